"""Whitening of embeddings by shifted Cholesky QR.

Entries become whole numbers x = floor(256 c).  The fit list holds each distinct x vector once.  Its
centred rows A are never stored or gathered: one pass over the fit list sums the Gram matrix of
A R1^-1 R2^-1 ... , each row going through the triangular solves of the factors found so far, and the
driver factors that Gram matrix (a shift on its diagonal keeps the first factor from breaking down on ill-conditioned
rows).  The factors composed give R with A = Q R; the singular value decomposition of R gives the components
(right vectors) and the eigenvalues (squares over n) of A's covariance.

Defined cases.  Rows whose vector is null or empty, holds a null or a non-finite entry, or one whose
256-fold doesn't fit 64 bits, give no row; neither does a vector of another number of entries than the most
frequent one (the greater of equally frequent).  Repeated rows and ids are rows of their own in
the result and one vector of the fit list.  Components without spread can't be scaled and are left out: constant data (or one
distinct vector, or no row) give no row.  Equal eigenvalues leave their components' basis open, but it is
one basis for all rows.  A deviation that doesn't fit 64 bits is null in ``deviation``; ``deviation_exact`` holds its digits always.
Other columns of the table, whatever their names, are not read.

Only matrices of dimension x dimension, one row per dimension, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import stored

#: Whole numbers per unit of an entry.
SCALE = 256
COMPONENTS = 4
#: Rows that go through the solves together.
BLOCK = 4_096
#: The Gram matrix may differ from the identity by so much when the passes end, and the passes at most.
ORTHOGONAL = 1e-12
PASSES = 6
#: Eigenvalues below this share of the greatest are rounding.
NOTHING = 1e-13


def whole(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers that take part, their x vectors) of a list column; all lengths equal ``dimension``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dimension)
    flat = column.take(pa.array(rows)).flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), dimension)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * SCALE)
        usable = (np.abs(scaled) < 2.0**63).all(axis=1)
    return rows[usable], scaled[usable].astype(np.int64)


def _dimension(vectors: DataFrame) -> int:
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= 2.0**63))
    lengths = vectors.filter(usable).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def rows_of(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def fit_list(vectors: DataFrame, dimension: int) -> DataFrame:
    """Each distinct x vector once: ``x array<bigint>``."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = whole(batch.column("v"), dimension)
            yield pa.RecordBatch.from_arrays([_lists(x.reshape(-1), dimension, pa.int64())], ["x"])

    return vectors.select("v").mapInArrow(scaled, "x array<bigint>").distinct()


def _lists(flat: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, len(flat) + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """(rows, exact sum of every dimension): high and low halves are added apart."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for batch in batches:
            x = rows_of(batch.column("x"), dimension)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        dims = np.arange(dimension)
        columns = [pa.array(dims, pa.int32()), pa.array(np.full(dimension, n)), pa.array(high), pa.array(low)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = fit.mapInArrow(halves, "i int, n bigint, high bigint, low bigint")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), exact("high"), exact("low")).orderBy("i").collect()
    if not rows:
        return 0, [0] * dimension
    return rows[0]["n"], [int(r["high"]) * (1 << 32) + int(r["low"]) for r in rows]


def through(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``factor``, one column after the other."""
    out = np.asfortranarray(rows)
    for j in range(factor.shape[0]):
        if j:
            out[:, j] -= out[:, :j] @ factor[:j, j]
        out[:, j] /= factor[j, j]
    return out


def _centred(x: np.ndarray, mean: np.ndarray, fraction: np.ndarray) -> np.ndarray:
    """x minus the mean, which is given as its whole part and the rest."""
    return (x - mean).astype(np.float64) - fraction


def _summed(fit: DataFrame, dimension: int, width: int, block) -> np.ndarray:
    """The sum over all rows of ``block(x)``'s Gram matrix, ``width`` wide.

    A task adds its blocks up and sends a row per line of the matrix; the lines are added where
    they meet, so that the driver takes ``width`` rows, whatever the number of tasks.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = rows_of(batch.column("x"), dimension)
            for a in range(0, len(x), BLOCK):
                y = block(x[a : a + BLOCK])
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), _lists(total.reshape(-1), width, pa.float64())], ["i", "line"])

    def added(table: pa.Table) -> pa.Table:
        line = rows_of(table.column("line"), width).sum(axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "line": _lists(line, width, pa.float64())})

    lines = fit.mapInArrow(partial, "i int, line array<double>").groupBy("i").applyInArrow(added, "i int, line array<double>")
    return np.array([r["line"] for r in lines.orderBy("i").collect()])


def shifted_factor(gram: np.ndarray, rows: int, plain: bool) -> np.ndarray:
    """Upper Cholesky factor of the Gram matrix; with a shift at first, or where it isn't definite."""
    d = len(gram)
    if plain:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    unit = np.finfo(np.float64).eps / 2
    shift = 11 * (rows * d + d * (d + 1)) * unit * max(float(np.trace(gram)), np.finfo(np.float64).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def orthogonalise(fit: DataFrame, dimension: int, n: int, mean: np.ndarray, fraction: np.ndarray) -> np.ndarray:
    """R of the centred fit list, by Gram passes: the first factor is shifted, later ones mend it.

    The last Gram matrix G isn't quite the identity (nor is it where the rows have less than full rank), so its
    root, made triangular, is composed with the factors: R^T R equals A^T A whatever the shifts were.
    """
    factors: list[np.ndarray] = []
    composed = np.eye(dimension)
    for turn in range(PASSES):
        made = tuple(factors)

        def block(x: np.ndarray) -> np.ndarray:
            rows = _centred(x, mean, fraction)
            for factor in made:
                rows = through(rows, factor)
            return rows

        gram = _summed(fit, dimension, dimension, block)
        gram = (gram + gram.T) / 2
        done = np.abs(gram - np.eye(dimension)).max() <= ORTHOGONAL or not np.trace(gram) > 0
        if done or turn == PASSES - 1:
            break
        factors.append(shifted_factor(gram, n, plain=turn > 0))
        composed = factors[-1] @ composed
    value, vector = np.linalg.eigh(gram)
    root = np.sqrt(np.maximum(value, 0))[:, None] * vector.T
    return np.linalg.qr(root, mode="r") @ composed


def components(fit: DataFrame, dimension: int, wanted: int = COMPONENTS) -> dict | None:
    """What whitens a row: ``n, sums, mean, fraction, directions, eigenvalues, trace, error``; None without spread."""
    n, sums = _sums(fit, dimension)
    if not n:
        return None
    mean = np.array([s // n for s in sums], dtype=np.int64)
    fraction = np.array([(s % n) / n for s in sums])
    factor = orthogonalise(fit, dimension, n, mean, fraction)
    _, singular, right = np.linalg.svd(factor)
    eigenvalues = singular**2 / n
    keep = int((eigenvalues[:wanted] > NOTHING * max(eigenvalues[0], np.finfo(np.float64).tiny)).sum())
    if not keep:
        return None
    directions = right[:keep].T / np.sqrt(eigenvalues[:keep])

    def block(x: np.ndarray) -> np.ndarray:  # with a column of ones, so that the mean comes along
        return np.hstack([_centred(x, mean, fraction) @ directions, np.ones((len(x), 1))])

    moments = _summed(fit, dimension, keep + 1, block) / n
    centre = moments[:-1, -1]
    covariance = moments[:-1, :-1] - np.outer(centre, centre)
    return {
        "n": n,
        "sums": sums,
        "mean": mean,
        "fraction": fraction,
        "directions": directions,
        "explained": eigenvalues[:keep] / eigenvalues.sum(),
        "error": float(np.abs(covariance - np.eye(keep)).max()),
    }


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n x - S)^2 of every row, exact: three sums of whole numbers a row
    where these fit 64 bits, else number by number."""
    d = x.shape[1]
    squares = sum(s * s for s in sums)
    largest = int(np.abs(x).max(initial=0))
    if 0 <= largest and d * largest * max(largest, 1 << 32) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        s = np.array(sums, dtype=np.int64)
        own = (x * x).sum(axis=1).tolist()
        high, low = (x @ (s >> 32)).tolist(), (x @ (s & 0xFFFFFFFF)).tolist()
        return [n * n * a - 2 * n * ((h << 32) + b) + squares for a, h, b in zip(own, high, low)]
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]


RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact string"


def whiten(table: DataFrame, column: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact``: a row for every
    usable row of the table and component."""
    spark = table.sparkSession
    names = RESULT.replace(" bigint", "").replace(" int", "").replace(" double", "").replace(" string", "").split(", ")
    vectors = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    dimension = _dimension(vectors)
    if not dimension:
        return spark.createDataFrame([], RESULT)
    model = components(stored(fit_list(vectors, dimension), "whitening-fit"), dimension, wanted)
    if model is None:
        return spark.createDataFrame([], RESULT)
    keep = model["directions"].shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole(batch.column("v"), dimension)
            white = _centred(x, model["mean"], model["fraction"]) @ model["directions"]
            exact = deviations(x, model["n"], model["sums"])
            fits = [v if v < 1 << 63 else None for v in exact]
            each = np.repeat(np.arange(len(rows)), keep)
            columns = [
                batch.column("vec_id").take(pa.array(rows[each])),
                pa.array(np.tile(np.arange(1, keep + 1), len(rows)), pa.int32()),
                pa.array(np.full(len(each), model["n"]), pa.int64()),
                pa.array(fits, pa.int64()).take(pa.array(each)),
                pa.array(white.reshape(-1), pa.float64()),
                pa.array(np.tile(model["explained"], len(rows)), pa.float64()),
                pa.array(np.full(len(each), model["error"]), pa.float64()),
                pa.array(list(map(str, exact)), pa.string()).take(pa.array(each)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.mapInArrow(project, RESULT)
