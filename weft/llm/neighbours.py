"""Nearest neighbours by inner product with collision-counting hashing.

Vectors are dealt out in blocks.  A block projects its vectors on random lines and keeps each line as one
sorted array.  A query is projected on the same lines; the window around its place on each line grows
in steps (virtual rehashing: a wider window stands for wider buckets, nothing is hashed again)
and counts for every vector the lines on which it is inside.  The vectors with most collisions are verified first; the
distance of the k-th of them tells how many collisions a nearer vector has, give or take, which is the threshold: every vector
at or above it is verified.  Windows stop growing when that distance gives enough collisions to tell.  Verified
means: the inner product is computed in double precision on the original vectors.

Inner products become distances by one more coordinate that gives all vectors the block's greatest
length; a query has 0 there.  Blocks are cut by length, so that a few long vectors don't crowd the others together.

Vectors that are null, zero or hold a null or a component that isn't finite take no part; vectors meet
only those of their own number of components.  Queries are written to the shared folder once and
read from there by the tasks in bounded batches.  A query's own id is never its neighbour; a query
that occurs several times with the same vector is one.  With no more candidates than asked for in a
block, all are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.arrow import new_folder

NEAREST = 20
EVERY = 20
#: Lines per block at most, and the frames that they come in: all lines of a frame are orthogonal to each other, which
#: tells vectors apart far better than lines drawn each by itself.
LINES = 256
FRAMES = 2
#: First half-width of a window, on lines on which vectors of the block's greatest length have deviation 1.
HALF_WIDTH = 1.25
#: Windows are wide enough when a vector as far as the k-th found collides on this share of the lines.
SHARE = 0.78
#: Candidates may collide on so many deviations fewer lines than a vector as far as the k-th found.
DEVIATIONS = 1.1
#: Vectors verified at first, for each wanted.
FIRST = 3
#: Vectors of a block at most.
BLOCK_ROWS = 16_384


def frames(lines: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """``lines`` directions of ``size`` coordinates, orthogonal within each run of ``size``, of length sqrt(size)."""
    made = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-lines // size))]
    return (np.vstack(made)[:lines] * np.sqrt(size)).astype(np.float32)


def collision_share(half: float, distance: float) -> float:
    """Share of lines on which two vectors at a distance lie within ``half`` of each other."""
    return math.erf(half / max(distance, 1e-9) / math.sqrt(2))


class Lines:
    """Sorted projections of a block of vectors of one number of components."""

    def __init__(self, vectors: np.ndarray, lines: int = LINES, seed: int = 0):
        self.vectors = vectors
        lines = min(lines, FRAMES * (vectors.shape[1] + 1))
        norms = np.linalg.norm(vectors, axis=1)
        self.scale = float(norms.max())
        unit = (vectors / self.scale).astype(np.float32)
        rest = np.sqrt(np.maximum(1 - (norms / self.scale) ** 2, 0)).astype(np.float32)
        axes = frames(lines, vectors.shape[1] + 1, np.random.default_rng(seed))
        self.axes = axes[:, :-1]
        place = self.axes @ unit.T + axes[:, -1:] * rest[None, :]
        order = np.argsort(place, axis=1)
        # all lines in one ascending array, each moved to a stretch of its own
        self.apart = 4 * float(np.abs(place).max()) + 64
        self.sorted = (np.take_along_axis(place, order, axis=1) + self.apart * np.arange(lines)[:, None]).ravel()
        self.order = order.ravel()

    def collisions(self, centre: np.ndarray, half: float, first: int, last: int) -> np.ndarray:
        """On how many of the lines ``first .. last - 1`` each vector lies in the window around the query; what is rarer,
        inside or outside, is counted."""
        n = len(self.vectors)
        begin = n * np.arange(first, last)
        lo = np.clip(np.searchsorted(self.sorted, centre[first:last] - half), begin, begin + n)
        hi = np.clip(np.searchsorted(self.sorted, centre[first:last] + half, side="right"), begin, begin + n)
        spans = lambda a, b: [self.order[x:y] for x, y in zip(a.tolist(), b.tolist())]
        if 2 * int((hi - lo).sum()) <= n * (last - first):
            return np.bincount(np.concatenate(spans(lo, hi)), minlength=n)
        outside = np.concatenate(spans(begin, lo) + spans(hi, begin + n))
        return last - first - np.bincount(outside, minlength=n)

    def candidates(self, query: np.ndarray, wanted: int, deviations: float = DEVIATIONS) -> np.ndarray:
        """Vectors above the collision threshold of the ``wanted``-th nearest one found.

        Half of the lines find the width of the windows, then the others join in.
        """
        n, lines = len(self.vectors), len(self.axes)
        some = FIRST * wanted
        if n <= some:
            return np.arange(n)
        direction = query / np.linalg.norm(query)
        centre = self.axes @ direction.astype(np.float32) + self.apart * np.arange(lines)
        half, used = HALF_WIDTH, -(-lines // 2)
        counts = self.collisions(centre, half, 0, used)
        while True:
            top = np.argpartition(counts, n - some)[n - some :]
            likeness = np.sort(self.vectors[top] @ direction)[-wanted] / self.scale
            distance = math.sqrt(max(2 - 2 * float(likeness), 0.0))
            share = collision_share(half, distance)
            if share < SHARE:  # virtual rehashing: the same arrays, a wider window
                half = 1.3 * distance
                counts = self.collisions(centre, half, 0, used)
            elif used < lines:
                counts += self.collisions(centre, half, used, lines)
                used = lines
            else:
                break
        least = lines * share - deviations * math.sqrt(lines * share * (1 - share))
        return np.union1d(np.flatnonzero(counts >= least), top)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each by itself, so that equal vectors get equal numbers."""
    return np.einsum("ij,j->i", vectors.astype(np.float64), query.astype(np.float64), optimize=False)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]


def _valid(vectors: DataFrame) -> DataFrame:
    whole = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    zero = F.forall("embedding", lambda x: x == 0)
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    kept = kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("embedding"))
    return kept.filter(~bad & ~zero)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, lines: int = LINES, deviations: float = DEVIATIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    fine = _valid(vectors).withColumn("size", F.size("embedding"))
    folder = new_folder(spark, "queries")
    fine.filter(F.col("vec_id") % every == 0).distinct().write.parquet(folder)
    system_path = folder if "://" in folder else f"file://{folder}"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = pafs.FileSystem.from_uri(system_path)
        queries = pads.dataset(inner, filesystem=system, format="parquet")
        for ids, block in by_length(_blocks(batches, block_rows)):
            index = Lines(block, lines)
            same = pads.field("size") == block.shape[1]
            for part in queries.to_batches(filter=same, batch_size=4096) if queries.files else []:
                out = []
                for q, query in zip(part.column("vec_id").to_pylist(), _matrix(part.column("embedding"))):
                    found = index.candidates(query, k + 1, deviations)
                    found = found[ids[found] != q]
                    score = exact(query, block[found])
                    top = best(ids[found], score, k)
                    out.append((q, query.tobytes(), ids[found[top]], score[top]))
                if out:
                    sizes = [len(x[2]) for x in out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([x[0] for x in out], sizes), pa.int64()),
                            pa.array([x[1] for x, n in zip(out, sizes) for _ in range(n)], pa.binary()),
                            pa.array(np.concatenate([x[2] for x in out]), pa.int64()),
                            pa.array(np.concatenate([x[3] for x in out]), pa.float64()),
                        ],
                        ["query_id", "query", "vec_id", "score"],
                    )

    dealt = fine.repartition(F.xxhash64("vec_id", "embedding"))
    found = dealt.mapInArrow(search, "query_id bigint, query binary, vec_id bigint, score double")
    found = found.withColumn("query", F.xxhash64("query"))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of up to ``rows`` vectors of one length."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    counts: dict[int, int] = {}
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == size))
            for a in range(0, part.num_rows, rows):
                piece = part.slice(a, rows)
                if counts.get(size, 0) + piece.num_rows > rows:
                    yield _joined(held.pop(size))
                    counts[size] = 0
                held.setdefault(size, []).append((piece.column("vec_id").to_numpy(), _matrix(piece.column("embedding"))))
                counts[size] = counts.get(size, 0) + piece.num_rows
    for size in sorted(held):
        if held[size]:
            yield _joined(held[size])


def by_length(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks cut in bands of vector length, each to half as much again."""
    for ids, vectors in blocks:
        band = np.floor(2 * np.log2(np.linalg.norm(vectors, axis=1)) + 0.25)
        for b in np.unique(band).tolist():
            yield ids[band == b], vectors[band == b]


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
