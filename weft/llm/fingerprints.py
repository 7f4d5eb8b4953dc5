"""Document fingerprints by a quartile bucket digest.

Every window of five bytes gives six triplets of its first byte with two later ones; each triplet is hashed to one of
256 buckets.  A bucket's count is coded by the quartile of the 256 counts that it lies in (two bits), and two bytes in
front hold the logarithm of the length and how the quartiles compare.  Two digests differ by the
steps between their codes (from the lowest to the highest quartile counts double) and between their
headers; the sum is bounded, so that likeness = 1 - difference / bound lies between 0 and 1.

:func:`fingerprint_table` compares each document with its edited text, whose last quarter is the
beginning of the next document by ``doc_id``, and with that next document.  Documents meet their successor in one shuffle:
the order is cut at existing rows, and the first row of every stretch goes along to the stretch before it.
No stretch is held whole: a task keeps a few megabytes of text and one row for the next slice.

Defined cases.  A null text is empty; a text of fewer than three bytes has no triplet, so only its length shows.
Texts are read whole; a longer one than a slice is counted in pieces that overlap.  A null id comes
first; rows of equal ids go by the hash of their text, and equal rows are rows of their own, each
followed by its copy.  One row alone is its own successor.  An empty table gives no row.  Other
columns, whatever their names, are not read.  Equal texts have equal fingerprints, and only the bytes
count: nothing is normalised.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import slices

BUCKETS = 256
#: The two later bytes of a triplet, by their distance from the first, with the odd factor that hashes it.
TRIPLETS = [(1, 2, 0x9E3779B1), (1, 3, 0x85EBCA6B), (1, 4, 0xC2B2AE35), (2, 3, 0x27D4EB2F), (2, 4, 0x165667B1), (3, 4, 0xD3A2646D)]
#: Steps of the length code in a doubling of the length.
OCTAVE = 8
#: Difference of the lowest and highest quartile, of one length step and one step of a quartile ratio; the most
#: that lengths add; the difference at which two digests are not alike at all.
FAR = 6
LENGTH_STEP = 4
LENGTH_MOST = 48
RATIO_STEP = 1
BOUND = 308
#: Bytes counted at once.
PIECE = 4 << 20
RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

STEPS = np.abs(np.arange(4)[:, None] - np.arange(4)[None, :])
STEPS[0, 3] = STEPS[3, 0] = FAR


def bucket_counts(raw: list[bytes]) -> np.ndarray:
    """How often triplets of each text fall in each bucket: ``len(raw) x BUCKETS``."""
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    owner = np.repeat(np.arange(len(raw), dtype=np.int64), sizes)
    out = np.zeros(len(raw) * BUCKETS, dtype=np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE + 4].astype(np.uint32)
        own = owner[at : at + PIECE + 4]
        for second, third, factor in TRIPLETS:
            n = min(PIECE, len(piece) - third)
            if n <= 0:
                continue
            triplet = piece[:n] << np.uint32(16) | piece[second : second + n] << np.uint32(8) | piece[third : third + n]
            bucket = (triplet * np.uint32(factor)) >> shift
            inside = own[:n] == own[third : third + n]
            out += np.bincount((own[:n] * BUCKETS + bucket)[inside], minlength=len(out))
    return out.reshape(len(raw), BUCKETS)


def digests(raw: list[bytes]) -> np.ndarray:
    """A row of bytes for each text: length code, ratio code, then four buckets to a byte."""
    counts = bucket_counts(raw)
    ranked = np.sort(counts, axis=1)
    lower, middle, upper = (ranked[:, k * BUCKETS // 4 - 1][:, None] for k in (1, 2, 3))
    codes = (counts > lower).astype(np.uint8) + (counts > middle) + (counts > upper)
    packed = codes[:, 0::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]
    sizes = np.fromiter(map(len, raw), dtype=np.float64, count=len(raw))
    length = np.minimum(np.round(OCTAVE * np.log2(1 + sizes)), 255).astype(np.uint8)
    top = np.maximum(upper, 1)
    ratio = (15 * lower // top << 4 | 15 * middle // top).astype(np.uint8)
    return np.hstack([length[:, None], ratio, packed.astype(np.uint8)])


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The difference of digests row by row."""
    total = np.zeros(len(a), dtype=np.int64)
    for shift in (6, 4, 2, 0):
        total += STEPS[a[:, 2:] >> shift & 3, b[:, 2:] >> shift & 3].sum(axis=1)
    length = np.abs(a[:, 0].astype(np.int64) - b[:, 0]) * LENGTH_STEP
    ratio = sum(np.abs((a[:, 1] >> s & 15).astype(np.int64) - (b[:, 1] >> s & 15)) for s in (4, 0))
    return total + np.minimum(length, LENGTH_MOST) + RATIO_STEP * ratio


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.minimum(differences(a, b), BOUND) / BOUND


def written(rows: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in rows]


def _read(column: pd.Series) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column)), dtype=np.uint8).reshape(len(column), 2 + BUCKETS // 4)


def fingerprint(text: str | Column) -> Column:
    """The fingerprint of a text column as hexadecimal digits; null is empty."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(written(digests([t.encode() for t in column])), dtype=object)

    return run(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def likeness(a: str | Column, b: str | Column) -> Column:
    """How like two fingerprints are, 0 to 1; null if one is null."""

    @F.pandas_udf("double")
    def run(one: pd.Series, other: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=one.index)
        both = one.notna() & other.notna()
        out[both] = likenesses(_read(one[both]), _read(other[both]))
        return out

    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when(a.isNotNull() & b.isNotNull(), run(a, b))


def _key(doc_id, text_hash, row) -> tuple:
    return (doc_id is not None, doc_id or 0, text_hash, row)


def _stretches(keyed: DataFrame, parts: int) -> list[tuple]:
    """The first row's key of every stretch of the order by id, text hash and row: ``parts`` keys at most."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    keys = keyed.select("doc_id", "h", "s")
    firsts = keys.repartitionByRange(parts, "doc_id", "h", "s").sortWithinPartitions("doc_id", "h", "s")
    return sorted(_key(*r) for r in firsts.mapInArrow(first, "doc_id bigint, h bigint, s bigint").collect())


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows ``b, copy, doc_id, text``, sorted inside every stretch ``b``; all but the last row of a stretch, a
    copy of the next stretch's first, are the table's, each followed by its successor."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("s"))
    bounds = _stretches(keyed, parts)
    ids = np.array([k[1] if k[0] else np.iinfo(np.int64).min for k in bounds], dtype=np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("doc_id")
            own = column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            stretch = np.searchsorted(ids, own, side="right") - 1
            again, before = [], []
            for i in np.flatnonzero(np.isin(own, ids)).tolist():  # equal ids are told apart by the rest of the key
                key = _key(column[i].as_py(), batch.column("h")[i].as_py(), batch.column("s")[i].as_py())
                at = bisect_right(bounds, key) - 1
                stretch[i] = max(at, 0)
                if at >= 0 and bounds[at] == key:
                    again.append(i)
                    before.append((at - 1) % len(bounds))
            rows = batch.take(pa.array(np.concatenate([np.arange(len(own)), np.array(again, dtype=np.int64)])))
            b = np.concatenate([stretch, np.array(before, dtype=np.int64)]).astype(np.int32)
            copy = np.arange(len(b)) >= len(own)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(copy), *rows.columns], ["b", "copy", *rows.schema.names])

    out = keyed.mapInArrow(dealt, "b int, copy boolean, doc_id bigint, text string, h bigint, s bigint")
    return out.repartition(parts, "b").sortWithinPartitions("b", "copy", "doc_id", "h", "s").select("b", "doc_id", "text")


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by as many characters from the beginning of ``after``."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row."""
    names = [part.split()[0] for part in RESULT.split(", ")]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, np.ndarray] = ([], [], [], np.zeros((0, 2 + BUCKETS // 4), np.uint8))
        for part in slices(batches):
            if not part.num_rows:
                continue
            texts = part.column("text").to_pylist()
            stretch = held[0] + part.column("b").to_pylist()
            ids = held[1] + part.column("doc_id").to_pylist()
            every = held[2] + texts
            prints = np.vstack([held[3], digests([t.encode() for t in texts])])
            pairs = [i for i in range(len(every) - 1) if stretch[i] == stretch[i + 1]]
            changed = [edited(every[i], every[i + 1]).encode() for i in pairs]
            at = np.array(pairs, dtype=np.int64)
            others = digests(changed)
            columns = [
                pa.array([ids[i] for i in pairs], pa.int64()),
                pa.array([len(every[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                pa.array(written(prints[at]), pa.string()),
                pa.array(written(others), pa.string()),
                pa.array(likenesses(prints[at], others), pa.float64()),
                pa.array(likenesses(prints[at], prints[at + 1]), pa.float64()),
            ]
            held = (stretch[-1:], ids[-1:], every[-1:], prints[-1:])
            yield pa.RecordBatch.from_arrays(columns, names)

    return with_successors(docs).mapInArrow(compared, RESULT)
