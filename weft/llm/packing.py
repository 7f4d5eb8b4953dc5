"""Best-two-fit packing of token sequences.

Only lengths decide the packing, and a length is at most the capacity, so the plan is made on the
histogram of lengths (one count per length, whatever the size of the corpus) and carried out by
rank: document number r of its length goes where the plan puts the r-th one.

The plan, bin by bin: the longest length left opens the bin, then the longest that still fits is
added until none does.  Then the bin's smallest document is taken out if two documents left over
fill its widened gap more tightly, the best such two.  As long as all lengths of the finished
pattern are left, the same steps give the same pattern again, so it is repeated at once.

A document longer than the capacity is cut in pieces of the capacity and one that may be shorter.
A null or empty text is a document of the end id alone; a null id is kept; equal ids are
separate documents.  No document gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.arrow import pin
from weft.llm.encoding import default_path, encoded

CAPACITY = 4096
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def plan(counts: np.ndarray) -> np.ndarray:
    """The packing of ``counts[n]`` documents of every length n up to the capacity ``len - 1``.

    Rows ``(length, first rank, end rank, per bin, first bin, offset)``, sorted by length and rank:
    ranks ``first .. end - 1`` go to bins from ``first bin`` on, ``per bin`` in each, from ``offset``.
    """
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    if left[0]:
        raise ValueError("a length of 0 can't be packed")
    used = np.zeros_like(left)
    #: the longest length up to n of which some are left, 0 if none
    longest = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))

    def gone(length: int) -> None:
        """``length`` has run out: those that pointed to it point to the next shorter."""
        below = longest[length - 1]
        end = length
        while end <= capacity and longest[end] == length:
            end += 1
        longest[length:end] = below

    def take(length: int) -> None:
        left[length] -= 1
        if not left[length]:
            gone(length)

    def give(length: int) -> None:
        left[length] += 1
        if left[length] == 1:
            end = length
            while end <= capacity and longest[end] < length:
                end += 1
            longest[length:end] = length

    rows, bins = [], 0
    while longest[capacity]:
        pattern, gap = [], capacity
        while gap and longest[gap]:
            n = int(longest[gap])
            pattern.append(n)
            take(n)
            gap -= n
        if gap:
            smallest = pattern[-1]
            room = gap + smallest
            first = np.flatnonzero(left[: room // 2 + 1])  # the shorter of the two
            if len(first):
                second = longest[room - first]
                fits = (second > first) | ((second == first) & (left[first] > 1))
                both = np.where(fits, first + second, 0)
                best = int(both.argmax())
                if both[best] > smallest:
                    a, b = int(first[best]), int(second[best])
                    pattern.pop()
                    give(smallest)
                    for n in (b, a):
                        pattern.append(n)
                        take(n)
        lengths, per = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // per).min()) + 1
        offset = 0
        for n, m in sorted(zip(lengths.tolist(), per.tolist()), reverse=True):
            rows.append((n, used[n], used[n] + m * times, m, bins, offset))
            used[n] += m * times
            offset += n * m
            left[n] -= m * (times - 1)
            if times > 1 and not left[n]:
                gone(n)
        bins += times
    out = np.array(rows, dtype=np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encoded documents cut in pieces: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``)."""
    path = path or default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, bounds in encoded(batches, path, end_id):
            sizes = np.diff(bounds)
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            raw = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes())
            at = bounds[doc] + start
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            columns = [
                rows.column("doc_id").take(pa.array(doc)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(sums, pa.int64()),
            ]
            if with_ids:
                cut_at = np.concatenate((at, bounds[-1:]))
                columns.append(pa.LargeListArray.from_arrays(cut_at, pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES + ", ids array<int>" * with_ids
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, schema)


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for rows with a ``length`` from 1 to ``capacity``.

    The rows are written to the shared folder once, so ranks are read from fixed partitions: a
    running count per length inside a partition, plus the counts of the partitions before.
    """
    laid = pin(parts).withColumn("__p", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            value, first, n = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), dtype=np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(first, n) + np.repeat(seen[value], n)
            seen[value] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "__r"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields) + ", __r bigint"
    numbered = laid.mapInArrow(number, schema)
    totals = laid.groupBy("length", "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("length", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in laid.groupBy("length").agg(F.count(F.lit(1))).collect():  # a row per length at most
        counts[length] = n
    table = plan(counts)  # a few rows per length, whatever the corpus
    key = table[:, 0] << 40 | table[:, 1]
    shipped = parts.sparkSession.sparkContext.broadcast((key, table))

    names = parts.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shipped.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__r").to_numpy() + batch.column("__o").to_numpy()
            at = rows[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            turn = rank - at[:, 1]
            sequence, offset = at[:, 4] + turn // at[:, 3], at[:, 5] + turn % at[:, 3] * length
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return numbered.join(offsets, ["length", "__p"]).mapInArrow(assign, out + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents ``doc_id, text`` packed in sequences of at most ``capacity`` tokens."""
    return place(pieces(docs, path, end_id, capacity, with_ids), capacity)
