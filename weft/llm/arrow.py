"""Small helpers for Arrow batches inside tasks and for the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from weft.session import pin, shared_dir
from weft.session import small_batches as by_bytes

#: Rows that travel together to a Python worker.
BATCH_ROWS = 1_000
#: Text held at once by a task, in bytes; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def texts(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """A text column as one large-string array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def cuts(lengths: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges whose lengths add up to ``limit`` at most (a longer row stands alone)."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(lengths):
        out.append((start, len(lengths)))
    return out


def let_go() -> None:
    """Give memory that a task has freed back to the system: workers are kept for the next stage, and what their
    allocators hold back would add up from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts stay below ``limit`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        for a, b in cuts(sizes.to_numpy(zero_copy_only=False), limit):
            yield batch.slice(a, b - a)
    let_go()


def gathered(
    batches: Iterator[pa.RecordBatch], column: str, limit: int
) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of ``limit`` bytes of text at most (a longer text stands with empty ones only).  Where a block ends
    depends on the texts alone: other columns beside them may make Spark cut its batches elsewhere."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        for i, n in enumerate(lengths.to_numpy(zero_copy_only=False).tolist()):
            if size and size + n > limit:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, start = [], 0, i
            size += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        del held
    let_go()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all rows, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts split at blanks and line ends: (offsets per text, word numbers, distinct words).

    An empty piece between two blanks counts as a word of length 0.
    """
    split = pc.split_pattern(pc.replace_substring(texts(column), "\n", " "), " ")
    coded = split.flatten().dictionary_encode()
    offsets = np.asarray(split.offsets, dtype=np.int64)
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def small_batches(spark: SparkSession) -> None:
    """Rows of this package are whole texts, so a batch between Spark and its Python workers has few of
    them: ten thousand would be held several times over on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    by_bytes(spark)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: later jobs all see the
    same rows, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


__all__ = ["SLICE_BYTES", "cuts", "gathered", "new_folder", "pin", "ragged", "slices", "small_batches", "stored", "texts", "words"]
