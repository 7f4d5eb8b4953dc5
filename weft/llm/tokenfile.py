"""Token files with directly addressable codes.

An id is split in chunks of eight bits, lowest first.  Level 0 holds the first chunk of every
token and a bitmap that says whether the token goes on; level k + 1 holds the next chunk of those
that do.  A directory with the running count of set bits every 512 positions leads from a position
at one level to its place at the next, so any token is read with one byte per level, and nothing
is decoded on the way.

File, little-endian::

    magic "DAC1" | levels u32 | documents u64 | tokens u64
    document ids i64 * documents | id present u8 * documents | first token u64 * (documents + 1)
    per level: size u64 | chunks u8 * size | bitmap u64 * ceil(size / 64)
               | directory u64 * (ceil(size / 512) + 1)

Documents with equal ids keep the order of their text.  A null id sorts first and comes back null; a
null or empty text is a document of the end id alone.  No document gives no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.arrow import new_folder
from weft.llm.encoding import default_path, encoded

MAGIC = b"DAC1"
#: Positions per directory entry.
BLOCK = 512
#: Tokens gathered before a file is closed.
FILE_TOKENS = 4_000_000

_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
MANIFEST = "shard bigint, part int, path string, n_docs bigint, n_tokens bigint"


def split_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, goes on) of every level."""
    out, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest >> 8
        on = more > 0
        out.append(((rest & 255).astype(np.uint8), on))
        if not on.any():
            return out
        rest = more[on]


def _level_bytes(chunks: np.ndarray, on: np.ndarray) -> bytes:
    n = len(chunks)
    bitmap = np.zeros(-(-n // 64) * 8, dtype=np.uint8)
    packed = np.packbits(on, bitorder="little")
    bitmap[: len(packed)] = packed
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK // 8, dtype=np.uint8)
    padded[: len(packed)] = packed
    per_block = _BITS[padded].reshape(blocks, BLOCK // 8).sum(axis=1, dtype=np.uint64)
    directory = np.concatenate((np.zeros(1, np.uint64), np.cumsum(per_block, dtype=np.uint64)))
    return np.uint64(n).tobytes() + chunks.tobytes() + bitmap.tobytes() + directory.tobytes()


def to_bytes(doc_ids: list[int | None], bounds: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: the documents' ids, their bounds in ``ids`` and the ids themselves."""
    levels = split_levels(ids)
    there = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = MAGIC + np.array([len(levels)], "<u4").tobytes() + np.array([len(doc_ids), len(ids)], "<u8").tobytes()
    body = [names.tobytes(), there.tobytes(), np.asarray(bounds, dtype="<u8").tobytes()]
    return b"".join([head, *body, *(_level_bytes(*level) for level in levels)])


class TokenFile:
    """Reads one file through a random-access handle; only the parts asked for are fetched."""

    def __init__(self, handle):
        self.handle = handle
        head = self._read(0, 24)
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        levels = int(np.frombuffer(head[4:8], "<u4")[0])
        self.n_docs, self.n_tokens = (int(x) for x in np.frombuffer(head[8:], "<u8"))
        at = 24 + 9 * self.n_docs + 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(self._read(at, 8), "<u8")[0])
            bitmap = at + 8 + n
            directory = bitmap + -(-n // 64) * 8
            self.levels.append((n, at + 8, bitmap, directory))
            at = directory + 8 * (-(-n // BLOCK) + 1)

    def _read(self, at: int, n: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(n)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """(document ids, bounds of their tokens)."""
        n = self.n_docs
        names = np.frombuffer(self._read(24, 8 * n), "<i8")
        there = np.frombuffer(self._read(24 + 8 * n, n), np.uint8)
        bounds = np.frombuffer(self._read(24 + 9 * n, 8 * (n + 1)), "<u8").astype(np.int64)
        return [int(d) if t else None for d, t in zip(names, there)], bounds

    def all(self) -> np.ndarray:
        """Every id of the file."""
        out = np.zeros(self.n_tokens, dtype="<u4")
        where = np.arange(self.n_tokens)
        for k, (n, chunks, bitmap, directory) in enumerate(self.levels):
            out[where] |= np.frombuffer(self._read(chunks, n), np.uint8).astype(np.uint32) << np.uint32(8 * k)
            if k + 1 < len(self.levels):
                raw = np.frombuffer(self._read(bitmap, directory - bitmap), np.uint8)
                where = where[np.unpackbits(raw, bitorder="little", count=n).astype(bool)]
        return out

    def token(self, position: int) -> int:
        """The id at one position: a byte per level, and one block of the bitmap to count in."""
        if not 0 <= position < self.n_tokens:
            raise IndexError(position)
        out = 0
        for k, (_, chunks, bitmap, directory) in enumerate(self.levels):
            out |= self._read(chunks + position, 1)[0] << (8 * k)
            if k + 1 == len(self.levels):
                break
            block, inside = divmod(position, BLOCK)
            raw = self._read(bitmap + block * BLOCK // 8, inside // 8 + 1)
            if not raw[inside // 8] >> (inside % 8) & 1:
                break
            below = int(np.frombuffer(self._read(directory + 8 * block, 8), "<u8")[0])
            last = raw[inside // 8] & ((1 << (inside % 8)) - 1)
            position = below + int(_BITS[np.frombuffer(raw[: inside // 8], np.uint8)].sum()) + int(_BITS[last])
        return out


def open_file(path: str) -> TokenFile:
    system, inner = pafs.FileSystem.from_uri(path)
    return TokenFile(system.open_input_file(inner))


def _uri(folder: str) -> str:
    return folder if "://" in folder else f"file://{folder}"


def write_tokens(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Encodes ``doc_id, text`` in ascending order of ``doc_id`` to token files below ``folder``.

    Returns the manifest ``shard, part, path, n_docs, n_tokens``, which is itself written to the
    folder by Spark: a file of a task that was lost or run twice is not in it.
    """
    spark, path, folder = docs.sparkSession, path or default_path(), _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part = TaskContext.get().partitionId(), 0
        system, inner = pafs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids, sizes = np.concatenate(held), np.concatenate(lengths)
            name = f"{shard:06d}-{part:05d}-{uuid.uuid4().hex}.dac"
            with system.open_output_stream(f"{inner}/{name}") as out:
                out.write(to_bytes(names, np.concatenate(([0], np.cumsum(sizes))), ids))
            row = [[shard], pa.array([part], pa.int32()), [f"{folder}/{name}"], [len(names)], [len(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, list) else x for x in row], ["shard", "part", "path", "n_docs", "n_tokens"])

        total = 0
        for rows, ids, bounds in encoded(batches, path, end_id):
            names += rows.column("doc_id").to_pylist()
            held.append(ids)
            lengths.append(np.diff(bounds))
            total += len(ids)
            if total >= file_tokens:
                yield close()
                part, total, names, held, lengths = part + 1, 0, [], [], []
        if names:
            yield close()

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{_uri(folder)}/manifest")


def located(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: the ids in all files before.  Two levels of running sums, over
    the files of a shard and over the shards."""
    inside = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("__n"))
    shards = shards.select("shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    files = manifest.withColumn("__f", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return files.join(shards, "shard").withColumn("start", F.col("__s") + F.col("__f")).drop("__s", "__f")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids``."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = open_file(row["path"])
                docs, bounds = file.documents()
                ids = file.all()
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = [
                    pa.array(docs, pa.int64()),
                    pa.array(bounds[:-1] + row["start"], pa.int64()),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(bounds, pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    files = located(manifest)
    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(spread, "path").mapInArrow(read, schema)


def lookup(manifest: DataFrame, positions: DataFrame) -> DataFrame:
    """The id at each ``position`` (over all files): ``position, token``; a position that is null
    or outside is left out.  A file is listed under every stretch of ``FILE_TOKENS`` positions that
    it touches, so positions meet their file by an equal stretch."""
    end = F.col("start") + F.col("n_tokens")
    stretch = lambda c: F.floor(c / F.lit(FILE_TOKENS)).cast("bigint")
    files = located(manifest).filter("n_tokens > 0").select(
        "path", "start", end.alias("end"), F.explode(F.sequence(stretch(F.col("start")), stretch(end - 1))).alias("stretch")
    )
    at = positions.select(F.col("position").cast("bigint").alias("position"))
    hit = at.withColumn("stretch", stretch(F.col("position"))).join(files, "stretch")
    hit = hit.filter((F.col("position") >= F.col("start")) & (F.col("position") < F.col("end")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, TokenFile | None] = ("", None)
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if opened[0] != row["path"]:
                    opened = (row["path"], open_file(row["path"]))
                found.append(opened[1].token(row["position"] - row["start"]))
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(found, pa.int64())], ["position", "token"])

    return hit.select("path", "start", "position").sortWithinPartitions("path").mapInArrow(read, "position bigint, token bigint")


def token_table(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Files written to a fresh folder below the shared one and read back."""
    return read_tokens(write_tokens(docs, new_folder(docs.sparkSession, "tokens"), path, end_id))
