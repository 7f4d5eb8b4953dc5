"""Binary token corpora: ``<prefix>.bin`` payload and ``<prefix>.idx`` header, read and written by tasks.

A written corpus is a folder of shards with a manifest; the reader takes a folder or one
prefix.  Readers split by byte range, and every task finds its own sequences in the header.

Conditions on ``doc_id`` and ``seq_id`` are pushed down where the session allows it
(``spark.sql.python.filterPushdown.enabled``), or given to :func:`read_indexed`: shards outside are not opened, and of the others only
the bytes of the sequences in question are read.  Without ``tokens`` among the columns no payload is read at all.
"""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

# Fixed values of the file format: magic, version, element types by code, small vocabulary bound.
MAGIC = b"MMIDIDX\x00\x00"
VERSION = 1
DTYPES = {1: "u1", 2: "i1", 3: "i2", 4: "i4", 5: "i8", 6: "f8", 7: "f4", 8: "u2"}
CODES = {v: k for k, v in DTYPES.items()}
SMALL_VOCAB = 65500
HEAD = len(MAGIC) + 8 + 1 + 8 + 8
MANIFEST = "_shards.json"
SCHEMA = (
    "dataset string, doc_id bigint, seq_no int, seq_id bigint, tokens array<{}>, "
    "n_tokens int, mode tinyint"
)
#: Column element of the types that 32-bit integers can't hold.
WIDE = {"i8": ("bigint", pa.int64()), "f8": ("double", pa.float64()), "f4": ("float", pa.float32())}


def column_type(dtype: np.dtype) -> tuple[str, pa.DataType]:
    return WIDE.get(dtype.str[1:], ("int", pa.int32()))


def arrow_schema(element: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("dataset", pa.string()),
            ("doc_id", pa.int64()),
            ("seq_no", pa.int32()),
            ("seq_id", pa.int64()),
            ("tokens", pa.list_(element)),
            ("n_tokens", pa.int32()),
            ("mode", pa.int8()),
        ]
    )


CHUNK = 4096


def token_dtype(vocab_size: int | None) -> str:
    return "u2" if vocab_size is not None and vocab_size < SMALL_VOCAB else "i4"


def _fs(path: str):
    if path.startswith("file:"):
        path = path[len("file:") :]
        path = "/" + path.lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class _Header:
    """Counts and array offsets of an ``.idx`` file; arrays are read in slices."""

    def __init__(self, prefix: str, multimodal: bool):
        system, path = _fs(prefix + ".idx")
        self.file = system.open_input_file(path)
        head = self.file.read_at(HEAD, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"bad header: {prefix}.idx")
        version, code, self.sequences, self.documents = struct.unpack("<QBQQ", head[len(MAGIC) :])
        if version != VERSION:
            raise ValueError(f"bad version {version}: {prefix}.idx")
        self.dtype = np.dtype("<" + DTYPES[code])
        self.at_lengths = HEAD
        self.at_pointers = self.at_lengths + 4 * self.sequences
        self.at_documents = self.at_pointers + 8 * self.sequences
        self.at_modes = self.at_documents + 8 * self.documents if multimodal else None

    def slice(self, at: int, kind: str, low: int, high: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at((high - low) * size, at + low * size), kind)

    def first_at_least(self, at: int, count: int, value: int) -> int:
        """First index whose 8-byte entry is >= value, by probing the sorted array in the file."""
        low, high = 0, count
        while low < high:
            mid = (low + high) // 2
            if self.slice(at, "<i8", mid, mid + 1)[0] < value:
                low = mid + 1
            else:
                high = mid
        return low


class _Range(InputPartition):
    """Sequences ``first`` to before ``end`` of a shard."""

    def __init__(self, prefix, first, end, doc_base, seq_base):
        self.prefix, self.first, self.end = prefix, first, end
        self.doc_base, self.seq_base = doc_base, seq_base


#: Beyond any number of documents or sequences.
FAR = 1 << 62


def narrowed(bounds: tuple[int, int], condition) -> tuple[int, int]:
    """The half-open range that a pushed condition leaves of ``bounds``; other conditions leave it as it is."""
    low, high = bounds
    value = getattr(condition, "value", None)
    if isinstance(condition, EqualTo) and isinstance(value, int):
        return max(low, value), min(high, value + 1)
    if isinstance(condition, In) and condition.value and all(isinstance(v, int) for v in condition.value):
        return max(low, min(condition.value)), min(high, max(condition.value) + 1)
    if isinstance(condition, GreaterThanOrEqual) and isinstance(value, int):
        return max(low, value), high
    if isinstance(condition, GreaterThan) and isinstance(value, int):
        return max(low, value + 1), high
    if isinstance(condition, LessThanOrEqual) and isinstance(value, int):
        return low, min(high, value + 1)
    if isinstance(condition, LessThan) and isinstance(value, int):
        return low, min(high, value)
    return bounds


class _Reader(DataSourceReader):
    def __init__(self, options, columns=None):
        self.path = options["path"].rstrip("/")
        self.multimodal = options.get("multimodal", "false") == "true"
        self.size = int(options.get("partition_bytes", str(128 << 20)))
        self.dataset = options.get("dataset", self.path.rsplit("/", 1)[-1])
        self.columns = columns
        self.ranges = {
            name: (int(options.get(f"{name}_from", "0")), int(options.get(f"{name}_before", str(FAR)))) for name in ("doc_id", "seq_id")
        }

    def _shards(self):
        """(prefix, documents before, sequences before, documents, sequences); counts are unknown for one prefix."""
        system, path = _fs(f"{self.path}/{MANIFEST}")
        if system.get_file_info(path).type == pafs.FileType.NotFound:
            yield self.path, 0, 0, None, None
            return
        docs = seqs = 0
        for shard in json.loads(system.open_input_file(path).read()):
            yield f"{self.path}/{shard['name']}", docs, seqs, shard["documents"], shard["sequences"]
            docs, seqs = docs + shard["documents"], seqs + shard["sequences"]

    def dtype(self):
        """Element type of the first shard; an empty corpus has 32-bit integers."""
        for prefix, *_ in self._shards():
            self._payload(prefix)
            return _Header(prefix, self.multimodal).dtype
        return np.dtype("<i4")

    @staticmethod
    def _payload(prefix):
        """File info of the payload; a missing half is an error."""
        system, path = _fs(prefix + ".bin")
        info = system.get_file_info(path)
        index = system.get_file_info(_fs(prefix + ".idx")[1])
        if pafs.FileType.NotFound in (info.type, index.type):
            raise ValueError(f"both {prefix}.bin and {prefix}.idx must exist")
        return info

    def _wanted(self, head, docs, seqs):
        """The sequences of a shard that the ranges leave, by its own numbers."""
        low, high = (min(max(x - seqs, 0), head.sequences) for x in self.ranges["seq_id"])
        first, before = (min(max(x - docs, 0), head.documents - 1) for x in self.ranges["doc_id"])
        if self.ranges["doc_id"] != (0, FAR) and head.documents:
            low = max(low, int(head.slice(head.at_documents, "<i8", first, first + 1)[0]))
            high = min(high, int(head.slice(head.at_documents, "<i8", before, before + 1)[0]))
        return low, high

    def partitions(self):
        out = []
        for prefix, docs, seqs, n_docs, n_seqs in self._shards():
            outside = [n is not None and (high <= base or low >= base + n) for (low, high), base, n in
                       zip((self.ranges["doc_id"], self.ranges["seq_id"]), (docs, seqs), (n_docs, n_seqs))]
            if any(outside):
                continue
            self._payload(prefix)
            head = _Header(prefix, self.multimodal)
            low, high = self._wanted(head, docs, seqs)
            if low >= high:
                continue
            begin = int(head.slice(head.at_pointers, "<i8", low, low + 1)[0])
            last = int(head.slice(head.at_pointers, "<i8", high - 1, high)[0])
            cuts = [head.first_at_least(head.at_pointers, head.sequences, at) for at in range(begin + self.size, last + 1, self.size)]
            edges = [low, *(c for c in cuts if low < c < high), high]
            out += [_Range(prefix, a, b, docs, seqs) for a, b in zip(edges[:-1], edges[1:]) if b > a]
        return out

    def read(self, part):
        head = _Header(part.prefix, self.multimodal)
        element = column_type(head.dtype)[1]
        if element != column_type(self.dtype())[1]:
            raise ValueError(f"{part.prefix}: elements of {head.dtype}, unlike the corpus' first shard")
        schema = arrow_schema(element)
        names = [f.name for f in schema] if self.columns is None else self.columns
        low, high = part.first, part.end
        system, path = _fs(part.prefix + ".bin")
        payload = system.open_input_file(path) if "tokens" in names else None
        # the document of a sequence: last bound that is <= its number
        doc = head.first_at_least(head.at_documents, head.documents, low + 1) - 1
        for a in range(low, high, CHUNK):
            b = min(a + CHUNK, high)
            lengths = head.slice(head.at_lengths, "<i4", a, b)
            bounds = head.slice(
                head.at_documents, "<i8", doc, min(head.documents, doc + (b - a) + 1)
            )
            # documents without sequences repeat a bound, so widen until the chunk is covered
            while bounds[-1] < b and doc + len(bounds) < head.documents:
                more = doc + len(bounds)
                bounds = np.concatenate(
                    [bounds, head.slice(head.at_documents, "<i8", more, min(head.documents, more + CHUNK))]
                )
            seq = np.arange(a, b)
            place = np.searchsorted(bounds, seq, side="right") - 1
            modes = (
                head.slice(head.at_modes, "i1", a, b) if self.multimodal else np.zeros(b - a, "i1")
            )
            columns = {
                "dataset": lambda: pa.array([self.dataset] * (b - a), pa.string()),
                "doc_id": lambda: pa.array(doc + place + part.doc_base, pa.int64()),
                "seq_no": lambda: pa.array((seq - bounds[place]).astype(np.int32), pa.int32()),
                "seq_id": lambda: pa.array(seq + part.seq_base, pa.int64()),
                "tokens": lambda: self._tokens(head, payload, lengths, a, element),
                "n_tokens": lambda: pa.array(lengths, pa.int32()),
                "mode": lambda: pa.array(modes, pa.int8()),
            }
            yield pa.RecordBatch.from_arrays([columns[name]() for name in names], schema=pa.schema([schema.field(name) for name in names]))
            doc += int(place[-1])


    @staticmethod
    def _tokens(head, payload, lengths, first, element):
        """The payload of the sequences from ``first`` on, in one piece."""
        begin = int(head.slice(head.at_pointers, "<i8", first, first + 1)[0])
        raw = payload.read_at(int(lengths.sum()) * head.dtype.itemsize, begin)
        values = np.frombuffer(raw, head.dtype).astype(element.to_pandas_dtype())
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


class _PushingReader(_Reader):
    """The reader of a session that pushes conditions down (others refuse one that could take them)."""

    def pushFilters(self, filters):
        """Ranges of the ids; Spark tests every condition again."""
        for condition in filters:
            name = getattr(condition, "attribute", ("",))[0]
            if name in self.ranges:
                self.ranges[name] = narrowed(self.ranges[name], condition)
            yield condition


class _Done(WriterCommitMessage):
    def __init__(self, order, name, sequences, documents):
        self.order, self.name = order, name
        self.sequences, self.documents = sequences, documents


class _Writer(DataSourceArrowWriter):
    """One shard per task under a name no retry can meet; the manifest names the winners."""

    def __init__(self, options, overwrite=False):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.dtype = np.dtype("<" + token_dtype(int(options["vocab_size"])))
        self.multimodal = options.get("multimodal", "false") == "true"

    def write(self, rows):
        from pyspark import TaskContext

        order = TaskContext.get().partitionId()
        name = f"part-{order:06d}-{uuid.uuid4().hex[:8]}"
        system, folder = _fs(self.path)
        system.create_dir(folder, recursive=True)
        lengths, modes, bounds, last, count = [], [], [0], None, 0
        with system.open_output_stream(f"{folder}/{name}.bin") as out:
            for batch in rows:
                if batch.num_rows == 0:
                    continue
                docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
                tokens = batch.column("tokens")
                # an array column is one flat run of values, so a batch is written at once
                flat = tokens.flatten().to_numpy(zero_copy_only=False)
                bound = np.iinfo(self.dtype)
                if len(flat) and not bound.min <= flat.min() <= flat.max() <= bound.max:
                    raise ValueError(f"tokens from {flat.min()} to {flat.max()} don't fit {self.dtype}: give a larger vocab_size")
                out.write(flat.astype(self.dtype).tobytes())
                lengths.append(tokens.value_lengths().to_numpy(zero_copy_only=False))
                modes.append(batch.column("mode").to_numpy(zero_copy_only=False))
                opens = np.flatnonzero(np.diff(docs)) + 1 + count
                if last is not None and docs[0] != last:
                    opens = np.concatenate([[count], opens])
                bounds += opens.tolist()
                last, count = docs[-1], count + len(docs)
        if count:
            bounds.append(count)
        lengths = np.concatenate(lengths) if lengths else np.zeros(0, "i4")
        modes = np.concatenate(modes) if modes else np.zeros(0, "i1")
        sizes = np.array(lengths, "<i4")
        ends = np.cumsum(sizes.astype("<i8")) * self.dtype.itemsize
        with system.open_output_stream(f"{folder}/{name}.idx") as out:
            code = CODES[self.dtype.str[1:]]
            out.write(MAGIC + struct.pack("<QBQQ", VERSION, code, count, len(bounds)))
            out.write(sizes.tobytes())
            out.write(np.concatenate([[0], ends[:-1]]).astype("<i8")[: len(lengths)].tobytes())
            out.write(np.array(bounds, "<i8").tobytes())
            if self.multimodal:
                out.write(np.array(modes, "i1").tobytes())
        return _Done(order, name, count, len(bounds) - 1)

    def commit(self, messages):
        done = sorted((m for m in messages if m is not None and m.sequences), key=lambda m: m.order)
        system, folder = _fs(self.path)
        shards, before = [], f"{folder}/{MANIFEST}"
        if not self.overwrite and system.get_file_info(before).type != pafs.FileType.NotFound:
            shards = json.loads(system.open_input_file(before).read())  # appended shards come last
            kinds = {s.get("dtype") for s in shards} - {None, self.dtype.str}
            if kinds:
                raise ValueError(f"the corpus has elements of {kinds.pop()}, not {self.dtype.str}")
        shards += [
            {"name": m.name, "sequences": m.sequences, "documents": m.documents, "dtype": self.dtype.str}
            for m in done
        ]
        with system.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(shards).encode())

    def abort(self, messages):
        """Nothing to undo: without a manifest entry a shard is never read."""


class IndexedCorpus(DataSource):
    @classmethod
    def name(cls):
        return "indexed_corpus"

    def schema(self):
        return SCHEMA.format(column_type(_Reader(self.options).dtype())[0])

    def reader(self, schema):
        pushes = self.options.get("pushdown", "false") == "true"
        return (_PushingReader if pushes else _Reader)(self.options, schema.fieldNames())

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme belongs to the cluster's default file system, as for Spark itself."""
    if ":" in path.split("/", 1)[0]:
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return path if default.startswith("file:") else f"{default.rstrip('/')}/{path.lstrip('/')}"


def read_indexed(
    spark: SparkSession,
    path: str,
    multimodal: bool = False,
    partition_bytes: int = 128 << 20,
    columns: list[str] | None = None,
    doc_ids: tuple[int, int] | None = None,
    seq_ids: tuple[int, int] | None = None,
) -> DataFrame:
    """Sequences of a corpus folder or of one prefix, with document and sequence numbers.

    ``columns`` chooses columns (no payload is read without ``tokens``); ``doc_ids`` and ``seq_ids``
    are ranges, the end not included, of which only the bytes are read.
    """
    spark.dataSource.register(IndexedCorpus)
    reader = spark.read.format("indexed_corpus").option("multimodal", str(multimodal).lower())
    reader = reader.option("partition_bytes", str(partition_bytes))
    reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, ids in (("doc_id", doc_ids), ("seq_id", seq_ids)):
        if ids is not None:
            reader = reader.option(f"{name}_from", str(ids[0])).option(f"{name}_before", str(ids[1]))
    place = qualified(spark, path)
    if columns is not None:
        kind = column_type(_Reader({"path": place, "multimodal": str(multimodal).lower()}).dtype())[0]
        types = dict(part.split(" ", 1) for part in SCHEMA.format(kind).split(", "))
        reader = reader.schema(", ".join(f"{c} {types[c]}" for c in columns))
    return reader.load(place)


def write_indexed(
    df: DataFrame, path: str, vocab_size: int, multimodal: bool = False, overwrite: bool = False
) -> None:
    """Write (doc_id, seq_no, tokens[, mode]) in document order; a document stays in one shard.

    A second write adds its documents behind those there, unless ``overwrite``.
    """
    df.sparkSession.dataSource.register(IndexedCorpus)
    mode = F.col("mode") if multimodal else F.lit(0)
    rows = df.select("doc_id", "seq_no", "tokens", mode.cast("tinyint").alias("mode"))
    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "seq_no")
        .write.format("indexed_corpus")
        .option("vocab_size", str(vocab_size))
        .option("multimodal", str(multimodal).lower())
        .mode("overwrite" if overwrite else "append")
        .save(qualified(df.sparkSession, path))
    )
