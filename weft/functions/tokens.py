"""Tokenizers as columns: byte level and integer text on the JVM, the rest behind one protocol."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, IntegralType

BYTE_VOCAB = 256


def empty_ints() -> Column:
    return F.array().cast("array<int>")


def _bytes_of(texts: pa.Array) -> pa.ListArray:
    """The bytes are there already: one buffer and its offsets become one list array."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = raw.buffers()[2]
    values = np.zeros(0, np.int32)
    if data is not None:
        values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.int32)
    nulls = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(values), mask=nulls)


@F.arrow_udf(ArrayType(IntegerType()))
def _utf8(texts: pa.Array) -> pa.Array:
    return _bytes_of(texts)


def byte_encode(text: str | Column) -> Column:
    """UTF-8 bytes as ``array<int>``, by Arrow batches."""
    return _utf8(F.col(text) if isinstance(text, str) else text)


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def _utf8_parts(parts: pa.Array) -> pa.Array:
    starts = pa.array(np.asarray(parts.offsets, np.int64) - parts.offsets[0].as_py(), pa.int32())
    return pa.ListArray.from_arrays(starts, _bytes_of(parts.flatten()), mask=parts.is_null() if parts.null_count else None)


def byte_encode_parts(parts: str | Column) -> Column:
    """UTF-8 bytes of every text of an ``array<string>``, by Arrow batches."""
    return _utf8_parts(F.col(parts) if isinstance(parts, str) else parts)


#: Whole numbers of a list in as few bytes each as a batch allows; a negative width stands for lists with nulls inside.
NARROW = "struct<width:tinyint,data:binary>"
WIDTHS = {1: "<u1", 2: "<u2", 4: "<i4", 8: "<i8"}


def narrow_lists(lists: pa.Array) -> pa.StructArray:
    """Lists of whole numbers or truth values as bytes; a token id below 256 takes one byte and not four."""
    ends, flat = np.asarray(lists.offsets, np.int64), lists.flatten().cast(pa.int64())
    ends = ends - ends[0]
    if flat.null_count:
        known = np.asarray(flat.is_valid().to_numpy(zero_copy_only=False), "u1")
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
        data = pa.array([known[a:b].tobytes() + values[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
        width = -8
    else:
        values = flat.to_numpy(zero_copy_only=False)
        low, high = int(values.min(initial=0)), int(values.max(initial=0))
        width = 8 if low < -(1 << 31) or high >= 1 << 31 else 4 if low < 0 or high >= 1 << 16 else 2 if high >= 1 << 8 else 1
        raw = pa.py_buffer(values.astype(WIDTHS[width]))
        data = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((ends * width).astype(np.int32)), raw])
    widths = pa.array(np.full(len(lists), width, np.int8))
    return pa.StructArray.from_arrays([widths, data], ["width", "data"], mask=lists.is_null() if lists.null_count else None)


def wide_lists(narrow: pa.StructArray, element: pa.DataType) -> pa.ListArray:
    """The lists that :func:`narrow_lists` took."""
    widths = narrow.field("width").fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = narrow.field("data").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if len(raw) and raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    counts = np.diff(ends) // np.where(widths < 0, 9, widths)
    if len(np.unique(widths)) == 1 and widths[0] > 0:
        flat = pa.array(data[ends[0] : ends[-1]].view(WIDTHS[int(widths[0])]).astype(np.int64))
    else:
        values, known = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for a, b, n, width in zip(ends.tolist(), ends[1:].tolist(), counts.tolist(), widths.tolist()):
            values.append(data[a + n * (width < 0) : b].copy().view(WIDTHS[abs(width)]).astype(np.int64))
            known.append(data[a : a + n].astype(bool) if width < 0 else np.ones(n, bool))
        flat = pa.array(np.concatenate(values), mask=~np.concatenate(known))
    starts = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    return pa.ListArray.from_arrays(starts, flat.cast(element), mask=narrow.is_null() if narrow.null_count else None)


def can_narrow(kind: DataType) -> bool:
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, (IntegralType, BooleanType))


def narrowed(lists: str | Column) -> Column:
    """An array of whole numbers or truth values as bytes, for a shuffle."""

    @F.arrow_udf(NARROW)
    def run(lists: pa.Array) -> pa.Array:
        return narrow_lists(lists)

    return run(lists)


def widened(narrow: str | Column, kind: ArrayType) -> Column:
    """The array that :func:`narrowed` took, of the type that it had."""
    element = to_arrow_type(kind.elementType)

    @F.arrow_udf(kind)
    def run(narrow: pa.Array) -> pa.Array:
        return wide_lists(narrow, element)

    return run(narrow)


def byte_values(text: str | Column) -> Column:
    """The same as an expression that also works inside a lambda; Latin-1 maps every byte to one
    character."""
    c = F.col(text) if isinstance(text, str) else text
    one_char_per_byte = F.decode(F.encode(c, "utf-8"), "ISO-8859-1")
    return F.when(F.length(c) == 0, empty_ints()).otherwise(
        F.transform(F.split(one_char_per_byte, ""), lambda ch: F.ascii(ch))
    )


def byte_decode(tokens: str | Column, special_start: int = BYTE_VOCAB) -> Column:
    """Text of byte tokens: special ids dropped, malformed bytes ignored, right-stripped."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        kept = (flat >= 0) & (flat < special_start)
        ends = np.concatenate(([0], np.cumsum(kept)))[np.asarray(ids.offsets, np.int64) - ids.offsets[0].as_py()].tolist()
        data = flat[kept].astype("u1").tobytes()
        texts = [data[a:b].decode("utf-8", errors="ignore").rstrip() for a, b in zip(ends, ends[1:])]
        return pa.array(texts, pa.string(), mask=np.asarray(ids.is_null()))

    return decode(F.col(tokens) if isinstance(tokens, str) else tokens)


def int_encode(text: str | Column) -> Column:
    """Ids written as text, split on single blanks."""
    c = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(c, " "), lambda x: x.cast("int"))


def int_offsets(text: str | Column) -> Column:
    """Character offset of every id of :func:`int_encode`."""
    c = F.col(text) if isinstance(text, str) else text
    after_blank = F.transform(F.split(c, ""), lambda ch, i: F.when(ch == " ", i + 1))
    return F.concat(F.array(F.lit(0)), F.filter(after_blank, lambda i: i.isNotNull()))


class Tokenizer(Protocol):
    """Per-worker tokenizer: ``encode`` maps a text to ids, ``decode`` back."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class ByteTokenizer:
    """Python twin of :func:`byte_encode` for operators that re-tokenise fragments."""

    special_start = BYTE_VOCAB

    def encode(self, text: str) -> list[int]:
        return list(text.encode("utf-8"))

    def decode(self, ids: list[int]) -> str:
        kept = bytes(i for i in ids if 0 <= i < self.special_start)
        return kept.decode("utf-8", errors="ignore").rstrip()


#: Fixed value: how byte-level vocabularies of ranks cut a text before merging.
BYTE_LEVEL_WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def load_tokenizer(kind: str, path: str | None = None, pattern: str | None = None) -> Tokenizer:
    """Tokenizer by type: ``byte``, ``bpe-json``, ``sentencepiece``, ``tiktoken`` (a file of ranks, with its ``pattern``), ``null`` (ids
    written as text); vocabulary libraries are imported only where they are used, and a process reads a vocabulary once."""
    if kind == "byte":
        return ByteTokenizer()
    if kind == "bpe-json":
        from tokenizers import Tokenizer as JsonTokenizer

        inner = JsonTokenizer.from_file(path)

        class _Json:
            def encode(self, text):
                return inner.encode(text, add_special_tokens=False).ids

            def encode_batch(self, texts):
                return [e.ids for e in inner.encode_batch_fast(texts, add_special_tokens=False)]

            def decode(self, ids):
                return inner.decode(ids)

        return _Json()
    if kind == "sentencepiece":
        import sentencepiece

        inner = sentencepiece.SentencePieceProcessor(model_file=path)

        class _Sentencepiece:
            def encode(self, text):
                return inner.encode(text)

            def encode_batch(self, texts):
                return inner.encode(texts, num_threads=1)

            def decode(self, ids):
                return inner.decode(ids)

        return _Sentencepiece()
    if kind == "tiktoken":
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        ranked = tiktoken.Encoding("own", pat_str=pattern or BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})

        class _Tiktoken:
            def encode(self, text):
                return ranked.encode_ordinary(text)

            def encode_batch(self, texts):
                return ranked.encode_ordinary_batch(texts, num_threads=1)

            def decode(self, ids):
                return ranked.decode(ids)

        return _Tiktoken()
    if kind == "null":

        class _Null:
            def encode(self, text):
                return [int(x) for x in text.split(" ")]

            def decode(self, ids):
                return " ".join(map(str, ids))

        return _Null()
    raise ValueError(f"unknown tokenizer type {kind!r}")


#: Characters that a tokenizer is given in one call: what it returns for each token is many times the id.
CALL_CHARS = 1 << 20


def _calls(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in stretches of about :data:`CALL_CHARS`."""
    stretch, chars = [], 0
    for text in texts:
        stretch.append(text)
        chars += len(text)
        if chars >= CALL_CHARS:
            yield stretch
            stretch, chars = [], 0
    if stretch:
        yield stretch


def _coded(texts: list[str], together: Callable) -> pa.ListArray:
    """The ids of every text, held as whole numbers and not as objects."""
    sizes, values = [], [np.zeros(0, np.int32)]
    for stretch in _calls(texts):
        ids = together(stretch)
        sizes += map(len, ids)
        values.append(np.fromiter(itertools.chain.from_iterable(ids), np.int32))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32()), pa.array(np.concatenate(values)))


def encode_with(
    df: DataFrame, column: str, out: str, make: Callable[[], Tokenizer]
) -> DataFrame:
    """Encode an ``array<string>`` column to ``array<array<int>>``, one tokenizer per task."""

    @F.arrow_udf("array<array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = make()
        together = getattr(tok, "encode_batch", lambda texts: [tok.encode(t) for t in texts])
        for parts in batches:
            ids = _coded(parts.flatten().to_pylist(), together)
            starts = pa.array(np.asarray(parts.offsets, np.int64) - parts.offsets[0].as_py(), pa.int32())
            yield pa.ListArray.from_arrays(starts, ids, mask=parts.is_null() if parts.null_count else None)

    return df.withColumn(out, run(F.col(column)))
