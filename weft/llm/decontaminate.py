"""Benchmark decontamination with an FM-index per shard of training documents.

Words are the runs of digits, letters a-z (A-Z lower-cased) and anything outside ASCII.  A shard is a block of documents;
its text is the sequence of their words, and as only benchmark phrases are searched, words that
no phrase has become gaps between stretches (a run of them is one gap).  Phrases of ten
words, or a whole item of fewer, are searched backward through the ranks of a wavelet matrix; the
occurrences are located by sampled suffix positions, and the spans are merged.

The benchmark is sent to the tasks in blocks of items of bounded size, and each block is searched in
every shard; a task holds one block at a time.  Null and empty texts have no words; repeated ids are separate documents, and
an item id that occurs twice is one item with the phrases of both; a null item id counts as the item "".  An empty benchmark
hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import gathered, ragged
from weft.llm.fmindex import FMIndex

WINDOW = 10
#: Bytes of text per shard.
SHARD_BYTES = 4 << 20
#: Bytes of item text per block sent to the tasks.
ITEM_BYTES = 8 << 20

#: Bytes to word bytes: A-Z to a-z, digits and everything outside ASCII stay, the rest separates.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
SEPARATES = np.frombuffer(WORD_BYTES, np.uint8) == 0x20


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = (text or "").encode("utf-8") if not isinstance(text, bytes) else text
    return raw.translate(WORD_BYTES).split()


class Phrases:
    """The phrases of a block of items: numbered words, padded rows, and the items of each phrase."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        owners: dict[tuple, set[str]] = {}
        for item, text in items:
            w = words_of(text)
            spans = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)] if len(w) >= window else [tuple(w)] if w else []
            for s in spans:
                owners.setdefault(s, set()).add("" if item is None else str(item))
        self.number = {w: i + 2 for i, w in enumerate(sorted({w for s in owners for w in s}))}  # 0 ends, 1 is a gap
        self.owners = list(owners.values())
        self.lengths = np.array([len(s) for s in owners], dtype=np.int64)
        self.rows = np.zeros((len(owners), window), dtype=np.int64)
        for i, s in enumerate(owners):
            self.rows[i, : len(s)] = [self.number[w] for w in s]


def hits(letters: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(position, phrase) of every occurrence in a shard's sequence, where 1 stands for other words."""
    foreign = letters == 1
    kept = np.ones(len(letters), dtype=bool)
    kept[1:] = ~(foreign[1:] & foreign[:-1])
    place = np.flatnonzero(kept)
    index = FMIndex(letters[place], len(phrases.number) + 2)
    lo, hi = index.search(phrases.rows, phrases.lengths)
    n = hi - lo
    phrase = np.repeat(np.arange(len(n)), n)
    at = index.locate(ragged(lo, n))
    return place[at], phrase


def _blocks(benchmark: DataFrame, window: int) -> list:
    """The benchmark's phrases as broadcasts of bounded size."""
    spark = benchmark.sparkSession
    blocks, held, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= ITEM_BYTES:
            blocks.append(spark.sparkContext.broadcast(Phrases(held, window)))
            held, size = [], 0
    if held or not blocks:
        blocks.append(spark.sparkContext.broadcast(Phrases(held, window)))
    return blocks


def one_by_one(blocks: list) -> Iterator[Phrases]:
    """The broadcast blocks; where there are several, each is let go before the next is read."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)


def search(texts: list[str | None], blocks: Iterable[Phrases]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """A shard's documents: (words, first word's place, hit flags by place, items found)."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes + np.arange(len(split))  # a gap before each document but the first
    covered = np.zeros(int(sizes.sum()) + len(split) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in split]
    for phrases in blocks:
        if not len(phrases.owners):
            continue
        letters = np.ones(int(sizes.sum()) + len(split) - 1, dtype=np.int64)
        get = phrases.number.get
        for w, start in zip(split, starts.tolist()):
            letters[start : start + len(w)] = [get(x, 1) for x in w]
        at, phrase = hits(letters, phrases)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + phrases.lengths[phrase], -1)
        doc = np.searchsorted(starts, at, side="right") - 1
        for d, p in set(zip(doc.tolist(), phrase.tolist())):
            items[d] |= phrases.owners[p]
    return sizes, starts, np.cumsum(covered) > 0, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_spans: bool = False) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``; ``with_spans``
    adds ``text`` and ``spans``, the merged removal spans as arrays of (start, end) in code points."""
    blocks = _blocks(benchmark, window)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] + ["text", "spans"] * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "text", SHARD_BYTES):
            texts = part.column("text").to_pylist()
            sizes, starts, hit, items = search(texts, one_by_one(blocks))
            total = np.concatenate(([0], np.cumsum(hit)))
            n_hit = total[starts + sizes] - total[starts]
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            columns = [
                part.column("doc_id"),
                pa.array(sizes),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array(sha),
                pa.array(n_hit > 0),
            ]
            if with_spans:
                spans = [_spans(t, hit[s : s + n]) if c else [] for t, s, n, c in zip(texts, starts.tolist(), sizes.tolist(), (n_hit > 0).tolist())]
                columns += [part.column("text"), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    schema += ", text string, spans array<struct<start:int,end:int>>" * with_spans
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code points of the runs of hit words, from a run's first word to the end of its last."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    inside = ~SEPARATES[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(point[begins[a]]), int(point[ends[b - 1]])) for a, b in zip(runs[::2].tolist(), runs[1::2].tolist())]


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans; what is left is joined as it stands."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents (all columns) without the spans that benchmark phrases cover.

    A document that had words and has none left goes; ``n_chars``, if there, follows the text.
    """
    blocks = _blocks(benchmark, window)
    schema, at = docs.schema, docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "text", SHARD_BYTES):
            texts = part.column(at).to_pylist()
            sizes, starts, hit, _ = search(texts, one_by_one(blocks))
            kept = np.ones(len(texts), dtype=bool)
            lengths = None if counted is None else part.column(counted).to_pylist()
            for i, (t, s, n) in enumerate(zip(texts, starts.tolist(), sizes.tolist())):
                mine = hit[s : s + n]
                if mine.any():
                    kept[i] = not mine.all()
                    texts[i] = remove_spans(t, _spans(t, mine))
                    if lengths is not None:
                        lengths[i] = len(texts[i])
            columns = list(part.columns)
            columns[at] = pa.array(texts, part.schema.field(at).type)
            if counted is not None:
                columns[counted] = pa.array(lengths, part.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(kept))

    return docs.mapInArrow(run, schema)
