"""Alignment of two tokenizers by sparse token-byte incidence matrices.

A token's row of its incidence matrix marks the bytes that it covers.  The row product A B^T of the two tokenizers'
matrices, both in compressed rows built here, gives the overlap links: pairs of tokens that share a byte.  Where
no link runs across a byte end, both tokenizers have a token end, which cuts the tokens into groups; the product of the
group-incidence matrices (ids x groups, groups x ids) gives the shared-group links.

Both tokenizers cut a text at a blank between two characters that are not white space, whatever stands around it.
So tokens, groups and links of a document are those of its pieces between such blanks, and every distinct
piece is encoded and multiplied once per block of documents.

How many documents hold a pair of ids linked needs the whole corpus.  Blocks of documents are stored
with their links by the number of the pair in the block; the pairs of a block, one row for each whatever
the number of documents, are counted, joined with the corpus-wide counts and sent back to their block.  Nothing is
broadcast or sent to the driver; a pair in every document is one row per block.

Defined cases.  A null or empty text, and one whose tokens' bytes differ from a blank and the text, has no
tokens: zeros and an empty string.  Such a document holds no pair.  Texts of white space, or with white space at
the ends or doubled, keep it in their pieces.  Repeated rows and equal or null ids are documents of their own.
A very long text is a block of its own.  No document gives no row.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import gathered, ragged, stored

#: Text of a block of documents, in bytes; pieces encoded in one call, and their characters at most.
BLOCK_BYTES = 8 << 20
TOGETHER = 1_000
CHARACTERS = 1 << 18
#: Products expanded at once.
PRODUCTS = 1 << 22
#: A blank where both tokenizers cut.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: A piece that is empty or has white space at an end, so that one of the blanks beside it is not such a blank.
WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHITE_ENDS = f"^$|^{WHITE}|{WHITE}$"

RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string, n_overlaps bigint"
)
BLOCKS = (
    "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, n_overlaps array<bigint>, bounds array<bigint>, pairs binary, times binary, "
    "keys array<bigint>, held array<bigint>"
)


@dataclass
class Rows:
    """A sparse matrix in compressed rows."""

    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def incidence(cls, lengths: np.ndarray) -> Rows:
        """Tokens x bytes: each token covers the bytes behind those of the tokens before."""
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        total = int(bounds[-1])
        return cls(bounds, np.arange(total), np.ones(total, dtype=np.int64), total)

    @classmethod
    def gathered(cls, row: np.ndarray, column: np.ndarray, height: int, width: int) -> Rows:
        """From entries in any order; equal places add up."""
        key, values = np.unique(row * width + column, return_counts=True)
        return cls(np.searchsorted(key, np.arange(height + 1) * width), key % width, values.astype(np.int64), width)

    @property
    def height(self) -> int:
        return len(self.bounds) - 1

    def transposed(self) -> Rows:
        """Columns as rows, by a stable counting sort."""
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(self.height), np.diff(self.bounds))
        bounds = np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width))))
        return Rows(bounds, row[order], self.values[order], self.height)

    def times(self, other: Rows) -> Rows:
        """Row product: row i of the result is the sum of other's rows that row i's columns name, each times its value.

        Rows are taken in blocks of a bounded number of products; a block's products are put in the order
        of (row, column), and equal places are added.
        """
        sizes = np.diff(other.bounds)[self.columns]
        before = np.concatenate(([0], np.cumsum(sizes)))[self.bounds]  # products before each row
        keys, sums, at = [], [], 0
        while at < self.height:
            end = max(at + 1, int(np.searchsorted(before, before[at] + PRODUCTS, side="right")) - 1)
            a, b = int(self.bounds[at]), int(self.bounds[end])
            row = np.repeat(np.arange(at, end), np.diff(self.bounds[at : end + 1]))
            entry = ragged(other.bounds[self.columns[a:b]], sizes[a:b])
            key = np.repeat(row, sizes[a:b]) * other.width + other.columns[entry]
            value = np.repeat(self.values[a:b], sizes[a:b]) * other.values[entry]
            if (np.diff(key) < 0).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            keys.append(key[first])
            sums.append(np.add.reduceat(value, first) if len(first) else value)
            at = end
        key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        values = np.concatenate(sums) if sums else np.zeros(0, dtype=np.int64)
        return Rows(np.searchsorted(key, np.arange(self.height + 1) * other.width), key % other.width, values, other.width)


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Rows:
    """Tokens of A x tokens of B: how many bytes both cover."""
    return Rows.incidence(a_lengths).times(Rows.incidence(b_lengths).transposed())


def groups_of(links: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every token of A and of B, from the overlap links of both in order of place: a
    group ends where the next token of A shares no token of B with what went before."""
    first, last = links.columns[links.bounds[:-1]], links.columns[links.bounds[1:] - 1]
    of_a = np.concatenate(([0], np.cumsum(first[1:] > last[:-1]))) if links.height else np.zeros(0, dtype=np.int64)
    of_b = np.zeros(links.width, dtype=np.int64)
    of_b[links.columns] = np.repeat(of_a, np.diff(links.bounds))
    return of_a, of_b


def letters_of_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable Latin-1, else
    the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Table:
    """Bytes of every id, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.starts[ids], self.lengths[ids])]


@dataclass
class Pieces:
    """What each distinct piece of text adds to its document, by arrays.

    ``fits`` is false for a piece that can't be tokenised, which adds nothing.  Piece i has the pairs of ids (A id << 32 |
    B id) from ``bounds[i]`` to ``bounds[i + 1] - 1`` of ``keys``, with ``times`` links each; ``groups`` spells its groups.
    """

    fits: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    n_overlaps: np.ndarray
    bounds: np.ndarray
    keys: np.ndarray
    times: np.ndarray
    groups: pa.Array


def _joined(lists: np.ndarray, items: pa.Array, by: str) -> pa.Array:
    """The strings ``items[lists[i]:lists[i + 1]]`` of every i in one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(lists, pa.int32()), items), pa.scalar(by, pa.large_string()))


class Aligner:
    """Both tokenizers and the bytes of their ids."""

    _made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = letters_of_bytes()
        vocab = self.a.get_vocab()
        entries = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            entries[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.a_table = Table(entries)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_table = Table([bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names])
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece with a blank behind another character: words can't be encoded by themselves")

    @classmethod
    def at(cls, a_path: str, b_path: str) -> Aligner:
        """One aligner per worker process and pair of files."""
        if (a_path, b_path) not in cls._made:
            cls._made[(a_path, b_path)] = cls(a_path, b_path)
        return cls._made[(a_path, b_path)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a blank and the text by A, and of the text by B; None where either's bytes aren't a blank and the text."""
        data = np.frombuffer(b" " + text.encode(), dtype=np.uint8)
        out = []
        for ids, table in ((self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.a_table), (self.b.encode(text, num_threads=1), self.b_table)):
            ids = np.asarray(ids, dtype=np.int64)
            if not np.array_equal(table.joined(ids), data):
                return None
            out.append(ids)
        return out[0], out[1]

    def _side_by_side(self, pieces: list[str]) -> list[tuple[list[np.ndarray], list[np.ndarray]] | None]:
        """(ids of A and B, tokens of each piece by A and B) of pieces in one text, or of each by itself if that can't be told
        apart; None for a piece that can't be tokenised."""
        ids = self.encode(" ".join(pieces))
        if ids is not None:
            ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
            cuts = []
            for own, table in zip(ids, (self.a_table, self.b_table)):
                token_ends = np.cumsum(table.lengths[own])
                at = np.searchsorted(token_ends, ends)
                if np.array_equal(token_ends[at], ends):
                    cuts.append(np.diff(at, prepend=-1))
            if len(cuts) == 2:
                return [(list(ids), cuts)]
        return [None] if len(pieces) == 1 else [x for p in pieces for x in self._side_by_side([p])]

    def pieces(self, wanted: list[str]) -> Pieces:
        """What each piece adds to its document."""
        together, size = [0], 0
        for i, piece in enumerate(wanted):
            if i > together[-1] and (i - together[-1] == TOGETHER or size + len(piece) > CHARACTERS):
                together.append(i)
                size = 0
            size += len(piece)
        parts = [x for a, b in zip(together, [*together[1:], len(wanted)]) if b > a for x in self._side_by_side(wanted[a:b])]
        nothing, unfit = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
        a, b = (np.concatenate([nothing, *(x[0][k] for x in parts if x)]) for k in (0, 1))
        n_a, n_b = (np.concatenate([nothing, *(x[1][k] if x else unfit for x in parts)]) for k in (0, 1))
        return self._multiply(a, b, n_a, n_b)

    def _multiply(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Pieces:
        """Groups and links of pieces with ``n_a`` and ``n_b`` tokens each."""
        n = len(n_a)
        a_cuts = np.concatenate(([0], np.cumsum(n_a)))
        links = overlaps(self.a_table.lengths[a], self.b_table.lengths[b])
        of_a, of_b = groups_of(links)
        total = int(of_a[-1]) + 1 if len(of_a) else 0
        piece = np.repeat(np.arange(n), n_a)
        # ids of a piece x groups, groups x ids: an id that comes again is one row with a greater value
        rows, row = np.unique(piece << 32 | a, return_inverse=True)
        by_group = Rows.gathered(of_b, b, total, len(self.b_table.lengths))
        shared = Rows.gathered(row, of_a, len(rows), total).times(by_group)
        owner = np.repeat(rows, np.diff(shared.bounds))
        bounds = np.searchsorted(owner >> 32, np.arange(n + 1))
        group_cuts = np.append(of_a, total)[a_cuts]
        text = lambda ids: pa.array(ids).cast(pa.large_string())
        each = np.arange(total + 1)
        sides = [_joined(np.searchsorted(of, each), text(ids), ",") for of, ids in ((of_a, a), (of_b, b))]
        return Pieces(
            fits=n_a > 0,
            n_a=n_a,
            n_b=n_b,
            n_groups=np.diff(group_cuts),
            n_links=np.diff(np.concatenate(([0], np.cumsum(shared.values)))[bounds]),
            n_overlaps=np.diff(links.bounds[a_cuts]),
            bounds=bounds,
            keys=(owner & 0xFFFFFFFF) << 32 | shared.columns,
            times=shared.values,
            groups=_joined(group_cuts, pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())), ";"),
        )


def pieces_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at the blanks where both tokenizers cut: (offsets per text, piece numbers, distinct pieces).

    A text without pieces is null or empty.
    """
    text = pc.fill_null(column.cast(pa.large_string()), "")
    split = pc.split_pattern(text, " ")
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.asarray(split.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]
    odd = pc.match_substring_regex(coded.dictionary, WHITE_ENDS).to_numpy(zero_copy_only=False)
    bad = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(odd[index])))[bounds]))
    if not len(bad):
        return bounds, index, distinct
    number = {p: i for i, p in enumerate(distinct)}
    parts, sizes, done = [], np.diff(bounds), 0
    for i in bad.tolist():  # white space beside a blank: cut by the rule
        whole = text[i].as_py()
        cut = SAFE.split(" " + whole) if whole else []
        cut[:1] = [p[1:] for p in cut[:1]]
        parts += [index[done : bounds[i]], np.array([number.setdefault(p, len(number)) for p in cut], dtype=np.int64)]
        sizes[i], done = len(cut), bounds[i + 1]
    parts.append(index[done:])
    return np.concatenate(([0], np.cumsum(sizes))), np.concatenate(parts), list(number)


def _block(aligner: Aligner, docs: pa.RecordBatch, block: int) -> pa.RecordBatch:
    """A block of documents as one row of ``BLOCKS``."""
    bounds, index, distinct = pieces_of(docs.column("text"))
    have = aligner.pieces(distinct)
    # documents with a piece that can't be tokenised have no tokens
    wrong = np.diff(np.concatenate(([0], np.cumsum(~have.fits[index])))[bounds]) > 0
    if wrong.any():
        sizes = np.diff(bounds)
        index = index[~np.repeat(wrong, sizes)]
        bounds = np.concatenate(([0], np.cumsum(np.where(wrong, 0, sizes))))

    def summed(name: str) -> pa.Array:
        return pa.array(np.diff(np.concatenate(([0], np.cumsum(getattr(have, name)[index])))[bounds]))

    spelled = _joined(bounds, have.groups.take(pa.array(index)), ";")
    hashed = [hashlib.sha256(s.as_buffer()).hexdigest() if n else "" for s, n in zip(spelled, np.diff(bounds).tolist())]
    # links of a document by the number of their pair in the block
    sizes = np.diff(have.bounds)
    keys, number = np.unique(have.keys, return_inverse=True)
    times = have.times
    entry = ragged(have.bounds[:-1][index], sizes[index])
    doc = np.repeat(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), sizes[index])
    place = doc * max(len(keys), 1) + number[entry]
    order = np.argsort(place, kind="stable")
    place, value = place[order], times[entry][order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    value = np.add.reduceat(value, first) if len(first) else value
    doc, pair = np.divmod(place[first], max(len(keys), 1))
    held = np.bincount(pair, minlength=len(keys))
    used = held > 0  # pairs of pieces that only documents without tokens have don't count
    renumbered = np.cumsum(used) - 1
    columns = {
        "block": pa.array([block], pa.int64()),
        "doc_id": _one(docs.column("doc_id")),
        "n_a": _one(summed("n_a")),
        "n_b": _one(summed("n_b")),
        "n_groups": _one(summed("n_groups")),
        "n_links": _one(summed("n_links")),
        "groups_sha256": _one(pa.array(hashed, pa.string())),
        "n_overlaps": _one(summed("n_overlaps")),
        "bounds": _one(pa.array(np.searchsorted(doc, np.arange(len(bounds))))),
        "pairs": pa.array([renumbered[pair].astype("<u4").tobytes()], pa.binary()),
        "times": pa.array([value.astype("<u4").tobytes()], pa.binary()),
        "keys": _one(pa.array(keys[used])),
        "held": _one(pa.array(held[used].astype(np.int64))),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _one(values: pa.Array) -> pa.ListArray:
    """An array as the only row of a list column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def blocks(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Documents in blocks with their links, stored: the rows of ``BLOCKS``."""
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.at(*paths)
        task = TaskContext.get().partitionId()
        for k, part in enumerate(gathered(batches, "text", BLOCK_BYTES)):
            yield _block(aligner, part, task << 32 | k)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stored(source.mapInArrow(run, BLOCKS), "alignment")


def pair_counts(laid: DataFrame) -> DataFrame:
    """``key`` (A id << 32 | B id), ``count``: the documents that hold the pair linked, and ``best``, whether no
    other pair of the A id has more."""
    each = laid.select(F.explode(F.arrays_zip("keys", "held")).alias("p")).groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.held").alias("count"))
    each = each.withColumn("a", F.shiftright("key", 32))
    most = each.groupBy("a").agg(F.max("count").alias("most"))
    return each.join(most, "a").select("key", "count", (F.col("count") == F.col("most")).alias("best"))


def linked_ids(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The alignment itself: ``a, b, count, best`` of every pair of ids that a document holds linked."""
    found = pair_counts(blocks(docs, paths))
    return found.select(F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "count", "best")


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """A row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps``."""
    laid = blocks(docs, paths)
    asked = laid.select("block", F.posexplode("keys").alias("number", "key"))
    told = asked.join(pair_counts(laid), "key").select("block", "number", "count", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = {name: left.column(name).combine_chunks().flatten() for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_overlaps", "bounds")}
        bounds = flat["bounds"].to_numpy(zero_copy_only=False)
        pair, times = (np.frombuffer(left.column(c)[0].as_py(), dtype="<u4").astype(np.int64) for c in ("pairs", "times"))
        order = np.argsort(right.column("number").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = right.column("best").to_numpy()[order].astype(np.int64)
        count_sum, n_best = (
            np.diff(np.concatenate(([0], np.cumsum(times * each[pair] if len(pair) else times)))[bounds]) for each in (count, best)
        )
        flat |= {"count_sum": pa.array(count_sum, pa.int64()), "n_best": pa.array(n_best, pa.int64())}
        return pa.table({name: flat[name] for name in (part.split()[0] for part in RESULT.split(", "))})

    body = laid.withColumnRenamed("block", "of").drop("keys", "held")
    return body.groupBy("of").cogroup(told.groupBy("block")).applyInArrow(finish, RESULT)
