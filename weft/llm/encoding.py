"""Texts to token ids with a public word-level BPE file, one distinct word at a time.

White space never reaches a token, and the vocabulary marks the last token of every run of
letters, so a text's ids are the ids of its words put together.  A batch is encoded by its distinct
words, and these by what is left of them in small letters without the punctuation around them, which Arrow takes
off; a word that is anything but plain letters with common punctuation around them goes through
the tokenizer as it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weft.llm.arrow import ragged, words

#: Punctuation cut from the ends of a word before it is looked up; none of it starts a contraction
#: or a special token.
EDGES = ".,!|&$%#*?;:()\"-"
#: Distinct strings of a kind that a worker remembers about, and the longest, in characters, that it does.
REMEMBERED, LONGEST = 200_000, 64
#: Words put together in one text, and strings encoded in one call: the tokenizer holds a call's tokens some hundred
#: bytes each, and every thread of it keeps what it had.
TOGETHER, CALL = 500, 4_000
#: Letters below this code point have one form only, so normalisation leaves them alone.
PLAIN = "ɏ"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent:
    """What was looked up lately, in two halves: when the newer one is full, the older one goes.  Words that keep
    coming are carried over, so those of a few documents don't push them out."""

    def __init__(self):
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.newer) + len(self.older)

    def turn(self) -> None:
        if len(self.newer) >= REMEMBERED // 2:
            self.newer, self.older = {}, self.newer

    def found(self, keys: list[str]) -> tuple[list[bytes | None], list[int]]:
        """The keys' values, and the places of those that have none."""
        newer, older = self.newer, self.older
        values, none = list(map(newer.get, keys)), []
        for k, value in enumerate(values):
            if value is None:
                value = values[k] = older.get(keys[k])
                if value is None:
                    none.append(k)
                else:
                    newer[keys[k]] = value
        return values, none

    def keep(self, key: str, value: bytes) -> None:
        if len(key) <= LONGEST:
            self.newer[key] = value


class WordEncoder:
    """Ids of texts, equal to the tokenizer's own ``encode(text, add_special_tokens=False)``."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.known, self.cores = Recent(), Recent()

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        """One encoder per worker process and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _bytes(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _whole(self, pieces: list[str]) -> list[bytes]:
        """Any strings, as the tokenizer has them."""
        encode = self.tokenizer.encode_batch_fast
        return [self._bytes(e.ids) for i in range(0, len(pieces), CALL) for e in encode(pieces[i : i + CALL], add_special_tokens=False)]

    def _letters(self, pieces: list[str]) -> list[bytes]:
        """Runs of letters: many in one call, cut where a run closes."""
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        encode, step = self.tokenizer.encode_batch_fast, CALL // TOGETHER
        calls = (encode([" ".join(g) for g in groups[i : i + step]], add_special_tokens=False) for i in range(0, len(groups), step))
        out: list[bytes] = []
        for group, e in zip(groups, (e for call in calls for e in call)):
            ids = np.asarray(e.ids, dtype=self.dtype)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                out += self._whole(group)
                continue
            raw, cuts = ids.tobytes(), [0, *(ends * self.dtype.itemsize).tolist()]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _strings(self, pieces: list[str]) -> list[bytes]:
        """Ids, as bytes, of strings that go through the tokenizer as they stand."""
        coded, new = self.known.found(pieces)
        fresh = sorted({pieces[k] for k in new})
        made = dict(zip(fresh, self._whole(fresh)))
        for piece, ids in made.items():
            self.known.keep(piece, ids)
        for k in new:
            coded[k] = made[pieces[k]]
        return coded

    def _cores(self, pieces: list[str]) -> list[bytes]:
        """Ids, as bytes, of distinct strings in small letters; none for one that isn't plain letters."""
        coded, new = self.cores.found(pieces)
        low = [pieces[k].lower() for k in new]
        plain = list({v for v in low if v.isalpha() and (v.isascii() or max(v) <= PLAIN)})
        if new:
            known = dict(zip(plain, self._letters(plain)))
            for k, v in zip(new, low):
                coded[k] = known.get(v, b"")
                self.cores.keep(pieces[k], coded[k])
        return coded

    def distinct(self, chunks: pa.Array) -> pa.Array:
        """Ids, as bytes, of strings without blanks: what is cut from their ends and what is left between."""
        self.known.turn()
        self.cores.turn()
        chunks = chunks.cast(pa.large_string())
        right = pc.utf8_rtrim(chunks, EDGES)
        inner = pc.utf8_ltrim(right, EDGES)
        low = pc.ascii_lower(inner).dictionary_encode()
        cores, core = self._cores(_list(low.dictionary)), low.indices.to_numpy(zero_copy_only=False)
        odd = np.flatnonzero((np.fromiter(map(len, cores), np.int64, len(cores)) == 0)[core])
        size, kept, left = (pc.binary_length(a).to_numpy(zero_copy_only=False) for a in (chunks, right, inner))
        pieces = pa.array([b"", *cores], pa.large_binary())
        at = np.zeros((len(chunks), 3), dtype=np.int64)  # before, core, after; 0 for none
        at[:, 1] = core + 1
        plain = np.ones(len(chunks), dtype=bool)
        plain[odd] = False
        start = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset :][: len(chunks)]
        for side, first, n in ((0, start, kept - left), (2, start + kept, size - kept)):
            some = np.flatnonzero(plain & (n > 0))
            edges = _cut(chunks, first[some], n[some]).dictionary_encode()
            at[some, side] = len(pieces) + edges.indices.to_numpy(zero_copy_only=False)
            pieces = pa.concat_arrays([pieces, pa.array(self._strings(_list(edges.dictionary)), pa.large_binary())])
        at[odd, 1] = len(pieces) + np.arange(len(odd))
        pieces = pa.concat_arrays([pieces, pa.array(self._strings(_list(chunks.take(pa.array(odd)))), pa.large_binary())])
        flat = pieces.take(pa.array(at.reshape(-1)))
        ends = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1 : 3].copy()
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(ends), flat.buffers()[2]])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets per text); null is empty."""
        offsets, index, dictionary = words(column)
        coded = self.distinct(dictionary).take(pa.array(index))
        ends = np.frombuffer(coded.buffers()[1], np.int64)[: len(coded) + 1] // self.dtype.itemsize
        return np.frombuffer(coded.buffers()[2] or b"", self.dtype, count=int(ends[-1])), ends[offsets]


def _list(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _cut(strings: pa.LargeStringArray, first: np.ndarray, n: np.ndarray) -> pa.LargeStringArray:
    """The ``n`` bytes from ``first`` on in the strings' data."""
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ragged(first, n)]
    ends = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends), pa.py_buffer(data))


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` put behind every text."""
    n = len(bounds) - 1
    shifted = bounds + np.arange(n + 1)
    dtype = ids.dtype if end_id <= np.iinfo(ids.dtype).max else np.dtype("<u4")
    out = np.empty(len(ids) + n, dtype=dtype)
    closing = shifted[1:] - 1
    keep = np.ones(len(out), dtype=bool)
    keep[closing] = False
    out[keep] = ids
    out[closing] = end_id
    return out, shifted


def encoded(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, text: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their ids and offsets."""
    from weft.llm.arrow import slices

    encoder = WordEncoder.at(path)
    for part in slices(batches, text):
        if part.num_rows:
            ids, bounds = encoder.encode(part.column(text))
            yield (part, ids, bounds) if end_id is None else (part, *with_end(ids, bounds, end_id))
