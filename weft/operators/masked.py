"""Masked objectives by Arrow batches: sentence pairs, n-gram masking, span corruption; fill in the middle as array expressions.

Every random choice is a draw named by (seed, sample, purpose, position), see :mod:`weft.functions.draws`, so
samples need no walk of their own and come out alike in any partitioning.  Maskable positions are called
places and are numbered without the special tokens; a word is a range of places, an n-gram a range of words.
The samples of a batch lie side by side as lines: their draws are hashed together, and choosing n-grams goes over
the words of all lines in drawn order, one word of each line at a time.  Fill-in-the-middle with a tokenizer from
outside goes through Python sample by sample.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from weft.functions.draws import below, bind, draw, number, plain_draw, plain_draws, plain_number, steps, upto
from weft.functions.ordering import by_rows

GEOMETRIC = 0.2  # fixed value of the published span masking
#: Shares of masked positions that become the mask token, and that become it or another token; fixed values.
MASKED, CHANGED = 0.8, 0.9


@dataclass(frozen=True)
class MaskConfig:
    """Vocabulary ids and rates of masked objectives."""

    length: int
    vocab: int
    cls: int
    sep: int
    mask: int
    pad: int
    probability: float = 0.15
    max_ngram: int = 3
    whole_words: bool = True
    longer_ngrams: bool = False
    geometric: bool = False
    permute: bool = False
    classify: bool = True
    always_mask: bool = False
    continuations: frozenset[int] = frozenset()
    seed: int = 1234

    def size_ends(self, geometric: bool) -> list[int]:
        """Where the draw of an n-gram's size goes from one size to the next."""
        sizes = range(1, self.max_ngram + 1)
        if geometric:
            weights = [GEOMETRIC * (1 - GEOMETRIC) ** (n - 1) for n in sizes[:-1]]
            weights.append(1 - sum(weights))
        else:
            weights = [1 / n for n in sizes]
            weights = weights[::-1] if self.longer_ngrams else weights
        return steps(weights)


#: Cells (rows by the longest of them) worked on at once.
CELLS = 1 << 18


def _heads(seed: int, tag: str, names: list[str | None]) -> list[str]:
    """What names the draws of (seed, tag, sample) and one more key, see :func:`weft.functions.draws.plain_draws`."""
    return [f"{seed}|{tag}|" if n is None else f"{seed}|{tag}|{n}|" for n in names]


def _lists(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(ends with a leading 0, values) of a list array, which may be a slice."""
    offsets = np.asarray(array.offsets, np.int64)
    return offsets - offsets[0], array.flatten()


def _numbers(array: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """(values, which are null) of an array of whole numbers."""
    if not array.null_count:
        return array.to_numpy(zero_copy_only=False).astype(np.int64), None
    return array.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), array.is_null().to_numpy(zero_copy_only=False)


def _targets(target: pa.Array) -> np.ndarray:
    """Targets as doubles; a missing one is no limit."""
    return target.cast(pa.float64()).fill_null(np.inf).to_numpy(zero_copy_only=False)


def _blocks(sizes: np.ndarray) -> Iterator[slice]:
    """Stretches of rows of bounded rows times longest row, a row at least."""
    first = widest = 0
    for i, n in enumerate(sizes.tolist()):
        widest = max(widest, n)
        if i > first and widest * (i + 1 - first) > CELLS:
            yield slice(first, i)
            first, widest = i, n
    if len(sizes) > first:
        yield slice(first, len(sizes))


def _ragged(lengths: np.ndarray, values: np.ndarray, blank: np.ndarray | None = None, absent: np.ndarray | None = None) -> pa.ListArray:
    """A list array from the values of all rows, the nulls among them and the rows that are null."""
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    items = pa.array(values, pa.int64(), mask=blank)
    return pa.ListArray.from_arrays(pa.array(ends), items, mask=None if absent is None else pa.array(absent))


class _Lines:
    """The samples of a block side by side: a line of tokens each, of ``sizes`` tokens and filled up to the longest."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, blank: np.ndarray | None, names: list[str | None], target: np.ndarray, cfg: MaskConfig):
        self.tokens, self.sizes, self.blank, self.names, self.cfg = tokens, sizes, blank, names, cfg
        plain = (np.arange(tokens.shape[1]) < sizes[:, None]) & (tokens != cfg.cls) & (tokens != cfg.sep)
        if blank is not None:
            plain &= ~blank
        #: places: their line and position, in order
        self.row, self.at = np.nonzero(plain)
        self.n_places = plain.sum(axis=1)
        self.begun = np.cumsum(self.n_places) - self.n_places
        starts = np.ones(len(self.row), bool)
        if cfg.whole_words and cfg.continuations:
            starts = ~np.isin(tokens[self.row, self.at], sorted(cfg.continuations))
            starts[self.begun[self.n_places > 0]] = True
        self.n_words = np.bincount(self.row[starts], minlength=len(sizes))
        before = np.cumsum(self.n_words) - self.n_words
        #: the word of a place, numbered in its line
        self.word = np.cumsum(starts) - 1 - before[self.row]
        #: word w covers the places from bounds[w] to bounds[w + 1] - 1; behind the last word comes the number of places
        self.width = int(self.n_words.max(initial=0))
        self.bounds = np.repeat(self.n_places[:, None], self.width + cfg.max_ngram + 1, axis=1)
        self.bounds[self.row[starts], self.word[starts]] = np.flatnonzero(starts) - self.begun[self.row[starts]]
        share = float(cfg.probability)
        self.budget = np.minimum(target * share, np.maximum(1.0, np.rint(sizes * share)))

    def pick(self, tag: str, taken: np.ndarray | None, geometric: bool) -> tuple[np.ndarray, np.ndarray]:
        """(length of the n-gram that begins at a word, whether a word is covered): n-grams in drawn order that fit the
        budget and touch no earlier one, nor a word of ``taken``.  A drawn size shrinks until it fits."""
        cfg, rows, width = self.cfg, len(self.sizes), self.width
        spans, covered = np.zeros((rows, width), np.int64), np.zeros((rows, width + cfg.max_ngram), bool)
        if not width:
            return spans, covered
        here = np.arange(width) < self.n_words[:, None]
        line, word = np.nonzero(here)
        drawn = plain_draws(_heads(cfg.seed, tag, self.names), line, word)
        size = np.ones((rows, width), np.int64)
        for end in cfg.size_ends(geometric):
            size[here] += drawn[1] >= end
        order = self._order(tag, here, word, drawn)
        lost = covered if taken is None else taken.copy()
        used, active = np.zeros(rows, np.int64), np.arange(rows)
        for k in range(width):
            # an n-gram has a place at least
            active = active[(self.n_words[active] > k) & (self.budget[active] - used[active] >= 1)]
            if not len(active):
                break
            w = order[active, k]
            begin, room, wanted = self.bounds[active, w], self.budget[active] - used[active], size[active, w]
            n = np.zeros(len(active), np.int64)
            for g in range(1, cfg.max_ngram + 1):
                n[(wanted >= g) & (self.bounds[active, w + g] - begin <= room)] = g
            free = n > 0
            for g in range(cfg.max_ngram):
                free &= ~((n > g) & lost[active, w + g])
            line, w, n, begin = active[free], w[free], n[free], begin[free]
            for g in range(cfg.max_ngram):
                lost[line[n > g], w[n > g] + g] = True
                covered[line[n > g], w[n > g] + g] = True
            used[line] += self.bounds[line, w + n] - begin
            spans[line, w] = n
        return spans, covered

    def _order(self, tag: str, here: np.ndarray, word: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """The words of every line in the order of their draws, the missing ones last."""
        bits = self.width.bit_length()
        low = np.uint64((1 << bits) - 1)
        keys = np.full(here.shape, np.iinfo(np.uint64).max)
        keys[here] = (((drawn[0].astype(np.uint64) << np.uint64(32)) | drawn[1]) & ~low) | word.astype(np.uint64)
        keys.sort(axis=1)
        order = (keys & low).astype(np.int64)
        # the word stands in the last bits of the draw: draws that agree in all others are compared whole
        close = (keys[:, 1:] >> np.uint64(bits) == keys[:, :-1] >> np.uint64(bits)) & here[:, 1:]
        for i in np.flatnonzero(close.any(axis=1)).tolist():
            head = _heads(self.cfg.seed, tag, [self.names[i]])[0]
            n = int(self.n_words[i])
            order[i, :n] = sorted(range(n), key=lambda w: hashlib.md5(f"{head}{w}".encode()).hexdigest() + str(w))
        return order

    def positions(self, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, position) of the places of covered words, in order."""
        hit = covered[self.row, self.word]
        return self.row[hit], self.at[hit]

    def masked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, labels, changed, spans): the tokens after masking; what stood where ``changed`` says so; the n-grams."""
        cfg = self.cfg
        spans, covered = self.pick("mask", None, cfg.geometric)
        line, at = self.positions(covered)
        text, labels, changed = self.tokens.copy(), np.full(self.tokens.shape, -1, np.int64), np.zeros(self.tokens.shape, bool)
        if cfg.always_mask:
            text[line, at] = cfg.mask
        else:
            d = plain_draws(_heads(cfg.seed, "fate", self.names), line, at).astype(np.int64)
            other = np.where(d[0] < below(CHANGED), d[1] % cfg.vocab, self.tokens[line, at])
            text[line, at] = np.where(d[0] < below(MASKED), cfg.mask, other)
        changed[line, at] = True
        if cfg.permute:
            line, at = self.positions(self.pick("move", covered, False)[1])
            d = plain_draws(_heads(cfg.seed, "swap", self.names), line, at)
            text[line, at] = self.tokens[line, at[np.lexsort((at, d[3], d[2], d[1], d[0], line))]]
            changed[line, at] = True
        labels[changed] = self.tokens[changed]
        return text, labels, changed, spans

    def ranges(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, from, to) of n-grams as ranges of places, in order."""
        line, word = np.nonzero(spans)
        return line, self.bounds[line, word], self.bounds[line, word + spans[line, word]]


def _token_lines(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, blank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Tokens (and which are null) of stretches of ``flat``, a line each, zeros behind."""
    lines = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    here = np.arange(lines.shape[1]) < sizes[:, None]
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    lines[here] = flat[at]
    if blank is None:
        return lines, None
    gone = np.zeros(lines.shape, bool)
    gone[here] = blank[at]
    return lines, gone


def _in_blocks(sizes: np.ndarray, schema: str, build: Callable[[slice], pa.StructArray]) -> pa.Array:
    """The struct arrays of all stretches of rows as one."""
    made = [build(block) for block in _blocks(sizes)]
    return pa.concat_arrays(made) if made else pa.array([], to_arrow_type(StructType.fromDDL(schema)))


CHANGED_TEXT = (
    "tokens array<bigint>, text array<bigint>, changes array<struct<p:int,token:bigint,label:bigint>>, places array<int>, "
    "spans array<struct<from:int,to:int>>"
)


def mask_ngrams(tokens: Column, target: Column, idx: Column, cfg: MaskConfig) -> Column:
    """struct(tokens, text, changes, places, spans): 80 % of the chosen positions get the mask, 10 % a random token.

    ``changes`` holds ``p`` (position), ``token`` (what stands there now) and ``label`` (what stood there);
    ``spans`` the chosen n-grams as ranges of ``places``.
    """

    @F.arrow_udf(f"struct<{CHANGED_TEXT}>")
    def run(tokens: pa.Array, target: pa.Array, idx: pa.Array) -> pa.Array:
        ends, flat = _lists(tokens)
        (values, blank), sizes, names, aims = _numbers(flat), np.diff(ends), idx.to_pylist(), _targets(target)
        absent = tokens.is_null().to_numpy(zero_copy_only=False)

        def block(b: slice) -> pa.StructArray:
            cells, gone = _token_lines(ends[:-1][b], sizes[b], values, blank)
            lines = _Lines(cells, sizes[b], gone, names[b], aims[b], cfg)
            text, labels, changed, spans = lines.masked()
            here = np.arange(cells.shape[1]) < sizes[b][:, None]
            line, begin, end = lines.ranges(spans)
            at = np.nonzero(changed)
            lists = lambda n, items: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), items)
            changes = [pa.array(at[1], pa.int32()), pa.array(text[at], pa.int64()), pa.array(labels[at], pa.int64())]
            ranges = [pa.array(begin, pa.int32()), pa.array(end, pa.int32())]
            nulls = None if gone is None else gone[here]
            return pa.StructArray.from_arrays(
                [
                    _ragged(sizes[b], cells[here], nulls, absent[b]),
                    _ragged(sizes[b], text[here], nulls, absent[b]),
                    lists(changed.sum(axis=1), pa.StructArray.from_arrays(changes, ["p", "token", "label"])),
                    lists(lines.n_places, pa.array(lines.at, pa.int32())),
                    lists(np.bincount(line, minlength=len(sizes[b])), pa.StructArray.from_arrays(ranges, ["from", "to"])),
                ],
                ["tokens", "text", "changes", "places", "spans"],
            )

        return _in_blocks(sizes, CHANGED_TEXT, block)

    return run(tokens, target, idx.cast("string"))


def _once(df: DataFrame, value: Column) -> DataFrame:
    """``idx`` and the fields of a struct; a row generator keeps the optimiser from repeating its expression."""
    return df.select("idx", F.explode(F.array(value)).alias("__r")).select("idx", "__r.*")


def _padded(values: np.ndarray, sizes: np.ndarray, length: int, fill: int) -> np.ndarray:
    """Lines cut or filled up to ``length`` with ``fill`` from their size on; a longer one is an error."""
    if (sizes > length).any():
        raise ValueError("sample longer than the sequence length")
    out = np.full((len(sizes), length), fill, np.int64)
    width = min(length, values.shape[1])
    np.copyto(out[:, :width], values[:, :width], where=np.arange(width) < sizes[:, None])
    return out


def _zeroed(values: np.ndarray, pad: int) -> np.ndarray:
    return np.where(values == pad, 0, values)


class _Pairs:
    """Two parts of every sample as stretches of one array: cut at a drawn pivot, swapped by a coin, trimmed from drawn ends.

    The longer part is trimmed until both are equal, then the second and the first take turns.
    """

    def __init__(self, sentences: pa.ListArray, names: list[str | None], target: np.ndarray, cfg: MaskConfig):
        of_row, inner = _lists(sentences)
        ends, flat = _lists(inner)
        self.flat, self.blank = _numbers(flat)
        rows, n = len(names), np.diff(of_row)
        absent = sentences.is_null().to_numpy(zero_copy_only=False)
        self.swapped, pivot = np.zeros(rows, np.int64), n
        if cfg.classify:
            texts = [f"{cfg.seed}|pair" if name is None else f"{cfg.seed}|pair|{name}" for name in names]
            draws = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest() for t in texts), ">u4").reshape(-1, 4).astype(np.int64)
            if (n[~absent] < 2).any():
                raise ValueError("a pair needs at least two sentences")
            pivot = np.where(n >= 3, 1 + draws[:, 0] % np.maximum(n - 1, 1), 1)
            self.swapped = (draws[:, 1] % 2 == 0).astype(np.int64)
        start, end = of_row[:-1], of_row[1:]
        middle = np.minimum(start + pivot, end)
        # a part with a missing sentence is missing; with the first part the whole sample is
        missing = np.concatenate(([0], np.cumsum(inner.is_null().to_numpy(zero_copy_only=False))))
        lost_first, lost_second = absent | (missing[middle] > missing[start]), absent | (missing[end] > missing[middle])
        swap = lambda x, y: (np.where(self.swapped == 1, y, x), np.where(self.swapped == 1, x, y))
        self.a, self.b = swap(ends[start], ends[middle])
        na, nb = swap(ends[middle] - ends[start], ends[end] - ends[middle])
        if not cfg.classify:
            lost_second = np.zeros(rows, bool)
        self.absent, lost_b = swap(lost_first, lost_second)
        na, nb = np.where(self.absent, 0, na), np.where(self.absent | lost_b, 0, nb)
        # what has no target or misses a part is not trimmed
        whole = self.absent | lost_b | np.isinf(target)
        excess = np.maximum(na + nb - np.where(whole, na + nb, target).astype(np.int64), 0)
        lead, a_leads = np.minimum(np.abs(na - nb), excess), na > nb
        a_front, b_front = self._fronts(excess, lead, a_leads, names, cfg)
        a_all = np.where(a_leads, lead, 0) + ((excess - lead) >> 1)
        self.a, self.b, self.na, self.nb = self.a + a_front, self.b + b_front, na - a_all, nb - (excess - a_all)
        self.truncated = (excess > 0).astype(np.int64)

    @staticmethod
    def _fronts(excess: np.ndarray, lead: np.ndarray, a_leads: np.ndarray, names: list[str | None], cfg: MaskConfig) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens leave the front of the first and of the second part: a coin for each, 32 in a draw."""
        a_front, b_front = np.zeros(len(excess), np.int64), np.zeros(len(excess), np.int64)
        some = np.flatnonzero(excess > 0)
        for part in _blocks(excess[some]):
            rows = some[part]
            n = -(-excess[rows] // 32)
            line = np.repeat(np.arange(len(rows)), n)
            block = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
            d = plain_draws(_heads(cfg.seed, "trim", [names[i] for i in rows.tolist()]), line, block)
            turns = np.arange(28, -1, -4, dtype=np.uint32)
            coins = (((d.T[:, :, None] >> turns) & 15) < 8).reshape(len(line), 32)
            k = block[:, None] * 32 + np.arange(32)
            ahead = lead[rows][line][:, None]
            of_a = np.where(k < ahead, a_leads[rows][line][:, None], (k - ahead) % 2 == 1)
            heads = coins & (k < excess[rows][line][:, None])
            a_front[rows] = np.bincount(line, (heads & of_a).sum(axis=1), len(rows)).astype(np.int64)
            b_front[rows] = np.bincount(line, (heads & ~of_a).sum(axis=1), len(rows)).astype(np.int64)
        return a_front, b_front

    def lines(self, b: slice, cfg: MaskConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(tokens, sizes, nulls) of ``[CLS] A [SEP] B [SEP]``, a line each."""
        na, nb = self.na[b], self.nb[b]
        sizes = na + 2 + np.where(nb > 0, nb + 1, 0)
        line, k = np.arange(len(na)), np.arange(int(sizes.max(initial=0)))
        second = k > na[:, None] + 1
        inside = np.where(second, k - na[:, None] - 2 < nb[:, None], (k > 0) & (k <= na[:, None]))
        at = np.where(second, self.b[b][:, None] + k - na[:, None] - 2, self.a[b][:, None] + k - 1)
        tokens = np.full(inside.shape, cfg.sep, np.int64)
        tokens[inside] = self.flat[at[inside]]
        tokens[line, 0] = cfg.cls
        if self.blank is None:
            return tokens, sizes, None
        gone = np.zeros(inside.shape, bool)
        gone[inside] = self.blank[at[inside]]
        return tokens, sizes, gone


BERT = (
    "text array<bigint>, types array<bigint>, labels array<bigint>, is_random int, padding_mask array<bigint>, loss_mask array<bigint>, "
    "truncated int"
)


def bert_samples(df: DataFrame, cfg: MaskConfig) -> DataFrame:
    """Masked pairs from (idx, sentences array<array<int>>, target): ``[CLS] A [SEP] B [SEP]``, masked and padded."""

    @F.arrow_udf(f"struct<{BERT}>")
    def run(idx: pa.Array, sentences: pa.Array, target: pa.Array) -> pa.Array:
        names, aims = idx.to_pylist(), _targets(target)
        pairs = _Pairs(sentences, names, aims, cfg)

        def block(b: slice) -> pa.StructArray:
            tokens, sizes, gone = pairs.lines(b, cfg)
            text, labels, changed, _ = _Lines(tokens, sizes, gone, names[b], aims[b], cfg).masked()
            k, absent = np.arange(cfg.length), pairs.absent[b]
            types = np.where(k < pairs.na[b][:, None] + 2, 0, np.where(k < sizes[:, None], 1, cfg.pad))
            full = lambda values, nulls=None: _ragged(np.full(len(sizes), cfg.length), values.reshape(-1), nulls, absent)
            nulls = None if gone is None else _padded(gone, sizes, cfg.length, 0).astype(bool).reshape(-1)
            unseen = np.where(text == cfg.pad, cfg.pad, 1)
            if gone is not None:
                unseen[gone] = 1
            number = lambda values: pa.array(values, pa.int32())
            return pa.StructArray.from_arrays(
                [
                    full(_padded(_zeroed(text, cfg.pad), sizes, cfg.length, 0), nulls),
                    full(types),
                    full(_zeroed(_padded(labels, sizes, cfg.length, -1), cfg.pad)),
                    number(pairs.swapped[b]),
                    full(_padded(unseen, sizes, cfg.length, cfg.pad)),
                    full(_padded(changed, sizes, cfg.length, 0)),
                    number(pairs.truncated[b]),
                ],
                ["text", "types", "labels", "is_random", "padding_mask", "loss_mask", "truncated"],
            )

        return _in_blocks(pairs.na + pairs.nb + 3, BERT, block)

    return _once(df, run(F.col("idx").cast("string"), F.col("sentences"), F.col("target")))


SPANS = (
    "text_enc array<bigint>, text_dec array<bigint>, labels array<bigint>, loss_mask array<bigint>, truncated int, enc_mask array<bigint>, "
    "dec_mask array<bigint>"
)


def _in_lines(row: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes): a line for each row, of the values in their order."""
    sizes = np.bincount(row, minlength=rows)
    return _token_lines(np.cumsum(sizes) - sizes, sizes, values, None)[0], sizes


def span_corrupt(
    df: DataFrame, cfg: MaskConfig, sentinels: list[int], bos: int, eos: int, decoder_length: int
) -> DataFrame:
    """Span corruption of (idx, tokens, target): sentinels in place of the chosen n-grams for the encoder, the n-grams
    behind their sentinels for the decoder."""
    always, marks = replace(cfg, always_mask=True, permute=False), np.array(sentinels, np.int64)

    def corrupted(lines: _Lines, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which cells the encoder keeps, all cells with the sentinels), then (row, value) of what the decoder is told, in order."""
        line, begin, end = lines.ranges(spans)
        n = np.bincount(line, minlength=len(lines.sizes))
        if (n > len(marks)).any():
            raise ValueError("more masked spans than sentinel tokens")
        name = marks[np.arange(len(line)) - (np.cumsum(n) - n)[line]]
        first, last = lines.at[lines.begun[line] + begin], lines.at[lines.begun[line] + end - 1]
        # the first position of an n-gram holds its sentinel, those behind it up to its last are left out
        values, depth = lines.tokens.copy(), np.zeros((len(n), lines.tokens.shape[1] + 2), np.int8)
        values[line, first] = name
        np.add.at(depth, (line, first + 1), 1)
        np.add.at(depth, (line, last + 1), -1)
        kept = (np.cumsum(depth, axis=1)[:, :-2] == 0) & (np.arange(values.shape[1]) < lines.sizes[:, None])
        # a sentinel before the tokens of each n-gram
        sizes = end - begin
        told_row = np.repeat(line, sizes + 1)
        head = np.cumsum(sizes + 1) - sizes - 1
        place = np.arange(len(told_row)) - np.repeat(head, sizes + 1) - 1 + np.repeat(lines.begun[line] + begin, sizes + 1)
        told = lines.tokens[told_row, lines.at[np.maximum(place, 0)]]
        told[head] = name
        return kept, values, told_row, told

    @F.arrow_udf(f"struct<{SPANS}>")
    def run(idx: pa.Array, tokens: pa.Array, target: pa.Array) -> pa.Array:
        ends, flat = _lists(tokens)
        (values, blank), whole, names, aims = _numbers(flat), np.diff(ends), idx.to_pylist(), _targets(target)
        cut = np.minimum(whole, np.maximum(np.where(np.isinf(aims), 0, aims), 0)).astype(np.int64)
        absent, open_end = tokens.is_null().to_numpy(zero_copy_only=False), np.isinf(aims)

        def block(b: slice) -> pa.StructArray:
            sizes, rows = cut[b], len(cut[b])
            cells, gone = _token_lines(ends[:-1][b], sizes, values, blank)
            lines = _Lines(cells, sizes, gone, names[b], aims[b], always)
            kept, enc, told_row, told = corrupted(lines, lines.pick("mask", None, always.geometric)[0])
            enc_row = np.nonzero(kept)[0]
            enc, n_enc = _in_lines(enc_row, enc[kept], rows)
            nulls = None
            if gone is not None:
                nulls = _padded(_in_lines(enc_row, gone[kept], rows)[0], n_enc, cfg.length, 0).astype(bool).reshape(-1)
            told, n_told = _in_lines(told_row, told, rows)
            dec = np.concatenate((np.full((rows, 1), bos), told), axis=1)
            labels = np.concatenate((told, np.zeros((rows, 1), np.int64)), axis=1)
            labels[np.arange(rows), n_told] = eos
            full = lambda values, n, length, fill, *nulls: _ragged(np.full(rows, length), _padded(values, n, length, fill).reshape(-1), *nulls)
            return pa.StructArray.from_arrays(
                [
                    full(_zeroed(enc, cfg.pad), n_enc, cfg.length, 0, nulls, absent[b]),
                    full(_zeroed(dec, cfg.pad), n_told + 1, decoder_length, 0),
                    full(_zeroed(labels, cfg.pad), n_told + 1, decoder_length, 0 if cfg.pad == -1 else -1),
                    full(np.ones_like(dec), n_told + 1, decoder_length, 0),
                    pa.array(whole[b] > sizes, pa.int32(), mask=absent[b] | open_end[b]),
                    full(enc != cfg.pad, n_enc, cfg.length, 0, nulls, absent[b]),
                    full(dec != cfg.pad, n_told + 1, decoder_length, 0),
                ],
                ["text_enc", "text_dec", "labels", "loss_mask", "truncated", "enc_mask", "dec_mask"],
            )

        return _in_blocks(cut, SPANS, block)

    return _once(df, run(F.col("idx").cast("string"), F.col("tokens"), F.col("target").cast("int")))


# ---- fill in the middle --------------------------------------------------------------------


@dataclass(frozen=True)
class InfillConfig:
    """Fill-in-the-middle rates and special ids."""

    rate: float
    spm_rate: float
    prefix: int
    middle: int
    suffix: int
    pad: int
    eod: int
    split: int | None = None
    fragment_rate: float = 0.0
    no_prefix: str | None = None
    seed: int = 1234


#: Well-formed UTF-8 by first byte: (from, to, bytes, least second byte, greatest second byte); fixed values.
UTF8 = [
    (0x00, 0x7F, 1, 0, 0),
    (0xC2, 0xDF, 2, 0x80, 0xBF),
    (0xE0, 0xE0, 3, 0xA0, 0xBF),
    (0xE1, 0xEC, 3, 0x80, 0xBF),
    (0xED, 0xED, 3, 0x80, 0x9F),
    (0xEE, 0xEF, 3, 0x80, 0xBF),
    (0xF0, 0xF0, 4, 0x90, 0xBF),
    (0xF1, 0xF3, 4, 0x80, 0xBF),
    (0xF4, 0xF4, 4, 0x80, 0x8F),
]
#: White space at the end of a decoded text.
BLANK_END = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


def _latin(b: Column) -> Column:
    """The bytes as a text: a character for each, which Latin-1 turns into that byte."""
    return F.encode(F.array_join(F.transform(b, F.char), ""), "ISO-8859-1").cast("string")


def _decoded(tokens: Column, special_start: int) -> Column:
    """(bytes, text) of byte tokens: the bytes that decode, and their text, right-stripped; the text begins at the first byte."""

    def decoded(b):
        def whole(i):
            lead, second = b[i], F.coalesce(F.get(b, i + 1), F.lit(0))
            ok, size = F.lit(False), F.lit(0)
            for low, high, n, least, most in UTF8:
                here = (lead >= low) & (lead <= high)
                size = F.when(here, F.lit(n)).otherwise(size)
                ok = ok | (here if n == 1 else here & (second >= least) & (second <= most))
            for k in (2, 3):
                follows = F.coalesce(F.get(b, i + k), F.lit(0))
                ok = ok & ((size <= k) | ((follows >= 0x80) & (follows <= 0xBF)))
            return F.when(ok, F.slice(b, i + 1, size)).otherwise(F.array().cast("array<int>"))

        pair = lambda g, s: F.struct(g.alias("bytes"), F.regexp_replace(s, BLANK_END, "").alias("text"))
        # only malformed bytes, as where a sample cuts a character, are looked at one by one
        some = bind(F.flatten(F.transform(upto(F.size(b)), whole)), lambda g: pair(g, _latin(g)))
        return bind(_latin(b), lambda s: F.when(F.is_valid_utf8(s), pair(b, s)).otherwise(some))

    kept = F.filter(tokens, lambda t: (t >= 0) & (t < special_start)).cast("array<int>")
    return bind(kept, decoded)


def byte_text(tokens: Column, special_start: int = 256) -> Column:
    """Text of byte tokens: special ids dropped, malformed bytes ignored, right-stripped."""
    return _decoded(tokens, special_start)["text"]


def _marked(i: int) -> Column:
    return F.array(F.lit(i))


def _segment_bytes(tokens: Column, rate: float, cfg: InfillConfig, keys: list[Column]) -> Column:
    """A segment of byte tokens cut at two drawn characters and put in another order."""

    def cut(d):
        def rearranged(decoded):
            text = decoded["text"]
            n = F.length(text) + 1
            x, y = number(d, 1) % n, number(d, 2) % n

            def moved(c):
                at = lambda k: F.octet_length(F.substring(text, F.lit(1), k.cast("int")))
                part = lambda a, b: F.slice(decoded["bytes"], at(a) + 1, at(b) - at(a))
                pre, mid, suf = part(F.lit(0), c["low"]), part(c["low"], c["high"]), part(c["high"], n - 1)
                spm = F.concat(_marked(cfg.prefix), _marked(cfg.suffix), suf, _marked(cfg.middle), pre, mid)
                psm = F.concat(_marked(cfg.prefix), pre, _marked(cfg.suffix), suf, _marked(cfg.middle), mid)
                return F.when(number(d, 3) < below(cfg.spm_rate), spm).otherwise(psm)

            out = bind(F.struct(F.least(x, y).alias("low"), F.greatest(x, y).alias("high")), moved)
            return out if cfg.no_prefix is None else F.when(F.startswith(text, F.lit(cfg.no_prefix)), tokens).otherwise(out)

        return F.when(number(d) >= below(rate), tokens).otherwise(bind(_decoded(tokens, 256), rearranged))

    return bind(draw(cfg.seed, F.lit("infill"), *keys), cut)


def _rejoined(tokens: Column, mark: int, change: Callable[[Column, Column], Column]) -> Column:
    """The parts between marks, changed; each non-empty one before the last closed by the mark; empty ones vanish."""

    def parts(at):
        def part(k):
            after = F.when(k > 0, at[k - 1] + 1).otherwise(F.lit(0))
            end = F.when(k < F.size(at), at[k]).otherwise(F.size(tokens))
            body = F.slice(tokens, after + 1, end - after)
            closed = lambda b: F.when(k == F.size(at), change(b, k)).when(
                F.size(b) > 0, F.concat(change(b, k), _marked(mark))
            ).otherwise(F.array().cast("array<int>"))
            return bind(body, closed)

        return F.flatten(F.transform(upto(F.size(at) + 1), part))

    at = F.filter(upto(F.size(tokens)), lambda i: tokens[i] == mark)
    return bind(F.when(~F.array_contains(tokens, mark), F.array().cast("array<int>")).otherwise(at), parts)


def fim_bytes(df: DataFrame, cfg: InfillConfig) -> DataFrame:
    """(idx, tokens) of byte tokens rearranged, then trimmed or padded to their length."""
    idx = F.col("idx")

    def segment(body, k):
        whole = _segment_bytes(body, cfg.rate, cfg, [idx, k])
        if cfg.split is None:
            return whole
        pieces = _rejoined(body, cfg.split, lambda f, j: _segment_bytes(f, cfg.fragment_rate, cfg, [idx, k, j]))
        left = number(draw(cfg.seed, F.lit("split"), idx, k)) >= below(cfg.rate)
        return F.when(~F.array_contains(body, cfg.split), whole).when(left, body).otherwise(pieces)

    def sized(t):
        n = F.size(t)
        fit = lambda out: F.slice(F.concat(out, F.array_repeat(F.lit(cfg.pad), F.greatest(n - F.size(out), F.lit(0)))), 1, n)
        return F.struct(bind(_rejoined(t, cfg.eod, segment), fit).alias("tokens"))

    return _once(by_rows(df), bind(F.col("tokens").cast("array<int>"), sized))


def infill_segment(tokens: list[int], rate: float, cfg: InfillConfig, tok, keys: tuple) -> list[int]:
    """One segment with a tokenizer from outside; the draws are those of :func:`fim_bytes`."""
    d = plain_draw(cfg.seed, "infill", *keys)
    if plain_number(d) >= below(rate):
        return tokens
    text = tok.decode(tokens)
    if cfg.no_prefix is not None and text.startswith(cfg.no_prefix):
        return tokens
    low, high = sorted(plain_number(d, k) % (len(text) + 1) for k in (1, 2))
    pre, mid, suf = (list(tok.encode(s)) for s in (text[:low], text[low:high], text[high:]))
    if plain_number(d, 3) < below(cfg.spm_rate):
        return [cfg.prefix, cfg.suffix, *suf, cfg.middle, *pre, *mid]
    return [cfg.prefix, *pre, cfg.suffix, *suf, cfg.middle, *mid]


def _changed_parts(tokens: list[int], mark: int, change) -> list[int]:
    parts: list[list[int]] = [[]]
    for t in tokens:
        if t == mark:
            parts.append([])
        else:
            parts[-1].append(t)
    out = [x for k, p in enumerate(parts[:-1]) if p for x in [*change(p, k), mark]]
    return out + change(parts[-1], len(parts) - 1)


def infill_sample(tokens: list[int], idx: int, cfg: InfillConfig, tok) -> list[int]:
    """Every end-token segment (or its split-token fragments) rearranged, then trimmed or padded."""

    def segment(part, k):
        if cfg.split is None or cfg.split not in part:
            return infill_segment(part, cfg.rate, cfg, tok, (idx, k))
        if plain_number(plain_draw(cfg.seed, "split", idx, k)) >= below(cfg.rate):
            return part
        return _changed_parts(part, cfg.split, lambda f, j: infill_segment(f, cfg.fragment_rate, cfg, tok, (idx, k, j)))

    out = _changed_parts(tokens, cfg.eod, segment)
    return (out + [cfg.pad] * (len(tokens) - len(out)))[: len(tokens)]


def fim(df: DataFrame, cfg: InfillConfig, tokenizer: Callable) -> DataFrame:
    """(idx, tokens) rearranged with a tokenizer from outside, one per task: its texts only exist in Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer()
        for batch in batches:
            rows = [infill_sample(list(map(int, t)), int(i), cfg, tok) for i, t in zip(batch["idx"], batch["tokens"])]
            yield pd.DataFrame({"idx": batch["idx"], "tokens": rows})

    return df.select("idx", "tokens").mapInPandas(run, "idx bigint, tokens array<int>")
