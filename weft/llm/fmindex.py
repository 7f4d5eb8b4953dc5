"""FM-index over a sequence of small integers: suffix array, Burrows-Wheeler letters in a wavelet
matrix, and sampled suffix positions.  Every step is vectorised over many queries."""

from __future__ import annotations

import numpy as np

#: Every so many text positions the suffix array is kept.
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text`` by prefix doubling; only suffixes still tied are sorted again.
    The last letter must be smaller than all others."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    wide = int(rank.max()) + 2
    # the first sort takes as many letters as fit in one number
    key, span = rank.copy(), 1
    while span < 8 and wide ** (span + 1) < 1 << 62:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: max(n - span, 0)] = rank[span:] + 1
        key = key * wide + nxt
        span += 1
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    while True:
        first = np.flatnonzero(new)
        group = np.repeat(first, np.diff(np.append(first, n)))  # a suffix's rank: the start of its group
        rank = np.empty(n, dtype=np.int64)
        rank[order] = group
        tied = ~new
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        suffix = order[at]
        behind = np.where(suffix + span < n, rank[np.minimum(suffix + span, n - 1)] + 1, 0)
        inner = np.lexsort((behind, group[at]))
        order[at] = suffix[inner]
        behind, inside = behind[inner], group[at][inner]
        differs = np.concatenate(([True], (behind[1:] != behind[:-1]) | (inside[1:] != inside[:-1])))
        new[at] |= differs
        span *= 2


class Bits:
    """A bitmap with a running count per 64 positions."""

    def __init__(self, flags: np.ndarray):
        n = -(-(len(flags) + 1) // 64)
        packed = np.zeros(n * 8, dtype=np.uint8)
        raw = np.packbits(flags, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before the positions."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of any letter in logarithmic time in the size of the alphabet."""

    def __init__(self, letters: np.ndarray, size: int):
        self.depth = max(int(size - 1).bit_length(), 1)
        self.levels: list[tuple[Bits, int]] = []
        rest = letters.astype(np.int32)
        for k in reversed(range(self.depth)):
            flags = (rest >> k & 1).astype(bool)
            self.levels.append((Bits(flags), int(len(flags) - flags.sum())))
            rest = np.concatenate((rest[~flags], rest[flags]))
        # where each letter's stretch begins after the last level
        self.n = len(letters)

    def rank(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``letter`` before ``at``."""
        lo, hi = np.zeros_like(at), at.copy()
        for k, (bits, zeros) in zip(reversed(range(self.depth)), self.levels):
            one = (letter >> k & 1).astype(bool)
            lo1, hi1 = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The letter at a position and its occurrences before it."""
        letter, lo, hi = np.zeros_like(at), np.zeros_like(at), at.copy()
        for bits, zeros in self.levels:
            one = bits.get(hi)
            lo1, hi1 = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
            letter = letter << 1 | one
        return letter, hi - lo


class FMIndex:
    """Index of ``text`` (letters 1 to ``size - 1``); a closing 0 is added."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE):
        full = np.append(text, 0).astype(np.int64)
        order = suffix_array(full)
        letters = full[order - 1]
        self.n, self.size = len(full), size
        self.first = np.concatenate(([0], np.cumsum(np.bincount(full, minlength=size))))
        self.wavelet = WaveletMatrix(letters, size)
        kept = order % sample == 0
        self.sampled = Bits(kept)
        self.positions = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges ``[lo, hi)`` of the phrases (rows padded behind), letter by letter from the
        last; a letter outside the alphabet (0 or less) is found nowhere."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            now = np.flatnonzero((lengths > j) & (hi > lo))
            letter = phrases[now, j]
            fine = letter > 0
            letter = np.where(fine, letter, 1)
            start = self.first[letter]
            new_lo = start + self.wavelet.rank(letter, lo[now])
            new_hi = start + self.wavelet.rank(letter, hi[now])
            lo[now], hi[now] = np.where(fine, new_lo, 0), np.where(fine, new_hi, 0)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array: steps to the letter before, until one is kept."""
        out = np.zeros(len(rows), dtype=np.int64)
        now, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(now):
            there = self.sampled.get(at)
            out[now[there]] = self.positions[self.sampled.rank(at[there])] + steps
            now, at = now[~there], at[~there]
            if len(now):
                letter, before = self.wavelet.access_rank(at)
                at = self.first[letter] + before
                steps += 1
        return out % self.n
