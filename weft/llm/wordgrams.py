"""Hashed character n-grams of words, for a whole dictionary of distinct words at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weft.llm.arrow import ragged

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def features(dictionary: pa.Array, shortest: int, longest: int, bits: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, bounds per word) in ``2 ** bits`` buckets: the character n-grams of
    ``<word>`` of the given lengths, and with ``whole`` the word itself."""
    words = pc.fill_null(dictionary.cast(pa.large_string()), "")
    n = len(words)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    codes = np.empty(int(bounds[-1]), dtype=np.uint64)
    raw = words.buffers()[2]
    at = np.asarray(words.buffers()[1]).view(np.int64)[words.offset : words.offset + n + 1] if n else np.zeros(1, np.int64)
    text = bytes(raw)[at[0] : at[-1]].decode("utf-8") if raw is not None and n else ""
    inner = np.ones(len(codes), dtype=bool)
    inner[bounds[:-1]] = False
    inner[bounds[1:] - 1] = False
    codes[inner] = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    codes[bounds[:-1]] = ord("<")
    codes[bounds[1:] - 1] = ord(">")
    shift = np.uint64(64 - bits)
    found, counts = [], []
    spread = codes * _STEP
    for k in range(shortest, longest + 1):
        per = np.maximum(sizes - k + 1, 0)
        at = ragged(bounds[:-1], per)
        h = np.full(len(at), k, dtype=np.uint64)
        for j in range(k):
            h = h * _MIX + spread[at + j]
        found.append(_mixed(h) >> shift)
        counts.append(per)
    if whole and n:
        # a polynomial over the word's characters, longest words first in power
        place = (np.arange(len(codes)) - np.repeat(bounds[:-1], sizes)).astype(np.uint64)
        h = np.add.reduceat(spread * (_mixed(place * _STEP + np.uint64(1)) | np.uint64(1)), bounds[:-1])
        found.append(_mixed(h) >> shift)
        counts.append(np.ones(n, dtype=np.int64))
    per = np.stack(counts)  # kinds x words
    out = np.empty(int(per.sum()), dtype=np.int64)
    ends = np.cumsum(per.sum(axis=0))
    start = ends - per.sum(axis=0)
    for kind, values in zip(per, found):
        out[ragged(start, kind)] = values
        start = start + kind
    return out, np.concatenate(([0], ends))


def per_word(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (along the first axis) between the bounds; 0 for an empty stretch."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]
