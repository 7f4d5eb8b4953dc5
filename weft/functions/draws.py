"""A counter-based random generator as column expressions and, for whole batches, as arrays of numbers.

A draw is named by its seed and keys (sample, purpose, position), so it is the same in every partitioning, after a
lost task, in SQL and in plain Python; no state is carried from draw to draw.  One md5 holds four
whole numbers below 2^32, or 32 coins.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.ordering import order_key

RANGE = 1 << 32


def draw(seed: int | str, *keys: str | Column) -> Column:
    """32 hexadecimal digits for (seed, keys)."""
    return order_key(seed, *keys)


def plain_draw(seed: int | str, *keys) -> str:
    """The same digits outside Spark, for code that has no column form."""
    return hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()


#: The constants of md5: the state at the start, a turn for each step of a round, an addend for each step.
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_ADDENDS = [int(abs(math.sin(i + 1)) * RANGE) for i in range(64)]
#: Texts hashed side by side: enough to hide the cost of a call, few enough to stay near the processor.
SIDE_BY_SIDE = 1 << 14


def _md5_numbers(words: list, n: int) -> list[np.ndarray]:
    """The four numbers of ``n`` texts of one md5 block each; ``words`` are its 16 words, as arrays or as a word that all share."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in MD5_START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        turns = MD5_TURNS[i // 16]
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if isinstance(words[at], np.ndarray):
            np.add(f, words[at], out=f)
            np.add(f, np.uint32(MD5_ADDENDS[i]), out=f)
        else:
            np.add(f, np.uint32((MD5_ADDENDS[i] + words[at]) % RANGE), out=f)
        np.left_shift(f, np.uint32(turns[i % 4]), out=g)
        np.right_shift(f, np.uint32(32 - turns[i % 4]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return [np.add(x, np.uint32(start)).byteswap() for x, start in zip((a, b, c, d), MD5_START)]


def plain_draws(heads: Sequence[str], row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The four numbers of the draw of ``heads[row] + str(key)``, a line for each number and a column for each pair; keys are
    whole numbers from 0.

    ``heads`` are the seed and the other keys, each closed by ``|``.  Texts of one md5 block are hashed side by side, the few longer
    ones one by one.
    """
    out = np.empty((4, len(row)), np.uint32)
    if not len(row):
        return out
    texts = [h.encode() for h in heads]
    sizes = np.array([len(t) for t in texts])
    every = np.arange(int(key.max()) + 1)
    digits = np.char.mod("%d", every).astype("S")
    more = np.char.str_len(digits).astype(np.int64)
    # a key's digits and the end mark as one whole number, the first digit in its lowest byte
    tails = np.frombuffer(np.char.add(digits, b"\x80").astype("S8").tobytes(), "<u8")
    one = (sizes[row] + more[key] < 56) & (more[key] < 5)
    for size in np.unique(sizes[row[one]]).tolist():
        same, at = np.flatnonzero(sizes == size), size // 4
        begun = np.frombuffer(b"".join(texts[i].ljust(64, b"\0") for i in same.tolist()), "<u4").reshape(-1, 16).T.copy()
        alike = (begun == begun[:, :1]).all(axis=1)
        place = np.zeros(len(texts), np.int64)
        place[same] = np.arange(len(same))
        which = np.flatnonzero(one & (sizes[row] == size))
        for part in (which[i : i + SIDE_BY_SIDE] for i in range(0, len(which), SIDE_BY_SIDE)):
            r, k = place[row[part]], key[part]
            tail = tails[k] << np.uint64(8 * (size % 4))
            words: list = [int(begun[j, 0]) if alike[j] else begun[j][r] for j in range(at)] + [0] * (16 - at)
            words[at] = begun[at][r] | (tail & np.uint64(RANGE - 1)).astype(np.uint32)
            if size % 4 + more[k].max() > 3:
                words[at + 1] = (tail >> np.uint64(32)).astype(np.uint32)
            words[14] = (8 * (size + more[k])).astype(np.uint32)
            out[:, part] = _md5_numbers(words, len(part))
    for i in np.flatnonzero(~one).tolist():
        out[:, i] = np.frombuffer(hashlib.md5(texts[row[i]] + str(int(key[i])).encode()).digest(), ">u4")
    return out


def number(digits: Column, k: int = 0) -> Column:
    """Whole number k (0 to 3) of a draw, below 2^32."""
    return F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("bigint")


def plain_number(digits: str, k: int = 0) -> int:
    return int(digits[8 * k : 8 * k + 8], 16)


def below(share: float) -> int:
    """The whole number below which ``share`` of all draws lie."""
    return round(share * RANGE)


def steps(weights: Sequence[float]) -> list[int]:
    """Upper ends of all weights but the last, as parts of the range of a draw."""
    total, ends, run = sum(weights), [], 0.0
    for w in weights[:-1]:
        run += w
        ends.append(below(run / total))
    return ends


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column) -> Column:
    """The whole numbers from 0 below ``n``."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
