"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is a hashed character n-gram of a word with its edges; its value in a document is the
number of the document's distinct words that hold it.  From the labelled sample come the
smoothed log-count ratios of the two classes, those within sampling error taken as 0, and the features scaled by them go into a logistic
regression with a quadratic penalty, fitted by quasi-Newton descent in numpy; its bias is then set where the sample parts best.

A distinct word's features fold to one number, so a text's margin is the sum over its distinct words.
Null and empty texts have no words and get the bias alone.  Without labelled rows every score
is 0.5; with one class only, that class's smoothed share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weft.llm.arrow import words
from weft.llm.labelled import CHARACTERS, ROWS_PER_CLASS, Sample, chosen_rows, fitted, fold
from weft.llm.quality import score_with
from weft.llm.wordgrams import features, per_word

BITS = 20
SHORTEST, LONGEST = 3, 6
SMOOTHING = 1.0
PENALTY = 1e-4
STEPS = 150
#: Standard errors that a log ratio must exceed.
DEVIATIONS = 2.5
HELD_OUT_FOLDS, HELD_OUT = 5, 0


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document, word) of every distinct lower-case word of a document, and all words."""
    offsets, index, dictionary = words(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    n = max(len(dictionary), 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pairs = np.unique(doc * n + index)
    doc, word = pairs // n, pairs % n
    real = np.asarray(pc.binary_length(dictionary))[word] > 0 if len(word) else np.zeros(0, bool)
    return doc[real], word[real], dictionary


class RatioModel:
    """``weights``: what a feature adds to the margin for each word that holds it."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int, shortest: int, longest: int):
        self.weights, self.bias = weights, bias
        self.bits, self.shortest, self.longest = bits, shortest, longest

    def scores(self, column: pa.Array) -> np.ndarray:
        doc, word, dictionary = distinct_words(column)
        found, bounds = features(dictionary, self.shortest, self.longest, self.bits, whole=False)
        value = per_word(self.weights[found], bounds)
        margin = self.bias + np.bincount(doc, value[word], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def descend(loss, x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halving steps."""
    value, grad = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        direction, alphas = grad.copy(), []
        for s, u, rho in reversed(pairs):
            alphas.append(rho * (s @ direction))
            direction -= alphas[-1] * u
        if pairs:
            s, u, rho = pairs[-1]
            direction /= rho * (u @ u)
        else:
            direction /= max(float(np.linalg.norm(grad)), 1e-300)
        for (s, u, rho), alpha in zip(pairs, reversed(alphas)):
            direction += (alpha - rho * (u @ direction)) * s
        slope, step = float(grad @ direction), 1.0
        for _ in range(30):
            new = x - step * direction
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, u = new - x, new_grad - grad
        if s @ u > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, u, 1 / float(s @ u))]
        x, grad = new, new_grad
        if value - new_value < 1e-7:
            return x
        value = new_value
    return x


def best_cut(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The margin that parts the classes best, in the middle of the gap that it falls in."""
    order = np.argsort(margin, kind="stable")
    m = margin[order]
    right = np.concatenate(([0.0], np.cumsum(np.where(y[order] == 1, -weight[order], weight[order]))))
    at = int(right.argmax())  # so many of the lowest margins are called 0
    below = m[at - 1] if at else m[0] - 1
    above = m[at] if at < len(m) else m[-1] + 1
    return float((below + above) / 2)


def train(
    sample: Sample, bits: int = BITS, shortest: int = SHORTEST, longest: int = LONGEST,
    smoothing: float = SMOOTHING, penalty: float = PENALTY, steps: int = STEPS, deviations: float = DEVIATIONS,
) -> RatioModel:
    y, n_docs = sample.label, len(sample.label)
    ones = float(y.sum())
    if n_docs == 0 or ones in (0, n_docs):
        share = (ones + 1) / (n_docs + 2)
        return RatioModel(np.zeros(1 << bits), float(np.log(share / (1 - share))), bits, shortest, longest)
    doc, word, dictionary = distinct_words(sample.text)
    found, bounds = features(dictionary, shortest, longest, bits, whole=False)
    size = np.diff(bounds)
    word_of = np.repeat(np.arange(len(dictionary)), size)
    # counts of a feature in the documents of a class, through the words' counts
    counts = [np.bincount(found, np.bincount(word, y[doc] == c, minlength=len(dictionary))[word_of], minlength=1 << bits) for c in (0, 1)]
    seen = counts[0] + counts[1] > 0
    rate = [(c + smoothing) / (c.sum() + smoothing * seen.sum()) for c in counts]
    ratio = np.log(rate[1] / rate[0])
    error = np.sqrt(1 / (counts[0] + smoothing) + 1 / (counts[1] + smoothing))
    ratio = np.where(seen & (np.abs(ratio) > deviations * error), ratio, 0.0)
    strong = np.flatnonzero(ratio[found])
    found, word_of = found[strong], word_of[strong]
    # words without a feature left add nothing: only the others, renumbered
    telling, word_of = np.unique(word_of, return_inverse=True)
    place = np.full(len(dictionary), -1)
    place[telling] = np.arange(len(telling))
    told = place[word] >= 0
    doc, word = doc[told], place[word][told]
    n_words = len(telling)
    bounds = np.searchsorted(word_of, np.arange(n_words + 1))
    # only features that occur, renumbered
    live, at = np.unique(found, return_inverse=True)
    r = ratio[live]

    def margins(w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(doc, per_word((w * r)[at], bounds)[word], minlength=n_docs)

    weight = np.where(y == 1, 0.5 / ones, 0.5 / (n_docs - ones))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        """Penalised loss and its slope; the last coordinate is the bias."""
        w, z = x[:-1], margins(x[:-1], x[-1])
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        to_word = np.bincount(word, error[doc], minlength=n_words)
        grad = r * np.bincount(at, to_word[word_of], minlength=len(live)) + penalty * w
        value = float((weight * (np.logaddexp(0, z) - y * z)).sum() + penalty / 2 * (w @ w))
        return value, np.append(grad, error.sum())

    x = descend(loss, np.zeros(len(live) + 1), steps)
    w, b = x[:-1], float(x[-1])
    b -= best_cut(margins(w, b), y, weight)
    full = np.zeros(1 << bits)
    full[live] = w * r
    return RatioModel(full, float(b), bits, shortest, longest)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, characters: int = CHARACTERS) -> RatioModel:
    """Learned from labelled rows outside the held-out fold."""
    return fitted(chosen_rows(docs, labels, "toxic", fold("doc_id", HELD_OUT_FOLDS) != HELD_OUT, rows, characters), train)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, characters: int = CHARACTERS) -> DataFrame:
    """Scores every document; repeated rows are scored each, a null id is never held out."""
    return score_with(docs, fit(docs, labels, rows, characters), fold("doc_id", HELD_OUT_FOLDS) == HELD_OUT)
