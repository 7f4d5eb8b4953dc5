"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its words and of their character n-grams, all
hashed to one table (a word that repeats the one before it counts as a word of its own); a softmax over the two classes follows.  Vectors and output are trained
together by stochastic gradient descent in numpy on a bounded labelled sample.

As the output is linear, a trained table folds to one number per bucket, and a text's score is the
mean of its buckets' numbers.  Null and empty texts have no bucket and get the bias alone.  Without
labelled rows every score is 0.5; with one class only, that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import slices, words
from weft.llm.labelled import CHARACTERS, ROWS_PER_CLASS, Sample, chosen_rows, fitted, fold
from weft.llm.wordgrams import features, per_word

BITS = 18
SHORTEST, LONGEST = 3, 5
DIMENSIONS = 8
EPOCHS = 4
BATCH = 64
RATE = 1.0
#: Stands for a word that repeats the one before it: repetition has a vector of its own.
REPEATED = "\0" * 6
HELD_OUT_FOLDS, HELD_OUT = 3, 1
#: Bytes of text scored at a time.
SLICE_BYTES = 2 << 20


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """:func:`words` without the empty pieces, a word right behind its like replaced by ``REPEATED``."""
    offsets, index, dictionary = words(column)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    real = (np.asarray(pc.binary_length(dictionary)) > 0)[index] if len(index) else np.zeros(0, bool)
    doc, index = doc[real], index[real].astype(np.int64)
    again = np.zeros(len(index), dtype=bool)
    again[1:] = (index[1:] == index[:-1]) & (doc[1:] == doc[:-1])
    index[again] = len(dictionary)
    dictionary = pa.concat_arrays([dictionary.cast(pa.large_string()), pa.array([REPEATED], pa.large_string())])
    return np.searchsorted(doc, np.arange(len(offsets))), index, dictionary


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(document, word, times) of every distinct word of a document, and the distinct words."""
    offsets, index, dictionary = tokens(column)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pairs, times = np.unique(doc * len(dictionary) + index, return_counts=True)
    return pairs // len(dictionary), pairs % len(dictionary), times, dictionary


class SubwordModel:
    """``weights``: what one occurrence of a bucket adds to the margin; ``bias`` is added once."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int, shortest: int, longest: int):
        self.weights, self.bias = weights, bias
        self.bits, self.shortest, self.longest = bits, shortest, longest

    def scores(self, column: pa.Array) -> np.ndarray:
        offsets, index, dictionary = tokens(column)
        found, bounds = features(dictionary, self.shortest, self.longest, self.bits, whole=True)
        total = per_word(per_word(self.weights[found], bounds)[index], offsets)
        n = per_word(np.diff(bounds)[index].astype(np.float64), offsets)
        margin = self.bias + total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def train(
    sample: Sample, bits: int = BITS, shortest: int = SHORTEST, longest: int = LONGEST, dimensions: int = DIMENSIONS,
    epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 0,
) -> SubwordModel:
    """Minibatch descent on the softmax loss, the rate falling linearly to nothing.  Every step weighs
    both classes alike, so their shares in the sample don't move the score."""
    y, n_docs = sample.label, len(sample.label)
    ones = float(y.sum())
    if n_docs == 0 or ones in (0, n_docs):
        share = (ones + 1) / (n_docs + 2)
        return SubwordModel(np.zeros(1 << bits), float(np.log(share / (1 - share))), bits, shortest, longest)
    doc, word, times, dictionary = bags(sample.text)
    found, bounds = features(dictionary, shortest, longest, bits, whole=True)
    sizes = np.diff(bounds)
    length = np.maximum(np.bincount(doc, times * sizes[word], minlength=n_docs), 1)
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    weight = np.where(y == 1, n_docs / (2 * ones), n_docs / (2 * (n_docs - ones)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dimensions, 1 / dimensions, (1 << bits, dimensions))
    out, bias = np.zeros((dimensions, 2)), np.zeros(2)
    target = np.stack([1 - y, y], axis=1)
    steps, done = epochs * -(-n_docs // batch), 0
    for _ in range(epochs):
        order = rng.permutation(n_docs)
        for at in range(0, n_docs, batch):
            now = order[at : at + batch]
            here = np.concatenate([np.arange(first[d], first[d + 1]) for d in now])
            row = np.repeat(np.arange(len(now)), first[now + 1] - first[now])
            # the batch's distinct words, then their buckets
            some, word_at = np.unique(word[here], return_inverse=True)
            n = sizes[some]
            spot = np.repeat(bounds[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            bucket, bucket_at = np.unique(found[spot], return_inverse=True)
            share = times[here] / length[now][row]
            # documents x buckets is the product of two sparse maps: documents x words, words x buckets
            ends = np.concatenate(([0], np.cumsum(n)))
            vectors = per_word(table[bucket][bucket_at], ends)
            mean = np.stack([np.bincount(row, share * vectors[word_at, k], minlength=len(now)) for k in range(dimensions)], axis=1)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - target[now]) * weight[now][:, None] / len(now)
            back = error @ out.T
            step = rate * (1 - done / steps)
            to_word = np.stack([np.bincount(word_at, share * back[row, k], minlength=len(some)) for k in range(dimensions)], axis=1)
            spread = np.repeat(to_word, n, axis=0)
            grad = np.stack([np.bincount(bucket_at, spread[:, k], minlength=len(bucket)) for k in range(dimensions)], axis=1)
            table[bucket] -= step * len(now) * grad
            out -= step * len(now) * (mean.T @ error)
            bias -= step * error.sum(axis=0)
            done += 1
    margin = out[:, 1] - out[:, 0]
    return SubwordModel(table @ margin, float(bias[1] - bias[0]), bits, shortest, longest)


def score_with(docs: DataFrame, model, held_out) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of whole texts; the model travels once per executor."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE_BYTES):
            score = shipped.value.scores(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, characters: int = CHARACTERS) -> SubwordModel:
    """Learned from labelled rows outside the held-out fold."""
    return fitted(chosen_rows(docs, labels, "quality", fold("doc_id", HELD_OUT_FOLDS) != HELD_OUT, rows, characters), train)


def quality(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, characters: int = CHARACTERS) -> DataFrame:
    """Scores every document; repeated rows are scored each, a null id is never held out."""
    return score_with(docs, fit(docs, labels, rows, characters), fold("doc_id", HELD_OUT_FOLDS) == HELD_OUT)


def keep(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """The documents (all columns) that the model calls 1."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), batch.schema.names[place], SLICE_BYTES):
                yield part.filter(pa.array(shipped.value.scores(part.column(place)) >= 0.5))

    return docs.mapInArrow(run, schema)
