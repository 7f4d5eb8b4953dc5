"""Sentence runs and title blocks: consecutive sentences up to a target length.

A document is one row of an Arrow batch; the runs of all documents of a batch are searched side by side in their prefix
sums, so the work is linear in the sentences and nothing but the seed decides the targets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.draws import plain_draw, plain_number
from weft.functions.ordering import hashed_running, order_key, ranged_running

LONG_SENTENCE = 512
RUNS = "array<struct<first:int,last:int,target:int>>"


def run_ends(
    lengths: pa.ListArray, min_here: int, left_over: int, target_of: Callable[[np.ndarray, int], np.ndarray]
) -> pa.ListArray:
    """Runs of every row of a batch: a run closes at its target with at least ``min_here`` sentences inside and
    ``left_over`` left, or at the end of the document.

    The r-th runs of all documents that still have one are found together, by search in the prefix sums;
    ``target_of(rows, r)`` gives their targets.
    """
    offsets = np.asarray(lengths.offsets, dtype=np.int64)
    sizes = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    rows, at, found, r = np.flatnonzero(end > start), start[end > start], [], 0
    while len(rows):
        target = target_of(rows, r)
        full = np.searchsorted(total, total[at] + target, side="left")
        close = np.maximum(full, at + max(min_here, 1))
        close = np.where(close <= end[rows] - left_over, close, end[rows])
        found.append((rows, at - start[rows], close - start[rows], target))
        more = close < end[rows]
        rows, at, r = rows[more], close[more], r + 1
    row, first, last, target = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(4))
    order = np.argsort(row, kind="stable")  # a row's runs keep their order
    bounds = np.searchsorted(row[order], np.arange(len(lengths) + 1))
    fields = [pa.array(x[order], pa.int32()) for x in (first, last, target)]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["first", "last", "target"]))


def _usable(lengths: pa.ListArray, min_sentences: int, tested_from: int) -> pa.ListArray:
    """The rows with enough sentences, and none too long where there are at least ``tested_from`` of them; the others
    without sentences.  Asked here, since a filter outside would have the texts cut once more for each condition."""
    offsets = np.asarray(lengths.offsets, dtype=np.int64)
    sizes = lengths.flatten().to_numpy(zero_copy_only=False)
    n, start = np.diff(offsets), offsets[:-1] - offsets[0]
    too_long = np.concatenate(([0], np.cumsum(sizes > LONG_SENTENCE)))
    bad = (n < min_sentences) | ((n >= tested_from) & (too_long[start + n] > too_long[start]))
    kept = np.repeat(~bad, n)
    ends = np.concatenate(([0], np.cumsum(np.where(bad, 0, n))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sizes[kept], pa.int32()))


def _runs_to(lengths: Column, target: Column, min_sentences: int) -> Column:
    """Runs by one target per document."""

    @F.arrow_udf(RUNS)
    def walk(lengths: pa.Array, target: pa.Array) -> pa.Array:
        aims = target.to_numpy(zero_copy_only=False)
        return run_ends(_usable(lengths, min_sentences, min_sentences), min_sentences, min_sentences, lambda rows, r: aims[rows])

    return walk(lengths, target)


def _runs_drawn(lengths: Column, key: Column, min_sentences: int, max_len: int, short_ratio: int, seed: int) -> Column:
    """Runs by a target for every run: drawn, one in ``short_ratio`` is short, 2 + h mod (max_len - 1); without a ratio
    ``max_len``."""

    @F.arrow_udf(RUNS)
    def walk(lengths: pa.Array, key: pa.Array) -> pa.Array:
        names = key.to_pylist()

        def targets(rows, r):
            if not short_ratio:
                return np.full(len(rows), max_len, dtype=np.int64)
            h = np.array([plain_number(plain_draw(seed, names[i], r)) for i in rows.tolist()], dtype=np.int64)
            return np.where(h % short_ratio == 0, 2 + h % (max_len - 1), max_len)

        return run_ends(_usable(lengths, min_sentences, 2), min_sentences, 2, targets)

    return walk(lengths, key)


def _dealt(walked: DataFrame, *keys: str) -> DataFrame:
    """A row per run.  Outer, because Spark puts a test for empty arrays before an inner one, and walks every text again for it."""
    return walked.select(*keys, F.posexplode_outer("__r").alias("run", "__x")).filter("run is not null")


def sentence_runs(
    docs: DataFrame,
    max_len: int,
    short_ratio: int = 0,
    min_sentences: int = 2,
    n_samples: int | None = None,
    epochs: int = 1,
    seed: int = 1234,
) -> DataFrame:
    """(epoch, doc_id, run, first, last, target, k) from (doc_id, sentence_lengths).

    With ``short_ratio`` r, one target in r is short: 2 + h mod (max_len - 1).  ``n_samples``
    takes whole epochs until there are enough.  ``k`` is the seeded order.
    """

    def one_pass(first_epoch, how_many):
        rows = docs.select(
            "doc_id", F.col("sentence_lengths").cast("array<int>").alias("__l")
        ).withColumn(
            "epoch", F.explode(F.sequence(F.lit(first_epoch), F.lit(first_epoch + how_many - 1)))
        )

        key = F.concat_ws("|", "epoch", "doc_id")
        walked = rows.withColumn("__r", _runs_drawn(F.col("__l"), key, min_sentences, max_len, short_ratio, seed))
        return _dealt(walked, "epoch", "doc_id").select("epoch", "doc_id", "run", "__x.*")

    if n_samples is not None:
        epochs = _epochs_for(one_pass, n_samples)
    runs = one_pass(0, epochs).withColumn("__k", order_key(seed + 1, "epoch", "doc_id", "run"))
    return hashed_running(runs, "__k", ties=["epoch", "doc_id", "run"], out="k").drop("__k")


def _epochs_for(one_pass, n_samples: int) -> int:
    """Whole epochs until ``n_samples`` runs: counts per epoch are the only thing brought back."""
    have, epochs, guess = 0, 0, 1
    while have < n_samples:
        counts = {
            r["epoch"]: r["n"]
            for r in one_pass(epochs, guess).groupBy("epoch").agg(F.count(F.lit(1)).alias("n")).collect()
        }
        if not counts:
            raise ValueError("no document yields a sentence run")
        for e in range(epochs, epochs + guess):
            have += counts.get(e, 0)
            epochs = e + 1
            if have >= n_samples:
                break
        per_epoch = max(1, have // epochs)
        guess = max(1, min(64, (n_samples - have) // per_epoch + 1))
    return epochs


def title_blocks(
    docs: DataFrame, max_len: int, min_sentences: int = 1, epochs: int = 1, seed: int = 1234
) -> DataFrame:
    """(epoch, doc_id, first, last, block_id, k) from (doc_id, sentence_lengths, title_length).

    The target is what the title leaves; a block closes with at least ``min_sentences`` left.
    Block ids count documents in order and restart with every epoch.
    """
    lengths = F.col("sentence_lengths").cast("array<int>")
    rows = docs.select("doc_id", lengths.alias("__l"), "title_length")
    target = F.lit(max_len) - F.col("title_length")
    walked = rows.withColumn("__r", _runs_to(F.col("__l"), target.cast("int"), min_sentences))
    blocks = _dealt(walked, "doc_id").select("doc_id", "run", "__x.first", "__x.last")
    numbered = ranged_running(blocks, ["doc_id", "run"], out="block_id")
    copies = numbered.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.withColumn("__k", order_key(seed + 1, "epoch", "block_id"))
    ranked = hashed_running(copies, "__k", ties=["epoch", "block_id"], out="k")
    return ranked.select("epoch", "doc_id", "first", "last", "block_id", "k")


def run_sentences(runs: DataFrame, docs: DataFrame, column: str = "sentences") -> DataFrame:
    """(idx, sentences, target): the slices of (doc_id, ``column`` array) that runs name.

    The runs of a document meet it once and are cut from its array there.
    """
    per_doc = runs.groupBy("doc_id").agg(
        F.collect_list(F.struct("k", "first", "last", "target")).alias("__r")
    )
    rows = per_doc.join(docs.select("doc_id", F.col(column).alias("__s")), "doc_id")
    cut = F.transform(
        "__r",
        lambda r: F.struct(
            r["k"].alias("idx"),
            F.slice(F.col("__s"), r["first"] + 1, r["last"] - r["first"]).alias("sentences"),
            r["target"].alias("target"),
        ),
    )
    return rows.select(F.explode(cut).alias("__x")).select("__x.*")
