"""Corpus to fixed-length training samples.

Plans and orders run on narrow tables (data set, document, length); token payloads are
joined once, at the end.  Every operator works per ``dataset``, so one plan serves one
corpus or a whole blend, and a data set holding most rows still spreads over all tasks.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.ordering import hashed_running, order_key, ranged_running
from weft.functions.tokens import empty_ints
from weft.operators.schedule import given, schedule, states
from weft.session import pin

SPLITS = ["train", "valid", "test"]
LAST_EPOCH_SHARE = 0.80
BLEND_SURPLUS = 0.005
MAX_DATASETS = 32766


def parse_split(text: str) -> list[float]:
    """``'99,1,0'`` to three shares of one."""
    shares = [float(x) for x in text.replace("/", ",").split(",") if x.strip()]
    shares = (shares + [0.0] * len(SPLITS))[: len(SPLITS)]
    if any(s < 0 for s in shares) or sum(shares) == 0:
        raise ValueError(f"split {text!r} needs non-negative shares with a positive sum")
    return [s / sum(shares) for s in shares]


def split_ranges(
    text: str, other: str | None = None
) -> list[tuple[float, float] | None]:
    """Book-ends of every split, None where empty, optionally cut by a second vector."""

    def ends(shares):
        at, out = 0.0, []
        for share in shares:
            out.append((at, at + share))
            at += share
        return out

    first = ends(parse_split(text))
    second = ends(parse_split(other)) if other else [(0.0, 1.0)] * len(SPLITS)
    cut = [(max(a, c), min(b, d)) for (a, b), (c, d) in zip(first, second)]
    return [(a, b) if b > a else None for a, b in cut]


def split_corpus(
    df: DataFrame, split: str, other: str | None = None, key: str = "doc_id"
) -> DataFrame:
    """``df`` with a ``split`` column: contiguous id ranges [round(b n), round(e n)) per data set.

    Only ids are ranked; the ids at the cuts (a few per data set) come back as a small table.
    """
    ranges = split_ranges(split, other)
    ranked = ranged_running(df.select("dataset", key).distinct(), [key], within=["dataset"])
    sizes = ranked.groupBy("dataset").agg(F.count(F.lit(1)).alias("__n"))
    check_datasets(sizes)
    marked = ranked.join(F.broadcast(sizes), "dataset")
    named, cuts = F.lit(None).cast("string"), []
    for name, bounds in zip(SPLITS, ranges):
        if bounds is None:
            continue
        low, high = [F.bround(F.lit(float(b)) * F.col("__n"), 0).cast("bigint") for b in bounds]
        inside = (F.col("ordinal") >= low) & (F.col("ordinal") < high)
        cuts += [
            F.min(F.when(inside, F.col(key))).alias(f"__{name}_low"),
            F.max(F.when(inside, F.col(key))).alias(f"__{name}_high"),
        ]
        named = F.when(
            F.col(key).between(F.col(f"__{name}_low"), F.col(f"__{name}_high")), name
        ).otherwise(named)
    table = marked.groupBy("dataset").agg(*cuts)  # one row per data set
    return (
        df.join(F.broadcast(table), "dataset")
        .withColumn("split", named)
        .filter("split is not null")
        .select(*df.columns, "split")
    )


def check_datasets(table: DataFrame) -> None:
    """Data sets are numbered in 16 bits; this also bounds every per-data-set broadcast."""
    if table.limit(MAX_DATASETS + 1).count() > MAX_DATASETS:
        raise ValueError(f"more than {MAX_DATASETS} data sets")


def epoch_plan(
    docs: DataFrame,
    length: int,
    requested: int | DataFrame | None = None,
    extra: bool = True,
    drop_last: bool | Column = True,
) -> DataFrame:
    """Per data set: documents, tokens, epochs needed, whether the last epoch stays apart, samples.

    ``requested`` is a sample count, a table (dataset, requested), or None for one epoch.
    """
    x = int(extra)
    stats = docs.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").cast("bigint").alias("epoch_tokens")
    )
    if isinstance(requested, DataFrame):
        stats = stats.join(requested, "dataset")
    else:
        stats = stats.withColumn("requested", F.lit(requested).cast("bigint"))
    stats = stats.withColumn(
        "epochs",
        F.when(F.col("requested").isNull(), F.lit(1)).otherwise(
            F.greatest(
                F.lit(1),
                F.expr(f"(requested * {length} + {x} + epoch_tokens - 1) div epoch_tokens"),
            )
        ),
    )
    stats = stats.withColumn(
        "head_samples", F.expr(f"((epochs - 1) * epoch_tokens - {x}) div {length}")
    ).withColumn("epoch_samples", F.expr(f"(epoch_tokens - {x}) div {length}"))
    few = F.col("requested") - F.col("head_samples") < (
        F.lit(LAST_EPOCH_SHARE) * F.col("epoch_samples")
    ).cast("bigint")
    stats = stats.withColumn("last_apart", F.coalesce((F.col("epochs") > 1) & few, F.lit(False)))
    tokens = F.col("epochs") * F.col("epoch_tokens") - x
    whole = F.floor(tokens / F.lit(length)).cast("bigint")
    kept = F.lit(drop_last) if isinstance(drop_last, bool) else drop_last
    stats = stats.withColumn(
        "n_samples", F.when(kept, whole).otherwise(F.ceil(tokens / F.lit(length)).cast("bigint"))
    ).withColumn("total_tokens", F.col("epochs") * F.col("epoch_tokens"))
    return pin(stats)  # one row per data set, read by every later step


def document_order(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(dataset, epoch, doc_id, n_tokens, pos, start): all epochs shuffled together, the last
    one on its own when the plan says so; ``start`` is the token offset in that order."""
    # the plan has a row per data set; joined by a shuffle, a data set would stay in one task for the ranks as well
    wanted = F.broadcast(plan.select("dataset", "n_docs", "epoch_tokens", "epochs", "last_apart"))
    copies = docs.select("dataset", "doc_id", "n_tokens").join(wanted, "dataset")
    copies = copies.withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), (F.col("epochs") - 1).cast("int")))
    )
    copies = copies.withColumn(
        "phase", (F.col("last_apart") & (F.col("epoch") == F.col("epochs") - 1)).cast("int")
    ).withColumn("__k", order_key(seed, "dataset", "epoch", "doc_id"))
    ordered = hashed_running(
        copies, "__k", ["n_tokens"], within=["dataset", "phase"], ties=["epoch", "doc_id"]
    )
    head = F.col("phase") * (F.col("epochs") - 1)
    return ordered.select(
        "dataset",
        "epoch",
        "doc_id",
        "n_tokens",
        (F.col("pos") + head * F.col("n_docs")).alias("pos"),
        (F.col("cum_n_tokens") + head * F.col("epoch_tokens")).alias("start"),
    )


def sample_bounds(
    order: DataFrame, plan: DataFrame, length: int, extra: bool = True
) -> DataFrame:
    """(dataset, sample_id, doc_pos, offset) for the ``n_samples + 1`` cuts of the flat order.

    Cut j lies at token min(j * length, total - extra); the document that holds it emits it, so
    there is no walk: cost is documents plus samples.
    """
    x = int(extra)
    rows = order.join(F.broadcast(plan.select("dataset", "n_samples", "total_tokens")), "dataset")
    end = F.col("start") + F.col("n_tokens")
    last_token = F.col("total_tokens") - x
    if extra:  # the document with start <= p < end
        low = F.ceil(F.col("start") / F.lit(length))
        high = F.floor((end - 1) / F.lit(length))
    else:  # the document with start < p <= end
        low = F.floor(F.col("start") / F.lit(length)) + 1
        high = F.floor(end / F.lit(length))
    low = F.greatest(low, F.lit(1)).cast("bigint")
    on_grid = F.floor(last_token / F.lit(length))
    high = F.least(high, F.col("n_samples"), on_grid).cast("bigint")
    inner = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    ragged = F.col("n_samples") * length > last_token
    holds_last = (
        (F.col("start") <= last_token) & (last_token < end)
        if extra
        else (F.col("start") < last_token) & (last_token <= end)
    )
    first = F.when(F.col("pos") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    tail = F.when(ragged & holds_last, F.array(F.col("n_samples"))).otherwise(
        F.array().cast("array<bigint>")
    )
    cuts = rows.select(
        "dataset",
        "pos",
        "start",
        "total_tokens",
        F.explode(F.concat(first, inner, tail)).alias("sample_id"),
    )
    at = F.least(F.col("sample_id") * length, F.col("total_tokens") - x)
    return cuts.select(
        "dataset",
        "sample_id",
        F.col("pos").alias("doc_pos"),
        F.when(F.col("sample_id") == 0, F.lit(0)).otherwise(at - F.col("start")).alias("offset"),
    )


def shuffle_samples(bounds: DataFrame, plan: DataFrame, seed: int, name: Column | str = "dataset") -> DataFrame:
    """(dataset, sample_id, k): seeded permutation, samples of a separate last epoch stay last.

    ``name`` stands for the data set in the draws.
    """
    rows = bounds.join(
        F.broadcast(plan.select("dataset", "n_samples", "head_samples", "last_apart")), "dataset"
    ).filter(F.col("sample_id") < F.col("n_samples"))
    rows = rows.withColumn(
        "phase", (F.col("last_apart") & (F.col("sample_id") >= F.col("head_samples"))).cast("int")
    ).withColumn("__k", order_key(seed, name, "sample_id"))
    ranked = hashed_running(rows, "__k", within=["dataset", "phase"], ties=["sample_id"])
    return ranked.select(
        "dataset",
        "sample_id",
        (F.col("pos") + F.col("phase") * F.col("head_samples")).alias("k"),
    )


def materialize(
    order: DataFrame,
    plan: DataFrame,
    corpus: DataFrame,
    length: int,
    extra: bool = True,
    pad: int = -1,
) -> DataFrame:
    """(dataset, sample_id, tokens, doc_ids): the pieces of every sample, padded to the full length.

    A document row carries its tokens once to each of its copies and is cut there; groups hold
    at most length + 1 tokens.
    """
    x = int(extra)
    rows = order.join(F.broadcast(plan.select("dataset", "n_samples")), "dataset").join(
        corpus.select("dataset", "doc_id", "tokens"), ["dataset", "doc_id"]
    )
    start, end = F.col("start"), F.col("start") + F.col("n_tokens")
    low = F.greatest(F.lit(0), F.floor((start - x) / F.lit(length))).cast("bigint")
    high = F.least(F.floor((end - 1) / F.lit(length)), F.col("n_samples") - 1).cast("bigint")

    def piece(j: Column) -> Column:
        begin = F.greatest(start, j * length)
        stop = F.least(end, j * length + length + x)
        return F.struct(
            j.alias("sample_id"),
            F.slice(
                F.col("tokens"), (begin - start + 1).cast("int"), (stop - begin).cast("int")
            ).alias("piece"),
        )

    cut = rows.filter(high >= low).select(
        "dataset",
        "pos",
        "doc_id",
        F.explode(F.transform(F.sequence(low, high), piece)).alias("__p"),
    )
    cut = cut.filter(F.size("__p.piece") > 0)
    grouped = cut.groupBy("dataset", F.col("__p.sample_id").alias("sample_id")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "doc_id", "__p.piece"))).alias("__all")
    )
    tokens = F.flatten(F.transform("__all", lambda p: p["piece"]))
    return grouped.withColumn("tokens", tokens).select(
        "dataset",
        "sample_id",
        F.concat(
            F.col("tokens"), F.array_repeat(F.lit(pad), F.lit(length + x) - F.size("tokens"))
        ).alias("tokens"),
        F.transform("__all", lambda p: p["doc_id"]).alias("doc_ids"),
    )


def lm_columns(df: DataFrame, extra: bool = True, pad: int = -1) -> DataFrame:
    """Input, shifted labels and loss mask; padding is masked and replaced by 0."""
    t, n = F.col("tokens"), F.size("tokens")
    if extra:
        ids, labels = F.slice(t, F.lit(1), n - 1), F.slice(t, F.lit(2), n - 1)
    else:
        ids, labels = t, F.concat(F.slice(t, F.lit(2), n - 1), F.array(F.lit(pad)))

    def unpad(a):  # an array without padding is not gone through
        return F.when(~F.array_contains(a, pad), a).otherwise(F.transform(a, lambda v: F.when(v == pad, 0).otherwise(v)))

    return (
        df.withColumn("__i", ids)
        .withColumn("__l", labels)
        .withColumn("input", unpad(F.col("__i")))
        .withColumn("labels", unpad(F.col("__l")))
        .withColumn("loss_mask", F.transform("__l", lambda v: F.when(v == pad, 0).otherwise(1)))
        .drop("__i", "__l")
    )


def ltor_columns(
    df: DataFrame,
    eod: int,
    column: str = "input",
    reset_positions: bool = True,
    reset_attention: bool = True,
    mask_eod: bool = True,
    pad: int | None = None,
) -> DataFrame:
    """Positions, segment ids and loss mask of left-to-right samples.

    Segment ids stand for the block-diagonal attention: a token sees earlier tokens of its own
    segment.  With ``pad`` the padding is masked in the loss as well.
    """
    t = F.col(column)
    # most samples lie inside one document; only those that hold an end are gone through token by token
    ends = F.filter(F.transform(t, lambda v, i: F.when(v == eod, i + 1)), lambda e: e.isNotNull())
    ends = F.when(~F.array_contains(t, eod), empty_ints()).otherwise(ends)
    edges = F.concat(F.array(F.lit(0)), ends, F.array(F.size(t)))
    spans = F.zip_with(F.slice(edges, F.lit(2), F.size(edges) - 1), edges, lambda b, a: b - a)
    spans = F.filter(spans, lambda n: n > 0)  # per segment, so both columns cost O(tokens)
    positions = F.flatten(F.transform("__s", lambda n: F.sequence(F.lit(0), n - 1)))
    segments = F.flatten(F.transform("__s", lambda n, k: F.array_repeat(k, n)))
    plain = F.transform(t, lambda v, i: i)
    zero = F.transform(t, lambda v: F.lit(0))
    out = df.withColumn("__s", spans) if reset_positions or reset_attention else df
    masked = F.lit(False)

    def loss(v):
        hit = masked
        if mask_eod:
            hit = hit | (v == eod)
        if pad is not None:
            hit = hit | (v == pad)
        return F.when(hit, 0).otherwise(1)

    marks = [eod] * mask_eod + [pad] * (pad is not None)
    losses = F.transform(t, loss)
    if marks:
        none = reduce(and_, [~F.array_contains(t, mark) for mark in marks])
        losses = F.when(none, F.array_repeat(F.lit(1), F.size(t))).otherwise(losses)
    return (
        out.withColumn("position_ids", positions if reset_positions else plain)
        .withColumn("segment_ids", segments if reset_attention else zero)
        .withColumn("loss_mask", losses)
        .drop("__s")
    )


def parse_blend(items: list[str | float]) -> tuple[list[str], list[float] | None]:
    """Names alone, or weight/name pairs."""
    if len(items) % 2 == 0:
        firsts = items[::2]
        numbers = []
        for x in firsts:
            try:
                numbers.append(float(x))
            except ValueError:
                numbers.append(None)
        if all(v is not None for v in numbers) and numbers:
            return [str(x).strip() for x in items[1::2]], numbers
        if any(v is not None for v in numbers):
            raise ValueError("weights and names must alternate, or no weight be given")
    return [str(x).strip() for x in items], None


def requested_per_source(size: int, weights: dict[str, float], surplus: float = BLEND_SURPLUS):
    """Samples asked of every source: ceil(ceil(size * w) * (1 + surplus))."""
    total = sum(weights.values())
    return {
        name: math.ceil(math.ceil(size * w / total) * (1 + surplus)) for name, w in weights.items()
    }


def blend(
    samples: DataFrame, weights: dict[str, float], size: int, mode: str = "stride"
) -> DataFrame:
    """(i, dataset, k): weighted interleave of per-source samples numbered ``k`` from 0.

    ``stride`` sorts samples by (k + 1/2) / weight; ``exact`` is the greedy largest-deficit schedule
    (:mod:`weft.operators.schedule`).  Both take any size.  A source asked for more samples than it has is an
    error that names it, see :func:`oversampled`.
    """
    names, shares = _shares(weights)
    spark = samples.sparkSession
    table = spark.createDataFrame(
        [(name, i, w) for i, (name, w) in enumerate(zip(names, shares))],
        "dataset string, dataset_id int, w double",
    )
    keyed = samples.select("dataset", "k").join(F.broadcast(table), "dataset")
    if mode == "exact":
        known = states(spark, shares, size)
        _raise_if_any(_short(given(known, names), samples))
        plan = schedule(known, shares, size)
        return plan.join(keyed, ["dataset_id", "k"]).select("i", "dataset", "k")
    # at least size samples lie below size + sources / 2, so the rest need not be sorted
    near = float(size + len(names) / 2 + 1)
    have = samples.groupBy("dataset").agg(F.count(F.lit(1)).alias("have"))
    due = table.filter("w > 0").join(have, "dataset", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    asked = F.floor(F.col("w") * size - 0.5).cast("bigint")
    _raise_if_any(due.select("dataset", asked.alias("asked"), "have").filter("asked > have"))
    below = F.least("have", F.floor(near * F.col("w") + 0.5).cast("bigint"))
    got = due.agg(F.coalesce(F.sum(below), F.lit(0)).alias("n")).first()["n"]
    if got < size:
        raise ValueError(f"blend asked for more samples than there are: {size} of {got}")
    keyed = keyed.filter("w > 0").withColumn("__s", (F.col("k") + 0.5) / F.col("w"))
    ranked = ranged_running(
        keyed.filter(F.col("__s") <= near).select("dataset", "dataset_id", "k", "__s"), ["__s", "dataset_id", "k"], out="i"
    )
    return ranked.filter(F.col("i") < size).select("i", "dataset", "k")


def oversampled(samples: DataFrame, weights: dict[str, float], size: int) -> DataFrame:
    """(dataset, asked, have): the sources that the exact schedule asks for more samples than they have."""
    names, shares = _shares(weights)
    return _short(given(states(samples.sparkSession, shares, size), names), samples)


def blend_exhaustive(samples: DataFrame, mode: str = "stride") -> DataFrame:
    """(i, dataset, k): every sample of every source once, interleaved in proportion to size."""
    sizes = {
        r["dataset"]: r["n"]
        for r in samples.groupBy("dataset")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("dataset")
        .limit(MAX_DATASETS + 1)
        .collect()
    }
    names, shares = _shares(sizes)
    total = sum(sizes.values())
    if mode == "exact":
        spark, limits = samples.sparkSession, list(sizes.values())
        table = spark.createDataFrame(list(enumerate(names)), "dataset_id int, dataset string")
        plan = schedule(states(spark, shares, total, limits), shares, total, limits)
        return (
            plan.join(F.broadcast(table), "dataset_id")
            .join(samples.select("dataset", "k"), ["dataset", "k"])
            .select("i", "dataset", "k")
        )
    return blend(samples, {name: float(n) for name, n in sizes.items()}, total)


def _shares(weights: dict[str, float]) -> tuple[list[str], list[float]]:
    if len(weights) > MAX_DATASETS:
        raise ValueError(f"more than {MAX_DATASETS} data sets")
    total = sum(weights.values())
    return list(weights), [float(w / total) for w in weights.values()]


def _short(asked: DataFrame, samples: DataFrame) -> DataFrame:
    have = samples.groupBy("dataset").agg(F.count(F.lit(1)).alias("have"))
    both = asked.join(have, "dataset", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return both.select("dataset", "asked", "have").filter("asked > have")


def _raise_if_any(short: DataFrame) -> None:
    few = short.orderBy("dataset").limit(5).collect()
    if few:
        raise ValueError(f"sources asked for more samples than they have: {few}")
