"""Top-level build: blend x split x size to the final order of samples, and the table cache."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.ordering import ranged_running
from weft.operators.samples import (
    SPLITS,
    epoch_plan,
    requested_per_source,
    shuffle_samples,
    split_corpus,
)
from weft.session import pin


@dataclass(frozen=True)
class BuildConfig:
    """What to build.  ``weights`` None means plain names; ``sizes`` None means one epoch."""

    length: int
    split: str = "99,1,0"
    seed: int = 1234
    extra: bool = True
    weights: tuple[tuple[str, float], ...] | None = None
    sizes: tuple[int | None, int | None, int | None] | None = None
    separate_validation: bool = False
    drop_last_validation: bool = True


def requested_sizes(
    train_iters: int, batch: int, eval_interval: int, eval_iters: int
) -> tuple[int, int, int]:
    """Samples for train, validation and test from iterations and evaluation points."""
    points = train_iters // eval_interval + 1
    return train_iters * batch, points * eval_iters * batch, eval_iters * batch


#: Between the split and the data set in the key that one plan for all splits works with.
BETWEEN = "\x1f"
#: Sample numbers that one row gives rise to.
RUN = 1 << 13


def build_splits(corpus: DataFrame, config: BuildConfig) -> dict[str, DataFrame]:
    """Per split (i, dataset, k, sample_id): the order in which samples are served.

    One plan, one shuffle and one blend serve all splits, with (split, data set) as the key.  Names without weights
    are mixed in proportion to their samples, up to the size asked for; weights need sizes, and a source
    asked for more than it has is an error.
    """
    if config.weights is not None and config.sizes is None:
        raise ValueError("weights need sizes")
    placed = split_corpus(corpus.select("dataset", "doc_id", "n_tokens"), config.split)
    docs = placed.withColumn("dataset", F.concat_ws(BETWEEN, "split", "dataset"))
    drop_last = F.lit(config.drop_last_validation) | ~F.startswith("dataset", F.lit(f"valid{BETWEEN}"))
    plan = epoch_plan(docs, config.length, _requested(docs, config), config.extra, drop_last)
    name = F.substring_index("dataset", BETWEEN, -1)
    shuffled = pin(shuffle_samples(sample_ids(plan), plan, config.seed, name))  # ids only, read several times
    mix = pin(_mixed(shuffled, plan, config))
    split = F.substring_index("dataset", BETWEEN, 1)
    return {s: mix.filter(split == s).select("i", name.alias("dataset"), "k", "sample_id") for s in SPLITS}


def sample_ids(plan: DataFrame) -> DataFrame:
    """(dataset, sample_id) of every sample of a plan, in runs that are dealt out to a fixed number of tasks: they are so few that
    they would be put in one task else, which then makes every sample."""
    tasks = max(1, int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_samples") - 1) / RUN))
    some = plan.filter("n_samples > 0").select("dataset", "n_samples", F.explode(runs).alias("__run"))
    first = F.col("__run") * RUN
    ids = F.sequence(first, F.least(first + RUN, F.col("n_samples")) - 1)
    return some.repartition(tasks, "dataset", "__run").select("dataset", F.explode(ids).alias("sample_id"))


def _sizes(config: BuildConfig) -> dict[str, int | None]:
    return dict(zip(SPLITS, config.sizes or (None,) * len(SPLITS)))


def _requested(docs: DataFrame, config: BuildConfig) -> DataFrame:
    """(dataset, requested) of the sources that take part in each split; null asks for one epoch."""
    spark, sizes = docs.sparkSession, _sizes(config)
    totals = docs.groupBy("split", "dataset").agg(F.sum("n_tokens").alias("__t"))  # a row per source and split
    if config.weights is not None:
        asked = [
            (split, f"{split}{BETWEEN}{source}", n)
            for split, size in sizes.items() if size is not None
            for source, n in requested_per_source(size, dict(config.weights)).items()
        ]
        table = spark.createDataFrame(asked, "split string, dataset string, requested bigint")
        sized = table.select("split").distinct().withColumn("__sized", F.lit(True))
        rows = totals.join(F.broadcast(table), ["split", "dataset"], "left").join(F.broadcast(sized), "split", "left")
        return rows.filter("requested is not null or __sized is null").select("dataset", "requested")
    table = spark.createDataFrame(list(sizes.items()), "split string, size bigint")
    whole = totals.groupBy("split").agg(F.sum("__t").alias("__all"))
    rows = totals.join(F.broadcast(table), "split").join(whole, "split")
    share = F.ceil(F.col("size").cast("double") * F.col("__t") / F.col("__all").cast("double"))
    return rows.select("dataset", share.cast("bigint").alias("requested"))


def _mixed(shuffled: DataFrame, plan: DataFrame, config: BuildConfig) -> DataFrame:
    """(i, dataset, k, sample_id) of all splits: samples in the order of (k + 1/2) / weight."""
    spark, sizes = shuffled.sparkSession, _sizes(config)
    counts: dict[str, dict[str, int]] = {s: {} for s in SPLITS}
    for r in plan.select("dataset", "n_samples").orderBy("dataset").collect():  # a row per source and split
        split, source = r["dataset"].split(BETWEEN, 1)
        counts[split][source] = r["n_samples"]
    rows = []
    for split, have in counts.items():
        size, total = sizes[split], sum(have.values())
        if config.weights is not None and size is not None:
            weights, take = dict(config.weights), size
        else:
            weights, take = {s: float(n) for s, n in have.items() if n}, total if size is None else min(size, total)
        whole = sum(weights.values())
        apart = config.separate_validation and split == "valid"
        shares = {s: w / whole for s, w in weights.items() if w > 0}
        near = float(take + len(weights) / 2 + 1)
        if not apart:
            short = {s: have.get(s, 0) for s, w in shares.items() if math.floor(w * take - 0.5) > have.get(s, 0)}
            if short or sum(min(have.get(s, 0), math.floor(near * w + 0.5)) for s, w in shares.items()) < take:
                raise ValueError(f"{split}: sources asked for more samples than they have: {short or take}")
        rows += [(f"{split}{BETWEEN}{s}", split, d, w, near, take, apart) for d, (s, w) in enumerate(shares.items())]
    kind = "dataset string, split string, place int, w double, near double, take bigint, apart boolean"
    table = spark.createDataFrame(rows, kind)  # a row per source and split
    known = shuffled.join(F.broadcast(table), "dataset").withColumn("__s", (F.col("k") + 0.5) / F.col("w"))
    alone = known.filter("apart").select(F.col("k").alias("i"), "dataset", "k", "sample_id")
    near = known.filter("not apart and __s <= near").select("split", "dataset", "k", "sample_id", "place", "take", "__s")
    ranked = ranged_running(near, ["__s", "place", "k"], within=["split"], out="i").filter("i < take")
    return ranked.select("i", "dataset", "k", "sample_id").unionByName(alone)


def description_key(description: dict) -> str:
    """md5 of the JSON description of a build."""
    return hashlib.md5(
        json.dumps(description, indent=4, default=str, sort_keys=True).encode()
    ).hexdigest()


def cached(
    spark: SparkSession, folder: str, description: dict, make: Callable[[], DataFrame]
) -> DataFrame:
    """The table built earlier from the same description, else build and keep it.

    The description is written beside the table, and last, so a half-written table of a lost
    job is rebuilt.
    """
    key = description_key(description)
    table, mark = f"{folder}/{key}", f"{folder}/{key}-description"
    try:
        spark.read.text(mark).limit(1).collect()
    except Exception as missing:  # noqa: BLE001 - any unreadable mark means: not built
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        make().write.mode("overwrite").parquet(table)
        text = json.dumps(description, default=str, sort_keys=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
            mark
        )
    return spark.read.parquet(table)
