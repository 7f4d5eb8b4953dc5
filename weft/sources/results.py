"""Result files, expert-load logs, rollout dumps, evaluation sets, task stores and block stores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.ordering import ranged_running
from weft.functions.text import to_number
from weft.operators.batches import partition_of

SAMPLE_FORMAT = "task_loss_samples_v1"  # fixed value


def parse_results(files: DataFrame) -> DataFrame:
    """(run, form, metric, step, value) from (run, content): training files hold ``values`` per
    metric, inference files a record per request; text and NaN are dropped."""
    doubled = F.from_json(F.concat(F.lit("["), F.col("content"), F.lit("]")), "array<string>")[0]
    content = F.when(F.startswith(F.ltrim("content"), F.lit('"')), doubled).otherwise(F.col("content"))
    entries = files.select("run", F.explode(F.from_json(content, "map<string,string>")).alias("name", "body"))
    values = F.get_json_object("body", "$.values")
    training = entries.filter(values.isNotNull()).select(
        "run",
        F.lit("training").alias("form"),
        F.col("name").alias("metric"),
        F.explode(F.from_json(values, "map<string,string>")).alias("step", "raw"),
    )
    served = F.get_json_object("body", "$.latency").isNotNull() | F.get_json_object(
        "body", "$.generated_text"
    ).isNotNull()
    inference = entries.filter(values.isNull() & served).select(
        "run",
        F.lit("inference").alias("form"),
        F.col("name").alias("step"),
        F.explode(F.from_json("body", "map<string,string>")).alias("metric", "raw"),
    )
    rows = training.unionByName(inference).withColumn("value", to_number("raw"))
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value")).drop("raw")


def read_results(spark: SparkSession, glob: str) -> DataFrame:
    files = spark.read.option("wholetext", "true").text(glob)
    return parse_results(files.select(F.input_file_name().alias("run"), F.col("value").alias("content")))


EXPERT_LOAD = "iter bigint, block string, layer int, mtp_idx int, tpe array<array<bigint>>"


def read_expert_load(spark: SparkSession, folder: str) -> DataFrame:
    """(rank, iter, block, layer, mtp_idx, micro, expert, tokens) from one JSON-lines file per rank."""
    rows = spark.read.schema(EXPERT_LOAD).json(folder).withColumn(
        "rank", F.regexp_extract(F.input_file_name(), r"rank(\d+)", 1).cast("int")
    )
    micro = rows.select("rank", "iter", "block", "layer", "mtp_idx", F.posexplode("tpe").alias("micro", "e"))
    return micro.select(
        "rank", "iter", "block", "layer", "mtp_idx", "micro", F.posexplode("e").alias("expert", "tokens")
    )


def write_rollouts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_task_samples(samples: DataFrame, counts: DataFrame, path: str, length: int) -> None:
    """Samples by task, and beside them (task, samples, seen, skipped, length, format)."""
    samples.write.partitionBy("task").mode("overwrite").parquet(f"{path}/samples")
    meta = counts.withColumn("length", F.lit(length)).withColumn("format", F.lit(SAMPLE_FORMAT))
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_task_samples(spark: SparkSession, path: str, tasks: list[str], length: int) -> DataFrame:
    """Samples of the asked tasks; a missing task, another length or format is an error."""
    meta = spark.read.parquet(f"{path}/meta").filter(F.col("task").isin(tasks))
    rows = meta.select("task", "length", "format", "samples").collect()  # one row per asked task
    missing = sorted(set(tasks) - {r["task"] for r in rows if r["samples"] > 0})
    if missing:
        raise ValueError(f"no prepared samples for {missing}")
    wrong = [r["task"] for r in rows if r["length"] != length or r["format"] != SAMPLE_FORMAT]
    if wrong:
        raise ValueError(f"sequence length or format differs for {wrong}")
    return spark.read.parquet(f"{path}/samples").filter(F.col("task").isin(tasks))


def missing_blocks(
    spark: SparkSession,
    n: int,
    size: int,
    existing: DataFrame,
    valid: Column | None = None,
    fraction: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """(block, start, end) of the blocks of [0, n) not yet stored, or stored but not ``valid``.

    ``existing`` holds a ``block`` column; ``fraction`` picks a seeded share of the missing ones.
    """
    from weft.functions.ordering import hash_uniform

    kept = existing if valid is None else existing.filter(valid)
    blocks = spark.range(-(-n // size)).select(
        F.col("id").alias("block"),
        (F.col("id") * size).alias("start"),
        F.least((F.col("id") + 1) * size, F.lit(n)).alias("end"),
    )
    missing = blocks.join(kept.select("block").distinct(), "block", "left_anti")
    if fraction >= 1.0:
        return missing
    return missing.filter(hash_uniform(seed, "block") < fraction)


def store_blocks(df: DataFrame, path: str) -> None:
    """Write rows with a ``block`` column; only the blocks at hand are replaced."""
    (
        df.write.partitionBy("block")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def embed(
    df: DataFrame,
    encoder: Callable[[], Callable[[list[list[int]]], list]],
    max_len: int,
    end_marker: int,
    pad: int,
    dim: int,
) -> DataFrame:
    """Adds ``embedding``: the mean over the inner tokens of the user's encoder, NaN as zeros.

    Inputs lose the end marker, are cut to ``max_len - 2`` and never empty.  ``encoder`` is built
    once per task and maps token lists to one (tokens x dim) array each.
    """
    import numpy as np

    t = F.col("tokens")
    bare = F.when(F.try_element_at(t, F.lit(-1)) == end_marker, F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t)
    cut = F.slice(bare, 1, max_len - 2)
    ready = F.when(F.size(cut) == 0, F.array(F.lit(pad))).otherwise(cut)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for batch in batches:
            hidden = encode([[int(x) for x in row] for row in batch])
            means = []
            for h in hidden:
                h = np.asarray(h, dtype="float64").reshape(-1, dim)
                mean = h.mean(axis=0) if len(h) else np.full(dim, np.nan)
                means.append(np.zeros(dim, "float32") if np.isnan(mean).any() else mean.astype("float32"))
            yield pd.Series(means)

    return df.withColumn("embedding", run(ready))


def read_eval_set(
    raw: DataFrame,
    fields: dict[str, str],
    task: str | None = None,
    files: DataFrame | None = None,
    path_field: str = "path",
    partition: tuple[int, int] | None = None,
    test_split: bool = False,
    order: str = "sample_id",
) -> DataFrame:
    """Evaluation rows with mapped fields.

    ``fields`` maps output to input columns (dots reach into nested data).  With ``files`` only
    rows whose file exists stay.  ``partition`` (k, part) keeps one contiguous share, a test split
    has blank gold, a task name is added and prefixes the id.
    """
    df = raw.select(*[F.col(src).alias(out) for out, src in fields.items()])
    if files is not None:
        df = df.join(files.select(F.col("path").alias(path_field)), path_field, "left_semi")
    if test_split:
        df = df.withColumn("gold", F.lit(""))
    if task is not None:
        df = df.withColumn("task", F.lit(task)).withColumn(
            "sample_id", F.concat(F.lit(task + "-"), F.col("sample_id").cast("string"))
        )
    if partition is not None:
        k, part = partition
        ids = ranged_running(df.select(order), [order], out="i")
        mine = ids.filter(partition_of(ids.count(), k, "linspace") == part).select(order)
        df = df.join(mine, order, "left_semi")
    return df


def stack_tasks(tasks: dict[str, DataFrame]) -> DataFrame:
    """Several evaluation sets under one schema."""
    out = None
    for df in tasks.values():
        out = df if out is None else out.unionByName(df)
    return out
