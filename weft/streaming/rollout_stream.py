"""Structured Streaming over rollout groups: ordered release, reward filter, staleness.

Ordered release keeps no per-source state in one task, and what waits is a log: a micro-batch writes its arrivals once, finds
complete batches by counting the narrow keys of the log, moves the frontier of every source over its
gap-free prefix and writes the rows between the old and the new frontier.  Waiting rows stay where they are.  Folders of the log
without a waiting row are left out from then on and deleted; when there are many, their waiting rows are merged into one, so a row is
rewritten only once for every ``MERGED`` micro-batches that it waits.  All outputs are folders named by the micro-batch,
overwritten when it is replayed, and nothing that a replay reads is deleted, so a lost query resumes without doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.functions.ordering import ranged_running

KEYS = ["source", "batch_id", "index_in_batch"]
#: Folders of the log beyond which they are merged.
MERGED = 16


def _files(spark: SparkSession, path: str):
    """(file system, path) by the cluster's own configuration."""
    inner = spark._jvm.org.apache.hadoop.fs.Path(path)
    return inner.getFileSystem(spark._jsc.hadoopConfiguration()), inner


def _exists(spark: SparkSession, path: str) -> bool:
    system, inner = _files(spark, path)
    return system.exists(inner)


def _delete(spark: SparkSession, path: str) -> None:
    system, inner = _files(spark, path)
    system.delete(inner, True)


def _children(spark: SparkSession, path: str) -> list[str]:
    system, inner = _files(spark, path)
    return [f.getPath().getName() for f in system.listStatus(inner)] if system.exists(inner) else []


def _state(spark: SparkSession, folder: str, epoch: int) -> tuple[list[str], DataFrame]:
    """(folders of the log with waiting rows, frontier of every source) after a micro-batch."""
    frontier = spark.createDataFrame([], "source string, next bigint")
    if not _exists(spark, f"{folder}/live/{epoch}/_SUCCESS"):
        return [], frontier
    live = sorted(r["name"] for r in spark.read.schema("name string").parquet(f"{folder}/live/{epoch}").collect())
    return live, spark.read.schema(frontier.schema).parquet(f"{folder}/frontier/{epoch}")


def _prune(spark: SparkSession, folder: str, epoch: int, live: list[str]) -> None:
    """Delete what neither this micro-batch nor a replay of it reads."""
    for name in _children(spark, f"{folder}/log"):
        if name not in live and int(name.rsplit("-", 1)[1]) < epoch:
            _delete(spark, f"{folder}/log/{name}")
    for kind in ("live", "frontier"):
        for name in _children(spark, f"{folder}/{kind}"):
            if int(name) < epoch - 1:
                _delete(spark, f"{folder}/{kind}/{name}")


def release_step(arrivals: DataFrame, epoch: int, per_batch: int, folder: str) -> None:
    """One micro-batch: log(e - 1) + arrivals -> released(e) + frontier(e) + log(e)."""
    spark, schema = arrivals.sparkSession, arrivals.schema
    live, before = _state(spark, folder, epoch - 1)
    _prune(spark, folder, epoch, live)
    arrived = f"arrived-{epoch}"
    arrivals.write.mode("overwrite").parquet(f"{folder}/log/{arrived}")
    live = [*live, arrived]

    def logged(names: list[str]) -> DataFrame:
        rows = spark.read.schema(schema).parquet(*[f"{folder}/log/{name}" for name in names])
        rows = rows.withColumn("__place", F.regexp_extract(F.col("_metadata.file_path"), r"/log/([^/]+)/", 1))
        return rows.join(before.withColumnRenamed("next", "__from"), "source", "left").filter(
            F.col("batch_id") >= F.coalesce("__from", F.lit(0))
        )

    waiting = logged(live)
    counts = waiting.groupBy("source", "batch_id").agg(F.count(F.lit(1)).alias("n"))
    known = counts.filter(F.col("n") >= per_batch).join(before, "source", "left").select(
        "source", "batch_id", F.coalesce("next", F.lit(0).cast("bigint")).alias("next")
    )
    ranked = ranged_running(known, ["batch_id"], within=["source"])
    moved = ranked.filter(F.col("batch_id") - F.col("next") == F.col("ordinal")).groupBy("source").agg(
        (F.max("batch_id") + 1).alias("moved")
    )
    after = before.join(moved, "source", "full").select("source", F.coalesce("moved", "next").alias("next"))
    after.write.mode("overwrite").parquet(f"{folder}/frontier/{epoch}")
    after = spark.read.schema(before.schema).parquet(f"{folder}/frontier/{epoch}")

    ready = waiting.join(after, "source").filter(F.col("batch_id") < F.col("next")).select(*schema.names)
    ready.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).write.mode("overwrite").parquet(f"{folder}/released/{epoch}")
    rest = waiting.join(after, "source", "left").filter(F.col("next").isNull() | (F.col("batch_id") >= F.col("next")))
    kept = {r["name"] for r in rest.groupBy(F.col("__place").alias("name")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per folder
    live = [name for name in live if name in kept]
    if len(live) > MERGED:
        merged = f"merged-{epoch}"
        rest.select(*schema.names).write.mode("overwrite").parquet(f"{folder}/log/{merged}")
        live = [merged]
    spark.createDataFrame([(name,) for name in live], "name string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/live/{epoch}")


def release_in_order(stream: DataFrame, per_batch: int, folder: str, once: bool = False) -> StreamingQuery:
    """Release batches of a source when all members are present and all earlier ones are out.

    Rows carry ``source, batch_id, index_in_batch``; released rows are in ``released/<epoch>``,
    sorted.  A batch that never completes waits, as in the order that is asked for.
    """
    writer = stream.writeStream.foreachBatch(
        lambda df, epoch: release_step(df, epoch, per_batch, folder)
    ).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(availableNow=True) if once else writer).start()


def reward_spread(rewards: str | Column) -> Column:
    """Population deviation of an array of rewards."""
    r = F.col(rewards) if isinstance(rewards, str) else rewards
    n = F.size(r)
    mean = F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / n
    return F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)


def filter_uniform_groups(stream: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Complete groups (one row with its ``rewards``) whose rewards differ; stateless."""
    return stream.filter(reward_spread("rewards") > eps)


def staleness(stream: DataFrame, iteration: int) -> DataFrame:
    """Staleness of the oldest and newest stamp of every rollout; stateless."""
    stamps = F.flatten(
        F.transform("policy_epoch", lambda t: F.transform(t, lambda s: s["epoch"]))
    )
    return stream.withColumn("staleness", F.lit(iteration) - F.element_at(stamps, 1)).withColumn(
        "last_staleness", F.lit(iteration) - F.element_at(stamps, -1)
    )
