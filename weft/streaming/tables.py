"""Streams into tables: corpus encoding with a running rate, and the interval log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.functions.ordering import ranged_running
from weft.operators.encode import encode
from weft.operators.telemetry import interval_log


def _start(stream: DataFrame, step: Callable, folder: str, mode: str, once: bool) -> StreamingQuery:
    writer = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(step)
        .option("checkpointLocation", f"{folder}/progress")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def encode_stream(
    stream: DataFrame, folder: str, eod: int | None = 256, key: str = "doc_id", once: bool = False
) -> StreamingQuery:
    """Encode documents per micro-batch, in key order inside it, with one rate row per batch."""

    def step(df: DataFrame, epoch: int) -> None:
        coded = encode(df, eod=eod)
        out = f"{folder}/tokens/epoch={epoch}"
        coded.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(out)
        done = df.sparkSession.read.parquet(out)
        done.agg(
            F.count(F.lit(1)).alias("docs"),
            F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
            F.current_timestamp().alias("at"),
        ).write.mode("overwrite").parquet(f"{folder}/rate/epoch={epoch}")

    return _start(stream, step, folder, "append", once)


def running_rate(spark: SparkSession, folder: str) -> DataFrame:
    """(epoch, docs, bytes, at, total_docs) of an encoding stream, one row per micro-batch."""
    rate = spark.read.parquet(f"{folder}/rate")
    summed = ranged_running(rate.select("epoch", "docs", "bytes", "at"), ["epoch"], ["docs"], out="__i")
    return summed.select("epoch", "docs", "bytes", "at", (F.col("cum_docs") + F.col("docs")).alias("total_docs"))


def interval_log_stream(
    stream: DataFrame, n: int, folder: str, once: bool = False
) -> StreamingQuery:
    """Interval log in update mode: changed intervals of every micro-batch."""

    def step(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/intervals/epoch={epoch}")

    return _start(interval_log(stream, n), step, folder, "update", once)


def latest_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The newest figures of every interval."""
    rows = spark.read.parquet(f"{folder}/intervals")
    figures = [c for c in rows.columns if c not in ("interval", "epoch")]
    last = F.max_by(F.struct(*figures), "epoch")
    return rows.groupBy("interval").agg(last.alias("r")).select("interval", "r.*")
