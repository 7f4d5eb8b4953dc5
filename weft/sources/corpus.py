"""Raw text corpora: JSON lines, line files, ingest filter, merge, counts, partition."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.ordering import ranged_running
from weft.functions.text import strip
from weft.functions.tokens import byte_encode

CHAT_SCHEMA = T.StructType(
    [
        T.StructField(
            "messages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("role", T.StringType()),
                        T.StructField("content", T.StringType()),
                    ]
                )
            ),
        )
    ]
)


def read_corpus(spark: SparkSession, glob: str, keys: Sequence[str] = ("text",)) -> DataFrame:
    """JSON lines, plain or gzip, only the requested keys; nothing is inferred."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    return spark.read.schema(schema).json(glob)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``messages``; several conversations may share a line."""
    return spark.read.schema(CHAT_SCHEMA).json(path)


def read_lines_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One document per line; an empty line is an error."""
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return encode_lines(lines)


def encode_lines(lines: DataFrame) -> DataFrame:
    tokens = byte_encode("text")
    checked = F.when(
        F.size(tokens) == 0, F.raise_error(F.lit("line without tokens")).cast("array<int>")
    ).otherwise(tokens)
    return lines.withColumn("tokens", checked).withColumn("n_tokens", F.size("tokens"))


def first_by_id(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The ``n`` rows of lowest ``key``: the cut is found on keys alone, then filters the scan."""
    ranked = ranged_running(df.select(key), [key])
    cut = ranked.filter(F.col("ordinal") < n).agg(F.max(key)).first()[0]
    return df.filter(F.lit(False)) if cut is None else df.filter(F.col(key) <= F.lit(cut))


def ingest_filter(
    df: DataFrame, n: int, min_chars: int = 100, bulk: bool = False, key: str = "doc_id"
) -> DataFrame:
    """First ``n`` documents whose stripped text is longer than ``min_chars``.

    ``bulk`` looks only at the first ``n + n // 10`` rows, so it may return fewer.
    """
    long_enough = F.length(strip("text")) > min_chars
    if bulk:
        return first_by_id(first_by_id(df, n + n // 10, key).filter(long_enough), n, key)
    return first_by_id(df.filter(long_enough), n, key)


def merge_corpora(shards: dict[str, DataFrame]) -> DataFrame:
    """Shards in sorted prefix order; sequence and document ids continue over the shards.

    Every shard holds dense ``doc_id``, ``seq_id`` and ``tokens`` of one element type.
    """
    names = sorted(shards)
    kinds = {shards[name].schema["tokens"].dataType.simpleString() for name in names}
    if len(kinds) > 1:
        raise ValueError(f"token types differ: {sorted(kinds)}")
    parts = [shards[name].withColumn("shard", F.lit(i)) for i, name in enumerate(names)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    sizes = merged.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_seqs"), (F.max("doc_id") + 1).alias("n_docs")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(  # one row per shard of the argument
        "shard",
        F.coalesce(F.sum("n_seqs").over(before), F.lit(0)).alias("__s"),
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("__d"),
    )
    return (
        merged.join(F.broadcast(offsets), "shard")
        .withColumn("seq_id", F.col("seq_id") + F.col("__s"))
        .withColumn("doc_id", F.col("doc_id") + F.col("__d"))
        .drop("__s", "__d")
    )


def dataset_counts(df: DataFrame, order: str = "doc_id") -> DataFrame:
    """(sequences, documents + 1) per data set, in order of first mention."""
    per_doc = df.groupBy("dataset", "doc_id").agg(
        F.count(F.lit(1)).alias("__n"), F.min(order).alias("__o")
    )
    return (
        per_doc.groupBy("dataset")
        .agg(
            F.sum("__n").alias("n_sequences"),
            (F.count(F.lit(1)) + 1).alias("n_documents"),
            F.min("__o").alias("first_mention"),
        )
        .orderBy("first_mention", "dataset")
    )


def partition_corpus(
    df: DataFrame, k: int, sequential: bool = False, key: str = "doc_id"
) -> DataFrame:
    """(key, part): round-robin by row, or runs of ceil(rows / k) rows in order."""
    rows = ranged_running(df.select(key), [key], out="row_no")
    if not sequential:
        return rows.withColumn("part", F.pmod("row_no", F.lit(k)).cast("int")).drop("row_no")
    run = max(1, math.ceil(rows.count() / k))
    return rows.withColumn("part", F.floor(F.col("row_no") / run).cast("int")).drop("row_no")
