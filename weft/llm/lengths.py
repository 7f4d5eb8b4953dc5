"""Exact token counts: the histogram of encoded lengths and what its suffix sums answer.

A null or empty text has length 0 and counts as a document; repeated rows count each.  No document
gives an empty table, and totals of zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.arrow import stored
from weft.llm.encoding import default_path, encoded

#: Lengths per block in the two-level suffix sums.
BLOCK = 512


def encoded_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``length, documents``: counts of a task's slices, one row per length in each."""
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, bounds in encoded(batches, path, None):
            length, n = np.unique(np.diff(bounds), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(n, pa.int64())], ["length", "documents"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "length bigint, documents bigint")


def suffix_table(histogram: DataFrame) -> DataFrame:
    """Per distinct length: ``documents`` of it, ``documents_at_least`` and ``tokens_at_least`` (of
    this length or longer), ``documents_up_to``, and ``truncated_tokens``: all tokens left
    if every document is cut at this length.

    Sums run over blocks of lengths, then inside each block, so no task sees all lengths.
    """
    # read twice below, so that the documents are encoded once
    exact = stored(histogram.groupBy("length").agg(F.sum("documents").alias("documents")), "lengths")
    exact = exact.withColumn("__b", F.floor(F.col("length") / BLOCK)).withColumn("__t", F.col("length") * F.col("documents"))
    blocks = exact.groupBy("__b").agg(F.sum("documents").alias("__n"), F.sum("__t").alias("__s"))
    after = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    blocks = blocks.select(
        "__b",
        F.coalesce(F.sum("__n").over(after), F.lit(0)).alias("__n_after"),
        F.coalesce(F.sum("__s").over(after), F.lit(0)).alias("__s_after"),
        F.sum("__n").over(all_rows).alias("__all_n"),
        F.sum("__s").over(all_rows).alias("__all_s"),
    )
    here = Window.partitionBy("__b").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    at_least = F.sum("documents").over(here) + F.col("__n_after")
    tokens = F.sum("__t").over(here) + F.col("__s_after")
    table = exact.join(blocks, "__b").withColumn("documents_at_least", at_least).withColumn("tokens_at_least", tokens)
    return table.select(
        "length",
        "documents",
        "documents_at_least",
        "tokens_at_least",
        (F.col("__all_n") - F.col("documents_at_least") + F.col("documents")).alias("documents_up_to"),
        (F.col("__all_s") - F.col("tokens_at_least") + F.col("documents_at_least") * F.col("length")).alias("truncated_tokens"),
    )


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    return suffix_table(encoded_lengths(docs, path))


def totals(table: DataFrame) -> DataFrame:
    """One row: ``documents, tokens, longest``; zeros for an empty table."""
    return table.agg(
        F.coalesce(F.max("documents_at_least"), F.lit(0)).alias("documents"),
        F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("length"), F.lit(0)).alias("longest"),
    )


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the smallest length that this share of the documents doesn't exceed
    (null for an empty table)."""
    n = totals(table).select(F.col("documents").alias("__all"))
    whole = table.crossJoin(F.broadcast(n))  # one row
    return whole.agg(
        *[F.min(F.when(F.col("documents_up_to") >= F.lit(q) * F.col("__all"), F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    ).select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)])).alias("r")).select("r.*")


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, tokens, documents_cut`` for any context limits: documents below the limit keep all
    their tokens, the others ``limit`` each."""
    cut = lambda k: F.col("length") > k
    return table.agg(
        *[F.coalesce(F.sum(F.least(F.col("length"), F.lit(k)) * F.col("documents")), F.lit(0)).alias(f"t{i}") for i, k in enumerate(limits)],
        *[F.coalesce(F.max(F.when(cut(k), F.col("documents_at_least"))), F.lit(0)).alias(f"n{i}") for i, k in enumerate(limits)],
    ).select(F.explode(F.array(*[F.struct(F.lit(int(k)).alias("limit"), F.col(f"t{i}").alias("tokens"), F.col(f"n{i}").alias("documents_cut")) for i, k in enumerate(limits)])).alias("r")).select("r.*")
