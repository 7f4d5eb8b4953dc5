"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import let_go

#: Labelled rows of each class that a fit takes at most, and the bound on their characters together.
ROWS_PER_CLASS = 1_500
CHARACTERS = 6_000_000


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids belong to fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)), F.lit(-1))


@dataclass
class Sample:
    text: pa.LargeStringArray
    label: np.ndarray


def chosen_rows(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int = ROWS_PER_CLASS, characters: int = CHARACTERS
) -> DataFrame:
    """``doc_id, label, text``: whole texts with their label 0 or 1, at most ``rows`` of each class.

    The choice is by a hash of the id, the same for every partitioning; documents are taken in that
    order as long as the classes' share of ``characters`` lasts.  A text longer than what is left is passed over
    for shorter ones behind it, so one above half of ``characters`` is never learned from.  Rows that ``allowed`` (over the
    labels' ``doc_id``) excludes, null labels and null ids are left out; an id with both
    labels counts as 1.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for value in (0, 1):
        one = known.filter(F.col("label") == value).orderBy(*order).limit(rows)
        chosen = one if chosen is None else chosen.unionByName(one)
    ids = chosen.collect()  # 2 * rows at most
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r["doc_id"], r["label"]) for r in ids], "doc_id bigint, label int"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = texts.join(wanted, "doc_id")
    sizes = met.select("doc_id", "label", F.length("text").alias("n")).orderBy(*order, "n").limit(2 * rows).collect()
    left, take = {0: characters // 2, 1: characters // 2}, set()
    for r in sizes:
        if r["doc_id"] not in take and r["n"] <= left[r["label"]]:
            left[r["label"]] -= r["n"]
            take.add(r["doc_id"])
    kept = F.broadcast(spark.createDataFrame([(i,) for i in sorted(take)], "doc_id bigint"))
    return met.join(kept, "doc_id").select("doc_id", "label", "text").dropDuplicates(["doc_id"])


def as_sample(table: pa.Table) -> Sample:
    table = table.sort_by("doc_id")
    text = pa.concat_arrays([pa.array([], pa.large_string()), *table["text"].cast(pa.large_string()).chunks])
    return Sample(text, table["label"].to_numpy().astype(np.float64))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int = ROWS_PER_CLASS, characters: int = CHARACTERS) -> Sample:
    """The chosen rows here, for a look at them."""
    return as_sample(chosen_rows(docs, labels, label, allowed, rows, characters).toArrow())


def fitted(chosen: DataFrame, train: Callable[[Sample], object]) -> object:
    """The model that ``train`` makes of the chosen rows, in a task: only the model reaches the driver."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema)], schema=schema) for b in batches], schema)
        model = pickle.dumps(train(as_sample(table)))
        del table
        let_go()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    made = chosen.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train(as_sample(schema.empty_table()))
