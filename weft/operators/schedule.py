"""The greedy largest-deficit schedule of a blend, in parallel blocks of steps.

At step i the source with the greatest ``weight * max(i, 1) - taken`` is taken, the first of equal ones.
The counts stay close to weight x i and forget where they came from: a walk that starts a
few rounds earlier from rounded counts soon runs along the true one.  So each block of steps guesses its start by such a run-up,
all blocks walk at once, and a block whose start differs from its predecessor's end walks again from that end until none
differs.  The result is the serial schedule whatever the guesses; a wrong guess only costs another walk of its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import pin

#: Steps of a block, and of its run-up for each source; a block has many times more steps than its run-up.
BLOCK_STEPS = 1 << 18
RUN_UP = 64
#: Rows that leave a task together.
BATCH = 1 << 16
STATE = "block bigint, start array<bigint>, end array<bigint>"


def block_steps(sources: int) -> int:
    return max(BLOCK_STEPS, 16 * RUN_UP * sources)


def walk(shares: np.ndarray, limits: np.ndarray | None, taken: np.ndarray, first: int, last: int) -> np.ndarray:
    """Sources of the steps ``first .. last - 1``; ``taken`` moves along."""
    out = np.empty(last - first, dtype=np.int32)
    full = None if limits is None else taken >= limits
    for i in range(first, last):
        short = shares * float(max(i, 1)) - taken
        if full is not None:
            short[full] = -np.inf
        d = int(short.argmax())
        out[i - first] = d
        taken[d] += 1
        if full is not None and taken[d] >= limits[d]:
            full[d] = True
    return out


def rounded(shares: np.ndarray, limits: np.ndarray | None, step: int) -> np.ndarray:
    """Whole counts near ``shares * step`` that add up to ``step``."""
    due = shares * float(step)
    taken = np.floor(due).astype(np.int64)
    short = step - int(taken.sum())
    if short > 0:
        taken[np.argsort(taken - due, kind="stable")[:short]] += 1
    return taken if limits is None else np.minimum(taken, limits)


def states(spark: SparkSession, weights: list[float], size: int, limits: list[int] | None = None) -> DataFrame:
    """``block, start, end``: what each source has given before and after each block of steps."""
    shares, most = np.array(weights, dtype=np.float64), None if limits is None else np.array(limits, dtype=np.int64)
    sources, steps = len(weights), block_steps(len(weights))
    blocks = -(-size // steps)

    def guess(block: int) -> np.ndarray:
        first = block * steps
        before = max(0, first - RUN_UP * sources)
        taken = rounded(shares, most, before)
        walk(shares, most, taken, before, first)
        return taken

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("start").to_pylist() if "start" in batch.schema.names else [None] * batch.num_rows
            for block, start in zip(batch.column("block").to_pylist(), starts):
                taken = guess(block) if start is None else np.array(start, dtype=np.int64)
                first = taken.tolist()
                walk(shares, most, taken, block * steps, min(size, (block + 1) * steps))
                yield pa.RecordBatch.from_pylist([{"block": block, "start": first, "end": taken.tolist()}], schema=_STATE)

    tasks = max(1, min(blocks, 10_000))
    every = spark.range(0, max(blocks, 0), 1, tasks).withColumnRenamed("id", "block")
    known = pin(every.mapInArrow(walked, STATE))
    while blocks > 1:
        before = known.select((F.col("block") + 1).alias("block"), F.col("end").alias("__e"))
        wrong = pin(known.join(before, "block").filter("start <> __e").select("block", F.col("__e").alias("start")))
        if wrong.isEmpty():
            break
        again = wrong.repartition(tasks, "block").mapInArrow(walked, STATE)
        known = pin(known.join(wrong.select("block"), "block", "left_anti").unionByName(again))
    return known


_STATE = pa.schema([("block", pa.int64()), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64()))])


def schedule(known: DataFrame, weights: list[float], size: int, limits: list[int] | None = None) -> DataFrame:
    """``i, dataset_id, k`` of every step, from the blocks' starts."""
    shares, most = np.array(weights, dtype=np.float64), None if limits is None else np.array(limits, dtype=np.int64)
    steps = block_steps(len(weights))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, start in zip(batch.column("block").to_pylist(), batch.column("start").to_pylist()):
                taken = np.array(start, dtype=np.int64)
                for at in range(block * steps, min(size, (block + 1) * steps), BATCH):
                    before = taken.copy()
                    source = walk(shares, most, taken, at, min(size, at + BATCH, (block + 1) * steps))
                    # how often the source came before in this batch
                    order = np.argsort(source, kind="stable")
                    value, first, n = np.unique(source[order], return_index=True, return_counts=True)
                    rank = np.empty(len(source), dtype=np.int64)
                    rank[order] = np.arange(len(source)) - np.repeat(first, n)
                    columns = [pa.array(np.arange(at, at + len(source))), pa.array(source), pa.array(before[source] + rank)]
                    yield pa.RecordBatch.from_arrays(columns, ["i", "dataset_id", "k"])

    tasks = max(1, min(-(-size // steps), 10_000))
    starts = known.select("block", "start")
    return (starts.repartition(tasks, "block") if tasks > 1 else starts).mapInArrow(emit, "i bigint, dataset_id int, k bigint")


def given(known: DataFrame, names: list[str]) -> DataFrame:
    """``dataset, asked``: what the whole schedule takes of every source."""
    last = known.orderBy(F.desc("block")).limit(1).select(F.posexplode("end").alias("dataset_id", "asked"))
    table = known.sparkSession.createDataFrame(list(enumerate(names)), "dataset_id int, dataset string")
    return table.join(last, "dataset_id").select("dataset", "asked")
