"""Assignment of numbered samples to steps, micro-batches and workers.

Input rows carry ``i``, a dense ordinal; assignment is arithmetic on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.ordering import hashed_running, order_key, ranged_running
from weft.functions.tokens import can_narrow, narrowed, widened

# Suffixes of batch-size schedules.
UNITS = {"K": 10**3, "M": 10**6, "B": 10**9, "T": 10**12}


def assign_sequential(
    df: DataFrame, total: int, consumed: int, mbs: int, dp: int, drop_last: bool = True
) -> DataFrame:
    """(i, batch, worker): full global micro-batches from ``consumed`` on, a contiguous slice per
    worker; the ragged end goes out only when asked for."""
    wide = mbs * dp
    rows = df.filter((F.col("i") >= consumed) & (F.col("i") < total))
    rows = rows.withColumn("batch", F.expr(f"(i - {consumed}) div {wide}"))
    if drop_last:
        rows = rows.filter(F.col("batch") < (total - consumed) // wide)
    return rows.withColumn("worker", F.expr(f"(i - {consumed}) % {wide} div {mbs}"))


def assign_global(
    df: DataFrame,
    total: int,
    consumed: int,
    mbs: int,
    dp: int,
    global_batch: int,
    drop_last: bool = True,
) -> DataFrame:
    """(i, batch, micro, worker): whole global batches at a time."""
    wide = global_batch // (mbs * dp) * mbs * dp
    rows = df.filter((F.col("i") >= consumed) & (F.col("i") < total))
    rows = rows.withColumn("batch", F.expr(f"(i - {consumed}) div {wide}"))
    if drop_last:
        rows = rows.filter(F.col("batch") < (total - consumed) // wide)
    inside = f"((i - {consumed}) % {wide})"
    return rows.withColumn("micro", F.expr(f"{inside} div {mbs * dp}")).withColumn(
        "worker", F.expr(f"{inside} % {mbs * dp} div {mbs}")
    )


def assign_full_validation(df: DataFrame, dp: int) -> DataFrame:
    """(i, batch, worker): one sample per worker and batch, ragged end kept."""
    return df.withColumn("batch", F.expr(f"i div {dp}")).withColumn("worker", F.expr(f"i % {dp}"))


def assign_cyclic(
    df: DataFrame, total: int, consumed: int, mbs: int, dp: int, sharding: bool = True
) -> DataFrame:
    """(i, worker, batch): permutation seeded by the epoch that ``consumed`` lies in, inside a
    worker's bucket or global and then strided; resumes mid-epoch, incomplete batches dropped."""
    wide = mbs * dp
    epoch, done = divmod(consumed, total - total % wide)
    if done % wide:
        raise ValueError("consumed samples must be whole global micro-batches")
    keyed = df.withColumn("__k", order_key(epoch, "i"))
    if sharding:
        bucket = total // wide * mbs
        rows = keyed.filter(F.col("i") < bucket * dp).withColumn(
            "worker", F.expr(f"i div {bucket}")
        )
        rows = hashed_running(rows, "__k", within=["worker"], ties=["i"], out="__r")
        at = F.col("__r") - done // dp
        rows = rows.filter(at >= 0).withColumn("batch", F.floor(at / mbs).cast("bigint"))
        return rows.filter(F.col("batch") < (bucket - done // dp) // mbs).drop("__k", "__r")
    full = total // mbs * mbs
    rows = hashed_running(keyed.filter(F.col("i") < full), "__k", ties=["i"], out="__r")
    rows = rows.withColumn("__r", F.col("__r") - done).filter("__r >= 0")
    rows = rows.withColumn("worker", F.expr(f"__r % {dp}")).withColumn(
        "batch", F.expr(f"__r div {dp} div {mbs}")
    )
    held = F.expr(f"({full - done} - worker + {dp - 1}) div {dp}")
    return rows.filter(F.col("batch") < F.floor(held / mbs)).drop("__k", "__r")


def parse_schedule(text: str, length: int | None = None) -> list[tuple[int, int]]:
    """``'0:768 250B:1536'`` to (threshold in samples, batch size), thresholds rising from 0."""

    def number(s: str) -> int:
        s = s.strip().upper()
        return int(float(s[:-1]) * UNITS[s[-1]]) if s[-1] in UNITS else int(s)

    entries = []
    for part in text.replace(",", " ").split():
        threshold, size = part.split(":", 1)
        at = number(threshold)
        entries.append((at // length if length else at, number(size)))
    entries.sort()
    if not entries or entries[0][0] != 0 or any(b <= 0 for _, b in entries):
        raise ValueError(f"schedule {text!r} must start at 0 with positive batch sizes")
    if any(a[0] == b[0] for a, b in zip(entries, entries[1:])):
        raise ValueError(f"thresholds of {text!r} must rise strictly")
    return entries


def schedule_segments(schedule: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first sample, batch size, first step): a size starts at the first step boundary at or
    after its threshold."""
    segments = [(0, schedule[0][1], 0)]
    for threshold, size in schedule[1:]:
        start, current, step = segments[-1]
        steps = max(0, -(-(threshold - start) // current))
        segments.append((start + steps * current, size, step + steps))
    # of sizes that start at one boundary only the last applies
    return [s for s, after in zip(segments, [*segments[1:], None]) if not after or after[0] > s[0]]


def assign_steps(df: DataFrame, schedule: str, length: int | None = None) -> DataFrame:
    """(i, step, batch_size) under a batch-size schedule."""
    step, size = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for start, batch, first in schedule_segments(parse_schedule(schedule, length)):
        here = F.col("i") >= start
        step = F.when(here, F.expr(f"{first} + (i - {start}) div {batch}")).otherwise(step)
        size = F.when(here, F.lit(batch).cast("bigint")).otherwise(size)
    return df.withColumn("step", step).withColumn("batch_size", size)


def partition_of(n: int, k: int, mode: str = "ceil", ordinal: str = "i") -> Column:
    """Worker of each of n ordinals over k workers; null for the rest that ``floor`` drops.

    ``ceil``: chunks of ceil(n / k); ``linspace``: cuts at floor(j n / k); ``floor``: equal shares.
    """
    if mode == "ceil":
        return F.expr(f"{ordinal} div {max(1, -(-n // k))}")
    if mode == "linspace":
        return F.expr(f"(({ordinal} + 1) * {k} - 1) div {max(1, n)}")
    part = F.expr(f"{ordinal} div {max(1, n // k)}")
    return F.when(part < k, part)


def unpack(df: DataFrame, numbering: DataFrame | None = None) -> DataFrame:
    """(global_id, rank, row, slot, tokens) from packed (rank, row, tokens, cu_seqlens); parts of
    no length are skipped, ids run over ranks in order.

    ``numbering`` are the same rows without tokens, where they come without moving any; the ids are taken from them.
    """
    cu = F.col("cu_seqlens")
    spans = F.transform(
        F.sequence(F.lit(1), F.size(cu) - 1),
        lambda j: F.struct(
            j.alias("slot"),
            F.element_at(cu, j).alias("at"),
            (F.element_at(cu, j + 1) - F.element_at(cu, j)).alias("n"),
        ),
    )
    spans = F.filter(spans, lambda s: s["n"] > 0)
    numbered = ranged_running(
        (df if numbering is None else numbering).select("rank", "row", F.explode(F.transform(spans, lambda s: s["slot"])).alias("slot")),
        ["rank", "row", "slot"],
        out="global_id",
    )
    cut = df.select(
        "rank",
        "row",
        F.explode(
            F.transform(
                spans,
                lambda s: F.struct(
                    s["slot"].alias("slot"),
                    F.slice(F.col("tokens"), s["at"] + 1, s["n"]).alias("tokens"),
                ),
            )
        ).alias("__s"),
    ).select("rank", "row", "__s.*")
    kind = df.schema["tokens"].dataType
    if not can_narrow(kind):
        return numbered.join(cut, ["rank", "row", "slot"])
    out = numbered.join(cut.withColumn("tokens", narrowed("tokens")), ["rank", "row", "slot"])
    return out.withColumn("tokens", widened("tokens", kind))


def pad_batch(
    df: DataFrame, columns: dict[str, int | float], batch: str = "batch", limit: int | None = None
) -> DataFrame:
    """Arrays padded to the longest of their batch, per column with its own value.

    A null array becomes zeros when its batch has any array, all null or too long is an error.
    """
    sizes = df.groupBy(batch).agg(*[F.max(F.size(F.col(c))).alias(f"__{c}") for c in columns])
    out = df.join(sizes, batch)
    for c, value in columns.items():
        widest = F.lit(limit) if limit is not None else F.col(f"__{c}")
        too_long = F.size(c) > widest
        none = F.col(f"__{c}").isNull() | (F.col(f"__{c}") < 0)
        kind = df.schema[c].dataType.simpleString()
        element = kind[len("array<") : -1]
        filler = F.array_repeat(F.lit(value).cast(element), F.greatest(widest - F.size(c), F.lit(0)))
        zeros = F.array_repeat(F.lit(0).cast(element), widest)
        padded = F.when(F.col(c).isNull(), zeros).otherwise(F.concat(F.col(c), filler))
        bad = F.raise_error(F.lit(f"{c}: batch of nulls, or array above the limit")).cast(kind)
        out = out.withColumn(c, F.when(none | F.coalesce(too_long, F.lit(False)), bad).otherwise(padded))
    return out.drop(*[f"__{c}" for c in columns])


def balance_groups(df: DataFrame, workers: int, max_len: int, slack: float = 0.05) -> DataFrame:
    """(batch, step, worker, seq_id, length, width): workload-balanced steps of every batch.

    A sequence needs the next power of two of length / max_len workers and costs
    length ** 2 / width on each.  Longest first onto the least loaded aligned block of workers;
    a step closes once its loads are within ``slack``; a step that would leave workers idle
    widens its sequences.  Batches are one global batch each, so groups are bounded.
    """

    def plan(batch):
        import pandas as pd

        todo = sorted(zip(batch["length"], batch["seq_id"]), key=lambda x: (-x[0], x[1]))
        rows, step = [], 0
        while todo:
            placed, todo = _one_step(todo, workers, max_len, slack)
            for seq_id, length, first, width in placed:
                rows += [(step, w, seq_id, length, width) for w in range(first, first + width)]
            step += 1
        out = pd.DataFrame(rows, columns=["step", "worker", "seq_id", "length", "width"])
        out.insert(0, "batch", batch["batch"].iloc[0])
        return out

    return (
        df.select("batch", "seq_id", F.col("length").cast("bigint").alias("length"))
        .groupBy("batch")
        .applyInPandas(
            plan, "batch bigint, step int, worker int, seq_id bigint, length bigint, width int"
        )
    )


def _width(length: int, workers: int, max_len: int) -> int:
    need = max(1, -(-int(length) // max_len))
    return min(1 << (need - 1).bit_length(), workers)


def _one_step(todo, workers, max_len, slack):
    """Fill one step from the longest on; what does not fit the balance waits."""
    load, placed, rest = [0.0] * workers, [], []
    for at, (length, seq_id) in enumerate(todo):
        width = _width(length, workers, max_len)
        first = min(range(0, workers - width + 1, width), key=lambda b: max(load[b : b + width]))
        balanced = min(load) > 0 and max(load) - min(load) <= slack * max(load)
        if balanced and placed and width < placed[0][3]:
            rest += todo[at:]  # behind those already put off, still longest first
            break
        peak = max(load)
        after = max(load[first : first + width]) + length**2 / width
        if min(load) > 0 and after > peak * (1 + slack):
            rest.append((length, seq_id))  # would unbalance a full step
            continue
        for w in range(first, first + width):
            load[w] += length**2 / width
        placed.append((seq_id, length, first, width))
    if min(load) == 0:  # idle workers: one sequence per step takes them over, widest first
        placed, rest = _widen(placed, workers), rest
    return placed, rest


def _widen(placed, workers):
    """Spread a step that leaves workers idle: widths double while all blocks still fit."""
    blocks = sorted({(first, width) for _, _, first, width in placed})
    widths = [width for _, width in blocks]
    grew = True
    while grew and sum(widths) < workers:
        grew = False
        for i in sorted(range(len(widths)), key=lambda i: widths[i]):
            if sum(widths) + widths[i] <= workers:
                widths[i] *= 2
                grew = True
    starts, at = {}, 0
    for block, width in zip(blocks, widths):
        starts[block] = (at, width)
        at += width
    return [(s, n, *starts[(first, width)]) for s, n, first, width in placed]
