"""Seeded orders, dense ordinals and prefix sums that never pass through one task.

Two routes, chosen by the order asked for:

* *hashed* orders (shuffles): an md5 key spreads evenly, so its leading hex digits
  cut the table in buckets of known share.  Bucket totals (at most 65,536 rows per
  group) give offsets, a window inside the bucket gives the rest.
* *ranged* orders (by id, score, ...): the narrow key table is range-partitioned,
  sorted and written to the shared folder once; partition totals give offsets.

Give ranged orders a unique last column, so that equal keys cannot pile up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import pin

BUCKET_DIGITS = 4


def order_key(seed: int | str, *cols: str | Column) -> Column:
    """md5 of ``seed|col|col...``: the same in every SQL engine and every partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(c).cast("string") for c in cols]))


def hash_uniform(seed: int | str, *cols: str | Column) -> Column:
    """Uniform double in [0, 1) from the first 12 hex digits of ``order_key``."""
    digits = F.substring(order_key(seed, *cols), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**12))


def hash_below(seed: int | str, bound: Column | int, *cols: str | Column) -> Column:
    """Integer in [0, bound) from the first 8 hex digits of ``order_key``."""
    digits = F.conv(F.substring(order_key(seed, *cols), 1, 8), 16, 10).cast("bigint")
    return F.pmod(digits, bound if isinstance(bound, Column) else F.lit(bound))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_rows(df: DataFrame, key: str = "idx") -> DataFrame:
    """Rows that cost more time than bytes, dealt by ``key``: there is a task for each shuffle partition, which a coalescing by
    bytes would fold together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def hashed_running(
    df: DataFrame,
    key: str,
    values: Sequence[str] = (),
    within: Sequence[str] = (),
    ties: Sequence[str] = (),
    out: str = "pos",
) -> DataFrame:
    """Rank by an md5 column, plus exclusive running sums ``cum_<value>``, per ``within``."""
    within, ties, values = list(within), list(ties), list(values)
    bucketed = df.withColumn("__b", F.substring(F.col(key), 1, BUCKET_DIGITS))
    totals = bucketed.groupBy(*within, "__b").agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(v).alias(f"__t_{v}") for v in values]
    )
    before = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *within,
        "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
        *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__t0_{v}") for v in values],
    )
    inside = Window.partitionBy(*within, "__b").orderBy(key, *ties)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = bucketed.withColumn("__r", F.row_number().over(inside) - 1)
    for v in values:
        ranked = ranked.withColumn(f"__c_{v}", F.coalesce(F.sum(v).over(earlier), F.lit(0)))
    joined = ranked.join(offsets, [*within, "__b"])
    joined = joined.withColumn(out, (F.col("__n0") + F.col("__r")).cast("bigint"))
    for v in values:
        joined = joined.withColumn(f"cum_{v}", F.col(f"__t0_{v}") + F.col(f"__c_{v}"))
    return joined.select(*df.columns, out, *[f"cum_{v}" for v in values])


def ranged_running(
    df: DataFrame,
    order: Sequence[str | Column],
    values: Sequence[str] = (),
    within: Sequence[str] = (),
    out: str = "ordinal",
    marks: dict[str, Column] | None = None,
) -> DataFrame:
    """Dense 0-based ordinal in ``order``, plus exclusive running sums ``cum_<value>``.

    ``marks`` names conditions; ``last_<name>`` is the ordinal of the nearest earlier row that
    fulfils one, or null.  With ``within`` everything restarts per group; a group may span
    many partitions.  Call it on narrow tables: the input is sorted and written once.
    """
    within, values, marks = list(within), list(values), marks or {}
    keys = [F.col(c) for c in within] + [_col(c) for c in order]
    laid = pin(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    # partition number in the upper bits, row number inside the partition in the lower 33
    laid = laid.withColumn("__m", F.monotonically_increasing_id())
    laid = laid.withColumn("__p", F.shiftrightunsigned("__m", 33)).withColumn(
        "__r", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    )
    for name, condition in marks.items():
        laid = laid.withColumn(f"__k_{name}", F.when(condition, F.col("__r")))
    totals = laid.groupBy("__p").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(v).alias(f"__t_{v}") for v in values],
        *[F.max(f"__k_{m}").alias(f"__x_{m}") for m in marks],
    )
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sorted table
    offsets = totals.withColumn("__n0", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(
        "__p",
        "__n0",
        *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__t0_{v}") for v in values],
        *[F.max(F.col("__n0") + F.col(f"__x_{m}")).over(before).alias(f"__x0_{m}") for m in marks],
    )
    if values or marks:
        earlier = (
            Window.partitionBy("__p").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
        )
        for v in values:
            laid = laid.withColumn(f"__c_{v}", F.coalesce(F.sum(v).over(earlier), F.lit(0)))
        for m in marks:
            laid = laid.withColumn(f"__l_{m}", F.max(f"__k_{m}").over(earlier))
    full = laid.join(F.broadcast(offsets), "__p").withColumn(
        out, (F.col("__n0") + F.col("__r")).cast("bigint")
    )
    for v in values:
        full = full.withColumn(f"cum_{v}", F.col(f"__t0_{v}") + F.col(f"__c_{v}"))
    for m in marks:
        near = F.coalesce(F.col("__n0") + F.col(f"__l_{m}"), F.col(f"__x0_{m}"))
        full = full.withColumn(f"last_{m}", near)
    cums, lasts = [f"cum_{v}" for v in values], [f"last_{m}" for m in marks]
    full = full.select(*df.columns, out, *cums, *lasts)
    if not within:
        return full
    starts = full.groupBy(*within).agg(
        F.min(out).alias("__o0"),
        *[F.min_by(c, out).alias(f"__s_{c}") for c in cums],
    )
    full = full.join(starts, within)
    return full.select(
        *df.columns,
        (F.col(out) - F.col("__o0")).alias(out),
        *[(F.col(c) - F.col(f"__s_{c}")).alias(c) for c in cums],
        *[F.when(F.col(c) >= F.col("__o0"), F.col(c) - F.col("__o0")).alias(c) for c in lasts],
    )


def previous(df: DataFrame, columns: Sequence[str], within: Sequence[str], out: str) -> DataFrame:
    """``prev_<column>`` of the row one ordinal earlier, by an equi-join that no group can skew."""
    earlier = df.select(
        *within, (F.col(out) + 1).alias(out), *[F.col(c).alias(f"prev_{c}") for c in columns]
    )
    return df.join(earlier, [*within, out], "left")


def group_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group, from the running counts of its distinct values.

    A group may be any size, and one value may fill it: equal values are counted before anything moves.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__rows"))
    ranked = ranged_running(counts, [value], ["__rows"], within=by)
    sizes = counts.groupBy(*by).agg(F.sum("__rows").alias("__all"))
    placed = ranked.join(sizes, by) if by else ranked.crossJoin(F.broadcast(sizes))  # one row

    def holds(position: Column) -> Column:
        inside = (position >= F.col("cum___rows")) & (position < F.col("cum___rows") + F.col("__rows"))
        return inside.cast("int")

    times = holds(F.floor((F.col("__all") - 1) / 2)) + holds(F.floor(F.col("__all") / 2))
    middle = placed.withColumn("__times", times).filter("__times > 0")
    return middle.groupBy(*by).agg((F.sum(F.col(value) * F.col("__times")) / 2).alias(out))
