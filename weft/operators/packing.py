"""Packing of variable-length sequences into bins.

Greedy packers see lengths only, so the table is reduced to (length, count): at most one row
per distinct length reaches the driver.  The rule runs on counts and yields *runs*
(identical bins with a multiplicity), and sequences join the runs by (length, rank within
length).  Members, order and bins equal the sequential walk; no task holds a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from weft.functions.ordering import ranged_running
from weft.functions.tokens import can_narrow, narrowed, wide_lists

# piece of a plan: sequences of ``length`` ranked [first, last) go ``per_bin`` to a bin, from
# ``bin_id`` on, at ``slot`` and token ``start`` of each bin
#: Piece of a plan: ranks ``first .. last - 1`` of a length, ``per_bin`` to a bin from ``bin_id`` on.
PIECE_FIELDS = "first: bigint, last: bigint, per_bin: bigint, bin_id: bigint, slot: bigint, start: bigint"
MAX_DISTINCT_LENGTHS = 2_000_000


def true_length(tokens: str | Column, pad: int) -> Column:
    """Position of the last token that is not padding; interior padding counts."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    back = F.array_position(F.reverse(F.transform(c, lambda x: x != pad)), True)
    return F.when(back == 0, F.lit(0)).otherwise(F.size(c) - back + 1).cast("int")


def histogram(df: DataFrame, length: str = "length") -> dict[int, int]:
    """Rows per length; bounded by the number of distinct lengths."""
    rows = (
        df.groupBy(length)
        .agg(F.count(F.lit(1)).alias("n"))
        .limit(MAX_DISTINCT_LENGTHS + 1)
        .collect()
    )
    if len(rows) > MAX_DISTINCT_LENGTHS:
        raise ValueError("too many distinct lengths to plan from their histogram")
    return {int(r[length]): int(r["n"]) for r in rows}


def next_fit_runs(
    counts: dict[int, int], size: int, max_seqs: int | None, empty_first: bool = False
) -> list[tuple]:
    """Pieces of next-fit over falling lengths; ``empty_first`` counts the empty bin that an
    oversize first item leaves behind."""
    cap = max_seqs if max_seqs is not None else 1 << 62
    pieces, bin_id, used, members, opened = [], 0, 0, 0, False
    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0

        def room(have_tokens, have_members, length=length):
            if have_tokens > size:  # an oversize bin takes nothing more, not even an empty sequence
                return 0
            by_tokens = (size - have_tokens) // length if length > 0 else 1 << 62
            return max(0, min(by_tokens, cap - have_members))

        fill = min(left, room(used, members))
        if fill > 0:
            pieces.append((length, 0, fill, fill, bin_id, members, used))
            used, members, opened = used + fill * length, members + fill, True
            left, done = left - fill, fill
        if left == 0:
            continue
        bin_id += 1 if opened or empty_first else 0
        opened = True
        each = max(1, room(0, 0))
        full, rest = divmod(left, each)
        if full:
            pieces.append((length, done, done + full * each, each, bin_id, 0, 0))
            done += full * each
            bin_id += full - 1
            used, members = each * length, each
        if rest:
            bin_id += 1 if full else 0
            pieces.append((length, done, done + rest, rest, bin_id, 0, 0))
            used, members = rest * length, rest
    return pieces


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple]:
    """Pieces of repeated largest-that-fits; a pattern repeats until one of its lengths runs out."""
    if counts and max(counts) > capacity:
        raise ValueError(f"a sequence of {max(counts)} exceeds the capacity {capacity}")
    from bisect import bisect_left, bisect_right

    left, taken = dict(counts), dict.fromkeys(counts, 0)
    alive = sorted(left)
    pieces, bin_id = [], 0
    while alive:
        room, pattern, limit = capacity, [], len(alive)
        while limit:
            limit = bisect_right(alive, room, 0, limit)
            if limit == 0:
                break
            length = alive[limit - 1]
            k = left[length] if length == 0 else min(left[length], room // length)
            pattern.append((length, k))
            room -= k * length
            limit -= 1
        times = min(left[length] // k for length, k in pattern)
        slot = start = 0
        for length, k in pattern:
            first = taken[length]
            pieces.append((length, first, first + k * times, k, bin_id, slot, start))
            taken[length] += k * times
            left[length] -= k * times
            slot, start = slot + k, start + k * length
        for length, _ in pattern:  # only these can have run out
            if left[length] == 0:
                del alive[bisect_left(alive, length)]
        bin_id += times
    return pieces


def place(
    df: DataFrame, pieces: list[tuple], last_first: bool = False
) -> DataFrame:
    """(bin_id, slot, seq_id, length, start) of every sequence of (seq_id, length)."""
    order = F.col("seq_id").desc() if last_first else F.col("seq_id").asc()
    ranked = ranged_running(
        df.select("seq_id", F.col("length").cast("bigint").alias("length")),
        [order],
        within=["length"],
        out="__r",
    )
    # one row per distinct length with its pieces in order of rank, so a sequence meets one row
    of_length: dict[int, list[tuple]] = {}
    for length, *rest in sorted(pieces):
        of_length.setdefault(length, []).append(tuple(rest))
    table = df.sparkSession.createDataFrame(list(of_length.items()), f"length bigint, pieces array<struct<{PIECE_FIELDS}>>")
    hit = F.filter("pieces", lambda p: (p["first"] <= F.col("__r")) & (F.col("__r") < p["last"]))
    joined = ranked.join(table, "length").select("*", F.explode(F.slice(hit, 1, 1)).alias("__x")).select("seq_id", "length", "__r", "__x.*")
    step = F.col("__r") - F.col("first")
    inside = F.expr("(__r - first) % per_bin")
    return joined.select(
        (F.col("bin_id") + F.floor(step / F.col("per_bin"))).cast("bigint").alias("bin_id"),
        (F.col("slot") + inside).alias("slot"),
        "seq_id",
        "length",
        (F.col("start") + inside * F.col("length")).alias("start"),
    )


def pack_nfd(df: DataFrame, bin_size: int, max_seqs: int = 16) -> DataFrame:
    """Next-fit over falling lengths (ties by seq_id) with a cap on sequences per bin."""
    return place(df, next_fit_runs(histogram(df), bin_size, max_seqs))


def pack_best_fit(df: DataFrame, capacity: int) -> DataFrame:
    """Best fit; among equal lengths the highest seq_id goes first; oversize is an error."""
    return place(df, best_fit_runs(histogram(df), capacity), last_first=True)


def pack_padded(df: DataFrame, size: int, multiple: int = 64) -> DataFrame:
    """Next-fit over falling padded lengths, no cap; an oversize first item leaves bin 0 empty."""
    up = (F.ceil(F.col("length") / F.lit(multiple)) * multiple).cast("bigint")
    padded = df.select("seq_id", up.alias("length"))
    return place(padded, next_fit_runs(histogram(padded), size, None, empty_first=True))


def pack_prefix(df: DataFrame, capacity: int) -> DataFrame:
    """Samples of (seq_id, length) in order until the first that would overflow; failed samples
    (null length) are skipped."""
    good = df.filter(F.col("length").isNotNull()).select("seq_id", "length")
    walked = ranged_running(good, ["seq_id"], ["length"])
    return walked.filter(F.col("cum_length") + F.col("length") <= capacity).select(
        F.col("ordinal").alias("slot"),
        "seq_id",
        "length",
        F.col("cum_length").cast("bigint").alias("start"),
    )


def bin_lengths(bins: DataFrame, df: DataFrame) -> DataFrame:
    """(bin_id, lengths) of the bins of :func:`assemble_bins`, without moving a token.

    Sequences of one ``seq_id`` and slot come here by length, there by their tokens; the empty ones are first in both.
    """
    sized = df.select("seq_id", F.size("tokens").alias("__n"))
    grouped = bins.select("bin_id", "slot", "seq_id").join(sized, "seq_id").groupBy("bin_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", "seq_id", "__n"))).alias("__m")
    )
    return grouped.select("bin_id", F.transform("__m", lambda m: m["__n"]).alias("lengths"))


def _ordered(of: np.ndarray, members: pa.StructArray) -> pa.StructArray:
    """Members that lie by bin, slot and sequence; those alike in all three by their arrays, a missing one and a null first."""
    same = lambda name: pc.equal(members.field(name)[1:], members.field(name)[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
    tied = (of[1:] == of[:-1]) & same("slot") & same("seq_id") if len(of) > 1 else np.zeros(0, bool)
    if not tied.any():
        return members
    order, first = np.arange(len(of)), 0
    key = lambda value: (value is not None, [(x is not None, x or 0) for x in value or []])
    for last in np.flatnonzero(~np.append(tied, False)).tolist():
        if last > first:
            rows = members[first : last + 1].to_pylist()
            order[first : last + 1] = first + np.array(
                sorted(range(len(rows)), key=lambda i: [key(v) for k, v in rows[i].items() if k not in ("slot", "seq_id")])
            )
        first = last + 1
    return members.take(pa.array(order))


def _members(lists: Column, kind: ArrayType, narrow: list[str]) -> Column:
    """The members of bins with their arrays as they were before :func:`narrowed`."""

    @F.arrow_udf(kind)
    def run(lists: pa.Array) -> pa.Array:
        ends, inner = np.asarray(lists.offsets, np.int64), lists.flatten()
        fields = []
        for f in kind.elementType.fields:
            field = inner.field(f.name)
            fields.append(wide_lists(field, to_arrow_type(f.dataType.elementType)) if f.name in narrow else field)
        members = pa.StructArray.from_arrays(fields, names=kind.elementType.names)
        of = np.repeat(np.arange(len(lists)), np.diff(ends))
        return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), _ordered(of, members))

    return run(lists)


def assemble_bins(
    bins: DataFrame, df: DataFrame, bin_size: int, pad: int
) -> DataFrame:
    """Packed rows from (seq_id, tokens, generation_mask): tokens, positions, loss mask, starts.

    Groups hold at most one bin of tokens.  Sequences that come without a ``generation_mask`` give rows without a loss
    mask; what a caller has no use for is then not moved twice with the tokens.  Tokens and masks are moved in as few bytes as
    they need.
    """
    masked = ["generation_mask"] * ("generation_mask" in df.columns)
    arrays = ["tokens", *masked]
    narrow = [c for c in arrays if can_narrow(df.schema[c].dataType)]
    moved = [narrowed(c).alias(c) if c in narrow else F.col(c) for c in arrays]
    joined = bins.select("bin_id", "slot", "seq_id").join(df.select("seq_id", *moved), "seq_id")
    fields = [joined.schema[c] for c in ("slot", "seq_id")] + [df.schema[c] for c in arrays]
    kind = ArrayType(StructType(fields))
    grouped = joined.groupBy("bin_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", "seq_id", *arrays))).alias("__m")
    )
    grouped = grouped.select("bin_id", _members(F.col("__m"), kind, narrow).alias("__m"))

    def part(name):
        return F.transform("__m", lambda m: m[name])

    lengths = F.transform("__m", lambda m: F.size(m["tokens"]))
    tokens = F.flatten(part("tokens"))
    positions = F.flatten(
        F.transform(
            F.filter(lengths, lambda n: n > 0), lambda n: F.sequence(F.lit(0), n - 1)
        )
    )
    masks = [F.transform(F.flatten(part(name)), lambda g: g.cast("int")) for name in masked]

    def fill(c, value):
        return F.concat(
            c, F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(bin_size) - F.size(c)))
        )

    return grouped.select(
        "bin_id",
        part("seq_id").alias("seq_ids"),
        lengths.alias("lengths"),
        fill(tokens, pad).alias("tokens"),
        fill(positions, 0).alias("position_ids"),
        *[fill(mask, 0).alias("loss_mask") for mask in masks],
    )


def assemble_mm_bins(
    bins: DataFrame, df: DataFrame, capacity: int, multiple: int = 1, ignore: int = -100
) -> DataFrame:
    """Packed multimodal rows from (seq_id, key, tokens, labels, n_images): cumulative lengths,
    longest part, joined keys.  With ``multiple`` parts are padded, labels with the ignored id.
    A bin above the capacity is an error."""
    joined = bins.select("bin_id", "slot", "seq_id").join(df, "seq_id")
    grouped = joined.groupBy("bin_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", "key", "tokens", "labels", "n_images"))).alias(
            "__m"
        )
    )

    def up(n):
        return (F.ceil(n / F.lit(multiple)) * multiple).cast("int")

    def widen(c, value):
        return F.concat(c, F.array_repeat(F.lit(value), up(F.size(c)) - F.size(c)))

    sizes = F.transform("__m", lambda m: up(F.size(m["tokens"])))
    out = grouped.select(
        "bin_id",
        F.flatten(F.transform("__m", lambda m: widen(m["tokens"], 0))).alias("tokens"),
        F.flatten(F.transform("__m", lambda m: widen(m["labels"], ignore))).alias("labels"),
        cumulative(sizes).alias("cu_lengths"),
        F.array_max(sizes).alias("max_length"),
        F.aggregate("__m", F.lit(0).cast("bigint"), lambda a, m: a + m["n_images"]).alias(
            "n_images"
        ),
        F.array_join(F.transform("__m", lambda m: m["key"]), ",").alias("keys"),
    )
    fits = F.size("tokens") <= capacity
    return out.withColumn(
        "max_length",
        F.when(fits, F.col("max_length")).otherwise(
            F.raise_error(F.lit("packed sequence exceeds the capacity")).cast("int")
        ),
    )


def cumulative(lengths: Column) -> Column:
    """[0, l1, l1 + l2, ...] of the few lengths of a bin."""
    return F.aggregate(
        lengths,
        F.array(F.lit(0)),
        lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n),
    )


def cu_seqlens(lengths: Column, bin_size: int, max_seqs: int) -> Column:
    """Cumulative lengths closed with the bin size, repeated to ``max_seqs + 2``; null when empty."""
    sums = F.array_append(cumulative(lengths), F.lit(bin_size))
    more = F.greatest(F.lit(0), F.lit(max_seqs + 2) - F.size(sums))
    return F.when(F.size(lengths) > 0, F.concat(sums, F.array_repeat(F.lit(bin_size), more)))


def distribute_bins(bins: DataFrame, world: int, algo: str = "fifo") -> DataFrame:
    """(rank, local, bin_id) for bins numbered from 0; short ranks get empty bins (null bin_id)
    up to ceil(bins / world)."""
    n = (bins.agg(F.max("bin_id")).first()[0] or 0) + 1
    most = -(-n // world)
    slots = bins.sparkSession.range(world * most).select(
        F.expr(f"id div {most}").alias("rank"), F.expr(f"id % {most}").alias("local")
    )
    share, extra = divmod(n, world)
    if algo == "round-robin":
        bin_id = F.col("local") * world + F.col("rank")
        held = bin_id < n
    else:
        bin_id = F.col("rank") * share + F.least(F.col("rank"), F.lit(extra)) + F.col("local")
        held = F.col("local") < share + (F.col("rank") < extra).cast("int")
    return slots.select("rank", "local", F.when(held, bin_id).cast("bigint").alias("bin_id"))


def packing_stats(placed: DataFrame, ranks: DataFrame, bin_size: int) -> DataFrame:
    """Per rank and overall (rank null): bins, non-empty bins, sequences, least, most and mean per
    bin, actual and compute tokens, efficiency (empty bins included), deviation from the mean."""
    per_bin = placed.groupBy("bin_id").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("length").alias("__t")
    )
    rows = ranks.join(per_bin, "bin_id", "left")
    n = F.coalesce("__n", F.lit(0))
    rolled = rows.rollup("rank").agg(
        F.count(F.lit(1)).alias("bins"),
        F.count("__n").alias("filled"),
        F.sum(n).cast("bigint").alias("seqs"),
        F.min("__n").alias("min_per_bin"),
        F.max("__n").alias("max_per_bin"),
        F.avg("__n").alias("avg_per_bin"),
        F.coalesce(F.sum("__t"), F.lit(0)).cast("bigint").alias("actual_tokens"),
        F.countDistinct("rank").alias("__ranks"),
    )
    compute = F.col("bins") * bin_size
    total = rolled.filter("rank is null").select(
        (F.col("actual_tokens") / F.col("__ranks")).alias("__mean")
    )
    return rolled.crossJoin(F.broadcast(total)).select(  # one row
        "rank",
        "bins",
        "filled",
        "seqs",
        "min_per_bin",
        "max_per_bin",
        F.round("avg_per_bin", 6).alias("avg_per_bin"),
        "actual_tokens",
        compute.alias("compute_tokens"),
        F.round(F.col("actual_tokens") / compute, 6).alias("efficiency"),
        F.when(
            F.col("rank").isNotNull(), F.round(F.col("actual_tokens") - F.col("__mean"), 6)
        ).alias("deviation"),
    )


def step_plan(placed: DataFrame, ranks: DataFrame, ratio: float, world: int) -> DataFrame:
    """(step, bins, global_batch, seqs): ceil(ratio * bins per rank) bins of every rank per step."""
    import math

    most = ranks.agg(F.max("local")).first()[0] + 1
    per_step = math.ceil(ratio * most)
    per_bin = placed.groupBy("bin_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = ranks.join(per_bin, "bin_id", "left")
    return rows.groupBy(F.expr(f"local div {per_step}").alias("step")).agg(
        F.count(F.lit(1)).alias("bins"),
        F.lit(per_step * world).cast("bigint").alias("global_batch"),
        F.sum(F.coalesce("__n", F.lit(0))).cast("bigint").alias("seqs"),
    )
