"""Rollout tables of reinforcement learning: statistics, advantages, alignment, rewards.

A rollout row has ``group_id, rollout_id, env_id, problem_id, reward`` and per-turn arrays
``trajectory, generation_mask, logprobs, policy_epoch, kv_cache_epoch, num_evictions``.
Group figures come from aggregates joined back, never from a window over a whole group.
"""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.ordering import ranged_running
from weft.functions.text import col, strip, to_number

EPOCHS = "array<array<struct<pos:int,epoch:int>>>"
ROLLOUT = (
    "group_id bigint, rollout_id bigint, env_id string, problem_id string, reward double, "
    "trajectory array<array<int>>, generation_mask array<array<boolean>>, "
    f"logprobs array<array<double>>, policy_epoch {EPOCHS}, kv_cache_epoch {EPOCHS}, "
    "num_evictions array<int>"
)


def _require(ok: Column, message: str, value: Column, kind: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def trajectories(
    df: DataFrame, length: int, pad: int, eod: int, bos: int | None = None, skip_bos: bool = False
) -> DataFrame:
    """One row per turn: tokens padded to ``length``, generation mask extended with false.

    Too long turns, a missing end token on a short one, misplaced begin tokens and more than one
    generated end token are errors.
    """
    turns = df.select(
        "group_id",
        "rollout_id",
        "env_id",
        F.posexplode(F.arrays_zip("trajectory", "generation_mask", "logprobs")).alias("turn", "__t"),
    )
    t, m = F.col("__t.trajectory"), F.col("__t.generation_mask")
    n = F.size(t)
    t = _require(n <= length, "turn longer than the sequence length", t, "array<int>")
    t = _require(
        (n == length) | (F.element_at("__t.trajectory", -1) == eod),
        "short turn without end token",
        t,
        "array<int>",
    )
    if bos is not None:
        starts = F.element_at("__t.trajectory", 1) == bos
        right = (~starts if skip_bos else starts) & (
            F.coalesce(F.try_element_at("__t.trajectory", F.lit(2)) != bos, F.lit(True))
        )
        t = _require(right, "begin token out of place", t, "array<int>")
    ends = F.size(
        F.filter(
            F.zip_with("__t.trajectory", m, lambda x, g: F.coalesce(g, F.lit(False)) & (x == eod)),
            lambda hit: hit,
        )
    )
    t = _require(ends <= 1, "more than one generated end token", t, "array<int>")
    return turns.select(
        "group_id",
        "rollout_id",
        "env_id",
        "turn",
        n.alias("n"),
        F.concat(t, F.array_repeat(F.lit(pad), F.lit(length) - n)).alias("tokens"),
        F.concat(m, F.array_repeat(F.lit(False), F.lit(length) - n)).alias("generation_mask"),
        F.col("__t.logprobs").alias("logprobs"),
    )


def environment_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("env_id").agg(F.count(F.lit(1)).alias("n"))


def advantages(df: DataFrame, eps: float = 1e-4) -> DataFrame:
    """(group_id, rollout_id, turn, advantage): (reward - mean) / (eps + population deviation) of
    the group, repeated for every turn."""
    stats = df.groupBy("group_id").agg(
        F.avg("reward").alias("__m"), F.stddev_pop("reward").alias("__s")
    )
    turns = F.size("trajectory") if "trajectory" in df.columns else F.col("n_turns")
    return (
        df.select("group_id", "rollout_id", "reward", turns.alias("__n"))
        .join(stats, "group_id")
        .select(
            "group_id",
            "rollout_id",
            F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("turn"),
            ((F.col("reward") - F.col("__m")) / (F.lit(eps) + F.col("__s"))).alias("advantage"),
        )
    )


def rollout_figures(df: DataFrame) -> DataFrame:
    """Per rollout: turns, turn and trajectory lengths, first and last epochs, evictions."""

    def stamps(c):
        return F.flatten(F.transform(c, lambda t: F.transform(t, lambda s: s["epoch"])))

    policy, cache = stamps(F.col("policy_epoch")), stamps(F.col("kv_cache_epoch"))

    def checked(c, name):
        return _require(F.size(c) > 0, f"rollout without {name}", c, "array<int>")

    lens = F.transform("trajectory", lambda t: F.size(t))
    policy, cache = checked(policy, "policy epochs"), checked(cache, "cache epochs")
    return df.select(
        "group_id",
        "rollout_id",
        "env_id",
        "reward",
        F.size("trajectory").alias("n_turns"),
        lens.alias("turn_lens"),
        F.aggregate(lens, F.lit(0).cast("bigint"), lambda a, n: a + n).alias("traj_len"),
        policy.alias("policy"),
        cache.alias("cache"),
        F.transform("policy_epoch", lambda t: F.element_at(t, -1)["epoch"]).alias("completed"),
        F.aggregate("num_evictions", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("evictions"),
    )


def group_stats(df: DataFrame) -> DataFrame:
    """Per group: rewards, turn and trajectory lengths, turns, epochs, evictions, in figures that
    combine map-side."""
    r = rollout_figures(df)
    # lengths per turn as count, sum and sum of squares, so that deviations stay aggregates
    n = F.col("n_turns")
    total = F.col("traj_len")
    squares = F.aggregate(
        "turn_lens", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x.cast("bigint")
    )
    mean_turn = F.sum(total) / F.sum(n)
    spread = F.sum(squares) / F.sum(n) - mean_turn * mean_turn
    done = F.aggregate("completed", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return r.groupBy("group_id").agg(
        F.min("env_id").alias("env_id"),
        F.count(F.lit(1)).alias("n"),
        F.avg("reward").alias("reward_mean"),
        F.stddev_pop("reward").alias("reward_std"),
        F.sum(n).cast("bigint").alias("turns"),
        F.avg(n).alias("turns_mean"),
        F.min(n).alias("turns_min"),
        F.max(n).alias("turns_max"),
        mean_turn.alias("turn_len_mean"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("turn_len_std"),
        F.min(F.array_min("turn_lens")).alias("turn_len_min"),
        F.max(F.array_max("turn_lens")).alias("turn_len_max"),
        F.avg(total).alias("traj_len_mean"),
        F.stddev_pop(total).alias("traj_len_std"),
        F.min(total).alias("traj_len_min"),
        F.max(total).alias("traj_len_max"),
        F.sum(done).cast("bigint").alias("completed_sum"),
        F.sum("evictions").cast("bigint").alias("evictions"),
        F.max("evictions").alias("evictions_max"),
    )


def rollout_table(df: DataFrame, iteration: int) -> DataFrame:
    """Per rollout: reward, length, evictions, staleness of oldest and newest token."""
    r = rollout_figures(df)
    now = F.lit(iteration)
    return r.select(
        "group_id",
        "rollout_id",
        "reward",
        "traj_len",
        "evictions",
        (now - F.element_at("policy", 1)).alias("policy_staleness"),
        (now - F.element_at("cache", 1)).alias("kv_staleness"),
        (now - F.element_at("policy", -1)).alias("policy_last_staleness"),
        (now - F.element_at("cache", -1)).alias("kv_last_staleness"),
    )


def token_staleness(df: DataFrame, iteration: int) -> DataFrame:
    """(policy_staleness, kv_staleness, n): the per-stamp table, counted instead of listed."""
    pairs = rollout_figures(df).select(
        F.explode(
            F.zip_with("policy", "cache", lambda p, k: F.struct(p.alias("p"), k.alias("k")))
        ).alias("s")
    )
    return pairs.groupBy(
        (F.lit(iteration) - F.col("s.p")).alias("policy_staleness"),
        (F.lit(iteration) - F.col("s.k")).alias("kv_staleness"),
    ).agg(F.count(F.lit(1)).alias("n"))


def histogram_of(df: DataFrame, column: str, width: float) -> DataFrame:
    """Exact counts in bins of ``width``."""
    at = (F.floor(F.col(column) / width) * width).alias("bin")
    return df.groupBy(at).agg(F.count(F.lit(1)).alias("n"))


def rollout_metrics(df: DataFrame, iteration: int) -> DataFrame:
    """One row of run metrics: means of group means, extremes, share of non-zero advantages,
    staleness, completion gap, evictions."""
    g = group_stats(df)
    over_groups = g.agg(
        F.avg("turn_len_mean").alias("mean_turn_length"),
        F.avg("turn_len_std").alias("mean_turn_length_std"),
        F.max("turn_len_max").alias("max_turn_length"),
        F.min("turn_len_min").alias("min_turn_length"),
        F.avg("traj_len_mean").alias("mean_traj_length"),
        F.avg("traj_len_std").alias("mean_traj_length_std"),
        F.max("traj_len_max").alias("max_traj_length"),
        F.min("traj_len_min").alias("min_traj_length"),
        F.avg("turns_mean").alias("mean_num_turns"),
        F.max("turns_max").alias("max_num_turns"),
        F.min("turns_min").alias("min_num_turns"),
        F.avg("reward_mean").alias("mean_reward"),
        F.sum("evictions").cast("bigint").alias("total_eviction_count"),
        F.max("evictions_max").alias("max_num_evictions"),
        (F.lit(iteration) - F.sum("completed_sum") / F.sum("turns")).alias("mean_completion_gap"),
    )
    a = advantages(df).agg(
        F.avg("advantage").alias("mean_advantage"),
        F.avg((F.col("advantage") != 0).cast("double")).alias("nonzero_groups_ratio"),
    )
    names = {
        "policy_staleness": "policy_staleness",
        "kv_staleness": "kv_cache_staleness",
        "policy_last_staleness": "policy_last_token_staleness",
        "kv_last_staleness": "kv_cache_last_token_staleness",
    }
    figures = [
        f(c).alias(f"{kind}_{name}")
        for c, name in names.items()
        for kind, f in (("mean", F.avg), ("max", F.max), ("min", F.min))
    ]
    s = rollout_table(df, iteration).agg(*figures)
    return over_groups.crossJoin(a).crossJoin(s)  # one row each


def align_logprobs(old: Column, inference: Column, mask: Column) -> Column:
    """``old`` with the generated stretch replaced by inference log-probabilities.

    ``old`` has one entry less than the tokens, so the stretch starts one before the first
    generated token; what the engine did not return keeps its old value.
    """
    first = (F.array_position(mask, True) - 2).cast("int")
    room = F.size(old) - first
    n = F.greatest(F.least(F.size(inference), room), F.lit(0))
    new = F.concat(
        F.slice(old, F.lit(1), first),
        F.slice(inference, F.lit(1), n),
        F.slice(old, first + n + 1, F.size(old)),
    )
    return F.when((first < 0) | inference.isNull(), old).otherwise(new)


def align_packed(
    bins: DataFrame, placed: DataFrame, sequences: DataFrame
) -> DataFrame:
    """(bin_id, logprobs): the same for packed bins (bin_id, old) with ``placed`` (bin_id, slot,
    seq_id, start, length) and ``sequences`` (seq_id, inference, mask)."""
    rows = placed.join(sequences, "seq_id").join(bins, "bin_id")
    part = F.slice("old", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    # the entry between two sequences belongs to neither: it closes its piece unchanged
    inner = F.slice(part, F.lit(1), (F.col("length") - 1).cast("int"))
    edge = F.slice(part, F.col("length").cast("int"), F.lit(1))
    piece = F.concat(align_logprobs(inner, F.col("inference"), F.col("mask")), edge)
    joined = rows.groupBy("bin_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", piece.alias("p")))).alias("__p")
    )
    done = F.flatten(F.transform("__p", lambda s: s["p"]))
    return joined.join(bins, "bin_id").select(
        "bin_id", F.concat(done, F.slice("old", F.size(done) + 1, F.size("old"))).alias("logprobs")
    )


def logprob_stats(df: DataFrame) -> DataFrame:
    """Min, max, mean of old/inference ratio, absolute probability gap and inference probability
    over generated positions of (old, inference, mask); no row for an empty mask."""
    cells = df.select(F.explode(F.arrays_zip("old", "inference", "mask")).alias("c")).filter("c.mask")
    o, i = F.col("c.old"), F.col("c.inference")
    ratio, gap, prob = F.exp(o - i), F.abs(F.exp(o) - F.exp(i)), F.exp(i)
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, c in (("ratio", ratio), ("abs_diff", gap), ("inf_prob", prob)):
        aggs += [F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}"), F.avg(c).alias(f"mean_{name}")]
    return cells.agg(*aggs).filter("n > 0")


def packed_advantages(
    starts: Column, lengths: Column, values: Column, bin_size: int
) -> Column:
    """One advantage per packed position; log-probabilities are a token shorter, gaps are zero."""
    spans = F.arrays_zip(starts.alias("s"), lengths.alias("n"), values.alias("v"))
    filled = F.flatten(
        F.transform(
            spans,
            lambda x: F.concat(
                F.array_repeat(x["v"], F.greatest((x["n"] - 1).cast("int"), F.lit(0))),
                F.array_repeat(F.lit(0.0), F.least(x["n"], F.lit(1)).cast("int")),
            ),
        )
    )
    return F.concat(
        F.slice(filled, 1, bin_size),
        F.array_repeat(F.lit(0.0), F.greatest(F.lit(bin_size) - F.size(filled), F.lit(0))),
    )


def policy_terms(
    df: DataFrame,
    eps_lower: float,
    eps_upper: float,
    kl_beta: float,
    entropy_weight: float,
    importance_cap: float | None = None,
    use_inference: bool = False,
) -> DataFrame:
    """Per-token loss, KL, ratio, entropy and truncation flags as arrays.

    Needs array columns ``current, old, ref`` (and ``inference``) and ``advantage``, one value or
    an array per position.
    """
    adv = F.col("advantage")
    if not isinstance(df.schema["advantage"].dataType, T.ArrayType):
        adv = F.array_repeat(adv, F.size("current"))
    cells = F.arrays_zip(
        F.col("current").alias("c"),
        F.col("old").alias("o"),
        F.col("ref").alias("r"),
        F.col("inference" if use_inference else "old").alias("i"),
        adv.alias("a"),
    )
    low, high = 1 - eps_lower, 1 + eps_upper

    def term(x):
        ratio = F.exp(x["c"] - x["o"])
        clamped = F.least(F.greatest(ratio, F.lit(low)), F.lit(high))
        gap = x["r"] - x["c"]
        kl = F.exp(gap) - gap - 1
        entropy = -F.exp(x["c"]) * x["c"]
        weight = F.exp(x["o"] - x["i"]) if use_inference else F.lit(1.0)
        if use_inference and importance_cap is not None:
            weight = F.least(weight, F.lit(importance_cap))
        gain = F.least(ratio * x["a"], clamped * x["a"])
        return F.struct(
            (-weight * gain + kl_beta * kl - entropy_weight * entropy).alias("loss"),
            kl.alias("kl"),
            ratio.alias("ratio"),
            entropy.alias("entropy"),
            (ratio > high).alias("above"),
            (ratio < low).alias("below"),
        )

    out = df.withColumn("__t", F.transform(cells, term))
    for name in ("loss", "kl", "ratio", "entropy", "above", "below"):
        out = out.withColumn(name, F.col(f"__t.{name}"))
    return out.drop("__t")


def filter_uniform_groups(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Rollouts of groups whose rewards differ (population deviation above ``eps``)."""
    varied = df.groupBy("group_id").agg(F.stddev_pop("reward").alias("__s")).filter(F.col("__s") > eps)
    return df.join(varied.select("group_id"), "group_id", "left_semi")


def allocate(
    n: int, weights: dict[str, float], evaluation_only: Sequence[str] = (), remainder: bool = True
) -> dict[str, int]:
    """Integer shares of ``n``; the remainder goes to the largest fractions, first on ties."""
    live = {k: w for k, w in weights.items() if k not in evaluation_only}
    if not live:
        raise ValueError("every source is for evaluation only")
    total = sum(weights.values())
    due = {k: n * (w / total) for k, w in live.items()}
    got = {k: int(x) for k, x in due.items()}
    if remainder:
        by_fraction = sorted(live, key=lambda k: due[k] - int(due[k]), reverse=True)
        for k in by_fraction[: n - sum(got.values())]:
            got[k] += 1
    return {k: got.get(k, 0) for k in weights}


def mix_groups(
    groups: DataFrame, weights: dict[str, float], n: int, evaluation_only: Sequence[str] = ()
) -> DataFrame:
    """(i, source, k): rounds in which every source gives its slots, until all are exhausted.

    ``groups`` (source, k) numbers the groups of every source from 0.  A source whose share is
    below one slot gives one group per round; a source without a weight is an error.
    """
    share = allocate(n, weights, evaluation_only)
    base = allocate(n, weights, evaluation_only, remainder=False)
    step = math.gcd(*base.values()) or 1
    table = groups.sparkSession.createDataFrame(
        [(s, i, share[s], max(1, base[s] // step)) for i, s in enumerate(weights)],
        "source string, place int, share bigint, slots bigint",
    )
    rows = groups.select("source", "k").join(F.broadcast(table), "source", "left")  # a row per source
    unknown = F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("source", F.lit("null")))).cast("bigint")
    rows = rows.withColumn("share", F.coalesce("share", unknown)).filter(F.col("k") < F.col("share")).withColumn("round", F.expr("k div slots"))
    return ranged_running(rows, ["round", "place", "k"], out="i").select("i", "source", "k")


def pass_at_k(
    df: DataFrame, ks: Sequence[int] | None = None, max_k: int | None = None
) -> DataFrame:
    """Per problem of (problem_id, reward, greedy): unbiased pass@k, greedy reward.

    1 - C(n - c, k) / C(n, k) as k factors; only a reward of exactly 1 counts; a k above the
    number of samples is an error.
    """
    ks = list(ks or [1, max_k])
    sampled = ~F.col("greedy")
    per = df.groupBy("problem_id").agg(
        F.count_if(sampled).alias("n"),
        F.count_if(sampled & (F.col("reward") == 1.0)).alias("c"),
        F.max(F.when(F.col("greedy"), F.col("reward"))).alias("greedy_reward"),
    )
    n, c = F.col("n"), F.col("c")

    def estimate(k):
        miss = F.aggregate(
            F.sequence(F.lit(0), F.lit(k - 1)),
            F.lit(1.0),
            lambda acc, j: acc * ((n - c - j).cast("double") / (n - j)),
        )
        value = F.when(n - c < k, F.lit(1.0)).otherwise(1.0 - miss)
        return _require(n >= k, "k above the number of samples", value, "double")

    return per.select("problem_id", "n", "c", *[estimate(k).alias(f"pass_at_{k}") for k in ks], "greedy_reward")


def eval_means(df: DataFrame) -> DataFrame:
    """Mean per environment and metric over all workers."""
    return df.groupBy("env_id", "metric").agg(
        F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")
    )


# Answer notations of mathematical and number-game responses.
ANSWER_TAG = r"(?s)<answer>(.*?)</answer>"
ANSWER_LINE = r"<answer>(.*?)</answer>"
BOXED = r"(?s)\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"


def equal_text(answer: Column, gold: Column) -> Column:
    """Default equality: the same number, or the same text without blanks and dollar signs."""

    def bare(c):
        return F.regexp_replace(c, r"[\s$]", "")

    x, y = to_number(bare(answer)), to_number(bare(gold))
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-9).otherwise(
        bare(answer) == bare(gold)
    )


def math_reward(
    response: Column,
    gold: Column,
    finish_reason: Column,
    partial: float = 0.1,
    format_reward: float = 0.05,
    negative: float = -0.5,
    equal: Callable[[Column, Column], Column] = equal_text,
) -> Column:
    """1, partial, format or negative reward by the last tagged, else last boxed answer.

    ``equal`` may be any column function, a pandas UDF for symbolic equality included.
    """

    def judged(pattern):
        found = F.regexp_extract_all(response, F.lit(pattern), F.lit(1))
        whole = F.regexp_extract_all(response, F.lit(pattern), F.lit(0))
        final = strip(F.try_element_at(found, F.lit(-1)))
        last = F.try_element_at(whole, F.lit(-1))
        at = F.length(response) - F.instr(F.reverse(response), F.reverse(last)) + 1
        after = strip(F.substring(response, at + 1, F.length(response)))
        stopped = finish_reason != "length"
        right = (
            F.when(stopped & (after == ""), F.lit(1.0))
            .when(stopped, F.lit(partial))
            .otherwise(F.lit(format_reward))
        )
        return F.when(equal(final, gold), right).otherwise(F.lit(format_reward))

    return (
        F.when(response.rlike(ANSWER_TAG), judged(ANSWER_TAG))
        .when(response.rlike(BOXED), judged(BOXED))
        .otherwise(F.lit(negative))
    )


#: Bits of the largest whole power that is worked out; a larger one has no value as a double anyway.
POWER_BITS = 4096


def _power(a, b):
    """``a ** b``; whole numbers too large for a double raise, as a double of them would."""
    if isinstance(a, int) and isinstance(b, int) and b > 1 and abs(a) > 1 and b * abs(a).bit_length() > POWER_BITS:
        raise OverflowError("power beyond a double")
    return a**b


_OPERATORS = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv,
    ast.Pow: lambda a, b: _power(a, b),
    ast.USub: operator.neg,
    ast.UAdd: operator.pos,
}


def _value(node):
    if isinstance(node, ast.Expression):
        return _value(node.body)
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return node.value
    if isinstance(node, ast.BinOp):
        return _OPERATORS[type(node.op)](_value(node.left), _value(node.right))
    if isinstance(node, ast.UnaryOp):
        return _OPERATORS[type(node.op)](_value(node.operand))
    raise ValueError("not arithmetic")


def _number(text: str) -> float | None:
    try:
        return float(_value(ast.parse(text.strip(), mode="eval")))
    except Exception:  # noqa: BLE001 - any unreadable expression has no value
        return None


def arithmetic(text: Column) -> Column:
    """Value of an expression of numbers, operators and parentheses; null when there is none."""

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(_number, na_action="ignore").astype("float64")

    return run(text)


def countdown_reward(
    response: Column, target: Column, nums: Column, format_score: float = 0.1, score: float = 1.0
) -> Column:
    """0 without an answer on the last line, ``score`` when it uses exactly the given numbers and
    hits the target within 1e-5, else ``format_score``."""
    line = F.element_at(F.split(response, "\n"), -1)
    found = F.regexp_extract_all(line, F.lit(ANSWER_LINE), F.lit(1))
    equation = strip(F.try_element_at(found, F.lit(-1)))
    used = F.array_sort(
        F.transform(
            F.regexp_extract_all(equation, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("bigint")
        )
    )
    honest = used == F.array_sort(nums.cast("array<bigint>"))
    plain = equation.rlike(r"^[\d+\-*/().\s]+$")
    value = arithmetic(F.when(plain, equation))
    hit = F.abs(value - target) < 1e-5
    return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(
        F.when(honest & F.coalesce(hit, F.lit(False)), F.lit(score)).otherwise(F.lit(format_score))
    )


def example_groups(df: DataFrame) -> DataFrame:
    """(env_id, group_id): the first group of every environment."""
    return df.groupBy("env_id").agg(F.min("group_id").alias("group_id"))


def order_groups(df: DataFrame) -> DataFrame:
    """(i, group_id, problem_id) in order of problem id, a missing one first."""
    groups = df.groupBy("group_id").agg(F.min("problem_id").alias("problem_id"))
    keyed = groups.withColumn("__p", F.coalesce("problem_id", F.lit("")))
    return ranged_running(keyed, ["__p", "group_id"], out="i").select("i", "group_id", "problem_id")


def head_tail_split(df: DataFrame, n_train: int, n_test: int, key: str) -> DataFrame:
    """(key, split): the first rows for training, the last ones for testing."""
    walked = ranged_running(df.select(key), [key])
    total = walked.agg(F.count(F.lit(1)).alias("__n"))
    split = F.when(F.col("ordinal") < n_train, "train").when(
        F.col("ordinal") >= F.col("__n") - n_test, "test"
    )
    return (
        walked.crossJoin(F.broadcast(total))  # one row
        .select(key, split.alias("split"))
        .filter("split is not null")
    )


def rl_throughput(df: DataFrame, length: int, world: int) -> DataFrame:
    """Per iteration of (iteration, seconds, batch, rank_bins, bin_size, actual_tokens, n_seqs):
    nominal, compute and actual tokens per second, per worker, efficiency, mean length."""
    per = df.groupBy("iteration").agg(
        F.max("seconds").alias("s"),
        F.sum("batch").alias("b"),
        F.sum(F.col("rank_bins") * F.col("bin_size")).alias("compute"),
        F.sum("actual_tokens").alias("actual"),
        F.sum("n_seqs").alias("n_seqs"),
    )
    s = F.col("s")
    nominal, compute, actual = F.col("b") * length / s, F.col("compute") / s, F.col("actual") / s
    return per.select(
        "iteration",
        nominal.alias("tokens_per_s"),
        (nominal / world).alias("tokens_per_s_worker"),
        compute.alias("compute_per_s"),
        (compute / world).alias("compute_per_s_worker"),
        actual.alias("actual_per_s"),
        (actual / world).alias("actual_per_s_worker"),
        (F.col("actual") / F.col("compute")).alias("efficiency"),
        (F.col("actual") / F.col("n_seqs")).alias("mean_length"),
    )


def environment_table(spark, configs: list[dict]) -> DataFrame:
    """(env, agent, args, weight, evaluation_only) from configuration entries; weights are shares."""
    total = sum(float(c["weight"]) for c in configs)
    rows = [
        (
            c["env"],
            c["agent"],
            {k: str(v) for k, v in c.get("args", {}).items()},
            float(c["weight"]) / total,
            bool(c.get("evaluation_only", False)),
        )
        for c in configs
    ]
    return spark.createDataFrame(
        rows,
        "env string, agent string, args map<string,string>, weight double, evaluation_only boolean",
    )
