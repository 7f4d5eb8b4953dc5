"""Run telemetry: metric series (metric, run, step, value), golden comparison, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.ordering import group_median, previous, ranged_running

# Metrics judged by the median, or by the maximum, of a whole run.
MEDIAN_METRICS = ["iteration-time"]
MAX_METRICS = ["mem-allocated-bytes", "mem-max-allocated-bytes"]
TOLERANCE_FLOOR = 0.001


def resample(
    df: DataFrame, n: int, start: int, interval: int, order: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(metric, step, value) on the grid start, then every multiple of ``interval`` up to ``n``.

    ``by`` names further key columns, such as the run.  Values round to 5 digits, a step found in several files keeps the earliest by ``order``
    (without one, the least value), missing steps are null.
    """
    value = F.round("value", 5)
    keys = ["metric", *by]
    kept = df.groupBy(*keys, "step").agg(
        (F.min_by(value, order) if order else F.min(value)).alias("value")
    )
    steps = df.sparkSession.range(1, n + 1).select(F.col("id").alias("step"))
    grid = steps.filter(
        (F.col("step") == start) | ((F.col("step") > start) & (F.col("step") % interval == 0))
    ).crossJoin(df.select(*keys).distinct())  # the grid is steps x metric names
    return grid.join(kept, [*keys, "step"], "left").select(*keys, "step", "value")


def compare_golden(
    actual: DataFrame,
    golden: DataFrame,
    rtol: float,
    atol: float = 0.0,
    exact: bool = False,
    interval: int = 1,
    by: Sequence[str] = (),
) -> DataFrame:
    """(metric, steps, close, passed): |a - g| <= atol + rtol |g| at every golden step.

    Missing on both sides is equal, on one side not.  Tolerant tests allow
    min(max(steps // 100, 1), 50) failing steps; iteration time compares medians.
    """
    inf, keys = F.lit(float("inf")), ["metric", *by]
    g = golden.select(*keys, "step", F.coalesce("value", inf).alias("g"))
    a = actual.select(*keys, "step", F.coalesce("value", inf).alias("a"))
    stepped = g.join(a, [*keys, "step"], "left")
    median_of = F.col("metric").isin(MEDIAN_METRICS)
    slow = stepped.filter(median_of)
    medians = group_median(slow, keys, "g", "g").join(
        group_median(slow, keys, "a", "a"), keys, "left"
    )
    both = stepped.filter(~median_of).unionByName(
        medians.withColumn("step", F.lit(None).cast("bigint")).select(*keys, "step", "g", "a")
    )
    near = (F.col("a") == F.col("g")) | (
        (F.col("g") != inf)
        & (F.col("a") != inf)
        & (F.abs(F.col("a") - F.col("g")) <= atol + rtol * F.abs("g"))
    )
    summed = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(near, F.lit(False))).alias("close"),
        ((F.max("step") - F.min("step")) / F.lit(float(interval)) + 1).alias("__s"),
    )
    steps = F.coalesce(F.col("__s"), F.lit(1.0))
    allowed = F.least(F.greatest(F.floor(steps / 100), F.lit(1)), F.lit(50))
    passed = F.when(F.lit(exact) | (steps == 1), F.col("close") == F.col("n")).otherwise(
        F.col("close") / F.col("n") >= 1 - allowed / steps
    )
    return summed.select(*keys, "n", "close", passed.alias("passed"))


def validate_series(
    current: DataFrame, golden: DataFrame, rtol: float, atol: float = 1e-9, by: Sequence[str] = ()
) -> DataFrame:
    """(metric, n, mismatches, missing, extra, passed): relative test, near-zero rule, extras ignored."""
    keys = ["metric", *by]
    g = golden.select(*keys, "step", F.col("value").alias("g"), F.lit(True).alias("__g"))
    c = current.select(*keys, "step", F.col("value").alias("c"), F.lit(True).alias("__c"))
    both = g.join(c, [*keys, "step"], "full")
    zero = F.abs("g") < atol
    off = F.when((F.col("g") == 0) | zero, F.abs("c") > atol).otherwise(
        F.abs(F.col("c") - F.col("g")) / F.abs("g") > rtol
    )
    paired = F.col("__g").isNotNull() & F.col("__c").isNotNull()
    out = both.groupBy(*keys).agg(
        F.count_if(F.col("__g").isNotNull()).alias("n"),
        F.count_if(paired & off).alias("mismatches"),
        F.count_if(F.col("__c").isNull()).alias("missing"),
        F.count_if(F.col("__g").isNull()).alias("extra"),
    )
    return out.withColumn("passed", (F.col("mismatches") == 0) & (F.col("missing") == 0))


def bounded_run(
    current: DataFrame, golden: DataFrame, warmup: int, time_share: float, memory_share: float, by: Sequence[str] = ()
) -> DataFrame:
    """(metric, current, golden, passed): median time within ± share, maximum memory below + share."""

    keys = ["metric", *by]

    def reduced(df, name):
        warm = df.filter(F.col("step") > warmup)
        t = group_median(warm.filter(F.col("metric").isin(MEDIAN_METRICS)), keys, "value", name)
        m = (
            warm.filter(F.col("metric").isin(MAX_METRICS))
            .groupBy(*keys)
            .agg(F.max("value").alias(name))
        )
        return t.unionByName(m)

    both = reduced(golden, "golden").join(reduced(current, "current"), keys, "left")
    c, g = F.col("current"), F.col("golden")
    in_time = (c >= g * (1 - time_share)) & (c <= g * (1 + time_share))
    passed = F.when(F.col("metric").isin(MEDIAN_METRICS), in_time).otherwise(
        c <= g * (1 + memory_share)
    )
    return both.select(*keys, "current", "golden", F.coalesce(passed, F.lit(False)).alias("passed"))


def run_stats(df: DataFrame) -> DataFrame:
    """Across runs per metric and step: min, max, mean, sample deviation (0 for one), count."""
    return df.groupBy("metric", "step").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.coalesce(F.nullif(F.stddev_samp("value"), F.lit(float("nan"))), F.lit(0.0)).alias("std"),
        F.count("value").alias("n"),
    )


def recommend_tolerance(df: DataFrame, k: float = 3.0, start_step: int = 1) -> DataFrame:
    """(metric, relative, absolute): k times the largest deviation from the mean, floor 0.001.

    Iteration time deviates by run medians, memory by run maxima, the rest step by step; a mean
    of at most 1e-9 counts as zero and its deviation as absolute.
    """
    warm = df.filter(F.col("step") > start_step)
    medians = group_median(
        warm.filter(F.col("metric").isin(MEDIAN_METRICS)), ["metric", "run"], "value", "v"
    ).withColumn("slot", F.lit(0).cast("bigint"))
    maxima = (
        df.filter(F.col("metric").isin(MAX_METRICS) & (F.col("step") > 1))
        .groupBy("metric", "run")
        .agg(F.max("value").alias("v"))
        .withColumn("slot", F.lit(0).cast("bigint"))
    )
    steps = warm.filter(~F.col("metric").isin(MEDIAN_METRICS + MAX_METRICS)).select(
        "metric", "run", F.col("value").alias("v"), F.col("step").cast("bigint").alias("slot")
    )
    points = medians.unionByName(maxima).unionByName(steps)
    # the largest |v - mean| of a group is at its minimum or maximum: no join back to the points
    spread = points.groupBy("metric", "slot").agg(
        F.avg("v").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    away = F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo"))
    zero = F.abs("m") <= 1e-9
    out = spread.groupBy("metric").agg(
        F.max(F.when(~zero, away / F.abs("m"))).alias("r"),
        F.max(F.when(zero, F.greatest(F.abs("hi"), F.abs("lo")))).alias("a"),
    )
    floor = F.lit(TOLERANCE_FLOOR)
    return out.select(
        "metric",
        F.greatest(k * F.coalesce("r", F.lit(0.0)), floor).alias("relative"),
        (k * F.coalesce("a", F.lit(0.0))).alias("absolute"),
    )


def request_stats(df: DataFrame) -> DataFrame:
    """Per run from (run, latency, steps, prompt_logprobs, generated_logprobs): means and totals."""

    def mean_of(c):
        total = F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
        return F.when(F.size(c) > 0, total / F.size(c))

    return df.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("latency").alias("latency_mean"),
        F.sum("latency").alias("latency_total"),
        F.avg("steps").alias("steps_mean"),
        F.avg(mean_of(F.col("prompt_logprobs"))).alias("prompt_logprob"),
        F.avg(mean_of(F.col("generated_logprobs"))).alias("generated_logprob"),
    )


def regression_flags(df: DataFrame) -> DataFrame:
    """(metric, current, golden, flag) from (metric, side, i, value) with side current or golden.

    Medians without the first value; throughput in [0.9, 1.2) of golden, memory within 5 %.
    """
    sizes = df.groupBy("metric", "side").agg(F.count(F.lit(1)).alias("__n"))
    warm = df.join(sizes, ["metric", "side"]).filter((F.col("i") > 0) | (F.col("__n") == 1))
    med = group_median(warm, ["metric", "side"], "value", "m")
    wide = med.groupBy("metric").agg(
        F.max(F.when(F.col("side") == "current", F.col("m"))).alias("current"),
        F.max(F.when(F.col("side") == "golden", F.col("m"))).alias("golden"),
    )
    c, g = F.col("current"), F.col("golden")
    flag = F.when(
        F.col("metric") == "throughput",
        F.when(c < 0.9 * g, "slower").when(c >= 1.2 * g, "faster").otherwise("ok"),
    ).otherwise(F.when(c < 0.95 * g, "low").when(c > 1.05 * g, "high").otherwise("ok"))
    return wide.withColumn("flag", F.when(c.isNull() | g.isNull(), "missing").otherwise(flag))


def compare_outputs(current: DataFrame, golden: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Per request (id, tokens, logprobs, text, routing) equality; golden ids must cover current ones."""
    g = golden.select("id", *[F.col(c).alias(f"g_{c}") for c in OUTPUT_COLUMNS])
    both = current.join(g, "id", "left")
    n = F.least(F.length("text"), F.length("g_text"))
    logs = F.forall(
        F.zip_with("logprobs", "g_logprobs", lambda a, b: F.abs(a - b) <= tol), lambda ok: ok
    )
    return both.select(
        "id",
        F.col("g_tokens").isNotNull().alias("known"),
        (F.col("tokens") == F.col("g_tokens")).alias("tokens_ok"),
        ((F.size("logprobs") == F.size("g_logprobs")) & logs).alias("logprobs_ok"),
        (F.substring("text", F.lit(1), n) == F.substring("g_text", F.lit(1), n)).alias("text_ok"),
        (F.array_sort("routing") == F.array_sort("g_routing")).alias("routing_ok"),
    )


OUTPUT_COLUMNS = ["tokens", "logprobs", "text", "routing"]


def interval_log(df: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Per n iterations: mean loss over advanced ones, counts of advanced, skipped and nan.

    ``df`` (iteration, loss, skipped); nan is counted on skipped iterations only.
    """
    skipped = F.col("skipped")
    return df.groupBy(*by, F.floor((F.col("iteration") - 1) / n).cast("bigint").alias("interval")).agg(
        F.avg(F.when(~skipped, F.col("loss"))).alias("loss"),
        F.count_if(~skipped).alias("advanced"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(skipped & F.isnan("loss")).alias("nan"),
    )


def timer_rollup(df: DataFrame, mode: str = "minmax", normalizer: float = 1.0) -> DataFrame:
    """Times over ranks (name, rank, seconds), zero readings ignored: min and max, or all."""
    live = df.filter(F.col("seconds") > 0).withColumn("ms", F.col("seconds") * 1000 / normalizer)
    if mode == "all":
        return live.select("name", "rank", "ms")
    return live.groupBy("name").agg(F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def extremes(df: DataFrame) -> DataFrame:
    """Per metric of (rank, metric, value): minimum and maximum with the rank that has it."""
    return df.groupBy("metric").agg(
        F.min("value").alias("min"),
        F.min(F.struct("value", "rank"))["rank"].alias("min_rank"),
        F.max("value").alias("max"),
        F.max(F.struct(F.col("value"), (-F.col("rank")).alias("r")))["r"].alias("max_rank"),
    ).withColumn("max_rank", -F.col("max_rank"))


def stragglers(df: DataFrame, k: int, metric: str = "throughput") -> DataFrame:
    """The k slowest and k fastest ranks: (side, place, rank, value).

    Top-k keeps k rows per task before the last step.
    """
    rows = df.filter(F.col("metric") == metric).select("rank", "value")
    sides = [
        rows.orderBy(F.col("value").asc() if side == "bottom" else F.col("value").desc(), "rank")
        .limit(k)
        .withColumn("side", F.lit(side))
        for side in ("bottom", "top")
    ]
    ranked = ranged_running(
        sides[0]
        .unionByName(sides[1])
        .withColumn("__o", F.when(F.col("side") == "top", -F.col("value")).otherwise(F.col("value"))),
        ["__o", "rank"],
        within=["side"],
        out="place",
    )
    return ranked.drop("__o")


def diff_tables(a: DataFrame, b: DataFrame, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """Status per key of two tensor tables (key, dtype, values): one-sided, type, shape, value, same."""

    def sized(df, side):
        return df.select(
            "key", F.col("dtype").alias(f"{side}_dtype"), F.col("values").alias(f"{side}_values")
        )

    both = sized(a, "a").join(sized(b, "b"), "key", "full")
    x, y = F.col("a_values"), F.col("b_values")
    apart = F.size(
        F.filter(
            F.zip_with(x, y, lambda p, q: F.abs(p - q) > atol + rtol * F.abs(q)), lambda bad: bad
        )
    )
    status = (
        F.when(y.isNull(), "only_left")
        .when(x.isNull(), "only_right")
        .when(F.col("a_dtype") != F.col("b_dtype"), "type")
        .when(F.size(x) != F.size(y), "shape")
        .when(apart > 0, "value")
        .otherwise("same")
    )
    return both.select("key", status.alias("status"), F.when(status == "value", apart).alias("n_apart"))


def norm_diff(
    a: DataFrame, b: DataFrame, layers: int = 32, k: float = 4.0, c: float = 1.03, eps: float = 2.0**-7
) -> DataFrame:
    """(key, rel, bound, near_zero, passed) from (key, layer, index, value): relative Frobenius
    difference against k * c ** (layers + 1 - layer) * eps.  A table of near-zero keys only fails
    the comparison as a whole: ask for one row with near_zero false."""
    both = a.join(b.select("key", "index", F.col("value").alias("w")), ["key", "index"])
    sums = both.groupBy("key", "layer").agg(
        F.sqrt(F.sum(F.pow(F.col("value") - F.col("w"), 2))).alias("d"),
        F.sqrt(F.sum(F.pow("value", 2))).alias("na"),
        F.sqrt(F.sum(F.pow("w", 2))).alias("nb"),
    )
    near_zero = F.greatest("na", "nb") < 1e-12
    bound = k * F.pow(F.lit(c), F.greatest(layers + 1 - F.col("layer"), F.lit(0))) * eps
    rel = F.when(near_zero, F.lit(0.0)).otherwise(F.col("d") / (F.col("nb") + 1e-30))
    return sums.select(
        "key",
        rel.alias("rel"),
        bound.alias("bound"),
        near_zero.alias("near_zero"),
        (near_zero | (rel <= bound)).alias("passed"),
    )


def expert_load(df: DataFrame) -> DataFrame:
    """(layer, expert, tokens, share, imbalance) from (layer, expert, tokens) rows."""
    each = df.groupBy("layer", "expert").agg(F.sum("tokens").alias("tokens"))
    totals = each.groupBy("layer").agg(
        F.sum("tokens").alias("__t"), F.avg("tokens").alias("__a"), F.max("tokens").alias("__x")
    )
    return each.join(totals, "layer").select(
        "layer",
        "expert",
        "tokens",
        (F.col("tokens") / F.col("__t")).alias("share"),
        (F.col("__x") / F.col("__a")).alias("imbalance"),
    )


def parse_progress(lines: DataFrame) -> DataFrame:
    """(run, line_no, ts, world, event, flops, tokens) from tab-separated lines of
    (run, line_no, value)."""
    f = F.split("value", "\t")

    def field(i):
        return F.try_element_at(F.split(F.try_element_at(f, F.lit(i)), ": "), F.lit(2))

    saving = F.element_at(f, 4).isin("Saved checkpoint", "Saving async checkpoint")
    return lines.select(
        "run",
        "line_no",
        F.to_timestamp(F.element_at(f, 1), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        field(3).cast("int").alias("world"),
        F.element_at(f, 4).alias("event"),
        F.when(saving, field(8).cast("double")).alias("flops"),
        F.when(saving, field(9).cast("double")).alias("tokens"),
    )


def progress(log: DataFrame, world: int) -> DataFrame:
    """(run, start_ts, start_flops): first job after the last line of another worker count, and
    the work committed before it.

    An asynchronous save counts once it is committed, and only its latest value.
    """
    event = F.col("event")
    walked = ranged_running(
        log,
        ["line_no"],
        within=["run"],
        marks={
            "saving": event == "Saving async checkpoint",
            "saved": event == "Saved async checkpoint",
        },
    )
    restart = walked.filter(F.col("world") != world).groupBy("run").agg(F.max("ordinal").alias("__x"))
    starts = (
        walked.filter((event == "Starting job") & (F.col("world") == world))
        .join(restart, "run", "left")
        .filter(F.col("ordinal") > F.coalesce("__x", F.lit(-1)))
        .groupBy("run")
        .agg(F.min("ordinal").alias("__at"), F.min_by("ts", "ordinal").alias("start_ts"))
    )
    direct = walked.filter(event == "Saved checkpoint").select("run", "ordinal", "flops")
    commits = walked.filter(
        (event == "Saved async checkpoint")
        & (F.col("last_saving") > F.coalesce("last_saved", F.lit(-1)))
    ).select("run", "ordinal", "last_saving")
    pending = walked.filter(event == "Saving async checkpoint").select(
        "run", F.col("ordinal").alias("last_saving"), "flops"
    )
    committed = direct.unionByName(
        commits.join(pending, ["run", "last_saving"]).select("run", "ordinal", "flops")
    )
    known = (
        committed.join(starts.select("run", "__at"), "run")
        .filter(F.col("ordinal") < F.col("__at"))
        .groupBy("run")
        .agg(F.max_by("flops", "ordinal").alias("start_flops"))
    )
    return starts.join(known, "run", "left").select(
        "run", "start_ts", F.coalesce("start_flops", F.lit(0.0)).alias("start_flops")
    )


def throughput_since(log: DataFrame, world: int) -> DataFrame:
    """TFLOP/s per worker at each committed save: since the job start and since the first job."""
    event = F.col("event")
    first = progress(log, world)
    walked = ranged_running(log, ["line_no"], within=["run"], marks={"job": event == "Starting job"})
    jobs = walked.filter(event == "Starting job").select(
        "run", F.col("ordinal").alias("last_job"), F.col("ts").alias("job_ts")
    )
    saves = walked.filter(event.isin("Saved checkpoint", "Saving async checkpoint"))
    rows = saves.join(jobs, ["run", "last_job"], "left").join(first, "run")
    seconds = F.unix_timestamp("ts") - F.unix_timestamp("start_ts")
    job_seconds = F.unix_timestamp("ts") - F.unix_timestamp("job_ts")
    scale = F.lit(1e12 * world)
    return rows.filter((seconds > 0) & (F.col("world") == world)).select(
        "run",
        "line_no",
        "tokens",
        ((F.col("flops") - F.col("start_flops")) / (seconds * scale)).alias("cumulative"),
        job_seconds.alias("job_seconds"),
    )


def rank_configs(df: DataFrame) -> DataFrame:
    """(config, docs_per_s) by falling mean rate."""
    return (
        df.groupBy("config")
        .agg(F.avg("docs_per_s").alias("docs_per_s"))
        .orderBy(F.desc("docs_per_s"), "config")
    )


def run_summary(df: DataFrame, length: int) -> DataFrame:
    """Per run from cumulative counters (run, iteration, samples, seconds, phase, flops).

    Iterations, samples, tokens, average and least time per iteration by phase, throughput and
    its maximum.
    """
    walked = ranged_running(
        df.select("run", "phase", "iteration", "samples", "seconds", "flops"),
        ["iteration"],
        within=["run", "phase"],
    )
    steps = previous(walked, ["iteration", "seconds", "flops"], ["run", "phase"], "ordinal")
    did = F.col("iteration") - F.coalesce("prev_iteration", F.lit(0))
    took = F.col("seconds") - F.coalesce("prev_seconds", F.lit(0.0))
    work = F.col("flops") - F.coalesce("prev_flops", F.lit(0.0))
    return steps.groupBy("run", "phase").agg(
        F.max("iteration").alias("iterations"),
        F.max("samples").alias("samples"),
        (F.max("samples") * length).alias("tokens"),
        (F.max("seconds") / F.max("iteration")).alias("avg_iteration_s"),
        F.min(took / did).alias("min_iteration_s"),
        (F.max("flops") / F.max("seconds")).alias("throughput"),
        F.max(F.when(took > 0, work / took)).alias("max_throughput"),
    )


def stage_spans(jobs: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Per pipeline and stage: first start, last finish, span in seconds, jobs, and the first
    failed stage in the given order among jobs that may not fail."""
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    rows = jobs.withColumn("__o", place)
    spans = rows.groupBy("pipeline", "stage").agg(
        F.min("started_at").alias("first_start"),
        F.max("finished_at").alias("last_finish"),
        F.count(F.lit(1)).alias("jobs"),
    )
    failed = (
        rows.filter((F.col("status") == "failed") & ~F.col("allow_failure") & (F.col("__o") > 0))
        .groupBy("pipeline")
        .agg(F.min_by("stage", "__o").alias("failed_stage"))
    )
    return spans.join(failed, "pipeline", "left").select(
        "pipeline",
        "stage",
        "first_start",
        "last_finish",
        F.timestamp_diff("SECOND", "first_start", "last_finish").alias("span_s"),
        "jobs",
        "failed_stage",
    )
