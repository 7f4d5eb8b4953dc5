"""Queries: metric series, golden comparison and roll-ups on ``events``, ``lineitem``, ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import telemetry as G
from weft.plans.registry import query

# event types stand for metrics; purchase is the one judged by its median, signup by its maximum
METRIC = (
    "CASE event_type WHEN 'purchase' THEN 'iteration-time' WHEN 'signup' THEN 'mem-allocated-bytes' ELSE event_type END"
)
SERIES = f"""series AS (SELECT {METRIC} AS metric, user_id%4 AS run, event_id//40+1 AS step, arg_min(value, event_id) AS value FROM events GROUP BY 1,2,3)"""


def series(t):
    return (
        t.events.select(
            F.expr(METRIC).alias("metric"),
            F.expr("user_id % 4").alias("run"),
            F.expr("event_id div 40 + 1").alias("step"),
            "value",
            "event_id",
        )
        .groupBy("metric", "run", "step")
        .agg(F.min_by("value", "event_id").alias("value"))
    )


def other_runs(t):
    """The runs after the first, and the first one as the golden run of each."""
    every = series(t)
    runs = every.filter("run > 0").select("run").distinct()  # three runs
    return every.filter("run > 0"), every.filter("run = 0").drop("run").crossJoin(F.broadcast(runs))


def steps(t):
    return t.events.agg(F.max(F.expr("event_id div 40 + 1"))).first()[0]


GRID = f"""{SERIES}, top AS (SELECT max(step) AS n FROM series), gr AS (SELECT metric, s AS step FROM (SELECT DISTINCT metric FROM series), (SELECT unnest(range(1, n+1)) AS s FROM top) WHERE s=1 OR s%5=0),
  rs AS (SELECT run, gr.metric, gr.step, round(value,5) AS value FROM gr CROSS JOIN (SELECT DISTINCT run FROM series) r LEFT JOIN (SELECT * FROM series) s USING (run, metric, step))"""


@query("g1_resample", f"WITH {GRID} SELECT metric, run, step, value FROM rs")
def resample(t):
    return G.resample(series(t), steps(t), 1, 5, by=["run"])


# each run is its own golden one, disturbed by up to 8 % on some steps
@query(
    "g2_compare_golden",
    f"""WITH {GRID}, a AS (SELECT metric, run, step, CASE WHEN step%7=0 THEN value*1.08 ELSE value*1.01 END AS value FROM rs),
    b AS (SELECT metric, run, step, COALESCE(g.value,'inf'::DOUBLE) AS g, COALESCE(a.value,'inf'::DOUBLE) AS a FROM rs g JOIN a USING (metric, run, step)),
    m AS (SELECT metric, run, NULL::BIGINT AS step, median(g) AS g, median(a) AS a FROM b WHERE metric='iteration-time' GROUP BY 1,2
      UNION ALL SELECT * FROM b WHERE metric<>'iteration-time'),
    s AS (SELECT metric, run, count(*) AS n, count(*) FILTER (a=g OR (g<>'inf'::DOUBLE AND a<>'inf'::DOUBLE AND abs(a-g)<=0.05*abs(g))) AS close,
      COALESCE((max(step)-min(step))/5.0+1, 1) AS s FROM m GROUP BY 1,2)
    SELECT metric, run, n, close, CASE WHEN s=1 THEN close=n ELSE close/n::DOUBLE >= 1-least(greatest(floor(s/100),1),50)/s END AS passed FROM s""",
)
def compare_golden(t):
    golden = G.resample(series(t), steps(t), 1, 5, by=["run"])
    actual = golden.withColumn(
        "value", F.expr("CASE WHEN step%7=0 THEN value*1.08D ELSE value*1.01D END")
    )
    return G.compare_golden(actual, golden, rtol=0.05, interval=5, by=["run"])


@query(
    "g3_validate_series",
    f"""WITH {SERIES}, g AS (SELECT metric, r.run, step, value AS g FROM series s, (SELECT DISTINCT run FROM series WHERE run>0) r WHERE s.run=0), c AS (SELECT metric, run, step, value AS c FROM series WHERE run>0),
    b AS (SELECT COALESCE(g.metric,c.metric) AS metric, COALESCE(g.run,c.run) AS run, g, c FROM g FULL JOIN c ON g.metric=c.metric AND g.run=c.run AND g.step=c.step)
    SELECT metric, run, count(g) AS n, count(*) FILTER (g IS NOT NULL AND c IS NOT NULL AND abs(c-g)/abs(g)>0.5) AS mismatches,
      count(*) FILTER (c IS NULL) AS missing, count(*) FILTER (g IS NULL) AS extra,
      count(*) FILTER (g IS NOT NULL AND c IS NOT NULL AND abs(c-g)/abs(g)>0.5)=0 AND count(*) FILTER (c IS NULL)=0 AS passed FROM b GROUP BY 1,2""",
)
def validate(t):
    """Every other run beside the first."""
    current, golden = other_runs(t)
    return G.validate_series(current, golden, rtol=0.5, by=["run"])


@query(
    "g3_bounded_run",
    f"""WITH {SERIES}, w AS (SELECT * FROM series WHERE step>3 AND metric IN ('iteration-time','mem-allocated-bytes')),
    r AS (SELECT metric, run, CASE WHEN metric='iteration-time' THEN median(value) ELSE max(value) END AS v FROM w GROUP BY 1,2)
    SELECT g.metric, c.run, c.v AS current, g.v AS golden, CASE WHEN g.metric='iteration-time' THEN c.v BETWEEN g.v*0.85 AND g.v*1.15 ELSE c.v<=g.v*1.1 END AS passed
    FROM (SELECT * FROM r WHERE run=0) g JOIN (SELECT * FROM r WHERE run>0) c USING (metric)""",
)
def bounded(t):
    current, golden = other_runs(t)
    return G.bounded_run(current, golden, 3, 0.15, 0.10, by=["run"])


@query(
    "g4_run_stats",
    f"""WITH {SERIES} SELECT metric, step, min(value) AS min, max(value) AS max, round(avg(value),6) AS mean, round(COALESCE(stddev_samp(value),0),6) AS std, count(*) AS n FROM series GROUP BY 1,2""",
)
def run_stats(t):
    out = G.run_stats(series(t))
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(
    "g5_recommend_tolerance",
    f"""WITH {SERIES}, p AS (SELECT metric, run, median(value) AS v, 0::BIGINT AS slot FROM series WHERE metric='iteration-time' AND step>1 GROUP BY 1,2
      UNION ALL SELECT metric, run, max(value), 0 FROM series WHERE metric='mem-allocated-bytes' AND step>1 GROUP BY 1,2
      UNION ALL SELECT metric, run, value, step FROM series WHERE step>1 AND metric NOT IN ('iteration-time','mem-allocated-bytes')),
    q AS (SELECT metric, v, avg(v) OVER (PARTITION BY metric, slot) AS m FROM p)
    SELECT metric, round(greatest(3*max(abs(v-m)/abs(m)),0.001),6) AS relative, 0.0::DOUBLE AS absolute FROM q GROUP BY 1""",
)
def tolerance(t):
    return G.recommend_tolerance(series(t)).withColumn("relative", F.round("relative", 6))


@query(
    "g6_request_stats",
    """WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS latency, count(*) AS steps, avg(-l_discount) AS lp, avg(-l_tax) AS gl FROM lineitem GROUP BY 1)
    SELECT l_orderkey%8 AS run, count(*) AS n, round(avg(latency),4) AS latency_mean, round(sum(latency),2) AS latency_total, round(avg(steps),6) AS steps_mean,
      round(avg(lp),6) AS prompt_logprob, round(avg(gl),6) AS generated_logprob FROM l GROUP BY 1""",
)
def request_stats(t):
    reqs = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("latency"),
        F.count(F.lit(1)).alias("steps"),
        F.collect_list(-F.col("l_discount")).alias("prompt_logprobs"),
        F.collect_list(-F.col("l_tax")).alias("generated_logprobs"),
    )
    out = G.request_stats(reqs.withColumn("run", F.expr("l_orderkey % 8")))
    return out.select(
        "run", "n", F.round("latency_mean", 4).alias("latency_mean"),
        F.round("latency_total", 2).alias("latency_total"), F.round("steps_mean", 6).alias("steps_mean"),
        F.round("prompt_logprob", 6).alias("prompt_logprob"),
        F.round("generated_logprob", 6).alias("generated_logprob"),
    )


@query(
    "g7_regression_flags",
    """WITH v AS (SELECT CASE WHEN event_type IN ('view','click') THEN 'throughput' ELSE 'mem-max-allocated-bytes' END AS metric,
        CASE WHEN user_id%2=0 THEN 'golden' ELSE 'current' END AS side, event_id AS i, value FROM events),
    m AS (SELECT metric, side, median(value) AS m FROM v WHERE i>0 GROUP BY 1,2),
    w AS (SELECT metric, max(m) FILTER (side='current') AS current, max(m) FILTER (side='golden') AS golden FROM m GROUP BY 1)
    SELECT metric, current, golden, CASE WHEN metric='throughput' THEN CASE WHEN current<0.9*golden THEN 'slower' WHEN current>=1.2*golden THEN 'faster' ELSE 'ok' END
      ELSE CASE WHEN current<0.95*golden THEN 'low' WHEN current>1.05*golden THEN 'high' ELSE 'ok' END END AS flag FROM w""",
)
def regression(t):
    return G.regression_flags(
        t.events.select(
            F.expr("CASE WHEN event_type IN ('view','click') THEN 'throughput' ELSE 'mem-max-allocated-bytes' END").alias("metric"),
            F.expr("CASE WHEN user_id%2=0 THEN 'golden' ELSE 'current' END").alias("side"),
            F.col("event_id").alias("i"),
            "value",
        )
    )


@query(
    "g8_compare_outputs",
    """SELECT doc_id AS id, doc_id%9<>0 AS known, CASE WHEN doc_id%9<>0 THEN doc_id%4<>0 END AS tokens_ok,
      CASE WHEN doc_id%9<>0 THEN doc_id%5<>0 END AS logprobs_ok,
      CASE WHEN doc_id%9<>0 THEN doc_id%6<>0 OR length(text)=0 END AS text_ok, CASE WHEN doc_id%9<>0 THEN doc_id%7<>0 END AS routing_ok FROM documents""",
)
def compare_outputs(t):
    golden = t.documents.select(
        F.col("doc_id").alias("id"),
        F.expr("array(doc_id, n_chars)").alias("tokens"),
        F.expr("array(0.5D, n_chars / 7.0D)").alias("logprobs"),
        "text",
        F.expr("array(3, 1, 2)").alias("routing"),
    )
    current = golden.select(
        "id",
        F.expr("CASE WHEN id%4=0 THEN array(id) ELSE tokens END").alias("tokens"),
        F.expr("CASE WHEN id%5=0 THEN array(0.6D, logprobs[1]) ELSE array(0.5005D, logprobs[1]) END").alias("logprobs"),
        F.expr("CASE WHEN id%6=0 THEN '#' || text ELSE text || ' more' END").alias("text"),
        F.expr("CASE WHEN id%7=0 THEN array(1,2,4) ELSE array(2,3,1) END").alias("routing"),
    )
    return G.compare_outputs(current, golden.filter("id % 9 <> 0"))


LOG = "SELECT event_id+1 AS iteration, CASE WHEN event_id%50=0 THEN 'nan'::DOUBLE ELSE value END AS loss, event_type='error' OR event_id%50=0 AS skipped FROM events"


@query(
    "g9_interval_log",
    f"""WITH l AS ({LOG}) SELECT (iteration-1)//100 AS interval, round(avg(loss) FILTER (NOT skipped),6) AS loss, count(*) FILTER (NOT skipped) AS advanced,
      count(*) FILTER (skipped) AS skipped, count(*) FILTER (skipped AND isnan(loss)) AS nan FROM l GROUP BY 1""",
)
def interval_log(t):
    log = t.events.select(
        (F.col("event_id") + 1).alias("iteration"),
        F.expr("CASE WHEN event_id%50=0 THEN double('nan') ELSE value END").alias("loss"),
        F.expr("event_type='error' OR event_id%50=0").alias("skipped"),
    )
    return G.interval_log(log, 100).withColumn("loss", F.round("loss", 6))


def timers(t):
    return t.events.select(
        F.col("event_type").alias("name"),
        F.col("user_id").alias("rank"),
        F.expr("CASE WHEN event_id%4=0 THEN 0D ELSE value END").alias("seconds"),
    )


@query(
    "g10_timer_rollup",
    """SELECT event_type AS name, round(min(value*1000/10),6) AS min_ms, round(max(value*1000/10),6) AS max_ms FROM events WHERE event_id%4<>0 AND value>0 GROUP BY 1""",
)
def timer_rollup(t):
    out = G.timer_rollup(timers(t), normalizer=10.0)
    return out.select("name", F.round("min_ms", 6).alias("min_ms"), F.round("max_ms", 6).alias("max_ms"))


@query(
    "g10_timer_all",
    "SELECT event_type AS name, user_id AS rank, round(value*1000,6) AS ms FROM events WHERE event_id%4<>0 AND value>0",
)
def timer_all(t):
    return G.timer_rollup(timers(t), "all").withColumn("ms", F.round("ms", 6))


def ranks(t):
    each = t.events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 9).alias("value"))
    return each.select(
        F.col("user_id").alias("rank"),
        F.expr("CASE event_type WHEN 'view' THEN 'throughput' ELSE event_type END").alias("metric"),
        "value",
    )


RANKS = "rk AS (SELECT user_id AS rank, CASE event_type WHEN 'view' THEN 'throughput' ELSE event_type END AS metric, round(avg(value),9) AS value FROM events GROUP BY user_id, event_type)"


@query(
    "g11_extremes",
    f"""WITH {RANKS} SELECT metric, min(value) AS min, (min((value, rank)))[2] AS min_rank, max(value) AS max, -(max((value, -rank)))[2] AS max_rank FROM rk GROUP BY 1""",
)
def extremes(t):
    return G.extremes(ranks(t))


@query(
    "g11_stragglers",
    f"""WITH {RANKS}, x AS (SELECT rank, value FROM rk WHERE metric='throughput')
    SELECT * FROM (SELECT 'bottom' AS side, row_number() OVER (ORDER BY value, rank)-1 AS place, rank, value FROM x) WHERE place<5
    UNION ALL SELECT * FROM (SELECT 'top' AS side, row_number() OVER (ORDER BY value DESC, rank)-1 AS place, rank, value FROM x) WHERE place<5""",
)
def stragglers(t):
    return G.stragglers(ranks(t), 5)


@query(
    "g12_diff_tables",
    """SELECT vec_id AS key, CASE WHEN vec_id%10=1 THEN 'only_right' WHEN vec_id%10=2 THEN 'only_left' WHEN vec_id%10=3 THEN 'type'
        WHEN vec_id%10=4 THEN 'shape' WHEN vec_id%10=5 THEN 'value' ELSE 'same' END AS status,
      CASE WHEN vec_id%10=5 THEN len(list_filter(embedding, lambda x: abs(x::DOUBLE*0.001) > 1e-8 + 1e-5*abs(x::DOUBLE*1.001)))::INT END AS n_apart FROM embeddings""",
)
def diff_tables(t):
    base = t.embeddings.select(
        F.col("vec_id").alias("key"),
        F.lit("float32").alias("dtype"),
        F.col("embedding").cast("array<double>").alias("values"),
    )
    other = base.filter("key % 10 <> 2").select(
        "key",
        F.expr("CASE WHEN key%10=3 THEN 'float16' ELSE dtype END").alias("dtype"),
        F.expr(
            "CASE WHEN key%10=4 THEN slice(values,1,10) WHEN key%10=5 THEN transform(values, x -> x*1.001D) ELSE values END"
        ).alias("values"),
    )
    return G.diff_tables(base.filter("key % 10 <> 1"), other)


@query(
    "g13_norm_diff",
    """WITH x AS (SELECT vec_id%50 AS key, (vec_id%50)%32+1 AS layer, unnest(embedding)::DOUBLE AS v, vec_id FROM embeddings),
    y AS (SELECT *, CASE WHEN key%9=0 THEN 0.0 ELSE v END AS a, CASE WHEN key%9=0 THEN 0.0 ELSE v*(1+0.002*key) END AS b FROM x),
    s AS (SELECT key, layer, sqrt(sum((a-b)^2)) AS d, sqrt(sum(a^2)) AS na, sqrt(sum(b^2)) AS nb FROM y GROUP BY 1,2)
    SELECT key, round(CASE WHEN nb<1e-12 THEN 0 ELSE d/nb END,9) AS rel, round(4*pow(1.03,33-layer)/128,9) AS bound, nb<1e-12 AS near_zero,
      nb<1e-12 OR d/nb <= 4*pow(1.03,33-layer)/128 AS passed FROM s""",
)
def norm_diff(t):
    rows = t.embeddings.select(
        F.expr("vec_id % 50").alias("key"),
        F.expr("vec_id % 50 % 32 + 1").alias("layer"),
        "vec_id",
        F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "v"),
    ).select("key", "layer", F.expr("vec_id * 4096 + p").alias("index"), "v")
    a = rows.select("key", "layer", "index", F.expr("CASE WHEN key%9=0 THEN 0D ELSE v END").alias("value"))
    b = rows.select("key", "index", F.expr("CASE WHEN key%9=0 THEN 0D ELSE v*(1+0.002D*key) END").alias("value"))
    out = G.norm_diff(a, b)
    return out.withColumn("rel", F.round("rel", 9)).withColumn("bound", F.round("bound", 9))


@query(
    "g14_expert_load",
    """WITH e AS (SELECT l_suppkey%4 AS layer, l_partkey%16 AS expert, sum(l_quantity)::DOUBLE AS tokens FROM lineitem GROUP BY 1,2)
    SELECT layer, expert, tokens, round(tokens/sum(tokens) OVER (PARTITION BY layer),9) AS share,
      round(max(tokens) OVER (PARTITION BY layer)/avg(tokens) OVER (PARTITION BY layer),9) AS imbalance FROM e""",
)
def expert_load(t):
    rows = t.lineitem.select(
        F.expr("l_suppkey % 4").alias("layer"),
        F.expr("l_partkey % 16").alias("expert"),
        F.col("l_quantity").alias("tokens"),
    )
    out = G.expert_load(rows)
    return out.withColumn("share", F.round("share", 9)).withColumn("imbalance", F.round("imbalance", 9))


# one log per customer segment: orders are lines, their status and price choose the event
def progress_lines(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    event = F.expr(
        "CASE o_orderkey%5 WHEN 0 THEN 'Starting job' WHEN 1 THEN 'Saved checkpoint' WHEN 2 THEN 'Saving async checkpoint' "
        "WHEN 3 THEN 'Saved async checkpoint' ELSE 'Starting job' END"
    )
    return j.select(
        F.col("c_mktsegment").alias("run"),
        F.col("o_orderkey").alias("line_no"),
        F.concat_ws(
            "\t",
            F.date_format(F.expr("timestamp'2024-01-01' + make_dt_interval(0,0,0,o_orderkey)"), "yyyy-MM-dd HH:mm:ss"),
            F.lit("Job ID: 1"),
            F.expr("'# GPUs: ' || CASE WHEN o_orderkey%997=5 THEN 4 ELSE 8 END"),
            event,
            F.lit("Iteration: 1"),
            F.lit("Job throughput: 1.0"),
            F.lit("Cumulative throughput: 1.0"),
            F.expr("'Floating-point operations: ' || o_orderkey || 'e9'"),
            F.lit("Tokens (in billions): 0.50"),
        ).alias("value"),
    )


PLOG = """lg AS (SELECT c_mktsegment AS run, o_orderkey AS line_no, CASE WHEN o_orderkey%997=5 THEN 4 ELSE 8 END AS world, o_orderkey%5 AS ev,
    TIMESTAMP '2024-01-01' + to_seconds(o_orderkey) AS ts, o_orderkey*1e9::DOUBLE AS fl FROM orders JOIN customer ON o_custkey=c_custkey),
  st AS (SELECT run, min(line_no) AS a0 FROM lg WHERE world=8 AND ev IN (0,4) AND line_no > COALESCE((SELECT max(line_no) FROM lg l2 WHERE l2.run=lg.run AND world<>8),-1) GROUP BY 1),
  wk AS (SELECT *, max(CASE WHEN ev=2 THEN line_no END) OVER w AS ls, max(CASE WHEN ev=3 THEN line_no END) OVER w AS lc FROM lg WINDOW w AS (PARTITION BY run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  cm AS (SELECT run, line_no, fl FROM wk WHERE ev=1 UNION ALL SELECT run, line_no, ls*1e9::DOUBLE FROM wk WHERE ev=3 AND ls>COALESCE(lc,-1)),
  fs AS (SELECT st.run, st.a0, TIMESTAMP '2024-01-01' + to_seconds(st.a0) AS start_ts, COALESCE((SELECT arg_max(fl, line_no) FROM cm WHERE cm.run=st.run AND line_no<st.a0),0) AS start_flops FROM st)"""


@query("g15_progress", f"WITH {PLOG} SELECT run, start_ts, start_flops FROM fs")
def progress(t):
    return G.progress(G.parse_progress(progress_lines(t)), 8)


@query(
    "g15_throughput",
    f"""WITH {PLOG}, jb AS (SELECT *, max(CASE WHEN ev IN (0,4) THEN line_no END) OVER (PARTITION BY run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS job FROM lg)
    SELECT jb.run, line_no, 0.5::DOUBLE AS tokens, round((fl-start_flops)/((line_no-a0)*8e12)*1e6,6) AS cumulative, line_no-job AS job_seconds
    FROM jb JOIN fs USING (run) WHERE ev IN (1,2) AND world=8 AND line_no>a0""",
)
def throughput(t):
    out = G.throughput_since(G.parse_progress(progress_lines(t)), 8)
    return out.withColumn("cumulative", F.round(F.col("cumulative") * 1e6, 6))


@query(
    "g16_rank_configs",
    "SELECT l_shipdate::DATE::VARCHAR AS config, round(avg(l_quantity),9) AS docs_per_s FROM lineitem GROUP BY 1",
)
def rank_configs(t):
    rows = t.lineitem.select(
        F.to_date("l_shipdate").cast("string").alias("config"),
        F.col("l_quantity").alias("docs_per_s"),
    )
    return G.rank_configs(rows).withColumn("docs_per_s", F.round("docs_per_s", 9))


@query(
    "g17_run_summary",
    """WITH c AS (SELECT user_id%5 AS run, event_type IN ('view','click') AS tr, event_id+1 AS iteration, (event_id+1)*8 AS samples,
        (event_id+1)*0.5 + (event_id%7)*0.01 AS seconds, (event_id+1)*3.0 + event_id%3 AS flops FROM events),
    p AS (SELECT *, iteration-COALESCE(lag(iteration) OVER w,0) AS di, seconds-COALESCE(lag(seconds) OVER w,0) AS ds, flops-COALESCE(lag(flops) OVER w,0) AS df
      FROM c WINDOW w AS (PARTITION BY run, tr ORDER BY iteration))
    SELECT run, CASE WHEN tr THEN 'train' ELSE 'valid' END AS phase, max(iteration) AS iterations, max(samples) AS samples, max(samples)*64 AS tokens,
      round(max(seconds)::DOUBLE/max(iteration),6) AS avg_iteration_s, round(min(ds::DOUBLE/di),6) AS min_iteration_s,
      round(max(flops)::DOUBLE/max(seconds)::DOUBLE,6) AS throughput, round(max(CASE WHEN ds>0 THEN df::DOUBLE/ds::DOUBLE END),6) AS max_throughput FROM p GROUP BY run, tr""",
)
def run_summary(t):
    counters = t.events.select(
        F.expr("user_id % 5").alias("run"),
        F.expr("CASE WHEN event_type IN ('view','click') THEN 'train' ELSE 'valid' END").alias("phase"),
        F.expr("event_id + 1").alias("iteration"),
        F.expr("(event_id + 1) * 8").alias("samples"),
        F.expr("(event_id + 1) * 0.5D + (event_id % 7) * 0.01D").alias("seconds"),
        F.expr("(event_id + 1) * 3.0D + event_id % 3").alias("flops"),
    )
    out = G.run_summary(counters, 64)
    for c in ("avg_iteration_s", "min_iteration_s", "throughput", "max_throughput"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    "g18_stage_spans",
    """WITH j AS (SELECT o_custkey AS pipeline, CASE o_orderstatus WHEN 'F' THEN 'build' WHEN 'O' THEN 'test' ELSE 'deploy' END AS stage,
        o_orderdate AS s, o_orderdate + to_seconds((floor(o_totalprice)::BIGINT)%5000) AS f, o_orderkey%6=0 AS bad, o_orderkey%4=0 AS may FROM orders),
    x AS (SELECT pipeline, CASE min(CASE stage WHEN 'build' THEN 1 WHEN 'test' THEN 2 ELSE 3 END) WHEN 1 THEN 'build' WHEN 2 THEN 'test' ELSE 'deploy' END AS failed_stage FROM j WHERE bad AND NOT may GROUP BY 1)
    SELECT pipeline, stage, min(s) AS first_start, max(f) AS last_finish, date_diff('second', min(s), max(f)) AS span_s, count(*) AS jobs, any_value(failed_stage) AS failed_stage
    FROM j LEFT JOIN x USING (pipeline) GROUP BY 1,2""",
)
def stage_spans(t):
    jobs = t.orders.select(
        F.col("o_custkey").alias("pipeline"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'build' WHEN 'O' THEN 'test' ELSE 'deploy' END").alias("stage"),
        F.col("o_orderdate").alias("started_at"),
        F.expr("o_orderdate + make_dt_interval(0,0,0,cast(floor(o_totalprice) as bigint) % 5000)").alias("finished_at"),
        F.expr("CASE WHEN o_orderkey%6=0 THEN 'failed' ELSE 'success' END").alias("status"),
        F.expr("o_orderkey % 4 = 0").alias("allow_failure"),
    )
    return G.stage_spans(jobs, ["build", "test", "deploy"])
