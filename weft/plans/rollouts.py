"""Queries: rollout tables derived from ``events`` (group = user, reward from value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import rollouts as R
from weft.plans.registry import digest, query

LENGTH, PAD, EOD, BOS, NOW = 12, 0, 2, 1, 10


def rollouts(t):
    """Every event is a rollout of one to three turns; lengths, tokens, masks and epochs follow
    from its id."""
    return t.events.selectExpr(
        "user_id AS group_id",
        "event_id AS rollout_id",
        "event_type AS env_id",
        "CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'p' || (user_id % 40) END AS problem_id",
        "CASE WHEN user_id % 9 = 0 THEN 1D ELSE floor(value / 20) * 1D END AS reward",
        "transform(sequence(0, cast(event_id % 3 as int)), t -> transform(sequence(0, cast(2 + (event_id + t) % 6 as int)), "
        "j -> CASE WHEN j = 0 THEN 1 WHEN j = 2 + (event_id + t) % 6 THEN 2 ELSE cast(10 + (event_id * 7 + t * 3 + j) % 90 as int) END)) AS trajectory",
        "transform(sequence(0, cast(event_id % 3 as int)), t -> transform(sequence(0, cast(2 + (event_id + t) % 6 as int)), j -> j >= 2)) AS generation_mask",
        "transform(sequence(0, cast(event_id % 3 as int)), t -> transform(sequence(2, cast(2 + (event_id + t) % 6 as int)), j -> -0.1D * ((event_id + j) % 10 + 1))) AS logprobs",
        "transform(sequence(0, cast(event_id % 3 as int)), t -> array(named_struct('pos', 0, 'epoch', cast(event_id % 5 as int)), named_struct('pos', 2, 'epoch', cast(event_id % 5 + t % 2 as int)))) AS policy_epoch",
        "transform(sequence(0, cast(event_id % 3 as int)), t -> array(named_struct('pos', 0, 'epoch', cast(event_id % 4 as int)), named_struct('pos', 2, 'epoch', cast(event_id % 4 + 1 as int)))) AS kv_cache_epoch",
        "transform(sequence(0, cast(event_id % 3 as int)), t -> cast((event_id + t) % 3 = 0 as int)) AS num_evictions",
    )


RO = """ro AS (SELECT user_id AS group_id, event_id AS rollout_id, event_type AS env_id,
    CASE WHEN user_id%10=0 THEN NULL ELSE 'p'||(user_id%40) END AS problem_id,
    CASE WHEN user_id%9=0 THEN 1::DOUBLE ELSE floor(value/20)::DOUBLE END AS reward, event_id%3+1 AS nt FROM events),
  tn AS (SELECT *, unnest(range(nt)) AS turn FROM ro), tl AS (SELECT *, 3+(rollout_id+turn)%6 AS n FROM tn)"""


@query(
    "e1_trajectories",
    f"""WITH {RO}, tk AS (SELECT *, list_transform(range({LENGTH}), lambda j: CASE WHEN j=0 THEN 1 WHEN j=n-1 THEN 2 WHEN j>=n THEN 0 ELSE 10+(rollout_id*7+turn*3+j)%90 END) AS k FROM tl)
    SELECT group_id, rollout_id, env_id, turn::INT AS turn, n::INT AS n, md5(array_to_string(k,' ')) AS tokens, greatest(n-2,0)::INT AS generated FROM tk""",
)
def trajectories(t):
    rows = R.trajectories(rollouts(t), LENGTH, PAD, EOD, BOS)
    return rows.select(
        "group_id", "rollout_id", "env_id", "turn", "n",
        digest("tokens").alias("tokens"),
        F.size(F.filter("generation_mask", lambda g: g)).alias("generated"),
    )


@query("e1_environment_counts", f"WITH {RO} SELECT env_id, count(*) AS n FROM ro GROUP BY 1")
def environment_counts(t):
    return R.environment_counts(rollouts(t))


@query(
    "e2_advantages",
    f"""WITH {RO}, s AS (SELECT group_id, avg(reward) AS m, stddev_pop(reward) AS s FROM ro GROUP BY 1)
    SELECT group_id, rollout_id, turn::INT AS turn, round((reward-m)/(1e-4+s),6)+0.0 AS advantage FROM tn JOIN s USING (group_id)""",
)
def advantages(t):
    return R.advantages(rollouts(t)).withColumn("advantage", F.round("advantage", 6) + F.lit(0.0))


GS = f"""WITH {RO}, rr AS (SELECT group_id, rollout_id, any_value(reward) AS reward, any_value(nt) AS nt, sum(n)::BIGINT AS tj, min(n) AS mn, max(n) AS mx,
    sum(((rollout_id+turn)%3=0)::INT)::BIGINT AS ev, sum(rollout_id%5+turn%2)::BIGINT AS ce, min(env_id) AS env_id FROM tl GROUP BY 1,2),
  tg AS (SELECT group_id, avg(n) AS tm, stddev_pop(n) AS ts FROM tl GROUP BY 1),
  gs AS (SELECT group_id, min(env_id) AS env_id, count(*) AS n, avg(reward) AS reward_mean, stddev_pop(reward) AS reward_std, sum(nt)::BIGINT AS turns, avg(nt) AS turns_mean,
    min(nt)::INT AS turns_min, max(nt)::INT AS turns_max, any_value(tm) AS turn_len_mean, any_value(ts) AS turn_len_std, min(mn)::INT AS turn_len_min, max(mx)::INT AS turn_len_max,
    avg(tj) AS traj_len_mean, stddev_pop(tj) AS traj_len_std, min(tj) AS traj_len_min, max(tj) AS traj_len_max, sum(ce)::BIGINT AS completed_sum, sum(ev)::BIGINT AS evictions, max(ev) AS evictions_max
    FROM rr JOIN tg USING (group_id) GROUP BY 1)"""
ROUNDED = ["reward_mean", "reward_std", "turns_mean", "turn_len_mean", "turn_len_std", "traj_len_mean", "traj_len_std"]


@query(
    "e3_group_stats",
    f"{GS} SELECT * REPLACE ({', '.join(f'round({c},6) AS {c}' for c in ROUNDED)}) FROM gs",
)
def group_stats(t):
    out = R.group_stats(rollouts(t))
    for c in ROUNDED:
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    "e4_rollout_metrics",
    f"""{GS}, a AS (SELECT avg((reward-reward_mean)/(1e-4+reward_std)) AS x, avg((reward-reward_mean<>0)::INT) AS nz FROM tn JOIN gs USING (group_id)),
    st AS (SELECT 10-rollout_id%5 AS p, 10-rollout_id%4 AS k, 10-(rollout_id%5+(nt-1)%2) AS pl, 10-(rollout_id%4+1) AS kl FROM ro),
    s AS (SELECT avg(p) AS ap, max(p) AS xp, min(p) AS np, avg(k) AS ak, max(k) AS xk, min(k) AS nk, avg(pl) AS apl, max(pl) AS xpl, min(pl) AS npl, avg(kl) AS akl, max(kl) AS xkl, min(kl) AS nkl FROM st),
    g AS (SELECT avg(turn_len_mean) AS a1, avg(turn_len_std) AS a2, max(turn_len_max) AS a3, min(turn_len_min) AS a4, avg(traj_len_mean) AS a5, avg(traj_len_std) AS a6, max(traj_len_max) AS a7, min(traj_len_min) AS a8,
      avg(turns_mean) AS a9, max(turns_max) AS a10, min(turns_min) AS a11, avg(reward_mean) AS a12, sum(evictions)::BIGINT AS a13, max(evictions_max) AS a14, 10-sum(completed_sum)/sum(turns)::DOUBLE AS a15 FROM gs)
    SELECT round(a1,5) AS mean_turn_length, round(a2,5) AS mean_turn_length_std, a3 AS max_turn_length, a4 AS min_turn_length, round(a5,5) AS mean_traj_length, round(a6,5) AS mean_traj_length_std,
      a7 AS max_traj_length, a8 AS min_traj_length, round(a9,5) AS mean_num_turns, a10 AS max_num_turns, a11 AS min_num_turns, round(a12,5) AS mean_reward, a13 AS total_eviction_count, a14 AS max_num_evictions,
      round(a15,5) AS mean_completion_gap, round(abs(x),5) AS mean_advantage, round(nz,5) AS nonzero_groups_ratio, round(ap,5) AS mean_policy_staleness, xp::INT AS max_policy_staleness, np::INT AS min_policy_staleness,
      round(ak,5) AS mean_kv_cache_staleness, xk::INT AS max_kv_cache_staleness, nk::INT AS min_kv_cache_staleness, round(apl,5) AS mean_policy_last_token_staleness, xpl::INT AS max_policy_last_token_staleness, npl::INT AS min_policy_last_token_staleness,
      round(akl,5) AS mean_kv_cache_last_token_staleness, xkl::INT AS max_kv_cache_last_token_staleness, nkl::INT AS min_kv_cache_last_token_staleness FROM g, a, s""",
)
def rollout_metrics(t):
    out = R.rollout_metrics(rollouts(t), NOW)
    out = out.withColumn("mean_advantage", F.abs("mean_advantage"))  # zero up to rounding
    for f in out.schema.fields:
        if f.dataType.simpleString() == "double":
            out = out.withColumn(f.name, F.round(f.name, 5))
    return out


@query(
    "e4_token_staleness",
    f"""WITH {RO}, u AS (SELECT 10-rollout_id%5 AS p, 10-rollout_id%4 AS k FROM tn UNION ALL SELECT 10-(rollout_id%5+turn%2), 10-(rollout_id%4+1) FROM tn)
    SELECT p::INT AS policy_staleness, k::INT AS kv_staleness, count(*) AS n FROM u GROUP BY 1,2""",
)
def token_staleness(t):
    return R.token_staleness(rollouts(t), NOW)


@query("e4_reward_histogram", f"WITH {RO} SELECT (floor(reward/2.0)*2.0)::DOUBLE AS bin, count(*) AS n FROM ro GROUP BY 1")
def reward_histogram(t):
    return R.histogram_of(rollouts(t), "reward", 2.0)


def scored_turns(t):
    """Turns with training log-probabilities one entry shorter than the padded tokens."""
    rows = R.trajectories(rollouts(t), LENGTH, PAD, EOD, BOS)
    return rows.withColumn(
        "old",
        F.expr(f"transform(sequence(0, {LENGTH - 2}), j -> -0.05D * ((rollout_id * 3 + turn + j) % 20 + 1))"),
    ).withColumnRenamed("logprobs", "inf")


ALIGN = f"""WITH {RO}, al AS (SELECT group_id, rollout_id, turn, n, list_transform(range({LENGTH - 1}), lambda j: CASE WHEN j>=1 AND j<n-1 THEN -0.1::DOUBLE*((rollout_id+j+1)%10+1) ELSE -0.05::DOUBLE*((rollout_id*3+turn+j)%20+1) END) AS v,
  list_transform(range({LENGTH - 1}), lambda j: -0.05::DOUBLE*((rollout_id*3+turn+j)%20+1)) AS o FROM tl)"""


@query(
    "e5_align_logprobs",
    f"{ALIGN} SELECT rollout_id, turn::INT AS turn, array_to_string(list_transform(v, lambda x: round(x*1000)::BIGINT),' ') AS logprobs FROM al",
)
def align_logprobs(t):
    out = scored_turns(t).withColumn(
        "a", R.align_logprobs(F.col("old"), F.col("inf"), F.col("generation_mask"))
    )
    ints = F.transform("a", lambda x: F.round(x * 1000).cast("bigint").cast("string"))
    return out.select("rollout_id", "turn", F.array_join(ints, " ").alias("logprobs"))


def turn_bins(t):
    """Bins of one rollout each: its turns side by side, unpadded."""
    rows = scored_turns(t)
    placed = rows.withColumn("seq_id", F.col("rollout_id") * 4 + F.col("turn"))
    starts = F.expr("CASE turn WHEN 0 THEN 0 WHEN 1 THEN 3+rollout_id%6 ELSE 6+rollout_id%6+(rollout_id+1)%6 END")
    return placed.select(
        F.col("rollout_id").alias("bin_id"),
        F.col("turn").alias("slot"),
        "seq_id",
        starts.cast("bigint").alias("start"),
        F.col("n").cast("bigint").alias("length"),
        F.col("inf").alias("inference"),
        F.slice("generation_mask", F.lit(1), F.col("n")).alias("mask"),
    )


@query(
    "e5_align_packed",
    f"""WITH {RO}, st AS (SELECT *, sum(n) OVER (PARTITION BY rollout_id ORDER BY turn) - n AS s FROM tl),
    c AS (SELECT rollout_id, s+j AS p, CASE WHEN j>=1 AND j<n-1 THEN -100*((rollout_id+j+1)%10+1) ELSE -50*((rollout_id+s+j)%20+1) END AS v FROM (SELECT *, unnest(range(n)) AS j FROM st) WHERE s+j<23)
    SELECT rollout_id AS bin_id, string_agg(v::BIGINT::VARCHAR,' ' ORDER BY p) AS logprobs FROM (SELECT * FROM c UNION ALL
      SELECT rollout_id, p, -50*((rollout_id+p)%20+1) FROM (SELECT rollout_id, unnest(range(sum(n)::BIGINT, 23)) AS p FROM st GROUP BY 1)) GROUP BY 1""",
)
def align_packed(t):
    rows = turn_bins(t)
    bins = t.events.select(
        F.col("event_id").alias("bin_id"),
        F.expr("transform(sequence(0, 22), j -> -0.05D * ((event_id + j) % 20 + 1))").alias("old"),
    )
    out = R.align_packed(
        bins,
        rows.select("bin_id", "slot", "seq_id", "start", "length"),
        rows.select("seq_id", "inference", "mask"),
    )
    ints = F.transform("logprobs", lambda x: F.round(x * 1000).cast("bigint").cast("string"))
    return out.select("bin_id", F.array_join(ints, " ").alias("logprobs"))


@query(
    "e6_logprob_stats",
    f"""{ALIGN}, c AS (SELECT unnest(range({LENGTH - 1})) AS j, n, unnest(v) AS i, unnest(o) AS o FROM al), m AS (SELECT exp(o-i) AS r, abs(exp(o)-exp(i)) AS d, exp(i) AS p FROM c WHERE j>=1 AND j<n-1)
    SELECT count(*) AS n, round(min(r),6) AS min_ratio, round(max(r),6) AS max_ratio, round(avg(r),6) AS mean_ratio, round(min(d),6) AS min_abs_diff, round(max(d),6) AS max_abs_diff, round(avg(d),6) AS mean_abs_diff,
      round(min(p),6) AS min_inf_prob, round(max(p),6) AS max_inf_prob, round(avg(p),6) AS mean_inf_prob FROM m""",
)
def logprob_stats(t):
    rows = scored_turns(t).select(
        "old",
        R.align_logprobs(F.col("old"), F.col("inf"), F.col("generation_mask")).alias("inference"),
        F.slice("generation_mask", 2, LENGTH).alias("mask"),
    )
    out = R.logprob_stats(rows)
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@query(
    "e7_policy_terms",
    """WITH c AS (SELECT event_id, unnest(range(6)) AS j, (event_id%7-3)/2.0::DOUBLE AS a FROM events),
    v AS (SELECT *, -0.1::DOUBLE*((event_id+j)%9+1) AS c, -0.1::DOUBLE*((event_id*2+j)%9+1) AS o, -0.1::DOUBLE*((event_id+j*2)%9+1) AS r, -0.1::DOUBLE*((event_id+j*3)%9+1) AS i FROM c),
    t AS (SELECT *, exp(c-o) AS ra, least(greatest(exp(c-o),0.8),1.3) AS cl, exp(r-c)-(r-c)-1 AS kl, -exp(c)*c AS en, least(exp(o-i),1.5) AS w FROM v)
    SELECT event_id, round(sum(-w*least(ra*a,cl*a)+0.1*kl-0.01*en),5) AS loss, round(sum(kl),5) AS kl, round(sum(ra),5) AS ratio, round(sum(en),5) AS entropy,
      count(*) FILTER (ra>1.3) AS above, count(*) FILTER (ra<0.8) AS below FROM t GROUP BY 1""",
)
def policy_terms(t):
    def arr(f):
        return f"transform(sequence(0,5), j -> -0.1D * (({f}) % 9 + 1))"

    rows = t.events.selectExpr(
        "event_id", f"{arr('event_id+j')} AS current", f"{arr('event_id*2+j')} AS old",
        f"{arr('event_id+j*2')} AS ref", f"{arr('event_id+j*3')} AS inference",
        "(event_id % 7 - 3) / 2.0D AS advantage",
    )
    out = R.policy_terms(rows, 0.2, 0.3, 0.1, 0.01, importance_cap=1.5, use_inference=True)

    def total(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 5).alias(c)

    return out.select(
        "event_id", total("loss"), total("kl"), total("ratio"), total("entropy"),
        F.size(F.filter("above", lambda x: x)).cast("bigint").alias("above"),
        F.size(F.filter("below", lambda x: x)).cast("bigint").alias("below"),
    )


@query(
    "e8_filter_uniform_groups",
    f"WITH {RO} SELECT group_id, rollout_id, reward FROM ro WHERE group_id IN (SELECT group_id FROM ro GROUP BY 1 HAVING stddev_pop(reward)>1e-6)",
)
def filter_uniform(t):
    return R.filter_uniform_groups(rollouts(t).select("group_id", "rollout_id", "reward"))


@query(
    "e10_mix_groups",
    """WITH k AS (SELECT event_type AS source, row_number() OVER (PARTITION BY event_type ORDER BY event_id)-1 AS k FROM events),
    n AS (SELECT count(*)//2 AS n FROM events), w AS (SELECT * FROM (VALUES ('click',0,0.3),('error',1,0.25),('purchase',2,0.2),('view',3,0.15),('signup',4,0.1)) v(source, place, w)),
    b AS (SELECT source, place, floor(n*w::DOUBLE)::BIGINT AS base, n*w::DOUBLE - floor(n*w::DOUBLE) AS fr, n FROM w, n),
    a AS (SELECT *, base + (row_number() OVER (ORDER BY fr DESC, place) <= n - sum(base) OVER ())::INT AS share FROM b),
    g AS (SELECT list_reduce(list(base), lambda x, y: gcd(x,y)) AS g FROM a)
    SELECT row_number() OVER (ORDER BY k // greatest(1, base//g), place, k)-1 AS i, source, k FROM k JOIN a USING (source), g WHERE k<share""",
)
def mix_groups(t):
    from weft.functions.ordering import ranged_running

    groups = ranged_running(
        t.events.select(F.col("event_type").alias("source"), "event_id"), ["event_id"], within=["source"], out="k"
    )
    weights = {"click": 0.3, "error": 0.25, "purchase": 0.2, "view": 0.15, "signup": 0.1}
    return R.mix_groups(groups, weights, t.events.count() // 2)


@query(
    "e11_pass_at_k",
    """WITH s AS (SELECT user_id AS problem_id, (value<15)::INT::DOUBLE AS reward, event_type='signup' AS greedy FROM events),
    p AS (SELECT problem_id, count(*) FILTER (NOT greedy) AS n, count(*) FILTER (NOT greedy AND reward=1) AS c, max(reward) FILTER (greedy) AS g FROM s GROUP BY 1)
    SELECT problem_id, n, c, round(CASE WHEN n-c<1 THEN 1.0 ELSE c/n::DOUBLE END,9) AS pass_at_1,
      round(CASE WHEN n-c<4 THEN 1.0 ELSE 1-COALESCE(list_product(list_transform(range(n-c+1,n+1), lambda x: 1-4.0::DOUBLE/x)),1) END,9) AS pass_at_4, g AS greedy_reward FROM p""",
)
def pass_at_k(t):
    samples = t.events.selectExpr(
        "user_id AS problem_id", "double(int(value < 15)) AS reward", "event_type = 'signup' AS greedy"
    )
    out = R.pass_at_k(samples, max_k=4)
    return out.withColumn("pass_at_1", F.round("pass_at_1", 9)).withColumn("pass_at_4", F.round("pass_at_4", 9))


@query(
    "e12_eval_means",
    "SELECT event_type AS env_id, 'm'||(user_id%3) AS metric, round(avg(value),6) AS mean, count(*) AS n FROM events GROUP BY 1,2",
)
def eval_means(t):
    rows = t.events.selectExpr("event_type AS env_id", "'m' || (user_id % 3) AS metric", "value")
    return R.eval_means(rows).withColumn("mean", F.round("mean", 6))


@query(
    "u2_reward_function",
    """SELECT doc_id, (CASE WHEN doc_id%3=0 THEN CASE WHEN doc_id%2=0 THEN 0.05 ELSE 1.0 END WHEN doc_id%3=1 THEN 0.05 ELSE -0.5 END)::DOUBLE AS reward FROM documents""",
)
def reward_function(t):
    """The caller's own equality: lengths of the whole texts that differ by one at most are equal."""
    near = lambda a, b: F.abs(a.cast("bigint") - b.cast("bigint")) <= 1
    head = "replace(replace(text, '<', ' '), chr(92), ' ')"
    said = F.expr(
        f"CASE doc_id % 3 WHEN 0 THEN {head} || '<answer>' || (n_chars + 1) || '</answer>' WHEN 1 THEN {head} || '<answer>' || (n_chars + 2) || '</answer>' ELSE {head} END"
    )
    reason = F.expr("CASE WHEN doc_id % 2 = 0 THEN 'length' ELSE 'stop' END")
    return t.documents.select("doc_id", R.math_reward(said, F.col("n_chars").cast("string"), reason, equal=near).alias("reward"))


@query(
    "u3_environments",
    """WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), s AS (SELECT *, n/(sum(n) OVER ())::DOUBLE AS weight FROM n)
    SELECT event_type AS env, 'agent.'||event_type AS agent, round(weight,9) AS weight, event_type='error' AS evaluation_only, n::VARCHAR AS events, n AS rollouts FROM s""",
)
def environments(t):
    """An environment for every type of event, weighted by how many there are, met with its rollouts."""
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("event_type").collect()  # a row per type
    configs = [
        {"env": r["event_type"], "agent": f"agent.{r['event_type']}", "args": {"events": r["n"]}, "weight": r["n"], "evaluation_only": r["event_type"] == "error"}
        for r in counts
    ]
    table = R.environment_table(t.spark, configs)
    held = t.events.groupBy(F.col("event_type").alias("env")).agg(F.count(F.lit(1)).alias("rollouts"))
    return held.join(F.broadcast(table), "env").select("env", "agent", F.round("weight", 9).alias("weight"), "evaluation_only", F.col("args")["events"].alias("events"), "rollouts")


@query(
    "e13_math_reward",
    """SELECT doc_id, (CASE doc_id%7 WHEN 0 THEN CASE WHEN doc_id%3=0 THEN 0.05 ELSE 1.0 END WHEN 1 THEN CASE WHEN doc_id%3=0 THEN 0.05 ELSE 0.1 END WHEN 2 THEN 0.05
      WHEN 3 THEN CASE WHEN doc_id%3=0 THEN 0.05 ELSE 1.0 END WHEN 4 THEN 0.05 WHEN 5 THEN -0.5 ELSE CASE WHEN doc_id%3=0 THEN 0.05 ELSE 1.0 END END)::DOUBLE AS reward FROM documents""",
)
def math_reward(t):
    head = "replace(replace(text, '<', ' '), chr(92), ' ') || '\\n'"
    response = F.expr(
        f"CASE doc_id % 7 WHEN 0 THEN {head} || '<answer> ' || n_chars || ' </answer>  ' WHEN 1 THEN {head} || '<answer>' || n_chars || '</answer> more' "
        f"WHEN 2 THEN {head} || '<answer>wrong</answer>' WHEN 3 THEN {head} || chr(92) || 'boxed{{' || n_chars || '}}' "
        f"WHEN 4 THEN {head} || chr(92) || 'boxed{{a{{b}}}}' WHEN 5 THEN {head} "
        f"ELSE '<answer>1x</answer>' || {head} || '<answer>' || n_chars || '.0</answer>' END"
    )
    reason = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'length' ELSE 'stop' END")
    return t.documents.select(
        "doc_id", R.math_reward(response, F.col("n_chars").cast("string"), reason).alias("reward")
    )


@query(
    "e14_countdown_reward",
    """SELECT event_id, (CASE event_id%6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.1 WHEN 2 THEN 0 WHEN 3 THEN 0.1 WHEN 4 THEN 0.1 ELSE 0 END)::DOUBLE AS reward FROM events""",
)
def countdown_reward(t):
    a, b, c = "(event_id % 50 + 3)", "(user_id % 20 + 2)", "(event_id % 3 + 2)"
    response = F.expr(
        f"CASE event_id % 6 WHEN 0 THEN 'so\\n<answer>1</answer><answer> (' || {a} || ' + ' || {b} || ') * ' || {c} || ' </answer>' "
        f"WHEN 1 THEN '<answer>' || {a} || ' + ' || {b} || ' - ' || {c} || '</answer>' WHEN 2 THEN 'no answer' "
        f"WHEN 3 THEN '<answer>' || ({a} + {b}) * {c} || ' * 1</answer>' WHEN 4 THEN '<answer>' || {a} || '+' || {b} || '*' || {c} || 'x</answer>' "
        f"ELSE '<answer>(' || {a} || '+' || {b} || ')*' || {c} || '</answer>\\nbye' END"
    )
    return t.events.select(
        "event_id",
        R.countdown_reward(response, F.expr(f"({a} + {b}) * {c}"), F.expr(f"array({a}, {b}, {c})")).alias("reward"),
    )


@query("e15_example_groups", f"WITH {RO} SELECT env_id, min(group_id) AS group_id FROM ro GROUP BY 1")
def example_groups(t):
    return R.example_groups(rollouts(t))


@query(
    "e16_order_groups",
    f"WITH {RO}, g AS (SELECT group_id, min(problem_id) AS problem_id FROM ro GROUP BY 1) SELECT row_number() OVER (ORDER BY COALESCE(problem_id,''), group_id)-1 AS i, group_id, problem_id FROM g",
)
def order_groups(t):
    return R.order_groups(rollouts(t))


@query(
    "e17_head_tail_split",
    "SELECT doc_id, split FROM (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id)<=300 THEN 'train' WHEN row_number() OVER (ORDER BY doc_id)>count(*) OVER ()-100 THEN 'test' END AS split FROM documents) WHERE split IS NOT NULL",
)
def head_tail(t):
    return R.head_tail_split(t.documents, 300, 100, "doc_id")


@query(
    "e18_rl_throughput",
    """WITH p AS (SELECT event_id//100 AS iteration, max(value)+1 AS s, sum(1+event_id%4) AS b, sum((1+event_id%3)*512) AS cm, sum(100+event_id%200) AS ac, sum(2+event_id%2) AS ns FROM events GROUP BY 1)
    SELECT iteration, round(b*256/s,4) AS tokens_per_s, round(b*256/s/8,4) AS tokens_per_s_worker, round(cm/s,4) AS compute_per_s, round(cm/s/8,4) AS compute_per_s_worker,
      round(ac/s,4) AS actual_per_s, round(ac/s/8,4) AS actual_per_s_worker, round(ac/cm::DOUBLE,6) AS efficiency, round(ac/ns::DOUBLE,6) AS mean_length FROM p""",
)
def rl_throughput(t):
    rows = t.events.selectExpr(
        "event_id div 100 AS iteration", "value + 1 AS seconds", "1 + event_id % 4 AS batch", "1 + event_id % 3 AS rank_bins",
        "512 AS bin_size", "100 + event_id % 200 AS actual_tokens", "2 + event_id % 2 AS n_seqs",
    )
    out = R.rl_throughput(rows, 256, 8)
    return out.select(
        "iteration",
        *[F.round(c, 6 if c in ("efficiency", "mean_length") else 4).alias(c) for c in out.columns[1:]],
    )
