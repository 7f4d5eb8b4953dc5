import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import rollouts as R


def turns(spark, rewards, counts):
    rows = [
        (g, r, float(x), [[1]] * n)
        for g, (xs, ns) in enumerate(zip(rewards, counts))
        for r, (x, n) in enumerate(zip(xs, ns))
    ]
    return spark.createDataFrame(rows, "group_id bigint, rollout_id bigint, reward double, trajectory array<array<int>>")


@pytest.mark.parametrize(
    ("counts", "want"), [([[1, 1], [1, 1]], [-1, 1, 0, 0]), ([[2, 1], [1, 3]], [-1, -1, 1, 0, 0, 0, 0])]
)
def test_advantages(spark, counts, want):
    out = R.advantages(turns(spark, [[-1, 1], [4, 4]], counts)).orderBy("group_id", "rollout_id", "turn").collect()
    assert [r["advantage"] for r in out] == pytest.approx(want, abs=1e-3)


def test_equal_policies_have_no_loss(spark):
    one = [1.0, 1.0]
    df = spark.createDataFrame([(one, one, one, 0.0)], "current array<double>, old array<double>, ref array<double>, advantage double")
    r = R.policy_terms(df, 0.2, 0.2, 0.1, 0.0).first()
    assert r["loss"] == [0.0, 0.0] and r["kl"] == [0.0, 0.0] and r["ratio"] == [1.0, 1.0]
    assert not any(r["above"]) and not any(r["below"])


def test_ratio_two_is_truncated(spark):
    cur, old = [math.log(2.0)], [0.0]
    df = spark.createDataFrame([(cur, old, cur, 1.0)], "current array<double>, old array<double>, ref array<double>, advantage double")
    r = R.policy_terms(df, 0.1, 0.1, 0.0, 0.0).first()
    assert r["ratio"] == pytest.approx([2.0]) and r["above"] == [True]
    assert r["loss"] == pytest.approx([-1.1])


def test_packed_advantages(spark):
    df = spark.createDataFrame([([0, 4], [4, 3], [1.0, 2.0])], "s array<int>, n array<int>, v array<double>")
    got = df.select(R.packed_advantages(F.col("s"), F.col("n"), F.col("v"), 9)).first()[0]
    assert got == [1, 1, 1, 0, 2, 2, 0, 0, 0]


def test_math_reward_cases(spark):
    rows = [
        ("think <answer>4</answer>", "stop", 1.0),
        ("<answer>5</answer>", "stop", 0.05),
        ("<answer>4</answer> and so on", "stop", 0.1),
        ("<answer>4</answer>", "length", 0.05),
        ("so \\boxed{4}", "stop", 1.0),
        ("so \\boxed{4} yes", "stop", 0.1),
        ("nothing", "stop", -0.5),
        ("<answer>9</answer> <answer> 4 </answer>  \n", "stop", 1.0),
    ]
    df = spark.createDataFrame(rows, "r string, f string, want double")
    got = df.select("want", R.math_reward(F.col("r"), F.lit("4"), F.col("f")).alias("x")).collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]


def test_countdown_cases(spark):
    rows = [
        ("<answer>(10+5)*2</answer>", 1.0),
        ("<answer>10+5+2</answer>", 0.1),
        ("(10+5)*2", 0.0),
        ("<answer>30*1</answer>", 0.1),
        ("<answer>(10+5)*2</answer>\nlater", 0.0),
        ("<answer>10/0+5*2</answer>", 0.1),
        ("<answer>__import__('os')</answer>", 0.1),
    ]
    df = spark.createDataFrame(rows, "r string, want double")
    nums = F.array(F.lit(10), F.lit(5), F.lit(2))
    got = df.select("want", R.countdown_reward(F.col("r"), F.lit(30), nums).alias("x")).collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]


def test_pass_at_k_equals_the_product_form(spark):
    rows = [(p, float(i < c), False) for p, (n, c) in enumerate([(10, 0), (10, 3), (10, 10), (8, 7)]) for i in range(n)]
    rows += [(p, 1.0, True) for p in range(4)]
    df = spark.createDataFrame(rows, "problem_id int, reward double, greedy boolean")
    for r in R.pass_at_k(df, [1, 5]).collect():
        for k in (1, 5):
            n, c = r["n"], r["c"]
            want = 1.0 if n - c < k else 1.0 - np.prod(1.0 - k / np.arange(n - c + 1, n + 1))
            assert r[f"pass_at_{k}"] == pytest.approx(want)


def test_allocation():
    assert R.allocate(10, {"a": 0.55, "b": 0.25, "c": 0.2}) == {"a": 6, "b": 2, "c": 2}
    assert R.allocate(10, {"a": 0.5, "b": 0.5}, remainder=False) == {"a": 5, "b": 5}
    assert R.allocate(4, {"a": 1.0, "b": 0.0}, ["b"]) == {"a": 4, "b": 0}


def test_mix_rounds(spark):
    df = spark.createDataFrame([(s, k) for s in "ab" for k in range(9)], "source string, k bigint")
    got = R.mix_groups(df, {"a": 2 / 3, "b": 1 / 3}, 9).orderBy("i").collect()
    assert "".join(r["source"] for r in got) == "aabaabaab"


def test_trajectory_checks(spark):
    schema = "group_id bigint, rollout_id bigint, env_id string, trajectory array<array<int>>, generation_mask array<array<boolean>>, logprobs array<array<double>>"

    def run(tokens, mask):
        df = spark.createDataFrame([(0, 0, "e", [tokens], [mask], [[0.0]])], schema)
        return R.trajectories(df, 4, 0, 2, 1).collect()

    assert run([1, 5, 2], [False, True, True])[0]["tokens"] == [1, 5, 2, 0]
    assert run([1, 5, 2], [False, True, True])[0]["generation_mask"] == [False, True, True, False]
    for tokens, mask in (([1, 5, 6], [False] * 3), ([1, 2, 3, 4, 5], [False] * 5), ([5, 2], [False] * 2), ([1, 2, 2], [True] * 3)):
        with pytest.raises(Exception):
            run(tokens, mask)


def test_environments(spark):
    rows = R.environment_table(spark, [{"env": "m", "agent": "x.Y", "weight": 3, "args": {"k": 1}}, {"env": "v", "agent": "x.Z", "weight": 1, "evaluation_only": True}]).collect()
    assert [(r["weight"], r["evaluation_only"]) for r in rows] == [(0.75, False), (0.25, True)]
