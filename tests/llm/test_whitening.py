"""Whitening beside an eigen-decomposition of the exact covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, n int, x string"


def exact_model(vectors):
    """(distinct x rows, sums, covariance, eigenvalues, eigenvectors) in plain Python and numpy."""
    x = sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors})
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    centred = np.array([[r[i] - sums[i] / n for i in range(d)] for r in x])
    cov = centred.T @ centred / n
    value, vector = np.linalg.eigh(cov)
    return x, sums, cov, value[::-1], vector[:, ::-1]


def check(rows, given):
    usable = [(i, v) for i, v in given if v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    x, sums, cov, value, vector = exact_model([np.float32(v) for _, v in usable])
    n = len(x)
    keep = min(4, int((value > 1e-9 * value[0]).sum()))
    assert len(rows) == keep * len(usable)
    white = {}
    for r in rows:
        white.setdefault((r["vec_id"], r["component"]), []).append(r)
    for i, v in usable:
        row = [math.floor(256 * float(np.float32(c))) for c in v]
        for k in range(keep):
            r = white[(i, k + 1)].pop() if len({i for i, _ in usable}) < len(usable) else white[(i, k + 1)][0]
            if len({i for i, _ in usable}) == len(usable):
                assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(row, sums))
                want = np.dot([a - s / n for a, s in zip(row, sums)], vector[:, k]) / math.sqrt(value[k])
                assert abs(abs(r["whitened"]) - abs(want)) < 1e-7
            assert r["n"] == n and abs(r["explained"] - value[k] / np.trace(cov)) <= 1e-8 * r["explained"] + 1e-15
            assert r["identity_error"] <= 1e-8


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 7, "q") for i, v in vectors], SCHEMA)


def made(n, rank=6, seed=3, scale=(9, 4, 2, 1, 0.5, 0.1)):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, rank)) * np.array(scale[:rank])
    return [(i, [float(c) for c in v]) for i, v in enumerate(base @ rng.standard_normal((rank, 6)))]


def test_equals_the_eigenvectors_of_the_covariance(spark):
    given = made(300)
    check(whitening.whiten(table(spark, given)).collect(), given)


def test_ill_conditioned_rows(spark):
    given = made(200, scale=(4e3, 1e2, 30, 1, 0.05, 0.01))
    check(whitening.whiten(table(spark, given)).collect(), given)


def test_one_sign_for_all_rows(spark):
    given = made(120)
    x, sums, _, value, vector = exact_model([np.float32(v) for _, v in given])
    rows = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(table(spark, given)).collect()}
    for k in range(4):
        want = [np.dot([math.floor(256 * float(np.float32(c))) - s / len(x) for c, s in zip(v, sums)], vector[:, k]) for _, v in given]
        assert abs(np.corrcoef(want, [rows[(i, k + 1)] for i, _ in given])[0, 1]) > 1 - 1e-9


def test_less_than_full_rank(spark):
    """Rows on a line of whole numbers: one component; the second pass meets a singular Gram matrix."""
    given = [(i, [float(i), 2.0 * i, 0.0, 1.0, float(-i), 0.0]) for i in range(50)]
    rows = whitening.whiten(table(spark, given)).collect()
    assert {r["component"] for r in rows} == {1} and len(rows) == 50
    check(rows, given)


def test_unusable_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [nan] * 6), (903, [0.0, inf] * 3), (904, []), (905, [1.0] * 5), (906, [3e38] * 6)]
    good = made(80)
    rows = whitening.whiten(table(spark, good + bad)).collect()
    check(rows, good)
    twice = whitening.whiten(table(spark, good + good + [(None, good[0][1])])).collect()
    assert len(twice) == 4 * 161 and {r["n"] for r in twice} == {80}
    assert sum(r["vec_id"] is None for r in twice) == 4


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [1.0] * 6)], [(1, [1.0] * 6), (2, [1.0] * 6)]])
def test_nothing_to_scale(spark, vectors):
    out = whitening.whiten(table(spark, vectors))
    assert out.collect() == []
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_64_bits(spark):
    given = [(i, [float(1 << 50), float(i) * 2.0**44, 0.0, 0.0, 0.0, 1.0]) for i in range(9)]
    rows = whitening.whiten(table(spark, given).withColumn("embedding", F.col("embedding").cast("array<double>"))).collect()
    sums = [sum(math.floor(256 * v[d]) for _, v in given) for d in range(6)]
    for r in rows:
        want = sum((9 * math.floor(256 * c) - s) ** 2 for c, s in zip(given[r["vec_id"]][1], sums))
        assert r["deviation_exact"] == str(want)
        assert r["deviation"] == (want if want < 2**63 else None)


def test_triangular_solve():
    rng = np.random.default_rng(1)
    a, r = rng.standard_normal((40, 7)), np.triu(rng.standard_normal((7, 7))) + 5 * np.eye(7)
    assert np.allclose(whitening.through(a, r) @ r, a)
