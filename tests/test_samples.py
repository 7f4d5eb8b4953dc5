import random

import pytest
from pyspark.sql import functions as F

from weft.operators import samples as S
from weft.operators import schedule
from weft.plans.build import RUN, BuildConfig, build_splits, cached, requested_sizes, sample_ids


def walk_bounds(lengths, length, extra, n_samples):
    """Reference walk: cut the flat order every ``length`` tokens."""
    total = sum(lengths)
    ends, at = [], 0
    for n in lengths:
        at += n
        ends.append(at)
    out = [(0, 0)]
    for j in range(1, n_samples + 1):
        p = min(j * length, total - extra)
        d = next(i for i, e in enumerate(ends) if (e > p if extra else e >= p))
        out.append((d, p - (ends[d] - lengths[d])))
    return out


@pytest.mark.parametrize("extra", [True, False])
@pytest.mark.parametrize("drop_last", [True, False])
def test_sample_bounds_equal_the_walk(spark, extra, drop_last):
    rng = random.Random(3)
    docs = [("x" if i % 5 else "y", i, rng.randint(1, 40)) for i in range(60)]
    df = spark.createDataFrame(docs, "dataset string, doc_id bigint, n_tokens int")
    plan = S.epoch_plan(df, 16, None, extra, drop_last)
    order = S.document_order(df, plan, 1)
    bounds = S.sample_bounds(order, plan, 16, extra).collect()
    plans = {r["dataset"]: r for r in plan.collect()}
    for name in ("x", "y"):
        flat = sorted((r["pos"], r["n_tokens"]) for r in order.collect() if r["dataset"] == name)
        want = walk_bounds([n for _, n in flat], 16, int(extra), plans[name]["n_samples"])
        got = sorted((r["sample_id"], r["doc_pos"], r["offset"]) for r in bounds if r["dataset"] == name)
        assert [(d, o) for _, d, o in got] == want
        assert [j for j, _, _ in got] == list(range(len(want)))


@pytest.mark.parametrize("extra", [True, False])
def test_samples_hold_every_token_once(spark, extra):
    rng = random.Random(8)
    docs = [("x", i, [i * 100 + k for k in range(rng.randint(1, 30))]) for i in range(40)]
    corpus = spark.createDataFrame(docs, "dataset string, doc_id bigint, tokens array<int>").withColumn(
        "n_tokens", F.size("tokens")
    )
    plan = S.epoch_plan(corpus, 8, None, extra, drop_last=False)
    order = S.document_order(corpus, plan, 4)
    got = {r["sample_id"]: r["tokens"] for r in S.materialize(order, plan, corpus, 8, extra).collect()}
    by_id = {i: t for _, i, t in docs}
    flat = [t for _, i in sorted((r["pos"], r["doc_id"]) for r in order.collect()) for t in by_id[i]]
    x = int(extra)
    for j, tokens in got.items():
        want = flat[j * 8 : j * 8 + 8 + x]
        assert tokens == want + [-1] * (8 + x - len(want))
    assert len(got) == -(-(len(flat) - x) // 8)


def test_last_epoch_stays_apart(spark):
    docs = spark.createDataFrame([("x", i, 10) for i in range(50)], "dataset string, doc_id bigint, n_tokens int")
    plan = S.epoch_plan(docs, 5, 210)  # 2.1 epochs of 99 samples
    assert plan.first()["epochs"] == 3 and plan.first()["last_apart"]
    order = S.document_order(docs, plan, 1).collect()
    assert {r["epoch"] for r in order if r["pos"] >= 100} == {2}
    shuffled = S.shuffle_samples(S.sample_bounds(S.document_order(docs, plan, 1), plan, 5), plan, 1).collect()
    head = plan.first()["head_samples"]
    assert all((r["sample_id"] < head) == (r["k"] < head) for r in shuffled)
    assert sorted(r["k"] for r in shuffled) == list(range(plan.first()["n_samples"]))


def test_split_ranges():
    assert S.split_ranges("0.99,0.01,0") == [(0.0, 0.99), (0.99, 1.0), None]
    assert S.split_ranges("50,50,0", "25,75,0") == [(0.0, 0.25), (0.5, 1.0), None]


def samples_of(spark, sizes):
    rows = [(name, k) for name, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "dataset string, k bigint")


def test_exact_blend(spark):
    df = samples_of(spark, {"a": 4, "b": 4, "c": 4})
    got = S.blend(df, {"a": 0.5, "b": 0.25, "c": 0.25}, 4, mode="exact").orderBy("i").collect()
    assert [(r["dataset"], r["k"]) for r in got] == [("a", 0), ("b", 0), ("c", 0), ("a", 1)]


def greedy_by_hand(shares, size, limits=None):
    taken, out = [0] * len(shares), []
    for i in range(size):
        errors = [w * max(i, 1) - c if limits is None or c < limits[d] else float("-inf") for d, (w, c) in enumerate(zip(shares, taken))]
        d = errors.index(max(errors))
        out.append((i, d, taken[d]))
        taken[d] += 1
    return out


@pytest.mark.parametrize("weights", [[1, 2, 3, 4, 5] * 4, [1] * 7, [0.61803, 0.2, 0.0, 0.0707], [random.Random(3).random() ** 6 + 0.001 for _ in range(40)]])
def test_schedule_in_blocks_equals_the_serial_walk(spark, monkeypatch, weights):
    monkeypatch.setattr(schedule, "block_steps", lambda sources: 150)
    shares = [w / sum(weights) for w in weights]
    known = schedule.states(spark, shares, 1_000)
    assert known.count() == 7
    got = sorted(tuple(r) for r in schedule.schedule(known, shares, 1_000).collect())
    assert got == greedy_by_hand(shares, 1_000)


def test_schedule_mends_wrong_guesses(spark, monkeypatch):
    """No run-up at all and starts that are off: blocks walk again from their predecessor's end."""
    monkeypatch.setattr(schedule, "block_steps", lambda sources: 90)
    monkeypatch.setattr(schedule, "RUN_UP", 0)
    shares = [0.5, 0.3, 0.15, 0.05]

    def off(shares, limits, step):
        taken = schedule.np.floor(shares * step).astype("int64")
        taken[0] += step - taken.sum()
        return taken

    monkeypatch.setattr(schedule, "rounded", off)
    got = sorted(tuple(r) for r in schedule.schedule(schedule.states(spark, shares, 500), shares, 500).collect())
    assert got == greedy_by_hand(shares, 500)


def test_exhaustive_schedule_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(schedule, "block_steps", lambda sources: 64)
    sizes = {f"d{i:02}": n for i, n in enumerate([300, 1, 17, 5, 120, 2, 55])}
    total = sum(sizes.values())
    got = sorted(tuple(r) for r in S.blend_exhaustive(samples_of(spark, sizes), "exact").collect())
    names = list(sizes)
    assert got == [(i, names[d], k) for i, d, k in greedy_by_hand([n / total for n in sizes.values()], total, list(sizes.values()))]


def test_sources_asked_for_too_much(spark):
    df = samples_of(spark, {"a": 10, "b": 100, "c": 3})
    rows = S.oversampled(df, {"a": 0.5, "b": 0.4, "c": 0.0, "d": 0.1}, 40).collect()
    assert sorted(tuple(r) for r in rows) == [("a", 20, 10), ("d", 4, 0)]
    for mode in ("stride", "exact"):
        with pytest.raises(ValueError, match="'a'"):
            S.blend(df, {"a": 0.5, "b": 0.5}, 40, mode)


def test_exhaustive_blends_use_every_sample_once(spark):
    sizes = {"a": 7, "b": 23, "c": 1}
    for mode in ("stride", "exact"):
        got = S.blend_exhaustive(samples_of(spark, sizes), mode).collect()
        assert sorted(r["i"] for r in got) == list(range(31))
        assert len({(r["dataset"], r["k"]) for r in got}) == 31


def test_stride_blend_keeps_proportions(spark):
    w = {"a": 0.6, "b": 0.3, "c": 0.1}
    got = S.blend(samples_of(spark, {"a": 200, "b": 200, "c": 200}), w, 200).orderBy("i").collect()
    taken = dict.fromkeys(w, 0)
    for i, r in enumerate(got):
        assert r["i"] == i and r["k"] == taken[r["dataset"]]
        taken[r["dataset"]] += 1
        assert all(abs(taken[n] - w[n] * (i + 1)) < 2 for n in w)


def test_oversampling_is_an_error(spark):
    df = samples_of(spark, {"a": 3, "b": 300})
    for mode in ("stride", "exact"):
        with pytest.raises(ValueError, match="more samples"):
            S.blend(df, {"a": 0.5, "b": 0.5}, 100, mode).collect()


def test_parse_blend():
    assert S.parse_blend(["0.3", "x", "0.7", "y"]) == (["x", "y"], [0.3, 0.7])
    assert S.parse_blend(["x", "y"]) == (["x", "y"], None)
    with pytest.raises(ValueError):
        S.parse_blend(["0.3", "x", "z", "y"])


def test_requested_sizes():
    assert requested_sizes(4, 8, 2, 2) == (32, 48, 16)


def test_build_with_weights(spark):
    docs = [(f"f{f}", f * 32 + d, 64) for f in range(4) for d in range(32)]
    corpus = spark.createDataFrame(docs, "dataset string, doc_id bigint, n_tokens int")
    weights = tuple((f"f{f}", float(f + 1)) for f in range(4))
    cfg = BuildConfig(16, "70,20,10", weights=weights, sizes=(32, 48, 16))
    built = build_splits(corpus, cfg)
    assert [built[s].count() for s in S.SPLITS] == [32, 48, 16]
    with pytest.raises(ValueError):
        build_splits(corpus, BuildConfig(16, weights=weights))


def test_cache_keeps_the_first_table(spark, tmp_path):
    first = cached(spark, str(tmp_path), {"a": 1}, lambda: spark.range(3).toDF("x"))
    again = cached(spark, str(tmp_path), {"a": 1}, lambda: spark.range(9).toDF("x"))
    other = cached(spark, str(tmp_path), {"a": 2}, lambda: spark.range(5).toDF("x"))
    assert (first.count(), again.count(), other.count()) == (3, 3, 5)


def test_runs_of_samples_stay_in_several_tasks(spark):
    """The runs are few rows; put together in one task, that task would make every sample of the build."""
    plan = spark.createDataFrame([("a", 40 * RUN + 3), ("b", 5), ("c", 0)], "dataset string, n_samples bigint")
    ids = sample_ids(plan)
    per = {r[0]: r[1] for r in ids.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).collect()}
    assert len(per) > 2 and max(per.values()) < 0.8 * sum(per.values())
    got = ids.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("d"), F.max("sample_id").alias("m"))
    assert {tuple(r) for r in got.collect()} == {("a", 40 * RUN + 3, 40 * RUN + 3, 40 * RUN + 2), ("b", 5, 5, 4)}


def test_columns_of_samples_without_marks_are_not_gone_through(spark):
    rows = [[1, 2, 3], [1, 9, 2, 9], [9], [-1, 5, -1], [], [1, None, 9, 2], [None, 1], None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, tokens array<int>")
    lm = S.lm_columns(df.filter("size(tokens) > 0"), extra=False)
    out = S.ltor_columns(df.withColumnRenamed("tokens", "input"), eod=9, pad=5)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" in plan(lm) and "array_contains" in plan(out)
    for r in lm.collect():
        assert r["input"] == [0 if v == -1 else v for v in rows[r["i"]]]
    for r in out.filter("input is not null").collect():
        at, seg, want = 0, 0, []
        for v in rows[r["i"]]:
            want.append((at, seg, 0 if v in (9, 5) else 1))
            at, seg = (0, seg + 1) if v == 9 else (at + 1, seg)
        assert list(zip(r["position_ids"], r["segment_ids"], r["loss_mask"])) == want
    assert [tuple(r)[2:] for r in out.filter("input is null").collect()] == [(None, None, None)]
