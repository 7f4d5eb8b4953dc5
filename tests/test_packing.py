import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.functions import tokens as T
from weft.operators import batches as B
from weft.operators import hooks as K
from weft.operators import packing as P


def frame(spark, lengths):
    return spark.createDataFrame(list(enumerate(lengths)), "seq_id bigint, length bigint").repartition(3)


def bins_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["bin_id"], r["slot"])):
        out.setdefault(r["bin_id"], []).append(r["seq_id"])
    return out


def next_fit(lengths, size, cap, empty_first=False):
    bins, used = [[]], 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if used + lengths[i] <= size and len(bins[-1]) < cap:
            bins[-1].append(i)
            used += lengths[i]
        else:
            if bins[-1] or empty_first:
                bins.append([])
            bins[-1].append(i)
            used = lengths[i]
    return {k: b for k, b in enumerate(bins) if b}


def best_fit(lengths, size):
    left = sorted((n, i) for i, n in enumerate(lengths))
    bins = {}
    while left:
        room, members = size, []
        while True:
            fitting = [x for x in left if x[0] <= room]
            if not fitting:
                break
            left.remove(fitting[-1])
            room -= fitting[-1][0]
            members.append(fitting[-1][1])
        bins[len(bins)] = members
    return bins


@pytest.mark.parametrize("seed", range(4))
def test_packers_equal_the_walks(spark, seed):
    rng = random.Random(seed)
    # a third of all sequences share one length, some are empty, some too long
    lengths = [7 if rng.random() < 0.34 else rng.randint(0, 70) for _ in range(90)]
    assert bins_of(P.pack_nfd(frame(spark, lengths), 64, 5)) == next_fit(lengths, 64, 5)
    fitting = [min(n, 64) for n in lengths]
    assert bins_of(P.pack_best_fit(frame(spark, fitting), 64)) == best_fit(fitting, 64)
    padded = [-(-n // 16) * 16 for n in lengths]
    got = bins_of(P.pack_padded(frame(spark, lengths), 64, 16))
    assert got == next_fit(padded, 64, 1 << 60, empty_first=True)


def test_run_lengths_equal_the_walks_on_many_cases():
    """The plans alone, without Spark: pieces expanded over ranks."""
    rng = random.Random(0)
    for _ in range(400):
        lengths = [rng.choice([0, 1, 3, 3, 5, 8, 13, 21, 40]) for _ in range(rng.randint(1, 40))]
        size, cap = rng.randint(5, 30), rng.randint(1, 6)
        counts = {n: lengths.count(n) for n in set(lengths)}
        ranks = {n: [i for i, x in enumerate(lengths) if x == n] for n in counts}

        def expand(pieces, members):
            bins = {}
            for length, first, last, per_bin, bin_id, slot, _ in pieces:
                for r in range(first, last):
                    at = bin_id + (r - first) // per_bin
                    bins.setdefault(at, []).append((slot + (r - first) % per_bin, members[length][r]))
            return {b: [i for _, i in sorted(m)] for b, m in sorted(bins.items())}

        assert expand(P.next_fit_runs(counts, size, cap), ranks) == next_fit(lengths, size, cap)
        want = next_fit(lengths, size, 1 << 60, empty_first=True)
        assert expand(P.next_fit_runs(counts, size, None, True), ranks) == want
        if max(lengths) <= size:
            backwards = {n: r[::-1] for n, r in ranks.items()}
            assert expand(P.best_fit_runs(counts, size), backwards) == best_fit(lengths, size)


def test_oversize_is_an_error(spark):
    with pytest.raises(ValueError):
        P.pack_best_fit(frame(spark, [3, 99]), 64)


def test_true_length(spark):
    rows = [([1, 2, 3, 42, 42],), ([1, 42, 42, 2, 3],), ([42, 42],), ([],)]
    df = spark.createDataFrame(rows, "a array<int>")
    assert [r[0] for r in df.select(P.true_length("a", 42)).collect()] == [3, 5, 0, 0]


def test_cu_seqlens_is_padded(spark):
    df = spark.createDataFrame([([1] * 50,), ([4, 5],), ([],)], "a array<int>")
    got = [r[0] for r in df.select(P.cu_seqlens(F.col("a"), 1024, 50)).collect()]
    assert len(got[0]) == 52 and got[0][0] == 0 and got[0][-1] == 1024
    assert got[1][:4] == [0, 4, 9, 1024] and len(got[1]) == 52
    assert got[2] is None


def test_statistics_of_two_bins(spark):
    placed = spark.createDataFrame(
        [(0, 0, 0, 5), (0, 1, 1, 3), (1, 0, 2, 10), (1, 1, 3, 4)], "bin_id bigint, slot int, seq_id int, length bigint"
    )
    ranks = P.distribute_bins(placed.select("bin_id").distinct(), 4)
    rows = {r["rank"]: r for r in P.packing_stats(placed, ranks, 16 * 2).collect()}
    assert rows[None]["actual_tokens"] == 22
    assert rows[None]["bins"] == 4 and rows[None]["filled"] == 2
    assert rows[None]["efficiency"] == pytest.approx(22 / 128, abs=1e-6)


@pytest.mark.parametrize(("ratio", "bins", "world", "want"), [(1, 1, 8, 8), (1, 42, 8, 336), (0.5, 1, 8, 8), (1 / 3, 4, 8, 16)])
def test_step_plan(spark, ratio, bins, world, want):
    ids = spark.range(bins * world).select(F.col("id").alias("bin_id"))
    placed = ids.withColumn("length", F.lit(1))
    plan = P.step_plan(placed, P.distribute_bins(ids, world), ratio, world)
    assert plan.first()["global_batch"] == want


def test_schedule():
    assert B.parse_schedule("0:768 250B:1536", 4096) == [(0, 768), (250 * 10**9 // 4096, 1536)]
    assert B.schedule_segments([(0, 10), (25, 20)]) == [(0, 10, 0), (30, 20, 3)]
    with pytest.raises(ValueError):
        B.parse_schedule("5:10")


def test_schedule_steps_equal_a_walk(spark):
    schedule = [(0, 10), (25, 16), (27, 20), (100, 7)]
    df = B.assign_steps(spark.range(200).toDF("i"), "0:10 25:16 27:20 100:7")
    got = {r["i"]: (r["step"], r["batch_size"]) for r in df.collect()}
    consumed = step = 0
    while consumed < 200:
        size = [b for t, b in schedule if t <= consumed][-1]
        for i in range(consumed, min(consumed + size, 200)):
            assert got[i] == (step, size)
        consumed, step = consumed + size, step + 1


def test_balanced_groups_serve_every_sequence_once(spark):
    rng = random.Random(2)
    rows = [(b, b * 100 + i, rng.randint(1, 9000)) for b in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "batch bigint, seq_id bigint, length bigint")
    got = B.balance_groups(df, 8, 2048).collect()
    per = {}
    for r in got:
        per.setdefault((r["batch"], r["seq_id"]), []).append(r)
    assert len(per) == len(rows)
    for (_, _), cells in per.items():
        width, length = cells[0]["width"], cells[0]["length"]
        assert len(cells) == width and len({c["step"] for c in cells}) == 1
        assert width & (width - 1) == 0 and width <= 8
        assert width * 2048 >= min(length, 8 * 2048)
        workers = sorted(c["worker"] for c in cells)
        assert workers == list(range(workers[0], workers[0] + width)) and workers[-1] < 8


def test_pad_batch_rules(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], None), (0, [4], [0.5])], "batch int, a array<int>, b array<double>")
    got = sorted(tuple(r) for r in B.pad_batch(df, {"a": 9, "b": 0.0}).select("a", "b").collect())
    assert got == [([1, 2, 3], [0.0]), ([4, 9, 9], [0.5])]
    bad = spark.createDataFrame([(0, None)], "batch int, a array<int>")
    with pytest.raises(Exception, match="batch of nulls"):
        B.pad_batch(bad, {"a": 0}).collect()


def test_best_fit_as_a_hook_equals_the_operator(spark):
    """One buffer that holds all samples gives the operator's bins; several give each buffer's own."""
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 1, 7, 30, 55, 64, rng.randint(1, 64)])) for i in range(300)]
    df = spark.createDataFrame(rows, "seq_id bigint, length bigint").repartition(3)
    pack = lambda g: {"ids": g.column("seq_id").to_pylist()}
    one = K.pack_with(df, "seq_id", 1_000, K.largest_that_fits(64), pack, "ids array<bigint>").collect()
    bins = {}
    for r in P.pack_best_fit(df, 64).orderBy("bin_id", "slot").collect():
        bins.setdefault(r["bin_id"], []).append(r["seq_id"])
    assert {r["pack"]: r["ids"] for r in one} == bins
    many = K.pack_with(df, "seq_id", 70, K.largest_that_fits(64), pack, "ids array<bigint>").collect()
    assert {r["buffer"] for r in many} == set(range(5))
    assert all(set(r["ids"]) <= set(range(70 * r["buffer"], 70 * r["buffer"] + 70)) for r in many)
    assert sorted(i for r in many for i in r["ids"]) == list(range(300))


def test_batch_hook_and_wrong_selections(spark):
    df = spark.createDataFrame([(i, i % 5 + 1) for i in range(23)], "seq_id bigint, length bigint")
    by_two = lambda t: [range(a, min(a + 2, t.num_rows)) for a in range(0, t.num_rows, 2)]
    pack = lambda g: {"n": g.num_rows, "longest": max(g.column("length").to_pylist())}

    def batch(packed):
        return pa.table({"width": pa.array([max(packed.column("longest").to_pylist())], pa.int64()), "rows": pa.array([packed.num_rows], pa.int64())})

    out = K.pack_with(df, "seq_id", 10, by_two, pack, "n int, longest bigint", batch, "width bigint, rows bigint").collect()
    assert sorted((r["buffer"], r["pack"], r["width"], r["rows"]) for r in out) == [(0, 0, 5, 5), (1, 0, 5, 5), (2, 0, 3, 2)]
    with pytest.raises(Exception, match="twice"):
        K.pack_with(df, "seq_id", 10, lambda t: [[0, 1], [1]], pack, "n int, longest bigint").collect()
    assert K.pack_with(df.limit(0), "seq_id", 10, by_two, pack, "n int, longest bigint").collect() == []


def test_bins_of_sequences_without_masks(spark):
    bins = spark.createDataFrame([(0, 0, 7), (0, 1, 8), (1, 0, 9)], "bin_id bigint, slot int, seq_id bigint")
    df = spark.createDataFrame([(7, [1, 2], [True, False]), (8, [3], [True]), (9, [], [])], "seq_id bigint, tokens array<int>, generation_mask array<boolean>")
    whole, bare = (P.assemble_bins(bins, d, 4, 0).orderBy("bin_id") for d in (df, df.drop("generation_mask")))
    assert bare.collect() == whole.drop("loss_mask").collect()
    assert [r["tokens"] for r in bare.collect()] == [[1, 2, 3, 0], [0, 0, 0, 0]]


def test_lists_as_bytes_and_back():
    cases = [
        (pa.int32(), [[1, 255], [], None, [0]]), (pa.int32(), [[1, 256], [], None]), (pa.int64(), [[-1, 5], [2**40]]), (pa.int32(), [[70000, -3], None]),
        (pa.bool_(), [[True, False], [], None]), (pa.int32(), [[1, None], [], [5]]), (pa.int32(), []), (pa.int32(), [None, None]), (pa.int8(), [[-128, 127]]),
    ]
    for kind, rows in cases:
        lists = pa.array(rows, pa.list_(kind))
        narrow = T.narrow_lists(lists)
        assert T.wide_lists(narrow, kind).to_pylist() == rows
        assert T.wide_lists(narrow[1:], kind).to_pylist() == T.wide_lists(T.narrow_lists(lists[1:]), kind).to_pylist() == rows[1:]
    parts = [[[1, 255], None, []], [[300]], [[None, 3], [7]], [[-1]]]
    mixed = pa.concat_arrays([T.narrow_lists(pa.array(rows, pa.list_(pa.int32()))) for rows in parts])
    assert T.wide_lists(mixed, pa.int32()).to_pylist() == sum(parts, [])
    assert T.narrow_lists(pa.array([[7] * 100], pa.list_(pa.int32()))).field("data").nbytes < 120


def moved(df):
    """The types of the columns that the joins of a plan put together."""
    found, left = set(), [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            found |= {c.output().apply(i).dataType().catalogString() for c in children for i in range(c.output().size())}
        left += children
    return found


def test_tokens_move_as_bytes_and_not_for_their_numbers(spark):
    """Bins, their parts and the numbers of these, with sequences that come twice; tokens were moved as arrays, twice over."""
    rng = random.Random(8)
    bins = [(b, s, rng.randrange(30)) for b in range(12) for s in range(rng.randint(0, 5))]
    seqs = [(i, None if i == 7 else [rng.choice([1, 255, 256, -4]) for _ in range(rng.choice([0, 1, 3]))]) for i in range(30) for _ in range(1 + i % 3)]
    placed = spark.createDataFrame(bins, "bin_id bigint, slot int, seq_id bigint").repartition(3)
    df = spark.createDataFrame(seqs, "seq_id bigint, tokens array<int>").repartition(2)
    rows = P.assemble_bins(placed, df, 16, 0)
    assert "array<int>" not in moved(rows)
    want = {}
    for b, s, i in bins:
        want.setdefault(b, []).extend((s, i, t is not None, t or []) for k, t in seqs if k == i)
    got = {r["bin_id"]: r for r in rows.collect()}
    assert set(got) == set(want)
    for b, members in want.items():
        members.sort()
        assert got[b]["seq_ids"] == [m[1] for m in members]
        if all(m[2] for m in members):
            flat = sum((m[3] for m in members), [])
            assert got[b]["tokens"] == flat + [0] * (16 - len(flat)) and got[b]["lengths"] == [len(m[3]) for m in members]
    of = (F.expr("bin_id % 3").alias("rank"), F.expr("bin_id div 3").alias("row"), P.cumulative(F.col("lengths")).alias("cu_seqlens"))
    packed, sizes = rows.select(*of, "tokens"), P.bin_lengths(placed, df).select(*of)
    assert moved(sizes) <= {"bigint", "int"}
    out = B.unpack(packed, sizes)
    assert "array<int>" not in moved(out)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, B.unpack(packed).collect())) != []
