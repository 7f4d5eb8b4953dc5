import random

import pytest
from pyspark.sql import functions as F

from weft.functions import ordering as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    # one group holds most rows, ids are sparse
    data = [("a" if rng.random() < 0.7 else "b", i * 37 + rng.randrange(30), rng.randrange(9)) for i in range(400)]
    return data, spark.createDataFrame(data, "g string, id bigint, v bigint").repartition(7)


def walk(data, within):
    seen, out = {}, {}
    for g, i, v in data:
        n, s = seen.get(g if within else 0, (0, 0))
        out[i] = (n, s)
        seen[g if within else 0] = (n + 1, s + v)
    return out


@pytest.mark.parametrize("within", [[], ["g"]])
def test_ranged_running(rows, within):
    data, df = rows
    got = O.ranged_running(df, ["id"], ["v"], within=within).collect()
    want = walk(sorted(data, key=lambda r: r[1]), bool(within))
    assert {r["id"]: (r["ordinal"], r["cum_v"]) for r in got} == want


@pytest.mark.parametrize("within", [[], ["g"]])
def test_hashed_running(rows, within):
    import hashlib

    data, df = rows
    keyed = df.withColumn("k", O.order_key(9, "id"))
    got = O.hashed_running(keyed, "k", ["v"], within=within, ties=["id"]).collect()
    order = sorted(data, key=lambda r: hashlib.md5(f"9|{r[1]}".encode()).hexdigest())
    assert {r["id"]: (r["pos"], r["cum_v"]) for r in got} == walk(order, bool(within))


def test_order_is_independent_of_partitions(rows):
    _, df = rows
    one = O.hashed_running(df.withColumn("k", O.order_key(1, "id")).coalesce(1), "k")
    many = O.hashed_running(df.withColumn("k", O.order_key(1, "id")).repartition(11), "k")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    other = O.hashed_running(df.withColumn("k", O.order_key(2, "id")), "k")
    assert {r["id"]: r["pos"] for r in one.collect()} != {r["id"]: r["pos"] for r in other.collect()}


def test_marks_find_the_nearest_earlier_row(rows):
    data, df = rows
    got = O.ranged_running(df, ["id"], within=["g"], marks={"zero": F.col("v") == 0}).collect()
    last, count, want = {}, {}, {}
    for g, i, v in sorted(data, key=lambda r: r[1]):
        want[i] = last.get(g)
        n = count.get(g, 0)
        if v == 0:
            last[g] = n
        count[g] = n + 1
    assert {r["id"]: r["last_zero"] for r in got} == want


def test_group_median(rows):
    import statistics

    data, df = rows
    got = {r["g"]: r["median"] for r in O.group_median(df, ["g"], "v").collect()}
    for g in ("a", "b"):
        assert got[g] == statistics.median(v for k, _, v in data if k == g)


def test_median_of_one_value_for_nine_rows_of_ten(spark):
    """Equal values are counted before they move, so the ranged order sees each once."""
    rows = [("a", 7.0)] * 900 + [("a", float(i)) for i in range(100)] + [("b", 1.0), ("b", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    got = {r["g"]: r["median"] for r in O.group_median(df, ["g"], "v").collect()}
    assert got == {"a": 7.0, "b": 2.5}
