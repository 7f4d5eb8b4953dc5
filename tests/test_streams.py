import glob
import os
import random

from weft.streaming import rollout_stream as R


def test_release_keeps_the_order(spark, tmp_path):
    rng = random.Random(7)
    rows = [(s, b, i, f"{s}{b}{i}") for s in ("hot", "cold") for b in range(30 if s == "hot" else 3) for i in range(4)]
    rng.shuffle(rows)
    schema = "source string, batch_id bigint, index_in_batch int, payload string"
    folder = str(tmp_path)
    released, arrived = [], set()
    for epoch in range(6):
        part = rows[epoch * 22 : (epoch + 1) * 22]
        arrived |= set(part)
        R.release_step(spark.createDataFrame(part, schema), epoch, 4, folder)
        out = [tuple(r) for r in spark.read.schema(schema).parquet(f"{folder}/released/{epoch}").collect()]
        released += out
        # all earlier batches of a source are out, and every batch is whole
        for s in ("hot", "cold"):
            seen = sorted((b, i) for q, b, i, _ in released if q == s)
            assert seen == [(b, i) for b in range(len(seen) // 4) for i in range(4)]
            full = 0
            while all((s, full, i, f"{s}{full}{i}") in arrived for i in range(4)):
                full += 1
            assert len(seen) == full * 4
    assert sorted(released) == sorted(rows)


def test_replayed_batch_gives_no_doubles(spark, tmp_path):
    schema = "source string, batch_id bigint, index_in_batch int"
    first = spark.createDataFrame([("a", 0, 0), ("a", 1, 0)], schema)
    second = spark.createDataFrame([("a", 0, 1), ("a", 1, 1)], schema)
    R.release_step(first, 0, 2, str(tmp_path))
    for _ in range(2):  # the same micro-batch, run again after a lost driver
        R.release_step(second, 1, 2, str(tmp_path))
    out = spark.read.schema(schema).parquet(*glob.glob(f"{tmp_path}/released/*")).collect()
    assert sorted(map(tuple, out)) == [("a", 0, 0), ("a", 0, 1), ("a", 1, 0), ("a", 1, 1)]


def stored_rows(spark, folder, schema):
    return {os.path.basename(p): spark.read.schema(schema).parquet(p).count() for p in glob.glob(f"{folder}/log/*")}


def test_written_rows_follow_the_arrivals(spark, tmp_path, monkeypatch):
    """One source never completes, others flow: its rows are merged now and then, not written with each micro-batch."""
    monkeypatch.setattr(R, "MERGED", 3)
    schema, folder = "source string, batch_id bigint, index_in_batch int", str(tmp_path)
    written, seen, out = 0, {}, []
    for epoch in range(9):
        rows = [("stuck", epoch + 1, 0)] + [("flow", epoch, i) for i in range(20)]
        for _ in range(1 + (epoch in (4, 8))):  # some micro-batches are replayed
            R.release_step(spark.createDataFrame(rows, schema), epoch, 20, folder)
        now = stored_rows(spark, folder, schema)
        written += sum(n for name, n in now.items() if name not in seen)
        seen = now
        out += [tuple(r) for r in spark.read.schema(schema).parquet(f"{folder}/released/{epoch}").collect()]
        assert len(glob.glob(f"{folder}/live/*")) <= 2 and len(glob.glob(f"{folder}/frontier/*")) <= 2
        assert len(now) <= 3 + 2 + 3
    assert sorted(out) == [("flow", e, i) for e in range(9) for i in range(20)]
    assert written <= 9 * 21 + 9 + 9  # arrivals, and the waiting rows of two merges


def test_reward_spread(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([0.0, 2.0],)], "rewards array<double>")
    assert [r[0] for r in df.select(R.reward_spread("rewards")).collect()] == [0.0, 1.0]
    assert R.filter_uniform_groups(df).count() == 1


def test_staged_rows_are_spread_over_files(spark, tmp_path):
    import glob

    from weft.plans.registry import Tables
    from weft.plans.streams import staged

    rows = spark.range(0, 1000, 1, 12).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    stream, folder = staged(Tables(spark, str(tmp_path)), rows)
    files = glob.glob(f"{folder}/in/*.parquet")
    assert len(files) == 12
    out = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
    query = out.trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
    assert spark.read.parquet(f"{folder}/out").agg({"doc_id": "sum"}).first()[0] == 999 * 500
