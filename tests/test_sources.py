import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.sources import corpus as C
from weft.sources import indexed as I
from weft.sources import pairs as P
from weft.sources import results as R


def written(spark, path, vocab, modes=False):
    rng = random.Random(3)
    rows = []
    for d in range(40):
        for s in range(rng.randint(1, 4)):
            rows.append((d, s, [rng.randrange(60000) for _ in range(rng.choice([0, 1, 5, 30]))], s % 2))
    df = spark.createDataFrame(rows, "doc_id bigint, seq_no int, tokens array<int>, mode int")
    I.write_indexed(df.repartition(5), path, vocab, multimodal=modes)
    return rows


@pytest.mark.parametrize("vocab", [60000, 70000])
@pytest.mark.parametrize("modes", [False, True])
def test_indexed_round_trip(spark, tmp_path, vocab, modes):
    rows = written(spark, str(tmp_path / "c"), vocab, modes)
    for size in (64, 1 << 20):
        got = I.read_indexed(spark, str(tmp_path / "c"), modes, partition_bytes=size).orderBy("seq_id").collect()
        assert [(r["doc_id"], r["seq_no"], r["tokens"], r["mode"] if modes else 0) for r in got] == [
            (d, s, t, m if modes else 0) for d, s, t, m in rows
        ]
        assert [r["seq_id"] for r in got] == list(range(len(rows)))
        assert all(r["n_tokens"] == len(r["tokens"]) for r in got)


def test_second_write_adds_documents(spark, tmp_path):
    path = str(tmp_path / "c")
    part = lambda a, b: spark.createDataFrame([(d, 0, [d, d + 1]) for d in range(a, b)], "doc_id bigint, seq_no int, tokens array<int>")
    I.write_indexed(part(0, 10), path, 60000)
    I.write_indexed(part(10, 15), path, 60000)
    got = I.read_indexed(spark, path).orderBy("seq_id").collect()
    assert [(r["doc_id"], r["seq_id"], r["tokens"]) for r in got] == [(d, d, [d, d + 1]) for d in range(15)]
    I.write_indexed(part(0, 3), path, 60000, overwrite=True)
    assert I.read_indexed(spark, path).count() == 3


def test_token_beyond_the_element_type_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, [70000])], "doc_id bigint, seq_no int, tokens array<int>")
    with pytest.raises(Exception, match="don't fit"):
        I.write_indexed(df, str(tmp_path / "c"), 60000)


@pytest.mark.parametrize("code,kind", [(1, "u1"), (2, "i1"), (3, "i2"), (4, "i4"), (5, "i8"), (6, "f8"), (7, "f4"), (8, "u2")])
def test_every_element_type_is_read_as_it_is(spark, tmp_path, code, kind):
    values = np.array([1, 2, 100], "<" + kind) if kind[0] != "f" else np.array([0.5, -2.25, 1e10], "<" + kind)
    if kind == "i8":
        values[2] = 1 << 40
    prefix = str(tmp_path / "one")
    values.tofile(prefix + ".bin")
    with open(prefix + ".idx", "wb") as f:
        f.write(I.MAGIC + struct.pack("<QBQQ", 1, code, 1, 2))
        f.write(np.array([3], "<i4").tobytes() + np.array([0], "<i8").tobytes() + np.array([0, 1], "<i8").tobytes())
    (row,) = I.read_indexed(spark, prefix).collect()
    assert row["tokens"] == values.tolist()


def test_index_layout(spark, tmp_path):
    """Magic, version, element code, counts, lengths, byte pointers, document bounds."""
    df = spark.createDataFrame([(0, 0, [1, 2, 3]), (0, 1, [4]), (1, 0, [5, 6])], "doc_id bigint, seq_no int, tokens array<int>")
    I.write_indexed(df.coalesce(1), str(tmp_path / "x"), 100)
    shards = json.loads((tmp_path / "x" / I.MANIFEST).read_text())
    lengths, pointers, bounds, payload = [], [], [], []
    for s in shards:
        raw = (tmp_path / "x" / (s["name"] + ".idx")).read_bytes()
        assert raw[:9] == I.MAGIC and int.from_bytes(raw[9:17], "little") == 1 and raw[17] == 8
        n, d = (int.from_bytes(raw[a : a + 8], "little") for a in (18, 26))
        lengths += np.frombuffer(raw, "<i4", n, 34).tolist()
        pointers.append(np.frombuffer(raw, "<i8", n, 34 + 4 * n).tolist())
        bounds.append(np.frombuffer(raw, "<i8", d, 34 + 12 * n).tolist())
        payload += np.frombuffer((tmp_path / "x" / (s["name"] + ".bin")).read_bytes(), "<u2").tolist()
    assert lengths == [3, 1, 2] and payload == [1, 2, 3, 4, 5, 6]
    assert pointers in ([[0, 6, 8]], [[0, 6], [0]]) and bounds in ([[0, 2, 3]], [[0, 2], [0, 1]])


def test_one_prefix_and_missing_file(spark, tmp_path):
    rows = written(spark, str(tmp_path / "c"), 70000)
    shard = json.loads((tmp_path / "c" / I.MANIFEST).read_text())[0]
    prefix = str(tmp_path / "c" / shard["name"])
    got = I.read_indexed(spark, prefix).orderBy("seq_id").collect()
    assert [r["tokens"] for r in got] == [t for _, _, t, _ in rows][: shard["sequences"]]
    lonely = tmp_path / "lonely.bin"
    lonely.write_bytes(b"")
    with pytest.raises(Exception, match="must exist"):
        I.read_indexed(spark, str(tmp_path / "lonely")).collect()


def test_merge_rejects_other_types(spark):
    a = spark.createDataFrame([(0, 0, [1])], "doc_id bigint, seq_id bigint, tokens array<int>")
    b = a.withColumn("tokens", F.col("tokens").cast("array<bigint>"))
    with pytest.raises(ValueError):
        C.merge_corpora({"a": a, "b": b})


def test_empty_line_is_an_error(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\n\nb\n")
    with pytest.raises(Exception, match="line without tokens"):
        C.read_lines_corpus(spark, str(tmp_path / "t.txt")).collect()


def test_odd_image_bytes(spark):
    blob = bytes(range(255)) * 4 + b"abc"
    texts = spark.createDataFrame([("k", "hi"), ("e", "")], "key string, text string")
    images = spark.createDataFrame([("k", blob), ("e", b"")], "key string, content binary")
    rows = {(r["key"], r["mode"]): r["tokens"] for r in P.build_pairs(texts, images, 4, 256).collect()}
    assert rows[("k", 0)] == [104, 105, 256, 256] and rows[("e", 0)] == []
    pad, *ints = rows[("k", 1)]
    assert np.array(ints, "<i4").tobytes()[: len(blob)] == blob and pad == -len(blob) % 4
    assert rows[("e", 1)] == [0]


def test_annotations(spark, tmp_path):
    notes = [{"video": "a.mp4", "conversations": [{"from": "human", "value": "q"}], "data_source": "s"}, {"video": None}]
    (tmp_path / "a.json").write_text(json.dumps(notes))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(n) for n in notes))
    for name, array in (("a.json", True), ("b.jsonl", False)):
        rows = P.read_annotations(spark, str(tmp_path / name), array)
        assert [r["video"] for r in rows.collect()] == ["a.mp4", None]


def test_result_files(spark, tmp_path):
    (tmp_path / "r1.json").write_text(json.dumps({"loss": {"values": {"1": 2.5, "2": "nan", "3": "4"}}}))
    (tmp_path / "r2.json").write_text(json.dumps(json.dumps({"7": {"latency": 0.5, "generated_text": "x"}})))
    rows = {(r["form"], r["metric"], r["step"]): r["value"] for r in R.read_results(spark, str(tmp_path)).collect()}
    assert rows == {("training", "loss", "1"): 2.5, ("training", "loss", "3"): 4.0, ("inference", "latency", "7"): 0.5}


def test_task_store_checks(spark, tmp_path):
    samples = spark.createDataFrame([("a", [1])], "task string, token_ids array<int>")
    counts = spark.createDataFrame([("a", 1, 2, 1), ("b", 0, 1, 1)], "task string, samples bigint, seen bigint, skipped bigint")
    R.write_task_samples(samples, counts, str(tmp_path), 16)
    assert R.read_task_samples(spark, str(tmp_path), ["a"], 16).count() == 1
    for tasks, length in ((["a", "b"], 16), (["a", "z"], 16), (["a"], 32)):
        with pytest.raises(ValueError):
            R.read_task_samples(spark, str(tmp_path), tasks, length)


def test_blocks_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(40).selectExpr("id", "id div 10 AS block", "0 AS v")
    R.store_blocks(rows.filter("block <> 2"), path)
    todo = R.missing_blocks(spark, 40, 10, spark.read.parquet(path))
    assert [r["block"] for r in todo.collect()] == [2]
    R.store_blocks(rows.filter("block = 2").withColumn("v", F.lit(1)), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 40 and stored.agg(F.sum("v")).first()[0] == 10
    assert R.missing_blocks(spark, 40, 10, stored).count() == 0


def test_embedding_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(0, [5, 9]), (1, [9]), (2, [5, 6, 7, 8])], "id int, tokens array<int>")

    def encoder():
        return lambda rows: [np.array([[x, float("nan") if x == 0 else 1.0] for x in row]) for row in rows]

    got = {r["id"]: r["embedding"] for r in R.embed(df, encoder, 5, 9, 0, 2).collect()}
    assert got == {0: [5.0, 1.0], 1: [0.0, 0.0], 2: [6.0, 1.0]}


class Counting:
    """A file system whose files count the bytes that are read of each."""

    def __init__(self, inner, read):
        self.inner, self.bytes = inner, read

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def open_input_file(self, path):
        inner, count = self.inner.open_input_file(path), self.bytes

        class File:
            def read_at(self, n, at):
                count[path[-3:]] = count.get(path[-3:], 0) + n
                return inner.read_at(n, at)

            def read(self):
                return inner.read()

        return File()


@pytest.fixture
def large_corpus(spark, tmp_path):
    rows = [(d, s, [d % 200] * (50 + d % 7)) for d in range(300) for s in range(3)]
    I.write_indexed(spark.createDataFrame(rows, "doc_id bigint, seq_no int, tokens array<int>").repartition(4), str(tmp_path / "c"), 300)
    return str(tmp_path / "c"), rows


def read_here(path, monkeypatch, columns=None, filters=(), **options):
    """(rows, bytes read by file type) of the reader itself."""
    read, plain = {}, I._fs
    monkeypatch.setattr(I, "_fs", lambda p: (lambda fs: (Counting(fs[0], read), fs[1]))(plain(p)))
    reader = I._PushingReader({"path": path, "partition_bytes": "4000", **options}, columns)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    monkeypatch.setattr(I, "_fs", plain)
    return rows, read


def test_only_the_bytes_of_the_wanted_documents_are_read(large_corpus, monkeypatch):
    path, rows = large_corpus
    every, all_bytes = read_here(path, monkeypatch)
    assert len(every) == 900 and all_bytes["bin"] == 2 * sum(len(t) for *_, t in rows)
    conditions = [
        ([I.EqualTo(("doc_id",), 150)], {150}),
        ([I.GreaterThan(("doc_id",), 20), I.LessThanOrEqual(("doc_id",), 23)], {21, 22, 23}),
        ([I.GreaterThanOrEqual(("doc_id",), 298)], {298, 299}),
        ([I.In(("doc_id",), (7, 9))], {7, 8, 9}),
        ([I.LessThan(("doc_id",), 0)], set()),
        ([I.EqualTo(("doc_id",), 10**15)], set()),
    ]
    for filters, wanted in conditions:
        got, read = read_here(path, monkeypatch, filters=filters)
        assert sorted((r["doc_id"], r["seq_no"], r["tokens"]) for r in got) == sorted(r for r in rows if r[0] in wanted)
        assert read.get("bin", 0) == 2 * sum(len(t) for d, _, t in rows if d in wanted)
        assert read.get("idx", 0) < 12_000
    got, read = read_here(path, monkeypatch, filters=[I.GreaterThanOrEqual(("seq_id",), 100), I.LessThan(("seq_id",), 105)])
    assert [r["seq_id"] for r in got] == list(range(100, 105)) and read["bin"] < 5 * 2 * 60
    other = I.EqualTo(("n_tokens",), 50)
    assert len(read_here(path, monkeypatch, filters=[other])[0]) == 900  # left to Spark


def test_no_payload_without_tokens(spark, large_corpus, monkeypatch):
    path, rows = large_corpus
    got, read = read_here(path, monkeypatch, columns=["n_tokens", "doc_id"])
    assert "bin" not in read and sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((d, len(t)) for d, _, t in rows)
    df = I.read_indexed(spark, path, columns=["doc_id", "n_tokens"], doc_ids=(10, 12))
    assert sorted(map(tuple, df.collect())) == sorted((d, len(t)) for d, _, t in rows if 10 <= d < 12)


def test_conditions_are_pushed_where_the_session_allows(spark, large_corpus):
    path, rows = large_corpus
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = I.read_indexed(spark, path, partition_bytes=2000).filter("doc_id between 40 and 41 and n_tokens > 0")
        assert sorted((r["doc_id"], r["seq_no"], r["tokens"]) for r in df.collect()) == sorted(r for r in rows if r[0] in (40, 41))
        assert df.rdd.getNumPartitions() <= 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
