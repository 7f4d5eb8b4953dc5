"""Quality and toxicity: held-out accuracy, folds, bounds and odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import labelled, quality, toxicity
from weft.llm.wordgrams import features, per_word

FOLDER = "/root/testdata/sf0.1"


def rows(n=600, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "ou", "re", "ing", "é"]) for _ in range(rng.randint(1, 4)))
    out, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(3, 60))]
        bad, rude = rng.random() < 0.4, rng.random() < 0.3
        if bad:
            w = [x.upper() + "!!" for x in w] if rng.random() < 0.5 else [x for x in w for _ in range(6)]
        if rude:
            w.insert(rng.randint(0, len(w)), rng.choice(["scumbag", "idiot", "crétin"]))
        out.append((i, " ".join(w)))
        if rng.random() < 0.8:
            labels.append((i, int(not bad), int(rude)))
    return out, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(i, t, 1, 0.5) for i, t in docs], "doc_id bigint, text string, label int, score double")
    return d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("make,label,folds,out", [(quality.quality, 1, 3, 1), (toxicity.toxicity, 2, 5, 0)])
def test_held_out_rows_are_told_apart(spark, make, label, folds, out):
    docs, labels = rows()
    extra = [(None, "no id"), (700, None), (701, ""), (702, "word " * 20_000), (3, "twin"), (3, "twin")]
    got = make(*frames(spark, docs + extra, [*labels, (None, 1, 1), (900, None, None), (901, 1, 0)])).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {r[0]: r[label] for r in labels}
    right = []
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is None:
            assert r["held_out"] is False
            continue
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out)
        if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 3:
            right.append(r["predicted"] == truth[r["doc_id"]])
    assert np.mean(right) > 0.95
    empty = [r["score"] for r in got if r["doc_id"] in (700, 701)]
    assert empty[0] == empty[1]
    # held-out labels change nothing
    turned = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % folds == out else (i, q, t) for i, q, t in labels]
    again = make(*frames(spark, docs + extra, turned)).collect()
    key = lambda r: (str(r["doc_id"]), r["score"])
    assert sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("make", [quality.quality, toxicity.toxicity])
def test_few_labels(spark, make):
    docs, _ = rows(20)
    d, none = frames(spark, docs, [])
    assert {r["score"] for r in make(d, none).collect()} == {0.5}
    _, same = frames(spark, docs, [(i, 1, 1) for i in range(20)])
    assert len({round(r["score"], 12) for r in make(d, same).collect()}) == 1
    assert make(d.limit(0), none).collect() == []


def test_sample_keeps_its_bounds(spark):
    docs, labels = rows(400)
    d, lab = frames(spark, docs, labels)
    some = labelled.labelled_sample(d.repartition(5), lab, "toxic", F.lit(True), rows=30, characters=8_000)
    assert sum(some.label == 1) <= 30 and sum(some.label == 0) <= 30
    assert sum(len(t) for t in some.text.to_pylist()) <= 8_000
    again = labelled.labelled_sample(d.repartition(3), lab, "toxic", F.lit(True), rows=30, characters=8_000)
    assert some.text.to_pylist() == again.text.to_pylist()


def test_rejected_documents_go(spark):
    docs, labels = rows()
    d, lab = frames(spark, docs, labels)
    model = quality.fit(d, lab)
    kept = quality.keep(d, model)
    assert kept.columns == d.columns
    want = {r["doc_id"] for r in quality.quality(d, lab).collect() if r["predicted"] == 1}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_slices_are_scored_alike():
    docs, labels = rows(120)
    sample = labelled.Sample(pa.array([t for _, t in docs], pa.large_string()), np.array([i % 2 for i, _ in docs], float))
    column = pa.array([t for _, t in docs], pa.string())
    for model in (quality.train(sample, epochs=1), toxicity.train(sample)):
        parts = [model.scores(column.slice(a, 11)) for a in range(0, len(column), 11)]
        assert np.allclose(np.concatenate(parts), model.scores(column), rtol=1e-12)


def test_features_are_the_ngrams():
    words = pa.array(["", "a", "été", "Straße", "日本", "aaaa"])
    found, bounds = features(words, 2, 4, 18, whole=True)
    for w, a, b in zip(words.to_pylist(), bounds[:-1], bounds[1:]):
        full = f"<{w}>"
        assert b - a == 1 + sum(max(len(full) - k + 1, 0) for k in range(2, 5))
    single, _ = features(pa.array(["été"]), 2, 4, 18, whole=True)
    assert single.tolist() == found[bounds[2] : bounds[3]].tolist()
    assert per_word(np.ones(len(found)), bounds).tolist() == np.diff(bounds).tolist()


def test_given_tables_are_told_apart(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for made, label, least in ((quality.quality(docs, labels), "quality", 0.98), (toxicity.toxicity(docs, labels), "toxic", 0.97)):
        held = made.filter("held_out").join(labels, "doc_id")
        assert held.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least
