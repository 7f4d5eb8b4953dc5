"""FM-index and decontamination, nearest neighbours: beside plain search."""

import hashlib
import random
import re

import numpy as np
import pytest

from weft.llm import decontaminate as D
from weft.llm import neighbours as N
from weft.llm.fmindex import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_index_finds_every_occurrence():
    rng = random.Random(1)
    for _ in range(150):
        n, size = rng.randint(1, 70), rng.randint(2, 6)
        text = np.array([rng.randint(1, size) for _ in range(n)])
        closed = [*text.tolist(), 0]
        assert suffix_array(np.array(closed)).tolist() == sorted(range(n + 1), key=lambda i: closed[i:])
        index = FMIndex(text, size + 1, sample=rng.randint(1, 9))
        phrases = [[rng.randint(0, size) for _ in range(rng.randint(1, 5))] for _ in range(15)]
        rows = np.zeros((15, 5), int)
        for i, p in enumerate(phrases):
            rows[i, : len(p)] = p
        lo, hi = index.search(rows, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(n - len(p) + 1) if text[i : i + len(p)].tolist() == p] if min(p) else []
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(rows, items, window=10):
    phrases = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window + 1, 1 if w else 0)):
            phrases.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for p, names in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= names
        out.append((str(doc), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def case():
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "é", "日本", "x1", "and", "in", "zz", "q"])
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 16)))) for i in range(25)]
    items += [(3, "same id other words"), (None, "item without id here"), (30, None), (31, "!!!"), (32, "the")]
    rows = []
    for i in range(120):
        parts = [word() if rng.random() < 0.7 else rng.choice(["other", "A-b", "Ünder"]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), rng.choice(items)[1] or "")
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(parts).upper() if rng.random() < 0.3 else " ".join(parts)))
    rows += [(None, "the of"), (7, "the"), (7, "the"), (500, None), (501, ""), (502, "the " * 20_000), (503, "| --"), (504, items[0][1])]
    return rows, items


def frames(spark, rows, items):
    docs = spark.createDataFrame([(d, t, 1, "q") for d, t in rows], "doc_id bigint, text string, n_words int, spans string")
    return docs, spark.createDataFrame(items, "item_id bigint, text string")


def test_decontamination_equals_plain_search(spark, monkeypatch):
    rows, items = case()
    docs, bench = frames(spark, rows, items)
    want = brute(rows, items)
    for item_bytes in (8 << 20, 60):  # one block of items, and many
        monkeypatch.setattr(D, "ITEM_BYTES", item_bytes)
        got = D.decontaminate(docs.repartition(4), bench).collect()
        assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == want


def test_spans_cover_the_hit_words(spark):
    rows, items = case()
    docs, bench = frames(spark, rows, items)
    for r in D.decontaminate(docs, bench, with_spans=True).collect():
        inside = sum(len(words(r["text"][s["start"] : s["end"]])) for s in r["spans"])
        assert inside == r["n_hit"] and (r["n_hit"] > 0) == bool(r["spans"])
        if r["spans"]:
            assert len(words(D.remove_spans(r["text"], [(s["start"], s["end"]) for s in r["spans"]]))) == r["n_words"] - r["n_hit"]
    kept = D.cleaned(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(r[0] for r in brute(rows, items) if not r[1] == r[2] > 0)


def test_nothing_to_search(spark):
    rows, items = case()
    docs, bench = frames(spark, rows, items)
    none = D.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)
    assert D.decontaminate(docs.limit(0), bench).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r") for i, v in rows], "vec_id bigint, embedding array<float>, size int, rank string")


def exact_top(rows, k, every):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            near = sorted((-float((x * y).sum()), i) for i, y in good if i != q and len(y) == len(x))
            out.setdefault(q, near[:k])
    return out


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((30, 32))
    rows = [(i, (centres[i % 30] + rng.standard_normal(32)).tolist()) for i in range(4000)]
    got = {}
    for r in N.nearest(vectors(spark, rows).repartition(2), block_rows=1500).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact_top(rows, 20, 20)
    assert set(got) == set(want)
    hit = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hit += len({m[1] for m in mine} & {i for _, i in near})
    assert hit / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    ids, every = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(float)
    got = {}
    for r in N.nearest(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in ids[ids % 20 == 0].tolist():
        score = every @ every[ids == q][0]
        near = [i for i in ids[np.lexsort((ids, -score))].tolist() if i != q][:20]
        recall.append(len(got[q] & set(near)) / 20)
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.75


def uneven(rng):
    return rng.standard_normal((6_000, 64)) * np.exp(rng.standard_normal(6_000))[:, None]


@pytest.mark.parametrize(
    "make, most",
    [
        (lambda rng: rng.standard_normal((16_384, 128)) / 11, 0.25),
        (lambda rng: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.standard_normal((16_384, 128))), 0.10),
        (lambda rng: np.vstack([10 * rng.standard_normal((1, 64)), (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.standard_normal((9_999, 64)))]), 0.10),
        (uneven, 1.0),
    ],
)
def test_recall_and_share_verified_in_a_block(make, most):
    every = make(np.random.default_rng(7))
    ids = np.arange(len(every))
    blocks = [(own, vectors, N.Lines(vectors)) for own, vectors in N.by_length([(ids, every)])]
    recall, verified = [], []
    for q in range(0, len(every), len(every) // 40):
        found = np.concatenate([own[index.candidates(every[q], 21)] for own, _, index in blocks])
        score = every @ every[q]
        score[q] = -np.inf
        near = np.argsort(-score, kind="stable")[:20]
        recall.append(len(np.intersect1d(found, near)) / 20)
        verified.append(len(found) / len(every))
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.75
    assert np.mean(verified) <= most


def test_odd_vectors(spark):
    """Null, zero, unfinished and unequal vectors, copies and ties, fewer candidates than asked for."""
    rows = [(i, [1.0, float(i % 3)]) for i in range(15)] + [(20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, []), (None, [1.0, 1.0])]
    rows += [(140, [1.0, 2.0, 3.0]), (160, [-1.0, -2.0, 3.0]), (0, [1.0, 0.0])]
    got = {}
    for r in N.nearest(vectors(spark, rows), k=5).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    want = exact_top(rows, 5, 20)
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert N.nearest(vectors(spark, rows).limit(0)).collect() == []
