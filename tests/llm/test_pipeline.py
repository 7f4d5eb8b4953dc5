"""The corpus pipeline beside the same stages in plain Python."""

import random
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_jaccard import sets
from tests.llm.test_pii import base
from weft import session
from weft.llm import pii, quality
from weft.llm.encoding import default_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def made():
    """(documents, labels, benchmark): good and bad prose, copies, benchmark passages, addresses, odd rows."""
    rng = random.Random(12)
    good = [f"{a}{b}" for a in ("mor", "lan", "ter", "sil", "ven") for b in ("dale", "wick", "ford", "holm", "gate", "mere")]
    prose = lambda n: " ".join(rng.choice(good) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["buy", "now", "click", "$$$", "win"]) for _ in range(n))
    items = [(i, prose(14)) for i in range(4)] + [(9, "two words")]
    docs, labels = [], []
    for i in range(90):
        bad = i % 3 == 0
        docs.append((i, junk(rng.randint(20, 80)) if bad else prose(rng.randint(30, 200))))
        labels.append((i, int(not bad)))
    twins = [d for d in docs if d[0] % 3][:12]
    docs += [(200 + i, t) for i, (_, t) in enumerate(twins[:5])]  # copies
    docs += [(300 + i, f"{t} {rng.choice(good)}") for i, (_, t) in enumerate(twins[5:9])]  # near copies
    docs += [(400, f"{prose(40)} {items[0][1]} {prose(30)}"), (401, items[1][1].upper()), (402, f"{prose(20)}, {items[2][1].replace(' ', ', ')}")]
    docs += [(500, f"{prose(30)} write to joe@site.org or call +1 (555) 123-4567 {prose(20)}"), (501, f"{prose(25)} 10.0.0.1 {prose(25)}")]
    docs += [(600, prose(6_000)), (None, prose(50)), (20, prose(45)), (700, None), (701, "")]
    return docs, labels, items


def without_passages(text, items):
    phrases = set()
    for _, t in items:
        w = WORD.findall(lower(t or ""))
        phrases |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} if w else set()
    found = [(m.group(), m.start(), m.end()) for m in WORD.finditer(lower(text))]
    words, hit = [f[0] for f in found], set()
    for p in phrases:
        for i in range(len(words) - len(p) + 1):
            if tuple(words[i : i + len(p)]) == p:
                hit |= set(range(i, i + len(p)))
    if words and len(hit) == len(words):
        return None
    for i in sorted(hit, reverse=True):  # a run of words goes from its first to its last
        start = found[i][1]
        end = found[i + 1][1] if i + 1 in hit else found[i][2]
        text = text[:start] + text[end:]
    return text


def without_personal(text):
    out, at = "", 0
    for k, a, b in sorted(base(text), key=lambda s: (s[1], -s[2])):
        assert a >= at
        out, at = out + text[at:a] + pii.LABELS[k], b
    return out + text[at:]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    docs, labels, items = made()
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def test_run_equals_the_stages_in_plain_python(spark, folder):
    from tokenizers import Tokenizer

    docs, _, items = made()
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.scores(pa.array([t for _, t in docs], pa.string()))
    kept = [d for d, s in zip(docs, scores) if s >= 0.5]
    assert {i for i, _ in kept} >= {1, 2, 200, 300, 400, 500, 600} and not any(i in (0, 3, 6) for i, _ in kept)
    every = [sets(t) for _, t in kept]
    group = list(range(len(kept)))
    for i, a in enumerate(every):
        for j in range(i):
            if a and every[j] and 100 * len(a & every[j]) >= 75 * len(a | every[j]):
                group = [group[j] if g == group[i] else g for g in group]
    chosen = []
    for g in sorted(set(group)):
        members = [kept[i] for i in range(len(kept)) if group[i] == g]
        chosen.append(min(members, key=lambda d: (d[0] is None, d[0] or 0)))
    cleaned = [(i, None if t is None else without_passages(t, items)) for i, t in chosen]
    cleaned = [(i, t) for (i, t), (_, before) in zip(cleaned, chosen) if t is not None or before is None]
    last = [(i, None if t is None else without_personal(t)) for i, t in cleaned]
    tokenizer = Tokenizer.from_file(default_path())
    want = []
    for i, t in last:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(str(i), p, ids[a : a + 4096]) for p, a in enumerate(range(0, len(ids), 4096))]
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["ids"]) for r in out) == sorted(want)
    used = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 4096


def test_stages_that_leave_nothing_and_repeated_rows(spark, tmp_path):
    rows = [(7, "the same text of a few words in two rows", "en", "s", 40)] * 2
    for name, given in (("none", []), ("twice", rows)):
        place = str(tmp_path / name)
        spark.createDataFrame(given, COLUMNS).write.parquet(f"{place}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{place}/benchmark.parquet")
        out = corpus_pipeline.run(spark, place).collect()
        assert [r["doc_id"] for r in out] == ([7] if given else [])
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]


def test_a_stage_called_alone_takes_batches_by_bytes(spark):
    spark.conf.unset(session.BATCH_SETTING)
    sizes = corpus_pipeline._sized(lambda spark, docs, folder: spark.conf.get(session.BATCH_SETTING))(spark, None, "")
    assert sizes == str(session.BATCH_BYTES)
