"""The shingle join beside all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import jaccard
from weft.llm.arrow import gathered
from weft.llm.components import components

BLANKS = " \t\n\v\f\r"


def sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANKS:
        low = low.replace(b, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Components over all pairs of rows; a component's id is its least id."""
    every = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(every):
        for j in range(i):
            b = every[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(s), str(least.get(root(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, every)))


def corpus(seed=0):
    """Chains of near copies, copies, a passage in many texts, common words, short texts."""
    rng = random.Random(seed)
    word = lambda k=60: f"w{int(rng.random() ** 2 * k)}"
    passage = " ".join(f"p{i}" for i in range(40))
    out = []
    for _ in range(12):
        base = [word(500) for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 10)):
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = word(500)
            out.append(" ".join(base))
            if rng.random() < 0.3:
                out.append(" ".join(base).upper().replace(" ", rng.choice(BLANKS)))
    for _ in range(30):
        head = [word(2000) for _ in range(rng.randint(0, 40))]
        out.append(" ".join([*head, passage, *[word(2000) for _ in range(rng.randint(0, 30))]]))
    out += [" ".join(word(3) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    out += ["", None, "one", "One", "a b c d", "A\tB c D", " ".join(["la"] * 5000), " ".join(["la"] * 7), "ä é", "Ä é", "x" * 50_000]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    wide = [(d, t, 7, "z", b"q") for d, t in rows]
    return spark.createDataFrame(wide, "doc_id bigint, text string, n int, hood string, class binary")


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 4)
    monkeypatch.setattr(jaccard, "SLICE_BYTES", 700)  # many slices of a batch
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 3000)
    rows = [(i * 13 % 997, t) for i, t in enumerate(corpus(seed))] + [(None, "no id but a text of many words here"), (5, "twin id"), (5, "a b c d")]
    got = jaccard.jaccard_components(frame(spark, rows).repartition(6))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == brute(rows)


def contending(docs, ranges):
    homes = jaccard.class_table(jaccard.set_table(docs))[1]
    return jaccard.contenders(jaccard.shared_postings(jaccard.dealt_postings(docs, ranges)), homes)


def test_only_shingles_of_other_classes_are_shared(spark, monkeypatch):
    """Copies in many blocks share nothing with each other; what contends is what all pairs of classes share."""
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 900)
    copies = [(i, " ".join(f"k{j}" for j in range(50))) for i in range(40)]
    rows = copies + [(100 + i, t) for i, t in enumerate(corpus(2))]
    docs = frame(spark, rows).repartition(5)
    table = contending(docs, 7).collect()
    names = jaccard.set_table(docs).filter("n > 0").dropDuplicates(["class"]).collect()
    every = {bytes(r["class"]): sets(dict(rows)[r["doc_id"]]) for r in names}
    holders = {}
    for c, own in every.items():
        for x in own:
            holders.setdefault(x, set()).add(c)
    shared = {c: sum(len(holders[x]) > 1 for x in own) for c, own in every.items()}
    got = {bytes(r["class"]): r for r in table}
    assert len(got) == len(table)
    for c, own in every.items():
        n, q = len(own), len(own) - -(-75 * len(own) // 100) + 1 - (len(own) - shared[c])
        assert (c in got) == (q >= 1 and n >= 3)
        if c in got:
            assert got[c]["q"] == q and len(got[c]["hashes"]) == shared[c]


def test_documents_that_change_between_scans_are_an_error(spark):
    docs = frame(spark, list(enumerate(corpus(5)))).repartition(3)
    homes = jaccard.class_table(jaccard.set_table(docs))[1]
    other = jaccard.shared_postings(jaccard.dealt_postings(docs.orderBy("doc_id").coalesce(1), 4))
    with pytest.raises(Exception, match="other partitions"):
        jaccard.contenders(other, homes).collect()


def test_blocks_find_what_hubs_miss(spark):
    """A chain whose ends share less than the threshold, more members than a block holds."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(60)] + [(100 + i, " ".join(words[:100]) + f" e{i}") for i in range(20)]
    table = contending(frame(spark, rows), 8)
    tied = jaccard.ties(table, jaccard.boundary(table))
    hood = components(tied).selectExpr("node as class", "component as hood")
    alone = hood.selectExpr("class", "hood", "class as joined")
    found = jaccard.block_links(table, alone, members=8)
    part = {bytes(r[0]): bytes(r[1]) for r in components(found).collect()}
    assert len(set(part.values())) == len({c for *_, c in brute(rows)}) == 1


def test_every_size_takes_either_road(spark):
    """Whatever the boundary, the candidates of linked classes are in one neighbourhood."""
    rows = [(i, t) for i, t in enumerate(corpus(3))]
    docs = frame(spark, rows)
    classes = jaccard.set_table(docs).filter("n > 0").dropDuplicates(["class"])
    table = contending(docs, 5).cache()
    by_class = {bytes(r["class"]): rows[r["doc_id"]][1] for r in classes.collect()}
    every = {k: sets(v) for k, v in by_class.items()}
    linked = [(a, b) for a in every for b in every if a < b and 100 * len(every[a] & every[b]) >= 75 * len(every[a] | every[b])]
    assert linked
    for edge in (0, 8, 40, 10**6):
        hood = {bytes(r[0]): bytes(r[1]) for r in components(jaccard.ties(table, edge)).collect()}
        assert all(hood[a] == hood[b] for a, b in linked)


def test_representatives_keep_all_columns(spark):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, ""), (9, None), (4, "A b c d e f g h"), (7, "else")]
    got = jaccard.representatives(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "n", "hood", "class"]
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 7, 9]


def test_representatives_are_one_row_of_each_component(spark):
    """Null ids, repeated rows, and one id with two texts."""
    near = [" ".join(f"w{j}" for j in range(60)), " ".join(f"w{j}" for j in range(58))]
    rows = [(None, "only text without id here"), (None, "only text without id here")]  # copies without id
    rows += [(None, "another one that has no id")]
    rows += [(None, near[0]), (None, near[1])]  # linked, no id
    rows += [(3, "one two three four five six"), (3, "one two three four five six")]  # repeated row
    rows += [(4, "text B of two rows in all"), (5, "text B of two rows in all"), (5, "text C of its own")]
    rows += [(None, "text C of its own"), (2, ""), (2, ""), (None, None)]
    got = [(r["doc_id"], r["text"]) for r in jaccard.representatives(frame(spark, rows).repartition(4)).collect()]
    linked = [g for g in got if g[1] in near]
    assert len(linked) == 1 and linked[0][0] is None
    want = [(None, "only text without id here"), (None, "another one that has no id"), (3, "one two three four five six")]
    want += [(4, "text B of two rows in all"), (5, "text C of its own"), (2, ""), (2, ""), (None, None)]
    assert sorted(map(str, got)) == sorted(map(str, want + linked))


@pytest.mark.parametrize("seed", [1])
def test_representatives_equal_all_pairs(spark, seed):
    rows = [(i * 13 % 997, t) for i, t in enumerate(corpus(seed))]
    want = sorted(str(d) for d, n, c in brute(rows) if n == 0 or d == c)
    got = jaccard.representatives(frame(spark, rows).repartition(6))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == want


def test_empty_table(spark):
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    order = rng.sample(range(500), 500)
    edges = [(a, b) for a, b in zip(order[:300], order[1:300])] + [(a, b) for a, b in zip(order[300:], order[301:])] + [(1, 1)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(got[x] == min(order[:300]) for x in order[:300]) and all(got[x] == min(order[300:]) for x in order[300:])


def test_slices_give_the_same_sets():
    texts = pa.array([t for t in corpus(4)], pa.string())
    whole = [s.tolist() for s in jaccard.shingles(texts)]
    assert [s.tolist() for a in range(0, len(texts), 7) for s in jaccard.shingles(texts.slice(a, 7))] == whole
    assert [len(s) for s in whole] == [len(sets(t)) for t in texts.to_pylist()]


def test_prefix_is_long_enough():
    n = np.arange(1, 200)
    for size, p in zip(n.tolist(), jaccard.prefix(n).tolist()):
        least = min(-(-75 * (size + other) // 175) for other in range(-(-75 * size // 100), size * 100 // 75 + 1))
        assert p >= size - least + 1


def test_blocks_depend_on_the_texts_alone():
    rng = random.Random(4)
    texts = [rng.choice([None, "", "x" * rng.randint(1, 90), "y" * 400]) for _ in range(300)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["doc_id", "text"])
    made = []
    for step in (1, 7, 50, 299, 300):
        batches = (rows.slice(i, step) for i in range(0, 300, step))
        made.append([b.column("doc_id").to_pylist() for b in gathered(batches, "text", 200)])
    assert all(m == made[0] for m in made) and len(made[0]) > 50 and sum(made[0], []) == list(range(300))
    sizes = [[len(texts[i] or "") for i in block] for block in made[0]]
    assert all(sum(s) <= 200 or sum(map(bool, s)) == 1 for s in sizes)


def test_representatives_of_several_blocks_in_batches_by_bytes(spark, tmp_path):
    """The set table carries a row number and the postings don't, so that batches cut by bytes differ between the scans."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=8)) for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(150, 350)))) for i in range(4000)]
    docs += [(5000 + i, docs[i * 37][1]) for i in range(60)]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    left = jaccard.representatives(spark.read.parquet(str(tmp_path / "d")))
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == list(range(4000))
