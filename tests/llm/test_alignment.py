"""Alignment beside a plain walk with both tokenizers over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import alignment as al

SCHEMA = "doc_id bigint, text string, block int, keys string"
WORDS = ["The", "don't", "tokenizers", "naïve", "日本語", "🙂🙂", "x1y2", "3.14159", "<s>", "</s>", "<|endoftext|>", "<0x41>", "ﬁ", "é́", "...", "_a", "--"]


def made(n=60, seed=2):
    rng = random.Random(seed)
    gaps = [" "] * 12 + ["  ", "\n", " \n ", "\t", " ", "  ", ""]
    out = ["".join(rng.choice(WORDS) + rng.choice(gaps) for _ in range(rng.randint(1, 25))) for _ in range(n)]
    return [*out, None, "", " ", "   ", "\n", "a", " a", "a ", "▁", "x ▁ y", "b▁", "plain words here", "　wide", "q" * 5_000, "<unk> a", "\x00 nul", "a\x85 b"]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = al.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


def walk(text, tokenizers):
    """(A ids, B ids, groups as lists of ids) of a text; None without tokens."""
    a, b = tokenizers
    if not text:
        return None
    letters = al.letters_of_bytes()
    want = (" " + text).encode()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = []
    for i in b_ids:
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return None
    ends = set(np.cumsum(list(map(len, a_bytes))).tolist()) & set(np.cumsum(list(map(len, b_bytes))).tolist())
    groups, i, j, at_a, at_b = [], 0, 0, 0, 0
    for end in sorted(ends):
        own, other = [], []
        while at_a < end:
            own.append(a_ids[i])
            at_a += len(a_bytes[i])
            i += 1
        while at_b < end:
            other.append(b_ids[j])
            at_b += len(b_bytes[j])
            j += 1
        groups.append((own, other))
    return a_ids, b_ids, groups


def expected(given, tokenizers):
    walks = [(i, walk(t, tokenizers)) for i, t in given]
    links = [Counter((a, b) for own, other in w[2] for a in own for b in other) if w else Counter() for _, w in walks]
    count = Counter(p for each in links for p in each)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (i, w), each in zip(walks, links):
        if w is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, own)) + "|" + ",".join(map(str, other)) for own, other in w[2])
        best = sum(n for p, n in each.items() if count[p] == most[p[0]])
        out.append((i, len(w[0]), len(w[1]), len(w[2]), sum(each.values()), best, sum(n * count[p] for p, n in each.items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str), count, most


def test_equals_the_plain_walk(spark, tokenizers):
    given = list(enumerate(made())) + [(3, "plain words here"), (3, "plain words here"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in given], SCHEMA).repartition(3)
    want, count, most = expected(given, tokenizers)
    out = al.align(df)
    assert out.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r)[:8] for r in out.collect()), key=str) == want
    pairs = {(r["a"], r["b"]): (r["count"], r["best"]) for r in al.linked_ids(df).collect()}
    assert pairs == {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_no_documents(spark):
    assert al.align(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_texts_without_tokens(spark):
    out = al.align(spark.createDataFrame([(1, None, 0, ""), (2, "▁", 0, "")], SCHEMA)).collect()
    assert sorted(tuple(r) for r in out) == [(1, 0, 0, 0, 0, 0, 0, "", 0), (2, 0, 0, 0, 0, 0, 0, "", 0)]


def test_pieces_one_by_one_give_the_same(monkeypatch):
    aligner = al.Aligner(*al.default_paths())
    _, _, distinct = al.pieces_of(pa.array([t for t in made(40, 9)]))
    together = aligner.pieces(distinct)
    monkeypatch.setattr(al, "TOGETHER", 1)
    single = aligner.pieces(distinct)
    for name, value in vars(together).items():
        other = getattr(single, name)
        assert value.equals(other) if name == "groups" else np.array_equal(value, other), name


def test_row_product_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    left, right = rng.integers(0, 3, (30, 20)) * (rng.random((30, 20)) < 0.3), rng.integers(0, 4, (20, 25)) * (rng.random((20, 25)) < 0.3)

    def rows(m):
        bounds = np.concatenate(([0], np.cumsum((m != 0).sum(axis=1))))
        return al.Rows(bounds, np.nonzero(m)[1], m[m != 0], m.shape[1])

    def dense(r):
        out = np.zeros((r.height, r.width), dtype=np.int64)
        out[np.repeat(np.arange(r.height), np.diff(r.bounds)), r.columns] = r.values
        return out

    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(al, "PRODUCTS", size)
        assert (dense(rows(left).times(rows(right))) == left @ right).all()
    assert (dense(rows(left).transposed()) == left.T).all()


def test_overlaps_by_hand():
    links = al.overlaps(np.array([3, 1, 2]), np.array([2, 2, 1, 1]))
    dense = np.zeros((3, 4), dtype=int)
    dense[np.repeat(np.arange(3), np.diff(links.bounds)), links.columns] = links.values
    assert dense.tolist() == [[2, 1, 0, 0], [0, 1, 0, 0], [0, 0, 1, 1]]
    of_a, of_b = al.groups_of(links)
    assert of_a.tolist() == [0, 0, 1] and of_b.tolist() == [0, 0, 1, 1]
