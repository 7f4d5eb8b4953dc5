"""Encoding, token files, length counts and packing, beside the tokenizer itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import encoding, lengths, packing, tokenfile
from weft.llm.encoding import WordEncoder, default_path

WORDS = ["The", "don't", "we'll", "x", "ÉTÉ", "über", "İstanbul", "ΣΑΣ", "日本語", "a1b2", "3.14", "...", "!!", "(ok)", "-", "'s", "<|endoftext|>", "|x|", "é́", "J̌", " ", "\t", "\x1c", "\r\n", "🙂", "ﬁ", "##a##", "'", "naïve,", " "]


def texts(n=200, seed=5):
    rng = random.Random(seed)
    made = ["".join(rng.choice(WORDS) + rng.choice([" ", "\n", "", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*made, "", None, " ", "\n\n", "word " * 30_000, "x" * 20_000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def test_words_together_equal_the_tokenizer(tokenizer):
    every = texts()
    ids, bounds = WordEncoder(default_path()).encode(pa.array(every, pa.string()))
    for i, t in enumerate(every):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_slices_of_a_batch_are_encoded_alike():
    every = pa.array(texts(60), pa.string())
    encoder = WordEncoder(default_path())
    ids, bounds = encoder.encode(every)
    parts = [encoder.encode(every.slice(a, 9)) for a in range(0, len(every), 9)]
    assert np.concatenate([p[0] for p in parts]).tolist() == ids.tolist()
    assert np.concatenate([np.diff(p[1]) for p in parts]).tolist() == np.diff(bounds).tolist()


def test_a_word_is_looked_up_once_in_all_its_spellings(tokenizer):
    """A batch costs Python a step for each word, not for each spelling with the punctuation around it."""
    every = ["house House, (HOUSE) house! house. ;house: Ähre ähre, don't DON'T, \u212aelvin kelvin", "house, 'house"]
    encoder, given = WordEncoder(default_path()), []
    cores = encoder._cores
    encoder._cores = lambda pieces: given.append(list(pieces)) or cores(pieces)
    ids, bounds = encoder.encode(pa.array(every, pa.string()))
    assert [len(g) for g in given] == [len(set(given[0]))] and given[0].count("house") == 1 and len(given[0]) == 7
    for i, t in enumerate(every):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_a_worker_remembers_the_words_that_keep_coming_and_few_others(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 40)
    encoder, given = WordEncoder(default_path()), []
    letters = encoder._letters
    encoder._letters = lambda pieces: given.extend(pieces) or letters(pieces)
    for i in range(20):
        rare = [f"x{chr(97 + i)}{chr(97 + j)}" for j in range(10)]
        encoder.encode(pa.array([" ".join(["house", *rare, "q" * 300])]))
        assert len(encoder.cores) <= 60 and max(map(len, encoder.cores.newer)) < 300
    assert given.count("house") == 1 and given.count("xab") == 1


def test_the_tokenizer_gets_a_bounded_number_of_words_in_a_call(tokenizer, monkeypatch):
    monkeypatch.setattr(encoding, "CALL", 1000)
    plain = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(2600)]
    text = " ".join([*plain, *[f"{i}x" for i in range(2600)]])
    encoder, sizes = WordEncoder(default_path()), []

    class Spy:
        def encode_batch_fast(self, pieces, **options):
            sizes.append(sum(len(p.split()) for p in pieces))
            return tokenizer.encode_batch_fast(pieces, **options)

    encoder.tokenizer = Spy()
    assert encoder.encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert max(sizes) <= 1000 and sum(sizes) == 5200


def frame(spark, rows, extra=True):
    if not extra:
        return spark.createDataFrame(rows, "doc_id bigint, text string")
    wide = [(d, t, "x", 1, 2, 3) for d, t in rows]
    return spark.createDataFrame(wide, "doc_id bigint, text string, start string, length int, __r int, shard int")


def test_token_files_round_trip(spark, tmp_path, tokenizer):
    rows = [(i * 7 % 400, t) for i, t in enumerate(texts(100))] + [(None, "no id"), (3, "twin"), (3, "twin")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards
    try:
        manifest = tokenfile.write_tokens(frame(spark, rows).repartition(5), str(tmp_path / "t"), file_tokens=2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = tokenfile.read_tokens(manifest, with_ids=True).orderBy("start").collect()
    assert len(got) == len(rows) and manifest.count() > 5
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    want = sorted((d if d is not None else -1, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r["ids"])) for r in got) == want
    flat = [i for r in got for i in r["ids"]]
    places = random.Random(1).sample(range(len(flat)), 300) + [0, len(flat) - 1]
    asked = spark.createDataFrame([(p,) for p in [*places, -1, len(flat), None]], "position bigint")
    found = {r["position"]: r["token"] for r in tokenfile.lookup(tokenfile.read_manifest(spark, str(tmp_path / "t")), asked).collect()}
    assert found == {p: flat[p] for p in places}


def test_wide_ids_take_more_levels():
    ids = np.array([0, 255, 256, 65_535, 65_536, 1 << 24, (1 << 32) - 1, 7] * 300, dtype=np.uint32)
    import io

    file = tokenfile.TokenFile(io.BytesIO(tokenfile.to_bytes([1], np.array([0, len(ids)]), ids)))
    assert file.all().tolist() == ids.tolist() and len(file.levels) == 4
    assert [file.token(i) for i in range(0, len(ids), 37)] == ids[::37].tolist()
    with pytest.raises(IndexError):
        file.token(len(ids))


def test_length_table_equals_counting(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(texts(120))] + [(1, None), (None, "a b")]
    table = lengths.token_counts(frame(spark, rows)).cache()
    n = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    for r in table.collect():
        k = r["length"]
        assert r["documents"] == n.count(k) and r["documents_up_to"] == sum(x <= k for x in n)
        assert r["documents_at_least"] == sum(x >= k for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= k)
        assert r["truncated_tokens"] == sum(min(x, k) for x in n)
    assert tuple(lengths.totals(table).first()) == (len(n), sum(n), max(n))
    limits = [0, 1, 7, 50, 10**6]
    assert [tuple(r) for r in lengths.truncated_totals(table, limits).collect()] == [(k, sum(min(x, k) for x in n), sum(x > k for x in n)) for k in limits]
    for r in lengths.quantiles(table, [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
        assert r["length"] == min(x for x in n if sum(y <= x for y in n) >= r["share"] * len(n))


def walk(sizes, capacity):
    """Best-two-fit one document at a time."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        pack, gap = [], capacity
        for x in list(left):
            if x <= gap:
                pack.append(x)
                left.remove(x)
                gap -= x
        if gap and pack:
            small = pack[-1]
            pairs = [(a + b, -a) for i, a in enumerate(sorted(left)) for b in sorted(left)[i + 1 :] if small < a + b <= gap + small]
            if pairs:
                total, a = max(pairs)
                pack.pop()
                left.append(small)
                for x in (-a, total + a):
                    left.remove(x)
                    pack.append(x)
                left.sort(reverse=True)
        bins.append(sorted(pack))
    return sorted(bins)


def test_plan_equals_the_walk():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.randint(3, 30)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 40))]
        counts = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, int)
        got = {}
        for n, first, end, per, bin_id, offset in packing.plan(counts).tolist():
            for r in range(first, end):
                got.setdefault(bin_id + (r - first) // per, []).append((offset + (r - first) % per * n, n))
        for members in got.values():
            at = 0
            for offset, n in sorted(members):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(sorted(n for _, n in m) for m in got.values()) == walk(sizes, capacity)


def test_packing_places_every_piece(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(texts(80))] + [(None, "no id"), (5, "again"), (5, "again")]
    got = packing.pack(frame(spark, rows).repartition(7), capacity=256, with_ids=True).collect()
    bins, docs = {}, {}
    for r in got:
        assert len(r["ids"]) == r["length"] <= 256 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    for members in bins.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= 256
    for i, t in rows[:86]:
        if i != 5:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
            assert sorted(docs[i]) == [(k, k * 256, ids[k * 256 : k * 256 + 256]) for k in range(-(-len(ids) // 256))]
    assert len(docs[None]) == 1 and sum(p == 0 for p, *_ in docs[5]) == 3


def test_empty_tables(spark, tmp_path):
    none = frame(spark, [], extra=False)
    assert tokenfile.token_table(none).count() == 0
    assert packing.pack(none).count() == 0
    table = lengths.token_counts(none)
    assert table.count() == 0 and tuple(lengths.totals(table).first()) == (0, 0, 0)
