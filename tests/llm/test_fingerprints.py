"""Fingerprints beside a plain walk over the sorted documents."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weft.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string, b int, copy string"
WORDS = "alpha beta gamma delta épsilon zeta eta theta 日本 語 iota kappa lambda mu nu xi".split()


def plain_digest(data: bytes) -> str:
    counts = [0] * 256
    for p in range(len(data)):
        for second, third, factor in fp.TRIPLETS:
            if p + third < len(data):
                triplet = data[p] << 16 | data[p + second] << 8 | data[p + third]
                counts[(triplet * factor & 0xFFFFFFFF) >> 24] += 1
    ranked = sorted(counts)
    q = [ranked[63], ranked[127], ranked[191]]
    codes = [sum(c > x for x in q) for c in counts]
    top = max(q[2], 1)
    import math

    head = [min(round(8 * math.log2(1 + len(data))), 255), (15 * q[0] // top) << 4 | 15 * q[1] // top]
    body = [codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 256, 4)]
    return bytes(head + body).hex()


def plain_likeness(a: str, b: str) -> float:
    a, b = bytes.fromhex(a), bytes.fromhex(b)
    total = min(48, 4 * abs(a[0] - b[0])) + abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))
    for x, y in zip(a[2:], b[2:]):
        for s in (0, 2, 4, 6):
            step = abs((x >> s & 3) - (y >> s & 3))
            total += 6 if step == 3 else step
    return 1 - min(total, 308) / 308


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def rows(spark, given, parts=5):
    return spark.createDataFrame([(i, t, 3, "no") for i, t in given], SCHEMA).repartition(parts)


def expected(given):
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in given))
    out = []
    for k, (known, i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][2]
        q = len(t) // 4
        changed = t[: len(t) - q] + after[:q]
        a, b, c = (plain_digest(x.encode()) for x in (t, changed, after))
        out.append((i if known else None, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out, key=str)


def got(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=str)


def test_equals_the_plain_walk(spark):
    given = [(7 * i - 50, t) for i, t in enumerate(texts(90))] + [(9001, None), (9002, ""), (9003, "a"), (None, "without an id"), (9004, "x" * 50_000)]
    df = fp.fingerprint_table(rows(spark, given))
    assert df.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert got(df) == expected(given)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    given = list(enumerate(texts(n, 4)))
    assert got(fp.fingerprint_table(rows(spark, given))) == (expected(given) if n else [])


def test_equal_rows_follow_each_other(spark):
    """A third of all rows is one row; every one of them but one is followed by its copy."""
    given = list(enumerate(texts(60, 5))) + [(30, "the same row")] * 60
    out = fp.fingerprint_table(rows(spark, given)).filter("doc_id = 30 and n_chars = 12").collect()
    assert len(out) == 60 and sum(r["near_next"] == 1.0 for r in out) >= 59
    assert len(fp.fingerprint_table(rows(spark, given)).collect()) == 120


def test_slices_and_pieces_change_nothing(spark, monkeypatch):
    raw = [t.encode() for t in texts(40, 6)] + [b"", b"ab", b"abc" * 999]
    whole = fp.bucket_counts(raw)
    monkeypatch.setattr(fp, "PIECE", 37)
    assert (fp.bucket_counts(raw) == whole).all()
    assert fp.written(fp.digests(raw)) == [plain_digest(r) for r in raw]


def test_near_texts_are_liker_than_others():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4_000)]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 600))) for _ in range(60)]
    a = fp.digests([t.encode() for t in made])
    near = fp.likenesses(a, fp.digests([fp.edited(t, u).encode() for t, u in zip(made, made[1:] + made[:1])]))
    far = fp.likenesses(a, fp.digests([u.encode() for u in made[1:] + made[:1]]))
    assert (near > far).all() and near.min() > 0.4


def test_columns(spark):
    df = spark.createDataFrame([("some text of a few words",), (None,), ("other",)], "t string").select("t", fp.fingerprint("t").alias("f"))
    out = {r["t"]: r for r in df.withColumn("same", fp.likeness("f", "f")).withColumn("none", fp.likeness("f", F.lit(None).cast("string"))).collect()}
    assert out[None]["f"] == plain_digest(b"") and out["other"]["f"] == plain_digest(b"other")
    assert all(r["same"] == 1.0 and r["none"] is None for r in out.values())
