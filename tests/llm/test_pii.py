"""Personal data: base spans beside Python's own search, and the terms that give an entity away."""

import collections
import hashlib
import math
import re

from weft.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.c_d@e.f x@y@z.com .a..b@c-d.e.f@g.h 1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 " + "9" * 40,
    "4111 1111-1111 1111 +1 (234) 555-6789..+49 30 1234567890123 +12345678é@ü.de ééé a+b%c@d.e",
    "1.2.3.4é5.6.7.8 4111111111111111-4111111111111111 +1234567890+1234567890",
    "@" * 50 + "a@a.a" * 20,
    "1.1.1.1" * 10,
    "日本 4111111111111111 🙂 me@x.org",
    "4111-1111-1111-1112 5500 0000 0000 0004 340000000000009 12 34",
    "a" * 40_000 + "@" + "b" * 40_000,
    "7" * 40_000,
    "x@y.z " * 2_000,
    "+1 " + "(" * 5_000,
    "",
    None,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    def holds(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 9, "e", 5) for d, t in rows], "doc_id bigint, text string, row bigint, kind string, n_chars bigint")


def test_base_spans_equal_plain_search(spark):
    rows = [*enumerate(TEXTS), (None, "z@z.zz"), (2, TEXTS[2]), (2, TEXTS[2])]
    got = pii.pii_table(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for d, t in rows:
        found, r = base(t), by[d]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        n = collections.Counter(k for k, *_ in found)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(n[k] for k in PATTERNS)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("term")) == listed


def leaking():
    """One address always beside the same rare name; another among common words only."""
    rows = [(i, f"the mail of Ruprecht is ann@site.org and more {i}") for i in range(4)]
    rows += [(10 + i, f"the the mail joe{i}@site.org and of is") for i in range(6)]
    rows += [(100 + i, "the mail of all is and more of the same") for i in range(40)]
    return rows


def test_terms_follow_the_measure(spark):
    rows = leaking()
    got = {r["doc_id"]: r for r in pii.pii_table(frame(spark, rows)).collect()}
    n = len(rows)
    words = [set(re.findall(r"[^\W\d_]\w*", t.lower())) for _, t in rows]
    near = {"of", "ruprecht", "is", "and", "more"}
    told = set()
    for t in near:
        n_t = sum(t in w for w in words)
        if math.log2(n * 4 / (n_t * 4)) >= pii.DISCLOSURE * math.log2(n / 4):
            told.add(t)
    assert told == {"ruprecht"}
    for i in range(4):
        spans = [s.split(":") for s in got[i]["spans"].split(",")]
        assert [rows[i][1][int(a) : int(b)] for k, a, b in spans if k == "term"] == ["Ruprecht"] and got[i]["n_term"] == 1
    assert all(r["n_term"] == 0 for d, r in got.items() if d >= 4)


def test_sanitised_text(spark):
    rows = [*leaking(), *((1000 + d, t) for d, t in enumerate(TEXTS))]
    source = frame(spark, rows)
    got = pii.sanitise(source)
    assert got.columns == source.columns
    by = {r["doc_id"]: r for r in got.collect()}
    assert len(by) == len(rows)
    assert by[0]["text"] == "the mail of  is [EMAIL] and more 0" and by[10]["text"] == "the the mail [EMAIL] and of is"
    for d, t in rows[len(leaking()) :]:
        out, at, runs = "", 0, []
        for k, a, b in sorted(base(t), key=lambda s: (s[1], -s[2])):
            if runs and a < runs[-1][2]:
                runs[-1][2] = max(runs[-1][2], b)
            else:
                runs.append([k, a, b])
        for k, a, b in runs:
            out, at = out + t[at:a] + pii.LABELS[k], b
        want = None if t is None else out + t[at:]
        assert by[d]["text"] == want and by[d]["row"] == 9 and by[d]["kind"] == "e"
        if runs:
            assert by[d]["n_chars"] == len(want)


def scattered():
    """An address of two documents far from the name in both; a domain whose addresses each stand once."""
    far = " ".join(f"plain{j}" for j in range(30))
    rows = [(i, f"Ruprecht {far} mail ann@site.org {far} ruprecht once{i} 4") for i in range(2)]
    rows += [(10 + i, f"joe{i}@rare.net {far} mail Verdandi lone{i}") for i in range(3)]
    return rows + [(100 + i, f"{far} mail of pair{i // 2}") for i in range(400)]


def test_terms_of_entities_in_one_or_two_documents(spark):
    rows = scattered()
    got = {r["doc_id"]: r for r in pii.pii_table(frame(spark, rows).repartition(3)).collect()}
    for d, t in rows:
        spans = [s.split(":") for s in got[d]["spans"].split(",") if s.startswith("term")]
        want = {0: ["Ruprecht", "ruprecht"], 10: ["Verdandi"]}.get(0 if d < 2 else 10 if d < 13 else 100, [])
        assert [t[int(a) : int(b)] for _, a, b in spans] == want and got[d]["n_term"] == len(want)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, rows)).collect()}
    assert not any(w in t.lower() for t in clean.values() for w in ("ruprecht", "verdandi", "@"))
    assert all("mail" in t and "plain7" in t for t in clean.values()) and "lone1" in clean[11]


def test_chance_is_no_evidence(spark):
    """Of a domain in a third of all documents, a word of two documents tells nothing."""
    rows = [(i, f"joe{i}@site.org word w{i // 2}x") for i in range(20)] + [(50 + i, f"word v{i}x") for i in range(40)]
    assert all(r["n_term"] == 0 for r in pii.pii_table(frame(spark, rows)).collect())


def test_copies_are_no_evidence(spark):
    """A text of rare words with an address, held five times: its words stay, whatever the number of copies."""
    rare = " ".join(f"rare{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(60))
    rows = [(i, f"write to ann@site.org today {rare}") for i in range(5)] + [(50 + i, f"the text {i} of many words that is here") for i in range(300)]
    got = {r["doc_id"]: r for r in pii.pii_table(frame(spark, rows)).collect()}
    assert all(got[i]["n_email"] == 1 for i in range(5)) and not any(r["n_term"] for r in got.values())
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, rows)).collect()}
    assert clean[0] == f"write to [EMAIL] today {rare}"


def test_many_coincidences_are_no_evidence(spark):
    """Each of 300 domains of two documents meets one word by chance: so many pairs are expected to be false."""
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3_000)]
    rows = [(i, f"joe{i}@site{i % 300}.org " + " ".join(rng.choice(words) for _ in range(40))) for i in range(600)]
    table = pii.pii_table(frame(spark, rows)).collect()
    assert sum(r["n_term"] for r in table) == 0


def test_no_python_on_the_executors(spark):
    plan = pii.pii_table(frame(spark, leaking()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert pii.pii_table(frame(spark, [])).collect() == [] and pii.sanitise(frame(spark, [])).collect() == []
