import hashlib
import random
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.functions import draws as D
from weft.functions.tokens import ByteTokenizer
from weft.operators import chat as H
from weft.operators import masked as M
from weft.operators import nextfit
from weft.operators import runs as R

CFG = M.MaskConfig(length=64, vocab=200, cls=200, sep=201, mask=202, pad=-1, continuations=frozenset(range(50, 60)))


def walk_runs(lengths, target, min_sent, left_over):
    out, start, tokens, n = [], 0, 0, 0
    for i, size in enumerate(lengths):
        tokens, n = tokens + size, n + 1
        left = len(lengths) - i - 1
        if (tokens >= target and left >= left_over and n >= min_sent) or left == 0:
            out.append((start, i + 1))
            start, tokens, n = i + 1, 0, 0
    return out


def test_runs_equal_the_walk(spark):
    rng = random.Random(1)
    docs = [(i, [rng.randint(1, 40) for _ in range(rng.randint(0, 25))], 5) for i in range(40)]
    docs += [(99, [3, 600, 3], 5), (100, [600], 5)]
    df = spark.createDataFrame(docs, "doc_id bigint, sentence_lengths array<int>, title_length int")
    got = {}
    for r in R.sentence_runs(df, 50, 0, 2).collect():
        got.setdefault(r["doc_id"], []).append((r["first"], r["last"]))
    blocks = {}
    for r in R.title_blocks(df, 55, 1).collect():
        blocks.setdefault(r["doc_id"], []).append((r["first"], r["last"]))
    for i, lengths, _ in docs:
        long = any(n > 512 for n in lengths)
        want = walk_runs(lengths, 50, 2, 2) if len(lengths) >= 2 and not long else []
        assert sorted(got.get(i, [])) == want
        want = walk_runs(lengths, 50, 1, 1) if len(lengths) >= 1 and not long else []
        assert sorted(blocks.get(i, [])) == want


def test_run_ends_of_a_very_long_document():
    rng = random.Random(2)
    rows = [[rng.randint(0, 40) for _ in range(n)] for n in (100_000, 0, 1, 3, 50)]
    targets = [[rng.choice([2, 30, 50]) for _ in range(100_001)] for _ in rows]
    got = R.run_ends(R.pa.array(rows, R.pa.list_(R.pa.int32())), 2, 2, lambda rows, r: np.array([targets[i][r] for i in rows]))
    for lengths, aims, found in zip(rows, targets, got.to_pylist()):
        want, start, tokens = [], 0, 0
        for i, size in enumerate(lengths):
            tokens += size
            left = len(lengths) - i - 1
            if (tokens >= aims[len(want)] and left >= 2 and i + 1 - start >= 2) or left == 0:
                want.append({"first": start, "last": i + 1, "target": aims[len(want)]})
                start, tokens = i + 1, 0
        assert found == want


def test_whole_epochs_until_enough(spark):
    df = spark.createDataFrame([(i, [10] * 6) for i in range(5)], "doc_id bigint, sentence_lengths array<int>")
    per_epoch = R.sentence_runs(df, 20, 3, 2, epochs=1).count()
    runs = R.sentence_runs(df, 20, 3, 2, n_samples=4 * per_epoch)
    assert runs.count() >= 4 * per_epoch
    last = runs.agg(F.max("epoch")).first()[0]
    assert runs.filter(F.col("epoch") < last).count() < 4 * per_epoch


def draws(seed, *keys):
    return hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()


def number(digits, k=0):
    return int(digits[8 * k : 8 * k + 8], 16)


def test_draws_of_a_batch_equal_the_single_ones():
    rng = np.random.default_rng(3)
    heads = [f"1234|mask|{i}|" for i in (0, 7, -99, 12345, 10**9, 10**18)] + ["1234|mask|", "x" * 49 + "|", "é" * 40, "y" * 200, ""]
    row, key = rng.integers(0, len(heads), 3_000), rng.integers(0, 130, 3_000)
    key[:40] = rng.integers(0, 70_000, 40)
    got = D.plain_draws(heads, row, key).T.tolist()
    for i in range(len(row)):
        digits = hashlib.md5(f"{heads[row[i]]}{key[i]}".encode()).hexdigest()
        assert got[i] == [number(digits, k) for k in range(4)], (heads[row[i]], key[i])
    assert D.plain_draws([], np.zeros(0, np.int64), np.zeros(0, np.int64)).shape == (4, 0)


@pytest.mark.parametrize("changes", [{"geometric": True, "permute": True, "classify": False}, {}, {"classify": False}])
def test_masking_goes_by_batches(spark, changes):
    """One batch function and no draw as an expression: an md5 for each word in an interpreted lambda took nine tenths of the time."""
    pairs = spark.createDataFrame([(1, [[5], [6]], 8)], "idx bigint, sentences array<array<int>>, target int")
    plan = M.bert_samples(pairs, replace(CFG, **changes)).select("idx", "labels", "loss_mask")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "md5" not in plan and "lambda" not in plan


def pick_by_hand(words, budget, taken, idx, tag, cfg, geometric):
    """Disjoint n-grams of words in drawn order, one after the other, within the budget."""
    ends = cfg.size_ends(geometric)
    used, out = set(), []
    for digits, w in sorted((draws(cfg.seed, tag, idx, w), w) for w in range(len(words))):
        if len(used) >= budget:
            break
        size = 1 + sum(number(digits, 1) >= e for e in ends)
        for n in range(size, 0, -1):
            spots = [p for word in words[w : w + n] for p in word]
            if len(used) + len(spots) <= budget:
                if not (set(spots) & (used | taken)):
                    used.update(spots)
                    out.append(spots)
                break
    return sorted(out)


def mask_by_hand(tokens, target, idx, cfg):
    """(text, position to label, spans) by a plain walk."""
    words = []
    for i, t in enumerate(tokens):
        if t not in (cfg.cls, cfg.sep):
            if cfg.whole_words and t in cfg.continuations and words:
                words[-1].append(i)
            else:
                words.append([i])
    budget = min(cfg.probability * target, max(1, round(len(tokens) * cfg.probability)))
    spans = pick_by_hand(words, budget, set(), idx, "mask", cfg, cfg.geometric)
    text, labels = list(tokens), {}
    for p in [p for s in spans for p in s]:
        d = draws(cfg.seed, "fate", idx, p)
        labels[p] = tokens[p]
        if cfg.always_mask or number(d) < round(0.8 * 2**32):
            text[p] = cfg.mask
        elif number(d) < round(0.9 * 2**32):
            text[p] = number(d, 1) % cfg.vocab
    if cfg.permute:
        moved = [p for s in pick_by_hand(words, budget, set(labels), idx, "move", cfg, False) for p in s]
        for p, q in zip(moved, sorted(moved, key=lambda p: draws(cfg.seed, "swap", idx, p))):
            text[p], labels[p] = tokens[q], tokens[p]
    return text, labels, spans


def pair_by_hand(sentences, target, idx, cfg):
    d, pivot, swapped = draws(cfg.seed, "pair", idx), len(sentences), 0
    if cfg.classify:
        pivot = 1 + number(d) % (len(sentences) - 1) if len(sentences) >= 3 else 1
        swapped = int(number(d, 1) % 2 == 0)
    a, b = sum(sentences[:pivot], []), sum(sentences[pivot:], [])
    a, b = (b, a) if swapped else (a, b)
    k = 0
    while len(a) + len(b) > target:
        digit = draws(cfg.seed, "trim", idx, k // 32)[k % 32]
        part = a if len(a) > len(b) else b
        del part[0 if digit < "8" else -1]
        k += 1
    tokens = [cfg.cls, *a, cfg.sep] + ([*b, cfg.sep] if b else [])
    text, labels, _ = mask_by_hand(tokens, target, idx, cfg)
    n, fill = len(tokens), cfg.length - len(tokens)
    unpad = lambda row: [0 if t == cfg.pad else t for t in row]
    return {
        "idx": idx, "text": unpad(text) + [0] * fill, "types": [0] * (len(a) + 2) + [1] * (n - len(a) - 2) + [cfg.pad] * fill,
        "labels": unpad([labels.get(p, -1) for p in range(cfg.length)]), "is_random": swapped,
        "padding_mask": [cfg.pad if t == cfg.pad else 1 for t in text] + [cfg.pad] * fill,
        "loss_mask": [int(p in labels) for p in range(cfg.length)], "truncated": int(k > 0),
    }


def test_lines_of_a_batch_are_cut_in_blocks(monkeypatch):
    """Blocks of one or two lines give what a block of all lines gives, also for words whose draws begin alike."""
    made = sentences_at_random(30, 8) + [[[7] * 3, [8] * 40, [9]]]
    tokens, sizes = [sum(s, []) for s in made], np.array([sum(map(len, s)) for s in made])
    names = [str(i) for i in range(len(made))]
    cfg = replace(CFG, permute=True)

    def run(rows):
        cells = np.zeros((len(rows), max(sizes[rows])), np.int64)
        for i, r in enumerate(rows):
            cells[i, : sizes[r]] = tokens[r]
        lines = M._Lines(cells, sizes[rows], None, [names[r] for r in rows], np.full(len(rows), 40.0), cfg)
        text, labels, changed, _ = lines.masked()
        return [(text[i, : sizes[r]].tolist(), {p: int(labels[i, p]) for p in np.flatnonzero(changed[i])}) for i, r in enumerate(rows)]

    whole = run(list(range(len(made))))
    assert whole == [mask_by_hand(t, 40, int(n), cfg)[:2] for t, n in zip(tokens, names)]
    assert [run([i])[0] for i in range(len(made))] == whole
    monkeypatch.setattr(M, "CELLS", 50)
    blocks = list(M._blocks(sizes))
    assert [i for b in blocks for i in range(b.start, b.stop)] == list(range(len(made)))
    assert all(b.stop - b.start == 1 or (b.stop - b.start) * max(sizes[b]) <= 50 for b in blocks)
    # all draws alike but for their last bits: the order is that of the whole draws
    order = M._Lines(np.zeros((1, 3), np.int64), np.array([3]), None, ["4"], np.array([9.0]), cfg)
    drawn = np.zeros((4, 3), np.uint32)
    want = sorted(range(3), key=lambda w: draws(cfg.seed, "mask", 4, w))
    assert order._order("mask", np.ones((1, 3), bool), np.arange(3), drawn)[0].tolist() == want


def test_sentences_are_dealt_as_texts(spark):
    """Runs are dealt to the tasks as texts and turned to tokens there: tokens were shuffled as arrays, four bytes for one."""
    from weft.plans import objectives as O

    class Tables:
        documents = spark.createDataFrame([(1, "one. two. three."), (2, None), (None, "a. b."), (3, "x")], "doc_id bigint, text string").withColumn("source", F.lit("s"))

    rows = O.run_rows(Tables)
    left, dealt = [rows._jdf.queryExecution().optimizedPlan()], []
    while left:
        node = left.pop()
        left += [node.children().apply(i) for i in range(node.children().size())]
        if "Repartition" in node.nodeName():
            dealt += [node.output().apply(i).dataType().catalogString() for i in range(node.output().size())]
    assert "array<string>" in dealt and "array<array<int>>" not in dealt
    assert sorted(r["sentences"] for r in rows.collect()) == [[list(b"one."), list(b"two."), list(b"three.")]]


def sentences_at_random(n, seed, top=100):
    rng = random.Random(seed)
    return [[[rng.randrange(top) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(2, 7))] for _ in range(n)]


@pytest.mark.parametrize(
    "changes",
    [
        {}, {"geometric": True}, {"permute": True, "classify": False}, {"longer_ngrams": True, "whole_words": False},
        {"pad": 7, "always_mask": True, "max_ngram": 5, "probability": 0.4}, {"probability": 0.01}, {"continuations": frozenset()},
    ],
)
def test_pair_samples_equal_the_walk(spark, changes):
    cfg = replace(CFG, **changes)
    made = [*sentences_at_random(60, 3), [[55], [51]], [[3], [50] * 30], [[9] * 70, [8]]]
    rows = [(i, s, 8 + 7 * (i % 8)) for i, s in enumerate(made)]
    df = spark.createDataFrame(rows, "idx bigint, sentences array<array<int>>, target int")
    out = {r["idx"]: r.asDict() for r in M.bert_samples(df.repartition(3), cfg).collect()}
    for i, s, target in rows:
        assert out[i] == pair_by_hand([list(x) for x in s], target, i, cfg), i


def test_pairs_need_two_sentences_and_room(spark):
    schema = "idx bigint, sentences array<array<int>>, target int"
    for rows, message in (([(1, [[5, 6]], 20)], "two sentences"), ([(1, [[5] * 70, [6]], 200)], "longer than")):
        with pytest.raises(Exception, match=message):
            M.bert_samples(spark.createDataFrame(rows, schema), CFG).collect()


def test_pairs_with_missing_sentences_or_keys(spark):
    """A sample without its first part has no text; without its second it is the first alone; without a target it is whole."""
    made = [(None, [[1, 2], [3]], 8), (2, None, 8), (3, [[1] * 20, None], 8), (4, [[1] * 9, [2] * 9], None), (5, [[1, None, 3], [4, 5]], 9), (6, [[], []], 5)]
    df = spark.createDataFrame(made, "idx bigint, sentences array<array<int>>, target int")
    out = {r["idx"]: r.asDict() for r in M.bert_samples(df, CFG).collect()}
    arrays = ("text", "types", "labels", "padding_mask", "loss_mask")
    assert len(out[None]["text"]) == 64 and out[None]["truncated"] == 0
    assert all(out[2][name] is None for name in arrays) and out[2]["is_random"] in (0, 1)
    swapped = int(number(draws(CFG.seed, "pair", 3), 1) % 2 == 0)
    assert out[3]["is_random"] == swapped and out[3]["truncated"] == 0
    assert out[3]["text"] is None if swapped else out[3]["text"].count(0) == 64 - 22
    assert out[4] == pair_by_hand([[1] * 9, [2] * 9], 10**6, 4, CFG)
    assert out[5]["text"].count(None) == 1 and out[5]["loss_mask"][out[5]["text"].index(None)] == 0
    assert out[6] == pair_by_hand([[], []], 5, 6, CFG)


def test_replacement_shares(spark):
    df = spark.range(400).select(F.col("id").alias("idx"), F.expr("transform(sequence(0, 49), i -> cast(i as int))").alias("t"))
    out = df.select(F.explode(M.mask_ngrams(F.col("t"), F.lit(60), F.col("idx"), CFG)["changes"]).alias("c")).select("c.*")
    share = out.agg(F.avg((F.col("token") == CFG.mask).cast("int")), F.avg((F.col("token") == F.col("label")).cast("int"))).first()
    assert 0.77 < share[0] < 0.83 and 0.08 < share[1] < 0.13


def spans_by_hand(tokens, target, idx, cfg, sentinels, bos, eos):
    cut = tokens[:target]
    _, _, spans = mask_by_hand(cut, target, idx, replace(cfg, always_mask=True, permute=False))
    enc, told, at = [], [], 0
    for name, spots in zip(sentinels, spans):
        enc += cut[at : spots[0]] + [name]
        told += [name] + [cut[p] for p in spots]
        at = spots[-1] + 1
    return enc + cut[at:], [bos, *told], [*told, eos]


def test_spans_equal_the_walk_and_merge_back(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([200, 201, *range(100)]) for _ in range(rng.randint(0, 60))], 40) for i in range(60)]
    df = spark.createDataFrame(rows, "idx bigint, tokens array<int>, target int")
    sentinels = list(range(300, 320))
    for r in M.span_corrupt(df, CFG, sentinels, 290, 291, 64).collect():
        enc, dec, labels = spans_by_hand(rows[r["idx"]][1], 40, r["idx"], CFG, sentinels, 290, 291)
        assert r["text_enc"] == enc + [0] * (64 - len(enc)) and r["enc_mask"] == [1] * len(enc) + [0] * (64 - len(enc))
        assert r["text_dec"] == dec + [0] * (64 - len(dec)) and r["dec_mask"] == [1] * len(dec) + [0] * (64 - len(dec))
        assert r["labels"] == labels + [0] * (64 - len(dec)) and r["loss_mask"] == r["dec_mask"]
        assert r["truncated"] == int(len(rows[r["idx"]][1]) > 40)
    with pytest.raises(Exception, match="sentinel"):
        M.span_corrupt(df, CFG, [300], 290, 291, 64).collect()


def test_spans_go_by_batches_and_take_odd_rows(spark):
    """Special tokens inside an n-gram go with it, an empty or missing sample has no spans, a missing target leaves nothing."""
    cfg, sentinels = replace(CFG, probability=0.5), list(range(300, 340))
    made = [(i, [1, 200, 2, 201, 3, 200, 4, 201, 5, 6, 200] * 3, 30) for i in range(20)] + [(30, [], 5), (31, None, 5), (32, [1, 2], None), (None, [1, 2, 3], 9), (33, [7] * 9, 0)]
    df = spark.createDataFrame(made, "idx bigint, tokens array<int>, target int")
    made_of = M.span_corrupt(df, cfg, sentinels, 290, 291, 64)
    plan = made_of.select("idx", "labels")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "md5" not in plan and "lambda" not in plan
    out = {r["idx"]: r.asDict() for r in made_of.collect()}
    for i, tokens, target in made:
        if i is None or tokens is None or target is None:
            continue
        enc, dec, labels = spans_by_hand(tokens, target, i, cfg, sentinels, 290, 291)
        assert out[i]["text_enc"] == enc + [0] * (64 - len(enc)) and out[i]["text_dec"] == dec + [0] * (64 - len(dec))
        assert out[i]["labels"] == labels + [0] * (64 - len(labels)) and out[i]["truncated"] == int(len(tokens) > target)
    assert out[31]["text_enc"] is None and out[31]["truncated"] is None and out[31]["text_dec"][:2] == [290, 0]
    assert out[32]["text_enc"] == [0] * 64 and out[32]["truncated"] is None
    assert len(out[None]["text_enc"]) == 64


def infill_rows(n=80, seed=6):
    rng = random.Random(seed)
    pieces = ["alpha", "/", " ", "é", "日本", "🙂", "keep ", "\n", "\u3000"]
    rows = [(0, list(b"alpha/beta gamma") + [256] + list(b"delta") + [256] + list(b"last/one")), (1, []), (2, [256, 256]), (3, list("日本語".encode())[1:-1])]
    for i in range(4, n):
        tokens = []
        for _ in range(rng.randint(0, 30)):
            tokens += rng.choice([[256], [47], [300], [0xE3], [0x81], [0xED, 0xA0, 0x80], [0xF0, 0x9F], *[list(rng.choice(pieces).encode()) for _ in range(8)]])
        rows.append((i, tokens))
    return rows


@pytest.mark.parametrize("spm", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("split", [None, 47])
@pytest.mark.parametrize("no_prefix", [None, "keep"])
def test_infill_columns_equal_the_tokenizer_path(spark, spm, split, no_prefix):
    cfg = M.InfillConfig(0.7, spm, 260, 261, 262, 263, 256, split=split, fragment_rate=0.6, no_prefix=no_prefix)
    rows = infill_rows()
    df = spark.createDataFrame(rows, "idx bigint, tokens array<int>")
    want = {i: M.infill_sample(t, i, cfg, ByteTokenizer()) for i, t in rows}
    assert {r["idx"]: r["tokens"] for r in M.fim_bytes(df.repartition(3), cfg).collect()} == want
    assert {r["idx"]: r["tokens"] for r in M.fim(df, cfg, ByteTokenizer).collect()} == want


@pytest.mark.parametrize("spm", [0.0, 1.0])
def test_infill_parts_join_to_the_text(spm):
    cfg = M.InfillConfig(1.0, spm, 260, 261, 262, 263, 256)
    full = M.infill_segment(list(b"alpha beta"), 1.0, cfg, ByteTokenizer(), (3, 0))
    parts = {}
    key = None
    for t in full:
        if t in (260, 261, 262):
            key = t
            parts[key] = []
        else:
            parts[key].append(t)
    if spm:
        assert full[:2] == [260, 262]
        joined = parts[261] + parts[262]  # prefix and middle follow the middle token
    else:
        assert full[0] == 260
        joined = parts[260] + parts[261] + parts[262]
    assert sorted(joined) == sorted(b"alpha beta")


def test_byte_text_equals_the_decoder(spark):
    rng = random.Random(11)
    rows = [[rng.choice([rng.randrange(256), rng.randrange(0x80, 0xF5), 32, 65, 256, 300]) for _ in range(rng.randint(0, 40))] for _ in range(300)]
    rows += [list("naïve 日本 🙂 　\x1f\x85".encode()), list("a​".encode()), [0xED, 0x9F, 0xBF], [0xF4, 0x90, 0x80, 0x80]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t array<int>")
    got = {r["i"]: r["x"] for r in df.select("i", M.byte_text(F.col("t")).alias("x")).collect()}
    assert got == {i: ByteTokenizer().decode(t) for i, t in enumerate(rows)}


def packed_by_hand(parts, length, pad, cp):
    """The packing rule, one conversation at a time."""
    tokens, targets, positions, cu = [], [], [], [0]
    for t, g in parts:
        t, g = list(t), list(g)
        grain = 2 * cp if cp > 1 else 1
        extra = -(len(tokens) + len(t)) % grain
        tokens += t + [pad] * extra
        targets += g + [pad] * extra
        positions += range(len(t) + extra)
        cu.append(len(tokens))
        if len(tokens) >= length + 1:
            tokens, targets = tokens[:length] + [pad], targets[:length] + [pad]
            positions = positions[: length + 1]
            cu[-1] = length
            break
    short = length + 1 - len(tokens)
    if short > 0:
        tokens, targets = tokens + [pad] * short, targets + [pad] * short
        positions += range(positions[-1] + 1, positions[-1] + 1 + short)
        cu[-1] = length
    return tokens[:-1], targets[1:], positions[:-1], cu


@pytest.mark.parametrize("cp", [1, 2])
def test_pack_chat_equals_the_rule(spark, cp):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 5)):
            t = [rng.randint(1, 90) for _ in range(rng.randint(1, 25))]
            parts.append((t, [-100 if rng.random() < 0.4 else x for x in t]))
        rows.append((i, parts))
    rows.append((40, [([5] * 33, [5] * 33)]))  # exactly one more than the length
    df = spark.createDataFrame(rows, "line bigint, parts array<struct<tokens:array<int>,targets:array<int>>>")
    for r in H.pack_chat(df, 32, 0, cp).collect():
        t, g, p, cu = packed_by_hand(rows[r["line"]][1], 32, 0, cp)
        assert (r["input"], r["labels"], r["position_ids"], r["cu_seqlens"]) == (t, g, p, cu)
        assert r["loss_mask"] == [int(v not in (0, -100)) for v in g]
        assert r["max_seqlen"] == max(b - a for a, b in zip(cu, cu[1:]))


def test_chat_rules(spark):
    def rows(*turns):
        return spark.createDataFrame([(list(turns),)], f"messages {H.MESSAGES}")

    good = H.chat_targets(rows(("system", "s"), ("user", "hi"), ("assistant", "yo")), H.ChatTemplate(bos=1)).first()
    assert good["tokens"][0] == 1 and len(good["tokens"]) == len(good["targets"])
    seen = bytes(t for t in good["targets"] if t >= 0).decode()
    assert seen == "yo<|im_end|>\n"
    for turns in ([("user", "a"), ("assistant", "")], [("user", "a"), ("assistant", "b"), ("assistant", "c")], [("assistant", "x"), ("user", "y")], [("robot", "x"), ("user", "y")]):
        with pytest.raises(Exception, match="conversation"):
            H.chat_targets(rows(*turns), H.ChatTemplate()).collect()
        assert H.chat_targets(rows(*turns), H.ChatTemplate(), strict=False).first()["error"]
    plain = H.chat_targets(rows(("user", "a"), ("assistant", "")), H.ChatTemplate(masked=False)).first()
    assert plain["tokens"] == plain["targets"]
    bare = H.chat_targets(rows(("system", "s"), ("user", "u")), H.ChatTemplate(has_system=False)).first()
    assert "system" not in bytes(bare["tokens"]).decode()


def test_too_large_shards_are_refused(spark, monkeypatch):
    monkeypatch.setattr(H, "MAX_SHARD_ROWS", 2)
    df = spark.createDataFrame([(i, [1, 2]) for i in range(9)], "conv_id bigint, tokens array<int>")
    with pytest.raises(ValueError, match="shards"):
        H.pack_concat(df, 4, 2, 0)


def fit_by_hand(sizes, length, held=0):
    """(rows that close a pack, tokens held at the end)."""
    ends = []
    for i, n in enumerate(sizes):
        held += n
        if held > length:
            ends.append(i)
            held = 0
    return ends, held


@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.integers(1, 30), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_maps_and_closings_of_a_block(sizes, length, held):
    held = min(held, length)
    sizes = np.minimum(np.array(sizes), length)
    ends, left = fit_by_hand(sizes.tolist(), length, held)
    assert nextfit.closings(sizes, length, held).tolist() == ends
    upto, held_after, closed = nextfit.block_map(sizes, length)
    piece = {"upto": upto, "held": held_after, "closed": closed, "total": int(sizes.sum())}
    after, packs = nextfit.applied(piece, np.array([held]), length)
    assert (int(after[0]), int(packs[0])) == (left, len(ends))


def test_one_giant_shard_is_packed_in_blocks(spark):
    """Shard 0 holds most rows, of one length in part, so that neighbouring walks never meet."""
    rng = random.Random(5)
    shards = {0: [rng.randint(1, 9) for _ in range(300)] + [3] * 300, 1: [7], 2: [10] * 24, 3: [1] * 40}
    rows = [(s, i, n) for s, sizes in shards.items() for i, n in enumerate(sizes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "shard int, i bigint, n int")
    got = sorted(tuple(r) for r in nextfit.next_fit(df, 10, block_rows=11).collect())
    want = []
    for s, sizes in shards.items():
        ends, _ = fit_by_hand(sizes, 10)
        want += [(s, i, sum(e < i for e in ends)) for i in range(ends[-1] + 1 if ends else 0)]
    assert got == want
    assert nextfit.next_fit(df.limit(0), 10).collect() == []


def test_infill_cuts_the_bytes_and_not_the_characters(spark):
    """Segments with malformed ends, wide characters and blanks at the end, beside the plain walk."""
    texts = ["plain words here", "\u00e9t\u00e9 \u65e5\u672c \U0001f642!", "tail \u00a0 \n", "", "\u00e7a", "x"]
    rows = []
    for i in range(40):
        t = [b for k in range(3) for b in [*texts[(i + k * (1 + i // 6)) % 6].encode(), 256]][i % 3 : len(texts) * 9 - i % 5]
        rows.append((i, t))
    rows.append((40, [0xE9, 0x80, 65, 0xFF, 66, 0xC3, 256, 0xED, 0xA0, 0x80, 67]))
    cfg = M.InfillConfig(rate=0.9, spm_rate=0.5, prefix=260, middle=261, suffix=262, pad=263, eod=256, seed=3)
    out = M.fim_bytes(spark.createDataFrame(rows, "idx bigint, tokens array<int>"), cfg)
    assert "ascii(" not in out._jdf.queryExecution().optimizedPlan().toString()
    from weft.functions.tokens import ByteTokenizer

    tok = ByteTokenizer()
    got = {r["idx"]: list(r["tokens"]) for r in out.collect()}
    assert got == {i: M.infill_sample(list(t), i, cfg, tok) for i, t in rows}
