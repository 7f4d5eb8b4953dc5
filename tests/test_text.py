import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from weft.functions import text as X
from weft.functions import tokens as T


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column).collect()]


def test_bytes(spark):
    assert one(spark, T.byte_encode("x"), "Hello", "", "é\n") == [[72, 101, 108, 108, 111], [], [195, 169, 10]]
    df = spark.createDataFrame([([72, 101, 300, 108, 32],), ([255, 104, 195],), ([],)], "x array<int>")
    assert [r[0] for r in df.select(T.byte_decode("x")).collect()] == ["Hel", "h", ""]


def test_integers(spark):
    assert one(spark, T.int_encode("x"), "11 325 97") == [[11, 325, 97]]
    assert one(spark, T.int_offsets("x"), "11 325 97") == [[0, 3, 7]]


def test_sentences_never_cross_a_slice(spark, monkeypatch):
    monkeypatch.setattr(X, "SLICE_CHARS", 10)
    got = one(spark, X.split_sentences("x", keep_newlines=True), "One two. Three four! x")[0]
    assert "".join(got) == "One two. Three four! x"
    assert got == ["One two. ", "T", "hree four!", " x"]


def test_reasoning(spark):
    got = one(spark, X.split_reasoning("x"), "a<think>b</think>c", "b</think>c", "plain", "<think>open")
    assert [tuple(r) for r in got] == [("ac", "b"), ("c", "b"), ("plain", None), ("<think>open", None)]


def test_clip_ends_on_a_character(spark):
    assert one(spark, X.clip_utf8("x", 4), "aaaé", "aééé", "<|endoftext|>", "  ", "ab") == ["aaa", "aé", None, None, "ab"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The answer is 42.", {"42.0"}),
        ("x = 1,234", {"1234.0", "234.0"}),  # the plain form also sees the tail
        ("so we get 3.14159", {"we get 3.14159", "3.14"}),
        ("B", {" b", "b "}),
        ("first line\nfinal 7e2", {"700.0", "2.0"}),
        ("it is red\nthe result is blue", {"red", "blue"}),
    ],
)
def test_open_answers(spark, text, want):
    assert set(one(spark, X.parse_open("x"), text)[0]) == want


def test_choice_ties_and_defaults(spark):
    opts = F.create_map(F.lit("A"), F.lit("red"), F.lit("B"), F.lit("blue"))
    letters = F.array(F.lit("A"), F.lit("B"))
    got = one(
        spark,
        X.parse_choice(F.col("x"), letters, opts),
        "(A) or rather (B)",
        "B) then A)",  # neither is bracketed on both sides: the first candidate
        "I say B",
        "well the colour here is surely blue I think",
        "no idea",
        "blue",
    )
    assert got == ["B", "A", "B", "B", "A", "A"]


def test_numbers(spark):
    assert one(spark, X.tidy_number("x"), "3.14159", "5.00", "7%", "8.", "abc") == ["3.14", "5", "7", "8", "abc"]
    assert one(spark, X.numeric_answer("x"), "the answer is 5.2 ok", "1e+5", "4") == ["5.2", "1e+5", "4"]


def test_final_answer(spark):
    got = one(spark, X.extract_answer("x"), "a \\boxed{1} \\answer{2}", "\\boxed{1}", "Answer:3")
    assert got == ["2", "1", "Answer: 3"]


def test_tool_calls(spark):
    tools = {"f": {"n": "integer", "s": "string", "b": "bool", "o": "object", "x": "number"}}
    text = (
        "say <tool_call><function=f><parameter=n>3</parameter><parameter=s>\n4\n</parameter>"
        "<parameter=b>TRUE</parameter><parameter=o>[1, 2]</parameter><parameter=x>2.0</parameter>"
        "<parameter=u>null</parameter><parameter=n>5</parameter></function></tool_call>"
    )
    df = spark.createDataFrame([(1, text), (2, "no call")], "id int, x string")
    rows = {r["parameter"]: r for r in X.extract_tool_calls(df, "x", tools, "id").collect()}
    values = {k: r["value"] for k, r in rows.items()}
    assert values == {"n": "5", "s": '"4"', "b": "true", "o": "[1,2]", "x": "2", "u": "null"}
    assert {r["content"] for r in rows.values()} == {"say "}


def test_vqa_normalisation(spark):
    got = one(spark, X.vqa_normalize("x"), "The two dogs, running!", "dont", "1,000", "a/b", "no. 5.5")
    assert got == ["2 dogs running", "don't", "1000", "b", "no 5.5"]


def test_tokenizer_types():
    assert T.load_tokenizer("byte").encode("ab") == [97, 98]
    with pytest.raises(ValueError):
        T.load_tokenizer("none")


def test_vqa_contractions_of_two_parts(spark):
    cases = {"couldnt've": "couldn't've", "Mightnt": "mightn't", "someones": "someone's", "youre two": "you're 2", "shedve": "shedve"}
    df = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert all(r[0] == r[1] for r in df.select(X.vqa_normalize("a"), "b").collect())


def test_subword_tokenizers_equal_their_libraries(spark):
    """Through the encoding path: nulls, empty lists and empty parts included."""
    import sentencepiece
    import tokenizers

    texts = [["Hello world.", " naïve 日本 🙂", ""], [], None, ["a"], ["word " * 500]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, parts array<string>").repartition(2)
    plain = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    by_kind = {
        "bpe-json": ("byte_bpe_50k.json", lambda t: plain.encode(t, add_special_tokens=False).ids),
        "tiktoken": ("byte_bpe_50k.tiktoken", lambda t: plain.encode(t, add_special_tokens=False).ids),
        "sentencepiece": ("piece_bpe_32k.model", pieces.encode),
    }
    for kind, (name, encode) in by_kind.items():
        out = T.encode_with(df, "parts", "ids", lambda kind=kind, path=P.path(name): T.load_tokenizer(kind, path)).collect()
        assert {r["i"]: r["ids"] for r in out} == {i: None if t is None else [encode(p) for p in t] for i, t in enumerate(texts)}
    numbers = spark.createDataFrame([(["1 22 3"],)], "parts array<string>")
    assert T.encode_with(numbers, "parts", "ids", lambda: T.load_tokenizer("null")).first()["ids"] == [[1, 22, 3]]
    assert T.load_tokenizer("tiktoken", P.path("byte_bpe_50k.tiktoken")).decode([15496]) == "Hello"


def test_batches_for_python_are_bounded_by_bytes(spark):
    import pyarrow as pa

    @F.arrow_udf("int")
    def rows(texts: pa.Array) -> pa.Array:
        return pa.array([len(texts)] * len(texts), pa.int32())

    long = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    assert long.select(rows("t").alias("n")).agg(F.max("n")).first()[0] < 500


def test_a_tokenizer_gets_a_bounded_call(spark, monkeypatch):
    import numpy as np

    from weft.functions import tokens as T

    monkeypatch.setattr(T, "CALL_CHARS", 10)
    calls = []

    def together(texts):
        calls.append(sum(map(len, texts)))
        return [list(t.encode()) for t in texts]

    ids = T._coded(["abc", "", "defghijkl", "m" * 30, "n"], together)
    assert max(calls) == 30 and len(calls) == 3
    assert ids.to_pylist() == [list(t.encode()) for t in ("abc", "", "defghijkl", "m" * 30, "n")]
    assert T._coded([], together).to_pylist() == [] and ids.flatten().to_numpy().dtype == np.int32


def test_encoded_parts_keep_nulls_and_empty_lists(spark):
    from weft.functions import tokens as T

    df = spark.createDataFrame([(1, ["ä", "", "b c"]), (2, None), (3, [])], "k int, p array<string>").coalesce(1)
    wanted = {1: [[195, 164], [], [98, 32, 99]], 2: None, 3: []}
    own = df.select("k", T.byte_encode_parts("p").alias("x"))
    other = T.encode_with(df, "p", "x", T.ByteTokenizer)
    assert {r["k"]: r["x"] for r in own.collect()} == wanted == {r["k"]: r["x"] for r in other.collect()}


def test_decoded_bytes_keep_nulls_and_drop_what_is_no_byte(spark):
    from weft.functions import tokens as T

    df = spark.createDataFrame([(1, [104, 300, 105, -1, 32]), (2, None), (3, []), (4, [195, 40, 195, 164])], "k int, t array<int>").coalesce(1)
    found = {r["k"]: r["x"] for r in df.select("k", T.byte_decode("t").alias("x")).collect()}
    assert found == {1: "hi", 2: None, 3: "", 4: "(ä"}


def test_images_of_a_batch_are_padded_one_by_one(spark):
    from weft.sources.pairs import image_ints

    df = spark.createDataFrame([(1, b"\1\0\0\0\2"), (2, None), (3, b""), (4, b"\xff\xff\xff\xff")], "k int, c binary").coalesce(1)
    found = {r["k"]: r["x"] for r in df.select("k", image_ints(F.col("c")).alias("x")).collect()}
    assert found == {1: [3, 1, 2], 2: None, 3: [0], 4: [0, -1]}


def test_sentences_are_those_of_the_plain_pattern(spark):
    import random
    import re

    from weft.functions.text import split_sentences

    pick = random.Random(5)
    texts = ["".join(pick.choice("ab.!? \n") for _ in range(pick.randrange(40))) for _ in range(400)] + ["a.b" * 100_000, ". a", "?? a.", "..", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {r["k"]: r["s"] for r in df.select("k", split_sentences("t", keep_newlines=True).alias("s")).collect()}
    plain = re.compile(r"[\s\S]+?[.!?]+(?:[ \n]+|\Z)|[\s\S]+\Z")
    assert found == {k: plain.findall(t) for k, t in enumerate(texts)}


def test_runs_cut_a_text_once(spark):
    from weft.functions.text import split_sentences
    from weft.operators import runs as R

    docs = spark.createDataFrame([(1, "a. bb. ccc. dddd."), (2, "one."), (3, "x" * 600 + ". b."), (4, None)], "doc_id bigint, text string")
    lengths = docs.select("doc_id", F.transform(split_sentences("text"), lambda s: F.octet_length(s)).alias("sentence_lengths"), F.lit(2).alias("title_length"))
    runs = R.sentence_runs(lengths, 5)
    assert runs._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2  # the rows and their bucket totals
    assert sorted((r["doc_id"], r["first"], r["last"]) for r in runs.collect()) == [(1, 0, 2), (1, 2, 4)]
    assert {r["doc_id"] for r in R.title_blocks(lengths, 12).collect()} == {1, 2}
