"""Text to token documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import split_sentences
from weft.functions.tokens import byte_encode, empty_ints, encode_with

EOD = 256


def encode(
    df: DataFrame,
    sentences: str | None = None,
    eod: int | None = EOD,
    tokenizer: Callable | None = None,
) -> DataFrame:
    """Adds ``tokens``, ``sentence_lengths`` and ``n_tokens``.

    ``sentences`` names an ``array<string>`` column; without it the ``text`` is one sentence.
    Empty sentences are dropped; a non-empty document gets the end token, counted in its
    last sentence.  ``tokenizer`` is a factory for a tokenizer object, default bytes.
    """
    parts = F.col(sentences) if sentences else F.array(F.col("text"))
    parts = F.coalesce(parts, F.array().cast("array<string>"))
    if tokenizer is None:
        return _encode_bytes(df, parts, eod, joined=None if sentences else F.coalesce("text", F.lit("")))
    coded = encode_with(df.withColumn("__parts", parts), "__parts", "__ids", tokenizer)
    coded = coded.drop("__parts").withColumn("__ids", F.filter("__ids", lambda a: F.size(a) > 0))
    return _close(coded, eod).drop("__ids")


def _encode_bytes(df: DataFrame, parts: Column, eod: int | None, joined: Column | None) -> DataFrame:
    """Bytes of sentences concatenate, so the joined text is encoded once and every length comes
    from the text: a filter on ``n_tokens`` never encodes anything."""
    text = F.array_join(parts, "") if joined is None else joined
    end = 0 if eod is None else 1
    ids = byte_encode(text)
    tokens = ids if eod is None else F.when(text == "", empty_ints()).otherwise(
        F.concat(ids, F.array(F.lit(eod)))
    )
    kept = F.filter(parts, lambda s: s != "")
    plain = F.transform(kept, lambda s: F.octet_length(s))
    lengths = plain
    if end:
        head, last = F.slice(plain, F.lit(1), F.greatest(F.size(plain) - 1, F.lit(0))), F.slice(plain, -1, 1)
        lengths = F.when(F.size(kept) == 0, empty_ints()).otherwise(
            F.concat(head, F.transform(last, lambda n: n + 1))
        )
    n_bytes = F.octet_length(text)
    return (
        df.withColumn("tokens", tokens)
        .withColumn("sentence_lengths", lengths)
        .withColumn("n_tokens", F.when(n_bytes > 0, n_bytes + end).otherwise(F.lit(0)))
    )


def _close(coded: DataFrame, eod: int | None) -> DataFrame:
    ids = F.col("__ids")
    lengths = F.transform(ids, lambda a: F.size(a))
    tokens: Column = F.flatten(ids)
    if eod is not None:
        some = F.size(ids) > 0
        last = F.size(ids) - 1
        tokens = F.when(some, F.concat(tokens, F.array(F.lit(eod)))).otherwise(empty_ints())
        lengths = F.transform(ids, lambda a, i: F.size(a) + F.when(i == last, 1).otherwise(0))
    return (
        coded.withColumn("tokens", tokens)
        .withColumn("sentence_lengths", lengths)
        .withColumn("n_tokens", F.size("tokens"))
    )


def byte_corpus(documents: DataFrame, dataset: str = "source") -> DataFrame:
    """(dataset, doc_id, tokens, n_tokens) of non-empty documents, one sequence each."""
    return (
        encode(documents)
        .filter("n_tokens > 0")
        .select(F.col(dataset).alias("dataset"), "doc_id", "tokens", "n_tokens")
    )


def byte_lengths(documents: DataFrame, dataset: str = "source") -> DataFrame:
    """(dataset, doc_id, n_tokens) of the same corpus, from text lengths alone."""
    n = F.octet_length("text")
    return documents.filter(n > 0).select(
        F.col(dataset).alias("dataset"), "doc_id", (n + 1).alias("n_tokens")
    )


def sentence_corpus(documents: DataFrame, dataset: str = "source") -> DataFrame:
    """(dataset, doc_id, sentences, tokens, sentence_lengths, n_tokens)."""
    split = documents.withColumn("sentences", split_sentences("text"))
    return encode(split, "sentences", eod=None).select(
        F.col(dataset).alias("dataset"),
        "doc_id",
        "sentences",
        "tokens",
        "sentence_lengths",
        "n_tokens",
    )
