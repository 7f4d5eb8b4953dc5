"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers, found by pattern and
checked (parts up to 255; 13 to 19 digits and the Luhn sum; 9 to 15 digits).  A base value is a protected
entity, and so is its class: the domain of a mail address, the first three parts of an IP address, the first six
digits of a card, a telephone number without its last four digits.  The kind is no entity: the label shows it.
The method adds *terms*: words that give an entity away.  Over the whole corpus,

* the information of an entity e is ``IC(e) = log2(N / n_e)``,
* what a term t tells about it is ``PMI(t, e) = log2(P(e | t) * N / n_e)`` with
  ``P(e | t) = (n_te - 1) / (n_t - 1)``,

with N documents, n_e that hold the entity, n_t that hold the term and n_te that hold both, anywhere in their text.
``P`` leaves the document out that is to be cleaned: a word of one document only tells nothing by the others.  A
term with ``PMI >= DISCLOSURE * IC`` is a span wherever it stands in a document that holds the entity, unless chance
gives as much: by Chernoff's bound (n_te - 1 of n_t - 1 documents at the rate n_e / N) each pair of a term and an entity has a
probability, and of the pairs that are taken, at most a share ``CHANCE`` may be expected to be false among all that meet more
than once (Benjamini and Hochberg).  A class of entities of one document each can have terms, too.  A term is
generalised to a class label; one that tells the entity outright (``PMI >= REMOVAL * IC``) is removed.  A word that
overlaps a base span is no term there and isn't counted there.  Documents with a base span count once for each distinct text, so
copies are no evidence; copies among the others count each, which only makes a word tell less.

Positions are code points.  All matches of a pattern and the pieces between them give the positions as running
sums.  Only documents with some base match go through that; the others pass in one scan.

A null or empty text has no spans; it stays null or empty.  Repeated rows and ids are separate rows of the result,
null ids are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.arrow import stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The base patterns, written so that a search never starts inside a run that it has already refused:
#: ``\G`` is the end of the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # a run of fewer than 13 digits is never a card, so only longer ones are matched
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A document without this has no base match.
SOME = r"@|[0-9]\.[0-9]|[0-9](?:[\x20-]?[0-9]){12}|\+[0-9]"

DISCLOSURE = 0.8
REMOVAL = 0.95
#: Share of false pairs that may be expected among those taken as evidence.
CHANCE = 0.01
#: Steps of the evidence histogram in a nat, and the nats beyond which all evidence counts alike.
STEPS, MOST_EVIDENCE = 8, 400
#: A term: letters, then letters or digits.
WORD = r"\p{L}[\p{L}\p{N}]*+"
#: Stands for every character of a base span (a noncharacter), and counts as a letter there.
FILL = "\uffff"
FILLED_WORD = rf"[\p{{L}}{FILL}][\p{{L}}\p{{N}}{FILL}]*+"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", TERM: "[TERM]", "removed": ""}


def _kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, TERM)]), kind)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, nines taken off: the sum is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)
    ))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    small = F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", n.between(13, 19) & F.when(n <= 19, _luhn(digits)).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def base_spans(rows: DataFrame) -> DataFrame:
    """``row, kind, start, end, value`` of all base spans of ``row, text``."""

    def found(kind: str) -> Column:
        pattern = PATTERNS[kind]
        matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        gaps = F.split("text", pattern, -1)
        return F.transform(matches, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), m.alias("value")))

    every = F.concat(*[found(k) for k in KINDS])
    one = rows.select("row", F.explode(every).alias("m")).select("row", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(F.length("value")).over(before), F.lit(0))
    placed = one.withColumn("start", start).withColumn("end", F.col("start") + F.length("value"))
    return placed.filter(_holds(F.col("kind"), F.col("value"))).select("row", "kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "value")


def _runs(spans: DataFrame, label: Column) -> DataFrame:
    """``row, parts, last``: overlapping spans made one, each with the end of the one before."""
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), _kind_order(F.col("kind")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int")
    runs = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min_by(label, F.struct("start", -F.col("end"), _kind_order(F.col("kind")))).alias("label"),
    )
    previous = F.coalesce(F.lag("end").over(Window.partitionBy("row").orderBy("start")), F.lit(0))
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "previous", "label")))
    return merged.withColumn("previous", previous).groupBy("row").agg(parts.alias("parts"), F.max("end").alias("last"))


def _with_parts(label) -> Column:
    """The text with ``label`` of each part in its place."""
    piece = lambda p: F.concat(F.substring(F.col("text"), p["previous"] + 1, p["start"] - p["previous"]), label(p))
    head = F.array_join(F.transform("parts", piece), "")
    return F.when(F.col("last").isNull(), F.col("text")).otherwise(F.concat(head, F.expr("substring(text, last + 1)")))


def filled(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``row, text``: every character of a base span replaced by ``FILL``, so that positions stay."""
    joined = rows.select("row", "text").join(_runs(spans, F.lit("")), "row", "left")
    return joined.select("row", _with_parts(lambda p: F.repeat(F.lit(FILL), p["end"] - p["start"])).alias("text"))


def _terms(pattern: str) -> Column:
    """The distinct words of the text, in lower case, without those that touch a base span."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.lower))
    return F.filter(words, lambda w: ~F.contains(w, F.lit(FILL)))


def entities(spans: DataFrame) -> DataFrame:
    """``row, entity``: the base values of a document and their classes, each once."""
    kind, value, digits = F.col("kind"), F.col("value"), _digits(F.col("value"))
    part = (
        F.when(kind == "email", F.lower(F.substring_index("value", "@", -1)))
        .when(kind == "ip", F.substring_index("value", ".", 3))
        .when(kind == "card", F.substring(digits, 1, 6))
        .otherwise(F.substring(digits, F.lit(1), F.length(digits) - 4))
    )
    both = F.array(F.concat_ws("=", kind, value), F.concat_ws("~", kind, part))
    return spans.select("row", F.explode(both).alias("entity")).distinct()


def evidence_needed(stats: DataFrame, share: float = CHANCE) -> float:
    """The least evidence (nats) at which the pairs beyond it hold at most ``share`` of false ones, expected among
    all pairs that meet more than once; from a histogram of some thousand rows at most."""
    step = F.floor(F.least("evidence", F.lit(float(MOST_EVIDENCE))) * STEPS)
    counts = {r["step"]: r["n"] for r in stats.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    tests, taken, needed = sum(counts.values()), 0, float("inf")
    for at in sorted(counts, reverse=True):
        taken += counts[at]
        if tests * math.exp(-at / STEPS) <= share * taken:
            needed = at / STEPS
    return needed


def disclosing(left: DataFrame, spans: DataFrame, clean: DataFrame) -> DataFrame:
    """``row, term, removed``: terms of a document that give one of its entities away, by the whole
    corpus: ``left`` is what the base spans leave of the numbered documents (``first`` of their text or not), ``clean`` the others."""
    once = left.filter("first")
    total = once.select(F.lit(1)).unionByName(clean.select(F.lit(1))).agg(F.count(F.lit(1)).alias("n"))
    held = entities(spans).join(left.select("row", "first"), "row")
    # an entity or a term of one document has no others to tell by
    known = held.join(held.filter("first").groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter("n_e > 1"), "entity")
    known = stored(known.crossJoin(F.broadcast(total)).filter("n_e < n"), "entities")  # one row
    words = once.select(F.explode(_terms(FILLED_WORD)).alias("term")).unionByName(clean.select(F.explode(_terms(WORD)).alias("term")))
    # documents per term: counted map-side, then met with the terms in question
    holding = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).filter("n_t > 1")
    wanted = left.join(known.select("row").distinct(), "row", "left_semi").select("row", F.explode(_terms(FILLED_WORD)).alias("term"))
    rate = F.col("n_e") / F.col("n")
    # n_te is n_e at most, so that a common word is out before it meets a rare entity
    able = F.col("n_e") - 1 >= (F.col("n_t") - 1) * F.pow(rate, F.lit(1 - DISCLOSURE)) * (1 - 1e-9)
    met = wanted.join(holding, "term").join(known, "row").filter(able)
    pairs = stored(met.select("row", "entity", "term", "first", "n_t", "n_e", "n"), "pairs")
    k, others = F.col("n_te") - 1, F.col("n_t") - 1
    pmi, ic = F.log2(k / others / rate), -F.log2(rate)
    misses = F.when(others > k, (others - k) * F.log((1 - k / others) / (1 - rate))).otherwise(F.lit(0.0))
    stats = pairs.filter("first").groupBy("entity", "term", "n_t", "n_e", "n").agg(F.count(F.lit(1)).alias("n_te")).filter("n_te > 1")
    evidence = F.when(k / others > rate, k * F.log(k / others / rate) + misses).otherwise(F.lit(0.0))
    stats = stored(stats.select("entity", "term", (pmi >= DISCLOSURE * ic).alias("tells"), (pmi >= REMOVAL * ic).alias("removed"), evidence.alias("evidence")), "stats")
    told = stats.filter(F.col("tells") & (F.col("evidence") >= evidence_needed(stats))).select("entity", "term", "removed")
    return pairs.join(told, ["entity", "term"]).groupBy("row", "term").agg(F.max("removed").alias("removed"))


def placed(left: DataFrame, told: DataFrame) -> DataFrame:
    """``row, start, end, removed``: wherever the terms of a document stand in it."""
    marked = left.join(told.select("row").distinct(), "row", "left_semi")
    words, gaps = F.regexp_extract_all("text", F.lit(FILLED_WORD), F.lit(0)), F.split("text", FILLED_WORD, -1)
    one = marked.select("row", F.posexplode(F.arrays_zip(words.alias("word"), gaps.alias("gap"))).alias("i", "w")).select("row", "i", "w.*")
    order = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("gap") + F.coalesce(F.length("word"), F.lit(0))).over(order).cast("int")
    every = one.withColumn("end", end).select("row", F.lower("word").alias("term"), (F.col("end") - F.length("word")).alias("start"), "end")
    return every.join(told, ["row", "term"]).select("row", "start", "end", "removed")


def _parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with something like a base span, numbered and written once; the others)."""
    some = F.coalesce(F.col("text").cast("string").rlike(SOME), F.lit(False))
    held = docs.filter(some).withColumn("row", F.monotonically_increasing_id())
    return stored(held, "held"), docs.filter(~some)


def find_spans(clean: DataFrame, held: DataFrame) -> DataFrame:
    """``row, kind, start, end, removed``: base spans and terms of the numbered documents."""
    spans = stored(base_spans(held.select("row", F.col("text").cast("string").alias("text"))), "spans")
    whole = held.select("row", F.md5(F.col("text").cast("string")).alias("print"))
    firsts = whole.groupBy("print").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    left = filled(held, spans).join(firsts, "row", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    left = stored(left, "left")
    terms = placed(left, stored(disclosing(left, spans, clean), "told"))
    return spans.select("row", "kind", "start", "end", F.lit(False).alias("removed")).unionByName(
        terms.select("row", F.lit(TERM).alias("kind"), "start", "end", "removed")
    )


def _listed(spans: Column) -> Column:
    """kind:start:end in order of kind, then start."""
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_table(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term``."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held, clean = _parts(source)
    spans = find_spans(clean, held)
    entry = F.struct(_kind_order(F.col("kind")).alias("order"), "start", "end", "kind")
    per_row = spans.groupBy("row").agg(
        *[F.sum((F.col("kind") == k).cast("bigint")).alias(f"n_{k}") for k in (*KINDS, TERM)],
        F.collect_list(F.when(F.col("kind") != TERM, entry)).alias("base"),
        F.collect_list(entry).alias("every"),
    )
    zero = [F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    text = lambda c: F.coalesce(_listed(F.col(c)), F.lit(""))
    full = held.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", *zero, F.sha2(text("base"), 256).alias("base_sha256"), text("every").alias("spans"), F.coalesce("n_term", F.lit(0)).cast("bigint").alias("n_term")
    )
    none = [F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS]
    empty = clean.select("doc_id", *none, F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("bigint").alias("n_term"))
    return full.unionByName(empty)


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents (all columns) with every span of their text replaced by its label.

    Overlapping spans become one, labelled by the one that starts first; ``n_chars``, if there, follows the text.
    """
    # the caller's columns travel as one, so that no name meets one of those used here
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    source = docs.select(F.col("text").cast("string").alias("text"), whole)
    held, clean = _parts(source)
    spans = find_spans(clean, held)
    kind = F.when(F.col("removed"), F.lit("removed")).otherwise(F.col("kind"))
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[kind]
    joined = _runs(spans, label)
    changed = _with_parts(lambda p: p["label"])
    full = held.join(joined, "row", "left").withColumn("whole", F.col("whole").withField("text", changed))
    if "n_chars" in docs.columns:
        n = F.length("whole.text").cast(docs.schema["n_chars"].dataType)
        full = full.withColumn("whole", F.col("whole").withField("n_chars", n))
    return full.select("whole.*").unionByName(clean.select("whole.*"))
