"""Queries: corpus intake, encoding, samples and blends on ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as X
from weft.functions.ordering import ranged_running
from weft.functions.tokens import byte_decode, byte_encode, encode_with, int_encode, int_offsets, load_tokenizer
from weft.operators import encode as E
from weft.operators import samples as S
from weft.plans.build import BuildConfig, build_splits
from weft.plans.registry import digest, query
from weft.sources import corpus as C

LENGTH = 256
SEED = 1234

WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)"
HEXBYTES = (
    "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x'||h)::INT)"
)
# corp: one row per non-empty document with its byte count plus end token
CORP = (
    "corp AS (SELECT source AS dataset, doc_id, octet_length(encode(text))+1 AS n "
    "FROM documents WHERE octet_length(encode(text))>0)"
)


@query(
    "a2_ingest_filter",
    f"SELECT doc_id, lang, n_chars FROM documents WHERE length(trim(text, {WS}))>100 "
    "ORDER BY doc_id LIMIT 700",
)
def ingest(t):
    return C.ingest_filter(t.documents, 700).select("doc_id", "lang", "n_chars")


@query(
    "a2_ingest_filter_bulk",
    f"SELECT doc_id, lang FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 770) "
    f"WHERE length(trim(text, {WS}))>100 ORDER BY doc_id LIMIT 700",
)
def ingest_bulk(t):
    return C.ingest_filter(t.documents, 700, bulk=True).select("doc_id", "lang")


def shard_frames(t):
    docs = E.encode(t.documents, eod=None).filter("n_tokens > 0")
    shards = {}
    for lang in ("en", "de"):
        part = docs.filter(F.col("lang") == lang).select("doc_id", "tokens", "n_tokens")
        ids = ranged_running(part.select("doc_id"), ["doc_id"], out="seq_id")
        shards[f"part_{lang}"] = part.join(ids, "doc_id").select(
            F.col("seq_id").alias("doc_id"), "seq_id", "tokens", "n_tokens"
        )
    return shards


@query(
    "a5_merge_corpora",
    f"""WITH d AS (SELECT doc_id, lang, octet_length(encode(text)) AS n, {HEXBYTES} AS tk
      FROM documents WHERE octet_length(encode(text))>0 AND lang IN ('de','en'))
    SELECT (CASE lang WHEN 'de' THEN 0 ELSE 1 END)::INT AS shard,
      row_number() OVER (ORDER BY lang, doc_id)-1 AS seq_id,
      row_number() OVER (ORDER BY lang, doc_id)-1 AS doc_id,
      n::INT AS n_tokens, md5(array_to_string(tk,' ')) AS tokens FROM d""",
)
def merge(t):
    merged = C.merge_corpora(shard_frames(t))
    return merged.select("shard", "seq_id", "doc_id", "n_tokens", digest("tokens").alias("tokens"))


@query(
    "a6_dataset_counts",
    """SELECT source AS dataset, count(*)::BIGINT AS n_sequences,
      (count(DISTINCT doc_id)+1)::BIGINT AS n_documents, min(doc_id) AS first_mention
    FROM documents WHERE octet_length(encode(text))>0 GROUP BY 1""",
)
def counts(t):
    return C.dataset_counts(E.byte_lengths(t.documents))


@query(
    "a7_partition_round_robin",
    "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id)-1)%7)::INT AS part FROM documents",
)
def round_robin(t):
    return C.partition_corpus(t.documents, 7)


@query(
    "a7_partition_sequential",
    """SELECT doc_id, ((row_number() OVER (ORDER BY doc_id)-1)
      // ceil((SELECT count(*) FROM documents)/7.0)::BIGINT)::INT AS part FROM documents""",
)
def sequential(t):
    return C.partition_corpus(t.documents, 7, sequential=True)


@query(
    "a8_lines_corpus",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)
    SELECT doc_id, count(*)::BIGINT AS n_lines, sum(octet_length(encode(text)))::BIGINT AS n_tokens,
      min(md5(array_to_string({HEXBYTES},' '))) AS first_line
    FROM l WHERE text<>'' GROUP BY 1""",
)
def lines(t):
    split = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    coded = C.encode_lines(split.filter("text <> ''"))
    return coded.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("n_tokens").alias("n_tokens"),
        F.min(digest("tokens")).alias("first_line"),
    )


SENT = r"[\s\S]+?[.!?]+(?:\s+|\z)|[\s\S]+\z"
# sentences of a text as DuckDB list; every given text is below one slice of a million characters
SENTS_KEEP = f"regexp_extract_all(text, '{SENT}')"
SENTS = (
    f"list_filter(list_transform({SENTS_KEEP}, lambda s: trim(s, {WS})), lambda s: s<>'')"
)


@query(
    "b1_split_sentences",
    f"""SELECT doc_id, len({SENTS})::INT AS n, md5(array_to_string({SENTS}, '|')) AS sentences,
      len({SENTS_KEEP})::INT AS n_keep, md5(array_to_string({SENTS_KEEP}, '|')) AS kept
    FROM documents""",
)
def sentences(t):
    split, kept = X.split_sentences("text"), X.split_sentences("text", keep_newlines=True)
    return t.documents.select(
        "doc_id",
        F.size(split).alias("n"),
        digest(split, "|").alias("sentences"),
        F.size(kept).alias("n_keep"),
        digest(kept, "|").alias("kept"),
    )


@query(
    "b2_encode_sentences",
    f"""WITH s AS (SELECT doc_id, {SENTS} AS ss FROM documents),
    e AS (SELECT doc_id, list_transform(ss, lambda x: octet_length(encode(x))::INT) AS ls,
      array_to_string(ss,'') AS text FROM s)
    SELECT doc_id, (CASE WHEN len(ls)=0 THEN 0 ELSE list_sum(ls)+1 END)::INT AS n_tokens,
      md5(array_to_string(list_transform(ls, lambda x, i: x + CASE WHEN i=len(ls) THEN 1 ELSE 0 END),' ')) AS lengths,
      md5(array_to_string(CASE WHEN len(ls)=0 THEN [] ELSE list_append({HEXBYTES},256) END,' ')) AS tokens
    FROM e""",
)
def encode_sentences(t):
    split = t.documents.withColumn("ss", X.split_sentences("text"))
    return E.encode(split, "ss").select(
        "doc_id",
        "n_tokens",
        digest("sentence_lengths").alias("lengths"),
        digest("tokens").alias("tokens"),
    )


@query(
    "b3_end_of_document",
    """SELECT doc_id, CASE WHEN octet_length(encode(text))=0 THEN 0 ELSE octet_length(encode(text))+1 END::INT AS n_tokens,
      CASE WHEN octet_length(encode(text))=0 THEN NULL ELSE 256 END AS last_token FROM documents""",
)
def end_token(t):
    return E.encode(t.documents).select(
        "doc_id", "n_tokens", F.try_element_at("tokens", F.lit(-1)).alias("last_token")
    )


@query(
    "b4_byte_tokens",
    f"""SELECT doc_id, md5(array_to_string({HEXBYTES},' ')) AS tokens,
      md5(rtrim(text, {WS})) AS decoded FROM documents""",
)
def byte_tokens(t):
    coded = t.documents.select("doc_id", byte_encode("text").alias("tk"))
    return coded.select(
        "doc_id",
        digest("tk").alias("tokens"),
        F.md5(byte_decode(F.array_append("tk", F.lit(300)))).alias("decoded"),
    )


@query(
    "b5_integer_tokens",
    """WITH s AS (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey) AS txt
      FROM lineitem GROUP BY 1),
    x AS (SELECT l_orderkey, list_transform(string_split(txt,' '), lambda v: v::INT) AS ids, string_split(txt,' ') AS w FROM s)
    SELECT l_orderkey, array_to_string(ids,' ') AS ids,
      array_to_string(list_transform(w, lambda v, i: COALESCE(list_sum(list_transform(w[1:i-1], lambda y: length(y)+1)),0)::INT),' ') AS starts
    FROM x""",
)
def integer_tokens(t):
    parts = t.lineitem.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p")
    )
    joined = parts.select(
        "l_orderkey",
        F.array_join(F.transform("p", lambda p: p["l_partkey"].cast("string")), " ").alias("txt"),
    )
    return joined.select(
        "l_orderkey",
        F.array_join(int_encode("txt").cast("array<string>"), " ").alias("ids"),
        F.array_join(int_offsets("txt").cast("array<string>"), " ").alias("starts"),
    )


@query(
    "b6_clean_text",
    r"""SELECT doc_id, md5(replace(replace(replace(regexp_replace(text, '\s+', ' ', 'g'),
      ' . ','. '),' . ','. '),' . ','. ')) AS cleaned FROM documents""",
)
def cleaned(t):
    return t.documents.select("doc_id", F.md5(X.clean_text("text")).alias("cleaned"))


@query(
    "b7_clip_utf8",
    f"""WITH d AS (SELECT doc_id, replace(text,'<|endoftext|>','') AS text FROM documents),
    c AS (SELECT doc_id, i, sum(octet_length(encode(ch))) OVER (PARTITION BY doc_id ORDER BY i) AS upto
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch, unnest(range(1, length(text)+1)) AS i FROM d WHERE octet_length(encode(text))>2048)),
    k AS (SELECT doc_id, max(i) AS k FROM c WHERE upto<=2048 GROUP BY 1)
    SELECT d.doc_id, CASE WHEN trim(text,{WS})='' THEN NULL ELSE md5(left(text, COALESCE(k, length(text)))) END AS clipped
    FROM d LEFT JOIN k USING (doc_id)""",
)
def clipped(t):
    return t.documents.select("doc_id", F.md5(X.clip_utf8("text", 2048)).alias("clipped"))


@query(
    "b8_split_reasoning",
    """WITH d AS (SELECT doc_id, CASE doc_id%4
        WHEN 0 THEN 'pre<think>' || left(text,50) || '</think>' || substr(text,51)
        WHEN 1 THEN left(text,30) || '</think>' || substr(text,31)
        WHEN 2 THEN '<think>' || text ELSE text END AS x FROM documents)
    SELECT doc_id,
      md5(CASE WHEN doc_id%4<2 THEN CASE doc_id%4 WHEN 0 THEN 'pre' ELSE '' END
        || substr(x, strpos(x,'</think>')+8) ELSE x END) AS rest,
      md5(CASE doc_id%4 WHEN 0 THEN substr(x, 11, strpos(x,'</think>')-11)
        WHEN 1 THEN left(x, strpos(x,'</think>')-1) END) AS reasoning FROM d""",
)
def reasoning(t):
    mod = F.col("doc_id") % 4
    x = (
        F.when(mod == 0, F.expr("'pre<think>' || left(text,50) || '</think>' || substr(text,51)"))
        .when(mod == 1, F.expr("left(text,30) || '</think>' || substr(text,31)"))
        .when(mod == 2, F.expr("'<think>' || text"))
        .otherwise(F.col("text"))
    )
    split = t.documents.select("doc_id", X.split_reasoning(x).alias("s"))
    return split.select("doc_id", F.md5("s.rest").alias("rest"), F.md5("s.reasoning").alias("reasoning"))


# ---- samples -------------------------------------------------------------------------------

def sized(t):
    return E.byte_lengths(t.documents)


def one_corpus(t):
    return sized(t).withColumn("dataset", F.lit("all"))


RANKED = f"""{CORP}, ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY doc_id)-1 AS o,
  count(*) OVER (PARTITION BY dataset) AS m FROM corp)"""


@query(
    "c2_split_corpus",
    f"""WITH {RANKED}
    SELECT dataset, doc_id, CASE WHEN o<round_even(0.7*m,0) THEN 'train'
      WHEN o<round_even((0.7+0.2)*m,0) THEN 'valid' ELSE 'test' END AS split FROM ranked""",
)
def split(t):
    return S.split_corpus(sized(t), "70,20,10").select("dataset", "doc_id", "split")


# three epochs over every data set for c5-c10: samples asked = 2.3 epochs
def asked(t):
    return (
        sized(t)
        .groupBy("dataset")
        .agg(F.floor(F.sum("n_tokens") * 23 / (10 * LENGTH)).cast("bigint").alias("requested"))
    )


PLAN = f"""{CORP}, st AS (SELECT dataset, count(*) AS n_docs, sum(n)::BIGINT AS t,
    floor(sum(n)*23/(10*{LENGTH}))::BIGINT AS requested FROM corp GROUP BY 1),
  pl0 AS (SELECT *, greatest(1, (requested*{LENGTH}+1+t-1)//t) AS e FROM st),
  pl1 AS (SELECT *, ((e-1)*t-1)//{LENGTH} AS head, (t-1)//{LENGTH} AS per FROM pl0),
  pl AS (SELECT *, e>1 AND requested-head < floor(0.8::DOUBLE*per) AS apart, (e*t-1)//{LENGTH} AS ns FROM pl1)"""
ORDER = f"""{PLAN}, cp AS (SELECT dataset, doc_id, n, e, unnest(range(e)) AS epoch, apart, ns, head FROM corp JOIN pl USING (dataset)),
  keyed AS (SELECT *, (apart AND epoch=e-1)::INT AS phase, md5(concat_ws('|','{SEED}',dataset,epoch,doc_id)) AS k FROM cp),
  ord AS (SELECT *, row_number() OVER w -1 AS pos, sum(n) OVER w - n AS start FROM keyed
    WINDOW w AS (PARTITION BY dataset ORDER BY phase, k, epoch, doc_id ROWS UNBOUNDED PRECEDING))"""


@query(
    "c5_epochs_needed",
    f"""WITH {PLAN} SELECT dataset, n_docs, t AS epoch_tokens, requested, e AS epochs, head AS head_samples,
      per AS epoch_samples, apart AS last_apart, ns AS n_samples FROM pl""",
)
def epochs(t):
    return S.epoch_plan(sized(t), LENGTH, asked(t)).drop("total_tokens")


@query(
    "c6_document_order",
    f"WITH {ORDER} SELECT dataset, epoch::INT AS epoch, doc_id, pos, start::BIGINT AS start FROM ord",
)
def order(t):
    plan = S.epoch_plan(sized(t), LENGTH, asked(t))
    return S.document_order(sized(t), plan, SEED).drop("n_tokens")


BOUNDS = f"""SELECT dataset, j AS sample_id, pos AS doc_pos, (CASE WHEN j=0 THEN 0 ELSE j*{LENGTH}-start END)::BIGINT AS "offset" FROM
  (SELECT dataset, pos, start, n, unnest(range(((start+{LENGTH}-1)//{LENGTH})::BIGINT, least((start+n-1)//{LENGTH}, ns)::BIGINT+1)) AS j FROM ord)"""


@query("c7_sample_bounds", f"WITH {ORDER} {BOUNDS}")
def bounds(t):
    plan = S.epoch_plan(sized(t), LENGTH, asked(t))
    return S.sample_bounds(S.document_order(sized(t), plan, SEED), plan, LENGTH)


@query(
    "c8_shuffle_samples",
    f"""WITH {PLAN}, sm AS (SELECT dataset, unnest(range(ns)) AS sample_id, apart, head FROM pl)
    SELECT dataset, sample_id, row_number() OVER (PARTITION BY dataset ORDER BY (apart AND sample_id>=head),
      md5(concat_ws('|','{SEED}',dataset,sample_id)))-1 AS k FROM sm""",
)
def shuffled(t):
    plan = S.epoch_plan(sized(t), LENGTH, asked(t))
    cuts = S.sample_bounds(S.document_order(sized(t), plan, SEED), plan, LENGTH)
    return S.shuffle_samples(cuts, plan, SEED)


# one epoch for the token-level queries
FLAT = f"""WITH {CORP}, ord AS (SELECT dataset, doc_id, n, md5(concat_ws('|','{SEED}',dataset,0,doc_id)) AS k FROM corp),
  pos AS (SELECT *, sum(n) OVER (PARTITION BY dataset ORDER BY k ROWS UNBOUNDED PRECEDING)-n AS start,
    sum(n) OVER (PARTITION BY dataset) AS t FROM ord),
  b AS (SELECT doc_id, list_append({HEXBYTES}, 256) AS tk FROM documents WHERE octet_length(encode(text))>0),
  tok AS (SELECT dataset, t, (start + unnest(range(n)))::BIGINT AS p, unnest(tk) AS v, doc_id FROM pos JOIN b USING (doc_id)),
  sam AS (SELECT dataset, p//{LENGTH} AS sample_id, p, v, doc_id FROM tok WHERE p//{LENGTH} < (t-1)//{LENGTH}
    UNION ALL SELECT dataset, p//{LENGTH}-1, p, v, doc_id FROM tok WHERE p%{LENGTH}=0 AND p>0 AND p//{LENGTH} <= (t-1)//{LENGTH}),
  g AS (SELECT dataset, sample_id::BIGINT AS sample_id, list(v ORDER BY p) AS tk, list(doc_id ORDER BY p) AS ds FROM sam GROUP BY 1,2)"""


def samples(t):
    plan = S.epoch_plan(sized(t), LENGTH)
    return S.materialize(
        S.document_order(sized(t), plan, SEED), plan, E.byte_corpus(t.documents), LENGTH
    )


@query(
    "c9_materialize",
    f"""{FLAT} SELECT dataset, sample_id, len(tk)::INT AS n, md5(array_to_string(tk,' ')) AS tokens,
      len(list_distinct(ds))::INT AS n_docs FROM g""",
)
def materialized(t):
    return samples(t).select(
        "dataset",
        "sample_id",
        F.size("tokens").alias("n"),
        digest("tokens").alias("tokens"),
        F.size("doc_ids").alias("n_docs"),
    )


@query(
    "c10_lm_columns",
    f"""{FLAT} SELECT dataset, sample_id, md5(array_to_string(tk[1:{LENGTH}],' ')) AS input,
      md5(array_to_string(tk[2:{LENGTH}+1],' ')) AS labels, {LENGTH}::BIGINT AS loss_tokens FROM g""",
)
def lm(t):
    return S.lm_columns(samples(t)).select(
        "dataset",
        "sample_id",
        digest("input").alias("input"),
        digest("labels").alias("labels"),
        F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("loss_tokens"),
    )


LTOR_SQL = f"""{FLAT}, f AS (SELECT dataset, sample_id, tk[1:{LENGTH}] AS tk FROM g),
  u AS (SELECT dataset, sample_id, unnest(range({LENGTH})) AS i, unnest(tk) AS v FROM f),
  w AS (SELECT *, COALESCE(max(CASE WHEN v=256 THEN i+1 END) OVER (PARTITION BY dataset, sample_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS f,
    COALESCE(sum((v=256)::INT) OVER (PARTITION BY dataset, sample_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS seg FROM u)"""


@query(
    "c11_ltor_columns",
    f"""{LTOR_SQL} SELECT dataset, sample_id, md5(string_agg((i-f)::VARCHAR,' ' ORDER BY i)) AS position_ids,
      md5(string_agg(seg::VARCHAR,' ' ORDER BY i)) AS segment_ids,
      md5(string_agg(CASE WHEN v=256 THEN '0' ELSE '1' END,' ' ORDER BY i)) AS loss_mask FROM w GROUP BY 1,2""",
)
def ltor(t):
    cols = S.ltor_columns(S.lm_columns(samples(t)), eod=E.EOD)
    return cols.select(
        "dataset",
        "sample_id",
        digest("position_ids").alias("position_ids"),
        digest("segment_ids").alias("segment_ids"),
        digest("loss_mask").alias("loss_mask"),
    )


@query(
    "c12_ltor_pad_mask",
    f"""{LTOR_SQL} SELECT dataset, sample_id, sum(CASE WHEN v IN (256, 32) THEN 0 ELSE 1 END)::BIGINT AS loss_tokens,
      max(seg)::INT AS segments FROM w GROUP BY 1,2""",
)
def ltor_pad(t):
    # the blank (32) stands for the padding id, so that the mask has work to do
    cols = S.ltor_columns(S.lm_columns(samples(t)), eod=E.EOD, pad=32)
    return cols.select(
        "dataset",
        "sample_id",
        F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("loss_tokens"),
        F.array_max("segment_ids").alias("segments"),
    )


def per_source(t):
    """Samples numbered per source: here one sample per document."""
    return ranged_running(sized(t).select("dataset", "doc_id"), ["doc_id"], within=["dataset"], out="k")


def weights(t):
    """Weights 1..20 by position of the source name, a fixed table of 20 names."""
    return {f"src{i}": float(1 + i % 5) for i in range(20)}


WTS = "wts AS (SELECT 'src'||i AS dataset, i::INT AS d, (1+i%5)/60.0::DOUBLE AS w FROM range(20) r(i))"
KS = f"{CORP}, ks AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY doc_id)-1 AS k FROM corp)"


def blend_size(t):
    """A size every source can serve: a third of the rows."""
    return sized(t).count() // 3


@query(
    "c13_blend_stride",
    f"""WITH {KS}, {WTS}, r AS (SELECT row_number() OVER (ORDER BY (k+0.5)/w, d, k)-1 AS i, dataset, k FROM ks JOIN wts USING (dataset))
    SELECT i, dataset, k FROM r WHERE i < (SELECT count(*)//3 FROM corp)""",
)
def blend_stride(t):
    return S.blend(per_source(t), weights(t), blend_size(t))


def greedy_sql(n: int | str, w: str, steps: str, limited: bool = False) -> str:
    """``g``: the greedy schedule step by step: ``i``, counts ``c`` before it and the source ``d`` (from 1) it takes."""
    spent = "CASE WHEN c[j]>=z[j] THEN -1e300 END" if limited else "NULL"
    error = f"list_transform(w, lambda v, j: coalesce({spent}, v*greatest(i,1)-c[j]))"
    return f"""ws AS ({w}), s0 AS (SELECT 0::BIGINT AS i, list_transform(range({n}), lambda x: 0::BIGINT) AS c),
    g AS (SELECT i, c, list_position(e, list_max(e)) AS d FROM (SELECT i, c, {error} AS e FROM s0, ws) WHERE {steps}>0
      UNION ALL SELECT i, c, list_position(e, list_max(e)) FROM (SELECT i, c, {error} AS e FROM
        (SELECT i+1 AS i, list_transform(c, lambda x, j: CASE WHEN j=d THEN x+1 ELSE x END) AS c FROM g WHERE i+1<{steps}), ws))"""


TABLE_WEIGHTS = "SELECT list_transform(range(20), lambda i: (1+i%5)/60.0::DOUBLE) AS w"


@query(
    "c13_blend_exact",
    f"""WITH RECURSIVE {KS}, {greedy_sql(20, TABLE_WEIGHTS, '(SELECT count(*)//3 FROM corp)')}
    SELECT i, 'src'||(d-1) AS dataset, c[d] AS k FROM g""",
)
def blend_exact(t):
    return S.blend(per_source(t), weights(t), blend_size(t), mode="exact")


@query(
    "c14_blend_exhaustive",
    f"""WITH {KS}, z AS (SELECT dataset, count(*) AS n, row_number() OVER (ORDER BY dataset) AS d FROM ks GROUP BY 1),
    tt AS (SELECT sum(n)::DOUBLE AS t FROM z)
    SELECT row_number() OVER (ORDER BY (k+0.5)/(n::DOUBLE/t), d, k)-1 AS i, dataset, k FROM ks JOIN z USING (dataset), tt""",
)
def exhaustive(t):
    return S.blend_exhaustive(per_source(t))


@query(
    "c14_blend_exhaustive_exact",
    f"""WITH RECURSIVE {KS}, zs AS (SELECT list(dataset ORDER BY dataset) AS names, list(n ORDER BY dataset) AS z FROM (SELECT dataset, count(*) AS n FROM ks GROUP BY 1)),
    {greedy_sql('(SELECT len(z) FROM zs)', 'SELECT z, list_transform(z, lambda n: n/(list_sum(z)::DOUBLE)) AS w FROM zs', '(SELECT count(*) FROM corp)', limited=True)}
    SELECT i, names[d] AS dataset, c[d] AS k FROM g, zs""",
)
def exhaustive_exact(t):
    return S.blend_exhaustive(per_source(t), mode="exact")


@query(
    "c15_oversampled",
    f"""WITH RECURSIVE {KS}, {greedy_sql(20, TABLE_WEIGHTS, '(SELECT count(*) FROM corp)')},
    asked AS (SELECT 'src'||(d-1) AS dataset, count(*) AS asked FROM g GROUP BY 1), have AS (SELECT dataset, count(*) AS have FROM ks GROUP BY 1)
    SELECT dataset, asked, coalesce(have, 0)::BIGINT AS have FROM asked LEFT JOIN have USING (dataset) WHERE asked > coalesce(have, 0)""",
)
def oversampled(t):
    """As many samples as there are documents, by weights that the sources can't serve."""
    return S.oversampled(per_source(t), weights(t), sized(t).count())


def built_sql(corpus: str, requested: str, shares: str, valid_apart: bool = False) -> str:
    """All splits: samples asked of each source (``requested`` over ``tt``), then ``shares`` (split, dataset, d, w, take)."""
    served = "row_number() OVER (PARTITION BY split ORDER BY (k+0.5)/w, d, k)-1"
    i = f"CASE WHEN split='valid' THEN k ELSE {served} END" if valid_apart else served
    return f"""WITH corp AS ({corpus}), ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY doc_id)-1 AS o, count(*) OVER (PARTITION BY dataset) AS m FROM corp),
    sp AS (SELECT dataset, doc_id, n, CASE WHEN o<round_even(0.7*m,0) THEN 'train' WHEN o<round_even((0.7+0.2)*m,0) THEN 'valid' ELSE 'test' END AS split FROM ranked),
    tt AS (SELECT split, dataset, sum(n)::BIGINT AS t, sum(sum(n)) OVER (PARTITION BY split) AS whole FROM sp GROUP BY 1,2),
    rq AS ({requested}), p0 AS (SELECT *, coalesce(greatest(1, (requested*{LENGTH}+1+t-1)//t), 1) AS e FROM rq),
    p1 AS (SELECT *, ((e-1)*t-1)//{LENGTH} AS head, (t-1)//{LENGTH} AS per FROM p0),
    pl AS (SELECT *, coalesce(e>1 AND requested-head < floor(0.8::DOUBLE*per), false) AS apart, ((e*t-1)//{LENGTH})::BIGINT AS ns FROM p1),
    sm AS (SELECT split, dataset, unnest(range(ns)) AS sample_id, apart, head FROM pl WHERE ns>0),
    sh AS (SELECT split, dataset, sample_id, row_number() OVER (PARTITION BY split, dataset ORDER BY (apart AND sample_id>=head)::INT, md5(concat_ws('|','{SEED}',dataset,sample_id)))-1 AS k FROM sm),
    ws AS ({shares}), bl AS (SELECT split, dataset, k, sample_id, take, {i} AS i FROM sh JOIN ws USING (split, dataset))
    SELECT split, i, dataset, k, sample_id::BIGINT AS sample_id FROM bl WHERE i<take OR {"split='valid'" if valid_apart else "false"}"""


def built(t, config, corpus=None):
    parts = build_splits(corpus if corpus is not None else sized(t), config)
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("split"), "i", "dataset", "k", "sample_id")
        out = df if out is None else out.unionByName(df)
    return out


SOURCES = "SELECT source AS dataset, doc_id, octet_length(encode(text))+1 AS n FROM documents WHERE octet_length(encode(text))>0"
LANGUAGES = SOURCES.replace("source AS dataset", "lang AS dataset")
ONE_EPOCH = "SELECT *, NULL::BIGINT AS requested FROM tt"
BY_SAMPLES = "SELECT split, dataset, row_number() OVER (PARTITION BY split ORDER BY dataset) AS d, ns/(sum(ns) OVER (PARTITION BY split))::DOUBLE AS w, {take} AS take FROM pl WHERE ns>0"
ASKED = {"train": 700, "valid": 90, "test": 40}
ASKED_SQL = "CASE split " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in ASKED.items()) + " END"


def by_language(t):
    return E.byte_lengths(t.documents, "lang")


@query("c16_build_splits", built_sql(SOURCES, ONE_EPOCH, BY_SAMPLES.format(take="sum(ns) OVER (PARTITION BY split)")))
def build_names(t):
    """Names alone: every sample of every source once."""
    return built(t, BuildConfig(length=LENGTH, split="70,20,10", seed=SEED))


@query("c16_separate_validation", built_sql(SOURCES, ONE_EPOCH, BY_SAMPLES.format(take="sum(ns) OVER (PARTITION BY split)"), valid_apart=True))
def build_separate(t):
    """The validation set of every source by itself."""
    return built(t, BuildConfig(length=LENGTH, split="70,20,10", seed=SEED, separate_validation=True))


@query(
    "c16_names_with_sizes",
    built_sql(LANGUAGES, f"SELECT *, ceil(({ASKED_SQL})::DOUBLE*t/whole::DOUBLE)::BIGINT AS requested FROM tt", BY_SAMPLES.format(take=f"least({ASKED_SQL}, sum(ns) OVER (PARTITION BY split))")),
)
def build_sized_names(t):
    """Names and sizes: every source is asked for its share by tokens, for as many epochs as that takes."""
    return built(t, BuildConfig(length=LENGTH, split="70,20,10", seed=SEED, sizes=tuple(ASKED.values())), by_language(t))


@query(
    "c16_weights_with_sizes",
    built_sql(
        LANGUAGES,
        f"SELECT tt.*, ceil(ceil(({ASKED_SQL})*w)*(1+0.005::DOUBLE))::BIGINT AS requested FROM tt JOIN (SELECT * FROM (VALUES ('de',0.1::DOUBLE),('en',0.4::DOUBLE),('es',0.3::DOUBLE),('fr',0.2::DOUBLE)) v(dataset, w)) USING (dataset)",
        f"SELECT split, dataset, d, w, {ASKED_SQL} AS take FROM (SELECT DISTINCT split FROM tt), (VALUES ('de',0,0.1::DOUBLE),('en',1,0.4::DOUBLE),('es',2,0.3::DOUBLE),('fr',3,0.2::DOUBLE)) v(dataset, d, w)",
    ),
)
def build_weighted(t):
    """Weights and sizes: every source is asked for its part and a surplus."""
    weights = (("de", 0.1), ("en", 0.4), ("es", 0.3), ("fr", 0.2))
    return built(t, BuildConfig(length=LENGTH, split="70,20,10", seed=SEED, weights=weights, sizes=tuple(ASKED.values())), by_language(t))


# ---- extension points ------------------------------------------------------------------------

# a vocabulary has no SQL: compared with the libraries in the tests
@query("u1_encode_subword")
def encode_subword(t):
    """The sentences of every text by three types of tokenizer."""
    import public_tokenizers

    files = {"bpe-json": "byte_bpe_50k.json", "tiktoken": "byte_bpe_50k.tiktoken", "sentencepiece": "piece_bpe_32k.model"}
    out = t.documents.select("doc_id", X.split_sentences("text").alias("parts"))
    for kind, name in files.items():
        out = encode_with(out, "parts", kind, lambda kind=kind, path=public_tokenizers.path(name): load_tokenizer(kind, path))
    flat = {kind: F.flatten(F.col(f"`{kind}`")) for kind in files}
    columns = [c for kind, ids in flat.items() for c in (F.size(ids).alias(f"n_{kind.split('-')[0]}"), digest(ids).alias(f"ids_{kind.split('-')[0]}"))]
    return out.select("doc_id", *columns)


@query(
    "u4_sample_hook",
    f"""{FLAT} SELECT dataset, sample_id, list_sum(tk)::BIGINT AS total, len(list_filter(tk, lambda x: x>=128))::INT AS high FROM g""",
)
def sample_hook(t):
    """A function of the caller on every sample, as ``DataFrame.transform`` takes it."""

    def hook(rows):
        total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
        return rows.select("dataset", "sample_id", total.alias("total"), F.size(F.filter("tokens", lambda x: x >= 128)).alias("high"))

    return samples(t).transform(hook)
