"""Queries: sources and sinks, written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft.functions.tokens import byte_encode
from weft.operators import chat as H
from weft.operators import encode as E
from weft.operators import samples as S
from weft.operators import telemetry as G
from weft.plans.build import cached
from weft.plans.objectives import ALEN, ANSWERED, questions
from weft.plans.registry import digest, query
from weft.plans.rollouts import rollouts
from weft.session import shared_dir
from weft.sources import corpus as C
from weft.sources import indexed as I
from weft.sources import pairs as P
from weft.sources import results as R

HEXB = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x'||h)::INT)"


def fresh(t) -> str:
    return f"{shared_dir(t.spark)}/weft-{uuid.uuid4().hex}"


@query("a1_read_corpus", "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text FROM documents")
def read_corpus(t):
    path = fresh(t)
    t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang").write.option(
        "compression", "gzip"
    ).json(path)
    rows = C.read_corpus(t.spark, path + "/*.json.gz", ["doc_id", "text"])
    return rows.select("doc_id", F.md5("text").alias("text"))


@query(
    "a3_read_indexed",
    f"""WITH d AS (SELECT doc_id, {HEXB.format('text')} AS tk FROM documents WHERE octet_length(encode(text))>0)
    SELECT row_number() OVER (ORDER BY doc_id)-1 AS doc_id, 0::INT AS seq_no, row_number() OVER (ORDER BY doc_id)-1 AS seq_id, len(tk)::INT+1 AS n_tokens, md5(array_to_string(tk||[256],' ')) AS tokens FROM d""",
)
def read_indexed(t):
    path = fresh(t)
    I.write_indexed(E.byte_corpus(t.documents).withColumn("seq_no", F.lit(0)), path, 257)
    rows = I.read_indexed(t.spark, path, partition_bytes=1 << 20)
    return rows.select("doc_id", "seq_no", "seq_id", "n_tokens", digest("tokens").alias("tokens"))


@query(
    "a4_write_indexed",
    f"""WITH c AS (SELECT conv_id, turn, {HEXB.format("role||text")} AS tk FROM conversations)
    SELECT dense_rank() OVER (ORDER BY conv_id)-1 AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1)::INT AS seq_no, row_number() OVER (ORDER BY conv_id, turn)-1 AS seq_id,
      len(tk)::INT AS n_tokens, md5(array_to_string(tk,' ')) AS tokens FROM c""",
)
def write_indexed(t):
    """Turns as sequences of a conversation, in 32 bits."""
    path = fresh(t)
    rows = t.conversations.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("seq_no"), byte_encode(F.concat("role", "text")).alias("tokens")
    )
    I.write_indexed(rows, path, 70000)
    back = I.read_indexed(t.spark, path, partition_bytes=1 << 18)
    return back.select("doc_id", "seq_no", "seq_id", "n_tokens", digest("tokens").alias("tokens"))


@query(
    "a9_build_pairs",
    """WITH p AS (SELECT page_id AS key, regexp_extract_all(hex(encode(url)),'..') AS u, hex(encode(html)) AS hx, ((4-octet_length(encode(html))%4)%4)::BIGINT AS pad FROM pages),
    q AS (SELECT key, list_transform(u, lambda h: ('0x'||h)::BIGINT) AS u, pad, list_transform(regexp_extract_all(hx||repeat('00', pad), '........'),
      lambda h: ('0x'||substr(h,7,2)||substr(h,5,2)||substr(h,3,2)||substr(h,1,2))::BIGINT) AS im FROM p)
    SELECT key, 0::INT AS seq_no, 0::INT AS mode, md5(array_to_string(u[1:40]||list_transform(range(greatest(40-len(u),0)), lambda x: 256::BIGINT),' ')) AS tokens FROM q
    UNION ALL SELECT key, 1, 1, md5(array_to_string([pad]||list_transform(im, lambda v: CASE WHEN v>=2147483648 THEN v-4294967296 ELSE v END),' ')) FROM q""",
)
def build_pairs(t):
    texts = t.pages.select(F.col("page_id").alias("key"), F.col("url").alias("text"))
    images = t.pages.select(F.col("page_id").alias("key"), F.encode("html", "utf-8").alias("content"))
    rows = P.build_pairs(texts, images, 40, 256)
    return rows.select("key", "seq_no", "mode", digest("tokens").alias("tokens"))


@query("a10_read_chat", "SELECT conv_id//4 AS line, count(*)::INT AS n_turns, md5(string_agg(role||text,'|' ORDER BY conv_id, turn)) AS texts FROM conversations GROUP BY 1")
def read_chat(t):
    from weft.plans.objectives import merged_lines

    path = fresh(t)
    merged_lines(t).write.partitionBy("line").json(path)
    rows = C.read_chat(t.spark, path)
    texts = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], m["content"])), "|")
    return rows.select(
        F.regexp_extract(F.input_file_name(), r"line=(\d+)", 1).cast("bigint").alias("line"),
        F.size("messages").alias("n_turns"),
        F.md5(texts).alias("texts"),
    )


@query(
    "a11_write_shards",
    """SELECT page_id::VARCHAR AS key, md5(html) AS image, '[{"from":"human","value":"Describe."},{"from":"gpt","value":"page '||page_id||'"}]' AS conversations, true AS small FROM pages""",
)
def write_shards(t):
    path = fresh(t)
    talk = F.array(
        F.struct(F.lit("human").alias("from"), F.lit("Describe.").alias("value")),
        F.struct(F.lit("gpt").alias("from"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("value")),
    )
    P.write_shards(
        t.pages.select(F.col("page_id").cast("string").alias("key"), F.encode("html", "utf-8").alias("image"), talk.alias("conversations")),
        path,
        max_per_shard=20,
    )
    rows = t.spark.read.parquet(path).withColumn("file", F.input_file_name())
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, "file").select(
        "key", F.md5("image").alias("image"), "conversations", (F.col("n") <= 20).alias("small")
    )


@query(
    "a12_video_pairs",
    """WITH k AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id)-1 AS n FROM documents WHERE doc_id%5<>0 AND doc_id%7<>0 AND doc_id%300 IN (SELECT page_id FROM pages))
    SELECT lpad(n::VARCHAR,9,'0') AS key, 'v'||(doc_id%300)||'.mp4' AS video, CASE WHEN doc_id%2=0 THEN source END AS data_source FROM k""",
)
def video_pairs(t):
    notes = t.documents.select(
        "doc_id",
        F.expr("CASE WHEN doc_id%5<>0 THEN 'v'||(doc_id%300)||'.mp4' END").alias("video"),
        F.expr("CASE WHEN doc_id%7<>0 THEN array(named_struct('from','human','value',lang)) END").alias("conversations"),
        F.expr("CASE WHEN doc_id%2=0 THEN source ELSE '' END").alias("data_source"),
    )
    files = t.pages.select(F.expr("'v'||page_id||'.mp4'").alias("path"))
    return P.build_video_pairs(notes, files, ["doc_id"]).select("key", "video", "data_source")


@query(
    "a13_assemble_parts",
    """SELECT page_id::VARCHAR AS key, 'Hear <audio> and  '||page_id AS context, 'ok '||page_id AS answers, md5(url) AS image, md5('s'||page_id) AS audio FROM pages""",
)
def assemble_parts(t):
    meta = F.concat(
        F.lit('{"conversations":[{"value":"Hear <audio> and <audio> '), F.col("page_id").cast("string"),
        F.lit('"},{"value":"ok '), F.col("page_id").cast("string"),
        F.lit('"}],"audios":["'), F.col("page_id").cast("string"), F.lit('.a.wav","x.b.wav"]}'),
    )
    parts = t.pages.select(
        F.col("page_id").cast("string").alias("key"),
        F.explode(
            F.array(
                F.struct(F.lit("json").alias("ext"), F.encode(meta, "utf-8").alias("content")),
                F.struct(F.lit("img").alias("ext"), F.encode("url", "utf-8").alias("content")),
                F.struct(F.lit("a.wav").alias("ext"), F.encode(F.expr("'s'||page_id"), "utf-8").alias("content")),
                F.struct(F.lit("b.wav").alias("ext"), F.encode(F.lit("other"), "utf-8").alias("content")),
            )
        ).alias("p"),
    ).select("key", "p.*")
    rows = P.assemble_parts(parts)
    return rows.select("key", "context", "answers", F.md5("image").alias("image"), F.md5("audio").alias("audio"))


@query(
    "a14_missing_blocks",
    """WITH n AS (SELECT count(*) AS n FROM embeddings), b AS (SELECT unnest(range((n+15)//16)) AS block, n FROM n),
    v AS (SELECT vec_id//16 AS block, count(*)=16 AS whole FROM embeddings WHERE vec_id%16<>15 OR vec_id//16%4<>1 GROUP BY 1)
    SELECT block, block*16 AS start, least((block+1)*16, n) AS "end" FROM b WHERE block NOT IN (SELECT block FROM v WHERE whole AND block%3<>0)""",
)
def missing_blocks(t):
    """Stored blocks of vectors: every third is absent, every fourth lacks a row and is invalid."""
    n = t.embeddings.count()
    held = t.embeddings.filter("vec_id % 16 <> 15 OR vec_id div 16 % 4 <> 1").groupBy(
        F.expr("vec_id div 16").alias("block")
    ).agg(F.count(F.lit(1)).alias("rows"))
    return R.missing_blocks(t.spark, n, 16, held.filter("block % 3 <> 0"), F.col("rows") == 16)


@query(
    "a15_task_samples",
    f"""WITH {ANSWERED} SELECT source AS task, count(*) AS n, sum(len(f[1:{ALEN}]))::BIGINT AS n_tokens FROM g JOIN documents USING (doc_id) WHERE ok AND source IN ('src1','src3','src5') GROUP BY 1""",
)
def task_samples(t):
    path = fresh(t)
    rows = H.answer_loss(questions(t), ALEN)
    counts = rows.groupBy("task").agg(
        F.count("token_ids").alias("samples"),
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("token_ids").isNull()).alias("skipped"),
    )
    good = rows.filter("token_ids is not null").select("task", "token_ids", "label_positions", "label_ids")
    R.write_task_samples(good, counts, path, ALEN)
    back = R.read_task_samples(t.spark, path, ["src1", "src3", "src5"], ALEN)
    return back.groupBy(F.col("task").cast("string").alias("task")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("token_ids")).cast("bigint").alias("n_tokens")
    )


@query(
    "a16_read_results",
    """WITH s AS (SELECT user_id%4 AS run, event_type AS metric, event_id AS step, value FROM events WHERE event_id%9<>0)
    SELECT run, 'training' AS form, metric, step::VARCHAR AS step, value FROM s
    UNION ALL SELECT 10+l_orderkey%3, 'inference', 'latency', l_orderkey::VARCHAR, sum(l_quantity) FROM lineitem GROUP BY l_orderkey""",
)
def read_results(t):
    """One training file per run and metric pair, one inference file per few orders, the latter
    doubly encoded."""
    path = fresh(t)
    cell = F.concat(
        F.lit('"'), F.col("event_id").cast("string"), F.lit('":'),
        F.when(F.expr("event_id % 9 = 0"), F.lit('"nan"')).otherwise(F.col("value").cast("string")),
    )
    bodies = t.events.groupBy(
        F.expr("user_id % 4").alias("run"), "event_type", F.expr("event_id div 500").alias("part")
    ).agg(F.array_join(F.collect_list(cell), ",").alias("cells"))
    training = bodies.select(
        "run", F.concat(F.lit('{"'), "event_type", F.lit('":{"start_step":1,"values":{'), "cells", F.lit("}}}")).alias("content")
    )
    served = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).select(
        F.expr("10 + l_orderkey % 3").alias("run"),
        F.to_json(F.array(F.concat(F.lit('{"'), F.col("l_orderkey").cast("string"), F.lit('":{"generated_text":"x","latency":'), F.col("q").cast("string"), F.lit("}}")))).alias("c"),
    ).select("run", F.expr("substr(c, 2, length(c) - 2)").alias("content"))
    training.unionByName(served).write.parquet(path)
    return R.parse_results(t.spark.read.parquet(path))


@query(
    "a17_read_expert_load",
    """SELECT (l_suppkey%4)::INT AS rank, (l_partkey%3)::INT AS layer, (l_linenumber%5)::INT AS expert, sum(l_quantity::BIGINT)::BIGINT AS tokens FROM lineitem GROUP BY 1,2,3""",
)
def read_expert_load(t):
    path = fresh(t)
    experts = [F.sum(F.when(F.expr(f"l_linenumber % 5 = {e}"), F.col("l_quantity").cast("bigint"))) for e in range(5)]
    rows = t.lineitem.groupBy(
        F.expr("cast(l_suppkey % 4 as int)").alias("r"), F.expr("cast(l_partkey % 3 as int)").alias("layer"), F.expr("l_orderkey % 10").alias("iter")
    ).agg(F.array(F.array(*[F.coalesce(e, F.lit(0)) for e in experts])).alias("tpe"))
    rows.withColumn("block", F.lit("decoder")).withColumn("rank", F.concat(F.lit("rank"), "r")).drop("r").write.partitionBy("rank").json(path)
    renamed = path + "/rank=rank*"
    loaded = R.read_expert_load(t.spark, renamed)
    return loaded.groupBy("rank", "layer", "expert").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")


@query(
    "a18_write_rollouts",
    "SELECT event_id AS rollout_id, user_id AS group_id, (event_id%3+1)::INT AS n_turns FROM events",
)
def write_rollouts(t):
    from weft.operators.rollouts import ROLLOUT

    path = fresh(t)
    R.write_rollouts(rollouts(t), path)
    back = t.spark.read.schema(ROLLOUT).json(path)
    return back.select("rollout_id", "group_id", F.size("trajectory").alias("n_turns"))


@query(
    "a19_read_eval_set",
    """WITH k AS (SELECT doc_id, lang, '' AS gold, row_number() OVER (ORDER BY 'vid-'||doc_id)-1 AS i, count(*) OVER () AS n FROM documents WHERE doc_id%300 IN (SELECT page_id FROM pages)),
    m AS (SELECT 'txt-'||item_id AS sample_id, 'txt' AS task, md5(text) AS question, text AS gold FROM benchmark)
    SELECT 'vid-'||doc_id AS sample_id, 'vid' AS task, lang AS question, gold FROM k WHERE ((i+1)*3-1)//n=1 UNION ALL SELECT * FROM m""",
)
def read_eval_set(t):
    raw = t.documents.select(
        F.struct("doc_id", F.struct("lang").alias("inner")).alias("data"),
        F.expr("'v'||(doc_id%300)||'.mp4'").alias("file"),
        F.lit("x").alias("answer"),
    )
    files = t.pages.select(F.expr("'v'||page_id||'.mp4'").alias("path"))
    videos = R.read_eval_set(
        raw,
        {"sample_id": "data.doc_id", "question": "data.inner.lang", "path": "file", "gold": "answer"},
        task="vid", files=files, partition=(3, 1), test_split=True,
    )
    texts = R.read_eval_set(
        t.benchmark.select("item_id", F.md5("text").alias("q"), F.col("text").alias("a")),
        {"sample_id": "item_id", "question": "q", "gold": "a"}, task="txt",
    )
    return R.stack_tasks({"vid": videos.drop("path"), "txt": texts}).select("sample_id", "task", "question", "gold")


def mean_encoder():
    """A stand-in for the user's model: every token is (id, id squared, 1)."""
    return lambda rows: [[(x, x * x / 100.0, 1.0) for x in row] for row in rows]


@query(
    "b26_embed",
    """WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x'||h)::INT)[1:62] AS tk FROM documents),
    u AS (SELECT doc_id, CASE WHEN len(tk)=0 THEN [0] ELSE tk END AS tk FROM t)
    SELECT doc_id, round(list_avg(tk)::FLOAT::DOUBLE,3) AS e0, round(list_avg(list_transform(tk, lambda x: x*x/100.0::DOUBLE))::FLOAT::DOUBLE,2) AS e1 FROM u""",
)
def embed(t):
    rows = E.encode(t.documents).select("doc_id", "tokens")
    out = R.embed(rows, mean_encoder, 64, E.EOD, 0, 3)
    return out.select(
        "doc_id", F.round(F.col("embedding")[0].cast("double"), 3).alias("e0"), F.round(F.col("embedding")[1].cast("double"), 2).alias("e1")
    )


@query(
    "c18_cached_samples",
    """SELECT source AS dataset, count(*) AS n_docs, sum(octet_length(encode(text))+1)::BIGINT AS epoch_tokens FROM documents WHERE octet_length(encode(text))>0 GROUP BY 1""",
)
def cached_plan(t):
    """Built on the first call, read on the second."""
    folder, what = fresh(t), {"class": "plan", "folder": t.folder, "length": 256, "split": "99,1,0"}

    def make():
        return S.epoch_plan(E.byte_lengths(t.documents), 256).select("dataset", "n_docs", "epoch_tokens")

    cached(t.spark, folder, what, make)
    return cached(t.spark, folder, what, lambda: make().limit(0))


@query(
    "g14_expert_load_files",
    """WITH e AS (SELECT l_partkey%3 AS layer, l_linenumber%5 AS expert, sum(l_quantity::BIGINT)::BIGINT AS tokens FROM lineitem GROUP BY 1,2)
    SELECT layer::INT AS layer, expert::INT AS expert, tokens, round(tokens/sum(tokens) OVER (PARTITION BY layer)::DOUBLE,9) AS share FROM e""",
)
def expert_load_files(t):
    out = G.expert_load(read_expert_load(t))
    return out.select("layer", "expert", "tokens", F.round("share", 9).alias("share"))
