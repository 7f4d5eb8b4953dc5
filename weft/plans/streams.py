"""Queries: streams over the given tables, run until everything at hand is processed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft.functions.ordering import ranged_running
from weft.plans.registry import digest, query
from weft.plans.rollouts import NOW, RO, rollouts
from weft.session import shared_dir
from weft.streaming import rollout_stream as R
from weft.streaming import tables as T


def staged(t, df, parts=3, by=None):
    """The rows as a stream of ``parts`` micro-batches; rows dealt by ``by`` are one file each, others as many files as the
    table has splits, so that no task writes or reads a third of it."""
    folder = f"{shared_dir(t.spark)}/weft-{uuid.uuid4().hex}"
    files = parts if by is not None else max(parts, df.rdd.getNumPartitions())
    (df.repartition(files, by) if by is not None else df.repartition(files)).write.parquet(f"{folder}/in")
    at_once = -(-files // parts)
    stream = t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", at_once).parquet(f"{folder}/in")
    return stream, folder


def numbered_groups(t):
    ids = ranged_running(
        t.events.select(F.col("event_type").alias("source"), "event_id"), ["event_id"], within=["source"], out="n"
    )
    return ids.selectExpr("source", "n div 8 AS batch_id", "n % 8 AS index_in_batch", "event_id")


@query(
    "h1_release_in_order",
    """WITH g AS (SELECT event_type AS source, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id)-1 AS n, count(*) OVER (PARTITION BY event_type) AS m FROM events)
    SELECT source, n//8 AS batch_id, n%8 AS index_in_batch, event_id FROM g WHERE n//8 < m//8""",
)
def release(t):
    stream, folder = staged(t, numbered_groups(t), by=F.expr("event_id % 11"))
    R.release_in_order(stream, 8, folder, once=True).awaitTermination()
    return t.spark.read.parquet(f"{folder}/released/*")


@query(
    "h2_filter_uniform_groups",
    """WITH g AS (SELECT event_id//4 AS group_id, list(CASE WHEN event_id//4%3=0 THEN 1::DOUBLE ELSE floor(value/20) END ORDER BY event_id) AS r FROM events GROUP BY 1)
    SELECT group_id, array_to_string(list_transform(r, lambda x: x::INT),' ') AS rewards FROM g WHERE len(list_distinct(r))>1""",
)
def filter_stream(t):
    groups = t.events.groupBy(F.expr("event_id div 4").alias("group_id")).agg(
        F.sort_array(F.collect_list(F.struct("event_id", F.expr("CASE WHEN event_id div 4 % 3 = 0 THEN 1D ELSE floor(value/20) * 1D END").alias("r")))).alias("m")
    )
    rows = groups.select("group_id", F.transform("m", lambda m: m["r"]).alias("rewards"))
    stream, folder = staged(t, rows)
    kept = R.filter_uniform_groups(stream)
    out = kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
    out.trigger(availableNow=True).start().awaitTermination()
    done = t.spark.read.parquet(f"{folder}/out")
    ints = F.transform("rewards", lambda x: x.cast("int").cast("string"))
    return done.select("group_id", F.array_join(ints, " ").alias("rewards"))


@query(
    "h3_interval_log",
    """SELECT event_id//100 AS interval, round(avg(value) FILTER (event_type<>'error'),6) AS loss, count(*) FILTER (event_type<>'error') AS advanced, count(*) FILTER (event_type='error') AS skipped, 0::BIGINT AS nan FROM events GROUP BY 1""",
)
def interval_stream(t):
    rows = t.events.selectExpr("event_id + 1 AS iteration", "value AS loss", "event_type = 'error' AS skipped")
    stream, folder = staged(t, rows)
    T.interval_log_stream(stream, 100, folder, once=True).awaitTermination()
    return T.latest_intervals(t.spark, folder).withColumn("loss", F.round("loss", 6))


@query(
    "h4_encode_stream",
    """SELECT doc_id, (CASE WHEN octet_length(encode(text))=0 THEN 0 ELSE octet_length(encode(text))+1 END)::INT AS n_tokens,
      md5(array_to_string(CASE WHEN octet_length(encode(text))=0 THEN [] ELSE list_transform(regexp_extract_all(hex(encode(text)),'..'), lambda h: ('0x'||h)::INT)||[256] END,' ')) AS tokens FROM documents""",
)
def encode_stream(t):
    stream, folder = staged(t, t.documents.select("doc_id", "text"))
    T.encode_stream(stream, folder, once=True).awaitTermination()
    return t.spark.read.parquet(f"{folder}/tokens").select("doc_id", "n_tokens", digest("tokens").alias("tokens"))


@query("h4_running_rate", "SELECT count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*) AS total_docs FROM documents")
def running_rate(t):
    stream, folder = staged(t, t.documents.select("doc_id", "text"))
    T.encode_stream(stream, folder, once=True).awaitTermination()
    rate = T.running_rate(t.spark, folder)
    return rate.agg(
        F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"), F.max("total_docs").alias("total_docs")
    )


@query(
    "h5_staleness",
    f"WITH {RO} SELECT rollout_id, ({NOW}-rollout_id%5)::INT AS staleness, ({NOW}-(rollout_id%5+(nt-1)%2))::INT AS last_staleness FROM ro",
)
def staleness(t):
    stream, folder = staged(t, rollouts(t).select("rollout_id", "policy_epoch"))
    out = R.staleness(stream, NOW).select("rollout_id", "staleness", "last_staleness").writeStream.format("parquet")
    out = out.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
    out.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")
