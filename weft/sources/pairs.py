"""Image-text, video and multi-part records."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.ordering import ranged_running
from weft.functions.tokens import byte_encode

AUDIO_TAG = "<audio>"  # fixed value


def image_ints(content: Column) -> Column:
    """Bytes zero-padded to a multiple of four as little-endian integers, pad count first."""

    @F.arrow_udf("array<int>")
    def run(batch: pa.Array) -> pa.Array:
        pieces, ends = [], [0]
        for raw in batch:
            if raw.is_valid:
                body = raw.as_py()
                pad = -len(body) % 4
                pieces += [pad.to_bytes(4, "little"), body, b"\0" * pad]
            ends.append(ends[-1] + ((len(body) + pad) // 4 + 1 if raw.is_valid else 0))
        values = np.frombuffer(b"".join(pieces), "<i4").astype("i4")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=batch.is_null() if batch.null_count else None)

    return run(content)


def build_pairs(
    texts: DataFrame, images: DataFrame, pad_length: int, eod: int | None, key: str = "key"
) -> DataFrame:
    """(key, seq_no, mode, tokens): text (mode 0) and image (mode 1) of every key.

    Non-empty text is cut and padded with the end token, when there is one.  Records join on the
    key; a listing order is never relied on.
    """
    ids = byte_encode("text")
    if eod is not None:
        fill = F.array_repeat(F.lit(eod), F.greatest(F.lit(pad_length) - F.size("__t"), F.lit(0)))
        ids_out = F.when(F.size("__t") > 0, F.concat(F.slice("__t", 1, pad_length), fill)).otherwise(
            F.col("__t")
        )
    else:
        ids_out = F.col("__t")
    text = texts.select(key, ids.alias("__t")).select(key, ids_out.alias("text"))
    both = text.join(images.select(key, image_ints(F.col("content")).alias("image")), key)
    parts = F.array(
        F.struct(F.lit(0).alias("seq_no"), F.lit(0).alias("mode"), F.col("text").alias("tokens")),
        F.struct(F.lit(1).alias("seq_no"), F.lit(1).alias("mode"), F.col("image").alias("tokens")),
    )
    return both.select(key, F.explode(parts).alias("p")).select(key, "p.*")


def read_images(spark: SparkSession, glob: str) -> DataFrame:
    """(key, content) of binary files, the key being the file name without its ending."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("key"), "content")


def write_shards(df: DataFrame, path: str, max_per_shard: int = 10000) -> None:
    """(key, image, conversations JSON) in files of at most ``max_per_shard`` records."""
    out = df.select("key", "image", F.to_json("conversations").alias("conversations"))
    out.write.option("maxRecordsPerFile", max_per_shard).mode("overwrite").parquet(path)


ANNOTATION = (
    "video string, conversations array<struct<from:string,value:string>>, data_source string"
)


def read_annotations(spark: SparkSession, glob: str, array: bool) -> DataFrame:
    """Annotations from JSON arrays or JSON lines."""
    reader = spark.read.schema(ANNOTATION)
    return (reader.option("multiLine", "true") if array else reader).json(glob)


def build_video_pairs(
    annotations: DataFrame, files: DataFrame, order: Sequence[str]
) -> DataFrame:
    """(key, video, conversations, data_source, path): annotations whose file exists, numbered in
    order with nine digits; ``files`` is (path, ...) and only joined, never collected."""
    known = annotations.filter("video is not null and conversations is not null").join(
        files.select(F.col("path").alias("video")), "video", "left_semi"
    )
    numbered = ranged_running(known.select("video", *order), list(order), out="__n")
    rows = known.join(numbered.select(*order, "__n"), list(order))
    return rows.select(
        F.lpad(F.col("__n").cast("string"), 9, "0").alias("key"),
        "video",
        F.to_json("conversations").alias("conversations"),
        F.when(F.col("data_source") != "", F.col("data_source")).alias("data_source"),
    )


def assemble_parts(parts: DataFrame) -> DataFrame:
    """(key, context, answers, image, audio) from (key, ext, content binary): the JSON part names
    the audio files, of which the first is taken, as is the first turn pair."""
    record = parts.groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("ext", "content"))).alias("m")
    )
    kind = "struct<conversations:array<struct<value:string>>,audios:array<string>>"
    j = F.from_json(F.decode(F.col("m")["json"], "utf-8"), kind)
    rows = record.withColumn("j", j)
    context = F.col("j.conversations")[0]["value"]
    at = F.instr(context, AUDIO_TAG)
    tail = F.substring(context, at + len(AUDIO_TAG), F.length(context))
    single = F.when(
        at > 0,
        F.concat(
            F.substring(context, F.lit(1), at - 1),
            F.lit(AUDIO_TAG),
            F.replace(tail, F.lit(AUDIO_TAG), F.lit("")),
        ),
    ).otherwise(context)
    name = F.col("j.audios")[0]
    first_audio = F.substring(name, F.instr(name, ".") + 1, F.length(name))
    return rows.select(
        "key",
        single.alias("context"),
        F.col("j.conversations")[1]["value"].alias("answers"),
        F.try_element_at("m", F.lit("img")).alias("image"),
        F.try_element_at("m", first_audio).alias("audio"),
    )
