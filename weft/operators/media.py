"""Token arithmetic of audio, images and video frames, and text pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.tokens import empty_ints

TILE_LADDER = [12, 8, 6, 4, 2, 1]  # fixed value: maximum tiles, step by step
QUESTION_RESERVE = 4
IGNORE = -100


def audio_tokens(
    samples: Column,
    rate: int = 16000,
    stride: float = 0.01,
    window: float | None = None,
    down: int = 2,
) -> Column:
    """Tokens of an audio length: frames by stride (or window and stride), scaled down, at least 1."""
    hop = int(stride * rate)
    if window is None:
        frames = F.ceil((samples + 1) / F.lit(hop))
    else:
        frames = F.floor((samples - int(window * rate)) / F.lit(hop)) + 1
    return F.greatest(F.lit(1), F.ceil(frames / F.lit(down))).cast("bigint")


def total_length(n_ids: Column, tiles: Column, per_tile: int) -> Column:
    """Sequence length once every image token has become its tiles."""
    all_tiles = F.aggregate(tiles, F.lit(0), lambda a, t: a + t)
    return n_ids + all_tiles * per_tile - F.size(tiles)


def fit_length(
    df: DataFrame, per_tile: int, max_len: int, image_id: int, pad: int
) -> DataFrame:
    """From (tokens, targets, tiles): length with images, truncation to ``max_len``, an ``error``
    when only ignored labels are left, and whether a trainable token lies inside the length."""
    tiles = F.aggregate("tiles", F.lit(0), lambda a, t: a + t)
    room = F.greatest(F.lit(max_len) - tiles * per_tile + F.size("tiles"), F.lit(0))
    rows = df.withColumn("total_len", total_length(F.size("tokens"), F.col("tiles"), per_tile))
    rows = rows.withColumn("tokens", F.slice("tokens", F.lit(1), room))
    rows = rows.withColumn("targets", F.slice("targets", F.lit(1), room))
    live = F.zip_with(
        "tokens", "targets", lambda t, g: (g != IGNORE) & (g != pad) & (t != image_id)
    )
    # the first trainable token that has a predecessor; its place counts the images before it
    first = F.array_position(F.transform(live, lambda ok, i: ok & (i > 0)), True)
    rows = rows.withColumn("__f", first)
    images = F.size(F.filter(F.slice("tokens", F.lit(1), F.col("__f").cast("int")), lambda t: t == image_id))
    before = F.aggregate(
        F.slice("tiles", F.lit(1), images), F.lit(0), lambda a, t: a + t * per_tile - 1
    )
    return (
        rows.withColumn(
            "error",
            F.when(
                ~F.exists("targets", lambda g: g != IGNORE), "all targets ignored after truncation"
            ),
        )
        .withColumn("trainable", (F.col("__f") > 0) & (F.col("__f") - 1 + before <= max_len))
        .drop("__f")
    )


def choose_tiles(
    df: DataFrame, per_tile: int, max_len: int, start: int = TILE_LADDER[0]
) -> DataFrame:
    """Adds ``max_tiles`` and ``n_tiles`` from (n_ids, tiles_at map of level to tiles): the first
    rung whose image tokens fit beside the text; the last rung is taken as it is."""
    ladder = F.array(*[F.lit(x) for x in TILE_LADDER if x <= start])
    budget = F.lit(max_len - QUESTION_RESERVE) - F.col("n_ids")
    fits = F.filter(
        ladder,
        lambda x: (F.element_at("tiles_at", x) * per_tile <= budget) | (x == TILE_LADDER[-1]),
    )
    return df.withColumn("max_tiles", F.element_at(fits, 1)).withColumn(
        "n_tiles", F.element_at("tiles_at", F.col("max_tiles"))
    )


def encode_pair(
    df: DataFrame, max_len: int, cls: int, sep: int, pad: int
) -> DataFrame:
    """Adds ``ids, types, paddings``: [CLS] A [SEP] B [SEP] cut to ``max_len``; ``b`` may be null.

    Padding carries the padding id in ids and types, and 0 in paddings.
    """
    a, b = F.col("a"), F.coalesce(F.col("b"), empty_ints())
    body = F.concat(F.array(F.lit(cls)), a, F.array(F.lit(sep)), b)
    kinds = F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(b)))
    rows = df.withColumn("__b", body).withColumn("__k", kinds)
    cut = F.size("__b") >= max_len
    closed = F.col("b").isNotNull() | cut
    kept = F.when(cut, F.lit(max_len - 1)).otherwise(F.size("__b"))
    rows = rows.withColumn("__n", kept + closed.cast("int")).withColumn("__kept", kept)
    last = F.when(closed, F.array(F.lit(sep))).otherwise(empty_ints())
    last_kind = F.when(
        closed, F.array(F.when(F.col("b").isNull(), 0).otherwise(1))
    ).otherwise(empty_ints())
    fill = F.lit(max_len) - F.col("__n")

    def row(c, end, value):
        return F.concat(
            F.slice(c, F.lit(1), F.col("__kept")), end, F.array_repeat(F.lit(value), fill)
        )

    return (
        rows.withColumn("ids", row("__b", last, pad))
        .withColumn("types", row("__k", last_kind, pad))
        .withColumn(
            "paddings",
            F.concat(F.array_repeat(F.lit(1), F.col("__n")), F.array_repeat(F.lit(0), fill)),
        )
        .drop("__b", "__k", "__n", "__kept")
    )


def even_frames(total: Column, n: int) -> Column:
    """``n`` evenly spaced frame numbers from the first to the last."""
    if n == 1:
        return F.array(F.lit(0).cast("bigint"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.floor((total - 1) * i / F.lit(n - 1)).cast("bigint"),
    )


def segment_frames(start: Column, end: Column, fps: Column, last: Column, n: int) -> Column:
    """Mid-points of ``n`` segments between two times; null times mean the whole video."""
    low = F.greatest(F.lit(0.0), F.bround(F.coalesce(start, F.lit(-100000.0)) * fps, 0))
    high = F.least(F.bround(F.coalesce(end, F.lit(100000.0)) * fps, 0), last.cast("double"))
    size = (high - low) / n
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: (low + size / 2 + F.bround(size * i, 0)).cast("bigint"),
    )


def frame_indices(df: DataFrame, n: int, by_time: bool = False) -> DataFrame:
    """One row per chosen frame (slot, frame) of (total) or of (start, end, fps, last)."""
    frames = (
        segment_frames(F.col("start"), F.col("end"), F.col("fps"), F.col("last"), n)
        if by_time
        else even_frames(F.col("total"), n)
    )
    return df.select(*df.columns, F.posexplode(frames).alias("slot", "frame"))
