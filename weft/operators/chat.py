"""Chat records: harmonise, split, tokens with targets, packing, answer-only loss."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.ordering import ranged_running
from weft.functions.text import strip
from weft.functions.tokens import byte_encode, byte_values, empty_ints
from weft.operators.nextfit import next_fit
from weft.operators.packing import cumulative
from weft.session import pin

IGNORE = -100
MESSAGES = "array<struct<role:string,content:string>>"
IMAGE_TOKEN = "<image>"  # fixed value

# Other names of the two speakers.
ROLES = {
    "human": "user",
    "Human": "user",
    "user": "user",
    "User": "user",
    "gpt": "assistant",
    "GPT": "assistant",
    "assistant": "assistant",
    "Assistant": "assistant",
    "system": "system",
    "System": "system",
}


@dataclass(frozen=True)
class ChatTemplate:
    """How a turn is written.  ``masked`` False keeps every token as a target."""

    head: str = "<|im_start|>"
    mid: str = "\n"
    tail: str = "<|im_end|>\n"
    bos: int | None = None
    has_system: bool = True
    masked: bool = True
    system_default: str | None = None
    image_open: str = ""
    image_close: str = ""


def conversations(df: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, messages) from one row per turn (key, turn, role, text); a conversation is a row."""
    turns = F.sort_array(F.collect_list(F.struct(order, "role", F.col("text").alias("content"))))
    return df.groupBy(key).agg(turns.alias("__m")).select(
        key,
        F.transform(
            "__m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
        ).alias("messages"),
    )


def harmonize_chat(df: DataFrame, kind: str, key: str) -> DataFrame:
    """(key, messages) from question/response pairs (``pair``), role/value lists (``aliases``),
    prompt lists (``prompts``), or ``messages`` / ``conversations`` columns (``plain``).

    Chats of fewer than two turns or opened by the assistant are dropped, prompts excepted.
    """
    if kind == "pair":
        messages = F.array(
            F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")),
        )
    elif kind == "aliases":
        names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
        messages = F.transform(
            "conversations",
            lambda m: F.struct(
                F.coalesce(F.try_element_at(names, m["from"]), m["from"]).alias("role"),
                m["value"].alias("content"),
            ),
        )
    elif kind == "prompts":
        return df.select(
            key,
            F.transform(
                "prompts", lambda p: F.struct(F.lit("user").alias("role"), p.alias("content"))
            ).alias("messages"),
        )
    else:
        held = [F.col(c) for c in ("conversations", "messages") if c in df.columns]
        messages = F.coalesce(*held)
    out = df.select(key, messages.alias("messages"))
    return out.filter(
        (F.size("messages") >= 2) & (F.element_at("messages", 1)["role"] != "assistant")
    )


def split_conversations(messages: str | Column) -> Column:
    """Array of conversations: every system message opens a new one."""
    m = F.col(messages) if isinstance(messages, str) else messages
    starts = F.filter(
        F.transform(m, lambda x, i: F.when((i == 0) | (x["role"] == "system"), i + 1)),
        lambda i: i.isNotNull(),
    )
    ends = F.concat(F.slice(starts, 2, 1 << 30), F.array(F.size(m) + 1))
    return F.zip_with(starts, ends, lambda a, b: F.slice(m, a, b - a))


def _pieces(messages: Column, template: ChatTemplate) -> Column:
    """Per turn: role, tokens and how many of its first tokens are no target."""
    bos = F.array(F.lit(template.bos)) if template.bos is not None else empty_ints()
    extra = 1 if template.bos is not None else 0

    def one(m, i):
        tokens = byte_values(
            F.concat(
                F.lit(template.head), m["role"], F.lit(template.mid), m["content"], F.lit(template.tail)
            )
        )
        tokens = F.when(i == 0, F.concat(bos, tokens)).otherwise(tokens)
        lead = F.when(i == 0, extra).otherwise(0)
        prefix = F.octet_length(F.concat(F.lit(template.head), m["role"], F.lit(template.mid)))
        role = F.lower(m["role"])
        hidden = (
            F.when(F.lit(not template.masked), 0)
            .when(role == "assistant", prefix + lead)
            .otherwise(F.size(tokens))
        )
        return F.struct(role.alias("role"), tokens.alias("tokens"), hidden.alias("hidden"))

    return F.transform(messages, one)


def _tokens_and_targets(pieces: Column) -> tuple[Column, Column]:
    tokens = F.flatten(F.transform(pieces, lambda p: p["tokens"]))
    targets = F.flatten(
        F.transform(
            pieces,
            lambda p: F.transform(
                p["tokens"], lambda t, j: F.when(j < p["hidden"], IGNORE).otherwise(t)
            ),
        )
    )
    return tokens, targets


def _without_system(messages: Column, template: ChatTemplate) -> Column:
    if template.has_system:
        return messages
    leads = F.element_at(messages, 1)["role"] == "system"
    return F.when(leads, F.slice(messages, 2, 1 << 30)).otherwise(messages)


def chat_error(messages: Column) -> Column:
    """Why a conversation cannot be used, else null."""
    role = F.transform(messages, lambda m: F.lower(m["role"]))
    follows = F.exists(
        F.transform(
            role,
            lambda r, i: (r == "assistant")
            & ~F.coalesce(F.get(role, i - 1).isin("user", "tool"), F.lit(False)),
        ),
        lambda bad: bad,
    )
    return (
        F.when(
            F.exists(messages, lambda m: (F.lower(m["role"]) == "assistant") & (m["content"] == "")),
            "empty assistant turn",
        )
        .when(follows, "assistant must follow user or tool")
        .when(F.exists(role, lambda r: ~r.isin("system", "user", "tool", "assistant")), "wrong role")
    )


def chat_targets(
    df: DataFrame, template: ChatTemplate, messages: str = "messages", strict: bool = True
) -> DataFrame:
    """Adds ``tokens`` and ``targets``: system, user, tool and the assistant prefix are ignored.

    A bad conversation is an error; without ``strict`` its reason is in ``error`` instead.
    """
    m = _without_system(F.col(messages), template)
    error = chat_error(m) if template.masked else F.lit(None).cast("string")
    rows = df.withColumn("__m", m).withColumn("error", error)
    if strict:
        fail = F.raise_error(F.concat(F.lit("conversation: "), F.col("error"))).cast(MESSAGES)
        rows = rows.withColumn("__m", F.when(F.col("error").isNull(), F.col("__m")).otherwise(fail))
        rows = rows.drop("error")
    rows = rows.withColumn("__p", _pieces(F.col("__m"), template))
    tokens, targets = _tokens_and_targets(F.col("__p"))
    return rows.withColumn("tokens", tokens).withColumn("targets", targets).drop("__m", "__p")


def mm_chat_targets(
    df: DataFrame, template: ChatTemplate, messages: str = "messages"
) -> DataFrame:
    """As :func:`chat_targets` for image chats: forced system line, image tags around the image
    token; empty turns and image tokens said by the assistant give an ``error`` and no tokens."""
    m = _without_system(F.col(messages), template)
    if template.system_default is not None:
        line = F.struct(F.lit("system").alias("role"), F.lit(template.system_default).alias("content"))
        leads = F.element_at(m, 1)["role"] == "system"
        rest = F.when(leads, F.slice(m, 2, 1 << 30)).otherwise(m)
        m = F.concat(F.array(line), rest)
    tagged = template.image_open + IMAGE_TOKEN + template.image_close
    m = F.transform(
        m,
        lambda x: F.struct(
            x["role"].alias("role"),
            F.replace(x["content"], F.lit(IMAGE_TOKEN), F.lit(tagged)).alias("content"),
        ),
    )
    error = F.when(F.exists("__m", lambda x: x["content"] == ""), "empty turn").when(
        F.exists(
            "__m",
            lambda x: (F.lower(x["role"]) == "assistant")
            & F.contains(x["content"], F.lit(IMAGE_TOKEN)),
        ),
        "image token in assistant turn",
    )
    rows = df.withColumn("__m", m).withColumn("error", error)
    rows = rows.withColumn(
        "__p", F.when(F.col("error").isNull(), _pieces(F.col("__m"), template))
    )
    tokens, targets = _tokens_and_targets(F.col("__p"))
    return rows.withColumn("tokens", tokens).withColumn("targets", targets).drop("__m", "__p")


def pack_chat(df: DataFrame, length: int, pad: int, cp: int = 1) -> DataFrame:
    """Fixed-length rows from ``parts``, an array of (tokens, targets) per conversation.

    Each conversation may be padded to 2 * cp; conversations join until length + 1 tokens,
    overflow is cut and its last token replaced by padding, a shortfall is padded in the last
    conversation.  Adds input, labels, loss_mask, position_ids, cu_seqlens, max_seqlen.
    """
    grain = 2 * cp if cp > 1 else 1
    sizes = F.transform("parts", lambda p: (F.ceil(F.size(p["tokens"]) / grain) * grain).cast("int"))
    rows = df.withColumn("__all", cumulative(sizes))
    over = F.array_position(F.transform("__all", lambda c: c >= length + 1), True)
    kept = F.when(over > 0, over - 1).otherwise(F.size("parts")).cast("int")
    rows = rows.withColumn("__k", kept).withColumn("__n", F.element_at("__all", F.col("__k") + 1))

    def fill(c, value, n):
        return F.concat(c, F.array_repeat(F.lit(value), F.greatest(n - F.size(c), F.lit(0))))

    def joined(name):
        return F.flatten(
            F.zip_with(
                F.slice("parts", F.lit(1), F.col("__k")),
                F.slice(sizes, F.lit(1), F.col("__k")),
                lambda p, n: fill(p[name], pad, n),
            )
        )

    cut = F.col("__n") >= length + 1

    def closed(c):
        short = F.concat(F.slice(c, 1, length), F.array(F.lit(pad)))
        return F.when(cut, short).otherwise(fill(c, pad, F.lit(length + 1)))

    positions = F.flatten(
        F.transform(
            F.filter(
                F.transform(
                    F.slice("__all", F.lit(1), F.col("__k")),
                    lambda a, i: F.when(
                        i == F.col("__k") - 1, F.greatest(F.lit(length + 1), F.col("__n")) - a
                    ).otherwise(F.element_at("__all", i + 2) - a),
                ),
                lambda n: n > 0,
            ),
            lambda n: F.sequence(F.lit(0), n - 1),
        )
    )
    rows = rows.withColumn("__t", closed(joined("tokens"))).withColumn("__g", closed(joined("targets")))
    rows = rows.withColumn("labels", F.slice("__g", 2, length))
    cu = F.concat(F.slice("__all", F.lit(1), F.col("__k")), F.array(F.lit(length)))
    rows = rows.withColumn("cu_seqlens", cu)
    spans = F.zip_with(
        F.slice("cu_seqlens", 2, 1 << 30),
        F.slice("cu_seqlens", F.lit(1), F.size("cu_seqlens") - 1),
        lambda b, a: b - a,
    )
    return (
        rows.withColumn("input", F.slice("__t", 1, length))
        .withColumn(
            "loss_mask",
            F.transform("labels", lambda v: F.when((v == pad) | (v == IGNORE), 0).otherwise(1)),
        )
        .withColumn("position_ids", F.slice(positions, 1, length))
        .withColumn("max_seqlen", F.array_max(spans))
        .drop("__all", "__k", "__n", "__t", "__g")
    )


def resolve_answer(target: Column, choices: Column | None = None) -> Column:
    """Gold text: the first of a list; an index, or a string of digits, through the choices."""
    if choices is None:
        return target
    at = strip(target)
    by_index = F.when(at.rlike("^[0-9]+$"), F.get(choices, at.try_cast("int")))
    return F.coalesce(by_index, target)


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements agree."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def answer_loss(df: DataFrame, length: int) -> DataFrame:
    """Adds ``token_ids, label_positions, label_ids`` (null when rejected) from (prompt, answer).

    The boundary is the common token prefix of prompt and prompt + answer; overflow is cut on the
    left; no answer, no prompt token left or no label rejects the row.
    """
    rows = df.withColumn("__p", byte_encode("prompt")).withColumn(
        "__f", byte_encode(F.concat("prompt", "answer"))
    )
    rows = rows.withColumn("__o", F.greatest(F.size("__f") - (length + 1), F.lit(0)))
    rows = rows.withColumn("__b", common_prefix(F.col("__p"), F.col("__f")) - F.col("__o"))
    rows = rows.withColumn("__f", F.slice("__f", F.col("__o") + 1, F.lit(length + 1)))
    low, high = F.col("__b") - 1, F.least(F.size("__f") - 1, F.lit(length))
    good = (F.col("answer") != "") & (F.col("__b") >= 1) & (high > low)
    spots = F.sequence(low, high - 1)
    return (
        rows.withColumn("token_ids", F.when(good, F.slice("__f", 1, length)))
        .withColumn("label_positions", F.when(good, spots))
        .withColumn("label_ids", F.when(good, F.slice("__f", F.col("__b") + 1, high - low)))
        .drop("__p", "__f", "__o", "__b")
    )


def cap_tasks(df: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts) of (task, doc_no, ok): at most ``most`` good rows per task in order;
    counts say how many documents were seen and skipped until then."""
    flagged = df.select("task", "doc_no", F.col("ok").cast("bigint").alias("ok"))
    walked = ranged_running(flagged, ["doc_no"], ["ok"], within=["task"])
    seen = walked.filter(F.col("cum_ok") < most) if most > 0 else walked
    counts = seen.groupBy("task").agg(
        F.sum("ok").cast("bigint").alias("samples"),
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("ok") == 0).alias("skipped"),
    )
    kept = seen.filter("ok = 1").select("task", "doc_no", F.col("cum_ok").cast("bigint").alias("k"))
    return kept, counts


def tile_tasks(kept: DataFrame, least: int) -> DataFrame:
    """(task, doc_no, k): tasks below ``least`` samples repeat theirs in order up to it."""
    sizes = kept.groupBy("task").agg(F.count(F.lit(1)).alias("__n"))
    rows = kept.join(sizes, "task")
    times = F.when(F.col("__n") < least, F.ceil(F.lit(least) / F.col("__n"))).otherwise(F.lit(1))
    rows = rows.withColumn("__t", F.explode(F.sequence(F.lit(0), times.cast("int") - 1)))
    rows = rows.withColumn("k", F.col("k") + F.col("__t") * F.col("__n"))
    return rows.filter((F.col("k") < least) | (F.col("__t") == 0)).select("task", "doc_no", "k")


def dense_rows(df: DataFrame, length: int) -> DataFrame:
    """Zero-filled tokens, labels and loss mask from an answer-loss sample."""
    ids, first, n = F.col("token_ids"), F.element_at("label_positions", 1), F.size("label_ids")

    def zeros(k):
        return F.array_repeat(F.lit(0), k)

    return (
        df.withColumn("tokens", F.concat(ids, zeros(F.lit(length) - F.size(ids))))
        .withColumn("labels", F.concat(zeros(first), F.col("label_ids"), zeros(F.lit(length) - first - n)))
        .withColumn(
            "loss_mask",
            F.concat(zeros(first), F.array_repeat(F.lit(1), n), zeros(F.lit(length) - first - n)),
        )
    )


#: Rows that a shard may have; None, as it is, for any number.
MAX_SHARD_ROWS: int | None = None


def pack_concat(
    df: DataFrame, length: int, shards: int, eos: int, key: str = "conv_id"
) -> DataFrame:
    """(shard, pack, rows, input_ids, loss_mask, token_counts) from (key, tokens).

    Chats plus an end token (no loss on it) are cut to ``length`` and joined until more than
    ``length`` tokens; the last incomplete pack of a shard is dropped.  Shards are runs of rows
    in key order, of any size: (key, length) is packed by :func:`weft.operators.nextfit.next_fit`.
    """
    narrow = df.select(
        key, F.least(F.size("tokens") + 1, F.lit(length)).cast("bigint").alias("n")
    )
    numbered = pin(ranged_running(narrow, [key], out="i"))
    share, extra = divmod(numbered.count(), shards)
    if MAX_SHARD_ROWS is not None and share + (extra > 0) > MAX_SHARD_ROWS:
        raise ValueError(f"more than {MAX_SHARD_ROWS} rows in a shard: ask for more shards")
    edge = (share + 1) * extra
    early = F.col("i") < edge
    shard = F.when(early, F.expr(f"i div {share + 1}")).otherwise(extra + F.expr(f"(i - {edge}) div {max(share, 1)}"))
    begins = F.when(F.col("shard") < extra, F.col("shard") * (share + 1)).otherwise(edge + (F.col("shard") - extra) * share)
    rows = numbered.select(F.col(key).alias("key"), shard.cast("int").alias("shard"), "i", "n")
    rows = rows.withColumn("at", F.col("i") - begins)
    packed = next_fit(rows.select("shard", F.col("at").alias("i"), "n"), length).withColumnRenamed("i", "at")
    placed = rows.join(packed, ["shard", "at"]).select("shard", "pack", "i", "key")
    full = df.select(
        F.col(key).alias("key"),
        F.slice(F.concat("tokens", F.array(F.lit(eos))), 1, length).alias("ids"),
        F.slice(
            F.concat(F.transform("tokens", lambda t: F.lit(1)), F.array(F.lit(0))), 1, length
        ).alias("loss"),
    )
    grouped = placed.join(full, "key").groupBy("shard", "pack").agg(
        F.sort_array(F.collect_list(F.struct("i", "ids", "loss"))).alias("m")
    )
    return grouped.select(
        "shard",
        "pack",
        F.size("m").alias("rows"),
        F.flatten(F.transform("m", lambda x: x["ids"])).alias("input_ids"),
        F.flatten(F.transform("m", lambda x: x["loss"])).alias("loss_mask"),
        F.transform("m", lambda x: F.size(x["ids"])).alias("token_counts"),
    )


def serve_packs(packs: DataFrame, n: int) -> DataFrame:
    """(idx, shard, pack): requests 0..n-1 over shards in turn, the packs of a shard cyclically."""
    sizes = packs.groupBy("shard").agg(F.count(F.lit(1)).alias("__n"))
    shards = sizes.count()
    asked = packs.sparkSession.range(n).select(
        F.col("id").alias("idx"), F.expr(f"cast(id % {shards} as int)").alias("shard")
    )
    return asked.join(sizes, "shard").select(
        "idx", "shard", F.expr(f"(idx div {shards}) % __n").alias("pack")
    )
