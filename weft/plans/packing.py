"""Queries: packing and batch assignment on byte lengths of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.ordering import ranged_running
from weft.functions.tokens import byte_encode
from weft.operators import batches as B
from weft.operators import hooks as K
from weft.operators import packing as P
from weft.plans.registry import digest, query

BIN, CAP, MAX_SEQS = 4096, 4096, 16
PIECES = 1_000_000


def lengths(t):
    return t.documents.select(
        F.col("doc_id").alias("seq_id"), F.octet_length("text").cast("bigint").alias("length")
    )


def cut(df, length):
    """A row for each piece ``p`` of a bin that a sequence is cut in; an empty one is a piece too."""
    last = F.greatest(F.ceil(length / CAP) - 1, F.lit(0)).cast("bigint")
    return df.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("p"))


def fitting(t):
    """Every sequence, longer ones in pieces of a bin numbered ``seq_id * PIECES + piece``."""
    left = F.col("length") - F.col("p") * CAP
    return cut(lengths(t), F.col("length")).select(
        (F.col("seq_id") * PIECES + F.col("p")).alias("seq_id"), F.least(left, F.lit(CAP)).alias("length")
    )


CUT = f"(SELECT doc_id, text, unnest(range(greatest((octet_length(encode(text))+{CAP}-1)//{CAP}, 1))) AS p FROM documents)"
FIT = f"len AS (SELECT doc_id*{PIECES}+p AS seq_id, least(octet_length(encode(text))-p*{CAP}, {CAP})::BIGINT AS length FROM {CUT})"
LEN = "len AS (SELECT doc_id AS seq_id, octet_length(encode(text))::BIGINT AS length FROM documents)"


@query(
    "d1_true_length",
    "SELECT doc_id, length(rtrim(text,'. '))::INT AS n FROM documents",
)
def true_length(t):
    # blanks and dots at the end stand for padding: dots are turned into the padding id first
    ids = F.transform(
        F.filter(F.split("text", ""), lambda c: c != ""),
        lambda c: F.when(c.isin(" ", "."), F.lit(32)).otherwise(F.lit(1)),
    )
    return t.documents.select("doc_id", P.true_length(ids, 32).alias("n"))


def walk(size, cap, first_bin, length="length"):
    """Next-fit walk as recursive SQL over sequences in falling length."""
    return f"""o AS (SELECT seq_id, {length} AS length, row_number() OVER (ORDER BY {length} DESC, seq_id) AS r FROM len),
    w AS (SELECT r, seq_id, length, {first_bin} AS bin_id, 0::BIGINT AS slot, 0::BIGINT AS start FROM o WHERE r=1
      UNION ALL SELECT o.r, o.seq_id, o.length,
        CASE WHEN w.start+w.length+o.length<={size} AND w.slot+1<{cap} THEN w.bin_id ELSE w.bin_id+1 END,
        CASE WHEN w.start+w.length+o.length<={size} AND w.slot+1<{cap} THEN w.slot+1 ELSE 0 END,
        CASE WHEN w.start+w.length+o.length<={size} AND w.slot+1<{cap} THEN w.start+w.length ELSE 0 END
      FROM w JOIN o ON o.r=w.r+1)"""


NFD = f"WITH RECURSIVE {LEN}, {walk(BIN, MAX_SEQS, '0::BIGINT')}"


@query("d2_pack_nfd", f"{NFD} SELECT bin_id, slot, seq_id, length, start FROM w")
def pack_nfd(t):
    return P.pack_nfd(lengths(t), BIN, MAX_SEQS)


@query(
    "d3_pack_best_fit",
    f"""WITH RECURSIVE {FIT}, s0 AS (SELECT list({{'l': length, 'id': seq_id}} ORDER BY length, seq_id) AS items FROM len),
    g AS (SELECT items, NULL::STRUCT(l BIGINT, id BIGINT) AS got, 0::BIGINT AS bin_id, 0::BIGINT AS slot, 0::BIGINT AS used, 0::BIGINT AS start FROM s0
      UNION ALL SELECT list_filter(items, lambda x: pick IS NULL OR x.id<>pick.id), pick, CASE WHEN pick IS NULL THEN bin_id+1 ELSE bin_id END,
        CASE WHEN pick IS NULL THEN 0 WHEN got IS NULL THEN 0 ELSE slot+1 END, CASE WHEN pick IS NULL THEN 0 ELSE used+pick.l END, used
      FROM (SELECT *, list_max(list_filter(items, lambda x: x.l<={CAP}-used)) AS pick FROM g WHERE len(items)>0))
    SELECT bin_id, slot, got.id AS seq_id, got.l AS length, start FROM g WHERE got IS NOT NULL""",
)
def pack_best_fit(t):
    return P.pack_best_fit(fitting(t), CAP)


BUFFER = 200


@query(
    "u5_packing_hooks",
    f"""WITH RECURSIVE {FIT}, bf AS (SELECT *, (row_number() OVER (ORDER BY seq_id)-1)//{BUFFER} AS buffer FROM len),
    s0 AS (SELECT buffer, list({{'l': length, 'id': seq_id}} ORDER BY length, seq_id) AS items FROM bf GROUP BY 1),
    g AS (SELECT buffer, items, NULL::STRUCT(l BIGINT, id BIGINT) AS got, 0::BIGINT AS pack, 0::BIGINT AS slot, 0::BIGINT AS used FROM s0
      UNION ALL SELECT buffer, list_filter(items, lambda x: pick IS NULL OR x.id<>pick.id), pick, CASE WHEN pick IS NULL THEN pack+1 ELSE pack END,
        CASE WHEN pick IS NULL THEN 0 WHEN got IS NULL THEN 0 ELSE slot+1 END, CASE WHEN pick IS NULL THEN 0 ELSE used+pick.l END
      FROM (SELECT *, list_max(list_filter(items, lambda x: x.l<={CAP}-used)) AS pick FROM g WHERE len(items)>0))
    SELECT buffer, pack, sum(got.l)::BIGINT AS length, string_agg(got.id::VARCHAR, ' ' ORDER BY slot) AS members FROM g WHERE got IS NOT NULL GROUP BY 1, 2""",
)
def packing_hooks(t):
    """Best fit as the caller's own select and pack, over buffers of samples in order."""

    def pack(group):
        ids = group.column("seq_id").to_pylist()
        return {"length": sum(group.column("length").to_pylist()), "members": " ".join(map(str, ids))}

    return K.pack_with(fitting(t), "seq_id", BUFFER, K.largest_that_fits(CAP), pack, "length bigint, members string")


@query(
    "d4_pack_padded",
    f"""WITH RECURSIVE {LEN}, {walk(BIN, 1 << 60, f"(CASE WHEN length>{BIN} THEN 1 ELSE 0 END)::BIGINT", "(length+63)//64*64")}
    SELECT bin_id, slot, seq_id, length, start FROM w""",
)
def pack_padded(t):
    return P.pack_padded(lengths(t), BIN)


def token_rows(t):
    """Sequences of at most one bin, generated from the second quarter on."""
    whole = t.documents.select("doc_id", byte_encode("text").alias("ids"))
    pieces = cut(whole, F.size("ids"))
    rows = pieces.select(
        (F.col("doc_id") * PIECES + F.col("p")).alias("seq_id"), F.expr(f"slice(ids, cast(p * {BIN} + 1 as int), {BIN})").alias("tokens")
    )
    return rows.withColumn(
        "generation_mask",
        F.transform("tokens", lambda v, i: i >= F.floor(F.size("tokens") / 4)),
    )


NFD_FIT = f"WITH RECURSIVE {FIT}, {walk(BIN, MAX_SEQS, '0::BIGINT')}"
BYTES = f"tk AS (SELECT doc_id*{PIECES}+p AS seq_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x'||h)::INT)[p*{BIN}+1 : (p+1)*{BIN}] AS tokens FROM {CUT})"


@query(
    "d5_assemble_bins",
    f"""{NFD_FIT}, {BYTES}, a AS (SELECT bin_id, string_agg(seq_id::VARCHAR,' ' ORDER BY slot) AS seq_ids, flatten(list(tokens ORDER BY slot)) AS tk,
      flatten(list(range(w.length) ORDER BY slot)) AS ps, sum(w.length - w.length//4)::BIGINT AS loss FROM w JOIN tk USING (seq_id) GROUP BY 1)
    SELECT bin_id, seq_ids, md5(array_to_string(tk || list_transform(range({BIN}-len(tk)), lambda x: 0::INT),' ')) AS tokens,
      md5(array_to_string(ps || list_transform(range({BIN}-len(tk)), lambda x: 0::BIGINT),' ')) AS positions, loss AS loss_tokens FROM a""",
)
def assemble_bins(t):
    placed = P.pack_nfd(fitting(t), BIN, MAX_SEQS)
    rows = P.assemble_bins(placed, token_rows(t), BIN, 0)
    return rows.select(
        "bin_id",
        F.array_join(F.col("seq_ids").cast("array<string>"), " ").alias("seq_ids"),
        digest("tokens").alias("tokens"),
        digest("position_ids").alias("positions"),
        F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("loss_tokens"),
    )


@query(
    "d6_assemble_mm_bins",
    f"""WITH RECURSIVE {FIT}, {walk(BIN, 1 << 60, '0::BIGINT', '(length+63)//64*64')},
    {BYTES}, p AS (SELECT w.bin_id, w.slot, w.seq_id, w.length, tokens || list_transform(range(w.length-len(tokens)), lambda x: 0::INT) AS tk,
      tokens || list_transform(range(w.length-len(tokens)), lambda x: -100::INT) AS lb, seq_id%3 AS im FROM w JOIN tk USING (seq_id)),
    c AS (SELECT *, sum(length) OVER (PARTITION BY bin_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS cu FROM p)
    SELECT bin_id, md5(array_to_string(flatten(list(tk ORDER BY slot)),' ')) AS tokens, md5(array_to_string(flatten(list(lb ORDER BY slot)),' ')) AS labels,
      '0 ' || string_agg(cu::VARCHAR,' ' ORDER BY slot) AS cu_lengths, max(length)::INT AS max_length, sum(im)::BIGINT AS n_images,
      string_agg('k'||seq_id,',' ORDER BY slot) AS keys FROM c GROUP BY 1""",
)
def assemble_mm(t):
    placed = P.pack_padded(fitting(t), BIN)
    rows = token_rows(t).select(
        "seq_id",
        F.concat(F.lit("k"), F.col("seq_id").cast("string")).alias("key"),
        "tokens",
        F.col("tokens").alias("labels"),
        F.expr("seq_id % 3").alias("n_images"),
    )
    out = P.assemble_mm_bins(placed, rows, BIN, multiple=64)
    return out.select(
        "bin_id",
        digest("tokens").alias("tokens"),
        digest("labels").alias("labels"),
        F.array_join(F.col("cu_lengths").cast("array<string>"), " ").alias("cu_lengths"),
        "max_length",
        "n_images",
        "keys",
    )


@query(
    "d7_pack_prefix",
    """WITH l AS (SELECT doc_id AS seq_id, octet_length(encode(text))::BIGINT AS length FROM documents WHERE doc_id%17<>0),
    r AS (SELECT row_number() OVER (ORDER BY seq_id)-1 AS slot, seq_id, length, sum(length) OVER (ORDER BY seq_id)::BIGINT - length AS start FROM l)
    SELECT slot, seq_id, length, start FROM r WHERE start+length <= 500000""",
)
def pack_prefix(t):
    failing = lengths(t).withColumn("length", F.expr("CASE WHEN seq_id % 17 = 0 THEN NULL ELSE length END"))
    return P.pack_prefix(failing, 500000)


WORLD = 7
DIST = f"""bb AS (SELECT max(bin_id)+1 AS n FROM w), sl AS (SELECT r AS rank, l AS local, n FROM bb, (SELECT unnest(range({WORLD})) AS r), (SELECT unnest(range((n+{WORLD}-1)//{WORLD})) AS l FROM bb)),
  ff AS (SELECT rank, local, CASE WHEN local < n//{WORLD} + (rank < n%{WORLD})::INT THEN rank*(n//{WORLD}) + least(rank, n%{WORLD}) + local END AS bin_id FROM sl)"""


@query("d8_distribute_fifo", f"{NFD}, {DIST} SELECT rank, local, bin_id FROM ff")
def distribute(t):
    return P.distribute_bins(P.pack_nfd(lengths(t), BIN, MAX_SEQS), WORLD)


@query(
    "d8_distribute_round_robin",
    f"{NFD}, {DIST} SELECT rank, local, CASE WHEN local*{WORLD}+rank<n THEN local*{WORLD}+rank END AS bin_id FROM sl",
)
def distribute_rr(t):
    return P.distribute_bins(P.pack_nfd(lengths(t), BIN, MAX_SEQS), WORLD, "round-robin")


@query(
    "d9_cu_seqlens",
    f"""{NFD}, a AS (SELECT bin_id, list((start)::INT ORDER BY slot) || [sum(length)::INT] AS cu FROM w GROUP BY 1)
    SELECT bin_id, array_to_string(cu || list_transform(range(greatest({MAX_SEQS}+2-len(cu),1)), lambda i: {BIN}),' ') AS cu FROM a""",
)
def cu_seqlens(t):
    bins = P.pack_nfd(lengths(t), BIN, MAX_SEQS).groupBy("bin_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", F.col("length").cast("int").alias("n")))).alias("m")
    )
    cu = P.cu_seqlens(F.transform("m", lambda m: m["n"]), BIN, MAX_SEQS)
    return bins.select("bin_id", F.array_join(cu.cast("array<string>"), " ").alias("cu"))


@query(
    "d10_packing_stats",
    f"""{NFD}, {DIST}, pb AS (SELECT bin_id, count(*) AS c, sum(length)::BIGINT AS tk FROM w GROUP BY 1),
    j AS (SELECT rank, local, c, tk FROM ff LEFT JOIN pb USING (bin_id)),
    r AS (SELECT rank, count(*) AS bins, count(c) AS filled, sum(COALESCE(c,0))::BIGINT AS seqs, min(c) AS min_per_bin, max(c) AS max_per_bin, round(avg(c),6) AS avg_per_bin,
      COALESCE(sum(tk),0)::BIGINT AS actual_tokens FROM j GROUP BY ROLLUP(rank))
    SELECT rank, bins, filled, seqs, min_per_bin, max_per_bin, avg_per_bin, actual_tokens, bins*{BIN} AS compute_tokens, round(actual_tokens/(bins*{BIN})::DOUBLE,6) AS efficiency,
      CASE WHEN rank IS NOT NULL THEN round(actual_tokens-(SELECT sum(length) FROM w)::DOUBLE/{WORLD},6) END AS deviation FROM r""",
)
def packing_stats(t):
    placed = P.pack_nfd(lengths(t), BIN, MAX_SEQS)
    return P.packing_stats(placed, P.distribute_bins(placed, WORLD), BIN)


@query(
    "d11_step_plan",
    f"""{NFD}, {DIST}, pb AS (SELECT bin_id, count(*) AS c FROM w GROUP BY 1), ps AS (SELECT ceil(0.25*(max(local)+1))::BIGINT AS p FROM ff)
    SELECT local//p AS step, count(*) AS bins, max(p)*{WORLD} AS global_batch, sum(COALESCE(c,0))::BIGINT AS seqs FROM ff LEFT JOIN pb USING (bin_id), ps GROUP BY 1""",
)
def step_plan(t):
    placed = P.pack_nfd(lengths(t), BIN, MAX_SEQS)
    return P.step_plan(placed, P.distribute_bins(placed, WORLD), 0.25, WORLD)


def ordinals(t):
    return t.events.select(F.col("event_id").alias("i"))


def total(t):
    return t.events.count()


N = "(SELECT count(*) FROM events)"


@query(
    "d12_assign_sequential",
    f"SELECT event_id AS i, (event_id-96)//24 AS batch, (event_id-96)%24//4 AS worker FROM events WHERE event_id>=96 AND (event_id-96)//24 < ({N}-96)//24",
)
def sequential(t):
    return B.assign_sequential(ordinals(t), total(t), 96, 4, 6)


@query(
    "d13_assign_global",
    f"SELECT event_id AS i, (event_id-96)//72 AS batch, (event_id-96)%72//24 AS micro, (event_id-96)%24//4 AS worker FROM events WHERE event_id>=96 AND (event_id-96)//72 < ({N}-96)//72",
)
def global_batches(t):
    return B.assign_global(ordinals(t), total(t), 96, 4, 6, 72)


@query("d14_assign_full_validation", "SELECT event_id AS i, event_id//6 AS batch, event_id%6 AS worker FROM events")
def full_validation(t):
    return B.assign_full_validation(ordinals(t), 6)


@query(
    "d15_assign_cyclic_sharded",
    f"""WITH b AS (SELECT event_id AS i, event_id//({N}//24*4) AS worker, row_number() OVER (PARTITION BY event_id//({N}//24*4) ORDER BY md5('0|'||event_id))-1-16 AS r FROM events WHERE event_id < ({N}//24*4)*6)
    SELECT i, worker, r//4 AS batch FROM b WHERE r>=0 AND r//4 < ({N}//24*4-16)//4""",
)
def cyclic_sharded(t):
    return B.assign_cyclic(ordinals(t), total(t), 96, 4, 6)


@query(
    "d15_assign_cyclic_global",
    f"""WITH f AS (SELECT {N}//4*4 AS n), b AS (SELECT event_id AS i, row_number() OVER (ORDER BY md5('0|'||event_id))-1-96 AS r FROM events, f WHERE event_id<n)
    SELECT i, r%6 AS worker, r//6//4 AS batch FROM b, f WHERE r>=0 AND r//6//4 < ((n-96-r%6+5)//6)//4""",
)
def cyclic_global(t):
    return B.assign_cyclic(ordinals(t), total(t), 96, 4, 6, sharding=False)


@query(
    "d16_assign_steps",
    """SELECT event_id AS i, CASE WHEN event_id<1008 THEN event_id//48 WHEN event_id<4080 THEN 21+(event_id-1008)//96 ELSE 53+(event_id-4080)//160 END AS step,
      (CASE WHEN event_id<1008 THEN 48 WHEN event_id<4080 THEN 96 ELSE 160 END)::BIGINT AS batch_size FROM events""",
)
def assign_steps(t):
    return B.assign_steps(ordinals(t), "0:48 1K:96 4K:160")


@query(
    "d17_partition",
    f"""WITH n AS (SELECT count(*) AS n FROM events)
    SELECT event_id AS i, event_id//((n+6)//7) AS by_ceil, (SELECT max(j) FROM range(8) q(j) WHERE (j*n)//7<=event_id AND j<7) AS by_linspace,
      CASE WHEN event_id//(n//7)<7 THEN event_id//(n//7) END AS by_floor FROM events, n""",
)
def partition(t):
    n = total(t)
    return ordinals(t).select(
        "i",
        B.partition_of(n, 7, "ceil").alias("by_ceil"),
        B.partition_of(n, 7, "linspace").alias("by_linspace"),
        B.partition_of(n, 7, "floor").alias("by_floor"),
    )


@query(
    "d18_unpack",
    f"""{NFD_FIT}, {BYTES}, x AS (SELECT bin_id%4 AS rank, bin_id//4 AS row, slot, seq_id, w.length FROM w WHERE w.length>0)
    SELECT row_number() OVER (ORDER BY rank, row, slot)-1 AS global_id, rank, row, md5(array_to_string(tokens,' ')) AS tokens FROM x JOIN tk USING (seq_id)""",
)
def unpack(t):
    placed = P.pack_nfd(fitting(t), BIN, MAX_SEQS)
    tokens = token_rows(t).drop("generation_mask")
    starts = (
        F.expr("bin_id % 4").alias("rank"),
        F.expr("bin_id div 4").alias("row"),
        P.cumulative(F.col("lengths")).alias("cu_seqlens"),
    )
    packed = P.assemble_bins(placed, tokens, BIN, 0).select(*starts, "tokens")
    out = B.unpack(packed, P.bin_lengths(placed, tokens).select(*starts))
    return out.select("global_id", "rank", "row", digest("tokens").alias("tokens"))


@query("d19_balance_groups")
def balance_groups(t):
    numbered = ranged_running(lengths(t).filter("length > 0"), ["seq_id"], out="i")
    return B.balance_groups(numbered.withColumn("batch", F.expr("i div 64")), 8, 4096)


@query(
    "d19_balance_served",
    """SELECT (row_number() OVER (ORDER BY doc_id)-1)//64 AS batch, doc_id AS seq_id, octet_length(encode(text))::BIGINT AS length,
      1::BIGINT AS steps, true AS whole, true AS wide_enough FROM documents WHERE octet_length(encode(text))>0""",
)
def balance_served(t):
    """Every sequence once: in one step, on ``width`` neighbouring workers, as many as its length asks for."""
    cells = balance_groups(t).groupBy("batch", "seq_id", "length", "width").agg(
        F.countDistinct("step").alias("steps"), F.count(F.lit(1)).alias("n"), F.min("worker").alias("lo"), F.max("worker").alias("hi")
    )
    whole = (F.col("n") == F.col("width")) & (F.col("hi") - F.col("lo") + 1 == F.col("width"))
    enough = F.col("width") >= F.least(F.ceil(F.col("length") / 4096), F.lit(8))
    return cells.select("batch", "seq_id", "length", "steps", whole.alias("whole"), enough.alias("wide_enough"))


@query(
    "d20_pad_batch",
    """WITH g AS (SELECT l_orderkey, l_orderkey//8 AS batch, list(l_partkey::INT ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY 1,2),
    m AS (SELECT batch, max(len(v)) AS w FROM g WHERE l_orderkey%5<>1 GROUP BY 1)
    SELECT l_orderkey, array_to_string(CASE WHEN l_orderkey%5=1 THEN list_transform(range(w), lambda x: 0) ELSE v || list_transform(range(w-len(v)), lambda x: -1) END,' ') AS v
    FROM g JOIN m USING (batch)""",
)
def pad_batch(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m")
    )
    rows = rows.select(
        "l_orderkey",
        F.expr("l_orderkey div 8").alias("batch"),
        F.when(F.expr("l_orderkey % 5 <> 1"), F.transform("m", lambda m: m["l_partkey"].cast("int"))).alias("v"),
    )
    out = B.pad_batch(rows, {"v": -1})
    return out.select("l_orderkey", F.array_join(F.col("v").cast("array<string>"), " ").alias("v"))
