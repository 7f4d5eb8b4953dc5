"""Queries: sentence runs, masked objectives and chat samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.ordering import by_rows
from weft.functions.text import split_sentences
from weft.functions.tokens import byte_encode, byte_encode_parts
from weft.operators import chat as H
from weft.operators import masked as M
from weft.operators import runs as R
from weft.plans.corpus import FLAT, SENTS, samples
from weft.plans.registry import digest, query

MAXLEN, RATIO, SEED = 128, 4, 1234


def sentence_lengths(t):
    """Byte lengths of the sentences of every document, without the empty ones."""
    parts = split_sentences("text")
    return t.documents.select(
        "doc_id",
        F.filter(F.transform(parts, lambda s: F.octet_length(s)), lambda n: n > 0).alias("sentence_lengths"),
        F.length("source").alias("title_length"),
    )


def target_sql(run: str) -> str:
    h = f"('0x'||substr(md5(concat_ws('|','{SEED}',0,doc_id,{run})),1,8))::BIGINT"
    return f"(CASE WHEN {h}%{RATIO}=0 THEN 2+{h}%({MAXLEN}-1) ELSE {MAXLEN} END)::INT"


def runs_sql(min_sent: int, tested: int, left_over: int, target, extra: str) -> str:
    """Recursive walk over the sentences of all documents side by side."""
    close = f"((tk+sz>=tg AND n-pt-1>={left_over} AND pt+1-fr>={min_sent}) OR pt+1=n)"
    return f"""l AS (SELECT doc_id, length(source)::INT AS title_length, list_filter(list_transform({SENTS}, lambda s: octet_length(encode(s))::INT), lambda n: n>0) AS ls FROM documents),
    u AS (SELECT doc_id, ls, len(ls)::INT AS n, title_length FROM l WHERE len(ls)>={min_sent} AND len(ls)>0 AND NOT (len(ls)>={tested} AND list_max(ls)>512)),
    w AS (SELECT doc_id, ls, n, title_length, 0 AS pt, 0 AS fr, 0 AS tk, 0 AS run, {target('0')} AS tg, NULL::INT AS f, NULL::INT AS e, NULL::INT AS t, NULL::INT AS r FROM u
      UNION ALL SELECT doc_id, ls, n, title_length, pt+1, CASE WHEN {close} THEN pt+1 ELSE fr END, CASE WHEN {close} THEN 0 ELSE tk+sz END, CASE WHEN {close} THEN run+1 ELSE run END,
        CASE WHEN {close} THEN {target('run+1')} ELSE tg END, CASE WHEN {close} THEN fr END, CASE WHEN {close} THEN pt+1 END, CASE WHEN {close} THEN tg END, CASE WHEN {close} THEN run END
      FROM (SELECT *, ls[pt+1] AS sz FROM w WHERE pt<n)){extra}"""


@query(
    "c19_sentence_runs",
    f"""WITH RECURSIVE {runs_sql(2, 2, 2, target_sql, '')}
    SELECT 0::INT AS epoch, doc_id, r AS run, f AS first, e AS last, t AS target, row_number() OVER (ORDER BY md5(concat_ws('|','{SEED + 1}',0,doc_id,r)))-1 AS k FROM w WHERE e IS NOT NULL""",
)
def sentence_runs(t):
    return R.sentence_runs(sentence_lengths(t), MAXLEN, RATIO, 2, seed=SEED)


@query(
    "c20_title_blocks",
    f"""WITH RECURSIVE {runs_sql(1, 1, 1, lambda run: f'({MAXLEN}-title_length)::INT', '')},
    b AS (SELECT doc_id, f AS first, e AS last, row_number() OVER (ORDER BY doc_id, r)-1 AS block_id FROM w WHERE e IS NOT NULL), c AS (SELECT *, unnest([0,1])::INT AS epoch FROM b)
    SELECT epoch, doc_id, first, last, block_id, row_number() OVER (ORDER BY md5(concat_ws('|','{SEED + 1}',epoch,block_id)), epoch, block_id)-1 AS k FROM c""",
)
def title_blocks(t):
    return R.title_blocks(sentence_lengths(t), MAXLEN, 1, epochs=2, seed=SEED)


def run_rows(t):
    """Sentence runs with the tokens of their sentences."""
    runs = R.sentence_runs(sentence_lengths(t), MAXLEN, RATIO, 2, seed=SEED)
    texts = by_rows(R.run_sentences(runs, t.documents.select("doc_id", split_sentences("text").alias("s")), "s"))
    return texts.select("idx", byte_encode_parts("sentences").alias("sentences"), "target")


# a byte vocabulary with special ids above it; UTF-8 continuation bytes continue a word
MASKS = M.MaskConfig(
    length=MAXLEN + 3, vocab=256, cls=256, sep=257, mask=258, pad=-1,
    continuations=frozenset(range(128, 192)), seed=SEED,
)


def num(digits: str, k: int) -> str:
    return f"('0x'||substr({digits},{8 * k + 1},8))::BIGINT"


def sql_md5(*keys) -> str:
    return f"md5(concat_ws('|','{SEED}',{','.join(map(str, keys))}))"


def byte_list(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})),'..'), lambda h: ('0x'||h)::INT)"


# samples with the texts of their sentences
SMP = f"""WITH RECURSIVE {runs_sql(2, 2, 2, target_sql, '')},
    sn AS (SELECT doc_id, {SENTS} AS ss FROM documents),
    smp AS (SELECT row_number() OVER (ORDER BY md5(concat_ws('|','{SEED + 1}',0,w.doc_id,w.r)))-1 AS idx, w.t AS target, ss[w.f+1:w.e] AS parts
      FROM w JOIN sn USING (doc_id) WHERE w.e IS NOT NULL)"""
COIN = f"substr({sql_md5(repr('trim'), 'idx', 'k//32')},(k%32)::INT+1,1)<'8'"
FROM_A = "(CASE WHEN k<abs(na-nb) THEN na>nb ELSE (k-abs(na-nb))%2=1 END)"
# two parts trimmed to the target, then one row of tokens
PAIRS = f"""p0 AS (SELECT *, len(parts) AS np, {sql_md5(repr('pair'), 'idx')} AS d FROM smp),
    p1 AS (SELECT *, (CASE WHEN np>=3 THEN 1+{num('d', 0)}%(np-1) ELSE 1 END)::INT AS piv, {num('d', 1)}%2=0 AS heads FROM p0),
    p2 AS (SELECT *, array_to_string(parts[1:piv],'') AS x, array_to_string(parts[piv+1:np],'') AS y FROM p1),
    p3 AS (SELECT idx, target, heads::INT AS swapped, {byte_list('CASE WHEN heads THEN y ELSE x END')} AS a, {byte_list('CASE WHEN heads THEN x ELSE y END')} AS b FROM p2),"""
JOINED = f"""SELECT idx, target, parts, len(parts) AS np FROM smp),
    p3 AS (SELECT idx, target, 0 AS swapped, {byte_list("array_to_string(parts,'')")} AS a, []::INT[] AS b FROM p0),"""
TRIMMED = f"""p4 AS (SELECT *, len(a) AS na, len(b) AS nb, greatest(len(a)+len(b)-target,0) AS x FROM p3),
    p5 AS (SELECT *, len(list_filter(range(x), lambda k: {FROM_A})) AS cut_a, len(list_filter(range(x), lambda k: {FROM_A} AND {COIN})) AS front_a,
      len(list_filter(range(x), lambda k: NOT {FROM_A} AND {COIN})) AS front_b FROM p4),
    p6 AS (SELECT idx, target, swapped, (x>0)::INT AS truncated, a[front_a+1:front_a+na-cut_a] AS a, b[front_b+1:front_b+nb-(x-cut_a)] AS b FROM p5),
    tk AS (SELECT *, [256] || a || [257] || CASE WHEN len(b)>0 THEN b || [257] ELSE [] END AS toks FROM p6),"""


def fold_sql(out: str, source: str, tag: str, taken: str, ends) -> str:
    """``out``: the ranges of places that a fold over the words in drawn order takes, within the budget."""
    stop = "(CASE WHEN x.dn>=3 AND x.a3-x.st<=budget-s.used THEN x.a3 WHEN x.dn>=2 AND x.a2-x.st<=budget-s.used THEN x.a2 WHEN x.a1-x.st<=budget-s.used THEN x.a1 END)"
    clash = lambda of: f"len(list_filter({of}, lambda q: q.f<{stop} AND x.st<q.t))"
    drawn = "(1" + "".join(f"+({num('c', 1)}>={e})::INT" for e in ends) + ")"
    at = lambda k: f"bounds[least(substr(c,33)::INT+{k},len(bounds)-1)+1]"
    nothing = "[]::STRUCT(f BIGINT, t BIGINT)[]"
    struct = lambda *v: "{{'st':{},'a1':{},'a2':{},'a3':{},'dn':{},'used':{},'r':{}}}".format(*v)
    item = struct("bounds[substr(c,33)::INT+1]", at(1), at(2), at(3), drawn, "0::BIGINT", nothing)
    grown = struct("0::BIGINT", "0::BIGINT", "0::BIGINT", "0::BIGINT", "0::INT", f"s.used+{stop}-x.st", f"list_append(s.r, {{'f':x.st,'t':{stop}}})")
    first = struct("0::BIGINT", "0::BIGINT", "0::BIGINT", "0::BIGINT", "0::INT", "0::BIGINT", nothing)
    return f"""{out}_c AS (SELECT *, list_sort(list_transform(range(len(bounds)-1), lambda w: {sql_md5(repr(tag), 'idx', 'w')}||w::VARCHAR)) AS cand FROM {source}),
    {out}_i AS (SELECT * EXCLUDE (cand), list_transform(cand, lambda c: {item}) AS items FROM {out}_c),
    {out} AS (SELECT * EXCLUDE (items), list_sort(list_reduce(items, lambda s, x: CASE WHEN budget-s.used<=0 THEN s WHEN {stop} IS NULL THEN s
      WHEN {clash('s.r')}=0 AND {clash(taken)}=0 THEN {grown} ELSE s END, {first}).r) AS {out}_r FROM {out}_i),"""


def places_sql(ends) -> str:
    """Places, word bounds and budget of ``tk``, then the chosen ranges ``ch_r``."""
    return f"""pl AS (SELECT *, list_filter(range(len(toks)), lambda i: toks[i+1] NOT IN (256,257)) AS plain,
      least(target*0.15::DOUBLE, greatest(1, round_even(len(toks)*0.15::DOUBLE,0))) AS budget FROM tk),
    bd AS (SELECT *, list_filter(range(len(plain)), lambda j: j=0 OR NOT (toks[plain[j+1]+1] BETWEEN 128 AND 191)) || [len(plain)] AS bounds FROM pl),
    {fold_sql('ch', 'bd', 'mask', '[]::STRUCT(f BIGINT, t BIGINT)[]', ends)}"""


COVERED = "flatten(list_transform({}, lambda q: plain[q.f+1:q.t]))"
FATE = sql_md5(repr("fate"), "idx", "p")
MASKED_TEXT = f"""list_transform(range(len(toks)), lambda p: CASE WHEN NOT list_contains(spots,p) THEN toks[p+1] WHEN {num(FATE, 0)}<{round(0.8 * 2**32)} THEN 258
      WHEN {num(FATE, 0)}<{round(0.9 * 2**32)} THEN {num(FATE, 1)}%256 ELSE toks[p+1] END)"""
WIDTH = MAXLEN + 3
LABELS = f"list_transform(range({WIDTH}), lambda p: CASE WHEN list_contains({{}},p) THEN toks[p+1] ELSE 0 END)"
INVERSE, GEOMETRIC = MASKS.size_ends(False), MASKS.size_ends(True)


def sql_digest(array: str) -> str:
    return f"md5(array_to_string({array},' '))"


@query(
    "c21_pair_samples",
    f"""{SMP}, {PAIRS} {TRIMMED} {places_sql(INVERSE)} sp AS (SELECT *, {COVERED.format('ch_r')} AS spots FROM ch)
    SELECT idx, {sql_digest(f"({MASKED_TEXT}) || list_transform(range({WIDTH}-len(toks)), lambda i: 0)")} AS text,
      {sql_digest(f"list_transform(range({WIDTH}), lambda i: CASE WHEN i<len(a)+2 THEN 0 WHEN i<len(toks) THEN 1 ELSE -1 END)")} AS types,
      {sql_digest(LABELS.format('spots'))} AS labels, swapped AS is_random, truncated, len(spots)::INT AS masked FROM sp""",
)
def pair_samples(t):
    out = M.bert_samples(run_rows(t), MASKS)
    return out.select(
        "idx", digest("text").alias("text"), digest("types").alias("types"),
        digest("labels").alias("labels"), "is_random", "truncated",
        F.size(F.filter("loss_mask", lambda x: x == 1)).alias("masked"),
    )


SWAP = sql_md5(repr("swap"), "idx", "p")


@query(
    "c22_mask_ngrams",
    f"""{SMP}, p0 AS ({JOINED} {TRIMMED} {places_sql(GEOMETRIC)} {fold_sql('mv', 'ch', 'move', 'ch_r', INVERSE)}
    sp AS (SELECT *, {COVERED.format('ch_r')} AS spots, {COVERED.format('mv_r')} AS moved FROM mv),
    sw AS (SELECT *, list_transform(list_sort(list_transform(moved, lambda p: {SWAP}||p::VARCHAR)), lambda s: substr(s,33)::BIGINT) AS taken FROM sp),
    ma AS (SELECT *, {MASKED_TEXT} AS masked_text FROM sw)
    SELECT idx, {sql_digest(LABELS.format('spots || moved'))} AS labels, len(spots || moved)::INT AS masked,
      {sql_digest(f"list_transform(range({WIDTH}), lambda p: CASE WHEN p>=len(toks) THEN 0 WHEN list_contains(moved,p) THEN toks[taken[list_position(moved,p)]+1] ELSE masked_text[p+1] END)")} AS text FROM ma""",
)
def mask_ngrams(t):
    longer = M.MaskConfig(**{**MASKS.__dict__, "geometric": True, "permute": True, "classify": False})
    out = M.bert_samples(run_rows(t), longer)
    return out.select(
        "idx", digest("labels").alias("labels"), F.size(F.filter("loss_mask", lambda x: x == 1)).alias("masked"),
        digest("text").alias("text"),
    )


@query(
    "c23_replace_tokens",
    f"""{SMP}, p0 AS ({JOINED} {TRIMMED} {places_sql(INVERSE)} sp AS (SELECT *, {COVERED.format('ch_r')} AS spots FROM ch),
    fa AS (SELECT idx, toks, unnest(spots) AS p FROM sp),
    fd AS (SELECT toks[p+1] AS was, CASE WHEN {num(FATE, 0)}<{round(0.8 * 2**32)} THEN 258 WHEN {num(FATE, 0)}<{round(0.9 * 2**32)} THEN {num(FATE, 1)}%256 ELSE toks[p+1] END AS now FROM fa)
    SELECT CASE WHEN now=258 THEN 'mask' WHEN now=was THEN 'kept' ELSE 'random' END AS fate, count(*) AS n FROM fd GROUP BY 1""",
)
def replace_tokens(t):
    """What became of the masked positions: masked, kept or replaced, over all samples."""
    out = M.bert_samples(run_rows(t), M.MaskConfig(**{**MASKS.__dict__, "classify": False}))
    cells = out.select(F.explode(F.arrays_zip("text", "labels", "loss_mask")).alias("c")).filter("c.loss_mask = 1")
    fate = (
        F.when(F.col("c.text") == MASKS.mask, "mask")
        .when(F.col("c.text") == F.col("c.labels"), "kept")
        .otherwise("random")
    )
    return cells.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


PAD_TO = f"list_transform(range({WIDTH}-len({{0}})), lambda i: 0)"


@query(
    "c24_span_corrupt",
    f"""{SMP}, fl AS (SELECT idx, target, {byte_list("array_to_string(parts,'')")} AS every FROM smp),
    tk AS (SELECT *, every[1:target] AS toks FROM fl), {places_sql(INVERSE)}
    cu AS (SELECT *, flatten(list_transform(range(len(ch_r)+1), lambda i: toks[(CASE WHEN i=0 THEN 0 ELSE ch_r[i].t END)+1:(CASE WHEN i<len(ch_r) THEN ch_r[i+1].f ELSE len(toks) END)]
        || CASE WHEN i<len(ch_r) THEN [(300+i)::INT] ELSE [] END)) AS enc,
      flatten(list_transform(range(len(ch_r)), lambda i: [(300+i)::INT] || toks[ch_r[i+1].f+1:ch_r[i+1].t])) AS told FROM ch),
    rw AS (SELECT *, [298] || told AS dec, told || [299] AS lab FROM cu)
    SELECT idx, {sql_digest('enc || ' + PAD_TO.format('enc'))} AS text_enc, {sql_digest('dec || ' + PAD_TO.format('dec'))} AS text_dec,
      {sql_digest('lab || ' + PAD_TO.format('lab'))} AS labels, (len(every)>target)::INT AS truncated FROM rw""",
)
def span_corrupt(t):
    rows = run_rows(t).select("idx", F.flatten("sentences").alias("tokens"), "target")
    out = M.span_corrupt(rows, MASKS, list(range(300, 400)), 298, 299, MAXLEN + 3)
    return out.select(
        "idx", digest("text_enc").alias("text_enc"), digest("text_dec").alias("text_dec"),
        digest("labels").alias("labels"), "truncated",
    )


# a character of the texts at byte i of a segment, if it lies in it whole
LEAD = "(CASE WHEN body[i+1]<128 THEN 1 WHEN body[i+1] BETWEEN 194 AND 223 THEN 2 WHEN body[i+1] BETWEEN 224 AND 239 THEN 3 WHEN body[i+1]>=240 THEN 4 ELSE 0 END)"
ENDING = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


@query(
    "c25_fill_in_middle",
    f"""{FLAT}, rows AS (SELECT ('0x'||substr(md5(dataset),1,6))::BIGINT*1000000+sample_id AS idx, tk, list_filter(range(len(tk)), lambda i: tk[i+1]=256) AS ends FROM g),
    ks AS (SELECT *, unnest(range(len(ends)+1)) AS k FROM rows),
    sg AS (SELECT idx, k, k=len(ends) AS last, len(tk) AS n, tk[(CASE WHEN k=0 THEN 0 ELSE ends[k]+1 END)+1:(CASE WHEN k<len(ends) THEN ends[k+1] ELSE len(tk) END)] AS body,
      {sql_md5(repr('infill'), 'idx', 'k')} AS d FROM ks),
    tx AS (SELECT *, regexp_replace(decode(unhex(array_to_string(list_transform(flatten(list_transform(list_filter(range(len(body)), lambda i: {LEAD}>0 AND i+{LEAD}<=len(body)),
      lambda i: body[i+1:i+{LEAD}])), lambda b: lpad(to_hex(b),2,'0')),''))),'{ENDING}','') AS text FROM sg WHERE last OR len(body)>0),
    cu AS (SELECT *, least({num('d', 1)}%(length(text)+1), {num('d', 2)}%(length(text)+1)) AS low, greatest({num('d', 1)}%(length(text)+1), {num('d', 2)}%(length(text)+1)) AS high FROM tx),
    pt AS (SELECT *, {byte_list('left(text,low)')} AS pre, {byte_list('substr(text,low+1,high-low)')} AS mid, {byte_list('substr(text,high+1)')} AS suf FROM cu),
    ch AS (SELECT idx, k, n, (CASE WHEN {num('d', 0)}>={round(0.5 * 2**32)} THEN body WHEN {num('d', 3)}<{round(0.5 * 2**32)} THEN [260,262] || suf || [261] || pre || mid
      ELSE [260] || pre || [262] || suf || [261] || mid END) || CASE WHEN last THEN [] ELSE [256] END AS part FROM pt),
    jo AS (SELECT idx, any_value(n) AS n, flatten(list(part ORDER BY k)) AS parts FROM ch GROUP BY 1)
    SELECT idx, {sql_digest("(parts || list_transform(range(greatest(n-len(parts),0)), lambda i: 263))[1:n]")} AS tokens, n::INT AS n FROM jo""",
)
def fill_in_middle(t):
    rows = samples(t).select(
        F.expr("conv(substr(md5(dataset), 1, 6), 16, 10) * 1000000 + sample_id").cast("bigint").alias("idx"), "tokens"
    )
    cfg = M.InfillConfig(rate=0.5, spm_rate=0.5, prefix=260, middle=261, suffix=262, pad=263, eod=256, seed=SEED)
    out = M.fim_bytes(rows, cfg)
    return out.select("idx", digest("tokens").alias("tokens"), F.size("tokens").alias("n"))


# ---- chats ---------------------------------------------------------------------------------

TEMPLATE = H.ChatTemplate()


def merged_lines(t):
    """Four conversations to a line, as in merged chat files."""
    turns = t.conversations.select(
        F.expr("conv_id div 4").alias("line"),
        F.struct("conv_id", "turn").alias("at"),
        "role",
        "text",
    )
    return H.conversations(turns, "line", "at")


LINES = "ln AS (SELECT conv_id//4 AS line, role, text, row_number() OVER (PARTITION BY conv_id//4 ORDER BY conv_id, turn)-1 AS i FROM conversations)"
SPLIT = f"{LINES}, sp AS (SELECT *, (CASE WHEN i=0 THEN 0 ELSE sum((role='system' AND i>0)::INT) OVER (PARTITION BY line ORDER BY i) END)::BIGINT AS part FROM ln)"


@query(
    "c26_split_conversations",
    f"WITH {SPLIT} SELECT line, part::INT AS part, count(*)::INT AS n_turns, md5(string_agg(text, '|' ORDER BY i)) AS texts FROM sp GROUP BY 1,2",
)
def split_conversations(t):
    parts = merged_lines(t).select("line", F.posexplode(H.split_conversations("messages")).alias("part", "m"))
    texts = F.md5(F.array_join(F.transform("m", lambda x: x["content"]), "|"))
    return parts.select("line", "part", F.size("m").alias("n_turns"), texts.alias("texts"))


TURN = "'<|im_start|>'||role||chr(10)||text||'<|im_end|>'||chr(10)"
TURN_TOKENS = f"list_transform(regexp_extract_all(hex(encode({TURN})), '..'), lambda h: ('0x'||h)::INT)"
TURN_TARGETS = f"list_transform({TURN_TOKENS}, lambda v, j: CASE WHEN role<>'assistant' OR j<=13+length(role) THEN -100 ELSE v END)"


def chats(t):
    return H.chat_targets(H.conversations(t.conversations), TEMPLATE)


@query(
    "c27_chat_targets",
    f"""WITH x AS (SELECT conv_id, turn, {TURN_TOKENS} AS tk, {TURN_TARGETS} AS tg FROM conversations)
    SELECT conv_id, md5(array_to_string(flatten(list(tk ORDER BY turn)),' ')) AS tokens, md5(array_to_string(flatten(list(tg ORDER BY turn)),' ')) AS targets, sum(len(tk))::INT AS n FROM x GROUP BY 1""",
)
def chat_targets(t):
    return chats(t).select(
        "conv_id", digest("tokens").alias("tokens"), digest("targets").alias("targets"), F.size("tokens").alias("n")
    )


@query(
    "c28_mm_chat_targets",
    f"""WITH z AS (SELECT conv_id, 0 AS g, -1 AS turn, 'system' AS role, 'Look.' AS text0 FROM conversations GROUP BY 1
      UNION ALL SELECT conv_id, 1, turn, role, CASE WHEN turn=1 AND role='user' THEN '<image>'||text WHEN conv_id%11=3 AND turn=1 AND role='assistant' THEN '<image>' WHEN conv_id%13=5 AND turn=1 THEN '' ELSE text END FROM conversations WHERE NOT (role='system' AND turn=0)),
    b AS (SELECT conv_id, max(CASE WHEN text0='' THEN 2 WHEN role='assistant' AND contains(text0,'<image>') THEN 1 ELSE 0 END) AS bad FROM z GROUP BY 1),
    x AS (SELECT conv_id, turn, replace(text0,'<image>','<img><image></img>') AS text, role FROM z),
    y AS (SELECT conv_id, turn, {TURN_TOKENS} AS tk, {TURN_TARGETS} AS tg FROM x)
    SELECT conv_id, CASE any_value(bad) WHEN 2 THEN 'empty turn' WHEN 1 THEN 'image token in assistant turn' END AS error,
      CASE WHEN any_value(bad)=0 THEN md5(array_to_string(flatten(list(tk ORDER BY turn)),' ')) END AS tokens,
      CASE WHEN any_value(bad)=0 THEN md5(array_to_string(flatten(list(tg ORDER BY turn)),' ')) END AS targets FROM y JOIN b USING (conv_id) GROUP BY 1""",
)
def mm_chat_targets(t):
    edited = t.conversations.withColumn(
        "text",
        F.expr(
            "CASE WHEN turn=1 AND role='user' THEN '<image>'||text WHEN conv_id%11=3 AND turn=1 AND role='assistant' THEN '<image>' "
            "WHEN conv_id%13=5 AND turn=1 THEN '' ELSE text END"
        ),
    )
    template = H.ChatTemplate(system_default="Look.", image_open="<img>", image_close="</img>")
    out = H.mm_chat_targets(H.conversations(edited), template)
    return out.select("conv_id", "error", digest("tokens").alias("tokens"), digest("targets").alias("targets"))


PACK = 1024


def packed(t, cp=1):
    parts = merged_lines(t).select("line", F.posexplode(H.split_conversations("messages")).alias("part", "messages"))
    coded = H.chat_targets(parts, TEMPLATE, strict=False).filter("error is null")
    rows = coded.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("part", "tokens", "targets"))).alias("parts"))
    return H.pack_chat(rows, PACK, 0, cp)


@query(
    "c29_pack_chat",
    f"""WITH {SPLIT}, x AS (SELECT line, part, i, {TURN_TOKENS} AS tk, {TURN_TARGETS} AS tg FROM sp),
    p AS (SELECT line, part, flatten(list(tk ORDER BY i)) AS tk, flatten(list(tg ORDER BY i)) AS tg FROM x GROUP BY 1,2),
    c AS (SELECT *, sum(len(tk)) OVER (PARTITION BY line ORDER BY part) AS cu FROM p), k AS (SELECT * FROM c WHERE cu-len(tk) < {PACK}+1),
    g AS (SELECT line, flatten(list(tk ORDER BY part)) AS tk, flatten(list(tg ORDER BY part)) AS tg, list(cu-len(tk) ORDER BY part) AS st FROM k GROUP BY 1),
    f AS (SELECT line, st, CASE WHEN len(tk)>={PACK}+1 THEN tk[1:{PACK}]||[0] ELSE tk||list_transform(range({PACK}+1-len(tk)), lambda x: 0) END AS tk,
      CASE WHEN len(tg)>={PACK}+1 THEN tg[1:{PACK}]||[0] ELSE tg||list_transform(range({PACK}+1-len(tg)), lambda x: 0) END AS tg FROM g)
    SELECT line, md5(array_to_string(tk[1:{PACK}],' ')) AS input, md5(array_to_string(tg[2:{PACK}+1],' ')) AS labels, len(list_filter(tg[2:{PACK}+1], lambda v: v NOT IN (0,-100)))::BIGINT AS loss_tokens,
      array_to_string(st||[{PACK}],' ') AS cu_seqlens, list_max(list_transform(st, lambda s, j: COALESCE(st[j+1],{PACK})-s))::INT AS max_seqlen,
      md5(array_to_string(flatten(list_transform(st, lambda s, j: range(0, (COALESCE(st[j+1],{PACK})-s)::BIGINT))),' ')) AS positions FROM f""",
)
def pack_chat(t):
    return packed(t).select(
        "line", digest("input").alias("input"), digest("labels").alias("labels"),
        F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("loss_tokens"),
        F.array_join(F.col("cu_seqlens").cast("array<string>"), " ").alias("cu_seqlens"),
        "max_seqlen", digest("position_ids").alias("positions"),
    )


QA = "SELECT doc_id, 'Q: '||text AS prompt, CASE WHEN doc_id%7=0 THEN '' ELSE reverse(text) END AS answer FROM documents"
ALEN = 4096


def questions(t):
    return t.documents.selectExpr(
        "doc_id", "source AS task", "'Q: '||text AS prompt",
        "CASE WHEN doc_id%7=0 THEN '' ELSE reverse(text) END AS answer",
    )


ANSWERED = f"""qa AS ({QA}), tk AS (SELECT doc_id, answer, octet_length(encode(prompt)) AS pn, list_transform(regexp_extract_all(hex(encode(prompt||answer)),'..'), lambda h: ('0x'||h)::INT) AS f FROM qa),
  o AS (SELECT *, greatest(len(f)-{ALEN + 1},0) AS o FROM tk), b AS (SELECT doc_id, answer, pn-o AS b, f[o+1:o+{ALEN + 1}] AS f FROM o),
  g AS (SELECT *, answer<>'' AND b>=1 AND least(len(f)-1,{ALEN})>b-1 AS ok FROM b)"""


@query(
    "c30_answer_loss",
    f"""WITH {ANSWERED} SELECT doc_id, CASE WHEN ok THEN md5(array_to_string(f[1:{ALEN}],' ')) END AS token_ids, CASE WHEN ok THEN (b-1)::INT END AS first_label,
      CASE WHEN ok THEN md5(array_to_string(f[b+1:],' ')) END AS label_ids FROM g""",
)
def answer_loss(t):
    out = H.answer_loss(questions(t), ALEN)
    return out.select(
        "doc_id", digest("token_ids").alias("token_ids"), F.col("label_positions")[0].alias("first_label"),
        digest("label_ids").alias("label_ids"),
    )


@query(
    "c31_resolve_answer",
    """SELECT doc_id, CASE doc_id%4 WHEN 0 THEN ['red','green','blue'][doc_id%3+1] WHEN 1 THEN 'free text' WHEN 2 THEN '9' ELSE ['red','green','blue'][doc_id%3+1] END AS answer FROM documents""",
)
def resolve_answer(t):
    target = F.expr("CASE doc_id%4 WHEN 0 THEN CAST(doc_id%3 AS STRING) WHEN 1 THEN 'free text' WHEN 2 THEN '9' ELSE ' ' || (doc_id%3) || ' ' END")
    choices = F.array(F.lit("red"), F.lit("green"), F.lit("blue"))
    return t.documents.select("doc_id", H.resolve_answer(target, choices).alias("answer"))


CAPPED = f"""WITH {ANSWERED}, d AS (SELECT source AS task, doc_id, ok FROM g JOIN documents USING (doc_id)),
  c AS (SELECT *, COALESCE(sum(ok::INT) OVER (PARTITION BY task ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM d), s AS (SELECT * FROM c WHERE before<20)"""


def judged(t):
    out = H.answer_loss(questions(t), ALEN)
    return out.select("task", F.col("doc_id").alias("doc_no"), F.col("token_ids").isNotNull().alias("ok"))


@query(
    "c32_cap_tasks",
    f"{CAPPED} SELECT task, sum(ok::INT)::BIGINT AS samples, count(*) AS seen, count(*) FILTER (NOT ok) AS skipped FROM s GROUP BY 1",
)
def cap_tasks(t):
    return H.cap_tasks(judged(t), 20)[1]


@query(
    "c32_tile_tasks",
    f"""{CAPPED}, k AS (SELECT task, doc_id, before AS k, count(*) OVER (PARTITION BY task) AS n FROM s WHERE ok),
    r AS (SELECT task, doc_id, k+n*x AS k, x FROM (SELECT *, unnest(range(CASE WHEN n<50 THEN ceil(50.0/n)::BIGINT ELSE 1 END)) AS x FROM k))
    SELECT task, doc_id AS doc_no, k::BIGINT AS k FROM r WHERE k<50 OR x=0""",
)
def tile_tasks(t):
    return H.tile_tasks(H.cap_tasks(judged(t), 20)[0], 50)


@query(
    "c32_dense_rows",
    f"""WITH {ANSWERED} SELECT doc_id, md5(array_to_string(f[1:{ALEN}]||list_transform(range({ALEN}-len(f[1:{ALEN}])), lambda x: 0),' ')) AS tokens,
      md5(array_to_string(list_transform(range(b-1), lambda x: 0)||f[b+1:]||list_transform(range({ALEN}-(b-1)-len(f[b+1:])), lambda x: 0),' ')) AS labels, len(f[b+1:])::BIGINT AS loss_tokens FROM g WHERE ok""",
)
def dense_rows(t):
    good = H.answer_loss(questions(t), ALEN).filter("token_ids is not null")
    out = H.dense_rows(good, ALEN)
    return out.select(
        "doc_id", digest("tokens").alias("tokens"), digest("labels").alias("labels"),
        F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("loss_tokens"),
    )


SHARDS = 3
CONCAT = f"""WITH RECURSIVE x AS (SELECT conv_id, turn, {TURN_TOKENS} AS tk FROM conversations),
  c AS (SELECT conv_id, (flatten(list(tk ORDER BY turn))||[256])[1:512] AS ids, (list_transform(range(sum(len(tk))::BIGINT), lambda q: 1)||[0])[1:512] AS ls, row_number() OVER (ORDER BY conv_id)-1 AS i, count(*) OVER () AS n FROM x GROUP BY 1),
  s AS (SELECT *, len(ids) AS m, CASE WHEN i < (n//{SHARDS}+1)*(n%{SHARDS}) THEN i//(n//{SHARDS}+1) ELSE n%{SHARDS} + (i-(n//{SHARDS}+1)*(n%{SHARDS}))//(n//{SHARDS}) END AS shard FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY i) AS j FROM s),
  w AS (SELECT shard, j, i, m, 0::BIGINT AS pack, m AS held FROM r WHERE j=1 UNION ALL
    SELECT r.shard, r.j, r.i, r.m, CASE WHEN w.held>512 THEN w.pack+1 ELSE w.pack END, CASE WHEN w.held>512 THEN r.m ELSE w.held+r.m END FROM w JOIN r ON r.shard=w.shard AND r.j=w.j+1),
  pk AS (SELECT shard, pack FROM w GROUP BY 1,2 HAVING max(held)>512)"""


@query(
    "c33_pack_concat",
    f"""{CONCAT} SELECT w.shard::INT AS shard, w.pack, count(*)::INT AS "rows", md5(array_to_string(flatten(list(ids ORDER BY w.i)),' ')) AS input_ids, md5(array_to_string(flatten(list(ls ORDER BY w.i)),' ')) AS loss_mask
    FROM w JOIN pk ON w.shard=pk.shard AND w.pack=pk.pack JOIN r ON r.i=w.i GROUP BY 1,2""",
)
def pack_concat(t):
    out = H.pack_concat(chats(t), 512, SHARDS, 256)
    return out.select("shard", "pack", "rows", digest("input_ids").alias("input_ids"), digest("loss_mask").alias("loss_mask"))


@query(
    "c33_serve_packs",
    f"""{CONCAT}, z AS (SELECT shard, count(*) AS n FROM pk GROUP BY 1), q AS (SELECT unnest(range((SELECT 3*count(*) FROM pk))) AS idx)
    SELECT idx, shard::INT AS shard, (idx//{SHARDS})%n AS pack FROM q JOIN z ON z.shard=idx%{SHARDS}""",
)
def serve_packs(t):
    packs = H.pack_concat(chats(t), 512, SHARDS, 256).select("shard", "pack")
    return H.serve_packs(packs, 3 * packs.count())


@query(
    "b28_harmonize_chat",
    """WITH c AS (SELECT conv_id, count(*) AS n, md5(string_agg(role||':'||text, '|' ORDER BY turn)) AS m, arg_min(role, turn) AS f FROM conversations GROUP BY 1)
    SELECT conv_id, m AS messages FROM c WHERE n>=2 AND f<>'assistant'""",
)
def harmonize_chat(t):
    # the same chats under the other speaker names
    other = F.expr("CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END")
    rows = H.conversations(t.conversations.withColumn("role", other)).select(
        "conv_id",
        F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))).alias("conversations"),
    )
    out = H.harmonize_chat(rows, "aliases", "conv_id")
    text = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return out.select("conv_id", F.md5(F.array_join(text, "|")).alias("messages"))


@query(
    "b28_harmonize_pairs",
    "SELECT item_id, md5('user:'||text||'|assistant:'||text) AS messages FROM benchmark",
)
def harmonize_pairs(t):
    rows = t.benchmark.select("item_id", F.col("text").alias("question"), F.col("text").alias("response"))
    out = H.harmonize_chat(rows, "pair", "item_id")
    text = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return out.select("item_id", F.md5(F.array_join(text, "|")).alias("messages"))
