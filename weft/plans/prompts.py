"""Queries: prompts, conversation wording and media token arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.tokens import byte_encode
from weft.operators import media as M
from weft.operators import prompts as P
from weft.plans.registry import digest, query

# options of an item follow from its id
OPTS = "array('red '||doc_id, 'green', 'blue '||(doc_id%7), 'old')"
OPTS_SQL = "['red '||doc_id, 'green', 'blue '||(doc_id%7), 'old']"
Q = "text"


def items(t):
    return t.documents.selectExpr(
        "doc_id", "source AS subject", f"{Q} AS question", f"{OPTS} AS choices", "cast(doc_id % 4 as int) AS answer"
    )


LINES = "'A. red '||doc_id||{s}||'B. green'||{s}||'C. blue '||(doc_id%7)||{s}||'D. old'"


@query(
    "b14_mc_prompt",
    f"""WITH d AS (SELECT doc_id, source AS subject, row_number() OVER (PARTITION BY source ORDER BY doc_id)-1 AS idx, {Q}||chr(10)||{LINES.format(s='chr(10)')} AS q, substr('ABCD',(doc_id%4)::INT+1,1) AS a FROM documents),
    e AS (SELECT subject, string_agg(q||chr(10)||'Answer: '||a||chr(10)||chr(10), '' ORDER BY idx) AS ex FROM d WHERE idx<3 GROUP BY 1)
    SELECT doc_id, md5('The following are multiple choice questions (with answers) about '||replace(subject,'_',' ')||'.'||chr(10)||chr(10)||ex||q||chr(10)||'Answer:') AS few,
      md5(q||chr(10)||'Answer:') AS bare FROM d JOIN e USING (subject)""",
)
def mc_prompt(t):
    dev = P.numbered_examples(items(t), "doc_id")
    few = P.mc_prompt(items(t), dev, 3).select("doc_id", F.md5("prompt").alias("few"))
    bare = P.mc_prompt(items(t), subject_header=False).select("doc_id", F.md5("prompt").alias("bare"))
    return few.join(bare, "doc_id")


@query(
    "b15_format_mc",
    f"""SELECT doc_id, md5({Q}||chr(10)||{LINES.format(s='chr(10)')}||chr(10)||'Answer with the option''s letter from the given choices directly.') AS prompt, substr('ABCD',(doc_id%4)::INT+1,1) AS gold FROM documents""",
)
def format_mc(t):
    rows = items(t).withColumnRenamed("choices", "options").withColumnRenamed("answer", "answer_index")
    return P.format_mc(rows).select("doc_id", F.md5("prompt").alias("prompt"), "gold")


PAREN = "'(A) red '||doc_id||chr(10)||'(B) green'||chr(10)||'(C) blue '||(doc_id%7)||chr(10)||'(D) old'||chr(10)"


@query(
    "b16_construct_prompt",
    f"""SELECT doc_id, md5('Think.'||chr(10)||chr(10)||CASE WHEN doc_id%3=0 THEN 'Short: '||trim({Q}, ' '||chr(10)) ELSE trim({Q}, ' '||chr(10))||' -> '||{PAREN}||'!' END) AS prompt,
      CASE WHEN doc_id%3=0 THEN 'C' ELSE {OPTS_SQL}[3] END AS gt_content, CASE WHEN doc_id%3<>0 THEN 'green' END AS second FROM documents""",
)
def construct_prompt(t):
    rows = t.documents.selectExpr(
        "doc_id", f"{Q} AS question", f"{OPTS} AS options", "'C' AS answer",
        "CASE WHEN doc_id%3=0 THEN 'open' ELSE 'multiple-choice' END AS question_type",
    )
    out = P.construct_prompt(rows, "{} -> {}!", "Short: {}", " Think. ")
    return out.select("doc_id", F.md5("prompt").alias("prompt"), "gt_content", F.col("index2ans")["B"].alias("second"))


@query(
    "b17_math_prompts",
    f"""SELECT doc_id, md5({Q}||chr(10)||'{P.TAGGED_HINT}') AS tagged, md5({Q}||chr(10)||'{P.BOXED_HINT}') AS boxed, n_chars::VARCHAR AS gold, md5({Q}) AS problem FROM documents""",
)
def math_prompts(t):
    wrapped = F.concat(F.lit(P.ANSWER_LEAD), F.expr(Q), F.lit(P.ANSWER_TAIL))
    return t.documents.select(
        "doc_id",
        F.md5(P.math_prompts(F.expr(Q), "tagged")).alias("tagged"),
        F.md5(P.math_prompts(F.expr(Q), "boxed")).alias("boxed"),
        P.numeric_gold(F.expr("replace(text,'#','')||'#### '||n_chars")).alias("gold"),
        F.md5(P.bare_problem(wrapped)).alias("problem"),
    )


@query(
    "b18_countdown_prompts",
    f"""SELECT event_id, md5('Using the numbers ['||event_id%50||', '||user_id||'], create an equation that equals '||(event_id%50+user_id)||'. {P.COUNTDOWN_TAIL}') AS prompt FROM events""",
)
def countdown_prompts(t):
    return t.events.select(
        "event_id",
        F.md5(P.countdown_prompts(F.expr("event_id % 50 + user_id"), F.expr("array(event_id % 50, user_id)"))).alias("prompt"),
    )


HASH = "('0x'||substr(md5(concat_ws('|','7',{0},doc_id)),1,8))::BIGINT"
BOX = "CASE WHEN doc_id%2=0 THEN '<box>('||doc_id||','||(doc_id+1)||'),('||(doc_id+2)||','||(doc_id+3)||')</box>' ELSE '<quad>('||doc_id||',1),(2,3),(4,5),(6,7)</quad>' END"


@query(
    "b19_format_boxes",
    f"""WITH r AS (SELECT doc_id, replace({Q},'<image>','') AS ref, {BOX} AS region, {HASH.format("'task'")}%2=0 AS find, {HASH.format("'find'")}%2 AS f, {HASH.format("'read'")}%2 AS g FROM documents)
    SELECT doc_id, md5('<image>'||chr(10)||CASE WHEN find THEN replace(CASE f WHEN 0 THEN 'Find {{}}' ELSE 'Where is {{}}?' END,'{{}}',ref) ELSE replace(CASE g WHEN 0 THEN 'Read {{}}' ELSE '{{}}: text?' END,'{{}}',region) END) AS prompt,
      md5(CASE WHEN find THEN region ELSE ref END) AS answer, md5('<ref>'||ref||'</ref>'||region||'<ref>x</ref>'||region) AS labels FROM r""",
)
def format_boxes(t):
    rows = t.documents.selectExpr(
        "doc_id", f"{Q} AS text",
        "CASE WHEN doc_id%2=0 THEN array(doc_id,doc_id+1,doc_id+2,doc_id+3) ELSE array(doc_id,1L,2L,3L,4L,5L,6L,7L) END AS box",
    )
    out = P.format_boxes(rows, ["Find {}", "Where is {}?"], ["Read {}", "{}: text?"], 7, "doc_id")
    labels = P.label_boxes(F.array("text", F.lit("x")), F.array("box", "box"))
    return out.select("doc_id", F.md5("prompt").alias("prompt"), F.md5("answer").alias("answer"), F.md5(labels).alias("labels"))


@query(
    "b20_normalize_chat",
    """WITH c AS (SELECT doc_id, doc_id%6 AS m, replace(text,'<',' ') AS q FROM documents)
    SELECT doc_id, CASE m WHEN 4 THEN 'more image tags than images' WHEN 5 THEN 'unexpected role' END AS error,
      CASE WHEN m<4 THEN md5('system:Answer the questions.|user:'||CASE m WHEN 0 THEN '<image> and <image> '||q WHEN 1 THEN '<image><image> '||q WHEN 2 THEN ' '||q ELSE '<image><image>'||chr(10)||q END||'|assistant:ok') END AS messages,
      CASE m WHEN 0 THEN 'b,a' WHEN 1 THEN 'a,a' WHEN 2 THEN '' WHEN 3 THEN 'a,b' WHEN 4 THEN 'a,b' ELSE 'a' END AS picked FROM c""",
)
def normalize_chat(t):
    q = "replace(text,'<',' ')"
    rows = t.documents.selectExpr(
        "doc_id",
        f"""array(named_struct('from', CASE WHEN doc_id%6=5 THEN 'bot' ELSE 'human' END, 'value',
          CASE doc_id%6 WHEN 0 THEN '<image-2> and <image-1> '||{q} WHEN 1 THEN '<image><image> '||{q} WHEN 2 THEN '<image> '||{q} WHEN 3 THEN {q} WHEN 4 THEN '<image><image><image>' ELSE {q} END),
          named_struct('from','gpt','value','ok')) AS texts""",
        "CASE doc_id%6 WHEN 1 THEN array('a') WHEN 2 THEN cast(array() as array<string>) WHEN 5 THEN array('a') ELSE array('a','b') END AS images",
    )
    out = P.normalize_chat(rows)
    text = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return out.select("doc_id", "error", F.md5(text).alias("messages"), F.array_join("picked", ",").alias("picked"))


@query(
    "b21_caption_pairs",
    f"""WITH c AS (SELECT doc_id, string_split(trim(text, ' '||chr(10)), chr(10)) AS ls, {HASH.format("'prompt'")}%3 AS p, {HASH.format("'line'")} AS l FROM documents)
    SELECT doc_id, '<image>'||chr(10)||['Say.','Tell.','Describe.'][p+1]||chr(10) AS prompt, md5(ls[l%len(ls)+1]) AS answer FROM c""",
)
def caption_pairs(t):
    rows = t.documents.select("doc_id", F.col("text").alias("caption"))
    out = P.caption_pairs(rows, ["Say.", "Tell.", "Describe."], 7, "doc_id", by_line=True)
    return out.select("doc_id", "prompt", F.md5("answer").alias("answer"))


@query(
    "b21_weighted_answers",
    """WITH u AS (SELECT doc_id, ('0x'||substr(md5(concat_ws('|','7','answer',doc_id)),1,12))::BIGINT/281474976710656.0::DOUBLE*6 AS u FROM documents)
    SELECT doc_id, '<image>'||chr(10)||'q'||doc_id AS prompt, CASE WHEN u<1 THEN 'a' WHEN u<3 THEN 'b' ELSE 'c' END AS answer FROM u""",
)
def weighted_answers(t):
    rows = t.documents.selectExpr("doc_id", "'q'||doc_id AS context", "array('a','b','c') AS answers", "array(1D,2D,3D) AS weights")
    return P.answer_pairs(rows, 7, "doc_id").select("doc_id", "prompt", "answer")


@query(
    "b22_audio_tokens",
    """SELECT doc_id, greatest(1, ceil(ceil((n_chars*100+1)/160.0)/2.0))::BIGINT AS plain, greatest(1, ceil((floor((n_chars*100-400)/160.0)+1)/2.0))::BIGINT AS windowed FROM documents""",
)
def audio_tokens(t):
    n = F.col("n_chars") * 100
    return t.documents.select(
        "doc_id", M.audio_tokens(n).alias("plain"), M.audio_tokens(n, window=0.025).alias("windowed")
    )


@query(
    "b23_fit_length",
    """WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)),'..'), lambda h: ('0x'||h)::INT) AS tk, [1+doc_id%3, 2] AS tl FROM documents),
    c AS (SELECT *, greatest(256-list_sum(tl)*20+2,0)::BIGINT AS room FROM b), d AS (SELECT doc_id, len(tk)+list_sum(tl)*20-2 AS total_len, ([300,300]||tk)[1:room] AS t, ([-100,-100]||list_transform(tk, lambda v, i: CASE WHEN i<=doc_id%250 THEN -100 ELSE v END))[1:room] AS g, tl FROM c)
    SELECT doc_id, (total_len+2)::INT AS total_len, len(t)::INT AS n, md5(array_to_string(t,' ')) AS tokens, CASE WHEN len(list_filter(g, lambda x: x<>-100))=0 THEN 'all targets ignored after truncation' END AS error FROM d""",
)
def fit_length(t):
    raw = byte_encode("text")
    images = F.array(F.lit(300), F.lit(300))
    rows = t.documents.select("doc_id", raw.alias("b")).select(
        "doc_id",
        F.concat(images, "b").alias("tokens"),
        F.concat(
            F.array(F.lit(-100), F.lit(-100)),
            F.transform("b", lambda v, i: F.when(i < F.col("doc_id") % 250, -100).otherwise(v)),
        ).alias("targets"),
        F.array((1 + F.col("doc_id") % 3).cast("int"), F.lit(2)).alias("tiles"),
    )
    out = M.fit_length(rows, 20, 256, 300, 0)
    return out.select("doc_id", "total_len", F.size("tokens").alias("n"), digest("tokens").alias("tokens"), "error")


@query(
    "b24_choose_tiles",
    """WITH d AS (SELECT doc_id, 2048-4-(n_chars%1900) AS budget, unnest([12,8,6,4,2,1]) AS lv, doc_id%3 AS k FROM documents)
    SELECT doc_id, max(lv)::INT AS max_tiles, max(lv+k)::INT AS n_tiles FROM d WHERE (lv+k)*100<=budget OR lv=1 GROUP BY 1""",
)
def choose_tiles(t):
    levels = [F.lit(x) for x in M.TILE_LADDER]
    pairs = [c for x in levels for c in (x, (x + F.col("doc_id") % 3).cast("int"))]
    rows = t.documents.select("doc_id", F.expr("cast(n_chars % 1900 as int)").alias("n_ids"), F.create_map(*pairs).alias("tiles_at"))
    return M.choose_tiles(rows, 100, 2048).select("doc_id", "max_tiles", "n_tiles")


HB = "list_transform(regexp_extract_all(hex(encode({0})),'..'), lambda h: ('0x'||h)::INT)"


@query(
    "b25_encode_pair",
    f"""WITH d AS (SELECT doc_id, {HB.format("text")} AS a, CASE WHEN doc_id%3=0 THEN NULL ELSE {HB.format("reverse(text)")} END AS b FROM documents),
    e AS (SELECT doc_id, b IS NULL AS nb, [256]||a||[257]||COALESCE(b,[]) AS s, list_transform(range(len(a)+2), lambda x: 0)||list_transform(range(COALESCE(len(b),0)), lambda x: 1) AS k FROM d),
    f AS (SELECT doc_id, nb, CASE WHEN len(s)>=100 THEN s[1:99] ELSE s END AS s, CASE WHEN len(s)>=100 THEN k[1:99] ELSE k END AS k, NOT nb OR len(s)>=100 AS cl FROM e),
    g AS (SELECT doc_id, CASE WHEN cl THEN s||[257] ELSE s END AS s, CASE WHEN cl THEN k||[CASE WHEN nb THEN 0 ELSE 1 END] ELSE k END AS k FROM f)
    SELECT doc_id, md5(array_to_string(s||list_transform(range(100-len(s)), lambda x: 258),' ')) AS ids, md5(array_to_string(k||list_transform(range(100-len(s)), lambda x: 258),' ')) AS types, len(s)::BIGINT AS n FROM g""",
)
def encode_pair(t):
    rows = t.documents.select(
        "doc_id",
        byte_encode("text").alias("a"),
        F.when(F.expr("doc_id % 3 <> 0"), byte_encode(F.reverse("text"))).alias("b"),
    )
    out = M.encode_pair(rows, 100, 256, 257, 258)
    return out.select(
        "doc_id", digest("ids").alias("ids"), digest("types").alias("types"),
        F.aggregate("paddings", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("n"),
    )


CATEGORIES = ["Accounting", "Art", "Art_Theory", "Biology", "Math"]


@query(
    "b27_tag_samples",
    """SELECT doc_id, CASE WHEN doc_id%3<2 THEN 'img'||doc_id END AS image, CASE doc_id%5 WHEN 0 THEN 'accounting' WHEN 1 THEN 'art' WHEN 2 THEN 'art' WHEN 3 THEN 'biology' ELSE 'math' END AS field FROM documents""",
)
def tag_samples(t):
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    rows = t.documents.select(
        "doc_id",
        F.concat(F.lit("validation_"), F.element_at(names, F.expr("cast(doc_id % 5 + 1 as int)")), F.lit("_"), F.col("doc_id").cast("string")).alias("id"),
        F.expr("CASE doc_id%3 WHEN 0 THEN array('a','b') WHEN 1 THEN array('<img=''x.png''>','b') ELSE array('<img=''x.png''>','<img=''y.png''>') END").alias("options"),
        F.concat(F.lit("img"), F.col("doc_id").cast("string")).alias("image_1"),
    )
    table = t.spark.createDataFrame(list(enumerate(CATEGORIES)), "place int, category string")
    return P.tag_samples(rows, table).select("doc_id", "image", "field")


def templates_sql():
    def quoted(s):
        return "NULL" if s is None else "'" + s.replace("'", "''") + "'"

    return ", ".join(f"({i}, {quoted(k)}, {quoted(s)}, {quoted(h)}, {quoted(e)}, {str(im).lower()})" for i, (k, s, h, e, im) in enumerate(P.TEMPLATES))


@query(
    "b29_benchmark_prompts",
    f"""WITH tp AS (SELECT * FROM (VALUES {templates_sql()}) v(i, task, sys, head, tail, img))
    SELECT doc_id, task, sys AS system, md5(CASE WHEN img THEN '<image>'||chr(10) ELSE '' END || head || CASE WHEN tail IS NULL THEN '' ELSE {Q}||tail END) AS "user",
      md5('Question: '||{Q}||chr(10)||'Options:'||chr(10)||rtrim({PAREN}, chr(10)||' ')) AS lettered, '(C) blue '||(doc_id%7) AS gold FROM documents JOIN tp ON i=doc_id%{len(P.TEMPLATES)}""",
)
def benchmark_prompts(t):
    names = F.array(*[F.lit(x[0]) for x in P.TEMPLATES])
    rows = t.documents.select(
        "doc_id",
        F.element_at(names, F.expr(f"cast(doc_id % {len(P.TEMPLATES)} + 1 as int)")).alias("task"),
        F.expr(Q).alias("question"),
        F.expr(OPTS).alias("options"),
    )
    out = P.benchmark_prompts(rows)
    return out.select(
        "doc_id", "task", "system", F.md5("user").alias("user"),
        F.md5(P.lettered_question(F.col("question"), F.col("options"))).alias("lettered"),
        P.lettered_answer(F.expr("'blue '||(doc_id%7)"), F.col("options")).alias("gold"),
    )


@query(
    "b30_frame_indices",
    """WITH s AS (SELECT unnest(range(8)) AS i), d AS (SELECT doc_id, n_chars AS total, i FROM documents, s)
    SELECT doc_id, i::INT AS slot, floor((total-1)*i/7.0::DOUBLE)::BIGINT AS frame FROM d""",
)
def frame_indices(t):
    rows = t.documents.select("doc_id", F.col("n_chars").alias("total"))
    return M.frame_indices(rows, 8).select("doc_id", "slot", "frame")


@query(
    "b30_segment_frames",
    """WITH s AS (SELECT unnest(range(8)) AS i), d AS (SELECT doc_id, CASE WHEN doc_id%4=0 THEN 0.0 ELSE greatest(0, round_even((doc_id%40)*2.5,0)) END::DOUBLE AS lo,
      CASE WHEN doc_id%4=0 THEN n_chars+100 ELSE least(round_even((doc_id%40+30)*2.5,0), n_chars+100) END::DOUBLE AS hi FROM documents)
    SELECT doc_id, i::INT AS slot, trunc(lo+(hi-lo)/8/2+round_even((hi-lo)/8*i,0))::BIGINT AS frame FROM d, s""",
)
def segment_frames(t):
    rows = t.documents.selectExpr(
        "doc_id", "CASE WHEN doc_id%4<>0 THEN double(doc_id%40) END AS start", "CASE WHEN doc_id%4<>0 THEN double(doc_id%40+30) END AS `end`",
        "2.5D AS fps", "n_chars + 100 AS last",
    )
    return M.frame_indices(rows, 8, by_time=True).select("doc_id", "slot", "frame")


TAGGED = """CASE doc_id%8 WHEN 0 THEN '<image 1>' WHEN 1 THEN 'See:<image 1>'||{q} WHEN 2 THEN 'Look. <image 1> '||{q} WHEN 3 THEN '<image 1> Shows '||{q}
  WHEN 4 THEN '<image 1> shows <image 3>'||{q} WHEN 5 THEN 'what is in <image 1> now '||{q} WHEN 6 THEN 'is it (<image 1>)'||{q} ELSE 'x'||{q}||'?<image 1>' END"""
PLAIN = "replace(replace(text,chr(10),''),' ','')"


@query(
    "b31_rewrite_image_tags",
    f"""SELECT doc_id, CASE doc_id%8 WHEN 0 THEN 'Answer the question in the image.' WHEN 1 THEN trim('See in the image. '||{PLAIN}) WHEN 2 THEN CASE WHEN {PLAIN}='' THEN 'Look.' ELSE 'Look. '||{PLAIN} END WHEN 3 THEN trim('Shows '||{PLAIN})
      WHEN 4 THEN 'The image shows '||{PLAIN} WHEN 5 THEN trim('what is in the image now '||{PLAIN}) WHEN 6 THEN 'is it '||{PLAIN} ELSE 'x'||{PLAIN}||'?' END AS told,
      CASE WHEN doc_id%8=4 THEN '<image> shows <image>'||{PLAIN} END AS tokens, CASE WHEN doc_id%8=4 THEN '1,3' END AS images FROM documents""",
)
def rewrite_image_tags(t):
    q = F.expr(TAGGED.format(q=PLAIN))
    both = P.first_image_tags(q)
    multi = F.expr("doc_id % 8 = 4")
    return t.documents.select(
        "doc_id",
        P.rewrite_image_tags(q).alias("told"),
        F.when(multi, both["prompt"]).alias("tokens"),
        F.when(multi, F.array_join(both["images"].cast("array<string>"), ",")).alias("images"),
    )
