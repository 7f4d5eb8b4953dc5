"""Prompts, options, boxes, tags and conversation wording as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.ordering import hash_below, hash_uniform, ranged_running
from weft.functions.text import strip
from weft.operators.chat import IMAGE_TOKEN

# Wording of the prompts.
OPTION_HINT = "Answer with the option's letter from the given choices directly."
SHORT_HINT = "Answer the question using a single word or phrase."
SUBJECT_HEADER = "The following are multiple choice questions (with answers) about {}.\n\n"
BOXED_HINT = (
    "Please reason step by step and provide your answer between \\boxed{} tags, "
    "for example \\boxed{20\\sqrt{3}}."
)
TAGGED_HINT = (
    "Please reason step by step and provide your answer between <answer> </answer> tags, "
    "for example <answer> 20\\sqrt{3} </answer>. Do not include an = sign."
)
ANSWER_LEAD = (
    "The last line of your response should be of the form Answer: $Answer (without quotes) where "
    "$Answer is the answer to the problem.\n\n"
)
ANSWER_TAIL = '\nRemember to put your answer on its own line after "Answer:".'
COUNTDOWN_HEAD = "Using the numbers {}, create an equation that equals {}. "
COUNTDOWN_TAIL = (
    "You can use basic arithmetic operations (+, -, *, /) and each number can only be used once. \n"
    "        Return the final answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 "
    "</answer>. Do not include an = sign."
)
FOLLOW = "Follow the user's instruction and answer questions."
ANSWER_IT = "Answer the questions."
LETTER_ONLY = (
    "Respond with only the letter choice (A, B, C, or D) of the correct option.\n"
)
VIDEO_HEAD = (
    "Select the best answer to the following multiple-choice question based on the video. "
    "Respond with only the letter (A, B, C, or D) of the correct option.\n"
)
# task, system line, text before the question, text after it, whether an image token leads
TEMPLATES = [
    ("captioning", ANSWER_IT, "Give a brief description of this image in one sentence.", None, True),
    ("TextVQA", FOLLOW, "", "\nAnswer the question using a single word, phrase, or number.", True),
    ("InfoVQA", FOLLOW, "", "\nAnswer the question using a single word, phrase, or number.", True),
    ("SPDocVQA", FOLLOW, "", "\nAnswer the question using a single word, phrase, or number.", True),
    ("VQAv2", FOLLOW, "", "\n" + SHORT_HINT, True),
    ("ChartQA", FOLLOW, "", "\n" + SHORT_HINT, True),
    ("MMMU", ANSWER_IT, "", "", True),
    ("VideoMME", ANSWER_IT, VIDEO_HEAD, "\n", True),
    ("OCRBench", FOLLOW, "", "", True),
    ("OCRBench_v2", FOLLOW, "", "", True),
    ("RD_TableBench", FOLLOW, "", "", True),
    (
        "MathVista",
        "You are math expert. Use your math knowledge to calculate the answer.",
        "",
        "",
        True,
    ),
    ("RealworldQA", FOLLOW, "", "", True),
    ("AI2D", FOLLOW, "", "", True),
    ("MotionBench", ANSWER_IT, "", "\n" + LETTER_ONLY, True),
    ("PhysGameBench", ANSWER_IT, "", "\n" + LETTER_ONLY, True),
    ("MVBench", ANSWER_IT, "", "\n" + SHORT_HINT, True),
    ("PerceptionTest", ANSWER_IT, "", "", True),
    ("inference", ANSWER_IT, "", "", False),
]


def letter(i: Column) -> Column:
    return F.char((F.lit(65) + i).cast("bigint"))


def option_lines(options: Column, left: str = "", right: str = ". ") -> Column:
    """Lettered options, one per line, each line closed."""
    lines = F.transform(
        options, lambda o, i: F.concat(F.lit(left), letter(i), F.lit(right), o, F.lit("\n"))
    )
    return F.array_join(lines, "")


def _example(question: Column, choices: Column) -> Column:
    lines = F.transform(choices, lambda c, i: F.concat(F.lit("\n"), letter(i), F.lit(". "), c))
    return F.concat(question, F.array_join(lines, ""))


def mc_prompt(
    test: DataFrame, dev: DataFrame | None = None, shots: int = 0, subject_header: bool = True
) -> DataFrame:
    """Adds ``prompt``: header, the first ``shots`` solved examples of the subject, the question.

    ``dev`` (subject, idx, question, choices, answer) numbers its examples per subject.
    """
    header = F.concat(
        F.lit(SUBJECT_HEADER.split("{}")[0]),
        F.replace("subject", F.lit("_"), F.lit(" ")),
        F.lit(SUBJECT_HEADER.split("{}")[1]),
    )
    body = F.concat(_example(F.col("question"), F.col("choices")), F.lit("\nAnswer:"))
    rows, solved = test, F.lit("")
    if shots > 0:
        one = F.concat(
            _example(F.col("question"), F.col("choices")),
            F.lit("\nAnswer: "),
            letter(F.col("answer")),
            F.lit("\n\n"),
        )
        # at most ``shots`` rows per subject
        few = dev.filter(F.col("idx") < shots).groupBy("subject").agg(
            F.sort_array(F.collect_list(F.struct("idx", one.alias("t")))).alias("__e")
        )
        rows = test.join(few, "subject", "left")
        solved = F.coalesce(F.array_join(F.transform("__e", lambda e: e["t"]), ""), F.lit(""))
    out = rows.withColumn(
        "prompt", F.concat(header if subject_header else F.lit(""), solved, body)
    )
    return out.drop("__e")


def format_mc(df: DataFrame) -> DataFrame:
    """Adds ``prompt`` and ``gold`` letter from (question, options, answer_index)."""
    text = F.concat("question", F.lit("\n"), option_lines(F.col("options")), F.lit(OPTION_HINT))
    return df.withColumn("prompt", text).withColumn("gold", letter(F.col("answer_index")))


def construct_prompt(
    df: DataFrame, choice_format: str, short_format: str, instructions: str = ""
) -> DataFrame:
    """Prompt, choices, index-to-text map and gold content by question type.

    ``df`` (question, options, answer, question_type); formats hold one ``{}`` per part.
    """
    multi = F.col("question_type") == "multiple-choice"
    question = strip("question")
    letters = F.transform("options", lambda o, i: letter(i))
    listed = option_lines(F.col("options"), "(", ") ")

    def filled(pattern, *parts):
        pieces = pattern.split("{}")
        cells = [F.lit(pieces[0])]
        for part, piece in zip(parts, pieces[1:]):
            cells += [part, F.lit(piece)]
        return F.concat(*cells)

    empty = F.when(multi, filled(choice_format, question, listed)).otherwise(
        filled(short_format, question)
    )
    lead = instructions.strip() + "\n\n" if instructions else ""
    place = F.ascii(F.upper("answer")) - 64
    return (
        df.withColumn("all_choices", F.when(multi, letters))
        .withColumn("index2ans", F.when(multi, F.map_from_arrays(letters, "options")))
        .withColumn("prompt", F.concat(F.lit(lead), empty))
        .withColumn(
            "gt_content",
            F.when(multi, F.try_element_at("options", place)).otherwise(F.col("answer")),
        )
    )


def math_prompts(problem: Column, fmt: str) -> Column:
    """Problem and the instruction of the answer format, ``boxed`` or ``tagged``."""
    hints = {"boxed": BOXED_HINT, "tagged": TAGGED_HINT}
    return F.concat(problem, F.lit("\n" + hints[fmt]))


def numeric_gold(answer: Column) -> Column:
    return F.element_at(F.split(answer, "#### "), -1)


def bare_problem(prompt: Column) -> Column:
    return F.replace(F.replace(prompt, F.lit(ANSWER_LEAD), F.lit("")), F.lit(ANSWER_TAIL), F.lit(""))


def countdown_prompts(target: Column, nums: Column) -> Column:
    a, b, c = COUNTDOWN_HEAD.split("{}")
    listed = F.concat(F.lit("["), F.array_join(nums.cast("array<string>"), ", "), F.lit("]"))
    return F.concat(
        F.lit(a), listed, F.lit(b), target.cast("string"), F.lit(c), F.lit(COUNTDOWN_TAIL)
    )


def box_text(box: Column) -> Column:
    """Four numbers as a box, eight as a quadrilateral."""

    def points(n):
        return F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.lit(n - 1)),
                lambda i: F.concat(
                    F.lit("("), F.get(box, 2 * i).cast("string"), F.lit(","),
                    F.get(box, 2 * i + 1).cast("string"), F.lit(")"),
                ),
            ),
            ",",
        )

    return F.when(
        F.size(box) == 4, F.concat(F.lit("<box>"), points(2), F.lit("</box>"))
    ).otherwise(F.concat(F.lit("<quad>"), points(4), F.lit("</quad>")))


def label_boxes(texts: Column, boxes: Column) -> Column:
    """All labelled regions of a page in one answer."""
    cells = F.zip_with(
        texts,
        boxes,
        lambda t, b: F.concat(
            F.lit("<ref>"), F.replace(t, F.lit(IMAGE_TOKEN), F.lit("")), F.lit("</ref>"), box_text(b)
        ),
    )
    return F.array_join(cells, "")


def _pick(prompts: list[str], content: Column, seed, *keys) -> Column:
    which = hash_below(seed, len(prompts), *keys)
    chosen = F.element_at(F.array(*[F.lit(p) for p in prompts]), (which + 1).cast("int"))
    filled = F.replace(chosen, F.lit("{}"), content)
    return F.when(F.contains(filled, F.lit(IMAGE_TOKEN)), filled).otherwise(
        F.concat(F.lit(IMAGE_TOKEN + "\n"), filled)
    )


def format_boxes(
    df: DataFrame, referring: list[str], grounded: list[str], seed: int, key: str
) -> DataFrame:
    """Adds ``prompt`` and ``answer`` from (key, text, box): find the text, or read the region,
    chosen by a seeded hash of the key."""
    ref = F.replace("text", F.lit(IMAGE_TOKEN), F.lit(""))
    region = box_text(F.col("box"))
    find = hash_below(seed, 2, F.lit("task"), key) == 0
    return df.withColumn(
        "prompt",
        F.when(find, _pick(referring, ref, seed, F.lit("find"), key)).otherwise(
            _pick(grounded, region, seed, F.lit("read"), key)
        ),
    ).withColumn("answer", F.when(find, region).otherwise(ref))


def weighted_choice(options: Column, weights: Column, uniform: Column) -> Column:
    """Option whose cumulative share first exceeds the uniform number."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    found = F.aggregate(
        weights,
        F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(-1).alias("hit")),
        lambda s, w: F.struct(
            (s["i"] + 1).alias("i"),
            (s["sum"] + w).alias("sum"),
            F.when((s["hit"] < 0) & (s["sum"] + w > uniform * total), s["i"])
            .otherwise(s["hit"])
            .alias("hit"),
        ),
    )["hit"]
    last = F.size(options) - 1
    return F.get(options, F.when(found < 0, last).otherwise(found))


def caption_pairs(
    df: DataFrame, prompts: list[str], seed: int, key: str, by_line: bool = False
) -> DataFrame:
    """Adds ``prompt`` and ``answer``: a seeded prompt, the caption or one seeded line of it."""
    which = hash_below(seed, len(prompts), F.lit("prompt"), key)
    chosen = F.element_at(F.array(*[F.lit(p) for p in prompts]), (which + 1).cast("int"))
    caption = strip("caption")
    lines = F.split(caption, "\n")
    line = F.get(lines, hash_below(seed, F.size(lines), F.lit("line"), key).cast("int"))
    return df.withColumn(
        "prompt", F.concat(F.lit(IMAGE_TOKEN + "\n"), chosen, F.lit("\n"))
    ).withColumn("answer", line if by_line else caption)


def answer_pairs(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Adds ``prompt`` and ``answer`` from (context, answers, weights): a weighted seeded answer."""
    context = F.when(F.contains("context", F.lit(IMAGE_TOKEN)), F.col("context")).otherwise(
        F.concat(F.lit(IMAGE_TOKEN + "\n"), "context")
    )
    u = hash_uniform(seed, F.lit("answer"), key)
    return df.withColumn("prompt", context).withColumn(
        "answer", weighted_choice(F.col("answers"), F.col("weights"), u)
    )


def tag_samples(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds ``image`` and ``field`` from (id, options, image_1): option images hide the main one
    when there are several; the field is the category named in the id."""
    paths = F.flatten(
        F.transform(
            "options", lambda o: F.regexp_extract_all(o, F.lit("<img='(.*?)'>"), F.lit(1))
        )
    )
    rows = df.withColumn("__n", F.size(paths))
    named = rows.select("id").join(
        F.broadcast(categories),  # a fixed table of some thirty names with their order
        F.contains("id", F.col("category")),
    )
    first = named.groupBy("id").agg(F.min_by("category", "place").alias("category"))
    return rows.join(first, "id", "left").select(
        *df.columns,
        F.when(F.col("__n") <= 1, F.col("image_1")).alias("image"),
        F.replace(F.lower("category"), F.lit("_"), F.lit(" ")).alias("field"),
    )


def benchmark_prompts(df: DataFrame) -> DataFrame:
    """Adds ``system`` and ``user`` from (task, question) by the template of the task."""
    spark = df.sparkSession
    table = spark.createDataFrame(
        TEMPLATES, "task string, system string, head string, tail string, image boolean"
    )
    known = df.join(F.broadcast(table), "task", "left")
    unknown = F.raise_error(F.concat(F.lit("no prompt for task "), F.col("task"))).cast("string")
    image = F.when(F.col("image"), F.lit(IMAGE_TOKEN + "\n")).otherwise(F.lit(""))
    asked = F.when(F.col("tail").isNull(), F.lit("")).otherwise(
        F.concat("question", F.col("tail"))
    )
    user = F.concat(image, F.col("head"), asked)
    return known.select(
        *df.columns,
        F.when(F.col("system").isNull(), unknown).otherwise(F.col("system")).alias("system"),
        user.alias("user"),
    )


def lettered_question(question: Column, options: Column) -> Column:
    """``Question: ... Options: (A) ...`` without a closing line break."""
    return F.rtrim(
        F.concat(
            F.lit("Question: "), question, F.lit("\nOptions:\n"), option_lines(options, "(", ") ")
        ),
        F.lit("\n "),
    )


def lettered_answer(answer: Column, options: Column) -> Column:
    """``(A) text`` of the gold text."""
    return F.concat(
        F.lit("("), letter(F.array_position(options, answer) - 1), F.lit(") "), answer
    )


def choice_question(question: Column, options: Column) -> Column:
    return F.concat(question, F.lit("\n"), option_lines(options), F.lit(OPTION_HINT))


def rewrite_image_tags(q: Column) -> Column:
    """Wording of a question once its main image tag is gone; tags 2 to 7 vanish."""
    tag = "<image 1>"
    q = strip(q)

    def has(s):
        return F.contains(q, F.lit(s))

    def swap(old, new):
        return F.replace(q, F.lit(old), F.lit(new))

    parts = F.filter(
        F.transform(F.split(q, tag), lambda p: strip(p)), lambda p: p != ""
    )
    capital = F.substring(q, 11, 1).rlike(r"^\p{Lu}$")
    # The ordered wording rules.
    told = (
        F.when(q == tag, F.lit("Answer the question in the image."))
        .when(has(":" + tag), strip(swap(":" + tag, " in the image. ")))
        .when(has(": " + tag), strip(swap(": " + tag, " in the image. ")))
        .when(has("." + tag) | has(". " + tag), F.array_join(parts, " "))
        .when(
            F.startswith(q, F.lit(tag + " ")),
            strip(F.when(capital, swap(tag, "")).otherwise(swap(tag, "The image"))),
        )
        .when(F.startswith(q, F.lit(tag)), swap(tag, ""))
        .when(F.endswith(q, F.lit(tag + "?")), swap(tag, "the image"))
        .when(
            F.endswith(q, F.lit("?" + tag))
            | F.endswith(q, F.lit("? " + tag))
            | F.endswith(q, F.lit("\n" + tag)),
            strip(swap(tag, "")),
        )
        .when(has(" " + tag + " "), swap(tag, "the image"))
        .when(has(" " + tag), swap(tag, "the image"))
        .when(has("()" + tag), swap("()" + tag, ""))
        .when(has("(" + tag + ")"), swap("(" + tag + ")", ""))
        .when(has(tag + "."), swap(tag + ".", ". "))
        .otherwise(strip(swap(tag, ". ")))
    )
    return F.regexp_replace(told, "<image [2-7]>", "")


def first_image_tags(q: Column) -> Column:
    """Struct (prompt, images): one occurrence per mention becomes the image token, in order."""
    numbers = F.regexp_extract_all(q, F.lit(r"<image (\d+)"), F.lit(1))

    def once(text, n):
        tag = F.concat(F.lit("<image "), n, F.lit(">"))
        at = F.instr(text, tag)
        swapped = F.concat(
            F.substring(text, F.lit(1), at - 1),
            F.lit(IMAGE_TOKEN),
            F.substring(text, at + F.length(tag), F.length(text)),
        )
        return F.when(at > 0, swapped).otherwise(text)

    return F.struct(
        F.aggregate(numbers, q, once).alias("prompt"), numbers.cast("array<int>").alias("images")
    )


def normalize_chat(df: DataFrame) -> DataFrame:
    """Adds ``messages``, ``picked`` images and ``error`` from (texts, images).

    human/gpt become user/assistant under a system line; numbered tags become image tokens and
    order the images; one image serves all tags; without images tags go; missing tags lead the
    first user turn; more tags than images, or an unknown speaker, is an error.
    """
    user = F.filter("texts", lambda m: m["from"] == "human")
    numbers = F.flatten(
        F.transform(
            user, lambda m: F.regexp_extract_all(m["value"], F.lit(r"<image-(\d+)>"), F.lit(1))
        )
    ).cast("array<int>")
    rows = df.withColumn("__ids", numbers)
    token = F.lit(IMAGE_TOKEN)
    named = F.transform(
        "texts",
        lambda m: F.struct(
            F.when(m["from"] == "human", "user").when(m["from"] == "gpt", "assistant").alias("role"),
            F.when(m["from"] == "human", F.regexp_replace(m["value"], r"<image-\d+>", IMAGE_TOKEN))
            .otherwise(m["value"])
            .alias("content"),
        ),
    )
    rows = rows.withColumn("__m", named)
    tags = F.aggregate(
        F.filter("__m", lambda m: m["role"] == "user"),
        F.lit(0),
        lambda a, m: a
        + (
            (F.length(m["content"]) - F.length(F.replace(m["content"], token, F.lit(""))))
            / F.lit(len(IMAGE_TOKEN))
        ).cast("int"),
    )
    rows = rows.withColumn("__t", tags)
    ordered = F.when(
        F.size("__ids") > 0, F.transform("__ids", lambda i: F.get("images", i - 1))
    ).otherwise(F.col("images"))
    rows = rows.withColumn("__i", ordered)
    rows = rows.withColumn(
        "picked",
        F.when(
            (F.size("__i") == 1) & (F.col("__t") > 1),
            F.flatten(F.array_repeat(F.col("__i"), F.col("__t"))),
        ).otherwise(F.col("__i")),
    )
    none = F.size("picked") == 0
    short = F.size("picked") - F.when(none, 0).otherwise(F.col("__t"))
    first_user = F.array_position(F.transform("__m", lambda m: m["role"] == "user"), True)
    rows = rows.withColumn("__short", short).withColumn("__first", first_user)
    told = F.transform(
        "__m",
        lambda m, i: F.struct(
            m["role"].alias("role"),
            F.when(
                (F.size("picked") == 0) & (m["role"] == "user"),
                F.replace(m["content"], token, F.lit("")),
            )
            .when(
                (F.col("__short") > 0) & (i + 1 == F.col("__first")),
                F.concat(F.repeat(token, F.col("__short")), F.lit("\n"), m["content"]),
            )
            .otherwise(m["content"])
            .alias("content"),
        ),
    )
    system = F.struct(F.lit("system").alias("role"), F.lit(ANSWER_IT).alias("content"))
    error = (
        F.when(F.exists("texts", lambda m: ~m["from"].isin("human", "gpt")), "unexpected role")
        .when(F.exists("picked", lambda x: x.isNull()), "no such image")
        .when(F.col("__short") < 0, "more image tags than images")
    )
    return (
        rows.withColumn("error", error)
        .withColumn("messages", F.when(F.col("error").isNull(), F.concat(F.array(system), told)))
        .drop("__ids", "__m", "__t", "__i", "__short", "__first")
    )


def numbered_examples(df: DataFrame, order: str) -> DataFrame:
    """Adds ``idx`` per subject in the given order."""
    ids = ranged_running(df.select("subject", order), [order], within=["subject"], out="idx")
    return df.join(ids, ["subject", order])
