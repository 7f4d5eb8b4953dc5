"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.draws import bind

# The characters a Unicode-aware strip removes.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: Runs of them, as few ranges: every range is tried on every character.
WHITE_RUN = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
END_OF_TEXT = "<|endoftext|>"
SLICE_CHARS = 1_000_000
#: A character, runs without an end, an end mark with white space behind it; or the rest.  Possessive, so that a text is
#: walked once and without a stack.
SENTENCE = r"[\s\S](?:[^.!?]++|[.!?]++(?!\s|\z))*+[.!?]++(?:\s+|\z)|[\s\S]+\z"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column, chars: str = WHITE) -> Column:
    return F.btrim(col(c), F.lit(chars))


#: What is read as a number: decimal digits with an optional exponent, or a name of no finite number.
NUMBER = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan|inf|infinity)$"


def to_number(c: str | Column) -> Column:
    """Double of a text that is a number and nothing else, else null; type suffixes are no digits."""
    return bind(strip(c), lambda bare: F.when(bare.rlike(NUMBER), bare.try_cast("double")))


def words(c: str | Column) -> Column:
    """Split on runs of white space, without empty ends."""
    none = F.array().cast("array<string>")
    return bind(strip(c), lambda s: F.when(s == "", none).otherwise(F.split(s, WHITE_RUN)))


def flat(c: str | Column) -> Column:
    """The words joined by single blanks."""
    return F.btrim(F.regexp_replace(col(c), WHITE_RUN, " "))


def rfind(text: Column, needle: Column) -> Column:
    """0-based position of the last occurrence, -1 when there is none."""
    at = F.instr(F.reverse(text), F.reverse(needle))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - at + 1 - F.length(needle))


def split_sentences(c: str | Column, keep_newlines: bool = False) -> Column:
    """Sentences of a text, cut first in slices of a million characters.

    A sentence ends at ``.``, ``!`` or ``?`` followed by white space.  With
    ``keep_newlines`` the white space stays, so the parts concatenate to the text.
    """
    text = col(c)
    n_slices = F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(float(SLICE_CHARS))).cast("int"))
    slices = F.transform(
        F.sequence(F.lit(0), n_slices - 1),
        lambda i: F.substring(text, i * SLICE_CHARS + 1, F.lit(SLICE_CHARS)),
    )
    parts = F.flatten(
        F.transform(slices, lambda s: F.regexp_extract_all(s, F.lit(SENTENCE), F.lit(0)))
    )
    if keep_newlines:
        return parts
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != "")


def clean_text(c: str | Column) -> Column:
    """White space to single blanks, then `` . `` to ``. `` three times over."""
    out = F.regexp_replace(col(c), WHITE_RUN, " ")
    for _ in range(3):
        out = F.replace(out, F.lit(" . "), F.lit(". "))
    return out


def clip_utf8(c: str | Column, max_bytes: int = 20480) -> Column:
    """Longest prefix of at most ``max_bytes`` UTF-8 bytes that ends on a character; blank is null."""
    text = F.replace(col(c), F.lit(END_OF_TEXT), F.lit(""))
    raw = F.encode(text, "utf-8")
    cuts = [
        F.try_validate_utf8(F.substring(raw, 1, max_bytes - back).cast("string"))
        for back in range(4)
    ]
    return F.when(strip(text) == "", F.lit(None)).otherwise(F.coalesce(*cuts))


def split_reasoning(c: str | Column) -> Column:
    """Struct (rest, reasoning) around the first ``<think>...</think>``; opener may be missing."""
    text = col(c)
    open_at = F.instr(text, "<think>")
    before = F.when(open_at > 0, F.substring(text, F.lit(1), open_at - 1)).otherwise(F.lit(""))
    after = F.when(open_at > 0, F.substring(text, open_at + 7, F.length(text))).otherwise(text)
    close_at = F.instr(after, "</think>")
    has = F.contains(text, F.lit("</think>")) & (close_at > 0)
    return F.struct(
        F.when(has, F.concat(before, F.substring(after, close_at + 8, F.length(after))))
        .otherwise(text)
        .alias("rest"),
        F.when(has, F.substring(after, F.lit(1), close_at - 1)).alias("reasoning"),
    )


# The tagged function-call notation and the type names of its schemas.
CALL_BLOCK = r"(?s)<tool_call>(.*?)</tool_call>|<tool_call>(.*?)\z"
FUNCTION_BLOCK = r"(?s)<function=(.*?)</function>|<function=(.*)\z"
PARAMETER = r"(?s)<parameter=(.*?)(?:</parameter>|(?=<parameter=)|(?=</function>)|\z)"
TEXT_TYPES = ["string", "str", "text", "varchar", "char", "enum"]
INT_TYPES = "^(int|uint|long|short|unsigned).*"
NUMBER_TYPES = "^(num|float).*"
BOOL_TYPES = ["boolean", "bool", "binary"]
JSON_TYPES = "^(object$|array$|arr$|dict.*|list.*)"


def _either_group(text: Column, pattern: str) -> Column:
    first = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(first, second, lambda a, b: F.when(a != "", a).otherwise(b))


def extract_tool_calls(
    df: DataFrame, text: str, tools: dict[str, dict[str, str]], key: str
) -> DataFrame:
    """One row per call parameter (null parameter for a call without any).

    ``tools`` maps function to parameter to declared type.  A missing closing tag at the
    end of the text is accepted, the last value of a repeated parameter counts, and values
    are returned as JSON text of the declared type.
    """
    source = F.col(text)
    tagged = _either_group(source, CALL_BLOCK)
    blocks = F.when(F.size(tagged) > 0, tagged).otherwise(F.array(source))
    calls = F.flatten(F.transform(blocks, lambda b: _either_group(b, FUNCTION_BLOCK)))
    named = F.filter(calls, lambda c: F.contains(c, F.lit(">")))
    tag_at, fn_at = F.instr(source, "<tool_call>"), F.instr(source, "<function=")
    cut = F.when(tag_at > 0, tag_at).otherwise(fn_at) - 1
    rows = df.select(
        key,
        F.when(cut > 0, F.substring(source, F.lit(1), cut)).alias("content"),
        F.posexplode(named).alias("call_no", "__call"),
    )
    stop = F.instr(F.col("__call"), ">")
    rows = rows.select(
        key,
        "content",
        "call_no",
        F.substring(F.col("__call"), F.lit(1), stop - 1).alias("function"),
        F.substring(F.col("__call"), stop + 1, F.length("__call")).alias("__body"),
    )
    raw = F.filter(
        F.regexp_extract_all(F.col("__body"), F.lit(PARAMETER), F.lit(1)),
        lambda p: F.contains(p, F.lit(">")),
    )
    rows = rows.select(
        key, "content", "call_no", "function", F.posexplode_outer(raw).alias("__no", "__raw")
    )
    mark = F.instr(F.col("__raw"), ">")
    value = F.substring(F.col("__raw"), mark + 1, F.length("__raw"))
    value = F.regexp_replace(F.regexp_replace(value, r"\A\n", ""), r"\n\z", "")
    rows = rows.select(
        key,
        "content",
        "call_no",
        "function",
        "__no",
        F.substring(F.col("__raw"), F.lit(1), mark - 1).alias("parameter"),
        value.alias("raw"),
    )
    last = rows.groupBy(key, "content", "call_no", "function", "parameter").agg(
        F.max_by("raw", "__no").alias("raw")
    )
    pairs = [(f"{f}\n{p}", t.strip().lower()) for f, ps in tools.items() for p, t in ps.items()]
    types = (
        F.create_map(*[F.lit(x) for pair in pairs for x in pair])
        if pairs
        else F.create_map().cast("map<string,string>")
    )
    declared = F.try_element_at(types, F.concat_ws("\n", "function", "parameter"))
    return last.withColumn("value", typed_json(F.col("raw"), declared))


def typed_json(raw: Column, declared: Column) -> Column:
    """JSON text of ``raw`` under a declared type; unparsable values stay strings."""
    quoted = F.to_json(F.array(raw))
    as_string = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    whole = strip(raw).try_cast("bigint").cast("string")
    number = to_number(raw)
    number_text = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(
        number.cast("string")
    )
    parsed = F.to_json(F.try_parse_json(raw))
    return (
        F.when(raw.isNull(), F.lit(None))
        .when(F.lower(raw) == "null", F.lit("null"))
        .when(declared.isNull() | declared.isin(TEXT_TYPES), as_string)
        .when(declared.rlike(INT_TYPES), F.coalesce(whole, as_string))
        .when(declared.rlike(NUMBER_TYPES), F.coalesce(number_text, as_string))
        .when(
            declared.isin(BOOL_TYPES),
            F.when(F.lower(raw) == "true", F.lit("true")).otherwise(F.lit("false")),
        )
        .when(declared.rlike(JSON_TYPES), F.coalesce(parsed, as_string))
        .otherwise(F.coalesce(parsed, as_string))
    )


def extract_answer(c: str | Column) -> Column:
    r"""``\answer{}`` first, then ``\boxed{}``, else the text with a blank after ``Answer:``."""
    text = col(c)
    tagged = r"(?s)\\answer\{(.*?)\}"
    boxed = r"(?s)\\boxed\{(.*?)\}"
    return (
        F.when(text.rlike(tagged), F.regexp_extract(text, tagged, 1))
        .when(text.rlike(boxed), F.regexp_extract(text, boxed, 1))
        .otherwise(F.replace(text, F.lit("Answer:"), F.lit("Answer: ")))
    )


# Characters removed around a choice, and phrases that lead to an open answer.
CHOICE_PUNCTUATION = [",", ".", "!", "?", ";", ":", "'"]
KEY_PHRASES = [
    "could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result ",
]
NUMBER_COMMAS = r"-?\b\d{1,3}(?:,\d{3})+\b"
NUMBER_SCIENTIFIC = r"-?\d+(?:\.\d+)?[eE][+-]?\d+"
NUMBER_SIMPLE = r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])"


def parse_choice(response: Column, choices: Column, options: Column) -> Column:
    """Letter meant by a free response; ``options`` maps letter to option text.

    Bracketed letters count first, then free-standing ones, then option texts in answers of
    more than five words.  Of several the last mention wins, of none the first choice.
    """
    text = response
    for ch in CHOICE_PUNCTUATION:
        text = strip(text, ch)

    def last_of(found: Column, needle) -> Column:
        # positions ascend in the array order, so the first maximum is kept as argmax does
        ranked = F.transform(
            found, lambda c, i: F.struct(needle(c).alias("at"), (-i).alias("no"), c.alias("c"))
        )
        return F.array_max(ranked)["c"]

    def by_brackets(text: Column) -> Column:
        bracketed = F.filter(
            choices,
            lambda c: F.contains(text, F.concat(F.lit("("), c, F.lit(")")))
            | F.contains(text, F.concat(c, F.lit(")"))),
        )
        last = lambda found: last_of(found, lambda c: rfind(text, F.concat(F.lit("("), c, F.lit(")"))))
        return bind(bracketed, lambda found: F.when(F.size(found) > 0, last(found)).otherwise(by_letters(text)))

    def by_letters(text: Column) -> Column:
        free = F.filter(choices, lambda c: F.contains(text, F.concat(F.lit(" "), c, F.lit(" "))))
        last = lambda found: last_of(found, lambda c: rfind(text, F.concat(F.lit(" "), c, F.lit(" "))))
        return bind(free, lambda found: F.when(F.size(found) > 0, last(found)).otherwise(by_options(text)))

    def by_options(text: Column) -> Column:
        told = lambda low: F.filter(
            F.map_keys(options), lambda c: F.contains(low, F.lower(F.element_at(options, c)))
        )
        last = lambda low, found: last_of(found, lambda c: rfind(low, F.lower(F.element_at(options, c))))
        found_in = lambda low: bind(
            told(low), lambda found: F.when(F.size(found) > 0, last(low, found)).otherwise(F.element_at(choices, 1))
        )
        return F.when(F.size(words(text)) > 5, bind(F.lower(text), found_in)).otherwise(F.element_at(choices, 1))

    return bind(F.concat(F.lit(" "), text, F.lit(" ")), by_brackets)


def extract_numbers(text: Column) -> Column:
    """Numbers in comma, scientific and plain notation, in that order."""
    return F.concat(
        *[
            F.regexp_extract_all(text, F.lit(p), F.lit(0))
            for p in (NUMBER_COMMAS, NUMBER_SCIENTIFIC, NUMBER_SIMPLE)
        ]
    )


def normalize_answer(text: Column) -> Column:
    """Array of comparable forms: a number rounded to 2, or lower text (one character padded)."""

    def forms(v):
        low = v["low"]
        return (
            F.when(v["number"].isNotNull(), F.array(F.bround(v["number"], 2).cast("string")))
            .when(
                F.length(low) == 1,
                F.array(F.concat(F.lit(" "), low), F.concat(low, F.lit(" "))),
            )
            .otherwise(F.array(low))
        )

    number = lambda s: to_number(F.replace(s, F.lit(","), F.lit("")))
    return bind(strip(text), lambda s: bind(F.struct(number(s).alias("number"), F.lower(s).alias("low")), forms))


def parse_open(c: str | Column) -> Column:
    """Distinct normalised candidates of an open answer, sorted."""
    # one strip of white space, one of dots, then lower case; sentences are cut at newlines
    # only, because after lower-casing no capital can follow a dot
    def shortest(line: Column, phrases: Column) -> Column:
        # one value per phrase: an explicit literal list instead of a lambda variable, as the
        # split pattern must be quoted per phrase
        hit = F.filter(phrases, lambda p: F.contains(line, p))
        size, turned = F.length(line), F.reverse(line)
        # what stands behind the last mention: as many characters as stand before it in the turned line
        behind = lambda v, p: F.substring(line, v["size"] - F.instr(v["turned"], F.reverse(p)) + 2, v["size"])
        tails = bind(
            F.struct(size.alias("size"), turned.alias("turned")),
            lambda v: F.transform(hit, lambda p: strip(behind(v, p))),
        )
        # an empty tail is replaced by the next phrase's, a shorter later tail wins
        return F.aggregate(
            tails,
            F.lit("").cast("string"),
            lambda best, t: F.when((best == "") | (F.length(t) < F.length(best)), t).otherwise(best),
        )

    phrases = F.array(*[F.lit(p) for p in KEY_PHRASES])
    with_equals = F.array(*[F.lit(p) for p in [*KEY_PHRASES, "="]])
    def keyed(lines: Column) -> Column:
        last = F.size(lines) - 1
        tails = F.transform(
            lines,
            lambda line, i: F.when(i == last, shortest(line, with_equals)).otherwise(shortest(line, phrases)),
        )
        return F.filter(tails, lambda k: (k != "") & ~k.isin(CHOICE_PUNCTUATION))

    def candidates(found: Column) -> Column:
        everything = F.concat(found, F.flatten(F.transform(found, extract_numbers)))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(everything, normalize_answer))))

    def of_text(text: Column) -> Column:
        or_text = lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(text))
        return bind(bind(bind(F.split(text, "\n"), keyed), or_text), candidates)

    return bind(F.lower(strip(strip(c), ".")), of_text)


def tidy_number(c: str | Column) -> Column:
    """Cut to two decimals, all-zero decimals dropped, ``%`` and one trailing dot removed."""
    decimals = r"^(\d+)\.(\d+)$"

    def cut(text):
        whole, rest = F.regexp_extract(text, decimals, 1), F.regexp_extract(text, decimals, 2)
        return (
            F.when(~text.rlike(r"^\d+\.\d+$"), text)
            .when(rest.rlike("^0+$"), whole)
            .otherwise(F.concat(whole, F.lit("."), F.substring(rest, 1, 2)))
        )

    return F.regexp_replace(F.replace(bind(col(c), cut), F.lit("%"), F.lit("")), r"\.\z", "")


def numeric_answer(c: str | Column) -> Column:
    """Number of ``answer is N`` in texts that hold letters and no ``e+``."""

    def number(text):
        found = F.regexp_extract(text, r"answer is (-*\d+\.*\d*)", 1)
        return F.when(
            text.rlike("[a-zA-Z]") & ~F.contains(text, F.lit("e+")) & (found != ""), found
        ).otherwise(text)

    return bind(col(c), number)


# Fixed values of the published visual-question-answering text normalisation.
VQA_PUNCTUATION = [
    ";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`",
    ",", "?", "!",
]
VQA_ARTICLES = ["a", "an", "the"]
VQA_NUMBERS = {
    "none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
}
# The contraction table of the published VQA metric, spelling as written by its annotators
# and the form that takes its place. Keys with a capital never meet a lower-cased word.
VQA_CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't",
    "couldn'tve": "couldn't've", "couldnt've": "couldn't've", "didnt": "didn't", "doesnt": "doesn't",
    "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't",
    "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd",
    "howll": "how'll", "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've",
    "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's",
    "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've",
    "mightve": "might've", "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't", "notve": "not've",
    "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at",
    "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've",
    "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've",
    "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've",
    "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's", "somethingd": "something'd",
    "somethingd've": "something'd've", "something'dve": "something'd've", "somethingll": "something'll",
    "thats": "that's", "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've",
    "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've",
    "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't",
    "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've", "werent": "weren't", "whatll": "what'll",
    "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd",
    "wheres": "where's", "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've",
    "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's",
    "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've",
    "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll",
    "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd",
    "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}


def vqa_normalize(c: str | Column) -> Column:
    """Punctuation, digit-word, article and contraction rules of the published VQA metric."""
    swaps = {**VQA_NUMBERS, **VQA_CONTRACTIONS}
    table = F.create_map(*[F.lit(x) for pair in swaps.items() for x in pair])

    def without_punctuation(v):
        out = v["text"]
        for p in VQA_PUNCTUATION:
            beside_blank = F.contains(v["text"], F.lit(p + " ")) | F.contains(v["text"], F.lit(" " + p))
            # one reference to the running text per step keeps the expression linear
            out = F.replace(
                out, F.lit(p), F.when(v["inner_comma"] | beside_blank, F.lit("")).otherwise(F.lit(" "))
            )
        return F.regexp_replace(out, r"\.(?!\d)", "")

    looked_at = lambda text: F.struct(text.alias("text"), text.rlike(r"\d,\d").alias("inner_comma"))
    plain = bind(
        bind(strip(F.translate(col(c), "\n\t", "  ")), looked_at), without_punctuation
    )
    kept = F.filter(words(F.lower(plain)), lambda w: ~w.isin(VQA_ARTICLES))
    return F.array_join(
        F.transform(kept, lambda w: F.when(w.isin(list(swaps)), F.try_element_at(table, w)).otherwise(w)), " "
    )
