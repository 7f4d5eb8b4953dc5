"""Main text of HTML pages by two passes of block rules.

A page is cut in blocks at block-level tags.  Blocks in containers that hold no article text by their
tag or name (navigation, headers, footers, sidebars, notices, adverts, forms, reader comments) are out.  A name counts if all
its parts say so: ``comment-list`` does, ``no-sidebar`` and ``legal-history`` don't.  A form or a named container around the whole
article is a wrapper and is opened: where no article element lies outside of such containers, those that hold one, else, as long as no
block outside passes the first pass, the outermost ones that hold a block that does.

First pass: a block with mostly link text is out; a block that is long enough and has enough stop words
of the four languages is in; a long block of few stop words outside an article element is out; all others
are ambiguous.  Second pass: an ambiguous block takes the label of its nearest decided neighbours
in the same region (the article element, or the page outside of it): both agreeing, or the nearer one,
in if they are equally near.  Without decided neighbours it is in inside an article, else out.

Character references are decoded after the markup is taken off.  White space inside a block, line
breaks included, becomes one space.  Null and empty pages, and pages without a block that is in, give
an empty text.  Repeated pages are extracted each; null ids and addresses are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import slices

LONG = 60
DENSE = 0.12
LINKED = 0.5

STOP_WORDS = frozenset(
    """
    the of and to in a is that it was for on are as with be by this from or an at not have had but they which you
    were her all she there would their we him been has when who will more no if out so what up said its about than
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat
    dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis
    de la le les et des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui
    nous comme mais on elle aux leur cette ses été sa y deux même tout fait
    el los las del y que por con una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando
    todo esta ser son dos también fue había era muy hasta desde está mi porque qué sólo han yo hay vez puede todos
    así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada
    """.split()
)

BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section
    summary table tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_BREAKS = frozenset(["br", "wbr"])
#: Containers that never hold article text.
OUTSIDE = frozenset("head title nav footer aside form menu dialog button select textarea fieldset legend label".split())
INSIDE = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a container's class or id that say the same.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox banner banners sponsor sponsored sponsors promo promos
    promotion sidebar sidebars side widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay
    newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies
    respond disqus discussion menu menus nav navbar navigation breadcrumb breadcrumbs footer footers pagination pager
    related recommended recommendations copyright legal disclaimer search toolbar masthead topbar""".split()
)
#: Parts of names that say nothing by themselves.
FILLERS = frozenset(
    """area bar block box body bottom col column container content element footer global group header inner item items js left links
    list main outer page panel post posts primary right row secondary section site slot small stories top unit wrap wrapper zone""".split()
)
#: Containers by tag that may be a wrapper.
WRAPPERS = frozenset(["form", "fieldset"])
#: The same, unless the container is inside an article.
WEAK_NAMES = frozenset(["header", "headers"])

#: These hold no article text; unclosed, they run to the end of the page.
_RAW = "script|style|noscript|template|iframe|xmp|noembed|noframes"
#: These hold none up to their closing tag; without one, only the tag itself goes.
EMBEDDED = frozenset("object svg math canvas audio video".split())
#: Empty if self-closed.
FOREIGN = frozenset(["svg", "math"])
_CLOSED = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in EMBEDDED}
_TOKEN = re.compile(
    rf"""<!--.*?(?:--!?>|\Z)
    |<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>
    |<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)
    |<[!?/][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"\w+")


def _outside(tag: str, attributes: str, inside: bool) -> str:
    """Why a container holds no article text: by its ``tag``, by its ``name``, or not at all (empty)."""
    if tag in OUTSIDE or (tag == "header" and not inside):
        return "name" if tag in WRAPPERS else "tag"
    if tag in ("body", "html", *INSIDE) or not attributes.strip():
        return ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" and not m[2]:
            return "tag"
        if name == "role" and value in ROLES:
            return "name"
        if name == "style" and "display:none" in value.replace(" ", ""):
            return "tag"
        if name in ("class", "id"):
            known = NAMES if inside else NAMES | WEAK_NAMES
            for word in value.split():
                parts = set(re.split(r"[^a-z]+", word)) - {""}
                if parts & known and parts <= known | FILLERS:
                    return "name"
    return ""


@dataclass
class Container:
    """A container that is out unless it turns out to be a wrapper; ``parent`` is the next one around it."""

    parent: int
    named: bool
    holds_article: bool = False
    opened: bool = False


def _passes(text: str, linked: int) -> bool | None:
    """The first pass over a block by itself: in, out (by its links) or, undecided, None."""
    length = len(text.replace(" ", ""))
    if linked > LINKED * length:
        return False
    if length < LONG:
        return None
    words = [w.lower() for w in _WORD.findall(text)]
    return True if sum(w in STOP_WORDS for w in words) >= DENSE * max(len(words), 1) else None


def _open_wrappers(containers: list[Container], found: list[tuple[str, int, int, bool]], article_outside: bool) -> None:
    """Mark the named containers that hold the article."""
    if article_outside:
        return
    if any(c.holds_article and c.named for c in containers):
        for c in containers:
            c.opened = c.named and c.holds_article
        return
    passing = [at for text, linked, at, _ in found if _passes(text, linked)]

    def outermost(at: int) -> int:
        """The outermost container around that is not open, or -1."""
        last = -1
        while at >= 0:
            if not containers[at].opened:
                last = at
            at = containers[at].parent
        return last

    while passing:
        around = {outermost(at) for at in set(passing)}
        wrappers = [c for c in around if c >= 0 and containers[c].named]
        if -1 in around or not wrappers:
            return
        for c in wrappers:
            containers[c].opened = True
        passing = [at for at in passing if outermost(at) not in around or outermost(at) == -1]


def blocks(html: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters inside links, out by its container, in an article) in page order."""
    found: list[tuple[str, int, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, its container or -1, article
    counts: Counter[str] = Counter()  # of each tag on the stack
    containers: list[Container] = []
    around = -1  # innermost container
    pieces: list[str] = []
    linked: list[str] = []
    article = 0
    article_outside = False

    def close_block() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                found.append((text, len("".join(unescape("".join(linked)).split())), around, article > 0))
        pieces, linked = [], []

    def pop() -> None:
        nonlocal around, article
        tag, container, was_article = stack.pop()
        counts[tag] -= 1
        if container >= 0:
            around = containers[container].parent
        article -= was_article

    def text(piece: str) -> None:
        if piece:
            pieces.append(piece)
            if counts["a"]:
                linked.append(piece)

    at = 0
    unclosed: set[str] = set()  # embedded elements with no closing tag from here on
    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag in INLINE_BREAKS:
            text(" ")
            continue
        if tag in EMBEDDED:
            if not closing and tag not in unclosed and not (tag in FOREIGN and attributes.endswith("/")):
                end = _CLOSED[tag].search(html, at)
                at = end.end() if end else at
                if not end:
                    unclosed.add(tag)
            continue
        block = tag in BLOCKS
        if block:
            close_block()
        if closing:
            if counts[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if block and counts["p"]:  # a paragraph ends where a block begins
            while stack[-1][0] != "p":
                pop()
            pop()
        elif tag in ("li", "a", "option", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
            pop()
        why = _outside(tag, attributes, article > 0)
        is_article = tag in INSIDE
        if is_article:
            article_outside |= around < 0
            c = around
            while c >= 0 and not containers[c].holds_article:
                containers[c].holds_article = True
                c = containers[c].parent
        stack.append((tag, len(containers) if why else -1, is_article))
        counts[tag] += 1
        if why:
            containers.append(Container(around, why == "name"))
            around = len(containers) - 1
        article += is_article
    text(html[at:])
    close_block()
    _open_wrappers(containers, found, article_outside)
    out: list[bool] = []  # a container is out if it or one around it isn't open; parents come first
    for c in containers:
        out.append(not c.opened or (c.parent >= 0 and out[c.parent]))
    return [(t, n, c >= 0 and out[c], a) for t, n, c, a in found]


def labels(found: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """Which blocks are in."""
    decided: list[bool | None] = []
    for text, linked, out, article in found:
        verdict = False if out else _passes(text, linked)
        if verdict is None and not article and len(text.replace(" ", "")) >= LONG:
            verdict = False
        decided.append(verdict)
    result = [bool(d) for d in decided]
    region = [(a and not o) for _, _, o, a in found]
    # nearest decided block of the same region, before and behind
    before: list[tuple[int, bool] | None] = []
    behind: list[tuple[int, bool] | None] = [None] * len(found)
    last: dict[bool, tuple[int, bool]] = {}
    for i, d in enumerate(decided):
        before.append(last.get(region[i]))
        if d is not None:
            last[region[i]] = (i, d)
    last = {}
    for i in reversed(range(len(found))):
        behind[i] = last.get(region[i])
        if decided[i] is not None:
            last[region[i]] = (i, decided[i])
    for i, d in enumerate(decided):
        if d is None:
            near = [x for x in (before[i], behind[i]) if x]
            if not near:
                result[i] = region[i]
            else:
                least = min(abs(i - j) for j, _ in near)
                result[i] = any(good for j, good in near if abs(i - j) == least)
    return result


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return "\n".join(text for (text, *_), good in zip(found, labels(found)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``page_id, url, html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
