"""Main text of hand-made pages."""

import pytest

from weft.llm import html

LONG = "This is the text of the article and it was written by one of the people who have been there for a long time."
MORE = "That is what they said to us when we were on the way to the house, and so it is with all of the others."


def page(between):
    return f"<html><body><article><p>{LONG}</p>{between}<p>{MORE}</p></article></body></html>"


def read(source):
    return [t for t, *_ in html.blocks(source)]


@pytest.mark.parametrize("tag", ["svg", "math"])
def test_self_closed_is_empty(tag):
    for mark in (f"<{tag}/>", f'<{tag} width="1" class="x" />', f"<{tag.upper()} viewBox='0 0 > 1'/>"):
        assert read(page(mark)) == [LONG, MORE]
    assert read(page(f"<{tag}/>") + f"<p>more</p><{tag}>drawn</{tag}>") == [LONG, MORE, "more"]


@pytest.mark.parametrize("tag", ["object", "audio", "video", "canvas", "svg", "math"])
def test_embedded_goes_up_to_its_closing_tag(tag):
    assert read(page(f"<{tag} a='1'><p>fallback</p></{tag.upper()} >")) == [LONG, MORE]
    assert read(page(f"<{tag} a='1'>")) == [LONG, MORE]
    assert read(page(f"</{tag}>")) == [LONG, MORE]
    assert read(page(f"<{tag}>in</{tag}>") + f"<{tag}><p>end</p>") == [LONG, MORE, "end"]


@pytest.mark.parametrize("tag", ["object", "audio", "video", "canvas"])
def test_self_closed_means_nothing_elsewhere(tag):
    assert read(page(f"<{tag}/>fallback</{tag}>")) == [LONG, MORE]


@pytest.mark.parametrize("tag", ["script", "style", "noscript", "template", "iframe", "xmp", "noembed", "noframes"])
def test_raw_runs_to_the_end(tag):
    assert read(page(f"<{tag}>")) == [LONG]
    assert read(page(f"<{tag}/>")) == [LONG]
    assert read(page(f"<{tag}><p>no</p></{tag}>")) == [LONG, MORE]


def test_many_unclosed_take_one_search():
    assert read("<video>" * 100_000 + LONG) == [LONG]


OUT = "There is a lot that the people who read this have to say about it, and they are saying it in the room below."


def whole(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Title of the page and of the site that it is on</title>{head}</head><body>{body}</body></html>"


ARTICLE = f"<article><header><h1>Heading</h1></header><p>{LONG}</p><p>Short one.</p><p>{MORE}</p></article>"
TEXT = f"Heading\n{LONG}\nShort one.\n{MORE}"

PAGES = {
    "plain": (whole(f"<nav><a href='/'>Home</a></nav>{ARTICLE}<footer>© the owners of this and of all that is in it</footer>"), TEXT),
    "wrapper by name": (whole(f"<div class='page no-sidebar'>{ARTICLE}</div>"), TEXT),
    "wrapper that is a name": (whole(f"<div class='sidebar'>{ARTICLE}</div>"), TEXT),
    "page in a form": (whole(f"<form id='aspnetForm' method='post'><nav><a>Home</a></nav>{ARTICLE}<div class='comments'><p>{OUT}</p></div></form>"), TEXT),
    "page in a form without an article": (whole(f"<form id='f'><div><p>{LONG}</p><p>{MORE}</p></div><div id='comment-list'><p>{OUT}</p></div></form>"), f"{LONG}\n{MORE}"),
    "two wrappers": (whole(f"<form><div class='widget'><p>{LONG}</p><div class='share'><p>{OUT}</p></div></div></form>"), LONG),
    "names inside an article": (
        whole(
            f"<article><div class='side-by-side'><p>{LONG}</p></div><div id='legal-history'><p>{MORE}</p></div>"
            f"<div class='reply-to-critics'><p>{LONG}</p></div><div class='search-results-explained'><p>{MORE}</p></div></article>"
        ),
        f"{LONG}\n{MORE}\n{LONG}\n{MORE}",
    ),
    "comments, notices, adverts, forms": (
        whole(
            f"<div class='cookie-banner'><p>{OUT}</p></div>{ARTICLE}<section class='comments'><p>{OUT}</p></section><div class='ad-slot'><p>{OUT}</p></div>"
            f"<div class='newsletter signup'><p>{OUT}</p></div><form><p>{OUT}</p></form><aside><p>{OUT}</p></aside><div hidden><p>{OUT}</p></div>"
            f"<script>var a = '<p>{OUT}</p>';</script><style>p {{ }}</style>"
        ),
        TEXT,
    ),
    "teasers of other articles": (whole(f"{ARTICLE}<div class='sidebar'><article><p>{OUT}</p></article></div>"), TEXT),
    "no article element": (whole(f"<div class='menu'><a>One</a> <a>Two</a></div><div><p>{LONG}</p><p>Short one.</p><p>{MORE}</p></div><p><a>{OUT}</a></p>"), f"{LONG}\nShort one.\n{MORE}"),
    "references and white space": (whole(f"<article><p>  Fish &amp; chips\n\t&lt;b&gt; caf&eacute; &#8212;\xa0it is the one that was  there for all of the people of the town </p></article>"),
                                   "Fish & chips <b> café — it is the one that was there for all of the people of the town"),
    "empty": ("", ""),
    "only menus": (whole("<nav><a>Home</a></nav>"), ""),
}


def test_whole_query(spark):
    """Every hand-made page, repeated and null ones, with columns whose names clash."""
    given = [(i, f"u{i}", page_html, "t", 3) for i, (page_html, _) in enumerate(PAGES.values())]
    given += [(0, None, given[0][2], "t", 3), (None, "x", None, None, None)]
    df = spark.createDataFrame(given, "page_id bigint, url string, html string, text string, n_chars int")
    out = html.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    texts = [want for _, want in PAGES.values()]
    want = [(i, f"u{i}", t, len(t)) for i, t in enumerate(texts)] + [(0, None, texts[0], len(texts[0])), (None, "x", "", 0)]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
    assert html.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("made", ["<div>" * 200_000, "<span>" * 100_000 + "</b>" * 100_000, "<div class='menu'>" * 60_000, "<p>a" * 200_000, "<form><article>" * 60_000])
def test_a_megabyte_of_open_tags_is_linear(made):
    import time

    html.main_text(made[: len(made) // 4])
    began = time.process_time()
    html.main_text(made)
    assert time.process_time() - began < 8
