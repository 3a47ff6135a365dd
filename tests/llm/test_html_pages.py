"""Pages of many layouts with the text that a reader would take for the article, and the query over whole tables."""

from pathlib import Path

import pytest

from foliant.llm import queries
from foliant.llm.html_text import extract, main_text

from .helpers import SF

LONG = "The harbour wall was built in two years and has stood for ninety, through every storm that the coast has known since."
MORE = "Nobody recalls who laid the first stone, but the ledger of the quarry names forty men and the wages that each of them drew."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul>'


def page(content, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}{content}{after}<script>var a = '<p>no</p>';</script></body></html>"


PAGES = {
    "article element": (page(f"<article><h1>Wall</h1><p>{LONG}</p><p>{MORE}</p></article>", f"<nav>{MENU}</nav>", "<footer>&copy; us</footer>"), ["Wall", LONG, MORE]),
    "short paragraphs stay": (page(f"<article><h1>Wall</h1><p>{LONG}</p><p>Yes.</p><p>{MORE}</p></article>", f"<nav>{MENU}</nav>"), ["Wall", LONG, "Yes.", MORE]),
    "div soup": (page(f'<div class="content"><h1>Wall</h1><p>{LONG}</p><p>{MORE}</p></div>', f'<div class="top">{MENU}</div>', f'<div class="links">{MENU}</div>'), ["Wall", LONG, MORE]),
    "title beside the text": (page(f"<div><h1>Wall</h1><div><p>{LONG}</p><p>{MORE}</p></div></div>", f"<div>{MENU}</div>"), ["Wall", LONG, MORE]),
    "hint words in a content class": (page(f'<div class="post share-open has-sidebar"><p>{LONG}</p><p>{MORE}</p></div>', f'<div class="menu">{MENU}</div>'), [LONG, MORE]),
    "related links in the article": (page(f'<article><p>{LONG}</p><div class="related"><p>Read <a href="/x">more of it</a></p></div><p>{MORE}</p></article>'), [LONG, MORE]),
    "long comments": (page(f"<article><p>{LONG}</p><p>{MORE}</p></article>", after='<div id="comments">' + f"<div class='comment-body'><p>{MORE} I think so. {LONG}</p></div>" * 9 + "</div>"), [LONG, MORE]),
    "comments as nested articles": (page(f'<article><p>{LONG}</p><section class="comments"><article class="c"><p>I agree with that</p></article></section></article>'), [LONG]),
    "sections": (page(f"<article><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>{MORE}</p></section></article>"), ["One", LONG, "Two", MORE]),
    "two articles, teasers": (page(f"<main><article><p>{LONG}</p><p>{MORE}</p></article><article><a href='/b'><p>Another</p></a></article></main>"), [LONG, MORE]),
    "notice and advert": (page(f'<div class="cookie-notice"><p>We use cookies to give you the best visit that you can have on this page.</p></div><main><p>{LONG}</p><p>{MORE}</p></main><div class="ad">Buy this.</div>'), [LONG, MORE]),
    "header, aside, form": (page(f"<article><p>{LONG}</p><aside>By the way</aside><form><p>Sign up here</p></form><p>{MORE}</p></article>", "<header><h1>The Daily</h1></header>"), [LONG, MORE]),
    "list in the text": (page(f"<article><p>{LONG}</p><ul><li>one</li><li>two</li></ul></article>"), [LONG, "one", "two"]),
    "all bold": (page(f"<article><p><b>{LONG}</b><br>{MORE}</p><p>End.</p></article>"), [f"{LONG} {MORE}", "End."]),
    "all is a menu": (page(f"<nav>{MENU}</nav>"), []),
    "bare text": (f"{LONG}\n<br>\n  {MORE}", [f"{LONG} {MORE}"]),
    "short blocks beside the core": (page(f"<div>{MENU}</div><div><p>A short word before.</p></div><div><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p></div><div><p>And one after.</p></div><div><p>&copy; 2020 us</p></div>"), ["A short word before.", LONG, MORE, LONG, "And one after."]),
    "editorial names in the article": (page(f'<article><p class="alert">Go now.</p><p>{LONG}</p><div class="notice"><p>Mind the step.</p></div></article>', '<div class="notice"><p>We moved.</p></div>'), ["Go now.", LONG, "Mind the step."]),
    "comments by name of the article": (page(f'<article><p>{LONG}</p><article class="comment"><p>{MORE} I agree.</p></article><div class="user-feedback"><p>{MORE} Me too.</p></div><div class="feedback"><p>No.</p></div></article>'), [LONG]),
    "two articles": (page(f"<article><h2>One</h2><p>{LONG}</p><p>{MORE}</p></article><p>between</p><article><h2>Two</h2><p>{MORE}</p></article>"), ["One", LONG, MORE, "Two", MORE]),
    "two articles, the shorter first": (page(f"<article><p>Short.</p></article><article><p>{LONG}</p><p>{MORE}</p></article><article><h3><a href='/c'>Third</a></h3><p>What it is about</p></article>"), ["Short.", LONG, MORE]),
    "beside main": (page(f"<div><p>Our slogan</p></div><main><div><p>Intro.</p></div><div><p>{LONG}</p><p>{MORE}</p></div></main>"), ["Intro.", LONG, MORE]),
    "an end tag of an outer cell": (page(f"<article><i><table><tr><td>one</i> two</td></tr></table></i><p>{LONG}</p></article>"), ["one two", LONG]),
    "references": ("<p>a &lt;b&gt; &amp;amp; &eacute;&#8212;&nbsp;z</p>", ["a <b> &amp; é— z"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    html, blocks = PAGES[name]
    assert main_text(html).split("\n\n") == (blocks or [""])


def test_threshold_acts():
    links = "".join(f'<a href="/{k}">story number {k}</a> and ' for k in range(6))
    html = page(f"<div><div><p>{LONG}</p><p>{MORE}</p></div><div><p>{LONG}</p></div><div>{links}</div></div>", f"<div>{MENU}</div>")
    assert main_text(html).split("\n\n") == [LONG, MORE, LONG]


def test_long_and_broken():
    assert len(main_text(page("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"))) == 20_000 * (len(LONG) + 2) - 2
    assert main_text("<article><p>one two three<p>four <b") == "one two three\n\nfour"
    assert main_text("<div><p>" * 3000 + LONG) == LONG


def test_hostile_markup():
    """Pages on which a walk over the open elements for each tag would take minutes."""
    import time

    n, start = 40_000, time.process_time()
    for html in ("<div>" * n + "</i>" * n, "<i><table>" + "<div>" * n + "</i>" * n, "<b>" * n + "x" + "<p>" * n, "<li><b>" * n, "<article class=a><h2><a>x" * n):
        main_text(html)
    assert time.process_time() - start < 30


def test_clashing_columns(spark):
    rows = [(1, None, PAGES["article element"][0], "x", 5), (2, "u", None, "y", 6), (3, "u", "", None, None)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).orderBy("page_id").collect()
    assert [r.text for r in out] == ["\n\n".join(PAGES["article element"][1]), "", ""] and [r.n_chars for r in out] == [len(r.text) for r in out]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_query(spark):
    """The tables' pages have one article each: its blocks, cut out by a pattern, are what the query must return."""
    import re
    from html import unescape

    def blocks(html):
        inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
        inner = re.sub(r"<!--.*?-->|</?(?:b|i|a|em|strong|span)\b[^>]*>", "", inner, flags=re.S)
        parts = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", re.sub(r"<br\s*/?>", " ", inner))
        return [x for p in parts if (x := " ".join(unescape(p).split()))]

    out = {r.page_id: r for r in queries.op8_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(out) == len(pages)
    for p in pages:
        assert out[p.page_id].text == "\n\n".join(blocks(p.html)) and out[p.page_id].n_chars == len(out[p.page_id].text)
