"""Main text of pages: made pages of many layouts, and the given ones against a plain cut at their article."""

from __future__ import annotations

import html
import re

import pytest
from conftest import SF

from quire.llm import main_text

L = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."

CASES = {
    "divs with names": (f'<html><body><div id="header"><a href=/>Home</a></div><div id="nav"><a>x</a> <a>y</a></div><div id="content"><h1>T &amp; t</h1><p>{L}</p><p>Er.</p><p>{L} {L}</p></div><div id="footer">c</div></body></html>', f"T & t\n{L}\nEr.\n{L} {L}"),
    "header and comments inside": (f"<body><header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>{L}</p><aside>see</aside><ul><li>a<li>b</ul><section class=comments><h2>Comments</h2><article class=comment><p>{L}{L}</p></article></section></article></main><footer>x</footer>", f"T\n{L}\na\nb"),
    "no names": (f"<body><div><a>1</a><a>2</a><a>3</a></div><div><div><h2>Title</h2><p>{L}</p><p>{L}<p>x</div></div><div><a>r1</a><a>r2</a><a>r3</a></div>", f"Title\n{L}\n{L}\nx"),
    "short article, long rest": (f"<body><div class=cookie-notice><p>{L}{L}</p></div><form><p>{L}</p></form><article><h1>a</h1><p>b</p></article><section id=comments><p>{L}</p><p>{L}</p></section>", "a\nb"),
    "comment beside": (f"<article><h1>t</h1><p>{L}</p></article><article class=comment><p>{L}{L}{L}</p></article>", f"t\n{L}"),
    "comments as inner articles": (f"<article><h1>t</h1><p>{L}</p><div><article><p>me too</p></article></div></article>", f"t\n{L}"),
    "table layout": (f"<table><tr><td><a>m1</a><br><a>m2</a></td><td><h1>H</h1><p>{L}</p><p>{L}</p></td></tr></table>", f"H\n{L}\n{L}"),
    "a name that denies": (f'<div class="post no-sidebar"><div class="entry-content"><p>{L}</p><p>{L}</p><div class="share">share</div></div></div><div class="widget">{L}</div>', f"{L}\n{L}"),
    "raw text": ("<script>if (a<b) x='</p>'</script><style>p>a{}</style><article><!-- <p>no</p> --><p>one<script>document.write('<p>x</p>')</script> two</p></article>", "one two"),
    "quotes and references": ("<article><p title=\"a>b\" class='x>y'>q</p><p>r &lt;b&gt; &#233; &eacute;&nbsp;z</p></article>", "q\nr <b> é é z"),
    "breaks": ("<p>a<br>b\n\t c", "a b c"),
    "misnested": ("<div><b><div>x</b>y</div></div>", "xy"),
    "plain": ("just text", "just text"),
    "empty": ("", ""),
    "blank": (" \n", ""),
    "only markup": ("<html><body><nav>x</nav></body></html>", ""),
    "unended": ("<article><p>a</p><!-- never", "a"),
    "hidden": (f"<article><p>{L}</p><p hidden>x</p><p style='display: none'>y</p></article>", L),
    "deep": ("<div>" * 3000 + L, L),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, want = CASES[name]
    assert main_text.extract(page) == want


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        text = "\n".join(b for b in blocks if b)
        want[r.page_id] = (r.url, text, len(text))
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in main_text.digest(pages).collect()}
    assert got == want


def test_nulls_repeats_clashes_and_nothing(spark):
    rows = [(1, None, None, "a"), (None, "u", "<p>x</p>", "b"), (2, "u", "<p>x</p>", "c"), (2, "u", "<p>x</p>", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `TEXT` string")
    got = sorted((tuple(r) for r in main_text.digest(pages).collect()), key=repr)
    assert got == [(1, None, "", 0), (2, "u", "x", 1), (2, "u", "x", 1), (None, "u", "x", 1)]
    assert main_text.digest(pages.limit(0)).collect() == []
