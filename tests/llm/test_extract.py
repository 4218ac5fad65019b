"""Main text of pages of several designs, and odd markup."""

from __future__ import annotations

import html
import re

import pytest

from feedlake.llm.extract import Tree, _blocks, main_text, texts

A = "The first paragraph tells the story at some length, with commas, names and a full stop at its end."
B = "A second paragraph carries on; it is as long as the first one, or nearly so, and ends likewise."
C = "Finally the third paragraph closes the matter, once more in plain words without any link at all."
MENU = '<ul class="menu"><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact</a></li></ul>'

PAGES = {
    "article": (f"<body><nav>{MENU}</nav><article><h1>Head &amp; line</h1><p>{A}<p>So.</p></article><footer>end</footer>", f"Head & line\n{A}\nSo."),
    "plain divs": (f'<html><body><div id="top">{MENU}</div><div class="text"><h2>Title</h2><p>{A}</p><p>{B}</p><p>{C}</p></div><div><a href="x">one</a> <a href="y">two</a> <a href="z">three</a></div></body>', f"Title\n{A}\n{B}\n{C}"),
    "sidebar and comments": (f'<main><div><p>{A}</p><p>{B}</p></div></main><div class="sidebar"><p>{C}</p></div><div id="comments"><p>{C}</p></div>', f"{A}\n{B}"),
    "notices": (f'<body><div class="cookie-notice">{C}</div><article><p>{A}</p><div class="ad-box">{C}</div><p>{B}</p><form><p>{C}</p></form></article></body>', f"{A}\n{B}"),
    "form around": (f"<body><form><input value=x><article><p>{A}</p><button>Go</button></article></form></body>", A),
    "table": (f"<body><div>{MENU}</div><table><tr><td>{A}<td>{B}</table></body>", f"{A}\n{B}"),
    "lists": (f"<article><p>{A}</p><ul><li>one<li>two <b>bold</b></ul><pre>  x\n y </pre></article>", f"{A}\none\ntwo bold\nx y"),
    "breaks": (f"<article><p>{A}<br>{B}</p> loose &lt;b&gt; &#233; &copy;&nbsp;1 </article>", f"{A} {B}\nloose <b> é © 1"),
    "scripts": (f'<head><title>t</title><script>"<p>"</script></head><body><article><script>var a="</p>";</script><style>p{{}}</style><p>{A}</p><!-- <p>no</p> --></article>', A),
    "no body": (f"<p>{A}</p><p>{B}</p>", f"{A}\n{B}"),
    "bare text": ("just words", "just words"),
    "cut in a tag": (f"<article><p>{A}</p><p>{B}</p><a hre", f"{A}\n{B}"),
    "header inside": (f"<body><header>{MENU}</header><article><header><h1>Title</h1></header><p>{A}</p></article></body>", f"Title\n{A}"),
}


STORY = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
NAMED = {
    "form around divs": f"<body><form id=aspnetForm><div>{MENU}</div><div>{STORY}</div></form></body>",
    "form, leftover": f"<body><form id=aspnetForm><div>{STORY}</div></form><div><p>All rights kept.</p></div></body>",
    "has-sidebar": f'<body><div class="layout has-sidebar"><div>{STORY}</div><div class="sidebar"><p>{A}</p></div></div></body>',
    "with comments": f'<body><div id="content-with-comments"><div>{STORY}</div><div id="comments">{STORY * 4}</div></div></body>',
    "fixed header": f'<body><div class="page-header-fixed"><div>{STORY}</div></div></body>',
    "article has-comments": f'<body><div>{MENU}</div><article class="post has-comments">{STORY}</article></body>',
    "long comments": f'<body><div class="text">{STORY}</div><div id="comments">{STORY * 9}</div></body>',
    "only a widget": f'<body><div class="widget"><div>{STORY}</div></div><div><p>All rights kept.</p></div></body>',
    "only comments": f'<body><div id="comments">{STORY}</div></body>',
    "hidden body": f'<body style="visibility:hidden"><div>{STORY}</div></body>',
}


@pytest.mark.parametrize("name", NAMED)
def test_names_do_not_take_the_article_away(name):
    assert main_text(NAMED[name]) == f"{A}\n{B}\n{C}"


@pytest.mark.parametrize("name", PAGES)
def test_designs(name):
    page, want = PAGES[name]
    assert main_text(page) == want


def test_unclosed_and_stray_tags():
    tree = Tree()
    tree.feed("<div><p>a<b>b<p>c</i></div>d</section>e")
    tree.close()
    assert _blocks(tree.root) == ["ab", "c", "de"]


@pytest.mark.parametrize("page", [None, "", " \n", "<html></html>", "<body><nav>x</nav></body>", "<!-- a", "<"])
def test_nothing(page):
    assert main_text(page) in ("", "<")


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + A + "</div>" * 20_000
    assert main_text(deep) == A
    long = "<article>" + f"<p>{A}</p>" * 20_000 + "</article>"
    assert main_text(long).count("\n") == 19_999


def test_query_on_supplied_pages(spark):
    from feedlake.llm.queries import op4_extract

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op4_extract(spark, sf).collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", pages[r.page_id], re.S)[1]
        parts = [html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(" ".join(b.split()) for b in parts if b.strip())
        assert r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, None, None), (1, "u", f"<p>{A}</p>"), (1, "u", f"<p>{A}</p>"), (None, None, "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = pages.select("page_id", texts(pages.html).alias("t"))
    assert sorted(r.t for r in got.collect()) == ["", "", A, A]
    assert got.where("false").count() == 0
