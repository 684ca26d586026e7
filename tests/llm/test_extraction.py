"""HTML extraction: the scan against all stretches, markup case by case, and whole pages against their labelled element."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from routeflow.llm import extraction, queries

SF = "/root/testdata/sf0.001"
NONE = extraction.Model({}, frozenset())


def test_best_stretch_by_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        x = [rng.randint(-4, 4) for _ in range(rng.randint(0, 14))]
        a, b = extraction.best_stretch(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1))])


PAGE = """<!DOCTYPE html><HTML><head><title>T</title><style>p{a:"</p>"}</style></head><body class="has-sidebar">
<div id="cookie-notice">We use cookies to be of use to you, please accept all of them now.</div>
<header class="site"><h2>My site</h2><nav><ul><li><a href="/a>b">Home</a><li><a href='x'>About us</a></ul></nav></header>
<div class="content with-sidebar"><form action="/"><%s>
<header><h1>The  title &amp; more</h1></header>
<p>First <b>para</b>graph, with a&nbsp;space&#33; 1 < 2 &copy 2020
and a <a href="/l">link in it</a>.<p>Second one, never closed
<div class="ad-box">Buy this now, it is the best that money can buy for you, really.</div>
<ul><li>one item of the list<li>another item of the list</ul>
<!-- hidden <p>text</p> --><script>if (a < b) document.write("<p>no</p>")</script>
<form><label>Your mail</label><input name=q><button>Subscribe now</button></form>
<table><tr><td>cell one<td>cell two</table>last words<br>of the text
<section id="commentList"><h3>Comments</h3><p>A reader says that it is a long and good article, and goes on and on about it.</p></section>
</%s></form><div class="sidebar"><p>Other things that you may like to read on this site, many of them.</p></div></div>
<footer><p>&copy; All of it is ours and ours alone, for ever and a day.</p></footer></body></html>"""
WANT = "The title & more First paragraph, with a space! 1 < 2 © 2020 and a link in it. Second one, never closed one item of the list another item of the list cell one cell two last words of the text"


@pytest.mark.parametrize("tag", ["article", "main", "div role=main", "section itemprop='articleBody'"])
def test_a_page_with_everything(tag):
    assert extraction.main_text(PAGE % (tag, tag.split()[0]), NONE) == WANT


def test_markup():
    text = lambda x: extraction.main_text(x, NONE)
    assert text(None) == text("") == text("<p>") == text("<nav>one two three</nav>") == text("<!-- only this") == text("<script>x y z") == ""
    assert text("just words, &lt;b&gt; &amp;amp; &am &quot") == 'just words, <b> &amp; &am "'
    assert text("in<i>line</i> tags<span>join</span>\n\t words") == "inline tagsjoin words"
    assert text('<p title="a > b" data-id=ad>kept words here</p>') == "kept words here"
    assert text("<p>one two three</div></p></b><P>four five six<textarea>no</textarea> seven<p hidden>not shown at all</p>") == "one two three four five six seven"
    assert text("a <!--> b <!-- - --> c <?php echo ?> d </ e> f <![CDATA[g]]>") == "a b c d f"
    assert text("some words <a href='x") == "some words"


def test_time_is_linear():
    for unit in ("<a<b ", '<p t="', "</script ", "<script ", "<!-", "<!-- ", "<li>", "<div>x", "</div>", "&amp"):
        t = time.perf_counter()
        extraction.main_text(unit * 30_000, NONE)
        assert time.perf_counter() - t < 5, unit


def _page(i, body, label="article"):
    side = f"<div class=promoted-{i}x>{'stuff to look at ' * 9}</div><div class=teasers>{'more things over here ' * 8}</div>"
    return f"<html><body>{side}<{label}>{body}</{label}><div class=teasers>{'read on ' * 30}</div><dl><dt>{'term ' * 20}</dl></body></html>"


def test_fit_learns_kinds_and_costs(spark):
    rows = [(i, _page(i, f"<h1>Title {i}</h1><p>{'words of the text ' * 5}<p>short")) for i in range(40)] + [(99, "<p>no label"), (None, None)]
    model = extraction.fit(spark.createDataFrame(rows, "page_id long, html string"))
    assert {".teasers", "dl"} <= model.asides and not {"p", "h1"} & model.asides
    assert model.costs["p"] == model.costs["h1"] == extraction.LOW and model.costs["dl"] > 1
    bare = _page(7, "<h1>Title</h1><p>one text<p>b", "section")
    assert extraction.main_text(bare, model) == "Title one text b"
    assert extraction.fit(spark.createDataFrame([], "page_id long, html string")) == NONE


def test_the_sample_is_drawn_by_the_whole_row(spark):
    rows = [(1, f"u{i}", _page(i, f"<p>{'text ' * 9}")) for i in range(300)]
    model = extraction.fit(spark.createDataFrame(rows, "page_id long, url string, html string"), sample=40)
    assert ".teasers" in model.asides


def test_extract_with_nulls_clashes_and_repeats(spark):
    rows = [(None, None, None, 1), (1, "u", PAGE % ("article", "article"), 2), (1, "u", PAGE % ("article", "article"), 2), (2, "v", "", 3), (3, "w", "<p>" + "é😀 long " * 100_000, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, c0 int").withColumns({"text": F.lit("old"), "n_chars": F.lit("old")})
    out = extraction.extract(df, NONE)
    assert out.columns == ["page_id", "url", "c0", "text", "n_chars"]
    got = sorted(((r["c0"], r["text"], r["n_chars"]) for r in out.collect()), key=lambda r: r[0])
    long = ("é😀 long " * 100_000).strip()
    assert got == [(1, "", 0), (2, WANT, len(WANT)), (2, WANT, len(WANT)), (3, "", 0), (4, long, len(long))]
    assert extraction.extract(df.where("false"), NONE).count() == 0


def _labelled(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    return " ".join(html.unescape(re.sub(r"</?(?:p|h1)>|<br>", " ", inner).replace("<b>", "")).split())


def test_query_on_all_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.op11_html_extraction(spark, SF)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], _labelled(pages[r["page_id"]]["html"]), len(r["text"]))


def test_pages_without_labels_by_what_others_taught(spark):
    """Half of the pages teach; the labels of the others are taken away."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = extraction.fit(pages.where("page_id % 2 = 0"))
    rest = pages.where("page_id % 2 = 1")
    got = {r["page_id"]: r["text"] for r in extraction.extract(rest.withColumn("html", F.regexp_replace("html", "</?article>", "")), model).collect()}
    want = {r["page_id"]: _labelled(r["html"]) for r in rest.collect()}
    assert got == want
