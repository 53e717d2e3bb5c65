from __future__ import annotations

import random
import time
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import html_content as h
from tallygrid.llm.queries.op11 import op11_html_content

SF = "/root/testdata/sf0.001"
PRIORS = {item: h.prior(item) for item in h.vocabulary()}
LONG = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize("seed", range(30))
def test_region_equals_all_regions(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randint(0, 25))]
    pairs = [(a, b) for a in range(len(scores)) for b in range(a, len(scores))]
    best = max((sum(scores[a:b + 1]) for a, b in pairs), default=0)
    found = h.best_region(scores)
    assert (found is None) == (best <= 0)
    if found:
        assert sum(scores[found[0]:found[1] + 1]) == best


def test_a_page_of_all_parts():
    page = f"""<!DOCTYPE html><html><head><title>Not me</title><style>p {{}}</style></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use {LONG}</div>
    <nav><ul><li><a href="/a">Home {LONG}</a></ul></nav>
    <div class="sidebar"><p>Side {LONG}</p></div>
    <article><header><h1>Tit&eacute;l &amp;lt; one</h1></header><p>{LONG}<b>bold</b>er,
    <a href="x">a   link</a>.<div class="ad">Buy {LONG}</div><p>Second&nbsp;part 3 < 4<br>end
    <script>var x = "</p><p>no";</script><form><label>Mail {LONG}</label></form>
    <blockquote>Quoted</blockquote><section id="comments"><article><p>First! {LONG}</p></article>
    </section></article><aside>Aside {LONG}</aside><footer>&copy; Foot {LONG}</footer></body></html>"""
    assert h.main_text(page, PRIORS) == (
        f"Titél &lt; one {LONG}bolder, a link. Second part 3 < 4 end Quoted")


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), (" \n", ""), ("just text &amp; more", "just text & more"),
    ("<p>", ""), ("<p>a<!-- b --><p>c", "a c"), ("<p>a<!-- open", "a"), ("<p>one<p cla", "one"),
    ("<script>x</script>", ""), ("<script>x", ""), ("<p>a <br/>b<wbr>c", "a bc"),
    ("<form><p>all in a form</p></form>", "all in a form"),
    ("<ul><li>a<li>b</ul>", "a b"), ("</div></p>loose <b>end</i> here", "loose end here"),
    ('<p title="a>b">x <a href=\'q"\'>y</a></p>', "x y"), ("a < b && c > d", "a < b && c > d"),
    ("<div>left<span>right</span></div>", "leftright"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
])
def test_small_pages(page, text):
    assert h.main_text(page, PRIORS) == text


def test_without_an_article():
    page = f"""<body><div id="top"><a href=1>x</a> <a href=2>y</a></div><div class=story><h2>Head</h2>
    <p>{LONG}</p><div class="advert">{LONG}</div><p>{LONG}</p><p>Bye.</p></div>
    <div id=footer>{LONG}</div>"""
    assert h.main_text(page, PRIORS) == f"Head {LONG} {LONG} Bye."


def test_long_pages_end():
    began = time.time()
    for page in ("<" * 200_000, "<b>" * 100_000 + "x", "</b>" * 100_000, '<a href="' * 50_000,
                 "<p>" * 100_000 + "x", "<div>" * 3_000 + "x" * 10 + "</div>" * 3_000,
                 "<p>a &amp; b " * 50_000, "<!--" * 50_000, "<script>" * 50_000):
        h.main_text(page, PRIORS)
    assert time.time() - began < 30


class Plain(HTMLParser):
    """Text inside of <article>, by the standard library."""

    def __init__(self):
        super().__init__()
        self.inside, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.text.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in ("b",):
            self.text.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.text.append(data)


@pytest.mark.skipif(not Path(SF).exists(), reason="no supplied tables")
def test_query_equals_the_articles_of_the_supplied_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op11_html_content(spark, SF).collect()
    assert {r["page_id"] for r in rows} == pages.keys() and len(rows) == len(pages)
    for r in rows:
        parser = Plain()
        parser.feed(pages[r["page_id"]])
        parser.close()
        assert r["text"] == " ".join("".join(parser.text).split())
        assert r["n_chars"] == len(r["text"])


KIND = "page_id bigint, url string, html string"


def test_weights_of_labelled_pages(spark):
    page = f"<nav><a href=x>go</a></nav><div><p>{LONG}</p></div><center>Foot</center>"
    begin = page.index("<p>")
    rows = [(i, None, page) for i in range(40)] + [(99, None, None)]
    df = spark.createDataFrame(rows, KIND).withColumns(
        {"begin": F.lit(begin), "end": F.lit(begin + len(LONG) + 7)})
    weights = h.fit(df, begin="begin", end="end")
    assert set(weights) == set(h.vocabulary())
    assert weights["word"] > 0 > weights["</p"] > weights["<center"] == -4.0
    assert weights["<h1"] == h.prior("<h1")
    # unlabelled pages teach nothing
    assert h.fit(df) == PRIORS
    assert h.fit(df.limit(0)) == PRIORS
    few = h.fit(df, begin="begin", end="end", sample_pages=1)
    assert set(few) == set(PRIORS)


def test_defined_cases(spark):
    rows = [(1, None, "<p>a b"), (1, None, "<p>a b"), (None, "u", None), (2, "v", "")]
    df = spark.createDataFrame(rows, KIND).withColumns(
        {"text": F.lit("mine"), "n_chars": F.lit(None).cast("int")})
    got = h.extract(df, PRIORS)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, None, "a b", 3)] * 2 + [(None, "u", "", 0), (2, "v", "", 0)], key=repr)
    assert h.extract(df.limit(0), PRIORS).count() == 0
