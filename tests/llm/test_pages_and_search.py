from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sortflow.llm.html_extraction import LineParser, extract_text, main_text, smoothed_ratios
from sortflow.llm.rows import ROW
from sortflow.llm.topk_search import max_score, top_k

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, which is a long sentence about nothing.</p></div>
<article><h1>Title &amp; more</h1><p>First   paragraph with
 <b>bold</b> text&nbsp;and &#233;.<br>Next line<p>Short.<div class="ad">Buy this</div>
<form><p>Mail?</p><input name=q></form><aside>See also</aside><ul><li>one<li>two</ul><p hidden>secret</p></article>
<section id="comments"><article class="comment"><p>I did not like this article at all, says a reader here.</p></article></section>
<footer>&copy; someone</footer></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE) == "Title & more\nFirst paragraph with bold text and é. Next line\nShort.\none\ntwo"


def test_page_without_an_article():
    page = PAGE.replace("<article>", '<div id="content">').replace("</article>\n<section", "</div>\n<section")
    assert main_text(page) == main_text(PAGE)


def test_a_long_paragraph_does_not_win_alone():
    lead, long, end = "lead " * 12, "long words " * 200, "closing words of the page"
    one = f"<div><h1>Title</h1><p>{lead}</p><p>{long}</p></div>"
    assert main_text(one).split("\n") == ["Title", lead.strip(), long.strip()]
    assert main_text(f"<div><h1>Title</h1><div><p>{long}</p></div></div>").split("\n") == ["Title", long.strip()]
    apart = f"<body><div><div><p>{lead}</p></div><div><p>{long}</p><ul><li>one<li>two</ul></div><div><p>{end}</p></div></div></body>"
    assert main_text(apart).split("\n") == [lead.strip(), long.strip(), "one", "two", end]
    table = f"<div><h2>Title</h2><table><tr><td>a<td>{long}</table><p>b</p></div>"
    assert main_text(table).split("\n") == ["Title", "a", long.strip(), "b"]


@pytest.mark.parametrize("said", ["class='layout has-sidebar'", "id=page class=no-comments", "class='container fixed-header'", "class=with_nav"])
def test_layout_words_do_not_empty_a_page(said):
    assert main_text(PAGE.replace("<body>", f"<body><div {said}>")) == main_text(PAGE)
    inside = PAGE.replace("<article>", f"<article><div {said}>").replace("<aside>", "</div><aside>")
    assert main_text(inside) == main_text(PAGE)
    page = PAGE.replace("First ", "First words of a paragraph that is the most of what this page has to say to its readers, and more ")
    plain = page.replace("<article>", f"<div id=content><div {said}>").replace("</article>\n<section", "</div></div>\n<section")
    assert main_text(plain) == main_text(page)


def test_surroundings_by_class_stay_out():
    around = "<div class='related'><article><p>Another story</p></article></div><p>x <span class=ad-slot>Buy</span> y</p>"
    assert main_text(f"<article><p>The story itself, at length.</p></article>{around}") == "The story itself, at length."
    assert main_text("<div><p>The story itself, at length.</p><p>x <b class=ad-slot>Buy</b> y</p></div>") == "The story itself, at length.\nx y"


@pytest.mark.parametrize(
    ("html", "text"),
    [(None, ""), ("", ""), ("<p></p><!-- x -->", ""), ("plain words", "plain words"), ("<p>a < b &lt; c &nosuch; &amp", "a < b < c &nosuch; &"),
     ("<article><p>cut of", "cut of"), ("<body><p>x</p><p>y</p>", "x\ny"), ("<script>if (a<b) {}</script>", "")],
)
def test_odd_pages(html, text):
    assert main_text(html) == text


def test_ratios_are_smoothed():
    parser = LineParser()
    parser.feed("<p>aaaa</p><p><a>b</a><a>c</a></p><p>" + "d" * 100 + "</p>")
    lines = parser.finish()
    plain = [len(x.text) / max(1, x.tags) for x in lines]
    kernel = [math.exp(-0.5 * k * k) for k in range(-3, 4)]
    padded = [plain[0]] * 3 + plain + [plain[-1]] * 3
    expected = [sum(w * x for w, x in zip(kernel, padded[i : i + 7])) / sum(kernel) for i in range(3)]
    np.testing.assert_allclose(smoothed_ratios(lines), expected)


def test_extraction_over_a_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y"), (None, "v", "<p>" + "w " * 200_000, "z")], "page_id long, url string, html string, text string")
    rows = sorted((r[ROW]["page_id"] or 0, r["n_chars"]) for r in extract_text(pages).collect())
    assert rows == [(0, 399_999), (1, len(main_text(PAGE))), (2, 0), (2, 0)]
    assert extract_text(pages.limit(0)).count() == 0


def brute(rows, asked, k=5):
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and usable(v)})
    out = []
    for q, v in rows:
        if asked(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard_rows", "block_queries"), [(4096, 2048), (37, 3)])
def test_equals_all_scores(spark, shard_rows, block_queries):
    r = random.Random(6)
    rows = [(i, [r.choice([0.0, 0.5, -0.25, r.gauss(0, 1)]) for _ in range(12)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12)]
    rows += [(3000, [1.0, 2.0]), (3001, []), (50, rows[50][1]), (None, rows[0][1]), (3050, [-0.1] * 14)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k(df, df.where("vec_id % 50 = 0"), shard_rows=shard_rows, block_queries=block_queries).collect()
    assert sorted(tuple(x) for x in found) == brute(rows, lambda q: q % 50 == 0)


def test_max_score_keeps_every_vector_of_the_kth_score():
    r = np.random.default_rng(3)
    vectors = r.integers(-4, 5, (900, 16)).astype(float) * (r.random((900, 16)) < 0.4)
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    for query in r.integers(-5, 6, (40, 16)).astype(float):
        rows, scores = max_score(query, vectors, low, high, 5)
        whole = vectors @ query
        assert set(rows) == set(np.flatnonzero(whole >= np.sort(whole)[-5])) and (scores == whole[rows]).all()


def test_few_and_large_vectors(spark):
    schema = "vec_id long, embedding array<double>, score long, shard long"
    few = spark.createDataFrame([(0, [1.0], 1, 1), (1, [2.0], 1, 1)], schema)
    assert [tuple(x) for x in top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_k(few.limit(0), few.limit(0)).count() == 0
    large = spark.createDataFrame([(0, [2.0**20], 1, 1), (1, [2.0**19 + 0.5], 1, 1)], schema)
    assert [tuple(x)[3] for x in top_k(large, large.where("vec_id = 0")).collect()] == [2**28 * (2**27 + 128)]
