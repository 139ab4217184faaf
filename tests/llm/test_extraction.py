"""Minimum cut against all labellings, the given pages against their articles, and edge pages."""

import html
import itertools
import random
import re

import pytest

from lexiloom.llm import extraction


def test_minimum_cut_against_all_labellings():
    random.seed(1)
    for _ in range(150):
        n = random.randint(1, 9)
        costs = [random.choice([-3, -1, -0.5, 0, 0.5, 1, 2, 4]) + random.random() / 9 for _ in range(n)]
        links = [(a, b, random.random() * 2) for a, b in itertools.combinations(range(n), 2) if random.random() < 0.5]

        def price(side):
            return sum(-c if s else c for c, s in zip(costs, side, strict=True)) / 2 + sum(w for a, b, w in links if side[a] != side[b])  # noqa: B023

        def cut(side):
            terminal = sum(max(-c, 0) if s else max(c, 0) for c, s in zip(costs, side, strict=True))  # noqa: B023
            return terminal + sum(w for a, b, w in links if side[a] != side[b])  # noqa: B023

        best = min(cut(s) for s in itertools.product([False, True], repeat=n))
        assert cut(extraction.source_side(costs, links)) == pytest.approx(best)


def article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S)[1]
    return " ".join(html.unescape(" ".join(re.sub(r"<(/?)(p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "").split())).split())


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = extraction.extract(pages.withColumnRenamed("url", "n_chars")).collect()
    assert len(rows) == 250
    for r in rows:
        assert r.text == article(r.html), r.page_id
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html></html>", ""),
        ("<body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class=article><p>One &amp; two\n three.<p>Four&nbsp;five, six &lt;seven&gt;.</div>", "One & two three. Four five, six <seven>."),
        ("<article><h1>Title</h1><p>Some <b>bold</b>er text here.</p><div class='ad-box'>Buy now, it is very cheap today.</div><p>The end of it all.</p></article><footer>&copy; X</footer>", "Title Some bolder text here. The end of it all."),
        ("<main><p>First paragraph of the page.</p><aside><p>Look at this other page, please.</p></aside><p>Second paragraph of the page.</p></main><section id='comments'><p>I liked this article very much.</p></section>", "First paragraph of the page. Second paragraph of the page."),
        ("<div id='cookie-notice'>We use cookies on this site.</div><form><p>Your name, please, and your age.</p></form><div><p>A long plain sentence without any hint of what it is.</p><p>And one more sentence that follows it closely here.</p></div>", "A long plain sentence without any hint of what it is. And one more sentence that follows it closely here."),
        ("<article><p>a<script>var x='</p>';</script>b</p><!-- c --><style>p{}</style><p title=\"a>b\">d &am e &copy;</p>", "ab d &am e ©"),
        ("<article>" + "<div>" * 5000 + "deep text" + "</b>" * 50 + "</div>" * 5000 + "</article>", "deep text"),
        ("<div class='content-with-sidebar'><div class='post-body'><p>The long text of this page is here.</p></div><div class='post-comments'><p>I do not agree with this at all, sorry.</p></div><div class='sidebar-content'><p>More pages that may be of interest to you.</p></div></div>", "The long text of this page is here."),
        ("<article><header class='article-header'><h1>Head</h1></header><p>Body of the text.</p></article><header><p>Site name, and a long slogan of it.</p></header>", "Head Body of the text."),
        ("<article><p>one<br>two</p><p hidden>not this one</p><pre>x\n  y</pre>", "one two x y"),
    ],
)
def test_pages(page, text):
    assert extraction.main_text(page) == text


PROSE = "The knights rode north for nine days, and nobody in the valley heard of them again."


@pytest.mark.parametrize(
    "attributes",
    [
        'aria-label="The hidden cost"', 'id="login"', 'id="menu"', 'class="related-work"', 'id="application-form"', 'id="banner-of-the-knights"',
        'class="footer-less"', 'data-id="share"', 'title="display: none"', 'data-hidden="x"',
    ],
)
def test_no_name_empties_an_article(attributes):
    assert extraction.main_text(f"<article {attributes}><h1>Head</h1><p>{PROSE}</p></article>") == f"Head {PROSE}"
    assert extraction.main_text(f"<article><section {attributes}><p>{PROSE}</p></section></article>") == PROSE


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>Hello world.</p>", "Hello world."),
        ("<article><ul><li><a href=a>First page</a><li><a href=b>Second page</a></ul></article>", "First page Second page"),
        ("<div class=menu><a href=a>Home</a> <a href=b>News</a></div>", ""),
        (f"<article><p>{PROSE}</p><div class='share-bar'>Share this article on</div><div id=related><a href=x>More on knights</a></div></article>", PROSE),
        (f"<article><p>{PROSE}</p><div class=newsletter>Subscribe to get the latest stories every week.</div><p aria-hidden='true'>{PROSE}</p></article>", PROSE),
        (f"<article><p>{PROSE}</p><div class=comments><p>{PROSE} {PROSE} {PROSE}</p></div><p style='color:red; display:none'>{PROSE}</p></article>", PROSE),
    ],
)
def test_what_a_page_says_about_its_parts(page, text):
    assert extraction.main_text(page) == text


def test_the_cut_decides():
    """By themselves the short lines between long ones look like boilerplate, and the long teaser like content."""
    page = f"<div><p>{PROSE}</p><p>By noon</p><p>{PROSE}</p><p>At last</p><p>{PROSE}</p></div><div><p><a href=a>Top</a></p><p>Two words more.</p><p><a href=b>Site map</a></p></div>"
    blocks = extraction.text_blocks(page)
    alone = [extraction.cost(b) > 0 for b in blocks]
    together = extraction.labels(blocks)
    changed = [b.text for b, a, t in zip(blocks, alone, together, strict=True) if a != t]
    assert changed == ["By noon", "At last", "Two words more."]
    assert extraction.main_text(page) == f"{PROSE} By noon {PROSE} At last {PROSE}"


def test_a_very_long_page():
    page = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article><nav>" + "<a href=x>y</a>" * 20_000 + "</nav>"
    assert extraction.main_text(page) == " ".join([PROSE] * 20_000)


XHTML = '<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml"><body>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<svg class='icon' width=\"1\"/><article><p>All of this text stays.</p></article>", "All of this text stays."),
        ("<article><p>One <svg/>two.</p><p>Three <svg width=9 />four.</p><svg><text>no</text></svg></article>", "One two. Three four."),
        ("<article><p>One <svg width=9/>no</svg>two.</p></article>", "One two."),
        ("<article><p>One <math/>two.</p><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", "One two. Where x=2 holds."),
        (XHTML + "<script src='a.js'/><iframe src=\"b\"/><article><p>One <object/>two <canvas id='c' />three.</p></article></body></html>", "One two three."),
        ("<article><p>One <iframe src='b'/>no</iframe>two.</p></article>", "One two."),
    ],
)
def test_self_closed_elements(page, text):
    assert extraction.main_text(page) == text


def test_empty_table_and_repeats(spark):
    assert extraction.extract(spark.createDataFrame([], "html string")).collect() == []
    df = spark.createDataFrame([("<article>x y z</article>", 1)] * 2 + [(None, 2)], "html string, text int")
    assert sorted((r.text, r.n_chars) for r in extraction.extract(df).collect()) == [("", 0), ("x y z", 5), ("x y z", 5)]
