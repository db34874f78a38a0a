import glob
import html
import re

import pyarrow.parquet as pq
import pytest

from rankflow.llm.html_text import extract, main_text, name_says

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- <p>x</p> -->
<div class="ad">Buy, now, all, of, it.</div><div class="cookie-notice">We use, cookies, a lot, really.</div>
<article><header><h1>Head &amp; line</h1></header><p><b>First   part,
 with a break<br>here.<p>Second&nbsp;part &lt;tag&gt; &#233;.<form><input><p>Mail, me.</p></form><ul><li>item one<li>item two</ul></article>
<aside><p>Side, bar, text, text.</p></aside><section id="comments"><p>Great, post, I, like, it, a, lot.</p></section>
<footer>&copy; site</footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE) == "Head & line\nFirst part, with a break here.\nSecond part <tag> é.\nitem one\nitem two"


def test_container_without_article_tag():
    body = "".join(f"<p>Sentence {i}, with a comma, and some more words to read.</p>" for i in range(6))
    page = f"<body><div id=menu><a href=x>a, b, c</a></div><div class=wrap><div class=inner>{body}</div><p>{'Sibling text. ' * 10}</p></div><div class=comments>{body}</div></body>"
    text = main_text(page)
    assert text.count("Sentence") == 6 and "Sibling" in text and "a, b" not in text


BODY = "".join(f"<p>Sentence {i}, with a comma, and some more words to read.</p>" for i in range(6))


@pytest.mark.parametrize("name", "main-menu page-footer post-nav entry-related main-header content-advert page-cookie-notice post-share mainMenu sidebar_left ad-slot-1 sidebar-content comment-body post-comments".split())
def test_names_that_are_cut(name):
    page = f'<body><div class="wrap">{BODY}<div class="x {name}"><p>Cut, this, text, please, and, all, of, it.</p></div></div></body>'
    assert name_says(name) == -1 and main_text(page).count("Sentence") == 6 and "Cut" not in main_text(page)


@pytest.mark.parametrize("name", "byline breadcrumb tags social promo widget toolbar post-body entry-content leadership header-less-unknown adventure".split()[:-2] + ["adventure", "formula", "shared-story"])
def test_names_that_stay(name):
    page = f'<body><div class="wrap">{BODY}<div class="{name}"><p>Keep, this, text, please, and, all, of, it.</p></div></div></body>'
    assert name_says(name) >= 0 and "Keep" in main_text(page)


def test_elements_that_stay():
    page = f"<body><div>{BODY}<p>Let <math><mi>x</mi></math> and <button>press</button>, <object>here</object>, <canvas>drawn</canvas>.</p></div></body>"
    assert "Let x and press , here , drawn ." in main_text(page).replace("press,", "press ,").replace("here,", "here ,").replace("drawn.", "drawn .")


#: Pages without an article element, with their main text as a reader would mark it.
LABELED = [
    (
        """<body><div id="top" class="site-header"><a href="/">Home</a> <a href="/x">News</a></div><div class="columns"><div class="left sidebar"><ul><li><a href="a">First, link</a></li><li><a href="b">Second, link</a></li></ul></div>
<div id="story"><h1>River rises</h1><p>The river rose, again, on Monday.</p><p>Two bridges, both old, were closed to traffic, police said.</p><blockquote>We wait, she said.</blockquote><ul><li>North bridge</li><li>South bridge</li></ul></div></div>
<div class="page-footer"><p>Imprint, contact, jobs, and all other pages of this site.</p></div></body>""",
        "River rises\nThe river rose, again, on Monday.\nTwo bridges, both old, were closed to traffic, police said.\nWe wait, she said.\nNorth bridge\nSouth bridge",
    ),
    (
        """<html><body><table><tr><td class="nav"><a href=1>One, two</a><br><a href=2>Three, four</a></td><td><p>Old pages, as this one, are tables.</p><p>Their text, such as it is, stands in a cell.</p></td></tr></table><form><p>Write, to, us, now.</p></form></body></html>""",
        "Old pages, as this one, are tables.\nTheir text, such as it is, stands in a cell.",
    ),
    (
        """<body><main><section><h2>Part one</h2><p>Salt, pepper, and oil.</p></section><section><h2>Part two</h2><p>Bake it, slowly, for an hour.</p></section><section class="reader-comments"><p>Tasty, thanks, will, cook, again, soon.</p></section></main></body>""",
        "Part one\nSalt, pepper, and oil.\nPart two\nBake it, slowly, for an hour.",
    ),
    (
        """<body><div class="banner">Sale, sale, sale, sale!</div><div><div>Plain text, without a paragraph, in a div.<br>Still the same block, it is.</div></div></body>""",
        "Plain text, without a paragraph, in a div. Still the same block, it is.",
    ),
]


@pytest.mark.parametrize("page,text", LABELED)
def test_labeled_pages_without_an_article(page, text):
    assert main_text(page) == text


def test_broken_pages():
    assert main_text("") == "" and main_text("<p>only") == "only" and main_text("plain < text") == "plain < text"
    assert main_text('<p>one</p><a href="x>two</a><p>three</p>').startswith("one")
    assert main_text("<p>a<script>x") == "a"
    assert len(main_text("<p>" + "<b>" * 50000 + "deep")) == 4
    assert len(main_text("<div>" * 20000 + "deep")) == 4
    assert main_text("<a '" * 20000) == ""


def template(page):
    """What the pages of the test tables hold between their article tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>|<br>", inner)
    clean = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts)
    return "\n".join(x for x in clean if x)


def test_whole_table_equals_brute_force():
    rows = pq.read_table(glob.glob("/root/testdata/sf0.01/pages.parquet")[0]).to_pylist()
    assert all(main_text(r["html"]) == template(r["html"]) for r in rows)


def test_rows(spark):
    frame = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (2, "u", PAGE, 3), (2, "u", PAGE, 3)], "page_id long, url string, html string, n_chars int")
    rows = sorted(extract(frame).collect(), key=lambda r: r.page_id or 0)
    assert [r.n_chars for r in rows[:2]] == [0, 0] and rows[2] == rows[3] and rows[2].n_chars == len(rows[2].text)
    assert extract(frame.limit(0)).count() == 0
