"""Main text of pages: made pages with every kind of frame, malformed markup, whole tables, odd rows."""

import html
import re

import pytest
from pyspark.sql import functions as F

from shelfrank.llm import html_blocks as hb, queries

SF = "/root/testdata/sf0.01"
STORY = "This is the story of a man who was in the house and had a lot to do with it all day."
OTHER = "Dies ist die Geschichte von einem Mann, der in dem Haus war und den ganzen Tag viel mit ihm zu tun hatte."


def plain(page):
    """The article of a given page, read with two patterns: its markup is regular."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())


def test_query_on_all_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op11_html_blocks(spark, SF).collect()}
    assert got.keys() == pages.keys()
    assert all(r.text == plain(pages[i].html) and r.n_chars == len(r.text) and r.url == pages[i].url for i, r in got.items())


@pytest.mark.parametrize(
    "frame",
    [
        "<nav><ul><li><a href=/>Home</a></li></ul></nav>%s", '<div class="site-nav"><a href=/>Home</a> and the rest of the menu</div>%s', f"<header><h1>Site</h1><p>{STORY}</p></header>%s",
        f"%s<footer><p>{STORY}</p></footer>", f"%s<aside><p>{STORY}</p></aside>", f'%s<div id="sidebar"><p>{STORY}</p></div>', f'<div class="cookie-notice"><p>{STORY}</p></div>%s',
        f'<div role="alert">{STORY}</div>%s', f'<div class="ad">{STORY}</div>%s', f'<div class="AdBox"><p>{STORY}</div>%s', f"<form><label>Name</label><p>{STORY}</p><input></form>%s",
        '<script>if (a < b) document.write("<p>x</p>")</script>%s<SCRIPT>more()</SCRIPT >', "<style>p > a { color: red }</style>%s", f'%s<section id="comments"><h2>Comments</h2><p>{STORY}</p></section>',
        f'%s<div class="reader-comments"><article class="comment"><p>{STORY}</p></article></div>', f"<!-- <p>{STORY}</p> -->%s", f'<dialog open><p>{STORY}</p></dialog>%s', "<ul><li><a href=a>One page</a><li><a href=b>Another page</a></ul>%s",
        f'%s<div class="related-posts"><p>{STORY}</p></div>', f'<noscript><p>{STORY}</p></noscript>%s', f'<div class="newsletter-signup"><p>{STORY}</p></div>%s',
    ],
)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_frames_go(frame, tag):
    body = f"<{tag}><h1>A title</h1><p>{STORY}</p><p>Short one.</p><p>{OTHER}</p></{tag}>"
    assert hb.main_text(f"<html><head><title>x</title></head><body class='has-sidebar'>{frame % body}</body></html>") == f"A title {STORY} Short one. {OTHER}"


def test_inside_an_article():
    page = f"<article class='post comments-open'><header><h1>T</h1></header><p>{STORY}</p><aside>x</aside><p>zzz qqq</p><div class=ad>buy</div><article><p>{STORY}</p></article><footer>by me</footer></article><p>{STORY}</p>"
    assert hb.main_text(page) == f"T {STORY} zzz qqq"
    assert hb.main_text("<article><p>Qx zq.</p></article>") == "Qx zq."
    assert hb.main_text("<article>" + "<p>" + "qxz " * 90 + "</article>") == ("qxz " * 90).strip()


def test_second_pass():
    good, bad, open_ = hb.GOOD, hb.BAD, hb.OPEN
    assert hb.second_pass([open_, good, open_, open_, bad, open_], good) == [good, good, good, bad, bad, bad]
    assert hb.second_pass([bad, open_, good], bad) == [bad, good, good] and hb.second_pass([open_], bad) == [bad] and hb.second_pass([], good) == []


def test_short_blocks_follow_their_neighbours():
    links = "<ul><li><a href=a>Alpha beta gamma</a></li><li><a href=b>Delta</a></li></ul><div>tiny</div>"
    assert hb.main_text(f"<body>{links}<div>x</div><p>{STORY}</p><p>so</p><p>{OTHER}</p><div>{'zxq ' * 60}</div>") == f"x {STORY} so {OTHER}"


def test_references_and_space():
    assert hb.main_text("<p>A&amp;B &lt;b&gt; &#233;&#xe9; &copy 5 &am\n\t x&nbsp;y&AMP;</p>") == "A&B <b> éé © 5 &am x y&"
    assert hb.main_text("<p>in<b>line</b> <i>tags</i> a<br>b</p>") == "inline tags a b"


def test_malformed_pages():
    assert hb.main_text('<p class="x>abc <b>def</b> </p> tail') == "abc def tail"
    assert hb.main_text("5 < 6 > 4 <3 <") == "5 < 6 > 4 <3 <"
    assert hb.main_text("<p>one<p>two<b><p>three</i></div>") == "one two three"
    assert hb.main_text("<!-- open <p>never</p>") == "" and hb.main_text("<script>never") == "" and hb.main_text("<p") == "<p"


@pytest.mark.parametrize("page", ['<a "' * 40000, "<b>" * 60000 + "<p>x" * 20000, "<" * 200000, "<!--" * 40000, "</" * 90000, '<div><a href="' * 20000, "<ul><li>" * 30000 + "x", "&amp" * 90000])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.time()
    hb.main_text(page)
    assert time.time() - began < 5


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "u", "", 1), (1, "u", "", 1), (2, None, " \n ", 1), (3, "v", f"<p>{STORY}</p>" * 5000, 1), (4, "w", "<nav>only</nav>", 1)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted(((r.id, r.url, r.text, r.n_chars) for r in hb.extracted(frame).collect()), key=str)
    long = " ".join([STORY] * 5000)
    assert got == sorted([(None, None, "", 0), (1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0), (3, "v", long, len(long)), (4, "w", "", 0)], key=str)
    assert hb.extracted(frame.filter(F.lit(False))).count() == 0
