"""Main text of pages: blocks of awkward markup, differencing, and the tables' articles."""

import html
import random
import re

import numpy as np
import pytest

from stratalake.llm.html_blocks import ARTICLE, HIDDEN, Page
from stratalake.llm.html_extract import CELLS, common_lines, host_and_path, main_text

SCHEMA = "page_id bigint, url string, html string, text string, gone string, lines string"


def texts(spark, pages):
    rows = spark.createDataFrame([(i, u, h, "own", "g", "l") for i, u, h in pages], SCHEMA).repartition(3)
    return {r.page_id: r.text for r in main_text(rows).collect()}


@pytest.mark.parametrize(("markup", "lines"), [
    (None, []), ("", []), ("plain  text\n here", ["plain text here"]), ("x < y and z > w", ["x < y and z > w"]),
    ("<p>a<p>b<br>c", ["a", "b", "c"]), ("<ul><li>one<li>two</ul>three", ["one", "two", "three"]),
    ("<p>a&nbsp;b &#x27;c&#39; &copy; &amp;lt; &#55296;</p>", ["a b 'c' © &lt; �"]),
    ("<script>if (a < b) x('</p>')</script>s<style>p{}</style>t<!-- <p>no</p> -->u", ["stu"]),
    ("<title>no</title><textarea><p>no</textarea>yes<noscript>no</noscript>", ["yes"]),
    ("<a title='x > y' data-z=\"a>b\">in</a> line<a href=it's>x</a>", ["in linex"]),
    ("<p>cut <b>off<a href=\"x", ["cut off"]), ("<p>a<!-- never closed <p>b", ["a"]), ("<script>never closed <p>b", []),
    ("<div>a<span hidden>no</span>b</div><div style='display: none'>no</div>", ["ab"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("a</div></p></zzz>b", ["a", "b"]),
    ("<nav>no<div>no</nav>yes", ["yes"]), ("<P CLASS=AD>no</P><P>yes", ["yes"]),
])
def test_blocks(markup, lines):
    page = Page(markup)
    assert page.lines == lines and len(page.zones) == len(lines) and HIDDEN not in page.zones


def test_long_broken_markup_is_read_in_time():
    for piece in ("<", "<a", "<a b=\"", "<!--", "</", "&", "<p><b>", "<div>", "<script>", "<p x='"):
        Page(piece * 20000)


FRAME = """<html><body class="no-sidebar"><header><h1>Site</h1></header><nav>Menu</nav><div class="cookie-notice">We use cookies</div>
<form><p>Search</p></form><aside>Side</aside><div id="sidebar"><article class="teaser ad">Teaser</article></div>{}
<section class="comments"><article class="comment"><p>Reader says</p></article></section><footer>Foot</footer></body></html>"""


def test_parts_around_an_article(spark):
    body = "<article><header><h1>Title</h1></header><p>First.</p><div class='ad'>Buy</div><p class='section-header'>Second</p><form>Mail</form><footer>Tags</footer></article>"
    inside = {"plain": body, "wrapped": f"<div class='layout has-sidebar'>{body}</div>", "form": f"<form>{body}</form>", "main": f"<main><p>Lead-in</p>{body}</main>"}
    got = texts(spark, [(i, f"http://{n}.x/a", FRAME.format(b)) for i, (n, b) in enumerate(inside.items())])
    assert set(got.values()) == {"Title\nFirst.\nSecond"}
    got = texts(spark, [(0, "http://x/a", FRAME.format("<main><p>Only main</p></main>")), (1, "http://y/a", FRAME.format("<div id='content'><p>Named</p></div><p>not</p>")),
                        (2, "http://z/a", FRAME.format("<p>Bare</p>")), (3, "http://w/a", FRAME.format(""))])
    assert got == {0: "Only main", 1: "Named", 2: "Bare", 3: ""}


def template(i, own, host="s.example"):
    top = "<div>Home</div><div>News</div>"
    return (i, f"http://{host}/part{i % 3}/{i:03d}", f"<body>{top}{own}<div>Contact us</div></body>")


def test_lines_shared_with_the_nearest_page_go(spark):
    rng = random.Random(4)
    own = {i: "".join(f"<p>own {i} {j} {rng.random()}</p>" for j in range(6)) for i in range(30)}
    pages = [template(i, own[i]) for i in own]
    want = {i: "\n".join(re.findall("<p>(.*?)</p>", own[i])) for i in own}
    assert texts(spark, pages) == want
    # Alone in its host a page keeps all; an article keeps what it shares.
    article = [(100 + i, f"http://a.example/{i}", f"<div>Home</div><article><p>Same line</p><p>{i}</p></article>") for i in range(4)]
    alone = [template(200, own[0], "alone.example")]
    got = texts(spark, article + alone)
    assert got == {**{100 + i: f"Same line\n{i}" for i in range(4)}, 200: f"Home\nNews\n{want[0]}\nContact us"}


def test_copies_of_a_page_delete_nothing_of_it(spark):
    rng = random.Random(4)
    body = [f"line {j} {rng.random()} with some more words" for j in range(30)]
    near = [(i, f"http://c.example/{i}", "".join(f"<p>{x}</p>" for x in [*body, f"changed {i}"])) for i in range(5)]
    same = [(10 + i, f"http://d.example/{i}", "".join(f"<p>{x}</p>" for x in body)) for i in range(5)]
    got = texts(spark, near + same)
    assert got == {**{i: "\n".join([*body, f"changed {i}"]) for i in range(5)}, **{10 + i: "\n".join(body) for i in range(5)}}


def test_awkward_pages(spark):
    pages = [(None, None, None), (None, "", ""), (1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "http://[bad", "<p>b</p>"), (3, "no url", "<p>c " + "long " * 200000 + "</p>")]
    rows = spark.createDataFrame([(i, u, h, "", "", "") for i, u, h in pages], SCHEMA)
    got = sorted((r.page_id is not None, r.page_id or 0, r.text) for r in main_text(rows).collect())
    assert got == [(False, 0, ""), (False, 0, ""), (True, 1, "a"), (True, 1, "a"), (True, 2, "b"), (True, 3, ("c " + "long " * 200000).strip())]
    assert main_text(rows.limit(0)).count() == 0


def test_hosts_and_paths():
    assert host_and_path("https://User@WWW.X.org:80/a/b?c=d#e") == ("www.x.org:80", "/a/b?c=d")
    assert host_and_path(None) == ("", "")


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("cells", [CELLS, 30])
def test_alignment_is_a_longest_common_subsequence(cells, monkeypatch):
    monkeypatch.setattr("stratalake.llm.html_extract.CELLS", cells)
    rng = random.Random(cells)
    for _ in range(150):
        a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(25))] for _ in range(2))
        found = common_lines(np.array(a, np.uint64), np.array(b, np.uint64))
        held, at = [x for x, f in zip(a, found, strict=True) if f], 0
        assert len(held) == longest(a, b)
        for x in held:
            at = b.index(x, at) + 1


def test_articles_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    held = {r.page_id: r.html for r in pages.collect()}
    for r in main_text(pages).collect():
        body = re.search("<article>(.*?)</article>", held[r.page_id], re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", body)]
        assert r.text == "\n".join(x for x in lines if x)
    assert ARTICLE in Page(held[0]).zones
