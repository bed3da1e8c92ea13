"""Extraction from pages of known text, and odd pages."""

import html
import re

import pytest

from tollbridge.llm import html_text
from tollbridge.llm.queries import QUERIES

PARAGRAPHS = [f"This is sentence {i}, which is part of the article; it goes on for a while. And it ends here &amp; now." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = " ".join(html.unescape(p) for p in PARAGRAPHS)
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(8)) + "</ul>"


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{MENU}</nav><article>{BODY}</article><footer>&copy; All rights.</footer></body></html>",
    f"<body><div class='menu'>{MENU}</div><div id=content><div class=story>{BODY}</div></div><div class='ad'>Buy this, it is cheap.</div></body>",
    f"<body>{MENU}<div><script>var x='<p>no</p>';</script>{BODY}</div><div>{MENU}</div></body>",
    f"<body><header><h1>Site</h1></header><main>{BODY}<form><label>Name, please.</label><input></form><aside>See also this, and that.</aside></main></body>",
    f"<body><div class='cookie-notice'>We use cookies, as all do. Agree.</div><article>{BODY}</article><section id=comments><p>Great, thanks. I read it.</p><p>Me too, twice.</p></section></body>",
    f"<body><article>{BODY}<section class='comments'><p>Nice one, sir. Thanks.</p></section></article><div class=sidebar><p>Other, longer texts. Read on.</p></div></body>",
    f"<body><nav>{MENU}</nav><article>{BODY.replace('</p>', '')}",
    f"<!DOCTYPE html><BODY><DIV ROLE='navigation'>{MENU}</DIV><ARTICLE>{BODY}</ARTICLE><!-- <p>hidden, really.</p> --></BODY>",
    f"<body class='menu'><div id=page class='has-sidebar no-banner'><div class='with-menu'>{BODY}</div><div class='right-sidebar'><p>Read this, too.</p></div></div></body>",
    f"<body><article>{BODY}</article><p hidden>Not seen, at all.</p><div style='display: none'>Nor this, nor that.</div></body>",
])
def test_known_pages(page):
    assert html_text.extract(page) == TEXT


def test_inside_a_block():
    page = "<article><h1>A  title</h1><p>Some <b>bo</b>ld and\n\t<i>slanted</i>&nbsp;text, line<br>break &lt;b&gt; &#233;.</p><ul><li>One<li>Two</ul></article>"
    assert html_text.extract(page) == "A title Some bold and slanted text, line break <b> é. One Two"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<html><body></body></html>", "<script>x", "<!-- never closed", "</p></div>", "<nav>only a menu</nav>"])
def test_pages_without_text(page):
    assert html_text.extract(page) in ("", "<")


def test_long_page():
    assert html_text.extract("<article>" + "<p>One, two. Three.</p>" * 20_000 + "</article>") == " ".join(["One, two. Three."] * 20_000)
    assert html_text.extract("<div>" * 200_000 + "deep, very deep." + "</div>" * 200_000) == "deep, very deep."


@pytest.mark.parametrize("page, wanted", [
    (f"<body><form><nav>{MENU}</nav><article>{BODY}</article></form></body>", TEXT),
    (f"<body><form action=x>{MENU}<div>{BODY}</div></form></body>", TEXT),
    (f"<body><div class='content-sidebar-wrap'><main>{BODY}</main><div class=sidebar><p>Side, text. A long one.</p></div></div></body>", TEXT),
    (f"<body><div class='layout-sidebar-right'><div>{BODY}</div></div><div id=sidebar>{MENU}</div></body>", TEXT),
    (f"<body><div class='social-science'>{BODY}</div>{MENU}</body>", TEXT),
    (f"<article>{BODY}<p class='notice-board'>The board, as it was.</p></article>", TEXT + " The board, as it was."),
    (f"<article>{BODY}{MENU}<p>The end, of it.</p></article>", TEXT + " The end, of it."),
    (f"<article>{BODY}<ul><li>One point, plain.</li><li>Another.</li></ul></article>", TEXT + " One point, plain. Another."),
    (f"<body><article><p>A teaser.</p></article><article><p>Another.</p></article><div id=story>{BODY}</div></body>", TEXT),
    (f"<body><article>{BODY}</article><section class='comment-list'>{BODY * 30}</section></body>", TEXT),
    (f"<body><article>{BODY}</article><div class=comments><article>{BODY * 3}</article><article>Me, too.</article></div></body>", TEXT),
    ("<article>" + "<div>" * 2_000 + "<p>Deep, one.</p>" + "</div>" * 2_000 + "<p>Then, the next one.</p></article>", "Deep, one. Then, the next one."),
    ("<p>One, two.</p><svg class=i/><p>Three, four.</p><svg><path d='x'/></svg><p>Five, six.</p>", "One, two. Three, four. Five, six."),
    ("<p>One, two.</p><iframe src=x><p>Three, four.</p>", "One, two. Three, four."),
])
def test_scores_decide(page, wanted):
    """What tags and names say yields to where the content is; lists of links in an article are none of it."""
    assert html_text.extract(page) == wanted


def test_flags_change_what_is_kept(monkeypatch):
    page = f"<article>{BODY}{MENU}</article>"
    assert html_text.extract(page) == TEXT
    monkeypatch.setattr(html_text, "content_flags", lambda runs: [True] * len(runs))
    assert html_text.extract(page) != TEXT


def test_deep_pages_take_no_longer(monkeypatch):
    """Many runs below many levels, and end tags that close nothing: work in proportion to the page."""
    import time

    page = "<div>" * 20_000 + "<p>A run, of text.</p></b></li></table>" * 20_000
    started = time.process_time()
    assert html_text.extract(page).count("A run, of text.") == 20_000
    assert time.process_time() - started < 20


def test_query_against_the_article_elements(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op5_html_text"](spark, sf_dir).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        inner = page.split("<article>", 1)[1].split("</article>")[0]
        inner = re.sub(r"</?(?:p|h1)[^>]*>|<br>", " ", inner)
        wanted = " ".join(html.unescape(re.sub(r"<[^>]*>?", "", inner)).split())
        assert got[i].text == wanted and got[i].n_chars == len(wanted)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>Yes, text.</p>"), (1, None, None)], "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(df).collect()), key=str) == sorted(
        [(1, None, "", 0), (1, None, "", 0), (None, "u", "Yes, text.", 10)], key=str
    )
    assert html_text.extract_text(df.limit(0)).count() == 0
