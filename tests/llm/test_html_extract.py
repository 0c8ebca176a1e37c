"""Planted pages with known main text."""

import html

import random

import numpy as np
import pytest

from cairnlake.llm import html_extract
from cairnlake.llm.html_extract import extract, main_text


def test_article_among_boilerplate():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a>More</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Title &amp; more</h1><p>First   para&shy;graph <b>bold<br><p>Second\n paragraph</p><p>No.</p><div class="ad">Buy</div>
    <aside>See also</aside><form><p>Mail?</p></form><ul><li>one<li>two</ul><section id="comments"><p>Nice post!</p></section></article>
    <div class="sidebar">Links</div><footer>&copy; us</footer></body></html>"""
    assert main_text(page).split("\n") == ["Title & more", "First para\xadgraph bold", "Second paragraph", "No.", "one", "two"]


def test_without_an_article_element():
    body = "".join(f"<p>{'some longer words of the story ' * 5}{i}</p>" for i in range(6))
    page = f"<body><div id='nav'>a b</div><div class='wrap'><div class='story'><h2>Head</h2>{body}<p>End.</p></div><div><a>x</a> <a>y</a></div></div></body>"
    lines = main_text(page).split("\n")
    assert lines[0] == "Head" and lines[-1] == "End." and len(lines) == 8


def test_comments_as_articles_do_not_win():
    page = "<article><p>Short.</p></article>" + "".join(f"<article class='comment'><p>{'words ' * 50}</p></article>" for _ in range(3))
    assert main_text(page) == "Short."


def test_marks_beside_words_of_the_article():
    text = "Sentences of the article with some more words. " * 4
    page = f"<div class='menu-list'>A</div><article><div class='article-header'><h1>Head</h1></div><p>{text}</p><p class='legal'>{text}</p><div class='share-price'>9.50</div><div class='share-box'>Share</div></article>"
    assert main_text(page).split("\n") == ["Head", text.strip(), text.strip(), "9.50"]
    two = f"<body><article><h2>One</h2><p>{text}</p></article><article><h2>Two</h2><p>{text}</p></article></body>"
    assert main_text(two).split("\n") == ["One", text.strip(), "Two", text.strip()]


def planted(rng: random.Random, layout: str) -> tuple[str, list[str]]:
    """A page whose boilerplate has no marks, and the lines of its article."""
    words = lambda a, b: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(rng.randrange(a, b)))
    lines = [words(3, 8)] + [words(30, 120) for _ in range(rng.randrange(3, 9))]
    lines.insert(rng.randrange(2, len(lines)), words(1, 4))
    links = lambda n: "<div>" + "".join(f"<a href='/{i}'><b>{words(1, 3)}</b></a> <br>" for i in range(n)) + "</div>"
    teaser = f"<article><a href='/t'><b><i>{words(2, 4)}</i></b></a></article>"
    inner = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:])
    half = len(lines) // 2
    parts = f"<div><h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:half]) + "</div><div>" + "".join(f"<p>{x}</p>" for x in lines[half:]) + "</div>"
    body = {
        "article": f"<article>{inner}</article>", "teasers": f"{teaser * 3}<main>{inner}</main>{teaser * 2}", "div": f"<div><div>{inner}</div></div>",
        "body": inner, "siblings": f"<div>{parts}</div>", "table": f"<table><tr><td>{links(4)}</td><td>{inner}</td></tr></table>",
    }[layout]
    return f"<html><body>{links(rng.randrange(3, 12))}{body}{links(rng.randrange(3, 9))}</body></html>", lines


def counts(layout: str, n: int = 60) -> tuple[int, int, int]:
    """(lines of articles found, lines of articles, lines found) over n planted pages."""
    rng, hits, wanted, got = random.Random(layout), 0, 0, 0
    for _ in range(n):
        page, lines = planted(rng, layout)
        found = main_text(page).split("\n")
        hits, wanted, got = hits + len(set(found) & set(lines)), wanted + len(lines), got + len(found)
    return hits, wanted, got


@pytest.mark.parametrize("layout", ["article", "teasers", "div", "body", "siblings", "table"])
def test_precision_and_recall_without_marks(layout):
    hits, wanted, got = counts(layout)
    assert hits >= 0.98 * wanted and hits >= 0.98 * got, (hits / wanted, hits / got)


def test_clusters_decide(monkeypatch):
    before = counts("div")
    monkeypatch.setattr(html_extract, "content_lines", lambda lines: (np.ones(len(lines), dtype=bool),) * 2)
    hits, _, got = counts("div")
    assert before[0] >= 0.98 * before[2] and hits < 0.8 * got


def test_repeated_rows(spark):
    rows = [(1, "<article><p>Same</p></article>")] * 3 + [(None, None)]
    assert sorted(r.text for r in extract(spark.createDataFrame(rows, "page_id long, html string")).collect()) == ["", "Same", "Same", "Same"]


def test_empty_broken_and_long_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<p>a<p>b</div></b></p><b>c") == "a\nb\nc"
    words = "word " * 200_000
    assert main_text(f"<article><p>{words}</p></article>") == words.strip()
    assert main_text("<div>" * 3000 + "deep") == "deep"


def test_round_trip_of_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()
    pages = []
    for d in docs:
        lines = [x for x in d.text.split("\n") if x.strip()]
        pages.append((d.doc_id, "u", f"<nav>menu</nav><article><h1>{html.escape(lines[0])}</h1>" + "".join(f"<p>{html.escape(x)}</p>" for x in lines[1:]) + "</article>", 5))
    got = {r.page_id: r for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string, n_chars int")).collect()}
    for d in docs:
        expect = "\n".join(" ".join(x.split()) for x in d.text.split("\n") if x.strip())
        assert got[d.doc_id].text == expect and got[d.doc_id].n_chars == len(expect)


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, html string")).collect() == []
