"""Main texts: generated articles against a direct reading, the density alone, and malformed pages of any size."""

import random
import re
import time

import pyarrow.parquet as pq
import pytest

from candleforge.llm import htmltext

WORDS = "river stone light paper cloud garden winter music letter market bridge silver morning window forest".split()


def sentence(rng, least=1, most=40):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))).capitalize() + "."


def generated(seed):
    """A page and the blocks of its article, written down while it is made."""
    rng, want, parts = random.Random(seed), [], []

    def block(tag, text, inner=None):
        want.append(text)
        parts.append(f"<{tag}>{inner or text}</{tag}>")

    for _ in range(rng.randint(2, 9)):
        kind, text = rng.randrange(7), sentence(rng)
        if kind == 0:
            parts.append("<section>")
            block("h2", sentence(rng, 1, 4))
            block("p", text)
            parts.append("</section>")
        elif kind == 1:
            parts.append("<ul>")
            for _ in range(rng.randint(1, 4)):
                block("li", sentence(rng, 1, 5))
            parts.append("</ul>")
        elif kind == 2:
            block("blockquote", text)
        elif kind == 3:
            parts.append("<table><tr>")
            for _ in range(3):
                block("td", sentence(rng, 1, 3))
            parts.append("</tr></table>")
        elif kind == 4:
            block("p", text, f"<a href='/x'>{text}</a>")
        elif kind == 5:
            parts.append("<aside class=box><p>Aside of the page.</p></aside><script>if (a < b) c('</p>')</script><form>Mail <input></form>")
        else:
            block("p", text)
    title = sentence(rng, 1, 5)
    head = rng.choice([f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<div class='article-header'><h1>{title}</h1></div>"])
    outer = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><div class=x><article>", "</article></div></main>")])
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body><header class='site-header'><h1>The site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class=\"ad\">{sentence(rng)}</div>{outer[0]}{head}{''.join(parts)}{outer[1]}<section id='comments'><p>{sentence(rng, 30, 60)}</p></section><div class='sidebar'><p>{sentence(rng)}</p></div><footer>{sentence(rng)}</footer></body></html>"
    return page, [title, *want]


def test_generated_articles_are_whole():
    for seed in range(300):
        page, want = generated(seed)
        assert htmltext.main_text(page) == "\n\n".join(want), page


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>Art text</p><!-- hidden", "Art text"),
        ("<p>x</p><!doctype html", "x"),
        ("<p>x</p><?php echo 1", "x"),
        ("<p>x</p><script", "x"),
        ("<p>x</p></p", "x"),
        ("<p>one<!--a--!> two</p><p>three</p>", "one two\n\nthree"),
        ("<p>a<!-->b--c<!--->d", "ab--cd"),
        ("a < b and c > d, x </", "a < b and c > d, x </"),
        ('<article><p>Long text here</p><div class="share-price"><p>Five.</p></div><div id="notice-period"><p>Two weeks.</p></div><section class="related-work"><p>Prior art.</p></section></article>', "Long text here\n\nFive.\n\nTwo weeks.\n\nPrior art."),
        ('<article><p>Text of it.</p><section id="comments"><p>A reader says a long thing, and more.</p></section><div class="ad">buy</div><div class="related"><a href=x>more like it</a></div></article>', "Text of it."),
    ],
)
def test_open_ends_and_names(page, text):
    """What is opened and never closed is no text; one word of a name drops nothing of an article."""
    assert htmltext.main_text(page) == text


LONG = "<p>" + "Long text, word after word. " * 30 + "</p>"


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        (f"<article><section>{LONG}</section><section><p>Short one.</p></section></article>", "Short one."),
        (f"<nav><a>x</a></nav><div id=wrap><div id=main>{LONG}{LONG}</div><ul><li>item one<li>item two</ul><p>Closing words.</p></div><footer>f</footer>", "item two\n\nClosing words."),
        (f"<article><h1>T</h1>{LONG}<p><a href=x>See the full report here</a></p></article>", "See the full report here"),
        (f'<article><div class="article-header"><h1>Title</h1></div>{LONG}</article>', "Title"),
        (f"<div class=content><header><h1>Title</h1></header>{LONG}{LONG}</div><footer>foo</footer>", "Title"),
        (f'<article><p class="notice">Take notice.</p>{LONG}</article>', "Take notice."),
        (f'<p class="a"">First text</p>{LONG}', "First text\n\n"),
        (f'<p class="a>First text</p>{LONG}<p class="b">x', "First text\n\n"),
        ("<div>" * 600 + LONG + "</div>" * 599 + "<p>Tail text</p></div>", "Tail text"),
        (f"<form action=x><div class=with-sidebar><article><h1>T</h1>{LONG}</article></div></form>", "T\n\nLong"),
    ],
)
def test_parts_of_an_article_stay(page, kept):
    text = htmltext.main_text(f"<body>{page}</body>")
    assert kept in text and "Long text" in text and "<" not in text and "class=" not in text and "foo" not in text


def test_density_alone_finds_the_article():
    """Without hints, and on pages whose elements are all ``div`` without names, the densities still choose the article."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    alone = nameless = long = 0
    for page in pages:
        want = htmltext.main_text(page)
        alone += htmltext.main_text(page, hints=False) == want
        if len(want) > 600:
            long += 1
            nameless += htmltext.main_text(re.sub(r"<(/?)(?:article|nav|footer)", r"<\1div", page).replace(' class="ad"', ""), hints=False) == want
    assert alone > 0.9 * len(pages) and nameless > 0.95 * long and long > 100


@pytest.mark.parametrize("page", ["<a " * 1_500_000, "<a " * 1_500_000 + ">", '<a b="' * 500_000 + ">", "<" * 5_000_000, "<header>" * 40_000 + "x", "<p><b>" * 100_000, "<ul><li>" * 50_000, "<div class=x>" * 100_000 + "</span>" * 100_000, "<b>" * 100_000 + "<p>" + "</b>" * 100_000, "<table><tr><td>" * 30_000, "<!--" * 1_000_000, "<script>" + "x</scrip" * 500_000])
def test_malformed_pages_take_linear_time(page):
    began = time.perf_counter()
    htmltext.main_text(page)
    assert time.perf_counter() - began < 20


def test_tables_of_pages(spark):
    rows = [(1, "u", "<p>a</p>", "x", 3), (1, "u", "<p>a</p>", "x", 3), (None, None, "<p>b", "x", 3), (2, "v", None, "x", 3), (3, "v", "", "x", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted((tuple(r) for r in htmltext.main_texts(pages).collect()), key=str) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "b", 1), (2, "v", "", 0), (3, "v", "", 0)], key=str)
    assert htmltext.main_texts(pages.limit(0)).count() == 0
