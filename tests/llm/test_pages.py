"""Main text against a plain block list, in layouts that the labelled table doesn't hold."""

import re
import time

import pytest

from wayloom.llm import html_text

TREE = html_text.train_tree()
SAY = "a quiet morning in the valley gave way to wind and later to rain that filled the small streams below the road ".split()


def words(n, at=0):
    return " ".join((SAY * 9)[at % 20 : at % 20 + n])


def test_first_splits_go_by_words_or_links():
    first, second = TREE[0], [t[0] for t in TREE[2:] if len(t) > 1]
    assert html_text.FEATURES[first] in ("words", "links", "words_before", "words_after", "links_before", "links_after") and second


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='post-content-wrap'><div class='tags-main'><p>hello there world</p></div></div>", "hello there world"),
        ("<article><p>Prices moved on Monday after a quiet week of trade.</p><div class='share-price'><p>The share price rose</p></div></article>", "Prices moved on Monday after a quiet week of trade.\n\nThe share price rose"),
        ("<article><p>x <span class='tags'>tagged</span> y</p></article>", "x tagged y"),
        ("<article><p>a <span hidden>b</span> c <b>d<i>e</b>f</p><p>g</p></article>", "a c def\n\ng"),
        ("<article><p>one</p><p><span class='advert'>Buy this now</span></p><p>two</p></article>", "one\n\ntwo"),
        ("<article><p>one</p><div class='socialShare'><p>Send it</p></div></article>", "one"),
    ],
)
def test_text_is_kept_where_names_only_look_alike(page, text):
    assert html_text.main_text(page, TREE) == text


@pytest.mark.parametrize("seed", range(12))
def test_bare_layouts_are_told_by_words_and_links(seed):
    """No names and no telling tags: a plain rule (blocks of mostly links, and the short lines behind the last long block, are none) says what is text."""
    link = lambda n, k: f"<a href='/{k}'>{words(n, seed + k)}</a>"
    menu = [(link(1 + (seed + k) % 3, k), False) for k in range(4 + seed % 3)]
    body = [(words(20 + (seed * 11 + 17 * k) % 60, k) + ".", True) for k in range(3 + seed % 2)]
    body[1:1] = [(f"{words(15)} {link(3, seed)} {words(10)}.", True)]
    more = [(link(6 + (seed + k) % 5, k), False) for k in range(3)]
    blocks = menu + body + more + [(words(3, seed), False)] * (seed % 2)
    page = "<html><body>" + "".join(f"<div>{b}</div>" for b, _ in blocks) + "</body></html>"
    want = "\n\n".join(re.sub("<[^>]*>", "", b) for b, y in blocks if y)
    assert html_text.main_text(page, TREE) == want


def test_broken_pages_take_linear_time(spark):
    start = time.time()
    for page in ("<b>" * 60_000 + "<p>x" * 60_000, "<div>" * 60_000 + "</x>" * 60_000, "<i><div>" + "<b>" * 60_000 + "</i>" * 60_000, "<tr><td>" * 50_000, "<p><b>" * 50_000):
        html_text.blocks(page)
    assert time.time() - start < 30
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty).count() == 0
