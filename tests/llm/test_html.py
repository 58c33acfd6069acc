"""Main text of pages with and without names, against the article cut out of
the given pages by patterns."""

from __future__ import annotations

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from retainlab.llm import html_blocks as H

PAGES = "/root/testdata/sf0.01/pages.parquet"
TREE = H.train()


def article(page: str) -> str:
    """The text between the article tags of a given page."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)
    text = re.sub(r"</?b>", "", inner[1]) if inner else ""
    return " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", text)).split())


def without_names(page: str, tree: H.Tree) -> str:
    found = H.blocks(page)
    x = H.features(found)
    x[:, H.HINTS] = 0
    return " ".join(b.text for b, row in zip(found, x) if tree.accepts(row))


@pytest.fixture(scope="module")
def pages():
    return pq.read_table(PAGES, columns=["html"]).column("html").to_pylist()


def test_given_pages(pages):
    assert all(H.main_text(p, TREE) == article(p) for p in pages)


@pytest.mark.parametrize("tree", [TREE, H.train(hints=False)], ids=["blind view", "never named"])
def test_given_pages_without_names(pages, tree):
    right = sum(without_names(p, tree) == article(p) for p in pages)
    assert right >= 0.95 * len(pages)


def test_other_tags_for_the_given_pages(pages):
    """Plain ``div`` for every tag and class that names a part."""
    for p in pages:
        plain = re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", p).replace(' class="ad"', "")
        assert H.main_text(plain, TREE) == article(p)


def words(n: int) -> str:
    return " ".join(["One"] + ["more"] * (n - 2) + ["end."]) if n > 1 else "One."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><p>{words(56)}</p></body>", words(56)),
        (f"<article><h1>Title</h1><p>{words(40)}</p></article>", f"Title {words(40)}"),
        (f"<h1>Title</h1><p>{words(12)}</p><p>{words(70)}</p>", f"Title {words(12)} {words(70)}"),
        (f"<article><h1>Title</h1><p>{words(50)}</p><div class='share-text'><p>{words(60)}</p></div><p>{words(30)}</p></article>", f"Title {words(50)} {words(60)} {words(30)}"),
        (f"<article><h1>Title</h1><p>{words(50)}</p></article><div><p>{words(45)}</p></div>", f"Title {words(50)}"),
        (f"<main><p>{words(50)}</p></main><aside><p>{words(40)}</p></aside>", words(50)),
        (f"<div class=comments><p>{words(30)}</p></div>", ""),
        ("<p></p> <br>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_pages_by_hand(page, want):
    assert H.main_text(page, TREE) == want


def test_reading_is_linear_in_nesting():
    for page in ("<div>" * 20_000 + "x", "<div><p>a" * 10_000 + "</section>" * 20_000, "<div>" * 10_000 + "</ul>" * 10_000 + "</div>" * 10_000):
        start = time.perf_counter()
        H.blocks(page)
        assert time.perf_counter() - start < 1.5


def test_containers_close_the_innermost_of_their_name():
    found = H.blocks("<nav><div><ul><li>a</nav>b<article><aside>c</article>d<section><div class=ad>e</section>f</div>g")
    assert [(b.text, b.beside, b.main) for b in found] == [
        ("a", 1, 0), ("b", 0, 0), ("c", 1, 1), ("d", 0, 0), ("e", 1, 0), ("f", 0, 0), ("g", 0, 0),
    ]


def test_a_very_long_page():
    page = f"<nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>{words(200)}</p><p>{words(300_000)}</p></article>"
    assert H.main_text(page, TREE) == f"Title {words(200)} {words(300_000)}"
