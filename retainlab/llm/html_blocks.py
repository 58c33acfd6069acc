"""Main text of web pages by a decision tree over flat text blocks.

A page is read once from left to right. Block-level tags cut its visible text
into flat blocks; scripts, styles, comments and form controls have none. Each
block has features: its words and link density and those of its neighbours on
either side, its own tag, whether a heading came before it, and, as hints that
may be missing, the kind of the containers it stands in. A decision tree,
trained here on the small labelled tables below, says which blocks belong to
the article; these are joined in page order by one space. Pages that can be
told without names count as they are and once more without their hints, so that
pages that name nothing are judged by words, links and neighbours alone.

Reading is linear in the page: a container knows the hints of those around it,
and a closing tag that closes nothing is not searched for.

Null or empty html, or a page without article blocks, gives an empty text.
Unclosed tags and broken markup are read as they come. Repeated rows get the
same text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, chunks, load, small_batches

#: elements whose content is never visible text of a page
SKIPPED = frozenset("script style noscript template title textarea select button svg iframe object canvas math audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("html body div section article main nav aside header footer form fieldset ul ol dl table figure blockquote details".split())
#: words of tag names, classes, ids and roles that say what a container holds
BESIDE = frozenset(
    "nav navbar navigation menu footer aside sidebar form ad ads advert adverts advertisement advertising sponsor sponsored "
    "promo promotion comment comments reply replies respond cookie cookies consent notice notices alert banner related recommended share "
    "sharing social newsletter subscribe subscription breadcrumb breadcrumbs popup modal widget copyright pagination "
    "pager login signup search toolbar masthead topbar disclaimer tags reactions disqus contentinfo complementary".split()
)
MAIN = frozenset("article main content post entry story".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>?")
_HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
FEATURES = "words links words_before links_before words_after links_after heading item paragraph headed stops mark beside main apart".split()
#: features that need names of tags, classes, ids or roles
HINTS = [FEATURES.index(f) for f in ("beside", "main", "apart")]
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


@dataclass
class Block:
    at: int
    text: str
    words: int
    linked: int
    beside: int  # containers around it that hold other things than the article
    main: int
    tag: str


def _kind(tag: str, attributes: str) -> int:
    """-1: beside the article, 1: the article, 0: either."""
    hints = {tag}
    for m in _HINT.finditer(attributes):
        hints.update(_WORD.findall((m[1] or m[2] or m[3] or "").lower()))
    if hints & BESIDE:
        return -1
    return int(bool(hints & MAIN))


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # open containers with ``beside`` and ``main`` inside them
    count: dict[str, int] = {}  # open containers by name
    pieces: list[str] = []
    linked: list[str] = []
    in_link = False
    at, tag, beside, main = 0, "body", 0, 0

    def close() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(at, text, text.count(" ") + 1, len("".join(linked).split()), beside, main, tag))
        pieces.clear()
        linked.clear()

    pos, n = 0, len(page)
    while pos < n:
        lt = page.find("<", pos)
        end = n if lt < 0 else lt
        if end > pos:
            piece = entities.unescape(page[pos:end])
            if not pieces:
                at = pos
            pieces.append(piece)
            if in_link:
                linked.append(piece)
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            pos = n if stop < 0 else stop + 3
            continue
        m = _TAG.match(page, lt)
        if not m:
            if page.startswith(("<!", "<?", "</"), lt):
                stop = page.find(">", lt)
                pos = n if stop < 0 else stop + 1
            else:  # a bare sign
                pieces.append("<")
                pos = lt + 1
            continue
        pos = m.end()
        closing, name = m[1], m[2].lower()
        if name in SKIPPED and not closing:
            if not m[0].endswith("/>"):
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
                pos = stop.end() if stop else n
            continue
        if name == "a":
            in_link = not closing
            linked.append(" ")
        if name in INLINE:
            if name == "br":
                pieces.append(" ")
            continue
        close()
        tag = name if not closing else "body"
        if name == "header" and not closing and main:
            continue  # an article's own header
        if name in CONTAINERS:
            if not closing:
                kind = _kind(name, m[3])
                if kind == 1:
                    beside, main = 0, main + 1
                elif kind == -1:
                    beside += 1
                stack.append((name, beside, main))
                count[name] = count.get(name, 0) + 1
            elif count.get(name):
                last = ""
                while last != name:
                    last = stack.pop()[0]
                    count[last] -= 1
                beside, main = stack[-1][1:] if stack else (0, 0)
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)))
    if not found:
        return x
    words = np.array([b.words for b in found], float)
    links = np.array([min(1.0, b.linked / b.words) for b in found])
    x[:, 0], x[:, 1] = words, links
    x[1:, 2], x[1:, 3] = words[:-1], links[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], links[1:]
    x[:, 6] = heading = np.array([b.tag in HEADINGS for b in found])
    x[:, 7] = [b.tag == "li" for b in found]
    x[:, 8] = [b.tag == "p" for b in found]
    x[:, 9] = np.logical_or.accumulate(heading)
    x[:, 10] = [(b.text.count(".") + b.text.count("!") + b.text.count("?")) / b.words for b in found]
    x[:, 11] = [b.text.startswith("©") or "©" in b.text and b.words < 25 for b in found]
    x[:, 12] = [b.beside for b in found]
    x[:, 13] = [b.main for b in found]
    named = any(b.main and not b.beside for b in found)
    x[:, 14] = [named and not b.main for b in found]  # outside what the page calls its article
    return x


class Tree:
    """A binary decision tree grown on the Gini index."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2):
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        here = len(self.nodes)
        share = float(y.mean()) if len(y) else 0.0
        self.nodes.append((-1, 0.0, -1, -1, share))
        best = (2 * share * (1 - share) * len(y) - 1e-9, -1, 0.0)
        for j in range(x.shape[1] if depth and 0 < share < 1 else 0):
            values = np.unique(x[:, j])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, j] <= cut
                n, p = left.sum(), y[left].mean()
                if min(n, len(y) - n) < least:
                    continue
                q = y[~left].mean()
                cost = 2 * n * p * (1 - p) + 2 * (len(y) - n) * q * (1 - q)
                if cost < best[0]:
                    best = (cost, j, float(cut))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            lo = self._grow(x[left], y[left], depth - 1, least)
            hi = self._grow(x[~left], y[~left], depth - 1, least)
            self.nodes[here] = (best[1], best[2], lo, hi, share)
        return here

    def accepts(self, row: np.ndarray) -> bool:
        k = 0
        while self.nodes[k][0] >= 0:
            j, cut, lo, hi, _ = self.nodes[k]
            k = lo if row[j] <= cut else hi
        return self.nodes[k][4] >= 0.5


def _prose(n: int) -> str:
    """``n`` words in sentences of at most 12."""
    return " ".join("Word" if i % 12 == 0 else "word." if i % 12 == 11 else "word" for i in range(n))


def _menu(n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">Item</a></li>' for i in range(n)) + "</ul>"


#: labelled pages as rows of (label, fragment); "+" is article text. In these a
#: box of other text looks like a paragraph and only its name tells
NAMED: list[list[tuple[str, str]]] = [
    [("-", f"<header><h1>Site</h1>{_menu(4)}</header>"), ("+", f"<main><h1>{_prose(8)}</h1><p>{_prose(30)}</p><p>Word.</p><ul><li>{_prose(9)}</li><li>{_prose(7)}</li></ul><p>{_prose(60)}</p></main>"), ("-", f'<aside class="sidebar"><h2>More</h2><p>{_prose(25)}</p>{_menu(5)}</aside><footer><p>{_prose(20)}</p></footer>')],
    [("-", '<div id="menu">' + _menu(8) + f'</div><div class="cookie-notice"><p>{_prose(30)}</p></div>'), ("+", f'<div class="content"><h2>{_prose(4)}</h2><p>{_prose(50)}</p><p>{_prose(2)}</p><p>{_prose(14)} <a href="/x">word word</a> {_prose(9)}</p></div>'), ("-", f'<div class="comments"><p>{_prose(40)}</p><p>{_prose(12)}</p></div><form><p>{_prose(8)}</p></form>')],
    [("-", f'<div class="banner">{_prose(15)}</div>'), ("+", f"<article><p>{_prose(12)}</p><p>{_prose(1)}</p>"), ("-", f'<div class="ad">{_prose(20)}</div>'), ("+", f"<p>{_prose(25)}</p>"), ("-", f'<div class="related">{_menu(3)}<p>{_prose(18)}</p></div>'), ("+", f"<p>{_prose(33)}</p></article>"), ("-", f'<section class="comments"><h3>Replies</h3><p>{_prose(50)}</p></section><footer>{_prose(6)}</footer>')],
    [("-", f'<div class="newsletter"><p>{_prose(22)}</p></div>'), ("+", f"<div><p>{_prose(90)}</p><p>{_prose(28)}</p><blockquote>{_prose(16)}</blockquote></div>"), ("-", '<div><a href="/1">Next</a></div><div><a href="/2">Word word word</a></div>'), ("-", f'<div class="social"><p>{_prose(6)}</p></div>')],
    [("-", f'<header><p>{_prose(6)}</p></header><div class="alert">{_prose(11)}</div>'), ("+", f"<article><header><h1>{_prose(6)}</h1></header><p>{_prose(40)}</p><table><tr><td>{_prose(3)}</td><td>{_prose(4)}</td></tr></table></article>"), ("-", f"<aside>{_prose(30)}</aside><footer>{_menu(3)}<p>© {_prose(9)}</p></footer>")],
    [("-", f"<nav>{_menu(5)}</nav>"), ("+", f'<article><h1>{_prose(6)}</h1><p>{_prose(41)}</p><div class="share-text"><p>{_prose(58)}</p><p>{_prose(72)}</p></div><p>{_prose(26)}</p></article>'), ("-", f"<div><p>{_prose(44)}</p><p>{_prose(31)}</p></div><footer>© {_prose(5)}</footer>")],
    [("+", f"<main><p>{_prose(39)}</p><p>{_prose(13)}</p></main>"), ("-", f"<div><p>{_prose(35)}</p></div><div>{_prose(24)}</div>")],
]
#: in these words, links, neighbours and headings tell; names may be absent
UNNAMED: list[list[tuple[str, str]]] = [
    [("-", "<nav>" + _menu(6) + '</nav><div class="ad">' + _prose(9) + "</div>"), ("+", f"<article><h1>{_prose(5)}</h1><p>{_prose(80)}</p><p>{_prose(3)}</p><p>{_prose(45)}</p></article>"), ("-", f"<footer>&copy; Site &middot; {_prose(10)}</footer>")],
    [("-", f'<p><a href="/">Home</a> | <a href="/b">News</a> | <a href="/c">About</a></p><p><a href="/d">{_prose(6)}</a></p>'), ("+", f"<h1>{_prose(7)}</h1><p>{_prose(70)}</p><p>{_prose(35)}</p><p>{_prose(5)}</p><p>{_prose(40)}</p>"), ("-", '<p><a href="/e">Terms</a> <a href="/f">Privacy</a></p><p>© 2020 Site | all rights reserved</p>')],
    [("-", f"<nav>{_menu(3)}</nav>"), ("+", f"<article><h1>Word</h1><p>{_prose(2)}</p></article>"), ("-", f"<footer>{_prose(4)}</footer>")],
    [("+", f"<body><p>{_prose(56)}</p></body>")],
    [("+", f"<article><h1>{_prose(3)}</h1><p>{_prose(64)}</p><p>{_prose(21)}</p></article>"), ("-", f"<footer>&copy; {_prose(7)}</footer>")],
    [("+", f"<h1>{_prose(2)}</h1><p>{_prose(18)}</p><p>{_prose(7)}</p>")],
    [("+", f"<h2>{_prose(6)}</h2><p>{_prose(4)}</p><p>{_prose(75)}</p>"), ("-", f"<div>{_menu(5)}</div><div>© {_prose(8)}</div>")],
    [("+", f"<p>{_prose(3)}</p><p>{_prose(48)}</p><p>{_prose(1)}</p>"), ("-", f"<div>&copy; {_prose(12)}</div>")],
    [("+", f"<body>{_prose(66)}<br><br>{_prose(30)}</body>")],
    [("+", f"<div>{_prose(58)}</div><div>{_prose(44)}</div><div>{_prose(62)}</div>"), ("-", f"<div>{_menu(4)}</div>")],
    [("+", f"<p>{_prose(10)}</p>")],
    [("-", f"<div>{_menu(6)}</div><div>{_prose(11)}</div>"), ("+", f"<div><h1>{_prose(9)}</h1><p>{_prose(37)}</p><p>{_prose(2)}</p><p>{_prose(52)}</p></div>"), ("-", f"<div>&copy; Site &middot; {_prose(13)}</div>")],
    [("-", f"<div>{_menu(3)}</div><div>{_prose(6)}</div>"), ("+", f"<h1>{_prose(4)}</h1><p>{_prose(1)}</p><p>{_prose(5)}</p>"), ("-", f"<div>{_prose(5)} © Site</div>")],
    [("-", f"<div>{_menu(7)}</div><div>{_prose(17)}</div>"), ("+", f"<h1>{_prose(12)}</h1><p>{_prose(95)}</p><p>{_prose(8)}</p><p>{_prose(3)}</p>"), ("-", f"<div>© Site {_prose(19)}</div>")],
]


def train(hints: bool = True) -> Tree:
    """The tree of the labelled tables; each block has the label of the
    fragment it begins in. Without ``hints`` it never sees a name."""
    xs, ys = [], []
    for rows, views in [(r, (True, False)) for r in UNNAMED] + [(r, (True,)) for r in NAMED]:
        ends = np.cumsum([len(fragment) for _, fragment in rows])
        found = blocks("".join(fragment for _, fragment in rows))
        for view in views:
            if hints or not view:
                x = features(found)
                if not view:
                    x[:, HINTS] = 0
                xs.append(x)
                ys += [rows[int(np.searchsorted(ends, b.at, side="right"))][0] == "+" for b in found]
    return Tree(np.concatenate(xs), np.array(ys, float))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if tree.accepts(row))


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and the main ``text`` of each page."""
    small_batches(spark)
    tree = train()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, u, main_text(h, tree)) for i, u, h in arrow_rows(batches, "page_id", "url", "html"))
        yield from chunks(rows, schema, 500)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(spark, load(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
