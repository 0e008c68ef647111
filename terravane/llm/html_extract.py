"""Main-text extraction: flat text blocks classified by a decision tree.

A page is cut into flat text blocks at block-level tags. Each block has its word count and link
density, those of its neighbours, and three marks of its place (inside an article element, inside
a menu, header, footer, sidebar, notice, advert, form or comment container, and whether the page
has an article at all). A decision tree, grown here from a small labelled table of such blocks,
keeps or drops each block; the kept ones are joined in page order by one newline.

Defined results: a null or empty page gives the empty text; broken markup (unclosed tags, stray
signs, unended comments or scripts) is read to its end; character references are decoded, also
without semicolons as HTML5 has them; any white space inside a block becomes one space; nothing
else is dropped or capped; repeated rows each get a result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices

# Elements whose content is never text of the page, elements that stay inside a block,
# elements and roles that hold no main text or hold it, and the words of class and id names that tell the same.
RAW = "script style title textarea noscript template svg iframe object select button canvas math video audio".split()
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr link meta".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = set("nav aside footer form dialog menu head".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note".split())
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets related recommended "
    "recommendations share sharing social cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin comment comments "
    "commentlist disqus replies reply respond footer masthead toolbar pagination pager skip banner disclaimer copyright search form".split()
)
WEAK_ASIDE_WORDS = set("header side meta head topbar".split())
MAIN = {"article", "main"}
MAIN_ROLES = {"main", "article"}
MAIN_WORDS = set("article post entry story maincontent articlebody".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{'|'.join(RAW)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*+(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")

#: A small labelled table of blocks, made by hand from common page layouts. Columns: words, link density,
#: words and link density of the block before, the same of the block after, in an article, in a side container, page has an article, heading; kept.
LABELLED = """
  6 0.0   0 0.0  80 0.0  1 0 1 1  1
 80 0.0   6 0.0  60 0.0  1 0 1 0  1
  1 0.0  40 0.0  30 0.0  1 0 1 0  1
  2 0.0   5 0.0   3 1.0  1 0 1 0  1
  9 0.9   3 0.0   2 1.0  1 0 1 0  1
  1 0.0   0 0.0   0 0.0  1 0 1 1  1
 20 0.0   1 1.0   6 0.0  1 0 1 0  1
 70 0.0  30 0.0  10 0.0  1 0 1 0  1
 25 0.6  40 0.0  40 0.0  1 0 1 0  1
  3 1.0  50 0.0  20 0.0  1 0 1 0  1
 12 0.1   1 1.0   0 0.0  1 0 1 0  1
  1 1.0   0 0.0   1 1.0  0 1 1 0  0
  1 1.0   1 1.0   5 0.0  0 1 1 0  0
  5 0.0   1 1.0   8 0.0  0 1 1 0  0
 40 0.0   5 0.0  90 0.0  0 1 1 0  0
 90 0.0  60 0.0  40 0.0  0 1 1 0  0
 10 0.0  70 0.0   0 0.0  0 1 1 0  0
 30 0.1  50 0.0  12 0.5  1 1 1 0  0
  8 0.0  50 0.0  20 0.0  1 1 1 0  0
  4 0.0  50 0.0  20 0.0  1 1 1 1  0
 60 0.0  50 0.0  20 0.0  1 1 1 0  0
  5 0.0   0 0.0   6 0.0  0 0 1 0  0
 25 0.0   0 0.0   6 0.0  0 0 1 0  0
 60 0.0  30 0.0   6 0.0  0 0 1 0  0
  4 0.0   1 1.0   7 0.0  0 0 1 1  0
  8 0.0  80 0.0   0 0.0  0 0 1 0  0
 20 0.0  10 0.0  40 0.0  0 0 1 0  0
 60 0.0   4 0.0  30 0.0  0 0 1 0  0
  3 0.0   0 0.0  80 0.0  0 0 1 0  0
 12 0.0  20 0.0  15 0.0  0 0 1 0  0
  5 0.0   2 1.0  25 0.0  0 0 1 1  0
 30 0.0  40 0.0  60 0.0  0 0 1 0  0
  2 1.0   2 1.0   2 1.0  0 1 0 0  0
 35 0.0   4 0.0  40 0.0  0 1 0 0  0
 12 0.0  60 0.0   0 0.0  0 1 0 0  0
  5 0.0   2 1.0  70 0.0  0 1 0 1  0
 70 0.0   6 0.0  60 0.0  0 0 0 0  1
 40 0.0  60 0.0  30 0.1  0 0 0 0  1
 25 0.1  40 0.0  50 0.0  0 0 0 0  1
 18 0.0  40 0.0  45 0.0  0 0 0 0  1
 16 0.2   3 1.0  45 0.0  0 0 0 0  1
  6 0.0   2 1.0  50 0.0  0 0 0 1  1
  4 0.0  30 0.0  35 0.0  0 0 0 1  1
  8 0.0  50 0.0  40 0.0  0 0 0 0  1
  4 0.0  40 0.0  30 0.0  0 0 0 0  1
 60 0.0  50 0.0   0 0.0  0 0 0 0  1
 45 0.0   3 0.0   8 0.0  0 0 0 0  1
 90 0.0   6 0.0   2 1.0  0 0 0 0  1
 30 0.1  20 0.0   3 1.0  0 0 0 0  1
 55 0.0   0 0.0   0 0.0  0 0 0 0  1
 22 0.0  30 0.0  12 0.0  0 0 0 0  1
  2 1.0   2 1.0   3 1.0  0 0 0 0  0
  3 1.0  60 0.0   2 1.0  0 0 0 0  0
 12 0.8   3 1.0   4 1.0  0 0 0 0  0
 20 0.7  30 0.0  10 1.0  0 0 0 0  0
 30 0.9  40 0.0  20 0.9  0 0 0 0  0
  5 0.0   3 1.0   2 1.0  0 0 0 0  0
  6 0.0   2 0.5   4 0.0  0 0 0 0  0
  3 0.0   3 0.0   5 0.5  0 0 0 0  0
 24 0.8   4 0.0  60 0.0  0 0 0 0  0
  2 1.0  50 0.0  60 0.0  0 0 0 0  0
  4 0.0   2 1.0   3 1.0  0 0 0 1  0
  7 0.2   5 0.5   0 0.0  0 0 0 0  0
  6 0.0  25 0.0  18 0.0  0 0 0 0  1
 10 0.0  14 0.0  22 0.0  0 0 0 0  1
  3 0.0  20 0.0   9 0.0  0 0 0 0  1
 15 0.0  10 0.0  12 0.0  0 0 0 0  1
  1 0.0  12 0.0  40 0.0  0 0 0 0  1
 20 0.0   7 0.0  15 0.0  0 0 0 0  1
  9 0.0  35 0.0   5 0.0  0 0 0 0  1
 12 0.0   6 0.0  18 0.0  0 0 0 0  1
 18 0.0  16 0.0   8 0.0  0 0 0 0  1
  9 0.0   2 1.0   6 0.0  0 0 0 0  0
 14 0.0   1 1.0   8 0.0  0 0 0 0  0
 11 0.0   3 1.0  10 0.0  0 0 0 0  0
  9 0.0  45 0.0   0 0.0  0 0 0 0  0
 16 0.0  20 0.0   0 0.0  0 0 0 0  0
  6 0.0  12 0.0   0 0.0  0 0 0 0  0
  8 0.0   2 1.0  20 0.0  0 0 0 1  1
  4 0.0  11 0.0  25 0.0  0 0 0 1  1
"""


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: a label, or (column, threshold, tree below or at it, tree above)."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best, cut = 2 * share * (1 - share) * len(y) - 1e-9, None
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, c] <= t
            score = sum(2 * p * (1 - p) * len(g) for g in (y[low], y[~low]) for p in (g.mean(),))
            if score < best:
                best, cut = score, (c, t)
    if cut is None:
        return int(share >= 0.5)
    low = x[:, cut[0]] <= cut[1]
    return (*cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@lru_cache(1)
def trained():
    rows = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return grow(rows[:, :-1], rows[:, -1])


def decide(tree, x) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _place(tag: str, attrs: str) -> int:
    """1: the element holds main text; -1: it holds none; 0: neither is told."""
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)} if "=" in attrs else {}
    role = named.get("role", "").lower()
    if tag in ASIDE or role in ASIDE_ROLES or named.get("aria-hidden") == "true" or re.search(r"(?i)(?:^|\s)hidden(?:\s|=|$)", attrs) or re.search(r"display\s*:\s*none", named.get("style", "")):
        return -1
    words = {w.lower() for k in ("class", "id") for w in PARTS.findall(named.get(k, ""))}
    if words & ASIDE_WORDS:
        return -1
    if tag in MAIN or role in MAIN_ROLES or words & MAIN_WORDS:
        return 1
    return -2 if tag == "header" or words & WEAK_ASIDE_WORDS else 0


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """Flat blocks: text, words, words in links, in an article, in a side container, heading."""
    out: list[tuple] = []
    stack: list[tuple[str, int]] = []
    pieces: list[str] = []
    links, in_link, heading = 0, 0, False
    main = side = 0

    def flush() -> None:
        nonlocal links
        text = SPACE.sub(" ", "".join(pieces)).strip()
        pieces.clear()
        if text:
            out.append((text, text.count(" ") + 1, min(links, text.count(" ") + 1), main > 0, side > 0, heading))
        links = 0

    def pop() -> str:
        nonlocal main, side
        tag, place = stack.pop()
        main -= place == 1
        side -= place < 0
        return tag

    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if in_link:
                links += len(text.split())
            continue
        if m["tag"] is None:
            if m["raw"] and m["raw"].lower() not in ("button", "canvas", "math", "svg"):
                pieces.append(" ")
            continue
        tag, end, attrs = m["tag"].lower(), m["end"], m["attrs"]
        if tag in INLINE and tag not in VOID and not end and attrs and _place(tag, attrs) == -1 and not attrs.endswith("/"):
            stack.append((tag, -1))  # an inline element that is marked as no text, such as a hidden span
            flush()
            side += 1
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                in_link = 0 if end else 1
            elif end and stack and stack[-1][0] == tag:
                flush()
                pop()
            continue
        flush()
        if re.fullmatch("h[1-6]", tag):
            heading = not end
        if end:
            if any(t == tag for t, _ in stack):
                while pop() != tag:
                    pass
            continue
        if stack and stack[-1][0] == "p":
            pop()
        if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            pop()
        if tag == "body":
            stack.clear()
            main = side = 0
        if tag not in VOID and not attrs.endswith("/"):
            place = 0 if tag in ("html", "body") else _place(tag, attrs)
            if place == -2:
                place = 0 if main else -1  # a header inside an article belongs to it
            stack.append((tag, place))
            main += place == 1
            side += place < 0
    flush()
    return out


def extract(page: str | None) -> str:
    found = blocks(page or "")
    has_main = any(b[3] and not b[4] for b in found)
    size = [(b[1], b[2] / b[1]) for b in found]
    edge = (0, 0.0)
    tree = trained()
    kept = []
    for i, (text, _, _, main, side, heading) in enumerate(found):
        before, after = size[i - 1] if i else edge, size[i + 1] if i + 1 < len(size) else edge
        if decide(tree, (*size[i], *before, *after, main, side, has_main, heading)):
            kept.append(text)
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, html_column: str = "html", out_column: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns and out_column: the main text of each page."""
    picked = pages.select(*keep, F.col(html_column).cast("string").alias("_html"))
    schema = picked.select(*keep, F.lit("").alias(out_column)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_html"):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([extract(p) for p in part.column("_html").to_pylist()], pa.string())], schema.names)

    return in_arrow(picked, run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
