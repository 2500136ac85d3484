"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_texts, table

#: Lines in a sliding window; share of the page's typical window at which the text surges, and below which it dives.
WINDOW, SURGE, DIVE = 3, 0.2, 0.05

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|title|iframe)\b(?:"[^"]*"|'[^']*'|[^'">])*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>""", re.S | re.I)
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SHELL = set("nav header footer aside form button select menu dialog object video audio canvas".split())
#: Words of class, id and role values that mark page furniture.
FURNITURE = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar widget aside complementary contentinfo cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup login "
    "comment comments reply replies disqus respond share sharing social related recommended pagination pager search form toolbar".split()
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SPACE = re.compile(r"\s+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Characters that end a sentence, or a sentence in quotes.
ENDS = set(".!?:;\u2026\u3002\uff01\uff1f\"')\u201d\u2019\u00bb")


def is_furniture(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is page furniture, by its name or by the words of its class, id and role."""
    if name in SHELL and not (inside and name == "header"):
        return True
    if not attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    for m in ATTRIBUTE.finditer(attributes):
        if FURNITURE & set(re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())):
            return name not in ("html", "body", "article", "main") or "comment" in m[0].lower()
    return False


class Line:
    """A run of text between block-level tags: its text, the characters that count, its article and whether it is a heading."""

    __slots__ = ("text", "size", "article", "heading")

    def __init__(self, text: str, size: int, article: int, heading: bool):
        self.text, self.size, self.article, self.heading = text, size, article, heading


def page_lines(page: str) -> list[Line]:
    """Lines of a page after markup is stripped.

    Characters in page furniture count as none, nor do those in links outside an article. ``article`` numbers the
    outermost marked articles from 1; 0 is outside.
    """
    lines: list[Line] = []
    parts: list[str] = []
    counted = inside = links = depth = articles = 0
    skip, heading = "", False

    def end_line() -> None:
        nonlocal parts, counted, heading
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                lines.append(Line(text, len(text) if counted else 0, articles if inside else 0, heading))
        parts, counted, heading = [], 0, False

    def take(raw: str) -> None:
        nonlocal counted
        if raw:
            parts.append(raw)
            if not skip and not (links and not inside) and not raw.isspace():
                counted += len(raw)

    at = 0
    for m in TAG.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            end_line()
            heading = name in HEADINGS and not closing
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name in ("article", "main"):
            end_line()
            if closing:
                inside = max(0, inside - 1)
                if skip == name:
                    skip = ""
            elif is_furniture(name, attributes, inside > 0):
                skip, depth = name, 1
                continue
            else:
                articles += not inside
                inside, skip, links = inside + 1, "", 0
        elif skip:
            if name == skip:
                depth += -1 if closing else 1
                if depth <= 0:
                    end_line()
                    skip = ""
        elif not closing and name not in VOID and not attributes.endswith("/") and is_furniture(name, attributes, inside > 0):
            end_line()
            skip, depth = name, 1
    take(page[at:])
    end_line()
    return lines


def window_sums(sizes: np.ndarray) -> np.ndarray:
    """Characters in the window of ``WINDOW`` lines that begins at each line."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    return total[np.minimum(at + WINDOW, len(sizes))] - total[at]


def typical_window(sizes: np.ndarray, sums: np.ndarray) -> float:
    """The window sum below which half of the page's characters lie: large windows hold most of a page's text."""
    order = np.argsort(sums, kind="stable")
    weight = np.cumsum(sizes[order])
    return float(sums[order][np.searchsorted(weight, weight[-1] / 2)])


def text_blocks(lines: list[Line], sizes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of lines (first, last + 1) between a surge of the window sums and the dive after it.

    Both points are set by the page's own distribution. The text surges in a window that reaches ``SURGE`` of the
    typical window; the first line is the window's first which is a heading, ends a sentence or holds ``DIVE`` of
    the typical window itself. It dives where a window holds less than ``DIVE`` of the typical one; of the short
    lines on either edge, those that end a sentence belong to the text and others do not.
    """
    sums = window_sums(sizes)
    level = typical_window(sizes, sums)
    high, low = SURGE * level, DIVE * level
    firm = [bool(x.size) and (x.heading or x.size >= low or x.text[-1] in ENDS) for x in lines]
    out, i, n = [], 0, len(sizes)
    while i < n:
        if sums[i] < high or not firm[i]:
            i += 1
            continue
        first, last = i, i
        while first and firm[first - 1] and (not out or first > out[-1][1]):
            first -= 1
        while last < n and sums[last] >= max(1, low):
            last += 1
        while last < n and firm[last]:
            last += 1
        end = last
        while not firm[end - 1]:
            end -= 1
        out.append((first, end))
        i = last
    return out


def articles_of(blocks: list[tuple[int, int]], article: np.ndarray, sizes: np.ndarray) -> set[int]:
    """Marked articles whose own lines surge inside one of the blocks."""
    high = SURGE * typical_window(sizes, window_sums(sizes))
    out = set()
    for first, last in blocks:
        for k in set(article[first:last].tolist()) - {0}:
            if window_sums(np.where(article == k, sizes, 0))[first:last].max() >= max(1, high):
                out.add(k)
    return out


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null or a page without any.

    The sums of the lines' lengths over sliding windows locate the text on every page: it lies between the points
    where they surge and dive (:func:`text_blocks`). A marked article votes where its own lines surge in such a
    stretch (:func:`articles_of`): its marks then bound the text, on both sides and over short lines within, and
    stretches outside such articles are dropped. An article that does not surge is a teaser and has no vote.
    """
    lines = page_lines(page or "")
    sizes = np.array([x.size for x in lines], np.int64)
    if not sizes.any():
        return ""
    article = np.array([x.article for x in lines])
    blocks = text_blocks(lines, sizes)
    keep = np.isin(article, list(articles_of(blocks, article, sizes)))
    if not keep.any():
        for first, last in blocks:
            keep[first:last] = True
    return " ".join(x.text for x, k in zip(lines, keep & (sizes > 0)) if k)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page, in one narrow pass: page_id, url, text, n_chars.

    A null page has an empty text; a null id or URL stays null; repeated rows each get a row; an empty table gives
    an empty result. Whole pages are parsed, however long, and nothing of the kept text is capped. Only the named
    columns are read, so other columns may have any name.
    """

    def work(texts: list) -> list:
        out = [main_text(t) for t in texts]
        return [out, [len(t) for t in out]]

    cols = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_texts(cols, lambda: work, "page_id long, url string, text string, n_chars long", 2)


def op6_main_text(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))
