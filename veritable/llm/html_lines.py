"""Operator 6: main text of HTML pages by line-block distribution.

Markup is stripped to lines, one a block element, in page order. Text inside
elements that are never part of an article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments) counts as no text, and
neither do lists of links. The lengths of the lines are summed over a sliding
window. Text begins where the sums surge and ends where they dive to nothing;
the blocks between are kept. If the page marks its article, only the lines in it
count, and any text there is a surge; otherwise a surge takes ``SURGE``
characters (half of the page's largest sum, if that is less), and all text from
the first to the last of the stretches near the largest stays.

An element is taken for such an element by a class, id or role all of whose
words say so (``cookie-notice``, not ``related-work``), unless it is a heading,
a paragraph, part of preformatted text, or a wrapper: one that holds most of
the page's text and its main heading, or all text but a few words. A list of
links is a run of ``RUN`` or more lines that consist mostly of links, headings
never among them: in an article short list items only; elsewhere also a single
line of as many links.

Character references are decoded, white space inside a block becomes one
space, blocks are joined by one line feed. Edge cases: html that is null, empty
or without an article gives an empty text; what is not closed runs to the
page's end; a null id or url is carried through; repeated rows each give a
row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import prepare_python

WINDOW, SURGE, NEAR = 3, 86, 0.25
#: Lines with more than this share of their text in links may be lists of links; so many lines (or links in one) make a list.
LINKS, RUN = 0.6, 3

SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object|select|xmp)\b[^>]*?(?<!/)>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?][^>]*>", re.IGNORECASE | re.DOTALL)
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "meta", "link", "q", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr", "input"}
VOID = {"area", "base", "col", "embed", "hr", "param", "source", "track"}
#: Elements that are never part of an article, and such words in an element's class, id or role.
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "applet", "audio", "video", "canvas"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
         "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "masthead", "menu",
         "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "related",
         "replies", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar",
         "widget", "alert", "gdpr", "paywall", "signup", "login"}
#: Words that may stand beside these in a class (``share-buttons``); and elements that may outgrow the article.
PARTS = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "form", "group", "icons", "inner", "item",
         "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "right",
         "secondary", "section", "side", "site", "slot", "top", "unit", "wrap", "wrapper"}
READERS = {"comment", "comments", "disqus", "replies"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE = {"article", "main"}
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z]{2,}")


def is_outside(name: str, in_article: bool) -> bool:
    return name in OUTSIDE or (name == "header" and not in_article)


def named_outside(name: str, rest: str, in_article: bool) -> set[str]:
    """The words by which a class, id or role says that an element is no part of the article (none: it does not)."""
    if not rest or name in ARTICLE or name in HEADINGS or name in ("html", "body", "p"):
        return set()
    out: set[str] = set()
    for m in NAMES.finditer(rest):
        parts = set() if in_article and m[1].lower() == "id" else PARTS  # an id in an article may be a heading's anchor
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(WORD.findall(token))
            if words <= WORDS | parts:
                out |= words & WORDS
    return out


@dataclass
class Line:
    text: str
    share: float  # of it in links
    links: int
    inside: bool  # an article
    kind: str  # "h1", "heading" (a lower one), "item" or "block"


def page_lines(page: str) -> tuple[list[Line], bool]:
    """(every line, whether the page marks an article).

    Lines outside the content come as empty text, so that they count in the windows.
    """
    lines: list[Line] = []
    under: list[int] = []  # of every line the innermost element outside by name that it is in, or -1
    said: list[tuple[int, set[str]]] = []  # of every such element the one around it, and the words that say so
    now = -1
    stack: list[tuple[str, bool, bool, int | None]] = []  # name, is outside, is article, place in ``said``
    held: list[str] = []
    linked, links, n_links, outside, article, pre, marked = 0, 0, 0, 0, 0, 0, False

    def flush() -> None:
        nonlocal linked, n_links
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            near = [x[0] for x in stack[-3:]]
            kind = ("h1" if "h1" in near[-2:] else "heading") if HEADINGS.intersection(near[-2:]) else (
                "item" if "li" in near else "block")
            lines.append(Line("" if outside else text, min(1.0, linked / len(text)), n_links, article > 0, kind))
            under.append(now)
        held.clear()
        linked = n_links = 0

    def pop(to: int) -> None:
        nonlocal outside, article, pre, now
        while len(stack) > to:
            was, was_outside, was_article, was_named = stack.pop()
            pre -= was == "pre"
            outside -= was_outside
            article -= was_article
            if was_named is not None:
                now = said[was_named][0]

    def named(name: str, rest: str) -> set[str]:
        return set() if pre else named_outside(name, rest, article > 0)

    done = 0
    for m in SCAN.finditer(page):
        piece = page[done:m.start()]
        done = m.end()
        if piece:
            held.append(piece)
            linked += len(piece) * (links > 0)
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        closes = bool(m["end"])
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if closes else 1))
                n_links += not closes
            if name == "br":
                held.append(" ")
            elif name != "span" or not (closes or named(name, m["rest"])):
                continue
            if name == "br":
                continue
        if closes:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if name == "span" and at is None:
                continue
            flush()
            links = 0
            if at is not None:
                pop(at)
            continue
        flush()
        links = 0
        if name in VOID or m["rest"].endswith("/"):
            continue
        if name in ARTICLE and not any(re.search(r"comment|repl", x[0]) for x in stack):
            if not article:  # an article ends menus that were left open
                at = next((k for k, x in enumerate(stack) if x[1] or x[3] is not None), None)
                if at is not None:
                    pop(at)
            marked = True
        if name == "p" and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        words = named(name, m["rest"])
        off, art = is_outside(name, article > 0), name in ARTICLE
        outside += off
        article += art
        pre += name == "pre"
        stack.append((name, off, art, len(said) if words else None))
        if words:
            said.append((now, words))
            now = len(said) - 1
    if done < len(page):
        held.append(re.sub(r"<[^>]*\Z", "", page[done:]))
    flush()
    if said:
        off_by_name(lines, under, said)
    return lines, marked


def off_by_name(lines: list[Line], under: list[int], said: list[tuple[int, set[str]]]) -> None:
    """Empties the lines in elements that are outside by name, but for wrappers."""
    total, rest = sum(len(x.text) for x in lines), sum(len(x.text) for x, u in zip(lines, under, strict=True) if u < 0)
    held, titled, gone = [0] * len(said), [False] * len(said), [False] * len(said)
    for line, k in zip(lines, under, strict=True):
        if k >= 0:
            held[k] += len(line.text)
            titled[k] |= line.kind == "h1"
    for k in range(len(said) - 1, -1, -1):  # an element comes after the one around it
        if (up := said[k][0]) >= 0:
            held[up] += held[k]
            titled[up] |= titled[k]
    for k, (up, words) in enumerate(said):
        wrapper = 2 * held[k] > total and not words & READERS and (titled[k] or rest < SURGE)
        gone[k] = not wrapper or (up >= 0 and gone[up])
    for line, k in zip(lines, under, strict=True):
        if k >= 0 and gone[k]:
            line.text = ""


def stretches(lengths: list[int], surge: int) -> list[tuple[int, int]]:
    """[first, end) of the lines from each surge of the window sums to the dive after it."""
    sums = [sum(lengths[k:k + WINDOW]) for k in range(len(lengths))]
    out, start = [], None
    for k, n in enumerate(lengths):
        if start is None and sums[k] >= surge and n:
            start = k
        elif start is not None and not sums[k]:
            out.append((start, k))
            start = None
    return out + ([(start, len(lengths))] if start is not None else [])


def link_lists(lines: list[Line], marked: bool) -> list[bool]:
    """Whether each line is of a list of links."""
    out = [False] * len(lines)
    run: list[int] = []

    def end() -> None:
        if len(run) >= RUN:
            for k in run:
                out[k] = True
        run.clear()

    for k, x in enumerate(lines):
        if not x.text:
            continue
        if x.share <= LINKS or x.kind not in ("item", "block"):
            end()
        elif not marked:
            out[k] = x.links >= RUN
            run.append(k)
        elif x.kind == "item" and x.inside and len(x.text) <= SURGE:
            run.append(k)
        else:
            end()
    end()
    return out


def main_text(page: str | None) -> str:
    lines, marked = page_lines(page or "")
    listed = link_lists(lines, marked)
    texts = ["" if gone or (marked and not x.inside) else x.text for x, gone in zip(lines, listed, strict=True)]
    if marked:
        return "\n".join(t for t in texts if t)
    # Single lines that are links neither begin nor end a stretch, but stay between others.
    lengths = [len(t) * (x.share <= LINKS or x.kind not in ("item", "block")) for t, x in zip(texts, lines, strict=True)]
    largest = max((sum(lengths[k:k + WINDOW]) for k in range(len(lengths))), default=0)
    found = stretches(lengths, max(1, min(SURGE, largest // 2)))
    sizes = [sum(lengths[a:b]) for a, b in found]
    found = [s for s, n in zip(found, sizes, strict=True) if n >= NEAR * max(sizes)]
    return "\n".join(t for t in texts[found[0][0]:found[-1][1]] if t) if found else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    prepare_python(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
