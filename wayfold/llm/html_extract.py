"""HTML extraction by line-block distribution.

Markup is stripped to lines, one for each block element; each part that never holds the article (menus, headers,
footers, forms, adverts, reader comments ...) is one line without weight.  Other lines weigh as much as their text
outside links, but only within the page's core.  Weights are summed over a sliding window of lines: where the sum
surges above nothing a stretch begins, where it dives to nothing the stretch ends, and what stands between is text.  So a menu
of links is cut out whatever it is called and wherever it stands, and a short closing line is text however little it weighs.

The core is what the page marks as its article; if less than ``ARTICLE`` of the weight stands in it, also the innermost
element that holds ``CORE`` of the weight.

An element is such a part by its name, its role, or a class or id all of whose words are names of page parts or
words of layout: ``comment-list`` is, ``social-history`` is not.  Words that articles are about too (``legal``) count outside of an
article only.  A part ends with its own end tag, so that the articles of a comment list or of teasers stay in it; if it
has none, at the next article.  A form with most of the page's text in it is the page.

Defined cases: null or empty html gives an empty text; a page of one very long line is one block; stretches that
surge alike are all kept; a tag that never ends hides the rest of the page; a page that is all parts is read again with each article ending
the part it stands in, for a part may have ended with another element's end tag;
repeated rows give a result each; null page_id or url is passed through; an empty table gives an empty result;
further columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .store import table

WINDOW = 3
#: The innermost element with this share of the weight is the core of a page that marks no article.
CORE = 0.7
#: What is marked as an article is the core if it has this share of the weight.
ARTICLE = 0.25
# Element names and roles of HTML, usual names of page parts, and words of layout.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav aside form header footer head title button select option textarea label menu dialog".split())
RAW = frozenset("script style noscript template svg iframe object canvas math audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr alert popup modal overlay sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe signup login "
    "searchform widget widgets pagination pager toolbar skip".split()
)
#: Names of parts, but within an article as likely what it is about.
ABOUT = frozenset("copyright legal discussion notice notices".split())
LAYOUT = frozenset("area bar block body bottom box buttons col column container content footer group head holder inner item items left link links list main outer page panel post posts right row section site slot text thread title top unit wrap wrapper".split())
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[>\"']")
NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|[\s\"'])hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLOSE = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


def _part(attributes: str, inside: bool) -> bool:
    """Whether an element's attributes hide it or name a page part; ``inside`` an article fewer words do."""
    parts = PARTS if inside else PARTS | ABOUT
    if not attributes or attributes.isspace():
        return False
    if HIDDEN.search(attributes):
        return True
    for kind, *value in NAMED.findall(attributes):
        for name in "".join(value).split():
            words = {w.lower() for w in WORD.findall(name)}
            if name.lower() in ROLES if kind.lower() == "role" else words & parts and words <= parts | LAYOUT:
                return True
    return False


def tags(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, name, whether it closes, attributes) of each tag, and the text after the last with no name; every character is looked at a few times at most."""
    at = start = 0
    unclosed: set[str] = set()
    while True:
        at = html.find("<", at)
        if at < 0:
            yield html[start:], "", False, ""
            return
        m = NAME.match(html, at + 1)
        if not m:
            if html.startswith("<!--", at):
                text, end = html[start:at], html.find("-->", at + 4)
                end = len(html) if end < 0 else end + 3
            elif html[at + 1 : at + 2] in ("!", "?"):
                text, end = html[start:at], html.find(">", at) + 1 or len(html)
            else:
                at += 1
                continue
            yield text, "!", False, ""
            at = start = end
            continue
        end, text = m.end(), html[start:at]
        while True:
            stop = STOP.search(html, end)
            if not stop:
                yield text, "", False, ""
                return
            end, mark = stop.end(), stop[0]
            if mark == ">":
                break
            close = -1 if mark in unclosed else html.find(mark, end)
            if close < 0:
                unclosed.add(mark)
            else:
                end = close + 1
        name = m[2].lower()
        yield text, name, bool(m[1]), html[m.end() : end - 1]
        if name in RAW and not m[1]:
            gone = CLOSE[name].search(html, end)
            end = gone.end() if gone else len(html)
        at = start = end


class Line(NamedTuple):
    """A block's text, its characters outside links, whether it stands in a marked article, whether it stands for a part, and the elements around it."""

    text: str
    weight: int
    marked: bool
    never: bool
    around: tuple[int, ...]


def _ends(found: list[tuple[str, str, bool, str]]) -> dict[int, int]:
    """The end tag of each start tag that has one: of tags of one name, an end ends the last that is open."""
    open_: dict[str, list[int]] = {}
    ends = {}
    for i, (_, name, closing, _) in enumerate(found):
        if not closing:
            open_.setdefault(name, []).append(i)
        elif open_.get(name):
            ends[open_[name].pop()] = i
    return ends


def lines(html: str, leave: bool = True) -> list[Line]:
    """One line for each block and each part of a page; without ``leave`` an article ends any part."""
    found = list(tags(html))
    ends = _ends(found)
    total = [0]
    for text, *_ in found:
        total.append(total[-1] + len(text) - text.count(" "))
    out: list[Line] = []
    piece: list[str] = []
    around: list[tuple[str, int]] = []
    weight = links = article = 0
    skip, until = "", -1

    def flush() -> None:
        nonlocal weight
        text = " ".join(unescape("".join(piece)).split()) if piece and not skip else ""
        if text:
            out.append(Line(text, weight, article > 0, False, tuple(k for _, k in around)))
        piece.clear()
        weight = 0

    for i, (text, name, closing, attributes) in enumerate(found):
        if text and not skip:
            piece.append(text)
            if not links:
                weight += len(text) - text.count(" ")
        if not name or name == "!":
            continue
        if skip:
            if name in ("article", "main") and (until < 0 or not leave):
                # The part's end is missing.
                skip = ""
            elif until >= 0:
                if i < until:
                    continue
                skip = ""
                continue
            elif skip == "p" and name in BLOCKS:
                skip = ""
                if name == "p" and closing:
                    continue
            elif skip == "li" and name in ("li", "ul", "ol", "menu"):
                skip = ""
            elif name == "body" or (skip in ("head", "title") and name in BLOCKS and name not in ("head", "title")):
                skip = ""
            else:
                continue
        if name == "br":
            piece.append("\n")
        elif name in ("td", "th"):
            piece.append(" ")
        elif name == "a":
            links = 0 if closing else 1
        if name in BLOCKS or name in NEVER:
            flush()
            links = 0
        if not closing and name not in VOID and name not in ("body", "html"):
            whole = name == "form" and 2 * (total[ends.get(i, len(found) - 1) + 1] - total[i]) > total[-1]
            if (name in NEVER and not whole) or _part(attributes, article > 0):
                flush()
                if not (out and out[-1].never):
                    out.append(Line("", 0, article > 0, True, tuple(k for _, k in around)))
                # A paragraph ends where a block begins, whether or not its end tag comes.
                skip, until = name, ends.get(i, -1) if name != "p" else -1
                continue
        if name in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
        if name in BLOCKS and name not in ("p", "hr"):
            if not closing:
                around.append((name, i))
            elif any(n == name for n, _ in around):
                while around.pop()[0] != name:
                    pass
    flush()
    return out


def core(found: list[Line]) -> list[bool]:
    """Which lines stand in the core of the page."""
    inside = sum(x.weight for x in found if x.marked)
    total = sum(x.weight for x in found)
    if any(x.marked and not x.never for x in found) and inside >= ARTICLE * total:
        return [x.marked for x in found]
    held: dict[int, int] = {}
    for x in found:
        for k in x.around:
            held[k] = held.get(k, 0) + x.weight
    # Of elements with so much weight each holds the next, and the last begins last.
    best = max((k for k, w in held.items() if w >= CORE * total and w > 0), default=None)
    return [best is None or best in x.around or x.marked for x in found]


def stretches(weight: np.ndarray) -> list[tuple[int, int]]:
    """Where the sums of ``WINDOW`` lines surge above nothing and where they dive to it."""
    n, half = len(weight), WINDOW // 2
    total, at = np.concatenate([[0], np.cumsum(weight)]), np.arange(n)
    block = total[np.minimum(at + half + 1, n)] - total[np.maximum(at - half, 0)]
    above = np.concatenate([[False], block > 0, [False]])
    surge, dive = np.flatnonzero(above[1:] & ~above[:-1]), np.flatnonzero(above[:-1] & ~above[1:])
    # The windows reach beyond the text: a stretch begins and ends with lines that weigh.
    heavy = np.flatnonzero(weight)
    return list(zip(heavy[np.searchsorted(heavy, surge)].tolist(), (heavy[np.searchsorted(heavy, dive) - 1] + 1).tolist()))


def extract(html: str | None) -> tuple[str, int, int, int]:
    """Text, its number of blocks, and the lines of the first surge and the last dive (-1: none)."""
    for leave in (True, False):
        found = lines(html, leave) if html else []
        within = core(found)
        weight = np.array([x.weight * w for x, w in zip(found, within)], np.int64)
        kept = stretches(weight)
        if kept:
            # A line or two of links between others are text.
            out = [found[i].text for a, z in kept for i in range(a, z) if within[i] and not found[i].never]
            return "\n\n".join(out), len(out), kept[0][0], kept[-1][1]
    return "", 0, -1, -1


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of every row's html."""
    kept = pages.select("page_id", "url", "html")
    schema = f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_blocks int, surge int, dive int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [extract(h) for h in part.column("html").to_pylist()]
                text, blocks, surge, dive = map(list, zip(*got))
                cols = [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), *(pa.array(x, pa.int32()) for x in (blocks, surge, dive))]
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars", "n_blocks", "surge", "dive"])

    return kept.mapInArrow(run, schema)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
