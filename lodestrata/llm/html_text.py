"""HTML extraction (operator 9): line-block distribution.

A page becomes lines, one for each block of text, without markup; elements that never hold the article (scripts, styles,
menus, headers, footers, sidebars, forms, and boxes that a whole word of their class or id names advert, notice, comments
and the like) are left out, but none that holds the section (article, main) with the most text, or, menus and buttons
aside, more than half of the page's text. The text lengths of the lines are summed over a sliding window. Where the sums rise above the page's level is a
surge, where they fall off again a dive; the stretches between are the body of the article, the one with the most text
its core, which also holds on a page whose markup names nothing. Last, they are widened: if the core lies in an article
or main, to the innermost such section of every stretch that has one; if not, to the innermost box that holds all
stretches. So neither further parts of an article nor short lines between or around them are lost.

Character references are decoded, white space inside a block is one space, blocks are joined by a newline. Nothing else
is dropped or capped. Null and empty pages give an empty text; unclosed elements, scripts and styles aside, end with the box around them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

WINDOW = 3

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?][^>]*+>)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")

# Element names of HTML by what they do.
_RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEFT_OUT = frozenset("head nav header footer aside form button dialog menu".split())
_WEAK = frozenset("nav menu button".split())
_ENDLESS = frozenset("script style".split())
_NESTED = frozenset("svg object".split())
_SECTION = frozenset("article main".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NOISE = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "header masthead menu modal nav navbar navigation newsletter notice popup promo promotion related replies respond share sharing sidebar "
    "signup skip social sponsor sponsored subscribe toolbar widget".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


# Words that make a token say what a box has or lacks, and words that may follow the name of a box.
_MODIFIER = frozenset("disable disabled enable enabled has hide hides is no not show shows with without".split())
_PLACE = frozenset(
    "area articles bar block body bottom box button buttons col column container content form group icons inner item items left link links list "
    "main outer panel post posts primary region right row secondary section site slot stories thread top unit wrap wrapper zone".split()
)


def _names_noise(token: str) -> bool:
    parts = _PARTS.findall(token.split("--")[0])
    if not parts or not _MODIFIER.isdisjoint(parts):
        return False
    return parts[-1] in _NOISE or parts[0] in _NOISE and all(x in _PLACE or x in _NOISE or len(x) == 1 for x in parts[1:])


def _noise(attributes: str) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name in ("class", "id") and any(map(_names_noise, value.split())):
            return True
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _close(page: str, at: int, name: str, box: str | None) -> int | None:
    """Where an element that is skipped unread ends; none if it is unclosed, by the end of the box around it."""
    if name in _ENDLESS or box is None and name not in _NESTED:
        tag = re.compile(f"</{name}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(page, at)
        return tag.end() if tag else None
    open_, boxes = 1, 1
    for tag in re.compile(f"<(/?)({name}|{re.escape(box or name)})(?=[\\s/>]|\\Z)[^>]*>?", re.I).finditer(page, at):
        step = -1 if tag[1] else 0 if tag[0].endswith("/>") else 1
        if tag[2].lower() == name:
            open_ += step if step < 0 or name in _NESTED else 0
            if not open_:
                return tag.end()
        else:
            boxes += step
            if not boxes:
                return None
    return None


def lines(page: str) -> tuple[list[str], list[tuple[int, ...]], dict[int, str]]:
    """Blocks of text in page order, the open sections and boxes of each (numbers, outermost first), their names."""
    blocks: list[list[tuple[str, tuple[int, ...]]]] = []  # pieces of text, and the elements to be left out that each is in
    places: list[tuple[int, ...]] = []
    names: dict[int, str] = {}
    stack: list[tuple[str, int]] = []
    text: list[tuple[str, tuple[int, ...]]] = []
    out: list[tuple[int, int]] = []  # open elements to be left out: depth, number
    inside: tuple[int, ...] = ()
    weak: set[int] = set()
    around: dict[int, tuple[int, ...]] = {}  # of each section
    loose: set[str] = set()  # names that have no end any more

    def flush() -> None:
        if text:
            blocks.append(text.copy())
            places.append(tuple(n for _, n in stack if n))
            text.clear()

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        if at > last:  # no tag ends any more; what is left is text, up to a comment that never ends
            text.append((page[at:].split("<!--", 1)[0], inside))
            break
        tag = _TAG.search(page, at)
        if tag is None:
            text.append((page[at:], inside))
            break
        if tag.start() > at:
            text.append((page[at : tag.start()], inside))
        at = tag.end()
        name = tag[3]
        if not name:
            continue
        name = name.lower()
        if tag[2]:
            if name in _BLOCK:
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
                if stack[depth][0] in ("body", "article", "main", "td") and name not in ("html", "body", "article", "main", "table", "tr"):
                    break
            while out and out[-1][0] > len(stack):
                out.pop()
                inside = inside[:-1]
            continue
        if name in _VOID or tag[4].rstrip().endswith("/"):
            if name in _BLOCK:
                flush()
            continue
        unclosed = False
        if name in _RAW:
            box = next((x for x, n in reversed(stack) if n), None)
            close = None if name in loose else _close(page, at, name, box)
            if close is not None or name in _ENDLESS:
                at = end if close is None else close
                continue
            if box in (None, "html", "body"):
                loose.add(name)
            unclosed = True
        if name in _BLOCK:
            flush()
            # an open paragraph ends where a block begins; an item ends where its next begins
            ends = {"p"} | ({name} if name in ("li", "tr", "td", "th") else {"dt", "dd"} if name in ("dt", "dd") else set())
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    del stack[depth:]
                    break
                if stack[depth][0] in _BLOCK:
                    break
            while out and out[-1][0] > len(stack):
                out.pop()
                inside = inside[:-1]
        box = name in _BLOCK and name not in ("p", "li")
        stack.append((name, at if box else 0))
        if box:
            names[at] = name
        noise = bool(tag[4]) and name not in ("body", "html") and _noise(tag[4])
        if name in _SECTION and not noise:
            around[at] = inside
        if (unclosed or name in _LEFT_OUT or noise) and len(out) < 64:
            out.append((len(stack), at))
            inside = (*inside, at)
            if name in _WEAK:
                weak.add(at)
    flush()

    size: dict[int, int] = {}
    own: dict[int, int] = {}
    total = 0
    for pieces, place in zip(blocks, places, strict=True):
        section = next((n for n in reversed(place) if n in around), None)
        for piece, skipped in pieces:
            n = len(piece.strip())
            total += n
            for x in skipped:
                size[x] = size.get(x, 0) + n
            if section is not None:
                own[section] = own.get(section, 0) + n
    stays = {x for x, n in size.items() if 2 * n > total and x not in weak}
    if own:
        stays.update(around[max(own, key=lambda x: (own[x], -x))])
    found, where = [], []
    for pieces, place in zip(blocks, places, strict=True):
        block = " ".join(html.unescape("".join(x for x, skipped in pieces if stays.issuperset(skipped))).split())
        if block:
            found.append(block)
            where.append(place)
    return found, where, names


def stretches(sizes: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """First and last line of every stretch between a surge and a dive of the window sums, in page order."""
    n = len(sizes)
    width = min(window, n)
    sums = np.convolve(sizes, np.ones(width, np.int64))[width - 1 : width - 1 + n]  # each line with those that follow
    level = max(1.0, sums.mean() / 2)
    high = sums >= level
    out, at = [], 0
    while at < n:
        if not high[at]:
            at += 1
            continue
        surge = at
        while at + 1 < n and high[at + 1]:
            at += 1
        dive = min(n - 1, at + width - 1)  # the last window that is high still reaches so far
        while dive > at and sizes[dive] < level / width:
            dive -= 1
        start = surge
        while start < dive and sizes[start] < level / width:
            start += 1
        out.append((start, dive))
        at += 1
    return out or [(0, n - 1)]


def core(sizes: np.ndarray, window: int = WINDOW) -> tuple[int, int]:
    """First and last line of the stretch with the most text."""
    return max(stretches(sizes, window), key=lambda s: (int(sizes[s[0] : s[1] + 1].sum()), -s[0]))


def _shared(boxes: list[tuple[int, ...]]) -> tuple[int, ...]:
    """The boxes that all lines lie in."""
    low, high = min(boxes), max(boxes)  # what the extremes share, all share
    same = 0
    while same < min(len(low), len(high)) and low[same] == high[same]:
        same += 1
    return low[:same]


def main_text(page: str | None) -> str:
    """The article of a page, one line for each block."""
    found, where, names = lines(page or "")
    if not found:
        return ""
    sizes = np.array([len(x) for x in found], np.int64)
    parts = stretches(sizes)
    sections = {}
    for first, last in parts:
        sections[first, last] = next((n for n in reversed(_shared(where[first : last + 1])) if names[n] in _SECTION), None)
    if sections[core(sizes)] is not None:
        boxes = set(sections.values()) - {None}
    else:
        boxes = set(_shared([w for first, last in parts for w in where[first : last + 1]])[-1:])
    if boxes:
        inside = [not boxes.isdisjoint(w) for w in where]
        if sections[core(sizes)] is not None and len(boxes) > 1:  # short sections between those that were found
            ends = np.flatnonzero(inside)
            inside = [x or ends[0] < i < ends[-1] and any(names[n] in _SECTION for n in where[i]) for i, x in enumerate(inside)]
        return "\n".join(x for x, y in zip(found, inside, strict=True) if y)
    return "\n".join(found[parts[0][0] : parts[-1][1] + 1])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            yield pa.record_batch([part.column(1), pa.array([main_text(x) for x in part.column(0).to_pylist()], pa.string())], ["rec", "main_text"])


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row as ``rec`` (a struct of the columns in ``keep``, by default all) and its main_text."""
    packed = pages.select(F.col(html_col).alias("html"), F.struct(*(keep or ["*"])).alias("rec"))
    return packed.mapInArrow(_run, packed.select("rec", F.lit(None).cast("string").alias("main_text")).schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: page_id, url, text, n_chars."""
    out = extracted(load(spark, sf_dir, "pages"), keep=("page_id", "url"))
    return out.select("rec.page_id", "rec.url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
