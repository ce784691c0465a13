"""Main text of a page by line-block distribution.

Markup is stripped into lines, one for each block; blocks that are menus, adverts and the like leave a blank
one. Over the lines a window sums text lengths (link text aside); the text surges where a sum rises
above a threshold and dives where a sum falls to nothing, and what stands between is kept.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import quoted

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>""")
_OPEN_ENDED = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z0-9]+")

#: Elements whose content is no text of the page.
UNREAD = frozenset("script style title template iframe noscript svg math textarea select option button object canvas audio video".split())
#: Elements that end a line before and after.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend"
    " li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Words of class and id names, and roles, of such parts.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar widget ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle banner promo"
    " promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login social share"
    " sharing comment comments reply replies respond disqus related recommended recommendations pagination pager search masthead topbar toolbar copyright disclaimer"
    " complementary contentinfo".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
MAIN_WORDS = frozenset(("main", "articlebody"))


@dataclass(frozen=True)
class LineBlocks:
    """``window`` lines are summed; ``surge`` characters start the text (half the page's largest sum, if that is less)."""

    window: int = 3
    surge: int = 86


@dataclass
class Line:
    text: str
    weight: int
    region: int


def lines_of(page: str) -> tuple[list[Line], list[str]]:
    """The page's lines, a blank one where a part was left out, and the elements (article or main) that regions are; region 0 is outside all."""
    lines: list[Line] = []
    regions = [""]
    parts: list[str] = []
    linked = 0
    # what is open, as (tag, leaves text out, region); only elements that matter are held
    stack: list[tuple[str, bool, int]] = []
    held: dict[str, int] = {}
    anchors = 0

    def state() -> tuple[bool, int]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            lines.append(Line(text, max(0, len(text) - linked), state()[1]))
        linked = 0

    def blank() -> None:
        lines.append(Line("", 0, state()[1]))

    def push(tag: str, out: bool, region: int) -> None:
        stack.append((tag, out, region))
        held[tag] = held.get(tag, 0) + 1

    def pop_to(tag: str) -> None:
        while True:
            top, out, _ = stack.pop()
            held[top] -= 1
            if out and not state()[0]:
                blank()
            if top == tag:
                return

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not state()[0]:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if anchors:
                linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        following = page[lt + 1:lt + 2]
        if not (following.isalpha() and following.isascii()) and following not in ("/", "!", "?"):
            add(page[at:lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        if following in ("!", "?"):
            end = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
            if end < 0:
                break
            at = end + (3 if page.startswith("<!--", lt) else 1)
            continue
        tag_at = _TAG.match(page, lt) or _OPEN_ENDED.match(page, lt)
        if tag_at is None:  # "</" before something else, or a tag that the page ends in
            end = page.find(">", lt)
            if end < 0:
                break
            at = end + 1
            continue
        at = tag_at.end()
        closing, tag, attributes = tag_at[1] == "/", tag_at[2].lower(), tag_at[3]
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            parts.append(" ")
        if closing:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if held.get(tag):
                if tag not in BLOCKS and stack[-1][0] != tag and any(t in BLOCKS for t, _, _ in stack[-8:] if t != tag) and stack[-1][0] in BLOCKS:
                    continue  # an inline end inside an open block closes nothing outside it
                flush_needed = any(out for _, out, _ in stack[-1:])
                if not flush_needed:
                    flush()
                pop_to(tag)
            continue
        if tag in UNREAD:
            if not attributes.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                close = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
                if close is None:
                    break
                end = page.find(">", close.start())
                at = size if end < 0 else end + 1
            continue
        if tag in VOID:
            continue
        if tag == "a":
            anchors += 1
        out, region = state()
        if tag in BLOCKS and held.get("p") and stack[-1][0] == "p":
            pop_to("p")
            out, region = state()
        if tag == "li" and held.get("li") and stack[-1][0] == "li":
            pop_to("li")
            out, region = state()
        words: set[str] = set()
        role = ""
        if attributes and "=" in attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "").lower()
                if name.lower() in ("role", "itemprop"):
                    role = value
                words.update(_NAME.findall(value))
        is_main = tag in ("article", "main") or role in MAIN_WORDS
        if is_main:
            aside = out and _closed_by_tag(stack) or bool(words & COMMENT_WORDS)
            if not aside:
                regions.append(tag if tag in ("article", "main") else "main")
                region = len(regions) - 1
            if out and not aside:
                blank()
            push(tag, aside, region)
        elif not out and (tag in ASIDE_TAGS or (tag == "header" and not region) or (tag not in ("html", "body") and words and (words & ASIDE_WORDS or (not region and "header" in words)))):
            flush()
            blank()
            push(tag, True, region)
        elif tag in BLOCKS and tag not in ("p", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "html", "body", "head"):
            push(tag, out, region)
        elif out and tag == "p" and stack[-1][0] == "p":
            push(tag, out, region)
    flush()
    return lines, regions


def _closed_by_tag(stack: list[tuple[str, bool, int]]) -> bool:
    """Whether an open element is, by its very tag, no place for an article."""
    return any(out and tag in ASIDE_TAGS for tag, out, _ in stack)


def window_sums(weights: list[int], window: int) -> list[int]:
    """The sum of each weight and the ``window`` - 1 that follow it."""
    n = len(weights)
    sums, run = [0] * n, 0
    for i in range(n - 1, -1, -1):
        run += weights[i] - (weights[i + window] if i + window < n else 0)
        sums[i] = run
    return sums


def between(lines: list[Line], weights: list[int], window: int, threshold: float) -> list[int]:
    """Numbers of the lines between surges and dives."""
    n, sums = len(lines), window_sums(weights, window)
    out, inside, start = [], False, 0
    for i in range(n + 1):
        filled = i < n and bool(lines[i].text)
        if inside and (i == n or sums[i] == 0):  # dive
            out.extend(k for k in range(start, i) if lines[k].text)
            inside = False
        if not inside and filled and sums[i] > threshold:  # surge: with the lines that lead up to it
            start = i
            while start and weights[start - 1]:
                start -= 1
            inside = True
    return out


def kept_lines(lines: list[Line], rules: LineBlocks) -> list[Line]:
    """Lines between surges and dives, where those inside articles and main parts and those outside leave each other blank.

    A region whose own lines surge is kept with every line that has text.
    """
    threshold = min(rules.surge, max(window_sums([x.weight for x in lines], rules.window), default=0) / 2)
    own: dict[int, list[int]] = {}
    for x in lines:
        if x.region:
            own.setdefault(x.region, []).append(x.weight)
    surged = {r for r, weights in own.items() if max(window_sums(weights, rules.window)) > threshold}
    kept = {i for i, x in enumerate(lines) if x.text and x.region in surged}
    for inner in (True, False):
        part = [x if bool(x.region) == inner else Line("", 0, x.region) for x in lines]
        kept.update(between(part, [x.weight for x in part], rules.window, threshold))
    return [lines[i] for i in sorted(kept)]


def main_text(page: str | None, rules: LineBlocks = LineBlocks()) -> str:
    """The page's main text, blocks joined by one space: what stands between surges and dives. Elements that mark an
    article or a main part only bound the blocks, and keep their short lines where they surge."""
    if not page:
        return ""
    return " ".join(x.text for x in kept_lines(lines_of(page)[0], rules))


def extract(pages: DataFrame, id_col: str = "page_id", html: str = "html", rules: LineBlocks = LineBlocks()) -> DataFrame:
    """``pages`` with all its columns but the html, and ``main_text``: one row per row; a null or empty page has an empty text.

    A column of ``pages`` that has that name already is left out.
    """
    others = [c for c in pages.columns if c not in (html, "main_text")]
    types = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(x.as_py(), rules) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*others, "main_text"])

    rows = pages.select(quoted(pages, html).cast("string").alias("rp_html_of_page"), *(quoted(pages, c) for c in others))
    return rows.mapInArrow(run, f"{types}{', ' if types else ''}main_text string")
