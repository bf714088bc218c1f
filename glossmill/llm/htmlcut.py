"""Main text of HTML pages by minimum-cut labelling.

A page becomes a list of text blocks. A linear classifier over tags, class names, link density and
length gives each block a cost of being content or boilerplate, which are its capacities to source
and sink. Smoothness edges join blocks that are neighbours on the page, the more so the closer they
are in the DOM, and the next block under the same parent. The source side of a minimum cut is the
main text.

Defined cases: null, empty and text-free pages give an empty text; broken markup is read leniently;
unclosed scripts, styles and comments end with the page; drawings, choices, templates and the like are left out with all
that is nested in them, and one that is never closed, or a drawing in which a block of text begins, ends before the next block's tag; a tag whose quote is never closed ends at the next
> or <, and a < in a tag begins the next one; rows may repeat; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"(/?)([a-zA-Z][\w:-]*)")
#: What may stand in a tag after its name; possessive, so that no byte is read twice.
INSIDE = re.compile(r"""(?:[^>"'<]++|"[^"]*+"|'[^']*+')*+""")
HINT = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I | re.S)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
#: HTML element names by their part in a page.
RAW = {"script", "style", "textarea", "iframe", "title"}
HIDDEN = {"noscript", "template", "svg", "select", "object", "math", "canvas"}
DRAWN = {"svg", "math"}
BLOCK = re.compile(r"<(/?)(?:p|div|h[1-6]|ul|ol|li|dl|table|section|article|main|aside|nav|footer|header|blockquote|pre|form|figure|body)(?=[\s/>])", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
BOILER_TAGS = {"nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "button": -8.0, "head": -20.0, "header": -3.0, "menu": -8.0, "dialog": -8.0, "fieldset": -8.0}
MAIN_TAGS = {"article": 3.0, "main": 2.5}
BOILER_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright discussion disclaimer disqus feedback footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup popups privacy promo promoted recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar topbar trending widget widgets".split())
MAIN_WORDS = set("article body content entry main post story text".split())
#: Words that say where a part stands or what it is made of; before them the first part of a class name counts.
PLACE_WORDS = set("area articles bar block box col column container group inner item items left link links list menu outer panel posts right row section slot stories text title top unit wrap wrapper".split())
#: Words that turn a class name into a statement about something else.
STATE_WORDS = set("has hide is js no not show with without".split())
#: Elements that hold the page or its article, which no class name makes boilerplate.
HOLDERS = {"article", "main", "body", "html"}
ADJACENT, SIBLING = 1.0, 0.5


def hints_of(tag: str, attributes: str) -> float:
    """What class, id and role say: a whole name or its last part counts, and its first before a word of place."""
    score = 0.0
    for h in HINT.findall(attributes):
        boiler = main = False
        for name in h.strip("\"'").lower().split():
            parts = WORD.findall(name)
            if not parts or parts[0] in STATE_WORDS:
                continue
            first = parts[0] if len(parts) > 1 and parts[-1] in PLACE_WORDS else parts[-1]
            if parts[-1] in BOILER_WORDS or first in BOILER_WORDS:
                boiler = True
            elif parts[0] in MAIN_WORDS or parts[-1] in MAIN_WORDS:
                main = True
        if boiler and tag not in HOLDERS:
            score -= 8.0
        elif main:
            score += 1.0
    return score


def ends_of(html: str, tag: str) -> dict[int, int]:
    """Of each element of a kind that is closed, by the place of its tag, the place behind its end tag; nested ones are matched from the inside."""
    ends: dict[int, int] = {}
    open_: list[int] = []
    for m in re.finditer(rf"""<(/?){tag}(?=[\s/>])((?:[^>"'<]++|"[^"]*+"|'[^']*+')*+)""", html, re.I):
        if not m[1]:
            if not m[2].endswith("/"):
                open_.append(m.start())
        elif open_:
            ends[open_.pop()] = html.find(">", m.end()) + 1 or len(html)
    return ends


def hidden_end(html: str, tag: str, begin: int, at: int, ends: dict[int, int]) -> int:
    """Where the page goes on behind an element that isn't shown, whose tag stands at `begin` and ends at `at`."""
    end = ends.get(begin)
    block = BLOCK.search(html, at, end if end is not None else len(html))
    if end is not None and (tag not in DRAWN or block is None or block[1] or "<foreignobject" in html[at:end].lower()):
        return end
    return block.start() if block else len(html)


def blocks_of(html: str) -> list[tuple[str, float, int, int, int, bool]]:
    """(text, score, parent, depth, link characters, within the article) of the text blocks of a page, in page order.

    One pass: no character of a tag is read again, and an end tag without an open element costs nothing."""
    out: list[tuple[str, float, int, int, int, bool]] = []
    # tag, summed score of it and what it is in, number, links open, within article or main
    stack: list[tuple[str, float, int, int, bool]] = [("", 0.0, 0, 0, False)]
    opened: dict[str, int] = {}
    hidden: dict[str, dict[int, int]] = {}
    parts: list[str] = []
    linked = number = at = 0
    n, last_end = len(html), html.rfind(">")

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if stack[-1][3]:
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                k = len(stack) - 1
                while k and stack[k][0] in INLINE:
                    k -= 1
                out.append((text, stack[-1][1] + (0.7 if stack[k][0] in ("p", "h1", "pre", "blockquote") else 0.0), stack[k - 1][2] if k else 0, len(stack), linked, stack[-1][4]))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt > last_end:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if html[lt + 1] in "!?":
            at = html.index(">", lt) + 1
            continue
        m = NAME.match(html, lt + 1)
        if m is None:
            say("<")
            at = lt + 1
            continue
        tag, attributes = m[2].lower(), INSIDE.match(html, m.end())[0]
        at = m.end() + len(attributes)
        if at < n and html[at] == ">":
            at += 1
        elif at < n and html[at] != "<":  # a quote that is never closed: the tag ends where the next one would, or may
            ends = [k for k in (html.find(">", at) + 1, html.find("<", at)) if k > 0]
            at = min(ends, default=n)
        elif at >= n:  # the last > stands in quotes
            at = html.index(">", m.end()) + 1
        if tag in RAW:
            if not m[1] and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in HIDDEN:
            if not m[1] and not attributes.endswith("/"):
                if tag not in hidden:
                    hidden[tag] = ends_of(html, tag)
                at = hidden_end(html, tag, lt, at, hidden[tag])
            continue
        if tag in ("br", "wbr", "img"):
            parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if m[1]:
            if opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if inline and stack[k][0] not in INLINE:
                        break  # an inline end tag closes no block
            continue
        if tag in VOID:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and opened.get(tag):
            for k in range(len(stack) - 1, 0, -1):  # such an element ends one of its own kind that is open
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] not in INLINE and stack[k][0] != "p":
                    break
        number += 1
        _, score, _, links, main = stack[-1]
        own = BOILER_TAGS.get(tag, 0.0) + MAIN_TAGS.get(tag, 0.0)
        if attributes and not inline:
            own += hints_of(tag, attributes)
        stack.append((tag, score + own, number, links + (tag == "a"), (main or tag in MAIN_TAGS) and own > -8.0))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def scores(blocks: list[tuple[str, float, int, int, int, bool]]) -> list[float]:
    """The classifier: above 0 is rather content. Links tell little of what an article holds itself."""
    out = []
    for text, score, _, _, linked, main in blocks:
        words = text.count(" ") + 1
        s = score + min(words, 40) / 20 - 0.5 - (1.0 if main else 4.0) * min(1.0, linked / len(text))
        if text[-1] in ".!?…:\"'”»。！？":
            s += 0.5
        elif words < 4:
            s -= 0.5
        out.append(s)
    return out


def min_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut; shortest augmenting paths, level by level."""
    n = len(cost)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, s in enumerate(cost):
        if s > 0:
            join(source, i, s, 0.0)
        elif s < 0:
            join(i, sink, -s, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        next_edge = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            for k in range(next_edge[a], len(out[a])):
                e = out[a][k]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    next_edge[a] = k
                    path.append(e)
                    a = to[e]
                    break
            else:
                if a == source:
                    break
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    if not blocks:
        return ""
    cost = scores(blocks)
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, (_, _, parent, depth, _, _) in enumerate(blocks):
        if i:
            far = abs(depth - blocks[i - 1][3]) + (parent != blocks[i - 1][2])
            edges.append((i - 1, i, ADJACENT / (1 + far)))
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    keep = min_cut(cost, edges)
    return "\n".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
