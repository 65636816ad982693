"""HTML main-text extraction by minimum cut: content against boilerplate over a graph of text blocks."""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|title|textarea)\b(?!(?<=svg)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s>/]|$)", re.I)
_PIECE = re.compile(r"[a-z]+")

# Element names of the HTML standard by their role here.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("html body table td th ul ol dl article main section div aside nav header footer form blockquote figure select".split())
BAD_TAGS = frozenset("nav aside footer form menu button select dialog search fieldset option head".split())
BAD_PIECES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header legal login "
    "masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion promoted recommended related reply replies respond share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription tags toolbar tracking widget widgets".split()
)
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
GOOD_PIECES = frozenset("article body content entry main post story text".split())

#: Costs: terminal capacities of what markup says, and the weights of the text's own signs.
MARKED_BAD, MARKED_GOOD, BY_CLASS = 12.0, 6.0, 3.0
NEXT, NEXT_SAME, NEAR = 0.3, 0.6, 0.3


class _Box:
    """An open block element: its tag and what it says of the text in it."""

    __slots__ = ("tag", "bad", "good", "key")

    def __init__(self, tag: str, bad: bool, good: float, key: int):
        self.tag, self.bad, self.good, self.key = tag, bad, good, key


def _open(tag: str, attrs: str, up: _Box | None, key: int) -> _Box:
    bad, good = bool(up and up.bad), up.good if up else 0.0
    words, role, hidden = [], "", False
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                words += [(w, _PIECE.findall(w)) for w in value.split()]
            elif name == "role":
                role = value
            elif name == "style":
                hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
            else:
                hidden = hidden or value != "false"
    frame = tag in ("html", "body", "main") or role == "main"
    pieces = {p for w, ps in words if not (ps and ps[0] in ("has", "with", "no", "without")) and "with" not in ps for p in ps}
    if tag in ("article", "main") or role in ("main", "article"):
        good = MARKED_GOOD
    elif pieces & GOOD_PIECES and not pieces & BAD_PIECES:
        good = max(good, BY_CLASS)
    bad = bad or hidden or tag in BAD_TAGS or role in BAD_ROLES or (tag == "header" and good < MARKED_GOOD) or (not frame and bool(pieces & BAD_PIECES))
    return _Box(tag, bad, good, key)


def blocks(html: str | None) -> list[tuple[str, int, _Box, str]]:
    """(text, characters in links, enclosing box, tag) of each block of text, in page order."""
    out: list[tuple[str, int, _Box, str]] = []
    stack = [_Box("#page", False, 0.0, 0)]
    parts: list[str] = []
    linked, in_link, key = 0, False, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, min(linked, len(text)), stack[-1], stack[-1].tag))
            parts.clear()
        linked = 0

    at, html = 0, html or ""
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        if m["cdata"] is not None:
            parts.append(m["cdata"].replace("&", "&amp;"))
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = not m["end"]
        elif tag in ("br", "wbr"):
            parts.append(" " if tag == "br" else "")
        elif tag in BLOCK_TAGS:
            flush()
            in_link = False
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if tag == "p" and stack[k].tag in SCOPES:
                        break
            else:
                closed = CLOSES.get(tag, {"p"})
                while len(stack) > 1 and stack[-1].tag in closed:
                    stack.pop()
                if tag not in VOID_TAGS:
                    key += 1
                    stack.append(_open(tag, m["attrs"], stack[-1], key))
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out


def _cost(text: str, linked: int, box: _Box, tag: str) -> float:
    """How much it costs to call the block boilerplate rather than content; below 0 the other way round."""
    if box.bad:
        return -MARKED_BAD
    share = linked / len(text)
    cost = box.good + min(len(text), 400) / 200 - 0.3 - 4 * share * (len(text) < 200 or share > 0.8)
    if text[-1] in ".!?…。\"”»":
        cost += 0.5
    if tag in ("h1", "h2", "h3", "p", "blockquote", "pre", "figcaption"):
        cost += 0.4
    return cost


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut.

    A node's cost is its capacity from the source where positive and to the sink where negative; edges are (i, j,
    capacity) both ways. Shortest augmenting paths; what a search reaches without meeting the sink stays on the
    source's side and is never searched again. Of equal cuts, the one with the fewest nodes at the source.
    """
    n = len(costs)
    room = list(costs)
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        links[i][j] = links[i].get(j, 0.0) + c
        links[j][i] = links[j].get(i, 0.0) + c
    source = [False] * n
    for s in range(n):
        while room[s] > 1e-12 and not source[s]:
            came, queue, end = {s: s}, deque([s]), -1
            while queue and end < 0:
                i = queue.popleft()
                for j, c in links[i].items():
                    if c > 1e-12 and j not in came and not source[j]:
                        came[j] = i
                        if room[j] < -1e-12:
                            end = j
                            break
                        queue.append(j)
            if end < 0:
                for i in came:
                    source[i] = True
                break
            path, j = [], end
            while j != s:
                path.append((came[j], j))
                j = came[j]
            flow = min(room[s], -room[end], *(links[i][j] for i, j in path))
            for i, j in path:
                links[i][j] -= flow
                links[j][i] += flow
            room[s] -= flow
            room[end] += flow
    return source


def main_text(html: str | None) -> str:
    """The content blocks of a page, one to a line; empty for null and empty pages and where all is boilerplate."""
    found = blocks(html)
    edges, last = [], {}
    for k, (_, _, box, _) in enumerate(found):
        if k:
            edges.append((k - 1, k, NEXT_SAME if found[k - 1][2].bad == box.bad and found[k - 1][2].good == box.good else NEXT))
        near = last.get((box.tag, box.good, box.bad))
        if near is not None and near < k - 1:
            edges.append((near, k, NEAR))
        last[(box.tag, box.good, box.bad)] = k
    kept = min_cut([_cost(*b) for b in found], edges)
    return "\n".join(b[0] for b, keep in zip(found, kept) if keep)


def main_text_column(html):
    """A column of main texts of whole pages."""

    @F.pandas_udf(T.StringType())
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return of(html)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with a column of main texts, which replaces one of that name.

    Each row gives one row, repeated rows too; null and empty pages have empty texts, an empty table gives none. Of equal
    cuts the one with the least content counts.
    """
    return pages.withColumn(out_col, main_text_column(F.col(html_col)))
