"""A small HTML tree for tag soup, and the relation of its elements."""

from __future__ import annotations

import html as _html
import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the keys ends when one of the values starts.
ENDS = {
    "p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
    "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]),
}
FENCED = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "thead": {"table"}, "tbody": {"table"}}
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset(["script", "style"])
#: Elements nested deeper become siblings, as in browsers, which allow some more; the tree's walks recurse once or a few times a level.
MAX_DEPTH = 200
sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * MAX_DEPTH))
SPACE = re.compile(r"\s+")
#: Characters that a byline or a text of a blog's chrome has at most.
SHORT = 200
_BYLINE = re.compile(r"\s*by\s+[A-Z]", re.I)


class Text(str):
    """A text node; comments have the flag set."""

    comment = False


class Comment(Text):
    comment = True


class Node:
    """An element with ordered children, which are nodes or texts."""

    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, up: Node | None = None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs or {}, [], up

    def add(self, kid):
        if isinstance(kid, Node):
            kid.up = self
        self.kids.append(kid)
        return kid

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """All elements below, in page order."""
        for kid in list(self.kids):
            if isinstance(kid, Node):
                yield kid
                yield from kid.walk()

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def above(self) -> Iterator[Node]:
        n = self.up
        while n is not None:
            yield n
            n = n.up

    def place(self) -> int:
        return next(i for i, k in enumerate(self.up.kids) if k is self)

    def drop(self) -> None:
        if self.up is not None and any(k is self for k in self.up.kids):
            del self.up.kids[self.place()]

    def swap(self, *kids) -> None:
        """Put kids in this element's place."""
        up, at = self.up, self.place()
        for k in kids:
            if isinstance(k, Node):
                k.up = up
        up.kids[at : at + 1] = list(kids)

    def unwrap(self) -> None:
        self.swap(*self.kids)

    def next_element(self) -> Node | None:
        after = self.up.kids[self.place() + 1 :] if self.up else []
        return next((k for k in after if isinstance(k, Node)), None)

    def whole(self) -> str:
        """The text as it stands, without comments and scripts; no line ends for br."""
        out = []
        for k in self.kids:
            if isinstance(k, Node):
                if k.tag not in RAW:
                    out.append(k.whole())
            elif not k.comment:
                out.append(str(k))
        return "".join(out)

    def text(self) -> str:
        """The text with single spaces; blocks and line breaks part words."""
        out: list[str] = []
        self._gather(out)
        return SPACE.sub(" ", "".join(out)).strip()

    def _gather(self, out: list[str]) -> None:
        for k in self.kids:
            if isinstance(k, Node):
                if k.tag in RAW:
                    continue
                if k.tag in BLOCKS:
                    out.append(" ")
                k._gather(out)
                if k.tag in BLOCKS:
                    out.append(" ")
            elif not k.comment:
                out.append(str(k))

    def own(self) -> str:
        return SPACE.sub(" ", "".join(str(k) for k in self.kids if not isinstance(k, Node) and not k.comment)).strip()

    def outer(self) -> str:
        attrs = "".join(f' {k}="{_html.escape(v)}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        return f"<{self.tag}{attrs}>{self.inner()}</{self.tag}>"

    def inner(self) -> str:
        out = []
        for k in self.kids:
            if isinstance(k, Node):
                out.append(k.outer())
            elif k.comment:
                out.append(f"<!--{k}-->")
            else:
                out.append(str(k) if self.tag in RAW else _html.escape(k, quote=False))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and tag in ENDS.get(self.open[-1].tag, ()):
            self.open.pop()
        for back in range(len(self.open) - 1, 0, -1):
            here = self.open[back].tag
            if here in FENCED and tag in ENDS.get(here, ()):
                del self.open[back:]
                break
            if here in ("table", "ul", "ol", "dl", "article", "body", "div"):
                break
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        node = self.open[-1].add(Node(tag, first))
        if tag not in VOID and len(self.open) <= MAX_DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for back in range(len(self.open) - 1, 0, -1):
            if self.open[back].tag == tag:
                del self.open[back:]
                return

    def handle_data(self, data):
        self.open[-1].add(Text(data))

    def handle_comment(self, data):
        self.open[-1].add(Comment(data))


def parse(markup: str | None) -> Node:
    """The tree of a page or fragment; a null gives an empty one. Never raises on malformed markup."""
    builder = _Builder()
    builder.feed(markup or "")
    builder.close()
    return builder.root


def article_root(root: Node) -> Node | None:
    """The first article, else the body, else the page itself if it has any element."""
    return root.first("article") or root.first("body") or (root if root.elements() else None)


def places(order: list[Node]) -> dict[int, tuple[int, Node | None, int, int]]:
    """For each element below those in order: its place, the next element, its place among those of its tag, and
    their number."""
    at: dict[int, tuple[int, Node | None, int, int]] = {}
    for up in order:
        after, left = None, {}
        for pos in range(len(up.kids) - 1, -1, -1):
            kid = up.kids[pos]
            if isinstance(kid, Node):
                left[kid.tag] = left.get(kid.tag, 0) + 1
                at[id(kid)] = (pos, after, left[kid.tag], 0)
                after = kid
        for kid in up.elements():
            pos, follows, back, _ = at[id(kid)]
            at[id(kid)] = (pos, follows, left[kid.tag] - back + 1, left[kid.tag])
    return at


def selector(node: Node, at: dict[int, tuple] | None = None) -> str:
    """#id, else up to six steps of tags with their place among siblings of the tag, down from the article."""
    if node.attrs.get("id"):
        return f"#{node.attrs['id']}"
    at = places(list(node.above())) if at is None else at
    steps: list[str] = []
    while len(steps) < 6 and id(node) in at and node.tag not in ("html", "body", "article", "#root"):
        _, _, nth, alike = at[id(node)]
        steps.append(node.tag if alike == 1 else f"{node.tag}:nth-of-type({nth})")
        node = node.up
    return " > ".join(reversed(steps)) or node.tag


def numbered_code(table: Node) -> str | None:
    """The code of a table of line numbers on the left and code on the right, else null."""
    cells = table.all("td")
    if len(cells) < 2:
        return None
    left, right = cells[:2]
    pre, lines, code = left.first("pre"), left.elements(), right.first("pre", "code")
    by_pre = pre is not None and re.fullmatch(r"[\d \n]+", pre.whole().strip()) is not None
    by_div = bool(lines) and code is not None and all(d.tag == "div" and re.fullmatch(r"\d+", d.text()) for d in lines)
    if not (by_pre or by_div):
        return None
    rows = [d for d in (code or right).elements() if d.tag == "div"]
    return "\n".join(d.whole() for d in rows) if rows else (code or right).whole()


NODE_SCHEMA = (
    "node_id int, parent_id int, pos int, depth int, tag string, attrs map<string,string>, classes array<string>, ancestors array<string>, inside map<string,int>, "
    "text string, own_text string, whole_text string, outer_html string, after string, next_tag string, next_classes array<string>, next_has_img boolean, selector string, in_byline boolean, numbered_code string"
)


def _byline(text: str) -> bool:
    """Whether a text begins as a byline and is as short as texts of a blog's chrome are."""
    return _BYLINE.match(text) is not None and len(" ".join(text.split())) <= SHORT


def rows(markup: str | None) -> Iterator[tuple]:
    """The elements of the article root and below, numbered in page order from 0, as NODE_SCHEMA says.

    inside counts the elements below by tag; after is the text that follows the element directly; in_byline tells
    elements that are, or are in, a short p, div or span that begins as a byline. A page without an article or body
    has one row, of number -1; a page that can't be taken apart has one of number -2 with the reason as its text.
    """
    try:
        found = list(_rows(markup))
    except Exception as wrong:  # one page must not stop the others
        found = [(-2, -1, 0, 0, "#error", {}, [], [], {}, f"{type(wrong).__name__}: {wrong}", "", "", None, None, None, None, False, None, False, None)]
    yield from found


def _rows(markup: str | None) -> Iterator[tuple]:
    root = article_root(parse(markup))
    if root is None:
        yield (-1, -1, 0, 0, "#none", {}, [], [], {}, "", "", "", None, None, None, None, False, None, False, None)
        return
    order = [root, *root.walk()]
    number = {id(node): k for k, node in enumerate(order)}
    inside: list[dict[str, int]] = [{} for _ in order]
    for k in range(len(order) - 1, 0, -1):  # from the leaves up, so that each element is counted once a level
        up = inside[number[id(order[k].up)]]
        up[order[k].tag] = up.get(order[k].tag, 0) + 1
        for tag, n in inside[k].items():
            up[tag] = up.get(tag, 0) + n
    at = places(order)
    bylines: set[int] = set()
    for k, node in enumerate(order):
        if id(node.up) in bylines or (node.tag in ("p", "div", "span") and k and _byline(node.whole())):
            bylines.add(id(node))
        above = [a.tag for a in node.above() if id(a) in number]
        nxt, pos, after = None, 0, None
        if k:
            pos, nxt, _, _ = at[id(node)]
            follow = node.up.kids[pos + 1] if pos + 1 < len(node.up.kids) else None
            after = str(follow) if isinstance(follow, Text) and not follow.comment else None
        yield (
            k, number.get(id(node.up), -1), pos, len(above), node.tag, dict(node.attrs), node.classes, above, inside[k], node.text(), node.own(), node.whole(),
            node.outer() if node.tag in ("noscript", "pre", "code", "script") else None, after, nxt.tag if nxt else None, nxt.classes if nxt else None,
            bool(nxt and (nxt.tag == "img" or nxt.first("img"))), selector(node, at), id(node) in bylines, numbered_code(node) if node.tag == "table" else None,
        )
