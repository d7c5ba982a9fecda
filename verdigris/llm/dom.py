"""A tolerant HTML tree of structural elements, its folded form, and simple tree matching."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

#: HTML's element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
#: An element that begins closes an open element of these kinds, up to one of the kinds after them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>a-zA-Z][^>]*>?|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


class Node:
    """An element; own is its text outside of structural children, in pieces between them."""

    __slots__ = ("attrs", "children", "parent", "runs", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.runs: list[list[str]] = [[]]  # text before each child, and after the last

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(self.attrs)} if self.attrs else {}


def parse(source: str) -> Node:
    """The tree of a page. Inline elements are transparent, except that white space parts words as written."""
    root = here = Node("", "", None)
    at, n, skip = 0, len(source), TOKEN
    while at < n:
        m = skip.search(source, at)
        if m is None:
            here.runs[-1].append(source[at:])
            break
        if m.start() > at:
            here.runs[-1].append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            here = _close(here, tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            if tag not in ("script", "style"):
                _child(here, tag, m[3] or "").runs[-1].append(source[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        if tag == "br":
            here.runs[-1].append(" ")
        if tag in VOID and tag != "hr":
            continue
        if tag not in BLOCK and tag not in KEPT_INLINE and not (m[3] and HIDING.search(m[3])):
            continue
        if tag in CLOSES_P:
            here = _close_p(here)
        if tag in IMPLIED:
            here = _implied(here, *IMPLIED[tag])
        node = _child(here, tag, m[3] or "")
        if tag not in VOID and not (m[3] or "").endswith("/") or tag in BLOCK and tag != "hr":
            here = node
    return root


#: Inline elements that are kept because their content may have to go.
KEPT_INLINE = frozenset("button select datalist object svg math canvas video audio noscript template label output progress meter".split())
HIDING = re.compile(r"\b(?:class|id|role|hidden|style|aria-hidden)\b", re.I)


def _child(parent: Node, tag: str, attrs: str) -> Node:
    node = Node(tag, attrs, parent)
    parent.children.append(node)
    parent.runs.append([])
    return node


def _close(here: Node, tag: str) -> Node:
    """What is open after </tag>; an end tag without its element is ignored. Table cells and the like hold an end tag in."""
    node = here
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if node.tag in ("td", "th", "article", "main") and tag not in BLOCK:
            return here
        node = node.parent
    return here


def _close_p(here: Node) -> Node:
    node = here
    while node.parent is not None and node.tag not in BLOCK - {"p"}:
        if node.tag == "p":
            return node.parent
        node = node.parent
    return here


def _implied(here: Node, kinds: set[str], until: set[str]) -> Node:
    node, out = here, here
    while node.parent is not None and node.tag not in until:
        if node.tag in kinds:
            out = node.parent
        node = node.parent
    return out


def walk(root: Node) -> Iterator[tuple[Node, int]]:
    """(node, run number) in page order: a run of text, then the child after it, and so on."""
    stack = [(root, 0)]
    while stack:
        node, i = stack.pop()
        yield node, i
        if i < len(node.children):
            stack.append((node, i + 1))
            stack.append((node.children[i], 0))


def run_text(node: Node, i: int) -> str:
    return " ".join(html.unescape("".join(node.runs[i])).split()) if node.runs[i] else ""


#: Elements of running text; neighbours of one form fold from two on, other elements from three on.
TEXT = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6 blockquote pre hr caption figcaption".split())
DIGITS = re.compile(r"\d+")


class Shape:
    """A node of a folded tree: one element, or a run of neighbouring elements of the same form, whose insides are left out."""

    __slots__ = ("classes", "form", "kids", "nodes", "number", "repeated", "tag")

    def __init__(self, tag: str, classes: str, kids: list[Shape], nodes: list[Node], repeated: bool = False):
        self.tag, self.classes, self.kids, self.nodes, self.repeated = tag, classes, kids, nodes, repeated
        self.form, self.number = 0, -1


def classes(node: Node) -> str:
    return ".".join(sorted(DIGITS.sub("", node.attributes().get("class", "")).split())) if node.attrs else ""


def fold(root: Node) -> Shape:
    """The folded tree, without recursion: pages can be as deep as they like."""
    order, stack, made, forms = [], [root], {}, {}
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.children)
    for node in reversed(order):
        kids: list[Shape] = []
        for form, run in groupby((made.pop(id(c)) for c in node.children), key=lambda k: k.form):
            same = list(run)
            if len(same) >= (2 if same[0].tag in TEXT else 3):
                one = Shape(same[0].tag, same[0].classes, [], [x for k in same for x in k.nodes], True)
                one.form = -form
                same = [one]
            kids += same
        out = made[id(node)] = Shape(node.tag, classes(node), kids, [node])
        out.form = forms.setdefault((out.tag, out.classes, *(k.form for k in kids)), len(forms) + 1)
    return made[id(root)]


class Matching:
    """Simple tree matching of two folded trees: the heaviest set of pairs that keep element, ancestors and order. A pair weighs
    1, and 1 more if the classes are the same.

    Exact while the cells of its tables fit into ``cells``; child lists beyond that are paired in linear time, the n-th element of a
    kind with the n-th, as far as the order is kept. What lies deeper than ``levels`` belongs to its ancestor there."""

    def __init__(self, a: Shape, b: Shape, cells: int = 400_000, levels: int = 400):
        self.left, self.levels = cells, levels
        self.memo: dict[tuple[int, int], tuple[int, list]] = {}
        self.roots = a, b
        self.total = self.score(a, b, 0)

    def score(self, a: Shape, b: Shape, level: int) -> int:
        if a.tag != b.tag:
            return 0
        key = id(a), id(b)
        if (found := self.memo.get(key)) is None:
            pairs = self._children(a.kids, b.kids, level + 1) if a.kids and b.kids and level < self.levels else []
            found = self.memo[key] = 1 + (a.classes == b.classes) + sum(w for _, _, w in pairs), pairs
        return found[0]

    def _children(self, xs: list[Shape], ys: list[Shape], level: int) -> list[tuple[Shape, Shape, int]]:
        if len(xs) * len(ys) > self.left:
            return [(x, y, self.score(x, y, level)) for x, y in in_order(xs, ys)]
        self.left -= len(xs) * len(ys)
        table = [[0] * (len(ys) + 1)]
        for x in xs:
            row, new = table[-1], [0]
            for j, y in enumerate(ys):
                w = self.score(x, y, level)
                new.append(max(row[j + 1], new[j], row[j] + w if w else 0))
            table.append(new)
        out, i, j = [], len(xs), len(ys)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j], self.score(xs[i], ys[j], level)))
        return out[::-1]

    def pairs(self) -> Iterator[tuple[Shape, Shape]]:
        stack = [self.roots] if self.total else []
        while stack:
            a, b = stack.pop()
            yield a, b
            stack.extend((x, y) for x, y, _ in self.memo[id(a), id(b)][1])


def in_order(xs: list[Shape], ys: list[Shape]) -> list[tuple[Shape, Shape]]:
    """The n-th element of a kind with the n-th one, less those that would cross: a longest increasing run of places."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(ys):
        places.setdefault(y.tag, []).append(j)
    met: dict[str, int] = {}
    both = []
    for x in xs:
        n = met[x.tag] = met.get(x.tag, -1) + 1
        if n < len(places.get(x.tag, ())):
            both.append((x, places[x.tag][n]))
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for i, (_, j) in enumerate(both):
        k = bisect_left(ends, j)
        before.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [j], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append((both[i][0], ys[both[i][1]]))
        i = before[i]
    return out[::-1]
