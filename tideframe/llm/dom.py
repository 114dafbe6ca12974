"""A small tolerant reader of HTML into trees, and simple tree matching between two of them.

Reading takes time in proportion to the page, whatever is left open in it; no function here recurses, so depth is free.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator

START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
TAG_END = re.compile(r"[\s/]*>")
# Element names by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HEAD_PARTS = frozenset("base link meta title style script noscript template".split())
BLOCK = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("br body html td th tr title".split())
#: Elements that end an open one of the same kind, up to the nearest element that holds them.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}


class Node:
    """An element: its label (name, and class, id or role), and its children (elements and strings)."""

    __slots__ = ("children", "hints", "label", "tag")

    def __init__(self, tag: str, hints: str = ""):
        self.tag, self.hints, self.children = tag, hints, []
        self.label = f"{tag}.{hints}" if hints else tag

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def own_text(self) -> str:
        return " ".join(" ".join(c for c in self.children if isinstance(c, str)).split())


class _Stack:
    """The open elements, and the places of each kind among them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in BLOCK:
            self.blocks.append(at)

    def last(self, tags: tuple[str, ...]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.nodes) > at:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def make_room(self, tag: str) -> None:
        """Close what a new element of that kind ends."""
        if self.nodes[-1].tag == "head" and tag not in HEAD_PARTS:
            self.cut(len(self.nodes) - 1)
        if tag in CLOSES_P and (at := self.last(("p",))) and self.blocks[-1] == at:
            self.cut(at)
        if tag in SIBLINGS and (at := self.last(SIBLINGS[tag])) > self.last(HOLDERS[tag]):
            self.cut(at)


def _attributes(text: str, at: int) -> tuple[str, int, bool]:
    """Class, id and role of a tag whose name ends at `at`; where the tag ends; whether it closes itself.

    A quote that is never closed is part of its value, which then ends at the next space or sign of the tag's end.
    """
    hints, slash = [], False
    while (found := TAG_END.match(text, at)) is None:
        part = ATTRIBUTE.match(text, at)
        if part is None:
            return "", len(text), False
        if part[1].lower() in ("class", "id", "role"):
            hints.append(part[2] or part[3] or part[4] or "")
        at = part.end()
    slash = "/" in found[0]
    return " ".join(" ".join(hints).lower().split()), found.end(), slash


def parse(page: str | None) -> Node:
    """The tree of a page; whatever is missing or misplaced is mended or passed over. Comments are dropped."""
    root = Node("#root")
    stack, text = _Stack(root), page or ""
    at, n = 0, len(text)

    def add(part: str) -> None:
        if stack.nodes[-1].tag == "head" and part.strip():
            stack.cut(len(stack.nodes) - 1)
        stack.nodes[-1].children.append(html.unescape(part) if "&" in part else part)

    while at < n:
        found = START.search(text, at)
        if found is None:
            add(text[at:])
            break
        if found.start() > at:
            add(text[at : found.start()])
        at = found.end()
        if found[1] or found[2]:
            end = text.find("-->" if found[1] else ">", at)
            at = n if end < 0 else end + (3 if found[1] else 1)
            continue
        tag = found[4].lower()
        hints, at, slash = ("", at + 1, False) if text[at : at + 1] == ">" else _attributes(text, at)
        if found[3]:
            if place := stack.last((tag,)):
                stack.cut(place)
            continue
        stack.make_room(tag)
        node = Node(tag, hints)
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
            inside = text[at : end.start() if end else n]
            at = _attributes(text, end.end())[1] if end else n
            node.children.append(html.unescape(inside) if tag in ("title", "textarea") else inside)
        elif tag not in VOID and not slash:
            stack.push(node)
    return root


#: Pairs of children that one matching weighs against each other; what lies beyond is aligned in order, without choice.
MOST_PAIRS = 100_000


def in_order(left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
    """Children with equal labels, the first with the first, from both ends of the lists."""
    out, i, j = [], 0, 0
    places: dict[str, list[int]] = {}
    for k in range(len(right) - 1, -1, -1):
        places.setdefault(right[k].label, []).append(k)
    for i in range(len(left)):
        held = places.get(left[i].label, [])
        while held and held[-1] < j:
            held.pop()
        if held:
            j = held.pop()
            out.append((left[i], right[j]))
            j += 1
    return out


def _match(a: Node, b: Node, room: list[int]) -> Generator:
    """The match of two trees with equal labels, as a generator that yields the matches it needs first: size, the two
    nodes, and the matches below them."""
    left, right = a.elements(), b.elements()
    if not left or not right:
        return 1, a, b, []
    if len(left) * len(right) > room[0]:
        size, out = 1, []
        for x, y in in_order(left, right):
            found = yield _match(x, y, room)
            size += found[0]
            out.append(found)
        return size, a, b, out
    room[0] -= len(left) * len(right)
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    pairs: dict[tuple[int, int], tuple] = {}
    for i, x in enumerate(left, 1):
        row, above = best[i], best[i - 1]
        for j, y in enumerate(right, 1):
            most = row[j - 1] if row[j - 1] > above[j] else above[j]
            if x.label == y.label:
                found = pairs[i, j] = (yield _match(x, y, room)) if x.children and y.children else (1, x, y, [])
                most = max(most, above[j - 1] + found[0])
            row[j] = most
    out, i, j = [], len(left), len(right)
    while i and j:
        if (i, j) in pairs and best[i][j] == best[i - 1][j - 1] + pairs[i, j][0]:
            out.append(pairs[i, j])
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[len(left)][len(right)], a, b, out


def match_trees(a: Node, b: Node, most_pairs: int = MOST_PAIRS) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most node pairs that keep labels, order and parents, and those pairs.

    The most, if no more than most_pairs pairs of children have to be weighed; else a matching of the same kind.
    """
    if a.label != b.label:
        return 0, []
    waiting, value = [_match(a, b, [most_pairs])], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as done:
            waiting.pop()
            value = done.value
    pairs, below = [], [value]
    while below:
        _, x, y, more = below.pop()
        pairs.append((x, y))
        below += more
    return value[0], pairs
