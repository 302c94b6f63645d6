"""A small document tree over the standard library's HTML parser, with the selectors that extractors need."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import Any

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: An open element of these is closed by the next one of its kind.
SELF_CLOSING = frozenset(("li", "p", "option", "tr", "td", "th", "dt", "dd"))


class Node:
    __slots__ = ("attrs", "children", "index", "order", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, order: int = 0) -> None:
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.children: list[Node | str] = []
        #: Of a page only: its elements by tag, .class and [attribute, in document order, so that a selector looks at few.
        self.index: dict[str, list[Node]] | None = None

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order; without recursion, so depth has no limit."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in ("script", "style"):
                stack.extend(reversed(item.children))

    def text(self, between: str = " ") -> str:
        return between.join(s for s in (x.strip() for x in self.strings()) if s)

    def raw(self) -> str:
        """What stands directly inside, as of a script."""
        return "".join(c for c in self.children if isinstance(c, str))

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def classes(self) -> list[str]:
        return self.get("class").split()

    def select(self, selector: str) -> Iterator[Node]:
        """Elements that match a list of compounds with descendant combinators, in document order."""
        chains = _chains(selector)
        for node in self.walk() if self.index is None else self._likely(chains):
            if any(_matches(node, chain, self) for chain in chains):
                yield node

    def _likely(self, chains: list[list[Compound]]) -> Iterable[Node]:
        """A page's elements that the last compound of some chain may match."""
        keys = {chain[-1].key for chain in chains}
        if len(keys) == 1:
            return self.index.get(next(iter(keys)), ())
        return sorted({n for k in keys for n in self.index.get(k, ())}, key=lambda n: n.order)

    def first(self, selector: str) -> Node | None:
        return next(self.select(selector), None)

    def above(self, selector: str) -> Node | None:
        """The nearest ancestor that matches a compound."""
        test, node = _chains(selector)[0][-1], self.parent
        while node is not None and not (node.tag and test.fits(node)):
            node = node.parent
        return node


_PART = re.compile(r"""([.#]?)([A-Za-z0-9_-]+)|\[([\w-]+)(?:(\*?=)['"]?([^'"\]]*)['"]?)?\]""")


@dataclass(frozen=True)
class Compound:
    """A test of an element, and the index entry in which all elements that pass it stand."""

    fits: Callable[[Node], bool]
    key: str


#: Selectors as read before; a plain dict, as it goes along with the functions to where the package isn't installed.
_READ: dict[str, Any] = {}


def _compound(selector: str) -> Compound:
    tests: list[Callable[[Node], bool]] = []
    keys: list[str] = []
    for mark, name, attr, how, value in _PART.findall(selector):
        if attr:
            tests.append(lambda n, a=attr, h=how, v=value: a in n.attrs and (not h or (v in n.attrs[a] if h == "*=" else n.attrs[a] == v)))
            keys.append("[" + attr)
        elif mark == ".":
            tests.append(lambda n, c=name: c in n.classes())
            keys.append("." + name)
        elif mark == "#":
            tests.append(lambda n, i=name: n.get("id") == i)
            keys.append("[id")
        else:
            tests.append(lambda n, t=name.lower(): n.tag == t)
            keys.append(name.lower())
    return Compound(lambda n: all(t(n) for t in tests), min(keys, key=lambda k: (".[".find(k[0]) % 3, k), default=""))


def _chains(selector: str) -> list[list[Compound]]:
    if selector not in _READ:
        _READ[selector] = [[_compound(c) for c in one.split()] for one in selector.split(",")]
    return _READ[selector]


def _matches(node: Node, chain: list[Compound], top: Node) -> bool:
    if not chain[-1].fits(node):
        return False
    left, up = len(chain) - 2, node.parent
    while left >= 0 and up is not None and up is not top.parent:
        if up.tag and chain[left].fits(up):
            left -= 1
        up = up.parent
    return left < 0


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", {}, None)
        self.top.index, self.seen = defaultdict(list), 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SELF_CLOSING and self.at.tag == tag and self.at.parent is not None:
            self.at = self.at.parent
        self.seen += 1
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, self.seen)
        self.at.children.append(node)
        for key in {tag, *("[" + k for k in node.attrs), *("." + c for c in node.classes())}:
            self.top.index[key].append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; broken markup gives what could be read of it."""
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except (AssertionError, ValueError):
        pass
    return builder.top


def json_products(page: Node, kind: str = "Product") -> list[dict[str, Any]]:
    """All objects of a type in a page's JSON-LD, through lists, graphs and item lists; bad JSON is skipped."""
    found: list[dict[str, Any]] = []
    for script in page.select("script"):
        if script.get("type") != "application/ld+json":
            continue
        try:
            stack = [json.loads(script.raw().strip())]
        except ValueError:
            continue
        while stack:
            item = stack.pop()
            if isinstance(item, list):
                stack.extend(reversed(item))
            elif isinstance(item, dict):
                types = item.get("@type")
                if types == kind or isinstance(types, list) and kind in types:
                    found.append(item)
                elements = item.get("itemListElement")
                below = [e.get("item") if isinstance(e, dict) else e for e in elements] if isinstance(elements, list) else []
                graph = item.get("@graph")
                stack.extend(reversed([*(graph if isinstance(graph, list) else []), *below]))
    return found
