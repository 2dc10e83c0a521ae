"""A minimal element tree over the standard HTML tokenizer, with a selector subset."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# an opening tag on the left closes an open tag on the right
CLOSES = {
    "p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
}
BLOCKS_CLOSE_P = {
    "div", "ul", "ol", "table", "section", "article", "header", "footer", "nav", "aside", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "main",
}
SCOPES = {"table", "ul", "ol", "dl", "div", "section", "article", "body", "html"}


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        parts: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
            else:
                stack.extend(reversed(item.children))
        return "".join(parts)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.at = self.root

    def _close(self, tags: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in SCOPES | tags:
            node = node.parent
        if node.tag in tags and node.parent is not None:
            self.at = node.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in CLOSES:
            self._close(CLOSES[tag])
        elif tag in BLOCKS_CLOSE_P:
            self._close({"p"})
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


# ---- selectors --------------------------------------------------------------

_SIMPLE = re.compile(
    r"(?P<tag>[A-Za-z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?P<q>[\"']?)(?P<val>.*?)(?P=q)\s*)?\]"
    r"|:nth-of-type\((?P<nth>\d+)\)|:nth-child\((?P<child>\d+)\)|:(?P<edge>first|last)-child"
)


def _attr_test(name: str, op: str | None, want: str):
    tests = {
        None: lambda v: True,
        "=": lambda v: v == want,
        "*=": lambda v: want in v,
        "^=": lambda v: v.startswith(want),
        "$=": lambda v: v.endswith(want),
        "~=": lambda v: want in v.split(),
        "|=": lambda v: v == want or v.startswith(want + "-"),
    }
    return lambda n: name in n.attrs and tests[op](n.attrs[name])


def _siblings(node: Node, tag: str | None = None) -> list[Node]:
    if node.parent is None:
        return [node]
    return [c for c in node.parent.children if isinstance(c, Node) and tag in (None, c.tag)]


def _compound(text: str):
    tests, end = [], 0
    for m in _SIMPLE.finditer(text):
        if m.start() != end:
            raise ValueError(f"selector not supported: {text!r}")
        end = m.end()
        if m["tag"]:
            tests.append(lambda n, t=m["tag"].lower(): t in ("*", n.tag))
        elif m["id"]:
            tests.append(lambda n, i=m["id"]: n.attrs.get("id") == i)
        elif m["cls"]:
            tests.append(lambda n, c=m["cls"]: c in n.attrs.get("class", "").split())
        elif m["attr"]:
            tests.append(_attr_test(m["attr"].lower(), m["op"], m["val"] or ""))
        elif m["nth"]:
            tests.append(lambda n, k=int(m["nth"]): _siblings(n, n.tag).index(n) == k - 1)
        elif m["child"]:
            tests.append(lambda n, k=int(m["child"]): _siblings(n).index(n) == k - 1)
        else:
            tests.append(lambda n, at=0 if m["edge"] == "first" else -1: _siblings(n)[at] is n)
    if end != len(text) or not tests:
        raise ValueError(f"selector not supported: {text!r}")
    return lambda n: all(t(n) for t in tests)


class Selector:
    """Comma lists of compounds joined by descendant or child combinators."""

    def __init__(self, text: str) -> None:
        self.chains = []
        for option in text.split(","):
            steps = re.sub(r"\s*>\s*", " > ", option.strip()).split()
            chain, direct = [], False
            for step in steps:
                if step == ">":
                    direct = True
                else:
                    chain.append((_compound(step), direct))
                    direct = False
            self.chains.append(chain)

    def matches(self, node: Node) -> bool:
        return any(self._matches(node, chain, len(chain) - 1) for chain in self.chains)

    def _matches(self, node: Node, chain, at: int) -> bool:
        test, direct = chain[at]
        if node.tag == "#document" or not test(node):
            return False
        if at == 0:
            return True
        if direct:
            return node.parent is not None and self._matches(node.parent, chain, at - 1)
        return any(self._matches(a, chain, at - 1) for a in node.ancestors())

    def all(self, root: Node) -> list[Node]:
        return [n for n in root.walk() if self.matches(n)]
