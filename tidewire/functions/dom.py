"""A small document tree over the standard library's HTML tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element; ``children`` holds elements and strings."""

    __slots__ = ("attributes", "children", "order", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None, order: int):
        self.tag, self.attributes, self.parent, self.order = tag, attributes, parent, order
        self.children: list[Node | str] = []

    def get(self, name: str) -> str:
        return self.attributes.get(name, "")

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def by_id(self, name: str) -> Node | None:
        return next((n for n in self.walk() if n.get("id") == name), None)

    def by_class(self, name: str) -> list[Node]:
        return [n for n in self.walk() if name in n.get("class").split()]

    def parents(self) -> Iterator[Node]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent

    def strings(self, skip: frozenset[Node] = frozenset()) -> Iterator[str]:
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                if item.strip():
                    yield item.strip()
            elif item not in skip:
                todo += reversed(item.children)

    def text(self, limit: int | None = None, skip: frozenset[Node] = frozenset()) -> str:
        return " ".join(" ".join(self.strings(skip)).split())[:limit]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("", {}, None, 0)
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.count += 1
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        node = Node(tag, seen, self.top, self.count)
        self.top.children.append(node)
        if tag not in VOID:
            self.top = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.top = self.top.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        at: Node | None = self.top
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.top = at.parent

    def handle_data(self, data: str) -> None:
        self.top.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
