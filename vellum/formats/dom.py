"""A small HTML tree on the standard library's tokeniser, with the implied end tags that browsers and parsers add."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

#: Fixed values of HTML: elements without content, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section summary table ul".split()
)
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: An implied end never reaches out of these.
_WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}


class Comment(str):
    pass


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        for c in self.elements():
            yield c
            yield from c.walk()

    def strings(self, comments: bool = False) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, Node):
                yield from c.strings(comments)
            elif comments or not isinstance(c, Comment):
                yield c

    def text(self, separator: str = "") -> str:
        parts = [s.strip() for s in self.strings()] if separator else list(self.strings())
        return separator.join(p for p in parts if p)

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def above(self, tag: str) -> Node | None:
        n = self.parent
        while n is not None and n.tag != tag:
            n = n.parent
        return n

    def html(self) -> str:
        attrs = "".join(f' {k}="{v}"' if v is not None else f" {k}" for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}/>"
        return f"<{self.tag}{attrs}>{self.inner_html()}</{self.tag}>"

    def inner_html(self) -> str:
        raw = self.tag in ("script", "style")
        out = []
        for c in self.children:
            if isinstance(c, Node):
                out.append(c.html())
            elif isinstance(c, Comment):
                out.append(f"<!--{c}-->")
            else:
                out.append(c if raw else c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")
        self.doctype: str | None = None

    def _close(self, tags: set[str] | frozenset[str], walls: set[str] | frozenset[str] = frozenset()) -> None:
        n = self.at
        while n.parent is not None and n.tag not in walls:
            if n.tag in tags:
                self.at = n.parent
                if tags & {"p"} or not tags & {self.at.tag}:
                    return
                n = self.at
                continue
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button"})
        if tag in _ENDS:
            self._close(_ENDS[tag], _WALLS[tag])
        node = Node(tag, {k: "" if v is None else v for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def handle_comment(self, data):
        self.at.children.append(Comment(data))

    def handle_decl(self, decl):
        if self.doctype is None:
            self.doctype = decl


def parse(html: str) -> tuple[Node, str | None]:
    """The tree and the document type declaration."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root, b.doctype
