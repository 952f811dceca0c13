"""HTML to the document model."""

from __future__ import annotations

import re

from vellum.formats.dom import Comment, Node, parse

#: Which elements hold blocks of their own, and what elements mean for the text inside them.
BLOCKS = frozenset({
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
})
CONTAINERS = frozenset({"div", "section", "article", "main", "header", "footer", "aside", "nav", "figure", "form"})
SILENT = frozenset("script style noscript".split())
MEANING = {
    **dict.fromkeys(("b", "strong"), {"bold": True}), **dict.fromkeys(("i", "em", "cite", "dfn", "var"), {"italic": True}),
    **dict.fromkeys(("s", "strike"), {"strikethrough": True}), **dict.fromkeys(("code", "kbd", "samp", "tt"), {"code": True}),
    "u": {"underline": True}, "ins": {"underline": True, "semantic_insert": True}, "del": {"strikethrough": True, "semantic_delete": True},
    "mark": {"highlight_color": "yellow"}, "sub": {"vertical_align": "sub"}, "sup": {"vertical_align": "sup"},
}
STYLED = {"figcaption": "Caption", "summary": "Summary", "dt": "DefinitionTerm", "dd": "DefinitionData", "legend": "Legend"}
ARABIC = re.compile("[؀-ۿݐ-ݿࢠ-ࣿ]")


def normal(text: str) -> str:
    """Lines with collapsed white space; empty lines go."""
    if "\n" not in text and "\r" not in text:
        return " ".join(text.split())
    lines = (" ".join(line.split()) for line in re.split(r"\r\n|\r|\n", text))
    return "\n".join(x for x in lines if x)


def css_color(raw: str) -> str | None:
    rgb = re.fullmatch(r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", raw, re.I)
    if raw.startswith("#") or re.fullmatch("[a-zA-Z]+", raw):
        return raw
    return "#{:02x}{:02x}{:02x}".format(*map(int, rgb.groups())) if rgb else None


def css_points(raw: str) -> float | None:
    m = re.match(r"([\d.]+)\s*(pt|px|em|rem)?", raw, re.I)
    try:
        return round(float(m[1]) * {"px": 0.75, "em": 12, "rem": 12}.get((m[2] or "pt").lower(), 1), 2) if m else None
    except ValueError:
        return None


def _css(node: Node) -> dict:
    """Formatting that the style attribute sets."""
    own, out = node.attrs.get("style", ""), {}
    if not own:
        return out
    found = {k: m[1].strip() for k in ("color", "font-family", "font-size") if (m := re.search(rf"\b{k}\s*:\s*([^;]+)", own, re.I))}
    if "color" in found:
        out["color_rgb"] = css_color(found["color"])
    if name := found.get("font-family", "").strip("'\"").split(",")[0].strip().strip("'\""):
        out["font_name"] = name
    if (size := css_points(found.get("font-size", ""))) is not None:
        out["font_size_pt"] = size
    return out


def _runs(node: Node, skip: frozenset[str] = frozenset()) -> list[dict]:
    """Runs of equally formatted text; each piece of text is normalised, and a space parts pieces that merge."""
    runs: list[dict] = []

    def push(text: str, style: dict) -> None:
        text = "\n" if text == "\n" else normal(text)
        if not text:
            return
        if runs and {k: v for k, v in runs[-1].items() if k != "text"} == style:
            last = runs[-1]["text"]
            runs[-1]["text"] = last + text if last.endswith("\n") or text.startswith("\n") else f"{last} {text}".strip()
        else:
            runs.append({**style, "text": text})

    def visit(n, style: dict) -> None:
        if not isinstance(n, Node):
            push(str(n), style)
        elif n.tag == "br":
            push("\n", style)
        elif n.tag not in SILENT | skip | {"table", "ul", "ol", "img"}:
            style = {**style, **MEANING.get(n.tag, {})}
            if n.tag == "a" and n.attrs.get("href", "").strip():
                style["hyperlink_url"] = n.attrs["href"].strip()
            style = {k: v for k, v in {**style, **_css(n)}.items() if v is not None}
            for c in n.children:
                visit(c, style)

    # The element itself may be one of those that are skipped inside others.
    style = {k: v for k, v in {**MEANING.get(node.tag, {}), **_css(node)}.items() if v is not None}
    for c in [] if node.tag in SILENT else node.children:
        visit(c, style)
    return [{**r, "index": i} for i, r in enumerate(runs)]


def _number(raw, default: int) -> int:
    try:
        return int(raw or default)
    except ValueError:
        return default


class Reader:
    """Walks the body and collects paragraphs, tables and media in order."""

    def __init__(self, include_media: bool, raw: bool = True):
        self.include_media, self.raw = include_media, raw
        self.paragraphs, self.tables, self.media, self.order = [], [], [], []

    def _add(self, kind: str, items: list, item: dict) -> None:
        self.order.append({"type": kind, "index": len(items)})
        items.append({"index": len(items), **item})

    def paragraph(self, text: str, runs: list[dict], source: Node | None = None, **more) -> None:
        given = {"is_bullet": False, "is_numbered": False, "text": text, "runs": runs, **more}
        if source is not None and self.raw:
            given["source"] = {"format": "html", "tag": source.tag, "attrs": dict(source.attrs), "raw_html": source.html()}
        self._add("paragraph", self.paragraphs, given)

    def plain(self, text: str, source: Node | None = None, **more) -> None:
        if text:
            self.paragraph(text, [{"index": 0, "text": text}], source, **more)

    def element(self, node: Node, **more) -> None:
        runs = _runs(node)
        text = "".join(r["text"] for r in runs).strip()
        if text:
            self.paragraph(text, runs, node, **{"direction": _direction(node, text), **more})

    def image(self, node: Node) -> None:
        src = node.attrs.get("src", "").strip()
        if src and self.include_media:
            size = {k: int(v) if (v := node.attrs.get(n, "")).isdigit() else None for n, k in (("width", "width_emu"), ("height", "height_emu"))}
            self._add("media", self.media, {"relationship_id": f"html_img_{len(self.media)}", "file_name": src.split("/")[-1], "local_file_path": src, "local_url": src, "alt_text": node.attrs.get("alt", "").strip() or None, **size})

    def table(self, node: Node) -> None:
        caption = next((c for c in node.elements() if c.tag == "caption"), None)
        if caption is not None and (text := normal(caption.text(" "))):
            self.paragraph(text, _runs(caption) or [{"index": 0, "text": text}], caption, style="TableCaption")
        rows, inner = [], []
        for r, tr in enumerate(n for n in node.walk() if n.tag == "tr" and n.above("table") is node):
            cells = []
            for cell in (n for n in tr.walk() if n.tag in ("td", "th") and n.above("table") is node):
                text = normal(cell.text(" "))
                made = {
                    "cell_index": len(cells), "text": text, "is_header": cell.tag == "th", "colspan": _number(cell.attrs.get("colspan"), 1), "rowspan": _number(cell.attrs.get("rowspan"), 1),
                    "nested_table_indices": [], "paragraphs": [{"index": 0, "text": text, "runs": _runs(cell) or [{"index": 0, "text": text}]}],
                }
                inner += [(made, n) for n in cell.walk() if n.tag == "table" and n.above("table") is node]
                cells.append(made)
            if cells:
                rows.append({"row_index": r, "cells": cells})
        if rows:
            self._add("table", self.tables, {"row_count": len(rows), "column_count": max(len(r["cells"]) for r in rows), "rows": rows})
            for cell, nested in inner:
                at = len(self.tables)
                self.table(nested)
                if len(self.tables) > at:
                    cell["nested_table_indices"].append(at)

    def list(self, node: Node, level: int = 0) -> None:
        bullet = node.tag == "ul"
        start = 1 if bullet else _number(node.attrs.get("start"), 1)
        for n, li in enumerate(c for c in node.elements() if c.tag == "li"):
            form = "bullet" if bullet else f"{start + n}."
            info = {"kind": "bullet" if bullet else "numbered", "numbering_format": form, "level": level, "start": None if bullet else start}
            self.element(li, is_bullet=bullet, is_numbered=not bullet, numbering_format=form, list_level=level, list_info=info)
            for c in li.elements():
                if c.tag in ("ul", "ol"):
                    self.list(c, level + 1)
                elif c.tag in ("table", "img", "figcaption") or c.tag in CONTAINERS - {"form"}:
                    self.block(c)

    def fieldset(self, node: Node) -> None:
        for c in node.elements():
            if c.tag == "input":
                self.plain(normal(c.attrs.get("placeholder") or c.attrs.get("value") or c.attrs.get("type") or ""), c)
            elif c.tag == "select":
                self.container(c)
            elif c.tag in ("ul", "ol", "table", "fieldset", "legend"):
                self.block(c)
            else:
                self.element(c)

    def container(self, node: Node) -> None:
        if any(c.tag in BLOCKS for c in node.elements()):
            self.walk(node)
        else:
            self.element(node)

    def block(self, node: Node) -> bool:
        """Read one element; false if its tag has no rule."""
        tag = node.tag
        if tag in SILENT or tag in ("meta", "link", "br"):
            return True
        if tag == "hr":
            self.plain("---", style="HorizontalRule", alignment="CENTER")
        elif tag == "img":
            self.image(node)
        elif tag == "table":
            self.table(node)
        elif tag in ("ul", "ol"):
            self.list(node)
        elif re.fullmatch("h[1-6]", tag):
            self.element(node, style=f"Heading {tag[1]}")
        elif tag in STYLED:
            self.element(node, style=STYLED[tag])
        elif tag == "p" and any(c.tag in ("ul", "ol", "table", "img") for c in node.elements()):
            runs = _runs(node, BLOCKS)
            text = "".join(r["text"] for r in runs).strip()
            if text:
                self.paragraph(text, runs)
            for c in node.elements():
                if c.tag in ("ul", "ol", "table", "img"):
                    self.block(c)
        elif tag in ("p", "blockquote", "pre"):
            self.element(node)
        elif tag == "details":
            self.walk(node)
        elif tag in CONTAINERS:
            self.container(node)
        elif tag == "fieldset":
            self.fieldset(node)
        elif tag == "dl":
            for c in node.elements():
                if c.tag in ("dt", "dd", "ul", "ol", "table"):
                    self.block(c)
        else:
            return False
        return True

    def walk(self, node: Node) -> None:
        for c in node.children:
            if not isinstance(c, Node):
                self.plain(normal(str(c)))
            elif not self.block(c) and normal(c.text(" ")):
                self.element(c)


def _direction(node: Node, text: str) -> str | None:
    css = re.search(r"\bdirection\s*:\s*(\w+)", node.attrs.get("style", ""), re.I)
    rtl = node.attrs.get("dir", "").lower() == "rtl" or (css and css[1].lower() == "rtl") or ARABIC.search(text)
    return "rtl" if rtl else None


def read_html(html: str, include_media: bool = True, raw: bool = True) -> dict:
    """Paragraphs, tables, media and their order, and the metadata of the page.

    Without `raw` no mark-up is kept: paragraphs have no source, and the metadata neither body nor head."""
    tree, doctype = parse(html)
    root = tree.find("html") or tree
    body, head = root.find("body") or root, root.find("head")
    reader = Reader(include_media, raw)
    reader.walk(body)
    title = head.find("title") if head else None
    assets = {k: [n for n in (head.elements() if head else []) if n.tag == k] for k in ("meta", "link", "style", "script")}
    meta = {
        "source_type": "html", "title": title.text().strip() if title else None, "doctype": doctype, "body_html": body.inner_html() if raw else None, "head_html": head.inner_html() if head and raw else None,
        **{f"{k}_count": str(len(v)) for k, v in assets.items()}, "lang": root.attrs.get("lang"),
    }
    return {"source_type": "html", "metadata": {k: v for k, v in meta.items() if v is not None}, "document_order": reader.order, "paragraphs": reader.paragraphs, "tables": reader.tables, "media": reader.media}


__all__ = ["Comment", "read_html"]
