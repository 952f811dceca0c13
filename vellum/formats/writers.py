"""The document model to text, Markdown and HTML."""

from __future__ import annotations

import re
from functools import lru_cache
from html import escape


def in_order(doc: dict) -> list[tuple[str, dict]]:
    """(kind, item) by the document's order; without one all paragraphs, then all tables, by index.

    Entries without an item are dropped, and of items with one index the last counts."""
    by = {"paragraph": {p["index"]: p for p in doc.get("paragraphs") or []}, "table": {t["index"]: t for t in doc.get("tables") or []}, "media": dict(enumerate(doc.get("media") or []))}
    order = doc.get("document_order")
    if not order:
        return [(k, by[k][i]) for k in ("paragraph", "table") for i in sorted(by[k])]
    return [(o["type"], by[o["type"]][o["index"]]) for o in order if o["index"] in by.get(o["type"], {})]


@lru_cache(1024)
def level_of(style: str | None) -> int | None:
    m = re.search(r"heading\s*([1-6])", style or "", re.I) or re.fullmatch("h([1-6])", (style or "").lower())
    return int(m[1]) if m else None


def cell_texts(table: dict) -> list[list[str]]:
    return [[c.get("text") or "" for c in r["cells"]] for r in table.get("rows") or []]


def write_text(doc: dict, title: str | None = None) -> str:
    lines = [title, ""] if title else []
    for kind, x in in_order(doc):
        if kind == "paragraph":
            text = (x.get("text") or "").strip()
            mark = "- " if x.get("is_bullet") else f"{(x.get('numbering_format') or '1.').rstrip()} " if x.get("is_numbered") else ""
            lines += [mark + text, ""]
        elif kind == "table":
            lines += [*(" | ".join(c.strip() for c in r) for r in cell_texts(x)), ""]
    return "\n".join(lines).rstrip() + "\n"


def _markdown_run(r: dict) -> str:
    text = r.get("text") or ""
    if r.get("code"):
        return f"`{text}`"
    stars = "*" * (2 * bool(r.get("bold")) + bool(r.get("italic")))
    text = stars + text + stars
    if r.get("underline"):
        text = f"<u>{text}</u>"
    return f"[{text}]({r['hyperlink_url']})" if r.get("hyperlink_url") else text


def _markdown_paragraph(p: dict) -> str:
    style = p.get("style") or ""
    if p.get("code_fence_language") is not None or style == "CodeBlock":
        return f"```{p.get('code_fence_language') or ''}\n{p.get('text') or ''}\n```"
    text = ("".join(map(_markdown_run, p["runs"])).replace("\n", "  \n") if p.get("runs") else p.get("text") or "").strip()
    if level := level_of(style):
        return "#" * level + " " + re.sub(r"^#+\s*", "", text)
    indent = "  " * int((p.get("list_info") or {}).get("indent_level") or 0)
    if p.get("is_bullet"):
        return f"{indent}- {text}"
    if p.get("is_numbered"):
        mark = p.get("numbering_format") or ""
        return f"{indent}{mark if re.fullmatch(r'[0-9]+[.)]', mark) else '1.'} {text}"
    return text


def _markdown_table(t: dict) -> str:
    rows = cell_texts(t)
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    line = lambda r: "| " + " | ".join(c.replace("\n", " ").strip() for c in r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def write_markdown(doc: dict, title: str | None = None) -> str:
    parts = [f"# {title}"] if title else []
    parts += [_markdown_paragraph(x) if kind == "paragraph" else _markdown_table(x) for kind, x in in_order(doc) if kind != "media"]
    return "\n\n".join(p for p in parts if p.strip()).rstrip() + "\n"


def _html_run(r: dict) -> str:
    text = escape(r.get("text") or "").replace("\n", "<br/>")
    for flag, tag in (("code", "code"), ("bold", "strong"), ("italic", "em"), ("semantic_insert", "ins"), ("semantic_delete", "del")):
        if r.get(flag):
            text = f"<{tag}>{text}</{tag}>"
    if r.get("underline") and not r.get("semantic_insert"):
        text = f"<u>{text}</u>"
    if r.get("vertical_align") in ("sub", "sup"):
        text = f"<{r['vertical_align']}>{text}</{r['vertical_align']}>"
    if r.get("highlight_color"):
        text = f"<mark>{text}</mark>"
    css = [f"{k}: {v}" for k, v in (("color", r.get("color_rgb")), ("font-family", r.get("font_name")), ("font-size", f"{r['font_size_pt']:g}pt" if r.get("font_size_pt") else None)) if v]
    return f'<span style="{escape("; ".join(css))}">{text}</span>' if css else text


def html_runs(runs: list[dict]) -> str:
    """Runs as HTML; neighbours with one link, or struck through alike, share the element around them."""
    out, i = [], 0
    key = lambda r: (r.get("hyperlink_url"), bool(r.get("strikethrough")) and not r.get("semantic_delete"))
    while i < len(runs):
        j = i
        while j < len(runs) and key(runs[j]) == key(runs[i]):
            j += 1
        link, struck = key(runs[i])
        text = "".join(map(_html_run, runs[i:j]))
        text = f"<s>{text}</s>" if struck else text
        out.append(f'<a href="{escape(link)}">{text}</a>' if link else text)
        i = j
    return "".join(out)


def html_table(t: dict) -> str:
    def cell(c: dict) -> str:
        tag = "th" if c.get("is_header") else "td"
        spans = "".join(f' {k}="{c[k]}"' for k in ("colspan", "rowspan") if (c.get(k) or 1) > 1)
        paragraphs = c.get("paragraphs") or []
        inner = "<br/>".join(html_runs(p["runs"]) if p.get("runs") else escape(p.get("text") or "") for p in paragraphs) if paragraphs else escape(c.get("text") or "")
        nested = "".join(f"<!-- nested table {i} -->" for i in c.get("nested_table_indices") or [])
        return f"<{tag}{spans}>{inner}{nested}</{tag}>"

    return "<table>" + "".join("<tr>" + "".join(map(cell, r["cells"])) + "</tr>" for r in t.get("rows") or []) + "</table>"


def _attributes(p: dict) -> str:
    """The source's attributes without event handlers, and the direction."""
    own = {k: v for k, v in ((p.get("source") or {}).get("attrs") or {}).items() if v is not None and not k.lower().startswith("on")}
    if p.get("direction") == "rtl":
        own["dir"] = "rtl"
    return "".join(f' {k}="{escape(str(v))}"' for k, v in own.items())


def _html_body(doc: dict, title: str | None) -> str:
    out, stack = [f"<h1>{escape(title)}</h1>"] if title else [], []

    def close(to: int) -> None:
        while len(stack) > to:
            out.append(f"</li></{stack.pop()}>")

    for kind, x in in_order(doc):
        if kind == "paragraph" and (x.get("is_bullet") or x.get("is_numbered")):
            level, tag = max(x.get("list_level") or 0, 0), "ul" if x.get("is_bullet") else "ol"
            close(level + 1)
            if len(stack) == level + 1 and stack[-1] != tag:
                close(level)
            if len(stack) == level + 1:
                out.append("</li>")
            while len(stack) < level + 1:
                start = (x.get("list_info") or {}).get("start") if tag == "ol" else None
                out.append(f'<{tag} start="{start}">' if start and start != 1 else f"<{tag}>")
                stack.append(tag)
                if len(stack) < level + 1:
                    out.append("<li>")
            out.append(f"<li>{html_runs(x['runs']) if x.get('runs') else escape(x.get('text') or '')}")
            continue
        close(0)
        if kind == "table":
            out.append(html_table(x))
        elif kind == "media":
            out.append(f'<img src="{escape(x.get("local_url") or x.get("file_name") or "")}" alt="{escape(x.get("alt_text") or "")}"/>')
        else:
            level, style = level_of(x.get("style")), x.get("style")
            tag = f"h{level}" if level else {"CodeBlock": "pre", "Caption": "figcaption"}.get(style or "", "p")
            inner = html_runs(x["runs"]) if x.get("runs") else escape(x.get("text") or "")
            out.append("<hr/>" if style == "HorizontalRule" else f"<{tag}{_attributes(x)}>{inner}</{tag}>")
    close(0)
    return "\n".join(out)


def write_html(doc: dict, title: str | None = None) -> str:
    """A whole page.  If the page's own body is known, it is kept and the texts that changed are put into it."""
    meta = doc.get("metadata") or {}
    head = meta.get("head_html") or f'<meta charset="utf-8"/><title>{escape(title or meta.get("title") or "Document")}</title>'
    body = _patched_body(doc, meta["body_html"]) if meta.get("body_html") else _html_body(doc, title)
    lang = f' lang="{escape(meta["lang"])}"' if meta.get("lang") else ""
    return f"<!{meta.get('doctype') or 'DOCTYPE html'}>\n<html{lang}>\n<head>{head}</head>\n<body>\n{body}\n</body>\n</html>\n"


def _patched_body(doc: dict, body: str) -> str:
    from vellum.formats.dom import Node, parse
    from vellum.formats.html_reader import normal

    tree, _ = parse(body)
    # One pass over the tree, then a lookup for each paragraph: its own mark-up, or else its text and tag.
    by_html, by_text = {}, {}
    for n in tree.walk():
        by_html.setdefault(n.html(), n)
        by_text.setdefault((n.tag, normal(n.text())), n)
    nodes, used = {}, set()
    for p in doc.get("paragraphs") or []:
        source = p.get("source") or {}
        n = by_html.get(source.get("raw_html")) or by_text.get((source.get("tag"), p.get("text")))
        if n is not None and id(n) not in used:
            used.add(id(n))
            nodes[p["index"]] = n
    last = None
    for kind, p in in_order(doc):
        if kind != "paragraph":
            continue
        n, inner = nodes.get(p["index"]), html_runs(p["runs"]) if p.get("runs") else escape(p.get("text") or "")
        if n is None:
            if not (p.get("source") or {}).get("raw_html") and p.get("text") and last is not None and last.parent is not None:
                made = Node(f"h{level_of(p.get('style'))}" if level_of(p.get("style")) else "p", {}, last.parent)
                made.children = parse(inner)[0].children
                last.parent.children.insert(last.parent.children.index(last) + 1, made)
                last = made
            continue
        last = n
        if normal(n.text()) != normal(p.get("text") or "") and "".join(x.strip() for x in n.strings()) != (p.get("text") or ""):
            blocks = [c for c in n.elements() if c.tag in ("ul", "ol", "table", "div")]
            n.children = parse(inner)[0].children + blocks
    tables = [n for n in tree.walk() if n.tag == "table"]
    for node, t in zip(tables, doc.get("tables") or []):
        rows = [tr for tr in node.walk() if tr.tag == "tr" and tr.above("table") is node]
        for tr, row in zip((r for r in rows if any(c.tag in ("td", "th") for c in r.elements())), t.get("rows") or []):
            for td, cell in zip((c for c in tr.elements() if c.tag in ("td", "th")), row["cells"]):
                if cell.get("text") and normal(td.text(" ")) != cell["text"]:
                    td.children = [cell["text"]]
    return tree.inner_html()
