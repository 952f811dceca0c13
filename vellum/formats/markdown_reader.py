"""Markdown to the document model.  The `chunking` profile strips inline marks from texts and drops blank paragraphs."""

from __future__ import annotations

import re

#: Line forms, and the inline forms in the order in which they are tried.
HEADING = re.compile(r"\s{0,3}(#{1,6})\s+")
TITLE = re.compile(HEADING.pattern + "(.*)")
BULLET, NUMBER = re.compile(r"(\s*)[-*+]\s+"), re.compile(r"(\s*)(\d+[.)])\s+")
FENCE = re.compile(r"(`{3,}|~{3,})(\S*)")
IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)\)")
INLINE = re.compile(
    r"\*\*\*(?P<both>[^*]+?)\*\*\*|\*\*(?P<bold>[^*]+?)\*\*|__(?P<bold_>[^_]+?)__|(?P<escaped>\\.)|[*_](?P<italic>[^*_]+?)[*_]"
    r"|`(?P<code>[^`]+?)`|\[(?P<label>[^\]]+)\]\((?P<url>[^)]+)\)|(?P<plain>[^*_`\\]+)|(?P<other>.)"
)
MARKS = re.compile(r"[*_`\\\[]")
SEPARATOR = re.compile(":?-{3,}:?")
HIDDEN = re.compile(
    r"\*{3}(.+?)\*{3}|\*{2}(.+?)\*{2}|_{2}(.+?)_{2}|\*(.+?)\*|_(.+?)_|~~(.+?)~~|`(.+?)`|!\[([^\]]*)\]\([^)]*\)|\[([^\]]+)\]\([^)]*\)|\\(.)", re.S
)


def visible(text: str) -> str:
    """Without inline marks; a second pass takes those that the first laid open."""
    show = lambda m: next((g for g in m.groups() if g is not None), m[0])
    once = HIDDEN.sub(show, text)
    return once if once == text else HIDDEN.sub(show, once)


FORMS = {"both": {"bold": True, "italic": True}, "bold": {"bold": True}, "bold_": {"bold": True}, "italic": {"italic": True}, "code": {"code": True}}


def inline_runs(text: str) -> list[dict]:
    if not MARKS.search(text):
        return [{"index": 0, "text": text}]
    runs = []
    for m in INLINE.finditer(text):
        kind, own = m.lastgroup, m[m.lastgroup]
        form = {"hyperlink_url": own} if kind == "url" else FORMS.get(kind, {})
        own = m["label"] if kind == "url" else own
        if own:
            runs.append({"index": len(runs), "text": own, **form})
    return runs or [{"index": 0, "text": text}]


def is_row(line: str) -> bool:
    return "|" in line and sum(bool(p.strip()) for p in line.strip().split("|")) >= 2


def is_separator(line: str) -> bool:
    own = line.strip().strip("|")
    return bool(own) and all(SEPARATOR.fullmatch(p) for p in map(str.strip, own.split("|")) if p)


def starts_table(lines: list[str], i: int) -> bool:
    return i + 1 < len(lines) and is_row(lines[i]) and is_separator(lines[i + 1])


def _table(lines: list[str]) -> dict:
    rows = [[c.strip() for c in x.strip().strip("|").split("|")] for i, x in enumerate(lines) if not (i == 1 and is_separator(x))]
    cells = lambda r: [{"cell_index": i, "text": t, "paragraphs": [{"index": 0, "text": t, "runs": [{"index": 0, "text": t}]}]} for i, t in enumerate(r)]
    return {"row_count": len(rows), "column_count": max(map(len, rows)), "rows": [{"row_index": i, "cells": cells(r)} for i, r in enumerate(rows)]}


def _paragraph(block: list[str]) -> dict:
    raw, first = "\n".join(block).strip(), block[0]
    out = {"is_bullet": False, "is_numbered": False}
    if m := TITLE.fullmatch(raw):
        out |= {"style": f"Heading {len(m[1])}"}
        raw = m[2].strip()
    elif m := BULLET.match(first) or NUMBER.match(first):
        bullet = m.re is BULLET
        form = "bullet" if bullet else m[2]
        raw = m.re.sub("", raw, count=1).strip()
        out |= {"is_bullet": bullet, "is_numbered": not bullet, "numbering_format": form, "list_info": {"kind": "bullet" if bullet else "numbered", "numbering_format": form, "indent_level": len(m[1]) // 2}}
    return {**out, "text": raw, "runs": inline_runs(raw)}


def read_markdown(text: str, include_media: bool = True, profile: str = "chunks") -> dict:
    lines, i = text.splitlines(), 0
    paragraphs, tables, media, order = [], [], [], []
    while i < len(lines):
        start = i
        if not lines[i].strip():
            i += 1
            continue
        if starts_table(lines, i):
            while i < len(lines) and is_row(lines[i]) or i == start + 1:
                i += 1
            order.append({"type": "table", "index": len(tables)})
            tables.append({"index": len(tables), **_table(lines[start:i])})
            continue
        if m := FENCE.match(lines[i].strip()):
            i += 1
            while i < len(lines) and lines[i].strip() != m[1]:
                i += 1
            body, i = "\n".join(lines[start + 1 : i]), i + 1
            block = lines[start:i]
            made = {"text": body, "style": "CodeBlock", "code_fence_language": m[2], "is_bullet": False, "is_numbered": False, "runs": [{"index": 0, "text": body, "code": True}] if body.strip() else []}
        else:
            i += 1
            while i < len(lines) and lines[i].strip() and not (HEADING.match(lines[i]) or BULLET.match(lines[i]) or NUMBER.match(lines[i]) or starts_table(lines, i)):
                i += 1
            block = lines[start:i]
            made = _paragraph(block)
        at = len(paragraphs)
        if include_media:
            for n, m in enumerate(IMAGE.finditer(whole) if "![" in (whole := "\n".join(block)) else ()):
                media.append({"relationship_id": f"md_p_{at}_img_{n}", "file_name": m[2].rsplit("/", 1)[-1], "local_file_path": m[2], "local_url": m[2], "alt_text": m[1] or None})
        if profile == "chunking":
            if made.get("style") != "CodeBlock":
                made["text"] = visible(made["text"])
            if not made["text"].strip():
                continue
        order.append({"type": "paragraph", "index": at})
        paragraphs.append({"index": at, "source": {"format": "markdown"}, **made})
    return {"source_type": "markdown", "metadata": {"source_type": "markdown"}, "document_order": order, "paragraphs": paragraphs, "tables": tables, "media": media}
