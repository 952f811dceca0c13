"""DOCX and PPTX packages to and from the document model, on zipfile and ElementTree."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

#: Name spaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "webp": "image/webp", "emf": "image/x-emf", "wmf": "image/x-wmf"}


def resolve(base: str, target: str) -> str:
    """The part that a relationship of part `base` names."""
    if target.startswith("/"):
        return target[1:]
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), target))


#: Parts up to this size are remembered.
_SMALL = 4096


def _remembered(f: Callable) -> Callable:
    """f with its results for the last small inputs (the last argument): many packages share parts.  Results stay unchanged."""
    known = lru_cache(128)(f)
    return lambda *a: known(*a) if len(a[-1]) <= _SMALL else f(*a)


_END, _ENTRY, _LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")


def _directory(data: bytes) -> dict[str, tuple[int, ...]] | None:
    """Name to (method, CRC, packed size, size, place, end) of a plain archive; None for one that zipfile had better read."""
    at = len(data) - _END.size
    if at < 0:
        return None
    sign, disk, first, here, count, size, start, comment = _END.unpack_from(data, at)
    if sign != b"PK\5\6" or disk or first or here != count or comment or start + size != at:
        return None
    out, end, later = {}, start, []
    for _ in range(count):
        body = start + _ENTRY.size
        if body > at:
            return None
        sign, _, version, flags, method, _, _, crc, packed, whole, length, extra, note, disk, _, _, place = _ENTRY.unpack_from(data, start)
        name = data[body : body + length]
        # Encrypted or patched parts, further fields (64-bit sizes among them) and other methods or names are zipfile's.
        if sign != b"PK\1\2" or version > 20 or flags & ~0x80E or method not in (0, 8) or extra or disk or not name.isascii() or b"\0" in name:
            return None
        later.append(place)
        out[name.decode("ascii")] = (method, crc, packed, whole, place)
        start = body + length + note
    later.append(end)
    if start != at or len(out) != count or later != sorted(set(later)):
        return None
    return {n: (*x, y) for (n, x), y in zip(out.items(), later[1:], strict=True)}


class _Package:
    """The parts of a package.  Plain archives are read by their directory, many times faster for small parts than by
    zipfile, which reads all others, and every part in which something is not as it should be."""

    def __init__(self, data: bytes):
        self._data, self._zip, self._plain = data, None, _directory(data)
        self.names = self._plain if self._plain is not None else dict.fromkeys(self._other().namelist())

    def _other(self) -> zipfile.ZipFile:
        if self._zip is None:
            try:
                self._zip = zipfile.ZipFile(io.BytesIO(self._data))
            except zipfile.BadZipFile as e:
                raise ValueError("not a package") from e
        return self._zip

    def listed(self) -> list[str]:
        """All names, in order; of parts with one name the last counts."""
        return list(self.names) if self._plain is not None else self._other().namelist()

    def small(self, paths: list[str], most: int = 1 << 16) -> bool:
        """Whether these parts are known to have so many bytes at most together."""
        return self._plain is not None and sum([self._plain[p][3] for p in paths]) <= most

    def read(self, path: str) -> bytes:
        if self._plain is not None:
            method, crc, packed, whole, place, end = self._plain[path]
            if place + _LOCAL.size <= end:
                sign, _, flags, _, _, _, _, _, _, length, extra = _LOCAL.unpack_from(self._data, place)
                name, start = place + _LOCAL.size, place + _LOCAL.size + length + extra
                if sign == b"PK\3\4" and not flags & ~0x80E and start + packed <= end and self._data[name : name + length] == path.encode("ascii"):
                    body = self._data[start : start + packed]
                    try:
                        body = zlib.decompressobj(-15).decompress(body, whole + 1) if method else body
                        if len(body) == whole and zlib.crc32(body) == crc:
                            return body
                    except zlib.error:
                        pass
        return self._other().read(path)


def _xml(z: _Package, path: str):
    return ET.fromstring(z.read(path)) if path in z.names else None


@_remembered
def _relations(part: str, raw: bytes) -> dict[str, tuple[str, str]]:
    return {r.get("Id"): (resolve(part, r.get("Target", "")) if r.get("TargetMode") != "External" else r.get("Target", ""), r.get("Type", "")) for r in ET.fromstring(raw).iter(REL + "Relationship")}


def _rels(z: _Package, part: str) -> dict[str, tuple[str, str]]:
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
    return _relations(part, z.read(path)) if path in z.names else {}


def _val(e, path: str, attr: str = W + "val"):
    found = e.find(path) if e is not None else None
    return None if found is None else found.get(attr, "")


def _deep(e, outer: str, inner: str, attr: str = W + "val"):
    """_val of an element within an outer one.  The library walks such paths in Python, so only if there is an outer one."""
    return None if e is None or e.find(outer) is None else _val(e, f"{outer}/{inner}", attr)


def _whole(raw: str | None, default: int = 0) -> int:
    """A whole number as attributes write it; anything else is the default."""
    return int(raw) if re.fullmatch(r"\s*-?[0-9]{1,9}\s*", raw or "") else default


def _xml_or_none(z: _Package, path: str):
    """Like _xml, and None for a part that is no XML: one damaged part does not lose the others."""
    try:
        return _xml(z, path)
    except ET.ParseError:
        return None


def _flag(e, path: str) -> bool | None:
    v = _val(e, path)
    return None if v is None else v not in ("0", "false", "none")


def _half(v) -> float | None:
    return int(v) / 2 if v and v.isdigit() else None


def _color(v) -> str | None:
    return None if not v or v == "auto" else v.upper()


def _numbering(z: _Package) -> dict[tuple[str, str], str]:
    """(num id, level) to `format:text`: the first match of each step counts."""
    root = _xml(z, "word/numbering.xml")
    if root is None:
        return {}
    levels: dict = {}
    for a in root.iter(W + "abstractNum"):
        for lvl in a.iter(W + "lvl"):
            levels.setdefault((a.get(W + "abstractNumId"), lvl.get(W + "ilvl")), f"{_val(lvl, W + 'numFmt') or ''}:{_val(lvl, W + 'lvlText') or ''}")
    nums: dict = {}
    for n in root.iter(W + "num"):
        nums.setdefault(n.get(W + "numId"), _val(n, W + "abstractNumId"))
    return {(num, level): form for num, a in nums.items() for (b, level), form in levels.items() if a == b}


_P, _R, _T, _RPR, _LINK = W + "p", W + "r", W + "t", W + "rPr", W + "hyperlink"
_WPPR, _STYLE, _NUM, _JC = W + "pPr", W + "pStyle", W + "numPr", W + "jc"
_BREAKS = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n"}


def _docx_text(r) -> str:
    return "".join([e.text or "" if e.tag == _T else _BREAKS.get(e.tag, "") for e in r])


def _docx_look(rpr) -> dict:
    font = rpr.find(W + "rFonts") if rpr is not None else None
    return {"bold": _flag(rpr, W + "b"), "italic": _flag(rpr, W + "i"), "underline": _flag(rpr, W + "u"), "strikethrough": _flag(rpr, W + "strike"), "font_name": font.get(W + "ascii") if font is not None else None, "font_size_pt": _half(_val(rpr, W + "sz")), "color_rgb": _color(_val(rpr, W + "color")), "highlight_color": _val(rpr, W + "highlight")}


#: Most runs have no properties.
_NO_LOOK = _docx_look(None)


@_remembered
def _styles(raw: bytes) -> tuple[dict[str, str], list[dict], dict | None]:
    """Names by id, styles and defaults of a part."""
    names, styles, defaults, root = {}, [], None, ET.fromstring(raw)
    for s in root.iter(W + "style"):
        names[s.get(W + "styleId")] = name = _val(s, W + "name")
        rpr = s.find(_RPR)
        font = rpr.find(W + "rFonts") if rpr is not None else None
        styles.append({"style_id": s.get(W + "styleId"), "name": name, "type": s.get(W + "type"), "font_name": font.get(W + "ascii") if font is not None else None, "font_size_pt": _half(_val(rpr, W + "sz")), "bold": _flag(rpr, W + "b"), "italic": _flag(rpr, W + "i"), "underline": _flag(rpr, W + "u"), "color_rgb": _color(_val(rpr, W + "color"))})
    base = root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr")
    if base is not None:
        fonts = base.find(W + "rFonts")
        name = next((fonts.get(W + k) for k in ("ascii", "hAnsi", "cs") if fonts is not None and fonts.get(W + k)), None)
        defaults = {"font_name": name, "font_size_pt": _half(_val(base, W + "sz")), "color_rgb": _color(_val(base, W + "color"))}
    return names, styles, defaults


def read_docx(data: bytes, include_media: bool = True, profile: str = "chunks") -> dict:
    """The body in order.  The `chunking` profile reads texts alone and drops blank paragraphs."""
    z = _Package(data)
    root = _xml(z, "word/document.xml")
    if root is None:
        raise ValueError("the package has no document")
    lean = profile == "chunking"
    names, styles, defaults = _styles(z.read("word/styles.xml")) if "word/styles.xml" in z.names else ({}, [], None)
    numbering, rels = _numbering(z), _rels(z, "word/document.xml")

    def paragraph(p, index: int) -> dict:
        ppr = p.find(_WPPR)
        style_id = _val(ppr, _STYLE)
        style = names.get(style_id, style_id) if style_id else (None if lean else "Normal")
        listed = ppr is not None and ppr.find(_NUM) is not None
        num, level = (_deep(ppr, _NUM, W + "numId"), _deep(ppr, _NUM, W + "ilvl")) if listed else (None, None)
        info = {"num_id": int(num), "level": _whole(level)} if num and num.isdigit() else None
        form = numbering.get((num, level or "0")) if info else None
        low = (style or "").lower()
        bullet = "bullet" in low or bool(form and form.startswith("bullet"))
        numbered = "number" in low or bool(form and not form.startswith("bullet"))
        runs = []
        links = {id(r): rels.get(h.get(R + "id"), (None,))[0] for h in p.iter(_LINK) for r in h.iter(_R)}
        for r in p.iter(_R):
            rpr = r.find(_RPR)
            runs.append({"index": len(runs), "text": _docx_text(r), **(_NO_LOOK if rpr is None else _docx_look(rpr)), "hyperlink_url": links.get(id(r))})
        text = "".join([t.text or "" for t in p.iter(_T)]) if lean else "".join([r["text"] for r in runs])
        return {"index": index, "text": text, "style": style, "is_bullet": bullet or info is not None, "is_numbered": numbered, "list_info": info, "numbering_format": form, "list_level": info["level"] if info else None, "alignment": (_val(ppr, _JC) or "").upper() or None, "runs": [] if lean else runs, "source": {"format": "docx"}}

    def table(t, index: int) -> dict:
        rows = []
        for r, tr in enumerate(t.findall(W + "tr")):
            cells = []
            for tc in tr.findall(W + "tc"):
                inner = [paragraph(p, i) for i, p in enumerate(tc.findall(_P))]
                texts = [p["text"].strip() if lean else p["text"] for p in inner if p["text"].strip()]
                span = _deep(tc, W + "tcPr", W + "gridSpan")
                made = {"text": "\n".join(texts), "cell_index": len(cells), "colspan": int(span) if span and span.isdigit() else None, "paragraphs": [] if lean else [{k: p[k] for k in ("index", "text", "style", "runs")} for p in inner]}
                # A merged cell stands once for each column that it covers, except in the lean form.
                cells += [made] * (1 if lean else made["colspan"] or 1)
            rows.append({"row_index": r, "cells": [{**c, "cell_index": i} for i, c in enumerate(cells)]})
        return {"index": index, "row_count": len(rows), "column_count": max((len(r["cells"]) for r in rows), default=0), "style": names.get(_deep(t, W + "tblPr", W + "tblStyle")), "rows": rows}

    paragraphs, tables, order, media = [], [], [], []
    for e in root.find(W + "body"):
        if e.tag == _P:
            made = paragraph(e, len(paragraphs))
            if not lean or made["text"].strip():
                order.append({"type": "paragraph", "index": len(paragraphs)})
                paragraphs.append(made)
        elif e.tag == W + "tbl":
            order.append({"type": "table", "index": len(tables)})
            tables.append(table(e, len(tables)))
    if include_media and not lean:
        for rid, (target, kind) in rels.items():
            if kind.endswith("/image") and target in z.names:
                ext = target.rpartition(".")[2].lower()
                media.append({"relationship_id": rid, "content_type": _TYPES.get(ext), "file_name": f"{rid}.{ext}", "local_file_path": target, "content": z.read(target)})
    return {"source_type": "docx", "metadata": {"source_type": "docx"}, "document_order": order, "document_defaults": defaults and {**defaults}, "styles": [] if lean else [{**x} for x in styles], "paragraphs": paragraphs, "tables": tables, "media": media}


_AP, _AR, _AFLD, _ABR, _AT = A + "p", A + "r", A + "fld", A + "br", A + "t"


def _slide_look(rpr) -> dict:
    get = (lambda k: None) if rpr is None else rpr.get
    rgb, scheme = _deep(rpr, A + "solidFill", A + "srgbClr", "val"), _deep(rpr, A + "solidFill", A + "schemeClr", "val")
    truth = lambda v: None if v is None else v in ("1", "true")
    font = rpr.find(A + "latin") if rpr is not None else None
    return {"bold": truth(get("b")), "italic": truth(get("i")), "underline": None if get("u") is None else get("u") != "none", "font_size_pt": int(get("sz")) / 100 if (get("sz") or "").isdigit() else None, "font_name": font.get("typeface") if font is not None else None, "color_rgb": rgb.upper() if rgb else f"scheme:{scheme}" if scheme else None}


#: Most runs have no properties.
_NO_SLIDE_LOOK = _slide_look(None)


def _slide_runs(p) -> list[dict]:
    runs = []
    for e in p:
        if e.tag in (_AR, _AFLD, _ABR):
            rpr = e.find(_PRPR)
            runs.append({"index": len(runs), "text": "\n" if e.tag == _ABR else "".join([t.text or "" for t in e.iter(_AT)]), **(_NO_SLIDE_LOOK if rpr is None else _slide_look(rpr))})
    return runs


def _joined(runs: list[dict]) -> str:
    return "".join([r["text"] for r in runs])


_SP, _FRAME, _PH, _TEXT, _TREE = P + "sp", P + "graphicFrame", P + "ph", P + "txBody", P + "spTree"
_SHAPES = (_SP, P + "pic", _FRAME, P + "grpSp")
_PPR, _PRPR, _SLIDE = A + "pPr", A + "rPr", P + "cSld"


_DECLARED = re.compile(rb'<\?xml version="1\.0" encoding="UTF-8" standalone="yes"\?>\s*(?=<)')


def _slides(z: _Package, paths: list[str]) -> Iterator[tuple[str, ET.Element | None]]:
    """The parts with their roots, None for one that is no XML.

    Small ones are parsed at one go, as a parser takes longer to set up than to read a slide: each in an element of its
    own, so that none reaches into another, and one by one if anything in them could tell the difference."""
    if z.small(paths):
        bodies = [z.read(p) for p in paths]
        heads = [_DECLARED.match(x) for x in bodies]
        if all(heads) and not any([b"<!" in x or b"<?" in x[2:] for x in bodies]):
            try:
                roots = list(ET.fromstring(b"<x>%b</x>" % b"".join([b"<x%d>%b</x%d>" % (i, x[m.end() :].rstrip(b" \t\r\n"), i) for i, (x, m) in enumerate(zip(bodies, heads, strict=True))])))
            except ET.ParseError:
                roots = []
            if [x.tag for x in roots] == [f"x{i}" for i in range(len(paths))] and all([len(x) == 1 and not x.text and not x[0].tail for x in roots]):
                yield from zip(paths, [x[0] for x in roots], strict=True)
                return
    for p in paths:
        yield p, _xml_or_none(z, p)


@_remembered
def _slide_ids(raw: bytes) -> list[str | None]:
    return [x.get(R + "id") for x in ET.fromstring(raw).iter(P + "sldId")]


def read_pptx(data: bytes, include_media: bool = True, raw: bool = True) -> dict:
    """Slides in the presentation's order with their paragraphs, tables, pictures and notes, and all parts if `raw`."""
    z = _Package(data)
    ids, rels = _slide_ids(z.read("ppt/presentation.xml")) if "ppt/presentation.xml" in z.names else None, _rels(z, "ppt/presentation.xml")
    if ids is None:
        raise ValueError("the package has no presentation")
    paragraphs, tables, media, order, slides = [], [], [], [], []
    for path, slide_xml in _slides(z, [p for x in ids if (p := rels.get(x, ("",))[0]) in z.names]):
        if slide_xml is None:
            # The slide keeps its place, without what it holds.
            slides.append({"index": len(slides), "slide_number": len(slides) + 1, "text": "", "shape_count": 0, "paragraph_indices": [], "table_indices": [], "media_indices": []})
            continue
        own, at = _rels(z, path), {"paragraph": [], "table": [], "media": []}
        title, texts, shapes = None, [], 0

        def put(kind: str, items: list, item: dict, at=at) -> None:
            at[kind].append(len(items))
            order.append({"type": kind, "index": len(items)})
            items.append(item if kind == "media" else {"index": len(items), **item})

        for shape in next((t for c in slide_xml.findall(_SLIDE) for t in c.findall(_TREE)), ()):
            shapes += shape.tag in _SHAPES
            if shape.tag == _SP:
                holder = next(shape.iter(_PH), None)
                is_title = holder is not None and holder.get("type") in ("title", "ctrTitle")
                body = shape.find(_TEXT)
                lines = []
                for p in body.findall(_AP) if body is not None else ():
                    runs = _slide_runs(p)
                    text = _joined(runs)
                    if text.strip():
                        ppr = p.find(_PPR)
                        level = _whole(ppr.get("lvl")) if ppr is not None else 0
                        lines.append(text)
                        put("paragraph", paragraphs, {"text": text, "style": "Heading 1" if is_title else None, "is_bullet": level > 0, "is_numbered": False, "list_level": level, "alignment": ppr.get("algn", "") if ppr is not None else None, "runs": runs, "source": {"format": "pptx"}})
                texts += lines
                if is_title and title is None and lines:
                    title = "\n".join(lines)
            elif shape.tag == _FRAME and (t := next(shape.iter(A + "tbl"), None)) is not None:
                rows = []
                for r, tr in enumerate(t.findall(A + "tr")):
                    cells = []
                    for tc in tr.findall(A + "tc"):
                        inner = [{"index": i, "text": _joined(runs), "runs": runs} for i, runs in enumerate([_slide_runs(p) for body in tc.findall(A + "txBody") for p in body.findall(_AP)])]
                        cells.append({"cell_index": len(cells), "text": "\n".join([x["text"] for x in inner if x["text"]]), "colspan": _whole(tc.get("gridSpan"), 1), "rowspan": _whole(tc.get("rowSpan"), 1), "paragraphs": inner})
                    rows.append({"row_index": r, "cells": cells})
                put("table", tables, {"row_count": len(rows), "column_count": max((len(r["cells"]) for r in rows), default=0), "rows": rows})
            elif shape.tag == P + "pic" and include_media:
                blip, ext = next(shape.iter(A + "blip"), None), shape.find(f"{P}spPr/{A}xfrm/{A}ext")
                target = own.get(blip.get(R + "embed"), ("",))[0] if blip is not None else ""
                if target in z.names:
                    size = {"width_emu": _whole(ext.get("cx")), "height_emu": _whole(ext.get("cy"))} if ext is not None else {}
                    put("media", media, {"relationship_id": blip.get(R + "embed"), "content_type": _TYPES.get(target.rpartition(".")[2].lower()), "file_name": posixpath.basename(target), "local_file_path": target, "content": z.read(target), **size})
        notes_path = next((t for t, kind in own.values() if kind.endswith("/notesSlide")), "")
        notes = _xml_or_none(z, notes_path) if notes_path else None
        notes_text = None
        if notes is not None:
            bodies = [s for s in notes.iter(P + "sp") if any(h.get("type") in (None, "body") for h in s.iter(P + "ph"))]
            notes_text = "\n".join(x for s in bodies for p in s.iter(_AP) if (x := _joined(_slide_runs(p))).strip()) or None
        slides.append({"index": len(slides), "slide_number": len(slides) + 1, "title": title, "text": "\n".join(texts), "notes_text": notes_text, "shape_count": shapes, **{f"{k}_indices": v for k, v in at.items()}})
    parts = [{"path": n, "xml": z.read(n).decode("utf-8", "replace")} if n.endswith((".xml", ".rels")) else {"path": n, "content": z.read(n)} for n in (z.listed() if raw else ()) if not n.endswith("/")]
    return {"source_type": "pptx", "metadata": {"source_type": "pptx"}, "document_order": order, "paragraphs": paragraphs, "tables": tables, "media": media, "slides": slides, "parts": parts}


# -- writing ------------------------------------------------------------------------------------------------------

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


_CONTROLS, _UNSAFE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]"), re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f&<>]")


def _clean(text: str) -> str:
    return escape(_CONTROLS.sub("", text)) if _UNSAFE.search(text) else text


@_remembered
def _member(name: bytes, body: bytes) -> tuple[bytes, bytes]:
    """A part as it stands in an archive, and its entry in the directory up to its place."""
    # A window of 32 KB takes longer to set up than to fill with a small part.
    c = zlib.compressobj(-1, zlib.DEFLATED, -12, 5) if len(body) <= _SMALL else zlib.compressobj(-1, zlib.DEFLATED, -15)
    packed = c.compress(body) + c.flush()
    # 33 is the first day that such a file can tell; the files are readable and writable by their owner.
    fixed = (0, 8, 0, 33, zlib.crc32(body), len(packed), len(body), len(name), 0)
    return _LOCAL.pack(b"PK\3\4", 20, *fixed) + name + packed, _ENTRY.pack(b"PK\1\2", 3 << 8 | 20, 20, *fixed, 0, 0, 0, 0o600 << 16, 0)[:-4]


def _archive(parts: dict[str, str | bytes]) -> bytes:
    """A ZIP file of the parts, with a fixed date, so that equal documents give equal bytes.

    What needs 64-bit fields or other names than ASCII ones is zipfile's, which takes many times longer for small parts."""
    bodies = [x.encode("utf-8") if isinstance(x, str) else x for x in parts.values()]
    if len(bodies) >= 0xFFFF or sum(map(len, bodies)) >= 1 << 30 or not all([p.isascii() and len(p) < 0xFFFF and "\0" not in p for p in parts]):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, body in zip(parts, bodies, strict=True):
                z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
        return out.getvalue()
    out, directory, at = [], [], 0
    for path, body in zip(parts, bodies, strict=True):
        name = path.encode("ascii")
        member, entry = _member(name, body)
        out.append(member)
        directory += (entry, at.to_bytes(4, "little"), name)
        at += len(member)
    listed = b"".join(directory)
    return b"".join([*out, listed, _END.pack(b"PK\5\6", 0, 0, len(bodies), len(bodies), len(listed), at, 0)])


_KNOWN = "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml", **_TYPES}.items())


def _package(parts: dict[str, str | bytes], types: dict[str, str]) -> bytes:
    """A package of parts; types has the content types of those that are not plain XML."""
    over = "".join([f'<Override PartName="/{p}" ContentType="{t}"/>' for p, t in types.items()])
    return _archive({"[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{_KNOWN}{over}</Types>', **parts})


def _rels_xml(rows: list[tuple[str, str, str, bool]]) -> str:
    base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
    return f'{_HEAD}<Relationships xmlns="{REL[1:-1]}">' + "".join(f'<Relationship Id="{i}" Type="{base}{t}" Target={quoteattr(x)}{" TargetMode=" + chr(34) + "External" + chr(34) if far else ""}/>' for i, t, x, far in rows) + "</Relationships>"


_LOOKS = ("bold", "italic", "strikethrough", "underline", "font_name", "font_size_pt", "color_rgb")


def _run_flags(r: dict) -> str:
    flags = "".join(f"<w:{t}/>" if r[k] else f'<w:{t} w:val="0"/>' for k, t in (("bold", "b"), ("italic", "i"), ("strikethrough", "strike")) if r.get(k) is not None)
    flags += f'<w:u w:val="{"single" if r["underline"] else "none"}"/>' if r.get("underline") is not None else ""
    flags += f"<w:rFonts w:ascii={quoteattr(r['font_name'])} w:hAnsi={quoteattr(r['font_name'])}/>" if r.get("font_name") else ""
    flags += f'<w:sz w:val="{round(r["font_size_pt"] * 2)}"/>' if r.get("font_size_pt") else ""
    color = (r.get("color_rgb") or "").lstrip("#")
    return flags + (f'<w:color w:val="{color.upper()}"/>' if re.fullmatch("[0-9a-fA-F]{6}", color) else "")


@lru_cache(1024)
def _style_ref(style: str | None) -> str:
    """The id of a style, quoted; documents have few styles and many paragraphs."""
    from vellum.formats.writers import level_of

    level = level_of(style)
    return quoteattr(f"Heading{level}" if level else (style or "Normal").replace(" ", ""))


@lru_cache(128)
def _styles_xml(names: tuple[tuple[str, str], ...]) -> str:
    return "".join(f"<w:style w:type=\"paragraph\" w:styleId={quoteattr(k)}><w:name w:val={quoteattr(v)}/></w:style>" for k, v in names)


def write_docx(doc: dict, title: str | None = None) -> bytes:
    from vellum.formats.writers import in_order, level_of

    links: list[str] = []

    def run(r: dict) -> str:
        flags = _run_flags(r) if any([r.get(k) is not None for k in _LOOKS]) else ""
        text = "<w:br/>".join([f'<w:t xml:space="preserve">{_clean(x)}</w:t>' for x in (r.get("text") or "").split("\n")])
        made = f"<w:r>{f'<w:rPr>{flags}</w:rPr>' if flags else ''}{text}</w:r>"
        if r.get("hyperlink_url"):
            links.append(r["hyperlink_url"])
            return f'<w:hyperlink r:id="rIdL{len(links)}">{made}</w:hyperlink>'
        return made

    def paragraph(p: dict) -> str:
        style = '"ListNumber"' if p.get("is_numbered") else '"ListBullet"' if p.get("is_bullet") else _style_ref(p.get("style"))
        jc = f'<w:jc w:val="{p["alignment"].lower()}"/>' if (p.get("alignment") or "").upper() in ("LEFT", "CENTER", "RIGHT", "BOTH", "JUSTIFY") else ""
        return f"<w:p><w:pPr><w:pStyle w:val={style}/>{jc}</w:pPr>{''.join(map(run, p.get('runs') or [{'text': p.get('text')}]))}</w:p>"

    def table(t: dict) -> str:
        def cell(c: dict) -> str:
            span = f'<w:tcPr><w:gridSpan w:val="{c["colspan"]}"/></w:tcPr>' if (c.get("colspan") or 1) > 1 else ""
            inner = "".join(map(paragraph, c.get("paragraphs") or [{"text": x} for x in (c.get("text") or "").split("\n")]))
            return f"<w:tc>{span}{inner}</w:tc>"

        return "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r["cells"])) + "</w:tr>" for r in t.get("rows") or []) + "</w:tbl>"

    body = [paragraph({"text": title, "style": "Title"})] if title else []
    body += [paragraph(x) if kind == "paragraph" else table(x) for kind, x in in_order(doc) if kind != "media"]
    names = {"Normal": "Normal", "Title": "Title", "ListBullet": "List Bullet", "ListNumber": "List Number", "CodeBlock": "CodeBlock", **{f"Heading{i}": f"Heading {i}" for i in range(1, 7)}}
    names |= {x.replace(" ", ""): x for x in dict.fromkeys([p.get("style") for p in doc.get("paragraphs") or []]) if x and not level_of(x)}
    space = f'xmlns:w="{W[1:-1]}" xmlns:r="{R[1:-1]}"'
    base = "application/vnd.openxmlformats-officedocument.wordprocessingml."
    return _package(
        {
            "_rels/.rels": _rels_xml([("rId1", "officeDocument", "word/document.xml", False)]),
            "word/_rels/document.xml.rels": _rels_xml([("rId1", "styles", "styles.xml", False), *[(f"rIdL{i + 1}", "hyperlink", x, True) for i, x in enumerate(links)]]),
            "word/document.xml": f"{_HEAD}<w:document {space}><w:body>{''.join(body)}</w:body></w:document>",
            "word/styles.xml": f"{_HEAD}<w:styles {space}>{_styles_xml(tuple(names.items()))}</w:styles>",
        },
        {"word/document.xml": base + "document.main+xml", "word/styles.xml": base + "styles+xml"},
    )


def body_lines(lines: list[str], title: str | None) -> list[str]:
    """Trimmed lines without the title and without repeats, in any case of letters."""
    out: dict[str, str] = {}
    for x in map(str.strip, lines):
        if x and x.lower() != (title or "").strip().lower():
            out.setdefault(x.lower(), x)
    return list(out.values())


def write_pptx(doc: dict, title: str | None = None) -> bytes:
    """The package's own parts if it has them; else a slide for each slide, or for each paragraph and table."""
    from vellum.formats.writers import cell_texts, in_order

    parts = {p["path"]: p["xml"] if p.get("xml") is not None else p["content"] for p in doc.get("parts") or []}
    if {"[Content_Types].xml", "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"} <= set(parts):
        return _archive(parts)
    ps, ts = ({x["index"]: x for x in doc.get(k) or []} for k in ("paragraphs", "tables"))
    pages = []
    for s in sorted(doc.get("slides") or [], key=lambda s: s.get("index") or 0):
        lines = body_lines([ps[i].get("text") or "" for i in s.get("paragraph_indices") or [] if i in ps], s.get("title"))
        pages.append((s.get("title"), lines, [cell_texts(ts[i]) for i in s.get("table_indices") or [] if i in ts][:1], s.get("notes_text")))
    if not pages:
        pages = [(title, [], [], None)] if title else []
        pages += [(None, [x.get("text") or ""], [], None) if kind == "paragraph" else (None, [], [cell_texts(x)], None) for kind, x in in_order(doc) if kind != "media"]
    space = f'xmlns:a="{A[1:-1]}" xmlns:p="{P[1:-1]}" xmlns:r="{R[1:-1]}"'
    para = lambda x: f"<a:p><a:r><a:t>{_clean(x)}</a:t></a:r></a:p>"

    def shape(lines: list[str], kind: str) -> str:
        return f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="{kind}"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{"".join(map(para, lines)) or "<a:p/>"}</p:txBody></p:sp>'

    def grid(rows: list[list[str]]) -> str:
        body = "".join("<a:tr h=\"370840\">" + "".join(f"<a:tc><a:txBody><a:bodyPr/>{''.join(map(para, c.split(chr(10))))}</a:txBody><a:tcPr/></a:tc>" for c in r) + "</a:tr>" for r in rows)
        return f"<p:graphicFrame><a:graphic><a:graphicData uri=\"http://schemas.openxmlformats.org/drawingml/2006/table\"><a:tbl>{body}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"

    base, files, types = "application/vnd.openxmlformats-officedocument.presentationml.", {}, {"ppt/presentation.xml": "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"}
    for n, (head, lines, grids, notes) in enumerate(pages, 1):
        inner = (shape(head.split("\n"), "title") if head else "") + (shape(lines, "body") if lines else "") + "".join(map(grid, grids))
        files[f"ppt/slides/slide{n}.xml"] = f"{_HEAD}<p:sld {space}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
        types[f"ppt/slides/slide{n}.xml"] = base + "slide+xml"
        if notes:
            files[f"ppt/notesSlides/notesSlide{n}.xml"] = f"{_HEAD}<p:notes {space}><p:cSld><p:spTree>{shape(notes.split(chr(10)), 'body')}</p:spTree></p:cSld></p:notes>"
            files[f"ppt/slides/_rels/slide{n}.xml.rels"] = _rels_xml([("rId1", "notesSlide", f"../notesSlides/notesSlide{n}.xml", False)])
            types[f"ppt/notesSlides/notesSlide{n}.xml"] = base + "notesSlide+xml"
    ids = "".join(f'<p:sldId id="{255 + n}" r:id="rId{n}"/>' for n in range(1, len(pages) + 1))
    return _package(
        {
            "_rels/.rels": _rels_xml([("rId1", "officeDocument", "ppt/presentation.xml", False)]),
            "ppt/presentation.xml": f"{_HEAD}<p:presentation {space}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>",
            "ppt/_rels/presentation.xml.rels": _rels_xml([(f"rId{n}", "slide", f"slides/slide{n}.xml", False) for n in range(1, len(pages) + 1)]),
            **files,
        },
        types,
    )
