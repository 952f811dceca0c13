"""PDF: a reader of text spans, the structure that spans imply, a chunker of plain page text, and a writer.

The reader takes uncompressed and Flate streams and simple (one byte a character) fonts, in files with plain object
syntax.  Encrypted files raise ValueError.  Pages without text (scans) give no paragraphs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

MAX_CHARS, OVERLAP = 800, 80
#: Fixed values of the layout rules.
LARGER, LEVELS, IN_TABLE, IN_TABLE_SIMPLE = 1.05, 6, 0.40, 0.50
BULLET = re.compile(r"[-*+•·▪▸▹►◦‣⁃◉○●∙]\s+")
NUMBER = re.compile(r"\s*((?:\d+|[a-zA-Z]|[ivxlcdmIVXLCDM]+)[.)])\s+")

_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]*|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": "\n", b"r": "\r", b"t": "\t", b"b": "\b", b"f": "\f"}


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        return bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode().ljust(2, "0")).decode("latin-1")
    one = lambda m: _ESCAPES.get(m[1]) or (chr(int(m[1], 8) & 255) if m[1][:1].isdigit() else m[1].decode("latin-1"))
    return re.sub(r"\\([0-7]{1,3}|.)", lambda m: one((None, m[1].encode("latin-1"))), raw[1:-1].decode("latin-1"), flags=re.S)


def _objects(data: bytes) -> dict[int, bytes]:
    out = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj(.*?)endobj", data, re.S)}
    for body in [b for b in out.values() if b"/ObjStm" in b]:
        raw, first = _stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
        numbers = list(map(int, raw[:first].split()))
        starts = numbers[1::2]
        for n, a, b in zip(numbers[::2], starts, [*starts[1:], len(raw) - first]):
            out.setdefault(n, raw[first + a : first + b])
    return out


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in body[: m.start()] else m[1]


def _refs(raw: bytes | None) -> list[int]:
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", raw or b"")]


def _entry(body: bytes, key: bytes) -> bytes | None:
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|<<.*?>>|\d+\s+\d+\s+R|/?[^\s/<>\[\]]+)", body, re.S)
    return m[1] if m else None


def read_spans(data: bytes) -> list[dict]:
    """Spans (page, line, text, size, font, color, x0, y0, x1, y1), y from the top, in the order in which they are drawn."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("the file is encrypted")
    objects, pages, spans = _objects(data), [], []

    def collect(n: int, depth: int = 0) -> None:
        body = objects.get(n, b"")
        if re.search(rb"/Type\s*/Pages\b", body) and depth < 50:
            for kid in _refs(_entry(body, b"Kids")):
                collect(kid, depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            pages.append(body)

    root = next((r for b in objects.values() if re.search(rb"/Type\s*/Catalog", b) for r in _refs(_entry(b, b"Pages"))), None)
    if root is not None:
        collect(root)
    for number, page in enumerate(pages):
        box = [float(x) for x in re.findall(rb"[-\d.]+", _entry(page, b"MediaBox") or b"[0 0 612 792]")]
        fonts = {}
        m = re.search(rb"/Font\s*<<(.*?)>>", page, re.S)
        for name, ref in re.findall(rb"/(\S+)\s+(\d+)\s+\d+\s+R", m[1] if m else b""):
            base = _entry(objects.get(int(ref), b""), b"BaseFont")
            fonts[name] = base.decode("latin-1").lstrip("/") if base else name.decode()
        content = b"\n".join(_stream(objects.get(r, b"")) for r in _refs(_entry(page, b"Contents")))
        spans += _page_spans(content, number, box[3] if len(box) > 3 else 792.0, fonts)
    return spans


def _page_spans(content: bytes, page: int, height: float, fonts: dict) -> list[dict]:
    out, stack, x, y, left, top, lead, size, scale, font, color, line = [], [], 0.0, 0.0, 0.0, 0.0, 0.0, 12.0, 1.0, "", 0, 0
    in_array, array = False, []

    def show(text: str) -> None:
        nonlocal x
        real = size * scale
        width = 0.5 * real * len(text)
        if text:
            out.append({"page": page, "line": line, "text": text, "size": round(real, 2), "font": font, "color": color, "x0": x, "y0": height - y - real, "x1": x + width, "y1": height - y})
        x += width

    def numbers(n: int) -> list[float]:
        return [float(v) for v in stack[-n:]] if len(stack) >= n else [0.0] * n

    for m in _TOKEN.finditer(content):
        t = m[0]
        if t == b"[":
            in_array, array = True, []
        elif t == b"]":
            in_array = False
        elif t[:1] in b"(<":
            (array if in_array else stack).append(_string(t))
        elif t[:1] == b"/":
            stack.append(t[1:])
        elif re.fullmatch(rb"[-+]?[0-9]*\.?[0-9]+", t):
            (array if in_array else stack).append(float(t))
        else:
            op = t.decode()
            if op == "Tf" and len(stack) >= 2:
                font, size = fonts.get(stack[-2], str(stack[-2])), float(stack[-1])
            elif op == "BT":
                x = y = left = top = 0.0
                scale = 1.0
                line += 1
            elif op in ("Td", "TD"):
                dx, dy = numbers(2)
                left, top = left + dx * scale, top + dy * scale
                lead = -dy if op == "TD" else lead
                x, y, line = left, top, line + bool(dy)
            elif op == "Tm":
                a, _, _, d, e, f = numbers(6)
                line += f != y
                left = x = e
                top = y = f
                scale = abs(d) or abs(a) or 1.0
            elif op == "TL":
                lead = numbers(1)[0]
            elif op == "rg":
                color = sum(round(v * 255) << s for v, s in zip(numbers(3), (16, 8, 0)))
            elif op in ("T*", "'", '"'):
                top -= lead * scale
                x, y, line = left, top, line + 1
                if op != "T*" and stack and isinstance(stack[-1], str):
                    show(stack[-1])
            elif op == "Tj" and stack and isinstance(stack[-1], str):
                show(stack[-1])
            elif op == "TJ":
                for v in array:
                    if isinstance(v, str):
                        show(v)
                    elif v < -200:
                        show(" ")
            stack.clear()
    return out


def blocks_of(spans: list[dict]) -> list[list[dict]]:
    """Spans of lines that follow each other closely, in one font size, as blocks."""
    out: list[list[dict]] = []
    for s in spans:
        last = out[-1][-1] if out else None
        near = last and last["page"] == s["page"] and (last["line"] == s["line"] or (0 <= s["y0"] - last["y1"] <= 0.6 * s["size"] and abs(s["size"] - last["size"]) < 0.1))
        if near:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def body_size(sizes: list[float]) -> float:
    """The most common size; of equally common ones the first; 12 if there is none."""
    return Counter(sizes).most_common(1)[0][0] if sizes else 12.0


def heading_levels(sizes: list[float], body: float) -> dict[float, str]:
    larger = sorted({s for s in sizes if s > body * LARGER}, reverse=True)[:LEVELS]
    return {s: f"Heading {i}" for i, s in enumerate(larger, 1)}


def list_type(text: str) -> str | None:
    """`bullet:•` whatever the sign, `decimal:` and the mark as it stands, or nothing."""
    if BULLET.match(text):
        return "bullet:•"
    return f"decimal:{m[1]}" if (m := NUMBER.match(text)) else None


def merge_spans(spans: list[dict]) -> list[dict]:
    """Runs of neighbours with one size, font and colour."""
    runs: list[dict] = []
    for s in spans:
        name = s["font"].lower()
        look = {"font_name": s["font"], "font_size_pt": s["size"], "bold": "bold" in name or None, "italic": "italic" in name or "oblique" in name or None, "color_rgb": f"{s['color'] & 0xFFFFFF:06X}"}
        if runs and {k: runs[-1][k] for k in look} == look:
            runs[-1]["text"] += s["text"]
        else:
            runs.append({"index": len(runs), "text": s["text"], **look})
    return runs


def read_pdf(data: bytes, include_media: bool = True, profile: str = "chunks") -> dict:
    """Paragraphs from blocks, in reading order; the largest size in a block gives its heading level."""
    spans = read_spans(data)
    sampled = [s for s in spans if s["page"] < 50] if profile == "chunking" else spans
    sizes = [round(s["size"], 1) for s in sampled if s["text"].strip()]
    body = body_size(sizes)
    levels, paragraphs = heading_levels(sizes, body), []
    for block in sorted(blocks_of(spans), key=lambda b: (b[0]["page"], b[0]["y0"])):
        lines: dict[int, str] = {}
        for s in block:
            lines[s["line"]] = lines.get(s["line"], "") + s["text"]
        text = " ".join(x.strip() for x in lines.values() if x.strip())
        if text:
            form = list_type(text)
            kind = form.partition(":")[0] if form else None
            paragraphs.append({"index": len(paragraphs), "text": text, "style": levels.get(round(max(s["size"] for s in block), 1), "Normal"), "is_bullet": kind == "bullet", "is_numbered": kind == "decimal", "numbering_format": form, "direction": "ltr", "page_index": block[0]["page"], "runs": merge_spans(block), "source": {"format": "pdf"}})
    fonts = Counter(s["font"] for s in spans)
    name = fonts.most_common(1)[0][0] if fonts and profile != "chunking" else None
    return {"source_type": "pdf", "metadata": {"source_type": "pdf"}, "document_order": [{"type": "paragraph", "index": i} for i in range(len(paragraphs))], "document_defaults": {"font_name": name, "font_size_pt": body}, "paragraphs": paragraphs, "tables": [], "media": []}


# -- plain page text in overlapping chunks ------------------------------------------------------------------------

def boundary(text: str, most: int) -> int:
    """Where the first chunk of a longer text ends: behind the last sentence that ends past a third of the limit, else
    the last word that does, else at the limit."""
    third = most // 3
    for unit in (rf".{{{third},}}[.!?]\s", rf".{{{third + 1},}} "):
        # The dots take as much as they can, so the unit found is the last one.
        if found := re.compile(unit, re.S).match(text, 0, most):
            return found.end()
    return most


def carried(chunk: str, overlap: int) -> str:
    """The whole words at the end of a chunk that `overlap` characters hold; without a space there, all of these."""
    if not 0 < overlap < len(chunk):
        return ""
    cut, space, words = chunk[-overlap:].partition(" ")
    return words if space else cut


def cut_at_boundary(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> tuple[str, str]:
    """(chunk, rest): the rest begins with what is carried over from the chunk."""
    at = boundary(text, most)
    chunk, rest = text[:at].strip(), text[at:].strip()
    again = carried(chunk, overlap)
    return chunk, f"{again} {rest}".strip() if rest else again


def sliding_chunks(pieces: list[tuple[str, str]], most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Chunks of (separator, text) pieces in order; texts are normalised, and tables' texts kept as they are."""
    buffer, out = "", []
    for separator, piece in pieces:
        text = re.sub(r"\s+", " ", piece).strip() if separator == " " else piece
        if not text:
            continue
        buffer = (buffer + separator + text).lstrip() if buffer else text
        while len(buffer) >= most:
            chunk, rest = cut_at_boundary(buffer, most, overlap)
            if not chunk:
                chunk, rest = buffer[:most].strip(), buffer[most:].strip()
            out.append(chunk)
            buffer = rest
    return [*out, buffer.strip()] if buffer.strip() else out


def chunk_pdf(data: bytes, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    return sliding_chunks([(" ", " ".join(s["text"] for s in b)) for b in blocks_of(read_spans(data))], most, overlap)


# -- writing ------------------------------------------------------------------------------------------------------

def fit_image(width: float, height: float, most: tuple[float, float] = (468.0, 612.0)) -> tuple[float, float]:
    """The size that fits a page of 6.5 by 8.5 inches, never enlarged."""
    factor = min(most[0] / width, most[1] / height, 1.0) if width and height else 1.0
    return width * factor, height * factor


def write_pdf(doc: dict, title: str | None = None) -> bytes:
    """Headings, paragraphs and tables on letter pages; a new page where page_index grows."""
    from vellum.formats.writers import cell_texts, in_order, level_of

    pages: list[list[str]] = [[]]
    y, reached = 740.0, None

    def put(text: str, size: float, bold: bool = False) -> None:
        nonlocal y
        width = int(468 / (0.5 * size))
        for raw in text.split("\n"):
            words, line, lines = raw.split(" "), "", []
            for w in words:
                if line and len(line) + 1 + len(w) > width:
                    lines.append(line)
                    line = w
                else:
                    line = f"{line} {w}" if line else w
            for x in [*lines, line]:
                if y < 60:
                    pages.append([])
                    y = 740.0
                shown = x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").decode("latin-1")
                pages[-1].append(f"BT /{'F2' if bold else 'F1'} {size:g} Tf 72 {y:g} Td ({shown}) Tj ET")
                y -= 1.2 * size
        y -= 0.8 * size + 4

    if title:
        put(title, 22, True)
    ordered = in_order(doc) if doc.get("document_order") else []
    for kind, x in ordered:
        page = x.get("page_index")
        if page is not None:
            if reached is not None and page > reached:
                pages.append([])
                y = 740.0
            reached = page if reached is None else max(reached, page)
        if kind == "paragraph":
            level, text = level_of(x.get("style")), (x.get("text") or "").strip()
            mark = "- " if x.get("is_bullet") else f"{x.get('numbering_format') or '1.'} " if x.get("is_numbered") else ""
            if text:
                put(mark + text, {1: 20, 2: 17, 3: 15}.get(level, 13) if level else 11, bool(level))
        elif kind == "table":
            for r in cell_texts(x):
                put(" | ".join(r), 10)
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(len(pages)))
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>"]
    bodies += [f"<< /Type /Font /Subtype /Type1 /BaseFont /{f} /Encoding /WinAnsiEncoding >>" for f in ("Helvetica", "Helvetica-Bold")]
    raw: list[bytes] = [b.encode("latin-1") for b in bodies]
    for i, lines in enumerate(pages):
        raw.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {6 + 2 * i} 0 R >>".encode())
        packed = zlib.compress("\n".join(lines).encode("latin-1"))
        raw.append(b"<< /Filter /FlateDecode /Length %d >>\nstream\n%b\nendstream" % (len(packed), packed))
    out, places = b"%PDF-1.4\n", []
    for n, b in enumerate(raw, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (n, b)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%btrailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(raw) + 1, table, len(raw) + 1, len(out))
