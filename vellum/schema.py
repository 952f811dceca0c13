"""The document model: one struct per document, with ordered blocks and the items that they name."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: dict) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in spec.items()])


S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

RUN = _struct({
    "index": I, "text": S, "bold": B, "italic": B, "underline": B, "strikethrough": B, "code": B, "font_name": S,
    "font_size_pt": D, "color_rgb": S, "highlight_color": S, "hyperlink_url": S, "vertical_align": S,
    "semantic_insert": B, "semantic_delete": B,
})
LIST_INFO = _struct({"kind": S, "numbering_format": S, "level": I, "start": I, "num_id": I, "indent_level": I})
SOURCE = _struct({"format": S, "tag": S, "attrs": T.MapType(S, S), "raw_html": S})
PARAGRAPH = _struct({
    "index": I, "text": S, "style": S, "code_fence_language": S, "is_bullet": B, "is_numbered": B, "list_info": LIST_INFO,
    "numbering_format": S, "list_level": I, "alignment": S, "direction": S, "page_index": I, "runs": T.ArrayType(RUN), "source": SOURCE,
})
#: A table inside a cell is a table of its own; the cell names it by index, so the type need not hold itself.
CELL = _struct({
    "cell_index": I, "text": S, "is_header": B, "colspan": I, "rowspan": I, "nested_table_indices": T.ArrayType(I),
    "paragraphs": T.ArrayType(_struct({"index": I, "text": S, "style": S, "runs": T.ArrayType(RUN)})),
})
TABLE = _struct({
    "index": I, "row_count": I, "column_count": I, "style": S, "page_index": I,
    "rows": T.ArrayType(_struct({"row_index": I, "cells": T.ArrayType(CELL)})),
})
MEDIA = _struct({
    "relationship_id": S, "content_type": S, "file_name": S, "local_file_path": S, "local_url": S, "width_emu": I,
    "height_emu": I, "alt_text": S, "content": T.BinaryType(),
})
SLIDE = _struct({
    "index": I, "slide_number": I, "title": S, "text": S, "notes_text": S, "paragraph_indices": T.ArrayType(I),
    "table_indices": T.ArrayType(I), "media_indices": T.ArrayType(I), "shape_count": I,
})
ORDER = _struct({"type": S, "index": I})
STYLE = _struct({"style_id": S, "name": S, "type": S, "font_name": S, "font_size_pt": D, "bold": B, "italic": B, "underline": B, "color_rgb": S})
PART = _struct({"path": S, "xml": S, "content": T.BinaryType()})
DOCUMENT = _struct({
    "source_type": S, "metadata": T.MapType(S, S), "document_order": T.ArrayType(ORDER),
    "document_defaults": _struct({"font_name": S, "font_size_pt": D, "color_rgb": S}), "styles": T.ArrayType(STYLE),
    "paragraphs": T.ArrayType(PARAGRAPH), "tables": T.ArrayType(TABLE), "media": T.ArrayType(MEDIA), "slides": T.ArrayType(SLIDE),
    "parts": T.ArrayType(PART), "error": S,
})


def only(kind: T.DataType, *paths: str) -> T.DataType:
    """The type with the parts alone that the dotted paths name, as `paragraphs.text`; arrays are passed through."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(only(kind.elementType, *paths))
    rest: dict[str, list[str]] = {}
    for p in paths:
        head, _, tail = p.partition(".")
        rest.setdefault(head, []).append(tail)
    if unknown := set(rest) - set(kind.names):
        raise ValueError(f"no such field: {sorted(unknown)}")
    return T.StructType([T.StructField(f.name, f.dataType if "" in rest[f.name] else only(f.dataType, *rest[f.name])) for f in kind.fields if f.name in rest])


def completer(kind: T.DataType):
    """A function that copies a value of the type with null for every field that is not there; None if nothing is to do."""
    if isinstance(kind, T.ArrayType):
        one = completer(kind.elementType)
        return (lambda xs: [x if x is None else one(x) for x in xs]) if one else list
    if isinstance(kind, T.MapType):
        return dict
    if not isinstance(kind, T.StructType):
        return None
    empty, inner = dict.fromkeys(kind.names), [(f.name, g) for f in kind.fields if (g := completer(f.dataType))]

    def complete(x: dict) -> dict:
        out = {**empty, **x}
        for k, g in inner:
            if out[k] is not None:
                out[k] = g(out[k])
        return out

    return complete
