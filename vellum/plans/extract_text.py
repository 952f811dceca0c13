"""Plain text as paragraphs, in one expression.

Lines are joined again with a mark wherever a block begins or ends, and split at the marks, so a text of any length
is read in one pass.  The mark is a character that ends lines, so no line can hold it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.schema import LIST_INFO, PARAGRAPH, RUN, SOURCE

_MARK = "\u001e"
_BULLET = rf"^{X.WS}*[-*+]{X.WS}+"
_NUMBER = rf"^{X.WS}*(\d+[.)]){X.WS}+"


def make(spec, **given: Column) -> Column:
    """A struct of the model's type: the given fields, and null for the others."""
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in spec.fields])


def blocks(text: Column, *, drop_dividers: bool = False) -> Column:
    """The stripped text of each block: list lines stand alone, blank lines (and dividers) end blocks."""

    kinds = [rf"{X.WS}*$", rf"{X.WS}*(?:[-*+]|\d+[.)]){X.WS}"] + ([rf"{X.WS}*[-=*_~]{{3,}}{X.WS}*$"] if drop_dividers else [])
    special = "^(?:" + "|".join(kinds) + ")"

    def mark(line: Column) -> Column:
        item = line.rlike(_BULLET) | line.rlike(_NUMBER)
        marked = F.when(item, F.concat(F.lit(_MARK), X.rstrip(line), F.lit(_MARK))).otherwise(F.lit(_MARK))
        # One test tells plain lines, which are most, from blank lines, list lines and dividers.
        return F.when(line.rlike(special), marked).otherwise(X.rstrip(line))

    joined = F.array_join(F.transform(X.split_lines(text), mark), "\n")
    return F.filter(F.transform(F.split(joined, rf"(?:\n?{_MARK}\n?)+"), X.strip), lambda b: b != "")


def paragraph(raw: Column, index: Column) -> Column:
    bullet, number = raw.rlike(_BULLET), raw.rlike(_NUMBER)
    text = F.when(bullet, F.regexp_replace(raw, _BULLET, "")).when(number, F.regexp_replace(raw, _NUMBER, "")).otherwise(raw)
    numbered = ~bullet & number
    kind = F.when(bullet, "bullet").when(number, "numbered")
    marker = F.when(bullet, "bullet").when(number, F.regexp_extract(raw, _NUMBER, 1))
    info = F.when(kind.isNotNull(), make(LIST_INFO, kind=kind, numbering_format=marker))
    run = make(RUN, index=F.lit(0), text=text)
    return make(PARAGRAPH, index=index, text=text, is_bullet=bullet, is_numbered=numbered, list_info=info, numbering_format=marker, runs=F.array(run), source=make(SOURCE, format=F.lit("txt")))


def paragraphs(text: Column, *, drop_dividers: bool = False) -> Column:
    """Paragraph structs of a plain text; a null text has none."""
    return F.transform(blocks(F.coalesce(text, F.lit("")), drop_dividers=drop_dividers), lambda b, i: paragraph(b, i))


def order(items: Column, kind: str = "paragraph") -> Column:
    return F.transform(items, lambda p: F.struct(F.lit(kind).alias("type"), p["index"].alias("index")))
