"""Text functions as columns.  White space is Unicode's, as in most document formats, not only ASCII's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, and those that end a line.
WS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_WS = "[^" + WS[1:]
#: White space but for the plain space.
ODD_WS = r"[\t-\r" + WS[3:]
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, use) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    # A look at the two ends is far cheaper than the replacement, which most texts do not need.
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(WS), F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")).otherwise(c)


def rstrip(c: Column) -> Column:
    return F.when(F.right(c, F.lit(1)).rlike(WS), F.regexp_replace(c, rf"{WS}+$", "")).otherwise(c)


def clean_text(c: Column) -> Column:
    """White space collapsed to single spaces and stripped; null becomes empty."""
    # Single plain spaces stay as they are, so only the odd ones are replaced.
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{WS}{{2,}}|{ODD_WS}", " "))


def is_blank(c: Column) -> Column:
    return ~c.rlike(NOT_WS)


def split_lines(c: Column) -> Column:
    """The lines of a text; a line end at the very end starts no further line."""
    parts = F.split(c, LINE_END)
    last = F.element_at(parts, -1) == ""
    return F.when(last, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def decode_utf8(content: Column) -> Column:
    """Bytes as text: U+FFFD for what is not UTF-8, and no byte-order mark."""
    return F.regexp_replace(F.call_function("make_valid_utf8", content.cast("string")), r"^\ufeff", "")


def sentences(c: Column) -> Column:
    """Parts between white space that follows `.`, `!` or `?`, stripped and not empty."""
    parts = F.split(c, rf"(?<=[.!?]){WS}+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def normalize_extension(c: Column) -> Column:
    """docx, pdf, pptx, html, md or txt for an extension or format name; docx for what is not known."""
    own = let(F.coalesce(c, F.lit("")), lambda x: F.regexp_replace(F.lower(strip(x)), r"^\.+", ""))
    return let(own, lambda own: (
        F.when(own == "pdf", "pdf")
        .when(own.isin("ppt", "pptx"), "pptx")
        .when(own.isin("html", "htm"), "html")
        .when(own.isin("md", "markdown"), "md")
        .when(own.isin("txt", "text"), "txt")
        .otherwise("docx")
    ))


def chunk_filename(name: Column, extension: Column) -> Column:
    """The stripped name (or `document`) with the extension, unless it has it in any case of letters."""
    suffix = F.concat(F.lit("."), extension)
    named = lambda own: F.when(F.endswith(F.lower(own), F.lower(suffix)), own).otherwise(F.concat(own, suffix))
    own = let(let(F.coalesce(name, F.lit("")), strip), lambda x: F.when(x == "", F.lit("document")).otherwise(x))
    return let(own, named)


def is_heading(style: Column) -> Column:
    """Style `title`, or one with `heading` and a level of 1 to 4."""
    own = strip(F.coalesce(style, F.lit("")))
    level = F.regexp_extract(own, r"(?i)heading\s*([1-6])", 1)
    return (F.lower(own) == "title") | level.isin("1", "2", "3", "4")


def heading_level(style: Column) -> Column:
    """The level in a style such as `Heading 2` or `h2`; null for others."""
    own = F.coalesce(style, F.lit(""))
    found = F.coalesce(F.nullif(F.regexp_extract(own, r"(?i)heading\s*([1-6])", 1), F.lit("")), F.nullif(F.regexp_extract(own, r"(?i)^h([1-6])$", 1), F.lit("")))
    return found.cast("int")


def format_paragraph(p: Column) -> Column:
    """A paragraph as one line of text, with its list marker; empty if it has no text."""
    marker = F.coalesce(F.nullif(p["numbering_format"], F.lit("")), F.lit("1."))

    def line(text: Column) -> Column:
        numbered = strip(F.concat(marker, F.lit(" "), text))
        return F.when(text == "", "").when(F.coalesce(p["is_bullet"], F.lit(False)), F.concat(F.lit("- "), text)).when(F.coalesce(p["is_numbered"], F.lit(False)), numbered).otherwise(text)

    return let(clean_text(p["text"]), line)


def format_table(t: Column) -> Column:
    """`Table:` and a line for each row with text, cells joined by ` | `; empty for a table without text."""
    rows = F.transform(t["rows"], lambda r: F.array_join(F.filter(F.transform(r["cells"], lambda c: clean_text(c["text"])), lambda x: x != ""), " | "))
    lines = F.array_join(F.filter(rows, lambda r: r != ""), "\n")
    return F.when(F.coalesce(lines, F.lit("")) == "", "").otherwise(F.concat(F.lit("Table:\n"), lines))


def strip_inline_markdown(c: Column) -> Column:
    """The visible content of inline Markdown; a second pass takes markers that the first laid open."""
    # The forms in the order in which they are tried.
    forms = (
        r"\*{3}(.+?)\*{3}", r"\*{2}(.+?)\*{2}", r"_{2}(.+?)_{2}", r"\*(.+?)\*", r"_(.+?)_",
        r"~~(.+?)~~", r"`(.+?)`", r"!\[([^\]]*)\]\([^)]*\)", r"\[([^\]]+)\]\([^)]*\)", r"\\(.)",
    )
    kept = "".join(f"${i}" for i in range(1, len(forms) + 1))
    once = F.regexp_replace(c, "(?s)" + "|".join(forms), kept)
    return F.when(once == c, c).otherwise(F.regexp_replace(once, "(?s)" + "|".join(forms), kept))


def css_color(c: Column) -> Column:
    """`#...` as it is, rgb() as hexadecimal, a bare word as it is; else null."""
    own = F.trim(c)
    rgb = rf"(?i)^rgb\({WS}*(\d+){WS}*,{WS}*(\d+){WS}*,{WS}*(\d+){WS}*\)$"
    number = lambda i: F.regexp_extract(own, rgb, i).cast("int")
    return (
        F.when(F.startswith(own, F.lit("#")), own)
        .when(own.rlike(rgb), F.format_string("#%02x%02x%02x", number(1), number(2), number(3)))
        .when(own.rlike(r"^[a-zA-Z]+$"), own)
    )


def css_points(c: Column) -> Column:
    """A CSS size in points: px count 0.75, em and rem 12, pt and bare numbers 1; null if it is none."""
    form = r"(?i)^([\d.]+)\s*(pt|px|em|rem)?"
    own = F.trim(c)
    unit = F.lower(F.regexp_extract(own, form, 2))
    factor = F.when(unit == "px", 0.75).when(unit.isin("em", "rem"), 12.0).otherwise(1.0)
    return F.bround(F.nullif(F.regexp_extract(own, form, 1), F.lit("")).try_cast("double") * factor, 2)


def rgb_hex(c: Column) -> Column:
    """A colour number as six hexadecimal digits."""
    return F.lpad(F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFFFF))), 6, "0")


def pointer_tokens(path: Column) -> Column:
    """The tokens of a JSON pointer; null where it does not start with a slash or names the root."""
    tokens = F.transform(F.split(F.substr(path, F.lit(2)), "/"), lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(F.startswith(path, F.lit("/")) & (F.length(path) > 1), tokens)
