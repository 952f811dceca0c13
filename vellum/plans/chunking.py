"""Section-aware text chunks from a document's ordered blocks.

Two profiles exist.  `chunking` packs parts up to the limit and then merges short chunks up to limit + minimum;
`chunks` cuts a section only around over-long parts, and merges short chunks (up to the limit) only in documents
without any heading.  All is one expression over a document's arrays, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import text as X

MAX_CHARS, MIN_CHARS = 1200, 350
_STATE = "struct<out:array<string>,cur:string>"


def limits(max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> tuple[int, int]:
    """The limit is 300 at least; the minimum 120 at least and, before that, no more than the limit."""
    most = max(300, max_chars)
    return most, max(120, min(min_chars, most))


def _state(out: Column, cur: Column) -> Column:
    return F.struct(out.alias("out"), cur.alias("cur")).cast(_STATE)


def _empty() -> Column:
    return _state(F.array(), F.lit(""))


def _closed(s: Column) -> Column:
    """What is out, and the open chunk if it holds something."""
    return F.when(s["cur"] != "", F.array_append(s["out"], s["cur"])).otherwise(s["out"])


def _non_empty(a: Column) -> Column:
    return F.filter(F.transform(a, X.strip), lambda x: x != "")


def _hard_pieces(sentence: Column, most: int) -> Column:
    """A sentence cut to the limit: at the last space in the second half, else at the limit."""

    def cut(s: Column, _: Column) -> Column:
        cur = s["cur"]
        head = F.substring(cur, 1, most)
        space = most - F.locate(" ", F.reverse(head))
        at = F.when((F.locate(" ", head) == 0) | (space <= most // 2), F.lit(most)).otherwise(space)
        rest = X.strip(F.substr(cur, at + 1))
        return F.when(F.length(cur) > most, _state(F.array_append(s["out"], X.strip(F.substr(cur, F.lit(1), at))), rest)).otherwise(s)

    # Every cut takes more than half the limit.
    times = F.sequence(F.lit(1), F.greatest(F.ceil(F.length(sentence) / (most // 2)).cast("int"), F.lit(1)))
    return F.aggregate(times, _state(F.array(), sentence), cut, lambda s: F.array_append(s["out"], s["cur"]))


def split_large_text(text: Column, most: int = MAX_CHARS) -> Column:
    """Whole sentences joined by spaces up to the limit; longer sentences are cut."""

    def add(s: Column, sentence: Column) -> Column:
        joined = F.when(s["cur"] == "", sentence).otherwise(F.concat(s["cur"], F.lit(" "), sentence))
        cut = X.let(_hard_pieces(sentence, most), lambda x: _state(F.concat(_closed(s), F.slice(x, F.lit(1), F.size(x) - 1)), F.element_at(x, -1)))
        after = F.when(F.length(sentence) > most, cut).otherwise(_state(_closed(s), sentence))
        return F.when(F.length(joined) <= most, _state(s["out"], joined)).otherwise(after)

    def pack(parts: Column) -> Column:
        return _non_empty(F.when(F.size(parts) == 0, F.array(F.substring(text, 1, most))).otherwise(F.aggregate(parts, _empty(), add, _closed)))

    return X.let(X.sentences(text), pack)


def split_unit(parts: Column, *, accumulate: bool, most: int = MAX_CHARS) -> Column:
    """The chunks of one section's parts, joined by line ends.

    With `accumulate` a chunk takes parts up to the limit.  Without it a part's own length alone is tested, and only
    parts over the limit (or, after others, as long as it) end a chunk."""

    def add(s: Column, part: Column) -> Column:
        joined = F.when(s["cur"] == "", part).otherwise(F.concat(s["cur"], F.lit("\n"), part))
        tested = F.length(joined) if accumulate else F.length(part) + F.when(s["cur"] == "", 0).otherwise(1)
        return (
            F.when(F.length(part) > most, _state(F.concat(_closed(s), split_large_text(part, most)), F.lit("")))
            .when(tested <= most, _state(s["out"], joined))
            .otherwise(_state(_closed(s), part))
        )

    return _non_empty(F.aggregate(parts, _empty(), add, _closed))


def merge_short(chunks: Column, *, least: int, ceiling: int) -> Column:
    """A chunk under `least` joins the one before it if both fit the ceiling."""

    def add(s: Column, chunk: Column) -> Column:
        joined = X.strip(F.concat(s["cur"], F.lit("\n"), chunk))
        fits = (s["cur"] != "") & (F.length(chunk) < least) & (F.length(joined) <= ceiling)
        return F.when(fits, _state(s["out"], joined)).otherwise(_state(_closed(s), chunk))

    return F.aggregate(chunks, _empty(), add, _closed)


_UNIT = "struct<heading:string,parts:array<string>>"


def build_units(items: Column) -> Column:
    """Sections (heading, parts) from (text, is_heading) items in order: a heading opens one and is its first part."""
    none = F.array().cast(f"array<{_UNIT}>")

    def cut(items: Column) -> Column:
        # Where sections begin: at the first item, and at every heading.
        starts = F.filter(F.transform(items, lambda x, i: F.when(x["is_heading"] | (i == 0), i)), lambda i: i.isNotNull())

        def units(begin: Column) -> Column:
            def unit(at: Column, k: Column) -> Column:
                own = F.slice(items, at + 1, F.coalesce(F.get(begin, k + 1), F.size(items)) - at)
                heading = F.when(F.get(items, at)["is_heading"], F.get(items, at)["text"])
                return F.struct(heading.alias("heading"), F.transform(own, lambda x: x["text"]).alias("parts")).cast(_UNIT)

            return F.transform(begin, unit)

        return F.when(F.size(items) == 0, none).otherwise(X.let(starts, units))

    return X.let(F.filter(items, lambda x: x["text"] != ""), cut)


def absorb_heading_only(units: Column) -> Column:
    """A section of a heading alone goes before the next one's parts; of several in a row only the last does."""
    alone = lambda u: u["heading"].isNotNull() & (F.size(u["parts"]) == 1)

    def absorb(units: Column) -> Column:
        def joined(u: Column, i: Column) -> Column:
            before = F.get(units, i - 1)
            prefix = F.when((i > 0) & alone(before), F.array(before["heading"])).otherwise(F.array().cast("array<string>"))
            last = i == F.size(units) - 1
            return F.when(alone(u), F.when(last, u)).otherwise(F.struct(u["heading"].alias("heading"), F.concat(prefix, u["parts"]).alias("parts")).cast(_UNIT))

        return F.filter(F.transform(units, joined), lambda u: u.isNotNull())

    return X.let(units, absorb)


def _with_lookup(items: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """use(find), where find gives the item of an index, of several the last.  Items mostly stand at their index."""

    def found(in_place: Column) -> Column:
        last = lambda i: X.let(F.filter(items, lambda p: p["index"] == i), lambda x: F.get(x, F.size(x) - 1))
        return use(lambda i: F.when(in_place, F.get(items, i)).otherwise(last(i)))

    return X.let(F.forall(F.transform(items, lambda p, i: p["index"].eqNullSafe(i)), lambda ok: ok), found)


def document_units(doc: Column) -> Column:
    """Sections of a document struct, by its order; without usable order from all paragraphs, or else all tables."""

    def items(paragraph: Callable[[Column], Column], table: Callable[[Column], Column]) -> Column:
        def item(o: Column) -> Column:
            own = lambda p: F.struct(F.coalesce(X.format_paragraph(p), F.lit("")).alias("text"), X.is_heading(p["style"]).alias("is_heading"))
            other = F.struct(F.coalesce(X.format_table(table(o["index"])), F.lit("")).alias("text"), F.lit(False).alias("is_heading"))
            none = F.struct(F.lit("").alias("text"), F.lit(False).alias("is_heading"))
            return F.when(o["type"] == "paragraph", X.let(paragraph(o["index"]), own)).when(o["type"] == "table", other).otherwise(none)

        return F.transform(doc["document_order"], item)

    units = _with_lookup(doc["paragraphs"], lambda p: _with_lookup(doc["tables"], lambda t: build_units(items(p, t))))
    texts = _non_empty(F.transform(doc["paragraphs"], X.format_paragraph))
    tables = _non_empty(F.transform(doc["tables"], X.format_table))
    rest = X.let(texts, lambda x: F.when(F.size(x) > 0, x).otherwise(tables))
    one = X.let(rest, lambda x: F.when(F.size(x) > 0, F.array(F.struct(F.lit(None).cast("string").alias("heading"), x.alias("parts")).cast(_UNIT))).otherwise(F.array().cast(f"array<{_UNIT}>")))
    return X.let(units, lambda u: F.when(F.size(u) > 0, u).otherwise(one))


def chunk_units(units: Column, profile: str = "chunking", *, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> Column:
    """The chunks of a document's sections under a profile."""
    most, least = limits(max_chars, min_chars)

    def chunks(units: Column) -> Column:
        return F.flatten(F.transform(units, lambda u: split_unit(u["parts"], accumulate=profile == "chunking", most=most)))

    def all_(own: Column) -> Column:
        headed = F.exists(own, lambda u: u["heading"].isNotNull())
        used = F.when(headed, absorb_heading_only(own)).otherwise(own)
        if profile == "chunking":
            return merge_short(chunks(used), least=least, ceiling=most + least)
        return X.let(chunks(used), lambda c: F.when(headed, c).otherwise(merge_short(c, least=least, ceiling=most)))

    return X.let(units, all_)


def chunk_document(doc: Column, profile: str = "chunking", **sizes: int) -> Column:
    return chunk_units(document_units(doc), profile, **sizes)


def slide_parts(doc: Column, slide: Column) -> Column:
    """Body paragraphs, tables and notes of a slide; headings, so the title, are left out."""
    def pick(items: Column, indices: Column, form: Callable[[Column], Column]) -> Column:
        own = F.coalesce(indices, F.array().cast("array<int>"))
        return _with_lookup(items, lambda find: F.transform(own, lambda i: X.let(find(i), form)))

    def body(p: Column) -> Column:
        return F.when(~X.is_heading(p["style"]), X.format_paragraph(p))

    notes = X.clean_text(slide["notes_text"])
    parts = F.concat(pick(doc["paragraphs"], slide["paragraph_indices"], body), pick(doc["tables"], slide["table_indices"], X.format_table), F.array(F.when(notes != "", F.concat(F.lit("Notes: "), notes))))
    return F.filter(parts, lambda x: x.isNotNull() & (x != ""))


def chunk_slides(doc: Column, profile: str = "chunking", *, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> Column:
    """A chunk for each slide, split if over the limit; `chunking` merges short ones, across slides too."""
    most, least = limits(max_chars, min_chars)
    chunks = F.flatten(F.transform(doc["slides"], lambda s: split_unit(slide_parts(doc, s), accumulate=profile == "chunking", most=most)))
    return merge_short(chunks, least=least, ceiling=most + least) if profile == "chunking" else chunks
