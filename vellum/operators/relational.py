"""Relational operators that document processing needs by name.

All work on any number of documents at once: `doc` columns partition, nothing is collected, and ties are settled by
explicit positions, never by the order in which rows happen to arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def keep_last(items: DataFrame, key: Names, position: str) -> DataFrame:
    """One row per key: the last by position."""
    rest = [c for c in items.columns if c not in key]
    # An aggregate, so that tasks combine repeated keys before the shuffle.
    best = items.groupBy(*key).agg(F.max_by(F.struct(*rest), position).alias("_row"))
    return best.select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def keep_first(items: DataFrame, key: Names, position: str) -> DataFrame:
    """One row per key: the first by position."""
    rest = [c for c in items.columns if c not in key]
    best = items.groupBy(*key).agg(F.min_by(F.struct(*rest), position).alias("_row"))
    return best.select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def order_join(order: DataFrame, items: DataFrame, *, doc: str = "doc_id", position: str = "pos") -> DataFrame:
    """Order entries (doc, seq, type, index) with their items (doc, type, index, position, ...).

    Entries without an item are dropped; of items with one index the last counts.  The two are merged, never broadcast:
    items that come from arrays are far more than Spark estimates, and it would gather them on the driver."""
    key = [doc, "type", "index"]
    return order.join(keep_last(items, key, position).hint("merge"), key)


def first_mode(values: DataFrame, by: Names, value: str, position: str) -> DataFrame:
    """The most common value of each group; of equally common ones the one that comes first."""
    counts = values.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def top_distinct(values: DataFrame, by: Names, value: str, n: int) -> DataFrame:
    """The n largest distinct values of each group with their rank from 1."""
    ranked = values.select(*by, value).distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value))))
    return ranked.where(F.col("rank") <= n)


def heading_sizes(spans: DataFrame, body: DataFrame, by: Names, size: str, factor: float = 1.05, levels: int = 6) -> DataFrame:
    """(group, size, rank): the largest sizes that exceed the body's by the factor; rank 1 is the first heading level."""
    joined = spans.join(body.select(*by, F.col(size).alias("_body")), list(by))
    return top_distinct(joined.where(F.col(size) > F.col("_body") * factor), by, size, levels)


def _overlap(a: str, b: str) -> Column:
    side = lambda lo, hi: F.greatest(F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def outside_boxes(blocks: DataFrame, boxes: DataFrame, by: Names, threshold: float = 0.4, strict: bool = False) -> DataFrame:
    """The blocks (with x0, y0, x1, y1) of which no box of their group covers `threshold` of the area (or more than
    that, if `strict`).  An area counts as 1 at least."""
    a, b = blocks.alias("a"), boxes.alias("b")
    area = F.greatest((F.col("a.x1") - F.col("a.x0")) * (F.col("a.y1") - F.col("a.y0")), F.lit(1.0))
    part = _overlap("a", "b") / area
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
    hit = part > threshold if strict else part >= threshold
    on = hit
    for s in same:
        on = on & s
    return a.join(b, on, "left_anti")


def islands(rows: DataFrame, by: Names, position: str, keys: Names) -> DataFrame:
    """Adds `island`: the number, from 0, of the run of neighbours with equal keys (nulls are equal) in its group."""
    w = Window.partitionBy(*by).orderBy(position)
    change = F.lit(False)
    for k in keys:
        change = change | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    first = F.row_number().over(w) == 1
    flagged = rows.withColumn("_new", F.when(first, 0).when(change, 1).otherwise(0))
    return flagged.withColumn("island", F.sum("_new").over(w)).drop("_new")


def merge_runs(rows: DataFrame, by: Names, position: str, keys: Names, text: str, separator: str = "") -> DataFrame:
    """Runs of neighbours with equal keys as one row, their texts joined in order."""
    grouped = islands(rows, by, position, keys).groupBy(*by, "island", *keys)
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    return grouped.agg(F.array_join(F.transform(parts, lambda x: x["t"]), separator).alias(text))


def running_index(rows: DataFrame, by: Names, position: Names, name: str = "index") -> DataFrame:
    """Numbers from 0 in each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*position)) - 1)


def sections(rows: DataFrame, by: Names, position: str, is_heading: str) -> DataFrame:
    """Adds `section`: how many headings there are up to and with this row."""
    w = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(F.col(is_heading).cast("int")).over(w))


def reading_order(paragraphs: DataFrame, tables: DataFrame, by: Names) -> DataFrame:
    """Paragraphs and tables (columns y, pos) of each page by height; paragraphs first where both are equal."""
    both = paragraphs.withColumns({"type": F.lit("paragraph"), "_kind": F.lit(0)}).unionByName(tables.withColumns({"type": F.lit("table"), "_kind": F.lit(1)}), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("y", "_kind", "pos")
    return both.withColumn("seq", F.row_number().over(w) - 1).drop("_kind")


def numbering_lookup(paragraphs: DataFrame, nums: DataFrame, levels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """paragraphs (num_id, level) -> nums (num_id, abstract_id) -> levels (abstract_id, level, format, text): adds
    numbering_format, `format:text`; null where a step finds nothing.  The first match counts."""
    first_num = keep_first(nums, [doc, "num_id"], "pos").select(doc, "num_id", "abstract_id")
    first_level = keep_first(levels, [doc, "abstract_id", "level"], "pos").select(doc, "abstract_id", "level", "format", "level_text")
    return (
        paragraphs.join(first_num, [doc, "num_id"], "left").join(first_level, [doc, "abstract_id", "level"], "left")
        .withColumn("numbering_format", F.when(F.col("format").isNotNull(), F.concat_ws(":", "format", F.coalesce("level_text", F.lit("")))))
        .drop("abstract_id", "format", "level_text")
    )
