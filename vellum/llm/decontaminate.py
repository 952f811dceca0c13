"""Benchmark decontamination by winnowing.

A window is `window` consecutive words of a benchmark item; an item of fewer words is one window.  Among the hashes
of all k-word grams of a text, winnowing keeps the least of every w consecutive ones.  With k + w - 1 equal to the
window's length, two texts that share a window keep a common fingerprint from inside it, so no shared window is
missed.  A document's fingerprints are looked up among the benchmark's, hits extend to the windows around them, and
those are compared word by word.

The benchmark is the query set: it goes to every task in blocks of bounded size, and no document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import kernels as K
from vellum.llm import store

#: UTF-8 bytes of benchmark text in one block; the index built from it takes some ten times as much.
BLOCK_BYTES = 8_000_000


def gram_sizes(window: int) -> tuple[int, int]:
    """k and w with k + w - 1 = window."""
    k = (window + 1) // 2
    return k, window - k + 1


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Which grams are the least of some w consecutive ones (of all, if there are fewer)."""
    n = len(grams)
    if n <= w:
        return grams == grams.min() if n else np.zeros(0, bool)
    least = np.lib.stride_tricks.sliding_window_view(grams, w).min(axis=1)
    # A gram is kept if some window that holds it has it as its least; no window's least exceeds it.
    padded = np.concatenate([np.repeat(least[:1], w - 1), least, np.repeat(least[-1:], w - 1)])
    return np.lib.stride_tricks.sliding_window_view(padded, w).max(axis=1) == grams


class Index:
    """Fingerprints and windows of some benchmark items."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        buf, off = K.text_buffer(pa.array(texts, pa.large_string()))
        self.ids = np.array(ids, dtype=object)
        self.words = words = K.Words(K.LOWER[buf], off, K.ALNUM)
        h = words.hashes()
        doc = words.doc
        self.sizes = []
        for size in range(1, window + 1):
            own = (words.count >= window) if size == window else (words.count == size)
            if not own.any():
                continue
            k, w = gram_sizes(size)
            grams = K.window_hashes(h, k)
            marks = [np.zeros(0, np.uint64)]
            for d in np.flatnonzero(own).tolist():
                part = grams[words.first[d] : words.first[d + 1] - k + 1]
                marks.append(part[winnow(part, w)])
            marks = np.concatenate(marks)
            full = K.window_hashes(h, size)
            at = np.flatnonzero(K.within(words, size) & own[doc][: len(full)])
            full = full[at]
            order = np.argsort(full, kind="stable")
            full, at = full[order], at[order]
            unique, first = np.unique(full, return_index=True)
            # For each distinct window: a place of it, and the items that have it.
            ends = np.append(first[1:], len(full))
            self.sizes.append((size, k, w, np.unique(marks), unique, at[first], first, ends, doc[at]))

    def same(self, words: K.Words, a: int, place: int, size: int) -> bool:
        return words.slice(a, a + size) == self.words.slice(place, place + size)

    def search(self, words: K.Words, h: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
        """Which words lie in an occurrence of a window, and the items of each text."""
        hit = np.zeros(len(words), bool)
        items: list[set[str]] = [set() for _ in words.count]
        doc = words.doc
        for size, k, w, marks, unique, place, first, ends, owner in self.sizes:
            grams = K.window_hashes(h, k)
            if not len(grams):
                continue
            kept = np.flatnonzero(winnow(grams, w) & K.within(words, k))
            found = kept[marks[np.minimum(np.searchsorted(marks, grams[kept]), len(marks) - 1)] == grams[kept]]
            if not len(found):
                continue
            near = K.covered(len(words), np.maximum(found - (size - k), 0), size - k + 1)
            full = K.window_hashes(h, size)
            near = np.flatnonzero(near[: len(full)] & K.within(words, size))
            at = np.minimum(np.searchsorted(unique, full[near]), len(unique) - 1)
            ok = unique[at] == full[near]
            near, at = near[ok], at[ok]
            ok = np.array([self.same(words, a, int(place[u]), size) for a, u in zip(near.tolist(), at.tolist(), strict=True)], dtype=bool)
            near, at = near[ok], at[ok]
            hit |= K.covered(len(words), near, size)
            pairs = np.unique(np.stack([doc[near], at]), axis=1)
            for d, u in zip(*pairs.tolist(), strict=True):
                items[d].update(self.ids[owner[first[u] : ends[u]]].tolist())
        return hit, items


_SPANS = "array<struct<start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _search(index, only_hits: bool, passed: tuple[str, ...]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = index.value
        for batch in batches:
            n_words, n_hit, spans, item_ids = [], [], [], []
            for _, _, buf, off in K.text_chunks(batch.column(0)):
                words = K.Words(K.LOWER[buf], off, K.ALNUM)
                hit, items = have.search(words, words.hashes())
                total = np.concatenate([[0], np.cumsum(hit)])
                n_words.append(words.count)
                n_hit.append(total[words.first[1:]] - total[words.first[:-1]])
                for d, own in enumerate(items):
                    a, b = words.first[d], words.first[d + 1]
                    start, end = K.runs(hit[a:b]) if own else ((), ())
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(start, end, strict=True)])
                    item_ids.append(sorted(own))
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passed), _longs(n_words), _longs(n_hit), pa.array(spans, _SPAN_TYPE), pa.array(item_ids, pa.list_(pa.string()))],
                [*passed, "n_words", "n_hit", "spans", "item_ids"],
            )
            if only_hits:
                out = out.filter(pa.array([bool(x) for x in item_ids], pa.bool_()))
            yield out

    return work


def _longs(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int64())


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, with_row: bool = False) -> DataFrame:
    """One row per document: doc_id, key, `row` (a struct of all columns, if `with_row`), n_words, n_hit, spans (hit
    ranges of words), item_ids (sorted) and contaminated.

    A-Z are lower-cased; words are runs of digits, letters a to z and characters outside ASCII.  A document word is
    hit if it lies in an occurrence of a window.  A null text has no words and an item without words no window; an
    empty benchmark hits nothing.  Items with equal texts are all listed, an item_id once, a null id as "null".
    Repeated documents get equal results.  Only the named columns are read.  A benchmark of more than `block_bytes`
    is searched block by block and the hits of the blocks are joined.
    """
    spark = docs.sparkSession
    store.prepare(spark)
    whole = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if with_row else []
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"), *whole).withColumn("key", F.xxhash64("doc_id", "text"))
    passed = tuple(c for c in rows.columns if c != "text")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1

    schema = T.StructType([rows.schema[c] for c in passed])
    span = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
    for name, kind in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("spans", T.ArrayType(span)), ("item_ids", T.ArrayType(T.StringType()))):
        schema = schema.add(name, kind)

    def found(number: int) -> DataFrame:
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        got = own.toArrow()
        index = spark.sparkContext.broadcast(Index(got["item_id"].to_pylist(), got["text"].to_pylist(), window))
        return rows.mapInArrow(_search(index, blocks > 1, passed), schema)

    if blocks == 1:
        out = found(0)
    else:
        hits = None
        for number in range(blocks):
            part = store.keep(found(number).select("key", "spans", "item_ids").distinct(), "hits")
            hits = part if hits is None else hits.unionByName(part)
        words = F.flatten(F.transform("all", lambda s: F.flatten(F.transform(s, lambda x: F.sequence(x["start"], x["end"] - 1)))))
        merged = (
            hits.groupBy("key")
            .agg(F.collect_list("spans").alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
            .select("key", "item_ids", F.array_sort(F.array_distinct(words)).alias("w"))
            .select("key", "item_ids", F.size("w").cast("long").alias("n_hit"), _ranges(F.col("w")).alias("spans"))
        )
        none = spark.sparkContext.broadcast(Index([], [], window))
        base = rows.mapInArrow(_search(none, False, passed), schema).select(*passed, "n_words")
        out = base.join(store.keep(merged, "merged"), "key", "left").select(
            *passed, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
        )
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _ranges(w):
    """Sorted places as ranges of consecutive ones."""
    starts = F.filter(w, lambda x, i: (i == 0) | (F.get(w, i - 1) != x - 1))
    ends = F.filter(w, lambda x, i: (i == F.size(w) - 1) | (F.get(w, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(store.read(spark, sf_dir, "documents"), store.read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[s : s + m - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT m FROM bw
), dw AS (
  SELECT doc_id, m, s, array_to_string(ws[s : s + m - 1], ' ') AS win
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS s FROM d, sizes WHERE len(ws) >= m)
), hits AS (
  SELECT doc_id, dw.m, s, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM hits)) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
