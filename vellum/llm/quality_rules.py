"""Quality rules: counts that reject broken texts, and a likelihood ratio against a trusted target.

Texts are cut into n-grams of bytes, hashed into a fixed number of buckets.  One multinomial is counted over the
trusted texts and one over the whole raw corpus; a text's score is the mean over its n-grams of the difference of the
two log-probabilities.  Every text is judged by the same threshold, without sampling.  Both counts take in all rows:
each task adds up its own buckets, and the sums, a table of fixed size, go back to every task.
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

#: Bytes in an n-gram, and buckets (a power of two).
ORDER = 4
BUCKETS = 1 << 16
#: The least mean log-likelihood ratio of a kept text.  Zero is a text as likely in the target as in the corpus; the
#: margin below it keeps good texts whose n-grams a small target happens to lack.
THRESHOLD = -0.4
MIN_WORDS = 50
#: Ids of trusted texts go to every task if they take up to this many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 32_000_000

_SYMBOL = K.byte_class(b"#*$%&|<>")


def grams(buf: np.ndarray, off: np.ndarray, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram at each place, and the places where n-grams of each text begin and end."""
    n = max(0, len(buf) - order + 1)
    x = np.zeros(n, np.uint32)
    for i in range(order):
        x *= np.uint32(0x01000193)
        x ^= buf[i : n + i].astype(np.uint32) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x &= np.uint32(buckets - 1)
    ends = np.maximum(off[1:] - order + 1, off[:-1])
    return x, np.stack([np.minimum(off[:-1], n), np.minimum(ends, n)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, buf, off in K.text_chunks(batch.column(0)):
            x, (begin, end) = grams(buf, off)
            inside = np.zeros(len(x) + 1, np.int64)
            for mask, sums in ((np.ones(b - a, bool), raw), (trusted[a:b], target)):
                inside[:] = 0
                np.add.at(inside, begin[mask], 1)
                np.add.at(inside, end[mask], -1)
                sums += np.bincount(x[np.cumsum(inside[:-1]) > 0], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def log_ratios(counts: pa.Table) -> np.ndarray:
    """Log-probability in the target less that in the corpus, by bucket, each with one added to every count."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts["bucket"].to_numpy()
    raw[at], target[at] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _mark_trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, trusted) of every row."""
    ids = store.keep(trusted.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct(), "trusted")
    if ids.count() * 16 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return docs.join(ids, docs.doc_id == ids.id, "left").select("text", F.col("id").isNotNull().alias("trusted"))


_METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for some texts."""
    words = K.Words(buf, off, K.NOT_BLANK)
    n = len(off) - 1

    def per_text(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[at[1:]] - total[at[:-1]]

    repeat = np.zeros(len(words), bool)
    grams3 = K.window_hashes(words.hashes(), 3)
    at = np.flatnonzero(K.within(words, 3))
    if len(at):
        key = K.mix64(grams3[at] + (words.doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        repeat = K.covered(len(words), at[twice], 3)
    raw = buf.tobytes()
    dup = np.zeros(n, np.int64)
    for d in range(n):
        lines = [x for x in raw[off[d] : off[d + 1]].split(b"\n") if x.strip()]
        dup[d] = len(lines) - len(set(lines))
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": per_text(words.inside & ((buf & 0xC0) != 0x80), off),
        "n_symbols": per_text(_SYMBOL[buf], off),
        "n_dup_lines": dup,
        "n_repeat_words": per_text(repeat, words.first),
    }


def _judge(ratios, threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratios.value
        for batch in batches:
            parts: dict[str, list] = {m: [np.zeros(0, np.int64)] for m in _METRICS}
            scores = [np.zeros(0)]
            for _, _, buf, off in K.text_chunks(batch.column(0)):
                for m, v in measure(buf, off).items():
                    parts[m].append(v)
                x, (begin, end) = grams(buf, off)
                total = np.concatenate([[0.0], np.cumsum(table[x])])
                scores.append((total[end] - total[begin]) / np.maximum(end - begin, 1))
            m = {k: np.concatenate(v).astype(np.int64) for k, v in parts.items()}
            score = np.concatenate(scores)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            cols = [batch.column(1), *(pa.array(m[k]) for k in _METRICS), pa.array(score), pa.array(failed), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays(cols, ["row", *_METRICS, "score", "base_failed", "kept"])

    return work


def assess(docs: DataFrame, trusted: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: `row` (a struct of all its columns), the base counts, score, base_failed and kept.

    `trusted` names the doc_ids of the target's texts.  Words lie between blanks.  A text fails the base rules with
    fewer than 50 words, or if over half its words lie in three-word windows found twice or more in it; others are
    kept if their score reaches `threshold`.  A null or empty text has zero counts, score 0, and fails.  Without any
    trusted text every score is 0 and the base rules decide.  Repeated rows count, and are judged, each for itself.
    Other columns of any name pass through inside `row`.
    """
    spark = docs.sparkSession
    store.prepare(spark)
    plain = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    marked = _mark_trusted(plain, trusted)
    counts = marked.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    ratios = spark.sparkContext.broadcast(log_ratios(counts.toArrow()))
    rows = docs.select(F.col(text).cast("string"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    schema = T.StructType(
        [T.StructField("row", rows.schema[1].dataType), *(T.StructField(m, T.LongType()) for m in _METRICS), T.StructField("score", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    )
    return rows.mapInArrow(_judge(ratios, threshold), schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids that labels call good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(store.read(spark, sf_dir, "documents"), trusted_ids(store.read(spark, sf_dir, "labels")))
    return out.select("row.doc_id", *_METRICS, "base_failed", "kept", "score")
