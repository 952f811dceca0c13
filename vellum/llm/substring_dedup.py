"""Removal of long word passages that occur more than once anywhere in a corpus, by difference-cover anchors.

A window of `window` words is repeated if its word sequence also starts at another place, in any text.  Every word
inside a repeated window goes.  How the repeated windows are found:

1. A difference cover modulo `period` holds two places for every shift: whatever the offset between two equal
   windows, some pair of covered places is aligned in both.  So only the `window - period + 1` words at covered
   places are hashed, about a quarter of all places, and an anchor that occurs twice is kept: equal ones stream past
   in sorted order.
2. Anchors extend to the windows around them: a window without a repeated anchor cannot be repeated and is never
   looked at again.  While the kept anchors are few, they reach the executors as a bitmap of bounded size; a false hit
   there only adds a candidate.  Beyond MAX_ANCHORS the covered places of all texts meet the kept anchors in a join on
   the hash instead, and come back to their texts by row key.  The results are the same.
3. Candidate windows are compared by hash over the corpus.  Each task first merges its own equal windows, so that
   a passage in a third of all texts gives one row per task and not one per text.
4. The repeated ranges meet their texts again by row key, and the words are removed.

No pair of texts is ever formed, nothing is capped, and no group is held in memory: equal windows stream past in
sorted order.  Hashes have 64 bits: among n compared windows about n * n / 2 ** 65 unequal pairs are taken as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import kernels as K
from vellum.llm import store

#: A perfect difference set modulo 21 (every shift is the difference of two members).
PERIOD = 21
COVER = (0, 1, 4, 14, 16)

#: Repeated anchors that go to the executors as a bitmap: 16 bits each, so 32 MB.  More are joined.
MAX_ANCHORS = 1 << 24
#: Windows that a task holds before it merges equal ones and hands them on.
MERGE_ROWS = 2_000_000
#: Rows handed on at once: the JVM holds a whole batch outside its heap, in a buffer of up to twice its bytes.
OUT_ROWS = 1 << 16

_U64 = np.uint64


def is_difference_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def row_key(*columns: Column) -> Column:
    """Rows with the same values share a key; they get the same result."""
    return F.xxhash64(*columns)


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h >> _U64(64 - bits), (h & _U64(0xFFFFFFFF)) & _U64((1 << bits) - 1)


def _anchors(words: K.Words, h: np.ndarray, size: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Covered places and the hashes of the `size` words from there."""
    g = K.window_hashes(h, size)
    if not len(g):
        return np.zeros(0, np.int64), g
    place = np.arange(len(words)) - np.repeat(words.first[:-1], words.count)
    on = np.zeros(period, bool)
    on[list(cover)] = True
    at = np.flatnonzero(on[place[: len(g)] % period] & K.within(words, size))
    return at, g[at]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, OUT_ROWS):
        yield batch.slice(a, OUT_ROWS)


def _task_anchors(size: int, period: int, cover: tuple[int, ...]):
    """The anchors of a task: once, or twice those that it has more often."""

    def merged(found: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(found), return_counts=True)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(h, np.minimum(n, 2)).view(np.int64))], ["h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            for _, _, buf, off in K.text_chunks(batch.column(0)):
                words = K.Words(buf, off, K.NOT_BLANK)
                found.append(_anchors(words, words.hashes(), size, period, cover)[1])
            if sum(map(len, found)) >= MERGE_ROWS:
                yield from _slices(merged(found))
        if found:
            yield from _slices(merged(found))

    return count


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of h: each h that more than one row has, once."""
    last = told = np.zeros(0, np.int64)
    for batch in batches:
        h = np.concatenate([last, batch.column(0).to_numpy()])
        again = np.unique(h[1:][h[1:] == h[:-1]])
        if len(again):
            fresh = again[1:] if len(told) and told[0] == again[0] else again
            told = again[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(fresh)], ["h"])
        last = h[-1:].copy()


def _bitmap(repeated: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Two bits for each of n repeated anchors, in a bitmap of 16 to 32 bits an anchor."""
    bits = max(16, int(16 * max(n, 1) - 1).bit_length())
    two = F.explode(F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit(0xFFFFFFFF & ((1 << bits) - 1)))))
    words = (
        repeated.select(two.alias("b"))
        .groupBy(F.shiftright("b", 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
        .toArrow()
    )
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[words["w"].to_numpy()] = words["v"].to_numpy()
    return bitmap.view(_U64), bits


def _anchor_places(size: int, period: int, cover: tuple[int, ...]):
    """(h, key, place) of every covered place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, buf, off in K.text_chunks(batch.column(0)):
                words = K.Words(buf, off, K.NOT_BLANK)
                at, g = _anchors(words, words.hashes(), size, period, cover)
                doc = words.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(keys[a:b][doc]), pa.array((at - words.first[doc]).astype(np.int64))], ["h", "key", "place"])

    return work


def _merged(h: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """(h, key, span, kind) rows: a window that the task has once (0); with no key, one that it has more often (1);
    and, under a hash that spreads them, ranges of windows already known to be repeated (2)."""
    order = np.argsort(h, kind="stable")
    own_h, own_key, own_place = h, key, place
    h, key, place = h[order], key[order], place[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    many = same[:-1] | same[1:]
    first = many & ~same[:-1]
    # In the order of the texts, where keys repeat and compress well.
    once = np.sort(order[~many])
    k, p = key[many], place[many]
    order = np.lexsort((p, k))
    k, p = k[order], p[order]
    # Equal rows of a table share key and places; one range for both is enough.
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    k, p = k[fresh], p[fresh]
    begin = np.ones(len(k), bool)
    begin[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)
    start = np.flatnonzero(begin)
    last = np.append(start[1:], len(k)) - 1 if len(k) else start
    spread = K.mix64(k[start].view(_U64) + p[start].astype(_U64)).view(np.int64)
    n_once, n_first, n_runs = len(once), int(first.sum()), len(start)
    hs = np.concatenate([own_h[once].view(np.int64), h[first].view(np.int64), spread])
    keys = np.concatenate([own_key[once], np.zeros(n_first, np.int64), k[start]])
    spans = np.concatenate([own_place[once] << 32 | 1, np.zeros(n_first, np.int64), p[start] << 32 | (p[last] - p[start] + 1)])
    kind = np.concatenate([np.zeros(n_once, np.int8), np.ones(n_first, np.int8), np.full(n_runs, 2, np.int8)])
    return pa.RecordBatch.from_arrays([pa.array(hs), pa.array(keys), pa.array(spans), pa.array(kind)], ["h", "key", "span", "kind"])


class _Windows:
    """The windows of a task around repeated anchors; equal ones are merged before they are handed on."""

    def __init__(self, window: int, size: int):
        self.window, self.reach, self.held = window, window - size, []

    def add(self, words: K.Words, h: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
        """The windows that hold an anchor at one of the places `at`; keys are those of the texts."""
        if not len(at):
            return
        # Windows around an anchor start up to `reach` words before it, in the same text.
        near = K.covered(len(words), np.maximum(at - self.reach, 0), self.reach + 1)
        near = np.flatnonzero(near[: max(0, len(words) - self.window + 1)] & K.within(words, self.window))
        if len(near):
            doc = words.doc[near]
            self.held.append((K.window_hashes(h, self.window)[near], keys[doc], (near - words.first[doc]).astype(np.int64)))

    def hand_on(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.held and sum(len(x[0]) for x in self.held) >= least:
            held = [np.concatenate(part) for part in zip(*self.held, strict=True)]
            self.held = []
            merged = _merged(*held)
            del held
            yield from _slices(merged)


_CANDIDATES = "h long, key long, span long, kind byte"


def _candidates(bitmap, bits: int, window: int, size: int, period: int, cover: tuple[int, ...]):
    """The windows of the texts around anchors that the bitmap has."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, found = bitmap.value, _Windows(window, size)
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, buf, off in K.text_chunks(batch.column(0)):
                words = K.Words(buf, off, K.NOT_BLANK)
                h = words.hashes()
                at, g = _anchors(words, h, size, period, cover)
                hit = np.ones(len(g), bool)
                for probe in _probes(g, bits):
                    hit &= (have[probe >> _U64(6)] >> (probe & _U64(63))) & _U64(1) == 1
                found.add(words, h, at[hit], keys[a:b])
            yield from found.hand_on(MERGE_ROWS)
        yield from found.hand_on(1)

    return find


def _candidates_of_places(window: int, size: int):
    """From rows in order of key, places of anchors before texts: the windows around them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Windows(window, size)
        for key, text, _, places in _by_key(batches, "place"):
            if places:
                words = K.Words(*K.text_buffer(pa.array([text], pa.large_string())), K.NOT_BLANK)
                # A place is its text's own word number.
                found.add(words, words.hashes(), np.unique(np.concatenate(places)), np.array([key]))
                yield from found.hand_on(MERGE_ROWS)
        yield from found.hand_on(1)

    return find


def _by_key(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple]:
    """(key, text, doc_id, parts) for each text of rows in order of key, numbers before texts; parts are arrays of the
    numbers in `column` that came under the text's key."""
    now, parts = None, []

    def take(a: int, b: int, key: int) -> None:
        nonlocal now, parts
        if key != now:
            now, parts = key, []
        for x, y in _pieces(keys, a, b, key):
            parts.append(numbers[x:y].astype(np.int64))

    for batch in batches:
        keys, numbers = batch.column("key").to_numpy(), batch.column(column).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(batch.column("is_text").to_numpy(zero_copy_only=False))
        texts, ids = batch.column("text").take(pa.array(at)), batch.column("doc_id").take(pa.array(at))
        done = 0
        for j, i in enumerate(at.tolist()):
            take(done, i, keys[i])
            done = i + 1
            yield int(keys[i]), texts[j].as_py() or "", ids[j].as_py(), parts
        if done < len(keys):
            take(done, len(keys), keys[-1])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of h: the spans whose window another row has too, and the ranges known before."""

    def out(key, span):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(span)], ["key", "span"])

    last_h, pending = None, None  # the last row, if it waits for the next one's hash
    for batch in batches:
        h, key, span, kind = (c.to_numpy() for c in batch.columns)
        if kind.any():
            done = kind == 2
            if done.any():
                yield out(key[done], span[done])
                h, key, span, kind = h[~done], key[~done], span[~done], kind[~done]
        if not len(h):
            continue
        same = h[1:] == h[:-1]
        before, after = np.zeros(len(h), bool), np.zeros(len(h), bool)
        before[1:], after[:-1] = same, same
        before[0] = last_h is not None and h[0] == last_h
        if pending is not None and before[0]:
            yield out(*pending)
        take = (before | after) & (kind == 0)
        yield out(key[take], span[take])
        last_h = h[-1]
        pending = (key[-1:], span[-1:]) if kind[-1] == 0 and not take[-1] else None


_RESULT = "doc_id long, key long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _remove(window: int, with_text: bool):
    """From rows in order of key, spans before texts: each text without the words of its spans."""
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for key, text, doc, spans in _by_key(batches, "span"):
            words = text.encode("utf-8", "surrogatepass").split()
            gone = []
            if spans:
                p = np.concatenate(spans)
                hit = np.zeros(len(words) + 1, np.int32)
                np.add.at(hit, p >> 32, 1)
                np.add.at(hit, np.minimum((p >> 32) + (p & 0xFFFFFFFF) + window - 1, len(words)), -1)
                start, end = K.runs(np.cumsum(hit[:-1]) > 0)
                gone = list(zip(start.tolist(), end.tolist(), strict=True))
            kept, last = [], 0
            for s, e in gone:
                kept += words[last:s]
                last = e
            kept += words[last:]
            line = b" ".join(kept)
            rows.append((doc, key, len(words), len(words) - len(kept), line.decode() if with_text else None, hashlib.sha256(line).hexdigest(), [{"start": s, "end": e} for s, e in gone]))
            size += len(line) if with_text else 1000
            if size >= K.CHUNK_BYTES:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), span_type]
        names = ["doc_id", "key", "n_words", "n_removed", "kept_text", "kept_sha256", "spans"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return strip


def _pieces(keys: np.ndarray, a: int, b: int, key: int) -> list[tuple[int, int]]:
    """The part of rows a to b that has this key (rows are in order of key)."""
    a += int(np.searchsorted(keys[a:b], key))
    return [(a, b)] if a < b else []


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = 35, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = True, max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """Each text without the words that lie in a repeated window of `window` words.

    Returns one row per input row: doc_id, key, n_words, n_removed, kept_text (words joined by one space; null unless
    `with_text`), kept_sha256 and the removed ranges of words.  Only `doc_id` and `text` are read, so other columns
    may have any name.  A null text has no words.  Texts shorter than the window stay whole.  All occurrences of a
    repeated passage go, the first one too, and rows that repeat a whole text of at least `window` words lose all of
    it.  Equal rows get equal results; an empty table gives an empty result.  `max_anchors` decides how candidates are
    found (see above), not which.
    """
    if not 1 <= period < window or not is_difference_cover(cover, period):
        raise ValueError("cover must be a difference cover modulo period, and period less than window")
    spark = docs.sparkSession
    store.prepare(spark)
    size = window - period + 1
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id")).withColumn("key", row_key("doc_id", "text"))
    n = store.partitions(spark, docs)
    # Tasks have merged their own; a hash table of what is left, nearly all of it different, would save nothing.
    anchors = rows.select("text").mapInArrow(_task_anchors(size, period, cover), "h long")
    repeated = anchors.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_repeated, "h long")
    # Few rows remain: few files, whatever the number of tasks.  A local file system starts a process for each file.
    repeated = store.keep(repeated.hint("rebalance", "h"), "anchors")
    known = repeated.count()
    if known <= max_anchors:
        bitmap, bits = _bitmap(repeated, known)
        shared = spark.sparkContext.broadcast(bitmap)
        found = rows.select("text", "key").mapInArrow(_candidates(shared, bits, window, size, period, cover), _CANDIDATES)
    else:
        places = rows.select("text", "key").mapInArrow(_anchor_places(size, period, cover), "h long, key long, place long")
        # Merged, never broadcast.  An anchor that very many texts share is split over tasks by adaptive execution.
        places = places.hint("merge").join(repeated, "h", "left_semi").select("key", "place").distinct()
        found = _with_texts(places, "place", rows, n).mapInArrow(_candidates_of_places(window, size), _CANDIDATES)
    spans = found.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_mark, "key long, span long")
    return _with_texts(spans, "span", rows, n).mapInArrow(_remove(window, with_text), _RESULT)


def _with_texts(numbers: DataFrame, column: str, rows: DataFrame, n: int) -> DataFrame:
    """(key, column) and the texts, in order of key, numbers before texts."""
    none = {"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long"), "is_text": F.lit(False)}
    both = numbers.withColumns(none).unionByName(rows.withColumns({column: F.lit(None).cast("long"), "is_text": F.lit(True)}))
    return both.repartition(n, "key").sortWithinPartitions("key", "is_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.read(spark, sf_dir, "documents")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), win AS (
  SELECT doc_id, s, md5(array_to_string(ws[s : s + 34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35)
), hot AS (
  SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM win WHERE h IN (SELECT h FROM hot)
), kept AS (
  SELECT t.doc_id, t.p, t.word FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) t
  ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.p = gone.p
), joined AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS line, count(*) AS n FROM kept GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM w LEFT JOIN joined USING (doc_id)
"""
