"""SimHash fingerprints of word shingles, and the groups of texts whose fingerprints differ in few bits.

Candidates come by pigeonring filtering.  The 64 bits are a ring of 8 segments.  If two fingerprints differ in at
most 3 bits, some segment starts a chain along which the differences counted so far never exceed the proportional
budget, 3 / 8 a segment: none in the first two segments, at most one in the first five, and so on round the ring.
So 16 bits are equal exactly, and of the next 24, which hold at most one difference, one half is equal too: a join
key of 28 bits, at 8 starts and 2 halves.  Pairs in a bucket pass the chain's budgets before their full distance is
counted.

Buckets hold distinct fingerprints only.  One with over BUCKET of them (a large group of near copies) is split again
by the same argument: of four parts of its free bits one must be equal.  Each split leaves fewer free bits, so after
at most four splits no bucket can be larger.  A bucket yields a spanning forest of its links, never its pairs.

Three bits of 64 mean all but equal texts.  Texts of which four shingles in five are the same differ in some ten bits,
and no exact keys of useful length are left on a ring with such a budget.  `similar_texts` therefore also takes SimHash
fingerprints of samples: of a text's shingles those in one of BANDS bands of the hash, and of these the SAMPLE least,
which similar texts share in some band or other.  Texts with an equal sample are candidates, by the distance of the
whole texts' fingerprints and then by the Jaccard similarity of their shingles.  First each is held against CENTRES
texts of its bucket (those with the least hash), which joins large groups of near copies without their pairs.  Then all
other pairs of a bucket follow, but for those that are joined by then: in blocks of at most BUCKET texts, whose tasks
compare the shingles themselves and return a forest of links, never pairs.  The same is done for what pigeonring links,
as a forest that holds by distance need not hold by similarity.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import kernels as K
from vellum.llm import store
from vellum.llm.components import components

SEGMENTS = 8
WIDTH = 64 // SEGMENTS
#: Distinct fingerprints compared with each other in one task; more are split by further bits.
BUCKET = 2048
#: Samples of a text: a power of two.  At similarity 0.8 all samples miss with a probability of 0.5 ** 7 * 0.49 = 0.004.
BANDS = 8
#: Shingles in a sample.
SAMPLE = 3
#: Texts of a bucket that all others are held against first.
CENTRES = 3
#: Bytes of a row that is dealt out to be held against others, besides its shingles: four ints, four longs, a length.
_DEALT_BYTES = 56

_U64 = np.uint64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segments(start: int, count: int) -> int:
    """The bits of `count` segments round the ring from `start`."""
    return sum(((1 << WIDTH) - 1) << ((start + i) % SEGMENTS * WIDTH) for i in range(count))


def _half(start: int, first: int, count: int, which: int) -> int:
    """One half of the bits of `count` segments that follow the first `first` ones from `start`."""
    bits = [((start + first) * WIDTH + i) % 64 for i in range(count * WIDTH)]
    n = len(bits) // 2
    return sum(1 << b for b in (bits[n:] if which else bits[:n]))


def level_masks() -> list[tuple[int, int]]:
    """(start of the chain, bits that must be equal) of the first join."""
    return [(s, _segments(s, 2) | _half(s, 2, 3, w)) for s in range(SEGMENTS) for w in (0, 1)]


def split_mask(mask: int, parts: int) -> list[int]:
    """`mask` with each of `parts` parts of its free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _fingerprints(size: int, seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, _U64)
            for a, b, buf, off in K.text_chunks(batch.column(0), K.CHUNK_BYTES // 4):
                words = K.Words(K.LOWER[buf], off, K.NOT_BLANK)
                n = len(words)
                if not n:
                    continue
                length = words.end - words.start
                line = np.full(int(length.sum()) + n, 0x20, np.uint8)
                line[np.arange(int(length.sum())) + np.repeat(np.arange(n), length)] = words.buf[words.inside]
                raw = line.tobytes()
                begin = np.cumsum(length + 1) - length - 1
                end = begin + length
                # A text with fewer words than a shingle has one shingle of all of them.
                shingles = np.where(words.count >= size, words.count - size + 1, np.minimum(words.count, 1))
                doc = np.repeat(np.arange(len(shingles)), shingles)
                first = np.cumsum(shingles) - shingles
                at = words.first[:-1][doc] + np.arange(len(doc)) - first[doc]
                last = at + np.minimum(size, words.count[doc]) - 1
                h = np.array([hashed(raw[x:y], seed) for x, y in zip(begin[at].tolist(), end[last].tolist(), strict=True)], dtype=_U64)
                some = shingles > 0
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, first[some], axis=0, dtype=np.int32)
                part = np.zeros(b - a, _U64)
                part[some] = np.packbits(2 * ones > shingles[some][:, None], axis=1, bitorder="little").view(_U64).ravel()
                out[a:b] = part
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return work


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row: a bit is set if over half of the shingles' hashes have it."""
    store.prepare(docs.sparkSession)
    return docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id")).mapInArrow(_fingerprints(size, seed), "doc_id long, fp long")


def _forest(fps: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) links that join what pairs within the distance join, one for each but the roots."""
    n = len(fps)
    near = np.zeros((n, n), bool)
    for a in range(0, n, 256):
        near[a : a + 256] = _linked(fps[a : a + 256, None], fps[None, :], start, distance)
    free, child, root = np.ones(n, bool), [], []
    for i in range(n):
        if not free[i]:
            continue
        free[i] = False
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & free)
            free[front] = False
            child.append(front)
            root.append(np.full(len(front), i))
    return fps[np.concatenate(child)], fps[np.concatenate(root)]


def _linked(x: np.ndarray, y: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Whether pairs pass the budgets of the chain from `start`, then the full distance."""
    differ = x ^ y
    ok = np.ones(differ.shape, bool)
    for count in range(1, SEGMENTS):
        budget = distance * count // SEGMENTS
        ok &= np.bitwise_count(differ & _U64(_segments(start, count))) <= budget
        if not ok.any():
            return ok
    return ok & (np.bitwise_count(differ) <= distance)


def _links(distance: int):
    """From rows in order of bucket: a spanning forest of each bucket's links."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            out, rest = groups(cols, False)
            yield out
        if rest is not None:
            yield groups(rest, True)[0]

    def groups(cols, over):
        start, mask, val, fp = cols
        n = len(fp)
        new = np.ones(n, bool)
        new[1:] = (start[1:] != start[:-1]) | (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])
        begin = np.flatnonzero(new)
        if not over:
            keep = [c[begin[-1] :] for c in cols] if n else None
            begin, n = begin[:-1], begin[-1] if n else 0
        else:
            keep = None
        size = np.diff(np.append(begin, n))
        fp = fp.view(_U64)
        a, b = [np.zeros(0, _U64)], [np.zeros(0, _U64)]
        two = begin[size == 2]
        for s in range(SEGMENTS):
            own = two[start[two] == s]
            ok = _linked(fp[own], fp[own + 1], s, distance)
            a.append(fp[own][ok])
            b.append(fp[own + 1][ok])
        for i, g in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = _forest(fp[i : i + g], int(start[i]), distance)
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"]), keep

    return work


def links(distinct: DataFrame, *, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at `distance` or less that join what all such pairs join."""
    if not 0 <= distance <= 3:
        raise ValueError("the join keys hold for a distance of at most 3")
    n = store.partitions(distinct.sparkSession, distinct, 2 * SEGMENTS)
    keys = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("start"), F.lit(_signed(m)).alias("mask")) for s, m in level_masks()]))
    rows = distinct.select("fp", keys.alias("k")).select(F.col("k.start").alias("start"), F.col("k.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("val"), "fp")
    found = []
    by = ["start", "mask", "val"]
    while True:
        sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
        # Eleven free bits tell at most 2048 fingerprints apart: such a bucket is small enough as it is.
        hot = store.keep(sizes.where((F.col("n") > bucket) & (F.bit_count("mask") < 64 - 11)).drop("n"), "buckets")
        some = not hot.isEmpty()
        cold = rows.join(hot, by, "left_anti") if some else rows
        found.append(store.keep(cold.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(_links(distance), "a long, b long").distinct(), "links"))
        if not some:
            break
        # At most four times as many masks as before: a table of a fixed size for each level.
        masks = [r.mask for r in hot.select("mask").distinct().collect()]
        parts = distance + 1
        table = [(m, _signed(x)) for m in masks for x in split_mask(m % (1 << 64), parts)]
        children = distinct.sparkSession.createDataFrame(table, "mask long, child long")
        rows = store.keep(
            rows.join(hot, by, "left_semi")
            .join(F.broadcast(children), "mask")
            .select("start", F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("val"), "fp"),
            "rows",
        )
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = 3, seed: int = 42, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id and the fingerprint as a long.

    A-Z are lower-cased, words lie between blanks, shingles are `size` words joined by a space (fewer words: all of
    them).  A null or empty text has no shingle; its fingerprint is zero and is linked like any other.  Rows are
    linked if their fingerprints differ in at most `distance` bits; component_id is the least doc_id that can be
    reached (null ids do not count; null if a component has no other).  Repeated rows give repeated results, an empty
    table an empty result.  Only `text` and `doc_id` are read.
    """
    fps = store.keep(fingerprints(docs, text=text, doc_id=doc_id, size=size, seed=seed), "fingerprints")
    distinct = store.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return _grouped(fps, distinct, links(distinct.select("fp"), distance=distance, bucket=bucket))


def _grouped(fps: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """What near_duplicates returns, from (doc_id, fp), (fp, least id) and the links between fingerprints."""
    roots = components(found)
    rooted = store.keep(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    least = store.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    # Tables on both sides of each join: a large component or a common fingerprint can be split over tasks.
    member = store.keep(rooted.join(least, "root").select("fp", "component_id"), "members")
    return fps.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def _shingles(words: K.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle, in order; a text of fewer words has one shingle of all of them."""
    h, doc = words.hashes(), words.doc
    whole = np.flatnonzero(K.within(words, size))
    owner, value = [doc[whole]], [K.window_hashes(h, size)[whole]]
    for k in range(1, size):
        some = np.flatnonzero(words.count == k)
        if len(some):
            owner.append(some)
            value.append(K.window_hashes(h, k)[words.first[some]])
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[fresh], value[fresh]


def _sketches(size: int):
    """(doc_id, fp, n, samples): the fingerprint and number of a text's shingles, and the fingerprints of its samples."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, count = np.zeros(batch.num_rows, _U64), np.zeros(batch.num_rows, np.int64)
            samples, sizes = [np.zeros(0, _U64)], [np.zeros(0, np.int64)]
            for a, b, buf, off in K.text_chunks(batch.column(0), K.CHUNK_BYTES // 4):
                owner, value = _shingles(K.Words(K.LOWER[buf], off, K.NOT_BLANK), size)
                count[a:b] = np.bincount(owner, minlength=b - a)
                own = np.zeros(b - a, np.int64)
                if len(owner):
                    # Values are in order in each text, and so are the bands, their upper bits.
                    band = owner << 8 | (value >> _U64(64 - BANDS.bit_length() + 1)).astype(np.int64)
                    first = np.flatnonzero(np.diff(band, prepend=-1))
                    least = np.arange(len(band)) - np.repeat(first, np.diff(np.append(first, len(band)))) < SAMPLE
                    own = np.bincount(owner[first], minlength=b - a)
                    samples.append(_majority(K.mix64(value[least] + _U64(1)), np.flatnonzero(np.diff(band[least], prepend=-1))))
                    text = np.flatnonzero(np.diff(owner, prepend=-1))
                    fp[a:b][owner[text]] = _majority(value, text)
                sizes.append(own)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(samples).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(fp.view(np.int64)), pa.array(count), lists], ["doc_id", "fp", "n", "samples"])

    return work


def _majority(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: the bits that over half of them have."""
    bits = np.unpackbits(value.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    n = np.diff(np.append(first, len(value)))
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(_U64).ravel()


def _sets(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in K.text_chunks(batch.column(0)):
                owner, value = _shingles(K.Words(K.LOWER[buf], off, K.NOT_BLANK), size)
                ends = pa.array(np.searchsorted(owner, np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(value.view(np.int64)))], ["node", "shingles"])

    return work


def widest(similarity: float) -> int:
    """Bits in which the fingerprints of texts of at least this Jaccard similarity differ at most, but for one in some
    ten thousand: the angle that SimHash measures, and four standard deviations."""
    part = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * part + 4 * math.sqrt(64 * part * (1 - part)))


def _others(similarity: float):
    """From rows in order of (kind, sample, i, j): links that join the similar pairs of a bucket's blocks i and j whose
    roots differ.  A link makes one of two roots, so a block gives fewer links than it has texts, however many pairs."""
    widths = widest(similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in (c.to_numpy() for c in batch.columns[:4])], axis=0)
            begin = np.flatnonzero(new)
            # The last group may go on in the next batch.
            rest = batch.slice(begin[-1])
            yield joined([batch.slice(x, y - x) for x, y in zip(begin, begin[1:], strict=False)])
        if rest is not None:
            yield joined([rest])

    def joined(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = [x for g in groups for x in links(g)]
        x, y = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found, strict=True)) if found else 2 * [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    def links(group: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, _, i, j, block, fp, root = (c.to_numpy() for c in group.columns[:7])
        sets = group.column(7)
        count, bits, root = sets.value_lengths().to_numpy().astype(np.int64), fp.view(_U64), root.copy()
        first = np.cumsum(count) - count
        kinds, ids = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        mark = np.zeros(len(kinds), bool)
        for p in range(len(fp) - 1):
            ok = root[p + 1 :] != root[p]
            if i[0] != j[0]:
                ok &= block[p + 1 :] != block[p]
            ok &= np.bitwise_count(bits[p + 1 :] ^ bits[p]) <= widths
            ok &= np.minimum(count[p + 1 :], count[p]) >= similarity * np.maximum(count[p + 1 :], count[p])
            q = np.flatnonzero(ok) + p + 1
            if not len(q):
                continue
            own, end = ids[first[p] : first[p] + count[p]], np.cumsum(count[q])
            mark[own] = True
            common = np.add.reduceat(mark[ids[np.arange(end[-1]) + np.repeat(first[q] - end + count[q], count[q])]], end - count[q], dtype=np.int64)
            mark[own] = False
            q = q[common >= similarity * (count[p] + count[q] - common)]
            if len(q):
                q = q[np.unique(root[q], return_index=True)[1]]
                root[np.isin(root, root[q])] = root[p]
                yield np.full(len(q), fp[p]), fp[q]

    return work


def _other_links(buckets: DataFrame, joined: DataFrame, known: DataFrame, texts: DataFrame, *, size: int, similarity: float, block: int) -> DataFrame:
    """Links (a, b) that join the similar texts of all buckets (kind, sample, fp, n) which `joined` (links) does not join.

    A bucket's texts of its most frequent root need not be compared with each other: only the rest, the strays, with all.
    Strays and the others are dealt out in blocks, and each block of strays meets all blocks."""
    # Of two texts one was the other's centre.
    by = ["kind", "sample"]
    sizes = buckets.groupBy(*by).agg(F.count("*").alias("size")).where("size > 2").drop("size")
    roots = store.keep(components(joined), "roots")
    rows = buckets.hint("merge").join(sizes, by).join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select(*by, "fp", "n", F.coalesce("root", "fp").alias("root"))
    # A text without shingles is like no other.
    rows = store.keep(rows.where("n > 0"), "rooted")
    of_root = rows.groupBy(*by, "root").agg(F.count("*").alias("size"), F.sum(8 * F.col("n") + _DEALT_BYTES).alias("bytes"))
    most = F.max(F.struct("size", "root", "bytes"))
    mixed = of_root.groupBy(*by).agg(most.alias("most"), F.sum("size").alias("size"), F.sum("bytes").alias("bytes")).where("size > most.size")

    def blocks(size, bytes_):
        return F.ceil(F.greatest(size / F.lit(block), bytes_ / F.lit(store.BATCH_BYTES))).cast("int")

    small = (F.col("size") <= block) & (F.col("bytes") <= store.BATCH_BYTES)
    strays = F.col("bytes") - F.col("most.bytes")
    k = blocks(F.col("size") - F.col("most.size"), strays)
    m = F.when(small, 0).otherwise(blocks(F.col("most.size"), F.col("most.bytes")))
    mixed = store.keep(mixed.select(*by, F.col("most.root").alias("main"), k.alias("k"), m.alias("m"), (strays * (k + m) + F.col("most.bytes") * k).alias("dealt")), "mixed")
    main = (F.col("root") == F.col("main")) & (F.col("m") > 0)
    own = F.when(main, F.col("k") + F.pmod(F.xxhash64("fp"), F.greatest("m", F.lit(1)))).otherwise(F.pmod(F.xxhash64("fp"), F.col("k"))).cast("int")
    rows = rows.hint("merge").join(mixed.drop("dealt"), by).select(*by, "fp", "root", own.alias("block"), F.when(main, F.col("k")).otherwise(F.col("k") + F.col("m")).alias("others"))
    rows = store.keep(rows, "strays")
    sets = _shingle_sets(rows.select("fp").distinct(), known, texts, size=size)
    rows = rows.hint("merge").join(sets, F.col("fp") == F.col("node")).select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    keys = [*by, "i", "j"]
    rows = rows.select(*by, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "root", "shingles")
    # Counted: Spark takes a join for the product of its sides, which gave a task to every few rows.
    n = store.partitions_of(buckets.sparkSession, mixed.agg(F.sum("dealt")).first()[0] or 0)
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_others(similarity), "a long, b long").distinct()


def similar_links(known: DataFrame, rows: DataFrame, near: DataFrame, *, size: int, similarity: float, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join all fingerprints whose texts share a sample, or are joined by `near`, and have the similarity.

    `known` has (fp, least, n, samples), a row per fingerprint; `rows` the texts by doc_id, `least` among them."""
    buckets = store.keep(known.select(F.explode(F.array_distinct("samples")).alias("sample"), "fp", "n"), "samples")
    order = [F.xxhash64("fp", F.lit(i)) for i in range(CENTRES)]
    centres = buckets.groupBy("sample").agg(F.count("*").alias("size"), *[F.min(F.struct(o, "fp", "n")).alias(f"c{i}") for i, o in enumerate(order)])
    centres = store.keep(centres.where("size > 1").drop("size"), "centres")
    # A bucket of very many texts can be split over tasks: two plain tables meet.
    held = buckets.hint("merge").join(centres, "sample").select("fp", "n", F.explode(F.array_distinct(F.array(*[F.struct(f"c{i}.fp", f"c{i}.n") for i in range(CENTRES)]))).alias("c"))
    close = (F.col("fp") != F.col("c.fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("c.fp"))) <= widest(similarity))
    close &= F.least("n", "c.n") >= similarity * F.greatest("n", "c.n")
    pairs = held.where(close).select(F.greatest("fp", "c.fp").alias("a"), F.least("fp", "c.fp").alias("b"))
    near = near.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = store.keep(pairs.unionByName(near).distinct(), "pairs")
    found = _similar(pairs, known, rows, size=size, similarity=similarity)
    # The rest, exactly: every pair of a bucket, or of what `near` joins, that is not joined yet.
    groups = buckets.select(F.lit(0).alias("kind"), "sample", "fp", "n")
    if not near.isEmpty():
        forest = components(near).join(known.select("fp", "n"), F.col("node") == F.col("fp"))
        groups = groups.unionByName(forest.select(F.lit(1).alias("kind"), F.col("root").alias("sample"), "fp", "n"))
    others = store.keep(_other_links(groups, found, known, rows, size=size, similarity=similarity, block=bucket), "others")
    return found.unionByName(others)


def _shingle_sets(nodes: DataFrame, known: DataFrame, rows: DataFrame, *, size: int) -> DataFrame:
    """(node, shingles) of fingerprints (column fp)."""
    nodes = store.keep(nodes.join(known.select("fp", "least"), "fp").select(F.col("fp").alias("node"), "least"), "nodes")
    texts = rows.hint("merge").join(nodes, rows.doc_id == nodes.least).select("text", "node")
    # Equal rows share an id: one set for each node.
    return store.keep(texts.mapInArrow(_sets(size), "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _similar(pairs: DataFrame, known: DataFrame, rows: DataFrame, *, size: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts have the similarity."""
    sets = _shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), known, rows, size=size)
    both = pairs.hint("merge").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").hint("merge").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return store.keep(both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")


def similar_texts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = 5, similarity: float = 0.8, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Like near_duplicates, but texts are linked if their sets of shingles have a Jaccard similarity of `similarity`.

    Candidates come by pigeonring, between fingerprints that differ in at most `distance` bits, and by samples (see
    above), which can miss: two similar texts are joined unless no sample of theirs is equal.  All candidates are compared
    by shingles, but for those that others have joined already.  Equal fingerprints count as equal texts.
    ids must tell texts apart.
    """
    store.prepare(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    fps = store.keep(rows.mapInArrow(_sketches(size), "doc_id long, fp long, n long, samples array<long>"), "sketches")
    known = store.keep(fps.groupBy("fp").agg(F.min(F.struct("doc_id", "n", "samples")).alias("x")).select("fp", F.col("x.doc_id").alias("least"), "x.n", "x.samples"), "distinct")
    near = links(known.select("fp"), distance=distance, bucket=bucket)
    found = similar_links(known, rows, near, size=size, similarity=similarity, bucket=bucket)
    return _grouped(fps.select("doc_id", "fp"), known.select("fp", "least"), found)


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", by: Callable[..., DataFrame] = near_duplicates, **how) -> DataFrame:
    """The rows of `docs`, all columns as they are, with one row left of each group of near duplicates.

    Groups are those of `by`: near_duplicates or similar_texts, which take `how`.  Rows are told apart by a hash of id
    and text, so null ids are no group; of equal rows one stays, of a group the one with the least hash.
    """
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"))
    keys = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    found = store.keep(by(keys, text="text", doc_id="key", **how).select("doc_id", "component_id"), "near")
    stay = store.keep(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("stay")).agg(F.count("*").alias("n")), "stay")
    # Merged, never broadcast: what stays grows with the corpus.
    kept = rows.hint("merge").join(stay, rows.key == stay.stay, "left_semi")
    if not stay.where("n > 1").isEmpty():
        kept = kept.groupBy("key").agg(F.first("row").alias("row"))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(store.read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
