"""Best-fit packing of token sequences by minimum bin slack.

Texts are tokenised, an end id is appended, and what is longer than the capacity is cut, so lengths are at most the
capacity.  Packing needs only how many pieces of each length there are, a table of at most `capacity` rows.  A bin
takes the longest piece left, and a subset-sum dynamic programme over the available lengths (one bit for each
reachable sum) finds the fullest combination for the rest of the bin.  That pattern is used as often as the counts
allow, and removed.  So the number of patterns depends on the capacity alone.

This happens twice.  Whenever a task has cut POOL tokens it packs them, and closes only bins that are full to the last
token; pieces that find no such bin, and short ones, wait for the next ones.  What waits when a task ends, or when it
would fill the pool, is the rest.  The rest of all tasks is packed together, from its counts by length on the driver.  A piece of the rest finds its bin
from its rank among the pieces of its length: the place within its task, plus the pieces that earlier tasks left.  No
piece is sorted, no length, however common, gathers in one task, and full bins are never shuffled.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import kernels as K
from vellum.llm import store

#: Tokens that a task holds before it packs them; four bytes each.
POOL = 2_000_000
#: Pieces shorter than one part in so many of the capacity are kept for the rest: without them it would not fill up.
FILLER = 4

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of a byte-level BPE vocabulary in the `tokenizers` JSON format.

    Where the vocabulary's ids are in the order of its merges, the pieces of a text are merged by `tiktoken`, which
    gives the same ids in a fraction of the time; special tokens in a text, and other vocabularies, are left to
    `tokenizers`."""

    #: Fixed value: how byte-level BPE splits a text before merging.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    #: White space so long that `tiktoken`, which backtracks over it, could run out of stack.
    LONG_BLANK = re.compile(r"(?<!\s)\s{4096}")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec: dict):
        import tiktoken

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        if model.get("type") != "BPE" or not byte_level or spec.get("normalizer") or model.get("dropout"):
            return None
        # Byte-level vocabularies write each byte as a printable character: itself if printable, else from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"] for t in spec.get("added_tokens") or []}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merges]
        if sorted(ranks.values()) != list(range(len(ranks))) or order != sorted(order):
            return None
        return tiktoken.Encoding("bpe", pat_str=Encoder.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or self.LONG_BLANK.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset int, part int, place long, ids array<int>"
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32())]


class Pool:
    """Pieces of one task that wait for a bin, by length."""

    def __init__(self, capacity: int, part: int):
        self.capacity, self.part = capacity, part
        self.waiting: dict[int, list[tuple]] = {}
        self.tokens = self.bins = 0
        self.left = np.zeros(capacity + 1, np.int64)

    def add(self, row: tuple) -> None:
        self.waiting.setdefault(row[3], []).append(row)
        self.tokens += row[3]

    def close_full(self) -> list[tuple]:
        """The pieces of all bins that can be filled to the last token, each with its sequence and offset."""
        out: list[tuple] = []
        for lengths, times in minimum_bin_slack({k: len(v) for k, v in self.waiting.items() if FILLER * k >= self.capacity}, self.capacity):
            if sum(lengths) < self.capacity:
                continue
            for _ in range(times):
                # Numbers from 0 up, apart from those of other tasks; the rest's are below 0.
                at, sequence = 0, self.part << 32 | self.bins
                self.bins += 1
                for length in lengths:
                    row = self.waiting[length].pop()
                    out.append((*row[:5], sequence, at, self.part, None, row[5]))
                    at += length
        self.waiting = {k: v for k, v in self.waiting.items() if v}
        self.tokens = sum(k * len(v) for k, v in self.waiting.items())
        return out

    def leave(self) -> list[tuple]:
        """All that waits, each with its place among the pieces of its length that this task leaves."""
        out = []
        for length, rows in self.waiting.items():
            out += [(*row[:5], None, None, self.part, int(self.left[length]) + i, row[5]) for i, row in enumerate(rows)]
            self.left[length] += len(rows)
        self.waiting, self.tokens = {}, 0
        return out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_PIECE_TYPES)
    names = [c.split()[0] for c in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PIECE_TYPES, strict=True)], names)


#: Pieces that leave a task at once.
OUT_ROWS = 2_000


def _cut(path: str, capacity: int, end_id: int, with_ids: bool, pool_tokens: int):
    def tables(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), OUT_ROWS):
            yield _table(rows[i : i + OUT_ROWS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        pool = Pool(capacity, TaskContext.get().partitionId())
        for batch in batches:
            for text, doc in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = np.append(enc.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                total = len(ids)
                # The first piece takes what full pieces leave over.
                cuts = [0, *range(total % capacity or min(total, capacity), total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[a:b]
                    pool.add((doc, piece, a, b - a, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None))
                if pool.tokens >= pool_tokens:
                    yield from tables(pool.close_full())
                    # Lengths that do not complement each other go to the rest, else they would fill the pool.
                    if 2 * pool.tokens >= pool_tokens:
                        yield from tables(pool.leave())
        # Not packed here: these fill up what the other tasks' rest leaves open.
        yield from tables(pool.leave())

    return work


def fullest(available: dict[int, int], room: int) -> list[int]:
    """The combination of available lengths (each at most as often as counted) with the largest sum up to `room`."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(available, reverse=True):
        left = min(available[length], room // length) if length else 0
        times = 1
        while left:
            times = min(times, left)
            left -= times
            after = (reach | reach << (length * times)) & mask
            if after != reach:
                steps.append((length, times, reach))
                reach = after
            times *= 2
        if reach >> room & 1:
            break
    target, out = reach.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> target & 1:
            out += [length] * times
            target -= length * times
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) until every piece is placed."""
    left = {length: n for length, n in counts.items() if n > 0}
    plan = []
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        bin_ = [longest, *fullest({k: n for k, n in rest.items() if n}, capacity - longest)]
        own = {k: bin_.count(k) for k in set(bin_)}
        times = min(left[k] // m for k, m in own.items())
        plan.append((sorted(bin_, reverse=True), times))
        for k, m in own.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
    return plan


def _places(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """For each length and pattern: length, first rank, pieces a bin, first bin, offset of the first piece."""
    rank: dict[int, int] = {}
    rows, first_bin = [], 0
    for lengths, times in plan:
        offset = 0
        for length in dict.fromkeys(lengths):
            m = lengths.count(length)
            rows.append((length, rank.get(length, 0), m, first_bin, offset))
            rank[length] = rank.get(length, 0) + m * times
            offset += m * length
        first_bin += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _assign(table):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        # Lengths and ranks as one ordered number; ranks of one length stay far below 2 ** 48.
        order = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("place").to_numpy() + batch.column("before").to_numpy()
            row = rows[np.searchsorted(order, length << 48 | rank, side="right") - 1] if len(rows) else np.zeros((0, 5), np.int64)
            at = rank - row[:, 1]
            bin_, slot = row[:, 3] + at // np.maximum(row[:, 2], 1), at % np.maximum(row[:, 2], 1)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
            out = {"length": pa.array(length), "sequence_id": pa.array(-1 - bin_), "offset": pa.array(row[:, 4] + slot * length)}
            yield pa.RecordBatch.from_arrays([out[n] if n in out else batch.column(n) for n in names], names)

    return work


def pack(docs: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", capacity: int = 1024, end_id: int = 2, with_ids: bool = True, pool_tokens: int = POOL) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and ids (null unless `with_ids`).

    `tokenizer` is the path of a `tokenizers` JSON file that every executor can read.  A null text is empty: its only
    id is `end_id`.  Texts of more than `capacity` ids are cut into pieces of `capacity`, the first one shorter.
    sequence_id tells the packed sequences apart (numbers of any size and sign); offsets in a sequence are gapless
    from 0.  Repeated rows are packed each for itself; an empty table gives no rows; only `text` and `doc_id` are read.
    """
    spark = docs.sparkSession
    store.prepare(spark)
    rows = docs.select(F.col(text).cast("string"), F.col(doc_id).cast("long"))
    pieces = store.keep(rows.mapInArrow(_cut(tokenizer, capacity, end_id, with_ids, pool_tokens), _PIECES), "pieces")
    names = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"), "ids"]
    full, rest = pieces.where("sequence_id is not null").select(*names), pieces.where("sequence_id is null")
    sizes = rest.groupBy("part", "length").agg(F.count("*").alias("n"))
    by = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = store.keep(sizes.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0))), "before")
    counts = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(_places(minimum_bin_slack(counts, capacity)))
    return full.unionByName(rest.join(before.drop("n"), ["part", "length"]).mapInArrow(
        _assign(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>"
    ))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(store.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return out.drop("ids")
