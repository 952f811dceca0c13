"""Sharding through fixed virtual slots.

Records are hashed into a fixed number of slots, thousands of them, and only slots are ever placed: a versioned map
names the shard of every slot.  Version 1 deals the slots out evenly.  Bytes are then aggregated per slot, and the
newest stored map is edited: slots move (or change places) between the fullest and the emptiest shard until the sizes
are near equal, and the edited map is stored as the next version.  So a map that is balanced already is kept as it is,
and later runs over a grown table move few slots.  A new shard is another edit: it takes slots, and so records, only
into itself.

The hash takes in the text as well as the id, so copies of a text, or rows that share an id, spread over the slots.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import kernels as K
from vellum.llm import store

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """The shard of every slot; each edit gives the next version."""

    version: int
    shards: int
    shard_of: np.ndarray

    @staticmethod
    def even(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, shards, np.arange(slots) % shards)

    def rebalance(self, sizes: np.ndarray) -> SlotMap:
        """Move or exchange slots between the fullest and the emptiest shard while that brings the two closer."""
        shard_of = self.shard_of.copy()
        load = np.bincount(shard_of, weights=sizes, minlength=self.shards).astype(np.int64)
        stuck: set[tuple[int, int]] = set()
        while load.max() - load.min() > max(1, sizes.sum() // (self.shards * 10_000)):
            order = np.argsort(load, kind="stable")
            pair = next(((int(h), int(low)) for low in order for h in order[::-1] if load[h] > load[low] and (int(h), int(low)) not in stuck), None)
            if pair is None:
                break
            high, low = pair
            gap = load[high] - load[low]
            a, b = np.flatnonzero(shard_of == high), np.append(np.flatnonzero(shard_of == low), -1)
            # Of all slots to give and (or none) to take back, the two that leave the smallest gap.
            give, take = sizes[a], np.where(b >= 0, sizes[b], 0)
            take_order = np.argsort(take, kind="stable")
            want = give - gap / 2
            at = np.searchsorted(take[take_order], want)
            best = None
            for shift in (-1, 0):
                near = np.clip(at + shift, 0, len(take) - 1)
                moved = give - take[take_order[near]]
                left = np.abs(gap - 2 * moved)
                i = int(np.argmin(left))
                if best is None or left[i] < best[0]:
                    best = (int(left[i]), i, int(take_order[near[i]]))
            if best[0] >= gap:
                stuck.add(pair)
                continue
            x, y = a[best[1]], b[best[2]]
            moved = sizes[x] - (sizes[y] if y >= 0 else 0)
            shard_of[x] = low
            if y >= 0:
                shard_of[y] = high
            load[high] -= moved
            load[low] += moved
            stuck = {p for p in stuck if high not in p and low not in p}
        return replace(self, version=self.version + 1, shard_of=shard_of)

    def grow(self, sizes: np.ndarray) -> SlotMap:
        """One more shard: it takes slots from the fullest shards until it holds its part; no other slot moves."""
        shard_of, new = self.shard_of.copy(), self.shards
        load = np.bincount(shard_of, weights=sizes, minlength=new + 1).astype(np.int64)
        part = int(sizes.sum()) // (new + 1)
        for slot in np.argsort(-sizes, kind="stable"):
            old = shard_of[slot]
            if load[old] - sizes[slot] >= part and load[new] + sizes[slot] <= part:
                shard_of[slot] = new
                load[old] -= sizes[slot]
                load[new] += sizes[slot]
        return SlotMap(self.version + 1, self.shards + 1, shard_of)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, s, int(x)) for s, x in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, vslot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the stored map; earlier versions stay.  An existing version is never written again."""
        self.frame(spark).drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The stored versions that were written to the end, in order; none if there is no map under `path`."""
        return sorted(int(p.rpartition("=")[2]) for p in store.folders(spark, path, "version=*") if store.exists(spark, f"{p}/_SUCCESS"))

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of a stored map, the newest if none is named.  Its rows are as many as slots.

        A path without a map, or a version that it does not have, is a ValueError."""
        have = SlotMap.versions(spark, path)
        if not have or version not in (None, *have):
            raise ValueError(f"{path}: no slot map" if not have else f"{path}: no version {version} of the slot map; there are {have}")
        version = have[-1] if version is None else version
        rows = spark.read.schema("shards int, vslot int, shard int").parquet(f"{path}/version={version}").orderBy("vslot").collect()
        return SlotMap(version, rows[0].shards, np.array([r.shard for r in rows]))


_ROWS = "doc_id long, size long, text_crc32 long, vslot int, part int, place long"


def _slots(slots: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(slots, np.int64)
        for batch in batches:
            buf, off = K.text_buffer(batch.column(0))
            raw = memoryview(np.ascontiguousarray(buf))
            crc = np.array([zlib.crc32(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], dtype=np.int64)
            slot = batch.column(2).to_numpy()
            # The place among this task's records of the slot.
            order = np.argsort(slot, kind="stable")
            new = np.flatnonzero(np.diff(np.concatenate([[-1], slot[order]])))
            count = np.diff(np.append(new, len(slot)))
            place = np.empty(len(slot), np.int64)
            place[order] = np.arange(len(slot)) - np.repeat(new, count) + seen[slot[order]]
            seen[slot[order][new]] += count
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.diff(off) + 8), pa.array(crc), batch.column(2), pa.array(np.full(len(slot), part, np.int32)), pa.array(place)],
                ["doc_id", "size", "text_crc32", "vslot", "part", "place"],
            )

    return work


def _edit(spark: SparkSession, path: str, shards: int, slots: int, sizes: np.ndarray) -> SlotMap:
    """The map under `path` for so many shards and these sizes of slots, every edit stored."""
    if SlotMap.versions(spark, path):
        now = SlotMap.load(spark, path)
        if len(now.shard_of) != slots or now.shards > shards:
            raise ValueError(f"{path}: a map of {len(now.shard_of)} slots and {now.shards} shards is not one of {slots} and {shards}")
    else:
        now = SlotMap.even(shards, slots)
        now.save(spark, path)
    while now.shards < shards:
        now = now.grow(sizes)
        now.save(spark, path)
    edited = now.rebalance(sizes)
    if (edited.shard_of == now.shard_of).all():
        return now
    edited.save(spark, path)
    return edited


def shard(docs: DataFrame, shards: int, *, text: str = "text", doc_id: str = "doc_id", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot and map_version.

    The size of a record is its text's UTF-8 bytes (null: none) plus 8.  The law is `bytes`: shards get near equal
    sizes, as near as whole slots, and so whole records, allow.  slot is the record's place in its shard, gapless
    from 0; grown_shard is null.  Equal texts of different ids are spread: one group of them may hold more than a
    shard's part of all bytes.

    The map under `map_path` is loaded, its newest version edited and the edit stored as the next one; if nothing
    moves, no version is added.  Without a map there, version 1 is the even one.  It must have as many slots; if it has
    fewer shards, it grows first, and more are a ValueError.  By default the map lies in the shared folder and goes
    when the driver ends.  Repeated rows get places of their own; an empty table gives no rows.  Only `text` and
    `doc_id` are read.
    """
    spark = docs.sparkSession
    store.prepare(spark)
    vslot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id")).withColumn("vslot", vslot)
    sized = store.keep(rows.mapInArrow(_slots(slots), _ROWS), "sized")
    per_slot = sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    sizes, counts = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in per_slot:
        sizes[r.vslot], counts[r.vslot] = r.bytes, r.n
    path = map_path or store.new_path(spark, "slot-map")
    edited = _edit(spark, path, shards, slots, sizes)
    # Slots of one shard stand one after another; in a slot the tasks do, by number.
    order = np.argsort(edited.shard_of, kind="stable")
    total = np.cumsum(counts[order]) - counts[order]
    base = np.empty(slots, np.int64)
    begin = np.searchsorted(edited.shard_of[order], np.arange(shards))
    base[order] = total - total[np.minimum(begin, slots - 1)][edited.shard_of[order]]
    placed = spark.createDataFrame([(s, int(x), int(b)) for s, (x, b) in enumerate(zip(edited.shard_of, base, strict=True))], "vslot int, shard int, base long")
    by = Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = store.keep(sized.groupBy("vslot", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0))).drop("n"), "before")
    return sized.join(before, ["vslot", "part"]).join(F.broadcast(placed), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("before") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.lit(edited.version).alias("map_version"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(store.read(spark, sf_dir, "documents"), 24)
