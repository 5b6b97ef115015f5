"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots.  Bytes and rows are
aggregated for each slot, and a small versioned table maps slots to shards.
Rebalancing writes a new version of that table; records keep their slots, so
only the slots whose entry was edited move.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexora.llm.common import cut, each_copy
from lexora.shared import fresh

SLOTS = 8192


@dataclass
class SlotMap:
    """One version of the slot-to-shard map: shard_of[slot]."""

    version: int
    shards: int
    shard_of: list[int] = field(default_factory=list)

    def loads(self, size: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += size[slot]
        return out


def first_map(size: list[int], shards: int) -> SlotMap:
    """Version 1: slots by falling size, each to the shard with the fewest bytes so far (ties: the lower shard)."""
    heap = [(0, s) for s in range(shards)]
    shard_of = [0] * len(size)
    for slot in sorted(range(len(size)), key=lambda s: (-size[s], s)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + size[slot], shard))
    return SlotMap(1, shards, shard_of)


def rebalanced(old: SlotMap, size: list[int], shards: int, slack: float = 0.01) -> SlotMap:
    """The next version: `old` with as few edits as bring every shard near its fair share.

    Only whole slots move, from the fullest shard to the emptiest, and only
    where that lowers the larger of the two.  `shards` may grow but not shrink.
    """
    if shards < old.shards:
        raise ValueError("a map can gain shards, not lose them")
    new = SlotMap(old.version + 1, shards, list(old.shard_of))
    load = new.loads(size)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(new.shard_of):
        held[shard].append((size[slot], slot))
    for h in held:
        h.sort(reverse=True)
    fair = sum(size) / shards
    while True:
        full, empty = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        if load[full] <= fair * (1 + slack):
            return new
        fits = next((x for x in held[full] if 0 < x[0] <= gap / 2), None) or next((x for x in reversed(held[full]) if 0 < x[0] < gap), None)
        if fits is None:
            return new
        held[full].remove(fits)
        held[empty].append(fits)
        held[empty].sort(reverse=True)
        load[full] -= fits[0]
        load[empty] += fits[0]
        new.shard_of[fits[1]] = empty


def save(spark: SparkSession, store: str, m: SlotMap) -> None:
    """A version is a folder of its own and is never overwritten."""
    rows = [(slot, shard, m.shards) for slot, shard in enumerate(m.shard_of)]
    spark.createDataFrame(rows, "vslot int, shard int, shards int").coalesce(1).write.parquet(f"{store}/version={m.version}")


def load(spark: SparkSession, store: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{store}/version={version}").orderBy("vslot").collect()  # one row for each slot
    return SlotMap(version, rows[0]["shards"], [r["shard"] for r in rows])


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of every row; a null text has no bytes, a null doc_id hashes as null.

    The text is hashed too, and the row's number among its equals, so that
    neither rows which share a doc_id nor repeated rows share a slot.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return each_copy(slim, "_copy").withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "_copy"), F.lit(slots)).cast("int")).drop("_copy")


def totals(rows: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: at most `slots` rows come to the driver."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r["vslot"]], count[r["vslot"]] = r["b"], r["n"]
    return size, count


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, store: str | None = None, version: int | None = None) -> DataFrame:
    """Put every row of docs into one of `shards` shards of nearly equal bytes.

    Rows that repeat are spread over slots like any others.  Returns doc_id, size (UTF-8 bytes of the text and 1), text_crc32, vslot,
    shard and slot, the row's place in its shard, gapless from 0.  Places
    follow vslot, doc_id, text_crc32, size; rows equal in all of these are
    interchangeable.  An empty table gives an empty result; columns other than
    doc_id and text aren't read.  `store` keeps the versions of the map (a new
    folder by default); `version` uses a stored one instead of making one.
    """
    spark = docs.sparkSession
    rows = cut(slotted(docs, slots), "slotted")
    size, count = totals(rows, slots)
    store = store or fresh(spark, "slot-map")
    if version is None:
        m = first_map(size, shards)
        save(spark, store, m)
    else:
        m = load(spark, store, version)
    first, at = [0] * m.shards, []
    for vslot, s in enumerate(m.shard_of):
        at.append((vslot, s, first[s]))
        first[s] += count[vslot]
    placed = spark.createDataFrame(at, "vslot int, shard int, first long")  # `slots` rows: a fixed bound for the broadcast
    inside = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("_i", inside).join(F.broadcast(placed), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("_i")).alias("slot"))
