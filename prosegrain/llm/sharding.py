"""Sharding by minimax contiguous partition: the smallest feasible shard capacity over ordered atomic group sizes, found by binary
search with a greedy check; the cuts are made there.

An atomic group is what shares a slot of the text hash, so equal texts stay together. The slots are as many as a
parameter says, whatever the corpus holds; their sizes are all that the driver gets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrain.llm.common import cut

#: Slots for each shard at least, and in all; 65,536 sizes are half a MB on the driver.
SLOTS_PER_SHARD, SLOTS = 64, 1 << 16
#: Parts in which the places within a shard are numbered, so that no shard is one task.
PARTS = 64


def minimax_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """First group of each shard but the first, so that the largest of `shards` contiguous runs of groups is as small as can be.

    Of the partitions with that capacity, each cut comes as near to an even share of the rest as the capacity allows.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)])
    n, total = len(sizes), int(ends[-1])

    def reach(start: int, capacity: int) -> int:
        return int(np.searchsorted(ends, ends[start] + capacity, side="right")) - 1

    def feasible(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = reach(at, capacity)
            if at == n:
                return True
        return False

    low, high = max(int(sizes.max(initial=0)), -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    need = np.zeros(n + 1, dtype=np.int64)
    far = np.searchsorted(ends, ends[:-1] + low, side="right") - 1
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[far[i]]
    cuts, at = [], 0
    for k in range(shards, 1, -1):
        even = ends[at] + (total - ends[at]) / k
        to = int(np.searchsorted(ends, even))
        to -= to > at and ends[to] - even > even - ends[to - 1]
        first = int(np.searchsorted(-need, -(k - 1)))  # need falls with the place: from here on k - 1 shards hold the rest
        to = min(max(to, first, at), reach(at, low))
        cuts.append(to)
        at = to
    return cuts


def bytes_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 16).cast("long")


def shard_map(measured: DataFrame, shards: int) -> DataFrame:
    """From slot to shard, for every slot. measured: group_slot, size."""
    spark, slots = measured.sparkSession, slots_for(shards)
    sizes = np.zeros(slots, dtype=np.int64)
    for r in measured.groupBy("group_slot").agg(F.sum("size").alias("size")).collect():  # at most one row for each slot
        sizes[r["group_slot"]] = r["size"]
    cuts = minimax_cuts(sizes, shards)
    of = np.searchsorted(np.array(cuts), np.arange(slots), side="right")
    runs = spark.createDataFrame([(int(s), int(np.flatnonzero(of == s)[0]), int(np.flatnonzero(of == s)[-1])) for s in np.unique(of)], "shard int, first long, last long")
    return runs.select("shard", F.explode(F.sequence("first", "last")).alias("group_slot"))


def slots_for(shards: int) -> int:
    return max(SLOTS, shards * SLOTS_PER_SHARD)


def numbered(placed: DataFrame) -> DataFrame:
    """placed (doc_id, text_crc32, size, shard) with slot, gapless from 0 in each shard.

    Each shard is numbered in PARTS parts by doc_id's hash, which windows sort one by one; the parts follow each other.
    """
    p = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(PARTS)))
    counts = p.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    p = p.withColumn("place", F.row_number().over(within) - 1)
    return p.join(start, ["shard", "part"]).withColumn("slot", (F.col("start") + F.col("place")).cast("long")).drop("part", "start", "place")


def shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law is `bytes`: the shards' sizes are as near equal as whole groups of equal texts allow, size being UTF-8 bytes and 16.
    grown_shard is null, as this law does not promise it. Texts are read once, into a table of numbers. Null texts count
    as empty (size 16, crc 0) and go together; null doc_ids and repeated rows get places of their own; an empty table
    gives an empty result; other columns of docs are not read.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    slot = F.pmod(F.xxhash64(t), F.lit(slots_for(n_shards))).cast("long")
    m = cut(docs.select("doc_id", bytes_of(F.col("text")).alias("size"), F.crc32(t).alias("text_crc32"), slot.alias("group_slot")), "shard-sizes")
    placed = m.join(F.broadcast(shard_map(m, n_shards)), "group_slot").drop("group_slot")
    return numbered(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
