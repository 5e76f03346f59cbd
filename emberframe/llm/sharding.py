"""Sharding by fixed virtual slots.

Every record hashes into one of SLOTS virtual slots; bytes are summed for each slot; a versioned table
maps slots to shards. A map that has no version yet starts by dealing the slots round robin. Rebalancing edits the latest version: slots move from the
fullest shards to the emptiest until no move helps, only moved slots change, and the edit is appended as the next version; without a move there's no new version. The map has SLOTS rows
at any input size, so it is planned on the driver and joined as a literal.

A slot can only move as a whole, so none may hold much of a shard: the rows of a slot with more than 1 / SPLIT of a shard (equal rows,
rows without doc_id) are dealt over all slots by row number before bytes are summed again.

All work on records is native: scans, partial aggregation and one window for positions.

Edge cases: a null text has 16 bytes (the fixed part) and the checksum of the empty text; rows hash by doc_id, length and checksum, so
rows with one doc_id part ways if their texts differ, and identical rows get places of their own; a single record larger than a shard's share
stays whole; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fs_path, shared_dir, stage, table

SHARDS = 40
SLOTS = 16384
OVERHEAD = 16
#: A slot with more than 1 / SPLIT of a shard's bytes is dealt anew.
SPLIT = 20


def slot_of(*key: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), *key), F.lit(slots)).cast("int")


def initial_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalance(current: list[int], sizes: list[int], shards: int) -> list[int]:
    """The next version of a slot-to-shard map: sizes near equal, from the current one by moves of single slots.

    Slots leave shards above the mean, largest that fits first, and go to the emptiest shard; then, from the
    fullest to the emptiest shard, the slot that halves their gap best moves until none shrinks the gap.
    """
    new, held = list(current), [[] for _ in range(shards)]
    total = [0] * shards
    for slot, shard in enumerate(current):
        held[shard].append(slot)
        total[shard] += sizes[slot]
    mean = sum(sizes) / shards
    loose: list[int] = []
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-sizes[s], s)):
            if sizes[slot] and total[shard] - sizes[slot] >= mean:
                total[shard] -= sizes[slot]
                held[shard].remove(slot)
                loose.append(slot)
    heap = [(total[k], k) for k in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-sizes[s], s)):
        size, shard = heapq.heappop(heap)
        new[slot] = shard
        held[shard].append(slot)
        total[shard] = size + sizes[slot]
        heapq.heappush(heap, (total[shard], shard))
    for _ in range(20 * shards):
        top = max(range(shards), key=lambda k: (total[k], -k))
        low = min(range(shards), key=lambda k: (total[k], k))
        gap = total[top] - total[low]
        moves = [s for s in held[top] if 0 < sizes[s] < gap]
        if not moves:
            break
        slot = min(moves, key=lambda s: (abs(gap - 2 * sizes[s]), s))
        held[top].remove(slot)
        held[low].append(slot)
        new[slot] = low
        total[top] -= sizes[slot]
        total[low] += sizes[slot]
    return new


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of every virtual slot; at most `slots` rows come to the driver."""
    found = docs.groupBy("vslot").agg(F.sum("size").alias("b")).collect()
    sizes = [0] * slots
    for r in found:
        sizes[r["vslot"]] = r["b"]
    return sizes


def latest_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """(version, shard of every slot) of the newest version stored at path; None if there's none."""
    fs, p = fs_path(spark, path)
    if not fs.exists(p):
        return None
    known = spark.read.schema("version int, vslot int, shard int").parquet(path)
    version = known.agg(F.max("version")).first()[0]
    if version is None:
        return None
    return version, [r["shard"] for r in known.where(F.col("version") == version).select("vslot", "shard").orderBy("vslot").collect()]


def append_map(spark: SparkSession, version: int, shards: list[int], path: str) -> None:
    """Add a version to the table (version, vslot, shard) at path; earlier ones stay."""
    flat = ",".join(map(str, shards))
    spark.range(0, len(shards), numPartitions=1).select(
        F.lit(version).alias("version"), F.col("id").cast("int").alias("vslot"), F.split(F.lit(flat), ",")[F.col("id").cast("int")].cast("int").alias("shard")).write.mode("append").parquet(path)


def next_map(spark: SparkSession, sizes: list[int], shards: int, path: str) -> tuple[int, list[int]]:
    """Load the newest version, edit it for these slot sizes, and append the edit if it moves a slot. Maps of another number of slots are an error;
    slots on shards that there are no longer start from the round robin."""
    found = latest_map(spark, path)
    if found is None:
        found = 0, initial_map(len(sizes), shards)
        append_map(spark, *found, path)
    version, now = found
    if len(now) != len(sizes):
        raise ValueError(f"the map at {path} has {len(now)} slots, not {len(sizes)}")
    new = rebalance([s if s < shards else k % shards for k, s in enumerate(now)], sizes, shards)
    if new != now:
        version += 1
        append_map(spark, version, new, path)
    return version, new


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0), grown_shard, vslot, map_version. path: of the map's table, which outlives the session."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = stage(docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("uid")).withColumn(
        "vslot", slot_of("doc_id", "text_crc32", "size", slots=slots)), "shard-base")
    sizes = slot_bytes(base, slots)
    hot = [k for k, n in enumerate(sizes) if n * shards * SPLIT > sum(sizes)]  # at most shards * SPLIT of them
    if hot:
        base = base.withColumn("vslot", F.when(F.col("vslot").isin(hot), slot_of("doc_id", "text_crc32", "size", "uid", slots=slots)).otherwise(F.col("vslot")))
        sizes = slot_bytes(base, slots)
    version, new = next_map(spark, sizes, shards, path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}")
    flat = ",".join(map(str, new))
    shard_of = lambda v: F.split(F.lit(flat), ",")[F.col(v)].cast("int")
    # Rows before a slot within its shard: a running sum over the map's fixed number of slots, not over records.
    counts = base.groupBy("vslot").agg(F.count("*").alias("n")).withColumn("shard", shard_of("vslot"))
    ahead = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("vslot", "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "uid"))
    return base.withColumn("place", place).join(F.broadcast(offsets), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "vslot", F.lit(version).alias("map_version"))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of each folder of tables is kept beside the session's other tables, and edited by the next run on that folder."""
    return shard(spark, table(spark, sf_dir, "documents"), path=f"{shared_dir(spark)}/slot-map-{zlib.crc32(sf_dir.encode()):08x}")
