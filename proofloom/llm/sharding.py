"""Sharding by balanced label propagation.

Documents of equal text are linked. The vertices are units: the members of one text's group that start in one shard,
so a group has at most as many units as there are shards, whatever its size. In each round every unit asks for the
shard that holds most bytes of its group; a shard admits movers only as far as its quota goes. At the end documents
without links, which no edge holds, fill what each shard lacks, so that sizes come out even.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, unit

SHARDS = 40
BLOCKS = 4096
SLOT_BLOCKS = 64


def propagate(units: DataFrame, capacity: float, shards: int, rounds: int) -> DataFrame:
    """Units (key, cell, bytes, label) with new labels. Groups over a quarter of a shard move by units, others whole.

    Rounds end when no unit asks to move, when no fewer bytes ask than the round before, or after ``rounds``.
    """
    before = float("inf")
    for turn in range(rounds):
        tally = units.groupBy("key", "label").agg(F.sum("bytes").alias("_held"))
        best = tally.groupBy("key").agg(F.max_by("label", F.struct("_held", -F.col("label"))).alias("_want"), F.sum("_held").alias("_all"))
        asked = cut(units.join(best, "key").withColumn("_big", F.col("_all") > capacity / 4), "sharding-asked")
        load = {r[0]: r[1] for r in asked.groupBy("label").agg(F.sum("bytes")).collect()}
        need = {r[0]: r[1] for r in asked.filter("label <> _want").groupBy("_want").agg(F.sum("bytes")).collect()}
        asking = sum(need.values())
        if not need or asking >= before:
            drop_cut(asked)
            break
        before = asking
        # one entry a shard
        part = F.create_map(*[x for t in range(shards) for x in (F.lit(t), F.lit(max(0.0, min(1.0, 0.9 * (capacity - load.get(t, 0)) / need[t])) if t in need else 0.0))])
        dice = F.when(F.col("_big"), unit(F.lit(turn), "key", "cell")).otherwise(unit(F.lit(turn), "key"))
        new = cut(asked.select("key", "cell", "bytes", F.when(dice < part[F.col("_want")], F.col("_want")).otherwise(F.col("label")).alias("label")), "sharding-units")
        drop_cut(asked)
        if turn:
            drop_cut(units)
        units = new
    return units


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = 12) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; sizes (UTF-8 bytes of the text plus 16) come out near equal.

    Needs doc_id and text; other columns are ignored. A null text counts as empty. Documents of equal text go to one
    shard where its quota allows it; a group too large for a shard stays spread. Repeated rows are separate
    documents; rows without doc_id share their blocks. An empty table gives no rows. Reruns agree.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))
    narrow = cut(narrow.withColumns({"cell": F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"), "_block": F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(BLOCKS)).cast("int")}), "sharding")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    capacity = total / shards
    units = narrow.groupBy("key", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    several = F.sum("n").over(Window.partitionBy("key")) > 1
    units = cut(units.withColumn("_several", several).filter("_several").select("key", "cell", "bytes", F.col("cell").alias("label")), "sharding-units")
    units = propagate(units, capacity, shards, rounds)
    placed = narrow.join(units.select("key", "cell", F.col("label").alias("_label")), ["key", "cell"], "left")
    placed = cut(placed.select("doc_id", "size", "text_crc32", "_block", "_label"), "sharding-placed")
    # at most BLOCKS rows
    sizes = placed.filter("_label is null").groupBy("_block").agg(F.sum("size").alias("s")).collect()
    load = {r[0]: r[1] for r in placed.filter("_label is not null").groupBy("_label").agg(F.sum("size")).collect()}
    heap = [(load.get(t, 0), t) for t in range(shards)]
    heapq.heapify(heap)
    rows = []
    for r in sorted(sizes, key=lambda r: (-r["s"], r["_block"])):
        held, t = heapq.heappop(heap)
        rows.append((r["_block"], t))
        heapq.heappush(heap, (held + r["s"], t))
    fill = spark.createDataFrame(rows, "_block int, _fill int")
    out = placed.join(F.broadcast(fill), "_block", "left")
    out = out.select("doc_id", "size", "text_crc32", F.coalesce("_label", "_fill").alias("shard"), F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(SLOT_BLOCKS)).cast("int").alias("_part"))
    # slots: a running count over (shard, part) pairs, at most shards * SLOT_BLOCKS rows, then a rank inside each pair
    pairs = out.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = pairs.withColumn("_base", base).drop("_n")
    rank = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "size", "text_crc32")) - 1
    out = out.withColumn("_rank", rank).join(F.broadcast(pairs), ["shard", "_part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_base") + F.col("_rank")).cast("long").alias("slot"))
