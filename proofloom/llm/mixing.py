"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents fall into ``blocks`` hashed blocks. A source's target fixes how many passes over its blocks
the mix takes: whole passes, then one partial pass that ends inside one block, at one word. The blocks drawn are dealt
to the output shards by halving the range of shards again and again: each half's number of blocks of every source is
one draw from a multivariate hypergeometric law, so quotas add up exactly at every level. A shard then takes the next
so many blocks from each source's permuted list, so shards are disjoint, and orders its own documents by a hash.

Only tables of sources by blocks reach the driver: their size is set by the number of sources and the parameter
``blocks``, not by the number of documents.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut, whole_row

BLOCKS = 256
SHARDS = 16


def targets(sizes: dict, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict:
    """Words to take of each source. Sources by code point, null last; weights repeat in that order.

    ``share`` times all words are dealt by weight; what exceeds ``cap`` times a source's size is dealt again among
    the others by weight, until no source is above. If all are at their caps, the rest is dropped.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if per * weight[s] > cap * sizes[s]]
        if not full:
            return out | {s: per * weight[s] for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _order(source, turn: int, blocks: int, seed: int) -> np.ndarray:
    """The permutation of a source's blocks in one pass."""
    digest = hashlib.sha256(f"{seed}|{turn}|{source!r}".encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "little")).permutation(blocks)


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard: rows are shards, columns are sources, columns add up to ``quotas``."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    half = int(quotas.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, half, method="marginals")
    return np.vstack([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


def plan_mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 17, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, passes; with ``carry`` also _row, all it held.

    ``passes`` is an array of struct(turn, words, shard): the words that pass ``turn`` takes from the head of the
    document and the shard they go to; nothing for a pass that leaves the document out. Needs doc_id, source, text;
    other columns are ignored. Null and empty texts have size 0 and no passes. A null source is a source, the last
    one. Repeated rows are separate documents. An empty table gives no rows. Reruns agree: nothing depends on the
    order or the partitioning of the rows.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    block, turn = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)).cast("int"), F.xxhash64(F.lit(seed + 1), "doc_id")
    measured = docs.select("doc_id", "source", size.alias("size"), block.alias("_block"), turn.alias("_turn"), *([whole_row(docs).alias("_row")] * carry))
    sized = cut(measured.drop("_row"), "mix")
    per = {(r["source"], r["_block"]): r["words"] for r in sized.groupBy("source", "_block").agg(F.sum("size").alias("words")).collect()}
    sizes: dict = {}
    for (s, _), words in per.items():
        sizes[s] = sizes.get(s, 0) + words
    want = targets(sizes, weights, share, cap)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    drawn: list[list[tuple[int, int, int]]] = []  # by source: (turn, block, words left for it, or -1 for the whole block)
    for s in names:
        goal, own = round(want[s]), []
        whole = min(goal // sizes[s], int(math.floor(cap))) if sizes[s] else 0
        for turn in range(whole):
            own += [(turn, int(b), -1) for b in _order(s, turn, blocks, seed) if (s, b) in per]
        rest = goal - whole * sizes[s]
        for b in _order(s, whole, blocks, seed) if rest > 0 else []:
            words = per.get((s, int(b)), 0)
            if words and rest > 0:
                own.append((whole, int(b), -1 if words <= rest else rest))
                rest -= min(rest, words)
        drawn.append(own)
    quotas = np.array([len(x) for x in drawn], dtype=np.int64)
    dealt = split_tree(quotas, shards, np.random.default_rng(seed)) if len(names) else np.zeros((shards, 0), int)
    rows, cuts = [], set()
    for i, s in enumerate(names):
        ends = np.cumsum(dealt[:, i])
        for k, (turn, b, left) in enumerate(drawn[i]):
            rows.append((s, b, turn, int(np.searchsorted(ends, k, side="right")), left))
            if left >= 0:
                cuts.add((s, b))
    kinds = T.StructType([T.StructField("source", T.StringType()), T.StructField("_block", T.IntegerType()), T.StructField("turn", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("left", T.LongType())])
    turns = spark.createDataFrame(rows, kinds).groupBy("source", "_block").agg(F.sort_array(F.collect_list(F.struct("turn", "shard", "left"))).alias("_turns"))
    heads = spark.createDataFrame([(s, sizes[s], float(want[s])) for s in names], "source string, source_size long, target double")
    # at most `blocks` rows a source: a size that no number of documents changes
    base = measured if carry else sized
    out = base.join(F.broadcast(heads.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    turns = turns.withColumnsRenamed({"source": "_s", "_block": "_b"})
    out = out.join(F.broadcast(turns), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left").drop("_s", "_b")
    # Only a block that a pass ends in needs its documents in order.
    last = F.exists(F.coalesce("_turns", F.array()), lambda t: t["left"] >= 0)
    before = F.sum("size").over(Window.partitionBy("source", "_block").orderBy("_turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    inside = out.filter(last).withColumn("_before", F.coalesce(before, F.lit(0).cast("long")))
    out = out.filter(~last).withColumn("_before", F.lit(0).cast("long")).unionByName(inside)

    def words(t):
        return F.when(t["left"] < 0, F.col("size")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), t["left"] - F.col("_before"))))

    passes = F.filter(F.transform("_turns", lambda t: F.struct(t["turn"].alias("turn"), words(t).alias("words"), t["shard"].alias("shard"))), lambda p: p["words"] > 0)
    return out.select(*(["_row"] * carry), "doc_id", "source", "size", "source_size", "target", F.coalesce(passes, F.array().cast("array<struct<turn:int,words:bigint,shard:int>>")).alias("passes"))


def draws(plan: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: doc_id, source, turn, words, shard, place; sort a shard by ``place`` to read it shuffled."""
    one = plan.select("doc_id", "source", F.explode("passes").alias("p"))
    return one.select("doc_id", "source", "p.turn", "p.words", "p.shard", F.xxhash64(F.lit(seed + 2), "doc_id", "p.turn").alias("place"))


def taken(plan: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (the words that the mix takes of each document, repeats counted), shards.

    shards: where the splitting tree sends each pass, as places of the passes are. One row per row of ``plan``, which
    states what nulls, repeated rows, very long texts, ties and empty tables give.
    """
    total = F.aggregate("passes", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return plan.select("doc_id", "size", "source_size", "target", total.alias("taken"), F.col("passes.shard").alias("shards"))
