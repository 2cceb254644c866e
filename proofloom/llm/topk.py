"""Exact top-k by inner product over KD-trees, one a shard.

Shards are regions of space: the leaves of a KD-tree's top levels, fitted on a bounded sample. A shard's vectors are
split at medians of the widest dimension; every node keeps the tight box around its vectors. The largest inner product
that a box allows bounds what lies below it, so a best-first search leaves out every node whose bound cannot beat the
k-th score so far. A query first searches the shard of its own region; the k-th score found there goes along, and only
to shards whose boxes can beat it. Queries travel in blocks to shards of bounded size, each shard's tree is built once
for many blocks: no join of rows with rows, no pairs beyond k a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, frugal, tidied

SHARD_ROWS = 8192
QUERY_ROWS = 256
LEAF = 128
#: Vectors that the shards' borders are fitted on (512 bytes each, on the driver), at most twice as many.
SAMPLE = 20_000
#: Boxes in one list that a query block is held against, and blocks that one copy of a shard serves.
BOXES, VISITS = 512, 64


class KDTree:
    """Median splits down to ``leaf`` vectors. ids and vectors are permuted so that each node is one slice."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors = ids.copy(), vectors.copy()
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left child, right child (-1: leaf)
        low, high, least = [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                s, e, l, r = self.nodes[parent]
                self.nodes[parent] = (s, e, at, r) if side == 0 else (s, e, l, at)
            self.nodes.append((a, b, -1, -1))
            v = self.vectors[a:b]
            low.append(v.min(0))
            high.append(v.max(0))
            least.append(self.ids[a:b].min())
            spread = high[-1] - low[-1]
            if b - a > leaf and spread.max() > 0:
                d, mid = int(spread.argmax()), (b - a) // 2
                order = np.argpartition(v[:, d], mid)
                self.vectors[a:b], self.ids[a:b] = v[order], self.ids[a:b][order]
                todo += [(a + mid, b, at, 1), (a, a + mid, at, 0)]
        self.low, self.high, self.least = np.array(low), np.array(high), np.array(least)

    def search(self, query: np.ndarray, own, k: int, floor: tuple[float, float]) -> list[tuple[float, int]]:
        """The k best (score, -id) that come before ``floor``, a (score, -id) too; ``own`` takes no part."""
        bound = np.maximum(query * self.low, query * self.high).sum(1)
        best: list[tuple[float, int]] = []  # a heap, the worst first
        worst = floor
        queue = [(-bound[0], 0)]
        while queue:
            b, at = heapq.heappop(queue)
            if (-b, -int(self.least[at])) < worst:
                if -b < worst[0]:
                    break
                continue  # as high as the worst, but no id here is smaller
            a, e, left, right = self.nodes[at]
            if left >= 0:
                for child in (left, right):
                    if (bound[child], -int(self.least[child])) >= worst:
                        heapq.heappush(queue, (-bound[child], child))
                continue
            scores, ids = self.vectors[a:e] @ query, self.ids[a:e]
            keep = (scores >= worst[0]) & (ids != own) if own is not None else scores >= worst[0]
            scores, ids = scores[keep], ids[keep]
            if len(ids) > k:
                top = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[top], ids[top]
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                hit = (s, -i)
                if hit < worst:
                    continue
                if len(best) < k:
                    heapq.heappush(best, hit)
                elif hit > best[0]:
                    heapq.heapreplace(best, hit)
                if len(best) == k:
                    worst = max(worst, best[0])
        return sorted(best, reverse=True)


def _matrix(values: list, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros, which add nothing to an inner product."""
    if all(len(v) == width for v in values):
        return np.array([np.asarray(v) for v in values], np.float64).reshape(len(values), width)
    out = np.zeros((len(values), width))
    for row, v in zip(out, values, strict=True):
        row[: len(v)] = v
    return out


class Splits:
    """The top levels of a KD-tree over a sample: ``dims`` and ``values`` of its nodes, level by level; leaves are shards."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.levels = max(0, (leaves - 1).bit_length()) if len(sample) else 0
        self.dims, self.values = [], []
        parts = [sample]
        for _ in range(self.levels):
            halves = []
            for p in parts:
                spread = p.max(0) - p.min(0) if len(p) else np.zeros(sample.shape[1])
                d = int(spread.argmax())
                value = float(np.median(p[:, d])) if len(p) else 0.0
                self.dims.append(d)
                self.values.append(value)
                high = p[:, d] > value if len(p) else np.zeros(0, bool)
                halves += [p[~high], p[high]]
            parts = halves

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The shard of each vector, by comparisons alone; dimensions that a vector lacks are zero."""
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        dims, values = np.array(self.dims, np.int64), np.array(self.values)
        for _ in range(self.levels):
            d = dims[node]
            x = np.where(d < points.shape[1], points[rows, np.minimum(d, points.shape[1] - 1)], 0.0) if points.shape[1] else np.zeros(len(points))
            node = node * 2 + 1 + (x > values[node])
        return node - ((1 << self.levels) - 1)

    def place(self, vectors: DataFrame) -> DataFrame:
        """vec_id, embedding, leaf: the splits go to the tasks as two arrays, however many levels there are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vecs = [v.values.to_numpy(zero_copy_only=False) for v in b.column(1)]
                leaf = self.leaves(_matrix(vecs, max(map(len, vecs), default=0)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], ["vec_id", "embedding", "leaf"])

        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return rows.mapInArrow(tidied(run), "vec_id long, embedding array<double>, leaf long")


def _loaded(ids, vecs, low: int) -> KDTree:
    """A shard's tree; ``low`` is the most that a query's components may reach for products to stay exact in doubles."""
    width = max(map(len, vecs))
    points = _matrix(vecs, width)
    if np.abs(points).max(initial=0) * low * max(width, 1) >= 2.0**53:
        points = np.array([[int(x) for x in r] for r in points], object)
    return KDTree(np.asarray(ids, np.int64), points)


def _search(batches: Iterator[pa.RecordBatch], k: int, largest: int) -> Iterator[pa.RecordBatch]:
    """Rows come shard by shard, a shard's vectors before the query blocks that visit it: its tree is built once."""
    tree = None
    for batch in batches:
        for row in range(batch.num_rows):
            ids, vecs = batch.column("ids")[row], batch.column("vecs")[row]
            vecs = [v.values.to_numpy(zero_copy_only=False) for v in vecs]
            if batch.column("kind")[row].as_py() == 0:
                tree = _loaded(ids.values.to_numpy(), vecs, largest)
                continue
            width, out = tree.vectors.shape[1], []
            for q, v, floor in zip(ids.as_py(), vecs, batch.column("floors")[row].as_py(), strict=True):
                v = np.r_[v, np.zeros(max(0, width - len(v)))][:width]  # what one of two vectors lacks adds nothing
                v = v if tree.vectors.dtype != object else np.array([int(x) for x in v], object)
                out += [(q, -i, int(s)) for s, i in tree.search(v, q, k, (float("-inf"), float("-inf")) if floor is None else (floor["score"], -floor["vec_id"]))]
            cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score"])


def _visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which shards of a list of boxes may hold a better vector than a query's floor; rows: a query block and a list."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
            shards, lows, highs, floors, homes = get("shards"), get("lows"), get("highs"), get("q_floors"), get("q_homes")
            width = max(map(len, lows))
            low, high = _matrix(lows, width), _matrix(highs, width)
            at, who = [], []
            for i, (v, f, home) in enumerate(zip(get("q_vecs"), floors, homes, strict=True)):
                v = np.r_[np.asarray(v, float), np.zeros(max(0, width - len(v)))][:width]
                # a little above what doubles give, so that rounding leaves no shard out
                best = np.maximum(v * low, v * high).sum(1) + 1e-9 * np.abs(v * np.maximum(np.abs(low), np.abs(high))).sum(1)
                for s in np.flatnonzero(best >= (float("-inf") if f is None else f["score"])):
                    if shards[s] != home:
                        at.append(shards[s])
                        who.append(i)
            ids, vecs = get("q_ids"), get("q_vecs")
            for s in sorted(set(at)):
                mine = [w for a, w in zip(at, who, strict=True) if a == s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.string()), pa.array([[ids[w] for w in mine]], pa.list_(pa.int64())), pa.array([[vecs[w] for w in mine]], pa.list_(pa.list_(pa.float64()))), pa.array([[floors[w] for w in mine]], pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())])))],
                    ["shard", "ids", "vecs", "floors"],
                )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to smaller ids.

    Both frames: vec_id, embedding (integers in double or long; no nulls). Rows with a query's own vec_id are no
    candidates for it. Fewer than k candidates: all of them. Vectors of unequal length meet as if the shorter ended in
    zeros. Rows that repeat an id are candidates of their own; of queries that repeat an id the least vector counts.
    Columns beside these are ignored. Empty frames give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.count()
    # a bounded sample, the same in every run; whatever it holds, every split of space is exact
    share = min(1.0, SAMPLE / max(rows, 1))
    picked = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE).select("embedding").toArrow().column("embedding").to_pylist()
    splits = Splits(_matrix(picked, max(map(len, picked), default=1)), -(-rows // shard_rows))
    placed = splits.place(vectors)
    # leaves that hold many rows, equal vectors among them, are dealt by id
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))  # no more rows than leaves
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    shard = F.concat_ws("-", "leaf", part.cast("string")).alias("shard")
    kept = placed.join(F.broadcast(sizes), "leaf").select("vec_id", "embedding", shard)
    kept = cut(kept.groupBy("shard").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("r")).select("shard", F.col("r.vec_id").alias("ids"), F.col("r.embedding").alias("vecs")), "topk-shards")
    least = splits.place(queries.groupBy("vec_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding")))
    asked = least.join(F.broadcast(sizes), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).select("vec_id", "embedding", shard)
    per = asked.groupBy("shard").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
    asked = cut(asked.join(per, "shard").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("blocks"))).drop("blocks"), "topk-queries")
    largest = vectors.select(F.explode("embedding").alias("x")).agg(F.max(F.abs("x"))).first()[0] or 0
    largest = max(largest, queries.select(F.explode("embedding").alias("x")).agg(F.max(F.abs("x"))).first()[0] or 0)
    floor = "struct<score:bigint,vec_id:bigint>"

    def meet(visits: DataFrame) -> DataFrame:
        """visits: shard, ids, vecs, floors of query blocks. At most ``VISITS`` blocks go to one copy of a shard."""
        visits = visits.withColumn("copy", F.floor((F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("ids"))) - 1) / VISITS))
        copies = visits.select("shard", "copy").distinct()
        none = F.array().cast(f"array<{floor}>")
        trees = kept.join(copies, "shard").select("shard", "copy", F.lit(0).alias("kind"), "ids", "vecs", none.alias("floors"))
        both = trees.unionByName(visits.select("shard", "copy", F.lit(1).alias("kind"), "ids", "vecs", "floors"))
        both = both.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
        with frugal(spark, 8):
            return cut(both.select("kind", "ids", "vecs", "floors").mapInArrow(tidied(lambda it: _search(it, k, largest)), "query_id long, vec_id long, score long"), "topk-hits")

    blocks = lambda df: df.groupBy("shard", "block").agg(F.collect_list(F.struct("vec_id", "embedding", "floor")).alias("q")).select("shard", F.col("q.vec_id").alias("ids"), F.col("q.embedding").alias("vecs"), F.col("q.floor").alias("floors"))
    hits = meet(blocks(asked.withColumn("floor", F.lit(None).cast(floor))))
    shards = kept.count()
    if shards > 1:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        floors = hits.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == k).select(F.col("query_id").alias("vec_id"), F.struct("score", "vec_id").alias("floor"))
        again = blocks(asked.join(floors, "vec_id", "left")).select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("floors").alias("q_floors"), F.transform("ids", lambda _: F.col("shard")).alias("q_homes"))
        lists = -(-shards // BOXES)
        dims = F.sequence(F.lit(0), F.greatest(F.array_max(F.transform("vecs", F.size)) - 1, F.lit(0)))
        side = lambda f: F.transform(dims, lambda d: f(F.transform("vecs", lambda v: F.coalesce(F.get(v, d), F.lit(0.0)))))
        boxes = kept.select("shard", side(F.array_min).alias("low"), side(F.array_max).alias("high"), F.pmod(F.xxhash64("shard"), F.lit(lists)).alias("list"))
        boxes = boxes.groupBy("list").agg(F.collect_list(F.struct("shard", "low", "high")).alias("b")).select("list", F.col("b.shard").alias("shards"), F.col("b.low").alias("lows"), F.col("b.high").alias("highs"))
        # query blocks by lists of boxes, not rows by rows; only queries that a shard can serve go there
        with frugal(spark, 8):
            visits = cut(again.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1)))).join(boxes, "list").drop("list").mapInArrow(tidied(_visited), f"shard string, ids array<long>, vecs array<array<double>>, floors array<{floor}>"), "topk-visits")
        hits = hits.unionByName(meet(visits))
        drop_cut(visits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    drop_cut(asked)
    return ranked.select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of every component; vectors null or with null or non-finite components are left out."""
    x = F.col("embedding")
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    out = vectors.filter(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    return out.select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("embedding"))
