"""An inverted-file index of vectors, and clauses found through it.

Centroids come from a bounded sample; every row is assigned to its nearest one and written to that list's folder. A query
reads only the folders of its nearest lists. With ``probes`` None all lists are read and the answer is exact.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import shortened
from . import retrieval
from .index import _manifest, index_key

# --- fixed values
TOP, CLIP, OVERFETCH = 5, 1200, 3
REGULATION, DOCUMENT_TYPE = "CEI EN 50128", "regulation_clause"
OFF, ON = ("0", "false", "no", "off"), ("1", "true", "yes", "on")
# --- end of fixed values
#: Vectors that centroids are fitted on (at most twice as many are read), rounds of fitting, lists that a query reads.
SAMPLE, ROUNDS, PROBES = 20_000, 12, 8


def gate(flag: str | None, there: bool) -> tuple[bool, str | None]:
    """Whether to look for clauses, and why not: off, on, or as the index is there (any other flag)."""
    flag = (flag or "").strip().lower()
    if flag in OFF:
        return False, "REGULATORY_RAG disabled"
    if flag in ON or there:
        return True, None
    return False, "regulatory index missing (build it first)"


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of a sample of unit vectors; the first ones are rows spread evenly over the sample."""
    rows = np.unique(sample, axis=0)
    centres = rows[np.linspace(0, len(rows) - 1, min(lists, len(rows))).astype(int)] if len(rows) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds if len(rows) else 0):
        own = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


class VectorIndex:
    """Unit vectors (id, embedding) in lists below ``path``."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict, built: bool):
        self.spark, self.path, self.built, self.folder = spark, path, built, manifest["folder"]
        self.centres = np.array(manifest["centres"], float)

    @classmethod
    def open(cls, rows: DataFrame, root: str, lists: int = 64, sample: int = SAMPLE) -> "VectorIndex":
        """The index of ``rows`` (id: a whole number, embedding: a unit vector) below ``root``, built if its key is not there.

        Rows with a ``text`` in place of the embedding are known by it; their vectors (``retrieval.embedded``) are worked
        out for the sample, and once more to be written down.
        """
        spark, hashed = rows.sparkSession, "embedding" not in rows.columns
        rows = rows.select(F.col("id").cast("long").alias("id"), "text" if hashed else "embedding").filter("id is not null")
        rows = rows if hashed else rows.filter("size(embedding) > 0")
        key = index_key(rows if hashed else rows.select("id", F.to_json("embedding").alias("embedding")), lists, sample, *["text"] * hashed)
        path = f"{root.rstrip('/')}/{key}"
        if found := _manifest(spark, path):
            return cls(spark, path, found, False)
        n = int(key.split("-")[1])  # rows
        share = min(1.0, sample / max(n, 1))
        vectors = (lambda r: retrieval.embedded(r, "id")) if hashed else (lambda r: r)
        picked = vectors(rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).limit(2 * sample).collect()
        points = np.array([r.embedding for r in sorted(picked, key=lambda r: r.id)], float)
        centres = centroids(points if len(points) else np.zeros((0, 1)), lists)
        folder = f"lists-{uuid.uuid4().hex}"

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((v @ centres.T).argmax(1) if len(v) else np.zeros(0, np.int64), pa.int64())], ["id", "embedding", "list"])

        vectors(rows).mapInArrow(assign, "id long, embedding array<double>, list long").repartition("list", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("list").parquet(f"{path}/{folder}")
        spark.createDataFrame([(folder, centres.tolist())], "folder string, centres array<array<double>>").coalesce(1).write.mode("ignore").parquet(f"{path}/manifest")
        return cls(spark, path, _manifest(spark, path), True)

    def search(self, queries: DataFrame, k: int, probes: int | None = PROBES) -> DataFrame:
        """query_id, id, score (6 places), rank: the k largest products above 0 of each query (query_id, embedding), a stated set.

        Queries go to every task with the lists that each reads; a task's rows meet, list by list, the queries of their list.
        """
        few = queries.select(F.col("query_id").cast("long").alias("q"), "embedding").limit(retrieval.SEND_QUERIES + 1).collect()
        if len(few) > retrieval.SEND_QUERIES:  # more than are sent at once go in several passes
            passes = -(-2 * queries.count() // retrieval.SEND_QUERIES)
            each = [self.search(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n), k, probes) for n in range(passes)]
            return reduce(DataFrame.unionByName, each)
        ids, matrix = [r.q for r in few], np.array([r.embedding for r in few], float).reshape(len(few), -1)
        asking: dict[int, list[int]] = defaultdict(list)
        fits = len(few) > 0 and matrix.shape[1] == self.centres.shape[1]  # an empty index fits nothing
        near = np.argsort(-(matrix @ self.centres.T), axis=1, kind="stable")[:, : probes or None] if fits else []
        for q, lists in enumerate(near):
            for n in lists.tolist():
                asking[n].append(q)
        by_list = {n: np.array(q) for n, q in asking.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = retrieval.Best(len(ids), k)
            for b in batches:
                v, keys, lists = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column(0).to_numpy(), b.column(2).to_numpy()
                for n in np.unique(lists).tolist():
                    rows, qs = np.flatnonzero(lists == n), by_list[n]
                    for at in range(0, len(rows), max(1, retrieval.CELLS // len(qs))):
                        part = rows[at : at + max(1, retrieval.CELLS // len(qs))]
                        score = matrix[qs] @ v[part].T
                        q, d = np.nonzero(score >= best.enough()[qs, None])
                        best.add(qs[q], score[q, d], keys[part][d])
            yield retrieval._best_rows(ids, best, "query_id", "id")

        rows = self.spark.read.schema("id long, embedding array<double>, list long").parquet(f"{self.path}/{self.folder}").select("id", "embedding", F.col("list").cast("long").alias("list"))
        hits = rows.filter(F.col("list").isin([*by_list]) if by_list else F.lit(False)).mapInArrow(run, "query_id long, id long, score double")
        return retrieval.ranked(hits, "query_id", k, F.desc("score"), F.col("id")).withColumn("score", F.round("score", 6))


def clause_texts(clauses: DataFrame) -> DataFrame:
    """Clauses with an id and a text, each with the text that is indexed: id, title, then its text. id numbers them."""
    trimmed = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("clause_id", "title", "text")}
    rows = clauses.withColumns(trimmed).filter("clause_id <> '' and text <> ''")
    return rows.withColumn("body", F.trim(F.concat(F.col("clause_id"), F.lit(" "), F.col("title"), F.lit("\n"), F.col("text")))).withColumn("id", F.xxhash64(*[c for c in ("doc", "clause_id") if c in rows.columns]))


def retrieve_clauses(queries: DataFrame, clauses: DataFrame, index: VectorIndex, k: int = TOP, clip: int = CLIP, probes: int | None = PROBES) -> DataFrame:
    """query_id, rank, clause_id, title, page_start, score (4 places), text of the best clauses of each query (query_id, text).

    clauses: rows of ``clause_texts``, of which ``index`` holds the vectors. Three times as many hits are reordered by the
    share of the query's words that they hold.
    """
    asked = queries.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.col("query_id").cast("long").alias("query_id"), "text")
    hits = index.search(retrieval.embedded(asked, "query_id"), OVERFETCH * k, probes)
    met = clauses.join(F.broadcast(hits), "id").join(F.broadcast(asked.withColumnRenamed("text", "query_text")), "query_id")  # 3k rows a query
    a, b = retrieval.words(F.col("query_text")), retrieval.words(F.col("body"))
    share = F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    met = met.withColumn("_h", F.round(retrieval.HYBRID[0] * F.col("score") + retrieval.HYBRID[1] * share, retrieval.PLACES))
    met = met.withColumn("_place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_h"), "rank"))).filter(F.col("_place") <= k)
    return met.select("query_id", F.col("_place").alias("rank"), "clause_id", "title", *(["page_start"] if "page_start" in met.columns else []), F.round("_h", 4).alias("score"), shortened(F.col("body"), clip).alias("text"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits (query_id, id) that were found."""
    row = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("f")), ["query_id", "id"], "left").agg(F.count("*").alias("n"), F.count("f").alias("f")).first()
    return row.f / row.n if row.n else 1.0
