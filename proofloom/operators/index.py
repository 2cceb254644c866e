"""A text index that is kept in files: chunks, their vectors, and postings by block.

A task that builds it takes its chunks as they come, cuts them into blocks of bounded size, and writes a posting row for
each term and block: the places of its chunks in the block, and how often each holds the term. A block's own row, that of
the empty term, has the chunks' ids and lengths once. Rows lie sorted by term in segments of bounded size, so a query of a
few terms reads only the pages that can hold them. Nothing is shuffled, so building takes no disk beyond the tables.

A query counts its terms' chunks, and then moves its terms' rows once, so that each block is in one task, whole. A task
bounds each block by its terms' largest weights and scores only blocks that can reach its k-th score so far; no term and
no query is a key that many rows share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval

#: Chunks of a block at most, by default and in any case: places are short whole numbers.
BLOCK, MOST = 1024, 1 << 15
#: Pairs of chunk and term from which a segment is written down.
SEGMENT = 1_000_000
#: Terms of queries that Spark's reader is told at most, to leave out pages without them; of more it takes only the range.
FEW = 9
#: Changes with the layout of the files.
VERSION = 2


def index_key(rows: DataFrame, *parameters: object) -> str:
    """A text that changes with any value of any row, with repeats of rows and with the parameters, not with their order."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(rows.columns)]
    h = F.xxhash64(*cols)
    row = rows.select(h.alias("h"), F.pmod(F.xxhash64(F.lit(7), *cols), F.lit(1 << 40)).alias("g")).agg(F.count("*").alias("n"), F.expr("bit_xor(h)").alias("x"), F.sum("g").alias("s")).first()
    return f"v{VERSION}-{row['n']}-{(row['x'] or 0) & (2**64 - 1):016x}-{row['s'] or 0}" + "".join(f"-{p}" for p in parameters)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        rows = spark.read.parquet(f"{path}/manifest").collect()
    except AnalysisException:
        return None
    return rows[0].asDict() if rows else None


_POSTINGS = "term string, block long, n int, places array<short>, tf array<int>, chunk_ids array<long>, lens array<int>"


def _lists(ends: np.ndarray, values: np.ndarray, null: bool = False) -> pa.Array:
    """Lists of ``values`` that end at ``ends``; ``null``: the empty ones are null."""
    at = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(values), mask=pa.array(np.diff(at) == 0) if null else None)


def _segment(parts: list[tuple], first: int, block: int) -> pa.RecordBatch:
    """Posting rows, by term and block, of chunks whose blocks have numbers from ``first`` on."""
    ids, lens = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    before = np.cumsum([0, *(len(p[0]) for p in parts)])
    chunk = np.concatenate([p[2] + n for p, n in zip(parts, before, strict=False)])
    words = pa.concat_arrays([p[4] for p in parts]).dictionary_encode()
    shift = np.cumsum([0, *(len(p[4]) for p in parts)])
    same = words.indices.to_numpy()
    term = np.concatenate([same[p[3] + n] for p, n in zip(parts, shift, strict=False)])
    tf = np.concatenate([p[5] for p in parts]).astype(np.int32)
    names = words.dictionary
    sort = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(sort), np.int64)
    rank[sort] = np.arange(len(sort))

    blocks = -(-len(ids) // block)
    key = rank[term] * blocks + chunk // block
    order = np.argsort(key, kind="stable")  # chunks of a key stay in their order
    key, place, tf = key[order], (chunk[order] % block).astype(np.int16), tf[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(new[1:], len(key)) if len(new) else new
    own = np.minimum(np.arange(1, blocks + 1) * block, len(ids))  # where each block ends among the ids
    size = np.concatenate([np.diff(own, prepend=0), np.diff(ends, prepend=0)])
    terms = pa.concat_arrays([pa.array([""] * blocks, pa.string()), names.take(pa.array(sort[key[new] // blocks])).cast(pa.string())])
    none = np.zeros(blocks, np.int64)
    rest = np.full(len(new), len(ids))
    columns = [
        terms, pa.array(first + np.concatenate([np.arange(blocks), key[new] % blocks])), pa.array(size.astype(np.int32)),
        _lists(np.concatenate([none, ends]), place, True), _lists(np.concatenate([none, ends]), tf, True), _lists(np.concatenate([own, rest]), ids, True), _lists(np.concatenate([own, rest]), lens.astype(np.int32), True),
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "places", "tf", "chunk_ids", "lens"])


def _postings(chunks: DataFrame, block: int) -> DataFrame:
    """Posting rows of chunks (chunk_id, text), in segments; a task's blocks are its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, first = [], 0, TaskContext.get().partitionId() << 32

        def written() -> Iterator[pa.RecordBatch]:
            out = _segment(parts, first, block)
            for at in range(0, out.num_rows, 50_000):
                yield out.slice(at, 50_000)

        for b in batches:
            for part in retrieval.slices(b, 1):
                row, term, tf, lens, words = retrieval.term_columns(part.column(1))
                parts.append((part.column(0).to_numpy(), lens, row, term, words, tf))
                held += len(tf)
                if held >= SEGMENT:
                    yield from written()
                    first += -(-sum(len(p[0]) for p in parts) // block)
                    parts, held = [], 0
        if parts:
            yield from written()

    return chunks.select("chunk_id", "text").mapInArrow(run, _POSTINGS)


class TextIndex:
    """An index at ``path``. ``built`` tells whether opening it had to build it."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict, built: bool):
        self.spark, self.path, self.built = spark, path, built
        self.docs, self.mean, self.folder = manifest["docs"], manifest["mean"], manifest["folder"]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.folder}/{name}")

    @property
    def chunks(self) -> DataFrame:
        """The chunks as they were given."""
        return self._table("chunks")

    @property
    def vectors(self) -> DataFrame:
        """chunk_id, embedding: worked out where the index was opened for terms only."""
        return self._table("vectors") if self.path.endswith("-vectors") else retrieval.embedded(self.chunks, "chunk_id")

    @property
    def ready(self) -> bool:
        return self.docs > 0 and self.mean > 0

    @classmethod
    def open(cls, chunks: DataFrame, root: str, block: int = BLOCK, vectors: bool = True) -> "TextIndex":
        """The index of ``chunks`` below ``root``: what is there if its key fits, else built and written once.

        chunks: chunk_id (a whole number, not null) and text, and whatever else is to be kept. Tables are written to a
        folder of their own first and the manifest last, so an index that was cut short is never read; of two that are
        built at once the first manifest counts. Without ``vectors`` it holds chunks and postings only.
        """
        spark = chunks.sparkSession
        path = f"{root.rstrip('/')}/{index_key(chunks, block, retrieval.BUCKETS, 'vectors' if vectors else 'terms')}"
        found = _manifest(spark, path)
        if found is not None:
            return cls(spark, path, found, False)
        folder = f"tables-{uuid.uuid4().hex}"
        at = f"{path}/{folder}"

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.option("compression", "zstd").parquet(f"{at}/{name}")
            return spark.read.parquet(f"{at}/{name}")

        kept = written(chunks, "chunks")
        if vectors:
            written(retrieval.embedded(kept, "chunk_id"), "vectors")
        postings = written(_postings(kept.filter("chunk_id is not null").withColumn("chunk_id", F.col("chunk_id").cast("long")), min(block, MOST)), "postings")
        own = postings.filter("term = ''").select("n", F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms"))
        total = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
        row = spark.createDataFrame([(folder, int(total.docs), total.terms / max(total.docs, 1))], "folder string, docs long, mean double")
        try:
            row.coalesce(1).write.mode("error").parquet(f"{path}/manifest")
        except AnalysisException:  # another one was first
            pass
        return cls(spark, path, _manifest(spark, path), True)

    def bm25(self, queries: DataFrame, k: int, query: str = "query_id", doc: str = "chunk_id") -> DataFrame:
        """query, doc, score (6 places), rank: as ``retrieval.bm25``, without a look at any text of a chunk."""
        asked = retrieval.asked_terms(queries, query)
        if asked is None:
            return retrieval.bm25(queries, self.chunks, k, query, "chunk_id").withColumnRenamed("chunk_id", doc)
        spark, kinds = self.spark, f"{query} long, {doc} long, score double"
        if not asked.terms or not self.docs:
            return spark.createDataFrame([], kinds + ", rank int")
        terms = spark.createDataFrame([("", -1), *asked.number.items()], "term string, no int")
        rows = self._table("postings")
        rows = rows.filter(F.col("term").isin(["", *asked.terms])) if len(asked.terms) <= FEW else rows
        posted = rows.join(F.broadcast(terms), "term")
        df = {r.no: r.df for r in posted.filter("no >= 0").groupBy("no").agg(F.sum("n").alias("df")).collect()}
        worth = np.array([retrieval.idf(self.docs, df.get(t, 0)) for t in range(len(asked.terms))])
        return retrieval.ranked(self._scored(posted, asked, worth, k, query, doc), query, k, F.desc("score"), F.col(doc)).withColumn("score", F.round("score", 6))

    def _scored(self, posted: DataFrame, asked: "retrieval.Asked", worth: np.ndarray, k: int, query: str, doc: str) -> DataFrame:
        """The k best of each query and task."""
        mean, ids, number = self.mean, asked.ids, len(asked.ids)
        rows = posted.select("block", "no", "places", "tf", "chunk_ids", "lens").repartition(F.xxhash64("block")).sortWithinPartitions("block", "no")

        def settle(held: list[pa.RecordBatch], best: "retrieval.Best") -> None:
            known, lens = (held[0].column(i).slice(0, 1).flatten().to_numpy() for i in (4, 5))  # the block's own row comes first
            row, size, place, tf = (np.concatenate(x) for x in zip(*((b.column(1).to_numpy(), pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False), b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()) for b in held), strict=True))
            row, size = row[1:], size[1:]
            if not len(row):
                return
            no, place = np.repeat(row, size), place.astype(np.int64)
            weight = worth[no] * retrieval.weights(tf, lens[place], mean)
            # what the block can score at most
            peak = np.maximum.reduceat(weight, np.cumsum(size) - size)
            n = asked.start[row + 1] - asked.start[row]
            holder = asked.query[np.repeat(asked.start[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            mask = np.bincount(holder, np.repeat(peak, n), number) >= best.enough() - 1e-9
            if not mask.any():
                return
            order = np.lexsort((no, place))
            for q, d, s in asked.scores(place[order], no[order], weight[order], len(known)):
                best.add(q[mask[q]], s[mask[q]], known[d[mask[q]]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, now, held = retrieval.Best(number, k), None, []
            for b in batches:
                blocks = b.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)] if len(blocks) else [0]
                for at, end in zip(cuts, cuts[1:], strict=False):
                    if held and blocks[at] != now:
                        settle(held, best)
                        held.clear()
                    now = blocks[at]
                    held.append(b.slice(at, end - at))
            if held:
                settle(held, best)
            yield retrieval._best_rows(ids, best, query, doc)

        return rows.mapInArrow(run, f"{query} long, {doc} long, score double")
