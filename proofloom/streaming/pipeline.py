"""Files that arrive, parsed, cut into chunks, embedded and kept: batch or stream, each file once.

What fails goes to a table of its own with the reason, and counts of files, documents, chunks and failures come from the
same pass over the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, context, retrieval
from ..operators.collection import StoredCollection, Version
from ..operators.store import exact_filter, post_filter, split_filters
from ..sources import mixed
from ..staging import settled

FILES = "path string, modificationTime timestamp, length long, content binary"


#: Hits for one that is wanted, before filters and reordering.
OVERFETCH = 3


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 500
    chunk_overlap: int = 50
    #: An object with ``dimension`` and ``embed``; hashed word counts without one.
    embedder: object = None


def chunks_of(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """chunk_id (document and number), document_id, chunk_index, total_chunks, text, embedding and the document's fields."""
    numbered = docs.withColumn("doc_id", F.xxhash64("document_id"))  # only to carry a number through the chunker
    parts = chunking.boundary_chunks(numbered.select("doc_id", F.col("content").alias("text")), settings.chunk_size, settings.chunk_overlap)
    fields = numbered.select("doc_id", "document_id", "source_type", "source_id", "title", "author", "created_at", "tags", "extra_fields")
    rows = parts.join(fields, "doc_id").withColumn("_k", F.xxhash64("document_id", "chunk_index")).withColumnRenamed("chunk", "text")
    rows = rows.withColumns({"chunk_id": F.concat_ws(":", "document_id", "chunk_index"), "position": F.format_string("%d of %d", F.col("chunk_index") + 1, F.col("total_chunks")), "chunk_chars": F.length("text")})
    vectors = retrieval.embedded(rows, "_k", embedder=settings.embedder)
    return rows.join(vectors, "_k").drop("_k", "doc_id", "start")


class DocumentStore:
    """Documents in a stored collection below ``root``, with a table of files that failed."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        self.collection = StoredCollection(spark, f"{self.root}/chunks")

    def add(self, parsed: DataFrame, batch: tuple[str, int] | None = None) -> dict:
        """Stores what ``mixed.parsed`` gave. Returns counts: files, documents, failed, chunks, and the version.

        The same documents again change nothing but the version; a batch that is there already is left out as a whole.
        """
        base = self.collection.version()
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return {"files": 0, "documents": 0, "failed": 0, "chunks": 0, "version": base.number}
        seen = Observation()
        counted = parsed.observe(seen, F.count("*").alias("files"), F.count_if(F.col("error").isNull()).alias("documents"), F.count_if(F.col("error").isNotNull()).alias("failed"))
        kept = settled(counted)
        failed = kept.filter("error is not null").select("path", "kind", "error", F.lit(batch[1] if batch else None).cast("long").alias("batch"))
        name = f"{batch[0]}-{batch[1]}" if batch else f"version-{base.number + 1}"
        failed.write.mode("overwrite").parquet(f"{self.root}/failed/{name}")
        told = Observation()
        rows = chunks_of(mixed.documents(kept), self.settings).observe(told, F.count("*").alias("chunks"))
        version = self.collection.upsert(rows, base=base, batch=batch)
        return seen.get | told.get | {"version": version.number}

    def add_files(self, path: str, glob: str | None = None) -> dict:
        return self.add(mixed.read(self.spark, path, glob))

    def add_emails(self, mails: DataFrame) -> dict:
        """Messages as rows: source_id, subject, from_addr, to_addr (list), body."""
        extra = F.to_json(F.struct("subject", "from_addr", F.array_join("to_addr", ", ").alias("to_addr")))
        return self.add(mails.select(F.col("source_id").alias("path"), F.lit("eml").alias("kind"), F.coalesce("body", F.lit("")).alias("content"), F.col("subject").alias("title"), F.nullif(F.trim("from_addr"), F.lit("")).alias("author"), F.lit(None).cast("timestamp").alias("created_at"), extra.alias("extra"), F.lit(None).cast("string").alias("error")))

    def failures(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/failed/*")

    def search(self, queries: DataFrame, k: int = 5, filters: dict | None = None) -> DataFrame:
        """query_id, rank, score and the chunks of each query (query_id, text).

        Filters of plain columns come before the search; date_range, source_type and tags after it, on three times as many
        hits, which are then put in order by likeness and shared words.
        """
        before, after = split_filters(filters)
        rows = self.collection.rows().withColumn("_k", F.xxhash64("chunk_id"))
        rows = rows.filter(exact_filter(before)) if before else rows
        found = retrieval.vector_top_k(retrieval.embedded(queries, "query_id", embedder=self.settings.embedder), rows.select("_k", "embedding"), OVERFETCH * k, "query_id", "_k")
        met = found.join(rows.drop("embedding"), "_k").filter(post_filter(after, rows.columns))
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").alias("query_text"))
        best = retrieval.hybrid(met.join(asked, "query_id"), k)
        return best.drop("_k", "score", "first_rank", "query_text").withColumnRenamed("hybrid", "score")

    def query(self, queries: DataFrame, k: int = 5, max_tokens: int = 2000) -> DataFrame:
        """query_id, context (blocks of the best chunks within a budget of tokens) and how many blocks it has."""
        hits = self.search(queries, k)
        hits = hits.withColumn("block", context.block(F.col("source_id"), F.col("chunk_index"), F.col("total_chunks"), F.col("score"), F.col("text")))
        return context.context(context.budgeted(hits, "query_id", "rank", max_tokens), "query_id", "rank")

    def delete_chunks(self, ids: DataFrame) -> Version:
        return self.collection.delete(ids)

    def delete_document(self, document_id: str) -> Version:
        return self.collection.delete_document(document_id)

    def health(self) -> dict:
        return self.collection.health()

    def follow(self, path: str, checkpoint: str, name: str = "files", files: int = 1000) -> StreamingQuery:
        """Stores files as they arrive below ``path``, ``files`` at a time at most; ends when all that are there are in.

        A batch that is run again after a fault finds its number in the collection and changes nothing.
        """

        def step(batch: DataFrame, number: int) -> None:
            DocumentStore(batch.sparkSession, self.root, self.settings).add(mixed.parsed(batch), (name, number))

        stream = self.spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(path)
        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
