"""A collection of chunks that is stored: segments, tombstones and numbered versions.

A version is a small file that names the segments and tombstones that make it up; it is created under its number or not at
all, so of two writers that began from the same version the second is refused. Rows are never changed in place: an upsert
writes a segment and tombstones for the keys that older segments hold, a deletion writes tombstones. Reading is a scan of
the segments without the rows that a later tombstone names. Older versions stay readable; ``compact`` writes one segment
of the live rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import dense_top_k
from .store import exact_filter

#: Tombstones that are sent to all tasks at most; beyond, a join shuffles.
SEND_TOMBSTONES = 500_000


class Conflict(RuntimeError):
    """Another writer has made the next version first."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    segments: tuple[str, ...] = ()
    tombstones: tuple[str, ...] = ()
    #: The last batch of each stream that is in it.
    batches: dict[str, int] = field(default_factory=dict)


class StoredCollection:
    """The collection below ``root``. ``key`` names a row; rows have ``embedding``, empty ones are skipped."""

    def __init__(self, spark: SparkSession, root: str, key: str = "chunk_id", metric: str = "cosine"):
        self.spark, self.root, self.key, self.metric = spark, root.rstrip("/"), key, metric
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # --- versions
    def _numbers(self) -> list[int]:
        at = self._path(f"{self.root}/versions")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _load(self, number: int) -> Version | None:
        stream = self._fs.open(self._path(f"{self.root}/versions/{number}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            d = json.loads(text)
        except ValueError:  # its writer has not ended
            return None
        return Version(d["number"], tuple(d["segments"]), tuple(d["tombstones"]), d["batches"])

    def version(self, number: int | None = None) -> Version:
        """A version, the last one unless a number is given."""
        if number is not None:
            return Version() if number == 0 else self._load(number)
        for n in reversed(self._numbers()):
            if found := self._load(n):
                return found
        return Version()

    def _commit(self, base: Version, segments: tuple[str, ...], tombstones: tuple[str, ...], batches: dict | None = None) -> Version:
        new = Version(base.number + 1, segments, tombstones, batches or base.batches)
        try:
            out = self._fs.create(self._path(f"{self.root}/versions/{new.number}.json"), False)
        except Py4JJavaError as fault:
            raise Conflict(f"version {new.number} is there already") from fault
        try:
            out.write(json.dumps({"number": new.number, "segments": segments, "tombstones": tombstones, "batches": new.batches}).encode())
        finally:
            out.close()
        return new

    def _write(self, rows: DataFrame, kind: str, number: int) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        rows.withColumn("_v", F.lit(number)).write.parquet(f"{self.root}/{name}")
        return name

    # --- reading
    def _live(self, v: Version, *columns: str) -> DataFrame | None:
        if not v.segments:
            return None
        read = lambda names: self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{n}" for n in names])
        rows = read(v.segments)
        rows = rows.select(*columns, "_v") if columns else rows
        if not v.tombstones:
            return rows
        gone = read(v.tombstones).groupBy(self.key).agg(F.max("_v").alias("_gone"))
        gone = F.broadcast(gone) if read(v.tombstones).count() <= SEND_TOMBSTONES else gone
        return rows.join(gone, self.key, "left").filter("_gone is null or _v >= _gone").drop("_gone")

    def rows(self, number: int | None = None) -> DataFrame:
        """The rows of a version; an empty collection has no columns but the key."""
        live = self._live(self.version(number))
        return self.spark.createDataFrame([], f"{self.key} string") if live is None else live.drop("_v")

    # --- changes
    def upsert(self, new: DataFrame, order: str | None = None, base: Version | None = None, batch: tuple[str, int] | None = None) -> Version:
        """Rows in place of those with their key; of new rows of one key the last by ``order`` (else any one).

        ``batch`` names a stream and its batch: one that is in the collection already changes nothing.
        """
        base = base or self.version()
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return base
        new = new.filter(F.col(self.key).isNotNull() & (F.size("embedding") > 0))
        turn = Window.partitionBy(self.key).orderBy(F.desc(order) if order else F.lit(1))
        new = new.withColumn("_r", F.row_number().over(turn)).filter("_r = 1").drop("_r")
        segment = self._write(new, "segments", base.number + 1)
        tombstones = base.tombstones
        live = self._live(base, self.key)
        if live is not None:  # only keys are read, of both sides
            again = self.spark.read.parquet(f"{self.root}/{segment}").select(self.key).join(live.select(self.key), self.key, "left_semi")
            tombstones += (self._write(again, "tombstones", base.number + 1),)
        batches = {**base.batches, batch[0]: batch[1]} if batch else None
        return self._commit(base, (*base.segments, segment), tombstones, batches)

    def delete(self, ids: DataFrame, base: Version | None = None) -> Version:
        """Without the rows of these keys; unknown keys do nothing."""
        base = base or self.version()
        live = self._live(base, self.key)
        if live is None:
            return base
        gone = live.select(self.key).join(ids.select(self.key), self.key, "left_semi").distinct()
        return self._commit(base, base.segments, (*base.tombstones, self._write(gone, "tombstones", base.number + 1)))

    def delete_document(self, document: str, column: str = "document_id", base: Version | None = None) -> Version:
        base = base or self.version()
        live = self._live(base, self.key, column)
        return base if live is None else self.delete(live.filter(F.col(column).cast("string") == F.lit(document)).select(self.key), base)

    def compact(self, base: Version | None = None) -> Version:
        """One segment of the live rows and no tombstones; versions before stay as they are."""
        base = base or self.version()
        live = self._live(base)
        if live is None:
            return base
        return self._commit(base, (self._write(live.drop("_v"), "segments", base.number + 1),), ())

    # --- use
    def search(self, queries: DataFrame, k: int = 10, filters: dict | None = None, min_score: float | None = None, number: int | None = None) -> DataFrame:
        """query_id, key, score, rank of the rows most like each query (vec_id, embedding); filters come before the search."""
        rows = self.rows(number)
        rows = (rows.filter(exact_filter(filters)) if filters else rows).select(F.col(self.key).alias("vec_id"), "embedding")
        hits = dense_top_k(queries, rows, k, self.metric, others=False).withColumnRenamed("vec_id", self.key)
        return hits if min_score is None else hits.filter(F.col("score") >= min_score)

    def health(self) -> dict:
        """version, rows, dimensions (more than one is a fault), ready."""
        v = self.version()
        live = self._live(v, self.key, "embedding")
        if live is None:
            return {"version": v.number, "rows": 0, "dimensions": [], "ready": False}
        sizes = live.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).limit(100).collect()
        return {"version": v.number, "rows": sum(r.n for r in sizes), "dimensions": sorted(r.d for r in sizes), "ready": len(sizes) == 1}
