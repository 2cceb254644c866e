"""A vector collection as a table: upsert, delete, filters, search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import dense_top_k


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """New rows in place of old ones with their key; of new rows with one key the last. Empty embeddings are skipped."""
    if "embedding" in new.columns:
        new = new.filter(F.size("embedding") > 0)
    if order:
        new = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def delete(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``ids``; unknown ids are ignored."""
    return old.join(ids.select(key).distinct(), key, "left_anti")


def exact_filter(filters: dict) -> Column:
    """All named columns equal their values as texts."""
    out = F.lit(True)
    for k, v in filters.items():
        out = out & (F.col(k).cast("string") == F.lit(str(v)))
    return out


def date_filter(names: list[str], low: str | None = None, high: str | None = None) -> Column:
    """The first non-empty of the columns as a time within inclusive bounds; missing or unreadable ones do not pass."""
    at = F.try_to_timestamp(F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names]))
    out = at.isNotNull()
    if low:
        out = out & (at >= F.lit(low).cast("timestamp"))
    if high:
        out = out & (at <= F.lit(high).cast("timestamp"))
    return F.coalesce(out, F.lit(False))


def tag_filter(tags: str, wanted: list[str]) -> Column:
    """Any tag in common; a lone text is one tag."""
    wanted = [wanted] if isinstance(wanted, str) else list(wanted)
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False))


# --- fixed values
AFTER_SEARCH = ("date_range", "source_type", "tags")
DATES = ("date", "created_at", "timestamp", "datetime")
# --- end of fixed values


def split_filters(filters: dict | None) -> tuple[dict, dict]:
    """Filters of plain columns, which come before a search, and those that hits are held against after it."""
    filters = filters or {}
    return {k: v for k, v in filters.items() if k not in AFTER_SEARCH}, {k: v for k, v in filters.items() if k in AFTER_SEARCH}


def post_filter(filters: dict, columns: list[str]) -> Column:
    """date_range (start, end, both inclusive, either may be missing), source_type and tags (any in common).

    Without a column that a filter asks for nothing passes it; an empty filter lets all pass.
    """
    out = F.lit(True)
    if span := filters.get("date_range"):
        names = [c for c in DATES if c in columns]
        out = out & (date_filter(names, span.get("start"), span.get("end")) if names else F.lit(False))
    if kind := filters.get("source_type"):
        out = out & (F.coalesce(F.col("source_type") == kind, F.lit(False)) if "source_type" in columns else F.lit(False))
    if tags := filters.get("tags"):
        out = out & (tag_filter("tags", tags) if "tags" in columns else F.lit(False))
    return out


@dataclass(frozen=True)
class Collection:
    """A table of chunks with vectors; every change gives a new collection."""

    rows: DataFrame
    key: str = "vec_id"
    metric: str = "cosine"

    def add(self, new: DataFrame, order: str | None = None) -> "Collection":
        return Collection(upsert(self.rows, new, self.key, order), self.key, self.metric)

    def remove(self, ids: DataFrame) -> "Collection":
        return Collection(delete(self.rows, ids, self.key), self.key, self.metric)

    def remove_document(self, document: str, column: str = "document_id") -> "Collection":
        return Collection(self.rows.filter(~F.col(column).cast("string").eqNullSafe(F.lit(document))), self.key, self.metric)

    def search(self, queries: DataFrame, k: int = 10, filters: dict | None = None, min_score: float | None = None) -> DataFrame:
        """Filters of plain columns come before the search, so that they reach the scan."""
        hits = dense_top_k(queries, self.rows.filter(exact_filter(filters)) if filters else self.rows, k, self.metric)
        return hits if min_score is None else hits.filter(F.col("score") >= min_score)

    def health(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimension")).withColumn("ready", F.col("vectors") > 0)
