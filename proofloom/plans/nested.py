"""Queries of nested values, reports within budgets, and chunks as table functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import nested, tables
from ..operators.collection import StoredCollection
from ..staging import shared_folder
from .registry import query, table
from .search import BOUNDARY_SQL


def _nested(spark, sf):
    """Documents as nested JSON."""
    d = table(spark, sf, "documents")
    t = lambda a, n: F.substring("text", a, n)
    deep = F.struct(F.col("n_chars").alias("k"), t(41, 12).alias("Text"))
    return d.select("doc_id", F.to_json(F.struct(
        F.col("doc_id").alias("id"), F.struct("lang", F.col("source").alias("note"), deep.alias("deep")).alias("meta"), t(1, 20).alias("title"),
        F.array(F.struct(t(21, 20).alias("text")), F.struct(F.col("lang").alias("text"))).alias("content"), F.lit(" ").alias("blank"),
    )).alias("json"))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""WITH d AS (SELECT doc_id, [{_TRIM.format("substr(text, 1, 20)")}, {_TRIM.format("substr(text, 21, 20)")}, lang, CAST(doc_id AS VARCHAR), source, {_TRIM.format("substr(text, 41, 12)")}, CAST(n_chars AS VARCHAR)] AS l FROM documents)
    SELECT doc_id, array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), '|') AS texts FROM d""")
def nested_texts(spark, sf):
    return nested.nested_texts(_nested(spark, sf), "json", ["doc_id"]).select("doc_id", F.array_join("texts", "|").alias("texts"))


@query("SELECT doc_id, CAST(n_chars AS VARCHAR) AS k, source AS note, lang AS second, NULL AS missing FROM documents")
def nested_path(spark, sf):
    at = lambda p: nested.value_at(F.col("json"), p)
    return _nested(spark, sf).select("doc_id", at("meta.deep.k").alias("k"), at("meta.note").alias("note"), at("content[1].text").alias("second"), at("meta.deep.none.x").alias("missing"))


@query("SELECT doc_id, lang AS title, CASE WHEN doc_id % 2 = 0 THEN source ELSE CAST(doc_id AS VARCHAR) END AS source_id, CAST(n_chars AS VARCHAR) AS n FROM documents")
def metadata_flattening(spark, sf):
    s = lambda c: F.col(c).cast("string")
    base = F.create_map(F.lit("title"), s("lang"), F.lit("source_id"), F.when(F.col("doc_id") % 4 == 0, F.lit("")).when(F.col("doc_id") % 2 == 1, s("doc_id")))
    extra = F.create_map(F.lit("title"), F.lit("other"), F.lit("source_id"), s("source"), F.lit("n"), s("n_chars"))
    m = nested.merged_fields(base, extra)
    return table(spark, sf, "documents").select("doc_id", *[F.element_at(m, F.lit(k)).alias(k) for k in ("title", "source_id", "n")])


@query("""WITH v AS (SELECT vec_id, label FROM embeddings), n AS (SELECT unnest(range(1, 6)) AS version)
    SELECT version, vec_id, CASE WHEN version >= 2 AND vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM v, n WHERE NOT (version >= 3 AND vec_id % 5 = 0) AND NOT (version >= 4 AND label = 2 AND (version < 2 OR vec_id % 3 <> 0))""")
def collection_versions(spark, sf):
    """A stored collection, filled, changed, deleted from by key and by document, compacted; all its versions."""
    v = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    c = StoredCollection(spark, f"{shared_folder(spark)}/proofloom-collections/{uuid.uuid4().hex}", "vec_id")
    c.upsert(v)
    c.upsert(v.filter("vec_id % 3 = 0").withColumn("label", F.col("label") + 100))
    c.delete(v.filter("vec_id % 5 = 0").select("vec_id").unionByName(spark.range(-9, -1).withColumnRenamed("id", "vec_id")))
    c.delete_document("2", "label")
    c.compact()
    out = None
    for n in range(1, 6):
        rows = c.rows(n).select(F.lit(n).cast("long").alias("version"), "vec_id", "label")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- table functions
@query(f"{BOUNDARY_SQL} SELECT lang, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars, CAST(max(k) AS INTEGER) AS last FROM c JOIN documents USING (doc_id) GROUP BY lang")
def chunks_by_table_function(spark, sf):
    tables.register(spark)
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    rows = spark.sql("SELECT * FROM boundary_chunks(TABLE(SELECT * FROM {docs}), 500, 50)", docs=docs)
    return rows.groupBy("lang").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.max("chunk_index").alias("last"))


@query("SELECT doc_id, CAST((length(text) - length(replace(lower(text), 'the', ''))) // 3 AS INTEGER) AS n, CAST(strpos(lower(text), 'the') AS INTEGER) AS first FROM documents WHERE contains(lower(text), 'the')")
def occurrences_by_table_function(spark, sf):
    tables.register(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = spark.sql("SELECT * FROM occurrences(TABLE(SELECT * FROM {docs}), 'The')", docs=docs)
    return rows.select("doc_id", "n", F.element_at("places", 1).alias("first"))
