"""Retrieval metrics and comparison with expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def per_query(hits: DataFrame, relevant: DataFrame, ks=(1, 3, 5, 10), query: str = "query_id", item: str = "vec_id") -> DataFrame:
    """Reciprocal rank, hit, precision and recall at each k of every query that has relevant items."""
    total = relevant.groupBy(query).agg(F.count("*").alias("relevant"))
    return measured(hits.join(relevant.select(query, item, F.lit(1).alias("good")), [query, item], "left"), total, ks, query)


def measured(marked: DataFrame, total: DataFrame, ks=(1, 3, 5, 10), query: str = "query_id") -> DataFrame:
    """The same of hits that are marked (good 1 or null, rank), given how many relevant items each query has (relevant)."""
    cols = [F.round(F.coalesce(1.0 / F.min(F.when(F.col("good") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("rr")]
    for k in ks:
        cols.append(F.count_if((F.col("good") == 1) & (F.col("rank") <= k)).alias(f"_n{k}"))
    out = total.join(marked.groupBy(query).agg(*cols), query, "left").fillna(0)
    for k in ks:
        out = out.withColumns({f"hit_{k}": (F.col(f"_n{k}") > 0).cast("int"), f"p_{k}": F.round(F.col(f"_n{k}") / k, 6), f"r_{k}": F.round(F.col(f"_n{k}") / F.col("relevant"), 6)})
    return out.drop(*[f"_n{k}" for k in ks])


def means(rows: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    names = ["rr", *[f"{m}_{k}" for k in ks for m in ("hit", "p", "r")]]
    return rows.agg(F.count("*").alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def compared(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected and actual texts of each key, equal if the same in upper case without margins; null equals null."""
    norm = lambda c: F.upper(F.trim(c))
    met = expected.join(actual, key, "left")
    return met.withColumn("ok", norm(F.col("expected")).eqNullSafe(norm(F.col("actual"))))


def accuracy(rows: DataFrame) -> DataFrame:
    n, ok = F.count("*"), F.count_if("ok")
    return rows.agg(n.alias("checks"), ok.alias("passed"), F.when(n == 0, 1.0).otherwise(F.round(ok / n, 6)).alias("accuracy"))


def golden_checks(audits: DataFrame, expected: DataFrame, ids: DataFrame | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """key, kind (deterministic, soft, id), name, expected, actual, ok of every check of a golden scenario.

    audits: key, audit (JSON); expected: key, path (field names with dots), expected, soft. Values are equal if the same in
    upper case without margins; a missing one equals an empty text. ids: key, id, wanted (must or must not be there);
    anomalies: key, requirement_id. Scenarios without an audit have nothing that was expected.
    """
    norm = lambda c: F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    # a path is data, so the value comes from the path's steps one after the other
    met = expected.join(audits, "key", "left")
    steps = F.split("path", r"\.")
    actual = F.aggregate(steps, F.col("audit"), lambda at, step: F.from_json(at, "map<string,string>")[step])
    checks = met.withColumn("actual", actual).select("key", F.when(F.col("soft"), "soft").otherwise("deterministic").alias("kind"), F.col("path").alias("name"), norm(F.col("expected")).alias("expected"), norm(F.col("actual")).alias("actual"))
    checks = checks.withColumn("ok", F.col("expected") == F.col("actual"))
    if ids is None:
        return checks
    there = anomalies.select("key", norm(F.col("requirement_id")).alias("name")).filter("name <> ''").distinct().withColumn("_there", F.lit(True))
    named = ids.select("key", norm(F.col("id")).alias("name"), "wanted").filter("name <> ''").join(there, ["key", "name"], "left")
    seen = F.coalesce("_there", F.lit(False))
    word = lambda c: F.when(c, "present").otherwise("absent")
    return checks.unionByName(named.select("key", F.lit("id").alias("kind"), "name", word(F.col("wanted")).alias("expected"), word(seen).alias("actual"), (seen == F.col("wanted")).alias("ok")))


def golden_summary(checks: DataFrame, strict_soft: bool = False) -> DataFrame:
    """One row a key: accuracy of deterministic and id checks, of soft ones (1 without any), and the exit status."""
    soft = F.col("kind") == "soft"
    share = lambda w: F.when(F.count_if(w) == 0, 1.0).otherwise(F.round(F.count_if(w & F.col("ok")) / F.count_if(w), 6))
    bad = ~F.col("ok") & (F.lit(True) if strict_soft else ~soft)
    return checks.groupBy("key").agg(F.count_if(~soft).alias("checks"), share(~soft).alias("accuracy"), share(soft).alias("soft_accuracy"), F.max(bad.cast("int")).alias("exit_status"))


def golden_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text, relevant (ids in upper case) of a JSON list of {id, query, relevant_requirement_ids | relevant_clause_ids}.

    Entries without id, query or relevant ids are left out.
    """
    kinds = "id string, query string, relevant_requirement_ids array<string>, relevant_clause_ids array<string>"
    rows = spark.read.option("multiLine", "true").schema(kinds).json(path)
    ids = F.coalesce("relevant_requirement_ids", "relevant_clause_ids", F.array().cast("array<string>"))
    ids = F.array_distinct(F.filter(F.transform(ids, lambda x: F.upper(F.trim(x))), lambda x: F.coalesce(x, F.lit("")) != ""))
    return rows.select(F.trim("id").alias("query_id"), F.trim("query").alias("text"), ids.alias("relevant")).filter("query_id <> '' and text <> '' and size(relevant) > 0")


def by_id_or_text(hits: DataFrame, golden: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """Metrics of each query, a hit being relevant by its id or by an id in its text. hits: query_id, rank, id, text.

    golden: query_id, relevant. rr, hit_k, p_k (relevant hits over k), r_k (ids found over ids); queries without hits have
    zeros. Several ids may be found by one hit, and one id by several.
    """
    met = golden.select("query_id", "relevant").join(hits, "query_id", "left")
    low = F.upper(F.coalesce("text", F.lit("")))
    own = F.upper(F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    found = F.filter("relevant", lambda r: (r == own) | low.contains(r))
    met = met.withColumn("_f", found).withColumn("_good", F.size("_f") > 0)
    cols = [F.round(F.coalesce(1.0 / F.min(F.when(F.col("_good"), F.col("rank"))), F.lit(0.0)), 6).alias("rr")]
    for k in ks:
        top = F.col("rank") <= k
        cols += [
            F.max(F.coalesce((F.col("_good") & top).cast("int"), F.lit(0))).alias(f"hit_{k}"), F.round(F.count_if(F.col("_good") & top) / k, 4).alias(f"p_{k}"),
            F.round(F.size(F.array_distinct(F.flatten(F.collect_list(F.when(top, F.col("_f")))))) / F.first(F.size("relevant")), 4).alias(f"r_{k}"),
        ]
    return met.groupBy("query_id").agg(*cols)
