"""CSV, JSON and plain text inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import blank_to_null

# --- fixed values: header spellings of the id
ID_HEADERS = ("requirement_id", "Requirement ID", "id")
# --- end of fixed values


def requirements_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a trace: every column trimmed, nulls empty; rows without id or with an id that begins with # are left out.

    Header names are trimmed and lose a byte order mark; the id comes from the first of its spellings that is not blank.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    raw = raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in raw.columns])
    ids = [blank_to_null(F.col(f"`{c}`")) for c in ID_HEADERS if c in raw.columns]
    if not ids:
        return raw.limit(0)
    return raw.withColumn("requirement_id", F.coalesce(*ids)).filter(F.col("requirement_id").isNotNull() & ~F.col("requirement_id").startswith("#"))


def test_logs_json(spark: SparkSession, path: str) -> DataFrame:
    """Test logs, one object a file; a file that is no object gives a row of nulls."""
    return spark.read.schema(schemas.TEST_LOG).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def log_results(logs: DataFrame) -> DataFrame:
    """requirement_id, result, ord: the results of logs in their order."""
    return logs.select(F.posexplode("requirement_results").alias("ord", "r")).select("r.requirement_id", "r.result", "ord")


def clauses_json(spark: SparkSession, path: str) -> DataFrame:
    """Clauses with an id and a text."""
    rows = spark.read.schema(schemas.CLAUSE).option("multiLine", True).json(path)
    return rows.filter(blank_to_null("clause_id").isNotNull() & blank_to_null("text").isNotNull())


def rules_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RULE).option("multiLine", True).json(path).filter("rule_id is not null")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file; a byte order mark chooses the encoding, UTF-8 otherwise."""
    files = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 3))
    text = (
        F.when(head == "EFBBBF", F.decode(F.expr("substring(content, 4)"), "UTF-8"))
        .when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode("content", "UTF-16"))
        .otherwise(F.expr("try_validate_utf8(decode(content, 'UTF-8'))"))
    )
    return files.select("path", F.coalesce(text, F.lit("")).alias("text"))


def text_lines(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, line_no, line of each text."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def evidence_corpus(body: DataFrame, sidecar: DataFrame, ids: DataFrame, least: int = 80) -> DataFrame:
    """Lines (doc, line_no, line) of the body, and of the sidecar too if the body is short or lacks an id."""
    chars = body.agg(F.coalesce(F.sum(F.length("line")), F.lit(0))).first()[0]
    few = ids.select("requirement_id").distinct()
    found = body.join(F.broadcast(few), F.lower("line").contains(F.lower("requirement_id"))).select("requirement_id").distinct()
    covered = few.join(found, "requirement_id", "left_anti").isEmpty()
    rows = body.select(F.lit(0).alias("doc"), "line_no", "line")
    return rows if chars >= least and covered else rows.unionByName(sidecar.select(F.lit(1).alias("doc"), "line_no", "line"))
