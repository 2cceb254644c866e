"""Clauses from the lines of a regulation: noise lines, carried headings, merged groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse

HEADER = r"^\s*(\d+(?:\.\d+)*)\s+(\S.*)$"


def lines(pages: DataFrame, key: str, text: str = "text", noise: str | None = None) -> DataFrame:
    """key, line_no, line: lines with white space collapsed; blank and noise lines are left out but keep their number."""
    out = pages.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", collapse("line")).filter("line <> ''")
    return out.filter(~F.col("line").rlike(noise)) if noise else out


def grouped(rows: DataFrame, key: str, header: Column) -> DataFrame:
    """clause_no and heading of each line: a line that is a header opens a clause, lines before the first have number 0."""
    order = Window.partitionBy(key).orderBy("line_no")
    out = rows.withColumn("_h", F.coalesce(header, F.lit(False)))
    return out.withColumns({"clause_no": F.sum(F.col("_h").cast("int")).over(order), "heading": F.last(F.when(F.col("_h"), F.col("line")), True).over(order), "next_line": F.lead("line").over(order)}).drop("_h")


def body(rows: DataFrame, key: str) -> DataFrame:
    """Clauses: key, clause_no, title, text of their lines, how many."""
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return rows.filter("clause_no > 0").groupBy(key, "clause_no").agg(F.first("heading").alias("title"), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x["line"]), " ").alias("text"), F.count("*").alias("n_lines"))


def meaningful(title: Column) -> Column:
    """A title with two letters or more, no dot leaders."""
    return ~title.rlike(r"^[\d\W]*$") & ~title.rlike(r"\.{4,}") & (F.length(F.regexp_replace(title, r"[^\p{L}]", "")) >= 2)


def merged(clauses: DataFrame, by: str, title: str, text: str, page: str) -> DataFrame:
    """One row a clause id: longest meaningful title, first page, distinct texts longest first."""
    ok = F.when(meaningful(F.col(title)), F.col(title))
    texts = F.collect_set(F.struct((-F.length(collapse(text))).alias("n"), collapse(text).alias("t")))
    return clauses.groupBy(by).agg(F.max_by(ok, F.struct(F.length(ok), ok)).alias("title"), F.min(page).alias("page_start"), F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(F.sort_array(texts), lambda x: x["t"]), "\n"), 256).alias("text_sha256"), F.size(texts).alias("texts"))


def cleanup(clauses: DataFrame, by: str) -> DataFrame:
    """One row of counters: rows, ids, ids that repeat, extra rows."""
    return clauses.groupBy(by).agg(F.count("*").alias("n")).agg(F.sum("n").alias("raw_rows"), F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("extra_rows"))
