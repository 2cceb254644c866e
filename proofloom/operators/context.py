"""Context blocks: order, diversity, token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate

SUFFIX = "\n[TRUNCATED: max_tokens reached]"


def block(name: Column, index: Column, total: Column, score: Column, body: Column) -> Column:
    """A source's header, text and end mark; indices outside their range are mended."""
    k = F.greatest(index, F.lit(0)) + 1
    n = F.greatest(total, F.lit(1), k)
    return F.format_string("[Source: %s, chunk %d/%d, score %.4f]\n%s\n---", F.coalesce(name, F.lit("unknown")), k, n, score, F.trim(body))


def diversified(hits: DataFrame, by: str, source: str, *order: Column) -> DataFrame:
    """place: sources take turns, best first, in the order of their best hits."""
    turn = F.row_number().over(Window.partitionBy(by, source).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    hits = hits.withColumns({"_turn": turn, "_place": place})
    first = F.min("_place").over(Window.partitionBy(by, source))
    hits = hits.withColumn("_first", first)
    return hits.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_turn", "_first"))).drop("_turn", "_place", "_first")


def truncated(c: Column, tokens: Column) -> Column:
    most = tokens * 4
    n = len(SUFFIX)
    return F.when(F.length(c) <= most, c).when(most <= n + 3, F.substring(c, F.lit(1), most)).otherwise(F.concat(F.rtrim(F.substring(c, F.lit(1), most - n - 3)), F.lit("..." + SUFFIX)))


def budgeted(blocks: DataFrame, by: str, place: str, max_tokens: int) -> DataFrame:
    """Blocks while they fit; the first that does not is cut to what is left, and ends the context. blocks: block."""
    if max_tokens <= 0:
        raise ValueError("max_tokens must be greater than zero")
    rows = blocks.withColumn("tokens", token_estimate(F.col("block")))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    rows = rows.withColumn("used", before).filter(F.col("used") < max_tokens)
    fits = F.col("used") + F.col("tokens") <= max_tokens
    return rows.withColumn("kept", F.rtrim(F.when(fits, F.col("block")).otherwise(truncated(F.col("block"), F.lit(max_tokens) - F.col("used")))))


def context(kept: DataFrame, by: str, place: str) -> DataFrame:
    """One text a query: its blocks in order, joined by line feeds."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), F.col("kept").alias("t"))))
    return kept.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("context"), F.count("*").alias("blocks"))
