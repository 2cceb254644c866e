"""JSON reports within a budget of characters."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType, StructType

from .report import PROFILES

MARK = "[truncated]"


def compact(report: dict | None, most: int, must_keep=(), drop_order=(), extras: dict | None = None, documented: bool = False) -> str:
    """The report as JSON of at most ``most`` characters, dropping fields outside ``must_keep`` one by one.

    Fields go from the last optional one to the first, then from the last of ``drop_order`` to the first; with
    ``documented`` in the opposite order. If what must stay is too long, it stays and a mark says so.
    """
    dump = lambda x: json.dumps(x, ensure_ascii=False)
    if not isinstance(report, dict) or not report:
        text = dump(report or {})
        return text if len(text) <= most else f"{text[:most]}\n{MARK}"
    extras = extras or {}
    left = {k: report[k] for k in must_keep if k in report} | {k: v for k, v in report.items() if k not in must_keep}
    loose = [*drop_order, *(k for k in report if k not in must_keep and k not in drop_order)]
    gone: list[str] = []
    for k in loose if documented else reversed(loose):
        if len(dump(left | extras)) <= most:
            break
        if k in left and k not in must_keep:
            del left[k]
            gone.append(k)
    text = dump(left | extras)
    if gone:
        told = dump({k: left[k] for k in report if k in left} | {"_compaction": {"dropped_fields": gone, "marker": MARK}} | extras)
        text = told if len(told) <= most else text
    return text if len(text) <= most else f"{text}\n{MARK}"


def compacted(reports: DataFrame, most: int, must_keep=(), drop_order=(), key: str = "key", column: str = "report") -> DataFrame:
    """key and the compacted form of each JSON object; what is no object counts as empty."""

    def one(text: str | None) -> str:
        try:
            value = json.loads(text) if text else {}
        except ValueError:
            value = {}
        return compact(value if isinstance(value, dict) else {}, most, must_keep, drop_order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f[key], "compact": [one(x) for x in f[column]]})

    return reports.select(key, column).mapInPandas(run, "key long, compact string")


# --- the same without a loop over JSON: fields and their sizes in arrays, one fold
def dumps(c: Column, kind: DataType) -> Column:
    """A value as JSON text with a space after each comma and colon; nulls, also inside, are null."""
    if isinstance(kind, StringType):
        text = F.to_json(F.array(c))
        out = F.substring(text, F.lit(2), F.length(text) - 2)
    elif isinstance(kind, BooleanType | NumericType):
        out = c.cast("string")
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: dumps(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, StructType):
        out = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), dumps(c[f.name], f.dataType)) for f in kind.fields]), F.lit("}"))
    else:
        out = dumps(c.cast("string"), StringType())
    return F.coalesce(out, F.lit("null"))


def fields(rows: DataFrame, names: list[str]) -> Column:
    """The columns ``names`` as an array of (name, JSON); null ones are not in the report."""
    every = [F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("name"), dumps(F.col(n), rows.schema[n].dataType).alias("json"))) for n in names]
    return F.filter(F.array(*every), lambda x: x.isNotNull())


def _object(parts: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda x: F.concat(F.lit('"'), x["name"], F.lit('": '), x["json"])), ", "), F.lit("}"))


def folded(rows: DataFrame, report: str, most: int, must_keep=(), drop_order=(), extras: str | None = None, into: str = "compact") -> DataFrame:
    """``rows`` with ``compact`` of the report in an array of (name, JSON), by one fold over the fields' sizes.

    Names of ``extras``, another such array, are not in the report. An empty report is ``{}``. Each step is a column of its
    own, so that no expression is worked out twice.
    """
    must, drop = list(must_keep), [d for d in drop_order if d not in must_keep]
    named = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    among = lambda a, names: F.flatten(F.transform(named(names), lambda n: F.filter(a, lambda x: x["name"] == n)))
    out = rows.withColumn("_extras", F.col(extras) if extras else F.array().cast("array<struct<name:string,json:string>>"))
    out = out.withColumns({"_kept": among(F.col(report), must), "_rest": F.filter(report, lambda x: ~x["name"].isin(*must)) if must else F.col(report)})
    optional = F.filter("_rest", lambda x: ~x["name"].isin(*drop)) if drop else F.col("_rest")
    out = out.withColumn("_order", F.reverse(F.concat(among(F.col("_rest"), drop), optional)))
    size = lambda x: F.length(x["name"]) + F.length(x["json"]) + 6  # quotes, colon and space, comma and space
    out = out.withColumn("_total", F.aggregate(F.concat("_kept", "_rest", "_extras"), F.lit(0), lambda s, x: s + size(x)))
    text = lambda total: F.greatest(total - 2, F.lit(0)) + 2
    step = lambda s, x: F.when(text(s["total"]) > most, F.struct((s["total"] - size(x)).alias("total"), (s["n"] + 1).alias("n"))).otherwise(s)
    out = out.withColumn("_n", F.aggregate("_order", F.struct(F.col("_total").alias("total"), F.lit(0).alias("n")), step)["n"])
    out = out.withColumn("_gone", F.transform(F.slice("_order", F.lit(1), F.col("_n")), lambda x: x["name"]))
    stays = lambda a: F.filter(a, lambda x: ~F.array_contains("_gone", x["name"]))
    mark = F.concat(F.lit('{"dropped_fields": ['), F.array_join(F.transform("_gone", lambda g: F.concat(F.lit('"'), g, F.lit('"'))), ", "), F.lit(f'], "marker": "{MARK}"}}'))
    out = out.withColumns({"_plain": _object(F.concat("_kept", stays("_rest"), "_extras")), "_told": F.when(F.col("_n") > 0, _object(F.concat(stays(report), F.array(F.struct(F.lit("_compaction").alias("name"), mark.alias("json"))), "_extras")))})
    out = out.withColumn("_best", F.when(F.length("_told") <= most, F.col("_told")).otherwise(F.col("_plain")))
    best = F.when(F.length("_best") > most, F.concat("_best", F.lit(f"\n{MARK}"))).otherwise(F.col("_best"))
    return out.withColumn(into, F.when(F.size(report) == 0, F.lit("{}")).otherwise(best)).drop("_extras", "_kept", "_rest", "_order", "_total", "_n", "_gone", "_plain", "_told", "_best")


def by_profile(rows: DataFrame, reader: str, name: str, most: int, names: list[str], extras: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``compact``: the columns ``names``, and ``extras`` that are never dropped, as that reader gets the report."""
    must, drop = PROFILES[reader, name]
    given = rows.withColumns({"_report": fields(rows, names), "_more": fields(rows, list(extras))})
    return folded(given, "_report", most, must, drop, "_more").drop("_report", "_more")
