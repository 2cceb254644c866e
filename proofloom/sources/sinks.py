"""Outputs: audit bundles, traces, clause and rule files, document context rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: characters that a preview keeps
PREVIEWS = {"emails": 12_000, "logs": 6_000, "corpus": 8_000, "authorizations": 4_000}
MARK = "\n...[truncated]"
# --- end of fixed values


def preview(c: Column, kind: str) -> Column:
    most = PREVIEWS[kind]
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(MARK))).otherwise(c)


def audit_bundle(parts: dict[str, DataFrame], sample: int = 12) -> DataFrame:
    """One row with a JSON object: how many rows each part has, and the first ``sample`` of them in their column order.

    Parts are reports of bounded size; each is cut to ``sample`` rows before it is gathered.
    """
    out = None
    for name, df in parts.items():
        first = df.orderBy(*df.columns).limit(sample).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name))
        one = first.crossJoin(df.agg(F.count("*").alias(f"{name}_rows")))  # one row by one row
        out = one if out is None else out.crossJoin(one)
    return out.select(F.to_json(F.struct(*out.columns)).alias("bundle"))


def write_trace(rows: DataFrame, path: str) -> None:
    """The three columns of a trace as CSV with a header."""
    rows.select("requirement_id", "title", "verification_status").write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def placeholders(row: DataFrame) -> DataFrame:
    """(placeholder, value) of a one-row context, as a document template fills them in."""
    names = row.columns
    pairs = F.explode(F.array(*[F.struct(F.lit("{{" + n + "}}").alias("placeholder"), F.col(n).cast("string").alias("value")) for n in names]))
    return row.select(pairs.alias("p")).select("p.*")
