"""Requirements against evidence lines and logs: outcomes, anomalies, summary, envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FAIL_LINE, PASS_LINE, normalise_status
from ..staging import settled
from . import needles

# --- fixed values
VERIFIED = ("VERIFIED", "VALIDATED", "APPROVED", "COMPLETE")
SNIPPET = 300
QUERY_HEAD = ("CEI EN 50128", "railway software safety", "traceability", "verification", "evidence", "derogation", "deviation", "failed test")
QUERY_WORDS, QUERY_CHARS = 8, 480
# --- end of fixed values


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value of each key; blank keys and values do not count. One pass, combined before the shuffle."""
    named = rows.select(F.upper(F.trim(F.col(key).cast("string"))).alias(key), F.upper(F.trim(value)).alias(value), order).filter((F.col(key) != "") & (F.col(value) != ""))
    return named.groupBy(key).agg(F.max_by(value, order).alias(value))


def keyed_outcomes(requirements: DataFrame, lines: DataFrame, key: str, line: str, order: str, fail: Column, good: Column) -> DataFrame:
    """Outcome and first line of each requirement whose lines are found by key: FAIL beats PASS beats UNKNOWN."""
    found = lines.groupBy(key).agg(F.bool_or(fail).alias("_fail"), F.bool_or(good).alias("_pass"), F.min_by(line, order).alias("snippet"))
    out = F.when(F.col("_fail").isNull(), "NOT_FOUND").when(F.col("_fail"), "FAIL").when(F.col("_pass"), "PASS").otherwise("UNKNOWN")
    return requirements.join(found, key, "left").withColumn("outcome", out).withColumn("snippet", F.substring("snippet", 1, SNIPPET)).drop("_fail", "_pass")


def substring_outcomes(requirements: DataFrame, lines: DataFrame, word: bool = False) -> DataFrame:
    """Outcome of each requirement whose id occurs in a line, in any case. lines: doc, line_no, line.

    All ids are looked for in one look at each line, however many they are; without ``word`` an id is found inside longer
    ones too. Requirements without an id are not found.
    """
    hits = needles.find(requirements.select(F.col("requirement_id").alias("needle")), lines, ["doc", "line_no", "line"], text="line", word=word)
    found = hits.groupBy("needle").agg(F.bool_or(F.col("line").rlike(FAIL_LINE)).alias("_fail"), F.bool_or(F.col("line").rlike(PASS_LINE)).alias("_pass"), F.min_by(F.trim("line"), F.struct("doc", "line_no")).alias("snippet"))
    out = F.when(F.col("_fail").isNull(), "NOT_FOUND").when(F.col("_fail"), "FAIL").when(F.col("_pass"), "PASS").otherwise("UNKNOWN")
    return requirements.join(found, F.lower("requirement_id") == F.col("needle"), "left").select(*requirements.columns, out.alias("outcome"), F.substring("snippet", 1, SNIPPET).alias("snippet"))


def merged_outcome(direct: Column, retrieved: Column) -> tuple[Column, Column]:
    """The outcome that counts and where it comes from; retrieval only fills what the exact scan leaves open."""
    fallback = (direct.isin("UNKNOWN") & retrieved.isin("PASS", "FAIL")) | (direct.isin("NOT_FOUND") & retrieved.isin("PASS", "FAIL", "UNKNOWN"))
    return F.when(fallback, retrieved).otherwise(direct), F.when(fallback, "retrieval_fallback").otherwise("exact_corpus_scan")


def anomalies(matched: DataFrame, verified=VERIFIED) -> DataFrame:
    """Anomalies of rows (requirement_id, status, outcome, snippet, log_result, ord), one row each, with their slot."""
    status = normalise_status("status")
    sure, rid = status.isin(*verified), F.col("requirement_id").cast("string")

    def found(when, slot, kind, severity, detail, snippet=None):
        snippet = F.lit(None).cast("string") if snippet is None else snippet
        return F.when(when, F.struct(F.lit(slot).alias("slot"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), detail.alias("detail"), snippet.alias("evidence_snippet")))

    o, log, snippet = F.col("outcome"), F.col("log_result"), F.col("snippet")
    every = F.array(
        found(sure & (o == "NOT_FOUND"), 1, "MISSING_TEST_DESIGN_EVIDENCE", "HIGH", F.concat(F.lit("Requirement "), rid, F.lit(" is "), status, F.lit(" in trace CSV but not found in test evidence corpus."))),
        found(sure & (o == "FAIL"), 2, "DOC_EVIDENCE_FAIL", "HIGH", F.concat(F.lit("Test design evidence shows FAIL for "), rid, F.lit(" while CSV marks it verified.")), snippet),
        found(sure & (o == "UNKNOWN"), 3, "WEAK_VERIFICATION_SIGNAL", "MEDIUM", F.concat(F.lit("Requirement "), rid, F.lit(" referenced in corpus but no explicit PASS/FAIL token nearby.")), snippet),
        found((log == "FAIL") & (o == "PASS"), 4, "LOG_FAIL_VS_DOC_PASS", "HIGH", F.lit("Execution logs record FAIL while test-design excerpt shows PASS."), snippet),
        found((log == "FAIL") & sure, 5, "LOG_FAIL_VS_VERIFIED_REQUIREMENT", "HIGH", F.lit("Structured logs report FAIL for a requirement marked Verified in the trace matrix.")),
    )
    return matched.filter(F.trim(rid) != "").withColumn("_a", F.explode(F.filter(every, lambda a: a.isNotNull()))).select("requirement_id", "ord", "_a.*")


def numbered(rows: DataFrame, order: list[str], prefix: str = "a-", digits: int = 4, column: str = "anomaly_id") -> DataFrame:
    """Numbers rows in order, from 1: ranges are sorted each by itself and moved on by the sizes of those before.

    Rows are written down before they are dealt out, so what makes them is worked out once, and once more in their ranges.
    """
    placed = settled(settled(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each range
    before, at = [], 0
    for p, n in sizes:
        before.append((p, at))
        at += n
    base = rows.sparkSession.createDataFrame(before, "_part long, _base long")
    met = placed.withColumn("_part", part).join(F.broadcast(base), "_part")
    return met.withColumn(column, F.format_string(f"{prefix}%0{digits}d", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1)).drop("_at", "_part", "_base")


def status_of(high: Column, every: Column) -> Column:
    return F.when(high > 0, "RED_FLAG").when(every > 0, "WARNING").otherwise("PASS")


def summary(matched: DataFrame, found: DataFrame, failed_tests: int = 0) -> DataFrame:
    """One row of counts and the overall status. Failed tests of the log metrics add one HIGH anomaly."""
    extra = 1 if failed_tests > 0 else 0
    total = matched.agg(F.count("*").alias("total_requirements"), F.count_if(F.col("outcome") != "NOT_FOUND").alias("with_document_hit"))
    n = found.agg((F.count("*") + extra).alias("anomalies_count"), (F.count_if(F.col("severity") == "HIGH") + extra).alias("high_severity_count"), F.count_if(F.col("severity") == "MEDIUM").alias("medium_severity_count"))
    out = total.crossJoin(n).withColumn("metrics_failed_tests", F.lit(failed_tests).cast("long"))  # one row by one row
    return out.withColumn("status", status_of(F.col("high_severity_count"), F.col("anomalies_count")))


def fingerprint(found: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 of the sorted anomaly lines of each group; a null id reads None."""
    row = F.struct(F.trim("anomaly_id"), F.trim("type"), F.upper(F.trim("severity")), F.trim(F.coalesce(F.col("requirement_id").cast("string"), F.lit("None"))), F.trim("detail"))
    lines = F.transform(F.sort_array(F.collect_list(row)), lambda r: F.concat_ws("|", *[r[f"col{k}"] for k in range(1, 6)]))
    return found.groupBy(*by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


def envelope(found: DataFrame, by: list[str], status: Column | None = None) -> DataFrame:
    """Primary ids, type counts, human summary and status of each group of anomalies."""
    first = found.filter((F.col("severity") == "HIGH") & (F.trim(F.col("requirement_id").cast("string")) != "")).groupBy(*by, F.upper(F.trim(F.col("requirement_id").cast("string"))).alias("_u")).agg(F.min(F.struct("ord", "slot", F.trim(F.col("requirement_id").cast("string")).alias("id"))).alias("f"))
    ids = first.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["id"]), ", ").alias("primary_requirement_ids"))
    kinds = found.groupBy(*by, "type").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("type_counts"))
    n = found.groupBy(*by).agg(F.count_if(F.col("severity") == "HIGH").alias("high"), F.count("*").alias("anomalies"))
    out = n.join(kinds, by).join(ids, by, "left").withColumn("status", status_of(F.col("high"), F.col("anomalies")))
    text = F.concat_ws(" ", F.when(F.col("primary_requirement_ids").isNotNull(), F.concat(F.lit("High-severity traceability anomalies involve requirement(s): "), F.col("primary_requirement_ids"), F.lit("."))), F.concat(F.lit("Recorded anomaly classes: "), F.col("type_counts"), F.lit(".")), F.concat(F.lit("Overall traceability matcher status: "), F.col("status"), F.lit(".")))
    return out.withColumn("human_summary", text)


def retrieval_query(found: DataFrame, by: list[str], failed_tests: int | None = None) -> DataFrame:
    """``by`` and retrieval_query: fixed words, primary ids, then each anomaly's type and first words of its detail, each once.

    found: ord, slot, requirement_id, type, severity, detail. The text has 480 characters at most, so of a group's words
    only the first few hundred are brought together.
    """
    rid = F.trim(F.col("requirement_id").cast("string"))
    high = found.filter((F.col("severity") == "HIGH") & (rid != "")).select(*by, F.struct(F.lit(0).alias("a"), "ord", "slot", F.lit(0).alias("p")).alias("o"), rid.alias("w"))
    words = F.slice(F.regexp_extract_all(F.coalesce("detail", F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), 1, QUERY_WORDS)
    said = F.concat(F.array(F.replace(F.trim(F.coalesce("type", F.lit(""))), F.lit("_"), F.lit(" "))), words)
    told = found.select(*by, "ord", "slot", F.posexplode(said).alias("p", "w")).select(*by, F.struct(F.lit(1).alias("a"), "ord", "slot", "p").alias("o"), "w")
    once = high.unionByName(told).filter("w <> ''").groupBy(*by, F.lower("w").alias("_k")).agg(F.min(F.struct("o", "w")).alias("f")).filter(~F.col("_k").isin(*[w.lower() for w in QUERY_HEAD]))
    kept = once.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("f.o"))).filter(F.col("_r") <= QUERY_CHARS)
    text = F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["w"]), " ")
    tail = [] if failed_tests is None else [F.lit(f"failed_tests_{failed_tests}")]
    out = kept.groupBy(*by).agg(text.alias("t"))
    return out.select(*by, F.trim(F.substring(F.concat_ws(" ", F.lit(" ".join(QUERY_HEAD)), "t", *tail), 1, QUERY_CHARS)).alias("retrieval_query"))


def covers(ids: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """One row: how many ids there are, how many no line has, and whether all are covered."""
    missing = ids.join(lines.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("missing"))
    return ids.agg(F.count("*").alias("ids")).crossJoin(missing).withColumn("covered", F.col("missing") == 0)  # one row by one row


def merged_trace(existing: DataFrame, incoming: DataFrame, default_status: str = "PLANNED") -> DataFrame:
    """Existing rows with the incoming title where an id matches, then new ids. Both: requirement_id, title, verification_status."""
    key = F.upper(F.trim("requirement_id"))
    new = incoming.withColumn("_k", key).groupBy("_k").agg(F.max_by("title", "requirement_id").alias("_title"), F.min("requirement_id").alias("_id"))
    kept = existing.withColumn("_k", key).join(new.select("_k", "_title"), "_k", "left")
    kept = kept.select("requirement_id", F.coalesce(F.nullif("_title", F.lit("")), "title").alias("title"), "verification_status")
    added = new.join(existing.select(key.alias("_k")).distinct(), "_k", "left_anti").select(F.col("_id").alias("requirement_id"), F.col("_title").alias("title"), F.lit(default_status).alias("verification_status"))
    return kept.unionByName(added)


def id_sort_key(c: str = "requirement_id") -> list[Column]:
    """Text before the first hyphen, trailing number, whole id."""
    return [F.substring_index(c, "-", 1), F.coalesce(F.regexp_extract(c, r"(\d+)$", 1).try_cast("int"), F.lit(0)), F.col(c)]
