"""Digests, evidence rows, auditor reports, consolidated report and release decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import enums
from . import governance

# --- fixed values
#: Fields that a compacted report keeps, and those that go first, by reader and report.
PROFILES = {
    ("lead", "pre_isa"): (("overall", "release_readiness", "inputs_digest", "verdict_digests", "summary_for_vdd_short"), ("citations", "fingerprints", "schema_version", "mode", "compiled_at", "evidence_chain_text", "derogation_context")),
    ("lead", "matcher"): (("status", "summary", "severity_counts", "anomaly_digests"), ("notes", "source_files", "retrieval", "test_log_snippets", "normalized_requirements")),
    ("detective", "matcher"): (("status", "summary", "severity_counts", "anomaly_digests"), ("retrieval", "notes", "source_files", "test_log_snippets", "normalized_requirements")),
    ("detective", "derogation"): (("overall", "matches", "summary"), ("citations", "evidence_chain_text", "notes")),
}
AUDITOR_FALLBACK = ("PARTIAL", 50)
DETECTIVE_FALLBACK = ("SUSPICIOUS", "HIGH")
NARRATIVE = 2400
# --- end of fixed values


def _cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(default))


def anomaly_digest(rid: Column, severity: Column, kind: Column, detail: Column) -> Column:
    """One line: id or -, severity, type, detail of at most 160 characters."""
    return F.rtrim(F.concat_ws(" | ", _or(rid, "-"), enums.normalise(severity), _or(kind, "UNKNOWN"), _cut(F.trim(F.coalesce(detail, F.lit(""))), 160)), F.lit(" |"))


def verdict_digest(rid: Column, severity: Column, verdict: Column, reason: Column) -> Column:
    return F.rtrim(F.concat_ws(" | ", _or(rid, "-"), enums.normalise(severity), enums.normalise(verdict, enums.VERDICT), _cut(F.trim(F.coalesce(reason, F.lit(""))), 140)), F.lit(" |"))


def evidence(anomalies: DataFrame | None = None, hits: DataFrame | None = None, overall: DataFrame | None = None, auditor: DataFrame | None = None, detective: DataFrame | None = None) -> DataFrame:
    """(evidence_id, text, source_type) of the reports that are given; blank texts are left out.

    anomalies: ord, type, severity, requirement_id, detail, evidence_snippet; hits: ord, pattern_id, strength, source,
    snippet (the first five); overall: overall, summary_text; auditor and detective: kind, ord, text.
    """
    parts = []
    name = lambda prefix: F.concat(F.lit(prefix), F.col("ord").cast("string"))
    if anomalies is not None:
        parts.append(anomalies.select(name("matcher-anomaly-").alias("evidence_id"), F.concat_ws(" ", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("type", "severity", "requirement_id", "detail", "evidence_snippet")]).alias("text"), F.lit("traceability_matcher").alias("source_type")))
    if overall is not None:
        parts.append(overall.select(F.lit("derogation-scan-summary").alias("evidence_id"), F.btrim(F.concat_ws(": ", "overall", "summary_text"), F.lit(": ")).alias("text"), F.lit("derogation_scan").alias("source_type")))
    if hits is not None:
        parts.append(hits.filter("ord <= 5").select(name("derogation-hit-").alias("evidence_id"), F.concat_ws(" ", "pattern_id", "strength", "source", "snippet").alias("text"), F.lit("derogation_scan").alias("source_type")))
    for df, source in ((auditor, "auditor_report"), (detective, "detective_report")):
        if df is not None:
            parts.append(df.select(F.concat(F.lit(source.split("_")[0] + "-"), "kind", F.lit("-"), F.col("ord").cast("string")).alias("evidence_id"), F.col("text"), F.lit(source).alias("source_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.trim("text") != "")


def auditor_report(raw: DataFrame, score: str = "compliance_score") -> DataFrame:
    """Reports with a known assessment, a score from 0 to 100, and lists without blank entries."""
    assessment = F.when(F.col("overall_assessment").isin("COMPLIANT", "PARTIAL", "NON_COMPLIANT"), F.col("overall_assessment")).otherwise("PARTIAL")
    out = raw.withColumns({"overall_assessment": assessment, score: F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.col(score).cast("string").try_cast("double").cast("int"), F.lit(0))))})
    for c in ("requirements_found", "risks", "recommendations"):
        if c in raw.columns:
            out = out.withColumn(c, F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    return out


def focused(docs: DataFrame, most: int) -> DataFrame:
    """path and the text of a parsed document within ``most`` characters: title, headings, paragraphs, then tables."""
    heads = F.array_join(F.transform(F.slice("headings", 1, 30), lambda h: F.concat(F.lit("  "), F.repeat(F.lit("  "), h["level"] - 1), h["text"])), "\n")
    header = F.concat_ws("\n", F.when(F.col("title") != "", F.concat(F.lit("DOCUMENT TITLE: "), "title")), F.when(F.size("headings") > 0, F.concat(F.lit("\nKEY SECTIONS:\n"), heads)))
    prefix = F.concat(header, F.lit("\n\nFULL PARAGRAPH TEXT (all non-empty paragraphs):\n"))
    paragraphs = F.array_join(F.filter("paragraphs", lambda p: F.trim(p) != ""), "\n\n")
    tables = F.array_join(F.transform("tables", lambda r: F.array_join(F.transform(r, lambda c: F.substring(c, 1, 400)), "  |  ")), "\n")
    rows = docs.select("path", prefix.alias("p"), paragraphs.alias("t"), tables.alias("b"))
    budget = F.lit(most - 40) - F.length("p")
    whole = F.concat("p", "t")
    rest = F.lit(most - 30) - F.length(whole)
    with_tables = F.concat(whole, F.lit("\n\nTABLES (all rows, flattened):\n"), F.substring("b", F.lit(1), rest), F.when(F.length("b") > rest, "\n[truncated tables]").otherwise(""))
    text = (
        F.when(budget <= 0, F.concat("p", F.lit("\n[truncated]")))
        .when(F.length("t") > budget, F.concat("p", F.substring("t", F.lit(1), budget), F.lit("\n[truncated paragraphs]")))
        .when((rest > 0) & (F.col("b") != ""), with_tables)
        .otherwise(whole)
    )
    return rows.select("path", F.substring(text, 1, most).alias("content"))


def fallback_auditor(reports: DataFrame) -> DataFrame:
    """Auditor's reports, and where one has no assessment the one that stands in for it: partial, half the score."""
    assessment, score = AUDITOR_FALLBACK
    none = F.trim(F.coalesce("overall_assessment", F.lit(""))) == ""
    return reports.withColumns({"mode": F.when(none, "fallback").otherwise("model"), "overall_assessment": F.when(none, assessment).otherwise(F.col("overall_assessment")), "compliance_score": F.when(none, F.lit(score)).otherwise(F.col("compliance_score"))})


def fallback_detective(messages: DataFrame) -> DataFrame:
    """The triage of messages (found, filtered) without a model: suspicious and high where any message has an alarm word, else clear and low."""
    status, level = DETECTIVE_FALLBACK
    n = F.coalesce(F.sum("found"), F.lit(0))
    return messages.agg(F.when(n > 0, status).otherwise("CLEAR").alias("status"), F.when(n > 0, level).otherwise("LOW").alias("risk_level"), n.alias("alarms"))


def consolidated(gates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: the overall gate, counts, narrative and release decision.

    gates: one row of matcher, regulatory, detective, auditor, derogation, derogation_needed (texts, one number); what is
    missing counts as its pessimistic default. verdicts: requirement_id, severity (or, where that is null or empty,
    matcher_severity), verdict of each anomaly.
    """
    high = (enums.severity_of("severity", "matcher_severity") if "matcher_severity" in verdicts.columns else enums.normalise("severity")) == "HIGH"
    v = enums.normalise("verdict", enums.VERDICT)
    n = verdicts.agg(
        F.count("*").alias("anomalies"), F.count_if(high).alias("high"), F.count_if(v == "JUSTIFICATION_SIGNALS").alias("justified"), F.coalesce(F.bool_or(high & (v == "RED_FLAG")), F.lit(False)).alias("high_red"),
        F.coalesce(F.bool_or(high & (v == "REVIEW")), F.lit(False)).alias("high_review"), F.coalesce(governance.worst_verdict(), F.lit("NONE")).alias("worst_verdict"),
    )
    out = gates.crossJoin(n)  # one row by one row
    out = out.withColumn("overall", governance.overall_gate(F.col("matcher"), F.col("regulatory"), F.col("detective"), F.col("high_red"), F.col("high_review")))
    told = F.concat_ws(
        " ",
        F.concat(F.lit("Pre-ISA consolidated assessment: overall="), "overall", F.lit(".")),
        F.concat(F.lit("Traceability matcher status="), _or(F.col("matcher"), "UNKNOWN"), F.lit("; regulatory gate status="), _or(F.col("regulatory"), "UNKNOWN"), F.lit("; communications triage status="), _or(F.col("detective"), "UNKNOWN"), F.lit("; derogation language scan="), _or(F.col("derogation"), "UNKNOWN"), F.lit(".")),
        F.when(F.col("high") > 0, F.concat(F.lit("High-severity traceability anomalies reviewed: "), F.col("high").cast("string"), F.lit("; with formal justification signals: "), F.col("justified").cast("string"), F.lit("."))),
    )
    decision = governance.release_gate(F.col("matcher"), F.col("regulatory"), F.col("detective"), F.col("auditor"), F.col("derogation_needed"), F.col("high_red"))
    return out.withColumns({"summary_for_vdd": F.substring(told, 1, NARRATIVE), "final_decision": decision, "safety_override": F.col("high_red")})
