"""Justification language around anomalies, verdicts and gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import enums

# --- fixed values: pattern, name, strength; scores by strength
PATTERNS = (
    (r"\bapproved\s+derogation\b", "approved_derogation", "strong"),
    (r"\bformal\s+deviation\s+approved\b", "formal_deviation_approved", "strong"),
    (r"\b(deviation|exception)\s+approved\b", "deviation_or_exception_approved", "strong"),
    (r"\bwaiver\s+(granted|approved)\b", "waiver_granted_or_approved", "strong"),
    (r"\bccb\b.{0,80}\b(approv|agreed|accepted)\b", "ccb_approval_language", "strong"),
    (r"\bconfiguration\s+control\b.{0,120}\b(approv|accept)\b", "configuration_control_approval", "strong"),
    (r"\b(sign[- ]?off|signoff)\b.{0,60}\b(recorded|complete|obtained)\b", "signoff_recorded", "strong"),
    (r"\bofficially\s+accepted\s+risk\b", "officially_accepted_risk", "strong"),
    (r"\bderogation\b", "derogation_mentioned", "medium"),
    (r"\b(waiver|deviation|exception)\b.{0,40}\b(request|pending)\b", "waiver_or_deviation_request", "medium"),
    (r"\baccepted\s+risk\b", "accepted_risk_phrase", "medium"),
    (r"\bqa\s+lead\b.{0,40}\b(sign|approv|accept)\b", "qa_lead_signoff_language", "medium"),
    (r"\b(workaround|bypass)\b", "workaround_or_bypass", "risk"),
    (r"\b(skip|disabled)\b.{0,40}\b(test|hil|check)\b", "skip_or_disable_tests", "risk"),
    (r"\bmanual(ly)?\b.{0,40}\b(kubectl|apply)\b", "manual_kubectl_apply", "risk"),
    (r"\bjust\s+to\s+pass\b", "just_to_pass_language", "risk"),
)
SCORES = {"strong": 3, "medium": 1, "risk": -2}
#: Words that make a message worth reading.
ALARMS = ("workaround", "bypass", "disabled", "temporary", "manually", "not integrated", "new function", "false positive", "skip tests", "ignore warning")
RADIUS, HEAD, BEFORE, AFTER, SNIPPET, PARENT = 280, 3500, 40, 80, 220, 800
NOTHING = "No anomalies detected in text."
# --- end of fixed values


@F.pandas_udf(ArrayType(IntegerType()))
def _places(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """Places (from 1) of each needle in its text, in any case, from left to right without overlaps."""
    out = []
    for text, needle in zip(texts, needles, strict=True):
        low, n, found = (text or "").lower(), (needle or "").strip().lower(), []
        at = low.find(n) if n else -1
        while at >= 0:
            found.append(at + 1)
            at = low.find(n, at + len(n))
        out.append(found)
    return pd.Series(out, dtype=object)


def occurrences(rows: DataFrame, needle: Column, text: str = "text", radius: int = RADIUS, head: int | None = None) -> DataFrame:
    """One row for each occurrence of ``needle``, in any case: at (from 1) and the window of ``radius`` around its start.

    Rows without a needle have none, or with ``head`` one window: that many characters of their text's head, at null.
    """
    blank = F.trim(F.coalesce(needle, F.lit(""))) == ""
    out = rows.filter(~blank).withColumn("at", F.explode(_places(F.col(text), needle)))
    low_at = F.greatest(F.lit(1), F.col("at") - radius)
    out = out.withColumn("window", F.trim(F.replace(F.substring(F.col(text), low_at, F.col("at") + radius - low_at), F.lit("\n"), F.lit(" "))))
    if head is None:
        return out
    body = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    return out.unionByName(rows.filter(blank & (body != "")).withColumn("at", F.lit(None).cast("int")).withColumn("window", F.substring(body, 1, head)))


def signals(windows: DataFrame, patterns=PATTERNS, window: str = "window") -> DataFrame:
    """One row for the first match of each pattern in each window: pattern_id, strength, base_score, snippet, parent."""
    w = F.col(window)
    found = [F.when(F.regexp_like(w, F.lit("(?i)" + p)), F.struct(F.lit(k).alias("ord"), F.lit(name).alias("pattern_id"), F.lit(strength).alias("strength"), F.lit(SCORES[strength]).alias("base_score"), F.regexp_instr(w, F.lit("(?i)" + p)).alias("first"), F.length(F.regexp_substr(w, F.lit("(?i)" + p))).alias("n"))) for k, (p, name, strength) in enumerate(patterns)]
    out = windows.withColumn("_s", F.explode(F.filter(F.array(*found), lambda s: s.isNotNull())))
    start = F.greatest(F.lit(1), F.col("_s.first") - BEFORE)
    snippet = F.substring(F.trim(F.substring(w, start, F.col("_s.first") + F.col("_s.n") + AFTER - start)), 1, SNIPPET)
    return out.withColumns({"ord": F.col("_s.ord"), "pattern_id": F.col("_s.pattern_id"), "strength": F.col("_s.strength"), "base_score": F.col("_s.base_score"), "snippet": snippet, "parent": F.substring(w, 1, PARENT)}).drop("_s")


def scored(hits: DataFrame, by: list[str], order: list[str], patterns=PATTERNS) -> DataFrame:
    """justification_score, hits and has_strong of each anomaly, repeats of pattern, source and snippet left out."""
    strong = "|".join(f"({p})" for p, _, s in patterns if s == "strong") or "(?!)"
    seen = Window.partitionBy(*by, "pattern_id", "source", F.substring("snippet", 1, 100)).orderBy(*order)
    once = hits.withColumn("_r", F.row_number().over(seen)).filter("_r = 1")
    worth = F.when((F.col("strength") == "risk") & F.regexp_like("parent", F.lit("(?i)" + strong)), 0).otherwise(F.col("base_score"))
    return once.groupBy(*by).agg(F.sum(worth).cast("int").alias("justification_score"), F.count("*").alias("hits"), F.bool_or(F.col("strength") == "strong").alias("has_strong"))


def derogation_overall(best: Column, hits: Column) -> Column:
    return F.when(F.coalesce(best, F.lit(0)) >= 4, "STRONG_SIGNALS").when((F.coalesce(best, F.lit(0)) >= 2) | (hits > 0), "WEAK_SIGNALS").otherwise("NO_SIGNALS")


def verdict(severity: Column, score: Column, strong: Column) -> Column:
    strong = F.coalesce(strong, F.lit(False))
    return F.when(F.upper(severity) != "HIGH", "TRACKED").when((score >= 4) & strong, "JUSTIFICATION_SIGNALS").when((score >= 2) | strong, "REVIEW").otherwise("RED_FLAG")


def rationale(v: Column, kind: Column, score: Column) -> Column:
    head = F.concat(F.lit("High-severity anomaly ("), F.coalesce(kind, F.lit("unknown type")), F.lit(") "))
    n = F.concat(F.lit("(score="), score.cast("string"), F.lit(")"))
    return (
        F.when(v == "JUSTIFICATION_SIGNALS", F.concat(head, F.lit("co-locates with strong governance / approval language in communications or authorizations "), n, F.lit(". Human ISA must still confirm scope and validity.")))
        .when(v == "REVIEW", F.concat(head, F.lit("has partial justification signals "), n, F.lit("; independent review recommended before release.")))
        .when(v == "RED_FLAG", F.concat(head, F.lit("lacks adequate documented justification in scanned emails and authorizations "), n, F.lit(".")))
        .otherwise("Non-high severity item tracked for completeness in the pre-ISA bundle.")
    )


def overall_gate(matcher: Column, regulatory: Column, detective: Column, high_red: Column, high_review: Column) -> Column:
    m, r = enums.normalise(matcher, enums.STATUS_GATE), enums.normalise(regulatory, enums.STATUS_GATE)
    d = enums.normalise(detective, enums.DETECTIVE_STATUS)
    return (
        F.when((m == "RED_FLAG") | (r == "RED_FLAG"), "RED_FLAG")
        .when((d == "SUSPICIOUS") | (m == "WARNING") | (r == "WARNING") | high_red | high_review, "REVIEW_REQUIRED")
        .otherwise("CLEAR")
    )


def release_gate(matcher: Column, regulatory: Column, detective: Column, auditor: Column, derogations: Column, high_red: Column, strict: bool = False) -> Column:
    """NO-GO or GO; what is missing counts as its pessimistic default. strict: an ERROR of the triage blocks too."""
    or_ = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    d = enums.normalise(or_(detective, "SUSPICIOUS"), enums.DETECTIVE_STATUS)
    no = (
        F.coalesce(high_red, F.lit(False)) | (enums.normalise(or_(matcher, "WARNING"), enums.STATUS_GATE) == "RED_FLAG") | (enums.normalise(or_(regulatory, "RED_FLAG"), enums.STATUS_GATE) == "RED_FLAG")
        | (F.coalesce(derogations, F.lit(0)) > 0) | (d == "SUSPICIOUS") | (enums.normalise(or_(auditor, "PARTIAL"), enums.AUDITOR_ASSESSMENT) == "NON_COMPLIANT")
    )
    if strict:
        no = no | (d == "ERROR")
    return F.when(no, "NO-GO").otherwise("GO")


def worst_verdict(v: str = "verdict") -> Column:
    """Aggregate: the worst known verdict of a group."""
    known = enums.normalise(v, enums.VERDICT)
    return F.min_by(F.when(known != "UNKNOWN", known), F.when(known != "UNKNOWN", enums.rank(known, enums.VERDICT)))


def message_blocks(rows: DataFrame, key: str, text: str, marker: str = "--- EMAIL") -> DataFrame:
    """Blocks of a log of messages, blank ones left out: key, block_no, block."""
    parts = rows.select(key, F.posexplode(F.split(text, rf"\Q{marker}\E")).alias("block_no", "block"))
    return parts.filter(F.trim("block") != "")


def alarming(blocks: DataFrame, key: str, alarms=ALARMS, marker: str = "--- EMAIL") -> DataFrame:
    """One text a log: the blocks that hold an alarm word, with their marker again; a fixed sentence if none does."""
    hit = F.lower("block").rlike("|".join(rf"\Q{a.lower()}\E" for a in alarms))
    parts = F.sort_array(F.collect_list(F.when(hit, F.struct("block_no", F.concat(F.lit(marker + " "), F.col("block")).alias("b")))))
    out = blocks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["b"]), "").alias("filtered"), F.count_if(hit).alias("found"))
    return out.withColumn("filtered", F.when(F.col("found") > 0, F.col("filtered")).otherwise(NOTHING))
