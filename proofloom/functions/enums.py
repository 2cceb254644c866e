"""Enumerations: normalising expressions and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: members, worst first where order matters
SEVERITY = ("HIGH", "MEDIUM", "LOW", "UNKNOWN")
VERDICT = ("RED_FLAG", "REVIEW", "JUSTIFICATION_SIGNALS", "TRACKED", "UNKNOWN")
STATUS_GATE = ("CLEAR", "WARNING", "RED_FLAG", "REVIEW_REQUIRED", "UNKNOWN")
DETECTIVE_STATUS = ("CLEAR", "SUSPICIOUS", "ERROR", "UNKNOWN")
AUDITOR_ASSESSMENT = ("COMPLETE", "PARTIAL", "INCOMPLETE", "NON_COMPLIANT", "UNKNOWN")
DEROGATION_OVERALL = ("NO_SIGNALS", "WEAK_SIGNALS", "STRONG_SIGNALS", "UNKNOWN")
DEROGATION_STRENGTH = ("strong", "medium", "risk", "unknown")
RELEASE_DECISION = {"NOGO": "NO-GO", "GO": "GO", "CONDITIONALGO": "CONDITIONAL_GO"}
# --- end of fixed values


def normalise(c, members=SEVERITY, unknown: str | None = None) -> Column:
    """The member that the text names, whatever its case and margins; else the last member."""
    c = F.col(c) if isinstance(c, str) else c
    unknown = members[-1] if unknown is None else unknown
    key, out = F.upper(F.trim(c.cast("string"))), F.lit(unknown)
    for m in members:
        out = F.when(key == m.upper(), F.lit(m)).otherwise(out)
    return out


def rank(c: Column, members=SEVERITY) -> Column:
    """Place of a member, 0 the worst; unknown texts count as the last."""
    out = F.lit(len(members) - 1)
    for k, m in enumerate(members):
        out = F.when(c == m, F.lit(k)).otherwise(out)
    return out


def release_decision(c) -> Column:
    """GO, NO-GO or CONDITIONAL_GO in any spelling with spaces, underscores and hyphens."""
    c = F.col(c) if isinstance(c, str) else c
    key = F.regexp_replace(F.upper(F.trim(c.cast("string"))), "[ _-]", "")
    out = F.lit("UNKNOWN")
    for k, v in RELEASE_DECISION.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def severity_of(severity, fallback) -> Column:
    """Severity from one column, or from another where that one is null or empty."""
    return normalise(F.coalesce(F.nullif(F.col(severity), F.lit("")), F.col(fallback)))
