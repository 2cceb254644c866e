"""Rules from clauses, and their evaluation against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums
from ..functions import text as T
from .matching import numbered

# --- fixed values
LEAST_CHARS, LEAST_OVERLAP, LEAST_RATIO, TOP_RULES = 35, 2, 0.08, 30
# --- end of fixed values


def extract(clauses: DataFrame, modals=T.MODALS, number: bool = True) -> DataFrame:
    """Rules of clauses (clause_id, title, text): one for each kept sentence with a modal word."""
    s = T.clean_sentence(F.col("_s"))
    rows = clauses.select("clause_id", "title", F.posexplode(T.sentences("text")).alias("sentence_no", "_s"))
    # cleaning joins no letters, so a modal word is there before it already
    rows = rows.filter(F.col("_s").rlike("(?i)" + "|".join(modals))).withColumn("sentence", s)
    rows = rows.withColumn("modality", T.modality(F.col("sentence"), modals)).filter((F.length("sentence") >= LEAST_CHARS) & F.col("modality").isNotNull() & ~T.is_noisy(F.col("sentence")))
    condition, action = T.condition_action(F.col("sentence"), F.col("modality"))
    rows = rows.select(
        "clause_id", "title", "sentence_no", F.col("sentence").alias("requirement_text"), "modality", condition.alias("condition"), action.alias("action"),
        T.category(F.concat_ws(" ", F.col("clause_id").cast("string"), "title", "sentence")).alias("category"), T.rule_severity(F.col("modality")).alias("severity"), T.rule_confidence(F.col("modality")).alias("confidence"),
    )
    return numbered(rows, ["clause_id", "sentence_no"], "R-", 5, "rule_id") if number else rows


def keywords(rules: DataFrame) -> Column:
    parts = [c for c in ("clause_id", "title", "requirement_text", "action") if c in rules.columns]
    return T.rule_tokens(F.concat_ws(" ", *[F.col(c).cast("string") for c in parts]))


def _tokens(rules: DataFrame) -> DataFrame:
    rk = rules.select("rule_id", keywords(rules).alias("rk"))
    return rk.select("rule_id", F.size("rk").alias("nr"), F.explode("rk").alias("t"))


def matches(rules: DataFrame, evidence: DataFrame, least: int = LEAST_OVERLAP, ratio: float = LEAST_RATIO) -> DataFrame:
    """rule_id, evidence_id of each rule and evidence with enough tokens in common."""
    et = evidence.select("evidence_id", F.explode(T.rule_tokens(F.col("text"))).alias("t"))
    met = et.join(_tokens(rules), "t").groupBy("rule_id", "evidence_id").agg(F.count("*").alias("n"), F.first("nr").alias("nr"))
    return met.filter((F.col("n") >= least) & (F.col("n") / F.col("nr") >= ratio)).select("rule_id", "evidence_id")


def evaluate(rules: DataFrame, anomalies: DataFrame, evidence: DataFrame, top: int = TOP_RULES, least: int = LEAST_OVERLAP, ratio: float = LEAST_RATIO) -> DataFrame:
    """Findings: for each anomaly text its most relevant rules, each with how much evidence matches, and status.

    rules: rule_id, modality and text columns; anomalies: anomaly_key, text; evidence: evidence_id, text. Tokens join
    tokens: no pair without a token in common is made. The matching evidence itself is ``matches``.
    """
    rt = _tokens(rules)
    at = anomalies.select("anomaly_key", T.rule_tokens(F.col("text")).alias("ak")).select("anomaly_key", F.size("ak").alias("na"), F.explode("ak").alias("t"))
    score = at.join(rt, "t").groupBy("anomaly_key", "rule_id").agg((F.count("*") / F.first("na")).alias("r")).withColumn("relevance", F.round("r", 6))
    best = score.withColumn("rank", F.row_number().over(Window.partitionBy("anomaly_key").orderBy(F.desc("r"), "rule_id"))).filter(F.col("rank") <= top)
    met = matches(rules, evidence, least, ratio)
    met = met.groupBy("rule_id").agg(F.count("*").alias("matched"), F.min("evidence_id").alias("first_evidence"))
    known = ["rule_id", "modality", *[c for c in ("severity", "clause_id") if c in rules.columns]]
    out = best.join(rules.select(*known), "rule_id").join(met, "rule_id", "left")
    status = F.when(F.col("matched").isNotNull(), "PASS").when(F.col("modality").isin("MUST", "SHALL"), "FAIL").otherwise("WARNING")
    return out.select("anomaly_key", "rule_id", "modality", "rank", "relevance", F.coalesce("matched", F.lit(0).cast("long")).alias("matched"), "first_evidence", status.alias("status"), (status == "FAIL").alias("needs_derogation"), *known[2:])


def gate(findings: DataFrame, *by: str) -> DataFrame:
    """Counts of findings by status and the gate: RED_FLAG where a rule of high severity fails, WARNING, else PASS.

    findings: status, severity. Without ``by`` one row, whatever there is: no findings give PASS.
    """
    failed = F.col("status") == "FAIL"
    high = failed & (enums.normalise("severity") == "HIGH")
    counts = [F.count("*").alias("rules_checked"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("WARNING", "warning"))], F.count_if(failed).alias("derogation_needed")]
    verdict = F.when(F.count_if(high) > 0, "RED_FLAG").when(F.count_if(F.col("status") == "WARNING") > 0, "WARNING").otherwise("PASS")
    return findings.groupBy(*by).agg(*counts, verdict.alias("gate"))


def findings_text(findings: DataFrame, by: str, detail: Column, most: int = 240) -> DataFrame:
    """A plain report of each group: findings by status, numbered."""
    turn = Window.partitionBy(by, "status").orderBy("rank")
    line = F.format_string("  %d. [%s] modality=%s\n     %s", F.row_number().over(turn), F.col("rule_id").cast("string"), F.col("modality"), F.substring(detail, 1, most))
    rows = findings.withColumn("_line", line)
    parts = rows.groupBy(by, "status").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "_line"))).alias("l"))
    place = F.when(F.col("status") == "PASS", 1).when(F.col("status") == "FAIL", 2).otherwise(3)
    parts = parts.select(by, F.struct(place.alias("p"), F.concat_ws("\n", F.format_string("%s (%d):", F.col("status"), F.col("n")), F.array_join(F.transform("l", lambda x: x["_line"]), "\n")).alias("t")).alias("b"))
    return parts.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda x: x["t"]), "\n\n").alias("report"))
