"""Traceability, governance, rule and evaluation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enums
from ..functions import text as T
from ..functions.nested import value_at
from ..operators import clauses, compaction, evaluation, governance, matching, report, rules
from .registry import SQL, query, table

_STATUS = {"F": "Verified ", "O": "planned", "P": "new  request"}
_MATCHED_SQL = """
    l AS (SELECT l_orderkey, concat('line ', l_linenumber, ' flag ', l_returnflag, ' status ', l_linestatus) AS line, l_returnflag FROM lineitem),
    f AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS bad, bool_or(l_returnflag = 'A') AS good, min(line) AS snippet FROM l GROUP BY l_orderkey),
    g AS (SELECT user_id, arg_max(CASE event_type WHEN 'error' THEN 'FAIL' ELSE 'PASS' END, event_id) AS log_result FROM events GROUP BY user_id),
    m AS (
        SELECT o_orderkey AS requirement_id, o_orderpriority AS module, CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'PLANNED' ELSE 'NEW REQUEST' END AS status,
            CASE WHEN bad IS NULL THEN 'NOT_FOUND' WHEN bad THEN 'FAIL' WHEN good THEN 'PASS' ELSE 'UNKNOWN' END AS outcome, snippet, log_result
        FROM orders LEFT JOIN f ON l_orderkey = o_orderkey LEFT JOIN g ON user_id = o_custkey
    )"""
_ANOMALIES_SQL = (
    _MATCHED_SQL
    + """,
    a AS (
        SELECT requirement_id, module, 1 AS slot, 'MISSING_TEST_DESIGN_EVIDENCE' AS type, 'HIGH' AS severity, concat('Requirement ', requirement_id, ' is ', status, ' in trace CSV but not found in test evidence corpus.') AS detail, NULL AS evidence_snippet FROM m WHERE status = 'VERIFIED' AND outcome = 'NOT_FOUND'
        UNION ALL SELECT requirement_id, module, 2, 'DOC_EVIDENCE_FAIL', 'HIGH', concat('Test design evidence shows FAIL for ', requirement_id, ' while CSV marks it verified.'), snippet FROM m WHERE status = 'VERIFIED' AND outcome = 'FAIL'
        UNION ALL SELECT requirement_id, module, 3, 'WEAK_VERIFICATION_SIGNAL', 'MEDIUM', concat('Requirement ', requirement_id, ' referenced in corpus but no explicit PASS/FAIL token nearby.'), snippet FROM m WHERE status = 'VERIFIED' AND outcome = 'UNKNOWN'
        UNION ALL SELECT requirement_id, module, 4, 'LOG_FAIL_VS_DOC_PASS', 'HIGH', 'Execution logs record FAIL while test-design excerpt shows PASS.', snippet FROM m WHERE log_result = 'FAIL' AND outcome = 'PASS'
        UNION ALL SELECT requirement_id, module, 5, 'LOG_FAIL_VS_VERIFIED_REQUIREMENT', 'HIGH', 'Structured logs report FAIL for a requirement marked Verified in the trace matrix.', NULL FROM m WHERE log_result = 'FAIL' AND status = 'VERIFIED'
    ),
    n AS (SELECT *, printf('a-%04d', row_number() OVER (ORDER BY requirement_id, slot)) AS anomaly_id FROM a)"""
)


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("requirement_id"), "o_orderkey", "o_custkey", F.col("o_orderpriority").alias("module"), F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in _STATUS.items()]).alias("status"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("line "), "l_linenumber", F.lit(" flag "), "l_returnflag", F.lit(" status "), "l_linestatus").alias("line"), "l_returnflag")
    events = table(spark, sf, "events").select(F.col("user_id"), F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("log_result"), "event_id")
    log = matching.last_wins(events, "user_id", "log_result", "event_id").select(F.col("user_id").cast("long").alias("o_custkey"), "log_result")
    out = matching.keyed_outcomes(orders, lines, "o_orderkey", "line", "line", F.col("l_returnflag") == "R", F.col("l_returnflag") == "A")
    return out.join(log, "o_custkey", "left").withColumn("ord", F.col("requirement_id"))


def _anomalies(spark: SparkSession, sf: str) -> DataFrame:
    matched = _matched(spark, sf)
    found = matching.numbered(matching.anomalies(matched), ["ord", "slot"])
    return found.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("requirement_id"), F.col("o_orderpriority").alias("module")), "requirement_id")


@query(f"WITH {_MATCHED_SQL} SELECT requirement_id, status, outcome, snippet, log_result FROM m")
def traceability_outcomes(spark, sf):
    return _matched(spark, sf).select("requirement_id", T.normalise_status("status").alias("status"), "outcome", "snippet", "log_result")


@query(f"WITH {_ANOMALIES_SQL} SELECT anomaly_id, requirement_id, slot, type, severity, detail, evidence_snippet FROM n")
def traceability_anomalies(spark, sf):
    return _anomalies(spark, sf).select("anomaly_id", "requirement_id", "slot", "type", "severity", "detail", "evidence_snippet")


@query(f"""WITH {_ANOMALIES_SQL},
    t AS (SELECT count(*) AS total_requirements, count(*) FILTER (outcome <> 'NOT_FOUND') AS with_document_hit FROM m),
    c AS (SELECT count(*) + 1 AS anomalies_count, count(*) FILTER (severity = 'HIGH') + 1 AS high_severity_count, count(*) FILTER (severity = 'MEDIUM') AS medium_severity_count FROM n)
    SELECT *, CAST(3 AS BIGINT) AS metrics_failed_tests, CASE WHEN high_severity_count > 0 THEN 'RED_FLAG' WHEN anomalies_count > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM t, c""")
def traceability_summary(spark, sf):
    matched = _matched(spark, sf)
    return matching.summary(matched, matching.anomalies(matched), 3)


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, upper(arg_max(event_type, event_id)) AS event_type FROM events GROUP BY user_id")
def duplicate_log_last_wins(spark, sf):
    return matching.last_wins(table(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("""SELECT (SELECT count(*) FROM orders) AS ids, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS missing,
    (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) = 0 AS covered""")
def coverage_check(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return matching.covers(ids, table(spark, sf, "lineitem"), "l_orderkey")


@query(f"""WITH {_ANOMALIES_SQL},
    c AS (SELECT module, string_agg(type || ' (' || k || ')', ', ' ORDER BY type) AS type_counts, sum(k)::BIGINT AS anomalies FROM (SELECT module, type, count(*) AS k FROM n GROUP BY ALL) GROUP BY module),
    p AS (SELECT module, string_agg(id, ', ' ORDER BY o, s) AS ids FROM (SELECT module, CAST(requirement_id AS VARCHAR) AS id, requirement_id AS o, min(slot) AS s FROM n WHERE severity = 'HIGH' GROUP BY ALL) GROUP BY module),
    h AS (SELECT module, count(*) FILTER (severity = 'HIGH') AS high FROM n GROUP BY module)
    SELECT c.module, high, anomalies, type_counts, sha256(ids) AS primary_ids_sha256, CASE WHEN high > 0 THEN 'RED_FLAG' ELSE 'WARNING' END AS status,
        sha256(concat('High-severity traceability anomalies involve requirement(s): ', ids, '. Recorded anomaly classes: ', type_counts, '. Overall traceability matcher status: ', CASE WHEN high > 0 THEN 'RED_FLAG' ELSE 'WARNING' END, '.')) AS summary_sha256
    FROM c JOIN p ON p.module = c.module JOIN h ON h.module = c.module""")
def anomaly_envelope(spark, sf):
    out = matching.envelope(_anomalies(spark, sf), ["module"])
    return out.select("module", "high", "anomalies", "type_counts", F.sha2("primary_requirement_ids", 256).alias("primary_ids_sha256"), "status", F.sha2("human_summary", 256).alias("summary_sha256"))


@query(f"""WITH {_ANOMALIES_SQL}
    SELECT module, sha256(string_agg(concat_ws('|', anomaly_id, type, severity, requirement_id, detail), chr(10) ORDER BY anomaly_id, type, severity, CAST(requirement_id AS VARCHAR), detail)) AS fingerprint FROM n GROUP BY module""")
def anomaly_fingerprint(spark, sf):
    return matching.fingerprint(_anomalies(spark, sf), ["module"])


@query(f"""WITH {_ANOMALIES_SQL}
    SELECT anomaly_id, rtrim(concat_ws(' | ', CAST(requirement_id AS VARCHAR), severity, type, CASE WHEN length(detail) > 100 THEN substr(detail, 1, 157) ELSE detail END), ' |') AS digest, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END AS severity_rank FROM n""")
def digests(spark, sf):
    return _anomalies(spark, sf).select("anomaly_id", report.anomaly_digest(F.col("requirement_id"), F.col("severity"), F.col("type"), F.col("detail")).alias("digest"), enums.rank(F.col("severity")).alias("severity_rank"))


@query(r"""WITH w AS (SELECT o_orderpriority, o_orderstatus, CASE WHEN o_custkey % 7 = 0 THEN 'perhaps' ELSE CASE o_orderstatus WHEN 'F' THEN ' no go' WHEN 'O' THEN 'Go ' ELSE 'Conditional-go' END END AS said, upper(trim(regexp_extract(o_orderpriority, '-(.*)$', 1))) AS word FROM orders)
    SELECT o_orderpriority, o_orderstatus, said, count(*) AS n, CASE WHEN word IN ('HIGH', 'MEDIUM', 'LOW') THEN word ELSE 'UNKNOWN' END AS severity,
        CASE said WHEN ' no go' THEN 'NO-GO' WHEN 'Go ' THEN 'GO' WHEN 'Conditional-go' THEN 'CONDITIONAL_GO' ELSE 'UNKNOWN' END AS decision
    FROM w GROUP BY ALL""")
def enum_normalise(spark, sf):
    word = F.regexp_extract("o_orderpriority", "-(.*)$", 1)
    said = F.when(F.col("o_custkey") % 7 == 0, "perhaps").when(F.col("o_orderstatus") == "F", " no go").when(F.col("o_orderstatus") == "O", "Go ").otherwise("Conditional-go")
    rows = table(spark, sf, "orders").withColumn("said", said).groupBy("o_orderpriority", "o_orderstatus", "said").agg(F.count("*").alias("n"))
    return rows.select("*", enums.normalise(word).alias("severity"), enums.release_decision("said").alias("decision"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS severity_rank,
        CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 1 WHEN value < 50 THEN 2 ELSE 4 END AS verdict_rank,
        row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 1 WHEN value < 50 THEN 2 ELSE 4 END, event_id) AS place FROM events""")
def severity_sort(spark, sf):
    from pyspark.sql import Window

    sev = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "signup", "MEDIUM").when(F.col("event_type") == "click", "LOW").otherwise("other")
    ver = F.when(F.col("value") < 5, "RED_FLAG").when(F.col("value") < 20, "REVIEW").when(F.col("value") < 50, "JUSTIFICATION_SIGNALS").otherwise("?")
    rows = table(spark, sf, "events").select("event_id", "user_id", enums.rank(enums.normalise(sev)).alias("severity_rank"), enums.rank(enums.normalise(ver, enums.VERDICT), enums.VERDICT).alias("verdict_rank"))
    return rows.select("event_id", "severity_rank", "verdict_rank", F.row_number().over(Window.partitionBy("user_id").orderBy("severity_rank", "verdict_rank", "event_id")).alias("place"))


# --- governance language; the words of these tables stand in for those of the default patterns
_WORDS = ((r"\bthe\s+the\b", "doubled", "strong"), (r"\bwith\s+(the|that)\b", "with", "medium"), (r"\b(ou|re)\b", "loose", "risk"))
_SCAN_SQL = r"""
    t AS (SELECT conv_id, turn, role, text, lower(text) AS low FROM conversations),
    h AS (
        SELECT conv_id, turn, role, 'doubled' AS pattern_id, 'strong' AS strength, 3 AS base_score FROM t WHERE regexp_matches(low, '\bthe\s+the\b')
        UNION ALL SELECT conv_id, turn, role, 'with', 'medium', 1 FROM t WHERE regexp_matches(low, '\bwith\s+(the|that)\b')
        UNION ALL SELECT conv_id, turn, role, 'loose', 'risk', -2 FROM t WHERE regexp_matches(low, '(^|[^\p{L}\p{N}_])(ou|re)($|[^\p{L}\p{N}_])')
    ),
    s AS (
        SELECT h.conv_id, sum(CASE WHEN strength = 'risk' AND regexp_matches(substr(low, 1, 800), '\bthe\s+the\b') THEN 0 ELSE base_score END)::INTEGER AS justification_score, count(*) AS hits, bool_or(strength = 'strong') AS has_strong
        FROM h JOIN t ON t.conv_id = h.conv_id AND t.turn = h.turn GROUP BY h.conv_id
    )"""


def _signals(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.col("role"), F.lit(":"), F.col("turn").cast("string")).alias("source"), "role", F.col("text").alias("window"))
    hits = governance.signals(turns, tuple((p.replace(r"\b(ou|re)\b", r"(?U)\b(ou|re)\b"), n, s) for p, n, s in _WORDS))
    return hits, governance.scored(hits, ["conv_id"], ["turn", "ord"], _WORDS)


@query(f"WITH {_SCAN_SQL} SELECT conv_id, turn, pattern_id, strength, base_score FROM h")
def derogation_signals(spark, sf):
    return _signals(spark, sf)[0].select("conv_id", "turn", "pattern_id", "strength", "base_score")


@query(f"""WITH {_SCAN_SQL} SELECT conv_id, justification_score, hits, has_strong,
    CASE WHEN justification_score >= 4 THEN 'STRONG_SIGNALS' WHEN justification_score >= 2 OR hits > 0 THEN 'WEAK_SIGNALS' ELSE 'NO_SIGNALS' END AS overall FROM s""")
def derogation_scan(spark, sf):
    out = _signals(spark, sf)[1]
    return out.withColumn("overall", governance.derogation_overall(F.col("justification_score"), F.col("hits")))


_VERDICT_SQL = (
    _SCAN_SQL
    + """,
    v AS (
        SELECT c.conv_id, severity, coalesce(justification_score, 0) AS score, CASE WHEN severity <> 'HIGH' THEN 'TRACKED' WHEN coalesce(justification_score, 0) >= 4 AND coalesce(has_strong, FALSE) THEN 'JUSTIFICATION_SIGNALS'
            WHEN coalesce(justification_score, 0) >= 2 OR coalesce(has_strong, FALSE) THEN 'REVIEW' ELSE 'RED_FLAG' END AS verdict
        FROM (SELECT conv_id, CASE WHEN count(*) >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM conversations GROUP BY conv_id) AS c LEFT JOIN s ON s.conv_id = c.conv_id
    )"""
)


def _verdicts(spark, sf):
    items = table(spark, sf, "conversations").groupBy("conv_id").agg(F.when(F.count("*") >= 4, "HIGH").otherwise("MEDIUM").alias("severity"))
    out = items.join(_signals(spark, sf)[1], "conv_id", "left").withColumn("score", F.coalesce("justification_score", F.lit(0)))
    return out.withColumn("verdict", governance.verdict(F.col("severity"), F.col("score"), F.col("has_strong")))


@query(f"""WITH {_VERDICT_SQL} SELECT conv_id, severity, score, verdict, sha256(CASE verdict
    WHEN 'JUSTIFICATION_SIGNALS' THEN concat('High-severity anomaly (long thread) co-locates with strong governance / approval language in communications or authorizations (score=', score, '). Human ISA must still confirm scope and validity.')
    WHEN 'REVIEW' THEN concat('High-severity anomaly (long thread) has partial justification signals (score=', score, '); independent review recommended before release.')
    WHEN 'RED_FLAG' THEN concat('High-severity anomaly (long thread) lacks adequate documented justification in scanned emails and authorizations (score=', score, ').')
    ELSE 'Non-high severity item tracked for completeness in the pre-ISA bundle.' END) AS rationale_sha256 FROM v""")
def verdict_per_anomaly(spark, sf):
    v = _verdicts(spark, sf)
    return v.select("conv_id", "severity", "score", "verdict", F.sha2(governance.rationale(F.col("verdict"), F.lit("long thread"), F.col("score")), 256).alias("rationale_sha256"))


@query(f"""WITH {_VERDICT_SQL} SELECT g.matcher, CASE WHEN g.matcher = 'red_flag' THEN 'RED_FLAG' WHEN g.matcher = 'WARNING' OR bool_or(severity = 'HIGH' AND verdict IN ('RED_FLAG', 'REVIEW')) THEN 'REVIEW_REQUIRED' ELSE 'CLEAR' END AS overall,
    arg_min(verdict, CASE verdict WHEN 'RED_FLAG' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'JUSTIFICATION_SIGNALS' THEN 2 ELSE 3 END) AS worst FROM v, (VALUES ('red_flag'), ('WARNING'), ('PASS')) AS g(matcher) GROUP BY g.matcher""")
def overall_gate(spark, sf):
    v = _verdicts(spark, sf)
    high = F.col("severity") == "HIGH"
    one = v.agg(F.bool_or(high & (F.col("verdict") == "RED_FLAG")).alias("red"), F.bool_or(high & (F.col("verdict") == "REVIEW")).alias("review"), governance.worst_verdict().alias("worst"))
    gates = spark.createDataFrame([("red_flag",), ("WARNING",), ("PASS",)], "matcher string")
    out = gates.crossJoin(one)  # three rows by one
    return out.select("matcher", governance.overall_gate(F.col("matcher"), F.lit("PASS"), F.lit("CLEAR"), F.col("red"), F.col("review")).alias("overall"), "worst")


@query("""SELECT event_id, CASE WHEN value < 1 OR event_type = 'error' OR user_id % 7 = 0 OR (user_id % 5 = 0) OR event_type = 'view' THEN 'NO-GO' ELSE 'GO' END AS decision FROM events""")
def release_gate(spark, sf):
    e = table(spark, sf, "events")
    matcher = F.when(F.col("event_type") == "error", "red_flag").otherwise("PASS")
    regulatory = F.when(F.col("event_type") != "view", "CLEAR")
    detective = F.when(F.col("user_id") % 5 == 0, "").otherwise("CLEAR")
    auditor = F.when(F.col("user_id") % 7 == 0, " non_compliant").otherwise("COMPLETE")
    return e.select("event_id", governance.release_gate(matcher, regulatory, detective, auditor, (F.col("value") < 1).cast("int"), F.lit(False)).alias("decision"))


_LOG_SQL = r"WITH b AS (SELECT conv_id, turn AS block_no, concat(' ', role, chr(10), text) AS block, lower(concat(' ', role, chr(10), text)) AS low FROM conversations)"


@query(_LOG_SQL + r""" SELECT conv_id, CASE WHEN count(*) FILTER (low LIKE '%system%' OR low LIKE '%with the%' OR low LIKE '%ing of%') > 0 THEN sha256(string_agg(concat('--- EMAIL ', block), '' ORDER BY block_no) FILTER (low LIKE '%system%' OR low LIKE '%with the%' OR low LIKE '%ing of%'))
    ELSE sha256('No anomalies detected in text.') END AS filtered_sha256, count(*) FILTER (low LIKE '%system%' OR low LIKE '%with the%' OR low LIKE '%ing of%') AS found FROM b GROUP BY conv_id""")
def email_prefilter(spark, sf):
    turns = table(spark, sf, "conversations")
    part = F.concat(F.lit("--- EMAIL "), F.col("role"), F.lit("\n"), F.col("text"))
    logs = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "").alias("log"))
    out = governance.alarming(governance.message_blocks(logs, "conv_id", "log"), "conv_id", ("system", "with the", "ing of"))
    return out.select("conv_id", F.sha2("filtered", 256).alias("filtered_sha256"), "found")


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, text, lower(text) AS low FROM documents),
    o AS (
        SELECT doc_id, text, low, strpos(low, 'license') AS pos FROM t WHERE strpos(low, 'license') > 0
        UNION ALL SELECT doc_id, text, low, pos + 6 + strpos(substr(low, pos + 7), 'license') FROM o WHERE strpos(substr(low, pos + 7), 'license') > 0
    )
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(replace(substr(text, greatest(1, pos - 280), pos + 280 - greatest(1, pos - 280)), chr(10), ' ')) AS "window" FROM o""")
def occurrence_windows(spark, sf):
    return governance.occurrences(table(spark, sf, "documents").select("doc_id", "text"), F.lit("license")).select("doc_id", F.col("at").alias("pos"), "window")


# --- rules and clauses; "with" and "that" stand in for modal words
_RULES_SQL = r"""
    c AS (SELECT doc_id AS clause_id, source AS title, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    p AS (SELECT clause_id, title, unnest(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) - 1 AS sentence_no FROM c),
    q AS (SELECT clause_id, title, sentence_no, trim(regexp_replace(regexp_replace(s, '\.{5,}', ' ', 'g'), '\s+', ' ', 'g'), ' -;:,') AS sentence FROM p),
    m AS (
        SELECT *, CASE WHEN regexp_matches(lower(sentence), '(^|[^\p{L}\p{N}_])with($|[^\p{L}\p{N}_])') THEN 'WITH' WHEN regexp_matches(lower(sentence), '(^|[^\p{L}\p{N}_])that($|[^\p{L}\p{N}_])') THEN 'THAT' END AS modality FROM q
        WHERE length(sentence) >= 35 AND length(regexp_replace(sentence, '[^\p{L}]', '', 'g')) >= 18 AND len(regexp_extract_all(sentence, '[♦•\[\]\(\)\|]')) < 6
            AND NOT regexp_matches(sentence, '(^|[^A-Za-z\p{L}\p{N}_])([A-Za-z][ ]+){8,}') AND sentence NOT LIKE '%(cid:%'
    ),
    r AS (SELECT *, CASE WHEN regexp_matches(lower(concat_ws(' ', clause_id, title, sentence)), 'test|verification|validation|evidence|report') THEN 'verification_and_testing'
        WHEN regexp_matches(lower(concat_ws(' ', clause_id, title, sentence)), 'traceability|requirement|configuration') THEN 'traceability_and_requirements'
        WHEN regexp_matches(lower(concat_ws(' ', clause_id, title, sentence)), 'maintenance|integration|architecture|design') THEN 'lifecycle_engineering'
        WHEN regexp_matches(lower(concat_ws(' ', clause_id, title, sentence)), 'safety|integrity|hazard|risk') THEN 'safety_assurance' ELSE 'general_compliance' END AS category,
        printf('R-%05d', row_number() OVER (ORDER BY clause_id, sentence_no)) AS rule_id FROM m WHERE modality IS NOT NULL)"""


def _clauses(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("clause_id"), F.col("source").alias("title"), "text")


@query(f"WITH {_RULES_SQL} SELECT rule_id, clause_id, CAST(sentence_no AS INTEGER) AS sentence_no, modality, category, sha256(sentence) AS sentence_sha256 FROM r")
def rule_extract(spark, sf):
    out = rules.extract(_clauses(spark, sf), ("WITH", "THAT"))
    return out.select("rule_id", "clause_id", "sentence_no", "modality", "category", F.sha2("requirement_text", 256).alias("sentence_sha256"))


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    p AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM c)
    SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, sha256(array_to_string(s, chr(10))) AS sentences_sha256 FROM p""")
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sentences("text").alias("s")).select("doc_id", F.size("s").alias("sentences"), F.sha2(F.array_join("s", "\n"), 256).alias("sentences_sha256"))


_FINDINGS_SQL = r"""
    rt AS (SELECT item_id AS rule_id, list_distinct([w FOR w IN regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') IF regexp_full_match(w, '[a-z]{3,}')]) AS ws FROM benchmark),
    stop AS (SELECT string_split('the and for with that this from shall must should into have been will are was were has had not its their than then also when where which while under over such each', ' ') AS st),
    rk AS (SELECT rule_id, [w FOR w IN ws IF NOT list_contains(st, w)] AS ws FROM rt, stop),
    aw AS (SELECT conv_id * 1000 + turn AS anomaly_key, list_distinct([w FOR w IN regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') IF regexp_full_match(w, '[a-z]{3,}')]) AS ws FROM conversations),
    ak AS (SELECT anomaly_key, [w FOR w IN ws IF NOT list_contains(st, w)] AS ws FROM aw, stop),
    dt AS (SELECT doc_id, list_distinct([w FOR w IN regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') IF regexp_full_match(w, '[a-z]{3,}')]) AS ws FROM documents),
    rx AS (SELECT rule_id, len(ws) AS nr, unnest(ws) AS t FROM rk), ax AS (SELECT anomaly_key, len(ws) AS na, unnest(ws) AS t FROM ak), dx AS (SELECT doc_id, unnest(ws) AS t FROM dt),
    sc AS (SELECT anomaly_key, rule_id, round(count(*) / any_value(na), 6) AS relevance FROM ax JOIN rx USING (t) GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY anomaly_key ORDER BY relevance DESC, rule_id) AS rank FROM sc),
    e AS (SELECT rule_id, count(*) AS matched, min(doc_id) AS first_evidence FROM (SELECT rule_id, doc_id, count(*) AS n, any_value(nr) AS nr FROM dx JOIN rx USING (t) GROUP BY ALL) WHERE n >= 2 AND n / nr >= 0.08 GROUP BY rule_id),
    f AS (SELECT anomaly_key, b.rule_id, CASE WHEN b.rule_id % 2 = 0 THEN 'SHALL' ELSE 'SHOULD' END AS modality, CAST(rank AS INTEGER) AS rank, relevance, coalesce(matched, 0) AS matched, first_evidence FROM b LEFT JOIN e ON e.rule_id = b.rule_id WHERE rank <= 30)"""


def _rules(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("rule_id"), F.when(F.col("item_id") % 2 == 0, "SHALL").otherwise("SHOULD").alias("modality"), F.col("text").alias("requirement_text"))


def _evidence(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("evidence_id"), "text")


def _findings(spark, sf):
    found = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("anomaly_key"), "text")
    return rules.evaluate(_rules(spark, sf), found, _evidence(spark, sf), 30)


@query(f"WITH {_FINDINGS_SQL} SELECT anomaly_key, rule_id, modality, rank, relevance, matched, first_evidence, CASE WHEN matched > 0 THEN 'PASS' WHEN modality = 'SHALL' THEN 'FAIL' ELSE 'WARNING' END AS status, matched = 0 AND modality = 'SHALL' AS needs_derogation FROM f")
def rule_engine(spark, sf):
    return _findings(spark, sf)


@query(f"""WITH {_FINDINGS_SQL}, g AS (SELECT *, CASE WHEN matched > 0 THEN 'PASS' WHEN modality = 'SHALL' THEN 'FAIL' ELSE 'WARNING' END AS status FROM f),
    l AS (SELECT anomaly_key, status, rank, printf('  %d. [%s] modality=%s' || chr(10) || '     %s', row_number() OVER (PARTITION BY anomaly_key, status ORDER BY rank), CAST(rule_id AS VARCHAR), modality, concat('matched ', matched)) AS line FROM g),
    p AS (SELECT anomaly_key, status, concat(status, ' (', count(*), '):', chr(10), string_agg(line, chr(10) ORDER BY rank)) AS t FROM l GROUP BY anomaly_key, status)
    SELECT anomaly_key, sha256(string_agg(t, chr(10) || chr(10) ORDER BY CASE status WHEN 'PASS' THEN 1 WHEN 'FAIL' THEN 2 ELSE 3 END)) AS report_sha256 FROM p GROUP BY anomaly_key""")
def findings_report(spark, sf):
    out = rules.findings_text(_findings(spark, sf), "anomaly_key", F.concat(F.lit("matched "), F.col("matched").cast("string")))
    return out.select("anomaly_key", F.sha2("report", 256).alias("report_sha256"))


@query(f"WITH {_FINDINGS_SQL} SELECT rule_id, doc_id AS evidence_id FROM (SELECT rule_id, doc_id, count(*) AS n, any_value(nr) AS nr FROM dx JOIN rx USING (t) GROUP BY ALL) WHERE n >= 2 AND n / nr >= 0.08")
def rule_evidence(spark, sf):
    """The matched evidence of every rule, a row each."""
    return rules.matches(_rules(spark, sf), _evidence(spark, sf))


@query(f"""WITH {_FINDINGS_SQL}, g AS (SELECT anomaly_key, CASE WHEN matched > 0 THEN 'PASS' WHEN modality = 'SHALL' THEN 'FAIL' ELSE 'WARNING' END AS status, CASE WHEN rule_id % 4 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM f)
    SELECT anomaly_key, count(*) AS rules_checked, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'WARNING') AS warning, count(*) FILTER (status = 'FAIL') AS derogation_needed,
        CASE WHEN count(*) FILTER (status = 'FAIL' AND severity = 'HIGH') > 0 THEN 'RED_FLAG' WHEN count(*) FILTER (status = 'WARNING') > 0 THEN 'WARNING' ELSE 'PASS' END AS gate FROM g GROUP BY anomaly_key""")
def regulatory_gate(spark, sf):
    """Counts and gate of the findings of each text; every other binding rule is of high severity."""
    severity = F.when(F.col("rule_id") % 4 == 0, "HIGH").otherwise("MEDIUM")
    return rules.gate(_findings(spark, sf).withColumn("severity", severity), "anomaly_key")


_LINES_SQL = r"""
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    n AS (SELECT doc_id, line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM l),
    h AS (SELECT *, length(line) < 60 AS head FROM n WHERE line <> ''),
    k AS (SELECT doc_id, line_no, line, CAST(sum(CAST(head AS INTEGER)) OVER w AS BIGINT) AS clause_no, last_value(CASE WHEN head THEN line END IGNORE NULLS) OVER w AS heading, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line
        FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _lines(spark, sf):
    rows = clauses.lines(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return clauses.grouped(rows, "doc_id", F.length("line") < 60)


@query(f"WITH {_LINES_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, clause_no, md5(heading) AS heading_md5, md5(next_line) AS next_md5 FROM k")
def clause_lines(spark, sf):
    return _lines(spark, sf).select("doc_id", "line_no", "clause_no", F.md5("heading").alias("heading_md5"), F.md5("next_line").alias("next_md5"))


@query(f"""WITH {_LINES_SQL} SELECT doc_id, clause_no, any_value(heading) AS title, count(*) AS n_lines, md5(coalesce(string_agg(line, ' ' ORDER BY line_no) FILTER (NOT (line = heading AND line_no = first_no)), '')) AS text_md5
    FROM (SELECT *, min(line_no) OVER (PARTITION BY doc_id, clause_no) AS first_no FROM k WHERE clause_no > 0) GROUP BY doc_id, clause_no""")
def clause_bodies(spark, sf):
    return clauses.body(_lines(spark, sf), "doc_id").select("doc_id", "clause_no", "title", "n_lines", F.md5("text").alias("text_md5"))


_TITLE = "regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')"


@query(f"""WITH c AS (SELECT md5(text) AS clause_id, doc_id, source AS title, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
    d AS (SELECT clause_id, max(title) AS title, min(doc_id) AS page_start, count(*) AS rows FROM (SELECT *, max(length(title)) OVER (PARTITION BY clause_id) AS m FROM c) WHERE length(title) = m GROUP BY clause_id),
    e AS (SELECT clause_id, min(doc_id) AS page_start, count(*) AS rows, CAST(count(DISTINCT t) AS INTEGER) AS texts, sha256(min(t)) AS text_sha256 FROM c GROUP BY clause_id)
    SELECT e.clause_id, d.title, e.page_start, e.rows, e.text_sha256, e.texts FROM e JOIN d ON d.clause_id = e.clause_id""")
def clause_merge(spark, sf):
    rows = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("clause_id"), "doc_id", F.col("source").alias("title"), "text")
    return clauses.merged(rows, "clause_id", "title", "text", "doc_id")


@query("SELECT count(*) AS raw_rows, (SELECT count(DISTINCT text) FROM documents) AS ids, (SELECT count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)) AS duplicate_ids, count(*) - (SELECT count(DISTINCT text) FROM documents) AS extra_rows FROM documents")
def cleanup_counters(spark, sf):
    return clauses.cleanup(table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("clause_id")), "clause_id").select(F.col("raw_rows").cast("long").alias("raw_rows"), "ids", "duplicate_ids", F.col("extra_rows").cast("long").alias("extra_rows"))


@query("""WITH f AS (SELECT conv_id * 1000 + turn AS key, [struct_pack(n := 'role', j := CAST(to_json(role) AS VARCHAR)), struct_pack(n := 'turn', j := CAST(turn AS VARCHAR)), struct_pack(n := 'text', j := CAST(to_json(text) AS VARCHAR)),
        struct_pack(n := 'n', j := CAST(length(text) AS VARCHAR)), struct_pack(n := 'status', j := '"kept"')] AS fs, ['n', 'turn', 'text'] AS ord FROM conversations),
    t AS (SELECT *, [concat('{', array_to_string([concat('"', n, '": ', [x.j FOR x IN fs IF x.n = n][1]) FOR n IN ['status', 'role', 'turn', 'text', 'n'] IF NOT list_contains(ord[1:d], n)], ', '), '}') FOR d IN range(0, 4)] AS texts FROM f),
    p AS (SELECT *, coalesce(list_position([length(x) <= 160 FOR x IN texts], TRUE), 4) - 1 AS d FROM t),
    q AS (SELECT *, texts[d + 1] AS plain, concat('{', array_to_string([concat('"', x.n, '": ', x.j) FOR x IN fs IF NOT list_contains(ord[1:d], x.n)], ', '), ', "_compaction": {"dropped_fields": [', array_to_string([concat('"', y, '"') FOR y IN ord[1:d]], ', '), '], "marker": "[truncated]"}}') AS told FROM p),
    b AS (SELECT key, CASE WHEN d > 0 AND length(told) <= 160 THEN told ELSE plain END AS best FROM q)
    SELECT key, CASE WHEN length(best) > 160 THEN concat(best, chr(10), '[truncated]') ELSE best END AS compact FROM b""")
def compaction_reports(spark, sf):
    turns = table(spark, sf, "conversations")
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.to_json(F.struct("role", "turn", "text", F.length("text").alias("n"), F.lit("kept").alias("status"))).alias("report"))
    return compaction.compacted(rows, 160, ("status", "role"), ("text",))


# --- traces and expectations
@query("""WITH x AS (SELECT c_name AS requirement_id, c_mktsegment AS title, 'VERIFIED' AS verification_status FROM customer),
    y AS (SELECT replace(upper(s_name), 'SUPPLIER', 'Customer') AS requirement_id, 'title ' || s_nationkey AS title FROM supplier UNION ALL SELECT s_name, 'new ' || s_nationkey FROM supplier)
    SELECT x.requirement_id, coalesce(y.title, x.title) AS title, verification_status FROM x LEFT JOIN y ON upper(y.requirement_id) = upper(x.requirement_id)
    UNION ALL SELECT requirement_id, title, 'PLANNED' FROM y WHERE upper(requirement_id) NOT IN (SELECT upper(requirement_id) FROM x)""")
def trace_merge(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_name").alias("requirement_id"), F.col("c_mktsegment").alias("title"), F.lit("VERIFIED").alias("verification_status"))
    s = table(spark, sf, "supplier")
    new = s.select(F.replace(F.upper("s_name"), F.lit("SUPPLIER"), F.lit("Customer")).alias("requirement_id"), F.concat(F.lit("title "), "s_nationkey").alias("title")).unionByName(s.select(F.col("s_name").alias("requirement_id"), F.concat(F.lit("new "), "s_nationkey").alias("title")))
    return matching.merged_trace(old, new)


@query(r"SELECT c_name, split_part(c_name, '#', 1) AS prefix, CAST(regexp_extract(replace(c_name, '#', '-'), '(\d+)$', 1) AS INTEGER) AS tail FROM customer")
def requirement_id_sort(spark, sf):
    rows = table(spark, sf, "customer").select("c_name", F.translate("c_name", "#", "-").alias("requirement_id"))
    prefix, tail, _ = matching.id_sort_key()
    return rows.select("c_name", prefix.alias("prefix"), tail.alias("tail")).orderBy("prefix", "tail")


@query(r"SELECT c_custkey, upper(regexp_replace(trim(c_mktsegment), '\s+', ' ', 'g')) AS status, coalesce(nullif(trim(c_name), ''), n_name) AS requirement_id FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_name NOT LIKE '#%'")
def csv_normalisation(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left")  # a small table: Spark sends it by its size
    return rows.select("c_custkey", T.normalise_status("c_mktsegment").alias("status"), F.coalesce(T.blank_to_null("c_name"), F.col("n_name")).alias("requirement_id")).filter(~F.col("requirement_id").startswith("#"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(concat('{"a": {"b": ', props, ', "c": null}}'), '$.a.b.k') AS nested, json_extract_string(props, '$.a.b') AS missing FROM events""")
def json_props_projection(spark, sf):
    deep = F.concat(F.lit('{"a": {"b": '), "props", F.lit(', "c": null}}'))
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), value_at(deep, "a.b.k").alias("nested"), value_at(F.col("props"), "a.b").alias("missing"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id""")
def ordered_distinct_ids(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


_GOLD_SQL = """WITH x AS (SELECT doc_id, CAST(quality AS VARCHAR) AS expected FROM labels), y AS (SELECT doc_id, CASE WHEN text LIKE '%!! %' OR text LIKE '%&&&%' OR text LIKE '%|%' THEN ' 0' ELSE '1 ' END AS actual FROM documents),
    z AS (SELECT x.doc_id, expected, actual, upper(trim(expected)) IS NOT DISTINCT FROM upper(trim(actual)) AS ok FROM x LEFT JOIN y ON y.doc_id = x.doc_id)"""


def _gold(spark, sf):
    d = table(spark, sf, "documents")
    junk = F.col("text").contains("!! ") | F.col("text").contains("&&&") | F.col("text").contains("|")
    return evaluation.compared(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("expected")), d.select("doc_id", F.when(junk, " 0").otherwise("1 ").alias("actual")), "doc_id")


@query(_GOLD_SQL + " SELECT doc_id, expected, actual, ok FROM z")
def golden_eval(spark, sf):
    return _gold(spark, sf)


@query(_GOLD_SQL + " SELECT count(*) AS checks, count(*) FILTER (ok) AS passed, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM z")
def golden_accuracy(spark, sf):
    return evaluation.accuracy(_gold(spark, sf))
