"""A whole assessment over files: trace, logs, evidence, messages, authorizations and rules to a release decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions.text import REQUIREMENT_ID
from ..operators import chunking, clause_index, governance, matching, needles, report, requirements, retrieval, rules, triple
from ..sources import tables
from ..staging import settled, shared_folder

#: Chunks of a requirement's entry at most: more than the longest text can have.
_MOST = 1 << 21


def requirement_chunks(reqs: DataFrame, lines: DataFrame, pattern: str = REQUIREMENT_ID, size: int = 1400, overlap: int = 120) -> DataFrame:
    """chunk_id, requirement_id, requirement_title, text: entries of the requirements that the lines name, cut at boundaries.

    Where no line names any requirement, the lines' documents themselves are cut instead, without a requirement.
    """
    entries = requirements.entries(reqs, lines, pattern).select("requirement_id", "title", "content")
    if entries.isEmpty():
        parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
        entries = lines.groupBy("doc").agg(parts.alias("content")).select(F.lit(None).cast("string").alias("requirement_id"), F.col("doc").alias("title"), "content")
    rows = matching.numbered(entries, ["requirement_id", "title"], "", 1, "_n").withColumn("doc_id", F.col("_n").cast("long"))
    parts = chunking.boundary_chunks(rows.select("doc_id", F.col("content").alias("text")), size, overlap)
    about = rows.select("doc_id", "requirement_id", F.col("title").alias("requirement_title"))
    return parts.join(about, "doc_id").select((F.col("doc_id") * _MOST + F.col("chunk_index")).alias("chunk_id"), "requirement_id", "requirement_title", F.col("chunk").alias("text"))


def with_retrieval(matched: DataFrame, lines: DataFrame) -> DataFrame:
    """``matched`` with outcomes of retrieval where the exact scan leaves them open, and evidence_source, verdict_agreement.

    matched: requirement_id, title, ord, outcome, snippet. Only open requirements are asked for.
    """
    asked = matched.filter(F.col("outcome").isin("UNKNOWN", "NOT_FOUND")).select(F.col("ord").alias("query_id"), "requirement_id", "title")
    chunks = settled(requirement_chunks(matched.select("requirement_id", "title"), lines))
    found = triple.classify(asked, chunks).select(F.col("query_id").alias("ord"), "verdict", F.col("snippet").alias("_snippet"), F.col("agreement").alias("retrieval_agreement"))
    met = matched.join(found, "ord", "left").withColumn("verdict", F.coalesce("verdict", F.lit("NOT_FOUND")))
    outcome, source = matching.merged_outcome(F.col("outcome"), F.col("verdict"))
    met = met.withColumn("_o", outcome).withColumn("evidence_source", source)
    return met.withColumns({"snippet": F.coalesce("snippet", F.when(F.col("evidence_source") == "retrieval_fallback", F.col("_snippet"))), "outcome": F.col("_o")}).drop("_o", "_snippet", "verdict")


def derogation_windows(found: DataFrame, texts: DataFrame) -> DataFrame:
    """anomaly_id, source, at, window: where each anomaly's needle stands in the texts (source, text), in one look at them.

    The needle is the requirement's id, else the first word of the detail. Anomalies without one get the head of each text.
    """
    needle = F.when(F.trim(F.coalesce(F.col("requirement_id"), F.lit(""))) != "", F.trim("requirement_id")).otherwise(F.regexp_extract(F.coalesce("detail", F.lit("")), r"^(\S+)", 1))
    asked = found.select("anomaly_id", F.lower(needle).alias("needle"))
    hits = needles.find(asked, texts, ["source", "text"], overlapping=False).withColumn("at", F.explode("places"))
    low = F.greatest(F.lit(1), F.col("at") - governance.RADIUS)
    hits = hits.withColumn("window", F.trim(F.replace(F.substring(F.col("text"), low, F.col("at") + governance.RADIUS - low), F.lit("\n"), F.lit(" "))))
    near = hits.select("needle", "source", "at", "window").join(asked, "needle").select("anomaly_id", "source", "at", "window")
    heads = governance.occurrences(texts.withColumns({"_none": F.lit(""), "_one": F.lit(1)}), F.col("_none"), head=governance.HEAD).select("_one", "source", "at", "window")
    bare = asked.filter("needle = ''").select("anomaly_id", F.lit(1).alias("_one")).join(heads, "_one").select("anomaly_id", "source", "at", "window")
    return near.unionByName(bare)


def assess(spark: SparkSession, trace: str, logs: str, evidence: str, messages: str, authorizations: str, clauses: DataFrame | None = None, auditor: str | None = "PARTIAL", detective: str | None = None, retrieve: bool = True) -> dict[str, DataFrame]:
    """Reports by name: requirements, anomalies, envelope, signals, verdicts, digests, decision; with clauses also findings,
    clause_hits, citations.

    With ``retrieve`` outcomes that the exact scan leaves open are looked for in chunks of the evidence.

    The triage of messages has no model here: without one given, it is SUSPICIOUS if any message holds an alarm word,
    else CLEAR. Without clauses the regulatory gate counts as CLEAR.
    """
    reqs = tables.requirements_csv(spark, trace)
    reqs = reqs.select("requirement_id", *[c for c in ("title", "verification_status") if c in reqs.columns]).withColumn("ord", F.monotonically_increasing_id())
    log = tables.test_logs_json(spark, logs)
    results = matching.last_wins(tables.log_results(log), "requirement_id", "result", "ord").select(F.col("requirement_id").alias("_k"), F.col("result").alias("log_result"))
    failed = log.select(F.coalesce(F.max("metrics.failed_tests"), F.lit(0)).alias("n")).first()["n"]
    lines = tables.text_lines(tables.whole_text(spark, evidence)).select(F.col("path").alias("doc"), "line_no", "line")
    matched = settled(matching.substring_outcomes(reqs.withColumn("status", F.col("verification_status")), lines))
    if "title" not in matched.columns:
        matched = matched.withColumn("title", F.lit(None).cast("string"))
    matched = settled(with_retrieval(matched, lines)) if retrieve else matched.withColumn("evidence_source", F.lit("exact_corpus_scan"))
    matched = matched.join(results, F.upper(F.trim("requirement_id")) == F.col("_k"), "left").drop("_k")
    found = matching.anomalies(matched)
    if failed > 0:
        top = spark.createDataFrame([(None, 1 << 62, 9, "METRICS_REPORT_FAILED_TESTS", "HIGH", f"Test log metrics report failed_tests={failed} for this build.", None)], found.schema)
        found = found.unionByName(top)
    found = matching.numbered(found, ["ord", "slot"])

    blocks = governance.message_blocks(tables.whole_text(spark, messages), "path", "text")
    mail = governance.alarming(blocks, "path")
    texts = mail.select(F.lit("email").alias("source"), F.col("filtered").alias("text")).unionByName(tables.whole_text(spark, authorizations).select(F.lit("authorization").alias("source"), "text"))
    windows = derogation_windows(found, texts)
    hits = governance.signals(windows)
    scores = governance.scored(hits, ["anomaly_id"], ["source", "at", "ord"])
    verdicts = found.join(scores, "anomaly_id", "left").withColumn("score", F.coalesce("justification_score", F.lit(0)))
    verdicts = verdicts.withColumn("verdict", governance.verdict(F.col("severity"), F.col("score"), F.col("has_strong"))).withColumn("rationale", governance.rationale(F.col("verdict"), F.col("type"), F.col("score")))

    summary = matching.summary(matched, found.filter("type <> 'METRICS_REPORT_FAILED_TESTS'"), failed)
    derogation = verdicts.agg(F.max(F.when(F.col("severity") == "HIGH", F.col("score"))).alias("best"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    alarms = mail.agg(F.coalesce(F.sum("found"), F.lit(0)).alias("alarms"))
    gates = summary.select(F.col("status").alias("matcher")).crossJoin(derogation).crossJoin(alarms)  # rows of one
    gates = gates.select("matcher", governance.derogation_overall(F.col("best"), F.col("hits")).alias("derogation"), (F.lit(detective) if detective else F.when(F.col("alarms") > 0, "SUSPICIOUS")).alias("detective"), F.lit(auditor).alias("auditor"))
    one = found.withColumn("run", F.lit(1))
    envelope = matching.envelope(one, ["run"]).join(matching.retrieval_query(one, ["run"], failed), "run").join(matching.fingerprint(one, ["run"]), "run")
    digest = verdicts.select("anomaly_id", report.anomaly_digest(F.col("requirement_id"), F.col("severity"), F.col("type"), F.col("detail")).alias("anomaly_digest"), report.verdict_digest(F.col("requirement_id"), F.col("severity"), F.col("verdict"), F.lit(None).cast("string")).alias("verdict_digest"))
    out = {"requirements": matched, "anomalies": found, "envelope": envelope, "signals": hits, "verdicts": verdicts, "digests": digest}
    if clauses is None:
        gates = gates.withColumns({"regulatory": F.lit(None).cast("string"), "derogation_needed": F.lit(0)})  # a missing report counts as its worst
    else:
        rows = rules.extract(clauses)
        text = found.agg(F.lit(1).alias("anomaly_key"), F.concat_ws(" ", F.sort_array(F.collect_set("detail"))).alias("text"))
        findings = rules.evaluate(rows, text, report.evidence(anomalies=found))
        gates = gates.crossJoin(rules.gate(findings).select("derogation_needed", F.col("gate").alias("regulatory")))  # one row by one row
        out["findings"] = findings
        known = clause_index.clause_texts(clauses)
        kinds = found.agg(F.lit(1).alias("query_id"), F.collect_set("type").alias("kinds"))  # a handful of types
        ids = envelope.select(F.lit(1).alias("query_id"), F.slice(F.split(F.coalesce("primary_requirement_ids", F.lit("")), ", "), 1, 5).alias("ids"), F.col("human_summary").alias("t"))
        asked = kinds.join(ids, "query_id").select("query_id", requirements.clause_query(F.col("kinds"), F.filter("ids", lambda x: x != ""), F.col("t")).alias("text"))
        index = clause_index.VectorIndex.open(retrieval.embedded(known, "id", "body"), f"{shared_folder(spark)}/proofloom-indexes")
        out["clause_hits"] = clause_index.retrieve_clauses(asked, known, index, probes=None)
        snippets = matched.filter("evidence_source = 'retrieval_fallback'").select(F.lit(1).alias("run"), "ord", F.coalesce("snippet", F.lit("")).alias("text"))
        language = hits.select(F.lit(1).alias("run"), F.monotonically_increasing_id().alias("ord"), "strength", "snippet")
        out["citations"] = requirements.citations(snippets, out["clause_hits"].select(F.lit(1).alias("run"), F.col("rank").cast("long").alias("ord"), "title"), language, "run")
    out["decision"] = report.consolidated(gates, verdicts)
    return out


def digests(found: DataFrame) -> DataFrame:
    return found.select("anomaly_id", report.anomaly_digest(F.col("requirement_id"), F.col("severity"), F.col("type"), F.col("detail")).alias("digest"))


