"""A whole assessment over files, and its reports."""

import json

import pytest
from pyspark.sql import functions as F

from proofloom.operators import report, rules
from proofloom.plans import run


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "trace.csv").write_text("requirement_id,title,verification_status\nX-1,first,VERIFIED\nX-2,second,VERIFIED\nX-3,third,PLANNED\nX-4,fourth,Approved\n")
    (tmp_path / "logs.json").write_text(json.dumps({"metrics": {"failed_tests": 1}, "requirement_results": [{"requirement_id": "x-3", "result": "FAIL"}]}))
    (tmp_path / "evidence.txt").write_text("X-1 | first | PASS\nX-2 failed twice\nX-3 passed\n")
    (tmp_path / "mails.txt").write_text("--- EMAIL one\nall fine\n--- EMAIL two\nX-2: waiver granted by the ccb, temporary measure")
    (tmp_path / "auth.txt").write_text("X-2: formal deviation approved.\nX-4 is pending.")
    return tmp_path


def test_assessment(spark, inputs):
    out = run.assess(spark, *[str(inputs / n) for n in ("trace.csv", "logs.json", "evidence.txt", "mails.txt", "auth.txt")])
    assert {r.requirement_id: (r.outcome, r.log_result) for r in out["requirements"].collect()} == {"X-1": ("PASS", None), "X-2": ("FAIL", None), "X-3": ("PASS", "FAIL"), "X-4": ("NOT_FOUND", None)}
    got = {(r.requirement_id, r.type): r.verdict for r in out["verdicts"].collect()}
    # the window around X-4 reaches into the line of X-2
    assert got == {("X-2", "DOC_EVIDENCE_FAIL"): "JUSTIFICATION_SIGNALS", ("X-3", "LOG_FAIL_VS_DOC_PASS"): "RED_FLAG", ("X-4", "MISSING_TEST_DESIGN_EVIDENCE"): "JUSTIFICATION_SIGNALS", (None, "METRICS_REPORT_FAILED_TESTS"): "RED_FLAG"}
    d = out["decision"].first()
    assert (d.final_decision, d.overall, d.detective, d.derogation, d.worst_verdict) == ("NO-GO", "RED_FLAG", "SUSPICIOUS", "STRONG_SIGNALS", "RED_FLAG")
    assert out["envelope"].first().primary_requirement_ids == "X-2, X-3, X-4"
    assert run.digests(out["anomalies"]).count() == 4
    e = out["envelope"].first()
    assert e.retrieval_query.startswith("CEI EN 50128 railway software safety") and "X-2 X-3 X-4" in e.retrieval_query and e.retrieval_query.endswith("failed_tests_1") and len(e.fingerprint) == 64
    assert {r.anomaly_digest.split(" | ")[1] for r in out["digests"].collect()} == {"HIGH"}


def test_assessment_fills_open_outcomes_by_retrieval(spark, tmp_path):
    (tmp_path / "trace.csv").write_text("requirement_id,title,verification_status\nC6-APCS-1,Door sensor alarm,VERIFIED\nC6-APCS-2,Crowding levels panel,VERIFIED\nC6-APCS-3,Nowhere at all,VERIFIED\n")
    (tmp_path / "logs.json").write_text("{}")
    (tmp_path / "evidence.txt").write_text("C6-APCS-1 door sensor alarm\nThe door sensor alarm test was run and passed\nC6-APCS-2 crowding levels panel\nnothing more is said\n")
    (tmp_path / "none.txt").write_text("")
    names = [str(tmp_path / n) for n in ("trace.csv", "logs.json", "evidence.txt", "none.txt", "none.txt")]
    got = {r.requirement_id: (r.outcome, r.evidence_source) for r in run.assess(spark, *names)["requirements"].collect()}
    assert got["C6-APCS-1"] == ("PASS", "retrieval_fallback")
    plain = {r.requirement_id: r.outcome for r in run.assess(spark, *names, retrieve=False)["requirements"].collect()}
    assert plain == {"C6-APCS-1": "UNKNOWN", "C6-APCS-2": "UNKNOWN", "C6-APCS-3": "NOT_FOUND"}
    assert set(got) == set(plain)


def test_assessment_with_clauses(spark, inputs):
    clauses = spark.createDataFrame([("6.1", "Reports", "The supplier shall record test evidence for every requirement in the corpus. The train must stop at the platform edge line at once.")], "clause_id string, title string, text string")
    out = run.assess(spark, *[str(inputs / n) for n in ("trace.csv", "logs.json", "evidence.txt", "mails.txt", "auth.txt")], clauses=clauses, detective="CLEAR")
    assert {r.rule_id: r.status for r in out["findings"].collect()}["R-00001"] == "PASS"
    assert out["decision"].first().detective == "CLEAR"
    assert [(r["rank"], r.clause_id) for r in out["clause_hits"].collect()] == [(1, "6.1")]
    assert {"regulatory_clause", "derogation_language"} <= {r.kind for r in out["citations"].collect()}


def test_go_needs_every_gate(spark):
    gates = spark.createDataFrame([("PASS", "CLEAR", "CLEAR", "COMPLETE", "NO_SIGNALS", 0)], "matcher string, regulatory string, detective string, auditor string, derogation string, derogation_needed int")
    none = spark.createDataFrame([], "requirement_id string, severity string, verdict string")
    d = report.consolidated(gates, none).first()
    assert (d.final_decision, d.overall, d.worst_verdict) == ("GO", "CLEAR", "NONE")
    one = spark.createDataFrame([("X", "high", "red_flag")], none.schema)
    d = report.consolidated(gates, one).first()
    assert (d.final_decision, d.overall, d.safety_override) == ("NO-GO", "REVIEW_REQUIRED", True)


def test_digests(spark):
    row = spark.createDataFrame([(None, "high", "", "d" * 200), ("X", "?", "T", None)], "r string, s string, t string, d string")
    got = [r.x for r in row.select(report.anomaly_digest(F.col("r"), F.col("s"), F.col("t"), F.col("d")).alias("x")).collect()]
    assert got == ["- | HIGH | UNKNOWN | " + "d" * 157 + "...", "X | UNKNOWN | T"]


def test_auditor_report(spark):
    raw = spark.createDataFrame([("odd", "130", ["a", " "], None), ("COMPLIANT", "x", None, ["r"])], "overall_assessment string, compliance_score string, requirements_found array<string>, risks array<string>")
    assert [tuple(r) for r in report.auditor_report(raw).collect()] == [("PARTIAL", 100, ["a"], []), ("COMPLIANT", 0, [], ["r"])]


@pytest.mark.parametrize("most", [60, 120, 140, 400])
def test_focused_content(spark, most):
    docs = spark.createDataFrame([("p", "T", [(1, "H")], [["a", "b"], ["c", "d"]], ["one " * 5, "two"], "")], "path string, title string, headings array<struct<level: int, text: string>>, tables array<array<string>>, paragraphs array<string>, full_text string")
    text = report.focused(docs, most).first().content
    assert len(text) <= most and text.startswith("DOCUMENT TITLE: T\n\nKEY SECTIONS:\n  H")
    assert ("a  |  b\nc  |  d" in text) == (most == 400)


def test_evidence_rows(spark):
    found = spark.createDataFrame([(1, "T", "HIGH", "X", "d", None)], "ord int, type string, severity string, requirement_id string, detail string, evidence_snippet string")
    hits = spark.createDataFrame([(k, "p", "strong", "email", "s") for k in range(1, 8)], "ord int, pattern_id string, strength string, source string, snippet string")
    more = spark.createDataFrame([("risk", 1, "r"), ("risk", 2, " ")], "kind string, ord int, text string")
    got = {r.evidence_id: r.text for r in report.evidence(found, hits, None, more).collect()}
    assert got["matcher-anomaly-1"] == "T HIGH X d" and got["auditor-risk-1"] == "r" and len(got) == 7


def test_regulatory_gate(spark):
    kinds = "status string, severity string"
    for rows, want in (([], "PASS"), ([("PASS", "HIGH")], "PASS"), ([("WARNING", "LOW"), ("PASS", None)], "WARNING"), ([("FAIL", "MEDIUM")], "PASS"), ([("FAIL", "medium"), ("WARNING", "LOW")], "WARNING"), ([("FAIL", " high "), ("WARNING", "LOW")], "RED_FLAG")):
        got = rules.gate(spark.createDataFrame(rows, kinds)).first()
        assert (got.gate, got.rules_checked, got.derogation_needed) == (want, len(rows), sum(r[0] == "FAIL" for r in rows))


def test_missing_reports_count_as_their_worst(spark, inputs):
    (inputs / "mails.txt").write_text("--- EMAIL one\nall fine")
    out = run.assess(spark, *[str(inputs / n) for n in ("trace.csv", "logs.json", "evidence.txt", "mails.txt", "auth.txt")])
    d = out["decision"].first()
    assert (d.regulatory, d.detective, d.final_decision) == (None, None, "NO-GO")


@pytest.mark.parametrize(("severity", "matcher"), [("HIGH", None), (None, "high"), ("", "HIGH")])
def test_either_severity_column_blocks_a_release(spark, severity, matcher):
    gates = spark.createDataFrame([("PASS", "CLEAR", "CLEAR", "COMPLETE", "NO_SIGNALS", 0)], "matcher string, regulatory string, detective string, auditor string, derogation string, derogation_needed int")
    one = spark.createDataFrame([("X", severity, matcher, "RED_FLAG")], "requirement_id string, severity string, matcher_severity string, verdict string")
    assert report.consolidated(gates, one).first().final_decision == "NO-GO"
