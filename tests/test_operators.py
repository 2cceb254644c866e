"""Operators on small hand-made inputs, against plain Python or known values."""

import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from proofloom.functions import enums
from proofloom.functions import text as T
from proofloom.functions.expansion import GLOSSARY, expanded
from proofloom.operators import chunking, clauses, compaction, context, evaluation, governance, matching, requirements, retrieval, rules, store
from proofloom.sources import documents, files, sinks, tables
from proofloom.streaming import ingest


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


# --- matching
def test_outcomes_of_lines(spark):
    reqs = spark.createDataFrame([("X-1", "VERIFIED"), ("X-10", "planned"), ("Y-2", "approved"), ("Z", "")], "requirement_id string, status string")
    lines = spark.createDataFrame([(0, 1, "x-1 | OK"), (0, 2, "X-10 failed twice"), (0, 3, "y-2 nothing said"), (0, 4, "passing x-1")], "doc int, line_no int, line string")
    got = {r.requirement_id: (r.outcome, r.snippet) for r in matching.substring_outcomes(reqs, lines).collect()}
    assert got == {"X-1": ("FAIL", "x-1 | OK"), "X-10": ("FAIL", "X-10 failed twice"), "Y-2": ("UNKNOWN", "y-2 nothing said"), "Z": ("NOT_FOUND", None)}
    got = {r.requirement_id: r.outcome for r in matching.substring_outcomes(reqs, lines, word=True).collect()}
    assert got["X-1"] == "PASS" and got["X-10"] == "FAIL"


def test_anomaly_slots_and_numbers(spark):
    rows = [("A", "Verified", "NOT_FOUND", None, None, 1), ("B", "VALIDATED", "FAIL", "s", "FAIL", 2), ("C", "complete", "UNKNOWN", "s", None, 3), ("D", "PLANNED", "PASS", "s", "FAIL", 4), (" ", "VERIFIED", "NOT_FOUND", None, None, 5)]
    matched = spark.createDataFrame(rows, "requirement_id string, status string, outcome string, snippet string, log_result string, ord long")
    found = matching.numbered(matching.anomalies(matched), ["ord", "slot"])
    got = sorted((r.anomaly_id, r.requirement_id, r.type, r.severity) for r in found.collect())
    assert got == [
        ("a-0001", "A", "MISSING_TEST_DESIGN_EVIDENCE", "HIGH"),
        ("a-0002", "B", "DOC_EVIDENCE_FAIL", "HIGH"),
        ("a-0003", "B", "LOG_FAIL_VS_VERIFIED_REQUIREMENT", "HIGH"),
        ("a-0004", "C", "WEAK_VERIFICATION_SIGNAL", "MEDIUM"),
        ("a-0005", "D", "LOG_FAIL_VS_DOC_PASS", "HIGH"),
    ]
    s = matching.summary(matched, found, 3).first()
    assert (s.status, s.anomalies_count, s.high_severity_count, s.medium_severity_count, s.metrics_failed_tests) == ("RED_FLAG", 6, 5, 1, 3)


@pytest.mark.parametrize(("direct", "found", "want"), [("PASS", "FAIL", "PASS"), ("UNKNOWN", "FAIL", "FAIL"), ("UNKNOWN", "UNKNOWN", "UNKNOWN"), ("NOT_FOUND", "UNKNOWN", "UNKNOWN"), ("NOT_FOUND", "NOT_FOUND", "NOT_FOUND")])
def test_merged_outcome(spark, direct, found, want):
    value, source = matching.merged_outcome(F.lit(direct), F.lit(found))
    row = spark.range(1).select(value.alias("v"), source.alias("s")).first()
    assert row.v == want and (row.s == "retrieval_fallback") == (want != direct or (direct, found) == ("NOT_FOUND", "UNKNOWN"))


# --- enums and gates
@pytest.mark.parametrize("text", ["NO-GO", "no_go", "NOGO", "no go", " No-Go ", "N O G O", "nO_gO", "no--go"])
def test_no_go_spellings(spark, text):
    assert one(spark, text, enums.release_decision) == "NO-GO"


@pytest.mark.parametrize(("text", "want"), [("go", "GO"), (" Go ", "GO"), ("conditional-go", "CONDITIONAL_GO"), ("going", "UNKNOWN"), ("", "UNKNOWN"), (None, "UNKNOWN")])
def test_other_decisions(spark, text, want):
    assert one(spark, text, enums.release_decision) == want


@pytest.mark.parametrize(("text", "want"), [("high", "HIGH"), (" Medium ", "MEDIUM"), ("CRITICAL", "UNKNOWN"), ("", "UNKNOWN"), (None, "UNKNOWN"), ("HIGH!", "UNKNOWN")])
def test_severity(spark, text, want):
    assert one(spark, text, enums.normalise) == want


@pytest.mark.parametrize(
    ("gates", "want"),
    [(("PASS", "CLEAR", "CLEAR", "COMPLETE", 0, False), "GO"), ((None, None, None, None, None, None), "NO-GO"), (("RED_FLAG", "CLEAR", "CLEAR", "COMPLETE", 0, False), "NO-GO"), (("PASS", "CLEAR", "CLEAR", "COMPLETE", 1, False), "NO-GO"), (("PASS", "CLEAR", "suspicious", "COMPLETE", 0, False), "NO-GO"), (("PASS", "CLEAR", "ERROR", "COMPLETE", 0, False), "GO"), (("PASS", "CLEAR", "CLEAR", "non_compliant", 0, False), "NO-GO"), (("PASS", "CLEAR", "CLEAR", "COMPLETE", 0, True), "NO-GO")],
)
def test_release_gate(spark, gates, want):
    row = spark.createDataFrame([gates], "m string, r string, d string, a string, n int, h boolean")
    assert row.select(governance.release_gate(*[F.col(c) for c in "mrdanh"]).alias("x")).first().x == want
    if gates[2] == "ERROR":
        assert row.select(governance.release_gate(*[F.col(c) for c in "mrdanh"], strict=True).alias("x")).first().x == "NO-GO"


# --- governance language
SENTENCES = {
    "approved_derogation": "see the approved derogation note", "formal_deviation_approved": "a formal deviation approved by all", "deviation_or_exception_approved": "exception approved", "waiver_granted_or_approved": "Waiver granted",
    "ccb_approval_language": "the CCB has agreed", "configuration_control_approval": "configuration control board will accept", "signoff_recorded": "sign-off was recorded", "officially_accepted_risk": "officially accepted risk",
    "derogation_mentioned": "a derogation", "waiver_or_deviation_request": "waiver still pending", "accepted_risk_phrase": "an accepted risk", "qa_lead_signoff_language": "QA lead will sign",
    "workaround_or_bypass": "use the bypass", "skip_or_disable_tests": "skip the slow test", "manual_kubectl_apply": "manually run kubectl", "just_to_pass_language": "just to pass",
}


def test_every_pattern_has_a_sentence(spark):
    rows = spark.createDataFrame([(k, "email", v) for k, v in SENTENCES.items()], "name string, source string, window string")
    got = {(r["name"], r.pattern_id) for r in governance.signals(rows).collect()}
    assert {(k, k) for k in SENTENCES} <= got
    assert {r.pattern_id for r in governance.signals(rows.filter("name = 'workaround_or_bypass'")).collect()} == {"workaround_or_bypass"}


def test_scores_leave_excused_risks_out(spark):
    rows = spark.createDataFrame([("a", "email", "waiver granted, use the bypass"), ("b", "email", "use the bypass"), ("b", "auth", "use the bypass"), ("b", "auth", "use the bypass")], "anomaly_id string, source string, window string")
    got = {r.anomaly_id: (r.justification_score, r.hits, r.has_strong) for r in governance.scored(governance.signals(rows), ["anomaly_id"], ["ord"]).collect()}
    assert got == {"a": (3, 2, True), "b": (-4, 2, False)}


@pytest.mark.parametrize(("severity", "score", "strong", "want"), [("HIGH", 4, True, "JUSTIFICATION_SIGNALS"), ("HIGH", 4, False, "REVIEW"), ("high", 0, True, "REVIEW"), ("HIGH", 1, False, "RED_FLAG"), ("MEDIUM", 9, True, "TRACKED"), ("HIGH", -2, None, "RED_FLAG")])
def test_verdicts(spark, severity, score, strong, want):
    row = spark.createDataFrame([(severity, score, strong)], "s string, n int, b boolean")
    assert row.select(governance.verdict(F.col("s"), F.col("n"), F.col("b")).alias("v")).first().v == want


def test_occurrences(spark):
    text = "aXbxx  end X." * 3
    rows = spark.createDataFrame([(1, text), (2, "none"), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.at) for r in governance.occurrences(rows, F.lit("x"), radius=3).collect()]
    assert got == [(1, m.start() + 1) for m in re.finditer("x", text.lower())]


def test_message_prefilter(spark):
    log = "head\n--- EMAIL 1\nfine--- EMAIL 2\nuse a Workaround--- EMAIL   "
    rows = spark.createDataFrame([(1, log), (2, "--- EMAIL all fine")], "k long, log string")
    got = {r.k: r.filtered for r in governance.alarming(governance.message_blocks(rows, "k", "log"), "k").collect()}
    assert got == {1: "--- EMAIL  2\nuse a Workaround", 2: governance.NOTHING}


# --- text
def test_tokenizers(spark):
    text = "The Fit-Level test_1 x 9a schöpf ABC abc; Überall"
    assert one(spark, text, T.keyword_tokens) == ["the", "fit-level", "test_1", "sch", "pf", "abc", "abc", "berall"]
    assert set(one(spark, text, T.words)) == {"the", "fit", "level", "test_1", "x", "9a", "schöpf", "abc", "überall"}
    assert set(one(spark, text, T.rule_tokens)) == {"fit", "level", "abc"}
    assert one(spark, "Level check of the RTM section", T.title_tokens) == ["rtm", "section"]
    assert one(spark, "rtm panel section", lambda c: T.bigrams(T.title_tokens(c))) == ["rtm panel", "panel section"]
    assert one(spark, "see c6_apcs_12 and C6-APCS-3", T.ids) == ["C6-APCS-12", "C6-APCS-3"]


def test_sentences_and_rules(spark):
    clause = "Intro. The supplier shall keep a test report of every release. If a hazard is found, the team must stop all of the work at once! You should maybe design it with great care. shall. ♦ ♦ ♦ ♦ ♦ ♦ it shall be listed here as rows of a table"
    frame = spark.createDataFrame([("6.1", "Title", clause)], "clause_id string, title string, text string")
    got = [(r.rule_id, r.modality, r.category, r.severity, r.condition) for r in rules.extract(frame).orderBy("rule_id").collect()]
    assert got == [("R-00001", "SHALL", "verification_and_testing", "HIGH", None), ("R-00002", "MUST", "safety_assurance", "HIGH", "If a hazard is found"), ("R-00003", "SHOULD", "lifecycle_engineering", "MEDIUM", None)]


@pytest.mark.parametrize(("text", "want"), [("short", "short"), ('a  "b"\n c', "a 'b' c"), ("word " * 100, ("word " * 100)[:359].rsplit(" ", 1)[0] + "…")])
def test_excerpt(spark, text, want):
    assert one(spark, text, T.excerpt) == want


def test_expansion(spark):
    assert one(spark, "RTM alarm", expanded) == "RTM alarm real time monitoring"
    assert one(spark, "crowding on the PSD", expanded) == "crowding on the PSD platform screen door passenger density occupancy level occupancy threshold"
    assert one(spark, "artful filter", expanded) == "artful filter"
    assert one(spark, " ", expanded) == ""
    assert one(spark, "x", lambda c: expanded(c, verification=True)).startswith("x verification")
    assert len(GLOSSARY) == 34


# --- chunks
def slow_spans(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        stop = min(start + size, len(text))
        end = stop
        if stop < len(text):
            low = start + max(1, int(size * 0.6))
            low = start if low >= stop else low
            found = text.rfind("\n\n", low, stop)
            if found == -1:
                ends = [low + m.end() for m in re.finditer(r"[.!?]\s+", text[low:stop])]
                found = ends[-1] if ends else text.rfind(" ", low, stop)
            end = found if found > start else stop
        out.append((start, end))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def test_boundary_spans():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bc", " ", "  ", ". ", "!\n", "\n\n", "?"]) for _ in range(rng.randrange(0, 400)))
        size = rng.randrange(2, 60)
        overlap = rng.randrange(0, size)
        assert chunking.boundary_spans(text, size, overlap) == slow_spans(text, size, overlap)


def test_chunks_of_documents(spark):
    docs = spark.createDataFrame([(1, "abc def. ghi jkl"), (2, ""), (3, None), (4, "     " * 5)], "doc_id long, text string")
    fixed = [(r.doc_id, r.chunk_index, r.start, r.chunk) for r in chunking.fixed_chunks(docs, 8, 2).collect()]
    assert fixed == [(1, 0, 0, "abc def."), (1, 1, 6, "f. ghi j"), (1, 2, 12, "jkl")]
    bound = [(r.doc_id, r.chunk) for r in chunking.boundary_chunks(docs, 10, 2).collect()]
    assert bound == [(1, "abc def."), (1, "ghi jkl")] or bound[0] == (1, "abc def.")
    named = chunking.with_metadata(chunking.fixed_chunks(docs, 8, 2), docs.withColumn("tag", F.lit("t"))).first()
    assert named.chunk_id == "1:0" and named.position == "1 of 3" and named.tag == "t"
    with pytest.raises(ValueError):
        chunking.fixed_chunks(docs, 5, 5)


# --- retrieval and context
def test_bm25_by_hand(spark):
    import math

    docs = [(1, "alpha beta beta"), (2, "beta gamma"), (3, ""), (4, "alpha alpha delta epsilon")]
    asked = [(9, "alpha beta alpha"), (8, "nothing")]
    got = {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in retrieval.bm25(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 10).collect()}
    tokens = {d: t.split() for d, t in docs}
    mean, n = sum(map(len, tokens.values())) / 4, 4
    want = {}
    for d, ts in tokens.items():
        s = 0.0
        for term in {"alpha", "beta"}:
            df, tf = sum(term in x for x in tokens.values()), ts.count(term)
            if tf:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / mean)) + 1)
        if s:
            want[9, d] = round(s, 6)
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want)
    assert [k for k, v in sorted(got.items(), key=lambda x: x[1][1])] == sorted(want, key=lambda k: -want[k])


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_dense_top_k_blocks(spark, metric):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)] + [(100, [0.0] * 4), (101, rng and [0.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a = {tuple(r) for r in retrieval.dense_top_k(frame.limit(20), frame, 5, metric, block=7).collect()}
    b = {tuple(r) for r in retrieval.dense_top_k(frame.limit(20), frame, 5, metric).collect()}
    assert a == b and len(a) == 100


def test_proximity(spark):
    far = "x" * 400
    rows = [(f"ID-1 passed {far} failed", ("PASS", "proximity")), (f"ID-1 {far} failed", ("FAIL", "full_text")), ("nothing", ("UNKNOWN", "full_text")), ("id-1 ok but fail", ("FAIL", "proximity"))]
    frame = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    v, m = retrieval.proximity(F.col("t"), F.lit("ID-1"), T.FAIL_LINE, T.PASS_LINE)
    assert [tuple(r) for r in frame.select(v, m).collect()] == [w for _, w in rows]


def test_context_budget(spark):
    rows = spark.createDataFrame([(1, k, "b" * 40 + str(k)) for k in range(1, 6)], "q int, place int, block string")
    out = context.context(context.budgeted(rows, "q", "place", 30), "q", "place").first()
    assert out.context.split("\n")[0] == "b" * 40 + "1" and out.blocks == 3
    with pytest.raises(ValueError):
        context.budgeted(rows, "q", "place", 0)


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], "query_id long, vec_id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 99), (2, 21), (3, 30)], "query_id long, vec_id long")
    got = {r.query_id: (r.rr, r.hit_3, r.p_3, r.r_3) for r in evaluation.per_query(hits, relevant, (3,)).collect()}
    assert got == {1: (0.5, 1, 0.333333, 0.5), 2: (0.0, 0, 0.0, 0.0), 3: (0.0, 0, 0.0, 0.0)}
    m = evaluation.means(evaluation.per_query(hits, relevant, (3,)), (3,)).first()
    assert m.queries == 3 and m.rr == round(0.5 / 3, 6)
    assert evaluation.accuracy(spark.createDataFrame([], "ok boolean")).first().accuracy == 1.0


# --- compaction
REPORT = {"a": "x" * 50, "status": "OK", "b": [1, 2, 3], "c": "y" * 30}


@pytest.mark.parametrize("most", [10, 40, 90, 160, 1000])
def test_compaction_keeps_what_must_stay(most):
    text = compaction.compact(REPORT, most, ["status"], ["b"])
    body = text.removesuffix("\n" + compaction.MARK)
    assert json.loads(body)["status"] == "OK"
    assert len(text) <= most or text.endswith(compaction.MARK)


def test_compaction_order():
    assert "c" not in json.loads(compaction.compact(REPORT, 110, ["status"], ["b"])) and "b" in json.loads(compaction.compact(REPORT, 110, ["status"], ["b"]))
    assert "b" not in json.loads(compaction.compact(REPORT, 110, ["status"], ["b"], documented=True))
    assert compaction.compact(None, 10) == "{}"


@pytest.mark.parametrize("text", ['q"uote', "back\\slash", "\x00\x01", "日本語", '{"a": 1}', "z" * 10_000, "123", "", " "])
def test_compaction_odd_strings(text):
    assert json.loads(compaction.compact({"k": text, "keep": text}, 100_000, ["keep"])) == {"keep": text, "k": text}


# --- clauses, requirements, store
def test_clause_groups(spark):
    rows = spark.createDataFrame([(1, "intro\n5 Scope\nfirst line\n\n5.1 Terms\nsecond\nthird")], "doc_id long, text string")
    got = clauses.body(clauses.grouped(clauses.lines(rows, "doc_id"), "doc_id", F.col("line").rlike(clauses.HEADER)), "doc_id").orderBy("clause_no").collect()
    assert [(r.title, r.text, r.n_lines) for r in got] == [("5 Scope", "first line", 2), ("5.1 Terms", "second third", 3)]


def test_excerpts(spark):
    text = ["a", "b", "X-1 Test objective: see", "Expected result fine", "", "Passed", "c", "d", "e", "f far", "rtm panel view"]
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "doc_id int, line_no int, line string")
    r = requirements.excerpts(lines, F.lower("line").contains("x-1"), F.lit("RTM panel")).first()
    assert r.excerpts == ["a", "b", "X-1 Test objective: see", "Expected result fine", "Passed", "c", "d", "rtm panel view"]
    assert (r.test_objective, r.expected_result, r.verification_status) == ("X-1 Test objective: see", "Expected result fine", "passed")


def test_entry_text(spark):
    row = spark.range(1).select(requirements.entry(F.lit("X-1"), F.lit("RTM view"), F.lit(None), F.array(F.lit("l1")), F.lit(""), F.lit("fine")).alias("t")).first()
    assert row.t == "Requirement ID: X-1\nRequirement title: RTM view\nTitle restated: RTM view\nSynonyms: RTM view real time monitoring\nEvidence:\n  l1\nExpected result: fine"


def test_entries_of_requirements(spark):
    text = ["intro", "C6-APCS-1 objective: x", "C6-APCS-10 other", "passed", "", "plain", "z", "far away"]
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(text)], "doc string, line_no int, line string")
    reqs = spark.createDataFrame([("C6-APCS-1", "RTM view"), ("c6-apcs-1", "again"), ("C6-APCS-7", "absent"), ("", "blank")], "requirement_id string, title string")
    rows = requirements.entries(reqs, lines, r"(?i)C6-APCS-\d+").collect()
    assert [r.requirement_id for r in rows] == ["C6-APCS-1"]
    assert rows[0].content.split("\n") == [
        "Requirement ID: C6-APCS-1", "Requirement title: RTM view", "Title restated: RTM view", "Synonyms: RTM view real time monitoring", "Verification status: passed", "Evidence:",
        "  intro", "  C6-APCS-1 objective: x", "  passed", "  plain", "  z", "  far away", "Test objective: C6-APCS-1 objective: x",
    ]
    titles = requirements.paragraph_titles(lines.withColumnRenamed("line_no", "ord").withColumnRenamed("line", "text"))
    assert {r.requirement_id: r.title for r in titles.collect()}["C6-APCS-10"] == "C6-APCS-10 other"


def test_documents_and_index_key(spark):
    texts = spark.createDataFrame([("/a/x.txt", "one"), ("/a/y.txt", "two")], "path string, text string")
    docs = documents.from_texts(texts)
    assert sorted((r.title, r.content, r.source_type) for r in docs.collect()) == [("x.txt", "one", "file"), ("y.txt", "two", "file")]
    same = documents.index_key(docs.repartition(3), 500, 50)
    assert same == documents.index_key(docs, 500, 50) != documents.index_key(docs.filter("content = 'one'"), 500, 50)
    mails = spark.createDataFrame([("p", "s", "a@b", ["c@d"], None, "body", ["f.txt"])], "path string, subject string, from_addr string, to_addr array<string>, sent timestamp, body string, attachments array<string>")
    r = documents.from_emails(mails).first()
    assert (r.author, r.extra_fields["attachments"], r.tags, r.source_type) == ("a@b", "f.txt", ["email"], "email")


def test_fallback_titles(spark):
    rows = spark.createDataFrame([(1, ["C6-APCS-1", "a long enough cell", "short"]), (2, ["C6-APCS-1", "an even longer enough cell"]), (3, ["C6-APCS-2", "tiny"])], "ord int, cells array<string>")
    got = {r.requirement_id: r.title for r in requirements.fallback_titles(rows).collect()}
    assert got == {"C6-APCS-1": "an even longer enough cell", "C6-APCS-2": "C6-APCS-2 | tiny"}


def test_collection(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a", "d1"), (2, [0.0, 1.0], "b", "d2")], "vec_id long, embedding array<double>, tag string, document_id string")
    more = spark.createDataFrame([(2, [1.0, 1.0], "c", "d2"), (3, [0.5, 0.5], "a", "d3"), (4, [], "x", "d4")], rows.schema)
    c = store.Collection(rows).add(more)
    assert {(r.vec_id, r.tag) for r in c.rows.collect()} == {(1, "a"), (2, "c"), (3, "a")}
    assert {r.vec_id for r in c.remove_document("d2").rows.collect()} == {1, 3}
    q = spark.createDataFrame([(50, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in c.search(q, 2).orderBy("rank").collect()] == [1, 2]
    assert [r.vec_id for r in c.search(q, 2, {"tag": "a"}, 0.9).collect()] == [1]
    h = c.health().first()
    assert (h.vectors, h.dimension, h.ready) == (3, 2, True)


# --- sources and sinks
def test_requirements_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿Requirement ID , title,verification_status\nX-1, a title ,VERIFIED\n#note,,\n,,\nX-2,\"b, c\",\n".encode())
    got = [(r.requirement_id, r.title, r.verification_status) for r in tables.requirements_csv(spark, str(tmp_path / "r.csv")).collect()]
    assert got == [("X-1", "a title", "VERIFIED"), ("X-2", "b, c", "")]


def test_logs_json(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"metrics": {"failed_tests": 2}, "requirement_results": [{"requirement_id": "x-1", "result": "PASS"}, {"requirement_id": "X-1", "result": "fail"}]}))
    logs = tables.test_logs_json(spark, str(tmp_path / "l.json"))
    assert logs.first().metrics.failed_tests == 2
    assert [tuple(r) for r in matching.last_wins(tables.log_results(logs), "requirement_id", "result", "ord").collect()] == [("X-1", "FAIL")]


def test_text_encodings(spark, tmp_path):
    for name, data in (("a", "é one".encode()), ("b", b"\xef\xbb\xbf" + "é two".encode()), ("c", "é three".encode("utf-16"))):
        (tmp_path / f"{name}.txt").write_bytes(data)
    assert sorted(r.text for r in tables.whole_text(spark, str(tmp_path)).collect()) == ["é one", "é three", "é two"]


def test_corpus_takes_the_sidecar_if_ids_are_missing(spark):
    line = lambda rows: spark.createDataFrame(rows, "line_no int, line string")
    ids = spark.createDataFrame([("X-1",), ("X-2",)], "requirement_id string")
    body, side = line([(0, "x-1 passed " + "z" * 90)]), line([(0, "X-2 passed")])
    assert tables.evidence_corpus(body, side, ids).count() == 2
    assert tables.evidence_corpus(body, side, ids.limit(1)).count() == 1


def test_email_and_docx(spark, tmp_path):
    mail = b"Subject: =?utf-8?q?Caf=C3=A9?=\r\nFrom: a@b\r\nTo: c@d, e@f\r\nDate: Mon, 01 Jan 2024 10:00:00 +0200\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>no</p>\r\n--B\r\nContent-Type: text/plain\r\n\r\nhello\r\n--B\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=f.txt\r\n\r\nx\r\n--B--\r\n"
    (tmp_path / "m.eml").write_bytes(mail)
    r = files.emails(spark, str(tmp_path / "m.eml")).first()
    assert (r.subject, r.from_addr, r.to_addr, str(r.sent), r.body, r.attachments) == ("Café", "a@b", ["c@d", "e@f"], "2024-01-01 08:00:00", "hello", ["f.txt"])
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Te</w:t></w:r><w:r><w:t>xt</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "d.docx").write_bytes(buffer.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    got = {r.title: (r.paragraphs, r.tables, r.full_text) for r in files.docx(spark, str(tmp_path / "*.docx")).collect()}
    assert got == {"Head": (["Head", "Text"], [["c1", "c2"]], "Head\nText\nc1 | c2"), "bad": ([], [], "")}


def test_html_pieces():
    assert files.html_pieces("<p>a &amp; b</p><script>x</script><!-- no --> c ") == "a & b x c"


def test_audit_bundle(spark):
    rows = spark.createDataFrame([(k, "x") for k in range(20)], "k int, t string")
    bundle = json.loads(sinks.audit_bundle({"rows": rows}, 3).first().bundle)
    assert bundle["rows_rows"] == 20 and [r["k"] for r in json.loads(bundle["rows"])] == [0, 1, 2]


# --- streaming
def test_last_results_of_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = ingest.last_results(ingest.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
    got = {r.user_id: r.event_type for r in spark.read.parquet(str(last)).collect()}
    assert got == {r.user_id: r.event_type for r in events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type")).collect()}


def test_windows_of_a_stream(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(ingest.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
