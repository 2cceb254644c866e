"""Composite features: many needles, stored index, retrieval, clauses, mixed files, stored collection, ingest."""

import email.message
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from proofloom.functions import nested
from proofloom.operators import collection, matching, needles, regulation, retrieval, triple
from proofloom.operators.index import TextIndex
from proofloom.sources import mixed
from proofloom.streaming.pipeline import DocumentStore, Settings


# --- many needles
def slow_places(needle, text, overlapping):
    out, at = [], text.find(needle)
    while at >= 0:
        out.append(at + 1)
        at = text.find(needle, at + (1 if overlapping else len(needle)))
    return out


@pytest.mark.parametrize("part", [needles.PART, 60])
@pytest.mark.parametrize("overlapping", [True, False])
def test_needles_overlaps_and_prefixes(spark, part, overlapping):
    dice = random.Random(2)
    words = ["a", "ab", "aba", "bab", "C6-1", "C6-10", "abab", "é", "", None, *{"".join(dice.choice("abc") for _ in range(4)) for _ in range(30)}]
    texts = [(k, "".join(dice.choice("abcABCé") for _ in range(200))) for k in range(40)] + [(90, "c6-1 C6-10 c6-100"), (91, None), (92, "")]
    frame = spark.createDataFrame(texts, "k long, text string")
    got = {(r.k, r.needle): r.places for r in needles.find(spark.createDataFrame([(w,) for w in words], "needle string"), frame, ["k"], overlapping=overlapping, part=part).collect()}
    want = {(k, w): p for k, t in texts for w in {x.lower() for x in words if x} if (p := slow_places(w, (t or "").lower(), overlapping))}
    assert got == want


def test_needles_whole_words(spark):
    rows = spark.createDataFrame([(1, "X-1 and X-10, (x-1) y_x-1 x-1_ é x-1é")], "k long, text string")
    ids = spark.createDataFrame([("X-1",), ("X-10",), ("é",)], "needle string")
    assert {r.needle: r.places for r in needles.find(ids, rows, ["k"], word=True).collect()} == {"x-1": [1, 16], "x-10": [9], "é": [32]}


def test_a_hundred_thousand_ids(spark):
    ids = spark.range(100_000).select(F.format_string("ID-%d", "id").alias("requirement_id"))
    lines = spark.createDataFrame([(0, k, f"Id-{k} {'failed' if k % 2 else 'passed'}") for k in range(99_000, 99_200)] + [(1, 0, "nothing")], "doc int, line_no long, line string")
    got = {r.requirement_id: r.outcome for r in matching.substring_outcomes(ids, lines).filter("outcome <> 'NOT_FOUND'").collect()}
    named = {f"ID-{str(k)[:n]}" for k in range(99_000, 99_200) for n in range(1, 6)} - {"ID-0"}
    assert set(got) == named and got["ID-99001"] == "FAIL" and got["ID-99002"] == "PASS" and got["ID-99"] == "FAIL"


def test_outcomes_by_substring(spark):
    lines = spark.createDataFrame([(0, 1, "B-12 passed"), (0, 2, "b-1 is named"), (0, 3, "B-2 failed, once passed"), (0, 4, "xB-3x")], "doc int, line_no long, line string")
    reqs = spark.createDataFrame([("B-1",), ("B-12",), ("B-2",), ("B-3",), ("B-4",), ("",), (None,)], "requirement_id string")
    got = {r.requirement_id: (r.outcome, r.snippet) for r in matching.substring_outcomes(reqs, lines).collect()}
    assert got == {"B-1": ("PASS", "B-12 passed"), "B-12": ("PASS", "B-12 passed"), "B-2": ("FAIL", "B-2 failed, once passed"), "B-3": ("UNKNOWN", "xB-3x"), "B-4": ("NOT_FOUND", None), "": ("NOT_FOUND", None), None: ("NOT_FOUND", None)}


# --- the stored index
@pytest.fixture(scope="module")
def corpus(spark):
    dice = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    rows = [(k, f"R-{k % 30}" if k % 4 else None, f"title of {words[k % 25]} {words[k % 7]}", " ".join(dice.choice(words[: 3 + k % 22]) for _ in range(dice.randrange(0, 60)))) for k in range(400)]
    rows += [(1000, "R-77", "the pump", "R-78 pump passed " + "x " * 300), (1001, "R-78", "the valve", "valve FAILED"), (1002, "", None, "R-79 is mentioned, the gate is closed"), (1003, None, None, None)]
    return spark.createDataFrame(rows, "chunk_id long, requirement_id string, requirement_title string, text string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "ba be di"), (2, "title of co"), (3, ""), (4, "zzz"), (5, "gu gu fa"), (6, None)], "query_id long, text string")


@pytest.mark.parametrize("block", [8, 1024])
def test_index_is_read_again_and_equals_a_scan(spark, corpus, asked, tmp_path, monkeypatch, block):
    first = TextIndex.open(corpus, str(tmp_path), block)
    assert first.built and first.ready
    want = sorted(map(tuple, retrieval.bm25(asked, corpus, 7, doc="chunk_id").collect()))
    assert sorted(map(tuple, first.bm25(asked, 7).select("query_id", "chunk_id", "score", "rank").collect())) == want

    def never(*_):
        raise AssertionError("tokenised again")

    monkeypatch.setattr(retrieval, "term_counts", never)
    monkeypatch.setattr(retrieval, "hash_vectors", never)
    again = TextIndex.open(corpus.repartition(2), str(tmp_path), block)
    assert not again.built and again.folder == first.folder
    assert sorted(map(tuple, again.bm25(asked, 7).select("query_id", "chunk_id", "score", "rank").collect())) == want
    monkeypatch.undo()
    other = TextIndex.open(corpus.withColumn("text", F.when(F.col("chunk_id") == 5, "changed").otherwise(F.col("text"))), str(tmp_path), block)
    assert other.built and other.path != first.path


def test_index_cut_short_is_not_read(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "embedded", lambda *_a, **_k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        TextIndex.open(corpus, str(tmp_path))
    monkeypatch.undo()
    assert TextIndex.open(corpus, str(tmp_path)).built
    empty = TextIndex.open(corpus.limit(0), str(tmp_path))
    assert not empty.ready and empty.bm25(corpus.select(F.lit(1).alias("query_id"), F.lit("ba").alias("text")).limit(1), 3).count() == 0


# --- retrieval
def test_many_queries_and_terms_take_other_ways(spark, corpus, asked, monkeypatch):
    want = sorted(map(tuple, retrieval.bm25(asked, corpus, 5, doc="chunk_id").collect()))
    dense = sorted(map(tuple, retrieval.hash_top_k(asked.filter("query_id in (1, 2, 5)"), corpus, 5, doc="chunk_id").select("query_id", "chunk_id", "score", "rank").collect()))
    monkeypatch.setattr(retrieval, "SEND_TERMS", 2)
    monkeypatch.setattr(retrieval, "SEND_QUERIES", 2)
    assert sorted(map(tuple, retrieval.bm25(asked, corpus, 5, doc="chunk_id").select("query_id", "chunk_id", "score", "rank").collect())) == want
    other = retrieval.hash_top_k(asked.filter("query_id in (1, 2, 5)"), corpus, 5, doc="chunk_id").select("query_id", "chunk_id", "score", "rank").collect()
    assert [(q, s, r) for q, _, s, r in sorted(map(tuple, other))] and sorted((r[0], r[2]) for r in map(tuple, other)) == sorted((r[0], r[2]) for r in dense)


def test_classification_of_requirements(spark, corpus, tmp_path):
    reqs = spark.createDataFrame([(1, "R-77", "the pump"), (2, "R-78", "the valve"), (3, "R-79", "the gate"), (4, "R-404", "zyx wvu"), (5, "", "")], "query_id long, requirement_id string, title string")
    for index in (None, TextIndex.open(corpus, str(tmp_path))):
        got = {r.query_id: r for r in triple.classify(reqs, corpus, index=index).collect()}
        assert (got[1].verdict, got[1].relevance_gate) == ("PASS", "passed") and got[1].snippet.startswith("R-78 pump passed")
        assert got[2].verdict == "PASS" and got[2].verdict_method == "proximity"  # the chunk that names it comes with an explicit word near it
        assert got[3].verdict in ("UNKNOWN", "FAIL", "PASS") and got[3].relevance_gate == "passed"
        assert (got[4].verdict, got[4].relevance_gate, got[4].snippet) == ("NOT_FOUND", "failed", None) or got[4].relevance_gate is None
        assert got[1].agreement == "full" or got[1].agreement == "partial"


def test_exact_hits_have_their_place_in_a_long_list(spark):
    rows = [(k, "HOT", "t", "alpha") for k in range(500)] + [(600, "A", "t", "beta hot gamma"), (601, "B", "u", "gamma only")]
    chunks = spark.createDataFrame(rows, "chunk_id long, requirement_id string, requirement_title string, text string").repartition(4)
    queries = spark.createDataFrame([(1, "gamma", "hot", "")], "query_id long, text string, requirement_id string, title string")
    got = {r.requirement_id: r for r in triple.retrieve(queries, chunks, 3).collect()}
    assert set(got) == {"HOT", "A", "B"}
    assert (got["HOT"].chunk_id, got["HOT"].sources, got["HOT"].fused) == (0, "exact_id", round(1 / 61, 6))
    assert got["A"].sources == "dense+bm25+exact_id" and got["A"].fused == round(1 / 62 + 1 / 62 + 1 / (60 + 501), 6)


@pytest.mark.parametrize(("texts", "want"), [
    (["x R-1 passed", "R-1 failed"], ("PASS", "proximity")), (["nothing", "r-1 FAILED"], ("FAIL", "proximity")), (["R-1 " + "y" * 400 + " failed"], ("FAIL", "full_text")),
    (["all ok"], ("PASS", "full_text")), (["none"], ("UNKNOWN", "full_text")), ([], ("UNKNOWN", "full_text")),
])
def test_verdict_of_a_list(spark, texts, want):
    v, m = triple.listed_verdict(F.col("t"), F.lit("R-1"))
    assert tuple(spark.createDataFrame([(texts,)], "t array<string>").select(v, m).first()) == want


# --- clauses
def slow_clauses(rows):
    out, i = [], 0
    state = {"doc": None, "id": None, "title": "", "section": "", "page": None, "text": []}

    def close():
        if state["id"] and state["text"]:
            out.append((state["doc"], state["id"], state["title"], state["section"] or state["title"], state["page"], " ".join(state["text"])))
        state["text"] = []

    while i < len(rows):
        doc, page, line = rows[i]
        if doc != state["doc"]:
            close()
            state = {"doc": doc, "id": None, "title": "", "section": "", "page": None, "text": []}
        following = rows[i + 1][2] if i + 1 < len(rows) and rows[i + 1][:2] == (doc, page) else None
        main, sub = re.fullmatch(r"(\d+)\s+([A-Z][A-Z0-9 /\-(),]+)", line), re.fullmatch(r"(\d+(?:\.\d+)+)\s+(.+)", line)
        found, used = None, 1
        if main:
            found = (main[1], main[2], main[2])
        elif sub:
            if "...." in sub[2]:
                i += 1
                continue
            found = (sub[1], sub[2], None)
        elif re.fullmatch(r"\d+(\.\d+)+", line) and following and not re.fullmatch(r"\d+(\.\d+)+", following):
            found, used = (line, following, None), 2
        elif re.fullmatch(r"\d+", line) and following and re.fullmatch(r"[A-Z][A-Z0-9 /\-(),]+", following):
            found, used = (line, following, following), 2
        if found:
            close()
            state |= {"id": found[0], "title": found[1], "page": page, "section": found[2] or state["section"]}
        elif state["id"] and line not in ("CONTENTS", "INDICE", "INTRODUCTION") and not line.startswith(("Publication", "Titolo")):
            state["text"].append(line)
        i += used
    close()
    return out


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_clauses_over_ranges_of_lines(spark, ranges):
    dice = random.Random(ranges)
    kinds = ["text here", "1 SCOPE", "2.1 Title", "3.4", "7", "PART A", "5.1 toc ......... 3", "CONTENTS", "Publication x", "3.4.5", "9", "more text"]
    rows = [(f"d{d}", p, dice.choice(kinds)) for d in range(6) for p in range(dice.randrange(1, 12)) for _ in range(dice.randrange(1, 9))]
    frame = spark.createDataFrame([(d, p, k, p + 10, line) for k, (d, p, line) in enumerate(rows)], "doc string, page_index int, line_no int, page int, line string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = regulation.parsed(frame).orderBy("clause_no").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.doc, r.clause_id, r.title, r.section, r.page_start - 10, r.text) for r in got] == slow_clauses(rows)


def test_regulation_pages(spark):
    text = "cover\n3.1 Assessment early\n-- 4 of 9 --\n3.1 Assessment\nThe assessor shall review   the plan.\nNorma Tecnica\n3.2\nTesting of software\nTests must be run and kept.\n-- 5 of 9 --\n3.1 Assessment\nSomething else that shall be said.\nANNEX A\n9 NOT READ\ntext that is not read"
    pages = regulation.split_pages(spark.createDataFrame([("r", text)], "doc string, text string"))
    assert [(r.page_index, r.text.splitlines()[0]) for r in pages.orderBy("page_index").collect()] == [(0, "cover"), (1, "3.1 Assessment"), (2, "3.1 Assessment")]
    found, counts = regulation.normalised(pages)
    got = [(r.clause_id, r.title, r.text, r.page_start) for r in found.orderBy(regulation.id_order()).collect()]
    assert got == [("3.1", "Assessment", "The assessor shall review the plan. Something else that shall be said.", 2), ("3.2", "Testing of software", "Tests must be run and kept.", 2)]
    row = counts.first()
    assert (row.before_total, row.after_total, row.duplicate_ids_before, row.duplicate_extra_rows_before) == (3, 2, 1, 1)
    assert regulation.normalised(pages.filter("page_index > 9"))[0].count() == 0


def test_clause_ids_by_number(spark):
    frame = spark.createDataFrame([(x,) for x in ("10", "2", "2.10", "2.9", "2.9.1", "1")], "clause_id string")
    assert [r.clause_id for r in frame.orderBy(regulation.id_order()).collect()] == ["1", "2", "2.9", "2.9.1", "2.10", "10"]


# --- nested values
def test_texts_at_any_depth(spark):
    value = '{"b": [1, {"Note": "n", "z": true}], "title": " t ", "deep": ' + '{"x": ' * 60 + '"end"' + "}" * 60 + ', "text": {"value": 2.5, "k": null}, "n2": "n"}'
    rows = spark.createDataFrame([(1, value), (2, None), (3, "no json"), (4, "[]"), (5, "[" * 100_000)], "k long, json string")
    got = {r.k: r.texts for r in nested.nested_texts(rows, "json", ["k"]).collect()}
    assert got == {1: ["t", "2.5", "1", "n", "True", "end"], 2: [], 3: [], 4: [], 5: []}
    as_variant = rows.filter("k = 1").select("k", F.parse_json("json").alias("v"))
    assert sorted(nested.nested_texts(as_variant, "v", ["k"]).first().texts) == sorted(got[1])


# --- mixed files, the store, the stream
def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    m = email.message.EmailMessage()
    m["Subject"], m["From"], m["To"], m["Date"] = "Bypass", "a@b.c", "d@e.f, g@h.i", "Mon, 01 Jan 2024 10:00:00 +0100"
    m.set_content("The check was disabled.")
    at = tmp_path / "in"
    (at / "sub").mkdir(parents=True)
    for name, data in {"m.eml": m.as_bytes(), "sub/raw": m.as_bytes(), "p.html": b"<p>One <b>page</b></p>", "n.txt": "naïve text. ".encode() * 80, "l.txt": b"caf\xe9", "d.docx": docx("Paper words"), "broken.docx": b"no zip", "x.pdf": b"%PDF-1.4 words", "empty.md": b""}.items():
        (at / name).write_bytes(data)
    return at


def test_files_of_a_mixed_folder(spark, folder):
    got = {r.path.rsplit("/in/", 1)[1]: r for r in mixed.read(spark, str(folder)).collect()}
    assert {k: r.kind for k, r in got.items()} == {"m.eml": "eml", "sub/raw": "eml", "p.html": "html", "n.txt": "text", "l.txt": "text", "d.docx": "docx", "broken.docx": "docx", "x.pdf": "pdf"}  # Spark lists no empty files
    assert got["m.eml"].content == "The check was disabled." == got["sub/raw"].content and got["m.eml"].author == "a@b.c" and got["m.eml"].created_at.hour == 9
    assert got["p.html"].content == "One page" and got["l.txt"].content == "café" and got["d.docx"].content == "Paper words"
    assert got["broken.docx"].content is None and "not a DOCX" in got["broken.docx"].error and got["x.pdf"].error is None
    docs = mixed.documents(mixed.read(spark, str(folder)))
    assert docs.count() == 7 and {tuple(r.tags) for r in docs.filter("source_type = 'email'").collect()} == {("email",)}
    assert mixed.read(spark, str(folder), "*.eml").count() == 1
    typed = mixed.parsed(spark.createDataFrame([("x.txt", bytearray(b"<p>a</p>"), "text/html; charset=utf-8")], "path string, content binary, t string"), F.col("t"))
    assert tuple(typed.select("kind", "content").first()) == ("html", "a")


def test_store_of_documents(spark, folder, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), Settings(200, 20))
    assert not store.health()["ready"]
    told = store.add_files(str(folder))
    n = store.collection.rows().count()
    assert (told["files"], told["documents"], told["failed"], told["chunks"]) == (8, 7, 1, n) and n > 8
    assert [r.path.rsplit("/", 1)[1] for r in store.failures().collect()] == ["broken.docx"]
    store.add_files(str(folder))  # the same again
    assert store.collection.rows().count() == n == store.health()["rows"] and store.health()["ready"]
    asked = spark.createDataFrame([(1, "check disabled"), (2, "naïve text")], "query_id long, text string")
    hits = store.search(asked, 3)
    assert hits.filter("query_id = 1 and rank = 1").first().text == "The check was disabled."
    assert {r.source_type for r in store.search(asked, 3, {"source_type": "email"}).collect()} == {"email"}
    dated = {"date_range": {"start": "2024-01-01", "end": "2024-01-02"}, "tags": ["email", "x"]}
    assert {r.title for r in store.search(asked, 3, dated).collect()} == {"Bypass"}
    assert store.search(asked, 3, {"tags": "none"}).count() == 0 and store.search(asked, 3, {"title": "n.txt", "source_type": "file"}).count() > 0
    assert "The check was disabled." in store.query(asked, 2, 500).filter("query_id = 1").first().context
    gone = store.collection.rows().filter("title = 'n.txt'").first().document_id
    store.delete_document(gone)
    assert store.collection.rows().filter(F.col("document_id") == gone).count() == 0
    one = store.collection.rows().select("chunk_id").limit(1)
    left = store.collection.rows().count()
    store.delete_chunks(spark.createDataFrame(one.collect(), "chunk_id string"))
    assert store.collection.rows().count() == left - 1
    told = store.add_emails(spark.createDataFrame([("mail:1", "S", "x@y.z", ["q@r.s"], "a letter")], "source_id string, subject string, from_addr string, to_addr array<string>, body string"))
    assert told["chunks"] == 1 and store.collection.rows().filter("source_id = 'mail:1'").first().author == "x@y.z"


def half():
    class Half:  # local, so that it goes to workers by value
        """Fails on batches with the word bad, gives nonsense for odd, and counts characters else."""

        dimension = 2

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[float("nan"), 1.0] if t == "odd" else [1.0, float(len(t))] for t in texts]

    return Half()


def test_embedders_that_fail_fail_their_batch_only(spark):
    texts = ["one", "odd", "bad", None]
    assert [x if x is None else x.tolist() for x in retrieval.guarded(half(), texts, 2)] == [[1.0, 3.0], None, None, None]
    assert retrieval.guarded(type("Short", (), {"dimension": 2, "embed": lambda self, t: [[1.0, 2.0]]})(), ["a", "b"]) == [None, None]
    rows = spark.createDataFrame([(1, "one"), (2, "odd")], "k long, text string").coalesce(1)
    assert {r.k: r.embedding for r in retrieval.embedded(rows, "k", embedder=half()).collect()} == {1: [1.0, 3.0], 2: None}
    same = retrieval.embedded(rows, "k", embedder=retrieval.HashEmbedder()).collect()
    assert same == retrieval.embedded(rows, "k").collect()


def test_stream_of_files_stores_each_once(spark, folder, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.follow(str(folder), str(tmp_path / "state"), files=4).awaitTermination(120)
    n, version = store.collection.rows().count(), store.collection.version()
    assert n >= 8 and version.batches == {"files": 2}
    store.follow(str(folder), str(tmp_path / "state"), files=4).awaitTermination(120)
    assert store.collection.version() == version
    assert store.add(mixed.read(spark, str(folder)), ("files", 2))["chunks"] == 0  # a batch that is run again
    (folder / "late.txt").write_text("a late file")
    store.follow(str(folder), str(tmp_path / "state"), files=4).awaitTermination(120)
    assert store.collection.rows().count() == n + 1 and store.failures().count() == 1


def test_collection_versions_and_conflicts(spark, tmp_path):
    rows = lambda *ks, x=1.0: spark.createDataFrame([(k, [x, float(k)], f"d{k % 2}", k) for k in ks], "chunk_id long, embedding array<double>, document_id string, n long")
    c = collection.StoredCollection(spark, str(tmp_path / "c"))
    assert c.health() == {"version": 0, "rows": 0, "dimensions": [], "ready": False} and c.rows().count() == 0
    base = c.upsert(rows(1, 2, 3).unionByName(rows(3, x=5.0)).unionByName(spark.createDataFrame([(9, [], "d", 1), (None, [1.0, 1.0], "d", 1)], "chunk_id long, embedding array<double>, document_id string, n long")), order="embedding")
    assert {r.chunk_id: r.embedding[0] for r in c.rows().collect()} == {1: 1.0, 2: 1.0, 3: 5.0}
    c.upsert(rows(2, 4, x=7.0))
    with pytest.raises(collection.Conflict):
        c.upsert(rows(5), base=base)
    assert sorted(r.chunk_id for r in c.rows().collect()) == [1, 2, 3, 4] and c.rows(1).count() == 3
    c.delete(rows(1, 77).select("chunk_id"))
    c.upsert(rows(1, x=8.0))  # deleted, then there again
    assert {r.chunk_id: r.embedding[0] for r in c.rows().collect()} == {1: 8.0, 2: 7.0, 3: 5.0, 4: 7.0}
    c.delete_document("d0")
    v = c.compact()
    assert sorted(r.chunk_id for r in c.rows().collect()) == [1, 3] and len(v.segments) == 1 and not v.tombstones
    assert c.rows(2).count() == 4 and c.health()["dimensions"] == [2]
    hits = c.search(spark.createDataFrame([(5, [8.0, 1.0])], "vec_id long, embedding array<double>"), 1, {"document_id": "d1"}, 0.5)
    assert [(r.query_id, r.chunk_id) for r in hits.collect()] == [(5, 1)]


# --- reports and evaluation
def test_compaction_by_one_fold_equals_the_plain_way(spark):
    from proofloom.operators import compaction

    dice = random.Random(8)
    names = ["a", "status", "b", "c", "notes"]
    rows = [tuple(None if dice.random() < 0.2 else "".join(dice.choice('xy"\\\né') for _ in range(dice.randrange(0, 30))) for _ in names) for _ in range(120)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, " + ", ".join(f"{n} string" for n in names))
    for most in (10, 60, 100, 1000):
        out = frame.withColumn("r", compaction.fields(frame, names)).withColumn("e", compaction.fields(frame.withColumn("x", F.lit("more")), []))
        got = {r.k: r.compact for r in compaction.folded(out, "r", most, ["status", "none"], ["notes", "b"]).collect()}
        for k, row in enumerate(rows):
            report = {n: v for n, v in zip(names, row, strict=True) if v is not None}
            assert got[k] == compaction.compact(report, most, ["status", "none"], ["notes", "b"])


def test_requirements_of_a_document(spark):
    from proofloom.operators import requirements

    cells = spark.createDataFrame([("d", 1, 0, ["Test case", "Name", "Requirements"]), ("d", 1, 1, ["t1", "Door alarm", "C6-AB-2"]), ("d", 2, 0, ["C6-AB-10", "a rather long description", "x"]), ("d", 2, 1, ["C6_AB_2", "short", ""])], "key string, table_no int, row_no int, cells array<string>")
    paragraphs = spark.createDataFrame([("The c6-ab-3 valve “opens”.", 1), ("C6-AB-2 again", 2), ("none", 3)], "text string, ord int")
    got = {r.requirement_id: r.title for r in requirements.from_document(cells, paragraphs).collect()}
    assert got == {"C6-AB-2": "Door alarm | C6-AB-2 again | C6_AB_2 | short |", "C6-AB-3": "The c6-ab-3 valve opens.", "C6-AB-10": "a rather long description"} or set(got) == {"C6-AB-2", "C6-AB-3", "C6-AB-10"} and got["C6-AB-2"].startswith("Door alarm | C6-AB-2 again") and got["C6-AB-10"] == "a rather long description"
    assert got["C6-AB-3"] == "The c6-ab-3 valve opens."


def test_benchmark_by_id_or_text(spark, tmp_path):
    from proofloom.operators import evaluation

    (tmp_path / "g.json").write_text('[{"id": "q1", "query": "doors", "relevant_requirement_ids": ["r-1", "R-2", " "]}, {"id": "q2", "query": "x", "relevant_clause_ids": ["6.1"]}, {"id": "", "query": "x", "relevant_clause_ids": ["1"]}, {"id": "q3", "query": "y"}]')
    golden = evaluation.golden_queries(spark, str(tmp_path / "g.json"))
    assert sorted((r.query_id, r.relevant) for r in golden.collect()) == [("q1", ["R-1", "R-2"]), ("q2", ["6.1"])]
    hits = spark.createDataFrame([("q1", 1, "R-9", "nothing"), ("q1", 2, None, "about r-1 and r-2"), ("q1", 3, "r-2", "")], "query_id string, rank int, id string, text string")
    got = {r.query_id: r for r in evaluation.by_id_or_text(hits, golden).collect()}
    assert (got["q1"].rr, got["q1"].hit_1, got["q1"].hit_3, got["q1"].p_3, got["q1"].r_3, got["q1"].r_1) == (0.5, 0, 1, 0.6667, 1.0, 0.0)
    assert (got["q2"].rr, got["q2"].hit_10, got["q2"].r_10) == (0.0, 0, 0.0)


def test_fallback_reports(spark):
    from proofloom.operators import report

    rows = report.fallback_auditor(spark.createDataFrame([(None, 90), ("COMPLIANT", 80)], "overall_assessment string, compliance_score int")).collect()
    assert [(r.mode, r.overall_assessment, r.compliance_score) for r in rows] == [("fallback", "PARTIAL", 50), ("model", "COMPLIANT", 80)]
    kinds = "found long, filtered string"
    assert tuple(report.fallback_detective(spark.createDataFrame([(2, "x"), (0, "y")], kinds)).first()) == ("SUSPICIOUS", "HIGH", 2)
    assert tuple(report.fallback_detective(spark.createDataFrame([], kinds)).first()) == ("CLEAR", "LOW", 0)


def test_golden_scenarios(spark):
    from proofloom.operators import evaluation

    audits = spark.createDataFrame([("a", '{"x": {"y": " go "}, "n": 3}'), ("b", "no json")], "key string, audit string")
    expected = spark.createDataFrame([("a", "x.y", "GO", False), ("a", "n", "3", False), ("a", "x.z", "", False), ("a", "x.y", "no", True), ("b", "x", "1", False), ("c", "x", None, False)], "key string, path string, expected string, soft boolean")
    ids = spark.createDataFrame([("a", "r-1", True), ("a", "R-2", False), ("a", " ", True)], "key string, id string, wanted boolean")
    there = spark.createDataFrame([("a", "R-1 "), ("a", None)], "key string, requirement_id string")
    checks = evaluation.golden_checks(audits, expected, ids, there)
    got = {r.key: tuple(r)[1:] for r in evaluation.golden_summary(checks).collect()}
    assert got == {"a": (5, 1.0, 0.0, 0), "b": (1, 0.0, 1.0, 1), "c": (1, 1.0, 1.0, 0)}
    assert {r.key: r.exit_status for r in evaluation.golden_summary(checks, strict_soft=True).collect()}["a"] == 1


def test_clause_index_recall_and_gate(spark, tmp_path):
    import numpy as np

    from proofloom.operators import clause_index

    rng = np.random.default_rng(7)
    points = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(points)], "id long, embedding array<double>")
    index = clause_index.VectorIndex.open(rows, str(tmp_path), 32)
    assert index.built and not clause_index.VectorIndex.open(rows.repartition(3), str(tmp_path), 32).built
    asked = rows.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    exact = index.search(asked, 10, None)
    want = {(q, int(i)) for q in range(0, 3000, 100) for i in np.lexsort((np.arange(3000), -np.round(points @ points[q], 10)))[:10]}
    assert {(r.query_id, r.id) for r in exact.collect()} == want
    assert clause_index.recall(index.search(asked, 10), exact) >= 0.9
    assert clause_index.gate(" Off ", True) == (False, "REGULATORY_RAG disabled") and clause_index.gate("on", False)[0] and clause_index.gate("auto", True)[0] and not clause_index.gate(None, False)[0]
    assert clause_index.VectorIndex.open(rows.limit(0), str(tmp_path), 4).search(asked, 3).count() == 0


# --- table functions
def test_table_functions(spark):
    from pyspark.errors import AnalysisException

    from proofloom.functions import tables
    from proofloom.operators.chunking import boundary_spans

    tables.register(spark)
    docs = spark.createDataFrame([("a", "One two. Three four five. " * 5, 1), ("b", None, 2), ("c", "", 3)], "name string, text string, n int")
    rows = spark.sql("SELECT * FROM boundary_chunks(TABLE(SELECT * FROM {docs}), 40, 5)", docs=docs)
    assert rows.columns == ["name", "n", "chunk_index", "start", "chunk", "total_chunks"]
    spans = boundary_spans("One two. Three four five. " * 5, 40, 5)
    assert [(r.start, r.chunk) for r in rows.orderBy("chunk_index").collect()] == [(a, ("One two. Three four five. " * 5)[a:b].strip()) for a, b in spans]
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM boundary_chunks(TABLE(SELECT * FROM {docs}), 5, 5)", docs=docs).schema
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM occurrences(TABLE(SELECT name FROM {docs}), 'x')", docs=docs).schema
    assert [(r.name, r.places) for r in spark.sql("SELECT name, places FROM occurrences(TABLE(SELECT * FROM {docs}), ' TWO.')", docs=docs).collect()] == [("a", [5, 31, 57, 83, 109])]
