"""The pipeline's stages against brute force, each on what the one before kept."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sequences import packed
from test_texts import deduped, linked

from proofloom.llm import quality, toxicity
from proofloom.llm.common import table


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """The rows after each stage, the awkward ones included."""
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(-1, None, "en", "src1", 0), (-2, "", "en", None, 0), (None, "a few words only", None, "src1", 16), (None, "a few words only", None, "src1", 16), (-3, "one word " * 9000, "en", "zzz", 81_000)], docs.schema)
    out = [docs.unionByName(odd)]
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, out[-1], sf_dir)
        rows = df.collect()
        out.append(spark.createDataFrame(rows, df.schema))
    return out


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "mixing", "best_fit_packing"]


def test_columns_stay(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes


def test_toxicity_rejects_what_scores_high(spark, sf_dir, steps):
    network = toxicity.fit(steps[0], table(spark, sf_dir, "labels"), "toxic", quality.remainder(4) != 2)
    rows = steps[0].collect()
    score = network.score([r.text for r in rows])
    assert Counter(map(str, steps[1].collect())) == Counter(str(r) for r, s in zip(rows, score, strict=True) if s < 0.3)
    clean = {r.doc_id for r in table(spark, sf_dir, "labels").filter("toxic = 0").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    assert len(clean & kept) >= 0.95 * len(clean)


def test_one_document_of_each_group_stays(steps):
    docs = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = Counter(str(d) for d, n, c in linked(docs) if d is not None and d == c or d is None and n == 0)
    want["None"] += 1  # of the two nameless rows that link
    assert Counter(str(r.doc_id) for r in steps[2].collect()) == want


def test_passages_go(steps):
    before = {r.doc_id: r.text for r in steps[2].filter("doc_id is not null").collect()}
    after = {r.doc_id: r.text for r in steps[3].filter("doc_id is not null").collect()}
    for d, n, gone, _ in deduped(list(before.items())):
        if gone == 0:
            assert after[d] == before[d]
        elif gone < n:
            assert len(after[d].split()) == n - gone
        else:
            assert d not in after
    assert all(r.n_chars == len(r.text or "") for r in steps[3].filter("text is not null").collect())


def test_mix_takes_near_targets(steps):
    from proofloom.llm import mixing

    size, took = defaultdict(int), defaultdict(int)
    for r in steps[3].collect():
        size[r.source] += len((r.text or "").split())
    for r in steps[4].collect():
        took[r.source] += len((r.text or "").split())
    want = mixing.targets(dict(size))
    assert all(abs(took[s] - want[s]) <= 1 for s in size)


def test_packing_holds_every_piece(steps):
    docs = [(r.doc_id, r.text) for r in steps[4].collect()]
    used, least = packed(steps[5].collect(), docs)
    assert used <= least + 2


def test_run_gives_the_packed_corpus(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    total = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 4096 for r in total) and np.mean([r.n for r in total]) > 3500


def test_empty_documents(spark, sf_dir):
    empty = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_stages_with_clashing_and_awkward_columns(spark, sf_dir):
    """Whatever the other columns are called, stages give what they give without them."""
    names = ["size", "_pass", "pass", "_spans", "spans", "_doc", "_t", "tid", "a.b", "_row", "row", "carried", "group", "id", "hash", "fate", "n", "c", "_block", "target", "`q`"]
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(words[k % 7 :] + [f"x{k}"] * (k % 5)), "en", f"s{k % 3}", 0) for k in range(40)] + [(3, "other text of the same id", "en", "s0", 0), (None, None, None, None, None)]
    plain = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    odd = plain.select("*", *[F.lit(f"v{i}").alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want, got = stage(spark, plain, sf_dir), stage(spark, odd, sf_dir)
        assert got.columns == odd.columns, name
        assert Counter(map(str, got.select(*plain.columns).collect())) == Counter(map(str, want.collect())), name


def test_one_row_of_repeated_rows_stays(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(1, text), (1, text), (1, "a text of its own under the same id"), (2, text + " more"), (None, "nameless and twice here"), (None, "nameless and twice here"), (4, None), (4, None)]
    got = corpus_pipeline.deduplicate(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf_dir).collect()
    assert Counter(map(tuple, got)) == Counter([(1, text), (1, "a text of its own under the same id"), (None, "nameless and twice here"), (4, None), (4, None)])
