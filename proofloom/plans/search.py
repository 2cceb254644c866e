"""Retrieval, chunking, context and collection queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.expansion import expanded
from ..operators import chunking, context, evaluation, retrieval, store
from .registry import SQL, query, table

_TOK = r"regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]+')"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- sparse
@query(f"SELECT doc_id, CAST(len({_TOK}) AS INTEGER) AS tokens, md5(array_to_string({_TOK}, ' ')) AS tokens_md5 FROM documents")
def bm25_tokenize(spark, sf):
    return _documents(spark, sf).select("doc_id", T.keyword_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(f"""WITH t AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS term FROM documents), n AS (SELECT count(*) AS docs, round(avg(len({_TOK})), 6) AS mean_len FROM documents)
    SELECT term, count(*) AS df, any_value(docs) AS docs, any_value(mean_len) AS mean_len FROM t, n GROUP BY term""")
def bm25_index_stats(spark, sf):
    df, n = retrieval.bm25_stats(_documents(spark, sf))
    return df.crossJoin(F.broadcast(n)).withColumn("mean_len", F.round("mean_len", 6))  # one row of totals


_BM25_SQL = f"""
    q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOK})) AS term FROM benchmark),
    d AS (SELECT doc_id, {_TOK} AS ts FROM documents), n AS (SELECT count(*) AS docs, avg(len(ts)) AS mean_len FROM d),
    p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT query_id, doc_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean_len)) + 1)), 10) AS score FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY query_id, doc_id),
    bm AS (SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20)"""


@query(f"WITH {_BM25_SQL} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm")
def bm25_topk(spark, sf):
    return retrieval.bm25(_asked(spark, sf), _documents(spark, sf), 20)


def _embedding_sql(name, source, key):
    return f"""
    {name}_t AS (SELECT {key}, CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % 128 AS bucket, count(*) AS n FROM (SELECT {key}, unnest({_WORDS}) AS w FROM {source}) GROUP BY ALL),
    {name} AS (SELECT {key}, bucket, n / sqrt(sum(CAST(n * n AS DOUBLE)) OVER (PARTITION BY {key})) AS weight FROM {name}_t)"""


_DENSE_SQL = f"""{_embedding_sql("eq", "benchmark", "item_id")}, {_embedding_sql("ed", "documents", "doc_id")},
    cs AS (SELECT item_id AS query_id, doc_id, round(sum(eq.weight * ed.weight), 10) AS score FROM eq JOIN ed USING (bucket) GROUP BY ALL),
    de AS (SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs) WHERE rank <= 20)"""


@query(f"WITH {_embedding_sql('e', 'documents', 'doc_id')} SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(weight, 6) AS weight FROM e")
def hash_embedding(spark, sf):
    return retrieval.hash_embedding(_documents(spark, sf), "doc_id").withColumn("weight", F.round("weight", 6))


def _hash_hits(spark, sf, k=20):
    return retrieval.hash_top_k(_asked(spark, sf), _documents(spark, sf), k)


@query(f"WITH {_DENSE_SQL} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM de")
def hash_topk(spark, sf):
    return _hash_hits(spark, sf)


# --- dense
def _vec_sql(score, k=10, where="TRUE"):
    return f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, round({score}, 6) AS score FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND {where})
    SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= {k}"""


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.filter(F.col("vec_id") % 20 == 0), v  # the stated set of queries


@query(_vec_sql("list_cosine_similarity(a.e, b.e)"))
def dense_topk_cosine(spark, sf):
    return retrieval.dense_top_k(*_vectors(spark, sf), 10, "cosine")


@query(_vec_sql("1 / (1 + list_distance(a.e, b.e))"))
def dense_topk_euclidean(spark, sf):
    return retrieval.dense_top_k(*_vectors(spark, sf), 10, "euclidean")


@query(_vec_sql("list_inner_product(a.e, b.e)"))
def dense_topk_dot(spark, sf):
    return retrieval.dense_top_k(*_vectors(spark, sf), 10, "dot")


@query(_vec_sql("list_cosine_similarity(a.e, b.e)", where="b.label = 3"))
def metadata_filtered_topk(spark, sf):
    q, v = _vectors(spark, sf)
    return store.Collection(v).search(q, 10, {"label": 3})


@query(f"SELECT * FROM ({_vec_sql('list_cosine_similarity(a.e, b.e)', 50)}) WHERE score >= 0.2")
def min_score_topk(spark, sf):
    q, v = _vectors(spark, sf)
    return store.Collection(v).search(q, 50, min_score=0.2)


@query(f"WITH {_BM25_SQL} SELECT bm.query_id, bm.doc_id, bm.score, CAST(bm.rank AS INTEGER) AS rank FROM bm JOIN documents AS d ON d.doc_id = bm.doc_id WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3', 'src4', 'src5') AND n_chars BETWEEN 100 AND 4000")
def post_filter_topk(spark, sf):
    meta = table(spark, sf, "documents").select("doc_id", "lang", F.array("source").alias("tags"), "n_chars")
    hits = retrieval.bm25(_asked(spark, sf), _documents(spark, sf), 20).join(meta, "doc_id")
    keep = store.exact_filter({"lang": "en"}) & store.tag_filter("tags", ["src1", "src2", "src3", "src4", "src5"]) & F.col("n_chars").between(100, 4000)
    return hits.filter(keep).select("query_id", "doc_id", "score", "rank")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 12:00:00'")
def date_filter(spark, sf):
    return table(spark, sf, "events").filter(store.date_filter(["ts"], "2024-01-05 00:00:00", "2024-01-09 12:00:00")).select("event_id", "ts")


# --- fusion and reranking
_EXACT_SQL = "ex AS (SELECT query_id, doc_id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM (SELECT item_id AS query_id, doc_id FROM benchmark AS b JOIN documents AS d ON contains(lower(d.text), lower(b.text))))"
_RRF_SQL = f"""{_DENSE_SQL}, {_BM25_SQL}, {_EXACT_SQL},
    al AS (SELECT query_id, doc_id, rank, 0 AS p, 'dense' AS name, score FROM de UNION ALL SELECT query_id, doc_id, rank, 1, 'bm25', score FROM bm UNION ALL SELECT query_id, doc_id, rank, 2, 'exact', score FROM ex),
    fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fused, string_agg(name, '+' ORDER BY p) AS sources, count(*) AS paths, max(score) FILTER (p = 0) AS dense_score, max(score) FILTER (p = 1) AS bm25_score FROM al GROUP BY ALL)"""


@query(f"WITH {_EXACT_SQL} SELECT query_id, doc_id FROM ex")
def exact_match_path(spark, sf):
    return retrieval.exact_matches(_asked(spark, sf), _documents(spark, sf))


def _fused(spark, sf):
    exact = retrieval.exact_matches(_asked(spark, sf), _documents(spark, sf)).withColumn("score", F.lit(1.0))
    exact = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return retrieval.fused({"dense": _hash_hits(spark, sf), "bm25": retrieval.bm25(_asked(spark, sf), _documents(spark, sf), 20), "exact": exact})


@query(f"WITH {_RRF_SQL} SELECT query_id, doc_id, fused, sources, paths, CASE paths WHEN 1 THEN 'single' WHEN 2 THEN 'partial' ELSE 'full' END AS agreement FROM fu")
def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "doc_id", "fused", "sources", "paths", retrieval.agreement(F.col("paths")).alias("agreement"))


_TITLE_STOP = "['and','with','the','for','level','check','through','its','via','that','this','from','into','test']"


def _title_sql(c):
    return f"[w FOR w IN regexp_extract_all(lower({c}), '[a-z][a-z0-9_-]{{2,}}') IF NOT list_contains({_TITLE_STOP}, w)]"


_RERANK_SQL = f"""{_RRF_SQL},
    j AS (SELECT fu.*, coalesce(dense_score, 1 / (1 + exp(-bm25_score / 5)), 0.5) AS base, substr(d.text, 1, 420) AS body, lower(substr(d.text, 1, 420)) AS low, source, b.text AS title, {_title_sql("b.text")} AS tt, list_distinct({_title_sql("substr(d.text, 1, 80)")}) AS dt FROM fu JOIN documents AS d ON d.doc_id = fu.doc_id JOIN benchmark AS b ON item_id = query_id),
    cv AS (SELECT *, len(list_intersect(dt, list_distinct(tt))) AS k FROM j),
    c2 AS (SELECT *, CASE WHEN k > 0 THEN least(0.99, round(base + 0.15 * k / len(dt) + 0.05 * k / len(list_distinct(tt)), 4)) ELSE base END AS covered FROM cv),
    c3 AS (SELECT *, len([t FOR t IN tt IF contains(low, t)]) AS m, len([z FOR z IN [concat(tt[i], ' ', tt[i + 1]) FOR i IN range(1, len(tt))] IF contains(low, z)]) AS bg, contains(low, lower(title)) AS inside FROM c2),
    c4 AS (SELECT *, (CASE WHEN inside THEN 0.15 ELSE 0.0 END + CASE WHEN len(tt) > 0 THEN least(4, m) * 0.04 + 0.08 * m / len(tt) ELSE 0.0 END + least(3, bg) * 0.06 + CASE paths WHEN 1 THEN 0.0 WHEN 2 THEN 0.02 ELSE 0.05 END)::DOUBLE AS boost FROM c3),
    rr AS (SELECT query_id, doc_id, source, round(CASE WHEN boost = 0 THEN covered ELSE least(0.99, round(covered + boost, 4)) END, 4) AS score, fused FROM c4)"""


def _reranked(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.substring("text", 1, 420).alias("body"), F.substring("text", 1, 80).alias("head"))
    rows = _fused(spark, sf).join(docs, "doc_id").join(F.broadcast(_asked(spark, sf).withColumnRenamed("text", "title")), "query_id")
    base = retrieval.base_score(F.col("dense_score"), F.col("bm25_score"))
    covered = retrieval.coverage_boost(base, F.col("head"), F.col("title"))
    rows = rows.withColumn("covered", covered)
    score = retrieval.evidence_boost(F.col("covered"), F.col("body"), F.col("title"), F.col("paths"), F.lit(False), F.lower("body").contains(F.lower("title")))
    return rows.withColumn("score", F.round(score, 4))


@query(f"WITH {_RERANK_SQL} SELECT query_id, doc_id, score FROM rr")
def evidence_rerank(spark, sf):
    return _reranked(spark, sf).select("query_id", "doc_id", "score")


@query(f"WITH {_RERANK_SQL} SELECT query_id, source, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, fused DESC, doc_id) AS r FROM rr) WHERE r = 1")
def dedupe_best(spark, sf):
    return retrieval.best_of(_reranked(spark, sf), "query_id", F.col("source"), F.desc("score"), F.desc("fused"), F.col("doc_id")).select("query_id", "source", "doc_id", "score")


@query(f"""WITH {_DENSE_SQL}, w AS (SELECT item_id, list_distinct({_WORDS}) AS qs FROM benchmark), x AS (SELECT doc_id, list_distinct({_WORDS}) AS ds FROM documents),
    h AS (SELECT query_id, de.doc_id, rank AS first_rank, round(0.8 * score + 0.2 * CASE WHEN len(qs) = 0 THEN 0 ELSE len(list_intersect(qs, ds)) / len(qs) END, 10) AS hybrid FROM de JOIN w ON item_id = query_id JOIN x ON x.doc_id = de.doc_id)
    SELECT query_id, doc_id, round(hybrid, 6) AS hybrid, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, first_rank) AS rank FROM h) WHERE rank <= 10""")
def hybrid_rerank(spark, sf):
    hits = _hash_hits(spark, sf).join(_documents(spark, sf), "doc_id").join(F.broadcast(_asked(spark, sf).withColumnRenamed("text", "query_text")), "query_id")
    return retrieval.hybrid(hits, 10).select("query_id", "doc_id", "hybrid", "rank")


@query(f"SELECT item_id, CAST(len(tt) AS INTEGER) AS tokens, md5(array_to_string([concat(tt[i], ' ', tt[i + 1]) FOR i IN range(1, len(tt))], '|')) AS bigrams_md5 FROM (SELECT item_id, {_title_sql('text')} AS tt FROM benchmark)")
def title_bigrams(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.title_tokens(F.col("text")).alias("t")).select("item_id", F.size("t").alias("tokens"), F.md5(F.array_join(T.bigrams(F.col("t")), "|").cast("binary")).alias("bigrams_md5"))


_GLOSSARY = (("with", ("together with", "along")), ("in the", ("inside",)), ("that", ("which",)), ("of", ("from the",)))


@query(r"""WITH b AS (SELECT doc_id, trim(text) AS base, lower(trim(text)) AS low FROM documents),
    f AS (SELECT doc_id, base, low, list_concat(list_concat(list_concat(
        CASE WHEN regexp_matches(low, '(^|[^\p{L}\p{N}_])with($|[^\p{L}\p{N}_])') THEN ['together with', 'along'] ELSE [] END, CASE WHEN contains(low, 'in the') THEN ['inside'] ELSE [] END),
        CASE WHEN regexp_matches(low, '(^|[^\p{L}\p{N}_])that($|[^\p{L}\p{N}_])') THEN ['which'] ELSE [] END), CASE WHEN regexp_matches(low, '(^|[^\p{L}\p{N}_])of($|[^\p{L}\p{N}_])') THEN ['from the'] ELSE [] END) AS fs FROM b)
    SELECT doc_id, CASE WHEN base = '' OR len([x FOR x IN fs IF NOT contains(low, x)]) = 0 THEN base ELSE concat(base, ' ', array_to_string([x FOR x IN fs IF NOT contains(low, x)], ' ')) END AS expanded FROM f""")
def query_expansion(spark, sf):
    return table(spark, sf, "documents").select("doc_id", expanded(F.trim("text"), _GLOSSARY, ()).alias("expanded"))


@query(r"""WITH t AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations),
    w AS (SELECT *, strpos(low, 'tion') AS pos, substr(low, greatest(1, strpos(low, 'tion') - 320), strpos(low, 'tion') + 4 + 320 - greatest(1, strpos(low, 'tion') - 320)) AS win FROM t)
    SELECT conv_id, turn, CASE WHEN pos > 0 AND contains(win, 'the the') THEN 'FAIL' WHEN pos > 0 AND contains(win, 'with') THEN 'PASS' WHEN contains(low, 'the the') THEN 'FAIL' WHEN contains(low, 'with') THEN 'PASS' ELSE 'UNKNOWN' END AS verdict,
        CASE WHEN pos > 0 AND (contains(win, 'the the') OR contains(win, 'with')) THEN 'proximity' ELSE 'full_text' END AS method FROM w""")
def proximity_verdict(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    v, m = retrieval.proximity(F.col("text"), F.lit("tion"), "(?i)the the", "(?i)with")
    return turns.select("conv_id", "turn", v.alias("verdict"), m.alias("method"))


@query(f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, a.label = b.label AS good, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10),
    t AS (SELECT query_id, count(*) FILTER (good) AS relevant FROM s GROUP BY query_id),
    p AS (SELECT query_id, coalesce(round(1.0::DOUBLE / min(rank) FILTER (good), 6), 0) AS rr, {", ".join(f"count(*) FILTER (good AND rank <= {k}) AS n{k}" for k in (1, 3, 5, 10))} FROM h GROUP BY query_id)
    SELECT count(*) AS queries, round(avg(rr), 6) AS rr, {", ".join(f"round(avg(CAST(n{k} > 0 AS INTEGER)), 6) AS hit_{k}, round(avg(round(n{k} / {k}, 6)), 6) AS p_{k}, round(avg(round(n{k} / relevant, 6)), 6) AS r_{k}" for k in (1, 3, 5, 10))} FROM p JOIN t USING (query_id) WHERE relevant > 0""")
def retrieval_metrics(spark, sf):
    q, v = _vectors(spark, sf)
    # what is relevant shares the query's label: counts a label, not pairs of vectors
    total = q.select(F.col("vec_id").alias("query_id"), "label").join(v.groupBy("label").agg((F.count("*") - 1).alias("relevant")), "label").filter("relevant > 0").select("query_id", "relevant")
    hits = retrieval.dense_top_k(q, v, 10).join(v.select("vec_id", F.col("label").alias("found")), "vec_id").join(q.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    marked = hits.withColumn("good", F.when(F.col("found") == F.col("label"), 1))
    return evaluation.means(evaluation.measured(marked, total))


# --- chunks and context
@query(r"""WITH d AS (SELECT doc_id, text, length(text) AS n, greatest(0, CAST(ceil((length(text) - 500) / 450) AS INTEGER)) AS last FROM documents WHERE length(text) > 0),
    s AS (SELECT doc_id, text, last + 1 AS total_chunks, unnest(range(0, last + 1)) AS chunk_index FROM d)
    SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(chunk_index * 450 AS INTEGER) AS start, total_chunks, md5(regexp_replace(substr(text, chunk_index * 450 + 1, 500), '^\s+|\s+$', '', 'g')) AS chunk_md5 FROM s WHERE regexp_replace(substr(text, chunk_index * 450 + 1, 500), '^\s+|\s+$', '', 'g') <> ''""")
def chunk_fixed(spark, sf):
    return chunking.fixed_chunks(_documents(spark, sf)).select("doc_id", "chunk_index", "start", "total_chunks", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def _end_sql(start: str) -> str:
    """Where a chunk of 500 characters that begins at ``start`` ends: as w, the last two fifths of its window, has it."""
    return rf"""CASE WHEN {start} + 500 >= n THEN n WHEN strpos(reverse(w), chr(10) || chr(10)) > 0 THEN {start} + 299 + length(w) - strpos(reverse(w), chr(10) || chr(10))
        WHEN regexp_matches(w, '[.!?]\s') THEN {start} + 300 + length(regexp_extract(w, '(?s)^(.*[.!?]\s+)', 1)) WHEN contains(w, ' ') THEN {start} + 300 + length(w) - strpos(reverse(w), ' ') ELSE {start} + 500 END"""


#: c: doc_id, k, s, chunk and total of every chunk that ends at a boundary.
BOUNDARY_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n, substr(text, 301, 200) AS w FROM documents WHERE length(text) > 0),
    r AS (SELECT doc_id, text, n, 0 AS k, 0 AS s, {_end_sql("0")} AS e FROM d
        UNION ALL SELECT doc_id, text, n, k, s, {_end_sql("s")} FROM (SELECT doc_id, text, n, k + 1 AS k, greatest(e - 50, s + 1) AS s, substr(text, greatest(e - 50, s + 1) + 301, 200) AS w FROM r WHERE e < n)),
    c AS (SELECT * FROM (SELECT doc_id, k, s, regexp_replace(substr(text, s + 1, e - s), '^\s+|\s+$', '', 'g') AS chunk, count(*) OVER (PARTITION BY doc_id) AS total FROM r) WHERE chunk <> '')"""


@query(f"{BOUNDARY_SQL} SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start, CAST(total AS INTEGER) AS total_chunks, md5(chunk) AS chunk_md5 FROM c")
def chunk_boundary(spark, sf):
    return chunking.boundary_chunks(_documents(spark, sf)).select("doc_id", "chunk_index", "start", "total_chunks", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.html_text(F.col("html")).cast("binary")).alias("text_md5"))


_CONTEXT_SQL = f"""{_BM25_SQL},
    k AS (SELECT query_id, bm.doc_id, source, score, rank, printf('[Source: %s, chunk %d/%d, score %.4f]' || chr(10) || '%s' || chr(10) || '---', source, rank, greatest(rank, 20), floor(score * 10000) / 10000, trim(text)) AS block FROM bm JOIN documents AS d ON d.doc_id = bm.doc_id)"""


def _blocks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("body"))
    hits = retrieval.bm25(_asked(spark, sf), _documents(spark, sf), 20).join(docs, "doc_id")
    return hits.withColumn("block", context.block(F.col("source"), F.col("rank") - 1, F.lit(20), F.floor(F.col("score") * 10000) / 10000, F.col("body")))  # no ties for the last place


@query(f"""WITH {_CONTEXT_SQL}, u AS (SELECT *, greatest(1, (length(block) + 3) // 4) AS tokens FROM k), b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM u),
    c AS (SELECT query_id, rank, rtrim(CASE WHEN used + tokens <= 1000 OR length(block) <= (1000 - used) * 4 THEN block WHEN (1000 - used) * 4 <= 35 THEN substr(block, 1, ((1000 - used) * 4)::BIGINT) ELSE concat(rtrim(substr(block, 1, ((1000 - used) * 4 - 35)::BIGINT)), '...', chr(10), '[TRUNCATED: max_tokens reached]') END) AS kept FROM b WHERE used < 1000)
    SELECT query_id, count(*) AS blocks, md5(string_agg(kept, chr(10) ORDER BY rank)) AS context_md5 FROM c GROUP BY query_id""")
def context_budget(spark, sf):
    out = context.context(context.budgeted(_blocks(spark, sf), "query_id", "rank", 1000), "query_id", "rank")
    return out.select("query_id", "blocks", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query(f"""WITH {_CONTEXT_SQL}, tt AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS turn, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pl FROM k), ff AS (SELECT *, min(pl) OVER (PARTITION BY query_id, source) AS first FROM tt)
    SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn, first) AS INTEGER) AS place FROM ff""")
def context_diversity(spark, sf):
    return context.diversified(_blocks(spark, sf), "query_id", "source", F.desc("score"), F.col("doc_id")).select("query_id", "doc_id", "place")


@query("SELECT user_id, event_id, CAST(place AS INTEGER) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS place FROM events) WHERE place <= 5")
def context_recent(spark, sf):
    return retrieval.ranked(table(spark, sf, "events"), "user_id", 5, F.desc_nulls_last("ts"), F.col("event_id")).select("user_id", "event_id", F.col("rank").alias("place"))


# --- collections
@query("SELECT vec_id, label, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id, label + 100, round(list_sum(CAST(embedding AS DOUBLE[])), 4) FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id + 1000000000, label, round(list_sum(CAST(embedding AS DOUBLE[])), 4) FROM embeddings WHERE vec_id % 7 = 0")
def vector_upsert(spark, sf):
    v = table(spark, sf, "embeddings")
    changed = v.filter("vec_id % 5 = 0").withColumn("label", F.col("label") + 100)
    added = v.filter("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000_000)
    new = changed.withColumn("at", F.lit(1)).unionByName(v.filter("vec_id % 5 = 0").withColumn("at", F.lit(0))).unionByName(added.withColumn("at", F.lit(0)))
    out = store.upsert(v, new, "vec_id", "at")
    return out.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("SELECT vec_id, label FROM embeddings WHERE label <> 4")
def vector_delete(spark, sf):
    v = table(spark, sf, "embeddings")
    gone = v.filter("label = 4").select("vec_id").unionByName(spark.range(-5, -1).withColumnRenamed("id", "vec_id"))
    return store.Collection(v).remove(gone).rows.select("vec_id", "label")
