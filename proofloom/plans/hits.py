"""Queries of retrieval over chunks: three paths at once, and verdicts of requirements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expansion import CROWDING, GLOSSARY
from ..operators import chunking, clause_index, regulation, retrieval, triple
from ..operators.index import TextIndex
from ..staging import shared_folder
from .registry import query, table
from .search import _BM25_SQL, _TOK, _documents, _embedding_sql, _title_sql

#: Chunks of a document at most: more than the longest text can have.
_MOST = 1 << 21


def chunks(spark, sf):
    """chunk_id, requirement_id (the source), requirement_title (the document's first line's head), text."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("requirement_id"), F.substring("text", 1, 80).alias("requirement_title"))
    parts = chunking.fixed_chunks(docs, 1400, 120, keep=("requirement_id", "requirement_title"))
    return parts.select((F.col("doc_id") * _MOST + F.col("chunk_index")).alias("chunk_id"), "requirement_id", "requirement_title", F.col("chunk").alias("text"))


def _asked(spark, sf):
    """Passages as queries: a third ask for a source, a third for a word of theirs, a third for no id."""
    rows = table(spark, sf, "benchmark")
    k = F.col("item_id") % 3
    rid = F.when(k == 0, F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string"))).when(k == 1, F.regexp_extract("text", r"(\w{5,})", 1)).otherwise("")
    return rows.select(F.col("item_id").alias("query_id"), "text", rid.alias("requirement_id"), F.substring("text", 1, 60).alias("title"))


_CHUNKS_SQL = r"""
    dn AS (SELECT doc_id, source, text, greatest(0, CAST(ceil((length(text) - 1400) / 1280) AS INTEGER)) AS last FROM documents WHERE length(text) > 0),
    dc AS (SELECT doc_id, source, text, unnest(range(0, last + 1)) AS i FROM dn),
    ch AS (SELECT doc_id * 2097152 + i AS chunk_id, source AS rid, upper(trim(coalesce(source, ''))) AS u, substr(text, 1, 80) AS rtitle, regexp_replace(substr(text, i * 1280 + 1, 1400), '^\s+|\s+$', '', 'g') AS text FROM dc
        WHERE regexp_replace(substr(text, i * 1280 + 1, 1400), '^\s+|\s+$', '', 'g') <> ''),
    ti AS (SELECT u, arg_min(trim(rtitle), chunk_id) AS ttitle FROM ch WHERE u <> '' AND trim(rtitle) <> '' GROUP BY u)"""
_ASKED_SQL = r"""qr AS (SELECT item_id AS query_id, text, CASE item_id % 3 WHEN 0 THEN concat('SRC', item_id % 20) WHEN 1 THEN regexp_extract(text, '(\w{5,})', 1) ELSE '' END AS rid, substr(text, 1, 60) AS title FROM benchmark)"""


def _has(term: str) -> str:
    return f"contains(low, '{term}')" if " " in term or "-" in term else f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_]){term}($|[^\\p{{L}}\\p{{N}}_])')"


def _listed(forms) -> str:
    return "[" + ", ".join(f"'{f}'" for f in forms) + "]"


_EXPANDED_SQL = f"""
    qe AS (SELECT *, trim(text) AS base, lower(trim(text)) AS low FROM qr),
    qf AS (SELECT *, flatten([{", ".join(f"CASE WHEN {_has(t)} THEN {_listed(f)} ELSE [] END" for t, f in GLOSSARY)}, CASE WHEN {" OR ".join(map(_has, CROWDING))} THEN {_listed(CROWDING)} ELSE [] END]) AS forms FROM qe),
    qg AS (SELECT *, list_filter(forms, lambda x, i: list_position(forms, x) = i AND NOT contains(low, x)) AS more FROM qf),
    q AS (SELECT query_id, rid, title, CASE WHEN len(more) = 0 THEN base ELSE base || ' ' || array_to_string(more, ' ') END AS text FROM qg WHERE base <> '')"""


def _retrieve_sql(k: int, asked: str) -> str:
    over = triple.over_fetch(k)
    return f"""{_CHUNKS_SQL}, {asked}, {_EXPANDED_SQL}, {_embedding_sql("eq", "q", "query_id")}, {_embedding_sql("ec", "ch", "chunk_id")},
    s0 AS (SELECT query_id, chunk_id, round(sum(eq.weight * ec.weight), 10) AS score FROM eq JOIN ec USING (bucket) GROUP BY ALL),
    s1 AS (SELECT query_id, chunk_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM s0) WHERE place <= {3 * over}),
    s2 AS (SELECT s1.*, list_distinct(regexp_extract_all(lower(q.text), '[\\p{{L}}\\p{{N}}_]+')) AS qw, list_distinct(regexp_extract_all(lower(ch.text), '[\\p{{L}}\\p{{N}}_]+')) AS cw FROM s1 JOIN q USING (query_id) JOIN ch USING (chunk_id)),
    s3 AS (SELECT query_id, chunk_id, place, round(0.8 * score + 0.2 * CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_intersect(qw, cw)) / len(qw) END, 10) AS mixed FROM s2),
    de AS (SELECT query_id, chunk_id, mixed AS dense, r AS dr FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mixed DESC, place) AS r FROM s3) WHERE r <= {over}),
    bq AS (SELECT query_id, unnest(list_distinct({_TOK})) AS term FROM q), bd AS (SELECT chunk_id, {_TOK} AS ts FROM ch), bn AS (SELECT count(*) AS docs, avg(len(ts)) AS mean_len FROM bd),
    bp AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS len, unnest(ts) AS term FROM bd) WHERE term IN (SELECT term FROM bq) GROUP BY ALL), bf AS (SELECT term, count(*) AS df FROM bp GROUP BY term),
    b1 AS (SELECT query_id, chunk_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean_len)) + 1)), 10) AS score FROM bq JOIN bp USING (term) JOIN bf USING (term), bn GROUP BY query_id, chunk_id),
    bm AS (SELECT query_id, chunk_id, round(score, 6) AS bm, r AS br FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM b1 WHERE score > 0) WHERE r <= {over}),
    ex AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS er FROM q JOIN ch ON trim(q.rid) <> '' AND (upper(trim(q.rid)) = u OR contains(lower(ch.text), lower(trim(q.rid))))),
    al AS (SELECT query_id, chunk_id, dense, dr, bm, br, er FROM de FULL JOIN bm USING (query_id, chunk_id) FULL JOIN ex USING (query_id, chunk_id)),
    j0 AS (SELECT al.*, q.rid AS qid, q.title AS qtitle, u, nullif(trim(ch.rid), '') AS requirement_id, CASE WHEN length(ch.text) > 420 THEN regexp_replace(substr(ch.text, 1, 417), '\\s+$', '') || '...' ELSE ch.text END AS text,
        list_distinct({_title_sql("coalesce(ttitle, '')")}) AS dt, list_distinct({_title_sql("q.text")}) AS dq, {_title_sql("q.title")} AS tt,
        round(coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + br), 0) + coalesce(1.0::DOUBLE / (60 + er), 0), 12) AS fused,
        concat_ws('+', CASE WHEN dr IS NOT NULL THEN 'dense' END, CASE WHEN br IS NOT NULL THEN 'bm25' END, CASE WHEN er IS NOT NULL THEN 'exact_id' END) AS sources,
        CAST(dr IS NOT NULL AS INTEGER) + CAST(br IS NOT NULL AS INTEGER) + CAST(er IS NOT NULL AS INTEGER) AS paths, round(coalesce(dense, 1 / (1 + exp(-bm / 5)), 0.5), 4) AS base
        FROM al JOIN q USING (query_id) JOIN ch USING (chunk_id) LEFT JOIN ti USING (u)),
    j1 AS (SELECT *, len(list_intersect(dt, dq)) AS n, len([t FOR t IN tt IF contains(lower(text), t)]) AS m, len([z FOR z IN [concat(tt[i], ' ', tt[i + 1]) FOR i IN range(1, len(tt))] IF contains(lower(text), z)]) AS bg FROM j0),
    j2 AS (SELECT *, CASE WHEN n > 0 THEN least(0.99::DOUBLE, round(base + 0.15::DOUBLE * n / len(dt) + 0.05::DOUBLE * n / len(dq), 4)) ELSE base END AS covered,
        CAST(CASE WHEN trim(qid) <> '' AND u = upper(trim(qid)) THEN 0.30 WHEN trim(qid) <> '' AND contains(lower(text), lower(trim(qid))) THEN 0.15 ELSE 0 END AS DOUBLE) + CASE WHEN len(tt) > 0 THEN least(4, m) * 0.04::DOUBLE + 0.08::DOUBLE * m / len(tt) ELSE 0 END
            + least(3, bg) * 0.06::DOUBLE + CAST(CASE WHEN paths >= 3 THEN 0.05 WHEN paths = 2 THEN 0.02 ELSE 0 END AS DOUBLE) AS boost FROM j1),
    j3 AS (SELECT *, CASE WHEN boost = 0 OR (trim(qid) = '' AND qtitle = '') THEN covered ELSE least(0.99::DOUBLE, round(covered + boost, 4)) END AS score,
        CASE WHEN dr IS NOT NULL THEN 0 WHEN br IS NOT NULL THEN 1 ELSE 2 END AS p, coalesce(dr, br, er) AS pr FROM j2),
    j4 AS (SELECT *, row_number() OVER (PARTITION BY query_id, u, CASE WHEN u = '' THEN chunk_id END ORDER BY score DESC, covered DESC, fused DESC, p, pr) AS one FROM j3),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, u = '', covered DESC, fused DESC, p, pr) AS rank FROM j4 WHERE one = 1) WHERE rank <= {k})"""


@query(f"WITH {_retrieve_sql(triple.TOP, _ASKED_SQL)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, requirement_id, score, round(fused, 6) AS fused, sources, CAST(paths AS INTEGER) AS paths, md5(text) AS text_md5 FROM hits")
def triple_path_retrieve(spark, sf):
    hits = triple.retrieve(_asked(spark, sf), chunks(spark, sf))
    return hits.withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


_REQUIRED_SQL = _ASKED_SQL.replace("qr AS", "q0 AS") + """, qr AS (SELECT query_id, concat_ws(' ', nullif(trim(rid), ''), nullif(trim(title), ''), 'verification test evidence pass fail result') AS text, trim(rid) AS rid, trim(title) AS title FROM q0)"""


@query(f"""WITH {_retrieve_sql(triple.CLASSIFY_TOP, _REQUIRED_SQL)},
    w AS (SELECT *, strpos(lower(text), lower(qid)) AS pos, greatest(1, strpos(lower(text), lower(qid)) - 320) AS low FROM hits),
    v AS (SELECT *, CASE WHEN qid <> '' AND pos > 0 THEN substr(text, low, pos + length(qid) + 320 - low) END AS win FROM w),
    p AS (SELECT query_id, arg_min(CASE WHEN contains(lower(win), 'the the') THEN 'FAIL' ELSE 'PASS' END, rank) FILTER (contains(lower(win), 'the the') OR contains(lower(win), 'with')) AS close,
        CASE WHEN bool_or(contains(lower(text), 'the the')) THEN 'FAIL' WHEN bool_or(contains(lower(text), 'with')) THEN 'PASS' ELSE 'UNKNOWN' END AS whole, count(*) AS n, max(score) AS top,
        bool_or((qid <> '' AND (u = upper(qid) OR contains(lower(text), lower(qid)))) OR len([t FOR t IN tt IF contains(lower(text), t)]) > 0) AS relevant, arg_min(text, rank) AS best, arg_min(paths, rank) AS paths FROM v GROUP BY query_id)
    SELECT qr.query_id, CASE WHEN relevant THEN coalesce(close, whole) ELSE 'NOT_FOUND' END AS verdict, CASE WHEN relevant THEN substr(best, 1, 300) END AS snippet, CASE WHEN relevant THEN 'passed' WHEN n > 0 THEN 'failed' END AS relevance_gate,
        CASE WHEN relevant THEN CASE WHEN close IS NULL THEN 'full_text' ELSE 'proximity' END END AS verdict_method, CASE coalesce(paths, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'single' WHEN 2 THEN 'partial' ELSE 'full' END AS agreement,
        round(top, 4) AS top_score, CAST(coalesce(n, 0) AS INTEGER) AS hits FROM qr LEFT JOIN p USING (query_id)""")
def classify_requirements(spark, sf):
    return triple.classify(_asked(spark, sf).drop("text"), chunks(spark, sf), fail="(?i)the the", good="(?i)with")


def _index(spark, chunks, block=256, vectors=True):
    return TextIndex.open(chunks, f"{shared_folder(spark)}/proofloom-indexes", block, vectors)


@query(f"WITH {_BM25_SQL} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm")
def bm25_indexed_topk(spark, sf):
    docs = _documents(spark, sf).withColumnRenamed("doc_id", "chunk_id")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _index(spark, docs, vectors=False).bm25(asked, 20, doc="doc_id")


@query(f"WITH {_retrieve_sql(triple.TOP, _ASKED_SQL)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM hits")
def indexed_retrieve(spark, sf):
    return triple.retrieve(_asked(spark, sf), None, index=_index(spark, chunks(spark, sf), 512)).select("query_id", "rank", "chunk_id", "score")


# --- clauses of regulations
def _regulation_pages(spark, sf):
    """Documents as regulations: their words in lines of eight, some of them with numbers and headings before, ten lines a page."""
    docs = table(spark, sf, "documents").filter(F.length("text") > 0)
    eight = F.regexp_extract_all("text", F.lit(r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){0,7}[^\x20\x09-\x0D]+"), F.lit(0))
    lines = docs.select("doc_id", F.posexplode(eight).alias("j", "part"))  # no row carries more of its text than its own words
    lines = lines.select(
        F.col("doc_id").cast("string").alias("doc"), "j", F.regexp_replace("part", r"[\x20\x09-\x0D]+", " ").alias("part"), (F.col("j") % 9 + 1).cast("string").alias("number"),
        (F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("j").cast("string")).cast("binary")) % 40).cast("int").alias("h"),
    )
    part, number, h = F.col("part"), F.col("number"), F.col("h")
    line = (
        F.when(h == 0, F.concat(number, F.lit(" SECTION OF ALL "), F.translate(number, "123456789", "ABCDEFGHI")))
        .when(h.isin(1, 2, 3), F.concat(number, F.lit("."), (F.col("j") % 4).cast("string"), F.lit(" "), part))
        .when(h.isin(4, 5), F.concat(number, F.lit("."), (F.col("j") % 4).cast("string")))
        .when(h == 6, number)
        .when(h == 7, F.concat(F.lit("PART "), F.translate(number, "123456789", "ABCDEFGHI")))
        .when(h == 8, F.concat(number, F.lit(".1 contents ........ 7")))
        .when(h == 9, F.concat(F.lit("Pagina "), number, F.lit(" di 9")))
        .when(h == 10, F.lit("INTRODUCTION"))
        .when(h == 11, F.concat(F.lit("Publication "), number))
        .when(h == 12, F.lit("RIFERIMENTI NORMATIVI"))
        .when(h == 13, F.lit("3.1 Assessment of parts"))
        .when(h == 14, F.lit(" ♦ "))
        .when(h == 15, F.concat(F.lit("deve della "), part))
        .when((h == 16) & (F.col("j") > 60), F.lit("ANNEX A"))
        .when((h == 17) & (F.col("j") % 2 == 0), F.concat(F.lit("-- "), (F.col("j") + 100).cast("string"), F.lit(" of 999 --")))
        .otherwise(part)
    )
    rows = lines.select("doc", F.floor(F.col("j") / 10).cast("int").alias("page_index"), "j", line.alias("line"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("j", "line"))), lambda x: x["line"])
    return rows.groupBy("doc", "page_index").agg(F.array_join(parts, "\n").alias("text"))


_CRC_SQL = "xor(list_reduce(list_prepend(4294967295::UBIGINT, [CAST(ord(x) AS UBIGINT) FOR x IN string_split(k, '')]), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)), 4294967295::UBIGINT)"


def _any(column, values):
    return "(" + " OR ".join(f"contains({column}, '{v}')" for v in values) + ")"


_CLAUSES_SQL = rf"""
    w0 AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE length(text) > 0),
    w1 AS (SELECT doc_id, w, CAST(unnest(range(0, (len(w) - 1) // 8 + 1)) AS INTEGER) AS j FROM w0 WHERE len(w) > 0),
    w2 AS (SELECT doc_id, j, array_to_string(w[j * 8 + 1:j * 8 + 8], ' ') AS part, CAST(j % 9 + 1 AS VARCHAR) AS nr, concat(doc_id, ':', j) AS k FROM w1),
    w3 AS (SELECT *, CAST({_CRC_SQL} % 40 AS INTEGER) AS h FROM w2),
    w4 AS (SELECT CAST(doc_id AS VARCHAR) AS doc, j // 10 AS pi, j, CASE WHEN h = 0 THEN concat(nr, ' SECTION OF ALL ', translate(nr, '123456789', 'ABCDEFGHI')) WHEN h IN (1, 2, 3) THEN concat(nr, '.', j % 4, ' ', part) WHEN h IN (4, 5) THEN concat(nr, '.', j % 4)
        WHEN h = 6 THEN nr WHEN h = 7 THEN concat('PART ', translate(nr, '123456789', 'ABCDEFGHI')) WHEN h = 8 THEN concat(nr, '.1 contents ........ 7') WHEN h = 9 THEN concat('Pagina ', nr, ' di 9') WHEN h = 10 THEN 'INTRODUCTION' WHEN h = 11 THEN concat('Publication ', nr)
        WHEN h = 12 THEN 'RIFERIMENTI NORMATIVI' WHEN h = 13 THEN '3.1 Assessment of parts' WHEN h = 14 THEN ' ♦ ' WHEN h = 15 THEN concat('deve della ', part) WHEN h = 16 AND j > 60 THEN 'ANNEX A' WHEN h = 17 AND j % 2 = 0 THEN concat('-- ', j + 100, ' of 999 --') ELSE part END AS line FROM w3),
    pg AS (SELECT doc, pi, coalesce(CAST(nullif(regexp_extract(string_agg(line, chr(10) ORDER BY j), '--\s+(\d+)\s+of\s+\d+\s+--', 1), '') AS INTEGER), pi + 1) AS page FROM w4 GROUP BY doc, pi),
    l0 AS (SELECT doc, pi, j, page, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM w4 JOIN pg USING (doc, pi)),
    l1 AS (SELECT * FROM l0 WHERE NOT regexp_matches(line, '^Pagina [ivx\d ]+(di \d+)?$|^-- \d+ of \d+ --$')),
    st AS (SELECT doc, min(j) AS a FROM l1 WHERE regexp_matches(line, '3\.1\s+Assessment') GROUP BY doc),
    l2 AS (SELECT l1.doc, pi, j, page, CASE WHEN j = a THEN substr(line, strpos(line, '3.1 Assessment')) ELSE line END AS line FROM l1 JOIN st USING (doc) WHERE j >= a),
    en AS (SELECT doc, min(j) AS z FROM l2 WHERE contains(line, 'ANNEX A') GROUP BY doc),
    l3 AS (SELECT l2.* FROM l2 LEFT JOIN en USING (doc) WHERE z IS NULL OR j < z),
    l4 AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY j) AS i FROM l3 WHERE line NOT IN ('', 'RIFERIMENTI NORMATIVI')),
    l5 AS (SELECT *, lead(line) OVER o AS nl, lead(page) OVER o AS np FROM l4 WINDOW o AS (PARTITION BY doc ORDER BY i)),
    l6 AS (SELECT *, coalesce(np = page AND CASE WHEN regexp_full_match(line, '\d+(\.\d+)+') THEN NOT regexp_full_match(nl, '\d+(\.\d+)+') WHEN regexp_full_match(line, '\d+') THEN regexp_full_match(nl, '[A-Z][A-Z0-9 /\-(),]+') ELSE FALSE END, FALSE) AS can FROM l5),
    l7 AS (SELECT *, coalesce(max(CASE WHEN NOT can THEN i END) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM l6),
    l8 AS (SELECT *, (i - since - 1) % 2 = 1 AS taken FROM l7),
    l9 AS (SELECT *, can AND NOT taken AS alone, NOT taken AND NOT can AND regexp_full_match(line, '\d+\s+[A-Z][A-Z0-9 /\-(),]+') AS main, NOT taken AND NOT can AND regexp_full_match(line, '\d+(\.\d+)+\s+.+') AS sub FROM l8),
    m0 AS (SELECT *, alone OR main OR (sub AND NOT contains(line, '....')) AS opens, CASE WHEN alone THEN line ELSE regexp_extract(line, '^[\d.]+', 0) END AS hid, CASE WHEN alone THEN nl ELSE trim(regexp_replace(line, '^[\d.]+\s+', '')) END AS ht,
        main OR (alone AND NOT contains(line, '.')) AS sec FROM l9),
    m1 AS (SELECT *, count(*) FILTER (opens) OVER o AS no, last_value(CASE WHEN opens THEN hid END IGNORE NULLS) OVER o AS cid, last_value(CASE WHEN opens THEN ht END IGNORE NULLS) OVER o AS ctitle, last_value(CASE WHEN opens AND sec THEN ht END IGNORE NULLS) OVER o AS csec,
        last_value(CASE WHEN opens THEN page END IGNORE NULLS) OVER o AS cpage FROM m0 WINDOW o AS (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING)),
    cl AS (SELECT doc, no, any_value(cid) AS clause_id, any_value(ctitle) AS title, coalesce(any_value(csec), any_value(ctitle)) AS section, any_value(cpage) AS page_start, string_agg(line, ' ' ORDER BY i) AS text FROM m1
        WHERE no > 0 AND NOT opens AND NOT taken AND NOT sub AND NOT main AND line NOT IN ('CONTENTS', 'INDICE', 'INTRODUCTION') AND NOT starts_with(line, 'Publication') AND NOT starts_with(line, 'Titolo') GROUP BY doc, no),
    g0 AS (SELECT *, title <> '' AND NOT regexp_full_match(title, '[^\p{{L}}]+') AND NOT regexp_matches(title, '\.{{5,}}') AND length(regexp_replace(title, '[^A-Za-z]', '', 'g')) >= 2 AS good,
        trim(regexp_replace(regexp_replace(text, '\.{{5,}}', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM cl),
    g1 AS (SELECT *, CASE WHEN regexp_full_match(cleaned, '[^\p{{L}}\p{{N}}_]{{1,6}}') THEN '' ELSE cleaned END AS c2 FROM g0),
    g2 AS (SELECT *, CASE WHEN length(regexp_replace(c2, '[^A-Za-z]', '', 'g')) >= 8 AND ({_any("concat(' ', lower(c2), ' ')", regulation.ENGLISH)} OR NOT {_any("concat(' ', lower(c2), ' ')", regulation.ITALIAN)}) THEN c2 ELSE '' END AS t,
        first_value(title) OVER (PARTITION BY doc, clause_id ORDER BY good DESC, length(title) DESC, no) AS best FROM g1),
    g3 AS (SELECT doc, clause_id, t, min(struct_pack(n := -length(text), at := no)) AS o FROM g2 WHERE t <> '' GROUP BY doc, clause_id, t),
    g4 AS (SELECT doc, clause_id, string_agg(t, ' ' ORDER BY o) AS text FROM g3 GROUP BY doc, clause_id),
    gr AS (SELECT doc, clause_id, any_value(best) AS title, arg_min(section, no) FILTER (title = best AND section <> '') AS section, min(page_start) AS page_start, count(*) AS n, arg_max(good, struct_pack(a := good, b := length(title), c := -no)) AS good FROM g2 GROUP BY doc, clause_id),
    ga AS (SELECT gr.*, coalesce(text, '') AS text FROM gr LEFT JOIN g4 USING (doc, clause_id))"""


@query(f"""WITH {_CLAUSES_SQL} SELECT doc, clause_id, title, section, page_start, md5(text) AS text_md5, CAST(row_number() OVER (PARTITION BY doc ORDER BY [CAST(x AS BIGINT) FOR x IN string_split(clause_id, '.')]) AS INTEGER) AS place
    FROM ga WHERE good AND text <> ''""")
def clause_normalisation(spark, sf):
    found, _ = regulation.normalised(_regulation_pages(spark, sf))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(regulation.id_order(), "clause_id"))
    return found.select("doc", "clause_id", "title", "section", "page_start", F.md5(F.col("text").cast("binary")).alias("text_md5"), place.alias("place"))


@query(f"""WITH {_CLAUSES_SQL}, b AS (SELECT doc, count(*) AS before_total FROM cl GROUP BY doc)
    SELECT doc, any_value(before_total) AS before_total, count(*) FILTER (good AND text <> '') AS after_total, count(*) FILTER (n > 1) AS duplicate_ids_before, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS duplicate_extra_rows_before,
        count(*) FILTER (n > 1) AS duplicates_resolved, count(*) FILTER (NOT good) AS removed_invalid_titles, count(*) FILTER (good AND text = '') AS removed_empty_text FROM ga JOIN b USING (doc) GROUP BY doc""")
def clause_cleanup_report(spark, sf):
    return regulation.normalised(_regulation_pages(spark, sf))[1]


# --- clause index
def _clauses(spark, sf):
    d = table(spark, sf, "documents")
    return clause_index.clause_texts(d.select(F.col("doc_id").cast("string").alias("clause_id"), F.substring("text", 1, 40).alias("title"), "text", F.col("n_chars").alias("page_start")))


def _vector_index(spark, clauses):
    return clause_index.VectorIndex.open(clauses.select("id", F.col("body").alias("text")), f"{shared_folder(spark)}/proofloom-indexes", 32)


@query(f"""WITH c AS (SELECT doc_id, trim(substr(text, 1, 40)) AS title, n_chars AS page_start, trim(concat(doc_id, ' ', trim(substr(text, 1, 40)), chr(10), trim(text))) AS text FROM documents WHERE trim(coalesce(text, '')) <> ''),
    {_embedding_sql("eq", "benchmark", "item_id")}, {_embedding_sql("ec", "c", "doc_id")},
    s AS (SELECT item_id AS query_id, doc_id, round(sum(eq.weight * ec.weight), 10) AS score FROM eq JOIN ec USING (bucket) GROUP BY ALL),
    t AS (SELECT query_id, doc_id, round(score, 6) AS score, p FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS p FROM s) WHERE p <= 15),
    w AS (SELECT t.*, title, page_start, c.text, list_distinct(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}_]+')) AS qw, list_distinct(regexp_extract_all(lower(c.text), '[\\p{{L}}\\p{{N}}_]+')) AS cw FROM t JOIN c USING (doc_id) JOIN benchmark AS b ON item_id = query_id),
    h AS (SELECT *, round(0.8 * score + 0.2 * len(list_intersect(qw, cw)) / len(qw), 10) AS m FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, p) AS rank FROM h)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, page_start, round(m, 4) AS score, md5(CASE WHEN length(text) > 1200 THEN regexp_replace(substr(text, 1, 1197), '\\s+$', '') || '...' ELSE text END) AS text_md5 FROM r WHERE rank <= 5""")
def clause_index_query(spark, sf):
    """Exact: all lists are read. Equal scores are told apart by clause id, as numbers."""
    clauses = _clauses(spark, sf).withColumn("id", F.col("clause_id").cast("long"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = clause_index.retrieve_clauses(asked, clauses, _vector_index(spark, clauses), probes=None)
    return hits.select("query_id", "rank", "page_start", "score", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def clause_index_recall(spark, sf):
    """Share of the ten best clauses that eight of 32 lists give, by query."""
    clauses = _clauses(spark, sf)
    index = _vector_index(spark, clauses)
    asked = retrieval.embedded(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id")
    exact = index.search(asked, 10, None).select("query_id", "id")
    some = index.search(asked, 10).select("query_id", "id", F.lit(1).alias("f"))
    return exact.join(some, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("exact"), F.count("f").alias("found"))
