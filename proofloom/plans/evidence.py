"""Queries of requirement entries, document lines and windows of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, requirements
from ..sources import files, sinks
from ..streaming import ingest
from .registry import query, table

_RAW_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


def _raw(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(f"""WITH {_RAW_SQL}, h AS (SELECT *, max(CASE WHEN contains(lower(line), 'with the') THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS hit_line FROM l)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(hit_line AS INTEGER) AS hit_line FROM h WHERE hit_line IS NOT NULL AND trim(line) <> ''""")
def context_frames(spark, sf):
    return requirements.frames(_raw(spark, sf), F.lower("line").contains("with the")).select("doc_id", "line_no", "hit_line")


@query(f"""WITH {_RAW_SQL}, h AS (SELECT doc_id, line_no, trim(line) AS line, coalesce(max(CAST(contains(lower(line), 'with the') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING), 0) = 1 AS near FROM l),
    o AS (SELECT doc_id, line, min(line_no) AS line_no FROM h WHERE near AND line <> '' GROUP BY doc_id, line), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM o)
    SELECT doc_id, CAST(count(*) AS INTEGER) AS excerpts, md5(string_agg(substr(line, 1, 280), chr(10) ORDER BY line_no)) AS excerpts_md5 FROM r WHERE k <= 10 GROUP BY doc_id""")
def requirement_excerpts(spark, sf):
    out = requirements.excerpts(_raw(spark, sf), F.lower("line").contains("with the"))
    return out.select("doc_id", F.size("excerpts").alias("excerpts"), F.md5(F.array_join("excerpts", "\n").cast("binary")).alias("excerpts_md5"))


@query(f"""WITH {_RAW_SQL}, g AS (SELECT doc_id, line, [upper(x) FOR x IN regexp_extract_all(line, '[A-Z]{{3,}}')] AS ids FROM l)
    SELECT doc_id, count(*) AS lines, count(*) FILTER (len(ids) = 0 OR list_contains(ids, 'THE')) AS own FROM g GROUP BY doc_id""")
def own_excerpts(spark, sf):
    kept = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    return kept.select("doc_id", F.size("ls").cast("long").alias("lines"), F.size(requirements.own(F.col("ls"), F.lit("the"), "[A-Z]{3,}")).cast("long").alias("own"))


@query(r"""WITH e AS (SELECT user_id, list_distinct(list(event_type)) AS kinds, min(event_id) AS first FROM events GROUP BY user_id)
    SELECT user_id, concat_ws(' ', 'CEI EN 50128 railway software safety compliance',
        CASE WHEN list_contains(kinds, 'error') THEN 'software requirements specification test specification documentation evidence clause 8 10 12' END,
        CASE WHEN list_contains(kinds, 'view') OR list_contains(kinds, 'click') THEN 'test report validation verification failure result record clause 11 13' END,
        CASE WHEN list_contains(kinds, 'signup') THEN 'verification evidence incomplete traceability clause 6 8' END,
        CASE WHEN list_contains(kinds, 'purchase') THEN 'discrepancy test log verification report clause 11 12 13' END, concat('requirements: ', first), 'anomaly text') AS clause_query FROM e""")
def clause_query(spark, sf):
    names = {"error": "MISSING_TEST_DESIGN_EVIDENCE", "view": "DOC_EVIDENCE_FAIL", "click": "LOG_FAIL_VS_VERIFIED_REQUIREMENT", "signup": "WEAK_VERIFICATION_SIGNAL", "purchase": "LOG_FAIL_VS_DOC_PASS"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in names.items()])
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(kind).alias("kinds"), F.min("event_id").cast("string").alias("first"))
    return rows.select("user_id", requirements.clause_query(F.col("kinds"), F.array("first"), F.lit("anomaly text")).alias("clause_query"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
    SELECT conv_id, CASE role WHEN 'user' THEN 'retrieval' WHEN 'assistant' THEN 'regulatory_clause' ELSE 'derogation_language' END AS kind, CAST(turn AS BIGINT) AS ord,
        md5(CASE role WHEN 'user' THEN substr(text, 1, 220) WHEN 'assistant' THEN text ELSE substr(text, 1, 240) END) AS text_md5 FROM t WHERE (role <> 'system' AND k <= 2) OR (role = 'system' AND k <= 6 AND length(text) % 3 > 0)""")
def citations(spark, sf):
    t = table(spark, sf, "conversations").withColumn("ord", F.col("turn").cast("long"))
    strength = F.when(F.length("text") % 3 == 1, "strong").when(F.length("text") % 3 == 2, "medium").otherwise("risk")
    out = requirements.citations(t.filter("role = 'user'"), t.filter("role = 'assistant'").withColumn("title", F.col("text")), t.filter("role = 'system'").withColumns({"strength": strength, "snippet": F.col("text")}), "conv_id", 2)
    return out.select("conv_id", "kind", "ord", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {_RAW_SQL} SELECT doc_id, count(*) AS lines FROM l WHERE length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 8 AND NOT (
        NOT (contains(' ' || lower(line) || ' ', ' the ') OR contains(' ' || lower(line) || ' ', ' of ')) AND (contains(' ' || lower(line) || ' ', ' la ') OR contains(' ' || lower(line) || ' ', ' die '))) GROUP BY doc_id""")
def english_lines(spark, sf):
    return requirements.language_lines(_raw(spark, sf), [" the ", " of "], [" la ", " die "]).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query(f"""WITH {_RAW_SQL}, b AS (SELECT *, coalesce(min(CASE WHEN contains(line, ' the ') THEN line_no END) OVER (PARTITION BY doc_id), 0) AS start FROM l),
    s AS (SELECT *, max(CAST(contains(line, ' was ') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS stopped FROM b WHERE line_no >= start)
    SELECT doc_id, count(*) AS lines, min(line_no)::INTEGER AS first_line FROM s WHERE stopped = 0 GROUP BY doc_id""")
def body_range(spark, sf):
    return requirements.body_range(_raw(spark, sf), "doc_id", " the ", " was ").groupBy("doc_id").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_counts(spark, sf):
    return ingest.windowed_counts(table(spark, sf, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM k GROUP BY user_id, s""")
def session_counts(spark, sf):
    return ingest.sessions(table(spark, sf, "events"))


@query("SELECT 'orders' AS part, count(*) AS rows FROM orders UNION ALL SELECT 'nation', count(*) FROM nation")
def audit_bundle(spark, sf):
    parts = {"orders": table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "nation": table(spark, sf, "nation")}
    one = sinks.audit_bundle(parts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.get_json_object("bundle", f"$.{p}_rows").cast("long").alias("rows")) for p in parts])).alias("p")).select("p.*")


@query("SELECT '{{n}}' AS placeholder, CAST(count(*) AS VARCHAR) AS value FROM nation UNION ALL SELECT '{{first}}', min(n_name) FROM nation")
def report_placeholders(spark, sf):
    return sinks.placeholders(table(spark, sf, "nation").agg(F.count("*").alias("n"), F.min("n_name").alias("first")))


@query()
def html_pieces(spark, sf):
    out = files.html_texts(table(spark, sf, "pages"), "page_id")
    return out.select("page_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH r AS (SELECT p_partkey, p_name, p_brand FROM part) SELECT p_brand AS requirement_id, string_agg(p_name, ' | ' ORDER BY k) AS title FROM (SELECT replace(upper(p_brand), '#', '-B-') AS p_brand, p_name, min(p_partkey) AS k FROM r GROUP BY ALL) GROUP BY p_brand""")
def verification_matrix(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.lit(1).alias("doc"), F.lit(1).alias("table_no"), F.col("p_partkey").alias("row_no"), F.array(F.lit("case"), F.col("p_name"), F.replace("p_brand", F.lit("#"), F.lit("_B_"))).alias("cells"))
    head = spark.createDataFrame([(1, 1, -1, ["Test case", "Title", "Requirements"])], "doc int, table_no int, row_no long, cells array<string>")
    return requirements.matrix(head.unionByName(rows), "doc", pattern=r"(?i)brand[-_]B[-_]\d+")


@query("""WITH p AS (SELECT p_partkey, replace(p_brand, '#', '-') AS b, p_size FROM part), i AS (SELECT DISTINCT b AS id FROM p UNION SELECT DISTINCT substr(b, 1, 7) FROM p UNION SELECT 'Brand-0'),
    l AS (SELECT p_partkey AS k, concat(upper(b), CASE WHEN p_size % 7 = 0 THEN ' failed' WHEN p_size % 2 = 0 THEN ' passed' ELSE ' is named' END) AS line FROM p WHERE p_partkey % 9 <> 0 AND (p_size % 7 <> 0 OR contains(b, '4'))),
    m AS (SELECT id, k, line FROM i JOIN l ON contains(lower(line), lower(id)))
    SELECT id AS requirement_id, CASE WHEN count(k) = 0 THEN 'NOT_FOUND' WHEN bool_or(contains(line, 'failed')) THEN 'FAIL' WHEN bool_or(contains(line, 'passed')) THEN 'PASS' ELSE 'UNKNOWN' END AS outcome, arg_min(line, k) AS snippet
    FROM i LEFT JOIN m USING (id) GROUP BY id""")
def substring_outcomes(spark, sf):
    """Substring ids hit longer ids too: Brand-1 is found in lines of Brand-11 to Brand-15."""
    p = table(spark, sf, "part").withColumn("b", F.replace("p_brand", F.lit("#"), F.lit("-")))
    ids = p.select(F.col("b").alias("requirement_id")).unionByName(p.select(F.substring("b", 1, 7).alias("requirement_id"))).unionByName(p.limit(1).select(F.lit("Brand-0").alias("requirement_id"))).distinct()
    said = F.when(F.col("p_size") % 7 == 0, " failed").when(F.col("p_size") % 2 == 0, " passed").otherwise(" is named")
    lines = p.filter((F.col("p_partkey") % 9 != 0) & ((F.col("p_size") % 7 != 0) | F.col("b").contains("4")))
    lines = lines.select(F.lit(0).alias("doc"), F.col("p_partkey").alias("line_no"), F.concat(F.upper("b"), said).alias("line"))
    return matching.substring_outcomes(ids, lines)
