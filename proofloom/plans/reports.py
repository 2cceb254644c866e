"""Queries of reports: envelope queries, head windows, golden scenarios, compaction by profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compaction, evaluation, governance, matching, report
from .assessment import _ANOMALIES_SQL, _anomalies
from .nested import _nested
from .registry import query, table

_HEAD = "['" + "', '".join(matching.QUERY_HEAD) + "']"


@query(f"""WITH {_ANOMALIES_SQL},
    w AS (SELECT module, 0 AS a, requirement_id AS o, slot AS s, 0 AS p, CAST(requirement_id AS VARCHAR) AS w FROM n WHERE severity = 'HIGH'
        UNION ALL SELECT module, 1, requirement_id, slot, 0, replace(type, '_', ' ') FROM n
        UNION ALL SELECT module, 1, requirement_id, slot, unnest(range(1, len(l) + 1)), unnest(l) FROM (SELECT *, regexp_extract_all(detail, '[A-Za-z][A-Za-z0-9_-]{{2,}}')[1:8] AS l FROM n)),
    k AS (SELECT module, lower(w) AS k, min(struct_pack(a := a, o := o, s := s, p := p, w := w)) AS f FROM w GROUP BY ALL),
    z AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY f) AS r FROM k WHERE NOT list_contains([lower(x) FOR x IN {_HEAD}], k))
    SELECT module, trim(substr(concat_ws(' ', array_to_string({_HEAD}, ' '), string_agg(f.w, ' ' ORDER BY f), 'failed_tests_3'), 1, 480)) AS retrieval_query FROM z WHERE r <= 480 GROUP BY module""")
def envelope_query(spark, sf):
    return matching.retrieval_query(_anomalies(spark, sf), ["module"], 3)


@query("""WITH d AS (SELECT doc_id, text, lower(text) AS low, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'that' ELSE ' ' END AS needle FROM documents),
    p AS (SELECT doc_id, text, unnest(list_transform(range(1, len(string_split(low, 'that'))), lambda k: length(array_to_string(string_split(low, 'that')[1:k], 'that')) + 1)) AS at FROM d WHERE needle = 'that' AND contains(low, 'that'))
    SELECT doc_id, CAST(at AS INTEGER) AS at_, md5(trim(replace(substr(text, greatest(1, at - 280), at + 280 - greatest(1, at - 280)), chr(10), ' '))) AS window_md5 FROM p
    UNION ALL SELECT doc_id, NULL, md5(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 3500)) FROM d WHERE coalesce(trim(needle), '') = '' AND regexp_matches(text, '\\S')""".replace(" AS at FROM", " AS pos FROM").replace("CAST(at AS", "CAST(pos AS").replace("(1, at - 280)", "(1, pos - 280)").replace(", at + 280", ", pos + 280"))
def derogation_windows(spark, sf):
    k = F.col("doc_id") % 3
    docs = table(spark, sf, "documents").select("doc_id", "text", F.when(k == 1, "that").when(k == 2, " ").alias("needle"))
    found = governance.occurrences(docs, F.col("needle"), head=governance.HEAD)
    return found.select("doc_id", F.col("at").alias("at_"), F.md5(F.col("window").cast("binary")).alias("window_md5"))


_GOLDEN_SQL = """WITH c AS (
    SELECT doc_id AS key, 'deterministic' AS kind, 'meta.note' AS name, upper(concat('SRC', doc_id % 20)) AS expected, upper(source) AS actual FROM documents
    UNION ALL SELECT doc_id, 'deterministic', 'meta.none.x', '', '' FROM documents
    UNION ALL SELECT doc_id, 'soft', 'meta.lang', 'EN', upper(lang) FROM documents
    UNION ALL SELECT doc_id, 'id', 'SRC3', 'present', CASE WHEN upper(source) = 'SRC3' THEN 'present' ELSE 'absent' END FROM documents WHERE doc_id % 20 = 3
    UNION ALL SELECT doc_id, 'id', 'EN', 'absent', CASE WHEN lang = 'en' THEN 'present' ELSE 'absent' END FROM documents WHERE doc_id % 2 = 0)"""


def _golden(spark, sf):
    d = table(spark, sf, "documents")
    one = lambda path, value, soft: d.select(F.col("doc_id").alias("key"), F.lit(path).alias("path"), value.alias("expected"), F.lit(soft).alias("soft"))
    expected = one("meta.note", F.concat(F.lit(" src"), (F.col("doc_id") % 20).cast("string")), False).unionByName(one("meta.none.x", F.lit(None).cast("string"), False)).unionByName(one("meta.lang", F.lit("en"), True))
    ids = d.filter("doc_id % 20 = 3").select(F.col("doc_id").alias("key"), F.lit("src3 ").alias("id"), F.lit(True).alias("wanted")).unionByName(d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), F.lit("en").alias("id"), F.lit(False).alias("wanted")))
    there = d.select(F.col("doc_id").alias("key"), F.explode(F.array("source", "lang")).alias("requirement_id"))
    return evaluation.golden_checks(_nested(spark, sf).withColumnsRenamed({"doc_id": "key", "json": "audit"}), expected, ids, there)


@query(f"{_GOLDEN_SQL} SELECT *, expected = actual AS ok FROM c")
def golden_checks(spark, sf):
    return _golden(spark, sf)


@query(f"""{_GOLDEN_SQL} SELECT key, count(*) FILTER (kind <> 'soft') AS checks, round(count(*) FILTER (kind <> 'soft' AND expected = actual) / count(*) FILTER (kind <> 'soft'), 6) AS accuracy,
    round(count(*) FILTER (kind = 'soft' AND expected = actual) / count(*) FILTER (kind = 'soft'), 6) AS soft_accuracy, max(CAST(kind <> 'soft' AND expected <> actual AS INTEGER)) AS exit_status FROM c GROUP BY key""")
def golden_summary(spark, sf):
    return evaluation.golden_summary(_golden(spark, sf))


_FOLD_SQL = """WITH o AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority, concat(o_custkey, chr(9), chr(34)) AS clerk, l_comment, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_returnflag, '"' ORDER BY l_linenumber, l_returnflag) AS l_comment FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
    f AS (SELECT o_orderkey, [struct_pack(n := 'extra', j := CAST(to_json(clerk) AS VARCHAR)), struct_pack(n := 'notes', j := CAST(to_json(l_comment) AS VARCHAR)), struct_pack(n := 'status', j := CAST(to_json(status) AS VARCHAR)),
        struct_pack(n := 'source_files', j := concat('["a", ', to_json(o_orderpriority), ']')), struct_pack(n := 'summary', j := concat('{"n": ', coalesce(n, 0), ', "k": ', to_json(o_orderpriority), '}'))] AS fs, concat('["', o_orderkey, ' | HIGH"]') AS digest FROM o),
    g AS (SELECT o_orderkey, list_filter(fs, lambda x: x.j IS NOT NULL) AS fs, digest FROM f),
    s AS (SELECT *, list_filter([2, 1], lambda i: TRUE) AS u, list_concat([x FOR x IN fs IF x.n = 'extra'], list_concat([x FOR x IN fs IF x.n = 'source_files'], [x FOR x IN fs IF x.n = 'notes'])) AS ord FROM g),
    t AS (SELECT *, [concat('{', array_to_string(list_concat(list_concat(list_concat([concat('"', x.n, '": ', x.j) FOR x IN fs IF x.n = 'status'], [concat('"', x.n, '": ', x.j) FOR x IN fs IF x.n = 'summary']), [concat('"', x.n, '": ', x.j) FOR x IN fs IF x.n NOT IN ('status', 'summary') AND NOT list_contains([y.n FOR y IN ord[1:d]], x.n)]), [concat('"anomaly_digests": ', digest)]), ', '), '}') FOR d IN range(0, len(ord) + 1)] AS texts FROM s),
    p AS (SELECT *, coalesce(list_position([length(x) <= 150 FOR x IN texts], TRUE), len(texts)) - 1 AS d FROM t),
    q AS (SELECT *, texts[d + 1] AS plain, concat('{', array_to_string([concat('"', x.n, '": ', x.j) FOR x IN fs IF NOT list_contains([y.n FOR y IN ord[1:d]], x.n)], ', '), ', "_compaction": {"dropped_fields": [', array_to_string([concat('"', y.n, '"') FOR y IN ord[1:d]], ', '), '], "marker": "[truncated]"}, "anomaly_digests": ', digest, '}') AS told FROM p),
    b AS (SELECT o_orderkey, d, CASE WHEN d > 0 AND length(told) <= 150 THEN told ELSE plain END AS best FROM q)"""


@query(f"{_FOLD_SQL} SELECT o_orderkey, CASE WHEN length(best) > 150 THEN concat(best, chr(10), '[truncated]') ELSE best END AS compact FROM b")
def compaction_profiles(spark, sf):
    """Orders as reports of the matcher, for its reader with a budget that most do not meet whole."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]), '"').alias("notes"))
    o = table(spark, sf, "orders").join(lines, "o_orderkey", "left")
    rows = o.select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit("\t\"")).alias("extra"), "notes", F.col("o_orderstatus").alias("status"), F.array(F.lit("a"), "o_orderpriority").alias("source_files"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("o_orderpriority").alias("k")).alias("summary"), F.array(F.concat(F.col("o_orderkey").cast("string"), F.lit(" | HIGH"))).alias("anomaly_digests"))
    return compaction.by_profile(rows, "lead", "matcher", 150, ["extra", "notes", "status", "source_files", "summary"], ("anomaly_digests",)).select("o_orderkey", "compact")
