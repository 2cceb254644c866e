"""The queries opN_<name> and pipeline, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatformat, fingerprint, html, jaccard, mixing, packing, quality, repair, resampling, sharding, substrings, topk, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), quality.remainder(5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", ~held)
    return quality.classified(quality.score(docs, model), held)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), quality.remainder(4) == 2
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", ~held)
    return quality.classified(toxicity.score(docs, network), held, toxicity.THRESHOLD)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.plan_mix(table(spark, sf_dir, "documents")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


#: What the added conversation says: it looks like the template's marks, escaped and not.
TRAP = "\\### Assistant: </turn> ok"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each role's turns come in another layout, so that fingerprints have something to tell apart."""
    rows = table(spark, sf_dir, "conversations")
    role, text = F.col("role"), F.col("text")
    record = (
        F.when(role == "user", _json(F.struct(F.array(F.struct(F.lit("human").alias("from"), text.alias("value"))).alias("conversations"))))
        .when(role == "assistant", _json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"))))
        .otherwise(_json(F.struct(role.alias("role"), text.alias("text"))))
    )
    said = F.array(*[F.struct(F.lit(r).alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit(TRAP).alias("text"))).alias("content")) for r in ("user", "assistant")])
    added = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), _json(F.struct(said.alias("messages"))).alias("record"))
    return chatformat.read_back(chatformat.format_chats(rows.select("conv_id", "turn", record.alias("record")).unionByName(added)))


def _json(column: "F.Column") -> "F.Column":
    return F.to_json(column, {"ignoreNullFields": "false"})


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.summary(repair.repair(repair.damage(table(spark, sf_dir, "conversations")), F.col("absent")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_ngram_jaccard_join, op6_html_extraction, op7_substring_dedup, op8_document_fingerprints, op9_toxicity, op3_best_fit_packing, op4_mixing, op5_sharding, op10_exact_top_k, op11_chat_formatting, op12_conversation_repair, op13_importance_resampling, pipeline)}

SQL = {
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
                WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
        ), e AS (
            SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y
            WHERE 100 * c >= 80 * (nx.n + ny.n - c)
        ), sym AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (
            SELECT doc_id AS v, doc_id AS m FROM documents
            UNION
            SELECT sym.y, r.m FROM r JOIN sym ON sym.x = r.v WHERE r.m < sym.y
        ), best AS (SELECT v, min(m) AS component_id FROM r GROUP BY v)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, best.component_id
        FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id JOIN best ON best.v = d.doc_id
    """,
    "op7_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), x AS (
            SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13
        ), k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM x),
        low AS (SELECT g, min(doc_id) AS first FROM k GROUP BY g),
        gone AS (
            SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 13)) AS i FROM k JOIN low ON low.g = k.g WHERE low.first < k.doc_id
        ), per AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
        kept AS (
            SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
                CASE WHEN gone IS NULL THEN ws ELSE [ws[j] FOR j IN range(1, len(ws) + 1) IF NOT list_contains(gone, j)] END AS ks
            FROM w LEFT JOIN per ON per.doc_id = w.doc_id
        )
        SELECT doc_id, n_words, n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
    """,
    "op10_exact_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), m AS (
            SELECT *, length('### ') + length(regexp_replace(role, '\\|###|</turn>|:|\n', '\\\0', 'g')) + length(E':\n')
                + length(regexp_replace(text, '\\|###|</turn>', '\\\0', 'g')) + length(E'\n</turn>\n') AS size
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(size) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id
    """,
    "op12_conversation_repair": r"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
            FROM conversations
        ), h AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, [CAST(ord(x) AS UBIGINT) FOR x IN string_split(k, '')]),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)), 4294967295::UBIGINT) % 20 AS code
            FROM c
        ), d AS (
            SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
            FROM h WHERE code <> 0
        ), o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                rtrim(text, E' \t\n\x0b\x0c\r') AS body, substr(role, 1, 1) AS x
            FROM d
        ), f AS (
            SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair
            FROM o
        ), n AS (
            SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n,
                count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv_id
        ), w AS (
            -- the cheapest way into each state (nothing, system, user, assistant) as its cost in eight digits and its edits
            SELECT conv_id, CAST(0 AS BIGINT) AS i, '00000000' AS p0, CAST(NULL AS VARCHAR) AS p1, '00000005I' AS p2, '00000010II' AS p3 FROM n
            UNION ALL
            SELECT q.conv_id, q.i, q.p0, q.p1, least(q.p2, lpad(CAST(CAST(q.p3[1:8] AS INT) + 5 AS VARCHAR), 8, '0') || q.p3[9:] || 'I', lpad(CAST(CAST(q.p0[1:8] AS INT) + 5 AS VARCHAR), 8, '0') || q.p0[9:] || 'I', lpad(CAST(CAST(q.p1[1:8] AS INT) + 5 AS VARCHAR), 8, '0') || q.p1[9:] || 'I'),
                least(q.p3, lpad(CAST(CAST(q.p2[1:8] AS INT) + 5 AS VARCHAR), 8, '0') || q.p2[9:] || 'I', lpad(CAST(CAST(q.p0[1:8] AS INT) + 10 AS VARCHAR), 8, '0') || q.p0[9:] || 'II', lpad(CAST(CAST(q.p1[1:8] AS INT) + 10 AS VARCHAR), 8, '0') || q.p1[9:] || 'II')
            FROM (
                SELECT w.conv_id, f.i, del[1] AS p0, least(del[2], CASE WHEN f.x = 's' AND ok THEN edit[1] END) AS p1,
                    CASE WHEN ok THEN least(del[3], CASE WHEN f.x = 'u' THEN least(edit[1], edit[2], edit[4]) END, least(again[1], again[2], again[4])) ELSE del[3] END AS p2,
                    CASE WHEN ok THEN least(del[4], CASE WHEN f.x = 'a' THEN edit[3] END, again[3]) ELSE del[4] END AS p3
                FROM (
                    SELECT w.*, f.i AS fi, f.fault NOT IN ('blank', 'duplicate') AS ok,
                        [lpad(CAST(CAST(p[1:8] AS INT) + 2 AS VARCHAR), 8, '0') || p[9:] || 'D' FOR p IN [p0, p1, p2, p3]] AS del,
                        [lpad(CAST(CAST(p[1:8] AS INT) + CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS VARCHAR), 8, '0') || p[9:] || 'K' FOR p IN [p0, p1, p2, p3]] AS edit,
                        [lpad(CAST(CAST(p[1:8] AS INT) + CASE WHEN f.fault = 'truncated' THEN 6 ELSE 1 END AS VARCHAR), 8, '0') || p[9:] || 'R' FOR p IN [p0, p1, p2, p3]] AS again
                    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
                ) AS w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.fi
            ) AS q
        ), best AS (
            SELECT w.conv_id, least(p0, p3) AS p FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i
        ), e AS (
            SELECT conv_id, CAST(p[1:8] AS BIGINT) AS cost, p[9:] AS audit, unnest(string_split(p[9:], '')) AS letter, unnest(range(1, length(p) - 7)) AS pos FROM best
        ), g AS (
            SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS j FROM e
        ), r AS (
            SELECT g.*, CASE WHEN letter <> 'I' THEN f.role END AS role, CASE WHEN letter <> 'I' THEN f.text ELSE '' END AS text,
                max(CASE WHEN letter = 'K' AND f.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g.conv_id) AS s
            FROM g LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i
        ), z AS (
            SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS repaired
            FROM r WHERE letter <> 'D' GROUP BY conv_id
        )
        SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, coalesce(CAST(p[1:8] AS BIGINT), 0) AS cost, coalesce(p[9:], '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS a
        LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
    """,
    "op13_importance_resampling": r"""
        WITH w AS (
            SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
            UNION ALL
            SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
        ), x AS (SELECT side, doc_id, unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS g FROM w),
        per AS (SELECT side, doc_id, g, count(*) AS n FROM x GROUP BY ALL),
        b AS (
            SELECT g, list_reduce(list_prepend(4294967295::UBIGINT, [CAST(CAST('0x' || v AS UTINYINT) AS UBIGINT) FOR v IN regexp_extract_all(hex(encode(g)), '..')]),
                lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)) AS c
            FROM (SELECT DISTINCT g FROM per)
        ), k AS (SELECT g, CAST(xor(c, 4294967295::UBIGINT) % 10000 AS INT) AS bucket FROM b),
        n AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS BIGINT) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS BIGINT) AS t FROM per JOIN k USING (g) GROUP BY bucket),
        a AS (SELECT CAST(sum(s) AS BIGINT) AS s, CAST(sum(t) AS BIGINT) AS t FROM n),
        gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((n.t + 1) * (a.s + 10000) AS DOUBLE) / CAST((n.s + 1) * (a.t + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n, a),
        v AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM per JOIN k USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id),
        z AS (
            SELECT w.doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features,
                CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
                CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
            FROM w LEFT JOIN v ON v.doc_id = w.doc_id WHERE side = 0
        ), y AS (
            SELECT doc_id, n_features, weight, weight + noise AS score, words >= 20 AS may FROM z
        ), q AS (
            SELECT doc_id, n_features, weight, score, CASE WHEN may THEN row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (may) OVER () AS n FROM y
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM q
    """,
}
