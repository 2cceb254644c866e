"""Retrieval over chunks by three paths at once, and verdicts of requirements from what it finds.

Dense vectors, BM25+ and exact ids each rank the chunks; the first two give a few times more hits than are wanted. The list
of exact matches has no such limit: an id may stand in any share of all chunks. Its chunks' scores follow from each chunk
alone, so every task keeps its best of each query, and only for these the place in the exact list is counted: chunks
before each of a query's few marks, added up, instead of a sort of the whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expansion import expanded
from ..functions.text import FAIL_LINE, PASS_LINE, bigrams, shortened, stripped, title_tokens
from ..staging import settled
from . import needles, retrieval
from .index import TextIndex

# --- fixed values
TOP, CLASSIFY_TOP, CLIP, SNIPPET = 3, 4, 420, 300
SEMANTIC_OVERFETCH = 3
VERDICT_QUERY = "verification test evidence pass fail result"
# --- end of fixed values
#: Rows of ids, titles and candidates that are sent to all tasks at most; beyond, joins shuffle.
SEND_ROWS = 500_000


def over_fetch(k: int) -> int:
    """How many hits each ranked path gives for ``k`` wanted."""
    return max(3 * k, k + 6)


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SEND_ROWS + 1).count() <= SEND_ROWS else df


def _upper(c: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))


def _titled(chunks: DataFrame) -> DataFrame:
    """Chunks with the words of their requirement's title: that of its first chunk that has one."""
    named = chunks.filter((_upper("requirement_id") != "") & (F.trim(F.coalesce("requirement_title", F.lit(""))) != ""))
    titles = named.groupBy(_upper("requirement_id").alias("_rid")).agg(F.min_by(F.trim("requirement_title"), "chunk_id").alias("_title"))
    titles = settled(titles.select("_rid", F.array_distinct(title_tokens(F.col("_title"))).alias("_title_words")))
    return chunks.withColumn("_rid", _upper("requirement_id")).drop("requirement_title").join(_sent(titles), "_rid", "left")


def _exact(asked: DataFrame, chunks: DataFrame, keep: list[str]) -> DataFrame:
    """(query_id and columns ``keep``) of chunks whose requirement is the query's or whose text holds its id.

    chunks: _own, the requirement in lower case, text, and ``keep``; no text goes with a hit unless it is kept.
    """
    ids = asked.filter(F.trim(F.coalesce("requirement_id", F.lit(""))) != "").select("query_id", F.lower(F.trim("requirement_id")).alias("needle"))
    known = _sent(ids.select("needle").distinct())
    own = chunks.withColumn("needle", F.col("_own")).join(known, "needle", "left_semi")
    texts = needles.find(ids, chunks, [*keep, "_own"], places=False).filter(F.col("_own") != F.col("needle"))
    return own.select(*keep, "needle").unionByName(texts.select(*keep, "needle")).join(_sent(ids), "needle").drop("needle")


def _clipped(text: Column, most: int) -> Column:
    return shortened(stripped(text), most)


def _worded(asked: DataFrame) -> DataFrame:
    """What scores need of each query (query_id, query_text, query_rid, query_title)."""
    title = F.coalesce("query_title", F.lit(""))
    rows = asked.select("query_id", F.trim(F.coalesce("query_rid", F.lit(""))).alias("query_rid"), title.alias("query_title"), F.array_distinct(title_tokens(F.col("query_text"))).alias("query_words"), title_tokens(title).alias("title_words"))
    return rows.withColumn("title_pairs", bigrams(F.col("title_words")))


def _scores(rows: DataFrame, base: Column, paths: Column) -> DataFrame:
    """covered and score of rows (_low, _title_words, _rid and the columns of ``_worded``), as boosts add up.

    Words of queries and titles and the texts in lower case come with the rows: of each query, title and chunk they are
    worked out once, not once a pair.
    """
    first = F.round(base, 4)
    rows = rows.withColumn("covered", retrieval.covered(first, F.col("_title_words"), F.col("query_words")))
    rid = F.col("query_rid")
    meta = (rid != "") & (F.col("_rid") == F.upper(rid))
    inside = (rid != "") & F.col("_low").contains(F.lower(rid))
    # columns of their own: named twice in an expression, they would be worked out twice
    rows = rows.withColumns({"_m": retrieval.held(F.col("_low"), F.col("title_words")), "_both": retrieval.held(F.col("_low"), F.col("title_pairs"))})
    rows = rows.withColumn("_boost", retrieval.boost(F.col("_m"), F.col("_both"), F.size("title_words"), paths, meta, inside))
    boosted = retrieval.raised(F.col("covered"), F.col("_boost"))
    return rows.withColumn("score", F.when((rid == "") & (F.col("query_title") == ""), F.col("covered")).otherwise(boosted))


def _marked(exact: DataFrame, marks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, exact_rank) of ``marks`` that are in the exact list: how many of its chunks are not after them."""
    lists = marks.groupBy("query_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("m"))  # a few of each query
    slot = F.size(F.filter("m", lambda x: x < F.col("chunk_id")))
    counts = exact.select("query_id", "chunk_id").join(_sent(lists), "query_id").groupBy("query_id", slot.alias("slot")).agg(F.count("*").alias("n"), F.max("chunk_id").alias("last"))
    total = counts.withColumn("exact_rank", F.sum("n").over(Window.partitionBy("query_id").orderBy("slot")))
    # a mark of the list is the last chunk of its own slot
    return total.select("query_id", F.col("last").alias("chunk_id"), "exact_rank").join(marks, ["query_id", "chunk_id"], "left_semi")


def retrieve(queries: DataFrame, chunks: DataFrame | None, k: int = TOP, clip: int = CLIP, index: TextIndex | None = None) -> DataFrame:
    """The ``k`` best hits of each query, one a requirement, in ``rank``.

    queries: query_id (whole number), text, requirement_id, title; the last two may be null or empty. chunks: chunk_id (a
    whole number that orders them), requirement_id, requirement_title, text; with an ``index`` its own are taken, and
    nothing is embedded or tokenised again. Queries without text have no hits.

    Returns query_id, rank, chunk_id, requirement_id, score, fused (6 places), sources (paths that found it, in order, with
    ``+``), paths, text (at most ``clip`` characters). Among equal scores known requirements come first, then the better
    covered title, then the better fused rank, then dense before BM25 before exact hits in their order.
    """
    over = over_fetch(k)
    asked = queries.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.col("query_id").cast("long").alias("query_id"), expanded(F.col("text")).alias("query_text"), F.col("requirement_id").alias("query_rid"), F.col("title").alias("query_title"))
    wanted = asked.select("query_id", F.col("query_text").alias("text"))
    own = (chunks if index is None else index.chunks).select(F.col("chunk_id").cast("long").alias("chunk_id"), "requirement_id", "requirement_title", "text")
    many = SEMANTIC_OVERFETCH * over
    near = retrieval.hash_top_k(wanted, own, many, doc="chunk_id") if index is None else retrieval.vector_top_k(retrieval.embedded(wanted, "query_id"), index.vectors, many, "query_id", "chunk_id")
    lexical = retrieval.bm25(wanted, own, over, doc="chunk_id") if index is None else index.bm25(wanted, over)
    found = near.select("query_id", "chunk_id", F.col("score").alias("_near"), F.col("rank").alias("_near_rank"))
    found = found.join(lexical.select("query_id", "chunk_id", F.col("score").alias("_bm25"), F.col("rank").alias("_bm25_rank")), ["query_id", "chunk_id"], "full")
    found = settled(found)
    titled = _titled(own)

    # the dense path: hybrid order of more hits than it gives
    met = titled.select("chunk_id", "text").join(_sent(found), "chunk_id").join(_sent(asked.select("query_id", "query_text")), "query_id")
    a, b = retrieval.words(F.col("query_text")), retrieval.words(F.col("text"))
    share = F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    mixed = F.when(F.col("_near").isNotNull(), F.round(retrieval.HYBRID[0] * F.col("_near") + retrieval.HYBRID[1] * share, retrieval.PLACES))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("_dense").desc_nulls_last(), "_near_rank", "chunk_id"))
    met = met.withColumn("_dense", mixed).withColumn("_place", place).withColumn("_dense_rank", F.when(F.col("_dense").isNotNull() & (F.col("_place") <= over), F.col("_place")))
    met = met.filter("_dense_rank is not null or _bm25_rank is not null").withColumn("_dense", F.when(F.col("_dense_rank").isNotNull(), F.col("_dense")))
    met = settled(met.select("query_id", "chunk_id", "_dense", "_dense_rank", "_bm25", "_bm25_rank"))

    # the exact path: of its chunks that no other path has, the best of each query and requirement
    wordy = _sent(settled(_worded(asked)))
    parts = titled.select("chunk_id", "_rid", "_title_words", F.lower(F.trim(F.coalesce("requirement_id", F.lit("")))).alias("_own"), F.lower(_clipped(F.col("text"), clip)).alias("_low"), "text")
    exact = _exact(asked.select("query_id", F.col("query_rid").alias("requirement_id")), parts, ["chunk_id", "_rid", "_title_words", "_low"]).join(wordy, "query_id")
    exact = _scores(exact, F.lit(0.5), F.lit(1))
    exact = settled(exact.select("query_id", "chunk_id", "_rid", "covered", "score"))
    order = [F.desc("score"), F.desc("covered"), F.col("chunk_id")]
    alone = exact.join(_sent(met.select("query_id", "chunk_id")), ["query_id", "chunk_id"], "left_anti")
    known = alone.filter("_rid <> ''").withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_rid").orderBy(*order))).filter("_r = 1")
    alone = known.drop("_r").unionByName(alone.filter("_rid = ''"))
    alone = alone.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("_rid") == "", *order[1:]))).filter(F.col("_r") <= k)

    every = met.unionByName(alone.select("query_id", "chunk_id"), allowMissingColumns=True)
    ranks = _marked(exact, every.select("query_id", "chunk_id"))
    every = settled(every.join(ranks, ["query_id", "chunk_id"], "left"))
    every = titled.join(_sent(every), "chunk_id").join(wordy, "query_id").withColumn("text", _clipped(F.col("text"), clip)).withColumn("_low", F.lower("text"))
    names = (("dense", "_dense_rank"), ("bm25", "_bm25_rank"), ("exact_id", "exact_rank"))
    every = every.withColumns({
        "fused": F.round(sum((F.coalesce(1.0 / (F.lit(retrieval.RRF) + F.col(c)), F.lit(0.0)) for _, c in names), F.lit(0.0)), 12),
        "sources": F.concat_ws("+", *[F.when(F.col(c).isNotNull(), n) for n, c in names]),
        "paths": sum((F.col(c).isNotNull().cast("int") for _, c in names), F.lit(0)),
        "_first": F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(p).alias("p"), F.col(c).cast("long").alias("r"))) for p, (_, c) in enumerate(names)]),
    })
    every = _scores(every, retrieval.base_score(F.col("_dense"), F.col("_bm25")), F.col("paths"))
    best = [F.desc("score"), F.col("_rid") == "", F.desc("covered"), F.desc("fused"), F.col("_first")]
    group = F.when(F.col("_rid") == "", F.col("chunk_id"))
    once = every.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_rid", group).orderBy(*best))).filter("_r = 1")
    out = retrieval.ranked(once, "query_id", k, *best)
    return out.select("query_id", "rank", "chunk_id", F.nullif(F.trim("requirement_id"), F.lit("")).alias("requirement_id"), "score", F.round("fused", 6).alias("fused"), "sources", "paths", "text")


def listed_verdict(texts: Column, needle: Column, fail: str = FAIL_LINE, good: str = PASS_LINE) -> tuple[Column, Column]:
    """Verdict of a few texts in order: near the id in the first that says something there, else in all of them."""
    low = F.lower(needle)

    def window(text):
        at = F.position(low, F.lower(text))
        start = F.greatest(F.lit(1), at - retrieval.VERDICT_WINDOW)
        return F.when((low != "") & (at > 0), F.substring(text, start, at + F.length(needle) + retrieval.VERDICT_WINDOW - start))

    near = F.transform(texts, lambda t: F.when(window(t).rlike(fail), "FAIL").when(window(t).rlike(good), "PASS"))
    close = F.get(F.filter(near, lambda v: v.isNotNull()), F.lit(0))
    joined = F.array_join(texts, "\n")
    whole = F.when(joined.rlike(fail), "FAIL").when(joined.rlike(good), "PASS").otherwise("UNKNOWN")
    return F.coalesce(close, whole), F.when(close.isNotNull(), "proximity").otherwise("full_text")


def classify(requirements: DataFrame, chunks: DataFrame | None, k: int = CLASSIFY_TOP, fail: str = FAIL_LINE, good: str = PASS_LINE, index: TextIndex | None = None) -> DataFrame:
    """query_id, verdict, snippet, relevance_gate, verdict_method, agreement, top_score, hits of each requirement.

    requirements: query_id (whole number), requirement_id, title. A requirement without relevant hits (its id neither a
    hit's requirement nor in a hit's text, and no word of its title in one) is NOT_FOUND; the gate is then ``failed``, or
    null without any hit. snippet: the first 300 characters of the best hit; agreement: how many paths found that one.
    """
    rid, title = F.trim(F.coalesce("requirement_id", F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    asked = requirements.select(F.col("query_id").cast("long").alias("query_id"), rid.alias("requirement_id"), title.alias("title"))
    some = asked.withColumn("text", F.concat_ws(" ", F.nullif("requirement_id", F.lit("")), F.nullif("title", F.lit("")), F.lit(VERDICT_QUERY)))
    hits = retrieve(some, chunks, k, index=index)
    one = F.struct("rank", F.coalesce("text", F.lit("")).alias("text"), "score", "paths", F.upper(F.coalesce("requirement_id", F.lit(""))).alias("rid"))
    per = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("h"))  # k a query
    rows = asked.join(per, "query_id", "left")
    texts = F.filter(F.transform("h", lambda x: x["text"]), lambda t: t != "")
    r = F.col("requirement_id")
    relevant = (r != "") & (F.exists("h", lambda x: x["rid"] == F.upper(r)) | F.exists(texts, lambda x: F.lower(x).contains(F.lower(r))))
    relevant = relevant | F.exists(texts, lambda x: retrieval.title_overlap(F.col("title"), x) > 0)
    verdict, method = listed_verdict(texts, r, fail, good)
    found = F.col("h").isNotNull()
    return rows.select(
        "query_id",
        F.when(found & relevant, verdict).otherwise("NOT_FOUND").alias("verdict"),
        F.when(found & relevant, F.substring(F.get(texts, F.lit(0)), 1, SNIPPET)).alias("snippet"),
        F.when(found, F.when(relevant, "passed").otherwise("failed")).alias("relevance_gate"),
        F.when(found & relevant, method).alias("verdict_method"),
        retrieval.agreement(F.coalesce(F.get("h", F.lit(0))["paths"], F.lit(0))).alias("agreement"),
        F.round(F.array_max(F.transform("h", lambda x: x["score"])), 4).alias("top_score"),
        F.when(found, F.size("h")).otherwise(0).alias("hits"),
    )
