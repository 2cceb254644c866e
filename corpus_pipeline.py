"""A training corpus from documents, in five stages, each on all that the one before kept.

1. toxicity: documents that the classifier rejects go;
2. n-gram Jaccard join: of each group of near and exact copies the document with the smallest doc_id stays;
3. substring dedup: words of passages that also start in an earlier document go; documents left without words go too;
4. mixing sources to target weights: each document comes as often as the mix takes it, its last copy cut where the mix
   ends;
5. best-fit packing of what is left into sequences of token ids.

All stages but the last return the columns of documents, whatever other columns there are and whatever their names.
doc_id stays an integer; in the mix the copies of a document share it, and packing tells them apart by their text's
place in the result. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import jaccard, mixing, packing, quality, substrings, toxicity
from proofloom.llm.common import WORD, cut, drop_cut, frugal, quoted, table, whole_row
from proofloom.llm.queries import tokenizer_path

#: SQL cannot express the classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def _with_text(docs: DataFrame, field: Callable[[str], Column], text: Column) -> list[Column]:
    """All columns of ``docs``, as ``field`` finds them, with another text, and with n_chars as it then is where documents had it."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return [(new[c] if c in new else field(c)).alias(c) for c in docs.columns]


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, whatever their other columns hold.

    Null and empty texts score low and stay; repeated rows score alike; a very long text scores as its worst window.
    """
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", quality.remainder(4) != 2)
    with frugal(spark):  # whole rows go through Python here, so few at a time
        return cut(toxicity.kept(docs, network), "pipeline-toxicity")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of links: the one with the smallest doc_id.

    Among rows of one doc_id that of the smallest hash of its text stays, among equal texts one row; rows without doc_id
    come last. Rows without words link with nothing and stay.
    """
    linked = cut(jaccard.link(docs).select("doc_id", "tid", "group"), "pipeline-linked")
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("doc_id"), F.col("tid").alias("tid"))
    of = linked.filter("group is not null").groupBy("group").agg(F.min(key).alias("best"), F.count("*").alias("n")).filter("n > 1")
    gone = linked.join(of.select("group", "best"), "group").filter(~key.eqNullSafe(F.col("best"))).select("doc_id", "tid").distinct()
    again = linked.filter("group is not null").groupBy("doc_id", "tid").agg(F.count("*").alias("n")).filter("n > 1")
    # what decides about rows has two numbers a row; rows that need no decision go straight through
    fate = cut(gone.withColumn("fate", F.lit("gone")).unionByName(again.join(gone, (again.doc_id.eqNullSafe(gone.doc_id)) & (again.tid == gone.tid), "left_anti").select("doc_id", "tid", F.lit("again").alias("fate"))), "pipeline-fate")
    drop_cut(linked)
    few = fate.count() <= jaccard.SEND_IDS
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    met = rows.join(F.broadcast(fate) if few else fate, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("tid")), "left")
    single = met.filter("fate is null").select("row")
    if not fate.filter("fate = 'again'").isEmpty():
        repeated = met.filter("fate = 'again'").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
        single = single.unionByName(repeated.select("row"))
    return single.select("row.*")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that an earlier document has; untouched texts stay as they are.

    Rows of one doc_id take nothing from each other; rows without doc_id, null and short texts stay as they are.
    """
    out = substrings.rewrite(docs, emptied=False)
    return out.select(*_with_text(out, lambda c: F.col(quoted(c)), F.col("text")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the pass that ends inside a document takes its first words.

    Documents without words are in no pass. A null source is a source; repeated rows are documents of their own.
    """
    drawn = mixing.plan_mix(docs, carry=True).select("_row", "size", F.explode("passes").alias("pass"))
    words = F.regexp_extract_all("_row.text", F.lit(WORD), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.col("pass.words").cast("int")), " ")
    text = F.when(F.col("pass.words") < F.col("size"), head).otherwise(F.col("_row.text"))
    return drawn.select(*_with_text(docs, lambda c: F.col("_row").getField(c), text))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; a null text is one token."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", detoxify), ("ngram_jaccard_join", deduplicate), ("substring_dedup", cut_passages), ("mixing", mix), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1 and not hasattr(docs, "_cut_path"):
            docs = cut(docs, f"pipeline-{name}")
        if before is not None:  # the last stage has read its input by now: it returns pieces that it has written
            drop_cut(before)
        before = docs
    return docs
