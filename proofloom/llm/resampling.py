"""Importance resampling of documents towards a target text distribution.

Features are words and pairs of consecutive words, hashed into ``BUCKETS`` buckets by the CRC-32 of their bytes.

1. Each task grows tries of its texts, a run of words at a time: words below the root, second words below first ones. A
   node holds how often its feature came and the CRC-32 of its bytes. A child's state goes on from its parent's: the
   parent's is moved on by the child's length, for all children at once. Words and their states are remembered from run
   to run, ``NODES`` at most; children are arrays of one run. Bucket totals of a task's tries leave it once.
2. Totals of the raw and of the target texts give each bucket's gain: ``BUCKETS`` numbers, whatever the input's size.
3. Texts walk the same kind of trie, whose nodes now carry the gain of their bucket; a text's weight is the floored mean
   of its features' gains. Gumbel noise from a hash of doc_id is added, so the highest scores are a draw without
   replacement.
4. The least score that can be drawn comes from the histogram of scores; only rows from there on are ranked, in ranges
   that are sorted each by itself and moved on by the sizes of the ranges before.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, frugal, tidied

BUCKETS = 10_000
#: Words that a task remembers; a trie with more starts anew.
NODES = 200_000
#: Words handled at a time, and bytes of one text.
WORDS, SLICE = 200_000, 1 << 20
#: Lengths by which states are moved on in tables.
MOVES = 64
#: Documents with fewer words are never drawn; of the others so many per cent are.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7

#: Bytes of words stay (capitals as small letters), all others become spaces; bytes of non-ASCII characters are words'.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACE = zlib.crc32(b" ")


def _tables() -> np.ndarray:
    """[n, place, byte]: a state of that one byte at that place, moved on by n zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.zeros((MOVES + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(MOVES):
        out[n + 1] = step[out[n] & 255] ^ (out[n] >> 8)
    return out


_MOVED = _tables()


class Trie:
    """Words by number, each with the CRC-32 of its bytes and of its bytes after a space."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.own, self.after, self.length = array("I"), array("I"), array("I")
        self.spelled: dict[int, bytes] = {}

    def __len__(self) -> int:
        return len(self.numbers)

    def walk(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words."""
        numbers = self.numbers
        for word in set(words).difference(numbers):
            if len(word) >= MOVES:
                self.spelled[len(numbers)] = word
            numbers[word] = len(numbers)
            self.own.append(zlib.crc32(word))
            self.after.append(zlib.crc32(word, _SPACE))
            self.length.append(min(len(word) + 1, MOVES))
        return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))

    def states(self) -> np.ndarray:
        return np.frombuffer(self.own, np.uint32)

    def below(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """States of the children: second words below first ones."""
        state, n = self.states()[first], np.frombuffer(self.length, np.uint32)[second]
        out = np.frombuffer(self.after, np.uint32)[second].copy()
        for place in range(4):
            out ^= _MOVED[n, place, (state >> np.uint32(8 * place)) & np.uint32(255)]
        if self.spelled:
            for k in np.flatnonzero(n == MOVES):
                if (word := self.spelled.get(int(second[k]))) is not None:
                    out[k] = zlib.crc32(b" " + word, int(state[k]))
        return out


def _children(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, second word, count) of each child of a run, and for each pair of words its child and its text."""
    same = doc[:-1] == doc[1:]
    keys, back, count = np.unique((words[:-1][same] << 32) | words[1:][same], return_inverse=True, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, count, back, doc[:-1][same]


def _runs(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """(words, number of their text, repeated) of some ``WORDS`` words at a time.

    A text longer than ``SLICE`` comes in parts; where a part follows on, its first word is the last one before, and
    repeated is 1.
    """
    words: list[bytes] = []
    docs: list[int] = []
    lengths: list[int] = []
    repeated = 0
    for k, text in enumerate(texts):
        folded = text.translate(_FOLD)
        at = 0
        while at < len(folded):
            end = len(folded) if len(folded) <= at + SLICE else folded.find(b" ", at + SLICE)
            end = len(folded) if end < 0 else end
            more = folded[at:end].split()
            words += more
            docs.append(k)
            lengths.append(len(more))
            at = end
            if len(words) - repeated >= WORDS:
                last = words[-1]
                yield words, np.repeat(docs, lengths), repeated
                words, docs, lengths, repeated = ([last], [k], [1], 1) if at < len(folded) else ([], [], [], 0)
    if words:
        yield words, np.repeat(docs, lengths).astype(np.int64), repeated


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS, nodes: int = NODES) -> DataFrame:
    """bucket, n: features of all rows of ``text``. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = Trie(), np.zeros(buckets, np.int64)
        for batch in batches:
            for words, doc, repeated in _runs(_texts(batch)):
                trie = trie if len(trie) < nodes else Trie()
                at = trie.walk(words)
                first, second, count, _, _ = _children(at, doc)
                np.add.at(total, trie.states() % buckets, np.bincount(at[repeated:], minlength=len(trie)))
                np.add.at(total, trie.below(first, second) % buckets, count)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(tidied(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: 1000 times the logarithm of its share of the target against its share of the raw texts, floored.

    One is added to each bucket's count. Both totals have at most ``buckets`` rows.
    """
    counts = []
    with frugal(raw.sparkSession):
        for texts in (raw, target):
            n = np.zeros(buckets, object)
            for r in bucket_totals(texts, buckets).collect():
                n[r.bucket] = r.n
            counts.append([int(x) for x in n])
    (s, t), (all_s, all_t) = counts, (sum(c) for c in counts)
    return np.array([math.floor(1000 * math.log(float((b + 1) * (all_s + buckets)) / float((a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, nodes: int = NODES) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row; weight is the floored mean gain of its features, 0 if it has none.

    Null and empty texts have no features; repeated rows are weighed each.
    """
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for words, doc, repeated in _runs(_texts(batch)):
                trie = trie if len(trie) < nodes else Trie()
                at = trie.walk(words)
                first, second, _, back, of = _children(at, doc)
                np.add.at(n, doc[repeated:], 1)
                np.add.at(total, doc[repeated:], gain[trie.states() % buckets][at[repeated:]])
                np.add.at(total, of, gain[trie.below(first, second) % buckets][back])
            features = np.maximum(2 * n - 1, 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(features), pa.array(total // np.maximum(features, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED) -> Column:
    """1000 times a Gumbel variate of doc_id's hash, floored; a null id counts as an empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their rank, 1, 2, 3... in that order.

    Ranges of the order are sorted each by itself; a range's rows are moved on by the sizes of the ranges before, one
    number for each range. Written down first, since ranges depend on a sample of the rows.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).collect()
    before, at = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        before.append((r["_part"], at))
        at += r["n"]
    base = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    met = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(base), "_part")
    return met.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score of every row of ``docs``, and rank: 1, 2, 3... of those drawn, else null.

    Drawn are the highest scores, ``percent`` of the documents with at least ``least_words`` words, rounded down; ties go
    to the smaller doc_id, then to fewer features and the smaller weight; rows without doc_id come last among ties. Rows
    of one doc_id are documents each, with the same noise. An empty target weighs by the raw texts alone; an empty table
    gives no rows. Columns other than doc_id and text are not looked at.
    """
    gain = gains(docs, target, buckets)
    spark = docs.sparkSession
    with frugal(spark):
        scored = cut(weights(docs, gain).withColumn("score", F.col("weight") + noise(seed)), "resampled")
    eligible = F.col("n_words") >= least_words
    # a score is a whole number between the floors of two logarithms, some 120 000 values at most
    histogram = sorted(((r.score, r.n) for r in scored.filter(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn, least, seen = percent * sum(n for _, n in histogram) // 100, None, 0
    for score, n in histogram:
        if seen < drawn:
            least, seen = score, seen + n
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    may = eligible & (F.col("score") >= least)
    best = ranked(scored.filter(may).select(*columns), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"))
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return best.unionByName(scored.filter(~may).select(*columns, F.lit(None).cast("long").alias("rank")))
