"""A quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics come from bytes, words and lines of the whole text. Trees are grown level by level from histograms of
binned statistics, all to one depth, so a tree is three arrays (statistic, threshold, leaf value) and a batch walks
all trees at once: place = 2 * place + 1 + (value > threshold).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: Rows that a model is fitted on at most; the rest of the labelled rows only has to be scored.
SAMPLE = 20_000
THRESHOLD = 0.3
NAMES = (
    "log_bytes log_words word_len word_len_sd longest long_words distinct top_word repeats upper_words lines line_len short_lines line_repeats top_line "
    "upper lower digit space newline high stop comma colon bang question percent amp dollar hash star bar slash at quote bracket math other entropy classes_max"
).split()
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", bytes(range(128, 256)), b".", b",", b":;", b"!", b"?", b"%", b"&", b"$", b"#", b"*", b"|", b"/\\", b"@", b"\"'`", b"()[]{}<>", b"+-=_^~"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_c, np.uint8)] = _i
_TO_CLASS = np.eye(len(_CLASSES) + 1)[_CLASS]


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of ``NAMES`` a text; a null text counts as empty."""
    out = np.zeros((len(texts), len(NAMES)))
    for row, text in zip(out, texts, strict=True):
        b = (text or "").encode("utf-8", "replace")
        if not b:
            continue
        hist = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        share = hist[hist > 0] / len(b)
        words, lines = b.split(), b.split(b"\n")
        n = max(1, len(words))
        lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        counts = Counter(words)
        seen = Counter(lines)
        line_lens = np.fromiter(map(len, lines), np.int64, len(lines))
        classes = hist @ _TO_CLASS / len(b)
        row[:15] = (
            np.log1p(len(b)), np.log1p(len(words)), lens.mean(), lens.std(), np.log1p(lens.max()), (lens > 14).mean(), len(counts) / n, max(counts.values(), default=0) / n,
            sum(map(bytes.__eq__, words, words[1:])) / n, sum(map(bytes.isupper, words)) / n, np.log1p(len(lines)), np.log1p(line_lens.mean()), (line_lens < 20).mean(), 1 - len(seen) / len(lines), max(seen.values()) / len(lines),
        )
        row[15:-2] = classes
        row[-2:] = -(share * np.log2(share)).sum(), classes.max()
    return out


class Boosted:
    """Trees as arrays: statistic and threshold by inner place, value by leaf."""

    def __init__(self, depth: int = 4, trees: int = 160, rate: float = 0.1, bins: int = 64, least: int = 8, ridge: float = 2.0):
        self.depth, self.trees, self.rate, self.bins, self.least, self.ridge = depth, trees, rate, bins, least, ridge
        self.base = 0.0
        self.feature = np.zeros((0, 2**depth - 1), np.int64)
        self.threshold, self.leaf = np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        n, width = x.shape
        rate = min(max((y.sum() + 0.5) / (n + 1.0), 1e-4), 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        if n == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        flat = binned + np.arange(width) * self.bins
        raw, inner, leaves = np.full(n, self.base), 2**self.depth - 1, 2**self.depth
        feature, threshold, leaf = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node, feat, thr = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                key = (node[:, None] * (width * self.bins) + flat).ravel()
                size = many * width * self.bins
                sums = [np.bincount(key, np.repeat(w, width), size).reshape(many, width, self.bins).cumsum(2) for w in (g, h)]
                count = np.bincount(key, minlength=size).reshape(many, width, self.bins).cumsum(2)
                (gl, hl), (gt, ht), ct = sums, (s[:, :1, -1:] for s in sums), count[:, :1, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(count < self.least) | (ct - count < self.least)] = 0
                best = gain.reshape(many, -1).argmax(1)
                top = gain.reshape(many, -1)[np.arange(many), best]
                for k in range(many):
                    j, cut = divmod(int(best[k]), self.bins)
                    if top[k] > 1e-6 and cut < len(edges[j]):
                        feat[first + k], thr[first + k] = j, edges[j][cut]
                at = first + node
                node = 2 * node + (x[np.arange(n), feat[at]] > thr[at])
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            raw += value[node]
            feature.append(feat)
            threshold.append(thr)
            leaf.append(value)
        self.feature, self.threshold, self.leaf = np.array(feature), np.array(threshold), np.array(leaf)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1, all trees walked together."""
        trees = np.arange(len(self.feature))
        place, rows = np.zeros((len(x), len(trees)), np.int64), np.arange(len(x))[:, None]
        for _ in range(self.depth if len(trees) else 0):
            place = 2 * place + 1 + (x[rows, self.feature[trees, place]] > self.threshold[trees, place])
        raw = self.base + (self.leaf[trees, place - (2**self.depth - 1)].sum(1) if len(trees) else 0)
        return 1 / (1 + np.exp(-np.broadcast_to(raw, len(x))))


def remainder(modulus: int) -> "F.Column":
    """crc32(doc_id as text) mod ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def sampled(docs: DataFrame, labels: DataFrame, label: str, learn: "F.Column", most: int, most_bytes: int | None = None) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled ids that may be learnt from, by a hash of doc_id.

    Of rows that repeat an id one counts, that of the smallest hash of its text, and of labels the smaller. With
    ``most_bytes`` ids are taken in that order as long as their texts have no more bytes together; the first one counts
    in any case.
    """
    marks = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & learn)
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"))
    # a bounded number of ids and labels
    few = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    met = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    if most_bytes is not None:
        size = F.coalesce(F.octet_length("text"), F.lit(0))
        sizes = met.groupBy("doc_id").agg(F.min_by(size, F.xxhash64("text")).alias("n"), F.first(F.xxhash64("doc_id")).alias("h")).collect()  # three numbers an id
        kept, total = [], 0
        for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
            total += r.n
            if kept and total > most_bytes:
                break
            kept.append((r.doc_id,))
        met = met.join(F.broadcast(docs.sparkSession.createDataFrame(kept, docs.select("doc_id").schema)), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: "F.Column | None" = None, sample: int = SAMPLE) -> Boosted:
    """A model of ``label`` from at most ``sample`` labelled rows of those that ``learn`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                x = statistics(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = sampled(docs, labels, label, F.lit(True) if learn is None else learn, sample).mapInArrow(tidied(run), "doc_id long, label int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(NAMES))
    return Boosted().fit(x, rows["label"].to_numpy(float))


def score(docs: DataFrame, model: Boosted) -> DataFrame:
    """doc_id and score (0 to 1) of every row.

    Only the text is looked at. Null and empty texts have statistics of zero and get a score too; a model fitted on no
    rows, or on one label only, scores every row alike. Repeated rows are scored each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                s = model.score(statistics(b.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, score double")


def classified(scored: DataFrame, held_out: "F.Column", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
