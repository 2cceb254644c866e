"""Retrieval: BM25+, dense search, exact matches, fusion and reranking, batch over queries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, contained, keyword_tokens, title_tokens, words
from . import needles

# --- fixed values
K1, B, DELTA = 1.5, 0.75, 1.0
RRF = 60
BUCKETS = 128
HYBRID = (0.8, 0.2)
VERDICT_WINDOW = 320
# --- end of fixed values
#: Query terms, and queries, that are sent to all executors at most; beyond, joins do the work.
SEND_TERMS = 1_000_000
SEND_QUERIES = 20_000
#: Places to which scores are compared: what differs less is rounding of sums in another order.
PLACES = 10
#: Numbers that a task's arrays hold at a time, and characters of texts that it takes from a batch at once, about.
CELLS = 500_000
SLICE = 1_000_000


def slices(batch: pa.RecordBatch, text: int, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch: ``rows`` rows at most, and fewer where the texts of column ``text`` are long (one at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right"))
        end = min(max(end, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


def ranked(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each ``by``, numbered from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def bm25_stats(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, df) over all documents, and one row (docs, mean_len); empty documents count."""
    tokens = docs.select(doc, keyword_tokens(F.col(text)).alias("t"))
    df = tokens.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df, tokens.agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("mean_len"))


class Best:
    """The k best (score, key) of each query number, of all that are added; ties go to the smaller key."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n, self.room = 0, max(1 << 16, 2 * queries * k)

    def enough(self) -> np.ndarray:
        """What a score above 0 must reach, before it is rounded, to be looked at: ``least`` is rounded, perhaps upwards."""
        return np.maximum(self.least - 10.0**-PLACES, 5e-11)

    def add(self, query: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        score = np.round(score, PLACES)
        good = score >= self.least[query]
        self.held.append((query[good], score[good], key[good]))
        self.n += int(good.sum())
        if self.n > self.room:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score, key = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        order = np.lexsort((key, -score, query))
        query, score, key = query[order], score[order], key[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        good = place < self.k
        self.held = [(query[good], score[good], key[good])]
        self.n = int(good.sum())
        return self.held[0]


def _best_rows(ids: list, best: Best, query: str, doc: str) -> pa.RecordBatch:
    q, score, key = best.settle()
    return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[q]), pa.array(key), pa.array(score)], [query, doc, "score"])


_KEYWORD = re.compile(r"[A-Za-z][A-Za-z0-9_\-]+")


def term_counts(texts: list[str | None], number: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of the terms that ``number`` gives a number from 0, and the length in terms of every text."""
    rows, terms, lengths = [], [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = _KEYWORD.findall(text or "")
        lengths[k] = len(found)
        ids = np.fromiter(map(number, " ".join(found).lower().split(" ") if found else ()), np.int64, len(found))
        ids = ids[ids >= 0]
        terms.append(ids)
        rows.append(np.full(len(ids), k, np.int64))
    row, term = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, terms))
    width = int(term.max()) + 1 if len(term) else 1
    keys, tf = np.unique(row * width + term, return_counts=True)
    return keys // width, keys % width, tf, lengths


_BYTES = [chr(c) for c in range(128)] + [""] * 128
_LETTER = np.array([c.isalpha() for c in _BYTES])
_INNER = np.array([c.isalnum() or c in ("_", "-") for c in _BYTES])
_LOWER = np.array([ord(c.lower()) if c else k for k, c in enumerate(_BYTES)], np.uint8)


def _spans(inner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of marked places begin and end; a run ends where a text does (``at``: begins of texts, and the end)."""
    cut = np.zeros(len(inner) + 1, bool)
    cut[at] = True
    left, right = np.append(False, inner[:-1]), np.append(inner[1:], False)
    return np.flatnonzero(inner & (~left | cut[:-1])), np.flatnonzero(inner & (~right | cut[1:])) + 1


def _distinct(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.DictionaryArray:
    """Spans of bytes as numbers of distinct ones."""
    turn = np.zeros(len(data) + 1, np.int8)
    turn[begin] = 1
    turn[end] -= 1
    ends = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    held = data[np.cumsum(turn[:-1], dtype=np.int8).astype(bool)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(held))]).dictionary_encode()


def term_columns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, term, tf) of all terms, the length in terms of every text, and the terms: ``term_counts`` over a column's bytes.

    Of a run of letters, digits, underscores and hyphens the term is what begins with its first letter, if that is not its last sign.
    """
    column = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    begin, end = _spans(_INNER[data], at)
    other = np.flatnonzero(~_LETTER[data[begin]])  # begin with a digit or sign
    if len(other):
        letters = np.append(np.flatnonzero(_LETTER[data]), len(data))
        begin[other] = letters[np.searchsorted(letters, begin[other])]
    good = end - begin >= 2
    begin, end = begin[good], end[good]
    lengths = np.diff(np.searchsorted(begin, at))
    found = _distinct(_LOWER[data], begin, end)
    width = max(1, len(found.dictionary))
    keys, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * width + found.indices.to_numpy(), return_counts=True)
    return keys // width, keys % width, tf, lengths, found.dictionary


def weights(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """What a term adds for its frequency in a document, before its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9))) + DELTA


class Asked:
    """Terms of queries as numbers, and for each term the queries that hold it."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = sorted({q for q, _ in rows})
        place = {q: k for k, q in enumerate(self.ids)}
        self.terms = sorted({t for _, t in rows})
        self.number = {t: k for k, t in enumerate(self.terms)}
        pairs = np.array(sorted((self.number[t], place[q]) for q, t in set(rows)), np.int64).reshape(-1, 2)
        self.start, self.query = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1)), pairs[:, 1]

    def scores(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, docs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, doc, score), some documents at a time, of the summed weights of each query's terms. doc ascends."""
        met = np.concatenate([[0], np.cumsum(self.start[term + 1] - self.start[term])])  # of all rows before each: queries that hold their terms
        before = met[np.searchsorted(doc, np.arange(docs + 1))]
        most = max(1, CELLS // max(1, len(self.ids)))
        low = 0
        while low < docs:
            step = min(max(1, int(np.searchsorted(before, before[low] + CELLS, "right")) - 1 - low), most, docs - low)
            a, b = np.searchsorted(doc, [low, low + step])
            d, t, w = doc[a:b] - low, term[a:b], weight[a:b]
            n = self.start[t + 1] - self.start[t]
            first = np.repeat(self.start[t] - (np.cumsum(n) - n), n)
            q = self.query[first + np.arange(n.sum())]
            total = np.bincount(q * step + np.repeat(d, n), np.repeat(w, n), len(self.ids) * step)
            hit = np.flatnonzero(total > 0)
            yield hit // step, hit % step + low, total[hit]
            low += step


def asked_terms(queries: DataFrame, query: str) -> Asked | None:
    """The distinct terms of ``queries``, or None where there are more than can be sent to every task."""
    terms = queries.select(F.col(query).cast("long").alias("q"), F.explode(F.array_distinct(keyword_tokens(F.col("text")))).alias("t"))
    rows = terms.limit(SEND_TERMS + 1).collect()
    return Asked([(r.q, r.t) for r in rows]) if len(rows) <= SEND_TERMS else None


def idf(docs: float, df):
    return np.log((docs - df + 0.5) / (df + 0.5) + 1)


def bm25(queries: DataFrame, docs: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """query, doc, score (6 places), rank: BM25+ over distinct query terms; only scores above 0, ranked before rounding.

    Query terms go to every task: one look at the texts counts their documents, a second one scores each text against
    all queries and keeps a task's k best of each, so no term is a key of a shuffle. Ids are whole numbers.
    """
    asked = asked_terms(queries, query)
    if asked is None:
        return _bm25_by_joins(queries, docs, k, query, doc)
    texts, n = docs.select(F.col(doc).cast("long").alias("_d"), "text"), len(asked.terms)
    number = asked.number

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, length = np.zeros(n, np.int64), 0, 0
        for b in batches:
            for part in slices(b, 1):
                _, term, _, lengths = term_counts(part.column(1).to_pylist(), lambda t: number.get(t, -1))
                df += np.bincount(term, minlength=n)[:n]
                rows, length = rows + len(lengths), length + int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *np.flatnonzero(df)], pa.int64()), pa.array([length, rows, *df[df > 0]], pa.int64())], ["term", "n"])

    sums = {r.term: r.n for r in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    mean, worth = sums.get(-2, 0) / max(sums.get(-1, 0), 1), np.array([idf(sums.get(-1, 0), sums.get(t, 0)) for t in range(n)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(asked.ids), k)
        for b in batches:
            for part in slices(b, 1):
                keys = part.column(0).to_numpy(zero_copy_only=False)
                row, term, tf, lengths = term_counts(part.column(1).to_pylist(), lambda t: number.get(t, -1))
                for q, d, s in asked.scores(row, term, worth[term] * weights(tf, lengths[row], mean), len(keys)):
                    best.add(q, s, keys[d])
        yield _best_rows(asked.ids, best, query, doc)

    hits = texts.filter("_d is not null").mapInArrow(score, f"{query} long, {doc} long, score double")
    return ranked(hits, query, k, F.desc("score"), F.col(doc)).withColumn("score", F.round("score", 6))


def _bm25_by_joins(queries: DataFrame, docs: DataFrame, k: int, query: str, doc: str) -> DataFrame:
    """The same by joins on terms, for more query terms than can be sent."""
    terms = queries.select(F.col(query).alias("_q"), F.explode(F.array_distinct(keyword_tokens(F.col("text")))).alias("term"))
    tokens = docs.select(F.col(doc).alias("_d"), keyword_tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    n = tokens.agg(F.count("*").alias("docs"), F.avg("len").alias("mean_len"))
    post = tokens.select("_d", "len", F.explode("t").alias("term")).join(terms.select("term").distinct(), "term").groupBy("_d", "len", "term").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    worth = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest("mean_len", F.lit(1e-9)))) + DELTA
    # one row of totals
    weight = post.join(df, "term").crossJoin(F.broadcast(n)).select("_d", "term", (worth * tf).alias("w"))
    scored = terms.join(weight, "term").groupBy("_q", "_d").agg(F.round(F.sum("w"), PLACES).alias("score")).filter("score > 0")
    return ranked(scored, "_q", k, F.desc("score"), F.col("_d")).withColumn("score", F.round("score", 6)).withColumnsRenamed({"_q": query, "_d": doc})


def hash_embedding(rows: DataFrame, key: str, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Sparse unit vectors (key, bucket, weight) of word counts by hashed bucket."""
    every = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    terms = rows.select(key, F.explode(every).alias("term"))
    bucket = (F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")
    counts = terms.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))


class _Buckets(dict):
    """The hash bucket of each word; about ``keep`` words are remembered."""

    def __init__(self, buckets: int, keep: int = 100_000):
        self.buckets, self.keep = buckets, keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        self[word] = n = int.from_bytes(hashlib.md5(word).digest()[:4], "big") % self.buckets
        return n


@cache
def _word_signs() -> np.ndarray:
    """Of every code point, whether ``\\w`` takes it."""
    return np.array([c.isalnum() or c == "_" for c in map(chr, range(0x110000))])


def hash_vectors(texts: list[str | None], known: _Buckets) -> np.ndarray:
    """Unit vectors of word counts by hashed bucket; zeros for texts without words."""
    lower = [(t or "").lower() for t in texts]
    at = np.cumsum([0, *map(len, lower)])
    every = "".join(lower)
    data = np.frombuffer(every.encode("utf-8", "surrogatepass"), np.uint8)
    signs = data if every.isascii() else np.frombuffer(every.encode("utf-32-le", "surrogatepass"), np.uint32)
    begin, end = _spans(_word_signs()[signs], at)
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, at)))
    if signs is not data:  # places of bytes for places of code points
        place = np.concatenate([[0], np.cumsum(1 + (signs > 0x7F).astype(np.int8) + (signs > 0x7FF) + (signs > 0xFFFF))])
        begin, end = place[begin], place[end]
    found = _distinct(data, begin, end)
    bucket = np.fromiter(map(known.__getitem__, found.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(found.dictionary))
    out = np.bincount(row * known.buckets + bucket[found.indices.to_numpy()], minlength=len(texts) * known.buckets).reshape(len(texts), known.buckets).astype(float)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)


class HashEmbedder:
    """Texts as unit vectors of word counts by hashed bucket. Any object with ``dimension`` and ``embed`` can stand in."""

    def __init__(self, dimension: int = BUCKETS):
        self.dimension, self._known = dimension, _Buckets(dimension)

    def embed(self, texts: list[str]) -> np.ndarray:
        return hash_vectors(texts, self._known)


#: Texts that an embedder gets at a time at most.
EMBED_BATCH = 100


def guarded(embedder, texts: list[str | None], batch: int = EMBED_BATCH) -> list[np.ndarray | None]:
    """A vector of each text; none for the texts of a batch that fails or gives another number of vectors, or another
    dimension, and for vectors that are not finite."""
    out: list[np.ndarray | None] = []
    for at in range(0, len(texts), batch):
        part = [t or "" for t in texts[at : at + batch]]
        try:
            v = np.asarray(embedder.embed(part), float)
        except Exception:  # whatever a provider raises fails its batch only
            v = np.zeros((0, 0))
        if v.shape == (len(part), embedder.dimension):
            out += [x if np.isfinite(x).all() else None for x in v]
        else:
            out += [None] * len(part)
    return out


def embedded(rows: DataFrame, key: str, text: str = "text", buckets: int = BUCKETS, embedder=None) -> DataFrame:
    """key (as a whole number) and ``embedding``: by ``embedder``, null where it fails, else the dense form of ``hash_embedding``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for b in batches:
            for part in slices(b, 1):
                keys, texts = part.column(0), part.column(1).to_pylist()
                if embedder is None:
                    v = hash_vectors(texts, known)
                    vectors = pa.ListArray.from_arrays(np.arange(0, v.size + 1, buckets, dtype=np.int32), v.ravel())
                else:
                    vectors = pa.array([None if x is None else x.tolist() for x in guarded(embedder, texts)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([keys, vectors], [key, "embedding"])

    return rows.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, embedding array<double>")


class _Near:
    """The k unit vectors with the largest products above 0 of each query of a matrix, of all that are added."""

    def __init__(self, matrix: np.ndarray, k: int):
        self.matrix, self.best, self.step = matrix, Best(len(matrix), k), max(1, CELLS // max(1, len(matrix)))

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(keys), self.step):
            score = self.matrix @ vectors[at : at + self.step].T
            q, d = np.nonzero(score >= self.best.enough()[:, None])
            self.best.add(q, score[q, d], keys[at : at + self.step][d])


def _few(queries: DataFrame, query: str) -> tuple[list[int], np.ndarray] | None:
    """Ids and matrix of queries with vectors, or None where there are more than can be sent."""
    few = queries.select(F.col(query).cast("long").alias("q"), "embedding").limit(SEND_QUERIES + 1).collect()
    return ([r.q for r in few], np.array([r.embedding for r in few], float).reshape(len(few), -1)) if len(few) <= SEND_QUERIES else None


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, query: str, doc: str) -> DataFrame:
    """query, doc, score (6 places), rank of the k unit vectors ``embedding`` with the largest products above 0.

    Queries go to every task as one matrix; a task's vectors meet it in dense blocks and only its k best of each query
    leave it. More queries than can be sent meet the vectors block by block.
    """
    sent = _few(queries, query)
    return _far_top_k(queries, vectors, k, query, doc) if sent is None else _near_top_k(*sent, vectors, k, query, doc)


def _far_top_k(queries: DataFrame, vectors: DataFrame, k: int, query: str, doc: str) -> DataFrame:
    names = {"query_id": query, "vec_id": doc}
    both = [df.select(F.col(c).cast("long").alias("vec_id"), "embedding") for df, c in ((queries, query), (vectors, doc))]
    return dense_top_k(*both, k, "dot", others=False).filter("score > 0").withColumnsRenamed(names)


def _near_top_k(ids: list[int], matrix: np.ndarray, rows: DataFrame, k: int, query: str, doc: str, hashed: bool = False) -> DataFrame:
    """``vector_top_k`` of ``rows``' vectors or, ``hashed``, of the vectors of their texts, which then never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, known = _Near(matrix, k), _Buckets(BUCKETS)
        for b in batches:
            for part in slices(b, 1) if hashed else [b] if b.num_rows else []:
                keys = part.column(0).to_numpy(zero_copy_only=False)
                near.add(keys, hash_vectors(part.column(1).to_pylist(), known) if hashed else part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1))
        yield _best_rows(ids, near.best, query, doc)

    rows = rows.select(F.col(doc).cast("long").alias(doc), "text" if hashed else "embedding").filter(F.col(doc).isNotNull())
    hits = rows.mapInArrow(run, f"{query} long, {doc} long, score double")
    return ranked(hits, query, k, F.desc("score"), F.col(doc)).withColumn("score", F.round("score", 6))


def hash_top_k(queries: DataFrame, docs: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """The k documents whose hashed word counts have the largest cosine with a query's."""
    asked = embedded(queries, query)
    sent = _few(asked, query)
    return _far_top_k(asked, embedded(docs, doc), k, query, doc) if sent is None else _near_top_k(*sent, docs, k, query, doc, hashed=True)


def _similarity(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return a @ b.T
    if metric == "euclidean":
        far = np.sqrt(np.maximum(((a[:, None] - b[None]) ** 2).sum(2), 0)) if len(a) * len(b) * a.shape[1] < 4_000_000 else np.stack([np.sqrt(((x - b) ** 2).sum(1)) for x in a])
        return 1 / (1 + far)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    return np.divide(a @ b.T, na[:, None] * nb[None], out=np.zeros((len(a), len(b))), where=(na[:, None] * nb[None]) > 0)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", others: bool = True, block: int = 4096) -> DataFrame:
    """query_id, vec_id, score (6 places), rank of the k most similar vectors.

    Both: vec_id, embedding. Rows go to blocks of bounded size by a hash; each block of queries meets each block of
    vectors once, and k hits a query leave it. An unknown metric counts as cosine; ``others`` leaves out a query itself.
    """
    both = []
    for df, name in ((queries, "q"), (vectors, "v")):
        n = max(1, -(-df.count() // block))
        rows = df.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(f"{name}b")).groupBy(f"{name}b").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("r"))
        both.append((rows.select(f"{name}b", F.col("r.vec_id").alias(f"{name}_ids"), F.col("r.embedding").alias(f"{name}_vecs")), n))
    (q, _), (v, n) = both
    pairs = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(v, "vb").select("q_ids", "q_vecs", "v_ids", "v_vecs")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for qi, qv, vi, vv in f.itertuples(index=False):
                vi, b = np.asarray(vi), np.array([np.asarray(x, float) for x in vv])
                out = []
                for s in range(0, len(qi), 256):
                    score = np.round(_similarity(np.array([np.asarray(x, float) for x in qv[s : s + 256]]), b, metric), 6)
                    for own, row in zip(qi[s : s + 256], score, strict=True):
                        order = np.lexsort((vi, -row))[: k + 1]
                        out += [(own, vi[j], row[j]) for j in order if not (others and vi[j] == own)][:k]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    hits = pairs.mapInPandas(run, "query_id long, vec_id long, score double")
    return ranked(hits, "query_id", k, F.desc("score"), F.col("vec_id"))


def exact_matches(queries: DataFrame, docs: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, doc) where the document holds the query's text in any case; empty queries match nothing."""
    asked = queries.select(F.col(query), F.lower("text").alias("needle"))
    return needles.find(asked, docs, [doc]).join(asked, "needle").select(query, doc)


def hybrid(hits: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """0.8 of the similarity and 0.2 of the share of query words in the text. hits: query, score, rank, query_text, text."""
    a, b = words(F.col("query_text")), words(F.col("text"))
    share = F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    hits = hits.withColumnRenamed("rank", "first_rank").withColumn("hybrid", F.round(HYBRID[0] * F.col("score") + HYBRID[1] * share, PLACES))
    return ranked(hits, query, k, F.desc("hybrid"), F.col("first_rank")).withColumn("hybrid", F.round("hybrid", 6))


def fused(paths: dict[str, DataFrame], query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of rankings (query, doc, rank, score): fused, sources, and each path's score."""
    every = None
    for k, (name, df) in enumerate(paths.items()):
        one = df.select(query, doc, F.lit(k).alias("_p"), F.lit(name).alias("_n"), "rank", F.col("score").cast("double").alias("_s"))
        every = one if every is None else every.unionByName(one)
    out = every.groupBy(query, doc).agg(
        F.round(F.sum(1.0 / (F.lit(RRF) + F.col("rank"))), 6).alias("fused"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("_p", "_n"))), lambda s: s["_n"]), "+").alias("sources"),
        F.count("*").alias("paths"), F.min(F.struct("_p", "rank")).alias("first"),
        *[F.max(F.when(F.col("_n") == n, F.col("_s"))).alias(f"{n}_score") for n in paths],
    )
    return out


def base_score(dense: Column, bm25: Column) -> Column:
    """The dense score; else a squashed BM25 score; else one half."""
    return F.coalesce(dense, 1 / (1 + F.exp(-bm25 / 5)), F.lit(0.5))


def coverage_boost(score: Column, title: Column, query: Column) -> Column:
    return covered(score, F.array_distinct(title_tokens(title)), F.array_distinct(title_tokens(query)))


def covered(score: Column, t: Column, q: Column) -> Column:
    """``coverage_boost`` from the distinct words of title and query; null words of a title count as none."""
    n = F.size(F.array_intersect(t, q))
    return F.when(n > 0, F.least(F.lit(0.99), F.round(score + 0.15 * n / F.size(t) + 0.05 * n / F.size(q), 4))).otherwise(score)


def evidence_boost(score: Column, text: Column, title: Column, paths: Column, exact_meta: Column, id_in_text: Column) -> Column:
    tokens = title_tokens(title)
    return boosted(score, F.lower(F.coalesce(text, F.lit(""))), tokens, bigrams(tokens), paths, exact_meta, id_in_text)


def boosted(score: Column, low: Column, tokens: Column, pairs: Column, paths: Column, exact_meta: Column, id_in_text: Column) -> Column:
    """``evidence_boost`` from the text in lower case and the title's words and pairs of words."""
    return raised(score, boost(held(low, tokens), held(low, pairs), F.size(tokens), paths, exact_meta, id_in_text))


def held(low: Column, words: Column) -> Column:
    """How many of ``words`` a text holds."""
    return F.size(F.filter(words, lambda t: low.contains(t)))


def boost(m: Column, both: Column, tokens: Column, paths: Column, exact_meta: Column, id_in_text: Column) -> Column:
    """What ``boosted`` adds, from how many words (of ``tokens``) and pairs of words of the title a text holds."""
    out = F.when(exact_meta, 0.30).when(id_in_text, 0.15).otherwise(0.0)
    out = out + F.when(tokens > 0, F.least(F.lit(4), m) * 0.04 + 0.08 * m / tokens).otherwise(0.0)
    return out + F.least(F.lit(3), both) * 0.06 + F.when(paths >= 3, 0.05).when(paths == 2, 0.02).otherwise(0.0)


def raised(score: Column, by: Column) -> Column:
    return F.when(by == 0, score).otherwise(F.least(F.lit(0.99), F.round(score + by, 4)))


def best_of(hits: DataFrame, by: str, group: Column, *order: Column) -> DataFrame:
    """The best hit of each group of a query; hits without a group all stay."""
    key = F.when(group.isNull() | (F.trim(group) == ""), F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))).otherwise(F.upper(F.trim(group)))
    return hits.withColumn("_g", key).withColumn("_r", F.row_number().over(Window.partitionBy(by, "_g").orderBy(*order))).filter("_r = 1").drop("_r", "_g")


def agreement(paths: Column) -> Column:
    return F.when(paths >= 3, "full").when(paths == 2, "partial").when(paths == 1, "single").otherwise("none")


def title_overlap(title: Column, text: Column) -> Column:
    return contained(title_tokens(title), text)


def proximity(text: Column, needle: Column, fail: str, good: str, around: int = VERDICT_WINDOW) -> tuple[Column, Column]:
    """Verdict near the first occurrence of ``needle``, else of the whole text, and which of the two it is."""
    at = F.position(F.lower(needle), F.lower(text))
    low = F.greatest(F.lit(1), at - around)
    near = F.when(at > 0, F.substring(text, low, at + F.length(needle) + around - low))
    close = F.when(near.rlike(fail), "FAIL").when(near.rlike(good), "PASS")
    whole = F.when(text.rlike(fail), "FAIL").when(text.rlike(good), "PASS").otherwise("UNKNOWN")
    return F.coalesce(close, whole), F.when(close.isNotNull(), "proximity").otherwise("full_text")
