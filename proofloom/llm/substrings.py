"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words. Its minimiser is the smallest hash among its runs of ``core`` words, so equal
windows have equal minimisers. Consecutive windows of a document that share one travel to its bucket as one packed
string (a super-k-mer), where windows are sorted and compared byte by byte, and the smallest doc_id of each is found.

Three things keep buckets small. A first pass counts, over the whole corpus, in how many documents each minimiser
occurs: windows of a minimiser that one document has cannot repeat elsewhere and stay where they are (a bitmap carries
that, sized by how many there are; what it lets through in excess only costs time). What repeats inside one chunk of
documents is settled there: only the first occurrence in the smallest document travels. And a minimiser that many
documents have is split: its windows go each to a bucket of their own, first to one of ``SALTS`` parts of it, whose
smallest document alone goes on to the bucket itself. So no bucket grows with the corpus, whatever repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, drop_cut, frugal, tidied, whole_row
from .textops import Words, chunks, mix, rolling

WIDTH = 13
CORE = 5
#: Bits of a map of minimisers at most (16 MB); a map has 32 bits or more for each while it is smaller. A full map costs time only.
MAP_BITS = 27
#: Documents that share a minimiser beyond which its windows are split, and the parts of a split window's bucket.
HOT = 200
SALTS = 32
#: bucket: where a row goes first; home: its window's bucket, if that is split; packed is null in runs that are settled.
_TRAVEL = "bucket long, home long, doc_id long, tid long, start int, n int, packed binary"


class Canon:
    """The words of a chunk, one space between them, and the windows of its documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        w = Words(data, offsets)
        size = w.ends - w.starts
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        total = int(self.ends[-1] + 1) if len(size) else 0
        self.data = np.full(total, 32, np.uint8)
        at = np.arange(total) - np.repeat(self.starts, size + 1)
        word = at < np.repeat(size, size + 1)
        self.data[word] = data[(at + np.repeat(w.starts, size + 1))[word]]
        self.hashes, self.doc, self.first = w.hashes(), w.doc, w.first
        n = max(0, len(size) - width + 1)
        self.at = np.flatnonzero(w.doc[:n] == w.doc[width - 1 : width - 1 + n]) if n else np.zeros(0, np.int64)  # first word of each window
        self.width = width

    def windows(self) -> np.ndarray:
        """64 bits of each window."""
        return rolling(self.hashes, self.width)[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def minimisers(self, core: int) -> np.ndarray:
        """Each window's smallest hash of ``core`` words."""
        h = rolling(self.hashes, core)
        span = self.width - core + 1
        if len(h) < span:
            return np.zeros(0, np.uint64)
        low, have = h, 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        return low[self.at]


def same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A group number for each slice of ``data``; slices of one group, and only those, are equal byte by byte."""
    n = len(hashes)
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.ones(n, bool)
    new[1:] = h[1:] != h[:-1]
    size = ends - starts
    pairs = np.flatnonzero(~new)
    wrong = [pairs[size[order[pairs]] != size[order[pairs - 1]]]]
    pairs = pairs[size[order[pairs]] == size[order[pairs - 1]]]
    for k in range(0, len(pairs), 50_000):
        p = pairs[k : k + 50_000]
        a, b, m = starts[order[p]], starts[order[p - 1]], size[order[p]]
        edge = np.cumsum(m)
        inner = np.arange(edge[-1]) - np.repeat(edge - m, m)
        differ = data[inner + np.repeat(a, m)] != data[inner + np.repeat(b, m)]
        if differ.any():
            wrong.append(p[np.add.reduceat(differ, edge - m) > 0])
    group = np.cumsum(new) - 1
    wrong = np.concatenate(wrong)
    if len(wrong):  # hashes that collide: by their bytes
        top = int(group[-1]) + 1
        for g in np.unique(group[wrong]):
            known: dict[bytes, int] = {}
            for k in np.flatnonzero(group == g):
                group[k] = known.setdefault(data[starts[order[k]] : ends[order[k]]].tobytes(), top + len(known))
            top += len(known)
    out = np.empty(n, np.int64)
    out[order] = group
    return out


def _spans(doc: np.ndarray, tid: np.ndarray, row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive windows of one row as (doc_id, tid, start, n)."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    k = np.flatnonzero(new)
    n = np.diff(np.r_[k, len(row)])
    return pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(tid[k]), pa.array(place[k].astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "tid", "start", "n"])


def _lowest(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest doc_id in each slice's group."""
    low = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(low, group, doc)
    return low[group]


def counted(docs: DataFrame, width: int, core: int) -> DataFrame:
    """(h, n): in how many documents each minimiser occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch):
                c = Canon(data, offsets, width)
                m, doc = c.minimisers(core), c.doc[c.at]
                order = np.lexsort((doc, m))
                m, doc = m[order], doc[order]
                fresh = np.ones(len(m), bool)
                fresh[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
                h, n = np.unique(m[fresh], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(tidied(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Members:
    """A set of hashes as a bitmap; may hold more than was put in."""

    def __init__(self, hashes: DataFrame):
        """hashes: h, without repeats. At most 2 ** (MAP_BITS - 6) rows reach the driver."""
        self.bits = max(12, min(MAP_BITS, (32 * hashes.count()).bit_length()))
        bit = F.col("h").bitwiseAND((1 << self.bits) - 1)
        words = hashes.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("x")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[words.column("w").to_numpy()] = words.column("x").to_numpy().astype(np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        bit = h & np.uint64((1 << self.bits) - 1)
        return ((self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def travelling(docs: DataFrame, width: int, core: int, repeated: Members, hot: Members) -> DataFrame:
    """Super-k-mers to compare (with ``packed``), and runs of windows that their own chunk settles (without).

    A run of no windows tells that a document repeats a window itself, of which only the first travels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch):
                ids, tids = (batch.column(k).slice(first, last - first).to_numpy(zero_copy_only=False) for k in ("doc_id", "tid"))
                c = Canon(data, offsets, width)
                m, h = c.minimisers(core), c.windows()
                some = np.flatnonzero(repeated.has(m))
                if not len(some):
                    continue
                at, m, h = c.at[some], m[some], h[some]
                row, place = c.doc[at], at - c.first[c.doc[at]]
                doc, tid = ids[row], tids[row]
                group = same(c.data, c.starts[at], c.ends[at + width - 1], h)
                gone = doc > _lowest(group, doc)
                # of windows that one document repeats, the first speaks for all
                order = np.lexsort((at, row, group))
                again = np.zeros(len(at), bool)
                again[order[1:]] = (group[order[1:]] == group[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
                again &= ~gone
                told = np.unique(row[again], return_index=True)[1]
                settled = [_spans(doc[gone], tid[gone], row[gone], place[gone])] if gone.any() else []
                if len(told):
                    zeros = pa.array(np.zeros(len(told), np.int32))
                    settled.append(pa.RecordBatch.from_arrays([pa.array(doc[again][told]), pa.array(tid[again][told]), zeros, zeros], ["doc_id", "tid", "start", "n"]))
                for b in settled:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.nulls(len(b), pa.int64()), *b.columns, pa.nulls(len(b), pa.binary())], ["bucket", "home", *b.schema.names, "packed"])
                keep = ~gone & ~again
                at, m, h, row, place, doc, tid = (x[keep] for x in (at, m, h, row, place, doc, tid))
                if not len(at):
                    continue
                split = hot.has(m)
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (m[1:] != m[:-1]) | split[1:] | (row[1:] != row[:-1])
                k = np.flatnonzero(new)
                n = np.diff(np.r_[k, len(at)])
                home = h[k].astype(np.int64)
                with np.errstate(over="ignore"):
                    salt = np.uint64(int(doc.min()) % SALTS) * np.uint64(0x9E3779B97F4A7C15)
                    bucket = np.where(split[k], mix(h[k] + salt), m[k]).astype(np.int64)
                lo, hi = c.starts[at[k]], c.ends[at[k] + n + width - 2]
                size = hi - lo
                edge = np.cumsum(size)
                packed = c.data[np.arange(edge[-1]) - np.repeat(edge - size - lo, size)]
                for a in range(0, len(k), 20_000):
                    z = min(len(k), a + 20_000)
                    base = edge[a] - size[a]
                    binary = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(np.r_[0, edge[a:z] - base].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(packed[base : edge[z - 1]]))])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[a:z]), pa.array(home[a:z], mask=~split[k[a:z]]), pa.array(doc[k[a:z]]), pa.array(tid[k[a:z]]), pa.array(place[k[a:z]].astype(np.int32)), pa.array(n[a:z].astype(np.int32)), binary], ["bucket", "home", "doc_id", "tid", "start", "n", "packed"])

    return docs.select("doc_id", "tid", "text").mapInArrow(tidied(run), _TRAVEL)


def _settle(table: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows, of those in the buckets of ``table``, that a smaller document has too, and what goes on.

    Of a split window the rows of its smallest document go on to its home.
    """
    for batch in table.combine_chunks().to_batches():
        col = batch.column("packed").cast(pa.large_binary())
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        c = Canon(data, offsets - offsets[0], width)
        row, place = c.doc[c.at], c.at - c.first[c.doc[c.at]]
        ids, tids, start = (batch.column(k).to_numpy() for k in ("doc_id", "tid", "start"))
        doc = ids[row]
        gone = doc > _lowest(same(c.data, c.starts[c.at], c.ends[c.at + width - 1], c.windows()), doc)
        if gone.any():
            b = _spans(doc[gone], tids[row[gone]], row[gone], start[row[gone]] + place[gone])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.nulls(len(b), pa.int64()), *b.columns, pa.nulls(len(b), pa.binary())], ["bucket", "home", *b.schema.names, "packed"])
        split = batch.column("home").is_valid().to_numpy(zero_copy_only=False)
        if split.any():  # one window a row
            left = np.zeros(len(batch), bool)
            left[row[~gone]] = True
            on = batch.filter(pa.array(left & split))
            yield on.set_column(0, "bucket", on.column("home")).set_column(1, "home", pa.nulls(len(on), pa.int64()))


def _compared(moved: DataFrame, width: int, limit: int) -> DataFrame:
    """The buckets of ``moved``, each settled in the task that it went to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, goal = [], 0, limit
        for batch in batches:
            flags = batch.filter(batch.column("packed").is_null())
            if len(flags):
                yield flags
            batch = batch.filter(batch.column("packed").is_valid())
            if not len(batch):
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= goal:  # up to the last bucket that has surely ended
                whole = pa.Table.from_batches(held)
                bucket = whole.column("bucket").to_numpy()
                k = int(np.searchsorted(bucket, bucket[-1]))
                if k:
                    yield from _settle(whole.slice(0, k), width)
                    held = whole.slice(k).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
                goal = max(limit, 2 * size)
        if held:
            yield from _settle(pa.Table.from_batches(held), width)

    parts = int(moved.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return moved.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidied(run), _TRAVEL)


def repeats(docs: DataFrame, width: int = WIDTH, core: int = CORE, limit: int = 1 << 20) -> DataFrame:
    """(doc_id, tid, start, n): runs of n windows, from word ``start``, that also start in a document of smaller id.

    n is 0 once for a document (doc_id, tid) that repeats a window itself: of such windows only the first is listed.
    """
    docs = docs.filter("doc_id is not null")
    counts = cut(counted(docs, width, core).filter("n > 1"), "substring-counts")
    repeated, hot = Members(counts.select("h")), Members(counts.filter(F.col("n") > HOT).select("h"))
    drop_cut(counts)
    once = cut(_compared(travelling(docs, width, core, repeated, hot), width, limit), "substring-once")
    spans = ["doc_id", "tid", "start", "n"]
    twice = _compared(once.filter("packed is not null"), width, limit).filter("packed is null").select(*spans)
    out = cut(once.filter("packed is null").select(*spans).unionByName(twice), "substring-spans")
    drop_cut(once)
    return out


def _runs_left(starts: set[int], width: int) -> list[tuple[int, int]]:
    """(first word from 1, words) of what stays when windows at ``starts`` go; the last run is open."""
    edges = np.sort(np.fromiter(starts, np.int64, len(starts)))
    new = np.flatnonzero(np.r_[True, np.diff(edges) > width])  # windows that overlap or touch go as one
    low, high = edges[new], edges[np.r_[new[1:] - 1, len(edges) - 1]] + width
    begins, ends = np.r_[0, high], np.r_[low, np.iinfo(np.int32).max - 1]
    return [(int(x) + 1, int(y - x)) for x, y in zip(begins, ends, strict=True) if y > x]


def _stays(rows: DataFrame, width: int) -> DataFrame:
    """(of, of_tid, stays): the runs of words that stay of each document with spans to remove.

    Where a row has a text, its text repeats a window: where one goes, all like it go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
                starts = {k for s in spans.as_py() for k in range(s["start"], s["start"] + s["n"])}
                if text.is_valid:
                    words = text.as_py().encode("utf-8", "surrogatepass").split()
                    gone = {tuple(words[k : k + width]) for k in starts}
                    starts = {k for k in range(len(words) - width + 1) if tuple(words[k : k + width]) in gone}
                out.append([{"start": a, "n": n} for a, n in _runs_left(starts, width)])
            yield pa.RecordBatch.from_arrays([b.column("of"), b.column("of_tid"), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))], ["of", "of_tid", "stays"])

    return rows.select("of", "of_tid", "text", "spans").mapInArrow(tidied(run), "of long, of_tid long, stays array<struct<start: int, n: int>>")


def _with_words(docs: DataFrame, carried: "F.Column", width: int, core: int) -> DataFrame:
    """doc_id, text, carried, words (of texts that lose some, else null) and kept, those of them that stay.

    The join moves the texts at any size, so that a plan is the same for a small corpus and a large one.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tid"), carried.alias("carried"))
    of = lambda other: (F.col("doc_id") == other["of"]) & (F.col("tid") == other["of_tid"])
    with frugal(docs.sparkSession):
        found = repeats(keyed.select("doc_id", "text", "tid"), width, core)
        spans = found.groupBy(F.col("doc_id").alias("of"), F.col("tid").alias("of_tid")).agg(F.collect_list(F.struct("start", "n")).alias("spans"), (F.min("n") == 0).alias("own"))
        spans = cut(spans.filter(F.exists("spans", lambda s: s["n"] > 0)), "substring-removed")
        drop_cut(found)
        own = spans.filter("own")
        # only texts that repeat a window themselves; rows of equal id and text are one
        texts = keyed.select("doc_id", "tid", "text").join(own, of(own)).dropDuplicates(["doc_id", "tid"])
        stays = cut(_stays(spans.filter("not own").withColumn("text", F.lit(None).cast("string")), width).unionByName(_stays(texts, width)), "substring-stays")
    drop_cut(spans)
    met = keyed.hint("merge").join(stays, of(stays), "left").withColumn("words", F.when(F.col("stays").isNotNull(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    return met.select("doc_id", "text", "carried", "words", F.flatten(F.transform("stays", lambda r: F.slice("words", r["start"], r["n"]))).alias("kept"))


def rewrite(docs: DataFrame, width: int = WIDTH, core: int = CORE, emptied: bool = True) -> DataFrame:
    """The rows with all their columns; texts that lose words hold what is left, one space between, others are as before.

    emptied: whether rows that lose all their words stay, with an empty text. Columns may have any names; null texts
    and ids, repeated rows, ties, very long texts and empty tables are as in ``dedup``.
    """
    met = _with_words(docs, whole_row(docs), width, core)
    if not emptied:
        met = met.filter(F.coalesce(F.size("kept") > 0, F.lit(True)))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", " "))
    return met.select(*[(text if c == "text" else F.col("carried").getField(c)).alias(c) for c in docs.columns])


def dedup(docs: DataFrame, width: int = WIDTH, core: int = CORE, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the words left, one space between) of every document.

    Removes each word covered by a window of ``width`` words that also starts in a document with a smaller doc_id.
    Needs doc_id and text; other columns are ignored. Null and empty texts, and texts of fewer words than ``width``,
    lose nothing. Rows that repeat a doc_id are one document: they take nothing from each other. Rows without doc_id
    neither lose words nor make others lose any. Very long texts are read whole. An empty table gives no rows.
    """
    met = _with_words(docs, F.lit(None), width, core)
    words = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.coalesce("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    met = met.select("doc_id", words.alias("words"), F.col("kept").alias("left"))
    met = met.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.col("left").isNull(), 0).otherwise(F.size("words") - F.size("left")).cast("long").alias("n_removed"), F.array_join(F.coalesce("left", "words"), " ").alias("kept"))
    return met.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), *(["kept"] * with_text))
