"""Best-fit packing by a linear grouping scheme.

Texts become token ids, and ids become pieces of at most ``capacity`` tokens. The plan is made from the histogram of
piece lengths alone, which has at most ``capacity`` entries however many documents there are:

1. pieces above ``capacity / 8`` are cut, in order of length, into groups of equal cardinality, and each length is
   rounded up to the largest of its group: few sizes remain;
2. configurations of those few sizes are chosen one after the other: the largest size that is left, filled up as far
   as a bounded subset-sum table can, used as often as supplies last;
3. actual lengths take the place of rounded ones, which only widens the room left in a sequence;
4. small pieces, longest first, go to the sequences with the least room that holds them.

Sequences that look alike stay one entry with a count, so the plan's size depends on ``capacity`` too, not on the
number of documents. Pieces then find their sequence by their rank among the pieces of their length; ranks are counted
in hashed buckets, so one length that a third of all pieces have is not one task's work.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, frugal, tidied

CAPACITY = 4096
GROUPS = 64
BUCKETS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_loaded: dict = {}


class _Numbered(dict):
    """Gives every new chunk the next number."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


class ChunkEncoder:
    """Token ids of texts, chunk by chunk between ASCII white space, which the vocabulary's rules never join.

    Each distinct chunk is encoded once; about ``keep`` of them are remembered. New chunks go through the tokenizer
    many at a time. Chunks of Latin-1 letters are one word each, so tokens that close a word tell them apart; others
    have a special token between them; a chunk that holds a special token itself goes alone.
    """

    def __init__(self, path: str, keep: int = 120_000, joined: int = 512):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self.tokenizer, self.keep, self.joined = Tokenizer.from_file(path), keep, joined
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = next(iter(special.items()))
        self.special = re.compile("|".join(map(re.escape, special)))
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.index = _Numbered()
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _run(self, texts: list[str]) -> np.ndarray:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([*(np.array(e.ids, np.uint32) for e in got), np.zeros(0, np.uint32)])

    def _learn(self, new: list[str]) -> None:
        kind = np.fromiter((0 if w.isalpha() and (w.isascii() or max(w) < "\u0100") else 2 if "<" in w and self.special.search(w) else 1 for w in new), np.int8, len(new))
        counts, parts = np.zeros(len(new), np.int64), []
        for k, sep in ((0, " "), (1, self.mark)):
            at = np.flatnonzero(kind == k)
            some = [new[i] for i in at]
            ids = self._run([sep.join(some[i : i + self.joined]) + sep for i in range(0, len(some), self.joined)])
            ends = np.flatnonzero(self.closes[ids] if k == 0 else ids == self.mark_id)
            assert len(ends) == len(some)
            counts[at] = np.diff(ends, prepend=-1) - k
            parts.append(ids if k == 0 else ids[ids != self.mark_id])
        at = np.flatnonzero(kind == 2)
        alone = [self._run([new[i]]) for i in at]
        counts[at] = [len(x) for x in alone]
        parts.append(np.concatenate([*alone, np.zeros(0, np.uint32)]))
        # the parts hold the chunks kind by kind; here they return to the chunks' order
        order = np.argsort(kind, kind="stable")
        first = np.empty(len(new), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        ends = np.cumsum(counts)
        ids = np.concatenate(parts)[np.arange(ends[-1]) + np.repeat(first - ends + counts, counts)]
        self.ids, self.starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, self.starts[-1] + ends])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > self.keep:
            self._empty()
        known, chunks = len(self.index), []
        for t in texts:
            for c in "\t\n\r\x0b\x0c":
                t = t.replace(c, " ")
            if t.isascii() and "<" not in t:
                t = t.lower()  # as the vocabulary's rules do; fewer distinct chunks
            ws = t.split(" ")
            chunks.append(np.fromiter(map(self.index.__getitem__, ws), np.int64, len(ws)))
        if len(self.index) > known:
            self._learn(list(itertools.islice(self.index, known, None)))
        out = []
        for at in chunks:
            first, n = self.starts[at], self.starts[at + 1] - self.starts[at]
            ends = np.cumsum(n)
            out.append(self.ids[np.arange(ends[-1]) + np.repeat(first - ends + n, n)])
        return out


def _encoder(path: str) -> ChunkEncoder:
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document: its ids, ``end_id``, cut only beyond ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[tuple] = []
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    out += [(doc, k, s, len(p := ids[s : s + capacity]), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
                names = [x.split()[0] for x in PIECES.split(", ")]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), PIECES)


class _Alike:
    """``count`` sequences that hold pieces of the same lengths; items are (length, rank of the first, offset)."""

    __slots__ = ("count", "items", "room")

    def __init__(self, count: int, room: int, items: list):
        self.count, self.room, self.items = count, room, items

    def head(self, n: int) -> "_Alike":
        """Splits off the first n sequences."""
        first = _Alike(n, self.room, list(self.items))
        self.items = [(length, rank + n, offset) for length, rank, offset in self.items]
        self.count -= n
        return first


def _groups(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths, longest first, in groups of equal cardinality: each a list of [length, count]."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = each
            m = min(n, room)
            out[-1].append([length, m])
            n, room = n - m, room - m
    return out


def _fullest(sizes: list[int], left: list[int], first: int, capacity: int) -> list[int]:
    """Groups of one configuration: ``first`` and those that fill the rest as far as can be, each within its supply."""
    rest = capacity - sizes[first]
    via: list = [None] * (rest + 1)  # by filled length: (group, filled length before)
    via[0] = (-1, 0)
    for g, s in enumerate(sizes):
        have = left[g] - (g == first)
        if have <= 0 or s > rest:
            continue
        used = [0] * (rest + 1)
        for x in range(s, rest + 1):
            if via[x] is None and via[x - s] is not None and used[x - s] < have:
                via[x], used[x] = (g, x - s), used[x - s] + 1
    x = max(k for k in range(rest + 1) if via[k] is not None)
    out = [first]
    while x:
        g, x = via[x]
        out.append(g)
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[_Alike]:
    """The packing of so many pieces of each length."""
    rank = dict.fromkeys(counts, 0)
    done: list[_Alike] = []
    large = {n: c for n, c in counts.items() if n > capacity // 8}
    grouped = _groups(large, groups)
    sizes, left = [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped]

    def pull(g: int, n: int) -> list[tuple[int, int, int]]:
        """The next n pieces of a group, longest first: runs of (length, rank of the first, count)."""
        out = []
        while n:
            length, have = grouped[g][0]
            m = min(n, have)
            out.append((length, rank[length], m))
            rank[length] += m
            n -= m
            grouped[g][0][1] -= m
            if not grouped[g][0][1]:
                grouped[g].pop(0)
        return out

    while any(left):
        first = next(g for g, n in enumerate(left) if n)
        chosen = _fullest(sizes, left, first, capacity)
        times = min(left[g] // chosen.count(g) for g in set(chosen))
        runs = []
        for g in chosen:
            runs.append(pull(g, times))
            left[g] -= times
        while times:  # where a run of one length ends, another kind of sequence begins
            m = min(r[0][2] for r in runs)
            items, offset = [], 0
            for r in runs:
                length, at, n = r[0]
                items.append((length, at, offset))
                offset += length
                r[0] = (length, at + m, n - m)
                if n == m:
                    r.pop(0)
            done.append(_Alike(m, capacity - offset, items))
            times -= m
    rooms: dict[int, list[_Alike]] = {}
    for x in done:
        rooms.setdefault(x.room, []).append(x)
    known = sorted(rooms)
    full: list[_Alike] = []

    def put(x: _Alike) -> None:
        if x.room == 0:
            full.append(x)
        elif x.room in rooms and rooms[x.room]:
            rooms[x.room].append(x)
        else:
            if x.room not in rooms:
                bisect.insort(known, x.room)
            rooms[x.room] = [x]

    for length in sorted((n for n in counts if n <= capacity // 8), reverse=True):
        n = counts[length]
        while n:
            k = bisect.bisect_left(known, length)
            while k < len(known) and not rooms[known[k]]:
                del rooms[known[k]]
                known.pop(k)
            if k < len(known):
                x = rooms[known[k]].pop()
                if x.count > n:
                    rooms[x.room].append(x)
                    x = x.head(n)
                each = 1
            else:
                each = min(capacity // length, n)
                x = _Alike(n // each, capacity, [])
            for _ in range(each):
                x.items.append((length, rank[length], capacity - x.room))
                rank[length] += x.count
                x.room -= length
                n -= x.count
            put(x)
    return full + [x for xs in rooms.values() for x in xs]


def pack(found: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Sequences are gapless from offset 0 and hold at most ``capacity`` tokens. Repeated rows are separate pieces; null
    ids count as one id; no pieces, no sequences. Reruns agree.
    """
    key = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int")
    with frugal(found.sparkSession):
        found = cut(found.select("doc_id", "piece", "start", "length", "ids_crc32", key.alias("_bucket")), "pieces")
    # at most capacity * BUCKETS rows
    per = found.groupBy("length", "_bucket").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "_bucket"])
    lengths, buckets, n = (per[c].to_numpy().astype(np.int64) for c in ("length", "_bucket", "n"))
    before = np.cumsum(n) - n
    if len(n):
        heads = np.r_[True, lengths[1:] != lengths[:-1]]
        before -= np.repeat(before[heads], np.diff(np.r_[np.flatnonzero(heads), len(n)]))
    counts = {int(k): int(v) for k, v in per.groupby("length")["n"].sum().items()}
    slots, base = [], 0
    for x in plan(counts, capacity, groups):
        slots += [(length, rank, base, offset) for length, rank, offset in x.items]
        base += x.count
    slots.sort()
    s_len, s_rank, s_base, s_off = (np.array(c, np.int64) for c in (zip(*slots, strict=True) if slots else ([], [], [], [])))
    wide = np.int64(1) << 48
    bases, places = lengths * BUCKETS + buckets, s_len * wide + s_rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, bucket, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_bucket", "_rank"))
            rank = rank + before[np.searchsorted(bases, length * BUCKETS + bucket)]
            k = np.searchsorted(places, length * wide + rank, side="right") - 1
            more = [pa.array(s_base[k] + rank - s_rank[k]), pa.array(s_off[k])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + more, [*names, "sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return found.withColumn("_rank", rank).mapInArrow(tidied(place), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Tokenises and packs documents (doc_id, text; other columns are ignored). A null text is an empty one: one id."""
    return pack(pieces(docs, tokenizer, capacity), capacity, groups)
