"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, then exact intersection.

A document is the set of 64-bit hashes of its distinct shingles; documents of equal sets are one class. Two sets with a
Jaccard similarity of at least T share a shingle among the first ``n - ceil(T n) + 1`` of each, in any common order, so
classes meet in tiles by shingle and size band, and only there. The common order puts very frequent shingles last,
where they are in a tile's key only if almost all of a document is made of them.

First every class is compared with a few classes of each of its tiles, which costs as much as there are rows and joins
groups of near copies, however large. Then tiles that still hold several components compare their members across
components, first the likeliest pair of each two components, then all that are still apart: parity bitmaps of the sets bound the overlap from above (the bits in which two bitmaps differ are
elements that only one set has), and pairs that pass are intersected exactly. Large tiles are split into pairs of
chunks. No pair within a component is emitted, no pair that may link is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, frugal, tidied
from .components import components
from .textops import Words, chunks, mix, rolling

WIDTH = 5
PERCENT = 80
CHUNK_ROWS = 512
HEAVY = 4096
#: Classes of each tile that all its others are compared with first.
HUBS = 4
#: Rows that a Python worker gets at a time, where a row holds a tile's bitmaps or two whole sets.
TILES_A_BATCH, SETS_A_BATCH = 32, 128
#: Class ids that are sent to all executors at most; beyond, a join sends the rows instead.
SEND_IDS = 1_000_000
#: Frequent shingles whose hubs are sent to all executors at most (about 100 bytes each).
SEND_HUBS = 200_000


def shingles(batch: pa.RecordBatch, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes document after document, where each document's begin and end)."""
    for a, b, data, offsets in chunks(batch):
        words = Words(data, offsets, lower=True)
        n = np.diff(words.first)
        h = words.hashes()
        roll = rolling(h, width)
        at = np.arange(len(roll))
        inside = words.doc[at] == words.doc[at + width - 1] if len(roll) else np.zeros(0, bool)
        values, owner = [roll[inside]], [words.doc[at[inside]]]
        for short in range(1, width):  # fewer words: the whole sequence is the one shingle
            docs = np.flatnonzero(n == short)
            if len(docs):
                values.append(mix(rolling(h, short)[words.first[docs]] + np.uint64(short)))
                owner.append(docs)
        values, owner = np.concatenate(values), np.concatenate(owner)
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[fresh], owner[fresh]
        yield a, values, np.searchsorted(owner, np.arange(b - a + 1))


def digest(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each set."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=sums[1:])
        return mix(sums[ends[1:]] - sums[ends[:-1]] + np.diff(ends).astype(np.uint64)).astype(np.int64)


def bits(n: int) -> int:
    """Width of the bitmap of a set of n elements."""
    return 1 << min(14, max(6, 1 + int(n - 1).bit_length()))


def parity(values: np.ndarray) -> bytes:
    """Bit i is set if an odd number of elements fall on it. The bitmap of half the width is the xor of its halves."""
    width = bits(len(values))
    return np.packbits(np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bitmap: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(bitmap, np.uint64)
    while len(x) * 64 > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(n_a, n_b, differ, percent: int = PERCENT):
    """Whether sets of these sizes can be similar enough if at least ``differ`` elements are in only one of them."""
    most = np.minimum((n_a + n_b - differ) // 2, np.minimum(n_a, n_b))
    return (100 + percent) * most >= percent * (n_a + n_b)


def frequent(docs: DataFrame, width: int, share: int) -> np.ndarray:
    """Shingles that about one class in ``share`` or more has: at most ``share`` times the mean set size of them.

    Only an order depends on them. Tasks report what is frequent among their own rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0

        def told():
            found, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            some = count >= max(4, len(seen) // (2 * share))
            return pa.RecordBatch.from_arrays([pa.array(found[some].astype(np.int64)), pa.array(count[some].astype(np.int64))], ["g", "n"])

        for batch in batches:
            for _, values, ends in shingles(batch, width):
                for k, c in enumerate(digest(values, ends).tolist()):
                    if c not in seen:
                        seen.add(c)
                        held.append(values[ends[k] : ends[k + 1]])
                        size += len(held[-1])
                if size > 2_000_000:
                    yield told()
                    held, seen, size = [], set(), 0
        yield told()

    rows = docs.count()
    counted = docs.select("text").mapInArrow(tidied(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") >= max(32, rows // share)).select("g").toPandas()["g"]
    return np.sort(found.to_numpy(np.int64).astype(np.uint64))


def sketches(docs: DataFrame, width: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """doc_id, tid (hash of the text), n, c (class), and for the first of a class in a task its keys, how many are not frequent, and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, values, ends in shingles(batch, width):
                n, c = np.diff(ends), digest(values, ends)
                common = heavy[np.minimum(np.searchsorted(heavy, values), len(heavy) - 1)] == values if len(heavy) else np.zeros(len(values), bool)
                keys, rare, maps = [], [], []
                for k, (size, own) in enumerate(zip(n.tolist(), c.tolist(), strict=True)):
                    if not size or own in seen:
                        keys.append(None)
                        rare.append(0)
                        maps.append(None)
                        continue
                    seen.add(own)
                    u, f = values[ends[k] : ends[k + 1]], common[ends[k] : ends[k + 1]]
                    prefix = np.concatenate([u[~f], u[f]])[: size - (percent * size + 99) // 100 + 1]
                    keys.append(prefix.astype(np.int64))
                    rare.append(min(len(prefix), int((~f).sum())))
                    maps.append(parity(u))
                ids, tids = (batch.column(name).slice(a, len(n)) for name in ("doc_id", "tid"))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x for x, t in zip([ids, tids, n.astype(np.int32), c, keys, rare, maps], kinds, strict=True)], ["doc_id", "tid", "n", "c", "keys", "rare", "bitmap"])
            if len(seen) > 2_000_000:
                seen.clear()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tid")).mapInArrow(tidied(run), "doc_id long, tid long, n int, c long, keys array<long>, rare int, bitmap binary")


def bundled(sketch: DataFrame, parts: int) -> DataFrame:
    """(bucket, gs, cs, ns, places): keys that are not frequent, those of one bucket and batch in one row.

    A row for each key would carry its class and size beside it many times over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys")
            ends = keys.offsets.to_numpy()
            g, size = keys.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(g)) - np.repeat(ends[:-1] - ends[0], size)
            keep = place < b.column("rare").to_numpy()[row]
            g, row, place = g[keep], row[keep], place[keep].astype(np.int32)
            bucket = (g.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            found, start = np.unique(bucket[order], return_index=True)
            cuts = pa.array(np.r_[start, len(g)].astype(np.int32))
            values = (g, b.column("c").to_numpy()[row], b.column("n").to_numpy()[row], place)
            yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.ListArray.from_arrays(cuts, pa.array(v[order])) for v in values)], ["bucket", "gs", "cs", "ns", "places"])

    return sketch.filter("keys is not null").select("c", "n", "rare", "keys").mapInArrow(tidied(run), "bucket int, gs array<long>, cs array<long>, ns array<int>, places array<int>")


def _close(a: str, b: str, percent: int) -> "F.Column":
    """Sizes that a link allows."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def bounded(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, na, b, nb) whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            na, nb = (x.column(k).to_numpy() for k in ("na", "nb"))
            differ = np.zeros(len(na), np.int64)
            for k, (p, q) in enumerate(zip(x.column("pa").to_pylist(), x.column("pb").to_pylist(), strict=True)):
                width = 8 * min(len(p), len(q))
                differ[k] = np.bitwise_count(folded(p, width) ^ folded(q, width)).sum()
            yield x.select(["a", "na", "b", "nb"]).filter(pa.array(may_link(na.astype(np.int64), nb.astype(np.int64), differ, percent)))

    held = pairs.join(maps.select(F.col("c").alias("a"), F.col("bitmap").alias("pa")), "a").join(maps.select(F.col("c").alias("b"), F.col("bitmap").alias("pb")), "b")
    return held.select("a", "na", "b", "nb", "pa", "pb").mapInArrow(tidied(run), "a long, na int, b long, nb int")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link, by exact intersection of the sets; classes: c and doc_id of one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, values, ends in shingles(batch, width):
                signed = values.astype(np.int64)
                signed = signed[np.lexsort((signed, np.repeat(np.arange(len(ends) - 1), np.diff(ends))))]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed))
                c = pa.array(digest(values, ends))
                asked = batch.column("c").slice(a, len(lists))  # an id may have several texts; null: whatever the text's class is
                yield pa.RecordBatch.from_arrays([c, lists], ["c", "grams"]).filter(pc.fill_null(pc.equal(asked, c), True))

    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(classes, "c"), "jaccard-ids")
    few = ids.count() <= SEND_IDS
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = rows.join(F.broadcast(ids) if few else ids, "doc_id").select("c", "text").mapInArrow(tidied(run), "c long, grams array<long>")
    if not ids.filter("doc_id is null").isEmpty():
        nameless = rows.filter("doc_id is null").select(F.lit(None).cast("long").alias("c"), "text").mapInArrow(tidied(run), "c long, grams array<long>")
        found = found.unionByName(nameless.join(ids.select("c"), "c", "left_semi"))
    sets = cut(found.dropDuplicates(["c"]), "jaccard-sets")

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            na, nb = (x.column(k).to_numpy().astype(np.int64) for k in ("na", "nb"))
            (ga, ea), (gb, eb) = ((x.column(k).values.to_numpy(), x.column(k).offsets.to_numpy()) for k in ("ga", "gb"))
            both = np.zeros(len(na), np.int64)
            for k in range(len(na)):  # sorted arrays: the smaller one is looked up in the larger one
                p, q = ga[ea[k] : ea[k + 1]], gb[eb[k] : eb[k + 1]]
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(q, p)
                both[k] = (q[np.minimum(at, len(q) - 1)] == p).sum()
            yield x.select(["a", "b"]).filter(pa.array(both * (100 + percent) >= (na + nb) * percent))

    met = pairs.join(sets.select(F.col("c").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("c").alias("b"), F.col("grams").alias("gb")), "b")
    with frugal(docs.sparkSession, SETS_A_BATCH):
        links = cut(met.select("a", "na", "b", "nb", "ga", "gb").mapInArrow(tidied(intersect), "a long, b long"), "jaccard-links")
    drop_cut(ids)
    drop_cut(sets)
    return links


def _open(frames: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Tiles with only the members that may link, by size, place and component, with another one; none, no tile.

    If a tile's shingle is the first that two sets share, neither can share more than what follows it; if it is not,
    the tile of an earlier shingle has both.
    """
    for batch in frames:
        lists = batch.column("m")
        at = lists.offsets.to_numpy()
        c, size_place, comp = (lists.values.field(k).to_numpy() for k in range(3))
        n, place = size_place >> 32, size_place & 0xFFFFFFFF
        out: list[tuple] = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            x, left, own = n[a:b], (n[a:b] - place[a:b]) * (100 + percent), comp[a:b]
            both = (x[:, None] + x[None]) * percent
            good = (left[:, None] >= both) & (left[None] >= both) & (own[:, None] != own[None])
            good &= np.minimum(x[:, None], x[None]) * 100 >= np.maximum(x[:, None], x[None]) * percent
            keep = np.flatnonzero(good.any(1))
            if len(keep):
                ids = c[a:b][keep]
                order = np.argsort(ids)
                keep, ids = keep[order], ids[order]
                out.append((hashlib.blake2b(ids.tobytes(), digest_size=16).digest(), ids, x[keep].astype(np.int32), own[keep]))
        if out:
            ends = np.cumsum([0, *(len(o[1]) for o in out)]).astype(np.int32)
            parts = [pa.array(np.concatenate([o[k] for o in out])) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["c", "n", "comp"]))], ["tile", "m"])


def _tile_pairs(frames: Iterator[pa.RecordBatch], percent: int, best: bool, few: int = 16) -> Iterator[pa.RecordBatch]:
    """Pairs across components that bitmaps allow.

    With ``best``, tiles with more than ``few`` give only the likeliest pair of each two components, and their name:
    they are not done.
    """
    for batch in frames:
        for tile, listed in zip(batch.column("tile"), batch.column("members"), strict=True):
            tile, members = tile.as_py(), sorted(listed.as_py(), key=lambda m: m["n"])
            n, c, comp = (np.array([m[k] for m in members], np.int64) for k in ("n", "c", "comp"))
            width = np.array([8 * len(m["bitmap"]) for m in members])
            # sizes that may link differ so little that widths are equal or double
            folds = {w: np.stack([folded(members[k]["bitmap"], w) for k in np.flatnonzero((width == w) | (width == 2 * w))]) for w in set(width.tolist())}
            place = {w: np.cumsum((width == w) | (width == 2 * w)) - 1 for w in folds}
            ends = np.searchsorted(n, n * 100 // percent, side="right")
            left, right, far = [], [], []
            for i in range(len(n) - 1):
                if ends[i] <= i + 1:
                    continue
                w = int(width[i])
                near = slice(int(place[w][i]) + 1, int(place[w][ends[i] - 1]) + 1)
                differ = np.bitwise_count(folds[w][near] ^ folds[w][place[w][i]]).sum(1, dtype=np.int64)
                j = np.flatnonzero(may_link(n[i], n[i + 1 : ends[i]], differ, percent) & (comp[i + 1 : ends[i]] != comp[i]))
                left.append(np.full(len(j), i))
                right.append(j + i + 1)
                far.append(differ[j])
            if not left or not (i := np.concatenate(left)).size:
                continue
            j = np.concatenate(right)
            part = best and len(i) > few
            if part:
                low, high = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
                order = np.lexsort((c[j], c[i], np.concatenate(far), high, low))
                first = np.r_[True, (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)]
                i, j = i[order[first]], j[order[first]]
            yield pa.RecordBatch.from_arrays([pa.array(c[i]), pa.array(n[i].astype(np.int32)), pa.array(c[j]), pa.array(n[j].astype(np.int32)), pa.array([tile if part else None] * len(i), pa.binary())], ["a", "na", "b", "nb", "undone"])


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with comp, the root of their class or itself."""
    known = roots.withColumnRenamed("v", "c")
    return members.join(F.broadcast(known) if roots.count() <= SEND_IDS else known, "c", "left").withColumn("comp", F.coalesce("root", "c")).drop("root")


def open_tiles(members: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(tile, m): tiles, or pairs of chunks of large ones, that hold several components. members: g, c, np, many."""
    rows = _rooted(members, roots)
    listed = F.collect_list(F.struct("c", "np", "comp")).alias("m")
    several = (F.min("comp") < F.max("comp")).alias("several")
    small = rows.filter(F.col("many") <= CHUNK_ROWS).groupBy("g").agg(listed, several).filter("several").select("m")
    # a large tile: bands of sizes that may link (a class is in its own and in the one below), and chunks of bands
    large = rows.filter(F.col("many") > CHUNK_ROWS)
    band = F.floor(F.log(F.shiftright("np", 32)) / float(np.log(100.0 / percent * 1.005))).cast("int")
    large = large.withColumn("band", F.explode(F.array(band, band - 1)))
    several_bands = large.groupBy("g", "band").agg(several, F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("k")).filter("several").drop("several")
    large = large.join(several_bands, ["g", "band"])
    large = large.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "c"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    large = large.groupBy("g", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(listed, several).filter("several").select("m")
    found = small.unionByName(large).mapInArrow(tidied(lambda it: _open(it, percent)), "tile binary, m array<struct<c: long, n: int, comp: long>>")
    return cut(found.dropDuplicates(["tile"]), "jaccard-open")


def crossing(tiles: DataFrame, maps: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, na, b, nb) of members (tile, c, n, comp) in different components that bitmaps allow to link, and undone."""
    filled = tiles.join(maps.select("c", "bitmap"), "c").groupBy("tile").agg(F.collect_list(F.struct("c", "n", "comp", "bitmap")).alias("members"))
    with frugal(tiles.sparkSession, TILES_A_BATCH):
        return cut(filled.mapInArrow(tidied(lambda it: _tile_pairs(it, percent, best)), "a long, na int, b long, nb int, undone binary"), "jaccard-crossing")


def _paired(found: DataFrame) -> DataFrame:
    first = F.col("a") < F.col("b")
    return found.select(F.least("a", "b").alias("a"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, tid, n_shingles, class_id, component_id, group of every document (doc_id, text; other columns are ignored).

    tid is xxhash64 of the text; group names the component also where it has no doc_id, null without shingles.

    component_id is the smallest doc_id that links reach, its own included. Null and empty texts have no shingles and
    link with nothing, not even each other; texts with fewer words than ``width`` are one shingle. Documents of equal
    sets link. Rows without doc_id are linked but name no component. An empty table gives no rows.
    """
    with frugal(docs.sparkSession):
        return _link(docs, width, percent)


def _link(docs: DataFrame, width: int, percent: int) -> DataFrame:
    heavy = frequent(docs, width, HEAVY)
    sketch = cut(sketches(docs, width, percent, heavy), "jaccard")
    classes = cut(sketch.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id")), "jaccard-classes")
    maps = cut(sketch.filter("keys is not null").groupBy("c").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "jaccard-maps")
    # np: size and place in one number
    keyed = sketch.filter("keys is not null").select("c", "n", "rare", F.posexplode("keys").alias("at", "g"))
    size_place = (F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")).alias("np")

    # tiles of two classes or more, each with a few classes that all others are compared with
    def least(seed: int) -> "F.Column":
        return F.struct(F.xxhash64(F.lit(seed), "c").alias("h"), F.col("c").alias("c"), F.shiftright("np", 32).cast("int").alias("n"))

    tile = Window.partitionBy("bucket", "g")
    parts = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bundled(sketch, parts).repartition("bucket").select("bucket", F.inline(F.arrays_zip("gs", "cs", "ns", "places"))).toDF("bucket", "g", "c", "n", "at")
    usual = rows.select("bucket", "g", "c", size_place).withColumns({"many": F.count("*").over(tile)} | {f"hub{k}": F.min(least(k)).over(tile) for k in range(HUBS)}).filter("many > 1")
    hubs = F.array(*[F.struct(F.col(f"hub{k}.c").alias("c"), F.col(f"hub{k}.n").alias("n")) for k in range(HUBS)])
    tiles = cut(usual.select("g", "c", "np", F.col("many").cast("int").alias("many"), F.array_distinct(hubs).alias("hubs")), "jaccard-tiles")
    edges = tiles.select("c", "np", "hubs")
    common = None
    if len(heavy):
        frequent_rows = cut(keyed.filter("at >= rare").select("g", "c", size_place), "jaccard-common")
        # no more rows than there are frequent shingles in tiles
        of = frequent_rows.groupBy("g").agg(F.count("*").cast("int").alias("many"), *[F.min(least(k)).alias(f"hub{k}") for k in range(HUBS)]).select("g", "many", F.array_distinct(hubs).alias("hubs"))
        common = cut(frequent_rows.join(F.broadcast(of) if len(heavy) <= SEND_HUBS else of, "g"), "jaccard-common")
        drop_cut(frequent_rows)
        edges = edges.unionByName(common.select("c", "np", "hubs"))
    edges = edges.select("c", "np", F.explode("hubs").alias("h")).select("c", F.shiftright("np", 32).cast("int").alias("n"), F.col("h.c").alias("hub"), F.col("h.n").alias("hub_n"))
    pairs = edges.filter((F.col("c") != F.col("hub")) & _close("n", "hub_n", percent)).select(F.least("c", "hub").alias("a"), F.when(F.col("c") < F.col("hub"), F.col("n")).otherwise(F.col("hub_n")).alias("na"), F.greatest("c", "hub").alias("b"), F.when(F.col("c") < F.col("hub"), F.col("hub_n")).otherwise(F.col("n")).alias("nb")).distinct()
    pairs = cut(bounded(pairs, maps, percent), "jaccard-pairs")
    links = verified(pairs, classes, docs, width, percent)
    drop_cut(pairs)
    roots = cut(components(links), "jaccard-roots")

    # tiles that hold several components: the likeliest pair of each two, then whatever is left
    members = tiles.select("g", "c", "np", "many")
    members = members if common is None else members.unionByName(common.select("g", "c", "np", "many"))
    still = open_tiles(members, roots, percent)
    drop_cut(tiles)
    if common is not None:
        drop_cut(common)
    rows = still.select("tile", F.explode("m").alias("m")).select("tile", "m.c", "m.n", "m.comp")
    for best in (True, False):
        found = crossing(rows, maps, percent, best)
        if found.isEmpty():
            break
        more = verified(_paired(found), classes, docs, width, percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            drop_cut(roots)
            roots = cut(components(links), "jaccard-roots")
        if best:
            undone = found.filter("undone is not null").select(F.col("undone").alias("tile")).distinct()
            if undone.isEmpty():
                break
            apart = F.min("comp").over(Window.partitionBy("tile")) < F.max("comp").over(Window.partitionBy("tile"))
            rows = _rooted(rows.join(undone, "tile").drop("comp"), roots).withColumn("_apart", apart).filter("_apart").drop("_apart")

    drop_cut(maps)
    drop_cut(still)
    of = classes.join(roots.withColumnRenamed("v", "c"), "c", "left").select("c", "doc_id", F.coalesce("root", "c").alias("root"))
    named = of.join(of.groupBy("root").agg(F.min("doc_id").alias("component")), "root").select("c", "component", F.col("root").alias("group"))
    out = sketch.select("doc_id", "tid", "n", "c").join(named, "c", "left")
    return out.select("doc_id", "tid", F.when(F.col("n") > 0, F.col("group")).alias("group"), F.col("n").cast("long").alias("n_shingles"), F.col("c").alias("class_id"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
