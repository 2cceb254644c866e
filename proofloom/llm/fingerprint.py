"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame and SQL functions only.

A paragraph is a run of at most ``RUN`` words of one line, in texts of any length; its digest is 64 bits. A sketch has
rows of cells; each digest is added to one cell of each row: its bits by xor, and a weight by addition, which holds a
count and a check value. Subtracting the sketches of two versions leaves what only one of them has. A cell whose weight
is that of its bits then names a digest; taking it out of the other rows frees more cells (peeling).

The fingerprint is a sketch of 3 rows of 8 cells. Where peeling the difference of two fingerprints gets stuck, larger
sketches are made of both texts: as many sub-sketches of 4 rows of 4 cells as there are digests for; digests are dealt
to them by hash. A sub-sketch that does not give back all its digests is made again from them, larger and with other hash
values, until nothing is left. Cells are columns of a hash aggregate, and what they name is arithmetic on them, in
generated code inside the partition that holds the document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Words in a paragraph at most.
RUN = 4
#: Digests of both texts in a sub-sketch, about.
LOAD = 2
#: How much larger the next attempt is: cells that hold nothing cost nothing.
GROWTH = 4096
#: Sizes that are tried in one plan before stuck documents are read again.
TRIES = 2
#: Ranges, and ids of stuck documents, that are sent to all executors at most (16 bytes and a path each); beyond, a join.
SEND_RANGES = 200_000
#: Bytes of text in one partition, about: its sub-sketches should fit in memory.
PARTITION_BYTES = 2 << 20


def digests(text: str | Column) -> Column:
    """The distinct digests of the paragraphs of a text."""
    runs = F.regexp_extract_all(text, F.lit(r"[^ \t\n\r]+(?:[ \t]+[^ \t\n\r]+){0,%d}" % (RUN - 1)), F.lit(0))
    return F.array_distinct(F.transform(runs, lambda run: F.xxhash64(run)))


def weight(digest: Column) -> Column:
    """One, in the 34th bit, and 32 bits that check the digest."""
    return F.lit(1 << 33) + F.shiftrightunsigned(F.xxhash64(digest, F.lit(7)), 32)


@dataclass(frozen=True)
class Shape:
    """Rows and cells of a sketch. Cells are columns k<row>_<place> and v<row>_<place>; bits of a hash choose places."""

    rows: int
    bits: int
    begin: int

    @property
    def width(self) -> int:
        return 1 << self.bits

    @property
    def places(self) -> list[str]:
        return [f"{r}_{p}" for r in range(self.rows) for p in range(self.width)]

    def place(self, hashed: Column, row: int) -> Column:
        return F.shiftright(hashed, self.begin + self.bits * row).bitwiseAND(self.width - 1).cast("int")

    def added(self) -> list[Column]:
        """Aggregates over rows with k (digest), v (signed weight) and p<row> (places)."""
        out = []
        for r in range(self.rows):
            for p in range(self.width):
                own = -(F.col(f"p{r}") == p).cast("long")
                out.append(F.bit_xor(F.col("k").bitwiseAND(own)).alias(f"k{r}_{p}"))
                out.append(F.sum(F.col("v").bitwiseAND(own)).alias(f"v{r}_{p}"))
        return out

    def recovered(self, df: DataFrame) -> DataFrame:
        """Adds n, how many digests the cells name, and stuck, whether there are more; the cells' columns go.

        All cells are looked at together: a digest counts where the first row names it. If what is named adds up to
        what a row holds, that is all; if not, the sketch is too small for another round to be worth while. Whether it is
        comes from a higher-order function, which keeps this out of whole-stage code: one method would be too large to compile.
        """
        rest = [c for c in df.columns if c[1:] not in self.places]
        k = {p: F.coalesce(f"k{p}", F.lit(0).cast("long")) for p in self.places}
        v = {p: F.coalesce(f"v{p}", F.lit(0).cast("long")) for p in self.places}
        df = df.select(*rest, *[k[p].alias(f"k{p}") for p in self.places], *[v[p].alias(f"v{p}") for p in self.places], *[(F.abs(v[p]) == weight(k[p])).alias(f"named{p}") for p in self.places])
        n, bits, sums = F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")
        for p in self.places:
            first = F.col(f"named{p}")
            for q in self.places:
                if q[0] < p[0]:
                    first = first & ~(F.col(f"named{q}") & (F.col(f"k{q}") == F.col(f"k{p}")))
            mask = -first.cast("long")
            n, bits, sums = n - mask, bits.bitwiseXOR(F.col(f"k{p}").bitwiseAND(mask)), sums + F.col(f"v{p}").bitwiseAND(mask)
        for p in range(self.width):
            bits, sums = bits.bitwiseXOR(F.col(f"k0_{p}")), sums - F.col(f"v0_{p}")
        return df.select(*rest, n.alias("n"), F.exists(F.array(bits, sums), lambda z: z != 0).alias("stuck"))


SMALL, SUB = Shape(3, 3, 3), Shape(4, 2, 48)


def printed(cells: str | Column) -> Column:
    """A sketch as text: the bits and the weight of each cell in hexadecimal."""
    return F.array_join(F.transform(cells, lambda z: F.concat_ws(":", F.hex(z["k"]), F.hex(z["v"]))), "|")


def _exploded(met: DataFrame, keys: list[str], parts: list[tuple[int, int, Column]], head: Column, kind) -> DataFrame:
    """Rows (keys, part, sign, k) of the digests of each (part, sign, digests), and one row of part -1 with ``head``."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast(kind)
    first = F.struct(F.lit(-1).alias("part"), F.lit(0).alias("sign"), F.array(zero).alias("found"), head.alias("head"))
    more = [F.struct(F.lit(part).alias("part"), F.lit(sign).alias("sign"), found.alias("found"), none.alias("head")) for part, sign, found in parts]
    rows = met.select(*keys, F.explode(F.array(first, *more)).alias("p"))
    return rows.select(*keys, "p.part", "p.sign", "p.head", F.explode("p.found").alias("k"))


def _head(df: DataFrame, columns: list[str]):
    """A struct of columns and its type."""
    head = F.struct(*columns)
    return head, df.select(head.alias("h")).schema["h"].dataType


def sketched(met: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """Adds c_<side>, the fingerprint cells of each array of digests."""
    head, kind = _head(met, [c for c in met.columns if c not in keys])
    rows = _exploded(met, keys, [(i, 1, F.col(s)) for i, s in enumerate(sides)], head, kind)
    rows = rows.select(*keys, "part", "head", "k", weight(F.col("k")).alias("v"), *[SMALL.place(F.col("k"), r).alias(f"p{r}") for r in range(SMALL.rows)])
    rows = rows.groupBy(*keys, "part", "head").agg(*SMALL.added())
    rows = rows.select(*keys, "part", "head", F.when(F.col("part") >= 0, F.array(*[F.struct(F.col(f"k{p}").alias("k"), F.col(f"v{p}").alias("v")) for p in SMALL.places])).alias("cells"))
    none = F.array_repeat(F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("v")), len(SMALL.places))
    found = [F.coalesce(F.first(F.when(F.col("part") == i, F.col("cells")), ignorenulls=True), none).alias(f"c_{s}") for i, s in enumerate(sides)]
    return rows.groupBy(*keys).agg(F.first("head", ignorenulls=True).alias("head"), *found).select(*keys, "head.*", *[f"c_{s}" for s in sides])


def compared(met: DataFrame, pairs: list[tuple[str, str]], rounds: int = 6) -> DataFrame:
    """Adds differ<i>, how many digests only one side of each pair has, from its fingerprints; null if peeling is stuck."""
    cell = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    kind = "array<struct<k:bigint,v:bigint>>"
    spots = [(r, p) for r in range(SMALL.rows) for p in range(SMALL.width)]

    def state(cells: Column, n: Column, live: Column) -> Column:
        return F.struct(cells.cast(kind).alias("cells"), n.alias("n"), live.alias("live"))

    def without(cells: Column, gone: Column) -> Column:
        def less(i: int, row: int, place: int) -> Column:
            here = F.filter(gone, lambda g: SMALL.place(g["k"], row) == place)
            return F.aggregate(here, cells[i], lambda s, g: cell(s["k"].bitwiseXOR(g["k"]), s["v"] - g["v"]))

        return F.array(*[less(i, *spot) for i, spot in enumerate(spots)])

    def turn(s: Column, _: Column) -> Column:
        def after(gone: Column) -> Column:
            return F.when(F.size(gone) == 0, state(s["cells"], s["n"], F.lit(False))).otherwise(state(without(s["cells"], gone), s["n"] + F.size(gone), F.lit(True)))

        # an array of one element gives a name to what is used several times
        named = F.array_distinct(F.filter(s["cells"], lambda z: F.abs(z["v"]) == weight(z["k"])))
        return F.when(~s["live"], s).otherwise(F.transform(F.array(named), after)[0])

    def end(a: str, b: str) -> Column:
        start = F.zip_with(f"c_{a}", f"c_{b}", lambda p, q: cell(p["k"].bitwiseXOR(q["k"]), p["v"] - q["v"]))
        last = F.aggregate(F.array(*[F.lit(k) for k in range(rounds)]), state(start, F.lit(0), F.lit(True)), turn)
        stuck = lambda s: F.exists(s["cells"], lambda z: (z["k"] != 0) | (z["v"] != 0))
        return F.transform(F.array(last), lambda s: F.when(~stuck(s), s["n"].cast("long")))[0]

    return met.select("*", *[end(a, b).alias(f"differ{i}") for i, (a, b) in enumerate(pairs)])


def retried(met: DataFrame, keys: list[str], pairs: list[tuple[str, str]], attempt: int, first: int) -> DataFrame:
    """Fills differ<i> where it is null, by sub-sketches; null stays where one of them is stuck.

    todo<i> lists the sub-sketches of the attempt before that were stuck (null: all digests count), n<i> what the others named.
    """
    width = lambda a, b, turn: F.greatest(F.ceil(F.log2((F.size(a) + F.size(b) + 1) * (GROWTH**turn / LOAD))).cast("int"), F.lit(0))
    masks = lambda turn: F.array(*[F.call_function("shiftleft", F.lit(1).cast("long"), width(a, b, turn)) - 1 for a, b in pairs])
    head, kind = _head(met, [c for c in met.columns if c not in keys])
    none = F.array().cast("array<bigint>")
    parts = [(i, sign, F.when(F.col(f"differ{i}").isNull(), F.col(side)).otherwise(none)) for i, (a, b) in enumerate(pairs) for sign, side in ((1, a), (-1, b))]
    more = {"masks": masks(attempt)}
    if attempt > first:
        more |= {"before": masks(attempt - 1), "todo": F.array(*[F.col(f"todo{i}") for i, _ in enumerate(pairs)])}
    rows = _exploded(met.withColumns(more), [*keys, *more], parts, head, kind)
    at = F.greatest("part", F.lit(0))
    if attempt > first:  # those of stuck sub-sketches
        rows = rows.filter((F.col("part") < 0) | F.array_contains(F.col("todo")[at], F.xxhash64("k", F.lit(attempt - 1)).bitwiseAND(F.col("before")[at])))
    rows = rows.select(*keys, "part", "head", "sign", "k", F.col("masks")[at].alias("mask"), F.xxhash64("k", F.lit(attempt)).alias("h"))
    rows = rows.select(*keys, "part", "head", "k", (F.col("sign") * weight(F.col("k"))).alias("v"), F.when(F.col("part") >= 0, F.col("h").bitwiseAND(F.col("mask"))).otherwise(-1).alias("sub"), *[SUB.place(F.col("h"), r).alias(f"p{r}") for r in range(SUB.rows)])
    rows = SUB.recovered(rows.groupBy(*keys, "part", "sub", "head").agg(*SUB.added()))
    rows = rows.withColumn("sub", F.when(F.col("stuck") & (F.col("part") >= 0), F.col("sub")))
    if attempt == first:  # many sub-sketches a document; later there are few
        rows = rows.groupBy(*keys, "part", "head", "sub").agg(F.sum("n").alias("n"))
    out = [F.first("head", ignorenulls=True).alias("head")]
    for i, _ in enumerate(pairs):
        own, fine = F.col("part") == i, F.col("sub").isNull()
        out += [F.coalesce(F.sum(F.when(own & fine, F.col("n"))), F.lit(0)).cast("long").alias(f"more{i}"), F.collect_list(F.when(own & ~fine, F.col("sub"))).alias(f"left{i}")]
    rows = rows.groupBy(*keys).agg(*out)
    rest = [c for c in met.columns if c not in keys and c[:-1] not in ("differ", "todo", "n")]
    final = []
    for i, _ in enumerate(pairs):
        known, n = F.col(f"head.differ{i}"), F.col(f"head.n{i}") + F.col(f"more{i}")
        final += [F.when(known.isNotNull(), known).when(F.size(f"left{i}") == 0, n).alias(f"differ{i}"), n.alias(f"n{i}"), F.col(f"left{i}").alias(f"todo{i}")]
    return rows.select(*keys, *[f"head.{c}" for c in rest], *final)


# --- the next document
def ranges(docs: DataFrame, per: int) -> tuple[DataFrame, DataFrame]:
    """The rows with ``path``, the range of their id, and (path, id, n, nulls, before) of every range.

    Ranges are of equal width; one that has many more rows than ``per`` and several ids is cut again by its own ids, until none has. before: the range before, of the first range the last.
    """
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    width = max(1, -(-(high - low + 1) // max(1, ends["n"] // per)))
    first = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)), F.lit(0)).cast("long")
    rows = docs.withColumn("path", F.array(first))

    def heads() -> DataFrame:
        found = rows.groupBy("path").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
        return cut(found, "ranges")

    found = heads()
    while True:
        wide = found.filter((F.col("n") > 8 * per) & (F.col("id") < F.col("last")))
        wide = wide.select(F.col("path").alias("_path"), F.col("id").alias("_low"), F.ceil((F.col("last") - F.col("id") + 1) / F.ceil(F.col("n") / per)).alias("_width"))
        some = wide.count()
        if not some:
            break
        deeper = F.concat("path", F.array(F.coalesce(F.floor((F.col("doc_id") - F.col("_low")) / F.col("_width")), F.lit(0)).cast("long")))
        rows = rows.join(F.broadcast(wide) if some <= SEND_RANGES else wide, F.col("path") == F.col("_path"), "left")
        rows = rows.withColumn("path", F.when(F.col("_path").isNull(), F.col("path")).otherwise(deeper)).drop("_path", "_low", "_width")
        found = heads()
    # the range before: inside groups of ranges, then from group to group
    group = F.floor(F.col("path")[0] / 4096)
    inner = found.withColumns({"_g": group, "_b": F.lag("path").over(Window.partitionBy(group).orderBy("path"))})
    outer = found.groupBy(group.alias("_g")).agg(F.max("path").alias("_last"))
    order = Window.orderBy("_g")  # a row for 4096 ranges
    ends_of = outer.select("_g", F.coalesce(F.lag("_last").over(order), F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_e"))
    return rows, inner.join(ends_of, "_g").select("path", "id", "n", "nulls", F.coalesce("_b", "_e").alias("before"))


def followed(docs: DataFrame, columns: list[str], per: int = 128, parts: int | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """Each row with the struct ``next`` of the following row's ``columns``, by doc_id; the last row gets the first's.

    Null ids come first; rows of equal id go by their columns. Rows are dealt to ranges of ids, and the first row of each
    range also goes to the range before: nothing is ordered in one place. One id of very many rows remains one range.
    ``derived`` columns are computed after rows have moved and may be among ``columns``; ``to``, the range, stays.
    """
    rows, found = ranges(docs, per)
    found = cut(found, "ranges")
    few = found.count() <= SEND_RANGES
    # rows with the smallest id of a range, or without one if it has such rows, go to the range before too
    firsts = found.select(F.col("path").alias("_path"), F.when(F.col("nulls") == 0, F.col("id")).alias("_id"), F.col("before").alias("_before"))
    met = rows.join(F.broadcast(firsts) if few else firsts, (F.col("path") == F.col("_path")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    here, there = F.struct(F.col("path").alias("to"), F.lit(0).alias("copy")), F.struct(F.col("_before").alias("to"), F.lit(1).alias("copy"))
    met = met.withColumn("_to", F.explode(F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    met = met.select(*docs.columns, "_to.to", "_to.copy")
    met = met.repartition(parts, "to") if parts else met.repartition("to")
    if derived:
        met = met.withColumns(derived)
    sort = [F.col("copy"), F.col("doc_id").asc_nulls_first(), *[F.col(c) for c in columns if c in docs.columns]]
    return met.withColumn("next", F.lead(F.struct(*columns)).over(Window.partitionBy("to").orderBy(*sort))).filter("copy = 0").drop("copy")


def _attempt(own: DataFrame, parts: int, first: int) -> DataFrame:
    """All columns of the result but likeness, and how many digests differ, null where peeling is stuck."""
    met = followed(own, ["doc_id", "text", "d"], parts=parts, derived={"d": digests("text")})
    n = F.length("text")
    met = met.select("to", "doc_id", "text", "d", n.alias("chars"), F.col("next.text").alias("after"), F.col("next.doc_id").alias("after_id"), F.col("next.d").alias("x"), F.floor(n / 4).cast("int").alias("q"))
    met = met.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("chars") - F.col("q")), F.substring("after", F.lit(1), F.col("q"))))
    met = met.select("to", F.monotonically_increasing_id().alias("row"), "doc_id", "after_id", "chars", F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("doc_id", "text", "after").alias("key"), "d", digests("edited").alias("e"), "x")
    keys, pairs = ["to", "row"], [("d", "e"), ("d", "x")]
    met = compared(sketched(met, keys, ["d", "e", "x"]), pairs).drop("c_x")
    met = met.select("*", *[F.lit(0).cast("long").alias(f"n{i}") for i in (0, 1)], *[F.lit(None).cast("array<bigint>").alias(f"todo{i}") for i in (0, 1)])
    for turn in range(TRIES):
        met = retried(met, keys, pairs, first + turn, first)
    return met.select("doc_id", "after_id", "chars", "edited_sha256", "key", "c_d", "c_e", F.size("d").alias("size"), F.size("e").alias("size0"), F.size("x").alias("size1"), "differ0", "differ1")


def fingerprints(docs: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last quarter of code points replaced by the first as many (or all) of the next document.
    Likeness is twice the paragraphs in common over all paragraphs of both, and 1 if neither has any. Null texts count
    as empty; the only document follows itself; equal texts have equal fingerprints; repeated rows are documents of
    their own, equal ids go by their texts; very long texts are one row each and are read whole; other columns are
    ignored; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, size // partition_bytes))
    found, attempt = cut(_attempt(own, parts, 0), "fingerprints"), 0
    done, stuck = found.filter("differ0 is not null and differ1 is not null"), found.filter("differ0 is null or differ1 is null")
    while not stuck.isEmpty():
        # those documents and the ones that follow them, in the order that they have among all
        attempt += TRIES
        ids = stuck.select(F.explode(F.array("doc_id", "after_id")).alias("_id")).distinct()
        again = own.join(F.broadcast(ids) if ids.count() <= SEND_RANGES else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        found = cut(_attempt(again, 8, attempt).join(stuck.select("key").distinct(), "key", "left_semi").select(*found.columns), "fingerprints")
        done, stuck = done.unionByName(found.filter("differ0 is not null and differ1 is not null")), found.filter("differ0 is null or differ1 is null")

    def near(k: int) -> Column:
        total = F.col("size") + F.col(f"size{k}")
        return F.when(total == 0, F.lit(1.0)).otherwise((total - F.col(f"differ{k}")) / total)

    return done.select("doc_id", F.col("chars").cast("long").alias("n_chars"), "edited_sha256", printed("c_d").alias("fingerprint"), printed("c_e").alias("edited_fingerprint"), near(0).alias("near_edited"), near(1).alias("near_next"))
