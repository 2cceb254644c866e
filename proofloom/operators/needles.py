"""Many needles in many texts: every occurrence of every needle, in one look at each text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Characters of needles in one automaton; needles beyond go to several.
PART = 8_000_000
#: Ways in which texts are dealt out to the tasks of one part, where needles fill several parts.
SALTS = 64


def _automaton(needles: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for n in needles:
        out.add_word(n, n)
    out.make_automaton()
    return out


def _inside_word(c: str) -> bool:
    return c.isalnum() or c in "_-"


def occurrences(automaton: ahocorasick.Automaton, text: str, word: bool = False, overlapping: bool = True) -> dict[str, list[int]]:
    """Places (from 1) of each needle that occurs, those that overlap or contain others too.

    ``word`` leaves out places where a letter, digit, underscore or hyphen stands before or after. Without
    ``overlapping`` a needle's next place begins after its last one ends, as a search from left to right finds them.
    """
    found: dict[str, list[int]] = {}
    for end, needle in automaton.iter(text) if len(automaton) else ():
        at = end - len(needle) + 1
        if word and (at > 0 and _inside_word(text[at - 1]) or end + 1 < len(text) and _inside_word(text[end + 1])):
            continue
        places = found.setdefault(needle, [])
        if overlapping or not places or at + 1 >= places[-1] + len(needle):
            places.append(at + 1)
    return found


def _hits(batch: pa.RecordBatch, keep: int, search: Callable[[str], dict[str, list[int]]]) -> pa.RecordBatch:
    rows, needles, places = [], [], []
    for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
        for needle, at in search(text).items() if text else ():
            rows.append(k)
            needles.append(needle)
            places.append(at)
    took = pa.array(rows, pa.int64())
    columns = [batch.column(i).take(took) for i in range(keep)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(needles, pa.string()), pa.array(places, pa.list_(pa.int32()))], [*batch.schema.names[:keep], "needle", "places"])


def find(needles: DataFrame, texts: DataFrame, keep: list[str], needle: str | Column = "needle", text: str | Column = "text", word: bool = False, overlapping: bool = True, part: int = PART, places: bool = True) -> DataFrame:
    """Columns ``keep`` of ``texts`` with each needle that occurs in the text, in any case, and its places.

    One row a text and distinct needle (lower case), places from 1 in the lower-case text. Needles of at most ``part``
    characters in all go to every task. More are split by a hash into parts of that size; a part's needles come first in
    each of its tasks and texts, dealt out over ``SALTS`` tasks a part, stream past them, so no task holds more than one
    part and nothing goes through the driver. Null and empty needles and texts match nothing.
    Without ``places`` those are empty lists, which takes less time.
    """
    low = lambda c: F.lower(F.col(c) if isinstance(c, str) else c)
    asked = needles.select(low(needle).alias("needle")).filter("needle <> ''").distinct()
    rows = texts.select(*keep, low(text).alias("_text"))
    schema = StructType([*rows.schema.fields[: len(keep)], StructField("needle", StringType()), StructField("places", ArrayType(IntegerType()))])
    size = asked.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("n")).first()["n"]
    n = len(keep)

    def searching(automaton):
        if places or word:
            return lambda t: occurrences(automaton, t, word, overlapping)
        return lambda t: {needle: [] for _, needle in automaton.iter(t)} if len(automaton) else {}

    if size <= part:
        known = [r.needle for r in asked.collect()]  # size is checked above

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = searching(_automaton(known))
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    yield _hits(b.slice(at, 1000), n, search)

        return rows.mapInArrow(run, schema)

    parts = -(-2 * size // part)
    salted = asked.select(F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.pmod(F.xxhash64("needle"), F.lit(parts)).cast("int").alias("_part"), F.lit(0).alias("_kind"), "needle")
    dealt = rows.withColumns({"_salt": F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int"), "_kind": F.lit(1), "_part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    every = salted.unionByName(dealt, allowMissingColumns=True).select("_part", "_salt", "_kind", "needle", *keep, "_text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, search = None, [], None
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            at = 0
            while at < b.num_rows:
                end = at + 1
                while end < b.num_rows and keys[end] == keys[at] and end - at < 1000:
                    end += 1
                if keys[at][:2] != now:
                    now, known, search = keys[at][:2], [], None
                if keys[at][2] == 0:
                    known += b.column(3).slice(at, end - at).to_pylist()
                else:
                    search = search or searching(_automaton(known))
                    if known:
                        yield _hits(pa.RecordBatch.from_arrays(b.columns[4:], b.schema.names[4:]).slice(at, end - at), n, search)
                at = end

    return every.repartition(parts * SALTS, "_part", "_salt").sortWithinPartitions("_part", "_salt", "_kind").mapInArrow(stream, schema)
