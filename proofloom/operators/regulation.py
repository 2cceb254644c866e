"""Clauses of regulations from their pages: body, lines, clauses, merged clauses, counters.

Whether a line opens a clause depends on the lines before it: a number that stands alone takes the next line as its title,
and a line that was taken opens nothing. One line thus maps the two states (taken or not) to the next line's, and such
maps compose. Lines are dealt out in ranges, so that a document of any length is many tasks' work: each range first gives
its map, its number of headings and its last heading for either state before it; a scan over the ranges, one row each,
says in which state and clause every range begins; then every range gives its pieces of clauses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby, tee

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..staging import settled

# --- fixed values
NOISE = (
    r"RIPRODUZIONE SU LICENZA CEI AD ESCLUSIVO USO AZIENDALE",
    r"Copia concessa a .*? CEI-Comitato Elettrotecnico Italiano",
    r"^Norma Tecnica$",
    r"^NORMA TECNICA$",
    r"^CEI EN 50128(:2002-04)?$",
    r"^Pagina [ivx\d ]+(di \d+)?$",
    r"^-- \d+ of \d+ --$",
)
NOISE_STARTS = ("© ", "Comitato Europeo di")
PAGE_MARK = r"--\s+(\d+)\s+of\s+\d+\s+--"
BODY_STARTS = r"3\.1\s+Assessment"
BODY_STOPS = ("ANNEX/ALLEGATO A", "ANNEX A", "BIBLIOGRAPHY")
OTHER_HEADINGS = ("CAMPO D’APPLICAZIONE", "RIFERIMENTI NORMATIVI", "DEFINIZIONI", "OBIETTIVI E CONFORMITÀ", "PERSONALE E RESPONSABILITÀ")
NOT_BODY, NOT_BODY_STARTS = ("CONTENTS", "INDICE", "INTRODUCTION"), ("Publication", "Titolo")
ENGLISH = (" shall ", " should ", " must ", " the ", " and ", " of ")
ITALIAN = (" il ", " della ", " delle ", " deve ", " requisito ", " requisiti ", " documento ", " software ", " validazione ")
MAIN, SUB = re.compile(r"(\d+)\s+([A-Z][A-Z0-9 /\-(),]+)"), re.compile(r"(\d+(?:\.\d+)+)\s+(.+)")
SUB_ALONE, MAIN_ALONE, MAIN_TITLE = re.compile(r"\d+(?:\.\d+)+"), re.compile(r"\d+"), re.compile(r"[A-Z][A-Z0-9 /\-(),]+")
LEADER = "...."
LEAST_LETTERS = 8
# --- end of fixed values

CLAUSES = "doc string, clause_no long, piece int, clause_id string, title string, section string, page_start int, text string"


def page_number(text: Column, index: Column) -> Column:
    """The number that a page's own marker names, else its place from 1."""
    return F.coalesce(F.regexp_extract(text, PAGE_MARK, 1).try_cast("int"), index.cast("int") + 1)


def split_pages(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """doc, page_index, text: pages between marker lines, blank ones left out but counted."""
    parts = F.split(F.col(text), r"\n\s*--\s+\d+\s+of\s+\d+\s+--\s*\n")
    return texts.select(doc, F.posexplode(parts).alias("page_index", "text")).filter(F.col("text").rlike(r"\S"))


def body(pages: DataFrame, starts: str | None = BODY_STARTS, stops: tuple[str, ...] = BODY_STOPS) -> DataFrame:
    """Pages (doc, page_index, page, text) from where ``starts`` first matches to before the first of ``stops``; none without a start.

    ``starts`` None begins with the first page.
    """
    rows = pages.filter(F.col("text").rlike(r"\S"))
    at = F.regexp_instr("text", F.lit(starts)) if starts else F.lit(1)
    first = rows.groupBy("doc").agg(F.min(F.when(at > 0, F.col("page_index"))).alias("_from"))
    rows = rows.join(first, "doc").filter(F.col("page_index") >= F.col("_from"))
    rows = rows.withColumn("text", F.when(F.col("page_index") == F.col("_from"), F.substr("text", at)).otherwise(F.col("text")))
    stop = F.least(*[F.when(F.instr("text", s) > 0, F.instr("text", s)) for s in stops], F.lit(None).cast("int"))
    last = rows.withColumn("_stop", stop).groupBy("doc").agg(F.min(F.when(F.col("_stop").isNotNull(), F.col("page_index"))).alias("_to"))
    rows = rows.withColumn("_stop", stop).join(last, "doc").filter(F.col("_to").isNull() | (F.col("page_index") <= F.col("_to")))
    rows = rows.withColumn("text", F.when(F.col("_stop").isNotNull(), F.substring("text", F.lit(1), F.col("_stop") - 1)).otherwise(F.col("text")))
    return rows.filter(F.col("text").rlike(r"\S")).select("doc", "page_index", "page", "text")


def is_noise(line: Column) -> Column:
    """Lines of licences, page feet and covers."""
    out = F.lit(False)
    for p in NOISE:
        out = out | line.rlike(p)
    for s in NOISE_STARTS:
        out = out | line.startswith(s)
    return out


def stripped(pages: DataFrame) -> DataFrame:
    """doc, page_index, page, text: page numbers, and texts of lines with white space collapsed, without noise lines."""
    rows = pages.select("doc", "page_index", page_number(F.col("text"), F.col("page_index")).alias("page"), F.split("text", "\r\n|[\n\r\x0b\x0c]").alias("_l"))
    kept = F.filter(F.transform("_l", collapse), lambda x: ~is_noise(x))
    return rows.select("doc", "page_index", "page", F.array_join(kept, "\n").alias("text"))


def page_lines(pages: DataFrame) -> DataFrame:
    """doc, page_index, page, line_no, line: lines that are not blank and no heading of the other language."""
    rows = pages.select("doc", "page_index", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.filter((F.col("line") != "") & ~F.col("line").isin(*OTHER_HEADINGS))


def heading(line: str) -> tuple[str, str, bool] | None:
    """(id, title, whether it opens a section) of a line that holds both; an empty id marks a row of a table of contents."""
    if m := MAIN.fullmatch(line):
        return m[1], m[2].strip(), True
    if m := SUB.fullmatch(line):
        return ("" if LEADER in m[2] else m[1]), m[2].strip(), False
    return None


def takes(line: str, following: str | None) -> bool:
    """Whether a number that stands alone takes the following line of its page as its title."""
    if not following:
        return False
    if SUB_ALONE.fullmatch(line):
        return not SUB_ALONE.fullmatch(following)
    return bool(MAIN_ALONE.fullmatch(line) and MAIN_TITLE.fullmatch(following))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(range, its lines as (doc, page, line)) one after the other."""
    rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("_part", "doc", "page", "line")), strict=True))
    for part, group in groupby(rows, lambda r: r[0]):
        yield part, (r[1:] for r in group)


def _walk(lines: Iterator[tuple], after: tuple | None, taken: bool) -> Iterator[tuple]:
    """(line, heading or None, whether it was taken, whether the next one is) of each line; ``after`` follows the last."""
    line = next(lines, None)
    while line is not None:
        following = next(lines, None)
        then = following or after
        same = then is not None and then[:2] == line[:2]
        takes_next = not taken and same and takes(line[2], then[2])
        found = None
        if not taken:
            found = (line[2], then[2], bool(MAIN_ALONE.fullmatch(line[2]))) if takes_next else heading(line[2])
        yield line, found, taken, takes_next
        line, taken = following, takes_next


class _State:
    """The clause that a line belongs to."""

    def __init__(self, doc=None, id_=None, title=None, section="", page=None):
        self.doc, self.id, self.title, self.section, self.page = doc, id_, title, section, page

    def meet(self, line: tuple, found: tuple | None) -> bool:
        """Goes on with a line; whether it opens a clause."""
        if line[0] != self.doc:
            self.__init__(line[0])
        if not found or not found[0]:
            return False
        self.id, self.title, self.page = found[0], found[1], line[1]
        self.section = found[1] if found[2] else self.section
        return True


def parsed(lines: DataFrame, order: tuple[str, ...] = ("page_index", "line_no")) -> DataFrame:
    """doc, clause_no, clause_id, title, text, section, page_start: the clauses of lines, those without text left out.

    A line is a heading with its title in capitals (``1 SCOPE``, which opens a section), a numbered one below it
    (``1.2 Title``), or a number alone whose title is the next line of its page. Rows of a table of contents (dot leaders)
    and other fragments are left out; lines before a document's first heading too. clause_no ascends through documents.
    """
    base = lines.select(F.col("doc").cast("string").alias("doc"), *order, F.col("page").cast("int").alias("page"), "line")
    base = base.repartitionByRange("doc", *order).sortWithinPartitions("doc", *order)
    base = settled(base.select("doc", "page", "line").withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    one = "doc string, page int, line string"
    firsts = base.groupBy("_part").agg(F.min_by(F.struct("doc", "page", "line"), "_row").alias("r"))
    heads = {r["_part"]: tuple(r.r) for r in firsts.collect()}  # one a range
    known = sorted(heads)
    after = {p: heads[q] for p, q in zip(known, known[1:], strict=False)}
    kinds = pa.schema([("_part", pa.int32()), ("taken", pa.bool_()), ("exit", pa.bool_()), ("n", pa.int64()), ("doc", pa.string()), ("doc_began", pa.bool_()), ("id", pa.string()), ("title", pa.string()), ("section", pa.string()), ("page", pa.int32())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts(batches):
            line = next(rows)
            states, n, exits = [_State(line[0], section=None) for _ in range(2)], [0, 0], [False, True]
            both = (_walk(r, after.get(part), taken) for r, taken in zip(tee(chain([line], rows)), exits, strict=True))
            for step in zip(*both, strict=True):  # side by side, so no range is held
                for k, (at, found, _, exits[k]) in enumerate(step):
                    n[k] += states[k].meet(at, found)
            ends = [{"_part": part, "taken": bool(k), "exit": exits[k], "n": n[k], "doc": s.doc, "doc_began": s.doc != line[0], "id": s.id, "title": s.title, "section": s.section, "page": s.page} for k, s in enumerate(states)]
            yield pa.RecordBatch.from_pylist(ends, kinds)

    ends = {(r["_part"], r.taken): r for r in base.mapInArrow(mapped, f"_part int, taken boolean, exit boolean, n long, {one.split(',')[0]}, doc_began boolean, id string, title string, section string, page int").collect()}
    begins, taken, count, state = {}, False, 0, _State()
    for p in known:
        begins[p] = (taken, count, (state.doc, state.id, state.title, state.section, state.page))
        e = ends[p, taken]
        if e.doc_began or e.doc != state.doc:
            state = _State(e.doc, e.id, e.title, e.section or "", e.page)
        else:
            state = _State(e.doc, *((e.id, e.title) if e.id else (state.id, state.title)), state.section if e.section is None else e.section, e.page if e.id else state.page)
        taken, count = e.exit, count + e.n

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CLAUSES.split(", ")]
        types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for part, rows in _parts(batches):
            entered, n, before = begins[part]
            state, texts, out = _State(*before), [], []

            def close() -> None:
                if state.id and texts:
                    out.append((state.doc, n, part, state.id, state.title, state.section or state.title, state.page, " ".join(texts)))
                texts.clear()

            for line, found, was_taken, _ in _walk(rows, after.get(part), entered):
                if line[0] != state.doc or found and found[0]:
                    close()
                if state.meet(line, found):
                    n += 1
                elif not was_taken and not found and state.id and line[2] not in NOT_BODY and not line[2].startswith(NOT_BODY_STARTS):
                    texts.append(line[2])
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out.clear()
            close()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    found = base.mapInArrow(pieces, CLAUSES)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), " ")
    same = [F.first(c).alias(c) for c in ("clause_id", "title", "section", "page_start")]
    return found.groupBy("doc", "clause_no").agg(*same, text.alias("text")).filter(F.trim("text") != "")


def clean_line(c: Column) -> Column:
    """Dot leaders, ligatures and bullets out; empty where nothing but a few symbols is left."""
    out = F.replace(F.replace(F.regexp_replace(c, r"\.{5,}", " "), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    out = collapse(F.replace(out, F.lit(""), F.lit(" ")))
    return F.when(out.rlike(r"^[^\p{L}\p{N}_]{1,6}$"), "").otherwise(out)


def english_only(c: Column) -> Column:
    """The cleaned line, or an empty text where letters are few or only marks of the other language are found."""
    line = clean_line(c)
    low = F.concat(F.lit(" "), F.lower(line), F.lit(" "))
    some = lambda marks: sum((low.contains(m).cast("int") for m in marks), F.lit(0)) > 0
    good = (F.length(F.regexp_replace(line, "[^A-Za-z]", "")) >= LEAST_LETTERS) & (some(ENGLISH) | ~some(ITALIAN))
    return F.when(good, line).otherwise("")


def meaningful(title: Column) -> Column:
    """Two ASCII letters at least, more than digits and signs, no dot leaders."""
    t = collapse(title)
    return (t != "") & ~t.rlike(r"^[^\p{L}]+$") & ~t.rlike(r"\.{5,}") & (F.length(F.regexp_replace(t, "[^A-Za-z]", "")) >= 2)


def id_order(c: str = "clause_id") -> Column:
    """Clause ids by their numbers: 2 before 10, 1.2 before 1.10."""
    return F.transform(F.split(c, r"\."), lambda p: p.cast("long"))


def merged(clauses: DataFrame) -> DataFrame:
    """One row a document and clause id: title, text, section, page_start, rows, valid_title, has_text.

    The longest meaningful title (else the longest) and the section that comes with it; the first page; distinct English
    texts, longest first. Ids that are no numbers with dots are left out. All rows of one id make one row.
    """
    rows = clauses.withColumns({"clause_id": F.trim("clause_id"), "title": collapse("title"), "section": collapse("section")}).filter(F.col("clause_id").rlike(r"^\d+(\.\d+)*$"))
    rank = F.struct(meaningful(F.col("title")).alias("m"), F.length("title").alias("n"), (-F.col("clause_no")).alias("first"))
    best = rows.groupBy("doc", "clause_id").agg(F.max_by("title", rank).alias("_title"), F.min("page_start").alias("page_start"), F.count("*").alias("rows"))
    rows = rows.join(best, ["doc", "clause_id"])
    own = (F.col("title") == F.col("_title")) & (F.col("section") != "")
    section = F.min_by(F.when(own, F.col("section")), F.when(own, F.col("clause_no"))).alias("_section")
    parts = rows.groupBy("doc", "clause_id", english_only(F.col("text")).alias("_t")).agg(F.min(F.struct((-F.length("text")).alias("n"), F.col("clause_no").alias("at"))).alias("o"), section)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_t") != "", F.struct("o", "_t")))), lambda x: x["_t"]), " ")
    one = rows.groupBy("doc", "clause_id").agg(section)
    out = parts.groupBy("doc", "clause_id").agg(text.alias("text")).join(one, ["doc", "clause_id"]).join(best, ["doc", "clause_id"])
    return out.select("doc", "clause_id", F.col("_title").alias("title"), "text", F.coalesce("_section", "_title").alias("section"), "page_start", "rows", meaningful(F.col("_title")).alias("valid_title"), (F.col("text") != "").alias("has_text"))


def report(clauses: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a document: before_total, after_total, duplicate_ids_before, duplicate_extra_rows_before, duplicates_resolved, removed_invalid_titles, removed_empty_text."""
    before = clauses.groupBy("doc").agg(F.count("*").alias("before_total"))
    many = F.col("rows") > 1
    after = groups.groupBy("doc").agg(
        F.count_if(F.col("valid_title") & F.col("has_text")).alias("after_total"), F.count_if(many).alias("duplicate_ids_before"), F.coalesce(F.sum(F.when(many, F.col("rows") - 1)), F.lit(0)).alias("duplicate_extra_rows_before"),
        F.count_if(many).alias("duplicates_resolved"), F.count_if(~F.col("valid_title")).alias("removed_invalid_titles"), F.count_if(F.col("valid_title") & ~F.col("has_text")).alias("removed_empty_text"),
    )
    return before.join(after, "doc")


def normalised(pages: DataFrame, starts: str | None = BODY_STARTS, stops: tuple[str, ...] = BODY_STOPS) -> tuple[DataFrame, DataFrame]:
    """(clauses, counters) of regulations given as pages (doc, page_index, text).

    Clauses: doc, clause_id, title, text, section, page_start; sort by ``id_order``. Documents in which ``starts`` is not
    found have none.
    """
    rows = settled(stripped(pages))  # read for the body's beginning and its end, and for the ranges of its lines
    raw = settled(parsed(page_lines(body(rows, starts, stops))))
    groups = merged(raw)
    kept = groups.filter("valid_title and has_text").select("doc", "clause_id", "title", "text", "section", "page_start")
    return kept, report(raw, groups)
