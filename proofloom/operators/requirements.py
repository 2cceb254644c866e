"""Requirement entries from documents: context lines, extractors, retrieval queries, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.expansion import expanded
from . import needles

# --- fixed values
OBJECTIVE = r"(?i)test\s*objective|test\s*purpose|objective\s*:"
EXPECTED = r"(?i)expected\s*result|pass\s*criteria|acceptance\s*criteria"
STATUS = r"(?i)\b(passed|failed|not\s+tested|n/?a|complete|verified)\b"
BEFORE, AFTER, EXCERPTS, LINE = 2, 5, 10, 280
#: Words that a clause search gets for each type of anomaly.
HINTS = (
    (("MISSING_TEST_DESIGN_EVIDENCE",), "software requirements specification test specification documentation evidence clause 8 10 12"),
    (("DOC_EVIDENCE_FAIL", "LOG_FAIL_VS_VERIFIED_REQUIREMENT"), "test report validation verification failure result record clause 11 13"),
    (("WEAK_VERIFICATION_SIGNAL",), "verification evidence incomplete traceability clause 6 8"),
    (("LOG_FAIL_VS_DOC_PASS",), "discrepancy test log verification report clause 11 12 13"),
    (("METRICS_REPORT_FAILED_TESTS",), "failed tests metrics safety integrity level clause 13 17"),
)
HINTS_HEAD = "CEI EN 50128 railway software safety compliance"
CITED = 8
TITLE = 500
# --- end of fixed values


def frames(lines: DataFrame, hit: Column, key: str = "doc_id", before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Lines within ``before`` and ``after`` rows of a line that hits: key, line_no, line, with the nearest hit's number.

    Blank lines count as rows and are left out at the end.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    near = F.max(F.when(hit, F.col("line_no"))).over(order.rowsBetween(-after, before))
    return lines.withColumn("hit_line", near).filter(F.col("hit_line").isNotNull() & (F.trim("line") != ""))


def excerpts(lines: DataFrame, hit: Column, title: Column | None = None, key: str = "doc_id", most: int = EXCERPTS) -> DataFrame:
    """key and its excerpts: context lines of hits, and lines with two or more title words, each text once, in order."""
    order = Window.partitionBy(key).orderBy("line_no")
    near = F.max(hit.cast("int")).over(order.rowsBetween(-AFTER, BEFORE)) == 1
    words = F.slice(T.title_tokens(title), 1, 8) if title is not None else F.array().cast("array<string>")
    low = F.lower("line")
    lined = F.size(F.filter(words, lambda w: low.contains(w))) >= 2
    rows = lines.withColumns({"_near": F.coalesce(near, F.lit(False)), "_words": lined, "line": F.trim("line")}).filter((F.col("_near") | F.col("_words")) & (F.col("line") != ""))
    once = rows.groupBy(key, "line").agg(F.min("line_no").alias("line_no"), F.bool_or("_near").alias("_near"))
    kept = once.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    cue = lambda p: F.min_by(F.when(F.col("_near") & F.col("line").rlike(p), F.substring("line", 1, 200)), F.when(F.col("_near") & F.col("line").rlike(p), F.col("line_no")))
    parts = F.sort_array(F.collect_list(F.struct("line_no", F.substring("line", 1, LINE).alias("t"))))
    return kept.groupBy(key).agg(
        F.transform(parts, lambda x: x["t"]).alias("excerpts"), cue(OBJECTIVE).alias("test_objective"), cue(EXPECTED).alias("expected_result"),
        F.lower(F.regexp_extract(cue(STATUS), STATUS, 1)).alias("verification_status"),
    )


def own(lines: Column, target: Column, pattern: str) -> Column:
    """Lines that name the target or no id at all."""

    def good(line):
        found = F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.upper)
        return (F.size(found) == 0) | F.array_contains(found, F.upper(target))

    return F.filter(lines, good)


def entry(rid: Column, title: Column, status: Column, lines: Column, objective: Column, expected: Column) -> Column:
    """The text that is indexed for a requirement; its title comes twice, with synonyms if it has any."""
    more = expanded(title)
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", F.concat(F.lit("Requirement ID: "), rid), F.concat(F.lit("Requirement title: "), title), part("Title restated", title), F.when(more != F.trim(title), part("Synonyms", more)), part("Verification status", status), F.when(F.size(lines) > 0, F.concat(F.lit("Evidence:\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  "), x)), "\n"))), part("Test objective", objective), part("Expected result", expected))


def entries(reqs: DataFrame, lines: DataFrame, pattern: str) -> DataFrame:
    """(requirement_id, title, content): what is indexed of each distinct requirement that the lines name.

    reqs: requirement_id, title; lines: doc, line_no, line. All ids are looked for in one look at each line; hits then fetch
    their context by line number.
    """
    first = reqs.filter(F.trim("requirement_id") != "").groupBy(F.upper(F.trim("requirement_id")).alias("_u")).agg(F.min(F.struct("requirement_id", "title")).alias("r")).select("r.*")
    met = needles.find(first.select(F.col("requirement_id").alias("needle")), lines, ["doc", "line_no"], text="line")
    hits = met.join(first, F.lower("requirement_id") == F.col("needle")).select("requirement_id", "doc", F.explode(F.sequence(F.col("line_no") - BEFORE, F.col("line_no") + AFTER)).alias("line_no")).distinct()
    near = hits.join(lines.withColumn("line", F.trim("line")), ["doc", "line_no"]).filter("line <> ''")
    place = F.struct("doc", "line_no")
    once = near.groupBy("requirement_id", "line").agg(F.min(place).alias("o"))
    kept = once.withColumn("_r", F.row_number().over(Window.partitionBy("requirement_id").orderBy("o"))).filter(F.col("_r") <= EXCERPTS)
    cue = lambda p: F.min_by(F.when(F.col("line").rlike(p), F.substring("line", 1, 200)), F.when(F.col("line").rlike(p), F.col("o")))
    found = kept.groupBy("requirement_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", F.substring("line", 1, LINE).alias("t")))), lambda x: x["t"]).alias("lines"), cue(OBJECTIVE).alias("objective"), cue(EXPECTED).alias("expected"), F.regexp_extract(cue(STATUS), STATUS, 1).alias("status"))
    out = first.join(found, "requirement_id")
    return out.select("requirement_id", "title", entry(F.col("requirement_id"), F.col("title"), F.col("status"), own(F.col("lines"), F.col("requirement_id"), pattern), F.col("objective"), F.col("expected")).alias("content"))


def paragraph_titles(paragraphs: DataFrame, pattern: str | None = None, text: str = "text", order: str = "ord") -> DataFrame:
    """requirement_id and the paragraphs that name it, each once, in order, cut at 2000 characters."""
    line = T.collapse(F.col(text))
    found = paragraphs.select(F.substring(line, 1, 2000).alias("t"), F.col(order).alias("o"), F.explode(F.array_distinct(T.ids(line, pattern) if pattern else T.ids(line))).alias("requirement_id"))
    once = found.groupBy("requirement_id", "t").agg(F.min("o").alias("o"))
    return once.groupBy("requirement_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), " | ").alias("title"))


def matrix(rows: DataFrame, key: str, cells: str = "cells", pattern: str | None = None) -> DataFrame:
    """requirement_id and title of a verification matrix: tables whose first row says test case and requirements.

    rows: key, table_no, row_no, cells. Titles of one id are joined in order, each once.
    """
    head = Window.partitionBy(key, "table_no").orderBy("row_no")
    first = F.first(cells).over(head)
    fits = F.lower(F.get(first, 0)).contains("test case") & F.lower(F.trim(F.get(first, 2))).startswith("requirements")
    body = rows.withColumn("_fits", fits).filter(F.col("_fits") & (F.size(cells) >= 3) & (F.trim(F.get(cells, 1)) != ""))
    ids = T.ids(F.get(F.col(cells), 2), pattern) if pattern else T.ids(F.get(F.col(cells), 2))
    found = body.select(key, "table_no", "row_no", T.collapse(F.get(F.col(cells), 1)).alias("title"), F.explode(ids).alias("requirement_id"))
    once = found.groupBy("requirement_id", "title").agg(F.min(F.struct(key, "table_no", "row_no")).alias("o"))
    return once.groupBy("requirement_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "title"))), lambda x: x["title"]), " | ").alias("title"))


def fallback_titles(rows: DataFrame, cells: str = "cells", order: str = "ord", pattern: str | None = None) -> DataFrame:
    """requirement_id and its longest cell without the id, of more than 12 characters; else the whole row."""
    line = F.concat_ws(" | ", F.col(cells))
    found = rows.withColumn("_line", line).withColumn("_id", F.explode(T.ids(line, pattern) if pattern else T.ids(line)))
    fit = F.filter(cells, lambda c: ~F.upper(c).contains(F.col("_id")) & (F.length(c) > 12))
    best = F.aggregate(fit, F.lit(""), lambda a, c: F.when(F.length(c) > F.length(a), c).otherwise(a))
    text = F.when(best != "", best).otherwise(F.col("_line"))
    return found.groupBy(F.col("_id").alias("requirement_id")).agg(F.substring(F.max_by(text, F.struct(F.length(text), -F.col(order))), 1, 2000).alias("title"))


def from_document(cells: DataFrame, paragraphs: DataFrame, pattern: str | None = None, status: str = "PLANNED") -> DataFrame:
    """requirement_id, title, verification_status of every id that a document's tables or paragraphs name.

    cells: key, table_no, row_no, cells; paragraphs: text, ord. A title joins what the verification matrix, the paragraphs
    and the fullest table row say, in that order, each once, cut at 500 characters. Ids are the union of the three; sort
    them by ``matching.id_sort_key``.
    """
    key = next(c for c in cells.columns if c not in ("table_no", "row_no", "cells"))
    rows = cells.withColumn("ord", F.struct(key, "table_no", "row_no"))
    number = F.row_number().over(Window.partitionBy(key, "table_no").orderBy("row_no"))
    parts = [matrix(cells, key, pattern=pattern), paragraph_titles(paragraphs, pattern), fallback_titles(rows.withColumn("ord", number), pattern=pattern)]
    every = None
    for n, df in enumerate(parts):
        one = df.select("requirement_id", F.lit(n).alias("part"), F.posexplode(F.split("title", r" \| ") if n < 2 else F.array("title")).alias("place", "t"))
        every = one if every is None else every.unionByName(one)
    clean = T.collapse(F.replace(T.clean_title(F.col("t")), F.lit('"'), F.lit("")))
    once = every.withColumn("t", clean).filter("t <> ''").groupBy("requirement_id", "t").agg(F.min(F.struct("part", "place")).alias("o"))
    ids = every.select("requirement_id").distinct()
    titles = once.groupBy("requirement_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), " | ").alias("title"))
    title = F.coalesce("title", F.lit(""))
    short = F.when(F.length(title) > TITLE, F.concat(F.substring(title, 1, TITLE - 3), F.lit("..."))).otherwise(title)
    return ids.join(titles, "requirement_id", "left").select("requirement_id", short.alias("title"), F.lit(status).alias("verification_status"))


def clause_query(types: Column, ids: Column, text: Column) -> Column:
    """A search text for clauses: words for the types of anomaly, up to five ids, and the head of the anomaly text."""
    hints = [F.when(F.arrays_overlap(types, F.array(*map(F.lit, kinds))), F.lit(words)) for kinds, words in HINTS]
    some = F.when(F.size(ids) > 0, F.concat(F.lit("requirements: "), F.array_join(F.slice(ids, 1, 5), " ")))
    return F.trim(F.concat_ws(" ", F.lit(HINTS_HEAD), *hints, some, F.when(F.trim(text) != "", F.substring(text, 1, 300))))


def citations(retrieved: DataFrame, clauses: DataFrame, language: DataFrame, by: str, most: int = CITED) -> DataFrame:
    """Up to ``most`` hits of retrieval and of clauses, and of the first six language hits those that are no risk."""
    first = lambda df, n: df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("ord"))).filter(F.col("_r") <= n).drop("_r")
    a = first(retrieved, most).select(by, F.lit("retrieval").alias("kind"), "ord", F.substring("text", 1, 220).alias("text"))
    b = first(clauses, most).select(by, F.lit("regulatory_clause").alias("kind"), "ord", F.col("title").alias("text"))
    c = first(language, 6).filter(F.col("strength").isin("strong", "medium")).select(by, F.lit("derogation_language").alias("kind"), "ord", F.substring("snippet", 1, 240).alias("text"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


def language_lines(lines: DataFrame, keep: list[str], drop: list[str], letters: int = 8) -> DataFrame:
    """Lines of one language: enough ASCII letters, and not only marks of the other."""
    low = F.concat(F.lit(" "), F.lower("line"), F.lit(" "))
    count = lambda marks: sum((low.contains(m).cast("int") for m in marks), F.lit(0))
    enough = F.length(F.regexp_replace("line", "[^A-Za-z]", "")) >= letters
    return lines.filter(enough & ~((count(keep) == 0) & (count(drop) > 0)))


def body_range(lines: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """Lines from the first that matches ``start`` (else from the first line) to before the next that matches ``stop``."""
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(key)
    begin = F.coalesce(F.min(F.when(F.col("line").rlike(start), F.col("line_no"))).over(every), F.lit(0))
    rows = lines.withColumn("_b", begin).filter(F.col("line_no") >= F.col("_b"))
    return rows.withColumn("_s", F.max(F.col("line").rlike(stop).cast("int")).over(order)).filter("_s = 0").drop("_b", "_s")
