"""Text functions as Column expressions: tokenizers, cleaning, sentences, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values
#: Words that rule keywords leave out.
RULE_STOPWORDS = "the and for with that this from shall must should into have been will are was were has had not its their than then also when where which while under over such each".split()
#: Words that title tokens leave out.
TITLE_STOPWORDS = "and with the for level check through its via that this from into test".split()
MODALS = ("MUST", "SHALL", "SHOULD")
CONFIDENCE = {"MUST": 0.97, "SHALL": 0.94, "SHOULD": 0.83}
#: Category and its words, the first that fits.
CATEGORIES = (
    ("verification_and_testing", ("test", "verification", "validation", "evidence", "report")),
    ("traceability_and_requirements", ("traceability", "requirement", "configuration")),
    ("lifecycle_engineering", ("maintenance", "integration", "architecture", "design")),
    ("safety_assurance", ("safety", "integrity", "hazard", "risk")),
)
OTHER_CATEGORY = "general_compliance"
#: Words of a line that mark a failed or a passed outcome.
FAIL_LINE = r"(?i)\bfail(ed|ure)?\b|✗"
PASS_LINE = r"(?i)\bpass(ed)?\b|✓|✔|\bok\b"
# --- end of fixed values


def blank_to_null(c) -> Column:
    """Trimmed text, null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def collapse(c) -> Column:
    """White space runs as one space, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def normalise_status(c) -> Column:
    return F.upper(collapse(c))


def clean_title(c) -> Column:
    """Curly double quotes go, curly single ones become plain; white space collapses."""
    c = F.col(c) if isinstance(c, str) else c
    return collapse(F.translate(F.coalesce(c, F.lit("")), "‘’“”", "''"))


# --- fixed value: what a requirement id looks like
REQUIREMENT_ID = r"(?i)\b(?:C6-[A-Z0-9]+-\d+|C6_[A-Z0-9]+_\d+)\b"
# --- end of fixed values


def ids(c, pattern: str = REQUIREMENT_ID) -> Column:
    """Identifiers in a text, upper case, underscores as hyphens."""
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x: F.replace(F.upper(x), F.lit("_"), F.lit("-")))


def keyword_tokens(c) -> Column:
    """Lower-case tokens that begin with an ASCII letter and are two characters or longer; with repeats."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9_\-]+"), F.lit(0)), F.lower)


def words(c) -> Column:
    """Distinct lower-case words of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def rule_tokens(c, stop=RULE_STOPWORDS) -> Column:
    """Distinct words of three or more ASCII letters and nothing else, without stop words."""
    some = F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]{3,}$"))
    return F.array_except(F.array_distinct(some), F.array(*map(F.lit, stop)))


def title_tokens(c, stop=TITLE_STOPWORDS) -> Column:
    """Lower-case tokens of three or more characters without stop words, in order, with repeats."""
    some = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), F.lower)
    return F.filter(some, lambda w: ~w.isin(*stop))


def bigrams(tokens: Column) -> Column:
    """Each two neighbours, joined by a space."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def contained(tokens: Column, text: Column) -> Column:
    """How many distinct tokens are substrings of the text, whatever its case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array_distinct(tokens), lambda t: low.contains(t)))


def has_term(text: Column, term: Column) -> Column:
    """Phrases and hyphenated terms as substrings, single words between word boundaries."""
    phrase = term.contains(" ") | term.contains("-")
    bounded = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])\Q"), term, F.lit(r"\E($|[^\p{L}\p{N}_])"))
    return F.when(phrase, text.contains(term)).otherwise(F.expr("true") & F.regexp_like(text, bounded))


def sentences(c) -> Column:
    """Sentences of a text whose white space is collapsed, split after . ! or ?"""
    return F.split(collapse(c), r"(?<=[.!?])\s+")


def clean_sentence(c: Column) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit("(cid:2)"), F.lit(" "))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "\\uF0B7", " "), r"\.{5,}", " "), r"\s+", " ")
    return F.btrim(out, F.lit(" -;:,"))


def is_noisy(c: Column) -> Column:
    """Licence banners, extraction artefacts, spaced letters, too few letters, dense symbols."""
    banner = c.contains("RIPRODUZIONE SU LICENZA") | c.contains("Copia concessa a") | c.contains("(cid:")
    spaced = F.lower(c).rlike(r"\bo n a i l a t i\b") | c.rlike(r"(\b[A-Za-z]\b\s+){8,}")
    few = F.length(F.regexp_replace(c, r"[^\p{L}]", "")) < 18
    dense = F.regexp_count(c, F.lit(r"[♦•\[\]\(\)\|]")) >= 6
    return (F.trim(c) == "") | banner | spaced | few | dense


def modality(c: Column, modals=MODALS) -> Column:
    """The first of ``modals`` that occurs as a word; null if none does."""
    out = F.lit(None).cast("string")
    for m in reversed(modals):
        out = F.when(c.rlike(rf"(?i)\b{m}\b"), F.lit(m)).otherwise(out)
    return out


def category(c: Column, categories=CATEGORIES, other: str = OTHER_CATEGORY) -> Column:
    low, out = F.lower(c), F.lit(other)
    for name, marks in reversed(categories):
        out = F.when(low.rlike("|".join(marks)), F.lit(name)).otherwise(out)
    return out


def rule_severity(m: Column) -> Column:
    return F.when(m.isin("MUST", "SHALL"), F.lit("HIGH")).otherwise(F.lit("MEDIUM"))


def rule_confidence(m: Column) -> Column:
    return F.when(m == "MUST", F.lit(0.97)).when(m == "SHALL", F.lit(0.94)).otherwise(F.lit(0.83))


def condition_action(s: Column, m: Column, leads: str = "if|when|where|as long as") -> tuple[Column, Column]:
    """A leading condition, up to a comma before the modal word or else up to that word, and the rest."""
    low = F.lower(s)
    at = F.regexp_instr(low, F.concat(F.lit(r"\b"), F.lower(m), F.lit(r"\b")))
    comma = F.instr(s, ",")
    by_comma = (comma > 0) & (comma < at)
    condition = F.when(by_comma, F.trim(F.substring(s, F.lit(1), comma - 1))).otherwise(F.btrim(F.substring(s, F.lit(1), at - 1), F.lit(" ,;:-")))
    action = F.when(by_comma, F.trim(F.substr(s, comma + 1))).otherwise(F.trim(F.substr(s, F.greatest(at, F.lit(1)))))
    good = (at > 0) & low.rlike(rf"^({leads})\b") & (F.length(condition) >= 6) & (action != "")
    return F.when(good, condition), F.when(good, action).otherwise(s)


def excerpt(c: Column, most: int = 360) -> Column:
    """One line, double quotes as single ones, cut at a word with an ellipsis."""
    one = F.replace(collapse(c), F.lit('"'), F.lit("'"))
    cut = F.regexp_replace(F.substring(one, 1, most - 1), " [^ ]*$", "")
    return F.when(F.length(one) <= most, one).otherwise(F.concat(cut, F.lit("…")))


#: What the pattern \s takes.
WHITE = " \t\n\x0b\f\r"


def stripped(c: Column) -> Column:
    """Without white space at both ends; a pattern would look at every character."""
    return F.btrim(c, F.lit(WHITE))


def shortened(c: Column, most: int) -> Column:
    """At most ``most`` characters, the last three of them dots where text was cut."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3), F.lit(WHITE)), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(c) + 3) / 4)).cast("int")


def outcome(line: Column, fail: str = FAIL_LINE, good: str = PASS_LINE) -> Column:
    """FAIL, PASS or UNKNOWN of a text; FAIL beats PASS."""
    return F.when(line.rlike(fail), "FAIL").when(line.rlike(good), "PASS").otherwise("UNKNOWN")


def html_text(c: Column) -> Column:
    """Tags as spaces, white space collapsed."""
    return collapse(F.regexp_replace(c, "<[^>]*>", " "))
