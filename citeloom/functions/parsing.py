"""Field parsers, one per convention in use; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import strip

STRING = r"""(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')"""
LITERAL = rf"(?s)^\[\s*+(?:{STRING}(?:\s*+,\s*+{STRING})*+\s*+,?\s*+)?\]$"

# Keywords that carry no topic, words that carry none in running text, words that mark a
# conference, and the patterns (with the group to take) of DOIs in running text.
KEYWORD_STOPS = (
    "review", "studies", "study", "analysis", "method", "methods", "approach", "approaches", "framework", "model", "system", "based", "using", "via",
    "case study", "research", "development",
)
TEXT_STOPS = (
    "the", "and", "for", "with", "that", "this", "these", "those", "from", "have", "has", "had", "were", "was", "are", "is", "be", "been", "being", "by", "in", "on", "at",
    "to", "of", "a", "an", "as", "or", "but", "not", "it", "its", "they", "them", "their", "we", "our", "you", "your", "he", "she", "his", "her", "my", "mine", "us", "ours",
)
CONFERENCE_WORDS = ("CONFERENCE", "PROCEEDINGS", "SYMPOSIUM", "MEETING", "CONGRESS", "WORKSHOP", "PROC.", "CONF.", "SYMP.")
DOI_PATTERNS = ((r"(?i)DOI\s+([^\s;,\]]+)", 1), (r"(?i)doi:\s*([^\s;,\]]+)", 1), (r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+", 0))


def empty() -> Column:
    return F.array().cast("array<string>")


def is_literal(c: Column) -> Column:
    """A list of quoted strings, as list texts write it; a trailing comma is allowed."""
    return c.rlike(LITERAL)


def literal_items(c: Column) -> Column:
    """The strings of a literal list, escapes resolved; null if `c` is none."""
    bare = F.transform(F.regexp_extract_all(c, F.lit(f"(?s){STRING}"), F.lit(0)), lambda x: x.substr(F.lit(2), F.length(x) - 2))
    plain = F.transform(bare, lambda x: F.regexp_replace(F.replace(x, F.lit("\\t"), F.lit("\t")), r"(?s)\\(.)", "$1"))
    return F.when(is_literal(c), F.when(c.contains("\\"), plain).otherwise(bare))


def _parts(c: Column, pattern: str, lower: bool = True) -> Column:
    parts = F.transform(F.split(c, pattern, -1), lambda x: F.lower(strip(x)) if lower else strip(x))
    return F.filter(parts, lambda x: x != "")


def keywords_by_first_separator(c: Column) -> Column:
    """OP-19: literal items as they are; else split at the first of `; , | 、` that occurs; null gives none."""
    out = F.when(c.isNull(), empty()).when(is_literal(c), literal_items(c))
    for sep, pattern in ((";", ";"), (",", ","), ("|", r"\|"), ("、", "、")):
        out = out.when(c.contains(sep), _parts(c, pattern))
    return out.otherwise(F.array(F.lower(strip(c))))


def keywords_without_stops(c: Column, stops: tuple[str, ...] = KEYWORD_STOPS) -> Column:
    """OP-20: sorted distinct keywords without stop words and single letters; a broken list is one keyword."""
    text = strip(c)
    boxed = text.startswith("[") & text.endswith("]")
    items = F.filter(F.transform(literal_items(text), lambda x: F.lower(strip(x))), lambda x: x != "")
    out = F.when(c.isNull(), empty()).when(boxed & is_literal(text), items).when(boxed, F.array(F.lower(text))).otherwise(_parts(text, "[;,]"))
    kept = F.filter(out, lambda x: (F.length(x) > 1) & ~x.isin(*stops))
    return F.array_sort(F.array_distinct(kept))


def keywords_by_comma_or_semicolon(c: Column) -> Column:
    """OP-21: literal items as they are, else split at comma and semicolon."""
    return F.when(c.isNull(), empty()).when(is_literal(c), literal_items(c)).otherwise(_parts(c, "[,;]"))


def keywords_of_themes(c: Column, on_bad_literal: str = "none") -> Column:
    """OP-22, OP-23: semicolons if there is one, else commas; a broken list gives none, or itself as one keyword with `on_bad_literal="whole"`."""
    if on_bad_literal not in ("none", "whole"):
        raise ValueError(on_bad_literal)
    bad = empty() if on_bad_literal == "none" else F.array(F.lower(strip(c)))
    items = F.filter(F.transform(literal_items(c), lambda x: F.lower(strip(x))), lambda x: x != "")
    return (
        F.when(c.isNull(), empty()).when(c.startswith("[") & is_literal(c), items).when(c.startswith("["), bad)
        .when(c.contains(";"), _parts(c, ";")).otherwise(_parts(c, ","))
    )


def categories_list(c: Column) -> Column:
    """OP-24: literal items, else split at the first of `; | /`, else the whole text; commas belong to names; a broken list gives none."""
    text = strip(c)
    boxed = text.startswith("[") & text.endswith("]")
    out = F.when(c.isNull(), empty()).when(boxed, F.coalesce(literal_items(text), empty()))
    for sep, pattern in ((";", ";"), ("|", r"\|"), ("/", "/")):
        out = out.when(text.contains(sep), _parts(text, pattern, lower=False))
    return out.otherwise(F.array(text))


def refs_of_literal(c: Column) -> Column:
    """OP-25: distinct items of a literal list, none for anything else."""
    return F.array_distinct(refs_with_repeats(c))


def refs_with_repeats(c: Column) -> Column:
    """OP-27: items of a literal list as they stand, none for anything else."""
    return F.coalesce(literal_items(c), empty())


def refs_lenient(c: Column) -> Column:
    """OP-26: literal items with repeats; else brackets and quotes dropped and split at commas."""
    rough = F.regexp_replace(F.regexp_replace(c, r"^[\[\]]++|[\[\]]++$", ""), "['\"]", "")
    return F.when(c.isNull() | c.isin("", "[]"), empty()).when(is_literal(c), literal_items(c)).otherwise(_parts(rough, ",", lower=False))


def dois_of_text(c: Column) -> Column:
    """OP-15: distinct DOIs of free reference text, sorted, case kept; three patterns, so one DOI may come out whole and cut."""
    hits = F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(g)) for p, g in DOI_PATTERNS))
    clean = F.transform(hits, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\[++", ""), r"[,;\]]++$", ""))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.startswith("10.") & (F.length(x) > 10)))), empty())


def bare_doi(c: Column) -> Column:
    """OP-28: trimmed, without one leading resolver or `doi:` prefix; case kept."""
    return F.regexp_replace(strip(c), r"^(?:https?://doi\.org/|doi:)", "")


def clean_text(c: Column) -> Column:
    """OP-29: lower-case words without links, digits and punctuation; null gives the empty text."""
    text = F.regexp_replace(F.lower(c), r"http[^\s\p{Z}]+|www[^\s\p{Z}]+", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\p{Nd}+", ""), r"[^\p{L}\p{N}_\s]", " ")
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def is_conference(c: Column) -> Column:
    """OP-16: the title holds a conference word or a year from 2000 on; null is none."""
    title = F.upper(c)
    hit = title.rlike("20[0-9]{2}")
    for word in CONFERENCE_WORDS:
        hit = hit | title.contains(word)
    return F.coalesce(hit, F.lit(False))


def year_of(c: Column) -> Column:
    """INT of a year typed as integer or decimal; null for anything else."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(r"^[0-9]{1,9}(\.[0-9]*)?$"), F.regexp_extract(text, "^[0-9]+", 0).try_cast("int"))


def shortened(c: Column, most: int) -> Column:
    """OP-35: labels longer than `most` cut and marked with dots."""
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def percent(c: Column, factor: float) -> Column:
    """OP-33: scores on the scale the reports use (100, 600, 500 or 5); null counts 0."""
    return F.coalesce(c, F.lit(0.0)) * F.lit(float(factor))
