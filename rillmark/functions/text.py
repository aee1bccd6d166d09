"""Text functions as Catalyst expressions: folding, tokens, citations, line kinds.

All are built-in JVM expressions; none needs a Python worker.  Regular expressions use
explicit ASCII classes after folding, or ``(?U)`` where Unicode word characters count.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """One-to-one folds of the Latin letters with marks, from their decompositions."""
    pairs = []
    for code in [*range(0x00DF, 0x0250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c and c == c.lower():
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()
#: Combining marks, as a Java character class.
MARKS = "\\u0300-\\u036F\\u1AB0-\\u1AFF\\u20D0-\\u20FF"


def fold(c: Column) -> Column:
    """Lower case without diacritics: letters with marks become plain ones, loose marks go."""
    return F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), f"[{MARKS}]", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """Folded, with single spaces."""
    return collapse(fold(c))


def nfkc(c: Column) -> Column:
    """Unicode's compatibility form.  No built-in function makes it, so this is an Arrow UDF:
    for requests, not for a corpus."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def query_normalize(c: Column) -> Column:
    """Compatibility form in lower case with single spaces, diacritics kept (the query side)."""
    return collapse(F.lower(nfkc(c)))


def tokens(c: Column) -> Column:
    """Runs of folded letters and digits."""
    return F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))


def bm25_tokens(c: Column) -> Column:
    """Numbers of up to six digits, and words of two or more letters."""
    return F.regexp_extract_all(fold(c), F.lit("[0-9]{1,6}|[a-z]{2,}"), F.lit(0))


def words(c: Column, longer_than: int = 0) -> Column:
    """Unicode words, without the short ones."""
    found = F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(found, lambda w: F.length(w) > longer_than) if longer_than else found


def overlap_ratio(query: Column, text: Column) -> Column:
    """Share of the distinct query tokens that the text's tokens hold; 0 without any."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, text)) / F.size(q)).otherwise(F.lit(0.0))


# Citations and paragraphs --------------------------------------------------

PARAGRAPH = r"§+\s*([0-9]+[a-zA-Z]?)"
CITATION = r"([0-9]{1,4})\s*/\s*([0-9]{4})"


def paragraphs(c: Column) -> Column:
    """The distinct paragraph numbers that a text names, in order, letters kept."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(PARAGRAPH), F.lit(1)))


def payload_paragraphs(paragraph: Column, text: Column, fragment_id: Column) -> Column:
    """Paragraphs of a chunk: its own, those in its text, those in its fragment's id."""
    own = F.when(F.coalesce(paragraph, F.lit("")) != "", F.array(paragraph)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(1)), F.regexp_extract_all(F.coalesce(fragment_id, F.lit("")), F.lit("(?i)/par_([0-9]+[a-z]?)"), F.lit(1))))


def citations(c: Column) -> Column:
    """The law iris of the citations number/year in a text, distinct, in order."""
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(CITATION), F.lit(1)).alias("n"), F.regexp_extract_all(c, F.lit(CITATION), F.lit(2)).alias("y"))
    return F.array_distinct(F.transform(pairs, lambda p: law_iri(p["n"], p["y"])))


def law_iri(number: Column, year: Column) -> Column:
    return F.concat(F.lit("local:sb/"), year, F.lit("/"), number)


def iri_of_citation(c: Column) -> Column:
    """The iri of "number/year ..."; other texts keep their safe characters."""
    text = F.trim(c)
    number, year = F.regexp_extract(text, "^([0-9]+)/([0-9]{4})", 1), F.regexp_extract(text, "^([0-9]+)/([0-9]{4})", 2)
    return F.when(number != "", law_iri(number, year)).otherwise(F.concat(F.lit("local:sb/"), F.regexp_replace(text, "[^a-zA-Z0-9_/]", "_")))


def iri_to_filename(iri: Column) -> Column:
    """"number/year Sb." of a law's iri; others as they are."""
    pattern = "^local:sb/([0-9]{4})/([0-9]+)$"
    year, number = F.regexp_extract(iri, pattern, 1), F.regexp_extract(iri, pattern, 2)
    return F.when(year != "", F.concat(number, F.lit("/"), year, F.lit(" Sb."))).otherwise(iri)


def fragment_number(fragment_id: Column) -> Column:
    """The number that ends a fragment's id, or null."""
    return F.nullif(F.regexp_extract(fragment_id, "/([0-9]+)$", 1), F.lit("")).try_cast("bigint")


def parse_query(c: Column) -> Column:
    """Lower case; "n / yyyy" and "paragraf n" in their usual spelling; single spaces."""
    text = F.lower(F.trim(c))
    text = F.regexp_replace(text, r"\b([0-9]{1,4})\s*/\s*([0-9]{4})\b", "$1/$2")
    text = F.regexp_replace(text, r"\bparagraf\s+([0-9]+)\b", "§ $1")
    return collapse(F.regexp_replace(text, r"§\s*([0-9]+)", "§ $1"))


def is_bare_paragraph(c: Column) -> Column:
    return F.trim(c).rlike(r"^§\s*[0-9]+[a-zA-Z]*$")


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


# Kinds of lines ------------------------------------------------------------

#: Line patterns of Czech statutes.  The reranker knows part prefixes before
#: an act's name, the answer filter does not.
_ACT = r"(?:z[aá]kon|na[rř][íi]zen[íi]|vyhl[áa][šs]ka|sd[eě]len[íi])"
INDEX_LINE = rf"(?iU)^\d{{1,3}}\.\s+(?:(?:část|hlava|díl)\s+\w+\s+)?{_ACT}"
INDEX_LINE_PLAIN = rf"(?iU)^\d{{1,3}}\.\s+{_ACT}"
SECTION_HEADING = r"(?iU)^(?:část|hlava|díl|oddíl|pododdíl|kapitola)\b"
AMENDMENT_LINE = r"(?iU)(?:z[aá]kon|na[rř][íi]zen[íi](?:\s+vl[aá]dy)?|vyhl[áa][šs]ka|sd[eě]len[íi])\s+č\."
PURE_REFERENCE = (
    r"(?iU)^(?:§\s*\d+[a-z]?(?:\s+odst\.\s*\d+)?(?:\s+(?:a|nebo|,)\s*§\s*\d+[a-z]?)*"
    r"|odstavce?\s+\d+(?:\s+(?:a|nebo|,)\s*\d+)*"
    r"|písmene?\s+[a-z]\)(?:\s+(?:a|nebo)\s+[a-z]\))*)\s*[,.]?$"
)
#: Verb forms that show a line to be more than a heading.
VERBS = "je jsou má ma musí musi může muze lze činí cini obsahuje obsahovat upravuje vzniká vznika zaniká zanika trvá trva skončí skonci".split()
VERBS_CROSS = "je jsou musi musí muze může lze byla byly byl cini činí obsahuje obsahovat skonci skončí zacina začíná konci končí upravuje má ma vzniká vznika zaniká zanika trvá trva".split()
SUBSTANTIVE_VERBS = "je jsou má může musí lze byl byla bylo byli stanoví upravuje určuje zakazuje ukládá přísluší vzniká zaniká trvá skončí".split()


def contains_any(c: Column, parts: list[str]) -> Column:
    """One alternation, so a text is scanned once however long the list."""
    return c.rlike("|".join("\\Q" + p + "\\E" for p in parts))


def looks_like_heading(c: Column, verbs: list[str]) -> Column:
    n = F.regexp_count(c, F.lit(r"(?U)\w+"))
    return (n > 0) & (n <= 12) & (F.length(c) < 120) & ~c.rlike("[.!?;:]") & ~contains_any(F.lower(c), verbs)


def is_all_caps(c: Column) -> Column:
    letters = F.regexp_replace(c, "[^A-Za-zÀ-ž]", "")
    return (letters != "") & (letters == F.upper(letters))


def structural_penalty(text: Column, verbs: list[str] = VERBS, heading: float = 0.35, most: float = 0.85, references: bool = True) -> Column:
    """What a chunk loses for being an index line, an amendment line, a section heading, a
    heading (more in capitals) or, if nothing else, a mere cross-reference."""
    v = F.trim(F.coalesce(text, F.lit("")))
    line = F.when(v.rlike(INDEX_LINE), 0.55).when(v.rlike(AMENDMENT_LINE) & (F.length(v) < 140), 0.35).otherwise(0.0)
    section = F.when(v.rlike(SECTION_HEADING), 0.45).otherwise(0.0)
    head = F.when(looks_like_heading(v, verbs), heading + F.when(is_all_caps(v), 0.15).otherwise(0.0)).otherwise(0.0)
    total = line + section + head
    if references:
        total = F.when((total == 0) & v.rlike(PURE_REFERENCE), 0.25).otherwise(total)
    return F.when(v == "", 0.0).otherwise(F.least(total, F.lit(most)))


def cross_encoder_penalty(text: Column) -> Column:
    """The variant beside the cross encoder: other verbs, 0.40 for headings, 0.90 at most."""
    return structural_penalty(text, VERBS_CROSS, 0.40, 0.90, references=False)


def heading_boost(text: Column, query_tokens: Column, in_law: Column, mode: Column) -> Column:
    """0.18 for a legal institute's heading that shares a word with a topic query."""
    v = F.trim(F.coalesce(text, F.lit("")))
    fits = (mode != "exact_lookup") & in_law & (v != "") & ~v.rlike(SECTION_HEADING) & ~v.rlike(INDEX_LINE) & looks_like_heading(v, VERBS)
    return F.when(fits & F.arrays_overlap(F.split(normalize(v), " "), query_tokens), 0.18).otherwise(0.0)


def is_substantive(text: Column) -> Column:
    """Worth citing: 30 characters or more, no index line or section heading, and with a
    digit, a verb or a conditional form."""
    v = F.trim(F.coalesce(text, F.lit("")))
    says = v.rlike("[0-9]") | v.rlike(rf"(?iU)\b(?:{'|'.join(SUBSTANTIVE_VERBS)})\b|\w+-li\b")
    return (F.length(v) >= 30) & ~v.rlike(INDEX_LINE_PLAIN) & ~v.rlike(SECTION_HEADING) & says


# Pieces of texts -----------------------------------------------------------


def preview(c: Column, limit: int = 280) -> Column:
    """Single spaces, cut to the limit with an ellipsis."""
    text = collapse(c)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("...")))


def first_sentence(c: Column) -> Column:
    return F.trim(F.substring_index(c, ".", 1))


def facts(c: Column) -> Column:
    """Up to five statements, split at full stops, semicolons and lines."""
    parts = F.filter(F.transform(F.split(c, r"[.;]\s+|\n+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.slice(parts, 1, 5)).otherwise(F.array(F.trim(c)))


def sentences(c: Column, at_least: int = 30) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= at_least)


def strip_tags(c: Column) -> Column:
    """Tags to spaces, white space collapsed."""
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def cut(c: Column, limit: int = 600) -> Column:
    v = F.trim(c)
    return F.when(F.length(v) > limit, F.concat(F.rtrim(F.substring(v, 1, limit)), F.lit(" …"))).otherwise(v)


def script_country(query: Column, country: Column) -> Column:
    """The jurisdiction: as given, else by script."""
    return F.coalesce(country, F.when(query.rlike("[\\u0400-\\u04ff]"), F.lit("russia")).otherwise(F.lit("czechia")))
