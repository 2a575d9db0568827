"""Text rules as Column expressions.

Two Arrow UDFs exist because Spark has no Unicode normal forms; they are fed
null for plain ASCII rows, so only rows that need them carry text to Python.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from alertloom import constants as K

NON_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


@F.pandas_udf(StringType())
def nfkd_ascii(s: pd.Series) -> pd.Series:
    return s.map(
        lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii")
    )


# Marked non-deterministic only to keep the optimizer from evaluating one call
# several times (filters and inferred conditions would otherwise repeat it).
nfkc_casefold = nfkc_casefold.asNondeterministic()
nfkd_ascii = nfkd_ascii.asNondeterministic()


def _only_non_ascii(c: Column) -> Column:
    return F.when(c.rlike(NON_ASCII), c)


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def any_word(text: Column, words: list[str]) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def first_label(text: Column, groups, default: str) -> Column:
    """Label of the first word group with a hit in the lower-cased text."""
    low = F.lower(text)
    branches = [F.when(any_word(low, words), label) for label, words in groups]
    return F.coalesce(*branches, F.lit(default))


def hazard(text: Column) -> Column:
    return first_label(text, K.HAZARD_WORDS, "unknown")


def severity(text: Column) -> Column:
    return first_label(text, K.SEVERITY_WORDS, "unknown")


def clean_text(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def py_text(c: Column) -> Column:
    """Null as the word None, the way it shows inside formatted text."""
    return F.coalesce(c, F.lit("None"))


def normalize_alert(df, title="title", description="description", hazard_type="hazard_type",
                    official="official_severity", normalized="normalized_severity"):
    """Hazard, severity, cleaned title and description of incoming alerts."""
    combined = F.concat(py_text(F.col(title)), F.lit(" "), py_text(F.col(description)))
    given = F.coalesce(F.col(hazard_type), F.lit(""))
    current = F.coalesce(F.col(normalized), F.lit(""))
    return df.withColumns({
        hazard_type: F.when(F.lower(given).isin(K.GENERIC_HAZARDS), hazard(combined)).otherwise(hazard(given)),
        normalized: F.when(F.coalesce(F.col(official), F.lit("")) != "", severity(F.col(official)))
        .when(current.isin("", "unknown"), severity(combined))
        .otherwise(F.col(normalized)),
        title: clean_text(F.col(title)),
        description: clean_text(F.col(description)),
    })


def fold(c: Column) -> Column:
    """Case- and punctuation-free text; word order and tokens are kept."""
    c = F.coalesce(c, F.lit(""))
    low = F.coalesce(nfkc_casefold(_only_non_ascii(c)), F.lower(c))
    low = F.regexp_replace(low, "[’‘`]", "'")
    low = F.regexp_replace(low, "[-‐‑‒–—_/]+", " ")
    low = F.regexp_replace(low, r"(?U)[^\p{L}\p{N}\s؀-ۿ']+", " ")
    return F.trim(F.regexp_replace(F.replace(low, F.lit("'"), F.lit(" ")), r"(?U)\s+", " "))


def location_name(c: Column) -> Column:
    """Folded place name without district words, common short forms spelt out."""
    name = fold(c)
    name = F.trim(F.regexp_replace(name, r"^(?:district|distt?|zila)\s+", ""))
    name = F.trim(F.regexp_replace(name, r"\s+(?:district|distt?|zila)$", ""))
    spelt = [F.when(name == short, full) for short, full in K.NAME_EXPANSIONS.items()]
    return F.coalesce(*spelt, name)


def to_ascii(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for old, new in K.ASCII_REPLACEMENTS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.coalesce(nfkd_ascii(_only_non_ascii(c)), c)


def _fill(line: Column, width: int) -> Column:
    broken = (
        r"(.{1,%d})(?:\s+|$|(?<=\w[A-Za-z]-)(?=\w[A-Za-z]))|(.{%d})" % (width, width)
    )
    return F.regexp_replace(F.regexp_replace(line, broken, "$1$2\n"), r"\n+$", "")


def wrap_ascii(ascii_text: Column, width: int = 78) -> Column:
    """Already-ASCII text filled to ``width``; one blank line between paragraphs."""
    lines = F.filter(
        F.transform(F.split(ascii_text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85]"), lambda p: F.trim(F.regexp_replace(p, r"\s", " "))),
        lambda p: p != "",
    )
    text = F.array_join(F.transform(lines, lambda p: _fill(p, width)), "\n\n")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("N/A")).otherwise(text)


def wrap(c: Column, width: int = 78) -> Column:
    return wrap_ascii(to_ascii(c), width)


def safety_family(hazard_type: Column) -> Column:
    return first_label(F.coalesce(hazard_type, F.lit("")), K.SAFETY_WORDS, "other")


def safety_instructions(hazard_type: Column, ascii_context: Column) -> Column:
    """Numbered lines of the text when there are two or more, else defaults."""
    marked = F.filter(
        F.transform(F.split(ascii_context, r"\r\n|[\n\r]"), lambda l: F.trim(l)),
        lambda l: l.rlike(r"^\d+[.)]\s+"),
    )
    own = F.filter(
        F.transform(marked, lambda l: F.regexp_replace(l, r"^\d+[.)]\s+", "")), lambda l: F.length(l) > 5
    )
    family = safety_family(hazard_type)
    defaults = F.coalesce(*[
        F.when(family == name, F.array(*[F.lit(x) for x in lines])) for name, lines in K.SAFETY_LINES.items()
    ])
    return F.when(F.size(own) >= 2, own).otherwise(defaults)


def file_part(ascii_text: Column, length: int) -> Column:
    part = F.regexp_replace(F.regexp_replace(F.upper(ascii_text), "[^A-Z0-9]", "_"), "_+", "_")
    part = F.regexp_replace(part, "^_|_$", "")
    return F.when(part == "", F.lit("UNKNOWN")).otherwise(F.substring(part, 1, length))


def report_filename(issued_at: Column, source: Column, hazard_type: Column, location: Column) -> Column:
    stamp = F.date_format(F.from_utc_timestamp(issued_at, K.PKT_ZONE), "yyyy-MM-dd_HH-mm-ss")
    return F.concat(F.concat_ws(
        "_", stamp, file_part(to_ascii(source), 10), file_part(to_ascii(hazard_type), 15),
        file_part(to_ascii(location), 20),
    ), F.lit(".txt"))


def filled(c: Column) -> Column:
    """Empty text as null, so that coalesce works like a truth test."""
    return F.when(c != "", c)


def location_label(*candidates: Column) -> Column:
    return F.coalesce(*[filled(c) for c in candidates], F.lit("Advisory Location"))


def evidence_label(match_method: Column, text_source: Column) -> Column:
    return (
        F.when(match_method == "HIERARCHY_INFERRED", "Resolved through location hierarchy")
        .when(text_source.isin("STRUCTURED_FIELD", "STRUCTURED_SCRAPER_FIELD"), "Source-provided")
        .otherwise("Inferred from advisory text")
    )


def parser_name(source_name: Column) -> Column:
    return (
        F.when(source_name.contains("PMD Weather"), "PMDWeatherScraper")
        .when(source_name.contains("NDMA"), "NDMAScraper")
        .when(source_name.contains("FFD") | source_name.contains("Flood"), "FFDBulletinScraper")
        .when(source_name.contains("Earthquake") | source_name.contains("Seismic"), "PMDEarthquakeScraper")
        .otherwise("BaseScraper")
    )


CONTEXT_TYPES = ["none", "DISTRICT", "TEHSIL", "PROVINCE", "DIVISION"]


def context_code(left16: Column, right16: Column) -> Column:
    """Place in ``CONTEXT_TYPES`` of the entity type that the 16 characters on
    each side of a span ask for."""
    before, after = F.rtrim(left16), F.ltrim(right16)
    ends = lambda *words: any_of([before.endswith(w) for w in words])
    starts = lambda *words: any_of([after.startswith(w) for w in words])
    unit = ("district", "distt", "zila")
    return (
        F.when(ends(*unit) | starts(*unit), 1).when(ends("tehsil"), 2)
        .when(ends("province", "territory"), 3).when(ends("division"), 4).otherwise(0)
    )


def safe_for_text(entity_type: Column, pattern: Column) -> Column:
    single = ~pattern.contains(" ")
    short_place = entity_type.isin("VILLAGE", "LOCALITY") & single & (F.length(pattern) < 6)
    allowed_length = (F.length(pattern) >= 3) | pattern.isin(K.SHORT_PATTERNS)
    return ~short_place & (entity_type != "UNKNOWN") & allowed_length


def geonames_type(feature_class: Column, code: Column, name: Column, population: Column) -> Column:
    upper = F.upper(name)
    return (
        F.when(code == "PCLI", "COUNTRY")
        .when((code == "ADM1") & upper.rlike("ISLAMABAD|AZAD|GILGIT"), "TERRITORY")
        .when(code == "ADM1", "PROVINCE")
        .when((code == "ADM2") & upper.contains("DIVISION"), "DIVISION")
        .when(code == "ADM2", "DISTRICT")
        .when(code == "ADM3", "TEHSIL")
        .when((feature_class == "P") & (code.isin("PPLC", "PPLA", "PPLA2", "PPLA3", "PPLA4") | (population >= 100000)), "CITY")
        .when((feature_class == "P") & (population >= 10000), "TOWN")
        .when((feature_class == "P") & code.isin("PPLL", "PPLX", "PPLQ"), "LOCALITY")
        .when(feature_class == "P", "VILLAGE")
        .when(code.startswith("STM") | code.isin("WADI", "CNL"), "RIVER")
        .when(code.startswith("DAM") & upper.contains("BARRAGE"), "BARRAGE")
        .when(code.startswith("DAM"), "DAM")
        .when(code.isin("RGN", "AREA", "BSND"), "REGION")
        .when(code.isin("CST", "BAY", "GULF"), "COASTAL_AREA")
    )


def unique_normalized(names: Column) -> Column:
    """Order-keeping distinct of normalised names (ASCII-safe: for arrays)."""
    return F.array_distinct(F.filter(F.transform(names, _array_name), lambda n: n != ""))


def _array_name(c: Column) -> Column:
    # Array elements cannot pass through an Arrow UDF inside a lambda; callers
    # hold names whose Unicode form was normalised when the row was read.
    low = F.lower(F.coalesce(c, F.lit("")))
    low = F.regexp_replace(low, "[’‘`']", " ")
    low = F.regexp_replace(low, "[-‐‑‒–—_/]+", " ")
    low = F.regexp_replace(low, r"(?U)[^\p{L}\p{N}\s؀-ۿ]+", " ")
    name = F.trim(F.regexp_replace(low, r"(?U)\s+", " "))
    name = F.trim(F.regexp_replace(name, r"^(?:district|distt?|zila)\s+", ""))
    name = F.trim(F.regexp_replace(name, r"\s+(?:district|distt?|zila)$", ""))
    return F.coalesce(*[F.when(name == s, full) for s, full in K.NAME_EXPANSIONS.items()], name)


def fallback_sentences(description: Column, n: int = 6) -> Column:
    parts = F.transform(F.split(F.coalesce(description, F.lit("")), r"(?<=[.!?])\s+(?=[A-Z])"), F.trim)
    return F.slice(F.filter(parts, lambda p: p != ""), 1, n)
