"""Single catalogue fields: years, call numbers, publishers, pages, subjects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import SPACE, blank_if_null, strip

_WORDISH = r"[\p{L}\p{N}_]"
PACKET_YEAR = rf"(?<!{_WORDISH})(1[6-9][0-9]{{2}}|20[0-2][0-9])(?!{_WORDISH})"
DISPLAY_YEAR = r"(?<![A-Za-z0-9_])(1[0-9]{3}|20[0-9]{2})(?![A-Za-z0-9_])"
YEAR_PREFIX = rf"(?i)^(?:c\.?|ca\.?|circa|between){SPACE}*"
CALL = rf"^([A-Za-z]{{1,3}}){SPACE}*([0-9]+(?:\.[0-9]+)?)?"
CALL_FULL = rf"^([A-Za-z]{{1,3}}){SPACE}*([0-9]+(?:\.[0-9]+)?)?{SPACE}*\.?([A-Z][0-9]+)?{SPACE}*([12][0-9]{{3}})?"


def packet_year(raw: Column) -> Column:
    """The first year from 1600 to 2029 standing as a word of its own."""
    return F.regexp_extract(blank_if_null(raw), PACKET_YEAR, 1).try_cast("int")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def display_year(raw: Column, as_of: int) -> Column:
    """The least year up to fifty years ahead, after one leading word for
    "about" or "between" is taken off."""
    bare = F.regexp_replace(strip(raw), YEAR_PREFIX, "")
    years = F.transform(F.regexp_extract_all(bare, F.lit(DISPLAY_YEAR)), lambda y: y.cast("int"))
    return F.array_min(F.filter(years, lambda y: y <= as_of + 50))


def call_prefix(call_number: Column) -> Column:
    """One to three leading capitals, '' if there are none; nothing is trimmed."""
    return F.regexp_extract(blank_if_null(call_number), "^([A-Z]{1,3})", 1)


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def lc_class(call_number: Column) -> Column:
    return _or_null(F.upper(F.regexp_extract(strip(call_number), CALL, 1)))


def lc_number(call_number: Column) -> Column:
    return F.regexp_extract(strip(call_number), CALL, 2).try_cast("double")


def lc_key(call_number: Column) -> Column:
    """The class and the whole part of the number, padded to eight digits but
    never cut; the class alone where there is no number."""
    whole = F.regexp_extract(F.regexp_extract(strip(call_number), CALL, 2), r"^0*([0-9]+)", 1)
    padded = F.when(F.length(whole) >= 8, whole).otherwise(F.lpad(whole, 8, "0"))
    return F.when(whole == "", lc_class(call_number)).otherwise(F.concat(lc_class(call_number), padded))


def lc_cutter(call_number: Column) -> Column:
    return _or_null(F.regexp_extract(strip(call_number), CALL_FULL, 3))


def lc_year(call_number: Column) -> Column:
    return F.regexp_extract(strip(call_number), CALL_FULL, 4).try_cast("int")


def publisher_norm(publishers: Column) -> Column:
    """The first publisher without place and years; three bodies by name."""
    first = strip(blank_if_null(F.get(publishers, F.lit(0))))
    at = F.instr(first, " : ")
    placed = F.when(at > 0, F.substring(first, at + 3, F.length(first))).otherwise(first)
    undated = F.regexp_replace(placed, rf",?{SPACE}*[0-9]{{4}}(?:-[0-9]{{4}})?", "")
    low = F.lower(undated)
    return (
        F.when(F.coalesce(F.size(publishers), F.lit(0)) <= 0, "")
        .when(low.contains("moma"), "Museum of Modern Art")
        .when(low.contains("university press"), "Univ. Press")
        .otherwise(strip(undated))
    )


def page_bin(formats: Column) -> Column:
    """By the page count of the first format that gives one."""
    count = r"(?i)([0-9]+)" + SPACE + rf"*(?:p(?!{_WORDISH})|pages?)"
    found = F.get(F.filter(F.transform(formats, lambda f: F.regexp_extract(f, count, 1)), lambda x: x != ""), F.lit(0))
    pages = F.coalesce(found.try_cast("bigint"), F.when(found.isNotNull(), F.lit(1 << 40)))
    return F.when(pages.isNull(), "unknown").when(pages < 150, "<150").when(pages <= 300, "150-300").otherwise(">300")


def trimmed_title(title: Column) -> Column:
    """Titles over 150 characters end in dots at 150."""
    t = blank_if_null(title)
    return F.when(F.length(t) > 150, F.concat(F.substring(t, 1, 147), F.lit("..."))).otherwise(t)


def clean_subjects(subjects: Column) -> Column:
    """Headings without closing punctuation and doubled spaces, each once."""
    def clean(s: Column) -> Column:
        single = F.regexp_replace(strip(s), f"{SPACE}+", " ")
        return strip(F.regexp_replace(single, r"[ .,;:/]+$", ""))

    return F.array_distinct(F.filter(F.transform(subjects, clean), lambda x: x.isNotNull() & (x != "")))
