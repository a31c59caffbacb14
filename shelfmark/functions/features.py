"""Feature packets: flags, tags and bins from the text of a catalogue record.

Texts are joined and lower-cased once; every flag is one pattern over them, so
a packet is one projection inside whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as t
from shelfmark.functions.fields import call_prefix, decade, packet_year, page_bin, publisher_norm, trimmed_title
from shelfmark.functions.vocabulary import DOMAINS, SIGNALS, Signal

_MARK = " | "


def _spaced(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def _text(c: str) -> Column:
    return t.blank_if_null(F.col(c))


def _list(c: str) -> Column:
    return t.joined(F.col(c), _MARK)


def evidence_text() -> Column:
    return F.lower(_spaced([_text("title"), _text("description"), _list("notes"), _list("table_of_contents"), _list("formats")]))


def tag_text() -> Column:
    return F.lower(_spaced([_text("title"), _list("subjects"), _list("notes"), _text("description")]))


def excerpt_text() -> Column:
    return _spaced([_text("description"), _list("notes"), _list("table_of_contents")])


def _found(haystack: Column, plain: list[str], pattern: str) -> Column:
    """A pattern that cannot match without one of some plain words: looking for
    those first spares most texts the pattern."""
    return t.any_of([haystack.contains(w) for w in plain]) & haystack.rlike(pattern)


def evidence_flags(haystack: Column) -> Column:
    plates = _found(haystack, ["plate"], t.PLATES)
    return F.struct(
        _found(haystack, ["photograph"], t.PHOTOGRAPHS).alias("has_photographs"),
        plates.alias("has_plates"),
        _found(haystack, ["illustration", "ill.", "fig"], t.ILLUSTRATIONS).alias("has_illustrations"),
        (_found(haystack, ["frontispiece"], t.FRONTISPIECE) & ~plates).alias("frontispiece_only"),
    )


def format_flags() -> Column:
    title, subjects, kind = F.lower(_text("title")), F.lower(_list("subjects")), F.lower(_text("material_type"))
    return F.struct(
        (title.rlike(t.EXHIBITION_TITLE) | subjects.rlike(t.EXHIBITION_SUBJECT)).alias("exhibition_catalog"),
        title.rlike(t.SURVEY).alias("survey_report"),
        title.rlike(t.MANUAL).alias("technical_manual"),
        (kind.contains("fiction") | subjects.contains("fiction")).alias("fiction"),
        title.rlike(t.COOKBOOK).alias("cookbook"),
    )


def domain_tags(haystack: Column, most: int = 3) -> Column:
    """The domains with most different key words found; ties by their order."""
    scored = []
    for place, (tag, words) in enumerate(DOMAINS.items()):
        hits = sum((_found(haystack, [w[1]], t.domain_pattern(*w)).cast("int") for w in words), F.lit(0))
        scored.append(F.struct((-hits).alias("least"), F.lit(place).alias("place"), F.lit(tag).alias("tag")))
    found = F.array_sort(F.filter(F.array(*scored), lambda s: s["least"] < 0))
    return F.transform(F.slice(found, 1, most), lambda s: s["tag"])


def notes_excerpt(full: Column, most: int = 240) -> Column:
    """The joined notes, cut, where a word for pictures occurs in them."""
    cut = F.when(F.length(full) <= most, full).otherwise(F.concat(F.substring(full, 1, most), F.lit("...")))
    return F.when(F.lower(full).rlike(t.EXCERPT_TRIGGER), cut).otherwise("")


def packets(records: DataFrame) -> DataFrame:
    """One feature packet per record: eleven fields, two of them flags."""
    year = packet_year(F.col("year"))
    return records.withColumns({"_evidence": evidence_text(), "_tags": tag_text(), "_excerpt": excerpt_text()}).select(
        "id",
        trimmed_title(F.col("title")).alias("title"),
        year.alias("year"),
        decade(year).alias("decade"),
        publisher_norm(F.col("publishers")).alias("publisher_norm"),
        call_prefix(F.col("call_number")).alias("call_number_prefix"),
        domain_tags(F.col("_tags")).alias("domain_tags"),
        page_bin(F.col("formats")).alias("page_count_bin"),
        evidence_flags(F.col("_evidence")).alias("evidence_flags"),
        format_flags().alias("format_flags"),
        notes_excerpt(F.col("_excerpt")).alias("notes_excerpt"),
    )


def signal_text(lists: list[str]) -> Column:
    """The non-empty items of several lists as one lower-cased text."""
    items = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])
    return F.lower(F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), _MARK))


def signals(haystack: Column, registry: list[Signal] = SIGNALS) -> Column:
    """Ids of all themes with a pattern in the text, in registry order; one
    alternation per theme.  A longer registry is passed, not patched."""
    hits = [F.when(haystack.rlike("|".join(map(t.signal_pattern, s.patterns))), F.lit(s.id)) for s in registry]
    return F.array_compact(F.array(*hits))
