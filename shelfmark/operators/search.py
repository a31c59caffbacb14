"""Search in several fields, and faceted filters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import all_of, any_of, blank_if_null, joined

#: The fields searched, in order.
FIELDS = ["title", "authors", "subjects", "sekula_notes"]


def normalized_query(query: str | None) -> str:
    return (query or "").strip().lower()


def field_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.lower(joined(F.col(name), " ") if kind == "array" else blank_if_null(F.col(name)))


def matched(df: DataFrame, query: str | None, fields: list[str] = FIELDS) -> DataFrame:
    """``df`` with matches, match_count and segments.

    The query is one literal; a field counts once however often it holds it;
    list items are joined by spaces, so a query may span two.  An empty query
    matches every row in no field.
    """
    q = normalized_query(query)
    if not q:
        return df.select("*", F.lit(True).alias("matches"), F.lit(0).alias("match_count"), F.array().cast("array<string>").alias("segments"))
    hits = F.array_compact(F.array(*[F.when(field_text(df, f).contains(q), F.lit(f)) for f in fields]))
    return df.withColumn("segments", hits).select(*df.columns, (F.size("segments") > 0).alias("matches"), F.size("segments").alias("match_count"), "segments")


@dataclass
class Term:
    """One part of an advanced query: words, in a field or any, near or exact."""

    text: str
    field: str | None = None
    edits: int = 0


_TERM = re.compile(r'(?:(\w+):)?(?:"([^"]*)"|([^\s"]+))')


def parsed_query(query: str) -> list[Term]:
    """``"exact phrase"``, ``field:word``, ``word~`` or ``word~2`` (edits);
    terms are joined by AND, written or not."""
    terms = []
    for name, phrase, word in _TERM.findall(query):
        if word == "AND" and not name:
            continue
        text, edits = phrase or word, 0
        if not phrase and (m := re.fullmatch(r"(.+)~(\d?)", word)):
            text, edits = m[1], int(m[2] or 1)
        if text.strip():
            terms.append(Term(text.strip().lower(), name.lower() or None, edits))
    return terms


def advanced(df: DataFrame, query: str, fields: list[str] = FIELDS) -> DataFrame:
    """Rows that meet every term of an advanced query."""

    def meets(term: Term) -> Column:
        names = [term.field] if term.field else fields
        if any(n not in df.columns for n in names):
            raise ValueError(f"no such field: {term.field}")
        if not term.edits:
            return any_of([field_text(df, n).contains(term.text) for n in names])
        words = [F.split(field_text(df, n), r"[^\p{L}\p{N}]+") for n in names]
        return any_of([F.exists(w, lambda x: F.levenshtein(x, F.lit(term.text), term.edits) >= 0) for w in words])

    return df.where(all_of([meets(x) for x in parsed_query(query)]))


def faceted(
    df: DataFrame,
    signal: str | None = None,
    lc_class: str | None = None,
    lc_between: tuple[float, float] | None = None,
    buckets: list[str] | None = None,
    years: tuple[int, int] | None = None,
    least_score: int | None = None,
    query: str | None = None,
) -> DataFrame:
    """Rows that meet every facet given; plain predicates reach the scan."""
    wanted: list[Column] = []
    if buckets:
        wanted.append(F.col("photo_insert_bucket").isin(buckets))
    if least_score is not None:
        wanted.append(F.col("photo_insert_score") >= least_score)
    if years:
        wanted.append(F.col("year_number").between(*years))
    if lc_class:
        wanted.append(F.col("lc_class") == lc_class)
    if lc_between:
        wanted.append(F.col("lc_number").between(*lc_between))
    if signal:
        wanted.append(F.array_contains("signals", signal))
    found = df.where(all_of(wanted)) if wanted else df
    return matched(found, query).where("matches") if normalized_query(query) else found


def on_paths(items: DataFrame, paths: DataFrame) -> DataFrame:
    """(path_id, id, signal_hits, class_hit): items met by curated paths.

    An item is on a path if it shares a signal with it; ``class_hit`` tells
    whether its class begins with one suggested.  Paths are exploded to their
    signals and equi-joined, so no item meets a path it shares nothing with.
    """
    wanted = paths.select(F.col("id").alias("path_id"), F.explode(F.array_distinct("signals")).alias("signal"), "suggested_classes")
    has = items.select("id", "lc_class", F.explode(F.array_distinct("signals")).alias("signal"))
    classed = F.exists("suggested_classes", lambda c: F.col("lc_class").startswith(c))
    return (
        has.join(wanted, "signal")
        .groupBy("path_id", "id")
        .agg(F.count("*").alias("signal_hits"), F.coalesce(F.bool_or(classed), F.lit(False)).alias("class_hit"))
    )
