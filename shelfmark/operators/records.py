"""Mapping nested source documents to flat catalogue records.

A document is a struct of ``pnx.{control,display,addata,facets}`` (lists of
strings per field, any of them missing) and ``delivery`` (locations).  The
mapping is one projection; nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import strip
from shelfmark.operators.nested import LOCATION_KEYS

#: The list fields of a source document, by part.
CONTROL = ["recordid", "sourcerecordid", "originalsourceid", "sourcesystem"]
DISPLAY = [
    "title", "unititle", "addtitle", "creator", "contributor", "creationdate", "subject", "language", "type", "format", "identifier",
    "publisher", "place", "series", "contents", "description", "mms", "lds01", "lds07", "lds14", "lds16", "lds23",
]
ADDATA = ["addtitle", "au", "date", "pub", "cop", "notes", "isbn", "issn", "oclcid", "lccn"]
FACETS = ["frbrgroupid"]


def _lists(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in names])


LOCATION = T.StructType([T.StructField(k, T.StringType()) for k in LOCATION_KEYS])
DOCUMENT = T.StructType(
    [
        T.StructField(
            "pnx",
            T.StructType(
                [
                    T.StructField("control", _lists(CONTROL)),
                    T.StructField("display", _lists(DISPLAY)),
                    T.StructField("addata", _lists(ADDATA)),
                    T.StructField("facets", _lists(FACETS)),
                ]
            ),
        ),
        T.StructField("delivery", T.StructType([T.StructField("bestlocation", LOCATION), T.StructField("holding", T.ArrayType(LOCATION))])),
    ]
)
PAGE = T.StructType([T.StructField("docs", T.ArrayType(DOCUMENT)), T.StructField("info", T.StructType([T.StructField("total", T.LongType())]))])


def _empty() -> Column:
    return F.array().cast("array<string>")


def normalized(values: Column) -> Column:
    """Items stripped, null and empty ones left out; null gives no items."""
    return F.filter(F.transform(F.coalesce(values, _empty()), strip), lambda x: x.isNotNull() & (x != ""))


def without_subfields(text: Column) -> Column:
    """Cut at the first subfield mark; unchanged where there is none."""
    return F.when(text.contains("$$"), strip(F.substring_index(text, "$$", 1))).otherwise(text)


def cleaned(values: Column) -> Column:
    """Normalized, then cut; an item that becomes empty by the cut stays."""
    return F.transform(normalized(values), without_subfields)


def first_of(values: Column) -> Column:
    return F.coalesce(F.get(cleaned(values), F.lit(0)), F.lit(""))


def filled_or(a: Column, b: Column) -> Column:
    """The first list unless it has no items: an empty list counts as none."""
    return F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a).otherwise(b)


def in_collection(tags: Column, name: str) -> Column:
    return F.exists(tags, lambda t: F.contains(F.lower(t), F.lit(name.lower())))


def slim_location(location: Column) -> Column:
    """The nine known fields of a location, whatever else it holds."""
    return F.struct(*[location[k].alias(k) for k in LOCATION_KEYS])


def record_url(record_id: Column, base: str, params: dict[str, str]) -> Column:
    tail = "".join(f"&{k}={v}" for k, v in params.items())
    return F.concat(F.lit(f"{base}?docid="), F.url_encode(record_id), F.lit(tail))


def records(
    documents: DataFrame,
    collection: str,
    source: str = "catalog",
    url_base: str = "https://catalog.example/full",
    url_params: dict[str, str] | None = None,
) -> DataFrame:
    """The 38-field record of every document of a collection that has an id."""

    def c(part: str, name: str) -> Column:
        return F.col(f"pnx.{part}.{name}")

    def d(name: str) -> Column:
        return c("display", name)

    def a(name: str) -> Column:
        return c("addata", name)

    best = F.col("delivery.bestlocation")
    call_notes = cleaned(d("lds01"))
    ids = cleaned(c("control", "recordid"))
    tags = cleaned(d("lds07"))
    own_call = F.when(best["callNumber"] != "", best["callNumber"])
    rows = documents.where(in_collection(tags, collection) & (F.size(ids) > 0)).select("*", F.get(ids, F.lit(0)).alias("_id"))
    return rows.select(
        F.col("_id").alias("id"),
        first_of(d("mms")).alias("alma_mms"),
        first_of(c("control", "sourcerecordid")).alias("source_record_id"),
        first_of(c("control", "originalsourceid")).alias("original_source_id"),
        first_of(c("control", "sourcesystem")).alias("source_system"),
        first_of(c("facets", "frbrgroupid")).alias("frbr_group_id"),
        first_of(d("title")).alias("title"),
        first_of(d("unititle")).alias("uniform_title"),
        cleaned(filled_or(d("addtitle"), a("addtitle"))).alias("alternative_titles"),
        filled_or(cleaned(d("creator")), cleaned(a("au"))).alias("authors"),
        cleaned(d("contributor")).alias("contributors"),
        first_of(filled_or(d("creationdate"), a("date"))).alias("year"),
        cleaned(d("language")).alias("languages"),
        first_of(d("type")).alias("material_type"),
        cleaned(d("format")).alias("formats"),
        cleaned(d("identifier")).alias("identifiers"),
        cleaned(filled_or(d("publisher"), a("pub"))).alias("publishers"),
        cleaned(filled_or(d("place"), a("cop"))).alias("places"),
        cleaned(d("series")).alias("series"),
        cleaned(filled_or(d("contents"), d("lds16"))).alias("table_of_contents"),
        F.array_join(cleaned(d("description")), " ").alias("description"),
        cleaned(a("notes")).alias("notes"),
        cleaned(d("lds14")).alias("provenance_notes"),
        cleaned(d("lds23")).alias("sekula_notes"),
        cleaned(d("subject")).alias("subjects"),
        F.lit(collection).alias("collection"),
        tags.alias("collection_tags"),
        F.coalesce(own_call, F.get(call_notes, F.lit(0)), F.lit("")).alias("call_number"),
        call_notes.alias("call_number_notes"),
        best["availabilityStatus"].alias("availability"),
        slim_location(best).alias("best_location"),
        F.transform(F.coalesce(F.col("delivery.holding"), F.array().cast(T.ArrayType(LOCATION))), slim_location).alias("holdings"),
        cleaned(a("isbn")).alias("isbns"),
        cleaned(a("issn")).alias("issns"),
        cleaned(a("oclcid")).alias("oclc_numbers"),
        cleaned(a("lccn")).alias("lccn"),
        record_url(F.col("_id"), url_base, url_params or {}).alias("record_url"),
        F.lit(source).alias("source"),
    )


def as_documents(index: DataFrame) -> DataFrame:
    """Catalogue rows turned back into source documents, for tests and for the
    query over the mapping: list items get a subfield tail."""

    def tailed(name: str) -> Column:
        return F.transform(F.col(name), lambda x: F.concat(x, F.lit(" $$Q"), x))

    def one(name: str) -> Column:
        return F.array(F.col(name))

    given = {
        "title": one("title"), "unititle": one("uniform_title"), "creator": F.col("authors"), "contributor": tailed("contributors"),
        "creationdate": one("year"), "subject": tailed("subjects"), "language": F.col("languages"), "type": one("material_type"),
        "format": F.col("formats"), "publisher": F.col("publishers"), "place": F.col("places"), "description": one("description"),
        "mms": one("alma_mms"), "lds01": F.col("call_number_notes"), "lds07": F.col("collection_tags"), "lds16": F.col("table_of_contents"),
        "lds23": F.col("sekula_notes"), "lds14": F.col("provenance_notes"), "identifier": F.col("identifiers"), "series": F.col("series"),
    }
    extra = {
        "au": F.col("contributors"), "notes": F.col("notes"), "isbn": F.col("isbns"), "date": one("year"), "addtitle": F.col("alternative_titles"), "issn": F.col("issns"),
        "oclcid": F.col("oclc_numbers"), "lccn": F.col("lccn"),
    }

    def part(names: list[str], values: dict[str, Column]) -> Column:
        return F.struct(*[values.get(n, F.lit(None).cast("array<string>")).alias(n) for n in names])

    location = F.from_json(F.when(F.col("best_location").startswith("{"), F.col("best_location")), LOCATION)
    listed = F.from_json(F.when(F.col("holdings").startswith("["), F.col("holdings")), "array<string>")
    held = F.transform(F.filter(listed, lambda e: F.coalesce(F.ltrim(e).startswith("{"), F.lit(False))), lambda e: F.from_json(e, LOCATION))
    control = {"recordid": one("id"), "sourcerecordid": one("source_record_id"), "originalsourceid": one("original_source_id"), "sourcesystem": one("source_system")}
    return index.select(
        F.struct(
            part(CONTROL, control).alias("control"),
            part(DISPLAY, given).alias("display"),
            part(ADDATA, extra).alias("addata"),
            part(FACETS, {"frbrgroupid": one("frbr_group_id")}).alias("facets"),
        ).alias("pnx"),
        F.struct(location.alias("bestlocation"), held.alias("holding")).alias("delivery"),
    )
