"""Files the catalogue comes from: JSON arrays, JSON lines, flat text, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import strip

#: The fields of a catalogue record in file order.
RECORD_FIELDS = [
    "id", "alma_mms", "source_record_id", "original_source_id", "source_system", "frbr_group_id", "title", "uniform_title",
    "alternative_titles", "authors", "contributors", "year", "languages", "material_type", "formats", "identifiers", "publishers", "places",
    "series", "table_of_contents", "description", "notes", "provenance_notes", "sekula_notes", "subjects", "collection", "collection_tags",
    "call_number", "call_number_notes", "availability", "best_location", "holdings", "isbns", "issns", "oclc_numbers", "lccn", "record_url",
    "source",
]
LIST_FIELDS = [
    "authors", "contributors", "subjects", "languages", "formats", "identifiers", "publishers", "places", "series", "table_of_contents", "notes",
    "provenance_notes", "sekula_notes", "call_number_notes", "isbns", "issns", "oclc_numbers", "lccn", "alternative_titles", "collection_tags",
]
LIST_MARK = " | "


def record_schema(nested_as_text: bool = True) -> T.StructType:
    kinds = {f: T.ArrayType(T.StringType()) for f in LIST_FIELDS}
    return T.StructType([T.StructField(f, kinds.get(f, T.StringType())) for f in RECORD_FIELDS])


def json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Records of a file holding one JSON array."""
    return spark.read.option("multiLine", True).schema(schema or record_schema()).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines as text, for checks of key presence."""
    return spark.read.text(path).where(F.trim("value") != "")


def curated_paths(spark: SparkSession, path: str) -> DataFrame:
    """The path rules of a JSON config, one row each."""
    rule = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("id", "title", "subtitle", "narrative")]
        + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("signals", "suggestedClasses")]
        + [T.StructField(n, T.StringType()) for n in ("colorMode", "icon")]
    )
    whole = T.StructType([T.StructField("schema", T.StringType()), T.StructField("version", T.StringType()), T.StructField("paths", T.ArrayType(rule))])
    rows = spark.read.option("multiLine", True).schema(whole).json(path).select(F.inline("paths"))
    return rows.withColumnsRenamed({"suggestedClasses": "suggested_classes", "colorMode": "color_mode"})


def flat_text(spark: SparkSession, path: str, list_fields: list[str] = LIST_FIELDS) -> DataFrame:
    """A flattened file read back: lists split at their mark, '' as no items; other
    fields are texts, an empty one ''."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True, nullValue="\x00", emptyValue="")
    rows = rows.fillna("")  # the reader takes an empty field for null, the writer makes null an empty field
    lists = {c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, r" \| ")) for c in list_fields if c in rows.columns}
    return rows.withColumns(lists)


def html_title(html: Column) -> Column:
    return strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column) -> Column:
    """Readable text of a page: scripts, styles and tags taken out."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return strip(F.regexp_replace(bare, r"\s+", " "))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def dataset_digest(spark: SparkSession, path: str | None) -> str:
    """The digest of one file; 'not-computed' without a path, 'unavailable' if
    it cannot be read."""
    if not path:
        return "not-computed"
    try:
        return file_digests(spark, path).limit(1).collect()[0]["sha256"]
    except Exception:  # noqa: BLE001 - any failure to read has the same meaning
        return "unavailable"
