"""Registered queries over golden rows: small fixed inputs whose right answers
were worked out by hand and are written down, so that a pattern shared by a query
and its SQL cannot hide a mistake."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import canonical, features, fields, scoring
from shelfmark.operators import merge, records

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = 2026


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def golden(name: str, kind: str, answers: dict[str, tuple[str, Callable[[Column], Column]]], rows: list[tuple]) -> None:
    """Registers rows of (raw, answer, …): ``answers`` has the SQL type and the
    expression over the raw value for each answer column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"place int, raw {kind}")
        return df.select("place", *[f(F.col("raw")).alias(c) for c, (_, f) in answers.items()])

    values = ", ".join(f"({i}, {', '.join(map(_literal, r[1:]))})" for i, r in enumerate(rows))
    casts = ", ".join(f"{c}::{t} AS {c}" for c, (t, _) in answers.items())
    QUERIES[name] = run
    SQL[name] = f"SELECT place, {casts} FROM (VALUES {values}) AS g(place, {', '.join(answers)})"


golden(
    "f09_golden_years", "string",
    {"packet": ("INT", fields.packet_year), "decade": ("INT", lambda x: fields.decade(fields.packet_year(x))), "display": ("INT", lambda x: fields.display_year(x, AS_OF))},
    [
        ("1995", 1995, 1990, 1995), ("c1990", None, None, 1990), ("[1985?]", 1985, 1980, 1985), ("1935-1949", 1935, 1930, 1935), ("ca. 1972", 1972, 1970, 1972),
        ("ca1972", None, None, None), ("n.d.", None, None, None), ("199-", None, None, None), ("", None, None, None), ("between 1960 and 1965", 1960, 1960, 1960),
        ("2024", 2024, 2020, 2024), ("1599", None, None, 1599), ("2085", None, None, None), ("circa 1901", 1901, 1900, 1901), ("1840", 1840, 1840, 1840),
        ("[1990-1995]", 1990, 1990, 1990), (None, None, None, None),
    ],
)
golden(
    "f11_golden_call_numbers", "string",
    {"prefix": ("VARCHAR", fields.call_prefix), "lc_class": ("VARCHAR", fields.lc_class), "lc_number": ("DOUBLE", fields.lc_number), "lc_key": ("VARCHAR", fields.lc_key)},
    [
        ("TR820 .S45 1995", "TR", "TR", 820.0, "TR00000820"), ("N7433.4 .A1", "N", "N", 7433.4, "N00007433"), ("tr 15", "", "TR", 15.0, "TR00000015"),
        ("  NA2500", "", "NA", 2500.0, "NA00002500"), ("123.45 X", "", None, None, None), ("", "", None, None, None), (None, "", None, None, None),
        ("PHOTOBOOK", "PHO", "PHO", None, "PHO"), ("Z", "Z", "Z", None, "Z"), ("TR123456789", "TR", "TR", 123456789.0, "TR123456789"),
    ],
)
golden(
    "f05_golden_publishers", "array<string>", {"publisher_norm": ("VARCHAR", fields.publisher_norm)},
    [
        (None, ""), ([], ""), (["New York : Morrow, 1974"], "Morrow"), (["MoMA PS1"], "Museum of Modern Art"), (["Example University Press"], "Univ. Press"),
        (["c1995"], "c"), (["Paris : Lab : Editions"], "Lab : Editions"), (["Verlag 1990-1995"], "Verlag"), (["Studio, 2001, 2nd"], "Studio, 2nd"), ([None], ""),
    ],
)
golden(
    "f04_golden_pages", "array<string>", {"page_count_bin": ("VARCHAR", fields.page_bin)},
    [(["1 sheet; 412 p"], ">300"), (["xvi, 245 pages"], "150-300"), (["96 p."], "<150"), (["unpaged"], "unknown"), (None, "unknown"), (["150 p"], "150-300"), (["300 p"], "150-300"), (["301 p"], ">300")],
)


def _flag(name: str) -> Callable[[Column], Column]:
    return lambda x: features.evidence_flags(F.lower(x))[name]


golden(
    "f01_golden_flags", "string", {n: ("BOOLEAN", _flag(n)) for n in ("has_photographs", "has_plates", "has_illustrations", "frontispiece_only")},
    [
        ("Ill. ; maps", False, False, False, False), ("Frontispiece and plate", False, True, False, False), ("Frontispiece only", False, False, False, True),
        ("Includes photographs", True, False, False, False), ("12 plates", False, True, False, False), ("Illustrations throughout", False, False, True, False),
        ("", False, False, False, False), ("photographer", False, False, False, False), ("templates", False, False, False, False), ("ill.5 and fig.2", False, False, True, False),
    ],
)
golden(
    "f07_golden_texts", "string", {"excerpt": ("VARCHAR", features.notes_excerpt), "title": ("VARCHAR", fields.trimmed_title)},
    [("Ill. ; maps", "Ill. ; maps", "Ill. ; maps"), ("photo" + "x" * 236, "photo" + "x" * 235 + "...", "photo" + "x" * 142 + "..."), ("y" * 151, "", "y" * 147 + "..."), ("y" * 150, "", "y" * 150), ("", "", "")],
)
golden(
    "f13_golden_signals", "string",
    {"signals": ("VARCHAR", lambda x: F.array_join(features.signals(F.lower(x)), ",")), "tags": ("VARCHAR", lambda x: F.array_join(features.domain_tags(F.lower(x)), ","))},
    [("Software heart", "war,art", ""), ("Annual report", "sea", ""), ("", "", "")],
)
golden(
    "f20_golden_buckets", "int", {"bucket": ("VARCHAR", scoring.bucket)},
    [(34, "Unlikely"), (35, "Plausible"), (54, "Plausible"), (55, "Likely"), (74, "Likely"), (75, "Strongly Likely"), (None, "Unlikely"), (140, "Strongly Likely"), (-5, "Unlikely")],
)
golden(
    "f24_golden_canonical", "string", {"canonical": ("VARCHAR", canonical.canonical_json)},
    [
        ('{"b":1,"a":[true,null],"c":{"z":"x","y":2}}', '{"a":[true,null],"b":1,"c":{"y":2,"z":"x"}}'), ('{"x":NaN,"y":-Infinity}', '{"x":null,"y":null}'), ("[ ]", "[]"), ("no json", None),
        ('{"b":1.50,"a":1e21,"B":"é\\u0041"}', '{"B":"éA","a":1e+21,"b":1.5}'), (None, None), ('"q\\"\\n"', '"q\\"\\n"'),
    ],
)
golden(
    "r01_golden_lists", "array<string>", {"cleaned": ("VARCHAR", lambda x: F.array_join(records.cleaned(x), "|")), "n": ("INT", lambda x: F.size(records.cleaned(x))), "first": ("VARCHAR", records.first_of)},
    [([" A $$QA ", "", None], "A", 1, "A"), (["$$Qx"], "", 1, ""), (None, "", 0, ""), ([" ", "B", "C $$Q"], "B|C", 2, "B")],
)


def r07_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallbacks of the mapping: an empty cleaned list of creators falls back, a
    raw list of publishers with an empty text does not; no tag or id, no record."""

    def document(control: dict | None, display: dict, addata: dict | None = None, delivery: dict | None = None) -> tuple:
        return ({"control": control, "display": display, "addata": addata, "facets": None}, delivery)

    tagged = {"lds07": ["The Quay Library"]}
    rows = [
        document({"recordid": ["a"]}, {**tagged, "creator": [" "], "publisher": [""]}, {"au": ["B"], "pub": ["P"]}),
        document({"recordid": ["b"]}, {"lds07": ["Other"]}),
        document(None, tagged),
        document({"recordid": ["c $$Q"]}, {**tagged, "lds01": ["TR 1"]}, None, {"bestlocation": {"callNumber": ""}, "holding": [{"holKey": "h", "callNumber": "X"}, None]}),
        document({"recordid": ["d"]}, {**tagged, "lds01": ["TR 1"], "publisher": None}, {"pub": ["P"]}, {"bestlocation": {"callNumber": "TR 9"}}),
    ]
    out = records.records(spark.createDataFrame(rows, records.DOCUMENT), "quay library")
    return out.select("id", F.array_join("authors", "|").alias("authors"), F.array_join("publishers", "|").alias("publishers"), "call_number", F.size("holdings").alias("n_holdings"))


QUERIES["r07_golden_records"] = r07_golden_records
SQL["r07_golden_records"] = "SELECT * FROM (VALUES ('a', 'B', '', '', 0), ('c', '', '', 'TR 1', 2), ('d', '', 'P', 'TR 9', 0)) AS g(id, authors, publishers, call_number, n_holdings)"


def j01_golden_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matched score wins even if it is null, no row keeps what is there, of two
    rows the last counts."""
    base = spark.createDataFrame([("a", 5), ("b", 5), ("c", None)], "id string, photo_insert_score int")
    rows = [("a", 1, None, None, None, None), ("c", 2, 10, None, None, None), ("c", 3, 20, "x", "y", None)]
    kinds = "photo_insert_score int, photo_insert_bucket string, photo_insert_reasoning string, scoring_metadata struct<provider:string>"
    scores = merge.last_per_key(spark.createDataFrame(rows, f"id string, line_no int, {kinds}"), "id", ["line_no"])
    return merge.merged(base, scores).select("id", "photo_insert_score")


QUERIES["j01_golden_merge"] = j01_golden_merge
SQL["j01_golden_merge"] = "SELECT id, s::INT AS photo_insert_score FROM (VALUES ('a', NULL), ('b', 5), ('c', 20)) AS g(id, s)"
