"""Golden rows of single fields."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import fields, scoring


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


YEARS = [
    ("1995", 1995, 1995), ("c1990", None, 1990), ("[1985?]", 1985, 1985), ("1935-1949", 1935, 1935), ("ca. 1972", 1972, 1972), ("ca1972", None, None),
    ("n.d.", None, None), ("199-", None, None), ("", None, None), ("between 1960 and 1965", 1960, 1960), ("2024", 2024, 2024), ("1599", None, 1599),
    ("2085", None, None), ("circa 1901", 1901, 1901), ("1840", 1840, 1840), ("[1990-1995]", 1990, 1990), (None, None, None),
]


def test_years(spark):
    rows = spark.createDataFrame([(i, y[0]) for i, y in enumerate(YEARS)], "i int, x string")
    got = rows.select("i", fields.packet_year(F.col("x")).alias("p"), fields.display_year(F.col("x"), 2026).alias("d")).orderBy("i").collect()
    assert [(r["p"], r["d"]) for r in got] == [(p, d) for _, p, d in YEARS]


CALLS = [
    ("TR820 .S45 1995", "TR", "TR", 820.0, "TR00000820"), ("N7433.4 .A1", "N", "N", 7433.4, "N00007433"), ("tr 15", "", "TR", 15.0, "TR00000015"),
    ("  NA2500", "", "NA", 2500.0, "NA00002500"), ("123.45 X", "", None, None, None), ("", "", None, None, None), (None, "", None, None, None),
    ("PHOTOBOOK", "PHO", "PHO", None, "PHO"), ("Z", "Z", "Z", None, "Z"), ("TR123456789", "TR", "TR", 123456789.0, "TR123456789"),
]


def test_call_numbers(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CALLS)], "i int, x string")
    x = F.col("x")
    got = rows.select("i", fields.call_prefix(x), fields.lc_class(x), fields.lc_number(x), fields.lc_key(x)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in CALLS]


@pytest.mark.parametrize(
    "raw, expected",
    [
        (None, ""), ([], ""), (["New York : Morrow, 1974"], "Morrow"), (["MoMA PS1"], "Museum of Modern Art"), (["Example University Press"], "Univ. Press"),
        (["c1995"], "c"), (["Paris : Lab : Editions"], "Lab : Editions"), (["Verlag 1990-1995"], "Verlag"), (["Studio, 2001, 2nd"], "Studio, 2nd"), ([None], ""),
    ],
)
def test_publisher(spark, raw, expected):
    assert one(spark, raw, "array<string>", fields.publisher_norm) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        (["1 sheet; 412 p"], ">300"), (["xvi, 245 pages"], "150-300"), (["96 p."], "<150"), (["unpaged"], "unknown"), (None, "unknown"), ([], "unknown"),
        (["150 p"], "150-300"), (["300 p"], "150-300"), ([None, "10 photos", "20 P."], "<150"), (["99999999999999999999999 p"], ">300"),
    ],
)
def test_pages(spark, raw, expected):
    assert one(spark, raw, "array<string>", fields.page_bin) == expected


def test_title(spark):
    assert one(spark, "x" * 151, "string", fields.trimmed_title) == "x" * 147 + "..."
    assert one(spark, "x" * 150, "string", fields.trimmed_title) == "x" * 150
    assert one(spark, None, "string", fields.trimmed_title) == ""


def test_buckets(spark):
    rows = spark.createDataFrame([(34,), (35,), (54,), (55,), (74,), (75,), (None,), (140,)], "s int").select(scoring.bucket(F.col("s")))
    assert [r[0] for r in rows.collect()] == ["Unlikely", "Plausible", "Plausible", "Likely", "Likely", "Strongly Likely", "Unlikely", "Strongly Likely"]


def test_subjects(spark):
    assert one(spark, ["Cranes. ", "Cranes", None, " ", "Ships  and docks;"], "array<string>", fields.clean_subjects) == ["Cranes", "Ships and docks"]
