"""Free-entered values against a canonical list."""

import pytest
from pyspark.sql import functions as F

from shelfmark.llm.linking import FIRMS, PLACES, Entry, Gazetteer, found

P = [
    Entry(1, "Fort Brelköping", (), "Ostrelia"), Entry(2, "Fort Brelköping", (), "Lower Brenn"), Entry(3, "Lindmouth", ("Varnburg",), "Vendmark"),
    Entry(4, "Upper Ulvaford", (), "Ostrelia"), Entry(5, "Ulvaford", (), "Lower Brenn"), Entry(6, "New Quillehaven", (), "Vendmark"), Entry(7, "Port Wendingmünde", (), "Kalesia"),
]
B = [
    Entry(1, "Quarry Hill Press"), Entry(2, "University of Ulvholm Press"), Entry(3, "Éditions Wexanthauer"), Entry(4, "Tallow & Eskuski Books"),
    Entry(5, "Kedestbrück & Jevumero"), Entry(6, "Halyard Museum of Yard Work"), Entry(7, "Galerie Krivindenko"),
]

PLACE_CASES = [
    ("Fort Brelköping, Ostr.", 1), ("LOWER BRENN, FORT BRELKÖPING", 2), ("Fort Brelköping", -1), ("[Fort Brelropnig]", -1), ("Fort Brelröping, Ostrelia", 1),
    ("Ft Brelköping (L. Br.)", 2), ("Varnburg [i.e. Lindmouth]", 3), ("in Lindmouth and elsewhere", 3), ("Lindmoth :", 3), ("Upper Ulvaford,", 4), ("ulvaford", 5),
    ("N. Quillehaven", 6), ("Wendingmünde", -1), ("New Lindmouth", -1), ("[S.l.]", -1), ("1962", -1), ("-", -1), ("Lindmouth, Ostrelia", -1), ("x" * 50_000, -1),
]
FIRM_CASES = [
    ("Yarrorsk : Quarry Hill Press, 1915", 1), ("Quarry-Hill Pr.", 1), ("Press, Quarry Hill", 1), ("Quary Hill Press Ltd.", 1), ("Quarry Court Press", -1),
    ("Univ. Ulvholm", 2), ("Ulvholm UP", 2), ("U of Ulvholm Press", 2), ("University of Ulvburg Press", -1), ("Les Editions Wexanthauer", 3), ("Ed. Wexanthauer, 1990", 3),
    ("Wexanthauer Verlag", -1), ("Tallow, Eskuski Bks. Inc.", 4), ("Tallow & Eskuski", 4), ("Jevumero und Kedestbruck", 5), ("Museum of Yard Work, Halyard", 6),
    ("Halyard Mus. of Yard Work", 6), ("Krivindenko Gallery", 7), ("Halyard Museum", 6), ("Quarry Museum", -1), ("s.n.", -1), ("[publisher not identified]", -1), (" : ", -1),
]


@pytest.mark.parametrize("text, expected", PLACE_CASES)
def test_places(text, expected):
    assert Gazetteer(P, PLACES).meant(text) == expected


@pytest.mark.parametrize("text, expected", FIRM_CASES)
def test_firms(text, expected):
    assert Gazetteer(B, FIRMS).meant(text) == expected


def test_found_rows(spark):
    df = spark.createDataFrame(
        [("a", ["Lindmouth", None, " ", "lindmouth"], 1), ("a", ["Lindmouth", None, " ", "lindmouth"], 2), ("b", None, 3), ("c", [], 4), (None, ["x"], 5)],
        "id string, places array<string>, value int",
    )
    got = [tuple(r) for r in found(df, "id", "places", P, PLACES).collect()]
    assert got == [("places", "a", 3, "lindmouth", 3)]
    assert found(df.limit(0), "id", "places", P, PLACES).count() == 0
    assert {r["ref_id"] for r in found(df, "id", "places", [], PLACES).collect()} == {-1}


def test_longest_mention_wins():
    g = Gazetteer(P, PLACES)
    assert [m[2] for m in g._mentions("upper ulvaford and lindmouth".split())] == ["upper ulvaford", "lindmouth"]


def test_column_keeps_null(spark):
    from shelfmark.llm.linking import linked

    df = spark.createDataFrame([(None,), ("Lindmouth",)], "v string")
    assert [r[0] for r in df.select(linked(F.col("v"), P, PLACES)).collect()] == [-1, 3]


def test_an_id_with_two_lists_keeps_both(spark):
    df = spark.createDataFrame([("a", ["Lindmouth", "ulvaford"]), ("a", ["lindmouth"]), ("a", ["lindmouth"])], "id string, places array<string>").withColumn("pos", F.lit(7))
    got = sorted(tuple(r) for r in found(df, "id", "places", P, PLACES).select("pos", "value", "ref_id").collect())
    assert got == [(0, "lindmouth", 3), (1, "ulvaford", 5)]


def test_one_list_under_two_sets_of_rules(spark):
    from shelfmark.llm.linking import Rules, linked

    df = spark.createDataFrame([("in Lindmouth",)], "v string").coalesce(1)
    plain = Rules(kinds={"zzz": ("zzz",)})
    assert df.select(linked(F.col("v"), P, PLACES).alias("a")).first()["a"] == 3
    got = df.select(linked(F.col("v"), P, plain).alias("b")).first()["b"]
    assert got == Gazetteer(P, plain).meant("in Lindmouth")
