"""Search and filters."""

import pytest

from shelfmark.operators import search

S = "id string, title string, authors array<string>, subjects array<string>, sekula_notes array<string>"


def rows(spark):
    return spark.createDataFrame(
        [("1", "Harbor light", ["A B", "C"], ["Docks"], None), ("2", None, None, ["harbors", None], ["light harbor"]), ("3", "x", [], [], [])], S
    )


def test_counts_fields_not_occurrences(spark):
    got = {r["id"]: (r["matches"], r["match_count"], r["segments"]) for r in search.matched(rows(spark), " HARBOR ").collect()}
    assert got["1"] == (True, 1, ["title"]) and got["2"] == (True, 2, ["subjects", "sekula_notes"]) and got["3"] == (False, 0, [])


def test_query_may_span_list_items(spark):
    assert [r["id"] for r in search.matched(rows(spark), "b c").where("matches").collect()] == ["1"]


def test_empty_query_matches_all(spark):
    assert [tuple(r)[-3:] for r in search.matched(rows(spark), None).collect()] == [(True, 0, [])] * 3


def test_advanced(spark):
    def ids(q):
        return [r["id"] for r in search.advanced(rows(spark), q).collect()]

    assert ids('title:"harbor light"') == ["1"]
    assert ids("harbor AND docks") == ["1"]
    assert ids("harbur~1") == ["1", "2"]
    assert ids("") == ["1", "2", "3"]
    with pytest.raises(ValueError):
        ids("nofield:x")


def test_curated_paths(spark):
    paths = spark.createDataFrame([("p", ["sea", "sea"], ["TR"]), ("q", [], None)], "id string, signals array<string>, suggested_classes array<string>")
    items = spark.createDataFrame([("1", ["sea", "war"], "TR"), ("2", ["war"], "TR"), ("3", ["sea"], None)], "id string, signals array<string>, lc_class string")
    assert sorted(tuple(r) for r in search.on_paths(items, paths).collect()) == [("p", "1", 1, True), ("p", "3", 1, False)]
