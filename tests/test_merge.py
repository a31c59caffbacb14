"""Joins by id."""

import pytest

from shelfmark.operators import merge

S = "id string, line_no int, photo_insert_score int, photo_insert_bucket string, photo_insert_reasoning string"


def scores(spark, rows):
    return spark.createDataFrame([(i, n, s, "b", "r") for i, n, s in rows], S)


def test_matched_null_overwrites(spark):
    base = spark.createDataFrame([("a", 5), ("b", 5), ("c", None)], "id string, photo_insert_score int")
    last = merge.last_per_key(scores(spark, [("a", 1, None), ("c", 1, 10), ("c", 2, 20), (None, 3, 9)]), "id", ["line_no"])
    got = {r["id"]: r["photo_insert_score"] for r in merge.merged(base, last).collect()}
    assert got == {"a": None, "b": 5, "c": 20}


def test_merged_keeps_every_row(spark):
    base = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert merge.merged(base, merge.last_per_key(scores(spark, [("a", 1, 1)]), "id", ["line_no"])).count() == 3


def test_first_wins_and_blank_ids_stay(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("", 3), ("", 4), (None, 5)], "id string, o int")
    assert sorted(merge.first_per_key(df, "id", ["o"]).collect()) == [("", 3), ("", 4), ("a", 1)]


def test_empty_sides(spark):
    none = scores(spark, [])
    base = spark.createDataFrame([("a",)], "id string")
    assert merge.merged(base, none).first()["photo_insert_score"] is None
    assert merge.not_in(base, none).count() == 1
    assert merge.presence({"x": base, "y": none}).first() == ("a", True, False)
    assert merge.same_ids(base, base).first()["same"]


def test_mismatches_are_null_safe(spark):
    a = scores(spark, [("a", 1, None), ("b", 1, 2), ("c", 1, None)])
    b = scores(spark, [("a", 1, 1), ("b", 1, 2), ("c", 1, None)])
    assert [tuple(r) for r in merge.mismatches(a, b, "id", "photo_insert_score").collect()] == [("a", None, 1)]


@pytest.mark.parametrize("times", [1, 2])
def test_merge_is_idempotent(spark, times):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    s = merge.last_per_key(scores(spark, [("a", 1, 7)]), "id", ["line_no"])
    out = base
    for _ in range(times):
        out = merge.merged(out, s)
    assert sorted((r["id"], r["photo_insert_score"]) for r in out.collect()) == [("a", 7), ("b", None)]
