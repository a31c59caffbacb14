"""Nested location JSON against a walk over the parsed objects."""

import json

import pytest

from shelfmark.operators import nested

A = {"organization": "O", "libraryCode": "MAIN", "callNumber": " "}
HELD = {**A, "items": [{"barcode": "B1"}, None, {"barcode": " "}, {"notes": ["x"]}, {"notes": [""]}]}

CASES = [
    (None, None, []),
    ("", " ", []),
    ("null", "null", []),
    ("{}", "[]", []),
    ("not json", '[{"organization": "O"', []),
    ('{"organization": "O"} x', '[{"organization":"O"}] x', []),
    (json.dumps(A), json.dumps([None, A, {}, {"holKey": None, "items": None}]), [(-1, -1), (1, -1)]),
    (json.dumps([A]), json.dumps([HELD]), [(-1, -1), (0, -1), (0, 0), (0, 3)]),
    (json.dumps(json.dumps(A)), json.dumps(json.dumps([A, HELD])), [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 3)]),
    (None, json.dumps({"holding": [A, A]}), [(0, -1), (1, -1)]),
    (None, json.dumps({"ZED": [A], "MAIN": [None, A]}), [(0, -1), (2, -1)]),
    (None, json.dumps([[A], [A, A]]), [(0, -1), (1, -1), (2, -1)]),
    (None, json.dumps(A), [(0, -1)]),
    (None, json.dumps([{**A, "items": {"item": [{"barcode": ""}, {"status": "in"}]}}]), [(0, -1), (0, 1)]),
    (None, json.dumps([{**A, "items": {"barcode": "B"}}, {**A, "items": {}}]), [(0, -1), (0, 0), (1, -1)]),
    (None, json.dumps([{"organization": None}] * 3 + [1, "x", A]), [(5, -1)]),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_positions(spark, n):
    best, held, expected = CASES[n]
    df = spark.createDataFrame([(7, best, held, "clash")], "ord bigint, best_location string, holdings string, tree string")
    assert sorted(tuple(r)[1:] for r in nested.node_positions(df).collect()) == sorted(expected)


def test_tables(spark):
    df = spark.createDataFrame([(1, json.dumps(A), json.dumps([None, HELD]))], "ord bigint, best_location string, holdings string")
    assert nested.best_locations(df, ["ord"]).first()["libraryCode"] == "MAIN"
    h = nested.holdings(df, ["ord"]).collect()
    assert [(r["holding_pos"], r["n_items"]) for r in h] == [(1, 5)]
    i = nested.items(df, ["ord"]).collect()
    assert [(r["holding_pos"], r["item_pos"], r["barcode"], r["notes"]) for r in i] == [(1, 0, "B1", None), (1, 3, None, '["x"]')]


def test_many_elements_and_repeated_rows(spark):
    text = json.dumps([A] * 5000)
    df = spark.createDataFrame([(1, None, text), (1, None, text)], "ord bigint, best_location string, holdings string")
    assert nested.node_positions(df).count() == 10000


def test_empty_table(spark):
    df = spark.createDataFrame([], "ord bigint, best_location string, holdings string")
    assert nested.node_positions(df).count() == 0
