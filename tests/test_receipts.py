"""Canonical JSON and receipts."""

import base64
import hashlib
import json
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import canonical as C
from shelfmark.functions import receipts as R

JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False, width=32) | st.text(),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3),
    max_leaves=8,
)


@given(JSON)
@settings(max_examples=200, deadline=None)
def test_canonical_is_idempotent(value):
    once = C.canonical(value)
    assert C.canonical(json.loads(once)) == once


def test_canonical_examples():
    assert C.canonical({"b": 1, "a": [True, None], "c": {"z": "x", "y": 2}}) == '{"a":[true,null],"b":1,"c":{"y":2,"z":"x"}}'
    assert C.canonical([math.nan, math.inf, 1.0, 1e-7, 1.5e22]) == "[null,null,1,1e-7,1.5e+22]"
    assert C.canonical({"k": None}) == '{"k":null}'


def selections(spark):
    return spark.createDataFrame([("s", "shelf", ["b", 'q"\n', "a"], '{"x":"y"}'), ("t", "view", [], None)], "selection_id string, mode string, items array<string>, filters string")


def test_create_verify_and_share(spark):
    made = R.created(selections(spark), "2026-01-01T00:00:00.000Z")
    rows = made.withColumn("fragment", R.to_fragment(F.col("receipt"))).withColumn("back", R.from_fragment(F.col("fragment")))
    for r in R.verified(rows).collect():
        assert r["valid"] and r["reason"] == "Hash verified"
        body = json.loads(r["receipt"])
        assert body["hash"]["value"] == hashlib.sha256(r["payload"].encode()).hexdigest()
        payload = {k: v for k, v in body.items() if k not in ("hash", "receiptId")}
        assert C.canonical(payload) == r["payload"]
        assert r["back"] == r["receipt"] and not set("+/=\n") & set(r["fragment"])


def test_any_change_is_seen(spark):
    made = R.created(selections(spark), "2026-01-01T00:00:00.000Z")
    changed = made.withColumn("receipt", F.replace("receipt", F.lit("2026"), F.lit("2027")))
    assert {r["reason"] for r in R.verified(changed).collect()} == {"Hash mismatch"}
    none = spark.createDataFrame([("{}",), ("no json",), (None,)], "receipt string")
    assert {r["reason"] for r in R.verified(none).collect()} == {"Missing hash"}


def test_receipts_cover_the_table(spark, tmp_path):
    from shelfmark.plans import registry

    rows = [(i, f"id{i % 1150:05d}", "a" if i % 1150 < 1100 else None, None) for i in range(1200)] + [(1200, None, "a", None)]
    spark.createDataFrame(rows, "ord bigint, id string, shard string, call_number string").write.parquet(str(tmp_path / "sekula_index.parquet"))
    spark.createDataFrame([("id00001",), (None,)], "id string").write.parquet(str(tmp_path / "photo_scored.parquet"))
    queries = registry.queries()
    made = queries["f28_table_receipts"](spark, str(tmp_path)).collect()
    assert sorted(x for r in made for x in json.loads(r["payload"])["items"]) == [f"id{i:05d}" for i in range(1150)]
    assert max(r["n_items"] for r in made) == 500 and len(made) == 4
    assert sum(r["found"] for r in queries["j08_table_items"](spark, str(tmp_path)).collect()) == 1
    assert {(r["variant"], r["valid"]) for r in queries["f29_table_verified"](spark, str(tmp_path)).collect()} == {("kept", True), ("changed", False), ("bare", False)}
    told = {r["selection_id"]: (r["payload"], r["hash_value"]) for r in made}
    for r in queries["k06_table_exports"](spark, str(tmp_path)).collect():
        payload, hash_value = told[r["selection_id"]]
        whole = json.loads(base64.urlsafe_b64decode(r["fragment"] + "=" * (-len(r["fragment"]) % 4)))
        rid = whole.pop("receiptId")
        assert whole.pop("hash") == {"alg": "sha256", "value": hash_value} and whole == json.loads(payload) and json.loads(r["unfolded"])["receiptId"] == rid
        assert r["file_name"] == f"receipt-shelf-{rid}.json" and len(r["card"].split("\n")) == 9 and r["card"].endswith(f"#r={r['fragment']}")


def test_bad_fragments_give_null(spark):
    rows = spark.createDataFrame([("#r=%%%",), ("_w",), (None,), ("",)], "f string").select(R.from_fragment(F.col("f")))
    assert [r[0] for r in rows.collect()] == [None] * 4


def test_items_in_order_with_missing(spark):
    rows = spark.createDataFrame([("r", ["x", "y", "x"])], "receipt_id string, items array<string>")
    have = spark.createDataFrame([("x",), (None,)], "id string")
    got = sorted((r["place"], r["id"], r["found"]) for r in R.item_report(rows, have).collect())
    assert got == [(0, "x", True), (1, "y", False), (2, "x", True)]
