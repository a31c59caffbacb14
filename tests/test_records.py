"""Mapping of source documents."""

import json

from pyspark.sql import functions as F

from shelfmark.operators import records as R


def doc(display=None, control=None, addata=None, delivery=None):
    display = {"lds07": ["My Library"], **(display or {})}
    control = {"recordid": ["r1"], **(control or {})}
    return json.dumps({"pnx": {"display": display, "control": control, "addata": addata or {}}, "delivery": delivery or {}})


def mapped(spark, *docs):
    rows = spark.createDataFrame([(d,) for d in docs], "j string").select(F.from_json("j", R.DOCUMENT).alias("d")).select("d.*")
    return R.records(rows, "my library").collect()


def lists(spark, values):
    return spark.createDataFrame([(values,)], "v array<string>").select(R.cleaned(F.col("v"))).first()[0]


def test_cleaning(spark):
    assert lists(spark, [" A $$QA ", "", None]) == ["A"]
    assert lists(spark, ["$$Qx"]) == [""]
    assert lists(spark, None) == []
    assert lists(spark, [" x "]) == ["x"]


def test_fallbacks(spark):
    (r,) = mapped(spark, doc({"creator": [" "], "publisher": [""], "creationdate": []}, addata={"au": ["B"], "pub": ["P"], "date": ["1990"]}))
    assert r["authors"] == ["B"] and r["publishers"] == [] and r["year"] == "1990"


def test_dropped(spark):
    assert mapped(spark, doc({"lds07": ["Other"]})) == []
    assert mapped(spark, doc(control={"recordid": []})) == []
    assert mapped(spark, "{}") == []


def test_call_number_and_location(spark):
    place = {"callNumber": "TR1", "availabilityStatus": "available", "unknownKey": "x"}
    (r,) = mapped(spark, doc({"lds01": ["N2"]}, delivery={"bestlocation": place, "holding": [place, {}]}))
    assert r["call_number"] == "TR1" and r["availability"] == "available" and len(r["holdings"]) == 2
    (r,) = mapped(spark, doc({"lds01": ["N2"]}, delivery={"bestlocation": {"callNumber": ""}}))
    assert r["call_number"] == "N2" and r["holdings"] == []
    assert len(r) == 38


def test_url_is_encoded(spark):
    (r,) = mapped(spark, doc(control={"recordid": ["a b&c"]}))
    assert r["record_url"].endswith("docid=a+b%26c")
