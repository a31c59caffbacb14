"""Flags, tags and signals, with the traps of their patterns."""

from pyspark.sql import functions as F

from shelfmark.functions import features, scoring

FIELDS = "id string, title string, description string, notes array<string>, table_of_contents array<string>, formats array<string>, subjects array<string>, material_type string, publishers array<string>, call_number string, year string"


def record(**given):
    base = dict.fromkeys([f.split()[0] for f in FIELDS.split(", ")])
    return tuple({**base, "id": "r", **given}.values())


def packet(spark, **given):
    return features.packets(spark.createDataFrame([record(**given)], FIELDS)).first()


def test_all_null(spark):
    p = packet(spark)
    assert p["title"] == "" and p["domain_tags"] == [] and p["notes_excerpt"] == "" and p["page_count_bin"] == "unknown"
    assert not any(p["evidence_flags"].asDict().values()) and not any(p["format_flags"].asDict().values())


def test_abbreviations_need_a_word_behind(spark):
    assert not packet(spark, notes=["Ill. ; maps"])["evidence_flags"]["has_illustrations"]
    assert packet(spark, notes=["Ill. ; maps"])["notes_excerpt"] != ""
    assert packet(spark, notes=["ill.a"])["evidence_flags"]["has_illustrations"]


def test_frontispiece(spark):
    both = packet(spark, notes=["Frontispiece and plate"])["evidence_flags"]
    assert both["has_plates"] and not both["frontispiece_only"]
    assert packet(spark, notes=["Frontispiece only"])["evidence_flags"]["frontispiece_only"]


def test_word_boundary_is_unicode(spark):
    assert not packet(spark, title="éphoto")["domain_tags"]
    assert packet(spark, title="a photo.")["domain_tags"] == ["photography"]


def test_photographs_in_formats_only(spark):
    p = features.packets(spark.createDataFrame([record(formats=["photographs"])], FIELDS))
    row = scoring.scored(p).first()
    assert row["evidence_flags"]["has_photographs"] and row["domain_tags"] == [] and row["photo_insert_score"] == 70


def test_tags_ties_keep_their_order(spark):
    assert packet(spark, title="sea art city war")["domain_tags"] == ["maritime", "art", "urban"]


def test_excerpt_is_cut(spark):
    assert packet(spark, description="photo " + "x" * 300)["notes_excerpt"] == "photo " + "x" * 234 + "..."


def test_signals_have_no_leading_boundary(spark):
    rows = spark.createDataFrame([(["Software heart"], None), ([], ["Annual report"]), (None, None), ([None, ""], [])], "subjects array<string>, notes array<string>")
    got = rows.select(features.signals(features.signal_text(["subjects", "notes"])).alias("s")).collect()
    assert [r["s"] for r in got] == [["war", "art"], ["sea"], [], []]


def test_outside_scorer_retries_and_falls_back(spark):
    calls = []

    def failing(rows):
        calls.append(len(rows))
        raise OSError

    waits = []
    assert scoring._asked(failing, [{"id": "a"}], 3, waits.append) == [(20, "Scoring failed")]
    assert waits == [2.0, 4.0] and calls == [1, 1, 1]
    assert scoring._asked(lambda rows: [{"likelihood": 140}], [{}], 1, waits.append) == [(100, "")]


def test_tint(spark):
    rows = spark.createDataFrame([("Likely",), ("Unlikely",), (None,)], "b string").select(scoring.tint(F.col("b")))
    assert [r[0] for r in rows.collect()] == ["yellow 0.3", None, None]
