"""Harvesting, resuming, streaming, checks, facets."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import scoring
from shelfmark.operators import facets, quality, shelf
from shelfmark.sources import harvest
from shelfmark.streaming import incremental


def pages(total, fail=(), limit=2):
    asked = []

    def page(offset, size):
        asked.append(offset)
        if len(asked) in fail:
            raise fail[len(asked)]
        return {"docs": [{"n": i} for i in range(offset, min(offset + size, total))], "info": {"total": total}}

    return page, asked


def test_page_loop():
    page, asked = pages(5)
    assert [d["n"] for _, _, d in harvest.documents(page, 2, lambda s: None)] == list(range(5)) and asked == [0, 2, 4]
    assert list(harvest.documents(pages(0)[0], 2, lambda s: None)) == []


def test_retries_are_bounded():
    waits = []
    page, _ = pages(2, {1: harvest.Refused(), 2: OSError()})
    assert len(list(harvest.documents(page, 2, waits.append))) == 2 and waits == [60.0, 1.0]
    with pytest.raises(OSError):
        list(harvest.documents(pages(2, dict.fromkeys(range(1, 9), OSError()))[0], 2, waits.append))
    with pytest.raises(harvest.Refused):
        list(harvest.documents(pages(2, dict.fromkeys(range(1, 99), harvest.Refused()))[0], 2, waits.append))


def test_empty_pages_end_the_loop():
    def page(offset, size):
        return {"docs": [], "info": {"total": 10}}

    assert list(harvest.documents(page, 2, lambda s: None)) == []


def test_source(spark, tmp_path):
    spark.createDataFrame([(i, f"id{i}", y) for i, y in enumerate(["1950", "c1955", "n.d.", None, "1820", "2021"])], "ord bigint, id string, year string").write.parquet(str(tmp_path / "t"))
    spark.dataSource.register(harvest.HarvestSource)
    read = spark.read.format("harvest").option("client", "shelfmark.sources.harvest:table_client").option("table", str(tmp_path / "t"))
    got = read.load().groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in got} == {"1950s": 2, "Pre1940": 1, "2020s": 1}
    assert read.option("shards", "1950s").load().count() == 2


def test_quantiles_of_any_column(spark):
    import random
    import statistics

    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(999)] + [0.5] * 400 + [None] * 7
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("n", F.lit("clash")).withColumn("part", F.lit(1))
    got = {r["p"]: r["value"] for r in facets.quantiles(df, "x", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    held = sorted(v for v in values if v is not None)
    cuts = statistics.quantiles(held, n=20, method="inclusive")
    assert got == pytest.approx({0.0: held[0], 0.25: cuts[4], 0.5: cuts[9], 0.9: cuts[17], 1.0: held[-1]})
    assert facets.quantiles(df.where("x IS NULL"), "x", (0.5,)).count() == 0
    assert facets.score_summary(df.where("x IS NULL"), "x").first()["q2"] is None


def test_clusters(spark):
    rows = [(i, float(i % 2 * 100 + i % 5), i % 2 == 0, "clash") for i in range(60)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "id int, x double, f boolean, features string")
    got = {r["id"]: r["cluster"] for r in facets.clusters(df, ["x", "f"], 2).collect()}
    assert len(got) == 61 and len({got[i] for i in range(0, 60, 2)}) == len({got[i] for i in range(1, 60, 2)}) == 1 and got[0] != got[1]
    assert facets.clusters(df.limit(0), ["x"], 2).count() == 0


def test_shards_already_done_are_kept(spark, tmp_path):
    def read(s):
        return spark.createDataFrame([(s,)], "x string")

    out = str(tmp_path / "out")
    assert incremental.harvest_shards(spark, read, out, ["a"]) == ["a"]
    assert incremental.harvest_shards(spark, read, out, ["a", "b"]) == ["b"]
    assert spark.read.parquet(out).count() == 2


def test_resumed_keeps_and_adds(spark):
    done = spark.createDataFrame([("gone", 1), ("a", 2)], "id string, s int")
    packets = spark.createDataFrame([("a",), ("b",)], "id string")
    got = incremental.resumed(packets, done, lambda df: df.withColumn("s", F.lit(9)))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 2), ("b", 9), ("gone", 1)]


def test_stream_runs_twice(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    one = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, n int")
    one.write.json(src)
    for _ in range(2):
        incremental.score_stream(spark, src, one.schema, out, ck, lambda df: df.withColumn("s", F.col("n") * 10))
    assert sorted((r["id"], r["s"]) for r in spark.read.parquet(out).collect()) == [("a", 10), ("b", 20)]
    spark.createDataFrame([("b", 2), ("c", 3)], "id string, n int").write.mode("append").json(src)
    incremental.score_stream(spark, src, one.schema, out, ck, lambda df: df.withColumn("s", F.col("n") * 10))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_checks(spark):
    lines = spark.createDataFrame([('{"id":"a","photo_insert_score":null,"photo_insert_bucket":"b","photo_insert_reasoning":""}',), ("",)], "value string")
    assert quality.structure(lines).first()["passed"]
    assert not quality.structure(spark.createDataFrame([('{"id":"a"}',)], "value string")).first()["passed"]
    assert not quality.structure(lines.limit(0)).first()["passed"]
    scored = spark.createDataFrame([("a", 1, 5), ("b", 2, None)], "id string, line_no int, photo_insert_score int")
    merged = spark.createDataFrame([("a", 5), ("b", None), ("c", None)], "id string, photo_insert_score int")
    got = {r["check"]: (r["passed"], r["warnings"]) for r in quality.report(merged, merged, scored).collect()}
    assert got["merged scores"] == (True, 2) and got["id sets"] == (True, 1) and got["sample"] == (True, 0) and got["all"][0]
    wrong = merged.withColumn("photo_insert_score", F.lit(7))
    got = {r["check"]: r["passed"] for r in quality.report(wrong, merged, scored).collect()}
    assert not got["merged scores"] and not got["all"]


def test_facets_on_empty_input(spark):
    none = spark.createDataFrame([], "photo_insert_bucket string, evidence_flags struct<x:boolean>, year string, call_number string, id string")
    assert [(r["n"], r["pct"]) for r in facets.bucket_shares(none).collect()] == [(0, 0.0)] * 4
    assert [tuple(r) for r in facets.flag_shares(none).collect()] == [("x", 0, 0.0)]
    assert facets.by_decade(none, 2026).agg(F.sum("n")).first()[0] == 0
    assert facets.match_rate(none, none).first()["rate"] == 0.0


def test_other_bucket_counts_in_the_total(spark):
    rows = spark.createDataFrame([("Likely",), ("Unknown",), (None,), ("Likely",)], "photo_insert_bucket string")
    got = {r["bucket"]: (r["n"], r["pct"]) for r in facets.bucket_shares(rows).collect()}
    assert got["Likely"] == (2, 50.0) and got["Unlikely"] == (0, 0.0)


def test_gaps_across_stretches(spark):
    rows = spark.createDataFrame([("TR", float(n)) for n in (1, 5, 990, 1005, 3000, 3000)] + [("N", None)], "lc_class string, lc_number double")
    got = sorted(tuple(r) for r in shelf.sequence_gaps(rows, 10).collect())
    assert got == [("TR", 5, 990, 985), ("TR", 990, 1005, 15), ("TR", 1005, 3000, 1995)]


def test_score_never_depends_on_the_clock(spark):
    p = spark.createDataFrame([("a", (True, True, False, False), (False,) * 5, None)], "id string, evidence_flags struct<has_photographs:boolean,has_plates:boolean,has_illustrations:boolean,frontispiece_only:boolean>, format_flags struct<exhibition_catalog:boolean,survey_report:boolean,technical_manual:boolean,fiction:boolean,cookbook:boolean>, domain_tags array<string>")
    assert scoring.scored(p).collect() == scoring.scored(p).collect()
    assert scoring.scored(p).first()["photo_insert_score"] == 70


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_shelf_windows_in_blocks(spark, block):
    rows = [(f"i{n:03d}", "TR" if n % 3 else "N", f"K{n % 7}", f"c{n % 5}", float(n % 11)) for n in range(60)] + [("x", None, None, None, 1.0)]
    df = spark.createDataFrame(rows, "id string, lc_class string, lc_key string, call_number string, score double")
    for c in ("TR", "N"):
        line = sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[3], r[0]))
        got = {r["id"]: r for r in shelf.neighbours(df, block).where(F.col("lc_class") == c).collect()}
        assert len(got) == len(line)
        for i, r in enumerate(line):
            left, right = line[i - 1][0] if i else None, line[i + 1][0] if i + 1 < len(line) else None
            assert (got[r[0]]["position"], got[r[0]]["left_id"], got[r[0]]["right_id"]) == (i + 1, left, right)
    means = {r["id"]: r["mean"] for r in shelf.rolling_mean(df, "score", 2, block).collect()}
    line = sorted((r for r in rows if r[1] == "TR"), key=lambda r: (r[2], r[3], r[0]))
    for i, r in enumerate(line):
        near = [x[4] for x in line[max(0, i - 2) : i + 3]]
        assert means[r[0]] == round(sum(near) / len(near), 6)
