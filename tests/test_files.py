"""Files in and out."""

import json

from pyspark.sql import functions as F

from shelfmark.sources import files, sinks


def sample(spark):
    return spark.createDataFrame(
        [("1", 'Title "q"\nline', ["a", "b"], {"organization": "O"}), ("2", "", [], None), ("3", None, None, {})],
        "id string, title string, authors array<string>, place map<string,string>",
    )


def test_flat_round_trip(spark, tmp_path):
    path = str(tmp_path / "flat")
    sinks.write_flat(sample(spark), path)
    back = {r["id"]: r for r in files.flat_text(spark, path, ["authors"]).collect()}
    assert back["1"]["title"] == 'Title "q"\nline' and back["1"]["authors"] == ["a", "b"]
    assert back["2"]["authors"] == [] and back["3"]["authors"] == []
    assert json.loads(back["1"]["place"]) == {"organization": "O"}


def test_lines_keep_nulls_and_skip_blanks(spark, tmp_path):
    path = str(tmp_path / "lines")
    sinks.write_lines(sample(spark).select("id", "title"), path)
    raw = [json.loads(r["value"]) for r in files.raw_lines(spark, path).collect()]
    assert {"id": "3", "title": None} in raw
    other = tmp_path / "blank.jsonl"
    other.write_text('{"id":"1"}\n\n  \n{"id":"2"}\n')
    assert files.json_lines(spark, str(other), sample(spark).select("id").schema).count() == 2


def test_array_round_trip(spark, tmp_path):
    path = str(tmp_path / "array")
    sinks.write_array(sample(spark).select("id", "title", "authors"), path, ["id"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*")))
    assert [r["id"] for r in json.loads(text)] == ["1", "2", "3"]
    assert files.json_array(spark, path).count() == 3
    sinks.write_array(sample(spark).limit(0), str(tmp_path / "none"), ["id"])
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []


def test_curated_paths(spark, tmp_path):
    config = tmp_path / "paths.json"
    config.write_text(json.dumps({"schema": "s", "version": "1", "paths": [{"id": "p", "signals": ["sea"], "suggestedClasses": ["TR"], "colorMode": "signals"}]}))
    (row,) = files.curated_paths(spark, str(config)).collect()
    assert row["id"] == "p" and row["suggested_classes"] == ["TR"] and row["color_mode"] == "signals" and row["icon"] is None


def test_html(spark):
    page = "<html><TITLE> A \n</title><style>x{}</style><p>b<br>c</p>"
    row = spark.createDataFrame([(page,), (None,)], "h string").select(files.html_title(F.col("h")), files.html_text(F.col("h"))).collect()
    assert tuple(row[0]) == ("A", "A b c") and tuple(row[1]) == (None, None)


def test_digests(spark, tmp_path):
    one = tmp_path / "x.txt"
    one.write_text("abc")
    assert files.dataset_digest(spark, str(one)) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert files.dataset_digest(spark, None) == "not-computed"
    assert files.dataset_digest(spark, str(tmp_path / "missing")) == "unavailable"
    d = files.file_digests(spark, str(one))
    assert sinks.manifest(d, d, {"rows": 3}, "run", 1.5).first()["counts"] == {"rows": 3}


def test_replace_table_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    sinks.replace_table(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    sinks.replace_table(spark.range(1), str(tmp_path / "new"))
    assert spark.read.parquet(str(tmp_path / "new")).count() == 1


def test_command_line(spark, tmp_path, capsys):
    from shelfmark.__main__ import main

    index = tmp_path / "index.json"
    index.write_text(json.dumps([{"id": "a", "title": "Camera work", "formats": ["photographs"]}, {"id": "b", "title": "Other"}]))
    p, s, m, f = (str(tmp_path / n) for n in ("packets", "scored", "merged", "flat"))
    assert main(["packets", "--input", str(index), "--output", p]) == 0
    assert main(["score", "--input", p, "--output", s, "--run-id", "r"]) == 0
    assert main(["merge", "--input", str(index), "--scores", s, "--output", m]) == 0
    assert main(["merge", "--input", str(index), "--scores", s, "--output", f, "--flat"]) == 0
    assert main(["verify", "--input", m, "--scores", s]) == 0
    assert "ok   all" in capsys.readouterr().out
    assert {r["id"]: r["photo_insert_score"] for r in spark.read.json(m).collect()} == {"a": 85, "b": 25}
    assert files.flat_text(spark, f).where("id = 'a'").first()["photo_scoring_provider"] == "rules"


def test_digest_and_flat_records_of_the_whole_table(spark, tmp_path):
    import hashlib

    from shelfmark.plans import registry

    rows = sample(spark)
    rows.repartition(2).write.parquet(str(tmp_path / "sekula_index.parquet"))
    parts = [p.read_bytes() for p in (tmp_path / "sekula_index.parquet").glob("part-*")]
    got = registry.queries()["f26_dataset_digest"](spark, str(tmp_path)).collect()
    assert sorted((r["length"], r["sha256"]) for r in got) == sorted((len(x), hashlib.sha256(x).hexdigest()) for x in parts)
    flat = registry.queries()["k02_flat_records"](spark, str(tmp_path))
    assert flat.columns == rows.columns
    assert {r["id"]: (r["authors"], r["place"]) for r in flat.collect()} == {"1": ("a | b", '{"organization":"O"}'), "2": ("", ""), "3": ("", "{}")}


def test_report_has_the_keys_check_and_the_summary(spark, tmp_path):
    from shelfmark.plans import registry

    scores = "photo_insert_score int, photo_insert_reasoning string, photo_insert_bucket string, scoring_metadata struct<provider:string>"
    spark.createDataFrame([(1, "a", 10, "r", "b", ("p",)), (2, "b", None, None, None, None)], f"line_no bigint, id string, {scores}").write.parquet(str(tmp_path / "photo_scored.parquet"))
    spark.createDataFrame([(0, "a"), (1, "b")], "ord bigint, id string").write.parquet(str(tmp_path / "sekula_index.parquet"))
    spark.createDataFrame([("a",), ("c",)], "id string").write.parquet(str(tmp_path / "photo_feature_packets.parquet"))  # the second set
    got = {r["check"]: (r["place"], r["passed"], r["warnings"]) for r in registry.queries()["q06_report"](spark, str(tmp_path)).collect()}
    assert got == {"structure": (1, True, 0), "merged scores": (2, True, 1), "coverage": (3, True, 1), "id sets": (4, True, 2), "sample": (5, True, 0), "all": (6, True, 4)}
