"""Checks over merged and scored data, as rows of (check, passed, warnings, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.merge import SCORES, last_per_key, mismatches, presence

REQUIRED = ["id", *SCORES]


def _row(agg: DataFrame, place: int, name: str, passed, warnings, detail) -> DataFrame:
    return agg.select(
        F.lit(place).alias("place"), F.lit(name).alias("check"), passed.alias("passed"), warnings.cast("bigint").alias("warnings"), detail.alias("detail")
    )


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def structure(lines: DataFrame, column: str = "value") -> DataFrame:
    """Check 1 over raw JSON lines: each needs the keys, present even if null,
    and an id that is not empty.  Keys are looked for in the text since a typed
    reader loses the difference between absent and null."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    lacking = F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), keys)) > 0
    no_id = F.coalesce(F.get_json_object(column, "$.id"), F.lit("")) == ""
    agg = lines.where(F.trim(column) != "").agg(F.count("*").alias("n"), F.count_if(lacking).alias("lacking"), F.count_if(~lacking & no_id).alias("no_id"))
    ok = (F.col("n") > 0) & (F.col("lacking") == 0) & (F.col("no_id") == 0)
    return _row(agg, 1, "structure", ok, F.lit(0), _text(F.col("n").cast("string"), " rows, ", F.col("lacking").cast("string"), " lacking keys, ", F.col("no_id").cast("string"), " without id"))


def typed_structure(scored: DataFrame) -> DataFrame:
    """Check 1 over a typed table: an id that is not empty."""
    no_id = F.coalesce("id", F.lit("")) == ""
    agg = scored.agg(F.count("*").alias("n"), F.count_if(no_id).alias("no_id"))
    ok = (F.col("n") > 0) & (F.col("no_id") == 0)
    return _row(agg, 1, "structure", ok, F.lit(0), _text(F.col("n").cast("string"), " rows, ", F.col("no_id").cast("string"), " without id"))


def merged_scores(merged: DataFrame, scores: DataFrame, field: str = "photo_insert_score") -> DataFrame:
    """Check 2: scores that differ fail, missing ones only warn."""
    differing = mismatches(merged.where(F.col("id").isNotNull()), scores, "id", field).agg(F.count("*").alias("differing"))
    agg = merged.agg(F.count("*").alias("n"), F.count_if(F.col(field).isNull()).alias("missing")).crossJoin(F.broadcast(differing))  # one row
    return _row(
        agg, 2, "merged scores", F.col("differing") == 0, F.col("missing"),
        _text(F.col("differing").cast("string"), " of ", F.col("n").cast("string"), " differ"),
    )


def coverage(records: DataFrame, field: str = "photo_insert_score") -> DataFrame:
    """Check 3: how many rows have a score; never fails."""
    agg = records.agg(F.count("*").alias("n"), F.count(field).alias("with_score"))
    return _row(agg, 3, "coverage", F.lit(True), F.col("n") - F.col("with_score"), _text(F.col("with_score").cast("string"), " of ", F.col("n").cast("string")))


def id_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """Check 4: ids not in all sets only warn."""
    flags = presence(sets)
    everywhere = reduce(lambda a, b: a & b, [F.col(f"in_{s}") for s in sets])
    agg = flags.agg(F.count("*").alias("n"), F.count_if(~everywhere).alias("partial"))
    return _row(agg, 4, "id sets", F.lit(True), F.col("partial"), _text(F.col("partial").cast("string"), " of ", F.col("n").cast("string"), " ids not everywhere"))


def sample(records: DataFrame, scores: DataFrame, order: str = "line_no") -> DataFrame:
    """Check 5: the first scored id is found among the records."""
    first = scores.where(F.col("id").isNotNull()).agg(F.min_by("id", order).alias("id"))
    have = records.select("id").distinct().withColumn("have", F.lit(True))
    agg = first.join(have, "id", "left")
    return _row(agg, 5, "sample", F.coalesce("have", F.lit(False)), F.lit(0), _text("id ", F.coalesce("id", F.lit("-"))))


def report(merged: DataFrame, second: DataFrame, scored: DataFrame, order: str = "line_no", lines: DataFrame | None = None) -> DataFrame:
    """All five checks and a summary row that passes if all do.  Check 1 looks
    at the raw JSON ``lines`` of ``scored`` if they are given."""
    scores = last_per_key(scored, "id", [order])
    checks = [
        typed_structure(scored) if lines is None else structure(lines),
        merged_scores(merged, scores),
        coverage(second),
        id_sets({"scored": scores, "records": merged, "second": second}),
        sample(merged, scored, order),
    ]
    rows = reduce(DataFrame.unionByName, checks)
    total = rows.agg(F.count("*").alias("n"), F.count_if("passed").alias("good"), F.sum("warnings").alias("w"))
    summary = _row(total, 6, "all", F.col("n") == F.col("good"), F.col("w"), _text(F.col("good").cast("string"), " of ", F.col("n").cast("string"), " passed"))
    return rows.unionByName(summary)
