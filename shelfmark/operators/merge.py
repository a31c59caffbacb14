"""Bringing scores back to records by id, and comparing sets of ids.

The score side is reduced to one row per id before any join, so a join adds no
rows; it is left to the engine whether a side is small enough to broadcast.
Hot ids cost one row each after the reduction, which combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ["photo_insert_score", "photo_insert_bucket", "photo_insert_reasoning"]
PROVENANCE = {"photo_scoring_provider": "provider", "photo_scoring_model": "model", "photo_scoring_prompt_version": "prompt_version"}


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each non-null key in the given order (last wins)."""
    return _one_per_key(df, key, order, F.max_by)


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each non-null key (first wins).  Rows whose key is
    blank were never seen before: all of them stay."""
    blank = F.col(key) == ""
    kept = _one_per_key(df.where(~blank), key, order, F.min_by)
    return kept.unionByName(df.where(blank))


def _one_per_key(df: DataFrame, key: str, order: list[str], pick) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in df.columns])
    chosen = pick(whole, F.struct(*[F.col(c) for c in order]))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(chosen.alias("_row")).select("_row.*")


def merged(records: DataFrame, scores: DataFrame, key: str = "id", fields: list[str] = SCORES) -> DataFrame:
    """Records with the score fields of their id.

    A matched record takes the fields even where they are null; an unmatched
    one keeps what it had, or null.  ``scores`` has one row per key.
    """
    side = scores.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = records.join(side, F.col(key) == F.col("_key"), "left")
    had = set(records.columns)
    out: list[Column] = [F.col(c) for c in records.columns if c not in fields]
    for f in fields:
        before = F.col(f) if f in had else F.lit(None)
        out.append(F.when(F.col("_key").isNotNull(), F.col(f"_{f}")).otherwise(before).alias(f))
    return joined.select(*out)


def merged_text(records: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """As :func:`merged`, for a flat file: everything missing is '' and three
    provenance columns are added; score columns already there give way."""
    base = records.drop(*SCORES, *PROVENANCE)
    side = scores.select(F.col(key).alias("_key"), *SCORES, *[F.col(f"scoring_metadata.{v}").alias(k) for k, v in PROVENANCE.items()])
    joined = base.join(side, F.col(key) == F.col("_key"), "left")
    return joined.select(*base.columns, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in [*SCORES, *PROVENANCE]])


def not_in(df: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key the other side does not have."""
    return df.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def mismatches(a: DataFrame, b: DataFrame, key: str, field: str) -> DataFrame:
    """(key, left, right) where both sides have the key and differ, null-safe."""
    left = a.select(key, F.col(field).alias("left"))
    right = b.select(key, F.col(field).alias("right"))
    return left.join(right, key).where(~F.col("left").eqNullSafe(F.col("right")))


def presence(sets: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(key, one flag per set) for every key of any set; one aggregation."""
    rows = None
    for name, df in sets.items():
        one = df.select(F.col(key), F.lit(name).alias("_set")).where(F.col(key).isNotNull())
        rows = one if rows is None else rows.unionByName(one)
    flags = [F.coalesce(F.bool_or(F.col("_set") == name), F.lit(False)).alias(f"in_{name}") for name in sets]
    return rows.groupBy(key).agg(*flags)


def appended(done: DataFrame, new: DataFrame) -> DataFrame:
    """New rows after those already there; columns missing on a side are null."""
    return done.unionByName(new, allowMissingColumns=True)


def same_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """One row: whether both sides have the same keys, and the differences."""
    flags = presence({"a": a, "b": b}, key)
    only_a = F.count_if(F.col("in_a") & ~F.col("in_b"))
    only_b = F.count_if(F.col("in_b") & ~F.col("in_a"))
    return flags.agg(only_a.alias("only_a"), only_b.alias("only_b"), ((only_a + only_b) == 0).alias("same"))
