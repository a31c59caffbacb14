"""Shelf order and what follows from it.

A call-number class can hold a third of all rows, so no window runs over a
whole class.  Rows are range-partitioned in shelf order, which gives each a
position from the counts of the stretches before it; neighbours and rolling
means then run over blocks of positions with the rows at their edges copied
into the next block.  Gaps run over distinct numbers in stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.fields import lc_class, lc_key, lc_number
from shelfmark.tables import written


def parsed(records: DataFrame) -> DataFrame:
    c = F.col("call_number")
    return records.select("*", lc_class(c).alias("lc_class"), lc_number(c).alias("lc_number"), lc_key(c).alias("lc_key"))


def ordered(shelf: DataFrame) -> DataFrame:
    """Shelf order: by key, then call number, then id; rows without key last."""
    return shelf.orderBy(F.col("lc_key").asc_nulls_last(), F.col("call_number").asc_nulls_last(), F.col("id").asc_nulls_last())


def page(shelf: DataFrame, offset: int, limit: int) -> DataFrame:
    return ordered(shelf).offset(offset).limit(limit)


def sequence_gaps(shelf: DataFrame, least: int) -> DataFrame:
    """(lc_class, before, after, gap): numbers of a class between which at
    least ``least`` whole numbers are missing.

    Distinct whole numbers are taken first and cut into stretches of 1,000; a
    stretch is a window partition, and only its ends are compared across
    stretches, so no partition holds a whole class.
    """
    whole = shelf.where(F.col("lc_number").isNotNull()).select("lc_class", F.floor("lc_number").alias("number")).distinct()
    cut = whole.withColumn("stretch", F.floor(F.col("number") / 1000))
    inside = Window.partitionBy("lc_class", "stretch").orderBy("number")
    near = cut.withColumn("before", F.lag("number").over(inside)).where(F.col("before").isNotNull()).select("lc_class", "before", F.col("number").alias("after"))
    ends = cut.groupBy("lc_class", "stretch").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    across = Window.partitionBy("lc_class").orderBy("stretch")
    far = ends.withColumn("before", F.lag("high").over(across)).where(F.col("before").isNotNull()).select("lc_class", "before", F.col("low").alias("after"))
    return near.unionByName(far).withColumn("gap", F.col("after") - F.col("before")).where(F.col("gap") > least)


def repeated_numbers(shelf: DataFrame) -> DataFrame:
    """(call_number, n): call numbers borne by more than one id."""
    held = shelf.where(F.trim("call_number") != "")
    return held.groupBy("call_number").agg(F.count_distinct("id").alias("n")).where("n > 1")


#: Rows of one class in a window partition.
BLOCK = 100_000


def positioned(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``df`` with ``position``: the place of each row within its ``by``, from
    1, in an order that must be total.

    One range exchange sorts the rows across the cluster.  It is written once,
    since the bounds of the ranges must not change between its two readings;
    the window over the counts has one row per range and class.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    ranges = max(2 * cores, 4, -(-df.count() // BLOCK))  # as many as the rows need, so that a range fits a task
    ranged = df.repartitionByRange(ranges, by, *order).withColumn("_stretch", F.spark_partition_id())
    ranged = written(ranged, "positioned")
    counts = ranged.groupBy(by, "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(by, "_stretch").orderBy(*order)
    numbered = ranged.withColumn("_within", F.row_number().over(inside)).join(offsets, [by, "_stretch"])
    return numbered.withColumn("position", F.col("_before") + F.col("_within")).drop("_stretch", "_within", "_before")


def blocked(df: DataFrame, by: str, around: int, block: int = BLOCK) -> DataFrame:
    """Positioned rows with ``_block`` and ``_home``: rows within ``around`` of
    a block's edge are also in the block beyond it, with ``_home`` false."""
    here = F.floor((F.col("position") - 1) / block)
    low, high = F.floor((F.col("position") - 1 - around) / block), F.floor((F.col("position") - 1 + around) / block)
    return df.withColumn("_own", here).withColumn("_block", F.explode(F.sequence(low, high))).withColumn("_home", F.col("_block") == F.col("_own")).drop("_own")


def neighbours(shelf: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, lc_class, position, left_id, right_id) within each class."""
    held = shelf.where(F.col("lc_class").isNotNull()).select("id", "lc_class", "lc_key", "call_number")
    rows = blocked(positioned(held, "lc_class", ["lc_key", "call_number", "id"]), "lc_class", 1, block)
    order = Window.partitionBy("lc_class", "_block").orderBy("position")
    seen = rows.select("id", "lc_class", "position", "_home", F.lag("id").over(order).alias("left_id"), F.lead("id").over(order).alias("right_id"))
    return seen.where("_home").drop("_home")


def rolling_mean(scored: DataFrame, value: str, around: int, block: int = BLOCK) -> DataFrame:
    """(id, mean): the mean over the shelf rows up to ``around`` before and
    after, within a class."""
    held = scored.where(F.col("lc_class").isNotNull()).select("id", "lc_class", "lc_key", "call_number", F.col(value).alias("_value"))
    rows = blocked(positioned(held, "lc_class", ["lc_key", "call_number", "id"]), "lc_class", around, block)
    order = Window.partitionBy("lc_class", "_block").orderBy("position").rowsBetween(-around, around)
    return rows.select("id", "_home", F.round(F.avg("_value").over(order), 6).alias("mean")).where("_home").drop("_home")


def segment_means(scored: DataFrame, value: str, width: int = 100) -> DataFrame:
    """(lc_class, segment, n, mean) over stretches of call numbers."""
    segment = F.floor(F.col("lc_number") / width).alias("segment")
    return (
        scored.where(F.col("lc_number").isNotNull())
        .groupBy("lc_class", segment)
        .agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    )


def trend(df: DataFrame, by: str, decade: str) -> DataFrame:
    """(by, decade, n, change): counts by decade and the change from the decade
    listed before; the window runs over the counts, not the rows."""
    counts = df.where(F.col(by).isNotNull() & F.col(decade).isNotNull()).groupBy(by, decade).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(decade)
    return counts.select(by, decade, "n", (F.col("n") - F.lag("n").over(order)).alias("change"))
