"""Radius join of strings under a true edit metric by metric-space cells.

Method: metric-space partitioning.  Some strings serve as pivots.  Each string
has its home in the cell of its nearest pivot and is a visitor in every cell whose
pivot is at most twice the radius farther away; by the triangle inequality any two
strings within the radius then meet in the home cell of either.  Cells are split
further by length (two strings within the radius differ by at most the radius in
length).  A cell that is still large is partitioned once more by pivots of its own,
and so on: the pivots of one level are bounded, the number of cells grows with the
strings.  What no pivot can part is split by its home members, so no task holds an
unbounded cell.

The metric is the Levenshtein distance, computed in the JVM for the pivots as
for the pairs.  Two neighbouring letters exchanged are two steps in it; such pairs are
found exactly by an equality join of every string with the exchanges of the others,
so the radius can stay small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.edits import distance
from shelfmark.tables import written

#: Home members of a cell compared in one join group at most; larger ones are split.
PART = 4_000
#: Pivots of the first level at most, pivots of a cell that is split, and levels of splitting.
MOST_PIVOTS, OWN_PIVOTS, LEVELS = 1024, 32, 4


def chosen_pivots(keys: DataFrame, key: str) -> list[str]:
    """Pivots spread over the keys by hash; their number grows as the square
    root of the keys, up to a bound beyond which cells are split."""
    wanted = min(MOST_PIVOTS, max(8, round(math.sqrt(keys.count()) / 2)))
    return [r[0] for r in keys.select(key).distinct().orderBy(F.xxhash64(key), key).limit(wanted).collect()]


def members(keys: DataFrame, group: str, key: str, pivots: list[str], radius: int) -> DataFrame:
    """(group, cell, key, home): every string in its home cell and in all cells
    whose pivot is at most twice the radius farther away than its nearest."""
    far = F.transform(F.array(*map(F.lit, pivots)), lambda p: F.levenshtein(F.col(key), p))
    # The keys are few bytes but each costs a distance to every pivot: spread them over all cores.
    spread = keys.repartition(4 * keys.sparkSession.sparkContext.defaultParallelism, key)
    near = spread.select(group, key, far.alias("far")).withColumn("least", F.array_min("far"))
    # Cells are chosen inside the array: a row filter, or a plain explode, would
    # make the optimizer compute the distances once more in a filter below.
    placed = F.transform("far", lambda d, i: F.struct(i.cast("int").alias("cell"), d.alias("d")))
    chosen = F.filter(placed, lambda c: c["d"] <= F.col("least") + 2 * radius)
    home = (F.array_position("far", F.col("least")) - 1).cast("int")
    rows = near.select(group, key, home.alias("home_cell"), F.explode_outer(chosen).alias("c"))
    return rows.select(group, F.col("c.cell").alias("cell"), key, (F.col("c.cell") == F.col("home_cell")).alias("home"))


def _large(placed: DataFrame, group: str) -> DataFrame:
    """(group, cell, length): the cells with more home members than PART."""
    return placed.where("home").groupBy(group, "cell", "length").agg(F.count("*").alias("n")).where(F.col("n") > PART).drop("n")


def split_cells(placed: DataFrame, group: str, key: str, radius: int) -> DataFrame:
    """``placed`` with every large cell parted by pivots of its own, taken from
    its home members by hash.  The rule of :func:`members` holds inside a cell as
    it does outside; a cell of members of one length is parted with all visitors
    that a home member of that length can meet."""
    for level in range(LEVELS):
        large = written(_large(placed, group).withColumnRenamed("length", "of"), f"metric-large-{level}")
        if large.isEmpty():
            break
        of = F.col("length") == F.col("of")
        cells = placed.join(large, [group, "cell"], "left")
        near = F.abs(F.col("length") - F.col("of")) <= radius
        asked = cells.where(F.col("of").isNotNull() & near).withColumn("home", F.col("home") & of)
        # Visitors for home members of other lengths stay in the cell as it was.
        rest = placed.join(large.withColumnRenamed("of", "length"), [group, "cell", "length"], "left_anti")
        moved = placed.join(large.withColumnRenamed("of", "length"), [group, "cell", "length"], "left_semi").withColumn("home", F.lit(False))
        by_hash = Window.partitionBy(group, "cell", "of").orderBy(F.xxhash64(key), key)
        pivots = asked.where("home").withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= OWN_PIVOTS)
        pivots = pivots.groupBy(group, "cell", "of").agg(F.sort_array(F.collect_list(key)).alias("pivots"))  # OWN_PIVOTS strings
        far = F.transform("pivots", lambda p: F.levenshtein(F.col(key), p))
        spread = asked.join(pivots, [group, "cell", "of"]).withColumn("far", far).withColumn("least", F.array_min("far"))
        own = F.transform("far", lambda d, i: F.struct(i.cast("int").alias("at"), d.alias("d")))
        chosen = F.filter(own, lambda c: c["d"] <= F.col("least") + 2 * radius)
        at_home = (F.array_position("far", F.col("least")) - 1).cast("int")
        inside = spread.select(group, "cell", "of", key, "length", "home", at_home.alias("at_home"), F.explode_outer(chosen).alias("c")).select(
            group, F.concat_ws("/", "cell", F.col("of").cast("string"), F.col("c.at").cast("string")).alias("cell"), key,
            (F.col("home") & (F.col("c.at") == F.col("at_home"))).alias("home"), "length",
        )
        placed = written(rest.unionByName(moved).unionByName(inside), f"metric-members-{level}")
    return placed


def radius_pairs(keys: DataFrame, group: str, key: str, radius: int = 1) -> DataFrame:
    """(group, key_a, key_b): all ordered pairs of different keys of one group
    within the radius, or with two neighbouring letters exchanged.  ``keys``
    holds each (group, key) once and no nulls."""
    keys = written(keys.select(group, key), "metric-keys")
    pivots = chosen_pivots(keys, key)
    if not pivots:
        return keys.select(group, F.col(key).alias("key_a"), F.col(key).alias("key_b")).limit(0)
    placed = members(keys, group, key, pivots, radius).withColumn("cell", F.col("cell").cast("string")).withColumn("length", F.length(key))
    placed = split_cells(written(placed, "metric-members"), group, key, radius)
    sizes = placed.where("home").groupBy(group, "cell", "length").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    homes = placed.where("home").join(sizes, [group, "cell", "length"]).select(
        group, "cell", "length", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"), F.col(key).alias("key_a")
    )
    # A home member of length L meets members of lengths L-radius to L+radius.
    shifts = F.explode(F.array(*[F.lit(k) for k in range(-radius, radius + 1)]))
    others = placed.select(group, "cell", F.col("length").alias("own"), F.col(key).alias("key_b"), shifts.alias("shift")).select(
        group, "cell", (F.col("own") + F.col("shift")).alias("length"), "key_b"
    )
    others = others.join(sizes, [group, "cell", "length"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # Few bytes but many distances a row: more tasks than the bytes would get.
    by = [group, "cell", "length", "part"]
    tasks = 8 * keys.sparkSession.sparkContext.defaultParallelism
    met = homes.repartition(tasks, *by).join(others.repartition(tasks, *by), by).where(
        (F.col("key_a") != F.col("key_b")) & (F.levenshtein("key_a", "key_b", radius) >= 0)
    )
    return met.select(group, "key_a", "key_b").unionByName(exchanged(keys, group, key)).distinct()


def exchanged(keys: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key_a, key_b): keys that differ by one exchange of neighbouring
    letters: every exchange of a key is looked up among the keys, so keys of many
    equal letters meet no others."""

    def swapped(i: Column) -> Column:
        k = F.col(key)
        one, two = F.substring(k, i, F.lit(1)), F.substring(k, i + 1, F.lit(1))
        return F.when(one != two, F.concat(F.substring(k, F.lit(1), i - 1), two, one, F.substring(k, i + 2, F.length(k))))

    places = F.when(F.length(key) > 1, F.sequence(F.lit(1), F.length(key) - 1))
    turned = keys.select(group, F.col(key).alias("key_a"), F.explode_outer(F.transform(places, swapped)).alias(key)).where(F.col(key).isNotNull())
    return turned.join(keys, [group, key], "left_semi").select(group, "key_a", F.col(key).alias("key_b"))


def brute_pairs(keys: list[str], radius: int = 1) -> set[tuple[str, str]]:
    """The same pairs by comparing all, for tests."""
    return {(a, b) for a in keys for b in keys if a != b and distance(a, b, radius) <= radius}
