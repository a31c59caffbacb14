"""Items that appear together (problem 3).

Method: basket collapsing.  Every record becomes a sorted array of its distinct
items; identical arrays are grouped into one basket with a weight; the pairs of
a basket are enumerated once and carry the weight.  Popular baskets, however
many billions of records share them, cost one row.  All three aggregations
combine on the map side, so a hot basket, item or pair never meets in one task
as more than one partial row per upstream task.

Defined results: records are distinct non-null keys; rows repeating a key add
their items to one record; null and blank items are no items; an item counts
once per record; ties have no effect; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import consistent


def records_of(df: DataFrame, key: str, row: str, fields: list[str]) -> DataFrame:
    """(key, field, items): the distinct consistent items of each record.

    ``row`` identifies a row of ``df``.  Lists without a suspicious value stay
    in the JVM; only the others are taken apart, put into the consistent form
    and put together again.
    """
    values = consistent.field_values(df.select(row, *fields), row, [], fields)
    long = df.where(F.col(key).isNotNull()).select(
        F.col(key), F.col(row), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields]))
    )
    odd = F.coalesce(F.exists("raw", consistent.is_suspicious), F.lit(False))
    taken_apart = long.where(odd).select(key, row, "field", F.posexplode("raw").alias("pos", "value"))
    turned = consistent.consistent_form(taken_apart, [row, "field", "pos"], values)
    plain = taken_apart.where(~consistent.is_suspicious(F.col("value")))
    mended = turned.select(row, "field", F.col("form").alias("value")).unionByName(plain.select(row, "field", "value"))
    keyed = mended.groupBy(row, "field").agg(F.collect_set("value").alias("raw"))
    keyed = long.where(odd).select(key, row, "field").join(keyed, [row, "field"])
    both = long.where(~odd).select(key, "field", "raw").unionByName(keyed.select(key, "field", "raw"))
    trimmed = F.array_sort(F.array_distinct(F.filter(F.transform("raw", lambda x: F.trim(x)), lambda x: x != "")))
    each = both.select(key, "field", trimmed.alias("items")).where(F.size("items") > 0)
    united = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return each.groupBy(key, "field").agg(united.alias("items"))


def baskets(records: DataFrame) -> DataFrame:
    """(field, items, weight): identical item arrays grouped."""
    return records.groupBy("field", "items").agg(F.count("*").alias("weight"))


def pair_scores(collapsed: DataFrame, least: int = 1, one_in: int | None = None) -> DataFrame:
    """(field, item_a, item_b, n, n_a, n_b, n_ab, lift, conviction).

    ``item_a`` is the smaller by code point.  Pairs found in fewer than
    ``least`` records or in less than one record in ``one_in`` of the field
    are left out before the item counts are joined.  Conviction is that of
    a implying b; it is null where a never occurs without b.
    """
    totals = collapsed.groupBy("field").agg(F.sum("weight").alias("n"))
    singles = collapsed.select("field", "weight", F.explode("items").alias("item")).groupBy("field", "item")
    singles = singles.agg(F.sum("weight").alias("n_item"))
    firsts = collapsed.select("field", "weight", "items", F.posexplode("items").alias("at", "item_a"))
    rest = F.slice("items", F.col("at") + 2, F.greatest(F.size("items") - F.col("at") - 1, F.lit(0)))
    pairs = (
        firsts.select("field", "weight", "item_a", F.explode(rest).alias("item_b"))
        .groupBy("field", "item_a", "item_b")
        .agg(F.sum("weight").alias("n_ab"))
        .where(F.col("n_ab") >= least)
        .join(F.broadcast(totals), "field")  # one row per field named by the caller
        .where(F.col("n_ab") * F.lit(one_in) >= F.col("n") if one_in else F.lit(True))
    )
    a = singles.select("field", F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = singles.select("field", F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    joined = pairs.join(a, ["field", "item_a"]).join(b, ["field", "item_b"])
    wide = [F.col(c).cast("double") for c in ("n", "n_a", "n_b", "n_ab")]
    n, n_a, n_b, n_ab = wide
    without = n_a - n_ab
    return joined.select(
        "field", "item_a", "item_b", "n", "n_a", "n_b", "n_ab",
        (n_ab * n / (n_a * n_b)).alias("lift"),
        F.when(without > 0, n_a * (n - n_b) / (n * without)).alias("conviction"),
    )


def more_than_chance(scores: DataFrame, times: int) -> DataFrame:
    """Pairs found at least ``times`` as often as chance, exactly (no doubles)."""

    def wide(c: str):
        return F.col(c).cast("decimal(19,0)")

    return scores.where(wide("n_ab") * wide("n") >= wide("n_a") * wide("n_b") * F.lit(times))
