"""Facet counts and summaries.

All counts combine on the map side; dimensions with a fixed list of values are
joined so that empty buckets show as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.fields import display_year
from shelfmark.functions.vocabulary import BUCKETS, SHARDS, SOURCE_CAP
from shelfmark.tables import written

DECADES = [(f"{d}s", d, d + 9) for d in range(1940, 2030, 10)]


def _fixed(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, place int")


def counted(df: DataFrame, facet: Column, values: list[str], name: str = "facet") -> DataFrame:
    """(facet, place, n) for every value of the list, zero included."""
    counts = df.select(facet.alias(name)).where(F.col(name).isin(values)).groupBy(name).agg(F.count("*").alias("n"))
    return _fixed(df.sparkSession, values, name).join(counts, name, "left").select(name, "place", F.coalesce("n", F.lit(0)).alias("n"))


def facet_counts(df: DataFrame, facets: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """(group, facet, place, n) over several facets in one pass over the rows;
    new facets are passed by the caller."""
    pairs = F.array(*[F.struct(F.lit(g).alias("group"), c.cast("string").alias("facet")) for g, (c, _) in facets.items()])
    counts = df.select(F.inline(pairs)).groupBy("group", "facet").agg(F.count("*").alias("n"))
    known = [(g, v, i) for g, (_, values) in facets.items() for i, v in enumerate(values)]
    wanted = df.sparkSession.createDataFrame(known, "group string, facet string, place int")
    return wanted.join(counts, ["group", "facet"], "left").select("group", "facet", "place", F.coalesce("n", F.lit(0)).alias("n"))


def range_label(year: Column, ranges: list[tuple[str, int, int]]) -> Column:
    out = F.lit(None).cast("string")
    for label, first, last in ranges:
        out = F.when(year.between(first, last), label).otherwise(out)
    return out


def by_decade(records: DataFrame, as_of: int) -> DataFrame:
    year = display_year(F.col("year"), as_of)
    return counted(records, range_label(year, DECADES), [d[0] for d in DECADES])


def call_letter(call_number: Column) -> Column:
    first = F.upper(F.substring(F.coalesce(call_number, F.lit("")), 1, 1))
    return F.when(first.rlike("^[0-9A-Z]$"), first).otherwise("Other")


def by_call_letter(records: DataFrame) -> DataFrame:
    values = [*"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "Other"]
    return counted(records, call_letter(F.col("call_number")), values)


def flag_shares(packets: DataFrame, flags: str = "evidence_flags") -> DataFrame:
    """(flag, n, pct): rows with each flag, in percent of all rows."""
    names = packets.schema[flags].dataType.names
    counts = packets.agg(F.count("*").alias("total"), *[F.count_if(F.col(f"{flags}.{n}")).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in names])
    return counts.select("total", F.inline(rows)).select(
        "flag", "n", F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("total")), F.lit(0.0)), 1).alias("pct")
    )


def bucket_shares(scored: DataFrame, column: str = "photo_insert_bucket") -> DataFrame:
    """(bucket, place, n, pct) in fixed order; other buckets count in the total."""
    values = [b for b, _ in BUCKETS]
    counts = scored.groupBy(F.col(column).alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = _fixed(scored.sparkSession, values, "bucket").join(counts, "bucket", "left").crossJoin(F.broadcast(total))  # one row
    n = F.coalesce("n", F.lit(0))
    return out.select("bucket", "place", n.alias("n"), F.round(F.coalesce(F.try_divide(100.0 * n, F.col("total")), F.lit(0.0)), 1).alias("pct"))


def match_rate(base: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """(total, matched, rate): rows of ``base`` whose key has a score."""
    keys = scores.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    joined = base.join(keys, F.col(key) == F.col("_k"), "left")
    hit = F.count_if(F.col("_k").isNotNull())
    return joined.agg(F.count("*").alias("total"), hit.alias("matched"), F.round(F.coalesce(F.try_divide(hit, F.count("*")), F.lit(0.0)), 6).alias("rate"))


def quantiles(df: DataFrame, column: str, at: tuple[float, ...]) -> DataFrame:
    """(p, value): exact quantiles, interpolated, of a column of any number of
    different values; no rows for a column without values.

    Equal values are counted first; their places come from one range exchange and
    the totals of the ranges, so no task holds more than one range of different
    values, and only the two values around each place are brought together."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    ranged = written(values.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "quantiles")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("below"))  # a row per range
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    placed = ranged.withColumn("upto", inside).join(F.broadcast(parts), "part").select("x", (F.col("below") + F.col("upto") - F.col("n")).alias("first"), (F.col("below") + F.col("upto") - 1).alias("last"))
    total = ranged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    asked = total.select(F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("p"), "total").withColumn("place", F.col("p") * (F.col("total") - 1))
    low, high = F.floor("place"), F.ceil("place")
    around = ((F.col("first") <= low) & (F.col("last") >= low)) | ((F.col("first") <= high) & (F.col("last") >= high))
    near = placed.join(F.broadcast(asked), around)  # as many rows as quantiles are asked for
    value = F.min("x") + (F.max("x") - F.min("x")) * (F.col("place") - F.floor("place"))
    return near.groupBy("p", "place").agg(value.alias("value")).select("p", "value")


def score_summary(scored: DataFrame, column: str = "photo_insert_score") -> DataFrame:
    """Average, extremes and the five numbers, interpolated."""
    x, five = F.col(column), (0.0, 0.25, 0.5, 0.75, 1.0)
    rows = quantiles(scored, column, five)
    numbers = rows.agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 6).alias(f"q{i}") for i, p in enumerate(five)])
    one = scored.agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("avg"), F.min(x).alias("least"), F.max(x).alias("most"))
    return one.crossJoin(F.broadcast(numbers))  # one row each


def overlap(df: DataFrame, items: str) -> DataFrame:
    """(a, b, n): rows holding both of two themes; a theme with itself gives
    its own count.  Each row holds few themes, so pairs stay few."""
    each = df.select(F.array_sort(F.array_distinct(items)).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 1, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return each.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))


def gaps(df: DataFrame, classes: list[str], column: str) -> DataFrame:
    """(class, n, share, gap): the share of each class against the mean share."""
    counts = counted(df, F.col(column), classes, "lc_class")
    total = counts.agg(F.sum("n").alias("total"))
    share = F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0))
    return counts.crossJoin(F.broadcast(total)).select(  # one row
        "lc_class", "n", F.round(share, 6).alias("share"), F.round(share - F.lit(1.0 / len(classes)), 6).alias("gap")
    )


def duplicates(df: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """(digest, n_ids): texts borne by more than one id."""
    hashed = df.select(F.sha2(text, 256).alias("digest"), key)
    return hashed.groupBy("digest").agg(F.count_distinct(key).alias("n_ids")).where("n_ids > 1")


def over_cap(df: DataFrame, as_of: int, cap: int = SOURCE_CAP) -> DataFrame:
    """(shard, n, over): publication ranges and whether they pass the cap."""
    year = display_year(F.col("year"), as_of)
    return counted(df, range_label(year, SHARDS), [s[0] for s in SHARDS], "shard").select("shard", "n", (F.col("n") > cap).alias("over"))


def outliers(df: DataFrame, by: str, value: str, times: float = 3.0) -> DataFrame:
    """Rows whose value is ``times`` standard deviations off their group's
    mean.  Group moments are aggregated and joined back: no window holds a
    group, however large."""
    moments = df.groupBy(F.col(by).alias("_by")).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))
    return df.join(moments, F.col(by) == F.col("_by")).withColumn("z", F.round(z, 6)).where(F.abs("z") > times).drop("_by", "_mean", "_sd")


def clusters(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """``df`` with ``cluster``, the group of similar rows by the numbers and flags
    in ``columns`` (null counts as 0), each put on the scale of its deviation.
    Lloyd's iterations run over the rows; ``k`` centres are all that moves."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    numbers = df.withColumns({f"_c{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(columns)})
    steps = [
        VectorAssembler(inputCols=[f"_c{i}" for i in range(len(columns))], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled"),
        KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="cluster"),
    ]
    if df.isEmpty():
        return df.withColumn("cluster", F.lit(None).cast("int"))
    made = Pipeline(stages=steps).fit(numbers).transform(numbers)
    return made.drop("_raw", "_scaled", *[f"_c{i}" for i in range(len(columns))])
