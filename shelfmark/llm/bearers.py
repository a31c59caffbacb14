"""Variant spellings of names typed by people (problem 5).

Distinct spellings are counted by record and parsed into keys (see ``naming``).
Spellings with one key name one bearer; a given name that stands for another (a pet
form) is found by the surnames the two share (:func:`other_givens`); keys one edit apart are found by the
metric-space radius join; a key that looks like a slip of a much more frequent
one (a single written form, no life dates of its own) joins it.  Shorter forms
(initials, a dropped middle name, a firm without its kind) join the one bearer
they fit.  Different life dates part bearers of one name; the spellings without
dates then are one more bearer, since those that have a namesake are told apart
by their dates.

Only distinct spellings and keys are joined, never records, so a name shared by
a third of all records is one row from the first aggregation on.

Defined results: null and blank names and stock values have no bearer; a
spelling that fits several bearers alike is linked to none; short spellings that
fit no full name share a bearer if they are one short form; ties for the main
spelling go to the dated and complete form, then to the smaller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import consistent
from shelfmark.llm.metric_join import radius_pairs
from shelfmark.llm.naming import parse
from shelfmark.tables import written

#: A slip has at most this share of the records of the name it stands for.
SLIP = 0.5
#: A shorter form has at most this share of the records of the full one.
SHORTER = 0.3
#: Of several bearers that fit, one with this many times the records of the next is meant.
CLEAR = 4
#: Given names of a surname up to which a meeting under it counts in full; under a surname
#: of more it counts ``RARE`` through their number.
RARE = 8
#: A full meeting in parts; whole numbers, so no order of adding changes a sum.  What is less
#: by a millionth, as rounded parts and quotients may be, is equal.
FULL, EQUAL = 1_000_000_000, 1 - 1e-6
#: Full meetings that show two given names as one at least, their share of the surnames with
#: the rarer one (one in so many), and how many times more often than by chance they meet.
SHOWN, ONE_IN, LIFT = 3, 2, 10


def spellings(df: DataFrame, key: str, row: str, names: list[str], firms: list[str]) -> DataFrame:
    """(kind, spelling, n): distinct spellings and the records holding them."""
    values = consistent.field_values(df.select(key, row, *names, *firms), row, [], [*names, *firms])
    suspicious = consistent.is_suspicious(F.col("value"))
    with_ids = df.select(key, row, *names, *firms)

    def placed(c: str) -> Column:
        return F.coalesce(
            F.transform(c, lambda v, i: F.struct(F.lit(c).alias("field"), i.cast("int").alias("pos"), v.alias("value"))),
            F.array().cast("array<struct<field:string,pos:int,value:string>>"),
        )

    rows = with_ids.select(key, row, F.inline(F.concat(*[placed(c) for c in [*names, *firms]]))).where(F.col("value").isNotNull())
    turned = consistent.consistent_form(rows.where(suspicious), [key, row, "field", "pos"], values)
    both = rows.where(~suspicious).select(key, "field", "value").unionByName(turned.select(key, "field", F.col("form").alias("value")))
    text = F.trim("value")
    firm = F.trim(F.regexp_replace(F.regexp_replace(text, r"^.*? : (?=.*\S)", ""), r", *\[?(?:c|ca\. ?)?\d{4}\??\]?\.?$", ""))
    is_firm = F.col("field").isin(firms)
    return (
        both.select(
            F.when(is_firm, F.lit("publisher")).otherwise(F.lit("name")).alias("kind"),
            F.when(is_firm, firm).otherwise(text).alias("spelling"),
            key,
        )
        .where(F.col("spelling") != "")
        .groupBy("kind", "spelling")
        .agg(F.count_distinct(key).alias("n"))
    )


_PARSED = (
    "kind string, spelling string, n bigint, sort string, keys array<string>, views array<string>, "
    "short boolean, birth string, certain boolean"
)


def _parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for kind, text, n in zip(batch["kind"], batch["spelling"], batch["n"]):
            p = parse(kind, text)
            if p is not None:
                rows.append((kind, text, n, p.sort, p.keys, p.views, p.short, p.birth, len(p.keys) == 1))
        names = ["kind", "spelling", "n", "sort", "keys", "views", "short", "birth", "certain"]
        columns = dict(zip(names, zip(*rows))) if rows else {c: () for c in names}
        objects = {c: pd.Series(list(v), dtype=object) for c, v in columns.items() if c not in ("n", "short", "certain")}
        numbers = {"n": pd.Series(list(columns["n"]), dtype="int64")}
        flags = {c: pd.Series(list(columns[c]), dtype="bool") for c in ("short", "certain")}
        yield pd.DataFrame({c: (objects | numbers | flags)[c] for c in names})


def _own_form(sort: Column, key: Column) -> Column:
    """Under which form shorter or turned names meet: the key of a person with
    ae, oe and ue written for umlauts undone, the sorted words of others."""
    return F.when(sort == "person", F.regexp_replace(key, r"([aou])e", "$1")).otherwise(F.array_join(F.array_sort(F.split(key, " ")), " "))


def _sized(named: DataFrame) -> DataFrame:
    """``named`` (surname, given, n) with what a meeting under the surname counts
    and the class of its size: 0 up to ``RARE`` given names, one more for each
    doubling."""
    sizes = named.groupBy("surname").agg(F.count("*").alias("givens"))
    counts = F.floor(F.lit(float(RARE * FULL)) / F.greatest(F.col("givens"), F.lit(RARE))).cast("bigint")
    doubled = F.floor((F.col("givens") - 1) / RARE).cast("bigint")
    size = F.when(doubled == 0, 0).otherwise(F.length(F.bin(doubled)))
    return named.join(sizes.select("surname", counts.alias("counts"), size.alias("size")), "surname")


def other_givens(sure: DataFrame) -> DataFrame:
    """(given, other): given names that stand for another one (pet forms,
    translations, common slips), read off the names themselves.

    Two given names are one if they meet under surnames far more often than by
    chance: the rarer under half of its surnames or more.  Every surname is looked
    at.  Under a common one all names meet, so a meeting there counts the less the
    more given names the surname has (``_sized``), and less by the share of the
    surnames of like size that hold the other name, which is the chance to meet it:
    where all hold it, a meeting speaks neither for the two nor against them.
    ``sure`` has (sort, key, n) with surname and given name first in the key.

    Not all pairs under a common surname are made.  A given name asks under its
    rarer surnames first; those left out count less than it takes, so who is met only
    there is no other form of it.  Only pairs that could still suffice are looked up
    under the surnames left out."""
    parts = F.split("key", " ")
    named = sure.where(F.col("sort") == "person").select(F.get(parts, F.lit(0)).alias("surname"), F.get(parts, F.lit(1)).alias("given"), "n")
    named = named.where(F.length("given") > 1).groupBy("surname", "given").agg(F.sum("n").alias("n"))
    names = written(_sized(named), "names-sized")

    # What the surnames of a given name count, and the share of the surnames of each size it has.
    n_all = names.groupBy("size").agg(F.count_distinct("surname").alias("n_all"))  # one row for each doubling
    sums = names.groupBy("given", "size").agg(F.sum("counts").alias("counts"), F.count("*").alias("n")).join(F.broadcast(n_all), "size")
    own = Window.partitionBy("given")
    sums = sums.withColumn("total", F.sum("counts").over(own)).withColumn("onward", F.sum("counts").over(own.orderBy(F.desc("size"))))
    enough = F.greatest(F.lit(SHOWN * FULL), F.col("total") / ONE_IN) * EQUAL

    def by_size(value: Column) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct("size", value.alias("value")))))

    able = sums.withColumn("enough", enough).where(F.col("total") >= F.col("enough")).groupBy("given").agg(
        F.max("enough").alias("enough"),
        F.max(F.when(F.col("onward") >= F.col("enough"), F.col("size"))).alias("last"),
        F.coalesce(F.max(F.when(F.col("onward") < F.col("enough"), F.col("onward"))), F.lit(0)).alias("left_out"),
        by_size(F.col("counts")).alias("counts_by"),
        by_size(F.col("n") / F.col("n_all")).alias("share_by"),
    )
    able = written(able, "names-able")
    telling = F.floor(F.col("counts") * (1 - F.col("share_by")[F.col("size")])).cast("bigint")
    held = names.join(able.select("given", "last", "share_by"), "given").withColumn("telling", telling).drop("share_by")
    held = written(held, "names-held")
    others = held.select("surname", F.col("given").alias("other"), F.col("n").alias("n_other"), F.col("telling").alias("tells"))
    differ = (F.col("given") != F.col("other")) & (F.col("n_other") >= F.col("n"))
    summed = [F.sum("counts").alias("shown"), F.sum("tells").alias("told")]
    met = held.where(F.col("size") <= F.col("last")).join(others, "surname").where(differ).groupBy("given", "other").agg(*summed)

    def total(value: Callable[[Column, Column], Column]) -> Column:
        """Over the sizes of surnames: what those of one name count, and the share that holds the other."""
        none = F.lit(0.0)
        at = F.map_zip_with("counts_by", "share_by", lambda _, counts, share: value(F.coalesce(counts, none), F.coalesce(share, none)))
        return F.aggregate(F.map_values(at), none, lambda x, y: x + y)

    met = met.join(able.select("given", "enough", "left_out", "counts_by"), "given").join(able.select(F.col("given").alias("other"), "share_by"), "other")
    own_told, chance = total(lambda counts, share: counts * (1 - share)), total(lambda counts, share: counts * share * (1 - share))
    # SHOWN full meetings at LIFT times chance tell this much at least.
    met = met.withColumn("least", F.greatest(F.lit(SHOWN * FULL * (1 - 1 / LIFT)), own_told / ONE_IN, LIFT * chance) * EQUAL)
    met = met.where((F.col("shown") + F.col("left_out") >= F.col("enough")) & (F.col("told") + F.col("left_out") >= F.col("least")))
    met = written(met.select("given", "other", "shown", "told", "left_out", "enough", "least"), "names-met")
    open_pairs = met.where(F.col("left_out") > 0).select("given", "other")
    late = held.where(F.col("size") > F.col("last")).join(open_pairs, "given").join(others, ["surname", "other"]).where(differ)
    late = late.groupBy("given", "other").agg(*summed)
    kept = met.unionByName(late, allowMissingColumns=True).groupBy("given", "other").agg(
        F.sum("shown").alias("shown"), F.sum("told").alias("told"), F.max("enough").alias("enough"), F.max("least").alias("least")
    )
    kept = kept.where((F.col("shown") >= F.col("enough")) & (F.col("told") >= F.col("least")))
    two = _first(kept.select("given", F.col("shown").alias("n_b"), F.col("other").alias("key_b")), ["given"], 2).groupBy("given")
    best = two.agg(F.max(F.struct("n_b", "key_b")).alias("best"), F.min("n_b").alias("second"), F.count("*").alias("fitting"))
    return best.where((F.col("fitting") == 1) | (F.col("best.n_b") > F.col("second"))).select("given", F.col("best.key_b").alias("other"))


def _with_other(rows: DataFrame, givens: DataFrame) -> DataFrame:
    """``rows`` with ``other_key``: the key of a person with the given name its
    own stands for, or null."""
    parts = F.split("key", " ")
    asked = rows.withColumn("given", F.when(F.col("sort") == "person", F.get(parts, F.lit(1))))
    turned = F.concat_ws(" ", F.get(parts, F.lit(0)), F.col("other"), F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), " "))
    joined = asked.join(givens, "given", "left").withColumn("other_key", F.when(F.col("other").isNotNull(), F.rtrim(turned)))
    return joined.drop("given", "other")


def bearers(counted: DataFrame) -> DataFrame:
    """(kind, spelling, n, bearer) of every spelling that has one."""
    parsed = written(counted.mapInPandas(_parse_all, _PARSED), "names-parsed")
    born = F.when(F.col("birth") != "", F.col("birth"))
    sure = parsed.where("certain AND NOT short").withColumn("key", F.get("keys", F.lit(0)))
    known = sure.groupBy("sort", "key").agg(F.sum("n").alias("n"), F.count("*").alias("forms"), F.count(born).alias("dated"))

    givens = written(other_givens(known), "names-givens")

    # Names whose order is open take the order that is known.
    open_keys = parsed.where("NOT certain AND NOT short").select("kind", "spelling", "n", "birth", "sort", F.posexplode("keys").alias("at", "key"))
    open_keys = _with_other(open_keys, givens).select(
        "kind", "spelling", "n", "birth", "sort", "at", F.posexplode(F.array_compact(F.array("key", "other_key"))).alias("turned", "key")
    )
    tried = open_keys.join(known.select("sort", "key", F.col("n").alias("n_known")), ["sort", "key"], "left")
    chosen = tried.groupBy("kind", "spelling", "n", "birth", "sort").agg(
        F.max(F.when(F.col("n_known").isNotNull(), F.struct("n_known", (-F.col("at")).alias("early"), "key")))["key"].alias("key"),
        F.min(F.struct("at", "turned", "key"))["key"].alias("first_key"),
        F.collect_list("key").alias("keys"),
    )
    placed = written(
        sure.select("kind", "spelling", "n", "birth", "sort", "key", F.array("key").alias("keys"), F.lit(True).alias("matched")).unionByName(
            chosen.select("kind", "spelling", "n", "birth", "sort", F.coalesce("key", "first_key").alias("key"), "keys", F.col("key").isNotNull().alias("matched"))
        ),
        "names-placed",
    )
    lone = placed.where(~F.col("matched")).select("sort", F.col("key").alias("own"), "n", F.explode("keys").alias("key"))

    # Keys one edit apart; a slip joins the most frequent key near it.
    nodes = known.select("sort", "key").unionByName(lone.select("sort", "key")).distinct()
    near = written(radius_pairs(nodes, "sort", "key"), "names-near")
    lone_sum = lone.groupBy("sort", "own", "key").agg(F.sum("n").alias("n"))
    asking = (
        known.select("sort", "key", F.col("key").alias("own"), "n", "forms", "dated")
        .unionByName(lone_sum.select("sort", "key", "own", "n", F.lit(1).cast("bigint").alias("forms"), F.lit(0).cast("bigint").alias("dated")))
    )
    plain_e = r"([aou])e"
    same_letters = F.regexp_replace("key", plain_e, "$1") == F.regexp_replace("key_b", plain_e, "$1")
    slips = (
        asking.join(near.withColumnRenamed("key_a", "key"), ["sort", "key"])
        .join(known.select("sort", F.col("key").alias("key_b"), F.col("n").alias("n_b")), ["sort", "key_b"])
        .where((F.col("n_b") > F.col("n")) & (F.col("dated") == 0))
        .where(same_letters | ((F.col("forms") == 1) & (F.col("n") <= F.greatest(F.lit(3), F.lit(SLIP) * F.col("n_b")))))
        .groupBy("sort", F.col("own").alias("key"))
        .agg(F.max(F.struct("n_b", "key_b"))["key_b"].alias("to"))
    )
    roots = placed.select("sort", "key").distinct().join(slips, ["sort", "key"], "left").withColumn("root", F.coalesce("to", "key")).drop("to")
    roots = _followed(roots, "names-roots")

    # Anchors: keys that are no slips, with all their records.
    anchored = placed.join(roots, ["sort", "key"])
    anchors = anchored.groupBy("sort", F.col("root").alias("key")).agg(F.sum("n").alias("n"), F.count_distinct(born).alias("dates"))
    views = (
        parsed.where("NOT short")
        .select("sort", F.get("keys", F.lit(0)).alias("key"), F.explode("views").alias("form"))
        .distinct()
        .join(anchors.select("sort", "key", F.col("n").alias("n_b")), ["sort", "key"])
        .select("sort", F.when(F.col("sort") == "person", _own_form(F.col("sort"), F.col("form"))).otherwise(F.col("form")).alias("form"), F.col("key").alias("key_b"), "n_b")
    )
    views = views.unionByName(anchors.select("sort", _own_form(F.col("sort"), F.col("key")).alias("form"), F.col("key").alias("key_b"), F.col("n").alias("n_b"))).distinct()
    views = written(views, "names-views")

    # Shorter and turned forms join the bearer they fit.  What makes a bearer fit
    # holds for every more frequent one too, so the three first of a form suffice.
    own = _with_other(anchors, givens)
    forms = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), _own_form(F.col("sort"), F.col(k))) for k in ("key", "other_key")]))
    own = own.select("sort", "key", "n", "dates", F.posexplode(forms).alias("turned", "form"))
    fitting = (
        own.join(_first(views, ["sort", "form"], 3), ["sort", "form"])
        .where((F.col("key_b") != F.col("key")) & (F.struct("n_b", "key_b") > F.struct("n", "key")) & ((F.col("dates") == 0) | (F.col("turned") == 1)))
        .where((F.col("sort") != "person") | (F.col("turned") == 1) | (F.col("n") <= F.greatest(F.lit(3), F.lit(SHORTER) * F.col("n_b"))))
    )
    shorter = _clear_choice(fitting.groupBy("sort", "key", "key_b").agg(F.max("n_b").alias("n_b")), ["sort", "key"])
    anchored_to = anchors.select("sort", "key").join(shorter, ["sort", "key"], "left").withColumn("root", F.coalesce("to", "key")).drop("to")
    anchored_to = _followed(anchored_to, "names-anchors")

    def with_root(rows: DataFrame) -> DataFrame:
        return rows.join(anchored_to.withColumnRenamed("root", "final"), ["sort", "key"]).drop("key").withColumnRenamed("final", "key")

    full = with_root(anchored.select("kind", "spelling", "n", "birth", "sort", F.col("root").alias("key")))
    brief = parsed.where("short").select("kind", "spelling", "n", "birth", "sort", F.get("keys", F.lit(0)).alias("asked"))
    brief = brief.withColumn("form", _own_form(F.col("sort"), F.col("asked")))
    rooted_views = views.join(anchored_to.select("sort", F.col("key").alias("key_b"), "root"), ["sort", "key_b"])
    rooted_views = rooted_views.groupBy("sort", "form", F.col("root").alias("key_b")).agg(F.max("n_b").alias("n_b"))
    fits = rooted_views.join(brief.select("sort", "form").distinct(), ["sort", "form"], "left_semi")
    fits = _first(fits, ["sort", "form"], 2).select("sort", "form", "n_b", "key_b")
    meant = fits.select("sort", "form").distinct().join(_clear_choice(fits, ["sort", "form"]), ["sort", "form"], "left").withColumn("fits", F.lit(True))
    # A short form that fits no full one is a bearer of its own.
    own_key = F.when(F.col("fits").isNull(), F.concat(F.lit("~"), "form")).otherwise(F.col("to"))
    met = brief.join(meant, ["sort", "form"], "left").withColumn("key", own_key).where("key IS NOT NULL")
    every = full.unionByName(met.select("kind", "spelling", "n", "birth", "sort", "key"))

    # Life dates part bearers of one name.
    dates = every.groupBy("sort", "key").agg(F.count_distinct(born).alias("dates"))
    parted = every.join(dates, ["sort", "key"])
    bearer = F.when(F.col("dates") <= 1, F.col("key")).otherwise(F.concat_ws("|", "key", "birth"))
    return parted.select("kind", "spelling", "n", "sort", "birth", bearer.alias("bearer")).where(F.col("bearer").isNotNull())


def _followed(steps: DataFrame, name: str) -> DataFrame:
    """(sort, key, root) with the last root of every chain: roots of roots are
    taken until none moves, which doubles the length followed each time.  Every
    step leads to a more frequent key, so there are no circles."""
    while True:
        nxt = steps.select("sort", F.col("key").alias("root"), F.col("root").alias("next"))
        moved = F.coalesce(F.col("next") != F.col("root"), F.lit(False)).alias("moved")
        steps = written(steps.join(nxt, ["sort", "root"], "left").select("sort", "key", F.coalesce("next", "root").alias("root"), moved), name)
        if steps.where("moved").isEmpty():
            return steps.drop("moved")
        steps = steps.drop("moved")


def _first(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` most frequent rows (n_b, key_b) per ``by``: every task keeps
    no more than these before anything is shuffled."""
    ranked = Window.partitionBy(*by).orderBy(F.desc("n_b"), F.desc("key_b"))
    return rows.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= most).drop("_rank")


def _clear_choice(fitting: DataFrame, by: list[str]) -> DataFrame:
    """(by, to): the only fitting key, or the one clearly more frequent."""
    two = _first(fitting, by, 2).groupBy(*by).agg(F.max(F.struct("n_b", "key_b")).alias("first"), F.min("n_b").alias("second"), F.count("*").alias("fitting"))
    clear = (F.col("fitting") == 1) | (F.col("first.n_b") >= CLEAR * F.col("second"))
    return two.where(clear).select(*by, F.col("first.key_b").alias("to"))


def linked_spellings(counted: DataFrame) -> DataFrame:
    """(kind, name_a, name_b): each spelling with the main one of its bearer."""
    named = written(bearers(counted), "names-bearers")
    rank = F.struct("n", (F.col("birth") != "").alias("dated"), F.locate(",", F.col("spelling")).cast("boolean").alias("comma"))
    top = named.groupBy("kind", "sort", "bearer").agg(F.max(rank).alias("rank"))
    mains = (
        named.withColumn("rank", rank)
        .join(top, ["kind", "sort", "bearer", "rank"])
        .groupBy("kind", "sort", "bearer")
        .agg(F.min("spelling").alias("main"))
    )
    return (
        named.join(mains, ["kind", "sort", "bearer"])
        .where(F.col("spelling") != F.col("main"))
        .select("kind", F.least("spelling", "main").alias("name_a"), F.greatest("spelling", "main").alias("name_b"))
        .distinct()
    )
