"""Pairs against counting all of them; survivorship against a plain loop."""

import itertools
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shelfmark.llm import pairs, queries, survivors


def test_pairs_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(str(rng.randrange(60)), i, [rng.choice(["a", "b", "с", "c", " d ", "", None, "ｅ", "e"]) for _ in range(rng.randrange(6))]) for i in range(200)]
    rows += [("hot", 1000 + i, ["a", "b"]) for i in range(100)] + [(None, 5000, ["a", "b"]), ("x", 5001, None)]
    df = spark.createDataFrame(rows, "id string, ord bigint, subjects array<string>").withColumn("items", F.lit("clash"))
    held = defaultdict(set)
    turned = {"с": "c", "ｅ": "e", " d ": "d"}
    for i, _, items in rows:
        for x in items or []:
            if i is not None and x and x.strip():
                held[i].add(turned.get(x, x))
    held = {k: v for k, v in held.items() if v}
    single, both = Counter(), Counter()
    for v in held.values():
        single.update(v)
        both.update(itertools.combinations(sorted(v), 2))
    # one script alone has no Latin word beside it, so the look-alike letter counts as Latin only if its group says so
    got = {(r["item_a"], r["item_b"]): (r["n_a"], r["n_b"], r["n_ab"], r["n"]) for r in pairs.pair_scores(pairs.baskets(pairs.records_of(df, "id", "ord", ["subjects"]))).collect()}
    assert got == {k: (single[k[0]], single[k[1]], n, len(held)) for k, n in both.items()}


def test_scores_and_support(spark):
    baskets = spark.createDataFrame([("f", ["a", "b"], 6), ("f", ["c"], 4), ("f", ["a", "c"], 1)], "field string, items array<string>, weight bigint")
    scores = {(r["item_a"], r["item_b"]): r for r in pairs.pair_scores(baskets, 5).collect()}
    assert list(scores) == [("a", "b")]
    r = scores["a", "b"]
    assert round(r["lift"], 6) == round(6 * 11 / (7 * 6), 6) and round(r["conviction"], 6) == round(7 * 5 / (11 * 1), 6)
    assert pairs.pair_scores(baskets, 1, 5).count() == 1
    assert pairs.more_than_chance(pairs.pair_scores(baskets, 1), 2).count() == 0
    assert pairs.pair_scores(baskets.limit(0)).count() == 0


def test_query_scores_every_pair(spark, tmp_path):
    rows = [(str(i), i, ["a", "b"] if i < 6 else ["c", "d"] if i < 8 else ["e", "f"] if i < 9 else ["a", "c", "e"], ["x", "y"] if i == 0 else []) for i in range(10)]
    spark.createDataFrame(rows, "id string, ord bigint, subjects array<string>, collection_tags array<string>").withColumn("title", F.lit("T")).withColumn("authors", F.array(F.lit("A"))).write.parquet(str(tmp_path / "sekula_index.parquet"))
    got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in queries.p3_pairs(spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): 6, ("c", "d"): 2, ("e", "f"): 1, ("a", "c"): 1, ("a", "e"): 1, ("c", "e"): 1, ("x", "y"): 1}
    assert queries.p3_found(spark, str(tmp_path)).count() == 0


S = "ord bigint, id string, frbr_group_id string, harvested_at timestamp, source_system string, title string, uniform_title string, authors array<string>, year string, publishers array<string>, places array<string>, subjects array<string>, description string, call_number string, isbns array<string>, value string"


def row(ord, id, group, at, title="T", description=None, **more):
    import datetime

    base = dict.fromkeys([c.split()[0] for c in S.split(", ")])
    return tuple({**base, "ord": ord, "id": id, "frbr_group_id": group, "harvested_at": datetime.datetime(2025, 1, at), "title": title, "description": description, **more}.values())


def test_survivors(spark):
    rows = [
        row(1, "a", "g", 1, description="Tells something."), row(2, "b", "g", 2, description="N/A.", year="1990"), row(3, "c", "g", 2, description="T. T.", year="c1990"),
        row(4, "d", "h", 1), row(5, "d", "h", 2), row(6, "e", " ", 1), row(7, "f", " ", 1), row(8, "g", None, 1),
        row(9, "p", "k", 3, title=None, description="tbc"), row(10, "q", "k", 3, title="[untitled]", description="—"),
    ]
    df = spark.createDataFrame(rows, S)
    got = {r["frbr_group_id"]: (r["id"], r["description_id"]) for r in survivors.survivors(df).collect()}
    assert got == {"g": ("b", "a"), "k": ("p", "")}
    assert survivors.survivors(df.limit(0)).count() == 0


def test_field_by_field(spark):
    rows = [row(1, "a", "g", 1, year="1990", source_system="ILS"), row(2, "b", "g", 3, year="undated", source_system="X"), row(3, "c", "g", 2, year="1991", source_system="X")]
    df = spark.createDataFrame(rows, S)
    assert survivors.survivors(df).first()["best_year"] == "1991"
    assert survivors.survivors(df, priority={"ILS": 1}).first()["best_year"] == "1990"


def test_stock_values(spark):
    nothing = [None, "", " ", "n/a", "N/A.", "[s.n.]", "S.l.", "[author not named]", "????", "—", "unknown", "no call number", "[in process]", "xxx", "0000000000", "to be assigned", "unknоwn", "Description to follow", "ｎ／ａ"]
    something = ["Unknown pleasures", "None shall pass", "s", "TR 1", "撮影者", "0801", "Place of work", "X-ray"]
    df = spark.createDataFrame([(x,) for x in nothing + something], "x string").select("x", survivors.says_something(F.col("x")).alias("y"))
    got = [r["y"] for r in df.collect()]
    assert got == [False] * len(nothing) + [True] * len(something)


def test_description_that_repeats_the_title(spark):
    cases = [("Über Schiffe", "Über Schiffe.", False), ("Fog years", "Fog years. Fog years.", False), ("A", "A longer text", True), (None, "text", True), ("", "text", True), ("Iron work", "Placeholder entry as part of the bulk load; x", False), ("x", None, False)]
    df = spark.createDataFrame([(t, d) for t, d, _ in cases], "t string, d string").select(survivors.description_says_something(F.col("d"), F.col("t")))
    assert [r[0] for r in df.collect()] == [c[2] for c in cases]


def test_placeholders_read_off_the_corpus(spark):
    held = ["Kept blank by the loader until autumn.", "Kept blank by the loader; ask at the desk."]
    rows = [row(i, f"a{i}", f"g{i // 2}", 1 + i % 2, title=f"Title {i}", description=held[i % 2]) for i in range(12)]
    # A sentence that recurs, but is part of a text found once: no placeholder.
    rows += [row(100 + i, f"b{i}", "h", 1 + i, title=f"Other {i}", description="The cranes of 1931 are shown.") for i in range(4)]
    rows += [row(200, "c", "h", 9, title="Single", description="Lost. The cranes of 1940 are shown. Found.")]
    # One record harvested often, and one title under several ids: no placeholder either.
    rows += [row(300 + i, f"d{i}", "k", 1 + i, title="Same", description="Printed twice over by the same office.") for i in range(5)]
    rows += [row(400, "e", "m", 1, title="T", description=held[0]), row(401, "f", "m", 2, title="U", description=None), row(402, "g", "m", 1, title="V", description="")]
    df = spark.createDataFrame(rows, S).withColumn("stock", F.lit("clash"))
    got = {r["frbr_group_id"]: r["description_id"] for r in survivors.survivors(df.drop("stock"), seeds=None).collect()}
    assert all(got[f"g{k}"] == "" for k in range(6)) and (got["h"], got["k"], got["m"]) == ("c", "d4", "")
    told = df.select(F.lower("description").alias("text"), "title")
    assert survivors.stock_texts(told).count() == 2 and survivors.stock_texts(told.limit(0)).count() == 0


def test_a_third_of_all_rows_share_one_placeholder(spark):
    rows = [row(i, f"i{i}", f"g{i % 20}", 1 + i % 28, title=f"Title {i}", description="Held back for now." if i % 3 else f"Tells of {i} ships.") for i in range(300)]
    got = survivors.survivors(spark.createDataFrame(rows, S), seeds=None).collect()
    assert len(got) == 20 and all(int(r["description_id"][1:]) % 3 == 0 for r in got)
