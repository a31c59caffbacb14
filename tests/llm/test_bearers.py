"""Names, the edit metric and the radius join."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import bearers, edits, metric_join
from shelfmark.llm.naming import is_stock, parse, spelling_of_firm

WORD = st.text(alphabet="abc", max_size=5)


@given(WORD, WORD, WORD)
@settings(max_examples=300, deadline=None)
def test_true_metric(a, b, c):
    d = edits.distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


def test_distances():
    assert edits.distance("ca", "abc") == 2 and edits.distance("ab", "ba") == 1 and edits.distance("", "abc") == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_radius_join_by_brute_force(spark, seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(250)})
    df = spark.createDataFrame([("g", w, 1) for w in words] + [("h", "a", 1), ("h", "b", 1)], "grp string, key string, cell int")
    got = {(r["key_a"], r["key_b"]) for r in metric_join.radius_pairs(df, "grp", "key").where("grp = 'g'").collect()}
    assert got == metric_join.brute_pairs(words)


def test_large_cells_are_parted_by_pivots_of_their_own(spark, monkeypatch):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(4, 12))) for _ in range(900)})
    df = spark.createDataFrame([("g", w) for w in words], "grp string, key string")
    monkeypatch.setattr(metric_join, "PART", 10)
    monkeypatch.setattr(metric_join, "MOST_PIVOTS", 3)
    monkeypatch.setattr(metric_join, "OWN_PIVOTS", 4)
    monkeypatch.setattr(metric_join, "LEVELS", 2)
    got = {(r["key_a"], r["key_b"]) for r in metric_join.radius_pairs(df, "grp", "key").collect()}
    assert got == metric_join.brute_pairs(words)


def test_exchanges_among_keys_of_equal_letters(spark):
    keys = ["abba", "baba", "abab", "aabb", "bbaa", "baab", "", "a"]
    df = spark.createDataFrame([("g", k) for k in keys], "grp string, key string")
    got = {(r["key_a"], r["key_b"]) for r in metric_join.exchanged(df, "grp", "key").collect()}
    turned = {(k, k[:i] + k[i + 1] + k[i] + k[i + 2 :]) for k in keys for i in range(len(k) - 1)}
    assert got == {(a, b) for a, b in turned if a != b and b in keys}


def test_radius_join_of_nothing(spark):
    assert metric_join.radius_pairs(spark.createDataFrame([], "grp string, key string"), "grp", "key").count() == 0


SAME = [
    ("name", "Jorimann, Johannes Friedrich, 1976-", ["Johannes Friedrich Jorimann", "JORIMANN, Johannes Friedrich", "Jorimann, Johannes Friedrich (1976-)", "Jorimann Johannes Friedrich"]),
    ("publisher", "Halyard Museum of Yard Work", ["[Halyard Museum of Yard Work]", "Halyard Mus. of Yard Work", "The Halyard Museum of Yard Work", "Museum of Yard Work, Halyard"]),
    ("name", "Association of Net Menders (Ulvmouth)", ["Ulvmouth. Association of Net Menders", "Association of Net Menders [ANM], Ulvmouth", "Assoc. of Net Menders of Ulvmouth"]),
]


@pytest.mark.parametrize("kind, name, others", SAME)
def test_keys_meet(kind, name, others):
    key = parse(kind, name).keys[0]
    for o in others:
        assert key in parse(kind, o).keys, o


def test_stock_and_firms():
    assert all(map(is_stock, ["n/a", "Anon.", "[author not named]", "Unknown", "s.n.", "[publisher not identified]"])) and not is_stock("Anonsen, Per")
    assert spelling_of_firm("Quillmünde : Halyard Press, 1971") == "Halyard Press"


def linked(spark, rows):
    df = spark.createDataFrame(rows, "id string, ord bigint, authors array<string>, contributors array<string>, publishers array<string>")
    out = bearers.linked_spellings(bearers.spellings(df, "id", "ord", ["authors", "contributors"], ["publishers"]))
    return sorted(tuple(r) for r in out.collect())


def many(name, n, start, field=2):
    rows = []
    for i in range(n):
        r = [f"id{start + i}", start + i, [], None, []]
        r[field] = [name]
        rows.append(tuple(r))
    return rows


def test_variants_link_to_the_main_spelling(spark):
    rows = many("Gazewick, Thomas William", 20, 0) + many("Thomas William Gazewick", 2, 100) + many("Gazewick, Thmas William", 2, 200) + many("T. W. Gazewick", 1, 300)
    rows += many("Tom Gazewick", 1, 400, 3) + many("n/a", 30, 500) + many("Other, Person", 3, 600) + many("Gazewick,\xa0Thomas William", 1, 700)
    got = linked(spark, rows)
    main = "Gazewick, Thomas William"
    assert got == sorted(("name", *sorted((main, o))) for o in ["Thomas William Gazewick", "Gazewick, Thmas William", "T. W. Gazewick", "Tom Gazewick"])


def test_life_dates_keep_bearers_apart(spark):
    rows = many("Vask, Pat, 1891-", 5, 0) + many("Vask, Pat, 1917-", 5, 10) + many("VASK, Pat, 1891-", 2, 20) + many("Vask, Pat", 2, 30) + many("Pat Vask", 1, 40)
    assert linked(spark, rows) == [("name", "Pat Vask", "Vask, Pat"), ("name", "VASK, Pat, 1891-", "Vask, Pat, 1891-")]


def test_initials_keep_their_accent(spark):
    rows = many("Vask, Åke", 9, 0) + many("Vask, Astrid", 9, 20) + many("Å. Vask", 1, 40) + many("Vask, A.", 1, 50)
    assert linked(spark, rows) == [("name", "Vask, A.", "Vask, Astrid"), ("name", "Vask, Åke", "Å. Vask")]


def test_close_names_with_forms_of_their_own_stay_apart(spark):
    rows = many("Kedeshaw, Margaret", 30, 0) + many("Kedoshaw, Margaret", 5, 100) + many("Kedoshaw, Peggy", 2, 200)
    assert linked(spark, rows) == [("name", "Kedoshaw, Margaret", "Kedoshaw, Peggy")]


def test_firms_and_hot_names(spark):
    rows = many("Ort : Keel Wharf Press, 1989", 200, 0, 4) + many("Keel Wharf Pr.", 3, 300, 4) + many("K. Wharf Press", 2, 400, 4) + many("Keel Court Press", 9, 500, 4)
    assert linked(spark, rows) == [("publisher", "K. Wharf Press", "Keel Wharf Press"), ("publisher", "Keel Wharf Pr.", "Keel Wharf Press")]


def test_chains_of_any_length_reach_their_end(spark):
    steps = [("s", f"k{i:02}", f"k{i + 1:02}") for i in range(40)] + [("s", "k40", "k40"), ("s", "lone", "lone")]
    got = {r["key"]: r["root"] for r in bearers._followed(spark.createDataFrame(steps, "sort string, key string, root string"), "chain").collect()}
    assert got == {f"k{i:02}": "k40" for i in range(41)} | {"lone": "lone"}


def test_short_spellings_without_a_full_name(spark):
    rows = many("É. J. Gaziloux", 3, 0) + many("Gaziloux, É.J.", 1, 10) + many("Gaziloux, P. J.", 1, 20)
    assert linked(spark, rows) == [("name", "Gaziloux, É.J.", "É. J. Gaziloux")]


def test_a_short_form_of_many(spark):
    rows = many("J. Smithson", 1, 0)
    for i in range(30):
        rows += many(f"Smithson, J{'abcdefghij'[i % 10]}{'klm'[i // 10]}tobiah", 5, 100 + 10 * i)
    assert not [x for x in linked(spark, rows) if "J. Smithson" in x]
    assert ("name", "J. Smithson", "Smithson, Jabel") in linked(spark, rows + many("Smithson, Jabel", 40, 9000))


def test_nothing(spark):
    assert linked(spark, [("a", 1, None, None, None), ("b", 2, [None, " "], [], [""])]) == []


def test_pet_forms_are_read_off_the_names(spark):
    # "Zubi" is in no list; it stands beside Zubarella under four surnames that share nothing else.
    rows, at = [], 0
    for surname in ("Aldock", "Brenley", "Cormast", "Dunvale"):
        rows += many(f"{surname}, Zubarella", 6, at) + many(f"{surname}, Zubi", 1, at + 50)
        at += 100
    rows += many("Zubi Eastmoor", 1, 5000) + many("Eastmoor, Zubarella, 1901-", 5, 5100)
    for k in range(60):
        rows += many(f"Surname{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}, Given{'qrstuv'[k % 6]}o", 3, 10_000 + 10 * k)
    got = linked(spark, rows)
    assert ("name", "Aldock, Zubarella", "Aldock, Zubi") in got and ("name", "Eastmoor, Zubarella, 1901-", "Zubi Eastmoor") in got
    assert len(got) == 5


def test_a_common_surname_proves_nothing(spark):
    rows = []
    for k, surname in enumerate(("Common", "Vulgar", "Plain")):
        for i, given in enumerate("Ada Bea Cora Dora Edda Fritha Gisla Hanna Inka".split()):
            rows += many(f"{surname}, {given}rix", 2 + i, 1000 * k + 20 * i)
    assert linked(spark, rows) == []


def other_givens_by_all_pairs(names):
    """The same other given names from all pairs under all surnames, with fractions."""
    under, holds = {}, {}
    for surname, given, n in names:
        under.setdefault(surname, {})[given] = n
        holds.setdefault(given, set()).add(surname)
    counts = {s: min(Fraction(1), Fraction(bearers.RARE, len(g))) for s, g in under.items()}
    size = {s: ((len(g) - 1) // bearers.RARE).bit_length() for s, g in under.items()}
    alike = Counter(size.values())
    share = {g: {k: Fraction(n, alike[k]) for k, n in Counter(size[s] for s in held).items()} for g, held in holds.items()}
    fitting = {}
    for g in holds:
        own = sum(counts[s] for s in holds[g])
        for o in holds:
            met = [s for s in holds[g] & holds[o] if under[s][o] >= under[s][g]]
            shown = sum(counts[s] for s in met)
            if g == o or shown < max(bearers.SHOWN, own / bearers.ONE_IN):
                continue
            tells = {s: counts[s] * (1 - share[o].get(size[s], 0)) for s in holds[g]}
            chance = sum(t * share[o].get(size[s], 0) for s, t in tells.items())
            least = max(bearers.SHOWN * (1 - Fraction(1, bearers.LIFT)), sum(tells.values()) / bearers.ONE_IN, bearers.LIFT * chance)
            if sum(tells[s] for s in met) >= least:
                fitting.setdefault(g, []).append((shown, o))
    ranked = {g: sorted(f, reverse=True) for g, f in fitting.items()}
    return {(g, f[0][1]) for g, f in ranked.items() if len(f) == 1 or f[0][0] > f[1][0]}


def other_givens(spark, names):
    df = spark.createDataFrame([("person", f"{s} {g}", n) for s, g, n in names], "sort string, key string, n bigint")
    return {tuple(r) for r in bearers.other_givens(df).collect()}


def test_pet_forms_under_common_surnames_are_read_off_the_names(spark):
    # No surname has fewer than 12 given names; the pet form stands under eight of 120.
    rng = random.Random(3)
    names = [(f"sur{s}", f"given{k}", 3) for s in range(120) for k in rng.sample(range(240), 12)]
    names += [(f"sur{s}", g, n) for s in range(8) for g, n in (("zubarella", 6), ("zubi", 1))]
    assert other_givens(spark, names) == {("zubi", "zubarella")} == other_givens_by_all_pairs(names)


@pytest.mark.parametrize("seed", [1, 2])
def test_other_givens_by_all_pairs(spark, seed, monkeypatch):
    # Surnames of 1 to about 50 given names; most pairs found need the surnames left out at first.
    monkeypatch.setattr(bearers, "RARE", 3)
    rng = random.Random(seed)
    names, often = {}, [(k + 5) ** -0.3 for k in range(300)]
    for s in range(400):
        for g in rng.choices(range(300), often, k=rng.choice([1, 2, 3, 3, 5, 9, 40])):
            names[f"sur{s}", f"given{g}"] = names.get((f"sur{s}", f"given{g}"), 0) + rng.randrange(2, 6)
            if g % 3 == 0 and rng.random() < 0.7:
                names[f"sur{s}", f"pet{g}"] = 1
    names = [(s, g, n) for (s, g), n in names.items()]
    got = other_givens(spark, names)
    assert got == other_givens_by_all_pairs(names) and len(got) >= 10
    assert all(g.replace("pet", "given") == o for g, o in got)


def test_a_surname_alone_in_its_size_speaks_against_nobody(spark):
    names = [(f"sur{s}", g, n) for s in range(4) for g, n in (("zubarella", 6), ("zubi", 1))]
    names += [("sur3", f"given{k}", 3) for k in range(9)] + [(f"other{k}", f"given{k}", 2) for k in range(60)]
    assert other_givens(spark, names) == {("zubi", "zubarella")} == other_givens_by_all_pairs(names)
