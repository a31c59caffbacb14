"""Truncated texts."""

from shelfmark.llm import truncation as X

S = "doc_id bigint, text string, source string, last_word string"
BASE = [
    "The harbour photographs were restored. The curator counted the photographs in 1950.",
    "A note by Sigrid Nibebø links the border with the photographs of the harbour.",
    "Die Aufnahmen zeigen die Arbeit im Hafen. Warum man sie zeigt, bleibt offen.",
    "写真帳は港を記録している。撮影者は分からない。",
]
#: What the beginnings of sentences and of list lines are known from.
BASE += [
    f"The curator counted {n} photographs in {1500 + n}. The photographs, although the captions are lost, show the harbour {n}. The harbour photographs of the firm were restored. "
    f"A note by Sigrid Nibebø links the border. Die Aufnahmen zeigen {n} Werften.\nThe curator counted the prints of {n}."
    for n in range(300)
]
BASE += [f"Notes .... {n}\nPlates .... {n + 9}\nThe harbour — {n + 12}" for n in range(20, 60)]


def flagged(spark, texts, source="s"):
    rows = [(i, t, source, "clash") for i, t in enumerate(BASE)] + [(10_000 + i, t, source, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, S)
    got = {r["doc_id"] for r in X.truncated(df).collect()}
    assert not got & set(range(len(BASE)))
    return [10_000 + i in got for i in range(len(texts))]


def test_cut_texts(spark):
    cut = [
        "The curator counted the photogr", "The curator counted the", "The photographs, although the", "The harbour photographs of the &am", "The photographs � ".replace(" �", "�"),
        "The curator counted the har\r\n", "A note by Sigrid Nib", "The harbour photographs were restored (nos.", "Die Aufnahmen zeigen die Ar", "「写真帳は港を記録し",
    ]
    assert flagged(spark, cut) == [True] * len(cut)


def test_complete_texts(spark):
    whole = [
        None, "", "  \n", "The curator counted the harbour.", "The photographs remain unclear!", "“Nobody counted the photographs.”", "The tide went out again...", "And rope…",
        "The photographs were restored.\n— Sigrid Nibebø", "The photographs were restored.\n\n-- \nSigrid Nibebø", "The photographs were restored.\nAlbumen print, 41 x 29 cm",
        "The photographs were restored.\nKeywords: harbour; photographs; border", "Q: Restored?\nA: The photographs were.\n[tape ends]", "港の写真帳。", "Notes .... 12\nPlates .... 15\nThe harbour — 20",
    ]
    assert flagged(spark, whole) == [False] * len(whole)


def test_list_lines_unlike_those_before(spark):
    assert flagged(spark, ["Notes .... 12\nPlates .... 15\nThe harbour", "Notes .... 12\nPlates .... 115\nThe harbour — 12"]) == [True, True]


def test_usual_last_lines_at_any_size(spark):
    usual = [f"The photographs of {y} were restored.\nSee plates 4–9" for y in (1950, 1960)]
    assert flagged(spark, usual) == [False] * 2
    lettered = [f"The photographs of {y} were restored by Boris.\nEnd of side B" for y in (1950, 1960)]
    assert flagged(spark, lettered) == [False] * 2
    begun = [f"The photographs of {y} were restored.\nThe curator counted" for y in range(1950, 1962)]
    more = [f"The photographs of {y} remain.\nThe curator counted the harbour photographs." for y in range(1950, 1963)]
    inside = [f"The photographs of {y} were restored.\nthe photogr" for y in range(1950, 1962)]
    assert flagged(spark, begun + more + inside) == [True] * 12 + [False] * 13 + [True] * 12


def test_dots_at_a_field_limit(spark):
    filler = "The harbour photographs were restored by the curator and the note links the border"
    texts = [(filler + " " + w * 40)[:97] + "..." for w in ("with ", "again ", "counted ", "sie ")]
    assert flagged(spark, texts, "labels") == [True] * 4


def test_one_character_dots_at_and_below_a_field_limit(spark):
    filler = "The harbour photographs were restored by the curator and the note links the border"
    piled = [(filler + " " + w * 40)[:97] + "..." for w in ("with ", "again ", "counted ", "sie ")]
    cut = ["The curator " + filler + "…", filler + " with the harbour…", filler + " and the photogr…"]
    said = ["Nobody counted. The tide, and the note…", "The border. The tide, and the note…", (filler + ". ")[2:] + "The tide, and the note…"]
    assert all(80 <= len(x) <= 100 for x in cut) and [len(x) >= 80 for x in said] == [False, False, True]
    assert flagged(spark, piled + cut + said, "labels") == [True] * 7 + [False] * 3
    assert flagged(spark, ["The curator counted the…", "The curator counted the photogr…"]) == [False, True]


def test_dots_at_a_limit_in_bytes(spark):
    words = ["harbour", "photographs", "counted", "sie"]
    texts = ["é" * k + " " + "a" * (60 - 2 * k - len(w)) + " the " + w + "..." for k, w in enumerate(words, 1)]
    assert {len(x.encode()) for x in texts} == {69} and len({len(x) for x in texts}) == 4
    assert flagged(spark, texts, "labels") == [True] * 4


def test_copies_long_texts_and_rates(spark):
    long = BASE[0] + (" " + BASE[1]) * 3000 + " The curator counted the photogr"
    assert flagged(spark, [long] * 30) == [True] * 30
    df = spark.createDataFrame([(1, "The harb", None), (2, "The harbour rests.", None), (3, None, "x")], "doc_id bigint, text string, source string")
    got = {r["source"]: (r["n_docs"], r["n_truncated"], r["share"]) for r in X.rates(df).collect()}
    assert got == {None: (2, 1, 0.5), "x": (1, 0, 0.0)}
    assert X.truncated(df.limit(0)).count() == 0


def test_every_row_has_its_evidence(spark):
    rows = [(i, t, "s") for i, t in enumerate(BASE)]
    piled = [(BASE[i][:100].rsplit(" ", 1)[0] + " prints" * 9)[:91] for i in range(60, 66)]
    piled = [p[: 91 - len(w)] + w for p, w in zip(piled, [" the prints", " the pri", " the har", " harbour", " of the note", " border"])]
    piled.append(("Quiet rooms were lent to those" + " prints" * 9)[:84] + " labels")
    rows.append((900, "Some labels were lost.", "s"))
    cut = {1000: "The curator counted the photogr", 1001: "The curator counted the prints while", 1002: "A note &#82"} | {1010 + i: p for i, p in enumerate(piled)}
    rows += [(k, t, "cards" if k >= 1010 else "s") for k, t in cut.items()] + [(2000, "Nobody knows", "s"), (2001, "Kept by Sigrid", "cards")]
    got = {r["doc_id"]: r["evidence"] for r in X.evidence(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("truncated").collect()}
    assert {len(p) for p in piled} == {91} and set(got) == set(cut)
    assert (got[1000], got[1001], got[1002]) == ("trie", "sentence", "broken") and set(got.values()) == {"trie", "sentence", "broken", "limit"}


def test_a_third_of_all_texts_is_one_cut_text(spark):
    assert flagged(spark, ["The curator counted the photographs, although"] * 180) == [True] * 180


def test_a_last_word_of_any_length(spark):
    word = "harbour" * 100
    assert flagged(spark, [f"Nobody wrote {word}s here.", f"Nobody wrote {word}"]) == [False, True]


def test_trie_by_brute_force(spark):
    import random

    rng = random.Random(5)
    known = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(300)} | {"ab" * 50_000})
    asked = sorted({w[: rng.randrange(1, len(w) + 1)] for w in known} | {w + "c" for w in known[:20]} | {"ab" * 40_000, "ba" * 40_000})
    words = spark.createDataFrame([(w, 1) for w in known], "word string, n bigint")
    got = {r["word"] for r in X.trie(words, spark.createDataFrame([(w,) for w in asked], "word string")).collect()}
    assert got == {a for a in asked if any(w != a and w.startswith(a) for w in known)}
