"""Consistent form of look-alike text."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import consistent as C

CORPUS = ["The harbour space", "ships and essays", "Музей кораблей и людей", "a the of"]

CASES = [
    ("plain text", "plain text"),
    ("", ""),
    (" two  spaces ", " two  spaces "),
    ("Ｗａｇｅｓ　－－ Ｆｉｃｔｉｏｎ", "Wages -- Fiction"),
    ("Ｔｈｅ　ｎｉｇｈｔ　＆　ｄａｙ", "The night & day"),
    ("a​b﻿c\xadd⁠e‎f", "abcdef"),
    ("no\xa0break thin em fig ", "no break thin em fig "),
    ("non‑breaking ‐", "non-breaking -"),
    ("Canción", "Canción"),
    ("e​́", "é"),
    ("ﬁnal ﬂat", "final flat"),
    ("wоrk", "work"),
    ("Yɑrrօrsk", "Yarrorsk"),
    ("Τhe harbοur", "The harbour"),
    ("Тһе harbour", "The harbour"),
    ("Ѕрасе walls", "Space walls"),
    ("Музей кораблей = Ѕрасе", "Музей кораблей = Space"),
    ("Музей кораблей и людей, 1972", "Музей кораблей и людей, 1972"),
    ("Φωτογραφίες από λιμάνια", "Φωτογραφίες από λιμάνια"),
    ("Музeй", "Музей"),
    ("СССР in construction", "СССР in construction"),
    ("40 m² of sea, 1ª serie, № 7, 12½ views", "40 m² of sea, 1ª serie, № 7, 12½ views"),
    ("L’été – “quoted” … —", "L’été – “quoted” … —"),
    ("港の写真帳 1946", "港の写真帳 1946"),
    ("港の写真，帳", "港の写真，帳"),
    ("び", "び"),
    ("日　本", "日　本"),
    ("می‌خواهم", "می‌خواهم"),
]


@pytest.mark.parametrize("given_text, expected", CASES)
def test_forms(spark, given_text, expected):
    corpus = spark.createDataFrame([(c,) for c in CORPUS], "value string")
    rows = spark.createDataFrame([(given_text, "extra")], "value string, form string")
    got = {r["value"]: r["form"] for r in C.with_form(rows, corpus).collect()}
    assert got == {given_text: expected}


def test_nulls_long_texts_and_empty_tables(spark):
    long = "Ｗ" * 200_000
    rows = spark.createDataFrame([(None,), (long,), (long,)], "value string")
    got = C.with_form(rows).collect()
    assert len(got) == 1 and got[0]["form"] == "W" * 200_000
    assert C.with_form(rows.limit(0)).count() == 0
    assert C.skeleton_groups(rows.limit(0)).count() == 0


def test_groups_of_equal_skeleton(spark):
    rows = spark.createDataFrame([("work",), ("wоrk",), ("work",), ("ｗｏｒｋ",), ("other",), (None,)], "value string")
    (g,) = C.skeleton_groups(rows).collect()
    assert (g["n_originals"], g["n_rows"], g["main"]) == (3, 4, "work")


def test_field_values_positions(spark):
    df = spark.createDataFrame([(1, "t", ["a", None, "b"], None), (2, None, [], ["c"])], "ord bigint, title string, authors array<string>, subjects array<string>")
    got = sorted(tuple(r) for r in C.field_values(df, "ord", ["title"], ["authors", "subjects"]).collect())
    assert got == [(1, "authors", 0, "a"), (1, "authors", 2, "b"), (1, "title", 0, "t"), (2, "subjects", 0, "c")]


@given(st.text(alphabet="abéо​　Ｗﬁ\xa0é-１Ж港", max_size=12))
@settings(max_examples=200, deadline=None)
def test_form_is_stable(text):
    def form(x):
        return unicodedata.normalize("NFC", "".join(own if latin is None else latin for own, latin, _, _ in C.parts(x)))

    once = form(text)
    assert form(once) == once
    assert C.skeleton(once) == C.skeleton(text) or any(c in text for c in "Ж港")
