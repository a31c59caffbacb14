"""One consistent form for text that only looks the same (problem 1).

Method: confusables skeleton.  A text is decomposed, every character is
replaced by its prototype (ordinary width, ordinary space and hyphen, single
letters, the Latin twin of a look-alike letter, nothing for the invisible) and
decomposed again; originals with equal skeletons form a group.

The consistent form of a text follows from the skeleton without harming text
that is honestly written in another script.  Words that mix scripts are put
into the script their unmistakable letters belong to.  A word made only of
look-alike letters of one foreign script (``Тһе``) is decided by its group:
words of the whole corpus are grouped by equal skeleton, and the word is taken
for Latin if its group holds Latin originals and no unmistakable word of its
own script stands around it.

Plain values (ASCII, composed letters, ideographs) never leave the JVM; only
values with a suspicious character go through an Arrow batch.  The word groups
are counted over all values with map-side combination, so what is shuffled is
the vocabulary, not the text.

Defined results: a null stays null, an empty text stays empty; leading,
trailing and repeated spaces are kept (only their characters change); raised
digits and letters, fractions, numero signs, typographic quotes and dashes stay;
marks that do not compose with their letter stay decomposed; full-width marks
and the ideographic space stay between ideographs and kana, joiners stay in
Arabic, Indic and emoji sequences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.tables import written

#: Look-alike letters and their Latin prototypes.
LATIN_TWINS = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u",
    "γ": "y", "σ": "o", "κ": "k", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    # Armenian
    "Տ": "S", "Օ": "O", "Լ": "L", "Ս": "U", "հ": "h", "օ": "o", "ո": "n", "ս": "u", "ց": "g", "զ": "q",
    "լ": "l", "յ": "j", "ա": "w",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L",
    "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M",
    "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # Coptic
    "Ⲟ": "O", "ⲟ": "o", "Ⲥ": "C", "ⲥ": "c", "Ⲣ": "P", "ⲣ": "p", "Ⲭ": "X", "Ⲕ": "K", "Ⲏ": "H", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T",
    # Latin letters of phonetic writing
    "ɑ": "a", "ɡ": "g",
}
_PHONETIC = {"ɑ": "a", "ɡ": "g"}
#: Hyphens that look like the ordinary one, invisible characters that are no format characters.
HYPHENS = "‐‑﹣－⁃­˗"
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ"

#: A value free of these characters is its own consistent form (a class of plain characters, negated).
SUSPICIOUS = (
    r"[^\x{20}-\x{7E}\t\n\r¡§ª«°²³¹º»¼½¾¿À-ÖØ-öø-ıĴ-ľŁ-ňŊ-žА-яЁё“”‘’„‚‹›–—…№"
    r"Ά-ΡΣ-ώ\x{3041}-\x{3096}\x{30A1}-\x{30FE}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"
)
#: Foreign letters that need a look at their word although each one is composed.
_FOREIGN = r"[А-яЁёΆ-ώ]"
_LATIN = r"[A-Za-zÀ-ž]"
_WORD = re.compile(r"(?:[^\W\d_][̀-ͯ҃-҇]*)+")


def is_suspicious(value: Column) -> Column:
    """Whether a value needs a closer look; null counts as plain."""
    lookalike = value.rlike("[" + "".join(c for c in LATIN_TWINS if ord(c) < 0x500 and ord(c) > 0x36F) + "]")
    beyond_ascii = F.octet_length(value) != F.length(value)  # spares most values the patterns
    return F.coalesce(beyond_ascii & (value.rlike(SUSPICIOUS) | (value.rlike(_FOREIGN) & lookalike)), F.lit(False))


def _script(c: str) -> str:
    if c in _PHONETIC:
        return "PHONETIC"
    return unicodedata.name(c, "OTHER").split(" ", 1)[0].removesuffix("-").split("-")[0]


def _is_wide(c: str) -> bool:
    return bool(c) and c.isalpha() and _script(c) in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "IDEOGRAPHIC")


def _joins(c: str) -> bool:
    """Characters beside which a joiner carries meaning."""
    return bool(c) and (
        0x0600 <= ord(c) <= 0x08FF or 0x0900 <= ord(c) <= 0x0DFF or ord(c) >= 0x1F000 or 0x2600 <= ord(c) <= 0x27BF or c == "️"
    )


def plain_characters(text: str) -> str:
    """Ordinary widths, spaces, hyphens and single letters; nothing invisible."""
    out: list[str] = []
    last = len(text) - 1
    for i, c in enumerate(text):
        if " " <= c <= "~":
            out.append(c)
            continue
        before, after = text[i - 1] if i else "", text[i + 1] if i < last else ""
        kind = unicodedata.category(c)
        if c in "‌‍️" and _joins(before) and (_joins(after) or c == "️"):
            out.append(c)
        elif c == "­" or c in INVISIBLE or kind == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F:
            continue
        elif c in HYPHENS and not (c == "－" and _is_wide(before) and _is_wide(after)):
            out.append("-")
        elif kind == "Zs":
            out.append(c if c == "　" and _is_wide(before) and _is_wide(after) else " ")
        elif kind == "Zl" or kind == "Zp":
            out.append(" ")
        elif 0xFF01 <= ord(c) <= 0xFF5E and not c.isalnum() and _is_wide(before) and (_is_wide(after) or not after):
            out.append(c)
        else:
            how = unicodedata.decomposition(c)
            tag = how.split(">", 1)[0] + ">" if how.startswith("<") else ""
            if tag in ("<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>"):
                out.append(unicodedata.normalize("NFKC", c))
            elif tag == "<compat>" and (kind in ("Ll", "Lu", "Lt") or 0x2160 <= ord(c) <= 0x217F):
                out.append(unicodedata.normalize("NFKC", c))
            else:
                out.append(c)
    return "".join(out)


def skeleton(text: str | None) -> str | None:
    """Decompose, replace every character by its prototype, decompose again."""
    if text is None:
        return None
    flat = unicodedata.normalize("NFD", plain_characters(unicodedata.normalize("NFD", text)))
    return unicodedata.normalize("NFD", "".join(LATIN_TWINS.get(c, c) for c in flat))


def _to_latin(word: str) -> str:
    return "".join(LATIN_TWINS.get(c, c) for c in word)


_BACK: dict[str, dict[str, str]] = {}
for _c, _l in LATIN_TWINS.items():
    _BACK.setdefault(_script(_c), {}).setdefault(_l, _c)


def parts(text: str) -> list[tuple[str, str | None, bool, bool]]:
    """The consistent form as parts (own, latin, anchored, lone); ``latin`` is
    set only where a word of look-alikes has still to be decided."""
    flat = unicodedata.normalize("NFD", plain_characters(unicodedata.normalize("NFD", text)))
    words = [m for m in _WORD.finditer(flat) if any(c.isalpha() for c in m.group())]
    out: list[tuple[str, str | None, bool, bool]] = []
    kinds: list[tuple[str, bool]] = []  # script and whether unmistakable, per word
    for m in words:
        letters = [c for c in m.group() if c.isalpha()]
        clear = [s for c in letters if (s := _script(c)) not in ("PHONETIC",) and (s == "LATIN" or c not in LATIN_TWINS)]
        foreign = [s for s in clear if s != "LATIN"]
        kinds.append((max(sorted(set(foreign)), key=foreign.count) if foreign else ("LATIN" if clear else _script(letters[0])), bool(clear)))
    at = 0
    for k, m in enumerate(words):
        out.append((flat[at : m.start()], None, False, False))
        at = m.end()
        word, (script, clear) = m.group(), kinds[k]
        if script in ("LATIN", "PHONETIC"):
            out.append((_to_latin(word), None, False, False))
        elif clear:
            latin = sum("a" <= c.lower() <= "z" for c in word)
            if not latin:
                out.append((word, None, False, False))
            elif script in _BACK:
                back = _BACK[script]
                turned = "".join(back.get(c, c) for c in word)
                own = sum(_script(c) == script for c in word)
                out.append((turned if own >= latin else _to_latin(word), None, False, False))
            else:
                out.append((word, None, False, False))
        else:
            between = {k - 1: flat[words[k - 1].end() : m.start()] if k else "", k + 1: flat[m.end() : words[k + 1].start()] if k + 1 < len(words) else ""}
            near = [kinds[j] for j, gap in between.items() if 0 <= j < len(kinds) and not gap.strip()]
            anchored = bool(near) and all(s == script and sure for s, sure in near)
            some = any(s == script and sure for s, sure in kinds)
            out.append((word, _to_latin(word), anchored, some))
    out.append((flat[at:], None, False, False))
    joined: list[tuple[str, str | None, bool, bool]] = []
    for p in out:  # texts that need no decision become one part
        if p[1] is None and joined and joined[-1][1] is None:
            joined[-1] = (joined[-1][0] + p[0], None, False, False)
        elif p[0] or p[1]:
            joined.append(p)
    return joined


_PARTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("own", T.StringType()),
            T.StructField("latin", T.StringType()),
            T.StructField("anchored", T.BooleanType()),
            T.StructField("some", T.BooleanType()),
        ]
    )
)


@F.pandas_udf(_PARTS)
def _parts_udf(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        seen: dict[str, list] = {}
        yield pd.Series([None if v is None else seen.get(v) or seen.setdefault(v, parts(v)) for v in batch])


@F.pandas_udf(T.StringType())
def _compose_udf(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        yield batch.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def _skeleton_udf(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        yield batch.map(skeleton)


def words_of(values: DataFrame, value: str = "value") -> DataFrame:
    """(word, n) over all values in lower case; counted before anything is
    shuffled."""
    found = F.explode(F.regexp_extract_all(F.lower(value), F.lit(r"([\p{L}\p{M}]+)")))
    return values.select(found.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def latin_words(values: DataFrame, value: str = "value") -> DataFrame:
    """Words grouped by equal skeleton: (skeleton, n_latin), the occurrences
    of Latin originals in each group."""
    words = words_of(values, value).where(F.col("word").rlike(r"^[A-Za-zÀ-ÖØ-öø-ž]+$"))
    plain = words.where(F.col("word").rlike(r"^[A-Za-z]+$")).withColumn("skeleton", F.col("word"))
    other = words.where(~F.col("word").rlike(r"^[A-Za-z]+$")).withColumn("skeleton", _skeleton_udf("word"))
    return plain.unionByName(other).groupBy("skeleton").agg(F.sum("n").alias("n_latin"))


def consistent_form(rows: DataFrame, keys: list[str], corpus: DataFrame, value: str = "value") -> DataFrame:
    """(keys, value, form) of every suspicious row of ``rows``.

    ``keys`` identify a row; ``corpus`` has the values whose words are grouped.
    Rows that are not suspicious have ``form`` equal to ``value`` and are not
    returned: see :func:`with_form` for all rows.
    """
    seen = rows.where(is_suspicious(F.col(value))).select(*keys, value, _parts_udf(value).alias("parts"))
    seen = written(seen, "suspicious")  # read twice below, far fewer rows than were looked at
    undecided = F.exists("parts", lambda p: p["latin"].isNotNull())
    sure = seen.where(~undecided).select(*keys, value, F.array_join(F.transform("parts", lambda p: p["own"]), "").alias("form"))
    open_parts = seen.where(undecided).select(*keys, value, F.posexplode("parts").alias("at", "part"))
    groups = latin_words(corpus, value).select(F.col("skeleton").alias("twin"), "n_latin")
    twin = F.lower(F.regexp_replace(F.col("part.latin"), r"\p{M}", ""))
    borrowed = (
        F.col("part.latin").isNotNull()
        & ~F.col("part.anchored")
        & (F.coalesce(F.col("n_latin"), F.lit(0)) > 0)
        & (~F.col("part.some") | (F.length("part.latin") > 1))
    )
    decided = (
        open_parts.withColumn("twin", twin)
        .join(groups, "twin", "left")
        .withColumn("text", F.when(borrowed, F.col("part.latin")).otherwise(F.col("part.own")))
        .groupBy(*keys, value)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "").alias("form"))
    )
    return sure.unionByName(decided).withColumn("form", _compose_udf("form"))


def with_form(values: DataFrame, corpus: DataFrame | None = None, value: str = "value") -> DataFrame:
    """``value`` and ``form`` for every distinct non-null value of ``values``."""
    distinct = values.select(value).where(F.col(value).isNotNull()).distinct()
    turned = consistent_form(distinct, [], corpus if corpus is not None else distinct, value)
    plain = distinct.where(~is_suspicious(F.col(value))).select(value, F.col(value).alias("form"))
    return plain.unionByName(turned)


def skeleton_groups(values: DataFrame, value: str = "value") -> DataFrame:
    """Originals grouped by equal skeleton.

    (skeleton, n_originals, n_rows, main): the number of distinct originals
    that look alike, the rows holding any of them and the most frequent one.
    Groups of one original are left out.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ascii_only = F.col(value).rlike(r"^[\x{20}-\x{7E}]*$")
    plain = counted.where(ascii_only).withColumn("skeleton", F.col(value))
    other = counted.where(~ascii_only).withColumn("skeleton", _skeleton_udf(value))
    best = F.max(F.struct(F.col("n"), F.col(value).alias("main")))["main"]
    return (
        plain.unionByName(other)
        .groupBy("skeleton")
        .agg(F.count("*").alias("n_originals"), F.sum("n").alias("n_rows"), best.alias("main"))
        .where("n_originals > 1")
    )


def field_values(df: DataFrame, key: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """(key, field, pos, value): one row per non-null value, positions from 0."""
    one = [F.array(F.struct(F.lit(c).alias("field"), F.lit(0).alias("pos"), F.col(c).alias("value"))) for c in scalars]

    def placed(c: str) -> Column:
        def row(v: Column, i: Column) -> Column:
            return F.struct(F.lit(c).alias("field"), i.cast("int").alias("pos"), v.alias("value"))

        return F.coalesce(F.transform(c, row), F.array().cast("array<struct<field:string,pos:int,value:string>>"))

    many = [placed(c) for c in lists]
    return df.select(key, F.inline(F.concat(*one, *many))).where(F.col("value").isNotNull())
