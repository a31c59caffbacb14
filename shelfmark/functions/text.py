"""Text helpers shared by all expressions.

Word boundaries are spelt out as character classes, so a pattern means the same
in Java, in RE2 and in Python whatever their idea of ``\\b``: a word character
is a letter, a number or an underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a Unicode-aware strip understands it.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BEFORE = r"(?:^|[^\p{L}\p{N}_])"
AFTER = r"(?:$|[^\p{L}\p{N}_])"
ASCII_AFTER = r"(?:$|[^A-Za-z0-9_])"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def joined(items: Column, mark: str) -> Column:
    """The non-null items with ``mark`` between them; null gives ''."""
    return F.coalesce(F.array_join(items, mark), F.lit(""))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def domain_pattern(kind: str, word: str) -> str:
    return BEFORE + word + (AFTER if kind == "word" else "")


def signal_pattern(pattern: str) -> str:
    return pattern.removesuffix("|b") + (ASCII_AFTER if pattern.endswith("|b") else "")


#: Patterns of the evidence and format flags, over lower-cased text.
PHOTOGRAPHS = f"{BEFORE}photograph(?:s|ic)?{AFTER}"
PLATES = f"{BEFORE}plates?{AFTER}"
# "ill." and "fig." count only with a word character right behind the dot.
ILLUSTRATIONS = f"{BEFORE}illustrations?{AFTER}|{BEFORE}ill\\.[\\p{{L}}\\p{{N}}_]|{BEFORE}fig(?:s|ure)?\\.[\\p{{L}}\\p{{N}}_]"
FRONTISPIECE = f"{BEFORE}frontispiece{AFTER}"
EXHIBITION_TITLE = f"{BEFORE}exhibition{AFTER}|{BEFORE}catalog{AFTER}"
EXHIBITION_SUBJECT = f"{BEFORE}exhibition catalog"
SURVEY = f"{BEFORE}survey{AFTER}|{BEFORE}report{AFTER}|{BEFORE}statistics"
MANUAL = f"{BEFORE}manual{AFTER}|{BEFORE}handbook{AFTER}|{BEFORE}guide{AFTER}|{BEFORE}technical"
COOKBOOK = f"{BEFORE}cookbook{AFTER}|{BEFORE}recipe"
EXCERPT_TRIGGER = f"{BEFORE}photo|{BEFORE}plate|{BEFORE}ill\\.|{BEFORE}fig\\."
