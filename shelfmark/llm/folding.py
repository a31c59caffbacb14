"""A JVM-side folding of text for comparisons that may ignore accents.

``folded`` reads through disguises without leaving the JVM: one ``translate``
with a table built by rule (ordinary width, base letters, Latin twins of
look-alike letters), then case folding.  It is coarser than the consistent
form (accents are lost), so it serves comparisons, never output.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.llm.consistent import LATIN_TWINS


def _base(c: str) -> str:
    kept = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
    return kept[0] if len(kept) == 1 else c


#: Letters that do not decompose; fixed values.
_STROKED = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D"}


def _table() -> dict[str, str]:
    ranges = [(0xC0, 0x17F), (0x386, 0x3CE), (0x400, 0x45F), (0x3041, 0x30FE), (0xFF01, 0xFF5E)]
    turned = {chr(x): _base(chr(x)) for a, b in ranges for x in range(a, b + 1)} | _STROKED
    turned |= {c: t for c, t in LATIN_TWINS.items()}
    return {c: t for c, t in turned.items() if c != t and unicodedata.category(c) != "Cn"}


_TABLE = _table()
#: Characters beyond the basic plane are left alone: translate works on code units.
_FROM, _TO = ("".join(x) for x in zip(*[(c, t) for c, t in _TABLE.items() if ord(c) < 0x10000 and len(t) == 1]))


OTHERS = r"[^\p{L}\p{N}]+"


def folded(text: Column) -> Column:
    """Lower-case base letters; other characters unchanged."""
    single = F.replace(F.replace(text, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.lower(F.translate(single, _FROM, _TO))


def bare(text: Column) -> Column:
    """Only the folded letters and digits of a text."""
    return F.regexp_replace(folded(text), OTHERS, "")
