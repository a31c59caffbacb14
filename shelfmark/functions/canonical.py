"""Canonical JSON: sorted keys, no white space, non-finite numbers as null.

Two ways.  A receipt has a fixed schema of strings, so its canonical text is a
JVM expression with the keys in order.  Any other JSON text goes through an
Arrow batch.  Keys are ordered by UTF-16 code units, as the standard says.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(x: float) -> str:
    if not math.isfinite(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits = repr(x)
    if "e" not in digits:
        return digits
    mantissa, power = digits.split("e")
    shift = int(power)
    if -6 <= shift < 0:
        whole, _, part = mantissa.lstrip("-").partition(".")
        return ("-" if x < 0 else "") + "0." + "0" * (-shift - 1) + whole + part
    return f"{mantissa}e{'+' if shift > 0 else '-'}{abs(shift)}"


def canonical(value) -> str:
    """The canonical text of a value made of plain Python objects."""
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return _number(value) if isinstance(value, float) else str(value)
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "null"


def canonical_json(text: Column) -> Column:
    """Canonical form of any JSON text; null for null and for no JSON."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_canonical_or_none(x) for x in batch], dtype=object)

    return run(text)


def _canonical_or_none(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return canonical(json.loads(text))
    except ValueError:
        return None


def quoted(text: Column) -> Column:
    """A string as JSON text."""
    inner = F.to_json(F.struct(text.alias("x")), {"ignoreNullFields": "false"})
    body = F.substring(inner, 6, F.length(inner) - 6)
    return F.when(text.isNull(), "null").otherwise(body)


def canonical_object(members: dict[str, Column]) -> Column:
    """The canonical text of an object whose members are JSON texts."""
    parts = [F.concat(F.lit(json.dumps(k) + ":"), members[k]) for k in sorted(members)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical_strings(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ","), F.lit("]"))


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hexadecimal."""
    return F.sha2(text, 256)
