"""Lookups in the registries: labels, colours, palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.vocabulary import NO_CLASS, NO_COLOR, NO_SIGNAL, PALETTES, SIGNALS, ZONES


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def labels(signal: Column) -> Column:
    return F.element_at(_map({s.id: s.label for s in SIGNALS}), signal)


def known_palette(key: str | None) -> str:
    """The palette of that name, else the default one."""
    return key if key in PALETTES else "default"


def spine_color(mode: str = "signals", lc_class: Column | None = None, signal: Column | None = None, zone: Column | None = None, palette_key: str | None = None) -> Column:
    """The colour of a spine by class, theme or zone; without a value for the
    mode the neutral colour, for an unknown value the mode's own fallback."""
    colors = {
        "lc_class": (lc_class, PALETTES[known_palette(palette_key)], NO_CLASS, lambda c: F.upper(F.substring(c, 1, 1))),
        "signals": (signal, {s.id: s.color for s in SIGNALS}, NO_SIGNAL, lambda c: c),
        "zone": (zone, ZONES, NO_SIGNAL, lambda c: c),
    }
    if mode not in colors or colors[mode][0] is None:
        return F.lit(NO_COLOR)
    value, table, fallback, key = colors[mode]
    return F.when(F.coalesce(value, F.lit("")) == "", NO_COLOR).otherwise(F.coalesce(F.element_at(_map(table), key(value)), F.lit(fallback)))


def palette(spark: SparkSession) -> DataFrame:
    """(palette, lc_letter, color) of all palettes."""
    rows = [(p, k, v) for p, m in PALETTES.items() for k, v in m.items()]
    return spark.createDataFrame(rows, "palette string, lc_letter string, color string")
