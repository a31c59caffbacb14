"""Flat tables out of nested location JSON (problem 6).

Catalog records carry two JSON texts: ``best_location`` (one location) and
``holdings`` (many locations, some with items inside).  Their shape varies: a
plain list, a list of lists, an object that wraps the list (``{"holding":
[...]}``) or groups it by library (``{"MAIN": [...], "MAPS": [...]}``), a
single object in place of a list, or any of these once more encoded as a JSON
string.  Items come as a list, as ``{"item": [...]}`` or as one object.

Everything is a projection: nested ``transform`` calls attach the record keys
and the positions, ``flatten`` joins the arrays, and one ``inline`` per target
table emits its rows.  There is no shuffle and no Python, so the work scales
with the input files alone and a record with many holdings costs only itself.

Defined results: null, empty or blank text, JSON ``null`` and text that is no
valid JSON give no rows; null and blank elements are counted in the positions
but give no row of their own; what nests deeper than ``DEPTH`` lists or wrapping
objects stays one element and is reported by :func:`unopened`; extra columns of the input are ignored unless
named in ``keys``; repeated records give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of a location and of an item.
LOCATION_KEYS = [
    "organization",
    "libraryCode",
    "mainLocation",
    "subLocation",
    "subLocationCode",
    "callNumber",
    "callNumberType",
    "availabilityStatus",
    "holKey",
]
ITEM_KEYS = ["barcode", "status", "enumeration", "notes"]

_TEXTS = "array<string>"
_OBJECT = "map<string,string>"


def _none() -> Column:
    return F.array().cast(_TEXTS)


def _texts(text: Column) -> Column:
    """The elements of a JSON array as texts; an object stays JSON text."""
    return F.coalesce(F.from_json(text, _TEXTS), _none())


def _starts(text: Column, mark: str) -> Column:
    return F.ltrim(text).startswith(mark)


def _unquoted(text: Column) -> Column:
    """The text inside a JSON string literal; other texts unchanged."""
    return F.when(_starts(text, '"'), F.get(_texts(F.concat(F.lit("["), text, F.lit("]"))), F.lit(0))).otherwise(text)


def _closed(text: Column) -> Column:
    """The text if it ends as it begins, else null: a JSON reader stops after
    the first value and would let trailing rubbish or a lost end pass."""
    return F.when(text.rlike(r"(?s)^\s*(\{.*\}|\[.*\])\s*$") & F.try_parse_json(text).isNotNull(), text)


def _expanded(text: Column, own: list[str]) -> Column:
    """One step down: the members of a list or of a wrapping object, or the
    element itself when it is an object of the wanted kind."""

    def of_map(m: Column) -> Column:
        mine = F.exists(F.map_keys(m), lambda k: k.isin(*own))
        groups = F.exists(F.map_values(m), lambda v: _starts(v, "[") | _starts(v, "{"))
        inside = F.flatten(
            F.transform(
                F.filter(F.map_values(m), lambda v: v.isNotNull()),
                lambda v: F.when(_starts(v, "["), _texts(v)).otherwise(F.array(v)),
            )
        )
        return F.when(~mine & groups, inside)

    wrapped = F.get(F.transform(F.array(F.from_json(text, _OBJECT)), of_map), F.lit(0))
    return (
        F.when(_starts(text, "["), _texts(text))
        .when(_starts(text, "{"), F.coalesce(wrapped, F.array(text)))
        .otherwise(F.array(text))
    )


#: Lists and wrapping objects opened around an element; each costs a parse.
#: :func:`unopened` reports the records that nest deeper.
DEPTH = 3


def elements(text: Column, own: list[str], depth: int | None = None) -> Column:
    """All elements of a nested JSON text in stored order, as JSON texts."""
    root = F.when(_starts(text, "{") | _starts(text, "["), F.array(text)).otherwise(_none())
    for _ in range(DEPTH if depth is None else depth):
        root = F.flatten(F.transform(root, lambda e: F.coalesce(_expanded(e, own), F.array(e))))
    return F.coalesce(root, _none())


def _says_something(v: Column) -> Column:
    bare = F.regexp_replace(v, r'"(?:[^"\\]|\\.)*"\s*:', "")
    left = F.regexp_replace(bare, r'" *"|null|[\[\]{},\s]', "")
    return v.isNotNull() & (F.trim(v) != "") & F.when(v.rlike(r"^\s*[\[{]"), left != "").otherwise(True)


def not_blank(element: Column) -> Column:
    """Whether an element is an object holding at least one non-blank value."""
    values = F.map_values(F.from_json(element, _OBJECT))
    return F.coalesce(_starts(element, "{") & F.exists(values, _says_something), F.lit(False))


def holdings_tree(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per record: ``best`` (texts) and ``tree``, an array of
    (holding_pos, object, kept, items) with items of (item_pos, object, kept)."""

    def root(c: str) -> Column:
        return _closed(_unquoted(_unquoted(F.col(c))))

    def item(e: Column, i: Column) -> Column:
        return F.struct(i.alias("item_pos"), e.alias("object"), not_blank(e).alias("kept"))

    def holding(e: Column, i: Column) -> Column:
        inner = _unquoted(F.element_at(F.from_json(e, _OBJECT), "items"))
        items = F.when(_starts(e, "{"), F.transform(elements(inner, ITEM_KEYS), item))
        return F.struct(
            i.alias("holding_pos"),
            e.alias("object"),
            not_blank(e).alias("kept"),
            F.coalesce(items, F.array().cast("array<struct<item_pos:int,object:string,kept:boolean>>")).alias("items"),
        )

    return df.select(
        *keys,
        elements(root("best_location"), LOCATION_KEYS).alias("best"),
        F.transform(elements(root("holdings"), [*LOCATION_KEYS, "items"]), holding).alias("tree"),
    )


def unopened(df: DataFrame, keys: list[str], depth: int | None = None) -> DataFrame:
    """(keys, n_unopened): records with elements that ``depth`` levels leave
    closed, lists and objects that only wrap others, in ``best_location``,
    ``holdings`` or the items of a holding.  An empty result says that the tables
    are complete."""

    def left(text: Column, own: list[str]) -> Column:
        def closed(e: Column) -> Column:
            return _starts(e, "[") | F.coalesce(_starts(e, "{") & (_expanded(e, own) != F.array(e)), F.lit(False))

        return F.size(F.filter(elements(text, own, depth), closed))

    def inner(e: Column) -> Column:
        return left(_unquoted(F.element_at(F.from_json(F.when(_starts(e, "{"), e), _OBJECT), "items")), ITEM_KEYS)

    held = [*LOCATION_KEYS, "items"]
    best, all_held = (_closed(_unquoted(_unquoted(F.col(c)))) for c in ("best_location", "holdings"))
    in_items = F.aggregate(F.transform(elements(all_held, held, depth), inner), F.lit(0), lambda n, x: n + x)
    n = left(best, LOCATION_KEYS) + left(all_held, held) + in_items
    return df.select(*keys, n.alias("n_unopened")).where("n_unopened > 0")


def _fields(element: Column, names: list[str]) -> list[Column]:
    m = F.from_json(element, _OBJECT)
    return [F.element_at(m, n).alias(n) for n in names]


def node_positions(df: DataFrame, key: str = "ord") -> DataFrame:
    """(key, holding_pos, item_pos) of every non-blank child object."""

    def node(h: Column, i: Column) -> Column:
        return F.struct(h.cast("int").alias("holding_pos"), i.cast("int").alias("item_pos"))

    tree = holdings_tree(df, [key])
    minus = F.lit(-1)
    best = F.when(F.exists("best", not_blank), F.array(node(minus, minus))).otherwise(
        F.array().cast("array<struct<holding_pos:int,item_pos:int>>")
    )
    holdings = F.transform(F.filter("tree", lambda h: h["kept"]), lambda h: node(h["holding_pos"], minus))
    items = F.flatten(
        F.transform(
            "tree",
            lambda h: F.transform(
                F.filter(h["items"], lambda i: i["kept"]), lambda i: node(h["holding_pos"], i["item_pos"])
            ),
        )
    )
    return tree.select(key, F.inline(F.flatten(F.array(best, holdings, items))))


def best_locations(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per non-blank best location: ``keys`` and the nine fields."""
    tree = holdings_tree(df, keys)
    rows = F.transform(F.filter("best", not_blank), lambda e: F.struct(*_fields(e, LOCATION_KEYS)))
    return tree.select(*keys, F.inline(F.slice(rows, 1, 1)))


def holdings(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per non-blank holding: ``keys``, holding_pos, the nine fields
    and the number of its elements in ``items``."""
    tree = holdings_tree(df, keys)
    rows = F.transform(
        F.filter("tree", lambda h: h["kept"]),
        lambda h: F.struct(
            h["holding_pos"].alias("holding_pos"), *_fields(h["object"], LOCATION_KEYS), F.size(h["items"]).alias("n_items")
        ),
    )
    return tree.select(*keys, F.inline(rows))


def items(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per non-blank item: ``keys``, holding_pos (its parent),
    item_pos and the item's fields (notes as JSON text where it is a list)."""
    tree = holdings_tree(df, keys)
    rows = F.flatten(
        F.transform(
            "tree",
            lambda h: F.transform(
                F.filter(h["items"], lambda i: i["kept"]),
                lambda i: F.struct(
                    h["holding_pos"].alias("holding_pos"),
                    i["item_pos"].alias("item_pos"),
                    *_fields(i["object"], ITEM_KEYS),
                ),
            ),
        )
    )
    return tree.select(*keys, F.inline(rows))
