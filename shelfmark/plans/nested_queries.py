"""Registered queries over nested location JSON (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators import nested
from shelfmark.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.node_positions(table(spark, sf_dir, "sekula_index"), "ord")


def p6_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.best_locations(table(spark, sf_dir, "sekula_index"), ["ord", "id"])


def p6_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.holdings(table(spark, sf_dir, "sekula_index"), ["ord", "id"])


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.items(table(spark, sf_dir, "sekula_index"), ["ord", "id"])


def p6_unopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that nest deeper than the tables open."""
    return nested.unopened(table(spark, sf_dir, "sekula_index"), ["ord", "id"])


QUERIES = {
    "p6_found": p6_found,
    "p6_locations": p6_locations,
    "p6_holdings": p6_holdings,
    "p6_items": p6_items,
    "p6_unopened": p6_unopened,
}


def _tables_sql() -> dict[str, str]:
    """The SQL twins: the same walk with JSON functions."""

    def keys(own: list[str]) -> str:
        return "[" + ", ".join(f"'{k}'" for k in own) + "]"

    def root(c: str) -> str:
        once = f"CASE WHEN json_valid({c}) THEN CASE WHEN json_type({c}) = 'VARCHAR' THEN json_extract_string({c}, '$') ELSE {c} END END"
        return f"(SELECT CASE WHEN json_valid(o) THEN CASE WHEN json_type(o) = 'VARCHAR' THEN json_extract_string(o, '$') ELSE o END END FROM (SELECT {once} AS o))"

    def step(e: str, own: list[str], v: str) -> str:
        groups = f"list_filter(json_extract({e}, '$.*'), lambda {v}: json_type({v}) <> 'NULL')"
        nested = f"len(list_filter({groups}, lambda {v}: json_type({v}) IN ('ARRAY', 'OBJECT'))) > 0 AND NOT list_has_any(json_keys({e}), {keys(own)})"
        inside = f"flatten(list_transform({groups}, lambda {v}: CASE WHEN json_type({v}) = 'ARRAY' THEN json_extract({v}, '$[*]') ELSE [{v}] END))"
        return f"CASE WHEN json_type({e}) = 'ARRAY' THEN json_extract({e}, '$[*]') WHEN json_type({e}) = 'OBJECT' THEN CASE WHEN {nested} THEN {inside} ELSE [{e}] END ELSE [{e}] END"

    def elements(e: str, own: list[str]) -> str:
        out = f"CASE WHEN json_type({e}) IN ('ARRAY', 'OBJECT') THEN [{e}] ELSE [] END"
        for level in ("a", "b", "c"):
            out = f"flatten(list_transform({out}, lambda e{level}: {step('e' + level, own, 'v' + level)}))"
        return out

    def kept(e: str) -> str:
        bare = f"""regexp_replace({e}::VARCHAR, '"(?:[^"\\\\]|\\\\.)*"\\s*:', '', 'g')"""
        left = f"""regexp_replace({bare}, '" *"|null|[\\[\\]{{}},\\s]', '', 'g')"""
        return f"(json_type({e}) = 'OBJECT' AND {left} <> '')"

    held = [*nested.LOCATION_KEYS, "items"]
    walk = (
        f"WITH t AS (SELECT ord, id, {root('best_location')}::JSON AS b, {root('holdings')}::JSON AS h FROM sekula_index), "
        f"best AS (SELECT ord, id, {elements('b', nested.LOCATION_KEYS)} AS es FROM t), "
        f"hold AS (SELECT ord, id, {elements('h', held)} AS hs FROM t), "
        "flat AS (SELECT ord, id, hs, unnest(range(len(hs)))::INT AS holding_pos FROM hold), "
        "one AS (SELECT ord, id, holding_pos, hs[holding_pos + 1] AS o FROM flat), "
        f"item AS (SELECT ord, id, holding_pos, o, {elements('i', nested.ITEM_KEYS)} AS xs FROM (SELECT *, {root('q')}::JSON AS i FROM "
        "(SELECT *, CASE WHEN json_type(o) = 'OBJECT' THEN json_extract(o, '$.items')::VARCHAR END AS q FROM one))), "
        "each_item AS (SELECT ord, id, holding_pos, unnest(range(len(xs)))::INT AS item_pos, unnest(xs) AS x FROM item) "
    )

    def fields(e: str, names: list[str]) -> str:
        return ", ".join(f"json_extract_string({e}, '$.{n}') AS {n}" for n in names)

    first = f"list_filter(es, lambda e: {kept('e')})[1]"
    return {
        "p6_found": walk + f"SELECT ord, -1 AS holding_pos, -1 AS item_pos FROM best WHERE {first} IS NOT NULL UNION ALL SELECT ord, holding_pos, -1 FROM one WHERE {kept('o')} "
        f"UNION ALL SELECT ord, holding_pos, item_pos FROM each_item WHERE {kept('x')}",
        "p6_locations": walk + f"SELECT ord, id, {fields('e', nested.LOCATION_KEYS)} FROM (SELECT ord, id, {first} AS e FROM best) WHERE e IS NOT NULL",
        "p6_holdings": walk + f"SELECT ord, id, holding_pos, {fields('o', nested.LOCATION_KEYS)}, coalesce(len(xs), 0)::INT AS n_items FROM item WHERE {kept('o')}",
        "p6_items": walk + f"SELECT ord, id, holding_pos, item_pos, {fields('x', nested.ITEM_KEYS)} FROM each_item WHERE {kept('x')}",
    }


SQL: dict[str, str] = _tables_sql()
