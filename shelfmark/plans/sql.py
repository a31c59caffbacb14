"""The same expressions as SQL text, built from the same patterns and lists.

Used only to compare results with another engine; see ``catalog_queries``.
"""

from __future__ import annotations

from shelfmark.functions import text as t
from shelfmark.functions.vocabulary import BUCKETS, DOMAINS, SIGNALS


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def has(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {lit(pattern)})"


def swap(e: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({e}, {lit(pattern)}, {lit(to)}, 'g')"


def pick(e: str, pattern: str, group: int, flags: str = "") -> str:
    return f"regexp_extract({e}, {lit(pattern)}, {group}" + (f", {lit(flags)})" if flags else ")")


def strip(e: str) -> str:
    return swap(e, f"^{t.SPACE}+|{t.SPACE}+$")


def text(c: str) -> str:
    return f"coalesce({c}, '')"


def joined(c: str, mark: str = " | ") -> str:
    return f"coalesce(array_to_string({c}, {lit(mark)}), '')"


EVIDENCE = f"lower(concat_ws(' ', {text('title')}, {text('description')}, {joined('notes')}, {joined('table_of_contents')}, {joined('formats')}))"
TAGS = f"lower(concat_ws(' ', {text('title')}, {joined('subjects')}, {joined('notes')}, {text('description')}))"
EXCERPT = f"concat_ws(' ', {text('description')}, {joined('notes')}, {joined('table_of_contents')})"


def evidence(e: str) -> dict[str, str]:
    return {
        "has_photographs": has(e, t.PHOTOGRAPHS),
        "has_plates": has(e, t.PLATES),
        "has_illustrations": has(e, t.ILLUSTRATIONS),
        "frontispiece_only": f"({has(e, t.FRONTISPIECE)} AND NOT {has(e, t.PLATES)})",
    }


def formats() -> dict[str, str]:
    title, subjects, kind = f"lower({text('title')})", f"lower({joined('subjects')})", f"lower({text('material_type')})"
    return {
        "exhibition_catalog": f"({has(title, t.EXHIBITION_TITLE)} OR {has(subjects, t.EXHIBITION_SUBJECT)})",
        "survey_report": has(title, t.SURVEY),
        "technical_manual": has(title, t.MANUAL),
        "fiction": f"(contains({kind}, 'fiction') OR contains({subjects}, 'fiction'))",
        "cookbook": has(title, t.COOKBOOK),
    }


def domain_tags(e: str) -> str:
    """The top three tags as a list."""
    scored = []
    for place, (tag, words) in enumerate(DOMAINS.items()):
        hits = " + ".join(f"{has(e, t.domain_pattern(*w))}::INT" for w in words)
        scored.append(f"{{'least': -({hits}), 'place': {place}, 'tag': '{tag}'}}")
    found = f"list_filter([{', '.join(scored)}], lambda s: s.least < 0)"
    return f"list_transform(list_sort({found})[1:3], lambda s: s.tag)"


def signals(e: str) -> str:
    hits = ", ".join(f"CASE WHEN {has(e, '|'.join(map(t.signal_pattern, s.patterns)))} THEN '{s.id}' END" for s in SIGNALS)
    return f"list_filter([{hits}], lambda s: s IS NOT NULL)"


def signal_text(*lists: str) -> str:
    every = " || ".join(f"coalesce({c}, []::VARCHAR[])" for c in lists)
    return f"lower(array_to_string(list_filter({every}, lambda x: x IS NOT NULL AND x <> ''), ' | '))"


_EDGE = r"(?:^|[^\p{L}\p{N}_])"
_TAIL = r"(?:$|[^\p{L}\p{N}_])"


def packet_year(c: str) -> str:
    return f"try_cast({pick(text(c), _EDGE + '(1[6-9][0-9]{2}|20[0-2][0-9])' + _TAIL, 1)} AS INT)"


def display_year(c: str, as_of: int) -> str:
    bare = swap(strip(c), rf"(?i)^(?:c\.?|ca\.?|circa|between){t.SPACE}*")
    found = f"regexp_extract_all({bare}, {lit(r'\b(1[0-9]{3}|20[0-9]{2})\b')}, 1)"
    return f"list_min(list_filter(list_transform({found}, lambda y: y::INT), lambda y: y <= {as_of + 50}))"


_CALL = rf"^([A-Za-z]{{1,3}}){t.SPACE}*([0-9]+(?:\.[0-9]+)?)?"


def lc_class(c: str = "call_number") -> str:
    return f"nullif(upper({pick(strip(text(c)), _CALL, 1)}), '')"


def lc_number(c: str = "call_number") -> str:
    return f"try_cast({pick(strip(text(c)), _CALL, 2)} AS DOUBLE)"


def lc_key(c: str = "call_number") -> str:
    whole = pick(pick(strip(text(c)), _CALL, 2), "^0*([0-9]+)", 1)
    padded = f"CASE WHEN length({whole}) >= 8 THEN {whole} ELSE lpad({whole}, 8, '0') END"
    return f"CASE WHEN {whole} = '' THEN {lc_class(c)} ELSE {lc_class(c)} || ({padded}) END"


def call_prefix(c: str = "call_number") -> str:
    return pick(text(c), "^([A-Z]{1,3})", 1)


def publisher_norm(c: str = "publishers") -> str:
    first = strip(f"coalesce({c}[1], '')")
    placed = f"CASE WHEN instr({first}, ' : ') > 0 THEN substring({first}, instr({first}, ' : ') + 3) ELSE {first} END"
    undated = swap(f"({placed})", rf",?{t.SPACE}*[0-9]{{4}}(?:-[0-9]{{4}})?")
    return (
        f"CASE WHEN coalesce(len({c}), 0) = 0 THEN '' WHEN contains(lower({undated}), 'moma') THEN 'Museum of Modern Art' "
        f"WHEN contains(lower({undated}), 'university press') THEN 'Univ. Press' ELSE {strip(undated)} END"
    )


def page_bin(c: str = "formats") -> str:
    count = rf"([0-9]+){t.SPACE}*(?:[pP]{_TAIL}|[pP][aA][gG][eE][sS]?)"
    found = f"list_filter(list_transform(coalesce({c}, []::VARCHAR[]), lambda f: {pick('f', count, 1)}), lambda x: x <> '')[1]"
    pages = f"CASE WHEN ({found}) IS NOT NULL THEN coalesce(try_cast(({found}) AS BIGINT), 1099511627776) END"
    return f"CASE WHEN ({pages}) IS NULL THEN 'unknown' WHEN ({pages}) < 150 THEN '<150' WHEN ({pages}) <= 300 THEN '150-300' ELSE '>300' END"


def trimmed_title() -> str:
    title = text("title")
    return f"CASE WHEN length({title}) > 150 THEN substring({title}, 1, 147) || '...' ELSE {title} END"


def notes_excerpt(e: str) -> str:
    return f"CASE WHEN {has(f'lower({e})', t.EXCERPT_TRIGGER)} THEN CASE WHEN length({e}) <= 240 THEN {e} ELSE substring({e}, 1, 240) || '...' END ELSE '' END"


def bucket(score: str) -> str:
    whens = " ".join(f"WHEN {score} >= {least} THEN '{name}'" for name, least in BUCKETS if least is not None)
    return f"CASE {whens} ELSE '{BUCKETS[-1][0]}' END"


def rule_score(e: str = "evidence_flags", f: str = "format_flags", tags: str = "domain_tags") -> str:
    g = f"coalesce({tags}, []::VARCHAR[])"
    return (
        f"CASE WHEN {e}.has_photographs AND list_contains({g}, 'photography') THEN 85 WHEN {e}.has_plates OR {e}.has_photographs THEN 70 "
        f"WHEN {f}.exhibition_catalog AND list_contains({g}, 'photography') THEN 65 "
        f"WHEN {e}.has_illustrations AND list_has_any({g}, ['photography', 'art', 'urban']) THEN 45 WHEN {f}.fiction THEN 15 ELSE 25 END"
    )


def struct(members: dict[str, str]) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in members.items()) + "}"


#: Feature packets of the index, one row per row, with ``ord``.
PACKETS = (
    f"SELECT ord, id, {trimmed_title()} AS title, {packet_year('year')} AS year, {publisher_norm()} AS publisher_norm, {call_prefix()} AS call_number_prefix, "
    f"{domain_tags('tg')} AS domain_tags, {page_bin()} AS page_count_bin, {struct(evidence('ev'))} AS evidence_flags, {struct(formats())} AS format_flags, "
    f"{notes_excerpt('ex')} AS notes_excerpt FROM (SELECT *, {EVIDENCE} AS ev, {TAGS} AS tg, {EXCERPT} AS ex FROM sekula_index)"
)


def last_per_id(table: str, order: str, columns: str = "*") -> str:
    return f"(SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order} DESC) AS rn FROM {table} WHERE id IS NOT NULL) WHERE rn = 1)"


def first_per_id(table: str, order: str, columns: str = "*") -> str:
    return f"(SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}) AS rn FROM {table} WHERE id IS NOT NULL) WHERE rn = 1)"


def dimension(values: list[str], name: str = "facet") -> str:
    rows = ", ".join(f"({lit(v)}, {i})" for i, v in enumerate(values))
    return f"(VALUES {rows}) AS dim({name}, place)"
