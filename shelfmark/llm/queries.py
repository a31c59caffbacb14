"""Registered queries of the llm subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bearers, consistent, encoding, linking, mixing, pairs, survivors, truncation
from shelfmark.tables import table


def _index_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "sekula_index").select("ord", "title", "authors", "subjects")
    return consistent.field_values(index, "ord", ["title"], ["authors", "subjects"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _index_values(spark, sf_dir)
    forms = consistent.consistent_form(values, ["ord", "field", "pos"], values)
    return forms.where(F.col("form") != F.col("value")).select("ord", "field", "pos")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent.skeleton_groups(_index_values(spark, sf_dir))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = linking.entries_of(table(spark, sf_dir, "ref_places"), "place_id", "name", ["alt_name"], "country")
    firms = linking.entries_of(table(spark, sf_dir, "ref_publishers"), "publisher_id", "name")
    index = table(spark, sf_dir, "sekula_index").select("id", "places")
    packets = table(spark, sf_dir, "photo_feature_packets").select("id", "publishers")
    return linking.found(index, "id", "places", places, linking.PLACES).unionByName(
        linking.found(packets, "id", "publishers", firms, linking.FIRMS)
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select("field", "id", "pos", "ref_id")


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without an entry of the list and how often each was typed."""
    none = _linked(spark, sf_dir).where("ref_id = -1")
    return none.groupBy("field", "value").agg(F.count("*").alias("n"))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "sekula_index").select("id", "ord", "subjects", "collection_tags")
    return pairs.baskets(pairs.records_of(index, "id", "ord", ["subjects", "collection_tags"]))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of one record, with its scores."""
    return pairs.pair_scores(_baskets(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of at least five records and one record in 500, three times as often as chance."""
    scores = pairs.pair_scores(_baskets(spark, sf_dir), 5, 500)
    return pairs.more_than_chance(scores, 3).select("field", "item_a", "item_b")


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "sekula_index"), priority={"ILS": 2, "LEGACY": 1})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "sekula_index"), values=False).select("frbr_group_id", "id", "description_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "sekula_index")
    counted = bearers.spellings(index, "id", "ord", ["authors", "contributors"], ["publishers"])
    return bearers.linked_spellings(counted)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encoded(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.round_trip(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many steps the rates took and whether they came to rest."""
    return mixing.fit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``p9_found`` with what speaks for each."""
    return truncation.evidence(table(spark, sf_dir, "documents")).where("truncated").select("doc_id", "source", "evidence")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p4_found": p4_found,
    "p4_survivors": p4_survivors,
    "p5_found": p5_found,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_fit": p8_fit,
    "p9_found": p9_found,
    "p9_evidence": p9_evidence,
    "p9_rates": p9_rates,
}


def _survivors_sql() -> str:
    """The SQL twin of ``p4_found``, written apart from the module: its own
    folding, its own list of stock values and seeds, and its own reading of
    placeholders off the table."""
    ligatures = "replace(replace({e}, 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    twins = "'АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυɑɡøł', 'ABEKMHOPCTYXSIJaeopcyxsijhdqwABEZHIKMNOPTYXovaipuagol'"

    def fold(e: str) -> str:
        single = ligatures.replace("{e}", e)
        return f"lower(translate(strip_accents(nfc_normalize(translate({single}, 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９．／，　', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789./, '))), {twins}))"

    things = "author|title|uniform title|date|year|publisher|place|place of publication|description|summary|subject|name|call number|isbn"
    lacking = (
        "unknown|not set|not named|not given|not identified|not known|not available|not recorded|not supplied|not stated|"
        "pending|to follow|to be assigned|to be added|to be supplied|to come"
    )
    words = "n/?a|none|none given|nil|unknown|anon|anonymous|untitled|undated|unclassified|n[.]? ?d|s[.]? ?a|s[.]? ?n|s[.]? ?l|n[.]? ?p|tbd|tbc|tba|x+|0+|in process|still to come|see printed inventory"
    stock = f"'^(?:{words}|(?:{lacking})|(?:{things})s? (?:{lacking})|no (?:{things})s?(?: (?:available|given|known|set|yet))?)$'"

    def says(e: str) -> str:
        core = f"regexp_replace(regexp_replace({fold(e)}, '[\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}\\x{{AD}}]', '', 'g'), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"
        return f"coalesce({core} <> '' AND NOT regexp_matches(regexp_replace({core}, '[\\s\\x{{A0}}\\p{{Zs}}]+', ' ', 'g'), {stock}), false)"

    def bare(e: str) -> str:
        return f"regexp_replace({fold(e)}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

    rules = {f: says(f) for f in ("title", "uniform_title", "call_number")}
    rules |= {f: f"coalesce(len(list_filter({f}, lambda x: {says('x')})) > 0, false)" for f in ("authors", "publishers", "places", "subjects", "isbns")}
    rules["year"] = "coalesce(regexp_matches(year, '[0-9]'), false)"
    again = "coalesce(t <> '' AND replace(b, t, '') = '', false)"
    seeds = "^(?:summary not yet supplied|placeholder entry|brief record (?:until|as part|and awaits|pending)|text removed during migration|this record was created automatically)\\b"
    score = " + ".join(f"({r})::INT" for r in rules.values())
    sentence = "list_transform(regexp_extract_all(regexp_replace(d, '[0-9]', '0', 'g'), '[^.!?。！？]+[.!?。！？]*'), lambda x: array_to_string(string_split(trim(x), ' ')[1:5], ' '))"
    return (
        f"WITH k AS (SELECT *, {bare('title')} AS t, {bare('description')} AS b, trim({fold('description')}) AS d, {says('description')} AS said FROM sekula_index), "
        f"r AS (SELECT *, said AND NOT {again} AND NOT regexp_matches(d, '{seeds}') AS open, {sentence} AS parts FROM k), "
        "texts AS (SELECT d, parts[1] AS head, count(DISTINCT coalesce(t, '')) AS titles FROM r WHERE open GROUP BY 1, 2), "
        "used AS (SELECT DISTINCT x AS head FROM (SELECT unnest(parts) AS x FROM r WHERE open AND d IN (SELECT d FROM texts WHERE titles = 1))), "
        "stock AS (SELECT d FROM texts WHERE titles >= 3 AND head NOT IN (SELECT head FROM used)), "
        f"q AS (SELECT frbr_group_id, id, harvested_at, ord, open AND d NOT IN (SELECT d FROM stock) AS told, {score} AS score FROM r WHERE trim(coalesce(frbr_group_id, '')) <> ''), "
        "best AS (SELECT *, row_number() OVER (PARTITION BY frbr_group_id ORDER BY score + coalesce(told, false)::INT DESC, harvested_at DESC, ord) AS rn FROM q), "
        "say AS (SELECT *, row_number() OVER (PARTITION BY frbr_group_id ORDER BY harvested_at DESC, ord) AS rn FROM q WHERE told) "
        "SELECT b.frbr_group_id, b.id, coalesce(s.id, '') AS description_id FROM best b LEFT JOIN say s ON s.frbr_group_id = b.frbr_group_id AND s.rn = 1 "
        "WHERE b.rn = 1 AND b.frbr_group_id IN (SELECT frbr_group_id FROM q GROUP BY 1 HAVING count(DISTINCT id) > 1)"
    )


SQL: dict[str, str] = {"p4_found": _survivors_sql()}
