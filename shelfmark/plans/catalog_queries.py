"""Registered queries of the catalogue operators, each over its whole table,
with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import canonical, features, fields, receipts, scoring
from shelfmark.functions.text import strip
from shelfmark.functions.vocabulary import BUCKETS, NO_CLASS, NO_SIGNAL, PALETTES, SHARDS, SIGNALS, Signal
from shelfmark.functions.registry_lookup import labels, palette, spine_color
from shelfmark.operators import facets, merge, quality, records, search, shelf
from shelfmark.plans import sql as q
from shelfmark.sources import sinks
from shelfmark.sources.files import flat_text, raw_lines
from shelfmark.sources.harvest import HarvestSource, write_pages
from shelfmark.streaming import incremental
from shelfmark.tables import scratch, table

AS_OF = 2026
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sekula_index")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "photo_scored")


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "photo_feature_packets")


def _last_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["id", "line_no", *merge.SCORES, "scoring_metadata"]
    return merge.last_per_key(_scored(spark, sf_dir).select(*wanted), "id", ["line_no"])


def _names(members: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in members.items())


# --- functions over single records -------------------------------------------------


@query(f"SELECT ord, {_names(q.evidence('ev'))} FROM (SELECT ord, {q.EVIDENCE} AS ev FROM sekula_index)")
def f01_evidence_flags(spark, sf_dir):
    rows = _index(spark, sf_dir).select("ord", features.evidence_text().alias("ev"))
    return rows.select("ord", features.evidence_flags(F.col("ev")).alias("f")).select("ord", "f.*")


@query(f"SELECT ord, {_names(q.formats())} FROM sekula_index")
def f02_format_flags(spark, sf_dir):
    return _index(spark, sf_dir).select("ord", features.format_flags().alias("f")).select("ord", "f.*")


@query(f"SELECT ord, array_to_string({q.domain_tags('tg')}, ',') AS tags FROM (SELECT ord, {q.TAGS} AS tg FROM sekula_index)")
def f03_domain_tags(spark, sf_dir):
    rows = _index(spark, sf_dir).select("ord", features.tag_text().alias("tg"))
    return rows.select("ord", F.array_join(features.domain_tags(F.col("tg")), ",").alias("tags"))


@query(f"SELECT ord, {q.page_bin()} AS page_count_bin FROM sekula_index")
def f04_page_bin(spark, sf_dir):
    return _index(spark, sf_dir).select("ord", fields.page_bin(F.col("formats")).alias("page_count_bin"))


@query(f"SELECT ord, {q.publisher_norm()} AS publisher_norm FROM sekula_index")
def f05_publisher_norm(spark, sf_dir):
    return _index(spark, sf_dir).select("ord", fields.publisher_norm(F.col("publishers")).alias("publisher_norm"))


@query(f"SELECT ord, {q.call_prefix()} AS prefix FROM sekula_index")
def f06_call_prefix(spark, sf_dir):
    return _index(spark, sf_dir).select("ord", fields.call_prefix(F.col("call_number")).alias("prefix"))


@query(f"SELECT ord, {q.notes_excerpt('ex')} AS excerpt FROM (SELECT ord, {q.EXCERPT} AS ex FROM sekula_index)")
def f07_notes_excerpt(spark, sf_dir):
    rows = _index(spark, sf_dir).select("ord", features.excerpt_text().alias("ex"))
    return rows.select("ord", features.notes_excerpt(F.col("ex")).alias("excerpt"))


@query(f"SELECT ord, {q.trimmed_title()} AS title FROM sekula_index")
def f08_title(spark, sf_dir):
    return _index(spark, sf_dir).select("ord", fields.trimmed_title(F.col("title")).alias("title"))


@query(f"SELECT ord, y AS year, (y // 10 * 10)::INT AS decade FROM (SELECT ord, {q.packet_year('year')} AS y FROM sekula_index)")
def f09_packet_year(spark, sf_dir):
    year = fields.packet_year(F.col("year"))
    return _index(spark, sf_dir).select("ord", year.alias("year"), fields.decade(year).alias("decade"))


@query(f"SELECT ord, {q.display_year('year', AS_OF)} AS year FROM sekula_index")
def f10_display_year(spark, sf_dir):
    return _index(spark, sf_dir).select("ord", fields.display_year(F.col("year"), AS_OF).alias("year"))


@query(f"SELECT ord, {q.lc_class()} AS lc_class, {q.lc_number()} AS lc_number, {q.lc_key()} AS lc_key FROM sekula_index")
def f11_call_number(spark, sf_dir):
    c = F.col("call_number")
    return _index(spark, sf_dir).select("ord", fields.lc_class(c).alias("lc_class"), fields.lc_number(c).alias("lc_number"), fields.lc_key(c).alias("lc_key"))


_FULL = fields.CALL_FULL


@query(
    f"SELECT ord, {q.lc_class()} AS lc_class, nullif({q.pick(q.strip(q.text('call_number')), _FULL, 3)}, '') AS cutter, "
    f"try_cast({q.pick(q.strip(q.text('call_number')), _FULL, 4)} AS INT) AS call_year FROM sekula_index"
)
def f12_call_number_full(spark, sf_dir):
    c = F.col("call_number")
    return _index(spark, sf_dir).select("ord", fields.lc_class(c).alias("lc_class"), fields.lc_cutter(c).alias("cutter"), fields.lc_year(c).alias("call_year"))


_SIGNALS = f"SELECT ord, id, call_number, {q.signals('st')} AS signals FROM (SELECT *, {q.signal_text('subjects', 'notes')} AS st FROM sekula_index)"


def _with_signals(index: DataFrame) -> DataFrame:
    return index.withColumn("_text", features.signal_text(["subjects", "notes"])).withColumn("signals", features.signals(F.col("_text"))).drop("_text")


@query(f"SELECT ord, array_to_string(signals, ',') AS signals FROM ({_SIGNALS})")
def f13_signals(spark, sf_dir):
    return _with_signals(_index(spark, sf_dir).select("ord", "subjects", "notes")).select("ord", F.array_join("signals", ",").alias("signals"))


_OWN_SIGNALS = [Signal("ice", "Ice and cold", "#0af", "", ("cold storage", "refrigerat")), Signal("post", "Post", "#fa0", "", ("postcard",))]


@query(
    "SELECT ord, array_to_string(list_filter([CASE WHEN contains(st, 'cold storage') OR contains(st, 'refrigerat') THEN 'ice' END, CASE WHEN contains(st, 'postcard') THEN 'post' END], lambda x: x IS NOT NULL), ',') AS signals "
    f"FROM (SELECT ord, {q.signal_text('subjects', 'notes')} AS st FROM sekula_index)"
)
def e02_own_signals(spark, sf_dir):
    """A registry of the reader's own in place of the built-in one."""
    rows = _index(spark, sf_dir).select("ord", features.signal_text(["subjects", "notes"]).alias("st"))
    return rows.select("ord", F.array_join(features.signals(F.col("st"), _OWN_SIGNALS), ",").alias("signals"))


_LABELS = " ".join(f"WHEN '{s.id}' THEN {q.lit(s.label)}" for s in SIGNALS)
_COLORS = " ".join(f"WHEN '{s.id}' THEN '{s.color}'" for s in SIGNALS)


@query(f"SELECT ord, array_to_string(list_transform(signals, lambda s: CASE s {_LABELS} END), '; ') AS labels FROM ({_SIGNALS})")
def f14_signal_labels(spark, sf_dir):
    rows = _with_signals(_index(spark, sf_dir).select("ord", "subjects", "notes"))
    return rows.select("ord", F.array_join(F.transform("signals", labels), "; ").alias("labels"))


_PALETTE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PALETTES["colorblind"].items())


@query(
    f"SELECT ord, CASE WHEN {q.lc_class()} IS NULL THEN '#ccc' ELSE CASE substring({q.lc_class()}, 1, 1) {_PALETTE} ELSE '{NO_CLASS}' END END AS by_class, "
    f"CASE WHEN len(signals) = 0 THEN '#ccc' ELSE CASE signals[1] {_COLORS} ELSE '{NO_SIGNAL}' END END AS by_signal FROM ({_SIGNALS})"
)
def f15_spine_color(spark, sf_dir):
    rows = _with_signals(_index(spark, sf_dir).select("ord", "subjects", "notes", "call_number"))
    by_class = spine_color("lc_class", lc_class=fields.lc_class(F.col("call_number")), palette_key="colorblind")
    return rows.select("ord", by_class.alias("by_class"), spine_color("signals", signal=F.get("signals", F.lit(0))).alias("by_signal"))


@query(" UNION ALL ".join(f"SELECT '{p}' AS palette, '{k}' AS lc_letter, '{v}' AS color" for p, m in PALETTES.items() for k, v in m.items()))
def f16_palettes(spark, sf_dir):
    return palette(spark)


def _match_sql(word: str) -> str:
    texts = {"title": q.text("title"), "authors": q.joined("authors", " "), "subjects": q.joined("subjects", " "), "sekula_notes": q.joined("sekula_notes", " ")}
    hits = ", ".join(f"CASE WHEN contains(lower({e}), '{word}') THEN '{n}' END" for n, e in texts.items())
    return f"list_filter([{hits}], lambda s: s IS NOT NULL)"


@query(f"SELECT ord, len(seg) > 0 AS matches, len(seg)::INT AS match_count, array_to_string(seg, ',') AS segments FROM (SELECT ord, {_match_sql('harbo')} AS seg FROM sekula_index)")
def f17_search(spark, sf_dir):
    rows = _index(spark, sf_dir).select("ord", *search.FIELDS)
    return search.matched(rows, "  Harbo ").select("ord", "matches", "match_count", F.array_join("segments", ",").alias("segments"))


_NEAR = "len(list_filter(string_split_regex(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+'), lambda w: levenshtein(w, 'porfraits') <= 1)) > 0"


@query(f"SELECT ord FROM sekula_index WHERE {_NEAR} AND contains(lower({q.joined('subjects', ' ')}), 'steel industry')")
def f19_advanced_search(spark, sf_dir):
    rows = _index(spark, sf_dir).select("ord", *search.FIELDS)
    return search.advanced(rows, 'title:porfraits~1 AND subjects:"steel industry"').select("ord")


@query(f"SELECT line_no, {q.bucket('photo_insert_score')} AS bucket FROM photo_scored")
def f20_bucket(spark, sf_dir):
    return _scored(spark, sf_dir).select("line_no", scoring.bucket(F.col("photo_insert_score")).alias("bucket"))


@query(f"SELECT id, {q.rule_score()} AS score FROM photo_feature_packets")
def f21_rule_score(spark, sf_dir):
    return _packets(spark, sf_dir).select("id", scoring.rule_score().alias("score"))


def outside_scorer(rows: list[dict]) -> list[dict]:
    """Stands for a service: the page bin decides."""
    points = {">300": 140, "150-300": 60, "<150": 30}
    return [{"likelihood": points.get(r["page_count_bin"], -5), "reasoning": "by size"} for r in rows]


@query("SELECT id, CASE page_count_bin WHEN '>300' THEN 100 WHEN '150-300' THEN 60 WHEN '<150' THEN 30 ELSE 0 END AS photo_insert_score, 'by size' AS photo_insert_reasoning FROM photo_feature_packets")
def f22_outside_scorer(spark, sf_dir):
    return scoring.scored_outside(_packets(spark, sf_dir).select("id", "page_count_bin"), outside_scorer)


@query(
    f"SELECT id, {q.rule_score()} AS photo_insert_score, {q.bucket('(' + q.rule_score() + ')')} AS photo_insert_bucket, 'rules' AS provider, 'rules-1' AS model, "
    "'v1.0' AS prompt_version, 'run-1' AS run_id, 1.5::DOUBLE AS ts FROM photo_feature_packets"
)
def f23_scored(spark, sf_dir):
    rows = scoring.scored(_packets(spark, sf_dir), "run-1", 1.5)
    meta = F.col("scoring_metadata")
    return rows.select("id", "photo_insert_score", "photo_insert_bucket", *[meta[k].alias(k) for k in ("provider", "model", "prompt_version", "run_id")], meta["timestamp"].alias("ts"))


_CANON = "'{\"id\":' || to_json(id) || ',\"title\":' || coalesce(to_json(title), 'null') || '}'"


@query(f"SELECT ord, sha256({_CANON}) AS digest FROM sekula_index")
def f25_canonical_digest(spark, sf_dir):
    text = canonical.canonical_object({"title": canonical.quoted(F.col("title")), "id": canonical.quoted(F.col("id"))})
    return _index(spark, sf_dir).select("ord", canonical.digest(text).alias("digest"))


@query()
def f24_canonical_json(spark, sf_dir):
    return _index(spark, sf_dir).select("ord", canonical.canonical_json(F.col("best_location")).alias("canonical"))


@query()
def f26_dataset_digest(spark, sf_dir):
    from shelfmark.sources.files import file_digests

    return file_digests(spark, f"{sf_dir}/sekula_index.parquet").select("length", "sha256")


BLOCK = 500


def _stretches(rows: DataFrame) -> DataFrame:
    """Selections that cover every id of ``rows`` once per shard: one per shard
    and stretch of BLOCK places in harvest order, so none holds more than BLOCK ids
    and no task more than a few of them, whatever a shard holds."""
    kept = rows.where(F.col("id").isNotNull()).select(F.coalesce("shard", F.lit("")).alias("shard"), "id", "ord")
    first = kept.groupBy("shard", "id").agg(F.min("ord").alias("ord"))
    listed = first.groupBy("shard", F.floor(F.col("ord") / BLOCK).alias("part")).agg(F.sort_array(F.collect_set("id")).alias("items"))
    filters = canonical.canonical_object({"part": F.col("part").cast("string"), "shard": canonical.quoted(F.col("shard"))})
    return listed.select(F.concat_ws("/", "shard", F.col("part").cast("string")).alias("selection_id"), F.lit("shelf").alias("mode"), "items", filters.alias("filters"))


def _selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader selects by the class TR."""
    return _stretches(_index(spark, sf_dir).where(F.col("call_number").startswith("TR")))


def _table_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stretches(_index(spark, sf_dir))


def _items_sql(where: str) -> str:
    return (
        f"SELECT shard, part, shard || '/' || part AS selection_id, list(id ORDER BY id) AS items FROM (SELECT coalesce(shard, '') AS shard, id, min(ord) // {BLOCK} AS part "
        f"FROM sekula_index WHERE id IS NOT NULL AND {where} GROUP BY 1, 2) GROUP BY 1, 2"
    )


_ITEMS_SQL, _TABLE_ITEMS_SQL = _items_sql("starts_with(call_number, 'TR')"), _items_sql("true")
_PAYLOAD_SQL = (
    "'{\"app\":{\"channel\":\"main\",\"name\":\"catalog-browser\",\"version\":\"v1\"},\"createdAt\":\"2026-01-01T00:00:00.000Z\",\"dataset\":{\"indexHash\":\"not-computed\","
    "\"name\":\"catalog\"},\"filters\":{\"part\":' || part || ',\"shard\":' || to_json(shard) || '},\"items\":[' || array_to_string(list_transform(items, lambda x: to_json(x)), ',') || "
    "'],\"mode\":\"shelf\",\"schema\":\"receipt@1\"}'"
)


def _receipts(spark: SparkSession, sf_dir: str, selections=_selections) -> DataFrame:
    return receipts.created(selections(spark, sf_dir), "2026-01-01T00:00:00.000Z")


@query(f"SELECT selection_id, {_PAYLOAD_SQL} AS payload, sha256({_PAYLOAD_SQL}) AS hash_value, len(items)::INT AS n_items FROM ({_ITEMS_SQL})")
def f28_receipts(spark, sf_dir):
    return _receipts(spark, sf_dir).select("selection_id", "payload", "hash_value", F.size("items").alias("n_items"))


@query(f"SELECT selection_id, {_PAYLOAD_SQL} AS payload, sha256({_PAYLOAD_SQL}) AS hash_value, len(items)::INT AS n_items FROM ({_TABLE_ITEMS_SQL})")
def f28_table_receipts(spark, sf_dir):
    return _receipts(spark, sf_dir, _table_selections).select("selection_id", "payload", "hash_value", F.size("items").alias("n_items"))


@query(
    "SELECT selection_id, v AS variant, v = 'kept' AS valid, CASE v WHEN 'kept' THEN 'Hash verified' WHEN 'changed' THEN 'Hash mismatch' ELSE 'Missing hash' END AS reason "
    f"FROM ({_ITEMS_SQL}), (VALUES ('kept'), ('changed'), ('bare')) AS t(v)"
)
def f29_verified(spark, sf_dir):
    return _verified(_receipts(spark, sf_dir))


@query(
    "SELECT selection_id, v AS variant, v = 'kept' AS valid, CASE v WHEN 'kept' THEN 'Hash verified' WHEN 'changed' THEN 'Hash mismatch' ELSE 'Missing hash' END AS reason "
    f"FROM ({_TABLE_ITEMS_SQL}), (VALUES ('kept'), ('changed'), ('bare')) AS t(v)"
)
def f29_table_verified(spark, sf_dir):
    return _verified(_receipts(spark, sf_dir, _table_selections))


def _verified(rows: DataFrame) -> DataFrame:
    kept = rows.select("selection_id", F.lit("kept").alias("variant"), "receipt")
    changed = rows.select("selection_id", F.lit("changed").alias("variant"), F.replace("receipt", F.lit('"mode":"shelf"'), F.lit('"mode":"view"')).alias("receipt"))
    bare = rows.select("selection_id", F.lit("bare").alias("variant"), F.col("payload").alias("receipt"))
    return receipts.verified(kept.unionByName(changed).unionByName(bare)).select("selection_id", "variant", "valid", "reason")


def _exports_sql(items: str) -> str:
    """File name, fragment and card of each receipt, put together once more."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'"
    groups = ["".join(f" || substring({letters}, ('0x' || substring(h, {2 * k + 1}, 2))::INT % 36 + 1, 1)" for k in range(4 * g, 4 * g + 4)) for g in range(3)]
    rid = "'RC'" + "".join(" || '-'" + g for g in groups)
    whole = "substring(payload, 1, length(payload) - 1) || ',\"hash\":{\"alg\":\"sha256\",\"value\":\"' || h || '\"},\"receiptId\":\"' || rid || '\"}'"
    fragment = "rtrim(replace(replace(to_base64(encode(whole)), '+', '-'), '/', '_'), '=')"
    card = (
        "'Digital receipt' || chr(10) || 'Receipt ID: ' || rid || chr(10) || 'Mode: shelf' || chr(10) || 'Created: 2026-01-01' || chr(10) || 'Items: ' || n || chr(10) || 'Dataset: catalog' || chr(10) || "
        "'Hash: ' || substring(h, 1, 16) || '...' || chr(10) || chr(10) || 'Verify at: https://catalog.example/#r=' || fragment"
    )
    return (
        f"SELECT selection_id, 'receipt-shelf-' || rid || '.json' AS file_name, fragment, whole AS unfolded, {card} AS card FROM (SELECT *, {fragment} AS fragment FROM (SELECT *, {whole} AS whole FROM "
        f"(SELECT *, {rid} AS rid FROM (SELECT *, sha256(payload) AS h FROM (SELECT selection_id, len(items) AS n, {_PAYLOAD_SQL} AS payload FROM ({items}))))))"
    )


@query(_exports_sql(_ITEMS_SQL))
def k06_receipt_exports(spark, sf_dir):
    return _exports(_receipts(spark, sf_dir))


@query(_exports_sql(_TABLE_ITEMS_SQL))
def k06_table_exports(spark, sf_dir):
    return _exports(_receipts(spark, sf_dir, _table_selections))


def _exports(rows: DataFrame) -> DataFrame:
    """The texts of a receipt's exports, and its fragment read back."""
    rows = rows.withColumn("fragment", receipts.to_fragment(F.col("receipt")))
    text = receipts.card(F.col("receipt_id"), F.col("mode"), F.lit("2026-01-01"), F.col("items"), F.lit("catalog"), F.col("hash_value"), F.col("fragment"))
    return rows.select(
        "selection_id", receipts.file_name(F.col("mode"), F.col("receipt_id")).alias("file_name"), "fragment",
        receipts.from_fragment(F.concat(F.lit("#r="), F.col("fragment"))).alias("unfolded"), text.alias("card"),
    )


_CLEAN = f"regexp_replace({q.swap(q.strip('s'), q.t.SPACE + '+', ' ')}, '[ .,;:/]+$', '')"


@query(
    f"SELECT ord, array_to_string(list_distinct_kept, '; ') AS subjects FROM (SELECT ord, list_filter(c, lambda x, i: list_position(c, x) = i) AS list_distinct_kept FROM "
    f"(SELECT ord, list_filter(list_transform(subjects, lambda s: {q.strip(_CLEAN)}), lambda x: x IS NOT NULL AND x <> '') AS c FROM sekula_index))"
)
def f30_subjects(spark, sf_dir):
    return _index(spark, sf_dir).select("ord", F.array_join(fields.clean_subjects(F.col("subjects")), "; ").alias("subjects"))


@query()
def f31_packet_size(spark, sf_dir):
    index = _index(spark, sf_dir).withColumn("_bytes", F.octet_length(F.to_json(F.struct("*"))))
    built = features.packets(index).withColumn("n", F.octet_length(F.to_json(F.struct("*"))))
    a = index.agg(F.sum("_bytes").alias("record_bytes"))
    b = built.agg(F.sum("n").alias("packet_bytes"))
    return a.crossJoin(b).select("record_bytes", "packet_bytes", F.round(F.col("record_bytes") / F.col("packet_bytes"), 2).alias("ratio"))  # one row each


@query("SELECT line_no, CASE photo_insert_bucket WHEN 'Strongly Likely' THEN 'orange 0.4' WHEN 'Likely' THEN 'yellow 0.3' WHEN 'Plausible' THEN 'lightblue 0.2' END AS tint FROM photo_scored")
def f33_tint(spark, sf_dir):
    return _scored(spark, sf_dir).select("line_no", scoring.tint(F.col("photo_insert_bucket")).alias("tint"))


@query(f"SELECT ord, id, title, year, (year // 10 * 10)::INT AS decade, publisher_norm, call_number_prefix, array_to_string(domain_tags, ',') AS tags, page_count_bin, evidence_flags.has_plates AS plates, format_flags.fiction AS fiction, notes_excerpt FROM ({q.PACKETS})")
def r13_packets(spark, sf_dir):
    index = _index(spark, sf_dir)
    both = features.packets(index.withColumn("id", F.struct("ord", "id")))
    return both.select(
        "id.ord", "id.id", "title", "year", "decade", "publisher_norm", "call_number_prefix", F.array_join("domain_tags", ",").alias("tags"), "page_count_bin",
        F.col("evidence_flags.has_plates").alias("plates"), F.col("format_flags.fiction").alias("fiction"), "notes_excerpt",
    )


def _cleaned_sql(c: str) -> str:
    item = f"CASE WHEN contains({q.strip('x')}, '$$') THEN {q.strip(q.pick(q.strip('x'), '(?s)^(.*?)[$][$]', 1))} ELSE {q.strip('x')} END"
    return f"list_transform(list_filter(coalesce({c}, []::VARCHAR[]), lambda x: x IS NOT NULL AND {q.strip('x')} <> ''), lambda x: {item})"


def _tailed_sql(c: str) -> str:
    """Items that were given a subfield tail: an item blank before is empty after."""
    return f"list_transform(list_filter(coalesce({c}, []::VARCHAR[]), lambda x: x IS NOT NULL), lambda x: {q.strip('x')})"


def _one_sql(c: str) -> str:
    return f"coalesce({_cleaned_sql(f'[{c}]')}[1], '')"


_COLLECTION = "Quayside Research Library"
_LOCATIONS = ["organization", "libraryCode", "mainLocation", "subLocation", "subLocationCode", "callNumber", "callNumberType", "availabilityStatus", "holKey"]
_BEST = "CASE WHEN starts_with(best_location, '{') AND json_valid(best_location) THEN best_location END"


def _location_sql(e: str) -> str:
    return "concat_ws('~', " + ", ".join(f"coalesce(json_extract_string({e}, '$.{k}'), '')" for k in _LOCATIONS) + ")"


def _records_sql() -> str:
    lists = {k: k for k in ("languages", "formats", "publishers", "places", "table_of_contents", "notes", "sekula_notes", "collection_tags", "call_number_notes", "isbns", "identifiers", "series", "provenance_notes", "issns", "oclc_numbers", "lccn", "alternative_titles")}
    fields = {
        "id": "trim(id)", "alma_mms": _one_sql("alma_mms"), "source_record_id": _one_sql("source_record_id"), "original_source_id": _one_sql("original_source_id"),
        "source_system": _one_sql("source_system"), "frbr_group_id": _one_sql("frbr_group_id"), "title": _one_sql("title"), "uniform_title": _one_sql("uniform_title"),
        "authors": f"array_to_string(CASE WHEN len({_cleaned_sql('authors')}) > 0 THEN {_cleaned_sql('authors')} ELSE {_cleaned_sql('contributors')} END, '|')",
        "contributors": f"array_to_string({_tailed_sql('contributors')}, '|')", "subjects": f"array_to_string({_tailed_sql('subjects')}, '|')",
        "year": _one_sql("year"), "material_type": _one_sql("material_type"), "description": _one_sql("description"), "collection": q.lit(_COLLECTION),
        "call_number": f"coalesce(nullif(json_extract_string({_BEST}, '$.callNumber'), ''), {_cleaned_sql('call_number_notes')}[1], '')",
        "availability": f"json_extract_string({_BEST}, '$.availabilityStatus')", "best_location": _location_sql(_BEST),  # a missing location is an empty one
        "holdings": "array_to_string(list_transform(list_filter(coalesce(CASE WHEN starts_with(holdings, '[') AND json_valid(holdings) THEN json_extract(holdings, '$[*]') END, []::JSON[]), "
        f"lambda e: json_type(e) = 'OBJECT'), lambda e: {_location_sql('e')}), '|')",
        "record_url": "'https://catalog.example/full?docid=' || trim(id) || '&lang=en'", "source": "'catalog'",
    }
    fields |= {k: f"array_to_string({_cleaned_sql(c)}, '|')" for k, c in lists.items()}
    return (
        f"SELECT {_names({f'{k}': v for k, v in fields.items()})} FROM sekula_index WHERE len(list_filter(coalesce(collection_tags, []::VARCHAR[]), lambda t: contains(lower(t), lower('{_COLLECTION}')))) > 0 "
        f"AND {q.strip(q.text('id'))} <> ''"
    )


@query(_records_sql())
def r07_records(spark, sf_dir):
    """Every record of the collection with all its 38 fields, lists as text."""
    rows = records.records(records.as_documents(_index(spark, sf_dir)), _COLLECTION, url_params={"lang": "en"})

    def located(x):
        return F.concat_ws("~", *[F.coalesce(x[k], F.lit("")) for k in _LOCATIONS])

    lists = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "array<string>"]
    out = rows.withColumns({c: F.array_join(c, "|") for c in lists})
    return out.withColumns({"best_location": located(F.col("best_location")), "holdings": F.array_join(F.transform("holdings", located), "|")})


# --- filters -------------------------------------------------------------------------


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir).select("ord", "id", "call_number", "year", *search.FIELDS, "notes")
    shelved = shelf.parsed(_with_signals(index)).withColumn("year_number", fields.display_year(F.col("year"), AS_OF)).drop(*merge.SCORES)
    return merge.merged(shelved, _last_scores(spark, sf_dir))


_ITEMS_Q = (
    f"SELECT i.*, s.photo_insert_score, s.photo_insert_bucket FROM (SELECT *, {q.signals('st')} AS signals, {q.lc_class()} AS lc_class, {q.lc_number()} AS lc_number, {q.lc_key()} AS lc_key, "
    f"{q.display_year('year', AS_OF)} AS year_number FROM (SELECT *, {q.signal_text('subjects', 'notes')} AS st FROM sekula_index)) i LEFT JOIN {q.last_per_id('photo_scored', 'line_no')} s ON i.id = s.id"
)


@query(f"SELECT ord FROM ({_ITEMS_Q}) WHERE list_contains(signals, 'labor')")
def r14_signal_filter(spark, sf_dir):
    return search.faceted(_items(spark, sf_dir), signal="labor").select("ord")


@query(f"SELECT ord FROM ({_ITEMS_Q}) WHERE lc_class = 'TR' AND lc_number BETWEEN 500 AND 900")
def r15_class_filter(spark, sf_dir):
    return search.faceted(_items(spark, sf_dir), lc_class="TR", lc_between=(500, 900)).select("ord")


@query("SELECT line_no FROM photo_scored WHERE photo_insert_bucket IN ('Likely', 'Strongly Likely')")
def r16_bucket_filter(spark, sf_dir):
    return search.faceted(_scored(spark, sf_dir), buckets=["Likely", "Strongly Likely"]).select("line_no")


@query(f"SELECT ord FROM ({_ITEMS_Q}) WHERE year_number BETWEEN 1960 AND 1979")
def r17_year_filter(spark, sf_dir):
    return search.faceted(_items(spark, sf_dir), years=(1960, 1979)).select("ord")


@query(
    f"SELECT ord FROM ({_ITEMS_Q}) WHERE lc_class = 'TR' AND list_contains(signals, 'image') AND photo_insert_bucket IN ('Likely', 'Strongly Likely', 'Plausible') "
    f"AND len({_match_sql('photo')}) > 0"
)
def r18_facets_and_search(spark, sf_dir):
    return search.faceted(_items(spark, sf_dir), signal="image", lc_class="TR", buckets=["Likely", "Strongly Likely", "Plausible"], query="photo").select("ord")


@query(f"SELECT ord, photo_insert_score AS score FROM ({_ITEMS_Q}) WHERE list_contains(signals, 'labor') AND photo_insert_score >= 70")
def r19_score_threshold(spark, sf_dir):
    found = search.faceted(_items(spark, sf_dir), signal="labor", least_score=70)
    return found.orderBy(F.desc("photo_insert_score"), "ord").select("ord", F.col("photo_insert_score").alias("score"))


@query("SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INT) >= 50")
def r20_json_predicate(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").try_cast("int") >= 50).select("event_id")


# --- joins and sets ------------------------------------------------------------------

_LAST = q.last_per_id("photo_scored", "line_no")
_FIRST = q.first_per_id("photo_scored", "line_no")


@query(f"SELECT i.ord, s.photo_insert_score AS score, s.photo_insert_bucket AS bucket FROM sekula_index i LEFT JOIN {_LAST} s ON i.id = s.id")
def j01_merged(spark, sf_dir):
    rows = merge.merged(_index(spark, sf_dir).select("ord", "id"), _last_scores(spark, sf_dir))
    return rows.select("ord", F.col("photo_insert_score").alias("score"), F.col("photo_insert_bucket").alias("bucket"))


@query(
    f"SELECT i.ord, {q.joined('i.authors')} AS authors, coalesce(s.photo_insert_score::VARCHAR, '') AS photo_insert_score, coalesce(s.photo_insert_bucket, '') AS photo_insert_bucket, "
    f"coalesce(s.scoring_metadata.provider, '') AS photo_scoring_provider FROM sekula_index i LEFT JOIN {_LAST} s ON i.id = s.id"
)
def j02_merged_flat(spark, sf_dir):
    rows = merge.merged_text(_index(spark, sf_dir).select("ord", "id", "authors"), _last_scores(spark, sf_dir))
    flat = sinks.flattened(rows)
    return flat.select(F.col("ord").cast("bigint").alias("ord"), "authors", "photo_insert_score", "photo_insert_bucket", "photo_scoring_provider")


@query("SELECT id FROM photo_feature_packets WHERE id NOT IN (SELECT id FROM photo_scored WHERE id IS NOT NULL)")
def j03_unscored(spark, sf_dir):
    return merge.not_in(_packets(spark, sf_dir), _scored(spark, sf_dir)).select("id")


@query(f'SELECT a.id, a.photo_insert_score AS "left", b.photo_insert_score AS "right" FROM {_FIRST} a JOIN {_LAST} b ON a.id = b.id WHERE a.photo_insert_score IS DISTINCT FROM b.photo_insert_score')
def j05_mismatches(spark, sf_dir):
    scored = _scored(spark, sf_dir).select("id", "line_no", "photo_insert_score")
    first = merge.first_per_key(scored, "id", ["line_no"])
    return merge.mismatches(first, merge.last_per_key(scored, "id", ["line_no"]), "id", "photo_insert_score")


_PRESENCE = (
    "SELECT id, bool_or(s = 'records') AS in_records, bool_or(s = 'packets') AS in_packets, bool_or(s = 'scored') AS in_scored FROM (SELECT id, 'records' AS s FROM sekula_index "
    "UNION ALL SELECT id, 'packets' FROM photo_feature_packets UNION ALL SELECT id, 'scored' FROM photo_scored) WHERE id IS NOT NULL GROUP BY id"
)


@query(_PRESENCE)
def j06_presence(spark, sf_dir):
    return merge.presence({"records": _index(spark, sf_dir), "packets": _packets(spark, sf_dir), "scored": _scored(spark, sf_dir)})


@query("SELECT ord, title FROM sekula_index WHERE id = (SELECT arg_min(id, line_no) FROM photo_scored WHERE id IS NOT NULL)")
def j07_sample(spark, sf_dir):
    first = _scored(spark, sf_dir).where(F.col("id").isNotNull()).agg(F.min_by("id", "line_no").alias("id"))
    return _index(spark, sf_dir).select("ord", "id", "title").join(F.broadcast(first), "id", "left_semi").select("ord", "title")  # one row


@query(
    f"SELECT selection_id, u.id, u.id IN (SELECT id FROM photo_scored WHERE id IS NOT NULL) AS found FROM (SELECT selection_id, unnest(items) AS id FROM ({_ITEMS_SQL})) u"
)
def j08_receipt_items(spark, sf_dir):
    rows = _receipts(spark, sf_dir).select(F.col("selection_id").alias("receipt_id"), "items")
    return receipts.item_report(rows, _scored(spark, sf_dir)).select(F.col("receipt_id").alias("selection_id"), "id", "found")


@query(
    f"SELECT selection_id, u.id, u.id IN (SELECT id FROM photo_scored WHERE id IS NOT NULL) AS found FROM (SELECT selection_id, unnest(items) AS id FROM ({_TABLE_ITEMS_SQL})) u"
)
def j08_table_items(spark, sf_dir):
    rows = _receipts(spark, sf_dir, _table_selections).select(F.col("selection_id").alias("receipt_id"), "items")
    return receipts.item_report(rows, _scored(spark, sf_dir)).select(F.col("receipt_id").alias("selection_id"), "id", "found")


@query(
    f"SELECT p.id AS path_id, i.ord::VARCHAR AS id, len(list_intersect(i.signals, p.signals))::BIGINT AS signal_hits, "
    f"coalesce(len(list_filter(p.suggested_classes, lambda c: starts_with(i.lc_class, c))) > 0, false) AS class_hit "
    f"FROM ({_ITEMS_Q}) i, curated_paths p WHERE list_has_any(i.signals, p.signals)"
)
def j09_curated(spark, sf_dir):
    items = shelf.parsed(_with_signals(_index(spark, sf_dir).select("ord", "call_number", "subjects", "notes"))).withColumn("id", F.col("ord").cast("string"))
    return search.on_paths(items, table(spark, sf_dir, "curated_paths"))


@query(f"SELECT id, line_no FROM {_LAST}")
def w02_last_wins(spark, sf_dir):
    return merge.last_per_key(_scored(spark, sf_dir).select("id", "line_no"), "id", ["line_no"])


@query("SELECT id, shard, ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shard, harvested_at, ord) AS rn FROM sekula_index WHERE id IS NOT NULL) WHERE rn = 1 OR id = ''")
def w01_first_wins(spark, sf_dir):
    rows = _index(spark, sf_dir).select("id", "shard", "ord", "harvested_at")
    return merge.first_per_key(rows, "id", ["shard", "harvested_at", "ord"]).select("id", "shard", "ord")


@query("SELECT id, photo_insert_score AS score FROM photo_scored UNION ALL SELECT id, NULL FROM photo_feature_packets WHERE id NOT IN (SELECT id FROM photo_scored WHERE id IS NOT NULL)")
def u01_appended(spark, sf_dir):
    done = _scored(spark, sf_dir).select("id", F.col("photo_insert_score").alias("score"))
    return merge.appended(done, merge.not_in(_packets(spark, sf_dir), done).select("id"))


@query(f"SELECT count(*) FILTER (WHERE in_packets AND NOT in_scored) AS only_a, count(*) FILTER (WHERE in_scored AND NOT in_packets) AS only_b, count(*) FILTER (WHERE in_packets <> in_scored) = 0 AS same FROM ({_PRESENCE})")
def u02_same_ids(spark, sf_dir):
    return merge.same_ids(_packets(spark, sf_dir), _scored(spark, sf_dir))


@query("SELECT id FROM sekula_index EXCEPT SELECT id FROM photo_feature_packets")
def u03_difference(spark, sf_dir):
    return _index(spark, sf_dir).select("id").subtract(_packets(spark, sf_dir).select("id"))


@query("SELECT shard, count(*) AS n, count(DISTINCT id) AS n_ids FROM sekula_index GROUP BY shard")
def u04_shard_union(spark, sf_dir):
    return _index(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


# --- aggregations --------------------------------------------------------------------

_YEAR_SQL = q.display_year("year", AS_OF)


def _range_sql(ranges: list[tuple[str, int, int]], e: str = "y") -> str:
    return "CASE " + " ".join(f"WHEN {e} BETWEEN {a} AND {b} THEN '{label}'" for label, a, b in ranges) + " END"


def _counted_sql(values: list[str], facet: str, source: str, name: str = "facet") -> str:
    return f"SELECT dim.{name}, dim.place, count(f.x)::BIGINT AS n FROM {q.dimension(values, name)} LEFT JOIN (SELECT {facet} AS x FROM {source}) f ON f.x = dim.{name} GROUP BY dim.{name}, dim.place"


@query(_counted_sql([d[0] for d in facets.DECADES], _range_sql(facets.DECADES), f"(SELECT {_YEAR_SQL} AS y FROM sekula_index)"))
def a01_decades(spark, sf_dir):
    return facets.by_decade(_index(spark, sf_dir), AS_OF)


_LETTER_SQL = "CASE WHEN regexp_full_match(upper(substring(coalesce(call_number, ''), 1, 1)), '[0-9A-Z]') THEN upper(substring(call_number, 1, 1)) ELSE 'Other' END"
_LETTERS = [*"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "Other"]


@query(_counted_sql(_LETTERS, _LETTER_SQL, "sekula_index"))
def a02_call_letters(spark, sf_dir):
    return facets.by_call_letter(_index(spark, sf_dir))


@query(
    "SELECT 'material' AS \"group\", * FROM (" + _counted_sql(["Book", "Journal"], "material_type", "sekula_index") + ") UNION ALL SELECT 'letter', * FROM ("
    + _counted_sql(_LETTERS, _LETTER_SQL, "sekula_index") + ")"
)
def e01_facet_groups(spark, sf_dir):
    groups = {"material": (F.col("material_type"), ["Book", "Journal"]), "letter": (facets.call_letter(F.col("call_number")), _LETTERS)}
    return facets.facet_counts(_index(spark, sf_dir), groups)


_FLAGS = ["has_photographs", "has_plates", "has_illustrations", "frontispiece_only"]


@query(" UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER (WHERE evidence_flags.{f}) AS n, round(100.0 * count(*) FILTER (WHERE evidence_flags.{f}) / count(*), 1)::DOUBLE AS pct FROM photo_feature_packets" for f in _FLAGS))
def a03_flag_shares(spark, sf_dir):
    return facets.flag_shares(_packets(spark, sf_dir))


def _bucket_sql(source: str, column: str) -> str:
    return (
        f"SELECT dim.bucket, dim.place, count(f.b)::BIGINT AS n, round(100.0 * count(f.b) / (SELECT count(*) FROM {source}), 1)::DOUBLE AS pct "
        f"FROM {q.dimension([b for b, _ in BUCKETS], 'bucket')} LEFT JOIN (SELECT {column} AS b FROM {source}) f ON f.b = dim.bucket GROUP BY dim.bucket, dim.place"
    )


@query(_bucket_sql("photo_scored", "photo_insert_bucket"))
def a04_buckets(spark, sf_dir):
    return facets.bucket_shares(_scored(spark, sf_dir))


_FROM_INDEX = f"(SELECT {q.bucket('(' + q.rule_score() + ')')} AS bucket FROM ({q.PACKETS}))"


@query(_bucket_sql(_FROM_INDEX, "bucket"))
def a04_likelihood_of_index(spark, sf_dir):
    """The flagship: index to packets to scores to bucket shares, one scan."""
    return facets.bucket_shares(scoring.scored(features.packets(_index(spark, sf_dir))))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE id IN (SELECT id FROM photo_scored WHERE id IS NOT NULL)) AS matched, round(count(*) FILTER (WHERE id IN (SELECT id FROM photo_scored WHERE id IS NOT NULL)) / count(*), 6) AS rate FROM sekula_index")
def a05_match_rate(spark, sf_dir):
    return facets.match_rate(_index(spark, sf_dir).select("id"), _scored(spark, sf_dir))


@query("SELECT count(DISTINCT id) AS n_ids, count(*) AS n FROM sekula_index")
def a06_distinct_ids(spark, sf_dir):
    return _index(spark, sf_dir).agg(F.count_distinct("id").alias("n_ids"), F.count("*").alias("n"))


@query("SELECT shard, n, (sum(n) OVER (ORDER BY shard))::BIGINT AS so_far FROM (SELECT shard, count(*) AS n FROM sekula_index GROUP BY shard)")
def a07_running_totals(spark, sf_dir):
    from pyspark.sql import Window

    counts = _index(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"))  # a row per shard, so one window partition is bounded
    return counts.select("shard", "n", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))


@query(
    "SELECT count(s) AS n, round(avg(s), 6) AS avg, min(s) AS least, max(s) AS most, "
    + ", ".join(f"round(quantile_cont(s, {p}), 6)::DOUBLE AS q{i}" for i, p in enumerate((0, 0.25, 0.5, 0.75, 1)))
    + " FROM (SELECT photo_insert_score AS s FROM photo_scored)"
)
def a09_score_summary(spark, sf_dir):
    return facets.score_summary(_scored(spark, sf_dir))


@query(f"SELECT lc_class, y // 10 * 10 AS decade, count(*) AS n FROM (SELECT {q.lc_class()} AS lc_class, {_YEAR_SQL} AS y FROM sekula_index) GROUP BY ALL")
def a12_class_by_decade(spark, sf_dir):
    rows = _index(spark, sf_dir).select(fields.lc_class(F.col("call_number")).alias("lc_class"), fields.decade(fields.display_year(F.col("year"), AS_OF)).alias("decade"))
    return rows.groupBy("lc_class", "decade").agg(F.count("*").alias("n"))


@query(f"SELECT lc_class, count(*) AS n FROM (SELECT {q.lc_class()} AS lc_class FROM sekula_index) GROUP BY ALL")
def a10_classes(spark, sf_dir):
    return shelf.parsed(_index(spark, sf_dir).select("call_number")).groupBy("lc_class").agg(F.count("*").alias("n"))


@query(f"SELECT x AS a, y AS b, count(*) AS n FROM (SELECT ord, unnest(signals) AS x FROM ({_SIGNALS})) JOIN (SELECT ord, unnest(signals) AS y FROM ({_SIGNALS})) USING (ord) WHERE x <= y GROUP BY ALL")
def a11_signal_overlap(spark, sf_dir):
    return facets.overlap(_with_signals(_index(spark, sf_dir).select("subjects", "notes")), "signals")


_CLASSES = ["N", "TR", "HD", "HE", "PN", "Z", "VM", "G", "TC", "QA"]
_PER_CLASS = _counted_sql(_CLASSES, "lc_class", f"(SELECT {q.lc_class()} AS lc_class FROM sekula_index)", "lc_class")


@query(f"SELECT lc_class, n, round(n / (SELECT sum(n) FROM ({_PER_CLASS})), 6) AS share, round(n / (SELECT sum(n) FROM ({_PER_CLASS})) - 0.1::DOUBLE, 6) AS gap FROM ({_PER_CLASS})")
def a13_gaps(spark, sf_dir):
    return facets.gaps(shelf.parsed(_index(spark, sf_dir).select("call_number")), _CLASSES, "lc_class")


@query(f"SELECT sha256({q.strip(q.text('description'))}) AS digest, count(DISTINCT id) AS n_ids FROM sekula_index GROUP BY 1 HAVING count(DISTINCT id) > 1")
def a14_duplicates(spark, sf_dir):
    return facets.duplicates(_index(spark, sf_dir), strip(F.coalesce("description", F.lit(""))))


@query(
    "SELECT line_no, round((s - m) / sd, 6) AS z FROM (SELECT line_no, photo_insert_score AS s, page_count_bin AS b FROM photo_scored) JOIN (SELECT page_count_bin AS b, avg(photo_insert_score) AS m, "
    "stddev_pop(photo_insert_score) AS sd FROM photo_scored GROUP BY 1) USING (b) WHERE abs(round((s - m) / sd, 6)) > 2"
)
def a15_outliers(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("line_no", "page_count_bin", "photo_insert_score")
    return facets.outliers(rows, "page_count_bin", "photo_insert_score", 2.0).select("line_no", "z")


@query()
def a15_clusters(spark, sf_dir):
    """Packets in five groups by their flags, decade and number of tags."""
    flags = [F.col(f"evidence_flags.{f}").alias(f) for f in _FLAGS]
    rows = _packets(spark, sf_dir).select("id", *flags, "decade", F.size("domain_tags").alias("n_tags"))
    return facets.clusters(rows, [*_FLAGS, "decade", "n_tags"], 5).select("id", "cluster")


@query(f"SELECT lc_class, floor(lc_number / 100)::BIGINT AS segment, count(*) AS n, round(avg(photo_insert_score), 6) AS mean FROM ({_ITEMS_Q}) WHERE lc_number IS NOT NULL GROUP BY 1, 2")
def a16_segment_means(spark, sf_dir):
    return shelf.segment_means(_items(spark, sf_dir), "photo_insert_score")


@query(f"SELECT shard, n, n > 500 AS over FROM ({_counted_sql([s[0] for s in SHARDS], _range_sql(SHARDS), f'(SELECT {_YEAR_SQL} AS y FROM sekula_index)', 'shard')})")
def a17_over_cap(spark, sf_dir):
    return facets.over_cap(_index(spark, sf_dir), AS_OF, 500)


# --- shelf order ---------------------------------------------------------------------

_SHELF = f"SELECT ord, id, call_number, {q.lc_class()} AS lc_class, {q.lc_number()} AS lc_number, {q.lc_key()} AS lc_key FROM sekula_index"
_ONE_ID = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM ({_SHELF})) WHERE rn = 1"


def _shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.parsed(_index(spark, sf_dir).select("ord", "id", "call_number"))


def _shelf_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.parsed(merge.first_per_key(_index(spark, sf_dir).select("ord", "id", "call_number"), "id", ["ord"]))


@query(f"SELECT ord, lc_key FROM ({_SHELF}) ORDER BY lc_key NULLS LAST, call_number NULLS LAST, id NULLS LAST")
def o01_shelf_order(spark, sf_dir):
    return shelf.ordered(_shelf(spark, sf_dir)).select("ord", "lc_key")


@query(f"SELECT id, lc_key FROM ({_ONE_ID}) ORDER BY lc_key NULLS LAST, call_number NULLS LAST, id NULLS LAST LIMIT 25 OFFSET 50")
def o06_page(spark, sf_dir):
    return shelf.page(_shelf_of_ids(spark, sf_dir), 50, 25).select("id", "lc_key")


@query("SELECT line_no, photo_insert_score AS score FROM photo_scored ORDER BY photo_insert_score DESC NULLS LAST, line_no LIMIT 10")
def o04_first(spark, sf_dir):
    rows = _scored(spark, sf_dir).orderBy(F.desc_nulls_last("photo_insert_score"), "line_no").limit(10)
    return rows.select("line_no", F.col("photo_insert_score").alias("score"))


@query(
    f"SELECT lc_class, prev AS before, num AS after, num - prev AS gap FROM (SELECT lc_class, num, lag(num) OVER (PARTITION BY lc_class ORDER BY num) AS prev FROM "
    f"(SELECT DISTINCT lc_class, floor(lc_number)::BIGINT AS num FROM ({_SHELF}) WHERE lc_number IS NOT NULL)) WHERE num - prev > 20"
)
def w04_sequence_gaps(spark, sf_dir):
    return shelf.sequence_gaps(_shelf(spark, sf_dir), 20)


@query(f"SELECT call_number, count(DISTINCT id) AS n FROM sekula_index WHERE trim(call_number) <> '' GROUP BY 1 HAVING count(DISTINCT id) > 1")
def w04_repeated_numbers(spark, sf_dir):
    return shelf.repeated_numbers(_shelf(spark, sf_dir))


_W = "OVER (PARTITION BY lc_class ORDER BY lc_key, call_number, id)"


@query(f"SELECT id, lc_class, row_number() {_W} AS position, lag(id) {_W} AS left_id, lead(id) {_W} AS right_id FROM ({_ONE_ID}) WHERE lc_class IS NOT NULL")
def w05_neighbours(spark, sf_dir):
    return shelf.neighbours(_shelf_of_ids(spark, sf_dir))


@query(
    f"SELECT a.id, round(avg(s.photo_insert_score) OVER (PARTITION BY lc_class ORDER BY lc_key, call_number, a.id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS mean FROM ({_ONE_ID}) a "
    f"LEFT JOIN {_LAST} s ON a.id = s.id WHERE lc_class IS NOT NULL"
)
def w06_rolling_mean(spark, sf_dir):
    return shelf.rolling_mean(merge.merged(_shelf_of_ids(spark, sf_dir), _last_scores(spark, sf_dir)), "photo_insert_score", 5)


@query(
    f"SELECT lc_class, decade, n, n - lag(n) OVER (PARTITION BY lc_class ORDER BY decade) AS change FROM (SELECT lc_class, (y // 10 * 10)::INT AS decade, count(*) AS n FROM "
    f"(SELECT {q.lc_class()} AS lc_class, {_YEAR_SQL} AS y FROM sekula_index) WHERE lc_class IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2)"
)
def w07_trend(spark, sf_dir):
    rows = shelf.parsed(_index(spark, sf_dir).select("call_number", "year")).withColumn("decade", fields.decade(fields.display_year(F.col("year"), AS_OF)))
    return shelf.trend(rows, "lc_class", "decade")


# --- exports, checks, incremental runs ------------------------------------------------


def _bibtex_sql(rows: str) -> str:
    def safe(e: str) -> str:
        return f"regexp_replace(coalesce({e}, ''), '([&%$#_{{}}])', '\\\\\\1', 'g')"

    names = f"array_to_string(list_transform(list_filter(coalesce(authors, []::VARCHAR[]), lambda x: true), lambda x: {safe('x')}), ' and ')"
    return (
        f"SELECT id, '@book{{' || id || ',' || chr(10) || '  title = {{' || {safe('title')} || '}},' || chr(10) || '  author = {{' || {names} || '}},' || chr(10) || '  year = {{' || {safe('year')} || '}},' "
        f"|| chr(10) || '  publisher = {{' || {safe('publishers[1]')} || '}}' || chr(10) || '}}' AS entry FROM {rows}"
    )


@query(_bibtex_sql("sekula_index"))
def k10_bibtex(spark, sf_dir):
    return sinks.bibtex(_index(spark, sf_dir))


@query(_bibtex_sql("(SELECT * FROM sekula_index ORDER BY ord LIMIT 10)"))
def k10_first_entries(spark, sf_dir):
    return sinks.bibtex(_index(spark, sf_dir), 10, ["ord"])


_TEXT_COLUMNS = [
    "id", "alma_mms", "source_record_id", "original_source_id", "source_system", "frbr_group_id", "title", "uniform_title", "year", "material_type", "description",
    "collection", "call_number", "availability", "record_url", "source", "shard", "best_location", "holdings",
]
_LIST_COLUMNS = [
    "alternative_titles", "authors", "contributors", "languages", "formats", "identifiers", "publishers", "places", "series", "table_of_contents", "notes",
    "provenance_notes", "sekula_notes", "subjects", "collection_tags", "call_number_notes", "isbns", "issns", "oclc_numbers", "lccn",
]
_FLAT_SQL = (
    "SELECT ord::VARCHAR AS ord, coalesce(rtrim(rtrim(strftime(harvested_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.'), '') AS harvested_at, "
    + ", ".join([f"{q.text(c)} AS {c}" for c in _TEXT_COLUMNS] + [f"{q.joined(c)} AS {c}" for c in _LIST_COLUMNS])
    + " FROM sekula_index"
)


@query(_FLAT_SQL)
def k02_flattened(spark, sf_dir):
    return sinks.flattened(_index(spark, sf_dir))


@query(_FLAT_SQL)
def k02_flat_records(spark, sf_dir):
    """The same from the file it is written to, read back."""
    path = scratch(spark, "flat-records")
    sinks.write_flat(_index(spark, sf_dir), path)
    return flat_text(spark, path, [])


def _json_sql(struct: str, members: list[str]) -> str:
    """A struct as JSON text without its null members, null for null."""
    parts = ", ".join(f"CASE WHEN {struct}.{m} IS NOT NULL THEN '\"{m}\":' || to_json({struct}.{m}) END" for m in members)
    return f"CASE WHEN {struct} IS NULL THEN '' ELSE '{{' || concat_ws(',', {parts}) || '}}' END"


_FORMATS = ["exhibition_catalog", "survey_report", "technical_manual", "fiction", "cookbook"]


@query(
    f"SELECT id, title, coalesce(year::VARCHAR, '') AS year, coalesce(decade::VARCHAR, '') AS decade, coalesce(publisher_norm, '') AS publisher_norm, coalesce(call_number_prefix, '') AS call_number_prefix, "
    f"{q.joined('domain_tags')} AS domain_tags, coalesce(page_count_bin, '') AS page_count_bin, {_json_sql('evidence_flags', _FLAGS)} AS evidence_flags, {_json_sql('format_flags', _FORMATS)} AS format_flags, "
    f"coalesce(notes_excerpt, '') AS notes_excerpt, {q.joined('publishers')} AS publishers FROM (SELECT * REPLACE (coalesce(id, '') AS id, coalesce(title, '') AS title) FROM photo_feature_packets)"
)
def k02_flat_packets(spark, sf_dir):
    """Structs become JSON text."""
    return sinks.flattened(_packets(spark, sf_dir))


def _checks_sql() -> str:
    """The five checks and their summary, the packets being the second data set."""
    second = f"(SELECT p.id, s.photo_insert_score FROM photo_feature_packets p LEFT JOIN {_LAST} s ON p.id = s.id)"
    sets = "SELECT id, 'a' AS s FROM sekula_index UNION ALL SELECT id, 'b' FROM photo_feature_packets UNION ALL SELECT id, 'c' FROM photo_scored"
    return (
        "WITH c AS (SELECT 1 AS place, 'structure' AS \"check\", (SELECT count(*) > 0 AND count(*) FILTER (WHERE coalesce(id, '') = '') = 0 FROM photo_scored) AS passed, 0::BIGINT AS warnings "
        f"UNION ALL SELECT 2, 'merged scores', true, (SELECT count(*) FROM sekula_index i LEFT JOIN {_LAST} s ON i.id = s.id WHERE s.photo_insert_score IS NULL) "
        f"UNION ALL SELECT 3, 'coverage', true, (SELECT count(*) FROM {second} WHERE photo_insert_score IS NULL) "
        f"UNION ALL SELECT 4, 'id sets', true, (SELECT count(*) FROM (SELECT id, count(DISTINCT s) AS k FROM ({sets}) WHERE id IS NOT NULL GROUP BY id) WHERE k < 3) "
        "UNION ALL SELECT 5, 'sample', (SELECT count(*) > 0 FROM sekula_index WHERE id = (SELECT arg_min(id, line_no) FROM photo_scored WHERE id IS NOT NULL)), 0) "
        "SELECT * FROM c UNION ALL SELECT 6, 'all', bool_and(passed), sum(warnings)::BIGINT FROM c"
    )


def _checked(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    merged = merge.merged(_index(spark, sf_dir).select("ord", "id"), _last_scores(spark, sf_dir))
    second = merge.merged(_packets(spark, sf_dir).select("id"), _last_scores(spark, sf_dir))
    return quality.report(merged, second, _scored(spark, sf_dir), lines=lines).select("place", "check", "passed", "warnings")


@query(_checks_sql())
def q05_checks(spark, sf_dir):
    return _checked(spark, sf_dir)


@query(_checks_sql())
def q06_report(spark, sf_dir):
    """The same, the first check over the scores written as JSON lines."""
    path = scratch(spark, "scored-lines")
    sinks.write_lines(_scored(spark, sf_dir), path)
    return _checked(spark, sf_dir, raw_lines(spark, path))


@query(
    f"SELECT id, photo_insert_score AS score FROM photo_scored UNION ALL SELECT id, {q.rule_score()} FROM photo_feature_packets WHERE id NOT IN (SELECT id FROM photo_scored WHERE id IS NOT NULL)"
)
def i01_resumed(spark, sf_dir):
    done = _scored(spark, sf_dir).select("id", "photo_insert_score")
    fresh = incremental.resumed(_packets(spark, sf_dir), done, lambda df: scoring.scored(df).select("id", "photo_insert_score"))
    return fresh.select("id", F.col("photo_insert_score").alias("score"))


@query(f"SELECT id, max({q.rule_score()}) AS score FROM photo_feature_packets GROUP BY id")
def i01_score_stream(spark, sf_dir):
    """Packets as files, scored by a stream that stops when all are seen; a
    second run finds nothing new."""
    base = scratch(spark, "stream")
    packets = _packets(spark, sf_dir)
    packets.write.json(f"{base}/in")
    for _ in range(2):
        incremental.score_stream(spark, f"{base}/in", packets.schema, f"{base}/out", f"{base}/checkpoint", lambda df: scoring.scored(df).select("id", "photo_insert_score"))
    return spark.read.parquet(f"{base}/out").select("id", F.col("photo_insert_score").alias("score"))


def _bursts_sql(minutes: int) -> str:
    return (
        f"SELECT user_id, count(*) AS n, arg_max(event_type, ts) AS last FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL {minutes} MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g "
        "FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, g"
    )


@query(_bursts_sql(30))
def i04_bursts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return incremental.bursts(rows, "user_id", "ts", "event_type", "30 minutes").select("user_id", "n", "last")


@query(_bursts_sql(2))
def i05_idle_resets(spark, sf_dir):
    """Visits that end after two idle minutes."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return incremental.bursts(rows, "user_id", "ts", "event_type", "2 minutes").select("user_id", "n", "last")


_HARVEST_YEAR = "try_cast(regexp_extract(coalesce(year, ''), '(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)', 1) AS INT)"


@query(
    f"SELECT shard, ((rn - 1) // 500 * 500)::INT AS \"offset\", ((rn - 1) % 500)::INT AS position, id FROM (SELECT {_range_sql(SHARDS)} AS shard, id, row_number() OVER (PARTITION BY {_range_sql(SHARDS)} ORDER BY ord) AS rn "
    f"FROM (SELECT *, {_HARVEST_YEAR} AS y FROM sekula_index)) WHERE shard IS NOT NULL"
)
def s03_harvest(spark, sf_dir):
    """The table laid out in pages and served page by page through the data source."""
    rows = _paged(spark, sf_dir).option("limit", "500").load()
    return rows.select("shard", "offset", "position", F.get_json_object("document", "$.id").alias("id"))


def _paged(spark: SparkSession, sf_dir: str):
    path = scratch(spark, "pages")
    write_pages(_index(spark, sf_dir), path)
    spark.dataSource.register(HarvestSource)
    return spark.read.format("harvest").option("client", "shelfmark.sources.harvest:paged_client").option("table", path)


@query(f"SELECT shard, count(*)::INT AS hits FROM (SELECT {_range_sql(SHARDS)} AS shard FROM (SELECT {_HARVEST_YEAR} AS y FROM sekula_index)) WHERE shard IS NOT NULL GROUP BY shard")
def s08_probe(spark, sf_dir):
    rows = _paged(spark, sf_dir).option("mode", "totals").load()
    return rows.where(F.col("position") > 0).select("shard", F.col("position").alias("hits"))
