"""Registered queries that write files and read them back, each with the SQL
that says what must be read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import scoring
from shelfmark.operators import merge
from shelfmark.plans import sql as q
from shelfmark.sources import files, sinks
from shelfmark.streaming import incremental
from shelfmark.tables import scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT place_id, name, country, alt_name FROM ref_places")
def s04_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array in one file, an export of a browsable size."""
    rows, path = table(spark, sf_dir, "ref_places"), scratch(spark, "array")
    sinks.write_array(rows, path, ["place_id"])
    return files.json_array(spark, path, rows.schema)


@query(
    "SELECT line_no, id, title, year, array_to_string(domain_tags, ',') AS tags, evidence_flags.has_plates AS plates, photo_insert_score AS score, photo_insert_bucket AS bucket, "
    "scoring_metadata.run_id AS run_id, scoring_metadata.timestamp AS ts FROM photo_scored"
)
def s05_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored packets as JSON lines."""
    rows, path = table(spark, sf_dir, "photo_scored"), scratch(spark, "lines")
    sinks.write_lines(rows, path)
    meta = F.col("scoring_metadata")
    return files.json_lines(spark, path, rows.schema).select(
        "line_no", "id", "title", "year", F.array_join("domain_tags", ",").alias("tags"), F.col("evidence_flags.has_plates").alias("plates"),
        F.col("photo_insert_score").alias("score"), F.col("photo_insert_bucket").alias("bucket"), meta["run_id"].alias("run_id"), meta["timestamp"].alias("ts"),
    )


@query("SELECT id, title, subtitle, narrative, array_to_string(signals, ',') AS signals, array_to_string(suggested_classes, ',') AS suggested_classes, color_mode, icon FROM curated_paths")
def s06_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path rules as the JSON config they are kept in."""
    path = scratch(spark, "paths")
    one = F.struct(
        *["id", "title", "subtitle", "narrative", "signals"], F.col("suggested_classes").alias("suggestedClasses"), F.col("color_mode").alias("colorMode"), "icon"
    )
    whole = table(spark, sf_dir, "curated_paths").agg(F.lit("paths@1").alias("schema"), F.lit("1").alias("version"), F.collect_list(one).alias("paths"))  # 8 rules
    whole.coalesce(1).write.json(path)
    rows = files.curated_paths(spark, path)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("signals", "suggested_classes")})


@query("SELECT ord, trim(coalesce(shard, '')) AS title, ord::VARCHAR || ' ' || coalesce(shard, '') || ' end' AS text FROM sekula_index")
def s10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a title, a style, a script and tags over several lines."""
    shard, ord_ = F.coalesce("shard", F.lit("")), F.col("ord").cast("string")
    page = F.concat(
        F.lit("<html><head><TITLE>\n "), shard, F.lit(" </TITLE><style>p { color: red }</style></head>\n<body class='a'><h1\nid='x'>"), ord_,
        F.lit("</h1><script>if (1) { alert('<p>') }</script>\n\n<p>"), shard, F.lit("</p> <br/>end</body></html>"),
    )
    pages = table(spark, sf_dir, "sekula_index").select("ord", page.alias("html"))
    bare = F.regexp_replace(files.html_text(F.col("html")), r"^\S+ (?=\d)", "")
    return pages.select("ord", files.html_title(F.col("html")).alias("title"), F.expr("html").alias("html")).select("ord", "title", bare.alias("text"))


def _read_back(c: str) -> str:
    """A list as a flattened file gives it back: null items are lost, an empty
    text is no items."""
    return f"CASE WHEN {q.joined(c)} = '' THEN '' ELSE {q.joined(c)} END AS {c}, CASE WHEN {q.joined(c)} = '' THEN 0 ELSE len(string_split({q.joined(c)}, ' | ')) END::INT AS n_{c}"


_LISTS = ["authors", "publishers", "subjects", "notes", "isbns"]


@query(f"SELECT ord::VARCHAR AS ord, {q.text('title')} AS title, {q.text('description')} AS description, {', '.join(map(_read_back, _LISTS))} FROM sekula_index")
def s11_flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flattened table, read back with its lists."""
    path = scratch(spark, "flat")
    sinks.write_flat(table(spark, sf_dir, "sekula_index"), path)
    back = files.flat_text(spark, path)
    lists = [x for c in _LISTS for x in (F.array_join(c, " | ").alias(c), F.size(c).alias(f"n_{c}"))]
    return back.select("ord", "title", "description", *lists)


_LAST = q.last_per_id("photo_scored", "line_no")


@query(f"SELECT i.ord, s.photo_insert_score AS score FROM sekula_index i LEFT JOIN {_LAST} s ON i.id = s.id")
def k04_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced twice by its own rows with the scores merged in; the
    second time changes nothing."""
    path = f"{scratch(spark, 'replaced')}/table"
    scores = merge.last_per_key(table(spark, sf_dir, "photo_scored").select("id", "line_no", *merge.SCORES), "id", ["line_no"])
    table(spark, sf_dir, "sekula_index").select("ord", "id").write.parquet(path)
    for _ in range(2):
        own = spark.read.parquet(path).select("ord", "id")
        sinks.replace_table(merge.merged(own, scores), path)
    return spark.read.parquet(path).select("ord", F.col("photo_insert_score").alias("score"))


@query(
    "SELECT 'run-1' AS run_id, 2.5::DOUBLE AS seconds, (SELECT count(*) FROM sekula_index)::INT AS n_records, (SELECT count(*) FROM photo_scored)::INT AS n_scored, true AS inputs_hashed, true AS outputs_hashed"
)
def k11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's manifest over its input and output files, written and read back.
    Digests are checked by their form here: SQL has no paths to read."""
    out, path = scratch(spark, "outputs"), scratch(spark, "manifest")
    scored = table(spark, sf_dir, "photo_scored")
    scored.write.parquet(out)
    counts = {"records": table(spark, sf_dir, "sekula_index").count(), "scored": scored.count()}
    inputs, outputs = files.file_digests(spark, f"{sf_dir}/photo_scored.parquet"), files.file_digests(spark, out)
    sinks.manifest(inputs, outputs, counts, "run-1", 2.5).write.json(path)
    digest = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("sha256", T.StringType())]))
    kind = T.StructType(
        [T.StructField("run_id", T.StringType()), T.StructField("inputs", digest), T.StructField("outputs", digest)]
        + [T.StructField("counts", T.MapType(T.StringType(), T.IntegerType())), T.StructField("seconds", T.DoubleType())]
    )
    back = files.json_lines(spark, path, kind)

    def hashed(c: str):
        return (F.size(c) > 0) & F.forall(c, lambda x: x["sha256"].rlike("^[0-9a-f]{64}$") & (x["length"] > 0))

    return back.select(
        "run_id", "seconds", F.col("counts")["records"].alias("n_records"), F.col("counts")["scored"].alias("n_scored"), hashed("inputs").alias("inputs_hashed"), hashed("outputs").alias("outputs_hashed")
    )


@query("SELECT shard, count(*) AS n, count(DISTINCT ord) AS n_rows FROM sekula_index WHERE shard IS NOT NULL GROUP BY shard")
def i02_guarded_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A harvest that broke off after three shards and is run twice more."""
    index, out = table(spark, sf_dir, "sekula_index").select("ord", "id", "shard"), scratch(spark, "shards")
    shards = sorted(r["shard"] for r in index.where("shard IS NOT NULL").select("shard").distinct().collect())  # one row per publication range

    def read(s: str) -> DataFrame:
        return index.where(F.col("shard") == s).drop("shard")

    for some in (shards[:3], shards, shards):
        incremental.harvest_shards(spark, read, out, some)
    return spark.read.parquet(out).groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count("*").alias("n"), F.count_distinct("ord").alias("n_rows"))


INSTRUCTIONS = "Score how likely the book has a photographic insert."


def chat(body: dict) -> dict:
    """Stands for a chat service: fenced answers, now and then none."""
    told = body["messages"][1]["content"]
    packet = json.loads(told.split("Book metadata:\n", 1)[1].split("\n\nAnswer with", 1)[0])
    if packet["page_count_bin"] == "unknown":
        return {"choices": []}
    said = json.dumps({"likelihood": {">300": 140, "150-300": 60}.get(packet["page_count_bin"], 30), "reasoning": "by size"})
    return {"choices": [{"message": {"content": f"```json\n{said}\n```" if packet["page_count_bin"] == ">300" else said}}]}


@query(
    "SELECT id, CASE page_count_bin WHEN '>300' THEN 100 WHEN '150-300' THEN 60 WHEN 'unknown' THEN 20 ELSE 30 END AS photo_insert_score, "
    "CASE page_count_bin WHEN 'unknown' THEN 'Scoring failed' ELSE 'by size' END AS photo_insert_reasoning FROM photo_feature_packets"
)
def f22_service_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet put to a chat service with its prompt, its answer parsed."""
    scorer = scoring.ServiceScorer("https://chat.example/v1", "m", INSTRUCTIONS, post=chat, wait=lambda s: None)
    return scoring.scored_outside(table(spark, sf_dir, "photo_feature_packets").select("id", "page_count_bin"), scorer)
