"""Command line: harvest, packets, score, merge, verify.

    python -m shelfmark harvest --url https://catalog.example/pages --params '{"tab": "All"}' --collection NAME --output index
    python -m shelfmark packets --input index.json --output packets
    python -m shelfmark score --input packets --output scored --run-id run-1
    python -m shelfmark score --input packets --output scored --service URL --model M --instructions FILE
    python -m shelfmark merge --input index.json --scores scored --output merged [--flat]
    python -m shelfmark verify --input merged --scores scored

Inputs are a JSON array file or a folder of JSON lines; outputs are folders.  Each
command but verify prints how many rows it wrote.  A harvest broken off goes on
with the publication ranges it lacks.  The key of a scoring service is read from
SCORER_API_KEY, never from the command line.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.features import packets
from shelfmark.functions.scoring import ServiceScorer, bucket, provenance, scored, scored_outside
from shelfmark.functions.vocabulary import SHARDS
from shelfmark.operators import quality
from shelfmark.operators.merge import SCORES, last_per_key, merged, merged_text
from shelfmark.operators.records import DOCUMENT, records
from shelfmark.sources import files, sinks
from shelfmark.sources.harvest import HarvestSource
from shelfmark.streaming.incremental import harvest_shards, resumed


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array file or of a folder of JSON lines."""
    schema = files.record_schema().add("photo_insert_score", T.IntegerType())
    schema = schema.add("photo_insert_bucket", T.StringType()).add("photo_insert_reasoning", T.StringType())
    read = files.json_array if path.endswith(".json") else files.json_lines
    return read(spark, path, schema)


def _scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored rows in file order: by file, then by place in it."""
    return spark.read.json(path).withColumn("line_no", F.monotonically_increasing_id())


def _harvest(spark: SparkSession, given: argparse.Namespace) -> None:
    """Records of the collection, one folder per publication range."""
    spark.dataSource.register(HarvestSource)

    def read(shard: str) -> DataFrame:
        source = spark.read.format("harvest").option("client", "shelfmark.sources.harvest:http_client")
        pages = source.option("url", given.url).option("params", given.params).option("shards", shard).load()
        return records(pages.select(F.from_json("document", DOCUMENT).alias("d")).select("d.*"), given.collection)

    harvest_shards(spark, read, given.output, [s[0] for s in SHARDS], sinks.write_lines)


def _by_service(df: DataFrame, given: argparse.Namespace, run: str, now: float) -> DataFrame:
    """Packets scored by a chat service, one row per id."""
    df = df.where(F.col("id").isNotNull()).dropDuplicates(["id"])
    with open(given.instructions, encoding="utf-8") as f:
        scorer = ServiceScorer(given.service, given.model, f.read(), key=os.environ["SCORER_API_KEY"])
    answers = scored_outside(df, scorer, batch=given.chunk_size)
    meta = provenance(run, now, provider=given.service, model=given.model)
    bucketed = answers.withColumn("photo_insert_bucket", bucket(F.col("photo_insert_score"))).withColumn("scoring_metadata", meta)
    return df.join(bucketed, "id")


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="shelfmark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["harvest", "packets", "score", "merge", "verify"])
    parser.add_argument("--input")
    parser.add_argument("--url", help="service to harvest")
    parser.add_argument("--params", default="{}", help="parameters of every request, as JSON")
    parser.add_argument("--collection", help="records are kept whose collection tags hold this name")
    parser.add_argument("--service", help="chat service that scores; by rules without one")
    parser.add_argument("--model", default="")
    parser.add_argument("--instructions", help="file that tells the service how to score")
    parser.add_argument("--chunk-size", type=int, default=100, help="packets given to a service at a time")
    parser.add_argument("--scores")
    parser.add_argument("--output")
    parser.add_argument("--run-id", default=None)
    parser.add_argument("--resume", help="folder of rows scored before; they are kept and not scored again")
    parser.add_argument("--flat", action="store_true", help="merge into a flattened file with provenance columns")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("shelfmark").getOrCreate()
    if given.command != "harvest" and not given.input:
        parser.error("--input is required")
    if given.service and not (given.instructions and os.environ.get("SCORER_API_KEY")):
        parser.error("a service needs --instructions and its key in SCORER_API_KEY")
    if given.command == "harvest":
        if not (given.url and given.collection):
            parser.error("harvest needs --url and --collection")
        _harvest(spark, given)
    elif given.command == "packets":
        sinks.write_lines(packets(_records(spark, given.input)), given.output)
    elif given.command == "score":
        now = time.time()
        run = given.run_id or f"run-{int(now)}"
        rows = spark.read.json(given.input)

        def score(df: DataFrame) -> DataFrame:
            return _by_service(df, given, run, now) if given.service else scored(df, run, now)

        sinks.write_lines(resumed(rows, spark.read.json(given.resume), score) if given.resume else score(rows), given.output)
    elif given.command == "merge":
        scores = last_per_key(_scored(spark, given.scores), "id", ["line_no"])
        if given.flat:
            sinks.write_flat(merged_text(_records(spark, given.input), scores), given.output)
        else:
            sinks.write_lines(merged(_records(spark, given.input), scores), given.output)
    else:
        records = _records(spark, given.input)
        report = quality.report(records.select("id", *SCORES), records.select("id", *SCORES), _scored(spark, given.scores))
        rows = report.orderBy("place").collect()  # six rows
        for r in rows:
            print(f"{'ok  ' if r['passed'] else 'FAIL'} {r['check']}: {r['detail']}, {r['warnings']} warnings")
        return 0 if rows[-1]["passed"] else 1
    back = spark.read.csv(given.output, header=True, escape='"', multiLine=True) if given.flat else spark.read.option("recursiveFileLookup", True).text(given.output)
    print(f"{given.command}: {back.count()} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
