"""Incremental runs: scoring what is new, debounced input, guarded shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.scoring import scored
from shelfmark.operators.merge import appended, not_in


def resumed(packets: DataFrame, done: DataFrame, scorer: Callable[[DataFrame], DataFrame] = scored) -> DataFrame:
    """All scored rows after scoring the packets that have no score yet; rows
    whose id has left the packets stay."""
    return appended(done, scorer(not_in(packets, done)))


def score_stream(
    spark: SparkSession, packets_dir: str, schema: T.StructType, out_dir: str, checkpoint: str, scorer: Callable[[DataFrame], DataFrame] = scored, files: int = 100
) -> None:
    """Score packet files that have arrived since the last run, then stop.

    Each micro-batch takes a bounded number of files and leaves out ids scored by
    the batches before it.  Its rows are the folder ``batch=number`` below
    ``out_dir``, so a batch that is tried again replaces its own rows; the
    checkpoint makes a second run do nothing.
    """

    def score(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        one = batch.dropDuplicates(["id"])
        at = session._jvm.org.apache.hadoop.fs.Path(out_dir)
        if at.getFileSystem(session._jsc.hadoopConfiguration()).exists(at):
            done = session.read.option("basePath", out_dir).schema("id string, batch bigint").parquet(out_dir)
            one = not_in(one, done.where(F.col("batch") != number))
        scorer(one).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(packets_dir)
    query = stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def bursts(events: DataFrame, user: str, at: str, value: str, gap: str) -> DataFrame:
    """(user, start, end, n, last): bursts of input separated by quiet of at
    least ``gap``; of each the last value counts.  Works on streams (with a
    watermark) as on tables."""
    window = F.session_window(at, gap)
    return (
        events.groupBy(user, window.alias("w"))
        .agg(F.count("*").alias("n"), F.max_by(value, F.struct(at, value)).alias("last"))
        .select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "last")
    )


def finished_shards(spark: SparkSession, out_dir: str, shards: list[str]) -> list[str]:
    """The shards not yet harvested: a shard is done when its folder holds the
    marker its write leaves behind."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    left = []
    for s in shards:
        marker = fs_path(f"{out_dir}/shard={s}/_SUCCESS")
        if not marker.getFileSystem(conf).exists(marker):
            left.append(s)
    return left


def _as_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def harvest_shards(
    spark: SparkSession, read: Callable[[str], DataFrame], out_dir: str, shards: list[str], write: Callable[[DataFrame, str], None] = _as_table
) -> list[str]:
    """Write every shard that is not done; a run broken off goes on where it
    stopped and earlier shards are kept.  Returns the shards written."""
    written = finished_shards(spark, out_dir, shards)
    for s in written:
        write(read(s), f"{out_dir}/shard={s}")
    return written
