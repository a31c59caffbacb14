"""Files the catalogue goes to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.sources.files import LIST_MARK


def flattened(df: DataFrame) -> DataFrame:
    """Every column as text: lists joined by their mark, structs and lists of
    structs as JSON, null as ''.  Decided by the schema, not by the rows."""

    def one(f: T.StructField) -> Column:
        c, kind = F.col(f.name), f.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            out = F.array_join(c, LIST_MARK)
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            out = F.to_json(c)
        else:
            out = c.cast("string")
        return F.coalesce(out, F.lit("")).alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def write_flat(df: DataFrame, path: str) -> None:
    """A flattened file with a header; quotes are doubled, line breaks and the
    spaces around a value kept."""
    flattened(df).write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue="", quoteAll=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; nulls are written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def array_lines(df: DataFrame) -> DataFrame:
    """The rows as the lines of one JSON array, in the order of ``df``."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_array(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON array in one file, for clients that need it whole.

    The rows are sorted across the cluster and written by partition; only the
    last step streams them through one task, one line at a time.  It is an
    export for collections of a browsable size; tables are the native sink.
    """
    lines = array_lines(df.orderBy(*order)).coalesce(1)

    def bracketed(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            texts = [("" if first and i == 0 else ",") + x for i, x in enumerate(batch.column(0).to_pylist())]
            if first:
                texts = ["[", *texts]
                first = False
            yield pa.RecordBatch.from_pydict({"value": texts})
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})

    whole = df.sparkSession.range(1).select(F.lit("[]").alias("value")) if df.isEmpty() else lines.mapInArrow(bracketed, "value string")
    whole.write.mode("overwrite").text(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a Parquet table to a new folder, then put it in the old one's
    place: a table may be replaced by rows read from itself, and a failed write
    leaves it as it was.  Between the two renames the table is away for a moment;
    if the second fails, the old one is put back."""
    spark = df.sparkSession
    fresh, gone = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(path_of(path))
    if had and not fs.rename(path_of(path), path_of(gone)):
        fs.delete(path_of(fresh), True)
        raise OSError(f"{path} cannot be moved away")
    if not fs.rename(path_of(fresh), path_of(path)):
        if had:
            fs.rename(path_of(gone), path_of(path))
        raise OSError(f"{fresh} cannot be moved to {path}")
    fs.delete(path_of(gone), True)


def bibtex(df: DataFrame, first: int | None = None, order: list[str] | None = None) -> DataFrame:
    """(id, entry): records as BibTeX, special characters escaped; all of them,
    or the ``first`` in an ``order`` that is total."""
    if first is not None:
        df = df.orderBy(*(order or ["id"])).limit(first)

    def safe(c: Column) -> Column:
        return F.regexp_replace(F.coalesce(c, F.lit("")), r"([&%$#_{}])", r"\\$1")

    authors = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<string>")), safe), " and ")
    entry = F.concat(
        F.lit("@book{"), F.col("id"), F.lit(",\n  title = {"), safe(F.col("title")), F.lit("},\n  author = {"), authors,
        F.lit("},\n  year = {"), safe(F.col("year")), F.lit("},\n  publisher = {"), safe(F.get("publishers", F.lit(0))), F.lit("}\n}"),
    )
    return df.select("id", entry.alias("entry"))


def manifest(inputs: DataFrame, outputs: DataFrame, counts: dict[str, int], run_id: str, seconds: float) -> DataFrame:
    """One row describing a run: files with their digests, counts, run time.

    ``inputs`` and ``outputs`` come from ``files.file_digests``.
    """
    listed = F.sort_array(F.collect_list(F.struct("path", "length", "sha256")))
    a = inputs.agg(listed.alias("inputs"))
    b = outputs.agg(listed.alias("outputs"))
    numbers = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(int(v)))]) if counts else F.create_map().cast("map<string,int>")
    return a.crossJoin(b).select(F.lit(run_id).alias("run_id"), "inputs", "outputs", numbers.alias("counts"), F.lit(float(seconds)).alias("seconds"))  # one row each
