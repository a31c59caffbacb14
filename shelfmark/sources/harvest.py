"""A paged catalogue service as a Spark data source.

One input partition per publication range keeps each request series below the
service's offset cap; the pages of a range are fetched inside its task.  The
client that talks to the service is named by an import path, so executors build
their own and tests use one that reads a table.

Usage: ``spark.dataSource.register(HarvestSource)`` and
``spark.read.format("harvest").option("client", "package.module:factory")``.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.functions.vocabulary import SHARDS
from shelfmark.operators.shelf import positioned

#: Pages asked for at a time, tries per page, longest wait after a refusal.
LIMIT, TRIES, LONGEST_WAIT = 50, 3, 900.0


class Refused(Exception):
    """The service asks for a pause (for example HTTP 403)."""


class Shard(InputPartition):
    def __init__(self, label: str, first: int, last: int):
        super().__init__((label, first, last))
        self.label, self.first, self.last = label, first, last


def built(path: str, options: dict):
    """The client a factory named ``module:function`` builds from options."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)(options)


def fetched(page: Callable[[int, int], dict], offset: int, limit: int, wait: Callable[[float], None], tries: int = TRIES) -> dict:
    """One page; refusals wait longer each time, all failures are bounded."""
    refusals = failures = 0
    while True:
        try:
            return page(offset, limit)
        except Refused:
            refusals += 1
            if refusals >= 5 * tries:
                raise
            wait(min(LONGEST_WAIT, 60.0 * refusals))
        except Exception:
            failures += 1
            if failures >= tries:
                raise
            wait(float(failures))


def documents(page: Callable[[int, int], dict], limit: int = LIMIT, wait: Callable[[float], None] = time.sleep, empties: int = 3) -> Iterator[tuple[int, int, dict]]:
    """(offset, position, document) until the stated total is reached or
    several pages in a row are empty."""
    offset = empty = 0
    while True:
        answer = fetched(page, offset, limit, wait)
        docs = answer.get("docs") or []
        for i, doc in enumerate(docs):
            yield offset, i, doc
        empty = 0 if docs else empty + 1
        if docs:
            offset += limit
        total = int((answer.get("info") or {}).get("total") or 0)
        if offset >= total or empty >= empties:
            return
        if not docs:
            wait(1.0)


class HarvestReader(DataSourceReader):
    """Option ``shards`` names the ranges to fetch, all by default."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        only = [x for x in (self.options.get("shards") or "").split(",") if x]
        return [Shard(*s) for s in SHARDS if not only or s[0] in only]

    def read(self, partition: Shard):
        client = built(self.options["client"], dict(self.options))

        def page(offset: int, limit: int) -> dict:
            return client(partition.first, partition.last, offset, limit)

        limit = int(self.options.get("limit", LIMIT))
        if self.options.get("mode") == "totals":
            total = int((fetched(page, 0, 1, time.sleep).get("info") or {}).get("total") or 0)
            yield (partition.label, 0, total, None)
            return
        for offset, i, doc in documents(page, limit):
            yield (partition.label, offset, i, json.dumps(doc, ensure_ascii=False))


class HarvestSource(DataSource):
    """Rows of (shard, offset, position, document as JSON text); with
    ``mode=totals`` one row per shard, its hits in ``position``."""

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return "shard string, offset int, position int, document string"

    def reader(self, schema):
        return HarvestReader(self.options)


def http_client(options: dict):
    """A client of a paged JSON service.

    Options: ``url``; ``params``, a JSON object of parameters sent with every
    request; ``facet``, the parameter that names the range, and ``range``, the form
    of its value (``{first}`` and ``{last}`` are filled in); ``agent``; ``timeout``
    in seconds.  Pages are asked for with ``offset`` and ``limit``; a 403 or 429
    counts as a refusal, every other failure as one to be tried again.
    """
    fixed = json.loads(options.get("params") or "{}")
    facet, form = options.get("facet", "multiFacets"), options.get("range", "facet_searchcreationdate,include,[{first} TO {last}]")

    def page(first: int, last: int, offset: int, limit: int) -> dict:
        asked = {**fixed, "offset": str(offset), "limit": str(limit), facet: form.format(first=first, last=last)}
        headers = {"User-Agent": options.get("agent", "shelfmark"), "Accept": "application/json"}
        request = urllib.request.Request(f"{options['url']}?{urllib.parse.urlencode(asked)}", headers=headers)
        try:
            with urllib.request.urlopen(request, timeout=float(options.get("timeout", 60))) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code in (403, 429):
                raise Refused(str(e)) from e
            raise

    return page


def write_pages(index: DataFrame, path: str) -> None:
    """A table laid out for :func:`paged_client`: one folder per publication
    range, its rows numbered in harvest order and sorted by number, so that a page
    is a few row groups."""
    digits = F.regexp_extract(F.coalesce("year", F.lit("")), r"(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)", 1).try_cast("int")
    label = F.lit(None).cast("string")
    for name, first, last in SHARDS:
        label = F.when(digits.between(first, last), name).otherwise(label)
    rows = index.select("ord", "id", "year", label.alias("range")).where(F.col("range").isNotNull())
    placed = positioned(rows, "range", ["ord"]).withColumn("place", F.col("position") - 1).drop("position")
    placed = placed.repartitionByRange("range", "place").sortWithinPartitions("range", "place")
    placed.write.partitionBy("range").option("parquet.block.size", 1 << 20).parquet(path)


def paged_client(options: dict):
    """A client that serves a table laid out by :func:`write_pages`: a page reads
    the row groups that hold its numbers, the total comes from their footers."""
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    where = options["table"] if "://" in options["table"] or options["table"].startswith("file:") else f"file://{options['table']}"
    fs, root = pafs.FileSystem.from_uri(where)
    labels = {(first, last): name for name, first, last in SHARDS}
    held: dict[str, tuple] = {}

    def opened(label: str) -> tuple:
        if label not in held:
            folder = f"{root}/range={label}"
            there = fs.get_file_info(folder).type == pafs.FileType.Directory
            data = ds.dataset(folder, filesystem=fs, format="parquet") if there else None
            held[label] = (data, data.count_rows() if data else 0)
        return held[label]

    def page(first: int, last: int, offset: int, limit: int) -> dict:
        data, total = opened(labels[first, last])
        if data is None:
            return {"docs": [], "info": {"total": 0}}
        wanted = (ds.field("place") >= offset) & (ds.field("place") < offset + limit)
        rows = data.to_table(filter=wanted, columns=["place", "ord", "id", "year"]).sort_by("place").drop_columns(["place"])
        return {"docs": rows.to_pylist(), "info": {"total": total}}

    return page


def table_client(options: dict):
    """A client for tests that serves a small Parquet table as it is: it holds
    the hits of a range.  See :func:`paged_client` for tables of any size."""
    import pyarrow.dataset as ds

    data = ds.dataset(options["table"])
    held: dict[tuple[int, int], list[dict]] = {}  # the hits of a range, looked up once for all its pages

    def hits_of(first: int, last: int) -> list[dict]:
        if (first, last) not in held:
            rows = [r for b in data.to_batches(columns=["ord", "id", "year"]) for r in b.to_pylist() if (y := _year(r["year"])) is not None and first <= y <= last]
            held[first, last] = sorted(rows, key=lambda r: r["ord"])
        return held[first, last]

    def page(first: int, last: int, offset: int, limit: int) -> dict:
        hits = hits_of(first, last)
        return {"docs": hits[offset : offset + limit], "info": {"total": len(hits)}}

    return page


def _year(text: str | None) -> int | None:
    digits = "".join(c if c.isdigit() and c.isascii() else " " for c in text or "").split()
    return next((int(d) for d in digits if len(d) == 4), None)
