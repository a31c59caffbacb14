"""Clients of outside services against small local ones; seams that may fail."""

import json
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from shelfmark import tables
from shelfmark.functions import scoring
from shelfmark.operators import nested
from shelfmark.sources import harvest, sinks
from shelfmark.streaming import incremental


class Catalog(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        self.asked.append((asked, self.headers["User-Agent"]))
        offset, limit = int(asked["offset"]), int(asked["limit"])
        if "docs" in asked:
            docs = [{"pnx": {"control": {"recordid": ["r1"]}, "display": {"title": ["A title"], "lds07": ["Quay Library"]}}, "delivery": {"holding": [{"holKey": "h"}]}}]
            years = docs if "[1950 TO 1959]" in asked["multiFacets"] else []
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"docs": years[offset : offset + limit], "info": {"total": len(years)}}).encode())
            return
        years = [1950, 1951, 1959] if "[1950 TO 1959]" in asked["multiFacets"] else []
        body = json.dumps({"docs": [{"year": y} for y in years[offset : offset + limit]], "info": {"total": len(years)}}).encode()
        refused = len(self.asked) == 1
        self.send_response(403 if refused else 200)
        self.end_headers()
        if not refused:
            self.wfile.write(body)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        likely = 90 if "Photo album" in body["messages"][1]["content"] else 10
        said = json.dumps({"likelihood": likely, "reasoning": self.headers["Authorization"]})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": {"content": f"```json\n{said}\n```"}}]}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    Catalog.asked = []
    server = HTTPServer(("127.0.0.1", 0), Catalog)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/pages"
    server.shutdown()


def test_http_client(service):
    client = harvest.http_client({"url": service, "params": json.dumps({"tab": "All"}), "agent": "me/1"})
    waits = []
    got = list(harvest.documents(lambda o, n: client(1950, 1959, o, n), 2, waits.append))
    assert [d["year"] for _, _, d in got] == [1950, 1951, 1959] and waits == [60.0]
    assert all(a["tab"] == "All" and agent == "me/1" for a, agent in Catalog.asked) and [a["offset"] for a, _ in Catalog.asked] == ["0", "0", "2"]


def test_http_client_in_the_source(spark, service):
    Catalog.asked.append(None)  # no refusal
    spark.dataSource.register(harvest.HarvestSource)
    read = spark.read.format("harvest").option("client", "shelfmark.sources.harvest:http_client").option("url", service).option("limit", "2")
    assert read.load().groupBy("shard").count().collect() == [("1950s", 3)]
    assert {r["shard"]: r["position"] for r in read.option("mode", "totals").load().collect()}["1950s"] == 3


def test_command_line_against_services(spark, service, tmp_path, monkeypatch, capsys):
    from shelfmark.__main__ import main

    out = str(tmp_path / "index")
    for _ in range(2):  # the second run finds every range done
        assert main(["harvest", "--url", service, "--params", '{"docs": 1}', "--collection", "quay library", "--output", out]) == 0
    assert [(r["id"], r["title"], r["shard"]) for r in spark.read.json(out).collect()] == [("r1", "A title", "1950s")]
    assert capsys.readouterr().out.splitlines() == ["harvest: 1 rows"] * 2
    packets, scored, told = str(tmp_path / "p"), str(tmp_path / "s"), tmp_path / "told.txt"
    spark.createDataFrame([("a", "Photo album"), ("b", "Cookbook"), ("b", "Cookbook")], "id string, title string").write.json(packets)
    told.write_text("Score it.")
    monkeypatch.setenv("SCORER_API_KEY", "k1")
    monkeypatch.setattr("shelfmark.functions.scoring.ServiceScorer.pause", 0.0)
    made = main(["score", "--input", packets, "--output", scored, "--service", service, "--model", "m", "--instructions", str(told), "--chunk-size", "2", "--run-id", "r"])
    got = {r["id"]: (r["photo_insert_score"], r["photo_insert_bucket"], r["scoring_metadata"]["run_id"]) for r in spark.read.json(scored).collect()}
    assert made == 0 and got == {"a": (90, "Strongly Likely", "r"), "b": (10, "Unlikely", "r")}
    with pytest.raises(SystemExit):
        main(["score", "--output", scored])


def test_pages_of_a_table(spark, tmp_path):
    rows = [(i, f"id{i}", "1955" if i % 3 else "c1820?" if i % 2 else None) for i in range(50)]
    path = str(tmp_path / "pages")
    harvest.write_pages(spark.createDataFrame(rows, "ord bigint, id string, year string").withColumn("range", F.lit("clash")), path)
    client = harvest.paged_client({"table": path})
    wanted = [r for r in rows if r[2] == "1955"]
    assert client(1950, 1959, 7, 5) == {"docs": [{"ord": o, "id": i, "year": y} for o, i, y in wanted[7:12]], "info": {"total": len(wanted)}}
    assert client(1950, 1959, 999, 5)["docs"] == [] and client(2020, 2029, 0, 5) == {"docs": [], "info": {"total": 0}}


def reply(content):
    return {"choices": [{"message": {"content": content}}]}


def test_answers_of_a_chat_service():
    good = {"likelihood": 70, "reasoning": "so"}
    for text in ('{"likelihood": 70, "reasoning": "so"}', '```json\n{"likelihood": "70", "reasoning": "so"}\n```', 'Sure:\n```\n{"likelihood": 70.4, "reasoning": "so"}\n``` ok'):
        assert scoring.answer_of(reply(text)) == good
    for bad in ({}, {"choices": []}, reply("no json"), reply('{"likelihood": 1}'), reply("[1]"), reply(None)):
        with pytest.raises(ValueError):
            scoring.answer_of(bad)


def test_service_scorer(spark):
    asked, waits = [], []

    def post(body):
        asked.append(body)
        if '"id": "bad"' in body["messages"][1]["content"]:
            return {"choices": []}
        if len(asked) == 1:
            raise OSError
        return reply('```json\n{"likelihood": 400, "reasoning": "x"}\n```')

    own = scoring.ServiceScorer("u", "m", "Score it.", post=post, wait=waits.append)
    assert own([{"id": "a", "title": "Häfen"}, {"id": "bad"}]) == [{"likelihood": 400, "reasoning": "x"}, {"likelihood": 20, "reasoning": "Scoring failed"}]
    assert waits == [2.0, 0.5, 2.0, 4.0, 0.5] and asked[0]["model"] == "m" and "Häfen" in asked[0]["messages"][1]["content"] and asked[0]["messages"][1]["content"].startswith("Score it.")
    scorer = scoring.ServiceScorer("u", "m", "Score it.", post=lambda b: {"choices": [{"message": {"content": '{"likelihood": 400, "reasoning": "x"}'}}]}, wait=lambda s: None)
    got = scoring.scored_outside(spark.createDataFrame([("a",), (None,)], "id string"), scorer).collect()
    assert [tuple(r)[1:] for r in got] == [(100, "x")] * 2


def test_a_batch_tried_again_replaces_its_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    one.write.json(src)
    for k in range(2):  # the second run has lost its checkpoint: batch 0 comes again
        incremental.score_stream(spark, src, one.schema, out, str(tmp_path / f"ck{k}"), lambda df: df.withColumn("s", F.col("n") * 10))
    assert sorted((r["id"], r["s"]) for r in spark.read.parquet(out).collect()) == [("a", 10), ("b", 20)]


def test_a_table_that_cannot_be_replaced_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    with pytest.raises(Exception):
        sinks.replace_table(spark.range(5).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    sinks.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_first_entries(spark):
    df = spark.createDataFrame([(str(i), i, "A & B", None, None, None) for i in range(9)], "id string, ord int, title string, authors array<string>, year string, publishers array<string>")
    got = sinks.bibtex(df, 2, ["ord"]).collect()
    assert [r["id"] for r in got] == ["0", "1"] and "A \\& B" in got[0]["entry"] and sinks.bibtex(df).count() == 9


def test_what_nests_too_deep_is_reported(spark):
    deep = '{"callNumber": "TR 1"}'
    for k in range(6):
        deep = f"[{deep}]" if k % 2 else f'{{"holding": {deep}}}'
    rows = [(1, deep, "[]"), (2, '{"callNumber": "TR 1"}', f'[{{"holKey": "h", "items": {deep}}}]'), (3, None, '[[{"holKey": "h"}]]'), (4, "rubbish", ""), (5, None, deep)]
    df = spark.createDataFrame(rows, "ord int, best_location string, holdings string")
    assert sorted(r["ord"] for r in nested.unopened(df, ["ord"]).collect()) == [1, 2, 5]
    assert nested.unopened(df, ["ord"], 7).count() == 0 and nested.unopened(df.limit(0), ["ord"]).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"getConf": lambda self: Conf()})()

    with pytest.raises(ValueError):
        tables.shared_folder(Session())


def test_a_broken_subpackage_is_an_error(tmp_path):
    code = "import sys, types; sys.modules['shelfmark.llm'] = m = types.ModuleType('shelfmark.llm'); m.__path__ = [%r]; import __spark_entry__ as e; print(len(e.queries()) > 50)"
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "queries.py").write_text("import no_such_module")
    (tmp_path / "none").mkdir()
    run = [subprocess.run([sys.executable, "-c", code % str(tmp_path / d)], capture_output=True, text=True, timeout=120, cwd=tables.__file__.rsplit("/", 2)[0]) for d in ("broken", "none")]
    assert run[0].returncode != 0 and "no_such_module" in run[0].stderr and run[1].stdout.strip() == "True"
