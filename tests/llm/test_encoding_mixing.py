"""Round trips of the encoder and shares of the mix."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import encoding as E
from shelfmark.llm import mixing as M

RANKS = E.default_ranks()


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_round_trip(text):
    assert E.decode(E.encode(text, RANKS), RANKS) == text.encode()


@given(st.text(alphabet="a 1.'s\n\té港", max_size=200), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_split_changes_nothing(text, chunk):
    whole = E.encoder(RANKS).encode_ordinary(text)
    assert [i for p in E.pieces(text, chunk) for i in E.encoder(RANKS).encode_ordinary(p)] == whole
    assert "".join(E.pieces(text, chunk)) == text


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|>"), (5, "word " * 30_000), (6, "x" * 60_000), (6, "é퟿🙂")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = E.encoded(df).collect()
    assert [r["ids"] for r in got if r["doc_id"] in (1, 2)] == [[], []] and len(got) == 7
    assert len(next(r["ids"] for r in got if r["doc_id"] == 4)) > 1
    assert all(r["same"] for r in E.round_trip(df).collect())
    assert E.encoded(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def documents(spark):
    words = {"a": "alpha apple amber", "b": "beta bronze bay", "c": "gamma gold gate"}
    rows = [(i, words[s] + f" {i}", s) for i, s in enumerate(["a"] * 300 + ["b"] * 100 + ["c"] * 20)]
    rows += [(1000, "alpha amber", None), (1001, None, "a"), (1002, "", None), (1003, "zzz", "unknown"), (1004, "zzz", "unknown")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("rate", F.lit("clash"))


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("a", 0.4, 2), ("b", 0.4, 4), ("c", 0.1, 3), ("d", 0.1, 9)], "source string, target_share double, max_repeats int")


def test_shares_are_met(documents, targets):
    mix = M.mixed(documents, targets)
    rows = {r["doc_id"]: r for r in mix.collect()}
    assert len(rows) == documents.count()
    assert rows[1001]["repeats"] == rows[1002]["repeats"] == rows[1003]["repeats"] == 0
    got = {r["source"]: r for r in M.shares(mix, targets).collect()}
    for s, share, most in (("a", 0.4, 2), ("b", 0.4, 4), ("c", 0.1, 3)):
        assert abs(got[s]["share"] - share / 0.9) < 0.02 and got[s]["most_repeats"] <= most
    assert got["d"]["share"] == 0 and got["d"]["n_docs"] == 0 and got["unknown"]["tokens"] == 0


def test_classifier(documents, targets):
    n, right = M.held_out_accuracy(documents, ["a", "b", "c"]).first()
    assert n > 40 and right >= 0.95 * n
    known, rows, fit = M.prepared(documents, targets)
    member = {r["doc_id"]: r["membership"] for r in known.collect()}
    assert [r["source"] for r in rows] == ["a", "b", "c", "d"] and fit.converged
    assert max(member[1000]) == member[1000][0] > 0  # no label: by its words
    assert member[0][0] >= 31 and member[1003] == [0, 0, 0, 0]  # the label is a prior; "unknown" is no target
    assert M.fit_report(documents, targets).first()["converged"]


def test_labels_are_a_prior_only(documents):
    known = M.measured(documents)
    table = M.learn(known, ["a", "b", "c"])
    free = {r["doc_id"]: r["membership"] for r in M.posteriors(known, table, ["a", "b", "c"], 0.0).collect()}
    wrong = known.withColumn("source", F.when(F.col("doc_id") == 0, "b").otherwise(F.col("source")))
    weak = {r["doc_id"]: r["membership"] for r in M.posteriors(wrong, table, ["a", "b", "c"], 1.0).collect()}
    strong = {r["doc_id"]: r["membership"] for r in M.posteriors(wrong, table, ["a", "b", "c"], 50.0).collect()}
    assert all((max(m) > 0) == (i not in (1003, 1004)) for i, m in free.items()) and free[0][0] >= weak[0][0] > strong[0][0] == 0


def test_few_long_documents_are_rounded_one_by_one(spark):
    rows = [(i, "s", 4000, 0.6) for i in range(5)] + [(10 + i, "s", 100, 0.6) for i in range(40)] + [(100, None, 7, 0.0), (101, "t", 9, 2.0), (102, "t", 9, 2.0)]
    got = {r["doc_id"]: r["repeats"] for r in M.rounded(spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, rate double")).collect()}
    drawn = sum(n * got[i] for i, s, n, _ in rows if s == "s")
    assert abs(drawn - 0.6 * (5 * 4000 + 40 * 100)) <= 100 and (got[100], got[101], got[102]) == (0, 2, 2)


def test_copies_of_one_document_fill_one_bin(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("bigint").alias("n_tokens"), F.lit(0.3).alias("rate"))
    assert abs(M.rounded(df).agg(F.sum("repeats")).first()[0] - 6000) <= 1


def test_nothing(documents, targets):
    assert M.mixed(documents.limit(0), targets).count() == 0
    assert {r["repeats"] for r in M.mixed(documents, targets.limit(0)).collect()} == {0}
