"""Mixing sources to target weights (problem 8).

Method: soft-membership mixing.  A classifier fitted to the labelled rows
predicts for every document how likely it belongs to each source; the label of a
labelled document enters as a prior, ``LABEL_WEIGHT`` added to its log-odds.
Projected-gradient least squares then finds a nonnegative rate per document, at
most its repeat cap, so that the expected tokens of each source match the targets.

One scan of the texts writes the number of tokens and the hashed features of each
document; everything else reads that table.  The classifier is a multinomial
logistic regression on hashed words, signs and marks of a text's shape.  It is
fitted on a sample of about ``SAMPLE`` labelled rows, chosen by hash over all rows
of each source; its table is bounded by ``BUCKETS`` rows of one number per source.  All
documents are then given their posteriors in Arrow batches.

The gradient of a document's rate, scaled by its length, depends only on its
membership and cap.  Documents equal in both therefore share one rate, and the
iterations run over the table of such classes (memberships are rounded to 1/32),
never over the documents; a document's rate is the fold of the residuals over its
membership.  What reaches the driver per iteration is one number per source.  The
iterations end when no total moves; :class:`Fit` tells whether they did.

Rates become whole repeats document by document.  Within a source, documents are
drawn in the order of their hash over the missing part of their rate, large ones
first, until the tokens drawn are those the rates stand for; what a size class
lacks is made up by the next smaller one.  Only a histogram per source, and the
documents of the one bin where the drawing ends, are looked at in order.

Defined results: every document comes out once with its repeats, 0 included;
null, empty and unencodable text has no tokens and 0 repeats; a source without
a target gets 0 repeats; a target whose source does not occur reaches 0 and the
others share its part in proportion; with no size given, the mix is the largest
in which every occurring source can reach its share under its cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.encoding import token_count
from shelfmark.tables import written

#: Hash buckets of features: the bound of the classifier's table.
BUCKETS = 1 << 14
#: Labelled rows the classifier is fitted on, about.
SAMPLE = 20_000
#: What the label of a document adds to the log-odds of its source.
LABEL_WEIGHT = 10.0
#: Bins of the drawing order, over twice the range needed.
BINS = 4096
#: Steps of the projected gradient at most; it ends when no total moves.
STEPS = 200
#: Membership is rounded to this part.
PARTS = 32


@dataclass
class Fit:
    """The residuals of all steps, the size of the mix, and whether the totals
    came to rest within ``STEPS``."""

    history: list[list[float]]
    size: float
    converged: bool


def _features(text: Column) -> Column:
    """Hash buckets of the different words and signs of a text and of marks of
    its shape: the order of its length, of its number of lines and of their
    length, how it begins and ends, and how its lines begin, digits levelled."""

    def order(n: Column, times: int) -> Column:
        return F.floor(F.log2(n + 1) * times).cast("string")

    def levelled(x: Column) -> Column:
        return F.translate(x, "123456789", "000000000")

    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+|[^\s\p{L}\p{N}]|\n)"))
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    shape = F.array(
        F.concat(F.lit("#length "), order(F.length(text), 4)), F.concat(F.lit("#lines "), order(lines, 2)),
        F.concat(F.lit("#line "), order(F.length(text) / (lines + 1), 2)), F.concat(F.lit("#end "), levelled(F.right(F.rtrim(text), F.lit(6)))),
        F.concat(F.lit("#start "), levelled(F.substring(text, 1, 4))),
    )
    begins = F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("#begins "), levelled(F.substring(x, 1, 6))))
    hashed = F.transform(F.concat(words, shape, begins), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    return F.when(F.length(text) > 0, F.array_distinct(hashed)).otherwise(F.array().cast("array<int>"))


def measured(documents: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, features), written once."""
    rows = documents.select("doc_id", "source", token_count(F.col("text"), ranks).alias("n_tokens"), _features(F.col("text")).alias("features"))
    return written(rows, "mix-measured")


def _scores(table: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of scores per document; the last row of ``table`` is the prior."""
    out = np.zeros((len(sizes), table.shape[1]))
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(table[flat], starts[some], axis=0) / np.sqrt(sizes[some])[:, None]
    return out + table[-1]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_table(features: list[np.ndarray], labels: np.ndarray, n: int, rounds: int = 4, batch: int = 64, pace: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Multinomial logistic regression by adaptive gradient steps: one row per
    bucket and one for the prior.  Equal input gives an equal table."""
    table, seen = np.zeros((BUCKETS + 1, n)), np.full((BUCKETS + 1, n), 1e-3)
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        order = rng.permutation(len(features))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            sizes = np.array([len(features[i]) for i in chosen])
            flat = np.concatenate([features[i] for i in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            off = _softmax(_scores(table, flat, starts, sizes))
            off[np.arange(len(chosen)), labels[chosen]] -= 1
            each = np.repeat(off / np.sqrt(np.maximum(sizes, 1))[:, None], sizes, axis=0)
            ranked = np.argsort(flat, kind="stable")
            rows, first = np.unique(flat[ranked], return_index=True)
            slope = np.add.reduceat(each[ranked], first, axis=0) + decay * table[rows] if len(rows) else np.zeros((0, n))
            rows, slope = np.append(rows, BUCKETS).astype(int), np.vstack([slope, off.sum(axis=0)])
            seen[rows] += slope**2
            table[rows] -= pace * slope / np.sqrt(seen[rows])
    return table


def learn(known: DataFrame, sources: list[str], sample: int = SAMPLE) -> np.ndarray:
    """The classifier's table from about ``sample`` labelled rows of ``known``
    (:func:`measured`), as many of each source where it has them, spread over all
    its rows by hash.  The prior is put back to the shares of all labelled rows;
    a source without any gets none."""
    rows = known.where(F.col("source").isin(sources) & (F.size("features") > 0))
    counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}  # a row per target
    each = sample / max(len(counts), 1)
    limit = F.lit(0)
    for s, n in counts.items():
        limit = F.when(F.col("source") == s, F.lit(int((1 << 30) * min(1.0, each / n)))).otherwise(limit)
    got = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < limit).select("doc_id", "source", "features").toArrow()  # about ``sample`` rows
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    labels = np.array([sources.index(s) for s in got["source"].to_pylist()], dtype=int)
    lists = got["features"].to_pylist()
    table = fit_table([np.array(lists[i], dtype=int) for i in order], labels[order], len(sources))
    taken = np.bincount(labels, minlength=len(sources))
    every = np.array([counts.get(s, 0) for s in sources])
    table[-1] += np.log(np.maximum(every, 1) / np.maximum(taken, 1))
    table[-1, every == 0] = -1e9
    return table


def posteriors(known: DataFrame, table: np.ndarray, sources: list[str], label_weight: float = LABEL_WEIGHT) -> DataFrame:
    """``known`` (:func:`measured`) with the membership of each document, the
    probability of each source in parts of ``PARTS``, instead of its features.
    A source that is no target leaves no membership: zeros."""
    place = {s: k for k, s in enumerate(sources)}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            lists, given = b.column("features"), b.column("source").to_pylist()
            ends = lists.offsets.to_numpy()
            sizes, starts = np.diff(ends), ends[:-1] - ends[0]
            z = _scores(table, lists.flatten().to_numpy(), starts, sizes)
            for i, s in enumerate(given):
                if s in place:
                    z[i, place[s]] += label_weight
            parts = np.rint(_softmax(z) * PARTS).astype(np.int32) if len(z) else np.zeros((0, len(sources)), dtype=np.int32)
            parts[[i for i, s in enumerate(given) if s is not None and s not in place]] = 0
            member = pa.ListArray.from_arrays(np.arange(0, parts.size + 1, len(sources), dtype=np.int32), pa.array(parts.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("n_tokens"), member], ["doc_id", "source", "n_tokens", "membership"])

    kept = known.select("doc_id", "source", "n_tokens", "features")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "features")
    return kept.mapInArrow(run, f"{kinds}, membership array<int>")


def held_out_accuracy(documents: DataFrame, sources: list[str], ranks: str | None = None) -> DataFrame:
    """(n, right): labelled rows of one fifth, classified after the others."""
    fifth = F.pmod(F.xxhash64("text"), F.lit(5))  # copies fall on the same side
    known = measured(documents.where(F.col("source").isin(sources) & (F.trim("text") != "")), ranks)
    side = known.join(documents.select("doc_id", fifth.alias("fifth")), "doc_id")
    table = learn(side.where("fifth <> 0"), sources)
    best = F.array_position("membership", F.array_max("membership"))
    said = posteriors(side.where("fifth = 0"), table, sources, 0.0).select("source", F.element_at(F.array(*map(F.lit, sources)), best.cast("int")).alias("said"))
    return said.agg(F.count("*").alias("n"), F.count(F.when(F.col("said") == F.col("source"), 1)).alias("right"))


def _fold(history: list[list[float]], caps: list[float]) -> Column:
    """The rate after all steps, from the membership and the cap alone."""
    cap = F.aggregate(
        F.zip_with("membership", F.array(*[F.lit(float(c)) for c in caps]), lambda p, c: F.struct(p.alias("p"), c.alias("c"))),
        F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("c")),
        lambda best, x: F.when(x["p"] > best["p"], x).otherwise(best),
    )["c"]
    if not history:
        return F.lit(0.0)
    flat = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in history])

    def moved(rate: Column, step: Column) -> Column:
        slope = F.aggregate(F.zip_with("membership", step, lambda p, c: p * c), F.lit(0.0), lambda a, x: a + x) / PARTS
        return F.least(F.greatest(rate - slope, F.lit(0.0)), cap)

    return F.aggregate(flat, F.lit(0.0), moved)


def fitted(classes: DataFrame, targets: list[dict], size: float | None = None) -> Fit:
    """The rates that bring the expected tokens of each source to its target.

    ``classes`` has the tokens of every membership (membership, tokens);
    ``targets`` one dict per source (source, target_share, max_repeats), a list
    the caller bounds.
    """
    n = len(targets)
    caps = [float(t["max_repeats"]) for t in targets]

    def totals(rate: Column) -> list[float]:
        each = [F.sum(F.col("tokens") * rate * F.get("membership", F.lit(k)) / PARTS) for k in range(n)]
        return list(classes.agg(*[F.coalesce(s, F.lit(0.0)).alias(f"w{k}") for k, s in enumerate(each)]).first())

    have = totals(F.lit(1.0))
    shares = [t["target_share"] if have[k] > 0 else 0.0 for k, t in enumerate(targets)]
    whole = sum(shares) or 1.0
    shares = [s / whole for s in shares]
    if size is None:
        size = min((have[k] * caps[k] / shares[k] for k in range(n) if shares[k] > 0), default=0.0)
    history: list[list[float]] = []
    last: list[float] | None = None
    for _ in range(STEPS):
        got = totals(_fold(history, caps))
        if last is not None and all(math.isclose(a, b, rel_tol=1e-6, abs_tol=0.5) for a, b in zip(got, last)):
            return Fit(history, size, True)
        history.append([(got[k] - shares[k] * size) / have[k] if have[k] else 0.0 for k in range(n)])
        last = got
    return Fit(history, size, False)


def prepared(documents: DataFrame, targets: DataFrame, size: float | None = None, ranks: str | None = None) -> tuple[DataFrame, list[dict], Fit]:
    """The documents with their membership, the targets, and the fitted rates.

    ``targets`` is a list of sources made by hand, one class of the classifier
    each; more than 1,000 rows are refused, so reading it to the driver is bounded.
    """
    rows = [r.asDict() for r in targets.select("source", "target_share", "max_repeats").orderBy("source").limit(1001).collect()]
    if len(rows) > 1000:
        raise ValueError("more than 1,000 mixing targets")
    sources = [r["source"] for r in rows]
    known = measured(documents, ranks)
    soft = written(posteriors(known, learn(known, sources), sources), "mix-membership")
    classes = soft.where("n_tokens > 0").groupBy("membership").agg(F.sum("n_tokens").alias("tokens"))
    return soft, rows, fitted(written(classes, "mix-classes"), rows, size)


_DRAWN = "drawn_src string, drawn_size int, through int, rest double"


def _drawn(bins: pd.DataFrame) -> pd.DataFrame:
    """How far each size class of one source is drawn: all bins below
    ``through``, and ``rest`` tokens of that bin.  At most BINS rows a class."""
    out, lacking = [], 0.0
    for size, rows in sorted(bins.groupby("size"), key=lambda x: -x[0]):
        lacking += rows["aim"].sum()
        through, rest = BINS + 1, 0.0
        for b, tokens, count in sorted(zip(rows["bin"], rows["tokens"], rows["count"])):
            if tokens <= lacking:
                lacking -= tokens
                continue
            through = int(b)
            if count > 1 and lacking > 0:
                rest, lacking = lacking, 0.0
            elif lacking >= tokens / 2:
                rest, lacking = float(tokens), lacking - tokens
            break
        out.append((rows["src"].iloc[0], int(size), through, rest))
    return pd.DataFrame(out, columns=["drawn_src", "drawn_size", "through", "rest"])


def rounded(rated: DataFrame) -> DataFrame:
    """``rated`` (doc_id, source, n_tokens, rate) with whole repeats."""
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    more = F.col("rate") - F.floor("rate")
    rows = rated.select(
        "doc_id", "source", "n_tokens", "rate", more.alias("more"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"),
        F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int").alias("size"),
    ).withColumn("bin", F.when(F.col("more") > 0, F.least(F.floor(hashed / F.col("more") * (BINS / 2)), F.lit(BINS)).cast("int")))
    bins = rows.where("more > 0").groupBy("src", "size", "bin")
    bins = bins.agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("count"), F.sum(F.col("n_tokens") * F.col("more")).alias("aim"))
    drawn = written(bins.groupBy("src").applyInPandas(_drawn, _DRAWN), "mix-drawn")
    met = (F.col("src") == F.col("drawn_src")) & (F.col("size") == F.col("drawn_size"))
    placed = rows.join(F.broadcast(drawn), met, "left")  # a row per source and power of two of a length
    # Where the drawing ends, the documents of that bin are taken one by one.
    border = (F.col("bin") == F.col("through")) & (F.col("rest") > 0)
    before = F.sum("n_tokens").over(Window.partitionBy("src", "size").orderBy("bin", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    taken = placed.where(border).select("doc_id", (F.coalesce(before, F.lit(0)) + F.col("n_tokens") / 2 <= F.col("rest")).alias("taken"))
    extra = F.when(F.col("bin") < F.col("through"), 1).when(F.coalesce("taken", F.lit(False)), 1).otherwise(0)
    counted = placed.join(taken, "doc_id", "left").withColumn("extra", extra)
    return counted.select("doc_id", "source", "n_tokens", "rate", (F.floor("rate").cast("int") + F.col("extra")).alias("repeats"))


def mixed(documents: DataFrame, targets: DataFrame, size: float | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, rate, repeats) of every document."""
    if targets.isEmpty():
        return documents.select("doc_id", "source", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0.0).alias("rate"), F.lit(0).alias("repeats"))
    known, rows, fit = prepared(documents, targets, size, ranks)
    rate = F.when(F.col("n_tokens") > 0, _fold(fit.history, [float(r["max_repeats"]) for r in rows])).otherwise(0.0)
    return rounded(written(known.select("doc_id", "source", "n_tokens", rate.alias("rate")), "mix-rated"))


def fit_report(documents: DataFrame, targets: DataFrame, size: float | None = None, ranks: str | None = None) -> DataFrame:
    """(steps, converged, size): how the fit of the rates ended."""
    _, _, fit = prepared(documents, targets, size, ranks)
    return documents.sparkSession.createDataFrame([(len(fit.history), fit.converged, fit.size)], "steps int, converged boolean, size double")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, tokens, share, most_repeats)
    per target and per source without one."""
    used = mix.groupBy("source").agg(
        F.count(F.when(F.col("repeats") > 0, 1)).alias("n_docs"),
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"),
        F.max("repeats").alias("most_repeats"),
    )
    total = used.agg(F.sum("tokens").alias("all_tokens"))
    joined = targets.select("source", "target_share", "max_repeats").join(used, "source", "full_outer").crossJoin(F.broadcast(total))  # one row
    return joined.select(
        "source", "target_share", "max_repeats",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("share"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
