"""Scores and buckets: a deterministic scorer, and a seam for outside ones."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.vocabulary import BUCKETS, TINTS

#: Fallback of an outside scorer that fails on a packet.
FALLBACK_SCORE = 20
FALLBACK_REASON = "Scoring failed"


def bucket(score: Column) -> Column:
    """The bucket of a score; nothing is clamped, null falls in the last."""
    out = None
    for name, least in BUCKETS:
        if least is not None:
            out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
        else:
            out = out.otherwise(name)
    return out


def rule_score() -> Column:
    """The deterministic score of a packet: six rules, the first that holds."""
    seen = F.col("evidence_flags")
    kind = F.col("format_flags")
    tags = F.coalesce("domain_tags", F.array().cast("array<string>"))
    photography = F.array_contains(tags, "photography")
    visual = F.arrays_overlap(tags, F.array(F.lit("photography"), F.lit("art"), F.lit("urban")))
    return (
        F.when(seen["has_photographs"] & photography, 85)
        .when(seen["has_plates"] | seen["has_photographs"], 70)
        .when(kind["exhibition_catalog"] & photography, 65)
        .when(seen["has_illustrations"] & visual, 45)
        .when(kind["fiction"], 15)
        .otherwise(25)
    )


def provenance(run_id: str, timestamp: float, provider: str = "rules", model: str = "rules-1", prompt_version: str = "v1.0") -> Column:
    """Where a score comes from; run and time are parameters, so equal runs
    give equal rows."""
    return F.struct(
        F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"),
        F.lit(run_id).alias("run_id"), F.lit(float(timestamp)).alias("timestamp"),
    )


def scored(packets: DataFrame, run_id: str = "run", timestamp: float = 0.0) -> DataFrame:
    """Packets with score, bucket, reasoning and provenance, by the rules."""
    score = rule_score()
    return packets.withColumn("photo_insert_score", score).select(
        *packets.columns,
        "photo_insert_score",
        bucket(F.col("photo_insert_score")).alias("photo_insert_bucket"),
        F.concat(F.lit("Rule score "), F.col("photo_insert_score").cast("string")).alias("photo_insert_reasoning"),
        provenance(run_id, timestamp).alias("scoring_metadata"),
    )


def scored_outside(
    packets: DataFrame, scorer: Callable[[list[dict]], list[dict]], tries: int = 3, wait: Callable[[float], None] = time.sleep, batch: int = 100
) -> DataFrame:
    """(id, photo_insert_score, photo_insert_reasoning) from an outside scorer.

    ``scorer`` takes packets as dicts and returns dicts with ``likelihood`` and
    ``reasoning`` in the same order.  A batch that fails is tried again after a
    doubling wait of at most a minute; one that fails for good, or answers of
    the wrong form, get the fallback.  Scores are kept between 0 and 100.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for start in range(0, len(part), batch):
                rows = part.iloc[start : start + batch].to_dict("records")
                answers = _asked(scorer, rows, tries, wait)
                yield pd.DataFrame(
                    {
                        "id": [r["id"] for r in rows],
                        "photo_insert_score": [a[0] for a in answers],
                        "photo_insert_reasoning": [a[1] for a in answers],
                    }
                )

    return packets.mapInPandas(run, "id string, photo_insert_score int, photo_insert_reasoning string")


def _asked(scorer, rows: list[dict], tries: int, wait) -> list[tuple[int, str]]:
    for attempt in range(tries):
        try:
            answers = scorer(rows)
            if len(answers) != len(rows):
                raise ValueError("a scorer must answer every packet")
            return [(max(0, min(100, int(a["likelihood"]))), str(a.get("reasoning", ""))) for a in answers]
        except Exception:  # noqa: BLE001 - an outside service may fail in any way
            if attempt + 1 < tries:
                wait(min(60.0, 2.0 * 2**attempt))
    return [(FALLBACK_SCORE, FALLBACK_REASON)] * len(rows)


def prompt(packet: dict, instructions: str, schema: dict | None = None) -> str:
    """What a language service is asked about one packet: the ``instructions`` of
    the caller, the packet as JSON and the form of the answer."""
    form = schema or {"likelihood": "<integer 0-100>", "reasoning": "<2-4 short sentences>"}
    told = json.dumps(packet, indent=2, ensure_ascii=False, default=str)
    return f"{instructions.strip()}\n\nBook metadata:\n{told}\n\nAnswer with this JSON object only:\n{json.dumps(form, indent=2)}"


def answer_of(reply: dict) -> dict:
    """The answer in a chat reply: the content of its first choice, with or
    without a code fence around the JSON.  ValueError for a reply without choices,
    for no JSON and for an object that lacks ``likelihood`` or ``reasoning``."""
    choices = reply.get("choices") or []
    content = ((choices[0].get("message") or {}).get("content") or "").strip() if choices else ""
    fenced = re.search(r"```(?:json)?\s*(.*?)\s*(?:```|$)", content, re.S)
    found = json.loads(fenced[1] if fenced else content)
    if not isinstance(found, dict) or not {"likelihood", "reasoning"} <= found.keys():
        raise ValueError(f"an answer lacks its members: {found!r}")
    return {"likelihood": int(found["likelihood"]), "reasoning": str(found["reasoning"])}


@dataclass(frozen=True)
class ServiceScorer:
    """An outside scorer for :func:`scored_outside` that asks a chat service
    about each packet.

    ``post`` sends a body to the service and returns its reply (default: HTTP with
    ``key`` or the one in ``key_variable`` of the worker's environment).  A packet is tried
    again after a doubling wait of at most a minute; one that fails for good gets
    the fallback, the others of its batch keep their answers.
    """

    url: str
    model: str
    instructions: str
    system: str = "You judge catalogue records. Answer in JSON and nothing else."
    temperature: float = 0.3
    tries: int = 3
    pause: float = 0.5
    key: str | None = field(default=None, repr=False)
    key_variable: str = "SCORER_API_KEY"
    post: Callable[[dict], dict] | None = None
    wait: Callable[[float], None] = time.sleep

    def body(self, packet: dict) -> dict:
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt(packet, self.instructions)}]
        return {"model": self.model, "messages": messages, "temperature": self.temperature}

    def _sent(self, body: dict) -> dict:
        if self.post is not None:
            return self.post(body)
        headers = {"Authorization": f"Bearer {self.key or os.environ[self.key_variable]}", "Content-Type": "application/json"}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=30) as answer:
            return json.load(answer)

    def __call__(self, packets: list[dict]) -> list[dict]:
        out = []
        for packet in packets:
            found = {"likelihood": FALLBACK_SCORE, "reasoning": FALLBACK_REASON}
            for attempt in range(self.tries):
                try:
                    found = answer_of(self._sent(self.body(packet)))
                    break
                except Exception:  # noqa: BLE001 - an outside service may fail in any way
                    if attempt + 1 < self.tries:
                        self.wait(min(60.0, 2.0 * 2**attempt))
            out.append(found)
            self.wait(self.pause)
        return out


def tint(name: Column) -> Column:
    """Colour and opacity of a bucket's overlay; null for the last bucket."""
    out = F.lit(None).cast("string")
    for label, (color, opacity) in TINTS.items():
        out = F.when(name == label, F.lit(f"{color} {opacity}")).otherwise(out)
    return out
