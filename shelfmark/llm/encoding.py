"""Encoding of the whole corpus with a public tokenizer (problem 7).

Method: the tiktoken library with a local rank file.  Texts go to Python in
Arrow batches; each worker builds the encoder once.  Long texts are split where
no token can cross: before a single space between two characters that are no
white space.  Decoding joins the raw bytes of the tokens, since one token can
hold part of a character.

Defined results: null and empty text give an empty list; text that looks like a
special token is ordinary text; nothing is trimmed or cut, so decoding gives
back exactly the stored text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters after which a long text is split at the next safe boundary.
CHUNK = 20_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[tuple[str, str | None], object] = {}


def default_ranks() -> str:
    """The rank file of the public byte-level tokenizer installed here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(ranks: str, pattern: str | None = None):
    """The encoder of a rank file, built once per process."""
    if (ranks, pattern) not in _ENCODERS:
        import tiktoken

        if pattern is None:
            import public_tokenizers

            pattern_used = public_tokenizers.PATTERN
        else:
            pattern_used = pattern
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[ranks, pattern] = tiktoken.Encoding("local", pat_str=pattern_used, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[ranks, pattern]


def pieces(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """The text in pieces no token crosses; short texts are one piece."""
    start = 0
    while len(text) - start > chunk:
        cut = _SAFE.search(text, start + chunk)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, ranks: str, pattern: str | None = None) -> list[int]:
    if not text:
        return []
    own = encoder(ranks, pattern)
    if len(text) <= CHUNK:
        return own.encode_ordinary(text)
    return [i for piece in pieces(text) for i in own.encode_ordinary(piece)]


def decode(ids, ranks: str, pattern: str | None = None) -> bytes:
    """The raw bytes of a list of ids."""
    own = encoder(ranks, pattern)
    return b"".join(own.decode_single_token_bytes(int(i)) for i in ids)


def ids_of(text: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """The ids of a text as an array of integers."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        path = ranks or default_ranks()  # where the worker has it
        for batch in batches:
            yield pd.Series([encode(t, path, pattern) for t in batch], dtype=object)

    return run(text)


def token_count(text: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """The number of ids of a text; the ids stay in the worker."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        path = ranks or default_ranks()
        for batch in batches:
            yield pd.Series([len(encode(t, path, pattern)) for t in batch], dtype="int64")

    return run(text)


def bytes_of(ids: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """The raw bytes a list of ids stands for."""

    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        path = ranks or default_ranks()
        for batch in batches:
            yield pd.Series([None if x is None else decode(x, path, pattern) for x in batch], dtype=object)

    return run(ids)


def encoded(documents: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document."""
    return documents.select("doc_id", ids_of(F.col("text"), ranks).alias("ids"))


def round_trip(documents: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_ids, same): whether decoding gives back the stored text."""
    ids = documents.select("doc_id", "text", ids_of(F.col("text"), ranks).alias("ids"))
    back = bytes_of(F.col("ids"), ranks)
    stored = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return ids.select("doc_id", F.size("ids").alias("n_ids"), (back == stored).alias("same"))
