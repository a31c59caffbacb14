"""Receipts: hash-verifiable exports of a selection.

The order of the items is part of the hash, so it is always given explicitly.
Names, schema tag and prefixes are parameters with neutral defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.canonical import canonical_json, canonical_object, canonical_strings, digest, quoted

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def payload(schema: str, created_at: Column, app: dict[str, str], dataset: dict[str, Column], mode: Column, items: Column, filters: Column) -> Column:
    """The canonical text a receipt's hash covers; ``filters`` is JSON text."""
    app_text = canonical_object({k: quoted(F.lit(v)) for k, v in app.items()})
    dataset_text = canonical_object({k: quoted(v) for k, v in dataset.items()})
    return canonical_object(
        {
            "schema": quoted(F.lit(schema)), "createdAt": quoted(created_at), "app": app_text, "dataset": dataset_text,
            "mode": quoted(mode), "items": canonical_strings(items), "filters": filters,
        }
    )


def receipt_id(hash_value: Column, prefix: str = "RC") -> Column:
    """Three groups of four characters taken from the hash, so that equal
    receipts have equal ids."""
    def character(i: int) -> Column:
        byte = F.conv(F.substring(hash_value, 2 * i + 1, 2), 16, 10).cast("int")
        return F.substring(F.lit(_ALPHABET), byte % 36 + 1, F.lit(1))

    groups = [F.concat(*[character(4 * g + k) for k in range(4)]) for g in range(3)]
    return F.concat_ws("-", F.lit(prefix), *groups)


def created(selections: DataFrame, created_at: str, index_hash: str = "not-computed", dataset_name: str = "catalog", version: str = "v1") -> DataFrame:
    """Receipts of selections (selection_id, mode, items, filters): their
    payload, hash, id and the whole receipt as JSON text."""
    text = payload(
        "receipt@1", F.lit(created_at), {"name": "catalog-browser", "channel": "main", "version": version},
        {"name": F.lit(dataset_name), "indexHash": F.lit(index_hash)}, F.col("mode"), F.col("items"), F.coalesce("filters", F.lit("{}")),
    )
    rows = selections.withColumn("payload", text).withColumn("hash_value", digest(F.col("payload"))).withColumn("receipt_id", receipt_id(F.col("hash_value")))
    tail = F.concat(F.lit(',"hash":{"alg":"sha256","value":'), quoted(F.col("hash_value")), F.lit('},"receiptId":'), quoted(F.col("receipt_id")), F.lit("}"))
    return rows.withColumn("receipt", F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), tail))


def verified(receipts: DataFrame, column: str = "receipt") -> DataFrame:
    """Adds valid, reason, computed_hash and provided_hash to receipts given as
    JSON text: the hash is taken off, the rest hashed again and compared."""
    stripped = canonical_json(_without(F.col(column)))
    rows = receipts.withColumn("provided_hash", F.get_json_object(column, "$.hash.value")).withColumn("computed_hash", digest(stripped))
    missing = F.coalesce("provided_hash", F.lit("")) == ""
    valid = ~missing & F.coalesce(F.col("computed_hash") == F.col("provided_hash"), F.lit(False))
    reason = F.when(missing, "Missing hash").when(valid, "Hash verified").otherwise("Hash mismatch")
    return rows.select(*receipts.columns, valid.alias("valid"), reason.alias("reason"), "computed_hash", "provided_hash")


def _without(text: Column) -> Column:
    """The receipt's members but for hash and receiptId, as JSON text."""
    members = F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: ~k.isin("hash", "receiptId"))
    plain = F.transform(
        F.map_entries(members),
        lambda e: F.concat(
            quoted(e["key"]),
            F.lit(":"),
            F.when(e["value"].isNull(), "null").when(e["value"].rlike(r"^\s*[\[{]"), e["value"]).otherwise(quoted(e["value"])),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(plain, ","), F.lit("}"))


def to_fragment(text: Column) -> Column:
    """Base64 for URLs, without padding and line breaks."""
    plain = F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def from_fragment(fragment: Column) -> Column:
    """The text of a fragment, with or without its ``#r=``; null if it is none."""
    bare = F.regexp_replace(fragment, "^#r=", "")
    standard = F.translate(bare, "-_", "+/")
    padded = F.concat(standard, F.repeat(F.lit("="), F.pmod(-F.length(standard), F.lit(4))))
    return F.when(bare.rlike("^[A-Za-z0-9_-]+$"), F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))


def file_name(mode: Column, rid: Column, prefix: str = "receipt") -> Column:
    return F.concat(F.concat_ws("-", F.lit(prefix), mode, rid), F.lit(".json"))


def share_url(fragment: Column, origin: str = "https://catalog.example/") -> Column:
    """The link a QR image would carry; drawing it is left to a client."""
    return F.concat(F.lit(f"{origin}#r="), fragment)


def card(rid: Column, mode: Column, created_at: Column, items: Column, dataset: Column, hash_value: Column, fragment: Column) -> Column:
    """A receipt as a short text of seven lines and the link to verify it."""
    lines = [
        F.lit("Digital receipt"), F.concat(F.lit("Receipt ID: "), rid), F.concat(F.lit("Mode: "), mode),
        F.concat(F.lit("Created: "), created_at), F.concat(F.lit("Items: "), F.size(items).cast("string")),
        F.concat(F.lit("Dataset: "), dataset), F.concat(F.lit("Hash: "), F.substring(hash_value, 1, 16), F.lit("...")),
        F.lit(""), F.concat(F.lit("Verify at: "), share_url(fragment)),
    ]
    return F.concat_ws("\n", *lines)


def item_report(receipts: DataFrame, records: DataFrame) -> DataFrame:
    """(receipt_id, place, id, found): the items of receipts in order, and
    whether the current records still hold them."""
    listed = receipts.select("receipt_id", F.posexplode("items").alias("place", "id"))
    have = records.select("id").where(F.col("id").isNotNull()).distinct().withColumn("_have", F.lit(True))
    return listed.join(have, "id", "left").select("receipt_id", "place", "id", F.coalesce("_have", F.lit(False)).alias("found"))
