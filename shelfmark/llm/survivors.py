"""Best representative of each duplicate group (problem 4).

Method: field-by-field survivorship.  One aggregation takes, per attribute, the
maximum of a composite struct (non-null, source priority, timestamp, value).
Maxima combine on the map side: a group holding a third of all rows arrives at
its final task as one partial row per upstream task, so no group is ever
collected.

What says nothing is known from two sides.  Stock values and the openings of some
placeholder sentences are fixed seeds.  The texts put in place of a description are
read off the corpus too (:func:`stock_texts`): the same text stands under several
different titles, and no record with a text of its own ever uses its first
sentence.  A sentence that merely recurs is part of longer, single texts as well.

Defined results: a null or blank group key belongs to no group; a group needs
two distinct ids; ties go to the smaller ``ord``; a group no row of which says
anything about a field gets null for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.folding import bare, folded
from shelfmark.tables import written

#: What may be missing, and how catalogues say that it is.
_THING = (
    "author|title|uniform title|date|year|publisher|place|place of publication|description|summary|subject|name|call number|isbn"
)
_MISSING = (
    "unknown|not set|not named|not given|not identified|not known|not available|not recorded|not supplied|not stated|"
    "pending|to follow|to be assigned|to be added|to be supplied|to come"
)
_STOCK = (
    r"^(?:n/?a|none|none given|nil|unknown|anon|anonymous|untitled|undated|unclassified|n\.? ?d|s\.? ?a|s\.? ?n|s\.? ?l|n\.? ?p|"
    r"tbd|tbc|tba|x+|0+|in process|still to come|see printed inventory|"
    rf"(?:{_MISSING})|(?:{_THING})s? (?:{_MISSING})|no (?:{_THING})s?(?: (?:available|given|known|set|yet))?)$"
)
#: Different titles a text stands under at least before it may be a stock text.
TITLES = 3
#: Words of the opening of a sentence.
OPENING = 5
#: Fixed values, seeds: openings of sentences put in place of a description still to come.
_PLACEHOLDER = (
    r"^(?:summary not yet supplied|placeholder entry|brief record (?:until|as part|and awaits|pending)|"
    r"text removed during migration|this record was created automatically)\b"
)


EDGES, UNSEEN, SPACES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{AD}]", r"[\s\x{A0}\p{Zs}]+"


def says_something(text: Column) -> Column:
    """Whether a value is neither blank nor a stock value for a missing one."""
    core = F.regexp_replace(folded(text), EDGES, "")
    core = F.regexp_replace(F.regexp_replace(core, UNSEEN, ""), SPACES, " ")
    return F.coalesce((core != "") & ~core.rlike(_STOCK), F.lit(False))


def list_says_something(items: Column) -> Column:
    return F.coalesce(F.exists(items, says_something), F.lit(False))


def year_says_something(year: Column) -> Column:
    return F.coalesce(year.rlike(r"\d"), F.lit(False))


def description_says_something(description: Column, title: Column, seeds: str | None = _PLACEHOLDER) -> Column:
    """Not blank, no stock value, no seeded placeholder, not only the title again."""
    d, t = bare(description), bare(title)
    again = F.coalesce((t != "") & (F.replace(d, t, F.lit("")) == ""), F.lit(False))
    held = F.coalesce(F.trim(folded(description)).rlike(seeds), F.lit(False)) if seeds else F.lit(False)
    return says_something(description) & ~again & ~held


def _hashed(text: Column) -> Column:
    """A text as two numbers, shuffled in its place."""
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def openings(text: Column) -> Column:
    """How the sentences of a text begin: ``OPENING`` words each, digits levelled."""
    found = F.regexp_extract_all(F.translate(text, "123456789", "000000000"), F.lit(r"([^.!?。！？]+[.!?。！？]*)"))
    return F.transform(found, lambda x: F.array_join(F.slice(F.split(F.trim(x), " "), 1, OPENING), " "))


def _text_marks(text: Column, title: Column, when: Column) -> list[Column]:
    """The hashes of a text, its title and its openings, null where not ``when``."""
    parts = F.transform(openings(text), _hashed)
    return [F.when(when & text.isNotNull(), c).alias(n) for n, c in (("text", _hashed(text)), ("text_title", F.xxhash64(title)), ("parts", parts))]


def _stock(rows: DataFrame) -> DataFrame:
    """:func:`stock_texts` of a written table of (text, text_title, parts)."""
    rows = rows.where(F.col("text").isNotNull()).select("text", "text_title", "parts", F.get("parts", F.lit(0)).alias("first"))
    titles = rows.groupBy("text", "first", "text_title").agg(F.lit(1).alias("one")).groupBy("text", "first").agg(F.count("*").alias("titles"))
    titles = written(titles, "survivors-titles")
    asked = titles.where(F.col("titles") >= TITLES)
    single = titles.where("titles = 1").select("text")
    used = rows.select("text", F.explode_outer("parts").alias("part")).join(asked.select(F.col("first").alias("part")).distinct(), "part", "left_semi")
    live = used.join(single, "text", "left_semi").select(F.col("part").alias("first")).distinct()
    return asked.join(live, "first", "left_anti").select(F.col("text").alias("stock"))


def stock_texts(told: DataFrame, text: str = "text", title: str = "title") -> DataFrame:
    """(stock), the hashes of texts that ``TITLES`` different titles share and
    that begin as no sentence does of a text standing under one title only.
    ``told`` has one row per record that tells something, texts folded."""
    return _stock(written(told.select(*_text_marks(F.col(text), F.col(title), F.lit(True))), "survivors-texts"))


#: The fields counted, with the rule that tells whether each is filled.
COMPLETENESS = {
    "title": says_something,
    "uniform_title": says_something,
    "authors": list_says_something,
    "year": year_says_something,
    "publishers": list_says_something,
    "places": list_says_something,
    "subjects": list_says_something,
    "description": None,
    "call_number": says_something,
    "isbns": list_says_something,
}


def filled(field: str, seeds: str | None = _PLACEHOLDER) -> Column:
    rule = COMPLETENESS[field]
    return rule(F.col(field)) if rule else description_says_something(F.col("description"), F.col("title"), seeds)


def survivors(
    df: DataFrame, group: str = "frbr_group_id", priority: dict[str, int] | None = None, seeds: str | None = _PLACEHOLDER, values: bool = True
) -> DataFrame:
    """One row per group: the surviving id, the id whose description is kept,
    and per field the value kept (``best``), all from one aggregation.

    ``priority`` ranks values of ``source_system`` (higher is more trusted);
    systems not named rank 0.  ``seeds`` is a pattern of known placeholders;
    without it only the corpus tells.  ``values`` says whether the values kept are
    wanted besides the ids.  The texts are read once: what is known of each row is
    written and read twice, for the placeholders and for the groups.
    """
    ranked = F.lit(0)
    for system, rank in (priority or {}).items():
        ranked = F.when(F.col("source_system") == system, F.lit(rank)).otherwise(ranked)
    marked = df.select(
        F.col(group).alias("_group"), "id", "harvested_at", *(COMPLETENESS if values else []), (-F.col("ord")).alias("early"), ranked.alias("rank"),
        *[filled(f, seeds).alias(f"has_{f}") for f in COMPLETENESS], F.trim(folded(F.col("description"))).alias("_text"), F.coalesce(bare(F.col("title")), F.lit("")).alias("_title"),
    )
    marked = marked.select("*", *_text_marks(F.col("_text"), F.col("_title"), F.col("has_description"))).drop("_text", "_title")
    marked = written(marked, "survivors-marked")
    rows = marked.where(F.trim(F.coalesce("_group", F.lit(""))) != "").drop("text_title", "parts").withColumnRenamed("text", "stock")
    rows = rows.join(_stock(marked).withColumn("is_stock", F.lit(True)), "stock", "left").drop("stock")
    rows = rows.withColumn("has_description", F.col("has_description") & F.col("is_stock").isNull()).withColumnRenamed("_group", group)
    score = sum((F.col(f"has_{f}").cast("int") for f in COMPLETENESS), F.lit(0))
    whole = F.max(F.struct(score.alias("score"), "harvested_at", "early", "id"))
    said = F.max(F.when(F.col("has_description"), F.struct("harvested_at", "early", "id")))
    kept = [
        F.max(F.when(F.col(f"has_{f}"), F.struct("rank", "harvested_at", "early", F.col(f).alias("value"))))["value"].alias(f"best_{f}")
        for f in (COMPLETENESS if values else [])
    ]
    return (
        rows.groupBy(group)
        .agg(F.min("id").alias("least"), F.max("id").alias("most"), whole.alias("whole"), said.alias("told"), *kept)
        .where("least <> most")
        .select(
            group,
            F.col("whole.id").alias("id"),
            F.coalesce(F.col("told.id"), F.lit("")).alias("description_id"),
            *[f"best_{f}" for f in (COMPLETENESS if values else [])],
        )
    )
