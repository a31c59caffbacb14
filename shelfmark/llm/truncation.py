"""Text cut off by field limits (problem 9).

Method: a vocabulary trie of the corpus, combined with length evidence.  Three
things speak for truncation, and a text needs one of them:

``trie``      The last word is not known, but a node of the trie: a proper prefix
              of known words.  Every proper prefix of a known word is a node.
``sentence``  The same one level up.  The last sentence begins as known sentences
              begin (its first two words, digits levelled), and those go on to
              another end: fewer than one in twenty end in a letter, a digit or
              whatever this text ends in.  A rare beginning is judged with all
              sentences that follow another one in their line.  Where lines that
              begin so go on to a number, one below that of the line before is
              a number cut off.
``limit``     The text has a length at which texts of its source pile up, most of
              them without an end, and does not end as such lines usually do.

A broken character or entity at the end (``broken``) is a trie node of its own:
the proper prefix of a code.  Dots, three or one character, that a limit put
there stand at it or, where the cut falls back to the end of a word, a little
below; dots as a manner of speaking follow the same words after different text,
at any length.

Words are counted over whole texts with the last word of each text left out, so
copies of a cut text do not teach the vocabulary the cut word; last sentences
are counted once each, however many copies there are.  Only texts without a full
stop are looked at closer, in salted joins, so an end shared by a third of all
texts is spread over the tasks.  All counts are exact.

Defined results: null, empty and blank texts are not truncated; white space
after the end is ignored; a text at a field limit that ends like a sentence is
complete; a null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.tables import written

_BLANK = " \t\r\n\u00a0\u2003\u2009\u3000\u200b\ufeff"
_STOPS = ".!?。！？…"
_CLOSERS = "\"'”’»“)]）」』"
_DOTS = r"(?:\.{3,}|…+)$"
#: The dots and the last three words before them, in a text turned round: found at once.
_DOTTED_END = r"^((?:\.{3,}|…+) ?[\p{L}\p{M}]+(?:[^\p{L}\p{M}]+[\p{L}\p{M}]+){0,2})"
#: Abbreviations after which a sentence goes on.
_SHORT = r"(?:nos?|pp|vols?|figs?|ca|ed|eds|cf)\."
_ABBREVIATED = rf"(?:^|[^\p{{L}}]){_SHORT}$"
#: Marks the first sentence of a line, stands for all that are none, parts sentences.
_FIRST, _AFTER, _PART = "\u0001", "\u0002", "\u0003"
#: What a sentence ends with inside a line: a stop before a space, or a full-width stop.
_INNER_END = (
    rf"([.!?…][\"'”’»“)\]]{{0,3}})(?<![^\p{{L}}]{_SHORT})(?=[^\S\n]+[^\s{_PART}])"
    rf"|([。！？][”’」』）]{{0,3}})(?![”’」』）\n{_PART}]|$)"
)
#: Letters down to which the trie is laid out.
DEEP = 12
#: Parts over which the rows of one key are spread.
SALTS = 16
#: So many characters before a field limit a cut falls back, at most, to the end of a word.
BACK = 20
#: An end is unlike the others if fewer than one in so many end so.
UNLIKE = 20
#: Known sentences a beginning needs to be judged by.
KNOWN = 5
#: Different ends a pile of lengths needs, and how far it rises above the mean of the lengths around it.
ENDS, RISE, AROUND = 3, 8, 10
#: One in so many of the ends of a pile, and two of them at least, bear a mark of their own.
MARKED = 4


def _without(text: Column, chars: str) -> Column:
    """``text`` without such characters at its end; most have none, and taking
    them off reads the whole text."""
    return F.when(F.right(text, F.lit(1)).isin(*chars), F.rtrim(text, F.lit(chars))).otherwise(text)


def text_ends(documents: DataFrame) -> DataFrame:
    """(doc_id, source, src, n_chars, n_bytes, kind, core): how every text ends
    (stop, dots, open, none) and the whole text of those without a stop."""
    core = _without(F.col("text"), _BLANK)
    rows = documents.select("doc_id", "source", "text", core.alias("core"))
    dotted = F.col("core").endswith("...") | F.col("core").endswith("…")
    last = F.right(_without(F.col("core"), _CLOSERS), F.lit(1))
    stop = last.isin(*_STOPS) & ~F.right("core", F.lit(6)).rlike(_ABBREVIATED)
    kind = F.when(F.coalesce(F.col("core"), F.lit("")) == "", "none").when(dotted, "dots").when(stop, "stop").otherwise("open")
    rows = rows.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"),
        F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), kind.alias("kind"), "core",
    )
    return rows.withColumn("core", F.when(F.col("kind").isin("dots", "open"), F.col("core")))


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n) over all texts, each without its last word."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([\p{L}\p{M}]+)"))
    but_last = F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0)))
    # An outer explode: a plain one would have the words looked for once more in a filter below.
    rows = documents.select(words.alias("words")).select(F.explode_outer(but_last).alias("word")).where("word IS NOT NULL")
    return rows.groupBy("word").agg(F.count("*").alias("n"))


def trie(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(word): the words of ``asked`` that are nodes of the trie, proper prefixes
    of known words.

    Nodes down to ``DEEP`` letters are met one by one, and those nobody asks for
    dropped as they arise; deeper ones are compared with the words below their
    ancestor at that depth, so a word of any length costs no more than that."""
    cuts = F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(DEEP)))
    prefixes = F.transform(cuts, lambda k: F.substring(F.col("word"), F.lit(1), k))
    nodes = words.where(F.length("word") > 1).select(F.explode_outer(prefixes).alias("word"))
    shallow = nodes.join(asked, "word", "left_semi").distinct()
    deep = asked.where(F.length("word") > DEEP).withColumn("head", F.substring("word", 1, DEEP))
    below = words.where(F.length("word") > DEEP).select(F.substring("word", 1, DEEP).alias("top"), F.col("word").alias("longer"))
    under = (F.col("head") == F.col("top")) & (F.length("longer") > F.length("word")) & F.startswith(F.col("longer"), F.col("word"))
    return shallow.unionByName(deep.join(below, under, "left_semi").select("word"))


def _sentences(core: Column) -> Column:
    """The sentences of a text, the first of each line marked."""
    lined = F.concat(F.lit(_FIRST), F.replace(core, F.lit("\n"), F.lit(f"\n{_PART}{_FIRST}")))
    return F.split(F.regexp_replace(lined, _INNER_END, f"$1$2{_PART}"), _PART)


def _begins(sentence: Column, words: int) -> Column:
    """Its first words with the signs around them, digits levelled."""
    found = F.regexp_extract(sentence, rf"^({_FIRST}?(?:[^\p{{L}}\p{{N}}{_FIRST}]*[\p{{L}}\p{{M}}\p{{N}}]+){{1,{words}}})", 1)
    return F.translate(found, "123456789", "000000000")


def _ends_in(sentence: Column) -> Column:
    """stop, digit, letter or other."""
    bare = _without(sentence, _BLANK + _FIRST)
    last = F.right(_without(bare, _CLOSERS), F.lit(1))
    own = F.right(bare, F.lit(1))
    return F.when(last.isin(*_STOPS), "stop").when(own.rlike(r"\p{N}"), "digit").when(own.rlike(r"[\p{L}\p{M}]"), "letter").otherwise("other")


def beginnings(documents: DataFrame) -> DataFrame:
    """(begin, n, n_stop, n_digit, n_letter, n_other): sentences by their first
    two words, by their first word, and (an empty beginning) all that follow
    another one in their line.  The last sentence of a text counts once per
    sentence before it, however many copies of the text there are."""
    core = _without(F.col("text"), _BLANK)
    rows = documents.where(F.length("text") > 0).select(_sentences(core).alias("all"))
    ending = F.xxhash64(F.slice("all", -F.least(F.size("all"), F.lit(2)), F.lit(2)))
    rows = rows.select(F.size("all").alias("size"), ending.alias("ending"), F.posexplode_outer("all").alias("at", "sentence")).where("sentence IS NOT NULL")
    rows = rows.select(
        F.when(F.col("at") == F.col("size") - 1, F.col("ending")).alias("last"), F.col("sentence").startswith(_FIRST).alias("first"),
        _begins(F.col("sentence"), 2).alias("two"), _ends_in(F.col("sentence")).alias("ends"),
    )
    # One scan: all rows of an inner sentence fall together here, the last ones by what they end with.
    counted = rows.groupBy("first", "two", "ends", "last").agg(F.count("*").alias("n"))
    once = F.when(F.col("last").isNull(), F.col("n")).otherwise(1)
    counted = counted.groupBy("first", "two", "ends").agg(F.sum(once).alias("n")).withColumn("one", _begins(F.col("two"), 1))
    every = F.array_distinct(F.array_compact(F.array("two", "one", F.when(~F.col("first"), F.lit(_AFTER)))))
    return (
        counted.select("ends", "n", F.explode(every).alias("begin"))
        .groupBy("begin")
        .agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("ends") == e, F.col("n")).otherwise(0)).alias(f"n_{e}") for e in ("stop", "digit", "letter", "other")])
    )


def limits(ends: DataFrame, marks: DataFrame) -> DataFrame:
    """(src, unit, length, kind, n, n_kind, n_ends): lengths at which the texts
    of a source pile up, at least half of them without a stop in the same way
    (``kind``: dots or open) after ``ENDS`` different endings or more.  Without
    dots, one in ``MARKED`` of these (two at least) bears marks of its own: a
    field limit cuts words and sentences anywhere.  A pile is ``RISE`` times the mean of the lengths around it.

    ``ends`` has the lengths of all texts; ``marks`` those without a stop and
    whether each is ``marked`` already."""
    sizes = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(c).alias("length")) for u, c in (("chars", "n_chars"), ("bytes", "n_bytes"))])
    long = F.col("n_chars") > 20
    counted = ends.where(long).select("src", F.inline(sizes)).groupBy("src", "unit", "length").agg(F.count("*").alias("n"))
    asked = marks.where(long).select("src", "kind", F.right("core", F.lit(25)).alias("end"), "marked", F.inline(sizes)).groupBy("src", "unit", "length", "kind", "end")
    asked = asked.agg(F.count("*").alias("n"), F.max(F.col("marked").cast("int")).alias("marked")).groupBy("src", "unit", "length", "kind")
    asked = asked.agg(F.count("*").alias("n_ends"), F.sum("n").alias("n_kind"), F.sum("marked").alias("n_marked"))
    marked = (F.col("n_marked") * MARKED >= F.col("n_ends")) & (F.col("n_marked") >= 2)
    asked = asked.where((F.col("n_ends") >= ENDS) & ((F.col("kind") == "dots") | marked))
    near = asked.select("src", "unit", "kind", F.col("length").alias("at"), F.explode(F.sequence(F.col("length") - AROUND, F.col("length") + AROUND)).alias("length"), "n_ends", "n_kind")
    here = F.col("length") == F.col("at")
    return (
        near.join(counted, ["src", "unit", "length"])
        .groupBy("src", "unit", F.col("at").alias("length"), "kind", "n_ends", "n_kind")
        .agg(F.sum(F.when(here, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(here, 0).otherwise(F.col("n"))).alias("beside"))
        .where((F.col("n_kind") * 2 >= F.col("n")) & (F.col("n") * 2 * AROUND >= RISE * F.col("beside")))
        .drop("beside")
    )


def _salted(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to a table unique in ``key``, hot keys spread."""
    spread = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return spread.join(copies, [key, "salt"], "left").drop("salt")


def _before_end() -> Column:
    """What stands before the last three words of a dotted text."""
    return F.right(F.expr("substring(core, 1, length(core) - length(dotted_end))"), F.lit(40))


def _last_number(line: Column) -> Column:
    """The number a line ends with, or null."""
    return F.regexp_extract(F.rtrim(line), r"([0-9]{1,9})$", 1).try_cast("bigint")


def _suspects(ends: DataFrame) -> DataFrame:
    """The texts without a stop, with the parts of their ends."""
    core, line = F.col("core"), F.substring_index("core", "\n", -1)
    lines = F.split("core", "\n")
    undotted = F.when(F.col("kind") == "dots", F.regexp_replace(core, f" ?{_DOTS}", "")).otherwise(core)
    rows = ends.where(F.col("kind").isin("dots", "open") & ~line.rlike(r"^[\[(（].*[\])）]$"))
    sentence = F.element_at(_sentences(core), -1)
    rows = rows.select(
        "*", F.reverse(F.regexp_extract(F.reverse(undotted), r"^([\p{L}\p{M}]+)", 1)).alias("last_word"), sentence.alias("sentence"),
        (_last_number(line) < _last_number(F.get(lines, F.size(lines) - 2))).alias("falls"),
    )
    return rows.withColumns(
        {
            "begin": _begins(F.col("sentence"), 2), "begin_one": _begins(F.col("sentence"), 1), "ends": F.replace(_ends_in(F.col("sentence")), F.lit("stop"), F.lit("other")),
            "first": F.col("sentence").startswith(_FIRST), "words": F.size(F.regexp_extract_all("sentence", F.lit(r"([\p{L}\p{N}]+)"))),
        }
    )


def evidence(documents: DataFrame) -> DataFrame:
    """What speaks for truncation, for every text without a stop at its end:
    (doc_id, source, kind, last_word, sentence, broken, inside_word, unlike,
    usual, at_limit, evidence, truncated), ``evidence`` naming the first of
    broken, trie, sentence and limit that holds."""
    ends = written(text_ends(documents), "text-ends")
    suspects = written(_suspects(ends), "text-suspects")
    words = written(vocabulary(documents), "vocabulary")
    asked = suspects.select(F.col("last_word").alias("word")).where(F.length("word") > 1).distinct()
    known = asked.join(words, "word", "left_semi").select("word", F.lit(True).alias("known"))
    nodes = trie(words, asked).withColumn("node", F.lit(True))
    table = asked.join(known, "word", "left").join(nodes, "word", "left").withColumnRenamed("word", "last_word")
    looked_up = _salted(suspects, table, "last_word")

    begun = suspects.select(F.explode(F.array("begin", "begin_one", F.lit(_AFTER))).alias("begin")).distinct()
    begun = written(beginnings(documents).join(begun, "begin", "left_semi"), "text-beginnings")
    counts = ["n", "n_stop", "n_digit", "n_letter", "n_other"]
    looked_up = _salted(looked_up, begun.select("begin", F.struct(*counts).alias("two")), "begin")
    looked_up = _salted(looked_up, begun.select(F.col("begin").alias("begin_one"), F.struct(*counts).alias("one")), "begin_one")
    after = begun.where(F.col("begin") == _AFTER).select(F.struct(*counts).alias("after")).agg(F.max("after").alias("after"))
    looked_up = looked_up.crossJoin(F.broadcast(after))  # one row

    def share(node: str) -> Column:
        mine = F.lit(None)
        for e in ("digit", "letter", "other"):
            mine = F.when(F.col("ends") == e, F.col(f"{node}.n_{e}")).otherwise(mine)
        return F.when(F.col(f"{node}.n") > 1, (mine - 1) / (F.col(f"{node}.n") - 1))  # the text itself does not count

    def true(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    two_known, one_known = F.col("two.n") > KNOWN, F.col("one.n") > KNOWN
    own = F.when(two_known, share("two")).when(one_known, share("one"))
    own = F.when((F.col("words") == 1) & (F.length("last_word") == 1), None).otherwise(own)
    node = F.when(two_known, F.col("two")).when(one_known, F.col("one"))
    numbered = F.coalesce(node["n_digit"] * 2 >= node["n"], F.lit(False))
    # A line of few words may be a name that a known sentence begins with as well, but no line of a list that goes on to a number.
    enough = F.when(F.col("first") & ~numbered, F.when(two_known, F.col("words") > 2).otherwise(F.col("words") > 3)).otherwise(True)
    unlike = F.when(F.col("first"), own * UNLIKE < 1).otherwise(F.coalesce(own, share("after")) * UNLIKE < 1) & enough
    unlike = true(unlike) | (numbered & true(F.col("falls")))
    usual = (own >= 0.5) & ~true(F.col("falls"))
    broken = F.col("core").endswith("�") | F.col("core").rlike(r"&(?:#x?[0-9A-Fa-f]{0,6}|[A-Za-z][A-Za-z0-9]{0,7}|)$")
    inside = true(F.col("node")) & ~true(F.col("known"))
    dotted = F.col("kind") == "dots"
    marks = looked_up.select(
        "doc_id", "source", "src", "n_chars", "n_bytes", "kind", "core", "last_word", "sentence", broken.alias("broken"), inside.alias("inside_word"),
        (~dotted & unlike).alias("unlike"), true(usual).alias("usual"),
        F.when(dotted, F.reverse(F.regexp_extract(F.reverse("core"), _DOTTED_END, 1))).alias("dotted_end"),
    )
    marks = written(marks.withColumn("marked", F.col("broken") | F.col("inside_word") | F.col("unlike")), "text-marks")

    piles = written(limits(ends, marks), "text-limits")
    rows = marks
    for unit in ("chars", "bytes"):
        back = F.when(F.col("kind") == "dots", BACK).otherwise(0)
        full = piles.where(F.col("unit") == unit).select("src", "kind", F.explode(F.sequence(F.col("length") - back, F.col("length"))).alias(f"n_{unit}"))
        rows = rows.join(full.distinct().withColumn(f"full_{unit}", F.lit(True)), ["src", "kind", f"n_{unit}"], "left")
    rows = rows.withColumn("at_limit", F.coalesce("full_chars", "full_bytes", F.lit(False)))
    said = (
        rows.where("dotted_end <> '' AND NOT at_limit")
        .groupBy("dotted_end")
        .agg(F.min(_before_end()).alias("a"), F.max(_before_end()).alias("b"))
        .where(F.col("a") != F.col("b"))
        .select("dotted_end", F.lit(True).alias("said"))
    )
    rows = _salted(rows, said, "dotted_end")
    named = (
        F.when(F.col("broken"), "broken")
        .when(dotted & true(F.col("said")), None)
        .when(F.col("inside_word"), "trie")
        .when(F.col("unlike"), "sentence")
        .when(F.col("at_limit") & (dotted | ~F.col("usual")), "limit")
    )
    rows = rows.select("doc_id", "source", "kind", "last_word", "sentence", "broken", "inside_word", "unlike", "usual", "at_limit", named.alias("evidence"))
    return rows.withColumn("truncated", F.col("evidence").isNotNull())


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id) of every document whose text breaks off before its end."""
    return evidence(documents).where("truncated").select("doc_id")


def rates(documents: DataFrame) -> DataFrame:
    """(source, n_docs, n_truncated, share) of every source."""
    cut = evidence(documents).where("truncated").groupBy("source").agg(F.count("*").alias("n_truncated"))
    every = documents.groupBy("source").agg(F.count("*").alias("n_docs"))
    found = F.coalesce(F.col("c.n_truncated"), F.lit(0))
    return (
        every.alias("e")
        .join(cut.alias("c"), F.col("e.source").eqNullSafe(F.col("c.source")), "left")
        .select("e.source", "n_docs", found.alias("n_truncated"), F.round(found / F.col("n_docs"), 6).alias("share"))
    )
