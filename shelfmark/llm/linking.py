"""Free-entered values mapped to a canonical list (problem 2).

Method: a multi-pattern automaton over the canonical names and their aliases
finds embedded mentions; the longest mentions that do not overlap win.  A
mention counts if what stands around it is noise (brackets, "and elsewhere",
a country, a year).  The remaining values go to token-set similarity: every
word of the entry must meet a word of the value (equal, one edit apart, or its
initial) and no other word may be left over.

The list is read once to the driver, refused above ``MOST_ENTRIES`` rows, and
sent to the workers with the function; the values themselves never move.  Each
worker keeps the answers to the values it saw last.

Defined results: an entry that is a canonical name character for character is
itself; null and blank entries are left out; an entry that names no listed
thing, or several with nothing to tell them apart, gets -1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.consistent import skeleton
from shelfmark.llm.edits import deletions, distance

MOST_ENTRIES = 100_000
_FLAT = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe"})
_TOKEN = re.compile(r"[^\W_]+")


def flat(text: str) -> str:
    """Lower-case letters without accents; other characters unchanged."""
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFKD", skeleton(text).translate(_FLAT))
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


@dataclass(frozen=True)
class Rules:
    """How values of one kind are typed; all fixed values.

    ``kinds`` are words that tell what sort of thing a name is, by spelling;
    ``optional`` kinds may be left out; ``noise`` words mean nothing; ``short``
    are abbreviations of the first word of a name.
    """

    noise: frozenset[str] = frozenset()
    kinds: dict[str, tuple[str, ...]] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()
    short: dict[str, tuple[str, ...]] = field(default_factory=dict)
    place_before: bool = False

    def key(self) -> tuple:
        """What tells these rules from others."""
        tables = [tuple(sorted(t.items())) for t in (self.kinds, self.short)]
        return (tuple(sorted(self.noise)), *tables, tuple(sorted(self.optional)), self.place_before)


PLACES = Rules(
    noise=frozenset("in city of the town and elsewhere etc i e near at usw others".split()),
    short={
        "n": ("north", "new"), "no": ("north",), "nw": ("new",), "s": ("south", "saint"), "ft": ("fort",), "pt": ("port",),
        "st": ("saint",), "mt": ("mount",), "up": ("upper",), "upr": ("upper",), "u": ("upper",), "l": ("lower",),
    },
)
FIRMS = Rules(
    noise=frozenset("the les le la of and und et y e co inc ltd llc gmbh ag sa cie hrsg publ pub publisher publishers company in for & bei".split()),
    kinds={
        "university": ("university",), "univ": ("university",), "uni": ("university",), "u": ("university",),
        "up": ("university", "press"), "press": ("press",), "pr": ("press",),
        "books": ("books",), "bks": ("books",), "book": ("books",),
        "editions": ("editions",), "edition": ("editions",), "ed": ("editions",), "eds": ("editions",), "edns": ("editions",),
        "verlag": ("verlag",), "verl": ("verlag",), "vlg": ("verlag",),
        "galerie": ("galerie",), "gallery": ("galerie",), "gal": ("galerie",),
        "museum": ("museum",), "mus": ("museum",),
    },
    optional=frozenset({"press", "books"}),
    place_before=True,
)


@dataclass(frozen=True)
class Entry:
    ref: int
    name: str
    aliases: tuple[str, ...] = ()
    context: str = ""


class Gazetteer:
    """A canonical list, ready to be asked what a typed value means."""

    def __init__(self, entries: list[Entry], rules: Rules):
        import ahocorasick

        self.rules = rules
        self.entries = entries
        self.contexts = sorted({flat(e.context) for e in entries if e.context})
        self.by_name: dict[str, list[int]] = {}
        self.cores: list[tuple[tuple[str, ...], frozenset[str], int]] = []
        self.near: dict[str, set[str]] = {}
        self.with_word: dict[str, set[int]] = {}
        self.initials: dict[str, set[int]] = {}
        self.kind_near: dict[str, set[str]] = {}
        for spelling in rules.kinds:
            if len(spelling) >= 5:
                for d in deletions(spelling):
                    self.kind_near.setdefault(d, set()).add(spelling)
        self.automaton = ahocorasick.Automaton()
        for at, e in enumerate(entries):
            for name in (e.name, *e.aliases):
                tokens = self.tokens(name)
                key = " ".join(tokens)
                if not key:
                    continue
                self.by_name.setdefault(key, []).append(at)
                core, kinds = self.split(tokens, exact=True)
                number = len(self.cores)
                self.cores.append((core, kinds, at))
                for word in core:
                    self.with_word.setdefault(word, set()).add(number)
                    for d in deletions(word):
                        self.near.setdefault(d, set()).add(word)
        for key in self.by_name:
            self.automaton.add_word(f" {key} ", key)
        if self.by_name:
            self.automaton.make_automaton()
        self.answer = lru_cache(maxsize=200_000)(self._answer)

    def tokens(self, text: str) -> list[str]:
        return _TOKEN.findall(flat(text))

    def split(self, tokens: list[str], exact: bool = False) -> tuple[tuple[str, ...], frozenset[str]]:
        """The words that make a name and the kinds of thing it may be."""
        core: list[str] = []
        kinds: set[str] = set()
        for t in tokens:
            if t in self.rules.kinds:
                kinds.update(self.rules.kinds[t])
            elif t in self.rules.noise:
                continue
            elif not exact and t not in self.with_word and (meant := self._kind_meant(t)):
                kinds.update(self.rules.kinds[meant])
            else:
                core.append(t)
        return tuple(core), frozenset(kinds)

    def _kind_meant(self, word: str) -> str | None:
        if len(word) < 4:
            return None
        near = {k for d in deletions(word) for k in self.kind_near.get(d, ()) if distance(word, k, 1) <= 1}
        return min(near) if near else None

    def _context_of(self, words: list[str]) -> str | None:
        """The country meant by the words around a name: spelt out, one edit
        off, or abbreviated (its letters in order, the first one included)."""
        joined = "".join(words)
        if not joined:
            return None
        for c in self.contexts:
            if distance(joined, c.replace(" ", ""), 1) <= 1:
                return c
        found = [c for c in self.contexts if c[0] == joined[0] and _is_within(joined, c.replace(" ", ""))]
        return found[0] if len(found) == 1 and len(joined) >= 2 else None

    def _chosen(self, at: list[int], around: list[str]) -> int | None:
        """The one entry meant, given the words left over; None if those words
        mean something else."""
        left = [w for w in around if w not in self.rules.noise and not w.isdigit()]
        if left:
            context = self._context_of(left)
            if context is None:
                return None
            fitting = {self.entries[i].ref for i in at if flat(self.entries[i].context) == context}
            return fitting.pop() if len(fitting) == 1 else None
        refs = {self.entries[i].ref for i in at}
        return refs.pop() if len(refs) == 1 else None

    def _mentions(self, tokens: list[str]) -> list[tuple[int, int, str]]:
        """Longest mentions that do not overlap: (first, after, name)."""
        if not self.by_name or not tokens:
            return []
        text = f" {' '.join(tokens)} "
        starts = {}
        at = 0
        for i, t in enumerate(tokens):
            starts[at] = i
            at += len(t) + 1
        found = []
        for end, key in self.automaton.iter(text):
            begin = end - len(key) - 1
            if begin in starts:
                found.append((starts[begin], starts[begin] + key.count(" ") + 1, key))
        taken: list[tuple[int, int, str]] = []
        for m in sorted(found, key=lambda m: (m[0] - m[1], m[0])):
            if all(m[1] <= t[0] or m[0] >= t[1] for t in taken):
                taken.append(m)
        return sorted(taken)

    def _by_mention(self, tokens: list[str]) -> int | None:
        mentions = self._mentions(tokens)
        if not mentions:
            return None
        inside = {i for a, b, _ in mentions for i in range(a, b)}
        around = [t for i, t in enumerate(tokens) if i not in inside]
        if self.rules.kinds:
            around = [t for t in around if t not in self.rules.noise and not _is_date(t)]
        chosen = {self._chosen(self.by_name[key], around) for _, _, key in mentions}
        return chosen.pop() if len(chosen) == 1 else None

    def _by_similarity(self, tokens: list[str]) -> int | None:
        words = [t for t in tokens if not _is_date(t)]
        core, kinds = self.split(words)
        if not core:
            return None
        near: dict[str, dict[str, int]] = {}
        for w in core:
            hits = {w: 0} if w in self.with_word else {}
            if len(w) >= 3:
                for d in deletions(w):
                    for other in self.near.get(d, ()):
                        if other not in hits and len(other) >= 3 and (k := distance(w, other, 1)) <= 1:
                            hits[other] = k
            near[w] = hits
        numbers = {n for hits in near.values() for h in hits for n in self.with_word[h]}
        best: list[tuple[int, int]] = []
        for n in numbers:
            name, own_kinds, at = self.cores[n]
            if not kinds <= own_kinds or (own_kinds - kinds) - self.rules.optional and kinds:
                continue
            if own_kinds and not kinds and not own_kinds <= self.rules.optional:
                continue
            left, edits, solid = list(core), 0, False
            for w in name:
                hits = [(near[t].get(w), t) for t in left if near[t].get(w) is not None]
                hits += [(0, t) for t in left if len(t) == 1 and t == w[0] and len(name) > 1]
                if not hits:
                    break
                k, t = min(hits)
                left.remove(t)
                edits += k
                solid = solid or len(t) >= 3
            else:
                if solid and edits <= (2 if sum(map(len, name)) >= 16 else 1):
                    left = [t for t in left if not (len(t) <= 3 and any(distance(t, x, 1) <= 1 for x in ("of", "the", "and", "und", "les")))] if self.rules.kinds else left
                    ref = self._chosen([at], left)
                    if ref is not None:
                        best.append((edits + (len(own_kinds - kinds) > 0), ref))
        if not best:
            return self._by_first_word(core, kinds)
        least = min(k for k, _ in best)
        refs = {r for k, r in best if k == least}
        return refs.pop() if len(refs) == 1 else None

    def _by_first_word(self, core: tuple[str, ...], kinds: frozenset[str]) -> int | None:
        """A name cut down to its first word and its kind, if only one entry
        begins so."""
        if len(core) != 1 or not kinds or kinds <= self.rules.optional:
            return None
        refs = {self.entries[at].ref for n in self.with_word.get(core[0], ()) for name, own, at in [self.cores[n]] if own == kinds and name[0] == core[0]}
        return refs.pop() if len(refs) == 1 else None

    def _answer(self, text: str) -> int:
        tokens = self.tokens(text)
        if not tokens:
            return -1
        longer = [[t, *tokens[1:]] for t in self.rules.short.get(tokens[0], ())] if len(tokens) > 1 else []
        for ask in (self._by_mention, self._by_similarity):
            ref = ask(tokens)
            if ref is not None:
                return ref
            refs = {r for form in longer if (r := ask(form)) is not None}
            if len(refs) == 1:
                return refs.pop()
        return -1

    def meant(self, text: str | None) -> int:
        """The entry a typed value means, or -1."""
        if text is None or not text.strip():
            return -1
        if self.rules.place_before:
            _, mark, after = text.partition(" : ")
            if mark and after.strip():
                text = after
            text = re.sub(r"[,.]? *\[?(?:c|©|ca\. ?)?\d{4}\??\]?[-–]?\.?$", "", text)
        return self.answer(text)


def _is_within(short: str, long: str) -> bool:
    letters = iter(long)
    return all(c in letters for c in short)


def _is_date(token: str) -> bool:
    return bool(re.fullmatch(r"c?\d{4}", token))


_READY: dict[tuple, Gazetteer] = {}


def entries_of(ref: DataFrame, ref_id: str, name: str, aliases: list[str] = (), context: str | None = None) -> list[Entry]:
    """The canonical list as entries; a list above the bound is refused."""
    rows = ref.select(ref_id, name, *aliases, *([context] if context else [])).orderBy(ref_id).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a canonical list of more than {MOST_ENTRIES} entries")
    return [
        Entry(int(r[ref_id]), r[name] or "", tuple(r[a] for a in aliases if r[a]), (r[context] or "") if context else "")
        for r in rows
        if (r[name] or "").strip()
    ]


def linked(value: Column, entries: list[Entry], rules: Rules) -> Column:
    """The id of the entry each value means, or -1."""
    key = (tuple(entries), rules.key())

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _READY:
            _READY[key] = Gazetteer(list(entries), rules)
        own = _READY[key]
        for batch in batches:
            yield pd.Series([own.meant(v) for v in batch], dtype="int64")

    return run(value)


def entries_per_id(df: DataFrame, key: str, lists: str) -> DataFrame:
    """(key, pos, value): the non-blank entries of the lists of each key, once
    each, in one aggregation that combines on the map side.  Rows that repeat a key
    with another list add its entries.
    """
    each = df.where(F.col(key).isNotNull()).select(key, F.posexplode_outer(lists).alias("pos", "value"))
    return each.where(F.trim(F.coalesce("value", F.lit(""))) != "").distinct()


def found(df: DataFrame, key: str, lists: str, entries: list[Entry], rules: Rules) -> DataFrame:
    """(field, key, pos, value, ref_id) of every non-blank entry that is not a
    canonical name character for character."""
    names = df.sparkSession.createDataFrame([(n,) for n in sorted({e.name for e in entries})], "value string")
    rows = entries_per_id(df, key, lists).join(F.broadcast(names), "value", "left_anti")  # at most MOST_ENTRIES names
    return rows.select(F.lit(lists).alias("field"), key, "pos", "value", linked(F.col("value"), entries, rules).alias("ref_id"))
