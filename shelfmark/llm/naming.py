"""How names of persons, bodies and firms are typed, as comparable keys.

A spelling is parsed into one or two keys (two where the order of surname and
given names cannot be told from the spelling alone), the shorter keys a full
name may be typed as, and the life dates it gives.  Keys hold lower-case words
without accents in a fixed order: the surname first, given names with pet forms
replaced, a firm's or body's words without those that mean nothing.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from shelfmark.llm.edits import deletions, distance
from shelfmark.llm.linking import FIRMS, flat

#: Fixed values, seeds: pet forms of given names (others are read off the names, see ``bearers``).
PET_FORMS = {
    "aga": "agnieszka", "sasha": "aleksandr", "tono": "antonio", "concha": "concepcion", "dot": "dorothy", "dolly": "dorothy",
    "ned": "edward", "ted": "edward", "eddie": "edward", "lisbeth": "elisabeth", "elsbeth": "elisabeth", "betty": "elizabeth",
    "liz": "elizabeth", "beth": "elizabeth", "paco": "francisco", "pancho": "francisco", "frede": "frederik", "fritz": "friedrich",
    "ginette": "genevieve", "heinz": "heinrich", "heiner": "heinrich", "nacho": "ignacio", "inge": "ingeborg", "jim": "james",
    "jimmy": "james", "jirka": "jiri", "quino": "joaquin", "hannes": "johannes", "hans": "johannes", "pepe": "jose",
    "kasia": "katarzyna", "kate": "katherine", "kitty": "katherine", "kathy": "katherine", "kris": "kristoffer", "lida": "ludmila",
    "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "grete": "margarete", "grethe": "margrethe", "merche": "mercedes",
    "mirek": "miroslav", "pat": "patricia", "patty": "patricia", "dick": "richard", "rick": "richard", "bob": "robert", "rob": "robert",
    "charo": "rosario", "staszek": "stanislaw", "sue": "susan", "susie": "susan", "tom": "thomas", "tomek": "tomas",
    "volodya": "vladimir", "vova": "vladimir", "willi": "wilhelm", "bill": "william", "will": "william", "billy": "william",
}
#: Words that only bodies have, and their abbreviations.
BODY_WORDS = {
    "association": "association", "assoc": "association", "assn": "association", "federation": "federation", "fed": "federation",
    "union": "union", "committee": "committee", "comm": "committee", "cttee": "committee", "ctte": "committee", "department": "department", "dept": "department",
    "society": "society", "soc": "society", "institute": "institute", "inst": "institute", "league": "league", "guild": "guild",
    "council": "council", "ministry": "ministry", "bureau": "bureau", "office": "office",
}
_BODY_OTHER = {"intl": "international", "internat": "international", "nat": "national", "natl": "national"}
_BODY_NOISE = frozenset("of for the and de".split())
_BODY_NEAR: dict[str, set[str]] = {}
for _w in BODY_WORDS:
    if len(_w) >= 5:
        for _d in deletions(_w):
            _BODY_NEAR.setdefault(_d, set()).add(_w)
#: Ways to say that no name is known.
STOCK = re.compile(
    r"^(?:n/?a|none|unknown|anon|anonymous|s\.? ?n|n\.? ?n|(?:author|name|publisher)s? (?:unknown|not (?:named|known|identified|given))|unknown (?:author|publisher))$"
)
_ROLE_BEFORE = re.compile(r"^(?:(?:(?:edited|compiled|translated|written|photographed|selected) )?by|ed\.|dr\.?|prof\.?|professor|mr\.?|mrs\.?|ms\.?|sir) +", re.I)
_ROLE_AFTER = re.compile(r"(?: *[(\[][^()\[\]\d]*[)\]]|, (?:ed|eds|editor|photographer|author)\.?)$", re.I)
_DATES = re.compile(r",? *\(?(?:b\. *|born |d\. *)?(\d{4})? ?[-–]? ?(\d{4})?\??\)?$")
_WORDS = re.compile(r"[^\W_]+")


@dataclass
class Parsed:
    """``sort`` is person, body or firm; ``keys`` are full names (one, or two
    where the order is uncertain) or, if ``short``, a surname with initials."""

    sort: str
    keys: list[str]
    views: list[str]
    short: bool = False
    birth: str = ""
    death: str = ""
    certain: bool = True


def is_stock(text: str) -> bool:
    return bool(STOCK.match(re.sub(r"^\W+|\W+$", "", flat(text))))


def _body_word(word: str) -> str | None:
    if word in BODY_WORDS:
        return BODY_WORDS[word]
    if len(word) < 5:
        return None
    near = {k for d in deletions(word) for k in _BODY_NEAR.get(d, ()) if distance(word, k, 1) <= 1}
    return BODY_WORDS[min(near)] if near else None


def _squeezed(name: str) -> list[str]:
    """The words of a name; what a hyphen or an apostrophe joins is one word."""
    return _WORDS.findall(re.sub(r"['’‐‑-]+", "", name))


def _paired(plain: str, typed: str) -> list[tuple[str, str]]:
    """The words of a name, flat and as typed."""
    a, b = _squeezed(plain), _squeezed(typed)
    return list(zip(a, b)) if len(a) == len(b) else [(w, w) for w in a]


def _person(surname: list[str], typed: list[tuple[str, str]]) -> tuple[str, list[str], bool]:
    """The key of a name, its shorter forms and whether it is short itself.

    ``typed`` has each given name flat and as typed: initials keep their
    accent, since a name cut to its initial keeps it.
    """
    parts = surname if len(surname) == 2 else []
    last = "".join(surname)
    given = [PET_FORMS.get(w, w) for w, _ in typed]
    letters = [raw[0] if w not in PET_FORMS else PET_FORMS[w][0] for w, raw in typed]
    initials = bool(given) and all(len(g) == 1 for g in given)
    key = " ".join([last, *(letters if initials else given)])
    if initials or not given:
        return key, [], initials
    views = [f"{last} {g}" for g in {given[0], " ".join(letters), letters[0]}]
    if parts:  # the second of two surnames put first
        views += [" ".join([parts[1], *given, parts[0]]), f"{parts[1]} {given[0]} {parts[0]}"]
    return key, sorted(set(views) - {key}), False


def parse_person(text: str) -> Parsed | None:
    s = text.strip()
    while (t := _ROLE_BEFORE.sub("", s)) != s or (t := _ROLE_AFTER.sub("", s)) != s:
        s = t.strip()
    birth = death = ""
    m = _DATES.search(s)
    if m and (m[1] or m[2]):
        birth, death, s = m[1] or "", m[2] or "", s[: m.start()]
    plain = flat(s)
    words = _WORDS.findall(plain)
    if any(_body_word(w) for w in words):
        return parse_body(text)
    before, comma, after = plain.partition(",")
    low = unicodedata.normalize("NFC", s.lower())
    if comma:
        surname, given = _squeezed(before), _paired(after, low.partition(",")[2])
        if not surname:
            return None
        if len(surname) == 1 and len(doubled := [x for x in re.split(r"[-‐‑]+", before) if x.strip()]) == 2:
            surname = ["".join(_WORDS.findall(x)) for x in doubled]
        key, views, short = _person(surname, given)
        return Parsed("person", [key], views, short, birth, death)
    pairs = _paired(plain, low)
    words = [w for w, _ in pairs]
    if not words:
        return None
    if len(words) == 1:
        return Parsed("person", [words[0]], [], False, birth, death)
    orders = [([words[-1]], pairs[:-1]), ([words[0]], pairs[1:])]
    if len(words[0]) == 1:
        orders = orders[:1]
    elif len(words[-1]) == 1:
        orders = orders[1:]
    built = [_person(*o) for o in orders]
    return Parsed("person", [b[0] for b in built], built[0][1], built[0][2], birth, death, len(built) == 1)


def _means_nothing(word: str) -> bool:
    """A linking word, also one edit off."""
    return word in _BODY_NOISE or len(word) <= 4 and any(distance(word, x, 1) <= 1 for x in ("of", "for"))


def parse_body(text: str) -> Parsed | None:
    plain = re.sub(r"\[[^\[\]]*\]", " ", flat(text))
    lead, dot, rest = plain.partition(". ")
    if dot and " " in rest and not _body_word(lead) and lead not in _BODY_OTHER and lead not in BODY_WORDS:
        plain = f"{rest} {lead}"  # "Place. Body" names the place first
    words = [_BODY_OTHER.get(w, w) for w in _WORDS.findall(plain)]
    words = [BODY_WORDS.get(w, w) for w in words if len(w) > 2 and not _means_nothing(w)]
    first = next((i for i, w in enumerate(words) if _body_word(w) or any(distance(w, x, 1) <= 1 for x in _BODY_OTHER.values())), 0)
    words = words[first:] + words[:first]
    return Parsed("body", [" ".join(words)], [" ".join(sorted(words))]) if words else None


def parse_firm(text: str) -> Parsed | None:
    """The kinds of a firm come first, then the words of its name in order;
    the alternative key turns the parts around a comma or the two partners."""
    plain = flat(text)
    before, comma, after = plain.rpartition(", ")
    turned = f"{after} {before}" if comma else plain
    keys = []
    for form in dict.fromkeys((turned, plain)):
        core, kinds = _firm_words(form)
        if not core and not kinds:
            continue
        keys.append(" ".join([*sorted(kinds), *core]))
    if not keys:
        return None
    core, kinds = _firm_words(plain)
    forms = [[*kinds, *core]]
    fewer = kinds - FIRMS.optional
    if fewer != kinds and core:
        forms.append([*fewer, *core])
    if len(core) > 1:
        forms.append([*kinds, core[0][0], *core[1:]])
        if fewer:
            forms.append([*fewer, core[0]])
    views = [" ".join(sorted(f)) for f in forms]
    return Parsed("firm", keys, sorted(set(views)), len(core) > 1 and len(core[0]) == 1)


_KIND_NEAR: dict[str, set[str]] = {}
for _w in FIRMS.kinds:
    if len(_w) >= 5:
        for _d in deletions(_w):
            _KIND_NEAR.setdefault(_d, set()).add(_w)


def _firm_words(plain: str) -> tuple[list[str], set[str]]:
    core: list[str] = []
    kinds: set[str] = set()
    for w in _WORDS.findall(plain):
        if w in FIRMS.kinds:
            kinds.update(FIRMS.kinds[w])
        elif w in FIRMS.noise:
            continue
        elif len(w) >= 4 and (near := {k for d in deletions(w) for k in _KIND_NEAR.get(d, ()) if distance(w, k, 1) <= 1}):
            kinds.update(FIRMS.kinds[min(near)])
        else:
            core.append(w)
    return core, kinds


def spelling_of_firm(text: str) -> str:
    """A firm without a leading ``place : `` and a trailing year."""
    _, mark, after = text.partition(" : ")
    s = after if mark and after.strip() else text
    return re.sub(r", *\[?(?:c|ca\. ?)?\d{4}\??\]?\.?$", "", s).strip()


def parse(kind: str, text: str) -> Parsed | None:
    """The parsed spelling, or None for a stock value or an empty name."""
    if not text or is_stock(text):
        return None
    return parse_firm(text) if kind == "publisher" else parse_person(text)
