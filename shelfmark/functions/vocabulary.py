"""Registries as data.  All lists here are fixed values: ids, labels, colours,
key words and the order in which they count are part of the results."""

from __future__ import annotations

from dataclasses import dataclass

#: Domain tags and their key words; ``word`` ends at a word boundary, ``stem`` goes on.
DOMAINS: dict[str, list[tuple[str, str]]] = {
    "photography": [("stem", "photograph"), ("word", "photo"), ("stem", "camera"), ("word", "photography"), ("stem", "photojournalism"), ("stem", "photographic")],
    "maritime": [("stem", "harbor"), ("stem", "harbour"), ("word", "port"), ("stem", "shipping"), ("stem", "dock"), ("stem", "maritime"), ("stem", "ocean"), ("word", "sea"), ("stem", "seafaring"), ("stem", "naval"), ("stem", "merchant marine")],
    "labor": [("stem", "labor"), ("stem", "labour"), ("stem", "working class"), ("stem", "worker"), ("stem", "union"), ("stem", "strike"), ("stem", "factory"), ("stem", "industry"), ("stem", "industrial")],
    "art": [("word", "art"), ("stem", "artist"), ("stem", "painting"), ("stem", "sculpture"), ("stem", "art photography")],
    "urban": [("stem", "urban"), ("word", "city"), ("stem", "cities"), ("stem", "metropolitan"), ("stem", "infrastructure"), ("stem", "los angeles")],
    "war": [("stem", "war"), ("stem", "military"), ("stem", "armed forces"), ("stem", "militarism"), ("stem", "police"), ("stem", "policing")],
    "theory": [("stem", "philosophy"), ("stem", "theory"), ("stem", "critical theory"), ("stem", "cultural studies"), ("stem", "aesthetics")],
    "archives": [("stem", "museum"), ("stem", "archive"), ("stem", "library"), ("stem", "collecting"), ("stem", "exhibition")],
}


@dataclass(frozen=True)
class Signal:
    """A theme: patterns match anywhere in lower-cased text, ``|b`` at the end
    of one stands for an ASCII word boundary."""

    id: str
    label: str
    color: str
    style: str
    patterns: tuple[str, ...]


SIGNALS = [
    Signal("image", "Image / media / cinema", "#1f77b4", "border-style:solid;", ("photograph", "photo|b", "camera", "cinema", "film|b", "motion picture", "documentary film", "visual", "media", "photojournalism")),
    Signal("labor", "Labor / work / class", "#e15759", "border-style:dashed;", ("labor", "labour", "working class", "worker", "union", "strike", "factory", "industry", "industrial", "proletariat")),
    Signal("capital", "Capital / empire", "#bcbd22", "border-width:3px;", ("capitalism", "socialism", "communism", "marx", "imperial", "empire", "colon", "neoliberal", "economic history", "political economy")),
    Signal("sea", "Sea / ports / maritime", "#2ca02c", "border-radius:0;", ("harbor", "harbour", "port|b", "shipping", "dock", "maritime", "ocean", "sea|b", "seafaring", "naval", "merchant marine", "ship|b", "shipwreck")),
    Signal("cities", "Cities / logistics", "#9467bd", "border-style:double;", ("los angeles", "urban", "city|b", "cities and towns", "metropolitan", "infrastructure", "transport", "railroad", "road", "logistic")),
    Signal("war", "War / policing", "#8c564b", "border-style:solid;border-color:#999;", ("war", "military", "armed forces", "militarism", "police", "policing", "prison", "penal", "security", "surveillance")),
    Signal("borders", "Borders / migration", "#17becf", "border-style:solid;border-color:#555;", ("emigration", "immigration", "migration", "refugee", "diaspora", "border", "citizenship")),
    Signal("archives", "Archives / museums", "#7f7f7f", "border-style:solid;border-color:#777;", ("museum", "archive", "library", "collecting", "collection of", "exhibition", "institutions?")),
    Signal("art", "Art / literature", "#d62728", "border-style:solid;border-color:#444;", ("art|b", "artist", "painting", "sculpture", "photography|b", "photography.*artistic", "fiction", "poetry", "drama", "literature")),
    Signal("theory", "Theory / method", "#ff7f0e", "border-style:dotted;", ("philosophy", "theory", "aesthetic", "psychoanalys", "critical theory", "semiotic", "hermeneutic")),
]

#: Colours of call-number classes by palette.
PALETTES: dict[str, dict[str, str]] = {
    "default": {
        "N": "#8B4513", "Q": "#2E8B57", "T": "#4682B4", "P": "#9370DB", "B": "#CD853F", "H": "#DC143C", "D": "#FF8C00", "G": "#20B2AA",
        "J": "#6A5ACD", "K": "#FF6347", "L": "#32CD32", "M": "#FF69B4", "R": "#1E90FF", "S": "#FFD700", "U": "#00CED1", "V": "#FF4500", "Z": "#9932CC",
    },
    "colorblind": {
        "N": "#D55E00", "Q": "#009E73", "T": "#0072B2", "P": "#CC79A7", "B": "#E69F00", "H": "#F0E442", "D": "#56B4E9", "G": "#009E73",
        "J": "#0072B2", "K": "#D55E00", "L": "#009E73", "M": "#CC79A7", "R": "#56B4E9", "S": "#F0E442", "U": "#0072B2", "V": "#D55E00", "Z": "#CC79A7",
    },
}
ZONES = {
    "Front Bedroom": "#ff7f0e", "Middle Bedroom": "#2ca02c", "Back Bedroom": "#d62728",
    "Guest Bedroom": "#9467bd", "Front Office": "#8c564b", "Back Office": "#e377c2",
}
NO_CLASS, NO_SIGNAL, NO_COLOR = "#999", "#1f77b4", "#ccc"

#: Likelihood buckets, best first, with the least score of each.
BUCKETS = [("Strongly Likely", 75), ("Likely", 55), ("Plausible", 35), ("Unlikely", None)]
#: Overlay tint of each bucket: colour and opacity.
TINTS = {"Strongly Likely": ("orange", 0.4), "Likely": ("yellow", 0.3), "Plausible": ("lightblue", 0.2)}

#: Publication ranges in which a large catalogue is harvested.
SHARDS = [("Pre1940", 1800, 1939)] + [(f"{d}s", d, d + 9) for d in range(1940, 2030, 10)]
SOURCE_CAP = 5000
