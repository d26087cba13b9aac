"""Captions and context of figures, from the text around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclattice.functions import text as T

# What captions look like, by priority; those with two groups have a number.
CAPTIONS = [
    r"(?:figure|fig\.?|diagram|schema|drawing|dwg\.?)\s+([0-9]+(?:[.-][0-9]+)*)\s*[:-]?\s*(.+?)(?:\n|$)",
    r"(?:рис(?:унок)?\.?|схема|чертеж)\s+([0-9]+(?:[.-][0-9]+)*)\s*[:-]?\s*(.+?)(?:\n|$)",
    r"(?:figure|fig\.?|diagram|schema|drawing|type|model)\s*[:-]\s*(.+?)(?:\n|$)",
    r"^([A-Z][A-Z0-9\s:&\-]{10,80})$",
    r"^(<<\s*FIG\.\s*[A-Z0-9\-]+\s*>>)$",
]
ANY_CASE = 3
# How texts refer to a figure of the number {}.
NAMES = r"(?:figure|fig\.?|diagram|drawing)"
REFERENCES = [
    rf"(?:see|refer to|shown in|depicted in|illustrated in|as per)\s+{NAMES}\s+{{}}",
    rf"{NAMES}\s+{{}}\s+(?:shows|illustrates|depicts|represents)",
    rf"\((?:see\s+)?{NAMES}\s+{{}}\)",
]
#: What they begin with: a place that begins otherwise is passed over at once.
BEGIN = ["[srdia]", "[fd]", r"\("]
# Words of the domains that a figure's surroundings may belong to.
DOMAINS = {
    "combustion": ["burner", "combustion", "fuel", "ignition"],
    "automation": ["control", "automation", "sensor", "controller"],
    "HMI": ["display", "panel", "screen", "hmi", "interface"],
    "fluid_system": ["pump", "valve", "pipe", "flow"],
    "electrical": ["electrical", "wiring", "circuit", "power"],
}
CODE = r"\b[A-Z]{1,3}-?[0-9]{1,3}\b"
MOST_CODES, AROUND = 10, 100


def captions_in(text: Column) -> list[Column]:
    """For each pattern the caption it finds first, cleaned; null if there is none of five characters."""
    out = []
    for k, pattern in enumerate(CAPTIONS):
        flagged = ("(?imu)" if k < ANY_CASE else "(?m)") + pattern
        numbered = k < 2
        title = T.strip(F.regexp_extract(text, flagged, 2 if numbered else 1))
        whole = F.concat(F.lit("Figure "), F.regexp_extract(text, flagged, 1), F.lit(": "), title) if numbered else title
        clean = T.strip_controls(whole)
        out.append(F.when(F.regexp_like(text, F.lit(flagged)) & (F.length(clean) >= 5), clean))
    return out


def title_like(text: Column) -> Column:
    """The first of the first three lines that is in capitals or has a colon, of 8 to 100 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: T.strip(x)), lambda x: x != "")
    fits = F.filter(F.slice(lines, 1, 3), lambda x: F.length(x).between(8, 100) & (((F.upper(x) == x) & (F.lower(x) != x)) | F.contains(x, F.lit(":"))))
    return F.when(F.size(fits) > 0, T.strip_controls(F.get(fits, F.lit(0))))


def find_caption(above: Column, below: Column) -> Column:
    """A figure's caption from the text above and below it: by pattern, then a line like a title; empty if there is none."""
    texts = [F.coalesce(t, F.lit("")) for t in (above, below)]
    return F.coalesce(*(c for t in texts for c in captions_in(t)), *map(title_like, texts), F.lit(""))


def figure_number(caption: Column) -> Column:
    """The first number of a caption, with its parts; null if there is none."""
    return F.nullif(F.regexp_extract(caption, r"([0-9]+(?:[.-][0-9]+)*)", 1), F.lit(""))


def matches_with_places(text: Column, pattern: Column) -> Column:
    """array<struct<match, start>> of a pattern's matches, start from 0: what stands between the matches tells their places.

    Both are the elements of arrays of one, so that a text is searched once for all its matches, and again only if there are some.
    """
    held = F.filter(F.array(F.regexp_extract_all(text, pattern, F.lit(0))), lambda f: F.size(f) > 0)
    both = F.transform(held, lambda f: F.struct(f.alias("found"), F.split(text, pattern, -1).alias("between")))
    chars = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda k, x: k + F.length(x))
    places = F.transform(both, lambda b: F.transform(b["found"], lambda m, i: F.struct(m.alias("match"), (chars(b["between"], i + 1) + chars(b["found"], i)).alias("start"))))
    return F.when(text.isNotNull() & pattern.isNotNull(), F.flatten(places))


def references(text: Column, number: Column, around: int = AROUND) -> Column:
    """array<string>: each reference to a figure of the number with so many characters on both sides, cleaned, once; none for a null number."""
    quoted = F.concat(F.lit(r"\Q"), number, F.lit(r"\E"))

    def by(pattern: str, begin: str) -> Column:
        first, last = pattern.split("{}")
        places = matches_with_places(text, F.concat(F.lit(f"(?i)(?={begin}){first}"), quoted, F.lit(last)))
        cut = lambda p: F.substring(text, F.greatest(p["start"] - around, F.lit(0)) + 1, p["start"] + F.length(p["match"]) + around - F.greatest(p["start"] - around, F.lit(0)))
        return F.transform(places, lambda p: T.strip_controls(cut(p)))

    found = F.filter(F.array_distinct(F.concat(*map(by, REFERENCES, BEGIN))), lambda x: x != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def domain_tags(text: Column) -> Column:
    tags = lambda low: F.filter(F.array(*(F.when(T.any_of(low, words), F.lit(tag)) for tag, words in DOMAINS.items())), lambda x: x.isNotNull())
    return F.get(F.transform(F.array(F.lower(text)), tags), F.lit(0))  # in lower case once


def entity_codes(text: Column, most: int = MOST_CODES) -> Column:
    """The first so many different codes of a text, by place."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit("(?=[A-Z])" + CODE), F.lit(0))), 1, most)
