"""Names, slugs, populations and labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Place classes with kind and rank, junction prefixes, sector tiers.
PLACES = {"city": ("town", 0), "town": ("town", 0), "village": ("village", 2), "hamlet": ("hamlet", 4)}
LANDMARK_RANK = 5
JUNCTIONS = ("carrefour", "rond-point", "rond point", "croix de", "place de")
SECTOR_TIERS = ((300, 1), (150, 2), (60, 3), (20, 4))


def _ascii_of(c: str) -> str:
    """What is left of a character in ASCII when it is decomposed, compatibility forms too."""
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


_FOLDED = {c: _ascii_of(c) for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if _ascii_of(c)}
#: Characters that fold to one ASCII character, and those characters.
ACCENTED = "".join(c for c, a in _FOLDED.items() if len(a) == 1)
PLAIN = "".join(a for a in _FOLDED.values() if len(a) == 1)
#: Characters (of 16 bits) that fold to several.
_LIGATURES = {c: a for c, a in _FOLDED.items() if len(a) > 1 and ord(c) < 0x10000}


def ascii_fold(name: Column) -> Column:
    """ASCII letters in place of accented and compatibility forms; what has none goes."""
    several = F.create_map(*[F.lit(v) for pair in _LIGATURES.items() for v in pair])
    some = "[" + "".join(_LIGATURES) + "]"
    spelt = F.array_join(F.transform(F.split(name, ""), lambda c: F.when(c.rlike(some), F.try_element_at(several, c)).otherwise(c)), "")
    whole = F.when(name.rlike(some), spelt).otherwise(name)
    return F.regexp_replace(F.translate(whole, ACCENTED, PLAIN), "[^\\x00-\\x7F]", "")


def slug(name: Column) -> Column:
    """ASCII, lower case, words joined by underscores; letters without an ASCII base go."""
    folded = F.lower(ascii_fold(name))
    return F.replace(F.regexp_replace(F.trim(F.regexp_replace(folded, "\\s+", " ")), " ", "_"), F.lit("/"), F.lit("_"))


def name_key(name: Column) -> Column:
    """Letters and digits only, lower case: what two spellings of a name share."""
    return F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]", "")


def population(raw: Column) -> Column:
    """All digits run together, as free text is read; 0 if none."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]", ""), F.lit("")).try_cast("long"), F.lit(0))


def is_junction(name: Column) -> Column:
    return F.lower(name).rlike("^(" + "|".join(JUNCTIONS) + ")")


def place_rank(place: Column, people: Column) -> Column:
    """The class's rank, one step up for 10,000 people or more, one down for 1 to 499."""
    base = F.when(place.isin("city", "town"), 0).when(place == "village", 2).when(place == "hamlet", 4)
    moved = F.when(people >= 10000, base - 1).when((people > 0) & (people < 500), base + 1).otherwise(base)
    return F.when(base.isNotNull(), F.greatest(moved, F.lit(0)))


def sector_rank(problems: Column) -> Column:
    out = None
    for limit, rank in SECTOR_TIERS:
        out = F.when(problems >= limit, rank) if out is None else out.when(problems >= limit, rank)
    return out.otherwise(5)


def html_escape(raw: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return raw
