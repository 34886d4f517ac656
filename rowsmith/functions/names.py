"""Names of companies as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.functions.html import collapse

# Legal forms, each a whole word, and kinds of lodging.
SUFFIXES = (r"Pty\.?\s*Ltd\b\.?", r"Ltd\b\.?", r"Limited\b", r"Inc\b\.?", r"Incorporated\b", r"LLC\b", r"Corp\b\.?", r"Corporation\b", r"Co\b\.?", r"Company\b")
LODGING = ("Hotel", "Motel", "Resort", "Lodge", "Inn", "Suites", "Accommodation", "Apartments", "Holiday Home", "Cottage", "Villa", "B&B", "Bed and Breakfast", "Hostel", "Backpackers")
REMOVED = ("Museum & History Center", "Museum and History Center", "Historical Society", "History Center", "Memorial", "Monument", ", Inc.", " Inc.", "- Museum", " Museum", "The ")


def casual(name: Column) -> Column:
    """Without legal forms and places; over four words, the first four of a lodging and the first three of others."""
    bare = reduce(lambda c, s: F.regexp_replace(c, rf"(?i)\b{s}", ""), SUFFIXES, F.trim(name))
    bare = F.regexp_replace(bare, r"(?i)\bAustralian?\b", "")
    bare = F.regexp_replace(collapse(bare), r"[ ,\-–—]+$", "")
    words = F.split(bare, " ")
    keep = F.when(F.arrays_overlap(words, F.array(*map(F.lit, LODGING))), 4).otherwise(3)
    return F.when(F.size(words) > 4, F.array_join(F.slice(words, F.lit(1), keep), " ")).otherwise(bare)


def short(name: Column, most: int = 40) -> Column:
    """Without usual terms; over ``most`` characters, cut at the last space before; the start of the name if none is left."""
    bare = reduce(lambda c, t: F.replace(c, F.lit(t), F.lit("")), REMOVED, name)
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(bare), "^-+|-+$", ""), "^,+|,+$", ""))
    cut = F.regexp_replace(F.substring(bare, 1, most), r"\s\S*$", "")
    return F.when(bare == "", F.substring(name, 1, most)).when(F.length(bare) > most, cut).otherwise(bare)


def from_domain(domain: Column) -> Column:
    """The words of a domain's first label, each with a capital."""
    words = F.regexp_extract_all(F.substring_index(F.lower(domain), ".", 1), F.lit("[a-z]+"), F.lit(0))
    return F.array_join(F.transform(words, F.initcap), " ")


def render(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each {placeholder} replaced by its column, null by nothing."""
    return reduce(lambda t, x: F.replace(t, F.lit("{" + x[0] + "}"), F.coalesce(x[1].cast("string"), F.lit(""))), values.items(), F.lit(template))
