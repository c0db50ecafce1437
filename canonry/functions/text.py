"""Names, lists and attributes as column expressions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Brand prefixes, in the order in which they are tried.
BRAND_PREFIXES = (
    "collection o ", "hotel o ", "fabhotel ", "oyo ", "oyo rooms ",
    "treebo trend ", "treebo ", "spot on ", "goroomgo ", "zostel ",
    "the hosteller ", "zostel plus ",
)

# Abbreviations in room names, in the order in which they are expanded.
ROOM_EXPANSIONS = (
    (r"\bw/\s*", "with "),
    (r"\bdbl\b", "double"),
    (r"\bsgl\b", "single"),
    (r"\btpl\b", "triple"),
    (r"\bquad\b", "quadruple"),
    (r"\bexec\b", "executive"),
    (r"\bdlx\b", "deluxe"),
    (r"\bstd\b", "standard"),
    (r"\bsup\b", "superior"),
    (r"\bac\b", "air conditioned"),
    (r"\bnon-ac\b", "non air conditioned"),
    (r"\bbrkfst\b", "breakfast"),
    (r"\bapt\b", "apartment"),
)

# Bed types; the first pattern that is found decides.
BEDS = (
    ("King", r"\bking\b"),
    ("Queen", r"\bqueen\b"),
    ("Twin", r"\btwin\b|\bhollywood\s*twin\b"),
    ("Double", r"\bdouble\b|\bdbl\b"),
    ("Single", r"\bsingle\b|\bsgl\b"),
    ("Bunk", r"\bbunk\b"),
    ("Dormitory", r"\bdorm(?:itory)?\b|\bhostel\s*bed\b"),
    ("Sofa Bed", r"\bsofa[\s\-]?bed\b|\bsofa\s*cum\s*bed\b"),
    ("Multiple Beds", r"\bmultiple\s*beds\b|\b[2-9]\s*beds\b"),
    ("Multiple Beds", r"\b[2-9]\s*bed(?:s|\s*room)?\b"),
    ("Double", r"\b1\s*bed(?:\b|\s*room\b)"),
    ("Multiple Beds", r"\b[2-9]\s*bedrooms?\b"),
    ("Double", r"\b1\s*bedroom\b"),
)

# Meal plans.
MEALS = (
    ("Half Board", r"\bhalf[\s\-]?board\b|\bhb\b"),
    ("Full Board", r"\bfull[\s\-]?board\b|\bfb\b|\ball[\s\-]?inclusive\b"),
    ("Breakfast", r"\bbreakfast\b|\bbed\s*&\s*breakfast\b|\bb\s*&\s*b\b|\bbb\b|\bw/?\.?\s*breakfast\b|\bcomplimentary\s+breakfast\b|\bfree\s+breakfast\b"),
)
NO_MEAL = "Room Only"

# Views.
VIEWS = (
    ("City", r"\bcity\s*view\b|\bcity\b"),
    ("Pool", r"\bpool\s*view\b|\bpool\b"),
    ("Garden", r"\bgarden\s*view\b|\bgarden\b"),
    ("Sea", r"\bsea\s*view\b|\bocean\s*view\b"),
    ("Mountain", r"\bmountain\s*view\b"),
    ("Courtyard", r"\bcourtyard\b"),
)

# Smoking, and occupancy by count and by keyword.
NOT_SMOKING = r"\bnon[\s\-]?smoking\b|\bno[\s\-]?smoking\b|\bnonsmoking\b"
SMOKING = r"\bsmoking\b"
GUESTS = r"(\d+)\s*(?:adults?|guests?|pax|persons?|people|sleeper)"
SLEEPS = r"\bsleeps\s*(\d+)"
OCCUPANCY = (
    ("Single", r"\bsingle\b|\bsgl\b"),
    ("Double", r"\bcouple\b|\bdouble\b|\bdbl\b|\bking\b|\bqueen\b|\btwin\b"),
    ("Triple", r"\btriple\b|\btpl\b"),
    ("Family", r"\bfamily\b|\bquadruple\b|\bquad\b|\bdormitory\b|\bdorm\b"),
)

#: Java's classes cover Unicode with this flag.
_U = "(?U)"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of a value that is computed once for each row.  What a lambda names from
    outside is put into it whole, so it is computed anew for each item otherwise."""
    return F.transform(F.array(value), of)[0]


def stripped(text: Column) -> Column:
    """Without white space at its ends, of any kind that Unicode has."""
    return F.regexp_replace(text, _U + r"^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def distinct_ignoring_case(items: Column) -> Column:
    """The first of items that differ in case or surrounding white space only."""
    return F.aggregate(
        items,
        F.array().cast("array<string>"),
        lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(stripped(k)) == F.lower(stripped(x))), kept).otherwise(F.array_append(kept, x)),
    )


def pipe_list(text: Column) -> Column:
    """Items between bars, trimmed, without blank and repeated ones."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), stripped)
    return distinct_ignoring_case(F.filter(parts, lambda x: x != ""))


@F.pandas_udf(T.StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    """One pass of HTML character references; the table has no SQL form."""
    return texts.map(lambda t: None if t is None else html.unescape(t).strip())


def number(text: Column) -> Column:
    """A double, or null for what isn't one; letters that Java allows after a number
    aren't one's."""
    plain = stripped(text)
    x = F.when(plain.rlike(r"^[+-]?(?:[0-9.]+(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?))$"), plain).try_cast("double")
    return F.when(~F.isnan(x), x)


def property_name(name: Column) -> Column:
    """Lower case without the first brand prefix that fits."""
    prefixes = "|".join(BRAND_PREFIXES)
    return F.regexp_replace(F.regexp_replace(stripped(F.lower(F.coalesce(name, F.lit("")))), f"^(?:{prefixes})", ""), _U + r"\s+", " ")


def property_numbers(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"\b\d{2,6}\b"), F.lit(0)))


def name_tokens(normal: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal, " "), lambda x: x != ""))


def room_name(name: Column) -> Column:
    text = reduce(lambda c, r: F.regexp_replace(c, _U + r[0], r[1]), ROOM_EXPANSIONS, F.lower(F.coalesce(name, F.lit(""))))
    return stripped(F.regexp_replace(F.regexp_replace(text, _U + r"[^\w\s]", " "), _U + r"\s+", " "))


def room_text(name: Column, amenities: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.array_join(F.coalesce(amenities, F.array().cast("array<string>")), " ")))


def first_label(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*(F.when(text.rlike(_U + p), F.lit(label)) for label, p in table))


def bed_type(text: Column) -> Column:
    return first_label(text, BEDS)


def meal_plan(text: Column) -> Column:
    return F.coalesce(first_label(text, MEALS), F.lit(NO_MEAL))


def view(text: Column) -> Column:
    return first_label(text, VIEWS)


def is_smoking(text: Column) -> Column:
    return F.when(text.rlike(_U + NOT_SMOKING), False).when(text.rlike(_U + SMOKING), True)


def occupancy(text: Column) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(text, GUESTS, 1), F.lit("")), F.nullif(F.regexp_extract(text, SLEEPS, 1), F.lit("")))
    # More digits than a number holds are a large count.
    n = F.coalesce(found.try_cast("int"), F.lit(99))
    counted = F.when(n == 1, "Single").when(n == 2, "Double").when(n == 3, "Triple").otherwise("Family")
    return F.when(found.isNotNull(), counted).otherwise(first_label(text, OCCUPANCY))


def _diacritics() -> tuple[str, str]:
    """Small Latin letters with diacritics, and what they are without."""
    pairs = [(c, b) for c in map(chr, range(0xE0, 0x250)) if c.islower() and len(b := unicodedata.normalize("NFKD", c)[:1]) and b.isascii() and b.isalpha()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _diacritics()


def fold(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Where each letter is one byte there are none, and nothing is looked up.
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, _MARKED, _PLAIN))


def search_terms(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.filter(F.split(fold(text), _U + r"[^\p{L}\p{N}]+"), lambda x: x != "")
