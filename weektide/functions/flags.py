"""Event predicates. Each is TRUE or FALSE, never NULL.

They are written as SQL text: a predicate is then one call into the JVM, which keeps
building the weekly plan fast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weektide.constants import COUNTRY_CODES, MAJOR_CODES, MIDDLE_EAST_GEO, RADAR_REGIONS

ACTOR1 = "Actor1CountryCode"
ACTOR2 = "Actor2CountryCode"
GEO = "ActionGeo_CountryCode"


def known(*conditions: str) -> Column:
    """Any of the conditions holds; one that is NULL does not hold."""
    return F.expr(" OR ".join(f"coalesce({condition}, false)" for condition in conditions))


def listed(column: str, codes: list[str]) -> str:
    values = ", ".join(f"'{code}'" for code in codes)
    return f"{column} IN ({values})"


MAJOR_PLACE = [listed(column, MAJOR_CODES) for column in (ACTOR1, ACTOR2, GEO)]


def is_class(number: int) -> Column:
    return known(f"QuadClass = {number}")


def is_class_text(number: int) -> Column:
    """Class test on trimmed text, as daily drops carry the class untyped."""
    return known(f"trim(CAST(QuadClass AS STRING)) = '{number}'")


def is_conflict() -> Column:
    return known("QuadClass >= 3")


def is_major_place() -> Column:
    return known(*MAJOR_PLACE)


def is_major() -> Column:
    """A place among the major countries, or the flag that came with the row."""
    return known(*MAJOR_PLACE, "is_major_country = 1")


def involves(country: str) -> Column:
    actor, geo = COUNTRY_CODES[country]
    return known(f"{ACTOR1} = '{actor}'", f"{ACTOR2} = '{actor}'", f"{GEO} = '{geo}'")


def in_middle_east() -> Column:
    return known(listed(GEO, MIDDLE_EAST_GEO))


def between(first: str, second: str) -> Column:
    """Both countries act, in either role."""
    left, right = COUNTRY_CODES[first][0], COUNTRY_CODES[second][0]
    return known(
        f"({ACTOR1} = '{left}' AND {ACTOR2} = '{right}')",
        f"({ACTOR1} = '{right}' AND {ACTOR2} = '{left}')",
    )


def in_regions(regions: list[str] = RADAR_REGIONS) -> Column:
    return known(listed(ACTOR1, regions), listed(ACTOR2, regions))
