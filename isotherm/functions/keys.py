"""Keys and labels of cities, files and months as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def city_key(city: Column, country: Column | None = None) -> Column:
    """A city's name (and country code, unless blank or null) as a key: lower case, blanks as underscores."""
    name = F.replace(F.lower(stripped(city)), F.lit(" "), F.lit("_"))
    if country is None:
        return name
    return F.concat_ws("_", name, F.nullif(F.lower(stripped(country)), F.lit("")))


def parse_city_key(key: Column) -> tuple[Column, Column]:
    """The inverse: name with blanks, and the country code that a trailing pair of letters stands for, else null."""
    pattern = "^(.+)_([A-Za-z]{2})$"
    has_code = F.regexp_like(key, F.lit(pattern))
    name = F.when(has_code, F.regexp_extract(key, pattern, 1)).otherwise(key)
    return F.replace(name, F.lit("_"), F.lit(" ")), F.when(has_code, F.upper(F.regexp_extract(key, pattern, 2)))


def file_safe(key: Column) -> Column:
    """Everything but letters, digits, - and _ as underscores."""
    return F.regexp_replace(key, r"[^\p{L}\p{N}_-]", "_")


def month_name(month: Column) -> Column:
    """Jan to Dec; any other number as text."""
    return F.when(month.between(1, 12), F.element_at(F.array(*map(F.lit, MONTHS)), F.greatest(F.least(month.cast("int"), F.lit(12)), F.lit(1)))).otherwise(month.cast("string"))
