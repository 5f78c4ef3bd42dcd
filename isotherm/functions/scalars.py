"""Calendar, class and bin expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_DAYS = 365.25


def season(date: Column) -> Column:
    m = F.month(date)
    return F.when(m.isin(12, 1, 2), "winter").when(m.between(3, 5), "pre_monsoon").when(m.between(6, 9), "monsoon").otherwise("post_monsoon")


def three_way(value: Column, below: str, between: str, above: str, edge: float = 1.0) -> Column:
    """By whether the value is under -edge, above edge or neither (null: neither)."""
    return F.when(value < -edge, below).when(value > edge, above).otherwise(between)


def tertile(value: Column, cuts: Column, low: str, mid: str, high: str) -> Column:
    """By two cuts, each still in the class below it; null is 'missing'."""
    return F.when(value.isNull(), "missing").when(value <= cuts[0], low).when(value <= cuts[1], mid).otherwise(high)


def doy_angle(date: Column, k: int = 1) -> Column:
    return F.dayofyear(date) * (2 * math.pi * k / YEAR_DAYS)


def fourier(date: Column, pairs: int) -> dict[str, Column]:
    """sin1, cos1, ... for that many harmonics of the year."""
    return {f"{name}{k}": f(doy_angle(date, k)) for k in range(1, pairs + 1) for name, f in (("sin", F.sin), ("cos", F.cos))}


def bin_label(value: Column, edges: Column) -> Column:
    """'bin' and the number of inner edges at or under the value, to nine places; 'bin0' if there are fewer than two edges.

    Edges are quantiles and may be values of the data but for their last bits, which shall not decide.
    """
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(F.coalesce(F.size(edges), F.lit(0)) < 2, "bin0").otherwise(F.concat(F.lit("bin"), F.size(F.filter(inner, lambda e: F.round(e, 9) <= F.round(value, 9))).cast("string")))


def safe_int(text: Column, default: int | None = None) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default).cast("int"))


def safe_float(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def present(value: Column) -> Column:
    """The value of a cell, or null where it is missing: blank text, NaN or null."""
    return F.when(F.coalesce(F.btrim(value.cast("string")).isin("", "NaN"), F.lit(True)), None).otherwise(value)
