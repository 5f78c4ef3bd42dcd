"""Discretisation of the cube: edges by feature, symbols by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_label


def _ends(values_min: Column, values_max: Column) -> Column:
    return F.array(values_min, values_max)


def edges(cube: DataFrame, n_bins: int, method: str = "eq_size") -> DataFrame:
    """(city, feature_idx, edges) of the numeric features, over all cells of the cube."""
    low, high = F.min("num"), F.max("num")
    if method == "eq_size":
        cuts = F.percentile("num", F.array(*(F.lit(k / n_bins) for k in range(n_bins + 1))))
        found = F.array_sort(F.array_distinct(cuts))
        found = F.when(F.size(found) < 2, _ends(low, high)).otherwise(found)
    elif method == "eq_width":
        spread = F.transform(F.sequence(F.lit(0), F.lit(n_bins)), lambda i: low + i * (high - low) / n_bins)
        close = F.abs(high - low) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(high)
        found = F.when(close, _ends(low, high)).otherwise(spread)
    else:
        raise ValueError(f"unknown method: {method}")
    return cube.where(F.col("num").isNotNull()).groupBy("city", "feature_idx").agg(found.alias("edges"))


def discretised(cube: DataFrame, cuts: DataFrame) -> DataFrame:
    """The cube's cells that aren't missing, each with its symbol. ``cuts`` has a row for each city and numeric feature."""
    joined = cube.join(cuts, ["city", "feature_idx"], "left")
    symbol = F.coalesce(F.col("sym"), F.when(F.col("num").isNotNull(), bin_label(F.col("num"), F.col("edges"))))
    return joined.withColumn("symbol", symbol).where(F.col("symbol").isNotNull() & (F.trim("symbol") != "")).select("city", "window_id", "context_idx", "feature_idx", "symbol")
