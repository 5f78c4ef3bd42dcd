"""Hopping windows over series and the long cube (city, window, offset, feature)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import NUMERIC, SYMBOLIC


def hopping(df: DataFrame, size: int, stride: int) -> DataFrame:
    """Each row once for each window that it lies in, with window_id and context_idx, both from 0; the partial window at the end is left out.

    A row works its windows out from its place, so that windows needn't be joined.
    """
    if size < 1 or stride < 1:
        raise ValueError("window and stride must be positive")
    w = Window.partitionBy("city")
    rows = df.withColumn("__rn", F.row_number().over(w.orderBy("date")) - 1).withColumn("__n", F.count("*").over(w))
    first = F.greatest(F.ceil((F.col("__rn") - size + 1) / stride), F.lit(0)).cast("int")
    last = F.least(F.floor(F.col("__rn") / stride), F.floor((F.col("__n") - size) / stride)).cast("int")
    out = rows.where(first <= last).withColumn("window_id", F.explode(F.sequence(first, last)))
    return out.withColumn("context_idx", (F.col("__rn") - F.col("window_id") * stride).cast("int")).drop("__rn", "__n").select("city", "window_id", "context_idx", *(c for c in df.columns if c != "city"))


def window_meta(rows: DataFrame, size: int) -> DataFrame:
    """First, last and middle date (that of offset size // 2) of each window."""
    return rows.groupBy("city", "window_id").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.max(F.when(F.col("context_idx") == size // 2, F.col("date"))).alias("center_date"))


def window_midpoints(rows: DataFrame) -> DataFrame:
    """First and last date and the midpoint between them, rounded down."""
    half = F.floor(F.datediff(F.max("date"), F.min("date")) / 2).cast("int")
    return rows.groupBy("city", "window_id").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.date_add(F.min("date"), half).alias("center_date"))


def broken_windows(rows: DataFrame, size: int) -> DataFrame:
    """Windows whose offsets aren't exactly 0 to size - 1."""
    seen = rows.groupBy("city", "window_id").agg(F.count_distinct("context_idx").alias("n"), F.min("context_idx").alias("low"), F.max("context_idx").alias("high"))
    return seen.where((F.col("n") != size) | (F.col("low") != 0) | (F.col("high") != size - 1))


def long_cube(rows: DataFrame, numeric: list[str] = NUMERIC, symbolic: list[str] = SYMBOLIC) -> DataFrame:
    """A row for each cell: feature_idx with a number or a symbol; null symbols are 'missing'."""
    cells: list[Column] = []
    for k, name in enumerate([*numeric, *symbolic]):
        number = F.col(name).try_cast("double") if name in numeric else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if name in numeric else F.coalesce(F.col(name).cast("string"), F.lit("missing"))
        cells.append(F.struct(F.lit(k).alias("feature_idx"), number.alias("num"), text.alias("sym")))
    return rows.select("city", "window_id", "context_idx", F.inline(F.array(*cells)))
