"""Monthly and yearly roll-ups, extremes, streaks and data health, all cities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTHLY = {"tavg_mean": F.avg, "tavg_std": F.stddev_samp}


def monthly(df: DataFrame) -> DataFrame:
    """Means by city and month, and the sample deviation of tavg; nulls as 0."""
    cols = {"tavg_mean": F.avg("tavg"), "tavg_std": F.stddev_samp("tavg"), "diurnal_mean": F.avg("diurnal_range"), "roll_std_mean": F.avg("roll_std_7"), "anomaly_mean": F.avg("anomaly_z"), "delta_1_mean": F.avg("delta_1")}
    return df.groupBy("city", F.year("date").alias("year"), F.month("date").alias("month")).agg(*(F.coalesce(c, F.lit(0.0)).alias(k) for k, c in cols.items()))


def baseline(months: DataFrame) -> DataFrame:
    """Means over the years of each calendar month's values (unweighted by days)."""
    return months.groupBy("city", "month").agg(*(F.avg(c).alias(c) for c in ("tavg_mean", "tavg_std", "diurnal_mean")))


def annual(months: DataFrame) -> DataFrame:
    return months.groupBy("city", "year").agg(F.avg("tavg_mean").alias("tavg_mean"))


def trend(months: DataFrame) -> DataFrame:
    """Slope of yearly means on years; 0 with fewer than two years."""
    slope = F.when(F.count("*") < 2, 0.0).otherwise(F.regr_slope("tavg_mean", F.col("year").cast("double")))
    return annual(months).groupBy("city").agg(slope.alias("trend_per_year"))


def extreme_months(base: DataFrame) -> DataFrame:
    """The hottest and coolest month of each city, the earlier on ties."""
    return base.groupBy("city").agg(F.max_by("month", F.struct("tavg_mean", -F.col("month"))).alias("hottest"), F.max("tavg_mean").alias("hottest_mean"), F.min_by("month", F.struct("tavg_mean", "month")).alias("coolest"), F.min("tavg_mean").alias("coolest_mean"))


def top_days(df: DataFrame, by: Column, n: int = 10) -> DataFrame:
    """Each city's n first days by ``by``, the earlier on ties."""
    rank = F.row_number().over(Window.partitionBy("city").orderBy(by, "date"))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def longest_run(df: DataFrame, holds: Column) -> DataFrame:
    """The first longest run of rows for which ``holds``: length, start and end; 0 and nulls where there is none."""
    by_date = Window.partitionBy("city").orderBy("date")
    marked = df.select("city", "date", F.coalesce(holds, F.lit(False)).alias("ok"), F.row_number().over(by_date).alias("rn"))
    island = F.col("rn") - F.row_number().over(Window.partitionBy("city", "ok").orderBy("date"))
    runs = marked.withColumn("island", island).where("ok").groupBy("city", "island").agg(F.count("*").alias("length"), F.min("date").alias("start"), F.max("date").alias("end"))
    best = runs.groupBy("city").agg(F.min_by(F.struct("length", "start", "end"), F.struct(-F.col("length"), "start")).alias("b"))
    cities = df.select("city").distinct()
    return cities.join(best, "city", "left").select("city", F.coalesce("b.length", F.lit(0)).cast("long").alias("length"), "b.start", "b.end")


def anomaly_days(df: DataFrame, edge: float = 2.0) -> DataFrame:
    return df.groupBy("city").agg(F.count_if(F.abs("anomaly_z") >= edge).alias("n"))


def health(df: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """Extent, expected and actual days and their ratio; with ``observed`` (the raw rows) also the days that were measured."""
    days = F.datediff(F.max("date"), F.min("date")) + 1
    out = df.groupBy("city").agg(F.min("date").alias("data_start"), F.max("date").alias("data_end"), days.cast("long").alias("expected_days"), F.count("*").alias("actual_days"))
    out = out.withColumn("coverage", F.when(F.col("expected_days") > 0, F.col("actual_days") / F.col("expected_days")).otherwise(1.0))
    if observed is None:
        return out
    return out.join(observed.groupBy("city").agg(F.count_distinct("date").alias("observed_days")), "city", "left")
