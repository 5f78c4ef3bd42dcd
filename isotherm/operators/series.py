"""Daily series by city: gap-free calendar, fills, lags, rolling and seasonal features.

All window expressions stand over one specification (city, by date), so that Spark shuffles and sorts a series once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import YEAR_DAYS, doy_angle, season, tertile, three_way

VALUES = ["tmin", "tmax", "tavg"]
DAILY = ["diurnal_range", "delta_1", "delta_7", "roll_mean_7", "roll_std_7", "anomaly_z", "doy_sin", "doy_cos", "time_idx"]


def by_city() -> WindowSpec:
    return Window.partitionBy("city")


def by_date() -> WindowSpec:
    return by_city().orderBy("date")


def backwards() -> WindowSpec:
    return by_city().orderBy(F.desc("date"))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or ValueError if it lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df


def coerced(df: DataFrame) -> DataFrame:
    """Dates and numbers from whatever they come as; rows without a date go, NaN becomes null."""
    numbers = {c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double")) for c in VALUES}
    return require(df, ["city", "date", *VALUES]).withColumns({"date": F.col("date").try_cast("date"), **numbers}).na.drop(subset=["date"])


def keep_last(df: DataFrame, order: str, keys: tuple[str, ...] = ("city", "date")) -> DataFrame:
    """The row of each key that comes last by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def regular(df: DataFrame) -> DataFrame:
    """A row for every day from a city's first to its last, values null in the gaps.

    Each row is followed by the days up to the next one, so that no calendar has to be joined.
    """
    following = F.date_sub(F.lead("date").over(by_date()), 1)
    days = df.select("city", F.col("date").alias("__from"), *VALUES, F.coalesce(following, F.col("date")).alias("__to"))
    days = days.withColumn("date", F.explode(F.sequence("__from", "__to")))
    return days.select("city", "date", *(F.when(F.col("date") == F.col("__from"), F.col(c)).alias(c) for c in VALUES))


def interpolated(df: DataFrame, columns: list[str] = VALUES) -> DataFrame:
    """Gaps filled linearly by position, both ends with the nearest value."""
    place = F.datediff("date", F.lit("1970-01-01").cast("date"))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(place.alias("at"), F.col(c).alias("v"))) for c in columns}
    around = {f"__{side}_{c}": F.last(k, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c, k in known.items() for side, w in (("before", by_date()), ("after", backwards()))}
    out = df.withColumns(around)

    def value(c: str) -> Column:
        p, q = F.col(f"__before_{c}"), F.col(f"__after_{c}")
        between = p["v"] + (q["v"] - p["v"]) * (place - p["at"]) / (q["at"] - p["at"])
        return F.when(F.col(c).isNotNull(), F.col(c)).when(p.isNull(), q["v"]).when(q.isNull(), p["v"]).otherwise(between)

    return out.withColumns({c: value(c) for c in columns}).drop(*around)


def without_gaps(df: DataFrame, columns: list[str] = VALUES) -> DataFrame:
    """``df``; a query over it fails where a value is still missing, as in a city that has none at all."""
    return df.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"no values to fill {c} of "), "city")).cast("double")) for c in columns})


def rolling(name: str, value: Column, frame, rows: int = 7) -> dict[str, Column]:
    """Mean and sample deviation over the frame, null unless it is full."""
    full = F.count(value).over(frame) == rows
    return {f"{name}_mean_{rows}": F.when(full, F.avg(value).over(frame)), f"{name}_std_{rows}": F.when(full, F.stddev_samp(value).over(frame))}


def lag_diffs(df: DataFrame) -> DataFrame:
    v = F.col("tavg")
    return df.withColumns({"delta_1": v - F.lag("tavg", 1).over(by_date()), "delta_7": v - F.lag("tavg", 7).over(by_date())})


def rolling_stats(df: DataFrame) -> DataFrame:
    return df.withColumns(rolling("roll", F.col("tavg"), by_date().rowsBetween(-6, 0)))


def climatology_z(df: DataFrame) -> DataFrame:
    """Standard score within a city's day of the year; 0 where the deviation is null or 0. No further shuffle after by_date()."""
    doy = Window.partitionBy("city", F.dayofyear("date"))
    mean, sd = F.avg("tavg").over(doy), F.stddev_samp("tavg").over(doy)
    return df.withColumn("anomaly_z", F.when(F.coalesce(sd, F.lit(0.0)) > 0, (F.col("tavg") - mean) / sd).otherwise(0.0))


def calendar_features(df: DataFrame) -> DataFrame:
    start = F.min("date").over(by_city())
    return df.withColumns({"doy_sin": F.sin(doy_angle(F.col("date"))), "doy_cos": F.cos(doy_angle(F.col("date"))), "time_idx": F.datediff("date", start) / YEAR_DAYS})


def features(df: DataFrame) -> DataFrame:
    """All daily features over the regularised, interpolated series; nothing filled or dropped yet."""
    filled = interpolated(regular(df)).withColumn("diurnal_range", F.col("tmax") - F.col("tmin"))
    out = calendar_features(climatology_z(rolling_stats(lag_diffs(filled))))
    return out.select("city", "date", *VALUES, *DAILY)


def daily_features(df: DataFrame) -> DataFrame:
    """Features without the rows that lack one: the first seven of each city go."""
    return features(df).na.drop("any")


def filled_rolling(df: DataFrame) -> DataFrame:
    """Rolling values before the first full window as in it; lags and what is still null of the deviation as 0."""
    back = backwards().rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_date().rowsBetween(Window.unboundedPreceding, 0)
    fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.last(c, ignorenulls=True).over(ahead))
    return df.withColumns({"roll_mean_7": fill("roll_mean_7"), "roll_std_7": F.coalesce(fill("roll_std_7"), F.lit(0.0)), "delta_1": F.coalesce("delta_1", F.lit(0.0)), "delta_7": F.coalesce("delta_7", F.lit(0.0))})


def symbolic(df: DataFrame) -> DataFrame:
    """Bands by a city's exact tertiles, trend, anomaly and season classes."""
    cuts = lambda c: F.percentile(c, F.array(F.lit(1 / 3), F.lit(2 / 3))).over(by_city())
    out = df.withColumns({"__t": cuts("tavg"), "__d": cuts("diurnal_range")})
    return out.withColumns({
        "temp_band": tertile(F.col("tavg"), F.col("__t"), "cold", "mild", "hot"), "trend_class": three_way(F.col("delta_1"), "cooling", "stable", "warming"),
        "anomaly_class": three_way(F.col("anomaly_z"), "low", "normal", "high"), "diurnal_band": tertile(F.col("diurnal_range"), F.col("__d"), "low", "medium", "high"), "season_class": season(F.col("date")),
    }).drop("__t", "__d")


def enriched_features(df: DataFrame, order: str | None = None) -> DataFrame:
    """All rows, gaps of the features filled, with symbolic classes. ``order``: column by which the last of equal dates stays."""
    rows = coerced(df)
    if order:
        rows = keep_last(rows, order)
    return symbolic(filled_rolling(without_gaps(features(rows))))


def shifted_stats(df: DataFrame) -> DataFrame:
    """Lags of 1, 2 and 7 days and statistics of the seven days before the current one."""
    out = df.withColumns({f"tavg_lag_{n}": F.lag("tavg", n).over(by_date()) for n in (1, 2, 7)})
    return out.withColumns(rolling("tavg_roll", F.col("tavg"), by_date().rowsBetween(-7, -1)))


def locf(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last value carried forward; leading gaps stay."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
