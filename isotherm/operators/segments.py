"""Daily features of very long series: a series is cut by date ranges that finish alone.

The plans of ``series`` sort a city's rows in one task. Here a city falls into segments of some days; each tells in one row what its
neighbours need (first day, first and last known value), these rows are combined over the city, and what comes of it is joined back:
the next segment's first day to fill a gap, the last known value to go on with. Lags and rolling values look back at most seven days,
so that each segment gets the last days of the one before along with its own. What stands over a whole city are sums (day of the year,
first day) and selected quantiles. Results are those of ``series``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import YEAR_DAYS, doy_angle, season, tertile, three_way
from ..sources.storage import stored
from .quantiles import exact_quantiles
from .series import DAILY, VALUES, coerced, keep_last, rolling, without_gaps

#: Days of a segment, and days that a feature looks back.
DAYS, BACK = 3650, 7


def _day() -> Column:
    return F.datediff("date", F.lit("1970-01-01").cast("date"))


def _segment(days: int) -> Column:
    return F.floor(_day() / days)


def _own() -> WindowSpec:
    return Window.partitionBy("city", "segment").orderBy("date")


def _beside(forward: bool) -> WindowSpec:
    """The segments before, nearest last; or those after."""
    return Window.partitionBy("city").orderBy("segment" if not forward else F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)


def regular(df: DataFrame, days: int = DAYS) -> DataFrame:
    """A row for every day from a city's first to its last, with its segment; values null in the gaps."""
    rows = df.select("city", "date", *VALUES).withColumn("segment", _segment(days))
    ends = rows.groupBy("city", "segment").agg(F.min("date").alias("__first"))
    ends = ends.withColumn("__next", F.last("__first").over(_beside(True))).drop("__first")
    following = F.coalesce(F.lead("date").over(_own()), F.col("__next"))
    spread = rows.join(ends, ["city", "segment"]).select("city", F.col("date").alias("__from"), *VALUES, F.coalesce(F.date_sub(following, 1), F.col("date")).alias("__to"))
    spread = spread.withColumn("date", F.explode(F.sequence("__from", "__to")))
    return spread.select("city", "date", *(F.when(F.col("date") == F.col("__from"), F.col(c)).alias(c) for c in VALUES)).withColumn("segment", _segment(days))


def interpolated(df: DataFrame) -> DataFrame:
    """Gaps of segmented rows filled linearly by position, both ends of a city with the nearest value."""
    known = {c: F.when(F.col(c).isNotNull(), F.struct(_day().alias("at"), F.col(c).alias("v"))) for c in VALUES}
    told = df.groupBy("city", "segment").agg(*(f(k).alias(f"__{side}_{c}") for c, k in known.items() for side, f in (("low", F.min), ("high", F.max))))
    carried = {f"__from_{c}": F.last(f"__high_{c}", ignorenulls=True).over(_beside(False)) for c in VALUES} | {f"__to_{c}": F.last(f"__low_{c}", ignorenulls=True).over(_beside(True)) for c in VALUES}
    told = told.select("city", "segment", *(v.alias(k) for k, v in carried.items()))
    back = Window.partitionBy("city", "segment").orderBy(F.desc("date"))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    around = {f"__{side}_{c}": F.last(k, ignorenulls=True).over(so_far(w)) for c, k in known.items() for side, w in (("before", _own()), ("after", back))}
    out = df.join(told, ["city", "segment"]).withColumns(around)

    def value(c: str) -> Column:
        p, q = F.coalesce(f"__before_{c}", f"__from_{c}"), F.coalesce(f"__after_{c}", f"__to_{c}")
        between = p["v"] + (q["v"] - p["v"]) * (_day() - p["at"]) / (q["at"] - p["at"])
        return F.when(F.col(c).isNotNull(), F.col(c)).when(p.isNull(), q["v"]).when(q.isNull(), p["v"]).otherwise(between)

    return out.select("city", "date", "segment", *(value(c).alias(c) for c in VALUES))


def features(df: DataFrame, days: int = DAYS) -> DataFrame:
    """All daily features of every day, nothing filled or dropped yet; ``days`` is at least BACK."""
    filled = interpolated(regular(df, days))
    # a segment's last days go to the next one, too
    late = F.pmod(_day(), F.lit(days)) >= days - BACK
    parts = filled.withColumn("__part", F.explode(F.when(late, F.array("segment", F.col("segment") + 1)).otherwise(F.array("segment"))))
    own, v = Window.partitionBy("city", "__part").orderBy("date"), F.col("tavg")
    parts = parts.withColumns({"delta_1": v - F.lag("tavg", 1).over(own), "delta_7": v - F.lag("tavg", 7).over(own), **rolling("roll", v, own.rowsBetween(-6, 0))})
    parts = parts.where(F.col("__part") == F.col("segment")).drop("__part", "segment").withColumn("doy", F.dayofyear("date"))
    climate = filled.groupBy("city", F.dayofyear("date").alias("doy")).agg(F.avg("tavg").alias("__mean"), F.stddev_samp("tavg").alias("__sd"))
    first = df.groupBy("city").agg(F.min("date").alias("__start"))
    out = parts.join(climate, ["city", "doy"]).join(first, "city")
    return out.select("city", "date", *VALUES, *(c.alias(k) for k, c in {
        "diurnal_range": F.col("tmax") - F.col("tmin"), "delta_1": F.col("delta_1"), "delta_7": F.col("delta_7"), "roll_mean_7": F.col("roll_mean_7"), "roll_std_7": F.col("roll_std_7"),
        "anomaly_z": F.when(F.coalesce("__sd", F.lit(0.0)) > 0, (v - F.col("__mean")) / F.col("__sd")).otherwise(0.0), "doy_sin": F.sin(doy_angle(F.col("date"))), "doy_cos": F.cos(doy_angle(F.col("date"))), "time_idx": F.datediff("date", "__start") / YEAR_DAYS,
    }.items()))


def daily_features(df: DataFrame, days: int = DAYS) -> DataFrame:
    """Features without the rows that lack one."""
    return features(df, days).na.drop("any", subset=[*VALUES, *DAILY])


def enriched_features(df: DataFrame, order: str | None = None, days: int = DAYS) -> DataFrame:
    """All rows, gaps of the features filled, with symbolic classes by a city's exact tertiles."""
    rows = coerced(df)
    if order:
        rows = keep_last(rows, order)
    # written once, so that the cuts are those of the very values that are held against them
    found = stored(without_gaps(features(rows, days)), "features")
    # of a series without gaps only its first days lack rolling values, and take those of its first full window
    full = found.where(F.col("roll_mean_7").isNotNull()).groupBy("city").agg(F.min_by("roll_mean_7", "date").alias("__m"), F.min_by("roll_std_7", "date").alias("__s"))
    out = found.join(full, "city", "left").withColumns({"roll_mean_7": F.coalesce("roll_mean_7", "__m"), "roll_std_7": F.coalesce("roll_std_7", "__s", F.lit(0.0)), "delta_1": F.coalesce("delta_1", F.lit(0.0)), "delta_7": F.coalesce("delta_7", F.lit(0.0))}).drop("__m", "__s")
    for name, value in (("__t", "tavg"), ("__d", "diurnal_range")):
        out = out.join(exact_quantiles(found, ["city"], value, [1 / 3, 2 / 3]).withColumnRenamed("quantiles", name), "city", "left")
    return out.withColumns({
        "temp_band": tertile(F.col("tavg"), F.col("__t"), "cold", "mild", "hot"), "trend_class": three_way(F.col("delta_1"), "cooling", "stable", "warming"),
        "anomaly_class": three_way(F.col("anomaly_z"), "low", "normal", "high"), "diurnal_band": tertile(F.col("diurnal_range"), F.col("__d"), "low", "medium", "high"), "season_class": season(F.col("date")),
    }).drop("__t", "__d")


def longest_run(df: DataFrame, holds: Column, days: int = DAYS) -> DataFrame:
    """(city, length, start, end) of each city's longest run of successive rows for which ``holds``; the first of equal ones; length 0 and nulls where none does.

    Runs are found in segments; those that reach a segment's border are put together there, one row for each run and segment.
    """
    rows = df.select("city", "date", F.coalesce(holds, F.lit(False)).alias("ok")).withColumn("segment", _segment(days))
    place = F.row_number().over(_own())
    island = place - F.row_number().over(Window.partitionBy("city", "segment", "ok").orderBy("date"))
    marked = rows.withColumn("at", place).withColumn("island", island)
    sizes = rows.groupBy("city", "segment").agg(F.count("*").alias("n"))
    runs = marked.where("ok").groupBy("city", "segment", "island").agg(F.count("*").alias("length"), F.min("date").alias("start"), F.max("date").alias("end"), F.min("at").alias("lo"), F.max("at").alias("hi")).join(sizes, ["city", "segment"])
    # a run goes on if the segment before has a run up to its last row; segments without rows don't part runs
    beside = sizes.select("city", "segment", F.lag("segment").over(Window.partitionBy("city").orderBy("segment")).alias("before"))
    edges = runs.where((F.col("lo") == 1) | (F.col("hi") == F.col("n"))).join(beside, ["city", "segment"])
    by = Window.partitionBy("city").orderBy("segment", "lo")
    touches = (F.col("lo") == 1) & (F.lag("segment").over(by) == F.col("before")) & (F.lag("hi").over(by) == F.lag("n").over(by))
    joined = edges.withColumn("group", F.sum(F.when(F.coalesce(touches, F.lit(False)), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("city", "group").agg(F.sum("length").alias("length"), F.min("start").alias("start"), F.max("end").alias("end")).drop("group")
    whole = runs.where((F.col("lo") > 1) & (F.col("hi") < F.col("n"))).select("city", "length", "start", "end").unionByName(joined.select("city", "length", "start", "end"))
    best = whole.groupBy("city").agg(F.max_by(F.struct("length", "start", "end"), F.struct("length", (-F.unix_date("start")).alias("o"))).alias("b"))
    return rows.select("city").distinct().join(best, "city", "left").select("city", F.coalesce("b.length", F.lit(0)).alias("length"), F.col("b.start").alias("start"), F.col("b.end").alias("end"))
