"""Exact quantiles by distributed selection: histograms that narrow, in place of all distinct values of a group in one task.

A group's wanted ranks begin with the range of all its values. Each round counts the values of a range in ``BUCKETS`` equal steps,
with least and greatest value of each, and a rank goes on with the values of the step that it falls into; it is found when they are all
alike. Counters are summed in the tasks that read, so that what meets for a range is bounded, however many rows a group has. Each
round parts least from greatest value, so that ranges end; some three or four rounds are usual. Values are written once before the first
round: sums of floats come out a last digit apart when they are worked out again, and a value beside its range would be in none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored

BUCKETS = 1024


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """(*by, quantiles) of the non-null values of each group, interpolated between neighbours as ``percentile`` does it."""
    rows = stored(df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")), "values")
    place = F.array(*(F.lit(float(p)) * (F.col("__n") - 1) for p in probabilities))
    ranks = F.array_distinct(F.concat(F.transform(place, lambda x: F.floor(x)), F.transform(place, lambda x: F.ceil(x))))
    sizes = stored(rows.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")), "sizes")
    open_ = sizes.select(*by, "__lo", "__hi", F.lit(0).cast("long").alias("__below"), F.explode(ranks).alias("__k"))
    found: DataFrame | None = None
    span = F.col("__hi") - F.col("__lo")
    # halves keep the step finite where the range itself overflows
    step = F.least(F.lit(BUCKETS - 1), F.floor((F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * BUCKETS)).cast("int")
    while True:
        done = open_.where(F.col("__lo") == F.col("__hi")).select(*by, "__k", F.col("__lo").alias("__v"))
        found = done if found is None else found.unionByName(done)
        ranges = open_.where(F.col("__lo") < F.col("__hi"))
        if ranges.isEmpty():
            break
        own = rows.join(ranges.select(*by, "__lo", "__hi", "__below").distinct(), by).where((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))
        counts = own.groupBy(*by, "__lo", "__hi", "__below", F.when(span > 0, step).otherwise(0).alias("__step")).agg(F.count("*").alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        before = F.coalesce(F.sum("__c").over(Window.partitionBy(*by, "__lo", "__hi").orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        steps = counts.withColumn("__from", F.col("__below") + before)
        meets = steps.join(ranges, [*by, "__lo", "__hi", "__below"]).where((F.col("__k") >= F.col("__from")) & (F.col("__k") < F.col("__from") + F.col("__c")))
        open_ = stored(meets.select(*by, F.col("__least").alias("__lo"), F.col("__most").alias("__hi"), F.col("__from").alias("__below"), "__k"), "ranges")
    known = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias("__at"))
    at = lambda k: F.element_at("__at", k)
    between = F.transform(place, lambda x: F.when(F.floor(x) == F.ceil(x), at(F.floor(x))).otherwise((F.ceil(x) - x) * at(F.floor(x)) + (x - F.floor(x)) * at(F.ceil(x))))
    return sizes.join(known, by).select(*by, between.alias("quantiles"))


def bins_of(cube: DataFrame, n_bins: int) -> DataFrame:
    """(city, feature_idx, edges) as ``bins.edges`` has them by equal size, from selected quantiles."""
    found = exact_quantiles(cube, ["city", "feature_idx"], "num", [k / n_bins for k in range(n_bins + 1)])
    distinct = F.array_sort(F.array_distinct("quantiles"))
    ends = F.array(F.col("quantiles")[0], F.element_at("quantiles", -1))
    return found.select("city", "feature_idx", F.when(F.size(distinct) < 2, ends).otherwise(distinct).alias("edges"))
