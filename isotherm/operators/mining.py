"""Pattern mining over windows.

An item is a (feature, offset, symbol) and can be at one place of a window only, so that a sequence contains a pattern just
if the window holds all its items. A closed set is the set of items common to some windows.

Runs of successive offsets in closed sets are searched for by themselves (``run_search``), without a bound on their number.

Closed sets as a whole are found by intersecting arrays of windows level by level. Levels are joins by city, what was seen
before is taken out by an anti-join, and each level is written before the next, so nothing is gathered on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import pattern_string, token
from ..sources.storage import numbered, stored
from . import run_search


def items(cells: DataFrame) -> DataFrame:
    """Discretised cells with their token."""
    return cells.withColumn("token", token(F.col("feature_idx"), F.col("context_idx"), F.col("symbol")))


def sequences(tokens: DataFrame) -> DataFrame:
    """(city, window_id, itemsets): sorted tokens by offset, in order of offsets."""
    sets = tokens.groupBy("city", "window_id", "context_idx").agg(F.array_sort(F.collect_list("token")).alias("items"))
    ordered = F.array_sort(F.collect_list(F.struct("context_idx", "items")))
    return sets.groupBy("city", "window_id").agg(F.transform(ordered, lambda s: s["items"]).alias("itemsets"))


def dictionary(tokens: DataFrame) -> DataFrame:
    """(city, token, item_id): ids from 1 in order of first appearance (window, offset, token)."""
    first = tokens.groupBy("city", "token").agg(F.min(F.struct("window_id", "context_idx")).alias("first"))
    return first.select("city", "token", F.row_number().over(Window.partitionBy("city").orderBy("first", "token")).alias("item_id"))


def min_support(n: int, min_rows: int, mode: str = "percent") -> int:
    """``percent``: as whole percent of n, rounded up, and back; ``exact``: min_rows."""
    if mode == "exact":
        return min_rows
    percent = max(1, math.ceil(100 * min_rows / max(n, 1)))
    return max(min_rows, -(-percent * n // 100))


def supports(tokens: DataFrame, min_rows: int, mode: str = "percent", min_share: float = 0.0) -> DataFrame:
    """(city, token, context_idx, feature_idx, tids, support, needed) of the frequent items.

    Frequent is what ``min_rows`` windows hold, by ``mode`` (see ``min_support``), and a share of ``min_share`` of a city's windows.
    """
    n = tokens.groupBy("city").agg(F.count_distinct("window_id").alias("n"))
    percent = F.greatest(F.lit(1), F.ceil(100 * F.lit(min_rows) / F.col("n")))
    needed = F.lit(min_rows) if mode == "exact" else F.greatest(F.lit(min_rows), F.ceil(percent * F.col("n") / 100)).cast("int")
    needed = F.greatest(needed, F.ceil(F.col("n") * min_share - 1e-9).cast("int"))
    each = tokens.groupBy("city", "token", "context_idx", "feature_idx").agg(F.array_sort(F.collect_set("window_id")).alias("tids"))
    out = each.join(n.select("city", needed.alias("needed")), "city").withColumn("support", F.size("tids"))
    return out.where(F.col("support") >= F.col("needed")).select("city", "token", "context_idx", "feature_idx", "tids", "support", "needed")


def pair_supports(frequent: DataFrame) -> DataFrame:
    """(city, first, second, support) of frequent pairs; pairs are counted by window rather than formed of all items."""
    flat = frequent.select("city", "token", "needed", F.explode("tids").alias("tid"))
    left, right = flat.withColumnRenamed("token", "first"), flat.drop("needed").withColumnRenamed("token", "second")
    pairs = left.join(right, ["city", "tid"]).where(F.col("first") < F.col("second"))
    return pairs.groupBy("city", "first", "second", "needed").agg(F.count("*").alias("support")).where(F.col("support") >= F.col("needed")).drop("needed")


def closed_sets(frequent: DataFrame, max_sets: int = 200_000) -> tuple[DataFrame, list[str]]:
    """(city, tids) of every closed set of frequent items, and the cities whose search ended past ``max_sets`` sets of their own (then the sets of whole levels)."""
    own = stored(frequent.select("city", "tids", "needed").distinct())
    found = frontier = own.select("city", "tids", "needed")
    cut: list[str] = []
    while True:
        other = own.select("city", F.col("tids").alias("more"))
        new = frontier.join(other, "city").select("city", F.array_sort(F.array_intersect("tids", "more")).alias("tids"), "needed")
        new = new.where(F.size("tids") >= F.col("needed")).distinct().join(found, ["city", "tids"], "left_anti")
        frontier = stored(new)
        if not frontier.count():
            return found.select("city", "tids"), sorted(cut)
        found = found.unionByName(frontier)
        cut += [r["city"] for r in found.groupBy("city").count().where(F.col("count") > max_sets).join(frontier.select("city").distinct(), "city", "left_semi").collect()]
        frontier = frontier.where(~F.col("city").isin(cut))


def closures(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """(city, tids, token, context_idx, feature_idx): the items common to each set of windows."""
    flat = frequent.select("city", "token", "context_idx", "feature_idx", F.explode("tids").alias("tid"))
    wide = sets.select("city", "tids", F.explode("tids").alias("tid"))
    counted = wide.join(flat, ["city", "tid"]).groupBy("city", "tids", "token", "context_idx", "feature_idx").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") == F.size("tids")).drop("n")


def patterns(frequent: DataFrame, min_offsets: int = 1, contiguous: bool = True, max_sets: int = 200_000) -> tuple[DataFrame, list[str]]:
    """Closed patterns (city, pattern_id, pattern_string, itemsets, support, subject_ids), and the cities whose search was cut.

    ``contiguous``: a closed set falls into its runs of successive offsets, of which those of ``min_offsets`` or more are
    patterns; their windows are all that hold their items. That search is never cut; ``max_sets`` bounds the other one.
    """
    frequent = stored(frequent, "items")
    if contiguous:
        found, own = run_search.runs(frequent, min_offsets=min_offsets)
        placed, cut = numbered(found.select("city", "held", "windows"), ["city"], ["held", "windows"], "pattern_id"), []
        rows = run_search.decoded(placed, own, ["pattern_id"]).select("city", "pattern_id", F.arrays_zip("context_idx", "token").alias("items"), "subject_ids")
    else:
        sets, cut = closed_sets(frequent, max_sets)
        members = closures(sets, frequent)
        grouped = members.groupBy("city", "tids").agg(F.array_sort(F.collect_list(F.struct("context_idx", "token"))).alias("items"), F.count_distinct("context_idx").alias("k"))
        rows = numbered(grouped.where(F.col("k") >= min_offsets).select("city", "items", F.col("tids").alias("subject_ids")), ["city"], ["items"], "pattern_id")
    return rows.select("city", F.col("pattern_id").cast("int").alias("pattern_id"), *strings(), F.size("subject_ids").alias("support"), "subject_ids"), cut


def strings() -> list[Column]:
    """pattern_string and itemsets of ``items``, an array of (context_idx, token)."""
    offsets = F.array_sort(F.array_distinct(F.transform("items", lambda i: i["context_idx"])))
    itemsets = F.transform(offsets, lambda k: F.transform(F.filter("items", lambda i: i["context_idx"] == k), lambda i: i["token"]))
    return [pattern_string(itemsets).alias("pattern_string"), itemsets.alias("itemsets")]


def frequent_sets(frequent: DataFrame, max_items: int = 3) -> DataFrame:
    """(city, items, tids): all frequent sets up to ``max_items`` items; for small data, as their number is exponential."""
    found = level = frequent.select("city", F.array("token").alias("items"), "tids", "needed")
    single = frequent.select("city", "token", F.col("tids").alias("more"))
    for _ in range(max_items - 1):
        joined = level.join(single, "city").where(F.col("token") > F.element_at("items", -1))
        level = joined.select("city", F.concat("items", F.array("token")).alias("items"), F.array_intersect("tids", "more").alias("tids"), "needed").where(F.size("tids") >= F.col("needed"))
        found = found.unionByName(level)
    return found.drop("needed")
