"""Labels and summaries of triclusters and of year-month clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import month_name
from ..functions.tokens import feature_of, symbol_of, tokens_in
from .triclusters import FEATURES


def parsed(blocks: DataFrame) -> DataFrame:
    """(city, id, feature_name, symbol) of each token of each pattern."""
    flat = blocks.select("city", "id", F.explode(tokens_in(F.col("pattern_string"))).alias("token"))
    names = F.array(*map(F.lit, FEATURES))
    index = feature_of(F.col("token"))
    name = F.when(index < len(FEATURES), F.get(names, index)).otherwise(F.concat(F.lit("feature_"), index.cast("string")))
    return flat.select("city", "id", "token", name.alias("feature_name"), symbol_of(F.col("token")).alias("symbol"))


def signature(tokens: DataFrame, n: int = 5) -> DataFrame:
    """(city, id, rank, feature, direction, count): the n most frequent feature-symbol pairs."""
    counted = tokens.groupBy("city", "id", "feature_name", "symbol").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("city", "id").orderBy(F.desc("count"), "feature_name", "symbol"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n).select("city", "id", "rank", F.col("feature_name").alias("feature"), F.col("symbol").alias("direction"), "count")


def modes(tokens: DataFrame) -> DataFrame:
    """(city, id, modes): by feature its symbols, most frequent first, then by name."""
    counted = tokens.groupBy("city", "id", "feature_name", "symbol").agg(F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "symbol"))), lambda s: s["symbol"])
    each = counted.groupBy("city", "id", "feature_name").agg(ordered.alias("symbols"))
    return each.groupBy("city", "id").agg(F.map_from_entries(F.collect_list(F.struct("feature_name", "symbols"))).alias("modes"))


#: Label if a feature has a symbol at all, in order of precedence.
SEASONS = {"monsoon": "Monsoon regime", "winter": "Winter regime", "pre_monsoon": "Pre-monsoon regime", "post_monsoon": "Post-monsoon regime"}
#: Label by a feature's most frequent symbol, features in order of precedence.
LEADING = {
    "anomaly_class": {"high": "Warm anomaly regime", "low": "Cold anomaly regime"},
    "diurnal_band": {"high": "High diurnal variability regime", "low": "Low diurnal variability regime"},
    "trend_class": {"warming": "Warming transition regime", "cooling": "Cooling transition regime", "stable": "Stable regime"},
}
BY_TYPE = {"mixed": "Mixed weather regime", "symbolic": "Symbolic seasonal regime"}


def regime(symbols: Column, names: Column, kind: Column) -> Column:
    """A tricluster's label; ``symbols`` are its modes, ``names`` its features; the first rule that holds counts."""
    own = lambda f: F.coalesce(symbols[f], F.array().cast("array<string>"))
    has = lambda f: F.array_contains(names, f)
    any_ = lambda f, s: has(f) & F.array_contains(own(f), s)
    leads = lambda f, s: has(f) & (F.coalesce(F.get(own(f), F.lit(0)), F.lit("")) == s)
    rules: list[tuple[Column, str]] = [(any_("season_class", s), label) for s, label in SEASONS.items()]
    rules += [
        (leads("temp_band", "hot") & any_("trend_class", "warming"), "Hot warming regime"), (leads("temp_band", "hot"), "Hot regime"),
        (leads("temp_band", "cold") & any_("anomaly_class", "low"), "Cold anomaly regime"), (leads("temp_band", "cold"), "Cool regime"),
        (leads("temp_band", "mild") & any_("trend_class", "stable"), "Stable mild regime"),
    ]
    rules += [(leads(f, s), label) for f, labels in LEADING.items() for s, label in labels.items()]
    rules += [(kind == k, label) for k, label in BY_TYPE.items()]
    out = F.lit("Numeric weather regime")
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return out


def labelled(blocks: DataFrame) -> DataFrame:
    """``blocks`` with their regime's label."""
    return blocks.join(modes(parsed(blocks)), ["city", "id"], "left").withColumn("label", regime(F.coalesce("modes", F.create_map().cast("map<string,array<string>>")), F.col("feature_names"), F.col("type"))).drop("modes")


def legacy_label(high: Column, low: Column) -> Column:
    """A year-month cluster's label by the features of its signature that are high and low (arrays of names)."""
    up, down = (lambda f: F.array_contains(high, f)), (lambda f: F.array_contains(low, f))
    return (
        F.when(down("diurnal_mean") & down("tavg_std") & down("roll_std_mean"), "Stable cloudy-like regime")
        .when(up("tavg_mean") & up("diurnal_mean"), "Dry heat regime")
        .when(up("delta_1_mean") | up("roll_std_mean") | up("tavg_std"), "Transition / volatile regime")
        .when(down("tavg_mean"), "Cool season regime")
        .otherwise("Seasonal regime")
    )


def seasons_of(blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """(city, id, months, years) by the center dates of a block's windows."""
    flat = blocks.select("city", "id", F.explode("rows").alias("window_id")).join(meta, ["city", "window_id"])
    day = F.coalesce("center_date", "start_date", "end_date")
    return flat.groupBy("city", "id").agg(F.array_sort(F.collect_set(F.month(day))).alias("months"), F.array_sort(F.collect_set(F.year(day))).alias("years"))


def cards(blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """``blocks`` with months, months_names and years of their windows, and signature_top5 (feature, direction, count)."""
    top = F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature", "direction", "count"))), lambda s: F.struct(s["feature"].alias("feature"), s["direction"].alias("direction"), s["count"].alias("count")))
    signatures = signature(parsed(blocks)).groupBy("city", "id").agg(top.alias("signature_top5"))
    out = blocks.join(seasons_of(blocks, meta), ["city", "id"], "left").join(signatures, ["city", "id"], "left")
    return out.withColumn("months_names", F.transform("months", month_name))


def ranked(blocks: DataFrame) -> DataFrame:
    """Places by coherence (the dashboard's order), by support and by volume."""
    w = Window.partitionBy("city")
    by = {"by_coherence": [F.col("hvar3"), F.desc("support"), F.desc("shape.volume")], "by_support": [F.desc("support"), F.col("hvar3")], "by_volume": [F.desc("shape.volume"), F.col("hvar3")]}
    return blocks.withColumns({k: F.row_number().over(w.orderBy(*v, "id")) for k, v in by.items()})


def summary(blocks: DataFrame) -> DataFrame:
    """By city: number of triclusters and of windows that support one, and the five first ids of each order."""
    places = ranked(blocks)
    first = lambda place: F.transform(F.array_sort(F.collect_list(F.when(F.col(place) <= 5, F.struct(place, "id")))), lambda s: s["id"])
    ids = places.groupBy("city").agg(F.count("*").alias("n_triclusters"), first("by_coherence").alias("top_coherent_ids"), first("by_support").alias("most_supported_ids"), first("by_volume").alias("largest_volume_ids"))
    windows = blocks.select("city", F.explode("rows").alias("w")).groupBy("city").agg(F.count_distinct("w").alias("n_supported_windows"))
    return ids.join(windows, "city")
