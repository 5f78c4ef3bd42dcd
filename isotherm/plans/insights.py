"""The insights of a city as one record, and the analysis from history to insights for all cities at once."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import month_name
from ..operators import bins, mining, regimes, rollup, run_search, series, triclusters, windows
from ..sources.sinks import as_json
from ..sources.storage import numbered, stored


@dataclass(frozen=True)
class Config:
    """Sizes and thresholds of the pattern search; always given along, as they belong to a result."""

    window: int = 14
    stride: int = 14
    min_rows: int = 8
    min_features: int = 2
    min_offsets: int = 2
    n_bins: int = 3
    binning: str = "eq_size"
    coherence: float = 0.4
    overlap: float | None = 0.7
    carry_forward: bool = False
    contiguous: bool = True
    support_mode: str = "percent"
    max_sets: int = 200_000
    min_share: float = 0.0


def cells(weather: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Windows of the enriched series and their long cube."""
    rows = windows.hopping(series.enriched_features(weather), config.window, config.stride)
    cube = windows.long_cube(rows)
    if config.carry_forward:
        for value in ("num", "sym"):
            cube = series.locf(cube, ["city", "window_id", "feature_idx"], "context_idx", value)
    return rows, cube


def find_triclusters(weather: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame, list[str]]:
    """Labelled triclusters of every city in order, their windows' dates, and the cities whose search was cut."""
    rows, cube = cells(weather, config)
    cube = stored(cube, "cube")
    symbols = bins.discretised(cube, bins.edges(cube, config.n_bins, config.binning))
    frequent = mining.supports(mining.items(symbols), config.min_rows, config.support_mode, config.min_share)
    if config.contiguous:
        kept, cut = run_triclusters(frequent, cube, config), []
    else:
        found, cut = mining.patterns(frequent, config.min_offsets, False, config.max_sets)
        blocks = stored(triclusters.from_patterns(found, config.min_rows, config.min_features, config.min_offsets), "blocks")
        scored = triclusters.described(triclusters.coherence(blocks, cube)).where(F.col("hvar3") <= config.coherence)
        kept = triclusters.overlap_filtered(stored(triclusters.deduplicated(scored), "scored"), config.overlap)
    return triclusters.ordered(regimes.labelled(kept)), windows.window_midpoints(rows), cut


def run_triclusters(frequent: DataFrame, cube: DataFrame, config: Config) -> DataFrame:
    """Triclusters of closed runs: scored where they are found, told apart as bits, and only then spelled out.

    Runs of the same windows and offsets are the same run, so that none is found twice.
    """
    found, own = run_search.runs(stored(frequent, "items"), cube, config.min_features, config.min_offsets, config.coherence)
    key = ["held", "windows"]
    if config.overlap is not None:
        found = found.join(triclusters.apart(found, key, config.overlap), ["city", *key], "left_semi")
    placed = numbered(found.select("city", *key, "hvar3"), ["city"], key, "id").withColumn("id", F.col("id").cast("int"))
    spelled = run_search.decoded(placed, own, ["id", "hvar3"]).select("city", F.col("id").alias("pattern_id"), "hvar3", F.arrays_zip("context_idx", "token").alias("items"), "subject_ids")
    wide = stored(spelled.select("city", "pattern_id", "hvar3", *mining.strings(), F.size("subject_ids").alias("support"), "subject_ids"), "patterns")
    blocks = triclusters.from_patterns(wide, 1, config.min_features, config.min_offsets)
    return triclusters.described(blocks.join(wide.select("city", F.col("pattern_id").alias("id"), "hvar3"), ["city", "id"]))


def summaries(weather: DataFrame) -> DataFrame:
    """A row for each city: extreme months, trend, streaks, anomalies and data health."""
    daily = series.daily_features(weather)
    months = rollup.monthly(daily)
    streak = lambda name, holds: rollup.longest_run(daily, holds).select("city", F.struct("length", "start", "end").alias(name))
    out = rollup.health(daily, weather)
    for part in (rollup.extreme_months(rollup.baseline(months)), rollup.trend(months), rollup.anomaly_days(daily).withColumnRenamed("n", "anomaly_days"), streak("warm_streak", F.col("anomaly_z") >= 2), streak("cold_streak", F.col("anomaly_z") <= -2)):
        out = out.join(part, "city")
    return out


def payload(weather: DataFrame, config: Config | None = None) -> DataFrame:
    """(city, payload): summaries, baseline and extreme days, with ``config`` also patterns, as JSON."""
    daily = series.daily_features(weather)
    listed = lambda df, name, *cols: df.groupBy("city").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    base = rollup.baseline(rollup.monthly(daily)).withColumn("month_name", month_name(F.col("month")))
    out = summaries(weather).join(listed(base, "monthly_baseline", "month", "month_name", "tavg_mean", "tavg_std", "diurnal_mean"), "city")
    for name, by in (("top_hot_days", F.desc("tavg")), ("top_cold_days", F.asc("tavg")), ("top_anomaly_days", F.desc(F.abs("anomaly_z")))):
        out = out.join(listed(rollup.top_days(daily, by), name, "rank", "date", "tavg", "anomaly_z"), "city")
    if config:
        blocks, meta, cut = find_triclusters(weather, config)
        out = with_patterns(out, stored(blocks, "triclusters"), meta, config, cut)
    return as_json(out, ["city"])


#: What the first clusters of the dashboard's order are told by.
CARD = ["label", "years", "months", "months_names", "signature_top5", "support", "hvar3", "type"]


def with_patterns(out: DataFrame, blocks: DataFrame, meta: DataFrame, config: Config, cut: list[str]) -> DataFrame:
    """``out`` with method, engine, config, the summary and the cards of the first twelve triclusters; all of them are a table of their own."""
    first = regimes.ranked(blocks).where(F.col("by_coherence") <= 12)
    told = regimes.cards(first, meta).groupBy("city").agg(F.array_sort(F.collect_list(F.struct("by_coherence", *CARD))).alias("c"))
    told = told.select("city", F.transform("c", lambda s: F.struct(*(s[k].alias(k) for k in CARD))).alias("clusters"))
    given = F.struct(*((F.lit(v) if v is not None else F.lit(None).cast("double")).alias(k) for k, v in asdict(config).items()))
    engine = F.struct(F.lit("closed runs" if config.contiguous else "closed sets").alias("search"), F.col("city").isin(cut).alias("truncated"))
    out = out.join(regimes.summary(blocks), "city", "left").join(told, "city", "left")
    return out.withColumns({"method": F.lit("triclusters of closed patterns"), "engine": engine, "config": given, "truncated": F.col("city").isin(cut)})
