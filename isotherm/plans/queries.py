"""Registered queries over the test tables, each with its SQL for another engine where SQL can express it.

Floats are compared after ``round(x + 1e-9, 6) + 0.0`` on both sides, which takes half-way cases and -0.0 out of the way.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, tokens
from ..operators import bins, forecast, mining, quantiles, regimes, rollup, segments, sequences, series, triclusters, windows, yearly_clusters
from ..schemas import NUMERIC, SYMBOLIC
from ..sources import archive_source as archive
from ..sources import sinks, tables
from ..sources.storage import noted, shared_dir, stored
from ..streaming.incremental import windowed_counts
from .insights import Config, cells, find_triclusters, payload, summaries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Windows that cover every day, of all queries on cubes, items and blocks.
LIVE = Config()
#: The same windows with patterns held by a tenth or a fifth of them; the number of patterns grows steeply as fewer are asked for.
TENTH = Config(min_share=0.1)
FIFTH = Config(min_share=0.2)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def even(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in columns or df.columns))


def r(*columns: str) -> str:
    return ", ".join(f"round({c} + 1e-9, 6) + 0.0 as {c}" for c in columns)


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


VALUES, V = series.VALUES, ", ".join(series.VALUES)
WEATHER = """weather as (select r_name as city, cast(o_orderdate as date) as date, min(o_totalprice) / 10000 as tmin, max(o_totalprice) / 10000 as tmax, avg(o_totalprice) / 10000 as tavg
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2)"""
REGULAR = """cal as (select city, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from weather group by city),
reg as (select city, date, tmin, tmax, tavg from cal left join weather using (city, date))"""
_B, _A = "partition by city order by date rows between unbounded preceding and current row", "partition by city order by date rows between current row and unbounded following"
FILLED = (
    "num as (select *, row_number() over (partition by city order by date) as rn from reg),\naround as (select *, "
    + ", ".join(f"last_value({c} ignore nulls) over ({_B}) as p_{c}, first_value({c} ignore nulls) over ({_A}) as q_{c}, max(case when {c} is not null then rn end) over ({_B}) as a_{c}, min(case when {c} is not null then rn end) over ({_A}) as b_{c}" for c in VALUES)
    + " from num),\nfilled as (select city, date, "
    + ", ".join(f"case when {c} is not null then {c} when p_{c} is null then q_{c} when q_{c} is null then p_{c} else p_{c} + (q_{c} - p_{c}) * (rn - a_{c}) / (b_{c} - a_{c}) end as {c}" for c in VALUES)
    + " from around)"
)
FEATURES = """doy as (select city, dayofyear(date) as d, avg(tavg) as m, case when count(*) > 1 then stddev_samp(tavg) end as s from filled group by 1, 2),
feat as (select f.city, date, tmin, tmax, tavg, tmax - tmin as diurnal_range, tavg - lag(tavg, 1) over w as delta_1, tavg - lag(tavg, 7) over w as delta_7,
  case when count(tavg) over v = 7 then avg(tavg) over v end as roll_mean_7, case when count(tavg) over v = 7 then stddev_samp(tavg) over v end as roll_std_7,
  case when coalesce(s, 0) > 0 then (tavg - m) / s else 0 end as anomaly_z, sin(2 * pi() * dayofyear(date) / 365.25) as doy_sin, cos(2 * pi() * dayofyear(date) / 365.25) as doy_cos,
  date_diff('day', min(date) over (partition by f.city), date) / 365.25 as time_idx
  from filled f join doy on doy.city = f.city and d = dayofyear(date) window w as (partition by f.city order by date), v as (partition by f.city order by date rows between 6 preceding and current row))"""
DAILY = "daily as (select * from feat where delta_1 is not null and delta_7 is not null and roll_mean_7 is not null and roll_std_7 is not null)"
MONTHLY = """monthly as (select city, cast(year(date) as integer) as year, cast(month(date) as integer) as month, avg(tavg) as tavg_mean, coalesce(case when count(*) > 1 then stddev_samp(tavg) end, 0) as tavg_std,
  avg(diurnal_range) as diurnal_mean, avg(roll_std_7) as roll_std_mean, avg(anomaly_z) as anomaly_mean, avg(delta_1) as delta_1_mean from daily group by 1, 2, 3)"""
ENRICHED = f"""back as (select * replace (coalesce(first_value(roll_mean_7 ignore nulls) over ({_A}), last_value(roll_mean_7 ignore nulls) over ({_B})) as roll_mean_7,
  coalesce(first_value(roll_std_7 ignore nulls) over ({_A}), last_value(roll_std_7 ignore nulls) over ({_B}), 0) as roll_std_7, coalesce(delta_1, 0) as delta_1, coalesce(delta_7, 0) as delta_7) from feat),
cuts as (select city, quantile_cont(tavg, [1.0 / 3, 2.0 / 3]) as t, quantile_cont(diurnal_range, [1.0 / 3, 2.0 / 3]) as g from back group by city),
rich as (select back.*, case when tavg <= t[1] then 'cold' when tavg <= t[2] then 'mild' else 'hot' end as temp_band, case when delta_1 < -1 then 'cooling' when delta_1 > 1 then 'warming' else 'stable' end as trend_class,
  case when anomaly_z < -1 then 'low' when anomaly_z > 1 then 'high' else 'normal' end as anomaly_class, case when diurnal_range <= g[1] then 'low' when diurnal_range <= g[2] then 'medium' else 'high' end as diurnal_band,
  case when month(date) in (12, 1, 2) then 'winter' when month(date) between 3 and 5 then 'pre_monsoon' when month(date) between 6 and 9 then 'monsoon' else 'post_monsoon' end as season_class from back join cuts using (city))"""
TO_FEATURES = with_(WEATHER, REGULAR, FILLED, FEATURES)
TO_DAILY = with_(WEATHER, REGULAR, FILLED, FEATURES, DAILY)
TO_MONTHLY = with_(WEATHER, REGULAR, FILLED, FEATURES, DAILY, MONTHLY)
TO_ENRICHED = with_(WEATHER, REGULAR, FILLED, FEATURES, ENRICHED)


def hop(size: int, stride: int) -> str:
    return f"""placed as (select *, row_number() over (partition by city order by date) - 1 as rn, count(*) over (partition by city) as n from rich),
hops as (select * exclude (rn, n, k), cast(k as integer) as window_id, cast(rn - k * {stride} as integer) as context_idx
  from (select *, unnest(range(greatest(0, cast(ceil((rn - {size - 1}) / {stride}) as bigint)), least(rn // {stride}, (n - {size}) // {stride}) + 1)) as k from placed where n >= {size}))"""


CUBE = (
    "cube as ("
    + " union all ".join([f"select city, window_id, context_idx, {k} as feature_idx, cast({c} as double) as num, cast(null as varchar) as sym from hops" for k, c in enumerate(NUMERIC)] + [f"select city, window_id, context_idx, {k}, cast(null as double), coalesce({c}, 'missing') from hops" for k, c in enumerate(SYMBOLIC, len(NUMERIC))])
    + ")"
)


def cut_points(n: int) -> str:
    return f"""edges as (select city, feature_idx, case when len(e) < 2 then [low, high] else e end as edges from (
  select city, feature_idx, list_sort(list_distinct(quantile_cont(num, [{', '.join(f'{k}.0 / {n}' for k in range(n + 1))}]))) as e, min(num) as low, max(num) as high from cube where num is not null group by 1, 2))"""


BINNED = """cells as (select city, window_id, context_idx, feature_idx, coalesce(sym, case when num is not null then case when coalesce(len(edges), 0) < 2 then 'bin0' else 'bin' || len(list_filter(edges[2:-2], lambda e: round(e, 9) <= round(num, 9))) end end) as symbol
  from cube left join edges using (city, feature_idx)), items as (select *, 'f' || feature_idx || '_' || context_idx || '#' || symbol as token from cells where symbol is not null and trim(symbol) <> '')"""
FREQUENT = """size as (select city, count(distinct window_id) as n from items group by city),
frequent as (select city, token, context_idx, feature_idx, tids, len(tids) as support, needed from (select city, token, context_idx, feature_idx, list_sort(list(distinct window_id)) as tids from items group by all)
  join (select city, greatest(8, ceil(greatest(1, ceil(800.0 / n)) * n / 100)) as needed from size) using (city) where len(tids) >= needed)"""
TO_HOPS = TO_ENRICHED.rstrip() + ",\n" + hop(LIVE.window, LIVE.stride)
TO_CUBE = TO_HOPS + ",\n" + CUBE
TO_ITEMS = TO_CUBE + ",\n" + cut_points(LIVE.n_bins) + ",\n" + BINNED
TO_FREQUENT = TO_ITEMS + ",\n" + FREQUENT


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.weather_daily(spark, sf_dir)


def daily_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily_features(weather(spark, sf_dir))


def monthly_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.monthly(daily_of(spark, sf_dir))


def enriched_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.enriched_features(weather(spark, sf_dir))


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cube = cells(weather(spark, sf_dir), LIVE)
    return mining.items(bins.discretised(cube, bins.edges(cube, LIVE.n_bins)))


# Sources


@query(with_(WEATHER) + f"select cast(date as varchar) as date, {r(*VALUES)} from weather where city = 'ASIA' and date between date '1996-01-01' and date '1998-12-31'")
def history_scan(spark, sf_dir):
    return even(tables.history(weather(spark, sf_dir), "ASIA", "1996-01-01", "1998-12-31").withColumn("date", F.col("date").cast("string")))


@query("select replace(lower(trim(r_name)), ' ', '_') as city, r_name as source from region union all select replace(lower(trim(n_name)), ' ', '_'), n_name from nation")
def city_listing(spark, sf_dir):
    return tables.cities(tables.metadata(spark, sf_dir))


@query(TO_MONTHLY + f"select city, year, month, {r('tavg_mean', 'tavg_std', 'diurnal_mean', 'roll_std_mean', 'anomaly_mean', 'delta_1_mean')} from monthly where city = 'EUROPE'")
def monthly_readback(spark, sf_dir):
    return even(tables.monthly_of(monthly_of(spark, sf_dir), "EUROPE"))


RUNS = "runs as (select cast(event_id as varchar) as run_id, ts as started_at, event_type as endpoint from events)"


def runs_of(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("started_at"), F.col("event_type").alias("endpoint"))


@query(with_(RUNS) + "select run_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') as started_at, endpoint from (select * from runs order by runs.started_at desc, run_id limit 30)")
def recent_runs(spark, sf_dir):
    return tables.recent_runs(runs_of(spark, sf_dir)).withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


CACHE = """cache as (select event_type as city, arg_max(status, {'t': ts, 'i': event_id}) as status, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as updated_at, arg_max(ref, {'t': ts, 'i': event_id}) filter (where ref is not null) as payload_ref
  from (select *, case when user_id % 3 = 0 then 'error' else 'ok' end as status, case when user_id % 3 > 0 then cast(event_id as varchar) end as ref from events) group by 1)"""


def cache_of(spark, sf_dir):
    """Events as states of a cache by event type: runs of some users fail and leave no payload."""
    good = F.col("user_id") % 3 > 0
    events = tables.table(spark, sf_dir, "events")
    states = events.select(F.col("event_type").alias("city"), F.struct("ts", "event_id").alias("at"), F.when(good, "ok").otherwise("error").alias("status"), F.when(good, F.col("event_id").cast("string")).alias("payload_ref"))
    out = sinks.cache_states(states)
    return out.select("city", "status", F.date_format("updated_at.ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "payload_ref")


@query(with_(CACHE) + "select city, status, updated_at, payload_ref from cache")
def insights_cache(spark, sf_dir):
    return cache_of(spark, sf_dir)


@query(with_(CACHE) + "select city, status, updated_at, payload_ref from cache where city = 'click'")
def cache_lookup(spark, sf_dir):
    return tables.cached(cache_of(spark, sf_dir), "click")


@query(with_(WEATHER) + f"select city, cast(date as varchar) as date, {r(*VALUES)} from weather")
def archive_rows(spark, sf_dir):
    rows = weather(spark, sf_dir)
    row = F.array_sort(F.collect_list(F.struct("date", *VALUES)))
    part = lambda f: F.transform("rows", f)
    answers = rows.groupBy("city").agg(row.alias("rows")).select("city", F.to_json(F.struct(F.struct(part(lambda s: s["date"].cast("string")).alias("time"), part(lambda s: s["tmax"]).alias("temperature_2m_max"), part(lambda s: s["tmin"]).alias("temperature_2m_min"), part(lambda s: s["tavg"]).alias("temperature_2m_mean")).alias("daily"))).alias("body"))
    return even(tables.archive_rows(answers).withColumn("date", F.col("date").cast("string")))


@query(with_(WEATHER) + f"select city, cast(date as varchar) as date, {r(*VALUES)} from weather where date >= date '1996-03-01'")
def archive_source(spark, sf_dir):
    """All days from 1996-03-01 on, from a source that asks a store of answers for each city and year."""
    root = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    noted("", root)
    rows = weather(spark, sf_dir).withColumns({"name": F.col("city"), "city": keys.city_key(F.col("city")), "year": F.year("date")})
    part = lambda c: F.transform("rows", lambda s: s[c])
    daily = F.struct(F.transform("rows", lambda s: s["date"].cast("string")).alias("time"), part("tmax").alias("temperature_2m_max"), part("tmin").alias("temperature_2m_min"), part("tavg").alias("temperature_2m_mean"))
    answers = rows.groupBy("city", "year").agg(F.collect_list(F.struct("date", *VALUES)).alias("rows")).select("city", "year", F.to_json(F.struct(daily.alias("daily"))).alias("value"))
    answers.write.partitionBy("city", "year").text(root)
    names = {r["city"]: r["name"] for r in rows.select("city", "name").distinct().collect()}  # one for each region
    places = json.dumps([{"key": k, "latitude": 0, "longitude": 0} for k in names])
    archive.register(spark)
    found = spark.read.format("daily_archive").options(places=places, root=root if ":" in root else f"file://{root}", start="1990-01-01", end="2010-12-31").load().where("date >= '1996-03-01'")
    told = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return even(found.select(told[F.col("city")].alias("city"), F.col("date").cast("string").alias("date"), *VALUES))


# Sinks


#: All days, and a later batch that corrects those from 1998 on.
BATCHES = "batches as (select *, 1 as batch from weather union all select city, date, tmin + 1, tmax + 1, tavg + 1, 2 from weather where date >= date '1998-01-01')"


def batches_of(spark, sf_dir):
    rows = weather(spark, sf_dir)
    second = rows.where("date >= '1998-01-01'").withColumns({c: F.col(c) + 1 for c in VALUES})
    return rows.withColumn("batch", F.lit(1)).unionByName(second.withColumn("batch", F.lit(2)))


@query(with_(WEATHER, BATCHES) + f"select city, cast(date as varchar) as date, {r(*VALUES)}, batch from batches qualify row_number() over (partition by city, date order by batch desc) = 1")
def upsert_latest(spark, sf_dir):
    return even(sinks.latest(batches_of(spark, sf_dir), ["city", "date"], ["batch"]).withColumn("date", F.col("date").cast("string")))


@query("""with e as (select cast(user_id as varchar) as run_id, ts as t, case event_type when 'click' then 'ok' when 'purchase' then 'error' else 'running' end as status from events)
select run_id, strftime(a, '%Y-%m-%d %H:%M:%S') as started_at, strftime(case when l.s <> 'running' then l.a end, '%Y-%m-%d %H:%M:%S') as finished_at, l.s as status, case when l.s <> 'running' then (epoch_us(l.a) - epoch_us(a)) // 1000 end as duration_ms
  from (select run_id, min(t) as a, max({'a': t, 's': status}) as l from e group by run_id)""")
def run_log_state(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "purchase", "error").otherwise("running")
    events = tables.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("status"))
    return sinks.run_states(events).select("run_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started_at", "finished_at")), "status", "duration_ms")


@query("select c_name as name, regexp_replace(c_name, '[^\\pL\\pN_-]', '_', 'g') as safe from customer union all select p_name, regexp_replace(p_name, '[^\\pL\\pN_-]', '_', 'g') from part")
def file_safe_keys(spark, sf_dir):
    names = tables.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).unionByName(tables.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))
    return names.select("name", keys.file_safe(F.col("name")).alias("safe"))


@query("""with k as (select replace(lower(trim(n_name)), ' ', '_') || '_' || lower(substr(r_name, 1, 2)) as key from nation join region on n_regionkey = r_regionkey)
select key, replace(regexp_extract(key, '^(.+)_([A-Za-z]{2})$', 1), '_', ' ') as name, upper(regexp_extract(key, '^(.+)_([A-Za-z]{2})$', 2)) as country from k""")
def parse_city_keys(spark, sf_dir):
    nations = tables.table(spark, sf_dir, "nation").join(tables.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    made = nations.select(keys.city_key(F.col("n_name"), F.substring("r_name", 1, 2)).alias("key"))
    name, country = keys.parse_city_key(F.col("key"))
    return made.select("key", name.alias("name"), country.alias("country"))


# Series


@query(with_(WEATHER, REGULAR) + f"select city, cast(date as varchar) as date, {r(*VALUES)} from reg")
def calendar_regularize(spark, sf_dir):
    return even(series.regular(weather(spark, sf_dir)).withColumn("date", F.col("date").cast("string")))


@query(with_(WEATHER, REGULAR, FILLED) + f"select city, cast(date as varchar) as date, {r(*VALUES)} from filled")
def interpolate_series(spark, sf_dir):
    return even(series.interpolated(series.regular(weather(spark, sf_dir))).withColumn("date", F.col("date").cast("string")))


def featured(name: str, columns: list[str], f: Callable[[DataFrame], DataFrame], source: str = "feat", sql: str = TO_FEATURES) -> None:
    """A query for some columns of the features."""

    def run(spark, sf_dir):
        return even(f(weather(spark, sf_dir)), "city", "date", *columns).withColumn("date", F.col("date").cast("string"))

    plain = [c for c in columns if c in SYMBOLIC]
    run.__name__ = name
    query(sql + f"select city, cast(date as varchar) as date, {', '.join([*plain, *([r(*(c for c in columns if c not in plain))] if len(plain) < len(columns) else [])])} from {source}")(run)


def again(name: str, of: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    """Another form of a query, held against the same SQL."""
    f.__name__ = name
    query(SQL[of])(f)


def base(df: DataFrame) -> DataFrame:
    return series.interpolated(series.regular(df))


featured("lag_diffs", ["delta_1", "delta_7"], lambda df: series.lag_diffs(base(df)))
featured("rolling_stats", ["roll_mean_7", "roll_std_7"], lambda df: series.rolling_stats(base(df)))
featured("climatology_z", ["anomaly_z"], lambda df: series.climatology_z(base(df)))
featured("cyclic_encoding", ["doy_sin", "doy_cos"], lambda df: series.calendar_features(base(df)))
featured("time_index", ["time_idx"], lambda df: series.calendar_features(base(df)))
featured("daily_features", VALUES + series.DAILY, series.daily_features, "daily", TO_DAILY)
featured("fill_rolling", ["roll_mean_7", "roll_std_7", "delta_1", "delta_7"], lambda df: series.filled_rolling(series.features(df)), "back", TO_ENRICHED)
featured("enriched_features", VALUES + series.DAILY + SYMBOLIC, series.enriched_features, "rich", TO_ENRICHED)
featured("tertile_labels", ["temp_band", "diurnal_band"], series.enriched_features, "rich", TO_ENRICHED)
featured("season_class", ["season_class"], series.enriched_features, "rich", TO_ENRICHED)
featured("trend_anomaly_class", ["trend_class", "anomaly_class"], series.enriched_features, "rich", TO_ENRICHED)


@query(with_(WEATHER, BATCHES) + f"select city, cast(date as varchar) as date, {r(*VALUES)} from batches qualify row_number() over (partition by city, date order by batch desc) = 1")
def dedupe_keep_last(spark, sf_dir):
    return even(series.keep_last(batches_of(spark, sf_dir), "batch"), "city", "date", *VALUES).withColumn("date", F.col("date").cast("string"))


@query(with_(WEATHER, REGULAR) + f"select city, cast(date as varchar) as date, round(last_value(tavg ignore nulls) over ({_B}) + 1e-9, 6) + 0.0 as tavg from reg")
def locf(spark, sf_dir):
    rows = series.regular(weather(spark, sf_dir)).select("city", "date", "tavg")
    return even(series.locf(rows, ["city"], "date", "tavg")).withColumn("date", F.col("date").cast("string"))


_S = "count(tavg) over v = 7"
SHIFTED = f"shifted as (select city, date, tavg, lag(tavg, 1) over w as tavg_lag_1, lag(tavg, 2) over w as tavg_lag_2, lag(tavg, 7) over w as tavg_lag_7, case when {_S} then avg(tavg) over v end as tavg_roll_mean_7, case when {_S} then stddev_samp(tavg) over v end as tavg_roll_std_7, sin(2 * pi() * dayofyear(date) / 365.25) as doy_sin, cos(2 * pi() * dayofyear(date) / 365.25) as doy_cos, lead(tavg, 1) over w as y from filled window w as (partition by city order by date), v as (partition by city order by date rows between 7 preceding and 1 preceding))"
FOREST = "forest as (select * from shifted where tavg_lag_7 is not null and tavg_roll_mean_7 is not null and tavg_roll_std_7 is not null and y is not null)"
featured("shifted_rolling", ["tavg_lag_1", "tavg_lag_2", "tavg_lag_7", "tavg_roll_mean_7", "tavg_roll_std_7"], lambda df: series.shifted_stats(base(df)), "shifted", with_(WEATHER, REGULAR, FILLED, SHIFTED))
featured("rf_features", [*forecast.FOREST_FEATURES, "y"], lambda df: forecast.forest_features(base(df)), "forest", with_(WEATHER, REGULAR, FILLED, SHIFTED, FOREST))
_FOURIER = ", ".join(f"{f}(2 * pi() * {k} * dayofyear(date) / 365.25) as {f}{k}" for k in (1, 2, 3) for f in ("sin", "cos"))
featured("fourier_exog", ["sin1", "cos1", "sin2", "cos2", "sin3", "cos3", "time_idx"], lambda df: forecast.exogenous(series.regular(df)), f"(select city, date, {_FOURIER}, date_diff('day', min(date) over (partition by city), date) / 365.25 as time_idx from reg)", with_(WEATHER, REGULAR))


# Roll-ups


@query(TO_MONTHLY + f"select city, year, month, {r('tavg_mean', 'tavg_std', 'diurnal_mean', 'roll_std_mean', 'anomaly_mean', 'delta_1_mean')} from monthly")
def monthly_rollup(spark, sf_dir):
    return even(monthly_of(spark, sf_dir))


BASELINE = "base as (select city, month, avg(tavg_mean) as tavg_mean, avg(tavg_std) as tavg_std, avg(diurnal_mean) as diurnal_mean from monthly group by 1, 2)"


@query(TO_MONTHLY.rstrip() + ", " + BASELINE + f" select city, month, strftime(make_date(2000, month, 1), '%b') as month_name, {r('tavg_mean', 'tavg_std', 'diurnal_mean')} from base")
def monthly_baseline(spark, sf_dir):
    return even(rollup.baseline(monthly_of(spark, sf_dir)).withColumn("month_name", keys.month_name(F.col("month"))))


TREND = "yearly as (select city, year, avg(tavg_mean) as m from monthly group by 1, 2), trend as (select city, case when count(*) < 2 then 0 else regr_slope(m, year) end as trend_per_year from yearly group by 1)"


@query(TO_MONTHLY.rstrip() + ", " + TREND + f" select city, {r('trend_per_year')} from trend")
def annual_trend(spark, sf_dir):
    return even(rollup.trend(monthly_of(spark, sf_dir)))


EXTREMES = "extremes as (select city, arg_max(month, {'m': tavg_mean, 'k': -month}) as hottest, max(tavg_mean) as hottest_mean, arg_min(month, {'m': tavg_mean, 'k': month}) as coolest, min(tavg_mean) as coolest_mean from base group by 1)"


@query(TO_MONTHLY.rstrip() + ", " + BASELINE + ", " + EXTREMES + f" select city, hottest, coolest, {r('hottest_mean', 'coolest_mean')} from extremes")
def hottest_coolest(spark, sf_dir):
    return even(rollup.extreme_months(rollup.baseline(monthly_of(spark, sf_dir))))


def top(name: str, by: Callable[[], Column], order: str) -> None:
    def run(spark, sf_dir):
        return even(rollup.top_days(daily_of(spark, sf_dir), by()), "city", "rank", "date", "tavg", "anomaly_z").withColumn("date", F.col("date").cast("string"))

    run.__name__ = name
    query(TO_DAILY + f"select city, cast(row_number() over (partition by city order by {order}, date) as integer) as rank, cast(date as varchar) as date, {r('tavg', 'anomaly_z')} from daily qualify row_number() over (partition by city order by {order}, date) <= 10")(run)


# orders by rounded values: engines may differ in the last bit of an average
top("top_hot", lambda: F.desc(F.round(F.col("tavg") + 1e-9, 9)), "round(daily.tavg + 1e-9, 9) desc")
top("top_cold", lambda: F.asc(F.round(F.col("tavg") + 1e-9, 9)), "round(daily.tavg + 1e-9, 9)")
top("top_anomaly", lambda: F.desc(F.round(F.abs("anomaly_z") + 1e-9, 9)), "round(abs(daily.anomaly_z) + 1e-9, 9) desc")


@query(TO_DAILY + "select city, count(*) filter (where abs(anomaly_z) >= 2) as n from daily group by city")
def anomaly_count(spark, sf_dir):
    return rollup.anomaly_days(daily_of(spark, sf_dir))


def streak(name: str, holds: Callable[[], Column], condition: str) -> None:
    def run(spark, sf_dir):
        return rollup.longest_run(daily_of(spark, sf_dir), holds()).withColumns({"start": F.col("start").cast("string"), "end": F.col("end").cast("string")})

    run.__name__ = name
    sql = f"""marked as (select city, date, {condition} as ok, row_number() over (partition by city order by date) as rn from daily),
islands as (select city, date, ok, rn - row_number() over (partition by city, ok order by date) as island from marked),
runs as (select city, count(*) as length, min(date) as a, max(date) as b from islands where ok group by city, island),
best as (select * from runs qualify row_number() over (partition by city order by length desc, a) = 1)
select c.city, coalesce(length, 0) as length, cast(a as varchar) as start, cast(b as varchar) as "end" from (select distinct city from daily) c left join best using (city)"""
    query(TO_DAILY.rstrip() + ", " + sql)(run)


streak("warm_streak", lambda: F.col("anomaly_z") >= 1, "anomaly_z >= 1")
streak("cold_streak", lambda: F.col("anomaly_z") <= -1, "anomaly_z <= -1")
# the payload's own limits
streak("warm_streak_payload", lambda: F.col("anomaly_z") >= 2, "anomaly_z >= 2")
streak("cold_streak_payload", lambda: F.col("anomaly_z") <= -2, "anomaly_z <= -2")


@query(TO_DAILY + """select d.city, cast(min(d.date) as varchar) as data_start, cast(max(d.date) as varchar) as data_end, date_diff('day', min(d.date), max(d.date)) + 1 as expected_days, count(*) as actual_days,
  round(count(*) / (date_diff('day', min(d.date), max(d.date)) + 1) + 1e-9, 6) + 0.0 as coverage, any_value(o.n) as observed_days from daily d join (select city, count(distinct date) as n from weather group by 1) o using (city) group by 1""")
def data_health(spark, sf_dir):
    rows = weather(spark, sf_dir)
    return even(rollup.health(series.daily_features(rows), rows).withColumns({"data_start": F.col("data_start").cast("string"), "data_end": F.col("data_end").cast("string")}))


@query(TO_MONTHLY.rstrip() + ", " + BASELINE + ", " + TREND + ", " + EXTREMES + f" select city, hottest, coolest, {r('trend_per_year')}, n as anomaly_days from extremes join trend using (city) join (select city, count(*) filter (where abs(anomaly_z) >= 2) as n from daily group by 1) using (city)")
def insights_summary(spark, sf_dir):
    return even(summaries(weather(spark, sf_dir)), "city", "hottest", "coolest", "trend_per_year", "anomaly_days")


@query()
def insights_payload(spark, sf_dir):
    return payload(weather(spark, sf_dir), FIFTH)


# Long series: cut by date ranges, here of some two years
SPLIT = 700
again("segmented_features", "daily_features", lambda spark, sf_dir: even(segments.daily_features(weather(spark, sf_dir), SPLIT)).withColumn("date", F.col("date").cast("string")))
again("segmented_enriched", "enriched_features", lambda spark, sf_dir: even(segments.enriched_features(weather(spark, sf_dir), days=SPLIT)).withColumn("date", F.col("date").cast("string")))
again("segmented_streak", "warm_streak", lambda spark, sf_dir: segments.longest_run(segments.daily_features(weather(spark, sf_dir), SPLIT), F.col("anomaly_z") >= 1, SPLIT).withColumns({"start": F.col("start").cast("string"), "end": F.col("end").cast("string")}))

# Windows and cube


def hopped(spark, sf_dir, size: int, stride: int) -> DataFrame:
    return windows.hopping(enriched_of(spark, sf_dir), size, stride)


@query(TO_ENRICHED.rstrip() + ",\n" + hop(14, 5) + f" select city, window_id, context_idx, cast(date as varchar) as date, {r('tavg')} from hops")
def hopping_windows(spark, sf_dir):
    return even(hopped(spark, sf_dir, 14, 5), "city", "window_id", "context_idx", "date", "tavg").withColumn("date", F.col("date").cast("string"))


@query(TO_ENRICHED.rstrip() + ",\n" + hop(14, 14) + " select city, window_id, cast(min(date) as varchar) as start_date, cast(max(date) as varchar) as end_date, cast(max(case when context_idx = 7 then date end) as varchar) as center_date from hops group by 1, 2")
def window_meta(spark, sf_dir):
    meta = windows.window_meta(hopped(spark, sf_dir, 14, 14), 14)
    return meta.select("city", "window_id", *(F.col(c).cast("string").alias(c) for c in ("start_date", "end_date", "center_date")))


@query(TO_ENRICHED.rstrip() + ",\n" + hop(14, 14) + " select city, window_id, cast(min(date) as varchar) as start_date, cast(max(date) as varchar) as end_date, cast(min(date) + cast(date_diff('day', min(date), max(date)) // 2 as integer) as varchar) as center_date from hops group by 1, 2")
def window_meta_midpoint(spark, sf_dir):
    meta = windows.window_midpoints(hopped(spark, sf_dir, 14, 14))
    return meta.select("city", "window_id", *(F.col(c).cast("string").alias(c) for c in ("start_date", "end_date", "center_date")))


@query(TO_ENRICHED.rstrip() + ",\n" + hop(7, 3) + " select city, window_id, count(distinct context_idx) as n, min(context_idx) as low, max(context_idx) as high from hops group by 1, 2 having n <> 8 or low <> 0 or high <> 7")
def window_integrity(spark, sf_dir):
    """Windows of 7 days held against an analysis that asks for 8: all are told."""
    return windows.broken_windows(hopped(spark, sf_dir, 7, 3), 8)


@query(TO_CUBE + f" select city, window_id, context_idx, feature_idx, {r('num')}, sym from cube")
def long_cube(spark, sf_dir):
    return even(cells(weather(spark, sf_dir), LIVE)[1])


@query(TO_CUBE + ",\n" + cut_points(3) + " select city, feature_idx, cast(k as integer) as k, round(edges[k + 1] + 1e-9, 6) + 0.0 as edge from (select *, unnest(range(len(edges))) as k from edges)")
def bin_edges_eq_size(spark, sf_dir):
    return even(bins.edges(cells(weather(spark, sf_dir), LIVE)[1], 3).select("city", "feature_idx", F.posexplode("edges").alias("k", "edge")))


@query(TO_CUBE + " select city, feature_idx, cast(k as integer) as k, round(low + k * (high - low) / 3 + 1e-9, 6) + 0.0 as edge from (select city, feature_idx, min(num) as low, max(num) as high, unnest(range(4)) as k from cube where num is not null group by 1, 2)")
def bin_edges_eq_width(spark, sf_dir):
    return even(bins.edges(cells(weather(spark, sf_dir), LIVE)[1], 3, "eq_width").select("city", "feature_idx", F.posexplode("edges").alias("k", "edge")))


@query(TO_ITEMS + " select city, window_id, context_idx, feature_idx, symbol from items")
def bin_assign(spark, sf_dir):
    return items_of(spark, sf_dir).select("city", "window_id", "context_idx", "feature_idx", "symbol")


# Patterns


@query(TO_ITEMS + """ select city, window_id, string_agg(s, ' ' order by context_idx) as pattern from (select city, window_id, context_idx, '(' || string_agg(token, ' ' order by token) || ')' as s from items group by 1, 2, 3) group by 1, 2""")
def item_tokens(spark, sf_dir):
    return mining.sequences(items_of(spark, sf_dir)).select("city", "window_id", tokens.pattern_string(F.col("itemsets")).alias("pattern"))


@query(TO_ITEMS + " select city, token, cast(row_number() over (partition by city order by first, token) as integer) as item_id from (select city, token, min({'w': window_id, 'c': context_idx}) as first from items group by 1, 2)")
def item_dictionary(spark, sf_dir):
    return mining.dictionary(items_of(spark, sf_dir))


@query(TO_FREQUENT + " select city, token, support, cast(needed as integer) as needed from frequent")
def item_support(spark, sf_dir):
    return mining.supports(items_of(spark, sf_dir), LIVE.min_rows).select("city", "token", F.col("support").cast("long").alias("support"), "needed")


@query(TO_FREQUENT + ", flat as (select city, token, needed, unnest(tids) as tid from frequent) select a.city, a.token as first, b.token as second, count(*) as support from flat a join flat b on a.city = b.city and a.tid = b.tid and a.token < b.token group by 1, 2, 3, a.needed having count(*) >= a.needed")
def pair_support(spark, sf_dir):
    return mining.pair_supports(mining.supports(items_of(spark, sf_dir), LIVE.min_rows)).select("city", "first", "second", "support")


@query(TO_ITEMS + ", p as (select city, window_id, string_agg(token, ' ' order by token) as pattern from items group by 1, 2), t as (select city, window_id, unnest(regexp_extract_all(pattern, 'f\\d+(?:_\\d+)?#[^\\s()]+')) as token from p) select city, window_id, token, cast(regexp_extract(token, '^f(\\d+)', 1) as integer) as feature_idx, cast(regexp_extract(token, '_(\\d+)#', 1) as integer) as context_idx, regexp_extract(token, '#(.+)$', 1) as symbol from t")
def token_parse(spark, sf_dir):
    lines = mining.sequences(items_of(spark, sf_dir)).select("city", "window_id", tokens.pattern_string(F.col("itemsets")).alias("pattern"))
    flat = lines.select("city", "window_id", F.explode(tokens.tokens_in(F.col("pattern"))).alias("token"))
    return flat.select("city", "window_id", "token", tokens.feature_of(F.col("token")).alias("feature_idx"), tokens.offset_of(F.col("token")).alias("context_idx"), tokens.symbol_of(F.col("token")).alias("symbol"))


NAMES = "names as (select unnest(range(12)) as feature_idx, unnest([" + ", ".join(f"'{c}'" for c in [*NUMERIC, *SYMBOLIC]) + "]) as feature)"


again("bin_edges_selected", "bin_edges_eq_size", lambda spark, sf_dir: even(quantiles.bins_of(cells(weather(spark, sf_dir), LIVE)[1], LIVE.n_bins).select("city", "feature_idx", F.posexplode("edges").alias("k", "edge"))))


@query(TO_ITEMS + ",\n" + NAMES + " select city, window_id as id, cast(row_number() over (partition by city, window_id order by n desc, feature, symbol) as integer) as rank, feature, symbol as direction, n as count from (select city, window_id, feature, symbol, count(*) as n from items join names using (feature_idx) group by all) qualify row_number() over (partition by city, window_id order by n desc, feature, symbol) <= 5")
def signature_top5(spark, sf_dir):
    lines = mining.sequences(items_of(spark, sf_dir)).select("city", F.col("window_id").alias("id"), tokens.pattern_string(F.col("itemsets")).alias("pattern_string"))
    return regimes.signature(regimes.parsed(lines))


# Blocks: for each city and season the windows that begin in it, all offsets, and features by the season's first letter


BLOCKS = """blocks as (select city, b.id, list_sort(list(distinct window_id)) as rows, range(14) as contexts, any_value(b.cols) as cols from hops
  join (values (0, 'monsoon', [0, 3, 7, 9]), (1, 'post_monsoon', [0, 1, 2]), (2, 'pre_monsoon', [7, 8, 9, 10]), (3, 'winter', [3, 4, 5, 8])) b(id, season, cols) on season_class = season where context_idx = 0 group by 1, 2),
bc as (select city, id, window_id, context_idx, feature_idx, num, sym from (select city, id, cols, contexts, unnest(rows) as window_id from blocks) join cube using (city, window_id) where list_contains(cols, feature_idx) and list_contains(contexts, context_idx)),
cv as (select city, id, avg(case when abs(m) < 1e-12 then 0 else s / abs(m) end) as cv from (select city, id, context_idx, feature_idx, avg(num) as m, stddev_pop(num) as s from bc where feature_idx < 7 group by 1, 2, 3, 4) group by 1, 2),
gini as (select city, id, avg(1 - sq / (t * t)) as gini from (select city, id, context_idx, feature_idx, sum(n) as t, sum(n * n) as sq from (select city, id, context_idx, feature_idx, sym, cast(count(*) as double) as n from bc where feature_idx >= 7 group by 1, 2, 3, 4, 5) group by 1, 2, 3, 4) group by 1, 2),
gaps as (select city, id, avg(case when num is null and sym is null then 1 else 0 end) as gap from bc group by 1, 2),
hvar as (select city, id, rows, len(rows) as support, len(rows) * len(contexts) * len(cols) as volume, case when jn > 0 then coalesce(cv, 0) / (a * jn) else 0 end + case when js > 0 then coalesce(gini, 0) / (a * js) else 0 end + coalesce(gap, 0) as hvar3
  from (select *, len(rows) * len(contexts) as a, len(list_filter(cols, lambda c: c < 7)) as jn, len(list_filter(cols, lambda c: c >= 7)) as js from blocks) left join cv using (city, id) left join gini using (city, id) left join gaps using (city, id))"""
TO_BLOCKS = TO_CUBE + ",\n" + BLOCKS


def blocks_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows, cube = cells(weather(spark, sf_dir), LIVE)
    cols = {"monsoon": (0, [0, 3, 7, 9]), "post_monsoon": (1, [0, 1, 2]), "pre_monsoon": (2, [7, 8, 9, 10]), "winter": (3, [3, 4, 5, 8])}
    pick = lambda i: F.coalesce(*(F.when(F.col("season_class") == k, F.lit(v[i]) if i == 0 else F.array(*map(F.lit, v[i]))) for k, v in cols.items()))
    first = rows.where("context_idx = 0").select("city", "window_id", pick(0).alias("id"), pick(1).alias("cols"))
    found = first.groupBy("city", "id", "cols").agg(F.array_sort(F.collect_set("window_id")).alias("rows"))
    return found.withColumn("contexts", F.sequence(F.lit(0), F.lit(LIVE.window - 1))), cube


@query(TO_BLOCKS + f" select city, cast(id as integer) as id, {r('cv')} from cv")
def block_cv(spark, sf_dir):
    return even(triclusters.variation(triclusters.block_cells(*blocks_of(spark, sf_dir))))


@query(TO_BLOCKS + f" select city, cast(id as integer) as id, {r('gini')} from gini")
def block_gini(spark, sf_dir):
    return even(triclusters.impurity(triclusters.block_cells(*blocks_of(spark, sf_dir))))


@query(TO_BLOCKS + " select city, cast(id as integer) as id, round(hvar3 + 1e-9, 9) + 0.0 as hvar3 from hvar")
def block_hvar3(spark, sf_dir):
    return triclusters.coherence(*blocks_of(spark, sf_dir)).select("city", "id", (F.round(F.col("hvar3") + 1e-9, 9) + 0.0).alias("hvar3"))


@query(
    TO_BLOCKS
    + """, mid as (select city, window_id, min(date) + cast(date_diff('day', min(date), max(date)) // 2 as integer) as day from hops group by 1, 2), flat as (select city, id, unnest(rows) as window_id from blocks)
select city, cast(id as integer) as id, array_to_string(list_sort(list(distinct month(day))), ',') as months, array_to_string(list_sort(list(distinct year(day))), ',') as years from flat join mid using (city, window_id) group by 1, 2"""
)
def block_seasons(spark, sf_dir):
    rows, _ = cells(weather(spark, sf_dir), LIVE)
    found = regimes.seasons_of(blocks_of(spark, sf_dir)[0], windows.window_midpoints(rows))
    return found.select("city", "id", F.array_join("months", ",").alias("months"), F.array_join("years", ",").alias("years"))


@query(
    TO_BLOCKS
    + """, windows_ as (select city, count(distinct w) as n from (select city, unnest(rows) as w from blocks) group by 1)
select h.city, count(*) as n_triclusters, any_value(n) as n_supported_windows, string_agg(cast(id as varchar), ',' order by hvar3, support desc, volume desc, id) as top_coherent_ids, string_agg(cast(id as varchar), ',' order by support desc, hvar3, id) as most_supported_ids, string_agg(cast(id as varchar), ',' order by volume desc, hvar3, id) as largest_volume_ids
from hvar h join windows_ w on h.city = w.city group by 1"""
)
def block_summary(spark, sf_dir):
    blocks = triclusters.described(triclusters.coherence(*blocks_of(spark, sf_dir))).withColumn("support", F.size("rows"))
    out = regimes.summary(blocks)
    return out.select("city", "n_triclusters", "n_supported_windows", *(F.array_join(c, ",").alias(c) for c in ("top_coherent_ids", "most_supported_ids", "largest_volume_ids")))


_MONTHS = ", ".join(f"'{m}'" for m in keys.MONTHS)


@query(
    TO_ITEMS
    + ",\n"
    + NAMES
    + f""", mid as (select city, window_id, min(date) + cast(date_diff('day', min(date), max(date)) // 2 as integer) as day from hops group by 1, 2),
top as (select city, window_id, feature, symbol, n from (select city, window_id, feature, symbol, count(*) as n from items join names using (feature_idx) group by all) qualify row_number() over (partition by city, window_id order by n desc, feature, symbol) <= 5),
sig as (select city, window_id, string_agg(feature || ':' || symbol || ':' || n, ',' order by n desc, feature, symbol) as signature from top group by 1, 2)
select city, window_id as id, cast(month(day) as varchar) as months, [{_MONTHS}][month(day)] as months_names, cast(year(day) as varchar) as years, signature from mid join sig using (city, window_id)"""
)
def window_cards(spark, sf_dir):
    """The cards of single windows, each with all of its items as its pattern."""
    rows, _ = cells(weather(spark, sf_dir), LIVE)
    w = F.col("window_id")
    blocks = mining.sequences(items_of(spark, sf_dir)).select("city", w.alias("id"), F.array(w).alias("rows"), tokens.pattern_string(F.col("itemsets")).alias("pattern_string"))
    signature = F.array_join(F.transform("signature_top5", lambda s: F.concat_ws(":", s["feature"], s["direction"], s["count"].cast("string"))), ",")
    told = regimes.cards(stored(blocks, "blocks"), windows.window_midpoints(rows))
    return told.select("city", "id", *(F.array_join(c, ",").alias(c) for c in ("months", "months_names", "years")), signature.alias("signature"))


SHAPES = """shapes as (select city, cast(window_id // 3 as integer) as id, list_sort(list(distinct w)) as rows, [0, 1] as contexts, list_sort(list(distinct cast(f as integer))) as cols from (select city, window_id, unnest([window_id, window_id + 1, window_id + 2]) as w, unnest([window_id % 4, 5, 6]) as f from hops where context_idx = 0) group by 1, 2)"""


def shapes_of(spark, sf_dir) -> DataFrame:
    rows, _ = cells(weather(spark, sf_dir), LIVE)
    w = F.col("window_id")
    wide = rows.where("context_idx = 0").select("city", "window_id", F.explode(F.arrays_zip(F.array(w, w + 1, w + 2).alias("w"), F.array(w % 4, F.lit(5), F.lit(6)).alias("f"))).alias("z"))
    found = wide.groupBy("city", F.floor(w / 3).cast("int").alias("id")).agg(F.array_sort(F.collect_set("z.w")).alias("rows"), F.array_sort(F.collect_set("z.f")).alias("cols"))
    return found.withColumn("contexts", F.array(F.lit(0), F.lit(1)))


@query(TO_HOPS + ",\n" + SHAPES + """, pairs as (select a.city, a.id as a, b.id as b, len(list_intersect(a.rows, b.rows)) * len(list_intersect(a.cols, b.cols)) * 2 as i, len(a.rows) * len(a.cols) * 2 + len(b.rows) * len(b.cols) * 2 as v, len(list_intersect(a.rows, b.rows)) as shared
  from shapes a join shapes b on a.city = b.city and a.id < b.id) select city, a, b, round(i / (v - i) + 1e-9, 6) + 0.0 as jaccard from pairs where shared > 0""")
def pairwise_jaccard(spark, sf_dir):
    return even(triclusters.overlaps(shapes_of(spark, sf_dir)))


@query(TO_HOPS + ",\n" + SHAPES + ", twice as (select * from shapes union all select city, id + 1000000, rows, contexts, cols from shapes) select city, min(id) as id, array_to_string(rows, ',') as rows, array_to_string(cols, ',') as cols from twice group by city, rows, contexts, cols")
def dedupe_triclusters(spark, sf_dir):
    """All shapes, each found twice under two ids."""
    shapes = shapes_of(spark, sf_dir)
    twice = shapes.unionByName(shapes.withColumn("id", F.col("id") + 1_000_000))
    return triclusters.deduplicated(twice).select("city", "id", F.array_join("rows", ",").alias("rows"), F.array_join("cols", ",").alias("cols"))


MODES = """t as (select city, window_id, feature, symbol, count(*) as n from items join names using (feature_idx) group by all),
m as (select city, window_id, feature, list(symbol order by n desc, symbol) as s from t group by 1, 2, 3),
w as (select city, window_id, max(s) filter (where feature = 'season_class') as se, max(s) filter (where feature = 'temp_band') as te, max(s) filter (where feature = 'trend_class') as tr, max(s) filter (where feature = 'anomaly_class') as an, max(s) filter (where feature = 'diurnal_band') as di from m group by 1, 2)"""


@query(TO_ITEMS + ",\n" + NAMES + ",\n" + MODES + """ select city, window_id as id, case when list_contains(se, 'monsoon') then 'Monsoon regime' when list_contains(se, 'winter') then 'Winter regime' when list_contains(se, 'pre_monsoon') then 'Pre-monsoon regime' when list_contains(se, 'post_monsoon') then 'Post-monsoon regime'
 when te[1] = 'hot' and list_contains(tr, 'warming') then 'Hot warming regime' when te[1] = 'hot' then 'Hot regime' when te[1] = 'cold' and list_contains(an, 'low') then 'Cold anomaly regime' when te[1] = 'cold' then 'Cool regime' when te[1] = 'mild' and list_contains(tr, 'stable') then 'Stable mild regime'
 when an[1] = 'high' then 'Warm anomaly regime' when an[1] = 'low' then 'Cold anomaly regime' when di[1] = 'high' then 'High diurnal variability regime' when di[1] = 'low' then 'Low diurnal variability regime'
 when tr[1] = 'warming' then 'Warming transition regime' when tr[1] = 'cooling' then 'Cooling transition regime' when tr[1] = 'stable' then 'Stable regime' else 'Mixed weather regime' end as label from w""")
def regime_labels(spark, sf_dir):
    lines = mining.sequences(items_of(spark, sf_dir)).select("city", F.col("window_id").alias("id"), tokens.pattern_string(F.col("itemsets")).alias("pattern_string"), F.array(*map(F.lit, triclusters.FEATURES)).alias("feature_names"), F.lit("mixed").alias("type"))
    return regimes.labelled(lines).select("city", "id", "label")


_Z = "case when stddev_pop({c}) over w = 0 then 1 else stddev_pop({c}) over w end"
GRID = (
    "cellsz as (select y.city, y.year, cast(y.m as integer) as month, " + ", ".join(f"mo.{c}" for c in yearly_clusters.MONTHLY) + " from (select city, year, unnest(range(1, 13)) as m from (select distinct city, year from monthly)) y left join monthly mo on mo.city = y.city and mo.year = y.year and mo.month = y.m),\n"
    "full_ as (select city, year, month, " + ", ".join(f"coalesce({c}, avg({c}) over (partition by city)) as {c}" for c in yearly_clusters.MONTHLY) + " from cellsz),\n"
    "scaled as (select city, year, month, " + ", ".join(f"({c} - avg({c}) over w) / {_Z.format(c=c)} as {c}" for c in yearly_clusters.MONTHLY) + " from full_ window w as (partition by city))"
)


@query(TO_MONTHLY.rstrip() + ",\n" + GRID + f" select city, year, month, {r(*yearly_clusters.MONTHLY)} from scaled")
def zscale_grid(spark, sf_dir):
    return even(yearly_clusters.standardised(monthly_of(spark, sf_dir)))


@query(TO_MONTHLY.rstrip() + ",\n" + GRID + """ select city, year, month, case when diurnal_mean < -0.3 and tavg_std < -0.3 and roll_std_mean < -0.3 then 'Stable cloudy-like regime' when tavg_mean > 0.3 and diurnal_mean > 0.3 then 'Dry heat regime'
  when delta_1_mean > 0.3 or roll_std_mean > 0.3 or tavg_std > 0.3 then 'Transition / volatile regime' when tavg_mean < -0.3 then 'Cool season regime' else 'Seasonal regime' end as label from scaled""")
def legacy_labels(spark, sf_dir):
    z = yearly_clusters.standardised(monthly_of(spark, sf_dir))
    names = lambda keep: F.filter(F.array(*(F.when(keep(F.col(c)), F.lit(c)) for c in yearly_clusters.MONTHLY)), lambda v: v.isNotNull())
    return z.select("city", "year", "month", regimes.legacy_label(names(lambda c: c > 0.3), names(lambda c: c < -0.3)).alias("label"))


@query()
def closed_patterns(spark, sf_dir):
    cube = stored(cells(weather(spark, sf_dir), TENTH)[1], "cube")
    symbols = bins.discretised(cube, bins.edges(cube, TENTH.n_bins, TENTH.binning))
    found, cut = mining.patterns(mining.supports(mining.items(symbols), TENTH.min_rows, min_share=TENTH.min_share), TENTH.min_offsets)
    return found.select("city", "pattern_id", "pattern_string", "support", F.col("city").isin(cut).alias("truncated"))


@query()
def triclusters_found(spark, sf_dir):
    blocks, _, cut = find_triclusters(weather(spark, sf_dir), FIFTH)
    return even(blocks.select("city", "id", "place", "pattern_string", "support", "type", "label", "hvar3", F.col("shape.volume").alias("volume"), F.col("city").isin(cut).alias("truncated")))


#: Weeks of events as groups, a user's week as a sequence of days.
WEEKS = """d as (select distinct cast(date_trunc('week', ts) as date) as city, user_id as seq, cast(ts as date) as day, event_type as item from events),
o as (select city, seq, cast(day - city as integer) as pos, item from d),
z as (select city, greatest(2, ceil(0.25 * count(distinct seq) - 1e-9)) as needed from o group by 1),
m(city, seq, p, places, needed) as (
  select city, seq, [[item]], list(pos order by pos), needed from o join z using (city) group by city, seq, item, needed qualify count(*) over (partition by city, item) >= needed
  union all
  select city, seq, p, list(pos order by pos), needed from (
    select m.city, m.seq, list_append(m.p, [o.item]) as p, o.pos, m.needed from m join o on o.city = m.city and o.seq = m.seq and o.pos > m.places[1]
    union all
    select m.city, m.seq, list_append(m.p[:-2], list_append(m.p[-1], o.item)), o.pos, m.needed from m join o on o.city = m.city and o.seq = m.seq and list_contains(m.places, o.pos) and o.item > m.p[-1][-1])
  group by city, seq, p, needed qualify count(*) over (partition by city, p) >= needed),
found as (select city, p, count(*) as support from m group by all)"""
_TOLD = "cast(city as varchar) as week, array_to_string(list_transform(p, lambda s: '(' || array_to_string(s, ' ') || ')'), ' ') as pattern_string, support"


def weeks_of(spark, sf_dir) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select(F.date_trunc("week", "ts").cast("date").alias("city"), F.col("user_id").alias("seq"), F.col("ts").cast("date").alias("day"), "event_type")
    days = rows.groupBy("city", "seq", "day").agg(F.array_sort(F.collect_set("event_type")).alias("items"))
    return days.groupBy(F.col("city").cast("string").alias("city"), "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "items"))), lambda s: s["items"]).alias("itemsets"))


def sequential(name: str, miner: str, sql: str) -> None:
    def run(spark, sf_dir):
        found = sequences.patterns(weeks_of(spark, sf_dir), 2, miner, min_share=0.25, subjects=False)
        return found.select(F.col("city").alias("week"), "pattern_string", F.col("support").cast("long").alias("support"))

    run.__name__ = name
    query("with recursive " + WEEKS + sql)(run)


sequential("sequences_prefixspan", "prefixspan", f" select {_TOLD} from found")
sequential("sequences_spam", "spam", f" select {_TOLD} from found")
sequential("sequences_clospan", "clospan", f""", spots as (select city, p, support, unnest(range(1, len(p) + 1)) as i from found), cut as (select city, p, support, i, unnest(p[i]) as item from spots),
less as (select distinct city, support, list_filter(list_transform(p, lambda s, k: case when k = i then list_filter(s, lambda v: v <> item) else s end), lambda s: len(s) > 0) as p from cut)
select {_TOLD} from found where not exists (select 1 from less where less.city = found.city and less.support = found.support and less.p = found.p)""")


@query()
def kmeans_regimes(spark, sf_dir):
    found = yearly_clusters.clusters(monthly_of(spark, sf_dir))
    return found.withColumn("label", regimes.legacy_label(F.col("high"), F.col("low")))


# Forecasts


FORECAST_PARTS = with_(WEATHER, REGULAR, FILLED, SHIFTED, FOREST)


@query(FORECAST_PARTS + "select city, part, count(*) as n, cast(min(date) as varchar) as first, cast(max(date) as varchar) as last from (select city, date, case when date >= last - 365 then 'test' when date >= last - 730 then 'val' else 'train' end as part from (select city, date, max(date) over (partition by city) as last from forest)) group by 1, 2")
def chrono_split(spark, sf_dir):
    parts = forecast.chronological(forecast.forest_features(base(weather(spark, sf_dir))))
    return parts.groupBy("city", "part").agg(F.count("*").alias("n"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last"))


@query(with_(WEATHER, REGULAR) + "select city, cast(fold as integer) as fold, n, n - (2 - fold) * 30 - 30 as val_start, n - (2 - fold) * 30 as val_end from (select city, count(*) as n, unnest(range(3)) as fold from reg group by city)")
def cv_folds(spark, sf_dir):
    return forecast.fold_table(series.regular(weather(spark, sf_dir)))


@query(with_(WEATHER) + f"select city, candidate, p, d, q, sp, sd, sq from (select distinct city from weather) cross join (values {', '.join(str((k, *o, *s[:3])) for k, o, s in forecast.candidates())}) g(candidate, p, d, q, sp, sd, sq)")
def candidate_grid(spark, sf_dir):
    return forecast.candidate_grid(weather(spark, sf_dir))


@query(FORECAST_PARTS + f"select city, {r('mae', 'rmse')}, n from (select city, avg(abs(tavg_lag_7 - tavg)) as mae, sqrt(avg((tavg_lag_7 - tavg) * (tavg_lag_7 - tavg))) as rmse, count(*) as n from shifted where tavg_lag_7 is not null group by city)")
def error_metrics(spark, sf_dir):
    rows = series.shifted_stats(base(weather(spark, sf_dir))).where(F.col("tavg_lag_7").isNotNull())
    return even(forecast.errors(rows, "tavg", "tavg_lag_7", ["city"]))


@query()
def rf_forecast(spark, sf_dir):
    rows = base(weather(spark, sf_dir)).select("city", "date", "tavg")
    return forecast.forest_forecast(rows, forecast.train_forests(rows))


@query()
def sarimax_forecast(spark, sf_dir):
    return even(forecast.sarimax_forecast(weather(spark, sf_dir), 7))


# Growing data


@query("select event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') as window_start, count(*) as n, round(avg(value) + 1e-9, 6) + 0.0 as mean, round(min(value) + 1e-9, 6) + 0.0 as low, round(max(value) + 1e-9, 6) + 0.0 as high from events group by 1, 2")
def windowed_events(spark, sf_dir):
    counts = windowed_counts(tables.table(spark, sf_dir, "events"), "event_type", "ts", "value")
    return even(counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")))
