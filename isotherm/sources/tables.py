"""Reading tables, and daily series derived from any fact table with a key, a day and a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import city_key
from ..schemas import ARCHIVE, WEATHER_DAILY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_series(facts: DataFrame, key: Column, day: Column, value: Column) -> DataFrame:
    """(city, date, tmin, tmax, tavg) from rows of a fact table."""
    return facts.groupBy(key.alias("city"), day.cast("date").alias("date")).agg(F.min(value).alias("tmin"), F.max(value).alias("tmax"), F.avg(value).alias("tavg"))


def weather_daily(spark: SparkSession, sf_dir: str, by: str = "region") -> DataFrame:
    """Order prices (in ten thousands) by day and customer's region or nation, as a stand-in for temperatures.

    Orders are first reduced by customer's nation key and day, so that the joins with nation and region are small.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    joined = orders.join(customers, "o_custkey")
    nations = table(spark, sf_dir, "nation")
    names = nations.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name" if by == "region" else "n_name").alias("city"))
    small = joined.groupBy("c_nationkey", "date").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.sum("o_totalprice").alias("total"), F.count("o_totalprice").alias("n"))
    out = small.join(names, "c_nationkey").groupBy("city", "date").agg(F.min("low").alias("tmin"), F.max("high").alias("tmax"), (F.sum("total") / F.sum("n")).alias("tavg"))
    return out.select("city", "date", *((F.col(c) / 10000).alias(c) for c in ("tmin", "tmax", "tavg")))


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_series(table(spark, sf_dir, "events"), F.col("event_type"), F.col("ts"), F.col("value"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, name and parent of each nation and region."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return regions.select(city_key(F.col("r_name")).alias("city"), F.col("r_name").alias("source")).unionByName(nations.select(city_key(F.col("n_name")).alias("city"), F.col("n_name").alias("source")))


def history(df: DataFrame, city: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One city's rows within inclusive bounds, by date; with files partitioned by city only its files are read."""
    if start and end and start > end:
        raise ValueError("start is after end")
    rows = df.where(F.col("city") == city)
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows.select("date", "tmin", "tmax", "tavg").orderBy("date")


def cities(meta: DataFrame) -> DataFrame:
    return meta.orderBy("city")


def monthly_of(months: DataFrame, city: str) -> DataFrame:
    return months.where(F.col("city") == city).orderBy("year", "month")


def recent_runs(runs: DataFrame, limit: int = 30) -> DataFrame:
    """The latest runs; the limit is held within 1 and 200."""
    return runs.orderBy(F.desc("started_at"), "run_id").limit(min(max(limit, 1), 200))


def cached(cache: DataFrame, city: str) -> DataFrame:
    """The row of one key, or none."""
    return cache.where(F.col("city") == city).limit(1)


def read_csv(spark: SparkSession, path: str, schema: str = WEATHER_DAILY) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def archive_rows(answers: DataFrame) -> DataFrame:
    """(city, date, tmax, tmin, tavg) from a column ``body`` with a daily archive's JSON answers; rows with a null go."""
    d = F.from_json("body", ARCHIVE)["daily"]
    zipped = F.arrays_zip(d["time"].alias("time"), d["temperature_2m_max"].alias("tmax"), d["temperature_2m_min"].alias("tmin"), d["temperature_2m_mean"].alias("tavg"))
    rows = answers.select("city", F.inline(zipped))
    return rows.select("city", F.col("time").try_cast("date").alias("date"), "tmin", "tmax", "tavg").na.drop("any")


def geocode(places: DataFrame, name: str, country: str | None = None) -> dict | None:
    """The first place of that name in a lookup table (name, country_code, latitude, longitude); None if there is none."""
    rows = places.where(city_key(F.col("name")) == city_key(F.lit(name)))
    if country:
        rows = rows.where(F.lower("country_code") == country.lower())
    found = rows.orderBy("name", "country_code").first()
    return found.asDict() if found else None
