"""The operations that a service would offer, as functions over tables; no web server."""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import city_key
from ..operators import forecast, rollup, series
from ..schemas import KEYS
from ..sources import sinks, tables
from ..sources.sinks import write_upsert
from ..sources.snapshots import Snapshots
from ..sources.storage import scratch, stored
from .insights import Config, payload

#: What a run's log rows hold besides its id, state and time.
RUN_COLUMNS = ["endpoint", "city", "params_json", "result_json", "error"]
DEFAULT_START, DEFAULT_END = date(2016, 1, 1), date(2024, 12, 31)


def clean_text(value: str | None) -> str | None:
    """Without white space at the ends; blank is None."""
    return (value or "").strip() or None


def clamped(value: int, low: int, high: int) -> int:
    return min(max(value, low), high)


class Store:
    """Tables as Parquet files under one root, series partitioned by city."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def upsert(self, name: str, rows: DataFrame) -> int:
        return write_upsert(self.spark, self.path(name), rows, KEYS[name], "city")

    def add_city(self, name: str, country: str | None, answers: DataFrame, places: DataFrame, train: bool = True) -> str:
        """Ingest a daily archive's answer (body) of a place and train its model; returns its key."""
        found = tables.geocode(places, name, clean_text(country))
        if found is None:
            raise ValueError(f"no such place: {name}")
        key = answers.sparkSession.range(1).select(city_key(F.lit(name), F.lit(country))).first()[0]
        rows = tables.archive_rows(answers.withColumn("city", F.lit(key)))
        self.upsert("weather_daily", rows)
        extent = rows.agg(F.lit(key).alias("city"), F.lit(found["latitude"]).cast("double").alias("latitude"), F.lit(found["longitude"]).cast("double").alias("longitude"), F.lit("archive").alias("source"), F.min("date").alias("start_date"), F.max("date").alias("end_date"))
        self.upsert("metadata", extent)
        if train:
            self.train([key])
        return key

    def models(self, kind: str = "sarimax") -> Snapshots:
        """The versions of the fitted states of all cities."""
        return Snapshots(self.spark, f"{self.path('models')}/{kind}")

    def train(self, cities: list[str] | None = None, only: list[int] | None = None) -> int:
        """Fits the models of ``cities`` (all, if None) and publishes their states in place of older ones; other cities' stay. Returns the version.

        A city whose series is too short has no model, and loses one that it had.
        """
        weather = self.read("weather_daily")
        own = weather if cities is None else weather.where(F.col("city").isin(cities))
        with scratch(self.spark):
            fitted = stored(forecast.train_sarimax(own, only), "states").withColumn("trained_at", F.current_timestamp())
            trained = own.select("city").distinct()
            return self.models().commit(lambda old: fitted if old is None else old.join(trained, "city", "left_anti").unionByName(fitted))

    def train_forests(self, trees: int = 600) -> DataFrame:
        """Grows all cities' forests and publishes them; returns (city, part, mae, rmse, n) on the parts held out."""
        days = series.interpolated(series.regular(self.read("weather_daily")), ["tavg"]).select("city", "date", "tavg")
        store = self.models("forest")
        store.commit(lambda _: forecast.train_forests(days, trees))
        return forecast.forest_scores(days, store.read())

    def cities(self) -> DataFrame:
        return tables.cities(self.read("metadata"))

    def history(self, city: str, start: str | None = None, end: str | None = None) -> DataFrame:
        return tables.history(self.read("weather_daily"), city, clean_text(start), clean_text(end))

    def analyse(self, config: Config | None = Config(), endpoint: str = "analyse") -> DataFrame:
        """Daily and monthly tables are upserted for all cities; the payloads, with patterns unless ``config`` is None, come back as (city, payload).

        The run's start and end are logged, and each city's payload is kept with its state; where the run fails the state says so,
        and the last good payload stays.
        """
        run, weather = self.start_run(endpoint, {"config": repr(config)}), self.read("weather_daily")
        cities = weather.select("city").distinct()
        with scratch(self.spark):
            try:
                daily = series.daily_features(weather)
                rows = {"daily_rows": self.upsert("analysis_daily", daily), "monthly_rows": self.upsert("analysis_monthly", rollup.monthly(daily))}
                out = stored(payload(weather, config), "payloads")
            except Exception as e:
                self._append("insights_cache", cities.select("city", F.current_timestamp().alias("at"), F.lit("error").alias("status"), F.lit(None).cast("string").alias("payload"), F.lit(run).alias("run_id")))
                self.end_run(run, "error", error=str(e)[:2000])
                raise
            self._append("insights_cache", out.select("city", F.current_timestamp().alias("at"), F.lit("ok").alias("status"), "payload", F.lit(run).alias("run_id")))
        self.end_run(run, "ok", rows)
        return self.read("insights_cache").where(F.col("run_id") == run).select("city", "payload")

    def insights(self, city: str) -> DataFrame:
        """The city's state and last good payload, or no row."""
        states = self.read("insights_cache").withColumnRenamed("payload", "payload_ref")
        return tables.cached(sinks.cache_states(states), city).withColumnRenamed("payload_ref", "payload")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(name))

    def _log(self, run: str, status: str, **values: str | None) -> None:
        given = self.spark.createDataFrame([(run, status, *(values.get(k) for k in RUN_COLUMNS))], ", ".join(f"{k} string" for k in ("run_id", "status", *RUN_COLUMNS)))
        self._append("execution_runs", given.withColumn("at", F.current_timestamp()))

    def start_run(self, endpoint: str, params: dict | None = None, city: str | None = None) -> str:
        run = uuid.uuid4().hex
        self._log(run, "running", endpoint=endpoint, city=city, params_json=json.dumps(params or {}, sort_keys=True))
        return run

    def end_run(self, run: str, status: str, result: dict | None = None, error: str | None = None) -> None:
        self._log(run, status, result_json=None if result is None else json.dumps(result, sort_keys=True), error=error)

    def runs(self, limit: int = 30) -> DataFrame:
        """The latest runs with their state, times and what was given and returned."""
        log = self.read("execution_runs")
        rest = log.groupBy("run_id").agg(*(F.max(c).alias(c) for c in RUN_COLUMNS))
        return tables.recent_runs(sinks.run_states(log).join(rest, "run_id"), limit)

    def forecast(self, horizon: int = 7, city: str | None = None) -> DataFrame:
        """The days after training of all cities or of one, from their stored states; LookupError where nothing has been trained."""
        states = self.models().read()
        if states is not None and city is not None:
            states = states.where(F.col("city") == city)
        if states is None or (city is not None and states.isEmpty()):
            raise LookupError(f"no model of {city or 'any city'}: train first")
        return forecast.sarimax_ahead(states, clamped(horizon, 1, 30))
