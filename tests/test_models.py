"""Versioned tables, stored models and steps."""

import datetime as dt
import math
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.operators import forecast, series
from isotherm.plans.api import Store
from isotherm.sources import sinks, storage
from isotherm.sources.snapshots import Conflict, Snapshots


def rows(spark, n, city="a", level=10.0, seed=3):
    noise = np.random.default_rng(seed).normal(scale=0.3, size=n)
    data = []
    for i in range(n):
        v = level + 5 * math.sin(2 * math.pi * i / 365.25) + (i % 7 == 0) + float(noise[i])
        data.append((city, dt.date(2018, 1, 1) + dt.timedelta(days=i), v - 1, v + 1, v))
    return spark.createDataFrame(data, "city string, date date, tmin double, tmax double, tavg double")


def test_two_writers_lose_nothing(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    add = lambda v: lambda old: spark.range(v, v + 1) if old is None else old.union(spark.range(v, v + 1))
    assert table.read() is None and table.commit(add(1)) == 1
    times = []

    def slow(old):
        times.append(1)
        if len(times) == 1:  # another writer commits between this one's reading and its commit
            assert table.commit(add(2)) == 2
        return add(3)(old)

    assert table.commit(slow) == 3 and len(times) == 2
    assert sorted(r["id"] for r in table.read().collect()) == [1, 2, 3]
    assert table.versions() == [2, 3] and len([d for d in os.listdir(tmp_path / "t") if d.startswith("data-")]) == 2
    assert sorted(r["id"] for r in table.read(2).collect()) == [1, 2]
    with pytest.raises(LookupError):
        table.read(1)


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    table.commit(lambda _: spark.range(3))
    with pytest.raises(Exception, match="broken"):
        table.commit(lambda old: old.withColumn("id", F.raise_error(F.lit("broken")).cast("long")))
    assert table.read().count() == 3 and table.versions() == [1]

    def always_late(old):
        Snapshots(spark, str(tmp_path / "t"), keep=99).commit(lambda o: o)
        return old

    with pytest.raises(Conflict):
        table.commit(always_late, tries=2)
    assert table.read().count() == 3
    assert not [f for f in os.listdir(tmp_path / "t" / "_commits") if f.startswith("new-")]


def test_a_state_forecasts_as_its_model(spark):
    """Whatever the orders, what is kept of a fit is enough."""
    own = rows(spark, 1200).orderBy("date").toPandas()
    y, x = own["tavg"].to_numpy(), forecast._matrix(own["date"].to_numpy())
    ahead = forecast._matrix([own["date"].iat[-1] + dt.timedelta(days=k) for k in range(1, 31)], origin=own["date"].iat[0])
    for k, order, seasonal in forecast.candidates():
        try:
            fitted = forecast.SeasonalArma(order, seasonal).fit(y, x)
        except ArithmeticError:
            continue
        mean, error = fitted.forecast(ahead)
        state = fitted.state()
        again = forecast.SeasonalArma(order, seasonal).restored(state).forecast(ahead)
        assert np.allclose(mean, again[0]) and np.allclose(error, again[1]), k
        assert len(state["mean"]) <= 10 and len(state["cov"]) == len(state["mean"]) ** 2 and len(state["errors"]) <= 30


def test_models_are_trained_kept_and_read(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.upsert("weather_daily", rows(spark, 1100).unionByName(rows(spark, 1100, "b", 20.0)).unionByName(rows(spark, 200, "short")))
    with pytest.raises(LookupError):
        store.forecast()
    assert store.train(only=[0, 6]) == 1
    first = {r["city"]: r for r in store.models().read().collect()}
    assert set(first) == {"a", "b"} and all(r["candidate"] in (0, 6) and 0 < r["cv_mae"] < 3 for r in first.values())
    direct = {(r["city"], r["date"]): r["tavg"] for r in forecast.sarimax_forecast(store.read("weather_daily"), 5, only=[0, 6]).collect()}
    # a forecast fits nothing
    monkeypatch.setattr(forecast.SeasonalArma, "fit", None)
    monkeypatch.setattr(forecast, "train_sarimax", None)
    got = store.forecast(5).collect()
    assert {(r["city"], r["date"]): r["tavg"] for r in got} == pytest.approx(direct) and len(got) == 10
    assert store.forecast(99, "a").count() == 30
    with pytest.raises(LookupError):
        store.forecast(5, "short")
    monkeypatch.undo()
    # one city is trained again, on more days; the other's state stays
    store.upsert("weather_daily", rows(spark, 1110).where(F.col("date") >= "2021-01-01"))
    assert store.train(["a"], only=[0]) == 2
    second = {r["city"]: r for r in store.models().read().collect()}
    assert second["b"] == first["b"] and second["a"]["train_end"] == first["a"]["train_end"] + dt.timedelta(days=10)


def test_forests_are_scored_on_held_out_parts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert("weather_daily", rows(spark, 1700).unionByName(rows(spark, 100, "short")))
    scores = {r["part"]: r for r in store.train_forests(trees=20).collect()}
    assert set(scores) == {"val", "test"} and all(r["city"] == "a" and 0 < r["mae"] <= r["rmse"] < 1.5 and 360 <= r["n"] <= 366 for r in scores.values())
    assert store.models("forest").read().count() == 20


def test_a_city_without_values_is_refused(spark):
    gone = rows(spark, 20).withColumn("tmin", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="no values to fill tmin"):
        series.enriched_features(gone).collect()
    some = rows(spark, 20).withColumn("tmin", F.when(F.col("date") == "2018-01-05", 1.0))
    assert {r["tmin"] for r in series.enriched_features(some).collect()} == {1.0}


def test_the_last_row_by_its_order_counts(spark, tmp_path):
    path, kinds = str(tmp_path / "t"), "city string, v int, at int"
    batch = spark.createDataFrame([("a", 1, 3), ("a", 2, 9), ("a", 3, 5), ("b", 4, 1)], kinds).repartition(4)
    assert sinks.write_upsert(spark, path, batch, ["city"], "city", ["at"]) == 4
    assert sinks.write_upsert(spark, path, spark.createDataFrame([("a", 7, 1), ("a", 8, 0)], kinds), ["city"], "city", ["at"]) == 2
    assert {r["city"]: r["v"] for r in spark.read.parquet(path).collect()} == {"a": 7, "b": 4}
    assert spark.read.parquet(path).columns == ["v", "city"]


def test_steps_are_each_threads_own(spark, tmp_path):
    before, mine, theirs = storage.steps(), storage.stored(spark.range(3)), []

    def other():
        with storage.scratch(spark):
            storage.stored(spark.range(5)).count()
            theirs.append(storage.steps())
        theirs.append(storage.steps())

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert theirs == [1, 0] and mine.count() == 3
    assert storage.removed(spark, before) == before
