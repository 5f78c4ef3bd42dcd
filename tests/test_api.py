import json

import pytest

from isotherm.functions import scalars, tokens
from isotherm.operators import mining
from isotherm.plans.api import Store, clamped, clean_text
from isotherm.plans.insights import Config
from isotherm.sources import sinks, storage, tables


def answer(spark, n=30):
    days = [f"2020-01-{d:02d}" for d in range(1, n + 1)]
    body = {"daily": {"time": days, "temperature_2m_max": [d + 5.0 for d in range(n)], "temperature_2m_min": [d - 5.0 for d in range(n)], "temperature_2m_mean": [float(d) for d in range(n)]}}
    return spark.createDataFrame([(json.dumps(body),)], "body string")


def test_store_from_ingest_to_insights(spark, tmp_path):
    places = spark.createDataFrame([("New York", "US", 40.7, -74.0)], "name string, country_code string, latitude double, longitude double")
    store, before = Store(spark, str(tmp_path)), storage.steps()
    key = store.add_city("New York", "US", answer(spark), places)
    assert key == "new_york_us" and [r["city"] for r in store.cities().collect()] == [key]
    store.add_city(" new york ", "US", answer(spark), places)
    assert store.history(key).count() == 30 and store.history(key, "2020-01-05", " ").count() == 26
    assert json.loads(store.analyse().first()["payload"])["expected_days"] == 23
    assert store.read("analysis_daily").count() == 23 and store.read("analysis_monthly").count() == 1
    run = store.runs(5).first()
    assert (run["status"], run["endpoint"], json.loads(run["result_json"])) == ("ok", "analyse", {"daily_rows": 23, "monthly_rows": 1}) and run["duration_ms"] >= 0
    kept = store.insights(key).first()
    assert kept["status"] == "ok" and json.loads(kept["payload"])["expected_days"] == 23 and store.insights("nowhere").count() == 0
    with pytest.raises(AttributeError):
        store.analyse(config="none")
    assert store.runs(1).first()["status"] == "error" and store.insights(key).first().asDict() | {"updated_at": 0} == kept.asDict() | {"updated_at": 0, "status": "error"}
    with_patterns = store.analyse(Config(window=7, stride=7, min_rows=2))
    told = json.loads(with_patterns.first()["payload"])
    assert told["config"]["min_rows"] == 2 and told["engine"] == {"search": "closed runs", "truncated": False} and told["n_triclusters"] >= len(told["clusters"]) > 0
    card = told["clusters"][0]
    assert set(card) == {"label", "years", "months", "months_names", "signature_top5", "support", "hvar3", "type"}
    assert card["years"] == [2020] and card["months"] == [1] and card["months_names"] == ["Jan"] and card["support"] >= 2
    assert 1 <= len(card["signature_top5"]) <= 5 and set(card["signature_top5"][0]) == {"feature", "direction", "count"}
    coherent = [c["hvar3"] for c in told["clusters"]]
    assert coherent == sorted(coherent) and len(coherent) <= 12
    assert storage.steps() == before
    with pytest.raises(LookupError):
        store.forecast(7, key)  # 30 days are too few for a model
    with pytest.raises(ValueError):
        store.add_city("Nowhere", None, answer(spark), places)
    with pytest.raises(ValueError):
        store.history(key, "2021-01-01", "2020-01-01")


def test_cleaning():
    assert clean_text("  ") is None and clean_text(" a ") == "a" and clamped(99, 1, 30) == 30


def test_runs_and_cache(spark):
    runs = spark.createDataFrame([("r", "2020-01-01 00:00:00", "running"), ("r", "2020-01-01 00:00:02", "ok"), ("s", "2020-01-01 00:00:01", "running")], "run_id string, at string, status string").selectExpr("run_id", "cast(at as timestamp) as at", "status")
    got = {r["run_id"]: (r["status"], r["duration_ms"]) for r in sinks.run_states(runs).collect()}
    assert got == {"r": ("ok", 2000), "s": ("running", None)}
    assert tables.recent_runs(runs.withColumnRenamed("at", "started_at"), 0).count() == 1
    cache = spark.createDataFrame([("a", 1, "ok", "f1"), ("a", 2, "running", None), ("a", 3, "error", None)], "city string, at int, status string, payload_ref string")
    assert sinks.cache_states(cache).first().asDict() == {"city": "a", "status": "error", "updated_at": 3, "payload_ref": "f1"}


def test_miner_lines_and_frequent_sets(spark):
    rows = spark.createDataFrame([([["a", "x"], [], ["b"]], {"a": 1, "b": 2})], "sets array<array<string>>, ids map<string,int>")
    assert rows.select(tokens.miner_line(rows["sets"], rows["ids"])).first()[0].split() == "<0> 1 -1 <1> -1 <2> 2 -1 -2".split()
    frame = spark.createDataFrame([("c", w, 0, f, f"f{f}_0#s") for w in range(4) for f in range(3) if (w + f) % 4], "city string, window_id int, context_idx int, feature_idx int, token string")
    sets = mining.frequent_sets(mining.supports(frame, 2, "exact"), 3)
    got = {tuple(r["items"]): len(r["tids"]) for r in sets.collect()}
    want = {}
    held = {w: {f"f{f}_0#s" for f in range(3) if (w + f) % 4} for w in range(4)}
    for mask in range(1, 8):
        own = tuple(f"f{f}_0#s" for f in range(3) if mask >> f & 1)
        n = sum(set(own) <= h for h in held.values())
        if n >= 2:
            want[own] = n
    assert got == want


def test_cells_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("f3_12#bin1", " 7 ", 1.5), ("odd", " ", float("nan")), (None, None, None)], "item string, text string, x double")
    split = rows.select(*tokens.split_item(rows["item"])).collect()
    assert [tuple(r) for r in split] == [(3, 12, "bin1"), (None, None, None), (None, None, None)]
    assert [tuple(r) for r in rows.select(scalars.present(rows["text"]), scalars.present(rows["x"])).collect()] == [(" 7 ", 1.5), (None, None), (None, None)]
    assert [tuple(r) for r in rows.select(scalars.safe_int(rows["text"], 4), scalars.safe_float(rows["text"])).collect()] == [(7, 7.0), (4, 0.0), (4, 0.0)]
    days = spark.createDataFrame([("a", "2020-01-01", 1.0, 2.0, 1.5)], "city string, date string, tmin double, tmax double, tavg double").selectExpr("city", "cast(date as date) as date", "tmin", "tmax", "tavg")
    sinks.write_csv(days, f"{tmp_path}/csv")
    sinks.write_csv(days, f"{tmp_path}/more.csv", {"city": "A", "start": "2020-01-01"})
    assert json.loads(spark.read.text(f"{tmp_path}/more.meta.json").first()[0]) == {"city": "A", "start": "2020-01-01"}
    payloads = spark.createDataFrame([("são/x y", '{"a": 1}'), ("b", '{"a": 2}')], "city string, payload string")
    paths = {r["city"]: r["path"] for r in sinks.write_payloads(payloads, f"{tmp_path}/out", "r1", "20200101T000000Z").collect()}
    assert paths["são/x y"].endswith("/file=são_x_y__r1__20200101T000000Z.json")
    assert tables.read_payload(spark, paths["b"]).first()["a"] == 2
    sinks.write_json(days, f"{tmp_path}/json")
    assert tables.read_csv(spark, f"{tmp_path}/csv").collect() == days.collect() and tables.read_payload(spark, f"{tmp_path}/json").first()["tavg"] == 1.5
