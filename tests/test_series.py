import datetime as dt
import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isotherm.functions import keys, scalars, tokens
from isotherm.operators import bins, forecast, mining, rollup, series, triclusters, windows, yearly_clusters
from isotherm.plans.insights import Config, find_triclusters
from isotherm.sources import sinks, tables

DAY = dt.date(2020, 1, 1)


def daily(spark, values, city="a", start=DAY):
    rows = [(city, start + dt.timedelta(days=i), v - 1 if v is not None else None, v + 1 if v is not None else None, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "city string, date date, tmin double, tmax double, tavg double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_interpolation_fills_gaps_and_both_ends(spark):
    values = [None, None, 1.0, None, None, 4.0, None, 2.0, None, None]
    got = column(series.interpolated(daily(spark, values)), "tavg")
    assert got == [1, 1, 1, 2, 3, 4, 3, 2, 2, 2]
    assert got == pd.Series(values).interpolate(limit_direction="both").tolist()


def test_regular_has_every_day_once(spark):
    rows = daily(spark, [1.0] * 3).unionByName(daily(spark, [2.0] * 2, start=DAY + dt.timedelta(days=10)))
    got = series.regular(rows)
    assert got.count() == 12 and got.where("tavg is null").count() == 7


@pytest.mark.parametrize(("n", "left"), [(5, 0), (8, 1), (40, 33)])
def test_daily_features_drop_the_first_week(spark, n, left):
    assert series.daily_features(daily(spark, [float(i % 5) for i in range(n)])).count() == left


def test_features_equal_pandas(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=60).tolist()
    got = series.features(daily(spark, values)).orderBy("date").toPandas()
    s = pd.Series(values)
    for name, want in {"delta_1": s.diff(1), "delta_7": s.diff(7), "roll_mean_7": s.rolling(7).mean(), "roll_std_7": s.rolling(7).std()}.items():
        np.testing.assert_allclose(got[name], want, atol=1e-9)
    np.testing.assert_allclose(got["doy_sin"] ** 2 + got["doy_cos"] ** 2, 1)


def test_enriched_keeps_short_and_constant_series(spark):
    got = series.enriched_features(daily(spark, [2.0] * 5)).collect()
    assert len(got) == 5 and all(r["roll_std_7"] == 0 and r["anomaly_z"] == 0 and r["delta_7"] == 0 and r["temp_band"] == "cold" for r in got)


def test_keep_last_and_upsert_are_idempotent(spark):
    old, new = daily(spark, [1.0, 2.0]), daily(spark, [5.0], start=DAY + dt.timedelta(days=1))
    once = sinks.upsert(old, new, ["city", "date"])
    twice = sinks.upsert(once, new, ["city", "date"])
    assert column(once, "tavg") == column(twice, "tavg") == [1.0, 5.0]


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_upsert(spark, path, daily(spark, [1.0], "a").unionByName(daily(spark, [2.0], "b")), ["city", "date"], "city")
    assert sinks.write_upsert(spark, path, daily(spark, [3.0, 4.0], "a"), ["city", "date"], "city") == 2
    got = {(r["city"], r["date"]): r["tavg"] for r in spark.read.parquet(path).collect()}
    assert got == {("a", DAY): 3.0, ("a", DAY + dt.timedelta(days=1)): 4.0, ("b", DAY): 2.0}


def test_first_longest_run(spark):
    marks = [0, 1, 1, 0, 1, 1, 1, 0, 1, 1, 1]
    got = rollup.longest_run(daily(spark, [float(m) for m in marks]), F.col("tavg") > 0).first()
    assert (got["length"], got["start"]) == (3, DAY + dt.timedelta(days=4))
    none = rollup.longest_run(daily(spark, [0.0]), F.col("tavg") > 0).first()
    assert (none["length"], none["start"], none["end"]) == (0, None, None)


def test_trend_of_one_year_is_zero(spark):
    months = rollup.monthly(series.features(daily(spark, [1.0] * 40)))
    assert rollup.trend(months).first()["trend_per_year"] == 0


def test_hopping_windows(spark):
    got = windows.hopping(daily(spark, [float(i) for i in range(20)]), 7, 3).collect()
    want = {(k, c): float(k * 3 + c) for k in range(5) for c in range(7)}
    assert {(r["window_id"], r["context_idx"]): r["tavg"] for r in got} == want
    assert windows.hopping(daily(spark, [1.0] * 6), 7, 3).count() == 0
    with pytest.raises(ValueError):
        windows.hopping(daily(spark, [1.0]), 0, 1)


def test_even_windows_have_two_centers(spark):
    rows = windows.hopping(daily(spark, [1.0] * 14), 14, 14)
    a, b = windows.window_meta(rows, 14).first(), windows.window_midpoints(rows).first()
    assert (a["center_date"] - b["center_date"]).days == 1
    assert windows.broken_windows(rows, 14).count() == 0


def test_bins_are_monotone_and_clamped(spark):
    edges = F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.5, 1.0, 2.5, 3.0, 9.0)], "v double")
    assert [r[0] for r in rows.select(scalars.bin_label(F.col("v"), edges)).collect()] == ["bin0", "bin0", "bin1", "bin2", "bin2", "bin2"]
    cube = spark.createDataFrame([("a", 0, 0, 0, 5.0, None)] * 4, "city string, window_id int, context_idx int, feature_idx int, num double, sym string")
    assert bins.edges(cube, 3).first()["edges"] == [5.0, 5.0]
    assert bins.edges(cube, 3, "eq_width").first()["edges"] == [5.0, 5.0]


def test_keys(spark):
    rows = spark.createDataFrame([(" New York ", "US"), ("MIDDLE EAST", " "), ("Ulm", None)], "c string, k string")
    got = rows.select(keys.city_key(F.col("c"), F.col("k")).alias("key"))
    assert [r[0] for r in got.collect()] == ["new_york_us", "middle_east", "ulm"]
    name, country = keys.parse_city_key(F.col("key"))
    assert [tuple(r) for r in got.select(name, country).collect()] == [("new york", "US"), ("middle east", None), ("ulm", None)]
    months = spark.createDataFrame([(1,), (12,), (13,), (0,)], "m int").select(keys.month_name(F.col("m")))
    assert [r[0] for r in months.collect()] == ["Jan", "Dec", "13", "0"]


def test_token_strings(spark):
    rows = spark.createDataFrame([("(f0_0#bin1 f7_0#winter) (f0_1#bin2) f3#x nonsense",)], "p string")
    flat = rows.select(F.explode(tokens.tokens_in(F.col("p"))).alias("t"))
    got = [tuple(r) for r in flat.select(tokens.feature_of(F.col("t")), tokens.offset_of(F.col("t")), tokens.symbol_of(F.col("t"))).collect()]
    assert got == [(0, 0, "bin1"), (7, 0, "winter"), (0, 1, "bin2"), (3, None, "x")]
    line = spark.createDataFrame([("1 3 -1 2 -1 -2 #SUP: 4 #SID: 7 2 x 2",)], "l string")
    assert tuple(line.select(*tokens.parse_miner_line(F.col("l"))).first()) == ([[1, 3], [2]], 4, [2, 7])


def closed_by_hand(rows, least, min_offsets):
    """Runs of closed sets by plain enumeration."""
    found = {}
    ids = list(rows)
    for mask in range(1, 1 << len(ids)):
        tids = [i for k, i in enumerate(ids) if mask >> k & 1]
        common = set.intersection(*(rows[i] for i in tids))
        run = []
        for offset in [*sorted({o for o, _ in common}), 10**6]:
            if run and offset != run[-1] + 1:
                if len(run) >= min_offsets:
                    items = frozenset(x for x in common if x[0] in run)
                    found[items] = frozenset(i for i in ids if items <= rows[i])
                run = []
            run.append(offset)
    return {k: v for k, v in found.items() if len(v) >= least}


@pytest.mark.parametrize("seed", [1, 2])
def test_closed_patterns_equal_enumeration(spark, seed):
    rng = np.random.default_rng(seed)
    rows = {w: {(o, f"f{f}_{o}#{rng.integers(2)}") for f in range(2) for o in range(4)} for w in range(6)}
    data = [("a", w, o, int(t[1]), t) for w, items in rows.items() for o, t in items]
    frame = spark.createDataFrame(data, "city string, window_id int, context_idx int, feature_idx int, token string")
    got, cut = mining.patterns(mining.supports(frame, 2, "exact"), 2)
    mined = {frozenset((int(t.split("_")[1].split("#")[0]), t) for s in r["itemsets"] for t in s): frozenset(r["subject_ids"]) for r in got.collect()}
    want = {k: v for k, v in closed_by_hand(rows, 2, 2).items()}
    assert not cut and mined == want


def test_runs_are_all_found_in_every_city(spark):
    rng = np.random.default_rng(5)
    data = {c: {w: {(o, f"f{f}_{o}#{rng.integers(2)}") for f in range(2) for o in range(4)} for w in range(n)} for c, n in (("a", 7), ("b", 4))}
    rows = [(c, w, o, int(t[1]), t) for c, windows_ in data.items() for w, items in windows_.items() for o, t in items]
    frequent = mining.supports(spark.createDataFrame(rows, "city string, window_id int, context_idx int, feature_idx int, token string"), 2, "exact")
    got, cut = mining.patterns(frequent, 2, max_sets=1)
    mined = {(r["city"], frozenset((int(t.split("_")[1].split("#")[0]), t) for s in r["itemsets"] for t in s)): frozenset(r["subject_ids"]) for r in got.collect()}
    assert not cut and mined == {(c, k): v for c, own in data.items() for k, v in closed_by_hand(own, 2, 2).items()}
    # without runs the bound is each city's own: b's search goes on to its end
    whole, _ = mining.patterns(frequent, 1, contiguous=False)
    sizes = {r["city"]: r["count"] for r in whole.groupBy("city").count().collect()}
    some, cut = mining.patterns(frequent, 1, contiguous=False, max_sets=sizes["b"])
    assert sizes["a"] > sizes["b"] and cut == ["a"] and some.where("city = 'b'").count() == sizes["b"]


def test_closed_patterns_cover_every_day(spark, monkeypatch):
    from isotherm.plans import queries

    values = [math.sin(i / 9) * 10 + (i * 7919 % 13) / 7 for i in range(150)]
    monkeypatch.setattr(queries, "weather", lambda *_: daily(spark, values))
    got = queries.closed_patterns(spark, "").agg(F.max("support"), F.min("support")).first()
    # ten windows of 14 days; of windows of 3 days every 30 there are five
    assert tuple(got) == (10, 8)


def test_support_thresholds():
    assert mining.min_support(234, 8) == 10 and mining.min_support(234, 8, "exact") == 8 and mining.min_support(0, 3) == 3


def test_hvar3_of_a_constant_block_is_zero(spark):
    cube = spark.createDataFrame([("a", w, c, f, 2.0 if f < 7 else None, None if f < 7 else "x") for w in range(3) for c in range(2) for f in (0, 7)], "city string, window_id int, context_idx int, feature_idx int, num double, sym string")
    block = spark.createDataFrame([("a", 0, [0, 1, 2], [0, 7], [0, 1])], "city string, id int, rows array<int>, cols array<int>, contexts array<int>")
    assert triclusters.coherence(block, cube).first()["hvar3"] == 0


def test_overlap_filter_is_greedy(spark):
    rows = [("a", 0, list(range(10)), 0.1), ("a", 1, list(range(9)), 0.2), ("a", 2, list(range(20, 30)), 0.3)]
    blocks = spark.createDataFrame(rows, "city string, id int, rows array<int>, hvar3 double").selectExpr("city", "id", "rows", "array(0, 1) as cols", "array(0, 1) as contexts", "hvar3")
    blocks = triclusters.described(blocks)
    assert {r["id"] for r in triclusters.overlap_filtered(blocks, 0.7).collect()} == {0, 2}
    assert triclusters.overlap_filtered(blocks, None).count() == 3
    assert {(r["a"], r["b"], round(r["jaccard"], 3)) for r in triclusters.overlaps(blocks).collect()} == {(0, 1, 0.9)}


def test_triclusters_hold_their_limits(spark):
    values = [math.sin(i / 9) * 10 + (i * 7919 % 13) / 7 for i in range(200)]
    config = Config(window=2, stride=5, min_rows=9, min_features=2, min_offsets=2)
    blocks, meta, cut = find_triclusters(daily(spark, values), config)
    got = blocks.collect()
    assert got and not cut and meta.count() == 40
    assert all(len(b["rows"]) >= 9 and len(b["cols"]) >= 2 and len(b["contexts"]) >= 2 and b["hvar3"] <= 0.4 and b["label"] for b in got)


def test_payload_says_whether_its_search_was_cut(spark, monkeypatch):
    from isotherm.plans import insights

    found = spark.createDataFrame([("a", 0, 1, "x", 9, 0.1, "mixed", [1, 2], "(f0_0#bin1 f7_0#hot)")], "city string, id int, place int, label string, support int, hvar3 double, type string, rows array<int>, pattern_string string")
    blocks = found.withColumn("shape", F.struct(F.lit(4).alias("volume")))
    meta = spark.createDataFrame([("a", w, DAY, DAY, DAY + dt.timedelta(days=31 * w)) for w in range(3)], "city string, window_id int, start_date date, end_date date, center_date date")
    monkeypatch.setattr(insights, "find_triclusters", lambda *_: (blocks, meta, ["a"]))
    got = json.loads(insights.payload(daily(spark, [float(i % 5) for i in range(40)]), Config()).first()["payload"])
    assert got["truncated"] is True and len(got["clusters"]) == 1 and got["engine"]["truncated"] is True
    assert got["clusters"][0]["months_names"] == ["Feb", "Mar"] and [t["direction"] for t in got["clusters"][0]["signature_top5"]] == ["bin1", "hot"]
    assert json.loads(insights.payload(daily(spark, [1.0] * 40), Config(overlap=None)).first()["payload"])["config"].get("overlap") is None


def test_archive_answers(spark):
    body = '{"daily": {"time": ["2020-01-02", "2020-01-01", "2020-01-03"], "temperature_2m_max": [3, 2, null], "temperature_2m_min": [1, 0, 1], "temperature_2m_mean": [2, 1, 2]}}'
    got = tables.archive_rows(spark.createDataFrame([("a", body)], "city string, body string"))
    assert column(got, "tavg") == [1.0, 2.0]


def test_folds_and_forecast(spark):
    assert forecast.folds(80) == [(50, 80)] and len(forecast.folds(100)) == 2 and forecast.folds(200) == [(110, 140), (140, 170), (170, 200)]
    noise = np.random.default_rng(3).normal(scale=0.3, size=1200)
    values = [10 + 5 * math.sin(2 * math.pi * i / 365.25) + (i % 7 == 0) + float(noise[i]) for i in range(1200)]
    got = forecast.sarimax_forecast(daily(spark, values), 7, only=[0, 6]).orderBy("date").toPandas()
    want = [10 + 5 * math.sin(2 * math.pi * i / 365.25) + (i % 7 == 0) for i in range(1200, 1207)]
    assert len(got) == 7 and np.abs(got["tavg"] - want).mean() < 0.5
    assert (got["lower_95"] <= got["tavg"]).all() and (got["tavg"] <= got["upper_95"]).all()


def test_fits_cover_all_cities_by_the_operators_defaults(spark, monkeypatch):
    from isotherm.plans import queries

    rows, fits = daily(spark, [1.0] * 20, "a").unionByName(daily(spark, [2.0] * 20, "b")), []
    monkeypatch.setattr(queries, "weather", lambda *_: rows)

    def noted(result):
        def fit(df, *args, **kw):
            fits.append((*args, *kw.items()))
            return result

        return fit

    clusters = spark.createDataFrame([("x", ["tavg_mean"], ["tavg_std"])], "city string, high array<string>, low array<string>")
    monkeypatch.setattr(queries.forecast, "train_forests", noted(None))
    monkeypatch.setattr(queries.forecast, "forest_forecast", lambda df, forests: df)
    monkeypatch.setattr(queries.yearly_clusters, "clusters", noted(clusters))
    monkeypatch.setattr(queries.forecast, "sarimax_forecast", noted(rows))
    assert queries.rf_forecast(spark, "").select("city").distinct().count() == 2 and queries.kmeans_regimes(spark, "").count() == 1
    queries.sarimax_forecast(spark, "")
    assert fits == [(), (), (7,)]


def test_a_tree_splits_where_squared_errors_fall_most():
    draw = np.random.default_rng(5)
    x, y = draw.integers(0, 9, size=(60, 3)).astype(float), draw.normal(size=60)

    def least(xs, ys):
        """(errors, feature, threshold) of the best split."""
        cuts = [(j, (a + b) / 2) for j in range(3) for a, b in itertools.pairwise(np.unique(xs[:, j]))]
        parts = lambda j, t: [ys[xs[:, j] <= t], ys[xs[:, j] > t]]
        return min(((sum(((p - p.mean()) ** 2).sum() for p in parts(j, t)), j, t) for j, t in cuts), default=None)

    feature, threshold, child, mean = forecast._tree(x, y, None, np.random.default_rng(1))
    pick = np.random.default_rng(1).integers(60, size=60)
    todo, seen = [(0, x[pick], y[pick])], 0
    while todo:
        k, xs, ys = todo.pop()
        seen += 1
        assert mean[k] == pytest.approx(ys.mean())
        if feature[k] < 0:
            assert np.ptp(ys) == 0 or least(xs, ys) is None
            continue
        right = xs[:, feature[k]] > threshold[k]
        assert sum(((p - p.mean()) ** 2).sum() for p in (ys[~right], ys[right])) == pytest.approx(least(xs, ys)[0], abs=1e-9)
        todo += [(child[k], xs[~right], ys[~right]), (child[k] + 1, xs[right], ys[right])]
    assert seen == len(feature)
    assert len(forecast._tree(x, y, 1, np.random.default_rng(1))[0]) == 3


def test_forests_of_all_cities(spark, tmp_path):
    values = [10 + 5 * math.sin(2 * math.pi * i / 365.25) for i in range(1300)]
    rows = daily(spark, values, "a").unionByName(daily(spark, [2.0] * 1300, "b")).unionByName(daily(spark, [1.0] * 200, "c")).select("city", "date", "tavg")
    forecast.train_forests(rows, trees=30).write.parquet(str(tmp_path / "forests"))
    forests = spark.read.parquet(str(tmp_path / "forests"))
    assert {r["city"]: r["count"] for r in forests.groupBy("city").count().collect()} == {"a": 30, "b": 30}
    got = forecast.forest_forecast(rows, forests, 5).orderBy("city", "date").toPandas()
    assert got["city"].tolist() == ["a"] * 5 + ["b"] * 5
    want = [10 + 5 * math.sin(2 * math.pi * i / 365.25) for i in range(1300, 1305)]
    assert np.abs(got["tavg"][:5] - want).max() < 0.5 and (got["tavg"][5:] == 2.0).all()


def test_years_are_clustered_at_least_cost_in_every_city(spark):
    draw = np.random.default_rng(3)
    rows = [(city, 2000 + y, m, *(10 * level[y] + draw.normal(size=6)).tolist()) for city, level in (("a", [0, 1, 2, 0, 1, 2]), ("b", [0, 0, 1, 1, 2, 2])) for y in range(6) for m in range(1, 13) if (y, m) != (3, 4)]
    months = spark.createDataFrame(rows, "city string, year int, month int, " + ", ".join(f"{c} double" for c in yearly_clusters.MONTHLY))
    got = yearly_clusters.clusters(months).toPandas()
    cells = yearly_clusters.standardised(months).toPandas().sort_values(["city", "year", "month"])
    for city, own in got.groupby("city"):
        points = cells[cells["city"] == city][yearly_clusters.MONTHLY].to_numpy().reshape(6, -1)
        cost = lambda groups: sum(((points[g] - points[g].mean(axis=0)) ** 2).sum() for g in groups)  # noqa: B023, E731
        found = [np.array(y) - 2000 for y in own.drop_duplicates("year_cluster")["years"]]
        splits = ([np.flatnonzero(np.array(s) == c) for c in set(s)] for s in itertools.product(range(3), repeat=6))
        assert cost(found) == pytest.approx(min(map(cost, splits)))
        assert all(sorted(sum(map(list, part["months"]), [])) == list(range(1, 13)) for _, part in own.groupby("year_cluster"))
        assert [len(h) + len(low) for h, low in zip(own["high"], own["low"], strict=True)] == [5] * len(own)
    assert yearly_clusters.clusters(months.where("year = 2000 and city = 'a'")).select("year_cluster").distinct().count() == 1
    assert yearly_clusters.clusters(months.where("false")).count() == 0


def test_stream_upsert(spark, tmp_path):
    from isotherm.streaming.incremental import upsert_stream

    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    daily(spark, [1.0, 2.0]).write.parquet(source)
    rows = spark.readStream.schema(daily(spark, []).schema).parquet(source)
    upsert_stream(rows, path, ["city", "date"], "city", str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.parquet(path).count() == 2
