"""Long series in segments and selected quantiles against the plain plans."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.operators import bins, quantiles, rollup, segments, series
from isotherm.schemas import SYMBOLIC

KINDS = "city string, date date, tmin double, tmax double, tavg double"
FIRST = dt.date(1999, 12, 20)


def gappy(spark, seed=1):
    """Cities with long gaps, missing values at both ends, few rows, and one row."""
    rng, rows = np.random.default_rng(seed), []
    for city, n, share in (("a", 900, 0.3), ("b", 400, 0.9), ("c", 5, 1.0), ("d", 1, 1.0), ("e", 700, 0.02)):
        for i in range(n):
            if i in (0, n - 1) or rng.random() < share:
                v = [None if rng.random() < 0.2 else round(float(rng.normal(10, 5)), 3) for _ in range(3)]
                rows.append((city, FIRST + dt.timedelta(days=i), *(v if 0 < i < n - 1 or n < 6 else [None] * 3)))
    rows += [("f", FIRST + dt.timedelta(days=i), 1.0, 3.0, 2.0) for i in range(60)]
    known = [("c", 1.0), ("d", 2.0)]
    return spark.createDataFrame([(*r[:2], *(dict(known).get(r[0], x) if x is None else x for x in r[2:])) for r in rows], KINDS)


def same(got, want, columns, near=("city", "date")):
    a, b = (df.select(*near, *columns).toPandas().sort_values(list(near)).reset_index(drop=True) for df in (got, want))
    assert len(a) == len(b) and a[list(near)].equals(b[list(near)])
    for c in columns:
        if a[c].dtype == object:
            assert (a[c].fillna("-") == b[c].fillna("-")).all(), c
        else:
            assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True, rtol=1e-9, atol=1e-9), c


@pytest.mark.parametrize("days", [7, 50, 3650])
def test_segments_give_the_plain_features(spark, days):
    rows = gappy(spark)
    same(segments.regular(rows, days), series.regular(rows), series.VALUES)
    same(segments.features(rows, days), series.features(rows), series.VALUES + series.DAILY)
    same(segments.daily_features(rows, days), series.daily_features(rows), series.DAILY)


def test_segments_give_the_plain_classes(spark):
    rows = gappy(spark, 2)
    same(segments.enriched_features(rows, days=30), series.enriched_features(rows), series.VALUES + series.DAILY + SYMBOLIC)


@pytest.mark.parametrize("days", [3, 10, 1000])
def test_runs_across_segments(spark, days):
    rng, rows = np.random.default_rng(4), []
    for city, share in (("a", 0.5), ("b", 0.97), ("c", 0.0), ("d", 1.0)):
        at = 0
        for _ in range(120):
            at += int(rng.integers(1, 12)) if rng.random() < 0.2 else 1
            rows.append((city, FIRST + dt.timedelta(days=at), None, None, None if rng.random() < 0.02 else float(rng.random() < share)))
    df = spark.createDataFrame(rows, KINDS)
    key = lambda r: (r["city"], r["length"], r["start"], r["end"])
    assert sorted(map(key, segments.longest_run(df, F.col("tavg") > 0, days).collect())) == sorted(map(key, rollup.longest_run(df, F.col("tavg") > 0).collect()))


@pytest.mark.parametrize("buckets", [2, 1024])
def test_selected_quantiles_are_exact(spark, monkeypatch, buckets):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rng = np.random.default_rng(6)
    groups = {"even": rng.normal(size=500), "ties": rng.integers(0, 3, 400).astype(float), "one": np.array([4.0]), "same": np.full(30, 2.5), "two": np.array([1.0, 9.0]), "wide": np.r_[rng.normal(size=50) * 1e-12, 1e15, -1e300, 1.7e308, -1.7e308]}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("even", None), ("none", None), ("ties", float("nan"))]
    df, p = spark.createDataFrame(rows, "k string, v double"), [0.0, 1 / 3, 0.5, 2 / 3, 0.9, 1.0]
    got = {r["k"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ["k"], "v", p).collect()}
    want = {r["k"]: r["q"] for r in df.where("v is not null and not isnan(v)").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, p))).alias("q")).collect()}
    assert set(got) == set(want) == set(groups)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-15), k
    assert quantiles.exact_quantiles(df.where("false"), ["k"], "v", p).count() == 0


def test_edges_of_bins(spark):
    rng = np.random.default_rng(2)
    cube = spark.createDataFrame([("a", f, float(v), None) for f in range(3) for v in (rng.normal(size=90) if f < 2 else np.zeros(9))] + [("b", 0, None, None), ("b", 7, None, "x")], "city string, feature_idx int, num double, sym string")
    key = lambda r: (r["city"], r["feature_idx"], [round(e, 12) for e in r["edges"]])
    assert sorted(map(key, quantiles.bins_of(cube, 3).collect())) == sorted(map(key, bins.edges(cube, 3).collect()))


def unsteady(df, columns):
    """``df`` whose numbers are up to a few last digits apart each time that they are worked out, as sums of floats over a cluster are."""

    def moved(batches):
        rng = np.random.default_rng()
        for batch in batches:
            yield batch.assign(**{c: batch[c] * (1 + rng.integers(-4, 5, len(batch)) * 2.0**-52) for c in columns})

    return df.mapInPandas(moved, df.schema)


def test_quantiles_of_values_that_differ_when_worked_out_again(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(10, 5, (3, 301))
    df = unsteady(spark.createDataFrame([(f"k{k}", float(x)) for k, own in enumerate(v) for x in own], "k string, v double"), ["v"])
    got = {r["k"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ["k"], "v", [0.0, 1 / 3, 0.5, 1.0]).collect()}
    assert {k: len(q) for k, q in got.items()} == {"k0": 4, "k1": 4, "k2": 4}
    for k, own in enumerate(v):
        assert got[f"k{k}"] == pytest.approx(np.quantile(own, [0.0, 1 / 3, 0.5, 1.0]), rel=1e-12)


def test_bands_are_cut_by_the_values_they_come_with(spark):
    """The cuts of 400 days are values of days, each of which is on its cut's lower side."""
    rng = np.random.default_rng(9)
    rows = [(c, FIRST + dt.timedelta(days=i), float(x), float(x + 7 + rng.random()), float(x + 3)) for c in ("a", "b", "c", "d") for i, x in enumerate(rng.normal(10, 5, 400))]
    got = segments.enriched_features(unsteady(spark.createDataFrame(rows, KINDS), series.VALUES), days=90).toPandas()
    assert len(got) == 1600
    for _, own in got.groupby("city"):
        assert own["temp_band"].value_counts().to_dict() == {"cold": 134, "mild": 133, "hot": 133}
        assert own["diurnal_band"].value_counts().to_dict() == {"low": 134, "medium": 133, "high": 133}
