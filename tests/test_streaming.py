import datetime as dt
import math

import pandas as pd
import pytest

from isotherm.operators import series, windows
from isotherm.streaming.features import FEATURES, daily_stream

START = dt.date(2019, 12, 20)
SCHEMA = "city string, date date, tmin double, tmax double, tavg double"


def arrivals():
    """Batches of two cities' rows: gaps of days and of values, days out of order, a day told twice; the last batch only moves the watermark."""
    days = {"a": [k for k in range(60) if k not in (5, 6, 20, 21, 22, 41)], "b": [k for k in range(3, 60) if k % 9], "c": list(range(60))}
    out = [[] for _ in range(5)]
    for city, own in days.items():
        for k in own:
            mean = 10 + 5 * math.sin(k / 3) + (k * 7919 % 13) / 7
            low, high = mean - 1 - k % 3, mean + 2
            if k in (3, 12, 30, 31):
                mean = None
            if k in (13, 31) or city == "c" and k < 30:
                low = None
            if city == "c" and 26 <= k < 41:  # what is ready ends before the first known tmin
                mean = None
            at = min(k // 15, 3) if k % 15 < 13 or k > 45 else min(k // 15 + 1, 3)  # the last two days of a batch come with the next
            out[at].append((city, START + dt.timedelta(days=k), low, high, mean))
    out = [batch[::-1] for batch in out]
    out[2].append(("a", START + dt.timedelta(days=44), 1.0, 9.0, 4.0))
    out[4] = [(city, START + dt.timedelta(days=90), 0.0, 1.0, 0.5) for city in days] + [(None, START, 1.0, 2.0, 1.5), ("a", None, 1.0, 2.0, 1.5)]
    return out


def streamed(spark, tmp_path, batches, **how):
    for k, batch in enumerate(batches):
        pd.DataFrame(batch, columns=["city", "date", "tmin", "tmax", "tavg"]).to_json(tmp_path / f"{k}.json", orient="records", lines=True, date_format="iso", default_handler=str)
        stamp = 1_600_000_000 + k
        __import__("os").utime(tmp_path / f"{k}.json", (stamp, stamp))
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/*.json")
    query = daily_stream(rows, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(200)
    if query.exception():
        raise query.exception()
    return spark.read.parquet(str(tmp_path / "out"))


def settled(spark, batches):
    """The batch form of all rows, without what the last batch adds; the last of equal dates stays."""
    last = {(r[0], r[1]): r for batch in batches[:4] for r in batch}
    return series.daily_features(spark.createDataFrame(sorted(last.values()), SCHEMA)).select("city", "date", *FEATURES)


def alike(got, want, keys):
    got, want = (df.toPandas().sort_values(keys).reset_index(drop=True)[[*keys, *FEATURES]] for df in (got, want))
    assert len(want) > 50
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.fixture(autouse=True)
def _store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


def test_days_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    batches = arrivals()
    alike(streamed(spark, tmp_path, batches, late="4 days"), settled(spark, batches), ["city", "date"])


@pytest.mark.parametrize("size,stride", [(10, 4), (5, 7)])
def test_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path, size, stride):
    batches = arrivals()
    alike(streamed(spark, tmp_path, batches, late="4 days", size=size, stride=stride), windows.hopping(settled(spark, batches), size, stride), ["city", "window_id", "context_idx", "date"])


def test_rows_later_than_the_watermark_are_passed_over(spark, tmp_path):
    batches = arrivals()
    batches.insert(3, [("a", START + dt.timedelta(days=5), 50.0, 60.0, 55.0)])
    got = streamed(spark, tmp_path, batches, late="4 days")
    alike(got, settled(spark, arrivals()), ["city", "date"])
