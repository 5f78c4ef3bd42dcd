"""The archive as a data source."""

import json
import os
from datetime import date

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from isotherm.sources import archive_source as a

PLACES = json.dumps([{"key": "aa", "latitude": 1.5, "longitude": 2}, {"key": "bb", "latitude": 3, "longitude": 4}])


def answer(days, missing=()):
    return json.dumps({"daily": {"time": days, "temperature_2m_min": [None if d in missing else 1.0 for d in days], "temperature_2m_max": [3.0] * len(days), "temperature_2m_mean": [2.0 + k for k in range(len(days))]}})


def stored(root):
    for city, year, days in (("aa", 2019, ["2019-12-31", "2019-12-30"]), ("aa", 2020, ["2020-01-02", "2020-01-01", "2020-06-01"]), ("bb", 2020, ["2020-01-01"])):
        os.makedirs(f"{root}/city={city}/year={year}")
        with open(f"{root}/city={city}/year={year}/part-0.txt", "w") as f:
            f.write(answer(days, {"2020-06-01"}) + "\n")


def options(root, **more):
    return {"places": PLACES, "start": "2019-12-31", "end": "2021-12-31", "root": f"file://{root}", "pause": "0"} | more


def test_stored_answers(spark, tmp_path):
    stored(tmp_path)
    a.register(spark)
    rows = spark.read.format("daily_archive").options(**options(tmp_path)).load()
    assert [(f.name, f.dataType.simpleString()) for f in rows.schema] == [("city", "string"), ("date", "date"), ("tmin", "double"), ("tmax", "double"), ("tavg", "double")]
    got = sorted((r["city"], r["date"].isoformat(), r["tavg"]) for r in rows.collect())
    assert got == [("aa", "2019-12-31", 2.0), ("aa", "2020-01-01", 3.0), ("aa", "2020-01-02", 2.0), ("bb", "2020-01-01", 2.0)]
    assert rows.rdd.getNumPartitions() == 6
    assert rows.where("city = 'bb' and date < '2020-01-02'").count() == 1 and rows.where("date > '2030-01-01'").count() == 0


def test_conditions_narrow_what_is_asked(tmp_path):
    reader = a.ArchiveReader(options(tmp_path))
    pushed = [GreaterThanOrEqual(("date",), date(2020, 5, 1)), LessThan(("date",), date(2021, 2, 1)), In(("city",), ("bb", "cc")), EqualTo(("tmin",), 1.0)]
    assert list(reader.pushFilters(pushed)) == pushed  # checked again by Spark
    assert [(p.key, p.start, p.end) for p in reader.partitions()] == [("bb", "2020-05-01", "2020-12-31"), ("bb", "2021-01-01", "2021-02-01")]
    list(reader.pushFilters([EqualTo(("city",), "none")]))
    assert reader.partitions() == []


def test_a_failing_service_is_asked_again(monkeypatch):
    reader = a.ArchiveReader({"places": PLACES, "start": "2020-01-01", "end": "2020-12-31", "url": "http://localhost:9/daily", "tries": "3", "pause": "0"})
    asked = []

    class Reply:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self):
            return answer(["2020-01-02", "2020-01-01"]).encode()

    def urlopen(url, timeout):
        asked.append(url)
        if len(asked) < 3:
            raise OSError("down")
        return Reply()

    monkeypatch.setattr(a.urllib.request, "urlopen", urlopen)
    rows = list(reader.read(reader.partitions()[0]))
    assert rows == [("aa", date(2020, 1, 1), 1.0, 3.0, 3.0), ("aa", date(2020, 1, 2), 1.0, 3.0, 2.0)] and len(asked) == 3
    assert "latitude=1.5&longitude=2.0&start_date=2020-01-01&end_date=2020-12-31" in asked[0]
    monkeypatch.setattr(a.urllib.request, "urlopen", lambda *_, **__: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError, match="down"):
        list(reader.read(reader.partitions()[0]))


def test_one_way_to_answers():
    for more in ({}, {"url": "http://x", "root": "file:///x"}):
        with pytest.raises(ValueError):
            a.ArchiveReader({"places": PLACES, "start": "2020-01-01", "end": "2020-12-31", **more})
