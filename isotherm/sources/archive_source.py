"""A daily archive as a Spark data source: places and years are partitions, days are rows.

After ``register``, ``spark.read.format("daily_archive")`` takes the options ``places`` (JSON list of key, latitude, longitude), ``start`` and ``end`` (dates), and
``url`` (a service that answers by latitude, longitude, start_date and end_date) or ``root`` (a shared folder with stored answers, in
``city=<key>/year=<year>/``). Conditions on city and date narrow the places and years that are asked for at all. Each partition is asked for
by itself and again after a pause where the service fails; a task that is run again asks again and yields the same rows.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..schemas import WEATHER_DAILY

#: What is asked of a service, and seconds that it may take.
FIELDS = ["temperature_2m_min", "temperature_2m_max", "temperature_2m_mean"]
TIMEOUT = 60


@dataclass
class PlaceYear(InputPartition):
    key: str
    latitude: float
    longitude: float
    start: str
    end: str

    def __hash__(self) -> int:
        return hash((self.key, self.start))


def parsed(body: str) -> Iterator[tuple[date, float, float, float]]:
    """Days of an answer by date, without those that lack a value."""
    daily = json.loads(body).get("daily", {})
    rows = zip(daily.get("time", []), *(daily.get(f, []) for f in FIELDS), strict=True)
    yield from sorted((date.fromisoformat(t), *map(float, v)) for t, *v in rows if None not in v)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.places = {p["key"]: p for p in json.loads(options["places"])}
        self.start, self.end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        self.url, self.root = options.get("url"), options.get("root")
        self.tries, self.pause = int(options.get("tries", "4")), float(options.get("pause", "1"))
        if bool(self.url) == bool(self.root):
            raise ValueError("give either url or root")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows places and days; Spark checks the conditions again."""
        for f in filters:
            if f_is(f, EqualTo, "city"):
                self.places = {k: p for k, p in self.places.items() if k == f.value}
            elif f_is(f, In, "city"):
                self.places = {k: p for k, p in self.places.items() if k in f.value}
            elif f_is(f, EqualTo, "date"):
                self.start, self.end = max(self.start, f.value), min(self.end, f.value)
            elif f_is(f, (GreaterThan, GreaterThanOrEqual), "date"):
                self.start = max(self.start, f.value)
            elif f_is(f, (LessThan, LessThanOrEqual), "date"):
                self.end = min(self.end, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        years = range(self.start.year, self.end.year + 1) if self.start <= self.end else ()
        return [PlaceYear(k, float(p["latitude"]), float(p["longitude"]), max(self.start, date(y, 1, 1)).isoformat(), min(self.end, date(y, 12, 31)).isoformat()) for k, p in self.places.items() for y in years]

    def read(self, partition: PlaceYear) -> Iterator[tuple]:
        if not isinstance(partition, PlaceYear):  # Spark makes up one where there is none
            return
        first, last = date.fromisoformat(partition.start), date.fromisoformat(partition.end)
        for body in self.answers(partition):
            for day, *values in parsed(body):
                if first <= day <= last:
                    yield (partition.key, day, *values)

    def answers(self, partition: PlaceYear) -> Iterator[str]:
        for k in range(self.tries):
            try:
                found = list(self.stored(partition) if self.root else [self.asked(partition)])
                break
            except OSError:
                if k == self.tries - 1:
                    raise
                time.sleep(self.pause * 2**k)
        yield from found

    def asked(self, partition: PlaceYear) -> str:
        asked = {"latitude": partition.latitude, "longitude": partition.longitude, "start_date": partition.start, "end_date": partition.end, "daily": ",".join(FIELDS), "timezone": "auto"}
        with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(asked)}", timeout=TIMEOUT) as answer:
            return answer.read().decode()

    def stored(self, partition: PlaceYear) -> Iterator[str]:
        """Answers in the files of a place and year; none where there is no such folder."""
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.root)
        where = fs.FileSelector(f"{root}/city={partition.key}/year={partition.start[:4]}", allow_not_found=True)
        for info in files.get_file_info(where):
            if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
                with files.open_input_stream(info.path) as stream:
                    yield from filter(None, stream.read().decode().split("\n"))


def f_is(condition: Filter, kind: type | tuple[type, ...], column: str) -> bool:
    return isinstance(condition, kind) and condition.attribute == (column,)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "daily_archive"

    def schema(self) -> str:
        return WEATHER_DAILY

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and has conditions pushed to such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
