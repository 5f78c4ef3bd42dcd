"""Daily features and hopping windows as rows arrive, with what a city needs of its past kept as state.

A day is settled once the watermark has passed it; settled days are filled and worked out in order of date, whatever the
order in which they came. The state of a city holds the rows not settled yet (bounded by the lateness), the settled ones
behind an open gap (bounded by the gap), and the last seven rows or the last window. Rows are those of the batch form
(``series.daily_features``, ``windows.hopping``) with these differences: ``anomaly_z`` is left out, as it hangs on days
to come; days after the last known value wait for the next one; rows later than the watermark are passed over; of
equal dates the one that came last stays. Rows without city or date are left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import YEAR_DAYS
from ..operators.series import DAILY, VALUES

FEATURES = [*VALUES, *(c for c in DAILY if c != "anomaly_z")]
DAY_MS, EPOCH, BEHIND = 86_400_000, dt.date(1970, 1, 1), 7
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(flat: list[float] | None, width: int) -> np.ndarray:
    return np.array(flat if flat is not None else [], dtype=float).reshape(-1, width)


class DailyState(StatefulProcessor):
    """Rows of full features of each city; with ``size`` whole windows of them, as soon as they are whole."""

    def __init__(self, size: int | None = None, stride: int = 1):
        self.size, self.stride = size, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day int", "tmin double, tmax double, tavg double")
        # days since 1970; open: settled rows not worked out yet, and the last known ones before (day and values);
        # tail: last days that were worked out (day and features)
        self.past = handle.getValueState("past", "first int, last int, place long, open array<double>, tail array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for day, *values in frame[["day", *VALUES]].itertuples(index=False):
                if day * DAY_MS > settled:
                    self.waiting.updateValue((int(day),), tuple(None if pd.isna(v) else float(v) for v in values))
                    self.handle.registerTimer(int(day) * DAY_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        settled = timerValues.getCurrentWatermarkInMs()
        due = sorted((day, values) for (day,), values in self.waiting.iterator() if day * DAY_MS <= settled)
        for day, _ in due:
            self.waiting.removeKey((day,))
        if due and (out := self._worked_out(due)) is not None:
            out.insert(0, "city", key[0])
            yield out

    def _worked_out(self, due: list[tuple[int, tuple]]) -> pd.DataFrame | None:
        first, last, place, kept, tail = self.past.get() if self.past.exists() else (due[0][0], due[0][0] - 1, 0, [], [])
        known = np.concatenate([_rows(kept, 4), np.array([(day, *(np.nan if v is None else v for v in values)) for day, values in due])])
        at = [known[~np.isnan(known[:, c]), 0] for c in (1, 2, 3)]
        ready = int(min((days[-1] if len(days) else last for days in at), default=last))
        tail, new = _rows(tail, 1 + len(FEATURES)), np.arange(last + 1, ready + 1)
        out = None
        if len(new):
            tail = np.concatenate([tail, self._features(first, new, [np.interp(new, days, known[~np.isnan(known[:, c]), c]) for c, days in zip((1, 2, 3), at, strict=True)], tail)])
            full = np.arange(last + 1, ready + 1) >= first + BEHIND
            out, place = self._emitted(tail, int(full.sum()), place)
            tail = tail[-max(BEHIND, (self.size or 1) - 1) :]
            # of the rows behind, a column's last known value is all that later days look back to
            back = [before[-1] for days in at if len(before := days[days <= ready])]
            known = known[(known[:, 0] > ready) | np.isin(known[:, 0], back)]
            last = ready
        self.past.update((int(first), int(last), int(place), known.ravel().tolist(), tail.ravel().tolist()))
        return out

    def _features(self, first: int, days: np.ndarray, values: list[np.ndarray], tail: np.ndarray) -> np.ndarray:
        low, high, mean = values
        behind = tail[-BEHIND:, 3]
        series = np.r_[np.full(BEHIND - len(behind), np.nan), behind, mean]
        spans = np.lib.stride_tricks.sliding_window_view(series, 7)[1:]
        angle = 2 * np.pi * np.array([(EPOCH + dt.timedelta(days=int(d))).timetuple().tm_yday for d in days]) / YEAR_DAYS
        return np.column_stack([
            days, low, high, mean, high - low, mean - series[BEHIND - 1 : -1], mean - series[: len(days)], spans.mean(1), spans.std(1, ddof=1),
            np.sin(angle), np.cos(angle), (days - first) / YEAR_DAYS,
        ])

    def _emitted(self, rows: np.ndarray, new: int, place: int) -> tuple[pd.DataFrame | None, int]:
        """The last ``new`` of ``rows``, or the windows that they make whole; ``place`` rows were full before them."""
        after = place + new
        if self.size is None:
            picked, windows = rows[len(rows) - new :], {}
        else:
            ids = [w for w in range(max(0, -(-(place + 1 - self.size) // self.stride)), (after - self.size) // self.stride + 1)]
            offset = np.arange(self.size)
            at = np.array([len(rows) - after + w * self.stride + offset for w in ids], dtype=int).reshape(-1)
            picked, windows = rows[at], {"window_id": np.repeat(ids, self.size).astype("int32"), "context_idx": np.tile(offset, len(ids)).astype("int32")}
        if not len(picked):
            return None, after
        dates = [EPOCH + dt.timedelta(days=int(d)) for d in picked[:, 0]]
        return pd.DataFrame({**windows, "date": dates, **{c: picked[:, k + 1] for k, c in enumerate(FEATURES)}}), after

    def close(self) -> None:
        pass


def daily_stream(rows: DataFrame, late: str = "2 days", size: int | None = None, stride: int = 1) -> DataFrame:
    """(city, date, features) of a stream of (city, date, tmin, tmax, tavg); with ``size`` its whole hopping windows, with window_id and context_idx.

    Works with the state store that keeps state on disk (``STATE_STORE``), which is set for the session where another one is.
    """
    if size is not None and (size < 1 or stride < 1):
        raise ValueError("window and stride must be positive")
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    values = {c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double")) for c in VALUES}
    day = F.unix_date(F.col("date").try_cast("date"))
    stamped = rows.select("city", day.alias("day"), *(v.alias(c) for c, v in values.items())).na.drop(subset=["city", "day"])
    stamped = stamped.withColumn("__ts", F.timestamp_seconds(F.col("day").cast("long") * 86400)).withWatermark("__ts", late)
    windows = "" if size is None else "window_id int, context_idx int, "
    schema = f"city string, {windows}date date, " + ", ".join(f"{c} double" for c in FEATURES)
    return stamped.groupBy("city").transformWithStateInPandas(DailyState(size, stride), schema, "Append", "EventTime")
