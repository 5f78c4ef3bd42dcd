"""Forecasting: regression with seasonal ARMA errors and random forests.

A city's series with one candidate model is one group of ``applyInPandas``, and so are some trees of a city's forest;
candidates, trees and cities run side by side. A forest is a table with a row for each tree, to be written and read as any. The ARMA
models are fitted by exact likelihood (``state_space``); a candidate's folds start from the parameters of the fold before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import YEAR_DAYS, doy_angle, fourier
from .series import by_city, by_date, interpolated, regular, shifted_stats
from .state_space import SeasonalArma

ORDERS = [(1, 1, 1), (2, 1, 1), (1, 1, 2), (2, 1, 2), (1, 0, 1), (0, 1, 1)]
SEASONAL = [(1, 0, 1, 7), (1, 1, 1, 7), (0, 1, 1, 7), (1, 0, 0, 7)]
HORIZON, LEAST_DAYS, FOREST_LEAST_ROWS = 30, 1095, 900
FOREST_FEATURES = ["tavg_lag_1", "tavg_lag_2", "tavg_lag_7", "tavg_roll_mean_7", "tavg_roll_std_7", "doy_sin", "doy_cos"]


def exogenous(df: DataFrame, pairs: int = 3) -> DataFrame:
    """(city, date, sin1, cos1, ..., time_idx) of each row."""
    start = F.min("date").over(by_city())
    return df.select("city", "date", *(c.alias(k) for k, c in fourier(F.col("date"), pairs).items()), (F.datediff("date", start) / YEAR_DAYS).alias("time_idx"))


def folds(n: int, count: int = 3, horizon: int = HORIZON) -> list[tuple[int, int]]:
    """(start, end) of each validation part of an expanding split; fewer for short series."""
    count = 1 if n < 3 * horizon else min(count, 2) if n < 4 * horizon else count
    return [(n - (count - k) * horizon, n - (count - k - 1) * horizon) for k in range(count)]


def fold_table(df: DataFrame, count: int = 3, horizon: int = HORIZON) -> DataFrame:
    """(city, fold, n, val_start, val_end) from each series' length."""
    n = F.col("n")
    used = F.when(n < 3 * horizon, 1).when(n < 4 * horizon, F.least(F.lit(count), F.lit(2))).otherwise(count)
    sized = df.groupBy("city").agg(F.count("*").alias("n")).withColumn("used", used).withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("used") - 1)))
    end = n - (F.col("used") - F.col("fold") - 1) * horizon
    return sized.select("city", "fold", "n", (end - horizon).alias("val_start"), end.alias("val_end"))


def candidates() -> list[tuple[int, tuple, tuple]]:
    return [(k, o, s) for k, (o, s) in enumerate((o, s) for o in ORDERS for s in SEASONAL)]


def candidate_grid(df: DataFrame) -> DataFrame:
    """Each city with each candidate: (city, candidate, p, d, q, sp, sd, sq)."""
    grid = F.array(*(F.struct(F.lit(k).alias("candidate"), *(F.lit(v).alias(c) for c, v in zip(("p", "d", "q", "sp", "sd", "sq"), (*o, *s[:3]), strict=True))) for k, o, s in candidates()))
    return df.select("city").distinct().select("city", F.inline(grid))


def _matrix(days: np.ndarray, pairs: int = 3, origin: pd.Timestamp | None = None) -> np.ndarray:
    """Exogenous values of days counted from the series' first (of an array of dates), or from ``origin``."""
    date = pd.DatetimeIndex(days)
    angle = 2 * np.pi * date.dayofyear.to_numpy() / YEAR_DAYS
    idx = (date - (date[0] if origin is None else pd.Timestamp(origin))).days.to_numpy() / YEAR_DAYS
    return np.column_stack([f(k * angle) for k in range(1, pairs + 1) for f in (np.sin, np.cos)] + [idx])


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Over tasks of a number of its own, as small groups of much work would be put together in few tasks otherwise."""
    return df.repartition(32 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def cross_validated(df: DataFrame, only: list[int] | None = None, least: int = 0) -> DataFrame:
    """(city, candidate, mae) of cities with at least ``least`` days: mean over the folds; a candidate that fails in a fold has none."""
    known = [c for c in candidates() if only is None or c[0] in only]
    models = {k: (o, s) for k, o, s in known}
    tries = F.explode(F.array(*(F.lit(k) for k in models)))
    rows = interpolated(regular(df), ["tavg"]).select("city", "date", "tavg", F.count("*").over(by_city()).alias("n")).where(F.col("n") >= least)
    rows = rows.drop("n").withColumn("candidate", tries)

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        y, x, errors, near = frame["tavg"].to_numpy(float), _matrix(frame["date"].to_numpy()), [], None
        try:
            for start, end in folds(len(y)):
                fitted = SeasonalArma(*models[int(frame["candidate"].iat[0])]).fit(y[:start], x[:start], near)
                near = fitted.free
                errors.append(np.abs(fitted.forecast(x[start:end])[0] - y[start:end]).mean())
            mae = float(np.mean(errors)) if np.isfinite(errors).all() else None
        except (ArithmeticError, np.linalg.LinAlgError, ValueError, IndexError):
            mae = None
        return pd.DataFrame({"city": [frame["city"].iat[0]], "candidate": [frame["candidate"].iat[0]], "mae": [mae]})

    return _spread(rows, "city", "candidate").groupBy("city", "candidate").applyInPandas(score, "city string, candidate int, mae double")


#: A fitted model of a city as a row.
STATE = "city string, candidate int, cv_mae double, train_start date, train_end date, beta array<double>, phi array<double>, theta array<double>, sigma double, mean array<double>, cov array<double>, errors array<double>"


def train_sarimax(df: DataFrame, only: list[int] | None = None) -> DataFrame:
    """The state (``STATE``) of each city's best candidate, fitted to its whole series; cities with fewer than LEAST_DAYS days have none."""
    scores = cross_validated(df, only, LEAST_DAYS).where(F.col("mae").isNotNull())
    best = scores.groupBy("city").agg(F.min_by("candidate", F.struct("mae", "candidate")).alias("candidate"), F.min("mae").alias("cv_mae"))
    series = interpolated(regular(df), ["tavg"]).select("city", "date", "tavg", F.count("*").over(by_city()).alias("n")).where(F.col("n") >= LEAST_DAYS)
    models = {k: (o, s) for k, o, s in candidates()}

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        y, dates, k = frame["tavg"].to_numpy(float), frame["date"].to_numpy(), int(frame["candidate"].iat[0])
        state = SeasonalArma(*models[k]).fit(y, _matrix(dates)).state()
        return pd.DataFrame([{"city": frame["city"].iat[0], "candidate": k, "cv_mae": frame["cv_mae"].iat[0], "train_start": dates[0], "train_end": dates[-1], **state}])

    return series.join(best, "city").groupBy("city").applyInPandas(fit, STATE)


def sarimax_ahead(states: DataFrame, horizon: int = 7) -> DataFrame:
    """(city, date, tavg, lower_95, upper_95, candidate) of the days after each state's last one; nothing is fitted."""
    horizon = min(max(horizon, 1), 30)
    models = {k: (o, s) for k, o, s in candidates()}

    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                future = pd.date_range(pd.Timestamp(row["train_end"]) + pd.Timedelta(days=1), periods=horizon)
                x = _matrix(future, origin=pd.Timestamp(row["train_start"]))
                mean, error = SeasonalArma(*models[row["candidate"]]).restored(row).forecast(x)
                yield pd.DataFrame({"city": row["city"], "date": future.date, "tavg": mean, "lower_95": mean - 1.959964 * error, "upper_95": mean + 1.959964 * error, "candidate": row["candidate"]})

    return states.mapInPandas(ahead, "city string, date date, tavg double, lower_95 double, upper_95 double, candidate int")


def sarimax_forecast(df: DataFrame, horizon: int = 7, only: list[int] | None = None) -> DataFrame:
    """The forecast of each city's best candidate, trained on the spot."""
    return sarimax_ahead(train_sarimax(df, only), horizon)


def forest_features(df: DataFrame) -> DataFrame:
    """Lags, statistics of the days before and the season of each day, with the next day's value as y; incomplete rows go."""
    out = shifted_stats(df.select("city", "date", "tavg")).withColumns({"doy_sin": F.sin(doy_angle(F.col("date"))), "doy_cos": F.cos(doy_angle(F.col("date"))), "y": F.lead("tavg", 1).over(by_date())})
    return out.select("city", "date", *FOREST_FEATURES, "y").na.drop("any")


def chronological(df: DataFrame, days: int = 365) -> DataFrame:
    """With ``part``: test are a city's last days, val as many before, train the rest."""
    last = F.max("date").over(Window.partitionBy("city"))
    part = F.when(F.col("date") >= F.date_sub(last, days), "test").when(F.col("date") >= F.date_sub(last, 2 * days), "val").otherwise("train")
    return df.withColumn("part", part)


def errors(df: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    gap = F.col(guess) - F.col(truth)
    return df.groupBy(*by).agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count("*").alias("n"))


def _tree(x: np.ndarray, y: np.ndarray, depth: int | None, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
    """Feature (-1: leaf), threshold, left child (the right one is next) and mean of each node of a tree on rows drawn with repetition.

    All nodes of a level are split at once, each where its squared errors fall most, until its rows are alike.
    """
    pick = draw.integers(len(y), size=len(y))
    x, centre = x[pick], y[pick].mean()
    y = y[pick] - centre
    orders, node = np.argsort(x, axis=0, kind="stable").T, np.zeros(len(y), dtype=int)
    feature, threshold, child, mean = [np.array([-1])], [np.zeros(1)], [np.array([0])], [np.zeros(1)]
    first, size, level = 0, 1, 0
    while size and (depth is None or level < depth):
        own = node >= first
        spread = np.full(size, -np.inf)
        np.maximum.at(spread, node[own] - first, y[own])
        low = np.full(size, np.inf)
        np.minimum.at(low, node[own] - first, y[own])
        best, split_at, split_by = np.full(size, -np.inf), np.zeros(size), np.full(size, -1)
        for j, order in enumerate(orders):
            order = order[own[order]]
            order = order[np.argsort(node[order], kind="stable")]
            at, v, total = node[order] - first, x[order, j], np.cumsum(y[order])
            begins = np.searchsorted(at, np.arange(size))
            ends = np.r_[begins[1:], len(at)] - 1
            before = np.r_[0.0, total][begins]
            left, n_left = total - before[at], np.arange(1, len(at) + 1) - begins[at]
            right, n_right = total[ends][at] - total, ends[at] - np.arange(len(at))
            gain = np.full(len(at), -np.inf)
            may = np.flatnonzero((n_right > 0) & (v < np.r_[v[1:], v[-1:]]))
            gain[may] = left[may] ** 2 / n_left[may] + right[may] ** 2 / n_right[may]
            top = np.maximum.reduceat(gain, begins)
            where = np.flatnonzero((gain == top[at]) & np.isfinite(gain))
            nodes, k = np.unique(at[where], return_index=True)
            better = top[nodes] > best[nodes]
            nodes, k = nodes[better], where[k[better]]
            best[nodes], split_by[nodes], split_at[nodes] = top[nodes], j, (v[k] + v[k + 1]) / 2
        split_by[spread <= low] = -1
        cut = np.flatnonzero(split_by >= 0)
        feature[-1], threshold[-1] = split_by, split_at
        child[-1][cut] = first + size + 2 * np.arange(len(cut))
        rows = np.flatnonzero(own)
        at = node[rows] - first
        rows, at = rows[split_by[at] >= 0], at[split_by[at] >= 0]
        node[np.flatnonzero(own)] = -1
        node[rows] = child[-1][at] + (x[rows, split_by[at]] > split_at[at])
        first, size, level = first + size, 2 * len(cut), level + 1
        if size:
            at = node[rows] - first
            feature.append(np.full(size, -1)), threshold.append(np.zeros(size)), child.append(np.zeros(size, dtype=int))
            mean.append(np.bincount(at, y[rows], size) / np.bincount(at, minlength=size))
    return np.concatenate(feature), np.concatenate(threshold), np.concatenate(child), np.concatenate(mean) + centre


def train_forests(df: DataFrame, trees: int = 600, depth: int | None = None, least: int = FOREST_LEAST_ROWS) -> DataFrame:
    """(city, tree, feature, threshold, child, mean): a row for each tree of the forests of cities with at least ``least`` rows of all features.

    Trees see a city's training part, with the feature day's own value as target (features lie before it).
    """
    rows = chronological(forest_features(df).join(df.select("city", "date", "tavg"), ["city", "date"])).withColumn("n", F.count("*").over(by_city()))
    rows = rows.where((F.col("n") >= least) & (F.col("part") == "train")).select("city", "date", "tavg", *FOREST_FEATURES)
    dealt = 25

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        x, y = frame[FOREST_FEATURES].to_numpy(float), frame["tavg"].to_numpy(float)
        own = range(key[1] * dealt, min((key[1] + 1) * dealt, trees))
        grown = [(key[0], t, *_tree(x, y, depth, np.random.default_rng((42, t)))) for t in own]
        return pd.DataFrame(grown, columns=["city", "tree", "feature", "threshold", "child", "mean"])

    parts = F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // dealt)))
    return _spread(rows.withColumn("part", parts), "city", "part").groupBy("city", "part").applyInPandas(grow, "city string, tree int, feature array<int>, threshold array<double>, child array<int>, mean array<double>")


def forest_scores(df: DataFrame, forests: DataFrame) -> DataFrame:
    """(city, part, mae, rmse, n) of a forest on the validation and test parts of its city, each some 365 days."""
    rows = chronological(forest_features(df).join(df.select("city", "date", "tavg"), ["city", "date"])).where(F.col("part") != "train")
    rows = rows.select("city", "part", "tavg", *FOREST_FEATURES)

    def guess(days: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if days.empty or trees.empty:
            return pd.DataFrame(columns=["city", "part", "tavg", "guess"])
        x, total = days[FOREST_FEATURES].to_numpy(float), np.zeros(len(days))
        for tree in trees.itertuples():
            feature, threshold, child, mean = (np.asarray(v) for v in (tree.feature, tree.threshold, tree.child, tree.mean))
            node = np.zeros(len(x), dtype=int)
            while (inner := feature[node] >= 0).any():
                node = np.where(inner, child[node] + (x[np.arange(len(x)), feature[node]] > threshold[node]), node)
            total += mean[node]
        return days[["city", "part", "tavg"]].assign(guess=total / len(trees))

    guessed = rows.groupBy("city").cogroup(forests.groupBy("city")).applyInPandas(guess, "city string, part string, tavg double, guess double")
    return errors(guessed, "tavg", "guess", ["city", "part"])


def forest_forecast(df: DataFrame, forests: DataFrame, horizon: int = 7) -> DataFrame:
    """(city, date, tavg) for the days after the last; each value feeds the lags of the next. Cities without a forest or with fewer than 15 rows have none."""
    place = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("date")))
    tail = df.select("city", "date", "tavg", place.alias("place")).where("place <= 15")
    steps = min(max(horizon, 1), 30)

    def ahead(days: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        days, out = days.sort_values("date"), []
        if len(days) < 15 or trees.empty:
            return days.iloc[:0][["city", "date", "tavg"]]
        feature, threshold, child, mean = (np.concatenate(trees[c].to_numpy()) for c in ("feature", "threshold", "child", "mean"))
        root = np.r_[0, np.cumsum([len(f) for f in trees["feature"]])[:-1]]
        values, day = days["tavg"].tolist(), pd.Timestamp(days["date"].iat[-1])
        for _ in range(steps):
            day = day + pd.Timedelta(days=1)
            angle = 2 * np.pi * day.dayofyear / YEAR_DAYS
            row = np.array([values[-1], values[-2], values[-7], np.mean(values[-7:]), np.std(values[-7:], ddof=1), np.sin(angle), np.cos(angle)])
            node = root
            while (inner := feature[node] >= 0).any():
                down = root + child[node] + (row[feature[node]] > threshold[node])
                node = np.where(inner, down, node)
            values.append(float(mean[node].mean()))
            out.append((days["city"].iat[0], day.date(), values[-1]))
        return pd.DataFrame(out, columns=["city", "date", "tavg"])

    return tail.groupBy("city").cogroup(forests.groupBy("city")).applyInPandas(ahead, "city string, date date, tavg double")
