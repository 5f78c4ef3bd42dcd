"""Clusters of years, and of months within them, over standardised monthly values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONTHLY = ["tavg_mean", "tavg_std", "diurnal_mean", "roll_std_mean", "anomaly_mean", "delta_1_mean"]


def grid(months: DataFrame) -> DataFrame:
    """Every month of every year of a city; months that it lacks are null."""
    years = months.groupBy("city").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    seen = months.select("city", "year").distinct()
    cells = years.select("city", F.explode(F.sequence("a", "b")).alias("year")).join(seen, ["city", "year"], "left_semi").select("city", "year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return cells.join(months, ["city", "year", "month"], "left")


def standardised(months: DataFrame) -> DataFrame:
    """The grid with missing cells at a city's mean, and scaled by population deviation (1 where that is 0)."""
    w = Window.partitionBy("city")
    full = grid(months)
    full = full.withColumns({c: F.coalesce(c, F.avg(c).over(w), F.lit(0.0)) for c in MONTHLY})
    sd = lambda c: F.stddev_pop(c).over(w)
    return full.withColumns({c: (F.col(c) - F.avg(c).over(w)) / F.when(sd(c) == 0, 1.0).otherwise(sd(c)) for c in MONTHLY})


def _lloyd(points: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, float]:
    """Labels and cost of k-means from one start, whose centers are drawn far from each other; ends when labels stay."""
    draw = np.random.default_rng(seed)
    far = lambda centers: ((points[:, None] - centers) ** 2).sum(axis=2)
    centers = points[[draw.integers(len(points))]]
    while len(centers) < k and (near := far(centers).min(axis=1)).sum() > 0:
        centers = np.vstack([centers, points[draw.choice(len(points), p=near / near.sum())]])
    labels = far(centers).argmin(axis=1)
    while True:
        centers = np.array([points[labels == c].mean(axis=0) if (labels == c).any() else centers[c] for c in range(len(centers))])
        gaps = far(centers)
        if (gaps.argmin(axis=1) == labels).all():
            return labels, float(gaps.min(axis=1).sum())
        labels = gaps.argmin(axis=1)


def _clustered(points: np.ndarray, k: int, starts: int) -> list[np.ndarray]:
    """The members of each cluster by the best of several starts, in order of their smallest member."""
    labels = min((_lloyd(points, k, seed) for seed in range(starts)), key=lambda found: found[1])[0]
    return sorted((np.flatnonzero(labels == c) for c in np.unique(labels)), key=lambda members: members[0])


def clusters(months: DataFrame, k_years: int = 3, k_months: int = 3, starts: int = 10) -> DataFrame:
    """(city, year_cluster, month_cluster, years, months, high, low) of every city; ``high`` and ``low`` are the five features farthest from 0 of a cluster's mean.

    A city is one group: twelve months of six values for each of its years. Cities are clustered side by side.
    """
    columns = ["city", "year_cluster", "month_cluster", "years", "months", "high", "low"]

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame, out = frame.sort_values(["year", "month"]), []
        years = frame["year"].unique()
        cube = frame[MONTHLY].to_numpy(float).reshape(len(years), 12, len(MONTHLY))
        for y, own in enumerate(_clustered(cube.reshape(len(years), -1), k_years, starts)):
            means = cube[own].mean(axis=0)
            for m, part in enumerate(_clustered(means, min(k_months, 12), starts)):
                center = means[part].mean(axis=0)
                top = sorted(zip(np.abs(center), MONTHLY, center, strict=True), reverse=True)[:5]
                out.append((frame["city"].iat[0], y, m, years[own].tolist(), (part + 1).tolist(), [f for _, f, z in top if z >= 0], [f for _, f, z in top if z < 0]))
        return pd.DataFrame(out, columns=columns)

    kinds = "city string, year_cluster int, month_cluster int, years array<int>, months array<int>, high array<string>, low array<string>"
    return standardised(months).groupBy("city").applyInPandas(cluster, kinds)
