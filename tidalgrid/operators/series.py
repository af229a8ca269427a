"""Decomposition of long series, one small task per series.

A series has one row per day, so its length is bounded by the study and not by the data volume; the
number of series is what grows, and Spark spreads them by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _odd_above(x: float) -> int:
    n = int(np.floor(x)) + 1
    return n if n % 2 else n + 1


@lru_cache(maxsize=64)
def _neighborhoods(n: int, first: int, count: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, tricube weights and positions for reading ``count`` fits from ``first`` on."""
    at = np.arange(first, first + count, dtype=float)
    q = min(span, n)
    left = np.clip(np.round(at - (q - 1) / 2).astype(int), 0, n - q)
    idx = left[:, None] + np.arange(q)[None, :]
    dist = np.abs(idx - at[:, None])
    reach = np.maximum(at - left, left + q - 1 - at) + max(span - n, 0) // 2
    r = dist / np.where(reach > 0, reach, 1.0)[:, None]
    tricube = np.where(r <= 0.001, 1.0, (1 - np.minimum(r, 1.0) ** 3) ** 3)
    return idx, np.where(r <= 0.999, tricube, 0.0), at


def local_line(y: np.ndarray, first: int, count: int, span: int, weights: np.ndarray) -> np.ndarray:
    """Locally weighted straight lines through the last axis of ``y`` (``span`` nearest points each)."""
    n = y.shape[-1]
    idx, base, at = _neighborhoods(n, first, count, span)
    w = base * weights[..., idx]
    total = w.sum(-1, keepdims=True)
    w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
    center = (w * idx).sum(-1, keepdims=True)
    off = idx - center
    var = (w * off * off).sum(-1, keepdims=True)
    tilt = np.divide(at[:, None] - center, var, out=np.zeros_like(var), where=np.sqrt(var) > 0.001 * max(n - 1, 1))
    fit = (w * (1 + tilt * off) * y[..., idx]).sum(-1)
    flat = y[..., np.clip(at, 0, n - 1).astype(int)]
    return np.where(total[..., 0] > 0, fit, flat)


def _moving(x: np.ndarray, k: int) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(x)])
    return (c[k:] - c[:-k]) / k


def seasonal_trend_split(y: np.ndarray, period: int, seasonal_span: int = 7, robust: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend parts after Cleveland, Cleveland, McRae and Terpenning (1990).

    Robust fitting runs two inner rounds inside fifteen reweightings by the bisquare of the residuals.
    All sub-series of one length are smoothed in one array operation.
    """
    n = len(y)
    trend_span = _odd_above(np.ceil(1.5 * period / (1 - 1.5 / seasonal_span)) - 1)
    low_span = _odd_above(period)
    inner, outer = (2, 15) if robust else (5, 0)
    trend, seasonal, rho, ones = np.zeros(n), np.zeros(n), np.ones(n), np.ones(n)
    starts = np.arange(period)
    lengths = (n - starts + period - 1) // period
    batches = [(starts[lengths == m], int(m)) for m in np.unique(lengths)]
    for round_no in range(outer + 1):
        for _ in range(inner):
            free = y - trend
            cycle = np.empty(n + 2 * period)
            for group, m in batches:
                spots = group[:, None] + period * np.arange(m)[None, :]
                out = group[:, None] + period * np.arange(m + 2)[None, :]
                cycle[out] = local_line(free[spots], -1, m + 2, seasonal_span, rho[spots])
            smooth = _moving(_moving(_moving(cycle, period), period), 3)
            seasonal = cycle[period : period + n] - local_line(smooth, 0, n, low_span, ones)
            trend = local_line(y - seasonal, 0, n, trend_span, rho)
        if round_no < outer:
            r = np.abs(y - seasonal - trend)
            scale = 6 * np.median(r)
            if scale <= 0:
                break
            u = np.clip(r / scale, 0, 1)
            rho = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u * u) ** 2, 0.0))
    return seasonal, trend


def seasonal_trend(
    df: DataFrame, series: Sequence[str], order: str, metric: str, period: Column | int, min_rows: int = 10, eps: float = 1e-6
) -> DataFrame:
    """Seasonal part, residual, its size and z-score per series; NULL for series that are too short.

    Missing values are interpolated for the fit; the trend is not kept.
    """
    per = F.lit(period) if isinstance(period, int) else period
    keys = list(series)
    base = df.select(*keys, order, F.col(metric).cast("double").alias("_y"), per.cast("int").alias("_p"))
    out_cols = [f"{metric}_seasonal", f"{metric}_residual", f"{metric}_residual_abs", f"{metric}_residual_zscore"]

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        out = pdf[[*keys, order]].copy()
        for c in out_cols:
            out[c] = np.nan
        p = int(pdf["_p"].iloc[0])
        y = pdf["_y"].astype(float)
        if y.notna().sum() < max(min_rows, 2 * p):
            return out
        y = y.interpolate(limit_direction="both").to_numpy()
        seasonal, trend = seasonal_trend_split(y, p)
        res = y - seasonal - trend
        sd = res.std(ddof=1)
        out[out_cols[0]], out[out_cols[1]], out[out_cols[2]] = seasonal, res, np.abs(res)
        if sd > eps:
            out[out_cols[3]] = res / sd
        return out

    kinds = dict(base.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in [*keys, order]] + [f"{c} double" for c in out_cols])
    return base.groupBy(*keys).applyInPandas(split, schema)


def tune_period(df: DataFrame, series: Sequence[str], bucket: str, order: str, metric: str, candidates: Sequence[int], min_rows: int = 20) -> DataFrame:
    """Mean variance explained per bucket and candidate period, best first.

    Each series and candidate is a task of its own.
    """
    keys = list(series)
    base = df.where(F.col(metric).isNotNull()).select(*keys, F.col(bucket).alias("_b"), order, F.col(metric).cast("double").alias("_y"))
    fan = base.withColumn("candidate_period", F.explode(F.array(*[F.lit(c) for c in candidates])))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)["_y"].to_numpy(dtype=float)
        p = int(pdf["candidate_period"].iloc[0])
        var = y.var(ddof=1) if len(y) > 1 else 0.0
        if len(y) < max(min_rows, 2 * p) or not var > 0:
            return pd.DataFrame({"bucket": pd.Series(dtype=str), "candidate_period": pd.Series(dtype="int32"), "explained": pd.Series(dtype=float)})
        seasonal, trend = seasonal_trend_split(y, p)
        return pd.DataFrame({"bucket": [str(pdf["_b"].iloc[0])], "candidate_period": [p], "explained": [1 - (y - seasonal - trend).var(ddof=1) / var]})

    each = fan.groupBy(*keys, "candidate_period").applyInPandas(fit, "bucket string, candidate_period int, explained double")
    out = each.groupBy("bucket", "candidate_period").agg(
        F.count(F.lit(1)).alias("series_count"), F.avg("explained").alias("mean_explained"), F.expr("percentile(explained, 0.5)").alias("median_explained")
    )
    # Buckets x candidates rows.
    w = W.partitionBy("bucket").orderBy(F.desc("mean_explained"), "candidate_period")
    return out.withColumn("period_rank", F.row_number().over(w))


def strongest_waves(y: np.ndarray, count: int) -> np.ndarray:
    """The series rebuilt from its mean and its ``count`` largest frequencies."""
    mean = y.mean()
    f = np.fft.rfft(y - mean)
    size = np.abs(f)
    size[0] = -1.0
    keep = np.argsort(size, kind="stable")[-count:]
    kept = np.zeros_like(f)
    kept[keep[keep > 0]] = f[keep[keep > 0]]
    kept[0] = f[0]
    return np.fft.irfft(kept, n=len(y)) + mean


def fourier_reconstruction(df: DataFrame, series: Sequence[str], order: str, metric: str, count: int = 20, min_rows: int = 60) -> DataFrame:
    """``<metric>_fourier_top<count>`` on rows with a value; NULL where a series is short or flat."""
    keys, name = list(series), f"{metric}_fourier_top{count}"
    base = df.select(*keys, order, F.col(metric).cast("double").alias("_y"))

    def rebuild(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        out = pdf[[*keys, order]].copy()
        out[name] = np.nan
        ok = pdf["_y"].notna().to_numpy()
        y = pdf.loc[ok, "_y"].to_numpy(dtype=float)
        if len(y) >= min_rows and y.std(ddof=1) > 0:
            out.loc[ok, name] = strongest_waves(y, count)
        return out

    kinds = dict(base.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in [*keys, order]] + [f"{name} double"])
    return base.groupBy(*keys).applyInPandas(rebuild, schema)


def dominant_periods(df: DataFrame, series: Sequence[str], order: str, metric: str, top: int = 5) -> DataFrame:
    """The frequencies with the most power per series, their period and its name."""
    keys = list(series)
    base = df.where(F.col(metric).isNotNull()).select(*keys, order, F.col(metric).cast("double").alias("_y"))

    def power(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)["_y"].to_numpy(dtype=float)
        p = np.abs(np.fft.rfft(y - y.mean())) ** 2
        freq = np.fft.rfftfreq(len(y), d=1)
        p, freq = p[1:], freq[1:]
        best = np.argsort(-p, kind="stable")[:top]
        out = pd.DataFrame({"rank": np.arange(1, len(best) + 1), "frequency": freq[best], "power_share": p[best] / p.sum() if p.sum() > 0 else np.nan})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    kinds = dict(base.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys]) + ", rank int, frequency double, power_share double"
    out = base.groupBy(*keys).applyInPandas(power, schema).withColumn("period_rows", 1 / F.col("frequency"))
    return out.withColumn("period_label", period_label(F.col("period_rows")))


def period_label(rows: Column) -> Column:
    return (
        F.when(rows.between(18, 24), "roughly monthly")
        .when(rows.between(55, 75), "roughly quarterly")
        .when(rows.between(220, 290), "roughly annual")
        .otherwise("exploratory cycle")
    )


def assemble_features(base: DataFrame, long: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long (key, feature, value) rows set beside their base rows: one shuffle for all features."""
    wide = long.groupBy(*key).agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features])
    return base.join(wide, list(key), "left")
