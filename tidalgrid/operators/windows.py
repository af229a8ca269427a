"""Features along a series: one zone and bucket ordered by date.

The panel has one row per series and day, so a series window never holds more rows than the study
has days.  That bound, and not the volume of raw rows, is what makes these windows safe at scale.
Features of one call share one window specification and therefore one shuffle and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import log_ratio
from ..session import reliable_checkpoint
from .panel import checked_broadcast

SERIES = ("zone_id", "temporal_bucket")


def lagged(metric: str, w, k: int = 1) -> Column:
    return F.lag(metric, k).over(w)


def rolling_mean(metric: str, w, rows: int = 7, min_rows: int = 1) -> Column:
    """Mean over the last ``rows`` rows including the current one (rows, not calendar days)."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(metric).over(frame) >= min_rows, F.avg(metric).over(frame))


def rolling_std(metric: str, w, rows: int = 7, min_rows: int = 2) -> Column:
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(metric).over(frame) >= min_rows, F.stddev_samp(metric).over(frame))


def history_features(
    df: DataFrame,
    metrics: Sequence[str],
    series: Sequence[str] = SERIES,
    order: str = "date",
    lags: Sequence[int] = (1,),
    window: int = 7,
    mean_min: int = 1,
    std_min: int = 2,
) -> DataFrame:
    """Lags, rolling mean and deviation, absolute and relative change of each metric."""
    w = W.partitionBy(*series).orderBy(order)
    out: dict[str, Column] = {}
    for m in metrics:
        for k in lags:
            out[f"{m}_lag_{k}"] = lagged(m, w, k)
        out[f"{m}_rolling_mean_{window}"] = rolling_mean(m, w, window, mean_min)
        out[f"{m}_rolling_std_{window}"] = rolling_std(m, w, window, std_min)
        previous = lagged(m, w)
        out[f"{m}_abs_change"] = F.col(m) - previous
        out[f"{m}_pct_change"] = F.try_divide(F.col(m) - previous, previous.cast("double"))
    return df.select("*", *[c.alias(n) for n, c in out.items()])


#: Nats of decay in one stretch of an exponential mean: sums inside a stretch stay far from overflow, and what lies
#: two stretches back weighs less than exp(-200) of the whole.
STRETCH = 200.0


def ema(
    df: DataFrame, metrics: Sequence[str], alpha: float | None = None, span: int | None = None,
    series: Sequence[str] = SERIES, order: str = "date",
) -> DataFrame:
    """Recursive exponential mean ``y = (1-a) y + a x``; a NULL or NaN keeps decaying the old weight, over any gap.

    Each value is a step ``y = p y + q`` whose factor depends only on the gap before it.  Running sums of
    -ln p cut a series into stretches of bounded decay; inside one the mean is a running sum of q scaled
    by the decay since its first value, and a stretch starts from the mean its predecessor ends with.
    So every row costs a fixed number of running sums, with no array and no bound on gaps.
    """
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    w = W.partitionBy(*series).orderBy(order)
    number = lambda m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
    if a >= 1:
        return df.withColumns({f"{m}_ema": F.last(number(m), ignorenulls=True).over(w) for m in metrics})
    keep = math.log1p(-a)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    added: list[str] = []

    def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        added.extend(c for c in columns if c not in added)
        return df.withColumns(columns)

    names = {m: {k: f"_{m}_{k}" for k in ("x", "gap", "fall", "q", "sum", "part", "since", "lead", "own", "prior")} for m in metrics}
    out = put(df, {"_at": F.row_number().over(w)} | {n["x"]: number(m) for m, n in names.items()})
    out = put(out, {n["gap"]: F.col("_at") - F.last(F.when(F.col(n["x"]).isNotNull(), F.col("_at")), ignorenulls=True).over(before) for n in names.values()})
    for n in names.values():
        old = F.exp(F.col(n["gap"]) * keep)
        step = F.col(n["x"]).isNotNull() & F.col(n["gap"]).isNotNull()
        out = put(out, {
            n["fall"]: F.when(step, F.log(old + a) - F.col(n["gap"]) * keep).otherwise(0.0),
            n["q"]: F.when(step, F.col(n["x"]) * a / (old + a)).otherwise(F.col(n["x"]))})
    out = put(out, {n["sum"]: F.sum(n["fall"]).over(w) for n in names.values()})
    out = put(out, {n["part"]: F.floor(F.col(n["sum"]) / STRETCH) for n in names.values()})
    for n in names.values():
        inside = W.partitionBy(*series, n["part"]).orderBy(order)
        out = put(out, {n["since"]: F.col(n["sum"]) - F.first(n["sum"]).over(inside), n["lead"]: F.first(n["fall"]).over(inside)})
        out = put(out, {n["own"]: F.exp(-F.col(n["since"])) * F.sum(F.col(n["q"]) * F.exp(n["since"])).over(inside)})
    out = put(out, {n["prior"]: F.lag(n["own"]).over(w) for n in names.values()})
    for m, n in names.items():
        inside = W.partitionBy(*series, n["part"]).orderBy(order)
        carried = F.exp(-F.col(n["since"]) - F.col(n["lead"])) * F.first(n["prior"]).over(inside)
        out = out.withColumn(f"{m}_ema", F.when(F.col(n["part"]) == 0, F.col(n["own"])).otherwise(F.col(n["own"]) + F.coalesce(carried, F.lit(0.0))))
    return out.drop(*added)


def period_profile(
    df: DataFrame, metrics: Sequence[str], series: Sequence[str] = SERIES, period: str = "period",
    pre: str = "pre_cp", post: str = "post_cp",
) -> DataFrame:
    """Per-series mean before and after the cutoff on every row, their difference and relative one."""
    w = W.partitionBy(*series)
    out = df
    first, second = {}, {}
    for m in metrics:
        first[f"{m}_pre_mean"] = F.avg(F.when(F.col(period) == pre, F.col(m))).over(w)
        first[f"{m}_post_mean"] = F.avg(F.when(F.col(period) == post, F.col(m))).over(w)
        second |= period_delta(m)
    return out.withColumns(first).withColumns(second)


def period_delta(metric: str) -> dict[str, Column]:
    a, b = F.col(f"{metric}_pre_mean"), F.col(f"{metric}_post_mean")
    return {f"{metric}_delta": b - a, f"{metric}_pct_delta": F.try_divide(b - a, a)}


def sparse_observed_lag(
    df: DataFrame, metric: str, series: Sequence[str] = SERIES, order: str = "date"
) -> DataFrame:
    """Previous observed value, change, relative change and days since, on observed rows only.

    ``last(ignore nulls)`` finds the previous observation in the same pass; nothing is joined back.
    """
    w = W.partitionBy(*series).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    seen = F.col(metric).isNotNull()
    previous = F.last(F.when(seen, F.struct(F.col(metric).alias("v"), F.col(order).alias("d"))), ignorenulls=True).over(w)
    out = df.withColumn("_p", F.when(seen, previous))
    change = F.col(metric) - F.col("_p.v")
    return out.withColumns(
        {
            f"{metric}_previous": F.col("_p.v"),
            f"{metric}_change": change,
            f"{metric}_pct_change": F.try_divide(change, F.col("_p.v").cast("double")),
            f"{metric}_days_since": F.datediff(F.col(order), F.col("_p.d")),
        }
    ).drop("_p")


def global_zscores(df: DataFrame, metrics: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / sample deviation over the table; moments come in as one scalar subquery each."""
    moments = df.agg(F.struct(*[F.struct(F.avg(m).alias("m"), F.stddev_samp(m).alias("s")).alias(m) for m in metrics]))
    s = moments.scalar()
    out = df.withColumn("_m", s)
    out = out.withColumns({f"{m}{suffix}": F.try_divide(F.col(m) - F.col(f"_m.{m}.m"), F.col(f"_m.{m}.s")) for m in metrics})
    return out.drop("_m")


def interaction_features(
    df: DataFrame,
    products: Mapping[str, tuple[str, str]] | None = None,
    ratios: Mapping[str, tuple[str, str]] | None = None,
    differences: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Products, log ratios and differences of columns, all in one projection."""
    out = {n: F.col(a) * F.col(b) for n, (a, b) in (products or {}).items()}
    out |= {n: log_ratio(F.col(a), F.col(b)) for n, (a, b) in (ratios or {}).items()}
    out |= {n: F.col(a) - F.col(b) for n, (a, b) in (differences or {}).items()}
    return df.withColumns(out)


BASELINE_KEY = ("zone_id", "temporal_bucket", "period")


def group_baseline(df: DataFrame, metrics: Sequence[str], key: Sequence[str] = BASELINE_KEY, min_rows: int = 10) -> DataFrame:
    """Size, moments, median and readiness per baseline group and metric (long)."""
    long = df.select(*key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(key), list(metrics), "metric", "value")
    out = long.groupBy(*key, "metric").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean_value"),
        F.stddev_samp("value").alias("std_value"),
        F.min("value").alias("min_value"),
        F.expr("percentile(value, 0.5)").alias("median_value"),
        F.max("value").alias("max_value"),
    )
    return out.withColumn("ready", F.col("n") >= min_rows)


def deviation_zscores(
    df: DataFrame, metrics: Sequence[str], key: Sequence[str] = BASELINE_KEY, min_rows: int = 10, eps: float = 1e-6
) -> DataFrame:
    """z-score against the row's baseline group and its absolute value; NULL unless the group is
    large enough and varies.

    Group moments are mergeable, so rows collapse to one row per group before anything is shuffled.
    That table is written once and, if its counted size allows, broadcast; the panel then needs
    neither a shuffle nor a sort.
    """
    moments = lambda m: F.struct(F.count(m).alias("n"), F.avg(m).alias("m"), F.stddev_samp(m).alias("s"))
    groups = reliable_checkpoint(df.groupBy(*key).agg(*[moments(m).alias(f"_b_{m}") for m in metrics]))
    z, a = {}, {}
    for m in metrics:
        b = f"_b_{m}"
        ready = (F.col(f"{b}.n") >= min_rows) & (F.col(f"{b}.s") > eps)
        z[f"{m}_deviation_z"] = F.when(ready, (F.col(m) - F.col(f"{b}.m")) / F.col(f"{b}.s"))
        a[f"{m}_deviation_abs_z"] = F.abs(F.col(f"{m}_deviation_z"))
    joined = df.join(checked_broadcast(groups), list(key), "left").select(*df.columns, *[f"_b_{m}" for m in metrics])
    return joined.withColumns(z).withColumns(a).drop(*[f"_b_{m}" for m in metrics])


def percentile_ranks(df: DataFrame, metrics: Sequence[str], key: Sequence[str] = BASELINE_KEY) -> DataFrame:
    """Average rank divided by the group's non-NULL count (ties share their mean rank).

    The mean of a tie's first rank and of the count up to its last row is its average rank, so each
    metric needs one sort of the group; all metrics share one shuffle.
    """
    whole = W.partitionBy(*key)
    out = {}
    for m in metrics:
        ordered = whole.orderBy(F.col(m).asc_nulls_last())
        mean_rank = (F.rank().over(ordered) + F.count(m).over(ordered)) / 2
        out[f"{m}_percentile_rank"] = F.when(F.col(m).isNotNull(), mean_rank / F.count(m).over(whole))
    return df.withColumns(out)


def monthly_residuals(
    df: DataFrame, metrics: Sequence[str], series: Sequence[str] = SERIES, month: str = "month", eps: float = 1e-6
) -> DataFrame:
    """Value minus the mean of the same series and calendar month, its size and its z-score."""
    by_month, by_series = W.partitionBy(*series, month), W.partitionBy(*series)
    first = {f"{m}_residual": F.col(m) - F.avg(m).over(by_month) for m in metrics}
    second = {}
    for m in metrics:
        r = f"{m}_residual"
        std = F.stddev_samp(r).over(by_series)
        second[f"{r}_abs"] = F.abs(r)
        second[f"{r}_zscore"] = F.when(std > eps, F.col(r) / std)
    return df.withColumns(first).withColumns(second)


def smoothed_daily(daily: DataFrame, metrics: Sequence[str], spans: Mapping[int, int], order: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Rolling means of a daily table as {rows: minimum rows}; one row per day and ``by`` group."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    return daily.withColumns({f"{m}_mean_{k}": rolling_mean(m, w, k, least) for m in metrics for k, least in spans.items()})


def top_decile_days(daily: DataFrame, metric: str, p: float = 0.9) -> DataFrame:
    """Days at or above the metric's ``p`` quantile; a daily table is small enough for it exactly."""
    cut = daily.agg(F.expr(f"percentile({metric}, {p})")).scalar()
    return daily.where(F.col(metric) >= cut)


def period_means(df: DataFrame, metrics: Sequence[str], period: str = "period") -> DataFrame:
    return df.groupBy(period).agg(F.count(F.lit(1)).alias("row_count"), *[F.avg(m).alias(f"{m}_mean") for m in metrics])


def event_study(windowed: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and median per relative day over event windows; rows are events x days, so few."""
    aggs = [F.count(F.lit(1)).alias("n_days")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.expr(f"percentile({m}, 0.5)").alias(f"{m}_median")]
    return windowed.groupBy("relative_day").agg(*aggs)


def cross_correlation(series: DataFrame, a: str, b: str, order: str, max_lag: int = 8) -> DataFrame:
    """Pearson correlation of ``a`` moved by each lag against ``b`` in a table of one row per period.

    Positive lags mean ``a`` leads.  Lags count rows, as both series are present on every row.
    """
    numbered = series.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order)))
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))
    moved = numbered.select(F.col(a).alias("_a"), "_i", lags.alias("lag")).withColumn("_i", F.col("_i") + F.col("lag"))
    pairs = moved.join(numbered.select("_i", F.col(b).alias("_b")), "_i")
    return pairs.groupBy("lag").agg(F.count(F.lit(1)).alias("n_periods"), F.corr("_a", "_b").alias("correlation"))


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group with their rank.

    With groups, the rank filter is pushed below the shuffle as a per-partition limit, so a hot
    group sends at most k rows per task; without groups it is a distributed top-k.
    """
    if by:
        w = W.partitionBy(*by).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
