"""Series features against hand-made vectors."""

import datetime as dt

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidalgrid.operators import windows as Wn

DAY = dt.date(2024, 1, 1)


def series(spark, data):
    """{(zone, bucket): values} to a frame of consecutive days."""
    out = [(z, b, DAY + dt.timedelta(i), v) for (z, b), vs in data.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(out, "zone_id int, temporal_bucket string, date date, x double")


def values(df, col, *keys):
    got = {}
    for r in df.orderBy("zone_id", "temporal_bucket", "date").collect():
        got.setdefault((r.zone_id, r.temporal_bucket), []).append(r[col])
    return got


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None and w is None) or g == pytest.approx(w, abs=1e-6)


def series_window():
    return W.partitionBy("zone_id", "temporal_bucket").orderBy("date")


def test_lag(spark):
    df = series(spark, {(1, "am"): [10.0, 20.0, 30.0], (1, "pm"): [100.0], (2, "am"): [5.0, 15.0, 25.0]})
    got = values(df.withColumn("l", Wn.lagged("x", series_window())), "l")
    assert got == {(1, "am"): [None, 10, 20], (1, "pm"): [None], (2, "am"): [None, 5, 15]}


def test_rolling(spark):
    df = series(spark, {(1, "am"): [10.0, 20.0, 30.0, 40.0], (2, "am"): [5.0, 15.0, 25.0]})
    out = df.withColumns({"m": Wn.rolling_mean("x", series_window(), 3, 1), "s": Wn.rolling_std("x", series_window(), 3, 2)})
    m, s = values(out, "m"), values(out, "s")
    close(m[(1, "am")], [10, 15, 20, 30])
    close(m[(2, "am")], [5, 10, 15])
    close(s[(1, "am")], [None, 7.0710678, 10, 10])
    close(s[(2, "am")], [None, 7.0710678, 10])


def test_ema(spark):
    df = series(spark, {(1, "am"): [10.0, 20.0, 30.0, 40.0], (2, "am"): [5.0, 15.0, 25.0]})
    got = values(Wn.ema(df, ["x"], span=3), "x_ema")
    close(got[(1, "am")], [10, 15, 22.5, 31.25])
    close(got[(2, "am")], [5, 10, 17.5])


def test_ema_matches_pandas_over_gaps(spark):
    import pandas as pd

    xs = [None, 4.0, None, None, 9.0, 1.0, None, 7.0]
    df = series(spark, {(1, "am"): xs})
    want = pd.Series(xs, dtype=float).ewm(alpha=0.3, adjust=False).mean()
    close(values(Wn.ema(df, ["x"], alpha=0.3), "x_ema")[(1, "am")], [None if pd.isna(v) else v for v in want])


@pytest.mark.parametrize("alpha", [0.01, 0.3, 0.9, 0.999, 1.0])
def test_ema_over_gaps_of_any_length(spark, alpha):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(8)
    xs = rng.normal(100, 40, 3000)
    for first, past in ((0, 3), (40, 41), (60, 260), (300, 1500), (2000, 2002)):
        xs[first:past] = np.nan
    other = np.where(rng.random(3000) < 0.7, np.nan, rng.normal(0, 1, 3000))
    df = spark.createDataFrame([(1, "am", i, float(x), float(z)) for i, (x, z) in enumerate(zip(xs, other, strict=True))], "zone_id int, temporal_bucket string, date int, x double, z double")
    got = Wn.ema(df.repartition(3), ["x", "z"], alpha=alpha).orderBy("date").toPandas()
    for name, x in (("x", xs), ("z", other)):
        want = pd.Series(x).ewm(alpha=alpha, adjust=False).mean()
        assert np.allclose(got[f"{name}_ema"].astype(float), want, rtol=1e-11, atol=1e-11, equal_nan=True)
    assert got.columns.tolist() == ["zone_id", "temporal_bucket", "date", "x", "z", "x_ema", "z_ema"]


def test_changes(spark):
    df = series(spark, {(1, "am"): [10.0, 20.0, 15.0], (1, "pm"): [100.0], (2, "am"): [5.0, 15.0, 10.0], (3, "am"): [0.0, 2.0]})
    out = Wn.history_features(df, ["x"])
    a, p = values(out, "x_abs_change"), values(out, "x_pct_change")
    assert a[(1, "am")] == [None, 10, -5] and a[(1, "pm")] == [None] and a[(2, "am")] == [None, 10, -5]
    close(p[(1, "am")], [None, 1, -0.25])
    close(p[(2, "am")], [None, 2, -1 / 3])
    assert p[(3, "am")] == [None, None]


def test_period_profile(spark):
    data = [(1, "am", DAY + dt.timedelta(i), p, v) for i, (p, v) in enumerate([("pre_cp", 10.0), ("pre_cp", 20.0), ("post_cp", 30.0), ("post_cp", 40.0)])]
    data += [(2, "am", DAY, "pre_cp", 5.0), (2, "am", DAY + dt.timedelta(1), "post_cp", 15.0)]
    df = spark.createDataFrame(data, "zone_id int, temporal_bucket string, date date, period string, x double")
    out = Wn.period_profile(df, ["x"])
    assert values(out, "x_pre_mean") == {(1, "am"): [15] * 4, (2, "am"): [5] * 2}
    assert values(out, "x_post_mean") == {(1, "am"): [35] * 4, (2, "am"): [15] * 2}


def test_period_delta(spark):
    df = spark.createDataFrame([(0, 10.0, 15.0), (1, 20.0, 10.0), (2, 0.0, 5.0), (3, None, 20.0)], "i int, x_pre_mean double, x_post_mean double")
    got = df.withColumns(Wn.period_delta("x")).orderBy("i").collect()
    assert [r.x_delta for r in got] == [5, -10, 5, None]
    assert [r.x_pct_delta for r in got] == [0.5, -0.5, None, None]


def test_sparse_lag_skips_gaps(spark):
    df = series(spark, {(1, "am"): [3.0, None, None, 6.0, 0.0, 2.0]})
    out = Wn.sparse_observed_lag(df, "x")
    assert values(out, "x_previous")[(1, "am")] == [None, None, None, 3, 6, 0]
    assert values(out, "x_days_since")[(1, "am")] == [None, None, None, 3, 1, 1]
    assert values(out, "x_pct_change")[(1, "am")] == [None, None, None, 1.0, -1.0, None]


def test_percentile_rank_shares_ties(spark):
    df = series(spark, {(1, "am"): [5.0, 1.0, 5.0, None, 9.0]}).withColumn("period", F.lit("pre_cp"))
    got = values(Wn.percentile_ranks(df, ["x"]), "x_percentile_rank")[(1, "am")]
    close(got, [2.5 / 4, 0.25, 2.5 / 4, None, 1.0])


def test_cross_correlation_finds_the_lead(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=60)
    df = spark.createDataFrame([(i, float(x[i]), float(x[i - 2]) if i >= 2 else 0.0) for i in range(60)], "t int, a double, b double")
    best = Wn.cross_correlation(df, "a", "b", "t").orderBy(F.desc("correlation")).first()
    assert best.lag == 2
