"""Order statistics against numpy, with hot values and hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalgrid.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    g = np.where(rng.random(4000) < 0.6, "hot", rng.choice(["a", "b"], 4000))
    v = np.where(rng.random(4000) < 0.35, 7.0, np.round(rng.normal(0, 50, 4000), 1))
    pdf = pd.DataFrame({"g": g, "v": v})
    return pdf, spark.createDataFrame(pdf)


def test_exact_quantiles(skewed):
    pdf, df = skewed
    probs = {"q1": 0.25, "m": 0.5, "p99": 0.99}
    for r in O.exact_quantiles(df, ["g"], "v", probs).collect():
        x = pdf.loc[pdf.g == r.g, "v"]
        assert r.n_values == len(x)
        for n, p in probs.items():
            assert r[n] == pytest.approx(np.quantile(x, p))


def test_quantiles_of_the_whole_table(skewed):
    pdf, df = skewed
    assert O.exact_quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(pdf.v.median())


def test_average_ranks(skewed):
    pdf, df = skewed
    want = pdf.assign(r=pdf.groupby("g").v.rank()).drop_duplicates(["g", "v"]).set_index(["g", "v"]).r
    got = O.average_ranks(df, ["g"], "v").toPandas().set_index(["g", "v"])["rank"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_running_totals(skewed):
    pdf, df = skewed
    once = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = O.running_totals(once, ["g"], "v", ["n"]).toPandas().sort_values(["g", "v"])
    want = got.groupby("g").n.cumsum() - got.n
    assert (got.n_before == want).all()
    assert (got.n_total == got.groupby("g").n.transform("sum")).all()


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), F.lit("x").alias("p")).repartition(7)
    got = O.assign_row_id(df, ["k"], "row_id").orderBy("k").collect()
    assert [r.row_id for r in got] == list(range(5000))


@pytest.mark.parametrize("in_one_task", [O.IN_ONE_TASK, 3])
def test_column_quantiles_against_numpy(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(O, "IN_ONE_TASK", in_one_task)
    monkeypatch.setattr(O, "ACCURACY", 40)  # wide brackets that still hold only a part of the values
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({
        "a": rng.normal(0, 1, 3000), "b": np.where(rng.random(3000) < 0.4, 5.0, rng.integers(0, 1000, 3000) / 7),
        "c": np.where(rng.random(3000) < 0.3, np.nan, rng.exponential(1, 3000)), "d": np.full(3000, np.nan), "e": np.full(3000, 2.0)})
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("b") != 5.0, F.col("b")).otherwise(F.when(F.rand(1) < 0.9, 5.0))).repartition(5)
    pdf = df.toPandas()
    probs = {"lowest": 0.0, "p01": 0.01, "q1": 0.25, "m": 0.5, "p95": 0.95, "p999": 0.999, "highest": 1.0}
    got = {r.column_name: r for r in O.column_quantiles(spark.createDataFrame(pdf), list("abcde"), probs).collect()}
    for c in "abce":
        x = pdf[c].dropna()
        assert got[c].n_values == len(x) and got[c].min_value == x.min() and got[c].max_value == x.max()
        for name, p in probs.items():
            assert got[c][name] == pytest.approx(np.quantile(x, p), rel=1e-12)
    assert tuple(got["d"])[1:] == (None, None, 0, *[None] * 7)
    assert O.column_quantiles(spark.createDataFrame(pdf).limit(0), ["a"], probs).first().n_values == 0
