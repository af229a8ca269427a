"""Fitted models: invariants and small exact cases."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalgrid.operators import matrix as Mx
from tidalgrid.operators import outliers as Ou
from tidalgrid.operators import sampling as Sm
from tidalgrid.operators import screening as Sc
from tidalgrid.operators import series as Se


@pytest.fixture(scope="module")
def blob(spark):
    rng = np.random.default_rng(2)
    x = rng.multivariate_normal([0, 1, 2], [[2, 0.8, 0], [0.8, 1, 0], [0, 0, 0.3]], 600)
    x[:6] += 9
    pdf = pd.DataFrame({"id": np.arange(600), "v": list(x)})
    return x, spark.createDataFrame(pdf, "id bigint, v array<double>")


def test_forest_finds_planted_rows(blob):
    x, df = blob
    f = Ou.fit_forest(df, "id", "v", trees=60)
    scored = Ou.forest_scores(df, "v", f).toPandas()
    assert set(scored.nsmallest(6, "score").id) == set(range(6))
    assert scored.score.between(-1, 0).all()
    again = Ou.fit_forest(df.repartition(5), "id", "v", trees=60)
    assert np.array_equal(f.cut, again.cut)


def test_tail_flags_hit_the_share(blob):
    _, df = blob
    s = df.select("id", F.col("id").cast("double").alias("score"))
    got = Ou.tail_flags(s, "score", [0.01, 0.05], inclusive=True).groupBy("tail_share").agg(F.count_if("is_flagged").alias("n")).toPandas().set_index("tail_share").n
    assert got[0.01] == 6 and got[0.05] == 30


@pytest.mark.parametrize("kind", ["full", "diag"])
def test_one_component_mixture_is_the_sample_normal(blob, kind):
    x, df = blob
    m = Ou.fit_mixture(df, "id", "v", 1, kind, max_iter=5)
    assert m.means[0] == pytest.approx(x.mean(0))
    cov = np.cov(x.T, bias=True)
    assert m.covariances[0] == pytest.approx(cov if kind == "full" else np.diag(np.diag(cov)), abs=1e-4)
    scores = Ou.mixture_scores(df, "v", m).toPandas().score
    assert scores.sum() == pytest.approx(m.log_likelihood, rel=1e-6)


def test_components_match_numpy(spark, blob):
    x, df = blob
    w = df.select(*[F.col("v")[i].alias(f"x{i}") for i in range(3)])
    m = Mx.fit_components(w, ["x0", "x1", "x2"])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert m.shares == pytest.approx(values / values.sum())
    assert m.loadings.T @ m.loadings == pytest.approx(np.eye(3), abs=1e-9)
    s = np.array([r.scores for r in Mx.project(w, m, 2).select("scores").collect()])
    assert s.var(axis=0, ddof=1) == pytest.approx(values[:2])
    same = Mx.loading_stability(spark, m, m).collect()
    assert all(r.aligned_cosine == pytest.approx(1) and r.top_overlap == pytest.approx(0.3) for r in same)


def test_greedy_order_reads_blocks_of_one_matrix(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(500, 1))
    cols = {"b0": a[:, 0], "copy": a[:, 0] + rng.normal(0, 1e-3, 500), "noise": rng.normal(size=500)}
    df = spark.createDataFrame(pd.DataFrame(cols))
    got = Mx.greedy_family_order(spark, df, ["b0"], {"n": ["noise"], "c": ["copy"]}, head=1).orderBy("step").collect()
    assert [r.added_family for r in got] == ["base", "c", "n"]
    assert got[1].head_variance == pytest.approx(1, abs=1e-4)


def test_quotas():
    sizes = {("a",): 900, ("b",): 90, ("c",): 9, ("d",): 1}
    q = Sm.quotas(sizes, 100)
    assert sum(q.values()) == 100 and all(q[s] >= 1 for s in sizes)
    assert Sm.quotas(sizes, 5000) == sizes
    assert Sm.quotas(sizes, 100, floor=20)[("b",)] == 20


def test_stratified_sample_is_exact_and_repeatable(spark):
    df = spark.range(3000).withColumn("s", F.when(F.col("id") % 10 < 7, "hot").otherwise((F.col("id") % 3).cast("string")))
    a = Sm.stratified_sample(df, ["s"], 250, "id", "x")
    b = Sm.stratified_sample(df.repartition(9), ["s"], 250, "id", "x")
    ids = sorted(r.id for r in a.collect())
    assert len(ids) == 250 and ids == sorted(r.id for r in b.collect())


def test_spearman_matches_pandas_over_gaps(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": range(300), "a": rng.integers(0, 9, 300).astype(float), "b": rng.normal(size=300)})
    pdf["c"] = pdf.b.where(rng.random(300) < 0.7) + 0.1 * pdf.a
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).to_records(index=False).tolist(), "k int, a double, b double, c double")
    want = pdf[["a", "b", "c"]].rank().corr()
    got = {(r.feature_a, r.feature_b): r for r in Sc.spearman_pairs(df, ["k"], ["a", "b", "c"]).collect()}
    for (x, y), r in got.items():
        both = pdf[[x, y]].dropna().rank()
        assert r.correlation == pytest.approx(both[x].corr(both[y]))
        assert r.n_rows == len(both)
    assert len(got) == 3 and want is not None


def test_split_recovers_a_cycle_and_resists_a_spike():
    t = np.arange(400)
    y = 20 + 0.02 * t + 3 * np.sin(2 * np.pi * t / 10) + np.random.default_rng(0).normal(0, 0.05, 400)
    y[200] += 80
    seasonal, trend = Se.seasonal_trend_split(y, 10)
    clean = np.delete(np.arange(400), 200)
    assert np.abs(seasonal - 3 * np.sin(2 * np.pi * t / 10))[clean].max() < 0.3
    assert np.abs(trend - 20 - 0.02 * t)[clean].max() < 0.4
    assert (y - seasonal - trend)[200] > 70


def test_short_series_stay_null(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(12)] + [("b", i, float(i % 5)) for i in range(60)], "k string, t int, x double")
    got = Se.seasonal_trend(df, ["k"], "t", "x", 10).toPandas()
    assert got[got.k == "a"].x_residual.isna().all() and got[got.k == "b"].x_residual.notna().all()


def test_fourier(spark):
    t = np.arange(120)
    y = 5 + 2 * np.cos(2 * np.pi * t / 12) + np.sin(2 * np.pi * t / 30)
    assert Se.strongest_waves(y, 2) == pytest.approx(y, abs=1e-9)
    df = spark.createDataFrame([("a", int(i), float(v)) for i, v in zip(t, y)], "k string, t int, x double")
    top = Se.dominant_periods(df, ["k"], "t", "x", 2).orderBy("rank").collect()
    assert top[0].period_rows == pytest.approx(12) and top[1].period_rows == pytest.approx(30)


def test_mixtures_and_clusters_read_whole_vectors(spark, small_dir, tmp_path):
    from tidalgrid.plans import anomalies as An

    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 64)).astype(np.float32) * 0.02
    x[:, 60] += np.arange(240) // 2 % 2 * 6  # two lumps in each half, apart in the 61st dimension only
    x[3, 63] += 40
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = str(tmp_path)
    got = {r.half: (r.cluster_count, r.noise_share) for r in An.vector_clusters(spark, d).collect()}
    assert got == {0: (2, 0.0), 1: (2, round(1 / 120, 6))}
    far = {r.vec_id: r.centroid_distance for r in An.vector_centroid_distances(spark, d).collect()}
    assert len(far) == 240 and max(far, key=far.get) == 3 and far[3] > 39
    scores = {r.vec_id: r.score for r in An.mixture_scores(spark, d).select("vec_id", "score").distinct().collect()}
    m = Ou.fit_mixture(An.vectors(spark, d), "vec_id", "embedding", 2)
    want = m.log_density(x.astype(float))
    assert len(m.means[0]) == 64 and all(abs(scores[i] - want[i]) < 1e-6 * max(1, abs(want[i])) for i in range(240))


def test_samples_rank_only_what_passes_and_stay_exact(spark, monkeypatch):
    from tidalgrid.operators import sampling as Sa

    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "b").alias("s")).repartition(7)
    rows = sorted((hashlib.md5(f"{i}:x".encode()).hexdigest(), i, "hot" if i % 10 < 7 else "b" if i % 10 < 9 else None) for i in range(5000))
    for slack in (6.0, -6.0):  # the second cuts too low and has to widen
        monkeypatch.setattr(Sa, "cutoff", lambda n, size, k=6.0, of=Sa.cutoff, first=slack: of(n, size, first if k == 6.0 else k))
        got = {r.id for r in Sa.take_quotas(df, ["s"], {("hot",): 40, ("b",): 900, (None,): 2000}, "id", "x").collect()}
        want = {i for s, n in (("hot", 40), ("b", 900), (None, 2000)) for _, i, t in [r for r in rows if r[2] == s][:n]}
        assert got == want and len(got) == 40 + 900 + 500
        assert [r.id for r in Sa.hash_sample(df, 25, "id", "x").collect()] == [i for _, i, _ in rows[:25]]
        monkeypatch.undo()
    assert Sa.hash_sample(df, 9000, "id", "x").count() == 5000 and Sa.hash_sample(df.limit(0), 5, "id", "x").count() == 0
    assert Sa.cutoff(10, 10_000_000) < "0001" and Sa.cutoff(5, 5) == "g"
