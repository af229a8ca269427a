"""Staging, merging, writing, text and statistics on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalgrid.functions import calendar as C
from tidalgrid.functions import labels as L
from tidalgrid.functions import text as X
from tidalgrid.operators import discourse as D
from tidalgrid.operators import panel as P
from tidalgrid.operators import quality as Q
from tidalgrid.operators import resampling as Rs
from tidalgrid.operators import statistics as S
from tidalgrid.sources import merge as M
from tidalgrid.sources import staging as St


def test_csv_pages(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ts,n,name\n01/31/2024 01:05:00 PM,\"5\",x\nbad,oops,y\n")
    (tmp_path / "b.csv").write_text("name,ts\nz,12/01/2024 12:00:00 AM\n")
    df = St.stage_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "ts timestamp_ntz, n int, name string, extra double", {"ts": "MM/dd/yyyy hh:mm:ss a"})
    got = {r.name: r for r in df.collect()}
    assert got["x"].ts == dt.datetime(2024, 1, 31, 13, 5) and got["x"].n == 5
    assert got["y"].ts is None and got["y"].n is None
    assert got["z"].ts == dt.datetime(2024, 12, 1) and got["z"].n is None and got["z"].extra is None


def test_jsonl_drops_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x", "more": [1]}\nnot json\n{"id": 2}\n')
    got = St.stage_jsonl(spark, [str(tmp_path / "a.jsonl")], "id bigint, t string").orderBy("id").collect()
    assert [(r.id, r.t) for r in got] == [(1, "x"), (2, None)]


def test_write_and_names(spark, tmp_path):
    df = spark.createDataFrame([("2024-01", 1), ("2024-02", 2), ("2024-02", 3)], "month string, n int")
    M.write_table(df, str(tmp_path / "t"), ["month"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.where("month = '2024-02'").agg(F.sum("n")).first()[0] == 5
    M.write_table(df.select("n"), str(tmp_path / "green_2024-03.parquet"))
    named = St.derive_from_filename(spark.read.parquet(str(tmp_path / "green_2024-03.parquet")), {"ext": r"\.([a-z]+)$"})
    assert {r.ext for r in named.collect()} == {"parquet"}


def test_first_wins(spark):
    df = spark.createDataFrame([(1, "tool", 5), (1, "api", 9), (2, "tool", 1), (1, "api", 7)], "id int, source string, v int")
    got = M.dedup_first_wins(df, ["id"], ["source", "v"]).orderBy("id").collect()
    assert [(r.id, r.source, r.v) for r in got] == [(1, "api", 7), (2, "tool", 1)]
    rep = M.merge_report(df, spark.createDataFrame([(2,), (3,), (3,)], "id int"), ["id"]).first()
    # Copies inside the base lower the net count below zero, as in before-and-after arithmetic.
    assert (rep.existing_rows, rep.net_new_rows, rep.dropped_copies) == (4, -1, 4)


def test_labels_from_messy_text(spark):
    cases = {
        '{"about_topic": 1, "stance": "PRO", "confidence": 0.7, "refers_to_parent": "yes"}': ("", True, "pro", 0.7, True),
        '[{"about_topic": "0", "stance": "NA"}]': ("", False, "NA", 0.0, False),
        'Sure! {"about_topic": true, "stance": "maybe", "confidence": 3} ok': ("", True, "NA", 1.0, False),
        "": ("empty", None, None, None, None),
        "[]": ("empty", None, None, None, None),
        "nothing here": ("malformed", None, None, None, None),
        "{broken": ("malformed", None, None, None, None),
        '{"stance": "pro"}': ("missing_fields", None, None, None, None),
        '"text"': ("malformed", None, None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in X.parse_labels(df, "t").collect():
        assert (r.fail_reason, r.about_topic, r.stance, r.confidence, r.refers_to_parent) == cases[r.t], r.t


def test_no_signal_text(spark):
    df = spark.createDataFrame([("[removed]",), (" https://a.b/c ",), ("?!…",), ("ok",), ("да",), (None,)], "t string")
    assert [r[0] for r in df.select(X.no_signal_reason(F.col("t"))).collect()] == ["removed", "url_only", "symbols_only", None, None, "removed"]


def test_published_nets(spark):
    df = spark.createDataFrame([("Congestion pricing works",), ("the $9 toll",), ("gridlock again",), ("nice dog",)], "t string")
    strict, broad = X.lexical_nets(F.col("t"))
    assert [tuple(r) for r in df.select(strict, broad).collect()] == [(True, True), (True, True), (False, True), (False, False)]


def test_local_time_over_daylight_saving(spark):
    at = [dt.datetime(2024, 3, 10, 6, 59), dt.datetime(2024, 3, 10, 7, 1), dt.datetime(2024, 11, 3, 6, 30)]
    secs = [int((t - dt.datetime(1970, 1, 1)).total_seconds()) for t in at]
    df = spark.createDataFrame([(s,) for s in secs], "s bigint")
    got = [r[0] for r in df.select(C.epoch_to_local(F.col("s"))).collect()]
    assert got == [dt.datetime(2024, 3, 10, 1, 59), dt.datetime(2024, 3, 10, 3, 1), dt.datetime(2024, 11, 3, 1, 30)]


def test_validated_join_fails_on_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    good, bad = spark.createDataFrame([(1, 5)], "k int, b int"), spark.createDataFrame([(1, 5), (1, 6)], "k int, b int")
    assert P.validated_join(a, good, ["k"]).count() == 2
    with pytest.raises(Exception, match="repeat"):
        P.validated_join(a, bad, ["k"]).collect()


def test_day_gaps(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 20, 30)]
    df = spark.createDataFrame([("s", d) for d in days for _ in range(6)], "k string, day date")
    r = Q.missing_day_gaps(df, ["k"], "day", "2024-01-01", "2024-01-31").first()
    assert (r.days_missing, r.max_gap, r.gap_start, r.gap_end, r.median_per_day, r.suspicious) == (27, 17, dt.date(2024, 1, 3), dt.date(2024, 1, 19), 6.0, True)


def test_broadcast_only_below_the_limit(spark):
    dim = spark.range(50).withColumnRenamed("id", "k")
    assert "broadcast" in P.checked_broadcast(dim, 100)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in P.checked_broadcast(dim, 10)._jdf.queryExecution().logical().toString().lower()


TOY = [
    # kind, first topic and stance, second topic and stance, truth
    (1, "anti", 1, "anti", "anti"), (1, "pro", 1, "pro", "pro"), (1, "anti", 1, "anti", "anti"), (1, "pro", 1, "anti", "anti"),
    (1, "mixed", 1, "pro", "pro"), (1, "pro", 1, "neutral", "neutral"), (1, "neutral", 0, "NA", "NA"), (0, "NA", 1, "neutral", "neutral"),
    (1, "anti", 0, "NA", "NA"), (1, "pro", 0, "NA", "NA"), (1, "anti", 1, "anti", "anti"), (1, "neutral", 1, "neutral", "neutral"),
]


def test_toy_cells_and_verdict(spark):
    df = spark.createDataFrame(TOY, "ta int, sa string, tb int, sb string, truth string")
    df = df.withColumn("cell", D.disagreement_cell(F.col("ta") == 1, F.col("sa"), F.col("tb") == 1, F.col("sb")))
    n = {r.cell: r["count"] for r in df.groupBy("cell").count().collect()}
    assert n == {"A_agree": 5, "D_flip": 1, "D_stance": 2, "D_topic": 4}
    on = F.col("truth") != "NA"
    right = lambda t, s: F.when(F.col("cell") == "D_topic", (F.col(t) == 1) == on).otherwise(F.col(s) == F.col("truth"))
    got = {r.cell: (r.first_right, r.second_right) for r in S.head_to_head(df, "cell", {"first": right("ta", "sa"), "second": right("tb", "sb")}).collect()}
    assert got["D_topic"] == (0.0, 1.0) and got["A_agree"] == (1.0, 1.0) and got["D_flip"] == (0.0, 1.0)


def test_kappa_of_two_raters(spark):
    a = ["anti", "pro", "anti", "anti", "pro", "neutral"]
    b = ["anti", "pro", "anti", "neutral", "pro", "neutral"]
    df = spark.createDataFrame([(i, r, x) for r, xs in (("a", a), ("b", b)) for i, x in enumerate(xs)], "item int, rater string, label string")
    got = S.cohen_pairwise(S.rating_table(df, "item", "rater", "label", ["a", "b"]), ["a", "b"]).first()
    po, pe = 5 / 6, sum((a.count(c) / 6) * (b.count(c) / 6) for c in set(a))
    assert got.raw_agreement == pytest.approx(po) and got.cohen_kappa == pytest.approx((po - pe) / (1 - pe))


def test_interrupted_series_matches_least_squares(spark):
    rng = np.random.default_rng(6)
    t = np.arange(40)
    post = (t >= 25) * 1.0
    y = 1 + 0.05 * t - 2 * post + 0.1 * (t - 25) * post + rng.normal(0, 0.1, 40)
    w = rng.integers(5, 50, 40).astype(float)
    x = np.column_stack([np.ones(40), t, post, (t - 25) * post])
    beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(t, y, w)], "t int, y double, w double")
    got = {r.term: r.coefficient for r in S.interrupted_series(df, F.col("t"), "y", "w", 25).collect()}
    assert [got[k] for k in ("const", "t", "post", "since")] == pytest.approx(beta, abs=1e-6)


@pytest.mark.parametrize("dof", [1, 2, 3, 7, 36, 41])
def test_student_tail_by_integration(dof):
    from math import gamma, pi, sqrt

    x = np.linspace(0, 1.7, 200_001)
    density = gamma((dof + 1) / 2) / (sqrt(dof * pi) * gamma(dof / 2)) * (1 + x * x / dof) ** (-(dof + 1) / 2)
    inside = ((density[1:] + density[:-1]) / 2 * np.diff(x)).sum()
    assert S.student_two_sided(-1.7, dof) == pytest.approx(1 - 2 * inside, abs=1e-9)


def test_bootstrap_centres_on_the_estimate(spark):
    rng = np.random.default_rng(8)
    y = rng.choice(["a", "b"], 400)
    p = np.where(rng.random(400) < 0.8, y, "a")
    df = spark.createDataFrame([(str(a), str(b)) for a, b in zip(y, p)], "t string, p string")
    point = S.class_metrics(S.confusion(df, "t", "p"), "t", "p", ["a", "b"]).agg(F.avg("f1")).first()[0]
    got = S.bootstrap_interval(Rs.bootstrap_f1(df, "t", ["p"], ["a", "b"], replicates=300)).first()
    assert got.low < point < got.high and got.mean_value == pytest.approx(point, abs=0.01)
    same = S.paired_difference(Rs.bootstrap_f1(df.withColumn("q", F.col("p")), "t", ["p", "q"], ["a", "b"], replicates=50), "p", "q").first()
    assert same.mean_value == 0 and not same.is_significant


def test_normal_cdf(spark):
    from statistics import NormalDist

    xs = [-3.1, -1.0, 0.0, 0.5, 1.96, 4.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(L.normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([NormalDist().cdf(x) for x in xs], abs=1e-7)


def test_a_failed_replacement_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    M.write_table(spark.range(10), path)
    bad = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="half-way"):
        M.write_table(bad, path)
    assert spark.read.parquet(path).count() == 10 and [x.name for x in tmp_path.iterdir()] == ["t"]
    M.write_table(spark.range(20), path)
    assert spark.read.parquet(path).count() == 20 and [x.name for x in tmp_path.iterdir()] == ["t"]
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert M.restore_table(spark, path) and not M.restore_table(spark, path) and spark.read.parquet(path).count() == 20


def test_mixed_json_lines_keep_their_rows(spark, tmp_path):
    lines = ['{"id":"a","edited":false,"score":1}', '{"id":"b","edited":1672608506,"score":2}', '{"id":"c","edited":1672608506.0,"score":3}', '{"id":"d","score":"4"}', '{broken']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    got = sorted(tuple(r) for r in St.stage_jsonl(spark, [str(tmp_path)], "id string, edited bigint, score bigint").collect())
    assert got == [("a", None, 1), ("b", 1672608506, 2), ("c", 1672608506, 3), ("d", None, 4)]
    assert tuple(St.broken_json_lines(spark, [str(tmp_path)]).first()) == (5, 1)


def test_csv_pages_with_other_column_orders(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "2.csv").write_text("b,a\ny,2\n")
    (tmp_path / "3.csv").write_text("")
    got = sorted(tuple(r) for r in St.stage_csv(spark, [str(tmp_path)], "a bigint, b string").collect())
    assert got == [(1, "x"), (2, "y")]


def test_draws_are_poisson_and_do_not_depend_on_partitions(spark):
    import numpy as np

    k = Rs.draws(np.arange(-500, 4000), 300)
    share = [(k == j).mean() for j in range(4)]
    assert np.allclose(share, [0.36788, 0.36788, 0.18394, 0.06131], atol=0.002) and abs(k.var() - 1) < 0.01
    assert abs(np.corrcoef(k[:, :20].T) - np.eye(20)).max() < 0.08 and abs(np.corrcoef(k[:30]) - np.eye(30)).max() < 0.3
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    sums = lambda d: {r.replicate: r.s for r in Rs.replicate_sums(d, F.col("id"), {"s": F.col("v"), "none": F.lit(None)}, 40).collect()}
    want = Rs.draws(np.arange(500), 40).T @ (np.arange(500) % 7)
    assert sums(df) == sums(df.repartition(9)) == {r + 1: x for r, x in enumerate(want.tolist())}


def test_undefined_replicates_are_dropped(spark):
    df = spark.createDataFrame([(i, "a", "a") for i in range(30)] + [(99, "b", "a")], "id long, t string, p string")
    n = Rs.bootstrap_f1(df, "t", ["p"], ["a", "b"], replicates=200, key="id").count()
    assert 80 < n < 180  # the one row of class b is missing from a good third
    same = spark.createDataFrame([(i, "x", "x") for i in range(10)], "id long, one string, two string")
    assert Rs.bootstrap_kappa(same, "id", ["one", "two"], ["x", "y"], replicates=20).collect() == []
