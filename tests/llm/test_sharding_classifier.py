"""Sharding laws and held-out accuracy of the classifier."""

import zlib
from collections import defaultdict

import numpy as np

from tidalgrid.llm.quality_classifier import STATISTICS, Discriminant, fit, quality_scores, statistics
from tidalgrid.llm.queries.op05_quality_classifier import op5_quality_classifier
from tidalgrid.llm.queries.op09_sharding import op9_sharding
from tidalgrid.llm.sharding import pack, shard_documents


def check_law(got, texts, shards=8):
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    return [sum(r["size"] for r in by[s]) for s in range(shards)]


def test_whole_table(spark, small_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = op9_sharding(spark, small_dir).collect()
    loads = check_law(got, docs)
    assert max(loads) - min(loads) <= 0.05 * sum(loads) / 8
    where = {}
    for r in got:  # no group is heavy here but by its one large text
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 3


def test_hot_group_is_cut_and_odd_rows(spark):
    docs = [(i, "same words again") for i in range(3000)] + [(i, f"text {i} " * (i % 7 + 1)) for i in range(6000)] + [(None, None), (1, ""), (1, ""), (None, "x")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, bundle int, pieces int").repartition(5)
    loads = check_law(shard_documents(df).collect(), docs)
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 8
    assert shard_documents(df.limit(0)).collect() == []


def test_pack_prefers_residual_capacity():
    where = pack(np.array([[8, 1, 1], [1, 8, 1], [8, 1, 1], [1, 8, 1.0]]), 2, (1, 1, 1))
    assert where[0] != where[2] and where[1] != where[3]


def test_classifier_on_held_out_rows(spark, small_dir):
    folder = small_dir.replace("sf0.001", "sf0.01")
    want = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = op5_quality_classifier(spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
    for c in (0, 1):
        assert np.mean([p == c for p, q in held if q == c]) >= 0.9, c


def test_classifier_degenerate_inputs(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x " * 50000, "c")], "doc_id long, text string, x string")
    none = spark.createDataFrame([(1, None), (None, 1), (99, 0)], "doc_id long, quality int")
    assert [r.score for r in quality_scores(df, none).collect()] == [0.5] * 4
    one = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert [r.score for r in quality_scores(df, one).collect()] == [1.0] * 4
    assert quality_scores(df.limit(0), one).collect() == []
    assert statistics(None) == statistics(" \n") == [0.0] * len(STATISTICS)


def test_discriminant_equals_direct_densities():
    rng = np.random.default_rng(0)
    d = len(STATISTICS)
    a, b = rng.normal(size=(300, d)), rng.normal(1, 2, size=(500, d))
    m = {c: (len(x), x.sum(0), x.T @ x) for c, x in ((0, a), (1, b))}
    model = fit(m, 0.1)
    assert isinstance(model, Discriminant)
    x = rng.normal(size=(20, d))
    both = np.vstack([a, b])
    z = lambda v: (v - both.mean(0)) / both.std(0)
    logs = []
    for c, part in ((0, a), (1, b)):
        cov = 0.9 * np.cov(z(part).T, bias=True) + 0.1 * np.eye(d)
        u = z(x) - z(part).mean(0)
        logs.append(np.log(len(part) / 800) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", u, np.linalg.inv(cov), u))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


def test_repeated_rows_of_one_key_and_text_are_cut(spark):
    from tidalgrid.llm.sharding import shard_documents

    rows = [(None, "the same text of a hot group")] * 400 + [(i, f"text {i} stands once in here ok") for i in range(800)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=8).collect()
    load = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert len(got) == 1200 and max(load) < 1.2 * sum(load) / 8
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
