"""Tiled neighbour operators against brute force, with copies and one hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalgrid.operators import neighbors as N

LAYOUT = {"pivots": 6, "block_rows": 50, "tile_rows": 16}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 0.3, (160, 3)), rng.normal(3, 0.3, (120, 3)), rng.uniform(-4, 7, (30, 3))])
    x = np.vstack([x, np.repeat(x[:1], 90, axis=0)])  # copies of one vector
    x = np.round(x, 4)
    g = np.where(rng.random(len(x)) < 0.8, 0, 1)
    pdf = pd.DataFrame({"id": np.arange(len(x)), "g": g, "v": list(x)})
    return pdf, spark.createDataFrame(pdf, "id bigint, g int, v array<double>")


def brute(pdf):
    for g, part in pdf.groupby("g"):
        x = np.array(part.v.tolist())
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        yield g, part, d


@pytest.mark.parametrize("merge", [True, False])
def test_noise(cloud, merge):
    pdf, df = cloud
    got = N.dbscan_noise(df, "g", "id", "v", 0.5, 6, merge_equal=merge, **LAYOUT).toPandas().set_index("id")
    for _, part, d in brute(pdf):
        count = (d <= 0.5).sum(1)
        core = count >= 6
        noise = ~((d <= 0.5) & core[None, :]).any(1)
        assert (got.loc[part.id, "neighbor_count"].to_numpy() == count).all()
        assert (got.loc[part.id, "is_core"].to_numpy() == core).all()
        assert (got.loc[part.id, "is_noise"].to_numpy() == noise).all()


def test_sweep(cloud):
    pdf, df = cloud
    got = N.dbscan_sweep(df, "g", "id", "v", [0.3, 0.6], [4, 8], **LAYOUT).toPandas().set_index(["eps", "min_samples"])
    for eps in (0.3, 0.6):
        for m in (4, 8):
            total = sum(int((~((d <= eps) & ((d <= eps).sum(1) >= m)[None, :]).any(1)).sum()) for _, _, d in brute(pdf))
            assert got.loc[(eps, m), "noise_rows"] == total and got.loc[(eps, m), "rows_evaluated"] == len(pdf)


def test_clusters(cloud):
    pdf, df = cloud
    got = N.dbscan_clusters(df, "g", "id", "v", 0.5, 6, **LAYOUT).toPandas().set_index("id").cluster
    for _, part, d in brute(pdf):
        near = d <= 0.5
        core = near.sum(1) >= 6
        label = np.arange(len(part))
        for _ in range(len(part)):
            new = np.where(core, np.min(np.where(near & core[None, :], label[None, :], len(part)), axis=1), label)
            if (new == label).all():
                break
            label = new
        mine = got.loc[part.id].to_numpy()
        assert (np.isnan(mine) == ~((near & core[None, :]).any(1))).all()
        c = np.nonzero(core)[0]
        assert len({(label[i], mine[i]) for i in c}) == len(set(label[c])) == len(set(mine[c]))


def test_kth_distances(cloud):
    pdf, df = cloud
    got = N.knn_profile(df, "g", "id", "v", [1, 5, 12], **LAYOUT).toPandas().set_index(["group_key", "neighbor_k"])
    for g, part, d in brute(pdf):
        s = np.sort(d, axis=1)
        for k in (1, 5, 12):
            r = got.loc[(str(g), k)]
            assert r.group_rows == len(part)
            assert r.mean_distance == pytest.approx(s[:, k].mean(), abs=1e-6)
            assert r.p95_distance == pytest.approx(np.quantile(s[:, k], 0.95), abs=1e-6)


def test_small_groups_are_left_out(spark):
    df = spark.createDataFrame([(i, 0 if i < 12 else 1, [float(i), 0.0]) for i in range(15)], "id bigint, g int, v array<double>")
    got = N.knn_profile(df, "g", "id", "v", [5], **LAYOUT).collect()
    assert [r.group_key for r in got] == ["0"]


def test_distance_profile(cloud):
    pdf, df = cloud
    got = N.distance_profile(df, "g", "id", "v", 4, **LAYOUT).toPandas().set_index("group_key")
    for g, part, d in brute(pdf):
        off = d[~np.eye(len(part), dtype=bool)]
        assert got.loc[str(g)].pair_distance_mean == pytest.approx(off.mean(), abs=1e-6)
        assert got.loc[str(g)].mean_knn_distance == pytest.approx(np.sort(d, axis=1)[:, 1:5].mean(), abs=1e-6)


def test_cluster_ids_beyond_what_a_double_holds(spark):
    base = 2**60 + 1
    xs = [0.0, 0.1, 0.2, 0.3, 0.7, 9.0]
    df = spark.createDataFrame([(base + i, "g", [x, 0.0]) for i, x in enumerate(xs)], "id bigint, g string, v array<double>")
    got = {r.id - base: None if r.cluster is None else r.cluster - base for r in N.dbscan_clusters(df, "g", "id", "v", 0.45, 4).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: None}


def test_a_vector_of_very_many_copies(spark):
    df = spark.range(3000).select(F.col("id"), F.lit("g").alias("g"), F.when(F.col("id") < 2990, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.col("id").cast("double"), F.lit(0.0))).alias("v"))
    r = N.knn_profile(df, "g", "id", "v", [3]).first()
    assert r.group_rows == 3000 and r.median_distance == 0.0 and r.p99_distance == 0.0


def test_labels_of_random_links():
    rng = np.random.default_rng(4)
    for n, links in ((1, 0), (50, 30), (400, 380), (400, 2000)):
        a, b = rng.integers(0, n, links), rng.integers(0, n, links)
        label = np.arange(n)
        for i in range(0, links, 37):
            N.merge_labels(label, a[i : i + 37], b[i : i + 37])
        want = np.arange(n)
        for _ in range(n):
            np.minimum.at(want, a, want[b])
            np.minimum.at(want, b, want[a])
        assert (label == want).all()


def test_a_group_without_name_and_clusters_over_many_blocks(spark):
    """A chain of 400 points, longer than any block, in the group NULL."""
    rows = [(i, None if i % 2 else "g", [i * 0.1, 0.0]) for i in range(800)] + [(900, "g", [500.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, g string, v array<double>").repartition(5)
    for merge in (True, False):
        got = {r.id: r.cluster for r in N.dbscan_clusters(df, "g", "id", "v", 0.21, 2, pivots=5, block_rows=40, tile_rows=16, merge_equal=merge).collect()}
        assert got == {i: i % 2 for i in range(800)} | {900: None}


def test_nearest_centroids_as_arrays_or_by_join(spark, monkeypatch):
    from tidalgrid.operators import outliers as Ou

    rng = np.random.default_rng(6)
    rows = [(i, "a" if i % 3 else "b", rng.normal(size=3).tolist(), None if i % 7 == 0 else int(i % 5)) for i in range(90)] + [(95, "none", [1.0, 1.0, 1.0], None), (96, "a", None, None)]
    df = spark.createDataFrame(rows, "id bigint, g string, v array<double>, c bigint")
    read = lambda: {r.id: tuple(r)[4:] for r in Ou.centroid_distance(df, "g", "id", "v", "c").collect()}
    first = read()
    monkeypatch.setattr(Ou, "SPOT_BYTES", 10)
    second = read()
    assert first.keys() == second.keys() and first[95] == second[95] == (None,) * 4
    for k in range(90):
        assert first[k][:2] == second[k][:2] and first[k][2:] == pytest.approx(second[k][2:], abs=1e-9)


def test_ranks_and_nearest_by_strips_equal_brute_force():
    """Tiles of more rows than a byte can count, copies of points and weights; no more than a strip of distances at once."""
    from tidalgrid.operators.blocks import Work

    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(5000, 4)), 2)
    x[100:140] = x[100]
    pid = rng.permutation(5000)
    d = np.sqrt(((x[:3000, None] - x[None, :3000]) ** 2).sum(2))
    d[np.arange(3000), np.arange(3000)] = np.inf
    for tile, weighted in ((4096, False), (512, False), (512, True)):
        w = rng.integers(1, 4, 5000) if weighted else np.ones(5000, np.int64)
        at = np.sort(d[:3000, rng.integers(0, 3000, 7)], axis=1)
        at[np.isinf(at)] = 1.0
        seen = []

        class Ranks(N._Ranks):
            def meet(self, rows, dist, *rest):
                seen.append(len(rows))
                super().meet(rows, dist, *rest)

        part = lambda s: (pid[s], x[s], w[s], at[s] if s.stop <= 3000 else np.zeros((s.stop - s.start, 7)))
        work = Work(Ranks(), part(slice(0, 3000)), tile)
        work.meet(part(slice(3000, 5000)))
        far = np.sqrt(((x[:3000, None] - x[None]) ** 2).sum(2))
        far[np.arange(3000), np.arange(3000)] = np.inf
        want = np.stack([((far < at[:, j, None] - 1e-9) * w).sum(1) for j in range(7)], axis=1)
        got = work.reducer.result()
        assert (np.stack(got["ranks"].to_numpy()) == want).all() and max(seen) <= Work.STRIP
        if not weighted:
            near = Work(N._Nearest(6), part(slice(0, 3000)), tile)
            near.meet(part(slice(3000, 5000)))
            found = near.reducer.result()
            order = np.lexsort((np.broadcast_to(pid, far.shape), np.round(far, 9)), axis=1)[:, :6]
            assert (np.stack(found["neighbors"].to_numpy()) == pid[order]).all()
            assert np.allclose(np.stack(found["distances"].to_numpy()), np.take_along_axis(far, order, axis=1), atol=1e-7)


def labels(x, eps, m, ids):
    """Smallest core id of each point's cluster, by brute force; None for noise."""
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= m
    label = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        new = np.where(core, np.min(np.where(near & core[None], label[None], np.iinfo(np.int64).max), axis=1), label)
        if (new == label).all():
            break
        label = new
    label = np.where(core, label, np.min(np.where(near & core[None], label[None], np.iinfo(np.int64).max), axis=1))
    return {i: None if c == np.iinfo(np.int64).max else c for i, c in zip(ids.tolist(), label.tolist(), strict=True)}


def test_clusters_that_blocks_see_in_part_equal_brute_force(spark, monkeypatch):
    """Points that are core only with other blocks, clusters that no hub touches, borders with cores elsewhere, huge ids."""
    rng = np.random.default_rng(21)
    knots = rng.uniform(-3, 3, (25, 2))
    x = np.round(np.vstack([rng.uniform(-3, 3, (330, 2)), knots.repeat(6, axis=0) + rng.normal(0, 0.08, (150, 2))]), 4)
    x = np.vstack([x, x[:40]])
    ids = 2**60 + rng.permutation(len(x)).astype(np.int64) * 3
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "g": "a", "v": list(x)}), "id bigint, g string, v array<double>").repartition(4)
    monkeypatch.setattr(N, "HUBS", 3)
    kinds = set()
    for eps, m in ((0.2, 4), (0.35, 9)):
        want = labels(x, eps, m, ids)
        got = {r.id: r.cluster for r in N.dbscan_clusters(df, "g", "id", "v", eps, m, pivots=4, block_rows=70, tile_rows=16).collect()}
        assert got == want
        kinds |= {None in want.values(), len(set(want.values())) > 8}
    assert kinds == {True}


def test_clusters_look_only_at_pairs_that_matter(monkeypatch):
    """In a dense block a fraction of the pairs settles which points are core and that they hang together."""
    from tidalgrid.operators import blocks as B

    x = np.random.default_rng(3).normal(size=(4000, 8))
    looked = []
    plain = B.pairs_within
    monkeypatch.setattr(B, "pairs_within", lambda a, b, eps: looked.append(len(a) * len(b)) or plain(a, b, eps))
    points = np.arange(4000), x, np.ones(4000, np.int64), np.zeros((4000, 1))
    found = B.Work(N._Cores(4.0, 10), points, 256).reducer.result()
    parts = B.Work(N._Parts(4.0), points, 256).reducer.result()
    assert (found[found.kind == N.WEIGHT].other >= 10).sum() > 3900 and parts.part.value_counts().max() > 3900
    assert sum(looked) < 4000 * 4000 / 2


def test_pairs_within_a_distance_equal_brute_force():
    from tidalgrid.operators.blocks import pairs_within

    rng = np.random.default_rng(9)
    for scale, offset in ((1.0, 0.0), (1e-9, 0.0), (1e8, 0.0), (1.0, 1e4), (1e25, 0.0)):
        x, y = (rng.integers(-4, 5, (n, 6)) * scale + offset for n in (300, 170))
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
        for eps in (5.0 * scale, np.sqrt(7.0) * scale, np.sort(d.ravel())[4000]):
            got = np.zeros(d.shape, bool)
            for i, j in pairs_within(x, y, eps):
                got[i, j] = True
            assert (got == (d <= eps)).all()
    assert not list(pairs_within(np.full((2, 3), np.nan), np.zeros((2, 3)), 1.0))


def test_nearest_centroids_hold_few_distances_at_once(spark, monkeypatch):
    """Strips of two rows give what one matrix of all rows gives; rows stay whole where a batch is empty."""
    from tidalgrid.operators import outliers as Ou

    rng = np.random.default_rng(12)
    x, c = rng.normal(size=(80, 3)), np.arange(80) % 9
    df = spark.createDataFrame([(i, "a", v.tolist(), None if k == 8 else int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "id bigint, g string, v array<double>, c bigint")
    monkeypatch.setattr(Ou, "SPOT_CELLS", 16)
    got = {r.id: r for r in Ou.centroid_distance(df.repartition(30, "c"), "g", "id", "v", "c").collect()}
    spots = np.stack([x[c == k].mean(axis=0) for k in range(8)])
    d = np.sqrt(((x[:, None] - spots[None]) ** 2).sum(2))
    assert len(got) == 80
    for i in range(80):
        k = d[i].argmin()
        edge = d[c == k, k].max()
        assert got[i].nearest_cluster == k and got[i].nearest_cluster_size == (c == k).sum()
        assert got[i].centroid_distance == pytest.approx(d[i, k]) and got[i].edge_ratio == pytest.approx(d[i, k] / edge)
