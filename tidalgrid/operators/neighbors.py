"""Exact neighbour work on vectors inside groups of any size, on the blocks of ``blocks.py``.

What leaves a task is one reduced row per point (a count, a maximum, k nearest) or a forest of links;
pairs of points are never written out.  Equal vectors are merged first and carry their number as a weight.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .blocks import Blocks, Work, as_matrix, lay_out, stream
from .ordered import exact_quantiles
from .sampling import hash_sample


class _Counts:
    """Weighted neighbours within each radius, the point itself included."""

    def __init__(self, eps: Sequence[float]):
        self.eps = eps

    def begin(self, pid, vec, w, carry):
        self.pid = pid
        self.out = np.repeat(w[:, None].astype(float), len(self.eps), axis=1)

    def reach(self, rows):
        return max(self.eps)

    def meet(self, rows, d, pid, w, carry, own):
        for j, e in enumerate(self.eps):
            self.out[rows, j] += (d <= e) @ w

    def result(self):
        return pd.DataFrame({"pid": self.pid, "counts": list(self.out)})


class _Peaks(_Counts):
    """Largest carried value per radius among the neighbours, the point itself included."""

    def begin(self, pid, vec, w, carry):
        self.pid, self.out = pid, carry.copy()

    def meet(self, rows, d, pid, w, carry, own):
        for j, e in enumerate(self.eps):
            found = np.where(d <= e, carry[None, :, j], -np.inf).max(axis=1)
            self.out[rows, j] = np.maximum(self.out[rows, j], found)

    def result(self):
        return pd.DataFrame({"pid": self.pid, "peaks": list(self.out)})


class _Nearest:
    """The k nearest others as sorted distances and ids; equal vectors count with their weight."""

    squared = True

    def __init__(self, k: int):
        self.k = k

    def begin(self, pid, vec, w, carry):
        n = len(pid)
        self.pid = pid
        self.d = np.full((n, self.k), np.inf)
        self.i = np.full((n, self.k), np.iinfo(np.int64).max)
        self.w = np.zeros((n, self.k))
        if (w > 1).any():  # copies of the point itself
            self.d[w > 1, 0], self.i[w > 1, 0], self.w[w > 1, 0] = 0.0, pid[w > 1], w[w > 1] - 1.0

    def reach(self, rows):
        return float(self.d[rows, -1].max())

    def meet(self, rows, d, pid, w, carry, own):
        # Only what is no farther than the k-th distance so far can count; ties are decided by the id.
        limit = self.d[rows, -1]
        near = d <= ((limit + 2e-9) ** 2 + 1e-12)[:, None]
        hits = np.flatnonzero(near)
        if len(hits) > 2 * self.k * len(rows) and d.shape[1] > self.k:
            there = np.where(np.isnan(d), np.inf, d)
            kth = np.sqrt(np.clip(np.partition(there, self.k - 1, axis=1)[:, self.k - 1], 0.0, None))
            near = d <= ((np.minimum(limit, kth) + 2e-9) ** 2 + 1e-12)[:, None]
            hits = np.flatnonzero(near)
        if not len(hits):
            return
        # Rows with something near, each with its finds side by side and padded.
        r, c = hits // d.shape[1], hits % d.shape[1]
        some, first, n = np.unique(r, return_index=True, return_counts=True)
        at = np.repeat(np.arange(len(some)), n), np.arange(len(r)) - np.repeat(first, n)
        more = len(some), int(n.max())
        far, ids, weight = np.full(more, np.inf), np.full(more, np.iinfo(np.int64).max), np.zeros(more)
        far[at], ids[at], weight[at] = np.sqrt(np.clip(d[r, c], 0.0, None)), pid[c], w[c]
        rows = rows[some]
        far, ids, weight = np.hstack([self.d[rows], far]), np.hstack([self.i[rows], ids]), np.hstack([self.w[rows], weight])
        # Rounded distances keep ties together; the id then decides them.
        order = np.lexsort((ids, np.round(far, 9)), axis=1)[:, : self.k]
        self.d[rows], self.i[rows], self.w[rows] = (np.take_along_axis(x, order, axis=1) for x in (far, ids, weight))

    def result(self):
        dist, ids = [], []
        for d, i, w in zip(self.d, self.i, self.w, strict=True):
            ok = np.isfinite(d)
            reps = np.minimum(w[ok], self.k).astype(int)
            dist.append(np.repeat(d[ok], reps)[: self.k])
            ids.append(np.repeat(i[ok], reps)[: self.k])
        return pd.DataFrame({"pid": self.pid, "distances": dist, "neighbors": ids})


class _Ranks:
    """How many others lie strictly nearer than each carried distance."""

    squared = True
    #: Others whose hits are added up eight to a machine word: no byte of it may run over.
    AT_ONCE = 2040

    def begin(self, pid, vec, w, carry):
        self.pid, self.at = pid, carry
        self.out = np.zeros(carry.shape)
        below = carry - 1e-9
        self.limit = np.where(below > 0, below * below, -np.inf)

    def reach(self, rows):
        return float(self.at[rows].max())

    def meet(self, rows, d, pid, w, carry, own):
        limit, n = self.limit[rows], d.shape[1]
        plain = n <= self.AT_ONCE and (w == 1).all()
        near = np.zeros((len(rows), -(-n // 8) * 8), bool)
        for j in range(limit.shape[1]):
            np.less(d, limit[:, j, None], out=near[:, :n])
            if plain:
                words = near.view(np.uint64).sum(axis=1)
                self.out[rows, j] += words.view(np.uint8).reshape(len(rows), 8).sum(axis=1)
            else:
                self.out[rows, j] += near[:, :n] @ w

    def result(self):
        return pd.DataFrame({"pid": self.pid, "ranks": list(self.out)})


class _Moments:
    """Sum, square sum and number of the distances to all others."""

    def begin(self, pid, vec, w, carry):
        self.pid, self.w = pid, w
        self.out = np.zeros((len(pid), 3))
        self.out[:, 2] = w - 1.0

    def reach(self, rows):
        return np.inf

    def meet(self, rows, d, pid, w, carry, own):
        there = ~np.isnan(d)
        d = np.where(there, d, 0.0)
        self.out[rows] += np.stack([d @ w, (d * d) @ w, there @ w], axis=1)

    def result(self):
        s = self.out * self.w[:, None]
        return pd.DataFrame({"pid": self.pid, "d1": s[:, 0], "d2": s[:, 1], "n": s[:, 2]})


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places the smallest label among them, in place; ``label`` points at places and is compressed."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (jumped := label[label]).tobytes() != label.tobytes():
            label[:] = jumped


#: What a row of _Cores and _Visits says of a point: the weight found near it, or one of the points found near it.
WEIGHT, NEAR = range(2)


class _Cores:
    """Which points of the block have ``min_samples`` near them, itself included, inside the block.

    A point is settled once it has that many; the others name all that was found, fewer than ``min_samples`` each.
    """

    def __init__(self, eps: float, min_samples: int):
        self.eps, self.least = eps, min_samples

    def begin(self, pid, vec, w, carry):
        self.pid, self.w = pid, w
        self.weight = w.astype(np.int64)
        self.near = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def reach(self, rows):
        return self.eps if (self.weight[rows] < self.least).any() else -np.inf

    def open_pairs(self, a, b, own):
        left = a[self.weight[a] < self.least]
        return [(left, b)] if len(left) else []

    def found(self, rows, others, own):
        apart = rows != others
        self._add(rows[apart], self.w[others[apart]], self.pid[others[apart]])

    def _add(self, rows, w, pid):
        np.add.at(self.weight, rows, w)
        few = self.weight[rows] < self.least
        self.near.append((rows[few], pid[few]))

    def result(self):
        rows, others = (np.concatenate(x) for x in zip(*self.near, strict=True))
        few = self.weight[rows] < self.least
        return pd.concat([
            pd.DataFrame({"pid": self.pid, "other": self.weight, "kind": WEIGHT}),
            pd.DataFrame({"pid": self.pid[rows[few]], "other": others[few], "kind": NEAR}),
        ], ignore_index=True)


class _Visits(_Cores):
    """What each visitor from another block finds in this one; it is settled here at ``min_samples``."""

    meets_own = False

    def begin(self, pid, vec, w, carry):
        self.own, self.own_w, self.rows = pid, w, []

    def reach(self, rows):
        return self.eps

    def arrive(self, points):
        super().begin(*points)
        self.weight[:] = 0

    def open_pairs(self, a, b, own):
        right = b[self.weight[b] < self.least]
        return [(a, right)] if len(right) else []

    def found(self, rows, others, own):
        self._add(others, self.own_w[rows], self.own[rows])

    def leave(self):
        out = super().result()
        self.rows.append(out[(out["kind"] == NEAR) | (out["other"] > 0)])

    def result(self):
        return pd.concat(self.rows, ignore_index=True) if self.rows else pd.DataFrame({"pid": [], "other": [], "kind": []})


class _Parts:
    """Core points of a block that hang together, by labels that numpy spreads, and the visitors that hang on them.

    Pairs of points whose labels already agree are not looked at again.
    """

    def __init__(self, eps: float):
        self.eps = eps

    def _named(self, pid, carry):
        return pid

    def begin(self, pid, vec, w, carry):
        # Names in order, so that the smallest label is the smallest id.
        self.names, self.node = np.unique(self._named(pid, carry), return_inverse=True)
        self.own_names = len(self.names)
        self.label = np.arange(self.own_names)

    def reach(self, rows):
        return self.eps

    def arrive(self, points):
        names, at = np.unique(self._named(points[0], points[3]), return_inverse=True)
        order = np.argsort(self.names, kind="stable")
        place = np.searchsorted(self.names, names, sorter=order)
        node = order[np.minimum(place, len(order) - 1)]
        new = self.names[node] != names
        node[new] = len(self.names) + np.arange(new.sum())
        self.names = np.concatenate([self.names, names[new]])
        self.label = np.concatenate([self.label, node[new]])
        self.guest = node[at]

    def open_pairs(self, a, b, own):
        if own and b[0] < a[0]:  # met before, the other way round
            return []
        la, lb = self.label[self.node[a]], self.label[(self.node if own else self.guest)[b]]
        some, n = np.unique(np.concatenate([la, lb]), return_counts=True)
        if len(some) == 1:
            return []
        # What has the most common label on both sides hangs together.
        la, lb = la == some[n.argmax()], lb == some[n.argmax()]
        return [(x, y) for x, y in ((a[~la], b), (a[la], b[~lb])) if len(x) and len(y)]

    def found(self, rows, others, own):
        merge_labels(self.label, self.node[rows], (self.node if own else self.guest)[others])

    def result(self):
        own = np.arange(len(self.names)) < self.own_names
        told = own | (self.label != np.arange(len(self.names)))
        return pd.DataFrame({"pid": self.names[told], "part": self.names[self.label[told]], "own": own[told]})


class _Joins(_Parts):
    """Components that visitors join to those of the block's points; names travel as two halves of a number."""

    meets_own = False

    def _named(self, pid, carry):
        return carry[:, 0].astype(np.int64) * 2**32 + carry[:, 1].astype(np.int64)

    def result(self):
        out = super().result()
        return out[out["pid"] != out["part"]]


def _none() -> Column:
    return F.array(F.lit(0.0))


def neighbor_counts(t: Blocks, eps: Sequence[float]) -> DataFrame:
    """(g, pid, counts): points within each radius of the vector, itself included."""
    eps = list(eps)
    return stream(t, F.lit(max(eps)), _none(), "counts array<double>", lambda: _Counts(eps))


def nearest_neighbors(t: Blocks, k: int) -> DataFrame:
    """(g, pid, distances, neighbors) of the k nearest others.

    The k-th distance inside a block bounds the true one from above, which rules out far blocks before
    the full pass; inside a task the distances found so far rule out far tiles.
    """
    fields = "distances array<double>, neighbors array<bigint>"
    if t.gaps is None:
        return stream(t, None, _none(), fields, lambda: _Nearest(k))
    tile_rows = t.tile_rows

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        near = _Nearest(k)
        Work(near, (pdf["pid"].to_numpy(), as_matrix(pdf["vec"]), pdf["w"].to_numpy(), np.zeros((len(pdf), 1))), tile_rows)
        worst = max((x[-1] if len(x) == k else np.inf) for x in near.result()["distances"])
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "cell": [pdf["cell"].iloc[0]], "block": [pdf["block"].iloc[0]], "bound": [worst]})

    bounds = reliable_checkpoint(t.points.groupBy("g", "cell", "block").applyInPandas(bound, "g string, cell int, block int, bound double"))
    bounds = bounds.withColumnsRenamed({"g": "_g", "cell": "_c", "block": "_b"})
    same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("cell") == F.col("_c")) & (F.col("block") == F.col("_b"))
    bounded = t.with_columns(t.points.join(bounds, same).drop("_g", "_c", "_b"))
    return stream(bounded, F.col("bound"), _none(), fields, lambda: _Nearest(k))


def _back_to_rows(df: DataFrame, t: Blocks, found: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Results of merged vectors joined back to every row that has the vector."""
    vec = F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(F.col(key), F.col(group), F.col(group).cast("string").alias("_g"), vec.alias("_vec"))
    kept = t.points.select("g", "vec", "pid").join(found.drop("g"), "pid").drop("pid").withColumnsRenamed({"g": "_of", "vec": "_same"})
    return rows.join(kept, (F.col("_vec") == F.col("_same")) & F.col("_g").eqNullSafe(F.col("_of"))).drop("_vec", "_same", "_g", "_of")


def knn_profile(df: DataFrame, group: str, key: str, vector: str, ks: Sequence[int], **layout) -> DataFrame:
    """Statistics of the k-th neighbour distance per group and k; groups below max(k) + 1 rows are left out."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_rows")).where(F.col("group_rows") > max(ks))
    base = df.join(big.select(group), group, "left_semi")
    t = lay_out(base, group, key, vector, **layout)
    near = nearest_neighbors(t, max(ks)).join(t.points.select("g", "pid", "w"), ["g", "pid"])
    kth = F.array(*[F.struct(F.lit(k).alias("neighbor_k"), F.element_at("distances", k).alias("d")) for k in ks])
    # A merged vector stands for w rows: its distance weighs w in the moments and quantiles.
    long = near.select("g", "w", F.inline(kth))
    w, d = F.col("w"), F.col("d")
    stats = long.groupBy("g", "neighbor_k").agg(
        F.sum("w").alias("group_rows"), (F.sum(w * d) / F.sum(w)).alias("mean_distance"), F.sum(w * d * d).alias("_sq")
    )
    spread = F.sqrt(F.greatest(F.col("_sq") / F.col("group_rows") - F.col("mean_distance") ** 2, F.lit(0.0)))
    stats = stats.withColumn("std_distance", spread).withColumn("variation", F.try_divide("std_distance", "mean_distance")).drop("_sq")
    q = exact_quantiles(long, ["g", "neighbor_k"], "d", {"median_distance": 0.5, "p90_distance": 0.9, "p95_distance": 0.95, "p99_distance": 0.99}, weight="w")
    return stats.join(q.drop("n_values"), ["g", "neighbor_k"]).withColumnRenamed("g", "group_key")


def dbscan_grid(df: DataFrame, group: str, key: str, vector: str, eps: Sequence[float], **layout) -> tuple[Blocks, DataFrame]:
    """(g, pid, w, counts, peaks) for every radius at once.

    ``counts`` are neighbours within a radius, ``peaks`` the largest such count among the neighbours.
    A point is core if its count reaches min_samples and noise if no neighbour's does, so these two
    passes answer every (radius, min_samples) setting.
    """
    eps = list(eps)
    t = lay_out(df, group, key, vector, **layout)
    counts = reliable_checkpoint(neighbor_counts(t, eps))
    carried = t.with_columns(t.points.join(counts.drop("g"), "pid"))
    peaks = stream(carried, F.lit(max(eps)), F.col("counts"), "peaks array<double>", lambda: _Peaks(eps))
    return t, carried.points.select("g", "pid", "w", "counts").join(peaks.drop("g"), "pid")


def dbscan_noise(df: DataFrame, group: str, key: str, vector: str, eps: float, min_samples: int, **layout) -> DataFrame:
    """(key, group, neighbor_count, is_core, is_noise) per row."""
    t, grid = dbscan_grid(df, group, key, vector, [eps], **layout)
    flags = grid.select(
        "g", "pid", F.col("counts")[0].cast("bigint").alias("neighbor_count"), (F.col("counts")[0] >= min_samples).alias("is_core"),
        (F.col("peaks")[0] < min_samples).alias("is_noise"),
    )
    if not layout.get("merge_equal", True):
        return df.select(key, group).join(flags.withColumnRenamed("pid", key).drop("g"), key)
    return _back_to_rows(df, t, flags, group, key, vector)


def dbscan_sweep(
    df: DataFrame, group: str, key: str, vector: str, eps: Sequence[float], min_samples: Sequence[int], min_group: int = 1, **layout
) -> DataFrame:
    """Noise share of every (eps, min_samples) over the groups that are large enough, weighted by rows."""
    _, grid = dbscan_grid(df, group, key, vector, eps, **layout)
    sizes = df.groupBy(F.col(group).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("group_rows"))
    settings = F.array(
        *[F.struct(F.lit(float(e)).alias("eps"), F.lit(m).alias("min_samples"), (F.col("peaks")[j] < m).alias("noise")) for j, e in enumerate(eps) for m in min_samples]
    )
    long = grid.join(sizes, "g").select("g", "group_rows", "w", F.inline(settings))
    used = F.col("group_rows") >= F.greatest(F.col("min_samples"), F.lit(min_group))
    out = long.where(used).groupBy("eps", "min_samples").agg(
        F.countDistinct("g").alias("groups_evaluated"), F.sum("w").alias("rows_evaluated"), F.sum(F.when(F.col("noise"), F.col("w")).otherwise(0)).alias("noise_rows")
    )
    return out.withColumn("weighted_noise_share", F.try_divide("noise_rows", "rows_evaluated"))


def eps_anchors(profile: DataFrame, by: Sequence[str] = ("neighbor_k",)) -> DataFrame:
    """Radius reference points from a neighbour profile: one row per group and k goes in."""
    med = lambda c: F.expr(f"percentile({c}, 0.5)")
    return profile.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups_profiled"), F.avg("group_rows").alias("mean_group_rows"), med("p90_distance").alias("p90_anchor"),
        med("p95_distance").alias("p95_anchor"), med("p99_distance").alias("p99_anchor"), F.avg("variation").alias("mean_variation"),
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over undirected edges (a, b).

    Every round takes the smallest label among neighbours and then follows labels to their own label,
    so distances in label chains halve; each round is checkpointed.  A round that moves nothing is the last.
    """
    both = reliable_checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = reliable_checkpoint(nodes.select("id", F.col("id").alias("component")))
    while True:
        offered = both.join(state.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_c"))
        lower = state.join(offered, "id", "left").select("id", "component", F.least("component", F.coalesce("_c", "component")).alias("_low"))
        jump = lower.select(F.col("id").alias("_low"), F.col("_low").alias("_next"))
        step = lower.join(jump, "_low").select("id", F.col("_next").alias("component"), (F.col("_next") != F.col("component")).alias("_moved"))
        step = reliable_checkpoint(step)
        moved = not step.where("_moved").isEmpty()
        state = step.drop("_moved")
        if not moved:
            return state


def _core_points(t: Blocks, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """(pid) of the core points, and (pid, to) of all pairs of a point that is no core and one near it.

    Blocks first look at their own points; only those that found too few there visit other blocks.
    """
    fields = "other bigint, kind int"
    found = reliable_checkpoint(stream(Blocks(t.points, None, t.tile_rows), None, _none(), fields, lambda: _Cores(eps, min_samples)))
    if t.gaps is not None:
        open_ids = found.where((F.col("kind") == WEIGHT) & (F.col("other") < min_samples)).select("pid")
        guests = t.points.where("cell >= 0").join(open_ids, "pid", "left_semi")
        if not guests.isEmpty():
            guests = reliable_checkpoint(guests.select(t.points.columns))
            visits = stream(t, F.lit(float(eps)), _none(), fields, lambda: _Visits(eps, min_samples), guests)
            found = found.unionByName(reliable_checkpoint(visits))
    weights = found.where(F.col("kind") == WEIGHT).groupBy("pid").agg(F.sum("other").alias("weight"))
    weights = reliable_checkpoint(weights)
    near = found.where(F.col("kind") == NEAR).select("pid", F.col("other").alias("to"))
    return weights.where(F.col("weight") >= min_samples).select("pid"), near.join(weights.where(F.col("weight") < min_samples).select("pid"), "pid")


#: About so many core points of a large group visit every block, before anything else does.
HUBS = 2048


def _core_components(t: Blocks, cores: DataFrame, eps: float) -> DataFrame:
    """(pid, cluster) of the core points; the cluster is the smallest id in it.

    Blocks find what hangs together inside them and on a few visitors, which mostly leaves one component a group that
    holds nearly all.  A link between two components has an end outside the largest one: only the core points
    outside it visit all other blocks.
    """
    points = t.points.join(cores, "pid", "left_semi").select(t.points.columns)
    reach = F.lit(float(eps))
    if t.gaps is None:
        return stream(Blocks(points, None, t.tile_rows), None, _none(), "part bigint, own boolean", lambda: _Parts(eps)).select("pid", F.col("part").alias("cluster"))
    points = reliable_checkpoint(points)
    core = t.with_columns(points)
    sizes = points.where("cell >= 0").groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(HUBS)).alias("_k")).withColumnRenamed("g", "_g")
    hubs = points.where("cell >= 0").join(F.broadcast(sizes), F.col("g").eqNullSafe(F.col("_g"))).where(F.pmod(F.xxhash64("pid", F.lit("hub")), F.col("_k")) == 0)
    found = reliable_checkpoint(stream(core, reach, _none(), "part bigint, own boolean", lambda: _Parts(eps), hubs.select(points.columns)))
    own = found.where("own").select("pid", "part")
    links = found.where(~F.col("own")).select("part", F.col("pid").alias("to"))

    def joined(own: DataFrame, edges: DataFrame) -> DataFrame:
        comp = components(own.select(F.col("part").alias("id")).distinct(), edges)
        return own.join(comp.withColumnsRenamed({"id": "part", "component": "_c"}), "part").select("pid", F.col("_c").alias("part"))

    if not links.isEmpty():
        of = own.select(F.col("pid").alias("to"), F.col("part").alias("b"))
        own = reliable_checkpoint(joined(own, links.join(of, "to").select(F.col("part").alias("a"), "b").distinct()))
    placed = points.join(own, "pid")
    largest = placed.where("cell >= 0").groupBy("g", "part").agg(F.count(F.lit(1)).alias("_n")).groupBy("g").agg(F.max_by("part", "_n").alias("part"))
    guests = placed.where("cell >= 0").join(F.broadcast(largest.select("part")), "part", "left_anti")
    if not guests.isEmpty():
        name = F.array(F.shiftright("part", 32), F.col("part").bitwiseAND(F.lit(2**32 - 1)))
        guests = reliable_checkpoint(guests.select(*points.columns, "part"))
        joins = reliable_checkpoint(stream(t.with_columns(placed), reach, name, "part bigint, own boolean", lambda: _Joins(eps), guests))
        if not joins.isEmpty():
            own = joined(own, joins.select(F.col("pid").alias("a"), F.col("part").alias("b")).distinct())
    return own.withColumnRenamed("part", "cluster")


def dbscan_clusters(df: DataFrame, group: str, key: str, vector: str, eps: float, min_samples: int, **layout) -> DataFrame:
    """(key, group, cluster) per row; the cluster is the smallest core id in it, NULL for noise.

    A border point joins the neighbouring cluster with the smallest id.  Looking ends where it can change nothing
    more: a point with ``min_samples`` near it is core, and pairs inside a known component are no new links.
    """
    t = lay_out(df, group, key, vector, **{"tile_rows": 2048, **layout})
    cores, near = _core_points(t, eps, min_samples)
    own = reliable_checkpoint(_core_components(t, cores, eps))
    border = near.join(own.withColumnRenamed("pid", "to"), "to").groupBy("pid").agg(F.min("cluster").alias("cluster"))
    found = own.unionByName(border)
    if not layout.get("merge_equal", True):
        return df.select(key, group).join(found.withColumnRenamed("pid", key), key, "left")
    return _back_to_rows(df, t, t.points.select("g", "pid").join(found, "pid", "left"), group, key, vector)


def cluster_summary(clusters: DataFrame, group: str) -> DataFrame:
    """Cluster count, largest cluster share of clustered rows, and noise share per group."""
    n = clusters.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("cluster").isNotNull()
    return n.groupBy(group).agg(
        F.count_if(inside).alias("cluster_count"),
        F.try_divide(F.max(F.when(inside, F.col("n"))), F.sum(F.when(inside, F.col("n")))).alias("largest_cluster_share"),
        F.try_divide(F.sum(F.when(~inside, F.col("n")).otherwise(0)), F.sum("n")).alias("noise_share"),
    )


def neighbor_overlap(df: DataFrame, key: str, space_a: str, space_b: str, k: int, **layout) -> DataFrame:
    """(key, overlap): share of the k nearest others that two vector spaces agree on."""
    one = df.withColumn("_all", F.lit(0))
    near = lambda v: nearest_neighbors(lay_out(one, "_all", key, v, merge_equal=False, **layout), k)
    a = near(space_a).select(F.col("pid").alias(key), F.col("neighbors").alias("_a"))
    b = near(space_b).select(F.col("pid").alias(key), F.col("neighbors").alias("_b"))
    return a.join(b, key).select(key, (F.size(F.array_intersect("_a", "_b")) / F.lit(float(k))).alias("overlap"))


def trustworthiness(df: DataFrame, key: str, high: str, low: str, k: int, **layout) -> DataFrame:
    """One row: how far the low space's neighbours are from being neighbours in the high space.

    A neighbour's high-space rank is the number of points nearer than it, counted in a pass that takes
    each point's k distances along; all ranks are never sorted out.
    """
    one = df.withColumn("_all", F.lit(0))
    near = nearest_neighbors(lay_out(one, "_all", key, low, merge_equal=False, **layout), k).select("pid", F.explode("neighbors").alias("j"))
    vec = lambda name, out: one.select(F.col(key).alias(name), F.transform(high, lambda x: x.cast("double")).alias(out))
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = near.join(vec("pid", "_u"), "pid").join(vec("j", "_v"), "j").groupBy("pid").agg(F.sort_array(F.collect_list(gap(F.col("_u"), F.col("_v")))).alias("at"))
    t = lay_out(one, "_all", key, high, merge_equal=False, **layout)
    ranks = stream(t.with_columns(t.points.join(pairs, "pid")), None, F.col("at"), "ranks array<double>", _Ranks)
    penalty = F.aggregate("ranks", F.lit(0.0), lambda s, r: s + F.greatest(r + 1 - k, F.lit(0.0)))
    out = ranks.agg(F.sum(penalty).alias("p"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    return out.select(F.col("n").alias("row_count"), (1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * F.col("p")).alias("trustworthiness"))


def distance_profile(df: DataFrame, group: str, key: str, vector: str, k: int, pair_sample: int | None = None, **layout) -> DataFrame:
    """Neighbour distances over all k, and mean, deviation and their ratio of all pair distances.

    ``pair_sample`` limits the pair distances to that many rows, as a parameter of the statistic.
    """
    t = lay_out(df, group, key, vector, **{"merge_equal": False, **layout})
    each = nearest_neighbors(t, k).select("g", F.explode("distances").alias("d"))
    near = each.groupBy("g").agg(F.avg("d").alias("mean_knn_distance"))
    q = exact_quantiles(each, ["g"], "d", {"median_knn_distance": 0.5, "p95_knn_distance": 0.95}).drop("n_values")
    chosen = df if pair_sample is None else hash_sample(df, pair_sample, key, "pairs")
    pt = t if pair_sample is None else lay_out(chosen, group, key, vector, **{"merge_equal": False, **layout})
    m = stream(pt, None, _none(), "d1 double, d2 double, n double", _Moments)
    s = m.groupBy("g").agg((F.sum("d1") / F.sum("n")).alias("pair_distance_mean"), (F.sum("d2") / F.sum("n")).alias("_m2"))
    std = F.sqrt(F.greatest(F.col("_m2") - F.col("pair_distance_mean") ** 2, F.lit(0.0)))
    s = s.withColumn("pair_distance_std", std).withColumn("concentration_ratio", F.try_divide("pair_distance_std", "pair_distance_mean")).drop("_m2")
    return near.join(q, "g").join(s, "g").withColumnRenamed("g", "group_key")
