"""Outlier frameworks, their calibration, and the events built from them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import bucket_daypart, bucket_day_kind
from ..functions.labels import first_match
from ..session import reliable_checkpoint
from .blocks import rows_of
from .ordered import assign_row_id, exact_quantiles
from .sampling import hash_sample, sample_key

# ---- isolation forest ---------------------------------------------------------------------------


def _expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as parallel arrays: feature (-1 at a leaf), cut, children and leaf depth."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    sample_rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Negative anomaly score per row: the lower, the more isolated."""
        trees = np.arange(self.feature.shape[0])[None, :]
        at = np.zeros((len(x), self.feature.shape[0]), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(math.ceil(math.log2(max(self.sample_rows, 2)))) + 1):
            f = self.feature[trees, at]
            inner = f >= 0
            if not inner.any():
                break
            go_left = x[rows, np.maximum(f, 0)] < self.cut[trees, at]
            at = np.where(inner, np.where(go_left, self.left[trees, at], self.right[trees, at]), at)
        mean = self.depth[trees, at].mean(axis=1)
        return -np.power(2.0, -mean / float(_expected_depth(self.sample_rows)))


def fit_forest(df: DataFrame, key: str, vector: str, trees: int = 300, sample_rows: int = 256, seed: int = 0) -> Forest:
    """Grow each tree on its own pseudo-random sample, one small task per tree.

    A row draws one number per tree and is sent only to the few trees whose threshold it passes, so
    about trees x sample_rows rows are shuffled whatever the table size.
    """
    n = df.count()
    psi = min(sample_rows, n)
    rate = min(1.0, (psi + 8 * math.sqrt(psi) + 16) / max(n, 1))
    draw = lambda t: F.xxhash64(F.col(key), t, F.lit(seed))
    chance = lambda t: (F.shiftrightunsigned(draw(t), 11).cast("double")) / F.lit(float(1 << 53))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: chance(t) < rate)
    fan = df.select(key, F.transform(vector, lambda x: x.cast("double")).alias("_x"), F.explode(chosen).alias("tree"))
    w = W.partitionBy("tree").orderBy(draw(F.col("tree")), key)
    sample = fan.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi)
    limit = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.array(pdf.sort_values("_r")["_x"].tolist(), dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = []

        def build(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([me, -1, 0.0, -1, -1, depth + float(_expected_depth(len(rows)))])
            spread = np.nonzero(rows.max(axis=0) > rows.min(axis=0))[0] if len(rows) > 1 else []
            if depth < limit and len(spread):
                f = int(rng.choice(spread))
                cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
                go = rows[:, f] < cut
                if go.any() and not go.all():
                    a, b = build(rows[go], depth + 1), build(rows[~go], depth + 1)
                    nodes[me][1:5] = [f, cut, a, b]
            return me

        build(x, 0)
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "depth"])
        return out.assign(tree=tree)[["tree", "node", "feature", "cut", "left", "right", "depth"]]

    schema = "tree int, node int, feature int, cut double, left int, right int, depth double"
    # At most trees x (2 sample_rows - 1) rows come back.
    t = sample.groupBy("tree").applyInPandas(grow, schema).toPandas()
    size = int(t["node"].max()) + 1
    grid = lambda c, fill, kind: _grid(t, c, trees, size, fill, kind)
    return Forest(grid("feature", -1, np.int64), grid("cut", 0.0, float), grid("left", 0, np.int64), grid("right", 0, np.int64), grid("depth", 0.0, float), psi)


def _grid(t: pd.DataFrame, column: str, trees: int, size: int, fill, kind) -> np.ndarray:
    out = np.full((trees, size), fill, dtype=kind)
    out[t["tree"].to_numpy(), t["node"].to_numpy()] = t[column].to_numpy()
    return out


def forest_scores(df: DataFrame, vector: str, forest: Forest, name: str = "score") -> DataFrame:
    """Score every row in Arrow batches against the broadcast forest, whose size is fixed."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.array(v.tolist(), dtype=float)))

    return df.withColumn(name, score(vector))


def tail_flags(scored: DataFrame, score: str, shares: Sequence[float], inclusive: bool = False) -> DataFrame:
    """(all columns, tail_share, cutoff, is_flagged): the lowest ``share`` of scores is flagged.

    All cuts come from one exact quantile pass.
    """
    names = {f"q{i}": s for i, s in enumerate(shares)}
    cuts = exact_quantiles(scored, [], score, names).agg(F.array(*[F.max(n) for n in names])).scalar()
    zipped = F.zip_with(F.array(*[F.lit(float(s)) for s in shares]), F.col("_cuts"), lambda s, c: F.struct(s.alias("tail_share"), c.alias("cutoff")))
    long = scored.withColumn("_cuts", cuts).select(*scored.columns, F.inline(zipped))
    hit = F.col(score) <= F.col("cutoff") if inclusive else F.col(score) < F.col("cutoff")
    return long.withColumn("is_flagged", hit)


# ---- gaussian mixture ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    kind: str
    log_likelihood: float
    rows: int

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for j, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
            chol = np.linalg.cholesky(c)
            z = np.linalg.solve(chol, (x - m).T)
            out[:, j] = np.log(w) - 0.5 * (z * z).sum(0) - np.log(np.diag(chol)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        parts = self.log_parts(x)
        top = parts.max(axis=1)
        return top + np.log(np.exp(parts - top[:, None]).sum(axis=1))

    @property
    def parameters(self) -> int:
        k, p = self.means.shape
        return k * (p * (p + 1) // 2 if self.kind == "full" else p) + k * p + k - 1

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + self.parameters * math.log(self.rows)

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.parameters


def fit_mixture(
    df: DataFrame, key: str, vector: str, k: int, kind: str = "full", max_iter: int = 50, tol: float = 1e-3, ridge: float = 1e-6, seed: str = "mixture"
) -> Mixture:
    """Expectation maximisation with one pass per step.

    A task adds the statistics of its rows to k x (1 + p + p^2) numbers, and the blocks are summed on
    the cluster; only those sums reach the driver.  Start points come from a small hash sample.
    """
    rows = df.select(F.transform(vector, lambda x: x.cast("double")).alias("x"))
    start = hash_sample(df.select(key, F.transform(vector, lambda x: x.cast("double")).alias("x")), 1000, key, seed)
    head = np.array([r["x"] for r in start.select("x").collect()], dtype=float)
    p = head.shape[1]
    rng = np.random.default_rng(7)
    centers = [head[0]]
    while len(centers) < k:
        gap = np.min([((head - c) ** 2).sum(1) for c in centers], axis=0)
        centers.append(head[rng.choice(len(head), p=gap / gap.sum())] if gap.sum() > 0 else head[len(centers) % len(head)])
    means = np.array(centers)
    for _ in range(10):
        near = ((head[:, None, :] - means[None]) ** 2).sum(2).argmin(1)
        means = np.array([head[near == j].mean(0) if (near == j).any() else means[j] for j in range(k)])
    spread = np.cov(head.T).reshape(p, p) + ridge * np.eye(p)
    if kind == "diag":
        spread = np.diag(np.diag(spread))
    model = Mixture(np.full(k, 1.0 / k), means, np.repeat(spread[None], k, 0), kind, -np.inf, 0)
    width = k * (1 + p + p * p) + 2

    def pass_over(current: Mixture) -> np.ndarray:
        def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s0, s1, s2, ll, n = np.zeros(k), np.zeros((k, p)), np.zeros((k, p, p)), 0.0, 0
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.array(pdf["x"].tolist(), dtype=float)
                parts = current.log_parts(x)
                top = parts.max(axis=1, keepdims=True)
                dens = np.exp(parts - top)
                total = dens.sum(axis=1, keepdims=True)
                resp = dens / total
                ll += float((top + np.log(total)).sum())
                n += len(x)
                s0 += resp.sum(0)
                s1 += resp.T @ x
                s2 += np.einsum("nk,np,nq->kpq", resp, x, x, optimize=True)
            values = np.concatenate([s0, s1.ravel(), s2.ravel(), [ll, n]])
            yield pd.DataFrame({"i": np.arange(width), "v": values})

        parts = rows.mapInPandas(block, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width)
        for r in parts:
            out[r["i"]] = r["v"]
        return out

    before = -np.inf
    for _ in range(max_iter):
        s = pass_over(model)
        s0, s1, s2 = s[:k], s[k : k + k * p].reshape(k, p), s[k + k * p : -2].reshape(k, p, p)
        ll, n = s[-2], int(s[-1])
        weight = np.maximum(s0, 1e-10)
        mu = s1 / weight[:, None]
        cov = s2 / weight[:, None, None] - np.einsum("kp,kq->kpq", mu, mu) + ridge * np.eye(p)
        if kind == "diag":
            cov = np.array([np.diag(np.diag(c)) for c in cov])
        settled = abs(ll / n - before) < tol
        before = ll / n
        model = Mixture(weight / weight.sum(), mu, cov, kind, ll, n) if not settled else Mixture(model.weights, model.means, model.covariances, kind, ll, n)
        if settled:
            break
    return model


def mixture_scores(df: DataFrame, vector: str, model: Mixture, name: str = "score") -> DataFrame:
    """Log density of every row under the mixture."""

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(model.log_density(np.array(v.tolist(), dtype=float)))

    return df.withColumn(name, score(vector))


#: Fixed value: a fit criterion counts for a structure whose dense rank is this or better.
COMPETITIVE_RANK = 4


def mixture_criteria(spark, models: Mapping[str, Mixture], feature_set: str = "all") -> DataFrame:
    """Fit criteria of candidate mixtures, one row a candidate."""
    rows = [(feature_set, n, len(m.weights), m.kind, float(m.log_likelihood / m.rows), float(m.aic), float(m.bic)) for n, m in models.items()]
    return spark.createDataFrame(rows, "feature_set string, model string, component_count int, kind string, mean_log_likelihood double, aic double, bic double")


def screen_structures(criteria: DataFrame, by: Sequence[str] = ("feature_set",)) -> DataFrame:
    """Dense ranks of BIC, AIC (small first) and mean log likelihood (large first) within ``by``, how many of
    the three are competitive, and the verdict.  There are as many rows as candidate fits."""
    rank = lambda c: F.dense_rank().over(W.partitionBy(*by).orderBy(c))
    out = criteria.withColumns({"bic_rank": rank(F.asc("bic")), "aic_rank": rank(F.asc("aic")), "log_likelihood_rank": rank(F.desc("mean_log_likelihood"))})
    c = sum((F.col(r) <= COMPETITIVE_RANK).cast("int") for r in ("bic_rank", "aic_rank", "log_likelihood_rank"))
    out = out.withColumn("competitive_metrics", c)
    c, full, diag = F.col("competitive_metrics"), F.col("kind") == "full", F.col("kind") == "diag"
    verdict = first_match([(F.col("component_count") == 1, "retire"), (full & (c == 3), "advance"), (diag & (c == 3), "caution"), (full & (c == 2), "caution")], "retire")
    return out.withColumn("structure_decision", verdict)


# ---- calibration of flags -----------------------------------------------------------------------


def score_separation(flagged: DataFrame, score: str, setting: str) -> DataFrame:
    """Tail and median gap between normal and flagged scores per setting (lower = more anomalous)."""
    q = exact_quantiles(flagged, [setting, "is_flagged"], score, {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    pick = lambda flag, c: F.max(F.when(F.col("is_flagged") == flag, F.col(c)))
    out = q.groupBy(setting).agg(
        pick(True, "n_values").alias("flagged_rows"), F.sum("n_values").alias("rows_evaluated"), pick(True, "q95").alias("anomaly_q95"),
        pick(False, "q05").alias("normal_q05"), pick(True, "q50").alias("anomaly_median"), pick(False, "q50").alias("normal_median"),
    )
    return out.withColumns({"tail_gap": F.col("normal_q05") - F.col("anomaly_q95"), "median_gap": F.col("normal_median") - F.col("anomaly_median")})


# Tail and median gaps at which a setting advances or is kept with caution.
TAIL_GAPS = (0.040, 0.030)
MEDIAN_GAPS = (0.200, 0.150)


def screen_separation(separation: DataFrame) -> DataFrame:
    t, m = F.col("tail_gap"), F.col("median_gap")
    rules = [((t >= TAIL_GAPS[0]) & (m >= MEDIAN_GAPS[0]), "advance"), ((t >= TAIL_GAPS[1]) & (m >= MEDIAN_GAPS[1]), "caution")]
    return separation.withColumn("screen_decision", first_match(rules, "retire"))


def screen_tails(separation: DataFrame, setting: str, widest: float, by: Sequence[str] = ()) -> DataFrame:
    """Verdict per tail share from the gaps and their dense ranks within ``by`` (feature set, structure)."""
    rank = lambda c: F.dense_rank().over(W.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(c)))
    out = separation.withColumns({"tail_rank": rank("tail_gap"), "median_rank": rank("median_gap")})
    sparse = (F.col(setting) <= 0.02) & (F.col("tail_rank") <= 2) & (F.col("median_rank") <= 2)
    return out.withColumn("screen_decision", first_match([(F.col(setting) == widest, "retire"), (F.col("tail_gap") <= 0, "retire"), (sparse, "advance")], "caution"))


def flag_stability(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Overlap of flags between neighbouring settings, listed in order.

    Each row compares its own flags in place; only counters are shuffled.
    """
    pairs = F.array(
        *[F.struct(F.lit(a).alias("setting_a"), F.lit(b).alias("setting_b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in zip(flags, flags[1:])]
    )
    long = df.select(F.inline(pairs))
    out = long.groupBy("setting_a", "setting_b").agg(
        F.count_if("x").alias("a_count"), F.count_if("y").alias("b_count"), F.count_if(F.col("x") & F.col("y")).alias("both_count"),
        F.count_if(F.col("x") | F.col("y")).alias("union_count"), F.count(F.lit(1)).alias("row_count"),
    )
    return out.withColumns(
        {
            "jaccard": F.try_divide("both_count", "union_count"),
            "volume_drift": F.try_divide(F.abs(F.col("a_count") - F.col("b_count")), F.col("row_count")),
        }
    )


def framework_consensus(surfaces: DataFrame, key: Sequence[str], frameworks: Sequence[str]) -> DataFrame:
    """Long (key, framework, is_flagged) to one row per key with flags and consensus levels."""
    flag = lambda f: F.coalesce(F.bool_or(F.when(F.col("framework") == f, F.col("is_flagged"))), F.lit(False))
    out = surfaces.groupBy(*key).agg(*[flag(f).alias(f"{f}_flag") for f in frameworks])
    count = sum((F.col(f"{f}_flag").cast("int") for f in frameworks[1:]), F.col(f"{frameworks[0]}_flag").cast("int"))
    out = out.withColumn("method_count", count)
    return out.withColumns(
        {"is_union": F.col("method_count") >= 1, "is_two_plus": F.col("method_count") >= 2, "is_three_plus": F.col("method_count") >= 3}
    )


# ---- interpretation -----------------------------------------------------------------------------


def explain_group_z(df: DataFrame, group: str, key: str, features: Sequence[str], flagged: Column, top: int = 5) -> DataFrame:
    """The features in which each flagged row departs most from its comparison group.

    Group moments and quartiles cover all rows; only flagged rows are joined to them.
    """
    long = df.select(group, key, flagged.alias("_flag"), *[F.col(f).cast("double").alias(f) for f in features])
    long = long.unpivot([group, key, "_flag"], list(features), "feature", "value").where("value IS NOT NULL")
    stats = long.groupBy(group, "feature").agg(F.avg("value").alias("group_mean"), F.stddev_pop("value").alias("group_std"))
    quart = exact_quantiles(long, [group, "feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n_values")
    out = long.where("_flag").drop("_flag").join(stats.join(quart, [group, "feature"]), [group, "feature"])
    z = F.when(F.col("group_std") > 0, (F.col("value") - F.col("group_mean")) / F.col("group_std"))
    w = W.partitionBy(key).orderBy(F.abs("z").desc_nulls_last(), "feature")
    return out.withColumn("z", z).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


#: Centroids up to this size, in bytes, are sent to every task as one array; beyond it rows meet them by a join.
SPOT_BYTES = 64 << 20
#: Distances of rows to centroids that are held at once.
SPOT_CELLS = 1 << 20


def centroid_distance(df: DataFrame, group: str, key: str, vector: str, cluster: str) -> DataFrame:
    """Distance of every row to the nearest cluster centroid of its group (ties: the smallest cluster), and
    its ratio to that cluster's farthest member.

    Centroids whose counted size stays under SPOT_BYTES go to the tasks as one array a group, and rows stay where
    they are.  Larger sets are joined: a row meets the centroids of its group one by one and keeps the
    nearest in a partial aggregate.
    """
    vec = F.transform(vector, lambda x: x.cast("double"))
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    base = df.withColumn("_v", vec)
    members = base.where(F.col(cluster).isNotNull())
    mid = members.groupBy(group, cluster).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("_v")))).alias("_c"), F.count(F.lit(1)).alias("_n")
    )
    rim = members.join(mid, [group, cluster]).groupBy(group, cluster).agg(F.max(gap(F.col("_v"), F.col("_c"))).alias("_edge"))
    spots = reliable_checkpoint(mid.join(rim, [group, cluster]).withColumnRenamed(cluster, "_k"))
    size = spots.agg(F.sum(F.size("_c") * 8 + 64)).first()[0] or 0
    if size <= SPOT_BYTES:
        return _nearest_spots(df, spots, group, vector, cluster)
    d = gap(F.col("_v"), F.col("_c"))
    best = base.select(key, group, "_v").join(spots, group).groupBy(key).agg(F.min(F.struct(d.alias("d"), "_k", "_n", "_edge")).alias("_near"))
    return df.join(best, key, "left").select(
        *df.columns,
        F.col("_near._k").alias("nearest_cluster"),
        F.col("_near._n").alias("nearest_cluster_size"),
        F.col("_near.d").alias("centroid_distance"),
        F.try_divide(F.col("_near.d"), F.col("_near._edge")).alias("edge_ratio"),
    )


def _nearest_spots(df: DataFrame, spots: DataFrame, group: str, vector: str, cluster: str) -> DataFrame:
    """Each row's nearest centroid out of one array a group, a batch of rows at a time."""
    known: dict[object, list] = {}
    for r in spots.collect():  # at most SPOT_BYTES
        known.setdefault(r[group], []).append((r["_k"], r["_n"], r["_edge"], r["_c"]))
    arrays = {g: (rows, np.array([c for *_, c in rows], float)) for g, rows in ((g, sorted(rows, key=lambda r: r[0])) for g, rows in known.items())}
    kind, names, cells = dict(df.dtypes), df.columns, SPOT_CELLS
    fields = f"nearest_cluster {kind[cluster]}, nearest_cluster_size bigint, centroid_distance double, edge_ratio double"

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            groups = b.column(0).to_pylist()
            out: list = [(None, None, None, None)] * b.num_rows
            by: dict[object, list[int]] = {}
            valid = b.column(1).is_valid().to_pylist()
            for i, g in enumerate(groups):
                if valid[i] and g in arrays:
                    by.setdefault(g, []).append(i)
            for g, at in by.items():
                rows, centres = arrays[g]
                x = rows_of(b.column(1).take(pa.array(at)))
                shift = centres.mean(axis=0)
                spot, far = -2.0 * (centres - shift).T, ((centres - shift) ** 2).sum(axis=1)
                strip = max(1, cells // len(centres))
                nearest = np.concatenate([(far + (x[i : i + strip] - shift) @ spot).argmin(axis=1) for i in range(0, len(x), strip)])
                d = np.concatenate([np.sqrt(((x[i : i + strip] - centres[nearest[i : i + strip]]) ** 2).sum(axis=1)) for i in range(0, len(x), strip)])
                for i, k, dist in zip(at, nearest.tolist(), d.tolist(), strict=True):
                    name, n, edge, _ = rows[k]
                    out[i] = (name, n, dist, dist / edge if edge else None)
            made = pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *made.columns], names=[*names, *made.schema.names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(fields)
    schema = to_arrow_schema(extra)
    numbers = F.transform(vector, lambda c: c.cast("double"))
    source = df.select(F.col(group).alias("_group"), numbers.alias("_numbers"), *df.columns)
    return source.mapInArrow(place, StructType([*df.schema.fields, *extra.fields]))


def representative_rows(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: str = "review") -> DataFrame:
    """A small varied panel: first rows of all strata in turn, then second rows, and so on."""
    w = W.partitionBy(*strata).orderBy(sample_key(F.col(key), seed))
    turn = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return turn.orderBy("turn", *strata).limit(n)


def recurrence_persistence(flagged: DataFrame, context: Sequence[str], day: str = "date", within: int = 7) -> DataFrame:
    """Flagged days per context, and whether another flag of the context lies within ``within`` days.

    A context has at most one row per day, so its window is bounded by the study length.
    """
    w = W.partitionBy(*context).orderBy(day)
    days = flagged.select(*context, day).distinct()
    ahead = F.coalesce(F.datediff(F.lead(day).over(w), day) <= within, F.lit(False))
    behind = F.coalesce(F.datediff(day, F.lag(day).over(w)) <= within, F.lit(False))
    return days.withColumns(
        {"recurrence": F.count(F.lit(1)).over(W.partitionBy(*context)), "followed_within": ahead, "is_persistent": ahead | behind}
    )


def external_enrichment(panel: DataFrame, flag: str, outside: DataFrame, key: Sequence[str], count: str) -> DataFrame:
    """Rate and mean count of an external event among flagged rows, among all rows, and their lift."""
    joined = panel.join(outside.select(*key, count), list(key), "left").withColumn(count, F.coalesce(count, F.lit(0)))
    hit, any_event = F.col(flag), (F.col(count) > 0).cast("double")
    out = joined.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(hit).alias("flagged_count"), F.avg(any_event).alias("any_rate"),
        F.avg(F.when(hit, any_event)).alias("flagged_any_rate"), F.avg(count).alias("mean_count"), F.avg(F.when(hit, F.col(count))).alias("flagged_mean_count"),
    )
    return out.withColumns({"any_lift": F.try_divide("flagged_any_rate", "any_rate"), "count_lift": F.try_divide("flagged_mean_count", "mean_count")})


def event_table(anomalies: DataFrame, modes: Sequence[str], key: Sequence[str] = ("zone_id", "date", "temporal_bucket")) -> DataFrame:
    """One event per zone, date and bucket out of retained anomaly rows.

    Needs feature_set, is_high_confidence, method_count, period, policy_geography; ids follow key order.
    """
    has = lambda m: F.bool_or(F.col("feature_set") == m)
    base = anomalies.groupBy(*key).agg(
        F.min("period").alias("period"), F.min("policy_geography").alias("policy_geography"), F.bool_or("is_high_confidence").alias("is_high_confidence"),
        F.max("method_count").alias("max_method_count"), *[has(m).alias(f"has_{m}") for m in modes],
    )
    b, g = F.col("temporal_bucket"), F.col("policy_geography")
    out = base.withColumns(
        {
            "daypart": bucket_daypart(b),
            "is_weekday": bucket_day_kind(b) == "weekday",
            "is_post": F.col("period") == "post_cp",
            "is_cbd": g == "cbd",
            "is_gateway_or_adjacent": g == "gateway_or_adjacent",
        }
    )
    numbered = assign_row_id(out, key, "_n", 1)
    return numbered.withColumn("event_id", F.format_string("mobility_event_%06d", "_n")).drop("_n")


def event_summary(events: DataFrame, by: str) -> DataFrame:
    out = events.groupBy(F.col(by).cast("string").alias("slice")).agg(F.count(F.lit(1)).alias("event_count"), F.count_if("is_high_confidence").alias("high_confidence_count"))
    return out.select(F.lit(by).alias("dimension"), "*", F.try_divide("high_confidence_count", "event_count").alias("high_confidence_share"))


def mode_summary(events: DataFrame, modes: Sequence[str]) -> DataFrame:
    long = events.select("is_high_confidence", *[f"has_{m}" for m in modes]).unpivot(["is_high_confidence"], [f"has_{m}" for m in modes], "mode", "present").where("present")
    return event_summary(long, "mode")
