"""Modeling matrices: imputation, scaling and principal components."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import exact_quantiles


def impute_with_policy(df: DataFrame, policies: Mapping[str, str | float]) -> DataFrame:
    """Fill NULLs per column: ``drop`` (complete cases), ``zero``, ``median`` or a constant.

    Medians and constants leave a ``<column>_missing`` indicator behind.  Medians are exact and come
    in as one scalar subquery.
    """
    need = [c for c, p in policies.items() if p == "median"]
    keep = [F.col(c).isNotNull() for c, p in policies.items() if p == "drop"]
    out = df
    for k in keep:
        out = out.where(k)
    if need:
        long = out.select(*[F.col(c).cast("double").alias(c) for c in need]).unpivot([], need, "_c", "_v")
        meds = exact_quantiles(long, ["_c"], "_v", {"m": 0.5})
        one = meds.agg(F.struct(*[F.max(F.when(F.col("_c") == c, F.col("m"))).alias(c) for c in need]))
        out = out.withColumn("_med", one.scalar())
    cols = {}
    for c, p in policies.items():
        if p == "zero":
            cols[c] = F.coalesce(F.col(c), F.lit(0))
        elif p != "drop":
            fill = F.col(f"_med.{c}") if p == "median" else F.lit(float(p))
            cols[f"{c}_missing"] = F.col(c).isNull().cast("int")
            cols[c] = F.coalesce(F.col(c), fill)
    return out.withColumns(cols).drop("_med")


def scaling_parameters(df: DataFrame, cols: Sequence[str], eps: float = 1e-12) -> DataFrame:
    """Population mean and deviation per column and what scaling does with it."""
    wide = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.count_if(~F.col(c).isin(0, 1)).alias("other")).alias(c) for c in cols])
    shape = "struct<m:double,s:double,lo:double,hi:double,other:bigint>"
    long = wide.select(*[F.col(c).cast(shape).alias(c) for c in cols]).unpivot([], list(cols), "column_name", "p")
    treat = F.when((F.col("p.s") <= eps) | (F.col("p.lo") == F.col("p.hi")), "dropped_constant").when(F.col("p.other") == 0, "kept_binary").otherwise("scaled")
    return long.select("column_name", F.col("p.m").alias("mean_value"), F.col("p.s").alias("std_value"), treat.alias("treatment"))


def scale_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population z-scores; 0/1 columns stay as they are and constants go.

    One number pair per column reaches the driver, because dropping columns changes the schema.
    """
    params = {r["column_name"]: r for r in scaling_parameters(df, cols).collect()}
    out = {}
    for c in cols:
        p = params[c]
        if p["treatment"] == "scaled":
            out[c] = (F.col(c) - F.lit(p["mean_value"])) / F.lit(p["std_value"])
    return df.withColumns(out).drop(*[c for c in cols if params[c]["treatment"] == "dropped_constant"])


@dataclass(frozen=True)
class Components:
    """Loadings as columns, the mean they are centred on, and variance shares."""

    names: tuple[str, ...]
    mean: np.ndarray
    loadings: np.ndarray
    shares: np.ndarray

    def needed(self, share: float) -> int:
        """Fewest components that reach a cumulative variance share."""
        return int(min(np.searchsorted(np.cumsum(self.shares), share - 1e-12) + 1, len(self.shares)))


def covariance(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of the columns.

    Tasks reduce their rows to one p x p block each and the blocks are added by row index, so the
    driver receives p rows of p numbers however large the table is.
    """
    p = len(cols)
    names = list(cols)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((p + 1, p + 1))
        for pdf in batches:
            x = np.hstack([np.ones((len(pdf), 1)), pdf[names].to_numpy(dtype=float)])
            gram += x.T @ x
        yield pd.DataFrame({"i": range(p + 1), "row": list(gram)})

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(blocks, "i int, row array<double>")
    total = parts.groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(p + 1)]).orderBy("i").collect()
    g = np.array([[r[f"c{j}"] for j in range(p + 1)] for r in total])
    n = g[0, 0]
    mean = g[0, 1:] / n
    return mean, (g[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)


def _eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def fit_components(df: DataFrame, cols: Sequence[str]) -> Components:
    """All principal components; the p x p eigenproblem is the only thing solved off the cluster."""
    mean, cov = covariance(df, cols)
    values, vectors = _eigen(cov)
    return Components(tuple(cols), mean, vectors, values / values.sum())


def project(df: DataFrame, model: Components, k: int, name: str = "scores") -> DataFrame:
    """Add the first ``k`` scores as an array, by matrix product on Arrow batches."""
    mean, load = model.mean, model.loadings[:, :k]

    @F.pandas_udf("array<double>")
    def scores(x: pd.DataFrame) -> pd.Series:
        return pd.Series(list((x.to_numpy(dtype=float) - mean) @ load))

    return df.withColumn(name, scores(F.struct(*[F.col(c).cast("double").alias(c) for c in model.names])))


def variance_table(spark, model: Components, levels: Sequence[float] = (0.8, 0.9, 0.95)) -> DataFrame:
    rows = [(float(s), model.needed(s), float(np.cumsum(model.shares)[model.needed(s) - 1])) for s in levels]
    return spark.createDataFrame(rows, "target_share double, component_count int, reached_share double")


def loading_stability(spark, a: Components, b: Components, k: int = 3, top: int = 10) -> DataFrame:
    """Sign-aligned cosine and correlation of matching components and overlap of their top loadings."""
    rows = []
    for i in range(k):
        u, v = a.loadings[:, i], b.loadings[:, i]
        cosine = float(u @ v / (np.linalg.norm(u) * np.linalg.norm(v)))
        sign = 1.0 if cosine >= 0 else -1.0
        lead = lambda x: set(np.argsort(-np.abs(x), kind="stable")[:top])
        rows.append((f"PC{i + 1}", abs(cosine), float(np.corrcoef(u, sign * v)[0, 1]), "same" if sign > 0 else "flipped", len(lead(u) & lead(v)) / top))
    return spark.createDataFrame(rows, "component string, aligned_cosine double, aligned_correlation double, sign_alignment string, top_overlap double")


def greedy_family_order(spark, df: DataFrame, base: Sequence[str], families: Mapping[str, Sequence[str]], head: int = 20) -> DataFrame:
    """Add feature families one by one, each time the one that compresses best with those before.

    The data are read once: every candidate set is a block of the same correlation matrix.
    """
    cols = list(base) + [c for f in families.values() for c in f]
    _, cov = covariance(df, cols)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-300, None))
    corr = cov / np.outer(sd, sd)
    at = {c: i for i, c in enumerate(cols)}

    def measure(chosen: Sequence[str]) -> tuple[float, int]:
        idx = [at[c] for c in chosen]
        values, _ = _eigen(corr[np.ix_(idx, idx)])
        cum = np.cumsum(values) / values.sum()
        return float(cum[min(head, len(cum)) - 1]), int(np.searchsorted(cum, 0.8 - 1e-12) + 1)

    chosen, left, rows = list(base), dict(families), []
    share, count = measure(chosen)
    rows.append((0, "base", len(chosen), share, count))
    while left:
        scored = sorted(((-measure(chosen + list(f))[0], name) for name, f in left.items()))
        name = scored[0][1]
        chosen += list(left.pop(name))
        share, count = measure(chosen)
        rows.append((len(rows), name, len(chosen), share, count))
    return spark.createDataFrame(rows, "step int, added_family string, feature_count int, head_variance double, components_80 int")


def correlation_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of columns without NULLs as (feature_a, feature_b, correlation), in column order."""
    _, cov = covariance(df, cols)
    sd = np.sqrt(np.diag(cov))
    rows = [
        (a, b, float(cov[i, j] / (sd[i] * sd[j])) if sd[i] > 0 and sd[j] > 0 else None)
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
        if i < j
    ]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, correlation double")
