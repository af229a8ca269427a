"""Bootstrap replicates as weighted sums: rows are read once and nothing is multiplied out.

Each item gets a Poisson(1) number of draws in each replicate, from a hash of its key and the replicate.  A task
multiplies the draws of a batch with the batch's values, so what leaves it is one row of sums a replicate;
a statistic of a replicate is then a column expression over those sums.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The hash works in whole numbers below this prime, so that any engine can repeat it; x**5 permutes them.
PRIME = 2**31 - 1
FACTORS = (48271, 69621, 16807, 39373)
#: Hashes from the j-th bound on mean more than j draws: the distribution of Poisson(1).
BOUNDS = [int(PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(j + 1))) for j in range(11)]
#: Rows multiplied at once.
ROWS_AT_ONCE = 2048


def draws(keys: np.ndarray, replicates: int, seed: int = 0) -> np.ndarray:
    """How often each key (whole numbers) is drawn in replicates 1 to ``replicates``: one row a key."""

    def fifth(x: np.ndarray) -> np.ndarray:
        square = x * x % PRIME
        return square * square % PRIME * x % PRIME

    a, b, c, d = FACTORS
    r = np.arange(1, replicates + 1, dtype=np.int64)[None, :]
    x = (np.mod(keys.astype(np.int64), PRIME)[:, None] * a + r * b + seed) % PRIME
    return np.searchsorted(np.array(BOUNDS), fifth((fifth(x) * c + r * d) % PRIME), side="right")


def replicate_sums(df: DataFrame, key: Column, values: Mapping[str, Column], replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, one sum a name): the values of all rows, each times its draws; NULL values count as nothing.

    Rows with one key are drawn together; a NULL key is a key.
    """
    names = list(values)
    rows = df.select(F.coalesce(key.cast("bigint"), F.lit(-1)).alias("key"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in values.items()])

    def add(batches):
        total = np.zeros((replicates, len(names)))
        for b in batches:
            for i in range(0, b.num_rows, ROWS_AT_ONCE):
                piece = b.slice(i, ROWS_AT_ONCE)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in piece.columns[1:]], axis=1)
                total += draws(piece.column(0).to_numpy(), replicates, seed).T.astype(float) @ x
        yield pa.record_batch([pa.array(np.arange(1, replicates + 1, dtype=np.int32)), *[pa.array(total[:, j]) for j in range(len(names))]], names=["replicate", *names])

    parts = rows.mapInArrow(add, "replicate int, " + ", ".join(f"`{n}` double" for n in names))
    return parts.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in names])


def _total(columns: Sequence[Column]) -> Column:
    return sum(columns[1:], columns[0])


def bootstrap_f1(
    df: DataFrame, truth: str, preds: Sequence[str], labels: Sequence[str], weight: str | None = None, replicates: int = 1000, seed: int = 0, key: str | None = None
) -> DataFrame:
    """Macro F1 per replicate and prediction column, each true class keeping its number of rows.

    The draws of a class are scaled to its size; a replicate in which some class is not drawn is undefined and left out.
    ``key`` names the item (default: every row is one, by its place).
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    k = range(len(labels))
    is_ = lambda c, i: F.col(c).eqNullSafe(F.lit(labels[i]))
    other = ~F.coalesce(F.col(truth).isin(*labels), F.lit(False))
    rows = {f"n{i}": is_(truth, i).cast("int") for i in k} | {"n_other": other.cast("int")}
    cells = {f"m{j}_{t}_{p}": F.when((is_(truth, t) if t in k else other) & is_(c, p), w) for j, c in enumerate(preds) for t in [*k, "other"] for p in k}
    truths = {f"w{i}": F.when(is_(truth, i), w) for i in k}
    sums = replicate_sums(df, F.monotonically_increasing_id() if key is None else F.col(key), rows | truths | cells, replicates, seed)
    sizes = df.agg(*[F.sum(c).alias(n) for n, c in rows.items()]).first()
    present = [t for t in [*k, "other"] if sizes[f"n{t}" if t != "other" else "n_other"]]
    name = lambda t: "n_other" if t == "other" else f"n{t}"
    scale = {t: F.lit(float(sizes[name(t)])) / F.col(name(t)) for t in present}
    for t in present:
        sums = sums.where(F.col(name(t)) > 0)

    def f1(j: int) -> Column:
        scores = []
        for i in k:
            hit = scale[i] * F.col(f"m{j}_{i}_{i}") if i in present else F.lit(0.0)
            both = _total([scale[i] * F.col(f"w{i}") if i in present else F.lit(0.0), *[scale[t] * F.col(f"m{j}_{t}_{i}") for t in present]])
            scores.append(F.coalesce(F.try_divide(2 * hit, both), F.lit(0.0)))
        return _total(scores) / len(labels)

    return sums.select("replicate", F.inline(F.array(*[F.struct(F.lit(c).alias("model"), f1(j).alias("macro_f1")) for j, c in enumerate(preds)])))


def bootstrap_kappa(table: DataFrame, item: str, raters: Sequence[str], labels: Sequence[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(replicate, model, value): Cohen's kappa of each pair of raters over drawn items; undefined replicates are left out.

    ``table`` has one row an item and one column a rater; an item counts for a pair that both rated.
    """
    k = range(len(labels))
    pairs = list(combinations(raters, 2))
    values = {f"c{q}_{i}_{j}": (F.col(a).eqNullSafe(F.lit(labels[i])) & F.col(b).eqNullSafe(F.lit(labels[j]))).cast("int") for q, (a, b) in enumerate(pairs) for i in k for j in k}
    sums = replicate_sums(table, F.col(item), values, replicates, seed)

    def kappa(q: int) -> Column:
        cell = lambda i, j: F.col(f"c{q}_{i}_{j}")
        n = _total([cell(i, j) for i in k for j in k])
        seen = F.try_divide(_total([cell(i, i) for i in k]), n)
        chance = F.try_divide(_total([_total([cell(i, j) for j in k]) * _total([cell(j, i) for j in k]) for i in k]), n * n)
        return F.try_divide(seen - chance, 1 - chance)

    long = sums.select("replicate", F.inline(F.array(*[F.struct(F.lit(f"{a} vs {b}").alias("model"), kappa(q).alias("value")) for q, (a, b) in enumerate(pairs)])))
    return long.where("value IS NOT NULL")


def bootstrap_agreement(ratings: DataFrame, item: str, label: str, categories: Sequence[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(replicate, model, value): Fleiss' kappa and Krippendorff's alphas over drawn items; undefined replicates are left out."""
    from .statistics import agreement_items, agreement_parts, agreement_values

    k = len(categories)
    sums = replicate_sums(agreement_items(ratings, item, label, categories), F.col(item), agreement_parts(k), replicates, seed)
    long = sums.select("replicate", F.inline(F.array(*[F.struct(F.lit(n).alias("model"), c.alias("value")) for n, c in agreement_values(k).items()])))
    return long.where("value IS NOT NULL")
