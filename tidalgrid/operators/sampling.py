"""Deterministic samples: the same rows for the same seed, whatever the partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sample_key(key: Column, seed: str) -> Column:
    """Pseudo-random order of a key that any SQL engine can reproduce."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def quotas(sizes: Mapping[tuple, int], n: int, floor: int = 1) -> dict[tuple, int]:
    """Rows to take per stratum: proportional, at least ``floor``, never beyond the stratum, ``n`` in all.

    What rounding leaves over goes to the largest fractional parts; an excess caused by floors comes
    off the largest quotas.
    """
    total = sum(sizes.values())
    n = min(n, total)
    exact = {s: size * n / total for s, size in sizes.items()}
    out = {s: min(sizes[s], max(min(floor, sizes[s]), int(exact[s]))) for s in sizes}
    while (gap := n - sum(out.values())) != 0:
        if gap > 0:
            order = sorted((s for s in sizes if out[s] < sizes[s]), key=lambda s: (out[s] - exact[s], s))
        else:
            above = [s for s in sizes if out[s] > min(floor, sizes[s])]
            order = sorted(above or (s for s in sizes if out[s] > 0), key=lambda s: (-out[s], s))
        for s in order[: abs(gap)]:
            out[s] += 1 if gap > 0 else -1
    return out


def cutoff(n: int, size: int, slack: float = 6.0) -> str:
    """A bound on :func:`sample_key` under which at least ``n`` of ``size`` rows lie, all but surely.

    Keys are evenly spread, so n rows are expected below n / size; ``slack`` deviations come on top.
    """
    share = (n + slack * (n**0.5 + 3)) / max(size, 1)
    return "g" if share >= 1 else f"{int(share * 16**12):012x}"  # no digit of a key reaches g


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, key: str, seed: str, floor: int = 1) -> DataFrame:
    """Exactly ``n`` rows with proportional strata.

    Only stratum sizes reach the driver; strata are categories, so these are few.
    """
    sizes = stratum_sizes(df, strata)
    return take_quotas(df, strata, quotas(sizes, n, floor), key, seed, sizes)


def stratum_sizes(df: DataFrame, strata: Sequence[str]) -> dict[tuple, int]:
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*strata).count().collect()}


def take_quotas(df: DataFrame, strata: Sequence[str], wanted: Mapping[tuple, int], key: str, seed: str, sizes: Mapping[tuple, int] | None = None) -> DataFrame:
    """The first rows of each stratum in pseudo-random order, as many as ``wanted`` says.

    A row is ranked only if its key lies under the cutoff of its stratum, which counted sizes set a little above the
    quota: no task gets more than a quota and its slack.  Should a stratum fall short, its cutoff is
    raised until it does not, so the sample is always exact.
    """
    sizes = stratum_sizes(df, strata) if sizes is None else sizes
    kinds = {f.name: f.dataType for f in df.schema.fields}
    ddl = ", ".join(f"_s{i} {kinds[s].simpleString()}" for i, s in enumerate(strata)) + ", _quota int, _cut string"
    same = None
    for i, s in enumerate(strata):
        c = F.col(s).eqNullSafe(F.col(f"_s{i}"))
        same = c if same is None else same & c
    slack = {s: 6.0 for s in wanted}
    while True:
        rows = [(*s, q, cutoff(q, sizes.get(s, 0), slack[s])) for s, q in wanted.items()]
        table = df.sparkSession.createDataFrame(rows, ddl)
        passing = df.withColumn("_key", sample_key(F.col(key), seed)).join(F.broadcast(table), same).where("_key < _cut")
        short = {tuple(r[:-1]): r[-1] for r in passing.groupBy(*strata).count().collect()}
        lacking = [s for s, q in wanted.items() if short.get(s, 0) < min(q, sizes.get(s, 0))]
        if not lacking:
            break
        slack |= {s: 4 * slack[s] for s in lacking}
    w = W.partitionBy(*strata).orderBy("_key", key)
    return passing.withColumn("_r", F.row_number().over(w)).where("_r <= _quota").select(*[passing[c] for c in df.columns])


def quota_sample(df: DataFrame, cell: str, wanted: Mapping[str, int], key: str, seed: str) -> DataFrame:
    """Chosen numbers of rows per cell, each with the weight N_cell / n_cell that undoes the choice."""
    sample = take_quotas(df, [cell], {(c,): q for c, q in wanted.items()}, key, seed)
    sizes = df.groupBy(cell).agg(F.count(F.lit(1)).alias("n_cell"))
    taken = sample.groupBy(cell).agg(F.count(F.lit(1)).alias("n_taken"))
    return sample.join(sizes.join(taken, cell), cell).withColumn("weight", F.col("n_cell") / F.col("n_taken"))


def hash_sample(df: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """The ``n`` rows smallest in pseudo-random order; only rows under a counted cutoff are sorted."""
    size, slack = df.count(), 6.0
    while True:
        cut = cutoff(n, size, slack)
        passing = df.where(sample_key(F.col(key), seed) < cut)
        if cut == "g" or passing.count() >= n:
            return passing.orderBy(sample_key(F.col(key), seed), key).limit(n)
        slack *= 4
