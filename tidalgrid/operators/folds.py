"""Cross-validation folds that keep groups whole and label shares even."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .discourse import hash_fraction

#: Small groups are dealt in this many bundles; a group above the share of one such bundle is placed on its own.
BUNDLES = 1024


def place_vectors(vectors: Sequence[Sequence[int]], k: int) -> list[int]:
    """A fold for each vector of label counts, in the given order: the one that has least of the labels it brings.

    What a fold has of a label counts as a share of all rows with that label, so rare labels weigh as much as common
    ones.  Ties go to the fold with fewest rows, then to the first.
    """
    totals = [sum(c) or 1 for c in zip(*vectors, strict=True)]
    held = [[0] * len(totals) for _ in range(k)]
    out = []
    for v in vectors:
        cost = [(sum(x * h / t for x, h, t in zip(v, fold, totals, strict=True)), sum(fold), i) for i, fold in enumerate(held)]
        best = min(cost)[2]
        held[best] = [h + x for h, x in zip(held[best], v, strict=True)]
        out.append(best)
    return out


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, salt: str = "folds", bundles: int = BUNDLES) -> DataFrame:
    """``fold`` per row: a group never spans two folds, and each fold has its share of every label.

    Label counts of groups are placed greedily, large groups first.  Groups of at most 1 / ``bundles`` of all rows are
    hashed into that many bundles, and a bundle is placed like one group; no more than twice ``bundles``
    count vectors reach the driver, however many groups there are.  Rows without group are one group, rows
    without label have a label of their own.
    """
    labels = [r[0] for r in df.groupBy(label).count().orderBy(label).collect()]
    if not labels:
        return df.withColumn("fold", F.lit(None).cast("int"))
    counts = [F.count_if(F.col(label).eqNullSafe(F.lit(x))).alias(f"_l{i}") for i, x in enumerate(labels)]
    names = [f"_l{i}" for i in range(len(labels))]
    sizes = df.groupBy(group).agg(*counts, F.count(F.lit(1)).alias("_n"))
    limit = df.count() / bundles
    bundle = lambda g: F.coalesce(F.pmod(hash_fraction(g, salt), F.lit(bundles)).cast("int"), F.lit(0))
    large = [(r[group], [r[c] for c in names]) for r in sizes.where(F.col("_n") > limit).select(group, *names).collect()]
    small = sizes.where(F.col("_n") <= limit).groupBy(bundle(F.col(group)).alias("_b")).agg(*[F.sum(c).alias(c) for c in names]).collect()
    items = [(-sum(v), 0, str(g), g, v) for g, v in large] + [(-sum(r[c] for c in names), 1, f"{r['_b']:09d}", r["_b"], [r[c] for c in names]) for r in small]
    items.sort(key=lambda x: x[:3])
    folds = place_vectors([x[-1] for x in items], k)
    of_bundle = [0] * bundles
    for (_, kind, _, b, _), fold in zip(items, folds, strict=True):
        if kind == 1:
            of_bundle[b] = fold
    in_bundle = F.element_at(F.array(*[F.lit(f) for f in of_bundle]), bundle(F.col(group)) + 1)
    placed = [(g, fold) for (_, kind, _, g, _), fold in zip(items, folds, strict=True) if kind == 0]
    if not placed:
        return df.withColumn("fold", in_bundle)
    own = df.sparkSession.createDataFrame(placed, f"_group {dict(df.dtypes)[group]}, _fold int")
    joined = df.join(F.broadcast(own), F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.withColumn("fold", F.coalesce("_fold", in_bundle)).drop("_group", "_fold")
