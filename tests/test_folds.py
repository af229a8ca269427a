"""Folds keep groups whole and label shares even, also with hot groups and rare labels."""

import pytest
from pyspark.sql import functions as F

from tidalgrid.operators import folds as Fo


def test_vectors_go_where_their_labels_are_scarce():
    assert Fo.place_vectors([[4, 0], [0, 4], [4, 0], [0, 4]], 2) == [0, 1, 1, 0]
    assert Fo.place_vectors([[9, 0], [1, 0], [1, 0]], 3) == [0, 1, 2] and Fo.place_vectors([], 3) == []


@pytest.mark.parametrize("bundles", [128, 1024])
def test_shares(spark, bundles):
    i = F.col("id")
    df = spark.range(30_000).select(
        "id", F.when(i % 10 == 0, "hot").when(i % 97 == 0, None).otherwise((i / 7).cast("int").cast("string")).alias("g"),
        F.when(i % 100 == 3, "rare").when(i % 11 == 0, None).when(i % 3 == 0, "a").otherwise("b").alias("y"))
    out = Fo.stratified_group_folds(df.repartition(5), "g", "y", 5, bundles=bundles).toPandas()
    assert len(out) == 30_000 and set(out.fold) == set(range(5))
    assert (out.groupby("g", dropna=False).fold.nunique() == 1).all()
    free = out[~out.g.isin(["hot"]) & out.g.notna()]
    assert out.groupby("fold").size().between(5700, 6300).all() and len(free) > 20_000
    for y in ("a", "b"):
        share = (out.y == y).groupby(out.fold).mean()
        assert (share - (out.y == y).mean()).abs().max() < (0.02 if bundles == 128 else 0.01)
    again = Fo.stratified_group_folds(df.repartition(3), "g", "y", 5, bundles=bundles).toPandas()
    assert again.set_index("id").fold.sort_index().equals(out.set_index("id").fold.sort_index())
    assert Fo.stratified_group_folds(df.limit(0), "g", "y", 5).collect() == []
