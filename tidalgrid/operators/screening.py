"""Feature screening: correlations, scorecards, contribution tiers and template consistency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import first_match
from ..session import reliable_checkpoint
from .matrix import correlation_table
from .ordered import average_ranks, running_totals


def feature_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    """Unordered pairs of column names; columns, not rows, so this is schema work."""
    return list(combinations(names, 2))


def pearson_pairs(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every column pair in a single aggregate."""
    pairs = feature_pairs(names)
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.corr(a, b).alias("correlation")) for a, b in pairs]
    return df.groupBy(*by).agg(F.array(*cells).alias("_c")).select(*by, F.inline("_c"))


def rank_columns(df: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Average ranks of each column beside the key, one ranking per column.

    Values are ranked once per distinct value by bucketed running totals and joined back by value.
    """
    long = df.select(*key, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(list(key), list(names), "_c", "_v")
    ranks = average_ranks(long, ["_c"], "_v").select("_c", "_v", "rank")
    placed = long.join(ranks, ["_c", "_v"])
    return placed.groupBy(*key).agg(*[F.max(F.when(F.col("_c") == c, F.col("rank"))).alias(c) for c in names])


def _mixed_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], min_rows: int) -> DataFrame:
    """Spearman of pairs with gaps: each pair ranks the rows in which both values are present."""
    entries = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    key = ["feature_a", "feature_b"]
    cells = df.select(F.inline(entries)).where("x IS NOT NULL AND y IS NOT NULL").groupBy(*key, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    cells = reliable_checkpoint(cells)

    def ranks(value: str) -> DataFrame:
        run = running_totals(cells.groupBy(*key, value).agg(F.sum("n").alias("m")), key, value, ["m"])
        return run.select(*key, value, (F.col("m_before") + (F.col("m") - F.col("m_total")) / 2).alias(f"r{value}"), F.col("m_total").alias("n_rows"))

    both = cells.join(ranks("x"), [*key, "x"]).join(ranks("y").drop("n_rows"), [*key, "y"])
    s = both.groupBy(*key).agg(
        F.max("n_rows").alias("n_rows"),
        F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("xy"),
        F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("xx"),
        F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("yy"),
    )
    # Ranks are centred on their mean already, so the sums are covariances.
    rho = F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy")))
    return s.where(F.col("n_rows") >= min_rows).select(*key, "n_rows", rho.alias("correlation"))


def spearman_pairs(df: DataFrame, key: Sequence[str], names: Sequence[str], min_rows: int = 50) -> DataFrame:
    """Spearman correlation of all column pairs over the rows in which both values are present.

    Columns without NULLs are ranked once each, however many pairs they form.  Only pairs with a
    gappy column rank the pair on its own, as their common rows differ from pair to pair.
    """
    df = reliable_checkpoint(df.select(*key, *names))
    filled = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in names]).head()
    whole = [c for c in names if filled[c] == filled["_n"]]
    mixed = [(a, b) for a, b in feature_pairs(names) if a not in whole or b not in whole]
    parts = []
    if len(whole) > 1 and filled["_n"] >= min_rows:
        ranked = correlation_table(rank_columns(df, key, whole), whole)
        parts.append(ranked.select("feature_a", "feature_b", F.lit(filled["_n"]).alias("n_rows"), "correlation"))
    if mixed:
        parts.append(_mixed_pairs(df, mixed, min_rows))
    if not parts:  # no pair has enough rows
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, n_rows bigint, correlation double")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def high_correlation(pairs: DataFrame, threshold: float = 0.90, strict: float = 0.95) -> DataFrame:
    """Pairs at or above the threshold with their band and an order-free pair key."""
    size = F.abs("correlation")
    band = F.when(size >= strict, "strict_high_correlation").otherwise("high_correlation")
    key = F.concat_ws("__PAIR__", F.least("feature_a", "feature_b"), F.greatest("feature_a", "feature_b"))
    return pairs.where(size >= threshold).withColumns({"correlation_band": band, "feature_pair_key": key})


def scorecard(manifest: DataFrame, evidence: Sequence[tuple[str, Column, float]], tiers: Sequence[tuple[Column, str]], default: str) -> DataFrame:
    """Additive evidence points per feature, then the first matching tier rule.

    ``evidence`` lists (name, condition, points); ``tiers`` may refer to ``score``.
    """
    points = {name: F.when(cond, F.lit(float(p))).otherwise(0.0) for name, cond, p in evidence}
    out = manifest.withColumns(points)
    score = sum((F.col(n) for n in list(points)[1:]), F.col(next(iter(points))))
    return out.withColumn("score", score).withColumn("decision_tier", first_match(tiers, default))


def contribution_tiers(steps: DataFrame, order: str, family: str, variance: str, components: str, features: str, base: str) -> DataFrame:
    """Change of variance and of component count at each added family, and its tier.

    One row per family, so the window over all of them is short.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(F.lit(0)).orderBy(order)
    change = F.coalesce((F.col(variance) - F.lag(variance).over(w)) * 100, F.lit(0.0))
    out = steps.withColumns(
        {
            "added_features": F.col(features) - F.coalesce(F.lag(features).over(w), F.lit(0)),
            "variance_change_pts": change,
            "components_change": F.coalesce(F.col(components) - F.lag(components).over(w), F.lit(0)),
        }
    )
    c = F.col("variance_change_pts")
    rules = [(F.col(family) == base, "baseline"), (c <= -10, "core_signal"), (c <= -3, "secondary_signal"), (c <= -1, "review_signal")]
    return out.withColumn("contribution_tier", first_match(rules, "low_incremental_signal"))


def template_consistency(decisions: DataFrame, feature: str = "feature_name", source: str = "source_metric", decision: str = "decision_tier") -> DataFrame:
    """Treatment of features that differ only in the metric they come from."""
    template = F.replace(F.col(feature), F.col(source), F.lit("{metric}"))
    d = F.col(decision)
    out = decisions.withColumn("feature_template", template).groupBy("feature_template").agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.countDistinct(source).alias("metric_count"),
        F.count_if(d == "selected").alias("selected_count"),
        F.count_if(d == "candidate_review").alias("review_count"),
        F.count_if(d.startswith("dropped")).alias("dropped_count"),
    )
    kinds = (F.col("selected_count") > 0).cast("int") + (F.col("review_count") > 0).cast("int") + (F.col("dropped_count") > 0).cast("int")
    verdict = first_match(
        [(F.col("feature_count") == 1, "single_feature"), (kinds > 1, "mixed_treatment"), (F.col("selected_count") > 0, "consistently_selected"), (F.col("dropped_count") > 0, "consistently_dropped")],
        "consistently_review",
    )
    return out.withColumn("template_status", verdict)
