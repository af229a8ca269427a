"""Tests, agreement and evaluation tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import normal_cdf
from .ordered import running_totals


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """Pooled z of two shares and its two-sided p-value."""
    p = F.try_divide(k1 + k2, (n1 + n2).cast("double"))
    se = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    z = F.try_divide(k1 / F.nullif(n1, F.lit(0)) - k2 / F.nullif(n2, F.lit(0)), se)
    return z, 2 * (1 - normal_cdf(F.abs(z)))


def bh_adjust(df: DataFrame, p: str, tie: str, name: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg: smallest p m / rank from here up.  One row per test, so a short table."""
    up = W.partitionBy(F.lit(0)).orderBy(F.col(p).asc_nulls_last(), tie)
    down = up.rowsBetween(0, W.unboundedFollowing)
    m = F.count(p).over(W.partitionBy(F.lit(0)))
    out = df.withColumn("_raw", F.col(p) * m / F.row_number().over(up))
    return out.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.min("_raw").over(down), F.lit(1.0)))).drop("_raw")


def student_two_sided(t: float, dof: int) -> float:
    """P(|T| >= |t|) for a whole number of degrees of freedom, by the finite series of the t distribution."""
    if dof < 1 or not math.isfinite(t):
        return math.nan
    angle = math.atan2(abs(t), math.sqrt(dof))
    c2, term, total = math.cos(angle) ** 2, 1.0, 0.0
    for k in range(dof % 2, dof - 1, 2):
        total += term
        term *= c2 * (k + 1) / (k + 2)
    if dof % 2:
        return 1 - 2 / math.pi * (angle + math.sin(angle) * math.cos(angle) * total)
    return 1 - math.sin(angle) * total


def interrupted_series(df: DataFrame, step: Column, value: str, weight: str, launch: int) -> DataFrame:
    """Weighted least squares of level, trend, level shift and trend change at ``launch``.

    Rows collapse to the sums of weighted cross products in one aggregate; a single row of 25 numbers
    is then solved.  Returns (term, coefficient, std_error, t_value, p_value), the last two-sided.
    """
    t = step.cast("double")
    post = F.when(t >= launch, 1.0).otherwise(0.0)
    x = {"const": F.lit(1.0), "t": t, "post": post, "since": (t - launch) * post}
    terms = list(x)
    w, y = F.col(weight).cast("double"), F.col(value).cast("double")
    base = df.where(y.isNotNull() & (w > 0))
    sums = [F.sum(w * x[a] * x[b]).alias(f"{a}_{b}") for a in terms for b in terms]
    sums += [F.sum(w * x[a] * y).alias(f"{a}_y") for a in terms]
    one = base.agg(*sums, F.sum(w * y * y).alias("yy"), F.count(F.lit(1)).alias("n"))

    def solve(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                xx = np.array([[r[f"{a}_{b}"] for b in terms] for a in terms], dtype=float)
                xy = np.array([r[f"{a}_y"] for a in terms], dtype=float)
                inv = np.linalg.pinv(xx)
                beta = inv @ xy
                sse = max(r["yy"] - beta @ xy, 0.0)
                dof = r["n"] - len(terms)
                se = np.sqrt(np.diag(inv) * sse / dof) if dof > 0 else np.full(len(terms), np.nan)
                yield pd.DataFrame({"term": terms, "coefficient": beta, "std_error": se, "t_value": (tv := beta / np.where(se > 0, se, np.nan)), "p_value": [student_two_sided(v, int(dof)) for v in tv]})

    return one.mapInPandas(solve, "term string, coefficient double, std_error double, t_value double, p_value double")


def ks_two_sample(df: DataFrame, value: str, in_second: Column, by: Sequence[str] = ()) -> DataFrame:
    """Largest distance of two empirical distributions and its asymptotic p-value.

    Equal values collapse first; cumulative counts then come from bucketed running totals, so no
    task sorts a whole sample.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count_if(~in_second).alias("_a"), F.count_if(in_second).alias("_b")
    )
    run = running_totals(counts, by, value, ["_a", "_b"])
    cdf = lambda s: F.try_divide(F.col(f"{s}_before") + F.col(s), F.col(f"{s}_total"))
    out = run.groupBy(*by).agg(
        F.max("_a_total").alias("n_first"), F.max("_b_total").alias("n_second"), F.max(F.abs(cdf("_a") - cdf("_b"))).alias("ks_statistic")
    )
    a, b = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    lam = F.sqrt(a * b / (a + b)) * F.col("ks_statistic")
    tail = sum(((-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 41))
    return out.withColumn("p_value", F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(2 * tail, F.lit(0.0)), F.lit(1.0))))


def distribution_profile(df: DataFrame, value: str, by: Sequence[str], min_bimodality: int = 8, min_rows: int = 30, extra_means: Mapping[str, Column] | None = None) -> DataFrame:
    """Mean, mean size and Sarle's bimodality coefficient per group, groups of ``min_rows`` and more.

    All moments are mergeable, so this is one partial and one final aggregate.
    """
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(value).alias("_m"),
        F.avg(value).alias("mean_value"),
        F.avg(F.abs(value)).alias("intensity"),
        F.skewness(value).alias("_g"),
        F.kurtosis(value).alias("_k"),
        *[F.avg(c).alias(k) for k, c in (extra_means or {}).items()],
    )
    m = F.col("_m").cast("double")
    bc = F.try_divide(F.col("_g") * F.col("_g") + 1, F.col("_k") + F.try_divide(3 * (m - 1) * (m - 1), (m - 2) * (m - 3)))
    return out.where(F.col("n") >= min_rows).withColumn("bimodality", F.when(m >= min_bimodality, bc)).drop("_m", "_g", "_k")


def density_by_period(df: DataFrame, value: str, by: Sequence[str], bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Fixed-width histogram densities per group (in place of a kernel estimate).

    The range is that of the data unless given; with a given one the end bins take what lies beyond,
    so every row counts.  NULL and NaN are left out.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if lo is None or hi is None:
        found = clean.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
        lo, hi = (found["lo"] or 0.0) if lo is None else lo, (found["hi"] or 0.0) if hi is None else hi
    width = (hi - lo) / bins or 1.0
    at = F.greatest(F.lit(0), F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)))
    n = clean.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*by))
    return n.withColumn("density", F.col("n") / (total * width)).withColumn("bin_start", F.lit(lo) + F.col("bin") * width)


# ---- classification -----------------------------------------------------------------------------


def confusion(df: DataFrame, truth: str, pred: str, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, truth, pred).agg(F.sum(F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))


def class_metrics(cells: DataFrame, truth: str, pred: str, labels: Sequence[str], by: Sequence[str] = (), w: str = "w") -> DataFrame:
    """Precision, recall and F1 per class from confusion cells; zero where undefined."""
    rows = F.array(*[F.lit(x) for x in labels])
    long = cells.withColumn("label", F.explode(rows))
    is_t, is_p = F.col(truth) == F.col("label"), F.coalesce(F.col(pred) == F.col("label"), F.lit(False))
    s = long.groupBy(*by, "label").agg(
        F.sum(F.when(is_t & is_p, F.col(w)).otherwise(0.0)).alias("tp"),
        F.sum(F.when(is_t, F.col(w)).otherwise(0.0)).alias("support"),
        F.sum(F.when(is_p, F.col(w)).otherwise(0.0)).alias("predicted"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return s.withColumns(
        {
            "precision": zero(F.try_divide("tp", "predicted")),
            "recall": zero(F.try_divide("tp", "support")),
            "f1": zero(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted"))),
        }
    ).drop("tp")


def macro_metrics(cells: DataFrame, truth: str, pred: str, labels: Sequence[str], subset: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Macro F1, accuracy, balanced accuracy, and macro F1 on rows whose truth is in ``subset``."""
    per = class_metrics(cells, truth, pred, labels, by)
    sub = class_metrics(cells.where(F.col(truth).isin(*subset)), truth, pred, subset, by)
    seen = F.col("support") > 0
    a = per.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"))
    b = sub.groupBy(*by).agg(F.avg("f1").alias("macro_f1_subset"))
    c = cells.groupBy(*by).agg((F.sum(F.when(F.col(truth) == F.col(pred), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("accuracy"))
    if by:
        return a.join(b, list(by), "left").join(c, list(by))
    return a.withColumn("accuracy", c.scalar()).withColumn("macro_f1_subset", b.scalar())


def normalized_confusion(cells: DataFrame, truth: str) -> DataFrame:
    """Cells as shares of their true class."""
    return cells.withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy(truth)))


def average_precision(df: DataFrame, truth: str, scores: Mapping[str, str], weight: Column | None = None) -> DataFrame:
    """One-vs-rest area under the precision-recall steps per class, tied scores taken together."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    entries = F.array(*[F.struct(F.lit(c).alias("label"), (-F.col(s)).alias("_order")) for c, s in scores.items()])
    long = df.select(F.col(truth).alias("_t"), w.alias("_w"), F.inline(entries))
    steps = long.groupBy("label", "_order").agg(F.sum(F.when(F.col("_t") == F.col("label"), F.col("_w")).otherwise(0.0)).alias("_tp"), F.sum("_w").alias("_n"))
    run = running_totals(steps, ["label"], "_order", ["_tp", "_n"])
    precision = F.try_divide(F.col("_tp_before") + F.col("_tp"), F.col("_n_before") + F.col("_n"))
    area = F.sum(F.try_divide("_tp", "_tp_total") * precision)
    return run.groupBy("label").agg(area.alias("average_precision"))


def bootstrap_interval(replicates: DataFrame, value: str = "macro_f1", by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and 95% percentile interval; one value per replicate, so a short table."""
    q = lambda p: F.expr(f"percentile({value}, {p})")
    return replicates.groupBy(*by).agg(F.avg(value).alias("mean_value"), q(0.025).alias("low"), q(0.975).alias("high"), F.count(F.lit(1)).alias("replicates"))


def paired_difference(replicates: DataFrame, a: str, b: str) -> DataFrame:
    """Interval and two-sided bootstrap p-value of model a minus model b."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("macro_f1")))
    diff = replicates.groupBy("replicate").agg((pick(a) - pick(b)).alias("diff"))
    out = bootstrap_interval(diff.withColumn("model", F.lit(f"{a} - {b}")), "diff")
    tails = diff.agg(F.least(2 * F.least(F.avg((F.col("diff") <= 0).cast("double")), F.avg((F.col("diff") >= 0).cast("double"))), F.lit(1.0)))
    return out.withColumn("p_value", tails.scalar()).withColumn("is_significant", (F.col("low") > 0) | (F.col("high") < 0))


# ---- agreement ----------------------------------------------------------------------------------


def rating_table(ratings: DataFrame, item: str, rater: str, label: str, raters: Sequence[str]) -> DataFrame:
    """One row per item, one column per rater."""
    return ratings.groupBy(item).agg(*[F.max(F.when(F.col(rater) == r, F.col(label))).alias(r) for r in raters])


def cohen_pairwise(table: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Raw agreement and Cohen's kappa for every pair of raters.

    Each item unfolds to its rater pairs in place; pair x label x label counts are all that shuffles.
    """
    pairs = F.array(*[F.struct(F.lit(f"{a} vs {b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(raters, 2)])
    long = table.select(F.inline(pairs)).where("x IS NOT NULL AND y IS NOT NULL")
    cells = long.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy("pair").agg(F.sum("n").alias("n_items"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy("pair", F.col("x").alias("label")).agg(F.sum("n").alias("nx"))
    right = cells.groupBy("pair", F.col("y").alias("label")).agg(F.sum("n").alias("ny"))
    chance = left.join(right, ["pair", "label"]).groupBy("pair").agg(F.sum(F.col("nx") * F.col("ny")).alias("cross"))
    out = total.join(chance, "pair", "left")
    po = F.col("same") / F.col("n_items")
    pe = F.coalesce(F.col("cross"), F.lit(0)) / (F.col("n_items").cast("double") * F.col("n_items"))
    return out.select("pair", "n_items", po.alias("raw_agreement"), F.try_divide(po - pe, 1 - pe).alias("cohen_kappa"))


def agreement_items(ratings: DataFrame, item: str, label: str, categories: Sequence[str]) -> DataFrame:
    """Category counts c0, c1 ... and their sum m of each item with two ratings or more."""
    k = range(len(categories))
    per = ratings.where(F.col(label).isin(*categories)).groupBy(item).agg(*[F.count_if(F.col(label) == c).alias(f"c{i}") for i, c in enumerate(categories)])
    return per.withColumn("m", sum((F.col(f"c{i}") for i in k[1:]), F.col("c0"))).where("m >= 2")


def agreement_parts(k: int) -> dict[str, Column]:
    """What an item adds to the sums that :func:`agreement_values` reads."""
    c = lambda i: F.col(f"c{i}").cast("double")
    mm = F.col("m").cast("double")
    agree = sum((c(i) * (c(i) - 1) for i in range(1, k)), c(0) * (c(0) - 1)) / (mm * (mm - 1))
    out = {"agree": agree, "n_items": F.lit(1), "n": F.col("m")} | {f"n{i}": c(i) for i in range(k)}
    return out | {f"o{i}_{j}": c(i) * (c(j) - (1 if i == j else 0)) / (mm - 1) for i in range(k) for j in range(k)}


def agreement_values(k: int) -> dict[str, Column]:
    """Fleiss' kappa and Krippendorff's alphas from the sums; NULL where they are undefined."""
    n = F.col("n").cast("double")
    add = lambda xs: sum(xs[1:], xs[0])
    p_e = add([F.try_divide(F.col(f"n{i}"), n) * F.try_divide(F.col(f"n{i}"), n) for i in range(k)])

    def alpha(distance) -> Column:
        pairs = [(i, j) for i in range(k) for j in range(k) if i != j]
        seen = add([F.col(f"o{i}_{j}") * distance(i, j) for i, j in pairs])
        expected = add([F.col(f"n{i}") * F.col(f"n{j}") * distance(i, j) for i, j in pairs])
        return 1 - F.try_divide((n - 1) * seen, expected)

    def ordinal(i: int, j: int) -> Column:
        lo, hi = min(i, j), max(i, j)
        between = add([F.col(f"n{g}") for g in range(lo, hi + 1)])
        d = between - (F.col(f"n{lo}") + F.col(f"n{hi}")) / 2
        return d * d

    p_bar = F.try_divide(F.col("agree"), F.col("n_items").cast("double"))
    return {"fleiss_kappa": F.try_divide(p_bar - p_e, 1 - p_e), "alpha_nominal": alpha(lambda i, j: F.lit(1.0)), "alpha_ordinal": alpha(ordinal)}


def multi_rater_agreement(ratings: DataFrame, item: str, label: str, categories: Sequence[str]) -> DataFrame:
    """Fleiss' kappa and Krippendorff's alpha, nominal and ordinal in the order of ``categories``.

    One aggregate turns items into category counts, a second sums the coincidence matrix.
    """
    k = len(categories)
    s = agreement_items(ratings, item, label, categories).agg(*[F.sum(c).alias(n) for n, c in agreement_parts(k).items()])
    return s.select("n_items", *[c.alias(n) for n, c in agreement_values(k).items()])


def head_to_head(df: DataFrame, cell: str, sources: Mapping[str, Column]) -> DataFrame:
    """Share of rows per cell in which the reference label backs each source."""
    return df.groupBy(cell).agg(F.count(F.lit(1)).alias("n_items"), *[F.avg(ok.cast("double")).alias(f"{k}_right") for k, ok in sources.items()])


def fold_mean_std(df: DataFrame, model: str, metrics: Sequence[str], sample: bool = True) -> DataFrame:
    std = F.stddev_samp if sample else F.stddev_pop
    aggs = [F.count(F.lit(1)).alias("n_folds")]
    for x in metrics:
        aggs += [F.avg(x).alias(f"{x}_mean"), std(x).alias(f"{x}_std")]
    return df.groupBy(model).agg(*aggs)


def prevalence_by_slice(df: DataFrame, flag: Column, by: Sequence[str]) -> DataFrame:
    """Rows, flagged rows and flagged share per slice."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(flag).alias("flagged_count"))
    return out.withColumn("prevalence", F.try_divide("flagged_count", "row_count"))


def slice_spread(slices: DataFrame, name: Column) -> DataFrame:
    """Smallest, median and largest slice prevalence with the slices that hold the ends."""
    return slices.agg(
        F.min("prevalence").alias("min_prevalence"),
        F.expr("percentile(prevalence, 0.5)").alias("median_prevalence"),
        F.max("prevalence").alias("max_prevalence"),
        F.min_by(name, F.struct("prevalence", name)).alias("min_slice"),
        F.max_by(name, F.struct("prevalence", name)).alias("max_slice"),
    )


def concentration(df: DataFrame, flag: Column, by: str, top: int = 5) -> DataFrame:
    """Share of flagged rows in the leading value and in the ``top`` leading values of ``by``."""
    n = df.where(flag).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("n"), by)
    head = n.orderBy(F.desc("n"), by).limit(top).withColumn("r", F.row_number().over(w))
    total = n.agg(F.sum("n")).scalar()
    return head.agg(
        F.max(F.when(F.col("r") == 1, F.col(by))).alias("top_value"), F.max("n").alias("top_count"), F.sum("n").alias("top_k_count")
    ).withColumn("top_share", F.col("top_count") / total).withColumn("top_k_share", F.col("top_k_count") / total)
