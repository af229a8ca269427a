"""Order statistics over whole columns without a single-task sort.

Values are first reduced to (value, weight) rows.  Each group is then cut at approximate quantiles
into buckets that different tasks own; only bucket totals are summed in order.  The cuts may be
approximate, the results are not: cuts decide the split of the work and nothing else.  All sizes take
the same path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


STEP = 8


def _bucket_of(value: Column) -> Column:
    """How many cuts lie below the value: every eighth cut first, then the few in between."""
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < value))
    coarse = below(F.col("_coarse"))
    return coarse * STEP + below(F.slice("_cuts", coarse * STEP + 1, F.lit(STEP - 1)))


def running_totals(
    df: DataFrame, groups: Sequence[str], order: str, sums: Sequence[str], buckets: int = 64
) -> DataFrame:
    """Add ``<s>_before`` and ``<s>_total`` for each column of ``sums``.

    ``<s>_before`` sums the rows of the group with a smaller ``order`` value, which must be unique
    in its group and not NULL.  The cuts are checkpointed, since an approximate quantile computed
    twice after a lost executor may differ, and both passes must use the same ones.
    """
    groups = list(groups)
    probs = [i / buckets for i in range(1, buckets)]
    # The rows are read for the cuts, for the bucket totals and for the result: compute them once.
    keyed = reliable_checkpoint(df if groups else df.withColumn("_all", F.lit(1)))
    by = groups or ["_all"]
    cuts = keyed.groupBy(*by).agg(F.percentile_approx(order, probs, 1000).alias("_cuts"))
    coarse = F.filter("_cuts", lambda c, i: (i + 1) % STEP == 0)
    cuts = reliable_checkpoint(cuts.withColumn("_coarse", coarse))
    # One row per group: with few groups, each huge, sending the cuts around spares a shuffle by group.
    few = cuts.limit(10_001).count() <= 10_000
    cut = keyed.join(F.broadcast(cuts) if few else cuts, by).withColumn("_bucket", _bucket_of(F.col(order))).drop("_cuts", "_coarse")
    totals = cut.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    # At most `buckets` rows per group reach these two windows.
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = cut.join(offsets, [*by, "_bucket"])
    out = out.withColumns(
        {f"{s}_before": F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"_o_{s}") for s in sums}
    )
    return out.drop("_bucket", *[f"_o_{s}" for s in sums], *([] if groups else ["_all"]))


def value_counts(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values with their row counts (or sums of a whole ``weight``); NULL and NaN left out."""
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return clean.groupBy(*groups, F.col(value)).agg((F.sum(F.col(weight)) if weight else F.count(F.lit(1))).alias("n"))


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float], buckets: int = 64, weight: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles, one row per group, for groups of any size."""
    ranked = running_totals(value_counts(df, groups, value, weight), groups, value, ["n"], buckets)
    v = F.col(value).cast("double")
    picks = []
    for name, p in probs.items():
        at = (F.col("n_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(at), F.ceil(at)
        holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
        picks += [
            F.max(F.when(holds(lo), v)).alias(f"_lo_{name}"),
            F.max(F.when(holds(hi), v)).alias(f"_hi_{name}"),
            F.max(at - lo).alias(f"_f_{name}"),
        ]
    picked = ranked.groupBy(*groups).agg(F.max("n_total").alias("n_values"), *picks)
    return picked.select(
        *groups,
        "n_values",
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ],
    )


#: Accuracy of the sketch that brackets a quantile: ranks are off by n / ACCURACY at most.
ACCURACY = 10_000
#: Distinct values inside a bracket that one task may sort; beyond it bucketed running totals do.
IN_ONE_TASK = 1_000_000


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """(column_name, min_value, max_value, n_values and each quantile of ``probs``, linearly interpolated and exact).

    One pass sketches all columns side by side and brackets every quantile by two of its values; a second
    pass counts what lies below each bracket and keeps the distinct values inside, a few in ACCURACY of the
    rows.  No other value is shuffled.  NULL and NaN are left out; a column without values has NULLs.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    wide = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    slack = 2.0 / ACCURACY
    around = [(max(p - slack, 0.0), min(p + slack, 1.0)) for p in probs.values()]
    flat = [x for pair in around for x in pair]
    sketch = wide.agg(*[a for i in range(len(cols)) for a in (
        F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"lo{i}"), F.max(f"c{i}").alias(f"hi{i}"),
        F.percentile_approx(f"c{i}", flat, ACCURACY).alias(f"q{i}"))]).first()
    # (column, quantile) -> whole and broken part of its rank, and its bracket.
    wanted = {}
    for i in range(len(cols)):
        for j, p in enumerate(probs.values()):
            if n := sketch[f"n{i}"]:
                rank = (n - 1) * p
                below, above = sketch[f"q{i}"][2 * j], sketch[f"q{i}"][2 * j + 1]
                wanted[i, j] = int(rank), rank - int(rank), sketch[f"lo{i}"] if around[j][0] == 0 else below, sketch[f"hi{i}"] if around[j][1] == 1 else above
    picked: dict[tuple[int, int], float] = {}
    if wanted:
        # A bracket is widened by the next value above, which an interpolated rank may need.
        inside = lambda i, lo, hi: (F.col(f"c{i}") >= lo) & (F.col(f"c{i}") <= hi)
        below = wide.agg(*[c for (i, j), (_, _, lo, hi) in wanted.items() for c in (
            F.count_if(F.col(f"c{i}") < lo).alias(f"b{i}_{j}"), F.min(F.when(F.col(f"c{i}") > hi, F.col(f"c{i}"))).alias(f"a{i}_{j}"))]).first()
        cells = F.array(*[F.when(inside(i, lo, hi), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}").alias("v"))) for (i, j), (_, _, lo, hi) in wanted.items()])
        kept = wide.select(F.inline(F.filter(cells, lambda x: x.isNotNull()))).groupBy("i", "j", "v").agg(F.count(F.lit(1)).alias("n"))
        kept = reliable_checkpoint(kept)
        most = kept.groupBy("i", "j").count().agg(F.max("count")).first()[0]
        if most <= IN_ONE_TASK:
            before = W.partitionBy("i", "j").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
            ranked = kept.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        else:
            ranked = running_totals(kept, ["i", "j"], "v", ["n"])
        spot = F.lit(None).cast("bigint")
        for (i, j), (whole, *_) in wanted.items():
            spot = F.when((F.col("i") == i) & (F.col("j") == j), F.lit(whole - below[f"b{i}_{j}"])).otherwise(spot)
        holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
        found = ranked.withColumn("at", spot).groupBy("i", "j").agg(F.max(F.when(holds(F.col("at")), F.col("v"))).alias("first"), F.max(F.when(holds(F.col("at") + 1), F.col("v"))).alias("second"))
        for r in found.collect():  # one row a column and quantile
            _, part, _, _ = wanted[r.i, r.j]
            second = r.second if r.second is not None else below[f"a{r.i}_{r.j}"]
            if r.first is None:
                raise ArithmeticError("a quantile lies outside its bracket")
            picked[r.i, r.j] = r.first if part == 0 or second is None else r.first + (second - r.first) * part
    rows = [(c, sketch[f"lo{i}"], sketch[f"hi{i}"], sketch[f"n{i}"], *[picked.get((i, j)) for j in range(len(probs))]) for i, c in enumerate(cols)]
    fields = ", ".join(f"`{name}` double" for name in probs)
    return df.sparkSession.createDataFrame(rows, f"column_name string, min_value double, max_value double, n_values bigint, {fields}")


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, buckets: int = 64) -> DataFrame:
    """(group, value, n, rank, n_total) with ties sharing their mean rank, starting at 1."""
    ranked = running_totals(value_counts(df, groups, value), groups, value, ["n"], buckets)
    return ranked.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2).drop("n_before")


def assign_row_id(df: DataFrame, key: Sequence[str], name: str = "row_id", start: int = 0) -> DataFrame:
    """Dense ids in key order, without pulling the table through one task.

    Rows are range-partitioned and sorted by the key; the sorted table is checkpointed, so that the
    per-partition counts and the ids rest on the same rows.  One number per partition is summed in
    order.  ``key`` must be unique.
    """
    spread = reliable_checkpoint(
        df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_at", 33)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    ordered = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_offset"))
    # One row per partition: bounded by the partition count, so safe to send to every task.
    out = spread.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    position = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, F.col("_offset") + position + F.lit(start)).drop("_at", "_part", "_offset")
