"""Profiling and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import column_quantiles


def _plain_path(path: Column) -> Column:
    """One spelling for a path: file:///x and file:/x are the same file."""
    return F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+):/+", "$1:/")


def file_health(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per file: dataset, path, bytes and rows; a file without rows is listed with 0."""
    parts = []
    for name, df in tables.items():
        spark = df.sparkSession
        # Only the listing is read here, not the content.
        listed = spark.read.format("binaryFile").load(df.inputFiles()).select(_plain_path(F.col("path")).alias("path"), F.col("length").alias("bytes"))
        counted = df.groupBy(_plain_path(F.col("_metadata.file_path")).alias("path")).agg(F.count(F.lit(1)).alias("rows"))
        parts.append(listed.join(counted, "path", "left").select(F.lit(name).alias("dataset"), "path", "bytes", F.coalesce("rows", F.lit(0)).alias("rows")))
    return reduce(DataFrame.unionByName, parts)


def file_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Files (empty ones too), bytes, smallest and largest file, rows and column count per dataset."""
    columns = F.create_map(*[x for n, df in tables.items() for x in (F.lit(n), F.lit(len(df.columns)).cast("bigint"))])
    files = file_health(tables).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("file_count"), F.count(F.when(F.col("rows") == 0, 1)).alias("empty_count"), F.sum("rows").alias("row_count"),
        F.sum("bytes").alias("byte_count"), F.min("bytes").alias("least_bytes"), F.max("bytes").alias("most_bytes"))
    return files.withColumn("column_count", columns[F.col("dataset")])


def schema_signatures(spark: SparkSession, tables: Mapping[str, DataFrame], expected: Sequence[str]) -> DataFrame:
    """Sorted column list per dataset with the columns missing from and beyond the expected ones.

    Only schemas reach the driver; they are metadata, not rows.
    """
    rows = [(n, sorted(df.columns)) for n, df in tables.items()]
    want = F.array(*[F.lit(c) for c in sorted(expected)])
    sig = spark.createDataFrame(rows, "dataset string, columns array<string>")
    return sig.select(
        "dataset",
        F.array_join("columns", ",").alias("signature"),
        F.size("columns").cast("bigint").alias("column_count"),
        F.array_join(F.array_sort(F.array_except(want, "columns")), ",").alias("missing_columns"),
        F.array_join(F.array_sort(F.array_except("columns", want)), ",").alias("unexpected_columns"),
    )


def schema_drift(signatures: DataFrame, modal: str) -> DataFrame:
    """Signature versions, how many datasets share each, and whether it differs from ``modal``."""
    return signatures.groupBy("signature").agg(
        F.count(F.lit(1)).alias("dataset_count"), F.max(F.col("signature") != F.lit(modal)).alias("is_drift")
    )


def missingness(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """NULL count and rate per column (and group): one aggregate pass, then a reshape of its result."""
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([*by, "row_count"], list(cols), "column_name", "null_count")
    return long.withColumn("null_rate", F.try_divide("null_count", "row_count"))


PROFILE_PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def numeric_profile(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float] = PROFILE_PROBS) -> DataFrame:
    """Minimum, maximum and exact quantiles of each column: two passes over all columns at once."""
    return column_quantiles(df, cols, probs)


def trip_quality_counts(
    df: DataFrame,
    distance: Column,
    seconds: Column,
    by: Sequence[str],
    max_distance: float = 100,
    min_seconds: float = 60,
    max_seconds: float = 86400,
    max_speed: float = 100,
) -> DataFrame:
    """Counts of implausible trips and their share; one trip may count under several rules."""
    speed = F.try_divide(distance, seconds / 3600.0)
    rules = {
        "negative_distance_rows": distance < 0,
        "excessive_distance_rows": distance > max_distance,
        "short_duration_rows": seconds < min_seconds,
        "excessive_duration_rows": seconds > max_seconds,
        "excessive_speed_rows": (seconds > 0) & (speed > max_speed),
    }
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw_trip_rows"), *[F.count_if(rule).alias(name) for name, rule in rules.items()]
    )
    flagged = sum((F.col(r) for r in list(rules)[1:]), F.col(list(rules)[0]))
    return out.withColumn("total_flagged_rows", flagged).withColumn(
        "pct_flagged_rows", F.round(F.try_divide("total_flagged_rows", "raw_trip_rows"), 4)
    )


def candidate_key_test(df: DataFrame, candidates: Mapping[str, Sequence[str]]) -> DataFrame:
    """How nearly unique each candidate key is: groups, repeats and the largest group."""
    parts = []
    for name, keys in candidates.items():
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            sizes.agg(
                F.sum("n").alias("total_rows"),
                F.count(F.lit(1)).alias("unique_keys"),
                F.sum(F.col("n") - 1).alias("duplicate_rows"),
                F.count_if(F.col("n") > 1).alias("repeated_keys"),
                F.max("n").alias("max_rows_per_key"),
            ).withColumn("key_name", F.lit(name))
        )
    return reduce(DataFrame.unionByName, parts)


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column, and their share.

    Rows are told apart by a 256-bit digest, so long texts are not shuffled.  NULL equals NULL, and 0.0 equals -0.0.
    """
    cells = [(F.col(f"`{c}`") + F.lit(0.0) if kind in ("float", "double") else F.col(f"`{c}`")).alias(f"c{i}") for i, (c, kind) in enumerate(df.dtypes)]
    sizes = df.select(F.sha2(F.to_json(F.struct(*cells)), 256).alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    out = sizes.agg(F.sum("_n").alias("total_rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows"))
    return out.withColumn("duplicate_share", F.try_divide("duplicate_rows", "total_rows"))


def grain_check(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows against distinct keys; keys are counted by aggregation, NULLs included."""
    return candidate_key_test(df, {"grain": key}).select("total_rows", "unique_keys", "duplicate_rows", "repeated_keys")


def worst_keys(df: DataFrame, key: Sequence[str], top: int = 20) -> DataFrame:
    """The most repeated keys."""
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .where("row_count > 1")
        .orderBy(F.desc("row_count"), *key)
        .limit(top)
    )


def coverage_by_key(df: DataFrame, key: Sequence[str], distinct: str) -> DataFrame:
    """Rows, distinct values and share of all rows per key.

    The total is a scalar subquery over the grouped counts, not a window over the whole table.
    """
    out = df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct(distinct).alias("distinct_count"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return out.withColumn("row_share", F.try_divide(F.col("row_count"), total))


def temporal_coverage(df: DataFrame, ts: str, by: Sequence[str]) -> DataFrame:
    """First and last timestamp, distinct days, hours of day and minutes of hour."""
    return df.groupBy(*by).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.countDistinct(F.to_date(ts)).alias("distinct_days"),
        F.countDistinct(F.hour(ts)).alias("distinct_hours"),
        F.countDistinct(F.minute(ts)).alias("distinct_minutes"),
    )


def missing_day_gaps(
    df: DataFrame, key: Sequence[str], day: str, start: str, end: str, min_gap: int = 14, min_median: float = 5
) -> DataFrame:
    """Days without rows per key inside [start, end], and the longest run of them.

    A gap is the distance between two neighbouring active days (window edges count as active), so
    the missing days themselves are never generated.  Rows collapse to one per key and day before
    the window over a key's days.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = df.groupBy(*key, F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("day").between(lo, hi)
    before = W.partitionBy(*key).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    steps = days.withColumn("previous", F.coalesce(F.max(F.when(inside, F.col("day"))).over(before), F.date_sub(lo, 1)))
    steps = steps.withColumn("gap", F.datediff("day", "previous") - 1)
    run = F.when(inside, F.struct("gap", F.date_add("previous", 1).alias("s"), F.date_sub("day", 1).alias("e")))
    out = steps.groupBy(*key).agg(
        F.sum("n").alias("total_rows"),
        (F.datediff(hi, lo) + 1 - F.count_if(inside)).alias("days_missing"),
        F.max_by(run, F.when(inside, F.struct("gap", (-F.unix_date("day")).alias("first")))).alias("inner"),
        F.coalesce(F.max(F.when(inside, F.col("day"))), F.date_sub(lo, 1)).alias("last"),
        F.coalesce(F.round(F.percentile(F.when(inside, F.col("n")), F.lit(0.5)), 1), F.lit(0.0)).alias("median_per_day"),
    )
    # The run up to the end of the window wins only if it is longer: the first longest run counts.
    tail = F.struct(F.datediff(hi, "last").alias("gap"), F.date_add("last", 1).alias("s"), hi.alias("e"))
    best = F.when(F.col("inner").isNull() | (tail["gap"] > F.col("inner.gap")), tail).otherwise(F.col("inner"))
    return out.withColumn("g", best).select(
        *key,
        "total_rows",
        "days_missing",
        F.col("g.gap").cast("bigint").alias("max_gap"),
        F.when(F.col("g.gap") > 0, F.col("g.s")).alias("gap_start"),
        F.when(F.col("g.gap") > 0, F.col("g.e")).alias("gap_end"),
        "median_per_day",
        ((F.col("g.gap") >= min_gap) & (F.col("median_per_day") >= min_median)).alias("suspicious"),
    )


def conservation_check(before: DataFrame, after: DataFrame, by: Sequence[str], count: str) -> DataFrame:
    """Retained raw rows against the sum of an aggregated count, per group."""
    a = before.groupBy(*by).agg(F.count(F.lit(1)).alias("raw_rows"))
    b = after.groupBy(*by).agg(F.sum(count).alias("aggregated_rows"))
    out = a.join(b, list(by), "full_outer").fillna(0, ["raw_rows", "aggregated_rows"])
    return out.withColumn("difference", F.col("raw_rows") - F.col("aggregated_rows"))


def low_information_profile(df: DataFrame, cols: Sequence[str], eps: float = 1e-12, exact: bool = True) -> DataFrame:
    """Moments and distinct counts per column with constant, near-constant and two-valued flags.

    ``exact=False`` swaps the distinct counts for sketches, which leaves one partial aggregate.
    """
    distinct = F.countDistinct if exact else F.approx_count_distinct
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "value")
    out = long.groupBy("column_name").agg(
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"),
        F.stddev_samp("value").alias("std_value"),
        distinct("value").alias("distinct_count"),
    )
    return out.withColumns(
        {
            "is_constant": F.col("min_value") == F.col("max_value"),
            "is_near_constant": F.coalesce(F.col("std_value"), F.lit(0.0)) <= eps,
            "is_two_valued": F.col("distinct_count") <= 2,
        }
    )


def numeric_safety(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL and non-finite cells per column in one pass."""

    def broken(c: str) -> Column:
        x = F.col(c).cast("double")
        return x.isNotNull() & (F.isnan(x) | (F.abs(x) == float("inf")))

    wide = df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("a"), F.count_if(broken(c)).alias("b")).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "column_name", "cells")
    return long.select("column_name", F.col("cells.a").alias("null_cells"), F.col("cells.b").alias("non_finite_cells"))


def row_coverage_gap(df: DataFrame, core: Sequence[str], engineered: Sequence[str]) -> DataFrame:
    """Rows with any or all core signals whose engineered values are incomplete."""
    have = lambda cols: sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    n_core, n_eng = have(list(core)), have(list(engineered))
    partial = n_eng < len(engineered)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(n_core > 0).alias("any_core_rows"),
        F.count_if(n_core == len(core)).alias("all_core_rows"),
        F.count_if((n_core > 0) & partial).alias("any_core_incomplete_rows"),
        F.count_if((n_core == len(core)) & partial).alias("all_core_incomplete_rows"),
    )


def compare_schema_coverage(
    spark: SparkSession, layers: Mapping[str, tuple[DataFrame, Sequence[str], str, str]]
) -> DataFrame:
    """Per layer: missing expected fields, rows, date span and distinct zones.

    ``layers`` maps a name to (table, expected fields, date column, zone column).
    """
    parts = []
    for name, (df, expected, day, zone) in layers.items():
        missing = sorted(set(expected) - set(df.columns))
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("row_count"),
                F.min(day).alias("first_date"),
                F.max(day).alias("last_date"),
                F.countDistinct(zone).alias("zone_count"),
            ).select(
                F.lit(name).alias("layer"),
                "*",
                F.lit(len(expected)).cast("bigint").alias("expected_fields"),
                F.lit(len(missing)).cast("bigint").alias("missing_fields"),
                F.lit(",".join(missing)).alias("missing_names"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def gap_position(df: DataFrame, series: Sequence[str], order: str, feature: str, first: int = 7) -> DataFrame:
    """How many NULLs of ``feature`` sit at the start or in the first rows of their series."""
    w = W.partitionBy(*series).orderBy(order)
    null = F.col(feature).isNull()
    return (
        df.withColumn("_pos", F.row_number().over(w))
        .agg(
            F.count_if(null).alias("null_rows"),
            F.count_if(null & (F.col("_pos") == 1)).alias("null_at_start"),
            F.count_if(null & (F.col("_pos") <= first)).alias("null_in_first_rows"),
            F.count_if(null & (F.col("_pos") > first)).alias("null_later"),
        )
        .withColumn("feature_name", F.lit(feature))
    )


def indicator_burden(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Active share and non-binary cells of indicator columns."""
    wide = df.agg(
        *[
            F.struct(
                F.count(F.lit(1)).alias("n"),
                F.count_if(F.col(c) == 1).alias("a"),
                F.count_if(F.col(c).isNull() | ~F.col(c).isin(0, 1)).alias("b"),
            ).alias(c)
            for c in cols
        ]
    )
    long = wide.unpivot([], list(cols), "column_name", "s")
    return long.select(
        "column_name",
        F.col("s.a").alias("active_rows"),
        F.try_divide("s.a", "s.n").alias("active_share"),
        F.col("s.b").alias("non_binary_cells"),
    )


def series_quality(
    df: DataFrame,
    key: Sequence[str],
    metrics: Sequence[str],
    min_rows: int,
    mean_floor: Mapping[str, float] | None = None,
    max_missing: float = 0.25,
) -> DataFrame:
    """Size, moments and missing share per series and metric, and whether to keep the series."""
    long = df.unpivot(list(key), list(metrics), "metric", "value")
    out = long.groupBy(*key, "metric").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("value").alias("non_null_count"),
        F.avg("value").alias("metric_mean"),
        F.stddev_samp("value").alias("metric_std"),
    )
    floor = F.lit(0.0)
    for metric, value in (mean_floor or {}).items():
        floor = F.when(F.col("metric") == metric, F.lit(float(value))).otherwise(floor)
    missing = 1 - F.col("non_null_count") / F.col("row_count")
    keep = (
        (F.col("non_null_count") >= min_rows)
        & (F.col("missing_share") <= max_missing)
        & (F.col("metric_std") > 0)
        & (F.col("metric_mean") > floor)
    )
    return out.withColumn("missing_share", missing).withColumn("keep_series", F.coalesce(keep, F.lit(False)))
