"""From raw rows to one dense panel of zone x date x temporal bucket."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import BUCKET_HOURS, calendar_fields, is_weekend, policy_period, temporal_bucket

STATE_KEY = ("zone_id", "date", "temporal_bucket")


# ---- joins -------------------------------------------------------------------------------------


def checked_broadcast(dim: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """The table with a broadcast hint if it has at most ``max_rows`` rows, else unchanged.

    The count stops one row beyond the limit, so checking a big table stays cheap; Spark then joins
    it by shuffle as usual.
    """
    small = dim.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(dim) if small else dim


def lookup_join(df: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left", max_rows: int = 100_000) -> DataFrame:
    return df.join(checked_broadcast(dim, max_rows), list(on), how)


def _unique_by(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The same rows, failing the job if a key repeats."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.any_value(F.struct(F.lit(0).alias("_x"), *rest)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    checked = one.where(F.assert_true(F.col("_n") == 1, F.lit(f"rows repeat the key {list(key)}")).isNull())
    return checked.select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def validated_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", cardinality: str = "many_to_one"
) -> DataFrame:
    """A join whose cardinality is asserted while it runs.

    The uniqueness check groups by the join key, so its shuffle also serves the join.
    """
    if cardinality not in ("one_to_one", "many_to_one"):
        raise ValueError(cardinality)
    l = _unique_by(left, on) if cardinality == "one_to_one" else left
    return l.join(_unique_by(right, on), list(on), how)


def assemble_panel(spine: DataFrame, layers: Sequence[DataFrame], key: Sequence[str] = STATE_KEY) -> DataFrame:
    """Left-join layers that are unique on the key; all share the key, so each side shuffles once."""
    return reduce(lambda a, b: a.join(b, list(key), "left"), layers, spine)


def anchored_rows(rows: DataFrame, threads: DataFrame, on: str) -> DataFrame:
    return rows.join(threads, on, "left_semi")


def without_keys(rows: DataFrame, *held_out: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose keys appear in none of the held-out tables."""
    return reduce(lambda a, h: a.join(h[0], h[1], "left_anti"), held_out, rows)


def event_window_join(events: DataFrame, daily: DataFrame, days: int, event_day: str = "event_date", day: str = "date") -> DataFrame:
    """Daily rows within +-``days`` of each event with their relative day.

    Events fan out to the days of their window, which leaves an equi-join on the day.
    """
    fan = events.withColumn("relative_day", F.explode(F.sequence(F.lit(-days), F.lit(days))))
    return fan.withColumn(day, F.date_add(event_day, F.col("relative_day"))).join(daily, day)


# ---- spine and dimensions -----------------------------------------------------------------------


def observed_values(dfs: Sequence[DataFrame], cols: Sequence[str]) -> DataFrame:
    """Distinct key values seen in any of the tables."""
    return reduce(DataFrame.unionByName, [d.select(*cols).distinct() for d in dfs]).distinct()


def dense_spine(zones: DataFrame, start: str, end: str) -> DataFrame:
    """Every zone on every day in the five buckets valid for that day.

    Each zone row unfolds in place: no join, no shuffle.
    """
    day = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    parts = lambda kind: F.array(*[F.lit(f"{kind}_{p}") for p in BUCKET_HOURS])
    bucket = F.when(is_weekend(F.col("date")), parts("weekend")).otherwise(parts("weekday"))
    return zones.withColumn("date", day).withColumn("temporal_bucket", F.explode(bucket))


def alias_dimension(dim: DataFrame, key: str, aliases: Mapping[int, int], unknown: Sequence[int] = ()) -> DataFrame:
    """Zone layer plus rows for alias and unknown ids, with a canonical id on every row."""
    kind = dict(dim.dtypes)[key]
    base = dim.withColumn("canonical_id", F.col(key)).withColumn("is_alias", F.lit(False))
    pairs = F.array(*[F.struct(F.lit(a).cast(kind).alias("a"), F.lit(c).cast(kind).alias("c")) for a, c in aliases.items()])
    target = F.try_element_at(F.filter(pairs, lambda p: p["c"] == F.col(key)), F.lit(1))
    copies = base.withColumn("_p", F.explode(F.filter(pairs, lambda p: p["c"] == F.col(key))))
    copies = copies.withColumn(key, F.col("_p.a")).withColumn("is_alias", F.lit(True)).drop("_p")
    out = base.join(copies.select(key), key, "left_anti").unionByName(copies)
    if unknown:
        ids = dim.sparkSession.createDataFrame([(u, u, True) for u in unknown], f"{key} {kind}, canonical_id {kind}, is_alias boolean")
        out = out.join(ids.select(key), key, "left_anti").unionByName(ids, allowMissingColumns=True)
    return out


def fill_by_service(panel: DataFrame, zero_always: Sequence[str], zero_if_served: Sequence[str], zone: str = "zone_id") -> DataFrame:
    """NULL policy: trip counts become zero; a served-zone count becomes zero only in zones that have
    it at all; every other column stays NULL where nothing was observed.

    Whether a zone is served is read off the panel itself, so no source is scanned again.  The window
    holds one zone's days and buckets, and later windows by zone and bucket reuse its partitioning.
    """
    w = W.partitionBy(zone)
    out = panel.fillna(0, list(zero_always))
    return out.withColumns({c: F.when(F.count(c).over(w) > 0, F.coalesce(F.col(c), F.lit(0))) for c in zero_if_served})


# ---- trips --------------------------------------------------------------------------------------


def valid_trips(
    distance: Column,
    seconds: Column,
    min_seconds: float = 60,
    max_seconds: float = 86400,
    max_distance: float = 100,
    max_speed: float = 100,
) -> Column:
    return (
        seconds.between(min_seconds, max_seconds)
        & distance.between(0, max_distance)
        & (F.try_divide(distance, seconds / 3600.0) <= max_speed)
    )


def standard_trips(df: DataFrame, mapping: Mapping[str, str | Column], service: str) -> DataFrame:
    """One service's columns renamed to the shared trip layout by its config."""
    return df.select(F.lit(service).alias("service"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in mapping.items()])


def aggregate_od(trips: DataFrame, cutoff: str) -> DataFrame:
    """Trips to origin x destination x hour with counts and means.

    Hot pairs are combined before the shuffle, and the hour in the key spreads them further.
    """
    t = calendar_fields(trips, "pickup_ts").withColumns(
        {"temporal_bucket": temporal_bucket(F.col("pickup_ts")), "period": policy_period(F.to_date("pickup_ts"), cutoff)}
    )
    return t.groupBy("service", "pickup_zone", "dropoff_zone", "date", "hour", "temporal_bucket", "period").agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.avg("distance").alias("avg_distance"),
        F.avg("seconds").alias("avg_seconds"),
    )


def collapse_duplicates(df: DataFrame, key: Sequence[str], total: str, first: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sum a measure over repeated readings; other fields come from the first reading by ``order``."""
    out = df.groupBy(*key).agg(
        F.sum(total).alias(total), F.min_by(F.struct(*first), F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("observation_count")
    )
    return out.select(*key, total, "_first.*", "observation_count")


def harmonize(
    df: DataFrame,
    sums: Mapping[str, str] | None = None,
    means: Mapping[str, str] | None = None,
    deviations: Mapping[str, str] | None = None,
    distincts: Mapping[str, str] | None = None,
    count: str = "observation_count",
    key: Sequence[str] = STATE_KEY,
) -> DataFrame:
    """Any source to the panel grain.  Arguments map output names to input columns; a deviation over
    one observation counts as zero."""
    aggs = [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    aggs += [F.avg(c).alias(n) for n, c in (means or {}).items()]
    aggs += [F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(n) for n, c in (deviations or {}).items()]
    aggs += [F.countDistinct(c).alias(n) for n, c in (distincts or {}).items()]
    return df.groupBy(*key).agg(*aggs, F.count(F.lit(1)).alias(count))


def harmonize_services(
    df: DataFrame,
    sums: Mapping[str, tuple[Column, str]] | None = None,
    means: Mapping[str, tuple[Column, str]] | None = None,
    deviations: Mapping[str, tuple[Column, str]] | None = None,
    distincts: Mapping[str, tuple[Column, str]] | None = None,
    counts: Mapping[str, Column] | None = None,
    key: Sequence[str] = STATE_KEY,
) -> DataFrame:
    """Several services that share one source, harmonized side by side in a single scan.

    Arguments map output names to (condition, input column).  A cell in which a service has no rows
    is NULL, as after a left join of separate tables.
    """
    one = lambda c, v: F.when(c, F.col(v))
    aggs = [F.sum(one(c, v)).alias(n) for n, (c, v) in (sums or {}).items()]
    aggs += [F.avg(one(c, v)).alias(n) for n, (c, v) in (means or {}).items()]
    aggs += [F.when(F.count(one(c, v)) > 0, F.coalesce(F.stddev_samp(one(c, v)), F.lit(0.0))).alias(n) for n, (c, v) in (deviations or {}).items()]
    aggs += [F.nullif(F.countDistinct(one(c, v)), F.lit(0)).alias(n) for n, (c, v) in (distincts or {}).items()]
    aggs += [F.nullif(F.count_if(c), F.lit(0)).alias(n) for n, c in (counts or {}).items()]
    return df.groupBy(*key).agg(*aggs)


def sufficient_stats(df: DataFrame, key: Sequence[str], values: Sequence[str], weight: str) -> DataFrame:
    """Additive n, sum(w x), sum(w x^2) per value; chunks can be summed again later."""
    w = F.col(weight)
    aggs = [F.sum(w).alias("weight_sum")]
    for v in values:
        seen = F.col(v).isNotNull()
        aggs += [
            F.sum(F.when(seen, w).otherwise(0)).alias(f"{v}_w"),
            F.sum(F.when(seen, F.col(v) * w).otherwise(0.0)).alias(f"{v}_wx"),
            F.sum(F.when(seen, F.col(v) * F.col(v) * w).otherwise(0.0)).alias(f"{v}_wxx"),
        ]
    return df.groupBy(*key).agg(*aggs)


def merge_stats(stats: DataFrame, key: Sequence[str]) -> DataFrame:
    parts = [c for c in stats.columns if c not in key and (c == "weight_sum" or c.endswith(("_w", "_wx", "_wxx")))]
    return stats.groupBy(*key).agg(*[F.sum(c).alias(c) for c in parts])


def finalize_stats(stats: DataFrame, values: Sequence[str]) -> DataFrame:
    """Weighted mean and population deviation between the weighted cells (NULL deviation -> 0)."""
    out = {}
    for v in values:
        mean = F.try_divide(f"{v}_wx", F.col(f"{v}_w"))
        spread = F.try_divide(f"{v}_wxx", F.col(f"{v}_w")) - mean * mean
        out[f"{v}_mean"] = mean
        out[f"{v}_std"] = F.coalesce(F.sqrt(F.greatest(spread, F.lit(0.0))), F.lit(0.0))
    drop = [f"{v}_{s}" for v in values for s in ("w", "wx", "wxx")]
    return stats.withColumns(out).drop(*drop)


def service_columns(df: DataFrame, key: Sequence[str], services: Sequence[str], count: str, service: str = "service") -> DataFrame:
    """Counts per service side by side with the pooled count."""
    per = [F.sum(F.when(F.col(service) == s, F.col(count)).otherwise(0)).alias(f"{s}_{count}") for s in services]
    return df.groupBy(*key).agg(*per, F.sum(count).alias(f"pooled_{count}"))


def recompute_distinct(df: DataFrame, key: Sequence[str], value: str, name: str, approx: bool = False) -> DataFrame:
    """Distinct values per key from base rows, since distinct counts do not add up."""
    count = F.approx_count_distinct(value) if approx else F.countDistinct(value)
    return df.groupBy(*key).agg(count.alias(name))


def profile_to_calendar(profile: DataFrame, start: str, end: str, keys: Sequence[str] = ("year", "month", "day_of_week")) -> DataFrame:
    """Monthly weekday profile rows expanded to the dates they stand for.

    The calendar is generated from its two ends, at most one row per day, so it can be broadcast.
    An aggregate put on the result runs in the same stage: the expanded rows are never stored.
    """
    span = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    days = profile.sparkSession.range(1).select(F.explode(span).alias("date"))
    days = days.select("date", F.year("date").alias("year"), F.month("date").alias("month"), F.date_format("date", "EEEE").alias("day_of_week"))
    return profile.join(F.broadcast(days), list(keys))


# ---- shares and context -------------------------------------------------------------------------


def pivot_counts(df: DataFrame, key: Sequence[str], by: str, values: Sequence[str], total: str | None = None, prefix: str = "n_") -> DataFrame:
    """Counts (or sums of ``total``) with one column per listed value; the list is explicit, so no
    extra job looks for it."""
    one = F.lit(1) if total is None else F.col(total)
    zero = F.lit(0)
    return df.groupBy(*key).agg(*[F.sum(F.when(F.col(by) == v, one).otherwise(zero)).alias(f"{prefix}{v}") for v in values])


def share_summary(df: DataFrame, by: str, value: str, digits: int = 4) -> DataFrame:
    """Total per group and its rounded share of the grand total."""
    out = df.groupBy(by).agg(F.sum(value).alias("total_value"))
    grand = df.agg(F.sum(value)).scalar()
    return out.withColumn("value_share", F.round(F.try_divide(F.col("total_value"), grand), digits))


def stacked_means(df: DataFrame, weights: Mapping[str, str], means: Mapping[str, str]) -> DataFrame:
    """Weighted mean per service over side-by-side columns, in one scan.

    ``weights`` and ``means`` map a service to its count and mean column.
    """
    pairs = F.array(
        *[F.struct(F.lit(s).alias("service"), F.col(weights[s]).cast("double").alias("w"), F.col(means[s]).cast("double").alias("m")) for s in weights]
    )
    long = df.select(F.inline(pairs))
    good = F.col("m").isNotNull()
    return long.groupBy("service").agg(
        F.sum("w").alias("weight_sum"),
        F.try_divide(F.sum(F.when(good, F.col("w") * F.col("m"))), F.sum(F.when(good, F.col("w")))).alias("weighted_mean"),
    )


def crossing_context(df: DataFrame, connected: Column, volume: str, key: Sequence[str] = ("date", "temporal_bucket")) -> DataFrame:
    """Total, connected and other crossing volume per date and bucket with the connected share."""
    v = F.col(volume)
    out = df.groupBy(*key).agg(
        F.sum(v).alias("total_volume"), F.sum(F.when(connected, v).otherwise(F.lit(0.0))).alias("connected_volume")
    )
    return out.withColumns(
        {
            "other_volume": F.col("total_volume") - F.col("connected_volume"),
            "connected_share": F.round(F.try_divide("connected_volume", "total_volume"), 3),
        }
    )


def set_overlap(a: DataFrame, b: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sizes of two key sets, of their intersection, union and differences, and their Jaccard share.

    Both sets go through one aggregation by key, so nothing is joined.
    """
    tag = lambda d, x, y: d.select(*by, *key, F.lit(x).alias("in_a"), F.lit(y).alias("in_b"))
    flags = tag(a, 1, 0).unionByName(tag(b, 0, 1)).groupBy(*by, *key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    both = F.col("in_a") + F.col("in_b") == 2
    out = flags.groupBy(*by).agg(
        F.sum("in_a").alias("a_count"),
        F.sum("in_b").alias("b_count"),
        F.count_if(both).alias("both_count"),
        F.count(F.lit(1)).alias("union_count"),
    )
    return out.withColumns(
        {
            "only_a": F.col("a_count") - F.col("both_count"),
            "only_b": F.col("b_count") - F.col("both_count"),
            "jaccard": F.try_divide("both_count", "union_count"),
        }
    )
