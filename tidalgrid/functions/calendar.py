"""Calendar, temporal-bucket and policy-period columns.

All functions take and return Columns.  Timestamps are wall-clock values without a zone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hour ranges (inclusive) of the mobility buckets.
BUCKET_HOURS = {
    "overnight": (0, 5),
    "am_peak": (6, 9),
    "midday": (10, 15),
    "pm_peak": (16, 19),
    "evening": (20, 23),
}
DAY_KINDS = ("weekday", "weekend")

# Discussion dayparts as [start, end) hours; the last one wraps past midnight.
DISCUSSION_DAYPARTS = {
    "morning": (6, 12),
    "afternoon": (12, 17),
    "evening": (17, 22),
    "overnight": (22, 6),
}

POLICY_CUTOFF = "2025-01-05"
LOCAL_ZONE = "America/New_York"


def calendar_fields(df: DataFrame, ts: str) -> DataFrame:
    """Add date, year, month, day name and hour of ``ts``."""
    c = F.col(ts)
    return df.withColumns(
        {
            "date": F.to_date(c),
            "year": F.year(c),
            "month": F.month(c),
            "day_of_week": F.date_format(c, "EEEE"),
            "hour": F.hour(c),
        }
    )


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def hour_bucket(hour: Column) -> Column:
    out = F.lit("overnight")
    for name, (lo, hi) in BUCKET_HOURS.items():
        if name != "overnight":
            out = F.when(hour.between(lo, hi), F.lit(name)).otherwise(out)
    return out


def temporal_bucket(ts: Column) -> Column:
    """One of ten values such as ``weekday_am_peak``."""
    kind = F.when(is_weekend(ts), F.lit("weekend_")).otherwise(F.lit("weekday_"))
    return F.concat(kind, hour_bucket(F.hour(ts)))


def policy_period(day: Column, cutoff: str = POLICY_CUTOFF) -> Column:
    """``post_cp`` on and after the cutoff date, ``pre_cp`` before it."""
    return F.when(day >= F.lit(cutoff).cast("date"), F.lit("post_cp")).otherwise(F.lit("pre_cp"))


def bucket_day_kind(bucket: Column) -> Column:
    return F.split_part(bucket, F.lit("_"), F.lit(1))


def bucket_daypart(bucket: Column) -> Column:
    return F.regexp_replace(bucket, "^(weekday|weekend)_", "")


def wrap_daypart(hour: Column, table: Mapping[str, tuple[int, int]] = DISCUSSION_DAYPARTS) -> Column:
    """Name of the [start, end) range holding ``hour``; ranges may wrap past midnight.

    When ranges overlap, the one listed last wins.
    """
    out = F.lit(None).cast("string")
    for name, (start, end) in table.items():
        inside = (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def epoch_to_local(seconds: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC epoch seconds to local wall clock, independent of the session time zone."""
    utc = F.timestamp_add("SECOND", seconds.cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def utc_to_local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def grain_start(day: Column, grain: str) -> Column:
    """First day of the daily, weekly (Monday start) or monthly period holding ``day``."""
    unit = {"daily": "day", "weekly": "week", "monthly": "month"}[grain]
    return F.to_date(F.date_trunc(unit, day))
