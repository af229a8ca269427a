"""How the given tables stand in for the study's sources, in Spark and as SQL fragments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import policy_period, temporal_bucket
from ..operators import panel as P
from ..session import reliable_checkpoint

CUTOFF = "2024-01-16"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def iso(c):
    return F.date_format(c, "yyyy-MM-dd")


def r6(c):
    """Six digits and no negative zero, as the checking SQL prints them."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), 6) + F.lit(0.0)


def rounded(df: DataFrame, nullable: Sequence[str] = ()) -> DataFrame:
    """Every double rounded to six digits, every date as ISO text and every integer a bigint.

    A nudge of 1e-9 on both sides makes exact ties round the same way in both engines.  Integers
    named in ``nullable`` hold NULLs and become doubles, the one form both engines hand out alike.
    """
    out = []
    for name, kind in df.dtypes:
        if name in nullable:
            out.append(F.col(name).cast("double").alias(name))
        elif kind in ("double", "float"):
            out.append(r6(F.col(name).cast("double")).alias(name))
        elif kind == "date":
            out.append(iso(name).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Events as mobility rows: zone, date, hour, bucket and period."""
    e = table(spark, folder, "events")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        (F.col("user_id") % 25).cast("int").alias("zone_id"),
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hour"),
        temporal_bucket(F.col("ts")).alias("temporal_bucket"),
        policy_period(F.to_date("ts"), CUTOFF).alias("period"),
    )


def layers(act: DataFrame) -> dict[str, DataFrame]:
    of = lambda kind: act.where(F.col("event_type") == kind)
    return {
        "trips": P.harmonize(of("purchase"), sums={"trip_value": "value"}, count="trip_count"),
        "ridership": P.harmonize(of("click"), sums={"ridership": "value"}, distincts={"riders": "user_id"}, count="ride_count"),
        "speed": P.harmonize(of("view"), means={"avg_speed": "value"}, deviations={"speed_std": "value"}, count="speed_count"),
        "traffic": P.harmonize(of("signup").where(F.col("value") > 20), sums={"traffic_volume": "value"}, count="traffic_count"),
    }


def _with_policy(joined: DataFrame) -> DataFrame:
    return P.fill_by_service(joined, ["trip_count", "trip_value", "ride_count"], ["ridership"])


def study_days(spark: SparkSession, folder: str) -> tuple[str, str]:
    """First and last day with activity."""
    r = table(spark, folder, "events").agg(F.min(F.to_date("ts")).cast("string").alias("a"), F.max(F.to_date("ts")).cast("string").alias("z")).first()
    return r["a"], r["z"]


def _spine(zones: DataFrame, days: tuple[str, str]) -> DataFrame:
    return P.dense_spine(zones, *days).withColumn("period", policy_period(F.col("date"), CUTOFF))


def joined_panel(spark: SparkSession, folder: str) -> DataFrame:
    """zone x date x bucket from four separately harmonized layers, each written once."""
    parts = {k: reliable_checkpoint(v) for k, v in layers(activity(spark, folder)).items()}
    zones = P.observed_values(list(parts.values()), ["zone_id"])
    return _with_policy(P.assemble_panel(_spine(zones, study_days(spark, folder)), list(parts.values())))


def dense_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The same panel in one scan, as here all four services come from one table."""
    of = lambda kind: F.col("event_type") == kind
    ride, trip, speed, flow = of("click"), of("purchase"), of("view"), of("signup") & (F.col("value") > 20)
    states = P.harmonize_services(
        activity(spark, folder).where(ride | trip | speed | flow),
        sums={"trip_value": (trip, "value"), "ridership": (ride, "value"), "traffic_volume": (flow, "value")},
        means={"avg_speed": (speed, "value")},
        deviations={"speed_std": (speed, "value")},
        distincts={"riders": (ride, "user_id")},
        counts={"trip_count": trip, "ride_count": ride, "speed_count": speed, "traffic_count": flow},
    )
    states = reliable_checkpoint(states)
    return _with_policy(P.assemble_panel(_spine(states.select("zone_id").distinct(), study_days(spark, folder)), [states]))


def nation_series(spark: SparkSession, folder: str) -> DataFrame:
    """Daily totals per supplier nation: 25 long series."""
    l = table(spark, folder, "lineitem")
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return (
        l.join(s, l.l_suppkey == s.s_suppkey)
        .groupBy(F.col("s_nationkey").alias("zone_id"), F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("line_count"))
    )


# ---- SQL fragments ------------------------------------------------------------------------------


def sql_bucket(ts: str) -> str:
    return f"""(CASE WHEN dayofweek({ts}) IN (0, 6) THEN 'weekend_' ELSE 'weekday_' END ||
      CASE WHEN hour({ts}) BETWEEN 6 AND 9 THEN 'am_peak' WHEN hour({ts}) BETWEEN 10 AND 15 THEN 'midday'
           WHEN hour({ts}) BETWEEN 16 AND 19 THEN 'pm_peak' WHEN hour({ts}) BETWEEN 20 AND 23 THEN 'evening'
           ELSE 'overnight' END)"""


SQL_ACTIVITY = f"""act AS (SELECT event_id, ts, user_id, event_type, value, CAST(user_id % 25 AS INTEGER) AS zone_id,
  CAST(ts AS DATE) AS date, CAST(hour(ts) AS BIGINT) AS hour, {sql_bucket('ts')} AS temporal_bucket,
  CASE WHEN CAST(ts AS DATE) >= DATE '{CUTOFF}' THEN 'post_cp' ELSE 'pre_cp' END AS period FROM events)"""

_KEY = "zone_id, date, temporal_bucket"
SQL_LAYERS = f"""
trips AS (SELECT {_KEY}, sum(value) AS trip_value, count(*) AS trip_count FROM act WHERE event_type = 'purchase' GROUP BY ALL),
rides AS (SELECT {_KEY}, sum(value) AS ridership, count(DISTINCT user_id) AS riders, count(*) AS ride_count FROM act WHERE event_type = 'click' GROUP BY ALL),
speeds AS (SELECT {_KEY}, avg(value) AS avg_speed, coalesce(stddev_samp(value), 0) AS speed_std, count(*) AS speed_count FROM act WHERE event_type = 'view' GROUP BY ALL),
traffic AS (SELECT {_KEY}, sum(value) AS traffic_volume, count(*) AS traffic_count FROM act WHERE event_type = 'signup' AND value > 20 GROUP BY ALL)"""

SQL_SPINE = f"""
zones AS (SELECT zone_id FROM trips UNION SELECT zone_id FROM rides UNION SELECT zone_id FROM speeds UNION SELECT zone_id FROM traffic),
days AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events), (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY)) AS DATE) AS date),
parts AS (SELECT unnest(['overnight', 'am_peak', 'midday', 'pm_peak', 'evening']) AS part),
spine AS (SELECT zone_id, date, CASE WHEN dayofweek(date) IN (0, 6) THEN 'weekend_' ELSE 'weekday_' END || part AS temporal_bucket,
  CASE WHEN date >= DATE '{CUTOFF}' THEN 'post_cp' ELSE 'pre_cp' END AS period FROM zones, days, parts)"""

SQL_PANEL = f"""{SQL_ACTIVITY}, {SQL_LAYERS}, {SQL_SPINE},
panel AS (SELECT s.zone_id, s.date, s.temporal_bucket, s.period,
  coalesce(trip_value, 0) AS trip_value, coalesce(trip_count, 0) AS trip_count,
  CASE WHEN s.zone_id IN (SELECT zone_id FROM rides) THEN coalesce(ridership, 0) ELSE ridership END AS ridership,
  riders, coalesce(ride_count, 0) AS ride_count, avg_speed, speed_std, speed_count, traffic_volume, traffic_count
  FROM spine s LEFT JOIN trips USING ({_KEY}) LEFT JOIN rides USING ({_KEY})
  LEFT JOIN speeds USING ({_KEY}) LEFT JOIN traffic USING ({_KEY}))"""

SQL_NATION = """nation_daily AS (SELECT s_nationkey AS zone_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS quantity,
  count(*) AS line_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def q6(expr: str, name: str | None = None) -> str:
    return f"round({expr} + 1e-9, 6) + 0.0 AS {name or expr}"


def isos(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name}"
