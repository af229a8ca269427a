"""Window, history and deviation feature queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import grain_start, policy_period
from ..operators import windows as Wn
from .base import SQL_NATION, SQL_PANEL, activity, dense_panel, nation_series, q6, rounded, table
from .panel import KEY_SQL, daily_events
from .registry import Family

FAMILY = Family()
query = FAMILY.query

SERIES_W = "PARTITION BY zone_id, temporal_bucket ORDER BY date"
BASE_W = "PARTITION BY zone_id, temporal_bucket, period"


def _z(m: str) -> str:
    return f"""CASE WHEN count({m}) OVER ({BASE_W}) >= 8 AND stddev_samp({m}) OVER ({BASE_W}) > 1e-6
      THEN ({m} - avg({m}) OVER ({BASE_W})) / stddev_samp({m}) OVER ({BASE_W}) END"""


@query(
    "O-87", "O-27", "O-28", "O-29", "O-46", "O-51",
    sql=f"""WITH {SQL_PANEL}, z AS (SELECT zone_id, date, temporal_bucket, period, trip_count, ridership, {_z('trip_count')} AS tz, {_z('ridership')} AS rz FROM panel)
      SELECT {KEY_SQL}, period, n_name AS zone, r_name AS borough, trip_count, {q6('ridership')}, {q6('tz', 'trip_count_deviation_z')}, {q6('rz', 'ridership_deviation_z')},
      {q6('abs(tz)', 'trip_count_deviation_abs_z')}, {q6('abs(rz)', 'ridership_deviation_abs_z')}
      FROM z JOIN nation ON zone_id = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def daily_panel_deviation(spark, d):
    from ..operators.panel import lookup_join

    panel = dense_panel(spark, d).select("zone_id", "date", "temporal_bucket", "period", "trip_count", "ridership")
    dims = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dims = dims.select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("zone"), F.col("r_name").alias("borough"))
    out = Wn.deviation_zscores(panel, ["trip_count", "ridership"], min_rows=8)
    return rounded(lookup_join(out, dims, ["zone_id"], "inner"))


@query(
    "O-78", "O-79", "O-81",
    sql=f"""WITH {SQL_PANEL}, h AS (SELECT zone_id, date, temporal_bucket, trip_count, avg_speed,
        lag(trip_count) OVER s AS l1, lag(trip_count, 7) OVER s AS l7, avg(trip_count) OVER w AS rm, CASE WHEN count(trip_count) OVER w >= 2 THEN stddev_samp(trip_count) OVER w END AS rs,
        lag(avg_speed) OVER s AS v1, lag(avg_speed, 7) OVER s AS v7, avg(avg_speed) OVER w AS vm, CASE WHEN count(avg_speed) OVER w >= 2 THEN stddev_samp(avg_speed) OVER w END AS vs
        FROM panel WINDOW s AS ({SERIES_W}), w AS ({SERIES_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
      SELECT {KEY_SQL}, l1::DOUBLE AS trip_count_lag_1, l7::DOUBLE AS trip_count_lag_7, {q6('rm', 'trip_count_rolling_mean_7')}, {q6('rs', 'trip_count_rolling_std_7')},
        (trip_count - l1)::DOUBLE AS trip_count_abs_change, {q6('(trip_count - l1) / nullif(l1, 0)', 'trip_count_pct_change')},
        {q6('v1', 'avg_speed_lag_1')}, {q6('v7', 'avg_speed_lag_7')}, {q6('vm', 'avg_speed_rolling_mean_7')}, {q6('vs', 'avg_speed_rolling_std_7')},
        {q6('avg_speed - v1', 'avg_speed_abs_change')}, {q6('(avg_speed - v1) / nullif(v1, 0)', 'avg_speed_pct_change')} FROM h""",
)
def same_bucket_history(spark, d):
    panel = dense_panel(spark, d).select("zone_id", "date", "temporal_bucket", "trip_count", "avg_speed")
    out = Wn.history_features(panel, ["trip_count", "avg_speed"], lags=(1, 7))
    return rounded(out.drop("trip_count", "avg_speed"), ["trip_count_lag_1", "trip_count_lag_7", "trip_count_abs_change"])


@query(
    "O-80",
    sql=f"""WITH RECURSIVE {SQL_PANEL}, n AS (SELECT zone_id, temporal_bucket, date, trip_count::DOUBLE AS a, avg_speed AS b,
        row_number() OVER ({SERIES_W}) AS i FROM panel),
      r AS (SELECT zone_id, temporal_bucket, date, i, a AS ya, b AS yb, 1.0::DOUBLE AS wb FROM n WHERE i = 1
        UNION ALL SELECT n.zone_id, n.temporal_bucket, n.date, n.i, 0.75 * r.ya + 0.25 * n.a,
          CASE WHEN n.b IS NULL THEN r.yb WHEN r.yb IS NULL THEN n.b ELSE (r.wb * 0.75 * r.yb + 0.25 * n.b) / (r.wb * 0.75 + 0.25) END,
          CASE WHEN n.b IS NULL AND r.yb IS NOT NULL THEN r.wb * 0.75 ELSE 1.0 END
        FROM r JOIN n ON n.zone_id = r.zone_id AND n.temporal_bucket = r.temporal_bucket AND n.i = r.i + 1)
      SELECT {KEY_SQL}, {q6('ya', 'trip_count_ema')}, {q6('yb', 'avg_speed_ema')} FROM r""",
)
def exponential_means(spark, d):
    panel = dense_panel(spark, d).select("zone_id", "date", "temporal_bucket", "trip_count", "avg_speed")
    return rounded(Wn.ema(panel, ["trip_count", "avg_speed"], span=7).drop("trip_count", "avg_speed"))


GAPPED_SQL = """d AS (SELECT o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) / 1e6 AS total, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
  s AS (SELECT DISTINCT o_orderpriority AS priority, unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 DAY))::DATE AS date FROM orders),
  p AS (SELECT priority, date, CASE WHEN NOT date BETWEEN DATE '1996-03-01' AND DATE '1996-12-31' THEN total END AS total, n, row_number() OVER (PARTITION BY priority ORDER BY date) AS i FROM s LEFT JOIN d USING (priority, date))"""


def _ema_step(x: str) -> str:
    """One step of the recursion for the column ``x`` of the next row, with its mean y_x and weight w_x."""
    old = f"(r.w_{x} * 0.9)"
    return f"""CASE WHEN p.{x} IS NULL THEN r.y_{x} WHEN r.y_{x} IS NULL THEN p.{x} ELSE ({old} * r.y_{x} + 0.1 * p.{x}) / ({old} + 0.1) END,
      CASE WHEN p.{x} IS NULL AND r.y_{x} IS NOT NULL THEN {old} ELSE 1.0 END"""


@query(
    "O-80",
    sql=f"""WITH RECURSIVE {GAPPED_SQL}, r AS (SELECT priority, date, i, total AS y_total, 1.0::DOUBLE AS w_total, n AS y_n, 1.0::DOUBLE AS w_n FROM p WHERE i = 1
        UNION ALL SELECT p.priority, p.date, p.i, {_ema_step('total')}, {_ema_step('n')} FROM r JOIN p ON p.priority = r.priority AND p.i = r.i + 1)
      SELECT priority, strftime(date, '%Y-%m-%d') AS date, {q6('y_total', 'total_ema')}, {q6('y_n', 'n_ema')} FROM r""",
)
def gapped_exponential_means(spark, d):
    # Order days by priority, with days that have no order and 306 days of which the totals are missing.
    days = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("date")).agg(
        (F.sum("o_totalprice") / 1e6).alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    spine = days.select("priority").distinct().select("priority", F.explode(F.expr("sequence(date '1995-01-01', date '2001-08-01')")).alias("date"))
    panel = spine.join(days, ["priority", "date"], "left").withColumn("total", F.when(~F.col("date").between("1996-03-01", "1996-12-31"), F.col("total")))
    return rounded(Wn.ema(panel, ["total", "n"], alpha=0.1, series=["priority"]).drop("total", "n"))


@query(
    "O-82",
    sql=f"""WITH {SQL_PANEL}, m AS (SELECT zone_id, date, temporal_bucket, avg(CASE WHEN period = 'pre_cp' THEN trip_count END) OVER w AS a,
      avg(CASE WHEN period = 'post_cp' THEN trip_count END) OVER w AS b FROM panel WINDOW w AS (PARTITION BY zone_id, temporal_bucket))
      SELECT {KEY_SQL}, {q6('a', 'trip_count_pre_mean')}, {q6('b', 'trip_count_post_mean')}, {q6('b - a', 'trip_count_delta')}, {q6('(b - a) / nullif(a, 0)', 'trip_count_pct_delta')} FROM m""",
)
def before_after_profile(spark, d):
    panel = dense_panel(spark, d).select("zone_id", "date", "temporal_bucket", "period", "trip_count")
    return rounded(Wn.period_profile(panel, ["trip_count"]).drop("period", "trip_count"))


@query(
    "O-83",
    sql=f"""WITH {SQL_PANEL}, o AS (SELECT zone_id, date, temporal_bucket, traffic_volume, lag(traffic_volume) OVER ({SERIES_W}) AS p, lag(date) OVER ({SERIES_W}) AS pd
        FROM panel WHERE traffic_volume IS NOT NULL)
      SELECT s.zone_id::BIGINT AS zone_id, strftime(s.date, '%Y-%m-%d') AS date, s.temporal_bucket, {q6('p', 'traffic_volume_previous')},
        {q6('o.traffic_volume - p', 'traffic_volume_change')}, {q6('(o.traffic_volume - p) / nullif(p, 0)', 'traffic_volume_pct_change')},
        date_diff('day', pd, o.date)::DOUBLE AS traffic_volume_days_since FROM panel s LEFT JOIN o USING (zone_id, date, temporal_bucket)""",
)
def sparse_traffic_history(spark, d):
    panel = dense_panel(spark, d).select("zone_id", "date", "temporal_bucket", "traffic_volume")
    return rounded(Wn.sparse_observed_lag(panel, "traffic_volume").drop("traffic_volume"), ["traffic_volume_days_since"])


@query(
    "O-84", "O-85", "O-43",
    sql=f"""WITH {SQL_PANEL}, m AS (SELECT avg(trip_count) AS ma, stddev_samp(trip_count) AS sa, avg(ridership) AS mb, stddev_samp(ridership) AS sb FROM panel),
      z AS (SELECT zone_id, date, temporal_bucket, (trip_count - ma) / sa AS a, (ridership - mb) / sb AS b, ln(1 + trip_value) - ln(1 + ridership) AS r FROM panel, m)
      SELECT {KEY_SQL}, {q6('a', 'trip_count_z')}, {q6('b', 'ridership_z')}, {q6('a * b', 'trip_x_ride')}, {q6('a - b', 'trip_minus_ride')}, {q6('r', 'trip_ride_log_ratio')} FROM z""",
)
def interaction_features(spark, d):
    panel = dense_panel(spark, d).select("zone_id", "date", "temporal_bucket", "trip_count", "trip_value", "ridership")
    z = Wn.global_zscores(panel, ["trip_count", "ridership"])
    out = Wn.interaction_features(
        z,
        {"trip_x_ride": ("trip_count_z", "ridership_z")},
        {"trip_ride_log_ratio": ("trip_value", "ridership")},
        {"trip_minus_ride": ("trip_count_z", "ridership_z")},
    )
    return rounded(out.drop("trip_count", "trip_value", "ridership"))


@query(
    "O-86",
    sql=f"""WITH {SQL_PANEL}, m AS (SELECT zone_id, temporal_bucket, period, unnest(['trip_count', 'avg_speed']) AS metric, unnest([trip_count::DOUBLE, avg_speed]) AS v FROM panel)
      SELECT zone_id::BIGINT AS zone_id, temporal_bucket, period, metric, count(v) AS n, {q6('avg(v)', 'mean_value')}, {q6('stddev_samp(v)', 'std_value')}, {q6('min(v)', 'min_value')},
      {q6('median(v)', 'median_value')}, {q6('max(v)', 'max_value')}, count(v) >= 10 AS ready FROM m GROUP BY ALL""",
)
def baseline_groups(spark, d):
    return rounded(Wn.group_baseline(dense_panel(spark, d), ["trip_count", "avg_speed"]))


@query(
    "O-88",
    sql=f"""WITH {SQL_PANEL} SELECT {KEY_SQL}, {q6(f'(rank() OVER ({BASE_W} ORDER BY trip_count) + (count(*) OVER ({BASE_W}, trip_count) - 1) / 2.0) / count(*) OVER ({BASE_W})', 'trip_count_percentile_rank')},
      CASE WHEN avg_speed IS NOT NULL THEN {q6(f'(rank() OVER ({BASE_W} ORDER BY round(avg_speed, 6) ASC NULLS LAST) + (count(avg_speed) OVER ({BASE_W}, round(avg_speed, 6)) - 1) / 2.0) / count(avg_speed) OVER ({BASE_W})', 'x').replace(' AS x', '')} END AS avg_speed_percentile_rank FROM panel""",
)
def percentile_rank_features(spark, d):
    panel = dense_panel(spark, d).select("zone_id", "date", "temporal_bucket", "period", "trip_count", F.round("avg_speed", 6).alias("avg_speed"))
    return rounded(Wn.percentile_ranks(panel, ["trip_count", "avg_speed"]).drop("period", "trip_count", "avg_speed"))


@query(
    "O-89",
    sql=f"""WITH {SQL_NATION}, r AS (SELECT zone_id, date, quantity - avg(quantity) OVER (PARTITION BY zone_id, month(date)) AS r FROM nation_daily)
      SELECT zone_id::BIGINT AS zone_id, strftime(date, '%Y-%m-%d') AS date, {q6('r', 'quantity_residual')}, {q6('abs(r)', 'quantity_residual_abs')},
      {q6('r / stddev_samp(r) OVER (PARTITION BY zone_id)', 'quantity_residual_zscore')} FROM r""",
)
def monthly_residuals(spark, d):
    s = nation_series(spark, d).withColumn("month", F.month("date"))
    return rounded(Wn.monthly_residuals(s, ["quantity"], ["zone_id"]).drop("month", "quantity", "line_count"))


@query(
    "O-90",
    sql=f"""WITH {SQL_NATION}, s AS (SELECT zone_id, date, quantity, avg(quantity) OVER a AS m7, count(*) OVER a AS c7, avg(quantity) OVER b AS m30, count(*) OVER b AS c30 FROM nation_daily
      WINDOW a AS (PARTITION BY zone_id ORDER BY date ROWS 6 PRECEDING), b AS (PARTITION BY zone_id ORDER BY date ROWS 29 PRECEDING))
      SELECT zone_id::BIGINT AS zone_id, strftime(date, '%Y-%m-%d') AS date, {q6('quantity')}, {q6('CASE WHEN c7 >= 3 THEN m7 END', 'quantity_mean_7')}, {q6('CASE WHEN c30 >= 10 THEN m30 END', 'quantity_mean_30')} FROM s""",
)
def smoothed_nation_days(spark, d):
    return rounded(Wn.smoothed_daily(nation_series(spark, d).drop("line_count"), ["quantity"], {7: 3, 30: 10}, by=["zone_id"]))


@query(
    "O-93",
    sql=f"""WITH w AS (SELECT date_trunc('week', l_shipdate) AS wk, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS b FROM lineitem GROUP BY 1),
      n AS (SELECT a, b, row_number() OVER (ORDER BY wk) AS i FROM w WHERE a IS NOT NULL AND b IS NOT NULL), lags AS (SELECT unnest(generate_series(-8, 8)) AS lag)
      SELECT lag, count(*) AS n_periods, {q6('corr(x.a, y.b)', 'correlation')} FROM lags JOIN n x ON true JOIN n y ON y.i = x.i + lag GROUP BY lag""",
)
def weekly_cross_correlation(spark, d):
    l = table(spark, d, "lineitem").withColumn("week", grain_start(F.to_date("l_shipdate"), "weekly"))
    qty = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    return rounded(Wn.cross_correlation(l.groupBy("week").agg(qty("A").alias("a"), qty("R").alias("b")), "a", "b", "week"))


@query(
    "O-94",
    sql="""SELECT event_type, user_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank FROM
      (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 5""",
)
def top_users_per_service(spark, d):
    n = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(Wn.top_k(n, 5, [F.desc("n"), F.asc("user_id")], ["event_type"]))


@query("O-94", sql="SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) AS rank FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, o_custkey LIMIT 10")
def top_customers(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(Wn.top_k(n, 10, [F.desc("n"), F.asc("o_custkey")]))
