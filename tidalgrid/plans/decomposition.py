"""Series decomposition and streaming queries."""

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import series as Se
from ..streaming.rollup import run_rollup, shared_folder
from .base import SQL_NATION, SQL_PANEL, dense_panel, nation_series, q6, rounded, table
from .panel import KEY_SQL
from .registry import Family

FAMILY = Family()
query = FAMILY.query


def weekly_bucket(spark, d):
    """Nation series with a weekday or weekend bucket, as same-bucket series."""
    s = nation_series(spark, d)
    kind = F.when(F.dayofweek("date").isin(1, 7), "weekend").otherwise("weekday")
    return s.withColumn("temporal_bucket", kind)


KEYS = ["zone_id", "temporal_bucket"]


def split(spark, d):
    period = F.when(F.col("temporal_bucket") == "weekday", 10).otherwise(8)
    return Se.seasonal_trend(weekly_bucket(spark, d), KEYS, "date", "quantity", period)


@query("O-125")
def seasonal_trend(spark, d):
    return split(spark, d)


@query("O-126")
def tuned_periods(spark, d):
    return Se.tune_period(weekly_bucket(spark, d), KEYS, "temporal_bucket", "date", "quantity", [6, 10, 14, 21])


WAVE_SQL = f"""{SQL_NATION}, s AS (SELECT zone_id, CASE WHEN dayofweek(date) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS temporal_bucket, date, quantity FROM nation_daily),
  c AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER p AS n, avg(quantity) OVER p AS m, stddev_samp(quantity) OVER p AS sd FROM s WINDOW w AS (PARTITION BY zone_id, temporal_bucket ORDER BY date), p AS (PARTITION BY zone_id, temporal_bucket)),
  k AS (SELECT zone_id, temporal_bucket, n, unnest(generate_series(1, n // 2)) AS f FROM (SELECT DISTINCT zone_id, temporal_bucket, n FROM c)),
  x AS (SELECT zone_id, temporal_bucket, c.n, f, sum((quantity - m) * cos(2 * pi() * ((f * t) % c.n) / c.n)) AS re, sum((quantity - m) * sin(2 * pi() * ((f * t) % c.n) / c.n)) AS im
    FROM c JOIN k USING (zone_id, temporal_bucket) GROUP BY ALL),
  pw AS (SELECT *, (re * re + im * im) / sum(re * re + im * im) OVER (PARTITION BY zone_id, temporal_bucket) AS share, row_number() OVER (PARTITION BY zone_id, temporal_bucket ORDER BY re * re + im * im DESC) AS rank FROM x)"""


@query("O-127", sql=f"""WITH {WAVE_SQL} SELECT zone_id::BIGINT AS zone_id, temporal_bucket, strftime(date, '%Y-%m-%d') AS date,
  CASE WHEN c.n >= 60 AND any_value(sd) > 0 THEN round(any_value(m) + sum(CASE WHEN 2 * f = c.n THEN 1 ELSE 2 END * (re * cos(2 * pi() * ((f * t) % c.n) / c.n) + im * sin(2 * pi() * ((f * t) % c.n) / c.n))) / c.n + 1e-9, 6) + 0.0 END AS quantity_fourier_top20
  FROM c JOIN pw USING (zone_id, temporal_bucket) WHERE rank <= 20 GROUP BY zone_id, temporal_bucket, date, c.n""")
def fourier_reconstruction(spark, d):
    return rounded(Se.fourier_reconstruction(weekly_bucket(spark, d), KEYS, "date", "quantity"))


@query("O-127")
def residual_fourier(spark, d):
    return Se.fourier_reconstruction(split(spark, d), KEYS, "date", "quantity_residual")


@query("O-128", sql=f"""WITH {WAVE_SQL} SELECT zone_id::BIGINT AS zone_id, temporal_bucket, rank, {q6('f / n', 'frequency')}, {q6('share', 'power_share')}, {q6('n / f', 'period_rows')},
  CASE WHEN n / f BETWEEN 18 AND 24 THEN 'roughly monthly' WHEN n / f BETWEEN 55 AND 75 THEN 'roughly quarterly' WHEN n / f BETWEEN 220 AND 290 THEN 'roughly annual' ELSE 'exploratory cycle' END AS period_label FROM pw WHERE rank <= 5""")
def dominant_periods(spark, d):
    return rounded(Se.dominant_periods(weekly_bucket(spark, d), KEYS, "date", "quantity"))


@query("O-129", sql=f"""WITH {SQL_PANEL} SELECT {KEY_SQL}, {q6('trip_value + 1', 'trip_up')}, {q6('ridership * 2', 'ride_twice')}, {q6('avg_speed / 2', 'half_speed')} FROM panel""")
def assembled_features(spark, d):
    p = dense_panel(spark, d)
    key = ["zone_id", "date", "temporal_bucket"]
    cells = [("trip_up", F.col("trip_value") + 1), ("ride_twice", F.col("ridership") * 2), ("half_speed", F.col("avg_speed") / 2)]
    long = p.select(*key, F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in cells]))).where("value IS NOT NULL")
    return rounded(Se.assemble_features(p.select(*key), long, key, [n for n, _ in cells]))


@query("O-95", sql="SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_rollup(spark, d):
    # Every event arrives twice; the stream must count it once.
    schema = "event_id bigint, ts timestamp_ntz, event_type string"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    twice = raw.select("event_id", F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp").alias("at"), "event_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    out = run_rollup(twice.drop("copy"), "event_id", "at", "event_type")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("window_start").cast("timestamp_ntz"))
    return out.select(F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query("O-95", sql="SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_late_patches(spark, d):
    # Patches with rows of all days, the first repeated at the end: nothing is too late.  The stream runs after
    # three of them and, from the same store, after the rest.
    folder, store = shared_folder(spark, "late"), shared_folder(spark, "late-store")
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_type")
    raw = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 16).parquet(folder)
    for parts in ((4, 3, 2), (1, 0, 4)):
        for part in parts:
            e.where(F.col("event_id") % 5 == part).write.mode("append").parquet(folder)
        out = run_rollup(raw().withColumn("at", F.to_timestamp("at")), "event_id", "at", "event_type", store=store)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")
