"""Calendar, panel construction, join and aggregation queries."""

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import labels as L
from ..operators import panel as P
from ..operators import quality as Q
from ..operators import windows as Wn
from .base import (
    CUTOFF, SQL_ACTIVITY, SQL_LAYERS, SQL_PANEL, SQL_SPINE, activity, dense_panel, joined_panel, layers, q6, study_days,
    rounded, sql_bucket, table,
)
from .registry import Family

FAMILY = Family()
query = FAMILY.query

KEY_SQL = "zone_id::BIGINT AS zone_id, strftime(date, '%Y-%m-%d') AS date, temporal_bucket"


@query(
    "O-27", "O-28", "O-29", "O-30",
    sql=f"""SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, year(ts) AS year, month(ts) AS month, dayname(ts) AS day_of_week,
      hour(ts) AS hour, {sql_bucket('ts')} AS temporal_bucket, CASE WHEN CAST(ts AS DATE) >= DATE '{CUTOFF}' THEN 'post_cp' ELSE 'pre_cp' END AS period,
      CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_kind,
      regexp_replace({sql_bucket('ts')}, '^(weekday|weekend)_', '') AS daypart FROM events""",
)
def calendar_columns(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    out = C.calendar_fields(e, "ts").withColumn("temporal_bucket", C.temporal_bucket(F.col("ts")))
    out = out.withColumns(
        {
            "period": C.policy_period(F.col("date"), CUTOFF),
            "day_kind": C.bucket_day_kind(F.col("temporal_bucket")),
            "daypart": C.bucket_daypart(F.col("temporal_bucket")),
        }
    )
    return rounded(out.drop("ts"))


@query(
    "O-31", "O-32",
    sql="""SELECT event_id, strftime(l, '%Y-%m-%d %H:%M:%S') AS local_time, hour(l) AS hour, CASE WHEN hour(l) >= 6 AND hour(l) < 12 THEN 'morning'
      WHEN hour(l) >= 12 AND hour(l) < 17 THEN 'afternoon' WHEN hour(l) >= 17 AND hour(l) < 22 THEN 'evening' ELSE 'overnight' END AS daypart
      FROM (SELECT event_id, (to_timestamp(epoch(ts)::BIGINT + event_id * 3600) AT TIME ZONE 'America/New_York') AS l FROM
        (SELECT event_id, date_trunc('second', ts) AS ts FROM events))""",
)
def local_discussion_time(spark, d):
    # Hourly steps by id spread the stamps over both sides of the daylight-saving changes.
    e = table(spark, d, "events")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.date_trunc("second", "ts").cast("timestamp_ntz"))
    local = C.epoch_to_local(seconds + F.col("event_id") * 3600)
    return rounded(
        e.select(
            "event_id",
            F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local_time"),
            F.hour(local).alias("hour"),
            C.wrap_daypart(F.hour(local)).alias("daypart"),
        )
    )


@query(
    "O-33",
    sql="""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_start, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week_start,
      strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start FROM orders""",
)
def period_starts(spark, d):
    day = F.to_date("o_orderdate")
    names = {"daily": "day_start", "weekly": "week_start", "monthly": "month_start"}
    return rounded(table(spark, d, "orders").select("o_orderkey", *[C.grain_start(day, g).alias(n) for g, n in names.items()]))


TRIP_SQL = """trip AS (SELECT l_returnflag AS service, l_suppkey % 25 AS pickup_zone, l_partkey % 25 AS dropoff_zone,
  l_shipdate + INTERVAL 1 HOUR * CAST(l_quantity % 24 AS INTEGER) AS pickup_ts, l_quantity / 5 AS distance, l_extendedprice / 20 AS seconds FROM lineitem)"""


def trips(spark, d):
    l = table(spark, d, "lineitem")
    mapping = {
        "pickup_zone": F.col("l_suppkey") % 25,
        "dropoff_zone": F.col("l_partkey") % 25,
        "pickup_ts": F.timestamp_add("HOUR", (F.col("l_quantity") % 24).cast("int"), F.col("l_shipdate").cast("timestamp_ntz")),
        "distance": F.col("l_quantity") / 5,
        "seconds": F.col("l_extendedprice") / 20,
    }
    services = [r for r in ("A", "N", "R")]
    from ..sources.staging import union_sources

    return union_sources([P.standard_trips(l.where(F.col("l_returnflag") == s), mapping, s) for s in services])


VALID = "seconds BETWEEN 60 AND 86400 AND distance BETWEEN 0 AND 100 AND distance / (seconds / 3600.0) <= 40"


@query("O-34", sql=f"WITH {TRIP_SQL} SELECT service, count(*) AS kept, {q6('sum(distance)', 'distance')} FROM trip WHERE {VALID} GROUP BY 1")
def plausible_trips(spark, d):
    t = trips(spark, d).where(P.valid_trips(F.col("distance"), F.col("seconds"), max_speed=40))
    return rounded(t.groupBy("service").agg(F.count(F.lit(1)).alias("kept"), F.sum("distance").alias("distance")))


OD_SQL = f"""{TRIP_SQL}, od AS (SELECT service, pickup_zone, dropoff_zone, CAST(pickup_ts AS DATE) AS date, hour(pickup_ts) AS hour,
  {sql_bucket('pickup_ts')} AS temporal_bucket, CASE WHEN CAST(pickup_ts AS DATE) >= DATE '1998-06-01' THEN 'post_cp' ELSE 'pre_cp' END AS period,
  count(*) AS trip_count, avg(distance) AS avg_distance, avg(seconds) AS avg_seconds FROM trip WHERE {VALID} GROUP BY ALL)"""


def od_states(spark, d):
    t = trips(spark, d).where(P.valid_trips(F.col("distance"), F.col("seconds"), max_speed=40))
    return P.aggregate_od(t, "1998-06-01")


@query(
    "O-58",
    sql=f"""WITH {OD_SQL} SELECT service, pickup_zone, dropoff_zone, strftime(date, '%Y-%m-%d') AS date, hour, temporal_bucket, period,
      trip_count, {q6('avg_distance')}, {q6('avg_seconds')} FROM od""",
)
def origin_destination_states(spark, d):
    return rounded(od_states(spark, d))


STATS_SQL = f"""{OD_SQL}, sp AS (SELECT *, CASE WHEN avg_seconds > 0 THEN avg_distance / (avg_seconds / 3600.0) END AS speed FROM od)"""


@query(
    "O-61",
    sql=f"""WITH {STATS_SQL} SELECT pickup_zone, temporal_bucket, CAST(sum(trip_count) AS BIGINT) AS trip_count, {q6('sum(avg_distance * trip_count) / sum(trip_count)', 'distance_mean')},
      round(sqrt(greatest(sum(avg_distance * avg_distance * trip_count) / sum(trip_count) - power(sum(avg_distance * trip_count) / sum(trip_count), 2), 0)), 4) AS distance_std,
      {q6('sum(speed * trip_count) / sum(trip_count)', 'speed_mean')},
      round(sqrt(greatest(sum(speed * speed * trip_count) / sum(trip_count) - power(sum(speed * trip_count) / sum(trip_count), 2), 0)), 4) AS speed_std
      FROM sp GROUP BY ALL""",
)
def weighted_trip_moments(spark, d):
    # Monthly chunks first, merged afterwards, as late months would be.
    od = od_states(spark, d).withColumns(
        {
            "month": F.month("date"),
            "speed": F.when(F.col("avg_seconds") > 0, F.col("avg_distance") / (F.col("avg_seconds") / 3600.0)),
            "distance": F.col("avg_distance"),
        }
    )
    key = ["pickup_zone", "temporal_bucket"]
    chunks = P.sufficient_stats(od, [*key, "month"], ["distance", "speed"], "trip_count")
    out = P.finalize_stats(P.merge_stats(chunks, key), ["distance", "speed"])
    out = out.select(*key, F.col("weight_sum").alias("trip_count"), "distance_mean", "speed_mean",
                     F.round("distance_std", 4).alias("distance_std"), F.round("speed_std", 4).alias("speed_std"))
    return rounded(out)


@query(
    "O-61",
    sql=f"""WITH {OD_SQL} SELECT pickup_zone, CAST(sum(CASE WHEN service = 'A' THEN trip_count ELSE 0 END) AS BIGINT) AS "A_trip_count",
      CAST(sum(CASE WHEN service = 'N' THEN trip_count ELSE 0 END) AS BIGINT) AS "N_trip_count",
      CAST(sum(CASE WHEN service = 'R' THEN trip_count ELSE 0 END) AS BIGINT) AS "R_trip_count", CAST(sum(trip_count) AS BIGINT) AS pooled_trip_count
      FROM od GROUP BY 1""",
)
def service_trip_columns(spark, d):
    return P.service_columns(od_states(spark, d), ["pickup_zone"], ["A", "N", "R"], "trip_count")


@query("O-62", sql=f"WITH {OD_SQL} SELECT pickup_zone, temporal_bucket, count(DISTINCT dropoff_zone) AS destination_count FROM od GROUP BY ALL")
def destination_diversity(spark, d):
    return P.recompute_distinct(od_states(spark, d), ["pickup_zone", "temporal_bucket"], "dropoff_zone", "destination_count")


@query(
    "O-35",
    sql="""SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey IN (3, 8) THEN 'cbd' WHEN n_nationkey IN (2, 4, 7, 9) THEN 'gateway_or_adjacent'
      ELSE 'outside' END AS policy_geography FROM nation""",
)
def policy_geography(spark, d):
    n = table(spark, d, "nation")
    flag = lambda ids: F.when(F.col("n_nationkey").isin(ids), 1)
    return rounded(n.select("n_nationkey", L.policy_geography(flag([3, 8]), flag([2, 4, 7, 9])).alias("policy_geography")))


@query(
    "O-60", "O-61", "O-46",
    sql=f"""WITH {SQL_PANEL} SELECT {KEY_SQL}, period, {q6('trip_value')}, trip_count, {q6('ridership')}, riders::DOUBLE AS riders, ride_count,
      {q6('avg_speed')}, {q6('speed_std')}, speed_count::DOUBLE AS speed_count, {q6('traffic_volume')}, traffic_count::DOUBLE AS traffic_count FROM panel""",
)
def dense_panel_rows(spark, d):
    return rounded(dense_panel(spark, d), ["riders", "speed_count", "traffic_count"])


@query(
    "O-46", "O-55",
    sql=f"""WITH {SQL_PANEL} SELECT {KEY_SQL}, period, {q6('trip_value')}, trip_count, {q6('ridership')}, riders::DOUBLE AS riders,
      {q6('avg_speed')}, {q6('traffic_volume')} FROM panel""",
)
def joined_layer_panel(spark, d):
    cols = ["zone_id", "date", "temporal_bucket", "period", "trip_value", "trip_count", "ridership", "riders", "avg_speed", "traffic_volume"]
    return rounded(joined_panel(spark, d).select(*cols), ["riders"])


@query(
    "O-51", "O-55",
    sql=f"WITH {SQL_ACTIVITY}, {SQL_LAYERS}, {SQL_SPINE} SELECT zone_id::BIGINT AS zone_id, strftime(date, '%Y-%m-%d') AS date, temporal_bucket FROM spine",
)
def observed_spine(spark, d):
    zones = P.observed_values(list(layers(activity(spark, d)).values()), ["zone_id"])
    return rounded(P.dense_spine(zones, *study_days(spark, d)))


@query(
    "O-47",
    sql=f"""WITH {SQL_PANEL} SELECT {KEY_SQL}, trip_count, n_name, {q6('trip_count * 1.0 / z.total', 'zone_share')} FROM panel
      JOIN nation ON zone_id = n_nationkey JOIN (SELECT zone_id, sum(trip_count) AS total FROM panel GROUP BY 1) z USING (zone_id)""",
)
def checked_zone_join(spark, d):
    panel = dense_panel(spark, d).select("zone_id", "date", "temporal_bucket", "trip_count")
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone_id"), "n_name")
    totals = panel.groupBy("zone_id").agg(F.sum("trip_count").alias("total"))
    out = P.validated_join(P.validated_join(panel, names, ["zone_id"], "inner"), totals, ["zone_id"], "inner")
    return rounded(out.withColumn("zone_share", F.col("trip_count") / F.col("total")).drop("total"))


@query(
    "O-48",
    sql=f"""SELECT n_name, r_name, count(*) AS row_count, {q6('sum(value)', 'total_value')} FROM events
      JOIN nation ON user_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def named_zone_totals(spark, d):
    dims = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dims = dims.select(F.col("n_nationkey").alias("zone_id"), "n_name", "r_name")
    totals = activity(spark, d).groupBy("zone_id").agg(F.count(F.lit(1)).alias("row_count"), F.sum("value").alias("total_value"))
    return rounded(P.lookup_join(totals, dims, ["zone_id"], "inner").drop("zone_id"))


@query("O-49", sql="SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE regexp_matches(text, '(?i)\\bnicht\\b'))")
def anchored_thread_rows(spark, d):
    c = table(spark, d, "conversations")
    hits = c.where(F.col("text").rlike(r"(?i)\bnicht\b")).select("conv_id")
    return P.anchored_rows(c.select("conv_id", "turn"), hits, "conv_id")


@query("O-50", sql="SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")
def unlabelled_pool(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("h"))
    held = table(spark, d, "labels").select("doc_id")
    held_text = docs.join(held, "doc_id", "left_semi").select("h")
    return P.without_keys(docs, (held, "doc_id"), (held_text, "h")).drop("h")


@query(
    "O-52",
    sql=f"""WITH prof AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, dayname(o_orderdate) AS dow, o_orderpriority AS pr,
        avg(o_totalprice) AS speed, count(*) AS trips FROM orders GROUP BY ALL),
      cal AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS date)
      SELECT strftime(date, '%Y-%m-%d') AS date, {q6('avg(speed)', 'avg_speed')}, {q6('coalesce(stddev_samp(speed), 0)', 'speed_std')},
        CAST(sum(trips) AS BIGINT) AS trips, count(*) AS observation_count FROM prof JOIN cal
        ON year(date) = prof.year AND month(date) = prof.month AND dayname(date) = prof.dow GROUP BY date""",
)
def expanded_profiles(spark, d):
    o = table(spark, d, "orders")
    profile = o.groupBy(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.date_format("o_orderdate", "EEEE").alias("day_of_week"), "o_orderpriority",
    ).agg(F.avg("o_totalprice").alias("speed"), F.count(F.lit(1)).alias("n"))
    days = P.profile_to_calendar(profile, "1995-01-01", "2001-12-31")
    return rounded(P.harmonize(days, {"trips": "n"}, {"avg_speed": "speed"}, {"speed_std": "speed"}, key=["date"]))


@query(
    "O-53",
    sql="""SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey, n_nationkey::BIGINT AS canonical_id, false AS is_alias FROM nation
      UNION ALL SELECT 57, n_name, n_regionkey, 7, true FROM nation WHERE n_nationkey = 7
      UNION ALL SELECT 105, n_name, n_regionkey, 3, true FROM nation WHERE n_nationkey = 3
      UNION ALL SELECT 264, NULL, NULL, 264, true UNION ALL SELECT 265, NULL, NULL, 265, true""",
)
def zone_aliases(spark, d):
    return rounded(P.alias_dimension(table(spark, d, "nation"), "n_nationkey", {57: 7, 105: 3}, [264, 265]), ["n_regionkey"])


WINDOW_SQL = """daily AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n, avg(value) AS v FROM events GROUP BY 1),
  cut AS (SELECT quantile_cont(n, 0.9) AS c FROM daily),
  ev AS (SELECT date AS event_date FROM daily, cut WHERE n >= c),
  win AS (SELECT event_date, date_diff('day', event_date, date) AS relative_day, date, n, v FROM ev JOIN daily ON date BETWEEN event_date - 7 AND event_date + 7)"""


def daily_events(spark, d):
    return activity(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))


def event_windows(spark, d):
    daily = daily_events(spark, d)
    events = Wn.top_decile_days(daily, "n").select(F.col("date").alias("event_date"))
    return P.event_window_join(events, daily, 7)


@query("O-54", sql=f"WITH {WINDOW_SQL} SELECT strftime(event_date, '%Y-%m-%d') AS event_date, relative_day, strftime(date, '%Y-%m-%d') AS date, n, {q6('v')} FROM win")
def days_around_events(spark, d):
    return rounded(event_windows(spark, d))


@query(
    "O-92", "O-90",
    sql=f"""WITH {WINDOW_SQL} SELECT relative_day, count(*) AS n_days, {q6('avg(n)', 'n_mean')}, {q6('median(n)', 'n_median')},
      {q6('avg(v)', 'v_mean')}, {q6('median(v)', 'v_median')} FROM win GROUP BY 1""",
)
def event_day_profile(spark, d):
    return rounded(Wn.event_study(event_windows(spark, d), ["n", "v"]))


@query(
    "O-56",
    sql="""WITH a AS (SELECT DISTINCT user_id % 5 AS cohort, user_id FROM events WHERE event_type = 'purchase' AND value > 60),
      b AS (SELECT DISTINCT user_id % 5 AS cohort, user_id FROM events WHERE event_type = 'error' AND value > 60),
      f AS (SELECT cohort, (a.user_id IS NOT NULL)::INT AS x, (b.user_id IS NOT NULL)::INT AS y FROM a FULL JOIN b USING (cohort, user_id))
      SELECT cohort, CAST(sum(x) AS BIGINT) AS a_count, CAST(sum(y) AS BIGINT) AS b_count, CAST(sum(x * y) AS BIGINT) AS both_count, count(*) AS union_count,
      CAST(sum(x - x * y) AS BIGINT) AS only_a, CAST(sum(y - x * y) AS BIGINT) AS only_b, round(sum(x * y) / count(*), 6) AS jaccard FROM f GROUP BY 1""",
)
def user_set_overlap(spark, d):
    e = table(spark, d, "events").where("value > 60").withColumn("cohort", F.col("user_id") % 5)
    of = lambda kind: e.where(F.col("event_type") == kind)
    return rounded(P.set_overlap(of("purchase"), of("error"), ["user_id"], ["cohort"]))


@query(
    "O-59",
    sql=f"""SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS date, {q6('sum(l_quantity)', 'l_quantity')},
      arg_min(l_returnflag, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag)) AS l_returnflag,
      arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag)) AS l_partkey, count(*) AS observation_count
      FROM lineitem GROUP BY l_suppkey, l_shipdate""",
)
def collapsed_readings(spark, d):
    l = table(spark, d, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"]
    return rounded(P.collapse_duplicates(l, ["l_suppkey", "date"], "l_quantity", ["l_returnflag", "l_partkey"], order))


@query(
    "O-60",
    sql=f"""WITH {SQL_ACTIVITY} SELECT {KEY_SQL}, {q6('sum(value)', 'total')}, {q6('avg(value)', 'mean')}, {q6('coalesce(stddev_samp(value), 0)', 'std')},
      count(DISTINCT user_id) AS users, count(*) AS observation_count FROM act GROUP BY ALL""",
)
def harmonized_states(spark, d):
    return rounded(P.harmonize(activity(spark, d), {"total": "value"}, {"mean": "value"}, {"std": "value"}, {"users": "user_id"}))


@query(
    "O-64",
    sql=f"""WITH {SQL_ACTIVITY} SELECT zone_id::BIGINT AS zone_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS n_click,
      count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase FROM act GROUP BY 1""",
)
def pivoted_counts(spark, d):
    return rounded(P.pivot_counts(activity(spark, d), ["zone_id"], "event_type", ["click", "view", "purchase"]))


@query("O-65", sql="SELECT event_type, round(sum(value), 4) AS total_value, round(sum(value) / (SELECT sum(value) FROM events), 4) AS value_share FROM events GROUP BY 1")
def service_shares(spark, d):
    out = P.share_summary(table(spark, d, "events"), "event_type", "value")
    return out.withColumn("total_value", F.round("total_value", 4))


@query(
    "O-66",
    sql=f"""WITH {SQL_PANEL}, s AS (SELECT unnest(['speed', 'traffic']) AS service, unnest([speed_count, traffic_count])::DOUBLE AS w,
      unnest([avg_speed, traffic_volume / traffic_count]) AS m FROM panel)
      SELECT service, sum(w) AS weight_sum, {q6('sum(CASE WHEN m IS NOT NULL THEN w * m END) / sum(CASE WHEN m IS NOT NULL THEN w END)', 'weighted_mean')} FROM s GROUP BY 1""",
)
def stacked_service_means(spark, d):
    p = dense_panel(spark, d).withColumn("traffic_mean", F.try_divide("traffic_volume", "traffic_count"))
    return rounded(P.stacked_means(p, {"speed": "speed_count", "traffic": "traffic_count"}, {"speed": "avg_speed", "traffic": "traffic_mean"}))


@query(
    "O-77",
    sql=f"""WITH {SQL_ACTIVITY}, t AS (SELECT date, temporal_bucket, sum(value) AS total_volume, sum(CASE WHEN zone_id < 10 THEN value ELSE 0 END) AS connected_volume
      FROM act WHERE event_type = 'error' GROUP BY ALL) SELECT strftime(date, '%Y-%m-%d') AS date, temporal_bucket, {q6('total_volume')}, {q6('connected_volume')},
      {q6('total_volume - connected_volume', 'other_volume')}, round(connected_volume / total_volume, 3) AS connected_share FROM t""",
)
def crossing_context(spark, d):
    e = activity(spark, d).where("event_type = 'error'")
    return rounded(P.crossing_context(e, F.col("zone_id") < 10, "value"))


@query(
    "O-91",
    sql=f"""WITH {SQL_PANEL} SELECT period, count(*) AS row_count, {q6('avg(trip_count)', 'trip_count_mean')}, {q6('avg(avg_speed)', 'avg_speed_mean')} FROM panel GROUP BY 1""",
)
def before_after_means(spark, d):
    return rounded(Wn.period_means(dense_panel(spark, d), ["trip_count", "avg_speed"]))


@query("O-36",
    sql="""SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'text' WHEN page_id % 7 = 1 THEN 'image' WHEN page_id % 7 = 2 THEN 'video'
      WHEN regexp_matches(lower(url), '\\.(jpg|jpeg|png|gif|gifv)$') THEN 'image' WHEN regexp_matches(lower(url), 'i\\.redd\\.it|imgur\\.com') THEN 'image'
      WHEN regexp_matches(lower(url), 'v\\.redd\\.it|youtube\\.com|youtu\\.be') THEN 'video' WHEN url <> '' THEN 'link' ELSE 'text' END AS media FROM pages""")
def page_media(spark, d):
    from ..functions.text import media_kind

    p = table(spark, d, "pages")
    hint = F.when(F.col("page_id") % 7 == 1, F.lit("rich:Image"))
    return p.select("page_id", media_kind(F.col("page_id") % 11 == 0, hint, F.col("page_id") % 7 == 2, F.col("url")).alias("media"))
