"""Spatial context, sampling, screening and matrix queries."""

from pyspark.sql import functions as F

from ..operators import matrix as Mx
from ..operators import sampling as Sm
from ..operators import screening as Sc
from ..operators import spatial as Sp
from ..operators import windows as Wn
from .base import SQL_PANEL, activity, dense_panel, q6, rounded, table
from .panel import KEY_SQL
from .registry import Family

FAMILY = Family()
query = FAMILY.query

# ---- spatial ------------------------------------------------------------------------------------

EDGE_SQL = """one AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
  UNION SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation), edges AS (SELECT a AS zone_id, b AS neighbor_id FROM one UNION SELECT b, a FROM one)"""


def edges(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    other = n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    inside = n.join(other, "n_regionkey").where("n_nationkey < b").select(F.col("n_nationkey").alias("a"), "b")
    ring = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 1) % 25).alias("b"))
    return Sp.symmetric_edges(inside.unionByName(ring), "a", "b")


@query("O-96", sql=f"""WITH {SQL_PANEL}, {EDGE_SQL}, c AS (SELECT e.zone_id, p.date, p.temporal_bucket, count(*) AS neighbor_count, avg(p.trip_count) AS t, avg(p.avg_speed) AS v
    FROM panel p JOIN edges e ON p.zone_id = e.neighbor_id GROUP BY ALL)
  SELECT zone_id::BIGINT AS zone_id, strftime(date, '%Y-%m-%d') AS date, temporal_bucket, coalesce(neighbor_count, 0) AS neighbor_count, {q6('t', 'connected_trip_count')}, {q6('v', 'connected_avg_speed')}
  FROM panel LEFT JOIN c USING (zone_id, date, temporal_bucket)""")
def neighbor_context(spark, d):
    p = dense_panel(spark, d).select("zone_id", "date", "temporal_bucket", "trip_count", "avg_speed")
    return rounded(Sp.neighbor_context(p, edges(spark, d), ["trip_count", "avg_speed"]).drop("trip_count", "avg_speed"))


@query("O-97", sql=f"""WITH {SQL_PANEL} SELECT {KEY_SQL}, {q6('avg(trip_count) OVER (PARTITION BY n_regionkey, date, temporal_bucket)', 'borough_trip_count')} FROM panel JOIN nation ON zone_id = n_nationkey""")
def borough_context(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_regionkey").alias("borough"))
    p = dense_panel(spark, d).select("zone_id", "date", "temporal_bucket", "trip_count").join(n, "zone_id")
    return rounded(Sp.group_context(p, "borough", ["trip_count"], "borough").drop("borough", "trip_count"))


@query("O-98", sql=f"""WITH {EDGE_SQL}, z AS (SELECT n_nationkey AS zone_id, (n_nationkey % 5)::DOUBLE AS x, (n_nationkey // 5)::DOUBLE AS y FROM nation)
  SELECT zone_id::BIGINT AS zone_id, (zone_id IN (3, 8))::BIGINT AS is_core, (zone_id NOT IN (3, 8) AND zone_id IN (SELECT zone_id FROM edges WHERE neighbor_id IN (3, 8)))::BIGINT AS is_core_adjacent,
    (zone_id IN (12, 17))::BIGINT AS is_gateway, (SELECT round(min(sqrt((z.x - c.x) ** 2 + (z.y - c.y) ** 2)) + 1e-9, 6) FROM z c WHERE c.zone_id IN (3, 8)) AS distance_to_set FROM z""")
def zone_flags(spark, d):
    z = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone_id"), (F.col("n_nationkey") % 5).cast("double").alias("x"), F.floor(F.col("n_nationkey") / 5).cast("double").alias("y"))
    out = Sp.distance_to_set(Sp.zone_flags(z, edges(spark, d), [3, 8], [12, 17]), F.col("zone_id").isin(3, 8))
    return rounded(out.drop("x", "y"))


@query("O-99", sql="""WITH p AS (SELECT c_custkey, (c_custkey * 37 % 500) / 100.0 + 0.003 AS x, (c_custkey * 91 % 500) / 100.0 + 0.004 AS y FROM customer),
  z AS (SELECT *, CASE WHEN abs(x - floor(x) - 0.5) + abs(y - floor(y) - 0.5) < 0.45 THEN (floor(y) * 5 + floor(x))::BIGINT END AS hit FROM p)
  SELECT c_custkey, coalesce(hit, CASE WHEN x > 4 AND y > 4 THEN 24 END)::DOUBLE AS zone_id, CASE WHEN hit IS NOT NULL THEN 'polygon' WHEN x > 4 AND y > 4 THEN 'rescue' END AS assignment FROM z""")
def points_to_zones(spark, d):
    # Every zone is a diamond inside its cell of a 5 x 5 grid.
    k = F.col("n_nationkey")
    cx, cy = k % 5 + 0.5, F.floor(k / 5) + 0.5
    corner = lambda dx, dy: F.struct((cx + dx).cast("double").alias("x"), (cy + dy).cast("double").alias("y"))
    zones = table(spark, d, "nation").select(k.alias("zone_id"), F.array(corner(0.45, 0), corner(0, 0.45), corner(-0.45, 0), corner(0, -0.45)).alias("ring"))
    c = F.col("c_custkey")
    points = table(spark, d, "customer").select("c_custkey", (c * 37 % 500 / 100.0 + 0.003).alias("x"), (c * 91 % 500 / 100.0 + 0.004).alias("y"))
    out = Sp.point_to_zone(points, zones, 0.6, "c_custkey", rescue=[((F.col("x") > 4) & (F.col("y") > 4), 24)])
    return rounded(out.drop("x", "y"), ["zone_id"])


# ---- sampling -----------------------------------------------------------------------------------

STRATA_SQL = """s AS (SELECT event_type, user_id % 3 AS g, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT sum(n) AS t FROM s),
  q0 AS (SELECT event_type, g, n, greatest(floor(n * 2500 / t), 1) AS q, n * 2500 / t - floor(n * 2500 / t) AS f FROM s, t),
  q AS (SELECT event_type, g, q + (row_number() OVER (ORDER BY f DESC, event_type, g) <= 2500 - sum(q) OVER ())::INT AS q FROM q0)"""


@query("O-100", sql=f"""WITH {STRATA_SQL}, r AS (SELECT event_id, event_type, user_id % 3 AS g, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY md5(event_id || ':42')) AS r FROM events)
  SELECT event_id, event_type, g FROM r JOIN q USING (event_type, g) WHERE r <= q""")
def stratified_sample(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("g"))
    return Sm.stratified_sample(e, ["event_type", "g"], 2500, "event_id", "42")


@query("O-101", sql="SELECT event_id, user_id FROM events ORDER BY md5(event_id || ':7'), event_id LIMIT 1000")
def hash_sample(spark, d):
    return Sm.hash_sample(table(spark, d, "events").select("event_id", "user_id"), 1000, "event_id", "7")


@query("O-142", sql=f"""WITH w AS (SELECT unnest(['click', 'view', 'error']) AS event_type, unnest([300, 100, 50]) AS q), r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':gold')) AS r,
  count(*) OVER (PARTITION BY event_type) AS n_cell FROM events), s AS (SELECT * FROM r JOIN w USING (event_type) WHERE r <= q)
  SELECT event_id, event_type, n_cell, count(*) OVER (PARTITION BY event_type) AS n_taken, {q6('n_cell / count(*) OVER (PARTITION BY event_type)', 'weight')} FROM s""")
def oversampled_cells(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return rounded(Sm.quota_sample(e, "event_type", {"click": 300, "view": 100, "error": 50}, "event_id", "gold"))


# ---- screening ----------------------------------------------------------------------------------

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "gross"]
FEATURE_SQL = "f AS (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 + l_tax) AS gross FROM lineitem)"


def features(spark, d):
    l = table(spark, d, "lineitem")
    price = F.col("l_extendedprice")
    return l.select("l_returnflag", *FEATURES[:4], (price * (1 - F.col("l_discount"))).alias("net"), (price * (1 + F.col("l_tax"))).alias("gross"))


PAIRS = Sc.feature_pairs(FEATURES)


@query("O-67", "O-57", sql=f"WITH {FEATURE_SQL} " + " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS feature_a, '{b}' AS feature_b, {q6(f'corr({a}, {b})', 'correlation')} FROM f GROUP BY 1" for a, b in PAIRS))
def pearson_pairs(spark, d):
    return rounded(Sc.pearson_pairs(features(spark, d), FEATURES, ["l_returnflag"]))


PANEL_FEATURES = ["trip_value", "trip_count", "ridership", "ride_count", "avg_speed", "traffic_volume"]


def _rho(a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY round({c}, 6)) + (count(*) OVER (PARTITION BY round({c}, 6)) - 1) / 2.0"
    return f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS n_rows, corr(x, y) AS rho FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


SPEARMAN_SQL = f"{SQL_PANEL}, every AS ({' UNION ALL '.join(_rho(a, b) for a, b in Sc.feature_pairs(PANEL_FEATURES))}), r AS (SELECT * FROM every WHERE n_rows >= 50)"


def spearman(spark, d):
    # Sums differ in their last bit with the order of addition; rounding keeps ties ties in both engines.
    key = ["zone_id", "date", "temporal_bucket"]
    p = dense_panel(spark, d).select(*key, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in PANEL_FEATURES])
    return Sc.spearman_pairs(p, key, PANEL_FEATURES)


@query("O-67", sql=f"WITH {SPEARMAN_SQL} SELECT feature_a, feature_b, n_rows, {q6('rho', 'correlation')} FROM r")
def spearman_pairs(spark, d):
    return rounded(spearman(spark, d))


@query("O-102", sql=f"""WITH {SPEARMAN_SQL} SELECT feature_a, feature_b, n_rows, {q6('rho', 'correlation')}, CASE WHEN abs(rho) >= 0.95 THEN 'strict_high_correlation' ELSE 'high_correlation' END AS correlation_band,
  least(feature_a, feature_b) || '__PAIR__' || greatest(feature_a, feature_b) AS feature_pair_key FROM r WHERE abs(rho) >= 0.9""")
def high_correlation_pairs(spark, d):
    return rounded(Sc.high_correlation(spearman(spark, d)))


SCORE_SQL = f"""{SQL_PANEL}, m AS (SELECT unnest(['trip_count', 'ridership', 'avg_speed', 'speed_std', 'traffic_volume', 'riders']) AS feature_name, unnest([trip_count, ridership, avg_speed, speed_std, traffic_volume, riders])::DOUBLE AS v FROM panel),
  p AS (SELECT feature_name, count(v) / count(*) AS coverage, stddev_samp(v) AS sd, count(DISTINCT v) AS d FROM m GROUP BY 1),
  sc AS (SELECT *, (CASE WHEN coverage >= 0.9 THEN 2 WHEN coverage >= 0.5 THEN 1 ELSE 0 END + CASE WHEN sd > 1 THEN 1 ELSE 0 END + CASE WHEN d > 50 THEN 1 ELSE 0 END)::DOUBLE AS score FROM p)"""


def scored_features(spark, d):
    names = ["trip_count", "ridership", "avg_speed", "speed_std", "traffic_volume", "riders"]
    long = dense_panel(spark, d).select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "feature_name", "v")
    manifest = long.groupBy("feature_name").agg((F.count("v") / F.count(F.lit(1))).alias("coverage"), F.stddev_samp("v").alias("sd"), F.countDistinct("v").alias("d"))
    c = F.col("coverage")
    evidence = [("is_covered", c >= 0.5, 1), ("is_dense", c >= 0.9, 1), ("varies", F.col("sd") > 1, 1), ("is_rich", F.col("d") > 50, 1)]
    tiers = [(F.col("feature_name").startswith("traffic"), "dropped_scope"), (c < 0.25, "dropped_low_signal"), (F.col("score") >= 3, "selected")]
    return Sc.scorecard(manifest, evidence, tiers, "candidate_review")


TIER_SQL = "CASE WHEN starts_with(feature_name, 'traffic') THEN 'dropped_scope' WHEN coverage < 0.25 THEN 'dropped_low_signal' WHEN score >= 3 THEN 'selected' ELSE 'candidate_review' END"


@query("O-103", sql=f"WITH {SCORE_SQL} SELECT feature_name, {q6('coverage')}, score, {TIER_SQL} AS decision_tier FROM sc")
def feature_scorecard(spark, d):
    return rounded(scored_features(spark, d).select("feature_name", "coverage", "score", "decision_tier"))


@query("O-164", sql=f"""WITH {SCORE_SQL}, t AS (SELECT feature_name, unnest([feature_name || '_lag', feature_name || '_mean', 'log_' || feature_name]) AS f, {TIER_SQL} AS tier FROM sc),
  g AS (SELECT replace(f, feature_name, '{{metric}}') AS feature_template, count(*) AS feature_count, count(DISTINCT feature_name) AS metric_count, count(*) FILTER (WHERE tier = 'selected') AS selected_count,
    count(*) FILTER (WHERE tier = 'candidate_review') AS review_count, count(*) FILTER (WHERE starts_with(tier, 'dropped')) AS dropped_count FROM t GROUP BY 1)
  SELECT *, CASE WHEN feature_count = 1 THEN 'single_feature' WHEN (selected_count > 0)::INT + (review_count > 0)::INT + (dropped_count > 0)::INT > 1 THEN 'mixed_treatment'
    WHEN selected_count > 0 THEN 'consistently_selected' WHEN dropped_count > 0 THEN 'consistently_dropped' ELSE 'consistently_review' END AS template_status FROM g""")
def template_consistency(spark, d):
    n = F.col("feature_name")
    names = F.explode(F.array(F.concat(n, F.lit("_lag")), F.concat(n, F.lit("_mean")), F.concat(F.lit("log_"), n)))
    s = scored_features(spark, d).select(n.alias("source_metric"), names.alias("feature_name"), "decision_tier")
    return Sc.template_consistency(s)


# ---- matrices -----------------------------------------------------------------------------------


@query("O-105", sql=f"""WITH {SQL_PANEL}, k AS (SELECT * FROM panel WHERE riders IS NOT NULL)
  SELECT {KEY_SQL}, riders, {q6('coalesce(traffic_volume, 0)', 'traffic_volume')}, {q6('coalesce(avg_speed, (SELECT median(avg_speed) FROM k))', 'avg_speed')}, (avg_speed IS NULL)::BIGINT AS avg_speed_missing,
  {q6('coalesce(speed_std, 0)', 'speed_std')}, (speed_std IS NULL)::BIGINT AS speed_std_missing FROM k""")
def imputed_matrix(spark, d):
    p = dense_panel(spark, d).select("zone_id", "date", "temporal_bucket", "riders", "traffic_volume", "avg_speed", "speed_std")
    return rounded(Mx.impute_with_policy(p, {"riders": "drop", "traffic_volume": "zero", "avg_speed": "median", "speed_std": 0.0}))


@query("O-106", sql=f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, (l_returnflag = 'R')::INT AS is_return FROM lineitem), m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS b, stddev_pop(l_extendedprice) AS t FROM x)
  SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, {q6('(l_quantity - a) / s', 'l_quantity')}, {q6('(l_extendedprice - b) / t', 'l_extendedprice')}, is_return::BIGINT AS is_return FROM x, m""")
def scaled_matrix(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("is_return"), F.lit(1.0).alias("fixed"))
    return rounded(Mx.scale_matrix(l, ["l_quantity", "l_extendedprice", "is_return", "fixed"]))


DIMS = 64


def wide_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(DIMS)])


XS = [f"x{i}" for i in range(DIMS)]


@query("O-107")
def component_counts(spark, d):
    return Mx.variance_table(spark, Mx.fit_components(wide_embeddings(spark, d), XS))


@query("O-107")
def component_scores(spark, d):
    w = wide_embeddings(spark, d)
    model = Mx.fit_components(w, XS)
    return Mx.project(w, model, model.needed(0.8)).select("vec_id", F.posexplode("scores").alias("component", "score"))


@query("O-108")
def loading_stability(spark, d):
    w = wide_embeddings(spark, d)
    half = lambda cond: Mx.fit_components(w.where(cond), XS)
    return Mx.loading_stability(spark, half("label < 5"), half("label >= 5"))


FAMILIES = {"history": XS[16:32], "spatial": XS[32:48], "deviation": XS[48:64]}


@query("O-104")
def family_order(spark, d):
    return Mx.greedy_family_order(spark, wide_embeddings(spark, d), XS[:16], FAMILIES)


@query("O-163")
def contribution_tiers(spark, d):
    steps = Mx.greedy_family_order(spark, wide_embeddings(spark, d), XS[:16], FAMILIES)
    return Sc.contribution_tiers(steps, "step", "added_family", "head_variance", "components_80", "feature_count", "base")
