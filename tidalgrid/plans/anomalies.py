"""Neighbour, outlier framework, consensus and event queries."""

from pyspark.sql import functions as F

from ..functions.labels import directional_label, policy_geography
from ..operators import neighbors as N
from ..operators import outliers as Ou
from ..operators import windows as Wn
from ..session import reliable_checkpoint
from .base import SQL_PANEL, dense_panel, isos, q6, rounded, table
from .history import BASE_W
from .registry import Family

FAMILY = Family()
query = FAMILY.query


def vectors(spark, d):
    return table(spark, d, "embeddings").withColumn("half", F.col("label") % 2)


VEC_SQL = """v AS (SELECT vec_id, label % 2 AS half, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  dist AS (SELECT a.vec_id AS a, b.vec_id AS b, a.half, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.half = b.half)"""
KNN_SQL = f"{VEC_SQL}, knn AS (SELECT half, a, b, d, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS r FROM dist WHERE a <> b)"


@query("O-109", sql=f"""WITH {KNN_SQL} SELECT half::VARCHAR AS group_key, r AS neighbor_k, count(*) AS group_rows, {q6('avg(d)', 'mean_distance')}, {q6('stddev_pop(d)', 'std_distance')}, {q6('stddev_pop(d) / avg(d)', 'variation')},
  {q6('median(d)', 'median_distance')}, {q6('quantile_cont(d, 0.9)', 'p90_distance')}, {q6('quantile_cont(d, 0.95)', 'p95_distance')}, {q6('quantile_cont(d, 0.99)', 'p99_distance')} FROM knn WHERE r IN (5, 10, 20) GROUP BY ALL""")
def neighbor_distances(spark, d):
    return rounded(N.knn_profile(vectors(spark, d), "half", "vec_id", "embedding", [5, 10, 20]))


@query("O-113", sql=f"""WITH {KNN_SQL}, p AS (SELECT half, r, count(*) AS n, quantile_cont(d, 0.9) AS p90, quantile_cont(d, 0.95) AS p95, quantile_cont(d, 0.99) AS p99, stddev_pop(d) / avg(d) AS cv FROM knn WHERE r IN (5, 10) GROUP BY ALL)
  SELECT r AS neighbor_k, count(*) AS groups_profiled, {q6('avg(n)', 'mean_group_rows')}, {q6('median(p90)', 'p90_anchor')}, {q6('median(p95)', 'p95_anchor')}, {q6('median(p99)', 'p99_anchor')}, {q6('avg(cv)', 'mean_variation')} FROM p GROUP BY 1""")
def radius_anchors(spark, d):
    return rounded(N.eps_anchors(N.knn_profile(vectors(spark, d), "half", "vec_id", "embedding", [5, 10])))


EPS, MIN_SAMPLES = 1.28, 10


def _dbscan_sql(eps: float, m: int) -> str:
    return f"""deg AS (SELECT a, any_value(half) AS half, count(*) AS n FROM dist WHERE d <= {eps} OR a = b GROUP BY a),
  nz AS (SELECT dist.a, max(deg.n) AS peak FROM dist JOIN deg ON deg.a = dist.b WHERE d <= {eps} OR dist.a = dist.b GROUP BY dist.a)"""


@query("O-111", sql=f"""WITH {VEC_SQL}, {_dbscan_sql(EPS, MIN_SAMPLES)} SELECT a AS vec_id, half::BIGINT AS half, n AS neighbor_count, n >= {MIN_SAMPLES} AS is_core, peak < {MIN_SAMPLES} AS is_noise FROM deg JOIN nz USING (a)""")
def density_noise(spark, d):
    return rounded(N.dbscan_noise(vectors(spark, d), "half", "vec_id", "embedding", EPS, MIN_SAMPLES))


GRID_EPS, GRID_M = [1.2, 1.25, 1.3], [5, 10, 20]


@query("O-113", sql=f"WITH {VEC_SQL} " + " UNION ALL ".join(
    f"""SELECT {e}::DOUBLE AS eps, {m}::BIGINT AS min_samples, count(DISTINCT half) AS groups_evaluated, count(*) AS rows_evaluated, count(*) FILTER (WHERE peak < {m}) AS noise_rows,
      {q6(f'count(*) FILTER (WHERE peak < {m}) / count(*)', 'weighted_noise_share')} FROM (WITH {_dbscan_sql(e, m)} SELECT * FROM deg JOIN nz USING (a))"""
    for e in GRID_EPS for m in GRID_M))
def density_sweep(spark, d):
    return rounded(N.dbscan_sweep(vectors(spark, d), "half", "vec_id", "embedding", GRID_EPS, GRID_M))


def _cluster_sql(eps: float, m: int) -> str:
    return f"""{VEC_SQL}, near AS (SELECT a, b FROM dist WHERE d <= {eps} OR a = b),
  core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {m}), edge AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
  reach AS (SELECT id, id AS r FROM core UNION SELECT reach.id, edge.b FROM reach JOIN edge ON edge.a = reach.r), comp AS (SELECT id, min(r) AS c FROM reach GROUP BY 1),
  lab AS (SELECT v.vec_id, v.half, v.e, coalesce(comp.c, (SELECT min(x.c) FROM near JOIN comp x ON x.id = near.b WHERE near.a = v.vec_id)) AS cluster FROM v LEFT JOIN comp ON comp.id = v.vec_id)"""


def _cluster_summary_sql(eps: float, m: int) -> str:
    return f"""WITH RECURSIVE {_cluster_sql(eps, m)}, n AS (SELECT half, cluster, count(*) AS n FROM lab GROUP BY ALL)
  SELECT half::BIGINT AS half, count(cluster) AS cluster_count, {q6('max(n) FILTER (WHERE cluster IS NOT NULL) / sum(n) FILTER (WHERE cluster IS NOT NULL)', 'largest_cluster_share')},
  {q6('coalesce(sum(n) FILTER (WHERE cluster IS NULL), 0) / sum(n)', 'noise_share')} FROM n GROUP BY half"""


def _centroid_sql(eps: float, m: int) -> str:
    return f"""WITH RECURSIVE {_cluster_sql(eps, m)}, parts AS (SELECT half, cluster, unnest(e) AS x, unnest(range(len(e))) AS i FROM lab WHERE cluster IS NOT NULL),
  mean AS (SELECT half, cluster, i, avg(x) AS x, count(*) AS n FROM parts GROUP BY ALL), mid AS (SELECT half, cluster, list(x ORDER BY i) AS c, any_value(n) AS n FROM mean GROUP BY ALL),
  rim AS (SELECT half, cluster, max(list_distance(e, c)) AS edge FROM lab JOIN mid USING (half, cluster) GROUP BY ALL),
  g AS (SELECT lab.vec_id, lab.half, lab.cluster, mid.cluster AS k, mid.n, rim.edge, list_distance(lab.e, mid.c) AS d FROM lab JOIN mid USING (half) JOIN rim ON rim.half = mid.half AND rim.cluster = mid.cluster),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM g)
  SELECT vec_id, half::BIGINT AS half, cluster::DOUBLE AS cluster, k::DOUBLE AS nearest_cluster, n::DOUBLE AS nearest_cluster_size, {q6('d', 'centroid_distance')}, {q6('d / nullif(edge, 0)', 'edge_ratio')} FROM r WHERE r = 1"""


#: A radius with many small clusters, and the one of density_noise, under which most vectors hang together.
TIGHT, TIGHT_M = 1.15, 3


def cluster_ids(spark, d, eps, m):
    return N.dbscan_clusters(vectors(spark, d), "half", "vec_id", "embedding", eps, m)


def centroid_rows(spark, d, eps, m):
    v = vectors(spark, d).select("vec_id", "half", "embedding").join(cluster_ids(spark, d, eps, m).select("vec_id", "cluster"), "vec_id")
    v = reliable_checkpoint(v)  # read three times below
    return rounded(Ou.centroid_distance(v, "half", "vec_id", "embedding", "cluster").drop("embedding"), ["cluster", "nearest_cluster", "nearest_cluster_size"])


@query("O-112", sql=_cluster_summary_sql(TIGHT, TIGHT_M))
def density_clusters(spark, d):
    return rounded(N.cluster_summary(cluster_ids(spark, d, TIGHT, TIGHT_M), "half"))


@query("O-120", sql=_centroid_sql(TIGHT, TIGHT_M))
def centroid_distances(spark, d):
    return centroid_rows(spark, d, TIGHT, TIGHT_M)


@query("O-112", sql=_cluster_summary_sql(EPS, MIN_SAMPLES))
def vector_clusters(spark, d):
    return rounded(N.cluster_summary(cluster_ids(spark, d, EPS, MIN_SAMPLES), "half"))


@query("O-120", sql=_centroid_sql(EPS, MIN_SAMPLES))
def vector_centroid_distances(spark, d):
    return centroid_rows(spark, d, EPS, MIN_SAMPLES)


LOW_SQL = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS s FROM embeddings),
  dist AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.e, b.e) AS d, list_distance(a.s, b.s) AS l FROM v a JOIN v b ON a.vec_id <> b.vec_id),
  r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS rh, row_number() OVER (PARTITION BY a ORDER BY round(l, 9), b) AS rl FROM dist)"""


def two_spaces(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.slice("embedding", 1, 8).alias("low"))


@query("O-110", sql=f"WITH {LOW_SQL} SELECT a AS vec_id, {q6('count(*) FILTER (WHERE rh <= 15 AND rl <= 15) / 15.0', 'overlap')} FROM r GROUP BY a")
def neighbor_overlap(spark, d):
    return rounded(N.neighbor_overlap(two_spaces(spark, d), "vec_id", "embedding", "low", 15))


@query("O-110", sql=f"""WITH {LOW_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM v) SELECT any_value(n)::BIGINT AS row_count,
  {q6('1 - 2.0 / (any_value(n) * 15 * (2 * any_value(n) - 46)) * sum(greatest(rh - 15, 0))', 'trustworthiness')} FROM r, n WHERE rl <= 15""")
def space_trustworthiness(spark, d):
    return rounded(N.trustworthiness(two_spaces(spark, d), "vec_id", "embedding", "low", 15))


@query("O-162", sql=f"""WITH {KNN_SQL}, k AS (SELECT half, avg(d) AS m, median(d) AS md, quantile_cont(d, 0.95) AS p FROM knn WHERE r <= 15 GROUP BY 1), a AS (SELECT half, avg(d) AS m2, stddev_pop(d) AS s2 FROM dist WHERE a <> b GROUP BY 1)
  SELECT half::VARCHAR AS group_key, {q6('m', 'mean_knn_distance')}, {q6('md', 'median_knn_distance')}, {q6('p', 'p95_knn_distance')}, {q6('m2', 'pair_distance_mean')}, {q6('s2', 'pair_distance_std')}, {q6('s2 / m2', 'concentration_ratio')} FROM k JOIN a USING (half)""")
def distance_profile(spark, d):
    return rounded(N.distance_profile(vectors(spark, d), "half", "vec_id", "embedding", 15))


# ---- model-based frameworks ---------------------------------------------------------------------

SHARES = [0.005, 0.01, 0.02, 0.05]


def forest_flags(spark, d):
    v = vectors(spark, d)
    scored = Ou.forest_scores(v, "embedding", Ou.fit_forest(v, "vec_id", "embedding", trees=300)).select("vec_id", "half", "score")
    return Ou.tail_flags(scored, "score", SHARES)


def mixture_flags(spark, d):
    v = vectors(spark, d)
    scored = Ou.mixture_scores(v, "embedding", Ou.fit_mixture(v, "vec_id", "embedding", 2)).select("vec_id", "half", "score")
    return Ou.tail_flags(scored, "score", SHARES, inclusive=True)


@query("O-114")
def forest_scores(spark, d):
    return forest_flags(spark, d)


@query("O-115")
def mixture_scores(spark, d):
    return mixture_flags(spark, d)


@query("O-115", "O-45")
def mixture_structures(spark, d):
    v = vectors(spark, d)
    fits = {f"{kind}_{k}": Ou.fit_mixture(v, "vec_id", "embedding", k, kind) for kind in ("diag", "full") for k in (1, 2, 3)}
    return Ou.screen_structures(Ou.mixture_criteria(spark, fits))


CRITERIA_SQL = """c AS (SELECT event_type AS feature_set, CAST(user_id % 7 AS INT) AS m, count(*)::DOUBLE AS bic, max(value) AS aic, min(value) AS mean_log_likelihood FROM events GROUP BY ALL),
  k AS (SELECT *, m % 4 + 1 AS component_count, CASE WHEN m % 2 = 0 THEN 'full' ELSE 'diag' END AS kind FROM c)"""


@query("O-115", sql=f"""WITH {CRITERIA_SQL}, r AS (SELECT *, dense_rank() OVER (PARTITION BY feature_set ORDER BY bic) AS bic_rank, dense_rank() OVER (PARTITION BY feature_set ORDER BY aic) AS aic_rank,
  dense_rank() OVER (PARTITION BY feature_set ORDER BY mean_log_likelihood DESC) AS log_likelihood_rank FROM k),
  n AS (SELECT *, (bic_rank <= 4)::INT + (aic_rank <= 4)::INT + (log_likelihood_rank <= 4)::INT AS competitive_metrics FROM r)
  SELECT feature_set, m::BIGINT AS m, bic_rank, aic_rank, log_likelihood_rank, competitive_metrics::BIGINT AS competitive_metrics, CASE WHEN component_count = 1 THEN 'retire' WHEN kind = 'full' AND competitive_metrics = 3 THEN 'advance'
  WHEN competitive_metrics = 3 OR (kind = 'full' AND competitive_metrics = 2) THEN 'caution' ELSE 'retire' END AS structure_decision FROM n""")
def structure_screen(spark, d):
    # Stand-in criteria, one row for each of seven fits a feature set; ties do occur.
    c = table(spark, d, "events").groupBy(F.col("event_type").alias("feature_set"), (F.col("user_id") % 7).cast("int").alias("m")).agg(
        F.count(F.lit(1)).cast("double").alias("bic"), F.max("value").alias("aic"), F.min("value").alias("mean_log_likelihood"))
    c = c.withColumns({"component_count": F.col("m") % 4 + 1, "kind": F.when(F.col("m") % 2 == 0, "full").otherwise("diag")})
    return rounded(Ou.screen_structures(c).select("feature_set", "m", "bic_rank", "aic_rank", "log_likelihood_rank", "competitive_metrics", "structure_decision"))


@query("O-116", sql="""WITH g AS (SELECT event_type AS feature_set, CAST(user_id % 3 AS INT) AS structure, CAST([0.005, 0.01, 0.02, 0.05][CAST(user_id // 3 % 4 AS INT) + 1] AS DOUBLE) AS tail_share, value, ts FROM events),
  s AS (SELECT feature_set, structure, tail_share, round(avg(value)) % 5 - 1 AS tail_gap, count(*) % 6 AS median_gap FROM g GROUP BY ALL),
  r AS (SELECT *, dense_rank() OVER (PARTITION BY feature_set, structure ORDER BY tail_gap DESC) AS tail_rank, dense_rank() OVER (PARTITION BY feature_set, structure ORDER BY median_gap DESC) AS median_rank FROM s)
  SELECT feature_set, structure::BIGINT AS structure, tail_share, tail_rank, median_rank, CASE WHEN tail_share = 0.05 OR tail_gap <= 0 THEN 'retire' WHEN tail_rank <= 2 AND median_rank <= 2 THEN 'advance' ELSE 'caution' END AS screen_decision FROM r""")
def ranked_tail_screen(spark, d):
    # Stand-in gaps with many ties, per feature set, structure and tail share.
    shares = F.array(*[F.lit(x) for x in SHARES])
    g = table(spark, d, "events").select(F.col("event_type").alias("feature_set"), (F.col("user_id") % 3).cast("int").alias("structure"), F.get(shares, F.expr("CAST(user_id DIV 3 % 4 AS INT)")).alias("tail_share"), "value")
    s = g.groupBy("feature_set", "structure", "tail_share").agg((F.round(F.avg("value")) % 5 - 1).alias("tail_gap"), (F.count(F.lit(1)) % 6).alias("median_gap"))
    return rounded(Ou.screen_tails(s, "tail_share", max(SHARES), ["feature_set", "structure"]).drop("tail_gap", "median_gap"))


FLAG_SQL = """f AS (SELECT event_type AS setting, value, value > CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 150 ELSE 100 END AS flag, -value / 100 AS score FROM events),
  s AS (SELECT setting, count(*) FILTER (WHERE flag) AS flagged_rows, count(*) AS rows_evaluated, quantile_cont(score, 0.95) FILTER (WHERE flag) AS aq, quantile_cont(score, 0.05) FILTER (WHERE NOT flag) AS nq,
    median(score) FILTER (WHERE flag) AS am, median(score) FILTER (WHERE NOT flag) AS nm FROM f GROUP BY 1)"""


def value_separation(spark, d):
    e = table(spark, d, "events")
    cut = F.when(F.col("event_type") == "click", 200).when(F.col("event_type") == "view", 150).otherwise(100)
    f = e.select(F.col("event_type").alias("setting"), (F.col("value") > cut).alias("is_flagged"), (-F.col("value") / 100).alias("score"))
    return Ou.score_separation(f, "score", "setting")


@query("O-116", "O-45", sql=f"""WITH {FLAG_SQL} SELECT setting, flagged_rows, rows_evaluated, {q6('aq', 'anomaly_q95')}, {q6('nq', 'normal_q05')}, {q6('am', 'anomaly_median')}, {q6('nm', 'normal_median')}, {q6('nq - aq', 'tail_gap')}, {q6('nm - am', 'median_gap')},
  CASE WHEN nq - aq >= 0.04 AND nm - am >= 0.2 THEN 'advance' WHEN nq - aq >= 0.03 AND nm - am >= 0.15 THEN 'caution' ELSE 'retire' END AS screen_decision FROM s""")
def score_separation(spark, d):
    return rounded(Ou.screen_separation(value_separation(spark, d)))


@query("O-116", "O-45")
def tail_screen(spark, d):
    return Ou.screen_tails(Ou.score_separation(forest_flags(spark, d), "score", "tail_share"), "tail_share", max(SHARES))


@query("O-117", sql=f"""WITH f AS (SELECT value > 250 AS a, value > 200 AS b, value > 150 AS c FROM events), p AS (SELECT unnest(['f250', 'f200']) AS setting_a, unnest(['f200', 'f150']) AS setting_b, unnest([a, b]) AS x, unnest([b, c]) AS y FROM f)
  SELECT setting_a, setting_b, count(*) FILTER (WHERE x) AS a_count, count(*) FILTER (WHERE y) AS b_count, count(*) FILTER (WHERE x AND y) AS both_count, count(*) FILTER (WHERE x OR y) AS union_count, count(*) AS row_count,
  {q6('count(*) FILTER (WHERE x AND y) / count(*) FILTER (WHERE x OR y)', 'jaccard')}, {q6('abs(count(*) FILTER (WHERE x) - count(*) FILTER (WHERE y)) / count(*)', 'volume_drift')} FROM p GROUP BY ALL""")
def flag_stability(spark, d):
    e = table(spark, d, "events").select(*[(F.col("value") > c).alias(f"f{c}") for c in (250, 200, 150)])
    return rounded(Ou.flag_stability(e, ["f250", "f200", "f150"]))


# ---- surfaces, consensus and events on the panel ------------------------------------------------

MODES = ["taxi", "subway", "bus"]
KEY = ["zone_id", "date", "temporal_bucket"]


def _z(m: str) -> str:
    return f"CASE WHEN count({m}) OVER ({BASE_W}) >= 5 AND stddev_samp({m}) OVER ({BASE_W}) > 1e-6 THEN ({m} - avg({m}) OVER ({BASE_W})) / stddev_samp({m}) OVER ({BASE_W}) END"


GEO_SQL = "CASE WHEN zone_id IN (3, 8) THEN 'cbd' WHEN zone_id IN (2, 4, 7, 9) THEN 'gateway_or_adjacent' ELSE 'outside' END"
SURFACE_SQL = f"""{SQL_PANEL}, z AS (SELECT zone_id, date, temporal_bucket, period, {GEO_SQL} AS geo, {_z('trip_value')} AS z1, {_z('ridership')} AS z2, {_z('avg_speed')} AS z3 FROM panel),
  surf AS (SELECT zone_id, date, temporal_bucket, period, geo, unnest(['taxi', 'subway', 'bus']) AS feature_set, unnest([z1, z2, z3]) AS z FROM z),
  con AS (SELECT *, coalesce(abs(z) > 1.5, false) AS a, coalesce(abs(z) > 2, false) AS b, coalesce(abs(z) > 2.5, false) AS c FROM surf)"""


def panel_z(spark, d):
    p = dense_panel(spark, d).select(*KEY, "period", "trip_value", "ridership", "avg_speed")
    near = lambda ids: F.when(F.col("zone_id").isin(ids), 1)
    geo = policy_geography(near([3, 8]), near([2, 4, 7, 9]))
    return Wn.deviation_zscores(p, ["trip_value", "ridership", "avg_speed"], min_rows=5).withColumn("policy_geography", geo)


def surfaces(spark, d):
    """Three cut-offs of the deviation z-score as three frameworks, per mode."""
    z = panel_z(spark, d)
    named = [F.struct(F.lit(m).alias("feature_set"), F.col(f"{c}_deviation_z").alias("z")) for m, c in zip(MODES, ("trip_value", "ridership", "avg_speed"))]
    long = z.select(*KEY, "period", "policy_geography", F.inline(F.array(*named)))
    cuts = [F.struct(F.lit(f).alias("framework"), F.coalesce(F.abs("z") > c, F.lit(False)).alias("is_flagged")) for f, c in (("dbscan", 1.5), ("forest", 2.0), ("mixture", 2.5))]
    return long.select(*KEY, "period", "policy_geography", "feature_set", F.inline(F.array(*cuts)))


def consensus(spark, d):
    return Ou.framework_consensus(surfaces(spark, d), [*KEY, "period", "policy_geography", "feature_set"], ["dbscan", "forest", "mixture"])


@query("O-118", sql=f"""WITH {SURFACE_SQL} SELECT zone_id::BIGINT AS zone_id, strftime(date, '%Y-%m-%d') AS date, temporal_bucket, period, geo AS policy_geography, feature_set, a AS dbscan_flag, b AS forest_flag, c AS mixture_flag,
  (a::INT + b::INT + c::INT)::BIGINT AS method_count, a OR b OR c AS is_union, a::INT + b::INT + c::INT >= 2 AS is_two_plus, a AND b AND c AS is_three_plus FROM con""")
def framework_consensus(spark, d):
    return rounded(consensus(spark, d))


def events(spark, d):
    kept = consensus(spark, d).where("is_union").withColumn("is_high_confidence", F.col("is_two_plus"))
    return Ou.event_table(kept, MODES)


EVENT_SQL = f"""{SURFACE_SQL}, ev AS (SELECT zone_id, date, temporal_bucket, any_value(period) AS period, any_value(geo) AS policy_geography, bool_or(a::INT + b::INT + c::INT >= 2) AS is_high_confidence, max(a::INT + b::INT + c::INT)::BIGINT AS max_method_count,
  bool_or(feature_set = 'taxi') AS has_taxi, bool_or(feature_set = 'subway') AS has_subway, bool_or(feature_set = 'bus') AS has_bus FROM con WHERE a OR b OR c GROUP BY ALL)"""


@query("O-75", "O-63", sql=f"""WITH {EVENT_SQL} SELECT zone_id::BIGINT AS zone_id, strftime(date, '%Y-%m-%d') AS date, temporal_bucket, period, policy_geography, is_high_confidence, max_method_count, has_taxi, has_subway, has_bus,
  regexp_replace(temporal_bucket, '^(weekday|weekend)_', '') AS daypart, starts_with(temporal_bucket, 'weekday') AS is_weekday, period = 'post_cp' AS is_post, policy_geography = 'cbd' AS is_cbd,
  policy_geography = 'gateway_or_adjacent' AS is_gateway_or_adjacent, printf('mobility_event_%06d', row_number() OVER (ORDER BY zone_id, date, temporal_bucket)) AS event_id FROM ev""")
def mobility_events(spark, d):
    return rounded(events(spark, d))


@query("O-76", sql=f"WITH {EVENT_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, {c}::VARCHAR AS slice, count(*) AS event_count, count(*) FILTER (WHERE is_high_confidence) AS high_confidence_count, {q6('count(*) FILTER (WHERE is_high_confidence) / count(*)', 'high_confidence_share')} FROM ev GROUP BY 2"
    for c in ("period", "policy_geography")) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'mode', 'has_{m}', count(*), count(*) FILTER (WHERE is_high_confidence), round(count(*) FILTER (WHERE is_high_confidence) / count(*) + 1e-9, 6) FROM ev WHERE has_{m} HAVING count(*) > 0" for m in MODES))
def event_summaries(spark, d):
    e = events(spark, d)
    out = Ou.event_summary(e, "period").unionByName(Ou.event_summary(e, "policy_geography")).unionByName(Ou.mode_summary(e, MODES))
    return rounded(out)


@query("O-119", sql=f"""WITH {SQL_PANEL}, f AS (SELECT temporal_bucket, zone_id || '|' || strftime(date, '%Y-%m-%d') || '|' || temporal_bucket AS k, trip_value > 250 AS flag, unnest(['trip_value', 'ridership', 'avg_speed']) AS feature, unnest([trip_value, ridership, avg_speed]) AS value FROM panel),
  s AS (SELECT temporal_bucket, feature, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, median(value) AS md, quantile_cont(value, 0.75) AS q3 FROM f WHERE value IS NOT NULL GROUP BY ALL),
  z AS (SELECT *, CASE WHEN sd > 0 THEN (value - m) / sd END AS z FROM f JOIN s USING (temporal_bucket, feature) WHERE flag AND value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(z) DESC NULLS LAST, feature) AS rank FROM z)
  SELECT temporal_bucket, feature, k, {q6('value')}, {q6('m', 'group_mean')}, {q6('sd', 'group_std')}, {q6('q1')}, {q6('md', 'median')}, {q6('q3')}, {q6('z')}, rank FROM r WHERE rank <= 2""")
def deviation_drivers(spark, d):
    p = dense_panel(spark, d).withColumn("k", F.concat_ws("|", F.col("zone_id").cast("string"), F.date_format("date", "yyyy-MM-dd"), "temporal_bucket"))
    return rounded(Ou.explain_group_z(p, "temporal_bucket", "k", ["trip_value", "ridership", "avg_speed"], F.col("trip_value") > 250, 2))


@query("O-121", sql=f"""WITH {EVENT_SQL}, k AS (SELECT policy_geography, temporal_bucket, period, zone_id || '|' || strftime(date, '%Y-%m-%d') || '|' || temporal_bucket AS k FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY policy_geography, temporal_bucket, period ORDER BY md5(k || ':review')) AS turn FROM k)
  SELECT policy_geography, temporal_bucket, period, k, turn FROM r WHERE turn <= 40 ORDER BY turn, policy_geography, temporal_bucket, period LIMIT 40""")
def review_panel(spark, d):
    kept = consensus(spark, d).where("is_union").groupBy(*KEY, "period", "policy_geography").agg(F.count(F.lit(1)).alias("n"))
    k = F.concat_ws("|", F.col("zone_id").cast("string"), F.date_format("date", "yyyy-MM-dd"), "temporal_bucket")
    return rounded(Ou.representative_rows(kept.select("policy_geography", "temporal_bucket", "period", k.alias("k")), ["policy_geography", "temporal_bucket", "period"], "k", 40))


@query("O-122", sql=f"""WITH {SURFACE_SQL}, f AS (SELECT DISTINCT feature_set, zone_id, temporal_bucket, date FROM con WHERE a), w AS (SELECT *, count(*) OVER (PARTITION BY feature_set, zone_id, temporal_bucket) AS recurrence,
  coalesce(date_diff('day', date, lead(date) OVER o) <= 7, false) AS nxt, coalesce(date_diff('day', lag(date) OVER o, date) <= 7, false) AS prv FROM f WINDOW o AS (PARTITION BY feature_set, zone_id, temporal_bucket ORDER BY date))
  SELECT feature_set, zone_id::BIGINT AS zone_id, temporal_bucket, strftime(date, '%Y-%m-%d') AS date, recurrence, nxt AS followed_within, nxt OR prv AS is_persistent FROM w""")
def recurrence_persistence(spark, d):
    flagged = surfaces(spark, d).where("framework = 'dbscan' AND is_flagged")
    return rounded(Ou.recurrence_persistence(flagged, ["feature_set", "zone_id", "temporal_bucket"]))


@query("O-123", sql=f"""WITH {SQL_PANEL}, o AS (SELECT zone_id, date, temporal_bucket, count(*) AS n FROM act WHERE event_type = 'error' AND value > 50 GROUP BY ALL), j AS (SELECT trip_value > 100 AS f, coalesce(n, 0) AS n FROM panel LEFT JOIN o USING (zone_id, date, temporal_bucket)),
  a AS (SELECT count(*) AS row_count, count(*) FILTER (WHERE f) AS flagged_count, avg((n > 0)::INT) AS r, avg((n > 0)::INT) FILTER (WHERE f) AS fr, avg(n) AS m, avg(n) FILTER (WHERE f) AS fm FROM j)
  SELECT row_count, flagged_count, {q6('r', 'any_rate')}, {q6('fr', 'flagged_any_rate')}, {q6('m', 'mean_count')}, {q6('fm', 'flagged_mean_count')}, {q6('fr / r', 'any_lift')}, {q6('fm / m', 'count_lift')} FROM a""")
def external_enrichment(spark, d):
    from .base import activity

    out = activity(spark, d).where("event_type = 'error' AND value > 50").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    p = dense_panel(spark, d).withColumn("is_flagged", F.col("trip_value") > 100)
    return rounded(Ou.external_enrichment(p, "is_flagged", out, KEY, "n"))


@query("O-124", sql=f"""WITH {SURFACE_SQL}, s AS (SELECT zone_id, date, temporal_bucket, CASE WHEN z3 <= -1 THEN -1 WHEN z3 >= 1 THEN 1 ELSE 0 END AS v, CASE WHEN z1 <= -1 THEN -1 WHEN z1 >= 1 THEN 1 ELSE 0 END AS c FROM z)
  SELECT zone_id::BIGINT AS zone_id, strftime(date, '%Y-%m-%d') AS date, temporal_bucket, CASE WHEN v = -1 AND c >= 0 THEN 'congestion_oriented' WHEN v = 0 AND c = 1 THEN 'positive_demand_shock' WHEN v = 1 AND c <= 0 THEN 'decongestion_oriented'
  WHEN v = 0 AND c = -1 THEN 'negative_demand_shock' WHEN v * c <> 0 THEN 'mixed' ELSE 'ambiguous' END AS direction FROM s""")
def directional_labels(spark, d):
    z = panel_z(spark, d)
    return rounded(z.select(*KEY, directional_label(F.col("avg_speed_deviation_z"), F.col("trip_value_deviation_z")).alias("direction")))
