"""Statistics, agreement and evaluation queries."""

from pyspark.sql import functions as F

from ..operators import resampling as Rs
from ..operators import statistics as S
from .base import q6, rounded, table
from .discourse import CELLS_SQL, SCORES, SQL_ITEMS, STANCES, item_cells, items
from .registry import Family

FAMILY = Family()
query = FAMILY.query

def _upper(a: str) -> str:
    """SQL of the five-term upper tail for a >= 0."""
    t = f"(1 / (1 + 0.2316419 * {a}))"
    poly = f"((((1.330274429 * {t} - 1.821255978) * {t} + 1.781477937) * {t} - 0.356563782) * {t} + 0.319381530) * {t}"
    return f"(exp(-{a} * {a} / 2) / 2.5066282746310002 * {poly})"


@query("O-149", sql=f"""WITH {SQL_ITEMS}, c AS (SELECT community, count(*) FILTER (WHERE date < DATE '2024-01-16') AS n_pre, count(*) FILTER (WHERE date >= DATE '2024-01-16') AS n_post,
    count(*) FILTER (WHERE date < DATE '2024-01-16' AND stance = 'pro') AS pro_pre, count(*) FILTER (WHERE date >= DATE '2024-01-16' AND stance = 'pro') AS pro_post FROM items WHERE stance <> 'off-topic' GROUP BY 1),
  z AS (SELECT *, (pro_post / n_post - pro_pre / n_pre) / sqrt((pro_post + pro_pre) / (n_post + n_pre) * (1 - (pro_post + pro_pre) / (n_post + n_pre)) * (1.0 / n_post + 1.0 / n_pre)) AS z FROM c),
  p AS (SELECT *, 2 * (1 - (1 - {_upper('abs(z)')})) AS p FROM z), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, community) AS raw, row_number() OVER (ORDER BY p, community) AS i FROM p)
  SELECT community, n_pre, n_post, pro_pre, pro_post, {q6('z', 'z_value')}, {q6('p', 'p_value')}, {q6('least(min(raw) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0)', 'p_adjusted')} FROM r""")
def before_after_tests(spark, d):
    i = items(spark, d).where("stance <> 'off-topic'")
    pre, pro = F.col("date") < F.lit("2024-01-16").cast("date"), F.col("stance") == "pro"
    c = i.groupBy("community").agg(F.count_if(pre).alias("n_pre"), F.count_if(~pre).alias("n_post"), F.count_if(pre & pro).alias("pro_pre"), F.count_if(~pre & pro).alias("pro_post"))
    z, p = S.two_proportion_z(F.col("pro_post"), F.col("n_post"), F.col("pro_pre"), F.col("n_pre"))
    return rounded(S.bh_adjust(c.withColumn("z_value", z).withColumn("p_value", p), "p_value", "community"))


@query("O-150")
def interrupted_order_series(spark, d):
    o = table(spark, d, "orders")
    step = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    monthly = o.groupBy(step.alias("step")).agg(F.avg("o_totalprice").alias("net"), F.count(F.lit(1)).alias("n"))
    return S.interrupted_series(monthly, F.col("step"), "net", "n", 36)


KS_Q = "list_sum(list_transform(generate_series(1, 40), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam)))"


@query("O-151", sql=f"""WITH v AS (SELECT event_type, value, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS a, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY ALL),
  c AS (SELECT event_type, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER t AS ta, sum(b) OVER t AS tb FROM v WINDOW w AS (PARTITION BY event_type ORDER BY value), t AS (PARTITION BY event_type)),
  k AS (SELECT event_type, CAST(max(ta) AS BIGINT) AS n_first, CAST(max(tb) AS BIGINT) AS n_second, max(abs(ca / ta - cb / tb)) AS ks FROM c GROUP BY 1),
  l AS (SELECT *, sqrt(n_first::DOUBLE * n_second / (n_first + n_second)) * ks AS lam FROM k)
  SELECT event_type, n_first, n_second, {q6('ks', 'ks_statistic')}, {q6(f'CASE WHEN lam < 0.2 THEN 1.0 ELSE least(greatest(2 * {KS_Q}, 0), 1) END', 'p_value')} FROM l""")
def value_shift_test(spark, d):
    e = table(spark, d, "events")
    return rounded(S.ks_two_sample(e, "value", F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"), ["event_type"]))


@query("O-152", sql=f"""WITH {SQL_ITEMS}, s AS (SELECT community, (p_pro - p_anti) / (p_anti + p_neutral + p_pro) AS s, conf FROM items),
  m AS (SELECT community, avg(s) AS mu FROM s GROUP BY 1), c AS (SELECT community, count(*) AS n, avg(s) AS mean_value, avg(abs(s)) AS intensity, avg(conf) AS mean_conf,
    avg((s - mu) ** 2) AS m2, avg((s - mu) ** 3) AS m3, avg((s - mu) ** 4) AS m4 FROM s JOIN m USING (community) GROUP BY 1)
  SELECT community, n, {q6('mean_value')}, {q6('intensity')}, {q6('mean_conf')}, {q6('((m3 / m2 ** 1.5) ** 2 + 1) / (m4 / m2 ** 2 - 3 + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))', 'bimodality')} FROM c WHERE n >= 30""")
def stance_distribution(spark, d):
    s = (F.col("p_pro") - F.col("p_anti")) / (F.col("p_anti") + F.col("p_neutral") + F.col("p_pro"))
    i = items(spark, d).withColumn("s", s)
    return rounded(S.distribution_profile(i, "s", ["community"], extra_means={"mean_conf": F.col("conf")}))


@query("O-153", sql=f"""WITH r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS width FROM events),
  b AS (SELECT event_type, CAST(least(floor((value - lo) / width), 19) AS BIGINT) AS bin, count(*) AS n FROM events, r GROUP BY ALL)
  SELECT event_type, bin, n, {q6('n / (sum(n) OVER (PARTITION BY event_type) * width)', 'density')}, {q6('lo + bin * width', 'bin_start')} FROM b, r""")
def value_densities(spark, d):
    return rounded(S.density_by_period(table(spark, d, "events"), "value", ["event_type"], 20))


CONF_SQL = f"{SQL_ITEMS}, cell AS (SELECT truth, stance, sum(w) AS w FROM items GROUP BY ALL), lab AS (SELECT unnest(['anti', 'neutral', 'pro', 'off-topic']) AS label)"
PER_SQL = """SELECT label, sum(CASE WHEN truth = label AND stance = label THEN w ELSE 0 END) AS tp, sum(CASE WHEN truth = label THEN w ELSE 0 END) AS support,
  sum(CASE WHEN stance = label THEN w ELSE 0 END) AS predicted FROM cell, lab"""


def item_confusion(spark, d):
    return S.confusion(items(spark, d), "truth", "stance", F.col("w"))


@query("O-154", sql=f"""WITH {CONF_SQL}, p AS ({PER_SQL} GROUP BY label) SELECT label, support, predicted, {q6('tp / predicted', 'precision')}, {q6('tp / support', 'recall')}, {q6('2 * tp / (support + predicted)', 'f1')} FROM p""")
def class_scores(spark, d):
    return rounded(S.class_metrics(item_confusion(spark, d), "truth", "stance", STANCES))


@query("O-154", sql=f"""WITH {CONF_SQL}, p AS ({PER_SQL} GROUP BY label), s AS ({PER_SQL} WHERE label <> 'off-topic' AND truth <> 'off-topic' GROUP BY label)
  SELECT {q6('avg(2 * tp / (support + predicted))', 'macro_f1')}, {q6('avg(tp / support)', 'balanced_accuracy')}, {q6('(SELECT sum(CASE WHEN truth = stance THEN w END) / sum(w) FROM cell)', 'accuracy')},
  {q6('(SELECT avg(2 * tp / (support + predicted)) FROM s)', 'macro_f1_subset')} FROM p""")
def macro_scores(spark, d):
    return rounded(S.macro_metrics(item_confusion(spark, d), "truth", "stance", STANCES, STANCES[:3]))


@query("O-154", sql=f"WITH {CONF_SQL} SELECT truth, stance, w, {q6('w / sum(w) OVER (PARTITION BY truth)', 'share')} FROM cell")
def normalized_confusion(spark, d):
    return rounded(S.normalized_confusion(item_confusion(spark, d), "truth"))


@query("O-155", sql=f"""WITH {SQL_ITEMS}, l AS (SELECT unnest(['anti', 'neutral', 'pro', 'off-topic']) AS label, unnest([p_anti, p_neutral, p_pro, p_off_topic]) AS s, truth, w FROM items),
  g AS (SELECT label, s, sum(CASE WHEN truth = label THEN w ELSE 0 END) AS tp, sum(w) AS n FROM l GROUP BY ALL),
  c AS (SELECT label, tp, sum(tp) OVER o AS ctp, sum(n) OVER o AS cn, sum(tp) OVER (PARTITION BY label) AS t FROM g WINDOW o AS (PARTITION BY label ORDER BY s DESC))
  SELECT label, {q6('sum(tp / t * ctp / cn)', 'average_precision')} FROM c GROUP BY label""")
def average_precision(spark, d):
    return rounded(S.average_precision(items(spark, d), "truth", dict(zip(STANCES, SCORES)), F.col("w")))


REPLICATES = 200


def draws_sql(rows: str, key: str) -> str:
    """CTEs that give each row of ``rows`` its draws ``k`` in each replicate, by the hash of operators/resampling.py."""
    a, b, c, e = Rs.FACTORS
    p = Rs.PRIME
    return f"""h0 AS (SELECT *, (({key}) % {p} * {a} + rep * {b}) % {p} AS x FROM {rows}, (SELECT unnest(range(1, {REPLICATES + 1})) AS rep)),
  h1 AS (SELECT *, x * x % {p} AS x2 FROM h0), h2 AS (SELECT * EXCLUDE (x, x2), (x2 * x2 % {p} * x % {p} * {c} + rep * {e}) % {p} AS x FROM h1),
  h3 AS (SELECT *, x * x % {p} AS x2 FROM h2), drawn AS (SELECT * EXCLUDE (x, x2), len(list_filter({Rs.BOUNDS}, lambda t: t <= x2 * x2 % {p} * x % {p})) AS k FROM h3)"""


F1_SQL = f"""{SQL_ITEMS}, named AS (SELECT id, truth, stance, CASE WHEN id % 3 = 0 THEN truth ELSE stance END AS other, w FROM items), {draws_sql('named', 'id')},
  lab AS (SELECT unnest(['anti', 'neutral', 'pro', 'off-topic']) AS label), size AS (SELECT truth, count(*) AS n FROM named GROUP BY 1),
  got AS (SELECT rep, truth, sum(k) AS kn, sum(k * w) AS kw FROM drawn GROUP BY ALL), sc AS (SELECT rep, truth, n / nullif(kn, 0) AS s, kw FROM got JOIN size USING (truth)),
  ok AS (SELECT rep FROM sc GROUP BY rep HAVING count(s) = (SELECT count(*) FROM size)),
  cell AS (SELECT rep, 'stance' AS model, truth, stance AS pred, sum(k * w) AS m FROM drawn GROUP BY ALL UNION ALL SELECT rep, 'other', truth, other, sum(k * w) FROM drawn GROUP BY ALL),
  part AS (SELECT rep, model, lab.label, sum(CASE WHEN truth = label AND pred = label THEN s * m ELSE 0 END) AS hit, sum(CASE WHEN pred = label THEN s * m ELSE 0 END) AS said,
    sum(CASE WHEN truth = label THEN s * m ELSE 0 END) AS held FROM cell JOIN sc USING (rep, truth) JOIN ok USING (rep), lab GROUP BY ALL),
  f AS (SELECT rep, model, avg(CASE WHEN said + held > 0 THEN 2 * hit / (said + held) ELSE 0 END) AS macro_f1 FROM part GROUP BY ALL)"""


def interval_sql(value: str) -> str:
    return f"{q6(f'avg({value})', 'mean_value')}, {q6(f'quantile_cont({value}, 0.025)', 'low')}, {q6(f'quantile_cont({value}, 0.975)', 'high')}, count(*) AS replicates"


def _bootstrap(spark, d):
    i = items(spark, d).withColumn("other", F.when(F.col("id") % 3 == 0, F.col("truth")).otherwise(F.col("stance")))
    return Rs.bootstrap_f1(i, "truth", ["stance", "other"], STANCES, "w", replicates=REPLICATES, key="id")


@query("O-156", sql=f"WITH {F1_SQL} SELECT model, {interval_sql('macro_f1')} FROM f GROUP BY model")
def bootstrap_intervals(spark, d):
    return rounded(S.bootstrap_interval(_bootstrap(spark, d)))


@query("O-156", sql=f"""WITH {F1_SQL}, x AS (SELECT rep, max(CASE WHEN model = 'other' THEN macro_f1 END) - max(CASE WHEN model = 'stance' THEN macro_f1 END) AS diff FROM f GROUP BY rep),
  o AS (SELECT 'other - stance' AS model, {interval_sql('diff')}, {q6('least(2 * least(avg((diff <= 0)::INT), avg((diff >= 0)::INT)), 1)', 'p_value')} FROM x)
  SELECT *, low > 0 OR high < 0 AS is_significant FROM o""")
def paired_bootstrap(spark, d):
    return rounded(S.paired_difference(_bootstrap(spark, d), "other", "stance"))


RATE_SQL = """rate AS (SELECT doc_id, unnest(['ann', 'ben', 'cy']) AS rater, unnest([CASE WHEN toxic = 1 THEN 'anti' WHEN quality = 1 THEN 'pro' ELSE 'neutral' END,
  CASE WHEN n_chars > 3000 THEN 'pro' WHEN n_chars < 600 THEN 'anti' ELSE 'neutral' END, CASE WHEN quality = 1 AND doc_id % 3 > 0 THEN 'pro' WHEN n_chars < 900 THEN 'anti' ELSE 'neutral' END]) AS label
  FROM labels JOIN documents USING (doc_id))"""
ORDINAL = ["anti", "neutral", "pro"]


def ratings(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    q, n = F.col("quality") == 1, F.col("n_chars")
    ann = F.when(F.col("toxic") == 1, "anti").when(q, "pro").otherwise("neutral")
    ben = F.when(n > 3000, "pro").when(n < 600, "anti").otherwise("neutral")
    cy = F.when(q & (F.col("doc_id") % 3 > 0), "pro").when(n < 900, "anti").otherwise("neutral")
    return t.select("doc_id", F.inline(F.array(*[F.struct(F.lit(r).alias("rater"), l.alias("label")) for r, l in (("ann", ann), ("ben", ben), ("cy", cy))])))


@query("O-157", sql=f"""WITH {RATE_SQL}, p AS (SELECT a.rater || ' vs ' || b.rater AS pair, a.label AS x, b.label AS y FROM rate a JOIN rate b USING (doc_id) WHERE a.rater < b.rater),
  n AS (SELECT pair, count(*) AS n_items, avg((x = y)::INT) AS po FROM p GROUP BY 1), mx AS (SELECT pair, x AS l, count(*) AS c FROM p GROUP BY ALL), my AS (SELECT pair, y AS l, count(*) AS c FROM p GROUP BY ALL),
  e AS (SELECT pair, sum(mx.c * my.c) AS e FROM mx JOIN my USING (pair, l) GROUP BY 1)
  SELECT pair, n_items, {q6('po', 'raw_agreement')}, {q6('(po - e / n_items / n_items) / (1 - e / n_items / n_items)', 'cohen_kappa')} FROM n JOIN e USING (pair)""")
def rater_pairs(spark, d):
    t = S.rating_table(ratings(spark, d), "doc_id", "rater", "label", ["ann", "ben", "cy"])
    return rounded(S.cohen_pairwise(t, ["ann", "ben", "cy"]))


@query("O-157", sql=f"""WITH {RATE_SQL}, u AS (SELECT doc_id, label, count(*) AS c FROM rate GROUP BY ALL), m AS (SELECT doc_id, sum(c) AS m FROM u GROUP BY 1),
  pi AS (SELECT avg(s) AS p FROM (SELECT doc_id, sum(c * (c - 1)) / any_value(m * (m - 1)) AS s FROM u JOIN m USING (doc_id) GROUP BY doc_id)),
  nl AS (SELECT label, sum(c) AS n, row_number() OVER (ORDER BY label) AS i FROM u GROUP BY 1), tot AS (SELECT sum(n) AS n FROM nl), pe AS (SELECT sum((nl.n / tot.n) ** 2) AS e FROM nl, tot),
  o AS (SELECT a.label AS x, b.label AS y, sum(a.c * b.c / (m - 1)) AS o FROM u a JOIN u b USING (doc_id) JOIN m USING (doc_id) WHERE a.label <> b.label GROUP BY ALL),
  d AS (SELECT a.label AS x, b.label AS y, a.n * b.n AS e, ((SELECT sum(g.n) FROM nl g WHERE g.i BETWEEN least(a.i, b.i) AND greatest(a.i, b.i)) - (a.n + b.n) / 2) ** 2 AS d2 FROM nl a JOIN nl b ON a.label <> b.label)
  SELECT (SELECT count(*) FROM m) AS n_items, {q6('(any_value(p) - any_value(pe.e)) / (1 - any_value(pe.e))', 'fleiss_kappa')},
    {q6('1 - (any_value(tot.n) - 1) * sum(coalesce(o, 0)) / sum(d.e)', 'alpha_nominal')}, {q6('1 - (any_value(tot.n) - 1) * sum(coalesce(o, 0) * d2) / sum(d.e * d2)', 'alpha_ordinal')}
  FROM d LEFT JOIN o USING (x, y), pi, pe, tot""")
def rater_agreement(spark, d):
    return rounded(S.multi_rater_agreement(ratings(spark, d), "doc_id", "label", ORDINAL))


@query("O-156", "O-157", sql=f"""WITH {RATE_SQL}, p AS (SELECT a.doc_id, a.rater || ' vs ' || b.rater AS pair, a.label AS one, b.label AS two FROM rate a JOIN rate b USING (doc_id) WHERE a.rater < b.rater), {draws_sql('p', 'doc_id')},
  n AS (SELECT rep, pair, sum(k) AS n, sum(CASE WHEN one = two THEN k ELSE 0 END) AS same FROM drawn GROUP BY ALL), mx AS (SELECT rep, pair, one AS l, sum(k) AS c FROM drawn GROUP BY ALL), my AS (SELECT rep, pair, two AS l, sum(k) AS c FROM drawn GROUP BY ALL),
  e AS (SELECT rep, pair, sum(mx.c * my.c) AS e FROM mx JOIN my USING (rep, pair, l) GROUP BY ALL), v AS (SELECT rep, pair AS model, (same / n - coalesce(e, 0) / n / n) / nullif(1 - coalesce(e, 0) / n / n, 0) AS value FROM n LEFT JOIN e USING (rep, pair) WHERE n > 0)
  SELECT model, {interval_sql('value')} FROM v WHERE value IS NOT NULL GROUP BY model""")
def kappa_intervals(spark, d):
    t = S.rating_table(ratings(spark, d), "doc_id", "rater", "label", ["ann", "ben", "cy"])
    return rounded(S.bootstrap_interval(Rs.bootstrap_kappa(t, "doc_id", ["ann", "ben", "cy"], ORDINAL, replicates=REPLICATES), "value"))


@query("O-156", "O-157", sql=f"""WITH {RATE_SQL}, u AS (SELECT doc_id, count(*) FILTER (label = 'anti')::DOUBLE AS c0, count(*) FILTER (label = 'neutral')::DOUBLE AS c1, count(*) FILTER (label = 'pro')::DOUBLE AS c2, count(*)::DOUBLE AS m FROM rate GROUP BY 1),
  {draws_sql('u', 'doc_id')}, s AS (SELECT rep, sum(k * (c0 * (c0 - 1) + c1 * (c1 - 1) + c2 * (c2 - 1)) / (m * (m - 1))) / sum(k) AS p, sum(k * m) AS n, sum(k * c0) AS n0, sum(k * c1) AS n1, sum(k * c2) AS n2,
    2 * sum(k * c0 * c1 / (m - 1)) AS o01, 2 * sum(k * c0 * c2 / (m - 1)) AS o02, 2 * sum(k * c1 * c2 / (m - 1)) AS o12 FROM drawn GROUP BY rep),
  z AS (SELECT *, (n0 * n0 + n1 * n1 + n2 * n2) / n / n AS e, ((n0 + n1) / 2) ** 2 AS d01, ((n1 + n2) / 2) ** 2 AS d12, (n1 + (n0 + n2) / 2) ** 2 AS d02 FROM s),
  v AS (SELECT 'fleiss_kappa' AS model, (p - e) / nullif(1 - e, 0) AS value FROM z UNION ALL SELECT 'alpha_nominal', 1 - (n - 1) * (o01 + o02 + o12) / nullif(2 * (n0 * n1 + n0 * n2 + n1 * n2), 0) FROM z
    UNION ALL SELECT 'alpha_ordinal', 1 - (n - 1) * (o01 * d01 + o02 * d02 + o12 * d12) / nullif(2 * (n0 * n1 * d01 + n0 * n2 * d02 + n1 * n2 * d12), 0) FROM z)
  SELECT model, {interval_sql('value')} FROM v WHERE value IS NOT NULL GROUP BY model""")
def agreement_intervals(spark, d):
    return rounded(S.bootstrap_interval(Rs.bootstrap_agreement(ratings(spark, d), "doc_id", "label", ORDINAL, replicates=REPLICATES), "value"))


@query("O-158", sql=f"""WITH {CELLS_SQL} SELECT cell, count(*) AS n_items, {q6("avg((CASE WHEN id % 2 = 0 THEN truth ELSE stance END = stance)::INT)", 'first_right')},
  {q6("avg((CASE WHEN id % 2 = 0 THEN truth ELSE stance END = truth)::INT)", 'second_right')} FROM cells GROUP BY 1""")
def label_head_to_head(spark, d):
    ref = F.when(F.col("id") % 2 == 0, F.col("truth")).otherwise(F.col("stance"))
    return rounded(S.head_to_head(item_cells(spark, d), "cell", {"first": ref == F.col("stance"), "second": ref == F.col("truth")}))


@query("O-166", sql=f"""WITH {SQL_ITEMS}, f AS (SELECT community AS model, id % 5 AS fold, avg((stance = truth)::INT) AS acc FROM items GROUP BY ALL)
  SELECT model, count(*) AS n_folds, {q6('avg(acc)', 'acc_mean')}, {q6('stddev_samp(acc)', 'acc_std')} FROM f GROUP BY 1""")
def fold_summaries(spark, d):
    f = items(spark, d).groupBy(F.col("community").alias("model"), (F.col("id") % 5).alias("fold")).agg(F.avg((F.col("stance") == F.col("truth")).cast("double")).alias("acc"))
    return rounded(S.fold_mean_std(f, "model", ["acc"]))


@query("O-73", sql=f"""WITH {SQL_ITEMS} SELECT community, kind, count(*) AS row_count, count(*) FILTER (WHERE conf > 0.6) AS flagged_count, {q6('count(*) FILTER (WHERE conf > 0.6) / count(*)', 'prevalence')} FROM items GROUP BY ALL""")
def slice_prevalence(spark, d):
    return rounded(S.prevalence_by_slice(items(spark, d), F.col("conf") > 0.6, ["community", "kind"]))


@query("O-73", sql=f"""WITH {SQL_ITEMS}, s AS (SELECT community || '/' || kind AS name, count(*) FILTER (WHERE conf > 0.6) / count(*) AS p FROM items GROUP BY ALL)
  SELECT {q6('min(p)', 'min_prevalence')}, {q6('median(p)', 'median_prevalence')}, {q6('max(p)', 'max_prevalence')}, (SELECT name FROM s ORDER BY p, name LIMIT 1) AS min_slice, (SELECT name FROM s ORDER BY p DESC, name DESC LIMIT 1) AS max_slice FROM s""")
def slice_spread(spark, d):
    s = S.prevalence_by_slice(items(spark, d), F.col("conf") > 0.6, ["community", "kind"])
    return rounded(S.slice_spread(s, F.concat_ws("/", "community", "kind")))


@query("O-73", sql=f"""WITH n AS (SELECT user_id, count(*) AS n FROM events WHERE value > 100 GROUP BY 1), h AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS r FROM n), t AS (SELECT sum(n) AS t FROM n)
  SELECT max(CASE WHEN r = 1 THEN user_id END) AS top_value, max(n) AS top_count, CAST(sum(n) AS BIGINT) AS top_k_count, {q6('max(n) / any_value(t)', 'top_share')}, {q6('sum(n) / any_value(t)', 'top_k_share')} FROM h, t WHERE r <= 5""")
def flag_concentration(spark, d):
    return rounded(S.concentration(table(spark, d, "events"), F.col("value") > 100, "user_id"))
