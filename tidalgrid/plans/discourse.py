"""Text, thread and rollup queries."""

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import labels as L
from ..functions import text as X
from ..operators import discourse as D
from ..operators import folds as Fo
from ..operators import threads as T
from ..operators import windows as Wn
from ..session import reliable_checkpoint
from .base import q6, rounded, table
from .registry import Family

FAMILY = Family()
query = FAMILY.query

STANCES = ["anti", "neutral", "pro", "off-topic"]
SCORES = ["p_anti", "p_neutral", "p_pro", "p_off_topic"]

SQL_ITEMS = """raw AS (SELECT *, ((event_id * 7 + user_id) % 11 + 1)::DOUBLE AS a, ((event_id * 3) % 7 + 1)::DOUBLE AS b,
    ((user_id * 5 + event_id) % 13 + 1)::DOUBLE AS c, (event_id % 4 + 1)::DOUBLE AS e, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM events),
  items AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'post' ELSE 'comment' END AS kind, event_type AS community, CAST(l AS DATE) AS date, hour(l) AS hour,
    a / (a + b + c + e) AS p_anti, b / (a + b + c + e) AS p_neutral, c / (a + b + c + e) AS p_pro, e / (a + b + c + e) AS p_off_topic,
    CASE WHEN a >= b AND a >= c AND a >= e THEN 'anti' WHEN b >= c AND b >= e THEN 'neutral' WHEN c >= e THEN 'pro' ELSE 'off-topic' END AS stance,
    greatest(a, b, c, e) / (a + b + c + e) AS conf, CASE (event_id * 13 + user_id) % 4 WHEN 0 THEN 'anti' WHEN 1 THEN 'neutral' WHEN 2 THEN 'pro' ELSE 'off-topic' END AS truth,
    (1 + user_id % 3)::DOUBLE AS w FROM raw)"""


def items(spark, d):
    """Events as predicted items of a discussion, in local time."""
    e = table(spark, d, "events")
    parts = [
        (F.col("event_id") * 7 + F.col("user_id")) % 11 + 1,
        (F.col("event_id") * 3) % 7 + 1,
        (F.col("user_id") * 5 + F.col("event_id")) % 13 + 1,
        F.col("event_id") % 4 + 1,
    ]
    total = sum(parts[1:], parts[0]).cast("double")
    local = C.utc_to_local(F.col("ts"))
    out = e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 5 == 0, "post").otherwise("comment").alias("kind"),
        F.col("event_type").alias("community"),
        F.to_date(local).alias("date"),
        F.hour(local).alias("hour"),
        F.element_at(F.array(*[F.lit(s) for s in STANCES]), ((F.col("event_id") * 13 + F.col("user_id")) % 4 + 1).cast("int")).alias("truth"),
        (1 + F.col("user_id") % 3).cast("double").alias("w"),
        *[(p / total).alias(n) for p, n in zip(parts, SCORES)],
    )
    label, conf = L.argmax_label(STANCES, SCORES)
    return out.withColumns({"stance": label, "conf": conf})


@query(
    "O-145", "O-146",
    sql=f"""WITH {SQL_ITEMS} SELECT id, stance, {q6('conf')}, {q6('(p_pro - p_anti) / (p_anti + p_neutral + p_pro)', 'soft_net')},
      {q6('-(p_anti / m * log2(p_anti / m) + p_neutral / m * log2(p_neutral / m) + p_pro / m * log2(p_pro / m))', 'entropy')}
      FROM (SELECT *, p_anti + p_neutral + p_pro AS m FROM items)""",
)
def item_scores(spark, d):
    i = items(spark, d)
    c = [F.col(x) for x in ("p_anti", "p_neutral", "p_pro")]
    return rounded(i.select("id", "stance", "conf", L.soft_net(c[2], c[0], c[1]).alias("soft_net"), L.entropy_bits(*c).alias("entropy")))


@query(
    "O-68",
    sql=f"""WITH {SQL_ITEMS} SELECT community, strftime(date, '%Y-%m-%d') AS date, hour, stance, kind, count(*) AS n,
      {q6('sum(p_anti)', 'sum_p_anti')}, {q6('sum(p_pro)', 'sum_p_pro')} FROM items GROUP BY ALL""",
)
def hourly_stance_rollup(spark, d):
    return rounded(D.hourly_rollup(items(spark, d), ["community", "stance", "kind"], ["p_anti", "p_pro"]))


@query(
    "O-69", "O-33",
    sql=f"""WITH {SQL_ITEMS} SELECT strftime(date_trunc('week', date), '%Y-%m-%d') AS period_start, community, stance, count(*) AS n FROM items GROUP BY ALL""",
)
def weekly_stance_counts(spark, d):
    return rounded(D.reaggregate(D.hourly_rollup(items(spark, d), ["community", "stance"]), "weekly", ["community", "stance"]))


@query(
    "O-69", "O-31",
    sql=f"""WITH {SQL_ITEMS} SELECT CASE WHEN hour >= 6 AND hour < 12 THEN 'morning' WHEN hour >= 12 AND hour < 17 THEN 'afternoon'
      WHEN hour >= 17 AND hour < 22 THEN 'evening' ELSE 'overnight' END AS daypart, stance, count(*) AS n FROM items GROUP BY ALL""",
)
def daypart_stance_counts(spark, d):
    return D.reaggregate(D.hourly_rollup(items(spark, d), ["stance"]), "daypart", ["stance"])


SHARES_SQL = f"""{SQL_ITEMS}, s AS (SELECT date, community, count(*) FILTER (WHERE stance = 'anti') AS n_anti, count(*) FILTER (WHERE stance = 'neutral') AS n_neutral,
  count(*) FILTER (WHERE stance = 'pro') AS n_pro FROM items WHERE stance <> 'off-topic' GROUP BY ALL), t AS (SELECT *, n_anti + n_neutral + n_pro AS n_total FROM s)"""


@query(
    "O-70", "O-148",
    sql=f"""WITH {SHARES_SQL}, p AS (SELECT *, n_pro / n_total AS sp, n_anti / n_total AS sa FROM t) SELECT strftime(date, '%Y-%m-%d') AS period_start, community, n_anti, n_neutral, n_pro, n_total,
      {q6('sa', 'share_anti')}, {q6('n_neutral / n_total', 'share_neutral')}, {q6('sp', 'share_pro')}, {q6('sp - sa', 'net')},
      {q6('sp - sa - 1.96 * sqrt(greatest((sp + sa - (sp - sa) ** 2) / n_total, 0))', 'net_low')}, {q6('sp - sa + 1.96 * sqrt(greatest((sp + sa - (sp - sa) ** 2) / n_total, 0))', 'net_high')},
      {q6('(sp + 3.8416 / (2 * n_total) - 1.96 * sqrt(sp * (1 - sp) / n_total + 3.8416 / (4 * n_total * n_total))) / (1 + 3.8416 / n_total)', 'pro_low')},
      {q6('least((sp + 3.8416 / (2 * n_total) + 1.96 * sqrt(sp * (1 - sp) / n_total + 3.8416 / (4 * n_total * n_total))) / (1 + 3.8416 / n_total), 1)', 'pro_high')} FROM p""",
)
def daily_stance_shares(spark, d):
    daily = D.reaggregate(D.hourly_rollup(items(spark, d), ["community", "stance"]), "daily", ["community", "stance"])
    out = D.stance_shares(daily, ["period_start", "community"])
    lo, hi = L.net_interval(F.col("share_pro"), F.col("share_anti"), F.col("n_total"))
    wlo, whi = L.wilson_interval(F.col("n_pro"), F.col("n_total"))
    return rounded(out.withColumns({"net_low": lo, "net_high": hi, "pro_low": wlo, "pro_high": whi}))


@query(
    "O-71",
    sql=f"""WITH {SQL_ITEMS}, a AS (SELECT date_trunc('month', date) AS m, community, count(*) AS n FROM items WHERE stance IN ('pro', 'anti') GROUP BY ALL),
      b AS (SELECT date_trunc('month', date) AS m, community, count(*) AS n FROM items GROUP BY ALL)
      SELECT strftime(m, '%Y-%m-%d') AS period_start, community, a.n AS n_topic, b.n AS n_total, {q6('a.n / b.n', 'share_topic')} FROM a LEFT JOIN b USING (m, community)""",
)
def share_of_conversation(spark, d):
    roll = D.hourly_rollup(items(spark, d), ["community", "stance"])
    topic = D.reaggregate(roll.where(F.col("stance").isin("pro", "anti")), "monthly", ["community"])
    total = D.reaggregate(roll, "monthly", ["community"])
    return rounded(D.share_of_conversation(topic, total, ["period_start", "community"]))


@query(
    "O-72",
    sql=f"""WITH {SQL_ITEMS}, m AS (SELECT CAST(ts AS DATE) AS date, count(*) AS events, count(*) FILTER (WHERE value > 100) AS strong_events, avg(value) AS mean_value FROM events WHERE event_type = 'purchase' GROUP BY 1),
      r AS (SELECT date, count(*) AS posts, count(*) FILTER (WHERE stance = 'anti') AS anti_count, avg(p_anti) AS anti_share, avg(p_pro) AS pro_share FROM items GROUP BY 1)
      SELECT strftime(date, '%Y-%m-%d') AS date, events, strong_events, {q6('mean_value')}, posts, anti_count, {q6('anti_share')}, {q6('pro_share')} FROM m JOIN r USING (date)""",
)
def daily_tracks_joined(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").withColumn("date", F.to_date("ts"))
    mob = D.daily_summary(e, counts={"strong_events": F.col("value") > 100}, means={"mean_value": F.col("value")}, n="events")
    talk = D.daily_summary(
        items(spark, d), counts={"anti_count": F.col("stance") == "anti"}, means={"anti_share": F.col("p_anti"), "pro_share": F.col("p_pro")}, n="posts"
    )
    return rounded(mob.join(talk, "date"))


# ---- text ---------------------------------------------------------------------------------------


@query(
    "O-37", "O-39", "O-40", "O-41",
    sql="""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '[removed]' WHEN doc_id % 19 = 0 THEN ' https://x.org/' || doc_id WHEN doc_id % 23 = 0 THEN '?! ...' ELSE text END AS body FROM documents),
      c AS (SELECT doc_id, body, CASE WHEN trim(body) IN ('[removed]', '[deleted]', '[deleted by user]', '[ Removed by Reddit ]') THEN '' ELSE body END AS clean FROM t)
      SELECT doc_id, CASE WHEN trim(body) IN ('', '[removed]', '[deleted]') THEN 'removed' WHEN trim(regexp_replace(trim(body), 'https?://\\S+', '', 'g')) = '' THEN 'url_only'
        WHEN NOT regexp_matches(body, '[\\p{L}\\p{N}]') THEN 'symbols_only' END AS no_signal,
        md5(CASE WHEN length(trim(clean)) <= 40 THEN trim(clean) ELSE substr(trim(clean), 1, 40) || ' …[trunc]' END) AS short_hash,
        CASE WHEN trim(clean) = '' THEN 0 ELSE length(trim(clean)) - length(replace(trim(clean), chr(10), '')) + 1 END AS lines,
        length(trim(clean)) AS chars, round(ln(1 + length(trim(clean))) + 1e-9, 6) + 0.0 AS log_chars FROM c""",
)
def text_shapes(spark, d):
    t = table(spark, d, "documents")
    i = F.col("doc_id")
    body = F.when(i % 17 == 0, "[removed]").when(i % 19 == 0, F.concat(F.lit(" https://x.org/"), i)).when(i % 23 == 0, "?! ...").otherwise(F.col("text"))
    clean = X.clean_removed(body)
    return rounded(
        t.select(
            "doc_id",
            X.no_signal_reason(body).alias("no_signal"),
            F.md5(X.truncated(clean, 40)).alias("short_hash"),
            X.line_count(clean).alias("lines"),
            X.char_count(clean).alias("chars"),
            F.log1p(X.char_count(clean)).alias("log_chars"),
        )
    )


STRICT = [r"nicht \w+ der", r"and the"]
BROAD = [r"nicht", r" the ", r" les "]


@query(
    "O-38",
    sql="""SELECT doc_id, regexp_matches(text, '(?i)(?:nicht \\w+ der|and the)') AS is_tier1, regexp_matches(text, '(?i)(?:nicht| the | les )') AS is_candidate FROM documents""",
)
def lexical_nets(spark, d):
    strict, broad = X.lexical_nets(F.col("text"), STRICT, BROAD)
    return table(spark, d, "documents").select("doc_id", strict.alias("is_tier1"), broad.alias("is_candidate"))


@query(
    "O-42",
    sql="""WITH k AS (SELECT event_id, event_id % 8 AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
      SELECT event_id, CASE v WHEN 0 THEN 'empty' WHEN 1 THEN 'malformed' WHEN 2 THEN 'missing_fields' ELSE '' END AS fail_reason,
        (CASE WHEN v > 2 THEN k % 2 = 1 END)::VARCHAR AS about_topic, CASE WHEN v > 2 THEN CASE WHEN k % 3 = 0 THEN 'pro' WHEN k % 3 = 1 THEN 'anti' ELSE 'NA' END END AS stance,
        CASE WHEN v > 2 THEN round(least(k / 80.0, 1) + 1e-9, 6) + 0.0 END AS confidence FROM k""",
)
def parsed_labels(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    v = F.col("event_id") % 8
    obj = F.format_string(
        '{"about_topic": %d, "stance": "%s", "confidence": %s}', (k % 2).cast("int"),
        F.when(k % 3 == 0, "PRO").when(k % 3 == 1, "anti").otherwise("odd"), (k / 80.0).cast("string"),
    )
    text = (
        F.when(v == 0, "[]").when(v == 1, "no label").when(v == 2, '{"stance": "pro"}')
        .when(v == 3, F.concat(F.lit("["), obj, F.lit("]"))).when(v == 4, F.concat(F.lit("Sure: "), obj, F.lit(" done"))).otherwise(obj)
    )
    out = X.parse_labels(e.select("event_id", text.alias("reply")), "reply")
    return rounded(out.select("event_id", "fail_reason", F.col("about_topic").cast("string").alias("about_topic"), "stance", "confidence"))


@query(
    "O-44",
    sql="""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pro' WHEN 1 THEN 'anti' WHEN 5 THEN 'off-topic' ELSE 'neutral' END AS label,
      CASE doc_id % 4 WHEN 0 THEN 'NYC citywide' WHEN 1 THEN 'Manhattan core' WHEN 2 THEN 'Transit / cycling' ELSE 'Unmapped' END AS geo_tier,
      CASE doc_id % 4 WHEN 1 THEN 'Non-CBD' END AS cbd_zone, CASE doc_id % 4 WHEN 2 THEN 'partial' ELSE 'false' END AS is_topical FROM documents""",
)
def mapped_labels(spark, d):
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % n + 1).cast("int"))
    t = table(spark, d, "documents").select(
        "doc_id", pick(["pro", "anti", "neutral", "mixed", "unsure", "NA"], 6).alias("raw"), pick(["AskNYC", "Harlem", "NJTransit", "elsewhere"], 4).alias("sub")
    )
    return L.add_geography(t.withColumn("label", L.collapse_label(F.col("raw"))), "sub").drop("raw", "sub")


@query(
    "O-45",
    sql="""WITH y AS (SELECT l_suppkey, count(DISTINCT year(l_shipdate)) AS years, max(l_quantity) / min(l_quantity) AS ratio, count(*) AS n FROM lineitem GROUP BY 1),
      s AS (SELECT *, CASE WHEN years < 7 THEN 'Not enough history' WHEN ratio < 2 THEN 'High Stability' WHEN ratio < 50 THEN 'Moderate Stability' ELSE 'Low Stability' END AS stability FROM y)
      SELECT l_suppkey, stability, CASE WHEN n >= 600 AND stability IN ('High Stability', 'Moderate Stability') THEN 'Reliable' WHEN n >= 600 AND stability = 'Low Stability' THEN 'Covered but unstable' ELSE 'Not reliable' END AS tier FROM s""",
)
def reliability_tiers(spark, d):
    y = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.countDistinct(F.year("l_shipdate")).alias("years"), (F.max("l_quantity") / F.min("l_quantity")).alias("ratio"), F.count(F.lit(1)).alias("n")
    )
    s = y.withColumn(
        "stability",
        L.first_match([(F.col("years") < 7, "Not enough history"), (F.col("ratio") < 2, "High Stability"), (F.col("ratio") < 50, "Moderate Stability")], "Low Stability"),
    )
    covered, st = F.col("n") >= 600, F.col("stability")
    tier = L.first_match([(covered & st.isin("High Stability", "Moderate Stability"), "Reliable"), (covered & (st == "Low Stability"), "Covered but unstable")], "Not reliable")
    return s.select("l_suppkey", "stability", tier.alias("tier"))


ASPECTS = [("english", "English words", r" the | and "), ("german", "German words", r" der | nicht "), ("numbers", "figures", r"\d{2}")]


@query(
    "O-137",
    sql="""SELECT doc_id, aspect FROM (SELECT doc_id, unnest([CASE WHEN length(trim(text)) > 0 THEN 'any' END, CASE WHEN regexp_matches(lower(text), ' the | and ') THEN 'english' END,
      CASE WHEN regexp_matches(lower(text), ' der | nicht ') THEN 'german' END, CASE WHEN regexp_matches(text, '\\d{2}') THEN 'numbers' END]) AS aspect FROM documents) WHERE aspect IS NOT NULL""",
)
def gated_aspects(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return D.aspect_gates(docs, "text", [("any", "anything", "."), *ASPECTS], ["any"]).drop("text")


LEXICON = [("the", 1.0), ("and", -1.0), ("nicht", -2.0), ("und", 1.0), ("les", 2.0), ("que", -1.0), ("los", 1.0), ("of", 2.0), ("is", -1.0)]


@query(
    "O-138",
    sql="""WITH lex AS (SELECT unnest(['the', 'and', 'nicht', 'und', 'les', 'que', 'los', 'of', 'is']) AS token, unnest([1.0, -1, -2, 1, 2, -1, 1, 2, -1])::DOUBLE AS score),
      tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}'']+')) AS token FROM documents),
      s AS (SELECT d.doc_id, coalesce(r.raw, 0) AS raw FROM documents d LEFT JOIN (SELECT doc_id, sum(score) AS raw FROM tok JOIN lex USING (token) GROUP BY 1) r USING (doc_id))
      SELECT doc_id, raw AS raw_score, round((exp(2 * greatest(least(raw / 5, 20), -20)) - 1) / (exp(2 * greatest(least(raw / 5, 20), -20)) + 1) + 1e-9, 6) + 0.0 AS signed_score,
        CASE WHEN raw > 0.25 THEN 'pos' WHEN raw < -0.25 THEN 'neg' ELSE 'neu' END AS sentiment FROM s""",
)
def lexicon_sentiment(spark, d):
    lex = spark.createDataFrame(LEXICON, "token string, score double")
    docs = table(spark, d, "documents").select("doc_id", "text")
    return rounded(D.lexicon_sentiment(docs, "doc_id", "text", lex).drop("text"))


@query(
    "O-139",
    sql=f"""WITH {SQL_ITEMS}, s AS (SELECT id, list_filter([p_pro - p_anti, CASE WHEN id % 3 > 0 THEN p_neutral END, CASE WHEN id % 2 > 0 THEN conf END], lambda x: x IS NOT NULL) AS xs FROM items)
      SELECT id, {q6('list_avg(xs)', 'ensemble_mean')}, {q6('list_var_pop(xs) ** 0.5', 'ensemble_std')} FROM s""",
)
def ensemble_scores(spark, d):
    mean, std = D.ensemble_score(F.col("p_pro") - F.col("p_anti"), F.when(F.col("id") % 3 > 0, F.col("p_neutral")), F.when(F.col("id") % 2 > 0, F.col("conf")))
    return rounded(items(spark, d).select("id", mean.alias("ensemble_mean"), std.alias("ensemble_std")))


@query(
    "O-140",
    sql="""WITH i AS (SELECT doc_id, n_chars > 2000 AS old, doc_id % 9 = 0 AS tier1 FROM documents), v AS (SELECT doc_id, quality = 1 AS topic, 1 AS version FROM labels UNION ALL SELECT doc_id, toxic = 1, 2 FROM labels WHERE doc_id % 2 = 0),
      n AS (SELECT doc_id, arg_max(topic, version) AS topic FROM v GROUP BY 1), s AS (SELECT i.doc_id, tier1, coalesce(topic, old) AS is_relevant FROM i LEFT JOIN n USING (doc_id)) SELECT * FROM s WHERE is_relevant OR tier1""",
)
def relevant_items(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 2000).alias("is_relevant"), (F.col("doc_id") % 9 == 0).alias("tier1"))
    l = table(spark, d, "labels")
    labels = l.select("doc_id", (F.col("quality") == 1).alias("about_topic"), F.lit(1).alias("version")).unionByName(
        l.where("doc_id % 2 = 0").select("doc_id", (F.col("toxic") == 1).alias("about_topic"), F.lit(2).alias("version"))
    )
    return D.relevance_gate(docs, labels, "doc_id", "tier1")


CELLS_SQL = f"""{SQL_ITEMS}, cells AS (SELECT *, CASE WHEN (stance = 'off-topic') <> (truth = 'off-topic') THEN 'D_topic' WHEN stance = truth THEN 'A_agree'
  WHEN (stance = 'pro' AND truth = 'anti') OR (stance = 'anti' AND truth = 'pro') THEN 'D_flip' ELSE 'D_stance' END AS cell FROM items)"""


def item_cells(spark, d):
    on = lambda c: F.col(c) != "off-topic"
    return items(spark, d).withColumn("cell", D.disagreement_cell(on("stance"), F.col("stance"), on("truth"), F.col("truth")))


@query("O-141", sql=f"WITH {CELLS_SQL} SELECT cell, kind, count(*) AS n FROM cells GROUP BY ALL")
def disagreement_cells(spark, d):
    return item_cells(spark, d).groupBy("cell", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "O-147",
    sql="""WITH t AS (SELECT d.doc_id, text, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN n_chars > 1500 THEN 'good' ELSE 'bad' END AS pred,
        1 - 1.0 / (2 + d.doc_id % 40) AS conf FROM documents d JOIN labels USING (doc_id))
      SELECT doc_id, truth, pred, round(conf + 1e-9, 6) + 0.0 AS conf FROM t WHERE truth <> pred AND conf > 0.9 ORDER BY length(trim(text)) - length(replace(trim(text), chr(10), '')), length(trim(text)), doc_id LIMIT 20""",
)
def confident_mistakes(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    t = t.select(
        "doc_id", "text", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(F.col("n_chars") > 1500, "good").otherwise("bad").alias("pred"),
        (1 - 1.0 / (2 + F.col("doc_id") % 40)).alias("conf"),
    )
    both = ["good", "bad"]
    out = D.confident_errors(t, "truth", "pred", F.col("conf"), both, both, X.line_count(F.col("text")), X.char_count(F.col("text")), "doc_id", 0.9, 20)
    return rounded(out.drop("text"))


# ---- anchors and threads ------------------------------------------------------------------------

@query(
    "O-130",
    sql="""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM u),
      e AS (SELECT vec_id, label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM n), c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM e WHERE label = 3 GROUP BY i))
      SELECT vec_id, round(list_dot_product(u, c) / sqrt(list_dot_product(c, c)) + 1e-9, 6) + 0.0 AS similarity, list_dot_product(u, c) / sqrt(list_dot_product(c, c)) >= 0.45 AS is_semantic_anchor FROM n, c""",
)
def semantic_anchors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return rounded(D.semantic_anchors(e, "embedding", F.col("label") == 3).drop("embedding", "label"))


DETECT_SQL = """lex AS (SELECT DISTINCT conv_id FROM conversations WHERE regexp_matches(text, '(?i)(?:nicht| the | les )')),
  sem AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING sum(length(text)) > 900),
  t1 AS (SELECT DISTINCT conv_id FROM conversations WHERE regexp_matches(text, '(?i)(?:and the|nicht)'))"""


def detectors(spark, d):
    c = table(spark, d, "conversations")
    lex = c.where(X.matches(F.col("text"), BROAD)).select("conv_id").distinct()
    sem = c.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).where("n > 900").select("conv_id")
    t1 = c.where(X.matches(F.col("text"), ["and the", "nicht"])).select("conv_id").distinct()
    return lex, sem, t1


@query("O-74", sql=f"""WITH {DETECT_SQL}, c AS (SELECT (SELECT count(*) FROM lex) AS a, (SELECT count(*) FROM sem) AS b, (SELECT count(*) FROM lex JOIN sem USING (conv_id)) AS m)
  SELECT a AS n_lexical, b AS n_semantic, m AS n_both, a + b - m AS n_union, round(a * b / m) AS estimated_total, round((a + b - m) / (a * b / m), 4) AS estimated_recall FROM c""")
def capture_recapture(spark, d):
    lex, sem, _ = detectors(spark, d)
    return D.capture_recapture(lex, sem, "conv_id")


@query("O-131", sql=f"""WITH {DETECT_SQL} SELECT conv_id, conv_id IN (SELECT conv_id FROM lex) AS is_lexical, conv_id IN (SELECT conv_id FROM sem) AS is_semantic,
  conv_id IN (SELECT conv_id FROM t1) AS is_tier1 FROM (SELECT conv_id FROM lex UNION SELECT conv_id FROM sem)""")
def anchored_threads(spark, d):
    return D.anchored_threads(*detectors(spark, d), "conv_id")


NODES_SQL = """nodes AS (SELECT conv_id, conv_id * 100 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100 + (turn - 1) // 2 END AS parent_id, turn, text,
  CASE WHEN turn % 5 = 4 THEN '[deleted]' ELSE role || '_' || (turn % 4) END AS author, contains(text, ' the ') AND turn > 0 AS anchor FROM conversations)"""


def nodes(spark, d):
    """Conversation turns as a reply tree in which each turn answers an earlier one."""
    c = table(spark, d, "conversations")
    return c.select(
        F.col("conv_id").alias("thread_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 100 + F.floor((F.col("turn") - 1) / 2)).alias("parent_id"),
        "turn",
        F.col("text").alias("body"),
        F.when(F.col("turn") % 5 == 4, "[deleted]").otherwise(F.concat("role", F.lit("_"), (F.col("turn") % 4).cast("string"))).alias("author"),
        (F.contains("text", F.lit(" the ")) & (F.col("turn") > 0)).alias("anchor"),
    )


@query("O-132", sql=f"""WITH RECURSIVE {NODES_SQL}, r AS (SELECT id, id AS root, 0::BIGINT AS depth FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.id, r.root, r.depth + 1 FROM r JOIN nodes n ON n.parent_id = r.id) SELECT id, root, depth FROM r""")
def thread_closure(spark, d):
    return T.roots_and_depths(nodes(spark, d))


@query("O-133", sql=f"""WITH RECURSIVE {NODES_SQL}, anc AS (SELECT id, id AS a FROM nodes UNION ALL SELECT anc.id, n.parent_id FROM anc JOIN nodes n ON n.id = anc.a WHERE n.parent_id IS NOT NULL),
  hit AS (SELECT id FROM nodes WHERE anchor), whole AS (SELECT conv_id FROM nodes WHERE turn = 0 AND contains(text, ' nicht '))
  SELECT id, conv_id AS thread_id FROM nodes WHERE id IN (SELECT a FROM anc WHERE id IN (SELECT id FROM hit)) OR id IN (SELECT id FROM anc WHERE a IN (SELECT id FROM hit))
    OR conv_id IN (SELECT conv_id FROM whole) OR conv_id NOT IN (SELECT conv_id FROM nodes WHERE anchor)""")
def target_scope(spark, d):
    n = nodes(spark, d)
    whole = n.where((F.col("turn") == 0) & F.contains("body", F.lit(" nicht "))).select("thread_id")
    return T.target_scope(n, "anchor", whole_threads=whole).select("id", "thread_id")


@query("O-134", "O-135", sql=f"""WITH RECURSIVE {NODES_SQL}, op AS (SELECT conv_id, author AS op FROM nodes WHERE turn = 0),
  up AS (SELECT id, id AS a, 0 AS hop FROM nodes UNION ALL SELECT up.id, n.parent_id, hop + 1 FROM up JOIN nodes n ON n.id = up.a WHERE n.parent_id IS NOT NULL AND hop < 2),
  ch AS (SELECT up.id, 2 - hop AS pos, hop, n.author, n.text, op.op FROM up JOIN nodes n ON n.id = up.a JOIN op USING (conv_id)),
  fa AS (SELECT id, author, row_number() OVER (PARTITION BY id ORDER BY min(pos)) AS r FROM ch WHERE author <> '[deleted]' AND author <> op GROUP BY id, author),
  ln AS (SELECT ch.id, pos, hop, CASE WHEN ch.author = '[deleted]' THEN '[deleted]' WHEN ch.author = op THEN 'OP' ELSE substr('ABCDEFGHJKLMNPQRSTUVWXYZ', fa.r, 1) END AS tag,
    CASE WHEN length(trim(text)) <= CASE WHEN hop = 0 THEN 120 ELSE 60 END THEN trim(text) ELSE substr(trim(text), 1, CASE WHEN hop = 0 THEN 120 ELSE 60 END) || ' …[trunc]' END AS body
    FROM ch LEFT JOIN fa ON fa.id = ch.id AND fa.author = ch.author)
  SELECT id, md5(coalesce(string_agg('[' || tag || '] ' || body, chr(10) ORDER BY pos) FILTER (WHERE hop > 0), '')) AS context_hash,
    count(*) FILTER (WHERE hop > 0) AS ancestors, max(tag) FILTER (WHERE hop = 0) AS tag, md5(max('[' || tag || '] ' || body) FILTER (WHERE hop = 0)) AS target_hash FROM ln GROUP BY id""")
def item_contexts(spark, d):
    n = nodes(spark, d)
    op = n.where("turn = 0").select("thread_id", F.col("author").alias("op_author"))
    out = T.build_context(n.join(op, "thread_id"), n, 2, 60, 120)
    depth = T.roots_and_depths(n).select("id", F.least("depth", F.lit(2).cast("bigint")).alias("ancestors"))
    return out.join(depth, "id").select(
        "id", F.md5("context").alias("context_hash"), "ancestors", F.regexp_extract("target", r"^\[(\[deleted\]|[A-Z]+)\] ", 1).alias("tag"), F.md5("target").alias("target_hash")
    )


@query("O-135", sql="""WITH f AS (SELECT source, lang || '_' || (n_chars % 40) AS author, min(doc_id) AS first FROM documents GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first, author) AS r FROM f) SELECT source, author, CASE WHEN r <= 24 THEN substr('ABCDEFGHJKLMNPQRSTUVWXYZ', r, 1) ELSE 'Z' END AS alias FROM r""")
def author_aliases(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.concat("lang", F.lit("_"), (F.col("n_chars") % 40).cast("string")).alias("author"))
    return T.author_letters(docs, "source", "author", "doc_id")


@query("O-136", sql="""WITH RECURSIVE n AS (SELECT source, doc_id, n_chars AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
  r AS (SELECT source, doc_id, i, s AS fill, 0::BIGINT AS chunk FROM n WHERE i = 1 UNION ALL
    SELECT n.source, n.doc_id, n.i, CASE WHEN r.fill + n.s > 6000 THEN n.s ELSE r.fill + n.s END, CASE WHEN r.fill + n.s > 6000 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN n ON n.source = r.source AND n.i = r.i + 1)
  SELECT source, doc_id, chunk FROM r""")
def packed_chunks(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return T.pack_chunks(docs, "source", "doc_id", "n_chars", 6000).select("source", "doc_id", "chunk")


# ---- folds and classifier -----------------------------------------------------------------------

HASH = "('0x' || substr(md5({k} || ':{s}'), 1, 8))::UBIGINT::BIGINT"


@query("O-144", sql=f"""WITH t AS (SELECT conv_id, turn, role, {HASH.format(k='conv_id', s='folds')} % 5 AS fold FROM conversations), n AS (SELECT fold, role, count(*) AS n FROM t GROUP BY ALL)
  SELECT fold, role, n, {q6('n / sum(n) OVER (PARTITION BY fold)', 'fold_share')}, {q6('sum(n) OVER (PARTITION BY role) / sum(n) OVER ()', 'overall_share')},
  {q6('n / sum(n) OVER (PARTITION BY fold) - sum(n) OVER (PARTITION BY role) / sum(n) OVER ()', 'drift')} FROM n""")
def grouped_folds(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "role")
    return rounded(D.fold_balance(D.grouped_folds(c, "conv_id", 5), "role"))


@query("O-144", sql="""SELECT role, count(*) AS row_count, 5::BIGINT AS folds, true AS shares_hold, (SELECT count(DISTINCT conv_id) FROM conversations) AS whole_threads FROM conversations GROUP BY role""")
def stratified_folds(spark, d):
    # What the folds promise: each thread in one fold, each fold's share of a role within one point of the role's.
    c = table(spark, d, "conversations").select("conv_id", "role")
    f = reliable_checkpoint(Fo.stratified_group_folds(c, "conv_id", "role", 5))
    whole = f.groupBy("conv_id").agg(F.count_distinct("fold").alias("n")).where("n = 1").agg(F.count(F.lit(1)).alias("whole_threads"))
    b = D.fold_balance(f, "role").groupBy("role").agg(F.sum("n").alias("row_count"), F.count_distinct("fold").alias("folds"), (F.max(F.abs("drift")) <= 0.01).alias("shares_hold"))
    return b.withColumn("whole_threads", whole.scalar())


@query("O-143", sql=f"""WITH docs AS (SELECT d.doc_id, text, 'q' || quality AS label, d.doc_id % 4 <> 0 AS train FROM documents d JOIN labels USING (doc_id)),
  tok AS (SELECT doc_id, train, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 2)) AS term FROM docs),
  tf AS (SELECT doc_id, term, any_value(train) AS train, count(*) AS tf FROM tok GROUP BY doc_id, term), nt AS (SELECT count(*) AS n FROM docs WHERE train),
  idf AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, nt WHERE train GROUP BY term),
  raw AS (SELECT doc_id, term, train, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)), w AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM raw),
  per AS (SELECT term, sum(x) AS s, sum(CASE WHEN label = 'q0' THEN x ELSE 0 END) AS s0, sum(CASE WHEN label = 'q1' THEN x ELSE 0 END) AS s1 FROM w JOIN docs USING (doc_id) WHERE w.train GROUP BY term),
  m AS (SELECT term, -ln((s + 1 - s0) / sum(s + 1 - s0) OVER ()) AS m0, -ln((s + 1 - s1) / sum(s + 1 - s1) OVER ()) AS m1 FROM per),
  sc AS (SELECT doc_id, sum(x * m0) AS a, sum(x * m1) AS b FROM w JOIN m USING (term) WHERE NOT train GROUP BY doc_id)
  SELECT doc_id, {q6('a', 'score_q0')}, {q6('b', 'score_q1')}, CASE WHEN a >= b THEN 'q0' ELSE 'q1' END AS predicted FROM sc""")
def complement_bayes(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    docs = docs.select("doc_id", "text", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"), (F.col("doc_id") % 4 != 0).alias("train"))
    w = D.term_weights(docs, "doc_id", "text", F.col("train"))
    model = D.complement_nb_fit(w, docs.where("train"), "doc_id", "label", ["q0", "q1"])
    test = w.join(docs.where("NOT train").select("doc_id"), "doc_id", "left_semi")
    return rounded(D.complement_nb_score(test, model, "doc_id", ["q0", "q1"]))
