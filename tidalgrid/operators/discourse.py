"""Relevance nets, label tables, rollups and stance shares of a discussion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import grain_start, wrap_daypart
from ..functions.labels import first_match
from .panel import checked_broadcast

# ---- relevance ----------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_anchors(df: DataFrame, vector: str, is_seed: Column, threshold: float = 0.45) -> DataFrame:
    """Add the cosine to the centroid of the seed rows and whether it reaches the threshold.

    The centroid is one vector, summed map-side and read back as a scalar subquery.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(dot(v, v))
    unit = df.withColumn("_u", F.transform(v, lambda x: F.try_divide(x, norm)))
    centroid = unit.where(is_seed & F.col("_u").isNotNull()).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("_u")))).alias("c")).scalar()
    out = unit.withColumn("_c", centroid)
    cosine = dot(F.col("_u"), F.col("_c")) / F.sqrt(dot(F.col("_c"), F.col("_c")))
    return out.withColumn("similarity", cosine).withColumn("is_semantic_anchor", F.col("similarity") >= threshold).drop("_u", "_c")


def anchored_threads(lexical: DataFrame, semantic: DataFrame, tier1: DataFrame, thread: str) -> DataFrame:
    """Threads found by either detector, with who found them and whether tier 1 hit."""
    tag = lambda d, k: d.select(thread, F.lit(k).alias("k"))
    both = tag(lexical, "l").unionByName(tag(semantic, "s")).unionByName(tag(tier1, "t"))
    has = lambda k: F.max(F.col("k") == k)
    out = both.groupBy(thread).agg(has("l").alias("is_lexical"), has("s").alias("is_semantic"), has("t").alias("is_tier1"))
    return out.where("is_lexical OR is_semantic")


def capture_recapture(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Lincoln-Petersen size of the hidden total and the recall of the union of two detectors."""
    from .panel import set_overlap

    o = set_overlap(a, b, [key])
    total = F.try_divide(F.col("a_count") * F.col("b_count"), F.col("both_count").cast("double"))
    return o.select(
        F.col("a_count").alias("n_lexical"),
        F.col("b_count").alias("n_semantic"),
        F.col("both_count").alias("n_both"),
        F.col("union_count").alias("n_union"),
        F.round(total).alias("estimated_total"),
        F.round(F.try_divide(F.col("union_count").cast("double"), total), 4).alias("estimated_recall"),
    )


def aspect_gates(df: DataFrame, text: str, aspects: Sequence[tuple[str, str, str]], ungated: Sequence[str] = ()) -> DataFrame:
    """One row per item and aspect its text mentions; ungated aspects hold for every non-empty text.

    All patterns run in one projection over the row; only matches are unfolded.
    """
    low = F.lower(F.col(text))
    scorable = F.length(F.trim(F.col(text))) > 0
    hits = [F.when(scorable if k in ungated else scorable & low.rlike("(?i)" + rx), F.lit(k)) for k, _, rx in aspects]
    return df.withColumn("aspect", F.explode(F.array_compact(F.array(*hits))))


def lexicon_sentiment(df: DataFrame, key: str, text: str, lexicon: DataFrame, scale: float = 5.0, dead_band: float = 0.05) -> DataFrame:
    """Sum of token scores, squashed to (-1, 1) and cut into pos, neu and neg.

    ``lexicon`` is (token, score) with unique tokens; it is broadcast if its size allows.  Items
    without any known token score zero.
    """
    tokens = df.select(key, F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}']+")).alias("token"))
    counts = tokens.join(checked_broadcast(lexicon), "token").groupBy(key).agg(F.sum("score").alias("raw_score"))
    out = df.join(counts, key, "left").withColumn("raw_score", F.coalesce("raw_score", F.lit(0.0).cast("double")))
    out = out.withColumn("signed_score", F.tanh(F.col("raw_score") / scale))
    return out.withColumn("sentiment", polarity(F.col("signed_score"), dead_band))


def polarity(score: Column, dead_band: float = 0.05) -> Column:
    return F.when(score > dead_band, "pos").when(score < -dead_band, "neg").otherwise("neu")


def ensemble_score(*scores: Column) -> tuple[Column, Column]:
    """Mean and population deviation of the scores that are present."""
    have = F.array_compact(F.array(*[s.cast("double") for s in scores]))
    n = F.nullif(F.size(have), F.lit(0)).cast("double")
    total = lambda f: F.aggregate(have, F.lit(0.0), lambda s, x: s + f(x))
    mean = total(lambda x: x) / n
    return mean, F.sqrt(total(lambda x: (x - mean) * (x - mean)) / n)


def relevance_gate(items: DataFrame, labels: DataFrame, key: str, tier1: str) -> DataFrame:
    """Items judged relevant or in tier 1, stamped with the newest relevance label."""
    stamped = restamp(items, labels, key)
    return stamped.where(F.col("is_relevant") | F.coalesce(F.col(tier1), F.lit(False)))


def restamp(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Relevance from the newest label where there is one, else the stamp the item carries."""
    old = F.col("is_relevant") if "is_relevant" in items.columns else F.lit(None).cast("boolean")
    fresh = labels.groupBy(key).agg(F.max_by("about_topic", "version").alias("_new"))
    base = items.withColumn("_old", old).drop("is_relevant")
    return base.join(fresh, key, "left").withColumn("is_relevant", F.coalesce("_new", "_old", F.lit(False))).drop("_new", "_old")


def disagreement_cell(topic_a: Column, stance_a: Column, topic_b: Column, stance_b: Column) -> Column:
    """Where two labellers part: topic, polarity flip, other stance, or nowhere."""
    flip = ((stance_a == "pro") & (stance_b == "anti")) | ((stance_a == "anti") & (stance_b == "pro"))
    return first_match([(topic_a != topic_b, "D_topic"), (stance_a == stance_b, "A_agree"), (flip, "D_flip")], "D_stance")


def confident_errors(
    df: DataFrame, truth: str, pred: str, conf: Column, true_set: Sequence[str], pred_set: Sequence[str],
    lines: Column, chars: Column, tie: str, min_conf: float = 0.9, top: int = 5,
) -> DataFrame:
    """Confident mistakes between two label sets, shortest texts first."""
    wrong = F.col(truth).isin(*true_set) & F.col(pred).isin(*pred_set) & (F.col(truth) != F.col(pred)) & (conf > min_conf)
    return df.where(wrong).orderBy(lines, chars, tie).limit(top)


# ---- rollups ------------------------------------------------------------------------------------


def hourly_rollup(items: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Item counts and summed probabilities per key, date and hour: additive, so it serves every
    coarser grain."""
    return items.groupBy(*keys, "date", "hour").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"sum_{s}") for s in sums])


def reaggregate(rollup: DataFrame, grain: str, by: Sequence[str], sums: Sequence[str] = ("n",)) -> DataFrame:
    """Hourly rollup to daily, weekly, monthly, or the typical day by daypart."""
    if grain == "daypart":
        df, key = rollup.withColumn("daypart", wrap_daypart(F.col("hour"))), "daypart"
    else:
        df, key = rollup.withColumn("period_start", grain_start(F.col("date"), grain)), "period_start"
    return df.groupBy(key, *by).agg(*[F.sum(s).alias(s) for s in sums])


def stance_shares(counts: DataFrame, keys: Sequence[str], stance: str = "stance", n: str = "n", stances: Sequence[str] = ("anti", "neutral", "pro")) -> DataFrame:
    """Counts and shares of each stance side by side, their total and net = pro - anti."""
    kept = counts.where(F.col(stance).isin(*stances))
    wide = kept.groupBy(*keys).agg(*[F.sum(F.when(F.col(stance) == s, F.col(n)).otherwise(0)).alias(f"n_{s}") for s in stances])
    total = sum((F.col(f"n_{s}") for s in stances[1:]), F.col(f"n_{stances[0]}"))
    wide = wide.withColumn("n_total", total)
    wide = wide.withColumns({f"share_{s}": F.try_divide(F.col(f"n_{s}"), F.col("n_total")) for s in stances})
    return wide.withColumn("net", F.col("share_pro") - F.col("share_anti"))


def share_of_conversation(topic: DataFrame, total: DataFrame, on: Sequence[str]) -> DataFrame:
    a = topic.withColumnRenamed("n", "n_topic")
    out = a.join(total.withColumnRenamed("n", "n_total"), list(on), "left")
    return out.withColumn("share_topic", F.try_divide("n_topic", "n_total"))


def daily_summary(
    df: DataFrame, day: str = "date", counts: Mapping[str, Column] | None = None, means: Mapping[str, Column] | None = None, n: str = "n"
) -> DataFrame:
    """Rows, conditional counts and means per day."""
    aggs = [F.count(F.lit(1)).alias(n)]
    aggs += [F.count_if(c).alias(k) for k, c in (counts or {}).items()]
    aggs += [F.avg(c).alias(k) for k, c in (means or {}).items()]
    return df.groupBy(day).agg(*aggs)


# ---- folds and a text classifier ----------------------------------------------------------------


def hash_fraction(key: Column, salt: str = "") -> Column:
    """A number in [0, 2^32) that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 8), 16, 10).cast("bigint")


def grouped_folds(df: DataFrame, group: str, k: int, salt: str = "folds") -> DataFrame:
    """Fold number per row; a group never spans two folds."""
    return df.withColumn("fold", F.pmod(hash_fraction(F.col(group), salt), F.lit(k)))


def fold_balance(df: DataFrame, label: str) -> DataFrame:
    """Label share per fold against the share overall."""
    n = df.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n"))
    per_fold = W.partitionBy("fold")
    per_label = W.partitionBy(label)
    total = n.agg(F.sum("n")).scalar()
    # Folds x labels rows reach these windows.
    out = n.withColumn("fold_share", F.col("n") / F.sum("n").over(per_fold)).withColumn("overall_share", F.sum("n").over(per_label) / total)
    return out.withColumn("drift", F.col("fold_share") - F.col("overall_share"))


def term_weights(df: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """(key, term, weight): sublinear tf times smoothed idf, scaled to length one per item.

    Documents are counted on the training rows; terms unseen there are dropped.
    """
    tokens = df.select(key, train.alias("_train"), F.explode(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= 2)).alias("term"))
    tf = tokens.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.max("_train").alias("_train"))
    n_train = df.where(train).agg(F.count(F.lit(1))).scalar()
    idf = tf.where("_train").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = idf.select("term", (F.log((1 + n_train) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_len"))
    return raw.join(length, key).select(key, "term", F.try_divide("w", "_len").alias("weight"))


def complement_nb_fit(weights: DataFrame, labels: DataFrame, key: str, label: str, classes: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """(term, one weight per class) of complement naive Bayes from term weights of labelled items."""
    per = weights.join(labels.select(key, label), key).groupBy("term").agg(
        *[F.sum(F.when(F.col(label) == c, F.col("weight")).otherwise(0.0)).alias(f"_s_{c}") for c in classes], F.sum("weight").alias("_all")
    )
    comp = per.select("term", *[(F.col("_all") + alpha - F.col(f"_s_{c}")).alias(c) for c in classes])
    totals = comp.agg(F.struct(*[F.sum(c).alias(c) for c in classes])).scalar()
    return comp.withColumn("_t", totals).select("term", *[(-F.log(F.col(c) / F.col(f"_t.{c}"))).alias(c) for c in classes])


def complement_nb_score(weights: DataFrame, model: DataFrame, key: str, classes: Sequence[str]) -> DataFrame:
    """(key, score per class, predicted): the class with the largest score wins."""
    s = weights.join(model, "term").groupBy(key).agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"score_{c}") for c in classes])
    best = F.greatest(*[F.col(f"score_{c}") for c in classes]) if len(classes) > 1 else F.col(f"score_{classes[0]}")
    return s.withColumn("predicted", first_match([(F.col(f"score_{c}") == best, c) for c in classes]))
