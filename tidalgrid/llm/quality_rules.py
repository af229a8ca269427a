"""Quality rules: a threshold table compiled into one projection of document ratios.

Everything is a column expression; a document never leaves its task and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bind, fresh, words_of

#: Frequent function words of the corpus languages (English, French, German, Spanish).
STOP_WORDS = (
    "the of and to in a is that it for on was be with as this by are or an from "
    "le la les de des du et en un une que dans pour pas sur est "
    "der die das und ist nicht ein eine mit zu von den auf für "
    "el los las del y que en por con una para como no"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a document whose ``measure`` lies below ``least`` or above ``most``; no bound if None."""

    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0  # the rule judges documents of at least so many words


#: Production thresholds.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_chars", least=2.0, most=15.0),
    Rule("symbol_ratio", most=0.2),
    Rule("bar_ratio", most=0.2),
    Rule("shout_ratio", most=0.2),
    Rule("letter_word_ratio", least=0.6),
    Rule("stop_word_ratio", least=0.02, from_words=50),
    Rule("dup_line_ratio", most=0.4),
    Rule("repeat_word_ratio", most=0.5),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def document_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the struct ``measures``: counts and ratios of each whole text.

    NULL and empty texts have no words: all counts and ratios are 0.  Texts of any length are read whole.
    Columns of ``df`` may have any names; if one is called ``measures``, the new column has underscores in front.
    """
    names, own = df.columns, fresh(df, "measures")
    at = names.index(text)
    df = df.toDF(*[f"in_{i}" for i in range(len(names))])
    text = f"in_{at}"
    t = F.coalesce(F.col(text), F.lit(""))
    d = bind(df, qr_words=words_of(F.col(text)), qr_lines=F.filter(F.split(t, "\n"), lambda s: F.regexp_replace(s, r"[\x20\x09-\x0D]+", "") != ""))
    d = bind(d, qr_n=F.size("qr_words"))
    windows = F.when(
        F.col("qr_n") > 2,
        F.sort_array(F.transform(F.sequence(F.lit(1), F.col("qr_n") - 2), lambda i: F.struct(
            F.xxhash64(F.element_at("qr_words", i), F.element_at("qr_words", i + 1), F.element_at("qr_words", i + 2)).alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    d = bind(d, qr_windows=windows)
    m = F.size("qr_windows")
    h = lambda k: F.get("qr_windows", k)["h"]  # noqa: E731  NULL outside
    again = F.filter(
        F.transform(F.sequence(F.lit(0), m - 1), lambda k: F.when((h(k) == h(k - 1)) | (h(k) == h(k + 1)), F.get("qr_windows", k)["i"])),
        lambda i: i.isNotNull())
    d = bind(d, qr_again=F.when(m > 1, F.sort_array(again)).otherwise(F.array().cast("array<int>")))
    r = F.size("qr_again")
    covered = F.when(r > 0, F.aggregate(
        F.transform(F.sequence(F.lit(0), r - 1), lambda k: F.least(F.lit(3), F.coalesce(F.get("qr_again", k + 1) - F.get("qr_again", k), F.lit(3)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))
    n, lines = F.col("qr_n").cast("bigint"), F.size("qr_lines").cast("bigint")
    d = bind(
        d,
        qr_chars=F.char_length(F.array_join("qr_words", "")).cast("bigint"),
        qr_symbols=F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint"),
        qr_bars=F.size(F.filter("qr_words", lambda w: w == "|")).cast("bigint"),
        qr_shouts=F.size(F.filter("qr_words", lambda w: w.endswith("!!"))).cast("bigint"),
        qr_letters=F.size(F.filter("qr_words", lambda w: w.rlike(r"\p{L}"))).cast("bigint"),
        qr_stops=F.size(F.filter("qr_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint"),
        qr_dups=lines - F.size(F.array_distinct("qr_lines")),
        qr_repeats=covered,
    )
    measures = F.struct(
        n.alias("n_words"), F.col("qr_chars").alias("word_chars"), F.col("qr_symbols").alias("n_symbols"),
        F.col("qr_dups").alias("n_dup_lines"), F.col("qr_repeats").alias("n_repeat_words"), lines.alias("n_lines"),
        _ratio(F.col("qr_chars"), n).alias("mean_word_chars"), _ratio(F.col("qr_symbols"), n).alias("symbol_ratio"),
        _ratio(F.col("qr_bars"), n).alias("bar_ratio"), _ratio(F.col("qr_shouts"), n).alias("shout_ratio"),
        _ratio(F.col("qr_letters"), n).alias("letter_word_ratio"), _ratio(F.col("qr_stops"), n).alias("stop_word_ratio"),
        _ratio(F.col("qr_dups"), lines).alias("dup_line_ratio"), _ratio(F.col("qr_repeats"), n).alias("repeat_word_ratio"))
    return d.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], measures.alias(own))


def compile_rules(rules: Sequence[Rule], measures: str = "measures") -> Column:
    """The names of the rules a document breaks, as one array expression; no rule is skipped."""
    broken = []
    for rule in rules:
        m, off = F.col(measures)[rule.measure], F.lit(False)
        if rule.least is not None:
            off = off | (m < rule.least)
        if rule.most is not None:
            off = off | (m > rule.most)
        if rule.from_words:
            off = off & (F.col(measures)["n_words"] >= rule.from_words)
        broken.append(F.when(off, F.lit(rule.measure)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def apply_rules(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``df`` with ``measures``, ``broken_rules`` (array) and ``kept``, under those names or, where ``df`` has
    such a column, with underscores in front.  Every row comes back, repeated rows too; an empty table stays empty."""
    measures, broken, kept = (fresh(df, name) for name in ("measures", "broken_rules", "kept"))
    d = document_measures(df, text).withColumn(broken, compile_rules(rules, measures))
    return d.withColumn(kept, F.size(broken) == 0)


def passing(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``df`` that break no rule."""
    return apply_rules(df, rules, text).where(F.col(fresh(df, "kept"))).select(*[F.col(f"`{c}`") for c in df.columns])
