"""Quality rules on all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..quality_rules import RULES, STOP_WORDS, apply_rules
from ..registry import Query, table

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    d = apply_rules(table(spark, folder, "documents").select("doc_id", "text"), RULES)
    d = d.select("doc_id", *[F.col(f"measures.{c}").alias(c) for c in COUNTS], F.col("kept").alias("passed"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("passed")).drop("passed")


def _rule_sql() -> str:
    parts = []
    for r in RULES:
        off = [f"{r.measure} < {r.least}"] * (r.least is not None) + [f"{r.measure} > {r.most}"] * (r.most is not None)
        parts.append("(" + " OR ".join(off) + ")" if not r.from_words else f"(({' OR '.join(off)}) AND n_words >= {r.from_words})")
    return " OR ".join(parts)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws) AS n_words, length(list_aggregate(list_concat([''], ws), 'string_agg', '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: x = '|')) AS bars, len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS shouts,
  len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS letters,
  len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], lower(x)))) AS stops
  FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
  CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
  CASE WHEN n_words > 0 THEN bars / n_words ELSE 0 END AS bar_ratio,
  CASE WHEN n_words > 0 THEN shouts / n_words ELSE 0 END AS shout_ratio,
  CASE WHEN n_words > 0 THEN letters / n_words ELSE 0 END AS letter_word_ratio,
  CASE WHEN n_words > 0 THEN stops / n_words ELSE 0 END AS stop_word_ratio,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_ratio FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({_rule_sql()}) AS kept
FROM r
"""

QUERY = Query("op3_quality_rules", op3_quality_rules, SQL)
