"""All documents against all benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..decontamination import contamination
from ..registry import Query, table


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    d = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return d.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), 13) AS k, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS g
  FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, ks WHERE len(ws) >= k)),
m AS (SELECT DISTINCT rid, i, k, item FROM dw JOIN bw USING (k, g)),
h AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT rid, i, k FROM m)) GROUP BY rid),
f AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN f USING (rid)
"""

QUERY = Query("op8_decontamination", op8_decontamination, SQL)
