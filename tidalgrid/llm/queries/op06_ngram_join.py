"""Near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..ngram_join import near_duplicates
from ..registry import Query, table


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "class_id", "copy_id", "n_links", "n_class_links")


#: All pairs of different n-gram sets that share an n-gram, then components by a recursive walk.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 OR ws IS NULL THEN NULL WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_sort(list_distinct([array_to_string(ws[i:i + 4], ' ') for i in generate_series(1, len(ws) - 4)])) END AS gs FROM d),
c AS (SELECT row_number() OVER () AS cid, gs, len(gs) AS n, count(*) AS copies, min(doc_id) AS least FROM g WHERE gs IS NOT NULL GROUP BY gs),
e AS (SELECT cid, n, unnest(gs) AS s FROM c),
p AS (SELECT a.cid AS x, b.cid AS y, a.n + b.n AS t, count(*) AS k FROM e a JOIN e b ON a.s = b.s AND a.cid <> b.cid GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE k >= 0.8 * (t - k) - 1e-9),
w AS (SELECT cid AS x, cid AS y FROM c UNION SELECT w.x, l.y FROM w JOIN l ON w.y = l.x),
k AS (SELECT w.x, min(c.least) AS class_id FROM w JOIN c ON c.cid = w.y GROUP BY w.x),
n AS (SELECT l.x, sum(c.copies) AS docs, count(*) AS cls FROM l JOIN c ON c.cid = l.y GROUP BY l.x)
SELECT g.doc_id, coalesce(k.class_id, g.doc_id) AS class_id, coalesce(c.least, g.doc_id) AS copy_id,
  CAST(coalesce(n.docs, 0) + coalesce(c.copies - 1, 0) AS BIGINT) AS n_links, CAST(coalesce(n.cls, 0) AS BIGINT) AS n_class_links
FROM g LEFT JOIN c ON c.gs = g.gs LEFT JOIN k ON k.x = c.cid LEFT JOIN n ON n.x = c.cid
"""

QUERY = Query("op6_ngram_join", op6_ngram_join, SQL)
