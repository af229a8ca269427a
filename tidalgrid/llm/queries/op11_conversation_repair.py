"""All conversations damaged by a rule, and repaired by the cheapest edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conversation_repair import repair_conversations, repair_summaries
from ..registry import Query, table


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the contract's damage; NULL is one space in the rule's key, roles and texts."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    d = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("rule"))
    text = F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("rule") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.where("rule <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return repaired(turns)


def repaired(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of ``turns``, those without rows after the damage included."""
    found = repair_summaries(repair_conversations(damaged(turns)))
    every = turns.select(F.col("conv_id").alias("of")).distinct()
    d = every.join(found, every["of"].eqNullSafe(found["conv_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select(F.col("of").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _then(state: str, cost: str, letters: str) -> str:
    return f"{{c: {state}.c + {cost}, a: {state}.a || '{letters}'}}"


#: The same edits by a dynamic programme from the front: for each state the cheapest and then least letters so far.
_USER = _least("s3", _then("s1", "3", "I"), _then("s2", "3", "I"), _then("s4", "3", "I"))
_LAST = _least("s4", _then("s3", "3", "I"), _then("s1", "6", "II"), _then("s2", "6", "II"))
_NEVER = "{c: CAST(1000000000 AS BIGINT), a: ''}"
SQL = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b:
    list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS rule FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN rule = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN rule = 1 THEN '' WHEN rule = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN rule = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE rule <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ord FROM dam),
f AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY ord) AS nth,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY ord) || left(role, 1) AS pair FROM o),
g AS (SELECT *, left(role, 1) AS r, CASE WHEN cut = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
c AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(ord) AS n FROM g GROUP BY conv_id),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS ord, {{c: CAST(0 AS BIGINT), a: ''}} AS s1, {_NEVER} AS s2, {_NEVER} AS s3, {_NEVER} AS s4 FROM c
  UNION ALL SELECT conv_id, ord + 1, {_then('s1', '4', 'D')},
    {_least(_then('s2', '4', 'D'), _then('s1', "p + CASE WHEN r = 's' THEN 0 ELSE 1000000000 END", 'K'))},
    {_least(_then('u', '4', 'D'), *[_then(x, 'p + 3', 'R') for x in ('s1', 's2', 'l')], *[_then(x, "p + CASE WHEN r = 'u' THEN 0 ELSE 1000000000 END", 'K') for x in ('s1', 's2', 'l')])},
    {_least(_then('l', '4', 'D'), _then('u', 'p + 3', 'R'), _then('u', "p + CASE WHEN r = 'a' THEN 0 ELSE 1000000000 END", 'K'))}
  FROM (SELECT dp.*, {_USER} AS u, {_LAST} AS l, g.r, CASE g.fault WHEN 'truncated' THEN 3 WHEN '' THEN 0 ELSE 1000000000 END AS p
    FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.ord = dp.ord + 1)),
best AS (SELECT dp.conv_id, {_least('s1', _LAST)} AS b FROM dp JOIN c ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.ord = c.n),
e AS (SELECT conv_id, unnest(string_split(b.a, '')) AS e, unnest(range(len(b.a))) AS pos FROM best),
w AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS ord, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS q FROM e),
y AS (SELECT w.*, g.role, CASE WHEN e = 'I' THEN '' ELSE g.text END AS text,
    max(CASE WHEN e = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS opened FROM w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.ord = w.ord),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (q - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos)) AS sha FROM y WHERE e <> 'D' GROUP BY conv_id)
SELECT i.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(best.b.c, 0) AS cost, coalesce(best.b.a, '') AS audit, coalesce(h.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM i.conv_id
"""

QUERY = Query("op11_conversation_repair", op11_conversation_repair, SQL)
