"""All conversations formatted, and digests of what reads back from the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chat_format import ALSO, END, SAYS, START, format_conversations, read_loss, read_turns
from ..columns import bind
from ..registry import Query, table

#: The conversation the contract adds: both turns say what looks like another template's markers.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(
        F.lit(c).cast("bigint").alias("conv_id"), F.lit(t).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in EXTRA])).alias("x")).select("x.*")
    turns = table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(extra)
    d = bind(format_conversations(turns), turns=read_turns(F.col("formatted")), loss=read_loss(F.col("formatted"), F.col("loss_spans")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev, replace(text, '<|', '<||') AS esc, replace(role, '<|', '<||') AS erole FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(esc) + CASE WHEN prev IS NULL OR prev <> role THEN {len(START) + len(SAYS) + len(END)} + length(erole) ELSE {len(ALSO)} END) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""

QUERY = Query("op10_chat_format", op10_chat_format, SQL)
