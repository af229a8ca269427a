"""Scores of all documents under a model that learns from six sevenths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lm_scoring import lm_scores
from ..registry import Query, table
from .op07_bpe_round_trip import tokenizer_path


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    d = lm_scores(table(spark, folder, "documents").select("doc_id", "text"), ~held, tokenizer_path())
    return d.withColumn("held_out", F.coalesce(held, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERY = Query("op2_lm_scoring", op2_lm_scoring)
