"""Quality of every document, learnt from four fifths of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..quality_classifier import quality_scores
from ..registry import Query, table


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    labels = table(spark, folder, "labels").where(~held).select("doc_id", "quality")
    d = quality_scores(table(spark, folder, "documents").select("doc_id", "text"), labels)
    return d.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))


QUERY = Query("op5_quality_classifier", op5_quality_classifier)
