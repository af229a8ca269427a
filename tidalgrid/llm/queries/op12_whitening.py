"""All embeddings projected on the first components of their covariance, with unit variance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..registry import Query, table
from ..whitening import whiten


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


QUERY = Query("op12_whitening", op12_whitening)
