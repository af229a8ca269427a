"""All documents in eight shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Query, table
from ..sharding import shard_documents


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    d = shard_documents(table(spark, folder, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_words")


QUERY = Query("op9_sharding", op9_sharding)
