"""First-wins merging of overlapping sources, and writing tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dedup_first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in ``order``.

    A ``min_by`` aggregate, so copies collapse before the shuffle and a key with very many copies
    never sits in one task.  ``order`` must decide every tie that matters.
    """
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*key, "_row.*").select(*df.columns)


def merge_patches(base: DataFrame, patch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Base rows plus the patch rows whose key is new; inside one source the first by ``order`` wins."""
    both = base.withColumn("_source", F.lit(0)).unionByName(
        patch.withColumn("_source", F.lit(1)), allowMissingColumns=True
    )
    return dedup_first_wins(both, key, ["_source", *order])


def merge_report(base: DataFrame, patch: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: existing rows, net new rows and dropped copies of a merge.

    Existing rows are counted as they stand, so copies already in the base count as dropped.
    """
    flags = base.select(*key, F.lit(0).alias("s")).unionByName(patch.select(*key, F.lit(1).alias("s")))
    per_key = flags.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(1) - F.col("s")).alias("n_base"))
    return per_key.agg(
        F.coalesce(F.sum("n_base"), F.lit(0)).alias("existing_rows"),
        (F.count(F.lit(1)) - F.coalesce(F.sum("n_base"), F.lit(0))).alias("net_new_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped_copies"),
    )


def seed_and_repair(prior: DataFrame, repaired: DataFrame, key: str, parsed: str) -> DataFrame:
    """Rows already parsed, plus new labels for exactly the ids that failed before."""
    good = prior.where(F.col(parsed))
    failed = prior.where(~F.coalesce(F.col(parsed), F.lit(False))).select(key)
    redone = repaired.join(failed.distinct(), key, "left_semi").where(F.col(parsed))
    return good.unionByName(redone, allowMissingColumns=True)


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), lambda x: jvm.org.apache.hadoop.fs.Path(x)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", fmt: str = "parquet"
) -> None:
    """Write a zstd table; replacing one keeps the old files until the new ones are complete.

    A replacement is written to a folder beside ``path`` and then takes its name; a job that fails leaves
    the old table as it was.  Should the driver die between the two renames, ``restore_table`` puts the old
    one back.  With partition columns the rows are first spread by them, with AQE splitting a partition
    value that holds very many rows, so no value leaves thousands of small files.
    """
    out = df.hint("rebalance", *partition_by) if partition_by else df
    replace = mode == "overwrite"
    target = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}" if replace else path
    writer = out.write.mode("errorifexists" if replace else mode).format(fmt).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if not replace:
        writer.save(path)
        return
    fs, at = _file_system(df.sparkSession, path)
    try:
        writer.save(target)
    except Exception:
        fs.delete(at(target), True)
        raise
    old = f"{path.rstrip('/')}.old"
    if fs.exists(at(path)):
        fs.delete(at(old), True)
        fs.rename(at(path), at(old))
    if not fs.rename(at(target), at(path)):
        raise OSError(f"could not put the new table at {path}; the old one is at {old}")
    fs.delete(at(old), True)


def restore_table(spark: SparkSession, path: str) -> bool:
    """Put the old table back if a replacement broke off between its renames; whether that was needed."""
    fs, at = _file_system(spark, path)
    old = f"{path.rstrip('/')}.old"
    if fs.exists(at(path)) or not fs.exists(at(old)):
        return False
    return bool(fs.rename(at(old), at(path)))
