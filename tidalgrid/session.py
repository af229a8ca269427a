"""Session defaults and the shared-folder checkpoint used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidalgrid", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDALGRID_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _is_local(spark: SparkSession) -> bool:
    # local-cluster has executors of its own, which share no folder with the driver.
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back, so later stages neither
    recompute it nor see it change when an executor is lost.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a local
    test session, which has none, gets a fresh temporary folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not _is_local(spark):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tidalgrid-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
