"""Late and repeated items folded into an hourly rollup as a stream that can stop and go on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets of the known ids, and batches after which their files are merged.
BUCKETS, MERGE_EVERY = 64, 16


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder; a temporary one only in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix=f"tidalgrid-{name}-")
    return f"{base}/{name}-{uuid.uuid4()}"


class FirstRows:
    """The first row of each id, kept below one folder so that any batch can be written again.

    ``batch=n`` holds the rows batch n added, ``base=n`` all rows of the batches before n; both are cut
    in hash buckets of the id.  Batch n looks at the base of its stretch of ``merge_every`` batches and the
    batches since, never at its own folder or a later one, so repeating it writes the same rows.
    """

    def __init__(self, spark: SparkSession, folder: str, fields: str, key: str, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY) -> None:
        self.spark, self.folder, self.fields, self.key, self.buckets, self.merge_every = spark, folder, fields, key, buckets, merge_every

    def _path(self, kind: str, n: int) -> str:
        return f"{self.folder}/{kind}={n:08d}"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _written(self, kind: str) -> list[int]:
        """The numbers of the complete folders of a kind."""
        fs, path = self._files()
        found = fs.globStatus(path(f"{self.folder}/{kind}=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def _read(self, paths: list[str]) -> DataFrame:
        rows = [self.spark.read.schema(f"{self.fields}, bucket int").option("basePath", p).parquet(p) for p in paths]
        out = rows[0] if rows else self.spark.createDataFrame([], f"{self.fields}, bucket int")
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def _before(self, n: int) -> list[str]:
        base = n // self.merge_every * self.merge_every
        return ([self._path("base", base)] if base else []) + [self._path("batch", i) for i in range(base, n)]

    def _write(self, rows: DataFrame, kind: str, n: int) -> None:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path(kind, n))

    def add(self, rows: DataFrame, n: int) -> None:
        """Write the rows of batch ``n`` whose id no earlier batch has; ``rows`` has each id once."""
        if n and n % self.merge_every == 0:
            last = n - self.merge_every
            merged = ([self._path("base", last)] if last else []) + [self._path("batch", i) for i in range(last, n)]
            self._write(self._read(merged), "base", n)
            fs, path = self._files()
            for kind in ("base", "batch"):  # what no batch from here on reads, a repetition of this one included
                for i in self._written(kind):
                    if i < last:
                        fs.delete(path(self._path(kind, i)), True)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        if earlier := self._before(n):
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
            known = self._read(earlier).where(F.col("bucket").isin(touched)).select(F.col("bucket").alias("_bucket"), F.col(self.key).alias("_known"))
            rows = rows.join(known, (F.col("bucket") == F.col("_bucket")) & F.col(self.key).eqNullSafe(F.col("_known")), "left_anti")
        self._write(rows, "batch", n)

    def all(self) -> DataFrame:
        """All rows so far: the latest base and the batches since."""
        base = max(self._written("base"), default=0)
        return self._read(([self._path("base", base)] if base else []) + [self._path("batch", i) for i in self._written("batch") if i >= base]).drop("bucket")


def run_rollup(
    items: DataFrame, key: str, ts: str, by: str, window: str = "1 hour", store: str | None = None, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY
) -> DataFrame:
    """Run the stream over everything available; counts per window and type of the first row of each id.

    ``store`` is a shared folder that holds the stream's position and the rows so far: a later call with the
    same store reads only what has come since, and a call that died goes on where it stopped, with
    nothing lost or counted twice.  Without it, every call starts anew.  No row is too late and no id is ever
    forgotten (rows without id count as one): a micro-batch keeps the ids no earlier batch has, the
    earliest time inside the batch winning, and reads only the buckets its ids fall in.
    """
    spark = items.sparkSession
    store = store or shared_folder(spark, "rollup")
    picked = items.select(key, ts, by)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    first_rows = FirstRows(spark, f"{store}/rows", fields, key, buckets, merge_every)

    def save(batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy(key).agg(F.min(F.struct(ts, by)).alias("first"))
        first_rows.add(first.select(key, f"first.{ts}", f"first.{by}"), batch_id)

    run = picked.writeStream.outputMode("append").option("checkpointLocation", f"{store}/position").trigger(availableNow=True).foreachBatch(save).start()
    run.awaitTermination()
    counted = first_rows.all().groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n")
