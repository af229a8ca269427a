"""Time the panel feature steps on a panel of the published size: 263 zones x 1,186 days x 5 buckets.

    python tools/scale_check.py [zones]

The panel is generated by Spark from zone ids and hashes; nothing else is read.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tidalgrid.functions.calendar import policy_period  # noqa: E402
from tidalgrid.operators import panel as P  # noqa: E402
from tidalgrid.operators import series as Se  # noqa: E402
from tidalgrid.operators import windows as Wn  # noqa: E402
from tidalgrid.session import local_session  # noqa: E402

METRICS = [f"m{i}" for i in range(7)]


def main() -> None:
    zones = int(sys.argv[1]) if len(sys.argv) > 1 else 263
    spark = local_session("tidalgrid-scale", partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    ids = spark.range(zones).select(F.col("id").cast("int").alias("zone_id"))
    spine = P.dense_spine(ids, "2023-01-01", "2026-03-31").withColumn("period", policy_period(F.col("date")))
    noise = lambda i: (F.pmod(F.xxhash64("zone_id", "date", "temporal_bucket", F.lit(i)), F.lit(100_000)) / 100.0).cast("double")
    level = 50 + F.col("zone_id") % 40 + 20 * F.sin(F.dayofyear("date") / 30.0)
    folder = tempfile.mkdtemp(prefix="tidalgrid-scale-")
    spine.withColumns({m: F.when(noise(i + 90) > 50, level + noise(i) / 20) for i, m in enumerate(METRICS)}).write.mode("overwrite").parquet(folder)
    panel = spark.read.parquet(folder)
    print(f"panel rows {panel.count():,}")
    steps = {
        "deviation z-scores, 14 features": lambda: Wn.deviation_zscores(panel, METRICS),
        "percentile ranks, 7 metrics": lambda: Wn.percentile_ranks(panel, METRICS),
        "history features, 35 columns": lambda: Wn.history_features(panel, METRICS),
        "exponential means, 7 metrics": lambda: Wn.ema(panel.drop("period"), METRICS, span=7),
        "seasonal split, 1 metric": lambda: Se.seasonal_trend(panel, ["zone_id", "temporal_bucket"], "date", "m0", 14),
    }
    panel.write.format("noop").mode("overwrite").save()
    series = panel.select("zone_id", "temporal_bucket").distinct().count()
    for name, build in steps.items():
        took = []
        for _ in range(1 if "split" in name else 2):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        per = f" ({took[-1] / series * 1000:.1f} ms per series, {series:,} series)" if "split" in name else ""
        print(f"{name}: " + ", then ".join(f"{t:.1f} s" for t in took) + per)


if __name__ == "__main__":
    main()
