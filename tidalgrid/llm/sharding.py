"""Vector bin packing of documents into shards, balancing bytes, tokens and rows jointly.

Groups of equal texts hash into a fixed number of bundles; a heavy group is cut by its rows' keys into
slices that are bundles of their own, placed together or, if the group is too heavy for one shard,
each by itself.  Only the bundles' (bytes, tokens, rows) reach
the driver, which places each, heaviest first, where the dot product with the shards' residual
capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import reliable_checkpoint
from .columns import words_of

#: Bundles the groups hash into: the number of rows that reach the driver, whatever the input.
BUNDLES = 1 << 14
#: A group above this part of a shard's fair share of bytes, tokens or rows goes to several shards.
SPREAD = 1 / 4
#: A group above this part is handled in slices of about this size, in one shard or several.
HEAVY = 1 / 16
#: Weight of bytes, tokens and rows in the dot product; bytes are the law, the others follow.
WEIGHTS = (8.0, 1.0, 1.0)


def pack(loads: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each bundle; ``loads`` has a row (bytes, tokens, rows) a bundle.

    Loads count as parts of a shard's fair share.  Ties go to the shard with the smallest number.
    """
    part = loads * shards / np.maximum(loads.sum(axis=0), 1)
    order = np.lexsort((np.arange(len(part)), -part.max(axis=1) if len(part) else np.zeros(0)))
    residual, w, where = np.ones((shards, loads.shape[1])), np.asarray(weights), np.zeros(len(part), np.int64)
    for i in order:
        s = int(np.argmax(residual @ (w * part[i])))
        residual[s] -= part[i]
        where[i] = s
    return where


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """(key, size, n_words, text_crc32, shard, slot) of every row.

    ``size`` is the text's bytes in UTF-8 plus 1; a NULL text counts as empty.  Equal texts share a
    shard unless their group takes more than ``SPREAD`` of one.  Slots number a shard's rows from 0 without a gap.  Repeated
    rows stay apart; no rows in, no rows out.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = reliable_checkpoint(docs.select(
        F.col(key).alias("key"), (F.octet_length(t) + 1).cast("bigint").alias("size"), F.size(words_of(F.col(text))).cast("bigint").alias("n_words"),
        F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("group"),
        F.monotonically_increasing_id().alias("salt")))  # tells repeated rows apart; the checkpoint keeps it fixed
    sums = [F.sum("size").alias("bytes"), F.sum("n_words").alias("tokens"), F.count("*").alias("rows")]
    total = d.agg(*sums).first()
    names = ["bytes", "tokens", "rows"]
    part = F.greatest(*[F.col(n) * shards / F.lit(float(max(1, total[n] or 0))) for n in names])
    # At most shards / HEAVY groups can be heavy in each of the three, so this is a bounded table.
    heavy = d.groupBy("group").agg(*sums).where(part > HEAVY).select("group", F.ceil(part / HEAVY).alias("pieces"), (part <= SPREAD).alias("together"))
    d = d.join(F.broadcast(heavy), "group", "left")
    bundle = F.when(F.col("pieces").isNull(), F.pmod("group", F.lit(BUNDLES))).otherwise(F.xxhash64("group", F.pmod(F.xxhash64("salt"), "pieces")))
    d = d.withColumn("cut", F.col("pieces").isNotNull()).withColumn("bundle", bundle).withColumn("unit", F.when(F.col("together"), F.col("group")).otherwise(F.col("bundle")))
    found = d.groupBy("cut", "bundle", "unit").agg(*sums).orderBy("cut", "bundle").collect()
    units = {u: i for i, u in enumerate(sorted({(r["cut"], r["unit"]) for r in found}))}
    loads = np.zeros((len(units), 3))
    for r in found:
        loads[units[r["cut"], r["unit"]]] += [r[n] for n in names]
    where = pack(loads, shards)
    filled, placed = [0] * shards, []
    for r in found:
        s = int(where[units[r["cut"], r["unit"]]])
        placed.append((r["cut"], r["bundle"], s, filled[s]))
        filled[s] += r["rows"]
    base = d.sparkSession.createDataFrame(placed, "cut boolean, bundle bigint, shard int, base bigint")
    nth = F.row_number().over(Window.partitionBy("cut", "bundle").orderBy("key", "group"))
    return d.withColumn("nth", nth).join(F.broadcast(base), ["cut", "bundle"]).select(
        F.col("key").alias(key), "size", "n_words", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"))
