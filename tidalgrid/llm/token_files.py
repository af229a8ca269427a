"""Token ids of all texts in wavelet matrix files, a few a task, and reading them back.

The files are kept as a Parquet dataset (shard, first key, n_ids, data): Spark's commit protocol then
covers lost executors and stores without a local path.  ``data`` is the whole file of ``wavelet.py``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge_ranks import rank_encoder
from .wavelet import WaveletMatrix

#: Texts encoded at once, in bytes.
_BATCH = 8 << 20
#: Text a task gets, in bytes, and ids after which it closes a file.
SHARD_BYTES, IDS_A_FILE = 64 << 20, 16 << 20


def write_token_files(
    docs: DataFrame, key: str, text: str, path: str, folder: str, end_id: int, bits: int = 16, shards: int | None = None, ids_a_file: int = IDS_A_FILE,
) -> None:
    """Encode each whole ``text`` (NULL: empty), append ``end_id`` and write ids by ascending ``key``.

    ``key`` is a long column, NULL first; ties and repeated rows are ordered by the text's first characters and hash.
    Ranges of about SHARD_BYTES of text (or ``shards`` of them) go to one task each; rows of one key may
    lie in several.  A task writes a file whenever ``ids_a_file`` ids have come, so neither a range nor a file
    grows with the table; a file holds whole texts, one at least.  An id that ``bits`` cannot hold raises ValueError.
    Other columns are not read; an empty table writes no file.
    """
    d = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if shards is None:
        size = d.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    d = d.select("key", "text", F.left("text", F.lit(32)).alias("start"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("number"))
    order = ["key", "start", "hash", "number"]
    kind = np.uint16 if bits <= 16 else np.uint32

    def file(k: int, keys: list, ids: list, sizes: list) -> pa.RecordBatch:
        all_keys = pa.chunked_array(keys).combine_chunks()
        known = all_keys.fill_null(0).to_numpy(zero_copy_only=False)
        stream = np.concatenate(ids)
        data = WaveletMatrix.build(stream, bits).to_bytes(keys=known, sizes=np.concatenate(sizes), nulls=np.array([all_keys.null_count], np.int64))  # NULL keys come first
        return pa.record_batch({
            "shard": pa.array([(TaskContext.get().partitionId() << 32) + k], pa.int64()), "n_ids": pa.array([len(stream)], pa.int64()), "data": pa.array([data], pa.binary())})

    def encode(batches):
        encoder, files, held, n = rank_encoder(path), 0, ([], [], []), 0
        for b in batches:
            step = max(1, _BATCH * b.num_rows // max(1, b.nbytes))
            for i in range(0, b.num_rows, step):
                piece = b.slice(i, step)
                flat, size = encoder.encode(piece.column(1).to_pylist())
                if max(int(flat.max(initial=0)), end_id) >> bits:
                    raise ValueError(f"ids need more than {bits} bits")
                for column, x in zip(held, (piece.column(0), np.insert(flat.astype(kind), np.cumsum(size), end_id), size + 1), strict=True):
                    column.append(x)
                n += len(flat) + len(size)
                if n >= ids_a_file:
                    yield file(files, *held)
                    files, held, n = files + 1, ([], [], []), 0
        if n:
            yield file(files, *held)

    d = d.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("key", "text")
    d.mapInArrow(encode, "shard bigint, n_ids bigint, data binary").write.mode("overwrite").parquet(folder)


def read_token_files(
    spark: SparkSession, folder: str, row: Callable[[np.ndarray], tuple], fields: dict[str, pa.DataType], sql: str,
) -> DataFrame:
    """Per document of the files in ``folder``: key, start (ids of all documents before it) and ``row(ids)``.

    Where a shard begins is the sum over the shards before it: one number a shard goes to the driver.
    """
    files = spark.read.parquet(folder)
    starts, total = {}, 0
    for shard, n in files.select("shard", "n_ids").orderBy("shard").collect():
        starts[shard] = total
        total += n

    def read(batches):
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                matrix, columns = WaveletMatrix.from_bytes(data)
                ids, sizes = matrix.to_array().astype("<u4", copy=False), columns["sizes"]
                ends = np.cumsum(sizes)
                out = [row(ids[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                key = pa.array(columns["keys"], mask=np.arange(len(sizes)) < columns["nulls"][0])
                yield pa.record_batch(
                    [key, pa.array(starts[shard] + ends - sizes)] + [pa.array([r[j] for r in out], kind) for j, kind in enumerate(fields.values())],
                    names=["key", "start", *fields])

    return files.select("shard", "data").mapInArrow(read, f"key bigint, start bigint, {sql}")
