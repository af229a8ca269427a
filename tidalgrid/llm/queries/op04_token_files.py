"""Every document's ids in wavelet matrix files, and what reads back from them."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..registry import Query, table
from ..shared import shared_path
from ..token_files import read_token_files, write_token_files
from .op07_bpe_round_trip import tokenizer_path

END_ID = 2


def _digest(ids: np.ndarray) -> tuple:
    return len(ids), zlib.crc32(np.ascontiguousarray(ids))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = shared_path(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), "doc_id", "text", tokenizer_path(), files, END_ID)
    d = read_token_files(spark, files, _digest, {"n_tokens": pa.int64(), "ids_crc32": pa.int64()}, "n_tokens bigint, ids_crc32 bigint")
    return d.withColumnRenamed("key", "doc_id")


QUERY = Query("op4_token_files", op4_token_files)
