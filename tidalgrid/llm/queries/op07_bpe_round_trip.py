"""Every document encoded through the distinct-word table and decoded again."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..bpe import round_trip
from ..registry import Query, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _digests(ids: memoryview, decoded: str) -> tuple:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


FIELDS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    return round_trip(docs, path, "text", _digests, FIELDS, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", ["doc_id"])


def op7_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digests(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())


QUERY = Query("op7_bpe_round_trip", op7_bpe_round_trip)
