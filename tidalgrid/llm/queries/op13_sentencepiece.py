"""Every document encoded by the sentencepiece model and decoded again."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..piece_codec import map_encoded
from ..registry import Query, table
from .op07_bpe_round_trip import tokenizer_path


def _digests(ids, begin, end, decoded: str) -> tuple:
    written = " ".join(map(str, ids.tolist())).encode()
    return len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), int((end - begin).sum())


FIELDS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "covered_bytes": pa.int64()}


def op13_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """The contract's columns, and covered_bytes: source bytes in the spans of all pieces."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return map_encoded(
        docs, tokenizer_path("piece_bpe_32k.model"), "text", _digests, FIELDS, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, covered_bytes bigint", ["doc_id"])


QUERY = Query("op13_sentencepiece", op13_sentencepiece)
