"""Every document without the bytes that 400-byte repeats cover."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..registry import Query, table
from ..suffix_dedup import whole_characters, with_spans, without


def _digest(raw: bytes, spans: list[tuple[int, int]]) -> tuple:
    kept = without(raw, whole_characters(raw, spans)).decode("utf-8", "replace")
    return len(raw), sum(z - a for a, z in spans), len(spans), hashlib.sha256(without(raw, spans)).hexdigest(), kept


#: The contract's columns, and the text that is left, cut in whole characters.
FIELDS = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}


def repeat_digests(docs: DataFrame, **options) -> DataFrame:
    return with_spans(docs, "doc_id", "text", _digest, FIELDS, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string", **options)


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_digests(table(spark, folder, "documents").select("doc_id", "text"))


QUERY = Query("op1_suffix_dedup", op1_suffix_dedup)
