"""From raw documents to encoded training text: each stage works on all that the one before it kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, written
as Parquet and read again for the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidalgrid.llm.columns import fresh
from tidalgrid.llm.decontamination import contamination
from tidalgrid.llm.ngram_join import keep_one
from tidalgrid.llm.quality_rules import passing
from tidalgrid.llm.queries.op07_bpe_round_trip import bpe_digests, tokenizer_path
from tidalgrid.llm.registry import table
from tidalgrid.llm.shared import shared_path
from tidalgrid.llm.suffix_dedup import remove_repeats

from pyspark.sql import functions as F


#: Passages of over 50 words are to be caught: 51 words of three letters and a blank each take 203 bytes.
REPEAT_BYTES = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by repeats of ``REPEAT_BYTES`` go, in whole characters; ``n_chars`` follows the text."""
    d = remove_repeats(docs, length=REPEAT_BYTES)
    return d.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items contaminate go."""
    key, digest = fresh(docs, "found_key"), fresh(docs, "found_hash")
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(digest)), "left_anti")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded: doc_id, n_tokens and digests of ids and decoded text."""
    return bpe_digests(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_texts),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL can express neither the repeats nor the encoding; tests/llm/test_pipeline.py has brute force for both.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
