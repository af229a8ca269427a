"""Operators for preparing training text at scale, and the queries that apply them to the given tables."""

from __future__ import annotations

from importlib import import_module

from .registry import Query

MODULES = [
    "op01_suffix_dedup", "op02_lm_scoring", "op03_quality_rules", "op04_token_files", "op05_quality_classifier", "op06_ngram_join", "op07_bpe_round_trip", "op08_decontamination", "op09_sharding", "op10_chat_format",
    "op11_conversation_repair", "op12_whitening", "op13_sentencepiece",
]


def llm_queries() -> list[Query]:
    return [import_module(f"{__name__}.queries.{m}").QUERY for m in MODULES]
