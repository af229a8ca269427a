"""Collecting named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


class Family:
    """The queries of one module, added by decorator."""

    def __init__(self) -> None:
        self.items: list[Query] = []

    def query(self, *covers: str, sql: str | None = None):
        def add(fn):
            self.items.append(Query(fn.__name__, fn, sql, covers))
            return fn

        return add
