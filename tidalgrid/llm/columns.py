"""Column expressions shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: blank and the controls from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bind(df: DataFrame, **named: Column) -> DataFrame:
    """``df`` with further columns that are computed once a row.

    A one-row generator keeps the optimizer from copying an expensive expression into every place
    that uses it, such as the body of a lambda, where it would run once an element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in named.items()]))))


def words_of(text: Column, blanks: str = BLANKS) -> Column:
    """The words of ``text`` in order; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), blanks), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
