"""Benchmark decontamination with a positional inverted index, by DataFrame operations only.

A phrase is found through its rarest term: postings of that term, moved back by its offset in the
phrase, are the only places where the phrase can begin, and the words around the posting decide.
Postings of terms that are no phrase's rarest term are never needed, so they are not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .columns import bind, lower_ascii, words_of

#: What separates words in texts and items: all of ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window; a shorter item is one window.
WINDOW = 13
#: Phrases (or terms) sent to every executor at once; more are looked up in blocks of this size.
BROADCAST_ROWS = 100_000


def item_words(text: Column) -> Column:
    return words_of(lower_ascii(text), SEPARATORS)


def windows_of(items: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct windows (words) with the ``items`` (as strings) they come from.

    NULL, empty and wordless items have no window; items of the same words share theirs.
    """
    d = bind(items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")), ws=item_words(F.col("text")))
    size = F.size("ws")
    spans = F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("ws", i, n))).when(size > 0, F.array("ws")).otherwise(F.array().cast("array<array<string>>"))
    return d.select("item", F.explode(spans).alias("words")).groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _blocks(df: DataFrame, key: Column) -> list[DataFrame]:
    """``df`` in blocks of at most about ``BROADCAST_ROWS`` rows each, for one broadcast after another."""
    n = -(-df.count() // BROADCAST_ROWS)
    return [df] if n <= 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def term_counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` (term) occurs in all of ``docs``; terms that do not occur are left out."""
    words = docs.select(F.explode(item_words(F.col(text))).alias("term"))
    return _union([words.join(F.broadcast(b), "term").groupBy("term").agg(F.count("*").alias("n")) for b in _blocks(terms, F.col("term"))])


def keyed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its rarest ``term`` (ties: the smallest) and the term's first ``offset`` (from 0) in it.

    A window with a word that occurs nowhere cannot occur and is left out.
    """
    w = windows.withColumn("id", F.xxhash64("words"))
    each = w.select("id", "words", F.posexplode("words").alias("offset", "term")).join(counts, "term", "left")
    best = each.groupBy("id", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")).alias("rare"))
    return w.join(best.where("rare.n > 0").select("words", "rare.term", "rare.offset"), "words").select("words", "items", "term", "offset")


def positional_postings(docs: DataFrame, keys: list[str], text: str, terms: DataFrame, radius: int = WINDOW - 1) -> DataFrame:
    """The index: (term, *keys, position, before, context) for every place of each of ``terms`` in ``docs``.

    ``context`` has up to ``radius`` words on either side, ``before`` of them in front of the term.
    """
    d = bind(docs.select(*keys, F.col(text).alias("t")), ws=item_words(F.col("t"))).select(*keys, "ws")
    places = d.select(*keys, "ws", F.posexplode("ws").alias("position", "term"))
    lo = F.greatest(F.col("position") - radius, F.lit(0))

    def of(block: DataFrame) -> DataFrame:
        return places.join(F.broadcast(block), "term").select(
            "term", *keys, "position", (F.col("position") - lo).alias("before"),
            F.slice("ws", lo + 1, F.col("position") - lo + radius + 1).alias("context"))

    return _union([of(b) for b in _blocks(terms, F.col("term"))])


def phrase_matches(postings: DataFrame, keys: list[str], phrases: DataFrame) -> DataFrame:
    """Where each of ``phrases`` (words, items, term, offset) occurs: (*keys, start, length, items)."""
    first = F.col("before") - F.col("offset") + 1
    here = F.slice("context", first, F.size("words"))

    def of(block: DataFrame) -> DataFrame:
        m = postings.join(F.broadcast(block), "term").where((first >= 1) & F.when(first >= 1, here == F.col("words")))
        return m.select(*keys, (F.col("position") - F.col("offset")).alias("start"), F.size("words").alias("length"), "items")

    return _union([of(b) for b in _blocks(phrases, F.col("words"))])


def proximity_matches(postings: DataFrame, keys: list[str], groups: DataFrame) -> DataFrame:
    """Where all ``words`` of a group (words, items, term) stand near one another: (*keys, position, items).

    Near means within the postings' radius of the group's rarest term, in any order.
    """
    def of(block: DataFrame) -> DataFrame:
        m = postings.join(F.broadcast(block), "term").where(F.size(F.array_except("words", "context")) == 0)
        return m.select(*keys, "position", "items")

    return _union([of(b) for b in _blocks(groups, F.col("words"))])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, items (sorted array), contaminated.

    A word inside any occurrence of a window is hit.  A document is contaminated if some word is hit and
    the hits make up a twentieth of its words or more.  NULL and empty texts have no words.  Rows equal
    in key and text are one document to the index and all come back.
    """
    d = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    windows = reliable_checkpoint(windows_of(items, item, item_text))
    terms = windows.select(F.explode("words").alias("term")).distinct()
    phrases = reliable_checkpoint(keyed(windows, term_counts(d, "text", terms)))
    postings = reliable_checkpoint(positional_postings(d, ["key", "text_hash"], "text", phrases.select("term").distinct()))
    m = phrase_matches(postings, ["key", "text_hash"], phrases)
    found = m.groupBy("key", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("items").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    found = found.select("key", "text_hash", F.size(covered).cast("bigint").alias("hit"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("found"))
    sizes = d.select("key", "text_hash", F.size(item_words(F.col("text"))).cast("bigint").alias("n_words")).alias("d")
    f = found.alias("f")
    out = sizes.join(f, F.col("d.key").eqNullSafe(F.col("f.key")) & F.col("d.text_hash").eqNullSafe(F.col("f.text_hash")), "left")
    hit = F.coalesce("hit", F.lit(0).cast("bigint"))
    return out.select(
        F.col("d.key").alias(key), F.col("d.text_hash").alias("text_hash"), "n_words", hit.alias("n_hit"),
        F.coalesce("found", F.array().cast("array<string>")).alias("items"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))
