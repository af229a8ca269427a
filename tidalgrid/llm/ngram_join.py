"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Documents of one n-gram set are one class; only classes meet.  A bucket of a band is cut into blocks
and pairs of blocks, so no task holds more than two blocks of it, and each unit reduces its pairs at
once to counts and to links of a spanning forest: pairs are never rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .columns import fresh
from .components import components

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Hashes a signature may have at most.
MOST_HASHES = 64
#: Members of a bucket that one block takes.
BLOCK = 512


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, at which a pair at
    ``threshold`` shares a band with probability ``recall`` or more within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall; allow more hashes")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ngrams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all texts in a row, and where each text's begin (one more at the end).

    A text of fewer words, but not none, has one n-gram of all its words.
    """
    split = [(t or "").encode("utf-8", "replace").split() for t in texts]
    size = np.array([len(w) for w in split], np.int64)
    flat = [w for ws in split for w in ws]
    h = pd.util.hash_array(np.array(flat + [b""], object), categorize=False)[:-1].astype(np.uint64) if flat else np.zeros(0, np.uint64)
    begin = np.concatenate([[0], np.cumsum(size)])
    grams = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    starts = np.concatenate([[0], np.cumsum(grams)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    at = np.arange(starts[-1]) - np.repeat(starts[:-1] - begin[:-1], grams)
    past = np.repeat(begin[1:], grams)
    out = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(n):
        inside = at + j < past
        out = _mix(out + np.where(inside, h[np.minimum(at + j, len(h) - 1)], np.uint64(0)) + np.uint64(j + 1) * inside.astype(np.uint64))
    return out, starts


def _chunks(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, most * b.num_rows // max(1, b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _set_of(grams: np.ndarray) -> bytes:
    return np.unique(grams).astype("<u8").tobytes()


def signatures(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(key, text_hash, print, bands): ``print`` names the text's n-gram set (NULL without words)."""
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def compute(batches):
        for b in _chunks(batches, 2):
            grams, starts = _ngrams(b.column(2).to_pylist(), n)
            some = np.flatnonzero(np.diff(starts))
            prints: list[bytes | None] = [None] * b.num_rows
            banded: list[list[int] | None] = [None] * b.num_rows
            if len(some):
                sig = np.stack([np.minimum.reduceat(_mix(grams ^ s), starts[some]) for s in seeds])
                code = np.zeros((bands, len(some)), np.uint64)
                for r in range(rows):
                    code = _mix(code + sig[r::rows])
                code = code.T.astype(np.int64)
                for i, c in zip(some.tolist(), code.tolist(), strict=True):
                    prints[i] = hashlib.blake2b(_set_of(grams[starts[i] : starts[i + 1]]), digest_size=16).digest()
                    banded[i] = c
            yield pa.record_batch([b.column(0), b.column(1), pa.array(prints, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], names=["key", "text_hash", "print", "bands"])

    d = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return d.mapInArrow(compute, f"key {dict(docs.dtypes)[key]}, text_hash bigint, print binary, bands array<bigint>")


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """(print, grams): the sorted n-gram hashes of each ``text`` of ``docs``."""
    def compute(batches):
        for b in _chunks(batches, 0):
            grams, starts = _ngrams(b.column(0).to_pylist(), n)
            sets = [_set_of(grams[a:z]) for a, z in zip(starts, starts[1:], strict=False)]
            yield pa.record_batch({
                "print": pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), "grams": pa.array(sets, pa.binary())})

    return docs.select("text").mapInArrow(compute, "print binary, grams binary")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of ``sets`` share."""
    m = len(sets)
    if m == 2:
        k = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), k], [k, len(sets[1])]])
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # An element of one set alone is in no intersection; the rest fill a 0/1 matrix, some columns at a time.
    keep = count[column] > 1
    who, column = who[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    out, width = np.zeros((m, m), np.float64), max(256, (4 << 20) // m)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, z = np.searchsorted(column, [first, first + width])
        x = np.zeros((m, width), np.float32)
        x[who[a:z], column[a:z] - first] = 1
        out += x @ x.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def _forest(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row of its component."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify_unit(band: int, two: bool, rows: list[tuple], threshold: float) -> list[tuple]:
    """(print, documents linked, classes linked, root) of the classes of one unit with a link."""
    rows = sorted(rows, key=lambda r: r[0])
    sets = [np.frombuffer(r[4], "<u8") for r in rows]
    size = np.array([len(s) for s in sets])
    inter = _shared(sets)
    either = size[:, None] + size[None, :] - inter
    link = inter * 1.0 >= threshold * either - 1e-9
    np.fill_diagonal(link, False)
    codes = np.array([r[3] for r in rows], np.int64)
    # A pair counts in the first band it shares, so once.
    for b in range(band):
        link &= codes[:, b][:, None] != codes[:, b][None, :]
    block, copies = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)
    if two:
        link &= block[:, None] != block[None, :]
    root = _forest(link)
    return [(rows[i][0], int(copies[link[i]].sum()), int(link[i].sum()), rows[root[i]][0]) for i in np.flatnonzero(link.any(axis=1))]


def verified_links(units: DataFrame, threshold: float, partitions: int) -> DataFrame:
    """From (band, code, b1, b2, print, block, copies, bands, grams) rows to (print, documents, classes, root)."""
    schema = pa.schema([("print", pa.binary()), ("documents", pa.int64()), ("classes", pa.int64()), ("root", pa.binary())])
    unit = ["band", "code", "b1", "b2"]

    def compute(batches):
        now, held = None, []

        def done():
            found = _verify_unit(now[0], now[2] != now[3], held, threshold)
            if found:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for band, code, b1, b2, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (band, code, b1, b2) != now:
                    if len(held) > 1:
                        yield from done()
                    now, held = (band, code, b1, b2), []
                held.append(tuple(row))
        if len(held) > 1:
            yield from done()

    d = units.select(*unit, "print", "block", "copies", "bands", "grams").repartition(partitions, *unit).sortWithinPartitions(*unit)
    return d.mapInArrow(compute, "print binary, documents bigint, classes bigint, root binary")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """Per row of ``docs``: key, text_hash, class_id, copy_id, n_links, n_class_links.

    ``copy_id`` is the smallest key of the documents with the same n-gram set, ``class_id`` the
    smallest of all that links of similarity ``threshold`` or more connect.  ``n_links`` counts the
    other documents linked to this one, ``n_class_links`` the other n-gram sets.  Texts without words
    (NULL, empty, blank) link to nothing: both ids are their own key.  Repeated rows are copies.
    """
    return _with_components(docs, key, text, n, threshold, recall).drop("component")


def _with_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """``near_duplicates`` and the print that names each class (NULL without words)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands, rows = choose_bands(threshold, recall)
    a = reliable_checkpoint(signatures(docs, key, text, n, bands, rows))
    named = a.where(F.col("print").isNotNull())
    one = F.struct("key", "text_hash", "bands")
    classes = reliable_checkpoint(named.groupBy("print").agg(F.count("*").alias("copies"), F.min(one).alias("one")).select(
        "print", "copies", F.col("one.key").alias("least"), F.col("one.text_hash").alias("one_hash"), F.col("one.bands").alias("bands")))
    member = classes.select("print", F.posexplode("bands").alias("band", "code"))
    ids = [F.bit_xor(F.xxhash64("print")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "print")).alias("m2")]
    buckets = member.groupBy("band", "code").agg(F.count("*").alias("n"), *ids).where("n > 1")
    # Buckets of the same members are one: the first band keeps it.
    buckets = buckets.groupBy("m1", "m2", "n").agg(F.min(F.struct("band", "code")).alias("first")).select("first.band", "first.code", "n")
    placed = reliable_checkpoint(member.join(buckets, ["band", "code"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("print"), "blocks").cast("int")).select("print", "band", "code", "block", "blocks"))
    needed = placed.select("print").distinct().join(classes, "print")
    d = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text")).alias("d")
    picked = d.join(needed.select("least", "one_hash").alias("r"), F.col("d.key").eqNullSafe(F.col("r.least")) & (F.col("d.text_hash") == F.col("r.one_hash")))
    # Repeated rows would give one set twice.
    sets = gram_sets(picked.select("d.text"), n).groupBy("print").agg(F.first("grams").alias("grams"))
    full = needed.select("print", "copies", "bands").join(sets, "print")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = placed.select("print", "band", "code", "block", other).select(
        "print", "band", "code", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block")
    found = reliable_checkpoint(verified_links(units.join(full, "print"), threshold, partitions))
    links = found.groupBy("print").agg(F.sum("documents").alias("documents"), F.sum("classes").alias("classes"))
    parts = components(found.select(F.col("print").alias("a"), F.col("root").alias("b")))
    c = classes.select("print", "copies", "least").join(links, "print", "left").join(parts.withColumnRenamed("node", "print"), "print", "left")
    c = reliable_checkpoint(c.select("print", "copies", "least", "documents", "classes", F.coalesce("component", "print").alias("component")))
    least = c.groupBy("component").agg(F.min("least").alias("class_id"))
    c = c.join(least, "component").select("print", "copies", "least", "documents", "classes", "class_id", "component")
    zero = F.lit(0).cast("bigint")
    return a.select("key", "text_hash", "print").join(c, "print", "left").select(
        F.col("key").alias(key), "text_hash",
        F.when(F.col("print").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("print").isNull(), F.col("key")).otherwise(F.col("least")).alias("copy_id"),
        (F.coalesce("documents", zero) + F.coalesce(F.col("copies") - 1, zero)).alias("n_links"), F.coalesce("classes", zero).alias("n_class_links"), "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one with the smallest key (then text hash).

    A row without a key stays only in a class where no row has one.  Classes are told apart by their
    texts, so rows of one key, or of none, with unrelated texts all stay.  Of rows equal in key and text
    the one whose JSON is least stays.  Texts without words are all kept.  Other columns may have any names.
    """
    near = reliable_checkpoint(_with_components(docs, key, text, **options).where(F.col("component").isNotNull()).select(F.col(key).alias("key"), "text_hash", "component"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")).alias("first")
    own, digest, mine = (fresh(docs, n) for n in ("kept_key", "kept_hash", "text_hash"))
    chosen = near.groupBy("component").agg(first).select(F.col("first.key").alias(own), F.col("first.text_hash").alias(digest))
    d = docs.withColumn(mine, F.xxhash64(F.col(text)))
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = d.where(worded).join(chosen, F.col(key).eqNullSafe(F.col(own)) & (F.col(mine) == F.col(digest)), "left_semi")
    if near.groupBy("key", "text_hash").count().where("count > 1").limit(1).count():
        row = F.struct(*[F.col(f"`{c}`") for c in d.columns])
        kept = kept.groupBy(F.col(key).alias("k"), F.col(mine).alias("h")).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.unionByName(d.where(~worded)).drop(mine)
