"""Points in blocks that meet each other: the shuffle unit is a block, the unit of arithmetic a tile.

A group of up to ``block_rows`` vectors is one block and needs no meeting at all.  In a larger group each
vector goes to the nearest of a few pivots, and a pivot's points are split by hash into blocks.  A block
then meets, as a sorted stream, only the blocks that the triangle inequality cannot rule out, so a row is
shuffled once for each block it meets: rows x blocks at most.  Inside a task, points are halved along
their widest dimension into tiles; a ball around each tile rules out most pairs where vectors are
short, and one matrix product does the rest.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import reliable_checkpoint
from .sampling import hash_sample

#: Rows of a block, most and least; between them a block is about half a task's share.
MOST_ROWS, LEAST_ROWS = 65_536, 4_096
#: A hair of slack keeps rounding in the distances from ruling out a true neighbour.
SLACK = 1e-6


@dataclass(frozen=True)
class Blocks:
    """Points with their block and, where some group has several, the distances of the pivots."""

    points: DataFrame  # g, cell, block, reach, pid, vec, w
    gaps: DataFrame | None  # cell, other, gap
    tile_rows: int

    def with_columns(self, points: DataFrame) -> "Blocks":
        return Blocks(points, self.gaps, self.tile_rows)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of the rows of ``a`` and ``b``, which should lie around the origin."""
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.clip(sq, 0.0, None))


def lifted(v: np.ndarray, left: bool) -> np.ndarray:
    """Vectors with their squares, so that one product of a left and a right side gives squared distances."""
    sq, one = (v * v).sum(axis=1)[:, None], np.ones((len(v), 1))
    return np.hstack([-2.0 * v, sq, one] if left else [v, one, sq])


#: Rows of squared distances worked on at once: they stay in the processor's cache.
STRIP, SINGLE_STRIP = 128, 256
#: Pairs whose distance is taken once more in full, at once.
EXACT_PAIRS = 16_384


def pairs_within(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the rows of ``x`` and ``y`` at most ``eps`` apart; both should lie around the origin.

    Squared distances come from products of single precision where that tells most pairs apart; what lies
    within the rounding of the product around the limit is decided by the distance itself, in double precision.
    """
    limit, terms = eps * eps, x.shape[1] + 8
    norms = [np.sqrt((v * v).sum(axis=1)) for v in (x, y)]
    scale = sum(n[np.isfinite(n)].max(initial=0.0) for n in norms) ** 2
    kind, unit = (np.float32, 2.0**-22) if 1e-30 < limit and scale < 1e30 and terms * 2.0**-22 * scale < 0.01 * limit else (np.float64, 2.0**-51)
    slack = terms * unit * scale
    left, right = lifted(x, True).astype(kind, copy=False), lifted(y, False).T.astype(kind)
    upper = kind(limit + slack)
    strip = SINGLE_STRIP if kind is np.float32 else STRIP
    room = np.empty((min(strip, len(x)), len(y)), kind)
    for at in range(0, len(x), strip):
        rows = left[at : at + strip]
        d = np.matmul(rows, right, out=room[: len(rows)])
        hits = np.flatnonzero(d <= upper)
        if not len(hits):
            continue
        i, j = np.divmod(hits, len(y))
        i += at
        unsure = np.flatnonzero(d.ravel()[hits] >= limit - slack)
        if len(unsure):
            near = np.ones(len(hits), bool)
            for k in range(0, len(unsure), EXACT_PAIRS):
                part = unsure[k : k + EXACT_PAIRS]
                near[part] = np.sqrt(((x[i[part]] - y[j[part]]) ** 2).sum(axis=1)) <= eps
            i, j = i[near], j[near]
        yield i, j


def as_matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float, copy=False) if len(v) else np.zeros((0, 0))


def rows_of(lists: pa.ListArray) -> np.ndarray:
    """A matrix of lists of numbers, which must have one length."""
    n = pc.min_max(pc.list_value_length(lists)).as_py()
    if lists.null_count or n["min"] != n["max"]:
        raise ValueError("all vectors must have the same length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(lists), n["min"] or 0)


def lay_out(
    df: DataFrame, group: str, key: str, vector: str, pivots: int = 32, block_rows: int | None = None, tile_rows: int = 1024,
    merge_equal: bool = True, seed: str = "pivots",
) -> Blocks:
    """Assign points to blocks.  The pivots, a fixed small number of rows, are the only data that reach the driver.

    ``block_rows``: by default half a task's share of all rows, between LEAST_ROWS and MOST_ROWS.
    Equal vectors are merged unless told otherwise, and carry their number as weight ``w``.
    """
    vec = F.transform(vector, lambda x: x.cast("double"))
    base = df.select(F.col(group).cast("string").alias("g"), F.col(key).alias("pid"), vec.alias("vec"))
    if merge_equal:
        base = base.groupBy("g", "vec").agg(F.min("pid").alias("pid"), F.count(F.lit(1)).alias("w"))
    else:
        base = base.withColumn("w", F.lit(1).cast("bigint"))
    base = reliable_checkpoint(base)
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
    most, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    share = (total or 0) // (2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = block_rows or min(MOST_ROWS, max(LEAST_ROWS, share))
    if (most or 0) <= rows:
        nought = F.lit(0)
        return Blocks(base.select("g", nought.alias("cell"), nought.alias("block"), nought.cast("double").alias("reach"), "pid", "vec", "w"), None, tile_rows)
    large = sizes.where(F.col("_n") > rows).select(F.col("g").alias("_of"), F.lit(True).alias("_large"))
    marked = base.join(large, F.col("g").eqNullSafe(F.col("_of")), "left").drop("_of")
    heads = as_matrix(hash_sample(marked.where("_large IS NOT NULL"), pivots, "pid", seed).select("vec").toPandas()["vec"])

    @F.pandas_udf("cell int, reach double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        d = distances(as_matrix(v), heads)
        at = d.argmin(axis=1)
        return pd.DataFrame({"cell": at.astype("int32"), "reach": d[np.arange(len(at)), at]})

    inside = F.col("_large").isNotNull()
    placed = marked.withColumn("_p", nearest("vec")).select(
        "g", F.when(inside, F.col("_p.cell")).otherwise(-1).alias("cell"), F.when(inside, F.col("_p.reach")).otherwise(0.0).alias("reach"), "pid", "vec", "w")
    cells = placed.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("_k"))
    cut = placed.join(cells.withColumnsRenamed({"g": "_g", "cell": "_c"}), F.col("g").eqNullSafe(F.col("_g")) & (F.col("cell") == F.col("_c")))
    points = cut.select("g", "cell", F.pmod(F.xxhash64("pid"), F.col("_k")).cast("int").alias("block"), "reach", "pid", "vec", "w")
    gap = distances(heads, heads)
    pairs = [(i, j, float(gap[i, j])) for i in range(len(heads)) for j in range(len(heads))]
    gaps = df.sparkSession.createDataFrame(pairs, "cell int, other int, gap double")
    return Blocks(reliable_checkpoint(points), gaps, tile_rows)


def _meetings(t: Blocks, reach: Column | None, guests: DataFrame | None = None) -> DataFrame:
    """(g, cell, block, other, other_block, foreign): each block with itself and all that may hold points within ``reach``.

    Cells of a group are paired first, at most pivots x pivots of them, then their blocks.  ``reach``
    may use the column ``bound`` of the left block; None keeps every block.  With ``guests``, only theirs are others.
    """
    more = [F.max("bound").alias("bound")] if "bound" in t.points.columns else []
    blocks = t.points.groupBy("g", "cell", "block").agg(F.max("reach").alias("r"), *more)
    others = blocks if guests is None else guests.groupBy("g", "cell", "block").agg(F.max("reach").alias("r"))
    far = others.select(F.col("g").alias("_g"), F.col("cell").alias("_cell"), F.col("block").alias("other_block"), F.col("r").alias("other_r"))
    both = blocks.where("cell >= 0").join(F.broadcast(t.gaps), "cell").join(far, F.col("g").eqNullSafe(F.col("_g")) & (F.col("other") == F.col("_cell")))
    same = (F.col("cell") == F.col("other")) & (F.col("block") == F.col("other_block"))
    both = both.where(~same if reach is None else ~same & (F.col("gap") - F.col("r") - F.col("other_r") <= reach + SLACK))
    own = blocks.select("g", "cell", "block", F.col("cell").alias("other"), F.col("block").alias("other_block"), F.lit(False).alias("foreign"))
    return own.unionByName(both.select("g", "cell", "block", "other", "other_block", F.lit(True).alias("foreign")))


class _Tile:
    """Rows that lie together: their places, and a ball around them."""

    def __init__(self, at: np.ndarray, vec: np.ndarray) -> None:
        self.at, self.centre = at, vec.mean(axis=0)
        self.radius = float(np.sqrt(((vec - self.centre) ** 2).sum(axis=1).max()))


def _tiles(vec: np.ndarray, rows: int) -> list[_Tile]:
    """Halve the rows along their widest dimension until no part has more than ``rows``."""
    out, todo = [], [np.arange(len(vec))] if len(vec) else []
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            out.append(_Tile(at, vec[at]))
            continue
        x = vec[at]
        wide = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        order = np.argpartition(x[:, wide], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


class Work:
    """What a task does for one block: its reducer sees the distances of each pair of tiles that may matter.

    A reducer has ``begin(pid, vec, w, carry)``, ``reach(rows)`` (how far the rows' answers can still change),
    ``meet(rows, d, pid, w, carry, own)`` and ``result()``.  ``d`` holds NaN where a row meets itself;
    ``own`` says that the others are of the block too, and is their places in it, else None.
    A reducer with ``squared`` set sees squared distances, which rounding may leave a hair below 0, of a few
    rows at a time: they stay in the processor's cache, and their memory is used again by the next ones.
    A reducer with ``open_pairs(a, b, own)`` names the places of two tiles whose pairs still matter, as lists of
    (left, right), and ``found(left, right, own)`` sees those of them that lie within its ``eps``.
    ``arrive(points)`` and ``leave()``, where there are any, enclose the meeting with foreign points.
    """

    #: Rows of squared distances handed out at once.
    STRIP = STRIP

    def __init__(self, reducer, points: tuple, tile_rows: int) -> None:
        pid, vec, w, carry = points
        self.reducer, self.vec, self.rows = reducer, vec, tile_rows
        self.tiles = _tiles(vec, tile_rows)
        reducer.begin(pid, vec, w, carry)
        if getattr(reducer, "meets_own", True):
            self._meet(points, self.tiles, own=True)
        if hasattr(reducer, "settle"):
            reducer.settle()

    def meet(self, points: tuple) -> None:
        if hasattr(self.reducer, "arrive"):
            self.reducer.arrive(points)
        self._meet(points, _tiles(points[1], self.rows), own=False)
        if hasattr(self.reducer, "leave"):
            self.reducer.leave()

    def _meet(self, points: tuple, tiles: list[_Tile], own: bool) -> None:
        pid, vec, w, carry = points
        if not tiles or not self.tiles:
            return
        centres, radii = np.stack([t.centre for t in tiles]), np.array([t.radius for t in tiles])
        for a in self.tiles:
            gap = np.sqrt(((centres - a.centre) ** 2).sum(axis=1)) - a.radius - radii
            near = self.vec[a.at] - a.centre
            for j in np.argsort(gap, kind="stable"):
                if gap[j] > self.reducer.reach(a.at) + SLACK:
                    break
                b = tiles[j]
                if hasattr(self.reducer, "open_pairs"):
                    self._pairs(a, b, vec, own)
                    continue
                if getattr(self.reducer, "squared", False):
                    self._strips(a, b, near, points, own)
                    continue
                d = distances(near, vec[b.at] - a.centre)
                if own and b is a:
                    np.fill_diagonal(d, np.nan)
                self.reducer.meet(a.at, d, pid[b.at], w[b.at], carry[b.at], b.at if own else None)

    def _pairs(self, a: _Tile, b: _Tile, vec: np.ndarray, own: bool) -> None:
        for left, right in self.reducer.open_pairs(a.at, b.at, own):
            near = list(pairs_within(self.vec[left] - a.centre, vec[right] - a.centre, self.reducer.eps))
            if near:
                i, j = (np.concatenate(places) for places in zip(*near, strict=True))
                self.reducer.found(left[i], right[j], own)

    def _strips(self, a: _Tile, b: _Tile, near: np.ndarray, points: tuple, own: bool) -> None:
        pid, vec, w, carry = points
        left, right = lifted(near, True), lifted(vec[b.at] - a.centre, False).T
        others = pid[b.at], w[b.at], carry[b.at], b.at if own else None
        room = np.empty((min(self.STRIP, len(a.at)), len(b.at)))
        for i in range(0, len(a.at), self.STRIP):
            rows = a.at[i : i + self.STRIP]
            d = np.matmul(left[i : i + self.STRIP], right, out=room[: len(rows)])
            if own and b is a:
                d[np.arange(len(rows)), i + np.arange(len(rows))] = np.nan
            self.reducer.meet(rows, d, *others)


def stream(
    t: Blocks, reach: Column | None, carry: Column, schema: str, reducer: Callable[[], object], guests: DataFrame | None = None
) -> DataFrame:
    """(g, ``schema``): each block's reducer after its own points and then those of every block it meets.

    Rows arrive sorted, so a task keeps one block and its running result in memory.  ``carry`` is an
    array of numbers that travels with each point.  ``guests``, rows like the points, are then the only ones that
    go to other blocks; points stay in theirs.
    """
    carried = carry.cast("array<double>").alias("carry")
    if t.gaps is None:
        rows = t.points.select("g", "cell", "block", F.lit(False).alias("foreign"), "pid", "vec", "w", carried)
        order = ["g", "cell", "block"]
    elif guests is not None:
        own = t.points.select("g", "cell", "block", F.lit(False).alias("foreign"), "pid", "vec", "w", carried)
        points = guests.select(F.col("g").alias("_g"), F.col("cell").alias("_other"), F.col("block").alias("_other_block"), "pid", "vec", "w", carried)
        meet = _meetings(t, reach, guests).where("foreign")
        same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("other") == F.col("_other")) & (F.col("other_block") == F.col("_other_block"))
        rows = own.unionByName(points.join(meet, same).select(own.columns))
        order = ["g", "cell", "block", "foreign"]
    else:
        points = t.points.select("g", F.col("cell").alias("other"), F.col("block").alias("other_block"), "pid", "vec", "w", carried)
        meet = _meetings(t, reach).withColumnsRenamed({"g": "_g", "other": "_other", "other_block": "_other_block"})
        same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("other") == F.col("_other")) & (F.col("other_block") == F.col("_other_block"))
        rows = points.join(meet, same).select("g", "cell", "block", "foreign", "other", "other_block", "pid", "vec", "w", "carry")
        order = ["g", "cell", "block", "foreign", "other", "other_block"]
    rows = rows.repartition("g", "cell", "block").sortWithinPartitions(*order).select("g", "cell", "block", "foreign", "pid", "vec", "w", "carry")
    tile_rows = t.tile_rows
    fields = StructType.fromDDL(f"g string, pid bigint, {schema}")
    made = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, work = None, [], None

        def unpack(parts: list[pa.RecordBatch]) -> tuple:
            column = lambda name: pa.chunked_array([p.column(name) for p in parts]).combine_chunks()
            numbers = lambda name: column(name).to_numpy(zero_copy_only=False)
            return numbers("pid"), rows_of(column("vec")), numbers("w"), rows_of(column("carry"))

        def finished() -> Iterator[pa.RecordBatch]:
            nonlocal held, work
            if current is not None:
                out = (work or Work(reducer(), unpack(held), tile_rows)).reducer.result()
                if len(out):
                    yield pa.RecordBatch.from_pandas(out.assign(g=pd.Series(current[0], out.index, object)), made, preserve_index=False)
            held, work = [], None

        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("g").dictionary_encode(null_encoding="encode")
            marks = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (g.indices, b.column("cell"), b.column("block"), b.column("foreign"))])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in itertools.pairwise(cuts):
                part, (name, cell, block, foreign) = b.slice(lo, hi - lo), marks[:, lo].tolist()
                at = g.dictionary[name].as_py(), cell, block
                if at != current:
                    yield from finished()
                    current = at
                if not foreign:
                    held.append(part)
                    continue
                if work is None:
                    work, held = Work(reducer(), unpack(held), tile_rows), []
                work.meet(unpack([part]))
        yield from finished()

    return rows.mapInArrow(run, fields)
