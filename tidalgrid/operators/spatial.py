"""Zone network, group context, distances and point-in-polygon assignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .panel import checked_broadcast


def symmetric_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(zone_id, neighbor_id) in both directions, once each, no loops."""
    both = edges.select(F.col(a).alias("zone_id"), F.col(b).alias("neighbor_id"))
    return both.unionByName(both.select(F.col("neighbor_id").alias("zone_id"), F.col("zone_id").alias("neighbor_id"))).where("zone_id <> neighbor_id").distinct()


def neighbor_context(panel: DataFrame, edges: DataFrame, metrics: Sequence[str], key: Sequence[str] = ("date", "temporal_bucket")) -> DataFrame:
    """Mean of each metric over connected zones on the same date and bucket, and how many there are.

    Values are sent to the zones that neighbour them (edges are a small network), averaged there and
    joined back on the panel key.
    """
    sent = panel.select(F.col("zone_id").alias("neighbor_id"), *key, *metrics).join(checked_broadcast(edges), "neighbor_id")
    context = sent.groupBy("zone_id", *key).agg(
        F.count(F.lit(1)).alias("neighbor_count"), *[F.avg(m).alias(f"connected_{m}") for m in metrics]
    )
    return panel.join(context, ["zone_id", *key], "left").fillna(0, ["neighbor_count"])


def group_context(panel: DataFrame, group: str, metrics: Sequence[str], prefix: str, key: Sequence[str] = ("date", "temporal_bucket")) -> DataFrame:
    """Group mean of each metric per date and bucket on every row; a window holds one row per zone."""
    w = W.partitionBy(group, *key)
    return panel.withColumns({f"{prefix}_{m}": F.avg(m).over(w) for m in metrics})


def zone_flags(zones: DataFrame, edges: DataFrame, core: Sequence[int], gateways: Sequence[int], zone: str = "zone_id") -> DataFrame:
    """Core membership, adjacency to the core, and gateway flags per zone."""
    near = edges.where(F.col("neighbor_id").isin(list(core))).select(F.col("zone_id").alias(zone)).distinct().withColumn("_near", F.lit(1))
    inside = F.col(zone).isin(list(core)).cast("int")
    return zones.join(checked_broadcast(near), zone, "left").withColumns(
        {
            "is_core": inside,
            "is_core_adjacent": F.when(inside == 0, F.coalesce("_near", F.lit(0))).otherwise(0),
            "is_gateway": F.col(zone).isin(list(gateways)).cast("int"),
        }
    ).drop("_near")


def distance_to_set(zones: DataFrame, members: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Least centroid distance to the member zones.

    The member centroids, a handful of dimension rows, reach every row as one scalar array.
    """
    spots = zones.where(members).agg(F.collect_list(F.struct(F.col(x).alias("px"), F.col(y).alias("py")))).scalar()
    out = zones.withColumn("_spots", spots)
    gap = F.transform("_spots", lambda p: F.sqrt((F.col(x) - p["px"]) * (F.col(x) - p["px"]) + (F.col(y) - p["py"]) * (F.col(y) - p["py"])))
    return out.withColumn("distance_to_set", F.array_min(gap)).drop("_spots")


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray casting against an array of (x, y) corners, open or closed."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i + 1), F.element_at(ring, F.when(i + 1 == n, 1).otherwise(i + 2))
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(spans & (x < at), 1).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crosses(i))
    return hits % 2 == 1


def point_to_zone(
    points: DataFrame, polygons: DataFrame, cell: float, point_key: str, x: str = "x", y: str = "y", ring: str = "ring", zone: str = "zone_id",
    rescue: Sequence[tuple[Column, int]] = (),
) -> DataFrame:
    """Zone of each point by polygon containment without buffer, then by named rescue rules.

    Polygons unfold to the grid cells of their bounding box, so points meet only nearby polygons
    through an equi-join on the cell.  The smallest zone wins where polygons overlap.
    """
    at = lambda c: F.floor(c / F.lit(cell))
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    cells = polygons.withColumn("_cx", F.explode(F.sequence(at(F.array_min(xs)), at(F.array_max(xs)))))
    cells = cells.withColumn("_cy", F.explode(F.sequence(at(F.array_min(ys)), at(F.array_max(ys))))).select(F.col(zone).alias("_zone"), F.col(ring).alias("_ring"), "_cx", "_cy")
    placed = points.withColumns({"_cx": at(F.col(x)), "_cy": at(F.col(y))})
    hits = placed.join(checked_broadcast(cells), ["_cx", "_cy"]).where(inside_ring(F.col(x), F.col(y), F.col("_ring")))
    found = hits.groupBy(point_key).agg(F.min("_zone").alias(zone))
    out = points.join(found, point_key, "left").withColumn("assignment", F.when(F.col(zone).isNotNull(), "polygon"))
    for condition, target in rescue:
        use = F.col(zone).isNull() & condition
        out = out.withColumns(
            {"assignment": F.when(use, "rescue").otherwise(F.col("assignment")), zone: F.when(use, F.lit(target)).otherwise(F.col(zone))}
        )
    return out
