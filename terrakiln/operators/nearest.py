"""Nearest lines and points, distances and exclusion zones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrakiln.functions.geo import segment_distance
from terrakiln.functions.scalar import finite
from terrakiln.operators.order import cut

#: The finest grid has so many cells to a side.
FINEST = 4096


def _cells(segments: DataFrame, cell: float) -> DataFrame:
    """`segments` with cx, cy of each grid cell that they pass through, column by column."""
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    listed = segments.withColumn("cx", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    # The part of the segment within the column; a vertical one is in one column with all its length.
    rise = F.try_divide(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    at = lambda x: F.when(rise.isNull(), None).otherwise(F.col("ay") + (x - F.col("ax")) * rise)
    first = at(F.greatest(low, F.col("cx") * cell))
    last = at(F.least(high, (F.col("cx") + 1) * cell))
    bottom = F.coalesce(F.least(first, last), F.least("ay", "by"))
    top = F.coalesce(F.greatest(first, last), F.greatest("ay", "by"))
    slack = 1e-6
    return listed.withColumn("cy", F.explode(F.sequence(F.floor(bottom / cell - slack), F.floor(top / cell + slack))))


def nearest_segment(points: DataFrame, segments: DataFrame, cell: float | None = None) -> DataFrame:
    """point_id, px, py, segment_id, dist: one row for each point, with its nearest segment, exactly, ties to the least id.

    points: point_id, px, py; segments: segment_id, ax, ay, bx, by, all in one plane. Segments are listed under
    the grid cells that they pass through, and places look into the 3 x 3 cells around them: what is nearer
    than a cell's side is settled, and the others look again in a grid of twice the side, until the side is
    twice the extent. So the number of rounds is the extent's logarithm, and every place is settled. `cell`:
    the first side, by default the extent over the root of the number of segments. Points of one place share
    a look-up, whatever their ids; one with a missing coordinate has no segment, nor has any if there is
    none; segments with a missing coordinate or id are left out.
    """
    ends = ["ax", "ay", "bx", "by"]
    whole = lambda df, columns: df.where(sum((finite(F.col(c)).isNull().cast("int") for c in columns[1:]), finite(F.col(columns[0])).isNull().cast("int")) == 0)
    known = whole(segments.where(F.col("segment_id").isNotNull()), ends).select("segment_id", *ends)
    places = whole(points, ["px", "py"]).select("px", "py").distinct()
    n, *box = known.agg(F.count("*"), F.min(F.least("ax", "bx")), F.max(F.greatest("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ay", "by"))).first()
    around = places.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if not n or around[0] is None:
        empty = points.select("point_id", "px", "py", F.lit(None).cast(known.schema["segment_id"].dataType).alias("segment_id"), F.lit(None).cast("double").alias("dist"))
        return empty
    extent = max(max(box[1], around[1]) - min(box[0], around[0]), max(box[3], around[3]) - min(box[2], around[2])) or 1.0
    side = max(cell or extent / math.isqrt(n), extent / FINEST)
    out, left = None, places
    while True:
        near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
        asked = left.withColumn("cx", F.explode(F.transform(near, lambda k: F.floor(F.col("px") / side) + k)))  # noqa: B023
        asked = asked.withColumn("cy", F.explode(F.transform(near, lambda k: F.floor(F.col("py") / side) + k)))  # noqa: B023
        met = asked.join(_cells(known, side), ["cx", "cy"]).withColumn("dist", segment_distance(*[F.col(c) for c in ("px", "py", *ends)]))
        found = met.groupBy("px", "py").agg(F.min(F.struct("dist", "segment_id")).alias("b")).where(F.col("b.dist") < side)
        found = cut(found)
        out = found if out is None else out.unionByName(found)
        if side > 2 * extent:
            break
        left = left.join(found.select("px", "py"), ["px", "py"], "left_anti")
        if left.isEmpty():
            break
        side *= 2
    return points.join(out, ["px", "py"], "left").select("point_id", "px", "py", F.col("b.segment_id").alias("segment_id"), F.col("b.dist").alias("dist"))


def nearest_point(points: DataFrame, targets: DataFrame) -> DataFrame:
    """point_id, px, py, segment_id, dist; targets: segment_id, ax, ay."""
    return nearest_segment(points, targets.select("segment_id", "ax", "ay", F.col("ax").alias("bx"), F.col("ay").alias("by")))


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the first in `order`."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def outside(points: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Points at least `radius` from every centre (cx, cy); the radius is the grid's side, so near ones share or adjoin a cell."""
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    asked = points.withColumn("_i", F.explode(F.transform(around, lambda k: F.floor(F.col("px") / radius) + k)))
    asked = asked.withColumn("_j", F.explode(F.transform(around, lambda k: F.floor(F.col("py") / radius) + k)))
    listed = centres.select("cx", "cy", F.floor(F.col("cx") / radius).alias("_i"), F.floor(F.col("cy") / radius).alias("_j")).distinct()
    near = asked.join(listed, ["_i", "_j"]).where(F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy")) < radius)
    return points.join(near.select("point_id").distinct(), "point_id", "left_anti")


def least_distance(points: DataFrame, centres: DataFrame) -> DataFrame:
    """point_id, dist: how far each point (px, py) is from the nearest centre (cx, cy)."""
    targets = centres.select("cx", "cy").distinct().withColumn("segment_id", F.monotonically_increasing_id())
    found = nearest_point(points, cut(targets.select("segment_id", F.col("cx").alias("ax"), F.col("cy").alias("ay"))))
    return found.select("point_id", "dist")
