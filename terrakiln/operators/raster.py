"""Rasters as pixel tables: raster_id, row, col, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakiln.functions.scalar import density, finite, slope_aspect, south_factor


def pixels(tiles: DataFrame, tile: str, values: str, width: int) -> DataFrame:
    """raster_id, row, col, value of tiles kept as row-major arrays."""
    flat = tiles.select(F.col(tile).alias("raster_id"), F.posexplode(values).alias("pos", "value"))
    return flat.select("raster_id", F.floor(F.col("pos") / width).cast("int").alias("row"), (F.col("pos") % width).cast("int").alias("col"), F.col("value").cast("double"))


def terrain(grid: DataFrame, size: float) -> DataFrame:
    """raster_id, row, col, elevation, slope, aspect, south of cells whose 3 x 3 window is whole.

    Each cell is added to its nine windows and one aggregate gathers them, so no cell looks another up.
    """
    shift = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)]))
    spread = grid.select("raster_id", "row", "col", finite(F.col("value")).alias("value"), shift.alias("s"))
    at = lambda r, c: F.max(F.when((F.col("s.r") == -r) & (F.col("s.c") == -c), F.col("value")))
    windows = spread.groupBy("raster_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col")).agg(
        at(0, 0).alias("elevation"), at(0, -1).alias("_l"), at(0, 1).alias("_r"), at(-1, 0).alias("_a"), at(1, 0).alias("_b"), F.count("value").alias("_n")
    )
    slope, aspect = slope_aspect(F.col("_l"), F.col("_r"), F.col("_a"), F.col("_b"), size)
    whole = windows.where(F.col("_n") == 9).withColumns({"slope": slope, "aspect": aspect})
    return whole.select("raster_id", "row", "col", "elevation", "slope", "aspect", south_factor(F.col("aspect")).alias("south"))


def terrain_by_window(tiles: DataFrame, tile: str, values: str, width: int, size: float) -> DataFrame:
    """terrain() of whole tiles kept as arrays: the windows are read within the array, without a shuffle."""
    inner = F.sequence(F.lit(1), F.lit(width - 2))
    cells = tiles.select(F.col(tile).alias("raster_id"), F.col(values).alias("v"), F.explode(inner).alias("row")).select("*", F.explode(inner).alias("col"))
    at = lambda r, c: finite(F.col("v")[(F.col("row") + r) * width + F.col("col") + c].cast("double"))
    every = [at(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    whole = cells.where(sum((x.isNull().cast("int") for x in every[1:]), every[0].isNull().cast("int")) == 0)
    slope, aspect = slope_aspect(at(0, -1), at(0, 1), at(-1, 0), at(1, 0), size)
    out = whole.select("raster_id", "row", "col", at(0, 0).alias("elevation"), slope.alias("slope"), aspect.alias("aspect"))
    return out.withColumn("south", south_factor(F.col("aspect")))


def sample(points: DataFrame, grid: DataFrame, on: list[str], shape: tuple[int, int] | None = None, edge: int = 0) -> DataFrame:
    """points (raster_id, row, col) with their cell's value; null outside, on a missing cell and on an edge of `edge` cells."""
    out = points.join(grid.select(*on, finite(F.col("value")).alias("value")), on, "left")
    if shape is None:
        return out
    clear = F.col("row").between(edge, shape[0] - 1 - edge) & F.col("col").between(edge, shape[1] - 1 - edge)
    return out.withColumn("value", F.when(clear, F.col("value")))


def window_median(points: DataFrame, grid: DataFrame, reach: int = 2) -> DataFrame:
    """point_id and the median of the known pixels up to `reach` rows and columns off; null if none.

    Points list the cells they ask for, so that the join is on equal cells.
    """
    near = F.sequence(F.lit(-reach), F.lit(reach))
    cells = F.flatten(F.transform(near, lambda r: F.transform(near, lambda c: F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")))))
    asked = points.select("point_id", "raster_id", F.explode(cells).alias("cell")).select("point_id", "raster_id", "cell.row", "cell.col")
    met = asked.join(grid.select("raster_id", "row", "col", finite(F.col("value")).alias("value")), ["raster_id", "row", "col"], "left")
    return met.groupBy("point_id").agg(F.median("value").alias("value"))


def composite(stack: DataFrame, batch: Column) -> DataFrame:
    """row, col and the median of the batches' medians, which isn't the median of all scenes."""
    known = stack.withColumn("value", finite(F.col("value"))).withColumn("_batch", batch)
    inner = known.groupBy("_batch", "row", "col").agg(F.median("value").alias("value"))
    return inner.groupBy("row", "col").agg(F.median("value").alias("value"))


def vegetation(
    df: DataFrame, ndvi: str, ndmi: str, fetched_ndvi: str, fetched_ndmi: str, has_raster: Column, may_fetch: Column, default_ndvi: float = 0.5, default_ndmi: float = 0.3, allow_fallback: bool = True, enabled: bool = True
) -> DataFrame:
    """`df` with ndvi_mean, ndmi_mean, vegetation_density and veg_source.

    Without a raster: the defaults. A known pixel: it, and its NDMI or the default. A missing pixel: the
    fetched scene, if it may be fetched and has a value. Else the defaults, or an error without fallback.
    """
    a, b, c, d = (finite(F.col(x).cast("double")) for x in (ndvi, ndmi, fetched_ndvi, fetched_ndmi))
    source = F.when(F.lit(enabled) & has_raster & a.isNotNull(), "raster").when(F.lit(enabled) & has_raster & may_fetch & c.isNotNull(), "scene").otherwise("default")
    if not allow_fallback:
        source = F.when(source != "default", source).otherwise(F.raise_error(F.lit("no vegetation value and no fallback")))
    out = df.withColumn("veg_source", source)
    ndvi_mean = F.when(F.col("veg_source") == "raster", a).when(F.col("veg_source") == "scene", c).otherwise(F.lit(default_ndvi))
    ndmi_mean = F.coalesce(F.when(F.col("veg_source") == "raster", b).when(F.col("veg_source") == "scene", d), F.lit(default_ndmi))
    return out.withColumns({"ndvi_mean": ndvi_mean, "ndmi_mean": ndmi_mean}).withColumn("vegetation_density", density(F.col("ndvi_mean")))


def by_year(ndvi_year: Column, ndmi_year: Column, ndvi_any: Column, ndmi_any: Column) -> tuple[Column, Column]:
    """The year's composites if both are there, else the general ones."""
    both = ndvi_year.isNotNull() & ndmi_year.isNotNull()
    return F.when(both, ndvi_year).otherwise(ndvi_any), F.when(both, ndmi_year).otherwise(ndmi_any)


def first_finite(scenes: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, the first known value in order, and the position of its scene."""
    known = scenes.where(finite(F.col(value)).isNotNull())
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return known.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
