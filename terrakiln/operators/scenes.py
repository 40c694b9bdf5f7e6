"""Selection of scenes from a catalogue: scene_id, pos, cloud (and cell)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidates(catalogue: DataFrame, most_cloud: float) -> DataFrame:
    return catalogue.where(F.col("cloud") < most_cloud)


def cell_of(x: Column, y: Column, box: tuple[float, float, float, float], cells: int = 6) -> tuple[Column, Column]:
    """Column and row of the grid over west, south, east, north; centres outside go to the border cells."""
    west, south, east, north = box
    clamp = lambda v: F.least(F.lit(cells - 1), F.greatest(F.lit(0), v.cast("int")))
    return clamp((x - west) / ((east - west) / cells)), clamp((y - south) / ((north - south) / cells))


def by_cloud(catalogue: DataFrame, most: int | None) -> DataFrame:
    """The scenes of least cloud (missing: 100), in the catalogue's order among equals; all of them if `most` is None or 0."""
    if not most:
        return catalogue
    return catalogue.orderBy(F.coalesce("cloud", F.lit(100)), "pos").limit(most)


def by_cell(catalogue: DataFrame, most: int | None, cell: list[str]) -> DataFrame:
    """Scenes spread over cells: most // cells (one at least) of least cloud in each, in the cells' first-seen order, then others by cloud.

    Ranks within cells and among all rows replace the loops; only the cells' number and the rows' number
    come to the driver.
    """
    if not most or catalogue.limit(most + 1).count() <= most:
        return catalogue
    per_cell = max(1, most // max(1, catalogue.select(*cell).distinct().count()))
    cloud = F.coalesce("cloud", F.lit(100))
    ranked = catalogue.withColumns(
        {"_in_cell": F.row_number().over(Window.partitionBy(*cell).orderBy(cloud, "pos")), "_seen": F.min("pos").over(Window.partitionBy(*cell))}
    )
    first = F.col("_in_cell") <= per_cell
    order = [F.when(first, 0).otherwise(1), F.when(first, F.col("_seen")).otherwise(F.lit(0)), F.when(first, F.col("_in_cell")).otherwise(F.lit(0)), cloud, F.col("pos")]
    return ranked.orderBy(*order).limit(most).drop("_in_cell", "_seen")


def select(catalogue: DataFrame, most: int | None, cell: list[str], strategy: str = "spatial") -> DataFrame:
    return by_cloud(catalogue, most) if strategy == "cloud" else by_cell(catalogue, most, cell)
