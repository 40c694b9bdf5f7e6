"""The labelled matrix: feature joins, negatives, imputation, resumption."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrakiln.functions import geo
from terrakiln.functions.scalar import PERIOD, finite, uniform
from terrakiln.logs import logger
from terrakiln.operators.nearest import outside
from terrakiln.operators.order import running_total

LOG = logger(__name__)


def merge(base: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on the key; columns that both have come from the base. Repeated keys on the right fan out."""
    if key not in right.columns:
        raise ValueError(f"the table to join has no column {key}")
    fresh = [c for c in right.columns if c == key or c not in base.columns]
    return base.join(right.select(*fresh), key, "left")


def join_features(base: DataFrame, tables: dict[str, DataFrame | None], key: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Joins the tables in their order; a missing one is an error if it is required."""
    for name, table in tables.items():
        if table is None:
            if name in required:
                raise FileNotFoundError(name)
            continue
        base = merge(base, table, key)
    return base


def _free(centres: DataFrame, attempts: int, radius_km: float, bounds: tuple[float, float, float, float], seed: int) -> DataFrame:
    """point_id, lon, lat of the attempts 1 to `attempts` whose place in the box is at least `radius_km` from every centre."""
    west, south, east, north = bounds
    tries = centres.sparkSession.range(1, attempts + 1).withColumnRenamed("id", "point_id")
    lon = F.lit(west) + uniform(F.col("point_id"), 104729, 31, seed) * F.lit(east - west)
    lat = F.lit(south) + uniform(F.col("point_id"), 224737, 57, seed) * F.lit(north - south)
    tries = tries.withColumns({"lon": lon, "lat": lat})
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    tries = tries.withColumns({"px": x, "py": y})
    cx, cy = geo.albers(F.col("lon"), F.col("lat"))
    return outside(tries, centres.select(cx.alias("cx"), cy.alias("cy")), radius_km * 1000.0).select("point_id", "lon", "lat")


def _until(count: int, free: Callable[[int], DataFrame]) -> DataFrame:
    """k, lon, lat of the first `count` free attempts, however many attempts that takes.

    Attempt i + PERIOD has the place of attempt i, so one period shows every place: free ones come again in
    its order, and where none is free none ever is.
    """
    tried = min(2 * count, PERIOD)
    while True:
        ranked = running_total(free(tried), "point_id", F.lit(1), "rank")
        found = ranked.count()
        if found >= count or tried == PERIOD:
            break
        tried = min(4 * tried, PERIOD)
    if found < count:
        LOG.warning("%d points are asked for and %d places are free", count, found)
    numbers = ranked.sparkSession.range(1, count + 1).select(F.col("id").alias("k"), ((F.col("id") - 1) % max(found, 1)).alias("rank"))
    return numbers.join(ranked.select("rank", "lon", "lat"), "rank").drop("rank")


def pseudo_absences(
    centres: DataFrame, dates: DataFrame, count: int, attempts: int | None, radius_km: float, bounds: tuple[float, float, float, float], seed: int
) -> DataFrame:
    """object_id (-1, -2, ...), lon, lat, alarm of `count` random points at least `radius_km` from every centre (lon, lat).

    Attempt i has its own place in the box, whatever happens to others, and points are accepted in the
    order of the attempts. The k-th point takes date number (k * 7919) mod n of the dates in order, a rank
    join: the dates stay in the cluster. No date: null. Fewer places than asked in `attempts` attempts: fewer
    rows. Without a number of attempts they go on until there are `count` points, or no place of the box is free.
    """
    if attempts is None:
        ordered = _until(count, lambda n: _free(centres, n, radius_km, bounds, seed))
    else:
        # At most `attempts` rows are left, a parameter.
        free = _free(centres, attempts, radius_km, bounds, seed)
        ordered = free.withColumn("k", F.row_number().over(Window.orderBy("point_id"))).where(F.col("k") <= count)
    known = dates.where(F.col("alarm").isNotNull()).select("alarm").distinct()
    numbered = running_total(known, "alarm", F.lit(1), "number")
    total = numbered.count()
    ordered = ordered.withColumn("number", (F.col("k") * 7919) % F.lit(max(total, 1)))
    return ordered.join(numbered, "number", "left").select((-F.col("k")).cast("bigint").alias("object_id"), "lon", "lat", "alarm")


def negatives_wanted(positives: int, ratio: float) -> int:
    """Half to even."""
    return round(positives * ratio)


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of exact medians, missing values left out."""
    return df.agg(*[F.median(finite(F.col(c).cast("double"))).alias(c) for c in columns])


def impute(df: DataFrame, columns: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Missing values of `columns` become the medians of `fitted_on` (or of `df`), one row that is broadcast."""
    own = medians(fitted_on if fitted_on is not None else df, columns).select(*[F.col(c).alias(f"_median_{c}") for c in columns])
    filled = {c: F.coalesce(finite(F.col(c).cast("double")), F.col(f"_median_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(own)).withColumns(filled).drop(*[f"_median_{c}" for c in columns])


def synthetic_negatives(fires: DataFrame, columns: list[str], count: int, bounds: tuple[float, float, float, float], seed: int) -> DataFrame:
    """object_id -1, -2, ..., a random place and summer date of 2000 to 2024, the medians as features, is_fire 0."""
    west, south, east, north = bounds
    i = F.col("id")
    part = lambda a, n: F.floor(uniform(i, a, 91, seed) * n).cast("int")
    rows = fires.sparkSession.range(1, count + 1).select(
        (-i).alias("object_id"),
        (F.lit(west) + uniform(i, 104729, 31, seed) * F.lit(east - west)).alias("lon"),
        (F.lit(south) + uniform(i, 224737, 57, seed) * F.lit(north - south)).alias("lat"),
        F.make_date(part(350377, 25) + 2000, part(479909, 4) + 6, part(611953, 27) + 1).alias("alarm"),
        F.lit(0).alias("is_fire"),
    )
    return rows.crossJoin(F.broadcast(medians(fires, columns)))


def matrix(parts: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def resume(wanted: DataFrame, done: DataFrame, key: str, complete: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of `done` that are wanted and complete, wanted rows still to do)."""
    ready = done if complete is None else done.where(complete)
    return ready.join(wanted.select(key), key, "left_semi"), wanted.join(ready.select(key), key, "left_anti")


def head(df: DataFrame, key: str, n: int | None) -> DataFrame:
    return df.orderBy(key).limit(n) if n else df


def feature_columns(df: DataFrame, metadata: tuple[str, ...]) -> list[str]:
    """Numeric and boolean columns that aren't metadata, in their order."""
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean")
    return [c for c, t in df.dtypes if c not in metadata and (t in kinds or t.startswith("decimal"))]
