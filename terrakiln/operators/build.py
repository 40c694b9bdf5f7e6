"""The labelled matrix as a whole: features of points, fires and negatives, with the options of a partial run."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakiln.logs import logger
from terrakiln.operators.assemble import head, join_features, matrix, merge, negatives_wanted
from terrakiln.operators.validate import centroid_or

LOG = logger(__name__)
#: What an extractor is: points (key, centroid_lon, centroid_lat, alarm) to a table of features by key.
Extractor = Callable[[DataFrame], DataFrame]


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """`df`, if it has the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def matched(df: DataFrame, column: str) -> DataFrame:
    """One row: n_rows, n_matched (rows with a value in `column`)."""
    return df.agg(F.count("*").alias("n_rows"), F.count(column).alias("n_matched"))


def point_features(points: DataFrame, extractors: dict[str, Extractor], key: str = "object_id", skip: Iterable[str] = ()) -> DataFrame:
    """key, centroid_lon, centroid_lat, alarm and the features of all extractors but those to skip, in their order.

    points: key, lon, lat, alarm; centroid columns are made from lon and lat where they are missing. A column
    that two extractors give comes from the first; a point that an extractor leaves out has nulls.
    """
    for c, source in (("centroid_lon", "lon"), ("centroid_lat", "lat")):
        if c not in points.columns:
            points = points.withColumn(c, F.col(source))
    if {"lon", "lat"} <= set(points.columns):
        points = centroid_or(points, F.col("lon"), F.col("lat"))
    work = require(points, [key, "alarm"])
    out = work.select(key, "centroid_lon", "centroid_lat", "alarm")
    for name, extract in extractors.items():
        if name not in skip:
            out = merge(out, extract(work), key)
    return out


def build_matrix(
    fires: DataFrame,
    tables: dict[str, DataFrame | None],
    negatives: Callable[[int], DataFrame],
    extractors: dict[str, Extractor],
    key: str = "object_id",
    required: tuple[str, ...] = (),
    ratio: float = 1.0,
    limit: int | None = None,
    skip_pseudo: bool = False,
    skip_pseudo_extract: bool = False,
) -> DataFrame:
    """Fires with their feature tables and is_fire 1, and below them negatives with extracted features and is_fire 0.

    `limit`: the first fires by key only. `negatives` makes as many points as asked: the fires' number times
    `ratio`, half to even. Without them (`skip_pseudo`) or without their features (`skip_pseudo_extract`) the
    fires stand alone. Where no point was found they do too, with the extracted features' columns, null: the
    columns follow from what is asked for, not from the rows.
    """
    base = head(require(fires, [key]), key, limit).withColumn("is_fire", F.lit(1))
    found = join_features(base, tables, key, required)
    if skip_pseudo:
        LOG.info("no negatives asked for")
        return found
    points = negatives(negatives_wanted(base.count(), ratio))
    if skip_pseudo_extract:
        LOG.info("negatives without features are left out")
        return found
    return matrix([found, point_features(points, extractors, key).withColumn("is_fire", F.lit(0))])
