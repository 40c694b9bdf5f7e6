"""Quality filter, validation checks and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakiln.functions import geo
from terrakiln.functions.scalar import finite

#: The checks in the order in which a report names them.
CHECKS = ("has_geometry", "geometry_valid", "has_alarm_date", "reasonable_size", "within_california", "has_cont_date", "cont_after_alarm")


def quality_filter(df: DataFrame, min_acres: float, max_acres: float, methods: list[int], acres: str = "acres", method: str = "method", valid: str = "geometry_valid") -> DataFrame:
    """Rows of a size within the limits, by one of the methods, with a valid geometry; a missing column isn't checked."""
    out = df
    if acres in df.columns:
        out = out.where(F.col(acres).between(min_acres, max_acres) & ~F.isnan(F.col(acres).cast("double")))
    if method in df.columns:
        out = out.where(F.col(method).isin(methods))
    if valid in df.columns:
        out = out.where(F.col(valid))
    return out


def checks(ring: Column, alarm: Column, cont: Column, acres: Column, limits: tuple[float, float], bounds: tuple[float, float, float, float], require_cont: bool = True) -> dict[str, Column]:
    """Boolean columns by check. The box is tested, strictly, with the unprojected centroid of the ring."""
    size = finite(acres.cast("double"))
    out = {
        "has_geometry": ring.isNotNull() & (F.size(ring) > 0),
        "geometry_valid": geo.ring_valid(ring),
        "has_alarm_date": alarm.isNotNull(),
        "reasonable_size": size.between(*limits),
        "within_california": F.exists(F.array(geo.ring_point(ring)), lambda c: geo.inside(c["x"], c["y"], bounds)),
    }
    if require_cont:
        out |= {"has_cont_date": cont.isNotNull(), "cont_after_alarm": cont >= alarm}
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def failed_checks(found: dict[str, Column]) -> Column:
    """Names of the failed checks, in order, joined by commas; empty if all hold."""
    return F.concat_ws(",", *[F.when(~found[k], F.lit(k)) for k in CHECKS if k in found])


def split(df: DataFrame, found: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the others with failed_checks."""
    marked = df.withColumn("failed_checks", failed_checks(found))
    return marked.where(F.col("failed_checks") == "").drop("failed_checks"), marked.where(F.col("failed_checks") != "")


def histogram(report: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent failures, ties by text."""
    return report.groupBy("failed_checks").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "failed_checks").limit(top)


def summary(df: DataFrame, acres: str, when: str) -> DataFrame:
    """Rows, first and last year, sum and mean of the size in hundredths (exact) as one row."""
    cents = F.round(F.col(acres) * 100).cast("bigint")
    return df.agg(
        F.count("*").alias("n"), F.min(F.year(when)).alias("min_year"), F.max(F.year(when)).alias("max_year"),
        (F.sum(cents) / 100.0).alias("sum_acres"), (F.sum(cents) / F.count(cents) / 100.0).alias("mean_acres"),
    )


def with_centroid(df: DataFrame, rings: str) -> DataFrame:
    """centroid_lon and centroid_lat: the centroid of the projected rings, back in degrees."""
    projected = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(*[c.alias(n) for n, c in zip("xy", geo.albers(p["x"], p["y"]), strict=True)])))
    out = df.withColumn("_rings", projected)
    x, y = geo.polygon_centroid(F.col("_rings"))
    out = out.withColumns({"_x": x, "_y": y})
    lon, lat = geo.albers_inverse(F.col("_x"), F.col("_y"))
    return out.withColumns({"centroid_lon": lon, "centroid_lat": lat}).drop("_rings", "_x", "_y")


def centroid_or(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Where either centroid column is missing, both are replaced."""
    missing = finite(F.col("centroid_lon")).isNull() | finite(F.col("centroid_lat")).isNull()
    return df.withColumns({"centroid_lon": F.when(missing, x).otherwise(F.col("centroid_lon")), "centroid_lat": F.when(missing, y).otherwise(F.col("centroid_lat"))})
