"""From the matrix to training: spatial groups with their report, their alignment, the table, features and labels."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakiln.logs import logger
from terrakiln.operators.assemble import feature_columns, matrix, synthetic_negatives
from terrakiln.operators.build import require
from terrakiln.operators.folds import centroids, fold_summary, group_folds, group_summary, kmeans_blocks, separation
from terrakiln.operators.model import Trained

LOG = logger(__name__)
METADATA = ("object_id", "centroid_lon", "centroid_lat", "lon", "lat", "alarm", "year", "is_fire", "spatial_group", "fold")


def group_count(wanted: int, folds: int, rows: int) -> int:
    """As many groups as asked, at least as many as folds, at most as many as rows."""
    return min(max(wanted, folds), rows)


def aligned_groups(df: DataFrame, groups: DataFrame | None, wanted: int, folds: int, key: str = "object_id", seed: int = 42, starts: int = 10) -> DataFrame:
    """`df` with spatial_group: from `groups` (key, spatial_group) if it has each row's key once, else all made anew."""
    if groups is not None:
        placed = df.drop("spatial_group").join(groups.select(key, "spatial_group"), key, "left")
        n, m, known, listed = df.count(), *placed.agg(F.count("*"), F.count("spatial_group")).first(), groups.count()
        if n == m == known == listed:
            return placed
        LOG.warning("%s groups for %s rows: groups are assigned anew", listed, n)
    return kmeans_blocks(df.drop("spatial_group"), "centroid_lon", "centroid_lat", group_count(wanted, folds, df.count()), seed, starts)


def assign_groups(df: DataFrame, wanted: int = 10, folds: int = 5, least_km: float = 30.0, seed: int = 42, starts: int = 10) -> tuple[DataFrame, dict[str, Any]]:
    """`df` with spatial_group and fold, and the report: groups, folds, separation, warnings, and whether all passed."""
    require(df, ["centroid_lon", "centroid_lat", "is_fire"])
    if df.isEmpty():
        raise ValueError("the matrix is empty")
    if wanted < folds:
        LOG.warning("%s groups for %s folds: as many groups as folds", wanted, folds)
    placed = kmeans_blocks(df, "centroid_lon", "centroid_lat", max(wanted, folds), seed, starts)
    placed = placed.join(F.broadcast(group_folds(placed, "spatial_group", folds)), "spatial_group")
    nearest = separation(centroids(placed, "spatial_group", "centroid_lon", "centroid_lat"), "spatial_group").first()
    by_fold = [r.asDict() for r in fold_summary(placed, "spatial_group", "is_fire", "fold").orderBy("fold").collect()]
    km = nearest["km"] if nearest else None
    warnings = [f"fold {r['fold']} shares {r['n_shared']} groups" for r in by_fold if r["n_shared"]]
    warnings += [f"fold {r['fold']} has one class" for r in by_fold if r["n_test_fires"] in (0, r["n_test"])]
    far = km is None or km >= least_km
    report = {
        "groups": [r.asDict() for r in group_summary(placed, "spatial_group", "is_fire").orderBy("spatial_group").collect()],
        "folds": by_fold,
        "least_separation_km": km,
        "separation_passed": far,
        "warnings": warnings,
        "passed": far and not warnings,
    }
    return placed, report


def save_groups(placed: DataFrame, report: dict[str, Any], folder: str, key: str = "object_id") -> None:
    """The groups as a table keyed by `key`, and the report as JSON beside it."""
    placed.select(key, "spatial_group", "fold").write.mode("overwrite").parquet(f"{folder}/groups")
    row = placed.sparkSession.createDataFrame([(json.dumps(report),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{folder}/report")


def training_table(df: DataFrame, synthetic: bool = False, bounds: tuple[float, float, float, float] = (-124.5, 32.5, -114.0, 42.0), seed: int = 42) -> DataFrame:
    """The matrix, checked; where it has fires only and `synthetic`, with as many synthetic negatives below.

    Without both classes, and without leave to make negatives, ValueError.
    """
    require(df, ["is_fire", "centroid_lon", "centroid_lat"])
    counts = dict(df.groupBy("is_fire").count().collect())
    if not counts:
        raise ValueError("the matrix is empty")
    if len(counts) > 1:
        return df
    if not synthetic or 1 not in counts:
        raise ValueError("training needs both classes")
    LOG.warning("no negatives: %s synthetic ones are made", counts[1])
    made = synthetic_negatives(df, feature_columns(df, METADATA), counts[1], bounds, seed)
    made = made.withColumnsRenamed({"lon": "centroid_lon", "lat": "centroid_lat"})
    return matrix([df, made.drop("alarm") if "alarm" not in df.columns else made.withColumn("alarm", F.col("alarm").cast(df.schema["alarm"].dataType))])


def features_and_labels(df: DataFrame, metadata: Iterable[str] = METADATA) -> tuple[DataFrame, list[str]]:
    """`df` with label (0 or 1) and year (-1 if unknown), and the feature columns; none is an error."""
    found = feature_columns(df, tuple(metadata))
    if not found:
        raise ValueError("the matrix has no feature column")
    year = F.coalesce(F.col("year").cast("int"), F.lit(-1)) if "year" in df.columns else F.coalesce(F.year("alarm"), F.lit(-1)) if "alarm" in df.columns else F.lit(-1)
    return df.withColumns({"label": F.col("is_fire").cast("int"), "year": year}), found


def importances(spark: SparkSession, folder: str) -> DataFrame:
    """feature, importance of a saved model, or else of the JSON of its metrics; FileNotFoundError if there is neither."""
    local = Path(folder)
    try:
        found = Trained.load(folder).importances
    except Exception as e:  # noqa: BLE001 - whatever keeps the model from loading, the metrics may do
        LOG.warning("no model in %s (%s)", folder, type(e).__name__)
        try:
            found = json.loads(spark.read.text(f"{local}/metrics").first()[0])["importances"]
        except Exception as missing:
            raise FileNotFoundError(folder) from missing
    return spark.createDataFrame(list(found.items()), "feature string, importance double")
