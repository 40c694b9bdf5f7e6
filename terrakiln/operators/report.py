"""Rows of the reports' figures, with their labels, and counts before and after a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakiln.sources.readers import write_report


def cv_scores(folds: DataFrame) -> DataFrame | None:
    """fold, title, auc, label, mean: a bar for each fold that has an AUC, in order; None if no fold has one."""
    scored = folds.where(F.col("auc").isNotNull())
    if scored.isEmpty():
        return None
    mean = scored.agg(F.avg("auc").alias("mean"))
    title = F.concat(F.lit("Fold "), (F.col("fold") + 1).cast("string"))
    return scored.crossJoin(F.broadcast(mean)).select("fold", title.alias("title"), "auc", F.format_string("%.3f", "auc").alias("label"), "mean").orderBy("fold")


def weight_rows(weights: DataFrame) -> DataFrame:
    """factor, title, weight, label: the greatest weight first."""
    title = F.initcap(F.replace(F.col("factor"), F.lit("_"), F.lit(" ")))
    return weights.select("factor", title.alias("title"), "weight", F.format_string("%.3f", "weight").alias("label")).orderBy(F.desc("weight"), "factor")


def top_importances(importances: DataFrame, top: int = 15) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(top)


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_before, n_after, n_removed, removed_percent (hundredths, half to even; 0 where there was nothing)."""
    n = before.agg(F.count("*").alias("n_before")).crossJoin(after.agg(F.count("*").alias("n_after")))
    gone = F.col("n_before") - F.col("n_after")
    return n.withColumns({"n_removed": gone, "removed_percent": F.bround(F.coalesce(F.try_divide(100.0 * gone, F.col("n_before").cast("double")), F.lit(0.0)), 2)})


def generate_all(spark: SparkSession, folder: str, folds: DataFrame | None = None, weights: DataFrame | None = None, importances: DataFrame | None = None) -> list[str]:
    """Writes the rows of every figure whose table is there as CSV; the names of those written."""
    made = {"cv_scores": cv_scores(folds) if folds is not None else None, "risk_weights": weight_rows(weights) if weights is not None else None, "top_importances": top_importances(importances) if importances is not None else None}
    return [name for name, rows in made.items() if rows is not None and write_report(rows, f"{folder}/{name}")]
