"""Spatial blocks, grouped folds and their checks."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrakiln.functions import geo
from terrakiln.operators.order import cut


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds z_{c}: off the mean in population standard deviations (0 where a column doesn't vary)."""
    own = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(own))
    return out.withColumns({f"z_{c}": F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))), F.lit(0.0)) for c in columns}).drop(
        *[f"_{k}_{c}" for k in "ms" for c in columns]
    )


def kmeans_blocks(df: DataFrame, lon: str, lat: str, k: int, seed: int = 42, starts: int = 10) -> DataFrame:
    """`df` with spatial_group from 0 to k - 1: k-means on standardised places, the best of `starts` starts."""
    if df.limit(k).count() < k:
        raise ValueError(f"fewer rows than {k} groups")
    ready = VectorAssembler(inputCols=[f"z_{lon}", f"z_{lat}"], outputCol="_place").transform(standardise(df, [lon, lat]))
    ready = cut(ready)
    models = [KMeans(k=k, seed=seed + i, featuresCol="_place", predictionCol="spatial_group").fit(ready) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(ready).drop("_place", f"z_{lon}", f"z_{lat}")


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): groups by size, largest first (ties by name), each to the fold with the fewest rows so far.

    The number of groups is a parameter of the blocks (tens), so their sizes fit one aggregate over an array.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    ordered = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(group).alias("g")))).alias("all"))
    zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), folds).alias("load"), F.array().cast(f"array<struct<g:{dict(df.dtypes)[group]},fold:int>>").alias("out"))

    def put(s, x):
        at = F.array_position(s["load"], F.array_min(s["load"])).cast("int") - 1
        load = F.transform(s["load"], lambda v, i: F.when(i == at, v - x["m"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(s["out"], F.array(F.struct(x["g"].alias("g"), at.alias("fold")))).alias("out"))

    placed = ordered.select(F.explode(F.aggregate("all", zero, put)["out"]).alias("x"))
    return placed.select(F.col("x.g").alias(group), F.col("x.fold").alias("fold"))


def fold_summary(df: DataFrame, group: str, label: str, fold: str) -> DataFrame:
    """fold, n_test, n_test_fires, n_test_groups, n_train_groups, n_shared (groups on both sides) of each fold."""
    per_group = df.groupBy(fold, group).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("y"))
    spread = per_group.withColumn("_folds", F.count("*").over(Window.partitionBy(group)))
    total = df.select(F.count_distinct(group).alias("_groups"))
    out = spread.groupBy(fold).agg(
        F.sum("n").alias("n_test"), F.sum("y").alias("n_test_fires"), F.count("*").alias("n_test_groups"), F.count_if(F.col("_folds") > 1).cast("bigint").alias("n_shared")
    )
    return out.crossJoin(F.broadcast(total)).select(fold, "n_test", "n_test_fires", "n_test_groups", (F.col("_groups") - F.col("n_test_groups") + F.col("n_shared")).alias("n_train_groups"), "n_shared")


def group_summary(df: DataFrame, group: str, label: str) -> DataFrame:
    y = F.col(label).cast("bigint")
    return df.groupBy(group).agg(F.count("*").alias("n_total"), F.sum(y).alias("n_fires"), F.sum(1 - y).alias("n_pseudo"))


def centroids(df: DataFrame, group: str, lon: str, lat: str) -> DataFrame:
    """group, x, y, n_records: the mean of the distinct projected places, and the number of all records."""
    x, y = geo.albers(F.col(lon), F.col(lat))
    per_place = df.groupBy(group, lon, lat).agg(F.count("*").alias("n")).withColumns({"x": x, "y": y})
    return per_place.groupBy(group).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum("n").alias("n_records"))


def separation(blocks: DataFrame, group: str) -> DataFrame:
    """group_a, group_b, km of the two nearest block centroids (first by name among equals); no row for fewer than two."""
    a = blocks.select(F.col(group).alias("group_a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = blocks.select(F.col(group).alias("group_b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    pairs = a.join(F.broadcast(b), F.col("group_a") < F.col("group_b"))
    pairs = pairs.withColumn("km", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")) / 1000)
    return pairs.orderBy("km", "group_a", "group_b").limit(1).select("group_a", "group_b", "km")


def temporal_split(df: DataFrame, year: str, holdout: int, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows before the holdout year (all rows if those are fewer than `least`) and rows in it; -1 is in neither."""
    before = df.where((F.col(year) >= 0) & (F.col(year) < holdout))
    train = before if before.limit(least).count() >= least else df
    return train, df.where(F.col(year) == holdout)
