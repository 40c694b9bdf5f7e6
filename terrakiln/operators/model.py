"""Metrics, forests and weights."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrakiln.operators.assemble import impute, medians
from terrakiln.operators.folds import group_folds, temporal_split
from terrakiln.operators.order import cut, running_total

#: The columns whose importances make up each exported factor, and the factors that must be there.
FACTORS = {
    "vegetation_density": ["vegetation_density", "ndvi_mean"],
    "slope_degrees": ["slope_degrees"],
    "aspect_south_factor": ["aspect_south_factor"],
    "elevation_meters": ["elevation_meters"],
    "infrastructure_distance_km": ["infrastructure_distance_km", "distance_to_roads_km"],
    "weather_erc_max": ["erc_max_7d", "erc_max_14d", "erc_max_30d"],
}
REQUIRED = ["vegetation_density", "slope_degrees", "aspect_south_factor", "elevation_meters", "infrastructure_distance_km"]
SUM_TOLERANCE = 0.01


def roc_auc(df: DataFrame, label: str, score: str, *by: str) -> DataFrame:
    """by, n_pos, n_neg, auc: the share of pairs in order, ties by half; null with one class only.

    Scores are counted first, so that ranks come from running sums over distinct scores; without `by` these are
    dealt by ranges of the score.
    """
    per = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    if by:
        below = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        ranked = per.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    else:
        ranked = running_total(per, "_s", F.col("_n"), "_below")
    won = F.sum(F.col("_p") * (2 * F.col("_below") + F.col("_n")))
    return ranked.groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), won.alias("_won")).select(
        *by, "n_pos", "n_neg", F.try_divide(F.col("_won").cast("double"), 2.0 * F.col("n_pos") * F.col("n_neg")).alias("auc")
    )


def confusion(df: DataFrame, label: str, predicted: str, *by: str) -> DataFrame:
    """by, tn, fp, fn, tp, accuracy."""
    cell = lambda y, p: F.count_if((F.col(label) == y) & (F.col(predicted) == p))
    right = F.count_if(F.col(label) == F.col(predicted))
    return df.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"), F.try_divide(right.cast("double"), F.count("*").cast("double")).alias("accuracy"))


def mean_and_spread(folds: DataFrame, value: str) -> DataFrame:
    """Mean and population standard deviation over folds, null ones left out."""
    return folds.agg(F.avg(value).alias("mean_auc"), F.stddev_pop(value).alias("std_auc"), F.count(value).alias("n_scored"))


def balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """`df` with weight: rows / (2 * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    shares = counts.crossJoin(total).select(label, (F.col("_all") / (2.0 * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(shares), label)


@dataclass
class Trained:
    model: RandomForestClassificationModel
    features: list[str]
    medians: dict[str, float]
    metrics: dict = field(default_factory=dict)

    @property
    def importances(self) -> dict[str, float]:
        return dict(zip(self.features, map(float, self.model.featureImportances.toArray()), strict=True))

    def save(self, folder: str) -> None:
        """The model, and beside it (in the same store) features, medians and metrics as JSON."""
        self.model.write().overwrite().save(f"{folder}/model")
        spark = SparkSession.getActiveSession()
        row = json.dumps({"features": self.features, "medians": self.medians, "metrics": self.metrics, "importances": self.importances})
        spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metrics")

    @classmethod
    def load(cls, folder: str) -> Trained:
        """What `save` wrote."""
        spark = SparkSession.getActiveSession()
        found = json.loads(spark.read.text(f"{folder}/metrics").first()[0])
        return cls(RandomForestClassificationModel.load(f"{folder}/model"), found["features"], found["medians"], found["metrics"])

    def predict(self, df: DataFrame) -> DataFrame:
        """`df` with prediction and probability of class 1."""
        filled = df.fillna(self.medians, subset=self.features)
        out = self.model.transform(VectorAssembler(inputCols=self.features, outputCol="_x").transform(filled))
        return out.withColumn("p1", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability")


def fit_forest(df: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 20, leaf: int = 20, seed: int = 42, fitted_on: DataFrame | None = None) -> Trained:
    """A balanced random forest on median-filled features; columns without any value are left out by name."""
    if df.select(label).distinct().count() < 2:
        raise ValueError("training needs both classes")
    found = medians(fitted_on if fitted_on is not None else df, features).first().asDict()
    used = [c for c in features if found[c] is not None]
    if not used:
        raise ValueError("no feature has a value")
    filled = impute(df, used, fitted_on if fitted_on is not None else df)
    ready = VectorAssembler(inputCols=used, outputCol="_x").transform(balanced_weight(filled, label))
    forest = RandomForestClassifier(featuresCol="_x", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed)
    return Trained(forest.fit(ready), used, {c: float(found[c]) for c in used})


def spatial_cv(df: DataFrame, features: list[str], label: str, group: str, folds: int = 5, **forest) -> DataFrame:
    """fold, n_test, auc, accuracy: each fold's groups held out; medians come from all rows, as the fold's models share them."""
    spark = df.sparkSession
    placed = df.join(F.broadcast(group_folds(df, group, folds)), group).persist()
    rows = []
    for k in range(folds):
        train, test = placed.where(F.col("fold") != k), placed.where(F.col("fold") == k)
        scored = fit_forest(train, features, label, fitted_on=placed, **forest).predict(test)
        auc = roc_auc(scored, label, "p1").select("auc")
        row = confusion(scored, label, "prediction").crossJoin(auc).select((F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_test"), "auc", "accuracy")
        rows.append((k, *row.first()))
    placed.unpersist()
    return spark.createDataFrame(rows, "fold int, n_test long, auc double, accuracy double")


def temporal_holdout(df: DataFrame, features: list[str], label: str, year: str, holdout: int, **forest) -> DataFrame | None:
    """Confusion, accuracy and auc of the holdout year by a model of the years before; None if either side is empty."""
    train, test = df.where((F.col(year) >= 0) & (F.col(year) < holdout)), df.where(F.col(year) == holdout)
    if train.isEmpty() or test.isEmpty():
        return None
    scored = fit_forest(train, features, label, **forest).predict(test)
    return confusion(scored, label, "prediction").crossJoin(roc_auc(scored, label, "p1").select("auc"))


def train(df: DataFrame, features: list[str], label: str, group: str, year: str, holdout: int = 2024, folds: int = 5, **forest) -> Trained:
    """The final model with its report: spatial folds, holdout, class counts."""
    cv = [r.asDict() for r in spatial_cv(df, features, label, group, folds, **forest).orderBy("fold").collect()]
    late = temporal_holdout(df, features, label, year, holdout, **forest)
    final = fit_forest(temporal_split(df, year, holdout)[0], features, label, **forest)
    counts = {str(r[0]): r[1] for r in df.groupBy(label).count().collect()}
    final.metrics = {"spatial_cv": cv, "temporal_holdout": late.first().asDict() if late is not None else None, "labels": counts}
    return final


def raw_weights(importances: DataFrame, include_weather: bool = True) -> DataFrame:
    """factor, raw: the greatest importance of each factor's columns; required factors are there with 0, weather only if above 0.

    importances: feature, importance.
    """
    spark = importances.sparkSession
    mapped = spark.createDataFrame([(f, c) for f, cs in FACTORS.items() for c in cs], "factor string, feature string")
    out = mapped.join(importances, "feature", "left").groupBy("factor").agg(F.coalesce(F.max("importance"), F.lit(0.0)).alias("raw"))
    return out.where(F.col("factor").isin(REQUIRED) | (F.lit(include_weather) & (F.col("raw") > 0)))


def normalised(weights: DataFrame) -> DataFrame:
    """factor, raw, weight: parts of the total; an error where the total isn't above 0. A handful of rows."""
    total = F.sum("raw").over(Window.partitionBy())
    checked = F.when(total > 0, F.col("raw") / total).otherwise(F.raise_error(F.lit("the weights have no total")))
    return weights.withColumn("weight", checked)


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights, if all required are there, each within 0 and 1, and their sum is 1."""
    missing = [k for k in REQUIRED if k not in weights]
    if missing or any(not 0 <= v <= 1 for v in weights.values()) or abs(sum(weights.values()) - 1) > SUM_TOLERANCE:
        raise ValueError(f"invalid weights: {weights}, missing {missing}")
    return weights


def export_weights(importances: DataFrame, include_weather: bool = True) -> str:
    """The checked weights as JSON."""
    rows = normalised(raw_weights(importances, include_weather)).collect()
    return json.dumps(check_weights({r["factor"]: r["weight"] for r in rows}), indent=2, sort_keys=True)


def risk_score(df: DataFrame, weights: dict[str, float], components: dict[str, str]) -> DataFrame:
    """`df` with risk_score: 100 times the weighted sum of components scaled to [0, 1]."""
    terms = [F.lit(w) * F.col(components[k]) for k, w in weights.items() if k in components]
    return df.withColumn("risk_score", 100 * sum(terms[1:], terms[0]))


def mean_contributions(model: Trained, df: DataFrame, top: int = 15) -> DataFrame:
    """feature, mean_shift: by how much the probability of class 1 moves, on average, when the feature is set to its median.

    A model-agnostic stand-in for tree explanations: one prediction of the rows per feature, all in the cluster.
    """
    base = cut(model.predict(df).withColumnRenamed("p1", "_p"))
    out = None
    for c in model.features:
        moved = model.predict(base.drop("prediction").withColumn(c, F.lit(model.medians[c])))
        row = moved.agg(F.avg(F.abs(F.col("p1") - F.col("_p"))).alias("mean_shift")).select(F.lit(c).alias("feature"), "mean_shift")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("mean_shift"), "feature").limit(top)
