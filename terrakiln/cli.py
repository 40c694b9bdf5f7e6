"""Commands: each stage on Parquet tables, and `run` for all of them, with stages to skip."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terrakiln.logs import logger, set_up
from terrakiln.operators import model, report, training, validate
from terrakiln.params import Params, load_config, method_codes, params
from terrakiln.session import build_session
from terrakiln.sources.readers import write_report, write_table

LOG = logger(__name__)


def filtered(spark: SparkSession, p: Params, at: str) -> None:
    """fires to filtered: years, size, method."""
    fires = spark.read.parquet(f"{at}/fires").where(F.col("year").between(p.min_year, p.max_year))
    write_table(validate.quality_filter(fires, p.min_acres, p.max_acres, method_codes(None)), f"{at}/filtered")


def validated(spark: SparkSession, p: Params, at: str) -> None:
    """filtered to valid, and the report of the others."""
    rows = spark.read.parquet(f"{at}/filtered")
    found = validate.checks(F.col("ring"), F.col("alarm"), F.col("cont"), F.col("acres"), (p.min_acres, p.max_acres), p.bounds)
    good, bad = validate.split(rows, found)
    write_table(good, f"{at}/valid")
    write_report(bad.select("object_id", "failed_checks"), f"{at}/validation_report")
    LOG.info("%s", report.removed(rows, good).first().asDict())


def grouped(spark: SparkSession, p: Params, at: str) -> None:
    """matrix to groups and their report."""
    placed, found = training.assign_groups(spark.read.parquet(f"{at}/matrix"), p.groups, p.folds, p.separation_km, p.seed)
    training.save_groups(placed, found, f"{at}/spatial_cv")
    LOG.info("spatial groups passed: %s", found["passed"])


def trained(spark: SparkSession, p: Params, at: str) -> None:
    """matrix and groups to the model and its metrics."""
    table = training.training_table(spark.read.parquet(f"{at}/matrix"), synthetic=True, bounds=p.bounds, seed=p.seed)
    placed = training.aligned_groups(table, spark.read.parquet(f"{at}/spatial_cv/groups"), p.groups, p.folds, seed=p.seed)
    rows, names = training.features_and_labels(placed)
    made = model.train(rows, names, "label", "spatial_group", "year", p.holdout_year, p.folds, trees=p.trees, depth=p.depth, leaf=p.leaf, seed=p.seed)
    made.save(f"{at}/model")


def exported(spark: SparkSession, p: Params, at: str) -> None:
    """The model's importances to weights and the figures' rows."""
    found = training.importances(spark, f"{at}/model")
    text = model.export_weights(found)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/risk_weights")
    cv = json.loads(spark.read.text(f"{at}/model/metrics").first()[0])["metrics"]["spatial_cv"]
    scores = spark.createDataFrame([(r["fold"], r["auc"]) for r in cv], "fold int, auc double")
    report.generate_all(spark, f"{at}/figures", scores, model.normalised(model.raw_weights(found)), found)


STAGES: dict[str, Callable[[SparkSession, Params, str], None]] = {"filter": filtered, "validate": validated, "groups": grouped, "train": trained, "export": exported}


def run(spark: SparkSession, p: Params, at: str, skip: tuple[str, ...] = ()) -> list[str]:
    """All stages but those to skip, in order; the names of those that ran. An unknown name is an error."""
    if unknown := set(skip) - set(STAGES):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    done = []
    for name, stage in STAGES.items():
        if name in skip:
            LOG.info("skipped: %s", name)
            continue
        stage(spark, p, at)
        done.append(name)
    return done


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="terrakiln", description=__doc__)
    parser.add_argument("command", choices=[*STAGES, "run"])
    parser.add_argument("--at", required=True, help="folder of the tables")
    parser.add_argument("--config", help="YAML configuration")
    parser.add_argument("--skip", action="append", default=[], help="a stage that run leaves out; may be repeated")
    parser.add_argument("--log", help="file for the full log")
    given = parser.parse_args(arguments)
    set_up(file=given.log)
    p = params(load_config(given.config) if given.config else None)
    spark = SparkSession.getActiveSession() or build_session()
    if given.command == "run":
        run(spark, p, given.at, tuple(given.skip))
    else:
        STAGES[given.command](spark, p, given.at)
    return 0


if __name__ == "__main__":
    sys.exit(main())
