import datetime as dt
import json
import logging
import math
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakiln import cli, logs
from terrakiln.functions import geo
from terrakiln.operators import assemble, build, model, order, report, training
from terrakiln.plans.queries import QUERIES
from terrakiln.sources import fetch


def points(spark, n, labels=None):
    labels = labels or (lambda i: int(i < n // 2))
    rows = [(i, -122 + 4 * (i % 40) / 39, 35 + 4 * (i * 7 % 40) / 39, 2015 + i % 8, labels(i), 100.0 + 10 * (i % 50), float(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "object_id long, centroid_lon double, centroid_lat double, year int, is_fire int, elevation double, erc double")


def test_build_matrix(spark):
    fires = spark.createDataFrame([(i, -120.0 - i, 38.0) for i in (5, 3, 1)], "object_id long, centroid_lon double, centroid_lat double")
    tables = {"terrain": spark.createDataFrame([(1, 7.0), (3, 8.0)], "object_id long, slope double"), "water": None}
    alarm = dt.datetime(2020, 1, 1)
    made = []

    def negatives(n):
        made.append(n)
        return spark.createDataFrame([(-k - 1, -121.0, 37.0, alarm) for k in range(n)], "object_id long, lon double, lat double, alarm timestamp_ntz")

    extractors = {"terrain": lambda p: p.select("object_id", F.lit(1.5).alias("slope")), "weather": lambda p: p.where("object_id = -1").select("object_id", F.lit(2.0).alias("erc"), F.lit(0.0).alias("slope"))}
    got = build.build_matrix(fires, tables, negatives, extractors, ratio=0.5).collect()
    assert made == [2] and len(got) == 5  # 1.5 is 2, half to even
    assert {(r.object_id, r.is_fire, r.slope, r.erc) for r in got} == {(1, 1, 7.0, None), (3, 1, 8.0, None), (5, 1, None, None), (-1, 0, 1.5, 2.0), (-2, 0, 1.5, None)}
    assert [r.object_id for r in build.build_matrix(fires, tables, negatives, extractors, limit=2, skip_pseudo=True).orderBy("object_id").collect()] == [1, 3]
    assert build.build_matrix(fires, tables, negatives, extractors, skip_pseudo_extract=True).count() == 3 and made == [2, 3]
    assert build.build_matrix(fires, tables, negatives, extractors, ratio=0.0).count() == 3
    with pytest.raises(FileNotFoundError):
        build.build_matrix(fires, tables, negatives, extractors, required=("water",))
    with pytest.raises(ValueError, match="object_id"):
        build.build_matrix(fires.drop("object_id"), tables, negatives, extractors)
    assert build.matched(build.build_matrix(fires, tables, negatives, extractors, skip_pseudo=True), "slope").first()[:] == (3, 2)


def test_matrix_without_negatives_has_their_columns(spark):
    fires = spark.createDataFrame([(1, -120.0, 38.0)], "object_id long, centroid_lon double, centroid_lat double")
    none = lambda n: spark.createDataFrame([], "object_id long, lon double, lat double, alarm timestamp_ntz")
    extractors = {"place": lambda p: p.select("object_id", F.round(F.col("centroid_lon"), 6).alias("place"))}
    got = build.build_matrix(fires, {}, none, extractors)
    assert [(r.object_id, r.is_fire, r.place) for r in got.collect()] == [(1, 1, None)]
    assert dict(got.dtypes)["place"] == "double"


def test_negatives_are_as_many_as_asked(spark, monkeypatch):
    monkeypatch.setattr(assemble, "PERIOD", 97)
    centres = spark.createDataFrame([(-121.0, 38.0), (-120.5, 38.5)], "lon double, lat double")
    dates = spark.createDataFrame([(dt.datetime(2020, 1, d),) for d in range(1, 8)], "alarm timestamp_ntz")
    place = lambda count, attempts, km=150.0: assemble.pseudo_absences(centres, dates, count, attempts, km, (-124.5, 32.5, -114.0, 42.0), 42).orderBy(F.desc("object_id")).collect()
    once = place(97, 97)  # every free place of the period
    assert 2 < len(once) < 97
    for count in (0, 2, len(once), 97, 300):
        got = place(count, None)
        assert [r.object_id for r in got] == [-k for k in range(1, count + 1)]
        assert [(r.lon, r.lat) for r in got] == [(once[i % len(once)].lon, once[i % len(once)].lat) for i in range(count)]
        assert [r.alarm for r in got] == [dt.datetime(2020, 1, 1 + k * 7919 % 7) for k in range(1, count + 1)]
    assert place(5, None, 5000.0) == []  # no place is free


def test_query_has_a_negative_for_each_fire(spark, sf):
    got = {r.is_fire: r["count"] for r in QUERIES["q69_build_matrix"](spark, sf).groupBy("is_fire").count().collect()}
    assert got[0] == got[1] == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_groups_and_tables(spark, tmp_path):
    df = points(spark, 60)
    assert [training.group_count(*x) for x in ((10, 5, 60), (3, 5, 60), (10, 5, 4), (3, 5, 4))] == [10, 5, 4, 4]
    placed, found = training.assign_groups(df, 3, 4, 30.0, starts=2)
    assert placed.select("spatial_group").distinct().count() == 4 and set(r["fold"] for r in found["folds"]) == {0, 1, 2, 3}
    assert found["passed"] == (found["separation_passed"] and not found["warnings"]) and sum(r["n_total"] for r in found["groups"]) == 60
    training.save_groups(placed, found, str(tmp_path / "cv"))
    assert json.loads(spark.read.text(str(tmp_path / "cv" / "report")).first()[0]) == found
    groups = spark.read.parquet(str(tmp_path / "cv" / "groups"))
    kept = training.aligned_groups(df, groups, 4, 4)
    assert sorted((r.object_id, r.spatial_group) for r in kept.collect()) == sorted((r.object_id, r.spatial_group) for r in groups.collect())
    for wrong in (groups.where("object_id < 50"), groups.unionAll(groups.limit(1)), groups.withColumn("object_id", F.col("object_id") + 1), None):
        assert training.aligned_groups(df, wrong, 4, 4, starts=1).where("spatial_group is null").count() == 0
    with pytest.raises(ValueError, match="empty"):
        training.assign_groups(df.limit(0))
    with pytest.raises(ValueError, match="is_fire"):
        training.assign_groups(df.drop("is_fire"))
    only = points(spark, 10, lambda i: 1)
    with pytest.raises(ValueError, match="both classes"):
        training.training_table(only)
    whole = training.training_table(only, synthetic=True)
    assert sorted(r.is_fire for r in whole.collect()) == [0] * 10 + [1] * 10 and whole.where("is_fire = 0 and elevation <> 145").count() == 0
    assert training.training_table(df).count() == 60
    rows, names = training.features_and_labels(df.withColumn("year", F.when(F.col("object_id") > 0, F.col("year"))))
    assert names == ["elevation", "erc"] and rows.where("object_id = 0").first().year == -1
    with pytest.raises(ValueError, match="no feature"):
        training.features_and_labels(df.drop("elevation", "erc"))


def test_model_comes_back(spark, tmp_path):
    made = model.fit_forest(points(spark, 60), ["elevation", "erc"], "is_fire", trees=4, depth=3, leaf=2)
    made.metrics = {"spatial_cv": []}
    made.save(str(tmp_path / "m"))
    again = model.Trained.load(str(tmp_path / "m"))
    assert (again.features, again.medians, again.metrics, again.importances) == (made.features, made.medians, made.metrics, made.importances)
    rows = points(spark, 20)
    assert sorted(r.p1 for r in again.predict(rows).collect()) == sorted(r.p1 for r in made.predict(rows).collect())
    want = {k: pytest.approx(v) for k, v in made.importances.items()}
    assert {r.feature: r.importance for r in training.importances(spark, str(tmp_path / "m")).collect()} == want
    spark.read.text(str(tmp_path / "m" / "metrics")).coalesce(1).write.text(str(tmp_path / "only" / "metrics"))
    assert {r.feature: r.importance for r in training.importances(spark, str(tmp_path / "only")).collect()} == want
    with pytest.raises(FileNotFoundError):
        training.importances(spark, str(tmp_path / "none"))


def test_reports(spark, tmp_path):
    folds = spark.createDataFrame([(1, 0.75), (0, 0.5), (2, None)], "fold int, auc double")
    assert [tuple(r) for r in report.cv_scores(folds).collect()] == [(0, "Fold 1", 0.5, "0.500", 0.625), (1, "Fold 2", 0.75, "0.750", 0.625)]
    assert report.cv_scores(folds.where("auc is null")) is None
    weights = spark.createDataFrame([("slope_degrees", 0.25), ("elevation_meters", 0.75)], "factor string, weight double")
    assert [(r.title, r.label) for r in report.weight_rows(weights).collect()] == [("Elevation Meters", "0.750"), ("Slope Degrees", "0.250")]
    found = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "feature string, importance double")
    assert report.generate_all(spark, str(tmp_path), folds.where("auc is null"), weights, found) == ["risk_weights", "top_importances"]
    assert spark.read.option("header", True).csv(str(tmp_path / "top_importances")).count() == 2
    assert report.removed(folds, folds.where("fold = 0")).first()[:] == (3, 1, 2, 66.67)
    assert report.removed(folds.limit(0), folds.limit(0)).first()[:] == (0, 0, 0, 0.0)


def test_running_totals(spark):
    draw = random.Random(1)
    rows = [(k, draw.randrange(10)) for k in draw.sample(range(10_000), 500)]
    got = order.running_total(spark.createDataFrame(rows, "k int, v int").repartition(7), "k", F.col("v"), "before").collect()
    want, total = {}, 0
    for k, v in sorted(rows):
        want[k] = total
        total += v
    assert {r.k: r.before for r in got} == want
    assert order.running_total(spark.createDataFrame([], "k int, v int"), "k", F.col("v"), "before").count() == 0


def page(ids):
    return json.dumps({"features": [{"properties": {"OBJECTID": i, "YEAR_": 2020}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}} for i in ids]})


def test_fetching(spark, tmp_path):
    asked, waits = [], []

    def service(where, size):
        asked.append(where)
        after = int(where.rsplit(" ", 1)[1])
        return page([i for i in range(1, 6) if i > after][:size])

    assert [r.OBJECTID for r in fetch.features(spark, service, 2000, 2024, 2).orderBy("OBJECTID").collect()] == [1, 2, 3, 4, 5]
    assert asked[0] == "YEAR_ >= 2000 AND YEAR_ <= 2024 AND OBJECTID > 0" and len(asked) == 3
    with pytest.raises(ValueError, match="answered"):
        fetch.features(spark, lambda *_: '{"error": {"code": 400}}', 2000, 2024)
    calls = iter([OSError("busy"), OSError("busy"), 7])

    def flaky():
        if isinstance(x := next(calls), Exception):
            raise x
        return x

    assert fetch.with_retries(flaky, 3, 1.0, waits.append) == 7 and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        fetch.with_retries(lambda: 1 / 0, 2, 0.0, waits.append)

    def series(lon, lat, first, last):
        if lon > 0:
            raise OSError("offshore")
        return [{"day": first, "erc": 1.5}, {"day": last, "erc": None}]

    anchors = spark.createDataFrame([(1, -120.0, 38.0, dt.datetime(2020, 8, 31)), (2, 5.0, 38.0, dt.datetime(2020, 8, 31)), (3, None, 1.0, None)], "object_id long, lon double, lat double, alarm timestamp_ntz")
    got = sorted(tuple(r) for r in fetch.daily_series(anchors, series, 30, ("erc",), 2, 0.0).collect())
    assert got == [(1, dt.date(2020, 8, 1), 1.5), (1, dt.date(2020, 8, 31), None)] or math.isnan(got[1][2])
    record = struct.pack("<i4d2i2i", 3, 0, 0, 5, 5, 2, 4, 0, 2) + struct.pack("<8d", 0, 0, 1, 1, 2, 2, 3, 3)
    body = b"\0" * 100 + struct.pack(">2i", 1, len(record) // 2) + record + struct.pack(">2i", 2, 2) + struct.pack("<i", 0)
    with zipfile.ZipFile(tmp_path / "roads.zip", "w") as z:
        z.writestr("x/roads.shp", body)
    rows = fetch.zipped_shapes(spark, str(tmp_path / "roads.zip")).orderBy("record").collect()
    assert [[[tuple(p) for p in part] for part in r.parts] for r in rows] == [[[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]], []]
    assert fetch.first_that_works(lambda: spark.read.parquet(str(tmp_path / "none")), lambda: spark.range(3)).count() == 3
    np.save(tmp_path / "g.npy", np.array([4, 2, 2], np.int32))
    labels = fetch.labels_from_npy(spark, str(tmp_path / "g.npy"))
    assert sorted(tuple(r) for r in labels.collect()) == [(0, 4), (1, 2), (2, 2)]
    fetch.labels_to_npy(labels.repartition(3), "position", "label", str(tmp_path / "h.npy"))
    assert np.load(tmp_path / "h.npy").tolist() == [4, 2, 2]


def test_rasters_reference_systems(spark):
    x, y = spark.range(1).select(*geo.to_raster(F.lit(-121.0), F.lit(38.0), 5070)).first()
    assert abs(x + 2149538.4407) < 1e-3 and spark.range(1).select(*geo.to_raster(F.lit(1.0), F.lit(2.0), 4326)).first()[:] == (1.0, 2.0)
    assert geo.pixel_size((-30.0, 0.0, -30.0, 0.0)) == 30.0
    with pytest.raises(ValueError):
        geo.to_raster(F.lit(1.0), F.lit(2.0), 3857)


def test_commands(spark, tmp_path):
    at = str(tmp_path)
    square = [(-121.0, 38.0), (-120.9, 38.0), (-120.9, 38.1), (-121.0, 38.1), (-121.0, 38.0)]
    day = dt.datetime(2020, 8, 1)
    spark.createDataFrame([(1, 2020, 100.0, 1, square, day, day), (2, 1990, 100.0, 1, square, day, day), (3, 2020, 100.0, 1, None, day, day)], "object_id long, year int, acres double, method int, ring array<struct<x:double,y:double>>, alarm timestamp_ntz, cont timestamp_ntz").write.parquet(f"{at}/fires")
    points(spark, 80, lambda i: i % 2).withColumn("elevation_meters", F.col("elevation") + F.col("is_fire") * 50).write.parquet(f"{at}/matrix")
    (tmp_path / "c.yaml").write_text("model: {trees: 3, depth: 3, leaf: 2, groups: 4, folds: 2, holdout_year: 2022}\n")
    assert cli.main(["run", "--at", at, "--config", str(tmp_path / "c.yaml"), "--log", str(tmp_path / "log" / "all.log")]) == 0
    assert [r.object_id for r in spark.read.parquet(f"{at}/valid").collect()] == [1]
    assert abs(sum(json.loads("".join(r[0] for r in spark.read.option("wholetext", True).text(f"{at}/risk_weights").collect())).values()) - 1) < 1e-9
    assert "n_removed" in (tmp_path / "log" / "all.log").read_text()
    p = cli.params(None, trees=2, depth=2, leaf=2, groups=4, folds=2)
    assert cli.run(spark, p, at, ("filter", "validate", "groups", "train")) == ["export"]
    with pytest.raises(ValueError, match="unknown"):
        cli.run(spark, p, at, ("other",))
    logs.set_up({"version": 1})
    assert logs.logger("x").name == "terrakiln.x"
    for handler in list(logging.getLogger("terrakiln").handlers):
        logging.getLogger("terrakiln").removeHandler(handler)
