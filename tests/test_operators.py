import datetime as dt
import math
import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from terrakiln.functions import geo, scalar
from terrakiln.operators import assemble, folds, model, nearest, raster, scenes, validate, weather
from terrakiln.params import load_config, method_codes, params
from terrakiln.sources import readers
from terrakiln.streaming.incremental import extract_arriving

BOX = (-124.5, 32.5, -114.0, 42.0)


def square(x, y, side=0.1):
    x, y = float(x), float(y)
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ring(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_params(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("data:\n  perimeters: {min_acres: 20, windows: [1, 2]}\n")
    p = params(load_config(str(path)), min_acres=None, seed=7)
    assert (p.min_acres, p.windows, p.seed, p.max_acres) == (20, (1, 2), 7, 1e6)
    (tmp_path / "e.yaml").write_text("")
    assert load_config(str(tmp_path / "e.yaml")) == {}
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.yaml"))
    assert method_codes(None) == [1, 2, 3, 4] and method_codes(["GPS", "7", 3, "?"]) == [1, 2, 3, 7] and method_codes(["?"]) == [1, 2, 3, 4]


def test_validation(spark):
    ms = dt.datetime(2020, 8, 1, tzinfo=dt.UTC).timestamp() * 1000
    rows = [(1, square(-121, 38), ms, ms + 1, 100.0), (2, square(-110, 40), ms, ms, 100.0), (3, square(-121, 38), ms, ms, 5.0), (4, square(-121, 38), math.nan, ms, 100.0), (5, square(-121, 38), ms, None, 100.0), (6, None, None, None, math.nan)]
    df = spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>, alarm double, cont double, acres double")
    found = validate.checks(F.col("ring"), scalar.from_epoch_ms(F.col("alarm")), scalar.from_epoch_ms(F.col("cont")), F.col("acres"), (10, 1e6), BOX)
    good, bad = validate.split(df, found)
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.failed_checks for r in bad.collect()} == {
        2: "within_california", 3: "reasonable_size", 4: "has_alarm_date,cont_after_alarm", 5: "has_cont_date,cont_after_alarm",
        6: "has_geometry,geometry_valid,has_alarm_date,reasonable_size,within_california,has_cont_date,cont_after_alarm",
    }
    table = spark.createDataFrame([(1, 150.0, 1), (2, 5.0, 6), (3, 50.0, 4), (4, None, 1)], "id int, acres double, method int")
    assert sorted(r.id for r in validate.quality_filter(table, 10, 1e6, [1, 2, 3, 4]).collect()) == [1, 3]


def test_geometry(spark):
    x, y = one(spark, *geo.albers(F.lit(-121.0), F.lit(38.0)))
    assert abs(x + 2149538.4407) < 1e-3 and abs(y - 1947201.8478) < 1e-3
    lon, lat = one(spark, *geo.albers_inverse(F.lit(x), F.lit(y)))
    assert abs(lon + 121) < 1e-9 and abs(lat - 38) < 1e-7
    assert one(spark, *geo.ring_centroid(ring([(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)])))[:] == (2.0, 1.0)
    hole = F.array(ring(square(0, 0, 4)), ring(square(2, 1, 1)[::-1]))
    cx, cy = one(spark, *geo.polygon_centroid(hole))
    assert abs(cx - (32 - 2.5) / 15) < 1e-12 and abs(cy - (32 - 1.5) / 15) < 1e-12
    bow = ring([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])
    assert one(spark, geo.ring_valid(ring(square(0, 0))), geo.ring_valid(bow), geo.ring_valid(ring([(0, 0), (1, 0), (0, 0)])))[:] == (True, False, False)
    line = ring([(0, 0), (10000, 0)])
    assert one(spark, geo.polyline_distance(F.lit(5000.0), F.lit(500.0), line))[0] == 500
    fires = spark.createDataFrame([(1, [square(-121, 38)])], "id int, rings array<array<struct<x:double,y:double>>>")
    r = validate.with_centroid(fires, "rings").first()
    assert abs(r.centroid_lon + 120.95) < 1e-4 and abs(r.centroid_lat - 38.05) < 1e-4
    assert not one(spark, geo.inside(F.lit(-114.0), F.lit(38.0), BOX))[0]


def test_windows_are_closed(spark):
    start = dt.datetime(2020, 7, 1)
    series = spark.createDataFrame([(1, start + dt.timedelta(days=i), 300.0 + i, 0.0 if i else math.nan) for i in range(31)], "place int, day timestamp_ntz, tmmx double, pr double")
    anchors = spark.createDataFrame([(1, dt.datetime(2020, 7, 31)), (1, dt.datetime(2020, 7, 31, 15)), (2, dt.datetime(2020, 7, 31))], "place int, at timestamp_ntz")
    got = {(r.place, r["at"].hour): r for r in weather.trailing(anchors, series, "place", "at", "day", ["tmmx", "pr"], (7, 30), ("pr",)).collect()}
    assert (got[1, 0].tmmx_max_7d, got[1, 0].tmmx_mean_7d, got[1, 0].pr_sum_7d) == (330.0, 326.5, 0.0)
    assert got[1, 15].tmmx_mean_7d == 327.0 and got[2, 0].tmmx_max_7d is None and got[2, 0].pr_sum_7d is None
    days = {(r.place, r["at"].hour): r.n_days for r in weather.complete(anchors, series, "place", "at", "day", 30, 0.9).collect()}
    assert days == {(1, 0): 31, (1, 15): 31}
    assert weather.fresh_columns(["erc (-)", "tmmx (K)", "x"], ("tmmx", "pr", "erc")) == [("tmmx (K)", "tmmx"), ("erc (-)", "erc")]


def test_terrain(spark):
    flat = spark.createDataFrame([(1, [100.0] * 9), (2, [float(i) for i in range(9)]), (3, [math.nan] + [1.0] * 8)], "id int, v array<double>")
    for got in (raster.terrain_by_window(flat, "id", "v", 3, 30), raster.terrain(raster.pixels(flat, "id", "v", 3), 30)):
        rows = {r.raster_id: r for r in got.collect()}
        assert set(rows) == {1, 2} and rows[1].slope == 0 and rows[1].aspect == 180 and rows[1].south == 1
        assert abs(rows[2].slope - math.degrees(math.atan(math.hypot(2 / 60, 6 / 60)))) < 1e-9
    assert one(spark, scalar.south_factor(F.lit(0.0)), scalar.south_factor(F.lit(math.nan)), scalar.known(F.lit(255.0), scalar.SLOPE_NODATA))[:] == (0.0, None, None)


def plain_nearest(points, segments):
    """Every point against every segment, in plain Python."""
    out = {}
    for i, x, y in points:
        best = (math.inf, None)
        for k, ax, ay, bx, by in segments:
            dx, dy = bx - ax, by - ay
            t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            best = min(best, (math.hypot(x - ax - t * dx, y - ay - t * dy), k))
        out[i] = (best[1], round(best[0], 6))
    return out


@pytest.mark.parametrize("side", [None, 300.0, 5000.0, 1e6])
def test_nearest_by_grid_equals_plain(spark, side):
    draw = random.Random(4)
    kinds = ("point_id int, px double, py double", "segment_id int, ax double, ay double, bx double, by double")
    points = [(i, draw.uniform(0, 20000), draw.uniform(0, 20000)) for i in range(120)] + [(500, 1e5, -3e4), (501, -2000.0, 5.0)]
    segments = [(i, *[draw.uniform(0, 20000) for _ in range(4)]) for i in range(30)] + [(40, 5.0, 5.0, 5.0, 9000.0), (41, 1.0, 300.0, 9000.0, 300.0), (42, 600.0, 600.0, 600.0, 600.0)]
    got = nearest.nearest_segment(spark.createDataFrame(points, kinds[0]), spark.createDataFrame(segments, kinds[1]), side).collect()
    assert {r.point_id: (r.segment_id, round(r.dist, 6)) for r in got} == plain_nearest(points, segments) and len(got) == len(points)


def test_nearest_of_odd_tables(spark):
    kinds = ("point_id int, px double, py double", "segment_id int, ax double, ay double, bx double, by double")
    ties = [(2, 0.0, 10.0, 10000.0, 10.0), (1, 0.0, 0.0, 10000.0, 0.0), (None, 5000.0, 5.0, 5000.0, 5.0), (3, math.nan, 5.0, 5000.0, 5.0)]
    points = [(1, 5000.0, 5.0), (1, 5000.0, 5.0), (1, 5000.0, 9.0), (2, None, 1.0), (3, math.nan, 1.0), (None, 5000.0, 5.0)]
    rows = nearest.nearest_segment(spark.createDataFrame(points, kinds[0]), spark.createDataFrame(ties, kinds[1])).collect()
    assert sorted(((r.point_id or 0, r.segment_id or 0, r.dist) for r in rows), key=str) == sorted([(1, 1, 5.0), (1, 1, 5.0), (1, 2, 1.0), (2, 0, None), (3, 0, None), (0, 1, 5.0)], key=str)
    none = spark.createDataFrame([], kinds[1])
    assert [r.segment_id for r in nearest.nearest_segment(spark.createDataFrame(points[:2], kinds[0]), none).collect()] == [None, None]
    assert nearest.nearest_segment(spark.createDataFrame([], kinds[0]), spark.createDataFrame(ties, kinds[1])).count() == 0
    centres = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (3.0, 4.0)], "cx double, cy double")
    assert [r.dist for r in nearest.least_distance(spark.createDataFrame([(1, 3.0, 0.0)], kinds[0]), centres).collect()] == [3.0]


def test_vegetation(spark):
    rows = [(0.2, 0.1, None, None), (None, None, 0.35, None), (None, 0.2, None, None), (0.2, math.nan, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [(r.veg_source, r.ndvi_mean, r.ndmi_mean, round(r.vegetation_density, 9)) for r in raster.vegetation(df, "a", "b", "c", "d", F.lit(True), F.lit(True)).collect()]
    assert got == [("raster", 0.2, 0.1, 0.6), ("scene", 0.35, 0.3, 0.675), ("default", 0.5, 0.3, 0.75), ("raster", 0.2, 0.3, 0.6)]
    with pytest.raises(Exception, match="no fallback"):
        raster.vegetation(df, "a", "b", "c", "d", F.lit(False), F.lit(True), allow_fallback=False).collect()
    assert one(spark, scalar.density(F.lit(-1.0)), scalar.density(F.lit(1.0)), scalar.normalised_difference(F.lit(0.0), F.lit(0.0)))[:] == (0.0, 1.0, None)


def test_scenes(spark):
    df = spark.createDataFrame([(0, 30, "a"), (1, 5, "a"), (2, 15, "b"), (3, None, "b")], "pos int, cloud int, cell string")
    assert [r.cloud for r in scenes.by_cloud(df, 2).collect()] == [5, 15]
    assert sorted(r.pos for r in scenes.select(df, 2, ["cell"]).collect()) == [1, 2] and scenes.by_cell(df, 9, ["cell"]).count() == 4
    assert one(spark, *scenes.cell_of(F.lit(-200.0), F.lit(41.9), BOX))[:] == (0, 5)


def test_matrix(spark):
    base = spark.createDataFrame([(1, 0.1), (2, 0.2)], "object_id int, slope double")
    right = spark.createDataFrame([(1, 99.0, 100.0), (1, 98.0, 101.0)], "object_id int, slope double, elevation double")
    rows = sorted((r.object_id, r.slope, r.elevation) for r in assemble.join_features(base, {"t": right, "x": None}, "object_id").collect() if r.elevation)
    assert rows == [(1, 0.1, 100.0), (1, 0.1, 101.0)]
    with pytest.raises(FileNotFoundError):
        assemble.join_features(base, {"t": None}, "object_id", ("t",))
    with pytest.raises(ValueError):
        assemble.merge(base, base.drop("object_id"), "object_id")
    assert assemble.negatives_wanted(5, 0.5) == 2 and assemble.negatives_wanted(7, 0.5) == 4
    centres = spark.createDataFrame([(-121.0, 38.0), (-120.5, 38.5)], "lon double, lat double")
    dates = spark.createDataFrame([(None,)], "alarm timestamp_ntz")
    got = assemble.pseudo_absences(centres, dates, 3, 2000, 5.0, BOX, 42).orderBy(F.desc("object_id")).collect()
    assert [r.object_id for r in got] == [-1, -2, -3] and all(r.alarm is None for r in got)
    fires = spark.createDataFrame([(100.0,), (200.0,), (None,), (math.nan,)], "elevation double")
    assert {(r.elevation, r.is_fire) for r in assemble.synthetic_negatives(fires, ["elevation"], 3, BOX, 1).collect()} == {(150.0, 0)}
    assert sorted(r.elevation for r in assemble.impute(fires, ["elevation"]).collect()) == [100, 150, 150, 200]
    assert assemble.feature_columns(right, ("object_id",)) == ["slope", "elevation"]
    assert scalar.epoch_unit(1.6e12) == "ms" and scalar.epoch_unit(1.6e18) == "ns" and scalar.epoch_unit(None) == "text"
    assert one(spark, scalar.year_of_epoch(F.lit(1686787200000.0), "ms"), scalar.year_of_epoch(F.lit(1.6867872e18), "ns"), scalar.year_of_epoch(F.lit("2023-06-15"), "text"), scalar.year_of_epoch(F.lit(None), "ms"))[:] == (2023, 2023, 2023, -1)


def test_folds_and_training(spark, tmp_path):
    rows = [(i, -122 + 4 * i / 39, 35 + 4 * i / 39, 2018 + i % 7, int(i < 20), 100.0 + 10 * i, None if i == 3 else float(i), None) for i in range(40)]
    df = spark.createDataFrame(rows, "object_id int, lon double, lat double, year int, is_fire int, elevation double, erc double, nothing double")
    blocks = folds.kmeans_blocks(df, "lon", "lat", 4, starts=2)
    assert {r.spatial_group for r in blocks.collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        folds.kmeans_blocks(df.limit(2), "lon", "lat", 3)
    assert folds.separation(folds.centroids(blocks, "spatial_group", "lon", "lat"), "spatial_group").first().km > 30
    placed = blocks.join(folds.group_folds(blocks, "spatial_group", 2), "spatial_group")
    assert {r.n_shared for r in folds.fold_summary(placed, "spatial_group", "is_fire", "fold").collect()} == {0}
    mixed = blocks.withColumn("g", F.col("object_id") % 4)
    made = model.train(mixed, ["elevation", "erc", "nothing"], "is_fire", "g", "year", 2024, folds=2, trees=5, depth=4, leaf=2)
    assert set(made.importances) == {"elevation", "erc"} and len(made.metrics["spatial_cv"]) == 2 and made.metrics["labels"] == {"0": 20, "1": 20}
    assert all(f["auc"] > 0.9 for f in made.metrics["spatial_cv"])
    made.save(str(tmp_path / "m"))
    assert (tmp_path / "m" / "metrics").exists()
    assert model.mean_contributions(made, mixed).count() == 2
    with pytest.raises(ValueError):
        model.fit_forest(df.where("is_fire = 1"), ["elevation"], "is_fire")


def test_weights(spark):
    values = {"vegetation_density": 0.1, "slope_degrees": 0.2, "aspect_south_factor": 0.05, "elevation_meters": 0.15, "distance_to_roads_km": 0.1, "erc_max_7d": 0.25, "erc_max_30d": 0.15}
    df = spark.createDataFrame(list(values.items()), "feature string, importance double")
    got = {r.factor: r.weight for r in model.normalised(model.raw_weights(df)).collect()}
    assert abs(got["weather_erc_max"] - 0.25 / 0.85) < 1e-12 and abs(sum(got.values()) - 1) < 1e-12
    assert "weather_erc_max" not in model.export_weights(df, include_weather=False)
    with pytest.raises(ValueError):
        model.check_weights(dict.fromkeys(model.REQUIRED, 0.5))
    assert model.check_weights(dict.fromkeys(model.REQUIRED, 0.2))
    with pytest.raises(Exception, match="no total"):
        model.normalised(model.raw_weights(df.where("importance < 0"))).collect()


def test_sources(spark, tmp_path):
    page = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"OBJECTID":1,"YEAR_":2020,"GIS_ACRES":150.0,"C_METHOD":1},"geometry":{"type":"Polygon","coordinates":[[[-121,38],[-120.9,38],[-120.9,38.1],[-121,38]]]}},{"properties":{"OBJECTID":2},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}]}'
    rows = readers.geojson_features(spark.createDataFrame([(page,), ('{"features":[]}',)], "value string")).orderBy("OBJECTID").collect()
    assert rows[0].GIS_ACRES == 150 and rows[0].rings[0][1].x == -120.9 and len(rows[1].rings) == 2 and len(rows) == 2
    data = [{"OBJECTID": i} for i in range(1, 6)]
    pages = list(readers.keyset_pages(lambda last: [r for r in data if r["OBJECTID"] > last][:2], 2))
    assert [len(p) for p in pages] == [2, 2, 1]
    with pytest.raises(ValueError, match="No fires"):
        list(readers.keyset_pages(lambda _: [], 2))
    path = str(tmp_path / "f.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("create table fires (OBJECTID integer, geom blob)")
        wkb = struct.pack("<BIII", 1, 3, 1, 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
        for i in range(10):
            db.execute("insert into fires values (?, ?)", (i, None if i == 9 else b"GP\0\1" + struct.pack("<I", 4326) + wkb))
    spark.dataSource.register(readers.GeoPackage)
    df = spark.read.format("gpkg").option("path", path).option("layer", "fires").option("partitions", "3").schema("OBJECTID bigint, rings array<array<struct<x:double,y:double>>>").load()
    got = {r.OBJECTID: r.rings for r in df.collect()}
    assert len(got) == 10 and got[9] is None and got[0][0][2] == (1.0, 1.0)
    readers.write_table(df.select("OBJECTID"), str(tmp_path / "t"))
    assert readers.read_parquet(spark, str(tmp_path / "t")).count() == 10
    assert not readers.write_report(df.where("false"), str(tmp_path / "r")) and readers.write_report(df.select("OBJECTID"), str(tmp_path / "r"))
    readers.write_json(spark.createDataFrame([(1, None)], "a int, b int"), str(tmp_path / "j"))
    assert readers.read_json(spark, str(tmp_path / "j")).columns == ["a"]
    readers.write_raster(spark.createDataFrame([(math.nan,)], "value double"), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).first().value == -9999


def test_arriving_files(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in batch], "id int").write.mode("append").parquet(src)
        extract_arriving(spark, src, "id int", out, str(tmp_path / "c"), "id", lambda df: df.withColumn("twice", F.col("id") * 2)).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 4), (3, 6)]
