"""The reference operators over the driver tables.

Orders stand for incidents, customers and suppliers for places, events for daily series, embeddings for
raster tiles, parts for scenes, labels and documents for scored rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakiln.functions import geo, scalar
from terrakiln.operators import assemble, build, folds, model, nearest, raster, report, scenes, training, validate, weather
from terrakiln.params import Params, method_codes
from terrakiln.session import table
from terrakiln.sources import fetch

LIMITS = (10_000.0, 300_000.0)
BOX = (-124.0005, 33.0005, -115.0005, 41.0005)
EVENTS = ("click", "error", "purchase", "signup", "view")
P = Params()


def _key(column: str) -> Column:
    return F.col(column).cast("bigint")


def _place(key: str) -> tuple[Column, Column]:
    return F.lit(-124.5) + (_key(key) * 7919 % 10500) / F.lit(1000.0), F.lit(32.5) + (_key(key) * 6007 % 9500) / F.lit(1000.0)


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    cont = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("object_id")).agg(F.max("l_shipdate").alias("cont"))
    lon, lat = _place("o_custkey")
    corners = [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1), (0.0, 0.0)]
    ring = F.array(*[F.struct((lon + a).alias("x"), (lat + b).alias("y")) for a, b in corners])
    out = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("object_id"),
        F.when(F.col("o_orderkey") % 53 != 0, F.col("o_orderdate")).alias("alarm"),
        F.col("o_totalprice").alias("acres"),
        (F.col("o_orderkey") % 8 + 1).cast("int").alias("method"),
        F.when(F.col("o_custkey") % 97 != 0, ring).alias("ring"),
        lon.alias("lon"),
        lat.alias("lat"),
    )
    return out.join(cont, "object_id", "left").withColumn("cont", F.when(F.col("object_id") % 59 != 0, F.col("cont")))


def _checks() -> dict[str, Column]:
    return validate.checks(F.col("ring"), F.col("alarm"), F.col("cont"), F.col("acres"), LIMITS, BOX)


def _customers(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = _place("c_custkey")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation"), "c_acctbal", lon.alias("lon"), lat.alias("lat"))


def q01_quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return validate.quality_filter(_incidents(spark, d).select("object_id", "acres", "method"), *LIMITS, method_codes(["GPS", "3", 4]))


def q02_validation_checks(spark: SparkSession, d: str) -> DataFrame:
    return _incidents(spark, d).select("object_id", *[c.alias(n) for n, c in _checks().items()])


def q03_validation_report(spark: SparkSession, d: str) -> DataFrame:
    return validate.split(_incidents(spark, d), _checks())[1].select("object_id", "failed_checks")


def q04_failure_histogram_top5(spark: SparkSession, d: str) -> DataFrame:
    return validate.histogram(q03_validation_report(spark, d))


def q05_summary_stats(spark: SparkSession, d: str) -> DataFrame:
    return validate.summary(table(spark, d, "orders"), "o_totalprice", "o_orderdate")


def q06_bbox_strict(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).where(geo.inside(F.col("lon"), F.col("lat"), (-122.0, 34.0, -116.0, 40.0))).select("custkey", "lon", "lat")


def q07_albers_project(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    return _customers(spark, d).select("custkey", F.round(x, 3).alias("x_m"), F.round(y, 3).alias("y_m"))


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("ignition"))


def q08_weather_windows(spark: SparkSession, d: str) -> DataFrame:
    return weather.trailing(_anchors(spark, d), table(spark, d, "events"), "user_id", "ignition", "ts", ["value"], P.windows, ("value",), ("event_id",))


def q09_weather_windows_by_var(spark: SparkSession, d: str) -> DataFrame:
    series = table(spark, d, "events").select("user_id", "ts", *[F.when(F.col("event_type") == v, F.col("value")).alias(v) for v in EVENTS])
    return weather.trailing(_anchors(spark, d), series, "user_id", "ignition", "ts", list(EVENTS), (7,), ("purchase",), ("event_id",))


def q10_completeness_gate(spark: SparkSession, d: str) -> DataFrame:
    return weather.complete(_anchors(spark, d), table(spark, d, "events"), "user_id", "ignition", "ts", 14, 0.3, P.coverage_start)


def _plane(key: str, a: int, b: int) -> tuple[Column, Column]:
    return ((_key(key) * a % 10500) * 100).cast("double"), ((_key(key) * b % 9500) * 100).cast("double")


def _points(spark: SparkSession, d: str) -> DataFrame:
    x, y = _plane("c_custkey", 7919, 6007)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), x.alias("px"), y.alias("py"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    x, y = _plane("s_suppkey", 5209, 8689)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("segment_id"), x.alias("ax"), y.alias("ay"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("point_id", "segment_id", F.round("dist", 6).alias("dist"))


def q11_nearest_point(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(nearest.nearest_point(_points(spark, d), _targets(spark, d)))


def q12_nearest_segment(spark: SparkSession, d: str) -> DataFrame:
    a = _targets(spark, d)
    b = a.select((F.col("segment_id") - 1).alias("segment_id"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    return _rounded(nearest.nearest_segment(_points(spark, d), a.join(b, "segment_id")))


def q13_nearest_dedupe_ties(spark: SparkSession, d: str) -> DataFrame:
    return nearest.first_per_key(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber"), "l_orderkey", "l_quantity", "l_linenumber")


def q14_terrain_slope(spark: SparkSession, d: str) -> DataFrame:
    out = raster.terrain_by_window(table(spark, d, "embeddings"), "vec_id", "embedding", 8, 0.5)
    return out.select("raster_id", "row", "col", F.round("elevation", 6).alias("elevation"), F.round("slope", 6).alias("slope"))


def q15_terrain_aspect_south_factor(spark: SparkSession, d: str) -> DataFrame:
    out = raster.terrain(raster.pixels(table(spark, d, "embeddings"), "vec_id", "embedding", 8), 0.5)
    return out.select("raster_id", "row", "col", F.round("aspect", 6).alias("aspect"), F.round("south", 6).alias("south"))


def q16_raster_point_sample(spark: SparkSession, d: str) -> DataFrame:
    grid = raster.pixels(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    row, col = geo.pixel((_key("c_custkey") % 30) / F.lit(3.0), F.lit(8.5) - (_key("c_custkey") * 7 % 30) / F.lit(3.0), (1.0, 0.5, -1.0, 8.0))
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), (_key("c_custkey") % 400).alias("raster_id"), row.alias("row"), col.alias("col"))
    return raster.sample(points, grid, ["raster_id", "row", "col"], (8, 8), 1).select("point_id", "raster_id", "row", "col", F.round("value", 6).alias("value"))


def q17_ndvi_density(spark: SparkSession, d: str) -> DataFrame:
    band = [scalar.reflectance(F.abs(F.col("embedding")[i].cast("double")) * 50) for i in range(3)]
    ndvi = scalar.normalised_difference(band[0], band[1])
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(ndvi, 9).alias("ndvi"), F.round(scalar.normalised_difference(band[2], band[1]), 9).alias("ndmi"), F.round(scalar.density(ndvi), 9).alias("vegetation_density")
    )


def q18_vegetation_fallback(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i, n: F.when(F.col("vec_id") % n != 0, F.col("embedding")[i].cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", e(0, 7).alias("a"), e(1, 3).alias("b"), e(2, 5).alias("c"), F.lit(None).cast("double").alias("e"))
    out = raster.vegetation(rows, "a", "b", "c", "e", F.col("vec_id") % 11 != 0, F.col("vec_id") % 2 == 0)
    return out.select("vec_id", "veg_source", *[F.round(c, 9).alias(c) for c in ("ndvi_mean", "ndmi_mean", "vegetation_density")])


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    cloud = F.when(F.col("p_partkey") % 13 != 0, F.col("p_size"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("scene_id"), F.col("p_partkey").alias("pos"), cloud.alias("cloud"), F.col("p_brand").alias("cell"), "p_retailprice")


def q19_scene_topk_cloud(spark: SparkSession, d: str) -> DataFrame:
    return scenes.by_cloud(scenes.candidates(_scenes(spark, d), 45), 15).select("scene_id", "cloud")


def q20_scene_topk_spatial(spark: SparkSession, d: str) -> DataFrame:
    return scenes.select(_scenes(spark, d), 60, ["cell"]).select("scene_id", "cell", "cloud")


def q21_first_finite_scene(spark: SparkSession, d: str) -> DataFrame:
    rows = _scenes(spark, d).withColumn("value", F.when(F.col("pos") % 4 != 0, F.col("p_retailprice"))).withColumn("order", F.coalesce("cloud", F.lit(100)))
    return raster.first_finite(rows, "cell", ["order", "pos"], "value").select("cell", "scene_id", "value")


def q22_median_composite(spark: SparkSession, d: str) -> DataFrame:
    stack = raster.pixels(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return raster.composite(stack, F.floor(F.col("raster_id") / 10)).select("row", "col", F.round("value", 6).alias("value"))


def q23_feature_join(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_totalprice").alias("acres"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("object_id")).agg(
        F.count("*").alias("n_lines"), F.max("l_quantity").alias("max_quantity"), F.min("l_shipdate").alias("first_ship"), F.count_distinct("l_suppkey").alias("n_suppliers")
    )
    parts = {
        "weather": lines.where("object_id % 2 = 0").select("object_id", "n_lines", F.lit(0.0).alias("acres")),
        "terrain": lines.where("object_id % 3 = 0").select("object_id", "max_quantity"),
        "spatial": lines.where("n_lines > 3").select("object_id", "first_ship", F.lit(0).cast("bigint").alias("n_lines")),
        "vegetation": None,
        "water": lines.select("object_id", "n_suppliers"),
    }
    return assemble.join_features(base, parts, "object_id", ("weather", "terrain", "spatial"))


def _negatives(spark: SparkSession, d: str, count: int = 40, attempts: int | None = P.pseudo_attempts) -> DataFrame:
    dates = table(spark, d, "orders").select(F.col("o_orderdate").alias("alarm"))
    return assemble.pseudo_absences(_customers(spark, d), dates, count, attempts, 5.0, P.bounds, P.seed)


def q24_pseudo_absence(spark: SparkSession, d: str) -> DataFrame:
    return _negatives(spark, d).select("object_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "alarm")


def q25_feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    fires = _incidents(spark, d).select("object_id", "lon", "lat", "alarm", "acres").withColumn("is_fire", F.lit(1))
    out = assemble.matrix([fires, _negatives(spark, d).withColumn("is_fire", F.lit(0))])
    return out.select("object_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "alarm", "acres", "is_fire")


def q26_resume_merge(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").select("o_orderkey")
    done = table(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("elevation"))
    kept, todo = assemble.resume(wanted, done, "o_orderkey", F.col("elevation").isNotNull())
    return kept.select("o_orderkey", "elevation").unionByName(todo.withColumn("elevation", F.lit(None).cast("double")))


def q27_synthetic_negatives(spark: SparkSession, d: str) -> DataFrame:
    out = assemble.synthetic_negatives(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 25, P.bounds, P.seed)
    return out.withColumns({"lon": F.round("lon", 9), "lat": F.round("lat", 9), "alarm": F.col("alarm").cast("string")})


def q28_median_impute(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("price"))
    return assemble.impute(rows, ["price"])


def q29_alarm_year_from_epoch(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("double")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, ms).alias("epoch"))
    unit = scalar.epoch_unit(rows.agg(F.max("epoch")).first()[0])
    return rows.select("o_orderkey", scalar.year_of_epoch(F.col("epoch"), unit).alias("year"))


def q30_standardize_xy(spark: SparkSession, d: str) -> DataFrame:
    out = folds.standardise(_customers(spark, d).select("custkey", "lon", "lat"), ["lon", "lat"])
    return out.select("custkey", F.round("z_lon", 9).alias("z_lon"), F.round("z_lat", 9).alias("z_lat"))


def q31_groupkfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return folds.group_folds(_customers(spark, d), "nation", 5)


def q32_fold_leakage(spark: SparkSession, d: str) -> DataFrame:
    rows = _customers(spark, d).select("nation", (F.col("c_acctbal") > 0).cast("int").alias("y"), (F.when(F.col("custkey") % 100 == 0, 0).otherwise(F.col("nation") % 5)).cast("int").alias("fold"))
    return folds.fold_summary(rows, "nation", "y", "fold")


def q33_group_summary(spark: SparkSession, d: str) -> DataFrame:
    return folds.group_summary(_customers(spark, d).withColumn("y", (F.col("c_acctbal") > 0).cast("int")), "nation", "y")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    repeated = _customers(spark, d).select((F.col("nation") % 10).cast("int").alias("block"), "lon", "lat")
    return folds.centroids(repeated.unionAll(repeated.where("lon > -120")), "block", "lon", "lat")


def q34_cluster_centroids_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("block", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "n_records")


def q35_min_cluster_separation(spark: SparkSession, d: str) -> DataFrame:
    return folds.separation(_blocks(spark, d), "block").select("group_a", "group_b", F.round("km", 6).alias("km"), (F.col("km") >= P.separation_km).alias("passed"))


def q36_temporal_holdout_split(spark: SparkSession, d: str) -> DataFrame:
    rows = q29_alarm_year_from_epoch(spark, d)
    train, test = folds.temporal_split(rows, "year", 2000)
    side = lambda df, name: df.groupBy("year").agg(F.count("*").alias("n")).withColumn("side", F.lit(name))
    return side(train, "train").unionByName(side(test, "test"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", "quality", "n_chars", (F.col("doc_id") % 5).cast("int").alias("fold"), (F.col("n_chars") > 900).cast("int").alias("predicted"))


def q37_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return model.roc_auc(_scored(spark, d), "quality", "n_chars").withColumn("auc", F.round("auc", 12))


def q38_accuracy_confusion(spark: SparkSession, d: str) -> DataFrame:
    return model.confusion(_scored(spark, d), "quality", "predicted", "fold").withColumn("accuracy", F.round("accuracy", 12))


def q39_cv_mean_std(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d).where("fold > 0 or quality = 1")
    out = model.mean_and_spread(model.roc_auc(scored, "quality", "n_chars", "fold"), "auc")
    return out.select(F.round("mean_auc", 9).alias("mean_auc"), F.round("std_auc", 9).alias("std_auc"), "n_scored")


FEATURES = sorted({c for cs in model.FACTORS.values() for c in cs})


def _importances(spark: SparkSession, d: str) -> DataFrame:
    """Each nation number stands for a feature; its customers' share is the importance."""
    names = F.array(*[F.lit(x) for x in FEATURES])
    counts = table(spark, d, "customer").where(F.col("c_nationkey") < len(FEATURES)).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return counts.select(names[F.col("c_nationkey")].alias("feature"), (F.col("n") / 1000.0).alias("importance"))


def q40_weights_normalize(spark: SparkSession, d: str) -> DataFrame:
    return model.normalised(model.raw_weights(_importances(spark, d))).withColumn("weight", F.round("weight", 12))


#: Weights of the score's query; any that sum to 1 serve.
SCORE = {"vegetation_density": 0.15, "slope_degrees": 0.2, "aspect_south_factor": 0.05, "elevation_meters": 0.25, "infrastructure_distance_km": 0.1, "weather_erc_max": 0.25}


def q41_risk_score(spark: SparkSession, d: str) -> DataFrame:
    parts = {"vegetation_density": "l_discount", "slope_degrees": "q", "aspect_south_factor": "l_tax", "elevation_meters": "e", "infrastructure_distance_km": "n", "weather_erc_max": "l_discount"}
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax", (F.col("l_quantity") / 50.0).alias("q"), (F.col("l_extendedprice") / 100000.0).alias("e"), (F.col("l_linenumber") / 7.0).alias("n")
    )
    return model.risk_score(rows, model.check_weights(SCORE), parts).select("l_orderkey", "l_linenumber", F.round("risk_score", 9).alias("risk_score"))


def q42_top_importances(spark: SparkSession, d: str) -> DataFrame:
    return _importances(spark, d).orderBy(F.desc("importance"), "feature").limit(10)


def q43_props_json_agg(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count(k).alias("n_k"))


def q44_unit_suffix_rename(spark: SparkSession, d: str) -> DataFrame:
    unit = F.concat(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.lit(" (mm)")).otherwise(F.lit("")))
    return table(spark, d, "events").select("event_id", scalar.plain_name(unit).alias("name"))


def q45_kmeans_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = folds.kmeans_blocks(_customers(spark, d), "lon", "lat", P.groups, P.seed, starts=3)
    return blocks.groupBy("spatial_group").agg(F.count("*").alias("n"))


def q46_forest_spatial_cv(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "source", "text"), "doc_id")
    rows = rows.select("quality", "source", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.array_distinct(F.split("text", " "))).cast("double").alias("n_distinct"))
    return model.spatial_cv(rows, ["n_chars", "n_distinct"], "quality", "source", 3, trees=10, depth=6, leaf=5)


def q47_window_pixel_median(spark: SparkSession, d: str) -> DataFrame:
    grid = raster.pixels(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    key = _key("c_custkey")
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), (key % 400).alias("raster_id"), (key % 12 - 2).cast("int").alias("row"), (key * 5 % 12 - 2).cast("int").alias("col"))
    return raster.window_median(points, grid).withColumn("value", F.round("value", 6))


def q48_scene_date_range(spark: SparkSession, d: str) -> DataFrame:
    first, last = scalar.scene_dates(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")), F.year("o_orderdate"), (6, 7, 8, 9))
    return table(spark, d, "orders").select("o_orderkey", first.cast("string").alias("first_day"), last.cast("string").alias("last_day"))


def q49_year_composite_preference(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i, n: F.when(F.col("vec_id") % n != 0, F.round(F.col("embedding")[i].cast("double"), 6))
    ndvi, ndmi = raster.by_year(e(0, 2), e(1, 3), e(2, 5), e(3, 7))
    return table(spark, d, "embeddings").select("vec_id", ndvi.alias("ndvi"), ndmi.alias("ndmi"))


def q50_epoch_parse(spark: SparkSession, d: str) -> DataFrame:
    ms = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 == 0, F.lit(1e300)).when(F.col("event_id") % 7 != 0, F.col("event_id") * 1000003.0)
    return table(spark, d, "events").select("event_id", F.unix_millis(scalar.from_epoch_ms(ms)).alias("ms"))


def q51_centroid_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = _incidents(spark, d).select("object_id", F.when(F.col("ring").isNotNull(), F.array("ring")).alias("rings"))
    return validate.with_centroid(rows, "rings").select("object_id", F.round("centroid_lon", 6).alias("centroid_lon"), F.round("centroid_lat", 6).alias("centroid_lat"))


def q52_centroid_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = _customers(spark, d).withColumns({"centroid_lon": F.when(F.col("custkey") % 7 != 0, F.col("c_acctbal")), "centroid_lat": F.when(F.col("custkey") % 5 != 0, F.col("c_acctbal"))})
    return validate.centroid_or(rows, F.col("lon"), F.col("lat")).select("custkey", "centroid_lon", "centroid_lat")


def q53_nodata_to_null(spark: SparkSession, d: str) -> DataFrame:
    value = (F.col("o_custkey") % 300).cast("double")
    return table(spark, d, "orders").select("o_orderkey", scalar.known(value, scalar.SLOPE_NODATA).alias("slope"))


def q54_patch_box(spark: SparkSession, d: str) -> DataFrame:
    box = geo.patch_box(F.col("lon"), F.col("lat"))
    return _customers(spark, d).select("custkey", *[F.round(box[k], 6).alias(k) for k in ("west", "south", "east", "north")])


def q55_small_train_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Too few rows before the holdout year, so all rows train."""
    rows = q29_alarm_year_from_epoch(spark, d)
    train, test = folds.temporal_split(rows, "year", 1900)
    return train.groupBy("year").agg(F.count("*").alias("n")).withColumn("n_test", F.lit(test.count()))


def q56_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return assemble.head(table(spark, d, "orders").where(F.col("o_orderkey") > 1000).select("o_orderkey", "o_custkey"), "o_orderkey", 50)


def q57_class_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = model.balanced_weight(_scored(spark, d), "quality")
    return rows.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.max("weight"), 12).alias("weight"))


def q58_greatest_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max("l_orderkey").alias("greatest_key"))


def q59_albers_inverse(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.albers_inverse(F.col("px") - 2_400_000, F.col("py") + 1_300_000)
    return _points(spark, d).select("point_id", F.round(x, 6).alias("lon"), F.round(y, 6).alias("lat"))


def q60_clamped_cells(spark: SparkSession, d: str) -> DataFrame:
    col, row = scenes.cell_of(F.col("lon"), F.col("lat"), (-122.0, 34.0, -116.0, 40.0))
    return _customers(spark, d).groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("n"))


def q61_weight_rows(spark: SparkSession, d: str) -> DataFrame:
    out = report.weight_rows(model.normalised(model.raw_weights(_importances(spark, d))))
    return out.withColumn("weight", F.round("weight", 12))


def q62_year_range(spark: SparkSession, d: str) -> DataFrame:
    return fetch.within_years(table(spark, d, "part"), "p_size", 10, 20).select("p_partkey", "p_size")


def q63_matched_count(spark: SparkSession, d: str) -> DataFrame:
    return build.matched(q23_feature_join(spark, d), "n_lines")


def q64_removed_percent(spark: SparkSession, d: str) -> DataFrame:
    rows = _incidents(spark, d)
    return report.removed(rows, validate.split(rows, _checks())[0])


def q65_least_distance(spark: SparkSession, d: str) -> DataFrame:
    centres = _targets(spark, d).select(F.col("ax").alias("cx"), F.col("ay").alias("cy"))
    return nearest.least_distance(_points(spark, d), centres).select("point_id", F.round("dist", 6).alias("dist"))


def q66_half_to_even(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") * 0.25, 1).alias("rounded"))


def q67_cv_score_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = report.cv_scores(model.roc_auc(_scored(spark, d), "quality", "n_chars", "fold"))
    return rows.withColumns({"auc": F.round("auc", 9), "mean": F.round("mean", 9)})


def _extractors(spark: SparkSession, d: str) -> dict[str, build.Extractor]:
    """Features of a point by its number: of every second point, and by its place."""
    return {
        "terrain": lambda p: p.where("object_id % 2 = 0").select("object_id", (F.col("object_id") % 7).cast("double").alias("slope")),
        "spatial": lambda p: p.select("object_id", scalar.half_away(F.col("centroid_lon") + F.col("centroid_lat"), 6).alias("place"), F.lit(9.0).alias("slope")),
        "vegetation": lambda p: p.select("object_id", F.lit(0.5).alias("ndvi")),
    }


def q68_point_features(spark: SparkSession, d: str) -> DataFrame:
    points = _customers(spark, d).select(F.col("custkey").alias("object_id"), "lon", "lat", F.lit(None).cast("timestamp_ntz").alias("alarm"))
    out = build.point_features(points, _extractors(spark, d), skip=("vegetation",))
    return out.select("object_id", F.round("centroid_lon", 6).alias("centroid_lon"), F.round("centroid_lat", 6).alias("centroid_lat"), "slope", "place")


def q69_build_matrix(spark: SparkSession, d: str) -> DataFrame:
    """As many negatives as fires, however many attempts they take."""
    fires = _incidents(spark, d).select("object_id", F.col("lon").alias("centroid_lon"), F.col("lat").alias("centroid_lat"), "alarm")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("object_id")).agg(F.max("l_quantity").alias("slope"))
    negatives = lambda n: _negatives(spark, d, n, None).withColumns({c: scalar.half_away(F.col(c), 9) for c in ("lon", "lat")})
    out = build.build_matrix(fires, {"terrain": lines, "water": None}, negatives, _extractors(spark, d), required=("terrain",))
    return out.select("object_id", F.round("centroid_lon", 9).alias("centroid_lon"), F.round("centroid_lat", 9).alias("centroid_lat"), "alarm", "is_fire", "slope", "place", "ndvi")


def q70_training_table(spark: SparkSession, d: str) -> DataFrame:
    """Fires only, so as many synthetic negatives join them."""
    lon, lat = _place("s_suppkey")
    fires = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("object_id"), lon.alias("centroid_lon"), lat.alias("centroid_lat"), F.lit(1).alias("is_fire"), "s_acctbal")
    out = training.training_table(fires, synthetic=True, bounds=P.bounds, seed=P.seed)
    return out.select("object_id", F.round("centroid_lon", 9).alias("centroid_lon"), F.round("centroid_lat", 9).alias("centroid_lat"), "is_fire", F.col("s_acctbal").cast("double").alias("s_acctbal"))


def q71_aligned_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = _customers(spark, d).select(F.col("custkey").alias("object_id"), F.col("lon").alias("centroid_lon"), F.col("lat").alias("centroid_lat"))
    groups = rows.select("object_id", (F.col("object_id") % P.groups).cast("int").alias("spatial_group"))
    return training.aligned_groups(rows, groups, P.groups, P.folds).select("object_id", "spatial_group")


def q72_scenes_at_points(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = _place("s_suppkey")
    catalogue = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("scene_id"), (lon - 0.5).alias("west"), (lon + 0.5).alias("east"), (lat - 0.5).alias("south"), (lat + 0.5).alias("north"), (F.col("s_suppkey") % 365).cast("int").alias("day")
    )
    points = _customers(spark, d).select("custkey", "lon", "lat", (F.col("custkey") % 300).cast("int").alias("first_day"), (F.col("custkey") % 300 + 90).cast("int").alias("last_day"))
    return fetch.scenes_at(points, catalogue).select("custkey", "scene_id")


def q73_scene_search(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = _place("s_suppkey")
    catalogue = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("scene_id"), (lon - 0.5).alias("west"), (lon + 0.5).alias("east"), (lat - 0.5).alias("south"), (lat + 0.5).alias("north"), (F.col("s_suppkey") % 365).cast("int").alias("day"), (F.col("s_suppkey") % 101).alias("cloud")
    )
    return fetch.scenes_between(catalogue, F.lit(1), F.lit(300), (-122.0, 34.0, -116.0, 40.0), 60).select("scene_id", "day", "cloud")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()}
