"""SQL of the queries, for DuckDB over the same tables."""

from __future__ import annotations

import math

from terrakiln.functions import geo
from terrakiln.operators.model import FACTORS, REQUIRED
from terrakiln.plans.queries import BOX, EVENTS, FEATURES, SCORE

PLACES = """places AS (
  SELECT c_custkey AS custkey, c_nationkey AS nation, c_acctbal,
         -124.5e0 + (c_custkey * 7919 % 10500) / 1000e0 AS lon, 32.5e0 + (c_custkey * 6007 % 9500) / 1000e0 AS lat
  FROM customer)"""
INCIDENTS = """incidents AS (
  SELECT o_orderkey AS object_id, CASE WHEN o_orderkey % 53 <> 0 THEN o_orderdate END AS alarm, o_totalprice AS acres,
         CAST(o_orderkey % 8 + 1 AS INTEGER) AS method, o_custkey % 97 <> 0 AS has_ring,
         -124.5e0 + (o_custkey * 7919 % 10500) / 1000e0 AS lon, 32.5e0 + (o_custkey * 6007 % 9500) / 1000e0 AS lat,
         CASE WHEN o_orderkey % 59 <> 0 THEN c.cont END AS cont
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS cont FROM lineitem GROUP BY 1) c ON c.l_orderkey = o_orderkey)"""
CHECKS = f"""{INCIDENTS}, checks AS (
  SELECT object_id, has_ring AS has_geometry, has_ring AS geometry_valid, alarm IS NOT NULL AS has_alarm_date,
         coalesce(acres BETWEEN 10000 AND 300000, false) AS reasonable_size,
         has_ring AND lon + 0.05e0 > {BOX[0]} AND lon + 0.05e0 < {BOX[2]} AND lat + 0.05e0 > {BOX[1]} AND lat + 0.05e0 < {BOX[3]} AS within_california,
         cont IS NOT NULL AS has_cont_date, coalesce(cont >= alarm, false) AS cont_after_alarm
  FROM incidents)"""
REPORT = f"""{CHECKS}, report AS (
  SELECT object_id, concat_ws(',', {", ".join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in ("has_geometry", "geometry_valid", "has_alarm_date", "reasonable_size", "within_california", "has_cont_date", "cont_after_alarm"))}) AS failed_checks
  FROM checks)"""
PIXELS = """pixels AS (
  SELECT vec_id AS raster_id, CAST(i // 8 AS INTEGER) AS "row", CAST(i % 8 AS INTEGER) AS col, CAST(embedding[i + 1] AS DOUBLE) AS value
  FROM embeddings, range(0, 64) AS t(i))"""


def albers(lon: str, lat: str) -> tuple[str, str]:
    s = f"sin(radians({lat}))"
    q = f"((1e0 - {geo.E2!r}) * ({s} / (1e0 - {geo.E2!r} * {s} * {s}) - ln((1e0 - {geo.ECC!r} * {s}) / (1e0 + {geo.ECC!r} * {s})) / {2 * geo.ECC!r}))"
    rho = f"({geo.SEMI_MAJOR!r} * sqrt({geo.SHIFT!r} - {geo.CONE!r} * {q}) / {geo.CONE!r})"
    theta = f"({geo.CONE!r} * radians({lon} - {geo.ORIGIN[0]!r}))"
    return f"({rho} * sin({theta}))", f"({geo.RHO0!r} - {rho} * cos({theta}))"


def uniform(number: str, a: int, b: int, seed: int = 42) -> str:
    return f"((({number}) * {a} + {b * seed}) % 1000003 / 1000003e0)"


def windows(values: dict[str, str], days: tuple[int, ...], summed: tuple[str, ...]) -> str:
    out = []
    for v, source in values.items():
        for w in days:
            here = f"FILTER (s.ts >= a.ignition - INTERVAL {w} DAY)"
            cents = f"CAST(round(({source}) * 100) AS BIGINT)"
            out += [f"max({cents}) {here} / 100e0 AS {v}_max_{w}d", f"CAST(sum({cents}) {here} AS BIGINT) / CAST(count({source}) {here} AS DOUBLE) / 100e0 AS {v}_mean_{w}d"]
            if v in summed:
                out.append(f"CASE WHEN count(s.ts) {here} > 0 THEN coalesce(CAST(sum({cents}) {here} AS BIGINT), 0) END / 100e0 AS {v}_sum_{w}d")
    return ",\n       ".join(out)


def trailing(values: dict[str, str], days: tuple[int, ...], summed: tuple[str, ...]) -> str:
    return f"""WITH a AS (SELECT event_id, user_id, ts AS ignition FROM events)
SELECT a.event_id, a.user_id, a.ignition,
       {windows(values, days, summed)}
FROM a LEFT JOIN events s ON s.user_id = a.user_id AND s.ts >= a.ignition - INTERVAL {max(days)} DAY AND s.ts <= a.ignition
GROUP BY 1, 2, 3"""


_SEGMENT = "least(greatest(CASE WHEN dx * dx + dy * dy = 0 THEN 0e0 ELSE ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy) END, 0e0), 1e0)"
_NEAREST = f"""WITH points AS (SELECT c_custkey AS point_id, CAST(c_custkey * 7919 % 10500 * 100 AS DOUBLE) AS px, CAST(c_custkey * 6007 % 9500 * 100 AS DOUBLE) AS py FROM customer),
targets AS (SELECT s_suppkey AS segment_id, CAST(s_suppkey * 5209 % 10500 * 100 AS DOUBLE) AS ax, CAST(s_suppkey * 8689 % 9500 * 100 AS DOUBLE) AS ay FROM supplier),
segments AS ({{segments}}),
measured AS (SELECT *, {_SEGMENT} AS t FROM points, segments),
ranked AS (
  SELECT point_id, segment_id, sqrt((px - (ax + t * dx)) * (px - (ax + t * dx)) + (py - (ay + t * dy)) * (py - (ay + t * dy))) AS dist FROM measured)
SELECT point_id, segment_id, round(dist, 6) AS dist FROM ranked
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(dist, 6), segment_id) = 1"""

_TERRAIN = """WITH cells AS (
  SELECT vec_id AS raster_id, CAST(i // 8 AS INTEGER) AS "row", CAST(i % 8 AS INTEGER) AS col, CAST(embedding[i + 1] AS DOUBLE) AS elevation,
         CAST(embedding[i + 2] AS DOUBLE) - CAST(embedding[i] AS DOUBLE) AS dx, CAST(embedding[i + 9] AS DOUBLE) - CAST(embedding[i - 7] AS DOUBLE) AS dy
  FROM embeddings, range(0, 64) AS t(i) WHERE i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6)
"""
_ASPECT = "((degrees(CASE WHEN dx = 0 AND dy = 0 THEN pi() ELSE atan2(dy, -dx) END) + 360e0) % 360e0)"

_PX, _PY = albers("lon", "lat")
_NEGATIVES = f"""{PLACES},
centres AS (SELECT {_PX} AS cx, {_PY} AS cy FROM places),
tries AS (SELECT i, -124.5e0 + {uniform("i", 104729, 31)} * 10.5e0 AS lon, 32.5e0 + {uniform("i", 224737, 57)} * 9.5e0 AS lat FROM range(1, 501) AS t(i)),
projected AS (SELECT i, lon, lat, {_PX} AS px, {_PY} AS py FROM tries),
free AS (
  SELECT i, lon, lat FROM projected p
  WHERE NOT EXISTS (SELECT 1 FROM centres c WHERE sqrt((p.px - c.cx) * (p.px - c.cx) + (p.py - c.cy) * (p.py - c.cy)) < 5000)),
numbered AS (SELECT *, row_number() OVER (ORDER BY i) AS k FROM free),
dates AS (SELECT o_orderdate AS alarm, row_number() OVER (ORDER BY o_orderdate) - 1 AS number FROM (SELECT DISTINCT o_orderdate FROM orders)),
negatives AS (
  SELECT CAST(-k AS BIGINT) AS object_id, round(lon, 9) AS lon, round(lat, 9) AS lat, d.alarm
  FROM numbered LEFT JOIN dates d ON d.number = (k * 7919) % (SELECT count(*) FROM dates) WHERE k <= 40)"""
#: As many as orders, which are the fires. One period of the attempts holds every place, and the free ones come again in its order.
_ALL_NEGATIVES = f"""{PLACES},
centres AS (SELECT DISTINCT cx, cy, floor(cx / 5000) AS i5, floor(cy / 5000) AS j5 FROM (SELECT {_PX} AS cx, {_PY} AS cy FROM places)),
tries AS (SELECT i, -124.5e0 + {uniform("i", 104729, 31)} * 10.5e0 AS lon, 32.5e0 + {uniform("i", 224737, 57)} * 9.5e0 AS lat FROM range(1, 1000004) AS t(i)),
projected AS (SELECT i, lon, lat, {_PX} AS px, {_PY} AS py FROM tries),
asked AS (SELECT i, px, py, floor(px / 5000) + a AS i5, floor(py / 5000) + b AS j5 FROM projected, range(-1, 2) AS s(a), range(-1, 2) AS u(b)),
taken AS (SELECT DISTINCT i FROM asked p JOIN centres c USING (i5, j5) WHERE sqrt((p.px - c.cx) * (p.px - c.cx) + (p.py - c.cy) * (p.py - c.cy)) < 5000),
free AS (SELECT lon, lat, row_number() OVER (ORDER BY i) - 1 AS place FROM projected ANTI JOIN taken USING (i)),
dates AS (SELECT o_orderdate AS alarm, row_number() OVER (ORDER BY o_orderdate) - 1 AS number FROM (SELECT DISTINCT o_orderdate FROM orders)),
sizes AS (SELECT (SELECT count(*) FROM orders) AS n_fires, (SELECT count(*) FROM free) AS n_free, (SELECT count(*) FROM dates) AS n_dates),
wanted AS (SELECT k, (k - 1) % n_free AS place, (k * 7919) % n_dates AS number FROM (SELECT unnest(range(1, n_fires + 1)) AS k, n_free, n_dates FROM sizes)),
negatives AS (
  SELECT CAST(-k AS BIGINT) AS object_id, round(lon, 9) AS lon, round(lat, 9) AS lat, d.alarm
  FROM wanted JOIN free USING (place) LEFT JOIN dates d USING (number))"""
_EPOCHS = "epochs AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN year(o_orderdate) ELSE -1 END AS year FROM orders)"
_SCORED = "scored AS (SELECT doc_id, quality, n_chars, CAST(doc_id % 5 AS INTEGER) AS fold, CAST(n_chars > 900 AS INTEGER) AS predicted FROM labels JOIN documents USING (doc_id))"
_NAMES = ", ".join(f"'{x}'" for x in FEATURES)
_IMPORTANCES = f"importances AS (SELECT [{_NAMES}][c_nationkey + 1] AS feature, count(*) / 1000e0 AS importance FROM customer WHERE c_nationkey < {len(FEATURES)} GROUP BY c_nationkey)"
_FACTORS = ", ".join(f"('{f}', '{c}')" for f, cs in FACTORS.items() for c in cs)
_BLOCKS = f"""{PLACES}, repeated AS (
  SELECT CAST(nation % 10 AS INTEGER) AS block, lon, lat FROM places UNION ALL SELECT CAST(nation % 10 AS INTEGER), lon, lat FROM places WHERE lon > -120),
blocks AS (
  SELECT block, avg({_PX}) AS x, avg({_PY}) AS y, CAST(sum(n) AS BIGINT) AS n_records
  FROM (SELECT block, lon, lat, count(*) AS n FROM repeated GROUP BY 1, 2, 3) GROUP BY 1)"""
_SCENES = "scenes AS (SELECT p_partkey AS scene_id, p_partkey AS pos, CASE WHEN p_partkey % 13 <> 0 THEN p_size END AS cloud, p_brand AS cell, p_retailprice FROM part)"



def albers_inverse(x: str, y: str) -> tuple[str, str]:
    e4, e6 = geo.E2 * geo.E2, geo.E2**3
    rho = f"sqrt(({x}) * ({x}) + ({geo.RHO0!r} - ({y})) * ({geo.RHO0!r} - ({y})))"
    theta = f"atan2({x}, {geo.RHO0!r} - ({y}))"
    beta = f"asin((({geo.SHIFT!r} - ({rho} * {geo.CONE / geo.SEMI_MAJOR!r}) * ({rho} * {geo.CONE / geo.SEMI_MAJOR!r})) / {geo.CONE!r}) / {geo._q(math.pi / 2)!r})"
    terms = (geo.E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 23 * e4 / 360 + 251 * e6 / 3780, 761 * e6 / 45360)
    phi = f"({beta} + {terms[0]!r} * sin(2 * {beta}) + {terms[1]!r} * sin(4 * {beta}) + {terms[2]!r} * sin(6 * {beta}))"
    return f"({geo.ORIGIN[0]!r} + degrees({theta} / {geo.CONE!r}))", f"degrees({phi})"


_CORNERS = ", ".join(f"{v} AS {n}{k}" for k, (a, b) in enumerate(((0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1))) for n, v in zip("xy", albers(f"(lon + {a}e0)", f"(lat + {b}e0)"), strict=True))
_LON, _LAT = albers_inverse("cx", "cy")
_PLON, _PLAT = albers_inverse("px", "py")
_CATALOGUE = """catalogue AS (
  SELECT s_suppkey AS scene_id, -124.5e0 + (s_suppkey * 7919 % 10500) / 1000e0 AS lon, 32.5e0 + (s_suppkey * 6007 % 9500) / 1000e0 AS lat, CAST(s_suppkey % 365 AS INTEGER) AS day, s_suppkey % 101 AS cloud FROM supplier)"""

ORACLES: dict[str, str] = {
    "q01_quality_filter": f"WITH {INCIDENTS} SELECT object_id, acres, method FROM incidents WHERE acres BETWEEN 10000 AND 300000 AND method IN (1, 2, 3, 4)",
    "q02_validation_checks": f"WITH {CHECKS} SELECT * FROM checks",
    "q03_validation_report": f"WITH {REPORT} SELECT object_id, failed_checks FROM report WHERE failed_checks <> ''",
    "q04_failure_histogram_top5": f"WITH {REPORT} SELECT failed_checks, count(*) AS n FROM report WHERE failed_checks <> '' GROUP BY 1 ORDER BY n DESC, failed_checks LIMIT 5",
    "q05_summary_stats": """SELECT count(*) AS n, CAST(min(year(o_orderdate)) AS INTEGER) AS min_year, CAST(max(year(o_orderdate)) AS INTEGER) AS max_year,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100e0 AS sum_acres,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / CAST(count(o_totalprice) AS DOUBLE) / 100e0 AS mean_acres FROM orders""",
    "q06_bbox_strict": f"WITH {PLACES} SELECT custkey, lon, lat FROM places WHERE lon > -122 AND lon < -116 AND lat > 34 AND lat < 40",
    "q07_albers_project": f"WITH {PLACES} SELECT custkey, round({_PX}, 3) AS x_m, round({_PY}, 3) AS y_m FROM places",
    "q08_weather_windows": trailing({"value": "s.value"}, (7, 14, 30), ("value",)),
    "q09_weather_windows_by_var": trailing({v: f"CASE WHEN s.event_type = '{v}' THEN s.value END" for v in EVENTS}, (7,), ("purchase",)),
    "q10_completeness_gate": """WITH a AS (SELECT DISTINCT user_id, ts AS ignition FROM events WHERE ts >= TIMESTAMP '1979-01-01'),
d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)
SELECT a.user_id, a.ignition, count(d.day) AS n_days
FROM a LEFT JOIN d ON d.user_id = a.user_id AND d.day BETWEEN CAST(a.ignition - INTERVAL 14 DAY AS DATE) AND CAST(a.ignition AS DATE)
GROUP BY 1, 2 HAVING count(d.day) >= 0.3e0 * 15""",
    "q11_nearest_point": _NEAREST.replace("{segments}", "SELECT segment_id, ax, ay, 0e0 AS dx, 0e0 AS dy FROM targets"),
    "q12_nearest_segment": _NEAREST.replace("{segments}", "SELECT a.segment_id, a.ax, a.ay, b.ax - a.ax AS dx, b.ay - a.ay AS dy FROM targets a JOIN targets b ON b.segment_id = a.segment_id + 1"),
    "q13_nearest_dedupe_ties": "SELECT l_orderkey, l_quantity, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) = 1",
    "q14_terrain_slope": _TERRAIN + 'SELECT raster_id, "row", col, round(elevation, 6) AS elevation, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope FROM cells',
    "q15_terrain_aspect_south_factor": _TERRAIN + f'SELECT raster_id, "row", col, round({_ASPECT}, 6) AS aspect, round(greatest(0e0, cos(radians({_ASPECT} - 180))), 6) AS south FROM cells',
    "q16_raster_point_sample": f"""WITH {PIXELS}, points AS (
  SELECT c_custkey AS point_id, c_custkey % 400 AS raster_id,
         CAST(floor((8.5e0 - (c_custkey * 7 % 30) / 3e0 - 8e0) / -1e0) AS INTEGER) AS "row", CAST(floor(((c_custkey % 30) / 3e0 - 0.5e0) / 1e0) AS INTEGER) AS col FROM customer)
SELECT p.point_id, p.raster_id, p."row", p.col, CASE WHEN p."row" BETWEEN 1 AND 6 AND p.col BETWEEN 1 AND 6 THEN round(x.value, 6) END AS value
FROM points p LEFT JOIN pixels x ON x.raster_id = p.raster_id AND x."row" = p."row" AND x.col = p.col""",
    "q17_ndvi_density": """WITH raw AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) * 50 AS a, abs(CAST(embedding[2] AS DOUBLE)) * 50 AS b, abs(CAST(embedding[3] AS DOUBLE)) * 50 AS c FROM embeddings),
bands AS (SELECT vec_id, CASE WHEN a > 2 THEN a / 10000e0 ELSE a END AS red, CASE WHEN b > 2 THEN b / 10000e0 ELSE b END AS nir, CASE WHEN c > 2 THEN c / 10000e0 ELSE c END AS swir FROM raw),
n AS (SELECT vec_id, CASE WHEN nir + red <> 0 THEN (nir - red) / (nir + red) END AS ndvi, CASE WHEN nir + swir <> 0 THEN (nir - swir) / (nir + swir) END AS ndmi FROM bands)
SELECT vec_id, round(ndvi, 9) AS ndvi, round(ndmi, 9) AS ndmi, round(least(greatest((ndvi + 1) / 2, 0e0), 1e0), 9) AS vegetation_density FROM n""",
    "q18_vegetation_fallback": """WITH raw AS (
  SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN CAST(embedding[1] AS DOUBLE) END AS a, CASE WHEN vec_id % 3 <> 0 THEN CAST(embedding[2] AS DOUBLE) END AS b,
         CASE WHEN vec_id % 5 <> 0 THEN CAST(embedding[3] AS DOUBLE) END AS c FROM embeddings),
s AS (SELECT *, CASE WHEN vec_id % 11 <> 0 AND a IS NOT NULL THEN 'raster' WHEN vec_id % 11 <> 0 AND vec_id % 2 = 0 AND c IS NOT NULL THEN 'scene' ELSE 'default' END AS veg_source FROM raw),
v AS (SELECT vec_id, veg_source, CASE veg_source WHEN 'raster' THEN a WHEN 'scene' THEN c ELSE 0.5e0 END AS ndvi, coalesce(CASE veg_source WHEN 'raster' THEN b END, 0.3e0) AS ndmi FROM s)
SELECT vec_id, veg_source, round(ndvi, 9) AS ndvi_mean, round(ndmi, 9) AS ndmi_mean, round(least(greatest((ndvi + 1) / 2, 0e0), 1e0), 9) AS vegetation_density FROM v""",
    "q19_scene_topk_cloud": f"WITH {_SCENES} SELECT scene_id, cloud FROM scenes WHERE cloud < 45 ORDER BY coalesce(cloud, 100), pos LIMIT 15",
    "q20_scene_topk_spatial": f"""WITH {_SCENES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cell ORDER BY coalesce(cloud, 100), pos) AS in_cell, min(pos) OVER (PARTITION BY cell) AS seen,
         greatest(1, 60 // (SELECT count(DISTINCT cell) FROM scenes)) AS per_cell FROM scenes)
SELECT scene_id, cell, cloud FROM ranked
ORDER BY CASE WHEN in_cell <= per_cell THEN 0 ELSE 1 END, CASE WHEN in_cell <= per_cell THEN seen ELSE 0 END, CASE WHEN in_cell <= per_cell THEN in_cell ELSE 0 END, coalesce(cloud, 100), pos LIMIT 60""",
    "q21_first_finite_scene": f"WITH {_SCENES} SELECT cell, scene_id, p_retailprice AS value FROM scenes WHERE pos % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY coalesce(cloud, 100), pos) = 1",
    "q22_median_composite": f"""WITH {PIXELS}, inner_median AS (SELECT raster_id // 10 AS batch, "row", col, median(value) AS value FROM pixels GROUP BY 1, 2, 3)
SELECT "row", col, round(median(value), 6) AS value FROM inner_median GROUP BY 1, 2""",
    "q23_feature_join": """WITH l AS (SELECT l_orderkey AS object_id, count(*) AS n_lines, max(l_quantity) AS max_quantity, min(l_shipdate) AS first_ship, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1)
SELECT o_orderkey AS object_id, o_totalprice AS acres, w.n_lines, t.max_quantity, s.first_ship, v.n_suppliers FROM orders
LEFT JOIN l w ON w.object_id = o_orderkey AND w.object_id % 2 = 0 LEFT JOIN l t ON t.object_id = o_orderkey AND t.object_id % 3 = 0
LEFT JOIN l s ON s.object_id = o_orderkey AND s.n_lines > 3 LEFT JOIN l v ON v.object_id = o_orderkey""",
    "q24_pseudo_absence": f"WITH {_NEGATIVES} SELECT * FROM negatives",
    "q25_feature_matrix": f"""WITH {_NEGATIVES}, {INCIDENTS}
SELECT object_id, round(lon, 9) AS lon, round(lat, 9) AS lat, alarm, acres, 1 AS is_fire FROM incidents
UNION ALL SELECT object_id, lon, lat, alarm, CAST(NULL AS DOUBLE), 0 FROM negatives""",
    "q26_resume_merge": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN o_totalprice END AS elevation FROM orders",
    "q27_synthetic_negatives": f"""WITH m AS (SELECT median(l_quantity) AS l_quantity, median(l_extendedprice) AS l_extendedprice, median(l_discount) AS l_discount FROM lineitem)
SELECT CAST(-i AS BIGINT) AS object_id, round(-124.5e0 + {uniform("i", 104729, 31)} * 10.5e0, 9) AS lon, round(32.5e0 + {uniform("i", 224737, 57)} * 9.5e0, 9) AS lat,
       CAST(make_date(CAST(floor({uniform("i", 350377, 91)} * 25) AS BIGINT) + 2000, CAST(floor({uniform("i", 479909, 91)} * 4) AS BIGINT) + 6, CAST(floor({uniform("i", 611953, 91)} * 27) AS BIGINT) + 1) AS VARCHAR) AS alarm,
       0 AS is_fire, m.* FROM range(1, 26) AS t(i), m""",
    "q28_median_impute": "WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS price FROM orders) SELECT o_orderkey, coalesce(price, (SELECT median(price) FROM p)) AS price FROM p",
    "q29_alarm_year_from_epoch": f"WITH {_EPOCHS} SELECT o_orderkey, CAST(year AS INTEGER) AS year FROM epochs",
    "q30_standardize_xy": f"WITH {PLACES} SELECT custkey, round((lon - avg(lon) OVER ()) / stddev_pop(lon) OVER (), 9) AS z_lon, round((lat - avg(lat) OVER ()) / stddev_pop(lat) OVER (), 9) AS z_lat FROM places",
    "q31_groupkfold_assign": """WITH RECURSIVE sizes AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1),
ordered AS (SELECT nation, n, row_number() OVER (ORDER BY n DESC, nation) AS k FROM sizes),
placed AS (
  SELECT 0::BIGINT AS k, NULL::INTEGER AS nation, NULL::INTEGER AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load
  UNION ALL
  SELECT o.k, o.nation, CAST(list_position(p.load, list_min(p.load)) - 1 AS INTEGER),
         list_transform(range(1, 6), lambda i: CASE WHEN i = list_position(p.load, list_min(p.load)) THEN p.load[i] + o.n ELSE p.load[i] END)
  FROM placed p JOIN ordered o ON o.k = p.k + 1)
SELECT nation, fold FROM placed WHERE k > 0""",
    "q32_fold_leakage": """WITH r AS (SELECT c_nationkey AS nation, CAST(c_acctbal > 0 AS BIGINT) AS y, CAST(CASE WHEN c_custkey % 100 = 0 THEN 0 ELSE c_nationkey % 5 END AS INTEGER) AS fold FROM customer),
f AS (SELECT DISTINCT fold FROM r)
SELECT f.fold, (SELECT count(*) FROM r WHERE r.fold = f.fold) AS n_test, (SELECT CAST(sum(y) AS BIGINT) FROM r WHERE r.fold = f.fold) AS n_test_fires,
       (SELECT count(DISTINCT nation) FROM r WHERE r.fold = f.fold) AS n_test_groups, (SELECT count(DISTINCT nation) FROM r WHERE r.fold <> f.fold) AS n_train_groups,
       (SELECT count(DISTINCT a.nation) FROM r a WHERE a.fold = f.fold AND EXISTS (SELECT 1 FROM r b WHERE b.nation = a.nation AND b.fold <> f.fold)) AS n_shared
FROM f""",
    "q33_group_summary": "SELECT c_nationkey AS nation, count(*) AS n_total, count(*) FILTER (c_acctbal > 0) AS n_fires, count(*) FILTER (c_acctbal <= 0) AS n_pseudo FROM customer GROUP BY 1",
    "q34_cluster_centroids_distinct": f"WITH {_BLOCKS} SELECT block, round(x, 3) AS x, round(y, 3) AS y, n_records FROM blocks",
    "q35_min_cluster_separation": f"""WITH {_BLOCKS}, pairs AS (
  SELECT a.block AS group_a, b.block AS group_b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 1000 AS km FROM blocks a JOIN blocks b ON a.block < b.block)
SELECT group_a, group_b, round(km, 6) AS km, km >= 30 AS passed FROM pairs ORDER BY pairs.km, group_a, group_b LIMIT 1""",
    "q36_temporal_holdout_split": f"""WITH {_EPOCHS}
SELECT CAST(year AS INTEGER) AS year, count(*) AS n, CASE WHEN year = 2000 THEN 'test' ELSE 'train' END AS side FROM epochs WHERE year >= 0 AND year <= 2000 GROUP BY 1, 3, epochs.year""",
    "q37_roc_auc": f"""WITH {_SCORED}, ranked AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2e0 AS r FROM scored)
SELECT count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg,
       round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2e0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 12) AS auc FROM ranked""",
    "q38_accuracy_confusion": f"""WITH {_SCORED} SELECT fold, count(*) FILTER (quality = 0 AND predicted = 0) AS tn, count(*) FILTER (quality = 0 AND predicted = 1) AS fp,
       count(*) FILTER (quality = 1 AND predicted = 0) AS fn, count(*) FILTER (quality = 1 AND predicted = 1) AS tp,
       round(count(*) FILTER (quality = predicted) / CAST(count(*) AS DOUBLE), 12) AS accuracy FROM scored GROUP BY 1""",
    "q39_cv_mean_std": f"""WITH {_SCORED}, kept AS (SELECT * FROM scored WHERE fold > 0 OR quality = 1),
ranked AS (SELECT fold, quality, rank() OVER (PARTITION BY fold ORDER BY n_chars) + (count(*) OVER (PARTITION BY fold, n_chars) - 1) / 2e0 AS r FROM kept),
folds AS (SELECT fold, (sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2e0) / nullif(count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0), 0) AS auc FROM ranked GROUP BY 1)
SELECT round(avg(auc), 9) AS mean_auc, round(stddev_pop(auc), 9) AS std_auc, count(auc) AS n_scored FROM folds""",
    "q40_weights_normalize": f"""WITH {_IMPORTANCES}, mapped(factor, feature) AS (VALUES {_FACTORS}),
raw AS (SELECT factor, coalesce(max(importance), 0e0) AS raw FROM mapped LEFT JOIN importances USING (feature) GROUP BY 1),
kept AS (SELECT * FROM raw WHERE factor IN ({", ".join(f"'{x}'" for x in REQUIRED)}) OR raw > 0)
SELECT factor, raw, round(raw / sum(raw) OVER (), 12) AS weight FROM kept""",
    "q41_risk_score": f"""SELECT l_orderkey, l_linenumber, round(100 * ({SCORE['vegetation_density']}e0 * l_discount + {SCORE['slope_degrees']}e0 * (l_quantity / 50e0) + {SCORE['aspect_south_factor']}e0 * l_tax
  + {SCORE['elevation_meters']}e0 * (l_extendedprice / 100000e0) + {SCORE['infrastructure_distance_km']}e0 * (l_linenumber / 7e0) + {SCORE['weather_erc_max']}e0 * l_discount), 9) AS risk_score FROM lineitem""",
    "q42_top_importances": f"WITH {_IMPORTANCES} SELECT feature, importance FROM importances ORDER BY importance DESC, feature LIMIT 10",
    "q43_props_json_agg": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(json_extract(props, '$.k')) AS n_k FROM events GROUP BY 1",
    "q44_unit_suffix_rename": "SELECT event_id, trim(split_part(event_type || CASE WHEN event_id % 2 = 0 THEN ' (mm)' ELSE '' END, '(', 1)) AS name FROM events",
    "q47_window_pixel_median": f"""WITH {PIXELS}, points AS (
  SELECT c_custkey AS point_id, c_custkey % 400 AS raster_id, CAST(c_custkey % 12 - 2 AS INTEGER) AS "row", CAST(c_custkey * 5 % 12 - 2 AS INTEGER) AS col FROM customer)
SELECT p.point_id, round(median(x.value), 6) AS value FROM points p
LEFT JOIN pixels x ON x.raster_id = p.raster_id AND abs(x."row" - p."row") <= 2 AND abs(x.col - p.col) <= 2 GROUP BY 1""",
    "q48_scene_date_range": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) - 60 AS DATE) ELSE make_date(year(o_orderdate), 6, 1) END AS VARCHAR) AS first_day,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) ELSE make_date(year(o_orderdate), 9, 28) END AS VARCHAR) AS last_day FROM orders""",
    "q49_year_composite_preference": """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 2 <> 0 THEN round(CAST(embedding[1] AS DOUBLE), 6) END AS a, CASE WHEN vec_id % 3 <> 0 THEN round(CAST(embedding[2] AS DOUBLE), 6) END AS b,
         CASE WHEN vec_id % 5 <> 0 THEN round(CAST(embedding[3] AS DOUBLE), 6) END AS c, CASE WHEN vec_id % 7 <> 0 THEN round(CAST(embedding[4] AS DOUBLE), 6) END AS d FROM embeddings)
SELECT vec_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE c END AS ndvi, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE d END AS ndmi FROM e""",
    "q50_epoch_parse": "SELECT event_id, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 7 <> 0 THEN CAST(event_id * 1000003 AS BIGINT) END AS ms FROM events",
    "q51_centroid_columns": f"""WITH {INCIDENTS}, corners AS (SELECT object_id, {_CORNERS} FROM incidents WHERE has_ring),
edges AS (SELECT object_id, x0, y0, x1 - x0 AS ax, y1 - y0 AS ay, x2 - x0 AS bx, y2 - y0 AS "by", x3 - x0 AS dx, y3 - y0 AS dy FROM corners),
moments AS (SELECT *, ax * "by" - bx * ay AS p, bx * dy - dx * "by" AS q FROM edges),
centres AS (SELECT object_id, x0 + ((ax + bx) * p + (bx + dx) * q) / (3 * (p + q)) AS cx, y0 + ((ay + "by") * p + ("by" + dy) * q) / (3 * (p + q)) AS cy FROM moments)
SELECT i.object_id, round({_LON}, 6) AS centroid_lon, round({_LAT}, 6) AS centroid_lat FROM incidents i LEFT JOIN centres c USING (object_id)""",
    "q52_centroid_fallback": f"""WITH {PLACES} SELECT custkey, CASE WHEN custkey % 7 <> 0 AND custkey % 5 <> 0 THEN c_acctbal ELSE lon END AS centroid_lon,
       CASE WHEN custkey % 7 <> 0 AND custkey % 5 <> 0 THEN c_acctbal ELSE lat END AS centroid_lat FROM places""",
    "q53_nodata_to_null": "SELECT o_orderkey, CAST(nullif(o_custkey % 300, 255) AS DOUBLE) AS slope FROM orders",
    "q54_patch_box": f"WITH {PLACES} SELECT custkey, round(lon - 0.001e0, 6) AS west, round(lat - 0.001e0, 6) AS south, round(lon + 0.001e0, 6) AS east, round(lat + 0.001e0, 6) AS north FROM places",
    "q55_small_train_fallback": f"WITH {_EPOCHS} SELECT CAST(year AS INTEGER) AS year, count(*) AS n, 0 AS n_test FROM epochs GROUP BY epochs.year",
    "q56_keyset_page": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50",
    "q57_class_weights": f"WITH {_SCORED} SELECT quality, count(*) AS n, round((SELECT count(*) FROM scored) / (2e0 * count(*)), 12) AS weight FROM scored GROUP BY 1",
    "q58_greatest_key": "SELECT l_returnflag, max(l_orderkey) AS greatest_key FROM lineitem GROUP BY 1",
    "q59_albers_inverse": f"""WITH points AS (SELECT c_custkey AS point_id, CAST(c_custkey * 7919 % 10500 * 100 - 2400000 AS DOUBLE) AS px, CAST(c_custkey * 6007 % 9500 * 100 + 1300000 AS DOUBLE) AS py FROM customer)
SELECT point_id, round({_PLON}, 6) AS lon, round({_PLAT}, 6) AS lat FROM points""",
    "q60_clamped_cells": f"""WITH {PLACES} SELECT CAST(least(5, greatest(0, trunc((lat - 34e0) / 1e0))) AS INTEGER) AS "row", CAST(least(5, greatest(0, trunc((lon + 122e0) / 1e0))) AS INTEGER) AS col, count(*) AS n FROM places GROUP BY 1, 2""",
    "q61_weight_rows": f"""WITH {_IMPORTANCES}, mapped(factor, feature) AS (VALUES {_FACTORS}),
raw AS (SELECT factor, coalesce(max(importance), 0e0) AS raw FROM mapped LEFT JOIN importances USING (feature) GROUP BY 1),
kept AS (SELECT factor, raw / sum(raw) OVER () AS weight FROM raw WHERE factor IN ({", ".join(f"'{x}'" for x in REQUIRED)}) OR raw > 0)
SELECT factor, list_aggregate(list_transform(string_split(factor, '_'), lambda w: upper(w[1:1]) || w[2:]), 'string_agg', ' ') AS title, round(weight, 12) AS weight, printf('%.3f', weight) AS label FROM kept""",
    "q62_year_range": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "q63_matched_count": "SELECT count(*) AS n_rows, count(l.k) AS n_matched FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 2 = 0) l ON l.k = o_orderkey",
    "q64_removed_percent": f"""WITH {REPORT}, n AS (SELECT count(*) AS n_before, count(*) FILTER (failed_checks = '') AS n_after FROM report)
SELECT n_before, n_after, n_before - n_after AS n_removed, round_even(100e0 * (n_before - n_after) / n_before, 2) AS removed_percent FROM n""",
    "q65_least_distance": """WITH points AS (SELECT c_custkey AS point_id, CAST(c_custkey * 7919 % 10500 * 100 AS DOUBLE) AS px, CAST(c_custkey * 6007 % 9500 * 100 AS DOUBLE) AS py FROM customer),
targets AS (SELECT CAST(s_suppkey * 5209 % 10500 * 100 AS DOUBLE) AS ax, CAST(s_suppkey * 8689 % 9500 * 100 AS DOUBLE) AS ay FROM supplier)
SELECT point_id, round(min(sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay))), 6) AS dist FROM points, targets GROUP BY 1""",
    "q66_half_to_even": "SELECT l_orderkey, l_linenumber, round_even(CAST(l_quantity AS DOUBLE) * 0.25e0, 1) AS rounded FROM lineitem",
    "q67_cv_score_rows": f"""WITH {_SCORED}, ranked AS (SELECT fold, quality, rank() OVER (PARTITION BY fold ORDER BY n_chars) + (count(*) OVER (PARTITION BY fold, n_chars) - 1) / 2e0 AS r FROM scored),
folds AS (SELECT fold, (sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2e0) / nullif(count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0), 0) AS auc FROM ranked GROUP BY 1)
SELECT fold, 'Fold ' || (fold + 1) AS title, round(auc, 9) AS auc, printf('%.3f', auc) AS label, round(avg(auc) OVER (), 9) AS mean FROM folds WHERE auc IS NOT NULL""",
    "q68_point_features": f"""WITH {PLACES} SELECT custkey AS object_id, round(lon, 6) AS centroid_lon, round(lat, 6) AS centroid_lat,
       CASE WHEN custkey % 2 = 0 THEN CAST(custkey % 7 AS DOUBLE) END AS slope, round(lon + lat, 6) AS place FROM places""",
    "q69_build_matrix": f"""WITH {_ALL_NEGATIVES}, {INCIDENTS}
SELECT object_id, round(lon, 9) AS centroid_lon, round(lat, 9) AS centroid_lat, alarm, 1 AS is_fire, CAST(l.slope AS DOUBLE) AS slope, CAST(NULL AS DOUBLE) AS place, CAST(NULL AS DOUBLE) AS ndvi
FROM incidents LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS slope FROM lineitem GROUP BY 1) l ON l.l_orderkey = object_id
UNION ALL SELECT object_id, lon, lat, alarm, 0, CASE WHEN object_id % 2 = 0 THEN CAST(object_id % 7 AS DOUBLE) END, round(lon + lat, 6), 0.5e0 FROM negatives""",
    "q70_training_table": f"""WITH s AS (SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier)
SELECT CAST(s_suppkey AS BIGINT) AS object_id, round(-124.5e0 + (s_suppkey * 7919 % 10500) / 1000e0, 9) AS centroid_lon, round(32.5e0 + (s_suppkey * 6007 % 9500) / 1000e0, 9) AS centroid_lat, 1 AS is_fire, s_acctbal FROM s
UNION ALL SELECT CAST(-i AS BIGINT), round(-124.5e0 + {uniform("i", 104729, 31)} * 10.5e0, 9), round(32.5e0 + {uniform("i", 224737, 57)} * 9.5e0, 9), 0, (SELECT median(s_acctbal) FROM s)
FROM (SELECT unnest(range(1, (SELECT count(*) FROM s) + 1)) AS i)""",
    "q71_aligned_groups": "SELECT c_custkey AS object_id, CAST(c_custkey % 10 AS INTEGER) AS spatial_group FROM customer",
    "q72_scenes_at_points": f"""WITH {PLACES}, {_CATALOGUE}
SELECT custkey, scene_id FROM places p JOIN catalogue c ON p.lon BETWEEN c.lon - 0.5e0 AND c.lon + 0.5e0 AND p.lat BETWEEN c.lat - 0.5e0 AND c.lat + 0.5e0 AND c.day BETWEEN custkey % 300 AND custkey % 300 + 90""",
    "q73_scene_search": f"""WITH {_CATALOGUE} SELECT scene_id, day, cloud FROM catalogue
WHERE day BETWEEN 1 AND 300 AND lon - 0.5e0 <= -116 AND lon + 0.5e0 >= -122 AND lat - 0.5e0 <= 40 AND lat + 0.5e0 >= 34 AND cloud < 60""",
}
