"""Geodesic queries, GeoJSON sources and the scene sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aerolattice.catalog import fixtures as fx
from aerolattice.catalog.fixtures import VIEWS, frac_sql, hex_round_sql, inside_sql, with_views
from aerolattice.catalog.geometry import ID, r6, s6
from aerolattice.catalog.planning import SCENE_SQL, SNAP_X, SNAP_Y, STEP_X, STEP_Y, planar_scene
from aerolattice.catalog.registry import c, num, query
from aerolattice.functions import geodesy
from aerolattice.operators import frame
from aerolattice.plans.published import map_scene, plan_points
from aerolattice.runtime import shared_folder
from aerolattice.sources import geojson

GEO_CENTRE_SQL = "SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM (SELECT DISTINCT lon, lat FROM fx_geo)"


FLAT = num(geodesy.FLATTENING)
ROUND = num(1 - geodesy.FLATTENING)
SERIES_SQL = f"""SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small
    FROM (SELECT *, cos2_a * {num((geodesy.A**2 - geodesy.B**2) / geodesy.B**2)} AS u FROM"""
DELTA_SQL = """small * sin_s * (cos_2m + small / 4 * (cos_s * (2 * cos_2m * cos_2m - 1)
    - small / 6 * cos_2m * (4 * sin_s * sin_s - 3) * (4 * cos_2m * cos_2m - 3)))"""
BEND_SQL = f"{FLAT} / 16 * cos2_a * (4 + {FLAT} * (4 - 3 * cos2_a))"
TURN_SQL = f"(1 - c) * {FLAT} * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m * cos_2m - 1)))"
SQL_ROUNDS = 8


def forward_sql(source):
    """Rows of `source(lon, lat, lon0, lat0, ..)` with metres east and north of the centre, by the iterated series."""
    text = f"""(SELECT *, gap AS lam FROM (SELECT *, atan({ROUND} * tan(radians(lat0))) AS u1, atan({ROUND} * tan(radians(lat))) AS u2,
        radians(lon - lon0) AS gap FROM {source}))"""
    for turn in range(SQL_ROUNDS):
        text = f"""(SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS sin_s,
            sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cos_s FROM {text})"""
        text = f"(SELECT *, atan2(sin_s, cos_s) AS sigma, CASE WHEN sin_s = 0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(lam) / sin_s END AS sin_a FROM {text})"
        text = f"(SELECT *, 1 - sin_a * sin_a AS cos2_a FROM {text})"
        text = f"(SELECT *, CASE WHEN cos2_a = 0 THEN 0e0 ELSE cos_s - 2 * sin(u1) * sin(u2) / cos2_a END AS cos_2m, {BEND_SQL} AS c FROM {text})"
        gone = "lam" if turn == SQL_ROUNDS - 1 else "lam, sin_s, cos_s, sigma, sin_a, cos2_a, cos_2m, c"
        text = f"(SELECT * EXCLUDE ({gone}), gap + {TURN_SQL} AS lam FROM {text})"
    return f"""(SELECT *, away * sin(azimuth) AS x, away * cos(azimuth) AS y FROM (
        SELECT *, {num(geodesy.B)} * big * (sigma - {DELTA_SQL}) AS away,
               atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) AS azimuth FROM ({SERIES_SQL} {text}))))"""


def back_sql(source):
    """Rows of `source(x, y, lon0, lat0, ..)` with longitude and latitude."""
    text = f"(SELECT *, atan({ROUND} * tan(radians(lat0))) AS u1, sqrt(x * x + y * y) AS away, atan2(x, y) AS azimuth FROM {source})"
    text = f"(SELECT *, atan2(tan(u1), cos(azimuth)) AS sigma1, cos(u1) * sin(azimuth) AS sin_a FROM {text})"
    text = f"(SELECT *, away / ({num(geodesy.B)} * big) AS sigma FROM ({SERIES_SQL} (SELECT *, 1 - sin_a * sin_a AS cos2_a FROM {text}))))"
    parts = "cos(2 * sigma1 + sigma) AS cos_2m, sin(sigma) AS sin_s, cos(sigma) AS cos_s"
    for _ in range(SQL_ROUNDS):
        text = f"(SELECT * EXCLUDE (sigma, cos_2m, sin_s, cos_s), away / ({num(geodesy.B)} * big) + {DELTA_SQL} AS sigma FROM (SELECT *, {parts} FROM {text}))"
    text = f"(SELECT *, {BEND_SQL} AS c, {parts} FROM {text})"
    return f"""(SELECT *, lon0 + degrees(lam - {TURN_SQL}) AS lon FROM (
        SELECT *, atan2(sin_s * sin(azimuth), cos(u1) * cos_s - sin(u1) * sin_s * cos(azimuth)) AS lam,
               degrees(atan2(sin(u1) * cos_s + cos(u1) * sin_s * cos(azimuth),
                             {ROUND} * sqrt(sin_a * sin_a + pow(sin(u1) * sin_s - cos(u1) * cos_s * cos(azimuth), 2)))) AS lat FROM {text}))"""


def on_map_sql(view):
    return f"(SELECT * EXCLUDE (x, y), {num(-43.2)} + x / {num(102000)} AS lon, {num(-22.9)} + y / {num(111000)} AS lat FROM ({VIEWS[view]}))"


def framed_sql(view):
    """A planar view's rows with the centre of all points."""
    return f"(SELECT * FROM {on_map_sql(view)}, {ORIGIN_SQL})"


# The planar views over points and intents whose x and y come from longitude and latitude.
ORIGIN_SQL = f"(SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM (SELECT DISTINCT lon, lat FROM {on_map_sql('fx_points')}))"
GEO_VIEWS = VIEWS | {
    "fx_points": f"SELECT layer, feature_id, x, y FROM {forward_sql(framed_sql('fx_points'))}",
    "fx_intents": f"SELECT seq, ts, session_id, kind, x, y FROM {forward_sql(framed_sql('fx_intents'))}",
}


def origin(spark, d):
    return frame.fixed(frame.centroid(fx.geo(spark, d), "lon", "lat"))


@query(
    "aeqd_crs",
    with_views("fx_geo", f"SELECT printf('+proj=aeqd +lat_0=%.6f +lon_0=%.6f +datum=WGS84 +units=m', lat0, lon0) AS crs FROM ({GEO_CENTRE_SQL})"),
)
def aeqd_crs(spark, d):
    at = frame.centroid(fx.geo(spark, d), "lon", "lat")
    return at.select(geodesy.aeqd_definition(c.lon, c.lat, 6).alias("crs"))


@query("aeqd_forward")
def aeqd_forward(spark, d):
    at = origin(spark, d)
    xy = fx.geo(spark, d).select(*ID, geodesy.aeqd_forward(c.lon, c.lat, at.lon, at.lat).alias("p"))
    return xy.select(*ID, r6(F.col("p.x"), "x"), r6(F.col("p.y"), "y"))


@query("aeqd_inverse", with_views("fx_geo", f"SELECT layer, feature_id, {s6('lon', 'lon')}, {s6('lat', 'lat')} FROM fx_geo"))
def aeqd_inverse(spark, d):
    """Points projected and back, which must give the points."""
    at = origin(spark, d)
    xy = fx.geo(spark, d).select(*ID, geodesy.aeqd_forward(c.lon, c.lat, at.lon, at.lat).alias("p"))
    back = xy.select(*ID, geodesy.aeqd_inverse(F.col("p.x"), F.col("p.y"), at.lon, at.lat).alias("g"))
    return back.select(*ID, r6(F.col("g.lon"), "lon"), r6(F.col("g.lat"), "lat"))


def utm_sql():
    n = geodesy.FLATTENING / (2 - geodesy.FLATTENING)
    radius = geodesy.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    skew = num(2 * n**0.5 / (1 + n))
    east = "eta" + "".join(f" + {num(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    north = "xi" + "".join(f" + {num(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    scale = num(geodesy.UTM_SCALE * radius)
    return with_views(
        "fx_geo",
        f"""SELECT layer, feature_id, zone, '+proj=utm +zone=' || zone || ' +south +datum=WGS84 +units=m' AS crs,
                   round({scale} * ({east}) + 500000e0, 3) + 0e0 AS x, round({scale} * ({north}) + 10000000e0, 3) + 0e0 AS y FROM (
              SELECT *, atan2(t, cos(gap)) AS xi, atanh(sin(gap) / sqrt(1 + t * t)) AS eta FROM (
                SELECT *, sinh(atanh(s) - {skew} * atanh({skew} * s)) AS t, radians(lon - (zone * 6 - 183)) AS gap FROM (
                  SELECT *, sin(radians(lat)) AS s, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zone FROM fx_geo)))""",
    )


@query("utm_crs", utm_sql())
def utm_crs(spark, d):
    placed = fx.geo(spark, d).withColumn("zone", geodesy.utm_zone(c.lon, c.lat))
    x, y = geodesy.utm_forward(c.lon, c.lat, c.zone)
    return placed.select(
        *ID, "zone", geodesy.utm_definition(c.zone, c.lat).alias("crs"), (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y")
    )


def written_layers(spark, d):
    """The fixture's points as GeoJSON, one feature per line, in a folder per layer."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    text = F.format_string(
        '{"type": "Feature", "properties": {"id": "%d"}, "geometry": {"type": "Point", "coordinates": [%.6f, %.6f]}}',
        "feature_id",
        "lon",
        "lat",
    )
    geojson.write_features(fx.geo(spark, d).select(F.col("layer").alias("layer_id"), text.alias("feature")), folder)
    return folder


@query("src_points", with_views("fx_geo", f"SELECT layer, feature_id, {s6('lon', 'lon')}, {s6('lat', 'lat')} FROM fx_geo WHERE layer = 'heliport'"))
def src_points(spark, d):
    layer = geojson.read_layer(spark, f"{written_layers(spark, d)}/layer_id=heliport", "heliport", lines=True)
    return layer.select(*ID, r6(c.lon, "lon"), r6(c.lat, "lat"))


@query("src_layers", with_views("fx_geo", f"SELECT layer, feature_id, {s6('lon', 'lon')}, {s6('lat', 'lat')} FROM fx_geo"))
def src_layers(spark, d):
    folder = written_layers(spark, d)
    layers = geojson.read_layer(spark, "layer_id=heliport", "heliport", folder, lines=True).unionByName(
        geojson.read_layer(spark, "layer_id=vertiport", "vertiport", folder, lines=True)
    )
    return layers.select(*ID, r6(c.lon, "lon"), r6(c.lat, "lat"))


@query("sink_scene", f"SELECT layer_id, feature FROM ({SCENE_SQL})")
def sink_scene(spark, d):
    """The planar scene written one feature per line and read back."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    geojson.write_features(planar_scene(spark, d), folder)
    return spark.read.schema("value string, layer_id string").text(folder).select("layer_id", c.value.alias("feature"))


# longitude and latitude end to end


@query(
    "layer_union_utm",
    with_views("fx_geo", f"SELECT layer, feature_id, {s6('lon', 'lon')}, {s6('lat', 'lat')}, 'EPSG:4326' AS crs FROM fx_geo"),
)
def layer_union_utm(spark, d):
    """Heliports in longitude and latitude and vertiports in UTM, some by code and some by definition, become one layer."""
    geo = fx.geo(spark, d).withColumn("zone", geodesy.utm_zone(c.lon, c.lat))
    x, y = geodesy.utm_forward(c.lon, c.lat, c.zone)
    named = F.when(c.feature_id % 2 == 0, F.concat(F.lit("EPSG:327"), c.zone)).otherwise(geodesy.utm_definition(c.zone, c.lat))
    vertiports = geo.where("layer = 'vertiport'").select(*ID, x.alias("lon"), y.alias("lat"), named.alias("crs"))
    heliports = geo.where("layer = 'heliport'").select(*ID, "lon", "lat", F.lit("EPSG:4326").alias("crs"))
    layers = [frame.geographic(layer) for layer in (heliports, vertiports)]
    return frame.union_layers(layers).select(*ID, r6(c.lon, "lon"), r6(c.lat, "lat"), "crs")


@query("src_utm_points", with_views("fx_geo", f"SELECT layer, feature_id, {s6('lon', 'lon')}, {s6('lat', 'lat')} FROM fx_geo WHERE layer = 'heliport'"))
def src_utm_points(spark, d):
    """A layer of UTM coordinates written one feature per line and read with its reference system named."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    x, y = geodesy.utm_forward(c.lon, c.lat, F.lit(23))
    text = F.format_string(
        '{"type": "Feature", "id": "%d", "geometry": {"type": "Point", "coordinates": [%.6f, %.6f]}}', "feature_id", x, y
    )
    heliports = fx.geo(spark, d).where("layer = 'heliport'")
    geojson.write_features(heliports.select(c.layer.alias("layer_id"), text.alias("feature")), folder)
    layer = geojson.read_layer(spark, f"{folder}/layer_id=heliport", "heliport", lines=True, crs="EPSG:32723")
    return layer.select(*ID, r6(c.lon, "lon"), r6(c.lat, "lat"))


@query("intent_cells_lonlat", with_views("intent_at", "SELECT seq, kind, q, r FROM intent_at", views=GEO_VIEWS))
def intent_cells_lonlat(spark, d):
    """Intents by longitude and latitude in the cells of a geographic frame."""
    return fx.GeoSite(spark, d).intents().select("seq", "kind", "q", "r")


def lonlat_sql():
    """Points and routes of the scene in longitude and latitude, as feature text."""
    at = "'[' || printf('%.8f', lon) || ', ' || printf('%.8f', lat) || ']'"
    facts = '"num_cells": %d, "origin_q": %d, "origin_r": %d, "target_q": %d, "target_r": %d'
    spots = f"""(SELECT * FROM (
        SELECT 'vertiports' AS layer_id, {SNAP_X} + cx AS x, {SNAP_Y} + cy AS y FROM placed, centre WHERE layer = 'vertiport'
        UNION ALL SELECT 'heliports', x, y FROM fx_points WHERE layer = 'heliport'), {ORIGIN_SQL})"""
    steps = f"""(SELECT p.path_id, pos, l.n AS steps, aq, ar, bq, br, {STEP_X} AS x, {STEP_Y} AS y, lon0, lat0
        FROM fx_paths p JOIN legs l ON l.path_id = p.path_id, centre, {ORIGIN_SQL})"""
    return with_views(
        "placed fx_points fx_paths legs centre",
        f"""SELECT layer_id, '{{"type": "Feature", "geometry": {{"type": "Point", "coordinates": ' || {at} || '}}, "properties": {{}}}}' AS feature
            FROM {back_sql(spots)}
            UNION ALL
            SELECT 'routes', '{{"type": "Feature", "geometry": {{"type": "LineString", "coordinates": [' || string_agg({at}, ', ' ORDER BY pos)
                   || ']}}, "properties": {{' || printf('{facts}', any_value(steps) + 1, any_value(aq), any_value(ar), any_value(bq), any_value(br)) || '}}}}'
            FROM {back_sql(steps)} GROUP BY path_id""",
        views=GEO_VIEWS,
    )


def read_back(spark, features):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    geojson.write_features(features, folder)
    return spark.read.schema("value string, layer_id string").text(folder).select("layer_id", c.value.alias("feature"))


@query("sink_scene_lonlat", lonlat_sql())
def sink_scene_lonlat(spark, d):
    """The scene of a geographic frame in EPSG:4326, written one feature per line and read back."""
    site = fx.GeoSite(spark, d)
    return read_back(spark, map_scene(site.local(), site.paths(), site.domain, site.size))


@query("publish_plan")
def publish_plan(spark, d):
    """From points in longitude and latitude to the published scene of a knn network."""
    return read_back(spark, plan_points(spark, fx.geo(spark, d), "knn", 2).features)
