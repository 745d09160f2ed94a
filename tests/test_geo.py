"""Geodesics, GeoJSON layers, scene and frame guards."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolattice.catalog import load_all
from aerolattice.functions import geodesy
from aerolattice.operators import frame, scene
from aerolattice.sources import geojson


def test_published_geodesic():
    # Flinders Peak to Buninyong on GRS80/WGS84-like ellipsoid: 54972.271 m, azimuth 306 52 05.37.
    away, azimuth = geodesy.inverse(-37.95103341666667, 144.42486788888888, np.array([-37.65282113888889]), np.array([143.92649552777777]))
    assert away[0] == pytest.approx(54972.271, abs=2e-3)
    assert math.degrees(azimuth[0]) % 360 == pytest.approx(306 + 52 / 60 + 5.37 / 3600, abs=1e-5)


def test_forward_and_back(spark):
    df = spark.createDataFrame([(-43.2 + i / 50, -22.9 + j / 50) for i in range(-10, 11) for j in range(-10, 11)], "lon double, lat double")
    xy = df.select("*", geodesy.aeqd_forward(F.col("lon"), F.col("lat"), -43.2, -22.9).alias("p"))
    back = xy.select("lon", "lat", "p", geodesy.aeqd_inverse(F.col("p.x"), F.col("p.y"), -43.2, -22.9).alias("g")).collect()
    for row in back:
        assert abs(row.lon - row.g.lon) < 1e-8 and abs(row.lat - row.g.lat) < 1e-8
    centre = [r for r in back if r.lon == -43.2 and r.lat == -22.9][0]
    assert (centre.p.x, centre.p.y) == (0.0, 0.0)


def test_utm_zones_and_known_point(spark):
    rows = [(5.0, 60.0), (2.0, 60.0), (8.0, 78.0), (10.0, 78.0), (179.99, 0.0), (-43.2, -22.9), (2.2945, 48.8582)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("zone", geodesy.utm_zone(F.col("lon"), F.col("lat")))
    x, y = geodesy.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    got = df.select("zone", x.alias("x"), y.alias("y")).collect()
    assert [r.zone for r in got] == [32, 31, 31, 33, 60, 23, 31]
    # The Eiffel tower: 31N 448251.8 5411932.7.
    assert got[-1].x == pytest.approx(448251.8, abs=1.0) and got[-1].y == pytest.approx(5411932.7, abs=1.0)


def collection(points):
    return json.dumps(
        {
            "type": "FeatureCollection",
            "features": [
                {"type": "Feature", "properties": {"id": i, "name": "é"}, "geometry": {"type": "Point", "coordinates": [x, y]}}
                for i, (x, y) in enumerate(points)
            ],
        }
    )


def test_read_layers(spark, tmp_path):
    (tmp_path / "h.geojson").write_text(collection([(-43.1, -22.8), (-43.2, -22.9)]))
    layers = geojson.read_layers(spark, "h.geojson", "  ", str(tmp_path))
    rows = layers.orderBy("feature_id").collect()
    assert [(r.layer, r.feature_id, r.lon, r.lat, r.geometry_type) for r in rows] == [
        ("heliport", 0, -43.1, -22.8, "Point"),
        ("heliport", 1, -43.2, -22.9, "Point"),
    ]
    assert rows[0].props["name"] == "é"
    assert geojson.read_layer(spark, str(tmp_path / "none.geojson"), "heliport").isEmpty()


def test_guards(spark):
    good = spark.createDataFrame([("Point",)], "geometry_type string")
    assert frame.require_points(good).count() == 1
    with pytest.raises(Exception, match="expected Point"):
        frame.require_points(spark.createDataFrame([("Polygon",)], "geometry_type string")).collect()
    with pytest.raises(ValueError):
        frame.union_layers([])
    with pytest.raises(Exception, match="without CRS"):
        frame.union_layers([spark.createDataFrame([(None,)], "crs string")]).collect()
    with pytest.raises(ValueError):
        frame.nonempty_layers([good.where("false")])
    with pytest.raises(Exception, match="no points"):
        frame.symmetric_bounds(spark.createDataFrame([], "x double, y double"), 1.0).collect()


def test_centroid_counts_coincident_points_once(spark):
    df = spark.createDataFrame([(0.0, 0.0)] * 5 + [(2.0, 4.0)], "x double, y double")
    row = frame.centroid(df, "x", "y").first()
    assert (row.x, row.y) == (1.0, 2.0)


def test_features_are_valid_json_and_come_back(spark, tmp_path):
    points = spark.createDataFrame([(i, i / 7, -i / 3) for i in range(25)], "feature_id bigint, x double, y double")
    rows = scene.point_features("heliports", points)
    geojson.write_features(rows, str(tmp_path / "scene"))
    back = geojson.read_layer(spark, str(tmp_path / "scene" / "layer_id=heliports"), "heliport", lines=True)
    assert {round(r.lon, 6) for r in back.collect()} == {round(i / 7, 6) for i in range(25)}
    texts = geojson.collections(rows, chunk=10).collect()
    assert sum(len(json.loads(r.geojson)["features"]) for r in texts) == 25


def test_range_circle_radius(spark):
    row = spark.range(1).select(scene.range_circle(F.lit(-43.2), F.lit(-22.9), F.lit(10.0)).alias("ring")).first()
    ring = [(p.lon, p.lat) for p in row.ring]
    assert len(ring) == 65 and ring[0] == pytest.approx(ring[-1])
    for lon, lat in ring:
        a, b = math.radians(lat), math.radians(-22.9)
        h = math.sin((a - b) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon + 43.2) / 2) ** 2
        assert 2 * scene.EARTH_RADIUS_KM * math.asin(math.sqrt(h)) == pytest.approx(10.0)


def feature(coordinates, **more):
    return {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": list(coordinates)}} | more


def test_ids_of_ordinary_layers(spark, tmp_path):
    features = [
        feature((1, 2), properties={"id": "7"}),
        feature((1, 2), id="node/1"),
        feature((1, 2), id=9, properties={"id": "8"}),
        feature((3, 4)),
        feature((5, 6)),
        feature((3, 4), properties={"name": "x"}),
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    ids = [r.feature_id for r in geojson.read_layer(spark, str(tmp_path / "a.geojson"), "heliport").collect()]
    assert ids[0] == 7 and ids[2] == 9 and None not in ids and len(set(ids)) == 6
    again = [r.feature_id for r in geojson.read_layer(spark, str(tmp_path / "a.geojson"), "vertiport").collect()]
    assert again == ids


@pytest.mark.parametrize("name, fine", [("urn:ogc:def:crs:OGC:1.3:CRS84", True), ("EPSG:4326", True), ("urn:ogc:def:crs:EPSG::4326", True), ("EPSG:3857", False)])
def test_declared_reference_system(spark, tmp_path, name, fine):
    crs = {"type": "name", "properties": {"name": name}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": crs, "features": [feature((1, 2))]}))
    layer = geojson.read_layer(spark, str(tmp_path / "a.geojson"), "heliport").select("lon", "lat")
    if fine:
        assert [tuple(r) for r in layer.collect()] == [(1.0, 2.0)]
    else:
        with pytest.raises(Exception, match="longitude and latitude"):
            layer.collect()


def test_range_points_are_the_rings_rows_from_many_tasks(spark):
    """Points of a single split are dealt out before each makes its ring's rows, and no lambda makes them."""
    rows = [("droneport", 1, -43.2, -22.9), ("heliport", 2, 179.99, 60.0), ("heliport", 2, 0.0, -89.99), ("droneport", None, None, 1.0), ("other", 4, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "kind string, feature_id int, lon double, lat double").coalesce(1)
    whole = scene.operating_ranges(points).select("kind", "feature_id", "radius_km", F.posexplode("ring").alias("pos", "p"))
    found = scene.operating_range_points(points)
    assert found.count() == whole.count() == len(rows) * (scene.RANGE_STEPS + 1)
    assert found.exceptAll(whole).isEmpty() and found.columns == whole.columns
    plan = load_all()[0]["range_circles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Repartition" in plan
