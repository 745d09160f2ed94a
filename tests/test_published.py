"""Reference systems both ways, and the run from files to a scene on the map."""

import json

import pytest
from pyspark.sql import functions as F

from aerolattice.functions import geodesy
from aerolattice.operators import frame
from aerolattice.plans.published import publish
from aerolattice.sources import geojson


def test_utm_and_back(spark):
    rows = [(lon + zone * 6 - 183.0, lat, zone) for zone in (1, 23, 31, 60) for lon in (-2.9, 0.0, 1.3) for lat in (-79.0, -22.9, -0.001, 0.0, 48.8, 83.0)]
    df = spark.createDataFrame(rows, "lon double, lat double, zone int")
    x, y = geodesy.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    back = geodesy.utm_inverse(F.col("x"), F.col("y"), F.col("zone"), F.col("lat") < 0)
    for r in df.withColumns({"x": x, "y": y}).select("*", back[0].alias("lon2"), back[1].alias("lat2")).collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9


def test_systems_are_chosen_row_by_row(spark):
    rows = [
        (-43.2, -22.9, "EPSG:4326"),
        (448251.8, 5411932.7, "urn:ogc:def:crs:EPSG::32631"),
        (448251.8, 5411932.7, "+proj=utm +zone=31 +datum=WGS84 +units=m"),
        (500000.0, 10000000.0, "+proj=utm +zone=23 +south +datum=WGS84 +units=m"),
        (None, None, "EPSG:32723"),
    ]
    got = frame.geographic(spark.createDataFrame(rows, "lon double, lat double, crs string")).collect()
    assert (got[0].lon, got[0].lat) == (-43.2, -22.9) and (got[4].lon, got[4].lat) == (None, None)
    for r in got[1:3]:  # the Eiffel tower
        assert abs(r.lon - 2.2945) < 2e-5 and abs(r.lat - 48.8582) < 2e-5
    assert abs(got[3].lon + 45) < 1e-9 and abs(got[3].lat) < 1e-9
    assert {r.crs for r in got} == {"EPSG:4326"}


@pytest.mark.parametrize("name", ["EPSG:31983", "EPSG:32761", "EPSG:132631", "+proj=utm +zone=23 +ellps=intl +units=m", "+proj=utm +zone=23 +datum=WGS84 +units=us-ft", None])
def test_other_systems_are_errors(spark, name):
    layer = spark.createDataFrame([(1.0, 2.0, name)], "lon double, lat double, crs string")
    with pytest.raises(Exception, match="neither longitude and latitude nor UTM"):
        frame.geographic(layer).collect()


def test_lines_keep_their_cuts(spark):
    rows = [(1, [(0.0, 0.0), (1000.0, 0.0)]), (2, None), (3, []), (4, [(0.0, -500.0)]), (5, [(None, 1.0)])]
    lines = spark.createDataFrame(rows, "id int, line array<struct<x:double,y:double>>").coalesce(1)
    got = {r.id: r.g for r in lines.select("id", geodesy.aeqd_inverse_lines(F.col("line"), -43.2, -22.9).alias("g")).collect()}
    assert got[2] is None and got[3] == [] and got[5][0].lon is None
    assert (got[1][0].lon, got[1][0].lat) == pytest.approx((-43.2, -22.9), abs=1e-12)
    away, azimuth = geodesy.inverse(-22.9, -43.2, [got[1][1].lat, got[4][0].lat], [got[1][1].lon, got[4][0].lon])
    assert away == pytest.approx([1000.0, 500.0], abs=1e-6)
    assert azimuth == pytest.approx([1.5707963, 3.1415927], abs=1e-6)


def test_from_files_to_the_map(spark, tmp_path):
    """One layer in degrees and one in UTM: heliports keep their place within a millimetre, routes join vertiport cells."""
    spots = [(-43.20, -22.90), (-43.15, -22.88), (-43.22, -22.93), (-43.17, -22.95)]
    ports = [(-43.18, -22.91), (-43.10, -22.90)]
    df = spark.createDataFrame(spots, "lon double, lat double")
    x, y = geodesy.utm_forward(F.col("lon"), F.col("lat"), F.lit(23))
    metres = [tuple(r) for r in df.select(x, y).collect()]

    def written(name, points, crs):
        features = [{"type": "Feature", "id": i, "properties": {}, "geometry": {"type": "Point", "coordinates": p}} for i, p in enumerate(points)]
        text = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": crs}}, "features": features}
        (tmp_path / name).write_text(json.dumps(text))

    written("h.geojson", ports, "urn:ogc:def:crs:OGC:1.3:CRS84")
    written("v.geojson", metres, "urn:ogc:def:crs:EPSG::32723")
    made = publish(spark, "h.geojson", "v.geojson", str(tmp_path / "out"), str(tmp_path), mode="Single-Linkage_HAC")
    back = geojson.read_layer(spark, str(tmp_path / "out" / "layer_id=heliports"), "heliport", lines=True).collect()
    assert sorted((round(r.lon, 7), round(r.lat, 7)) for r in back) == sorted(ports)
    assert made.domain.crs.startswith("+proj=aeqd +lat_0=-22.9")
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "layer_id=routes")).collect()]
    snapped = {(round(r.lon, 6), round(r.lat, 6)) for r in geojson.read_layer(spark, str(tmp_path / "out" / "layer_id=vertiports"), "v", lines=True).collect()}
    assert len(rows) == 3 and len(snapped) == 4
    for row in rows:
        line = row["geometry"]["coordinates"]
        assert len(line) == row["properties"]["num_cells"]
        assert {tuple(round(v, 6) for v in line[0]), tuple(round(v, 6) for v in line[-1])} <= snapped
        for a, b in zip(line, line[1:]):  # neighbouring cells of 500 m hexagons
            away, _ = geodesy.inverse(a[1], a[0], [b[1]], [b[0]])
            assert away[0] == pytest.approx(500 * 3**0.5, abs=0.1)


def test_a_run_without_points_says_so(spark, tmp_path):
    with pytest.raises(ValueError, match="no layer holds any point"):
        publish(spark, "none.geojson", "", str(tmp_path / "out"), str(tmp_path))
