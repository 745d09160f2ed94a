"""Map layers as feature rows and their GeoJSON text."""

from __future__ import annotations

from collections.abc import Sequence
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolattice.functions import geodesy
from aerolattice.functions import hexmath as hx
from aerolattice.operators.frame import from_local
from aerolattice.operators.grid import cells_of_points
from aerolattice.runtime import shuffle_width

# Fixed values of the map view.
OPERATING_RANGE_KM = {"droneport": 10.0, "heliport": 2 * 1.852}
RANGE_STEPS = 64
EARTH_RADIUS_KM = 6371.0088
LAYER_TYPES = {"vertiports": "droneport", "heliports": "heliport"}


def vertiport_layer(points: DataFrame, domain: SimpleNamespace, size: float) -> DataFrame:
    """Vertiports moved to their cell centre, in domain coordinates; those off the grid are left out."""
    at = cells_of_points(points, domain, size)
    x, y = hx.centre(F.col("q"), F.col("r"), size)
    return from_local(at.select("feature_id", x.alias("x"), y.alias("y")), domain)


def heliport_layer(points: DataFrame, domain: SimpleNamespace) -> DataFrame:
    return from_local(points.select("feature_id", "x", "y"), domain)


def route_layer(paths: DataFrame, domain: SimpleNamespace, size: float) -> DataFrame:
    """One line per path of two or more cells, with its ends and its points in domain coordinates."""
    origin, target = F.element_at("cells", 1), F.element_at("cells", -1)

    def at(cell: Column) -> Column:
        x, y = hx.centre(cell.q, cell.r, size)
        return F.struct((x + domain.x).alias("x"), (y + domain.y).alias("y"))

    return paths.where(F.size("cells") >= 2).select(
        F.col("path_id").alias("route_id"),
        F.size("cells").alias("num_cells"),
        origin.q.alias("origin_q"),
        origin.r.alias("origin_r"),
        target.q.alias("target_q"),
        target.r.alias("target_r"),
        F.transform("cells", at).alias("line"),
    )


def points_on_map(points: DataFrame, domain: SimpleNamespace) -> DataFrame:
    """A point layer in domain coordinates with `x`, `y` as longitude and latitude (EPSG:4326)."""
    place = geodesy.aeqd_inverse(F.col("x"), F.col("y"), domain.lon0, domain.lat0)
    return points.withColumn("_place", place).withColumns({"x": F.col("_place.lon"), "y": F.col("_place.lat")}).drop("_place")


def routes_on_map(routes: DataFrame, domain: SimpleNamespace) -> DataFrame:
    """A route layer in domain coordinates with its lines in longitude and latitude (EPSG:4326)."""
    line = geodesy.aeqd_inverse_lines(F.col("line"), domain.lon0, domain.lat0)
    named = F.transform("line", lambda p: F.struct(p.lon.alias("x"), p.lat.alias("y")))
    return routes.withColumn("line", line).withColumn("line", named)


def _pair_text(x: Column, y: Column, digits: int) -> Column:
    return F.format_string(f"[%.{digits}f, %.{digits}f]", x, y)


def point_features(layer: str, points: DataFrame, x: str = "x", y: str = "y", digits: int = 6) -> DataFrame:
    """Rows (layer_id, geometry_type, feature_id, feature): GeoJSON text of one feature each."""
    text = F.concat(
        F.lit('{"type": "Feature", "geometry": {"type": "Point", "coordinates": '),
        _pair_text(F.col(x), F.col(y), digits),
        F.lit('}, "properties": {}}'),
    )
    return points.select(
        F.lit(layer).alias("layer_id"),
        F.lit("Point").alias("geometry_type"),
        F.col("feature_id").cast("string").alias("feature_id"),
        text.alias("feature"),
    )


def route_features(routes: DataFrame, digits: int = 6) -> DataFrame:
    line = F.array_join(F.transform("line", lambda p: _pair_text(p.x, p.y, digits)), ", ")
    facts = F.format_string(
        '"num_cells": %d, "origin_q": %d, "origin_r": %d, "target_q": %d, "target_r": %d',
        "num_cells",
        "origin_q",
        "origin_r",
        "target_q",
        "target_r",
    )
    text = F.concat(
        F.lit('{"type": "Feature", "geometry": {"type": "LineString", "coordinates": ['),
        line,
        F.lit(']}, "properties": {'),
        facts,
        F.lit("}}"),
    )
    return routes.select(
        F.lit("routes").alias("layer_id"),
        F.lit("LineString").alias("geometry_type"),
        F.col("route_id").cast("string").alias("feature_id"),
        text.alias("feature"),
    )


def scene(layers: Sequence[DataFrame]) -> DataFrame:
    """All feature rows of the layers that are present."""
    if not layers:
        raise ValueError("a scene needs at least one layer")
    joined = layers[0]
    for layer in layers[1:]:
        joined = joined.unionByName(layer)
    return joined


def infrastructure(scene_rows: DataFrame, visible: Sequence[str] = ("vertiports", "heliports")) -> DataFrame:
    """Point features of the visible layers, tagged with what they show."""
    tag = F.create_map(*[F.lit(v) for pair in LAYER_TYPES.items() for v in pair])
    rows = scene_rows.where(F.col("layer_id").isin(list(visible)) & (F.col("geometry_type") == "Point"))
    return rows.withColumn("kind", tag[F.col("layer_id")])


def range_circle(lon: Column, lat: Column, radius_km: Column, steps: int = RANGE_STEPS) -> Column:
    """Closed ring of points at a great-circle distance, counter-clockwise from north."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: range_point(lon, lat, radius_km, i, steps))


def range_point(lon: Column, lat: Column, radius_km: Column, i: Column, steps: int = RANGE_STEPS) -> Column:
    """Point `i` of the ring."""
    angle = radius_km / EARTH_RADIUS_KM
    lat0, lon0 = F.radians(lat), F.radians(lon)
    bearing = F.radians(-(i % steps) * F.lit(360.0) / steps)
    lat1 = F.asin(F.sin(lat0) * F.cos(angle) + F.cos(lat0) * F.sin(angle) * F.cos(bearing))
    lon1 = lon0 + F.atan2(F.sin(bearing) * F.sin(angle) * F.cos(lat0), F.cos(angle) - F.sin(lat0) * F.sin(lat1))
    return F.struct(F.degrees(lon1).alias("lon"), F.degrees(lat1).alias("lat"))


def _range_km() -> Column:
    return F.create_map(*[F.lit(v) for pair in OPERATING_RANGE_KM.items() for v in pair])[F.col("kind")]


def operating_ranges(points: DataFrame) -> DataFrame:
    """Range polygon of every point of `points(kind, feature_id, lon, lat)`."""
    ring = range_circle(F.col("lon"), F.col("lat"), _range_km())
    return points.select("kind", "feature_id", _range_km().alias("radius_km"), ring.alias("ring"))


def operating_range_points(points: DataFrame) -> DataFrame:
    """The rings of `operating_ranges` as rows (kind, feature_id, radius_km, pos, p), in compiled code instead of a lambda.

    Points are dealt out first, since each makes many rows and a file of points may be a single split.
    """
    dealt = points.select("kind", "feature_id", _range_km().alias("radius_km"), "lon", "lat").repartition(shuffle_width(points.sparkSession))
    rows = dealt.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(RANGE_STEPS))))
    return rows.select("kind", "feature_id", "radius_km", "pos", range_point(F.col("lon"), F.col("lat"), F.col("radius_km"), F.col("pos")).alias("p"))
