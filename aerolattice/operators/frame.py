"""Domain frame: layer union, centre, local coordinates and bounds.

The frame is one row of a dozen numbers. `fixed` reads it once, and its values then enter other plans as literals:
nothing is joined to reach them and Catalyst can fold them into filters.
"""

from __future__ import annotations

from collections.abc import Sequence
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolattice.functions import geodesy

BOUND_NAMES = ["min_x", "max_x", "min_y", "max_y"]


def fixed(frame: DataFrame) -> SimpleNamespace:
    """The values of a one-row frame, to be used as literals."""
    row = frame.first()
    if row is None:
        raise ValueError("empty frame")
    return SimpleNamespace(**row.asDict())


def union_layers(layers: Sequence[DataFrame]) -> DataFrame:
    """Concatenate layers already in WGS84; every row must name its CRS."""
    if not layers:
        raise ValueError("at least one layer is required")
    joined = layers[0]
    for layer in layers[1:]:
        joined = joined.unionByName(layer)
    known = F.when(F.col("crs").isNull(), F.raise_error(F.lit("layer without CRS"))).otherwise(F.col("crs"))
    return joined.withColumn("crs", known)


def geographic(layer: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Coordinates `x`, `y` in longitude and latitude, whatever system the row's `crs` names: UTM is converted."""
    lon, lat = geodesy.to_wgs84(F.col(x), F.col(y), F.col("crs"))
    return layer.withColumns({x: lon, y: lat, "crs": F.lit("EPSG:4326")})


def geographic_domain(points: DataFrame, padding: float, margin: float) -> tuple[DataFrame, SimpleNamespace]:
    """Points with metric `x`, `y` around the centre of their positions, and the domain: centres, bounds and CRS.

    The frame is azimuthal equidistant about the mean of the distinct positions (`lon0`, `lat0`); `x`, `y` of the domain is
    the mean of the projected points, as in `build_domain`.
    """
    at = fixed(centroid(points, "lon", "lat"))
    if at.lon is None:
        raise ValueError("no points provided")
    place = geodesy.aeqd_forward(F.col("lon"), F.col("lat"), at.lon, at.lat)
    metric = points.withColumn("_place", place).withColumns({"x": F.col("_place.x"), "y": F.col("_place.y")}).drop("_place")
    domain = fixed(build_domain(metric, padding, margin))
    crs = f"+proj=aeqd +lat_0={at.lat!r} +lon_0={at.lon!r} +datum=WGS84 +units=m"
    return metric, SimpleNamespace(**vars(domain), lon0=at.lon, lat0=at.lat, crs=crs)


def positions(points: DataFrame, domain: SimpleNamespace) -> DataFrame:
    """Add local `x`, `y` to points in longitude and latitude, such as where a user clicks on a map."""
    place = geodesy.aeqd_forward(F.col("lon"), F.col("lat"), domain.lon0, domain.lat0)
    metric = points.withColumn("_place", place).withColumns({"x": F.col("_place.x"), "y": F.col("_place.y")})
    return to_local(metric.drop("_place"), domain)


def nonempty_layers(layers: Sequence[DataFrame]) -> list[DataFrame]:
    """Drop layers without rows; `isEmpty` stops at the first row it meets."""
    kept = [layer for layer in layers if not layer.isEmpty()]
    if not kept:
        raise ValueError("no layer holds any point")
    return kept


def require_points(features: DataFrame, kind: str = "geometry_type") -> DataFrame:
    checked = F.when(F.col(kind) == "Point", F.col(kind)).otherwise(
        F.raise_error(F.concat(F.lit("expected Point geometry, got "), F.coalesce(F.col(kind), F.lit("null"))))
    )
    return features.withColumn(kind, checked)


def centroid(points: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of the distinct positions: coincident points count once, as in a geometric union."""
    return points.select(x, y).distinct().agg(F.avg(x).alias(x), F.avg(y).alias(y))


def to_local(points: DataFrame, centre: SimpleNamespace) -> DataFrame:
    return points.withColumns({"x": F.col("x") - centre.x, "y": F.col("y") - centre.y})


def from_local(points: DataFrame, centre: SimpleNamespace) -> DataFrame:
    return points.withColumns({"x": F.col("x") + centre.x, "y": F.col("y") + centre.y})


def expand(bounds: DataFrame, margin: float) -> DataFrame:
    return bounds.select(
        (F.col("min_x") - margin).alias("min_x"),
        (F.col("max_x") + margin).alias("max_x"),
        (F.col("min_y") - margin).alias("min_y"),
        (F.col("max_y") + margin).alias("max_y"),
    )


def raw_bounds(points: DataFrame) -> DataFrame:
    return points.agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )


def bounds_pair(points: DataFrame, padding: float, margin: float) -> DataFrame:
    """Operational and visualization bounds; both grow from the raw bounds, not one from the other."""
    return raw_bounds(points).select(*_padded("op", padding), *_padded("vis", margin))


def _padded(prefix: str, by: float) -> list[Column]:
    return [
        (F.col("min_x") - by).alias(f"{prefix}_min_x"),
        (F.col("max_x") + by).alias(f"{prefix}_max_x"),
        (F.col("min_y") - by).alias(f"{prefix}_min_y"),
        (F.col("max_y") + by).alias(f"{prefix}_max_y"),
    ]


def symmetric_bounds(points: DataFrame, padding: float) -> DataFrame:
    reach = points.agg(F.max(F.abs("x")).alias("ax"), F.max(F.abs("y")).alias("ay"))
    empty = F.raise_error(F.lit("no points provided"))
    ax = F.when(F.col("ax").isNull(), empty).otherwise(F.col("ax") + padding)
    ay = F.when(F.col("ay").isNull(), empty).otherwise(F.col("ay") + padding)
    return reach.select((-ax).alias("min_x"), ax.alias("max_x"), (-ay).alias("min_y"), ay.alias("max_y"))


def corners(bounds: DataFrame) -> DataFrame:
    """Four corners, clockwise from the top left."""
    b = {n: F.col(n) for n in BOUND_NAMES}
    order = [("min_x", "max_y"), ("max_x", "max_y"), ("max_x", "min_y"), ("min_x", "min_y")]
    points = F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in order])
    return bounds.select(F.posexplode(points).alias("corner", "p")).select("corner", "p.x", "p.y")


def within(domain: SimpleNamespace, x: Column, y: Column) -> Column:
    """Inclusive containment in the operational bounds."""
    return x.between(domain.op_min_x, domain.op_max_x) & y.between(domain.op_min_y, domain.op_max_y)


def build_domain(points: DataFrame, padding: float, margin: float) -> DataFrame:
    """Centre and both bounds in one pass over the distinct metric points.

    Subtracting the centre is monotone in floating point, so the extremes of the local points are the
    extremes of the metric points minus the centre and no second pass is needed.
    """
    spread = (
        points.select("x", "y")
        .distinct()
        .agg(
            F.avg("x").alias("x"),
            F.avg("y").alias("y"),
            F.min("x").alias("lo_x"),
            F.max("x").alias("hi_x"),
            F.min("y").alias("lo_y"),
            F.max("y").alias("hi_y"),
        )
    )
    local = spread.select(
        "x",
        "y",
        (F.col("lo_x") - F.col("x")).alias("min_x"),
        (F.col("hi_x") - F.col("x")).alias("max_x"),
        (F.col("lo_y") - F.col("y")).alias("min_y"),
        (F.col("hi_y") - F.col("y")).alias("max_y"),
    )
    return local.select("x", "y", *_padded("op", padding), *_padded("vis", margin))
