"""From layers in files to a published scene in longitude and latitude: the whole planning run as one composition."""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolattice.functions.hexmath import CELL_SIZE, MARGIN, PADDING
from aerolattice.operators import frame, grid, scene, sites
from aerolattice.plans.routes import RoutePlan, plan_routes
from aerolattice.runtime import pinned
from aerolattice.sources import geojson


@dataclass
class PublishedPlan:
    """Domain, cells (q, r, cost, restricted), placed points, routes and feature rows of a run."""

    domain: SimpleNamespace
    cells: DataFrame
    placed: DataFrame
    routes: RoutePlan
    features: DataFrame


def map_scene(points: DataFrame, paths: DataFrame, domain: SimpleNamespace, size: float = CELL_SIZE) -> DataFrame:
    """Feature rows in EPSG:4326 of local points (layer, feature_id, x, y) and of paths (path_id, cells)."""
    vertiports = scene.vertiport_layer(points.where("layer = 'vertiport'"), domain, size)
    heliports = scene.heliport_layer(points.where("layer = 'heliport'"), domain)
    routes = scene.route_layer(paths, domain, size)
    return scene.scene(
        [
            scene.point_features("vertiports", scene.points_on_map(vertiports, domain), digits=8),
            scene.point_features("heliports", scene.points_on_map(heliports, domain), digits=8),
            scene.route_features(scene.routes_on_map(routes, domain), digits=8),
        ]
    )


def plan_points(
    spark: SparkSession,
    points: DataFrame,
    mode: str = "knn",
    k: int = 2,
    size: float = CELL_SIZE,
    padding: float = PADDING,
    margin: float = MARGIN,
) -> PublishedPlan:
    """Plan over points(layer, feature_id, lon, lat): frame, grid, restrictions by heliports, routes, scene.

    Vertiports in the cell of a heliport are no terminals; they stay in the scene. Eight digits of a degree are about a
    millimetre.
    """
    metric, domain = frame.geographic_domain(points.select("layer", "feature_id", "lon", "lat"), padding, margin)
    local = pinned(frame.to_local(metric, domain))
    placed = pinned(grid.cells_of_points(local, domain, size))
    heliports = placed.where("layer = 'heliport'")
    blank = grid.domain_cells(spark, domain, size).select("q", "r", F.lit(1.0).alias("cost"), F.lit(False).alias("restricted"))
    cells = pinned(sites.apply_restrictions(blank, sites.restricted_cells(heliports).withColumn("change", F.lit("added"))))
    terminals = sites.without_conflicts(placed.where("layer = 'vertiport'"), heliports).select("feature_id", "q", "r")
    routes = plan_routes(cells, terminals, mode, k)
    return PublishedPlan(domain, cells, placed, routes, map_scene(local, routes.paths, domain, size))


def publish(
    spark: SparkSession, heliports: str | None, vertiports: str | None, out: str, base: str | None = None, **settings
) -> PublishedPlan:
    """Read both layers (longitude and latitude or UTM), plan with `settings` of `plan_points`, write the scene under `out`."""
    layers = frame.nonempty_layers(
        [geojson.read_layer(spark, heliports, "heliport", base), geojson.read_layer(spark, vertiports, "vertiport", base)]
    )
    made = plan_points(spark, pinned(frame.require_points(frame.union_layers(layers))), **settings)
    geojson.write_features(made.features, out)
    return made
