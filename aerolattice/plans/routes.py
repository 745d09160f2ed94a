"""From sites to routes: the planning run as one composition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from aerolattice.operators import graph, pairs, routing, sites
from aerolattice.runtime import pinned


@dataclass
class RoutePlan:
    """Tables of a planned network."""

    vertices: DataFrame
    edges: DataFrame
    paths: DataFrame
    route_vertices: DataFrame
    route_edges: DataFrame
    terminal_edges: DataFrame


def interconnect(terminals: DataFrame, vertices: DataFrame, mode: str, k: int = 2) -> DataFrame:
    """Paths (path_id, cells, cost) between the terminal pairs of a mode that have one."""
    return routing.as_paths(routing.shortest_paths(pairs.build_pairs(terminals, mode, k), vertices))


def plan_routes(cells: DataFrame, terminals: DataFrame, mode: str, k: int = 2) -> RoutePlan:
    """G0 from traversable cells, paths of the mode, and the graphs G1 and G2 made of them."""
    vertices = pinned(sites.traversable(cells).select("q", "r", "cost"))
    paths = pinned(interconnect(terminals, vertices, mode, k))
    return RoutePlan(
        vertices=vertices,
        edges=graph.weighted_edges(graph.g0_edges(vertices)),
        paths=paths,
        route_vertices=graph.g1_vertices(paths),
        route_edges=graph.g1_edges(paths),
        terminal_edges=graph.g2_edges(paths),
    )
