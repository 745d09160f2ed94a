"""Graph tables: airspace graph G0, route graph G1 and terminal graph G2.

Cells are their own keys, so no vertex ids are made unless asked for. Paths are rows
(path_id, cells ARRAY<STRUCT<q, r>>); stepping along one needs no shuffle because the array is already ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolattice.functions import hexmath as hx
from aerolattice.operators.sites import traversable

STEP_WEIGHT = 1.0

# The directions that lead to a cell later in (q, r) order, so each edge is met once.
FORWARD = [(1, 0), (1, -1), (0, 1)]


def forward_literal() -> Column:
    return F.array(*[F.struct(F.lit(q).alias("q"), F.lit(r).alias("r")) for q, r in FORWARD])


def g0_vertices(cells: DataFrame) -> DataFrame:
    return traversable(cells)


def vertex_ids(vertices: DataFrame) -> DataFrame:
    """Dense ids in (q, r) order: a running count over grid columns plus the place within the column."""
    per_column = vertices.groupBy("q").agg(F.count("*").alias("n"))
    before = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_column.select("q", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("r")) - 1
    return vertices.withColumn("place", place).join(offset, "q").withColumn("vid", F.col("offset") + F.col("place")).drop("offset", "place")


def g0_edges(vertices: DataFrame) -> DataFrame:
    """Undirected adjacency of traversable cells, each edge once with both ends' costs."""
    ahead = vertices.select("q", "r", "cost", F.explode(forward_literal()).alias("d")).select(
        "q", "r", "cost", (F.col("q") + F.col("d.q")).alias("nq"), (F.col("r") + F.col("d.r")).alias("nr")
    )
    other = vertices.select(F.col("q").alias("nq"), F.col("r").alias("nr"), F.col("cost").alias("ncost"))
    return ahead.join(other, ["nq", "nr"])


def edge_weight(cost_a: Column, cost_b: Column) -> Column:
    return F.lit(STEP_WEIGHT) + F.lit(0.5) * (cost_a + cost_b)


def weighted_edges(edges: DataFrame) -> DataFrame:
    return edges.select("q", "r", "nq", "nr", edge_weight(F.col("cost"), F.col("ncost")).alias("weight"))


def path_steps(paths: DataFrame) -> DataFrame:
    return paths.select("path_id", F.posexplode("cells").alias("pos", "c")).select("path_id", "pos", "c.q", "c.r")


def path_hops(paths: DataFrame) -> DataFrame:
    """Consecutive cells of every path."""
    after = F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))
    hop = F.posexplode(after).alias("pos", "b")
    return paths.select("path_id", "cells", hop).select(
        "path_id",
        "pos",
        F.col("cells")[F.col("pos")].q.alias("aq"),
        F.col("cells")[F.col("pos")].r.alias("ar"),
        F.col("b.q").alias("bq"),
        F.col("b.r").alias("br"),
    )


def path_weights(paths: DataFrame, cells: DataFrame) -> DataFrame:
    """Sum of edge weights along each path: an inner cell's cost counts fully, an end's by half."""
    n = F.size("cells")
    step = paths.select("path_id", n.alias("n"), F.posexplode("cells").alias("pos", "c")).select(
        "path_id", "n", "pos", "c.q", "c.r"
    )
    is_end = (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)
    share = F.when(F.col("n") == 1, F.lit(0.0)).when(is_end, F.col("cost") * 0.5).otherwise(F.col("cost"))
    return (
        step.join(cells.select("q", "r", "cost"), ["q", "r"])
        .groupBy("path_id")
        .agg((F.sum(share) + (F.max("n") - 1) * STEP_WEIGHT).alias("weight"))
    )


def g1_edges(paths: DataFrame) -> DataFrame:
    """Distinct undirected edges over all paths."""
    a, b = F.struct(F.col("aq").alias("q"), F.col("ar").alias("r")), F.struct(F.col("bq").alias("q"), F.col("br").alias("r"))
    ends = path_hops(paths).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ends.select(
        F.col("a.q").alias("aq"), F.col("a.r").alias("ar"), F.col("b.q").alias("bq"), F.col("b.r").alias("br")
    ).distinct()


def path_ends(paths: DataFrame) -> DataFrame:
    first, last = F.element_at("cells", 1), F.element_at("cells", -1)
    return paths.select(
        "path_id",
        first.q.alias("origin_q"),
        first.r.alias("origin_r"),
        last.q.alias("target_q"),
        last.r.alias("target_r"),
        F.size("cells").alias("num_cells"),
    )


def terminal_cells(paths: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.element_at("cells", 1), F.element_at("cells", -1))).alias("c")
    return paths.select(ends).select("c.q", "c.r").distinct()


def g1_vertices(paths: DataFrame) -> DataFrame:
    """Cells on an edge with a flag for path ends. A path of one cell adds nothing.

    One grouped pass: every step of a longer path is on an edge, and the flag is an aggregate over both kinds of row.
    """
    on_edge = F.size("cells") > 1
    step = paths.select(on_edge.alias("on_edge"), F.size("cells").alias("n"), F.posexplode("cells").alias("pos", "c"))
    is_end = (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)
    return (
        step.select("c.q", "c.r", "on_edge", is_end.alias("is_end"))
        .groupBy("q", "r")
        .agg(F.max("on_edge").alias("on_edge"), F.max("is_end").alias("is_terminal"))
        .where("on_edge")
        .drop("on_edge")
    )


def g2_edges(paths: DataFrame) -> DataFrame:
    """One edge per path; parallel edges and loops stay."""
    return path_ends(paths)


def graph_counts(vertices: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    counted = vertices.select(F.lit(1).alias("v"), F.lit(0).alias("e")).unionAll(
        edges.select(F.lit(0).alias("v"), F.lit(1).alias("e"))
    )
    return counted.agg(
        F.lit(name).alias("graph"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("vcount"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("ecount"),
    )


def cell_load(paths: DataFrame) -> DataFrame:
    """Number of paths through each cell."""
    return path_steps(paths).groupBy("q", "r").agg(F.count("*").alias("paths"))


def average_path_length(paths: DataFrame) -> DataFrame:
    """Mean number of hops, and 0.0 when no path has an edge."""
    return paths.agg(F.coalesce(F.avg(F.size("cells") - 1), F.lit(0.0)).alias("avg_path_length"))


def cells_on_routes(cells: DataFrame, paths: DataFrame) -> DataFrame:
    return cells.join(path_steps(paths).select("q", "r").distinct(), ["q", "r"], "left_semi")


def affected_paths(paths: DataFrame, changed: DataFrame) -> DataFrame:
    """Paths that cross a changed cell."""
    hit = path_steps(paths).join(changed.select("q", "r").distinct(), ["q", "r"], "left_semi")
    return hit.select("path_id").distinct()


def cell_key(prefix: str = "") -> Column:
    return hx.pack(F.col(f"{prefix}q"), F.col(f"{prefix}r"))
