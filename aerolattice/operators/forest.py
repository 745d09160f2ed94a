"""Minimum spanning forest and connected components by rounds of contraction.

Each round every component picks its smallest outgoing edge in one grouped aggregation, the picked edges are
followed to a root by pointer doubling, and the remaining edges are renamed to roots and thinned to one per
component pair. The edge table at least halves its components per round, so rounds grow with log n.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolattice.runtime import pinned, release


def to_roots(parents: DataFrame) -> DataFrame:
    """Follow `p` from every `c` until it no longer moves; three doublings per written table."""
    old = None
    while True:
        jumped = parents.select("c", "p")
        for _ in range(2):
            jumped = _jump(jumped, jumped)
        parents = pinned(_jump(parents.select("c", "p"), jumped))
        release(*[old] if old else [])
        old = parents
        if parents.join(parents.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p").where("pp <> p").isEmpty():
            return parents


def _jump(pointers: DataFrame, ahead: DataFrame) -> DataFrame:
    nxt = ahead.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    return pointers.join(nxt, "p", "left").select("c", F.coalesce("pp", "p").alias("p"))


def minimum_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forest of `edges(u, v, w, cu, cv)` under the total order (w, u, v), and root of each start component.

    `u < v` name the edge; `cu`, `cv` are the components its ends start in (the ends themselves, or labels that
    are to be joined further). Returns (forest(u, v, w), roots(c, root)).
    """
    live = given = pinned(edges.where("cu <> cv").select("u", "v", "w", "cu", "cv"))
    start = live.select(F.explode(F.array("cu", "cv")).alias("c")).distinct()
    forest: list[DataFrame] = []
    hops: list[DataFrame] = []
    while not live.isEmpty():
        edge = F.struct("w", "u", "v")
        outgoing = live.select(F.col("cu").alias("c"), edge.alias("e"), F.col("cv").alias("o")).unionAll(
            live.select(F.col("cv").alias("c"), edge.alias("e"), F.col("cu").alias("o"))
        )
        picked = pinned(outgoing.groupBy("c").agg(F.min(F.struct("e", "o")).alias("m")).select("c", "m.e", "m.o"))
        forest.append(picked.select("e.u", "e.v", "e.w").distinct())
        back = picked.select(F.col("c").alias("o"), F.col("o").alias("oo"))
        mutual = (F.col("oo") == F.col("c")) & (F.col("c") < F.col("o"))
        parents = picked.select("c", "o").join(back, "o").select("c", F.when(mutual, F.col("c")).otherwise(F.col("o")).alias("p"))
        roots = to_roots(parents)
        hops.append(roots)
        renamed = (
            live.join(roots.select(F.col("c").alias("cu"), F.col("p").alias("ru")), "cu")
            .join(roots.select(F.col("c").alias("cv"), F.col("p").alias("rv")), "cv")
            .where("ru <> rv")
        )
        thinned = renamed.groupBy(F.least("ru", "rv").alias("cu"), F.greatest("ru", "rv").alias("cv")).agg(
            F.min(edge).alias("e")
        )
        passed, live = live, pinned(thinned.select("e.u", "e.v", "e.w", "cu", "cv"))
        if passed is not given:  # which the result still reads
            release(passed)
    final = start.select("c", F.col("c").alias("root"))
    for roots in hops:
        step = roots.select(F.col("c").alias("root"), "p")
        final = final.join(step, "root", "left").select("c", F.coalesce("p", "root").alias("root"))
    picked_edges = reduce(DataFrame.unionAll, forest) if forest else edges.select("u", "v", "w").limit(0)
    return picked_edges, final


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Label every vertex `v` with the smallest vertex of its component over `edges(u, v)`."""
    ordered = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    _, roots = minimum_forest(ordered.select("u", "v", F.lit(0).alias("w"), F.col("u").alias("cu"), F.col("v").alias("cv")))
    rooted = pinned(roots)
    smallest = rooted.groupBy("root").agg(F.min("c").alias("label"))
    labels = rooted.join(smallest, "root").select(F.col("c").alias("v"), "label")
    return vertices.select("v").distinct().join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("label"))
