"""Betweenness of the route graph by breadth-first search from all vertices at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolattice.functions import hexmath as hx
from aerolattice.runtime import pinned


def betweenness(g1_edges: DataFrame) -> DataFrame:
    """Interior visits per cell over one fewest-hops path of every vertex pair, smallest predecessors first.

    Layers of (source, vertex, predecessor) grow outwards; a vertex can only repeat in the two layers before, so
    nothing else is compared. Visits are then summed from the outermost layer inwards: a vertex is interior to as
    many paths as it has later-numbered descendants in the source's tree. No path is ever listed.
    """
    ends = g1_edges.select(hx.pack(F.col("aq"), F.col("ar")).alias("v"), hx.pack(F.col("bq"), F.col("br")).alias("w"))
    links = pinned(ends.unionAll(ends.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct())
    sources = links.select(F.col("v").alias("s")).distinct()
    layers = [pinned(sources.select("s", F.col("s").alias("v"), F.lit(None).cast("bigint").alias("p")))]
    while True:
        nearer = layers[-1].select("s", "v")
        if len(layers) > 1:
            nearer = nearer.unionAll(layers[-2].select("s", "v"))
        grown = layers[-1].select("s", "v").join(links, "v").groupBy("s", F.col("w").alias("v")).agg(F.min("v").alias("p"))
        layer = pinned(grown.join(nearer, ["s", "v"], "left_anti"))
        if layer.isEmpty():
            break
        layers.append(layer)
    visits: list[DataFrame] = []
    below = None
    for layer in reversed(layers[1:]):
        own = F.when(F.col("v") > F.col("s"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        if below is None:
            counted = layer.select("s", "p", own.alias("n"))
        else:
            counted = layer.join(below, ["s", "v"], "left").select("s", "p", (own + F.coalesce("n", F.lit(0))).alias("n"))
        below = pinned(counted.groupBy("s", F.col("p").alias("v")).agg(F.sum("n").alias("n")))
        visits.append(below.where("s <> v").select("v", "n"))
    if not visits:
        visits = [links.select("v", F.lit(0).cast("bigint").alias("n")).limit(0)]
    total = reduce(DataFrame.unionAll, visits).groupBy("v").agg(F.sum("n").alias("visits")).where("visits > 0")
    q, r = hx.unpack(F.col("v"))
    return total.select(q.alias("q"), r.alias("r"), "visits")
