"""Density hierarchy of spanning trees: single linkage dendrogram, condensed clusters, selection by excess of mass.

No tree is gathered anywhere and no step follows the depth of a tree, which may be as large as the tree:

* The dendrogram is built over rounds of contraction. In each round every component picks its lightest edge. Edges that
  nobody picks join two clusters that are both more than a component (fork edges); there are at most half as many of them
  as components. The picked edges are contracted. A contracted edge that is lighter than the lightest fork edge of its
  new component is part of that component's chain: the chain's edges, ordered by weight, are each the parent of the one
  before, and the fork edge is the parent of the last. Heavier edges wait for the component of a later round.
* Clusters are the runs of nodes between true splits; their tops are found by pointer doubling.
* Selection runs along heavy paths: each cluster continues in its larger child. From the bottom of a path upwards, the
  best mass is `P + max(S - P)` with S the stabilities and P the running sum of what hangs on the path from the side, so
  a path of any length takes two running values, and no more than log2(n) paths lie above one another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolattice.operators.forest import to_roots
from aerolattice.operators.ordered import running
from aerolattice.runtime import measured, pinned

#: Two masses that differ by less than this share are equal; the larger cluster is then kept whole.
TIE = 1e-9


def dendrogram(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of a forest `tree(u, v, w)`: nodes(e, w, parent, size), and leaves(v, e) with the node above each point.

    A node is an edge that joins what lies under lighter edges; `e` rises with (w, u, v). `size` counts points.
    """
    numbered = tree.select("u", "v", "w").orderBy("w", "u", "v").withColumn("e", F.monotonically_increasing_id())
    edges = pinned(numbered)
    light = leaves = pinned(edges.select("e", F.explode(F.array("u", "v")).alias("v")).groupBy("v").agg(F.min("e").alias("e")))
    light = light.select(F.col("v").alias("c"), "e")
    held = leaves.groupBy("e").agg(F.count("*").alias("held"))
    live = edges.join(held, "e", "left").select("e", F.col("u").alias("cu"), F.col("v").alias("cv"), F.coalesce("held", F.lit(0)).alias("held"))
    waiting: DataFrame | None = None
    made: list[DataFrame] = []
    while True:
        picks = light.groupBy("e").agg(F.count("*").alias("_n"))
        marked = live.join(picks, "e", "left")
        other = F.when(F.col("c") == F.col("cu"), F.col("cv")).otherwise(F.col("cu"))
        mutual = (F.col("_n") == 2) & (F.col("c") < other)
        parents = light.join(marked, "e").select("c", F.when(mutual, F.col("c")).otherwise(other).alias("p"))
        roots = to_roots(parents)
        at_u, at_v = (roots.select(F.col("c").alias(x), F.col("p").alias(f"r{x[1]}")) for x in ("cu", "cv"))
        renamed = marked.join(at_u, "cu").join(at_v, "cv")
        forks = pinned(renamed.where("_n IS NULL").select("e", F.col("ru").alias("cu"), F.col("rv").alias("cv"), "held"))
        inside = renamed.where("_n IS NOT NULL").select("e", F.col("ru").alias("c"), "held")
        if waiting is not None:
            moved = waiting.join(roots, "c").select("e", F.col("p").alias("c"), "held")
            inside = inside.unionByName(moved)
        light = forks.select("e", F.explode(F.array("cu", "cv")).alias("c")).groupBy("c").agg(F.min("e").alias("e"))
        here = pinned(inside.join(light.withColumnRenamed("e", "top"), "c", "left"))
        chained = here.where("top IS NULL OR e < top").withColumn("_back", -F.col("e"))
        totals = chained.groupBy("c", "top").agg(F.sum("held").alias("total"))
        after = {"next": ("min", F.col("e")), "above": ("sum", F.col("held"))}
        placed = running(chained, ["c"], "_back", after, inclusive=False).join(totals.select("c", "total"), "c")
        made.append(pinned(placed.select("e", F.coalesce("next", "top").alias("parent"), (F.col("total") - F.col("above")).alias("size"))))
        if forks.isEmpty():
            break
        waiting = here.where("e > top").select("e", "c", "held")
        below = totals.where("top IS NOT NULL").groupBy(F.col("top").alias("e")).agg(F.sum("total").alias("_below"))
        live = forks.join(below, "e", "left").select("e", "cu", "cv", (F.col("held") + F.coalesce("_below", F.lit(0))).alias("held"))
    nodes = reduce(DataFrame.unionByName, made).join(edges.select("e", "w"), "e").select("e", "w", "parent", "size")
    return pinned(nodes), leaves


def condensed(nodes: DataFrame, smallest: int) -> tuple[DataFrame, DataFrame]:
    """(owners, clusters) of a dendrogram whose clusters have at least `smallest` (two or more) points.

    A node both of whose children are that large splits its cluster in two; else the cluster goes on in the large child
    and sheds the rest. owners(e, top) names each node's cluster by its uppermost node (small nodes belong to the cluster
    that sheds them); clusters(k, parent, size, zero, mass) has the stability: the sum over points of how much larger the
    inverse distance is at which they leave than that at which the cluster began. `zero` counts points that only leave
    at distance 0; it outweighs any mass.
    """
    large = nodes.where(F.col("size") >= smallest)
    kids = large.where("parent IS NOT NULL").groupBy(F.col("parent").alias("e")).agg(F.count("*").alias("big"), F.sum("size").alias("inside"))
    full = nodes.join(kids, "e", "left").withColumn("split", F.coalesce(F.col("big") == 2, F.lit(False)))
    full = pinned(full.select("e", "w", "parent", "size", "split", F.coalesce("inside", F.lit(0)).alias("inside")))
    above = full.select(F.col("e").alias("parent"), F.col("split").alias("torn"), F.col("w").alias("wide"))
    up = pinned(full.join(above, "parent", "left"))
    begins = F.col("parent").isNull() | F.col("torn")
    owners = to_roots(up.select(F.col("e").alias("c"), F.when(begins, F.col("e")).otherwise(F.col("parent")).alias("p")))
    owners = owners.select(F.col("c").alias("e"), F.col("p").alias("top"))
    tops = up.where(begins).select(F.col("e").alias("top"), "parent", F.col("size").alias("whole"), F.coalesce(1 / F.col("wide"), F.lit(0.0)).alias("born"))
    left = F.when(F.col("size") < smallest, 0).when(F.col("split"), F.col("size")).otherwise(F.col("size") - F.col("inside"))
    shed = full.select("e", "w", left.alias("left")).join(owners, "e").join(tops.select("top", "born"), "top")
    flat = F.col("w") <= 0
    sums = shed.groupBy("top").agg(
        F.sum(F.when(flat, F.col("left")).otherwise(0)).alias("zero"),
        F.sum(F.when(flat, 0.0).otherwise(F.col("left") * (1 / F.col("w") - F.col("born")))).alias("mass"),
    )
    above = owners.select(F.col("e").alias("parent"), F.col("top").alias("_up"))
    clusters = sums.join(tops, "top").where(F.col("whole") >= smallest).join(above, "parent", "left")
    return owners, pinned(clusters.select(F.col("top").alias("k"), F.col("_up").alias("parent"), F.col("whole").alias("size"), "zero", "mass"))


def _paths(clusters: DataFrame) -> DataFrame:
    """Clusters with the head of their heavy path (`head`), and of the path that hangs on them from the side (`side`)."""
    heavy = clusters.where("parent IS NOT NULL").groupBy("parent").agg(F.max_by("k", F.struct("size", "k")).alias("heir"))
    joined = clusters.join(heavy, "parent", "left")
    follows = F.coalesce(F.col("heir") == F.col("k"), F.lit(False))
    heads = to_roots(joined.select(F.col("k").alias("c"), F.when(follows, F.col("parent")).otherwise(F.col("k")).alias("p")))
    side = joined.where(~follows & F.col("parent").isNotNull()).select(F.col("parent").alias("k"), F.col("k").alias("side"))
    named = clusters.join(heads.select(F.col("c").alias("k"), F.col("p").alias("head")), "k")
    return pinned(named.join(side, "k", "left"))


def _pair(zero: Column, mass: Column) -> Column:
    return F.struct(zero.alias("zero"), mass.alias("mass"))


def _at_least(zero: Column, mass: Column, than_zero: Column, than_mass: Column, scale: Column) -> Column:
    return (zero > than_zero) | ((zero == than_zero) & (mass >= than_mass - TIE * scale))


def excess_of_mass(clusters: DataFrame) -> DataFrame:
    """(k, chosen): the selected cluster that each cluster lies in, null outside all of them.

    Of every cluster and what can be made of its descendants the heavier is taken; a whole tree is never one cluster.
    """
    paths = _paths(clusters)
    heads = paths.where("k = head").select("head", F.col("parent").alias("hangs"))
    unsolved, solved, judged = paths, None, []
    while True:
        if solved is None:
            known = unsolved.withColumns({"lz": F.lit(0).cast("bigint"), "lm": F.lit(0.0), "ok": F.col("side").isNull()})
        else:
            known = unsolved.join(solved.select(F.col("head").alias("side"), "lz", "lm"), "side", "left")
            known = known.withColumn("ok", F.col("side").isNull() | F.col("lz").isNotNull()).fillna({"lz": 0, "lm": 0.0})
        known = pinned(known)
        open_paths = known.where(~F.col("ok")).select("head").distinct()
        done = known.join(open_paths, "head", "left_anti")
        summed = running(done, ["head"], "size", {"pz": ("sum", F.col("lz")), "pm": ("sum", F.col("lm"))})
        rest = summed.withColumn("rest", _pair(F.col("zero") - F.col("pz"), F.col("mass") - F.col("pm")))
        below = running(rest, ["head"], "size", {"under": ("max", F.col("rest"))}, inclusive=False)
        scale = F.abs(F.col("mass")) + F.abs(F.col("pm"))
        wins = _at_least(F.col("rest.zero"), F.col("rest.mass"), F.col("under.zero"), F.col("under.mass"), scale)
        best = F.when(F.col("under").isNull(), F.col("rest")).otherwise(F.greatest("rest", "under"))
        told = below.withColumn("wins", F.coalesce(wins, F.lit(True))).withColumn("best", best)
        columns = [*paths.columns, "wins", (F.col("best.zero") + F.col("pz")).alias("lz"), (F.col("best.mass") + F.col("pm")).alias("lm")]
        judged.append(pinned(told.select(*columns)))
        fresh = judged[-1].where("k = head").select("head", "lz", "lm")
        solved = fresh if solved is None else solved.unionByName(fresh)
        unsolved = pinned(known.join(open_paths, "head", "left_semi").select(*paths.columns))
        if unsolved.isEmpty():
            break
    down = reduce(DataFrame.unionByName, judged).select("k", "parent", "head", "size", "wins")
    candidate = F.when(F.col("wins") & F.col("parent").isNotNull(), F.struct("size", "k"))
    within = running(down.withColumn("_down", -F.col("size")), ["head"], "_down", {"top": ("max", candidate)})
    within = pinned(within.select("k", "head", F.col("top.k").alias("top")))
    hung = heads.join(within.select(F.col("k").alias("hangs"), F.col("head").alias("over"), F.col("top").alias("given")), "hangs", "left")
    reached = pinned(hung.where("over IS NULL").select("head", F.lit(None).cast("bigint").alias("given")))
    found = [reached]
    while not reached.isEmpty():
        above = reached.select(F.col("head").alias("over"), F.col("given").alias("_higher"))
        reached = pinned(hung.join(above, "over").select("head", F.coalesce("_higher", "given").alias("given")))
        found.append(reached)
    return within.join(reduce(DataFrame.unionByName, found), "head").select("k", F.coalesce("given", "top").alias("chosen"))


@measured
def density_labels(points: DataFrame, tree: DataFrame, smallest: int) -> DataFrame:
    """(zone, id, label) of `points(zone, id, ...)` under the spanning forest `tree(u, v, w)` of their zones.

    The label is the smallest id of the selected cluster, -1 for noise and for points that no edge reaches.
    """
    if smallest < 2:
        raise ValueError("a cluster has at least two points")
    nodes, leaves = dendrogram(tree)
    owners, clusters = condensed(nodes, smallest)
    chosen = excess_of_mass(clusters)
    at = leaves.join(owners, "e").join(chosen.withColumnRenamed("k", "top"), "top").where("chosen IS NOT NULL").select("v", "chosen")
    named = pinned(at).groupBy("chosen").agg(F.min("v").alias("label"))
    labels = at.join(named, "chosen").select(F.col("v").alias("id"), "label")
    return points.select("zone", "id").join(labels, "id", "left").select("zone", "id", F.coalesce("label", F.lit(-1)).alias("label"))
