"""Shortest paths for many terminal pairs at once.

All sources advance together: a state row (source, cell) holds the best cost so far and the directions walked, one
character per hop, so the path is known on arrival and no walk back is needed. A source stops growing when no
frontier row can still improve one of its targets. Several hops are planned at a time, because the state is written
once per turn and not once per hop; all but the last hop's states have then been grown already.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolattice.functions import hexmath as hx
from aerolattice.operators.forest import components
from aerolattice.operators.graph import STEP_WEIGHT, edge_weight, g0_edges
from aerolattice.runtime import pinned

PAIR = ["aq", "ar", "bq", "br"]
SOURCE = ["aq", "ar"]
# Hops per written state, and the number of hops after which unreachable pairs are looked for.
HOPS = 3
PATIENCE = 12


def routable_pairs(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs with both ends in the graph."""
    a = vertices.select(F.col("q").alias("aq"), F.col("r").alias("ar"))
    b = vertices.select(F.col("q").alias("bq"), F.col("r").alias("br"))
    return pairs.select(*PAIR).distinct().join(a, SOURCE, "left_semi").join(b, ["bq", "br"], "left_semi")


def reachable_pairs(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs whose ends lie in one component of the graph."""
    edges = g0_edges(vertices).select(hx.pack(F.col("q"), F.col("r")).alias("u"), hx.pack(F.col("nq"), F.col("nr")).alias("v"))
    labels = pinned(components(vertices.select(hx.pack(F.col("q"), F.col("r")).alias("v")), edges))
    keyed = pairs.withColumn("_a", hx.pack(F.col("aq"), F.col("ar"))).withColumn("_b", hx.pack(F.col("bq"), F.col("br")))
    a = labels.select(F.col("v").alias("_a"), F.col("label").alias("_la"))
    b = labels.select(F.col("v").alias("_b"), F.col("label").alias("_lb"))
    return keyed.join(a, "_a").join(b, "_b").where("_la = _lb").select(*PAIR)


def shortest_paths(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Cheapest path of every pair that has one: (aq, ar, bq, br, cost, cells).

    Edge weight is 1 plus the mean cost of both cells. Among equal costs the smallest direction string wins.
    """
    graph = pinned(vertices.select("q", "r", "cost"))
    wanted = pinned(routable_pairs(pairs, graph))
    lightest = STEP_WEIGHT + (graph.agg(F.min("cost")).first()[0] or 0.0)
    state = pinned(
        wanted.select(*SOURCE)
        .distinct()
        .join(graph.select(F.col("q").alias("aq"), F.col("r").alias("ar"), "cost"), SOURCE)
        .select(
            *SOURCE,
            F.col("aq").alias("q"),
            F.col("ar").alias("r"),
            F.struct(F.lit(0.0).alias("g"), F.lit("").alias("steps"), F.lit(0).alias("round"), "cost").alias("best"),
        )
    )
    turn, checked = 0, False
    while not state.where(F.col("best.round") == turn).isEmpty():
        if turn >= PATIENCE and not checked:
            wanted, checked = pinned(reachable_pairs(wanted, graph)), True
        reach = _reach(wanted, state)
        grown = [state]
        front = state.where(F.col("best.round") == turn)
        for _ in range(HOPS):
            turn += 1
            useful = front.join(reach, SOURCE).where(F.col("best.g") + lightest <= F.col("reach"))
            front = _best(_hop(useful, graph, turn))
            grown.append(front)
        state = pinned(_best(reduce(DataFrame.unionByName, grown)))
    arrived = state.select(*SOURCE, F.col("q").alias("bq"), F.col("r").alias("br"), "best")
    found = wanted.join(arrived, PAIR)
    return found.select(*PAIR, F.col("best.g").alias("cost"), _walk(F.col("aq"), F.col("ar"), F.col("best.steps")).alias("cells"))


def _hop(front: DataFrame, graph: DataFrame, turn: int) -> DataFrame:
    """Neighbours of the frontier, one direction character longer."""
    ahead = front.select(*SOURCE, "q", "r", "best", F.posexplode(hx.direction_literal()).alias("way", "d")).select(
        *SOURCE,
        (F.col("q") + F.col("d.q")).alias("q"),
        (F.col("r") + F.col("d.r")).alias("r"),
        "best",
        F.col("way").cast("string").alias("way"),
    )
    arrival = F.struct(
        (F.col("best.g") + edge_weight(F.col("best.cost"), F.col("cost"))).alias("g"),
        F.concat(F.col("best.steps"), F.col("way")).alias("steps"),
        F.lit(turn).alias("round"),
        F.col("cost"),
    )
    return ahead.join(graph, ["q", "r"]).select(*SOURCE, "q", "r", arrival.alias("best"))


def _best(states: DataFrame) -> DataFrame:
    return states.groupBy(*SOURCE, "q", "r").agg(F.min("best").alias("best"))


def _reach(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """Per source, the cost up to which its search must go on: infinite until every target has been met."""
    met = state.select(*SOURCE, F.col("q").alias("bq"), F.col("r").alias("br"), F.col("best.g").alias("g"))
    known = F.coalesce(F.col("g"), F.lit(float("inf")))
    return wanted.join(met, PAIR, "left").groupBy(*SOURCE).agg(F.max(known).alias("reach"))


def _walk(q: Column, r: Column, steps: Column) -> Column:
    dirs = hx.direction_literal()
    origin = F.struct(q.alias("q"), r.alias("r"))
    places = F.when(F.length(steps) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length(steps)))
    ways = F.transform(places, lambda i: F.substr(steps, i, F.lit(1)).cast("int"))

    def go(cells: Column, way: Column) -> Column:
        last, d = F.element_at(cells, -1), F.element_at(dirs, way + 1)
        return F.concat(cells, F.array(F.struct((last.q + d.q).alias("q"), (last.r + d.r).alias("r"))))

    return F.aggregate(ways, F.array(origin), go)


def as_paths(routed: DataFrame) -> DataFrame:
    """Give every routed pair a `path_id` made of its ends."""
    name = F.concat_ws(">", F.concat_ws(":", "aq", "ar"), F.concat_ws(":", "bq", "br"))
    return routed.select(name.alias("path_id"), "cells", "cost")
