"""Which terminals to connect: k nearest, single-linkage backbone, or a connected repair of given pairs.

Terminals are rows (feature_id, q, r); several may share a cell. Pairs are unordered cell pairs (aq, ar, bq, br)
with the smaller (q, r) first. Everything below works on distinct cells, so copies of a terminal cost nothing
beyond one grouped count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolattice.functions import hexmath as hx
from aerolattice.operators.forest import components, minimum_forest
from aerolattice.operators.graph import forward_literal
from aerolattice.operators.grid import box_cells
from aerolattice.operators.ordered import running
from aerolattice.operators.proximity import near_candidates
from aerolattice.runtime import pinned


def all_pairs_profile(terminals: DataFrame) -> DataFrame:
    """The all-pairs set in closed form: per cell, the number of its pairs, without making them.

    A pair runs from the earlier terminal to the later one, so cell a is paired with every cell b that has a member
    after a's first member, and with itself if it has copies. That is a count of last members beyond a position.
    """
    cells = terminals.groupBy("q", "r").agg(
        F.count("*").alias("members"), F.min("feature_id").alias("first_id"), F.max("feature_id").alias("last_id")
    )
    marks = cells.select(
        F.explode(
            F.array(
                F.struct((-F.col("first_id")).alias("at"), F.lit(0).alias("ends")),
                F.struct((-F.col("last_id")).alias("at"), F.lit(1).alias("ends")),
            )
        ).alias("m"),
        "q",
        "r",
        "members",
    ).select("m.at", "m.ends", "q", "r", "members")
    counted = running(marks, [], "at", {"pairs": ("sum", F.col("ends"))}, ties=["ends"])
    return counted.where("ends = 0").select("q", "r", "members", "pairs")


def knn_pairs(terminals: DataFrame, k: int) -> DataFrame:
    """For each terminal the k nearest terminals in other cells, ties by feature_id, those without an id first.

    Copies share their neighbours, and copies of a neighbour use up places, so each cell is reduced to its first k
    members before any neighbour is looked up.
    """
    first = Window.partitionBy("q", "r").orderBy("feature_id")
    members = terminals.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k)
    cells = pinned(
        members.groupBy("q", "r")
        .agg(F.sort_array(F.collect_list(F.coalesce("feature_id", F.lit(-(1 << 63))))).alias("ids"))
        .select(F.lit(0).alias("zone"), hx.pack(F.col("q"), F.col("r")).alias("id"), F.col("q").alias("u"), F.col("r").alias("v"), F.size("ids").alias("m"), "ids")
    )
    met = near_candidates(cells.drop("ids"), k, 1.0, hx.distance)
    ids = cells.select(F.col("id").alias("other"), "ids")
    ranked = (
        met.join(ids, "other")
        .select("id", "other", "d", F.explode("ids").alias("member"))
        .withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy("d", "member")))
        .where(F.col("_rank") <= k)
    )
    return _as_pairs(F.least("id", "other"), F.greatest("id", "other"), ranked).distinct()


def _as_pairs(a: Column, b: Column, rows: DataFrame) -> DataFrame:
    (aq, ar), (bq, br) = hx.unpack(F.col("a")), hx.unpack(F.col("b"))
    keyed = rows.select(a.alias("a"), b.alias("b"))
    return keyed.select(aq.alias("aq"), ar.alias("ar"), bq.alias("bq"), br.alias("br"))


def _sweep(field: DataFrame, line: Column, place: Column) -> DataFrame:
    """Spread seeds along one axis: each cell takes the best of the seeds before and after it on its line."""
    at = field.withColumn("_line", line).withColumn("_at", place)
    lower = F.when(F.col("seed").isNotNull(), F.struct((F.col("d") - F.col("_at")).alias("d"), "seed"))
    upper = F.when(F.col("seed").isNotNull(), F.struct((F.col("d") + F.col("_at")).alias("d"), "seed"))
    so_far = Window.partitionBy("_line").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    from_end = Window.partitionBy("_line").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    seen = at.withColumn("_lo", F.min(lower).over(so_far)).withColumn("_hi", F.min(upper).over(from_end))
    best = F.least(
        F.when(F.col("_lo").isNotNull(), F.struct((F.col("_lo.d") + F.col("_at")).alias("d"), F.col("_lo.seed").alias("seed"))),
        F.when(F.col("_hi").isNotNull(), F.struct((F.col("_hi.d") - F.col("_at")).alias("d"), F.col("_hi.seed").alias("seed"))),
    )
    return seen.withColumn("_best", best).select("q", "r", F.col("_best.d").alias("d"), F.col("_best.seed").alias("seed"))


def nearest_terminal(terminals: DataFrame) -> DataFrame:
    """Nearest terminal cell and its distance for every cell of the terminals' axial box.

    A shortest way between two cells uses at most two of the three axes and stays in the box of its ends, so one
    sweep along each axis settles every cell: three shuffles whatever the distances are.
    """
    seeds = terminals.select("q", "r", F.lit(0).alias("d"), hx.pack(F.col("q"), F.col("r")).alias("seed")).distinct()
    box = terminals.agg(
        F.min("q").alias("min_q"), F.max("q").alias("max_q"), F.min("r").alias("min_r"), F.max("r").alias("max_r")
    ).where("min_q is not null")
    field = box_cells(box).join(seeds, ["q", "r"], "left")
    field = _sweep(field, F.col("r"), F.col("q"))
    field = _sweep(field, F.col("q"), F.col("r"))
    return _sweep(field, F.col("q") + F.col("r"), F.col("q"))


def backbone_candidates(terminals: DataFrame) -> DataFrame:
    """Terminal pairs whose nearest-terminal regions touch, with their distance.

    A minimum spanning tree of all pairs can be chosen among these, and there are at most three per cell.
    """
    regions = pinned(nearest_terminal(terminals))
    ahead = regions.select("seed", F.explode(forward_literal()).alias("d"), "q", "r").select(
        F.col("seed").alias("s"), (F.col("q") + F.col("d.q")).alias("q"), (F.col("r") + F.col("d.r")).alias("r")
    )
    touching = (
        ahead.join(regions.select("q", "r", "seed"), ["q", "r"])
        .where("s <> seed")
        .select(F.least("s", "seed").alias("u"), F.greatest("s", "seed").alias("v"))
        .distinct()
    )
    (uq, ur), (vq, vr) = hx.unpack(F.col("u")), hx.unpack(F.col("v"))
    return touching.select("u", "v", hx.distance(uq, ur, vq, vr).alias("w"))


def backbone_edges(terminals: DataFrame) -> DataFrame:
    """Spanning tree (u, v, w) over the distinct terminal cells."""
    edges = backbone_candidates(terminals)
    forest, _ = minimum_forest(edges.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")))
    return forest


def backbone_pairs(terminals: DataFrame) -> DataFrame:
    """Single-linkage backbone. Copies of a terminal are linked at distance 0, which shows as a loop of the cell."""
    tree = backbone_edges(terminals).select("u", "v")
    copies = (
        terminals.groupBy(hx.pack(F.col("q"), F.col("r")).alias("u")).agg(F.count("*").alias("n")).where("n > 1").select("u", F.col("u").alias("v"))
    )
    return _as_pairs(F.col("u"), F.col("v"), tree.unionByName(copies))


def connected_pairs(terminals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add the shortest links that join the components of `pairs`, as few as needed.

    Contracting parts of a graph never brings an edge into its spanning tree, so the links are looked for among the
    backbone's edges only.
    """
    key = terminals.select(hx.pack(F.col("q"), F.col("r")).alias("v")).distinct()
    given = pairs.select(hx.pack(F.col("aq"), F.col("ar")).alias("u"), hx.pack(F.col("bq"), F.col("br")).alias("v"))
    labels = pinned(components(key, given))
    tree = backbone_edges(terminals)
    joined = tree.join(labels.select(F.col("v").alias("u"), F.col("label").alias("cu")), "u").join(
        labels.select("v", F.col("label").alias("cv")), "v"
    )
    links, _ = minimum_forest(joined)
    return pairs.unionByName(_as_pairs(F.col("u"), F.col("v"), links)).distinct()


def build_pairs(terminals: DataFrame, mode: str, k: int = 2) -> DataFrame:
    """Pairs of a connectivity mode. The all-pairs set is quadratic and never written out: see `all_pairs_profile`."""
    if mode == "knn":
        return knn_pairs(terminals, k)
    if mode == "Single-Linkage_HAC":
        return backbone_pairs(terminals)
    if mode == "all_pairs":
        raise ValueError("all_pairs is not enumerated: use all_pairs_profile, or route a pair table of your own")
    raise ValueError(f"unknown connectivity mode: {mode}")
