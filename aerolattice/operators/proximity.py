"""Nearest neighbours on a plane through an adaptive quadtree.

A square bucket splits while it holds more than a few positions, down to any depth, so dense places have narrow leaves and
empty ones wide leaves. Distances within a point's own leaf bound that of its k-th neighbour, and leaves of whatever depth
that come within the bound of each other are joined; points only meet in those.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil, floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolattice.runtime import pinned

#: Positions that a leaf holds at most (or k, if that is more), and levels that are looked at together.
CROWD = 16
LADDER = 8
#: Levels below which two different coordinates of one extent are always in different buckets.
DEEPEST = 60

Measure = Callable[[Column, Column, Column, Column], Column]


def _side(level: Column, base: float) -> Column:
    return F.lit(float(base)) * F.pow(F.lit(2.0), level)


def _up(bucket: Column, levels: Column) -> Column:
    """The bucket that many levels above."""
    return F.floor(bucket / F.pow(F.lit(2.0), levels)).cast("bigint")


def _top(points: DataFrame, base: float) -> int:
    """Level whose buckets are as wide as all points lie apart."""
    reach = points.agg(F.max("u").alias("hu"), F.min("u").alias("lu"), F.max("v").alias("hv"), F.min("v").alias("lv")).first()
    if reach.hu is None:
        return 0
    extent = max(reach.hu - reach.lu, reach.hv - reach.lv)
    return ceil(log2(extent / base)) if extent > 0 else floor(log2(base))


def leaves(points: DataFrame, most: int, base: float) -> DataFrame:
    """`points` with their leaf: level (buckets are base * 2^level wide) and bucket bu, bv.

    A leaf is the widest bucket of at most `most` rows. Levels are taken a few at a time from the top down: points are
    counted in the narrowest, those counts travel to the wider ones, and only points of buckets that are still too full
    go on.
    """
    top = _top(points, base)
    low, found, open_points = top, [], points
    place = ["zone", "level", "bu", "bv"]
    while True:
        high, low = low, low - LADDER
        side = float(base) * 2.0**low
        at = open_points.withColumn("cu", F.floor(F.col("u") / side)).withColumn("cv", F.floor(F.col("v") / side))
        cells = at.groupBy("zone", "cu", "cv").agg(F.count("*").alias("held"))
        steps = F.explode(F.sequence(F.lit(0), F.lit(high - low)))
        ladder = cells.withColumn("up", steps).select(
            "zone", "cu", "cv", "held", (F.col("up") + low).alias("level"), _up(F.col("cu"), F.col("up")).alias("bu"), _up(F.col("cv"), F.col("up")).alias("bv")
        )
        full = ladder.groupBy(*place).agg(F.sum("held").alias("all")).where(F.col("all") <= most)
        leaf = ladder.join(full, place).groupBy("zone", "cu", "cv").agg(F.max(F.struct("level", "bu", "bv")).alias("leaf"))
        placed = pinned(at.join(leaf, ["zone", "cu", "cv"], "left").select(*points.columns, "leaf.*"))
        found.append(placed.where("level IS NOT NULL"))
        open_points = placed.where("level IS NULL").select(*points.columns)
        if low <= top - DEEPEST or open_points.isEmpty():
            break
    last = open_points.withColumn("level", F.lit(low)).withColumn("bu", F.floor(F.col("u") / side)).withColumn("bv", F.floor(F.col("v") / side))
    return pinned(reduce(DataFrame.unionByName, [*found, last]))


def _bounded(placed: DataFrame, k: int, base: float, measure: Measure) -> DataFrame:
    """`placed` with a distance within which its k nearest others are sure to lie; null if there may be fewer in all.

    A leaf with enough points is measured. Else the bucket above holds more than a leaf may, all within two of its sides.
    """
    place = ["zone", "level", "bu", "bv"]
    other = placed.select(*place, F.col("id").alias("other"), F.col("u").alias("ou"), F.col("v").alias("ov"))
    met = placed.join(other, place).where("id <> other").select("zone", "id", measure(F.col("u"), F.col("v"), F.col("ou"), F.col("ov")).alias("d"))
    near = met.groupBy("zone", "id").agg(F.sort_array(F.collect_list("d")).alias("_d")).select("zone", "id", F.get("_d", k - 1).alias("within"))
    top = placed.groupBy("zone").agg(F.count("*").alias("_all"))
    joined = placed.join(near, ["zone", "id"], "left").join(top, "zone")
    wide = F.when(F.col("_all") > k, 2 * _side(F.col("level") + 1, base))
    return joined.withColumn("within", F.coalesce("within", wide)).drop("_all")


def _met_leaves(table: DataFrame, base: float, top: int) -> DataFrame:
    """Pairs (zone, leaf, other leaf) that lie within the leaf's reach, the leaf itself included.

    The nine buckets around a leaf, of a width that is at least its reach and its own, hold every leaf that may be near.
    Narrower leaves are found under those buckets through their ancestors, wider ones through the buckets' ancestors.
    """
    reach = F.greatest(F.col("level"), F.ceil(F.log2(F.col("reach") / base)).cast("int"))
    at = F.least(F.coalesce(reach, F.lit(top)), F.lit(top))
    box = ["lu", "hu", "lv", "hv"]
    asking = table.select("zone", "leaf", "reach", *box, at.alias("at"), _up(F.col("bu"), at - F.col("level")).alias("qu"), _up(F.col("bv"), at - F.col("level")).alias("qv"))
    nine = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asking = asking.withColumn("n", nine).withColumn("qu", F.col("qu") + F.col("n.i")).withColumn("qv", F.col("qv") + F.col("n.j"))
    asking = asking.drop("n").withColumnsRenamed({name: f"a{name}" for name in box})
    there = table.select("zone", F.col("leaf").alias("other"), *box, "level", "bu", "bv")
    ancestors = there.withColumn("at", F.explode(F.sequence(F.col("level"), F.greatest(F.lit(top), F.col("level")))))
    ancestors = ancestors.withColumn("qu", _up(F.col("bu"), F.col("at") - F.col("level"))).withColumn("qv", _up(F.col("bv"), F.col("at") - F.col("level")))
    under = asking.join(ancestors, ["zone", "at", "qu", "qv"])
    wider = asking.where(F.col("at") < top).withColumn("level", F.explode(F.sequence(F.col("at") + 1, F.lit(top))))
    wider = wider.withColumn("bu", _up(F.col("qu"), F.col("level") - F.col("at"))).withColumn("bv", _up(F.col("qv"), F.col("level") - F.col("at")))
    over = wider.drop("qu", "qv", "at").distinct().join(there, ["zone", "level", "bu", "bv"])
    kept = ["zone", "leaf", "other", "reach", *[f"a{name}" for name in box], *box]
    met = under.select(*kept).unionByName(over.select(*kept))
    near = F.lit(True)
    for axis in ("u", "v"):
        gap = F.greatest(F.col(f"l{axis}") - F.col(f"ah{axis}"), F.col(f"al{axis}") - F.col(f"h{axis}"))
        near = near & (gap <= F.col("reach"))
    return met.where(F.col("reach").isNull() | near).select("zone", "leaf", "other", *box)


def near_candidates(points: DataFrame, k: int, base: float, measure: Measure) -> DataFrame:
    """Rows (zone, id, other, d) holding at least the k nearest others of every point of `points(zone, id, u, v, m)`.

    Points are distinct positions standing for `m` members each. `measure` must be at least the larger of the two
    coordinate differences and at most twice it, as hexagon and Euclidean distance are. `base` is any width; buckets are
    that wide times powers of two.
    """
    placed = leaves(points.select("zone", "id", "u", "v"), max(CROWD, k), base)
    bounded = pinned(_bounded(placed, k, base, measure).withColumn("leaf", F.struct("level", "bu", "bv")))
    top = _top(points, base) + 1
    sizes = [F.min("u").alias("lu"), F.max("u").alias("hu"), F.min("v").alias("lv"), F.max("v").alias("hv")]
    reach = F.when(F.count("within") == F.count("*"), F.max("within")).alias("reach")
    table = pinned(bounded.groupBy("zone", "leaf").agg(reach, *sizes).select("*", "leaf.*"))
    met = _met_leaves(table, base, top)
    asks = bounded.select("zone", "leaf", "id", "u", "v", "within").join(met, ["zone", "leaf"])
    for axis in ("u", "v"):
        gap = F.greatest(F.col(f"l{axis}") - F.col(axis), F.col(axis) - F.col(f"h{axis}"))
        asks = asks.where(F.col("within").isNull() | (gap <= F.col("within")))
    there = bounded.select("zone", F.col("leaf").alias("other"), F.col("id").alias("other_id"), F.col("u").alias("ou"), F.col("v").alias("ov"))
    pairs = asks.select("zone", "id", "u", "v", "within", "other").join(there, ["zone", "other"]).where("id <> other_id")
    found = pairs.select("zone", "id", F.col("other_id").alias("other"), "within", measure(F.col("u"), F.col("v"), F.col("ou"), F.col("ov")).alias("d"))
    return found.where("within IS NULL OR d <= within").select("zone", "id", "other", "d")
