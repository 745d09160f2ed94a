"""Density clustering of point layers per zone.

points(zone, id, x, y). Copies of a position are folded into one row with a count before any neighbour is looked up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolattice.operators.forest import components, minimum_forest
from aerolattice.operators.proximity import near_candidates
from aerolattice.runtime import measured, pinned

# Radius of a lone cluster's circle and its number of sides.
LONE_RADIUS = 50.0
CIRCLE_SIDES = 64
# Point pairs a box pair may make before its boxes are halved, and the finest box as a share of the first.
PAIR_WORK = 4096
FINEST = 2.0**-40
WIDEN = 4.0
#: Positions that share a bucket with a position, itself included and on average, at the first scale of a tree.
SHARED = 8


def euclid(u: Column, v: Column, ou: Column, ov: Column) -> Column:
    du, dv = u - ou, v - ov
    return F.sqrt(du * du + dv * dv)


def positions(points: DataFrame) -> DataFrame:
    """Distinct positions (zone, id, u, v, m): smallest member id and number of members."""
    return points.groupBy("zone", F.col("x").alias("u"), F.col("y").alias("v")).agg(F.min("id").alias("id"), F.count("*").alias("m"))


def position_cores(spots: DataFrame, min_samples: int, base: float) -> DataFrame:
    """Distance of every position's `min_samples`-th other member, its own copies included; null if there are too few."""
    met = near_candidates(spots, min_samples, base, euclid).join(
        spots.select("zone", F.col("id").alias("other"), F.col("m").alias("om")), ["zone", "other"]
    )
    by_distance = Window.partitionBy("zone", "id").orderBy("d", "other")
    nearest = met.withColumn("n", F.row_number().over(by_distance)).where(F.col("n") <= min_samples)
    reached = nearest.withColumn("held", F.sum("om").over(by_distance.rowsBetween(Window.unboundedPreceding, 0)))
    joined = spots.join(reached.select("zone", "id", "d", "held"), ["zone", "id"], "left")
    own = F.col("m") - 1
    found = F.min(F.when(own + F.col("held") >= min_samples, F.col("d")))
    return joined.groupBy("zone", "id", "u", "v", "m").agg(
        F.when(own >= min_samples, F.lit(0.0)).otherwise(found).alias("core")
    )


def core_distances(points: DataFrame, min_samples: int, base: float) -> DataFrame:
    cores = position_cores(positions(points), min_samples, base)
    at = points.select("zone", "id", F.col("x").alias("u"), F.col("y").alias("v"))
    return at.join(cores.select("zone", "u", "v", "core"), ["zone", "u", "v"]).select("zone", "id", "core")


def _nodes(spots: DataFrame, side: float) -> DataFrame:
    """Boxes of one component within one square bucket, with bounds on position and core distance."""
    return (
        spots.withColumn("bu", F.floor(F.col("u") / side))
        .withColumn("bv", F.floor(F.col("v") / side))
        .groupBy("zone", "comp", "bu", "bv")
        .agg(
            F.count("*").alias("n"),
            F.min("u").alias("lu"),
            F.max("u").alias("hu"),
            F.min("v").alias("lv"),
            F.max("v").alias("hv"),
            F.min("core").alias("lc"),
            F.max("core").alias("hc"),
        )
    )


BOX = ["comp", "bu", "bv", "n", "lu", "hu", "lv", "hv", "lc", "hc"]


def _side(nodes: DataFrame, letter: str) -> DataFrame:
    return nodes.select("zone", *[F.col(name).alias(letter + name) for name in BOX])


def _kept(pairs: DataFrame, limit: float) -> DataFrame:
    """Box pairs that may hold the shortest link of their two components."""
    c = F.col

    def gap(axis: str) -> Column:
        return F.greatest(c(f"al{axis}") - c(f"bh{axis}"), c(f"bl{axis}") - c(f"ah{axis}"), F.lit(0.0))

    def span(axis: str) -> Column:
        return F.greatest(c(f"ah{axis}") - c(f"bl{axis}"), c(f"bh{axis}") - c(f"al{axis}"))

    low = F.greatest(F.sqrt(gap("u") * gap("u") + gap("v") * gap("v")), c("alc"), c("blc"))
    high = F.greatest(F.sqrt(span("u") * span("u") + span("v") * span("v")), c("ahc"), c("bhc"))
    bounded = pairs.withColumn("low", low * (1 - 1e-12)).withColumn("high", high * (1 + 1e-12)).where(F.col("low") <= limit)
    best = bounded.groupBy("zone", "acomp", "bcomp").agg(F.min("high").alias("best"))
    return bounded.join(best, ["zone", "acomp", "bcomp"]).where("low <= best").drop("low", "high", "best")


def _closest_links(spots: DataFrame, limit: float) -> DataFrame:
    """Shortest link (u, v, w) between each two components that come within `limit` of each other.

    Boxes of components are paired with those of the nine buckets around; pairs that cannot hold the shortest link are
    dropped by their bounds, and boxes are halved until the pairs left are small. Points only meet in those. A point whose
    core distance is above `limit` has no such link.
    """
    side = limit
    spots = spots.where(F.col("core") <= limit)
    nodes = _nodes(spots, side)
    nine = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = (
        nodes.withColumn("s", F.explode(nine))
        .withColumn("nu", F.col("bu") + F.col("s.i"))
        .withColumn("nv", F.col("bv") + F.col("s.j"))
        .select("zone", *[F.col(name).alias("a" + name) for name in BOX], F.col("nu").alias("bbu"), F.col("nv").alias("bbv"))
    )
    pairs = pinned(_kept(around.join(_side(nodes, "b"), ["zone", "bbu", "bbv"]).where("acomp < bcomp"), limit))
    while side > limit * FINEST and (pairs.agg(F.max(F.col("an") * F.col("bn"))).first()[0] or 0) > PAIR_WORK:
        side /= 2
        halves = pinned(_nodes(spots, side))
        split = pairs.select("zone", "acomp", "bcomp", "abu", "abv", "bbu", "bbv")
        for letter in ("a", "b"):
            child = _side(halves, letter)
            parent = {f"{letter}{n}": F.floor(F.col(f"{letter}{n}") / 2) for n in ("bu", "bv")}
            keyed = child.withColumns({f"{k}_up": v for k, v in parent.items()})
            up = split.withColumnsRenamed({f"{letter}bu": f"{letter}bu_up", f"{letter}bv": f"{letter}bv_up"})
            split = up.join(keyed, ["zone", f"{letter}comp", f"{letter}bu_up", f"{letter}bv_up"]).drop(f"{letter}bu_up", f"{letter}bv_up")
        pairs = pinned(_kept(split, limit))
    at = spots.withColumn("bu", F.floor(F.col("u") / side)).withColumn("bv", F.floor(F.col("v") / side))
    small = pairs.select("zone", "acomp", "bcomp", "abu", "abv", "bbu", "bbv")
    for letter in ("a", "b"):
        own = at.select("zone", *[F.col(n).alias(letter + n) for n in ("comp", "bu", "bv", "id", "u", "v", "core")])
        small = small.join(own, ["zone", f"{letter}comp", f"{letter}bu", f"{letter}bv"])
    d = euclid(F.col("au"), F.col("av"), F.col("bu"), F.col("bv"))
    # `bu`/`bv` above name the second point's position; the buckets are abu, abv, bbu, bbv.
    link = F.struct(
        F.greatest(d, "acore", "bcore").alias("w"), F.least("aid", "bid").alias("u"), F.greatest("aid", "bid").alias("v")
    )
    return (
        small.groupBy(F.col("acomp").alias("cu"), F.col("bcomp").alias("cv"))
        .agg(F.min(link).alias("e"))
        .select("e.u", "e.v", "e.w", "cu", "cv")
        .where(F.col("w") <= limit)
    )


def _first_limit(spots: DataFrame, base: float) -> float:
    """The widest scale, `base` or below, at which positions share a bucket with few others.

    All positions are components of their own at the first scale, so it makes as many pairs as positions share buckets;
    where more positions stand on the same ground, a fixed scale would make their square.
    """
    limit = base
    while limit > base * FINEST:
        held = spots.groupBy("zone", F.floor(F.col("u") / limit), F.floor(F.col("v") / limit)).agg(F.count("*").alias("n"))
        found = held.agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("met")).first()
        if (found.met or 0) <= SHARED * (found["all"] or 0):
            break
        limit /= WIDEN
    return limit


@measured
def mutual_reach_tree(points: DataFrame, min_samples: int, base: float) -> DataFrame:
    """Minimum spanning tree (u, v, w) of every zone under mutual reachability distance.

    Components grow by distance scale: at each scale only the shortest link of two nearby components is looked for,
    and a spanning forest of these links merges them. Points closer than the scale before are already one component,
    so a bucket holds few components however many points it has; the first scale is chosen by how dense they stand. Copies of a position are linked to its first member
    at the position's core distance.
    """
    spots = pinned(position_cores(positions(points), min_samples, base).where("core is not null"))
    reach = spots.groupBy("zone").agg(
        F.max("u").alias("hu"), F.min("u").alias("lu"), F.max("v").alias("hv"), F.min("v").alias("lv"), F.max("core").alias("c")
    )
    top = reach.agg(F.max(F.greatest(F.col("hu") - F.col("lu") + F.col("hv") - F.col("lv"), "c"))).first()[0] or 0.0
    state = spots.withColumn("comp", F.col("id"))
    limit = _first_limit(spots, base)
    trees: list[DataFrame] = []
    while True:
        links = pinned(_closest_links(state, limit))
        if not links.isEmpty():
            forest, roots = minimum_forest(links)
            trees.append(pinned(forest))
            renamed = state.join(roots.withColumnRenamed("c", "comp"), "comp", "left").withColumn("comp", F.coalesce("root", "comp"))
            state = pinned(renamed.select("zone", "id", "u", "v", "core", "comp"))
        if limit > top:
            break
        limit *= WIDEN
    copies = points.select("zone", F.col("id").alias("member"), F.col("x").alias("u"), F.col("y").alias("v")).join(
        spots.select("zone", "u", "v", "id", "core"), ["zone", "u", "v"]
    )
    doubled = copies.where("member <> id").select(F.col("id").alias("u"), F.col("member").alias("v"), F.col("core").alias("w"))
    return reduce(DataFrame.unionByName, trees + [doubled])


def cut_labels(points: DataFrame, tree: DataFrame, cut_at: float, min_cluster_size: int) -> DataFrame:
    """Cluster of every point when links longer than `cut_at` are dropped; small groups are noise, labelled -1.

    A cluster's label is its smallest member id.
    """
    kept = tree.where(F.col("w") <= cut_at)
    labels = pinned(components(points.select(F.col("id").alias("v")), kept.select("u", "v")))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    named = labels.join(sizes, "label").select(
        F.col("v").alias("id"), F.when(F.col("n") >= min_cluster_size, F.col("label")).otherwise(F.lit(-1)).alias("label")
    )
    return points.join(named, "id").select("zone", "id", "label")


def zone_members(points: DataFrame, labels: DataFrame, min_cluster_size: int) -> DataFrame:
    """Members of every cluster; noise is dropped, and a zone of no more than the smallest size is one cluster."""
    size = points.groupBy("zone").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    joined = points.join(size, "zone").join(labels.select("id", "label"), "id", "left")
    label = F.when(F.col("n") <= min_cluster_size, F.col("first")).otherwise(F.col("label"))
    return joined.withColumn("label", label).where("label <> -1").select("zone", "label", "id", "x", "y")


def centroids(members: DataFrame) -> DataFrame:
    return members.groupBy("zone", "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))


def circle(cx: Column, cy: Column, radius: float = LONE_RADIUS, sides: int = CIRCLE_SIDES) -> Column:
    """Closed ring around a centre, clockwise from east."""

    def at(i: Column) -> Column:
        angle = -(i % sides) * F.lit(2.0) * F.pi() / sides
        return F.struct((cx + radius * F.cos(angle)).alias("x"), (cy + radius * F.sin(angle)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(sides)), at)


def few_points(members: DataFrame) -> DataFrame:
    """One circle per cluster around its mean."""
    return centroids(members).withColumn("ring", circle(F.col("cx"), F.col("cy")))


def ring_area(ring: Column) -> Column:
    """Area of a closed ring, by the shoelace sum about its first point."""
    a0 = ring[0]

    def term(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, i + 1)
        return (p.x - a0.x) * (q.y - a0.y) - (q.x - a0.x) * (p.y - a0.y)

    terms = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), term)
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def ring_radius(ring: Column, cx: Column, cy: Column) -> Column:
    return F.array_max(F.transform(ring, lambda p: F.hypot(p.x - cx, p.y - cy)))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a closed ring."""

    def crosses(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, i + 1)
        straddles = (p.y > y) != (q.y > y)
        return F.when(straddles & (x < (q.x - p.x) * (y - p.y) / F.when(q.y == p.y, F.lit(1.0)).otherwise(q.y - p.y) + p.x), F.lit(1)).otherwise(F.lit(0))

    hits = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), crosses)
    return F.aggregate(hits, F.lit(0), lambda s, t: s + t) % 2 == 1


def ring_buckets(rings: DataFrame, side: float) -> DataFrame:
    """Rings spread over the square buckets their extent touches; points are looked up by bucket."""
    low = {a: F.array_min(F.transform("ring", lambda p: p[a])) for a in ("x", "y")}
    high = {a: F.array_max(F.transform("ring", lambda p: p[a])) for a in ("x", "y")}
    spread = {a: F.sequence(F.floor(low[a] / side), F.floor(high[a] / side)) for a in ("x", "y")}
    return rings.withColumn("bx", F.explode(spread["x"])).withColumn("by", F.explode(spread["y"]))


def contained(points: DataFrame, rings: DataFrame, side: float) -> DataFrame:
    """Points inside rings(zone, label, ring) of their zone."""
    at = points.withColumn("bx", F.floor(F.col("x") / side)).withColumn("by", F.floor(F.col("y") / side))
    met = at.join(ring_buckets(rings.select("zone", "label", "ring"), side), ["zone", "bx", "by"])
    return met.where(ring_contains(F.col("ring"), F.col("x"), F.col("y"))).select("zone", "label", "id")


def radial_boundary(members: DataFrame, offset: float = 80.0, resolution: int = 360, min_gap_deg: float = 20.0) -> DataFrame:
    """Outline of every cluster: rows (zone, label, pos, x, y), `2 * resolution` per cluster.

    Members reach out by their distance plus `offset`, directions far from any member by `offset` alone, and the
    radius runs linearly between them; a five-wide median and a lower limit of `offset` follow. Members are first
    reduced to the outermost angles of each angular slot, so a cluster of any size enters the ordered part as a fixed
    number of rows.
    """
    key = ["zone", "label"]
    centre = centroids(members).drop("n")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    angle = F.atan2(dy, dx)
    turned = F.when(angle >= F.pi(), -F.pi()).otherwise(angle)
    polar = members.join(centre, key).select(*key, "id", turned.alias("a"), (F.hypot(dx, dy) + offset).alias("rad"))
    step = 2 * F.pi() / (resolution - 1)
    gap = F.radians(F.lit(min_gap_deg))
    top = polar.groupBy(*key).agg(F.max("rad").alias("top"))

    slot = F.floor((F.col("a") + F.pi()) / step)
    edge = polar.groupBy(*key, slot.alias("slot")).agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    near = F.ceil(gap / step).cast("int") + 1
    blocked = (
        edge.withColumn("i", F.explode(F.sequence(F.col("slot") - near, F.col("slot") + near + 1)))
        .withColumn("va", -F.pi() + F.col("i") * step)
        .where((F.abs(F.col("va") - F.col("lo")) < gap) | (F.abs(F.col("va") - F.col("hi")) < gap) | ((F.col("lo") < F.col("va")) & (F.col("va") < F.col("hi"))))
        .select(*key, "i")
        .distinct()
    )
    virtual = (
        top.select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(resolution - 1).cast("bigint"))).alias("i"))
        .join(blocked, key + ["i"], "left_anti")
        .select(*key, (-F.pi() + F.col("i") * step).alias("a"), F.lit(offset).alias("rad"), F.lit(-1).cast("bigint").alias("id"))
    )
    known = polar.select(*key, "a", "rad", "id").unionByName(virtual)
    span = known.groupBy(*key).agg(F.min("a").alias("a0"), F.min_by("rad", F.struct("a", "id")).alias("r0"))
    # The curve runs from the smallest angle once round; output angle j lies between the last known angle at or
    # before it and the first one after it. Only the two ends of each output slot can be either.
    fine = 2 * F.pi() / (2 * resolution - 1)
    at = known.join(span.select(*key, "a0"), key)
    cell = at.groupBy(*key, F.least(F.floor((F.col("a") - F.col("a0")) / fine), F.lit(2 * resolution - 2)).alias("j")).agg(
        F.min_by(F.struct("a", "rad"), F.struct("a", "id")).alias("first"),
        F.max_by(F.struct("a", "rad"), F.struct("a", "id")).alias("last"),
    )
    grid = span.join(top, key).select(*key, "a0", "r0", "top", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2 * resolution - 1).cast("bigint"))).alias("j"))
    rows = grid.join(cell, key + ["j"], "left")
    along = Window.partitionBy(*key).orderBy("j")
    back = Window.partitionBy(*key).orderBy(F.desc("j"))
    theta = F.col("a0") + F.col("j") * fine
    wrap = F.struct((F.col("a0") + 2 * F.pi()).alias("a"), F.col("r0").alias("rad"))
    exact = F.when(F.col("first.a") <= theta, F.col("first"))
    before = F.coalesce(exact, F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.col("first"))
    after = F.coalesce(F.when(F.col("first.a") > theta, F.col("first")), F.last("first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)), wrap)
    traced = rows.withColumn("theta", theta).withColumn("p", before).withColumn("n", after)
    share = F.when(F.col("n.a") > F.col("p.a"), (F.col("theta") - F.col("p.a")) / (F.col("n.a") - F.col("p.a"))).otherwise(F.lit(0.0))
    radius = F.col("p.rad") + (F.col("n.rad") - F.col("p.rad")) * share
    clipped = traced.withColumn("rad", F.greatest(F.lit(0.0), F.least(radius, F.col("top") + offset)))
    five = F.array_sort(F.array(*[F.coalesce(F.lag("rad", k).over(along) if k >= 0 else F.lead("rad", -k).over(along), F.lit(0.0)) for k in (2, 1, 0, -1, -2)]))
    smooth = clipped.withColumn("rad", F.greatest(five[2], F.lit(offset)))
    return smooth.join(centre, key).select(
        *key, F.col("j").cast("int").alias("pos"), (F.col("cx") + F.col("rad") * F.cos("theta")).alias("x"), (F.col("cy") + F.col("rad") * F.sin("theta")).alias("y")
    )


def summary(rings: DataFrame) -> DataFrame:
    return rings.select("zone", "label", "cx", "cy", ring_area(F.col("ring")).alias("area"))


def shared_cells(cells: DataFrame, size: float) -> DataFrame:
    """Cells two clusters both occupy, and their area: (label_a, label_b, shared, area).

    Each cell lists its distinct clusters once, so the pairs made are pairs of clusters that really meet.
    """
    once = cells.select("label", "q", "r").distinct()
    a, b = once.withColumnRenamed("label", "label_a"), once.withColumnRenamed("label", "label_b")
    met = a.join(b, ["q", "r"]).where("label_a < label_b")
    area = 3 * 3**0.5 / 2 * size**2
    return met.groupBy("label_a", "label_b").agg(F.count("*").alias("shared"), (F.count("*") * area).alias("area"))
