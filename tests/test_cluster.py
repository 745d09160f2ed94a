"""Clustering against brute force."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from aerolattice import runtime
from aerolattice.operators import cluster


def cloud(seed, n=60):
    """Two zones; a third of zone 0 sits on one position, and one dense blob holds many of the rest."""
    rnd = random.Random(seed)
    rows = [(0, i, round(rnd.gauss(0, 3), 2), round(rnd.gauss(0, 3), 2)) for i in range(n // 2)]
    rows += [(0, n + i, round(rnd.uniform(-300, 300), 2), round(rnd.uniform(-300, 300), 2)) for i in range(n // 2)]
    rows += [(0, 2 * n + i, 40.0, 40.0) for i in range(n // 2)]
    rows += [(1, 3 * n + i, round(rnd.uniform(0, 100), 2), round(rnd.uniform(0, 100), 2)) for i in range(n // 4)]
    return rows


def cores_of(rows, k):
    out = {}
    for zone, i, x, y in rows:
        near = sorted(math.dist((x, y), (b[2], b[3])) for b in rows if b[0] == zone and b[1] != i)
        out[i] = near[k - 1] if len(near) >= k else None
    return out


def tree_weights(rows, cores):
    rows = list(rows)
    inside, rest, out = [rows[0]], rows[1:], []

    def reach(a, b):
        return max(cores[a[1]], cores[b[1]], math.dist(a[2:], b[2:]))

    while rest:
        w, j = min((min(reach(a, b) for a in inside), j) for j, b in enumerate(rest))
        out.append(w)
        inside.append(rest.pop(j))
    return sorted(out)


@pytest.mark.parametrize("work", [4096, 16])
def test_tree_and_cores(spark, monkeypatch, work):
    monkeypatch.setattr(cluster, "PAIR_WORK", work)
    rows = cloud(3)
    df = spark.createDataFrame(rows, "zone int, id bigint, x double, y double")
    cores = cores_of(rows, 2)
    assert {r.id: pytest.approx(r.core) for r in cluster.core_distances(df, 2, 8.0).collect()} == cores
    tree = cluster.mutual_reach_tree(df, 2, 8.0).collect()
    zone_of = {i: z for z, i, _, _ in rows}
    for zone in (0, 1):
        got = sorted(e.w for e in tree if zone_of[e.u] == zone)
        assert got == pytest.approx(tree_weights([r for r in rows if r[0] == zone], cores))


def test_pairs_grow_with_points_where_all_stand_close(spark, monkeypatch):
    rnd, made, kept = random.Random(7), [], cluster._kept
    rows = [(0, i, round(rnd.uniform(0, 100), 2), round(rnd.uniform(0, 100), 2)) for i in range(300)]

    def counted(pairs, limit):
        made.append(pairs.count())
        return kept(pairs, limit)

    monkeypatch.setattr(cluster, "_kept", counted)
    df = spark.createDataFrame(rows, "zone int, id bigint, x double, y double")
    tree = cluster.mutual_reach_tree(df, 2, 256.0).collect()
    assert max(made) < 60 * len(rows)  # 44,850 when all meet all
    assert sorted(e.w for e in tree) == pytest.approx(tree_weights(rows, cores_of(rows, 2)))


def static_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_a_tree_broadcast_by_measured_sizes(spark, monkeypatch):
    """Rows that an explode makes of a table with a small file are not taken for as small as the file."""
    wide = runtime.pinned(spark.range(300_000).select("id", (F.col("id") * 7919 % 300_007).alias("other")))

    def exploded():
        nine = wide.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8))))
        return wide.withColumnRenamed("id", "c").join(nine.select((F.col("id") + F.col("i")).alias("c"), F.col("other").alias("o")), "c")

    plans, closest = [], cluster._closest_links

    def watched(*args):
        plans.append(static_plan(exploded()))
        return closest(*args)

    assert "BroadcastHashJoin" in static_plan(exploded())
    monkeypatch.setattr(cluster, "_closest_links", watched)
    df = spark.createDataFrame(cloud(5, 20), "zone int, id bigint, x double, y double")
    cluster.mutual_reach_tree(df, 2, 256.0)
    assert plans and not any("BroadcastHashJoin" in x for x in plans)
    assert "BroadcastHashJoin" in static_plan(exploded())  # the session's own settings are back


def test_cut_and_members(spark):
    rows = [(0, i, float(i), 0.0) for i in range(5)] + [(0, 10 + i, 500.0 + i, 0.0) for i in range(4)] + [(0, 99, 5000.0, 0.0)]
    rows += [(1, 200, 0.0, 0.0), (1, 201, 90.0, 0.0)]
    df = spark.createDataFrame(rows, "zone int, id bigint, x double, y double")
    labels = cluster.cut_labels(df, cluster.mutual_reach_tree(df, 2, 4.0), 50.0, 2)
    got = {r.id: r.label for r in labels.collect()}
    assert {got[i] for i in range(5)} == {0} and {got[i] for i in range(10, 14)} == {10} and got[99] == -1
    found = {(r.zone, r.label): r.n for r in cluster.centroids(cluster.zone_members(df, labels, 2)).collect()}
    assert found == {(0, 0): 5, (0, 10): 4, (1, 200): 2}


def supports(points, offset=80.0, virtual=360, gap=np.radians(20)):
    """Known (angle, radius) pairs of an outline: the points' own, and the offset wherever a wide gap has none."""
    centre = np.mean(points, axis=0)
    own = []
    for x, y in np.array(points) - centre:
        turn = np.arctan2(y, x)
        own.append((turn if turn < np.pi else -np.pi, np.hypot(x, y) + offset))
    step = 2 * np.pi / (virtual - 1)
    bare = [-np.pi + k * step for k in range(virtual)]
    bare = [(v, offset) for v in bare if min(abs(v - a) for a, _ in own) >= gap]
    return centre, sorted(own + bare)


def radius_at(known, angle):
    """Radius between the two known angles that enclose the angle, going round once."""
    ring = known + [(known[0][0] + 2 * np.pi, known[0][1])]
    for (a, ra), (b, rb) in zip(ring, ring[1:], strict=False):
        if a <= angle <= b and b > a:
            return ra + (rb - ra) * (angle - a) / (b - a)
    return ring[-1][1]


@pytest.mark.parametrize("seed,n", [(1, 3), (2, 12), (3, 400)])
def test_outline(spark, seed, n):
    rnd = random.Random(seed)
    points = [(rnd.uniform(-500, 500), rnd.uniform(-200, 200)) for _ in range(n)]
    rows = [(0, 7, i, x, y) for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "zone int, label bigint, id bigint, x double, y double")
    got = np.array([(r.x, r.y) for r in sorted(cluster.radial_boundary(df).collect(), key=lambda r: r.pos)])
    assert got.shape == (720, 2)
    centre, known = supports(points)
    away = np.hypot(*(got - centre).T)
    first, turn = known[0][0], 2 * np.pi / 719
    raw = [radius_at(known, first + k * turn) for k in range(720)]
    assert (away >= 80 - 1e-6).all() and (away <= max(r for _, r in known) + 1e-6).all()
    for k in range(720):  # each is the median of the five radii around it, beyond the ends counted as nothing
        five = [raw[j] if 0 <= j < 720 else 0.0 for j in range(k - 2, k + 3)]
        assert away[k] == pytest.approx(max(80.0, float(np.median(five))), abs=1e-6)
        angle = np.arctan2(*(got[k] - centre)[::-1])
        assert np.cos(angle - first - k * turn) == pytest.approx(1, abs=1e-9)
