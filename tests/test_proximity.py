"""Neighbours through the adaptive quadtree against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from aerolattice.operators import cluster, proximity


def scattered(seed):
    """Spots of widths from a millionth to thousands, one line, and lone points; two zones."""
    draw = random.Random(seed)
    rows = [(draw.gauss(c, s), draw.gauss(c, s)) for c, s, n in [(0, 1e-6, 80), (5, 1, 80), (900, 400, 80)] for _ in range(n)]
    rows += [(float(i), -50.0) for i in range(40)] + [(1e6, 1e6), (-3e5, 0.0), (0.5, 0.5)]
    return [(0, i, u, v) for i, (u, v) in enumerate(rows)] + [(1, 1000 + i, u, v) for i, (u, v) in enumerate(rows[:3])]


@pytest.mark.parametrize("k, base", [(2, 64.0), (7, 1.0)])
def test_k_nearest_are_among_the_candidates(spark, k, base):
    rows = scattered(k)
    points = spark.createDataFrame([(*r, 1) for r in rows], "zone int, id bigint, u double, v double, m bigint")
    found = {}
    for r in proximity.near_candidates(points, k, base, cluster.euclid).collect():
        assert (r.id, r.other) not in found
        found[r.id, r.other] = r.d
    for zone, i, u, v in rows:
        near = sorted((math.dist((u, v), p[2:]), p[1]) for p in rows if p[0] == zone and p[1] != i)
        want = [p for p in near if len(near) <= k or p[0] <= near[k - 1][0]]
        assert all(found[i, j] == pytest.approx(d) for d, j in want)


def test_a_crowded_bucket_makes_few_candidates(spark):
    """Twenty thousand points within one bucket of the given width, and a few around it."""
    points = spark.range(20_000).select(F.lit(0).alias("zone"), "id", (F.rand(1) * 30).alias("u"), (F.rand(2) * 30).alias("v"), F.lit(1).alias("m"))
    far = spark.createDataFrame([(0, -1, 9e3, 0.0, 1), (0, -2, 9e3, 5.0, 1), (0, -3, -9e3, 0.0, 1)], "zone int, id bigint, u double, v double, m int")
    assert proximity.near_candidates(points.unionByName(far), 2, 64.0, cluster.euclid).count() < 20_000 * 20


def test_leaves_are_the_widest_that_hold_few(spark):
    rows = scattered(1)
    points = spark.createDataFrame(rows, "zone int, id bigint, u double, v double")
    placed = proximity.leaves(points, 16, 8.0).collect()
    assert sorted(r.id for r in placed) == sorted(r[1] for r in rows)
    top = max(r.level for r in placed)
    for r in placed:
        for level, few in ((r.level, True), (r.level + 1, False)):
            side = 8.0 * 2.0**level
            held = sum(p[0] == r.zone and math.floor(p[2] / side) == math.floor(r.u / side) and math.floor(p[3] / side) == math.floor(r.v / side) for p in rows)
            assert held <= 16 if few else (held > 16 or r.level == top)


def test_no_and_single_points(spark):
    points = spark.createDataFrame([(0, 1, 3.0, 4.0, 1)], "zone int, id bigint, u double, v double, m bigint")
    assert proximity.near_candidates(points, 2, 64.0, cluster.euclid).count() == 0
    assert proximity.near_candidates(points.limit(0), 2, 64.0, cluster.euclid).count() == 0
