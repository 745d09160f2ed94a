"""Dendrogram, condensed clusters and their selection against a plain hierarchy."""

import random
from collections import Counter, defaultdict

import pytest
from test_cluster import cloud

from aerolattice.operators import cluster, hierarchy


def merged(edges):
    """Nodes of single linkage in order: (w, members, children as node numbers or None)."""
    nodes, where = [], {}
    for w, u, v in sorted((w, u, v) for u, v, w in edges):
        sides = [where.get(x, (None, frozenset([x]))) for x in (u, v)]
        members = sides[0][1] | sides[1][1]
        nodes.append((w, members, [s[0] for s in sides]))
        for x in members:
            where[x] = (len(nodes) - 1, members)
    return nodes


def labelled(edges, smallest):
    """Label of every point by walking the condensed tree from its root, as the published definition has it."""
    nodes, out = merged(edges), {}
    parents = {c: i for i, (_, _, kids) in enumerate(nodes) for c in kids if c is not None}

    def big(i):
        return i is not None and len(nodes[i][1]) >= smallest

    def grown(top, born):
        """Stability, then what can be made of the cluster: (zero, mass), its selected sets."""
        zero, mass, i = 0, 0.0, top
        while True:
            w, members, kids = nodes[i]
            large = [k for k in kids if big(k)]
            left = len(members) - (len(nodes[large[0]][1]) if len(large) == 1 else 0)
            if w > 0:
                mass += left * (1 / w - born)
            else:
                zero += left
            if len(large) == 1:
                i = large[0]
                continue
            below = [grown(k, 1 / w) for k in large]
            total = (sum(b[0][0] for b in below), sum(b[0][1] for b in below))
            sets = [s for b in below for s in b[1]]
            return ((zero, mass), [nodes[top][1]], total, sets) if not below or (zero, mass) >= total else (total, sets, total, sets)

    for root in set(range(len(nodes))) - set(parents):
        if big(root):
            _, _, _, sets = grown(root, 0.0)
            for s in sets:
                out |= {x: min(s) for x in s}
    return out


def shaped(kind, n, seed):
    draw = random.Random(seed)
    if kind == "rising":
        return [(i, i + 1, float(i + 1)) for i in range(n)]
    if kind == "random":
        return [(draw.randrange(i), i, draw.random() + 0.01) for i in range(1, n)]
    if kind == "ties":
        return [(draw.randrange(i), i, float(draw.randrange(1, 4))) for i in range(1, n)]
    if kind == "zeros":
        return [(draw.randrange(i), i, max(0.0, draw.random() - 0.3)) for i in range(1, n)]
    if kind == "comb":  # pairs at rising distances: every split hangs on the one above
        return [(2 * i, 2 * i + 1, 0.1 + 0.001 * draw.random()) for i in range(n)] + [(2 * i, 2 * i + 2, 1.0 + i + draw.random()) for i in range(n - 1)]
    raise ValueError(kind)


def test_dendrogram_and_labels(spark):
    kinds = ["rising", "random", "ties", "zeros", "comb"]
    edges = [(u + 1000 * k, v + 1000 * k, w) for k, kind in enumerate(kinds) for u, v, w in shaped(kind, 60, 5)]
    tree = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    nodes, leaves = hierarchy.dendrogram(tree)
    want = merged(edges)
    rows = sorted(nodes.collect(), key=lambda r: r.e)
    assert [(r.w, r.size) for r in rows] == [(w, len(m)) for w, m, _ in want]
    order = {r.e: i for i, r in enumerate(rows)}
    parents = {c: i for i, (_, _, kids) in enumerate(want) for c in kids if c is not None}
    assert {order[r.e]: order[r.parent] for r in rows if r.parent is not None} == parents
    first = {}
    for i, (_, members, _) in enumerate(want):
        for x in members:
            first.setdefault(x, i)
    assert {r.v: order[r.e] for r in leaves.collect()} == first
    points = spark.createDataFrame([(0, x) for x in first] + [(1, -7)], "zone int, id bigint")
    for smallest in (2, 4):
        got = {r.id: r.label for r in hierarchy.density_labels(points, tree, smallest).collect()}
        assert got == dict.fromkeys([*first, -7], -1) | labelled(edges, smallest)


def test_clouds_of_mixed_density(spark):
    rows = cloud(4)
    draw = random.Random(8)
    rows += [(2, 1000 + i, draw.gauss(c, s), draw.gauss(c, s)) for i, (c, s) in enumerate([(0, 1), (60, 12), (62, 0.5)] * 15)]
    points = spark.createDataFrame(rows, "zone int, id bigint, x double, y double")
    tree = cluster.mutual_reach_tree(points, 2, 8.0)
    edges = [tuple(r) for r in tree.select("u", "v", "w").collect()]
    got = {r.id: r.label for r in hierarchy.density_labels(points, tree, 2).collect()}
    want = labelled(edges, 2)
    assert got == {i: want.get(i, -1) for _, i, _, _ in rows}
    assert len(set(want.values())) > 5 and Counter(got.values())[-1] > 0


def test_no_edges(spark):
    points = spark.createDataFrame([(0, 1)], "zone int, id bigint")
    tree = spark.createDataFrame([], "u bigint, v bigint, w double")
    assert [r.label for r in hierarchy.density_labels(points, tree, 2).collect()] == [-1]
    assert hierarchy.density_labels(points.limit(0), tree, 2).count() == 0
