"""Pairs, forests, paths and betweenness against small brute-force versions."""

import heapq
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from aerolattice.functions.hexmath import DIRECTIONS
from aerolattice.operators import forest, graph, metrics, pairs, routing
from aerolattice.plans.routes import plan_routes


def dist(a, b):
    return max(abs(a[0] - b[0]), abs(a[1] - b[1]), abs(a[0] + a[1] - b[0] - b[1]))


def random_terminals(seed, n=40, spread=12):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(-spread, spread), rnd.randint(-spread, spread)) for i in range(n)]
    # A third of all terminals share one cell.
    return rows + [(n + i, 3, 3) for i in range(n // 2)]


def as_df(spark, rows):
    return spark.createDataFrame(rows, "feature_id bigint, q int, r int")


def pair_set(df):
    return {((x.aq, x.ar), (x.bq, x.br)) for x in df.collect()}


def spanning_weights(cells):
    """Sorted edge weights of a minimum spanning tree, which all such trees share."""
    rest, tree, out = set(cells[1:]), {cells[0]}, []
    while rest:
        w, b = min((dist(a, b), b) for a in tree for b in rest)
        out.append(w)
        rest.remove(b)
        tree.add(b)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_backbone_is_a_minimum_tree(spark, seed):
    rows = random_terminals(seed)
    got = pair_set(pairs.backbone_pairs(as_df(spark, rows)))
    cells = sorted({(q, r) for _, q, r in rows})
    loops = {p for p in got if p[0] == p[1]}
    copied = {c for c in cells if sum((q, r) == c for _, q, r in rows) > 1}
    assert {p[0] for p in loops} == copied
    assert sorted(dist(*p) for p in got - loops) == spanning_weights(cells)


def test_nearest_terminal_field(spark):
    rows = random_terminals(5, 12, 9)
    cells = {(q, r) for _, q, r in rows}
    field = pairs.nearest_terminal(as_df(spark, rows)).collect()
    assert field and all(x.d == min(dist((x.q, x.r), c) for c in cells) for x in field)


@pytest.mark.parametrize("k", [1, 3])
def test_knn_with_copies(spark, k):
    rows = random_terminals(3)
    want = set()
    for i, q, r in rows:
        others = sorted((x for x in rows if x[1:] != (q, r)), key=lambda x: (dist((q, r), x[1:]), x[0]))
        for _, bq, br in others[:k]:
            want.add(tuple(sorted([(q, r), (bq, br)])))
    assert pair_set(pairs.knn_pairs(as_df(spark, rows), k)) == want


def test_all_pairs_profile(spark):
    rows = random_terminals(7, 15, 4)
    want = {}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            want.setdefault(rows[i][1:], set()).add(rows[j][1:])
    got = {(x.q, x.r): x.pairs for x in pairs.all_pairs_profile(as_df(spark, rows)).collect()}
    assert got == {c: len(want.get(c, ())) for c in {x[1:] for x in rows}}


def test_connected_pairs_join_all(spark):
    rows = as_df(spark, random_terminals(4))
    joined = pair_set(pairs.connected_pairs(rows, pairs.knn_pairs(rows, 1)))
    seen, todo = set(), [next(iter(joined))[0]]
    while todo:
        cell = todo.pop()
        if cell not in seen:
            seen.add(cell)
            todo += [b if a == cell else a for a, b in joined if cell in (a, b)]
    assert seen == {(x.q, x.r) for x in rows.collect()}


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        pairs.build_pairs(as_df(spark, [(1, 0, 0)]), "ring")


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame(chain + star, "u bigint, v bigint")
    vertices = spark.createDataFrame([(i,) for i in list(range(61)) + list(range(1000, 1200)) + [5000]], "v bigint")
    got = {x.v: x.label for x in forest.components(vertices, edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1200)) and got[5000] == 5000


def blocked_grid(seed, n=7, share=0.25, costs=(1.0,)):
    rnd = random.Random(seed)
    cells = [(q, r, rnd.choice(costs)) for q in range(-n, n + 1) for r in range(-n, n + 1)]
    return [c for c in cells if rnd.random() > share]


def dijkstra(vertices, source):
    cost = {(q, r): c for q, r, c in vertices}
    best, queue = {source: 0.0}, [(0.0, source)]
    while queue:
        g, (q, r) = heapq.heappop(queue)
        if g > best[(q, r)]:
            continue
        for dq, dr in DIRECTIONS:
            to = (q + dq, r + dr)
            if to in cost:
                h = g + 1 + 0.5 * (cost[(q, r)] + cost[to])
                if h < best.get(to, float("inf")):
                    best[to] = h
                    heapq.heappush(queue, (h, to))
    return best


@pytest.mark.parametrize("costs", [(1.0,), (0.0, 1.0, 4.0)])
def test_shortest_paths(spark, costs):
    vertices = blocked_grid(11, costs=costs)
    rnd = random.Random(1)
    ends = [(rnd.choice(vertices)[:2], rnd.choice(vertices)[:2]) for _ in range(12)]
    ends += [((99, 99), ends[0][0]), (ends[0][0], ends[0][0])]
    table = spark.createDataFrame([a + b for a, b in ends], "aq int, ar int, bq int, br int")
    grid = spark.createDataFrame(vertices, "q int, r int, cost double")
    got = {((x.aq, x.ar), (x.bq, x.br)): x for x in routing.shortest_paths(table, grid).collect()}
    known = {(q, r) for q, r, _ in vertices}
    for a, b in ends:
        best = dijkstra(vertices, a).get(b) if a in known and b in known else None
        if best is None:
            assert (a, b) not in got
            continue
        row = got[(a, b)]
        cells = [tuple(c) for c in row.cells]
        assert row.cost == pytest.approx(best)
        assert cells[0] == a and cells[-1] == b and set(cells) <= known
        assert all(dist(x, y) == 1 for x, y in zip(cells, cells[1:]))


def test_betweenness(spark):
    rnd = random.Random(2)
    cells = [c[:2] for c in blocked_grid(3, n=3, share=0.3)]
    edges = sorted({tuple(sorted([a, (a[0] + d[0], a[1] + d[1])])) for a in cells for d in DIRECTIONS if (a[0] + d[0], a[1] + d[1]) in cells})
    edges = [e for e in edges if rnd.random() < 0.8]
    want = {}
    nodes = sorted({c for e in edges for c in e})
    near = {c: sorted({b if a == c else a for a, b in edges if c in (a, b)}) for c in nodes}
    for s in nodes:
        level, parent, queue = {s: 0}, {}, deque([s])
        while queue:
            at = queue.popleft()
            for to in near[at]:
                if to not in level:
                    level[to] = level[at] + 1
                    queue.append(to)
        for v in level:
            if v != s:
                parent[v] = min(u for u in near[v] if level.get(u) == level[v] - 1)
        for t in level:
            if t > s:
                at = parent[t]
                while at != s:
                    want[at] = want.get(at, 0) + 1
                    at = parent[at]
    table = spark.createDataFrame([a + b for a, b in edges], "aq int, ar int, bq int, br int")
    assert {(x.q, x.r): x.visits for x in metrics.betweenness(table).collect()} == want


def test_plan_routes_avoids_restricted_cells(spark):
    cells = spark.createDataFrame(
        [(q, r, 1.0, q == 0 and r != 3) for q in range(-4, 5) for r in range(-4, 5)], "q int, r int, cost double, restricted boolean"
    )
    plan = plan_routes(cells, as_df(spark, [(1, -3, -3), (2, 3, 2), (3, -3, 2)]), "Single-Linkage_HAC")
    routes = plan.paths.collect()
    assert len(routes) == 2
    for route in routes:
        assert all(c.q != 0 or c.r == 3 for c in route.cells)
        assert route.cost == 2 * (len(route.cells) - 1)
    assert plan.terminal_edges.count() == 2
    flags = {(x.q, x.r): x.is_terminal for x in plan.route_vertices.collect()}
    assert flags[(-3, -3)] and sum(flags.values()) == 3


def test_one_cell_path_has_no_graph_vertex(spark):
    paths = spark.createDataFrame([(1, [(0, 0)]), (2, [(0, 1), (0, 2)])], "path_id bigint, cells array<struct<q:int,r:int>>")
    assert {(x.q, x.r) for x in graph.g1_vertices(paths).collect()} == {(0, 1), (0, 2)}
    assert graph.average_path_length(paths).first()[0] == 0.5
    assert graph.average_path_length(paths.where("path_id = 9")).first()[0] == 0.0
    weights = graph.path_weights(paths, spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, float("inf"))], "q int, r int, cost double"))
    assert {x.path_id: x.weight for x in weights.select("path_id", F.col("weight")).collect()} == {1: 0.0, 2: float("inf")}
