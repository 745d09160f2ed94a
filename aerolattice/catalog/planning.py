"""Siting, graph, routing, metric and scene queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolattice.catalog import fixtures as fx
from aerolattice.catalog.fixtures import COARSE, centre_sql, with_views
from aerolattice.catalog.geometry import r6, s6
from aerolattice.catalog.registry import c, num, query
from aerolattice.functions import hexmath as hx
from aerolattice.functions.hexmath import CELL_SIZE
from aerolattice.operators import graph, metrics, pairs, routing, scene, sites
from aerolattice.operators.forest import components
from aerolattice.plans.routes import interconnect, plan_routes
from aerolattice.runtime import pinned

# restrictions and siting


@query("restricted_cells", with_views("hcells", "SELECT q, r FROM hcells"))
def restricted_cells(spark, d):
    return sites.restricted_cells(fx.Site(spark, d).heliport_cells())


DELTA_VIEWS = """before_cells AS (SELECT DISTINCT q + CAST(feature_id % 2 AS INT) AS q, r FROM placed WHERE layer = 'heliport'),
delta AS (SELECT coalesce(a.q, b.q) AS q, coalesce(a.r, b.r) AS r,
                 CASE WHEN b.q IS NULL THEN 'added' WHEN a.q IS NULL THEN 'removed' ELSE 'kept' END AS change
          FROM hcells a FULL JOIN before_cells b ON a.q = b.q AND a.r = b.r)"""


def with_delta(names, body):
    return with_views(names, "").rstrip() + ",\n" + DELTA_VIEWS + "\n" + body


def earlier_and_now(site):
    """Heliport cells, and an earlier state in which every odd heliport stood one cell further along q."""
    now = site.heliport_cells()
    before = now.select((c.q + (c.feature_id % 2).cast("int")).alias("q"), "r").distinct()
    return before, sites.restricted_cells(now)


@query("restriction_delta", with_delta("hcells", "SELECT q, r, change FROM delta"))
def restriction_delta(spark, d):
    return sites.restriction_delta(*earlier_and_now(fx.Site(spark, d)))


@query(
    "apply_restrictions",
    with_delta(
        "cells hcells",
        """SELECT c.q, c.r, CASE change WHEN 'added' THEN true WHEN 'removed' THEN false ELSE b.q IS NOT NULL END AS restricted
           FROM cells c LEFT JOIN before_cells b ON b.q = c.q AND b.r = c.r LEFT JOIN delta d ON d.q = c.q AND d.r = c.r""",
    ),
)
def apply_restrictions(spark, d):
    site = fx.Site(spark, d)
    before, now = earlier_and_now(site)
    blank = site.cells().withColumn("restricted", F.lit(False))
    state = sites.apply_restrictions(blank, before.withColumn("change", F.lit("added")))
    return sites.apply_restrictions(state, sites.restriction_delta(before, now)).select("q", "r", "restricted")


@query("traversable_cells", with_views("g0v", "SELECT q, r FROM g0v"))
def traversable_cells(spark, d):
    return sites.traversable(fx.Site(spark, d).grid_state()).select("q", "r")


@query(
    "site_conflicts",
    with_views("vterm hcells", "SELECT feature_id, q, r FROM vterm v WHERE NOT EXISTS (SELECT 1 FROM hcells h WHERE h.q = v.q AND h.r = v.r)"),
)
def site_conflicts(spark, d):
    site = fx.Site(spark, d)
    return sites.without_conflicts(site.terminals(), site.heliport_cells()).select("feature_id", "q", "r")


@query("cell_available", with_views("g0v hcells", "SELECT q, r FROM g0v EXCEPT SELECT q, r FROM hcells"))
def cell_available(spark, d):
    site = fx.Site(spark, d)
    return sites.available_cells(site.grid_state(), site.heliport_cells()).select("q", "r")


@query("is_heliport_cell", with_views("cells hcells", "SELECT q, r FROM cells INTERSECT SELECT q, r FROM hcells"))
def is_heliport_cell(spark, d):
    site = fx.Site(spark, d)
    return sites.holding(site.cells(), site.heliport_cells()).select("q", "r")


@query("cells_on_route", with_views("cells fx_paths", "SELECT q, r FROM cells INTERSECT SELECT q, r FROM fx_paths"))
def cells_on_route(spark, d):
    site = fx.Site(spark, d)
    return graph.cells_on_routes(site.cells(), site.paths()).select("q", "r")


@query(
    "random_block",
    with_views(
        "cells vterm",
        """SELECT q, r FROM cells WHERE ((q * 7919 + r * 104729) % 1000 + 1000) % 1000 < 150
           AND NOT EXISTS (SELECT 1 FROM vterm v WHERE v.q = cells.q AND v.r = cells.r)""",
    ),
)
def random_block(spark, d):
    """A repeatable sample of 15 percent of the cells, without the terminals' own, to be blocked."""
    site = fx.Site(spark, d)
    return sites.blocked_share(site.cells(), 0.15).join(site.terminals(), ["q", "r"], "left_anti").select("q", "r")


# graphs


@query("g0_vertices", with_views("g0v", "SELECT q, r, cost, row_number() OVER (ORDER BY q, r) - 1 AS vid FROM g0v"))
def g0_vertices(spark, d):
    return graph.vertex_ids(graph.g0_vertices(fx.Site(spark, d).grid_state()).select("q", "r", "cost"))


@query("g0_edges", with_views("g0e", "SELECT q, r, nq, nr FROM g0e"))
def g0_edges(spark, d):
    return graph.g0_edges(fx.Site(spark, d).vertices()).select("q", "r", "nq", "nr")


@query(
    "edge_weight",
    with_views("grid_state dirs", """SELECT a.q, a.r, b.q AS nq, b.r AS nr, 1e0 + 5e-1 * (a.cost + b.cost) AS weight
        FROM (SELECT q, r, CASE WHEN restricted THEN CAST('inf' AS DOUBLE) ELSE cost END AS cost FROM grid_state) a, dirs d,
             (SELECT q, r, CASE WHEN restricted THEN CAST('inf' AS DOUBLE) ELSE cost END AS cost FROM grid_state) b
        WHERE b.q = a.q + d.dq AND b.r = a.r + d.dr AND (b.q > a.q OR (b.q = a.q AND b.r > a.r))"""),
)
def edge_weight(spark, d):
    from aerolattice.operators.grid import cell_costs

    return graph.weighted_edges(graph.g0_edges(cell_costs(fx.Site(spark, d).grid_state())))


@query(
    "path_weight",
    with_views(
        "fx_hops grid_state",
        """SELECT h.path_id, sum(1e0 + 5e-1 * (CASE WHEN a.restricted THEN CAST('inf' AS DOUBLE) ELSE a.cost END
                                              + CASE WHEN b.restricted THEN CAST('inf' AS DOUBLE) ELSE b.cost END)) AS weight
           FROM fx_hops h JOIN grid_state a ON a.q = h.aq AND a.r = h.ar JOIN grid_state b ON b.q = h.bq AND b.r = h.br GROUP BY h.path_id""",
    ),
)
def path_weight(spark, d):
    from aerolattice.operators.grid import cell_costs

    site = fx.Site(spark, d)
    return graph.path_weights(site.paths(), cell_costs(site.grid_state()))


@query("terminals", with_views("vterm", "SELECT feature_id, q, r FROM vterm"))
def terminals(spark, d):
    return fx.Site(spark, d).terminals()


@query(
    "pairs_all",
    with_views(
        "vterm",
        """SELECT p.q, p.r, m.members, p.pairs FROM (
             SELECT a.q, a.r, count(DISTINCT CASE WHEN b.q IS NULL THEN NULL ELSE b.q * 100000 + b.r END) AS pairs
             FROM vterm a LEFT JOIN vterm b ON a.feature_id < b.feature_id GROUP BY a.q, a.r) p
           JOIN (SELECT q, r, count(*) AS members FROM vterm GROUP BY q, r) m ON m.q = p.q AND m.r = p.r""",
    ),
)
def pairs_all(spark, d):
    return pairs.all_pairs_profile(fx.Site(spark, d).terminals())


KNN_SQL = """SELECT DISTINCT CASE WHEN less THEN q ELSE bq END AS aq, CASE WHEN less THEN r ELSE br END AS ar,
       CASE WHEN less THEN bq ELSE q END AS bq, CASE WHEN less THEN br ELSE r END AS br
FROM (SELECT *, (q < bq OR (q = bq AND r < br)) AS less FROM (
  SELECT a.feature_id, a.q, a.r, b.q AS bq, b.r AS br,
         row_number() OVER (PARTITION BY a.feature_id ORDER BY greatest(abs(a.q - b.q), abs(a.r - b.r), abs(a.q + a.r - b.q - b.r)), b.feature_id) AS n
  FROM vterm a JOIN vterm b ON a.q <> b.q OR a.r <> b.r) WHERE n <= 2)"""


@query("pairs_knn", with_views("vterm", KNN_SQL))
def pairs_knn(spark, d):
    return pairs.knn_pairs(fx.Site(spark, d).terminals(), 2)


@query("pairs_mst")
def pairs_mst(spark, d):
    return pairs.backbone_pairs(fx.Site(spark, d).terminals())


TOUCHING = """cell AS (SELECT DISTINCT q, r FROM vterm),
step AS (SELECT a.q, a.r, b.q AS nq, b.r AS nr, greatest(abs(a.q - b.q), abs(a.r - b.r), abs(a.q + a.r - b.q - b.r)) AS far
         FROM cell a JOIN cell b ON a.q <> b.q OR a.r <> b.r)"""


@query(
    "components",
    with_views(
        "vterm",
        """SELECT q, r, CAST(floor(min(root) / 100000e0) AS INT) AS label_q, CAST(min(root) - floor(min(root) / 100000e0) * 100000 - 50000 AS INT) AS label_r
           FROM walk GROUP BY q, r""",
        recursive=TOUCHING
        + """,
walk(q, r, root) AS (SELECT q, r, CAST(q AS BIGINT) * 100000 + r + 50000 FROM cell
                     UNION SELECT s.nq, s.nr, w.root FROM walk w JOIN step s ON s.q = w.q AND s.r = w.r AND s.far = 1)""",
    ),
)
def components_query(spark, d):
    """Terminal cells joined when they touch."""
    at = pinned(fx.Site(spark, d).terminals().select("q", "r").distinct())
    edges = graph.g0_edges(at.withColumn("cost", F.lit(1.0)))
    labels = components(
        at.select(hx.pack(c.q, c.r).alias("v")),
        edges.select(hx.pack(c.q, c.r).alias("u"), hx.pack(c.nq, c.nr).alias("v")),
    )
    (q, r), (lq, lr) = hx.unpack(c.v), hx.unpack(c.label)
    return labels.select(q.alias("q"), r.alias("r"), lq.alias("label_q"), lr.alias("label_r"))


def far_sql(a, b):
    return f"greatest(abs({a}.q - {b}.q), abs({a}.r - {b}.r), abs({a}.q + {a}.r - {b}.q - {b}.r))"


# A link with a third cell closer to both ends is in no backbone. Looking for that cell among an end's twelve nearest
# leaves few links to walk per length.
LINKS = f"""cell AS (SELECT DISTINCT q, r FROM vterm),
pair AS (SELECT a.q, a.r, b.q AS nq, b.r AS nr, {far_sql('a', 'b')} AS far FROM cell a JOIN cell b ON a.q <> b.q OR a.r <> b.r),
near AS (SELECT q, r, nq, nr, far FROM pair QUALIFY row_number() OVER (PARTITION BY q, r ORDER BY far, nq, nr) <= 12),
step AS (SELECT q, r, nq, nr, far FROM pair EXCEPT
         SELECT p.q, p.r, p.nq, p.nr, p.far FROM pair p JOIN near c ON c.q = p.q AND c.r = p.r AND c.far < p.far
         WHERE greatest(abs(c.nq - p.nq), abs(c.nr - p.nr), abs(c.nq + c.nr - p.nq - p.nr)) < p.far)"""


@query(
    "pairs_mst_lengths",
    with_views(
        "vterm",
        """SELECT CAST(far AS INT) AS length, n FROM (SELECT far, lag(parts, 1, (SELECT count(*) FROM cell)) OVER (ORDER BY far) - parts AS n FROM (
             SELECT far, count(DISTINCT root) AS parts FROM (SELECT far, q, r, min(root) AS root FROM walk GROUP BY far, q, r) GROUP BY far)) WHERE n > 0""",
        recursive=LINKS
        + """,
walk(far, q, r, root) AS (SELECT t.far, q, r, CAST(q AS BIGINT) * 100000 + r + 50000 FROM cell, (SELECT DISTINCT far FROM step) t
                          UNION SELECT w.far, s.nq, s.nr, w.root FROM walk w JOIN step s ON s.q = w.q AND s.r = w.r AND s.far <= w.far)""",
    ),
)
def pairs_mst_lengths(spark, d):
    """How many links of each length the backbone has, which does not depend on how ties are broken."""
    tree = pairs.backbone_edges(fx.Site(spark, d).terminals())
    return tree.groupBy(c.w.cast("int").alias("length")).agg(F.count("*").alias("n"))


@query("pairs_connected")
def pairs_connected(spark, d):
    at = pinned(fx.Site(spark, d).terminals())
    return pairs.connected_pairs(at, pinned(pairs.knn_pairs(at, 2)))


def search_sql(pairs_sql, depth):
    """Breadth-first search from every origin of `pair`, to a depth no shortest path of the fixture exceeds."""
    return f"""pair AS ({pairs_sql}),
walk(aq, ar, q, r, d) AS (SELECT DISTINCT aq, ar, aq, ar, 0 FROM pair JOIN open ON open.q = aq AND open.r = ar
                          UNION SELECT w.aq, w.ar, o.q, o.r, w.d + 1 FROM walk w, dirs, open o WHERE o.q = w.q + dq AND o.r = w.r + dr AND w.d < {depth}),
found AS (SELECT p.aq, p.ar, p.bq, p.br, min(d) AS d FROM pair p JOIN walk w ON w.aq = p.aq AND w.ar = p.ar AND w.q = p.bq AND w.r = p.br GROUP BY ALL)"""


COARSE_LEGS = """SELECT DISTINCT q AS aq, r AS ar, bq, br FROM (
  SELECT q, r, lead(q) OVER (ORDER BY feature_id) AS bq, lead(r) OVER (ORDER BY feature_id) AS br FROM placed_coarse WHERE layer = 'vertiport')
  WHERE bq IS NOT NULL AND (bq <> q OR br <> r)"""


@query(
    "shortest_path",
    with_views(
        "coarse placed_coarse dirs",
        "SELECT aq, ar, bq, br, d * 2e0 AS cost, d + 1 AS num_cells FROM found",
        recursive="open AS (SELECT q, r FROM coarse EXCEPT SELECT q, r FROM placed_coarse WHERE layer = 'heliport'), " + search_sql(COARSE_LEGS, 60),
    ),
)
def shortest_path(spark, d):
    """Cost of the cheapest path between consecutive vertiports."""
    site = fx.Site(spark, d, COARSE)
    legs = site.paths().select(F.element_at("cells", 1).alias("a"), F.element_at("cells", -1).alias("b"))
    ends = legs.select(F.col("a.q").alias("aq"), F.col("a.r").alias("ar"), F.col("b.q").alias("bq"), F.col("b.r").alias("br"))
    return routing.shortest_paths(ends, site.vertices()).select("aq", "ar", "bq", "br", r6(c.cost, "cost"), F.size("cells").alias("num_cells"))


@query(
    "interconnect",
    with_views(
        "vterm g0v dirs",
        "SELECT aq || ':' || ar || '>' || bq || ':' || br AS path_id, d * 2e0 AS cost, d + 1 AS num_cells FROM found",
        recursive="open AS (SELECT q, r FROM g0v), " + search_sql(KNN_SQL, 12),
    ),
)
def interconnect_query(spark, d):
    site = fx.Site(spark, d)
    found = interconnect(site.terminals(), site.vertices(), "knn", 2)
    return found.select("path_id", r6(c.cost, "cost"), F.size("cells").alias("num_cells"))


@query(
    "g1_edges",
    with_views(
        "fx_hops",
        """SELECT DISTINCT CASE WHEN less THEN aq ELSE bq END AS aq, CASE WHEN less THEN ar ELSE br END AS ar,
                  CASE WHEN less THEN bq ELSE aq END AS bq, CASE WHEN less THEN br ELSE ar END AS br
           FROM (SELECT *, (aq < bq OR (aq = bq AND ar < br)) AS less FROM fx_hops)""",
    ),
)
def g1_edges(spark, d):
    return graph.g1_edges(fx.Site(spark, d).paths())


@query(
    "g1_vertices",
    with_views("fx_paths", "SELECT q, r, bool_or(pos = 0 OR pos = n) AS is_terminal FROM fx_paths WHERE n > 0 GROUP BY q, r"),
)
def g1_vertices(spark, d):
    return graph.g1_vertices(fx.Site(spark, d).paths())


@query(
    "g2_edges",
    with_views(
        "legs",
        "SELECT path_id, aq AS origin_q, ar AS origin_r, bq AS target_q, br AS target_r, CAST(n + 1 AS INT) AS num_cells FROM legs",
    ),
)
def g2_edges(spark, d):
    return graph.g2_edges(fx.Site(spark, d).paths())


@query(
    "graph_counts",
    with_views("g0v g0e", "SELECT 'g0' AS graph, (SELECT count(*) FROM g0v) AS vcount, (SELECT count(*) FROM g0e) AS ecount"),
)
def graph_counts(spark, d):
    at = fx.Site(spark, d).vertices()
    return graph.graph_counts(at, graph.g0_edges(at), "g0")


@query("route_plan")
def route_plan(spark, d):
    """Routes along the single-linkage backbone of the vertiports that are not in a heliport's cell."""
    site = fx.Site(spark, d)
    at = pinned(sites.without_conflicts(site.terminals(), site.heliport_cells()).select("feature_id", "q", "r"))
    plan = plan_routes(site.grid_state(), at, "Single-Linkage_HAC")
    ends = plan.terminal_edges
    return ends.join(plan.paths.select("path_id", r6(c.cost, "cost")), "path_id")


# metrics


@query(
    "avg_path_length",
    with_views("legs", f"SELECT {s6('coalesce(avg(n), 0e0)', 'avg_path_length')} FROM legs"),
)
def avg_path_length(spark, d):
    return graph.average_path_length(fx.Site(spark, d).paths()).select(r6(c.avg_path_length, "avg_path_length"))


@query("betweenness")
def betweenness(spark, d):
    """Route graph of straight lines over the coarse grid."""
    return metrics.betweenness(graph.g1_edges(fx.Site(spark, d, COARSE).paths()))


@query("cell_load", with_views("fx_paths", "SELECT q, r, count(*) AS paths FROM fx_paths GROUP BY q, r"))
def cell_load(spark, d):
    return graph.cell_load(fx.Site(spark, d).paths())


@query(
    "affected_paths",
    with_views("fx_paths hcells", "SELECT DISTINCT path_id FROM fx_paths p JOIN hcells h ON h.q = p.q AND h.r = p.r"),
)
def affected_paths(spark, d):
    site = fx.Site(spark, d)
    return graph.affected_paths(site.paths(), site.heliport_cells())


@query(
    "sum_routes",
    with_views(
        "fx_paths g0v g0e legs",
        """SELECT CAST(p.path_id AS VARCHAR) AS path_id, string_agg('{"q": ' || p.q || ', "r": ' || p.r || '}', ', ' ORDER BY p.pos) AS cells,
                  (SELECT count(*) FROM g0v) AS g0_vertices, (SELECT count(*) FROM g0e) AS g0_edges,
                  (SELECT count(*) FROM (SELECT aq, ar FROM legs UNION SELECT bq, br FROM legs)) AS g2_vertices, (SELECT count(*) FROM legs) AS g2_edges
           FROM fx_paths p GROUP BY p.path_id""",
    ),
)
def sum_routes(spark, d):
    site = fx.Site(spark, d)
    at, routes = site.vertices(), site.paths()
    g0 = graph.graph_counts(at, graph.g0_edges(at), "g0").first()
    g2 = graph.graph_counts(graph.terminal_cells(routes), graph.g2_edges(routes), "g2").first()
    text = F.array_join(F.transform("cells", lambda p: F.format_string('{"q": %d, "r": %d}', p.q, p.r)), ", ")
    return routes.select(
        c.path_id.cast("string").alias("path_id"),
        text.alias("cells"),
        F.lit(g0.vcount).alias("g0_vertices"),
        F.lit(g0.ecount).alias("g0_edges"),
        F.lit(g2.vcount).alias("g2_vertices"),
        F.lit(g2.ecount).alias("g2_edges"),
    )


# scene

SNAP_X, SNAP_Y = centre_sql()


@query(
    "layer_vertiports",
    with_views("placed centre", f"SELECT feature_id, {s6(f'{SNAP_X} + cx', 'x')}, {s6(f'{SNAP_Y} + cy', 'y')} FROM placed, centre WHERE layer = 'vertiport'"),
)
def layer_vertiports(spark, d):
    site = fx.Site(spark, d)
    at = scene.vertiport_layer(site.local().where("layer = 'vertiport'"), site.domain, CELL_SIZE)
    return at.select("feature_id", r6(c.x, "x"), r6(c.y, "y"))


@query("layer_heliports", with_views("fx_points", f"SELECT feature_id, {s6('x', 'x')}, {s6('y', 'y')} FROM fx_points WHERE layer = 'heliport'"))
def layer_heliports(spark, d):
    site = fx.Site(spark, d)
    at = scene.heliport_layer(site.local().where("layer = 'heliport'"), site.domain)
    return at.select("feature_id", r6(c.x, "x"), r6(c.y, "y"))


@query(
    "layer_routes",
    with_views(
        "fx_paths legs centre",
        f"""SELECT p.path_id AS route_id, CAST(l.n + 1 AS INT) AS num_cells, l.aq AS origin_q, l.ar AS origin_r, l.bq AS target_q, l.br AS target_r,
                   p.pos, {s6(f"{centre_sql('p.q', 'p.r')[0]} + cx", 'x')}, {s6(f"{centre_sql('p.q', 'p.r')[1]} + cy", 'y')}
            FROM fx_paths p JOIN legs l ON l.path_id = p.path_id, centre""",
    ),
)
def layer_routes(spark, d):
    site = fx.Site(spark, d)
    lines = scene.route_layer(site.paths(), site.domain, CELL_SIZE)
    facts = ["route_id", "num_cells", "origin_q", "origin_r", "target_q", "target_r"]
    return lines.select(*facts, F.posexplode("line").alias("pos", "p")).select(*facts, "pos", r6(F.col("p.x"), "x"), r6(F.col("p.y"), "y"))


def xy_sql(x, y):
    return f"'[' || printf('%.3f', {x}) || ', ' || printf('%.3f', {y}) || ']'"


def point_sql(x, y):
    return (
        """'{"type": "Feature", "geometry": {"type": "Point", "coordinates": ' || """
        + xy_sql(x, y)
        + """ || '}, "properties": {}}'"""
    )


STEP_X, STEP_Y = (f"{text} + cx" if i == 0 else f"{text} + cy" for i, text in enumerate(centre_sql("p.q", "p.r")))
SCENE_SQL = with_views(
    "placed fx_points fx_paths legs centre",
    f"""SELECT 'vertiports' AS layer_id, 'Point' AS geometry_type, CAST(feature_id AS VARCHAR) AS feature_id,
               {point_sql(SNAP_X + ' + cx', SNAP_Y + ' + cy')} AS feature FROM placed, centre WHERE layer = 'vertiport'
        UNION ALL
        SELECT 'heliports', 'Point', CAST(feature_id AS VARCHAR), {point_sql('(x - cx) + cx', '(y - cy) + cy')} FROM fx_points, centre WHERE layer = 'heliport'
        UNION ALL
        SELECT 'routes', 'LineString', CAST(p.path_id AS VARCHAR),
               '{{"type": "Feature", "geometry": {{"type": "LineString", "coordinates": [' || string_agg({xy_sql(STEP_X, STEP_Y)}, ', ' ORDER BY pos)
               || ']}}, "properties": {{' || printf('"num_cells": %d, "origin_q": %d, "origin_r": %d, "target_q": %d, "target_r": %d', any_value(l.n) + 1, any_value(aq), any_value(ar), any_value(bq), any_value(br)) || '}}}}'
        FROM fx_paths p JOIN legs l ON l.path_id = p.path_id, centre GROUP BY p.path_id""",
)


def planar_scene(spark, d):
    site = fx.Site(spark, d)
    snapped = scene.vertiport_layer(site.local().where("layer = 'vertiport'"), site.domain, CELL_SIZE)
    plain = scene.heliport_layer(site.local().where("layer = 'heliport'"), site.domain)
    routes = scene.route_layer(site.paths(), site.domain, CELL_SIZE)
    return scene.scene(
        [
            scene.point_features("vertiports", snapped, digits=3),
            scene.point_features("heliports", plain, digits=3),
            scene.route_features(routes, digits=3),
        ]
    )


@query("scene", SCENE_SQL)
def scene_query(spark, d):
    return planar_scene(spark, d)


@query(
    "layer_select",
    f"SELECT feature_id, kind, feature FROM (SELECT *, CASE layer_id WHEN 'vertiports' THEN 'droneport' ELSE 'heliport' END AS kind FROM ({SCENE_SQL})) WHERE geometry_type = 'Point'",
)
def layer_select(spark, d):
    return scene.infrastructure(planar_scene(spark, d)).select("feature_id", "kind", "feature")


CIRCLE_SQL = f"""
SELECT kind, feature_id, radius_km, CAST(i AS INT) AS pos, round(degrees(lon1), 5) + 0e0 AS lon, round(degrees(lat1), 5) + 0e0 AS lat FROM (
  SELECT *, lon0 + atan2(sin(b) * sin(a) * cos(lat0), cos(a) - sin(lat0) * sin(lat1)) AS lon1 FROM (
    SELECT *, asin(sin(lat0) * cos(a) + cos(lat0) * sin(a) * cos(b)) AS lat1 FROM (
      SELECT *, radians(lat) AS lat0, radians(lon) AS lon0, radius_km / {num(scene.EARTH_RADIUS_KM)} AS a, radians(-(i % 64) * 360e0 / 64) AS b FROM (
        SELECT CASE layer WHEN 'vertiport' THEN 'droneport' ELSE 'heliport' END AS kind, feature_id, lon, lat, i,
               CASE layer WHEN 'vertiport' THEN 1e1 ELSE 3.704e0 END AS radius_km FROM fx_geo, range(0, 65) t(i)))))"""


@query("range_circles", with_views("fx_geo", CIRCLE_SQL))
def range_circles(spark, d):
    kind = F.when(c.layer == "vertiport", "droneport").otherwise("heliport")
    at = fx.geo(spark, d).select(kind.alias("kind"), "feature_id", "lon", "lat")
    ranges = scene.operating_range_points(at)
    return ranges.select("kind", "feature_id", "radius_km", "pos", (F.round("p.lon", 5) + 0.0).alias("lon"), (F.round("p.lat", 5) + 0.0).alias("lat"))
