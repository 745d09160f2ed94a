"""Clustering queries.

Points are the first two entries of each embedding with its label as zone, or the planar sites with one zone per
layer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolattice.catalog import fixtures as fx
from aerolattice.catalog.geometry import r6, s6
from aerolattice.catalog.registry import c, num, query
from aerolattice.functions import hexmath as hx
from aerolattice.operators import cluster, hierarchy
from aerolattice.runtime import measured, pinned

# Start widths of the neighbour search, and the link length at which clusters are cut.
BASE = 64.0
CUT = 250.0
SITE_BASE = 256.0

POINTS_SQL = f"""SELECT label AS zone, vec_id AS id, round(CAST(embedding[1] AS DOUBLE) * {num(10000)}, 3) + 0e0 AS x,
       round(CAST(embedding[2] AS DOUBLE) * {num(10000)}, 3) + 0e0 AS y FROM embeddings"""


def points(spark, d):
    def entry(i):
        return F.round(c.embedding[i].cast("double") * 10000.0, 3) + F.lit(0.0)

    return fx.table(spark, d, "embeddings").select(
        c.label.alias("zone"), c.vec_id.alias("id"), entry(0).alias("x"), entry(1).alias("y")
    )


def site_points(spark, d):
    """Heliports and vertiports as zones 0 and 1 with ids that do not meet."""
    zone = F.when(c.layer == "vertiport", 1).otherwise(0)
    return fx.points(spark, d).select(zone.alias("zone"), (c.feature_id * 2 + zone).alias("id"), "x", "y")


def members(spark, d):
    """The zones themselves as clusters."""
    return points(spark, d).select("zone", c.zone.cast("bigint").alias("label"), "id", "x", "y")


CORE_SQL = f"""WITH p AS ({POINTS_SQL})
SELECT zone, id, core FROM (SELECT a.zone, a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS core,
  row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS n
  FROM p a JOIN p b ON a.zone = b.zone AND a.id <> b.id) WHERE n = 2"""


@query("core_distance", f"SELECT zone, id, {s6('core', 'core')} FROM ({CORE_SQL})")
def core_distance(spark, d):
    return cluster.core_distances(points(spark, d), 2, BASE).select("zone", "id", r6(c.core, "core"))


# A link is in the tree when no way round it uses only earlier links: its rank is the smallest greatest rank between its ends.
ROUND_SQL = "\n".join(
    f", m{k} AS (SELECT a.zone, a.u, b.v, min(greatest(a.n, b.n)) AS n FROM m{k - 1} a JOIN m{k - 1} b ON a.zone = b.zone AND a.v = b.u GROUP BY ALL)"
    for k in range(1, 7)
)
TREE_TABLES = f"""p AS ({POINTS_SQL}), core AS ({CORE_SQL}),
link AS (SELECT a.zone, a.id AS u, b.id AS v, greatest(ca.core, cb.core, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS w
         FROM p a JOIN p b ON a.zone = b.zone AND a.id < b.id JOIN core ca ON ca.id = a.id JOIN core cb ON cb.id = b.id),
ranked AS (SELECT *, row_number() OVER (ORDER BY w, u, v) AS n FROM link),
m0 AS (SELECT zone, u, v, n FROM ranked UNION ALL SELECT zone, v, u, n FROM ranked UNION ALL SELECT zone, id, id, 0 FROM p)
{ROUND_SQL}
, edge AS MATERIALIZED (SELECT r.zone, r.n, r.w, r.u, r.v FROM ranked r JOIN m6 ON m6.u = r.u AND m6.v = r.v AND m6.n = r.n)"""


@query("mutual_reach_mst", f"WITH {TREE_TABLES} SELECT u, v, {s6('w', 'w')} FROM edge")
def mutual_reach_mst(spark, d):
    return cluster.mutual_reach_tree(points(spark, d), 2, BASE).select("u", "v", r6(c.w, "w"))


CUT_SQL = f"""WITH RECURSIVE p AS ({POINTS_SQL}), core AS ({CORE_SQL}),
link AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.zone = b.zone AND a.id <> b.id JOIN core ca ON ca.id = a.id JOIN core cb ON cb.id = b.id
         WHERE greatest(ca.core, cb.core, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) <= {num(CUT)}),
walk(id, root) AS (SELECT id, id FROM p UNION SELECT link.v, walk.root FROM walk JOIN link ON link.u = walk.id),
named AS (SELECT id, min(root) AS label FROM walk GROUP BY id)
SELECT p.zone, p.id, CASE WHEN count(*) OVER (PARTITION BY label) >= 2 THEN label ELSE -1 END AS label FROM p JOIN named ON named.id = p.id"""


@query("cut_labels", CUT_SQL)
def cut_labels(spark, d):
    at = points(spark, d)
    return cluster.cut_labels(at, cluster.mutual_reach_tree(at, 2, BASE), CUT, 2)


# Every link of the tree is a node whose members are reached by no later link; a node of two nodes (none is smaller than a
# cluster here) is a split. Masses are found from the leaves of the cluster tree upwards, the selection from its root down.
LABELS_SQL = f"""WITH RECURSIVE {TREE_TABLES},
node AS MATERIALIZED (SELECT e.n, e.w, e.u, count(*) AS size FROM edge e JOIN m6 ON m6.u = e.u AND m6.n <= e.n GROUP BY ALL),
above AS (SELECT a.n, min(b.n) AS up FROM node a JOIN m6 ON m6.u = a.u JOIN edge b ON b.u = m6.v AND b.n > a.n AND m6.n <= b.n GROUP BY a.n),
kids AS (SELECT up AS n, count(*) AS big, sum(size) AS inside FROM node JOIN above USING (n) GROUP BY up),
whole AS MATERIALIZED (
  SELECT n, w, size, up, coalesce(big = 2, false) AS split, CASE WHEN big = 2 THEN size ELSE size - coalesce(inside, 0) END AS shed
  FROM node LEFT JOIN above USING (n) LEFT JOIN kids USING (n)),
run(n, top) AS (
  SELECT w.n, w.n FROM whole w LEFT JOIN whole u ON u.n = w.up WHERE u.n IS NULL OR u.split
  UNION ALL SELECT w.n, run.top FROM run JOIN whole o ON o.n = run.n AND NOT o.split JOIN whole w ON w.up = run.n),
born AS (SELECT t.n AS top, t.up, coalesce(1 / u.w, 0) AS at FROM whole t LEFT JOIN whole u ON u.n = t.up),
found AS MATERIALIZED (
  SELECT run.top AS k, any_value(o.top) AS parent, sum(CASE WHEN w.w <= 0 THEN shed ELSE 0 END) AS zero,
         sum(CASE WHEN w.w <= 0 THEN 0 ELSE shed * (1 / w.w - born.at) END) AS mass
  FROM run JOIN whole w USING (n) JOIN born USING (top) LEFT JOIN run o ON o.n = born.up GROUP BY run.top),
solved(i, k, parent, zero, mass, wins, bz, bm) AS (
  SELECT 0, k, parent, zero, mass, CAST(NULL AS BOOLEAN), CAST(NULL AS HUGEINT), CAST(NULL AS DOUBLE) FROM found
  UNION ALL
  SELECT s.i + 1, s.k, s.parent, s.zero, s.mass,
         CASE WHEN s.wins IS NOT NULL THEN s.wins WHEN c.k IS NULL THEN true WHEN c.waiting = 0 THEN s.zero > c.z OR (s.zero = c.z AND s.mass >= c.m - 1e-9 * (abs(s.mass) + abs(c.m))) END,
         CASE WHEN s.wins IS NOT NULL THEN s.bz WHEN c.k IS NULL THEN s.zero WHEN c.waiting = 0 THEN greatest(s.zero, c.z) END,
         CASE WHEN s.wins IS NOT NULL THEN s.bm WHEN c.k IS NULL THEN s.mass
              WHEN c.waiting = 0 THEN CASE WHEN s.zero > c.z THEN s.mass WHEN s.zero < c.z THEN c.m ELSE greatest(s.mass, c.m) END END
  FROM solved s LEFT JOIN (SELECT parent AS k, sum(bz) AS z, sum(bm) AS m, count(*) FILTER (wins IS NULL) AS waiting FROM solved GROUP BY parent) c ON c.k = s.k
  WHERE (SELECT count(*) FROM solved WHERE wins IS NULL) > 0),
judged AS (SELECT k, parent, bool_or(wins) AS wins FROM solved GROUP BY k, parent),
pick(k, chosen) AS (
  SELECT k, CAST(NULL AS BIGINT) FROM judged WHERE parent IS NULL
  UNION ALL SELECT j.k, coalesce(pick.chosen, CASE WHEN j.wins THEN j.k END) FROM pick JOIN judged j ON j.parent = pick.k),
held AS (SELECT id, min(n) AS n FROM (SELECT u AS id, n FROM edge UNION ALL SELECT v, n FROM edge) GROUP BY id),
named AS (SELECT id, min(id) OVER (PARTITION BY chosen) AS label FROM held JOIN run USING (n) JOIN pick ON pick.k = run.top WHERE chosen IS NOT NULL)
SELECT p.zone, p.id, coalesce(label, -1) AS label FROM p LEFT JOIN named USING (id)"""


def labels(at, base):
    return hierarchy.density_labels(at, cluster.mutual_reach_tree(at, 2, base), 2)


@query("density_labels", LABELS_SQL)
def density_labels(spark, d):
    return labels(points(spark, d), BASE)


@query("fit_zone", f"SELECT zone, label, count(*) AS n, {s6('avg(x)', 'cx')}, {s6('avg(y)', 'cy')} FROM ({LABELS_SQL}) JOIN ({POINTS_SQL}) USING (zone, id) WHERE label <> -1 GROUP BY zone, label")
def fit_zone(spark, d):
    at = points(spark, d)
    found = cluster.centroids(cluster.zone_members(at, labels(at, BASE), 2))
    return found.select("zone", "label", "n", r6(c.cx, "cx"), r6(c.cy, "cy"))


@measured
def site_centres(at):
    return pinned(cluster.centroids(cluster.zone_members(at, labels(at, SITE_BASE), 2)))


@query("zone_clusters")
def zone_clusters(spark, d):
    """Heliport clusters as MAV and vertiport clusters as UAV zones."""
    found = site_centres(pinned(site_points(spark, d)))
    kind = F.when(c.zone == 0, "MAV").otherwise("UAV")
    return found.select(kind.alias("zone_type"), "label", "n", r6(c.cx, "cx"), r6(c.cy, "cy"))


CENTRE_SQL = f"SELECT zone, CAST(zone AS BIGINT) AS label, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM ({POINTS_SQL}) GROUP BY zone"
CIRCLE_SQL = f"""SELECT zone, label, cx, cy, i AS pos, cx + 50 * cos(-(i % 64) * 2e0 * pi() / 64) AS x, cy + 50 * sin(-(i % 64) * 2e0 * pi() / 64) AS y
FROM ({CENTRE_SQL}), range(0, 65) t(i)"""


@query("cluster_centroid", f"SELECT zone, label, {s6('cx', 'cx')}, {s6('cy', 'cy')}, n FROM ({CENTRE_SQL})")
def cluster_centroid(spark, d):
    return cluster.centroids(members(spark, d)).select("zone", "label", r6(c.cx, "cx"), r6(c.cy, "cy"), "n")


@query("few_points", f"SELECT zone, label, CAST(pos AS INT) AS pos, round(x, 4) + 0e0 AS x, round(y, 4) + 0e0 AS y FROM ({CIRCLE_SQL})")
def few_points(spark, d):
    rings = cluster.few_points(members(spark, d)).select("zone", "label", F.posexplode("ring").alias("pos", "p"))
    return rings.select("zone", "label", "pos", (F.round("p.x", 4) + 0.0).alias("x"), (F.round("p.y", 4) + 0.0).alias("y"))


AREA_SQL = f"""SELECT zone, label, any_value(cx) AS cx, any_value(cy) AS cy, abs(sum(x * ny - nx * y)) / 2 AS area
FROM (SELECT zone, label, cx, cy, x - cx AS x, y - cy AS y, lead(x) OVER w - cx AS nx, lead(y) OVER w - cy AS ny FROM ({CIRCLE_SQL}) WINDOW w AS (PARTITION BY zone ORDER BY pos)) WHERE nx IS NOT NULL GROUP BY zone, label"""


@query("cluster_area", f"SELECT zone, label, round(area, 3) AS area FROM ({AREA_SQL})")
def cluster_area(spark, d):
    rings = cluster.few_points(members(spark, d))
    return rings.select("zone", "label", F.round(cluster.ring_area(c.ring), 3).alias("area"))


@query("cluster_summary", f"SELECT zone, label, {s6('cx', 'cx')}, {s6('cy', 'cy')}, round(area, 3) AS area FROM ({AREA_SQL})")
def cluster_summary(spark, d):
    rows = cluster.summary(cluster.few_points(members(spark, d)))
    return rows.select("zone", "label", r6(c.cx, "cx"), r6(c.cy, "cy"), F.round("area", 3).alias("area"))


@query("cluster_radius", f"SELECT zone, label, round(max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 4) AS radius FROM ({CIRCLE_SQL}) GROUP BY zone, label")
def cluster_radius(spark, d):
    rings = cluster.few_points(members(spark, d))
    return rings.select("zone", "label", F.round(cluster.ring_radius(c.ring, c.cx, c.cy), 4).alias("radius"))


WIDE = 600.0
# A regular 64-gon holds a point when it is on the inner side of all its edges.
INSIDE_SQL = f"""WITH p AS ({POINTS_SQL}), ring AS (SELECT zone, label, i, cx + {num(WIDE)} * cos(-(i % 64) * 2e0 * pi() / 64) AS x, cy + {num(WIDE)} * sin(-(i % 64) * 2e0 * pi() / 64) AS y FROM ({CENTRE_SQL}), range(0, 65) t(i))
SELECT p.zone, a.label, p.id FROM p JOIN ring a ON a.zone = p.zone JOIN ring b ON b.zone = a.zone AND b.i = a.i + 1
GROUP BY p.zone, a.label, p.id HAVING max((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) < 0"""


def wide_rings(spark, d):
    return cluster.centroids(members(spark, d)).withColumn("ring", cluster.circle(c.cx, c.cy, WIDE))


@query("cluster_contains", INSIDE_SQL)
def cluster_contains(spark, d):
    return cluster.contained(points(spark, d), wide_rings(spark, d), 256.0)


OVERLAP = 100.0


@query(
    "cluster_overlap",
    f"""WITH p AS ({POINTS_SQL}), cell AS (SELECT DISTINCT zone, q, r FROM ({fx.hex_round_sql(f"(SELECT zone, {fx.frac_sql('x', 'y', OVERLAP)} FROM p)", 'zone')}))
        SELECT a.zone AS zone_a, b.zone AS zone_b, count(*) AS shared, round(count(*) * {num(3 * 3**0.5 / 2 * OVERLAP**2)}, 3) AS area
        FROM cell a JOIN cell b ON a.q = b.q AND a.r = b.r AND a.zone < b.zone GROUP BY a.zone, b.zone""",
)
def cluster_overlap(spark, d):
    """Area two clusters share, counted in cells that both occupy."""
    at = hx.with_cell(points(spark, d), OVERLAP).select(c.zone.alias("label"), "q", "r")
    return cluster.shared_cells(at, OVERLAP).select(
        c.label_a.alias("zone_a"), c.label_b.alias("zone_b"), "shared", F.round("area", 3).alias("area")
    )


@query("radial_boundary")
def radial_boundary(spark, d):
    outline = cluster.radial_boundary(members(spark, d))
    return outline.select("zone", "label", "pos", r6(c.x, "x"), r6(c.y, "y"))
