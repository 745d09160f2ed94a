"""Frame, hexagon and grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolattice.catalog import fixtures as fx
from aerolattice.catalog.fixtures import centre_sql, frac_sql, hex_round_sql, with_views
from aerolattice.catalog.registry import c, num, query
from aerolattice.functions import hexmath as hx
from aerolattice.functions.hexmath import CELL_SIZE, MARGIN, PADDING
from aerolattice.operators import frame, grid


def r6(column, name):
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def s6(text, name):
    return f"round({text}, 6) + 0e0 AS {name}"


# frame


@query("metric_center", with_views("centre", f"SELECT {s6('cx', 'x')}, {s6('cy', 'y')} FROM centre"))
def metric_center(spark, d):
    return frame.centroid(fx.points(spark, d), "x", "y").select(r6(c.x, "x"), r6(c.y, "y"))


@query(
    "geo_centroid",
    with_views("fx_geo", f"SELECT {s6('avg(lon)', 'lon')}, {s6('avg(lat)', 'lat')} FROM (SELECT DISTINCT lon, lat FROM fx_geo)"),
)
def geo_centroid(spark, d):
    return frame.centroid(fx.geo(spark, d), "lon", "lat").select(r6(F.col("lon"), "lon"), r6(F.col("lat"), "lat"))


@query("to_local", with_views("loc", f"SELECT layer, feature_id, {s6('x', 'x')}, {s6('y', 'y')} FROM loc"))
def to_local(spark, d):
    return fx.Site(spark, d).local().select("layer", "feature_id", r6(c.x, "x"), r6(c.y, "y"))


@query("from_local", with_views("fx_points", f"SELECT layer, feature_id, {s6('x', 'x')}, {s6('y', 'y')} FROM fx_points"))
def from_local(spark, d):
    site = fx.Site(spark, d)
    return frame.from_local(site.local(), site.domain).select("layer", "feature_id", r6(c.x, "x"), r6(c.y, "y"))


BOX = ["min_x", "max_x", "min_y", "max_y"]


@query(
    "bounds_agg",
    with_views("dom", "SELECT " + ", ".join(s6(f"{p}_{n}", f"{p}_{n}") for p in ("op", "vis") for n in BOX) + " FROM dom"),
)
def bounds_agg(spark, d):
    both = frame.bounds_pair(fx.Site(spark, d).local(), PADDING, MARGIN)
    return both.select(*[r6(F.col(n), n) for n in both.columns])


@query(
    "bounds_expand",
    with_views(
        "loc",
        f"SELECT {s6(f'min(x) - {num(250)}', 'min_x')}, {s6(f'max(x) + {num(250)}', 'max_x')}, "
        f"{s6(f'min(y) - {num(250)}', 'min_y')}, {s6(f'max(y) + {num(250)}', 'max_y')} FROM loc",
    ),
)
def bounds_expand(spark, d):
    grown = frame.expand(frame.raw_bounds(fx.Site(spark, d).local()), 250.0)
    return grown.select(*[r6(F.col(n), n) for n in BOX])


@query(
    "bounds_symmetric",
    with_views(
        "loc",
        f"""SELECT {s6('-ax', 'min_x')}, {s6('ax', 'max_x')}, {s6('-ay', 'min_y')}, {s6('ay', 'max_y')}
            FROM (SELECT max(abs(x)) + {num(PADDING)} AS ax, max(abs(y)) + {num(PADDING)} AS ay FROM loc)""",
    ),
)
def bounds_symmetric(spark, d):
    return frame.symmetric_bounds(fx.Site(spark, d).local(), PADDING).select(*[r6(F.col(n), n) for n in BOX])


@query(
    "bounds_corners",
    with_views(
        "dom",
        f"""SELECT CAST(corner AS INT) AS corner, {s6('x', 'x')}, {s6('y', 'y')} FROM (
              SELECT 0 AS corner, op_min_x AS x, op_max_y AS y FROM dom UNION ALL SELECT 1, op_max_x, op_max_y FROM dom
              UNION ALL SELECT 2, op_max_x, op_min_y FROM dom UNION ALL SELECT 3, op_min_x, op_min_y FROM dom)""",
    ),
)
def bounds_corners(spark, d):
    bounds = fx.domain(spark, d).select(*[F.col(f"op_{n}").alias(n) for n in BOX])
    return frame.corners(bounds).select("corner", r6(c.x, "x"), r6(c.y, "y"))


@query(
    "bounds_filter",
    with_views(
        "dom",
        f"""SELECT seq, {s6('x', 'x')}, {s6('y', 'y')}
            FROM (SELECT l_orderkey * 10 + l_linenumber AS seq, l_extendedprice - 50000e0 AS x, l_quantity * 1000e0 - 25000e0 AS y FROM lineitem), dom
            WHERE x BETWEEN op_min_x AND op_max_x AND y BETWEEN op_min_y AND op_max_y""",
    ),
)
def bounds_filter(spark, d):
    moved = fx.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_extendedprice") - 50000.0).alias("x"),
        (F.col("l_quantity") * 1000.0 - 25000.0).alias("y"),
    )
    return moved.where(frame.within(fx.Site(spark, d).domain, c.x, c.y)).select("seq", r6(c.x, "x"), r6(c.y, "y"))


@query(
    "build_domain",
    with_views(
        "dom",
        f"SELECT {s6('cx', 'x')}, {s6('cy', 'y')}, "
        + ", ".join(s6(f"{p}_{n}", f"{p}_{n}") for p in ("op", "vis") for n in BOX)
        + " FROM dom, centre",
    ),
)
def build_domain(spark, d):
    domain = fx.domain(spark, d)
    return domain.select(*[r6(F.col(n), n) for n in domain.columns])


# hexagon scalars over the cells of all points

PAIR_SQL = """pairs AS (SELECT layer, feature_id, q, r, q2, r2 FROM
  (SELECT layer, feature_id, q, r, CAST(feature_id % 37 - 18 AS INT) AS q2, CAST(feature_id % 23 - 11 AS INT) AS r2 FROM placed))"""


def _pair_view(body):
    head = with_views("placed", "")
    return head.rstrip() + ",\n" + PAIR_SQL + "\n" + body


def pairs(spark, d):
    q2 = (F.col("feature_id") % 37 - 18).cast("int").alias("q2")
    r2 = (F.col("feature_id") % 23 - 11).cast("int").alias("r2")
    return fx.Site(spark, d).placed().select("layer", "feature_id", "q", "r", q2, r2)


ID = ["layer", "feature_id"]


@query("hex_s", with_views("placed", "SELECT layer, feature_id, q, r, CAST(-q - r AS INT) AS s FROM placed"))
def hex_s(spark, d):
    return fx.Site(spark, d).placed().select(*ID, "q", "r", hx.third(c.q, c.r).alias("s"))


@query(
    "hex_arith",
    _pair_view(
        """SELECT layer, feature_id, q + q2 AS add_q, r + r2 AS add_r, q - q2 AS sub_q, r - r2 AS sub_r,
                  q * 3 AS mul_q, r * 3 AS mul_r FROM pairs"""
    ),
)
def hex_arith(spark, d):
    return pairs(spark, d).select(
        *ID,
        (c.q + c.q2).alias("add_q"),
        (c.r + c.r2).alias("add_r"),
        (c.q - c.q2).alias("sub_q"),
        (c.r - c.r2).alias("sub_r"),
        (c.q * 3).alias("mul_q"),
        (c.r * 3).alias("mul_r"),
    )


@query("hex_norm", with_views("placed", "SELECT layer, feature_id, greatest(abs(q), abs(r), abs(-q - r)) AS norm FROM placed"))
def hex_norm(spark, d):
    return fx.Site(spark, d).placed().select(*ID, hx.norm(c.q, c.r).alias("norm"))


@query(
    "hex_in_radius",
    with_views("placed", "SELECT layer, feature_id, q, r FROM placed WHERE greatest(abs(q), abs(r), abs(-q - r)) <= 20"),
)
def hex_in_radius(spark, d):
    return fx.Site(spark, d).placed().where(hx.norm(c.q, c.r) <= 20).select(*ID, "q", "r")


DIST = "greatest(abs(q - q2), abs(r - r2), abs(q + r - q2 - r2))"


@query("hex_distance", _pair_view(f"SELECT layer, feature_id, {DIST} AS distance FROM pairs"))
def hex_distance(spark, d):
    return pairs(spark, d).select(*ID, hx.distance(c.q, c.r, c.q2, c.r2).alias("distance"))


T_SQL = "(CAST(feature_id % 8 AS DOUBLE) / 8e0)"


def eighth():
    return (c.feature_id % 8).cast("double") / F.lit(8.0)


@query("hex_lerp", _pair_view(f"SELECT layer, feature_id, {s6(f'q + (q2 - q) * {T_SQL}', 'qf')}, {s6(f'r + (r2 - r) * {T_SQL}', 'rf')} FROM pairs"))
def hex_lerp(spark, d):
    qf, rf = hx.lerp(c.q, c.r, c.q2, c.r2, eighth())
    return pairs(spark, d).select(*ID, r6(qf, "qf"), r6(rf, "rf"))


HALF_SQL = "(SELECT layer, feature_id, x / 1000e0 AS qf, y / 500e0 AS rf FROM fx_points)"


@query("hex_round", with_views("fx_points", hex_round_sql(HALF_SQL, "layer, feature_id")))
def hex_round(spark, d):
    return hx.place(fx.points(spark, d), c.x / F.lit(1000.0), c.y / F.lit(500.0)).select(*ID, "q", "r")


@query(
    "hex_sample",
    _pair_view(hex_round_sql(f"(SELECT layer, feature_id, q + (q2 - q) * {T_SQL} AS qf, r + (r2 - r) * {T_SQL} AS rf FROM pairs)", "layer, feature_id")),
)
def hex_sample(spark, d):
    at = hx.place(pairs(spark, d), *hx.lerp(c.q, c.r, c.q2, c.r2, eighth()), "sq", "sr")
    return at.select(*ID, c.sq.alias("q"), c.sr.alias("r"))


@query("hex_to_xy", with_views("cells", f"SELECT q, r, {s6(centre_sql()[0], 'x')}, {s6(centre_sql()[1], 'y')} FROM cells"))
def hex_to_xy(spark, d):
    x, y = hx.centre(c.q, c.r, CELL_SIZE)
    return fx.Site(spark, d).cells().select("q", "r", r6(x, "x"), r6(y, "y"))


@query("xy_to_hex", with_views("loc", hex_round_sql(f"(SELECT *, {frac_sql('x', 'y')} FROM loc)", "layer, feature_id")))
def xy_to_hex(spark, d):
    return hx.with_cell(fx.Site(spark, d).local(), CELL_SIZE).select(*ID, "q", "r")


@query("xy_to_hex_frac", with_views("loc", f"SELECT layer, feature_id, {s6('qf', 'qf')}, {s6('rf', 'rf')} FROM (SELECT *, {frac_sql('x', 'y')} FROM loc)"))
def xy_to_hex_frac(spark, d):
    qf, rf = hx.fractional(c.x, c.y, CELL_SIZE)
    return fx.Site(spark, d).local().select(*ID, r6(qf, "qf"), r6(rf, "rf"))


@query(
    "hex_polygon",
    with_views(
        "cells",
        f"""SELECT q, r, CAST(i AS INT) AS vertex,
                   round({centre_sql()[0]} + {num(CELL_SIZE)} * cos(radians(60 * i + 30)), 3) + 0e0 AS x,
                   round({centre_sql()[1]} + {num(CELL_SIZE)} * sin(radians(60 * i + 30)), 3) + 0e0 AS y
            FROM cells, range(0, 6) t(i)""",
    ),
)
def hex_polygon(spark, d):
    return fx.Site(spark, d).cells().select("q", "r", F.posexplode(hx.vertices(c.q, c.r, CELL_SIZE)).alias("vertex", "p")).select(
        "q", "r", "vertex", (F.round("p.x", 3) + F.lit(0.0)).alias("x"), (F.round("p.y", 3) + F.lit(0.0)).alias("y")
    )


@query(
    "hex_direction",
    with_views("placed dirs", "SELECT layer, feature_id, i AS direction, q + dq AS q, r + dr AS r FROM placed JOIN dirs ON i = feature_id % 6"),
)
def hex_direction(spark, d):
    way = (F.col("feature_id") % 6).cast("int")
    ahead = F.element_at(hx.direction_literal(), way + 1)
    return fx.Site(spark, d).placed().select(*ID, way.alias("direction"), (c.q + ahead.q).alias("q"), (c.r + ahead.r).alias("r"))


@query(
    "hex_diagonals",
    with_views(
        "placed dirs",
        """SELECT layer, feature_id, a.i AS diagonal, q + a.dq + b.dq AS q, r + a.dr + b.dr AS r
           FROM placed, dirs a JOIN dirs b ON b.i = (a.i + 1) % 6""",
    ),
)
def hex_diagonals(spark, d):
    return fx.Site(spark, d).placed().select(*ID, "q", "r", F.posexplode(hx.diagonal_literal()).alias("diagonal", "v")).select(
        *ID, "diagonal", (c.q + F.col("v.q")).alias("q"), (c.r + F.col("v.r")).alias("r")
    )


# grid


@query(
    "axial_bounds",
    with_views(
        "dom",
        f"""SELECT CAST(floor(min(qf)) AS INT) AS min_q, CAST(ceil(max(qf)) AS INT) AS max_q,
                   CAST(floor(min(rf)) AS INT) AS min_r, CAST(ceil(max(rf)) AS INT) AS max_r
            FROM (SELECT {frac_sql('x', 'y')} FROM (SELECT op_min_x AS x, op_min_y AS y FROM dom UNION ALL SELECT op_min_x, op_max_y FROM dom
                  UNION ALL SELECT op_max_x, op_min_y FROM dom UNION ALL SELECT op_max_x, op_max_y FROM dom))""",
    ),
)
def axial_bounds(spark, d):
    return grid.axial_bounds(spark, fx.Site(spark, d).domain, CELL_SIZE)


@query("domain_cells", with_views("cells", "SELECT q, r FROM cells"))
def domain_cells(spark, d):
    return fx.Site(spark, d).cells()


@query(
    "build_grid",
    with_views("cells", f"SELECT q, r, {num(CELL_SIZE)} AS cell_size, 'POINTY' AS orientation, 1e0 AS cost, false AS restricted FROM cells"),
)
def build_grid(spark, d):
    return grid.domain_cells(spark, fx.Site(spark, d).domain, CELL_SIZE, "POINTY").select(
        "q",
        "r",
        F.lit(CELL_SIZE).alias("cell_size"),
        F.lit("POINTY").alias("orientation"),
        F.lit(1.0).alias("cost"),
        F.lit(False).alias("restricted"),
    )


@query(
    "cell_of_point",
    with_views(
        "loc dom",
        f"""SELECT layer, feature_id, CASE WHEN {fx.inside_sql()} THEN q END AS q, CASE WHEN {fx.inside_sql()} THEN r END AS r
            FROM ({hex_round_sql(f"(SELECT *, {frac_sql('x', 'y')} FROM loc)", 'layer, feature_id')}), dom""",
    ),
)
def cell_of_point(spark, d):
    site = fx.Site(spark, d)
    at = hx.with_cell(site.local(), CELL_SIZE).select(*ID, "q", "r")
    on_grid = frame.within(site.domain, *hx.centre(c.q, c.r, CELL_SIZE))
    return at.select(*ID, F.when(on_grid, c.q).alias("q"), F.when(on_grid, c.r).alias("r"))


@query("cells_of_points", with_views("placed", "SELECT layer, feature_id, q, r FROM placed"))
def cells_of_points(spark, d):
    return fx.Site(spark, d).placed().select(*ID, "q", "r")


@query(
    "cell_neighbors",
    with_views(
        "cells dirs",
        "SELECT a.q, a.r, i AS direction, b.q AS nq, b.r AS nr FROM cells a, dirs, cells b WHERE b.q = a.q + dq AND b.r = a.r + dr",
    ),
)
def cell_neighbors(spark, d):
    return grid.neighbours(fx.Site(spark, d).cells()).select("q", "r", "direction", "nq", "nr")


@query(
    "hex_ring",
    with_views(
        "placed dirs",
        """SELECT layer, feature_id, CAST(i AS INT) AS pos, CAST(q AS INT) AS q, CAST(r AS INT) AS r FROM (
             SELECT layer, feature_id, s.i AS i,
                    q + 3 * (-1 + (SELECT coalesce(sum(dq), 0) FROM dirs WHERE dirs.i < s.i // 3)) + (s.i % 3) * (SELECT dq FROM dirs WHERE dirs.i = s.i // 3) AS q,
                    r + 3 * (1 + (SELECT coalesce(sum(dr), 0) FROM dirs WHERE dirs.i < s.i // 3)) + (s.i % 3) * (SELECT dr FROM dirs WHERE dirs.i = s.i // 3) AS r
             FROM placed, range(0, 18) s(i))""",
    ),
)
def hex_ring(spark, d):
    return grid.ring_rows(fx.Site(spark, d).placed().select(*ID, "q", "r"), 3)


@query(
    "hex_range",
    with_views(
        "placed",
        """SELECT layer, feature_id, CAST(q + dq AS INT) AS q, CAST(r + dr AS INT) AS r
           FROM placed, range(-2, 3) a(dq), range(-2, 3) b(dr) WHERE abs(dq + dr) <= 2""",
    ),
)
def hex_range(spark, d):
    return fx.Site(spark, d).placed().select(*ID, F.explode(hx.around(c.q, c.r, F.lit(2))).alias("c")).select(*ID, "c.q", "c.r")


@query(
    "hex_range_intersect",
    _pair_view(
        """SELECT layer, feature_id, CAST(q + dq AS INT) AS q, CAST(r + dr AS INT) AS r
           FROM pairs, range(-3, 4) a(dq), range(-3, 4) b(dr)
           WHERE abs(dq + dr) <= 3 AND greatest(abs(q + dq - q2), abs(r + dr - r2), abs(q + dq + r + dr - q2 - r2)) <= 20"""
    ),
)
def hex_range_intersect(spark, d):
    near = pairs(spark, d).select(*ID, "q2", "r2", F.explode(hx.around(c.q, c.r, F.lit(3))).alias("c")).select(*ID, "q2", "r2", "c.q", "c.r")
    return near.where(hx.distance(c.q, c.r, c.q2, c.r2) <= 20).select(*ID, "q", "r")


@query(
    "cell_cost",
    with_views("grid_state", "SELECT q, r, CASE WHEN restricted THEN CAST('inf' AS DOUBLE) ELSE cost END AS cost FROM grid_state"),
)
def cell_cost(spark, d):
    return grid.cell_costs(fx.Site(spark, d).grid_state()).select("q", "r", "cost")


# summaries of the frame and the grid


@query(
    "sum_domain",
    with_views(
        "dom",
        f"""SELECT {s6('cx', 'center_x')}, {s6('cy', 'center_y')}, {s6('op_max_x - op_min_x', 'op_width')}, {s6('op_max_y - op_min_y', 'op_height')},
                   {s6('vis_max_x - vis_min_x', 'vis_width')}, {s6('vis_max_y - vis_min_y', 'vis_height')} FROM dom, centre""",
    ),
)
def sum_domain(spark, d):
    return fx.domain(spark, d).select(
        r6(c.x, "center_x"),
        r6(c.y, "center_y"),
        r6(c.op_max_x - c.op_min_x, "op_width"),
        r6(c.op_max_y - c.op_min_y, "op_height"),
        r6(c.vis_max_x - c.vis_min_x, "vis_width"),
        r6(c.vis_max_y - c.vis_min_y, "vis_height"),
    )


@query(
    "sum_grid",
    with_views("cells", f"SELECT {num(CELL_SIZE)} AS cell_size, 'POINTY' AS orientation, count(*) AS cells FROM cells"),
)
def sum_grid(spark, d):
    return fx.Site(spark, d).cells().agg(
        F.lit(CELL_SIZE).alias("cell_size"), F.lit("POINTY").alias("orientation"), F.count("*").alias("cells")
    )


@query(
    "point_guard",
    with_views("fx_points", "SELECT layer, geometry_type, count(*) AS n FROM (SELECT layer, 'Point' AS geometry_type FROM fx_points) GROUP BY ALL"),
)
def point_guard(spark, d):
    typed = fx.points(spark, d).withColumn("geometry_type", F.lit("Point"))
    return frame.require_points(typed).groupBy("layer", "geometry_type").agg(F.count("*").alias("n"))


@query("layer_union", with_views("fx_geo", f"SELECT layer, feature_id, {s6('lon', 'lon')}, {s6('lat', 'lat')}, 'EPSG:4326' AS crs FROM fx_geo"))
def layer_union(spark, d):
    geo = fx.geo(spark, d).withColumn("crs", F.lit("EPSG:4326"))
    layers = [geo.where("layer = 'heliport'"), geo.where("layer = 'vertiport'")]
    return frame.union_layers(layers).select(*ID, r6(F.col("lon"), "lon"), r6(F.col("lat"), "lat"), "crs")


@query("layer_nonempty", with_views("fx_geo", "SELECT layer, count(*) AS n FROM fx_geo GROUP BY layer"))
def layer_nonempty(spark, d):
    geo = fx.geo(spark, d).withColumn("crs", F.lit("EPSG:4326"))
    layers = [geo.where(F.col("layer") == name) for name in ("heliport", "vertiport", "helipad")]
    return frame.union_layers(frame.nonempty_layers(layers)).groupBy("layer").agg(F.count("*").alias("n"))
