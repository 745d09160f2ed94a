"""Inputs of the registered queries, derived from whole test tables, in Spark and as SQL views.

Suppliers stand in for heliports and customers for vertiports. Every twentieth customer sits on a supplier's place
and every twenty-fifth on one common place, so conflicts and copies of a terminal occur.
"""

from __future__ import annotations

from functools import cached_property
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolattice.catalog.registry import num
from aerolattice.functions import hexmath as hx
from aerolattice.functions.hexmath import CELL_SIZE, MARGIN, PADDING
from aerolattice.operators import frame, grid, sites
from aerolattice.operators.ordered import running
from aerolattice.runtime import shuffle_width

COARSE = 2000.0
#: Ids of vertiports whose legs are found in one task.
LEG_RANGE = 1 << 14

POINTS_SQL = """
SELECT 'heliport' AS layer, s_suppkey AS feature_id,
       CAST((s_suppkey * 7919) % 60001 - 30000 AS DOUBLE) AS x,
       CAST((s_suppkey * 104729) % 40001 - 20000 AS DOUBLE) AS y
FROM supplier
UNION ALL
SELECT 'vertiport', c_custkey,
       CAST(CASE WHEN c_custkey % 20 = 0 THEN (CAST((c_custkey - c_custkey % 20) / 20 AS BIGINT) * 7919) % 60001 - 30000
                 WHEN c_custkey % 25 = 0 THEN 100
                 ELSE (c_custkey * 6151) % 50001 - 25000 END AS DOUBLE),
       CAST(CASE WHEN c_custkey % 20 = 0 THEN (CAST((c_custkey - c_custkey % 20) / 20 AS BIGINT) * 104729) % 40001 - 20000
                 WHEN c_custkey % 25 = 0 THEN 100
                 ELSE (c_custkey * 3571) % 30001 - 15000 END AS DOUBLE)
FROM customer
"""

GEO_SQL = f"SELECT layer, feature_id, {num(-43.2)} + x / {num(102000)} AS lon, {num(-22.9)} + y / {num(111000)} AS lat FROM fx_points"

INTENTS_SQL = """
SELECT event_id AS seq, ts, user_id AS session_id,
       CASE event_type WHEN 'purchase' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'click' THEN 'toggle' ELSE 'other' END AS kind,
       CAST((user_id * 3571) % 20001 - 10000 AS DOUBLE) AS x,
       CAST((user_id * 7919) % 15001 - 7500 AS DOUBLE) AS y
FROM events
"""


def hex_round_sql(source: str, keep: str) -> str:
    """Rows of `source(qf, rf, ...)` with their nearest cell; `keep` lists the columns carried along."""
    return f"""
SELECT {keep},
       CAST(CASE WHEN eq > er AND eq > es THEN -rr - rs ELSE rq END AS INT) AS q,
       CAST(CASE WHEN NOT (eq > er AND eq > es) AND er > es THEN -rq - rs ELSE rr END AS INT) AS r
FROM (SELECT *, abs(rq - qf) AS eq, abs(rr - rf) AS er, abs(rs - sf) AS es
      FROM (SELECT *, round_even(qf, 0) AS rq, round_even(rf, 0) AS rr, round_even(sf, 0) AS rs
            FROM (SELECT *, -qf - rf AS sf FROM {source})))"""


def frac_sql(x: str, y: str, size: float = CELL_SIZE) -> str:
    s = num(size)
    return f"({num(hx.ROOT3 / 3)} * {x} - {num(1 / 3)} * {y}) / {s} AS qf, ({num(2 / 3)} * {y}) / {s} AS rf"


def centre_sql(q: str = "q", r: str = "r", size: float = CELL_SIZE) -> tuple[str, str]:
    s = num(size)
    return (
        f"({s} * ({num(hx.ROOT3)} * {q} + {num(hx.ROOT3)} * {r} / {num(2)}))",
        f"({s} * ({num(1.5)} * {r}))",
    )


def inside_sql(size: float = CELL_SIZE, q: str = "q", r: str = "r") -> str:
    cx, cy = centre_sql(q, r, size)
    return f"{cx} BETWEEN op_min_x AND op_max_x AND {cy} BETWEEN op_min_y AND op_max_y"


def cells_sql(size: float) -> str:
    return f"""
SELECT q, r FROM (
  SELECT q, unnest(range(min_r, max_r + 1)) AS r FROM (
    SELECT unnest(range(min_q, max_q + 1)) AS q, min_r, max_r FROM (
      SELECT CAST(floor(min(qf)) AS INT) AS min_q, CAST(ceil(max(qf)) AS INT) AS max_q,
             CAST(floor(min(rf)) AS INT) AS min_r, CAST(ceil(max(rf)) AS INT) AS max_r
      FROM (SELECT {frac_sql('bx', 'bytop', size)} FROM (
              SELECT unnest([op_min_x, op_min_x, op_max_x, op_max_x]) AS bx,
                     unnest([op_min_y, op_max_y, op_min_y, op_max_y]) AS bytop FROM dom))))), dom
WHERE {inside_sql(size)}"""


def placed_sql(local: str, size: float, keep: str) -> str:
    return f"""
SELECT {keep}, q, r FROM ({hex_round_sql(f"(SELECT *, {frac_sql('x', 'y', size)} FROM {local})", '*')}), dom
WHERE {inside_sql(size)}"""


VIEWS = {
    "fx_points": POINTS_SQL,
    "fx_geo": GEO_SQL,
    "centre": "SELECT avg(x) AS cx, avg(y) AS cy FROM (SELECT DISTINCT x, y FROM fx_points)",
    "loc": "SELECT layer, feature_id, x - cx AS x, y - cy AS y FROM fx_points, centre",
    "dom": f"""SELECT min(x) - {num(PADDING)} AS op_min_x, max(x) + {num(PADDING)} AS op_max_x,
                      min(y) - {num(PADDING)} AS op_min_y, max(y) + {num(PADDING)} AS op_max_y,
                      min(x) - {num(MARGIN)} AS vis_min_x, max(x) + {num(MARGIN)} AS vis_max_x,
                      min(y) - {num(MARGIN)} AS vis_min_y, max(y) + {num(MARGIN)} AS vis_max_y FROM loc""",
    "cells": cells_sql(CELL_SIZE),
    "coarse": cells_sql(COARSE),
    "placed": placed_sql("loc", CELL_SIZE, "layer, feature_id, x, y"),
    "placed_coarse": placed_sql("loc", COARSE, "layer, feature_id, x, y"),
    "hcells": "SELECT DISTINCT q, r FROM placed WHERE layer = 'heliport'",
    "vterm": "SELECT feature_id, q, r FROM placed WHERE layer = 'vertiport'",
    "grid_state": "SELECT c.q, c.r, 1e0 AS cost, h.q IS NOT NULL AS restricted FROM cells c LEFT JOIN hcells h ON c.q = h.q AND c.r = h.r",
    "g0v": "SELECT q, r, cost FROM grid_state WHERE NOT restricted",
    "dirs": "SELECT * FROM (VALUES (0, 1, 0), (1, 1, -1), (2, 0, -1), (3, -1, 0), (4, -1, 1), (5, 0, 1)) t(i, dq, dr)",
    "g0e": """SELECT a.q, a.r, b.q AS nq, b.r AS nr, a.cost, b.cost AS ncost FROM g0v a, dirs d, g0v b
              WHERE b.q = a.q + d.dq AND b.r = a.r + d.dr AND (b.q > a.q OR (b.q = a.q AND b.r > a.r))""",
    "legs": """SELECT feature_id AS path_id, q AS aq, r AS ar, bq, br,
                      greatest(abs(bq - q), abs(br - r), abs(bq + br - q - r)) AS n
               FROM (SELECT *, lead(q) OVER (ORDER BY feature_id) AS bq, lead(r) OVER (ORDER BY feature_id) AS br FROM vterm)
               WHERE bq IS NOT NULL AND (bq <> q OR br <> r)""",
    "fx_paths": hex_round_sql(
        """(SELECT *, aq + (bq - aq) * (CAST(pos AS DOUBLE) / n) AS qf, ar + (br - ar) * (CAST(pos AS DOUBLE) / n) AS rf
                    FROM (SELECT *, unnest(range(0, n + 1)) AS pos FROM legs))""",
        "path_id, CAST(pos AS INT) AS pos, CAST(n AS INT) AS n",
    ),
    "fx_hops": """SELECT a.path_id, a.pos, a.q AS aq, a.r AS ar, b.q AS bq, b.r AS br
                  FROM fx_paths a JOIN fx_paths b ON a.path_id = b.path_id AND b.pos = a.pos + 1""",
    "fx_intents": INTENTS_SQL,
    "intent_at": f"""SELECT seq, ts, session_id, kind, q, r FROM (
        {hex_round_sql(f"(SELECT *, {frac_sql('x', 'y')} FROM (SELECT seq, ts, session_id, kind, x - cx AS x, y - cy AS y FROM fx_intents, centre))", '*')}), dom
        WHERE {inside_sql()}""",
}

NEEDS = {
    "fx_geo": ["fx_points"],
    "centre": ["fx_points"],
    "loc": ["centre"],
    "dom": ["loc"],
    "cells": ["dom"],
    "coarse": ["dom"],
    "placed": ["dom"],
    "placed_coarse": ["dom"],
    "hcells": ["placed"],
    "vterm": ["placed"],
    "grid_state": ["cells", "hcells"],
    "g0v": ["grid_state"],
    "g0e": ["g0v", "dirs"],
    "legs": ["vterm"],
    "fx_paths": ["legs"],
    "fx_hops": ["fx_paths"],
    "intent_at": ["dom", "fx_intents"],
}


def with_views(names: str, body: str, recursive: str = "", views: dict[str, str] = VIEWS) -> str:
    """Prefix `body` with the named views and what they need; `views` may hold other definitions of them."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({views[n]})" for n in order]
    if recursive:
        parts.append(recursive)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(
        F.lit("heliport").alias("layer"),
        F.col("s_suppkey").alias("feature_id"),
        ((F.col("s_suppkey") * 7919) % 60001 - 30000).cast("double").alias("x"),
        ((F.col("s_suppkey") * 104729) % 40001 - 20000).cast("double").alias("y"),
    )
    key = F.col("c_custkey")
    shared = ((key - key % 20) / 20).cast("bigint")

    def coordinate(step: int, span: int, own: int, width: int) -> F.Column:
        on_supplier = (shared * step) % span - (span - 1) // 2
        own_place = (key * own) % width - (width - 1) // 2
        return F.when(key % 20 == 0, on_supplier).when(key % 25 == 0, F.lit(100)).otherwise(own_place).cast("double")

    c = table(spark, sf_dir, "customer").select(
        F.lit("vertiport").alias("layer"),
        key.alias("feature_id"),
        coordinate(7919, 60001, 6151, 50001).alias("x"),
        coordinate(104729, 40001, 3571, 30001).alias("y"),
    )
    return s.unionByName(c)


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_map(points(spark, sf_dir))


def on_map(rows: DataFrame) -> DataFrame:
    """Rows with `lon`, `lat` instead of `x`, `y`."""
    lon, lat = F.lit(-43.2) + F.col("x") / F.lit(102000.0), F.lit(-22.9) + F.col("y") / F.lit(111000.0)
    return rows.select(*[n for n in rows.columns if n not in ("x", "y")], lon.alias("lon"), lat.alias("lat"))


def domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.build_domain(points(spark, sf_dir), PADDING, MARGIN)


class Site:
    """The fixture's planning inputs over one domain, whose single row is read once."""

    def __init__(self, spark: SparkSession, sf_dir: str, size: float = CELL_SIZE):
        self.spark, self.sf_dir, self.size = spark, sf_dir, size

    @cached_property
    def domain(self) -> SimpleNamespace:
        return frame.fixed(domain(self.spark, self.sf_dir))

    def local(self) -> DataFrame:
        return frame.to_local(points(self.spark, self.sf_dir), self.domain)

    def cells(self) -> DataFrame:
        return grid.domain_cells(self.spark, self.domain, self.size)

    def placed(self) -> DataFrame:
        return grid.cells_of_points(self.local(), self.domain, self.size)

    def heliport_cells(self) -> DataFrame:
        return self.placed().where("layer = 'heliport'")

    def terminals(self) -> DataFrame:
        return self.placed().where("layer = 'vertiport'").select("feature_id", "q", "r")

    def grid_state(self) -> DataFrame:
        """Cells with unit cost, restricted where a heliport is."""
        blank = self.cells().select("q", "r", F.lit(1.0).alias("cost"), F.lit(False).alias("restricted"))
        now = sites.restricted_cells(self.heliport_cells())
        return sites.apply_restrictions(blank, now.withColumn("change", F.lit("added")))

    def vertices(self) -> DataFrame:
        return sites.traversable(self.grid_state()).select("q", "r", "cost")

    def paths(self) -> DataFrame:
        """Straight cell lines between consecutive vertiports whose cells differ.

        Legs are dealt out before each makes its line, since a file of points may be a single split. The line goes through
        `inline`, so that filters on it are not pushed below the dealing, where every line would be made once more.
        """
        at = self.terminals().withColumn("back", -F.col("feature_id"))
        after = running(at, [], "back", {"next": ("last", F.struct("q", "r"))}, inclusive=False, width=LEG_RANGE)
        legs = after.where("next is not null and (next.q <> q or next.r <> r)").repartition(shuffle_width(self.spark))
        line = hx.line_cells(F.col("q"), F.col("r"), F.col("next.q"), F.col("next.r"))
        return legs.select(F.col("feature_id").alias("path_id"), F.inline(F.array(F.struct(line.alias("cells")))))

    def intents(self) -> DataFrame:
        here = frame.to_local(intents(self.spark, self.sf_dir), self.domain)
        placed = grid.cells_of_points(here, self.domain, self.size)
        return placed.select("seq", "ts", "session_id", "kind", "q", "r")


class GeoSite(Site):
    """The fixture over a frame that comes from longitude and latitude, with intents where a user clicks on a map."""

    @cached_property
    def _framed(self) -> tuple[DataFrame, SimpleNamespace]:
        return frame.geographic_domain(geo(self.spark, self.sf_dir), PADDING, MARGIN)

    @cached_property
    def domain(self) -> SimpleNamespace:
        return self._framed[1]

    def local(self) -> DataFrame:
        return frame.to_local(self._framed[0], self.domain).select("layer", "feature_id", "x", "y")

    def intents(self) -> DataFrame:
        clicks = on_map(intents(self.spark, self.sf_dir))
        placed = grid.cells_of_points(frame.positions(clicks, self.domain), self.domain, self.size)
        return placed.select("seq", "ts", "session_id", "kind", "q", "r")


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    kind = (
        F.when(F.col("event_type") == "purchase", "add")
        .when(F.col("event_type") == "error", "remove")
        .when(F.col("event_type") == "click", "toggle")
        .otherwise("other")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        user.alias("session_id"),
        kind.alias("kind"),
        ((user * 3571) % 20001 - 10000).cast("double").alias("x"),
        ((user * 7919) % 15001 - 7500).cast("double").alias("y"),
    )
