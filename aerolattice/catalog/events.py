"""Intent queries: the batch forms of the stateful operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aerolattice.catalog import fixtures as fx
from aerolattice.catalog.fixtures import with_views
from aerolattice.catalog.registry import c, query
from aerolattice.operators import intents, sites
from aerolattice.runtime import shared_folder
from aerolattice.streaming import store


@query("intent_cells", with_views("intent_at", "SELECT seq, kind, q, r FROM intent_at"))
def intent_cells(spark, d):
    return fx.Site(spark, d).intents().select("seq", "kind", "q", "r")


@query(
    "intent_route",
    with_views("fx_intents", "SELECT seq, kind, CASE WHEN kind IN ('add', 'remove', 'toggle') THEN 'cell' ELSE 'dead_letter' END AS route FROM fx_intents"),
)
def intent_route(spark, d):
    known, dead = intents.routed(fx.intents(spark, d))
    return known.select("seq", "kind", F.lit("cell").alias("route")).unionByName(dead.select("seq", "kind", F.lit("dead_letter").alias("route")))


def folded_state(spark, d, log):
    site = fx.Site(spark, d)
    heliports = site.heliport_cells()
    start = intents.start_states(site.terminals(), sites.restricted_cells(heliports))
    return intents.fold_states(log(site.intents()), start, heliports)


def fold_sql(kind_sql):
    """Recursive replay of each cell's log; state = vertiport + 2 * restricted."""
    return with_views(
        "intent_at vterm hcells",
        """SELECT q, r, state % 2 = 1 AS vertiport, state >= 2 AS restricted FROM (SELECT q, r, arg_max(state, n) AS state FROM walk GROUP BY q, r)""",
        recursive=f"""
keyed AS ({kind_sql}),
start AS (SELECT q, r, max(v) + 2 * max(x) AS state FROM (SELECT q, r, 1 AS v, 0 AS x FROM vterm UNION ALL SELECT q, r, 0, 1 FROM hcells) GROUP BY q, r),
cells_seen AS (SELECT q, r FROM start UNION SELECT q, r FROM keyed WHERE kind <> 'clear'),
steps AS (SELECT c.q, c.r, k.kind, h.q IS NOT NULL AS heli, row_number() OVER (PARTITION BY c.q, c.r ORDER BY k.seq) AS n
          FROM cells_seen c JOIN keyed k ON (k.kind = 'clear' OR (k.q = c.q AND k.r = c.r)) LEFT JOIN hcells h ON h.q = c.q AND h.r = c.r),
walk(q, r, n, state) AS (
  SELECT c.q, c.r, CAST(0 AS BIGINT), coalesce(s.state, 0) FROM cells_seen c LEFT JOIN start s ON s.q = c.q AND s.r = c.r
  UNION ALL
  SELECT w.q, w.r, t.n, CASE
      WHEN t.kind IN ('remove', 'clear') THEN w.state - w.state % 2
      WHEN t.heli THEN w.state
      WHEN t.kind = 'add' AND w.state = 0 THEN 1
      WHEN t.kind = 'toggle' AND w.state % 2 = 0 THEN 2 - w.state
      WHEN t.kind = 'toggle_vertiport' AND w.state % 2 = 1 THEN w.state - 1
      WHEN t.kind = 'toggle_vertiport' AND w.state = 0 THEN 1
      ELSE w.state END
  FROM walk w JOIN steps t ON t.q = w.q AND t.r = w.r AND t.n = w.n + 1)""",
    )


@query("intent_state", fold_sql("SELECT seq, kind, q, r FROM intent_at"))
def intent_state(spark, d):
    return folded_state(spark, d, lambda log: log)


@query("intent_add", fold_sql("SELECT seq, kind, q, r FROM intent_at WHERE kind = 'add'"))
def intent_add(spark, d):
    return folded_state(spark, d, lambda log: log.where("kind = 'add'"))


@query("intent_remove", fold_sql("SELECT seq, kind, q, r FROM intent_at WHERE kind = 'remove'"))
def intent_remove(spark, d):
    return folded_state(spark, d, lambda log: log.where("kind = 'remove'"))


@query("intent_toggle", fold_sql("SELECT seq, kind, q, r FROM intent_at WHERE kind = 'toggle'"))
def intent_toggle(spark, d):
    return folded_state(spark, d, lambda log: log.where("kind = 'toggle'"))


CLICK_SQL = "SELECT seq, CASE kind WHEN 'add' THEN 'toggle_vertiport' WHEN 'remove' THEN 'toggle_vertiport' ELSE kind END AS kind, q, r FROM intent_at"


@query("intent_click", fold_sql(CLICK_SQL))
def intent_click(spark, d):
    """Additions and removals as left clicks, toggles as right clicks."""
    left = F.when(c.kind.isin("add", "remove"), "toggle_vertiport").otherwise(c.kind)
    return folded_state(spark, d, lambda log: log.withColumn("kind", left))


@query("clear_vertiports", fold_sql("SELECT seq, CASE WHEN seq % 500 = 0 THEN 'clear' ELSE kind END AS kind, q, r FROM intent_at"))
def clear_vertiports(spark, d):
    """Every intent numbered by a multiple of five hundred is a clear."""
    return folded_state(spark, d, lambda log: log.withColumn("kind", F.when(c.seq % 500 == 0, "clear").otherwise(c.kind)))


DRAG_SQL = """SELECT session_id, seq, from_q, from_r, q AS to_q, r AS to_r FROM (
  SELECT session_id, seq, action, q, r, lag(action) OVER w AS was, lag(q) OVER w AS from_q, lag(r) OVER w AS from_r
  FROM (SELECT session_id, seq, q, r, CASE WHEN kind = 'add' OR kind = 'toggle' THEN 'press' ELSE 'release' END AS action FROM intent_at WHERE kind <> 'other')
  WINDOW w AS (PARTITION BY session_id ORDER BY seq)) WHERE action = 'release' AND was = 'press'"""


@query("intent_drag", with_views("intent_at", DRAG_SQL))
def intent_drag(spark, d):
    """Additions and toggles as right presses, removals as right releases; other intents as left presses."""
    log = fx.Site(spark, d).intents()
    action = F.when(c.kind.isin("add", "toggle"), "press").when(c.kind == "remove", "release").otherwise("press")
    button = F.when(c.kind == "other", "left").otherwise("right")
    return intents.drag_pairs(log.select("session_id", "seq", button.alias("button"), action.alias("action"), "q", "r"))


LAST_WRITES_SQL = "SELECT user_id AS run_id, event_type AS artifact, max(event_id) AS seq, arg_max(value, event_id) AS payload FROM events GROUP BY ALL"


@query("publish_store", LAST_WRITES_SQL)
def publish_store(spark, d):
    """Last writes of a store on disk that took in the later half of the log, then the earlier half, then that once more."""
    log = fx.table(spark, d, "events").select(
        c.user_id.alias("run_id"), c.event_type.alias("artifact"), c.event_id.alias("seq"), c.value.alias("payload")
    )
    half, folder = log.agg(F.max("seq")).first()[0] // 2, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for part in (log.where(c.seq > half), log.where(c.seq <= half), log.where(c.seq <= half)):
        store.take_in(part, folder, 4)
    return store.stored(spark, folder, log.schema)


@query("publish_upsert", LAST_WRITES_SQL)
def publish_upsert(spark, d):
    """Last write per run and artifact, after the second half of the log is applied to the first half's table."""
    from aerolattice.operators.lineage import upserted

    log = fx.table(spark, d, "events").select(
        c.user_id.alias("run_id"), c.event_type.alias("artifact"), c.event_id.alias("seq"), c.value.alias("payload")
    )
    half = log.agg(F.max("seq")).first()[0] // 2
    return upserted(upserted(None, log.where(c.seq <= half)), log.where(c.seq > half))
