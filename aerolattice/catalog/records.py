"""Lineage, message and text queries.

Contracts are read off the trade tables: suppliers produce parts, orders consume parts and produce deliveries,
customers consume deliveries and produce accounts, nations and regions follow. Runs are users' event logs over the
planning pipeline's own contracts, and messages are the turns of conversations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolattice.catalog.fixtures import table
from aerolattice.catalog.registry import c, query
from aerolattice.functions import text
from aerolattice.operators import lineage, messages
from aerolattice.runtime import shuffle_width

TRADE_SQL = """
SELECT 'S' || min(l_suppkey) AS module, 'P' || l_partkey AS artifact, 'PRODUCED' AS role FROM lineitem GROUP BY l_partkey
UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey, 'CONSUMED' FROM lineitem
UNION ALL SELECT 'O' || o_orderkey, 'D' || o_orderkey, 'PRODUCED' FROM orders
UNION ALL SELECT 'C' || o_custkey, 'D' || o_orderkey, 'CONSUMED' FROM orders
UNION ALL SELECT 'C' || c_custkey, 'A' || c_custkey, 'PRODUCED' FROM customer
UNION ALL SELECT 'N' || c_nationkey, 'A' || c_custkey, 'CONSUMED' FROM customer
UNION ALL SELECT 'N' || n_nationkey, 'G' || n_nationkey, 'PRODUCED' FROM nation
UNION ALL SELECT 'R' || n_regionkey, 'G' || n_nationkey, 'CONSUMED' FROM nation
UNION ALL SELECT 'R' || n_regionkey, 'A' || n_nationkey, 'MUTATES' FROM nation"""


def trade(spark, d):
    """The contracts of TRADE_SQL."""
    item, order = table(spark, d, "lineitem"), table(spark, d, "orders")
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")

    def tag(letter, key):
        return F.concat(F.lit(letter), F.col(key).cast("string"))

    def rows(source, module, artifact, role):
        return source.select(tag(*module).alias("module"), tag(*artifact).alias("artifact"), F.lit(role).alias("role"))

    takes = item.select("l_orderkey", "l_partkey").repartition("l_orderkey", "l_partkey").distinct()
    first = item.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    parts = [
        rows(first, ("S", "l_suppkey"), ("P", "l_partkey"), "PRODUCED"),
        rows(takes, ("O", "l_orderkey"), ("P", "l_partkey"), "CONSUMED"),
        rows(order, ("O", "o_orderkey"), ("D", "o_orderkey"), "PRODUCED"),
        rows(order, ("C", "o_custkey"), ("D", "o_orderkey"), "CONSUMED"),
        rows(customer, ("C", "c_custkey"), ("A", "c_custkey"), "PRODUCED"),
        rows(customer, ("N", "c_nationkey"), ("A", "c_custkey"), "CONSUMED"),
        rows(nation, ("N", "n_nationkey"), ("G", "n_nationkey"), "PRODUCED"),
        rows(nation, ("R", "n_regionkey"), ("G", "n_nationkey"), "CONSUMED"),
        rows(nation, ("R", "n_regionkey"), ("A", "n_nationkey"), "MUTATES"),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined


CHANGED_SQL = "SELECT DISTINCT 'P' || l_partkey AS artifact FROM lineitem WHERE l_discount > 0.095e0"
VALIDITY_SQL = "SELECT 'D' || o_orderkey AS artifact, o_orderstatus <> 'P' AS valid FROM orders"


def changed(spark, d):
    """Parts sold at the highest discount."""
    hit = table(spark, d, "lineitem").where("l_discount > 0.095D")
    return hit.select(F.concat(F.lit("P"), c.l_partkey.cast("string")).alias("artifact")).distinct()


def validity(spark, d):
    order = table(spark, d, "orders")
    return order.select(F.concat(F.lit("D"), c.o_orderkey.cast("string")).alias("artifact"), (c.o_orderstatus != "P").alias("valid"))


EDGES_SQL = """SELECT DISTINCT a.module AS producer, b.module AS consumer
FROM trade a JOIN trade b ON a.artifact = b.artifact AND a.role = 'PRODUCED' AND b.role = 'CONSUMED'"""


def over_trade(body, more=""):
    return f"WITH trade AS ({TRADE_SQL}){more}\n{body}"


@query("dep_edges", over_trade(EDGES_SQL))
def dep_edges(spark, d):
    return lineage.dependency_edges(trade(spark, d))


@query("upstream", over_trade(f"SELECT consumer AS module, count(*) AS upstream FROM ({EDGES_SQL}) GROUP BY consumer"))
def upstream(spark, d):
    hops = lineage.upstream(lineage.dependency_edges(trade(spark, d)))
    return hops.groupBy("module").agg(F.count("*").alias("upstream"))


@query("downstream", over_trade(f"SELECT producer AS module, count(*) AS downstream FROM ({EDGES_SQL}) GROUP BY producer"))
def downstream(spark, d):
    hops = lineage.downstream(lineage.dependency_edges(trade(spark, d)))
    return hops.groupBy("module").agg(F.count("*").alias("downstream"))


@query("impacted_modules", over_trade(f"SELECT DISTINCT module FROM trade WHERE role = 'CONSUMED' AND artifact IN ({CHANGED_SQL})"))
def impacted_modules(spark, d):
    return lineage.impacted_modules(trade(spark, d), changed(spark, d))


@query(
    "impacted_artifacts",
    over_trade(
        f"""SELECT DISTINCT artifact FROM trade WHERE role = 'PRODUCED' AND module IN
            (SELECT module FROM trade WHERE role = 'CONSUMED' AND artifact IN ({CHANGED_SQL}))"""
    ),
)
def impacted_artifacts(spark, d):
    contracts = trade(spark, d)
    return lineage.impacted_artifacts(contracts, lineage.impacted_modules(contracts, changed(spark, d)))


@query(
    "duplicate_producers",
    """SELECT 'P' || l_partkey AS artifact, count(DISTINCT l_suppkey) AS producers, min('S' || l_suppkey) AS first_producer, max('S' || l_suppkey) AS last_producer
       FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1""",
)
def duplicate_producers(spark, d):
    item = table(spark, d, "lineitem")
    claims = item.select(
        F.concat(F.lit("S"), c.l_suppkey.cast("string")).alias("module"),
        F.concat(F.lit("P"), c.l_partkey.cast("string")).alias("artifact"),
        F.lit("PRODUCED").alias("role"),
    )
    return lineage.duplicate_producers(claims)


GONE_SQL = "SELECT 'O' || o_orderkey AS module FROM orders WHERE o_orderpriority = '1-URGENT'"


@query(
    "unregister",
    over_trade(
        f"""SELECT artifact, valid FROM val WHERE artifact NOT IN (SELECT artifact FROM trade WHERE role = 'PRODUCED' AND module IN (SELECT module FROM gone))
            OR artifact IN (SELECT artifact FROM trade WHERE role = 'PRODUCED' AND module NOT IN (SELECT module FROM gone))""",
        f", gone AS ({GONE_SQL}), val AS ({VALIDITY_SQL})",
    ),
)
def unregister(spark, d):
    gone = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    gone = gone.select(F.concat(F.lit("O"), c.o_orderkey.cast("string")).alias("module"))
    return lineage.unregister(trade(spark, d), validity(spark, d), gone)[1]


CLOSURE_SQL = f"""WITH RECURSIVE trade AS ({TRADE_SQL}), val AS ({VALIDITY_SQL}), changed AS ({CHANGED_SQL}),
flow AS (SELECT DISTINCT u.artifact AS up, m.artifact AS down FROM trade u JOIN trade m ON u.module = m.module AND u.role = 'CONSUMED' AND m.role = 'PRODUCED'
         WHERE m.artifact NOT IN (SELECT artifact FROM val WHERE NOT valid)),
walk(artifact, fell) AS (SELECT artifact, false FROM changed UNION SELECT flow.down, true FROM walk JOIN flow ON flow.up = walk.artifact)"""


@query(
    "invalidation_closure",
    CLOSURE_SQL + "\nSELECT DISTINCT module FROM trade WHERE role = 'CONSUMED' AND artifact IN (SELECT artifact FROM walk)",
)
def invalidation_closure(spark, d):
    return lineage.invalidation_closure(trade(spark, d), changed(spark, d), validity(spark, d))[0]


@query(
    "validity_diff",
    CLOSURE_SQL + "\nSELECT DISTINCT artifact, 'became_invalid' AS change FROM walk WHERE fell",
)
def validity_diff(spark, d):
    """Validity before and after the mutation of the changed parts."""
    before = validity(spark, d)
    fallen = lineage.invalidation_closure(trade(spark, d), changed(spark, d), before)[1].withColumn("valid", F.lit(False))
    after = before.join(fallen, "artifact", "left_anti").unionByName(fallen)
    return lineage.validity_diff(before, after)


# runs over the planning pipeline

# The contracts of the planning stages.
PIPELINE = """config yaml PRODUCED
sources yaml CONSUMED
sources geodata PRODUCED
domain geodata CONSUMED
domain yaml CONSUMED
domain domain PRODUCED
align geodata CONSUMED
align domain CONSUMED
align heliports PRODUCED
align vertiports PRODUCED
grid domain CONSUMED
grid yaml CONSUMED
grid grid PRODUCED
restrict heliports CONSUMED
restrict vertiports CONSUMED
restrict grid MUTATES
routes heliports CONSUMED
routes vertiports CONSUMED
routes grid CONSUMED
routes yaml CONSUMED
routes routes PRODUCED"""
PIPELINE_ROWS = [tuple(line.split()) for line in PIPELINE.splitlines()]
PIPELINE_SQL = "SELECT * FROM (VALUES " + ", ".join(str(row) for row in PIPELINE_ROWS) + ") t(module, artifact, role)"
MODULES = {"view": "config", "click": "sources", "signup": "domain", "purchase": "grid"}
ARTIFACTS = {"view": "yaml", "click": "geodata", "signup": "domain", "purchase": "grid"}


def case_sql(mapping, other):
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{other}' END"


RUNS_SQL = f"SELECT user_id AS run_id, event_id AS seq, {case_sql(MODULES, 'routes')} AS module, {case_sql(ARTIFACTS, 'routes')} AS artifact FROM events"


def runs(spark, d, modules=MODULES, other="routes", other_artifact="routes"):
    def pick(mapping, default):
        chosen = F.lit(default)
        for kind, value in mapping.items():
            chosen = F.when(c.event_type == kind, F.lit(value)).otherwise(chosen)
        return chosen

    return table(spark, d, "events").select(
        c.user_id.alias("run_id"),
        c.event_id.alias("seq"),
        pick(modules, other).alias("module"),
        pick(ARTIFACTS, other_artifact).alias("artifact"),
    )


def pipeline(spark):
    return spark.createDataFrame(PIPELINE_ROWS, "module string, artifact string, role string")


def over_runs(body, more=""):
    return f"WITH pub AS ({RUNS_SQL}), con AS ({PIPELINE_SQL}){more}\n{body}"


VERSIONS_SQL = "SELECT run_id, seq, module, artifact, row_number() OVER (PARTITION BY run_id, artifact ORDER BY seq) AS version FROM pub"
NOTED_SQL = f"""SELECT p.run_id, p.seq, p.artifact, k.artifact AS dependency, coalesce(max(v.version), 0) AS version
FROM pub p JOIN con k ON k.module = p.module AND k.role = 'CONSUMED'
LEFT JOIN ({VERSIONS_SQL}) v ON v.run_id = p.run_id AND v.artifact = k.artifact AND v.seq <= p.seq
GROUP BY p.run_id, p.seq, p.artifact, k.artifact"""


@query("artifact_versions", over_runs(VERSIONS_SQL))
def artifact_versions(spark, d):
    return lineage.artifact_versions(runs(spark, d))


@query(
    "latest_artifact",
    over_runs("SELECT run_id, artifact, max(seq) AS seq, arg_max(module, seq) AS module FROM pub GROUP BY run_id, artifact"),
)
def latest_artifact(spark, d):
    return lineage.latest(runs(spark, d))


@query("dependency_versions", over_runs(NOTED_SQL))
def dependency_versions(spark, d):
    return lineage.dependency_versions(pipeline(spark), runs(spark, d))


@query(
    "stale_artifacts",
    over_runs(
        f"""SELECT n.run_id, n.artifact, n.dependency, n.recorded, l.newest FROM
              (SELECT run_id, artifact, dependency, arg_max(version, seq) AS recorded FROM ({NOTED_SQL}) GROUP BY ALL) n
            JOIN (SELECT run_id, artifact, count(*) AS newest FROM pub GROUP BY ALL) l ON l.run_id = n.run_id AND l.artifact = n.dependency
            WHERE recorded <> newest"""
    ),
)
def stale_artifacts(spark, d):
    return lineage.stale_artifacts(pipeline(spark), runs(spark, d))


DIRTY_SQL = """SELECT c.run_id, k.module, m.artifact AS product, k.artifact AS dependency, p.at IS NULL OR c.at > p.at AS dirty
FROM con k JOIN con m ON m.module = k.module AND k.role = 'CONSUMED' AND m.role = 'PRODUCED'
JOIN (SELECT run_id, artifact, max(seq) AS at FROM pub GROUP BY ALL) c ON c.artifact = k.artifact
LEFT JOIN (SELECT run_id, artifact, max(seq) AS at FROM pub GROUP BY ALL) p ON p.run_id = c.run_id AND p.artifact = m.artifact"""


@query("dirty_status", over_runs(DIRTY_SQL))
def dirty_status(spark, d):
    return lineage.dirty_status(pipeline(spark), runs(spark, d))


@query(
    "dirty_queries",
    over_runs(
        f"""SELECT run_id, module, product, bool_or(dirty) AS any_dirty, count(*) FILTER (WHERE dirty) =
                   (SELECT count(*) FROM con k WHERE k.module = s.module AND k.role = 'CONSUMED') AS all_dirty, count(*) FILTER (WHERE dirty) AS dirty
            FROM ({DIRTY_SQL}) s GROUP BY run_id, module, product"""
    ),
)
def dirty_queries(spark, d):
    contracts = pipeline(spark)
    return lineage.dirty_summary(lineage.dirty_status(contracts, runs(spark, d)), contracts)


@query(
    "fire_any",
    over_runs(
        """SELECT run_id, module, seq FROM (
             SELECT h.*, (SELECT count(DISTINCT e.artifact) FROM heard e WHERE e.run_id = h.run_id AND e.module = h.module AND e.seq <= h.seq) AS seen,
                    (SELECT count(*) FROM con k WHERE k.module = h.module AND k.role = 'CONSUMED') AS needed FROM heard h) WHERE seen = needed""",
        ", heard AS (SELECT p.run_id, p.seq, k.module, k.artifact FROM pub p JOIN con k ON k.artifact = p.artifact AND k.role = 'CONSUMED')",
    ),
)
def fire_any(spark, d):
    return lineage.fire_any(pipeline(spark), runs(spark, d))


@query(
    "fire_all",
    f"""WITH RECURSIVE pub AS ({RUNS_SQL}), con AS ({PIPELINE_SQL}),
        bits AS (SELECT module, artifact, CAST(1 << (row_number() OVER (PARTITION BY module ORDER BY artifact) - 1) AS INT) AS bit,
                        CAST((1 << count(*) OVER (PARTITION BY module)) - 1 AS INT) AS full_mask FROM con WHERE role = 'CONSUMED'),
        heard AS (SELECT p.run_id, b.module, p.seq, b.bit, b.full_mask, row_number() OVER (PARTITION BY p.run_id, b.module ORDER BY p.seq) AS n
                  FROM pub p JOIN bits b ON b.artifact = p.artifact),
        walk(run_id, module, n, seq, mask, fired) AS (
          SELECT run_id, module, n, seq, CASE WHEN bit = full_mask THEN 0 ELSE bit END, bit = full_mask FROM heard WHERE n = 1
          UNION ALL
          SELECT h.run_id, h.module, h.n, h.seq, CASE WHEN (w.mask | h.bit) = h.full_mask THEN 0 ELSE w.mask | h.bit END, (w.mask | h.bit) = h.full_mask
          FROM walk w JOIN heard h ON h.run_id = w.run_id AND h.module = w.module AND h.n = w.n + 1)
        SELECT run_id, module, seq FROM walk WHERE fired""",
)
def fire_all(spark, d):
    return lineage.fire_all(pipeline(spark), runs(spark, d))


@query(
    "missing_deps",
    over_runs(
        """SELECT r.run_id, k.module, k.artifact FROM (SELECT DISTINCT run_id FROM pub) r, con k
           WHERE k.role = 'CONSUMED' AND NOT EXISTS (SELECT 1 FROM pub p WHERE p.run_id = r.run_id AND p.artifact = k.artifact)"""
    ),
)
def missing_deps(spark, d):
    log = runs(spark, d)
    wanted = F.array(*[F.struct(F.lit(m).alias("module"), F.lit(a).alias("artifact")) for m, a, role in PIPELINE_ROWS if role == "CONSUMED"])
    needs = log.select("run_id").distinct().select("run_id", F.inline(wanted))
    return lineage.missing_dependencies(needs, log).select("run_id", "module", "artifact")


@query("validity_after_publish")
def validity_after_publish(spark, d):
    """Runs in which views and errors are direct writes to the configuration and the grid by modules that do not own them."""
    modules = dict(MODULES, view="operator")
    return lineage.validity_after(pipeline(spark), runs(spark, d, modules, "restrict", "grid"))


RING_ROWS = [
    ("ping", "b", "CONSUMED"),
    ("ping", "a", "PRODUCED"),
    ("pong", "a", "CONSUMED"),
    ("pong", "b", "PRODUCED"),
    ("tail", "b", "CONSUMED"),
    ("tail", "t", "PRODUCED"),
]
RING_MODULES = {"view": "ping", "click": "pong", "signup": "tail"}
RING_ARTIFACTS = {"view": "a", "click": "b", "signup": "t", "purchase": "a"}


def lookup(names):
    return F.create_map(*[F.lit(v) for pair in names.items() for v in pair])[c.event_type]


@query(
    "validity_on_cycle",
    f"""WITH RECURSIVE pub AS (SELECT user_id AS run_id, {case_sql(RING_MODULES, 'operator')} AS module, {case_sql(RING_ARTIFACTS, 'b')} AS artifact,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        walk(run_id, n, a, b, t) AS (
          SELECT DISTINCT run_id, CAST(0 AS BIGINT), false, false, false FROM pub
          UNION ALL
          SELECT w.run_id, p.n,
                 CASE WHEN module = 'ping' THEN true WHEN module = 'operator' THEN a AND artifact = 'a' AND NOT b ELSE a END,
                 CASE WHEN module = 'pong' THEN true WHEN module = 'operator' THEN b AND artifact = 'b' AND NOT a ELSE b END,
                 CASE WHEN module = 'tail' THEN true WHEN module = 'operator' THEN t AND artifact = 'a' AND NOT b ELSE t END
          FROM walk w JOIN pub p ON p.run_id = w.run_id AND p.n = w.n + 1),
        ends AS (SELECT run_id, arg_max(a, n) AS a, arg_max(b, n) AS b, arg_max(t, n) AS t FROM walk GROUP BY run_id)
        SELECT run_id, 'a' AS artifact, a AS valid FROM ends UNION ALL SELECT run_id, 'b', b FROM ends UNION ALL SELECT run_id, 't', t FROM ends""",
)
def validity_on_cycle(spark, d):
    """Two modules that feed each other and one behind them, with direct writes to what the two make."""
    rules = spark.createDataFrame(RING_ROWS, "module string, artifact string, role string")
    log = table(spark, d, "events").select(
        c.user_id.alias("run_id"),
        c.event_id.alias("seq"),
        F.coalesce(lookup(RING_MODULES), F.lit("operator")).alias("module"),
        F.coalesce(lookup(RING_ARTIFACTS), F.lit("b")).alias("artifact"),
    )
    return lineage.validity_after(rules, log)


NODES_SQL = f"""SELECT 'F' || (CAST(substr(module, 2) AS BIGINT) % 50) AS flow, module,
       CASE substr(module, 1, 1) WHEN 'S' THEN 'INPUT' WHEN 'R' THEN 'OUTPUT' WHEN 'N' THEN 'INPUT' ELSE 'TRANSFORM' END AS kind,
       substr(module, 1, 1) = 'R' OR CAST(substr(module, 2) AS BIGINT) % 100 = 7 AS returns, artifact, role FROM trade"""


@query(
    "contract_lint",
    over_trade(
        """SELECT flow, module, unnest(list_filter([
               CASE WHEN kind = 'INPUT' AND used > 0 THEN 'input_consumes' END,
               CASE WHEN kind = 'INPUT' AND made = 0 THEN 'input_produces_nothing' END,
               CASE WHEN kind = 'INPUT' AND returns THEN 'input_returns_value' END,
               CASE WHEN kind = 'TRANSFORM' AND used = 0 THEN 'transform_consumes_nothing' END,
               CASE WHEN kind = 'TRANSFORM' AND made = 0 THEN 'transform_produces_nothing' END,
               CASE WHEN kind = 'TRANSFORM' AND returns THEN 'transform_returns_value' END,
               CASE WHEN kind = 'OUTPUT' AND used = 0 THEN 'output_consumes_nothing' END,
               CASE WHEN kind = 'OUTPUT' AND made > 0 THEN 'output_produces' END,
               CASE WHEN kind = 'OUTPUT' AND NOT returns THEN 'output_returns_nothing' END,
               CASE WHEN used > used_kinds OR made > made_kinds THEN 'artifact_twice' END,
               CASE WHEN both_ways > 0 THEN 'consumes_what_it_produces' END], lambda x: x IS NOT NULL)) AS rule FROM node
           UNION ALL SELECT flow, NULL, 'many_inputs' FROM node GROUP BY flow HAVING count(*) FILTER (WHERE kind = 'INPUT') > 1
           UNION ALL SELECT flow, NULL, 'many_outputs' FROM node GROUP BY flow HAVING count(*) FILTER (WHERE kind = 'OUTPUT') > 1""",
        f""", nodes AS ({NODES_SQL}), node AS (
            SELECT flow, module, kind, returns, count(*) FILTER (WHERE role = 'CONSUMED') AS used, count(*) FILTER (WHERE role = 'PRODUCED') AS made,
                   count(DISTINCT artifact) FILTER (WHERE role = 'CONSUMED') AS used_kinds, count(DISTINCT artifact) FILTER (WHERE role = 'PRODUCED') AS made_kinds,
                   count(DISTINCT artifact) FILTER (WHERE role = 'CONSUMED') + count(DISTINCT artifact) FILTER (WHERE role = 'PRODUCED')
                     - count(DISTINCT artifact) FILTER (WHERE role IN ('CONSUMED', 'PRODUCED')) AS both_ways FROM nodes GROUP BY flow, module, kind, returns)""",
    ),
)
def contract_lint(spark, d):
    return lineage.contract_lint(flow_nodes(spark, d))


def flow_nodes(spark, d):
    number, letter = F.expr("cast(substr(module, 2) as bigint)"), F.substring("module", 1, 1)
    kind = F.when(letter.isin("S", "N"), "INPUT").when(letter == "R", "OUTPUT").otherwise("TRANSFORM")
    return trade(spark, d).select(
        F.concat(F.lit("F"), (number % 50).cast("string")).alias("flow"),
        "module",
        kind.alias("kind"),
        ((letter == "R") | (number % 100 == 7)).alias("returns"),
        "artifact",
        "role",
    )


@query(
    "contract_lint_inputs",
    over_trade(
        """SELECT DISTINCT flow, module, rule FROM (
             SELECT flow, module, 'optional_dependency' AS rule FROM nodes WHERE role = 'CONSUMED' AND substr(artifact, 2) LIKE '%7'
             UNION ALL SELECT flow, module, 'output_takes_outside_input' FROM nodes WHERE kind = 'OUTPUT' AND module IN ('R1', 'R3')
             UNION ALL SELECT flow, module, 'output_returns_artifact' FROM nodes WHERE kind = 'OUTPUT' AND module IN ('R2', 'R3'))""",
        f", nodes AS ({NODES_SQL})",
    ),
)
def contract_lint_inputs(spark, d):
    """The rules on optional dependencies, outside inputs and returned artifacts."""
    told = flow_nodes(spark, d).withColumns(
        {
            "optional": c.artifact.endswith("7"),
            "outside": c.module.isin("R1", "R3", "N3").cast("int"),
            "wraps": c.module.isin("R2", "R3", "N3"),
        }
    )
    rules = ["optional_dependency", "output_takes_outside_input", "output_returns_artifact"]
    return lineage.contract_lint(told).where(c.rule.isin(rules))


# messages

MESSAGES_SQL = """SELECT conv_id * 1000 + turn AS trace_id, CASE WHEN role = 'assistant' THEN conv_id * 1000 + turn - 1 END AS reply_to,
       conv_id % 7 AS topic, role AS from_id, CASE role WHEN 'system' THEN 'BROADCAST' WHEN 'user' THEN 'assistant' ELSE 'user' END AS to_id,
       CASE WHEN conv_id % 5 = 0 THEN ['user'] ELSE [] END AS exclude_ids, conv_id * 1000 + turn AS seq FROM conversations"""


def talk(spark, d):
    to_id = F.when(c.role == "system", "BROADCAST").when(c.role == "user", "assistant").otherwise("user")
    trace = c.conv_id * 1000 + c.turn
    return table(spark, d, "conversations").select(
        trace.alias("trace_id"),
        F.when(c.role == "assistant", trace - 1).alias("reply_to"),
        (c.conv_id % 7).alias("topic"),
        c.role.alias("from_id"),
        to_id.alias("to_id"),
        F.when(c.conv_id % 5 == 0, F.array(F.lit("user"))).otherwise(F.array().cast("array<string>")).alias("exclude_ids"),
        trace.alias("seq"),
    )


def subscribers(sent):
    """Whoever speaks on a topic listens to it, except assistants on topic 3."""
    return sent.select("topic", c.from_id.alias("subscriber")).where("not (topic = 3 and subscriber = 'assistant')").distinct()


def over_talk(body):
    return f"""WITH msg AS ({MESSAGES_SQL}), sub AS (SELECT DISTINCT topic, from_id AS subscriber FROM msg WHERE NOT (topic = 3 AND from_id = 'assistant')),
del AS (SELECT trace_id, m.topic, from_id, subscriber FROM msg m JOIN sub s ON s.topic = m.topic
        AND ((to_id = 'BROADCAST' AND subscriber <> from_id AND NOT list_contains(exclude_ids, subscriber)) OR subscriber = to_id))
{body}"""


@query("deliveries", over_talk("SELECT trace_id, topic, from_id, subscriber FROM del"))
def deliveries(spark, d):
    sent = talk(spark, d)
    return messages.deliveries(sent, subscribers(sent))


@query(
    "delivery_state",
    over_talk(
        """SELECT trace_id, CASE WHEN trace_id IN (SELECT trace_id FROM del) THEN 'OK' ELSE 'FAIL' END || CASE WHEN reply_to IS NULL THEN '_REQUEST' ELSE '_REPLY' END AS state FROM msg"""
    ),
)
def delivery_state(spark, d):
    sent = talk(spark, d)
    known = messages.with_delivered(sent, messages.deliveries(sent, subscribers(sent)))
    return known.select("trace_id", messages.delivery_state(c.delivered, c.reply_to).alias("state"))


@query(
    "reply_match",
    over_talk("SELECT a.trace_id AS request_id, a.from_id AS asked_by, b.trace_id AS reply_id, b.from_id AS answered_by FROM msg a LEFT JOIN msg b ON b.reply_to = a.trace_id"),
)
def reply_match(spark, d):
    return messages.reply_match(talk(spark, d))


@query("open_traces", over_talk("SELECT trace_id, from_id FROM msg WHERE trace_id NOT IN (SELECT reply_to FROM msg WHERE reply_to IS NOT NULL)"))
def open_traces(spark, d):
    sent = talk(spark, d)
    return messages.open_traces(sent, sent.where("reply_to is not null").select(c.reply_to.alias("trace_id"))).select("trace_id", "from_id")


@query(
    "lifecycle_changes",
    """SELECT component, seq, state FROM (SELECT user_id AS component, event_id AS seq, event_type AS state,
              lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM state""",
)
def lifecycle_changes(spark, d):
    states = table(spark, d, "events").select(c.user_id.alias("component"), c.event_id.alias("seq"), c.event_type.alias("state"))
    return messages.lifecycle_changes(states)


@query(
    "publisher_ids",
    """SELECT publisher, first_seq, 3 + dense_rank() OVER (ORDER BY first_seq) AS publisher_id
       FROM (SELECT 'user' || user_id AS publisher, min(event_id) AS first_seq FROM events GROUP BY user_id)""",
)
def publisher_ids(spark, d):
    sent = table(spark, d, "events").select(F.concat(F.lit("user"), c.user_id.cast("string")).alias("from_id"), c.event_id.alias("seq"))
    return messages.publisher_ids(sent)


@query(
    "trace_label",
    """SELECT o_orderkey, 't:' || right(CAST(o_orderkey AS VARCHAR), 4) AS trace, coalesce(s_name, 'Publisher') || '#p:' || o_custkey AS publisher
       FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey""",
)
def trace_label(spark, d):
    """Publishers go by supplier names; there are more customers than suppliers, so some are unknown."""
    known = table(spark, d, "supplier").select(c.s_suppkey.alias("o_custkey"), "s_name")
    joined = table(spark, d, "orders").join(known, "o_custkey", "left")
    return joined.select(
        "o_orderkey",
        F.concat(F.lit("t:"), messages.trace_tail(c.o_orderkey)).alias("trace"),
        messages.publisher_label(c.s_name, c.o_custkey).alias("publisher"),
    )


# text

STATS_SQL = r"""SELECT doc_id, CAST(len(tokens) AS INT) AS word_count, CAST(coalesce(list_sum(list_transform(tokens, lambda w: length(w))), 0) AS INT) AS character_count,
       contains(lower(text), 'python') AS contains_python
FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '') AS tokens FROM documents)"""


def document_stats(spark, d):
    """Documents are dealt out first, since a file of them may be a single split."""
    dealt = table(spark, d, "documents").select("doc_id", "text").repartition(shuffle_width(spark))
    return dealt.select("doc_id", text.text_stats(c.text).alias("s"))


@query("text_stats", STATS_SQL)
def text_stats(spark, d):
    return document_stats(spark, d).select("doc_id", "s.*")


@query(
    "text_report",
    f"""SELECT doc_id, 'Words: ' || word_count || chr(10) || 'Characters: ' || character_count || chr(10) || 'Contains ''Python'': ' ||
               CASE WHEN contains_python THEN 'True' ELSE 'False' END AS report FROM ({STATS_SQL})""",
)
def text_report(spark, d):
    return document_stats(spark, d).select("doc_id", text.text_report(c.s).alias("report"))


@query(
    "safe_ratio",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 10 > 0 THEN l_extendedprice / (l_quantity - 10) ELSE 0 END AS ratio FROM lineitem""",
)
def safe_ratio(spark, d):
    ratio = text.safe_ratio(c.l_extendedprice, c.l_quantity - 10)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"))
