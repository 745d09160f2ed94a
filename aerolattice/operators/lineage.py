"""Artifact contracts, versions, validity and firing rules over tables.

contracts(module, artifact, role) says what a module consumes, produces or mutates; publishes(run_id, seq, module,
artifact) is the log of writes. Every ordered operator works per (run, artifact) or (run, module) in ranges of
`seq`, so one busy run does not end up in one task.
"""

from __future__ import annotations

import itertools
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolattice.operators.ordered import running
from aerolattice.runtime import pinned, release, shared_folder

#: Share of the runs at which those that still change are written apart from those that are done.
GOES_ON = 0.6


def consumed(contracts: DataFrame) -> DataFrame:
    """What each module consumes, each pair once however often it is stated."""
    return contracts.where("role = 'CONSUMED'").select("module", "artifact").distinct()


def produced(contracts: DataFrame) -> DataFrame:
    return contracts.where("role = 'PRODUCED'").select("module", "artifact").distinct()


def dependency_edges(contracts: DataFrame) -> DataFrame:
    """Producer to consumer, each pair once. Mutation makes no edge."""
    makers = produced(contracts).withColumnRenamed("module", "producer")
    users = consumed(contracts).withColumnRenamed("module", "consumer")
    return makers.join(users, "artifact").select("producer", "consumer").distinct()


def upstream(edges: DataFrame, module: str | None = None) -> DataFrame:
    """(module, upstream) one hop back, for one module or all."""
    hops = edges.select(F.col("consumer").alias("module"), F.col("producer").alias("upstream"))
    return hops if module is None else hops.where(F.col("module") == module)


def downstream(edges: DataFrame, module: str | None = None) -> DataFrame:
    hops = edges.select(F.col("producer").alias("module"), F.col("consumer").alias("downstream"))
    return hops if module is None else hops.where(F.col("module") == module)


def impacted_modules(contracts: DataFrame, changed: DataFrame) -> DataFrame:
    return consumed(contracts).join(changed.select("artifact"), "artifact", "left_semi").select("module").distinct()


def impacted_artifacts(contracts: DataFrame, modules: DataFrame) -> DataFrame:
    return produced(contracts).join(modules.select("module"), "module", "left_semi").select("artifact").distinct()


def duplicate_producers(contracts: DataFrame) -> DataFrame:
    """Artifacts with more than one producer module, with the first and last of them by name."""
    return (
        produced(contracts)
        .distinct()
        .groupBy("artifact")
        .agg(F.count("*").alias("producers"), F.min("module").alias("first_producer"), F.max("module").alias("last_producer"))
        .where("producers > 1")
    )


def unregister(contracts: DataFrame, validity: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracts without the modules `gone`, and the validity of artifacts that keep a producer.

    Only artifacts of a module that goes are forgotten; validity of any other artifact is not touched.
    """
    left = contracts.join(gone.select("module"), "module", "left_anti")
    lost = produced(contracts.join(gone.select("module"), "module", "left_semi")).select("artifact").distinct()
    orphaned = lost.join(produced(left).select("artifact"), "artifact", "left_anti")
    return left, validity.join(orphaned, "artifact", "left_anti")


def invalidation_closure(contracts: DataFrame, changed: DataFrame, validity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(affected modules, artifacts made invalid) when `changed` artifacts are mutated.

    What has fallen is one table that rounds append to.

    From a changed artifact the consumers are affected and what they produce becomes invalid; an artifact that was
    valid, or of unknown validity, passes this on. Artifacts are visited once, so cycles end.
    """
    uses, makes = pinned(consumed(contracts)), pinned(produced(contracts))
    dead = validity.where("not valid").select("artifact")
    spark, path = contracts.sparkSession, f"{shared_folder(contracts.sparkSession)}/{uuid.uuid4().hex}"
    front = start = pinned(changed.select("artifact").distinct())
    front.limit(0).write.parquet(path)
    while not front.isEmpty():
        modules = uses.join(front, "artifact", "left_semi").select("module").distinct()
        hit = makes.join(modules, "module", "left_semi").select("artifact").distinct().join(dead, "artifact", "left_anti")
        passed = front
        front = pinned(hit.join(spark.read.schema(start.schema).parquet(path), "artifact", "left_anti"))
        front.write.mode("append").parquet(path)
        if passed is not start:
            release(passed)
    fallen = spark.read.schema(start.schema).parquet(path)
    affected = uses.join(start.unionByName(fallen), "artifact", "left_semi").select("module").distinct()
    return affected, fallen


def validity_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Artifacts that became valid (unknown before counts as not valid) or invalid (unknown counts as valid)."""
    both = before.select("artifact", F.col("valid").alias("was")).join(
        after.select("artifact", F.col("valid").alias("now")), "artifact", "full"
    )
    change = F.when(F.col("now") & ~F.coalesce("was", F.lit(False)), "became_valid").when(
        ~F.col("now") & F.coalesce("was", F.lit(True)), "became_invalid"
    )
    return both.select("artifact", change.alias("change")).where("change is not null")


def _artifact_levels(links: DataFrame) -> DataFrame:
    """Longest distance of every artifact from a source of the artifact graph; null on a cycle and behind one.

    Artifacts whose upstream all has a level get the next one, so there are as many rounds as levels.
    """
    left = pinned(links.select(F.explode(F.array("up", "down")).alias("artifact")).distinct())
    levels = left.limit(0).withColumn("level", F.lit(None).cast("int"))
    for level in itertools.count():
        waiting = links.join(left.withColumnRenamed("artifact", "up"), "up", "left_semi").select(F.col("down").alias("artifact"))
        free = pinned(left.join(waiting, "artifact", "left_anti"))
        if free.isEmpty():
            return levels.unionByName(left.withColumn("level", F.lit(None).cast("int")))
        levels = levels.unionByName(free.withColumn("level", F.lit(level)))
        left = pinned(left.join(free, "artifact", "left_anti"))


def _cyclic_touches(made: DataFrame, arrived: DataFrame, links: DataFrame, artifacts: int) -> DataFrame:
    """All touches (run_id, seq, artifact) within a cyclic part of `artifacts` artifacts, from those that arrive from outside.

    Between two productions of an artifact only its first touch meets it valid and goes on. Which one that is follows from
    the touches of the round before, so a touch may come and go until the rounds no longer change anything; earlier moments
    settle first. Every touch knows how many hops it has come: a ring of touches that only hold each other up ages past
    the number of artifacts and falls out. Runs know nothing of each other, so one that a round leaves as it was is done; once
    few go on, later rounds read those only.
    """
    place = ["run_id", "artifact"]
    start = pinned(arrived.select(*place, "seq", F.lit(0).alias("hops")))
    supply = pinned(made.select(*place, "seq", F.lit(None).cast("int").alias("hops"), F.lit(1).alias("made"), F.lit(0).alias("turn")))
    touches, done = start, []
    running_on = start.select("run_id").distinct().count()
    while True:
        events = supply.unionByName(touches.withColumns({"made": F.lit(0), "turn": F.lit(1)}))
        lives = running(events, place, "seq", {"life": ("sum", F.col("made"))}, ties=["turn"])
        first = lives.where("turn = 1 and life > 0").groupBy(*place, "life").agg(
            F.min("seq").alias("seq"), F.min_by("hops", "seq").alias("hops")
        )
        onward = first.where(F.col("hops") < artifacts).withColumnRenamed("artifact", "up").join(links, "up")
        reached = start.unionByName(onward.select("run_id", F.col("down").alias("artifact"), "seq", (F.col("hops") + 1).alias("hops")))
        now = pinned(reached.groupBy(*place, "seq").agg(F.min("hops").alias("hops")))
        both = touches.withColumn("side", F.lit(1)).unionByName(now.withColumn("side", F.lit(-1)))
        differing = both.groupBy(*place, "seq", "hops").agg(F.sum("side").alias("side")).where("side <> 0")
        moving = pinned(differing.select(F.col("run_id").alias("_run")).distinct())
        left = moving.count()
        if touches is not start:
            release(touches)
        touches = now
        if not left:
            release(start, supply, moving)
            return reduce(DataFrame.unionByName, [*done, touches]).select("run_id", "seq", "artifact")
        if left <= running_on * GOES_ON:
            same, past = F.col("run_id").eqNullSafe(F.col("_run")), (start, supply)
            done.append(pinned(now.join(moving, same, "left_anti")))
            start, supply, touches = (pinned(x.join(moving, same, "left_semi")) for x in (start, supply, now))
            release(*past, now)
            running_on = left
        release(moving)


def validity_after(contracts: DataFrame, publishes: DataFrame) -> DataFrame:
    """Validity of every produced artifact after each run's log: (run_id, artifact, valid); one not touched is not valid.

    Producing makes an artifact valid. Writing an artifact that the module neither produces nor consumes touches
    what depends on it, and a touch that meets a valid artifact makes it invalid and touches further; of one moment,
    production comes first. Artifacts are settled level by level of their dependency graph: all touches of a level are known
    before it is looked at, and whether a touch meets a valid artifact is seen from the event before it. What lies on a cycle
    of contracts, or behind one, has no level and is settled last, all of it together.
    """
    makes, uses = produced(contracts), consumed(contracts)
    links = pinned(
        uses.withColumnRenamed("artifact", "up").join(makes.withColumnRenamed("artifact", "down"), "module").select("up", "down").distinct()
    )
    levels = pinned(_artifact_levels(links))
    log = publishes.select("run_id", "seq", "module", "artifact")
    made = log.join(makes, ["module", "artifact"], "left_semi")
    mutated = log.join(makes.unionByName(uses), ["module", "artifact"], "left_anti")
    touch = mutated.select("run_id", "seq", F.col("artifact").alias("up")).join(links, "up").select("run_id", "seq", F.col("down").alias("artifact"))
    settled = pinned(made.select("run_id", "artifact", "seq", F.lit(True).alias("valid")))
    pending = pinned(touch.distinct())
    top = levels.agg(F.max("level")).first()[0]
    for level in range(0 if top is None else top + 1):
        here = levels.where(F.col("level") == level).select("artifact")
        arrived = pending.join(here, "artifact", "left_semi")
        if arrived.isEmpty():
            continue
        fallen = arrived.select("run_id", "artifact", "seq", F.lit(False).alias("valid"))
        events = settled.join(here, "artifact", "left_semi").unionByName(fallen).withColumn("turn", (~F.col("valid")).cast("int"))
        seen = running(events, ["run_id", "artifact"], "seq", {"was": ("last", F.col("valid"))}, inclusive=False, ties=["turn"])
        fell = seen.where("not valid and was").select("run_id", "seq", F.col("artifact").alias("up"))
        onward = fell.join(links, "up").select("run_id", "seq", F.col("down").alias("artifact"))
        settled = pinned(settled.unionByName(fallen))
        pending = pinned(pending.join(here, "artifact", "left_anti").unionByName(onward).distinct())
    core = levels.where("level is null").select("artifact")
    arrived = pinned(pending.join(core, "artifact", "left_semi"))
    if not arrived.isEmpty():
        inside = links.join(core.withColumnRenamed("artifact", "up"), "up", "left_semi")
        touched = _cyclic_touches(settled.join(core, "artifact", "left_semi"), arrived, inside, core.count())
        settled = settled.unionByName(touched.select("run_id", "artifact", "seq", F.lit(False).alias("valid")))
    last = settled.groupBy("run_id", "artifact").agg(F.max_by("valid", F.struct("seq", ~F.col("valid"))).alias("last"))
    every = log.select(F.col("run_id").alias("_run")).distinct().join(makes.select(F.col("artifact").alias("_made")).distinct())
    found = every.join(last, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("artifact") == F.col("_made")), "left")
    return found.select(F.col("_run").alias("run_id"), F.col("_made").alias("artifact"), F.coalesce("last", F.lit(False)).alias("valid"))


def artifact_versions(publishes: DataFrame) -> DataFrame:
    """Version 1, 2, .. of an artifact at each of its publishes."""
    return running(publishes, ["run_id", "artifact"], "seq", {"version": ("sum", F.lit(1))})


def latest(publishes: DataFrame) -> DataFrame:
    """Last write per artifact; artifacts never written do not appear."""
    columns = [n for n in publishes.columns if n not in ("run_id", "artifact")]
    best = F.max_by(F.struct(*columns), "seq").alias("last")
    return publishes.groupBy("run_id", "artifact").agg(best).select("run_id", "artifact", "last.*")


def upserted(store: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Last-write-wins store after a batch of publishes; the store only enters as one row per artifact."""
    return latest(batch if store is None else store.unionByName(batch))


def dependency_versions(contracts: DataFrame, publishes: DataFrame) -> DataFrame:
    """Version of every consumed artifact when a module publishes; 0 while there is none.

    An as-of join: publishes of the dependency and the moments it is asked for run through one ordered pass.
    """
    supply = artifact_versions(publishes).select(
        "run_id", "seq", F.col("artifact").alias("dependency"), F.lit(None).cast("string").alias("artifact"), "version"
    )
    demand = publishes.join(consumed(contracts).withColumnRenamed("artifact", "dependency"), "module").select(
        "run_id", "seq", "dependency", "artifact", F.lit(None).cast("bigint").alias("version")
    )
    merged = running(
        supply.withColumn("version", F.col("version").cast("bigint")).unionByName(demand),
        ["run_id", "dependency"],
        "seq",
        {"known": ("last", F.col("version"))},
    )
    return merged.where("artifact is not null").select(
        "run_id", "seq", "artifact", "dependency", F.coalesce("known", F.lit(0)).alias("version")
    )


def require_dependencies(versions: DataFrame) -> DataFrame:
    """Fail on the first dependency that had no version when it was needed."""
    missing = F.raise_error(F.concat(F.lit("missing dependency "), F.col("dependency")))
    return versions.withColumn("version", F.when(F.col("version") > 0, F.col("version")).otherwise(missing))


def stale_artifacts(contracts: DataFrame, publishes: DataFrame) -> DataFrame:
    """Latest artifacts whose recorded dependency version is not the dependency's latest one."""
    noted = dependency_versions(contracts, publishes)
    recorded = noted.groupBy("run_id", "artifact", "dependency").agg(F.max_by("version", "seq").alias("recorded"))
    newest = publishes.groupBy("run_id", F.col("artifact").alias("dependency")).agg(F.count("*").alias("newest"))
    return recorded.join(newest, ["run_id", "dependency"]).where("recorded <> newest")


def dirty_status(contracts: DataFrame, publishes: DataFrame) -> DataFrame:
    """Per run and product, the dependencies that changed after it was last made: (.., product, dependency, dirty)."""
    last = publishes.groupBy("run_id", "artifact").agg(F.max("seq").alias("at"))
    wiring = produced(contracts).withColumnRenamed("artifact", "product").join(
        consumed(contracts).withColumnRenamed("artifact", "dependency"), "module"
    )
    changed = last.select("run_id", F.col("artifact").alias("dependency"), F.col("at").alias("changed_at"))
    made = last.select("run_id", F.col("artifact").alias("product"), F.col("at").alias("made_at"))
    joined = changed.join(wiring, "dependency").join(made, ["run_id", "product"], "left")
    dirty = F.col("made_at").isNull() | (F.col("changed_at") > F.col("made_at"))
    return joined.select("run_id", "module", "product", "dependency", dirty.alias("dirty"))


def dirty_summary(status: DataFrame, contracts: DataFrame) -> DataFrame:
    """Any, all and number of dirty dependencies per product; never-published dependencies are clean."""
    wanted = produced(contracts).withColumnRenamed("artifact", "product").join(consumed(contracts), "module")
    width = wanted.groupBy("module", "product").agg(F.count("*").alias("dependencies"))
    flags = status.groupBy("run_id", "module", "product").agg(F.count_if("dirty").alias("dirty"))
    return flags.join(width, ["module", "product"]).select(
        "run_id",
        "module",
        "product",
        (F.col("dirty") > 0).alias("any_dirty"),
        ((F.col("dirty") == F.col("dependencies")) & (F.col("dependencies") > 0)).alias("all_dirty"),
        "dirty",
    )


def fire_any(contracts: DataFrame, publishes: DataFrame) -> DataFrame:
    """Moments a module runs when any dependency changes: each such publish from the one that completes the set."""
    uses = consumed(contracts)
    needed = uses.groupBy("module").agg(F.count("*").alias("needed"))
    heard = publishes.select("run_id", "seq", "artifact").join(uses, "artifact")
    first = heard.groupBy("run_id", "module", "artifact").agg(F.min("seq").alias("first"))
    ready = (
        first.groupBy("run_id", "module")
        .agg(F.count("*").alias("seen"), F.max("first").alias("ready"))
        .join(needed, "module")
        .where("seen = needed")
    )
    return heard.join(ready, ["run_id", "module"]).where("seq >= ready").select("run_id", "module", "seq")


def fire_all(contracts: DataFrame, publishes: DataFrame) -> DataFrame:
    """Moments a module runs when every dependency has changed since its last run.

    After a run at s the next one is at the largest, over the dependencies, of their first publish after s. That is known
    for every moment from one ordered pass per dependency; the runs are the chain from the start, marked by doubling the
    hops. Work grows with publishes times dependencies. Publishes without `seq` have no moment and fire nothing.
    """
    uses = consumed(contracts)
    place = ["run_id", "module"]
    log = publishes.where("seq is not null").select("run_id", "seq", "artifact").distinct()
    heard = pinned(log.join(uses, "artifact").select(*place, "seq", "artifact"))
    start = heard.groupBy(*place).agg((F.min("seq") - 1).alias("seq"))
    moments = heard.select(*place, "seq").distinct().unionByName(start)
    asked = moments.join(uses, "module").select(*place, "artifact", "seq", F.lit(0).alias("told"))
    told = heard.select(*place, "artifact", "seq", F.lit(1).alias("told"))
    both = asked.unionByName(told).withColumn("back", -F.col("seq").cast("bigint"))
    publish = F.when(F.col("told") == 1, F.col("seq").cast("bigint"))
    seen = running(both, [*place, "artifact"], "back", {"ahead": ("last", publish)}, inclusive=False, ties=["told"])
    known = F.when(F.count("ahead") == F.count("*"), F.max("ahead")).alias("next")
    hops = pinned(seen.where("told = 0").groupBy(*place, "seq").agg(known).where("next is not null"))
    fired = pinned(start.withColumn("fired", F.lit(False)))
    while True:
        at = fired.select(F.col("run_id").alias("_run"), F.col("module").alias("_module"), F.col("seq").alias("_seq"))
        here = (F.col("run_id").eqNullSafe(F.col("_run"))) & (F.col("module") == F.col("_module"))
        onward = hops.join(at, here & (F.col("seq") == F.col("_seq"))).select(*place, F.col("next").alias("seq"), F.lit(True).alias("fired"))
        more = pinned(onward)
        if more.isEmpty():
            break
        fired = pinned(fired.unionByName(more).groupBy(*place, "seq").agg(F.max("fired").alias("fired")))
        after = hops.select(F.col("run_id").alias("_run"), F.col("module").alias("_module"), F.col("seq").alias("_seq"), F.col("next").alias("then"))
        hops = pinned(hops.join(after, here & (F.col("next") == F.col("_seq"))).select(*place, "seq", F.col("then").alias("next")))
    return fired.where("fired").select("run_id", "module", "seq")


def missing_dependencies(needs: DataFrame, publishes: DataFrame) -> DataFrame:
    """Rows of needs(run_id, module, artifact) whose artifact was never published in the run."""
    return needs.join(publishes.select("run_id", "artifact"), ["run_id", "artifact"], "left_anti")


def contract_lint(nodes: DataFrame) -> DataFrame:
    """Broken definition rules: (flow, module, rule).

    nodes(flow, module, kind, returns, artifact, role) has a row per declared artifact, `artifact` being null for a
    node without any; `kind` is INPUT, TRANSFORM or OUTPUT and `returns` tells whether a plain value is returned. Three more
    columns may be there: `optional` (this consumption is declared optional), `outside` (how many inputs of the flow itself
    the node takes) and `wraps` (the plain value holds an artifact). Missing or null they mean no. Nodes are grouped once, in
    partitions of a few megabytes, and written; both kinds of rules read them from there.
    """
    told = {"optional": F.lit(False), "outside": F.lit(0), "wraps": F.lit(False)}
    given = {n: F.coalesce(n, no) if n in nodes.columns else no for n, no in told.items()}
    place = ["flow", "module", "kind", "returns", "artifact"]
    # Hardly any two rows of a file share their place: grouping before the shuffle would only hold whole splits in memory.
    per_artifact = nodes.withColumns(given).repartition(*place).groupBy(*place).agg(
        F.count_if(F.col("role") == "CONSUMED").alias("used"),
        F.count_if(F.col("role") == "PRODUCED").alias("made"),
        F.count_if((F.col("role") == "CONSUMED") & F.col("optional")).alias("spared"),
        F.max("outside").alias("outside"),
        F.max("wraps").alias("wraps"),
    )
    per_node = per_artifact.groupBy("flow", "module", "kind", "returns").agg(
        F.sum("used").alias("used"),
        F.sum("made").alias("made"),
        F.count_if((F.col("used") > 1) | (F.col("made") > 1)).alias("twice"),
        F.count_if((F.col("used") > 0) & (F.col("made") > 0)).alias("both"),
        F.sum("spared").alias("spared"),
        F.max("outside").alias("outside"),
        F.max("wraps").alias("wraps"),
    )
    per_node = pinned(per_node, fine=True)
    kind, used, made = F.col("kind"), F.col("used"), F.col("made")
    rules = {
        "input_consumes": (kind == "INPUT") & (used > 0),
        "input_produces_nothing": (kind == "INPUT") & (made == 0),
        "input_returns_value": (kind == "INPUT") & F.col("returns"),
        "transform_consumes_nothing": (kind == "TRANSFORM") & (used == 0),
        "transform_produces_nothing": (kind == "TRANSFORM") & (made == 0),
        "transform_returns_value": (kind == "TRANSFORM") & F.col("returns"),
        "output_consumes_nothing": (kind == "OUTPUT") & (used == 0),
        "output_produces": (kind == "OUTPUT") & (made > 0),
        "output_returns_nothing": (kind == "OUTPUT") & ~F.col("returns"),
        "artifact_twice": F.col("twice") > 0,
        "consumes_what_it_produces": F.col("both") > 0,
        "optional_dependency": F.col("spared") > 0,
        "output_takes_outside_input": (kind == "OUTPUT") & (F.col("outside") > 0),
        "output_returns_artifact": (kind == "OUTPUT") & F.col("wraps"),
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    node_rows = per_node.select("flow", "module", F.explode(broken).alias("rule"))
    ends = per_node.groupBy("flow").agg(F.count_if(kind == "INPUT").alias("i"), F.count_if(kind == "OUTPUT").alias("o"))
    crowded = F.filter(
        F.array(F.when(F.col("i") > 1, F.lit("many_inputs")), F.when(F.col("o") > 1, F.lit("many_outputs"))), lambda x: x.isNotNull()
    )
    return node_rows.unionByName(ends.select("flow", F.lit(None).cast("string").alias("module"), F.explode(crowded).alias("rule")))
