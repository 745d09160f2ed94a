"""Ordered helpers, lineage, intents and messages against plain replays."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aerolattice import runtime
from aerolattice.catalog import load_all
from aerolattice.functions import text
from aerolattice.operators import intents, lineage, messages, ordered
from aerolattice.operators.ordered import running


def log_rows(seed, n=300, keys=4):
    rnd = random.Random(seed)
    # Key 0 holds most of the rows.
    return [(rnd.choice([0, 0, 0] + list(range(keys))), i, rnd.choice([None, 1, 2, 5])) for i in range(n)]


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_over_narrow_ranges(spark, inclusive):
    rows = log_rows(1)
    df = spark.createDataFrame(rows, "k int, seq bigint, x int")
    values = {"s": ("sum", F.coalesce("x", F.lit(0))), "m": ("max", F.col("x")), "l": ("last", F.col("x"))}
    got = {(r.k, r.seq): (r.s, r.m, r.l) for r in ordered.running(df, ["k"], "seq", values, inclusive=inclusive, width=16).collect()}
    for k, seq, _ in rows:
        before = [x for kk, s, x in rows if kk == k and (s <= seq if inclusive else s < seq) and x is not None]
        assert got[(k, seq)] == (sum(before), max(before, default=None), before[-1] if before else None)


def test_folds_and_scans_over_narrow_ranges(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([0, 0, 1]), i, [rnd.randrange(4) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, seq bigint, change array<int>")
    states, before = {}, {}
    for k, seq, change in rows:
        before[(k, seq)] = states.get(k, 0)
        states[k] = change[states.get(k, 0)]
    folded = {r.k: r.change[0] for r in ordered.folded(df, ["k"], "seq", "change", width=8).collect()}
    assert folded == states
    scanned = {(r.k, r.seq): r.state for r in ordered.scanned(df, ["k"], "seq", "change", width=8).collect()}
    assert scanned == before


CONTRACTS = [
    ("source", "number", "PRODUCED"),
    ("double", "number", "CONSUMED"),
    ("double", "doubled", "PRODUCED"),
    ("left", "number", "CONSUMED"),
    ("left", "leftv", "PRODUCED"),
    ("join", "leftv", "CONSUMED"),
    ("join", "doubled", "CONSUMED"),
    ("join", "combined", "PRODUCED"),
    ("show", "combined", "CONSUMED"),
]


def contracts(spark):
    return spark.createDataFrame(CONTRACTS, "module string, artifact string, role string")


def publishes(spark, rows):
    return spark.createDataFrame(rows, "run_id bigint, seq bigint, module string, artifact string")


def test_barrier_fires_once_per_full_set(spark):
    rows = [(1, i, "x", a) for i, a in enumerate(["leftv", "leftv", "doubled", "doubled", "leftv", "leftv"])]
    fired = lineage.fire_all(contracts(spark), publishes(spark, rows)).where("module = 'join'")
    assert sorted(r.seq for r in fired.collect()) == [2, 4]
    either = lineage.fire_any(contracts(spark), publishes(spark, rows)).where("module = 'join'")
    assert sorted(r.seq for r in either.collect()) == [2, 3, 4, 5]


def test_missing_dependency_is_named(spark):
    log = publishes(spark, [(1, 0, "source", "number"), (1, 1, "join", "combined")])
    versions = lineage.dependency_versions(contracts(spark), log)
    assert {(r.dependency, r.version) for r in versions.where("artifact = 'combined'").collect()} == {("leftv", 0), ("doubled", 0)}
    with pytest.raises(Exception, match="missing dependency"):
        lineage.require_dependencies(versions).collect()


def test_duplicate_producers(spark):
    twice = contracts(spark).unionByName(spark.createDataFrame([("other", "number", "PRODUCED")], "module string, artifact string, role string"))
    row = lineage.duplicate_producers(twice).collect()
    assert [(r.artifact, r.first_producer, r.last_producer) for r in row] == [("number", "other", "source")]


def replay_validity(rows, rules=CONTRACTS):
    made = {m: {a for mm, a, r in rules if mm == m and r == "PRODUCED"} for m, _, _ in rules}
    used = {m: {a for mm, a, r in rules if mm == m and r == "CONSUMED"} for m, _, _ in rules}
    valid = {}
    for run, _, module, artifact in rows:
        state = valid.setdefault(run, {a: False for group in made.values() for a in group})
        if artifact in made.get(module, ()):
            state[artifact] = True
        elif artifact not in used.get(module, ()):
            queue = [artifact]
            while queue:
                changed = queue.pop()
                for m in made:
                    if changed in used[m]:
                        for p in made[m]:
                            if state[p]:
                                state[p] = False
                                queue.append(p)
    return valid


def test_validity_after_random_logs(spark):
    rnd = random.Random(8)
    own = [("source", "number"), ("double", "doubled"), ("left", "leftv"), ("join", "combined")]
    foreign = [("operator", "number"), ("operator", "leftv"), ("show", "doubled")]
    rows = [(rnd.choice([1, 1, 2, 3]), i, *rnd.choice(own + foreign)) for i in range(250)]
    got = lineage.validity_after(contracts(spark), publishes(spark, rows)).collect()
    want = replay_validity(rows)
    assert {(r.run_id, r.artifact): r.valid for r in got} == {(run, a): v for run, state in want.items() for a, v in state.items()}


def test_fire_all_with_many_dependencies(spark):
    rnd = random.Random(5)
    names = [f"a{i}" for i in range(40)]
    uses = [("m", a, "CONSUMED") for a in names] + [("m", "a0", "CONSUMED"), ("few", "a1", "CONSUMED"), ("few", "a2", "CONSUMED")]
    rows = [(rnd.choice([None, 1, 2]), i, "p", rnd.choice(names)) for i in range(3000)]
    rows += [(1, None, "p", "a3")]
    table = spark.createDataFrame(uses, "module string, artifact string, role string")
    log = spark.createDataFrame(rows, "run_id bigint, seq bigint, module string, artifact string")
    want = set()
    for module in ("m", "few"):
        needs = {a for m, a, _ in uses if m == module}
        seen = {}
        for run, seq, _, artifact in rows:
            if seq is not None and artifact in needs:
                fresh = seen.setdefault(run, set())
                fresh.add(artifact)
                if fresh == needs:
                    want.add((run, module, seq))
                    fresh.clear()
    assert {tuple(r) for r in lineage.fire_all(table, log).collect()} == want
    ready = {tuple(r)[:2] for r in lineage.fire_any(table, log).collect()}
    assert {(1, "m"), (2, "m"), (1, "few"), (2, "few")} <= ready  # a contract stated twice is one dependency


def test_running_values_keep_rows_with_null_keys_and_orders(spark):
    rows = [(None, 1), (None, 5), (1, None), (1, 3), (1, 2000000), (1, -7)]
    df = spark.createDataFrame(rows, "k bigint, at bigint")
    found = running(df, ["k"], "at", {"n": ("sum", F.lit(1)), "top": ("max", F.col("at"))}, width=4).collect()
    assert {(r.k, r["at"], r.n, r.top) for r in found} == {
        (None, 1, 1, 1), (None, 5, 2, 5), (1, None, 1, None), (1, -7, 2, -7), (1, 3, 3, 3), (1, 2000000, 4, 2000000),
    }


# Two modules that feed each other, a third ring of three, something in front of the rings and something behind them.
RINGS = [
    ("seed", "s", "PRODUCED"),
    ("front", "s", "CONSUMED"), ("front", "f", "PRODUCED"),
    ("ping", "f", "CONSUMED"), ("ping", "b", "CONSUMED"), ("ping", "a", "PRODUCED"),
    ("pong", "a", "CONSUMED"), ("pong", "b", "PRODUCED"),
    ("one", "b", "CONSUMED"), ("one", "z", "CONSUMED"), ("one", "x", "PRODUCED"),
    ("two", "x", "CONSUMED"), ("two", "y", "PRODUCED"),
    ("three", "y", "CONSUMED"), ("three", "z", "PRODUCED"),
    ("self", "z", "CONSUMED"), ("self", "own", "CONSUMED"), ("self", "own", "PRODUCED"),
    ("last", "z", "CONSUMED"), ("last", "end", "PRODUCED"),
]


@pytest.mark.parametrize("seed, mutations", [(1, 1), (2, 1), (3, 3)])
def test_validity_on_cycles_of_contracts(spark, seed, mutations):
    rnd = random.Random(seed)
    own = [(m, a) for m, a, role in RINGS if role == "PRODUCED"]
    foreign = [("operator", a) for a in "sfabxyz"] + [("last", "s"), ("operator", "own")]
    rows = [(rnd.choice([1, 1, 2, None]), i, *rnd.choice(own * 3 + foreign * mutations)) for i in range(300)]
    table = spark.createDataFrame(RINGS, "module string, artifact string, role string")
    got = lineage.validity_after(table, publishes(spark, rows)).collect()
    want = replay_validity(rows, RINGS)
    assert {(r.run_id, r.artifact): r.valid for r in got} == {(run, a): v for run, state in want.items() for a, v in state.items()}


def test_production_comes_before_touches_of_its_moment(spark):
    rows = [(1, 0, "pong", "b"), (1, 1, "ping", "a"), (1, 1, "ping", "z"), (1, 2, "front", "f"), (1, 2, "front", "a"), (2, 0, "three", "z")]
    table = spark.createDataFrame(RINGS, "module string, artifact string, role string")
    valid = {(r.run_id, r.artifact) for r in lineage.validity_after(table, publishes(spark, rows)).collect() if r.valid}
    assert valid == {(1, "f"), (2, "z")}  # the write to `a` touches `b`, which was valid and touches `a`


def test_rounds_on_a_cycle_leave_out_runs_that_are_done(spark, monkeypatch):
    sizes = []

    def counted(events, *given, **named):
        sizes.append(events.select("run_id").distinct().count())
        return running(events, *given, **named)

    monkeypatch.setattr(lineage, "running", counted)
    rnd = random.Random(5)
    own = [(m, a) for m, a, role in RINGS if role == "PRODUCED"]
    foreign = [("operator", a) for a in "fabxyz"]
    rows = [(99, i, *rnd.choice(own * 3 + foreign)) for i in range(200)]
    for run in [None, *range(9)]:
        rows += [(run, 0, "ping", "a"), (run, 1, "operator", "f")]
    table = spark.createDataFrame(RINGS, "module string, artifact string, role string")
    got = lineage.validity_after(table, publishes(spark, rows)).collect()
    want = replay_validity(rows, RINGS)
    assert {(r.run_id, r.artifact): r.valid for r in got} == {(run, a): v for run, state in want.items() for a, v in state.items()}
    assert max(sizes) == 11 and sizes[-1] == 1


def test_closure_on_a_cycle_and_through_invalid_artifacts(spark):
    ring = [(f"m{i}", f"a{i}", "CONSUMED") for i in range(4)] + [(f"m{i}", f"a{(i + 1) % 4}", "PRODUCED") for i in range(4)]
    table = spark.createDataFrame(ring, "module string, artifact string, role string")
    changed = spark.createDataFrame([("a0",)], "artifact string")
    fine = spark.createDataFrame([("a1", True)], "artifact string, valid boolean")
    modules, fallen = lineage.invalidation_closure(table, changed, fine)
    assert {r.module for r in modules.collect()} == {"m0", "m1", "m2", "m3"} and fallen.count() == 4
    stopped = spark.createDataFrame([("a2", False)], "artifact string, valid boolean")
    modules, fallen = lineage.invalidation_closure(table, changed, stopped)
    assert {r.module for r in modules.collect()} == {"m0", "m1"} and {r.artifact for r in fallen.collect()} == {"a1"}


def test_lint_of_a_sound_and_a_broken_flow(spark):
    rows = [
        ("good", "in", "INPUT", False, "a", "PRODUCED"),
        ("good", "mid", "TRANSFORM", False, "a", "CONSUMED"),
        ("good", "mid", "TRANSFORM", False, "b", "PRODUCED"),
        ("good", "out", "OUTPUT", True, "b", "CONSUMED"),
        ("bad", "in", "INPUT", False, "a", "CONSUMED"),
        ("bad", "in2", "INPUT", False, None, None),
        ("bad", "mid", "TRANSFORM", False, "b", "CONSUMED"),
        ("bad", "mid", "TRANSFORM", False, "b", "PRODUCED"),
        ("bad", "out", "OUTPUT", False, "b", "CONSUMED"),
        ("bad", "out", "OUTPUT", False, "b", "CONSUMED"),
    ]
    nodes = spark.createDataFrame(rows, "flow string, module string, kind string, returns boolean, artifact string, role string")
    assert {(r.flow, r.module, r.rule) for r in lineage.contract_lint(nodes).collect()} == {
        ("bad", "in", "input_consumes"),
        ("bad", "in", "input_produces_nothing"),
        ("bad", "in2", "input_produces_nothing"),
        ("bad", "mid", "consumes_what_it_produces"),
        ("bad", "out", "output_returns_nothing"),
        ("bad", "out", "artifact_twice"),
        ("bad", None, "many_inputs"),
    }


def test_lint_groups_nodes_once_in_small_partitions(spark, monkeypatch):
    monkeypatch.setitem(runtime.FINE, "spark.sql.shuffle.partitions", "64")
    monkeypatch.setitem(runtime.FINE, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    monkeypatch.setitem(runtime.FINE, "spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    before = {name: spark.conf.get(name, None) for name in runtime.FINE}
    made = F.concat(F.lit("m"), F.col("id") % 5000).alias("module")
    nodes = spark.range(20_000).select(
        F.lit("f").alias("flow"), made, F.lit("TRANSFORM").alias("kind"), F.lit(False).alias("returns"),
        F.concat(F.lit("a"), "id").alias("artifact"), F.lit("CONSUMED").alias("role"),
    )
    lint = lineage.contract_lint(nodes)
    assert len(set(lint.inputFiles())) > 16  # written once, by many tasks
    assert {name: spark.conf.get(name, None) for name in runtime.FINE} == before
    assert {tuple(r) for r in lint.groupBy("rule").count().collect()} == {("transform_produces_nothing", 5000)}


def test_lint_of_optional_and_outside_inputs(spark):
    rows = [
        ("f", "in", "INPUT", False, "a", "PRODUCED", True, 2, True),
        ("f", "mid", "TRANSFORM", False, "a", "CONSUMED", True, 1, None),
        ("f", "mid", "TRANSFORM", False, "b", "PRODUCED", None, 1, None),
        ("f", "out", "OUTPUT", True, "a", "CONSUMED", False, 1, True),
        ("f", "out", "OUTPUT", True, "b", "CONSUMED", None, None, None),
    ]
    names = "flow string, module string, kind string, returns boolean, artifact string, role string, optional boolean, outside int, wraps boolean"
    assert {(r.module, r.rule) for r in lineage.contract_lint(spark.createDataFrame(rows, names)).collect()} == {
        ("mid", "optional_dependency"),
        ("out", "output_takes_outside_input"),
        ("out", "output_returns_artifact"),
    }


def replay_intents(rows, start, heliports):
    state = dict(start)
    for _, kind, q, r in sorted(rows):
        if kind == "clear":
            state = {c: s - s % 2 for c, s in state.items()}
            continue
        s = state.get((q, r), 0)
        if kind == "remove":
            s -= s % 2
        elif (q, r) not in heliports:
            if kind == "add" and s == 0:
                s = 1
            elif kind == "toggle" and s % 2 == 0:
                s = 2 - s
            elif kind == "toggle_vertiport":
                s = s - 1 if s % 2 else (1 if s == 0 else s)
        state[(q, r)] = s
    return state


def test_intent_fold_with_clears_and_a_hot_cell(spark):
    rnd = random.Random(4)
    spots = [(0, 0)] * 6 + [(1, 0), (2, 2), (5, 5)]
    rows = [(i, rnd.choice(intents.KINDS), *rnd.choice(spots)) for i in range(1500)]
    start = {(2, 2): 2, (9, 9): 1, (5, 5): 3}
    log = spark.createDataFrame(rows, "seq bigint, kind string, q int, r int")
    begun = spark.createDataFrame([(*c, s) for c, s in start.items()], "q int, r int, state int")
    ports = spark.createDataFrame([(5, 5)], "q int, r int")
    got = {(r.q, r.r): r.vertiport + 2 * r.restricted for r in intents.fold_states(log, begun, ports).collect()}
    assert got == replay_intents(rows, start, {(5, 5)})


def test_drags(spark):
    rows = [
        (1, 1, "right", "release", 0, 0),
        (1, 2, "right", "press", 1, 1),
        (1, 3, "left", "press", 8, 8),
        (1, 4, "right", "press", 2, 2),
        (1, 5, "right", "release", 3, 3),
        (1, 6, "right", "release", 4, 4),
    ]
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, button string, action string, q int, r int")
    assert [tuple(r) for r in intents.drag_pairs(df).collect()] == [(1, 5, 2, 2, 3, 3)]


def test_broadcast_skips_sender_and_excluded(spark):
    sent = spark.createDataFrame(
        [(1, "t", "a", "BROADCAST", ["c"]), (2, "t", "a", "b", []), (3, "t", "a", "z", [])],
        "trace_id bigint, topic string, from_id string, to_id string, exclude_ids array<string>",
    )
    subs = spark.createDataFrame([("t", x) for x in "abcd"], "topic string, subscriber string")
    got = {(r.trace_id, r.subscriber) for r in messages.deliveries(sent, subs).collect()}
    assert got == {(1, "b"), (1, "d"), (2, "b")}


def test_unknown_publisher_label(spark):
    row = spark.createDataFrame([(None, 7), ("Grid", 8)], "name string, id int").select(messages.publisher_label(F.col("name"), F.col("id")).alias("l")).collect()
    assert [r.l for r in row] == ["Publisher#p:7", "Grid#p:8"]


def test_text_stats_from_many_tasks(spark, tmp_path, monkeypatch):
    """Counts equal those by regular expressions, whatever the slices, and documents of a single split are dealt out."""
    blanks = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    draw = random.Random(7)
    letters = list("ab\u00e9\u4e2d\U0001f600\u200b\u180e\ufeff\u2030\u3001\u00c2") + list(text.BLANKS)
    rows = [(i, "".join(draw.choice(letters) for _ in range(draw.randrange(12)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "PyTHON\u00a0is"), (402, "PyTHON\u00a0is"), (None, "\u3000"), (403, "x" * 5000 + " y"), (404, "a\u00a0")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = documents.select(
        "doc_id",
        F.regexp_count("text", F.lit("[^" + blanks[1:])).alias("word_count"),
        F.length(F.regexp_replace("text", blanks, "")).alias("character_count"),
        F.contains(F.lower("text"), F.lit("python")).alias("contains_python"),
    )
    found = load_all()[0]["text_stats"](spark, str(tmp_path))
    assert found.schema.simpleString() == want.schema.simpleString() and found.count() == len(rows)
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.index("ArrowEvalPython") < plan.index("Repartition")
    texts = [t for _, t in rows]
    whole = text._counted(pa.array(texts)).to_pylist()
    monkeypatch.setattr(text, "SLICE", 16)
    assert text._counted(pa.array([None, *texts]).slice(1)).to_pylist() == whole and len(text._counted(pa.array([], pa.string()))) == 0
