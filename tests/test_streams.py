"""Streams end in what the batch forms give."""

import datetime as dt
import random

from pyspark.sql import functions as F

from aerolattice.operators import intents, lineage, messages
from aerolattice.streaming.intents import INTENT, intent_changes
from aerolattice.streaming.runs import fire_all_stream, lifecycle_stream, reply_stream, upsert_stream, use_state_store

START = dt.datetime(2024, 1, 1)


def feed(spark, rows, schema, folder, parts=3):
    """Write rows as `parts` files and read them one file per batch."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = rows[i * size : (i + 1) * size]
        if chunk:
            spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, name, tmp_path):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    return df.sparkSession.table(name)


def test_intent_stream_equals_fold(spark, tmp_path):
    use_state_store(spark)
    rnd = random.Random(3)
    kinds = ["add", "remove", "toggle", "toggle_vertiport"]
    log = [(i, START + dt.timedelta(seconds=i), rnd.choice(kinds), rnd.choice([0, 0, 1]), rnd.choice([0, 2])) for i in range(120)]
    ports = {(1, 2)}
    rows = [(*r, int(r[3:] in ports), 0) for r in log]
    for i in range(0, 120, 10):  # arrival order within ten seconds is not seq order
        part = rows[i : i + 10]
        rnd.shuffle(part)
        rows[i : i + 10] = part
    rows.append((10_000, START + dt.timedelta(days=1), "other", 9, 9, 0, 0))  # moves the watermark past the rest
    rows.append((10_001, START + dt.timedelta(days=2), "other", 9, 9, 0, 0))
    changes = run(intent_changes(feed(spark, rows, INTENT, str(tmp_path / "in"), 4), "1 minute"), "intent_out", tmp_path)
    last = changes.where("q <> 9").groupBy("q", "r").agg(F.max_by(F.struct("vertiport", "restricted"), "seq").alias("s"), F.max("late").alias("late"), F.count("*").alias("n"))
    got = {(r.q, r.r): (bool(r.s.vertiport), bool(r.s.restricted)) for r in last.collect()}
    assert changes.where("q <> 9").count() == 120 and changes.agg(F.max("late")).first()[0] == 0
    batch = spark.createDataFrame([(s, k, q, r) for s, _, k, q, r in log], "seq bigint, kind string, q int, r int")
    none = spark.createDataFrame([], "q int, r int, state int")
    heli = spark.createDataFrame([(1, 2)], "q int, r int")
    want = {(r.q, r.r): (r.vertiport, r.restricted) for r in intents.fold_states(batch, none, heli).collect()}
    assert got == want


def test_barrier_stream_equals_batch(spark, tmp_path):
    use_state_store(spark)
    contracts = spark.createDataFrame([("m", "a", "CONSUMED"), ("m", "b", "CONSUMED"), ("n", "a", "CONSUMED")], "module string, artifact string, role string")
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 2]), i, "x", rnd.choice("abb")) for i in range(60)]
    schema = "run_id bigint, seq bigint, module string, artifact string"
    out = run(fire_all_stream(contracts, feed(spark, rows, schema, str(tmp_path / "in"))), "barrier_out", tmp_path)
    want = lineage.fire_all(contracts, spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_barrier_stream_with_a_repeated_contract_row(spark, tmp_path):
    use_state_store(spark)
    rules = [("m", "a", "CONSUMED"), ("m", "b", "CONSUMED"), ("m", "a", "CONSUMED")]
    contracts = spark.createDataFrame(rules, "module string, artifact string, role string")
    rows = [(1, i, "x", "ab"[i % 3 == 2]) for i in range(30)]
    schema = "run_id bigint, seq bigint, module string, artifact string"
    out = run(fire_all_stream(contracts, feed(spark, rows, schema, str(tmp_path / "in"))), "repeated_out", tmp_path)
    want = lineage.fire_all(contracts, spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() == 10


def test_barrier_stream_under_disorder(spark, tmp_path):
    use_state_store(spark)
    rules = [("m", "a", "CONSUMED"), ("m", "b", "CONSUMED"), ("m", "a", "CONSUMED"), ("n", "a", "CONSUMED")]
    contracts = spark.createDataFrame(rules, "module string, artifact string, role string")
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 2]), i, START + dt.timedelta(seconds=i), rnd.choice("abb")) for i in range(60)]
    rows += rnd.sample(rows, 10)
    rows += [(1, None, START, "a"), (1, 7, None, "b"), (1, 61, START, "unheard")]
    rnd.shuffle(rows)
    rows += [(99, 100 + i, START + dt.timedelta(days=1 + i), "b") for i in range(40)]  # move the watermark past the rest
    schema = "run_id bigint, seq bigint, ts timestamp, artifact string"
    stream = fire_all_stream(contracts, feed(spark, rows, schema, str(tmp_path / "in"), 5), "2 minutes")
    out = run(stream, "disorder_out", tmp_path)
    timed = spark.createDataFrame([r for r in rows if r[2] and r[0] < 99], schema)
    want = lineage.fire_all(contracts, timed.select("run_id", "seq", F.lit("x").alias("module"), "artifact"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    use_state_store(spark)
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 2]), i, rnd.choice("xy")) for i in range(60)]
    schema = "component bigint, seq bigint, state string"
    out = run(lifecycle_stream(feed(spark, rows, schema, str(tmp_path / "in"))), "life_out", tmp_path)
    want = messages.lifecycle_changes(spark.createDataFrame(rows, schema)).select("component", "seq", "state")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_reply_stream(spark, tmp_path):
    minute = dt.timedelta(minutes=1)
    asked = [(i, START + i * minute, "u") for i in range(6)] + [(90, START + 600 * minute, "u"), (91, START + 1200 * minute, "u")]
    answers = [(100 + i, i, START + (i + 2) * minute, "v") for i in (0, 2, 3)] + [
        (190, 90, START + 601 * minute, "v"), (191, 91, START + 1201 * minute, "v"),
    ]
    requests = feed(spark, asked, "trace_id bigint, ts timestamp, from_id string", str(tmp_path / "q"), 4)
    replies = feed(spark, answers, "reply_id bigint, reply_to bigint, reply_ts timestamp, answered_by string", str(tmp_path / "r"), 4)
    out = run(reply_stream(requests, replies), "reply_out", tmp_path).where("trace_id < 90")
    assert {(r.trace_id, r.reply_id) for r in out.collect()} == {(0, 100), (1, None), (2, 102), (3, 103), (4, None), (5, None)}


def test_upsert_stream_keeps_last_writes(spark, tmp_path):
    rows = [(1, "abc"[i % 3], i, float(i)) for i in range(20)]
    schema = "run_id bigint, artifact string, seq bigint, payload double"
    stream = feed(spark, rows, schema, str(tmp_path / "in"), 3)
    upsert_stream(stream, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "store" / "v=2"))
    assert {(r.artifact, r.seq, r.payload) for r in last.collect()} == {("a", 18, 18.0), ("b", 19, 19.0), ("c", 17, 17.0)}
