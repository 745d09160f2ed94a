"""The artifact store over batches, repeated batches, broken folds and new checkpoints."""

import random

from aerolattice.streaming import store

SCHEMA = "run_id bigint, seq bigint, artifact string, payload double"


def feed(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def last_writes(rows):
    best = {}
    for run, seq, artifact, payload in rows:
        if (run, artifact) not in best or best[(run, artifact)][0] < seq:
            best[(run, artifact)] = (seq, payload)
    return best


def kept(spark, folder):
    rows = store.stored(spark, folder, SCHEMA).collect()
    found = {(r.run_id, r.artifact): (r.seq, r.payload) for r in rows}
    assert len(found) == len(rows)
    return found


def test_stream_restart_and_new_checkpoint(spark, tmp_path):
    rnd = random.Random(4)
    seqs = rnd.sample(range(1000), 160)  # writes arrive out of order
    rows = [(rnd.choice([1, 1, 1, 2, None]), seq, rnd.choice("abcdefgh"), float(seq)) for seq in seqs]
    source, folder = str(tmp_path / "in"), str(tmp_path / "store")

    def catch_up(checkpoint):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        store.store_stream(stream, folder, str(tmp_path / checkpoint), 3).awaitTermination(120)

    feed(spark, rows[:50], source)
    feed(spark, rows[50:100], source)
    catch_up("ck")
    assert kept(spark, folder) == last_writes(rows[:100])
    feed(spark, rows[100:], source)
    catch_up("ck")
    assert kept(spark, folder) == last_writes(rows)
    catch_up("new")  # all over again from the first file
    assert kept(spark, folder) == last_writes(rows)
    assert store.stored(spark, str(tmp_path / "none"), SCHEMA).isEmpty()


def test_broken_folds_and_small_batches(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    rows = [(i % 200, i, "xyz"[i % 3], float(i)) for i in range(3000)]
    store.take_in(spark.createDataFrame(rows, SCHEMA), folder, 2)
    base = {name for b in range(2) for name, _ in store._files(spark, f"{folder}/base/bucket={b}")}
    assert base and not any(store._files(spark, f"{folder}/delta/bucket={b}") for b in range(2))
    small = [(7, 5000, "x", 1.0), (7, 1, "y", 2.0)]
    store.take_in(spark.createDataFrame(small, SCHEMA), folder, 2)
    assert base == {name for b in range(2) for name, _ in store._files(spark, f"{folder}/base/bucket={b}")}  # not rewritten
    assert kept(spark, folder) == last_writes(rows + small)
    with monkeypatch.context() as broken:  # the fold ends between writing the new base and deleting the old files
        broken.setattr(store, "_delete", lambda *_: None)
        more = [(i % 200, 6000 + i, "w", float(i)) for i in range(3000)]
        store.take_in(spark.createDataFrame(more, SCHEMA), folder, 2)
    assert kept(spark, folder) == last_writes(rows + small + more)
    store.take_in(spark.createDataFrame(more, SCHEMA), folder, 2)
    assert kept(spark, folder) == last_writes(rows + small + more)
