"""Streaming forms of the firing barrier, lifecycle changes, reply matching and the artifact store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from aerolattice.operators.lineage import consumed, upserted

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

NAME = StructType([StructField("artifact", StringType())])
FLAG = StructType([StructField("changed", BooleanType())])
MOMENT = StructType([StructField("seq", LongType())])
HEARD = StructType(
    [
        StructField("seq", LongType()),
        StructField("artifact", StringType()),
        StructField("needed", LongType()),
        StructField("at_ms", LongType()),
    ]
)
FIRED = StructType(
    [StructField("run_id", LongType()), StructField("module", StringType()), StructField("seq", LongType())]
)
LAST = StructType([StructField("state", StringType())])
CHANGED = StructType(
    [StructField("component", LongType()), StructField("seq", LongType()), StructField("state", StringType())]
)


def use_state_store(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Barrier(StatefulProcessor):
    """Dependencies of one run's module that changed since it last ran."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.changed = handle.getMapState("changed", NAME, FLAG)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = sorted((int(r.seq), r.artifact, int(r.needed)) for frame in rows for r in frame.itertuples(index=False))
        waiting = {name[0] for name in self.changed.keys()} if self.changed.exists() else set()
        fired = []
        for seq, artifact, needed in batch:
            waiting.add(artifact)
            if len(waiting) == needed:
                fired.append((key[0], key[1], seq))
                waiting = set()
        self.changed.clear()
        for artifact in waiting:
            self.changed.updateValue((artifact,), (True,))
        yield pd.DataFrame(fired, columns=FIRED.names)

    def close(self) -> None:
        pass


class PatientBarrier(StatefulProcessor):
    """The barrier over publishes in any order: they wait until the watermark has passed them and count in `seq` order.

    A publish that is no later than the last firing tells nothing new, so repeated rows count once. One that comes after the
    watermark has passed it counts if it is later than the last firing, and leaves what was given out as it is.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changed = handle.getMapState("changed", NAME, FLAG)
        self.last = handle.getValueState("last", MOMENT)
        self.waiting = handle.getListState("waiting", HEARD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [
            (int(r.seq), r.artifact, int(r.needed), int(pd.Timestamp(r.ts).timestamp() * 1000))
            for frame in rows
            for r in frame.itertuples(index=False)
        ]
        self.waiting.appendList(fresh)
        for at_ms in {row[3] for row in fresh}:
            self.handle.registerTimer(at_ms)
        yield pd.DataFrame(columns=FIRED.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        due = sorted({row[:3] for row in waiting if row[3] <= watermark})
        if not due:  # an earlier timer of this batch has taken them
            yield pd.DataFrame(columns=FIRED.names)
            return
        rest = [row for row in waiting if row[3] > watermark]
        self.waiting.put(rest) if rest else self.waiting.clear()
        changed = {name[0] for name in self.changed.keys()} if self.changed.exists() else set()
        last = self.last.get()[0] if self.last.exists() else None
        fired = []
        for seq, artifact, needed in due:
            if last is not None and seq <= last:
                continue
            changed.add(artifact)
            if len(changed) == needed:
                fired.append((key[0], key[1], seq))
                last, changed = seq, set()
        self.changed.clear()
        for artifact in changed:
            self.changed.updateValue((artifact,), (True,))
        if fired:
            self.last.update((last,))
        yield pd.DataFrame(fired, columns=FIRED.names)

    def close(self) -> None:
        pass


def fire_all_stream(contracts: DataFrame, publishes: DataFrame, delay: str | None = None) -> DataFrame:
    """Moments a module has heard of every dependency again.

    Without `delay`, events of a key must arrive in `seq` order across batches. With it, `publishes` has an event time `ts`
    that grows with `seq` within a run, and events may arrive that much out of order; see `PatientBarrier`. Publishes
    without `seq`, or then without `ts`, have no moment and fire nothing.
    """
    uses = consumed(contracts)
    needed = uses.groupBy("module").agg(F.count("*").cast("int").alias("needed"))
    wanted = uses.join(needed, "module")
    if delay is None:
        heard = publishes.where("seq is not null").select("run_id", "seq", "artifact").join(wanted, "artifact")
        return heard.groupBy("run_id", "module").transformWithStateInPandas(
            Barrier(), outputStructType=FIRED, outputMode="Append", timeMode="None"
        )
    timely = publishes.where("seq is not null and ts is not null").withWatermark("ts", delay)
    heard = timely.select("run_id", "seq", "artifact", "ts").join(wanted, "artifact")
    return heard.groupBy("run_id", "module").transformWithStateInPandas(
        PatientBarrier(), outputStructType=FIRED, outputMode="Append", timeMode="EventTime"
    )


class LastState(StatefulProcessor):
    """Last state of one component."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = sorted((int(r.seq), r.state) for frame in rows for r in frame.itertuples(index=False))
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for seq, state in batch:
            if state != before:
                out.append((key[0], seq, state))
            before = state
        self.last.update((before,))
        yield pd.DataFrame(out, columns=CHANGED.names)

    def close(self) -> None:
        pass


def lifecycle_stream(states: DataFrame) -> DataFrame:
    return states.groupBy("component").transformWithStateInPandas(
        LastState(), outputStructType=CHANGED, outputMode="Append", timeMode="None"
    )


def reply_stream(requests: DataFrame, replies: DataFrame, wait: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Requests with their replies; a request is given up, with a null reply, once `wait` and the watermark have passed.

    requests(trace_id, ts, from_id), replies(reply_id, reply_to, reply_ts, answered_by).
    """
    asked = requests.withWatermark("ts", delay)
    answered = replies.withWatermark("reply_ts", delay)
    timely = F.expr(f"reply_to = trace_id AND reply_ts >= ts AND reply_ts <= ts + interval {wait}")
    return asked.join(answered, timely, "left_outer")


def upsert_stream(publishes: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Keep a last-write-wins table of artifacts under `store`: each batch writes the next version of the table.

    Versions are named by batch, so a batch that is run again writes the same one again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{store}/v={number - 1}") if number > 0 else None
        upserted(before, batch).write.mode("overwrite").parquet(f"{store}/v={number}")

    return publishes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
