"""Intent state as a stream, keyed by cell.

Intents wait in the cell's state until the watermark has passed them and are then applied in `seq` order, so the
stream ends in the same states as the batch fold. Intents older than the watermark are counted and left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from aerolattice.operators.intents import HELIPORT_MAPS, MAPS, SAME

STATE = StructType([StructField("state", IntegerType())])
LATE = StructType([StructField("late", LongType())])
WAITING = StructType([StructField("seq", LongType()), StructField("at_ms", LongType()), StructField("kind", StringType())])
CHANGES = StructType(
    [
        StructField("q", IntegerType()),
        StructField("r", IntegerType()),
        StructField("seq", LongType()),
        StructField("kind", StringType()),
        StructField("vertiport", IntegerType()),
        StructField("restricted", IntegerType()),
        StructField("late", LongType()),
    ]
)
INTENT = StructType(
    [
        StructField("seq", LongType()),
        StructField("ts", TimestampType()),
        StructField("kind", StringType()),
        StructField("q", IntegerType()),
        StructField("r", IntegerType()),
        StructField("on_heliport", IntegerType()),
        StructField("start", IntegerType()),
    ]
)


class CellAutomaton(StatefulProcessor):
    """State of one cell and the intents that wait for the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.late = handle.getValueState("late", LATE)
        self.heliport = handle.getValueState("heliport", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        fresh, late = [], 0
        for frame in rows:
            for row in frame.itertuples(index=False):
                if not self.state.exists():
                    self.state.update((int(row.start),))
                    self.heliport.update((int(row.on_heliport),))
                at_ms = int(pd.Timestamp(row.ts).timestamp() * 1000)
                if at_ms < watermark:
                    late += 1
                    continue
                fresh.append((int(row.seq), at_ms, str(row.kind)))
        if late:
            self.late.update(((self.late.get()[0] if self.late.exists() else 0) + late,))
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(max(at for _, at, _ in fresh))
        yield pd.DataFrame(columns=CHANGES.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(row) for row in self.waiting.get())
        due = [row for row in waiting if row[1] <= watermark]
        rest = [row for row in waiting if row[1] > watermark]
        self.waiting.put(rest) if rest else self.waiting.clear()
        state = self.state.get()[0]
        on_heliport = self.heliport.get()[0] == 1
        late = self.late.get()[0] if self.late.exists() else 0
        out = []
        for seq, _, kind in due:
            table = HELIPORT_MAPS if on_heliport else MAPS
            state = table.get(kind, SAME)[state]
            out.append((key[0], key[1], seq, kind, state % 2, state // 2, late))
        self.state.update((state,))
        yield pd.DataFrame(out, columns=CHANGES.names)

    def close(self) -> None:
        pass


def intent_changes(intents: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """State after each intent of a stream of INTENT rows, in `seq` order per cell."""
    return (
        intents.withWatermark("ts", delay)
        .groupBy("q", "r")
        .transformWithStateInPandas(CellAutomaton(), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
    )
