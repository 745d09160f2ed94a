"""User intents on cells: adding and removing vertiports and switching restrictions.

The state of a cell is one number, vertiport + 2 * restricted, and an intent is a map of the four states. Maps
compose, so a cell's log is folded in ranges (see `ordered.folded`) and one cell with most of the events is no
problem. Cells of heliports take no intent but a removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolattice.operators.ordered import folded, running

KINDS = ["add", "remove", "toggle", "toggle_vertiport", "clear"]

# Next state of the states free, vertiport, restricted, both, per kind of intent.
MAPS = {
    "add": [1, 1, 2, 3],
    "remove": [0, 0, 2, 2],
    "toggle": [2, 1, 0, 3],
    "toggle_vertiport": [1, 0, 2, 2],
    "clear": [0, 0, 2, 2],
}
HELIPORT_MAPS = {"remove": [0, 0, 2, 2], "clear": [0, 0, 2, 2]}
SAME = [0, 1, 2, 3]


def routed(intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intents of a known kind, and the others as a dead-letter table."""
    known = F.col("kind").isin(KINDS)
    return intents.where(known), intents.where(~known | F.col("kind").isNull())


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def state_map(kind: Column, on_heliport: Column) -> Column:
    chosen = _ints(SAME)
    for name, values in MAPS.items():
        there = _ints(HELIPORT_MAPS.get(name, SAME))
        chosen = F.when(kind == name, F.when(on_heliport, there).otherwise(_ints(values))).otherwise(chosen)
    return chosen


def start_states(vertiport_cells: DataFrame, restricted: DataFrame) -> DataFrame:
    """Start state (q, r, state) of every cell that holds a vertiport or is restricted."""
    marks = vertiport_cells.select("q", "r", F.lit(1).alias("v"), F.lit(0).alias("x")).unionByName(
        restricted.select("q", "r", F.lit(0).alias("v"), F.lit(1).alias("x"))
    )
    return marks.groupBy("q", "r").agg((F.max("v") + 2 * F.max("x")).alias("state"))


def fold_states(intents: DataFrame, start: DataFrame, heliport_cells: DataFrame) -> DataFrame:
    """State of every cell after all intents: (q, r, vertiport, restricted).

    intents(seq, kind, q, r); a `clear` has no cell and applies to every cell that can hold a vertiport by then.
    """
    heliports = heliport_cells.select("q", "r").distinct().withColumn("on_heliport", F.lit(True))
    at_cells = intents.where("kind <> 'clear'").select("seq", "kind", "q", "r")
    touched = start.select("q", "r").unionByName(at_cells.select("q", "r")).distinct()
    clears = intents.where("kind = 'clear'").select("seq")
    steps = at_cells.unionByName(_clears_per_cell(at_cells, touched, clears))
    change = state_map(F.col("kind"), F.coalesce("on_heliport", F.lit(False)))
    maps = folded(
        steps.join(heliports, ["q", "r"], "left").select("q", "r", "seq", change.alias("change")), ["q", "r"], "seq", "change"
    )
    joined = touched.join(maps, ["q", "r"], "left").join(start, ["q", "r"], "left")
    begun = F.coalesce("state", F.lit(0))
    ended = F.coalesce(F.element_at("change", begun + 1), begun)
    return joined.select("q", "r", (ended % 2 == 1).alias("vertiport"), (ended >= 2).alias("restricted"))


def _clears_per_cell(at_cells: DataFrame, touched: DataFrame, clears: DataFrame) -> DataFrame:
    """The clears each cell has to replay: those with an event of the cell since the clear before, and the last one.

    Between two events of a cell any number of clears does what one does. Events and clears are numbered by epoch, a
    running count of clears, so a cell's events name the epochs that end in a clear worth replaying.
    """
    marks = at_cells.select("seq", F.lit(0).alias("n"), "q", "r").unionByName(
        clears.select("seq", F.lit(1).alias("n"), F.lit(None).cast("int").alias("q"), F.lit(None).cast("int").alias("r"))
    )
    counted = running(marks, [], "seq", {"epoch": ("sum", F.col("n"))})
    ends = counted.where("n = 1").select(F.col("epoch").alias("ending"), "seq")
    lived = counted.where("n = 0").select("q", "r", (F.col("epoch") + 1).alias("ending")).distinct()
    first = touched.withColumn("ending", F.lit(1).cast("bigint"))
    wanted = lived.unionByName(first).distinct()
    return wanted.join(ends, "ending").select("seq", F.lit("clear").alias("kind"), "q", "r")


def drag_pairs(events: DataFrame) -> DataFrame:
    """Terminal moves of events(session_id, seq, button, action, q, r): (session_id, seq, from_q, from_r, to_q, to_r).

    A right press opens a drag, a later press replaces it, and the next right release closes it.
    """
    right = events.where("button = 'right'").withColumn("cell", F.struct("q", "r"))
    before = running(right, ["session_id"], "seq", {"was": ("last", F.struct("action", "cell"))}, inclusive=False)
    closing = before.where("action = 'release' and was.action = 'press'")
    return closing.select(
        "session_id",
        "seq",
        F.col("was.cell.q").alias("from_q"),
        F.col("was.cell.r").alias("from_r"),
        F.col("q").alias("to_q"),
        F.col("r").alias("to_r"),
    )
