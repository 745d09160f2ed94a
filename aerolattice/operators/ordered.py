"""Running values and ordered folds that do not put a whole key into one task.

A key may hold a third of all rows. Its rows are therefore cut into ranges of the order column: values run inside
a range, one summary row per range carries the rest over, and only those summaries are ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_WIDTH = 1 << 20
FOLD_WIDTH = 1 << 10
SCAN_WIDTH = 1 << 8


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    ties: Sequence[str] = (),
    width: int = RANGE_WIDTH,
) -> DataFrame:
    """Add running values per key in `order` (an integer column).

    Every row comes back once. Null keys are a key like any other, and rows without an order come first in their key.

    `values` maps a new column to (kind, expression), kind being `sum`, `max`, `min` or `last`; `last` is the latest
    value that is not null. Exclusive running values leave the current row out.
    """
    keys = list(keys)
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    for name, (_, expr) in values.items():
        ranged = ranged.withColumn(f"_in_{name}", expr)
    place = keys + ["_range"]
    frame = Window.partitionBy(*place).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    over_ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    totals, carried, merged = [], [], []
    for name, (kind, _) in values.items():
        source = F.col(f"_in_{name}")
        latest = F.struct(order, *ties, source.alias("_value"))
        known = F.when(source.isNotNull(), latest)
        totals.append((F.max(known)["_value"] if kind == "last" else _plain(kind, source)).alias(f"_all_{name}"))
        carried.append(_frame_value(kind, F.col(f"_all_{name}")).over(over_ranges).alias(f"_carry_{name}"))
    summary = ranged.groupBy(*place).agg(*totals).select(*place, *carried)
    local = ranged.select(
        *df.columns,
        "_range",
        *[_frame_value(kind, F.col(f"_in_{name}")).over(frame).alias(f"_here_{name}") for name, (kind, _) in values.items()],
    )
    for name, (kind, _) in values.items():
        here, carry = F.col(f"_here_{name}"), F.col(f"_carry_{name}")
        if kind == "sum":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif kind == "last":
            value = F.coalesce(here, carry)
        else:
            value = (F.greatest if kind == "max" else F.least)(here, carry)
        merged.append(value.alias(name))
    return _joined(local, summary, place, "inner").select(*df.columns, *merged)


def _joined(rows: DataFrame, facts: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which any may be null; null meets null."""
    named = facts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[n for n in facts.columns if n not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return rows.join(named, same, how)


def _plain(kind: str, source: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](source)


def _frame_value(kind: str, source: Column) -> Column:
    return F.last(source, ignorenulls=True) if kind == "last" else _plain(kind, source)


def compose(first: Column, then: Column) -> Column:
    """Composition of two state maps held as arrays: state s goes to then[first[s]]."""
    return F.transform(first, lambda s: F.element_at(then, s + 1))


def _chained(run: Column) -> Column:
    """Composition of the maps of a sorted run."""
    states = F.size(run[0]["change"])
    return F.aggregate(run, F.sequence(F.lit(0), states - 1), lambda acc, e: compose(acc, e["change"]))


def _parts(events: DataFrame, keys: list[str], width: int) -> DataFrame:
    return (
        events.withColumn("_part", F.floor(F.col("_at") / width))
        .groupBy(*keys, "_part")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "change"))).alias("_run"))
    )


def _maps(events: DataFrame, keys: list[str], order: str, change: str) -> tuple[DataFrame, int, int]:
    """The maps with places counted from 1 (0: no order), the largest place, and what was taken off the order."""
    low, high = events.agg(F.min(order), F.max(order)).first()
    low, high = (0, 0) if low is None else (int(low), int(high))
    at = F.coalesce(F.col(order).cast("bigint") - low + 1, F.lit(0).cast("bigint"))
    return events.select(*keys, at.alias("_at"), F.col(change).alias("change")), high - low + 1, low - 1


def folded(events: DataFrame, keys: Sequence[str], order: str, change: str, width: int = FOLD_WIDTH) -> DataFrame:
    """Compose the state maps `change` of every key in `order`; columns keys and `change`.

    A map is an array that holds the next state of each state. Composition is associative, so ranges of the order
    column are folded first and their results again, until one map per key is left. No group ever holds more than
    `width` rows, provided `order` is unique per key. Rows without an order come first in their key.
    """
    keys = list(keys)
    level, top, _ = _maps(events, keys, order, change)
    while True:
        level = _parts(level, keys, width).select(*keys, F.col("_part").alias("_at"), _chained(F.col("_run")).alias("change"))
        top = top // width
        if top == 0:
            return level.select(*keys, "change")


def scanned(events: DataFrame, keys: Sequence[str], order: str, change: str, width: int = SCAN_WIDTH) -> DataFrame:
    """Add `state`, the state before each event when every key starts in state 0.

    Ranges of the order column are composed, their start states come from scanning the composed ranges the same way,
    and each range is then walked from its start state. `order` has to be unique per key, null included, which comes
    first.
    """
    keys = list(keys)
    maps, top, base = _maps(events, keys, order, change)
    walked = _scan(maps, keys, top, width)
    placed = walked.withColumn(order, F.when(F.col("_at") > 0, F.col("_at") + base)).drop("_at")
    return _joined(events, placed, keys + [order], "inner").select(*events.columns, "state")


def _scan(maps: DataFrame, keys: list[str], top: int, width: int) -> DataFrame:
    parts = _parts(maps, keys, width)
    if top // width == 0:
        started = parts.withColumn("_start", F.lit(0))
    else:
        summary = parts.select(*keys, F.col("_part").alias("_at"), _chained(F.col("_run")).alias("change"))
        starts = _scan(summary, keys, top // width, width)
        starts = starts.select(*keys, F.col("_at").alias("_part"), F.col("state").alias("_start"))
        started = _joined(parts, starts, keys + ["_part"], "inner").select(*parts.columns, "_start")
    begun = F.struct(F.col("_start").alias("state"), F.array().cast("array<struct<_at:bigint,state:int>>").alias("seen"))

    def step(acc: Column, e: Column) -> Column:
        here = F.struct(e["_at"].alias("_at"), acc["state"].alias("state"))
        return F.struct(
            F.element_at(e["change"], acc["state"] + 1).alias("state"), F.concat(acc["seen"], F.array(here)).alias("seen")
        )

    seen = F.aggregate("_run", begun, step, lambda acc: acc["seen"])
    return started.select(*keys, F.inline(seen))
