"""Restrictions and siting: set operations on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["q", "r"]


def restricted_cells(heliport_cells: DataFrame) -> DataFrame:
    return heliport_cells.select(*CELL).distinct()


def restriction_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per cell of either set with its change: added, removed or kept.

    Both sets are tagged and grouped once, which shuffles them once, where a difference each way does so twice.
    """
    tagged = before.select(*CELL, F.lit(1).alias("was"), F.lit(0).alias("now")).unionByName(
        after.select(*CELL, F.lit(0).alias("was"), F.lit(1).alias("now"))
    )
    both = tagged.groupBy(*CELL).agg(F.max("was").alias("was"), F.max("now").alias("now"))
    change = F.when(F.col("was") == 0, "added").when(F.col("now") == 0, "removed").otherwise("kept")
    return both.select(*CELL, change.alias("change"))


def apply_restrictions(cells: DataFrame, delta: DataFrame) -> DataFrame:
    """Set or clear `restricted` for the cells named by the delta, and leave the others alone."""
    joined = cells.join(delta.select(*CELL, "change"), CELL, "left")
    state = (
        F.when(F.col("change") == "added", F.lit(True))
        .when(F.col("change") == "removed", F.lit(False))
        .otherwise(F.col("restricted"))
    )
    return joined.withColumn("restricted", state).drop("change")


def traversable(cells: DataFrame) -> DataFrame:
    return cells.where(~F.col("restricted"))


def without_conflicts(vertiport_cells: DataFrame, heliport_cells: DataFrame) -> DataFrame:
    """Vertiports that are on the grid and share no cell with a heliport."""
    return vertiport_cells.join(restricted_cells(heliport_cells), CELL, "left_anti")


def available_cells(cells: DataFrame, heliport_cells: DataFrame) -> DataFrame:
    return traversable(cells).join(restricted_cells(heliport_cells), CELL, "left_anti")


def holding(cells: DataFrame, site_cells: DataFrame) -> DataFrame:
    """Cells that hold at least one site."""
    return cells.join(site_cells.select(*CELL).distinct(), CELL, "left_semi")


def blocked_share(cells: DataFrame, share: float) -> DataFrame:
    """About `share` of the cells, picked by a fixed rule on (q, r) so that every run and engine picks the same."""
    draw = F.pmod(F.col("q") * 7919 + F.col("r") * 104729, F.lit(1000))
    return cells.where(draw < int(share * 1000))
