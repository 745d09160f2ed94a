"""Hexagonal grid over the operational bounds."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolattice.functions import hexmath as hx
from aerolattice.operators.frame import within
from aerolattice.runtime import shuffle_width


def require_pointy(orientation: str) -> None:
    if orientation != "POINTY":
        raise NotImplementedError("only pointy-top hexagons are supported")


def axial_bounds(spark: SparkSession, domain: SimpleNamespace, size: float) -> DataFrame:
    """Integer axial box around the four corners of the operational bounds."""
    edges = [(F.lit(x), F.lit(y)) for x in (domain.op_min_x, domain.op_max_x) for y in (domain.op_min_y, domain.op_max_y)]
    q = [hx.fractional(x, y, size)[0] for x, y in edges]
    r = [hx.fractional(x, y, size)[1] for x, y in edges]
    return spark.range(1).select(
        F.floor(F.least(*q)).cast("int").alias("min_q"),
        F.ceil(F.greatest(*q)).cast("int").alias("max_q"),
        F.floor(F.least(*r)).cast("int").alias("min_r"),
        F.ceil(F.greatest(*r)).cast("int").alias("max_r"),
    )


def box_cells(box: DataFrame) -> DataFrame:
    """Every cell of an axial box. Columns of the box are spread over the cluster before rows are made."""
    return (
        box.select(F.explode(F.sequence("min_q", "max_q")).alias("q"), "min_r", "max_r")
        .repartition(shuffle_width(box.sparkSession), "q")
        .select("q", F.explode(F.sequence("min_r", "max_r")).alias("r"))
    )


def domain_cells(spark: SparkSession, domain: SimpleNamespace, size: float, orientation: str = "POINTY") -> DataFrame:
    """Cells whose centre lies in the operational bounds."""
    require_pointy(orientation)
    x, y = hx.centre(F.col("q"), F.col("r"), size)
    return box_cells(axial_bounds(spark, domain, size)).where(within(domain, x, y))


def cells_of_points(points: DataFrame, domain: SimpleNamespace, size: float) -> DataFrame:
    """Add (q, r) to local points. A point is kept when its cell's centre, not itself, is in bounds."""
    placed = hx.with_cell(points, size)
    return placed.where(within(domain, *hx.centre(F.col("q"), F.col("r"), size)))


def neighbours(cells: DataFrame) -> DataFrame:
    """Cell and in-grid neighbour, one row per direction."""
    step = F.posexplode(hx.direction_literal()).alias("direction", "d")
    ahead = cells.select("q", "r", step).select(
        "q", "r", "direction", (F.col("q") + F.col("d.q")).alias("nq"), (F.col("r") + F.col("d.r")).alias("nr")
    )
    return ahead.join(cells.select(F.col("q").alias("nq"), F.col("r").alias("nr")), ["nq", "nr"])


def ring_rows(cells: DataFrame, radius: int) -> DataFrame:
    """`cells` (q, r and more) with one row per cell of their ring, `pos` and its `q`, `r`, in compiled code instead of a lambda.

    Cells are dealt out first, since each makes many rows and a file of points may be a single split.
    """
    keep = [n for n in cells.columns if n not in ("q", "r")]
    dealt = cells.repartition(shuffle_width(cells.sparkSession))
    rows = dealt.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(max(6 * radius - 1, 0)))))
    at = hx.ring_cell(F.col("q"), F.col("r"), F.lit(radius), F.col("pos")) if radius else F.struct("q", "r")
    return rows.select(*keep, "pos", at.alias("_at")).select(*keep, "pos", "_at.q", "_at.r")


def cell_costs(cells: DataFrame) -> DataFrame:
    """Traversal cost: infinite when restricted; a negative cost is an error."""
    bad = F.raise_error(F.lit("cell cost must not be negative"))
    cost = F.when(F.col("cost") < 0, bad).otherwise(F.col("cost"))
    return cells.withColumn("cost", F.when(F.col("restricted"), F.lit(float("inf"))).otherwise(cost))
