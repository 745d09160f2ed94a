"""Axial hexagon arithmetic as column expressions (pointy-top layout)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six axial steps in ring order, and the cell size and paddings of the case study.
DIRECTIONS = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]
CELL_SIZE = 500.0
PADDING = 1000.0
MARGIN = 2000.0

ROOT3 = 3**0.5


def direction_literal() -> Column:
    return F.array(*[F.struct(F.lit(q).alias("q"), F.lit(r).alias("r")) for q, r in DIRECTIONS])


def diagonal_literal() -> Column:
    after = DIRECTIONS[1:] + DIRECTIONS[:1]
    return F.array(
        *[
            F.struct(F.lit(a[0] + b[0]).alias("q"), F.lit(a[1] + b[1]).alias("r"))
            for a, b in zip(DIRECTIONS, after)
        ]
    )


def third(q: Column, r: Column) -> Column:
    return -q - r


def norm(q: Column, r: Column) -> Column:
    return F.greatest(F.abs(q), F.abs(r), F.abs(q + r))


def distance(aq: Column, ar: Column, bq: Column, br: Column) -> Column:
    return norm(aq - bq, ar - br)


def lerp(aq: Column, ar: Column, bq: Column, br: Column, t: Column) -> tuple[Column, Column]:
    return aq + (bq - aq) * t, ar + (br - ar) * t


def _rounded(qf: Column, rf: Column) -> Column:
    """The three rounded cube coordinates and their errors. `rint` rounds halves to even; `round` does not."""
    sf = -qf - rf
    parts = {"q": qf, "r": rf, "s": sf}
    return F.struct(
        *[F.rint(v).alias(n) for n, v in parts.items()],
        *[F.abs(F.rint(v) - v).alias(f"e{n}") for n, v in parts.items()],
    )


def _mended(p: Column, q_name: str = "q", r_name: str = "r") -> Column:
    """Rebuild the coordinate with the strictly largest error from the other two, so that q + r + s = 0."""
    q_worst = (p.eq > p.er) & (p.eq > p.es)
    q = F.when(q_worst, -p.r - p.s).otherwise(p.q)
    r = F.when(~q_worst & (p.er > p.es), -p.q - p.s).otherwise(p.r)
    return F.struct(q.cast("int").alias(q_name), r.cast("int").alias(r_name))


def nearest_cells(fractions: Column) -> Column:
    """Cells of an array of fractional positions (q, r). Each stage binds its values once."""
    return F.transform(F.transform(fractions, lambda p: _rounded(p.q, p.r)), lambda p: _mended(p))


def place(df: DataFrame, qf: Column, rf: Column, q: str = "q", r: str = "r") -> DataFrame:
    """Add the cell (q, r) of a fractional position to every row.

    The stages go through one-element `inline` generators: filters on the cell are not rewritten in terms of the
    position, where each of them would repeat the whole rounding and outgrow what Spark can compile.
    """
    keep = [n for n in df.columns if n not in (q, r)]
    staged = df.select(*keep, F.inline(F.array(F.struct(qf.alias("_qf"), rf.alias("_rf")))))
    staged = staged.select(*keep, F.inline(F.array(F.struct(_rounded(F.col("_qf"), F.col("_rf")).alias("_p")))))
    return staged.select(*keep, F.inline(F.array(_mended(F.col("_p"), q, r))))


def centre(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    x = F.lit(ROOT3) * q + F.lit(ROOT3) * r / F.lit(2.0)
    return F.lit(float(size)) * x, F.lit(float(size)) * (F.lit(1.5) * r)


def fractional(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    q = (F.lit(ROOT3 / 3) * x - F.lit(1 / 3) * y) / F.lit(float(size))
    r = (F.lit(2 / 3) * y) / F.lit(float(size))
    return q, r


def with_cell(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return place(df, *fractional(F.col(x), F.col(y), size))


def vertices(q: Column, r: Column, size: float) -> Column:
    """Array of the six corners, first one at 30 degrees."""
    x, y = centre(q, r, size)
    return F.transform(
        F.sequence(F.lit(0), F.lit(5)),
        lambda i: F.struct(
            (x + F.lit(float(size)) * F.cos(F.radians(i * 60 + 30))).alias("x"),
            (y + F.lit(float(size)) * F.sin(F.radians(i * 60 + 30))).alias("y"),
        ),
    )


def line_cells(aq: Column, ar: Column, bq: Column, br: Column) -> Column:
    """Cells met by n+1 equally spaced samples between two cells, n being their distance."""
    n = distance(aq, ar, bq, br)

    def between(t: Column) -> Column:
        q, r = lerp(aq, ar, bq, br, t)
        return F.struct(q.alias("q"), r.alias("r"))

    shares = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(n == 0, F.lit(0.0)).otherwise(i / n))
    return nearest_cells(F.transform(shares, between))


def pack(q: Column, r: Column) -> Column:
    """One BIGINT per cell, ordered like (q, r)."""
    return q.cast("bigint") * F.lit(1 << 32) + (r.cast("bigint") + F.lit(1 << 31))


def unpack(key: Column) -> tuple[Column, Column]:
    q = F.shiftright(key, 32)
    r = key - q * F.lit(1 << 32) - F.lit(1 << 31)
    return q.cast("int"), r.cast("int")


def around(q: Column, r: Column, radius: Column) -> Column:
    """Array of all cells within `radius`, by q then r."""
    columns = F.transform(
        F.sequence(-radius, radius),
        lambda dq: F.transform(
            F.sequence(F.greatest(-radius, -dq - radius), F.least(radius, -dq + radius)),
            lambda dr: F.struct((q + dq).cast("int").alias("q"), (r + dr).cast("int").alias("r")),
        ),
    )
    return F.flatten(columns)


def ring_cell(q: Column, r: Column, radius: Column, i: Column) -> Column:
    """Cell `i` of the ring of a radius above 0: it starts `radius` steps along direction 4 and walks directions 0 to 5."""
    side = F.floor(i / radius).cast("int")
    step = i - side * radius
    ahead = F.element_at(direction_literal(), side + 1)
    corners = [tuple(map(sum, zip(DIRECTIONS[4], *DIRECTIONS[:n]))) for n in range(6)]
    corner = F.element_at(F.array(*[F.struct(F.lit(cq).alias("q"), F.lit(cr).alias("r")) for cq, cr in corners]), side + 1)
    return F.struct(
        (q + radius * corner.q + step * ahead.q).cast("int").alias("q"),
        (r + radius * corner.r + step * ahead.r).cast("int").alias("r"),
    )


def ring(q: Column, r: Column, radius: Column) -> Column:
    """Ordered ring of a cell, which is its own ring of radius 0."""
    own = F.array(F.struct(q.cast("int").alias("q"), r.cast("int").alias("r")))
    return F.when(radius == 0, own).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(radius * 6 - 1, F.lit(0))), lambda i: ring_cell(q, r, radius, i))
    )
