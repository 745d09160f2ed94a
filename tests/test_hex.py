"""Properties of the hexagon functions."""

import math

from pyspark.sql import functions as F

from aerolattice.catalog import fixtures, load_all
from aerolattice.functions import hexmath as hx
from aerolattice.operators import grid


def cells(spark, n=12):
    side = F.sequence(F.lit(-n), F.lit(n))
    return spark.range(1).select(F.explode(side).alias("q")).select("q", F.explode(side).alias("r"))


def test_centre_round_trip(spark):
    at = cells(spark).withColumnsRenamed({"q": "q0", "r": "r0"})
    x, y = hx.centre(F.col("q0"), F.col("r0"), 500.0)
    back = hx.with_cell(at.withColumn("x", x).withColumn("y", y), 500.0)
    assert back.where("q <> q0 or r <> r0").count() == 0


def python_round(qf, rf):
    parts = [qf, rf, -qf - rf]
    whole = [round(p) for p in parts]
    errors = [abs(w - p) for w, p in zip(whole, parts)]
    if errors[0] > errors[1] and errors[0] > errors[2]:
        whole[0] = -whole[1] - whole[2]
    elif errors[1] > errors[2]:
        whole[1] = -whole[0] - whole[2]
    return whole[0], whole[1]


def test_rounding_of_halves(spark):
    steps = [i / 4 for i in range(-14, 15)]
    rows = [(a, b) for a in steps for b in steps]
    df = spark.createDataFrame(rows, "qf double, rf double")
    placed = hx.place(df.select("*", F.col("qf").alias("a"), F.col("rf").alias("b")), F.col("qf"), F.col("rf")).collect()
    for row in placed:
        assert (row.q, row.r) == python_round(row.a, row.b)


def test_ring_and_range_sizes(spark):
    df = spark.createDataFrame([(2, -5, n) for n in range(5)], "q int, r int, n int")
    for row in df.select("n", hx.ring(F.col("q"), F.col("r"), F.col("n")).alias("ring"), hx.around(F.col("q"), F.col("r"), F.col("n")).alias("all")).collect():
        n = row.n
        assert len({tuple(c) for c in row.ring}) == max(1, 6 * n)
        assert len({tuple(c) for c in row["all"]}) == 3 * n * n + 3 * n + 1
        for q, r in row.ring:
            assert max(abs(q - 2), abs(r + 5), abs(q - 2 + r + 5)) == n


def test_line_is_a_chain_of_neighbours(spark):
    df = spark.createDataFrame([(0, 0, 7, -3), (5, 5, 5, 5), (-4, 9, 6, -8)], "aq int, ar int, bq int, br int")
    for row in df.select("*", hx.line_cells(*[F.col(n) for n in ("aq", "ar", "bq", "br")]).alias("line")).collect():
        line = [tuple(c) for c in row.line]
        assert line[0] == (row.aq, row.ar) and line[-1] == (row.bq, row.br)
        for (aq, ar), (bq, br) in zip(line, line[1:]):
            assert max(abs(aq - bq), abs(ar - br), abs(aq + ar - bq - br)) == 1


def test_packed_keys_keep_cells_and_order(spark):
    df = cells(spark, 5).withColumn("k", hx.pack(F.col("q"), F.col("r")))
    q, r = hx.unpack(F.col("k"))
    rows = df.select("q", "r", "k", q.alias("uq"), r.alias("ur")).collect()
    assert all((x.q, x.r) == (x.uq, x.ur) for x in rows)
    assert [(x.q, x.r) for x in sorted(rows, key=lambda x: x.k)] == sorted((x.q, x.r) for x in rows)


def test_polygon_area(spark):
    row = spark.range(1).select(hx.vertices(F.lit(1), F.lit(2), 10.0).alias("v")).first()
    v = [(p.x, p.y) for p in row.v]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(v, v[1:] + v[:1]))) / 2
    assert math.isclose(area, 3 * math.sqrt(3) / 2 * 100)


def test_ring_rows_are_the_rings_from_many_tasks(spark):
    """Cells of a single split are dealt out before each makes its ring, and no lambda makes it."""
    cells = spark.createDataFrame([("a", 3, -2), ("a", 3, -2), (None, 0, 0), ("b", None, 1)], "name string, q int, r int").coalesce(1)
    for radius in (0, 1, 4):
        whole = cells.select("name", F.posexplode(hx.ring(F.col("q"), F.col("r"), F.lit(radius))).alias("pos", "c")).select("name", "pos", "c.q", "c.r")
        rows = grid.ring_rows(cells, radius)
        assert rows.columns == whole.columns and rows.count() == whole.count() == 4 * max(6 * radius, 1)
        assert rows.exceptAll(whole).isEmpty()
    plan = load_all()[0]["hex_ring"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Repartition" in plan


def test_lines_are_made_once_and_by_many_tasks(spark, tmp_path, monkeypatch):
    """Legs of a single split are dealt out, and no filter on a line makes it again below."""
    spark.range(1, 400).select(F.col("id").cast("int").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 30).select(F.col("id").cast("int").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(fixtures, "LEG_RANGE", 64)
    paths = fixtures.Site(spark, str(tmp_path)).paths()
    steps = paths.where(F.size("cells") >= 2).select("path_id", F.explode("cells").alias("c"))
    above, below = steps._jdf.queryExecution().optimizedPlan().toString().split("Repartition", 1)
    assert "lambda" in above and "lambda" not in below
    ends = [(r.path_id, r.cells[-1]) for r in paths.collect()]
    assert len(ends) == len({p for p, _ in ends}) > 300
    cells = {r.feature_id: (r.q, r.r) for r in fixtures.Site(spark, str(tmp_path)).terminals().collect()}
    after = dict(zip(sorted(cells), sorted(cells)[1:]))
    assert all(tuple(last) == cells[after[p]] for p, last in ends)
