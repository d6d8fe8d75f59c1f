"""Work that takes far longer by row than the read is dealt over tasks, and shared parts of an expression are computed once."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loxodrome.functions import geom, overlay
from loxodrome.plans import registry

HEAVY = ["geometry_measures", "numeric_rest", "s2_rest", "shape_rest", "geometry_parts", "decompositions", "geography", "functions_of_functions", "numeric_methods", "buffers", "grid_rest", "format_rest", "transforms"]


@pytest.fixture(scope="module")
def one_row_group(tmp_path_factory):
    """Two thousand customers and parts, each in a file of one row group, which a scan can't split."""
    path = tmp_path_factory.mktemp("wide")
    for name in ("customer", "part"):
        pq.write_table(pq.read_table(f"/root/testdata/sf0.01/{name}.parquet").slice(0, 2000), path / f"{name}.parquet", row_group_size=10_000)
    return str(path)


@pytest.mark.parametrize("name", HEAVY)
def test_rows_are_dealt(spark, one_row_group, name):
    assert registry.queries()[name](spark, one_row_group).rdd.getNumPartitions() > 1


def test_coordinates_of_a_point_are_its_columns(spark):
    """A cast to the geometry's type once hid that, and each use built the point again."""
    df = spark.range(3).select(geom.x(geom.point(F.col("id"), F.col("id") + 1)).alias("x"))
    assert "named_struct" not in df._jdf.queryExecution().optimizedPlan().toString() and [r["x"] for r in df.collect()] == [0.0, 1.0, 2.0]


def test_hull_without_triangles(monkeypatch):
    """An alpha of 0 keeps every triangle, so none is looked for: corners on a side, repeated points, points on a line."""
    from loxodrome.operators import analysis

    monkeypatch.setattr(analysis, "triangulated", lambda xy: 1 / 0)
    pts = [(0, 0), (2, 0), (1, 0), (2, 1), (0, 1), (0, 0.5), (1, 0.5), (2, 1)]
    assert overlay.alpha_polygons(pts, 0.0) == [[[(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]]
    assert overlay.alpha_polygons([(0, 0), (1, 1), (2, 2)], 0.0) == []


def test_hdbscan_of_copies(spark):
    """Copies of a point are one place: a thousand of each don't need the square of all points, nor are they clusters."""
    from loxodrome.operators import analysis

    place = spark.range(60).select(F.col("id").alias("i"), (F.when(F.col("id") < 30, 0.0).otherwise(900.0) + F.col("id") % 6).alias("x"), F.floor(F.col("id") % 30 / 6).cast("double").alias("y"))
    p = place.crossJoin(spark.range(1000).select(F.col("id").alias("c"))).select(F.lit(1).alias("g"), (F.col("i") + 60 * F.col("c")).alias("id"), "x", "y")
    got = analysis.hdbscan(p, ["g"], 10).groupBy("cluster", F.col("id") % 60 < 30).count().collect()
    assert sorted((r["cluster"], r[1], r["count"]) for r in got) == [(1, True, 30_000), (2, False, 30_000)]


def test_stream_to_database_where_executors_are_other_processes(tmp_path):
    """The database is in the driver's process; rows have to get there from executors."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from loxodrome.session import build_session
from loxodrome.plans import registry
spark = build_session("local-cluster[1,1,1024]", "t", **{{"spark.checkpoint.dir": "file://{tmp_path}/ck", "spark.executor.memory": "1g", "spark.ui.enabled": "false"}})
rows = registry.queries()["stream_to_database"](spark, "/root/testdata/sf0.001").collect()
print("rows", sorted((r[0], r[1]) for r in rows))
spark.stop()
"""
    root = str(Path(__file__).parents[1])
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": root, "TMPDIR": str(tmp_path)}, capture_output=True, text=True, timeout=240)
    con = __import__("duckdb").connect()
    expected = con.sql("select event_type, count(*) from '/root/testdata/sf0.001/events.parquet' group by all order by all").fetchall()
    assert f"rows {expected}" in done.stdout, done.stderr[-2000:]


def test_kriging_at_points_of_one_place(spark):
    from loxodrome.operators import analysis

    p = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, 7.0), (3, 4.0, 0.0, 1.0)], "p long, x double, y double, v double")
    got = analysis.kriging(p, p.select(F.col("p").alias("k"), "x", "y"), "k", "p", "v", 2.0, 2).collect()
    assert {r["k"]: r["estimate"] for r in got} == {1: 5.0, 2: 7.0, 3: 1.0}


def test_a_point_near_a_shared_side_is_in_one_triangle(spark):
    """A side is reckoned the same from either end: points on it, to rounding, are in one of the two triangles."""
    a, b, c, d = (-500.3, -400.1), (505.7, 400.9), (500.1, -410.7), (-510.9, 405.3)
    rows = [(i, a[0] + (b[0] - a[0]) * i / 997, a[1] + (b[1] - a[1]) * i / 997) for i in range(1, 997)]
    ring = lambda *p: F.array(*[geom.coord(*q) for q in (*p, p[0])])
    inside = [geom.in_ring(F.col("x"), F.col("y"), ring(*t)).cast("int") for t in ((a, b, d), (b, a, c))]
    assert [r["n"] for r in spark.createDataFrame(rows, "k int, x double, y double").select((inside[0] + inside[1]).alias("n")).collect()] == [1] * 996


def test_knn_starts_with_narrow_cells_where_points_are_dense(spark):
    from loxodrome.operators import spatial

    dense = spark.range(2500).select((F.col("id") % 50).cast("double").alias("x"), F.floor(F.col("id") / 50).cast("double").alias("y"))
    assert spatial._width(dense, 3, 100.0, "x", "y") < 4 and spatial._width(dense, 3, 1.0, "x", "y") == 1.0


def test_sums_of_copies_within_a_distance(spark, monkeypatch):
    """Points at one place meet others as one; a crowded cell's pairs go to several tasks, with or without a broadcast."""
    import numpy as np

    from loxodrome.operators import analysis, spatial

    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(0, 6)), float(rng.integers(0, 6)), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "s long, x double, y double, w double")
    x, y, w = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    near = (np.hypot(x[:, None] - x, y[:, None] - y) <= 2) & ~np.eye(200, dtype=bool)
    z = w - w.mean()
    for few in (500_000, 0):
        monkeypatch.setattr(spatial, "PAIRS_OF_A_TASK", 1000)
        monkeypatch.setattr(spatial, "FEW", few)
        assert {r["s"]: r["g"] for r in analysis.getis_ord_g(df, "s", "w", 2.0).collect()} == pytest.approx(dict(enumerate((near * w).sum(1) / (w.sum() - w))))
        assert analysis.morans_i(df, "s", "w", 2.0).first()[0] == pytest.approx((near * np.outer(z, z)).sum() / near.sum() / w.var())
        pairs = spatial.within_distance(df, df, 2.0)
        assert pairs.count() == near.sum() + 200 and pairs.rdd.getNumPartitions() > 1


def test_bootstrap_plan_has_one_sum_for_all_resamples(spark):
    """Not two for each of them, which no compiled aggregate holds."""
    from loxodrome.operators import stats

    df = spark.range(50).select("id", F.col("id").cast("double").alias("v"))
    assert stats.bootstrap_ci(df, "v", "id", 100)._jdf.queryExecution().analyzed().toString().count("sum(") <= 4


def test_triangles_of_many_points():
    """Twenty thousand points in a time that their square would not allow; the circles of some are held against all points."""
    import time

    import numpy as np

    from loxodrome.operators import analysis

    xy = np.random.default_rng(6).uniform(0, 1, (20_000, 2))
    began = time.process_time()
    t = analysis.triangulated(xy)
    assert time.process_time() - began < 30
    for a, b, c in xy[t[::997]]:
        u, v = b - a, c - a
        d = 2 * (u[0] * v[1] - u[1] * v[0])
        at = np.array([v[1] * (u @ u) - u[1] * (v @ v), u[0] * (v @ v) - v[0] * (u @ u)]) / d
        assert (np.hypot(*(xy - a - at).T) > np.hypot(*at) * (1 - 1e-9)).all()
