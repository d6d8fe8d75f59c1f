"""Spatial joins and searches over tables, by equality of grid cells with the exact predicate behind it.

Points are two columns (x, y) or a geometry column. Cells are squares of a given size, so any plane
works; the size should be near that of the typical shape or search radius.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loxodrome.functions import geom
from loxodrome.operators.stats import kept


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("bigint")


def with_bounds(df: DataFrame, column: str) -> DataFrame:
    """df with minx, miny, maxx, maxy of the geometry; written so, Parquet's statistics prune by box."""
    e = geom.envelope(F.col(column))
    return df.withColumn("_e", e).select(*df.columns, "_e.minx", "_e.miny", "_e.maxx", "_e.maxy")


def bbox_query(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """The rows whose bounds meet the box: four comparisons that reach the scan."""
    return df.filter((F.col("maxx") >= minx) & (F.col("minx") <= maxx) & (F.col("maxy") >= miny) & (F.col("miny") <= maxy))


def query_point(df: DataFrame, x: float, y: float) -> DataFrame:
    return bbox_query(df, x, y, x, y)


def box_cells(df: DataFrame, size: float) -> DataFrame:
    """df with one row for each cell (cx, cy) that its bounds meet."""
    span = lambda lo, hi: F.sequence(cell(F.col(lo), size), cell(F.col(hi), size))
    return df.withColumn("cx", F.explode(span("minx", "maxx"))).withColumn("cy", F.explode(span("miny", "maxy")))


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, shape: str, size: float) -> DataFrame:
    """points joined with the polygons they lie in. A point has one cell, so no pair comes twice."""
    cells = box_cells(with_bounds(polygons, shape), size)
    px, py = F.col(x), F.col(y)
    at = points.withColumn("cx", cell(px, size)).withColumn("cy", cell(py, size))
    both = at.join(cells, ["cx", "cy"])
    inside = px.between(F.col("minx"), F.col("maxx")) & py.between(F.col("miny"), F.col("maxy")) & geom.in_polygon(px, py, geom.rings(F.col(shape)))
    return both.filter(inside).select(*points.columns, *[c for c in polygons.columns])


def boxes_meeting(a: DataFrame, b: DataFrame) -> Column:
    return (F.col("maxx") >= F.col("minx_b")) & (F.col("minx") <= F.col("maxx_b")) & (F.col("maxy") >= F.col("miny_b")) & (F.col("miny") <= F.col("maxy_b"))


def box_join(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs of rows whose bounds meet; columns of b get the suffix _b. Of the cells that a pair shares only its lowest one counts."""
    bb = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    cells = bb.withColumn("cx", F.explode(F.sequence(cell(F.col("minx_b"), size), cell(F.col("maxx_b"), size)))).withColumn("cy", F.explode(F.sequence(cell(F.col("miny_b"), size), cell(F.col("maxy_b"), size))))
    both = box_cells(a, size).join(cells, ["cx", "cy"]).filter(boxes_meeting(a, b))
    own = (F.col("cx") == F.greatest(cell(F.col("minx"), size), cell(F.col("minx_b"), size))) & (F.col("cy") == F.greatest(cell(F.col("miny"), size), cell(F.col("miny_b"), size)))
    return both.filter(own).drop("cx", "cy")


def shapes_meeting(a: DataFrame, b: DataFrame, shape_a: str, shape_b: str, size: float) -> DataFrame:
    """Pairs whose geometries intersect; columns of b get the suffix _b."""
    found = box_join(with_bounds(a, shape_a), with_bounds(b, shape_b), size)
    bounds = ["minx", "miny", "maxx", "maxy"]
    return found.filter(geom.intersects(F.col(shape_a), F.col(f"{shape_b}_b"))).drop(*bounds, *[f"{c}_b" for c in bounds])


#: Pairs and searching points of a task, and rows of a side (with its copies for the cells around) that is broadcast.
PAIRS_OF_A_TASK, POINTS_OF_A_TASK, FEW = 5_000_000, 50_000, 500_000


def within_distance(a: DataFrame, b: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of points at most radius apart, with dist; columns of b get the suffix _b. b is dealt to its nine cells.

    The pairs of each cell are counted before they are made, and dealt over as many tasks as they are
    worth: a crowded cell's points of a go to several tasks, each of which has all of b near them.
    """
    near = F.array(F.lit(-1), F.lit(0), F.lit(1)).cast("array<bigint>")
    counts = lambda df, name: df.groupBy(cell(F.col(x), radius).alias("cx"), cell(F.col(y), radius).alias("cy")).agg(F.count(F.lit(1)).alias(name))
    around = counts(b, "n").withColumn("i", F.explode(near)).withColumn("j", F.explode(near)).select((F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"), "n")
    crowd = counts(a, "m").join(around, ["cx", "cy"]).groupBy("cx", "cy").agg((F.first("m") * F.sum("n")).alias("p")).agg(F.sum("p").alias("p"), F.max("p").alias("most")).first()
    tasks = -(-(crowd["p"] or 0) // PAIRS_OF_A_TASK)
    if tasks > 1:
        spread = min(tasks, max(1, -(-crowd["most"] // PAIRS_OF_A_TASK)))
        if 9 * b.count() <= FEW:
            return _near_pairs(a.repartition(tasks), b, radius, x, y, near, True)
        share = F.pmod(F.xxhash64(x, y, F.monotonically_increasing_id()), F.lit(spread)).cast("int")
        aa = a.withColumn("_part", share)
        return _near_pairs(aa, b.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))), radius, x, y, near, False, tasks)
    return _near_pairs(a, b, radius, x, y, near, False)


def _near_pairs(a: DataFrame, b: DataFrame, radius: float, x: str, y: str, near: Column, few: bool, tasks: int = 0) -> DataFrame:
    """The pairs of within_distance; with tasks, those of equal _part, dealt over so many tasks."""
    on = ["cx", "cy", "_part"] if tasks else ["cx", "cy"]
    bb = b.select(*[F.col(c).alias(c if c == "_part" else f"{c}_b") for c in b.columns])
    bb = bb.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).withColumn("cx", cell(F.col(f"{x}_b"), radius) + F.col("_i")).withColumn("cy", cell(F.col(f"{y}_b"), radius) + F.col("_j")).drop("_i", "_j")
    aa = a.withColumn("cx", cell(F.col(x), radius)).withColumn("cy", cell(F.col(y), radius))
    if tasks:
        aa, bb = aa.repartition(tasks, *on), bb.repartition(tasks, *on)
    dx, dy = F.col(x) - F.col(f"{x}_b"), F.col(y) - F.col(f"{y}_b")
    return aa.join(F.broadcast(bb) if few else bb, on).drop(*on).withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") <= radius)


def nearest(df: DataFrame, px: float, py: float, n: int, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """The n rows nearest to a point, with dist: each task keeps n."""
    dx, dy = F.col(x) - px, F.col(y) - py
    return df.withColumn("dist", F.sqrt(dx * dx + dy * dy)).orderBy("dist", key).limit(n)


def _width(b: DataFrame, k: int, size: float, x: str, y: str) -> float:
    """The widest of size, size / 2, size / 4, ... whose cells hold no more than 2 k points of b, as its points see it on average."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(14))).alias("_l")
    part = F.pow(F.lit(2.0), -F.col("_l")) * size
    dealt = b.select(x, y, levels).groupBy("_l", F.floor(F.col(x) / part).alias("cx"), F.floor(F.col(y) / part).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    rows = dealt.groupBy("_l").agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("crowd")).orderBy("_l").collect()  # 15 rows
    least = min((r["crowd"] for r in rows), default=0.0)
    return size / 2 ** next((r["_l"] for r in rows if r["crowd"] <= max(2.0 * k, 1.5 * least)), 0)


def knn_join(a: DataFrame, b: DataFrame, k: int, key_a: str, key_b: str, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """The k nearest points of b for each of a, with dist and rank; columns of b get the suffix _b.

    The cells are of this size, or a half, a quarter, ... of it where b lies so dense that a point's cell would
    hold far more than k. Squares of cells about each point are searched, twice as wide each round; a point is done once it
    has k found within the square's safe radius, or once the squares are wider than all points lie
    apart. What is still open is written out after each round, so that no round is computed again.
    """
    bb = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    w = Window.partitionBy(key_a).orderBy("dist", f"{key_b}_b")
    dx, dy = F.col(x) - F.col(f"{x}_b"), F.col(y) - F.col(f"{y}_b")
    both = a.select(x, y).unionByName(b.select(x, y)).agg(*[f(c) for c in (x, y) for f in (F.min, F.max)]).first()
    span = max(both[1] - both[0], both[3] - both[2], size) if both[0] is not None else size
    near = F.array(F.lit(-1), F.lit(0), F.lit(1)).cast("array<bigint>")
    parts = a.count() // POINTS_OF_A_TASK
    open_, done, wide = a.repartition(parts) if parts > 1 else a, None, _width(b, k, size, x, y)
    while True:
        last = wide >= 2 * span
        around = bb.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).withColumn("cx", cell(F.col(f"{x}_b"), wide) + F.col("_i")).withColumn("cy", cell(F.col(f"{y}_b"), wide) + F.col("_j")).drop("_i", "_j")
        found = open_.withColumn("cx", cell(F.col(x), wide)).withColumn("cy", cell(F.col(y), wide)).join(around, ["cx", "cy"]).drop("cx", "cy")
        ranked = found.withColumn("dist", F.sqrt(dx * dx + dy * dy))
        # whatever is nearer than a cell's width lies in the nine cells; in the last round all points do
        ranked = (ranked if last else ranked.filter(F.col("dist") <= wide)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if last:
            return ranked if done is None else done.unionByName(ranked)
        full = kept(ranked.withColumn("_full", F.count(F.lit(1)).over(Window.partitionBy(key_a))).filter(F.col("_full") == k).drop("_full"))
        done = full if done is None else done.unionByName(full)
        open_ = kept(open_.join(full.select(key_a).distinct(), key_a, "left_anti"))
        if open_.isEmpty():
            return done
        wide *= 2
