"""Spatial queries. The tables hold no coordinates: points come from keys by whole-number arithmetic, boxes from nation keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from loxodrome.functions import geog, geom, grids
from loxodrome.operators import analysis, spatial
from loxodrome.operators.index import SpatialIndex
from loxodrome.plans.base import Registry, dealt, table
from loxodrome.sources import formats

REGISTRY = Registry()
query = REGISTRY.query

_LON, _LAT = "({k} * 37 % 36000) / 1e2 - 180", "({k} * 53 % 17000) / 1e2 - 85"
_XY = "select c_custkey as k, c_acctbal as v, " + _LON.format(k="c_custkey") + " as x, " + _LAT.format(k="c_custkey") + " as y from customer"
_SITES = "select s_suppkey as s, s_acctbal as w, " + _LON.format(k="(s_suppkey * 91)") + " as x, " + _LAT.format(k="(s_suppkey * 17)") + " as y from supplier"
_BOXES = "select n_nationkey as n, n_nationkey * 14 - 178 as x0, n_nationkey * 5 - 80 as y0, n_nationkey * 14 - 158 + n_nationkey % 4 as x1, n_nationkey * 5 - 50 + n_nationkey % 7 as y1 from nation"
#: Area of the hull of the points p(g, x, y), which are whole numbers: by the sides that all other points lie to the left of.
_HULLS = """sides as (select p.g, p.x as px, p.y as py, q.x as qx, q.y as qy from p join p q on p.g = q.g and (p.x <> q.x or p.y <> q.y)
  where not exists (select 1 from p r where r.g = p.g and ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0
    or (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 and ((r.x - p.x) * (r.x - q.x) > 0 or (r.y - p.y) * (r.y - q.y) > 0)))),
hulls as (select g, sum(px * qy - qx * py) / 2e0 as area from sides group by g)"""
#: Haversine distance of two pairs of degrees in SQL.
_HAV = "2 * {r} * atan2(sqrt(pow(sin(radians({b} - {d}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({a} - {c}) / 2), 2)), sqrt(1 - (pow(sin(radians({b} - {d}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({a} - {c}) / 2), 2))))"


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_acctbal").alias("v"), ((k * 37 % 36000) / F.lit(1e2) - 180).alias("x"), ((k * 53 % 17000) / F.lit(1e2) - 85).alias("y"))


def _sites(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("s"), F.col("s_acctbal").alias("w"), ((k * 91 * 37 % 36000) / F.lit(1e2) - 180).alias("x"), ((k * 17 * 53 % 17000) / F.lit(1e2) - 85).alias("y"))


def _boxes(spark, sf_dir):
    n = F.col("n_nationkey").cast("double")
    box = geom.bbox(n * 14 - 178, n * 5 - 80, n * 14 - 158 + n % 4, n * 5 - 50 + n % 7)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), geom.bbox_to_polygon(box).alias("shape"))


def _r(c, k=6):
    return F.round(c, k)


@query(f"select k, round({_HAV.format(r=6371.0088, a='x', b='y', c='-0.1278', d='51.5074')}, 6) as km, round({_HAV.format(r=6371008.8, a='x', b='y', c='-0.1278', d='51.5074')}, 3) as metres from ({_XY})")
def haversine(spark, sf_dir):
    p, q = geom.point(F.col("x"), F.col("y")), geom.point(-0.1278, 51.5074)
    return _points(spark, sf_dir).select("k", _r(geom.distance_geodesic(p, q)).alias("km"), _r(geog.distance_great_circle(p, q), 3).alias("metres"))


@query(f"""
select k, round(fmod(degrees(atan2(cos(radians(10)) * sin(radians(20 - x)), cos(radians(y)) * sin(radians(10)) - sin(radians(y)) * cos(radians(10)) * cos(radians(20 - x)))) + 360, 360), 6) as bearing,
  round(degrees(asin(sin(radians(y)) * cos(500 / 6371.0088) + cos(radians(y)) * sin(500 / 6371.0088) * cos(radians(45)))), 6) as dest_lat,
  round(x + degrees(atan2(sin(radians(45)) * sin(500 / 6371.0088) * cos(radians(y)), cos(500 / 6371.0088) - sin(radians(y)) * (sin(radians(y)) * cos(500 / 6371.0088) + cos(radians(y)) * sin(500 / 6371.0088) * cos(radians(45))))), 6) as dest_lon,
  round((x + 20) / 2, 6) as mid_x, round(degrees(atan2(sin(radians(y)) + sin(radians(10)), sqrt(pow(cos(radians(y)) + cos(radians(10)) * cos(radians(20 - x)), 2) + pow(cos(radians(10)) * sin(radians(20 - x)), 2)))), 6) as gc_mid_lat,
  round(sqrt((x - 20) * (x - 20) + (y - 10) * (y - 10)), 6) as distance, round(atan2(10 - y, 20 - x), 6) as azimuth
from ({_XY})
""")
def geodesy(spark, sf_dir):
    p, q = geom.point(F.col("x"), F.col("y")), geom.point(20.0, 10.0)
    dest = geom.destination(p, 45.0, 500.0)
    return _points(spark, sf_dir).select(
        "k", _r(geom.bearing(p, q)).alias("bearing"), _r(geom.y(dest)).alias("dest_lat"), _r(geom.x(dest)).alias("dest_lon"), _r(geom.x(geom.midpoint(p, q))).alias("mid_x"), _r(geom.y(geog.midpoint(p, q))).alias("gc_mid_lat"),
        _r(geom.distance(p, q)).alias("distance"), _r(geom.azimuth(p, q)).alias("azimuth"),
    )


@query(f"""
select k, round(x * 20037508.34 / 180, 3) as half_x, round(ln(tan((90 + y) * pi() / 360)) / (pi() / 180) * 20037508.34 / 180, 3) as half_y, round(6378137 * x * pi() / 180, 3) as axis_x, round(6378137 * ln(tan(pi() / 4 + y * pi() / 360)), 3) as axis_y,
  round(x, 6) as back_x, round(y, 6) as back_y, least(cast(floor((x + 180) / 6) as integer) + 1, 60) as zone, case when y >= 0 then 32600 else 32700 end + least(cast(floor((x + 180) / 6) as integer) + 1, 60) as epsg
from ({_XY})
""")
def mercator(spark, sf_dir):
    p = geom.point(F.col("x"), F.col("y"))
    half, axis = geom.project(p, 4326, 3857), geog.to_web_mercator(p)
    back = geog.from_web_mercator(axis)
    return _points(spark, sf_dir).select(
        "k", _r(geom.x(half), 3).alias("half_x"), _r(geom.y(half), 3).alias("half_y"), _r(geom.x(axis), 3).alias("axis_x"), _r(geom.y(axis), 3).alias("axis_y"), _r(geom.x(back)).alias("back_x"), _r(geom.y(back)).alias("back_y"),
        geog.utm_zone(F.col("x")).alias("zone"), geog.utm_epsg(F.col("x"), F.col("y")).alias("epsg"),
    )


@query(f"""
with c as (select k, x, y, least(cast(floor((y + 90) / 180 * 256) as bigint), 255) as r, least(cast(floor((x + 180) / 360 * 256) as bigint), 255) as c from ({_XY}))
select k, 7 * 1152921504606846976 + r * 1073741824 + c as cell, 7 as resolution, round((c + 0.5) / 256 * 360 - 180, 6) as center_x, round((r + 0.5) / 256 * 180 - 90, 6) as center_y,
  lower(lpad(to_hex(7 * 1152921504606846976 + r * 1073741824 + c), 16, '0')) as text, greatest(abs(r - 128), abs(c - 128)) as distance, 5 * 1152921504606846976 + (r // 4) * 1073741824 + c // 4 as parent, true as round_trip
from c
""")
def grid_h3(spark, sf_dir):
    i = F.col("cell")
    other = grids.h3_from_lat_lon(F.lit(0.1), F.lit(0.1), 7)
    p = _points(spark, sf_dir).withColumn("cell", grids.h3_from_lat_lon(F.col("y"), F.col("x"), 7))
    c = grids.h3_center(i)
    return p.select("k", "cell", grids.h3_resolution(i).alias("resolution"), _r(c["x"]).alias("center_x"), _r(c["y"]).alias("center_y"), grids.h3_to_string(i).alias("text"), grids.h3_distance(i, other).alias("distance"), grids.h3_parent(i, 5).alias("parent"), (grids.h3_from_string(grids.h3_to_string(i))["value"] == i).alias("round_trip"))


@query(f"""
with c as (select k, least(cast(floor((y + 90) / 180 * 16) as bigint), 15) as r, least(cast(floor((x + 180) / 360 * 16) as bigint), 15) as c from ({_XY})),
d as (select k, greatest(0, least(15, r + i)) as r, (c + j + 16) % 16 as c from c, (values (-1), (0), (1)) as a(i), (values (-1), (0), (1)) as b(j))
select 3 * 1152921504606846976 + r * 1073741824 + c as cell, count(*) as n, sum(k) as ks from d group by all
""")
def kring(spark, sf_dir):
    p = _points(spark, sf_dir).select("k", F.explode(grids.h3_k_ring(grids.h3_from_lat_lon(F.col("y"), F.col("x"), 3), 1)).alias("cell"))
    return p.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("k").cast("double").alias("ks"))


@query(f"""
with s as (select k, cos(radians(y)) * cos(radians(x)) as a, cos(radians(y)) * sin(radians(x)) as b, sin(radians(y)) as c from ({_XY})),
f as (select k, case when abs(a) >= abs(b) and abs(a) >= abs(c) then case when a > 0 then 0 else 3 end when abs(b) >= abs(a) and abs(b) >= abs(c) then case when b > 0 then 1 else 4 end when c > 0 then 2 else 5 end as face,
  case when abs(a) >= abs(b) and abs(a) >= abs(c) then b / abs(a) when abs(b) >= abs(a) and abs(b) >= abs(c) then a / abs(b) else a / abs(c) end as u,
  case when abs(a) >= abs(b) and abs(a) >= abs(c) then c / abs(a) when abs(b) >= abs(a) and abs(b) >= abs(c) then c / abs(b) else b / abs(c) end as v from s)
select k, 10 * 576460752303423488 + face * 72057594037927936 + least(cast(floor((u + 1) / 2 * 1024) as bigint), 1023) * 268435456 + least(cast(floor((v + 1) / 2 * 1024) as bigint), 1023) as cell, 10 as level, true as inside from f
""")
def grid_s2(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("cell", grids.s2_from_lat_lon(F.col("y"), F.col("x"), 10))
    c = grids.s2_center(F.col("cell"))
    return p.select("k", "cell", grids.s2_level(F.col("cell")).alias("level"), grids.s2_contains(F.col("cell"), c["y"], c["x"], 10).alias("inside"))


@query(f"""
select n, cast((x1 - x0) * (y1 - y0) as double) as area, cast(2 * (x1 - x0 + y1 - y0) as double) as perimeter, (x0 + x1) / 2e0 as cx, (y0 + y1) / 2e0 as cy, cast(x0 as double) as minx, cast(y1 as double) as maxy, 5 as num_points, true as valid, 'Polygon' as kind, cast((x1 - x0) * (y1 - y0) as double) as signed_area, 2 as dimension, cast(x1 - x0 as double) as width,
  round(abs((x1 - x0) * 2 * (sin(radians(y1)) - sin(radians(y0)))) * pi() / 180 * 6371.0088 * 6371.0088 / 2, 2) as area_km2
from ({_BOXES})
""")
def measures(spark, sf_dir):
    g = F.col("shape")
    e, c = geom.envelope(g), geom.centroid(g)
    ring = F.slice(geom.exterior(g), 1, 4)  # the formula takes every vertex once
    return _boxes(spark, sf_dir).select(
        "n", _r(geom.area(g)).alias("area"), _r(geom.perimeter(g)).alias("perimeter"), _r(geom.x(c)).alias("cx"), _r(geom.y(c)).alias("cy"), e["minx"].alias("minx"), e["maxy"].alias("maxy"), geom.num_points(g).alias("num_points"), geom.is_valid(g).alias("valid"),
        geom.geom_type(g).alias("kind"), _r(geom.signed_area(g)).alias("signed_area"), geom.dimension(g).alias("dimension"), geom.bbox_width(e).alias("width"), _r(geom.ring_area_geodesic(ring), 2).alias("area_km2"),
    )


@query(f"""
select k, round(x + 3, 6) as tx, round(y * 2, 6) as sy, round(x * cos(0.5) - y * sin(0.5), 6) as rx, round(-y, 6) as my, round(x + 0.5 * y, 6) as shear_x, round(sqrt(25 + 144), 6) as length, round(x + 2.5, 6) as along_x, round(y + 6, 6) as along_y, 5e-1 as located, true as closed, 2 as n
from ({_XY})
""")
def affine(spark, sf_dir):
    p = geom.point(F.col("x"), F.col("y"))
    line = geom.line(F.array(geom.coord(F.col("x"), F.col("y")), geom.coord(F.col("x") + 5, F.col("y") + 12)))
    mid = geom.along(line, 0.5)
    closed = geom.line(F.array(geom.coord(0, 0), geom.coord(1, 0), geom.coord(1, 1), geom.coord(0, 0)))
    return _points(spark, sf_dir).select(
        "k", _r(geom.x(geom.translate(p, 3.0, 0.0))).alias("tx"), _r(geom.y(geom.scale(p, 1.0, 2.0))).alias("sy"), _r(geom.x(geom.rotate(p, 0.5))).alias("rx"), _r(geom.y(geom.reflect(p, "x"))).alias("my"), _r(geom.x(geom.shear(p, 0.5, 0.0))).alias("shear_x"),
        _r(geom.length(line)).alias("length"), _r(geom.x(mid)).alias("along_x"), _r(geom.y(mid)).alias("along_y"), _r(geom.locate_point(line, mid)).alias("located"), geom.is_closed(closed).alias("closed"), geom.num_points(geom.reverse(line)).alias("n"),
    )


@query(f"select k, n from ({_XY}) join ({_BOXES}) on x >= x0 and x < x1 and y >= y0 and y < y1")
def point_in_polygon_join(spark, sf_dir):
    return spatial.points_in_polygons(_points(spark, sf_dir), _boxes(spark, sf_dir), "x", "y", "shape", 20.0).select("k", "n")


@query(f"select a.n as n, b.n as n_b from ({_BOXES}) a join ({_BOXES}) b on a.x1 >= b.x0 and a.x0 <= b.x1 and a.y1 >= b.y0 and a.y0 <= b.y1")
def polygons_meeting_join(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return spatial.shapes_meeting(b, b, "shape", "shape", 25.0).select("n", "n_b")


@query(f"""
select n, k, x >= x0 and x < x1 and y >= y0 and y < y1 as contains, x > x0 and x < x1 and y > y0 and y < y1 as intersects, not (x > x0 and x < x1 and y > y0 and y < y1) as disjoint, false as touches, x >= x0 and x < x1 and y >= y0 and y < y1 as within,
  x >= x0 and x < x1 and y >= y0 and y < y1 as covers, x >= x0 and x < x1 and y >= y0 and y < y1 as covered_by
from ({_XY}) join ({_BOXES}) on k % 25 = n
""".replace("x > x0 and x < x1 and y > y0 and y < y1", "x >= x0 and x < x1 and y >= y0 and y < y1"))
def predicates(spark, sf_dir):
    both = _points(spark, sf_dir).join(_boxes(spark, sf_dir), F.col("k") % 25 == F.col("n"))
    g, p = F.col("shape"), geom.point(F.col("x"), F.col("y"))
    return both.select(
        "n", "k", geom.contains(g, p).alias("contains"), geom.intersects(g, p).alias("intersects"), geom.disjoint(g, p).alias("disjoint"), geom.touches(g, p).alias("touches"), geom.within(p, g).alias("within"), geom.covers(g, p).alias("covers"), geom.covered_by(p, g).alias("covered_by"),
    )


@query(f"select a.k as k, b.s as s_b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as dist from ({_XY}) a, ({_SITES}) b where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 8")
def within_distance_join(spark, sf_dir):
    return spatial.within_distance(_points(spark, sf_dir), _sites(spark, sf_dir), 8.0).select("k", "s_b", _r("dist").alias("dist"))


@query(f"select k, x, y from ({_XY}) where x between -20 and 40 and y between 0 and 30")
def bbox_query(spark, sf_dir):
    p = _points(spark, sf_dir)
    boxed = p.select("k", "x", "y", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))
    return spatial.bbox_query(boxed, -20.0, 0.0, 40.0, 30.0).select("k", "x", "y")


@query(f"select k, round(sqrt((x - 12) * (x - 12) + (y - 3) * (y - 3)), 6) as dist from ({_XY}) order by sqrt((x - 12) * (x - 12) + (y - 3) * (y - 3)), k limit 12")
def nearest(spark, sf_dir):
    return spatial.nearest(_points(spark, sf_dir), 12.0, 3.0, 12, "k").select("k", _r("dist").alias("dist"))


@query(f"""
select k, s_b, rank, round(d, 6) as dist from (select a.k, b.s as s_b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d,
  row_number() over (partition by a.k order by sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.s) as rank from ({_XY}) a, ({_SITES}) b) where rank <= 3
""")
def knn_join(spark, sf_dir):
    return spatial.knn_join(_points(spark, sf_dir), _sites(spark, sf_dir), 3, "k", "s", 15.0).select("k", "s_b", "rank", _r("dist").alias("dist"))


@query(f"""
with t as (select n as k, (x0 + x1) / 2e0 as x, (y0 + y1) / 2e0 as y from ({_BOXES}))
select t.k as k, round(sum(s.w / (pow(s.x - t.x, 2) + pow(s.y - t.y, 2))) / sum(1 / (pow(s.x - t.x, 2) + pow(s.y - t.y, 2))), 4) as idw from t, ({_SITES}) s group by t.k
""")
def idw(spark, sf_dir):
    c = geom.centroid(F.col("shape"))
    t = _boxes(spark, sf_dir).select(F.col("n").alias("k"), geom.x(c).alias("x"), geom.y(c).alias("y"))
    return analysis.idw(_sites(spark, sf_dir), t, "k", "w").select("k", _r("idw", 4).alias("idw"))


@query(f"""
with recursive p as (select k, x, y from ({_XY})),
near as (select a.k as k, b.k as o from p a, p b where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 2.5),
core as (select k from near group by k having count(*) >= 4),
links as (select near.k, near.o from near join core a on near.k = a.k join core b on near.o = b.k),
reach(k, r) as (select k, k from core union select reach.k, links.o from reach join links on reach.r = links.k),
label as (select k, min(r) as l from reach group by k),
ids as (select l, cast(row_number() over (order by l) as integer) as cluster from (select distinct l from label)),
own as (select k, cluster from label join ids using (l))
select k, cluster from own union all select near.k, min(cluster) from near join own on near.o = own.k where near.k not in (select k from core) group by near.k
""")
def dbscan(spark, sf_dir):
    return analysis.dbscan(_points(spark, sf_dir).select("k", "x", "y"), "k", 2.5, 4)


@query(f"""
with c(c, cx, cy) as (values (0, -100.0, -40.0), (1, 0.0, 0.0), (2, 100.0, 40.0)),
d as (select k, x, y, c, row_number() over (partition by k order by pow(x - cx, 2) + pow(y - cy, 2), c) as r from ({_XY}), c)
select c, round(avg(x), 6) as x, round(avg(y), 6) as y, count(*) as n from d where r = 1 group by c
""")
def kmeans_step(spark, sf_dir):
    centres = spark.createDataFrame([(0, -100.0, -40.0), (1, 0.0, 0.0), (2, 100.0, 40.0)], "c int, x double, y double")
    return analysis.kmeans_step(_points(spark, sf_dir), centres).select("c", _r("x").alias("x"), _r("y").alias("y"), "n")


@query(f"""
with g as (select i + 21 * j as node, -180 + i * 18.0 as x, -85 + j * 8.5 as y from range(21) a(i), range(21) b(j)),
d as (select node, s, sqrt(pow(g.x - t.x, 2) + pow(g.y - t.y, 2)) as d, row_number() over (partition by node order by sqrt(pow(g.x - t.x, 2) + pow(g.y - t.y, 2)), s) as r from g, ({_SITES}) t)
select node, s, round(d, 6) as dist from d where r = 1
""")
def voronoi_grid(spark, sf_dir):
    nodes = analysis.grid_nodes(spark, -180.0, -85.0, 180.0, 85.0)
    return analysis.nearest_site(nodes, _sites(spark, sf_dir), "node", "s").select("node", "s", _r("dist").alias("dist"))


@query(f"""
with g as (select i + 21 * j as node, i, j, -180 + i * 18e0 as x, -85 + j * 8.5e0 as y from range(21) a(i), range(21) b(j)),
d as (select node, i, j, s, row_number() over (partition by node order by sqrt(pow(g.x - t.x, 2) + pow(g.y - t.y, 2)), s) as r from g, ({_SITES}) t),
p as (select s as g, i as x, j as y from d where r = 1), {_HULLS}
select distinct p.g as s, round(coalesce(area, 0) * 18 * 8.5e0, 4) as area from p left join hulls using (g)
""")
def voronoi_cells(spark, sf_dir):
    out = analysis.voronoi(_sites(spark, sf_dir), "s", -180.0, -85.0, 180.0, 85.0)
    return out.select("s", _r(geom.area(F.col("geom")), 4).alias("area"))


@query(f"""
with p as (select distinct c_custkey % 10 as g, c_custkey * 37 % 36000 as x, c_custkey * 53 % 17000 as y from customer), {_HULLS}
select distinct p.g, round(coalesce(area, 0) / 1e4, 4) as area from p left join hulls using (g)
""")
def convex_hulls(spark, sf_dir):
    p = _points(spark, sf_dir).select((F.col("k") % 10).alias("g"), "x", "y")
    return analysis.hulls(p, ["g"]).select("g", _r(geom.area(F.col("geom")), 4).alias("area"))


@query("""
with p as (select c_custkey % 150 as g, c_custkey as id, (c_custkey * 7919 % 10007) / 10e0 as x, (c_custkey * c_custkey % 10009) / 10e0 as y from customer),
t as (select a.g, a.id as a, b.id as b, c.id as c, a.x as ax, a.y as ay, b.x - a.x as ux, b.y - a.y as uy, c.x - a.x as vx, c.y - a.y as vy from p a join p b on a.g = b.g and a.id < b.id join p c on a.g = c.g and b.id < c.id),
o as (select *, 2 * (ux * vy - uy * vx) as d, ux * ux + uy * uy as uu, vx * vx + vy * vy as vv from t where ux * vy <> uy * vx),
r as (select g, a, b, c, ax + (vy * uu - uy * vv) / d as x, ay + (ux * vv - vx * uu) / d as y, (pow(vy * uu - uy * vv, 2) + pow(ux * vv - vx * uu, 2)) / (d * d) as rr from o)
select g, a, b, c from r where not exists (select 1 from p where p.g = r.g and p.id not in (r.a, r.b, r.c) and pow(p.x - r.x, 2) + pow(p.y - r.y, 2) < rr * (1 - 1e-12))
""")
def delaunay(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select((k % 150).alias("g"), k.alias("id"), ((k * 7919 % 10007) / F.lit(10.0)).alias("x"), ((k * k % 10009) / F.lit(10.0)).alias("y"))
    t, order = analysis.delaunay(p, ["g"]), F.array_sort(F.array("a", "b", "c"))
    return t.select("g", *[order[i].alias(c) for i, c in enumerate("abc")])


@query("""
with r as (select i // 40 as row, i % 40 as col, cast((i * 7919) % 1000 as double) as value from range(1600) t(i))
select a.row, a.col, round(avg(b.value), 6) as focal_mean, round(max(a.value) * 2 + 1, 6) as doubled from r a join r b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by a.row, a.col
""")
def raster_focal(spark, sf_dir):
    r = _raster(spark)
    twice = analysis.raster_algebra(r, r, lambda a, b: a + b + 1).select("row", "col", F.col("value").alias("doubled"))
    return analysis.focal_mean(r).select("row", "col", _r("value").alias("focal_mean")).join(twice, ["row", "col"])


def _raster(spark):
    return analysis.raster_empty(spark, 40, 40).withColumn("value", ((F.col("row").cast("bigint") * 40 + F.col("col")) * 7919 % 1000).cast("double"))


@query("""
with r as (select i // 40 as row, i % 40 as col, cast((i * 7919) % 1000 as double) as value from range(1600) t(i))
select cast(row // 10 * 4 + col // 10 as integer) as zone, count(*) as n, round(avg(value), 6) as mean, min(value) as min, max(value) as max from r group by all
""")
def zonal_stats(spark, sf_dir):
    r = _raster(spark)
    zones = r.select("row", "col", (F.floor(F.col("row") / 10) * 4 + F.floor(F.col("col") / 10)).cast("int").alias("zone"))
    return analysis.zonal_stats(r, zones).withColumn("mean", _r("mean"))


@query(f"""
select k, 'POINT (' || cast(k % 360 as integer) || ' ' || cast(k % 90 as integer) || ')' as wkt, cast(k % 360 as double) as x, cast(k % 90 as double) as y, '{{"coordinates":[' || k % 360 || ',' || k % 90 || '],"type":"Point"}}' as geojson,
  '<Point><coordinates>' || k % 360 || ',' || k % 90 || ',0</coordinates></Point>' as kml, true as wkb_ok from ({_XY})
""")
def format_round_trips(spark, sf_dir):
    g = geom.point((F.col("k") % 360).cast("double"), (F.col("k") % 90).cast("double"))
    p = _points(spark, sf_dir).select("k", g.alias("g")).select("k", "g", formats.to_wkt(F.col("g")).alias("wkt"), formats.to_geojson(F.col("g")).alias("geojson"), formats.to_kml(F.col("g")).alias("kml"), formats.to_wkb(F.col("g")).alias("wkb"))
    back, other = formats.parse_wkt(F.col("wkt")), formats.parse_geojson(F.col("geojson"))
    same = geom.equals(formats.from_wkb(F.col("wkb")), F.col("g")) & (formats.point_to_wkb(geom.x(F.col("g")), geom.y(F.col("g"))) == F.col("wkb"))
    return p.select("k", "wkt", geom.x(back).alias("x"), geom.y(other).alias("y"), "geojson", "kml", same.alias("wkb_ok"))


@query(f"select n, 'POLYGON ((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '))' as wkt, cast((x1 - x0) * (y1 - y0) as double) as area, cast((x1 - x0) * (y1 - y0) as double) as wkb_area from ({_BOXES})")
def polygon_formats(spark, sf_dir):
    b = _boxes(spark, sf_dir).select("n", "shape", formats.to_wkt(F.col("shape")).alias("wkt"), formats.to_wkb(F.col("shape")).alias("wkb"))
    return b.select("n", "wkt", _r(geom.area(formats.parse_wkt(F.col("wkt")))).alias("area"), _r(geom.area(formats.from_wkb(F.col("wkb")))).alias("wkb_area"))


@query(f"select k, 33 as n, round(x + (k % 5 + 1), 6) as east, round(y - (k % 5 + 1), 6) as south, round(16 * pow(k % 5 + 1, 2) * sin(pi() / 16), 6) as area from ({_XY})")
def buffers(spark, sf_dir):
    p = geom.point(F.col("x"), F.col("y"))
    b = geom.buffer_point(p, F.col("k") % 5 + 1)
    e = geom.envelope(b)
    return dealt(_points(spark, sf_dir)).select("k", geom.num_points(b).alias("n"), _r(e["maxx"]).alias("east"), _r(e["miny"]).alias("south"), _r(geom.area(b)).alias("area"))


@query(f"select cast(floor(x / 30) as bigint) as qx, cast(floor(y / 30) as bigint) as qy, count(*) as n from ({_XY}) group by all")
def quadrat_count(spark, sf_dir):
    return analysis.quadrat_count(_points(spark, sf_dir), 30.0)


@query(f"""
select s, round(coalesce(sum(case when d <= 12 then pow(1 - d * d / 144, 2) * 3 / (pi() * 144) end), 0), 9) as density
from (select s.s as s, sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2)) as d from ({_SITES}) s, ({_XY}) p) group by s
""")
def kernel_density(spark, sf_dir):
    return analysis.kernel_density(_points(spark, sf_dir), _sites(spark, sf_dir), "s", 12.0).select("s", _r("density", 9).alias("density"))


@query(f"""
select a.s as s, round(coalesce(sum(case when a.s <> b.s and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 40 then b.w end), 0) / (any_value(t) - any_value(a.w)), 8) as g
from ({_SITES}) a, ({_SITES}) b, (select sum(w) as t from ({_SITES})) group by a.s
""")
def getis_ord_g(spark, sf_dir):
    return analysis.getis_ord_g(_sites(spark, sf_dir), "s", "w", 40.0).select("s", _r("g", 8).alias("g"))


@query("""
with recursive e as (select n_nationkey as a, (n_nationkey * 7 + 3) % 25 as b, cast(n_nationkey % 5 + 1 as double) as cost from nation union all select n_nationkey, (n_nationkey + 1) % 25, 4e0 from nation),
r(node, cost) as (select 0, 0e0 union select e.b, r.cost + e.cost from r join e on r.node = e.a where r.cost + e.cost < 60)
select node, min(cost) as cost from r group by node
""")
def shortest_paths(spark, sf_dir):
    n = F.col("n_nationkey")
    t = table(spark, sf_dir, "nation")
    edges = t.select(n.alias("a"), ((n * 7 + 3) % 25).alias("b"), (n % 5 + 1).cast("double").alias("cost")).union(t.select(n, (n + 1) % 25, F.lit(4.0)))
    return analysis.shortest_paths(edges, 0)


@query("""
with r as (select i // 40 as row, i % 40 as col, cast((i * 7919) % 1000 as double) as value from range(1600) t(i))
select a.row, a.col, round(degrees(atan(sqrt(pow((e.value - w.value) / 2, 2) + pow((s.value - n.value) / 2, 2)))), 6) as slope
from r a join r e on e.row = a.row and e.col = a.col + 1 join r w on w.row = a.row and w.col = a.col - 1 join r s on s.row = a.row + 1 and s.col = a.col join r n on n.row = a.row - 1 and n.col = a.col
""")
def raster_slope(spark, sf_dir):
    return analysis.slope_aspect(_raster(spark)).select("row", "col", _r("slope").alias("slope"))


@query(f"select n from ({_BOXES}) where x1 >= -50 and x0 <= 20 and y1 >= -20 and y0 <= 10")
def index_query(spark, sf_dir):
    return SpatialIndex.of(_boxes(spark, sf_dir), "shape", 20.0).query(-50.0, -20.0, 20.0, 10.0).select("n")
