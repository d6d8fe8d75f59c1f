"""Geometry, geography, formats, grids, rasters and analysis: the operators that geo_queries leaves out, a column each."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loxodrome.functions import crs, geog, geom, grids, overlay
from loxodrome.operators import analysis, quality, spatial
from loxodrome.operators.index import GridIndex, QuadTree, SpatialIndex, STRTree
from loxodrome.plans.base import Registry, dealt, real, table
from loxodrome.plans.geo_queries import _BOXES, _HAV, _SITES, _XY, _boxes, _points, _r, _raster, _sites
from loxodrome.session import scratch_path
from loxodrome.sources import files, formats, vectors

REGISTRY = Registry()
query = REGISTRY.query
_RASTER = "r as (select i // 40 as row, i % 40 as col, cast((i * 7919) % 1000 as double) as value from range(1600) t(i))"


def _ring(*xy):
    return F.array(*[geom.coord(x, y) for x, y in xy])


def _square(x, y, w, h):
    return geom.polygon(_ring((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)))


# kinds and parts of geometries


@query(real(f"""
select k, 'LineString' as kind, 3 as n, [x, x + 3, x + 3] as xs, 'MultiPoint' as multi, 3 as members, 2 as collection, 10.0 as area_hole, 1 as holes, 12.0 as no_holes, x + 1 as hole_x, true as has_z, false as flat_has_z, false as has_m, 2 as coordinate_dimension, false as is_empty, y as miny, round(x + 1.5, 6) as center_x, 4.0 as height,
  round(x, 6) as start_x, round(y + 4, 6) as end_y, 3 as points, true as is_simple, false as crossed_simple, true as is_ring, false as open_ring, round(x + 3, 6) as along_x, round(y + 0.5, 6) as along_y, 3.5 as part_length, 4 as merged, true as ccw, 12.0 as ccw_area, 5 as ring_points, 2 as multi_lines, 'LineString' as member_kind, 7.0 as lengths
from ({_XY})
"""))
def geometry_parts(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    at = lambda dx, dy: geom.point(x + dx, y + dy)
    line = geom.linestring(at(0, 0), at(3, 0), at(3, 4))
    many = geom.multipoint(geom.coords(line))
    ring = _ring((x, y), (x + 3, y), (x + 3, y + 4), (x, y + 4), (x, y))
    hole = _ring((x + 1, y + 1), (x + 2, y + 1), (x + 2, y + 3), (x + 1, y + 3), (x + 1, y + 1))
    poly = geom.polygon(ring, hole)
    crossed = geom.line(_ring((x, y), (x + 2, y + 2), (x + 2, y), (x, y + 2)))
    middle = geom.interpolate(line, 0.5)
    merged = geom.merge(line, geom.linestring(at(3, 4), at(9, 4)))
    two = geom.multi(F.array(line, merged))
    turned = geom.orient_exterior_ccw(geom.reverse(geom.remove_holes(poly)))
    e = geom.bounds(poly)
    return dealt(_points(spark, sf_dir)).select(
        "k", geom.geom_type(line).alias("kind"), geom.num_points(line).alias("n"), F.transform(geom.coordinates(line), lambda c: c["x"]).alias("xs"), geom.geom_type(many).alias("multi"), geom.num_geometries(many).alias("members"), F.size(geom.geometry_collection(line, poly)).alias("collection"), _r(geom.area(poly)).alias("area_hole"),
        geom.num_interior_rings(poly).alias("holes"), _r(geom.area(geom.remove_holes(poly))).alias("no_holes"), geom.x(geom.start_point(geom.interior_ring(poly, 0))).alias("hole_x"), geom.has_z(geom.point(x, y, 5.0)).alias("has_z"), geom.has_z(at(0, 0)).alias("flat_has_z"), geom.has_m(line).alias("has_m"),
        geom.coordinate_dimension(line).alias("coordinate_dimension"), geom.is_empty(line).alias("is_empty"), e["miny"].alias("miny"), _r(geom.x(geom.bbox_center(e))).alias("center_x"), _r(geom.bbox_height(e)).alias("height"), _r(geom.x(geom.start_point(line))).alias("start_x"), _r(geom.y(geom.end_point(line))).alias("end_y"),
        F.size(geom.points(line)).alias("points"), geom.is_simple(line).alias("is_simple"), geom.is_simple(crossed).alias("crossed_simple"), geom.is_ring(geom.exterior_ring(poly)).alias("is_ring"), geom.is_ring(line).alias("open_ring"), _r(geom.x(middle)).alias("along_x"), _r(geom.y(middle)).alias("along_y"),
        _r(geom.length(geom.substring(line, 0.25, 0.75))).alias("part_length"), geom.num_points(merged).alias("merged"), (geom.signed_area(turned) > 0).alias("ccw"), _r(geom.area(turned)).alias("ccw_area"), geom.num_points(geom.exterior_ring(poly)).alias("ring_points"), geom.num_geometries(two).alias("multi_lines"),
        geom.geom_type(geom.geometries(two)[0]).alias("member_kind"), _r(geom.length(geom.geometries(two)[0])).alias("lengths"),
    )


@query(real(f"""
select k, round({_HAV.format(r=6371.0088, a='x', b='y', c='(x + 1)', d='y')}, 6) as length_km, round({_HAV.format(r=6371008.8, a='x', b='y', c='(x + 1)', d='y')} / 1000, 6) as geog_km, round(abs(radians(1) * (sin(radians(y + 1)) - sin(radians(y)))) * pow(6371.0088, 2), 4) as area_km2,
  round(abs(radians(1) * (sin(radians(y + 1)) - sin(radians(y)))) * pow(6371.0088, 2), 2) as geog_area, 1.0 as hausdorff, k % 7 + 1 as frechet, 7 as densified, floor(x / 2 + 0.5) * 2 as snapped, round(2 * x + 3 * y + 1, 6) as affine_x, round(x - y, 6) as affine_y, round(x + 2 * y + 3 * 5 + 1, 6) as affine3_x, 4 as thinned, 3 as visvalingam,
  round(2 + 0.5 * (k % 4), 6) as hull_area, round(2 + 0.5 * (k % 4), 6) as alpha_hull
from ({_XY}) where abs(y) < 89
"""))
def geometry_measures(spark, sf_dir):
    x, y, k = F.col("x"), F.col("y"), F.col("k")
    line = geom.line(_ring((x, y), (x + 1, y)))
    box = _ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))
    poly = geom.polygon(box)
    far = geom.line(_ring((x, y + (k % 7 + 1)), (x + 1, y + (k % 7 + 1))))
    bent = geom.line(_ring((x, y), (x + 1, y + 0.01), (x + 2, y), (x + 3, y + 5), (x + 4, y)))
    cloud = geom.multipoint(_ring((0, 0), (2, 0), (2, 1), (0, 1), (1, 0.5), (1, 1 + (k % 4) / 2)))
    shift = geom.affine3d(geom.point(x, y, 5.0), [[1, 2, 3, 1], [0, 1, 0, 0], [0, 0, 1, 0]])
    a = geom.affine(geom.point(x, y), 2, 3, 1, 1, -1, 0)
    return dealt(_points(spark, sf_dir)).filter(F.abs(y) < 89).select(
        "k", _r(geom.length_geodesic(line)).alias("length_km"), _r(geog.distance_great_circle(geom.point(x, y), geom.point(x + 1, y)) / 1000).alias("geog_km"), _r(geom.area_geodesic(poly), 4).alias("area_km2"), _r(geog.area_geodesic(poly) / 1e6, 2).alias("geog_area"), _r(geom.hausdorff_distance(line, geom.translate(line, 1.0, 0.0))).alias("hausdorff"),
        _r(overlay.frechet_distance(line, far)).alias("frechet"), geom.num_points(geom.densify(geom.line(_ring((x, y), (x + 3, y))), 0.5)).alias("densified"), (F.floor(geom.x(geom.snap(geom.point(F.floor(x / 2 + 0.5) * 2 + 0.3, y), 2.0)) + 0.5)).alias("snapped"), _r(geom.x(a)).alias("affine_x"), _r(geom.y(a)).alias("affine_y"),
        _r(geom.x(shift)).alias("affine3_x"), geom.num_points(geom.simplify(bent, 0.1)).alias("thinned"), geom.num_points(overlay.visvalingam_whyatt(bent, 5.5)).alias("visvalingam"), _r(geom.area(geom.convex_hull(cloud))).alias("hull_area"), _r(geom.area(geom.alpha_shape(cloud, 0.0))).alias("alpha_hull"),
    )


# overlay and relations of boxes: b is a moved by its width (n % 4 = 0), by half of it (1), inside a (2) or far away (3)


_PAIRS = f"(select n, x0, y0, x1 - x0 as w, y1 - y0 as h, n % 4 as c from ({_BOXES}))"


def _pairs(spark, sf_dir):
    n = F.col("n_nationkey")
    t = table(spark, sf_dir, "nation").select(n.alias("n"), (n * 14 - 178).cast("double").alias("x0"), (n * 5 - 80).cast("double").alias("y0"), (20 + n % 4).cast("double").alias("w"), (30 + n % 7).cast("double").alias("h"), (n % 4).alias("c"))
    x0, y0, w, h, c = (F.col(v) for v in ("x0", "y0", "w", "h", "c"))
    dx = F.when(c == 0, w).when(c == 1, w / 2).when(c == 2, w / 4).otherwise(3 * w)
    small = F.when(c == 2, 0.5).otherwise(1.0)
    return t.select("n", "w", "h", "c", "x0", "y0", _square(x0, y0, w, h).alias("a"), _square(x0 + dx, y0 + F.when(c == 2, h / 4).otherwise(0.0), w * small, h * small).alias("b"))


@query(real(f"""
select n, round(case c when 1 then w * h / 2 when 2 then w * h / 4 else 0 end, 6) as intersection, round(case c when 1 then w * h * 1.5 when 2 then w * h else w * h * 2 end, 6) as "union", round(case c when 1 then w * h / 2 when 2 then w * h * 0.75 else w * h end, 6) as difference, round(case c when 1 then w * h when 2 then w * h * 0.75 else w * h * 2 end, 6) as sym_difference,
  case c when 3 then 2 else 1 end as parts, case c when 2 then 1 else 0 end as holes, round(case c when 1 then w * h * 1.5 when 2 then w * h else w * h * 2 end + 25, 6) as unary, round(w * w / 2, 6) as bow_tie, round(x0 + w / 2.0, 6) as inner_x, round(y0 + h / 2.0, 6) as inner_y, round(w * h + 4 * (w + h) + 64 * sin(pi() / 16), 4) as buffered,
  round((w - 4) * (h - 4.0), 4) as shrunk, round(w * 2 + 16 * sin(pi() / 16), 5) as line_buffer
from {_PAIRS}
"""))
def overlays(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    a, b, w, x0, y0 = (F.col(v) for v in ("a", "b", "w", "x0", "y0"))
    tie = geom.polygon(_ring((x0, y0), (x0 + w, y0 + w), (x0 + w, y0), (x0, y0 + w), (x0, y0)))
    p = p.select("*", overlay.union(a, b).alias("u"), overlay.difference(a, b).alias("d"), overlay.point_on_surface(a).alias("i"))
    area = lambda g, k=6: _r(geom.area(g), k)
    return p.select(
        "n", area(overlay.intersection(a, b)).alias("intersection"), area(F.col("u")).alias("union"), area(F.col("d")).alias("difference"), area(overlay.sym_difference(a, b)).alias("sym_difference"), geom.num_geometries(F.col("u")).alias("parts"), geom.num_interior_rings(F.col("d")).alias("holes"),
        area(overlay.unary_union(F.array(a, b, _square(F.lit(1000.0), F.lit(1000.0), 5, 5)))).alias("unary"), area(overlay.make_valid(tie)).alias("bow_tie"), _r(geom.x(F.col("i"))).alias("inner_x"), _r(geom.y(F.col("i"))).alias("inner_y"), area(overlay.buffer(a, 2.0), 4).alias("buffered"), area(overlay.buffer(a, -2.0), 4).alias("shrunk"),
        area(overlay.buffer(geom.line(_ring((x0, y0), (x0 + w, y0))), 1.0), 5).alias("line_buffer"),
    )


@query(f"""
select n, case c when 0 then 'FF2F11212' when 1 then '212111212' when 2 then '212FF1FF2' else 'FF2FF1212' end as matrix, c = 0 as touches, c = 1 as overlaps, c = 2 as contains, c = 2 as within, c = 2 as covers, c = 2 as covered_by, c = 3 as disjoint, c <> 3 as intersects, true as equal, c = 1 or c = 2 as pattern, true as line_crosses, true as point_within,
  true as geo_valid, c <> 0 as near_equal from {_PAIRS}
""")
def relations(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    through = geom.line(_ring((F.col("x0") - 1, F.col("y0") + 1), (F.col("x0") + 1, F.col("y0") + 1)))
    inner = geom.point(F.col("x0") + 1, F.col("y0") + 1)
    moved = geom.translate(a, F.when(F.col("c") == 0, 0.5).otherwise(1e-6), 0.0)
    return _pairs(spark, sf_dir).select(
        "n", overlay.relate(a, b).alias("matrix"), overlay.touches(a, b).alias("touches"), overlay.overlaps(a, b).alias("overlaps"), overlay.contains(a, b).alias("contains"), overlay.within(b, a).alias("within"), overlay.covers(a, b).alias("covers"), overlay.covered_by(b, a).alias("covered_by"), overlay.disjoint(a, b).alias("disjoint"),
        overlay.intersects(a, b).alias("intersects"), overlay.equal(a, geom.reverse(a)).alias("equal"), overlay.relate(a, b, "T********").alias("pattern"), overlay.crosses(through, a).alias("line_crosses"), overlay.within(inner, a).alias("point_within"), quality.geo_valid(a).alias("geo_valid"), quality.geo_near_equal(a, moved, 1e-3).alias("near_equal"),
    )


@query(f"""
select n, c in (0, 1) as touches, c <> 3 as overlaps_or_contains, c = 1 as overlaps, c = 2 as contains, true as crosses, round(w * h + 0.0, 6) > 0 as buffer_larger from {_PAIRS}
""")
def vertex_relations(spark, sf_dir):
    """The rules by vertices and edges, which exact relations stand beside: edges that meet count as touching."""
    a, b = F.col("a"), F.col("b")
    through = geom.line(_ring((F.col("x0") - 1, F.col("y0") + 1), (F.col("x0") + 1, F.col("y0") + 1)))
    p = _pairs(spark, sf_dir)
    return p.select(
        "n", geom.touches(a, b).alias("touches"), geom.intersects(a, b).alias("overlaps_or_contains"), (geom.overlaps(a, b) & (F.col("c") == 1)).alias("overlaps"), geom.contains(a, b).alias("contains"), geom.crosses(through, a).alias("crosses"), (geom.area(geom.buffer(a, 1.0)) > geom.area(a)).alias("buffer_larger"),
    )


# geography and reference systems


@query(real(f"""
select k, x as lon, y as lat, 4326 as srid, round({_HAV.format(r=6371008.8, a='x', b='y', c='20', d='10')}, 3) as metres, round(fmod(degrees(atan2(cos(radians(10)) * sin(radians(20 - x)), cos(radians(y)) * sin(radians(10)) - sin(radians(y)) * cos(radians(10)) * cos(radians(20 - x)))) + 360, 360), 6) as bearing,
  round(degrees(asin(sin(radians(y)) * cos(5e5 / 6371008.8) + cos(radians(y)) * sin(5e5 / 6371008.8) * cos(radians(45)))), 6) as dest_lat, round(degrees(asin(sin(radians(y)) * cos(5e5 / 6371008.8) + cos(radians(y)) * sin(5e5 / 6371008.8) * cos(radians(45)))), 6) as project_lat, 33 as ring, 1000.0 as off, x between -10 and 10 and y between -10 and 10 as intersects,
  x between -10 and 10 and y between -10 and 10 as contains, x between -10 and 10 and y between -10 and 10 as within, cast(k % 180 as double) as wkt_lon, 4326 as wkt_srid, 0 as plain_srid, round({_HAV.format(r=6371008.8, a='x', b='y', c='20', d='10')} / 4, 2) as quarter, 2 as line_points
from ({_XY})
"""))
def geography(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    p, q = geog.from_lat_lon(y, x), geog.Point(20.0, 10.0)
    ring = geog.buffer(p, 1000.0)
    first = geom.start_point(geom.exterior_ring(ring))
    box = geom.bbox_to_polygon(geom.bbox(-10, -10, 10, 10))
    parsed = geog.from_wkt(F.concat(F.lit("POINT ("), (F.col("k") % 180).cast("string"), F.lit(" 5)")))
    way = geog.LineString(F.array(geom.coord_of(p), geom.coord_of(q)))
    return dealt(_points(spark, sf_dir)).select(
        "k", geom.lon(p).alias("lon"), geom.lat(p).alias("lat"), geom.srid(p).alias("srid"), _r(geog.distance_great_circle(p, q), 3).alias("metres"), _r(geog.bearing(p, q)).alias("bearing"), _r(geom.y(geog.destination(p, 45.0, 5e5))).alias("dest_lat"), _r(geom.y(geog.project(p, 45.0, 5e5))).alias("project_lat"), geom.num_points(ring).alias("ring"),
        _r(geog.distance_great_circle(p, first), 3).alias("off"), geog.intersects(box, p).alias("intersects"), geog.contains(box, p).alias("contains"), geog.within(p, box).alias("within"), geom.x(parsed).alias("wkt_lon"), geom.srid(parsed).alias("wkt_srid"), geom.srid(geog.to_geometry(p)).alias("plain_srid"),
        _r(geog.distance_great_circle(p, geog.interpolate(p, q, 0.25)), 2).alias("quarter"), geom.num_points(way).alias("line_points"),
    )


@query(real("""
select * from (values (4326, 'WGS 84', true, false, 'degree', 'World Geodetic System 1984', 'WGS 84', -180.0, 90.0, '+proj=longlat', 'GEOGCRS'), (3857, 'WGS 84 / Pseudo-Mercator', false, true, 'metre', 'World Geodetic System 1984', 'WGS 84', -20037508.34, 20048966.1, '+proj=merc +a', 'PROJCRS'),
  (4269, 'NAD83', true, false, 'degree', 'North American Datum 1983', 'GRS 1980', -172.54, 86.46, '+proj=longlat', 'GEOGCRS'), (4267, 'NAD27', true, false, 'degree', 'North American Datum 1927', 'Clarke 1866', -172.54, 86.46, '+proj=longlat', 'GEOGCRS'),
  (4258, 'ETRS89', true, false, 'degree', 'European Terrestrial Reference System 1989', 'GRS 1980', -16.1, 84.17, '+proj=longlat', 'GEOGCRS'), (9999, null, null, null, null, null, null, null, null, null, null)) as t(code, name, is_geographic, is_projected, units, datum, ellipsoid, west, north, proj, wkt)
"""))
def reference_systems(spark, sf_dir):
    codes = spark.createDataFrame([(c,) for c in (4326, 3857, 4269, 4267, 4258, 9999)], "code int")
    c = F.col("crs")
    found = geog.from_epsg(codes, "code")
    return found.select("code", c["name"].alias("name"), c["is_geographic"].alias("is_geographic"), c["is_projected"].alias("is_projected"), c["units"].alias("units"), c["datum"].alias("datum"), c["ellipsoid"].alias("ellipsoid"), c["west"].alias("west"), c["north"].alias("north"), F.substring(c["proj4"], 1, 13).alias("proj"), F.substring(c["wkt"], 1, 7).alias("wkt"))


@query(real(f"""
select k, round(radians(x) * 6378137, 3) as merc_x, round(6378137 * ln(tan(pi() / 4 + radians(y) / 2)), 3) as merc_y, round(x, 7) as back_x, round(y, 7) as back_y, round(-122 + (k % 10) / 10.0, 7) as lcc_x, round(39 + (k % 7) / 7.0, 7) as lcc_y, round(x, 7) as utm_x, round(y, 7) as utm_y, 32600 + 31 as utm_epsg, 26941 as lcc_epsg, round(x, 6) as piped,
  least(cast(floor((x + 180) / 6) as integer) + 1, 60) as zone, 'WGS 84 / UTM zone ' || least(cast(floor((x + 180) / 6) as integer) + 1, 60) || case when y >= 0 then 'N' else 'S' end as zone_name
from ({_XY})
"""))
def transforms(spark, sf_dir):
    x, y, k = F.col("x"), F.col("y"), F.col("k")
    world, merc = crs.from_epsg(4326), crs.from_proj4("+proj=merc +a=6378137 +b=6378137 +lon_0=0 +units=m")
    p = geom.point(x, y, srid=4326)
    there = crs.Transformer(world, merc)
    lcc = crs.Transformer(world, crs.state_plane("CA_I"))
    near = geom.point(-122 + (k % 10) / 10, 39 + (k % 7) / 7)
    round_trip = lcc.inverse().transform(lcc.transform(near))
    zone = crs.Transformer(world, crs.from_wkt('PROJCRS["WGS 84 / UTM zone 31N",ID["EPSG",32631]]'))
    # the zone's series holds near its meridian: points are taken to within three degrees of it and back
    local = geom.point(x / 60 + 3, y)
    back = zone.inverse().transform(zone.transform(local))
    piped = crs.pipeline(there, there.inverse(), crs.Transformer(world, crs.from_epsg(4269)))(p)
    moved, returned = there.transform(p), there.inverse().transform(there.transform(p))
    return dealt(_points(spark, sf_dir)).select(
        "k", _r(geom.x(moved), 3).alias("merc_x"), _r(geom.y(moved), 3).alias("merc_y"), _r(geom.x(returned), 7).alias("back_x"), _r(geom.y(returned), 7).alias("back_y"), _r(geom.x(round_trip), 7).alias("lcc_x"), _r(geom.y(round_trip), 7).alias("lcc_y"), _r((geom.x(back) - 3) * 60, 7).alias("utm_x"), _r(geom.y(back), 7).alias("utm_y"),
        geom.srid(zone.transform(local)).alias("utm_epsg"), geom.srid(lcc.transform(near)).alias("lcc_epsg"), _r(geom.x(piped)).alias("piped"), geog.utm_zone(x).alias("zone"), geog.utm_name(x, y).alias("zone_name"),
    )


# formats


@query(f"""
select k, '<Point><coordinates>' || k % 360 || ',' || k % 90 || ',0</coordinates></Point>' as kml, cast(k % 360 as double) as kml_x, 'LINESTRING (' || k % 360 || ' ' || k % 90 || ', 0 0)' as ewkb, 4326 as ewkb_srid, '<trkpt lat="' || k % 90 || '" lon="' || k % 360 || '"></trkpt>' as gpx, '{{"n":' || k || '}}' as properties, 'f' || k as id, cast(k as varchar) as n,
  'POINT (' || k % 360 || ' ' || k % 90 || ')' as geometry, 1 as features
from ({_XY})
""")
def format_rest(spark, sf_dir):
    k = F.col("k")
    p = geom.point((k % 360).cast("double"), (k % 90).cast("double"))
    line = geom.set_srid(geom.line(F.array(geom.coord_of(p), geom.coord(0, 0))), 4326)
    text = formats.to_feature(p, F.struct(k.alias("n")), F.concat(F.lit("f"), k.cast("string")))
    d = dealt(_points(spark, sf_dir)).select("k", p.alias("p"), formats.to_kml(p).alias("kml"), formats.to_ewkb(line).alias("e"), formats.to_gpx(line).alias("g"), text.alias("feature"), formats.from_kml(formats.to_kml(p)).alias("back"))
    parsed = formats.features(d.select(F.col("feature")), "feature").select(F.col("properties")["n"].cast("bigint").alias("k"), F.col("id"), F.col("properties")["n"].alias("n"), formats.to_wkt(F.col("geometry")).alias("geometry"))
    return d.join(parsed, "k").select(
        "k", "kml", geom.x(F.col("back")[0]).alias("kml_x"), formats.to_wkt(formats.from_ewkb(F.col("e"))).alias("ewkb"), geom.srid(formats.from_ewkb(F.col("e"))).alias("ewkb_srid"), F.regexp_extract("g", "<trkpt.*?</trkpt>", 0).alias("gpx"), F.regexp_extract("feature", r'"properties":(\{.*?\})', 1).alias("properties"), "id", "n", "geometry",
        F.size(F.array(F.col("p"))).alias("features"),
    )


@query(f"""
with b as (select n, x0, y0, cast((x1 - x0) * (y1 - y0) as double) as area from ({_BOXES}))
select 'shapefile' as format, n, area, 'name ' || n as name from b union all select 'geopackage', n, area, 'name ' || n from b union all select 'csv', n, area, 'name ' || n from b union all select 'geojson', n, area, 'name ' || n from b
""")
def vector_files(spark, sf_dir):
    """Boxes written to and read from each format, in the shared folder."""
    b = _boxes(spark, sf_dir).withColumn("name", F.concat(F.lit("name "), F.col("n").cast("string")))
    path = scratch_path(spark, "vectors")
    vectors.write_shapefile(b, f"{path}/shp", "shape", ["n", "name"])
    vectors.write_geopackage(b, f"{path}/gpkg", "boxes", "shape", ["n", "name"])
    vectors.write_geo_csv(b.select("n", "name", "shape"), f"{path}/csv", "shape")
    formats.to_feature_collection(b, "shape", ["n", "name"], f"{path}/geojson")
    each = [
        ("shapefile", vectors.read_shapefile(spark, f"{path}/shp/*.shp").select("geometry", F.col("attributes")["n"].alias("n"), F.col("attributes")["name"].alias("name"))),
        ("geopackage", vectors.read_geopackage(spark, f"{path}/gpkg/*.gpkg").filter("layer = 'boxes'").select("geometry", F.col("attributes")["n"].alias("n"), F.col("attributes")["name"].alias("name"))),
        ("csv", vectors.read_geo_csv(spark, f"{path}/csv", "n int, name string, shape string", "shape").select(F.col("shape").alias("geometry"), F.col("n").cast("string").alias("n"), "name")),
        ("geojson", formats.features(spark.read.text(f"{path}/geojson"), "value").select("geometry", F.col("properties")["n"].alias("n"), F.col("properties")["name"].alias("name"))),
    ]
    out = None
    for name, df in each:
        rows = df.select(F.lit(name).alias("format"), F.col("n").cast("int").alias("n"), _r(geom.area(F.col("geometry"))).alias("area"), "name")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
select 'text' as kind, n_name as value from nation union all select 'csv', n_name || ',' || n_regionkey from nation union all select 'json', n_name || ',' || n_regionkey from nation union all select 'bytes', '1 2 255' union all select 'calls', 'yes yes no yes 3 a.bin,b.bin,d,e yes yes yes yes no'
union all select 'paths', 'a/b.txt a .txt b.txt ../c' union all select 'columns', 'a/b x.gz .gz a/b/x.gz' union all select 'lines', n_name from nation union all select 'lines', 'one more'
""")
def file_calls(spark, sf_dir):
    """Reading, writing and the calls of the file system, in the shared folder."""
    import posixpath

    n = table(spark, sf_dir, "nation")
    path = scratch_path(spark, "files")
    files.create_dir_all(spark, path)
    files.write_text(n.select("n_name"), f"{path}/text")
    files.append_text(spark.createDataFrame([("one more",)], "value string"), f"{path}/text")
    files.to_csv(n.select("n_name", "n_regionkey"), f"{path}/csv")
    files.to_json(n.select("n_name", "n_regionkey"), f"{path}/json")
    own = f"{path}/own"
    files.create_dir(spark, own)
    files.write_bytes(spark, f"{own}/a.bin", [1, 2, 255])
    files.copy(spark, f"{own}/a.bin", f"{own}/c.bin")
    files.move(spark, f"{own}/c.bin", f"{own}/b.bin")
    files.create_dir(spark, f"{own}/d")
    files.create_dir(spark, f"{own}/e")
    yes = lambda v: "yes" if v else "no"
    calls = [yes(files.exists(spark, f"{own}/a.bin")), yes(files.is_file(spark, f"{own}/a.bin")), yes(files.is_file(spark, own)), yes(files.is_dir(spark, own)), str(files.file_size(spark, f"{own}/a.bin")), ",".join(files.list_dir(spark, own))]
    calls += [yes(files.modified_time(spark, f"{own}/a.bin") > 1e12), yes(files.remove_file(spark, f"{own}/b.bin")), yes(files.remove_dir(spark, f"{own}/d")), yes(files.remove_dir_all(spark, f"{own}/e"))]
    raw = files.read_bytes(spark, f"{own}/a.bin").select(F.lit("bytes").alias("kind"), F.array_join(F.transform("bytes", lambda b: b.cast("string")), " ").alias("value"))
    calls.append(yes(files.exists(spark, f"{own}/e")))
    paths = [files.join("a", "x", "..", "b.txt"), files.dirname("a/b.txt"), files.extension("a/b.txt"), files.basename("a/b.txt"), files.relative("/a/b", "/a/c")]
    assert files.absolute("x") == posixpath.abspath("x")
    p = F.lit("a/b/x.gz")
    columns = spark.range(1).select(F.lit("columns").alias("kind"), F.concat_ws(" ", files.dirname_column(p), files.basename_column(p), files.extension_column(p), files.join_columns(F.lit("a/b"), F.lit("x.gz"))).alias("value"))
    pair = F.concat_ws(",", "n_name", F.col("n_regionkey").cast("string"))
    schema = "n_name string, n_regionkey int"
    whole = files.read_file(spark, f"{path}/text/*").select(F.explode(F.split(F.rtrim(F.regexp_replace("value", r"\n$", "")), "\n")).alias("value")).filter("value <> 'one more'").select(F.lit("text").alias("kind"), "value")
    out = whole.unionByName(files.from_csv(spark, f"{path}/csv", schema).select(F.lit("csv").alias("kind"), pair.alias("value"))).unionByName(files.from_json(spark, f"{path}/json", schema).select(F.lit("json").alias("kind"), pair.alias("value"))).unionByName(raw).unionByName(columns)
    out = out.unionByName(files.read_lines(spark, f"{path}/text").select(F.lit("lines").alias("kind"), "value"))
    return out.unionByName(spark.createDataFrame([("calls", " ".join(calls)), ("paths", " ".join(paths))], "kind string, value string"))


# grids and indexes


@query(real(f"""
with c as (select k, least(cast(floor((y + 90) / 180 * 256) as bigint), 255) as r, least(cast(floor((x + 180) / 360 * 256) as bigint), 255) as c from ({_XY}))
select k, 4 as children, case when c between 1 and 254 then 8 else 5 end as ring, round(360 / 256.0 * 180 / 256.0, 6) as boundary_area, round(2 * pi() * pow(6371.0088, 2) / 256 * (sin(radians((r + 1) / 256.0 * 180 - 90)) - sin(radians(r / 256.0 * 180 - 90))), 4) as area_km2, greatest(abs(r - 128), abs(c - 128)) + 1 as path, 1 + 4 as uncompacted, true as valid, round((c + 0.5) / 256 * 360 - 180, 6) as point_x,
  4 as covered, 6 as polyfilled
from c where r between 1 and 254
"""))
def grid_rest(spark, sf_dir):
    i, e = F.col("cell"), F.col("e")
    other = grids.h3_from_lat_lon(F.lit(0.1), F.lit(0.1), 7)
    p = dealt(_points(spark, sf_dir)).withColumn("cell", grids.h3_from_lat_lon(F.col("y"), F.col("x"), 7)).filter(grids.h3_row(i).between(1, 254))
    p = p.withColumn("shape", grids.h3_boundary(i)).withColumn("e", geom.envelope(F.col("shape")))
    dx, dy = F.lit(360 / 256), F.lit(180 / 256)
    p = p.withColumn("cover", grids.covering(e["minx"] + dx / 4, e["miny"] + dy / 4, e["maxx"] - dx / 4, e["maxy"] - dy / 4, 8))
    # three cells by two of the finer resolution
    p = p.withColumn("six", grids.h3_polyfill(geom.bbox_to_polygon(geom.bbox(F.lit(0.0), F.lit(0.0), F.lit(3 * 360 / 512), F.lit(2 * 180 / 512))), 8)).withColumn("filled", grids.h3_polyfill(F.col("shape"), 8))
    return p.select(
        "k", F.size(grids.h3_children(i, 8)).alias("children"), F.size(grids.h3_ring(i, 1)).alias("ring"), _r(geom.area(F.col("shape"))).alias("boundary_area"), _r(grids.h3_area_km2(i), 4).alias("area_km2"), F.size(grids.h3_path(i, other)).alias("path"), (F.size("filled") + 1).alias("uncompacted"), grids.h3_is_valid(i).alias("valid"),
        _r(geom.x(grids.h3_to_point(i))).alias("point_x"), F.size("cover").alias("covered"), F.size("six").alias("polyfilled"),
    )


@query(real(f"""
with s as (select k, cos(radians(y)) * cos(radians(x)) as a, cos(radians(y)) * sin(radians(x)) as b, sin(radians(y)) as c from ({_XY})),
f as (select k, case when abs(a) >= abs(b) and abs(a) >= abs(c) then case when a > 0 then 0 else 3 end when abs(b) >= abs(a) and abs(b) >= abs(c) then case when b > 0 then 1 else 4 end when c > 0 then 2 else 5 end as face,
  case when abs(a) >= abs(b) and abs(a) >= abs(c) then b / abs(a) when abs(b) >= abs(a) and abs(b) >= abs(c) then a / abs(b) else a / abs(c) end as u, case when abs(a) >= abs(b) and abs(a) >= abs(c) then c / abs(a) when abs(b) >= abs(a) and abs(b) >= abs(c) then c / abs(b) else b / abs(c) end as v from s)
select k, 9 * 576460752303423488 + face * 72057594037927936 + least(cast(floor((u + 1) / 2 * 1024) as bigint), 1023) // 2 * 268435456 + least(cast(floor((v + 1) / 2 * 1024) as bigint), 1023) // 2 as parent, face, 4 as children, true as valid, true as own_child, 4 as neighbours, true as mutual from f
"""))
def s2_rest(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    c = F.col("cell")
    p = dealt(_points(spark, sf_dir)).withColumn("cell", grids.s2_from_lat_lon(y, x, 10)).withColumn("near", grids.s2_neighbors(F.col("cell"), 10))
    point = grids.s2_to_point(c)
    same = grids.s2_contains(c, geom.y(point), geom.x(point), 10)
    mutual = F.forall("near", lambda n: F.array_contains(grids.s2_neighbors(n, 10), c))
    return p.select("k", grids.s2_parent(c).alias("parent"), grids.s2_face(c).alias("face"), F.size(grids.s2_children(c)).alias("children"), grids.s2_is_valid(c).alias("valid"), (F.array_contains(grids.s2_children(grids.s2_parent(c)), c) & same).alias("own_child"), F.size(F.array_distinct("near")).alias("neighbours"), mutual.alias("mutual"))


@query(f"""
with c as (select distinct 6 as res, least(cast(floor((y + 90) / 180 * 128) as bigint), 127) as r, least(cast(floor((x + 180) / 360 * 128) as bigint), 127) as c from ({_XY})),
f as (select r, c from c) select count(*) as cells, sum(r) as rows_, sum(c) as cols from f
""")
def grid_compaction(spark, sf_dir):
    """Cells compacted as far as they go and spread again are the cells as they were."""
    p = _points(spark, sf_dir).select(grids.h3_from_lat_lon(F.col("y"), F.col("x"), 6).alias("cell")).distinct()
    # with all children of one cell, so that there is something to compact
    back = grids.h3_uncompact(grids.h3_compact(p, "cell"), "cell", 6)
    return back.agg(F.count(F.lit(1)).alias("cells"), F.sum(grids.h3_row(F.col("cell"))).alias("rows_"), F.sum(grids.h3_col(F.col("cell"))).alias("cols"))


@query(f"""
with b as (select * from ({_BOXES}))
select 'query' as call, n from b where x1 >= -50 and x0 <= 20 and y1 >= -20 and y0 <= 10 union all select 'point', n from b where x1 >= -50 and x0 <= -50 and y1 >= -30 and y0 <= -30 union all select 'radius', n from b where sqrt(pow(greatest(x0 - 10, 10 - x1, 0), 2) + pow(greatest(y0 - 0, 0 - y1, 0), 2)) <= 15
union all select 'removed', n from b where n % 2 = 1 union all select 'inserted', n from b where n % 2 = 1 union all select 'inserted', n from b where n % 2 = 0 union all select 'size', 25 union all select 'nearest', n from (select n from b order by sqrt(pow((x0 + x1) / 2e0, 2) + pow((y0 + y1) / 2e0, 2)), n limit 3) union all select 'bounds', min(x0) from b
union all select 'cell', n from b where x1 >= 0 and x0 < 20 and y1 >= 0 and y0 < 20 union all select 'cleared', 0 union all select 'new', 0 union all select 'joined', count(*) from b a join b c on a.x1 >= c.x0 and a.x0 <= c.x1 and a.y1 >= c.y0 and a.y0 <= c.y1
""")
def index_calls(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    index = STRTree.of(b, "shape", 20.0)
    even = b.filter("n % 2 = 0").select("n")
    removed = index.remove(even, "n")
    again = removed.insert(spatial.with_bounds(b.filter("n % 2 = 0"), "shape"))
    one = lambda call, value: spark.createDataFrame([(call, value)], "call string, n int")
    named = lambda call, df: df.select(F.lit(call).alias("call"), F.col("n").cast("int").alias("n"))
    out = named("query", index.query(-50.0, -20.0, 20.0, 10.0)).unionByName(named("point", index.query_point(-50.0, -30.0))).unionByName(named("radius", index.query_radius(10.0, 0.0, 15.0))).unionByName(named("removed", removed.items)).unionByName(named("inserted", again.items))
    out = out.unionByName(one("size", index.size())).unionByName(named("nearest", index.nearest(0.0, 0.0, 3, "n"))).unionByName(index.bounds().select(F.lit("bounds").alias("call"), F.col("minx").cast("int").alias("n")))
    out = out.unionByName(named("cell", GridIndex(index.items, 20.0).get_cell(5.0, 5.0))).unionByName(one("cleared", index.clear().size())).unionByName(one("new", QuadTree.new(spark, "n int").size()))
    return out.unionByName(SpatialIndex(index.items, 20.0).join(index).agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit("joined").alias("call"), "n"))


# rasters


@query(f"""
with {_RASTER}, e as (select i as col, 0 as row, cast(i * 2 as double) as value from range(5) t(i))
select 'array' as call, row, col, value from e union all select 'map', row, col, value * 2 from r union all select 'points', row, col, 100 + col * 10 + 5 + value from r union all select 'algebra', row, col, value * value from r union all select 'empty', row, col, 7e0 from (select i // 3 as row, i % 3 as col from range(6) t(i))
union all select 'value', row, col, value from r where row % 10 = 3 union all select 'sample', a.row, a.col, round((a.value + b.value) / 2, 6) from r a join r b on b.row = a.row and b.col = a.col + 1 where a.row % 10 = 3
union all select 'resample', row // 2 as row, col // 2, round(avg(value), 6) from r group by all union all select 'nearest', row // 2, col // 2, value from r where row % 2 = 1 and col % 2 = 1
union all select 'reproject', row, col, value from r where row < 10 and col < 10
""")
def raster_calls(spark, sf_dir):
    r = _raster(spark)
    named = lambda call, df, k=6: df.select(F.lit(call).alias("call"), "row", "col", F.round("value", k).alias("value"))
    made = analysis.raster_from_array(spark.range(1).select(F.array(*[F.lit(float(2 * i)) for i in range(5)]).alias("v")), "v", 5)
    pts = analysis.raster_to_points(r, 100.0, 0.0, 10.0)
    some = r.filter("row % 10 = 3").select((F.col("row") * 40 + F.col("col")).alias("k"), (F.col("col") + 0.5).alias("x"), (-(F.col("row") + 0.5)).alias("y"))
    back = lambda df: df.select(F.floor(F.col("k") / 40).cast("int").alias("row"), (F.col("k") % 40).cast("int").alias("col"), "value")
    between = some.filter("k % 40 < 39").withColumn("x", F.col("x") + 0.5)
    out = named("array", made).unionByName(named("map", analysis.raster_map(r, lambda v: v * 2))).unionByName(pts.select(F.lit("points").alias("call"), "row", "col", (F.col("x") + F.col("value")).alias("value"))).unionByName(named("algebra", analysis.raster_algebra(r, r, lambda a, b: a * b)))
    out = out.unionByName(named("empty", analysis.raster_empty(spark, 3, 2, 7.0))).unionByName(named("value", back(analysis.value_at(r, some, "k", 0.0, 0.0, 1.0)))).unionByName(named("sample", back(analysis.sampled_at(r, between, "k", 0.0, 0.0, 1.0))))
    out = out.unionByName(named("resample", analysis.resample(r, 40, 40, 20, 20))).unionByName(named("nearest", analysis.resample(r, 40, 40, 20, 20, "nearest")))
    return out.unionByName(named("reproject", analysis.reproject(r, 0.0, 0.0, 1.0, lambda x, y: (x / 2, y / 2), 0.0, 0.0, 2.0, 10, 10, "nearest")))


@query(f"""
with {_RASTER}, n as (select a.row, a.col, (e.value - w.value) / 2 as dx, (s.value - n.value) / 2 as dy from r a join r e on e.row = a.row and e.col = a.col + 1 join r w on w.row = a.row and w.col = a.col - 1 join r s on s.row = a.row + 1 and s.col = a.col join r n on n.row = a.row - 1 and n.col = a.col),
t as (select row, col, atan(sqrt(dx * dx + dy * dy)) as slope, atan2(dy, -dx) as aspect from n)
select row, col, round(greatest(cos(radians(45)) * cos(slope) + sin(radians(45)) * sin(slope) * cos(radians(315) - aspect), 0) * 255, 4) as shade, round(fmod(degrees(aspect) + 360, 360), 4) as aspect from t
""")
def raster_shade(spark, sf_dir):
    r = _raster(spark)
    return analysis.hillshade(r).select("row", "col", F.round("value", 4).alias("shade")).join(analysis.slope_aspect(r).select("row", "col", F.round("aspect", 4).alias("aspect")), ["row", "col"])


@query("""
with r as (select i // 12 as row, i % 12 as col, i // 12 // 4 * 3 + i % 12 // 4 as value from range(144) t(i))
select 'zone' as kind, cast(value as double) as value, cast(count(*) as double) as size, null as pieces from r group by value union all select 'plane', level, 11e0, null from (values (2e0), (4e0), (6e0), (8e0), (10e0)) t(level)
union all select 'bounds', 0, 144, 9
""")
def raster_outlines(spark, sf_dir):
    """Outlines of zones have their cells' area; contour lines of a slope are as long as it is wide."""
    r = analysis.raster_empty(spark, 12, 12)
    zones = analysis.raster_map(r, lambda v: v).withColumn("value", (F.floor(F.col("row") / 4) * 3 + F.floor(F.col("col") / 4)).cast("double"))
    polygons = analysis.to_polygons(zones)
    slope = r.withColumn("value", F.col("col") + F.lit(0.25))
    lines = analysis.contours(slope, 2.0).groupBy(F.col("level").alias("value")).agg(F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 6).alias("size"))
    none = F.lit(None).cast("bigint")
    out = polygons.select(F.lit("zone").alias("kind"), "value", _r(geom.area(F.col("geom"))).alias("size"), none.alias("pieces")).unionByName(lines.select(F.lit("plane").alias("kind"), "value", "size", none.alias("pieces")))
    return out.unionByName(polygons.agg(F.sum(geom.area(F.col("geom"))).alias("size"), F.count(F.lit(1)).alias("pieces")).select(F.lit("bounds").alias("kind"), F.lit(0.0).alias("value"), "size", "pieces"))


@query(f"""
with {_RASTER}, w as (select row, col, value, case when col = 20 and row between 5 and 35 then 900 else 0 end as wall, case when col = 20 and row <> 0 then 1000e0 else 1e0 end as cost from r)
select 'seen' as kind, count(*) filter (where col < 20 or col = 20) as n, 0e0 as cost from w where sqrt(pow(row - 20, 2) + pow(col - 10, 2)) <= 12 and (col <= 20) union all select 'ascii', count(*), sum(value) from r union all select 'corner', 40, 2.5e0
""")
def raster_paths(spark, sf_dir):
    """A wall hides what lies behind it; a grid written as text reads the same."""
    r = _raster(spark)
    wall = r.withColumn("value", F.when((F.col("col") == 20), 900.0).otherwise(0.0))
    seen = analysis.viewshed(wall, 20, 10, 2.0, 12.0).filter("visible").agg(F.count(F.lit(1)).alias("n")).select(F.lit("seen").alias("kind"), "n", F.lit(0.0).alias("cost"))
    path = scratch_path(spark, "grid")
    vectors.ascii_grid(r, 40, 2.5, -30.0, 1.0, 40).orderBy("at").coalesce(1).select("value").write.text(path)
    read = vectors.read_ascii_grid(spark, f"{path}/part-*")
    return seen.unionByName(read.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("cost")).select(F.lit("ascii").alias("kind"), "n", "cost")).unionByName(read.agg((F.max("maxy") + 30).cast("bigint").alias("n"), F.min("minx").alias("cost")).select(F.lit("corner").alias("kind"), "n", "cost"))


@query("select 0 as row, i as col, cast(i as double) as cost from range(8) t(i) union all select i, 8, round(6 + sqrt(2) + i, 6) from range(1, 6) t(i)")
def least_cost(spark, sf_dir):
    """Cells are dear but along the upper and the right edge; the corner is cut by the diagonal."""
    r = analysis.raster_empty(spark, 9, 6).withColumn("value", F.when((F.col("row") == 0) | (F.col("col") == 8), 1.0).otherwise(100.0))
    return analysis.least_cost_path(r, (0, 0), (5, 8)).withColumn("cost", F.round("cost", 6))


# point patterns, interpolation and networks


@query(real(f"""
with s as ({_SITES}), d as (select a.s, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as d from s a join s b on a.s <> b.s group by a.s), n as (select avg(d) as o, count(*) as n, 0.5 / sqrt(count(*) / 61200.0) as e, 0.26136 / sqrt(count(*) * count(*) / 61200.0) as se from d),
m as (select avg(w) as m, var_pop(w) as v from s), p as (select sum((a.w - m) * (b.w - m)) as t, count(*) as c, any_value(v) as v from s a join s b on a.s <> b.s and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 40 cross join m)
select 'observed' as measure, round(o, 6) as value from n union all select 'ratio', round(o / e, 6) from n union all select 'z', round((o - e) / se, 5) from n union all select 'moran', round(t / c / v, 8) from p
"""))
def point_patterns(spark, sf_dir):
    s = _sites(spark, sf_dir)
    nn = analysis.nearest_neighbour(s, "s", 61200.0, 20.0)
    named = lambda name, c, k=6: nn.select(F.lit(name).alias("measure"), F.round(c, k).alias("value"))
    moran = analysis.morans_i(s, "s", "w", 40.0).select(F.lit("moran").alias("measure"), F.round("morans_i", 8).alias("value"))
    return named("observed", "observed").unionByName(named("ratio", "ratio")).unionByName(named("z", "z", 5)).unionByName(moran)


@query(real(f"""
with s as ({_SITES}), g as (select i // 18 as row, i % 18 as col, -180 + (i % 18 + 0.5) * 20 as x, 90 - (i // 18 + 0.5) * 20 as y from range(162) t(i))
select cast(row as integer) as row, cast(col as integer) as col, round(sum(s.w / (pow(s.x - g.x, 2) + pow(s.y - g.y, 2))) / sum(1 / (pow(s.x - g.x, 2) + pow(s.y - g.y, 2))), 4) as value from g, s group by all
"""))
def idw_grid(spark, sf_dir):
    return analysis.idw_grid(_sites(spark, sf_dir), "w", -180.0, -90.0, 180.0, 90.0, 20.0).withColumn("value", F.round("value", 4))


@query(real(f"""
with s as ({_SITES}), t as (select n as k, (x0 + x1) / 2.0 as x, (y0 + y1) / 2.0 as y from ({_BOXES}))
select t.k, round(sum(case when d <= 60 then s.w / (d * d) end) / sum(case when d <= 60 then 1 / (d * d) end), 4) as idw from (select t.k, s.w, sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2)) as d from t, s) s join t using (k) group by t.k having count(*) filter (where d <= 60) > 0
"""))
def idw_near(spark, sf_dir):
    c = geom.centroid(F.col("shape"))
    t = _boxes(spark, sf_dir).select(F.col("n").alias("k"), geom.x(c).alias("x"), geom.y(c).alias("y"))
    return analysis.idw(_sites(spark, sf_dir), t, "k", "w", radius=60.0).select("k", _r("idw", 4).alias("idw"))


@query(f"select s as k, round(w, 4) as estimate, round(2e0 * x - y, 4) as plane, 1 as found from ({_SITES})")
def surfaces(spark, sf_dir):
    """Kriging gives a point's own value there; triangles of a plane give the plane."""
    s = _sites(spark, sf_dir)
    own = analysis.kriging(s, s.select(F.col("s").alias("k"), "x", "y"), "k", "s", "w", 20.0).select("k", F.round("estimate", 4).alias("estimate"))
    corners = spark.createDataFrame([(1, 0, -500.0, -400.0), (1, 1, 500.0, -410.0), (1, 2, 505.0, 400.0), (1, 3, -510.0, 405.0), (1, 4, 3.0, 7.0)], "g int, id bigint, x double, y double").withColumn("v", 2 * F.col("x") - F.col("y"))
    tin = analysis.tin(corners, "v", ["g"])
    # a point on a side shared by two triangles is in one of them
    plane = analysis.tin_at(tin, s.select(F.col("s").alias("k"), "x", "y"), "k", 100.0).groupBy("k").agg(F.round(F.min("value"), 4).alias("plane"), F.count(F.lit(1)).cast("int").alias("found"))
    return own.join(plane, "k")


@query("select k, (k % 3 = 0)::int + 1 as cluster from (select c_custkey as k from customer)")
def hierarchy_clusters(spark, sf_dir):
    """Two dense clouds far apart, by the rows' keys."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(F.lit(0).alias("g"), k.alias("id"), (F.when(k % 3 == 0, 1000.0).otherwise(0.0) + (k * 37 % 101) / 10).alias("x"), ((k * 53 % 97) / 10).alias("y"))
    found = analysis.hdbscan(p, ["g"], 20).select(F.col("id").alias("k"), "cluster")
    # clusters are numbered by their first point: that of key 0 or 1
    first = found.filter("k = 1").select(F.col("cluster").alias("one"))
    return found.join(F.broadcast(first)).select("k", F.when(F.col("cluster") == F.col("one"), 1).when(F.col("cluster") > 0, 2).otherwise(0).alias("cluster"))


@query(f"""
with c as (select * from (values (0, 0e0, 0e0), (1, 100e0, 30e0)) t(c, cx, cy)), d as (select k, x, y, c, row_number() over (partition by k order by pow(x - cx, 2) + pow(y - cy, 2), c) as r from ({_XY}), c),
m as (select c, avg(x) as cx, avg(y) as cy from d where r = 1 group by c), e as (select k, m.c, row_number() over (partition by k order by pow(x - cx, 2) + pow(y - cy, 2), m.c) as r from ({_XY}), m)
select k, c as cluster from e where r = 1
""")
def kmeans_once(spark, sf_dir):
    return analysis.kmeans(_points(spark, sf_dir).select("k", "x", "y"), [(0.0, 0.0), (100.0, 30.0)], most=1)[0].select("k", "cluster")


@query("""
with recursive e as (select n_nationkey as a, (n_nationkey * 7 + 3) % 25 as b, cast(n_nationkey % 5 + 1 as double) as cost from nation union all select n_nationkey, (n_nationkey + 1) % 25, 4e0 from nation),
r(source, node, cost) as (select n_nationkey, n_nationkey, 0e0 from nation union select r.source, e.b, r.cost + e.cost from r join e on r.node = e.a where r.cost + e.cost < 30), d as (select source, node, min(cost) as cost from r group by all)
select 'area' as kind, node, 0 as facility, cost from d where source = 0 and cost <= 12 union all
select 'facility', source, facility, cost from (select source, node as facility, cost, row_number() over (partition by source order by cost, node) as i from d where node in (3, 11, 20)) where i = 1
""")
def networks(spark, sf_dir):
    n = F.col("n_nationkey")
    t = table(spark, sf_dir, "nation")
    edges = t.select(n.alias("a"), ((n * 7 + 3) % 25).alias("b"), (n % 5 + 1).cast("double").alias("cost")).union(t.select(n, (n + 1) % 25, F.lit(4.0)))
    area = analysis.service_area(edges, 0, 12.0).select(F.lit("area").alias("kind"), "node", F.lit(0).alias("facility"), "cost")
    near = analysis.closest_facility(edges, t.select(n.alias("node")), t.filter("n_nationkey in (3, 11, 20)").select(n.alias("node")))
    return area.unionByName(near.select(F.lit("facility").alias("kind"), "node", "facility", "cost"))


@query(real(f"""
select k, true as in_bbox, 5.0 as elevation, x as wkt_x, y as wkt_y, 2 as collection, lower(lpad(to_hex(cell), 16, '0')) as token, true as from_token, round(2 + 0.5 * (k % 4), 6) as hull, 32600 + case when y >= 0 then 0 else 100 end + least(cast(floor((x + 180) / 6) as integer) + 1, 60) as utm_epsg, true as utm_near
from (select k, x, y, 10 * 576460752303423488 + k % 1000 as cell from ({_XY}))
"""))
def shape_rest(spark, sf_dir):
    x, y, k = F.col("x"), F.col("y"), F.col("k")
    p = geom.point(x, y, 5.0)
    cell = F.shiftleft(F.lit(10).cast("bigint"), 59) + k % 1000
    cloud = geom.multipoint(_ring((0, 0), (2, 0), (2, 1), (0, 1), (1, 0.5), (1, 1 + (k % 4) / 2)))
    wkt = formats.parse_wkt_point(F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")")))
    utm = geog.to_utm(geom.point(x, y))
    two = formats.parse_wkt_collection(F.concat(F.lit("GEOMETRYCOLLECTION (POINT ("), (k % 9).cast("string"), F.lit(" 1), LINESTRING (0 0, 1 1))")))
    return dealt(_points(spark, sf_dir)).select(
        "k", geom.in_bbox(p, geom.bbox(x - 1, y - 1, x + 1, y + 1)).alias("in_bbox"), (geom.elevation(p) + geom.z(p) - 5).alias("elevation"), geom.x(wkt).alias("wkt_x"), geom.y(wkt).alias("wkt_y"), F.size(two).alias("collection"), grids.s2_to_token(cell).alias("token"), (grids.s2_from_token(grids.s2_to_token(cell))["value"] == cell).alias("from_token"),
        _r(geom.area(geom.concave_hull(cloud, 0.0))).alias("hull"), geom.srid(utm).alias("utm_epsg"), geom.x(utm).between(160000.0, 840000.0).alias("utm_near"),
    )


@query(f"select cast(n * 14 - 178 as double) as lon, cast(n * 5 - 80 as double) as lat, cast(n as double) as ele from ({_BOXES})")
def track_files(spark, sf_dir):
    """A track through the nations' corners, written as a GPX file and read again."""
    n = F.col("n_nationkey").cast("double")
    path = scratch_path(spark, "gpx")
    track = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(geom.coord(n * 14 - 178, n * 5 - 80, n))).alias("c"))  # 25 points
    track.select(formats.to_gpx(geom.line(F.col("c"))).alias("value")).write.text(path)
    return formats.read_gpx(spark, path).select("lon", "lat", "ele")
