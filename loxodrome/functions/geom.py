"""Planar geometry as column expressions.

A geometry is a struct<kind, srid, parts>: parts hold rings or lines, and those hold coordinates
struct<x, y, z>; z is null without elevation. A Point has one part of one line of one coordinate, a
LineString one part of one line, a Polygon one part of its rings (the first is the outer one), the
Multi kinds a part for each member. A collection is an array of geometries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loxodrome.functions.core import let

COORD = "struct<x:double,y:double,z:double>"
LINE = f"array<{COORD}>"
GEOM = f"struct<kind:string,srid:int,parts:array<array<{LINE}>>>"
EARTH_KM = 6371.0088
HALF_WORLD = 20037508.34


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(None if x is None else float(x))).cast("double")


def coord(x, y, z=None) -> Column:
    return F.struct(_d(x).alias("x"), _d(y).alias("y"), _d(z).alias("z"))


def make(kind, parts: Column, srid=0) -> Column:
    """Without a cast to GEOM, which parts of coord() have anyway: a cast would copy every coordinate and hide from Catalyst that x(point(a, b)) is a."""
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(kind.alias("kind"), (srid if isinstance(srid, Column) else F.lit(srid)).cast("int").alias("srid"), parts.alias("parts"))


# builders


def point(x, y, z=None, srid=0) -> Column:
    return make("Point", F.array(F.array(F.array(coord(x, y, z)))), srid)


def line(coords: Column, srid=0) -> Column:
    """A LineString of an array of coordinates."""
    return make("LineString", F.array(F.array(coords)), srid)


def linestring(*points: Column) -> Column:
    return line(F.array(*[coord_of(p) for p in points]))


def polygon(ring: Column, *holes: Column, srid=0) -> Column:
    """Of arrays of coordinates; rings aren't closed by themselves."""
    return make("Polygon", F.array(F.array(ring, *holes)), srid)


def multipoint(coords: Column, srid=0) -> Column:
    return make("MultiPoint", F.transform(coords, lambda c: F.array(F.array(c))), srid)


def multi(geoms: Column, srid=0) -> Column:
    """The Multi kind of an array of LineStrings or of Polygons."""
    return make(F.concat(F.lit("Multi"), F.get(geoms, F.lit(0))["kind"]), F.transform(geoms, lambda g: F.get(g["parts"], F.lit(0))), srid)


def geometry_collection(*geoms: Column) -> Column:
    return F.array(*geoms)


def bbox(minx, miny, maxx, maxy) -> Column:
    return F.struct(_d(minx).alias("minx"), _d(miny).alias("miny"), _d(maxx).alias("maxx"), _d(maxy).alias("maxy"))


def bbox_to_polygon(b: Column) -> Column:
    return polygon(F.array(coord(b["minx"], b["miny"]), coord(b["maxx"], b["miny"]), coord(b["maxx"], b["maxy"]), coord(b["minx"], b["maxy"]), coord(b["minx"], b["miny"])))


def bbox_width(b: Column) -> Column:
    return b["maxx"] - b["minx"]


def bbox_height(b: Column) -> Column:
    return b["maxy"] - b["miny"]


def bbox_center(b: Column) -> Column:
    return point((b["minx"] + b["maxx"]) / 2, (b["miny"] + b["maxy"]) / 2)


# parts


def coords(g: Column) -> Column:
    """All coordinates in order."""
    return F.flatten(F.flatten(g["parts"]))


coordinates = coords


def rings(g: Column) -> Column:
    """The rings or lines of the first part."""
    return F.get(g["parts"], F.lit(0))


def exterior(g: Column) -> Column:
    return F.get(rings(g), F.lit(0))


def holes(g: Column) -> Column:
    return F.slice(rings(g), F.lit(2), F.greatest(F.size(rings(g)) - 1, F.lit(0)))


def coord_of(p: Column) -> Column:
    return F.get(exterior(p), F.lit(0))


def x(p: Column) -> Column:
    return coord_of(p)["x"]


def y(p: Column) -> Column:
    return coord_of(p)["y"]


def z(p: Column) -> Column:
    return coord_of(p)["z"]


lon, lat, elevation = x, y, z


def geom_type(g: Column) -> Column:
    return g["kind"]


def num_points(g: Column) -> Column:
    return F.size(coords(g))


def has_z(g: Column) -> Column:
    """Of Points only; other kinds never say so."""
    return (g["kind"] == "Point") & z(g).isNotNull()


def has_m(g: Column) -> Column:
    return F.lit(False)


def is_empty(g: Column) -> Column:
    return (num_points(g) == 0) | ((g["kind"] == "Point") & (F.isnan(x(g)) | F.isnan(y(g))))


def dimension(g: Column) -> Column:
    return F.when(g["kind"].isin("Point", "MultiPoint"), 0).when(g["kind"].isin("LineString", "MultiLineString"), 1).otherwise(2)


def coordinate_dimension(g: Column) -> Column:
    return F.lit(2)


def srid(g: Column) -> Column:
    return g["srid"]


def set_srid(g: Column, n) -> Column:
    return make(g["kind"], g["parts"], n)


def num_geometries(g: Column) -> Column:
    return F.size(g["parts"])


def geometries(g: Column) -> Column:
    """The members of a Multi kind."""
    return F.transform(g["parts"], lambda p: make(F.regexp_replace(g["kind"], "^Multi", ""), F.array(p), g["srid"]))


def exterior_ring(g: Column) -> Column:
    return line(exterior(g), g["srid"])


def num_interior_rings(g: Column) -> Column:
    return F.size(rings(g)) - 1


def interior_ring(g: Column, i: int) -> Column:
    return line(F.get(rings(g), F.lit(i + 1)), g["srid"])


def remove_holes(g: Column) -> Column:
    return polygon(exterior(g), srid=g["srid"])


def points(g: Column) -> Column:
    return F.transform(coords(g), lambda c: make("Point", F.array(F.array(F.array(c))), g["srid"]))


def start_point(g: Column) -> Column:
    return point(F.get(coords(g), F.lit(0))["x"], F.get(coords(g), F.lit(0))["y"], F.get(coords(g), F.lit(0))["z"])


def end_point(g: Column) -> Column:
    c = F.try_element_at(coords(g), F.lit(-1))
    return point(c["x"], c["y"], c["z"])


# measures


def _distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    dz = F.when(a["z"].isNotNull() & b["z"].isNotNull(), a["z"] - b["z"]).otherwise(0.0)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def distance(p: Column, q: Column) -> Column:
    """Euclidean, with elevation where both have it."""
    return _distance(coord_of(p), coord_of(q))


def haversine(lon1, lat1, lon2, lat2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance of degrees, in the unit of the radius."""
    a1, a2, o1, o2 = F.radians(lat1), F.radians(lat2), F.radians(lon1), F.radians(lon2)
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), F.lit(2.0))
    h = F.least(h, F.lit(1.0))
    return F.lit(2 * radius) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def distance_geodesic(p: Column, q: Column) -> Column:
    """Kilometres."""
    return haversine(x(p), y(p), x(q), y(q))


def _edges(c: Column, f, closed: bool) -> Column:
    """f of each coordinate and the next; closed: also of the last and the first."""

    def of(c: Column) -> Column:
        rest = F.greatest(F.size(c) - 1, F.lit(0))
        if closed:
            return F.zip_with(c, F.concat(F.slice(c, F.lit(2), rest), F.slice(c, 1, 1)), f)
        return F.zip_with(F.slice(c, F.lit(1), rest), F.slice(c, F.lit(2), rest), f)

    return let(c, of)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def ring_signed_area(ring: Column) -> Column:
    """Positive if counter-clockwise."""
    return let(ring, lambda c: F.when(F.size(c) < 3, 0.0).otherwise(_sum(_edges(c, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"], True)) / 2))


def _area_of_part(rs: Column, ring_area) -> Column:
    return F.aggregate(F.transform(rs, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda s, v: s + v)


def area(g: Column) -> Column:
    """Of Polygons and MultiPolygons, holes off; 0 of other kinds."""
    return F.when(g["kind"].isin("Polygon", "MultiPolygon"), _sum(F.transform(g["parts"], lambda p: _area_of_part(p, lambda r: F.abs(ring_signed_area(r)))))).otherwise(0.0)


def signed_area(g: Column) -> Column:
    return ring_signed_area(exterior(g))


def ring_area_geodesic(ring: Column, radius: float = EARTH_KM) -> Column:
    """Spherical excess in squares of the radius' unit."""

    def of(ring: Column) -> Column:
        n = F.size(ring)
        term = lambda c, i: (F.radians(F.get(ring, (i + 2) % n)["x"]) - F.radians(c["x"])) * F.sin(F.radians(F.get(ring, (i + 1) % n)["y"]))
        return F.when(n < 3, 0.0).otherwise(F.abs(_sum(F.transform(ring, term))) * F.lit(radius * radius / 2))

    return let(ring, of)


def area_geodesic(g: Column, radius: float = EARTH_KM) -> Column:
    """Square kilometres."""
    return _sum(F.transform(g["parts"], lambda p: _area_of_part(p, lambda r: ring_area_geodesic(r, radius))))


def line_length(c: Column) -> Column:
    return _sum(_edges(c, _distance, False))


def length(g: Column) -> Column:
    return line_length(exterior(g))


def perimeter(g: Column) -> Column:
    """Of the outer ring, or the length of a line."""
    return line_length(exterior(g))


def length_geodesic(g: Column) -> Column:
    """Kilometres."""
    return _sum(_edges(exterior(g), lambda a, b: haversine(a["x"], a["y"], b["x"], b["y"]), False))


def ring_centroid(ring: Column) -> Column:
    """struct<x, y, z>: by area, or the mean of the vertices where there is none."""
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    total = _sum(_edges(ring, cross, True))
    cx = _sum(_edges(ring, lambda a, b: (a["x"] + b["x"]) * cross(a, b), True))
    cy = _sum(_edges(ring, lambda a, b: (a["y"] + b["y"]) * cross(a, b), True))
    return let(total, lambda t: F.when(t == 0, mean_coord(ring)).otherwise(coord(cx / (3 * F.nullif(t, F.lit(0.0))), cy / (3 * F.nullif(t, F.lit(0.0))))))


def mean_coord(c: Column) -> Column:
    n = F.greatest(F.size(c), F.lit(1))
    return coord(_sum(F.transform(c, lambda p: p["x"])) / n, _sum(F.transform(c, lambda p: p["y"])) / n)


def centroid(g: Column) -> Column:
    """Of a Polygon that of its outer ring; else the mean of the vertices."""
    c = F.when(g["kind"] == "Polygon", ring_centroid(exterior(g))).otherwise(mean_coord(coords(g)))
    return make("Point", F.array(F.array(F.array(c))), g["srid"])


def envelope_of(c: Column) -> Column:
    low = lambda k: F.array_min(F.transform(c, lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(c, lambda p: p[k]))
    return bbox(low("x"), low("y"), high("x"), high("y"))


def envelope(g: Column) -> Column:
    return envelope_of(coords(g))


bounds = envelope


# predicates


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Ray casting, half open: of two regions that share an edge a point on it is in one. An edge is always reckoned from its lower end, or rounding would put a point near it in both or in none."""
    end = lambda pick, a, b: pick(F.struct(a["y"].alias("y"), a["x"].alias("x")), F.struct(b["y"].alias("y"), b["x"].alias("x")))
    right = lambda low, high: px < (high["x"] - low["x"]) * (py - low["y"]) / F.nullif(high["y"] - low["y"], F.lit(0.0)) + low["x"]
    crossing = lambda a, b: ((b["y"] > py) != (a["y"] > py)) & right(end(F.least, a, b), end(F.greatest, a, b))
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))  # not by _edges(), whose let() conditions of joins don't take
    return F.size(F.filter(F.zip_with(ring, after, lambda a, b: F.coalesce(crossing(a, b), F.lit(False))), lambda c: c)) % 2 == 1


def in_polygon(px: Column, py: Column, rs: Column) -> Column:
    """Inside the first ring and in none of the others."""
    return in_ring(px, py, F.get(rs, F.lit(0))) & ~F.exists(F.slice(rs, F.lit(2), F.greatest(F.size(rs) - 1, F.lit(0))), lambda h: in_ring(px, py, h))


def in_bbox(p: Column, b: Column) -> Column:
    return x(p).between(b["minx"], b["maxx"]) & y(p).between(b["miny"], b["maxy"])


def contains(a: Column, b: Column) -> Column:
    """Whether all vertices of b (the outer ring's of a Polygon) are in the Polygon a and in none of its holes; false if a is of another kind."""
    inner = F.when(b["kind"] == "Polygon", exterior(b)).otherwise(coords(b))
    some = (a["kind"] == "Polygon") & b["kind"].isin("Point", "LineString", "Polygon", "MultiPoint")
    return F.when(some, let(rings(a), lambda rs: F.forall(inner, lambda c: in_polygon(c["x"], c["y"], rs)))).otherwise(False)


def within(a: Column, b: Column) -> Column:
    return contains(b, a)


covers, covered_by = contains, within


def segments_meet(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Whether pq and rs have a point in common: their boxes overlap, and neither segment lies to one side of the other's line."""
    span = lambda u, v, k: (F.least(u[k], v[k]), F.greatest(u[k], v[k]))
    overlap = F.lit(True)
    for k in ("x", "y"):
        (low, high), (least, most) = span(p, q, k), span(r, s, k)
        overlap = overlap & (low <= most) & (least <= high)
    side = lambda u, v, w: F.signum((v["x"] - u["x"]) * (w["y"] - u["y"]) - (w["x"] - u["x"]) * (v["y"] - u["y"]))
    return overlap & (side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0)


def edges(g: Column) -> Column:
    """array<struct<a, b>> of the lines and outer rings; none of points."""
    each = lambda l: _edges(l, lambda a, b: F.struct(a.alias("a"), b.alias("b")), False)
    outer = F.transform(g["parts"], lambda p: each(F.get(p, F.lit(0))))
    return F.when(g["kind"].isin("Point", "MultiPoint"), F.slice(F.flatten(outer), 1, 0)).otherwise(F.flatten(outer))


def edges_meet(a: Column, b: Column) -> Column:
    return let(edges(b), lambda eb: F.exists(edges(a), lambda s: F.exists(eb, lambda t: segments_meet(s["a"], s["b"], t["a"], t["b"]))))


def bbox_meet(a: Column, b: Column) -> Column:
    return (a["maxx"] >= b["minx"]) & (a["minx"] <= b["maxx"]) & (a["maxy"] >= b["miny"]) & (a["miny"] <= b["maxy"])


def intersects(a: Column, b: Column) -> Column:
    """Bounding boxes, then containment, edges and vertices in outer rings. A point is never met by a point or line."""
    vertex_in = lambda p, q: (p["kind"] == "Polygon") & let(exterior(p), lambda ring: F.exists(coords(q), lambda c: in_ring(c["x"], c["y"], ring)))
    return F.when(bbox_meet(envelope(a), envelope(b)), contains(a, b) | contains(b, a) | edges_meet(a, b) | vertex_in(a, b) | vertex_in(b, a)).otherwise(False)


def disjoint(a: Column, b: Column) -> Column:
    return ~intersects(a, b)


def touches(a: Column, b: Column) -> Column:
    """Whether edges meet."""
    return intersects(a, b) & edges_meet(a, b)


def crosses(a: Column, b: Column) -> Column:
    """A line with vertices in and out of a polygon, or one that meets a line."""
    inside = let(exterior(b), lambda ring: F.transform(coords(a), lambda c: in_ring(c["x"], c["y"], ring)))
    return F.when((a["kind"] == "LineString") & (b["kind"] == "Polygon"), F.array_contains(inside, True) & F.array_contains(inside, False)).when((a["kind"] == "LineString") & (b["kind"] == "LineString"), edges_meet(a, b)).otherwise(False)


def overlaps(a: Column, b: Column) -> Column:
    return intersects(a, b) & ~contains(a, b) & ~contains(b, a)


def equals(a: Column, b: Column) -> Column:
    """Of one kind with the same coordinates in order."""
    return (a["kind"] == b["kind"]) & (coords(a) == coords(b))


def is_closed(g: Column) -> Column:
    return let(exterior(g), lambda c: (F.size(c) > 0) & (F.get(c, F.lit(0)) == F.element_at(c, -1)))


def is_simple(g: Column) -> Column:
    """A LineString none of whose edges meets another but its neighbours; other kinds always."""

    def clash(e: Column) -> Column:
        n = F.size(e)
        ends = let(e, lambda e: (F.size(e) > 0) & (F.get(e, F.lit(0))["a"] == F.element_at(e, -1)["b"]))
        return let(ends, lambda ends: F.exists(F.transform(e, lambda s, i: F.exists(F.filter(e, lambda _, j: (j > i + 1) & ~(ends & (i == 0) & (j == n - 1))), lambda t: segments_meet(s["a"], s["b"], t["a"], t["b"]))), lambda v: v))

    return F.when(g["kind"] == "LineString", ~let(edges(g), clash)).otherwise(True)


def is_ring(g: Column) -> Column:
    return is_closed(g) & is_simple(g) & (F.size(exterior(g)) >= 4)


def is_valid(g: Column) -> Column:
    return F.when(g["kind"] == "Point", ~F.isnan(x(g)) & ~F.isnan(y(g))).when(g["kind"] == "LineString", F.size(exterior(g)) >= 2).when(g["kind"] == "Polygon", (F.size(exterior(g)) >= 4) & is_closed(g)).otherwise(True)


# changes


def mapped(g: Column, f) -> Column:
    """The geometry with f of each coordinate."""
    return make(g["kind"], F.transform(g["parts"], lambda p: F.transform(p, lambda l: F.transform(l, f))), g["srid"])


def translate(g: Column, dx, dy) -> Column:
    return mapped(g, lambda c: coord(c["x"] + dx, c["y"] + dy, c["z"]))


def scale(g: Column, fx, fy=None) -> Column:
    """About the origin."""
    return mapped(g, lambda c: coord(c["x"] * fx, c["y"] * (fx if fy is None else fy), c["z"]))


def rotate(g: Column, angle: float) -> Column:
    """About the origin, by radians."""
    co, si = math.cos(angle), math.sin(angle)
    return mapped(g, lambda c: coord(c["x"] * co - c["y"] * si, c["x"] * si + c["y"] * co, c["z"]))


def reflect(g: Column, axis: str) -> Column:
    """At the x or y axis."""
    return mapped(g, lambda c: coord(c["x"], -c["y"], c["z"]) if axis == "x" else coord(-c["x"], c["y"], c["z"]))


def shear(g: Column, kx: float, ky: float) -> Column:
    return mapped(g, lambda c: coord(c["x"] + c["y"] * kx, c["y"] + c["x"] * ky, c["z"]))


def affine(g: Column, a: float, b: float, c_: float, d: float, e: float, f: float) -> Column:
    """x' = a x + b y + c, y' = d x + e y + f."""
    return mapped(g, lambda c: coord(c["x"] * a + c["y"] * b + c_, c["x"] * d + c["y"] * e + f, c["z"]))


def affine3d(g: Column, m: list[list[float]]) -> Column:
    """Three rows of four numbers: each coordinate is the sum of x, y, z (0 without elevation) and 1, weighed by a row."""
    z = lambda c: F.coalesce(c["z"], F.lit(0.0))
    return mapped(g, lambda c: coord(*[c["x"] * float(r[0]) + c["y"] * float(r[1]) + z(c) * float(r[2]) + float(r[3]) for r in m]))


def reverse(g: Column) -> Column:
    return make(g["kind"], F.transform(g["parts"], lambda p: F.transform(p, F.reverse)), g["srid"])


def merge(a: Column, b: Column) -> Column:
    """One line of two; a shared vertex comes once."""
    both = lambda ca, cb: F.concat(ca, F.when(F.element_at(ca, -1) == F.get(cb, F.lit(0)), F.slice(cb, F.lit(2), F.size(cb))).otherwise(cb))
    return line(let(exterior(a), lambda ca: let(exterior(b), lambda cb: both(ca, cb))), a["srid"])


def orient_exterior_ccw(g: Column) -> Column:
    turned = lambda g: make("Polygon", F.array(F.transform(rings(g), lambda ring, i: F.when(i == 0, F.reverse(ring)).otherwise(ring))), g["srid"])
    return let(g, lambda g: F.when(signed_area(g) < 0, turned(g)).otherwise(g))


def along(g: Column, fraction) -> Column:
    """The point at this share of the line's length."""
    f = fraction if isinstance(fraction, Column) else F.lit(float(fraction))

    def of(c: Column) -> Column:
        steps = _edges(c, _distance, False)
        # the first edge whose end is at or beyond the goal
        state = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at"), F.lit(0.0).alias("t"), F.lit(0).alias("i"))

        def walk(s, d, goal):
            hit = (s["at"] < 0) & (s["sum"] + d >= goal)
            return F.struct((s["sum"] + d).alias("sum"), F.when(hit, s["i"]).otherwise(s["at"]).alias("at"), F.when(hit & (d > 0), (goal - s["sum"]) / F.nullif(d, F.lit(0.0))).otherwise(s["t"]).alias("t"), (s["i"] + 1).alias("i"))

        def put(s):
            a, b = F.get(c, s["at"]), F.get(c, s["at"] + 1)
            last = F.element_at(c, -1)
            return F.when(s["at"] < 0, coord(last["x"], last["y"])).otherwise(coord(a["x"] + s["t"] * (b["x"] - a["x"]), a["y"] + s["t"] * (b["y"] - a["y"])))

        return let(line_length(c) * f, lambda goal: F.aggregate(steps, state, lambda s, d: walk(s, d, goal), put))

    return make("Point", F.array(F.array(F.array(let(exterior(g), of)))), g["srid"])


interpolate = along


def locate_point(g: Column, p: Column) -> Column:
    """The share of the line's length at its place nearest to p."""

    def of(c: Column, px: Column, py: Column) -> Column:
        def near(a, b):
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((px - a["x"]) * dx + (py - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
            off = F.hypot(px - a["x"] - t * dx, py - a["y"] - t * dy)
            return F.struct(off.alias("off"), (t * F.hypot(dx, dy)).alias("into"), F.hypot(dx, dy).alias("len"))

        start = F.struct(F.lit(float("inf")).alias("off"), F.lit(0.0).alias("at"), F.lit(0.0).alias("sum"))
        step = lambda s, e: F.struct(F.least(s["off"], e["off"]).alias("off"), F.when(e["off"] < s["off"], s["sum"] + e["into"]).otherwise(s["at"]).alias("at"), (s["sum"] + e["len"]).alias("sum"))
        return F.aggregate(_edges(c, near, False), start, step, lambda s: F.when(s["sum"] > 0, s["at"] / F.nullif(s["sum"], F.lit(0.0))).otherwise(0.0))

    return let(exterior(g), lambda c: let(coord_of(p), lambda q: of(c, q["x"], q["y"])))


def substring(g: Column, start: float, stop: float) -> Column:
    """The line between two shares of its length."""

    def of(c: Column) -> Column:
        # the length up to each vertex, by one pass
        sums = F.aggregate(_edges(c, _distance, False), F.array(F.lit(0.0)), lambda s, d: F.concat(s, F.array(F.element_at(s, -1) + d)))
        inner = lambda upto: F.filter(c, lambda _, i: (F.get(upto, i) > F.element_at(upto, -1) * start) & (F.get(upto, i) < F.element_at(upto, -1) * stop))
        whole = line(c)
        return F.concat(F.array(coord_of(along(whole, start))), let(sums, inner), F.array(coord_of(along(whole, stop))))

    return line(let(exterior(g), of), g["srid"])


def buffer_point(p: Column, radius, segments: int = 32) -> Column:
    """A regular polygon about a point."""
    r = _d(radius)
    return polygon(F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: coord(x(p) + r * F.cos(F.lit(2 * math.pi) * i / segments), y(p) + r * F.sin(F.lit(2 * math.pi) * i / segments))))


def midpoint(p: Column, q: Column) -> Column:
    """The planar mean."""
    return point((x(p) + x(q)) / 2, (y(p) + y(q)) / 2)


def azimuth(p: Column, q: Column) -> Column:
    """The mathematical angle from p to q in radians."""
    return F.atan2(y(q) - y(p), x(q) - x(p))


def bearing(p: Column, q: Column) -> Column:
    """Degrees from north, 0 to 360."""
    return bearing_of(x(p), y(p), x(q), y(q))


def bearing_of(lon1, lat1, lon2, lat2) -> Column:
    a1, a2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    deg = F.degrees(F.atan2(F.cos(a2) * F.sin(d), F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(d)))
    return (deg + 360) % 360


def destination_of(lon1, lat1, brg, dist, radius: float = EARTH_KM) -> Column:
    """struct<x, y, z>: where this bearing and distance lead on the sphere."""
    a, o, b, d = F.radians(lat1), F.radians(lon1), F.radians(_d(brg)), _d(dist) / radius
    lat2 = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    lon2 = o + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return coord(F.degrees(lon2), F.degrees(lat2))


def destination(p: Column, brg, km) -> Column:
    c = destination_of(x(p), y(p), brg, km)
    return point(c["x"], c["y"])


def to_mercator(c: Column) -> Column:
    """EPSG:3857 by half the world's width."""
    k = HALF_WORLD / 180
    return coord(c["x"] * k, F.ln(F.tan((90 + c["y"]) * F.lit(math.pi / 360))) / F.lit(math.pi / 180) * k, c["z"])


def from_mercator(c: Column) -> Column:
    return coord(c["x"] * F.lit(180 / HALF_WORLD), F.atan(F.exp(c["y"] * F.lit(math.pi / HALF_WORLD))) * F.lit(360 / math.pi) - 90, c["z"])


def project(g: Column, source: int, target: int) -> Column:
    if source == target:
        return g
    if (source, target) not in ((4326, 3857), (3857, 4326)):
        raise ValueError(f"unsupported projection {source} -> {target} (supported: 4326 <-> 3857)")
    return mapped(g, to_mercator if target == 3857 else from_mercator)


# what needs loops with a memory: Arrow functions over lists of coordinates


def hull(xy: np.ndarray) -> np.ndarray:
    """The convex hull of points (n, 2), counter-clockwise and closed, from the smallest x."""
    pts = sorted(set(map(tuple, np.asarray(xy, float).tolist())))  # plain numbers: most hulls are of a few points, which arrays are slow for
    if len(pts) <= 2:
        return np.array(pts, float).reshape(-1, 2)

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    both = chain(pts) + chain(pts[::-1])
    return np.array(both + both[:1])


def thinned(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that Douglas-Peucker keeps."""
    keep, todo = {0, len(xy) - 1}, [(0, len(xy) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d, mid = xy[i], xy[j] - xy[i], xy[i + 1 : j]
        n = float(d @ d)
        t = np.clip((mid - a) @ d / n, 0, 1) if n else np.zeros(len(mid))
        off = np.hypot(*(mid - a - t[:, None] * d).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return np.array(sorted(keep))


def _lines(f):
    """An Arrow function on the xs and ys of a line."""

    @F.pandas_udf(LINE)
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xs, ys, strict=True):
            xy = np.column_stack([np.asarray(a, float), np.asarray(b, float)]) if a is not None else np.empty((0, 2))
            out.append([{"x": float(p), "y": float(q), "z": None} for p, q in f(xy)] if len(xy) else [])
        return pd.Series(out)

    return lambda c: run(F.transform(c, lambda p: p["x"]), F.transform(c, lambda p: p["y"]))


def convex_hull(g: Column) -> Column:
    return polygon(_lines(hull)(coords(g)), srid=g["srid"])


def concave_hull(g: Column, concavity: float = 0.5) -> Column:
    from loxodrome.functions import overlay

    return overlay.concave_hull(g, concavity)


def alpha_shape(g: Column, alpha: float) -> Column:
    from loxodrome.functions import overlay

    return overlay.alpha_shape(g, alpha)


def simplify(g: Column, tolerance: float) -> Column:
    """Douglas-Peucker of a line or the outer ring."""
    kept = _lines(lambda xy: xy[thinned(xy, tolerance)] if len(xy) > 2 else xy)(exterior(g))
    return make(g["kind"], F.array(F.concat(F.array(kept), holes(g))), g["srid"])


def buffer(g: Column, radius: float, segments: int = 32) -> Column:
    """Of a point a circle; of other kinds the hull of the circles about its vertices. overlay.buffer() is exact."""
    turn = np.linspace(0, 2 * math.pi, segments + 1)
    ring = np.column_stack([np.cos(turn), np.sin(turn)]) * radius
    round_ = _lines(lambda xy: hull((xy[:, None, :] + ring[None, :, :]).reshape(-1, 2)))(coords(g))
    return F.when(g["kind"] == "Point", buffer_point(g, radius, segments)).otherwise(polygon(round_, srid=g["srid"]))


def hausdorff_distance(a: Column, b: Column) -> Column:
    """Between the vertices."""
    one = lambda p, q: F.array_max(F.transform(p, lambda s: F.array_min(F.transform(q, lambda t: _distance(s, t)))))
    return let(coords(a), lambda p: let(coords(b), lambda q: F.greatest(one(p, q), one(q, p))))


def densify(g: Column, most: float) -> Column:
    """Vertices added so that no edge is longer."""

    def parts(a, b):
        n = F.greatest(F.ceil(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / most), F.lit(1)).cast("int")
        return let(n, lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: coord(a["x"] + (b["x"] - a["x"]) * k / n, a["y"] + (b["y"] - a["y"]) * k / n)))

    each = lambda l: F.concat(F.flatten(_edges(l, parts, False)), F.slice(l, F.size(l), F.lit(1)))
    return make(g["kind"], F.transform(g["parts"], lambda p: F.transform(p, each)), g["srid"])


def snap(g: Column, cell: float) -> Column:
    """Coordinates at the nearest multiples of cell."""
    return mapped(g, lambda c: coord(F.round(c["x"] / cell) * cell, F.round(c["y"] / cell) * cell, c["z"]))
