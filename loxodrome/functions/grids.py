"""Grid cells: a latitude-longitude grid of 16 resolutions and a cube grid of 31 levels, as 64-bit ids.

Latitude-longitude ids hold the resolution in the top 4 bits, then 30 bits of rows and 30 of columns;
cube ids the level in 5 bits, the face in 3, then 28 bits of each face coordinate. An id may be
negative as a bigint; only equality and the bits matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loxodrome.functions import geom
from loxodrome.functions.core import let

MOST_RESOLUTION, MOST_LEVEL = 15, 30


def _cell(share: Column, n: int) -> Column:
    """The number of the cell, of n in a row, that a share from 0 to 1 falls in."""
    return F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * n), F.lit(n - 1)).cast("bigint")


def _id(*fields: tuple[Column, int]) -> Column:
    out = F.lit(0).cast("bigint")
    for value, shift in fields:
        out = out.bitwiseOR(F.shiftleft(value.cast("bigint"), shift))
    return out


def h3_from_lat_lon(lat: Column, lon: Column, res: int) -> Column:
    n = 1 << (res + 1)
    return _id((F.lit(res), 60), (_cell((lat + 90) / 180, n), 30), (_cell((lon + 180) / 360, n), 0))


def h3_resolution(i: Column) -> Column:
    return F.shiftrightunsigned(i, 60).cast("int")


def h3_row(i: Column) -> Column:
    return F.shiftrightunsigned(i, 30).bitwiseAND(F.lit((1 << 30) - 1).cast("bigint"))


def h3_col(i: Column) -> Column:
    return i.bitwiseAND(F.lit((1 << 30) - 1).cast("bigint"))


def h3_size(i: Column) -> Column:
    """Cells along either axis at the id's resolution."""
    return F.pow(F.lit(2.0), h3_resolution(i) + 1).cast("bigint")


def h3_is_valid(i: Column) -> Column:
    return i.isNotNull() & h3_resolution(i).between(0, MOST_RESOLUTION)


def h3_center(i: Column) -> Column:
    """struct<x, y, z>."""
    return geom.coord((h3_col(i) + 0.5) / h3_size(i) * 360 - 180, (h3_row(i) + 0.5) / h3_size(i) * 180 - 90)


def h3_to_point(i: Column) -> Column:
    c = h3_center(i)
    return geom.point(c["x"], c["y"], srid=4326)


def h3_k_ring(i: Column, k: int) -> Column:
    """All cells within k rows and columns; rows end at the poles (and repeat there), columns go round."""
    n, span = h3_size(i), F.sequence(F.lit(-k), F.lit(k))
    row = lambda d: F.greatest(F.lit(0), F.least(n - 1, h3_row(i) + d))
    col = lambda d: F.when(h3_col(i) + d < 0, h3_col(i) + d + n).when(h3_col(i) + d >= n, h3_col(i) + d - n).otherwise(h3_col(i) + d)
    one = lambda r, c: F.shiftleft(h3_resolution(i).cast("bigint"), 60).bitwiseOR(F.shiftleft(row(r), 30)).bitwiseOR(col(c))
    return F.flatten(F.transform(span, lambda r: F.transform(span, lambda c: one(r, c))))


def h3_ring(i: Column, k: int) -> Column:
    """Only the cells at distance k."""
    return F.filter(h3_k_ring(i, k), lambda j: h3_distance(i, j) == k)


def h3_distance(a: Column, b: Column) -> Column:
    return F.greatest(F.abs(h3_row(a) - h3_row(b)), F.abs(h3_col(a) - h3_col(b)))


def h3_parent(i: Column, res: int) -> Column:
    drop = h3_resolution(i) - res
    half = lambda v: F.floor(v / F.pow(F.lit(2.0), drop)).cast("bigint")
    return F.shiftleft(F.lit(res).cast("bigint"), 60).bitwiseOR(F.shiftleft(half(h3_row(i)), 30)).bitwiseOR(half(h3_col(i)))


def h3_children(i: Column, res: int) -> Column:
    """All cells of a finer resolution in the cell."""
    n = F.pow(F.lit(2.0), F.lit(res) - h3_resolution(i)).cast("bigint")
    span = F.sequence(F.lit(0).cast("bigint"), n - 1)
    return F.flatten(F.transform(span, lambda r: F.transform(span, lambda c: F.shiftleft(F.lit(res).cast("bigint"), 60).bitwiseOR(F.shiftleft(h3_row(i) * n + r, 30)).bitwiseOR(h3_col(i) * n + c))))


def h3_boundary(i: Column) -> Column:
    n = h3_size(i)
    west, south, dx, dy = h3_col(i) / n * 360 - 180, h3_row(i) / n * 180 - 90, F.lit(360.0) / n, F.lit(180.0) / n
    return geom.bbox_to_polygon(geom.bbox(west, south, west + dx, south + dy))


def h3_area_km2(i: Column) -> Column:
    """Of the band between two latitudes on the sphere."""
    n = h3_size(i)
    south = F.radians(h3_row(i) / n * 180 - 90)
    north = F.radians((h3_row(i) + 1) / n * 180 - 90)
    return F.lit(geom.EARTH_KM**2 * 2 * math.pi) / n * (F.sin(north) - F.sin(south))


def covering(minx: Column, miny: Column, maxx: Column, maxy: Column, res: int) -> Column:
    """The ids of all cells that a bounding box meets."""
    n = 1 << (res + 1)
    rows = F.sequence(_cell((miny + 90) / 180, n), _cell((maxy + 90) / 180, n))
    cols = F.sequence(_cell((minx + 180) / 360, n), _cell((maxx + 180) / 360, n))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.shiftleft(F.lit(res).cast("bigint"), 60).bitwiseOR(F.shiftleft(r, 30)).bitwiseOR(c))))


def hex16(i: Column) -> Column:
    return F.lpad(F.lower(F.hex(i)), 16, "0")


h3_to_string = s2_to_token = hex16


def from_hex(s: Column) -> Column:
    """A result: the id, or an error."""
    v = F.when(s.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(s, 16, -10).cast("bigint"))
    return F.struct(v.isNotNull().alias("ok"), v.alias("value"), F.when(v.isNull(), F.concat(F.lit("invalid cell: "), F.coalesce(s, F.lit("nil")))).alias("err"))


h3_from_string = s2_from_token = from_hex


def s2_from_lat_lon(lat: Column, lon: Column, level: int) -> Column:
    """At levels 29 and 30 the face coordinates run into the bits above, as they always have."""
    a, o = F.radians(lat), F.radians(lon)
    place = F.struct((F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z"))
    return let(place, lambda p: _on_cube(p["x"], p["y"], p["z"], level))


def _on_cube(px: Column, py: Column, pz: Column, level: int) -> Column:
    """The cell in whose direction from the middle a place lies, at any distance."""
    ax, ay, az = F.abs(px), F.abs(py), F.abs(pz)
    by_x, by_y = (ax >= ay) & (ax >= az), (ay >= ax) & (ay >= az)
    face = F.when(by_x, F.when(px > 0, 0).otherwise(3)).when(by_y, F.when(py > 0, 1).otherwise(4)).otherwise(F.when(pz > 0, 2).otherwise(5))
    u = F.when(by_x, py / ax).when(by_y, px / ay).otherwise(px / az)
    v = F.when(by_x, pz / ax).when(by_y, pz / ay).otherwise(py / az)
    n = 1 << level
    return _id((F.lit(level), 59), (face, 56), (_cell((u + 1) / 2, n), 28), (_cell((v + 1) / 2, n), 0))


def s2_level(c: Column) -> Column:
    return F.shiftrightunsigned(c, 59).cast("int")


def s2_face(c: Column) -> Column:
    return F.shiftrightunsigned(c, 56).bitwiseAND(F.lit(7).cast("bigint")).cast("int")


def _uv(c: Column) -> tuple[Column, Column]:
    low = F.lit((1 << 28) - 1).cast("bigint")
    return F.shiftrightunsigned(c, 28).bitwiseAND(low), c.bitwiseAND(low)


def s2_is_valid(c: Column) -> Column:
    return c.isNotNull() & s2_level(c).between(0, MOST_LEVEL) & (s2_face(c) <= 5)


def s2_center(c: Column) -> Column:
    """struct<x, y, z>."""
    n = F.pow(F.lit(2.0), s2_level(c))
    u, v = [(k + 0.5) / n * 2 - 1 for k in _uv(c)]
    f = s2_face(c)
    px = F.when(f == 0, 1.0).when(f == 3, -1.0).otherwise(u)
    py = F.when(f == 1, 1.0).when(f == 4, -1.0).when(f.isin(0, 3), u).otherwise(v)
    pz = F.when(f == 2, 1.0).when(f == 5, -1.0).otherwise(v)
    r = F.sqrt(px * px + py * py + pz * pz)
    return geom.coord(F.degrees(F.atan2(py, px)), F.degrees(F.asin(pz / r)))


def s2_to_point(c: Column) -> Column:
    p = s2_center(c)
    return geom.point(p["x"], p["y"], srid=4326)


def s2_contains(c: Column, lat: Column, lon: Column, level: int) -> Column:
    """Whether the point falls in the cell, which is of this level; as a join, equality of ids."""
    return s2_from_lat_lon(lat, lon, level) == c


def s2_parent(c: Column) -> Column:
    u, v = _uv(c)
    return F.shiftleft((s2_level(c) - 1).cast("bigint"), 59).bitwiseOR(F.shiftleft(s2_face(c).cast("bigint"), 56)).bitwiseOR(F.shiftleft(F.shiftright(u, 1), 28)).bitwiseOR(F.shiftright(v, 1))


def s2_children(c: Column) -> Column:
    u, v = _uv(c)
    head = F.shiftleft((s2_level(c) + 1).cast("bigint"), 59).bitwiseOR(F.shiftleft(s2_face(c).cast("bigint"), 56))
    return F.array(*[head.bitwiseOR(F.shiftleft(u * 2 + i, 28)).bitwiseOR(v * 2 + j) for i in (0, 1) for j in (0, 1)])


def h3_path(a: Column, b: Column) -> Column:
    """The cells on the straight line from a to b, both included; of one resolution."""
    n = h3_distance(a, b)
    step = lambda u, v, i: F.round(u + (v - u) * i / F.greatest(n, F.lit(1))).cast("bigint")
    head = F.shiftleft(h3_resolution(a).cast("bigint"), 60)
    return F.transform(F.sequence(F.lit(0).cast("bigint"), n), lambda i: head.bitwiseOR(F.shiftleft(step(h3_row(a), h3_row(b), i), 30)).bitwiseOR(step(h3_col(a), h3_col(b), i)))


def h3_polyfill(g: Column, res: int) -> Column:
    """The cells whose centres lie in the polygon, in rows from the south."""
    inside = lambda h: lambda i: let(h3_center(i), lambda c: geom.in_polygon(c["x"], c["y"], geom.rings(h)))
    return let(g, lambda h: let(geom.envelope(h), lambda e: F.filter(covering(e["minx"], e["miny"], e["maxx"], e["maxy"], res), inside(h))))


def h3_compact(cells, column: str, by: list[str] = []):  # noqa: B006
    """A table of by and cells with each four cells that fill a cell of the next resolution replaced by that one, as far as it goes."""
    from loxodrome.operators.stats import kept

    out = kept(cells.select(*by, column).distinct())
    finest = out.agg(F.max(h3_resolution(F.col(column)))).first()[0] or 0
    for res in range(finest, 0, -1):
        own = h3_resolution(F.col(column)) == res
        parent = out.filter(own).select(*by, column, h3_parent(F.col(column), res - 1).alias("_p"))
        full = kept(parent.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 4").select(*by, "_p"))
        rest = parent.join(full, [*by, "_p"], "left_anti").select(*by, column)
        out = kept(out.filter(~own).union(rest).union(full.select(*by, F.col("_p").alias(column))))  # written out, or the next level would compute this one three times
    return out


def h3_uncompact(cells, column: str, res: int):
    """A table of cells with coarser ones replaced by their cells of the resolution."""
    i = F.col(column)
    return cells.withColumn(column, F.explode(F.when(h3_resolution(i) < res, h3_children(i, res)).otherwise(F.array(i))))


def s2_neighbors(c: Column, level: int) -> Column:
    """The four cells that share an edge with a cell of this level, over the cube's edges too."""
    n = 1 << level
    own = F.struct(s2_face(c).alias("f"), *[((k + 0.5) / F.lit(float(n)) * 2 - 1).alias(name) for k, name in zip(_uv(c), "uv", strict=True)])

    def beside(s: Column, du: int, dv: int) -> Column:
        f, u, v = s["f"], s["u"] + du * 2 / n, s["v"] + dv * 2 / n
        px = F.when(f == 0, 1.0).when(f == 3, -1.0).otherwise(u)
        py = F.when(f == 1, 1.0).when(f == 4, -1.0).when(f.isin(0, 3), u).otherwise(v)
        pz = F.when(f == 2, 1.0).when(f == 5, -1.0).otherwise(v)
        return F.struct(px.alias("x"), py.alias("y"), pz.alias("z"))

    places = let(own, lambda s: F.array(*[beside(s, du, dv) for du, dv in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    return F.transform(places, lambda p: _on_cube(p["x"], p["y"], p["z"], level))
