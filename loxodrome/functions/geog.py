"""Geography on the sphere in metres, reference systems and transforms between them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.functions import geom
from loxodrome.functions.geom import coord, x, y

EARTH_M, MAJOR_AXIS = 6371008.8, 6378137.0
#: Code, name, geographic, unit, datum, ellipsoid, PROJ text, west, south, east, north of the known systems.
SYSTEMS = [
    (4326, "WGS 84", True, "degree", "World Geodetic System 1984", "WGS 84", "+proj=longlat +datum=WGS84 +no_defs +type=crs", -180.0, -90.0, 180.0, 90.0),
    (3857, "WGS 84 / Pseudo-Mercator", False, "metre", "World Geodetic System 1984", "WGS 84", "+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +k=1 +units=m +no_defs +type=crs", -20037508.34, -20048966.1, 20037508.34, 20048966.1),
    (4269, "NAD83", True, "degree", "North American Datum 1983", "GRS 1980", "+proj=longlat +datum=NAD83 +no_defs +type=crs", -172.54, 23.81, -47.74, 86.46),
    (4267, "NAD27", True, "degree", "North American Datum 1927", "Clarke 1866", "+proj=longlat +datum=NAD27 +no_defs +type=crs", -172.54, 23.81, -47.74, 86.46),
    (4258, "ETRS89", True, "degree", "European Terrestrial Reference System 1989", "GRS 1980", "+proj=longlat +ellps=GRS80 +no_defs +type=crs", -16.1, 32.88, 40.18, 84.17),
]
#: Semi-major axis and inverse flattening of the ellipsoids, as well-known text writes them.
ELLIPSOIDS = {"WGS 84": "6378137,298.257223563", "GRS 1980": "6378137,298.257222101", "Clarke 1866": "6378206.4,294.978698214"}
SAME_DATUM = (4326, 4269, 4258)


# measures


def Point(lon, lat) -> Column:
    return geom.point(lon, lat, srid=4326)


def LineString(coords: Column) -> Column:
    return geom.line(coords, 4326)


def from_lat_lon(lat, lon) -> Column:
    return Point(lon, lat)


def from_wkt(s: Column) -> Column:
    """A geography of well-known text in longitudes and latitudes."""
    from loxodrome.sources import formats

    return geom.set_srid(formats.parse_wkt(s), 4326)


def distance_great_circle(p: Column, q: Column) -> Column:
    """Metres."""
    return geom.haversine(x(p), y(p), x(q), y(q), EARTH_M)


def bearing(p: Column, q: Column) -> Column:
    return geom.bearing(p, q)


def destination(p: Column, brg, metres) -> Column:
    c = geom.destination_of(x(p), y(p), brg, metres, EARTH_M)
    return Point(c["x"], c["y"])


project = destination


def midpoint_of(lon1, lat1, lon2, lat2) -> Column:
    """struct<x, y, z>: half-way on the great circle."""
    a1, a2, o1, d = F.radians(lat1), F.radians(lat2), F.radians(lon1), F.radians(lon2) - F.radians(lon1)
    bx, by = F.cos(a2) * F.cos(d), F.cos(a2) * F.sin(d)
    lat = F.atan2(F.sin(a1) + F.sin(a2), F.sqrt((F.cos(a1) + bx) * (F.cos(a1) + bx) + by * by))
    return coord(F.degrees(o1 + F.atan2(by, F.cos(a1) + bx)), F.degrees(lat))


def midpoint(p: Column, q: Column) -> Column:
    c = midpoint_of(x(p), y(p), x(q), y(q))
    return Point(c["x"], c["y"])


def interpolate(p: Column, q: Column, f: float) -> Column:
    """The point at this share of the great circle from p to q."""
    a1, a2, o1, o2 = F.radians(y(p)), F.radians(y(q)), F.radians(x(p)), F.radians(x(q))
    d = geom.haversine(x(p), y(p), x(q), y(q), 1.0)
    wa, wb = F.sin((1 - f) * d) / F.nullif(F.sin(d), F.lit(0.0)), F.sin(f * d) / F.nullif(F.sin(d), F.lit(0.0))
    cx = wa * F.cos(a1) * F.cos(o1) + wb * F.cos(a2) * F.cos(o2)
    cy = wa * F.cos(a1) * F.sin(o1) + wb * F.cos(a2) * F.sin(o2)
    cz = wa * F.sin(a1) + wb * F.sin(a2)
    return F.when(d < 1e-12, Point(x(p), y(p))).otherwise(Point(F.degrees(F.atan2(cy, cx)), F.degrees(F.atan2(cz, F.hypot(cx, cy)))))


def area_geodesic(g: Column) -> Column:
    """Square metres."""
    return geom.area_geodesic(g, EARTH_M)


def buffer(p: Column, metres: float, segments: int = 32) -> Column:
    """A polygon of points at this distance."""
    ring = F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: geom.destination_of(x(p), y(p), (i % segments) * F.lit(360.0 / segments), F.lit(float(metres)), EARTH_M))
    return geom.polygon(ring, srid=4326)


def intersects(a: Column, b: Column) -> Column:
    """By bounding boxes."""
    return geom.bbox_meet(geom.envelope(a), geom.envelope(b))


def contains(a: Column, b: Column) -> Column:
    """By bounding boxes."""
    e, f = geom.envelope(a), geom.envelope(b)
    return (e["minx"] <= f["minx"]) & (e["miny"] <= f["miny"]) & (e["maxx"] >= f["maxx"]) & (e["maxy"] >= f["maxy"])


def within(a: Column, b: Column) -> Column:
    return contains(b, a)


def to_geometry(g: Column) -> Column:
    return geom.set_srid(g, 0)


# reference systems


def systems(spark: SparkSession) -> DataFrame:
    """The known systems as a table of five rows."""
    return spark.createDataFrame([(*s, wkt_of(s)) for s in SYSTEMS], "epsg int, name string, is_geographic boolean, units string, datum string, ellipsoid string, proj4 string, west double, south double, east double, north double, wkt string").withColumn("is_projected", ~F.col("is_geographic"))


def wkt_of(s: tuple) -> str:
    """The system's definition as well-known text."""
    ellipsoid = f'DATUM["{s[4]}",ELLIPSOID["{s[5]}",{ELLIPSOIDS[s[5]]}]]'
    if s[2]:
        return f'GEOGCRS["{s[1]}",{ellipsoid},CS[ellipsoidal,2],AXIS["latitude",north],AXIS["longitude",east],UNIT["degree",0.0174532925199433]]'
    return f'PROJCRS["{s[1]}",BASEGEOGCRS["WGS 84",{ellipsoid}],CONVERSION["Popular Visualisation Pseudo-Mercator"],CS[Cartesian,2],AXIS["easting",east],AXIS["northing",north],UNIT["metre",1]]'


def from_epsg(df: DataFrame, code: str) -> DataFrame:
    """df with crs: the system of the code in this column, null for unknown codes."""
    known = systems(df.sparkSession)
    return df.join(F.broadcast(known.select(F.col("epsg").alias("_epsg"), F.struct(*known.columns).alias("crs"))), F.col(code) == F.col("_epsg"), "left").drop("_epsg")


def utm_zone(lon: Column) -> Column:
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def utm_name(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("WGS 84 / UTM zone "), utm_zone(lon).cast("string"), F.when(lat >= 0, F.lit("N")).otherwise(F.lit("S")))


def utm_of(lon: Column, lat: Column) -> Column:
    """struct<x, y, z>: easting and northing on the WGS 84 ellipsoid (Krueger's series to the third order)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    big = MAJOR_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    k = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    d = F.radians(lon - (utm_zone(lon) * 6 - 183))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = eta + sum((F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    north = xi + sum((F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    return coord(500000 + 0.9996 * big * east, F.when(lat >= 0, 0.0).otherwise(10000000.0) + 0.9996 * big * north)


def to_utm(g: Column) -> Column:
    """The geometry in the zone of the mean of its vertices."""
    c = geom.mean_coord(geom.coords(g))
    return geom.set_srid(geom.mapped(g, lambda p: utm_of(p["x"], p["y"])), utm_epsg(c["x"], c["y"]))


# transforms


def mercator_of(lon: Column, lat: Column) -> Column:
    """struct<x, y, z> in EPSG:3857 by the ellipsoid's axis."""
    return coord(lon * F.lit(MAJOR_AXIS) * F.lit(math.pi) / 180, F.lit(MAJOR_AXIS) * F.ln(F.tan(F.lit(math.pi / 4) + lat * F.lit(math.pi) / 360)))


def mercator_back(mx: Column, my: Column) -> Column:
    return coord(mx / MAJOR_AXIS * 180 / F.lit(math.pi), (2 * F.atan(F.exp(my / MAJOR_AXIS)) - F.lit(math.pi / 2)) * 180 / F.lit(math.pi))


def transform_coord(c: Column, source: int, target: int) -> Column:
    for code in (source, target):
        if code != source and source == target or code not in (*SAME_DATUM, 3857):
            raise ValueError(f"transform of EPSG:{code} not supported")
    if source == target or (source != 3857 and target != 3857):
        return c
    moved = mercator_of(c["x"], c["y"]) if target == 3857 else mercator_back(c["x"], c["y"])
    return coord(moved["x"], moved["y"], c["z"])


def transform(g: Column, source: int, target: int) -> Column:
    return geom.set_srid(geom.mapped(g, lambda c: transform_coord(c, source, target)), target)


def to_web_mercator(g: Column, source: int = 4326) -> Column:
    return transform(g, source, 3857)


def from_web_mercator(g: Column, target: int = 4326) -> Column:
    return transform(g, 3857, target)
