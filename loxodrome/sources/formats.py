"""Spatial text and binary formats to and from geometry columns: WKT, GeoJSON, WKB in hex, KML, GPX."""

from __future__ import annotations

import json
import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.functions import geom
from loxodrome.functions.geom import GEOM

#: Depth of the coordinate lists of each kind: 0 a coordinate, 1 a line, 2 rings or lines, 3 polygons.
DEPTH = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}
WKB_CODES = {"Point": 1, "LineString": 2, "Polygon": 3}
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def number_text(x: Column) -> Column:
    """As %g in its shortest form: exponents from 21 digits on or below 1e-4, no trailing .0."""
    text = F.regexp_replace(x.cast("string"), r"\.0$", "")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"0+$", ""), r"\.$", "")
    return F.when((F.abs(x) >= 1e7) & (F.abs(x) < 1e21) & (x == F.floor(x)), F.format_string("%.0f", x)).when(text.contains("E") & (F.abs(x) < 1e21) & (F.abs(x) >= 1e-4), plain).otherwise(F.lower(text))


def _coord_text(c: Column, sep: str) -> Column:
    return F.concat(number_text(c["x"]), F.lit(sep), number_text(c["y"]), F.when(c["z"].isNotNull(), F.concat(F.lit(sep), number_text(c["z"]))).otherwise(""))


def to_wkt(g: Column) -> Column:
    line = lambda l: F.array_join(F.transform(l, lambda c: _coord_text(c, " ")), ", ")
    paren = lambda s: F.concat(F.lit("("), s, F.lit(")"))
    rings = lambda p: F.array_join(F.transform(p, lambda l: paren(line(l))), ", ")
    kind, parts = g["kind"], g["parts"]
    body = (
        F.when(kind.isin("Point", "LineString"), line(geom.exterior(g)))
        .when(kind == "Polygon", rings(geom.rings(g)))
        .when(kind == "MultiPoint", F.array_join(F.transform(parts, lambda p: paren(line(F.get(p, F.lit(0))))), ", "))
        .when(kind == "MultiLineString", F.array_join(F.transform(parts, lambda p: paren(line(F.get(p, F.lit(0))))), ", "))
        .otherwise(F.array_join(F.transform(parts, lambda p: paren(rings(p))), ", "))
    )
    z = F.when(F.exists(geom.coords(g), lambda c: c["z"].isNotNull()), " Z").otherwise("")
    return F.when(geom.num_points(g) == 0, F.concat(F.upper(kind), F.lit(" EMPTY"))).otherwise(F.concat(F.upper(kind), z, F.lit(" "), paren(body)))


def parse_wkt_point(s: Column) -> Column:
    """POINT by expressions alone; null for anything else."""
    m = rf"^\s*(?i:POINT)(?:\s*(?i:Z))?\s*\(\s*({NUMBER})\s+({NUMBER})(?:\s+({NUMBER}))?\s*\)\s*$"
    part = lambda k: F.regexp_extract(s, m, k).try_cast("double")
    return F.when(s.rlike(m), geom.point(part(1), part(2), part(3)))


def _parts_of(kind: str, nested) -> list:
    """Lists of coordinates, as deep as the kind has them, as parts of lines."""
    if kind == "Point":
        return [[[nested]]] if nested else []
    if kind == "LineString":
        return [[nested]]
    if kind == "MultiPoint":
        return [[[c]] for c in nested]
    if kind == "Polygon":
        return [nested]
    if kind == "MultiLineString":
        return [[line] for line in nested]
    return nested


def _row(kind: str, nested) -> dict:
    c = lambda p: {"x": float(p[0]), "y": float(p[1]), "z": float(p[2]) if len(p) > 2 else None}
    return {"kind": kind, "srid": 0, "parts": [[[c(p) for p in line] for line in part] for part in _parts_of(kind, nested)]}


def wkt_rows(text: str) -> list[dict]:
    """The geometries in a text: one, or the members of a collection. A ValueError for anything else."""
    tokens = re.findall(rf"{NUMBER}|[A-Za-z]+|[(),]", text)
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal at
        t = peek()
        if not t or want is not None and t != want:
            raise ValueError(f"WKT: expected {want or 'more'}, found {t or 'the end'}")
        at += 1
        return t

    def nested(depth: int):
        if depth == 0:
            out = [float(take())]
            while re.fullmatch(NUMBER, peek()):
                out.append(float(take()))
            return out
        take("(")
        out = [nested(depth - 1)]
        while peek() == ",":
            take(",")
            out.append(nested(depth - 1))
        take(")")
        return out

    def one() -> list[dict]:
        word = take().upper()
        if peek().upper() in ("Z", "M", "ZM"):
            take()
        if word == "GEOMETRYCOLLECTION":
            if peek().upper() == "EMPTY":
                take()
                return []
            take("(")
            out = one()
            while peek() == ",":
                take(",")
                out += one()
            take(")")
            return out
        kind = next((k for k in DEPTH if k.upper() == word), None)
        if kind is None:
            raise ValueError(f"WKT: unknown type {word}")
        if peek().upper() == "EMPTY":
            take()
            return [_row(kind, [])]
        if kind == "Point":
            take("(")
            c = nested(0)
            take(")")
            return [_row(kind, c)]
        if kind == "MultiPoint" and tokens[at + 1 : at + 2] == ["("]:
            return [_row(kind, [p[0] for p in nested(2)])]
        return [_row(kind, nested(DEPTH[kind]))]

    out = one()
    if at != len(tokens):
        raise ValueError("WKT: text after the geometry")
    return out


def geojson_rows(text: str) -> list[dict]:
    """geometry, properties (printed values) and id of each feature in a geometry, Feature or FeatureCollection."""

    def geometries(g) -> list[dict]:
        if g is None:
            return []
        if g["type"] == "GeometryCollection":
            return [r for m in g["geometries"] for r in geometries(m)]
        return [_row(g["type"], g["coordinates"])]

    def show(v):
        return v if isinstance(v, str) or v is None else json.dumps(v)

    def of(o) -> list[dict]:
        if o["type"] == "FeatureCollection":
            return [r for f in o["features"] for r in of(f)]
        if o["type"] == "Feature":
            return [{"geometry": g, "properties": {k: show(v) for k, v in (o.get("properties") or {}).items()}, "id": show(o.get("id"))} for g in geometries(o.get("geometry"))]
        return [{"geometry": g, "properties": {}, "id": None} for g in geometries(o)]

    return of(json.loads(text))


def _wkt_series(s: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else wkt_rows(t) for t in s])


def _geojson_series(s: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else geojson_rows(t) for t in s])


def _wkt(s: Column) -> Column:
    return F.pandas_udf(_wkt_series, f"array<{GEOM}>")(s)


def _geojson(s: Column) -> Column:
    return F.pandas_udf(_geojson_series, f"array<struct<geometry:{GEOM},properties:map<string,string>,id:string>>")(s)


def parse_wkt(s: Column) -> Column:
    """The geometry in a text of any kind but a collection."""
    return F.get(_wkt(s), F.lit(0))


def parse_wkt_collection(s: Column) -> Column:
    return _wkt(s)


def parse_geojson(s: Column) -> Column:
    return F.get(_geojson(s), F.lit(0))["geometry"]


def features(df: DataFrame, column: str) -> DataFrame:
    """A row (geometry, properties, id) for each feature in texts of GeoJSON."""
    return df.select(F.explode(_geojson(F.col(column))).alias("f")).select("f.*")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """The features of files of GeoJSON, one document a file."""
    return features(spark.read.text(path, wholetext=True), "value")


def to_geojson(g: Column) -> Column:
    """A geometry object; keys in alphabetical order."""
    c = lambda p: F.concat(F.lit("["), _coord_text(p, ","), F.lit("]"))
    many = lambda a, f: F.concat(F.lit("["), F.array_join(F.transform(a, f), ","), F.lit("]"))
    line = lambda l: many(l, c)
    kind, parts = g["kind"], g["parts"]
    body = (
        F.when(kind == "Point", c(geom.coord_of(g)))
        .when(kind == "LineString", line(geom.exterior(g)))
        .when(kind == "Polygon", many(geom.rings(g), line))
        .when(kind == "MultiPoint", many(parts, lambda p: c(F.get(F.get(p, F.lit(0)), F.lit(0)))))
        .when(kind == "MultiLineString", many(parts, lambda p: line(F.get(p, F.lit(0)))))
        .otherwise(many(parts, lambda p: many(p, line)))
    )
    return F.concat(F.lit('{"coordinates":'), body, F.lit(',"type":"'), kind, F.lit('"}'))


def to_feature(g: Column, properties: Column, id_: Column | None = None) -> Column:
    """A Feature; properties: map or struct."""
    own = F.concat(F.lit('"id":'), F.to_json(F.array(id_)).substr(F.lit(2), F.char_length(F.to_json(F.array(id_))) - 2), F.lit(",")) if id_ is not None else F.lit("")
    return F.concat(F.lit('{"geometry":'), to_geojson(g), F.lit(","), own, F.lit('"properties":'), F.to_json(properties), F.lit(',"type":"Feature"}'))


def to_feature_collection(df: DataFrame, shape: str, properties: list[str], path: str) -> None:
    """The rows as files of GeoJSON features, one a line."""
    df.select(to_feature(F.col(shape), F.struct(*properties)).alias("value")).write.mode("overwrite").text(path)


def wkb_hex(g: dict) -> str:
    """Little-endian, two-dimensional, upper-case hex, of a Point, LineString or Polygon."""
    kind = g["kind"]
    if kind not in WKB_CODES:
        raise ValueError(f"WKB: unsupported type {kind}")
    xy = lambda c: struct.pack("<2d", c["x"], c["y"])
    lines = g["parts"][0] if len(g["parts"]) else []
    head = struct.pack("<BI", 1, WKB_CODES[kind])
    if kind == "Point":
        return (head + xy(lines[0][0])).hex().upper()
    body = b"".join(struct.pack("<I", len(line)) + b"".join(map(xy, line)) for line in lines)
    return (head + (struct.pack("<I", len(lines)) if kind == "Polygon" else b"") + body).hex().upper()


def wkb_row(text: str) -> dict:
    """A Point, LineString or Polygon of hex in either byte order."""
    raw = bytes.fromhex(text)
    e = "<" if raw[0] == 1 else ">"
    code, at = struct.unpack_from(f"{e}I", raw, 1)[0], 5

    def line() -> list:
        nonlocal at
        n = struct.unpack_from(f"{e}I", raw, at)[0]
        flat = struct.unpack_from(f"{e}{2 * n}d", raw, at + 4)
        at += 4 + 16 * n
        return list(zip(flat[::2], flat[1::2], strict=True))

    if code == 1:
        return _row("Point", list(struct.unpack_from(f"{e}2d", raw, at)))
    if code == 2:
        return _row("LineString", line())
    if code == 3:
        n = struct.unpack_from(f"{e}I", raw, at)[0]
        at += 4
        return _row("Polygon", [line() for _ in range(n)])
    raise ValueError(f"WKB: unsupported type {code}")


def _float_hex(x: Column) -> Column:
    """A double's eight bytes, little-endian, as hex: by the arithmetic of sign, exponent and fraction."""
    a = F.abs(x)
    e = F.when(a == 0, F.lit(0)).otherwise(F.floor(F.log2(F.greatest(a, F.lit(1e-300)))).cast("int"))
    # log2 may be off by one at powers of two
    e = F.when((a > 0) & (a < F.pow(F.lit(2.0), e)), e - 1).when((a > 0) & (a >= F.pow(F.lit(2.0), e + 1)), e + 1).otherwise(e)
    frac = F.when(a == 0, F.lit(0).cast("bigint")).otherwise(((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(1 << 52))).cast("bigint"))
    bits = F.when(a == 0, F.lit(0).cast("bigint")).otherwise(F.shiftleft((e + 1023).cast("bigint"), 52).bitwiseOR(frac))
    bits = F.when(x < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)
    big = F.lpad(F.hex(bits), 16, "0")
    return F.concat(*[F.substring(big, 15 - 2 * k, 2) for k in range(8)])


def point_to_wkb(x: Column, y: Column) -> Column:
    """A point's WKB by expressions alone."""
    return F.concat(F.lit("0101000000"), _float_hex(x), _float_hex(y))


def _to_wkb_series(kind: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else wkb_hex({"kind": k, "parts": p}) for k, p in zip(kind, parts, strict=True)])


def _from_wkb_series(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([{"kind": None, "srid": None, "parts": None} if t is None else wkb_row(t) for t in s])


def to_wkb(g: Column) -> Column:
    return F.pandas_udf(_to_wkb_series, "string")(g["kind"], g["parts"])


def from_wkb(s: Column) -> Column:
    return F.pandas_udf(_from_wkb_series, GEOM)(s)


def to_kml(g: Column) -> Column:
    """A bare element; elevation 0 where there is none."""
    text = lambda l: F.array_join(F.transform(l, lambda c: F.concat(number_text(c["x"]), F.lit(","), number_text(c["y"]), F.lit(","), number_text(F.coalesce(c["z"], F.lit(0.0))))), " ")
    tag = lambda name, s: F.concat(F.lit(f"<{name}>"), s, F.lit(f"</{name}>"))
    at = lambda l: tag("coordinates", text(l))
    poly = lambda p: tag("Polygon", F.concat(tag("outerBoundaryIs", tag("LinearRing", at(F.get(p, F.lit(0))))), F.array_join(F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda h: tag("innerBoundaryIs", tag("LinearRing", at(h)))), "")))
    kind, parts = g["kind"], g["parts"]
    each = lambda f: tag("MultiGeometry", F.array_join(F.transform(parts, f), ""))
    first = lambda p: F.get(p, F.lit(0))
    return (
        F.when(kind == "Point", tag("Point", at(geom.exterior(g))))
        .when(kind == "LineString", tag("LineString", at(geom.exterior(g))))
        .when(kind == "Polygon", poly(geom.rings(g)))
        .when(kind == "MultiPoint", each(lambda p: tag("Point", at(first(p)))))
        .when(kind == "MultiLineString", each(lambda p: tag("LineString", at(first(p)))))
        .otherwise(each(poly))
    )


def kml_rows(text: str) -> list[dict]:
    """The geometries in a KML element, in order."""
    import xml.etree.ElementTree as ET

    def name(e) -> str:
        return e.tag.rpartition("}")[2]

    def line(e) -> list:
        found = next(x for x in e.iter() if name(x) == "coordinates")
        return [[float(v) for v in c.split(",")] for c in (found.text or "").split()]

    def of(e) -> list[dict]:
        if name(e) == "Point":
            return [_row("Point", line(e)[0])]
        if name(e) == "LineString":
            return [_row("LineString", line(e))]
        if name(e) == "Polygon":
            outer = [line(x) for x in e if name(x) == "outerBoundaryIs"]
            return [_row("Polygon", outer + [line(x) for x in e if name(x) == "innerBoundaryIs"])]
        return [r for x in e for r in of(x)]

    return of(ET.fromstring(text))


def _kml_series(s: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else kml_rows(t) for t in s])


def from_kml(s: Column) -> Column:
    """array of the geometries in the element."""
    return F.pandas_udf(_kml_series, f"array<{GEOM}>")(s)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat, ele, time of the track points in GPX files."""
    schema = "_lat double, _lon double, ele double, time timestamp"
    return spark.read.format("xml").option("rowTag", "trkpt").schema(schema).load(path).select(F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), "ele", "time")


def to_gpx(g: Column) -> Column:
    """A line as a GPX track."""
    pt = lambda c: F.concat(F.lit('<trkpt lat="'), number_text(c["y"]), F.lit('" lon="'), number_text(c["x"]), F.lit('">'), F.when(c["z"].isNotNull(), F.concat(F.lit("<ele>"), number_text(c["z"]), F.lit("</ele>"))).otherwise(""), F.lit("</trkpt>"))
    return F.concat(F.lit('<gpx version="1.1" creator="loxodrome"><trk><trkseg>'), F.array_join(F.transform(geom.coords(g), pt), ""), F.lit("</trkseg></trk></gpx>"))


def to_ewkb(g: Column) -> Column:
    """WKB with the SRID behind the type code."""
    plain, code = to_wkb(g), F.lpad(F.hex(g["srid"]), 8, "0")
    little = F.concat(*[F.substring(code, 7 - 2 * k, 2) for k in range(4)])
    return F.concat(F.substring(plain, 1, 8), F.lit("20"), little, F.substring(plain, F.lit(11), F.char_length(plain)))


def from_ewkb(s: Column) -> Column:
    srid = F.concat(*[F.substring(s, 17 - 2 * k, 2) for k in range(4)])
    return geom.set_srid(from_wkb(F.concat(F.substring(s, 1, 8), F.lit("00"), F.substring(s, F.lit(19), F.char_length(s)))), F.conv(srid, 16, 10).cast("int"))
