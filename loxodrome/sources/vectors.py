"""Vector and raster files: Shapefile, GeoPackage, CSV with a geometry column, ESRI's ASCII grids.

A file of these kinds is read by one task (they can't be split), many files by many. Writers make one
file for each partition of the table, so that no task or driver holds more than a partition.
"""

from __future__ import annotations

import sqlite3
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.functions import overlay
from loxodrome.functions.geom import GEOM
from loxodrome.sources import files, formats

#: Shape types of the format (the 11s and 21s carry further numbers that aren't read).
SHAPES = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
FEATURES = f"array<struct<geometry:{GEOM},attributes:map<string,string>>>"


# Shapefile


def _shape(raw: bytes) -> dict | None:
    """The geometry of one record; None of a null shape. The outer rings of polygons run clockwise, holes the other way."""
    kind = SHAPES.get(struct.unpack_from("<i", raw)[0] % 10)
    if kind is None:
        return None
    if kind == "Point":
        return formats._row("Point", list(struct.unpack_from("<2d", raw, 4)))
    if kind == "MultiPoint":
        n = struct.unpack_from("<i", raw, 36)[0]
        flat = struct.unpack_from(f"<{2 * n}d", raw, 40)
        return formats._row("MultiPoint", list(zip(flat[::2], flat[1::2], strict=True)))
    parts, points = struct.unpack_from("<2i", raw, 36)
    starts = [*struct.unpack_from(f"<{parts}i", raw, 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", raw, 44 + 4 * parts)
    lines = [list(zip(flat[2 * a : 2 * b : 2], flat[2 * a + 1 : 2 * b : 2], strict=True)) for a, b in zip(starts, starts[1:], strict=False)]
    if kind == "LineString":
        return formats._row("LineString", lines[0]) if parts == 1 else formats._row("MultiLineString", lines)
    polygons = overlay.nested([line[::-1] for line in lines])
    return formats._row("Polygon", polygons[0]) if len(polygons) == 1 else formats._row("MultiPolygon", polygons)


def shapes_of(raw: bytes) -> list[dict | None]:
    if struct.unpack_from(">i", raw)[0] != 9994:
        raise ValueError("not a Shapefile")
    out, at = [], 100
    while at + 8 <= len(raw):
        words = struct.unpack_from(">i", raw, at + 4)[0]
        out.append(_shape(raw[at + 8 : at + 8 + 2 * words]))
        at += 8 + 2 * words
    return out


def attributes_of(raw: bytes) -> list[dict[str, str]]:
    """The rows of a dBASE table as text."""
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), raw[at + 16]))
        at += 32
    out = []
    for i in range(n):
        row, k = {}, head + i * size + 1
        for name, length in fields:
            row[name] = raw[k : k + length].decode("utf-8", "replace").strip()
            k += length
        out.append(row)
    return out


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """geometry, attributes (printed values) of the records in x.shp and x.dbf; path may be a pattern of .shp files."""
    stem = lambda: F.regexp_replace("path", r"\.\w+$", "")
    load = lambda p, name: spark.read.format("binaryFile").load(p).select(stem().alias("stem"), F.col("content").alias(name))
    both = load(path, "shp").join(load(path.removesuffix(".shp") + ".dbf", "dbf"), "stem", "left")

    @F.pandas_udf(FEATURES)
    def records(shp: pd.Series, dbf: pd.Series) -> pd.Series:
        out = []
        for s, d in zip(shp, dbf, strict=True):
            shapes = shapes_of(s)
            rows = attributes_of(d) if d is not None else [{}] * len(shapes)
            out.append([{"geometry": g, "attributes": a} for g, a in zip(shapes, rows, strict=True)])
        return pd.Series(out)

    return both.select(F.explode(records("shp", "dbf")).alias("f")).select("f.*")


def _content(g: dict) -> tuple[int, bytes, tuple]:
    """Type, content and box of a geometry."""
    kind = g["kind"]
    lists = [[[(c["x"], c["y"]) for c in line] for line in p] for p in g["parts"]]
    flat = [c for p in lists for line in p for c in line]
    xs, ys = [c[0] for c in flat], [c[1] for c in flat]
    box = (min(xs), min(ys), max(xs), max(ys))
    if kind == "Point":
        return 1, struct.pack("<i2d", 1, *flat[0]), box
    if kind == "MultiPoint":
        return 8, struct.pack("<i4di", 8, *box, len(flat)) + b"".join(struct.pack("<2d", *c) for c in flat), box
    if kind.endswith("Polygon"):
        code = 5
        lines = [line if (overlay.signed_area(line) < 0) == (i == 0) else line[::-1] for p in lists for i, line in enumerate(p)]
    else:
        code, lines = 3, [line for p in lists for line in p]
    starts = [sum(map(len, lines[:i])) for i in range(len(lines))]
    return code, struct.pack(f"<i4d2i{len(lines)}i", code, *box, len(lines), len(flat), *starts) + b"".join(struct.pack("<2d", *c) for line in lines for c in line), box


def shapefile_bytes(rows: list[tuple[dict, dict]]) -> tuple[bytes, bytes, bytes]:
    """The .shp, .shx and .dbf of geometries of one kind with their attributes."""
    made = [_content(g) for g, _ in rows]
    if len({m[0] for m in made}) > 1:
        raise ValueError("a Shapefile holds geometries of one kind")
    box = [f(m[2][i] for m in made) for i, f in enumerate((min, min, max, max))] if made else [0.0] * 4
    body, index, at = b"", b"", 50
    for i, (_, raw, _box) in enumerate(made, 1):
        index += struct.pack(">2i", at, len(raw) // 2)
        body += struct.pack(">2i", i, len(raw) // 2) + raw
        at += 4 + len(raw) // 2

    def head(size: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + size) // 2) + struct.pack("<2i8d", 1000, made[0][0] if made else 0, *box, 0, 0, 0, 0)

    names = list(dict.fromkeys(k for _, a in rows for k in a))
    cells = [[(a.get(k) or "").encode()[:254] for k in names] for _, a in rows]
    width = [max([1, *[len(c[i]) for c in cells]]) for i in range(len(names))]
    fields = b"".join(struct.pack("<11scI2B14x", k.encode("latin-1")[:10], b"C", 0, w, 0) for k, w in zip(names, width, strict=True))
    table = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(names), 1 + sum(width)) + fields + b"\r"
    table += b"".join(b" " + b"".join(c.ljust(w) for c, w in zip(row, width, strict=True)) for row in cells) + b"\x1a"
    return head(len(body)) + body, head(len(index)) + index, table


def _by_partition(df: DataFrame, shape: str, attributes: list[str], make, names: list[str]) -> DataFrame:
    """part and a binary column of each name: make(rows) of the rows of each partition that has some."""

    def run(batches):
        rows: list = []
        for pdf in batches:
            rows += [({"kind": k, "parts": p}, {a: v for a, v in zip(attributes, row, strict=True) if v is not None}) for k, p, row in zip(pdf["kind"], pdf["parts"], pdf[attributes].itertuples(index=False), strict=True)]
        if rows:
            from pyspark import TaskContext

            yield pd.DataFrame([(TaskContext.get().partitionId(), *make(rows))], columns=["part", *names])

    own = df.select(F.col(shape)["kind"].alias("kind"), F.col(shape)["parts"].alias("parts"), *[F.col(a).cast("string").alias(a) for a in attributes])
    return own.mapInPandas(run, "part int, " + ", ".join(f"{n} binary" for n in names))


def write_shapefile(df: DataFrame, path: str, shape: str, attributes: list[str]) -> list[str]:
    """path/part-n.shp with .shx and .dbf for each partition; the paths of the .shp files. One partition passes the driver at a time."""
    out = []
    for r in _by_partition(df, shape, attributes, shapefile_bytes, ["shp", "shx", "dbf"]).toLocalIterator():
        stem = f"{path}/part-{r['part']:05d}"
        for ending in ("shp", "shx", "dbf"):
            files.write_bytes(df.sparkSession, f"{stem}.{ending}", r[ending])
        out.append(f"{stem}.shp")
    return out


# GeoPackage


def _blob(g: dict, srid: int = 4326) -> bytes:
    return b"GP" + struct.pack("<BBi", 0, 1, srid) + bytes.fromhex(formats.wkb_hex(g))


def _unblob(raw: bytes) -> dict:
    envelope = (0, 32, 48, 48, 64)[raw[3] >> 1 & 7]
    return formats.wkb_row(raw[8 + envelope :].hex())


def geopackage_bytes(layer: str, rows: list[tuple[dict, dict]]) -> bytes:
    names = list(dict.fromkeys(k for _, a in rows for k in a))
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    with sqlite3.connect(":memory:") as db:
        db.execute("pragma application_id = 1196444487")
        db.execute("create table gpkg_contents (table_name text primary key, data_type text, identifier text, srs_id integer)")
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z tinyint, m tinyint)")
        db.execute("insert into gpkg_contents values (?, 'features', ?, 4326)", (layer, layer))
        db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', 4326, 0, 0)", (layer,))
        db.execute(f"create table {quoted(layer)} (fid integer primary key, geom blob{''.join(f', {quoted(n)} text' for n in names)})")
        db.executemany(f"insert into {quoted(layer)} values (null, ?{', ?' * len(names)})", [(_blob(g), *[a.get(n) for n in names]) for g, a in rows])
        db.commit()
        return db.serialize()


def geopackage_rows(raw: bytes) -> list[dict]:
    """layer, geometry and attributes of all features."""
    out = []
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(bytes(raw))
        db.row_factory = sqlite3.Row
        for layer, column in [tuple(r) for r in db.execute("select table_name, column_name from gpkg_geometry_columns")]:
            for row in db.execute('select * from "' + layer.replace('"', '""') + '"'):
                out.append({"layer": layer, "geometry": _unblob(row[column]) if row[column] else None, "attributes": {k: str(row[k]) for k in row.keys() if k != column and row[k] is not None}})
    finally:
        db.close()
    return out


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    """layer, geometry, attributes (printed values) of the features in GeoPackages."""

    @F.pandas_udf(f"array<struct<layer:string,geometry:{GEOM},attributes:map<string,string>>>")
    def features(content: pd.Series) -> pd.Series:
        return pd.Series([geopackage_rows(c) for c in content])

    return spark.read.format("binaryFile").load(path).select(F.explode(features("content")).alias("f")).select("f.*")


def write_geopackage(df: DataFrame, path: str, layer: str, shape: str, attributes: list[str]) -> list[str]:
    """path/part-n.gpkg for each partition; their paths. One partition passes the driver at a time."""
    out = []
    for r in _by_partition(df, shape, attributes, lambda rows: (geopackage_bytes(layer, rows),), ["gpkg"]).toLocalIterator():
        out.append(f"{path}/part-{r['part']:05d}.gpkg")
        files.write_bytes(df.sparkSession, out[-1], r["gpkg"])
    return out


# CSV with a geometry column, and rasters


def read_geo_csv(spark: SparkSession, path: str, schema: str, column: str, kind: str = "wkt") -> DataFrame:
    """A CSV with headers, whose column of well-known text (or wkb, or geojson) becomes a geometry."""
    parse = {"wkt": formats.parse_wkt, "wkb": formats.from_wkb, "geojson": formats.parse_geojson}[kind]
    return spark.read.csv(path, schema=schema, header=True, escape='"').withColumn(column, parse(F.col(column)))


def write_geo_csv(df: DataFrame, path: str, column: str) -> None:
    df.withColumn(column, formats.to_wkt(F.col(column))).write.mode("overwrite").csv(path, header=True, escape='"')


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col, value, and the grid's minx, maxy and cell; cells without data are left out."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("lines"))

    def own(name: str, other: float | None) -> Column:
        """The number in the header line of this name."""
        found = F.get(F.filter("lines", lambda line: F.lower(line).startswith(name)), F.lit(0))
        return F.coalesce(F.regexp_extract(found, r"(\S+)\s*$", 1).try_cast("double"), F.lit(other).cast("double"))

    size, rows = own("cellsize", None), own("nrows", None)
    minx = F.coalesce(own("xllcorner", None), own("xllcenter", None) - size / 2)
    miny = F.coalesce(own("yllcorner", None), own("yllcenter", None) - size / 2)
    data = F.filter("lines", lambda line: line.rlike(r"^\s*[-+.\d]"))
    each = text.select("path", minx.alias("minx"), (miny + rows * size).alias("maxy"), size.alias("cell"), own("nodata_value", -9999.0).alias("none"), F.posexplode(data).alias("row", "line"))
    cells = each.select("path", "minx", "maxy", "cell", "none", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "text"))
    return cells.withColumn("value", F.col("text").cast("double")).filter("value <> none").select("path", "row", "col", "value", "minx", "maxy", "cell")


def ascii_grid(a: DataFrame, width: int, minx: float, miny: float, cell: float, height: int) -> DataFrame:
    """value: the lines of a grid in order of ``at`` (header lines first), a line for each row of cells; cells that are missing are written as -9999."""
    lines = a.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: formats.number_text(F.coalesce(F.try_element_at("m", c), F.lit(-9999.0)))), " ")
    spark = a.sparkSession
    head = [f"ncols {width}", f"nrows {height}", f"xllcorner {minx}", f"yllcorner {miny}", f"cellsize {cell}", "NODATA_value -9999"]
    empty = " ".join(["-9999"] * width)
    own = spark.range(height).select(F.col("id").cast("int").alias("row")).join(lines, "row", "left").select((F.col("row") + len(head)).alias("at"), F.when(F.col("m").isNull(), F.lit(empty)).otherwise(text).alias("value"))
    return spark.createDataFrame(list(enumerate(head)), "at int, value string").unionByName(own)
