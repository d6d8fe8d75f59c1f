"""Values that are known in advance: measures, statistics, formats, symbols, streams of edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loxodrome.functions import arrays, core, dates, geog, geom, grids, linalg, lists, maps, mathx, numeric, strings, symbolic
from loxodrome.operators import analysis, frame, functional, quality, spatial, stats
from loxodrome.sources import files, formats


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def ring(*xy):
    return F.array(*[geom.coord(x, y) for x, y in xy])


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]


def test_squares(spark):
    g = geom.polygon(ring(*SQUARE))
    hole = geom.polygon(ring(*SQUARE), ring((2, 2), (8, 2), (8, 8), (2, 8), (2, 2)))
    c = geom.centroid(g)
    assert one(spark, geom.area(g), geom.area(hole), geom.x(c), geom.y(c)) == (100.0, 64.0, 5.0, 5.0)
    inside = lambda a, x, y: geom.contains(a, geom.point(x, y))
    assert one(spark, inside(g, 5, 5), inside(g, 15, 5), inside(hole, 5, 5), inside(hole, 1, 1)) == (True, False, False, True)


def test_relations(spark):
    a = geom.polygon(ring(*SQUARE))
    b = geom.polygon(ring((5, 5), (15, 5), (15, 15), (5, 15), (5, 5)))
    far = geom.polygon(ring((50, 50), (51, 50), (51, 51), (50, 51), (50, 50)))
    line = geom.line(ring((5, 5), (20, 5)))
    assert one(spark, geom.intersects(a, b), geom.overlaps(a, b), geom.disjoint(a, far), geom.crosses(line, a), geom.touches(a, b), geom.equals(a, a)) == (True,) * 6


def test_lines(spark):
    g = geom.line(ring((0, 0), (3, 0), (3, 4)))
    part = geom.substring(g, 0.0, 3 / 7)
    assert one(spark, geom.length(g), geom.length(part), geom.is_simple(g), geom.is_closed(g)) == (7.0, pytest.approx(3.0), True, False)
    crossed = geom.line(ring((0, 0), (2, 2), (2, 0), (0, 2)))
    assert one(spark, geom.is_simple(crossed)) is False
    merged = geom.merge(g, geom.line(ring((3, 4), (9, 4))))
    assert one(spark, geom.num_points(merged)) == 4


def test_hull_simplify_buffer(spark):
    pts = geom.multipoint(ring((0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (1, 3)))
    assert one(spark, geom.area(geom.convex_hull(pts))) == 16.0
    g = geom.line(ring((0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)))
    assert one(spark, geom.num_points(geom.simplify(g, 0.1))) == 4
    assert one(spark, geom.area(geom.buffer(geom.point(0, 0), 1.0))) == pytest.approx(math.pi, abs=0.03)
    assert one(spark, geom.area(geom.buffer(geom.line(ring((0, 0), (10, 0))), 1.0))) == pytest.approx(20 + math.pi, abs=0.05)


def test_london(spark):
    ny, london = geom.point(-74.006, 40.7128), geom.point(-0.1278, 51.5074)
    km, m = one(spark, geom.distance_geodesic(ny, london), geog.distance_great_circle(ny, london))
    assert 5500 < km < 5600 and m == pytest.approx(km * 1000)
    half = geog.interpolate(ny, london, 0.5)
    mid = geog.midpoint(ny, london)
    assert one(spark, geom.x(half), geom.y(half)) == pytest.approx(one(spark, geom.x(mid), geom.y(mid)))


def test_utm(spark):
    """Known: the CN Tower is at 630084 m E, 4833439 m N in zone 17N."""
    p = geog.to_utm(geom.point(-79.387139, 43.642567))
    x, y, epsg = one(spark, geom.x(p), geom.y(p), geom.srid(p))
    assert (round(x), round(y), epsg) == (630084, 4833439, 32617)


def test_transforms(spark):
    p = geom.point(-73.9857, 40.7484)
    back = geom.project(geom.project(p, 4326, 3857), 3857, 4326)
    assert one(spark, geom.x(back), geom.y(back)) == pytest.approx((-73.9857, 40.7484), abs=1e-9)
    with pytest.raises(ValueError):
        geom.project(p, 4326, 32633)
    assert geog.systems(spark).count() == 5


def test_cells(spark):
    i = grids.h3_from_lat_lon(F.lit(37.7749), F.lit(-122.4194), 9)
    ring_ = grids.h3_k_ring(i, 1)
    assert one(spark, grids.h3_resolution(i), grids.h3_is_valid(i), F.size(ring_), F.size(grids.h3_children(i, 10)), grids.h3_parent(F.get(grids.h3_children(i, 10), F.lit(3)), 9) == i) == (9, True, 9, 4, True)
    c = grids.s2_from_lat_lon(F.lit(37.7749), F.lit(-122.4194), 12)
    assert one(spark, grids.s2_level(c), grids.s2_is_valid(c), F.size(grids.s2_children(c)), grids.s2_from_token(grids.s2_to_token(c))["value"] == c) == (12, True, 4, True)


@pytest.mark.parametrize(
    "text",
    ["POINT (1 2)", "POINT Z (1 2 3)", "LINESTRING (0 0, 1 1.5)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "POINT EMPTY"],
)
def test_wkt(spark, text):
    g = formats.parse_wkt(F.lit(text))
    assert one(spark, formats.to_wkt(g)) == text
    if "EMPTY" not in text:
        assert one(spark, geom.equals(formats.parse_geojson(formats.to_geojson(g)), g)) is True
        assert one(spark, F.size(formats.from_kml(formats.to_kml(g)))) == one(spark, geom.num_geometries(g))


def test_wkt_collection_and_errors(spark):
    assert one(spark, F.size(formats.parse_wkt_collection(F.lit("GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))")))) == 2
    assert quality.throws(lambda: one(spark, formats.parse_wkt(F.lit("CIRCLE (1 2)"))))


def test_wkb(spark):
    for text in ("POINT (1 -2.5)", "LINESTRING (0 0, 1 1.5)", "POLYGON ((0 0, 4 0, 4 4, 0 0))"):
        g = geom.set_srid(formats.parse_wkt(F.lit(text)), 4326)
        h, back, e = one(spark, formats.to_wkb(g), formats.to_wkt(formats.from_wkb(formats.to_wkb(g))), geom.srid(formats.from_ewkb(formats.to_ewkb(g))))
        assert back == text and e == 4326 and h.startswith("01")
    assert one(spark, formats.point_to_wkb(F.lit(1.0), F.lit(-2.5))) == one(spark, formats.to_wkb(geom.point(1, -2.5)))
    assert one(spark, formats.to_wkt(formats.from_wkb(F.lit("000000000140000000000000004010000000000000")))) == "POINT (2 4)"


def test_features(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "name string, x double, y double").withColumn("g", geom.point(F.col("x"), F.col("y")))
    formats.to_feature_collection(df, "g", ["name"], str(tmp_path / "f"))
    got = formats.features(spark.read.text(str(tmp_path / "f")), "value").select("properties", formats.to_wkt(F.col("geometry")).alias("w")).first()
    assert got["properties"] == {"name": "a"} and got["w"] == "POINT (1 2)"


def test_statistics(spark):
    df = spark.createDataFrame([(i, float(v), 2.0 * v, 1.0) for i, v in enumerate([2, 4, 4, 4, 5, 5, 7, 9])], "_pos int, x double, y double, w double")
    r = df.agg(stats.variance("x").alias("v"), stats.median("x").alias("m"), stats.percentile("x", 0).alias("p0"), stats.percentile("x", 100).alias("p1"), stats.correlation("x", "y").alias("c"), stats.linreg("x", "y").alias("l"), stats.weighted_mean("x", "w").alias("wm"), stats.mode("x").alias("mode")).first()
    assert r["v"] == pytest.approx(4.571428571428571) and r["m"] == 4.5 and (r["p0"], r["p1"]) == (2.0, 9.0) and r["c"] == pytest.approx(1.0) and r["l"]["slope"] == pytest.approx(2.0) and r["wm"] == 5.0 and r["mode"] == 4.0
    flat = df.withColumn("y", F.lit(3.0)).agg(stats.correlation("x", "y").alias("c"), stats.linreg("x", "y")["r2"].alias("r2")).first()
    assert tuple(flat) == (0.0, 0.0)
    assert df.filter("false").agg(stats.series_mean("x"), stats.series_sum("x"), stats.product("x")).first()[0:3] == (0.0, 0.0, 1.0)
    k = stats.kendall(df, "x", "y").first()[0]
    x = [2, 4, 4, 4, 5, 5, 7, 9]
    want = sum(np.sign(x[j] - x[i]) ** 2 for i in range(8) for j in range(i + 1, 8)) / 28
    assert k == pytest.approx(want)


def test_frame(spark):
    df = frame.from_columns(spark, {"a": [1, 2, 3], "b": [4, 5, 6]})
    assert df.count() == 3 and frame.describe(df).endswith("rows=3)")
    with pytest.raises(ValueError):
        frame.from_columns(spark, {"a": [1], "b": [1, 2]})
    rows = frame.from_rows(spark, [{"a": 1}, {"b": "x"}])
    assert rows.columns == ["a", "b"] and rows.filter("a is null").first()["b"] == "x"
    assert [r["a"] for r in frame.tail(df, ["_pos"], 2).collect()] == [2, 3]
    assert frame.series_from_map(spark, {"z": 1, "a": 2}).orderBy("_pos").first()["idx"] == "a"
    assert frame.drop(df, "nothing", "b").columns == ["_pos", "a"]


def test_strings(spark):
    s = F.lit("héllo wörld")
    assert one(spark, strings.length(s), strings.index_of(s, "w"), strings.char_at(s, 1), strings.slice_(s, -5), strings.capitalize(s), strings.count(s, "")) == (13, 7, "é", "wörld", "Héllo wörld", 12)
    assert one(spark, strings.split(F.lit("a.b.c"), "."), strings.split(F.lit("ab"), "")) == (["a", "b", "c"], ["a", "b"])
    assert one(spark, strings.parse_int(F.lit(" 12abc"))["value"], strings.parse_int(F.lit("x"))["ok"], strings.parse_bool(F.lit("YES"))["value"]) == (12, False, True)
    assert one(spark, strings.pad_start(F.lit("abc"), 2), strings.pad_start(F.lit("a"), 4, "xy"), strings.title_case(F.lit("ab  cD"))) == ("abc", "xyxya", "Ab CD")
    assert one(spark, strings.trim(F.lit("  a  ")), strings.lines(F.lit("a\nb\n"))) == ("a", ["a", "b", ""])


def test_lists_and_maps(spark):
    a = F.array(*[F.lit(x) for x in (5, 1, 4, 1, 3)])
    assert one(spark, lists.take_while(a, lambda x: x > 0), lists.take_while(a, lambda x: x > 4), lists.drop_while(a, lambda x: x > 4), lists.sort_by(a, lambda x: -x), lists.interleave(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(9)))) == ([5, 1, 4, 1, 3], [5], [1, 4, 1, 3], [5, 4, 3, 1, 1], [1, 9, 2, 3])
    assert one(spark, lists.windowed(a, 9), lists.chunked(lists.take(a, 0), 2), lists.intersperse(lists.take(a, 2), 0), lists.distinct_by(a, lambda x: x % 2), lists.slice_(a, -2)) == ([], [], [5, 0, 1], [5, 4], [1, 3])
    assert one(spark, lists.fold_right(a, F.lit(0), lambda x, acc: x - acc), lists.find_index(a, lambda x: x == 4), lists.insert(a, -1, F.lit(7))) == (5 - (1 - (4 - (1 - 3))), 2, [5, 1, 4, 1, 3, 7])
    assert one(spark, core.int_range(F.lit(3), F.lit(1)), core.int_range(F.lit(0), F.lit(7), 3), core.int_power(F.lit(2), F.lit(-1)), core.index_of(a, F.lit(-1)), core.index_of(a, F.lit(9))) == ([], [0, 3, 6], 0, 3, None)
    m = F.create_map(F.lit("a"), F.lit(1))
    assert one(spark, maps.update_or_insert(m, "b", 5, lambda v: v + 1), maps.update_or_insert(m, "a", 5, lambda v: v + 1)) == ({"a": 1, "b": 5}, {"a": 2})
    assert quality.throws(lambda: one(spark, core.unwrap(F.lit(None).cast("string"))))


def test_dates(spark):
    t = F.lit("2024-03-15T14:30:00Z").cast("timestamp")
    assert one(spark, dates.quarter(t), dates.hour(dates.start_of_day(t)), dates.day(dates.start_of_month(t)), dates.year(dates.with_year(t, 2025)), dates.day_of_week(t)) == (1, 0, 1, 2025, 5)
    leap = F.lit("2024-02-29T01:02:03Z").cast("timestamp")
    assert one(spark, dates.to_iso8601(dates.with_year(leap, 2023)), dates.to_iso8601(dates.with_month(F.lit("2024-01-31T00:00:00Z").cast("timestamp"), 2))) == ("2023-03-01T01:02:03Z", "2024-03-02T00:00:00Z")
    assert one(spark, dates.to_hours(dates.minutes(F.lit(90))), dates.parse(F.lit("bad"), "date")["ok"]) == (1.5, False)


def test_mathematics(spark):
    f = F.lit
    assert one(spark, mathx.round_(f(-2.5)), mathx.trunc(f(-2.7)), mathx.log(f(0.0)), mathx.gcd(f(12), f(-18)), mathx.lcm(f(4), f(6)), mathx.is_prime(f(97)), mathx.is_prime(f(91)), mathx.prime_factors(f(360))) == (-3.0, -2.0, -math.inf, 6, 12, True, False, [2, 2, 2, 3, 3, 5])
    assert math.isnan(one(spark, mathx.log(f(-1.0))))
    assert one(spark, mathx.linspace(0, 1, 5), mathx.arange(0, 1, 0.25), mathx.combinations(f(5).cast("bigint"), f(2).cast("bigint"))) == ([0.0, 0.25, 0.5, 0.75, 1.0], [0.0, 0.25, 0.5, 0.75], 10)


def test_linear_algebra(spark):
    m = linalg.matrix([4, 3], [6, 3])
    assert one(spark, linalg.det(m)) == pytest.approx(-6)
    assert one(spark, linalg.solve(m, linalg.vector(10, 12))) == pytest.approx([1, 2])
    assert one(spark, linalg.mat_mul(m, linalg.identity(2))) == [[4.0, 3.0], [6.0, 3.0]]
    assert one(spark, linalg.rank(linalg.matrix([1, 2], [2, 4]))) == 1
    assert [e["re"] for e in one(spark, linalg.eigenvalues(linalg.matrix([2, 0], [0, 5])))] == pytest.approx([5, 2])
    assert one(spark, linalg.kronecker(linalg.identity(2), m))[3] == [0.0, 0.0, 6.0, 3.0]
    assert quality.throws(lambda: one(spark, linalg.inverse(linalg.matrix([1, 2], [2, 4]))))
    a = arrays.from_nested(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))))
    assert one(spark, arrays.shape(a), arrays.to_list(arrays.transpose(a)), arrays.to_list(arrays.matmul(a, a)), arrays.to_list(arrays.sum_axis(a, 0))) == ([2, 2], [1, 3, 2, 4], [7, 10, 15, 22], [4, 6])


def test_symbols(spark):
    e = symbolic.parse("x^2 + 3*x*sin(y) - exp(x)/y")
    for x in ("x", "y"):
        d, h, at = symbolic.diff(e, x), 1e-6, {"x": 1.3, "y": 0.7}
        lo, hi = ({**at, x: at[x] + s * h} for s in (-1, 1))
        assert symbolic.value(d, at) == pytest.approx((symbolic.value(e, hi) - symbolic.value(e, lo)) / (2 * h), rel=1e-6)
    assert str(symbolic.simplify(symbolic.parse("0 * x + y * 1"))) == "y" and symbolic.free_symbols(e) == ["x", "y"]
    assert str(symbolic.parse("-(a - b) - c * (d + 2)^2")) == "-(a - b) - c * (d + 2) ^ 2"
    assert symbolic.value(symbolic.substitute(e, "x", 2), {"y": 1.0}) == pytest.approx(symbolic.value(e, {"x": 2, "y": 1}))
    with pytest.raises(ZeroDivisionError):
        symbolic.div(symbolic.var("x"), 0)


def test_numbers(spark):
    f = lambda x: x * x - 2
    assert one(spark, numeric.bisect(f, 0, 2), numeric.newton(f, 1), numeric.secant(f, 1, 2)) == pytest.approx((2**0.5,) * 3)
    assert one(spark, numeric.quad(F.sin, 0.0, math.pi)["value"]) == pytest.approx(2.0, abs=1e-9)
    assert one(spark, numeric.ode_rk4(lambda t, y: y, 1.0, 0.0, 1.0)) == pytest.approx(math.e, abs=1e-7)
    assert one(spark, numeric.interp1d(mathx.linspace(0, 2, 3), F.array(F.lit(0.0), F.lit(10.0), F.lit(40.0)), F.lit(1.5))) == 25.0
    df = spark.range(20).select(F.col("id").alias("x"), (3 * F.col("id") * F.col("id") - 2 * F.col("id") + 1).alias("y"))
    assert numeric.polyfit(df, "x", "y", 2) == pytest.approx([3, -2, 1], abs=1e-6)


def test_clusters(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.1, 0.1), (2, 5.0, 5.0), (3, 5.1, 5.1)], "id int, x double, y double")
    assert {r["id"]: r["cluster"] for r in analysis.dbscan(p, "id", 1.0, 1).collect()} == {0: 1, 1: 1, 2: 2, 3: 2}
    got, centres = analysis.kmeans(p, [(0.0, 0.0), (5.0, 5.0)])
    assert centres == [(0.05, 0.05), (5.05, 5.05)] and got.filter("cluster = 1").count() == 2
    n = spatial.nearest(p, 5.2, 5.2, 1, "id").first()
    assert n["id"] == 3


def test_delaunay_is_empty_inside_circles():
    xy = np.random.default_rng(1).random((40, 2))
    tri = analysis.triangulated(xy)
    assert len(tri) > 50
    for t in tri:
        (ax, ay), (bx, by), (cx, cy) = xy[t]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        u = np.array([(ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by), (ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)]) / d
        r = np.hypot(*(xy[t[0]] - u))
        assert (np.hypot(*(xy - u).T) >= r - 1e-9).all()


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (-2, None)], "n int, s string")
    checks = [("positive", quality.positive(F.col("n"))), ("named", quality.not_nil(F.col("s")))]
    assert {r["check"]: r["violations"] for r in quality.report(df, checks).collect()} == {"positive": 1, "named": 1}
    assert quality.throws(lambda: quality.enforced(df, checks).collect()) and quality.does_not_throw(lambda: quality.enforced(df.filter("n > 0"), checks).collect())


def test_files(spark, tmp_path):
    p = f"file://{tmp_path}/a.bin"
    files.write_bytes(spark, p, [1, 2, 255])
    assert files.exists(spark, p) and files.is_file(spark, p) and files.file_size(spark, p) == 3 and files.read_bytes(spark, p).first()["bytes"] == [1, 2, 255]
    assert files.copy(spark, p, f"file://{tmp_path}/b.bin") and files.list_dir(spark, f"file://{tmp_path}") == ["a.bin", "b.bin"] and files.remove_file(spark, p)
    assert files.extension("x/y.tar.gz") == ".gz" and files.join("a", "..", "b") == "b"
    gpx = tmp_path / "t.gpx"
    gpx.write_text(one(spark, formats.to_gpx(geom.line(ring((1, 2), (3, 4))))))
    assert [(r["lon"], r["lat"]) for r in formats.read_gpx(spark, str(gpx)).collect()] == [(1.0, 2.0), (3.0, 4.0)]


def test_functions():
    assert functional.compose(lambda x: x + 1, lambda x: x * 2)(5) == 11 and functional.pipe(lambda x: x + 1, lambda x: x * 2)(5) == 12
    assert functional.curry(lambda a, b, c: a + b * c)(1)(2, 3) == 7 and functional.flip(lambda a, b: a - b)(1, 5) == 4
