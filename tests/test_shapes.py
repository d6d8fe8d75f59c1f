"""Overlay, relations, reference systems and files of shapes, against identities and known values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loxodrome.functions import crs, geom, numeric, overlay, symbolic
from loxodrome.sources import formats, vectors


def star(rng, cx, cy, n=9):
    """A simple ring about a centre."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + (r := rng.uniform(1, 6)) * math.cos(t), cy + r * math.sin(t)) for t in turns]
    return [*ring, ring[0]]


def shape(*rings):
    return overlay.Shape("Polygon", [[[{"x": x, "y": y} for x, y in r] for r in rings]])


def area(polygons):
    return sum(overlay.signed_area(r) for p in polygons for r in p)


@pytest.mark.parametrize("seed", range(12))
def test_overlay_identities(seed):
    rng = random.Random(seed)
    a, b = shape(star(rng, 0, 0)), shape(star(rng, rng.uniform(-4, 4), rng.uniform(-4, 4)))
    both, either, less, one = (overlay.overlaid([a, b], f) for f in (all, any, lambda v: v[0] and not v[1], lambda v: v[0] != v[1]))
    own = [area(overlay.overlaid([s], any)) for s in (a, b)]
    assert area(both) + area(either) == pytest.approx(sum(own), abs=1e-6) and area(less) == pytest.approx(own[0] - area(both), abs=1e-6) and area(one) == pytest.approx(area(either) - area(both), abs=1e-6)
    for _ in range(200):
        p = (rng.uniform(-9, 9), rng.uniform(-9, 9))
        inside = lambda polygons, p=p: any(overlay._in(poly[0], p) and not any(overlay._in(h, p) for h in poly[1:]) for poly in polygons)
        assert inside(both) == (a.inside(p) and b.inside(p)) and inside(less) == (a.inside(p) and not b.inside(p))


def test_shared_edges_and_corners():
    sq = lambda x, y, s: shape([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)])
    union = overlay.overlaid([sq(0, 0, 2), sq(2, 0, 2)], any)
    assert len(union) == 1 and len(union[0][0]) == 5 and area(union) == 8  # one rectangle, without the corners in between
    corner = overlay.overlaid([sq(0, 0, 2), sq(2, 2, 2)], any)
    assert len(corner) == 2 and area(corner) == 8
    ring = overlay.overlaid([sq(0, 0, 6), sq(2, 2, 2)], lambda v: v[0] and not v[1])
    assert len(ring) == 1 and len(ring[0]) == 2 and area(ring) == 32
    assert overlay.overlaid([sq(0, 0, 1), sq(5, 5, 1)], all) == []


@pytest.mark.parametrize(
    ("a", "b", "matrix"),
    [
        ("LINESTRING (-1 1, 1 1)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "1010F0212"),
        ("POINT (2 2)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "0FFFFF212"),
        ("POINT (0 2)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "F0FFFF212"),
        ("LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", "0F1FF0102"),
        ("LINESTRING (0 0, 2 0)", "LINESTRING (1 0, 3 0)", "1010F0102"),
        ("LINESTRING (0 0, 1 0)", "LINESTRING (1 0, 1 1)", "FF1F00102"),
        ("POINT (1 1)", "POINT (1 1)", "0FFFFFFF2"),
        ("MULTIPOINT ((0 0), (1 1))", "POINT (1 1)", "0F0FFFFF2"),
        ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "2FFF1FFF2"),
    ],
)
def test_matrices(a, b, matrix):
    s, t = (overlay.Shape(r["kind"], r["parts"]) for r in (formats.wkt_rows(a)[0], formats.wkt_rows(b)[0]))
    found = overlay.relation(s, t)
    assert found == matrix
    # the matrix of the pair the other way round is its transpose
    assert overlay.relation(t, s) == "".join(found[3 * (i % 3) + i // 3] for i in range(9))


def test_buffers():
    line = overlay.Shape("LineString", [[[{"x": 0, "y": 0}, {"x": 10, "y": 0}, {"x": 10, "y": 10}]]])
    got = overlay.buffered(line, 1.0, 64)
    # two bars that share a square at the corner, whose outer part is a quarter of a circle, and half a circle at either end
    assert len(got) == 1 and area(got) == pytest.approx(2 * 20 - 1 + math.pi / 4 + math.pi, abs=0.02)
    assert overlay.buffered(shape([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]), -1.5, 16) == []


def test_outlines_of_points():
    """Points of an L: the hull fills its notch, the concave hull doesn't."""
    pts = [(x, y) for x in range(11) for y in range(11) if x <= 4 or y <= 4]
    rng = random.Random(1)
    pts = [(x + rng.uniform(-0.1, 0.1), y + rng.uniform(-0.1, 0.1)) for x, y in pts]
    hull, tight = overlay.concave_polygons(pts, 0.0), overlay.concave_polygons(pts, 1.0)
    assert area(hull) == pytest.approx(100 - 18, abs=4) and 55 < area(tight) < 72 and len(tight) == 1


def test_lambert_and_transverse_mercator(spark):
    """The worked example of the projection's registry (Texas South Central, in feet), and there and back elsewhere."""
    texas = crs.from_proj4("+proj=lcc +lat_1=28.38333333333333 +lat_2=30.28333333333333 +lat_0=27.83333333333333 +lon_0=-99 +x_0=609601.2192024384 +y_0=0 +datum=NAD27 +units=us-ft +no_defs")
    x, y = texas.forward(F.lit(-96.0), F.lit(28.5))
    got = spark.range(1).select(x, y).first()
    assert got[0] == pytest.approx(2963503.91, abs=0.02) and got[1] == pytest.approx(254759.80, abs=0.02)
    tower = crs.Transformer(crs.from_epsg(4326), crs.utm(17)).point(F.lit(-79.387139), F.lit(43.642567))
    assert [round(v) for v in spark.range(1).select(*tower).first()] == [630084, 4833439]
    grid = crs.from_proj4("+proj=tmerc +lat_0=49 +lon_0=-2 +k_0=0.9996 +x_0=400000 +y_0=-100000 +ellps=GRS80")
    lon, lat = grid.backward(*grid.forward(F.lit(1.5), F.lit(52.3)))
    assert spark.range(1).select(lon, lat).first() == pytest.approx((1.5, 52.3), abs=1e-9)
    for bad in ("+proj=aeqd", ""):
        with pytest.raises(ValueError):
            crs.from_proj4(bad)
    for call in (lambda: crs.from_epsg(1), lambda: crs.from_wkt('GEOGCRS["none"]'), lambda: crs.state_plane("NY"), lambda: crs.Transformer(crs.from_epsg(4267), crs.from_epsg(4326))):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("text", ["POINT (1 2)", "LINESTRING (0 0, 1 1, 2 0)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", "MULTIPOINT ((1 2), (3 4))"])
def test_shapefile_round_trip(text):
    g = formats.wkt_rows(text)[0]
    shp, shx, dbf = vectors.shapefile_bytes([(g, {"name": "é", "n": "7"}), (g, {"n": "x" * 300})])
    back = vectors.shapes_of(shp)
    assert len(back) == 2 and back[0]["kind"] == g["kind"] and len(shx) == 100 + 16
    flat = lambda r: sorted((c["x"], c["y"]) for p in r["parts"] for line in p for c in line)
    assert set(flat(back[0])) == set(flat(g)) and [a["name"] for a in vectors.attributes_of(dbf)] == ["é", ""] and vectors.attributes_of(dbf)[1]["n"] == "x" * 254
    if "POLYGON" in text:
        assert area([[[(c["x"], c["y"]) for c in r] for r in p] for p in back[0]["parts"]]) == 80


def test_geopackage_round_trip():
    rows = [(formats.wkt_rows("POINT (1 2)")[0], {"a": "x", "b": None}), (formats.wkt_rows("POLYGON ((0 0, 1 0, 1 1, 0 0))")[0], {"a": "y"})]
    got = vectors.geopackage_rows(vectors.geopackage_bytes('my "layer"', rows))
    assert [r["layer"] for r in got] == ['my "layer"'] * 2 and got[0]["geometry"]["parts"] == rows[0][0]["parts"] and got[1]["attributes"]["a"] == "y"


def test_symbols():
    x = symbolic.var("x")
    for e in (x**3 - 2 * x + 1, symbolic.sin(2 * x + 1), symbolic.exp(3 * x), symbolic.num(4) / (2 * x + 1), symbolic.sqrt(x + 2), (2 * x + 1) ** 5):
        d = symbolic.diff(symbolic.integrate(e, "x"), "x")
        assert symbolic.value(d, {"x": 1.3}) == pytest.approx(symbolic.value(e, {"x": 1.3}))
    with pytest.raises(ValueError):
        symbolic.integrate(symbolic.exp(x * x), "x")
    assert [r.args[0] for r in symbolic.solve(x**3 - 6 * x**2 + 11 * x - 6, "x")] == pytest.approx([1, 2, 3]) and symbolic.solve(x**2 + 1, "x") == []
    assert symbolic.degree(x**2 * 3 + x, "x") == 2 and not symbolic.is_polynomial(symbolic.sin(x), "x") and symbolic.limit((x**2 - 1) / (x - 1), "x", 1.0) == pytest.approx(2)
    assert str(symbolic.cancelled((x**2 - 1) / (x - 1), "x")) in ("x + 1", "x - -1") and math.isnan(symbolic.limit(symbolic.call("abs", x) / x, "x", 0.0))
    assert symbolic.to_latex(symbolic.parse("x^2 / sqrt(y)")) == r"\frac{x^{2}}{\sqrt{y}}"


def test_roots_and_quadrature(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(numeric.brent(lambda x: F.cos(x) - x, 0.0, 1.0)) == pytest.approx(0.7390851332151607) and one(numeric.romberg(F.exp, 0.0, 1.0)) == pytest.approx(math.e - 1, abs=1e-10)
    assert one(numeric.find_roots(F.sin, 1.0, 10.0, 50)) == pytest.approx([math.pi, 2 * math.pi, 3 * math.pi])
    assert one(numeric.rk45(lambda t, y: -2 * t * y, 1.0, 0.0, 2.0)) == pytest.approx(math.exp(-4), abs=1e-7)
    s = numeric.spline(F.array(*[F.lit(float(i)) for i in range(6)]), F.array(*[F.lit(math.sin(i)) for i in range(6)]))
    assert one(numeric.spline_at(s, F.lit(2.5))) == pytest.approx(math.sin(2.5), abs=0.01) and one(numeric.spline_integral(s, 0.0, 5.0)) == pytest.approx(1 - math.cos(5), abs=0.05)


def test_points_on_surfaces(spark):
    """Inside even where the centroid isn't."""
    c = geom.polygon(F.array(*[geom.coord(x, y) for x, y in ((0, 0), (10, 0), (10, 1), (1, 1), (1, 9), (10, 9), (10, 10), (0, 10), (0, 0))]))
    p = overlay.point_on_surface(c)
    assert spark.range(1).select(overlay.contains(c, p), overlay.contains(c, geom.centroid(c))).first() == (True, False)
