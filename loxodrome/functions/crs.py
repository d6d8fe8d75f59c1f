"""Reference systems from PROJ text, well-known text, codes and zone names, and transforms between them.

Projections are column expressions on the ellipsoid: geographic, Mercator, transverse Mercator
(Krueger's series) and Lambert's conformal conic with two parallels. Datums that differ by less than
two metres (WGS 84, NAD 83, ETRS 89) count as one; others are refused.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loxodrome.functions import geog, geom

#: Semi-major axis and inverse flattening by the names that PROJ has for ellipsoids.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "clrk66": (6378206.4, 294.978698214), "bessel": (6377397.155, 299.1528128)}
#: The ellipsoid of each datum, and metres in a unit.
DATUMS = {"WGS84": "WGS84", "NAD83": "GRS80", "NAD27": "clrk66", "ETRS89": "GRS80"}
UNITS = {"m": 1.0, "us-ft": 1200 / 3937, "ft": 0.3048}
#: Zones of California: EPSG code, parallels, latitude and longitude of the origin; the false origin is 2,000,000 m E, 500,000 m N.
CALIFORNIA = {
    "CA_I": (26941, 41 + 40 / 60, 40.0, 39 + 20 / 60, -122.0), "CA_II": (26942, 39 + 50 / 60, 38 + 20 / 60, 37 + 40 / 60, -122.0), "CA_III": (26943, 38 + 26 / 60, 37 + 4 / 60, 36.5, -120.5),
    "CA_IV": (26944, 37.25, 36.0, 35 + 20 / 60, -119.0), "CA_V": (26945, 35 + 28 / 60, 34 + 2 / 60, 33.5, -118.0), "CA_VI": (26946, 33 + 53 / 60, 32 + 47 / 60, 32 + 10 / 60, -116.25),
}


@dataclass(frozen=True)
class CRS:
    """proj: longlat, merc, tmerc or lcc; p: its numbers."""

    proj: str
    name: str = ""
    epsg: int | None = None
    datum: str = "WGS84"
    axis: float = 6378137.0
    flattening: float = 298.257223563  # the inverse; 0 of a sphere
    p: dict = field(default_factory=dict, hash=False)

    def is_geographic(self) -> bool:
        return self.proj == "longlat"

    def is_projected(self) -> bool:
        return not self.is_geographic()

    def units(self) -> str:
        return "degrees" if self.is_geographic() else {"m": "meters"}.get(self.p.get("units", "m"), "feet")

    def _e2(self) -> float:
        f = 1 / self.flattening if self.flattening else 0.0
        return f * (2 - f)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Degrees to the system's coordinates."""
        if self.is_geographic():
            return lon, lat
        x, y = _FORWARD[self.proj](self, lon, lat)
        unit = UNITS[self.p.get("units", "m")]
        return (x + self.p.get("x_0", 0.0)) / unit, (y + self.p.get("y_0", 0.0)) / unit

    def backward(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The system's coordinates to degrees."""
        if self.is_geographic():
            return x, y
        unit = UNITS[self.p.get("units", "m")]
        return _BACKWARD[self.proj](self, x * unit - self.p.get("x_0", 0.0), y * unit - self.p.get("y_0", 0.0))

    def to_proj4(self) -> str:
        own = " ".join(f"+{k}={v}" for k, v in sorted(self.p.items()))
        return f"+proj={self.proj} {own + ' ' if own else ''}+datum={self.datum} +no_defs"


def _k0(c: CRS) -> float:
    return c.p.get("k_0", c.p.get("k", 1.0))


def _isometric(c: CRS, lat: Column) -> Column:
    """The isometric latitude of degrees."""
    e, s = math.sqrt(c._e2()), F.sin(F.radians(lat))
    return F.atanh(s) - (e * F.atanh(e * s) if e else 0.0)


def _latitude(c: CRS, q: Column) -> Column:
    """Degrees of an isometric latitude, by as many steps as doubles need."""
    e = math.sqrt(c._e2())
    if not e:
        return F.degrees(F.asin(F.tanh(q)))
    s = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.tanh(q), lambda s, _: F.tanh(q + e * F.atanh(e * s)))
    return F.degrees(F.asin(s))


def _merc_forward(c: CRS, lon: Column, lat: Column) -> tuple[Column, Column]:
    k = c.axis * _k0(c)
    return k * F.radians(lon - c.p.get("lon_0", 0.0)), k * _isometric(c, lat)


def _merc_backward(c: CRS, x: Column, y: Column) -> tuple[Column, Column]:
    k = c.axis * _k0(c)
    return F.degrees(x / k) + c.p.get("lon_0", 0.0), _latitude(c, y / k)


def _series(c: CRS) -> tuple[float, list[float], list[float]]:
    """The rectifying radius, and Krueger's coefficients of both directions to the third order."""
    f = 1 / c.flattening if c.flattening else 0.0
    n = f / (2 - f)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return c.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64), alpha, beta


def _meridian(c: CRS) -> float:
    """The northing of the origin's latitude."""
    lat = math.radians(c.p.get("lat_0", 0.0))
    if not lat:
        return 0.0
    big, alpha, _ = _series(c)
    e = math.sqrt(c._e2())
    xi = math.atan(math.sinh(math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat))))
    return big * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(alpha, 1)))


def _tmerc_forward(c: CRS, lon: Column, lat: Column) -> tuple[Column, Column]:
    big, alpha, _ = _series(c)
    t, d = F.sinh(_isometric(c, lat)), F.radians(lon - c.p.get("lon_0", 0.0))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    return _k0(c) * big * east, _k0(c) * (big * north - _meridian(c))


def _tmerc_backward(c: CRS, x: Column, y: Column) -> tuple[Column, Column]:
    big, _, beta = _series(c)
    xi, eta = (y / _k0(c) + _meridian(c)) / big, x / (_k0(c) * big)
    xi0 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1)), F.lit(0.0))
    eta0 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1)), F.lit(0.0))
    return F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + c.p.get("lon_0", 0.0), _latitude(c, F.asinh(F.sin(xi0) / F.sqrt(F.pow(F.sinh(eta0), 2.0) + F.pow(F.cos(xi0), 2.0))))


def _cone(c: CRS) -> tuple[float, float, float]:
    """The cone's constant, its scale, and the radius of the origin's latitude."""
    e2 = c._e2()
    e = math.sqrt(e2)

    def m(lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - e2 * math.sin(lat) ** 2)

    def q(lat: float) -> float:
        return math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat))

    one, two, origin = (math.radians(c.p.get(k, c.p.get("lat_1", 0.0))) for k in ("lat_1", "lat_2", "lat_0"))
    n = (math.log(m(one)) - math.log(m(two))) / (q(two) - q(one)) if one != two else math.sin(one)
    scale = c.axis * m(one) * math.exp(n * q(one)) / n
    return n, scale, scale * math.exp(-n * q(origin))


def _lcc_forward(c: CRS, lon: Column, lat: Column) -> tuple[Column, Column]:
    n, scale, start = _cone(c)
    r, turn = scale * F.exp(-n * _isometric(c, lat)), n * F.radians(lon - c.p.get("lon_0", 0.0))
    return r * F.sin(turn), start - r * F.cos(turn)


def _lcc_backward(c: CRS, x: Column, y: Column) -> tuple[Column, Column]:
    n, scale, start = _cone(c)
    sign = math.copysign(1.0, n)
    r = sign * F.hypot(x, start - y)
    return F.degrees(F.atan2(sign * x, sign * (start - y)) / n) + c.p.get("lon_0", 0.0), _latitude(c, -F.ln(r / scale) / n)


_FORWARD = {"merc": _merc_forward, "tmerc": _tmerc_forward, "lcc": _lcc_forward}
_BACKWARD = {"merc": _merc_backward, "tmerc": _tmerc_backward, "lcc": _lcc_backward}


# where systems come from


def utm(zone: int, north: bool = True) -> CRS:
    return CRS("tmerc", f"WGS 84 / UTM zone {zone}{'N' if north else 'S'}", (32600 if north else 32700) + zone, p={"lon_0": zone * 6 - 183.0, "k_0": 0.9996, "x_0": 500000.0, "y_0": 0.0 if north else 1e7})


def state_plane(zone: str) -> CRS:
    """A zone of California, such as CA_I. A ValueError for others."""
    if zone not in CALIFORNIA:
        raise ValueError(f"unknown zone {zone}")
    epsg, one, two, lat, lon = CALIFORNIA[zone]
    return CRS("lcc", f"NAD83 / California zone {list(CALIFORNIA).index(zone) + 1}", epsg, "NAD83", *ELLIPSOIDS["GRS80"], p={"lat_1": one, "lat_2": two, "lat_0": lat, "lon_0": lon, "x_0": 2e6, "y_0": 5e5})


def from_epsg(code: int) -> CRS:
    """A ValueError for unknown codes."""
    for base, north in ((32600, True), (32700, False)):
        if base < code <= base + 60:
            return utm(code - base, north)
    for zone, values in CALIFORNIA.items():
        if values[0] == code:
            return state_plane(zone)
    known = {s[0]: s for s in geog.SYSTEMS}
    if code not in known:
        raise ValueError(f"unknown EPSG code {code}")
    out = from_proj4(known[code][6])
    datum = {4326: "WGS84", 3857: "WGS84", 4269: "NAD83", 4267: "NAD27", 4258: "ETRS89"}[code]
    return CRS(out.proj, known[code][1], code, datum, out.axis, out.flattening, out.p)


def from_proj4(text: str) -> CRS:
    """Of +proj=longlat, merc, utm, tmerc or lcc with their numbers. A ValueError for other projections."""
    found = dict(re.findall(r"\+(\w+)(?:=(\S+))?", text))
    proj = {"latlong": "longlat", "latlon": "longlat"}.get(found.get("proj", ""), found.get("proj", ""))
    if proj == "utm":
        return utm(int(found["zone"]), "south" not in found)
    if proj != "longlat" and proj not in _FORWARD:
        raise ValueError(f"unsupported projection: {text}")
    datum = found.get("datum", "WGS84")
    axis, flattening = ELLIPSOIDS[found.get("ellps") or DATUMS.get(datum, "WGS84")]
    if "a" in found:
        axis = float(found["a"])
        b = float(found.get("b", axis))
        flattening = axis / (axis - b) if b != axis else 0.0
    names = ("lat_0", "lat_1", "lat_2", "lon_0", "x_0", "y_0", "k_0", "k")
    p = {k: float(found[k]) for k in names if k in found} | ({"units": found["units"]} if found.get("units", "m") != "m" else {})
    return CRS(proj, "", None, datum, axis, flattening, p if proj != "longlat" else {})


def from_wkt(text: str) -> CRS:
    """By the EPSG code at the end of well-known text, or by the name of a known system. A ValueError for others."""
    codes = re.findall(r'(?:ID|AUTHORITY)\["EPSG",\s*"?(\d+)"?\]', text)
    if codes:
        return from_epsg(int(codes[-1]))
    name = re.match(r'\s*\w+\["([^"]*)"', text)
    if name and (zone := re.fullmatch(r"WGS 84 / UTM zone (\d+)([NS])", name[1])):
        return utm(int(zone[1]), zone[2] == "N")
    known = {s[1]: s[0] for s in geog.SYSTEMS}
    if not name or name[1] not in known:
        raise ValueError(f"unknown system: {text[:60]}")
    return from_epsg(known[name[1]])


_ALIKE = {"WGS84", "NAD83", "ETRS89"}


@dataclass(frozen=True)
class Transformer:
    """Geometries from one system into another."""

    source: CRS
    target: CRS

    def __post_init__(self):
        if self.source.datum != self.target.datum and not {self.source.datum, self.target.datum} <= _ALIKE:
            raise ValueError(f"no transform between {self.source.datum} and {self.target.datum}")

    def point(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.target.forward(*self.source.backward(x, y))

    def transform(self, g: Column) -> Column:
        def moved(c: Column) -> Column:
            x, y = self.point(c["x"], c["y"])
            return geom.coord(x, y, c["z"])

        return geom.set_srid(geom.mapped(g, moved), self.target.epsg or 0)

    def inverse(self) -> Transformer:
        return Transformer(self.target, self.source)


def pipeline(*steps: Transformer):
    """A function that applies the transforms one after another."""

    def run(g: Column) -> Column:
        for step in steps:
            g = step.transform(g)
        return g

    return run
