"""Numerical methods on Column -> Column functions: a fixed number of steps as one expression for every row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loxodrome.functions import linalg, mathx
from loxodrome.functions.core import let

Fn = Callable[[Column], Column]
GOLDEN = (5**0.5 - 1) / 2
linspace, arange = mathx.linspace, mathx.arange


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def bisect(f: Fn, a, b, steps: int = 60) -> Column:
    """A root between a and b, where f changes its sign; an error where it doesn't."""

    def step(s, _):
        m = (s["a"] + s["b"]) / 2
        left = F.signum(f(m)) == F.signum(f(s["a"]))
        return F.when(left, F.struct(m.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), m.alias("b")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(_d(a).alias("a"), _d(b).alias("b")), step, lambda s: (s["a"] + s["b"]) / 2)
    return F.when(F.signum(f(_d(a))) * F.signum(f(_d(b))) <= 0, found).otherwise(F.raise_error(F.lit("bisect: f(a) and f(b) must have opposite signs")).cast("double"))


def newton(f: Fn, x0, steps: int = 30, h: float = 1e-6) -> Column:
    """Newton's steps with a central difference."""

    def step(x, _):
        return let((f(x + h) - f(x - h)) / (2 * h), lambda slope: F.when(slope == 0, x).otherwise(x - f(x) / F.nullif(slope, F.lit(0.0))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), _d(x0), step)


def secant(f: Fn, a, b, steps: int = 40) -> Column:
    def step(s, _):
        moved = let(s["b"] - s["fb"] * (s["b"] - s["a"]) / F.nullif(s["fb"] - s["fa"], F.lit(0.0)), lambda x: F.struct(s["b"].alias("a"), x.alias("b"), s["fb"].alias("fa"), f(x).alias("fb")))
        return F.when(s["fb"] == s["fa"], s).otherwise(moved)  # level: every further step would stay at b

    low, high = _d(a), _d(b)
    start = F.struct(low.alias("a"), high.alias("b"), f(low).alias("fa"), f(high).alias("fb"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["b"])


def _simpson(f: Fn, a: Column, b: Column, n: int) -> Column:
    h = (b - a) / n
    weight = lambda i: F.when((i == 0) | (i == n), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), lambda s, i: s + weight(i) * f(a + h * i)) * h / 3


def quad(f: Fn, a, b, n: int = 1000) -> Column:
    """struct<value, error>: Simpson's rule, the error from half as many steps."""
    fine, half = _simpson(f, _d(a), _d(b), n), _simpson(f, _d(a), _d(b), n // 2)
    return F.struct(fine.alias("value"), (F.abs(fine - half) / 15).alias("error"))


def diff(f: Fn, x, h: float = 1e-6) -> Column:
    return (f(_d(x) + h) - f(_d(x) - h)) / (2 * h)


def minimize(f: Fn, a, b, steps: int = 80) -> Column:
    """struct<x, value> of the least value between a and b, by golden sections."""

    def step(s, _):
        c, d = s["b"] - (s["b"] - s["a"]) * GOLDEN, s["a"] + (s["b"] - s["a"]) * GOLDEN
        return F.when(f(c) < f(d), F.struct(s["a"].alias("a"), d.alias("b"))).otherwise(F.struct(c.alias("a"), s["b"].alias("b")))

    x = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(_d(a).alias("a"), _d(b).alias("b")), step, lambda s: (s["a"] + s["b"]) / 2)
    return let(x, lambda v: F.struct(v.alias("x"), f(v).alias("value")))


def gradient_descent(f: Fn, x0, rate: float = 0.01, steps: int = 1000, h: float = 1e-6) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), _d(x0), lambda x, _: x - rate * (f(x + h) - f(x - h)) / (2 * h))


def polyval(coeffs: Column, x: Column) -> Column:
    """Horner's scheme, the highest power first."""
    return F.aggregate(coeffs, F.lit(0.0), lambda s, c: s * x + c)


def polyfit(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Coefficients, the highest power first, of the least squares: power sums of all rows in one pass, a small system on the driver."""
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    sums = [F.sum(F.pow(cx, float(k))).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(F.pow(cx, float(k)) * cy).alias(f"t{k}") for k in range(degree + 1)]
    r = df.filter(cx.isNotNull() & cy.isNotNull()).agg(*sums).first()
    m = np.array([[r[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    return np.linalg.solve(m, np.array([r[f"t{k}"] for k in range(degree + 1)]))[::-1].tolist()


def interp1d(xs: Column, ys: Column, x: Column) -> Column:
    """Piecewise linear between ascending xs, constant beyond them."""
    n = F.size(xs)
    k = F.least(F.greatest(F.size(F.filter(xs, lambda v: v <= x)), F.lit(1)), n - 1)
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - x0) / F.nullif(x1 - x0, F.lit(0.0))))
    return F.when(n == 1, F.get(ys, F.lit(0))).otherwise(y0 + (y1 - y0) * at)


def ode_rk4(f: Callable[[Column, Column], Column], y0, t0: float, t1: float, steps: int = 100) -> Column:
    """y at t1 of y' = f(t, y), by the classical fourth-order steps."""
    h = (t1 - t0) / steps

    def step(y, i):
        t = F.lit(t0) + i * h
        end = lambda k1, k2, k3: y + (k1 + k2 * 2 + k3 * 2 + f(t + h, y + k3 * h)) * h / 6
        return let(f(t, y), lambda k1: let(f(t + h / 2, y + k1 * h / 2), lambda k2: let(f(t + h / 2, y + k2 * h / 2), lambda k3: end(k1, k2, k3))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), _d(y0), step)


def brent(f: Fn, a, b, steps: int = 60) -> Column:
    """A root between a and b, where f changes its sign: inverse quadratic or linear steps where they stay well inside the bracket, else its middle; an error where f doesn't change its sign."""

    def step(s, _):
        a, b, c = s["a"], s["b"], s["c"]
        fa, fb, fc = s["fa"], s["fb"], s["fc"]
        apart = F.abs(fa - fc) * F.abs(fb - fc) * F.abs(fa - fb) > 0
        part = lambda u, fu, fv, fw, v, w: u * fv * fw / F.nullif((fu - fv) * (fu - fw), F.lit(0.0))
        curved = part(a, fa, fb, fc, b, c) + part(b, fb, fa, fc, a, c) + part(c, fc, fa, fb, a, b)
        straight = b - fb * (b - a) / F.nullif(fb - fa, F.lit(0.0))
        edge = (3 * a + b) / 4
        held = lambda guess: F.when(((guess > edge) & (guess < b)) | ((guess > b) & (guess < edge)), guess).otherwise((a + b) / 2)

        def ends(u, fu, v, fv):
            """The bracket from u to v, with its better end as b."""
            of = lambda p, fp, q, fq: F.struct(p.alias("a"), q.alias("b"), b.alias("c"), fp.alias("fa"), fq.alias("fb"), fb.alias("fc"))
            return F.when(F.abs(fu) < F.abs(fv), of(v, fv, u, fu)).otherwise(of(u, fu, v, fv))

        put = lambda x: let(f(x), lambda fx: F.when(F.signum(fa) * F.signum(fx) <= 0, ends(a, fa, x, fx)).otherwise(ends(x, fx, b, fb)))
        return F.when(fb == 0, s).otherwise(let(F.when(apart, curved).otherwise(straight), lambda guess: let(held(guess), put)))

    low, high = _d(a), _d(b)
    start = F.struct(low.alias("a"), high.alias("b"), low.alias("c"), f(low).alias("fa"), f(high).alias("fb"), f(low).alias("fc"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["b"])
    return F.when(F.signum(f(low)) * F.signum(f(high)) <= 0, found).otherwise(F.raise_error(F.lit("brent: f(a) and f(b) must have opposite signs")).cast("double"))


def quad_gauss(f: Fn, a, b, n: int = 5) -> Column:
    """Gauss and Legendre's rule of n nodes."""
    a, b = _d(a), _d(b)
    nodes, weights = np.polynomial.legendre.leggauss(n)
    total = sum((F.lit(float(w)) * f((a + b) / 2 + (b - a) / 2 * float(t)) for t, w in zip(nodes, weights, strict=True)), F.lit(0.0))
    return total * (b - a) / 2


def romberg(f: Fn, a, b, levels: int = 7) -> Column:
    """Trapezoids of 1, 2, 4, ... strips, extrapolated; the extrapolation is one weighted sum of them."""
    a, b = _d(a), _d(b)

    def trapezoid(n: int) -> Column:
        h = (b - a) / n
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + f(a + h * i)) if n > 1 else F.lit(0.0)
        return h * ((f(a) + f(b)) / 2 + inner)

    rows = list(np.eye(levels))
    for k in range(1, levels):
        rows = [(4.0**k * rows[i + 1] - rows[i]) / (4.0**k - 1) for i in range(len(rows) - 1)]
    return sum((F.lit(float(w)) * trapezoid(2**i) for i, w in enumerate(rows[0])), F.lit(0.0))


def dblquad(f: Callable[[Column, Column], Column], ax, bx, ay, by, n: int = 8) -> Column:
    """Over a rectangle, by Gauss and Legendre's rule both ways."""
    return quad_gauss(lambda x: quad_gauss(lambda y: f(x, y), ay, by, n), ax, bx, n)


def diff2(f: Fn, x, h: float = 1e-3) -> Column:
    """The second derivative by central differences."""
    return (f(_d(x) + h) - 2 * f(_d(x)) + f(_d(x) - h)) / (h * h)


def maximize(f: Fn, a, b, steps: int = 80) -> Column:
    """struct<x, value> of the greatest value between a and b."""
    found = minimize(lambda x: -f(x), a, b, steps)
    return F.struct(found["x"].alias("x"), (-found["value"]).alias("value"))


def find_roots(f: Fn, a: float, b: float, n: int = 100) -> Column:
    """The roots that sign changes over n strips tell of."""
    h = (b - a) / n
    strips = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.signum(f(F.lit(a) + i * h)) * F.signum(f(F.lit(a) + (i + 1) * h)) < 0) | (f(F.lit(a) + i * h) == 0))
    return F.transform(strips, lambda i: F.when(f(F.lit(a) + i * h) == 0, F.lit(a) + i * h).otherwise(bisect(f, F.lit(a) + i * h, F.lit(a) + (i + 1) * h)))


#: Dormand and Prince's coefficients: places, slopes' weights, and the weights of the fifth and the fourth order.
_C = (0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1)
_A = ((), (1 / 5,), (3 / 40, 9 / 40), (44 / 45, -56 / 15, 32 / 9), (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729), (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656))
_FIFTH = (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0)
_FOURTH = (5179 / 57600, 0, 7571 / 16695, 393 / 640, -92097 / 339200, 187 / 2100, 1 / 40)


def rk45(f: Callable[[Column, Column], Column], y0, t0: float, t1: float, tolerance: float = 1e-8, most: int = 200) -> Column:
    """y at t1 of y' = f(t, y), by Dormand and Prince's steps, whose length follows the estimated error; an error if t1 isn't reached in ``most`` tries."""

    def step(s, _):
        t, y, h = s["t"], s["y"], F.least(s["h"], F.lit(float(t1)) - s["t"])

        def weighed(ks, weights):
            return sum((k * float(w) for k, w in zip(ks, weights, strict=True) if w), F.lit(0.0))

        def slopes(ks):
            if len(ks) == len(_C):
                error = lambda last: h * F.abs(weighed([*ks, last], [p - q for p, q in zip(_FIFTH, _FOURTH, strict=True)]))
                return let(y + h * weighed(ks, _FIFTH[:-1]), lambda high: let(f(t + h, high), lambda last: let(error(last), lambda e: decided(high, e))))
            i = len(ks)
            return let(f(t + h * float(_C[i]), y + h * weighed(ks, _A[i])), lambda k: slopes([*ks, k]))

        def decided(high, error):
            good = error <= tolerance
            factor = F.greatest(F.lit(0.2), F.least(F.lit(5.0), 0.9 * F.pow(tolerance / F.greatest(error, F.lit(1e-300)), F.lit(0.2))))
            return F.struct(F.when(good, t + h).otherwise(t).alias("t"), F.when(good, high).otherwise(y).alias("y"), (h * factor).alias("h"))

        return F.when(t >= float(t1), s).otherwise(slopes([]))

    start = F.struct(F.lit(float(t0)).alias("t"), _d(y0).alias("y"), F.lit((t1 - t0) / 10).alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: F.when(s["t"] >= t1, s["y"]).otherwise(F.raise_error(F.lit("rk45: too many steps")).cast("double")))


def _curvatures(xs, ys):
    x, y = np.asarray(xs, float), np.asarray(ys, float)
    n, h = len(x), np.diff(x)
    if n < 3:
        return [0.0] * n
    m = np.eye(n)
    d = np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        d[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    return np.linalg.solve(m, d).tolist()


def spline(xs: Column, ys: Column) -> Column:
    """struct<xs, ys, m>: the natural cubic spline through ascending xs; m are the second derivatives there."""
    return F.struct(xs.alias("xs"), ys.alias("ys"), linalg._each("array<double>", _curvatures)(xs, ys).alias("m"))


def spline_at(s: Column, x: Column) -> Column:
    """The spline's value; beyond its ends the outer cubics go on."""

    def of(s: Column) -> Column:
        k = F.least(F.greatest(F.size(F.filter(s["xs"], lambda v: v <= x)), F.lit(1)), F.size(s["xs"]) - 1)
        g = lambda name, i: F.get(s[name], i)
        h = g("xs", k) - g("xs", k - 1)
        a, b = (g("xs", k) - x) / h, (x - g("xs", k - 1)) / h
        return a * g("ys", k - 1) + b * g("ys", k) + ((a * a * a - a) * g("m", k - 1) + (b * b * b - b) * g("m", k)) * h * h / 6

    return let(s, of)


def spline_derivative(s: Column, x, h: float = 1e-5) -> Column:
    return diff(lambda v: spline_at(s, v), x, h)


def spline_integral(s: Column, a, b) -> Column:
    """Exact between knots only as far as Gauss' rule of 20 nodes is."""
    return quad_gauss(lambda v: spline_at(s, v), a, b, 20)


_COMPLEX = "array<struct<re:double,im:double>>"


def _plain(values) -> np.ndarray:
    return np.array([complex(v["re"], v["im"]) if isinstance(v, dict) else complex(v) for v in values])


def _pairs(values) -> list[dict]:
    return [{"re": float(v.real), "im": float(v.imag)} for v in values]


def fft(a: Column) -> Column:
    """array<struct<re, im>> of an array of numbers or of such structs."""
    return linalg._each(_COMPLEX, lambda v: _pairs(np.fft.fft(_plain(v))))(a)


def ifft(a: Column) -> Column:
    return linalg._each(_COMPLEX, lambda v: _pairs(np.fft.ifft(_plain(v))))(a)


def fftfreq(n: int, d: float = 1.0) -> Column:
    return F.array(*[F.lit(float(v)) for v in np.fft.fftfreq(n, d)])
