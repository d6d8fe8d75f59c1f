"""Scalar mathematics with the edge cases of IEEE arithmetic: logarithms outside their domain are NaN or -Infinity, not null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loxodrome.functions.core import let

PI, E, TAU, PHI = math.pi, math.e, 2 * math.pi, (1 + 5**0.5) / 2
INFINITY, NEG_INF, NAN = float("inf"), float("-inf"), float("nan")

sin, cos, tan, asin, acos, atan, atan2 = F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.atan2
sinh, cosh, tanh, asinh, acosh, atanh = F.sinh, F.cosh, F.tanh, F.asinh, F.acosh, F.atanh
to_radians, to_degrees, exp, cbrt, hypot, expm1, pow_, sqrt, abs_ = F.radians, F.degrees, F.exp, F.cbrt, F.hypot, F.expm1, F.pow, F.sqrt, F.abs


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def round_(x: Column) -> Column:
    """Halves away from zero."""
    return F.round(x.cast("double"), 0)


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def frac(x: Column) -> Column:
    return x - F.floor(x)


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def _log(x: Column, f) -> Column:
    return F.when(x < 0, F.lit(NAN)).when(x == 0, F.lit(NEG_INF)).otherwise(f(x))


def log(x: Column) -> Column:
    return _log(x, F.ln)


def log2(x: Column) -> Column:
    return _log(x, F.log2)


def log10(x: Column) -> Column:
    return _log(x, F.log10)


def log1p(x: Column) -> Column:
    return F.when(x < -1, F.lit(NAN)).when(x == -1, F.lit(NEG_INF)).otherwise(F.log1p(x))


def log_base(base: Column, x: Column) -> Column:
    return log(x) / log(base)


def sign(x: Column) -> Column:
    return F.signum(x).cast("bigint")


def clamp(v: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, v)).cast("double")


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def inverse_lerp(a: Column, b: Column, v: Column) -> Column:
    return F.when(a == b, F.lit(0.0)).otherwise((v - a) / (b - a))


def is_nan(x: Column) -> Column:
    return F.coalesce(F.isnan(x), F.lit(False))


def is_infinite(x: Column) -> Column:
    return F.coalesce(x.isin(INFINITY, NEG_INF), F.lit(False))


def is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & ~x.isin(INFINITY, NEG_INF), F.lit(False))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps; 93 are enough for 64 bits."""
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    return let(gcd(a, b), lambda g: F.when(g == 0, F.lit(0).cast("bigint")).otherwise(F.abs(F.call_function("div", a.cast("bigint"), F.when(g == 0, F.lit(1).cast("bigint")).otherwise(g)) * b)))


def factorial(n: Column) -> Column:
    """Null beyond 20, where 64 bits end."""
    return F.factorial(n.cast("int"))


def is_prime(n: Column) -> Column:
    """Trial division by 2, 3 and the numbers beside multiples of 6."""
    top = F.greatest(F.floor((F.sqrt(n.cast("double")) + 1) / 6), F.lit(1)).cast("int")
    beside = F.exists(F.sequence(F.lit(1), top), lambda k: ((n % (6 * k - 1) == 0) & (n > 6 * k - 1)) | ((n % (6 * k + 1) == 0) & (n > 6 * k + 1)))
    return F.when(n < 2, False).when(n < 4, True).when((n % 2 == 0) | (n % 3 == 0), False).otherwise(~beside)


def prime_factors(n: Column) -> Column:
    """With multiplicity, ascending."""
    top = F.greatest(F.floor(F.sqrt(n.cast("double"))), F.lit(2)).cast("int")

    def step(s, d):
        many = F.aggregate(F.sequence(F.lit(1), F.lit(62)), F.struct(s["n"].alias("n"), F.lit(0).alias("c")), lambda t, _: F.when((t["n"] > 1) & (t["n"] % d == 0), F.struct(F.call_function("div", t["n"], d.cast("bigint")).alias("n"), (t["c"] + 1).alias("c"))).otherwise(t))
        return F.when(s["n"] % d != 0, s).otherwise(let(many, lambda m: F.struct(m["n"].alias("n"), F.concat(s["f"], F.array_repeat(d.cast("bigint"), m["c"])).alias("f"))))

    start = F.struct(n.cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("f"))
    return F.aggregate(F.sequence(F.lit(2), top), start, step, lambda s: F.when(s["n"] > 1, F.array_append(s["f"], s["n"])).otherwise(s["f"]))


def next_prime(n: Column) -> Column:
    """The smallest prime above n; gaps below 2 ** 31 are shorter than 300."""
    return F.get(F.filter(F.sequence(F.greatest(n, F.lit(1)).cast("bigint") + 1, F.greatest(n, F.lit(1)).cast("bigint") + 300), is_prime), F.lit(0))


def nth_prime(n: Column) -> Column:
    """The n-th prime, from 1; null for n below 1. The n-th lies under n (ln n + ln ln n) from the sixth on."""
    m = F.greatest(n, F.lit(1)).cast("double")
    top = F.when(n < 6, F.lit(13)).otherwise(F.ceil(m * (F.ln(m) + F.ln(F.greatest(F.ln(F.greatest(m, F.lit(3.0))), F.lit(0.1)))))).cast("bigint")
    return F.when(n >= 1, F.get(F.filter(F.sequence(F.lit(2).cast("bigint"), top), is_prime), (n - 1).cast("int")))


def mod(a: Column, b: Column) -> Column:
    """Never negative for a positive b."""
    return F.pmod(a, b)


def div_mod(a: Column, b: Column) -> Column:
    return F.struct(F.floor(a / b).alias("_1"), F.pmod(a, b).alias("_2"))


def permutations(n: Column, k: Column) -> Column:
    return F.when(k > n, F.lit(0).cast("bigint")).otherwise(F.aggregate(F.when(k > 0, F.sequence(n - k + 1, n)).otherwise(F.array().cast("array<bigint>")), F.lit(1).cast("bigint"), lambda a, x: a * x))


def combinations(n: Column, k: Column) -> Column:
    m = F.least(k, n - k)
    return F.when((k < 0) | (k > n), F.lit(0).cast("bigint")).otherwise(
        F.aggregate(F.when(m > 0, F.sequence(F.lit(1).cast("bigint"), F.greatest(m, F.lit(1)).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), F.lit(1).cast("bigint"), lambda a, i: F.call_function("div", a * (n.cast("bigint") - m + i), i))
    )


binomial = combinations


def smoothstep(e0: Column, e1: Column, x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - e0) / (e1 - e0)))
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


# complex numbers: struct<re, im>


def complex_(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def real(c: Column) -> Column:
    return c["re"]


def imag(c: Column) -> Column:
    return c["im"]


def conjugate(c: Column) -> Column:
    return complex_(c["re"], -c["im"])


def complex_mag(c: Column) -> Column:
    return F.hypot(c["re"], c["im"])


def complex_phase(c: Column) -> Column:
    return F.atan2(c["im"], c["re"])


def complex_add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def complex_sub(a: Column, b: Column) -> Column:
    return complex_(a["re"] - b["re"], a["im"] - b["im"])


def complex_mul(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_div(a: Column, b: Column) -> Column:
    d = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_((a["re"] * b["re"] + a["im"] * b["im"]) / d, (a["im"] * b["re"] - a["re"] * b["im"]) / d)


def complex_sqrt(c: Column) -> Column:
    """The root with the real part that isn't negative."""
    r, half = F.sqrt(complex_mag(c)), complex_phase(c) / 2
    return complex_(r * F.cos(half), r * F.sin(half))


def complex_exp(c: Column) -> Column:
    return complex_(F.exp(c["re"]) * F.cos(c["im"]), F.exp(c["re"]) * F.sin(c["im"]))


def linspace(a: float, b: float, n: int) -> Column:
    """n values from a to b; a alone for n = 1."""
    if n <= 1:
        return F.array(*[F.lit(float(a))] * max(n, 0)).cast("array<double>")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(a)) + i * F.lit((b - a) / (n - 1)))


def logspace(a: float, b: float, n: int) -> Column:
    return F.transform(linspace(a, b, n), lambda x: F.pow(F.lit(10.0), x))


def arange(a: float, b: float, step: float = 1.0) -> Column:
    """a, a + step, ... before b."""
    n = max(0, math.ceil((b - a) / step - 1e-12))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(a)) + i * F.lit(float(step))) if n else F.array().cast("array<double>")
