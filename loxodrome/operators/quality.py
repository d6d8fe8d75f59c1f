"""Assertions as data-quality checks.

A check is a name and a condition on rows; null counts as a violation. ``report`` counts the
violations of all checks in one pass; ``enforced`` makes a row that violates one an error at run time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loxodrome.functions import core, geom

Check = tuple[str, Column]


def equal(a: Column, b) -> Column:
    return a.eqNullSafe(b)


def not_equal(a: Column, b) -> Column:
    return ~a.eqNullSafe(b)


def approximately(a: Column, b, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def greater_than(a: Column, b) -> Column:
    return a > b


def less_than(a: Column, b) -> Column:
    return a < b


def greater_or_equal(a: Column, b) -> Column:
    return a >= b


def less_or_equal(a: Column, b) -> Column:
    return a <= b


def between(v: Column, lo, hi) -> Column:
    return v.between(lo, hi)


def is_nil(x: Column) -> Column:
    return x.isNull()


def not_nil(x: Column) -> Column:
    return x.isNotNull()


def ok(r: Column) -> Column:
    return r["ok"]


def err(r: Column) -> Column:
    return ~r["ok"]


def empty(a: Column) -> Column:
    return F.size(a) == 0


def not_empty(a: Column) -> Column:
    return F.size(a) > 0


def length(a: Column, n: int) -> Column:
    return F.size(a) == n


def contains(a: Column, x, kind: str = "list") -> Column:
    """kind: list or set, string, map."""
    return {"string": F.contains, "map": F.map_contains_key}.get(kind, F.array_contains)(a, x if kind == "map" else F.lit(x))


def starts_with(s: Column, p: str) -> Column:
    return s.startswith(p)


def ends_with(s: Column, p: str) -> Column:
    return s.endswith(p)


def matches(s: Column, pattern: str) -> Column:
    return s.rlike(pattern)


def contains_all(a: Column, xs: list) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(x) for x in xs]), a)) == 0


def contains_none(a: Column, xs: list) -> Column:
    return F.size(F.array_intersect(F.array(*[F.lit(x) for x in xs]), a)) == 0


def blank(s: Column) -> Column:
    return s.rlike(r"^\s*$")


def type_(x: Column, name: str) -> Column:
    return core.typeof(x) == name


instanceof = type_


def positive(x: Column) -> Column:
    return x > 0


def negative(x: Column) -> Column:
    return x < 0


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def nan(x: Column) -> Column:
    return F.isnan(x)


def geo_valid(g: Column) -> Column:
    return geom.is_valid(g)


def geo_near_equal(a: Column, b: Column, tolerance: float) -> Column:
    """Of one kind and size, each vertex within the tolerance."""
    ca, cb = geom.coords(a), geom.coords(b)
    return (a["kind"] == b["kind"]) & (F.size(ca) == F.size(cb)) & F.forall(F.zip_with(ca, cb, lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance)), lambda v: F.coalesce(v, F.lit(False)))


def throws(action: Callable) -> bool:
    """Whether the action, such as df.collect, fails."""
    try:
        action()
    except Exception:  # noqa: BLE001  any failure is what is asked for
        return True
    return False


def does_not_throw(action: Callable) -> bool:
    return not throws(action)


def same(a, b) -> bool:
    return a is b


def _violations(checks: list[Check]) -> list[Column]:
    return [F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks]


def report(df: DataFrame, checks: list[Check]) -> DataFrame:
    """check, n, violations."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *_violations(checks))
    return counts.select("_n", F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("violations")) for name, _ in checks])).alias("r")).select("r.check", F.col("_n").alias("n"), "r.violations")


def enforced(df: DataFrame, checks: list[Check]) -> DataFrame:
    """df, where a row that violates a check is an error."""
    passed = F.lit(True)
    for name, c in checks:
        passed = passed & F.when(F.coalesce(c, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"assertion failed: {name}")).cast("boolean"))
    return df.filter(passed)


def observed(df: DataFrame, checks: list[Check], name: str = "checks") -> tuple[DataFrame, Observation]:
    """Soft: df, and the violations counted while it is used."""
    seen = Observation(name)
    return df.observe(seen, *_violations(checks)), seen


class Soft:
    """Assertions that are counted together in one pass; assert_all() names all that failed."""

    def __init__(self, df: DataFrame, checks: list[Check]):
        self.df, self.checks = df, checks

    def failed(self) -> list[str]:
        counts = self.df.agg(*_violations(self.checks)).first()  # one row
        return [name for name, _ in self.checks if counts[name]]

    def assert_all(self) -> None:
        if names := self.failed():
            raise AssertionError(f"failed: {', '.join(names)}")
