"""Sets as arrays of distinct values, and the same operations over rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of(*xs: Column) -> Column:
    return F.array_distinct(F.array(*xs))


def empty(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


from_list = F.array_distinct


def size(s: Column) -> Column:
    return F.size(s)


def is_empty(s: Column) -> Column:
    return F.size(s) == 0


def contains(s: Column, x) -> Column:
    return F.array_contains(s, x)


def add(s: Column, x) -> Column:
    return F.array_union(s, F.array(x if isinstance(x, Column) else F.lit(x)))


def remove(s: Column, x) -> Column:
    return F.array_remove(s, x)


def to_list(s: Column) -> Column:
    """Sorted by the printed values."""
    return F.transform(F.array_sort(F.transform(s, lambda x: F.struct(x.cast("string").alias("k"), x.alias("x")))), lambda e: e["x"])


union, intersection, difference = F.array_union, F.array_intersect, F.array_except


def is_subset(s: Column, o: Column) -> Column:
    return F.size(F.array_except(s, o)) == 0


def is_superset(s: Column, o: Column) -> Column:
    return F.size(F.array_except(o, s)) == 0


def is_disjoint(s: Column, o: Column) -> Column:
    return F.size(F.array_intersect(s, o)) == 0


def symmetric_difference(s: Column, o: Column) -> Column:
    return F.array_union(F.array_except(s, o), F.array_except(o, s))


def toggle(s: Column, x) -> Column:
    return F.when(F.array_contains(s, x), F.array_remove(s, x)).otherwise(F.array_append(s, x))


def map_(s: Column, f: Callable) -> Column:
    return F.array_distinct(F.transform(s, f))


def filter_(s: Column, p: Callable) -> Column:
    return F.filter(s, p)


def flat_map(s: Column, f: Callable) -> Column:
    return F.array_distinct(F.flatten(F.transform(s, f)))


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def symmetric_difference_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(*a.columns)
    return a.subtract(b).union(b.subtract(a))
