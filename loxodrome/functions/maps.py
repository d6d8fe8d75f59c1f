"""Map methods. The right side wins where keys meet, whatever the session's policy for duplicate keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(m: Column) -> Column:
    return F.size(m)


def is_empty(m: Column) -> Column:
    return F.size(m) == 0


keys, values, entries = F.map_keys, F.map_values, F.map_entries


def get(m: Column, k) -> Column:
    return F.try_element_at(m, F.lit(k))


def contains(m: Column, k) -> Column:
    return F.map_contains_key(m, k)


def get_or_default(m: Column, k, d) -> Column:
    return F.when(F.map_contains_key(m, k), F.try_element_at(m, F.lit(k))).otherwise(d)


def merge(m: Column, o: Column, resolver: Callable | None = None) -> Column:
    """Entries of both; where both have a key, o's value or resolver(old, new)."""
    both = resolver or (lambda a, b: b)
    return F.map_zip_with(m, o, lambda k, a, b: F.when(F.map_contains_key(m, k) & F.map_contains_key(o, k), both(a, b)).when(F.map_contains_key(o, k), b).otherwise(a))


put_all = merge


def put(m: Column, k, v) -> Column:
    return merge(m, F.create_map(F.lit(k), v if isinstance(v, Column) else F.lit(v)))


def remove(m: Column, k) -> Column:
    return F.map_filter(m, lambda key, _: key != F.lit(k))


def map_values(m: Column, f: Callable) -> Column:
    return F.transform_values(m, lambda _, v: f(v))


def map_keys(m: Column, f: Callable) -> Column:
    return F.transform_keys(m, lambda k, _: f(k))


def filter_(m: Column, p: Callable) -> Column:
    return F.map_filter(m, p)


def filter_keys(m: Column, p: Callable) -> Column:
    return F.map_filter(m, lambda k, _: p(k))


def filter_values(m: Column, p: Callable) -> Column:
    return F.map_filter(m, lambda _, v: p(v))


def update(m: Column, k, f: Callable) -> Column:
    return F.transform_values(m, lambda key, v: F.when(key == F.lit(k), f(v)).otherwise(v))


def update_or_insert(m: Column, k, d, f: Callable) -> Column:
    return F.when(F.map_contains_key(m, k), update(m, k, f)).otherwise(put(m, k, d))
