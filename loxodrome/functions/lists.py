"""List methods over array columns. Positions are from 0; an option is null where there is nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loxodrome.functions.core import let

Fn = Callable[..., Column]


def length(a: Column) -> Column:
    return F.size(a)


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def non_empty(a: Column) -> Column:
    return F.size(a) > 0


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


head = first


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def get(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def contains(a: Column, x) -> Column:
    return F.array_contains(a, x)


map_, filter_ = F.transform, F.filter
any_, all_ = F.exists, F.forall
reverse, append, prepend, flatten, distinct = F.reverse, F.array_append, F.array_prepend, F.flatten, F.array_distinct


def none(a: Column, p: Fn) -> Column:
    return ~F.exists(a, p)


def reduce(a: Column, init: Column, f: Fn) -> Column:
    return F.aggregate(a, init, f)


fold = reduce


def fold_right(a: Column, init: Column, f: Fn) -> Column:
    """f(x, acc) from the right."""
    return F.aggregate(F.reverse(a), init, lambda acc, x: f(x, acc))


def sum_(a: Column, kind: str = "double") -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda acc, x: acc + x)


def product(a: Column, kind: str = "double") -> Column:
    return F.aggregate(a, F.lit(1).cast(kind), lambda acc, x: acc * x)


def min_(a: Column) -> Column:
    return F.array_min(a)


def max_(a: Column) -> Column:
    return F.array_max(a)


def enumerate_(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(i.alias("_1"), x.alias("_2")))


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def tail(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def init(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def index_of(a: Column, x) -> Column:
    at = F.array_position(a, x)
    return F.when(at > 0, at - 1)


def find(a: Column, p: Fn) -> Column:
    return F.get(F.filter(a, p), F.lit(0))


def find_index(a: Column, p: Fn) -> Column:
    at = F.array_position(F.transform(a, p), F.lit(True))
    return F.when(at > 0, at - 1)


def flat_map(a: Column, f: Fn) -> Column:
    return F.flatten(F.transform(a, f))


def take(a: Column, n: int) -> Column:
    return F.slice(a, 1, max(n, 0))


def drop(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(max(n, 0) + 1), F.greatest(F.size(a) - max(n, 0), F.lit(0)))


def take_while(a: Column, p: Fn) -> Column:
    stop = F.array_position(F.transform(a, lambda x: F.coalesce(p(x), F.lit(False))), F.lit(False))
    return F.when(stop == 0, a).otherwise(F.slice(a, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))


def drop_while(a: Column, p: Fn) -> Column:
    stop = F.array_position(F.transform(a, lambda x: F.coalesce(p(x), F.lit(False))), F.lit(False)).cast("int")
    return F.when(stop == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, F.greatest(stop, F.lit(1)), F.size(a)))


def slice_(a: Column, start: int, stop: int | None = None) -> Column:
    """[start, stop), negative positions from the end."""
    n = F.size(a)
    low = n + start if start < 0 else F.lit(start)
    high = n if stop is None else n + stop if stop < 0 else F.lit(stop)
    low, high = F.least(F.greatest(low, F.lit(0)), n), F.least(F.greatest(high, F.lit(0)), n)
    return F.slice(a, low + 1, F.greatest(high - low, F.lit(0)))


def sort(a: Column) -> Column:
    return F.array_sort(a)


def sort_by(a: Column, key: Fn) -> Column:
    """Stable, by the key."""
    keyed = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def sort_with(a: Column, cmp: Fn) -> Column:
    """By a comparison that gives a negative number, 0 or a positive one."""
    return F.array_sort(a, lambda x, y: cmp(x, y).cast("int"))


def zip_(a: Column, b: Column) -> Column:
    """Pairs, as many as the shorter list has."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("_1"), y.alias("_2")))


def zip_with(a: Column, b: Column, f: Fn) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f)


def unzip(a: Column) -> Column:
    return F.struct(F.transform(a, lambda s: s["_1"]).alias("_1"), F.transform(a, lambda s: s["_2"]).alias("_2"))


def partition(a: Column, p: Fn) -> Column:
    yes = lambda x: F.coalesce(p(x), F.lit(False))
    return F.struct(F.filter(a, yes).alias("_1"), F.filter(a, lambda x: ~yes(x)).alias("_2"))


def group_by(a: Column, key: Fn) -> Column:
    """Map from each key to its elements, keys in the order they come first."""
    keys = F.array_distinct(F.transform(a, key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(a, lambda x: key(x).eqNullSafe(k))))


def chunked(a: Column, n: int) -> Column:
    return F.when(F.size(a) == 0, F.slice(F.array(a), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / n).cast("int") - 1), lambda k: F.slice(a, k * n + 1, F.lit(n))))


def windowed(a: Column, size: int, step: int = 1) -> Column:
    """Full windows only."""
    return F.when(F.size(a) < size, F.slice(F.array(a), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - size, F.lit(0)), F.lit(step)), lambda k: F.slice(a, k + 1, F.lit(size))))


def filter_map(a: Column, f: Fn) -> Column:
    return F.array_compact(F.transform(a, f))


def distinct_by(a: Column, key: Fn) -> Column:
    """The first element of each key."""
    return let(F.transform(a, key), lambda keys: F.filter(a, lambda x, i: F.array_position(keys, key(x)) == i + 1))


def min_by(a: Column, key: Fn) -> Column:
    return F.get(F.transform(F.slice(F.array_sort(F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))), 1, 1), lambda s: s["x"]), F.lit(0))


def max_by(a: Column, key: Fn) -> Column:
    """The first of those with the largest key."""
    keyed = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x")))
    return F.array_max(keyed)["x"]


def intersperse(a: Column, sep) -> Column:
    sep = sep if isinstance(sep, Column) else F.lit(sep)
    return F.slice(F.flatten(F.transform(a, lambda x: F.array(x, sep))), F.lit(1), F.greatest(2 * F.size(a) - 1, F.lit(0)))


def interleave(a: Column, b: Column) -> Column:
    """In turn; the longer list goes on alone."""
    n = F.least(F.size(a), F.size(b))
    paired = F.flatten(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.array(x, y)))
    return F.concat(paired, F.slice(a, n + 1, F.size(a)), F.slice(b, n + 1, F.size(b)))


def scan(a: Column, init: Column, f: Fn) -> Column:
    """The folds of all prefixes, from the empty one."""
    return F.aggregate(a, F.array(init), lambda acc, x: F.array_append(acc, f(F.element_at(acc, F.lit(-1)), x)))


def insert(a: Column, i: int, x) -> Column:
    return F.array_insert(a, i + 1, x) if i >= 0 else F.array_insert(a, i, x)


def remove(a: Column, i: int) -> Column:
    at = F.size(a) + i if i < 0 else F.lit(i)
    return F.filter(a, lambda _, k: k != at)


def join(a: Column, sep: str = "") -> Column:
    return F.array_join(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit("nil"))), sep)


def repeat(x: Column, n: int) -> Column:
    return F.array_repeat(x, n)


def generate(n: int, f: Fn) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f) if n > 0 else F.array()
