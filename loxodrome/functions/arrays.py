"""n-dimensional arrays: struct<data, shape>, row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loxodrome.functions import linalg, mathx


def make(data: Column, shape: Column) -> Column:
    return F.struct(data.cast("array<double>").alias("data"), shape.cast("array<int>").alias("shape"))


def _shape(dims) -> Column:
    return F.array(*[F.lit(int(d)) for d in dims])


def full(dims, v: float) -> Column:
    return make(F.array_repeat(F.lit(float(v)), math.prod(dims)), _shape(dims))


def zeros(dims) -> Column:
    return full(dims, 0.0)


def ones(dims) -> Column:
    return full(dims, 1.0)


def eye(n: int) -> Column:
    return make(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.when(i % (n + 1) == 0, 1.0).otherwise(0.0)), _shape([n, n]))


def linspace(a: float, b: float, n: int) -> Column:
    return make(mathx.linspace(a, b, n), _shape([n]))


def arange(a: float, b: float, step: float = 1.0) -> Column:
    d = mathx.arange(a, b, step)
    return make(d, F.array(F.size(d)))


def from_list(a: Column) -> Column:
    return make(a, F.array(F.size(a)))


def from_nested(a: Column) -> Column:
    """Of lists of equal length; an error for others."""
    n = F.size(F.get(a, F.lit(0)))
    flat = F.when(F.forall(a, lambda r: F.size(r) == n), F.flatten(a)).otherwise(F.raise_error(F.lit("ragged nested list")).cast("array<double>"))
    return make(flat, F.array(F.size(a), n))


def shape(a: Column) -> Column:
    return a["shape"]


def ndim(a: Column) -> Column:
    return F.size(a["shape"])


def size(a: Column) -> Column:
    return F.size(a["data"])


def dtype(a: Column) -> Column:
    return F.lit("float")


def to_list(a: Column) -> Column:
    return a["data"]


def flatten(a: Column) -> Column:
    return from_list(a["data"])


def reshape(a: Column, dims) -> Column:
    return make(F.when(size(a) == math.prod(dims), a["data"]).otherwise(F.raise_error(F.lit("cannot reshape: sizes differ")).cast("array<double>")), _shape(dims))


def transpose(a: Column) -> Column:
    """Of two dimensions."""
    r, c = F.get(a["shape"], F.lit(0)), F.get(a["shape"], F.lit(1))
    return make(F.transform(F.sequence(F.lit(0), size(a) - 1), lambda k: F.get(a["data"], (k % r) * c + F.floor(k / r).cast("int"))), F.array(c, r))


T = transpose


def sum_(a: Column) -> Column:
    return F.aggregate(a["data"], F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(size(a) == 0, 0.0).otherwise(sum_(a) / F.greatest(size(a), F.lit(1)))


def min_(a: Column) -> Column:
    return F.coalesce(F.array_min(a["data"]), F.raise_error(F.lit("min of an empty array")).cast("double"))


def max_(a: Column) -> Column:
    return F.coalesce(F.array_max(a["data"]), F.raise_error(F.lit("max of an empty array")).cast("double"))


def var(a: Column) -> Column:
    """Of the population."""
    m = mean(a)
    return F.aggregate(a["data"], F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / size(a)


def std(a: Column) -> Column:
    return F.sqrt(var(a))


def argmin(a: Column) -> Column:
    return F.array_position(a["data"], F.array_min(a["data"])) - 1


def argmax(a: Column) -> Column:
    return F.array_position(a["data"], F.array_max(a["data"])) - 1


def cumsum(a: Column) -> Column:
    run = F.aggregate(a["data"], F.array().cast("array<double>"), lambda s, x: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + x))
    return make(run, a["shape"])


def cumprod(a: Column) -> Column:
    run = F.aggregate(a["data"], F.array().cast("array<double>"), lambda s, x: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(1.0)) * x))
    return make(run, a["shape"])


def each(a: Column, f) -> Column:
    """f of every element."""
    return make(F.transform(a["data"], f), a["shape"])


def rows(a: Column) -> Column:
    """array<array<double>> of two dimensions."""
    r, c = F.get(a["shape"], F.lit(0)), F.get(a["shape"], F.lit(1))
    return F.transform(F.sequence(F.lit(0), r - 1), lambda i: F.slice(a["data"], i * c + 1, c))


def sum_axis(a: Column, axis: int) -> Column:
    m = rows(a) if axis == 1 else rows(transpose(a))
    return from_list(F.transform(m, lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + x)))


def mean_axis(a: Column, axis: int) -> Column:
    """The means along an axis of two dimensions."""
    m = rows(a) if axis == 1 else rows(transpose(a))
    return from_list(F.transform(m, lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + x) / F.size(r)))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two lists."""
    return linalg.dot(a["data"], b["data"])


def matmul(a: Column, b: Column) -> Column:
    return from_nested(linalg.mat_mul(rows(a), rows(b)))
