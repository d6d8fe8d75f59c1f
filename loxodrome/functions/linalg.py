"""Vectors (array<double>) and matrices (array<array<double>>).

Products, norms and constructors are column expressions; decompositions are Arrow functions over numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MATRIX = "array<array<double>>"
SMALLEST_PIVOT, RANK_TOLERANCE = 1e-12, 1e-10


def vector(*xs) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in xs]).cast("array<double>")


def matrix(*rows) -> Column:
    return F.array(*[r if isinstance(r, Column) else vector(*r) for r in rows])


def length(v: Column) -> Column:
    return F.size(v)


def to_list(v: Column) -> Column:
    """A vector is an array, and a matrix one of arrays."""
    return v


def x(v: Column) -> Column:
    return F.get(v, F.lit(0))


def y(v: Column) -> Column:
    return F.get(v, F.lit(1))


def z(v: Column) -> Column:
    return F.get(v, F.lit(2))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cross(a: Column, b: Column) -> Column:
    g = F.get
    i = lambda v, k: g(v, F.lit(k))
    return F.array(i(a, 1) * i(b, 2) - i(a, 2) * i(b, 1), i(a, 2) * i(b, 0) - i(a, 0) * i(b, 2), i(a, 0) * i(b, 1) - i(a, 1) * i(b, 0))


def magnitude(v: Column) -> Column:
    return F.sqrt(dot(v, v))


norm = magnitude


def normalize(v: Column) -> Column:
    """Of length 1; an error for the zero vector."""
    n = magnitude(v)
    return F.when(n == 0, F.raise_error(F.lit("cannot normalize zero vector")).cast("array<double>")).otherwise(F.transform(v, lambda x: x / n))


unit = normalize


def vec_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vec_sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vec_mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def vec_div(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x / y)


def vec_scale(v: Column, k) -> Column:
    return F.transform(v, lambda x: x * k)


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (magnitude(a) * magnitude(b)))))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def project_onto(a: Column, b: Column) -> Column:
    return vec_scale(b, dot(a, b) / dot(b, b))


def reject_from(a: Column, b: Column) -> Column:
    return vec_sub(a, project_onto(a, b))


def vector_norm(v: Column, p: float = 2) -> Column:
    if p == float("inf"):
        return F.array_max(F.transform(v, F.abs))
    return F.pow(F.aggregate(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(p)))), F.lit(0.0), lambda s, x: s + x), F.lit(1.0 / p))


def rows(m: Column) -> Column:
    return F.size(m)


def cols(m: Column) -> Column:
    return F.size(F.get(m, F.lit(0)))


def get(m: Column, i: int, j: int) -> Column:
    """An error out of bounds."""
    return F.element_at(F.element_at(m, i + 1), j + 1)


def row(m: Column, i: int) -> Column:
    return F.element_at(m, i + 1)


def col(m: Column, j: int) -> Column:
    return F.transform(m, lambda r: F.element_at(r, j + 1))


def is_square(m: Column) -> Column:
    return rows(m) == cols(m)


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), cols(m) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))


def mat_vec_mul(m: Column, v: Column) -> Column:
    return F.transform(m, lambda r: dot(r, v))


def mat_mul(a: Column, b: Column) -> Column:
    return F.transform(a, lambda r: F.transform(transpose(b), lambda c: dot(r, c)))


def identity(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0)))


eye = identity


def full(r: int, c: int, x: float) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(float(x)), c), r)


def zeros(r: int, c: int) -> Column:
    return full(r, c, 0.0)


def ones(r: int, c: int) -> Column:
    return full(r, c, 1.0)


def diag(v: Column) -> Column:
    """The matrix with this diagonal."""
    return F.transform(v, lambda x, i: F.transform(v, lambda _, j: F.when(i == j, x).otherwise(0.0)))


def diagonal(m: Column) -> Column:
    return F.transform(m, lambda r, i: F.get(r, i))


def trace(m: Column) -> Column:
    return F.aggregate(diagonal(m), F.lit(0.0), lambda s, x: s + x)


def matrix_norm(m: Column) -> Column:
    return magnitude(F.flatten(m))


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, vec_mul)


def kronecker(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda ra: F.transform(b, lambda rb: F.flatten(F.transform(ra, lambda x: F.transform(rb, lambda y: x * y))))))


def hilbert(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.lit(1.0) / (i + j + 1)))


def vandermonde(v: Column) -> Column:
    return F.transform(v, lambda x: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda j: F.pow(x, j.cast("double"))))


def submatrix(m: Column, r0: int, r1: int, c0: int, c1: int) -> Column:
    """Rows r0 to before r1, columns c0 to before c1."""
    return F.transform(F.slice(m, r0 + 1, r1 - r0), lambda r: F.slice(r, c0 + 1, c1 - c0))


def det_small(m: Column) -> Column:
    """The determinant for up to three rows, as an expression."""
    g = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    two = g(0, 0) * g(1, 1) - g(0, 1) * g(1, 0)
    three = g(0, 0) * (g(1, 1) * g(2, 2) - g(1, 2) * g(2, 1)) - g(0, 1) * (g(1, 0) * g(2, 2) - g(1, 2) * g(2, 0)) + g(0, 2) * (g(1, 0) * g(2, 1) - g(1, 1) * g(2, 0))
    return F.when(F.size(m) == 1, g(0, 0)).when(F.size(m) == 2, two).when(F.size(m) == 3, three)


def _array(x) -> np.ndarray:
    return np.array([np.asarray(r, float) for r in x], float)


def _each(kind: str, f):
    """An Arrow function that applies f to each row's matrices and vectors; null in, null out."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in xs) else f(*xs) for xs in zip(*columns, strict=True)])

    return run


def _solve(a, b):
    m, v = _array(a), np.asarray(b, float)
    if abs(np.linalg.det(m)) < SMALLEST_PIVOT:
        raise ValueError("matrix is singular")
    return np.linalg.solve(m, v).tolist()


def _inverse(a):
    m = _array(a)
    if abs(np.linalg.det(m)) < SMALLEST_PIVOT:
        raise ValueError("matrix is singular")
    return np.linalg.inv(m).tolist()


def _lu(a):
    u = _array(a)
    n = len(u)
    lower, p = np.eye(n), np.eye(n)
    for k in range(n):
        top = k + int(np.argmax(np.abs(u[k:, k])))
        if top != k:
            u[[k, top]], p[[k, top]] = u[[top, k]], p[[top, k]]
            lower[[k, top], :k] = lower[[top, k], :k]
        if u[k, k]:
            lower[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(lower[k + 1 :, k], u[k])
    return {"L": lower.tolist(), "U": u.tolist(), "P": p.tolist()}


def _qr(a):
    q, r = np.linalg.qr(_array(a))
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    return {"Q": (q * s).tolist(), "R": (r * s[:, None]).tolist()}


def _eigen(a):
    e = np.linalg.eigvals(_array(a))
    return [{"re": float(x.real), "im": float(x.imag)} for x in sorted(e, key=lambda x: (-x.real, -x.imag))]


def _cond(a):
    s = np.linalg.svd(_array(a), compute_uv=False)
    s = s[s > 0]
    return float(s.max() / s.min()) if len(s) else float("inf")


def determinant(m: Column) -> Column:
    return _each("double", lambda a: float(np.linalg.det(_array(a))))(m)


det = determinant


def inverse(m: Column) -> Column:
    return _each(MATRIX, _inverse)(m)


def solve(m: Column, b: Column) -> Column:
    return _each("array<double>", _solve)(m, b)


def lu(m: Column) -> Column:
    return _records(f"L {MATRIX}, U {MATRIX}, P {MATRIX}", _lu)(m)


def _records(kind: str, f):
    """As _each, for functions that give a struct."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(*xs) for xs in zip(*columns, strict=True)])

    return run


def qr(m: Column) -> Column:
    """R with a diagonal that isn't negative."""
    return _records(f"Q {MATRIX}, R {MATRIX}", _qr)(m)


def eigenvalues(m: Column) -> Column:
    """array<struct<re, im>>, the largest real part first."""
    return _each("array<struct<re:double,im:double>>", _eigen)(m)


def singular_values(m: Column) -> Column:
    return _each("array<double>", lambda a: np.linalg.svd(_array(a), compute_uv=False).tolist())(m)


svd = singular_values


def rank(m: Column) -> Column:
    return _each("int", lambda a: int(np.linalg.matrix_rank(_array(a), tol=RANK_TOLERANCE)))(m)


def cond(m: Column) -> Column:
    """The largest singular value over the smallest positive one."""
    return _each("double", _cond)(m)


def pseudo_inverse(m: Column) -> Column:
    return _each(MATRIX, lambda a: np.linalg.pinv(_array(a)).tolist())(m)


def cholesky(m: Column) -> Column:
    return _each(MATRIX, lambda a: np.linalg.cholesky(_array(a)).tolist())(m)


def least_squares(m: Column, b: Column) -> Column:
    return _each("array<double>", lambda a, y: np.linalg.lstsq(_array(a), np.asarray(y, float), rcond=None)[0].tolist())(m, b)


def toeplitz(c: Column, r: Column) -> Column:
    """The matrix with this first column and, beyond its first element, this first row."""
    return F.transform(c, lambda _, i: F.transform(r, lambda __, j: F.when(j <= i, F.get(c, i - j)).otherwise(F.get(r, j - i))))


def companion(coeffs: Column) -> Column:
    """Of a polynomial, the highest power first; its eigenvalues are the roots."""
    n, lead = F.size(coeffs) - 1, F.get(coeffs, F.lit(0))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(i == 0, -F.get(coeffs, j + 1) / lead).when(i == j + 1, 1.0).otherwise(0.0)))


def _expm(a):
    m = _array(a)
    k = max(0, int(np.ceil(np.log2(max(np.abs(m).sum(1).max(), 1e-300)))) + 4)
    term = out = np.eye(len(m))
    for i in range(1, 24):
        term = term @ (m / 2**k) / i
        out = out + term
    return np.linalg.matrix_power(out, 2**k).tolist()


def expm(m: Column) -> Column:
    """The exponential, by a series of the halved matrix and squarings."""
    return _each(MATRIX, _expm)(m)


def low_rank(m: Column, k: int) -> Column:
    """The nearest matrix of rank k."""

    def run(a):
        u, s, v = np.linalg.svd(_array(a), full_matrices=False)
        return ((u[:, :k] * s[:k]) @ v[:k]).tolist()

    return _each(MATRIX, run)(m)


def nullspace(m: Column) -> Column:
    """An orthonormal basis of what the matrix maps to 0, a row each."""

    def run(a):
        _, s, v = np.linalg.svd(_array(a))
        return v[int((s > RANK_TOLERANCE).sum()) :].tolist()

    return _each(MATRIX, run)(m)
