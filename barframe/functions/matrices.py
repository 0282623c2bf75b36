"""Matrix functions on array<array<double>>. Linear algebra runs in vectorised numpy functions, all else in expressions.

Reads of no element give na; operations whose shapes do not match leave the matrix as it is or give na.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from barframe.functions import arrays as A
from barframe.na import col, div

KIND = "array<array<double>>"
EPS = 1e-12


def _m(m) -> Column:
    return col(m).cast(KIND)


def new(rows=0, columns=0, initial=None) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(initial).cast("double"), columns), rows)


def rows(m) -> Column:
    return F.size(_m(m))


def columns(m) -> Column:
    return F.coalesce(F.size(F.get(_m(m), F.lit(0))), F.lit(0))


def elements_count(m) -> Column:
    return rows(m) * columns(m)


def get(m, r, c) -> Column:
    return F.get(F.get(_m(m), col(r)), col(c))


def set_(m, r, c, x) -> Column:
    r, c, x = col(r), col(c), col(x)
    return F.transform(_m(m), lambda v, i: F.when(i == r, A.set_(v, c, x)).otherwise(v))


def row(m, i) -> Column:
    return F.get(_m(m), col(i))


def col_(m, j) -> Column:
    return F.transform(_m(m), lambda r: F.get(r, col(j)))


def add_row(m, values, at=None) -> Column:
    m = _m(m)
    return A.insert(m, F.size(m) if at is None else at, col(values).cast("array<double>"))


def add_col(m, values, at=None) -> Column:
    m, v = _m(m), col(values)
    return F.transform(m, lambda r, i: A.insert(r, F.size(r) if at is None else col(at), F.get(v, i)))


def remove_row(m, i=None) -> Column:
    m = _m(m)
    return A.remove(m, F.size(m) - 1 if i is None else i)


def remove_col(m, j=None) -> Column:
    return F.transform(_m(m), lambda r: A.remove(r, F.size(r) - 1 if j is None else col(j)))


def _cells(m, f) -> Column:
    return F.transform(_m(m), lambda r, i: F.transform(r, lambda v, j: f(v, i, j)))


def _with(m, other, f) -> Column:
    if isinstance(other, (int, float)):
        return _cells(m, lambda v, i, j: f(v, F.lit(float(other))))
    return F.zip_with(_m(m), _m(other), lambda a, b: F.zip_with(a, b, f))


def sum_(m, other) -> Column:
    return _with(m, other, lambda a, b: a + b)


def diff(m, other) -> Column:
    return _with(m, other, lambda a, b: a - b)


def copy(m) -> Column:
    return _m(m)


def transpose(m) -> Column:
    m = _m(m)
    return F.when(columns(m) == 0, F.array().cast(KIND)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(columns(m) - 1, F.lit(0))), lambda j: F.transform(m, lambda r: F.get(r, j))))


def _flat(m) -> Column:
    return F.flatten(_m(m))


def avg(m) -> Column:
    return A.avg(_flat(m))


def max_(m) -> Column:
    return F.array_max(_flat(m))


def min_(m) -> Column:
    return F.array_min(_flat(m))


def median(m) -> Column:
    return A.median(_flat(m))


def mode(m) -> Column:
    return A.mode(_flat(m))


def fill(m, x, from_row=0, to_row=None, from_column=0, to_column=None) -> Column:
    r1, c1 = rows(m) if to_row is None else col(to_row), columns(m) if to_column is None else col(to_column)
    return _cells(m, lambda v, i, j: F.when((i >= from_row) & (i < r1) & (j >= from_column) & (j < c1), col(x).cast("double")).otherwise(v))


def concat(m, other) -> Column:
    return F.when(columns(m) == columns(other), F.concat(_m(m), _m(other))).otherwise(_m(m))


def swap_rows(m, a: int, b: int) -> Column:
    m = _m(m)
    return F.transform(m, lambda r, i: F.when(i == a, F.get(m, F.lit(b))).when(i == b, F.get(m, F.lit(a))).otherwise(r))


def swap_columns(m, a: int, b: int) -> Column:
    return F.transform(_m(m), lambda r: F.transform(r, lambda v, j: F.when(j == a, F.get(r, F.lit(b))).when(j == b, F.get(r, F.lit(a))).otherwise(v)))


def reshape(m, r: int, c: int) -> Column:
    flat = _flat(m)
    new_ = F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda i: F.slice(flat, i * c + 1, F.lit(c)))
    return F.when(F.size(flat) == r * c, new_).otherwise(_m(m))


def submatrix(m, from_row=0, to_row=None, from_column=0, to_column=None) -> Column:
    return F.transform(A.slice_(_m(m), from_row, to_row), lambda r: A.slice_(r, from_column, to_column))


def mult(m, other, kind: str = "matrix") -> Column:
    """Times a number, a matrix or (``kind="vector"``) an array; na where shapes do not match."""
    if isinstance(other, (int, float)):
        return _cells(m, lambda v, i, j: v * float(other))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    if kind == "vector":
        v = col(other).cast("array<double>")
        return F.when(columns(m) == F.size(v), F.transform(_m(m), lambda r: dot(r, v)))
    t = transpose(other)
    return F.when(columns(m) == rows(other), F.transform(_m(m), lambda r: F.transform(t, lambda c: dot(r, c))))


def trace(m) -> Column:
    m = _m(m)
    return F.when(is_square(m), F.aggregate(F.transform(m, lambda r, i: F.get(r, i)), F.lit(0.0), lambda s, v: s + v))


def reverse(m) -> Column:
    return F.reverse(F.transform(_m(m), lambda r: F.reverse(r)))


def sort(m, column: int = 0, order: str = "ascending") -> Column:
    """Rows by a column, na last; equal rows keep their order."""
    m = _m(m)
    by = A.sort_indices(col_(m, F.lit(column)), order)
    return F.transform(by, lambda i: F.get(m, i))


def kron(a, b) -> Column:
    a, b = _m(a), _m(b)
    block = F.transform(a, lambda r: F.transform(b, lambda s: F.flatten(F.transform(r, lambda x: F.transform(s, lambda y: x * y)))))
    return F.flatten(block)


def is_square(m) -> Column:
    return rows(m) == columns(m)


def _all(m, f) -> Column:
    return F.forall(F.flatten(_cells(m, lambda v, i, j: F.coalesce(f(v, i, j), F.lit(False)))), lambda x: x)


def is_zero(m) -> Column:
    return _all(m, lambda v, i, j: v == 0)


def is_identity(m) -> Column:
    return is_square(m) & _all(m, lambda v, i, j: v == F.when(i == j, 1.0).otherwise(0.0))


def is_diagonal(m) -> Column:
    return is_square(m) & _all(m, lambda v, i, j: (i == j) | (v == 0))


def is_antidiagonal(m) -> Column:
    n = rows(m)
    return is_square(m) & _all(m, lambda v, i, j: (i + j == n - 1) | (v == 0))


def is_symmetric(m) -> Column:
    m = _m(m)
    return is_square(m) & _all(m, lambda v, i, j: v == F.get(F.get(m, j), i))


def is_antisymmetric(m) -> Column:
    m = _m(m)
    return is_square(m) & _all(m, lambda v, i, j: v == -F.get(F.get(m, j), i))


def is_binary(m) -> Column:
    return _all(m, lambda v, i, j: (v == 0) | (v == 1))


def is_triangular(m) -> Column:
    return is_square(m) & (_all(m, lambda v, i, j: (i <= j) | (v == 0)) | _all(m, lambda v, i, j: (i >= j) | (v == 0)))


def is_stochastic(m) -> Column:
    m = _m(m)
    sums = F.transform(m, lambda r: F.aggregate(r, F.lit(0.0), lambda s, v: s + v))
    return is_square(m) & _all(m, lambda v, i, j: v >= 0) & F.forall(sums, lambda s: F.coalesce(F.abs(s - 1) <= 1e-10, F.lit(False)))


# --- linear algebra


def _array(x) -> np.ndarray | None:
    if x is None or len(x) == 0 or len({len(r) for r in x}) != 1:
        return None
    a = np.array([[np.nan if v is None else v for v in r] for r in x], float)
    return a if np.isfinite(a).all() and a.shape[1] else None


def _number(f):
    @pandas_udf("double")
    def run(m: pd.Series) -> pd.Series:
        return pd.Series([None if (a := _array(x)) is None else f(a) for x in m], dtype="float64")

    return run


def _matrix(f, kind: str = KIND):
    @pandas_udf(kind)
    def run(m: pd.Series) -> pd.Series:
        out = [None if (a := _array(x)) is None else f(a) for x in m]
        return pd.Series([None if a is None else a.tolist() for a in out])

    return run


def _square(f):
    return lambda a: f(a) if a.shape[0] == a.shape[1] else None


def det(m) -> Column:
    return _number(_square(lambda a: 0.0 if np.linalg.matrix_rank(a, tol=EPS) < len(a) else float(np.linalg.det(a))))(_m(m))


def inv(m) -> Column:
    return _matrix(_square(lambda a: None if np.linalg.matrix_rank(a, tol=EPS) < len(a) else np.linalg.inv(a)))(_m(m))


def pinv(m) -> Column:
    return _matrix(lambda a: np.linalg.pinv(a))(_m(m))


def rank(m) -> Column:
    return _number(lambda a: float(np.linalg.matrix_rank(a, tol=EPS)))(_m(m)).cast("int")


def pow_(m, power: int) -> Column:
    if power != int(power) or power < 0:
        return F.lit(None).cast(KIND)
    return _matrix(_square(lambda a: np.linalg.matrix_power(a, int(power))))(_m(m))


def eigenvalues(m) -> Column:
    return _matrix(_square(lambda a: np.sort(np.linalg.eigvals(a).real)[::-1]), "array<double>")(_m(m))


def _eigenvectors(a: np.ndarray) -> np.ndarray:
    """Unit columns by falling eigenvalue, the first significant component positive."""
    w, v = np.linalg.eig(a)
    v = v.real[:, np.argsort(-w.real, kind="stable")]
    v = v / np.linalg.norm(v, axis=0)
    for j in range(v.shape[1]):
        big = np.flatnonzero(np.abs(v[:, j]) > 1e-9)
        if len(big) and v[big[0], j] < 0:
            v[:, j] = -v[:, j]
    return v


def eigenvectors(m) -> Column:
    return _matrix(_square(_eigenvectors))(_m(m))


def normalised(m) -> Column:
    """Each row over its sum."""
    return F.transform(_m(m), lambda r: F.transform(r, lambda v: div(v, F.aggregate(r, F.lit(0.0), lambda s, x: s + x))))
