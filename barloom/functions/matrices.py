"""Matrix functions over array<array<double>> (rows of equal length)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions import arrays as A

let = A.let
MATRIX = "array<array<double>>"


def new(rows: int = 0, columns: int = 0, value: float | None = None) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(value).cast("double"), columns), rows)


def rows(m: Column) -> Column: return F.size(m)  # noqa: E704
def columns(m: Column) -> Column: return F.when(F.size(m) > 0, F.size(F.get(m, F.lit(0)))).otherwise(0)  # noqa: E704
def elements_count(m: Column) -> Column: return rows(m) * columns(m)  # noqa: E704
def copy(m: Column) -> Column: return m  # noqa: E704
def get(m: Column, row: int, column: int) -> Column: return F.get(F.get(m, F.lit(row)), F.lit(column))  # noqa: E704
def row(m: Column, i: int) -> Column: return F.get(m, F.lit(i))  # noqa: E704
def col(m: Column, j: int) -> Column: return F.transform(m, lambda r: F.get(r, F.lit(j)))  # noqa: E704
def concat(a: Column, b: Column) -> Column: return F.concat(a, b)  # noqa: E704


def set(m: Column, i: int, j: int, value: Column) -> Column:  # noqa: A001
    return F.transform(m, lambda r, a: F.when(a == i, F.transform(r, lambda x, b: F.when(b == j, value).otherwise(x))).otherwise(r))


def fill(m: Column, value: Column, from_row: int = 0, to_row: int | None = None, from_column: int = 0, to_column: int | None = None) -> Column:
    inside = lambda k, a, b: (k >= a) & (F.lit(True) if b is None else k < b)
    return F.transform(m, lambda r, i: F.transform(r, lambda x, j: F.when(inside(i, from_row, to_row) & inside(j, from_column, to_column), value).otherwise(x)))


def add_row(m: Column, at: int | None, values: Column) -> Column:
    return F.array_append(m, values) if at is None else F.array_insert(m, at + 1, values)


def add_col(m: Column, at: int | None, values: Column) -> Column:
    return F.zip_with(m, values, lambda r, x: F.array_append(r, x) if at is None else F.array_insert(r, at + 1, x))


def remove_row(m: Column, at: int | None = None) -> Column:
    k = F.size(m) - 1 if at is None else F.lit(at)
    return F.struct(F.filter(m, lambda r, i: i != k).alias("matrix"), F.get(m, k).alias("row"))


def remove_col(m: Column, at: int | None = None) -> Column:
    k = columns(m) - 1 if at is None else F.lit(at)
    return F.struct(F.transform(m, lambda r: F.filter(r, lambda x, j: j != k)).alias("matrix"), F.transform(m, lambda r: F.get(r, k)).alias("column"))


def swap_rows(m: Column, a: int, b: int) -> Column:
    return F.transform(m, lambda r, i: F.when(i == a, F.get(m, F.lit(b))).when(i == b, F.get(m, F.lit(a))).otherwise(r))


def swap_columns(m: Column, a: int, b: int) -> Column:
    return F.transform(m, lambda r: F.transform(r, lambda x, j: F.when(j == a, F.get(r, F.lit(b))).when(j == b, F.get(r, F.lit(a))).otherwise(x)))


def submatrix(m: Column, from_row: int = 0, to_row: int | None = None, from_column: int = 0, to_column: int | None = None) -> Column:
    cut = lambda a, lo, hi: F.slice(a, F.lit(lo + 1), (F.size(a) if hi is None else F.lit(hi)) - lo)
    return F.transform(cut(m, from_row, to_row), lambda r: cut(r, from_column, to_column))


def reshape(m: Column, n_rows: int, n_columns: int) -> Column:
    return let(F.flatten(m), lambda f: F.transform(F.sequence(F.lit(0), F.lit(n_rows - 1)), lambda i: F.slice(f, i * n_columns + 1, F.lit(n_columns))))


def reverse(m: Column) -> Column: return F.reverse(F.transform(m, F.reverse))  # noqa: E704
def transpose(m: Column) -> Column: return F.transform(F.sequence(F.lit(0), columns(m) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))  # noqa: E704
def avg(m: Column) -> Column: return A.avg(F.flatten(m))  # noqa: E704
def max(m: Column) -> Column: return F.array_max(F.flatten(m))  # noqa: A001, E704
def min(m: Column) -> Column: return F.array_min(F.flatten(m))  # noqa: A001, E704
def median(m: Column) -> Column: return A.median(F.flatten(m))  # noqa: E704
def mode(m: Column) -> Column: return A.mode(F.flatten(m))  # noqa: E704


def _cells(a: Column, b: Column | float, f: Callable) -> Column:
    if isinstance(b, int | float):
        return F.transform(a, lambda r: F.transform(r, lambda x: f(x, F.lit(float(b)))))
    return F.zip_with(a, b, lambda r, s: F.zip_with(r, s, f))


def sum(a: Column, b: Column | float) -> Column: return _cells(a, b, lambda x, y: x + y)  # noqa: A001, E704
def diff(a: Column, b: Column | float) -> Column: return _cells(a, b, lambda x, y: x - y)  # noqa: E704


def trace(m: Column) -> Column:
    return F.aggregate(F.transform(m, lambda r, i: F.get(r, i)), F.lit(0.0), lambda t, x: t + x)


def mult(a: Column, b: Column | float) -> Column:
    """Product with a matrix or a number (JVM-side)."""
    if isinstance(b, int | float):
        return _cells(a, b, lambda x, y: x * y)
    dot = lambda r, c: F.aggregate(F.zip_with(r, c, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return let(transpose(b), lambda t: F.transform(a, lambda r: F.transform(t, lambda c: dot(r, c))))


def mult_vector(a: Column, v: Column) -> Column:
    return F.transform(a, lambda r: F.aggregate(F.zip_with(r, v, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x))


def kron(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda r: F.transform(b, lambda s: F.flatten(F.transform(r, lambda x: F.transform(s, lambda y: x * y))))))


def sort(m: Column, column: int = 0, ascending: bool = True) -> Column:
    keyed = F.transform(m, lambda r, i: F.struct(F.get(r, F.lit(column)).alias("k"), i.alias("i"), r.alias("r")))
    found = F.transform(F.sort_array(keyed), lambda s: s["r"])
    return found if ascending else F.reverse(found)


def _each(m: Column, f: Callable) -> Column:
    """Whether f(value, i, j) holds for every cell."""
    return F.forall(F.transform(m, lambda r, i: F.forall(F.transform(r, lambda x, j: f(x, i, j)), lambda b: b)), lambda b: b)


def is_square(m: Column) -> Column: return rows(m) == columns(m)  # noqa: E704
def is_zero(m: Column) -> Column: return _each(m, lambda x, i, j: x == 0)  # noqa: E704
def is_binary(m: Column) -> Column: return _each(m, lambda x, i, j: (x == 0) | (x == 1))  # noqa: E704
def is_diagonal(m: Column) -> Column: return is_square(m) & _each(m, lambda x, i, j: (i == j) | (x == 0))  # noqa: E704
def is_antidiagonal(m: Column) -> Column: return is_square(m) & _each(m, lambda x, i, j: (i + j == F.size(m) - 1) | (x == 0))  # noqa: E704
def is_identity(m: Column) -> Column: return is_square(m) & _each(m, lambda x, i, j: x == F.when(i == j, 1.0).otherwise(0.0))  # noqa: E704
def is_symmetric(m: Column) -> Column: return is_square(m) & _each(m, lambda x, i, j: x == F.get(F.get(m, j), i))  # noqa: E704
def is_antisymmetric(m: Column) -> Column: return is_square(m) & _each(m, lambda x, i, j: x == -F.get(F.get(m, j), i))  # noqa: E704
def is_triangular(m: Column) -> Column: return is_square(m) & (_each(m, lambda x, i, j: (i <= j) | (x == 0)) | _each(m, lambda x, i, j: (i >= j) | (x == 0)))  # noqa: E704


def is_stochastic(m: Column) -> Column:
    whole = F.forall(m, lambda r: F.abs(F.aggregate(r, F.lit(0.0), lambda t, x: t + x) - 1) <= A.EPSILON)
    return whole & _each(m, lambda x, i, j: x >= 0)


def _numeric(kind: str, f: Callable[[np.ndarray], object]) -> Callable[[Column], Column]:
    """An Arrow function over dense matrices, called once for all of one shape in a batch; null for null matrices, nulls inside and where ``f`` gives None."""

    def call(m: Column) -> Column:
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            out: list[object] = [None] * len(s)
            by_shape: dict[tuple, list[int]] = {}
            dense = [None if v is None else np.array([np.asarray(r, np.float64) for r in v]) for v in s]
            for i, a in enumerate(dense):
                if a is not None and np.isfinite(a).all():
                    by_shape.setdefault(a.shape, []).append(i)
            for rows in by_shape.values():
                for i, value in zip(rows, f(np.stack([dense[i] for i in rows])), strict=True):
                    out[i] = value
            return pd.Series(out, dtype=object)

        return run(m)

    return call


def _eigenvalues(a: np.ndarray) -> list[list[float]]:
    if a.shape[1:] == (1, 1):
        return a[:, 0].tolist()
    if a.shape[1:] != (2, 2):
        return [[]] * len(a)
    half, product = (a[:, 0, 0] + a[:, 1, 1]) / 2, a[:, 0, 0] * a[:, 1, 1] - a[:, 0, 1] * a[:, 1, 0]
    root = np.sqrt(np.maximum(half * half - product, 0.0))
    return np.stack((half + root, half - root), axis=1).tolist()


def _inverse(a: np.ndarray) -> list[object]:
    """Inverses; singular matrices have none."""
    regular = np.linalg.det(a) != 0
    out = np.zeros_like(a)
    out[regular] = np.linalg.inv(a[regular])
    return [m if ok else None for m, ok in zip(out.tolist(), regular.tolist(), strict=True)]


det = _numeric("double", lambda a: np.linalg.det(a).tolist())
inv = _numeric(MATRIX, _inverse)
pinv = _numeric(MATRIX, lambda a: np.linalg.pinv(a).tolist())
rank = _numeric("int", lambda a: np.linalg.matrix_rank(a).tolist())
eigenvalues = _numeric("array<double>", _eigenvalues)
eigenvectors = _numeric(MATRIX, lambda a: [np.eye(a.shape[1]).tolist()] * len(a))


def pow(m: Column, power: int) -> Column:  # noqa: A001
    return _numeric(MATRIX, lambda a: np.linalg.matrix_power(a, power).tolist())(m)
