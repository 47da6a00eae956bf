"""Array functions without side effects: each gives a new array (or a struct of array and value where an element is taken out).

na elements are null.  Searches and comparisons of numbers are within 1e-10.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.na import EPSILON

def abs(a: Column) -> Column:  # noqa: A001
    return F.transform(a, F.abs)


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def known(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def sum(a: Column) -> Column:  # noqa: A001
    return let(known(a), lambda k: F.when(F.size(k) > 0, _sum(k)))


def avg(a: Column) -> Column:
    return let(known(a), lambda k: F.try_divide(_sum(k), F.size(k)))


def max(a: Column, nth: int = 0) -> Column:  # noqa: A001
    return F.get(F.sort_array(known(a), asc=False), F.lit(nth))


def min(a: Column, nth: int = 0) -> Column:  # noqa: A001
    return F.get(F.sort_array(known(a)), F.lit(nth))


def range(a: Column) -> Column:  # noqa: A001
    return F.array_max(a) - F.array_min(a)


def _middle(s: Column) -> Column:
    n = F.size(s)
    return F.when(n > 0, F.when(n % 2 == 1, F.get(s, (n / 2).cast("int"))).otherwise((F.get(s, (n / 2).cast("int") - 1) + F.get(s, (n / 2).cast("int"))) / 2))


def median(a: Column) -> Column:
    return let(F.sort_array(known(a)), _middle)


def mode(a: Column) -> Column:
    """The most frequent value, of equals the first met."""

    def best(k: Column) -> Column:
        counted = F.transform(F.array_distinct(k), lambda v, i: F.struct(F.size(F.filter(k, lambda x: x == v)).alias("n"), (-i).alias("i"), v.alias("v")))
        return F.array_max(counted)["v"]

    return let(known(a), best)


def variance(a: Column, biased: bool = True) -> Column:
    def of(k: Column) -> Column:
        n = F.size(k)
        mean = lambda k: _sum(k) / F.size(k)
        square = let(mean(k), lambda m: F.aggregate(k, F.lit(0.0), lambda t, x: t + (x - m) * (x - m)))
        return F.when(n < 2, F.lit(0.0)).otherwise(square / (n if biased else n - 1))

    return let(known(a), of)


def stdev(a: Column, biased: bool = True) -> Column:
    return F.sqrt(variance(a, biased))


def standardize(a: Column) -> Column:
    """z-scores; where all values are equal, 1.0."""
    return let(F.struct(avg(a).alias("m"), stdev(a).alias("s")), lambda p: F.transform(a, lambda x: F.when(p["s"] == 0, F.lit(1.0)).otherwise((x - p["m"]) / p["s"])))


def covariance(a: Column, b: Column, biased: bool = True) -> Column:
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())

    def of(p: Column) -> Column:
        n = F.size(p)
        mean = lambda f: F.aggregate(p, F.lit(0.0), lambda t, e: t + e[f]) / n
        total = let(F.struct(mean("x").alias("x"), mean("y").alias("y")), lambda m: F.aggregate(p, F.lit(0.0), lambda t, e: t + (e["x"] - m["x"]) * (e["y"] - m["y"])))
        return F.coalesce(F.try_divide(total, n if biased else n - 1), F.lit(0.0))

    return let(pairs, of)


def every(a: Column) -> Column:
    return (F.size(a) > 0) & F.forall(a, lambda x: F.coalesce(x, F.lit(False)))


def some(a: Column) -> Column:
    return F.exists(a, lambda x: F.coalesce(x, F.lit(False)))


def same(x: Column, v: Column) -> Column:
    return F.coalesce(F.abs(x - v) <= EPSILON, F.lit(False))


def includes(a: Column, v: Column) -> Column:
    return F.exists(a, lambda x: same(x, v))


def indexof(a: Column, v: Column) -> Column:
    return (F.array_position(F.transform(a, lambda x: same(x, v)), True) - 1).cast("int")


def lastindexof(a: Column, v: Column) -> Column:
    back = F.array_position(F.reverse(F.transform(a, lambda x: same(x, v))), True)
    return F.when(back > 0, F.size(a) - back).otherwise(-1).cast("int")


def binary_search(a: Column, v: Column) -> Column:
    return (F.array_position(a, v) - 1).cast("int")


def binary_search_leftmost(a: Column, v: Column) -> Column:
    """The first equal element of an ascending array, else the last smaller one (at least 0)."""
    less = F.size(F.filter(a, lambda x: x < v))
    return F.when(F.array_contains(a, v), less).otherwise(F.greatest(less - 1, F.lit(0)))


def binary_search_rightmost(a: Column, v: Column) -> Column:
    """The last equal element of an ascending array, else the first greater one."""
    upto = F.size(F.filter(a, lambda x: x <= v))
    return F.when(F.array_contains(a, v), upto - 1).otherwise(upto)


def get(a: Column, index: Column | int) -> Column:
    i = index if isinstance(index, Column) else F.lit(index)
    return F.get(a, F.when(i < 0, F.size(a) + i).otherwise(i).cast("int"))


def set(a: Column, index: Column | int, v: Column) -> Column:  # noqa: A001
    i = index if isinstance(index, Column) else F.lit(index)
    at = F.when(i < 0, F.size(a) + i).otherwise(i)
    return F.when(i.isNull(), a).otherwise(F.transform(a, lambda x, k: F.when(k == at, v).otherwise(x)))


def fill(a: Column, v: Column, index_from: int = 0, index_to: int | None = None) -> Column:
    end = F.size(a) if index_to is None else F.lit(index_to)
    return F.transform(a, lambda x, k: F.when((k >= index_from) & (k < end), v).otherwise(x))


def first(a: Column) -> Column: return F.get(a, F.lit(0))  # noqa: E704
def last(a: Column) -> Column: return F.get(a, F.size(a) - 1)  # noqa: E704
def size(a: Column) -> Column: return F.size(a)  # noqa: E704
def copy(a: Column) -> Column: return a  # noqa: E704
def concat(a: Column, b: Column) -> Column: return F.concat(a, b)  # noqa: E704
def reverse(a: Column) -> Column: return F.reverse(a)  # noqa: E704
def push(a: Column, v: Column) -> Column: return F.array_append(a, v)  # noqa: E704
def unshift(a: Column, v: Column) -> Column: return F.array_prepend(a, v)  # noqa: E704
def clear(a: Column) -> Column: return F.slice(a, 1, 0)  # noqa: E704
def join(a: Column, separator: str) -> Column: return F.array_join(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit("NaN"))), separator)  # noqa: E704
def from_items(*items: Column) -> Column: return F.array(*items)  # noqa: E704


def insert(a: Column, index: int | None, v: Column) -> Column:
    return F.array_append(a, v) if index is None else F.array_insert(a, index + 1 if index >= 0 else index, v)


def _without(a: Column, at: Column) -> Column:
    return F.filter(a, lambda x, k: k != at)


def remove(a: Column, index: int) -> Column:
    """struct(array, value): the element taken out, and the rest."""
    at = F.size(a) + index if index < 0 else F.lit(index)
    return F.struct(_without(a, at).alias("array"), F.get(a, at).alias("value"))


def pop(a: Column) -> Column: return remove(a, -1)  # noqa: E704
def shift(a: Column) -> Column: return remove(a, 0)  # noqa: E704


def slice(a: Column, index_from: int, index_to: int) -> Column:  # noqa: A001
    return F.slice(a, index_from + 1, index_to - index_from)


def new(kind: str, size: int = 0, value: object = None) -> Column:
    """Array of ``size`` equal values of a SQL type (``double``, ``bigint``, ``boolean``, ``string``)."""
    return F.array_repeat(F.lit(value).cast(kind), size)


def new_float(size: int = 0, value: float | None = None) -> Column: return new("double", size, value)  # noqa: E704
def new_int(size: int = 0, value: int | None = None) -> Column: return new("bigint", size, value)  # noqa: E704
def new_bool(size: int = 0, value: bool | None = None) -> Column: return new("boolean", size, value)  # noqa: E704
def new_string(size: int = 0, value: str | None = None) -> Column: return new("string", size, value)  # noqa: E704
def new_color(size: int = 0, value: str | None = None) -> Column: return new("string", size, value)  # noqa: E704


def percentile_nearest_rank(a: Column, percentage: float) -> Column:
    def pick(s: Column) -> Column:
        rank = F.least(F.greatest(F.ceil(F.lit(percentage) * F.size(s) / 100), F.lit(1)), F.size(s))
        return F.get(s, (rank - 1).cast("int"))

    return let(F.array_sort(a), pick)


def percentile_linear_interpolation(a: Column, percentage: float) -> Column:
    def pick(s: Column) -> Column:
        n = F.size(s)
        place = n * percentage / 100.0 + 0.5
        at = lambda k: F.get(s, (F.least(F.greatest(k, F.lit(1)), n) - 1).cast("int"))
        share = place - F.floor(place)
        return F.when(share == 0, at(F.floor(place))).otherwise(at(F.floor(place)) * (1 - share) + at(F.floor(place) + 1) * share)

    return let(F.array_sort(a), pick)


def percentrank(a: Column, index: int) -> Column:
    at = F.get(a, F.lit(index))
    n = F.size(a) - 1
    return let(at, lambda v: F.try_divide((F.size(F.filter(a, lambda x: x - v <= EPSILON)) - 1) * 100.0, n))


def sort(a: Column, ascending: bool = True) -> Column:
    """Numbers with na last; descending is the reverse of that."""
    return F.array_sort(a) if ascending else F.reverse(F.array_sort(a))


def sort_indices(a: Column, ascending: bool = True) -> Column:
    pairs = F.transform(a, lambda x, i: F.struct(x.isNull().alias("na"), x.alias("x"), i.alias("i")))
    found = F.transform(F.sort_array(pairs), lambda p: p["i"])
    return found if ascending else F.reverse(found)

