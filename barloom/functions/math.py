"""Scalar mathematics; null in, null out."""

from __future__ import annotations

import math as m
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

pi, e, phi, rphi = m.pi, m.e, (1 + m.sqrt(5)) / 2, (m.sqrt(5) - 1) / 2

abs = F.abs  # noqa: A001
acos, asin, atan, cos, sin, tan = F.acos, F.asin, F.atan, F.cos, F.sin, F.tan
exp, sign, todegrees, toradians = F.exp, F.signum, F.degrees, F.radians


def _all(columns: tuple[Column, ...], value: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in columns)), value)


def avg(*numbers: Column) -> Column:
    return reduce(lambda a, b: a + b, numbers) / len(numbers)


def max(*numbers: Column) -> Column:  # noqa: A001
    return _all(numbers, F.greatest(*numbers)) if len(numbers) > 1 else numbers[0]


def min(*numbers: Column) -> Column:  # noqa: A001
    return _all(numbers, F.least(*numbers)) if len(numbers) > 1 else numbers[0]


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("long")


def floor(x: Column) -> Column:
    return F.floor(x).cast("long")


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def pow(base: Column, exponent: Column | float) -> Column:  # noqa: A001
    if exponent == 2:
        return base * base
    if exponent == 0.5:
        return sqrt(base)
    return F.pow(base, exponent)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def round(x: Column, precision: int | None = None) -> Column:  # noqa: A001
    """Half away from zero, with ties within 1e-10 of the last place; a whole number without a precision."""
    scale = 10.0 ** (precision or 0)
    moved = F.signum(x) * F.floor(F.abs(x) * scale + 0.5 + 1e-10)
    return moved.cast("long") if precision is None else moved / scale


def round_to_mintick(x: Column, mintick: Column | float) -> Column:
    tick = mintick if isinstance(mintick, Column) else F.lit(float(mintick))
    return F.floor(x / tick + 0.5) * tick
