"""Colours as text ``#RRGGBBAA``; transparency runs from 0 (solid) to 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _channel(c: Column, at: int) -> Column:
    return F.conv(F.substring(c, at, 2), 16, 10).cast("int")


def r(c: Column) -> Column: return _channel(c, 2)  # noqa: E704
def g(c: Column) -> Column: return _channel(c, 4)  # noqa: E704
def b(c: Column) -> Column: return _channel(c, 6)  # noqa: E704


def t(c: Column) -> Column:
    alpha = F.when(F.length(c) >= 9, _channel(c, 8)).otherwise(255)
    return F.round((255 - alpha) * 100 / 255.0, 0)


def _hex(x: Column) -> Column:
    return F.lpad(F.hex(F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(255.0)).cast("int")), 2, "0")


def rgb(red: Column, green: Column, blue: Column, transp: Column | float = 0) -> Column:
    transp = transp if isinstance(transp, Column) else F.lit(float(transp))
    return F.concat(F.lit("#"), _hex(red), _hex(green), _hex(blue), _hex(F.floor(255 - transp * 255 / 100 + 0.5)))


def new(c: Column, transp: Column | float = 0) -> Column:
    return rgb(r(c), g(c), b(c), transp)


def from_gradient(value: Column, bottom_value: Column, top_value: Column, bottom_color: Column, top_color: Column) -> Column:
    """Linear interpolation; an na end fades out towards it and keeps the other end's hue."""
    span = top_value - bottom_value
    p = F.least(F.greatest(F.try_divide(value - bottom_value, span), F.lit(0.0)), F.lit(1.0))
    between = lambda f: F.floor(f(bottom_color) + (f(top_color) - f(bottom_color)) * p)
    both = rgb(between(r), between(g), between(b), t(bottom_color) + (t(top_color) - t(bottom_color)) * p)
    known = value.isNotNull() & bottom_value.isNotNull() & top_value.isNotNull()
    return F.when(
        known,
        F.when(span == 0, bottom_color)
        .when(bottom_color.isNull(), F.when(p > 0, new(top_color, (t(top_color) - 100) * p + 100)))
        .when(top_color.isNull(), F.when(p < 1, new(bottom_color, t(bottom_color) + (F.lit(100) - t(bottom_color)) * p)))
        .otherwise(both),
    )
