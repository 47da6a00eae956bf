"""Missing values: na is SQL NULL; NaN and infinities count as na."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-10


def is_na(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def finite(x: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(~is_na(x), x)


def nz(x: Column, replacement: Column | float = 0) -> Column:
    return F.coalesce(finite(x), replacement if isinstance(replacement, Column) else F.lit(replacement))


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating columns; done once at the scan."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({n: F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")) for n in floats}) if floats else df


def false_if_na(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def teq(a: Column, b: Column) -> Column:
    return false_if_na(F.abs(a - b) <= EPSILON)


def tne(a: Column, b: Column) -> Column:
    return false_if_na(F.abs(a - b) > EPSILON)


def tlt(a: Column, b: Column) -> Column:
    return false_if_na(b - a > EPSILON)


def tle(a: Column, b: Column) -> Column:
    return false_if_na(a - b <= EPSILON)


def tgt(a: Column, b: Column) -> Column:
    return tlt(b, a)


def tge(a: Column, b: Column) -> Column:
    return tle(b, a)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def truth(x: Column) -> Column:
    """na and zero are false."""
    return false_if_na(F.abs(x.cast("double")) > EPSILON)


def cast_int(x: Column) -> Column:
    """Truncated towards zero; what is no number is null."""
    d = x.try_cast("double")
    return F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("long")


def cast_float(x: Column) -> Column:
    return x.try_cast("double")


def for_range(start: Column, stop: Column, step: Column | None = None) -> Column:
    """The numbers of a loop: both ends included, the direction is that from start to stop."""
    size = F.abs(step) if step is not None else F.lit(1)
    return F.sequence(start, stop, F.when(stop >= start, size).otherwise(-size))
