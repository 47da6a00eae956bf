"""Scalar text functions; null in, null out."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

contains, endswith, startswith, lower, upper, length = F.contains, F.endswith, F.startswith, F.lower, F.upper, F.length


def match(source: Column, pattern: str) -> Column:
    """The match at the start of the text, '' if there is none."""
    return F.regexp_extract(source, f"^(?:{pattern})", 0)


def pos(source: Column, part: Column) -> Column:
    """0-based place of the first occurrence, null if there is none."""
    return F.nullif(F.position(part, source), F.lit(0)) - 1


def repeat(source: Column, times: Column, separator: str = "") -> Column:
    return F.when(times > 0, F.array_join(F.array_repeat(source, times.cast("int")), separator))


def replace_all(source: Column, target: str, replacement: str) -> Column:
    return F.replace(source, F.lit(target), F.lit(replacement))


def replace(source: Column, target: str, replacement: str, occurrence: int = 0) -> Column:
    """Replace the n-th occurrence (occurrences may overlap); an empty target inserts at that place."""
    if target == "":
        return F.when(F.length(source) >= occurrence, F.concat(F.substring(source, 1, occurrence), F.lit(replacement), F.substring(source, occurrence + 1, 1 << 30))).otherwise(source)
    at = F.locate(target, source, 1)
    for _ in range(occurrence):
        at = F.when(at > 0, _next(source, target, at)).otherwise(0)
    return F.when(at > 0, F.concat(F.substr(source, F.lit(1), at - 1), F.lit(replacement), F.substr(source, at + len(target)))).otherwise(source)


def _next(source: Column, target: str, at: Column) -> Column:
    rest = F.position(F.lit(target), source, at + 1)
    return rest


def split(source: Column, separator: str) -> Column:
    if separator == "":
        return F.filter(F.split(source, ""), lambda c: c != "")
    return F.split(source, re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", separator), -1)


def substring(source: Column, begin: Column, end: Column | None = None) -> Column:
    """Characters from ``begin`` up to but not including ``end``, 0-based."""
    return F.substr(source, begin + 1, end - begin) if end is not None else F.substr(source, begin + 1)


def tonumber(source: Column) -> Column:
    return F.trim(source).try_cast("double")


def trim(source: Column) -> Column:
    return F.regexp_replace(source, "^\\s+|\\s+$", "")


def format_time(ms: Column, mask: str = "yyyy-MM-dd'T'HH:mm:ssZ", timezone: str = "UTC") -> Column:
    """Text of an epoch-ms time in a time zone (the session's zone must be UTC)."""
    shifted = F.from_utc_timestamp(F.timestamp_millis(ms), timezone)
    if mask.endswith("Z"):
        minutes = ((F.unix_seconds(shifted) - F.floor(ms / 1000)) / 60).cast("int")
        offset = F.format_string("%s%02d%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int"))
        return F.concat(F.date_format(shifted, mask[:-1]), offset)
    return F.date_format(shifted, mask)


#: Digits for any double.
WIDE = Context(prec=800)


def mask_number(x: float | None, mask: str = "#.##########", half_even: bool = False) -> str:
    """A number under a decimal mask such as ``#.##``, ``0.00``, ``#,##0`` or ``#.#%``."""
    if x is None or x != x:
        return "NaN"
    percent = mask.endswith("%")
    body = mask.rstrip("%")
    whole, _, part = body.partition(".")
    d = (Decimal(x) if half_even else Decimal(repr(float(x)))) * (100 if percent else 1)
    most, least = len(part), part.count("0")
    d = d.quantize(Decimal(1).scaleb(-most), ROUND_HALF_EVEN if half_even else ROUND_HALF_UP, WIDE)
    sign, text = ("-" if d < 0 else ""), f"{abs(d):f}"
    left, _, right = text.partition(".")
    right = right.rstrip("0").ljust(least, "0")
    left = left.lstrip("0").rjust(whole.replace(",", "").count("0"), "0") or ("0" if not right or whole.endswith("#") else "")
    if "," in whole:
        left = f"{int(left or 0):,}"
    out = left + ("." + right if right else "")
    return (sign if any(c in "123456789" for c in out) else "") + out + ("%" if percent else "")


def tostring(x: Column, mask: str = "#.##########", mintick: float | None = None) -> Column:
    """Text of a number under a mask, or as ``mintick``, ``percent`` or ``volume``."""
    if mask == "mintick":
        tick = mintick or 0.01
        decimals = max(0, -Decimal(repr(tick)).as_tuple().exponent)
        x, mask = F.floor(x / tick + 0.5) * tick, "#." + "0" * decimals if decimals else "#"
    elif mask == "percent":
        mask = "0.##%"
        x = x / 100
    elif mask == "volume":
        return _volume(x)

    return masked(x.cast("double"), mask)


#: Beyond this a number has no digits after the point that a mask could show.
LARGE = 1e20


def masked(x: Column, mask: str) -> Column:
    """``mask_number`` (halves up) as an expression: the digits come from a rounded decimal, or for large numbers from the number itself."""
    percent = mask.endswith("%")
    whole, _, part = mask.rstrip("%").partition(".")
    most, least, digits = len(part), part.count("0"), whole.replace(",", "").count("0")
    exact = F.when(F.abs(x) < LARGE, F.abs(x)).cast("decimal(38,17)") * (100 if percent else 1)
    fixed = F.format_number(F.round(exact, most).cast(f"decimal(38,{most})"), most)
    shown = F.coalesce(fixed, F.concat(F.format_string("%,.0f", F.abs(x) * (100 if percent else 1)), F.lit("." + "0" * most if most else "")))
    grouped, right = F.substring_index(shown, ".", 1), F.substring_index(shown, ".", -1) if most else F.lit("")
    if most > least:
        right = F.regexp_replace(right, f"^(\\d{{{least}}}\\d*?)0+$", "$1")
    if "," in whole:
        left = grouped
    else:
        plain = F.when(grouped == "0", "").otherwise(F.replace(grouped, F.lit(","), F.lit("")))
        left = F.when(F.length(plain) < digits, F.lpad(plain, digits, "0")).otherwise(plain)
        left = F.when((left == "") & ((right == "") | F.lit(whole.endswith("#"))), "0").otherwise(left)
    text = F.concat(left, F.when(right == "", "").otherwise(F.concat(F.lit("."), right)))
    sign = F.when((x < 0) & text.rlike("[1-9]"), "-").otherwise("")
    return F.when(x.isNull() | F.isnan(x), "NaN").otherwise(F.concat(sign, text, F.lit("%" if percent else "")))


def _volume(x: Column) -> Column:
    a = F.abs(x)
    steps = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]
    out = F.when(F.lit(False), "")
    for size, mark in steps:
        out = out.when(a >= size, F.concat(F.regexp_replace(F.format_string("%.3f", x / size), "\\.?0+$", ""), F.lit(mark)))
    return out.otherwise(F.regexp_replace(F.format_string("%.3f", x), "\\.?0+$", ""))


def format(pattern: str, *args: Column) -> Column:  # noqa: A001
    """Message format: ``{0}``, ``{0,number,#.##}``; single quotes escape braces, unknown numbers stay as they are."""

    @F.pandas_udf("string")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([message(pattern, row) for row in zip(*columns, strict=True)])

    return run(*args) if args else F.lit(message(pattern, ()))


def message(pattern: str, values: tuple) -> str:
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "'":
            end = pattern.find("'", at + 1)
            if end < 0:
                out.append(pattern[at + 1 :])
                break
            out.append(pattern[at + 1 : end] if end > at + 1 else "'")
            at = end + 1
        elif c == "{" and (end := pattern.find("}", at)) > 0:
            place = [p.strip() for p in pattern[at + 1 : end].split(",", 2)]
            known = place[0].isdigit() and int(place[0]) < len(values)
            out.append(shown(values[int(place[0])], place[2] if len(place) > 2 else None) if known else pattern[at : end + 1])
            at = end + 1
        else:
            out.append(c)
            at += 1
    return "".join(out)


def shown(v: object, mask: str | None) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int | float):
        return mask_number(float(v), {"integer": "#,##0", "percent": "0%", "currency": "#,##0.00"}.get(mask, mask) or "#,##0.###", half_even=True)
    if v is None:
        return "NaN"
    if hasattr(v, "__iter__") and not isinstance(v, str):
        return "[" + ", ".join(shown(x, mask) for x in v) + "]"
    return str(v)
