"""Timeframes such as 5, 240, 30S, 1D, 2W, 3M and 100T."""

from __future__ import annotations

from typing import NamedTuple


class Timeframe(NamedTuple):
    count: int
    unit: str  # '' for minutes, or one of T S D W M

    @property
    def text(self) -> str:
        return f"{self.count}{self.unit}"

    @property
    def seconds(self) -> int:
        sizes = {"": 60, "S": 1, "D": 86_400, "W": 604_800, "M": 86_400 * 365 / 12 + 3}
        if self.unit not in sizes:
            raise ValueError("tick timeframes have no length")
        return int(self.count * sizes[self.unit])

    isticks = property(lambda s: s.unit == "T")
    isseconds = property(lambda s: s.unit == "S")
    isminutes = property(lambda s: s.unit == "")
    isdaily = property(lambda s: s.unit == "D")
    isweekly = property(lambda s: s.unit == "W")
    ismonthly = property(lambda s: s.unit == "M")
    isdwm = property(lambda s: s.unit in ("D", "W", "M"))
    isintraday = property(lambda s: s.unit not in ("D", "W", "M"))
    multiplier = property(lambda s: s.count)
    period = property(lambda s: s.text)


def parse(text: str) -> Timeframe:
    if not text:
        raise ValueError("a timeframe needs a number or a unit")
    if text.isdigit():
        count, unit = int(text), ""
    else:
        count, unit = int(text[:-1] or 1), text[-1]
    if unit not in ("", "T", "S", "D", "W", "M") or count <= 0:
        raise ValueError(f"not a timeframe: {text!r}")
    return Timeframe(count, unit)


def in_seconds(text: str) -> int:
    return parse(text).seconds


def from_seconds(seconds: int) -> str:
    for size, unit in ((86_400 * 28, "M"), (604_800, "W"), (86_400, "D"), (60, "")):
        if seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds}S"


def validate_aggregation(source: str, target: str) -> None:
    """The target must be longer than the source, and for clock timeframes a multiple of it."""
    a, b = parse(source), parse(target)
    if b.seconds <= a.seconds:
        raise ValueError(f"{target} is not longer than {source}")
    if b.isintraday and b.seconds % a.seconds:
        raise ValueError(f"{target} is not a multiple of {source}")
