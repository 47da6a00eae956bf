"""Typed inputs of scripts: a kind, a default and limits; values come from the caller, from TOML, or are the default."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from typing import Any

from barloom.functions.timeframe import parse

#: The series that a source input may name.
SOURCES = ("open", "high", "low", "close", "volume", "hl2", "hlc3", "ohlc4", "hlcc4")


def _number(kind: type) -> Callable[[Any], Any]:
    def read(v: Any) -> Any:
        if isinstance(v, bool) or not isinstance(v, int | float) or (kind is int and v != int(v)):
            raise ValueError(f"not a number of the kind {kind.__name__}: {v!r}")
        return kind(v)

    return read


def _text(v: Any) -> str:
    if not isinstance(v, str):
        raise ValueError(f"not a text: {v!r}")
    return v


def _truth(v: Any) -> bool:
    if not isinstance(v, bool):
        raise ValueError(f"not true or false: {v!r}")
    return v


def _matching(pattern: str, what: str) -> Callable[[Any], str]:
    def read(v: Any) -> str:
        if not re.fullmatch(pattern, _text(v)):
            raise ValueError(f"not {what}: {v!r}")
        return v

    return read


def _parsed(parser: Callable[[str], Any]) -> Callable[[Any], str]:
    def read(v: Any) -> str:
        parser(_text(v))
        return v

    return read


READERS: dict[str, Callable[[Any], Any]] = {
    "int": _number(int),
    "float": _number(float),
    "price": _number(float),
    "time": _number(int),
    "bool": _truth,
    "string": _text,
    "text_area": _text,
    "symbol": _matching(r"[^\s:]*:?[^\s:]+", "a symbol"),
    "color": _matching("#[0-9A-Fa-f]{6}([0-9A-Fa-f]{2})?", "a colour"),
    "source": _matching("|".join(SOURCES), "a source"),
    "session": _matching(r"(24x7)?|\d{4}-\d{4}(:[1-7]+)?(,\d{4}-\d{4}(:[1-7]+)?)*", "a session"),
    "timeframe": _parsed(lambda v: parse(v) if v else None),
    "enum": lambda v: v,
}


@dataclass(frozen=True)
class Input:
    kind: str
    default: Any
    least: float | None = None
    most: float | None = None
    options: tuple = ()
    title: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in READERS:
            raise ValueError(f"no kind of input: {self.kind}")
        self.read(self.default)

    def read(self, value: Any) -> Any:
        """The value in its kind, within the limits; an error else."""
        if self.kind == "enum":
            members = type(self.default)
            if not issubclass(members, Enum):
                raise ValueError("the default of an enum input is a member")
            value = value if isinstance(value, members) else members[value] if value in members.__members__ else members(value)
        v = READERS[self.kind](value)
        if self.options and v not in self.options:
            raise ValueError(f"{v!r} is none of {', '.join(map(repr, self.options))}")
        if (self.least is not None and v < self.least) or (self.most is not None and v > self.most):
            raise ValueError(f"{v!r} is not between {self.least} and {self.most}")
        return v


def resolved(declared: dict[str, Input], given: dict[str, Any] | None = None, toml: str | None = None) -> dict[str, Any]:
    """Values of all declared inputs: those given, else those of TOML text (``[inputs.name]`` with ``value``), else the defaults."""
    stored = {n: t["value"] for n, t in (tomllib.loads(toml).get("inputs", {}) if toml else {}).items() if "value" in t}
    given = given or {}
    if unknown := (set(given) | set(stored)) - set(declared):
        raise ValueError(f"no input named {', '.join(sorted(unknown))}")
    return {n: i.read(given.get(n, stored.get(n, i.default))) for n, i in declared.items()}
