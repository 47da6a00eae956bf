"""Ticker identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEIKIN_ASHI = "HA="
#: Fixed value: the prefix of corporate-action feeds.
CORPORATE_ACTIONS = "ESD_FACTSET"


def new(prefix: Column, ticker: Column) -> Column:
    return F.when(F.length(prefix) > 0, F.concat(prefix, F.lit(":"), ticker)).otherwise(ticker)


def modify(ticker_id: Column) -> Column:
    return ticker_id


def standard(ticker_id: Column) -> Column:
    return ticker_id


def inherit(from_id: Column, symbol: Column) -> Column:
    """The exchange prefix of another id, unless the symbol has its own."""
    prefix = F.substring_index(from_id, ":", 1)
    return F.when(symbol.contains(":") | ~from_id.contains(":"), symbol).otherwise(F.concat(prefix, F.lit(":"), symbol))


def heikinashi(ticker_id: Column) -> Column:
    """Marks an id: requests of it get Heikin-Ashi bars."""
    return F.concat(F.lit(HEIKIN_ASHI), ticker_id)


def _feed(kind: str, ticker_id: Column) -> Column:
    return F.concat(F.lit(f"{CORPORATE_ACTIONS}:"), F.regexp_replace(ticker_id, ":", ";"), F.lit(f";{kind}"))


def dividends(ticker_id: Column) -> Column: return _feed("DIVIDENDS", ticker_id)  # noqa: E704
def earnings(ticker_id: Column) -> Column: return _feed("EARNINGS", ticker_id)  # noqa: E704
def splits(ticker_id: Column) -> Column: return _feed("SPLITS", ticker_id)  # noqa: E704


def unsupported(*_: object) -> Column:
    raise NotImplementedError("renko, point and figure, kagi and line break charts are not supported")


renko = pointfigure = kagi = linebreak = unsupported
