"""Entry points: indicators and strategies over bars."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.inputs import resolved
from barloom.operators import backtest as _backtest
from barloom.operators.plots import Plots
from barloom.operators.simulator import Settings
from barloom.plans.series import Chart


def indicator(bars: DataFrame, script: Callable[..., dict[str, Any] | None], inputs: dict[str, Any] | None = None, calc_bars_count: int | None = None, toml: str | None = None) -> DataFrame:
    """Output of ``script(chart, plots, **inputs)``: one row per bar with one column per plot or returned entry.

    A script may declare ``script.inputs`` (name -> ``Input``); then all of them are passed, source inputs as series.
    """
    chart = Chart(bars)
    if calc_bars_count:
        chart = chart.last_bars(calc_bars_count)
    plots = Plots()
    returned = script(chart, plots, **arguments(script, chart, inputs or {}, toml)) or {}
    columns = {n: chart.value(s) for n, s in (plots.columns | returned).items()}
    return chart.select(**columns)


def arguments(script: Callable, chart: Chart, given: dict[str, Any], toml: str | None = None) -> dict[str, Any]:
    declared = getattr(script, "inputs", None)
    if declared is None:
        return checked(script, given)
    values = resolved(declared, given, toml)
    return {n: getattr(chart, v) if declared[n].kind == "source" else v for n, v in values.items()}


def write_files(outputs: DataFrame, events: DataFrame, folder: str, initial_capital: float = Settings.initial_capital, bars: DataFrame | None = None) -> None:
    """The files of a run as CSV folders with headers: plots, trades and statistics (one row per symbol and name)."""
    csv = lambda df, name: df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    csv(outputs.sortWithinPartitions("symbol", "time"), "plots")
    csv(_backtest.closed_trades(events), "trades")
    found = _backtest.statistics(events, initial_capital, bars)
    named = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in found.columns if c != "symbol"))
    csv(found.select("symbol", F.explode(named).alias("s")).select("symbol", "s.name", "s.value"), "statistics")


def checked(script: Callable, inputs: dict[str, Any]) -> dict[str, Any]:
    """Inputs within the limits that the script declares in ``script.limits``: name -> (least, most) or allowed values."""
    for name, limit in getattr(script, "limits", {}).items():
        if name not in inputs:
            continue
        v = inputs[name]
        fine = limit[0] <= v <= limit[1] if isinstance(limit, tuple) else v in limit
        if not fine:
            raise ValueError(f"input {name} is outside {limit}: {v!r}")
    return inputs


def strategy(bars: DataFrame, script: Callable[[Chart], dict[str, Any]], on_bar: Callable, settings: Settings | None = None, **more: Any) -> DataFrame:
    """Signals of ``script(chart)`` as columns, then one backtest pass with ``on_bar(broker, bar)``."""
    chart = Chart(bars)
    signals = chart.select(keep=("open", "high", "low", "close", "volume"), **{n: chart.value(s) for n, s in script(chart).items()})
    return _backtest.backtest(signals, on_bar, settings, **more)
