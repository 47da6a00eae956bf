"""Plans that must not come back, kernels by blocks, and inputs."""

from __future__ import annotations

import datetime as dt
import random
from enum import Enum

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import time as ftime
from barloom.inputs import Input, resolved
from barloom.operators import backtest, kernels, request, resample
from barloom.operators.simulator import LONG, Settings

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hourly(spark):
    rows = [(s, START + dt.timedelta(hours=i), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, 1.0) for s in "AB" for i in range(60)]
    return spark.createDataFrame(rows, "symbol string, time timestamp, open double, high double, low double, close double, volume double")


def test_ticks_are_not_sorted(spark):
    ticks = spark.range(100).select(F.lit("A").alias("s"), F.timestamp_seconds(F.floor(F.col("id") / 7)).alias("t"), (F.col("id") * 0.5).alias("p"), "id")
    bars = resample.ticks_to_bars(ticks, "1", "s", "t", "p", order=F.col("id"))
    assert "SortAggregate" not in plan(bars) and "HashAggregate" in plan(bars)
    assert bars.where("close = 49.5").count() == 1 and bars.where("open = 0.0").count() == 1


def test_ties_go_by_order(spark):
    ticks = spark.createDataFrame([("A", START, float(p), n) for p, n in ((5, 2), (3, -1), (9, 1))], "s string, t timestamp, p double, n long")
    assert [(r.open, r.close) for r in resample.ticks_to_bars(ticks, "1", "s", "t", "p", order=F.col("n")).collect()] == [(3.0, 5.0)]


def test_other_symbols_make_no_pairs(spark, hourly):
    other = hourly.where("symbol = 'A'").select(F.lit("X").alias("symbol"), (F.col("time") - F.expr("INTERVAL 3 HOURS")).alias("time"), F.col("close").alias("x"))
    for gaps in (False, True):
        out = request.security(hourly.select("symbol", "time"), other, "60", "60", ["x"], other_symbol=True, gaps=gaps)
        assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    found = out.groupBy("symbol").agg(F.count("x").alias("n")).collect()
    assert sorted((r.symbol, r.n) for r in found) == [("A", 57), ("B", 57)]


def test_rates_hold_far_into_the_future(spark):
    df = spark.createDataFrame([(1, dt.datetime(2300, 5, 1, tzinfo=dt.UTC)), (2, START)], "id int, time timestamp")
    rates = spark.createDataFrame([("EUR", "USD", START, 1.25)], "base string, quote string, time timestamp, rate double")
    assert {r.id: r.rate for r in request.currency_rate(df, rates, "EUR", "USD").collect()} == {1: 1.25, 2: 1.25}


def test_a_strategy_is_simulated_once(hourly):
    events = backtest.backtest(hourly, lambda broker, bar: broker.entry("L", LONG), Settings())
    text = plan(backtest.statistics(events))
    assert "InMemoryTableScan" in text
    assert backtest.statistics(events).count() == 2


@pytest.mark.parametrize("make", [kernels.Ema, kernels.Rma])
def test_blocks_give_what_single_values_give(make):
    rng = random.Random(3)
    for n in (1, 2, 9, 200):
        x = np.array([float("nan") if rng.random() < 0.1 else rng.uniform(1, 100) for _ in range(1500)])
        one, whole, pieces = make(n), make(n).push(x), make(n)
        assert np.allclose(whole, [one.one(v) for v in x.tolist()], rtol=1e-12, equal_nan=True)
        cut = [pieces.push(p) for p in np.split(x, [1, 7, 500, 501, 1400])]
        assert np.allclose(whole, np.concatenate(cut), rtol=1e-12, equal_nan=True)


def test_ends_are_the_starts_of_the_next(spark):
    days = spark.range(0, 1500).select(F.timestamp_seconds(F.col("id") * 86_400 + 900_000_000 - 900_000_000 % 86_400).alias("t"))
    for frame in ("1D", "3D", "7D", "1W", "2W", "3W", "1M", "5M"):
        start = ftime.bucket(F.col("t"), frame)
        end = ftime.bucket_end(start, frame)
        wrong = days.where((ftime.bucket(end, frame) != end) | (ftime.bucket(end - F.expr("INTERVAL 1 SECOND"), frame) != start))
        assert wrong.isEmpty(), frame


def test_session_ends(spark):
    hours = ftime.session_intervals("0930-1600:23456")
    at = lambda h, m=0: dt.datetime(2024, 1, 2, h, m, tzinfo=dt.UTC)
    df = spark.createDataFrame([(at(15, 30),), (at(10),), (at(20),)], "t timestamp")
    ends = [r[0] for r in df.select(F.unix_seconds(ftime.bucket_end(F.col("t"), "60", intervals=hours))).collect()]
    assert ends == [int(x.timestamp()) for x in (at(16), at(11), at(21))]


class Side(Enum):
    UP = "up"
    DOWN = "down"


def test_inputs():
    declared = {"n": Input("int", 5, 1, 9), "side": Input("enum", Side.UP), "frame": Input("timeframe", "")}
    assert resolved(declared) == {"n": 5, "side": Side.UP, "frame": ""}
    assert resolved(declared, {"side": "down"}, "[inputs.n]\nvalue = 7") == {"n": 7, "side": Side.DOWN, "frame": ""}
    for kind, wrong in (("int", 1.5), ("int", True), ("float", "x"), ("bool", 1), ("symbol", "a b"), ("source", "nothing"), ("session", "x"), ("timeframe", "5X"), ("string", 3), ("color", "#12")):
        with pytest.raises(ValueError):
            Input(kind, wrong)
    with pytest.raises(ValueError, match="no kind"):
        Input("thing", 1)
