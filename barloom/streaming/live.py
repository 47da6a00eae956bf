"""Indicators over a stream of bar updates, by the kernels that the batch runs use.

An update has symbol, time, prices and ``is_closed``.  A closed bar moves the state on; a tick of the bar that is still forming
gives a provisional row from a copy of the state; updates at or before the last closed bar are dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions.time import bucket


def deduplicated(updates: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Late updates are dropped by the watermark, repeated ones by their key within it."""
    return updates.withWatermark("time", delay).dropDuplicatesWithinWatermark(["symbol", "time", "is_closed"])


def tumbling_bars(ticks: DataFrame, duration: str, symbol: str, time: str, price: str, volume: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Bars of clock windows of a stream of ticks, final when the watermark has passed their end."""
    at = F.struct(F.col(time), F.col(price))
    size = F.sum(F.col(volume).cast("double")) if volume else F.count(F.lit(1)).cast("double")
    out = ticks.withWatermark(time, delay).groupBy(F.window(time, duration), F.col(symbol).alias("symbol")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), size.alias("volume"))
    return out.select("symbol", F.col("window.start").alias("time"), "open", "high", "low", "close", "volume")


def bucket_bars(ticks: DataFrame, timeframe: str, symbol: str, time: str, price: str, delay: str = "1 day", **calendar: Any) -> DataFrame:
    """Bars of calendar buckets (days, weeks, sessions) of a stream, in update mode."""
    at = F.struct(F.col(time), F.col(price))
    return ticks.withWatermark(time, delay).groupBy(F.col(symbol).alias("symbol"), bucket(F.col(time), timeframe, **calendar).alias("bucket")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")).withColumnRenamed("bucket", "time")


def indicator(updates: DataFrame, kernel: Callable[[], Any], inputs: list[str], outputs: list[str], idle_after_ms: int | None = None) -> DataFrame:
    """symbol, time, is_confirmed and the kernel's outputs for every accepted update.

    The state of a symbol is the pickled kernel after its last closed bar and that bar's time and close.  With ``idle_after_ms`` a symbol without
    updates gives one row that repeats the last close, as a bar without trades would.
    """
    schema = "symbol string, time timestamp, is_confirmed boolean, " + ", ".join(f"{o} double" for o in outputs)

    def values(got: Any) -> list[float | None]:
        parts = got if isinstance(got, tuple) else (got,)
        return [None if v != v else float(v) for v in parts]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else (None, kernel(), None)
        last, current, row = held
        out = []
        if state.hasTimedOut:
            if row is not None:
                out.append((key[0], last, False, *values(current.peek(*row))))
            state.remove() if row is None else state.update((cloudpickle.dumps(held),))
        else:
            updates = pd.concat(list(frames)).sort_values(["time", "is_closed"], kind="stable")
            for u in updates.itertuples(index=False):
                at = u.time
                if last is not None and at <= last:
                    continue
                x = [float("nan") if (v := getattr(u, c)) is None else float(v) for c in inputs]
                if u.is_closed:
                    out.append((key[0], at, True, *values(current.one(*x))))
                    last, row = at, x
                else:
                    out.append((key[0], at, False, *values(current.peek(*x))))
            state.update((cloudpickle.dumps((last, current, row)),))
            if idle_after_ms:
                state.setTimeoutDuration(idle_after_ms)
        yield pd.DataFrame(out, columns=["symbol", "time", "is_confirmed", *outputs])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_after_ms else GroupStateTimeout.NoTimeout
    return updates.groupBy("symbol").applyInPandasWithState(step, schema, "state binary", "append", timeout)


def replay(spark: Any, directory: str, schema: Any, files_per_trigger: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """The Parquet files of a directory as a stream of updates, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(directory)


class Ring:
    """A function of the last n values."""

    def __init__(self, n: int, function: Callable[[list[float]], float]) -> None:
        self.n, self.function, self.values = n, function, []

    def peek(self, x: float) -> float:
        held = [*self.values, x][-self.n :]
        return self.function(held) if len(held) == self.n else float("nan")

    def one(self, x: float) -> float:
        out = self.peek(x)
        self.values = [*self.values, x][-self.n :]
        return out


def rolling(updates: DataFrame, n: int, column: str, function: Callable[[list[float]], float], output: str) -> DataFrame:
    """A function of the last n closed values, as a ring buffer in the state (streams have no row windows)."""
    return indicator(updates, lambda: Ring(n, function), [column], [output])
