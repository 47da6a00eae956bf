"""Bars from ticks and from finer bars."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.time import Interval, bucket, period_day, trading_day
from barloom.functions.timeframe import parse, validate_aggregation

OHLCV = ("open", "high", "low", "close", "volume")


def instant(time: Column, order: Column) -> Column:
    """One decimal that orders by time, then by a whole number: a struct would not fit the fixed-width buffers of a hash aggregate."""
    wide = lambda c: c.cast("long").cast("decimal(38,0)")
    return wide(F.unix_micros(time)) * F.lit(Decimal(2 * 10**19)) + wide(order) + F.lit(Decimal(2**63))


def ticks_to_bars(ticks: DataFrame, timeframe: str, symbol: str, time: str, price: str, volume: str | None = None, order: Column | None = None, **calendar) -> DataFrame:
    """Bars of prices; ``order`` (a whole number) breaks ties of time for open and close, the price does without it.

    One shuffle, with partial aggregation before it; with ``order`` both are hash aggregates, so the ticks are never sorted.
    """
    at = instant(F.col(time), order) if order is not None else F.struct(time, price)
    size = F.sum(F.col(volume).cast("double")) if volume else F.count(F.lit(1)).cast("double")
    return (
        ticks.where(F.col(price).isNotNull() & ~F.isnan(F.col(price).cast("double")))
        .groupBy(F.col(symbol).alias("symbol"), bucket(F.col(time), timeframe, **calendar).alias("time"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), size.alias("volume"))
    )


def merged() -> list[Column]:
    """Aggregates that merge bars into one."""
    return [F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume")]


def resample(bars: DataFrame, timeframe: str, source_timeframe: str | None = None, keep_list: bool = False, **calendar) -> DataFrame:
    """Coarser bars on a timeframe; with ``keep_list`` the finer bars stay as an array in time order (``sub_bars``)."""
    if source_timeframe:
        validate_aggregation(source_timeframe, timeframe)
    at = bucket(F.col("time"), timeframe, **calendar)
    more = [F.sort_array(F.collect_list(F.struct("time", *OHLCV))).alias("sub_bars")] if keep_list else []
    return bars.groupBy("symbol", at.alias("bucket")).agg(*merged(), *more).withColumnRenamed("bucket", "time")


def observed(bars: DataFrame, timeframe: str, intervals: list[Interval] | None = None, timezone: str = "UTC") -> DataFrame:
    """nD, nW or nM bars counted over the days that really traded, each year anew, stamped by their first bar."""
    tf = parse(timeframe)
    if not tf.isdwm:
        raise ValueError("observed calendars are for D, W and M")
    unit = period_day(trading_day(F.col("time"), intervals, timezone), f"1{tf.unit}")
    days = bars.withColumn("unit", unit)
    w = Window.partitionBy("symbol", F.year("unit")).orderBy("unit")
    grouped = days.withColumn("slot", F.floor((F.dense_rank().over(w) - 1) / tf.count)).withColumn("in_year", F.year("unit"))
    return grouped.groupBy("symbol", "in_year", "slot").agg(F.min("time").alias("at"), *merged()).select("symbol", F.col("at").alias("time"), *OHLCV)


def developing(bars: DataFrame, timeframe: str, **calendar) -> DataFrame:
    """For every bar, the coarser bar as it stands at that moment (never its final values): dev_open ... dev_volume."""
    at = bucket(F.col("time"), timeframe, **calendar)
    d = bars.withColumn("bucket", at)
    w = Window.partitionBy("symbol", "bucket").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns({"dev_open": F.first("open").over(w), "dev_high": F.max("high").over(w), "dev_low": F.min("low").over(w), "dev_close": F.col("close"), "dev_volume": F.sum("volume").over(w)})


def timeframe_change(ts: Column, previous: Column, timeframe: str, **calendar) -> Column:
    """Whether a bar is the first of a new period (false on the first bar)."""
    return F.coalesce(bucket(ts, timeframe, **calendar) != bucket(previous, timeframe, **calendar), F.lit(False))


def infer_period(bars: DataFrame, symbol: str = "symbol", time: str = "time") -> DataFrame:
    """The smallest positive spacing of each symbol in seconds (calendar months as 28 to 31 days), with its timeframe text."""
    w = Window.partitionBy(symbol).orderBy(time)
    gap = F.unix_seconds(time) - F.unix_seconds(F.lag(time).over(w))
    found = bars.select(symbol, gap.alias("gap")).where("gap > 0").groupBy(symbol).agg(F.min("gap").alias("seconds"))
    s, day = F.col("seconds"), 86_400
    text = F.when(s.between(28 * day, 31 * day), F.lit("1M"))
    for size, unit in ((7 * day, "W"), (day, "D")):
        text = text.when(s % size == 0, F.concat((s / size).cast("long").cast("string"), F.lit(unit)))
    return found.withColumn("period", text.when(s % 60 == 0, (s / 60).cast("long").cast("string")).otherwise(F.concat(s.cast("string"), F.lit("S"))))


def valid(bars: DataFrame) -> DataFrame:
    """Bars that a writer accepts: a time, numbers, and a range that holds open and close; one bar per symbol and time."""
    ok = F.col("time").isNotNull() & F.col("close").isNotNull() & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    w = Window.partitionBy("symbol", "time").orderBy(*(F.col(c) for c in OHLCV))
    return bars.where(ok).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
