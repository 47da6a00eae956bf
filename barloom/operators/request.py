"""Values of other symbols and timeframes, without looking ahead.

A backward as-of merge is a union of both sides, sorted by instant within a symbol, with the last value carried forward: one shuffle
and one sort, whatever the sizes, where a range join would be quadratic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ticker import HEIKIN_ASHI
from barloom.functions.time import Interval, bucket, bucket_end
from barloom.functions.timeframe import parse
from barloom.operators import ta
from barloom.operators.resample import developing, resample
from barloom.plans.series import Chart

PRICES = ("open", "high", "low", "close")


def asof(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], gaps: bool = False) -> DataFrame:
    """``left`` with the values of the latest ``right`` row at or before it; with ``gaps`` only where that row is new."""
    packed = F.struct(*(F.col(v) for v in values), F.col(right_at).alias("__at"))
    own = F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("row")
    keys = [F.col(b).alias(f"__k{i}") for i, b in enumerate(by)]
    a = left.select(*keys, F.col(left_at).alias("__t"), F.lit(1).alias("__side"), own, F.lit(None).cast(right.select(packed).schema[0].dataType).alias("v"))
    b = right.select(*keys, F.col(right_at).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["row"].dataType).alias("row"), packed.alias("v"))
    w = Window.partitionBy(*(f"__k{i}" for i in range(len(by)))).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("__side = 1")
    if gaps:
        before = F.lag("v").over(Window.partitionBy(*(f"__k{i}" for i in range(len(by)))).orderBy("__t"))
        fresh = F.col("v.__at").isNotNull() & ~F.col("v.__at").eqNullSafe(F.col("before.__at"))
        out = out.withColumn("before", before)
        return out.select("row.*", *(F.when(fresh, F.col("v")[x]).alias(x) for x in values))
    return out.select("row.*", *(F.col("v")[x].alias(x) for x in values))


def security(chart: DataFrame, requested: DataFrame, chart_timeframe: str, timeframe: str, values: list[str], other_symbol: bool = False, gaps: bool = False, timezone: str = "UTC", intervals: list[Interval] | None = None) -> DataFrame:
    """Chart bars with values of the latest requested bar that has closed by the chart bar's close (lookahead off).

    With ``intervals`` (trading hours of the requested symbol) an intraday bar closes with its session at the latest.

    ``requested`` holds bars on ``timeframe`` with the values as columns; with ``other_symbol`` it is one symbol for all chart symbols,
    whose bars and the chart's distinct instants (a dimension of time, not of rows) are merged in one task.
    The request of the chart's own symbol and timeframe is a plain equi-join.
    """
    if not other_symbol and parse(timeframe) == parse(chart_timeframe):
        picked = requested.select("symbol", "time", *values)
        return chart.join(picked, ["symbol", "time"], "left")
    left = chart.withColumn("__close", bucket_end(F.col("time"), chart_timeframe, timezone))
    right = requested.withColumn("__end", bucket_end(F.col("time"), timeframe, timezone, intervals))
    if not other_symbol:
        return asof(left, right, ["symbol"], "__close", "__end", values, gaps).drop("__close")
    # the one symbol is merged with the distinct instants of the chart, and each bar looks its instant up
    one = lambda df: df.withColumn("__one", F.lit(1))
    found = asof(one(left.select("__close").distinct()), one(right.withColumn("__last", F.col("__end"))), ["__one"], "__close", "__end", [*values, "__last"]).drop("__one")
    out = left.join(found, "__close")
    if gaps:
        before = F.lag("__last").over(Window.partitionBy("symbol").orderBy("__close"))
        out = out.withColumn("__fresh", F.col("__last").isNotNull() & ~F.col("__last").eqNullSafe(before))
        out = out.withColumns({v: F.when(F.col("__fresh"), F.col(v)) for v in values})
    return out.select(*(F.col(f"`{c}`") for c in chart.columns), *values)


def own_timeframe(chart: DataFrame, chart_timeframe: str, timeframe: str, expressions: dict[str, Column], gaps: bool = False, **calendar) -> DataFrame:
    """Coarser bars of the chart's own feed, an expression over each, merged back."""
    higher = resample(chart.select("symbol", "time", "open", "high", "low", "close", "volume"), timeframe, chart_timeframe, **calendar)
    named = higher.select("symbol", "time", *(e.alias(n) for n, e in expressions.items()))
    return security(chart, named, chart_timeframe, timeframe, list(expressions), gaps=gaps)


def heikinashi(bars: DataFrame) -> DataFrame:
    """Averaged bars (Heikin-Ashi) in place of the prices, as a request of a marked ticker gets them."""
    chart = Chart(bars)
    made = dict(zip(PRICES, ta.heikinashi(chart), strict=True))
    return chart.select(keep=("volume",), **made).select("symbol", "time", *PRICES, "volume")


def feed(ticker: str, feeds: dict[str, DataFrame], ignore_invalid_symbol: bool = False) -> DataFrame | None:
    """The bars that a ticker names: of a feed, averaged if the ticker is marked; None for an unknown symbol if that is to be ignored."""
    name = ticker.removeprefix(HEIKIN_ASHI)
    if name not in feeds:
        if ignore_invalid_symbol:
            return None
        raise ValueError(f"there is no symbol {name!r}")
    return heikinashi(feeds[name]) if ticker.startswith(HEIKIN_ASHI) else feeds[name]


def security_of(chart: DataFrame, ticker: str, feeds: dict[str, DataFrame], chart_timeframe: str, timeframe: str, expressions: dict[str, Column], ignore_invalid_symbol: bool = False, gaps: bool = False) -> DataFrame:
    """``security`` by ticker: an expression over the bars of one named feed (one symbol); na columns for an ignored symbol."""
    bars = feed(ticker, feeds, ignore_invalid_symbol)
    if bars is None:
        return chart.withColumns({n: F.lit(None).cast("double") for n in expressions})
    named = bars.select("time", *(e.alias(n) for n, e in expressions.items()))
    return security(chart, named, chart_timeframe, timeframe, list(expressions), other_symbol=True, gaps=gaps)


def lookahead_on(chart: DataFrame, timeframe: str, **calendar) -> DataFrame:
    """The developing bar of the chart's own feed and ``last_close``, the close of the last finished one: still no future values."""
    d = developing(chart, timeframe, **calendar)
    higher = resample(chart.select("symbol", "time", "open", "high", "low", "close", "volume"), timeframe, **calendar)
    w = Window.partitionBy("symbol").orderBy("time")
    closed = higher.select("symbol", F.col("time").alias("bucket"), F.lag("close").over(w).alias("last_close"))
    return d.join(closed, ["symbol", "bucket"], "left")


def future_leak(chart: DataFrame, timeframe: str, **calendar) -> DataFrame:
    """The final close of the period on each of its bars: for measuring what looking ahead would gain, never for trading."""
    higher = resample(chart.select("symbol", "time", "open", "high", "low", "close", "volume"), timeframe, **calendar)
    leaked = higher.select("symbol", F.col("time").alias("bucket"), F.col("close").alias("leaked_close"))
    return chart.withColumn("bucket", bucket(F.col("time"), timeframe, **calendar)).join(leaked, ["symbol", "bucket"], "left")


def lower_timeframe(chart: DataFrame, lower: DataFrame, chart_timeframe: str, values: list[str], **calendar) -> DataFrame:
    """For each chart bar, arrays of the values of the lower bars that open inside it, in order (empty if there are none)."""
    at = bucket(F.col("time"), chart_timeframe, **calendar)
    listed = lower.groupBy("symbol", at.alias("__bar")).agg(F.sort_array(F.collect_list(F.struct("time", *values))).alias("__l"))
    joined = chart.join(listed, (chart.symbol == listed.symbol) & (chart.time == listed["__bar"]), "left").select(chart["*"], "__l")
    pick = lambda v: F.coalesce(F.transform("__l", lambda e: e[v]), F.array().cast(lower.select(F.array(v)).schema[0].dataType)).alias(f"{v}s")
    return joined.select(*(F.col(c) for c in chart.columns), *(pick(v) for v in values))


def currency_rate(df: DataFrame, rates: DataFrame, from_currency: str, to_currency: str, time: str = "time") -> DataFrame:
    """``df`` with ``rate`` at its time: 1 for equal or empty codes, the pair's rate, or one over the inverse pair's.

    ``rates`` has base, quote, time and rate.
    """
    if from_currency == to_currency or not from_currency or not to_currency:
        return df.withColumn("rate", F.lit(1.0))
    direct = (F.col("base") == from_currency) & (F.col("quote") == to_currency)
    inverse = (F.col("base") == to_currency) & (F.col("quote") == from_currency)
    used = rates.where(direct | inverse).select(F.col("time").alias("__rt"), F.when(direct, F.col("rate")).otherwise(F.try_divide(F.lit(1.0), F.col("rate"))).alias("rate"))
    # per month of the data: the rate that holds at its start, and the rates inside it; rows meet the spans of their month only
    month = lambda c: F.date_trunc("month", c)
    one = lambda df: df.withColumn("__one", F.lit(1))
    months = df.select(month(F.col(time)).alias("__m")).where("__m IS NOT NULL").distinct()
    held = asof(one(months), one(used), ["__one"], "__m", "__rt", ["rate"]).where(F.col("rate").isNotNull()).select("__m", F.col("__m").alias("__rt"), "rate")
    inside = used.select(month(F.col("__rt")).alias("__m"), "__rt", "rate").where(F.col("__rt") > F.col("__m"))
    spans = held.unionByName(inside).withColumn("__until", F.lead("__rt").over(Window.partitionBy("__m").orderBy("__rt")))
    hit = (F.col("__t") >= F.col("__rt")) & (F.col("__until").isNull() | (F.col("__t") < F.col("__until"))) & (F.col("__dm") == F.col("__m"))
    return df.withColumns({"__t": F.col(time), "__dm": month(F.col(time))}).join(spans, hit, "left").select(*(F.col(c) for c in df.columns), "rate")


def unavailable(df: DataFrame, name: str, ignore_invalid_symbol: bool = False) -> DataFrame:
    """dividends, splits, earnings, financial, economic, quandl, seed and footprint have no source: na, or an error."""
    if not ignore_invalid_symbol:
        raise ValueError("there is no source for this request")
    return df.withColumn(name, F.lit(None).cast("double"))
