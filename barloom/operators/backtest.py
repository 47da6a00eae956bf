"""Backtests over many symbols: one ordered pass per symbol, trades and equity as ordinary DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.simulator import Broker, Settings

EVENT = (
    "kind string, symbol string, time timestamp, bar_index long, equity double, netprofit double, openprofit double, position_size double, position_avg_price double, max_drawdown double, max_runup double, "
    "trade_num long, entry_id string, direction int, size double, entry_price double, entry_time timestamp, entry_bar_index long, entry_comment string, exit_id string, exit_price double, exit_time timestamp, exit_bar_index long, exit_comment string, "
    "profit double, commission double, trade_max_runup double, trade_max_drawdown double, margin_calls long, max_contracts double, records map<string,double>"
)
NAMES = [x.split()[0] for x in EVENT.split(", ")]
ARROW = {"string": pa.string(), "timestamp": pa.timestamp("us", "UTC"), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "map<string,double>": pa.map_(pa.string(), pa.float64())}
TYPES = [ARROW[x.split()[1]] for x in EVENT.split(", ")]


def backtest(bars: DataFrame, strategy: Callable[[Broker, dict[str, Any]], None], settings: Settings | None = None, setup: Callable[[Broker], None] | None = None, sub_bars: str | None = None) -> DataFrame:
    """Run ``strategy(broker, bar)`` on every bar of every symbol after the orders of earlier bars have been filled on it.

    ``bars`` needs symbol, time and prices; all its columns (indicators, signals) are in ``bar``.  Conditions are best computed as columns
    before; only what depends on the position needs the function.  The pass streams over the sorted bars of a partition and
    keeps one symbol's state, so long symbols need no more memory than short ones.  Rows: kind 'bar', 'trade' (closed) and 'open' (left at the end).
    """
    s = settings or Settings()
    columns = bars.columns

    def finish(broker: Broker, symbol: str) -> list[tuple]:
        return [trade_row("open", broker, symbol, t) for t in broker.open]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: str | None = None
        broker: Broker | None = None
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], names=NAMES)
        for batch in batches:
            rows: list[tuple] = []
            for bar in batch.to_pylist():
                if broker is None or bar["symbol"] != current:
                    if broker is not None:
                        rows += finish(broker, current)
                    current, broker = bar["symbol"], Broker(s)
                    if setup:
                        setup(broker)
                inner = [(b["open"], b["high"], b["low"], b["close"]) for b in bar[sub_bars]] if sub_bars else None
                broker.process(bar["time"], bar["open"], bar["high"], bar["low"], bar["close"], bar["time"].date(), inner)
                strategy(broker, bar)
                broker.after_body(broker.tick(bar["close"]))
                rows += [trade_row("trade", broker, current, t) for t in broker.fresh]
                broker.fresh = []
                avg = broker.position_avg_price
                rows.append(("bar", current, bar["time"], broker.bar_index, broker.equity, broker.realised, broker.openprofit, broker.position_size, avg if avg == avg else None, broker.max_drawdown, broker.max_runup, *[None] * 17, broker.margin_calls, broker.max_contracts, list(broker.records.items())))
                broker.records = {}
            if rows:
                yield pack(rows)
        if broker is not None and (rows := finish(broker, current)):
            yield pack(rows)

    missing = {"symbol", "time", "open", "high", "low", "close"} - set(columns)
    if missing:
        raise ValueError(f"bars lack {', '.join(sorted(missing))}")
    return bars.repartition("symbol").sortWithinPartitions("symbol", "time").mapInArrow(run, EVENT)


def trade_row(kind: str, b: Broker, symbol: str, t: Any) -> tuple:
    return (kind, symbol, b.time, b.bar_index, *[None] * 7, t.number, t.entry_id, t.direction, t.size, t.entry_price, t.entry_time, t.entry_bar, t.entry_comment, t.exit_id, t.exit_price, t.exit_time, t.exit_bar, t.exit_comment, b.profit_of(t) if kind == "open" else t.profit, t.commission, t.max_runup, t.max_drawdown, None, None, None)


BAR_COLUMNS = ("symbol", "time", "bar_index", "equity", "netprofit", "openprofit", "position_size", "position_avg_price", "max_drawdown", "max_runup", "margin_calls", "max_contracts", "records")
TRADE_COLUMNS = NAMES[NAMES.index("trade_num") : NAMES.index("margin_calls")]


def equity(events: DataFrame) -> DataFrame:
    return events.where("kind = 'bar'").select(*BAR_COLUMNS)


def closed_trades(events: DataFrame) -> DataFrame:
    """Closed trades of each symbol with their ordinal (0-based, in order of exit) and percentages of the entry's value."""
    value = F.col("entry_price") * F.col("size")
    w = Window.partitionBy("symbol").orderBy("exit_bar_index", "trade_num", "exit_id", "size")
    percent = lambda c: F.try_divide(F.col(c) * 100, value)
    return events.where("kind = 'trade'").select("symbol", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), *TRADE_COLUMNS, percent("profit").alias("profit_percent"), percent("trade_max_runup").alias("max_runup_percent"), percent("trade_max_drawdown").alias("max_drawdown_percent"))


def open_trades(events: DataFrame) -> DataFrame:
    """Trades that are open at the end, with their ordinal."""
    w = Window.partitionBy("symbol").orderBy("trade_num")
    value = F.col("entry_price") * F.col("size")
    percent = lambda c: F.try_divide(F.col(c) * 100, value)
    return events.where("kind = 'open'").select("symbol", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), *(c for c in TRADE_COLUMNS if not c.startswith("exit")), percent("profit").alias("profit_percent"), percent("trade_max_runup").alias("max_runup_percent"), percent("trade_max_drawdown").alias("max_drawdown_percent"))


def trade_at(trades: DataFrame, ordinal: int, column: str) -> DataFrame:
    """A field of the n-th trade of each symbol; null where there is none."""
    return trades.groupBy("symbol").agg(F.max(F.when(F.col("ordinal") == ordinal, F.col(column))).alias(column))


def convert(value: Column, rate: Column, to_account: bool = True) -> Column:
    """Between the symbol's and the account's currency, with the rate of the bar."""
    return value * rate if to_account else F.try_divide(value, rate)


def statistics(events: DataFrame, initial_capital: float = Settings.initial_capital, bars: DataFrame | None = None) -> DataFrame:
    """One row of strategy statistics per symbol, from closed trades and the equity of every bar; with ``bars`` also buy and hold.

    ``events`` is read several times, so it is kept on the executors' disks: the simulation runs once.
    Values that nothing decides (the average of no trades, a ratio over zero) are 0.
    """
    events = events.persist(StorageLevel.DISK_ONLY)
    t = closed_trades(events).withColumn("bars", F.col("exit_bar_index") - F.col("entry_bar_index"))
    p = F.col("profit")
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    only = lambda c, x: or_zero(F.sum(F.when(c, x)))
    count = lambda c: F.count(F.when(c, 1))
    mean = lambda c, x: or_zero(F.avg(F.when(c, x)))
    largest = lambda pick, c, x: or_zero(pick(F.col(x), F.when(c, p)))
    found = []
    for name, side in (("", F.lit(True)), ("long_", F.col("direction") > 0), ("short_", F.col("direction") < 0)):
        win, loss = side & (p > 0), side & (p < 0)
        found += [count(side).alias(f"{name}total_trades"), count(win).alias(f"{name}winning_trades"), only(side, p).alias(f"{name}trades_profit"), only(win, p).alias(f"{name}gross_profit"), mean(side, F.col("bars")).alias(f"{name}avg_bars_in_trades")]
        found += [(F.abs(only(loss, p)) if not name else only(loss, p)).alias(f"{name}gross_loss")]
        for kind, pick, c in (("winning", F.max_by, win), ("losing", F.min_by, loss)):
            found += [largest(pick, c, "profit").alias(f"{name}largest_{kind}_trade"), largest(pick, c, "profit_percent").alias(f"{name}largest_{kind}_trade_percent")]
    found += [count(p < 0).alias("losing_trades"), mean(p > 0, p).alias("avg_winning_trade"), mean(p < 0, p).alias("avg_losing_trade"), mean(p > 0, F.col("bars")).alias("avg_bars_in_winning_trades"), mean(p < 0, F.col("bars")).alias("avg_bars_in_losing_trades"), F.sum("commission").alias("commission_paid")]
    totals = t.groupBy("symbol").agg(*found)
    # streaks: runs of one sign are islands of the difference of two row numbers
    sign = t.withColumn("sign", F.signum("profit"))
    runs = sign.withColumn("island", F.col("ordinal") - F.row_number().over(Window.partitionBy("symbol", "sign").orderBy("ordinal"))).groupBy("symbol", "sign", "island").agg(F.count(F.lit(1)).alias("n"))
    streaks = runs.groupBy("symbol").agg(F.coalesce(F.max(F.when(F.col("sign") > 0, F.col("n"))), F.lit(0)).alias("max_cons_winning_trades"), F.coalesce(F.max(F.when(F.col("sign") < 0, F.col("n"))), F.lit(0)).alias("max_cons_losing_trades"))
    before = F.lag("equity").over(Window.partitionBy("symbol").orderBy("time"))
    moves = equity(events).withColumn("r", F.try_divide(F.col("equity") - before, before))
    down = F.count(F.when(F.col("r") < 0, 1))
    spread, downside = F.stddev_samp("r"), F.sqrt(F.sum(F.when(F.col("r") < 0, F.col("r") * F.col("r"))) / down)
    year = 252
    last = moves.groupBy("symbol").agg(
        F.max_by("equity", "time").alias("final_equity"), F.max_by("netprofit", "time").alias("net_profit"), F.max("max_drawdown").alias("max_equity_drawdown"), F.max("max_runup").alias("max_equity_runup"), F.max("margin_calls").alias("margin_calls"), F.max("max_contracts").alias("max_contracts_held"),
        or_zero(F.try_divide(F.avg("r") * year, spread * year**0.5)).alias("sharpe_ratio"), or_zero(F.when(down > 1, F.try_divide(F.avg("r") * year, downside * year**0.5))).alias("sortino_ratio"),
    )
    left = events.where("kind = 'open'").groupBy("symbol").agg(F.count(F.lit(1)).alias("total_open_trades"))
    out = last.join(totals, "symbol", "left").join(streaks, "symbol", "left").join(left, "symbol", "left")
    out = out.fillna(0).withColumnsRenamed({f"{side}_trades_profit": f"{side}_net_profit" for side in ("long", "short")})
    share = lambda c: (F.col(c) * 100 / initial_capital).alias(f"{c}_percent")
    amounts = ("net_profit", "gross_profit", "gross_loss", "max_equity_drawdown", "max_equity_runup", "avg_winning_trade", "avg_losing_trade", *(f"{side}_{c}" for side in ("long", "short") for c in ("net_profit", "gross_profit", "gross_loss")))
    ratio = lambda a, b: or_zero(F.try_divide(a, b))
    means = [x for side, profit in (("", "net_profit"), ("long_", "long_net_profit"), ("short_", "short_net_profit")) for x in (ratio(F.col(profit), F.col(f"{side}total_trades")).alias(f"{side}avg_trade"), ratio(F.col(profit) * 100 / initial_capital, F.col(f"{side}total_trades")).alias(f"{side}avg_trade_percent"))]
    names = [F.col(f"{side}_total_trades").alias(f"{side}_trades") for side in ("long", "short")] + [F.col(f"{side}_avg_bars_in_trades").alias(f"{side}_avg_bars") for side in ("long", "short")]
    out = out.select("*", *map(share, amounts), *means, *names, F.abs(ratio(F.col("gross_profit"), F.col("gross_loss"))).alias("profit_factor"), ratio(F.col("winning_trades") * 100.0, F.col("total_trades")).alias("percent_profitable"), F.abs(ratio(F.col("avg_winning_trade"), F.col("avg_losing_trade"))).alias("ratio_avg_win_loss"))
    return out.join(buy_and_hold(bars, initial_capital), "symbol", "left") if bars is not None else out


def buy_and_hold(bars: DataFrame, initial_capital: float = Settings.initial_capital) -> DataFrame:
    """Return of buying at the first open and holding to the last close."""
    ends = bars.groupBy("symbol").agg(F.min_by("open", "time").alias("first"), F.max_by("close", "time").alias("last"))
    gain = F.try_divide(F.col("last") - F.col("first"), F.col("first"))
    return ends.select("symbol", (gain * initial_capital).alias("buy_and_hold_return"), (gain * 100).alias("buy_and_hold_return_percent"))
