"""Registered queries of strategies: every field of trades, positions and statistics, each beside SQL that derives it from signals and prices."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import engine
from barloom.operators import backtest, resample, ta
from barloom.operators.simulator import LONG, SHORT, Settings
from barloom.plans.series import Chart
from barloom.queries import BARS, CROSS, OVER, REVERSAL, TICK, query
from barloom.sources import bars as sources

def off_ties(sql: str) -> str:
    """``round(x, n)`` of a little more than x: amounts are whole parts of a cent, so halves are common and sums in another order fall on either side of them."""
    return re.sub(r", ([4-9])\) AS", lambda m: f" + 3e-{int(m[1]) + 4}, {m[1]}) AS", sql)


def settled(column: str, digits: int):
    """The same of a column."""
    return F.round(F.col(column) + 3 * 10.0 ** -(digits + 4), digits).alias(column)


SETTINGS = Settings(commission_value=0.1, slippage=2)


def crossing(spark, sf_dir, on_bar, settings: Settings = SETTINGS, setup=None) -> DataFrame:
    def script(c: Chart):
        fast, slow = ta.sma(c.close, 5), ta.sma(c.close, 20)
        return {"up": ta.crossover(fast, slow), "down": ta.crossunder(fast, slow)}

    return engine.strategy(sources.from_events(spark, sf_dir, "60"), script, on_bar, settings, setup=setup)


def reversing(broker, bar):
    """Long and short in turn, with comments; what the strategy may read is recorded on every bar."""
    if bar["up"]:
        broker.entry("L", LONG, comment="go long")
    elif bar["down"]:
        broker.entry("S", SHORT, comment="go short")
    broker.record(
        initial_capital=broker.initial_capital, equity=broker.equity, netprofit=broker.netprofit, netprofit_percent=broker.netprofit_percent, openprofit=broker.openprofit, openprofit_percent=broker.openprofit_percent, grossprofit=broker.grossprofit, grossloss=broker.grossloss, grossprofit_percent=broker.grossprofit_percent, grossloss_percent=broker.grossloss_percent,
        wintrades=broker.wintrades, losstrades=broker.losstrades, eventrades=broker.eventrades, closedtrades=broker.closedtrades, opentrades=broker.opentrades, position_size=broker.position_size, max_drawdown_percent=broker.max_drawdown_percent, max_runup_percent=broker.max_runup_percent, avg_trade=broker.avg_trade, avg_winning_trade=broker.avg_winning_trade, avg_losing_trade=broker.avg_losing_trade,
        is_long=broker.position_entry_name == "L", in_dollars=broker.account_currency == "USD",
    )


_SIDE = lambda s: f"CASE WHEN {s} > 0 THEN 'L' ELSE 'S' END"
_COMMENT = lambda s: f"CASE WHEN {s} > 0 THEN 'go long' ELSE 'go short' END"
#: Trades (closed and open) with their extremes: the fees of the entry count from the first bar, those of the exit at the end.
TRADES = f"""{REVERSAL}, marks AS (SELECT symbol, n, {TICK('high')} AS h, {TICK('low')} AS l, {TICK('close')} AS c FROM b), ends AS (SELECT symbol, max(n) AS bars FROM b GROUP BY 1),
tx AS (SELECT t.*, row_number() OVER (PARTITION BY t.symbol ORDER BY t.entry_time) AS number, coalesce(t.exit_bar, ends.bars) AS until FROM t JOIN ends USING (symbol)),
e AS (SELECT tx.symbol, tx.number, any_value(side) AS side, any_value(price) AS price, any_value(entry_time) AS entry_time, any_value(entry_bar) AS entry_bar, any_value(exit_price) AS exit_price, any_value(exit_time) AS exit_time, any_value(exit_bar) AS exit_bar,
greatest(0, max(CASE WHEN side > 0 THEN h - price ELSE price - l END) - 0.001 * any_value(price)) AS runup, greatest(0, max(CASE WHEN side > 0 THEN price - l ELSE h - price END) + 0.001 * any_value(price)) AS drawdown, arg_max(c, marks.n) AS last_close FROM tx JOIN marks ON marks.symbol = tx.symbol AND marks.n BETWEEN tx.entry_bar + 1 AND tx.until GROUP BY 1, 2),
z AS (SELECT *, 0.001 * price + coalesce(0.001 * exit_price, 0) AS fees, CASE WHEN exit_time IS NULL THEN (last_close - price) * side - 0.001 * price ELSE (exit_price - price) * side - 0.001 * (price + exit_price) END AS net FROM e)"""


@query(off_ties(f"""{TRADES} SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY number) - 1 AS ordinal, number AS trade_num, {_SIDE('side')} AS entry_id, side::INT AS direction, 1.0::DOUBLE AS size, round(price, 6) AS entry_price, entry_time, entry_bar AS entry_bar_index, {_COMMENT('side')} AS entry_comment,
{_SIDE('-side')} AS exit_id, round(exit_price, 6) AS exit_price, exit_time, exit_bar AS exit_bar_index, {_COMMENT('-side')} AS exit_comment, round(net, 6) AS profit, round(fees, 6) AS commission, round(greatest(runup, net), 6) AS trade_max_runup, round(greatest(drawdown, -net), 6) AS trade_max_drawdown,
round(net * 100 / price, 6) AS profit_percent, round(greatest(runup, net) * 100 / price, 6) AS max_runup_percent, round(greatest(drawdown, -net) * 100 / price, 6) AS max_drawdown_percent FROM z WHERE exit_time IS NOT NULL"""))
def closed_trade_fields(spark, sf_dir):
    t = backtest.closed_trades(crossing(spark, sf_dir, reversing))
    return t.select(*(settled(c, 6) if k == "double" and c != "size" else F.col(c) for c, k in t.dtypes))


@query(off_ties(f"""{TRADES} SELECT symbol, 0::BIGINT AS ordinal, number AS trade_num, {_SIDE('side')} AS entry_id, side::INT AS direction, 1.0::DOUBLE AS size, round(price, 6) AS entry_price, entry_time, entry_bar AS entry_bar_index, {_COMMENT('side')} AS entry_comment, round(net, 6) AS profit, round(fees, 6) AS commission,
round(runup, 6) AS trade_max_runup, round(drawdown, 6) AS trade_max_drawdown, round(net * 100 / price, 6) AS profit_percent, round(runup * 100 / price, 6) AS max_runup_percent, round(drawdown * 100 / price, 6) AS max_drawdown_percent FROM z WHERE exit_time IS NULL"""))
def open_trade_fields(spark, sf_dir):
    t = backtest.open_trades(crossing(spark, sf_dir, reversing))
    return t.select(*(settled(c, 6) if k == "double" and c != "size" else F.col(c) for c, k in t.dtypes))


#: Per bar: what has been realised by its open, and the position after it.
BARS_OF_ACCOUNT = f"""{TRADES}, fl AS (SELECT symbol, entry_bar + 1 AS n, -0.001 * price AS cash, 0.0 AS won, 0.0 AS lost, 0 AS w, 0 AS l FROM z UNION ALL SELECT symbol, exit_bar + 1, (exit_price - price) * side - 0.001 * exit_price, greatest(net, 0), greatest(-net, 0), (net > 0)::INT, (net < 0)::INT FROM z WHERE exit_time IS NOT NULL),
fs AS (SELECT symbol, n, sum(cash) AS cash, sum(won) AS won, sum(lost) AS lost, sum(w) AS w, sum(l) AS l FROM fl GROUP BY 1, 2),
r AS (SELECT b.symbol, b.time, b.n, {', '.join(f"sum(coalesce(fs.{c}, 0)) OVER (PARTITION BY b.symbol ORDER BY b.n ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("cash", "won", "lost", "w", "l"))}, marks.h AS mh, marks.l AS ml, marks.c AS mc FROM b JOIN marks USING (symbol, n) LEFT JOIN fs USING (symbol, n)),
a0 AS (SELECT r.*, coalesce(z.side, 0) AS pos, z.price AS avg, coalesce((mc - z.price) * z.side, 0) AS op, coalesce(CASE WHEN z.side > 0 THEN ml - z.price ELSE z.price - mh END, 0) AS worst, coalesce(CASE WHEN z.side > 0 THEN mh - z.price ELSE z.price - ml END, 0) AS best FROM r LEFT JOIN z ON z.symbol = r.symbol AND r.n > z.entry_bar AND (z.exit_bar IS NULL OR r.n <= z.exit_bar)),
a1 AS (SELECT *, 1000000 + cash + op AS equity, coalesce(max(1000000 + cash + op) OVER w, 1000000) AS peak, coalesce(min(1000000 + cash + op) OVER w, 1000000) AS trough FROM a0 WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a2 AS (SELECT *, greatest(0, max(greatest(peak, 1000000) - (1000000 + cash + worst)) OVER u) AS drawdown, greatest(0, max(1000000 + cash + best - least(trough, 1000000)) OVER u) AS runup FROM a1 WINDOW u AS (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING))"""


@query(off_ties(f"""{BARS_OF_ACCOUNT} SELECT symbol, time, n - 1 AS bar_index, round(equity, 5) AS equity, round(cash, 5) AS netprofit, round(op, 5) AS openprofit, pos::DOUBLE AS position_size, round(avg, 6) AS position_avg_price, round(drawdown, 5) AS max_drawdown, round(runup, 5) AS max_runup FROM a2"""))
def equity_fields(spark, sf_dir):
    e = backtest.equity(crossing(spark, sf_dir, reversing))
    r = lambda c, d=5: settled(c, d)
    return e.select("symbol", "time", "bar_index", r("equity"), r("netprofit"), r("openprofit"), "position_size", r("position_avg_price", 6), r("max_drawdown"), r("max_runup"))


@query(off_ties(f"""{BARS_OF_ACCOUNT} SELECT symbol, time, 1000000.0::DOUBLE AS initial_capital, round(equity, 5) AS equity, round(cash, 5) AS netprofit, round(cash / 10000, 7) AS netprofit_percent, round(op, 5) AS openprofit, round(op / 10000, 7) AS openprofit_percent, round(won, 5) AS grossprofit, round(lost + CASE WHEN pos <> 0 THEN 0.001 * avg ELSE 0 END, 5) AS grossloss,
round(won / 10000, 7) AS grossprofit_percent, round((lost + CASE WHEN pos <> 0 THEN 0.001 * avg ELSE 0 END) / 10000, 7) AS grossloss_percent, w::DOUBLE AS wintrades, l::DOUBLE AS losstrades, 0.0::DOUBLE AS eventrades, (w + l)::DOUBLE AS closedtrades, abs(pos)::DOUBLE AS opentrades, pos::DOUBLE AS position_size,
round(drawdown / 10000, 7) AS max_drawdown_percent, round(runup / 10000, 7) AS max_runup_percent, round(cash / nullif(w + l, 0), 5) AS avg_trade, round(won / nullif(w, 0), 5) AS avg_winning_trade, round(lost / nullif(l, 0), 5) AS avg_losing_trade, (pos > 0)::INT::DOUBLE AS is_long, 1.0::DOUBLE AS in_dollars FROM a2"""))
def strategy_values(spark, sf_dir):
    """What a strategy reads in its body on every bar."""
    e = backtest.equity(crossing(spark, sf_dir, reversing))
    names = ("initial_capital", "equity", "netprofit", "netprofit_percent", "openprofit", "openprofit_percent", "grossprofit", "grossloss", "grossprofit_percent", "grossloss_percent", "wintrades", "losstrades", "eventrades", "closedtrades", "opentrades", "position_size", "max_drawdown_percent", "max_runup_percent", "avg_trade", "avg_winning_trade", "avg_losing_trade", "is_long", "in_dollars")
    whole = ("initial_capital", "wintrades", "losstrades", "eventrades", "closedtrades", "opentrades", "position_size", "is_long", "in_dollars")
    read = e.select("symbol", "time", *(F.nanvl(F.col("records")[n], F.lit(None).cast("double")).alias(n) for n in names))
    return read.select("symbol", "time", *(F.col(n) if n in whole else settled(n, 7 if n.endswith("percent") else 5) for n in names))


_PICK = lambda kind, f, c, side: f"coalesce({f}(net, net) FILTER (WHERE net {c} 0{side}), 0) AS {kind}_trade, coalesce({f}(net * 100 / price, net) FILTER (WHERE net {c} 0{side}), 0) AS {kind}_trade_percent"


def _side(name: str, where: str) -> str:
    both = f"WHERE {where}" if where else "WHERE true"
    more = f" AND {where}" if where else ""
    return f"""count(*) FILTER ({both}) AS {name}n, count(*) FILTER ({both} AND net > 0) AS {name}winning_trades, coalesce(sum(net) FILTER ({both}), 0) AS {name}profit, coalesce(sum(net) FILTER ({both} AND net > 0), 0) AS {name}gross_profit, coalesce(sum(net) FILTER ({both} AND net < 0), 0) AS {name}loss, coalesce(avg(exit_bar - entry_bar) FILTER ({both}), 0) AS {name}bars,
{_PICK(name + 'largest_winning', 'arg_max', '>', more)}, {_PICK(name + 'largest_losing', 'arg_min', '<', more)}"""


_AMOUNTS = ("gross_profit", "largest_winning_trade", "largest_winning_trade_percent", "largest_losing_trade", "largest_losing_trade_percent")
_SIDES = ", ".join(
    ", ".join([f"round({s}_{c}, 5) AS {s}_{c}" for c in _AMOUNTS] + [f"{s}_n AS {s}_trades, {s}_winning_trades, round({s}_profit, 5) AS {s}_net_profit, round({s}_profit / 10000, 8) AS {s}_net_profit_percent, round({s}_gross_profit / 10000, 8) AS {s}_gross_profit_percent, round({s}_loss, 5) AS {s}_gross_loss, round({s}_loss / 10000, 8) AS {s}_gross_loss_percent, round({s}_profit / {s}_n, 5) AS {s}_avg_trade, round({s}_profit / 10000 / {s}_n, 8) AS {s}_avg_trade_percent, round({s}_bars, 5) AS {s}_avg_bars"])
    for s in ("long", "short")
)
STATISTICS = f"""{BARS_OF_ACCOUNT}, q AS (SELECT symbol, {_side('', '')}, {_side('long_', 'side > 0')}, {_side('short_', 'side < 0')}, coalesce(avg(net) FILTER (WHERE net > 0), 0) AS awin, coalesce(avg(net) FILTER (WHERE net < 0), 0) AS aloss, coalesce(avg(exit_bar - entry_bar) FILTER (WHERE net > 0), 0) AS wbars, coalesce(avg(exit_bar - entry_bar) FILTER (WHERE net < 0), 0) AS lbars, sum(fees) AS fees, count(*) FILTER (WHERE net < 0) AS losing_trades FROM z WHERE exit_time IS NOT NULL GROUP BY 1),
mv AS (SELECT symbol, n, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY n) - 1 AS ret FROM a2), ra AS (SELECT symbol, avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)) AS sharpe, avg(ret) * 252 / (sqrt(sum(ret * ret) FILTER (WHERE ret < 0) / count(*) FILTER (WHERE ret < 0)) * sqrt(252)) AS sortino FROM mv GROUP BY 1),
fin AS (SELECT symbol, arg_max(cash, n) AS net_profit, arg_max(equity, n) AS final_equity, max(drawdown) AS dd, max(runup) AS ru FROM a2 GROUP BY 1), bh AS (SELECT symbol, (arg_max(close, time) - arg_min(open, time)) / arg_min(open, time) AS gain FROM b GROUP BY 1), op AS (SELECT symbol, count(*) AS left_open FROM z WHERE exit_time IS NULL GROUP BY 1)"""


@query(off_ties(f"""{STATISTICS} SELECT q.symbol, {_SIDES}, {', '.join(f'round({c}, 5) AS {c}' for c in _AMOUNTS)}, n AS total_trades, winning_trades, losing_trades, round(net_profit, 5) AS net_profit, round(net_profit / 10000, 8) AS net_profit_percent, round(final_equity, 5) AS final_equity, round(gross_profit / 10000, 8) AS gross_profit_percent, round(-loss, 5) AS gross_loss, round(-loss / 10000, 8) AS gross_loss_percent,
round(net_profit / n, 5) AS avg_trade, round(net_profit / 10000 / n, 8) AS avg_trade_percent, round(awin, 5) AS avg_winning_trade, round(awin / 10000, 8) AS avg_winning_trade_percent, round(aloss, 5) AS avg_losing_trade, round(aloss / 10000, 8) AS avg_losing_trade_percent, round(bars, 5) AS avg_bars_in_trades, round(wbars, 5) AS avg_bars_in_winning_trades, round(lbars, 5) AS avg_bars_in_losing_trades,
round(gross_profit / -loss, 6) AS profit_factor, round(winning_trades * 100.0 / n, 6) AS percent_profitable, round(abs(awin / aloss), 6) AS ratio_avg_win_loss, round(fees, 5) AS commission_paid, round(dd, 5) AS max_equity_drawdown, round(dd / 10000, 8) AS max_equity_drawdown_percent, round(ru, 5) AS max_equity_runup, round(ru / 10000, 8) AS max_equity_runup_percent,
round(sharpe, 5) AS sharpe_ratio, round(sortino, 5) AS sortino_ratio, 0::BIGINT AS margin_calls, 1.0::DOUBLE AS max_contracts_held, coalesce(left_open, 0) AS total_open_trades, round(gain * 1000000, 4) AS buy_and_hold_return, round(gain * 100, 6) AS buy_and_hold_return_percent FROM q JOIN ra USING (symbol) JOIN fin USING (symbol) JOIN bh USING (symbol) LEFT JOIN op USING (symbol)"""))
def strategy_statistics(spark, sf_dir):
    """All statistics of a strategy, buy and hold included."""
    s = backtest.statistics(crossing(spark, sf_dir, reversing), bars=sources.from_events(spark, sf_dir, "60"))
    digits = {"profit_factor": 6, "percent_profitable": 6, "ratio_avg_win_loss": 6, "buy_and_hold_return": 4, "buy_and_hold_return_percent": 6}
    keep = [c for c in s.columns if c not in ("max_cons_winning_trades", "max_cons_losing_trades", "trades_profit", *(f"{x}_{c}" for x in ("long", "short") for c in ("total_trades", "avg_bars_in_trades")))]
    of_capital = {f"{x}{c}_percent" for x in ("", "long_", "short_") for c in ("net_profit", "gross_profit", "gross_loss", "avg_trade", "avg_winning_trade", "avg_losing_trade", "max_equity_drawdown", "max_equity_runup")}
    return s.select(*(settled(c, digits.get(c, 8 if c in of_capital else 5)) if dict(s.dtypes)[c] == "double" and c != "max_contracts_held" else F.col(c) for c in keep))


# -- orders of other kinds ------------------------------------------------------------------------------------------------

_LONG = f"""WITH {CROSS}, s AS (SELECT symbol, time, n, up, dn, lead(time) OVER ({OVER}) AS next_time, lead({TICK('open')}) OVER ({OVER}) AS next_open FROM x)"""


def closing(kind: str):
    def on_bar(broker, bar):
        if bar["up"] and not broker.open:
            broker.order("B", LONG, 2.0) if kind == "order" else broker.entry("B", LONG, 2.0)
            broker.entry("never", LONG, 1.0, limit=0.01)
        if bar["down"] and broker.open:
            broker.cancel("never")
            {"close": lambda: broker.close("B", comment="out"), "close_all": lambda: broker.close_all(comment="out"), "order": lambda: broker.order("out", SHORT, 2.0, comment="out")}[kind]()
    return on_bar


def _closing_sql(kind: str) -> str:
    exit_id = {"close": "'Close entry(s) order B'", "close_all": "'Close position order'", "order": "'out'"}[kind]
    return f"""{_LONG}, ev AS (SELECT *, CASE WHEN up THEN 1 WHEN dn THEN -1 END AS side FROM s WHERE (up OR dn) AND next_time IS NOT NULL), st AS (SELECT *, lag(side) OVER (PARTITION BY symbol ORDER BY n) AS before FROM ev),
fx AS (SELECT * FROM st WHERE side = 1 AND before IS DISTINCT FROM 1 OR side = -1 AND before = 1), pr AS (SELECT symbol, side, next_time AS entry_time, next_open AS price, lead(next_time) OVER (PARTITION BY symbol ORDER BY n) AS exit_time, lead(next_open) OVER (PARTITION BY symbol ORDER BY n) AS exit_price FROM fx)
SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY exit_time) - 1 AS ordinal, 'B' AS entry_id, {exit_id} AS exit_id, 'out' AS exit_comment, 2.0::DOUBLE AS size, round(price, 6) AS entry_price, entry_time, round(exit_price, 6) AS exit_price, exit_time, round((exit_price - price) * 2, 5) AS profit FROM pr WHERE side = 1 AND exit_time IS NOT NULL"""


def _closing(kind: str):
    def run(spark, sf_dir):
        t = backtest.closed_trades(crossing(spark, sf_dir, closing(kind), Settings()))
        return t.select("symbol", "ordinal", "entry_id", "exit_id", "exit_comment", "size", F.round("entry_price", 6).alias("entry_price"), "entry_time", F.round("exit_price", 6).alias("exit_price"), "exit_time", F.round("profit", 5).alias("profit"))

    run.__name__ = f"orders_{kind}"
    run.__doc__ = "Market entries that are closed on the opposite cross; an unreachable limit order is cancelled."
    return query(_closing_sql(kind))(run)


for _kind in ("close", "close_all", "order"):
    _closing(_kind)


@query(f"""{REVERSAL}, l AS (SELECT *, side AS s FROM f) SELECT symbol, entry_time, round(price, 6) AS entry_price FROM (SELECT symbol, fill_time AS entry_time, price, side, lag(side) OVER (PARTITION BY symbol ORDER BY fill_time) AS before FROM l) WHERE side > 0 AND before IS DISTINCT FROM 1""")
def risk_allow_entry_in(spark, sf_dir):
    """Only long entries: a short signal closes the position."""
    e = crossing(spark, sf_dir, reversing, setup=lambda broker: broker.allow_entry_in(LONG))
    columns = ("symbol", "entry_time", F.round("entry_price", 6).alias("entry_price"))
    return backtest.closed_trades(e).select(*columns).unionByName(backtest.open_trades(e).select(*columns))


@query(f"""{TRADES} SELECT symbol, count(*) AS trades, 0.5::DOUBLE AS largest FROM z GROUP BY 1""")
def risk_max_position_size(spark, sf_dir):
    e = crossing(spark, sf_dir, reversing, setup=lambda broker: broker.max_position_size(0.5))
    t = backtest.closed_trades(e).select("symbol", "size").unionByName(backtest.open_trades(e).select("symbol", "size"))
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.max("size").alias("largest"))


@query(f"""{BARS_OF_ACCOUNT} SELECT symbol, time, CASE WHEN pos <> 0 THEN CASE WHEN pos > 0 THEN floor(round((avg - 1000000 - cash_) / (1 - 0.5) / 0.01, 7)) ELSE ceil(round((1000000 + cash_ + avg) / (1 + 0.25) / 0.01, 7)) END * 0.01 END AS liquidation FROM (SELECT *, cash AS cash_ FROM a2)""")
def margin_liquidation(spark, sf_dir):
    """Price at which a margin call of the position would come, long at 50 %, short at 25 % (capital that never calls)."""

    def on_bar(broker, bar):
        reversing(broker, bar)
        broker.record(liquidation=broker.margin_liquidation_price())

    e = backtest.equity(crossing(spark, sf_dir, on_bar, Settings(commission_value=0.1, slippage=2, margin_long=50.0, margin_short=25.0)))
    return e.select("symbol", "time", F.nanvl(F.col("records")["liquidation"], F.lit(None).cast("double")).alias("liquidation"))


@query(f"""WITH {CROSS}, r AS (SELECT symbol, time, close, 1 + n / 1000.0 AS rate FROM x) SELECT symbol, time, round(close * rate, 6) AS account, round(close / rate, 6) AS back FROM r""")
def account_currency(spark, sf_dir):
    """convert_to_account and convert_to_symbol with the rate of each bar."""
    c = Chart(sources.from_events(spark, sf_dir, "60"))
    df = c.select(keep=("close",), i=c.bar_index).withColumn("rate", F.lit(1) + (F.col("i") + 1) / 1000.0)
    return df.select("symbol", "time", F.round(backtest.convert(F.col("close"), F.col("rate")), 6).alias("account"), F.round(backtest.convert(F.col("close"), F.col("rate"), to_account=False), 6).alias("back"))


# -- orders inside the bar ------------------------------------------------------------------------------------------------


def walked(bars: str, entry: str, leave: str, last: str = "true") -> str:
    """SQL of a strategy that keeps one entry order while it is flat and one bracket on the position, as a recursion over the path of the bars.

    ``bars`` has symbol, n, time, open, high, low, close and level (the entry's price as set after the last path bar of a bar, for which ``last`` holds).
    A bar is four steps: its open, and the legs to its nearer and its farther extreme and to its close.  ``entry`` is 'stop' (filled going up) or 'limit' (going down);
    ``leave`` gives the columns up_exit (a price above, from e) and down_exit (below, from e and mark), null for none; mark is the trailing high once armed.
    """
    t = lambda x: f"round({TICK(x)}, 12)"
    reached = "a >= s_level" if entry == "stop" else "a <= s_level"
    crossed = "z >= a AND a < s_level AND z >= s_level" if entry == "stop" else "z <= a AND a > s_level AND z <= s_level"
    return f"""pb AS (SELECT symbol, n, time, level, {last} AS closes, {t('open')} AS o, {t('high')} AS h, {t('low')} AS l, {t('close')} AS c FROM {bars}),
pp AS (SELECT *, CASE WHEN h - o < o - l THEN h ELSE l END AS p1, CASE WHEN h - o < o - l THEN l ELSE h END AS p2 FROM pb),
legs AS (SELECT symbol, n, time, level, closes, s, (n - 1) * 4 + s AS i, CASE s WHEN 0 THEN o WHEN 1 THEN o WHEN 2 THEN p1 ELSE p2 END AS a, CASE s WHEN 0 THEN o WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE c END AS z FROM pp, (VALUES (0), (1), (2), (3)) v(s)),
st(symbol, i, pos, e, e_time, mark, s_level, out_price, x_e, x_time, time) AS (SELECT symbol, -1::BIGINT, false, NULL::DOUBLE, NULL::TIMESTAMP, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::TIMESTAMP, NULL::TIMESTAMP FROM (SELECT DISTINCT symbol FROM pb) UNION ALL
SELECT symbol, i, pos AND out_price IS NULL, CASE WHEN out_price IS NULL THEN e END, CASE WHEN out_price IS NULL THEN e_time END, CASE WHEN pos AND out_price IS NULL THEN mark END, CASE WHEN s = 3 AND closes AND NOT (pos AND out_price IS NULL) THEN level WHEN came THEN NULL ELSE s_level END, out_price, e, e_time, time
FROM (SELECT *, CASE WHEN NOT pos THEN NULL WHEN s = 0 AND was AND (a >= up_exit OR a <= down_exit) THEN a WHEN s > 0 AND z >= a AND z >= up_exit THEN {t('up_exit')} WHEN s > 0 AND z < a AND z <= down_exit THEN {t('down_exit')} END AS out_price
FROM (SELECT *, {leave} FROM (SELECT *, CASE WHEN pos THEN {{mark}} END AS mark FROM (SELECT symbol, i, s, a, z, level, closes, time, s_level, was, came, mark0, was OR came AS pos, CASE WHEN was THEN e0 WHEN came AND s = 0 THEN {t('a')} WHEN came THEN {t('s_level')} END AS e, CASE WHEN was THEN t0 WHEN came THEN time END AS e_time
FROM (SELECT *, NOT was AND s_level IS NOT NULL AND (s = 0 AND {reached} OR s > 0 AND {crossed}) AS came FROM (SELECT legs.*, st.pos AS was, st.e AS e0, st.e_time AS t0, st.mark AS mark0, st.s_level FROM st JOIN legs ON legs.symbol = st.symbol AND legs.i = st.i + 1)))))))"""


_TRADES = "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS ordinal, round(x_e + 3e-9, 5) AS entry_price, x_time AS entry_time, round(out_price + 3e-9, 5) AS exit_price, time AS exit_time, round(out_price - x_e + 3e-9, 5) AS profit FROM st WHERE out_price IS NOT NULL"
_BRACKET = "e + {profit} AS up_exit, e - {loss} AS down_exit"


def exits(events: DataFrame) -> DataFrame:
    t = backtest.closed_trades(events)
    return t.select("symbol", "ordinal", settled("entry_price", 5), "entry_time", settled("exit_price", 5), "exit_time", settled("profit", 5))


@query(f"WITH RECURSIVE {BARS}, lv AS (SELECT *, high AS level FROM b), {walked('lv', 'stop', _BRACKET.format(profit='5.0', loss='3.0')).replace('{mark}', 'NULL')} {_TRADES}")
def orders_stop_and_bracket(spark, sf_dir):
    """A stop entry above the last bar, cancelling a limit order of its group, and a bracket in ticks."""

    def on_bar(broker, bar):
        if not broker.open:
            broker.entry("L", LONG, stop=bar["high"], oca_name="in", oca_type="cancel")
            broker.entry("never", LONG, limit=-1.0, oca_name="in", oca_type="cancel")
        broker.exit("X", "L", profit=500, loss=300)

    return exits(backtest.backtest(sources.from_events(spark, sf_dir, "60"), on_bar, Settings()))


@query(f"WITH RECURSIVE {BARS}, lv AS (SELECT *, low AS level FROM b), {walked('lv', 'limit', 'NULL::DOUBLE AS up_exit, mark - 2.0 AS down_exit').replace('{mark}', 'CASE WHEN mark0 IS NOT NULL THEN greatest(mark0, CASE WHEN came THEN e ELSE a END, z) WHEN greatest(CASE WHEN came THEN e ELSE a END, z) >= e + 3.0 THEN greatest(CASE WHEN came THEN e ELSE a END, z) END')} {_TRADES}")
def orders_limit_and_trail(spark, sf_dir):
    """A limit entry below the last bar, and a stop that trails by 2.00 once the price is 3.00 above the entry."""

    def on_bar(broker, bar):
        if not broker.open:
            broker.cancel_all()
            broker.entry("L", LONG, limit=bar["low"])
        broker.exit("T", "L", trail_points=300, trail_offset=200)

    return exits(backtest.backtest(sources.from_events(spark, sf_dir, "60"), on_bar, Settings()))


@query(f"""WITH RECURSIVE {BARS}, d AS (SELECT *, date_trunc('day', time)::TIMESTAMP AS day FROM b), lv AS (SELECT symbol, n, day AS time, open, high, low, close, min(low) OVER (PARTITION BY symbol, day) AS level, n = max(n) OVER (PARTITION BY symbol, day) AS ends FROM d), {walked('lv', 'limit', _BRACKET.format(profit='20.0', loss='20.0'), 'ends').replace('{mark}', 'NULL')} {_TRADES}""")
def orders_magnified(spark, sf_dir):
    """Daily bars whose limit entries and brackets fill along their hourly bars."""
    day = resample.resample(sources.from_events(spark, sf_dir, "60"), "1D", "60", keep_list=True)

    def on_bar(broker, bar):
        if not broker.open:
            broker.entry("L", LONG, limit=bar["low"])
        broker.exit("X", "L", profit=2000, loss=2000)

    return exits(backtest.backtest(day, on_bar, Settings(), sub_bars="sub_bars"))


@query(off_ties(f"""{STATISTICS} SELECT symbol, 'plots' AS file, 'rows' AS name, count(*)::DOUBLE AS value FROM b GROUP BY symbol UNION ALL SELECT symbol, 'trades', 'rows', n::DOUBLE FROM q UNION ALL SELECT symbol, 'statistics', 'percent_profitable', round(winning_trades * 100.0 / n, 5) AS value FROM q UNION ALL SELECT symbol, 'statistics', 'commission_paid', round(fees, 5) AS value FROM q"""))
def run_files(spark, sf_dir):
    """Plots, trades and statistics written as files of a run, and read again."""
    from barloom.queries_values import shared_folder

    folder = shared_folder(spark)
    bars = sources.from_events(spark, sf_dir, "60")
    outputs = engine.indicator(bars, lambda chart, plots: {"mean": ta.sma(chart.close, 5)})
    engine.write_files(outputs, crossing(spark, sf_dir, reversing), folder)
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{name}")
    rows = [read(n).groupBy("symbol").agg(F.lit(n).alias("file"), F.lit("rows").alias("name"), F.count(F.lit(1)).cast("double").alias("value")) for n in ("plots", "trades")]
    values = read("statistics").where("name IN ('percent_profitable', 'commission_paid')").select("symbol", F.lit("statistics").alias("file"), "name", settled("value", 5))
    return rows[0].unionByName(rows[1]).unionByName(values)
