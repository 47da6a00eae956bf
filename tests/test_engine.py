"""Series, kernels, requests, backtests, sources and streams."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barloom import engine
from barloom.operators import backtest, kernels, plots, request, resample, ta
from barloom.operators.simulator import LONG, SHORT, Broker, Settings
from barloom.plans.series import Chart
from barloom.sources import bars as sources
from barloom.streaming import live

START = dt.datetime(2024, 1, 1)


def walk(n: int, seed: int, gaps: bool = False) -> list[tuple]:
    rng, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        o = price
        price = max(1.0, price + rng.gauss(0, 1))
        h, low = max(o, price) + rng.random(), min(o, price) - rng.random()
        rows.append((START + dt.timedelta(hours=i), o, h, low, None if gaps and rng.random() < 0.2 else price, float(rng.randint(1, 9))))
    return rows


def frame(spark, symbols: dict[str, list[tuple]]):
    rows = [(s, *r) for s, bars in symbols.items() for r in bars]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, time timestamp, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark, {"A": walk(120, 1), "B": walk(90, 2, gaps=True)}).cache()


def values(df, name, symbol):
    return [r[name] for r in df.where(F.col("symbol") == symbol).orderBy("time").collect()]


def test_folds_equal_plain_loops(bars):
    c = Chart(bars)
    out = c.select(ema=ta.ema(c.close, 5), rma=ta.rma(c.close, 5), rsi=ta.rsi(c.close, 5), macd=ta.macd(c.close, 3, 6, 4)[1]).cache()
    for s in "AB":
        xs = values(bars, "close", s)
        e, count, total, want = None, 0, 0.0, []
        for x in xs:
            if x is None:
                want.append(None)
                continue
            count, total = count + 1, total + x
            e = None if count < 5 else total / 5 if count == 5 else e + (x - e) / 3
            want.append(e)
        assert values(out, "ema", s) == pytest.approx(want)
        for name, kernel in (("rma", kernels.Rma(5)), ("rsi", kernels.Rsi(5))):
            assert [math.nan if v is None else v for v in values(out, name, s)] == pytest.approx(kernel.push(np.array([math.nan if x is None else x for x in xs])).tolist(), nan_ok=True)


@pytest.mark.parametrize("make", [lambda: kernels.Ema(5), lambda: kernels.Rsi(4), lambda: kernels.Tsi(3, 5), lambda: kernels.Macd(3, 5, 2)])
def test_kernels_do_not_mind_how_they_are_fed(make):
    x = np.array([r[4] for r in walk(60, 3)])
    whole, pieces = make(), make()
    a = np.vstack([whole.push(x)])
    b = np.hstack([np.vstack([pieces.push(part)]) for part in np.array_split(x, 7)])
    assert np.allclose(a, b, equal_nan=True)


def test_repeat_and_skip_of_na(bars):
    c = Chart(bars)
    out = c.select(keep=("close",), sma=ta.sma(c.close, 4), total=ta.sum(c.close, 4), cum=ta.cum(c.close), swma=ta.swma(c.close), fix=ta.fixnan(c.close))
    held, last = [], None
    for r in out.where("symbol = 'B'").orderBy("time").collect():
        if r.close is not None:
            held.append(r.close)
            last = sum(held[-4:]) / 4 if len(held) >= 4 else None
        assert r.sma == (pytest.approx(last) if last is not None else None)
        assert r.total == (pytest.approx(last * 4) if last is not None else None)
        assert (r.cum is None) == (r.close is None)
        assert r.fix == (held[-1] if held else None)


def test_sar_and_supertrend(bars):
    c = Chart(bars)
    line, way = ta.supertrend(c, 2.0, 5)
    out = c.select(keep=("high", "low", "close"), sar=ta.sar(c), line=line, way=way).where("symbol = 'A'").orderBy("time").collect()
    assert out[0].sar is None and (out[0].line, out[0].way) == (0.0, 1.0)
    for r in out[2:]:
        assert r.sar <= r.low or r.sar >= r.high
    for r in out[10:]:
        assert r.way in (1.0, -1.0) and (r.line >= r.close) == (r.way == 1.0)


def test_no_lookahead(spark):
    rows = walk(100, 5)
    script = lambda c: c.select(sma=ta.sma(c.close, 10), ema=ta.ema(c.close, 10), pivot=ta.pivothigh(c.high, 3, 2), cross=ta.cross(ta.sma(c.close, 3), ta.sma(c.close, 9)), rank=ta.percentrank(c.close, 9))
    whole = script(Chart(frame(spark, {"A": rows}))).orderBy("time").collect()
    part = script(Chart(frame(spark, {"A": rows[:60]}))).orderBy("time").collect()
    assert whole[:60] == part
    with_htf = lambda r: request.own_timeframe(frame(spark, {"A": r}), "60", "240", {"c4": F.col("close")}).orderBy("time").collect()
    assert with_htf(rows)[:60] == with_htf(rows[:60])


def test_operators_of_series(bars):
    c = Chart(bars)
    cond = (c.close > c.open) & ~(c.close > 1000.0)
    out = c.select(up=cond, pick=cond.where(c.close, c.open), back=c.close[2], share=c.close / 0.0, same=c.close.eq(c.close + 1e-11))
    r = out.where("symbol = 'A'").orderBy("time").collect()
    assert r[0].back is None and all(x.share is None and x.same for x in r) and {x.up for x in r} == {True, False}


def test_when_active(bars):
    c = Chart(bars)
    every_other = c.bar_index.map(lambda i: i % 2 == 0)
    out = c.select(i=c.bar_index, v=ta.when_active(every_other, c.bar_index * 1.0, lambda s: ta.sma(s, 3))).where("symbol = 'A'").orderBy("time").collect()
    assert [r.v for r in out[:8]] == [None, None, None, None, 2.0, 2.0, 4.0, 4.0]


def test_resampling(spark, bars):
    four = resample.resample(bars.where("symbol = 'A'"), "240", "60", keep_list=True).orderBy("time").first()
    rows = walk(120, 1)[:4]
    assert (four.open, four.high, four.low, four.close, four.volume) == (rows[0][1], max(r[2] for r in rows), min(r[3] for r in rows), rows[3][4], sum(r[5] for r in rows))
    assert [b.open for b in four.sub_bars] == [r[1] for r in rows]
    assert {tuple(r) for r in resample.infer_period(bars).collect()} == {("A", 3600, "60"), ("B", 3600, "60")}
    bad = spark.createDataFrame([("A", START, 1.0, 0.5, 0.4, 0.6, 1.0), ("A", START, 1.0, 2.0, 0.5, 1.5, 1.0), ("A", START, 1.0, 2.0, 0.5, 1.5, 1.0)], bars.schema)
    assert resample.valid(bad).count() == 1


def test_currency_and_missing_rates(spark):
    df = spark.createDataFrame([(1, START), (2, START + dt.timedelta(days=40)), (2, START + dt.timedelta(days=40)), (3, START - dt.timedelta(days=1))], "id long, time timestamp")
    rates = spark.createDataFrame([("EUR", "USD", START, 1.25)], "base string, quote string, time timestamp, rate double")
    assert sorted((r.id, r.rate) for r in request.currency_rate(df, rates, "USD", "EUR").where("rate is not null").collect()) == [(1, 0.8), (2, 0.8), (2, 0.8)]
    assert request.currency_rate(df, rates, "EUR", "GBP").where("rate is not null").count() == 0
    assert request.currency_rate(df, rates, "EUR", "EUR").count() == 4


def run(rows, on_bar, setup=None, **settings):
    b = Broker(Settings(mintick=0.01, **settings))
    if setup:
        setup(b)
    done = []
    for i, (o, h, low, c) in enumerate(rows):
        b.process(START + dt.timedelta(hours=i), o, h, low, c, i // 24)
        on_bar(b, i)
        b.after_body(c)
        done += b.fresh
    return b, done


def test_market_orders_fill_at_the_next_open_with_slippage():
    def on_bar(b, i):
        if i == 0:
            b.entry("L", LONG)
        if i == 2:
            b.close("L")

    b, closed = run([(10, 11, 9, 10), (10.5, 12, 10, 11), (11, 12, 10, 11), (12, 13, 11, 12)], on_bar, slippage=2, commission_type="cash_per_order", commission_value=1.0)
    t = closed[0]
    assert (t.entry_price, t.exit_price, t.entry_bar, t.exit_bar) == (10.52, 11.98, 1, 3)
    assert t.profit == pytest.approx(1.46 - 2) and b.equity == pytest.approx(1_000_000 + 1.46 - 2)


def test_path_decides_between_stop_and_limit():
    def on_bar(b, i):
        if i == 0:
            b.entry("L", LONG)
            b.exit("X", "L", limit=12, stop=9)

    rows = [(10, 10, 10, 10), (10, 10.1, 9.9, 10)]
    assert run([*rows, (10, 12.5, 8, 10)], on_bar)[1][0].exit_price == 9
    assert run([*rows, (11.5, 12.5, 8, 10)], on_bar)[1][0].exit_price == 12
    assert run([*rows, (8.5, 9, 8, 8.5)], on_bar)[1][0].exit_price == 8.5  # the open has jumped the stop
    assert run([*rows, (13, 13, 12.5, 13)], on_bar)[1][0].exit_price == 13


def test_trailing_stop_follows_and_fires():
    def on_bar(b, i):
        if i == 0:
            b.entry("L", LONG)
            b.exit("T", "L", trail_points=100, trail_offset=50)

    _, closed = run([(10, 10, 10, 10), (10, 10.5, 9.9, 10.4), (10.4, 12, 10.3, 11.9), (11.9, 11.95, 11, 11)], on_bar)
    assert closed[0].exit_price == pytest.approx(11.5)


def test_reversal_pyramiding_and_partial_exits():
    def on_bar(b, i):
        if i in (0, 1, 2):
            b.entry(f"L{i}", LONG, qty=2)
        if i == 4:
            b.exit("half", "L0", qty_percent=50, limit=10)
        if i == 6:
            b.entry("S", SHORT, qty=1)

    b, closed = run([(10, 10, 10, 10)] * 9, on_bar, pyramiding=2)
    assert [(t.entry_id, t.size, t.exit_id) for t in closed] == [("L0", 1, "half"), ("L0", 1, "S"), ("L1", 2, "S")]
    assert b.position_size == -1 and b.position_entry_name == "S"


def test_oca_stop_limit_cancel_and_close_pass():
    def on_bar(b, i):
        if i == 0:
            b.entry("up", LONG, stop=11, oca_name="o", oca_type="cancel")
            b.entry("down", SHORT, stop=9, oca_name="o", oca_type="cancel")
            b.order("never", LONG, limit=1)
            b.cancel("never")
        if i == 3:
            b.close_all(immediately=True)

    b, closed = run([(10, 10, 10, 10), (10, 10.5, 9.5, 10), (10, 11.5, 9.8, 11), (11, 11.2, 10.8, 11.1)], on_bar)
    assert [(t.entry_id, t.entry_price, t.exit_price, t.exit_bar) for t in closed] == [("up", 11, 11.1, 3)] and not b.orders
    _, closed = run([(10, 10, 10, 10), (10, 12, 9, 11), (11, 12, 10, 10)], lambda b, i: b.entry("L", LONG) if i == 0 else b.close("L") if i == 1 else None, process_orders_on_close=True)
    assert [(t.entry_bar, t.entry_price, t.exit_bar, t.exit_price) for t in closed] == [(0, 10, 1, 11)]


def test_margin_call_and_risk_rules():
    b, closed = run([(10, 10, 10, 10), (10, 10, 10, 10), (10, 10, 6, 6)], lambda b, i: b.entry("L", LONG, qty=15) if i == 0 else None, initial_capital=100, margin_long=50)
    assert b.margin_calls >= 1 and closed[0].exit_id == "Margin call"
    b, _ = run([(10, 10, 10, 10)] * 4, lambda b, i: b.entry("S", SHORT), setup=lambda b: b.allow_entry_in(LONG))
    assert b.position_size == 0
    b, _ = run([(10, 10, 10, 10)] * 4, lambda b, i: b.entry("L", LONG, qty=5), setup=lambda b: b.max_position_size(3))
    assert b.position_size == 3
    b, closed = run([(100, 100, 100, 100), (100, 100, 50, 50), (50, 50, 50, 50), (50, 50, 50, 50)], lambda b, i: b.entry("L", LONG, qty=1), setup=lambda b: b.risk_max_drawdown(10, "cash"), initial_capital=1000)
    assert b.halted and b.position_size == 0 and closed[0].exit_price == 50
    b, _ = run([(10, 10, 10, 10)] * 6, lambda b, i: b.entry("L", LONG, qty=1) if b.position_size == 0 else b.close("L"), setup=lambda b: b.max_intraday_filled_orders(2))
    assert b.day_halted and b.position_size == 0


def test_backtest_over_symbols(bars):
    def on_bar(broker, bar):
        if bar["up"]:
            broker.entry("L", LONG)
        else:
            broker.close_all()

    clean = bars.where("close is not null")
    events = engine.strategy(clean, lambda c: {"up": ta.rising(c.close, 2)}, on_bar, Settings(initial_capital=1000.0)).cache()
    e, t = backtest.equity(events), backtest.closed_trades(events)
    assert e.count() == clean.count()
    for r in e.groupBy("symbol").agg(F.max_by("netprofit", "time").alias("net")).join(t.groupBy("symbol").agg(F.sum("profit").alias("p")), "symbol").collect():
        assert r.net == pytest.approx(r.p)
    s = backtest.statistics(events, 1000.0).collect()
    assert len(s) == 2 and all(x.total_trades == x.winning_trades + x.losing_trades + t.where((F.col("symbol") == x.symbol) & (F.col("profit") == 0)).count() for x in s)
    assert backtest.trade_at(t, 0, "profit").count() == 2
    assert backtest.open_trades(events).count() == e.groupBy("symbol").agg(F.max_by("position_size", "time").alias("p")).where("p <> 0").count()


def test_drawings_and_ndjson(spark, bars):
    c = Chart(bars)
    df = c.select(keep=("close",), i=c.bar_index)
    made = plots.create(df.where("i < 3"), "line", F.concat(F.lit("l"), F.col("i").cast("string")), F.col("i"), x1=F.col("i"), y1=F.lit(1.0))
    gone = plots.delete(df.where("i = 1"), "line", F.lit("l1"), F.lit(10))
    both = plots.update(df.where("i = 0"), "line", F.lit("l0"), F.lit(11), y1=F.lit(2.0))
    events = made.unionByName(gone).unionByName(both)
    left = plots.live(events, "line").where("symbol = 'A'").orderBy("id").collect()
    assert [(r.id, r.attrs["y1"]) for r in left] == [("l0", "2.0"), ("l2", "1.0")]
    assert plots.live(events, "line", 1).where("symbol = 'A'").first().id == "l2"
    with pytest.raises(ValueError, match="no radius"):
        plots.create(df, "line", F.lit("x"), F.lit(1), radius=F.lit(1))
    p = plots.Plots()
    assert [p.plot(c.close, "a"), p.plot(c.close, "a")] == ["a", "a 2"]
    lines = plots.ndjson(c.select(**p.columns), p).where("symbol = 'B'").orderBy("seq").collect()
    assert '"hdr"' in lines[0].value and '"end"' in lines[-1].value and any('"a":null' in x.value for x in lines)


def test_inputs_are_checked(bars):
    def script(chart, plots, length=3):
        return {"m": ta.sma(chart.close, length)}

    script.limits = {"length": (1, 50)}
    assert engine.indicator(bars, script, {"length": 4}, calc_bars_count=10).count() == 20
    with pytest.raises(ValueError, match="length"):
        engine.indicator(bars, script, {"length": 99})


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Time,Volume,Open,High,Low,Close,signal\n2024-01-02,09:30,5,1,2,0.5,1.5,x\n2024-01-02,09:31,6,1.5,2,1,NaN,y\n")
    r = sources.read_csv(spark, str(tmp_path / "a.csv"), "A", "America/New_York").orderBy("time").collect()
    assert [str(x.time) for x in r] == ["2024-01-02 14:30:00", "2024-01-02 14:31:00"] and r[0].extra == {"signal": "x"} and r[1].close is None
    (tmp_path / "b.txt").write_text("time;o;h;l;c;v\n1704200000;1;2;0.5;1.5;5\n")
    assert sources.read_text(spark, str(tmp_path / "b.txt"), "B").first().volume == 5
    (tmp_path / "c.json").write_text('{"data": [{"t": 1704200000000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 1}]}')
    assert str(sources.read_json(spark, str(tmp_path / "c.json"), "C").first().time) == "2024-01-02 12:53:20"
    rows = [(1_704_200_000_000 + i * 60_000, 1.0 + i, 2.0 + i, 0.5, 1.5, 9.0) for i in range(5)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "X.ohlcv").write_bytes(sources.encode_records(rows))
    assert sources.read_records(spark, str(tmp_path / "r"), start_ms=rows[2][0]).count() == 3
    import struct

    old = sources.decode_records(struct.pack("<Ifffff", 1_704_200_000, 1, 2, 0.5, 1.5, 3) + struct.pack("<Ifffff", 1_704_200_060, 1, 1, 1, 1, -1))
    assert old["time"].tolist() == [1_704_200_000_000]
    assert [sources.detect("x", h) for h in (sources.MAGIC, b" [{}]", b"time,open", b"a;b")] == ["records", "json", "csv", "text"]
    assert sources.guess_symbol("/x/ccxt_BTCUSDT_60.csv") == ("BTCUSDT", "crypto") and sources.guess_symbol("EURUSD, 60.csv")[1] == "forex"
    bars = frame(spark, {"A": walk(30, 1)})
    sources.write(bars, str(tmp_path / "w"))
    got = sources.read(spark, str(tmp_path / "w"), "2024-01-01 05:00:00", "2024-01-01 09:00:00")
    assert got.count() == 5 and "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time" in got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sources.export(bars, str(tmp_path / "e"))
    assert spark.read.csv(str(tmp_path / "e"), header=True).count() == 30


class Fake(sources.Provider):
    def symbols(self):
        return ["P", "Q"]

    def bars(self, symbol, timeframe, start_ms, end_ms):
        yield from ((t, 1.0, 2.0, 0.5, 1.5, 1.0) for t in range(0, 300_000, 60_000))


def test_closed_and_developing_bars_of_a_stream(spark, tmp_path):
    rows = walk(25, 9)
    updates = [("A", r[0], r[4], True) for r in rows]
    updates.insert(10, ("A", rows[10][0], 50.0, False))
    updates.insert(20, ("A", rows[3][0], 1.0, True))
    for k in range(0, len(updates), 6):
        spark.createDataFrame(updates[k : k + 6], "symbol string, time timestamp, close double, is_closed boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "u"))
    stream = live.replay(spark, str(tmp_path / "u"), "symbol string, time timestamp, close double, is_closed boolean", 1)
    q = live.indicator(stream, lambda: kernels.Ema(4), ["close"], ["ema"]).writeStream.format("memory").queryName("ema_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table("ema_out")
    want = kernels.Ema(4).push(np.array([r[4] for r in rows])).tolist()
    got = [math.nan if r.ema is None else r.ema for r in out.where("is_confirmed").orderBy("time").collect()]
    assert got == pytest.approx(want, nan_ok=True)
    assert out.where("not is_confirmed").count() == 1


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "sma" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_one_shuffle_for_all_windows(spark, bars):
    c = Chart(bars)
    df = c.select(a=ta.sma(c.close, 5), b=ta.highest(c.high, 7), d=ta.change(c.close, 3), e=ta.linreg(c.close, 5))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
