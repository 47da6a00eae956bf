"""Registered queries of the engine over the driver's tables, each beside the SQL that it must equal.

``@query(sql)`` registers a function under its name; without SQL the query is tested against plain Python instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import engine
from barloom.functions import arrays, color, maps, matrices, na, strings, ticker, timeframe
from barloom.functions import math as fmath
from barloom.functions import time as ftime
from barloom.operators import backtest, plots, request, resample, ta
from barloom.operators.simulator import LONG, SHORT, Settings
from barloom.plans.series import Chart
from barloom.sources import bars as sources
from barloom.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BARS = """b0 AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS time, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS n FROM b0)"""
OVER = "PARTITION BY symbol ORDER BY time"


def last(n: int) -> str:
    return f"OVER ({OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


ALL = f"OVER ({OVER} ROWS UNBOUNDED PRECEDING)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def hourly(spark: SparkSession, sf_dir: str) -> Chart:
    return Chart(sources.from_events(spark, sf_dir, "60"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles to fixed digits (some columns to others), so that sums in another order compare equal."""
    return df.select(*(F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# -- scans, resampling ---------------------------------------------------------------------------------------------------


@query(f"WITH {BARS} SELECT symbol, time, open, high, low, close, volume FROM b")
def resample_hourly(spark, sf_dir):
    return sources.from_events(spark, sf_dir, "60")


@query("SELECT event_type AS symbol, to_timestamp(floor(epoch(ts) / 14400) * 14400)::TIMESTAMP AS time, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2")
def resample_4h_from_hourly(spark, sf_dir):
    return resample.resample(sources.from_events(spark, sf_dir, "60"), "240", "60")


LINEITEM = """SELECT l_returnflag AS symbol, {bucket} AS time, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2"""


@query(LINEITEM.format(bucket="date_trunc('day', l_shipdate)::TIMESTAMP"))
def resample_daily(spark, sf_dir):
    return sources.from_lineitem(spark, sf_dir, "1D")


@query(LINEITEM.format(bucket="date_trunc('week', l_shipdate)::TIMESTAMP"))
def resample_weekly(spark, sf_dir):
    return sources.from_lineitem(spark, sf_dir, "1W")


@query(LINEITEM.format(bucket="make_timestamp(year(l_shipdate), ((month(l_shipdate) - 1) // 3) * 3 + 1, 1, 0, 0, 0)"))
def resample_quarterly(spark, sf_dir):
    return sources.from_lineitem(spark, sf_dir, "3M")


@query(LINEITEM.format(bucket="(make_date(year(l_shipdate), 1, 1) + ((dayofyear(l_shipdate) - 1) // 3 * 3)::INT)::TIMESTAMP"))
def resample_3d_grid(spark, sf_dir):
    return sources.from_lineitem(spark, sf_dir, "3D")


@query("""WITH d AS (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS time, max(l_extendedprice) AS high, min(l_extendedprice) AS low, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, (dense_rank() OVER (PARTITION BY symbol, year(time) ORDER BY time) - 1) // 5 AS slot FROM d)
SELECT symbol, min(time) AS time, max(high) AS high, min(low) AS low, sum(volume) AS volume FROM r GROUP BY symbol, year(time), slot""")
def resample_observed_5d(spark, sf_dir):
    return resample.observed(sources.from_lineitem(spark, sf_dir, "1D"), "5D").select("symbol", "time", "high", "low", "volume")


@query(f"""WITH {BARS}, g AS (SELECT symbol, epoch(time) - epoch(lag(time) OVER ({OVER})) AS gap FROM b) SELECT symbol, min(gap)::BIGINT AS seconds, (min(gap) / 60)::BIGINT::VARCHAR AS period FROM g WHERE gap > 0 GROUP BY symbol""")
def infer_period(spark, sf_dir):
    return resample.infer_period(sources.from_events(spark, sf_dir, "60"))


@query(f"WITH {BARS} SELECT symbol, time, close FROM b WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def time_range(spark, sf_dir):
    return sources.from_events(spark, sf_dir, "60").where(F.col("time").between("2024-01-05", "2024-01-12")).select("symbol", "time", "close")


@query(f"WITH {BARS}, t AS (SELECT *, n - 1 AS absolute_index, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS back FROM b) SELECT symbol, time, absolute_index, avg(close) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS mean FROM t WHERE back <= 50")
def calc_bars_count(spark, sf_dir):
    c = hourly(spark, sf_dir).last_bars(50)
    return rounded(c.select(keep=("absolute_index",), mean=c.close.window(lambda x: F.avg(x).over(c.over(0)))), 9)


@query(f"WITH {BARS} SELECT symbol, time, n - 1 AS bar_index, count(*) OVER (PARTITION BY symbol) - 1 AS last_bar_index, n = 1 AS isfirst, n = count(*) OVER (PARTITION BY symbol) AS islast, (high + low) / 2 AS hl2, (high + low + close) / 3 AS hlc3, (open + high + low + close) / 4 AS ohlc4, (high + low + 2 * close) / 4 AS hlcc4 FROM b")
def bar_columns(spark, sf_dir):
    c = hourly(spark, sf_dir)
    s = c.barstate()
    return c.select(bar_index=c.bar_index, last_bar_index=c.last_bar_index, isfirst=s["isfirst"], islast=s["islast"], hl2=c.hl2, hlc3=c.hlc3, ohlc4=c.ohlc4, hlcc4=c.hlcc4)


# -- window indicators -----------------------------------------------------------------------------------------------------


def mean(x: str, n: int) -> str:
    return f"CASE WHEN n >= {n} THEN avg({x}) {last(n)} END"


@query(f"""WITH {BARS}, s AS (SELECT symbol, time, {mean('close', 20)} AS sma, CASE WHEN n >= 20 THEN sum(close) {last(20)} END AS total, CASE WHEN n >= 20 THEN (sum(close * volume) {last(20)}) / (sum(volume) {last(20)}) END AS vwma,
CASE WHEN n >= 20 THEN stddev_pop(close) {last(20)} END AS sd, CASE WHEN n >= 20 THEN var_samp(close) {last(20)} END AS var FROM b)
SELECT symbol, time, round(sma, 6) AS sma, round(total, 6) AS total, round(vwma, 8) AS vwma, round(sd, 6) AS stdev, round(var, 6) AS variance, round(sma + 2 * sd, 6) AS upper, round(sma - 2 * sd, 6) AS lower, round(400 * sd / sma, 6) AS bbw FROM s""")
def ta_averages(spark, sf_dir):
    c = hourly(spark, sf_dir)
    basis, upper, lower = ta.bb(c.close, 20, 2.0)
    return rounded(c.select(sma=basis, total=ta.sum(c.close, 20), vwma=ta.vwma(c.close, 20), stdev=ta.stdev(c.close, 20), variance=ta.variance(c.close, 20, False), upper=upper, lower=lower, bbw=ta.bbw(c.close, 20, 2.0)), vwma=8)


@query(f"""WITH {BARS}, x AS (SELECT *, CASE WHEN n % 7 <> 0 THEN close END AS x FROM b), c AS (SELECT *, count(x) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS k FROM x),
m AS (SELECT symbol, time, CASE WHEN k >= 10 THEN avg(x) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS v FROM c WHERE x IS NOT NULL)
SELECT c.symbol, c.time, round(last_value(v IGNORE NULLS) OVER (PARTITION BY c.symbol ORDER BY c.time ROWS UNBOUNDED PRECEDING), 6) AS sma_na, round(last_value(x IGNORE NULLS) OVER (PARTITION BY c.symbol ORDER BY c.time ROWS UNBOUNDED PRECEDING), 6) AS fixnan FROM c LEFT JOIN m USING (symbol, time)""")
def ta_sma_with_na(spark, sf_dir):
    c = hourly(spark, sf_dir)
    x = c.close.map(lambda v, i: F.when((i + 1) % 7 != 0, v), c.bar_index)
    return rounded(c.select(sma_na=ta.sma(x, 10), fixnan=ta.fixnan(x)))


def weighted(x: str, weights: list[float]) -> str:
    n = len(weights)
    return "(" + " + ".join(f"{w!r} * lag({x}, {n - 1 - i}) OVER ({OVER})" for i, w in enumerate(weights)) + ")"


@query(f"""WITH {BARS}, w AS (SELECT *, {weighted('close', [float(i) for i in range(1, 10)])} / 45 AS w9, {weighted('close', [1.0, 2.0, 3.0, 4.0])} / 10 AS w4 FROM b), r AS (SELECT *, 2 * w4 - w9 AS raw FROM w)
SELECT symbol, time, round(w9, 6) AS wma, round({weighted('raw', [1.0, 2.0, 3.0])} / 6, 6) AS hma, round({weighted('close', [1 / 6, 2 / 6, 2 / 6, 1 / 6])}, 6) AS swma FROM r""")
def ta_weighted(spark, sf_dir):
    c = hourly(spark, sf_dir)
    return rounded(c.select(wma=ta.wma(c.close, 9), hma=ta.hma(c.close, 9), swma=ta.swma(c.close)))


def alma_weights(n: int, offset: float, sigma: float) -> list[float]:
    import math

    raw = [math.exp(-((i - offset * (n - 1)) ** 2) / (2 * (n / sigma) ** 2)) for i in range(n)]
    return [w / math.fsum(raw) for w in raw]


@query(f"WITH {BARS} SELECT symbol, time, round({weighted('close', alma_weights(9, 0.85, 6.0))}, 6) AS alma FROM b")
def ta_alma(spark, sf_dir):
    c = hourly(spark, sf_dir)
    return rounded(c.select(alma=ta.alma(c.close, 9)))


@query(f"""WITH {BARS}, h AS (SELECT *, max(high) {last(10)} AS hh, min(low) {last(10)} AS ll, max(close) {last(10)} AS hc, min(close) {last(10)} AS lc, list(close) {last(10)} AS l FROM b)
SELECT symbol, time, CASE WHEN n >= 10 THEN hh END AS highest, CASE WHEN n >= 10 THEN ll END AS lowest, CASE WHEN n >= 10 THEN (list_position(l, hc) - 10)::BIGINT END AS highestbars, CASE WHEN n >= 10 THEN (list_position(l, lc) - 10)::BIGINT END AS lowestbars,
CASE WHEN n >= 10 THEN hc - lc END AS range, round(CASE WHEN n >= 10 THEN 100 * (close - ll) / nullif(hh - ll, 0) END, 6) AS stoch, round(CASE WHEN n >= 10 THEN 100 * (close - hh) / nullif(hh - ll, 0) END, 6) AS wpr, max(close) {ALL} AS max, min(close) {ALL} AS min FROM h""")
def ta_extremes(spark, sf_dir):
    c = hourly(spark, sf_dir)
    df = c.select(highest=ta.highest(c.high, 10), lowest=ta.lowest(c.low, 10), highestbars=ta.highestbars(c.close, 10), lowestbars=ta.lowestbars(c.close, 10), range=ta.range(c.close, 10), stoch=ta.stoch(c.close, c.high, c.low, 10), wpr=ta.wpr(c, 10), max=ta.max(c.close), min=ta.min(c.close))
    return df.withColumns({n: F.round(n, 6) for n in ("stoch", "wpr")})


@query(f"""WITH {BARS}, d AS (SELECT *, close - lag(close) OVER ({OVER}) AS d, lag(close, 5) OVER ({OVER}) AS c5 FROM b), u AS (SELECT *, CASE WHEN d > 1e-10 THEN 1 ELSE 0 END AS up, CASE WHEN d < -1e-10 THEN 1 ELSE 0 END AS dn,
volume * CASE WHEN d <= 1e-10 THEN 0 ELSE close END AS mu, volume * CASE WHEN d >= -1e-10 THEN 0 ELSE close END AS md FROM d),
s AS (SELECT *, sum(CASE WHEN d >= 0 THEN d ELSE 0 END) {last(14)} AS su, sum(CASE WHEN d < 0 THEN -d ELSE 0 END) {last(14)} AS sd, sum(mu) {last(14)} AS smu, sum(md) {last(14)} AS smd FROM u)
SELECT symbol, time, round(d, 6) AS change, round(close - c5, 6) AS mom, round(100 * (close - c5) / nullif(c5, 0), 6) AS roc, round(sum(close) {ALL}, 4) AS cum, n >= 3 AND sum(up) {last(3)} = 3 AS rising, n >= 3 AND sum(dn) {last(3)} = 3 AS falling,
round(CASE WHEN n > 14 THEN 100 * (su - sd) / nullif(su + sd, 0) END, 6) AS cmo, round(CASE WHEN n >= 14 THEN CASE WHEN smd = 0 THEN 100 ELSE 100 - 100 / (1 + smu / smd) END END, 6) AS mfi FROM s""")
def ta_momentum(spark, sf_dir):
    c = hourly(spark, sf_dir)
    df = c.select(change=ta.change(c.close), mom=ta.mom(c.close, 5), roc=ta.roc(c.close, 5), cum=ta.cum(c.close), rising=ta.rising(c.close, 3), falling=ta.falling(c.close, 3), cmo=ta.cmo(c.close, 14), mfi=ta.mfi(c.close, 14))
    return rounded(df).withColumn("cum", F.round("cum", 4))


CROSS = f"""{BARS}, m AS (SELECT *, {mean('close', 5)} AS f, {mean('close', 20)} AS s FROM b), p AS (SELECT *, lag(f) OVER ({OVER}) AS pf, lag(s) OVER ({OVER}) AS ps FROM m),
x AS (SELECT *, coalesce(f > s AND pf <= ps, false) AS up, coalesce(f < s AND pf >= ps, false) AS dn FROM p)"""


@query(f"""WITH {CROSS} SELECT symbol, time, up AS crossover, dn AS crossunder, up OR dn AS crossed, (n - 1 - max(CASE WHEN up THEN n - 1 END) {ALL})::BIGINT AS since, last_value(CASE WHEN up THEN close END IGNORE NULLS) {ALL} AS value0 FROM x""")
def ta_crosses(spark, sf_dir):
    c = hourly(spark, sf_dir)
    fast, slow = ta.sma(c.close, 5), ta.sma(c.close, 20)
    up = ta.crossover(fast, slow)
    return c.select(crossover=up, crossunder=ta.crossunder(fast, slow), crossed=ta.cross(fast, slow), since=ta.barssince(up), value0=ta.valuewhen(up, c.close, 0))


@query(f"""WITH {CROSS}, o AS (SELECT symbol, time, close, lag(close, 2) OVER ({OVER}) AS v FROM x WHERE up) SELECT x.symbol, x.time, last_value(CASE WHEN up THEN coalesce(o.v, -1) END IGNORE NULLS) OVER (PARTITION BY x.symbol ORDER BY x.time ROWS UNBOUNDED PRECEDING) AS value2 FROM x LEFT JOIN o USING (symbol, time)""")
def ta_valuewhen(spark, sf_dir):
    c = hourly(spark, sf_dir)
    up = ta.crossover(ta.sma(c.close, 5), ta.sma(c.close, 20))
    value = ta.valuewhen(up, c.close, 2)
    ever = up.window(lambda x: F.max(x).over(c.over(0)))
    return c.select(value2=value.map(lambda v, e: F.when(e, F.coalesce(v, F.lit(-1.0))), ever))


@query(f"""WITH {BARS}, d AS (SELECT *, lag(close) OVER ({OVER}) AS c1 FROM b), e AS (SELECT *, close - c1 AS d, coalesce((2 * close - low - high) / nullif(high - low, 0) * volume, 0) AS flow,
CASE WHEN close > c1 THEN close - least(low, c1) WHEN close < c1 THEN close - greatest(high, c1) WHEN c1 IS NOT NULL THEN 0 END AS gain FROM d)
SELECT symbol, time, round(sum(flow) {ALL}, 5) AS accdist, round((2 * close - high - low) / nullif((high - low) * volume, 0), 6) AS iii, round((close - open) / nullif(high - low, 0) * volume, 6) AS wvad,
CASE WHEN n > 1 THEN sum(sign(d) * volume) {ALL} END AS obv, round(CASE WHEN n > 1 THEN sum(d / nullif(c1, 0) * volume) {ALL} END, 5) AS pvt, round(CASE WHEN n > 1 THEN sum(gain) {ALL} END, 5) AS wad,
round(CASE WHEN c1 IS NULL THEN NULL ELSE greatest(high - low, abs(high - c1), abs(low - c1)) END, 6) AS tr FROM e""")
def ta_volume(spark, sf_dir):
    c = hourly(spark, sf_dir)
    df = c.select(accdist=ta.accdist(c), iii=ta.iii(c), wvad=ta.wvad(c), obv=ta.obv(c), pvt=ta.pvt(c), wad=ta.wad(c), tr=ta.tr(c))
    return df.select(*(F.round(n, 5 if n in ("accdist", "pvt", "wad") else 6).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


@query(f"""WITH {BARS}, l AS (SELECT *, list_sort(list(close) {last(20)}) AS s, list(close) {last(21)} AS p, list(round(close)) {last(20)} AS r FROM b)
SELECT symbol, time, round(CASE WHEN n >= 20 THEN (s[10] + s[11]) / 2 END, 6) AS median, CASE WHEN n >= 20 THEN s[6] END AS nearest_rank, round(CASE WHEN n >= 20 THEN s[6] * 0.5 + s[7] * 0.5 END, 6) AS linear,
CASE WHEN n >= 21 THEN (len(list_filter(p, lambda x: x - close <= 1e-10)) - 1) * 100.0 / 20 END AS percentrank,
CASE WHEN n >= 20 THEN list_sort(list_transform(list_distinct(r), lambda v: {{'c': -len(list_filter(r, lambda q: q = v)), 'v': v}}))[1].v END AS mode FROM l""")
def ta_percentiles(spark, sf_dir):
    c = hourly(spark, sf_dir)
    whole = c.close.map(lambda x: F.floor(x + 0.5).cast("double"))
    df = c.select(median=ta.median(c.close, 20), nearest_rank=ta.percentile_nearest_rank(c.close, 20, 30.0), linear=ta.percentile_linear_interpolation(c.close, 20, 30.0), percentrank=ta.percentrank(c.close, 20), mode=ta.mode(whole, 20))
    return df.withColumns({n: F.round(n, 6) for n in ("median", "linear")})


@query(f"""WITH {BARS}, l AS (SELECT *, list(close) {last(20)} AS a, avg(close) {last(20)} AS m, regr_slope(close, n) {last(20)} AS sl, corr(close, volume) {last(20)} AS r, stddev_pop(volume) {last(20)} AS sv FROM b),
d AS (SELECT *, list_sum(list_transform(a, lambda x: abs(x - m))) / 20 AS dev FROM l)
SELECT symbol, time, round(CASE WHEN n >= 20 THEN dev END, 6) AS dev, round(CASE WHEN n >= 20 THEN (close - m) / nullif(0.015 * dev, 0) END, 5) AS cci, round(CASE WHEN n >= 20 THEN m + sl * (19 - 9.5) END, 5) AS linreg,
round(CASE WHEN n >= 20 THEN CASE WHEN sv < 1e-9 THEN 0 ELSE r END END, 5) AS correlation, round(CASE WHEN n >= 20 THEN -list_sum(list_transform(a, lambda x, i: x * (21 - i))) / nullif(list_sum(a), 0) END, 5) AS cog FROM d""")
def ta_regression(spark, sf_dir):
    c = hourly(spark, sf_dir)
    df = c.select(dev=ta.dev(c.close, 20), cci=ta.cci(c.close, 20), linreg=ta.linreg(c.close, 20), correlation=ta.correlation(c.close, c.volume, 20), cog=ta.cog(c.close, 20))
    return df.select(*(F.round(n, 6 if n == "dev" else 5).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


@query(f"""WITH {BARS}, l AS (SELECT *, list(close) {last(8)} AS a FROM b), r AS (SELECT *, list_transform(a, lambda e: len(list_filter(a, lambda o: o - e >= 1e-10)) + (len(list_filter(a, lambda o: abs(o - e) < 1e-10)) - 1) / 2.0) AS k FROM l),
v AS (SELECT *, list_sum(list_transform(k, lambda e, i: (8 - i - 3.5) * (e - 3.5))) / 8 AS cov, list_sum(list_transform(k, lambda e: e * e)) / 8 - 12.25 AS vy FROM r) SELECT symbol, time, round(CASE WHEN n > 8 AND vy > 0 THEN 100 * cov / sqrt(vy * 5.25) END, 6) AS rci FROM v""")
def ta_rci(spark, sf_dir):
    c = hourly(spark, sf_dir)
    return rounded(c.select(rci=ta.rci(c.close, 8)))


@query(f"""WITH {BARS}, l AS (SELECT *, max(high) {last(8)} AS m, min(low) {last(8)} AS w, list(high) {last(8)} AS hs, list(low) {last(8)} AS ls FROM b)
SELECT symbol, time, CASE WHEN n >= 8 AND hs[6] = m AND len(list_filter(hs[7:8], lambda x: x = m)) = 0 THEN m END AS pivothigh, CASE WHEN n >= 8 AND ls[6] = w AND len(list_filter(ls[7:8], lambda x: x = w)) = 0 THEN w END AS pivotlow FROM l""")
def ta_pivots(spark, sf_dir):
    c = hourly(spark, sf_dir)
    return c.select(pivothigh=ta.pivothigh(c.high, 5, 2), pivotlow=ta.pivotlow(c.low, 5, 2))


@query(f"""WITH {BARS}, g AS (SELECT *, date_trunc('day', time) AS d FROM b), p AS (SELECT symbol, d, arg_min(open, time) AS o, max(high) AS h, min(low) AS l, arg_max(close, time) AS c FROM g GROUP BY 1, 2),
q AS (SELECT symbol, d, lag(h) OVER w AS h, lag(l) OVER w AS l, lag(c) OVER w AS c FROM p WINDOW w AS (PARTITION BY symbol ORDER BY d))
SELECT g.symbol, g.time, round((q.h + q.l + q.c) / 3, 6) AS p, round(2 * (q.h + q.l + q.c) / 3 - q.l, 6) AS r1, round(2 * (q.h + q.l + q.c) / 3 - q.h, 6) AS s1, round(q.c + (q.h - q.l) * 1.1 / 12, 6) AS camarilla_r1,
round(sum(close * volume) OVER w / sum(volume) OVER w, 8) AS vwap FROM g LEFT JOIN q ON g.symbol = q.symbol AND g.d = q.d WINDOW w AS (PARTITION BY g.symbol, g.d ORDER BY g.time ROWS UNBOUNDED PRECEDING)""")
def ta_anchored(spark, sf_dir):
    c = hourly(spark, sf_dir)
    day = c.time.window(lambda t: F.date_trunc("day", t) != F.coalesce(F.date_trunc("day", F.lag(t).over(c.over())), F.lit("1900-01-01").cast("timestamp")))
    levels, other = ta.pivot_point_levels(c, "Traditional", day), ta.pivot_point_levels(c, "Camarilla", day)
    return rounded(c.select(p=levels.map(lambda a: a[0]), r1=levels.map(lambda a: a[1]), s1=levels.map(lambda a: a[2]), camarilla_r1=other.map(lambda a: a[1]), vwap=ta.vwap(c.close, day)), vwap=8)


# -- recursive indicators ----------------------------------------------------------------------------------------------------


def smooth(name: str, source: str, x: str, n: int, alpha: str) -> str:
    """CTEs of an average seeded with the mean of the first n values of x (null only at the start) in ``source``."""
    return f"""{name}_x AS (SELECT symbol, time, x, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k FROM (SELECT symbol, time, {x} AS x FROM {source}) WHERE x IS NOT NULL),
{name}(symbol, k, v) AS (SELECT symbol, {n}::BIGINT, avg(x) FROM {name}_x WHERE k <= {n} GROUP BY symbol HAVING count(*) = {n}
UNION ALL SELECT p.symbol, p.k + 1, p.v + {alpha} * (q.x - p.v) FROM {name} p JOIN {name}_x q ON q.symbol = p.symbol AND q.k = p.k + 1),
{name}_t AS (SELECT q.symbol, q.time, p.v FROM {name} p JOIN {name}_x q ON q.symbol = p.symbol AND q.k = p.k)"""


DIFF = f"dd AS (SELECT *, lag(close) OVER ({OVER}) AS c1 FROM b)"


@query(f"""WITH RECURSIVE {BARS}, {DIFF}, {smooth('e', 'b', 'close', 12, '(2.0::DOUBLE / 13)')}, {smooth('r', 'b', 'close', 14, '(1.0::DOUBLE / 14)')},
{smooth('a', 'dd', 'CASE WHEN c1 IS NULL THEN high - low ELSE greatest(high - low, abs(high - c1), abs(low - c1)) END', 14, '(1.0::DOUBLE / 14)')}
SELECT b.symbol, b.time, round(e_t.v, 6) AS ema, round(r_t.v, 6) AS rma, round(a_t.v, 6) AS atr FROM b LEFT JOIN e_t USING (symbol, time) LEFT JOIN r_t USING (symbol, time) LEFT JOIN a_t USING (symbol, time)""")
def fold_averages(spark, sf_dir):
    c = hourly(spark, sf_dir)
    return rounded(c.select(ema=ta.ema(c.close, 12), rma=ta.rma(c.close, 14), atr=ta.atr(c, 14)))


@query(f"""WITH RECURSIVE {BARS}, {DIFF}, {smooth('u', 'dd', 'greatest(close - c1, 0) + 0 * c1', 14, '(1.0::DOUBLE / 14)')}, {smooth('d', 'dd', 'greatest(c1 - close, 0) + 0 * c1', 14, '(1.0::DOUBLE / 14)')}
SELECT b.symbol, b.time, round(CASE WHEN d_t.v = 0 THEN 100 ELSE 100 - 100 / (1 + u_t.v / d_t.v) END, 6) AS rsi FROM b LEFT JOIN u_t USING (symbol, time) LEFT JOIN d_t USING (symbol, time)""")
def fold_rsi(spark, sf_dir):
    c = hourly(spark, sf_dir)
    return rounded(c.select(rsi=ta.rsi(c.close, 14)))


@query(f"""WITH RECURSIVE {BARS}, {smooth('f', 'b', 'close', 12, '(2.0::DOUBLE / 13)')}, {smooth('s', 'b', 'close', 26, '(2.0::DOUBLE / 27)')}, m AS (SELECT symbol, time, f_t.v - s_t.v AS line FROM f_t JOIN s_t USING (symbol, time)),
{smooth('g', 'm', 'line', 9, '(2.0::DOUBLE / 10)')} SELECT b.symbol, b.time, round(m.line, 6) AS macd, round(g_t.v, 6) AS signal, round(m.line - g_t.v, 6) AS hist FROM b LEFT JOIN m USING (symbol, time) LEFT JOIN g_t USING (symbol, time)""")
def fold_macd(spark, sf_dir):
    c = hourly(spark, sf_dir)
    line, signal, hist = ta.macd(c.close, 12, 26, 9)
    return rounded(c.select(macd=line, signal=signal, hist=hist))


@query(f"""WITH RECURSIVE {BARS}, {DIFF}, {smooth('m', 'b', 'close', 20, '(2.0::DOUBLE / 21)')}, {smooth('w', 'dd', 'CASE WHEN c1 IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) END', 20, '(2.0::DOUBLE / 21)')}
SELECT b.symbol, b.time, round(m_t.v, 6) AS basis, round(m_t.v + 2 * w_t.v, 6) AS upper, round(m_t.v - 2 * w_t.v, 6) AS lower, round(4 * w_t.v / m_t.v, 6) AS kcw FROM b LEFT JOIN m_t USING (symbol, time) LEFT JOIN w_t USING (symbol, time)""")
def fold_keltner(spark, sf_dir):
    c = hourly(spark, sf_dir)
    basis, upper, lower = ta.kc(c.close, 20, 2.0)
    return rounded(c.select(basis=basis, upper=upper, lower=lower, kcw=ta.kcw(c.close, 20, 2.0)))


@query(f"""WITH RECURSIVE {BARS}, {DIFF}, {smooth('a', 'dd', 'close - c1', 26, '(2.0::DOUBLE / 27)')}, {smooth('c', 'dd', 'abs(close - c1)', 26, '(2.0::DOUBLE / 27)')}, {smooth('a2', 'a_t', 'v', 12, '(2.0::DOUBLE / 13)')}, {smooth('c2', 'c_t', 'v', 12, '(2.0::DOUBLE / 13)')}
SELECT b.symbol, b.time, round(a2_t.v / c2_t.v, 6) AS tsi FROM b LEFT JOIN a2_t USING (symbol, time) LEFT JOIN c2_t USING (symbol, time)""")
def fold_tsi(spark, sf_dir):
    c = hourly(spark, sf_dir)
    return rounded(c.select(tsi=ta.tsi(c.close, 12, 26)))


@query(f"""WITH RECURSIVE {BARS}, h(symbol, n, o, c) AS (SELECT symbol, n, (open + close) / 2, (open + high + low + close) / 4 FROM b WHERE n = 1 UNION ALL SELECT b.symbol, b.n, (h.o + h.c) / 2, (b.open + b.high + b.low + b.close) / 4 FROM h JOIN b ON b.symbol = h.symbol AND b.n = h.n + 1),
v(symbol, n, nvi, pvi) AS (SELECT symbol, n, 1.0::DOUBLE, 1.0::DOUBLE FROM b WHERE n = 1 UNION ALL SELECT b.symbol, b.n, v.nvi * CASE WHEN b.volume < p.volume AND p.close <> 0 THEN 1 + (b.close - p.close) / p.close ELSE 1 END, v.pvi * CASE WHEN b.volume > p.volume AND p.close <> 0 THEN 1 + (b.close - p.close) / p.close ELSE 1 END FROM v JOIN b ON b.symbol = v.symbol AND b.n = v.n + 1 JOIN b p ON p.symbol = v.symbol AND p.n = v.n)
SELECT b.symbol, b.time, round(h.o, 6) AS ha_open, round(greatest(b.high, h.o, h.c), 6) AS ha_high, round(least(b.low, h.o, h.c), 6) AS ha_low, round(h.c, 6) AS ha_close, CASE WHEN v.nvi > 0 THEN round(ln(v.nvi), 6) END AS nvi, CASE WHEN v.pvi > 0 THEN round(ln(v.pvi), 6) END AS pvi FROM b JOIN h USING (symbol, n) JOIN v USING (symbol, n)""")
def fold_bars(spark, sf_dir):
    c = hourly(spark, sf_dir)
    o, h, low, close = ta.heikinashi(c)
    ln = lambda x: F.when(x > 0, F.ln(x))
    return rounded(c.select(ha_open=o, ha_high=h, ha_low=low, ha_close=close, nvi=ta.nvi(c).map(ln), pvi=ta.pvi(c).map(ln)))


MOVES = f"""mv AS (SELECT *, high - lag(high) OVER ({OVER}) AS u, lag(low) OVER ({OVER}) - low AS d FROM dd), mp AS (SELECT *, CASE WHEN u - d > 1e-10 AND u > 1e-10 THEN u WHEN u IS NOT NULL THEN 0 END AS p, CASE WHEN d - u > 1e-10 AND d > 1e-10 THEN d WHEN d IS NOT NULL THEN 0 END AS m,
CASE WHEN c1 IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS t, greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0)) AS t0 FROM mv)"""


@query(f"""WITH RECURSIVE {BARS}, {DIFF}, {MOVES}, {smooth('r', 'mp', 't', 14, '(1.0::DOUBLE / 14)')}, {smooth('p', 'mp', 'p', 14, '(1.0::DOUBLE / 14)')}, {smooth('m', 'mp', 'm', 14, '(1.0::DOUBLE / 14)')},
di AS (SELECT b.symbol, b.time, 100 * p_t.v / nullif(r_t.v, 0) AS plus, 100 * m_t.v / nullif(r_t.v, 0) AS minus FROM b LEFT JOIN r_t USING (symbol, time) LEFT JOIN p_t USING (symbol, time) LEFT JOIN m_t USING (symbol, time)), dx AS (SELECT *, abs(plus - minus) / CASE WHEN plus + minus = 0 THEN 1 ELSE plus + minus END AS x FROM di),
{smooth('x', 'dx', 'x', 14, '(1.0::DOUBLE / 14)')} SELECT di.symbol, di.time, round(plus, 6) AS plus, round(minus, 6) AS minus, round(100 * x_t.v, 6) AS adx FROM di LEFT JOIN x_t USING (symbol, time)""")
def fold_dmi(spark, sf_dir):
    c = hourly(spark, sf_dir)
    plus, minus, adx = ta.dmi(c, 14, 14)
    return rounded(c.select(plus=plus, minus=minus, adx=adx))


#: The stop and reverse as a recursion over bars: side, factor, stop and extreme of the bar before, and the two bars before.
SAR = """w AS (SELECT symbol, time, n, high, low, lag(high) OVER v AS h1, lag(low) OVER v AS l1, lag(high, 2) OVER v AS h2, lag(low, 2) OVER v AS l2 FROM b WINDOW v AS (PARTITION BY symbol ORDER BY n)),
s(symbol, n, up, af, sar, ep) AS (SELECT symbol, n, h1 <= high, 0.02::DOUBLE, CASE WHEN h1 <= high THEN l1 ELSE h1 END, CASE WHEN h1 <= high THEN high ELSE low END FROM w WHERE n = 2 UNION ALL
SELECT symbol, n, CASE WHEN turned THEN NOT up ELSE up END, CASE WHEN turned THEN 0.02 WHEN up AND high > ep OR NOT up AND low < ep THEN least(af + 0.02, 0.2) ELSE af END,
CASE WHEN turned AND up THEN greatest(ep, high, h1, h2) WHEN turned THEN least(ep, low, l1, l2) WHEN up THEN least(x, l1, l2) ELSE greatest(x, h1, h2) END, CASE WHEN turned AND up THEN low WHEN turned THEN high WHEN up THEN greatest(ep, high) ELSE least(ep, low) END
FROM (SELECT w.*, s.up, s.af, s.ep, s.sar + s.af * (s.ep - s.sar) AS x, CASE WHEN s.up THEN w.low <= s.sar + s.af * (s.ep - s.sar) ELSE w.high >= s.sar + s.af * (s.ep - s.sar) END AS turned FROM s JOIN w ON w.symbol = s.symbol AND w.n = s.n + 1))"""


@query(f"WITH RECURSIVE {BARS}, {SAR} SELECT b.symbol, b.time, round(s.sar, 6) AS sar FROM b LEFT JOIN s USING (symbol, n)")
def fold_sar(spark, sf_dir):
    c = hourly(spark, sf_dir)
    return rounded(c.select(sar=ta.sar(c)))


#: Bands around the middle, each kept while it would move away from the price; the line is the band of the current direction.
SUPERTREND = """k AS (SELECT d.symbol, d.n, (high + low) / 2 + 3 * a_t.v AS up0, (high + low) / 2 - 3 * a_t.v AS lo0, d.close, row_number() OVER (PARTITION BY d.symbol ORDER BY d.n) AS i FROM mp d JOIN a_t USING (symbol, time) WHERE a_t.v IS NOT NULL),
st(symbol, i, n, lo, up, close, way, line) AS (SELECT symbol, i, n, lo0, up0, close, 1, up0 FROM k WHERE i = 1 UNION ALL SELECT symbol, i, n, lo, up, close, way, CASE WHEN way = 1 THEN up ELSE lo END FROM (SELECT *, CASE WHEN was_up THEN CASE WHEN close > up THEN -1 ELSE 1 END ELSE CASE WHEN close < lo THEN 1 ELSE -1 END END AS way
FROM (SELECT k.symbol, k.i, k.n, k.close, CASE WHEN k.lo0 > st.lo OR st.close < st.lo THEN k.lo0 ELSE st.lo END AS lo, CASE WHEN k.up0 < st.up OR st.close > st.up THEN k.up0 ELSE st.up END AS up, st.line = st.up AS was_up FROM st JOIN k ON k.symbol = st.symbol AND k.i = st.i + 1)))"""


@query(f"""WITH RECURSIVE {BARS}, {DIFF}, {MOVES}, {smooth('a', 'mp', 't0', 10, '(1.0::DOUBLE / 10)')}, {SUPERTREND} SELECT b.symbol, b.time, CASE WHEN b.n = 1 THEN 0.0 ELSE round(st.line, 6) END AS line, CASE WHEN st.way IS NULL THEN 1.0 ELSE st.way::DOUBLE END AS direction FROM b LEFT JOIN st ON st.symbol = b.symbol AND st.n = b.n""")
def fold_supertrend(spark, sf_dir):
    c = hourly(spark, sf_dir)
    line, way = ta.supertrend(c, 3.0, 10)
    return rounded(c.select(line=line, direction=way))


@query(f"""WITH RECURSIVE {BARS}, g(i, s) AS (SELECT 0::BIGINT, xor(7::HUGEINT, 25214903917::HUGEINT) UNION ALL SELECT i + 1, (s * 25214903917 + 11) % 281474976710656 FROM g WHERE i < 2 * (SELECT max(n) FROM b)),
v AS (SELECT a.i // 2 + 1 AS n, ((a.s >> 22) * 134217728 + (z.s >> 21))::DOUBLE / 9007199254740992 AS random FROM g a JOIN g z ON z.i = a.i + 1 WHERE a.i % 2 = 1) SELECT symbol, time, round(random, 9) AS random FROM b JOIN v USING (n)""")
def fold_random(spark, sf_dir):
    """Seeded random numbers, the same for every symbol."""
    c = hourly(spark, sf_dir)
    return rounded(c.select(random=ta.random(c, seed=7)), 9)


@query(f"""WITH RECURSIVE {BARS}, h(symbol, n, o, c) AS (SELECT symbol, n, (open + close) / 2, (open + high + low + close) / 4 FROM b WHERE n = 1 UNION ALL SELECT b.symbol, b.n, (h.o + h.c) / 2, (b.open + b.high + b.low + b.close) / 4 FROM h JOIN b ON b.symbol = h.symbol AND b.n = h.n + 1)
SELECT b.symbol, b.time, round(h.o, 6) AS ha_open, round(greatest(b.high, h.o, h.c), 6) AS ha_high, round(least(b.low, h.o, h.c), 6) AS ha_low, round(h.c, 6) AS ha_close FROM b JOIN h USING (symbol, n)""")
def fold_heikinashi(spark, sf_dir):
    c = hourly(spark, sf_dir)
    o, h, low, close = ta.heikinashi(c)
    return rounded(c.select(ha_open=o, ha_high=h, ha_low=low, ha_close=close))


@query(f"""WITH RECURSIVE {BARS}, f(symbol, n, v) AS (SELECT symbol, n, close FROM b WHERE n = 1 UNION ALL SELECT b.symbol, b.n, 0.9::DOUBLE * f.v + 0.1::DOUBLE * b.close FROM f JOIN b ON b.symbol = f.symbol AND b.n = f.n + 1) SELECT b.symbol, b.time, round(f.v, 6) AS smoothed FROM b JOIN f USING (symbol, n)""")
def fold_user(spark, sf_dir):
    c = hourly(spark, sf_dir)

    def step(state, x):
        v = x if state is None else 0.9 * state + 0.1 * x
        return v, v

    return rounded(c.select(smoothed=ta.fold(c, lambda: None, step, c.close)))


# -- scalar functions --------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, abs(c_acctbal) AS abs, ceil(c_acctbal)::BIGINT AS ceil, floor(c_acctbal)::BIGINT AS floor, sign(c_acctbal)::DOUBLE AS sign, round(sqrt(abs(c_acctbal)), 6) AS sqrt, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS sqrt_na,
CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS log, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS log10, round(sin(c_acctbal), 6) AS sin, round(cos(c_acctbal), 6) AS cos, round(tan(c_custkey / 1000.0), 6) AS tan, round(atan(c_acctbal), 6) AS atan,
round(asin(c_custkey / 1e6), 6) AS asin, round(acos(c_custkey / 1e6), 6) AS acos, round(exp(c_acctbal / 10000), 6) AS exp, round(c_acctbal * c_acctbal, 3) AS pow2, round(degrees(c_acctbal), 4) AS degrees, round(radians(c_acctbal), 6) AS radians, round((c_acctbal + c_custkey + c_nationkey) / 3, 6) AS avg,
greatest(c_acctbal, c_custkey::DOUBLE) AS max, least(c_acctbal, c_custkey::DOUBLE) AS min, (sign(c_acctbal) * floor(abs(c_acctbal) + 0.5 + 1e-10))::BIGINT AS round, round(floor(c_acctbal / 0.25 + 0.5) * 0.25, 6) AS mintick, CASE WHEN c_nationkey > 0 THEN round(c_acctbal / c_nationkey, 6) END AS safe_div,
trunc(c_acctbal)::BIGINT AS cast_int, abs(c_acctbal) > 1e-10 AS truth FROM customer""")
def scalar_math(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    x, k, n = F.col("c_acctbal"), F.col("c_custkey"), F.col("c_nationkey")
    r = lambda e, d=6: F.round(e, d)
    return c.select(
        "c_custkey", fmath.abs(x).alias("abs"), fmath.ceil(x).alias("ceil"), fmath.floor(x).alias("floor"), fmath.sign(x).alias("sign"), r(fmath.sqrt(F.abs(x))).alias("sqrt"), r(fmath.sqrt(x)).alias("sqrt_na"), r(fmath.log(x)).alias("log"), r(fmath.log10(x)).alias("log10"),
        r(fmath.sin(x)).alias("sin"), r(fmath.cos(x)).alias("cos"), r(fmath.tan(k / 1000.0)).alias("tan"), r(fmath.atan(x)).alias("atan"), r(fmath.asin(k / 1e6)).alias("asin"), r(fmath.acos(k / 1e6)).alias("acos"), r(fmath.exp(x / 10000)).alias("exp"), r(fmath.pow(x, 2), 3).alias("pow2"),
        r(fmath.todegrees(x), 4).alias("degrees"), r(fmath.toradians(x)).alias("radians"), r(fmath.avg(x, k, n)).alias("avg"), fmath.max(x, k.cast("double")).alias("max"), fmath.min(x, k.cast("double")).alias("min"), fmath.round(x).alias("round"), r(fmath.round_to_mintick(x, 0.25)).alias("mintick"),
        r(na.safe_div(x, n)).alias("safe_div"), na.cast_int(x).alias("cast_int"), na.truth(x).alias("truth"),
    )


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'NaN'::DOUBLE WHEN c_custkey % 5 = 2 THEN 'inf'::DOUBLE ELSE c_acctbal END AS v FROM customer)
SELECT c_custkey, c_custkey % 5 < 3 AS is_na, CASE WHEN c_custkey % 5 < 3 THEN 0 ELSE v END AS nz, CASE WHEN c_custkey % 5 < 3 THEN 2 ELSE v END AS nz2, CASE WHEN c_custkey % 5 < 3 THEN NULL ELSE v END AS finite, coalesce(c_custkey % 5 >= 3 AND v > 100, false) AS above FROM x""")
def scalar_na(spark, sf_dir):
    m = F.col("c_custkey") % 5
    v = F.when(m == 0, F.lit(None).cast("double")).when(m == 1, F.lit(float("nan"))).when(m == 2, F.lit(float("inf"))).otherwise(F.col("c_acctbal"))
    x = table(spark, sf_dir, "customer").select("c_custkey", v.alias("v"))
    c = F.col("v")
    return x.select("c_custkey", na.is_na(c).alias("is_na"), na.nz(c).alias("nz"), na.nz(c, 2.0).alias("nz2"), na.finite(c).alias("finite"), na.tgt(na.finite(c), F.lit(100.0)).alias("above"))


@query("""SELECT p_partkey, contains(p_name, 'a') AS contains, p_type LIKE 'S%' AS startswith, p_type LIKE '%L' AS endswith, length(p_name) AS length, lower(p_type) AS lower, upper(p_name) AS upper, replace(p_name, 'a', '__') AS replace_all, nullif(instr(p_name, 'e'), 0) - 1 AS pos, p_brand || '-' || p_brand AS repeat,
string_split(p_name, ' ') AS split, substring(p_name, 2, 3) AS substring, try_cast(p_size::VARCHAR AS DOUBLE) AS tonumber, trim('  ' || p_brand || ' ') AS trim, regexp_extract(p_name, '^(?:[a-z]+)', 0) AS match,
CASE WHEN instr(p_name, 'a') > 0 THEN CASE WHEN instr(substring(p_name, instr(p_name, 'a') + 1), 'a') > 0 THEN substring(p_name, 1, instr(p_name, 'a') + instr(substring(p_name, instr(p_name, 'a') + 1), 'a') - 1) || '@' || substring(p_name, instr(p_name, 'a') + instr(substring(p_name, instr(p_name, 'a') + 1), 'a') + 1) ELSE p_name END ELSE p_name END AS replace_second FROM part""")
def scalar_strings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return p.select(
        "p_partkey", strings.contains(n, F.lit("a")).alias("contains"), strings.startswith(t, F.lit("S")).alias("startswith"), strings.endswith(t, F.lit("L")).alias("endswith"), strings.length(n).alias("length"), strings.lower(t).alias("lower"), strings.upper(n).alias("upper"), strings.replace_all(n, "a", "__").alias("replace_all"), strings.pos(n, F.lit("e")).alias("pos"), strings.repeat(b, F.lit(2), "-").alias("repeat"),
        strings.split(n, " ").alias("split"), strings.substring(n, F.lit(1), F.lit(4)).alias("substring"), strings.tonumber(F.col("p_size").cast("string")).alias("tonumber"), strings.trim(F.concat(F.lit("  "), b, F.lit(" "))).alias("trim"), strings.match(n, "[a-z]+").alias("match"), strings.replace(n, "a", "@", 1).alias("replace_second"),
    )


@query("""SELECT p_partkey, printf('%d items', p_size) AS message, CASE WHEN p_retailprice = floor(p_retailprice) THEN printf('%d', p_retailprice::BIGINT) ELSE rtrim(rtrim(printf('%.2f', p_retailprice), '0'), '.') END AS text, printf('%.2f', p_retailprice) AS fixed FROM part""")
def scalar_format(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", strings.format("{0} items", F.col("p_size")).alias("message"), strings.tostring(F.col("p_retailprice"), "#.##").alias("text"), strings.tostring(F.col("p_retailprice"), "#.00").alias("fixed"))


@query("""SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS dayofmonth, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, weekofyear(ts)::INT AS week, (dayofweek(ts) + 1)::INT AS dayofweek, epoch_ms(date_trunc('day', ts)) AS day_open, epoch_ms(date_trunc('week', ts)::TIMESTAMP) AS week_open, epoch_ms(date_trunc('month', ts)::TIMESTAMP) AS month_open,
(floor(epoch(ts) / 14400) * 14400000)::BIGINT AS open4h, (floor(epoch(ts) / 14400) * 14400000 + 14400000)::BIGINT AS close4h, isodow(ts) < 6 AND hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) < 16 AS in_session, CASE WHEN isodow(ts) < 6 AND hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) < 16 THEN epoch_ms(date_trunc('hour', ts)) ELSE 0 END AS session_time,
epoch_ms(make_timestamp(year(ts), 1, day(ts), 3, 4, 5)) AS stamp, epoch_ms((ts + INTERVAL 7 HOUR)::DATE::TIMESTAMP) AS tradingday, strftime(ts, '%Y-%m-%d %H:%M') AS text FROM events""")
def scalar_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    t = F.col("ts")
    night = [ftime.Interval(d, "17:00", "17:00") for d in (6, 0, 1, 2, 3)]
    return e.select(
        "event_id", ftime.year(t).alias("year"), ftime.month(t).alias("month"), ftime.dayofmonth(t).alias("dayofmonth"), ftime.hour(t).alias("hour"), ftime.minute(t).alias("minute"), ftime.second(t).alias("second"), ftime.weekofyear(t).alias("week"), ftime.dayofweek(t).alias("dayofweek"), ftime.time(t, "1D").alias("day_open"), ftime.time(t, "1W").alias("week_open"), ftime.time(t, "1M").alias("month_open"),
        ftime.time(t, "240").alias("open4h"), ftime.time_close(t, "240").alias("close4h"), ftime.in_session(t, ftime.session_intervals("0930-1600:23456")).alias("in_session"), F.coalesce(ftime.time(t, "60", "0930-1600:23456"), F.lit(0)).alias("session_time"),
        ftime.timestamp(F.year(t), F.lit(1), F.dayofmonth(t), 3, 4, 5).alias("stamp"), ftime.time_tradingday(t, night).alias("tradingday"), strings.format_time(F.unix_millis(t), "yyyy-MM-dd HH:mm").alias("text"),
    )


@query(f"""WITH {BARS}, m AS (SELECT *, (isodow(time) - 1) * 1440 + hour(time) * 60 AS w FROM b) SELECT symbol, time, isodow(time) < 6 AND hour(time) = 9 AS isfirstbar, isodow(time) < 6 AND hour(time) = 15 AS islastbar, isodow(time) < 6 AND hour(time) BETWEEN 9 AND 15 AS ismarket,
coalesce(date_trunc('day', time) <> date_trunc('day', lag(time) OVER ({OVER})), false) AS new_day FROM m""")
def session_bars(spark, sf_dir):
    c = hourly(spark, sf_dir)
    s = ftime.session_intervals("0930-1600:23456")
    return c.select(isfirstbar=c.time.map(lambda t: ftime.isfirstbar(t, 3600, s)), islastbar=c.time.map(lambda t: ftime.islastbar(t, 3600, s)), ismarket=c.time.map(lambda t: ftime.ismarket(t, 3600, s)), new_day=c.time.map(lambda t, p: resample.timeframe_change(t, p, "1D"), c.time[1]))


@query("""SELECT * FROM (VALUES ('5', 300, true, '5'), ('240', 14400, true, '240'), ('1D', 86400, false, '1D'), ('2W', 1209600, false, '2W'), ('30S', 30, true, '30S'), ('1M', 2628003, false, '2628003S')) AS t(text, seconds, intraday, back)""")
def timeframes(spark, sf_dir):
    rows = [(t, timeframe.in_seconds(t), timeframe.parse(t).isintraday, timeframe.from_seconds(timeframe.in_seconds(t))) for t in ("5", "240", "1D", "2W", "30S", "1M")]
    return spark.createDataFrame(rows, "text string, seconds int, intraday boolean, back string")


@query("""WITH c AS (SELECT c_custkey, (c_custkey % 256)::INT AS r, (c_custkey * 7 % 256)::INT AS g, (c_custkey * 13 % 256)::INT AS b FROM customer) SELECT c_custkey, printf('#%02X%02X%02XFF', r, g, b) AS rgb, r, g, b, 0.0::DOUBLE AS t, printf('#%02X%02X%02X80', r, g, b) AS faded, printf('#%02X%02X%02XFF', (r + (255 - r) / 2.0)::DECIMAL(9,3) // 1, (g / 2.0)::DECIMAL(9,3) // 1, (b / 2.0)::DECIMAL(9,3) // 1) AS middle,
'NYSE:' || c_custkey AS ticker FROM (SELECT c_custkey, r, g, b FROM c)""".replace("(r + (255 - r) / 2.0)::DECIMAL(9,3) // 1", "floor(r + (255 - r) * 0.5)::INT").replace("(g / 2.0)::DECIMAL(9,3) // 1", "floor(g - g * 0.5)::INT").replace("(b / 2.0)::DECIMAL(9,3) // 1", "floor(b - b * 0.5)::INT"))
def colors_and_tickers(spark, sf_dir):
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select("c_custkey", color.rgb(k % 256, k * 7 % 256, k * 13 % 256).alias("rgb"))
    c = F.col("rgb")
    return base.select("c_custkey", "rgb", color.r(c).alias("r"), color.g(c).alias("g"), color.b(c).alias("b"), color.t(c).alias("t"), color.new(c, 50).alias("faded"), color.from_gradient(F.lit(5.0), F.lit(0.0), F.lit(10.0), c, F.lit("#FF0000FF")).alias("middle"), ticker.inherit(F.lit("NYSE:IBM"), k.cast("string")).alias("ticker"))


# -- arrays, maps, matrices --------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), s AS (SELECT *, list_sort(a) AS s, list_avg(a) AS m FROM e)
SELECT vec_id, round(list_sum(a), 6) AS sum, round(m, 6) AS avg, s[len(s)] AS max, s[len(s) - 1] AS max1, s[1] AS min, round(s[len(s)] - s[1], 6) AS range, round(CASE WHEN len(s) % 2 = 1 THEN s[len(s) // 2 + 1] ELSE (s[len(s) // 2] + s[len(s) // 2 + 1]) / 2 END, 6) AS median, round(list_var_pop(a), 9) AS variance, round(list_stddev_samp(a), 6) AS stdev,
len(list_filter(a, lambda x: abs(x - a[5]) <= 1e-10)) > 0 AS includes, list_position(a, a[5]) - 1 AS indexof, s[ceil(0.3 * len(s))::INT] AS nearest, round((len(list_filter(a, lambda x: x - a[4] <= 1e-10)) - 1) * 100.0 / (len(a) - 1), 6) AS percentrank, a[3:5] AS part, list_reverse(s)[1:2] AS top, len(list_filter(a, lambda x: x > 0)) = len(a) AS every, len(list_filter(a, lambda x: x > 0)) > 0 AS some,
round(list_sum(list_transform(a, lambda x, i: (x - m) * (s[i] - m))) / len(a), 9) AS covariance, len(list_filter(s, lambda x: x <= a[6])) - 1 AS rightmost, len(a) AS size FROM s""")
def array_functions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    e = e.withColumn("s", arrays.sort(F.col("a")))
    a, s = F.col("a"), F.col("s")
    r = lambda x: F.round(x, 6)
    return e.select(
        "vec_id", r(arrays.sum(a)).alias("sum"), r(arrays.avg(a)).alias("avg"), arrays.max(a).alias("max"), arrays.max(a, 1).alias("max1"), arrays.min(a).alias("min"), r(arrays.range(a)).alias("range"), r(arrays.median(a)).alias("median"), F.round(arrays.variance(a), 9).alias("variance"), r(arrays.stdev(a, False)).alias("stdev"),
        arrays.includes(a, arrays.get(a, 4)).alias("includes"), arrays.indexof(a, arrays.get(a, 4)).alias("indexof"), arrays.percentile_nearest_rank(a, 30.0).alias("nearest"), r(arrays.percentrank(a, 3)).alias("percentrank"), arrays.slice(a, 2, 5).alias("part"), arrays.slice(arrays.sort(a, False), 0, 2).alias("top"),
        arrays.every(F.transform(a, lambda x: x > 0)).alias("every"), arrays.some(F.transform(a, lambda x: x > 0)).alias("some"), F.round(arrays.covariance(a, s), 9).alias("covariance"), arrays.binary_search_rightmost(s, arrays.get(a, 5)).alias("rightmost"), arrays.size(a).alias("size"),
    )


@query("""WITH e AS (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS a, vec_id::DOUBLE AS v FROM embeddings) SELECT vec_id, list_append(a, v) AS push, list_prepend(v, a) AS unshift, [a[1], v, a[2], a[3]] AS insert, [a[1], a[3]] AS removed, a[2] AS taken, [a[1], v, a[3]] AS changed, [v, v, a[3]] AS filled, [a[3], a[2], a[1]] AS reversed, a || a AS twice,
[a[1], a[2]] AS popped, a[3] AS last, a[1] AS first, array_to_string([vec_id, vec_id + 1], '-') AS joined FROM e""")
def array_changes(spark, sf_dir):
    a, v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")), F.col("vec_id").cast("double")
    e = table(spark, sf_dir, "embeddings").select("vec_id", a.alias("a"), v.alias("v"))
    a, v = F.col("a"), F.col("v")
    return e.select("vec_id", arrays.push(a, v).alias("push"), arrays.unshift(a, v).alias("unshift"), arrays.insert(a, 1, v).alias("insert"), arrays.remove(a, 1)["array"].alias("removed"), arrays.remove(a, 1)["value"].alias("taken"), arrays.set(a, 1, v).alias("changed"), arrays.fill(a, v, 0, 2).alias("filled"), arrays.reverse(a).alias("reversed"), arrays.concat(a, a).alias("twice"), arrays.pop(a)["array"].alias("popped"), arrays.last(a).alias("last"), arrays.first(a).alias("first"), arrays.join(F.array("vec_id", F.col("vec_id") + 1), "-").alias("joined"))


@query("""SELECT c_custkey, 2 AS size, true AS contains, c_acctbal AS got, NULL::DOUBLE AS missing, ['a', 'b'] AS keys, [c_acctbal, 1.0::DOUBLE] AS values, c_acctbal AS old, [c_acctbal + 1, 1.0::DOUBLE] AS after_put, 3 AS after_add, ['b'] AS after_remove, [7.0::DOUBLE, 1.0::DOUBLE, 8.0::DOUBLE] AS after_all FROM customer""")
def map_functions(spark, sf_dir):
    m = F.create_map(F.lit("a"), F.col("c_acctbal"), F.lit("b"), F.lit(1.0))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", m.alias("m"))
    m = F.col("m")
    put = maps.put(m, F.lit("a"), F.col("c_acctbal") + 1)
    return c.select("c_custkey", maps.size(m).alias("size"), maps.contains(m, F.lit("a")).alias("contains"), maps.get(m, F.lit("a")).alias("got"), maps.get(m, F.lit("z")).alias("missing"), maps.keys(m).alias("keys"), maps.values(m).alias("values"), put["value"].alias("old"), maps.values(put["map"]).alias("after_put"), maps.size(maps.put(m, F.lit("c"), F.lit(2.0))["map"]).alias("after_add"), maps.keys(maps.remove(m, F.lit("a"))["map"]).alias("after_remove"), maps.values(maps.put_all(m, F.create_map(F.lit("a"), F.lit(7.0), F.lit("c"), F.lit(8.0)))).alias("after_all"))


@query("""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings)
SELECT vec_id, round(a * d - b * c, 6) AS det, round(a + d, 6) AS trace, [[a, c], [b, d]] AS transposed, [a, c] AS col0, [c, d] AS row1, 4 AS elements, round(a * a + b * c, 6) AS mult00, round(c * b + d * d, 6) AS mult11, round(d / (a * d - b * c), 4) AS inv00, greatest(a, b, c, d) AS max, round((a + b + c + d) / 4, 6) AS avg, [[c, d], [a, b]] AS swapped, [[d, c], [b, a]] AS reversed, [[a, b, c, d]] AS reshaped, round(b * b, 6) AS kron03,
b = c AS symmetric, true AS square, CASE WHEN a <= c THEN [[a, b], [c, d]] ELSE [[c, d], [a, b]] END AS sorted, round(a * a + b * c, 6) AS pow00, [[a + 1, b + 1], [c + 1, d + 1]] AS added, CASE WHEN abs(a * d - b * c) > 1e-9 THEN 2 ELSE 1 END AS rank FROM e""")
def matrix_functions(spark, sf_dir):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.array(at(0), at(1)), F.array(at(2), at(3))).alias("m"))
    m, M = F.col("m"), matrices
    r = lambda x, d=6: F.round(x, d)
    return e.select(
        "vec_id", r(M.det(m)).alias("det"), r(M.trace(m)).alias("trace"), M.transpose(m).alias("transposed"), M.col(m, 0).alias("col0"), M.row(m, 1).alias("row1"), M.elements_count(m).alias("elements"), r(M.get(M.mult(m, m), 0, 0)).alias("mult00"), r(M.get(M.mult(m, m), 1, 1)).alias("mult11"), r(M.get(M.inv(m), 0, 0), 4).alias("inv00"), M.max(m).alias("max"), r(M.avg(m)).alias("avg"),
        M.swap_rows(m, 0, 1).alias("swapped"), M.reverse(m).alias("reversed"), M.reshape(m, 1, 4).alias("reshaped"), r(M.get(M.kron(m, m), 0, 3)).alias("kron03"), M.is_symmetric(m).alias("symmetric"), M.is_square(m).alias("square"), M.sort(m, 0).alias("sorted"), r(M.get(M.pow(m, 2), 0, 0)).alias("pow00"), M.sum(m, 1.0).alias("added"), M.rank(m).alias("rank"),
    )


# -- requests of other timeframes and symbols ----------------------------------------------------------------------------------

H4 = "h AS (SELECT symbol, to_timestamp(floor(epoch(time) / 14400) * 14400)::TIMESTAMP AS time, arg_max(close, time) AS close, max(high) AS high FROM b GROUP BY 1, 2)"


@query(f"""WITH {BARS}, {H4}, c AS (SELECT *, time + INTERVAL 1 HOUR AS at FROM b), k AS (SELECT *, time + INTERVAL 4 HOUR AS fin FROM h), j AS (SELECT c.symbol, c.time, k.close AS h4_close, k.high AS h4_high, k.fin FROM c ASOF LEFT JOIN k ON c.symbol = k.symbol AND c.at >= k.fin)
SELECT symbol, time, h4_close, h4_high, CASE WHEN fin IS DISTINCT FROM lag(fin) OVER ({OVER}) THEN h4_close END AS h4_gap FROM j""")
def security_higher(spark, sf_dir):
    b = sources.from_events(spark, sf_dir, "60")
    e = {"h4_close": F.col("close"), "h4_high": F.col("high")}
    filled = request.own_timeframe(b, "60", "240", e).select("symbol", "time", "h4_close", "h4_high")
    gaps = request.own_timeframe(b, "60", "240", {"h4_gap": F.col("close")}, gaps=True).select("symbol", "time", "h4_gap")
    return filled.join(gaps, ["symbol", "time"])


@query(f"""WITH {BARS}, {H4}, p AS (SELECT symbol, time, lag(close) OVER ({OVER}) AS last_close, close AS leaked_close FROM h), d AS (SELECT *, to_timestamp(floor(epoch(time) / 14400) * 14400)::TIMESTAMP AS bucket FROM b)
SELECT d.symbol, d.time, first_value(open) OVER w AS dev_open, max(high) OVER w AS dev_high, min(low) OVER w AS dev_low, close AS dev_close, sum(volume) OVER w AS dev_volume, p.last_close, p.leaked_close FROM d LEFT JOIN p ON d.symbol = p.symbol AND d.bucket = p.time WINDOW w AS (PARTITION BY d.symbol, d.bucket ORDER BY d.time ROWS UNBOUNDED PRECEDING)""")
def security_lookahead(spark, sf_dir):
    b = sources.from_events(spark, sf_dir, "60")
    dev = request.lookahead_on(b, "240").select("symbol", "time", "dev_open", "dev_high", "dev_low", "dev_close", "dev_volume", "last_close")
    return dev.join(request.future_leak(b, "240").select("symbol", "time", "leaked_close"), ["symbol", "time"])


@query(f"""WITH {BARS}, d AS (SELECT o_orderdate::DATE::TIMESTAMP AS time, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1), l AS (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS time FROM lineitem GROUP BY 1, 2)
SELECT l.symbol, l.time, d.close AS order_close FROM l ASOF LEFT JOIN d ON l.time >= d.time""")
def security_other_symbol(spark, sf_dir):
    chart = sources.from_lineitem(spark, sf_dir, "1D").select("symbol", "time")
    other = sources.from_orders(spark, sf_dir, "1D").select("time", F.col("close").alias("order_close"))
    return request.security(chart, other, "1D", "1D", ["order_close"], other_symbol=True)


@query("""WITH l AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS time, arg_max(value, ts) AS close FROM events GROUP BY 1, 2), d AS (SELECT DISTINCT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS time FROM events)
SELECT d.symbol, d.time, list(l.close ORDER BY l.time) AS closes FROM d JOIN l ON d.symbol = l.symbol AND date_trunc('day', l.time) = d.time GROUP BY 1, 2""")
def security_lower(spark, sf_dir):
    day = sources.from_events(spark, sf_dir, "1D").select("symbol", "time")
    return request.lower_timeframe(day, sources.from_events(spark, sf_dir, "60"), "1D", ["close"])


@query("""WITH r AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS time, avg(o_totalprice) / 100000 AS rate FROM orders GROUP BY 1), o AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS time FROM orders) SELECT o.o_orderkey, round(r.rate, 6) AS direct, round(1 / r.rate, 6) AS inverse FROM o ASOF LEFT JOIN r ON o.time >= r.time""")
def currency(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("time"), "o_totalprice")
    rates = o.groupBy(F.date_trunc("month", "time").alias("time")).agg((F.avg("o_totalprice") / 100000).alias("rate")).select(F.lit("EUR").alias("base"), F.lit("USD").alias("quote"), "time", "rate")
    one = request.currency_rate(o, rates, "EUR", "USD").select("o_orderkey", "time", F.round("rate", 6).alias("direct"))
    return request.currency_rate(one, rates, "USD", "EUR").select("o_orderkey", "direct", F.round("rate", 6).alias("inverse"))


# -- backtests -----------------------------------------------------------------------------------------------------------------


def reversal(spark, sf_dir) -> DataFrame:
    def script(c: Chart):
        fast, slow = ta.sma(c.close, 5), ta.sma(c.close, 20)
        return {"up": ta.crossover(fast, slow), "down": ta.crossunder(fast, slow)}

    def on_bar(broker, bar):
        if bar["up"]:
            broker.entry("L", LONG)
        elif bar["down"]:
            broker.entry("S", SHORT)

    return engine.strategy(sources.from_events(spark, sf_dir, "60"), script, on_bar, Settings(commission_value=0.1, slippage=2))


TICK = lambda x: f"(floor({x} / 0.01 + 0.5) * 0.01)"
REVERSAL = f"""WITH {CROSS}, s AS (SELECT symbol, time, n, CASE WHEN up THEN 1 WHEN dn THEN -1 END AS side, lead(time) OVER ({OVER}) AS fill_time, lead({TICK('open')}) OVER ({OVER}) AS o FROM x),
f AS (SELECT *, round(o + 0.02 * side, 6) AS price FROM s WHERE side IS NOT NULL AND fill_time IS NOT NULL), t AS (SELECT symbol, fill_time AS entry_time, side, price, lead(fill_time) OVER (PARTITION BY symbol ORDER BY fill_time) AS exit_time, lead(price) OVER (PARTITION BY symbol ORDER BY fill_time) AS exit_price, n AS entry_bar, lead(n) OVER (PARTITION BY symbol ORDER BY fill_time) AS exit_bar FROM f),
c AS (SELECT *, (exit_price - price) * side - 0.001 * (price + exit_price) AS profit FROM t WHERE exit_time IS NOT NULL)"""


@query(f"{REVERSAL} SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY exit_time) - 1 AS ordinal, CASE WHEN side > 0 THEN 'L' ELSE 'S' END AS entry_id, side::INT AS direction, round(price, 6) AS entry_price, entry_time, round(exit_price, 6) AS exit_price, exit_time, round(profit, 5) AS profit FROM c")
def backtest_trades(spark, sf_dir):
    t = backtest.closed_trades(reversal(spark, sf_dir))
    return t.select("symbol", "ordinal", "entry_id", "direction", F.round("entry_price", 6).alias("entry_price"), "entry_time", F.round("exit_price", 6).alias("exit_price"), "exit_time", F.round("profit", 5).alias("profit"))


@query(f"""{REVERSAL}, g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY exit_time) - row_number() OVER (PARTITION BY symbol, sign(profit) ORDER BY exit_time) AS island FROM c), k AS (SELECT symbol, sign(profit) AS sg, island, count(*) AS n FROM g GROUP BY 1, 2, 3),
mm AS (SELECT symbol, coalesce(max(n) FILTER (WHERE sg > 0), 0) AS wins, coalesce(max(n) FILTER (WHERE sg < 0), 0) AS losses FROM k GROUP BY 1)
SELECT c.symbol, count(*) AS total_trades, count(*) FILTER (WHERE profit > 0) AS winning_trades, count(*) FILTER (WHERE profit < 0) AS losing_trades, round(sum(profit) - coalesce(any_value(pending.fee), 0), 6) AS net_profit, round(coalesce(sum(profit) FILTER (WHERE profit > 0), 0), 6) AS gross_profit, round(-coalesce(sum(profit) FILTER (WHERE profit < 0), 0), 6) AS gross_loss,
count(*) FILTER (WHERE side > 0) AS long_total_trades, round(max(profit) FILTER (WHERE profit > 0), 6) AS largest_winning_trade, round(avg(exit_bar - entry_bar), 6) AS avg_bars_in_trades, any_value(mm.wins) AS max_cons_winning_trades, any_value(mm.losses) AS max_cons_losing_trades FROM c JOIN mm USING (symbol) LEFT JOIN (SELECT symbol, sum(0.001 * price) AS fee FROM t WHERE exit_time IS NULL GROUP BY 1) pending USING (symbol) GROUP BY c.symbol""")
def backtest_statistics(spark, sf_dir):
    s = backtest.statistics(reversal(spark, sf_dir))
    names = ("net_profit", "gross_profit", "gross_loss", "largest_winning_trade", "avg_bars_in_trades")
    return s.select("symbol", "total_trades", "winning_trades", "losing_trades", "long_total_trades", "max_cons_winning_trades", "max_cons_losing_trades", *(F.round(n, 6).alias(n) for n in names))


@query()
def backtest_brackets(spark, sf_dir):
    """Limit and stop entries with brackets, trailing stops, sizing by equity, margin and risk rules."""

    def on_bar(broker, bar):
        if bar["up"]:
            broker.entry("L", LONG, stop=bar["high"], oca_name="in", oca_type="cancel")
            broker.entry("S", SHORT, limit=bar["high"] * 1.2, oca_name="in", oca_type="cancel")
        broker.exit("X", "L", qty_percent=50, profit=500, loss=800)
        broker.exit("T", "L", trail_points=300, trail_offset=200)
        broker.exit("Y", "S", limit=bar["low"] * 0.9, stop=bar["high"] * 1.3)

    def setup(broker):
        broker.max_position_size(1e6)
        broker.max_intraday_filled_orders(20)

    def script(c: Chart):
        return {"up": ta.crossover(ta.sma(c.close, 3), ta.sma(c.close, 9))}

    settings = Settings(initial_capital=10_000, qty_type="percent_of_equity", qty_value=50, commission_value=0.05, margin_long=50, margin_short=50)
    return backtest.closed_trades(engine.strategy(sources.from_events(spark, sf_dir, "60"), script, on_bar, settings, setup=setup))


@query()
def backtest_magnified(spark, sf_dir):
    """Daily bars whose orders fill along their hourly bars."""
    day = resample.resample(sources.from_events(spark, sf_dir, "60"), "1D", "60", keep_list=True)

    def on_bar(broker, bar):
        if not broker.open:
            broker.entry("L", LONG, limit=bar["low"])
        broker.exit("X", "L", profit=2000, loss=2000)

    return backtest.closed_trades(backtest.backtest(day, on_bar, Settings(), sub_bars="sub_bars"))


@query(f"WITH {BARS}, e AS (SELECT symbol, arg_min(open, time) AS f, arg_max(close, time) AS l FROM b GROUP BY 1) SELECT symbol, round((l - f) / f * 1000000, 4) AS buy_and_hold_return, round((l - f) / f * 100, 6) AS buy_and_hold_return_percent FROM e")
def buy_and_hold(spark, sf_dir):
    h = backtest.buy_and_hold(sources.from_events(spark, sf_dir, "60"))
    return h.select("symbol", F.round("buy_and_hold_return", 4).alias("buy_and_hold_return"), F.round("buy_and_hold_return_percent", 6).alias("buy_and_hold_return_percent"))


# -- outputs and streams -----------------------------------------------------------------------------------------------------


@query(f"WITH {CROSS} SELECT symbol, time, 'up at ' || round(close, 2)::DECIMAL(18,2)::VARCHAR AS message FROM x WHERE up")
def alerts(spark, sf_dir):
    c = hourly(spark, sf_dir)
    df = c.select(keep=("close",), up=ta.crossover(ta.sma(c.close, 5), ta.sma(c.close, 20)))
    return plots.alerts(df, F.col("up"), F.concat(F.lit("up at "), F.round("close", 2).cast("decimal(18,2)").cast("string")))


@query(f"WITH {CROSS}, l AS (SELECT symbol, 'cross' || (n - 1) AS id, n, close, row_number() OVER (PARTITION BY symbol ORDER BY n DESC) AS back FROM x WHERE up) SELECT symbol, id, close::DECIMAL(18,4)::VARCHAR AS y, CASE WHEN back = 1 THEN 'red' ELSE 'blue' END AS color FROM l WHERE back <= 5")
def drawings(spark, sf_dir):
    c = hourly(spark, sf_dir)
    df = c.select(keep=("close",), up=ta.crossover(ta.sma(c.close, 5), ta.sma(c.close, 20)), i=c.bar_index).where("up")
    id_ = F.concat(F.lit("cross"), F.col("i").cast("string"))
    made = plots.create(df, "label", id_, F.col("i") * 10, x=F.col("i"), y=F.col("close").cast("decimal(18,4)"), color=F.lit("blue"))
    newest = df.groupBy("symbol").agg(F.max("i").alias("i"))
    changed = plots.update(newest, "label", id_, F.col("i") * 10 + 1, color=F.lit("red"))
    left = plots.live(made.unionByName(changed), "label", 5)
    return left.select("symbol", "id", plots.attribute(left, "y").alias("y"), plots.attribute(left, "color").alias("color"))


@query(f"""WITH {BARS}, r AS (SELECT symbol, n AS seq, '{{"type":"bar","time":' || epoch_ms(time) || ',"values":{{"sma":' || CASE WHEN n >= 20 THEN round(avg(close) {last(20)}, 4)::VARCHAR ELSE 'null' END || '}}}}' AS value FROM b), s AS (SELECT DISTINCT symbol FROM b)
SELECT * FROM r UNION ALL SELECT symbol, -1, '{{"type": "hdr", "version": 1}}' FROM s UNION ALL SELECT symbol, 0, '{{"type": "meta", "plots": [{{"kind": "plot", "title": "sma", "color": "blue"}}, {{"kind": "hline", "price": 50.0, "title": "middle"}}]}}' FROM s UNION ALL SELECT symbol, 4611686018427387904, '{{"type": "end"}}' FROM s""")
def ndjson(spark, sf_dir):
    """Plot records as JSON lines."""
    c = hourly(spark, sf_dir)
    p = plots.Plots()
    p.plot(ta.sma(c.close, 20).map(lambda x: F.round(x, 4)), "sma", color="blue")
    p.hline(50.0, "middle")
    return plots.ndjson(c.select(**p.columns), p)


@query(f"WITH {BARS} SELECT symbol, time, CASE WHEN n >= 14 THEN round(avg(close) {last(14)}, 6) END AS \"Average\", high - low AS \"Range\" FROM b")
def indicator_script(spark, sf_dir):
    def script(chart, plots, length=20):
        plots.plot(ta.sma(chart.close, length).map(lambda x: F.round(x, 6)), "Average")
        plots.plot(chart.high - chart.low, "Range")

    return engine.indicator(sources.from_events(spark, sf_dir, "60"), script, {"length": 14})


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """All rows of a stream over data at hand, run to its end in one trigger."""
    import uuid

    name = f"s{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


@query("SELECT event_type AS symbol, date_trunc('hour', ts) AS time, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ticks = live.replay(spark, sf_dir, schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(live.tumbling_bars(ticks, "1 hour", "event_type", "ts", "value"), "complete")
