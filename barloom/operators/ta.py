"""Rolling and recursive indicators over series.

Window indicators are Catalyst window expressions with na as null: a compacted window partitions by "x is null" as well, which gives the last n values
instead of the last n bars without a self-join.  Recursive ones are kernels, run together in one pass.
"""

from __future__ import annotations

import builtins
import math
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barloom.operators import kernels as K
from barloom.plans.series import EPSILON, Chart, Series, yes


def _carry(s: Series) -> Series:
    """On bars without a value, the last one."""
    return s.window(lambda x: F.last(x, ignorenulls=True).over(s.chart.over(0)))


def _compacted(s: Series, n: int, make) -> Series:
    """``make(x, window)`` over the last n values of s, null until there are n and on na bars."""
    c = s.chart

    def build(x: Column) -> Column:
        w = c.compact(x, n)
        return F.when(x.isNotNull() & (F.count(x).over(w) == n), make(x, w))

    return s.window(build)


def _bars(s: Series, n: int, make) -> Series:
    """``make(x, window)`` over the last n bars, null until there are n."""
    c = s.chart
    return s.window(lambda x: F.when(F.row_number().over(c.over()) >= n, make(x, c.over(n))))


def _list(s: Series, n: int) -> Series:
    """The values of the last n bars, oldest first, nulls kept; null until there are n."""
    held = _bars(s, n, lambda x, w: F.collect_list(F.struct(x.alias("v"))).over(w))
    return held.map(lambda a: F.transform(a, lambda e: e["v"]))


def _values(s: Series, n: int) -> Series:
    """The last n values, oldest first; null until there are n and on na bars."""
    return _compacted(s, n, lambda x, w: F.collect_list(x).over(w))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, e: t + e)


def _dot(a: Column, weights: list[float]) -> Column:
    return _total(F.zip_with(a, F.array(*map(F.lit, weights)), lambda x, w: x * w))


# -- sums and averages ---------------------------------------------------------------------------------------------


def sum(source: Series, length: int) -> Series:  # noqa: A001
    if length == 1:
        return source
    return _carry(_compacted(source, length, lambda x, w: F.sum(x).over(w)))


def sma(source: Series, length: int) -> Series:
    return _carry(_compacted(source, int(length), lambda x, w: F.avg(x).over(w)))


def variance(source: Series, length: int, biased: bool = True) -> Series:
    return _carry(_compacted(source, int(length), lambda x, w: (F.var_pop if biased else F.var_samp)(x).over(w)))


def stdev(source: Series, length: int, biased: bool = True) -> Series:
    return variance(source, length, biased).map(F.sqrt)


def bb(series: Series, length: int, mult: float) -> tuple[Series, Series, Series]:
    basis, width = sma(series, length), stdev(series, length) * mult
    return basis, basis + width, basis - width


def bbw(series: Series, length: int, mult: float) -> Series:
    basis, upper, lower = bb(series, length, mult)
    return (upper - lower) * 100.0 / basis


def vwma(source: Series, length: int) -> Series:
    return sma(source * source.chart.volume, length) / sma(source.chart.volume, length)


def swma(source: Series) -> Series:
    return (source + source[1] * 2.0 + source[2] * 2.0 + source[3]) / 6.0


def wma(source: Series, length: int) -> Series:
    """Linear weights over the forward-filled window; na bars give na."""
    filled = _list(_carry(source), length)
    total = length * (length + 1) / 2
    return filled.map(lambda a, x: F.when(x.isNotNull(), _dot(a, [float(i) for i in builtins.range(1, length + 1)]) / total), source)


def hma(source: Series, length: int) -> Series:
    raw = wma(source, length // 2) * 2.0 - wma(source, length)
    return wma(raw, int(math.sqrt(length)))


def alma(series: Series, length: int, offset: float = 0.85, sigma: float = 6.0, floor: bool = False) -> Series:
    m = offset * (length - 1)
    m = math.floor(m) if floor else m
    s = length / sigma
    weights = [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in builtins.range(length)]
    norm = math.fsum(weights)
    return _list(series, length).map(lambda a: _dot(a, [w / norm for w in weights]))


def ema(source: Series, length: int) -> Series:
    return source.chart.fold(lambda: K.Ema(length), source)


def rma(source: Series, length: int) -> Series:
    return source.chart.fold(lambda: K.Rma(length), source)


def cum(source: Series) -> Series:
    return source.window(lambda x: F.when(x.isNotNull(), F.sum(x).over(source.chart.over(0))))


def max(source: Series) -> Series:  # noqa: A001
    return source.window(lambda x: F.max(x).over(source.chart.over(0)))


def min(source: Series) -> Series:  # noqa: A001
    return source.window(lambda x: F.min(x).over(source.chart.over(0)))


# -- change, cross and counts ----------------------------------------------------------------------------------------


def change(source: Series, length: int = 1) -> Series:
    return source - source[length]


def change_bool(source: Series, length: int = 1) -> Series:
    return source.map(lambda a, b: a != b, source[length])


mom = change


def roc(source: Series, length: int) -> Series:
    return (source - source[length]) * 100.0 / source[length]


def rising(source: Series, length: int) -> Series:
    return _steps(source, length, 1)


def falling(source: Series, length: int) -> Series:
    return _steps(source, length, -1)


def _steps(source: Series, n: int, sign: int) -> Series:
    step = source.map(lambda a, b: F.when((a - b) * sign > EPSILON, 1).otherwise(0), source[1])
    return step.window(lambda s: yes((F.min(s).over(source.chart.over(n)) == 1) & (F.count(s).over(source.chart.over(n)) == n)))


def crossover(source1: Series, source2: Any) -> Series:
    return _crossed(source1, source2, lambda a, b: a > b, lambda a, b: a <= b)


def crossunder(source1: Series, source2: Any) -> Series:
    return _crossed(source1, source2, lambda a, b: a < b, lambda a, b: a >= b)


def _crossed(a: Series, b: Any, now, before) -> Series:
    w = a.chart.over().rowsBetween(-(2**31), -1)
    return a.window(lambda x, y: yes(F.last(F.when(x.isNotNull() & y.isNotNull(), before(x, y)), ignorenulls=True).over(w) & now(x, y)), b)


def cross(source1: Series, source2: Any) -> Series:
    """Fires on a strict jump out of the side that the sources were last clearly on."""
    d = source1 - source2
    w = d.chart.over().rowsBetween(-(2**31), -1)
    return d.window(lambda x: yes(F.last(F.when(F.abs(x) > EPSILON, F.signum(x)), ignorenulls=True).over(w) * F.signum(x) < 0))


def barssince(condition: Series) -> Series:
    c = condition.chart
    at = condition.map(lambda x, i: F.when(yes(x), i), c.bar_index)
    return at.window(lambda a, i: i - F.last(a, ignorenulls=True).over(c.over(0)), c.bar_index)


def valuewhen(condition: Series, source: Series, occurrence: int) -> Series:
    """The source on the ``occurrence``-th most recent bar with the condition; an na source counts as one."""
    c = condition.chart

    def nth(x: Column, s: Column) -> Column:
        only = Window.partitionBy(c.key, yes(x)).orderBy(c.time_name)
        return F.when(yes(x), F.struct(F.lag(s, occurrence).over(only).alias("v"))) if occurrence else F.when(yes(x), F.struct(s.alias("v")))

    at = condition.window(nth, source)
    return at.window(lambda x: F.last(x, ignorenulls=True).over(c.over(0))["v"])


# -- extremes, ranks and percentiles -----------------------------------------------------------------------------------


def highest(source: Series, length: int) -> Series:
    return _bars(source, length, lambda x, w: F.max(x).over(w))


def lowest(source: Series, length: int) -> Series:
    return _bars(source, length, lambda x, w: F.min(x).over(w))


def highestbars(source: Series, length: int) -> Series:
    return _extreme_at(source, length, 1)


def lowestbars(source: Series, length: int) -> Series:
    return _extreme_at(source, length, -1)


def _extreme_at(source: Series, n: int, sign: int) -> Series:
    """Offset (0 or negative) to the extreme; of equals the oldest."""
    i = source.chart.bar_index
    at = source.chart.windowed(lambda x, i: F.when(F.row_number().over(source.chart.over()) >= n, F.max(F.when(x.isNotNull(), F.struct((x * sign).alias("x"), (-i).alias("i")))).over(source.chart.over(n))), source, i)
    return at.map(lambda m, i: -(m["i"]) - i, i)


def range(source: Series, length: int) -> Series:  # noqa: A001
    return highest(source, length) - lowest(source, length)


def stoch(source: Series, high: Series, low: Series, length: int) -> Series:
    lo = lowest(low, length)
    return (source - lo) * 100.0 / (highest(high, length) - lo)


def wpr(chart: Chart, length: int) -> Series:
    if length == 1:
        return chart.close
    hh = highest(chart.high, length)
    return (chart.close - hh) * 100.0 / (hh - lowest(chart.low, length))


def pivothigh(source: Series, leftbars: int, rightbars: int) -> Series:
    return _pivot(source, leftbars, rightbars, 1)


def pivotlow(source: Series, leftbars: int, rightbars: int) -> Series:
    return _pivot(source, leftbars, rightbars, -1)


def _pivot(source: Series, left: int, right: int, sign: int) -> Series:
    """The extreme of left + right + 1 bars if it stands exactly ``right`` bars ago; of equals the newest counts."""
    n = left + right + 1
    i = source.chart.bar_index
    best = source.chart.windowed(lambda x, i: F.when(x.isNotNull() & (F.row_number().over(source.chart.over()) >= n), F.max(F.when(x.isNotNull(), F.struct((x * sign).alias("x"), i.alias("i")))).over(source.chart.over(n))), source, i)
    return best.map(lambda m, i: F.when(m["i"] == i - right, m["x"] * sign), i)


def median(source: Series, length: int) -> Series:
    return _compacted(source, length, lambda x, w: F.percentile(x, F.lit(0.5)).over(w))


def mode(source: Series, length: int) -> Series:
    return _bars(source, length, lambda x, w: F.mode(x, True).over(w))


def percentile_linear_interpolation(source: Series, length: int, percentage: float) -> Series:
    place = length * percentage / 100 + 0.5

    def pick(a: Column, x: Column) -> Column:
        s = F.array_sort(a)  # nulls last
        at = lambda k: F.get(s, F.lit(builtins.min(builtins.max(k, 1), length) - 1))
        lo = math.floor(place)
        share = place - lo
        return F.when(x.isNotNull(), at(lo) if share == 0 else at(lo) * (1 - share) + at(lo + 1) * share)

    return _list(source, length).map(pick, source)


def percentile_nearest_rank(source: Series, length: int, percentage: float) -> Series:
    rank = builtins.min(builtins.max(math.ceil(percentage * length / 100), 1), length)
    return _list(source, length).map(lambda a, x: F.when(x.isNotNull(), F.get(F.array_sort(a), F.lit(rank - 1))), source)


def percentrank(source: Series, length: int) -> Series:
    """Share of the ``length`` bars before that are at most the current value, in percent."""
    held = _list(source, length + 1)
    return held.map(lambda a, x: F.when(x.isNotNull(), (F.size(F.filter(a, lambda e: e - x <= EPSILON)) - 1) * 100.0 / length), source)


def rci(source: Series, length: int) -> Series:
    """Rank correlation of value and time, in percent; values within 1e-10 share their rank."""
    held = _list(source, length)
    mean = (length - 1) / 2
    var_x = (length * length - 1) / 12

    def value(a: Column, x: Column, i: Column) -> Column:
        above = lambda e: F.size(F.filter(a, lambda o: o - e >= EPSILON))
        same = lambda e: F.size(F.filter(a, lambda o: F.abs(o - e) < EPSILON))
        ranks = F.transform(a, lambda e: above(e) + (same(e) - 1) / 2.0)

        def score(r: Column) -> Column:
            cov = F.aggregate(F.transform(r, lambda e, k: (F.lit(length - 1) - k - mean) * (e - mean)), F.lit(0.0), lambda t, e: t + e) / length
            var_y = _total(F.transform(r, lambda e: e * e)) / length - mean * mean
            return F.when(var_y > 0, cov * 100.0 / F.sqrt(var_y * var_x))

        return F.when(x.isNotNull() & (i >= length), F.element_at(F.transform(F.array(ranks), score), 1))

    return held.map(value, source, source.chart.bar_index)


# -- deviation, regression, correlation -----------------------------------------------------------------------------------


def dev(source: Series, length: int) -> Series:
    """Mean absolute deviation from the average; an na bar in the window gives na."""
    if length == 1:
        return source * 0.0
    held = _list(source, length)
    return held.map(lambda a, m: F.aggregate(a, F.lit(0.0), lambda t, e: t + F.abs(e - m)) / length, sma(source, length))


def cci(source: Series, length: int) -> Series:
    return (source - sma(source, length)) / (dev(source, length) * 0.015)


def correlation(source1: Series, source2: Series, length: int) -> Series:
    a, b = sma(source1, length), sma(source2, length)
    cov = sma(source1 * source2, length) - a * b
    spread = (sma(source1 * source1, length) - a * a) * (sma(source2 * source2, length) - b * b)
    return cov.map(lambda c, s: F.when(F.abs(c) <= EPSILON, F.lit(0.0)).when(s > 0, c / F.sqrt(s)), spread)


def linreg(source: Series, length: int, offset: int = 0) -> Series:
    if length == 1:
        return source
    mean, square = (length - 1) / 2, length * (length * length - 1) / 12

    def at(a: Column) -> Column:
        slope = _dot(a, [(i - mean) / square for i in builtins.range(length)])
        return _total(a) / length + slope * (length - 1 - offset - mean)

    return _carry(_values(source, length).map(at))


def cog(source: Series, length: int) -> Series:
    return _carry(_values(source, length).map(lambda a: F.try_divide(-_dot(a, [float(length - i) for i in builtins.range(length)]), _total(a))))


def cmo(series: Series, length: int) -> Series:
    m = change(series)
    up = sum(m.map(lambda x: F.when(x >= -EPSILON, x).when(x.isNotNull(), 0.0)), length)
    down = sum(m.map(lambda x: F.when(x < -EPSILON, -x).when(x.isNotNull(), 0.0)), length)
    return m.map(lambda x, u, d: F.when(x.isNotNull(), F.try_divide((u - d) * 100.0, u + d)), up, down)


# -- volume and true range ---------------------------------------------------------------------------------------------


def tr(chart: Chart, handle_na: bool = False) -> Series:
    h, low, c1 = chart.high, chart.low, chart.close[1]
    first = (lambda h, lo: h - lo) if handle_na else (lambda h, lo: F.lit(None).cast("double"))
    return h.map(lambda h, lo, c: F.when(c.isNull(), first(h, lo)).otherwise(F.greatest(h - lo, F.abs(h - c), F.abs(lo - c))), low, c1)


def atr(chart: Chart, length: int) -> Series:
    return rma(tr(chart, True), length)


def accdist(chart: Chart) -> Series:
    flow = chart.close.map(lambda c, h, lo, v: F.coalesce(F.try_divide((c - lo) - (h - c), h - lo) * v, F.lit(0.0)), chart.high, chart.low, chart.volume)
    return flow.window(lambda x: F.sum(x).over(chart.over(0)))


def iii(chart: Chart) -> Series:
    return (chart.close * 2.0 - chart.high - chart.low) / ((chart.high - chart.low) * chart.volume)


def wvad(chart: Chart) -> Series:
    return (chart.close - chart.open) / (chart.high - chart.low) * chart.volume


def obv(chart: Chart) -> Series:
    return cum(change(chart.close).map(lambda d, v: F.signum(d) * v, chart.volume))


def pvt(chart: Chart) -> Series:
    return cum(change(chart.close) / chart.close[1] * chart.volume)


def wad(chart: Chart) -> Series:
    def gain(c: Column, h: Column, lo: Column, c1: Column) -> Column:
        return F.when(c1.isNull(), F.lit(None).cast("double")).when(c > c1, c - F.least(lo, c1)).when(c < c1, c - F.greatest(h, c1)).otherwise(0.0)

    return cum(chart.close.map(gain, chart.high, chart.low, chart.close[1]))


def nvi(chart: Chart) -> Series:
    return chart.fold(lambda: K.VolumeIndex(-1), chart.close, chart.volume)


def pvi(chart: Chart) -> Series:
    return chart.fold(lambda: K.VolumeIndex(1), chart.close, chart.volume)


def mfi(series: Series, length: int) -> Series:
    v = series.chart.volume
    up = sum(series.map(lambda s, d, v: v * F.when(d <= EPSILON, 0.0).otherwise(s), change(series), v), length)
    down = sum(series.map(lambda s, d, v: v * F.when(d >= -EPSILON, 0.0).otherwise(s), change(series), v), length)
    flat = lambda x: F.when(F.abs(x) <= EPSILON, 0.0).otherwise(x)
    return up.map(lambda u, d, s: F.when(u.isNotNull() & d.isNotNull() & s.isNotNull(), F.when(flat(d) == 0, 100.0).otherwise(100.0 - F.try_divide(F.lit(100.0), 1.0 + F.try_divide(flat(u), flat(d))))), down, series)


def vwap(source: Series, anchor: Series, stdev_mult: float | None = None) -> Series | tuple[Series, Series, Series]:
    """Volume-weighted average since the last bar with the anchor."""
    c = source.chart
    segment = anchor.window(lambda a: F.sum(F.when(yes(a), 1).otherwise(0)).over(c.over(0)))

    def since(x: Column, g: Column) -> Column:
        return F.when(g > 0, F.sum(x).over(Window.partitionBy(c.key, g).orderBy(c.time_name).rowsBetween(Window.unboundedPreceding, 0)))

    known = source.map(lambda x, v: F.when(x.isNotNull(), v), c.volume)
    total, weighted = known.window(since, segment), (source * c.volume).window(since, segment)
    mean = source.map(lambda x, p, v: F.when(x.isNotNull(), F.try_divide(p, v)), weighted, total)
    if stdev_mult is None:
        return mean
    squares = (source * source * c.volume).window(since, segment)
    width = squares.map(lambda s, v, m: F.sqrt(F.greatest(F.try_divide(s, v) - m * m, F.lit(0.0))) * stdev_mult, total, mean)
    return mean, mean + width, mean - width


# -- recursive --------------------------------------------------------------------------------------------------------


def rsi(source: Series, length: int) -> Series:
    return source.chart.fold(lambda: K.Rsi(length), source)


def macd(source: Series, fastlen: int, slowlen: int, siglen: int) -> tuple[Series, Series, Series]:
    return source.chart.fold(lambda: K.Macd(fastlen, slowlen, siglen), source, outputs=3)


def dmi(chart: Chart, di_length: int, adx_smoothing: int) -> tuple[Series, Series, Series]:
    return chart.fold(lambda: K.Dmi(di_length, adx_smoothing), chart.high, chart.low, tr(chart), outputs=3)


def tsi(source: Series, short_length: int, long_length: int) -> Series:
    return source.chart.fold(lambda: K.Tsi(short_length, long_length), source)


def kc(series: Series, length: int, mult: float, use_true_range: bool = True) -> tuple[Series, Series, Series]:
    c = series.chart
    basis, span = ema(series, length), ema(tr(c) if use_true_range else c.high - c.low, length)
    return basis, basis + span * mult, basis - span * mult


def kcw(series: Series, length: int, mult: float, use_true_range: bool = True) -> Series:
    basis, upper, lower = kc(series, length, mult, use_true_range)
    return (upper - lower) / basis


def sar(chart: Chart, start: float = 0.02, inc: float = 0.02, max: float = 0.2) -> Series:  # noqa: A002
    return chart.fold(lambda: K.Sar(start, inc, max), chart.high, chart.low)


def supertrend(chart: Chart, factor: float, atr_period: int) -> tuple[Series, Series]:
    return chart.fold(lambda: K.Supertrend(factor, atr_period), chart.hl2, chart.close, tr(chart, True), outputs=2)


def heikinashi(chart: Chart) -> tuple[Series, Series, Series, Series]:
    return chart.fold(K.HeikinAshi, chart.open, chart.high, chart.low, chart.close, outputs=4)


def random(chart: Chart, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Series:
    return chart.fold(lambda: K.Lcg(low, high, seed), chart.close)


def fixnan(source: Series) -> Series:
    return _carry(source)


def fold(chart: Chart, start, step, *inputs: Series) -> Series:
    """A recurrence of the user: ``step(state, *values) -> (state, output)`` from ``start()``."""
    return chart.fold(lambda: K.UserFold(start, step), *inputs)


def when_active(condition: Series, source: Series, function) -> Series:
    """``function`` over only the bars with the condition (na elsewhere), its last value carried over the others."""
    return _carry(function(condition.where(source)))


# -- pivot levels -----------------------------------------------------------------------------------------------------

#: Per type, the factors of the ranges added to the centre for R1, S1, R2, S2 ...
FIBONACCI = (0.382, 0.618, 1.0)
CAMARILLA = (12, 6, 4, 2)


def pivot_point_levels(chart: Chart, type: str, anchor: Series, developing: bool = False) -> Series:  # noqa: A002
    """Array of P, R1, S1 ... R5, S5 from the last finished period (or the current one), periods starting at the anchor."""
    segment = anchor.window(lambda a: F.sum(F.when(yes(a), 1).otherwise(0)).over(chart.over(0)))
    inside = lambda g: Window.partitionBy(chart.key, g).orderBy(chart.time_name).rowsBetween(Window.unboundedPreceding, 0)
    o = chart.open.window(lambda x, g: F.first(x).over(inside(g)), segment)
    h = chart.high.window(lambda x, g: F.max(x).over(inside(g)), segment)
    low = chart.low.window(lambda x, g: F.min(x).over(inside(g)), segment)
    now = o.map(lambda o, h, lo, c: F.struct(o.alias("o"), h.alias("h"), lo.alias("l"), c.alias("c")), h, low, chart.close)
    if developing:
        used = now.map(lambda x, g: F.when(g > 0, x), segment)
    else:
        ended = now.window(lambda x, a: F.when(yes(a), F.lag(x).over(chart.over())), anchor)
        used = ended.window(lambda x: F.last(x, ignorenulls=True).over(chart.over(0)))
    kind = type.lower()

    def levels(x: Column, open_: Column) -> Column:
        h, lo, c, po = x["h"], x["l"], x["c"], x["o"]
        span, na = h - lo, F.lit(None).cast("double")
        p = (h + lo + c) / 3
        if kind in ("traditional", "classic", "woodie"):
            p = (h + lo + (c if developing else open_) * 2) / 4 if kind == "woodie" else p
            r1, s1 = p * 2 - lo, p * 2 - h
            out = [p, r1, s1, p + span, p - span, r1 + span, s1 - span]
        elif kind == "fibonacci":
            out = [p, *(v for k in FIBONACCI for v in (p + span * k, p - span * k))]
        elif kind == "dm":
            t = F.when(c < po, h + lo * 2 + c).when(c > po, h * 2 + lo + c).otherwise(h + lo + c * 2)
            out = [t / 4, t / 2 - lo, t / 2 - h]
        elif kind == "camarilla":
            out = [p, *(v for k in CAMARILLA for v in (c + span * 1.1 / k, c - span * 1.1 / k))]
        else:
            out = []
        return F.array(*(F.when(x.isNotNull(), v) for v in out), *[na] * (11 - len(out)))

    return used.map(levels, o)

