"""Sequential kernels of the recursive indicators.

Every kernel keeps its state between calls of ``push``, takes one array of values per input (NaN is na) and gives arrays of the
same length, so a batch run, a run in pieces and a stream give the same values.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable

import numpy as np

NAN = float("nan")
EPSILON = 1e-10


class Kernel:
    """Value by value; subclasses give ``one(*values)``."""

    outputs = 1

    def push(self, *inputs: np.ndarray):
        rows = [self.one(*v) for v in zip(*(x.tolist() for x in inputs), strict=True)]
        if self.outputs == 1:
            return np.array(rows, np.float64)
        return tuple(np.array([r[i] for r in rows], np.float64) for i in range(self.outputs))

    def peek(self, *values: float):
        """The value that a developing bar would have; the state stays."""
        return copy.deepcopy(self).one(*values)

    def one(self, *values: float):
        raise NotImplementedError


BLOCK = 128


class Smoothed(Kernel):
    """Exponential average: seeded with the plain mean of the first n values; na bars are skipped.

    The recurrence is v' = keep v + take x, so a block of values is one triangular product plus what is left of the value before it;
    arrays are done block by block, and only the blocks follow one another.
    """

    def __init__(self, n: int, take: float):
        self.n, self.take, self.keep = int(n), take, 1.0 - take
        self.count, self.total, self.value = 0, 0.0, NAN

    def one(self, x: float) -> float:
        if x != x:
            return NAN
        if self.n == 1:
            return x
        if self.count < self.n:
            self.count += 1
            self.total += x
            if self.count < self.n:
                return NAN
            self.value = self.total / self.n
            return self.value
        self.value = self.keep * self.value + self.take * x
        return self.value

    def push(self, x: np.ndarray) -> np.ndarray:
        if self.n == 1:
            return x
        out = np.full(len(x), NAN)
        there = np.flatnonzero(x == x)
        first = min(len(there), self.n - self.count)
        out[there[:first]] = [self.one(v) for v in x[there[:first]].tolist()]
        rest = x[there[first:]]
        if len(rest):
            lags = np.arange(BLOCK)
            fade = self.keep ** (lags + 1.0)
            mix = np.tril(self.take * self.keep ** np.maximum(lags[:, None] - lags, 0))
            blocks = np.zeros(-(-len(rest) // BLOCK) * BLOCK)
            blocks[: len(rest)] = rest
            blocks = blocks.reshape(-1, BLOCK) @ mix.T
            starts, value = np.empty(len(blocks)), self.value
            for k, end in enumerate(blocks[:, -1].tolist()):
                starts[k] = value
                value = fade[-1] * value + end
            blocks += starts[:, None] * fade
            done = blocks.ravel()[: len(rest)]
            out[there[first:]] = done
            self.value = float(done[-1])
        return out


class Ema(Smoothed):
    def __init__(self, n: int):
        super().__init__(n, 2.0 / (int(n) + 1))


class Rma(Smoothed):
    def __init__(self, n: int):
        super().__init__(n, 1.0 / int(n))


class Composed(Kernel):
    """A kernel given for whole arrays; one value is an array of one."""

    def one(self, *values: float):
        found = self.push(*(np.array([v], np.float64) for v in values))
        return float(found[0]) if self.outputs == 1 else tuple(float(x[0]) for x in found)


def moved(x: np.ndarray, before: float) -> np.ndarray:
    """Each value's predecessor."""
    return np.concatenate(([before], x[:-1]))


def quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, na over zero and over na."""
    return np.divide(a, b, out=np.full(len(a), NAN), where=b != 0)


class Rsi(Composed):
    def __init__(self, n: int):
        self.up, self.down, self.before = Rma(n), Rma(n), NAN

    def push(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), NAN)
        there = np.flatnonzero(x == x)
        if len(there):
            y = x[there]
            change = y - moved(y, self.before)
            self.before = float(y[-1])
            up, down = self.up.push(np.where(change > 0, change, 0 * change)), self.down.push(np.where(change < 0, -change, 0 * change))
            out[there] = np.where(down == 0, 100.0 + 0 * up, 100.0 - 100.0 / (1.0 + quotient(up, down)))
        return out


class Macd(Composed):
    outputs = 3

    def __init__(self, fast: int, slow: int, signal: int):
        self.fast, self.slow, self.signal = Ema(fast), Ema(slow), Ema(signal)

    def push(self, x: np.ndarray):
        line = self.fast.push(x) - self.slow.push(x)
        signal = self.signal.push(line)
        return line, signal, line - signal


class Dmi(Composed):
    """From high, low and true range (na on the first bar): +DI, -DI, ADX."""

    outputs = 3

    def __init__(self, n: int, smoothing: int):
        self.range, self.plus, self.minus, self.adx = Rma(n), Rma(n), Rma(n), Rma(smoothing)
        self.high = self.low = NAN

    def push(self, high: np.ndarray, low: np.ndarray, true_range: np.ndarray):
        up, down = high - moved(high, self.high), moved(low, self.low) - low
        if len(high):
            self.high, self.low = float(high[-1]), float(low[-1])
        missing = (up != up) | (down != down)
        directed = lambda a, b: np.where(missing, NAN, np.where((a - b > EPSILON) & (a > EPSILON), a, 0.0))
        spread = self.range.push(true_range)
        plus, minus = (100 * quotient(k.push(directed(a, b)), spread) for k, a, b in ((self.plus, up, down), (self.minus, down, up)))
        known = (plus == plus) & (minus == minus)
        plus, minus = np.where(known, plus, NAN), np.where(known, minus, NAN)
        total = plus + minus
        return plus, minus, 100 * self.adx.push(np.abs(plus - minus) / np.where(total == 0, 1.0, total))


class Tsi(Composed):
    def __init__(self, short: int, long: int):
        self.slow, self.fast = (Ema(long), Ema(long)), (Ema(short), Ema(short))
        self.before = NAN

    def push(self, x: np.ndarray) -> np.ndarray:
        move = x - moved(x, self.before)
        if len(x):
            self.before = float(x[-1])
        a, b = (fast.push(slow.push(m)) for fast, slow, m in zip(self.fast, self.slow, (move, np.abs(move)), strict=True))
        return quotient(a, b)


class VolumeIndex(Composed):
    """Compounded return over bars whose volume rose (sign 1) or fell (sign -1), from 1."""

    def __init__(self, sign: int):
        self.sign, self.value, self.close, self.volume = sign, 1.0, NAN, NAN

    def push(self, close: np.ndarray, volume: np.ndarray) -> np.ndarray:
        if not len(close):
            return close
        before, volume_before = moved(close, self.close), moved(volume, self.volume)
        change = quotient(close - before, before)
        counts = ((volume - volume_before) * self.sign > 0) & (change == change)
        out = np.cumprod(np.concatenate(([self.value], np.where(counts, 1 + change, 1.0))))[1:]
        self.close, self.volume, self.value = float(close[-1]), float(volume[-1]), float(out[-1])
        return out


class Sar(Kernel):
    """Parabolic stop and reverse of high and low."""

    def __init__(self, start: float, inc: float, most: float):
        self.start, self.inc, self.most = start, inc, most
        self.long, self.af, self.sar, self.extreme = True, start, NAN, NAN
        self.bars: list[tuple[float, float]] = []

    def one(self, high: float, low: float) -> float:
        past = self.bars
        self.bars = [*past[-1:], (high, low)]
        if not past:
            return NAN
        h1, l1 = past[-1]
        if len(past) == 1:
            self.long = not h1 > high
            self.sar, self.extreme = (l1, high) if self.long else (h1, low)
            return self.sar
        h2, l2 = (v if v == v else w for v, w in zip(past[-2], past[-1], strict=True))
        sar = self.sar + self.af * (self.extreme - self.sar)
        if self.long and low <= sar:
            self.long, self.af, sar, self.extreme = False, self.start, max(self.extreme, high, h1, h2), low
        elif not self.long and high >= sar:
            self.long, self.af, sar, self.extreme = True, self.start, min(self.extreme, low, l1, l2), high
        elif self.long:
            sar = min(sar, l1, l2)
            if high > self.extreme:
                self.extreme, self.af = high, min(self.af + self.inc, self.most)
        else:
            sar = max(sar, h1, h2)
            if low < self.extreme:
                self.extreme, self.af = low, min(self.af + self.inc, self.most)
        self.sar = sar
        return sar


class Supertrend(Kernel):
    """Line and direction from the middle of the bar, close and true range (first bar: high - low)."""

    outputs = 2

    def __init__(self, factor: float, n: int):
        self.factor, self.atr, self.first = factor, Rma(n), True
        self.state: tuple[float, float, float, int, float] | None = None

    def one(self, middle: float, close: float, true_range: float):
        atr = self.atr.one(true_range)
        if self.first:
            self.first = False
            return 0.0, 1
        if middle != middle or atr != atr:
            return NAN, self.state[3] if self.state else 1
        upper, lower = middle + self.factor * atr, middle - self.factor * atr
        if self.state is None:
            self.state = (lower, upper, close, 1, upper)
            return upper, 1
        low1, up1, close1, _, line1 = self.state
        lower = lower if lower > low1 or close1 < low1 else low1
        upper = upper if upper < up1 or close1 > up1 else up1
        on_upper = line1 == up1
        way = (-1 if close > upper else 1) if on_upper else (1 if close < lower else -1)
        line = upper if way == 1 else lower
        self.state = (lower, upper, close, way, line)
        return line, way


class HeikinAshi(Kernel):
    outputs = 4

    def __init__(self):
        self.open = self.close = NAN

    def one(self, o: float, h: float, low: float, c: float):
        close = (o + h + low + c) / 4
        start = (o + c) / 2 if self.open != self.open else (self.open + self.close) / 2
        self.open, self.close = start, close
        return start, max(h, start, close), min(low, start, close), close


class Lcg(Kernel):
    """Numbers of a 48-bit linear congruential generator, one per bar."""

    def __init__(self, low: float, high: float, seed: int):
        self.low, self.high = low, high
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 11) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def one(self, _: float) -> float:
        unit = ((self.bits(26) << 27) + self.bits(27)) / (1 << 53)
        return self.low + (self.high - self.low) * unit


class UserFold(Kernel):
    """A user's step: ``step(state, *values) -> (state, output)``."""

    def __init__(self, start: Callable[[], object], step: Callable):
        self.state, self.step = start(), step

    def one(self, *values: float) -> float:
        self.state, out = self.step(self.state, *values)
        return NAN if out is None else float(out)


def finite(x: float | None) -> float:
    return NAN if x is None or math.isinf(x) else x
