"""Lazy series over bars, and the planner that turns them into one DataFrame plan.

A series is a node: a scalar expression (inlined), a window expression (one projection per layer, so that
all windows of a layer share one sort), or an output of a fold (a sequential kernel).  The planner resolves all windows it can before it runs a fold
pass, and one fold pass runs every kernel that is ready: four exponential averages are one pass, not four.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-10
Number = int | float


class Series:
    """One column with history, evaluated bar by bar within each symbol."""

    _numbers = itertools.count()

    def __init__(self, chart: Chart, kind: str, make: Any, inputs: tuple[Series, ...] = (), output: int = 0):
        self.chart, self.kind, self.make, self.inputs, self.output = chart, kind, make, inputs, output
        self.number = next(self._numbers)

    def map(self, make: Callable[..., Column], *others: Any) -> Series:
        """A scalar expression of this series and others."""
        return self.chart.scalar(make, self, *others)

    def window(self, make: Callable[..., Column], *others: Any) -> Series:
        """An expression with window functions over this series and others."""
        return self.chart.windowed(make, self, *others)

    def __getitem__(self, back: int) -> Series:
        """The value ``back`` bars ago; null before the first bar."""
        if back == 0:
            return self
        return self.window(lambda x: F.lag(x, int(back)).over(self.chart.over()))

    def __add__(self, o): return self.map(lambda a, b: a + b, o)  # noqa: E704
    def __radd__(self, o): return self.map(lambda a, b: b + a, o)  # noqa: E704
    def __sub__(self, o): return self.map(lambda a, b: a - b, o)  # noqa: E704
    def __rsub__(self, o): return self.map(lambda a, b: b - a, o)  # noqa: E704
    def __mul__(self, o): return self.map(lambda a, b: a * b, o)  # noqa: E704
    def __rmul__(self, o): return self.map(lambda a, b: b * a, o)  # noqa: E704
    def __truediv__(self, o): return self.map(lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), o)  # noqa: E704
    def __rtruediv__(self, o): return self.map(lambda a, b: F.try_divide(b.cast("double"), a.cast("double")), o)  # noqa: E704
    def __neg__(self): return self.map(lambda a: -a)  # noqa: E704
    def __abs__(self): return self.map(F.abs)  # noqa: E704
    def __gt__(self, o): return self.map(lambda a, b: yes(a - b > EPSILON), o)  # noqa: E704
    def __lt__(self, o): return self.map(lambda a, b: yes(b - a > EPSILON), o)  # noqa: E704
    def __ge__(self, o): return self.map(lambda a, b: yes(b - a <= EPSILON), o)  # noqa: E704
    def __le__(self, o): return self.map(lambda a, b: yes(a - b <= EPSILON), o)  # noqa: E704
    def eq(self, o): return self.map(lambda a, b: yes(F.abs(a - b) <= EPSILON), o)  # noqa: E704
    def ne(self, o): return self.map(lambda a, b: yes(F.abs(a - b) > EPSILON), o)  # noqa: E704
    def __and__(self, o): return self.map(lambda a, b: yes(a) & yes(b), o)  # noqa: E704
    def __or__(self, o): return self.map(lambda a, b: yes(a) | yes(b), o)  # noqa: E704
    def __invert__(self): return self.map(lambda a: ~yes(a))  # noqa: E704

    def where(self, then: Any, otherwise: Any = None) -> Series:
        """``then`` on the bars where this condition holds, else ``otherwise`` (both are always evaluated)."""
        return self.map(lambda c, a, b: F.when(yes(c), a).otherwise(b), then, otherwise)


def yes(c: Column) -> Column:
    """A condition in which na is false."""
    return F.coalesce(c, F.lit(False))


class Chart:
    """Bars of one or many symbols, keyed by symbol and time, each pair once."""

    def __init__(self, bars: DataFrame, key: str = "symbol", time: str = "time", mintick: float = 1e-5):
        self.bars, self.key, self.time_name, self.mintick = bars, key, time, mintick
        self._sources: dict[str, Series] = {}

    def over(self, n: int | None = None) -> WindowSpec:
        """Rows of a symbol in time order; the last ``n`` of them; all up to the current one for n = 0."""
        w = Window.partitionBy(self.key).orderBy(self.time_name)
        return w if n is None else w.rowsBetween(Window.unboundedPreceding if n == 0 else -(n - 1), Window.currentRow)

    def compact(self, x: Column, n: int) -> WindowSpec:
        """The last ``n`` bars on which x is not null."""
        return Window.partitionBy(self.key, x.isNull()).orderBy(self.time_name).rowsBetween(-(n - 1), Window.currentRow)

    def __getitem__(self, name: str) -> Series:
        if name not in self._sources:
            self._sources[name] = Series(self, "source", name)
        return self._sources[name]

    def __getattr__(self, name: str) -> Series:
        if name.startswith("_"):
            raise AttributeError(name)
        derived = {
            "hl2": lambda: (self["high"] + self["low"]) / 2.0,
            "hlc3": lambda: (self["high"] + self["low"] + self["close"]) / 3.0,
            "ohlc4": lambda: (self["open"] + self["high"] + self["low"] + self["close"]) / 4.0,
            "hlcc4": lambda: (self["high"] + self["low"] + self["close"] * 2.0) / 4.0,
            "time": lambda: self[self.time_name],
            "bar_index": lambda: self.windowed(lambda: F.row_number().over(self.over()).cast("long") - 1),
            "last_bar_index": lambda: self.windowed(lambda: F.count(F.lit(1)).over(Window.partitionBy(self.key)) - 1),
            "bid": lambda: self.value(None),
            "ask": lambda: self.value(None),
        }
        if name in derived:
            if name not in self._sources:
                self._sources[name] = derived[name]()
            return self._sources[name]
        if name in self.bars.columns:
            return self[name]
        raise AttributeError(name)

    def value(self, x: Any) -> Series:
        return x if isinstance(x, Series) else Series(self, "scalar", lambda: F.lit(x) if x is not None else F.lit(None).cast("double"))

    def scalar(self, make: Callable[..., Column], *inputs: Any) -> Series:
        return Series(self, "scalar", make, tuple(map(self.value, inputs)))

    def windowed(self, make: Callable[..., Column], *inputs: Any) -> Series:
        return Series(self, "window", make, tuple(map(self.value, inputs)))

    def fold(self, kernel: Callable[[], Any], *inputs: Any, outputs: int = 1) -> Series | tuple[Series, ...]:
        """Outputs of a sequential kernel: an object whose ``push(*arrays)`` continues where the last call ended."""
        shared = Fold(kernel, tuple(map(self.value, inputs)), outputs)
        found = tuple(Series(self, "fold", shared, shared.inputs, i) for i in range(outputs))
        return found[0] if outputs == 1 else found

    def barstate(self) -> dict[str, Series]:
        """Flags of historical bars: all of them are confirmed history."""
        first = self.bar_index.map(lambda i: i == 0)
        last = self.scalar(lambda i, n: i == n, self.bar_index, self.last_bar_index)
        const = {"isconfirmed": True, "ishistory": True, "isrealtime": False, "isnew": True}
        return {"isfirst": first, "islast": last, "islastconfirmedhistory": last} | {k: self.value(v) for k, v in const.items()}

    def select(self, keep: tuple[str, ...] = (), **plots: Series) -> DataFrame:
        """One row per bar with the key, the time, ``keep`` and one column per plot."""
        return Planner(self).run(plots, keep)

    def max_bars_back(self, series: Series, n: int) -> Series:
        """Series have no horizon here; the number is only checked against the largest that scripts may ask for."""
        if not 0 < n <= 5000:
            raise ValueError(f"max_bars_back must be between 1 and 5000, not {n}")
        return series

    def visible_bounds(self) -> DataFrame:
        """First and last bar time of each symbol, which stand for the ends of the viewport."""
        return self.bars.groupBy(self.key).agg(F.min(self.time_name).alias("left_visible_bar_time"), F.max(self.time_name).alias("right_visible_bar_time"))

    def last_bars(self, n: int) -> Chart:
        """Only the last ``n`` bars of each symbol: series start fresh, bar_index stays absolute as ``absolute_index``."""
        down = Window.partitionBy(self.key).orderBy(F.col(self.time_name).desc())
        up = Window.partitionBy(self.key).orderBy(self.time_name)
        bars = self.bars.withColumn("absolute_index", F.row_number().over(up).cast("long") - 1).withColumn("__back", F.row_number().over(down)).where(F.col("__back") <= n).drop("__back")
        return Chart(bars, self.key, self.time_name, self.mintick)


class Fold:
    """A kernel with its inputs, shared by the series of its outputs."""

    def __init__(self, kernel: Callable[[], Any], inputs: tuple[Series, ...], outputs: int):
        self.kernel, self.inputs, self.outputs = kernel, inputs, outputs


class Planner:
    def __init__(self, chart: Chart):
        self.chart, self.df, self.columns = chart, chart.bars, {}
        self.names = itertools.count()

    def ordered(self, roots: list[Series]) -> list[Series]:
        out: list[Series] = []
        seen: set[int] = set()
        stack = [(r, False) for r in reversed(roots)]
        while stack:
            node, done = stack.pop()
            if done:
                out.append(node)
            elif node.number not in seen:
                seen.add(node.number)
                stack.append((node, True))
                stack += [(i, False) for i in node.inputs]
        return out

    def run(self, plots: dict[str, Series], keep: tuple[str, ...] = ()) -> DataFrame:
        waiting = self.ordered(list(plots.values()))
        done: dict[int, Column] = self.columns
        while waiting:
            ready = lambda s: all(i.number in done for i in s.inputs)
            progress = True
            while progress:
                progress = False
                for s in [s for s in waiting if s.kind in ("source", "scalar") and ready(s)]:
                    done[s.number] = F.col(s.make) if s.kind == "source" else s.make(*(done[i.number] for i in s.inputs))
                    waiting.remove(s)
                    progress = True
            if layer := [s for s in waiting if s.kind == "window" and ready(s)]:
                new = {f"__w{next(self.names)}": s for s in layer}
                self.df = self.df.withColumns({n: s.make(*(done[i.number] for i in s.inputs)) for n, s in new.items()})
                for n, s in new.items():
                    done[s.number] = F.col(n)
                    waiting.remove(s)
                continue
            if layer := [s for s in waiting if s.kind == "fold" and ready(s)]:
                self.fold_pass(layer)
                for s in layer:
                    waiting.remove(s)
                continue
            if waiting and not progress:
                if any(ready(s) for s in waiting):
                    continue
                raise ValueError("the series depend on each other in a circle")
        return self.df.select(self.chart.key, self.chart.time_name, *keep, *(done[s.number].alias(n) for n, s in plots.items()))

    def fold_pass(self, layer: list[Series]) -> None:
        """Run the kernels of a layer in one pass over the bars in time order.

        Batches stream through the kernels, whose state is carried from batch to batch of a symbol, so
        no symbol is ever held in memory as a whole.
        """
        folds = list({id(s.make): s.make for s in layer}.values())
        inputs: dict[int, str] = {}
        for f in folds:
            for i in f.inputs:
                inputs.setdefault(i.number, f"__in{next(self.names)}")
        df = self.df.withColumns({n: self.columns[k].cast("double") for k, n in inputs.items()})
        outs = [[f"__f{next(self.names)}" for _ in range(f.outputs)] for f in folds]
        plan = [(f.kernel, [df.columns.index(inputs[i.number]) for i in f.inputs]) for f in folds]
        names = [n for group in outs for n in group]
        key = df.columns.index(self.chart.key)
        kept = [i for i, n in enumerate(df.columns) if n not in set(inputs.values())]
        schema = T.StructType([df.schema[i] for i in kept] + [T.StructField(n, T.DoubleType()) for n in names])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, kernels = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(key).to_pylist()
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                columns = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for _, cs in plan for c in cs}
                filled = [np.empty(len(keys)) for _ in names]
                for a, b in itertools.pairwise(cuts):
                    if kernels is None or keys[a] != current:
                        current, kernels = keys[a], [k() for k, _ in plan]
                    at = 0
                    for kernel, (_, cs), group in zip(kernels, plan, outs, strict=True):
                        got = kernel.push(*(columns[c][a:b] for c in cs))
                        for part in got if len(group) > 1 else (got,):
                            filled[at][a:b] = part
                            at += 1
                arrays = [batch.column(i) for i in kept] + [pa.array(x, pa.float64(), mask=~np.isfinite(x)) for x in filled]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

        ordered = df.repartition(self.chart.key).sortWithinPartitions(self.chart.key, self.chart.time_name)
        self.df = ordered.mapInArrow(run, schema)
        by_fold = {id(f): group for f, group in zip(folds, outs, strict=True)}
        for s in layer:
            self.columns[s.number] = F.col(by_fold[id(s.make)][s.output])
