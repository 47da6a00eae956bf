"""Order-fill simulator of one symbol: pure Python state, driven bar by bar."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

NAN = float("nan")
LONG, SHORT = 1, -1


@dataclass(frozen=True)
class Settings:
    initial_capital: float = 1_000_000.0
    pyramiding: int = 1
    qty_type: str = "fixed"  # fixed, cash, percent_of_equity
    qty_value: float = 1.0
    commission_type: str = "percent"  # percent, cash_per_contract, cash_per_order
    commission_value: float = 0.0
    slippage: int = 0
    mintick: float = 0.01
    pointvalue: float = 1.0
    mincontract: float = 1e-6
    margin_long: float = 0.0
    margin_short: float = 0.0
    process_orders_on_close: bool = False
    close_entries_rule: str = "FIFO"  # or ANY
    fill_limits_assumption: int = 0
    currency: str = "USD"


@dataclass
class Order:
    id: str
    kind: str  # entry, order, exit, close
    direction: int
    qty: float | None = None
    limit: float | None = None
    stop: float | None = None
    oca_name: str | None = None
    oca_type: str = "none"  # none, cancel, reduce
    from_entry: str | None = None
    qty_percent: float | None = None
    profit: float | None = None
    loss: float | None = None
    trail_price: float | None = None
    trail_points: float | None = None
    trail_offset: float | None = None
    comment: str | None = None
    placed: int = -1
    triggered: bool = False
    marks: dict[int, float] = field(default_factory=dict)
    used: dict[int, float] = field(default_factory=dict)


@dataclass
class Trade:
    number: int
    entry_id: str
    direction: int
    size: float
    entry_price: float
    entry_time: object
    entry_bar: int
    commission: float
    entry_comment: str | None = None
    original: float = 0.0
    max_runup: float = 0.0
    max_drawdown: float = 0.0
    exit_id: str | None = None
    exit_price: float | None = None
    exit_time: object = None
    exit_bar: int | None = None
    exit_comment: str | None = None
    profit: float = 0.0


class Broker:
    """What a strategy sees while it runs: orders in, position and results out."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.orders: dict[tuple, Order] = {}
        self.open: list[Trade] = []
        self.fresh: list[Trade] = []
        #: what the strategy records on a bar; a column of the bar's event
        self.records: dict[str, float] = {}
        self.realised = self.fees = self.gross_profit = self.gross_loss = 0.0
        self.wins = self.losses = self.evens = self.margin_calls = self.serial = 0
        self.peak = self.trough = settings.initial_capital
        self.max_drawdown = self.max_runup = self.max_contracts = 0.0
        self.bar_index, self.time, self.price = -1, None, NAN
        self.immediate: list[Order] = []
        self.rules: dict[str, tuple] = {}
        self.halted = self.day_halted = False
        self.day, self.day_fills, self.day_start, self.loss_days = None, 0, settings.initial_capital, 0

    # -- orders ----------------------------------------------------------------------------------------------------

    def entry(self, id: str, direction: int, qty: float | None = None, limit: float | None = None, stop: float | None = None, oca_name: str | None = None, oca_type: str = "none", comment: str | None = None) -> None:
        if not self.halted:
            self._put(Order(id, "entry", direction, qty, limit, stop, oca_name, oca_type, comment=comment))

    def order(self, id: str, direction: int, qty: float | None = None, limit: float | None = None, stop: float | None = None, oca_name: str | None = None, oca_type: str = "none", comment: str | None = None) -> None:
        if not self.halted:
            self._put(Order(id, "order", direction, qty, limit, stop, oca_name, oca_type, comment=comment))

    def exit(self, id: str, from_entry: str | None = None, qty: float | None = None, qty_percent: float | None = None, profit: float | None = None, limit: float | None = None, loss: float | None = None, stop: float | None = None, trail_price: float | None = None, trail_points: float | None = None, trail_offset: float | None = None, comment: str | None = None) -> None:
        """A bracket on the open and coming trades of an entry (all entries without one)."""
        if all(x is None for x in (profit, limit, loss, stop)) and (trail_offset is None or (trail_price is None and trail_points is None)):
            return
        new = Order(id, "exit", 0, qty, limit, stop, None, "reduce", from_entry, qty_percent, profit, loss, trail_price, trail_points, trail_offset, comment)
        old = self.orders.get(("exit", id, from_entry))
        if old:
            same = (old.trail_price, old.trail_points, old.trail_offset) == (trail_price, trail_points, trail_offset)
            new.marks = old.marks if same else {}
            new.used = old.used
        self._put(new)

    def close(self, id: str, qty: float | None = None, qty_percent: float | None = None, comment: str | None = None, immediately: bool = False) -> None:
        """Market exit of the trades of an entry."""
        size = sum(t.size for t in self.open if t.entry_id == id)
        if size:
            side = next(t.direction for t in self.open if t.entry_id == id)
            amount = min(size, qty if qty is not None else size * (100.0 if qty_percent is None else qty_percent) / 100)
            self._market_exit(Order(f"Close entry(s) order {id}", "close", -side, amount, from_entry=id, comment=comment), immediately)

    def close_all(self, comment: str | None = None, immediately: bool = False) -> None:
        if self.open:
            self._market_exit(Order("Close position order", "close", -self.open[0].direction, abs(self.position_size), comment=comment), immediately)

    def _market_exit(self, order: Order, immediately: bool) -> None:
        order.placed = self.bar_index
        if immediately:
            self.immediate.append(order)
        else:
            self.orders[("close", order.id, order.from_entry)] = order

    def cancel(self, id: str) -> None:
        for key in [k for k in self.orders if k[1] == id]:
            del self.orders[key]

    def cancel_all(self) -> None:
        self.orders.clear()

    def _put(self, order: Order) -> None:
        order.placed = self.bar_index
        self.orders[(order.kind, order.id, order.from_entry)] = order

    # -- risk rules ------------------------------------------------------------------------------------------------

    def allow_entry_in(self, direction: int) -> None: self.rules["allow"] = (direction,)  # noqa: E704
    def risk_max_drawdown(self, value: float, kind: str = "percent_of_equity") -> None: self.rules["drawdown"] = (value, kind)  # noqa: E704
    def max_cons_loss_days(self, count: int) -> None: self.rules["loss_days"] = (count,)  # noqa: E704
    def max_intraday_filled_orders(self, count: int) -> None: self.rules["fills"] = (count,)  # noqa: E704
    def max_intraday_loss(self, value: float, kind: str = "percent_of_equity") -> None: self.rules["day_loss"] = (value, kind)  # noqa: E704
    def max_position_size(self, contracts: float) -> None: self.rules["size"] = (contracts,)  # noqa: E704

    # -- results ---------------------------------------------------------------------------------------------------

    @property
    def position_size(self) -> float: return sum(t.size * t.direction for t in self.open)  # noqa: E704

    @property
    def position_avg_price(self) -> float:
        size = sum(t.size for t in self.open)
        return sum(t.size * t.entry_price for t in self.open) / size if size else NAN

    @property
    def position_entry_name(self) -> str | None: return self.open[0].entry_id if self.open else None  # noqa: E704

    def openprofit_at(self, price: float) -> float:
        return sum((price - t.entry_price) * t.direction * t.size * self.s.pointvalue for t in self.open)

    @property
    def openprofit(self) -> float: return self.openprofit_at(self.price) if self.open else 0.0  # noqa: E704

    @property
    def equity(self) -> float: return self.s.initial_capital + self.realised + self.openprofit  # noqa: E704

    @property
    def capital_held(self) -> float:
        return sum(t.size * self.price * self.s.pointvalue * (self.s.margin_long if t.direction > 0 else self.s.margin_short) / 100 for t in self.open)

    def margin_liquidation_price(self) -> float:
        """Price at which a margin call fires, on the tick grid (down for long, up for short positions); na without a position or margin."""
        size = self.position_size
        ratio = (self.s.margin_long if size > 0 else self.s.margin_short) / 100
        side = math.copysign(1, size)
        scale = abs(size) * self.s.pointvalue
        if not size or ratio <= 0 or scale * (side - ratio) == 0:
            return NAN
        price = (side * scale * self.position_avg_price - self.s.initial_capital - self.realised) / (scale * (side - ratio))
        ticks = round(price / self.s.mintick, 7)
        return (math.floor(ticks) if size > 0 else math.ceil(ticks)) * self.s.mintick

    def profit_of(self, t: Trade) -> float:
        """Profit of an open trade at the last price, its entry's fee paid."""
        return (self.price - t.entry_price) * t.direction * t.size * self.s.pointvalue - t.commission

    def record(self, **values: float) -> None:
        """Keep numbers of this bar in its event (column ``records``)."""
        self.records |= {k: float(v) for k, v in values.items()}

    def of_capital(self, value: float) -> float: return value / self.s.initial_capital * 100 if self.s.initial_capital else 0.0  # noqa: E704

    closedtrades = property(lambda b: b.wins + b.losses + b.evens)
    opentrades = property(lambda b: len(b.open))
    wintrades = property(lambda b: b.wins)
    losstrades = property(lambda b: b.losses)
    eventrades = property(lambda b: b.evens)
    initial_capital = property(lambda b: b.s.initial_capital)
    netprofit = property(lambda b: b.realised)
    grossprofit = property(lambda b: b.gross_profit)
    #: the fees of open trades are losses already
    grossloss = property(lambda b: b.gross_loss + sum(t.commission for t in b.open))
    netprofit_percent = property(lambda b: b.of_capital(b.realised))
    openprofit_percent = property(lambda b: b.of_capital(b.openprofit))
    grossprofit_percent = property(lambda b: b.of_capital(b.grossprofit))
    grossloss_percent = property(lambda b: b.of_capital(b.grossloss))
    max_drawdown_percent = property(lambda b: b.of_capital(b.max_drawdown))
    max_runup_percent = property(lambda b: b.of_capital(b.max_runup))
    avg_trade = property(lambda b: b.realised / b.closedtrades if b.closedtrades else NAN)
    avg_winning_trade = property(lambda b: b.gross_profit / b.wins if b.wins else NAN)
    avg_losing_trade = property(lambda b: b.gross_loss / b.losses if b.losses else NAN)
    account_currency = property(lambda b: b.s.currency)

    # -- fills -----------------------------------------------------------------------------------------------------

    def tick(self, price: float) -> float:
        return round(math.floor(price / self.s.mintick + 0.5) * self.s.mintick, 12)

    def lots(self, qty: float) -> float:
        step = self.s.mincontract
        return round(math.floor(qty / step + 1e-9) * step, 12)

    def fee(self, qty: float, price: float, share: float = 1.0) -> float:
        s = self.s
        return {"percent": qty * price * s.pointvalue * s.commission_value / 100, "cash_per_contract": qty * s.commission_value, "cash_per_order": s.commission_value * share}[s.commission_type]

    def default_qty(self, price: float) -> float:
        s = self.s
        if s.qty_type == "fixed":
            return s.qty_value
        money = s.qty_value if s.qty_type == "cash" else self.equity * s.qty_value / 100
        cost = price * s.pointvalue * (1 + (s.commission_value / 100 if s.commission_type == "percent" else 0))
        return self.lots(money / cost) if cost > 0 else 0.0

    def fill(self, key: tuple, price: float, slip: bool, qty: float | None = None, comment: str | None = None, bound: Trade | None = None) -> None:
        """Execute an order at a price; slippage is against it."""
        o = self.orders.get(key) if key else None
        if o is None:
            return
        self.execute(o, price, slip, qty, comment, bound)
        if o.kind != "exit":
            self.orders.pop(key, None)
        elif o.from_entry is None or not any(t.entry_id == o.from_entry for t in self.open):
            if not self.open:
                self.orders.pop(key, None)
        if o.oca_name:
            for k in [k for k, x in self.orders.items() if x.oca_name == o.oca_name and x is not o]:
                if o.oca_type == "cancel":
                    del self.orders[k]
                elif o.oca_type == "reduce" and self.orders[k].qty is not None:
                    self.orders[k].qty -= o.qty or 0
                    if self.orders[k].qty <= 1e-12:
                        del self.orders[k]

    def execute(self, o: Order, price: float, slip: bool, qty: float | None = None, comment: str | None = None, bound: Trade | None = None) -> None:
        direction = o.direction or (-bound.direction if bound else -1)
        price = self.tick(price + (self.s.slippage * self.s.mintick * direction if slip else 0))
        position = self.position_size
        if o.kind in ("exit", "close"):
            self.reduce(o, qty if qty is not None else o.qty or abs(position), price, direction, comment, bound)
            self.counted()
            return
        size = o.qty if o.qty is not None else self.default_qty(price)
        size = self.lots(size)
        if o.kind == "entry":
            if position * direction > 0 and len(self.open) >= max(1, self.s.pyramiding):
                return
            allowed = self.rules.get("allow", (0,))[0]
            if allowed and direction != allowed:
                size = 0.0
            if (self.halted or self.day_halted) and position * direction >= 0:
                return
        if position * direction < 0:
            closing = abs(position) if o.kind == "entry" else min(abs(position), size)
            self.reduce(o, closing, price, direction, comment)
            if o.kind != "entry":
                size -= closing
        if cap := self.rules.get("size"):
            size = min(size, max(0.0, cap[0] - abs(self.position_size)))
        if size > 1e-12 and self.affordable(size, price, direction):
            self.serial += 1
            fee = self.fee(size, price)
            self.fees += fee
            self.realised -= fee
            self.open.append(Trade(self.serial, o.id, direction, size, price, self.time, self.bar_index, fee, o.comment, size))
            self.max_contracts = max(self.max_contracts, abs(self.position_size))
        self.counted()

    def affordable(self, size: float, price: float, direction: int) -> bool:
        ratio = (self.s.margin_long if direction > 0 else self.s.margin_short) / 100
        held = sum(t.size for t in self.open)
        equity = self.s.initial_capital + self.realised + self.openprofit_at(price)
        return not ratio or (size + held) * price * self.s.pointvalue * ratio <= equity + 1e-6 * abs(equity)

    def reduce(self, o: Order, qty: float, price: float, direction: int, comment: str | None = None, bound: Trade | None = None) -> None:
        """Close open trades, first in first out, or those of the entry that the order is bound to."""
        queue = [bound] if bound else [t for t in self.open if self.s.close_entries_rule != "ANY" or not o.from_entry or t.entry_id == o.from_entry]
        left = qty
        for t in queue:
            if left <= 1e-12:
                break
            part = min(left, t.size)
            left -= part
            share = part / t.size
            fee = self.fee(part, price, share)
            entry_fee, runup, drawdown = t.commission * share, t.max_runup * share, t.max_drawdown * share
            gain = (price - t.entry_price) * t.direction * part * self.s.pointvalue
            self.fees += fee
            self.realised += gain - fee
            net = gain - fee - entry_fee
            done = Trade(t.number, t.entry_id, t.direction, part, t.entry_price, t.entry_time, t.entry_bar, entry_fee + fee, t.entry_comment, t.original, max(runup, net), max(drawdown, -net), o.id, price, self.time, self.bar_index, comment or o.comment, net)
            self.fresh.append(done)
            self.wins, self.losses, self.evens = self.wins + (net > 0), self.losses + (net < 0), self.evens + (net == 0)
            self.gross_profit, self.gross_loss = self.gross_profit + max(net, 0.0), self.gross_loss + max(-net, 0.0)
            t.size, t.commission, t.max_runup, t.max_drawdown = t.size - part, t.commission - entry_fee, t.max_runup - runup, t.max_drawdown - drawdown
        self.open = [t for t in self.open if t.size > 1e-12]

    def counted(self) -> None:
        self.day_fills += 1
        if (rule := self.rules.get("fills")) and self.day_fills >= rule[0] and not self.day_halted:
            self.day_halted = True
            self.flatten("Max number of filled orders in one day")

    def flatten(self, why: str) -> None:
        self.orders.clear()
        if self.open:
            self.orders[("close", "risk", None)] = Order(why, "close", -self.open[0].direction, abs(self.position_size), comment=why)

    # -- one bar -----------------------------------------------------------------------------------------------------

    def process(self, time: object, o: float, h: float, low: float, c: float, day: object, sub_bars: Iterable[tuple] | None = None) -> None:
        """Fill the orders of earlier bars on this bar, then mark it."""
        self.bar_index += 1
        self.time = time
        self.fresh = []
        o, h, low, c = map(self.tick, (o, h, low, c))
        if day != self.day:
            self.new_day(day)
        for b in sub_bars or [(o, h, low, c)]:
            self.walk_bar(*map(self.tick, b))
        self.price = c
        self.mark(h, low, c)
        self.guard(c)

    def new_day(self, day: object) -> None:
        if self.day is not None:
            change = self.s.initial_capital + self.realised - self.day_start
            self.loss_days = self.loss_days + 1 if change < 0 else 0 if change > 0 else self.loss_days
            if (rule := self.rules.get("loss_days")) and self.loss_days >= rule[0] and not self.halted:
                self.halted = True
                self.flatten("Max consecutive loss days")
        self.day, self.day_fills, self.day_halted, self.day_start = day, 0, False, self.s.initial_capital + self.realised

    def walk_bar(self, o: float, h: float, low: float, c: float) -> None:
        self.price = o
        self.at_open(o)
        path = [o, h, low, c] if h - o < o - low else [o, low, h, c]
        for k in range(3):
            self.segment(path[k], path[k + 1])
            self.price = path[k + 1]
            if self.open and k < 2:
                self.margin_check(path[k + 1])

    def at_open(self, o: float) -> None:
        """Market orders, and limits and stops that the open has jumped; entries before exits."""
        for wanted in (("entry", "order"), ("close",)):
            for key, x in list(self.orders.items()):
                if x.kind not in wanted or key not in self.orders:
                    continue
                if x.limit is None and x.stop is None:
                    self.fill(key, o, True)
                elif x.stop is not None and not x.triggered and (o - x.stop) * x.direction >= 0:
                    if x.limit is None:
                        self.fill(key, o, True)
                    else:
                        x.triggered = True
                if key in self.orders and x.limit is not None and (x.stop is None or x.triggered) and (x.limit - o) * x.direction >= self.beyond():
                    self.fill(key, o, False)
        for key, t, x in self.legs():
            limit, stop, _ = self.levels(x, t)
            self.follow(x, t, o, o)
            trail = self.trail_stop(x, t)
            hard = [p for p in (stop, trail) if p is not None and (p - o) * t.direction >= 0]
            if hard:
                self.leave(key, t, x, o, True)
            elif limit is not None and (o - limit) * t.direction >= self.beyond():
                self.leave(key, t, x, o, False)
        if self.open:
            self.margin_check(o)

    def beyond(self) -> float:
        return self.s.fill_limits_assumption * self.s.mintick

    def legs(self) -> list[tuple[tuple, Trade, Order]]:
        """Exits with the open trades they are bound to and have not used up."""
        return [(k, t, x) for k, x in list(self.orders.items()) if x.kind == "exit" for t in list(self.open) if x.from_entry in (None, "", t.entry_id) and self.leg_qty(x, t) > 1e-12]

    def leg_qty(self, x: Order, t: Trade) -> float:
        want = x.qty if x.qty is not None else t.original * (100.0 if x.qty_percent is None else x.qty_percent) / 100
        return min(t.size, want - x.used.get(t.number, 0.0))

    def levels(self, x: Order, t: Trade) -> tuple[float | None, float | None, float | None]:
        """Limit, stop and trailing activation of an exit for one trade."""
        m = self.s.mintick * t.direction
        limit = x.limit if x.limit is not None else t.entry_price + x.profit * m if x.profit is not None else None
        stop = x.stop if x.stop is not None else t.entry_price - x.loss * m if x.loss is not None else None
        arm = x.trail_price if x.trail_price is not None else t.entry_price + x.trail_points * m if x.trail_points is not None else None
        return limit, stop, arm if x.trail_offset is not None else None

    def follow(self, x: Order, t: Trade, start: float, end: float) -> None:
        """Arm a trailing stop, or move its mark, as the price goes from start to end."""
        arm = self.levels(x, t)[2]
        if arm is None:
            return
        best = max(start * t.direction, end * t.direction)
        if t.number in x.marks:
            x.marks[t.number] = max(x.marks[t.number], best)
        elif best >= arm * t.direction:
            x.marks[t.number] = best

    def trail_stop(self, x: Order, t: Trade) -> float | None:
        if t.number not in x.marks:
            return None
        return (x.marks[t.number] - int(x.trail_offset) * self.s.mintick) * t.direction

    def leave(self, key: tuple, t: Trade, x: Order, price: float, slip: bool) -> None:
        qty = self.leg_qty(x, t)
        x.used[t.number] = x.used.get(t.number, 0.0) + qty
        self.fill(key, price, slip, qty, bound=t)

    def segment(self, start: float, end: float) -> None:
        """Walk a straight piece of the path; the nearest trigger goes first, and fills may arm new ones."""
        at, up = start, end >= start
        for _ in range(1000):
            best: tuple[float, int, tuple] | None = None
            offer = lambda level, rank, what: (level, rank, what) if (at <= level <= end if up else end <= level <= at) else None
            found = []
            for key, x in self.orders.items():
                if x.kind in ("exit", "close"):
                    continue
                if x.stop is not None and not x.triggered and (x.direction > 0) == up:
                    found.append(offer(x.stop, 0, ("stop", key, None)))
                elif x.limit is not None and (x.stop is None or x.triggered) and (x.direction < 0) == up:
                    level = x.limit - self.beyond() * x.direction
                    found.append(offer(level, 1, ("limit", key, None)))
            for key, t, x in self.legs():
                limit, stop, _ = self.levels(x, t)
                gaining = (t.direction > 0) == up
                if limit is not None and gaining:
                    found.append(offer(limit + self.beyond() * t.direction, 1, ("exit_limit", key, t)))
                if not gaining:
                    self.follow(x, t, at, at)
                    for level in (stop, self.trail_stop(x, t)):
                        if level is not None:
                            found.append(offer(level, 0, ("exit_stop", key, t)))
            hits = [f for f in found if f]
            if not hits:
                break
            best = min(hits, key=lambda f: (abs(f[0] - at), f[1]))
            level, _, (what, key, t) = best
            if (t is None or (t.direction > 0) == up):
                for k2, t2, x2 in self.legs():
                    if (t2.direction > 0) == up and k2:
                        self.follow(x2, t2, at, level)
            at = self.price = level
            x = self.orders[key]
            if what == "stop":
                if x.limit is not None:
                    x.triggered = True
                else:
                    self.fill(key, level, True)
            elif what == "limit":
                self.fill(key, x.limit, False)
            elif what == "exit_limit":
                self.leave(key, t, x, self.levels(x, t)[0], False)
            else:
                self.leave(key, t, x, level, True)
        for _, t, x in self.legs():
            if (t.direction > 0) == up:
                self.follow(x, t, at, end)

    def margin_check(self, price: float) -> None:
        size = self.position_size
        ratio = (self.s.margin_long if size > 0 else self.s.margin_short) / 100
        if not ratio or not size:
            return
        unit = price * self.s.pointvalue
        available = self.s.initial_capital + self.realised + self.openprofit_at(price) - abs(size) * unit * ratio
        if available >= -1e-9:
            return
        cover = self.lots(abs(available) / ratio / unit)
        qty = min(abs(size), max(cover * 4, self.s.mincontract))
        self.margin_calls += 1
        call = Order("Margin call", "close", -1 if size > 0 else 1, qty, comment="Margin call")
        self.reduce(call, qty, self.tick(price), call.direction)

    def mark(self, h: float, low: float, c: float) -> None:
        """Run-up and drawdown of open trades and of the account, with the extremes of the bar."""
        pv = self.s.pointvalue
        for t in self.open:
            best, worst = (h, low) if t.direction > 0 else (low, h)
            t.max_runup = max(t.max_runup, (best - t.entry_price) * t.direction * t.size * pv - t.commission)
            t.max_drawdown = max(t.max_drawdown, (t.entry_price - worst) * t.direction * t.size * pv + t.commission)
        base = self.s.initial_capital + self.realised
        size = self.position_size
        best, worst = (h, low) if size >= 0 else (low, h)
        self.max_drawdown = max(self.max_drawdown, self.peak - (base + self.openprofit_at(worst)))
        self.max_runup = max(self.max_runup, base + self.openprofit_at(best) - self.trough)
        now = base + self.openprofit_at(c)
        self.peak, self.trough = max(self.peak, now), min(self.trough, now)

    def guard(self, c: float) -> None:
        """Rules that are tested when a bar has closed."""
        base = self.s.initial_capital + self.realised
        limit = lambda rule, of: rule[0] if rule[1] == "cash" else of * rule[0] / 100
        now = base + self.openprofit_at(c)
        if (rule := self.rules.get("drawdown")) and not self.halted and self.peak - now >= limit(rule, self.peak):
            self.halted = True
            self.flatten("Max drawdown")
        if (rule := self.rules.get("day_loss")) and not self.day_halted and self.day_start - now >= limit(rule, self.day_start):
            self.day_halted = True
            self.flatten("Max intraday loss")

    def after_body(self, c: float) -> None:
        """Immediate closes, and orders of this bar that may fill at its close."""
        for o in self.immediate:
            self.execute(o, c, True)
        self.immediate = []
        if self.s.process_orders_on_close:
            for key, x in list(self.orders.items()):
                if key not in self.orders or x.placed != self.bar_index or x.kind == "exit":
                    continue
                if x.limit is None and x.stop is None or x.stop is not None and x.limit is None and (c - x.stop) * x.direction >= 0:
                    self.fill(key, c, True)
                elif x.limit is not None and x.stop is None and (x.limit - c) * x.direction >= 0:
                    self.fill(key, c, False)
