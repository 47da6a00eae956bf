"""Calendar parts, period starts and trading sessions of epoch or timestamp columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.timeframe import parse


def local(ts: Column, timezone: str = "UTC") -> Column:
    return ts if timezone == "UTC" else F.from_utc_timestamp(ts, timezone)


def to_utc(ts: Column, timezone: str = "UTC") -> Column:
    return ts if timezone == "UTC" else F.to_utc_timestamp(ts, timezone)


def year(ts: Column, timezone: str = "UTC") -> Column: return F.year(local(ts, timezone))  # noqa: E704
def month(ts: Column, timezone: str = "UTC") -> Column: return F.month(local(ts, timezone))  # noqa: E704
def weekofyear(ts: Column, timezone: str = "UTC") -> Column: return F.weekofyear(local(ts, timezone))  # noqa: E704
def dayofmonth(ts: Column, timezone: str = "UTC") -> Column: return F.dayofmonth(local(ts, timezone))  # noqa: E704
def dayofweek(ts: Column, timezone: str = "UTC") -> Column: return F.dayofweek(local(ts, timezone))  # noqa: E704
def hour(ts: Column, timezone: str = "UTC") -> Column: return F.hour(local(ts, timezone))  # noqa: E704
def minute(ts: Column, timezone: str = "UTC") -> Column: return F.minute(local(ts, timezone))  # noqa: E704
def second(ts: Column, timezone: str = "UTC") -> Column: return F.second(local(ts, timezone))  # noqa: E704


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def timenow() -> Column:
    return F.unix_millis(F.current_timestamp())


def timestamp(year: Column, month: Column, day: Column, hour: Column | int = 0, minute: Column | int = 0, second: Column | int = 0, timezone: str = "UTC") -> Column:
    """Epoch ms of calendar parts; parts beyond their range carry over (month 13 is January of the next year)."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    months = c(year) * 12 + c(month) - 1
    first = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    days = F.date_add(first, (c(day) - 1).cast("int"))
    base = F.to_timestamp(days) + F.make_dt_interval(F.lit(0), c(hour).cast("int"), c(minute).cast("int"), c(second).cast("decimal(18,6)"))
    return F.unix_millis(to_utc(base, timezone))


def timestamp_text(text: Column) -> Column:
    """Epoch ms of a date text."""
    return F.unix_millis(F.coalesce(F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm", "dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm", "dd MMM yyyy"))))


class Interval(NamedTuple):
    """Weekly trading hours: day 0 is Monday; an end at or before the start is on the next day."""

    day: int
    start: str  # HH:MM
    end: str


def _minutes(text: str) -> int:
    h, m = text.split(":")[:2]
    return int(h) * 60 + int(m)


def session_intervals(text: str) -> list[Interval]:
    """Intervals of a session text such as ``0930-1600:23456`` (1 is Sunday; no days: every day), comma-separated."""
    out = []
    if text in ("24x7", ""):
        return [Interval(d, "00:00", "00:00") for d in range(7)]
    for part in text.split(","):
        hours, _, days = part.partition(":")
        a, _, b = hours.partition("-")
        for d in days or "1234567":
            out.append(Interval((int(d) + 5) % 7, f"{a[:2]}:{a[2:]}", f"{b[:2]}:{b[2:]}"))
    return out


def _week_minute(ts: Column, timezone: str) -> Column:
    t = local(ts, timezone)
    return F.weekday(t) * 1440 + F.hour(t) * 60 + F.minute(t)


def _spans(intervals: list[Interval]) -> list[tuple[int, int]]:
    out = []
    for i in intervals:
        a, b = i.day * 1440 + _minutes(i.start), i.day * 1440 + _minutes(i.end)
        out.append((a, b if b > a else b + 1440))
    return out


def in_session(ts: Column, intervals: list[Interval], timezone: str = "UTC") -> Column:
    """Whether a time lies in a session (overnight sessions and the turn of the week included)."""
    m = _week_minute(ts, timezone)
    out = F.lit(False)
    for a, b in _spans(intervals):
        out = out | ((m >= a) & (m < b)) | ((m + 10_080 >= a) & (m + 10_080 < b))
    return out


def ismarket(ts: Column, bar_seconds: int, intervals: list[Interval], timezone: str = "UTC") -> Column:
    """Whether the bar overlaps a session."""
    m, n = _week_minute(ts, timezone), max(1, bar_seconds // 60)
    out = F.lit(False)
    for a, b in _spans(intervals):
        for shift in (-10_080, 0, 10_080):
            out = out | ((m + shift < b) & (m + shift + n > a))
    return out


def holds_instant(ts: Column, bar_seconds: int, instants: list[int], timezone: str, closed_right: bool = False) -> Column:
    """Whether the bar holds one of the weekly instants (minutes of the week)."""
    m, n = _week_minute(ts, timezone), max(1, bar_seconds // 60)
    out = F.lit(False)
    for at in instants:
        for shift in (-10_080, 0, 10_080):
            if closed_right:
                out = out | ((m + shift < at) & (m + shift + n >= at))
            else:
                out = out | ((m + shift <= at) & (m + shift + n > at))
    return out


def isfirstbar(ts: Column, bar_seconds: int, intervals: list[Interval], timezone: str = "UTC") -> Column:
    return holds_instant(ts, bar_seconds, [a for a, _ in _spans(intervals)], timezone)


def islastbar(ts: Column, bar_seconds: int, intervals: list[Interval], timezone: str = "UTC") -> Column:
    return holds_instant(ts, bar_seconds, [b for _, b in _spans(intervals)], timezone, closed_right=True)


isfirstbar_regular, islastbar_regular = isfirstbar, islastbar


def ispremarket() -> Column:
    return F.lit(False)


ispostmarket = ispremarket


def overnight_minutes(intervals: list[Interval]) -> int:
    """Minutes to add so that an evening open belongs to the next day's trading day."""
    late = [_minutes(i.start) for i in intervals if _minutes(i.end) <= _minutes(i.start) and _minutes(i.start) >= 720]
    return 1440 - min(late) if late else 0


def trading_day(ts: Column, intervals: list[Interval] | None = None, timezone: str = "UTC") -> Column:
    """The date of the trading day; an overnight session belongs to the day on which it ends."""
    roll = overnight_minutes(intervals or [])
    return F.to_date(local(ts, timezone) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(roll)))


def time_tradingday(ts: Column, intervals: list[Interval] | None = None, timezone: str = "UTC") -> Column:
    """00:00 UTC of the trading day, in epoch ms."""
    return F.unix_millis(F.to_timestamp(trading_day(ts, intervals, timezone)))


def first_monday(y: Column) -> Column:
    jan = F.make_date(y, F.lit(1), F.lit(1))
    return F.date_add(jan, F.pmod(-F.weekday(jan), F.lit(7)).cast("int"))


def weekdays_before(d: Column) -> Column:
    """Number of weekdays (Monday to Friday) of the year before a date."""
    jan = F.make_date(F.year(d), F.lit(1), F.lit(1))
    count = lambda x: F.floor(F.datediff(x, F.lit("1970-01-05").cast("date")) / 7) * 5 + F.least(F.pmod(F.datediff(x, F.lit("1970-01-05").cast("date")), F.lit(7)), F.lit(5))
    return (count(d) - count(jan)).cast("int")


def _weekday_of_year(y: Column, n: Column) -> Column:
    """The date of the n-th (0-based) weekday of a year."""
    jan = F.make_date(y, F.lit(1), F.lit(1))
    lead = F.weekday(jan)
    start = F.when(lead > 4, F.date_add(jan, (F.lit(7) - lead).cast("int"))).otherwise(jan)
    k = n + F.weekday(start)
    return F.date_add(start, (F.floor(k / 5) * 7 + k % 5 - F.weekday(start)).cast("int"))


def period_day(day: Column, timeframe: str, weekday_grid: bool = False) -> Column:
    """First day of the D, W or M period that holds a trading day; multiples count anew each year."""
    tf = parse(timeframe)
    n = tf.count
    y = F.year(day)
    if tf.unit == "D":
        if n == 1:
            return day
        if weekday_grid:
            return _weekday_of_year(y, F.floor(weekdays_before(day) / n) * n)
        return F.date_add(F.make_date(y, F.lit(1), F.lit(1)), (F.floor((F.dayofyear(day) - 1) / n) * n).cast("int"))
    if tf.unit == "W":
        monday = F.date_sub(day, F.weekday(day))
        if n == 1:
            return monday
        first = first_monday(F.year(monday))
        return F.date_add(first, (F.floor(F.datediff(monday, first) / 7 / n) * n * 7).cast("int"))
    start = F.make_date(y, (F.floor((F.month(day) - 1) / n) * n + 1).cast("int"), F.lit(1))
    return F.when(F.weekday(start) > 4, F.date_add(start, (F.lit(7) - F.weekday(start)).cast("int"))).otherwise(start) if weekday_grid and n > 1 else start


def bucket(ts: Column, timeframe: str, timezone: str = "UTC", intervals: list[Interval] | None = None, anchor_sessions: bool = False, weekday_grid: bool | None = None) -> Column:
    """Open time (timestamp) of the bar of a timeframe that holds a time.

    Intraday bars lie on the UTC clock, or count from the session's open with ``anchor_sessions``; days, weeks and months
    follow the calendar of the time zone, or the trading days when ``intervals`` are given.
    """
    tf = parse(timeframe)
    roll = overnight_minutes(intervals or [])
    if tf.isintraday:
        size = tf.seconds
        if not (anchor_sessions and intervals):
            return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / size) * size)
        start = day_open(trading_day(ts, intervals, timezone), intervals, timezone)
        start = F.when(start <= ts, start).otherwise(start - F.expr("INTERVAL 1 DAY"))
        return F.timestamp_seconds(F.unix_seconds(start) + F.floor((F.unix_seconds(ts) - F.unix_seconds(start)) / size) * size)
    if weekday_grid is None:
        weekday_grid = bool(intervals) and len({i.day for i in intervals}) < 7
    return day_open(period_day(trading_day(ts, intervals, timezone), timeframe, weekday_grid), intervals, timezone)


def day_open(day: Column, intervals: list[Interval] | None, timezone: str = "UTC") -> Column:
    """The instant at which a trading day opens: its midnight, or its session's open (the evening before, if overnight)."""
    if not intervals:
        return to_utc(F.to_timestamp(day), timezone)
    opens: dict[int, int] = {}
    for i in intervals:
        start, overnight = _minutes(i.start), _minutes(i.end) <= _minutes(i.start)
        late = overnight and start >= 720
        day_of = (i.day + 1) % 7 if late else i.day
        opens[day_of] = min(opens.get(day_of, 1440), start - 1440 if late else start)
    minutes = F.lit(min(opens.values()))
    for weekday, start in opens.items():
        minutes = F.when(F.weekday(day) == weekday, F.lit(start)).otherwise(minutes)
    return to_utc(F.to_timestamp(day) + F.make_dt_interval(F.lit(0), F.lit(0), minutes), timezone)


def bucket_end(start: Column, timeframe: str, timezone: str = "UTC", intervals: list[Interval] | None = None, weekday_grid: bool = False) -> Column:
    """The instant at which a bar that opens at ``start`` ends.

    Calendar periods end where the next one begins, so multiples are cut at the turn of the year, as they count anew there;
    an intraday bar that opens in a session ends with the session at the latest.
    """
    tf = parse(timeframe)
    n = tf.count
    if tf.isintraday:
        end = F.unix_seconds(start) + tf.seconds
        m = _week_minute(start, timezone)
        for a, b in _spans(intervals or []):
            for shift in (0, 10_080):
                inside = (m + shift >= a) & (m + shift < b)
                end = F.when(inside, F.least(end, F.unix_seconds(F.date_trunc("minute", start)) + (F.lit(b) - m - shift) * 60)).otherwise(end)
        return F.timestamp_seconds(end)
    t = local(start, timezone)
    day = F.to_date(t)
    y = F.year(day)
    if tf.unit == "D":
        end = F.date_add(day, n) if n == 1 else F.least(F.date_add(day, n), F.make_date(y + 1, F.lit(1), F.lit(1)))
        if weekday_grid and n > 1:
            end = F.least(_weekday_of_year(y, weekdays_before(day) + n), _weekday_of_year(y + 1, F.lit(0)))
    elif tf.unit == "W":
        end = F.date_add(day, 7) if n == 1 else F.least(F.date_add(day, 7 * n), first_monday(y + 1))
    else:
        end = F.add_months(F.trunc(day, "month"), n)
        end = end if n == 1 else F.least(end, F.make_date(y + 1, F.lit(1), F.lit(1)))
        if weekday_grid and n > 1:
            end = F.when(F.weekday(end) > 4, F.date_add(end, (F.lit(7) - F.weekday(end)).cast("int"))).otherwise(end)
        elif n == 1:
            end = F.date_add(end, F.dayofmonth(day) - 1)
    return to_utc(F.to_timestamp(end) + (t - F.date_trunc("day", t)), timezone)


def time(ts: Column, timeframe: str, session: str | None = None, timezone: str = "UTC") -> Column:
    """Epoch ms of the open of the bar on a timeframe; null outside the session."""
    value = F.unix_millis(bucket(ts, timeframe, timezone))
    return F.when(in_session(ts, session_intervals(session), timezone), value) if session else value


def time_close(ts: Column, timeframe: str, session: str | None = None, timezone: str = "UTC") -> Column:
    value = F.unix_millis(bucket_end(bucket(ts, timeframe, timezone), timeframe, timezone))
    return F.when(in_session(ts, session_intervals(session), timezone), value) if session else value
