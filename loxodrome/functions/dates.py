"""Dates, times and durations, in UTC. Timestamps without a zone are taken as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named formats, and the parts of reference-time layouts, as Spark's patterns.
NAMED = {"RFC3339": "yyyy-MM-dd'T'HH:mm:ssXXX", "ISO8601": "yyyy-MM-dd'T'HH:mm:ssXXX", "date": "yyyy-MM-dd", "time": "HH:mm:ss", "datetime": "yyyy-MM-dd HH:mm:ss"}
LAYOUT = [("2006", "yyyy"), ("January", "MMMM"), ("Jan", "MMM"), ("Monday", "EEEE"), ("Mon", "EEE"), ("15", "HH"), ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("PM", "a"), ("Z07:00", "XXX"), ("MST", "zzz"), ("06", "yy")]

year, month, day, hour, minute, day_of_year, week_of_year, quarter = F.year, F.month, F.dayofmonth, F.hour, F.minute, F.dayofyear, F.weekofyear, F.quarter


def at(ts: Column) -> Column:
    return ts.cast("timestamp")


def second(ts: Column) -> Column:
    return F.second(ts)


def millisecond(ts: Column) -> Column:
    return F.pmod(F.unix_millis(at(ts)), F.lit(1000)).cast("int")


def day_of_week(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1


def to_unix(ts: Column) -> Column:
    return F.unix_seconds(at(ts))


def to_unix_millis(ts: Column) -> Column:
    return F.unix_millis(at(ts))


def to_iso8601(ts: Column) -> Column:
    return F.date_format(at(ts), NAMED["RFC3339"])


def pattern_of(layout: str) -> str:
    """Spark's pattern of a named format or a reference-time layout."""
    if layout in NAMED:
        return NAMED[layout]
    out, i = "", 0
    while i < len(layout):
        for token, spark in LAYOUT:
            if layout.startswith(token, i):
                out, i = out + spark, i + len(token)
                break
        else:
            out, i = out + (f"'{layout[i]}'" if layout[i].isalpha() else layout[i]), i + 1
    return out.replace("''", "")


def format_(ts: Column, layout: str) -> Column:
    return F.date_format(at(ts), pattern_of(layout))


def parse(s: Column, layout: str) -> Column:
    """A result: the time, or an error."""
    t = F.try_to_timestamp(s, F.lit(pattern_of(layout)))
    return F.struct(t.isNotNull().alias("ok"), t.alias("value"), F.when(t.isNull(), F.concat(F.lit("cannot parse time: "), F.coalesce(s, F.lit("nil")))).alias("err"))


def is_before(a: Column, b: Column) -> Column:
    return at(a) < at(b)


def is_after(a: Column, b: Column) -> Column:
    return at(a) > at(b)


def is_between(t: Column, a: Column, b: Column) -> Column:
    return at(t).between(at(a), at(b))


def _moved(ts: Column, year_: Column, month_: Column, day_: Column) -> Column:
    """The time of day of ts on this date; months and days over their ends run on."""
    start = F.add_months(F.make_date(F.lit(2000), F.lit(1), F.lit(1)), ((year_ - 2000) * 12 + month_ - 1).cast("int"))
    date = F.date_add(start, (day_ - 1).cast("int"))
    micros = F.unix_micros(at(ts)) - F.unix_micros(F.date_trunc("DAY", at(ts)))
    return F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + micros)


def with_year(ts: Column, y) -> Column:
    return _moved(ts, F.lit(y), F.month(ts), F.dayofmonth(ts))


def with_month(ts: Column, m) -> Column:
    return _moved(ts, F.year(ts), F.lit(m), F.dayofmonth(ts))


def with_day(ts: Column, d) -> Column:
    return _moved(ts, F.year(ts), F.month(ts), F.lit(d))


def start_of_day(ts: Column) -> Column:
    return F.date_trunc("DAY", at(ts))


def end_of_day(ts: Column) -> Column:
    """The last microsecond of the day."""
    return F.timestamp_micros(F.unix_micros(F.date_trunc("DAY", at(ts))) + F.lit(86_400_000_000 - 1))


def start_of_month(ts: Column) -> Column:
    return F.date_trunc("MONTH", at(ts))


def start_of_year(ts: Column) -> Column:
    return F.date_trunc("YEAR", at(ts))


def date(y: Column, m: Column, d: Column) -> Column:
    """Midnight; months and days over their ends run on."""
    return _moved(F.lit("2000-01-01").cast("timestamp"), y, m, d)


def datetime(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(date(y, m, d)) + (h.cast("bigint") * 3600 + mi * 60 + s) * 1_000_000)


def from_unix(s: Column) -> Column:
    return F.timestamp_seconds(s.cast("bigint"))


def from_unix_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("bigint"))


def now() -> Column:
    return F.current_timestamp()


instant = now


def seconds(n: Column) -> Column:
    """A duration."""
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def minutes(n: Column) -> Column:
    return seconds(n * 60)


def hours(n: Column) -> Column:
    return seconds(n * 3600)


def days(n: Column) -> Column:
    return seconds(n * 86400)


def millis(n: Column) -> Column:
    return seconds(n / 1000)


def plus(ts: Column, duration: Column) -> Column:
    return at(ts) + duration


def minus(ts: Column, other: Column) -> Column:
    """A time less a duration, or the duration between two times."""
    return at(ts) - other


def since(ts: Column) -> Column:
    return F.current_timestamp() - at(ts)


def until(ts: Column) -> Column:
    return at(ts) - F.current_timestamp()


def to_seconds(d: Column) -> Column:
    return d.cast("interval day to second").cast("decimal(24,6)").cast("double")


def to_minutes(d: Column) -> Column:
    return to_seconds(d) / 60


def to_hours(d: Column) -> Column:
    return to_seconds(d) / 3600


def to_days(d: Column) -> Column:
    return to_seconds(d) / 86400


def to_millis(d: Column) -> Column:
    return (to_seconds(d) * 1000).cast("bigint")
