"""Instants and durations. A duration is a struct of months, days, seconds and nanos that do not carry over."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Units that date_trunc lacks, in years.
YEARS = {"decade": 10, "century": 100, "millennium": 1000}


def truncate(unit: str, instant: Column) -> Column:
    unit = unit.lower()
    if unit in YEARS:
        n = YEARS[unit]
        return F.make_timestamp_ntz(F.floor(F.year(instant) / n) * n, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.date_trunc(unit, instant).cast("timestamp_ntz")


#: Accessors of an instant.
COMPONENTS = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "week": F.weekofyear,
    "weekYear": lambda t: F.extract(F.lit("YEAROFWEEK"), t),
    "dayOfYear": F.dayofyear,
    "ordinalDay": F.dayofyear,
    "dayOfQuarter": lambda t: F.datediff(t, F.trunc(t, "quarter")) + 1,
    "dayOfWeek": lambda t: F.weekday(t) + 1,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "epochSeconds": lambda t: F.unix_seconds(t.cast("timestamp")),
    "epochMillis": lambda t: F.unix_millis(t.cast("timestamp")),
}


def duration(months=0, days=0, seconds=0, nanos=0) -> Column:
    part = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(part(months, "long").alias("months"), part(days, "long").alias("days"), part(seconds, "long").alias("seconds"), part(nanos, "int").alias("nanos"))


_iso = re.compile(r"(-?)P(?:(-?\d+)Y)?(?:(-?\d+)M)?(?:(-?\d+)W)?(?:(-?\d+)D)?(?:T(?:(-?\d+)H)?(?:(-?\d+)M)?(?:(-?\d+)(?:\.(\d{1,9}))?S)?)?")


def duration_of(text: str) -> Column:
    """A duration constant from ISO 8601."""
    m = _iso.fullmatch(text)
    if not m or text.rstrip("-")[-1] in "PT":
        raise ValueError(f"not a duration: {text}")
    y, mo, w, d, h, mi, s = (int(x or 0) for x in m.groups()[1:8])
    nanos = int((m[9] or "").ljust(9, "0"))
    sign = -1 if m[1] else 1
    return duration(sign * (12 * y + mo), sign * (7 * w + d), sign * (3600 * h + 60 * mi + s), sign * nanos)


def plus(instant: Column, d: Column) -> Column:
    """Months first, then days, then seconds."""
    moved = F.make_dt_interval(d["days"].cast("int"), F.lit(0), F.lit(0), (d["seconds"] + d["nanos"] / 1e9).cast("decimal(18,6)"))
    return instant + F.make_ym_interval(F.lit(0), d["months"].cast("int")) + moved


def between_months(a: Column, b: Column) -> Column:
    """Whole months from a to b."""
    return F.timestamp_diff("MONTH", a, b)


def between_days(a: Column, b: Column) -> Column:
    return F.timestamp_diff("DAY", a, b)


def between_seconds(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b)


def average_seconds(d: Column) -> Column:
    """The length used to order durations: a month is 30.436875 days (2629746 seconds)."""
    return d["months"] * 2629746 + d["days"] * 86400 + d["seconds"]


def parse_epoch(text: Column, pattern: str, unit: str = "ms") -> Column:
    """Epoch of a text in ms, s, m, h or d."""
    millis = F.unix_millis(F.to_timestamp(text, pattern))
    return F.call_function("div", millis, F.lit({"ms": 1, "s": 1000, "m": 60000, "h": 3600000, "d": 86400000}[unit]).cast("long"))


def _n(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def make_date(year, month=1, day=1) -> Column:
    return F.make_date(_n(year), _n(month), _n(day))


def week_date(year, week=1, day=1) -> Column:
    """A date by ISO week and day of the week, Monday = 1; the fourth of January is in week 1."""
    monday = F.trunc(F.make_date(_n(year), F.lit(1), F.lit(4)), "week")
    return F.date_add(monday, ((_n(week) - 1) * 7 + _n(day) - 1).cast("int"))


def ordinal_date(year, day=1) -> Column:
    return F.date_add(F.make_date(_n(year), F.lit(1), F.lit(1)), (_n(day) - 1).cast("int"))


def quarter_date(year, quarter=1, day=1) -> Column:
    return F.date_add(F.make_date(_n(year), (_n(quarter) * 3 - 2).cast("int"), F.lit(1)), (_n(day) - 1).cast("int"))


def parse_date(text: Column) -> Column:
    """ISO dates: 2015-07-21, 20150721, 2015-07, 2015, 2015-202, 2015-W30-2, 2015-Q2-60; null where it is none."""
    part = lambda pattern, i: F.when(F.rlike(text, F.lit(f"^{pattern}$")), F.regexp_extract(text, f"^{pattern}$", i).cast("int"))
    forms = [
        (make_date, r"(\d{4})-(\d{2})-(\d{2})", 3),
        (make_date, r"(\d{4})(\d{2})(\d{2})", 3),
        (make_date, r"(\d{4})-(\d{2})", 2),
        (make_date, r"(\d{4})", 1),
        (ordinal_date, r"(\d{4})-(\d{3})", 2),
        (week_date, r"(\d{4})-W(\d{2})-(\d)", 3),
        (week_date, r"(\d{4})-W(\d{2})", 2),
        (quarter_date, r"(\d{4})-Q(\d)-(\d{2})", 3),
    ]
    return F.coalesce(*(make(*(part(pattern, i + 1) for i in range(n))) for make, pattern, n in forms))


def local_time(hour, minute=0, second=0, nanos=0) -> Column:
    """A time of day as nanoseconds since midnight."""
    return ((_n(hour) * 60 + _n(minute)) * 60 + _n(second)).cast("long") * 1_000_000_000 + _n(nanos)


def parse_local_time(text: Column) -> Column:
    """hh:mm[:ss[.fraction]], with or without colons."""
    form = r"^(\d{2}):?(\d{2})(?::?(\d{2})(?:\.(\d{1,9}))?)?$"
    part = lambda i: F.coalesce(F.regexp_extract(text, form, i).try_cast("long"), F.lit(0).cast("long"))
    nanos = F.rpad(F.regexp_extract(text, form, 4), 9, "0").try_cast("long")
    return F.when(F.rlike(text, F.lit(form)), local_time(part(1), part(2), part(3), F.coalesce(nanos, F.lit(0))))


def time_text(time: Column) -> Column:
    """hh:mm:ss.nnnnnnnnn of a time of day."""
    s = F.call_function("div", time, F.lit(1_000_000_000).cast("long"))
    return F.format_string("%02d:%02d:%02d.%09d", F.call_function("div", s, F.lit(3600).cast("long")), F.call_function("div", s, F.lit(60).cast("long")) % 60, s % 60, time % 1_000_000_000)


def time_with_offset(time: Column, offset_seconds) -> Column:
    """A time of day of an offset; ``utc`` orders such times."""
    return F.struct(time.alias("time"), _n(offset_seconds).cast("int").alias("offset"), (time - _n(offset_seconds).cast("long") * 1_000_000_000).alias("utc"))


def local_datetime(year, month=1, day=1, hour=0, minute=0, second=0) -> Column:
    return F.make_timestamp_ntz(*(_n(x) for x in (year, month, day, hour, minute, second)))


def zoned_datetime(year, month=1, day=1, hour=0, minute=0, second=0, zone: str = "UTC") -> Column:
    return F.make_timestamp(*(_n(x) for x in (year, month, day, hour, minute, second)), F.lit(zone))


def from_epoch(seconds, nanos=0) -> Column:
    """An instant; Spark keeps microseconds."""
    return F.timestamp_micros((_n(seconds).cast("long") * 1_000_000 + F.call_function("div", _n(nanos).cast("long"), F.lit(1000).cast("long"))).cast("long"))


def from_epoch_millis(millis) -> Column:
    return F.timestamp_millis(_n(millis).cast("long"))


def _div(a: Column, n: int) -> Column:
    return F.call_function("div", a, F.lit(n).cast("long"))


#: Accessors of a duration: whole units of its own group (months, days, seconds), and what is left over in a larger unit.
DURATION = {
    "years": lambda d: _div(d["months"], 12),
    "quarters": lambda d: _div(d["months"], 3),
    "months": lambda d: d["months"],
    "weeks": lambda d: _div(d["days"], 7),
    "days": lambda d: d["days"],
    "hours": lambda d: _div(d["seconds"], 3600),
    "minutes": lambda d: _div(d["seconds"], 60),
    "seconds": lambda d: d["seconds"],
    "milliseconds": lambda d: d["seconds"] * 1000 + _div(d["nanos"].cast("long"), 1_000_000),
    "microseconds": lambda d: d["seconds"] * 1_000_000 + _div(d["nanos"].cast("long"), 1000),
    "nanoseconds": lambda d: d["seconds"] * 1_000_000_000 + d["nanos"],
    "quartersOfYear": lambda d: _div(d["months"], 3) % 4,
    "monthsOfYear": lambda d: d["months"] % 12,
    "monthsOfQuarter": lambda d: d["months"] % 3,
    "daysOfWeek": lambda d: d["days"] % 7,
    "minutesOfHour": lambda d: _div(d["seconds"], 60) % 60,
    "secondsOfMinute": lambda d: d["seconds"] % 60,
    "millisecondsOfSecond": lambda d: _div(d["nanos"].cast("long"), 1_000_000),
    "microsecondsOfSecond": lambda d: _div(d["nanos"].cast("long"), 1000),
    "nanosecondsOfSecond": lambda d: d["nanos"].cast("long"),
}
