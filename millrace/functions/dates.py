"""Date and time functions on Columns.

Instants are counted in microseconds from 1970-01-01 in the session's zone, which is UTC.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"us": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "D": 86400 * 10**6}

#: The names that the units of truncation go by.
UNITS = {
    "year": "Y", "years": "Y", "y": "Y", "month": "M", "months": "M", "week": "W", "weeks": "W", "w": "W",
    "day": "D", "days": "D", "d": "D", "date": "D", "hour": "h", "hours": "h", "h": "h", "minute": "m", "minutes": "m", "m": "m",
    "second": "s", "seconds": "s", "s": "s", "millisecond": "ms", "milliseconds": "ms", "ms": "ms",
    "microsecond": "us", "microseconds": "us", "us": "us", "nanosecond": "ns", "nanoseconds": "ns", "ns": "ns",
}


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def _quarter_start(c: Column) -> Column:
    return F.trunc(F.to_date(c), "quarter")


#: Parts and questions of a date or an instant.
PARTS = {
    "date": F.to_date,
    "time": lambda c: F.date_format(c, "HH:mm:ss.SSSSSS"),
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": lambda c: F.second(c).cast("double"),
    "millisecond": lambda c: F.floor(F.pmod(micros(c), F.lit(10**6)) / 1000),
    "microsecond": lambda c: F.pmod(micros(c), F.lit(10**6)),
    "nanosecond": lambda c: F.when(c.isNotNull(), F.lit(0)),
    "week": F.weekofyear,
    "weekofyear": F.weekofyear,
    "dayofyear": F.dayofyear,
    "dayofweek": F.weekday,
    "weekday": F.weekday,
    "weekday_name": lambda c: F.date_format(c, "EEEE"),
    "quarter": F.quarter,
    "daysinmonth": lambda c: F.dayofmonth(F.last_day(c)),
    "days_in_month": lambda c: F.dayofmonth(F.last_day(c)),
    "is_month_start": lambda c: F.dayofmonth(c) == 1,
    "is_month_end": lambda c: F.to_date(c) == F.last_day(c),
    "is_quarter_start": lambda c: F.to_date(c) == _quarter_start(c),
    "is_quarter_end": lambda c: F.to_date(c) == F.date_sub(F.add_months(_quarter_start(c), 3), 1),
    "is_year_start": lambda c: (F.month(c) == 1) & (F.dayofmonth(c) == 1),
    "is_year_end": lambda c: (F.month(c) == 12) & (F.dayofmonth(c) == 31),
}

#: C format codes and the patterns they stand for.
CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS",
    "j": "DDD", "A": "EEEE", "a": "EEE", "B": "MMMM", "b": "MMM", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "'%'",
}


def strftime_pattern(fmt: str) -> str:
    """The pattern for a C format; other codes are an error."""
    out = []
    for code, text in re.findall(r"%(.?)|([^%]+)", fmt):
        if text:
            out.append("'" + text.replace("'", "''") + "'")
        elif code in CODES:
            out.append(CODES[code])
        else:
            raise ValueError(f"unknown format code %{code}")
    return "".join(out)


def strftime(c: Column, fmt: str) -> Column:
    return F.date_format(c, strftime_pattern(fmt))


def unit_of(name: str) -> str:
    if name in UNITS:
        return UNITS[name]
    raise ValueError(f"unknown time unit: {name}")


def truncate(c: Column, n: int, unit: str) -> Column:
    """Down to a multiple of ``n`` units; a date for days and longer.

    Days are counted from 0001-01-01, weeks from Sundays, months and years from 1970, shorter
    units from 1970-01-01T00:00.
    """
    u = unit_of(unit)
    if u in ("Y", "M"):
        months = (F.year(c) - 1970) * 12 + F.month(c) - 1
        size = n * (12 if u == "Y" else 1)
        first = F.floor(months / size) * size
        return F.make_date((F.lit(1970) + F.floor(first / 12)).cast("int"), (F.pmod(first, F.lit(12)) + 1).cast("int"), F.lit(1))
    if u in ("W", "D"):
        offset, size = (4, 7 * n) if u == "W" else (719163, n)
        days = F.floor((F.unix_date(F.to_date(c)) + offset) / size) * size - offset
        return F.date_from_unix_date(days.cast("int"))
    if u == "ns":
        return c
    size = n * MICROS[u]
    return from_micros(micros(c) - F.pmod(micros(c), F.lit(size)))


def frequency(freq: str) -> int:
    """Microseconds of an offset string such as ``15min``, ``D`` or ``H``."""
    m = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", freq)
    names = {"D": "D", "H": "h", "h": "h", "T": "m", "min": "m", "S": "s", "s": "s", "L": "ms", "ms": "ms", "U": "us", "us": "us"}
    if not m or m[2] not in names:
        raise ValueError(f"not a fixed frequency: {freq}")
    return int(m[1] or 1) * MICROS[names[m[2]]]


def to_frequency(c: Column, freq: str, how: str) -> Column:
    """``round`` (half to even), ``floor`` or ``ceil`` to a fixed frequency."""
    size = frequency(freq)
    at = micros(c)
    rest = F.pmod(at, F.lit(size))
    down = at - rest
    if how == "floor":
        return from_micros(down)
    if how == "ceil":
        return from_micros(F.when(rest == 0, at).otherwise(down + size))
    odd = F.pmod(down, F.lit(2 * size)) != 0
    return from_micros(F.when((rest * 2 > size) | ((rest * 2 == size) & odd), down + size).otherwise(down))


def from_seconds(c: Column) -> Column:
    """The instant so many seconds, with their fraction, after 1970."""
    return F.timestamp_seconds(c).cast("timestamp_ntz")


def delta_micros(c: Column) -> Column:
    """Microseconds of a day-time interval."""
    part = lambda f: F.extract(F.lit(f), c)
    days, hours, minutes, seconds = (part(f) for f in ("DAY", "HOUR", "MINUTE", "SECOND"))
    return ((days.cast("long") * 24 + hours) * 60 + minutes) * F.lit(60 * 10**6) + F.round(seconds * F.lit(10**6)).cast("long")


DELTA_PARTS = {
    "days": lambda c: F.floor(delta_micros(c) / 86_400_000_000),
    "seconds": lambda c: F.floor(F.pmod(delta_micros(c), F.lit(86_400_000_000)) / 10**6),
    "nanoseconds": lambda c: F.pmod(delta_micros(c), F.lit(1)) * 1000,
    "total_seconds": lambda c: delta_micros(c) / 10**6,
}
