"""Calendar functions; the session's time zone is the local one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def hour(ts: Column) -> Column:
    """00 to 23."""
    return F.lpad(F.hour(ts).cast("string"), 2, "0")


def weekday(ts: Column) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(ts) - 1


def monday_week(ts: Column) -> Column:
    """Year and week, weeks beginning on Mondays, days before the first Monday in week 00."""
    week = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7).cast("int")
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def seconds_between(first: Column, last: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(last) - F.unix_timestamp(first))


def since(text: str) -> Column:
    """An RFC 3339 time, or a day's first moment."""
    return F.coalesce(F.try_to_timestamp(F.lit(text)), F.try_to_timestamp(F.lit(text), F.lit("yyyy-MM-dd")))


def day_bounds(ts: Column, zone: str) -> Column:
    """(start, end) of the day of a zone that a time lies in, as times: 23 or 25 hours long where clocks change."""
    day = F.to_date(F.from_utc_timestamp(ts, zone))
    start = lambda d: F.to_utc_timestamp(d.cast("timestamp_ntz").cast("timestamp"), zone)
    return F.struct(start(day).alias("start"), start(F.date_add(day, 1)).alias("end"))
