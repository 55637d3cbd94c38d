"""Calendar arithmetic; every rule takes its own ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts: Column) -> Column:
    """UTC day."""
    return F.to_date(ts)


def month_key(ts: Column) -> Column:
    """``yyyy-MM``."""
    return F.date_format(ts, "yyyy-MM")


def month_bounds(d: Column) -> tuple[Column, Column]:
    """First day of the month before, last day two months ahead."""
    return F.trunc(F.add_months(d, -1), "MM"), F.last_day(F.add_months(d, 2))


def ttl_epoch(start: Column, days: int = 90) -> Column:
    """Epoch seconds at which a row expires."""
    return F.unix_seconds(start.cast("timestamp")) + days * 86400


def local_time(ts: Column, zone: str) -> Column:
    """``h:mm a`` in ``zone`` of a UTC time."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "h:mm a")


def hours_since(then: Column, now: Column) -> Column:
    """Hours from one time to another, with fractions."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 3.6e9


def page_delay_ms(pages: Column, cycle_minutes: float) -> Column:
    """Pause between pages: nine tenths of the cycle shared out, 2 s at least and 5 minutes at most."""
    return F.greatest(F.lit(2000), F.least(F.floor(F.try_divide(F.lit(cycle_minutes * 60_000 * 0.9), pages)), F.lit(300_000))).cast("long")


def days_between(start: Column, end: Column) -> Column:
    """Array of all days, both ends included."""
    return F.sequence(F.to_date(start), F.to_date(end))


def percent_truncated(part: Column, whole: Column, places: int = 1) -> Column:
    """``100 * part / whole`` cut, not rounded, to ``places``; null for an empty whole."""
    scale = 10**places
    return F.floor(F.try_divide(100 * scale * part, whole)).cast("double") / scale
