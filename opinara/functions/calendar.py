"""Column functions for time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions.text import _col


def parse_iso(c) -> Column:
    """ISO text to timestamp; anything unreadable becomes NULL."""
    return F.try_to_timestamp(_col(c))


def from_epoch(c) -> Column:
    return F.timestamp_seconds(_col(c))


def iso_text(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ssxxx")


def parts(ts) -> dict[str, Column]:
    """Year, month, weekday (Monday is 0) and hour."""
    c = _col(ts)
    return {"year": F.year(c), "month": F.month(c), "day_of_week": F.weekday(c), "hour": F.hour(c)}


def month_name(ts) -> Column:
    return F.date_format(_col(ts), "MMMM")


def month_end(ts) -> Column:
    return F.last_day(F.to_date(_col(ts)))


def whole_days(start, end) -> Column:
    """Completed days between two timestamps."""
    return F.floor((F.unix_micros(_col(end)) - F.unix_micros(_col(start))) / F.lit(86_400_000_000)).cast("long")
