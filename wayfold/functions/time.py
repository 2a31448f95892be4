"""UTC dates and hours of epoch milliseconds, by arithmetic: no session time zone enters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def utc_date(ms: Column) -> Column:
    """yyyy-mm-dd."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int")).cast("string")


def utc_hour(ms: Column) -> Column:
    """Two digits."""
    return F.lpad(F.floor(F.pmod(ms, F.lit(DAY_MS)) / 3_600_000).cast("string"), 2, "0")


def midnight_ms(date: Column) -> Column:
    """The first millisecond of a date in UTC."""
    return F.datediff(F.to_date(date), F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS
