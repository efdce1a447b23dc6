"""Month keys and the UTC stamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_number(moment: Column) -> Column:
    """Months since year 0: a small integer to group by, cheaper than formatting every row."""
    return F.year(moment) * 12 + F.month(moment) - 1


def month_key(number: Column) -> Column:
    """``YYYY-MM`` text of a :func:`month_number`."""
    year = F.lpad((number / 12).cast("int").cast("string"), 4, "0")
    return F.concat(year, F.lit("-"), F.lpad((number % 12 + 1).cast("string"), 2, "0"))


def utc_stamp() -> Column:
    """The current time in UTC as ISO text without an offset."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
