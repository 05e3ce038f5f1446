"""Calendar expressions; the session time zone is UTC throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def month_index(ms: Column) -> Column:
    at = F.timestamp_millis(ms)
    return (F.year(at) * 12 + F.month(at) - 1).cast("long")


def rfc3339_ms(text: Column) -> Column:
    """RFC 3339 to milliseconds; null when it is not one."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(shaped, F.unix_millis(F.try_to_timestamp(F.upper(text))))


def loose_date_ms(text: Column) -> Column:
    """`2023/05/20 (Sat) 02:21`, dashes or slashes, time optional, as UTC milliseconds."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)), lambda n: n.try_cast("bigint"))
    year, month, day = (F.get(numbers, F.lit(i)) for i in range(3))
    hour, minute = (F.coalesce(F.get(numbers, F.lit(i)), F.lit(0)) for i in (3, 4))
    valid = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & year.between(1, 9999)
    # Counting days from the first of the month lets an over-long month roll over.
    first = F.when(valid, F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))
    days = F.datediff(first, F.lit("1970-01-01").cast("date")) + day - 1
    return (days * F.lit(86_400_000) + (hour * 60 + minute) * F.lit(60_000)).cast("long")
