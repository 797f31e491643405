"""Times as columns: ISO texts, epoch milliseconds and UTC days. The session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DAY_MS

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?([+-]\d{2}(:?\d{2}(:?\d{2})?)?|Z)?)?$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def iso_to_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 text, UTC where it has no offset; null where it is none."""
    return F.when(text.rlike(_ISO), F.unix_millis(F.try_to_timestamp(F.regexp_replace(text, ",", "."))))


def flexible_ms(text: Column) -> Column:
    """Epoch milliseconds of a whole number (3 or 3.0) or an ISO text."""
    number = text.try_cast("double")
    whole = F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint")).when(number == F.floor(number), number.try_cast("bigint"))
    # What begins as an ISO text is no number: a cast that fails costs an exception a row.
    return F.when(text.rlike(r"^\d{4}-"), iso_to_ms(text)).otherwise(whole)


def iso_date(text: Column) -> Column:
    """A real calendar day written yyyy-MM-dd; null otherwise."""
    return F.when(text.rlike(_DATE), text.try_cast("date"))


def date_to_ms(day: Column) -> Column:
    """Epoch milliseconds of a day's UTC midnight."""
    return F.unix_date(day).cast("bigint") * F.lit(DAY_MS)


def ms_to_date(ms: Column) -> Column:
    """The UTC day of epoch milliseconds."""
    return F.date_from_unix_date(F.floor(ms / F.lit(DAY_MS)).cast("int"))


def day_start_ms(value: Column) -> Column:
    """UTC midnight of epoch milliseconds, or of microseconds from 1e13 on, in milliseconds."""
    ms = F.when(value >= F.lit(10**13), F.floor(value / F.lit(1000))).otherwise(value)
    return (F.floor(ms / F.lit(DAY_MS)) * F.lit(DAY_MS)).cast("bigint")


def timestamp_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
