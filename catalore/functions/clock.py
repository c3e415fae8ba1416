"""Time expressions. The clock is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(as_of: datetime | Column) -> Column:
    """The clock argument as a zone-free timestamp."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def relative_time(ts: Column, as_of: datetime | Column) -> Column:
    """Never / date / N days, hours or minutes ago / Just now.

    Limits are strict: 3600 s still reads "60 minutes ago" and 60 s "Just now".
    Future times read "Just now". Wall clock times are subtracted as they are,
    whatever the session time zone.
    """
    seconds = (instant(as_of) - ts).cast("bigint")
    days = F.floor(seconds / 86400)
    rest = F.pmod(seconds, F.lit(86400))

    def ago(amount: Column, unit: str) -> Column:
        return F.concat(amount.cast("bigint").cast("string"), F.lit(f" {unit} ago"))

    return (
        F.when(ts.isNull(), F.lit("Never"))
        .when(seconds < 0, F.lit("Just now"))
        .when(days > 7, F.date_format(ts, "yyyy-MM-dd HH:mm"))
        .when(days > 0, ago(days, "days"))
        .when(rest > 3600, ago(F.floor(rest / 3600), "hours"))
        .when(rest > 60, ago(F.floor(rest / 60), "minutes"))
        .otherwise(F.lit("Just now"))
    )


def relative_time_text(text: Column, as_of: datetime | Column) -> Column:
    """The same for time stamps held as text; text that is no time comes back as it is."""
    parsed = F.try_to_timestamp(text).cast("timestamp_ntz")
    shown = F.when(parsed.isNull(), text).otherwise(relative_time(parsed, as_of))
    return F.when(text.isNull(), F.lit("Never")).otherwise(shown)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with fraction."""
    return (end - start).cast("interval second").cast("decimal(20, 6)").cast("double")
