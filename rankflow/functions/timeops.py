"""Time as whole epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, WEEK = 86_400, 604_800
#: The first Monday after the epoch, 1970-01-05 00:00 UTC.
FIRST_MONDAY = 345_600


def epoch_seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp; one without a zone is read as UTC whatever the session's zone is."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def week_start(seconds: Column) -> Column:
    """Monday 00:00 of the week; floors, also before the first Monday."""
    return F.floor((seconds - FIRST_MONDAY) / WEEK).cast("long") * WEEK + FIRST_MONDAY
