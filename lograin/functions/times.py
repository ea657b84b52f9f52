"""Time texts of reports, file names and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats seen by readers of reports and alerts.
CLOCK = "HH:mm:ss"
DAY = "yyyy-MM-dd"
ALERT = "dd-MM-yyyy, HH:mm"
PAYLOAD = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def clock(ts: Column) -> Column:
    return F.date_format(ts, CLOCK)


def day(ts: Column) -> Column:
    return F.date_format(ts, DAY)


def alert_time(ts: Column) -> Column:
    return F.date_format(ts, ALERT)


def payload_time(ts: Column) -> Column:
    return F.date_format(ts, PAYLOAD)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")
