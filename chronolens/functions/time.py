"""Integer time arithmetic over epoch milliseconds and a captured offset in minutes; never the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a work day begins at 04:00 local time.
DAY_START_HOUR = 4
DAY_MS, HOUR_MS, MINUTE_MS = 86_400_000, 3_600_000, 60_000


def _floor_div(x: Column, n: int) -> Column:
    return ((x - F.pmod(x, F.lit(n))) / n).cast("bigint")


def local_ms(ts_ms: Column, tz_minutes: Column) -> Column:
    return ts_ms + tz_minutes.cast("bigint") * MINUTE_MS


def work_day(ts_ms: Column, tz_minutes: Column) -> Column:
    """DATE of the work day, 04:00 to 04:00."""
    return F.date_from_unix_date(_floor_div(local_ms(ts_ms, tz_minutes) - DAY_START_HOUR * HOUR_MS, DAY_MS).cast("int"))


def hour_of(ts_ms: Column, tz_minutes: Column) -> Column:
    """Local hour, 0 to 23."""
    return F.pmod(_floor_div(local_ms(ts_ms, tz_minutes), HOUR_MS), F.lit(24)).cast("int")


def clock(ts_ms: Column, tz_minutes: Column) -> Column:
    """HH:MM."""
    minute = F.pmod(_floor_div(local_ms(ts_ms, tz_minutes), MINUTE_MS), F.lit(1440)).cast("int")
    return F.concat(F.lpad((minute / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"))


def format_duration(ms: Column) -> Column:
    """42m below an hour, else 1h28; rounded minutes."""
    minutes = F.floor(ms / MINUTE_MS + 0.5).cast("bigint")
    hours, rest = (minutes / 60).cast("bigint"), F.lpad((minutes % 60).cast("string"), 2, "0")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.concat(hours.cast("string"), F.lit("h"), rest))


def ts_millis(ts: Column) -> Column:
    """Of a TIMESTAMP or TIMESTAMP_NTZ, the latter taken as UTC (the session's time zone is to be UTC)."""
    return F.unix_millis(ts.cast("timestamp"))
