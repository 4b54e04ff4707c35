"""Time arithmetic on long microseconds and timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def duration_ms(start_us: Column, end_us: Column) -> Column:
    """Fractional milliseconds from ``start_us`` to ``end_us``."""
    return (end_us - start_us) / F.lit(1000.0)


def elapsed_whole_ms(start_us: Column, end_us: Column) -> Column:
    """Whole milliseconds from ``start_us`` to ``end_us``, truncated toward zero."""
    return F.call_function("div", end_us - start_us, F.lit(1000))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts)


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with microseconds, in UTC whatever the session's timezone."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")).cast("string")
    fraction = F.rpad(F.substring(utc, 21, 6), 6, "0")  # the text leaves out zeros at its end
    day, time = F.substring(utc, 1, 10), F.substring(utc, 12, 8)
    return F.concat(day, F.lit("T"), time, F.lit("."), fraction, F.lit("Z"))
