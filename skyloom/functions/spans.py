"""Time ranges: structs of start and end, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: schedules are aligned to 2001-01-01 UTC, in seconds of the Unix epoch.
REFERENCE_S = 978307200


def span(start: Column, end: Column) -> Column:
    """Null unless both ends are known."""
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def _seconds(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp")) / 1e6


def elapsed_s(a: Column) -> Column:
    return _seconds(a["end"]) - _seconds(a["start"])


def start_to_start(a: Column, b: Column) -> Column:
    return span(a["start"], b["start"])


def start_to_end(a: Column, b: Column) -> Column:
    return span(a["start"], b["end"])


def end_to_end(a: Column, b: Column) -> Column:
    return span(a["end"], b["end"])


def schedule(a: Column, seconds: int) -> Column:
    """Moments a whole number of intervals from ``REFERENCE_S``: the last not after the start to the first not before the end."""
    first = F.floor((_seconds(a["start"]) - REFERENCE_S) / seconds) * seconds + REFERENCE_S
    last = first + F.ceil((_seconds(a["end"]) - first) / seconds) * seconds
    return F.transform(F.sequence(first, last, F.lit(seconds).cast("long")), F.timestamp_seconds)
