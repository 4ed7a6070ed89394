"""Parsing and formatting of recorder and plan fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(token: Column) -> Column:
    """Seconds of h:mm or h:mm:ss; null if it is neither."""
    parts = F.split(F.trim(token), ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    return F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2)).when(F.size(parts) == 2, number(0) * 3600 + number(1) * 60)


def number(token: Column) -> Column:
    """The number a cell holds; blank and dashes are null, NaN and infinities too."""
    value = F.when(~F.trim(token).isin("", "-", "--"), F.trim(token)).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def pair(token: Column) -> Column:
    """Struct first, second of a cell such as a/b."""
    return F.struct(number(F.split_part(token, F.lit("/"), F.lit(1))).alias("first"), number(F.split_part(token, F.lit("/"), F.lit(2))).alias("second"))


def timestamp(date: Column, time: Column, offset: Column) -> Column:
    """Instant of a recorder's date (either order), time and offset cells; null when they do not parse."""
    cells = F.concat_ws(" ", F.trim(date), F.trim(time), F.trim(offset))
    tries = [F.try_to_timestamp(cells, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss XXX", "dd/MM/yyyy HH:mm:ss XXX")]
    return F.when((F.trim(date) != "") & (F.trim(time) != ""), F.coalesce(*tries))


def rounded_time(ts: Column, width_s: int) -> Column:
    """The nearest multiple of the width."""
    return F.timestamp_seconds(F.round(F.unix_micros(ts.cast("timestamp")) / 1e6 / width_s) * width_s)


def file_kind(name: Column) -> Column:
    """log, report, system or null, by a recorder file's name."""
    return F.when(name.rlike(r"^log_.*\.csv$"), "log").when(name.rlike(r"^rpt_.*\.csv$"), "report").when(name.rlike(r"^sys_.*\.json$"), "system")


def file_time(name: Column) -> Column:
    """The time that log_YYMMDD_HHMMSS_ICAO.csv names."""
    parts = F.split(name, "_")
    return F.try_to_timestamp(F.concat(F.lit("20"), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))), F.lit("yyyyMMddHHmmss"))


def file_airport(name: Column) -> Column:
    """The airport that a log's name ends in; null where it has none."""
    last = F.regexp_replace(F.element_at(F.split(name, "_"), -1), r"\.csv$", "")
    return F.when(last != "", last)


def metric_key(field: str, metric: str) -> str:
    return f"{field}.{metric}"


def split_key(key: Column) -> Column:
    parts = F.split(key, r"\.", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("field"), F.get(parts, F.lit(1)).alias("metric"))


def duration(seconds: Column, style: str = "hms") -> Column:
    """h:mm:ss (hms), h:mm (hm), m:ss (ms) or hours with one decimal (hours) of whole seconds, a minus before them; - for null."""
    n = F.bround(seconds).cast("long")
    size, sign = F.abs(n), F.when(n < 0, "-").otherwise("")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours, minutes, rest = F.floor(size / 3600).cast("string"), F.floor(size % 3600 / 60), size % 60
    shown = {
        "hms": F.concat(sign, hours, F.lit(":"), two(minutes), F.lit(":"), two(rest)), "hm": F.concat(sign, hours, F.lit(":"), two(minutes)),
        "ms": F.concat(sign, F.floor(size / 60).cast("string"), F.lit(":"), two(rest)), "hours": F.format_string("%.1f", F.bround(seconds / 3600, 1)),
    }[style]
    return F.coalesce(shown if style != "hours" else F.when(seconds.isNotNull(), shown), F.lit("-"))
