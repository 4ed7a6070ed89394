"""The catalogue of flights and aircraft: states, selections, searches, lists and totals.

A flight record has log_file_name, system_id, start_time, end_time, start_icao, end_icao, route, and the figures
of ``flights.summaries``; an aircraft has system_id, identifier, airframe, fuel_max, fuel_tab, gph.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import text
from skyloom.operators.joins import as_of

#: The version of what parsing yields; older records are parsed again.
VERSION = 1
STATUSES = ("notParsed", "quickParsed", "parsed", "empty", "error")


def one_a_key(rows: DataFrame, key: str, order: Sequence[str], last: bool = False) -> DataFrame:
    """The first (last) row of each key, in an order."""
    pick = (F.max_by if last else F.min_by)(F.struct(*rows.columns), F.struct(*order))
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(pick.alias("__row")).select("__row.*")


def status(column: Column) -> Column:
    """A known status, else notParsed."""
    return F.when(column.isin(*STATUSES), column).otherwise("notParsed")


def requires_parsing(status_of: Column, version: Column) -> Column:
    return (F.coalesce(version, F.lit(0)) < VERSION) | status(status_of).isin("notParsed", "quickParsed")


def refined(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Records after a parse: a full parse replaces any, a quick one only what no full parse gave."""
    rank = F.when(F.col("status") == "parsed", 2).when(F.col("status") == "quickParsed", 1).otherwise(0)
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    pick = F.max_by(F.struct(*[c for c in both.columns if c != "__age"]), F.struct(rank, "__age"))
    return both.groupBy(F.col(key).alias("__k")).agg(pick.alias("__row")).select("__row.*")


def is_empty(flying_s: Column, distance: Column) -> Column:
    return F.coalesce((flying_s == 0) | (distance < 0.2), F.lit(True))


def is_flight(flying_s: Column, distance: Column, kind: Column) -> Column:
    return ~is_empty(flying_s, distance) & F.coalesce(kind == "flight", F.lit(False))


def listed(records: DataFrame, request: str = "all", flight: Column | None = None, chosen: Column | None = None) -> DataFrame:
    """all, flights, or filtered records; without a filter, filtered gives none."""
    if request == "flights":
        return records.where(flight)
    if request == "filtered":
        return records.where(chosen if chosen is not None else F.lit(False))
    return records


def of_aircraft(records: DataFrame, system_ids: Sequence[str], column: str = "system_id") -> DataFrame:
    return records.where(F.col(column).isin([i for i in system_ids if i != ""]))


def containing(records: DataFrame, columns: Sequence[str], term: str) -> DataFrame:
    """Records with the term, in its own case, in any of the columns (texts or arrays of texts)."""
    kinds = dict(records.dtypes)
    hit = F.lit(False)
    for c in columns:
        own = F.exists(c, lambda x: x.contains(F.lit(term))) if kinds[c].startswith("array") else F.contains(F.col(c), F.lit(term))
        hit = hit | F.coalesce(own, F.lit(False))
    return records.where(hit)


def without_quotes(system_id: Column) -> Column:
    return F.regexp_replace(system_id, '"', "")


def starts_after(start: Column, moment: Column) -> Column:
    return F.coalesce(start > moment, F.lit(False))


def starts_before(start: Column, moment: Column) -> Column:
    return F.coalesce(start < moment, F.lit(False))


def is_newer(start: Column, name: Column, other_start: Column, other_name: Column) -> Column:
    """Whether a log is newer than another: by their times, or by their file names where either time is missing."""
    return F.when(start.isNotNull() & other_start.isNotNull(), start > other_start).otherwise(name > other_name)


def is_older(start: Column, name: Column, other_start: Column, other_name: Column) -> Column:
    return F.when(start.isNotNull() & other_start.isNotNull(), start < other_start).otherwise(name < other_name)


def by_name(files: DataFrame, name: str = "name") -> DataFrame:
    """The files, the last by name first."""
    return files.orderBy(F.desc(name))


def newest_first(records: DataFrame, start: str = "start_time", name: str = "log_file_name") -> DataFrame:
    return records.orderBy(F.desc(start), F.desc(name))


def import_list(files: DataFrame, name: str, method: str = "all", since: Column | None = None, chosen: Sequence[str] = (), imported: DataFrame | None = None) -> DataFrame:
    """The files to import: ``all``, those of ``since`` or later (after_date), the ``chosen`` ones (selected), or those no older
    than the newest imported one (latest; all, if none was). Files whose name tells no date come with all and selected only."""
    told = text.file_time(F.col(name))
    if method == "after_date":
        return files.where(told >= since)
    if method == "selected":
        return files.where(F.col(name).isin(list(chosen)))
    if method == "latest":
        newest = imported.agg(F.max(text.file_time(F.col(name))).alias("t"), F.count("*").alias("n")).first()
        return files if not newest["n"] else files.where(told >= F.lit(newest["t"]))
    return files


def fuel_on(moments: DataFrame, flights: DataFrame, aircraft: str = "system_id", ts: str = "ts") -> DataFrame:
    """``moments`` (aircraft, ts) with the fuel of the flight that started last before: tanks, totalizer, and both with what was added.

    ``flights``: aircraft, start_time, fuel_start, fuel_end, fuel_totalizer, added. Without such a flight all are 0.
    """
    right = flights.select(aircraft, F.col("start_time").alias(ts), "fuel_start", "fuel_end", "fuel_totalizer", "added")
    found = as_of(moments, right, [aircraft], ts, ["fuel_start", "fuel_end", "fuel_totalizer", "added"], strict=True, prefix="__")
    known = lambda c: F.coalesce(c, F.lit(0.0))
    tanks, counted, added = known(F.col("__fuel_end")), known(F.col("__fuel_start") - F.col("__fuel_totalizer")), known(F.col("__added"))
    return found.select(*moments.columns, tanks.alias("tanks"), counted.alias("totalizer"), (tanks + added).alias("tanks_plus_added"), (counted + added).alias("totalizer_plus_added"))


def aircraft_list(flights: DataFrame, aircraft: DataFrame, key: str = "system_id", start: str = "start_time", name: str = "log_file_name") -> DataFrame:
    """One row an aircraft that flew: its identifier, flights, sums, first and latest flight; ``newest`` orders them as shown."""
    own = flights.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n_flights"), F.sum("distance").alias("distance"), F.sum("hours").alias("hours"), F.sum("fuel_used").alias("fuel_used"),
        F.min(start).alias("first_time"), F.max(start).alias("latest_time"), F.max_by(name, F.struct(start, name)).alias("latest_flight"),
    )
    named = aircraft.select(F.col(key).alias("__k"), F.col("identifier").alias("__id"))
    return own.join(named, F.col(key) == F.col("__k"), "left").withColumn("identifier", display_identifier(F.col("__id"), F.col(key))).drop("__k", "__id")


def newest(aircraft: DataFrame) -> DataFrame:
    return aircraft.orderBy(F.desc_nulls_last("latest_time"), "identifier")


def counts(flights: DataFrame, key: str = "system_id") -> DataFrame:
    """Flights by aircraft, those of none under Null."""
    return flights.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("Null")).alias(key)).agg(F.count("*").alias("n"))


def trip_counts(flights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_flights and n_trips of all flights that belong to a trip (``keys`` tell trips apart)."""
    return flights.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_flights"), F.count("*").alias("n_trips"))


def display_identifier(identifier: Column, system_id: Column) -> Column:
    return F.coalesce(identifier.cast("string"), system_id.cast("string"), F.lit(""))


def route_text(route: Column, departs: Column, arrives: Column) -> Column:
    """A to B via the points between; the airports alone where no point lies between."""
    points = F.filter(F.coalesce(route, F.array().cast("array<string>")), lambda p: (p != departs) & (p != arrives))
    ends = F.concat_ws(" - ", departs, arrives)
    return F.when(F.size(points) > 0, F.concat_ws(" via ", ends, F.array_join(points, ", "))).otherwise(ends)


def totalizer_agrees(used: Column, counted: Column, most: float = 2.0) -> Column:
    return F.abs(used - counted) < most


def fuel_defaults(inputs: DataFrame, step: float = 1.0, target: float = 70.0, start: float = 92.0) -> DataFrame:
    """``inputs`` (last_entered, target, totalizer_start, added, start_left, start_right) with defaults where nothing was ever entered:
    the fuel at the start rounded up tank by tank, or the settings where that is unknown, and nothing added."""
    up = lambda c: F.ceil(F.col(c) / step) * step
    full = (up("start_left") + up("start_right")).cast("double")
    new = F.col("last_entered").isNull()
    return inputs.withColumns({
        "target": F.when(new, F.coalesce(full, F.lit(target))).otherwise(F.col("target")),
        "totalizer_start": F.when(new, F.coalesce(full, F.lit(start))).otherwise(F.col("totalizer_start")),
        "added": F.when(new, F.lit(0.0)).otherwise(F.col("added")),
    })


def summary_cells(flights: DataFrame, key: str) -> DataFrame:
    """key, cell, at: the times of a flight as rows Start, Taxi, Takeoff, Landing, Parked, Shutdown."""
    cells = {"Start": "hobbs_start", "Taxi": "moving_start", "Takeoff": "flying_start", "Landing": "flying_end", "Parked": "moving_end", "Shutdown": "hobbs_end"}
    named = flights.select(key, *[F.col(c).alias(k) for k, c in cells.items()])
    return named.unpivot([key], list(cells), "cell", "at")


def time_cells(flights: DataFrame, key: str) -> DataFrame:
    """key, line, cell, since_s, elapsed_s, logbook_h: a flight's times as seconds since the start, with the length of what ends there.

    Landing ends what was flown, Parked what was moved, Shutdown what the engine ran; the logbook's hours are those of what was moved.
    """
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    since = lambda c: t(c) - t("hobbs_start")
    span = lambda n: t(f"{n}_end") - t(f"{n}_start")
    none = F.lit(None).cast("double")
    lines = [
        ("Start", "hobbs_start", none, none), ("Taxi", "moving_start", none, none), ("Takeoff", "flying_start", none, none),
        ("Landing", "flying_end", span("flying"), none), ("Parked", "moving_end", span("moving"), span("moving") / 3600), ("Shutdown", "hobbs_end", span("hobbs"), none),
    ]
    out = [F.struct(F.lit(i).alias("line"), F.lit(c).alias("cell"), since(at).alias("since_s"), e.alias("elapsed_s"), h.alias("logbook_h")) for i, (c, at, e, h) in enumerate(lines)]
    return flights.select(key, F.inline(F.array(*out)))


def aircraft_cells(aircraft: DataFrame, key: str = "system_id") -> DataFrame:
    """key, line, title, value of an aircraft's summary: Identifier, Airframe, Last (the date of its latest flight)."""
    lines = [("Identifier", F.col("identifier")), ("Airframe", F.col("airframe_name")), ("Last", F.date_format("latest_time", "yyyy-MM-dd"))]
    return aircraft.select(key, F.inline(F.array(*[F.struct(F.lit(i).alias("line"), F.lit(t).alias("title"), v.cast("string").alias("value")) for i, (t, v) in enumerate(lines)])))


def fuel_cells(flights: DataFrame, key: str) -> DataFrame:
    """key, cell, left, right, total: fuel at the start, at the end, and used."""
    f = lambda side: F.col(f"fuel_{side}.left"), lambda side: F.col(f"fuel_{side}.right")
    rows = []
    for name, get in (("Start", lambda g: g("start")), ("End", lambda g: g("end")), ("Used", lambda g: g("start") - g("end"))):
        left, right = get(f[0]), get(f[1])
        rows.append(F.struct(F.lit(name).alias("cell"), left.alias("left"), right.alias("right"), (left + right).alias("total")))
    return flights.select(key, F.inline(F.array(*rows)))


def field_columns(legs: DataFrame, grouped: Sequence[str], order: dict[str, int]) -> list[str]:
    """The fields of a table of legs as shown: all but the grouped ones, by the dictionary's order, unknown ones last."""
    return sorted((c for c in legs.columns if c not in grouped), key=lambda c: (order.get(c, 9999), c))


def without(records: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The records but for those whose key is among ``gone``."""
    return records.join(gone.select(key).distinct(), key, "left_anti")
