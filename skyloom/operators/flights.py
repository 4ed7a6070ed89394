"""From samples to flights: summaries, trips, home base, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.series import drop_head, drop_tail, leg_ends, legs, scan, value_changes


def summaries(samples: DataFrame, key: str = "log_id", ts: str = "ts") -> DataFrame:
    """One row a log: hobbs, engine, moving and flying times, type, fuel, distance, highest altitude, route.

    ``samples`` has ts, gs, ias, power, fuel_left, fuel_right, totalizer, distance, alt, waypoint.
    """
    keys, order = [key], [ts]

    def span(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.min(ts).alias(f"{name}_start"), F.max(ts).alias(f"{name}_end"))

    engine = drop_tail(drop_head(samples, F.col("power") > 0, keys, order), F.col("power") > 0, keys, order)
    moving = drop_tail(drop_head(engine, F.col("gs") > 0, keys, order, run=5), F.col("gs") > 0, keys, order)
    flying = drop_tail(drop_head(engine, F.col("ias") > 35, keys, order), F.col("ias") > 35, keys, order)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts)))
    out = samples.groupBy(key).agg(
        F.min(ts).alias("hobbs_start"), F.max(ts).alias("hobbs_end"),
        F.struct(first("fuel_left").alias("left"), first("fuel_right").alias("right")).alias("fuel_start"),
        F.struct(last("fuel_left").alias("left"), last("fuel_right").alias("right")).alias("fuel_end"),
        last("totalizer").alias("fuel_totalizer"), last("distance").alias("distance"), F.max("alt").alias("altitude"),
    )
    for rows, name in ((engine, "engine"), (moving, "moving"), (flying, "flying")):
        out = out.join(span(rows, name), key, "left")
    stops = value_changes(samples.join(span(flying, "f"), key).where(F.col(ts) >= F.col("f_start")), ["waypoint"], keys, order)
    stops = stops.where("waypoint <> ''").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(ts, "waypoint"))), lambda x: x["waypoint"]).alias("route"))
    out = out.join(stops, key, "left")
    kind = F.when(F.col("engine_start").isNull() | F.col("moving_start").isNull(), "preflight").when(F.col("flying_start").isNull(), "ground").otherwise("flight")
    return out.withColumn("type", kind)


def elapsed(start: str, end: str) -> Column:
    return F.unix_micros(F.col(end).cast("timestamp")) / 1e6 - F.unix_micros(F.col(start).cast("timestamp")) / 1e6


def measures(flights: DataFrame) -> DataFrame:
    """``flights`` with fuel_used, ground_speed, gph and nm_per_gallon; the totaliser is believed where it counted."""
    used = F.col("fuel_start.left") + F.col("fuel_start.right") - F.col("fuel_end.left") - F.col("fuel_end.right")
    moving, flying = elapsed("moving_start", "moving_end"), elapsed("flying_start", "flying_end")
    fuel = F.when(F.col("fuel_totalizer") > 0, F.col("fuel_totalizer")).otherwise(used)
    over = F.when(moving - flying > flying, moving).otherwise(flying)
    return flights.withColumn("fuel_used", fuel).withColumns({
        "ground_speed": F.col("distance") / F.nullif(over / 3600, F.lit(0.0)),
        "gph": F.col("fuel_used") / F.nullif(moving / 3600, F.lit(0.0)),
        "nm_per_gallon": F.col("distance") / F.nullif(F.col("fuel_used"), F.lit(0.0)),
    })


class Trips:
    """Numbers an aircraft's flights by trip: a flight that arrives at the base ends its trip, unless it is the trip's first;
    after a local flight at the base, one that goes elsewhere starts a new trip. Flights without airports stay in theirs."""

    def __init__(self, base: str):
        self.base, self.out, self.trip, self.last = base, [], 0, None

    def add(self, departs: str | None, arrives: str | None) -> None:
        known = departs is not None and arrives is not None
        ends = known and self.last is not None and arrives == self.base
        if known and self.last == (self.base, self.base) and not ends and departs != arrives:
            self.trip += 1
        self.out.append(self.trip)
        self.last = (departs, arrives)
        if ends:
            self.trip, self.last = self.trip + 1, None


def trips(flights: DataFrame, base: str, aircraft: str = "system_id", start: str = "start_time", departs: str = "start_icao", arrives: str = "end_icao", order: Sequence[str] = ()) -> DataFrame:
    """``flights`` with trip_idx, from 0 for each aircraft; flights of no aircraft belong to no trip."""
    found = scan(flights.where(F.col(aircraft).isNotNull()), [departs, arrives], [aircraft], [start, *order], "trip_idx", "int", lambda: Trips(base))
    return found.unionByName(flights.where(F.col(aircraft).isNull()).withColumn("trip_idx", F.lit(None).cast("int")))


def trip_measures(start: str = "start_time", order: Sequence[str] = ()) -> dict[str, Column]:
    """Aggregates of flights at any level: sums, ratios of sums, and what belongs to the oldest or the newest flight.

    Flights have distance, hours, fuel_used, fuel_from, fuel_to, altitude.
    """
    at = F.struct(start, *order)
    ratio = lambda a, b: F.sum(a) / F.nullif(F.sum(b), F.lit(0.0))
    return {
        "n_flights": F.count("*"), "fuel_start": F.min_by("fuel_from", at), "fuel_end": F.max_by("fuel_to", at),
        "distance": F.sum("distance"), "hours": F.sum("hours"), "fuel_used": F.sum("fuel_used"), "altitude": F.max("altitude"),
        "ground_speed": ratio("distance", "hours"), "gph": ratio("fuel_used", "hours"), "nm_per_gallon": ratio("distance", "fuel_used"),
    }


def trip_totals(flights: DataFrame, keys: Sequence[str], start: str = "start_time", order: Sequence[str] = ()) -> DataFrame:
    """Fuel at the start and end, sums, and ratios of sums for each trip, by ``trip_measures``."""
    return flights.groupBy(*keys).agg(*[c.alias(n) for n, c in trip_measures(start, order).items()])


def trip_table(flights: DataFrame, levels: Sequence[str], detail: str, start: str = "start_time", order: Sequence[str] = ()) -> DataFrame:
    """The rows of a table of trips: every flight, a total for each of the levels (an aircraft, a trip), and one over all.

    level counts the levels that a row is of (flights: one more), oldest and newest are the times of its first and last flight, and place
    is its position within its parent, the newest first, each trip's flights too. Measures are those of ``trip_measures`` at every level, so
    ratios are of sums, and fuel at the start and end is that of the oldest and the newest flight. All levels are summed in one pass.
    """
    names = [*levels, detail]
    out = flights.rollup(*names).agg(F.grouping_id().alias("__g"), F.min(start).alias("oldest"), F.max(start).alias("newest"), *[c.alias(n) for n, c in trip_measures(start, order).items()])
    # A level that is rolled up sets the bits of all below it.
    out = out.withColumn("level", (F.lit(len(names)) - F.bit_count("__g")).cast("int"))
    own = lambda k: F.when(F.col("level") > k + 1, F.col(names[k]))
    w = Window.partitionBy("level", *[own(k) for k in range(len(names))]).orderBy(F.desc("newest"), *[F.desc(n) for n in names])
    return out.withColumn("place", F.row_number().over(w)).drop("__g")


def nights(flights: DataFrame, key: Sequence[str], start: str = "start_time", departs: str = "start_icao", arrives: str = "end_icao", order: Sequence[str] = (), connected: bool = False) -> DataFrame:
    """Nights between a flight and the one before, by the airport that the later one leaves; local flights do not count.

    ``key`` parts the flights (an owner, a fleet), so that no task gets all. ``connected``: only where the flight before
    arrived at that airport.
    """
    away = flights.where(F.col(departs).isNotNull() & F.col(arrives).isNotNull() & (F.col(departs) != F.col(arrives)))
    w = Window.partitionBy(*key).orderBy(start, *order)
    stays = away.withColumn("nights", F.datediff(F.to_date(start), F.lag(F.to_date(start)).over(w))).withColumn("__at", F.lag(arrives).over(w)).where("nights IS NOT NULL")
    if connected:
        stays = stays.where(F.col("__at") == F.col(departs))
    return stays.groupBy(F.col(departs).alias("airport"), *key).agg(F.sum("nights").cast("long").alias("nights"), F.count("*").alias("visits"))


def home_base(by_airport: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, base: the airport with the most nights; of equals the first by name; none without a night."""
    best = F.min_by("airport", F.struct(-F.col("nights"), F.col("airport")))
    return by_airport.where("nights > 0").groupBy(*key).agg(best.alias("base"))


def flown_legs(rows: DataFrame, columns: Sequence[str], key: Sequence[str], order: Sequence[str], ts: str, takeoff: DataFrame | None = None) -> DataFrame:
    """key, leg_idx, ``columns``, start, end: a key's runs of equal values from its take-off on; the last ends with the log.

    ``takeoff`` has the key and takeoff, one row a key; keys without one have no legs. Without the table runs count
    from the first row, as for routes.
    """
    at = rows.withColumn("__last", F.max(ts).over(Window.partitionBy(*key)))
    if takeoff is not None:
        own = takeoff.select(*key, F.col("takeoff").alias("__from")).where("__from IS NOT NULL")
        at = at.join(own, list(key)).where(F.col(ts) >= F.col("__from"))
    runs = legs(at, columns, key, order).groupBy(*key, "leg_idx")
    found = runs.agg(*[F.first(c).alias(c) for c in columns], F.min(ts).alias("start"), F.max("__last").alias("__last"))
    return leg_ends(found, key, "start", "__last", order=["leg_idx"]).drop("__last")


def subtotals(rows: DataFrame, group: Sequence[str], detail: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Detail rows and one total row a group (detail columns null, is_total 1)."""
    agg = [F.sum(c).alias(c) for c in sums]
    total = rows.groupBy(*group).agg(*agg).withColumn("is_total", F.lit(1))
    return rows.groupBy(*group, *detail).agg(*agg).withColumn("is_total", F.lit(0)).unionByName(total, allowMissingColumns=True)
