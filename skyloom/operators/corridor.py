"""Planned against flown, and routing options across flights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.geo import cross_track_nm, distance_nm, headwind
from skyloom.functions.text import finite
from skyloom.operators.clusters import clustered as clustered
from skyloom.operators.clusters import complete_linkage as complete_linkage
from skyloom.operators.clusters import fix_distances as fix_distances
from skyloom.operators.clusters import labelled as labelled
from skyloom.operators.joins import abeam
from skyloom.operators.series import by, distance_run


def reconcile(plan: DataFrame, track: DataFrame, key: Sequence[str]) -> DataFrame:
    """Planned and flown figures of each waypoint, and of the leg that leads to the next one.

    ``plan``: key, seq, name, lat, lon, fuel, elapsed. ``track``: key, row_idx, lat, lon, fuel, elapsed.
    """
    flown = distance_run(track, "lat", "lon", key, ["row_idx"])
    own = flown.select(*key, "row_idx", F.col("fuel").alias("flown_fuel"), F.col("elapsed").alias("flown_elapsed"), F.col("distance").alias("flown_nm"))
    at = plan.join(abeam(plan, track, key), [*key, "seq"], "left").join(own, [*key, "row_idx"], "left")
    w = by(key, ["seq"])
    after = lambda c: F.lead(c).over(w)
    return at.select(
        "*",
        (F.col("flown_fuel") - F.col("fuel")).alias("fuel_delta"), (F.col("flown_elapsed") - F.col("elapsed")).alias("elapsed_delta"),
        distance_nm(F.col("lat"), F.col("lon"), after("lat"), after("lon")).alias("leg_planned_nm"),
        F.when(after("row_idx") > F.col("row_idx"), after("flown_nm") - F.col("flown_nm")).alias("leg_flown_nm"),
        (after("flown_elapsed") - F.col("flown_elapsed")).alias("leg_flown_s"), (after("elapsed") - F.col("elapsed")).alias("leg_planned_s"),
        (F.col("flown_fuel") - after("flown_fuel")).alias("leg_fuel"),
    )


def inside(rows: DataFrame, box: tuple[float, float, float, float], margin_nm: float = 35.0) -> DataFrame:
    """Rows (lat, lon) within a box (south, west, north, east) and a margin around it."""
    south, west, north, east = box
    up = margin_nm / 60
    side = up / max(0.2, float(np.cos(np.radians((south + north) / 2))))
    return rows.where(F.col("lat").between(south - up, north + up) & F.col("lon").between(west - side, east + side))


def offset_profile(track: DataFrame, a: tuple[float, float], b: tuple[float, float], key: Sequence[str], order: Sequence[str], n: int = 9) -> DataFrame:
    """key, offsets: the distance off the line from a to b at n even fractions of the distance flown."""
    rows = distance_run(track.where("lat IS NOT NULL AND lon IS NOT NULL"), "lat", "lon", key, order, "run")
    rows = rows.withColumn("__all", F.max("run").over(Window.partitionBy(*key)))
    off = cross_track_nm(F.col("lat"), F.col("lon"), *map(F.lit, (*a, *b)))
    at = [F.min_by(off, F.when(F.col("run") >= F.col("__all") * k / (n + 1), F.struct("run", *order))).alias(f"o{k}") for k in range(1, n + 1)]
    return rows.groupBy(*key).agg(*at).select(*key, F.array(*[f"o{k}" for k in range(1, n + 1)]).alias("offsets"))


#: The route rules that are used where none are given, the first that holds first.
RULES = (
    {"label": "OCAS (low, OCK/LYD)", "any_prefix": ["M25"]},
    {"label": "Airways + CMB shortcut", "any_of": ["GWC"], "all_of": ["CMB"]},
    {"label": "Airways (no shortcut)", "any_of": ["GWC"]},
    {"label": "OCAS (low, OCK/LYD)", "any_of": ["OCK", "LYD", "LZD", "RINTI", "DVR"]},
)


def classified(sequence: Column, rules: Sequence[Mapping[str, object]] = RULES, altitude: Column | None = None, other: str = "Direct / other") -> Column:
    """The label of the first rule that a fix sequence (and the highest altitude) meets.

    A rule's tests, all of which must hold: all_of, any_of, none_of (fixes), any_prefix (of a fix), alt_above, alt_below.
    An unknown altitude is neither above nor below.
    """
    out = F.lit(other)
    for rule in reversed(rules):
        tests = [F.array_contains(sequence, fix) for fix in rule.get("all_of", ())]
        if rule.get("any_of"):
            tests.append(F.arrays_overlap(sequence, F.array(*map(F.lit, rule["any_of"]))))
        if rule.get("any_prefix"):
            tests.append(_any_starts_with(sequence, rule["any_prefix"]))
        tests += [~F.array_contains(sequence, fix) for fix in rule.get("none_of", ())]
        if "alt_above" in rule:
            tests.append(altitude > rule["alt_above"])
        if "alt_below" in rule:
            tests.append(altitude < rule["alt_below"])
        out = F.when(reduce(and_, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True)), rule["label"]).otherwise(out)
    return out


def _any_starts_with(sequence: Column, prefixes: Sequence[str]) -> Column:
    return F.exists(sequence, lambda x: reduce(or_, [x.startswith(p) for p in prefixes]))


def renamed(label: Column, names: Mapping[str, str]) -> Column:
    """The name given to a label, else the label."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[label], label) if names else label


def last_events(events: DataFrame, key: Sequence[str], ident: str, order: Sequence[str]) -> DataFrame:
    """The last event of each name."""
    return events.groupBy(*[F.col(k).alias(f"__{k}") for k in key], F.col(ident).alias("__i")).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("__row")).select("__row.*")


def with_events(plan: DataFrame, events: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``plan`` (key, name) with the values of the last event of the waypoint's name; null where it was never flown to."""
    own = last_events(events, key, "name", order).select(*key, "name", *[F.col(v).alias(f"event_{v}") for v in values])
    return plan.join(own, [*key, "name"], "left")


def accuracy(legs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean errors and fuel sums of each plan over its reliable legs.

    ``legs``: key, reliable, overflown, actual_gs, planned_gs, actual_time_s, planned_time_s, actual_fuel, planned_fuel,
    actual_fuel_tank, headwind_actual, headwind_planned. Speeds and times of 0 count as unknown. What the order of adding leaves in the
    last binary places is rounded off first, so that a half goes up whatever the order.
    """
    steady = lambda c, places=0: F.round(F.round(c, places + 7), places)
    told = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    sure = lambda x: F.when(F.col("reliable"), x)
    total = lambda c: steady(F.coalesce(F.sum(sure(F.col(c))), F.lit(0.0)), 1)
    return legs.groupBy(*key).agg(
        F.count(F.when(F.col("reliable"), 1)).alias("n_reliable_legs"), steady(F.avg(sure(told("actual_gs") - told("planned_gs"))), 1).alias("mean_gs_err_kt"),
        steady(F.avg(sure(told("actual_time_s") - told("planned_time_s")))).alias("mean_leg_time_err_s"), steady(F.avg(sure(F.col("actual_fuel") - F.col("planned_fuel"))), 2).alias("mean_leg_fuel_err_gal"),
        steady(F.avg(F.when(F.col("overflown"), F.col("headwind_actual") - F.col("headwind_planned"))), 1).alias("mean_headwind_err_kt"),
        total("planned_fuel").alias("reliable_fuel_plan_gal"), total("actual_fuel").alias("reliable_fuel_totaliser_gal"), total("actual_fuel_tank").alias("reliable_fuel_tank_gal"),
    )


#: Miles off a waypoint within which it counts as overflown.
NEAR_NM = 5.0


def reconciled_waypoints(plan: DataFrame, track: DataFrame, events: DataFrame, key: Sequence[str], order: Sequence[str], overflown_nm: float = NEAR_NM) -> DataFrame:
    """Each planned waypoint with the nearest row of the track, what differs there from the plan, and the last event of its name.

    ``plan``: key, seq, name, lat, lon, eta_s, fuel_used, gs, wind_dir, wind_speed, crs, dist_leg, leg_time_s. ``track``: key, row_idx, lat, lon, elapsed, fuel,
    fuel_burn, gs, tas, alt, wind_dir, wind_speed, trk. ``events``: key, name, row_idx and the ``order`` columns. A tank that reads 1 or less tells nothing. What was not near any row, as
    without a position, has nulls.
    """
    flown = distance_run(track, "lat", "lon", key, ["row_idx"])
    own = flown.select(*key, "row_idx", F.col("elapsed").alias("abeam_elapsed_s"), F.when(F.col("fuel") > 1, F.col("fuel")).alias("abeam_fuel"), finite(F.col("fuel_burn")).alias("fuel_used_actual"), F.col("distance").alias("__run"),
                       *[finite(F.col(c)).alias(f"abeam_{c}") for c in ("gs", "tas", "alt", "wind_dir", "wind_speed", "trk")])
    at = plan.join(abeam(plan, track, key).withColumnRenamed("offset_nm", "lateral_offset_nm"), [*key, "seq"], "left").join(own, [*key, "row_idx"], "left")
    out = at.select(
        "*", (F.col("lateral_offset_nm") <= overflown_nm).alias("overflown"), (F.col("abeam_elapsed_s") - F.col("eta_s")).alias("eta_delta_s"),
        (F.col("fuel_used_actual") - F.col("fuel_used")).alias("fuel_used_delta"), (F.col("abeam_gs") - F.col("gs")).alias("gs_delta"),
        headwind(F.col("wind_speed"), F.col("wind_dir"), F.col("crs")).alias("headwind_planned"), headwind(F.col("abeam_wind_speed"), F.col("abeam_wind_dir"), F.col("abeam_trk")).alias("headwind_actual"),
    )
    return with_events(out, events.withColumn("row", F.col("row_idx")), key, order, ["row"])


def reconciled_legs(waypoints: DataFrame, key: Sequence[str]) -> DataFrame:
    """The legs between consecutive waypoints of ``reconciled_waypoints``, as ``accuracy`` takes them; reliable between two that were overflown.

    Distances are along the track, where the later waypoint was passed later; speeds are of those.
    """
    w = by(key, ["seq"])
    after = lambda c: F.lead(c).over(w)
    rows = waypoints.select(
        *key, "seq", F.col("name").alias("frm"), after("name").alias("to"), after("dist_leg").alias("planned_dist_nm"), after("leg_time_s").alias("planned_time_s"), after("gs").alias("planned_gs"),
        (F.coalesce(F.col("overflown"), F.lit(False)) & F.coalesce(after("overflown"), F.lit(False))).alias("reliable"), (after("fuel_used") - F.col("fuel_used")).alias("planned_fuel"),
        (after("abeam_elapsed_s") - F.col("abeam_elapsed_s")).alias("actual_time_s"), (after("fuel_used_actual") - F.col("fuel_used_actual")).alias("actual_fuel"), (F.col("abeam_fuel") - after("abeam_fuel")).alias("actual_fuel_tank"),
        F.when(after("row_idx") > F.col("row_idx"), after("__run") - F.col("__run")).alias("actual_dist_nm"),
    ).where("to IS NOT NULL")
    return rows.withColumn("actual_gs", F.when(F.col("actual_time_s") > 0, F.col("actual_dist_nm") / (F.col("actual_time_s") / 3600)))


def off_plan(events: DataFrame, plan: DataFrame, key: Sequence[str]) -> DataFrame:
    """The waypoints that were flown to but not planned, in the order of the events."""
    return events.join(plan.select(*key, "name").distinct(), [*key, "name"], "left_anti")


def reconciled_accuracy(waypoints: DataFrame, legs: DataFrame, key: Sequence[str]) -> DataFrame:
    """``accuracy`` of ``reconciled_legs``, with the headwind error of the waypoints that were overflown."""
    wind = waypoints.select(*key, "overflown", "headwind_actual", "headwind_planned").withColumn("reliable", F.lit(None).cast("boolean"))
    return accuracy(legs.unionByName(wind, allowMissingColumns=True), key)


def plan_totals(plan: DataFrame, track: DataFrame, waypoints: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The totals of each plan against its log: ``flown_totals``, the length of the planned route, what was saved, and how many waypoints were overflown or skipped."""
    w = by(key, ["seq"])
    leg = distance_nm(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    route = plan.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("__leg", leg).groupBy(*key).agg(F.round(F.coalesce(F.sum("__leg"), F.lit(0.0)), 1).alias("planned_route_gc_nm"))
    passed = waypoints.groupBy(*key).agg(F.count_if("overflown").alias("n_overflown"), F.count_if(F.col("lateral_offset_nm").isNotNull() & ~F.col("overflown")).alias("n_skipped"))
    out = passed.join(route, list(key), "left").join(flown_totals(track, key, order), list(key), "left")
    return out.withColumn("dist_saved_nm", F.round(F.col("planned_route_gc_nm") - F.col("flown_dist_nm"), 1))


def flown_totals(track: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distance, airborne time (first to last row faster than 40), burn and fuel left of each log (elapsed, lat, lon, gs, fuel_burn, fuel).

    Fuel that reads 1 gallon or less tells nothing; a log that never flew has its whole time.
    """
    rows = distance_run(track, "lat", "lon", key, order, "__run")
    fast = F.when(F.col("gs") > 40, F.col("elapsed"))
    told = F.when(F.col("fuel") > 1, F.struct(*order))
    out = rows.groupBy(*key).agg(
        F.round(F.max("__run"), 1).alias("flown_dist_nm"), F.round(F.coalesce(F.max(fast) - F.min(fast), F.max("elapsed") - F.min("elapsed"))).alias("airborne_s"),
        F.min_by("fuel", told).alias("fuel_start_gal"), F.max_by("fuel", told).alias("fuel_end_gal"), F.round(F.max_by("fuel_burn", F.struct(*order)), 1).alias("burned_gal"),
    )
    return out.withColumn("burned_tank_gal", F.round(F.col("fuel_start_gal") - F.col("fuel_end_gal"), 1)).withColumn("remaining_gal", F.round(F.col("fuel_start_gal") - F.col("burned_gal"), 1))


def planned_climb_descent(plan: DataFrame, key: Sequence[str], top: str = "-TOC-", down: str = "-TOD-") -> DataFrame:
    """Planned climb (departure to top of climb) and descent (top of descent to destination) of each plan.

    ``plan``: key, seq, name, eta_s, fuel_used, dist_leg, dist_rem, altitude, tas, gs.
    """
    w = by(key, ["seq"])
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    get = lambda c, test: F.max_by(c, F.when(test, F.col("seq"))).over(whole)
    is_top, is_down = F.col("name") == top, F.col("name") == down
    rows = plan.withColumn("__down", F.max(F.when(is_down, F.col("eta_s"))).over(whole))
    late = lambda c: F.avg(F.when(F.col("eta_s") >= F.col("__down"), F.col(c))).over(whole)
    first, last = (lambda c: F.min_by(c, "seq").over(whole)), (lambda c: F.max_by(c, "seq").over(whole))
    # All over one sort of a plan's rows: what a task holds is that sort, which spills, and no table of its plans.
    out = rows.select(
        *key, F.row_number().over(w).alias("__at"),
        get("eta_s", is_top).alias("climb_s"), (get("fuel_used", is_top) - first("fuel_used")).alias("climb_gal"), get("dist_leg", is_top).alias("climb_nm"), (get("altitude", is_top) - first("altitude")).alias("climb_ft"),
        (last("eta_s") - F.col("__down")).alias("descent_s"), (last("fuel_used") - get("fuel_used", is_down)).alias("descent_gal"), get("dist_rem", is_down).alias("descent_nm"),
        (last("altitude") - get("altitude", is_down)).alias("descent_ft"), late("tas").alias("descent_tas"), late("gs").alias("descent_gs"),
    ).where("__at = 1").drop("__at")
    rate = lambda c: F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_ft") / (F.col(f"{c}_s") / 60))
    return out.withColumns({"climb_fpm": rate("climb"), "descent_fpm": rate("descent")})


def corridor_segments(tracks: DataFrame, anchor: tuple[float, float], via: tuple[float, float], key: str, order: str, anchor_nm: float = 8.0, via_nm: float = 14.0, least_rows: int = 30, least_segment: int = 10) -> DataFrame:
    """The rows (lat, lon) of each track between the anchor and its closest approach to the via point, with ``direction`` (out,
    in), ``near_via_nm`` and ``step``, which numbers the rows from the anchor to the via point.

    Taken are tracks that start or end within ``anchor_nm`` of the anchor and come within ``via_nm`` of the via point, with
    enough rows. Keys without a chance are told by their ends and their closest row before any row is shuffled.
    """
    point = lambda p: [F.lit(p[0]), F.lit(p[1])]
    rows = tracks.where("lat IS NOT NULL AND lon IS NOT NULL")
    rows = rows.withColumn("__a", distance_nm(F.col("lat"), F.col("lon"), *point(anchor))).withColumn("__v", distance_nm(F.col("lat"), F.col("lon"), *point(via)))
    told = rows.groupBy(key).agg(F.min_by("__a", order).alias("__start"), F.max_by("__a", order).alias("__end"), F.min(F.struct("__v", order)).alias("__near"), F.count("*").alias("__n"))
    told = told.where((F.least("__start", "__end") <= anchor_nm) & (F.col("__near.__v") <= via_nm) & (F.col("__n") >= least_rows))
    told = told.select(key, F.when(F.col("__start") <= F.col("__end"), "out").otherwise("in").alias("direction"), F.col("__near.__v").alias("near_via_nm"), F.col(f"__near.{order}").alias("__cut"))
    cut = rows.join(told, key).where(F.when(F.col("direction") == "out", F.col(order) <= F.col("__cut")).otherwise(F.col(order) >= F.col("__cut")))
    n, i = F.count("*").over(Window.partitionBy(key)), F.row_number().over(Window.partitionBy(key).orderBy(order))
    cut = cut.withColumn("__n", n).withColumn("__i", i).where(F.col("__n") >= least_segment)
    return cut.withColumn("step", F.when(F.col("direction") == "out", F.col("__i") - 1).otherwise(F.col("__n") - F.col("__i"))).drop("__a", "__v", "__cut", "__n", "__i")


def segment_figures(segments: DataFrame, key: Sequence[str]) -> DataFrame:
    """Track, time, still-air time, speeds, altitudes and fuel of each segment of ``corridor_segments`` (elapsed, tas, alt, fuel_burn).

    In still air each step takes as long as at the airspeed of its later point, where that is above 40.
    """
    w = by(key, ["step"])
    d = distance_nm(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    rows = segments.withColumn("__d", d).withColumn("__tas", F.when(F.col("tas") > 40, finite(F.col("tas"))))
    ends = lambda c: F.abs(F.max_by(c, "step") - F.min_by(c, "step"))
    out = rows.groupBy(*key).agg(
        F.coalesce(F.sum("__d"), F.lit(0.0)).alias("track_nm"), ends("elapsed").alias("time_s"), (F.sum(F.col("__d") / F.col("__tas")) * 3600).alias("still_air_s"),
        F.avg("__tas").alias("avg_tas"), F.avg(finite(F.col("alt"))).alias("avg_alt"), F.max(finite(F.col("alt"))).alias("max_alt"), ends("fuel_burn").alias("fuel_gal"),
    )
    return out.withColumn("avg_gs", F.when(F.col("time_s") > 0, F.col("track_nm") / (F.col("time_s") / 3600)))


def fix_sequences(events: DataFrame, via: tuple[float, float], directions: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """key, fixes: the names flown to up to (inbound: from) the event nearest to the via point, in order. ``directions``: key, direction."""
    rows = events.withColumn("__d", distance_nm(F.col("lat"), F.col("lon"), F.lit(via[0]), F.lit(via[1])))
    at = F.min(F.struct("__d", order)).over(Window.partitionBy(key))[order]
    rows = rows.withColumn("__at", at).join(directions.select(key, "direction"), key)
    own = rows.where(F.when(F.col("direction") == "out", F.col(order) <= F.col("__at")).otherwise(F.col(order) >= F.col("__at")))
    return own.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(name).alias("n")))), lambda x: x["n"]).alias("fixes"))


def wind_tag(still_air_s: Column, time_s: Column) -> Column:
    """tail or head, and by how many minutes; - where either time is unknown or 0."""
    wind = F.nullif(still_air_s, F.lit(0.0)) - F.nullif(time_s, F.lit(0.0))
    return F.when(wind.isNull(), "-").otherwise(F.concat(F.when(wind > 0, "tail ").otherwise("head "), F.bround(F.abs(wind) / 60).cast("int").cast("string"), F.lit("m")))


def option_rows(flights: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Means of each option, its size, and tags against the midrange of its direction (the first key)."""
    means = flights.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(finite(F.col(m))).alias(m) for m in measures])
    tag = _against_midrange(measures[0], 6.0, "short", "long", keys[0])
    return means.withColumn("tag", tag).withColumn("best", F.col(measures[-1]) == F.min(measures[-1]).over(Window.partitionBy(keys[0])))


def _against_midrange(column: str, spread: float, low: str, high: str, direction: str) -> Column:
    w = Window.partitionBy(direction)
    own = F.nullif(F.col(column), F.lit(0.0))
    top, bottom = F.max(own).over(w), F.min(own).over(w)
    return F.when(top - bottom > spread, F.when(F.col(column) < (top + bottom) / 2, low).otherwise(high)).otherwise("med")


def profiles(options: DataFrame, direction: str, track: str = "track_nm", altitude: str = "avg_alt") -> DataFrame:
    """``options`` with profile: short, long or med by track, and low, high or med by altitude, against the direction's midrange."""
    return options.withColumn("profile", F.concat_ws("/", _against_midrange(track, 6.0, "short", "long", direction), _against_midrange(altitude, 1500.0, "low", "high", direction)))


def head_to_head(options: DataFrame, direction: str, order: Sequence[str], label: str = "label", air: str = "still_air_s", track: str = "track_nm", altitude: str = "avg_alt") -> DataFrame:
    """direction, a, b, faster, air_min, track_nm, alt_ft: the first two options of each direction compared."""
    rows = options.withColumn("__k", F.row_number().over(Window.partitionBy(direction).orderBy(*order)))
    of = lambda c, k: F.max(F.when(F.col("__k") == k, F.col(c)))
    both = rows.where("__k <= 2").groupBy(direction).agg(*[of(c, k).alias(f"{c}__{k}") for c in (label, air, track, altitude) for k in (1, 2)])
    both = both.where((F.col(f"{air}__1") != 0) & (F.col(f"{air}__2") != 0))
    apart = lambda c: F.col(f"{c}__2") - F.col(f"{c}__1")
    return both.select(
        direction, F.col(f"{label}__1").alias("a"), F.col(f"{label}__2").alias("b"), F.when(apart(air) > 0, F.col(f"{label}__1")).otherwise(F.col(f"{label}__2")).alias("faster"),
        F.abs(apart(air) / 60).alias("air_min"), F.abs(apart(track)).alias("track_nm"), F.abs(apart(altitude)).alias("alt_ft"),
    )
