"""Registered queries of fuel planning, whole reconciliation, and the tables that reports show, made from the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions import fuel, text
from skyloom.operators import catalog, clusters, corridor, flights, phase
from skyloom.plans.catalogue import _FLIGHTS, KEY, ORDER, _flights, _sql_distance, _t, query
from skyloom.plans.recorder import _TRACK, _r, _track


def _positive(left: str, right: str) -> tuple[str, str]:
    own = lambda a, b: f"(CASE WHEN {a} < 0 AND {b} > 0 THEN 0 WHEN {a} > 0 AND {b} < 0 THEN greatest({a} + {b}, 0) ELSE greatest({a}, 0) END)"
    return own(left, right), own(right, left)


def _analysis_sql() -> str:
    ml, mr = _positive("tl - cl", "tr - cr")
    ul, ur = _positive("sl - ul", "sr - ur")
    fill = lambda x, more: f"greatest(least({x} + {more}, 46), {x})"
    return f"""f AS (SELECT s_suppkey, (s_suppkey * 7 % 40)::DOUBLE AS cl, (s_suppkey * 11 % 40)::DOUBLE AS cr, (s_suppkey * 3 % 20)::DOUBLE / 2 AS ad, (s_suppkey % 13)::DOUBLE AS ul, (s_suppkey % 29)::DOUBLE AS ur, (s_suppkey % 17)::DOUBLE AS sl, (s_suppkey % 23)::DOUBLE AS sr,
 35.0::DOUBLE AS tl, 20.0::DOUBLE AS tr FROM supplier),
g AS (SELECT *, {ml} AS ml, {mr} AS mr, {ul} AS kl, {ur} AS kr FROM f),
h AS (SELECT s_suppkey, cl + cr AS c, kl + kr AS k, {fill("cl", "ml")} + {fill("cr", "mr")} AS w, {fill("cl", "ad")} + {fill("cr", "ad")} AS a, {fill("kl", "ad")} + {fill("kr", "ad")} AS b FROM g),
out AS (SELECT s_suppkey, c AS current, k AS current_totalizer, w AS target, w - c AS target_add, w - k AS target_add_totalizer, 92 - w AS target_save, (92 - w) * 3.785411784 * 0.71 AS target_save_kg,
 a AS added_total, a - c AS added_fuel, 92 - a AS added_save, (92 - a) * 3.785411784 * 0.71 AS added_save_kg, b AS added_total_totalizer, b - k AS added_fuel_totalizer, 92 - b AS added_save_totalizer, (92 - b) * 3.785411784 * 0.71 AS added_save_kg_totalizer,
 c / 17 * 3600 AS endurance, k / 17 * 3600 AS endurance_totalizer, a / 17 * 3600 AS added_endurance, b / 17 * 3600 AS added_endurance_totalizer, w / 17 * 3600 AS target_endurance, (92 - a) / 17 * 3600 AS lost_endurance, (92 - b) / 17 * 3600 AS lost_endurance_totalizer, (92 - w) / 17 * 3600 AS target_lost_endurance FROM h)"""


OUTPUTS = (
    "current", "current_totalizer", "target", "target_add", "target_add_totalizer", "target_save", "target_save_kg", "added_total", "added_fuel", "added_save", "added_save_kg", "added_total_totalizer",
    "added_fuel_totalizer", "added_save_totalizer", "added_save_kg_totalizer", "endurance", "endurance_totalizer", "added_endurance", "added_endurance_totalizer", "target_endurance", "lost_endurance", "lost_endurance_totalizer", "target_lost_endurance",
)


def _analysed(spark, sf_dir):
    k = F.col("s_suppkey")
    both = lambda v: fuel.tanks(F.lit(float(v)), F.lit(float(v)))
    rows = _t(spark, sf_dir, "supplier").select(k)
    return fuel.analysed(rows, fuel.tanks(k * 7 % 40, k * 11 % 40), fuel.tanks(k % 13, k % 29), fuel.tanks(F.lit(35.0), F.lit(20.0)), fuel.halves((k * 3 % 20).cast("double")), fuel.tanks(k % 17, k % 23), both(46), F.lit(17.0))


@query(f"WITH {_analysis_sql()} SELECT s_suppkey, {', '.join(f'round({c}, 6) AS {c}' for c in OUTPUTS)} FROM out")
def fuel_analysis(spark, sf_dir):
    return _analysed(spark, sf_dir).select("s_suppkey", *[F.round(f"analysis.{c}", 6).alias(c) for c in OUTPUTS])


_LINES = ", ".join(f"{{'line': {i}, 'title': '{t}', 'gauges': round({a}, 6), 'totalizer': round({b}, 6), 'unit': '{u}'}}" for i, (t, a, b, u) in enumerate(fuel.PLANNING))


@query(f"WITH {_analysis_sql()} SELECT s_suppkey, l.line::INT AS line, l.title AS title, l.gauges AS gauges, l.totalizer AS totalizer, l.unit AS unit FROM (SELECT s_suppkey, unnest([{_LINES}]) AS l FROM out)")
def fuel_planning(spark, sf_dir):
    rows = fuel.planning_table(_analysed(spark, sf_dir), "s_suppkey")
    return rows.select("s_suppkey", "line", "title", *_r("gauges", "totalizer", places=6), "unit")


@query("""WITH t AS (SELECT s_suppkey, (s_suppkey % 7 - 3)::DOUBLE AS al, (s_suppkey % 5 - 2 + 0.25)::DOUBLE AS ar, (s_suppkey % 4 - 1)::DOUBLE AS bl, (s_suppkey % 3)::DOUBLE AS br FROM supplier)
SELECT s_suppkey, ceil(al) AS up_left, ceil(ar) AS up_right, floor(ar * 3.785411784) AS litres_right, greatest(al, bl) AS most_left, least(ar, br) AS least_right, al + ar < bl + br AS less, al + ar = bl + br AS same, abs(al + ar - bl - br) < 2 AS near,
 CASE WHEN al < 0 AND ar > 0 THEN 0 WHEN al > 0 AND ar < 0 THEN greatest(al + ar, 0) ELSE greatest(al, 0) END AS positive_left, CASE WHEN ar < 0 AND al > 0 THEN 0 WHEN ar > 0 AND al < 0 THEN greatest(al + ar, 0) ELSE greatest(ar, 0) END AS positive_right FROM t""")
def tank_algebra(spark, sf_dir):
    k = F.col("s_suppkey")
    a, b = F.col("a"), F.col("b")
    rows = _t(spark, sf_dir, "supplier").select(k, fuel.tanks(k % 7 - 3, k % 5 - 2 + F.lit(0.25)).alias("a"), fuel.tanks(k % 4 - 1, k % 3).alias("b"))
    up, own = fuel.rounded(a), fuel.positive(a)
    return rows.select(
        k, up["left"].alias("up_left"), up["right"].alias("up_right"), fuel.rounded(a, F.floor, "gallon", "liter")["right"].alias("litres_right"), fuel.most_of(a, b)["left"].alias("most_left"), fuel.least_of(a, b)["right"].alias("least_right"),
        fuel.less(a, b).alias("less"), fuel.same(a, b).alias("same"), fuel.within(a, b, 2.0).alias("near"), own["left"].alias("positive_left"), own["right"].alias("positive_right"),
    )


_SPANS = """s AS (SELECT o_orderkey AS log_id, o_orderdate AS t, o_totalprice / 1013.77 AS distance, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 8737.31 ELSE 0 END AS counted, 50.0 + o_orderkey % 9 AS fl, 40.0 + o_orderkey % 7 AS fr, 30.0 + o_orderkey % 5 AS el, 25.0::DOUBLE AS er, (70 + o_orderkey % 50 * 3) AS moved, 60 + o_orderkey % 30 AS flown FROM orders)"""


def _spans(spark, sf_dir):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    at = lambda m: t + F.make_dt_interval(mins=m)
    return _t(spark, sf_dir, "orders").select(
        k.alias("log_id"), t.alias("hobbs_start"), at((F.lit(80) + k % 50 * 3).cast("int")).alias("hobbs_end"), at(F.lit(5)).alias("moving_start"), at((F.lit(75) + k % 50 * 3).cast("int")).alias("moving_end"), at(F.lit(9)).alias("flying_start"), at((F.lit(69) + k % 30).cast("int")).alias("flying_end"),
        (F.col("o_totalprice") / 1013.77).alias("distance"), F.when(k % 3 > 0, F.col("o_totalprice") / 8737.31).otherwise(0.0).alias("fuel_totalizer"), fuel.tanks(50.0 + k % 9, 40.0 + k % 7).alias("fuel_start"), fuel.tanks(30.0 + k % 5, F.lit(25.0)).alias("fuel_end"),
    )


@query(f"""WITH {_SPANS}, f AS (SELECT *, CASE WHEN counted > 0 THEN counted ELSE fl + fr - el - er END AS used FROM s)
SELECT log_id, round(used, 7) AS fuel_used, round(distance / (CASE WHEN moved - flown > flown THEN moved ELSE flown END / 60), 6) AS ground_speed, round(used / (moved / 60), 6) AS gph, round(distance / used, 6) AS nm_per_gallon FROM f""")
def flight_measures(spark, sf_dir):
    return flights.measures(_spans(spark, sf_dir)).select("log_id", *_r("fuel_used", places=7), *_r("ground_speed", "gph", "nm_per_gallon", places=6))


@query(f"""WITH {_SPANS} SELECT log_id, l.line::INT AS line, l.cell AS cell, l.since_s AS since_s, l.elapsed_s AS elapsed_s, round(l.logbook_h, 6) AS logbook_h FROM (SELECT log_id, unnest([
 {{'line': 0, 'cell': 'Start', 'since_s': 0.0::DOUBLE, 'elapsed_s': NULL::DOUBLE, 'logbook_h': NULL::DOUBLE}}, {{'line': 1, 'cell': 'Taxi', 'since_s': 300, 'elapsed_s': NULL, 'logbook_h': NULL}}, {{'line': 2, 'cell': 'Takeoff', 'since_s': 540, 'elapsed_s': NULL, 'logbook_h': NULL}},
 {{'line': 3, 'cell': 'Landing', 'since_s': 540 + flown * 60, 'elapsed_s': flown * 60, 'logbook_h': NULL}}, {{'line': 4, 'cell': 'Parked', 'since_s': 300 + moved * 60, 'elapsed_s': moved * 60, 'logbook_h': moved / 60}}, {{'line': 5, 'cell': 'Shutdown', 'since_s': 600 + moved * 60, 'elapsed_s': 600 + moved * 60, 'logbook_h': NULL}}]) AS l FROM s)""")
def flight_time_cells(spark, sf_dir):
    return catalog.time_cells(_spans(spark, sf_dir), "log_id").withColumn("logbook_h", F.round("logbook_h", 6))


@query(f"""WITH {_FLIGHTS}, l AS (SELECT system_id, count(*) AS n, max(start_time) AS last FROM f GROUP BY system_id), t AS (SELECT c_custkey, c_name, c_mktsegment, last FROM customer JOIN l ON c_custkey = system_id)
SELECT c_custkey AS system_id, x.line::INT AS line, x.title AS title, x.value AS value FROM (SELECT c_custkey, unnest([{{'line': 0, 'title': 'Identifier', 'value': c_name}}, {{'line': 1, 'title': 'Airframe', 'value': c_mktsegment}}, {{'line': 2, 'title': 'Last', 'value': strftime(last, '%Y-%m-%d')}}]) AS x FROM t)""")
def aircraft_summary_cells(spark, sf_dir):
    named = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("system_id"), F.col("c_name").alias("identifier"), "c_mktsegment")
    rows = catalog.aircraft_list(_flights(spark, sf_dir), named.select("system_id", "identifier"))
    rows = rows.join(named.select("system_id", F.col("c_mktsegment").alias("airframe_name")), "system_id")
    return catalog.aircraft_cells(rows)


@query(f"""WITH {_FLIGHTS}, s AS (SELECT log_id, system_id, log_file_name AS name, CASE WHEN log_id % 4 > 0 THEN start_time END AS told FROM f), p AS (SELECT *, lag(told) OVER w AS bt, lag(name) OVER w AS bn FROM s WINDOW w AS (PARTITION BY system_id ORDER BY log_id))
SELECT log_id, CASE WHEN told IS NOT NULL AND bt IS NOT NULL THEN told > bt ELSE name > bn END AS newer, CASE WHEN told IS NOT NULL AND bt IS NOT NULL THEN told < bt ELSE name < bn END AS older FROM p""")
def newer_and_older(spark, sf_dir):
    w = Window.partitionBy("system_id").orderBy("log_id")
    rows = _flights(spark, sf_dir).withColumn("at", F.when(F.col("log_id") % 4 > 0, F.col("start_time")))
    rows = rows.withColumn("bt", F.lag("at").over(w)).withColumn("bn", F.lag("log_file_name").over(w))
    args = [F.col(c) for c in ("at", "log_file_name", "bt", "bn")]
    return rows.select("log_id", catalog.is_newer(*args).alias("newer"), catalog.is_older(*args).alias("older"))


@query("""WITH d AS (SELECT event_id, (event_id * 7919 % 200000 - 40000)::BIGINT AS s FROM events)
SELECT event_id, CASE WHEN s < 0 THEN '-' ELSE '' END || abs(s) // 3600 || ':' || lpad((abs(s) % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(s) % 60)::VARCHAR, 2, '0') AS hms, CASE WHEN event_id % 5 = 0 THEN '-' ELSE CASE WHEN s < 0 THEN '-' ELSE '' END || abs(s) // 3600 || ':' || lpad((abs(s) % 3600 // 60)::VARCHAR, 2, '0') END AS hm,
 CASE WHEN s < 0 THEN '-' ELSE '' END || abs(s) // 60 || ':' || lpad((abs(s) % 60)::VARCHAR, 2, '0') AS ms FROM d""")
def shown_durations(spark, sf_dir):
    s = F.col("event_id") * 7919 % 200000 - 40000
    return _t(spark, sf_dir, "events").select("event_id", text.duration(s).alias("hms"), text.duration(F.when(F.col("event_id") % 5 > 0, s), "hm").alias("hm"), text.duration(s, "ms").alias("ms"))


@query(f"WITH {_FLIGHTS} SELECT log_file_name, system_id FROM f ORDER BY log_file_name DESC LIMIT 50")
def files_by_name(spark, sf_dir):
    return catalog.by_name(_flights(spark, sf_dir), "log_file_name").limit(50).select("log_file_name", "system_id")


@query(f"""WITH {_FLIGHTS} SELECT log_id, system_id, status, row_number() OVER (PARTITION BY system_id, status ORDER BY start_time, log_id)::INT AS nth FROM f""")
def cluster_flights_by_date(spark, sf_dir):
    return clusters.by_date(_flights(spark, sf_dir), ["system_id", "status"], "start_time", ["log_id"]).select("log_id", "system_id", "status", "nth")


_NAMES = "['view', 'click', 'nowhere', 'error', 'purchase']"
_WHOLE = f"""{_TRACK}, x AS (SELECT *, (event_id % 360)::DOUBLE AS wind_dir, (event_id % 40)::DOUBLE AS wind_speed, (event_id * 7 % 360)::DOUBLE AS trk FROM t),
s AS (SELECT *, coalesce({_sql_distance("lag(lat) OVER (PARTITION BY user_id ORDER BY row_idx)", "lag(lon) OVER (PARTITION BY user_id ORDER BY row_idx)", "lat", "lon")}, 0) AS step FROM x), r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY row_idx) AS run FROM s),
p AS (SELECT user_id, k, {_NAMES}[k + 1] AS name, CASE WHEN k <> 2 THEN 50 + k * 0.3::DOUBLE END AS lat, -1 + k * 0.1::DOUBLE AS lon, k * 600.0::DOUBLE AS eta_s, k * 2.0::DOUBLE AS fuel_used, 100.0::DOUBLE + k AS gs, k * 40.0::DOUBLE AS wind_dir, 10.0::DOUBLE AS wind_speed, k * 30.0::DOUBLE AS crs, k * 9.0::DOUBLE AS dist_leg, 600.0::DOUBLE AS leg_time_s FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(5)) AS k)),
v AS (SELECT user_id, event_type AS name, row_idx FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY row_idx) AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY row_idx DESC) AS back FROM t) WHERE (nxt IS DISTINCT FROM event_type OR back = 1) AND event_type <> ''),
lv AS (SELECT user_id, name, max(row_idx) AS event_row FROM v GROUP BY ALL),
d AS (SELECT p.user_id, k, row_idx, {_sql_distance("p.lat", "p.lon", "r.lat", "r.lon")} AS nm FROM p JOIN r USING (user_id) WHERE p.lat IS NOT NULL), b AS (SELECT user_id, k, arg_min(row_idx, (nm, row_idx)) AS row_idx, min(nm) AS off FROM d GROUP BY ALL),
w AS (SELECT p.*, b.row_idx, b.off, off <= 5 AS overflown, r.elapsed, CASE WHEN r.fuel > 1 THEN r.fuel END AS tank, r.fuel_burn AS burn, r.run, r.gs AS ags, event_row, p.wind_speed * cos(radians(p.wind_dir - p.crs)) AS hp, r.wind_speed * cos(radians(r.wind_dir - r.trk)) AS ha
 FROM p LEFT JOIN b USING (user_id, k) LEFT JOIN r ON r.user_id = p.user_id AND r.row_idx = b.row_idx LEFT JOIN lv ON lv.user_id = p.user_id AND lv.name = p.name),
l AS (SELECT user_id, k, name AS frm, lead(name) OVER z AS "to", lead(dist_leg) OVER z AS planned_dist_nm, lead(leg_time_s) OVER z AS planned_time_s, lead(gs) OVER z AS planned_gs, coalesce(overflown, false) AND coalesce(lead(overflown) OVER z, false) AS reliable, lead(fuel_used) OVER z - fuel_used AS planned_fuel,
 lead(elapsed) OVER z - elapsed AS actual_time_s, lead(burn) OVER z - burn AS actual_fuel, tank - lead(tank) OVER z AS actual_fuel_tank, CASE WHEN lead(row_idx) OVER z > row_idx THEN lead(run) OVER z - run END AS actual_dist_nm FROM w WINDOW z AS (PARTITION BY user_id ORDER BY k)),
g AS (SELECT *, CASE WHEN actual_time_s > 0 THEN actual_dist_nm / (actual_time_s / 3600) END AS actual_gs FROM l WHERE "to" IS NOT NULL)"""


def _whole(spark, sf_dir):
    """Plan, track and events of every user's log."""
    e, k = F.col("event_id"), F.col("k")
    track = _track(spark, sf_dir).withColumns({"wind_dir": (e % 360).cast("double"), "wind_speed": (e % 40).cast("double"), "trk": (e * 7 % 360).cast("double")})
    plan = _t(spark, sf_dir, "events").select("user_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    names = F.array(*map(F.lit, ("view", "click", "nowhere", "error", "purchase")))
    plan = plan.select(
        "user_id", k.alias("seq"), F.get(names, k).alias("name"), F.when(k != 2, 50 + k * 0.3).alias("lat"), (-1 + k * 0.1).alias("lon"), (k * 600.0).alias("eta_s"), (k * 2.0).alias("fuel_used"), (100.0 + k).alias("gs"),
        (k * 40.0).alias("wind_dir"), F.lit(10.0).alias("wind_speed"), (k * 30.0).alias("crs"), (k * 9.0).alias("dist_leg"), F.lit(600.0).alias("leg_time_s"),
    )
    events = phase.waypoint_events(track.drop("row_idx"), "event_type", KEY, ORDER).select("user_id", F.col("event_type").alias("name"), F.col("row_idx").cast("int").alias("row_idx"))
    waypoints = corridor.reconciled_waypoints(plan, track, events, KEY, ["row_idx"])
    return plan, track, events, waypoints


@query(f"""WITH {_WHOLE} SELECT user_id, name, row_idx, round(off, 4) AS lateral_offset_nm, overflown, round(elapsed - eta_s, 3) AS eta_delta_s, round(burn - fuel_used, 6) AS fuel_used_delta, round(ags - gs, 6) AS gs_delta, round(hp, 6) + 0.0 AS headwind_planned, round(ha, 6) + 0.0 AS headwind_actual, round(tank, 6) AS abeam_fuel, event_row FROM w""")
def reconciled_waypoints(spark, sf_dir):
    found = _whole(spark, sf_dir)[3]
    wind = [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("headwind_planned", "headwind_actual")]
    return found.select("user_id", "name", "row_idx", *_r("lateral_offset_nm"), "overflown", *_r("eta_delta_s", places=3), *_r("fuel_used_delta", "gs_delta", "abeam_fuel", places=6), *wind, "event_row")


@query(f"""WITH {_WHOLE} SELECT user_id, frm, "to", planned_dist_nm, planned_time_s, planned_gs, reliable, planned_fuel, round(actual_time_s, 3) AS actual_time_s, round(actual_fuel, 6) AS actual_fuel, round(actual_fuel_tank, 6) AS actual_fuel_tank, round(actual_dist_nm, 4) AS actual_dist_nm, round(actual_gs, 4) AS actual_gs FROM g""")
def reconciled_legs(spark, sf_dir):
    legs = corridor.reconciled_legs(_whole(spark, sf_dir)[3], KEY)
    return legs.select("user_id", "frm", "to", "planned_dist_nm", "planned_time_s", "planned_gs", "reliable", "planned_fuel", *_r("actual_time_s", places=3), *_r("actual_fuel", "actual_fuel_tank", places=6), *_r("actual_dist_nm", "actual_gs"))


@query(f"WITH {_WHOLE} SELECT user_id, name, row_idx::INT AS row_idx FROM v WHERE name NOT IN ('view', 'click', 'nowhere', 'error', 'purchase')")
def off_plan_events(spark, sf_dir):
    plan, _, events, _ = _whole(spark, sf_dir)
    return corridor.off_plan(events, plan, KEY).select("user_id", "name", "row_idx")


@query(f"""WITH {_WHOLE}, a AS (SELECT user_id, count(*) FILTER (reliable) AS n_reliable_legs, round(avg(CASE WHEN actual_time_s <> 0 THEN actual_time_s - planned_time_s END) FILTER (reliable)) AS mean_leg_time_err_s, round(coalesce(sum(planned_fuel) FILTER (reliable), 0), 1) AS reliable_fuel_plan_gal FROM g GROUP BY user_id),
o AS (SELECT user_id, round(avg(ha - hp) FILTER (overflown), 1) AS mean_headwind_err_kt, count(*) FILTER (overflown) AS n_overflown, count(*) FILTER (off IS NOT NULL AND NOT overflown) AS n_skipped FROM w GROUP BY user_id),
q AS (SELECT user_id, round(sum({_sql_distance("plat", "plon", "lat", "lon")}), 1) AS planned_route_gc_nm FROM (SELECT *, lag(lat) OVER z AS plat, lag(lon) OVER z AS plon FROM p WHERE lat IS NOT NULL WINDOW z AS (PARTITION BY user_id ORDER BY k)) GROUP BY user_id),
u AS (SELECT user_id, round(max(run), 1) AS flown_dist_nm FROM r GROUP BY user_id)
SELECT user_id, n_reliable_legs, mean_leg_time_err_s, reliable_fuel_plan_gal, mean_headwind_err_kt, n_overflown, n_skipped, planned_route_gc_nm, flown_dist_nm, round(planned_route_gc_nm - flown_dist_nm, 1) AS dist_saved_nm FROM a JOIN o USING (user_id) JOIN q USING (user_id) JOIN u USING (user_id)""")
def plan_totals(spark, sf_dir):
    plan, track, _, waypoints = _whole(spark, sf_dir)
    good = corridor.reconciled_accuracy(waypoints, corridor.reconciled_legs(waypoints, KEY), KEY)
    total = corridor.plan_totals(plan, track, waypoints, KEY, ORDER)
    return good.join(total, KEY).select("user_id", "n_reliable_legs", "mean_leg_time_err_s", "reliable_fuel_plan_gal", "mean_headwind_err_kt", "n_overflown", "n_skipped", "planned_route_gc_nm", "flown_dist_nm", "dist_saved_nm")
