"""Registered queries of the recorder, catalogue, plan and corridor operators, each with the SQL that gives the same rows.

Events stand for recorder rows (``_TRACK``) and orders for flights (``catalogue._FLIGHTS``).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom import fields
from skyloom.functions import fuel, geo, text
from skyloom.operators import catalog, corridor, flights, joins, phase, series, stats
from skyloom.plans.catalogue import _FLIGHTS, KEY, ORDER, W, _flights, _sql_distance, _t, query
from skyloom.sources import logs, plans, store

_TRACK = f"""n AS (SELECT *, row_number() {W} - 1 AS i FROM events),
t AS (SELECT user_id, event_id, ts, event_type, i::INT AS row_idx, epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id)) AS elapsed, 50 + user_id % 3 * 0.1::DOUBLE + i % 200 * 0.01::DOUBLE AS lat, -1 + i % 300 * 0.005::DOUBLE AS lon,
 value AS gs, value + event_id % 20 AS tas, value * 0.9 AS ias, (i * 37 % 9000)::DOUBLE AS alt, i * 0.01::DOUBLE AS fuel_burn, 50 - i * 0.01::DOUBLE AS fuel FROM n)"""


def _track(spark, sf_dir):
    rows = series.numbered(_t(spark, sf_dir, "events"), KEY, ORDER, "i")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    i, v = F.col("i"), F.col("value")
    return rows.select(
        "user_id", "event_id", "ts", "event_type", i.cast("int").alias("row_idx"), (seconds(F.col("ts")) - seconds(F.min("ts").over(Window.partitionBy(*KEY)))).alias("elapsed"),
        (50 + F.col("user_id") % 3 * 0.1 + i % 200 * 0.01).alias("lat"), (-1 + i % 300 * 0.005).alias("lon"), v.alias("gs"), (v + F.col("event_id") % 20).alias("tas"), (v * 0.9).alias("ias"),
        (i * 37 % 9000).cast("double").alias("alt"), (i * 0.01).alias("fuel_burn"), (50 - i * 0.01).alias("fuel"),
    )


def _r(*columns, places=4):
    return [F.round(c, places).alias(c) for c in columns]


@query("""SELECT user_id, arg_min(value, (ts, event_id)) FILTER (ok) AS "start", arg_max(value, (ts, event_id)) FILTER (ok) AS "end", min(value) FILTER (ok) AS "min", max(value) FILTER (ok) AS "max",
 round(sum(value) FILTER (ok), 4) AS "sum", count(*) FILTER (ok) AS "count", round(avg(value) FILTER (ok), 6) AS average FROM (SELECT *, event_id % 7 > 1 AS ok FROM events) GROUP BY user_id""")
def finite_statistics(spark, sf_dir):
    k = F.col("event_id") % 7
    rows = _t(spark, sf_dir, "events").withColumn("value", F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("-inf"))).otherwise(F.col("value")))
    s = stats.value_stats("value", F.struct(*ORDER))
    return rows.groupBy("user_id").agg(*[s[m].alias(m) for m in ("start", "end", "min", "max", "count")], F.round(s["sum"], 4).alias("sum"), F.round(s["average"], 6).alias("average"))


@query("""SELECT user_id, count(value) AS n, min(value) AS low, max(value) AS high, round(arg_max(value, ts) - arg_min(value, ts), 6) AS total
FROM (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL) WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY user_id""")
def range_statistics(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    cut = lambda s: F.lit(s).cast("timestamp_ntz")
    found = stats.range_stats(rows, "value", KEY, "ts", cut("2024-01-05"), cut("2024-01-20"))
    return found.select("user_id", F.col("count").alias("n"), F.col("min").alias("low"), F.col("max").alias("high"), F.round("total", 6).alias("total"))


@query(f"SELECT event_id, i::INT AS i FROM (SELECT *, row_number() {W} - 1 AS i FROM events) WHERE i >= 40")
def without_first_rows(spark, sf_dir):
    rows = series.numbered(_t(spark, sf_dir, "events"), KEY, ORDER, "i")
    return series.without_first(rows, 40, KEY, ORDER).select("event_id", F.col("i").cast("int").alias("i"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00'")
def head_from(spark, sf_dir):
    return series.head_from(_t(spark, sf_dir, "events"), "ts", F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")).select("event_id")


@query(f"SELECT user_id, event_id, value FROM (SELECT *, row_number() {W} - 1 AS i FROM events) WHERE i = 7")
def row_at(spark, sf_dir):
    return series.at_row(_t(spark, sf_dir, "events"), 7, KEY, ORDER).select("user_id", "event_id", "value")


@query(f"WITH {_TRACK} SELECT user_id, arg_min(event_id, (abs(elapsed - 86400), ts, event_id)) AS event_id FROM t GROUP BY user_id")
def nearest_sample(spark, sf_dir):
    return series.nearest_to(_track(spark, sf_dir), F.lit(86400.0), "elapsed", KEY, ORDER).select("user_id", "event_id")


@query("""SELECT user_id, ts, round(epoch(ts) - epoch(TIMESTAMP '2024-01-05'), 3) AS elapsed, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND event_id % 5 > 0""")
def field_series(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 5 > 0, F.col("value")).otherwise(F.lit(float("nan"))))
    cut = lambda s: F.lit(s).cast("timestamp_ntz")
    return series.series_of(rows, "value", "ts", cut("2024-01-05"), cut("2024-01-20"), KEY).withColumn("elapsed", F.round("elapsed", 3))


@query("""WITH s AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS ts, event_type, max(value) AS value FROM events GROUP BY ALL)
SELECT a.user_id, a.ts, a.value AS x, b.value AS y FROM s a JOIN s b USING (user_id, ts) WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def paired_series(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_type").agg(F.max("value").alias("value"))
    return series.paired(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), KEY, "ts")


@query("SELECT event_id, value AS power FROM events")
def column_choice(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    return rows.select("event_id", series.first_present(rows, ["absent", "value", "user_id"]).alias("power"))


_PLACES = "a AS (SELECT s_suppkey, (s_suppkey * 7 % 120 - 60)::DOUBLE AS lat, (s_suppkey * 11 % 360 - 180)::DOUBLE + 0.02 AS lon FROM supplier)"


def _places(spark, sf_dir):
    k = F.col("s_suppkey")
    return _t(spark, sf_dir, "supplier").select(k, (k * 7 % 120 - 60).cast("double").alias("lat"), ((k * 11 % 360 - 180).cast("double") + 0.02).alias("lon"))


@query(f"""WITH {_PLACES}, p AS (SELECT event_id, (event_id * 37 % 120 - 60)::DOUBLE + event_id % 3 * 0.04 AS plat, (event_id * 53 % 360 - 180)::DOUBLE AS plon FROM events),
d AS (SELECT p.event_id, s_suppkey, {_sql_distance("plat", "plon", "lat", "lon")} AS nm FROM p JOIN a ON abs(plat - lat) < 0.2)
SELECT p.event_id, s_suppkey FROM p LEFT JOIN (SELECT event_id, arg_min(s_suppkey, (nm, s_suppkey)) AS s_suppkey FROM d WHERE nm <= 6 GROUP BY event_id) USING (event_id)""")
def nearest_within(spark, sf_dir):
    k = F.col("event_id")
    points = _t(spark, sf_dir, "events").select(k, ((k * 37 % 120 - 60).cast("double") + k % 3 * 0.04).alias("lat"), (k * 53 % 360 - 180).cast("double").alias("lon"))
    return joins.nearest_within(points, _places(spark, sf_dir), "lat", "lon", ["event_id"], "s_suppkey").select("event_id", "s_suppkey")


@query(f"""WITH {_PLACES}, f AS (SELECT 'N' || s_suppkey % 5 AS name, lat, lon, s_suppkey % 2 AS kind FROM a), c AS (SELECT c_custkey, 'N' || c_custkey % 7 AS ident, (c_custkey % 50)::DOUBLE AS rlat, (c_custkey % 80)::DOUBLE AS rlon FROM customer),
ap AS (SELECT name, min(lat) AS lat, arg_min(lon, (lat, lon)) AS lon FROM f WHERE kind = 0 AND name = 'N0' GROUP BY name),
fx AS (SELECT * FROM f WHERE kind = 1),
n AS (SELECT c_custkey, arg_min({{'lat': fx.lat, 'lon': fx.lon}}, ({_sql_distance("rlat", "rlon", "fx.lat", "fx.lon")}, fx.lat, fx.lon)) AS b FROM c JOIN fx ON c.ident = fx.name GROUP BY c_custkey)
SELECT c.c_custkey, coalesce(ap.lat, n.b.lat) AS lat, round(coalesce(ap.lon, n.b.lon), 6) AS lon FROM c LEFT JOIN ap ON ap.name = c.ident LEFT JOIN n USING (c_custkey)""")
def resolved_idents(spark, sf_dir):
    k, name = F.col("c_custkey"), lambda c, m: F.concat(F.lit("N"), (c % m).cast("string"))
    idents = _t(spark, sf_dir, "customer").select(k, name(k, 7).alias("ident"), (k % 50).cast("double").alias("ref_lat"), (k % 80).cast("double").alias("ref_lon"))
    own = _places(spark, sf_dir).withColumn("name", name(F.col("s_suppkey"), 5))
    airports = own.where("s_suppkey % 2 = 0 AND name = 'N0'").select(F.col("name").alias("ident"), "lat", "lon")
    return joins.resolved(idents, airports, own.where("s_suppkey % 2 = 1")).select("c_custkey", "lat", F.round("lon", 6).alias("lon"))


@query("""SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON lower(n_name) = lower('nation_' || (r_regionkey * 3)) OR lower(n_name) = lower(r_name)""")
def matched_names(spark, sf_dir):
    other = _t(spark, sf_dir, "region").select(F.upper("r_name").alias("own"), "r_regionkey").unionByName(_t(spark, sf_dir, "region").select(F.concat(F.lit("NATION_"), (F.col("r_regionkey") * 3).cast("string")).alias("own"), "r_regionkey"))
    return joins.matched_names(_t(spark, sf_dir, "nation"), other, "n_name", "own", "r_regionkey").select("n_nationkey", "r_regionkey")


@query("""WITH s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT event_id, coalesce(ts BETWEEN a AND b, false) AS "within" FROM events LEFT JOIN s USING (user_id)""")
def highlighted(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    own = rows.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return joins.within(rows, own, KEY, "ts", "a", "b").select("event_id", "within")


@query(f"""WITH {_TRACK} SELECT user_id, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon,
 round(max(lat) FILTER (gs > 20), 6) AS fast_max_lat, round((min(lat) + max(lat)) / 2, 6) AS mid, round(min(lat) - 0.1 * (max(lat) - min(lat)), 6) AS low FROM t WHERE event_id % 9 > 0 GROUP BY user_id""")
def bounding_boxes(spark, sf_dir):
    rows = _track(spark, sf_dir).withColumn("lon", F.when(F.col("event_id") % 9 > 0, F.col("lon")).otherwise(-180.0))
    fast = stats.bounds("lat", "lon", F.col("gs") > 20)[1]
    box = rows.groupBy("user_id").agg(*stats.bounds("lat", "lon"), fast.alias("fast_max_lat"))
    m = geo.midpoint(F.col("min_lat"), F.col("max_lat"), 0.1)
    return box.select("user_id", *_r("min_lat", "max_lat", "min_lon", "max_lon", "fast_max_lat", places=6), F.round(m["mid"], 6).alias("mid"), F.round(m["low"], 6).alias("low"))


@query("""WITH b AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS "Date" FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, "Date", event_type ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id, "Date" ORDER BY ts, event_id) AS i FROM b)
SELECT user_id AS "LogFileName", "Date", round(arg_max(value, i) - arg_min(value, i), 6) AS total, round(avg(value), 6) AS average, max(value) AS high, min(value) AS low, arg_max(event_type, (n, -i)) AS mode, NULL::DOUBLE AS absent FROM n GROUP BY ALL""")
def stored_intervals(spark, sf_dir):
    v = F.col("value")
    # Microseconds part rows of one second, so that the order is total.
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("LogFileName"), (F.col("ts").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, event_id / 1e6)")).alias("at"), "ts", v.alias("Distance"), v.alias("IAS"), v.alias("amp1"), F.col("event_type").alias("AfcsOn"))
    found = stats.wide(series.intervals(rows, "ts", 3600, "Date"), fields.STORED_VALUES, fields.STORED_NAMES, ["LogFileName", "Date"], ["ts", "at"])
    return found.select("LogFileName", "Date", F.round("`Distance.total`", 6).alias("total"), F.round("`IAS.average`", 6).alias("average"), F.col("`amp1.max`").alias("high"), F.col("`amp1.min`").alias("low"), F.col("`AfcsOn.mostFrequent`").alias("mode"), F.col("`OAT.average`").alias("absent"))


@query("""SELECT list_sort(list_distinct(list(event_type))) AS "values", NULL::VARCHAR AS single FROM events UNION ALL SELECT ['error'], 'error'""")
def distinct_values(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    return stats.distinct_or_scalar(rows, "event_type").unionByName(stats.distinct_or_scalar(rows.where("event_type = 'error'"), "event_type"))


@query("""WITH l AS (SELECT l_suppkey, l_linenumber, max(l_quantity) AS q, max(l_tax) AS x FROM lineitem GROUP BY ALL)
SELECT l_suppkey, 'q' AS field, string_agg(l_linenumber::VARCHAR || ':' || q::INT::VARCHAR, ',' ORDER BY l_linenumber) AS series FROM l GROUP BY l_suppkey
UNION ALL SELECT l_suppkey, 'x', string_agg(l_linenumber::VARCHAR || ':' || round(x * 100)::INT::VARCHAR, ',' ORDER BY l_linenumber) FROM l GROUP BY l_suppkey""")
def values_by_field(spark, sf_dir):
    legs = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("x"))
    found = stats.by_field(legs, ["l_suppkey"], "l_linenumber", ["q", "x"])
    told = F.transform("series", lambda s: F.concat_ws(":", s["leg"].cast("string"), F.round(F.when(F.col("field") == "q", s["value"]).otherwise(s["value"] * 100)).cast("int").cast("string")))
    return found.select("l_suppkey", "field", F.array_join(told, ",").alias("series"))


@query(f"""WITH {_FLIGHTS} SELECT system_id, date_trunc('month', start_time)::TIMESTAMP AS month, count(*) AS n_flights, arg_min(fuel_from, (start_time, log_id)) AS fuel_start, round(arg_max(fuel_to, (start_time, log_id)), 8) AS fuel_end,
 round(sum(distance), 6) AS distance, max(altitude) AS altitude, round(sum(distance) / sum(hours), 4) AS ground_speed, round(sum(fuel_used) / sum(hours), 4) AS gph, round(sum(distance) / sum(fuel_used), 4) AS nm_per_gallon FROM f GROUP BY ALL""")
def trip_totals(spark, sf_dir):
    rows = _flights(spark, sf_dir).withColumn("month", F.date_trunc("month", "start_time").cast("timestamp_ntz")).withColumn("at", F.struct("start_time", "log_id"))
    found = flights.trip_totals(rows, ["system_id", "month"], "at")
    return found.select("system_id", "month", "n_flights", "fuel_start", F.round("fuel_end", 8).alias("fuel_end"), "altitude", F.round("distance", 6).alias("distance"), *_r("ground_speed", "gph", "nm_per_gallon"))


@query(f"""WITH {_FLIGHTS} SELECT system_id, coalesce(min(c_name), min(system_id)::VARCHAR) AS identifier, count(*) AS n_flights, round(sum(distance), 6) AS distance, min(start_time) AS first_time, max(start_time) AS latest_time,
 arg_max(log_file_name, (start_time, log_file_name)) AS latest_flight FROM f LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = system_id GROUP BY system_id""")
def aircraft_lists(spark, sf_dir):
    aircraft = _t(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("system_id"), F.col("c_name").alias("identifier"))
    found = catalog.newest(catalog.aircraft_list(_flights(spark, sf_dir), aircraft))
    return found.select("system_id", "identifier", "n_flights", F.round("distance", 6).alias("distance"), "first_time", "latest_time", "latest_flight")


@query("""SELECT coalesce((CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END)::VARCHAR, 'Null') AS system_id, count(*) AS n FROM orders GROUP BY ALL""")
def aircraft_counts(spark, sf_dir):
    return catalog.counts(_t(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("system_id")))


@query(f"WITH {_FLIGHTS} SELECT count(*) AS n_flights, count(DISTINCT (system_id, start_icao)) AS n_trips FROM f WHERE start_icao IS NOT NULL")
def trip_counts(spark, sf_dir):
    return catalog.trip_counts(_flights(spark, sf_dir), ["system_id", "start_icao"])


_NIGHTS = "l AS (SELECT *, lag(start_time) OVER w AS p, lag(end_icao) OVER w AS q FROM f WHERE start_icao <> end_icao WINDOW w AS (PARTITION BY system_id ORDER BY start_time, log_id))"


@query(f"""WITH {_FLIGHTS}, {_NIGHTS}, n AS (SELECT start_icao AS airport, system_id, sum(start_time::DATE - p::DATE)::BIGINT AS nights FROM l WHERE p IS NOT NULL GROUP BY ALL)
SELECT system_id, arg_min(airport, (-nights, airport)) AS base FROM n WHERE nights > 0 GROUP BY system_id""")
def home_bases(spark, sf_dir):
    return flights.home_base(flights.nights(_flights(spark, sf_dir), ["system_id"], order=["log_id"]), ["system_id"])


@query(f"WITH {_FLIGHTS}, {_NIGHTS} SELECT start_icao AS airport, system_id, sum(start_time::DATE - p::DATE)::BIGINT AS nights, count(*) AS visits FROM l WHERE q = start_icao GROUP BY ALL")
def nights_where_connected(spark, sf_dir):
    return flights.nights(_flights(spark, sf_dir), ["system_id"], order=["log_id"], connected=True)


_SEG = f"""{_TRACK}, c AS (SELECT *, (row_idx // 25)::INT AS seg FROM t), d AS (SELECT *, {_sql_distance("lag(lat) OVER s", "lag(lon) OVER s", "lat", "lon")} AS d FROM c WINDOW s AS (PARTITION BY user_id, seg ORDER BY ts, event_id))"""


@query(f"""WITH {_SEG} SELECT user_id, seg, count(*) AS n_rows, round(max(elapsed) - min(elapsed), 3) AS duration_s, round(arg_max(fuel_burn, row_idx) - arg_min(fuel_burn, row_idx), 6) AS fuel_gal, round(coalesce(sum(d), 0), 4) AS dist_nm,
 arg_min(alt, row_idx) AS alt_start, arg_max(alt, row_idx) AS alt_end, round(CASE WHEN max(elapsed) > min(elapsed) THEN (arg_max(alt, row_idx) - arg_min(alt, row_idx)) / ((max(elapsed) - min(elapsed)) / 60) END, 6) AS rate_fpm, round(avg(tas), 6) AS avg_tas
FROM d GROUP BY ALL HAVING count(*) >= 2""")
def segment_metrics(spark, sf_dir):
    rows = _track(spark, sf_dir).withColumn("seg", F.floor(F.col("row_idx") / 25).cast("int"))
    found = phase.segment_metrics(rows, ["user_id", "seg"], ORDER).where("n_rows >= 2")
    return found.select("user_id", "seg", "n_rows", F.round("duration_s", 3).alias("duration_s"), "alt_start", "alt_end", F.round("dist_nm", 4).alias("dist_nm"), *_r("fuel_gal", "rate_fpm", "avg_tas", places=6))


@query("""WITH s AS (SELECT l_suppkey, l_returnflag AS label, l_orderkey * 10 + l_linenumber AS k, l_quantity AS dur, CASE WHEN l_linenumber > 1 THEN l_tax END AS g, l_extendedprice AS a, l_extendedprice + l_discount AS b FROM lineitem)
SELECT l_suppkey, sum(dur) AS duration_s, round(coalesce(sum(g), 0), 6) AS fuel_gal, arg_min(a, k) AS alt_start, round(arg_max(b, k), 6) AS alt_end, round(sum(b - a) / (sum(dur) / 60), 6) AS rate_fpm,
 round(sum(g * dur) / sum(CASE WHEN g IS NOT NULL THEN dur END), 6) AS avg_tas FROM s WHERE label = 'R' GROUP BY l_suppkey""")
def active_segments(spark, sf_dir):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    g = F.when(F.col("l_linenumber") > 1, F.col("l_tax"))
    rows = _t(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_returnflag").alias("label"), k.alias("k"), F.col("l_quantity").alias("duration_s"), g.alias("fuel_gal"), g.alias("dist_nm"), F.col("l_extendedprice").alias("alt_start"),
        (F.col("l_extendedprice") + F.col("l_discount")).alias("alt_end"), g.alias("avg_ias"), g.alias("avg_tas"), g.alias("avg_gs"),
    )
    found = phase.active_only(rows, "R", ["l_suppkey"], "k")
    return found.select("l_suppkey", "duration_s", "alt_start", *_r("fuel_gal", "alt_end", "rate_fpm", "avg_tas", places=6))


_ISLANDS = """x AS (SELECT *, CASE WHEN row_idx = 0 OR event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY row_idx) THEN 1 ELSE 0 END AS new FROM t),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY row_idx) AS g FROM x)"""


@query(f"""WITH {_TRACK}, {_ISLANDS}, z AS (SELECT user_id, g, min(event_type) AS event_type, max(row_idx) AS row_idx, min(gs) AS closest FROM y WHERE event_type <> 'view' GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY row_idx)::INT AS event, event_type, row_idx, closest FROM z""")
def waypoint_events(spark, sf_dir):
    rows = _track(spark, sf_dir).withColumn("event_type", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(""))
    return phase.waypoint_events(rows.drop("row_idx"), "event_type", KEY, ORDER, "gs")


@query(f"""WITH {_TRACK}, s AS (SELECT *, avg(gs * 10) OVER (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS sm FROM t),
r AS (SELECT *, (sm - lag(sm) OVER (PARTITION BY user_id ORDER BY row_idx)) * 60 AS rate FROM s), l AS (SELECT *, CASE WHEN rate > 200 THEN 'climb' WHEN rate < -200 THEN 'descent' ELSE 'level' END AS label FROM r),
x AS (SELECT *, CASE WHEN row_idx = 0 OR label <> lag(label) OVER (PARTITION BY user_id ORDER BY row_idx) THEN 1 ELSE 0 END AS new FROM l), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY row_idx) - 1 AS g FROM x),
i AS (SELECT user_id, g, min(label) AS label, min(row_idx) AS a, max(row_idx) AS b, count(*) AS n FROM y GROUP BY ALL), k AS (SELECT *, sum(CASE WHEN g = 0 OR n >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY g) AS h FROM i),
f AS (SELECT *, first_value(label) OVER (PARTITION BY user_id, h ORDER BY g) AS own FROM k), d AS (SELECT *, CASE WHEN g = 0 OR own <> lag(own) OVER (PARTITION BY user_id ORDER BY g) THEN 1 ELSE 0 END AS new FROM f),
u AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY g) - 1 AS run FROM d)
SELECT user_id, run::BIGINT AS run, min(own) AS label, min(a)::INT AS "first", max(b)::INT AS "last", sum(n)::BIGINT AS n FROM u GROUP BY user_id, run""")
def vertical_segments(spark, sf_dir):
    rows = _track(spark, sf_dir).withColumn("height", F.col("gs") * 10)
    return phase.vertical_segments(rows, "height", KEY, ORDER, least=3).withColumn("run", F.col("run").cast("long"))


@query(f"""WITH {_TRACK}, c AS (SELECT user_id, quantile_cont(alt, 0.95) AS cruise FROM t WHERE gs > 40 GROUP BY user_id)
SELECT user_id, round(cruise, 6) AS cruise, min(row_idx) FILTER (alt >= cruise - 500) AS toc, max(row_idx) FILTER (alt >= cruise - 1500) AS tod FROM t JOIN c USING (user_id) WHERE gs > 40 GROUP BY ALL""")
def climb_and_descent_ends(spark, sf_dir):
    # Row numbers are those of the whole log, as the operator numbers the rows it is given.
    found = phase.top_of_climb_and_descent(_track(spark, sf_dir).drop("row_idx"), "alt", "gs", KEY, ORDER)
    return found.withColumn("cruise", F.round("cruise", 6))


_LINE = _sql_distance("50.0", "-1.0", "lat", "lon")


@query(f"""WITH {_TRACK}, p AS (SELECT user_id, (k * 10)::INT AS seq, 50 + k * 0.3 AS lat, -1 + k * 0.1 AS lon FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(5)) AS k)),
d AS (SELECT p.user_id, seq, row_idx, {_sql_distance("p.lat", "p.lon", "t.lat", "t.lon")} AS nm FROM p JOIN t USING (user_id))
SELECT user_id, seq, arg_min(row_idx, (nm, row_idx)) AS row_idx, round(min(nm), 4) AS offset_nm FROM d GROUP BY ALL""")
def abeam_points(spark, sf_dir):
    return joins.abeam(_plan(spark, sf_dir), _track(spark, sf_dir), KEY).withColumn("offset_nm", F.round("offset_nm", 4))


def _plan(spark, sf_dir):
    k = F.explode(F.sequence(F.lit(0), F.lit(4)))
    at = _t(spark, sf_dir, "events").select("user_id").distinct().withColumn("k", k)
    return at.select("user_id", (F.col("k") * 10).alias("seq"), F.concat(F.lit("W"), F.col("k").cast("string")).alias("name"), (50 + F.col("k") * 0.3).alias("lat"), (-1 + F.col("k") * 0.1).alias("lon"), (F.col("k") * 2.0).alias("fuel"), (F.col("k") * 600.0).alias("elapsed"))


@query(f"""WITH {_TRACK}, p AS (SELECT user_id, k, 'W' || k AS name, 50 + k * 0.3 AS lat, -1 + k * 0.1 AS lon, k * 2.0::DOUBLE AS fuel, k * 600.0::DOUBLE AS elapsed FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(5)) AS k)),
d AS (SELECT p.user_id, k, row_idx, {_sql_distance("p.lat", "p.lon", "t.lat", "t.lon")} AS nm FROM p JOIN t USING (user_id)), b AS (SELECT user_id, k, arg_min(row_idx, (nm, row_idx)) AS row_idx FROM d GROUP BY ALL),
s AS (SELECT *, coalesce({_sql_distance(f"lag(lat) {W}", f"lag(lon) {W}", "lat", "lon")}, 0) AS step FROM t), r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY row_idx) AS run FROM s),
o AS (SELECT p.*, b.row_idx, r.fuel AS ff, r.elapsed AS fe, r.run FROM p JOIN b USING (user_id, k) JOIN r ON r.user_id = p.user_id AND r.row_idx = b.row_idx)
SELECT user_id, name, row_idx, round(ff - fuel, 6) AS fuel_delta, round(fe - elapsed, 3) AS elapsed_delta, round({_sql_distance("lat", "lon", "lead(lat) OVER v", "lead(lon) OVER v")}, 4) AS leg_planned_nm,
 round(CASE WHEN lead(row_idx) OVER v > row_idx THEN lead(run) OVER v - run END, 4) AS leg_flown_nm, round(ff - lead(ff) OVER v, 6) AS leg_fuel FROM o WINDOW v AS (PARTITION BY user_id ORDER BY k)""")
def reconciled(spark, sf_dir):
    found = corridor.reconcile(_plan(spark, sf_dir), _track(spark, sf_dir), KEY)
    return found.select("user_id", "name", "row_idx", F.round("elapsed_delta", 3).alias("elapsed_delta"), *_r("leg_planned_nm", "leg_flown_nm"), *_r("fuel_delta", "leg_fuel", places=6))


@query(f"""WITH {_TRACK}, s AS (SELECT *, coalesce({_sql_distance(f"lag(lat) {W}", f"lag(lon) {W}", "lat", "lon")}, 0) AS step FROM t), r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY row_idx) AS run FROM s),
m AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS whole FROM r), k AS (SELECT unnest(range(1, 10)) AS k), a AS (SELECT user_id, k, arg_min({{'lat': lat, 'lon': lon}}, row_idx) AS p FROM m, k WHERE run >= whole * k / 10 GROUP BY ALL),
q AS (SELECT user_id, k, p.lat AS lat, p.lon AS lon FROM a),
o AS (SELECT user_id, k, {geo.RADIUS_NM!r} * asin(sin({_LINE} / {geo.RADIUS_NM!r}) * sin(atan2(sin(radians(lon + 1)) * cos(radians(lat)), cos(radians(50)) * sin(radians(lat)) - sin(radians(50)) * cos(radians(lat)) * cos(radians(lon + 1)))
 - atan2(sin(radians(1.5)) * cos(radians(52)), cos(radians(50)) * sin(radians(52)) - sin(radians(50)) * cos(radians(52)) * cos(radians(1.5))))) AS off FROM q)
SELECT user_id, k::INT AS k, round(off, 3) + 0.0 AS off FROM o""")
def offset_profiles(spark, sf_dir):
    found = corridor.offset_profile(_track(spark, sf_dir), (50.0, -1.0), (52.0, 0.5), KEY, ORDER)
    return found.select("user_id", F.posexplode("offsets").alias("p", "off")).select("user_id", (F.col("p") + 1).alias("k"), (F.round("off", 3) + F.lit(0.0)).alias("off"))


_VIA = "(51.0, 0.2)"
_CUT = f"""{_TRACK}, v AS (SELECT *, {_sql_distance("lat", "lon", "50.05", "-1.0")} AS a, {_sql_distance("lat", "lon", "51.0", "-0.5")} AS v FROM t),
k AS (SELECT user_id, arg_min(a, row_idx) AS sa, arg_max(a, row_idx) AS ea, min(v) AS near, arg_min(row_idx, (v, row_idx)) AS cut, count(*) AS n FROM v GROUP BY user_id),
w AS (SELECT *, CASE WHEN sa <= ea THEN 'out' ELSE 'in' END AS direction FROM k WHERE least(sa, ea) <= 8 AND near <= 14 AND n >= 30),
g AS (SELECT v.*, direction, near, CASE WHEN direction = 'out' THEN row_idx ELSE -row_idx END AS o FROM v JOIN w USING (user_id) WHERE (direction = 'out' AND row_idx <= cut) OR (direction = 'in' AND row_idx >= cut)),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) - 1 AS step, count(*) OVER (PARTITION BY user_id) AS len FROM g)"""


@query(f"""WITH {_CUT}, e AS (SELECT *, {_sql_distance("lag(lat) OVER z", "lag(lon) OVER z", "lat", "lon")} AS d FROM h WHERE len >= 10 WINDOW z AS (PARTITION BY user_id ORDER BY step))
SELECT user_id, direction, round(near, 4) AS near_via_nm, round(sum(d), 4) AS track_nm, round(sum(CASE WHEN tas > 40 THEN d / tas END) * 3600, 3) AS still_air_s, round(abs(arg_max(elapsed, step) - arg_min(elapsed, step)), 3) AS time_s,
 round(avg(tas) FILTER (tas > 40), 6) AS avg_tas, max(alt) AS max_alt, round(abs(arg_max(fuel_burn, step) - arg_min(fuel_burn, step)), 6) AS fuel_gal FROM e GROUP BY ALL""")
def corridor_scan(spark, sf_dir):
    own = corridor.corridor_segments(_track(spark, sf_dir), (50.05, -1.0), (51.0, -0.5), "user_id", "row_idx")
    found = corridor.segment_figures(own, ["user_id", "direction", "near_via_nm"])
    return found.select("user_id", "direction", "max_alt", *_r("near_via_nm", "track_nm"), *_r("still_air_s", "time_s", places=3), *_r("avg_tas", "fuel_gal", places=6))


@query(f"""WITH {_TRACK}, v AS (SELECT *, {_sql_distance("lat", "lon", "51.0", "-0.5")} AS d, CASE WHEN user_id % 2 = 0 THEN 'out' ELSE 'in' END AS direction FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY row_idx) AS before FROM t) WHERE before IS NULL OR event_type <> before), k AS (SELECT user_id, arg_min(row_idx, (d, row_idx)) AS cut_row FROM v GROUP BY user_id)
SELECT user_id, string_agg(event_type, ' ' ORDER BY row_idx) AS fixes FROM v JOIN k USING (user_id) WHERE (direction = 'out' AND row_idx <= cut_row) OR (direction = 'in' AND row_idx >= cut_row) GROUP BY user_id""")
def fix_sequences(spark, sf_dir):
    rows = series.value_changes(_track(spark, sf_dir), ["event_type"], KEY, ["row_idx"])
    ways = rows.select("user_id").distinct().withColumn("direction", F.when(F.col("user_id") % 2 == 0, "out").otherwise("in"))
    return corridor.fix_sequences(rows, (51.0, -0.5), ways, "user_id", "row_idx", "event_type").select("user_id", F.array_join("fixes", " ").alias("fixes"))


@query(f"WITH {_TRACK} SELECT event_id FROM t WHERE lat BETWEEN 50.5 - 5 / 60.0 AND 51 + 5 / 60.0 AND lon BETWEEN -0.8 - 5 / 60.0 / cos(radians(50.75)) AND -0.2 + 5 / 60.0 / cos(radians(50.75))")
def inside_box(spark, sf_dir):
    return corridor.inside(_track(spark, sf_dir), (50.5, -0.8, 51.0, -0.2), 5.0).select("event_id")


_LEGS = """e AS (SELECT l_suppkey, l_returnflag = 'A' AS reliable, l_linestatus = 'O' AS overflown, l_quantity AS ags, l_quantity - 3 AS pgs, l_quantity * 60 AS ats, l_quantity * 59 AS pts, l_tax * 100 AS af, CASE WHEN l_linenumber > 1 THEN l_discount * 100 END AS pf,
 l_tax * 90 AS aft, l_tax * 10 AS ha, l_discount * 10 AS hp FROM lineitem)"""


@query(f"""WITH {_LEGS} SELECT l_suppkey, count(*) FILTER (reliable) AS n_reliable_legs, round(avg(CASE WHEN ags <> 0 AND pgs <> 0 THEN ags - pgs END) FILTER (reliable), 1) AS mean_gs_err_kt,
 round(avg(af - pf) FILTER (reliable), 2) AS mean_leg_fuel_err_gal, round(coalesce(sum(pf) FILTER (reliable), 0), 1) AS reliable_fuel_plan_gal, round(coalesce(sum(af) FILTER (reliable), 0), 1) AS reliable_fuel_totaliser_gal,
 round(avg(CASE WHEN ats <> 0 AND pts <> 0 THEN ats - pts END) FILTER (reliable)) AS mean_leg_time_err_s, round(avg(ha - hp) FILTER (overflown), 1) AS mean_headwind_err_kt, round(coalesce(sum(aft) FILTER (reliable), 0), 1) AS reliable_fuel_tank_gal FROM e GROUP BY l_suppkey""")
def plan_accuracy(spark, sf_dir):
    q, x, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    legs = _t(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_returnflag") == "A").alias("reliable"), (F.col("l_linestatus") == "O").alias("overflown"), q.alias("actual_gs"), (q - 3).alias("planned_gs"), (q * 60).alias("actual_time_s"), (q * 59).alias("planned_time_s"),
        (x * 100).alias("actual_fuel"), F.when(F.col("l_linenumber") > 1, d * 100).alias("planned_fuel"), (x * 90).alias("actual_fuel_tank"), (x * 10).alias("headwind_actual"), (d * 10).alias("headwind_planned"),
    )
    return corridor.accuracy(legs, ["l_suppkey"])


@query(f"""WITH {_TRACK}, s AS (SELECT *, coalesce({_sql_distance(f"lag(lat) {W}", f"lag(lon) {W}", "lat", "lon")}, 0) AS d FROM t)
SELECT user_id, round(sum(d), 1) AS flown_dist_nm, round(max(elapsed) FILTER (gs > 40) - min(elapsed) FILTER (gs > 40)) AS airborne_s, round(arg_max(fuel_burn, row_idx), 1) AS burned_gal, round(arg_min(fuel, row_idx) FILTER (fuel > 1), 6) AS fuel_start_gal,
 round(arg_max(fuel, row_idx) FILTER (fuel > 1), 6) AS fuel_end_gal, round(arg_min(fuel, row_idx) FILTER (fuel > 1) - arg_max(fuel, row_idx) FILTER (fuel > 1), 1) AS burned_tank_gal, round(arg_min(fuel, row_idx) FILTER (fuel > 1) - round(arg_max(fuel_burn, row_idx), 1), 1) AS remaining_gal FROM s GROUP BY user_id""")
def flown_totals(spark, sf_dir):
    found = corridor.flown_totals(_track(spark, sf_dir), KEY, ORDER)
    return found.select("user_id", "flown_dist_nm", "airborne_s", "burned_gal", *_r("fuel_start_gal", "fuel_end_gal", places=6), "burned_tank_gal", "remaining_gal")


_PLANNED = """p AS (SELECT l_orderkey AS plan_id, l_linenumber AS seq, CASE l_linenumber WHEN 2 THEN '-TOC-' WHEN 3 THEN '-TOD-' ELSE 'W' || l_linenumber END AS name, l_linenumber * 600.0::DOUBLE AS eta, l_linenumber * 2.5::DOUBLE AS used, l_quantity AS leg, l_quantity * 2 AS rem, l_linenumber * 1000.0::DOUBLE AS alt, l_quantity AS tas FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL))"""


@query(f"""WITH {_PLANNED}, k AS (SELECT plan_id, max(eta) FILTER (name = '-TOD-') AS d FROM p GROUP BY plan_id)
SELECT plan_id, max(eta) FILTER (name = '-TOC-') AS climb_s, max(used) FILTER (name = '-TOC-') - arg_min(used, seq) AS climb_gal, max(leg) FILTER (name = '-TOC-') AS climb_nm, arg_max(eta, seq) - max(d) AS descent_s, max(rem) FILTER (name = '-TOD-') AS descent_nm,
 round(avg(tas) FILTER (eta >= d), 6) AS descent_tas FROM p JOIN k USING (plan_id) GROUP BY plan_id""")
def planned_climb_descent(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    name = F.when(n == 2, "-TOC-").when(n == 3, "-TOD-").otherwise(F.concat(F.lit("W"), n.cast("string")))
    # The greatest of a line's quantities, by the sort that the plans need too: a table of all lines would be held by hashing.
    best = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("l_quantity"))
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").repartition("l_orderkey").withColumn("n", F.row_number().over(best)).where("n = 1")
    plan = lines.select(F.col("l_orderkey").alias("plan_id"), n.alias("seq"), name.alias("name"), (n * 600.0).alias("eta_s"), (n * 2.5).alias("fuel_used"), q.alias("dist_leg"), (q * 2).alias("dist_rem"), (n * 1000.0).alias("altitude"), q.alias("tas"), q.alias("gs"))
    found = corridor.planned_climb_descent(plan, ["plan_id"])
    return found.select("plan_id", "climb_s", "climb_gal", "climb_nm", "descent_s", "descent_nm", F.round("descent_tas", 6).alias("descent_tas"))


@query("""WITH e AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_event_id, arg_max(value, (ts, event_id)) AS event_value FROM events GROUP BY ALL)
SELECT p.user_id, p.name, event_event_id, event_value FROM (SELECT user_id, unnest(['view', 'error', 'nowhere']) AS name FROM (SELECT DISTINCT user_id FROM events)) p LEFT JOIN e ON e.user_id = p.user_id AND e.event_type = p.name""")
def plan_with_events(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("name", F.col("event_type"))
    plan = rows.select("user_id").distinct().withColumn("name", F.explode(F.array(*map(F.lit, ("view", "error", "nowhere")))))
    return corridor.with_events(plan, rows, KEY, ORDER, ["event_id", "value"])


_OPTIONS = """o AS (SELECT l_suppkey AS way, l_returnflag || l_linestatus AS label, count(*) AS n, avg(l_quantity * 2) AS track_nm, avg(l_extendedprice) AS avg_alt, avg(l_quantity * 30 + l_tax * 100) AS still_air_s FROM lineitem GROUP BY ALL)"""


def _options(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("way"), F.concat("l_returnflag", "l_linestatus").alias("label"), (F.col("l_quantity") * 2).alias("track_nm"), F.col("l_extendedprice").alias("avg_alt"), (F.col("l_quantity") * 30 + F.col("l_tax") * 100).alias("still_air_s"))
    return corridor.option_rows(rows, ["way", "label"], ["track_nm", "avg_alt", "still_air_s"])


@query(f"""WITH {_OPTIONS}, w AS (SELECT *, max(track_nm) OVER v AS th, min(track_nm) OVER v AS tl, max(avg_alt) OVER v AS ah, min(avg_alt) OVER v AS al, min(still_air_s) OVER v AS s FROM o WINDOW v AS (PARTITION BY way))
SELECT way, label, n, round(still_air_s, 4) AS still_air_s, still_air_s = s AS best, CASE WHEN th - tl > 6 THEN CASE WHEN track_nm < (th + tl) / 2 THEN 'short' ELSE 'long' END ELSE 'med' END || '/' || CASE WHEN ah - al > 1500 THEN CASE WHEN avg_alt < (ah + al) / 2 THEN 'low' ELSE 'high' END ELSE 'med' END AS profile FROM w""")
def option_profiles(spark, sf_dir):
    return corridor.profiles(_options(spark, sf_dir), "way").select("way", "label", "n", F.round("still_air_s", 4).alias("still_air_s"), "best", "profile")


@query(f"""WITH {_OPTIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY way ORDER BY n DESC, label) AS k FROM o)
SELECT a.way, a.label AS a, b.label AS b, CASE WHEN b.still_air_s > a.still_air_s THEN a.label ELSE b.label END AS faster, round(abs(b.still_air_s - a.still_air_s) / 60, 6) AS air_min, round(abs(b.track_nm - a.track_nm), 6) AS track_nm, round(abs(b.avg_alt - a.avg_alt), 4) AS alt_ft
FROM k a JOIN k b ON a.way = b.way AND a.k = 1 AND b.k = 2""")
def head_to_head(spark, sf_dir):
    found = corridor.head_to_head(_options(spark, sf_dir), "way", [F.desc("n"), "label"])
    return found.select("way", "a", "b", "faster", *_r("air_min", "track_nm", places=6), F.round("alt_ft", 4).alias("alt_ft"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN '-' ELSE CASE WHEN l_quantity > 25 THEN 'tail ' ELSE 'head ' END || abs(l_quantity - 25)::INT::VARCHAR || 'm' END AS wind,
 CASE l_returnflag WHEN 'A' THEN 'Airways' ELSE l_returnflag END AS label FROM lineitem""")
def wind_tags_and_names(spark, sf_dir):
    still = F.when(F.col("l_linenumber") > 1, F.col("l_quantity") * 60).otherwise(F.lit(0.0))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", corridor.wind_tag(still, F.lit(1500.0)).alias("wind"), corridor.renamed(F.col("l_returnflag"), {"A": "Airways"}).alias("label"))


@query("""WITH r AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(DISTINCT event_type) AS s, max(value) AS top FROM events GROUP BY ALL)
SELECT user_id, day, CASE WHEN len(list_filter(s, lambda x: x LIKE 'pur%')) > 0 AND top > 150 THEN 'high' WHEN list_contains(s, 'error') OR list_contains(s, 'signup') THEN CASE WHEN list_contains(s, 'view') THEN CASE WHEN top < 120 THEN 'low' ELSE 'Direct / other' END ELSE 'unseen' END
 WHEN top < 120 THEN 'low' ELSE 'Direct / other' END AS label FROM r""")
def route_rules(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set("event_type").alias("s"), F.max("value").alias("top"))
    rules = [{"label": "high", "any_prefix": ["pur", "xyz"], "alt_above": 150}, {"label": "unseen", "any_of": ["error", "signup"], "none_of": ["view"]}, {"label": "low", "alt_below": 120}]
    return rows.select("user_id", "day", corridor.classified(F.col("s"), rules, F.col("top")).alias("label"))


@query(f"""WITH {_FLIGHTS} SELECT log_id, 'flights' AS request FROM f WHERE hours <> 0 AND distance >= 0.2 AND status = 'F' UNION ALL SELECT log_id, 'filtered' FROM f WHERE system_id IN (1, 4, 7)""")
def listed_flights(spark, sf_dir):
    rows = _flights(spark, sf_dir).withColumn("kind", F.when(F.col("status") == "F", "flight").otherwise("ground"))
    own = catalog.listed(rows, "flights", catalog.is_flight(F.col("hours"), F.col("distance"), F.col("kind"))).withColumn("request", F.lit("flights"))
    chosen = catalog.listed(rows, "filtered", chosen=F.col("system_id").isin(1, 4, 7)).withColumn("request", F.lit("filtered"))
    return own.unionByName(chosen).unionByName(catalog.listed(rows, "filtered").withColumn("request", F.lit("none"))).select("log_id", "request")


@query(f"""WITH {_FLIGHTS} SELECT log_id FROM f WHERE contains(log_file_name, '77') OR contains(coalesce(start_icao, ''), '77') OR list_contains([coalesce(end_icao, '')], 'B')""")
def text_search(spark, sf_dir):
    rows = _flights(spark, sf_dir).withColumn("route", F.array("end_icao"))
    found = catalog.containing(rows, ["log_file_name", "start_icao"], "77").select("log_id")
    return found.union(catalog.containing(rows, ["route"], "B").select("log_id")).distinct()


@query("SELECT doc_id FROM documents WHERE contains(text, 'the ') OR contains(source, 'src1')")
def document_search(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return joins.upsert(catalog.containing(docs, ["text"], "the "), catalog.containing(docs, ["source"], "src1"), ["doc_id"]).select("doc_id")


@query(f"""WITH {_FLIGHTS} SELECT log_id, coalesce(s < TIMESTAMP '1995-01-01', false) AS earlier, coalesce(s > TIMESTAMP '1995-01-01', false) AS later FROM (SELECT log_id, CASE WHEN log_id % 4 > 0 THEN start_time END AS s FROM f)""")
def before_and_after(spark, sf_dir):
    rows = _flights(spark, sf_dir).withColumn("s", F.when(F.col("log_id") % 4 > 0, F.col("start_time")))
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    return rows.select("log_id", catalog.starts_before(F.col("s"), cut).alias("earlier"), catalog.starts_after(F.col("s"), cut).alias("later"))


_FILES = "n AS (SELECT o_orderkey, 'log_' || strftime(o_orderdate, '%y%m%d') || '_1012' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || '_EGTF.csv' AS name, o_orderdate + INTERVAL 10 HOUR + INTERVAL 12 MINUTE + to_seconds(o_orderkey % 60) AS told FROM orders)"


def _files(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("log_"), F.date_format("o_orderdate", "yyMMdd"), F.lit("_1012"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("_EGTF.csv"))
    return _t(spark, sf_dir, "orders").select(k, "o_orderdate", name.alias("name"))


@query(f"""WITH {_FILES}, p AS (SELECT o_orderkey, name, strptime('20' || substr(name, 5, 6) || substr(name, 12, 6), '%Y%m%d%H%M%S') AS t FROM n), l AS (SELECT max(t) AS t FROM p WHERE o_orderkey % 100 = 1)
SELECT o_orderkey, 'after_date' AS method FROM p WHERE t >= TIMESTAMP '2020-06-01' UNION ALL SELECT p.o_orderkey, 'latest' FROM p, l WHERE p.t >= l.t UNION ALL SELECT o_orderkey, 'all' FROM p""")
def import_lists(spark, sf_dir):
    rows = _files(spark, sf_dir)
    pick = lambda method, **more: catalog.import_list(rows, "name", method, **more).select("o_orderkey", F.lit(method).alias("method"))
    since = F.lit("2020-06-01").cast("timestamp")
    return pick("after_date", since=since).unionByName(pick("latest", imported=rows.where("o_orderkey % 100 = 1"))).unionByName(pick("all"))


@query(f"""WITH {_FILES} SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'report' WHEN 1 THEN 'system' WHEN 2 THEN NULL ELSE 'log' END AS kind, 'EGTF' AS airport, strptime('20' || substr(name, 5, 6) || substr(name, 12, 6), '%Y%m%d%H%M%S')::VARCHAR AS told FROM n""")
def file_names(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    own = F.when(k == 0, F.lit("rpt_1.csv")).when(k == 1, F.lit("sys_1.json")).when(k == 2, F.lit("other.txt")).otherwise(F.col("name"))
    return _files(spark, sf_dir).select("o_orderkey", text.file_kind(own).alias("kind"), text.file_airport(F.col("name")).alias("airport"), text.file_time(F.col("name")).cast("string").alias("told"))


@query("""SELECT p_partkey, p_name AS a, 'x, "' || p_brand || '"' AS b, p_size::VARCHAR AS c, '' AS d FROM part""")
def quoted_cells(spark, sf_dir):
    line = F.concat(F.lit(" "), F.col("p_name"), F.lit(' , "x, ""'), F.col("p_brand"), F.lit('""", '), F.col("p_size").cast("string"), F.lit(","))
    own = _t(spark, sf_dir, "part").select("p_partkey", logs.cells(line).alias("c"))
    return own.where(F.size("c") == 4).select("p_partkey", *[F.col("c")[i].alias(n) for i, n in enumerate("abcd")])


@query("""SELECT s_suppkey, s_name AS name, '01.2' AS version, 2 AS n FROM supplier""")
def log_metadata(spark, sf_dir):
    line = F.concat(F.lit('#airframe_info,log_version="01.2",system_id="'), F.col("s_name"), F.lit('",'))
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), F.lit(0).alias("line_no"), line.alias("line"))
    return logs.metadata(rows).select(F.col("path").alias("s_suppkey"), F.col("meta")["system_id"].alias("name"), F.col("meta")["log_version"].alias("version"), F.size("meta").alias("n"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS day FROM orders""")
def header_dates(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders")
    return rows.select("o_orderkey", plans.header_date(F.concat(F.lit("EGTF - LFAT N1 ("), F.date_format("o_orderdate", "MMM dd, yyyy"), F.lit(")"))).alias("day"))


@query(f"""WITH {_FLIGHTS}, m AS (SELECT log_id, system_id, start_time AS ts, row_number() OVER (PARTITION BY system_id, start_time ORDER BY log_id) AS k FROM f),
g AS (SELECT system_id, start_time, arg_max({{'a': fuel_from, 'b': fuel_to, 'c': fuel_used, 'd': added}}, log_id) AS v FROM f GROUP BY ALL),
j AS (SELECT m.log_id, g.v FROM m ASOF LEFT JOIN g ON m.system_id = g.system_id AND m.ts > g.start_time)
SELECT log_id, round(coalesce(v.b, 0), 8) AS tanks, round(coalesce(v.a - v.c, 0), 8) AS totalizer, round(coalesce(v.b, 0) + coalesce(v.d, 0), 8) AS tanks_plus_added, round(coalesce(v.a - v.c, 0) + coalesce(v.d, 0), 8) AS totalizer_plus_added FROM j""")
def fuel_on_dates(spark, sf_dir):
    rows = _flights(spark, sf_dir)
    one = rows.groupBy("system_id", "start_time").agg(F.max_by(F.struct(F.col("fuel_from").alias("fuel_start"), F.col("fuel_to").alias("fuel_end"), F.col("fuel_used").alias("fuel_totalizer"), "added"), "log_id").alias("v")).select("system_id", "start_time", "v.*")
    found = catalog.fuel_on(rows.select("log_id", "system_id", F.col("start_time").alias("ts")), one)
    return found.select("log_id", *_r("tanks", "totalizer", "tanks_plus_added", "totalizer_plus_added", places=8))


@query(f"WITH {_FLIGHTS} SELECT log_id, start_time FROM f ORDER BY start_time DESC, log_file_name DESC LIMIT 20")
def newest_flights(spark, sf_dir):
    return catalog.newest_first(_flights(spark, sf_dir)).limit(20).select("log_id", "start_time")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'O' THEN 'quickParsed' ELSE 'notParsed' END AS status, o_orderstatus <> 'F' OR o_orderkey % 5 = 0 AS again FROM orders""")
def parse_states(spark, sf_dir):
    told = F.when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "O", "quickParsed").otherwise("unheard of")
    version = F.when(F.col("o_orderkey") % 5 > 0, F.lit(1))
    return _t(spark, sf_dir, "orders").select("o_orderkey", catalog.status(told).alias("status"), catalog.requires_parsing(told, version).alias("again"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 > 0 THEN 'quickParsed' WHEN o_orderkey % 4 = 0 THEN 'parsed' WHEN o_orderkey % 3 = 0 THEN 'parsed' ELSE 'quickParsed' END AS status, CASE WHEN o_orderkey % 4 = 0 OR (o_orderkey % 4 = 2 AND o_orderkey % 3 > 0) THEN 'new' ELSE 'old' END AS origin FROM orders""")
def refined_records(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders")
    old = rows.select(k, F.when(k % 3 == 0, "parsed").otherwise("quickParsed").alias("status"), F.lit("old").alias("origin"))
    new = rows.where(k % 2 == 0).select(k, F.when((k % 4 == 0) & (k % 3 == 0), "parsed").otherwise("quickParsed").alias("status"), F.lit("new").alias("origin"))
    return catalog.refined(old, new, "o_orderkey")


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey""")
def first_and_last_of_key(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    pick = lambda last, name: catalog.one_a_key(rows, "o_custkey", ["o_orderdate", "o_orderkey"], last).select("o_custkey", F.col("o_orderkey").alias(name))
    return pick(False, "first_order").join(pick(True, "last_order"), "o_custkey")


@query("""WITH t AS (SELECT o_orderkey, o_orderdate AS t FROM orders)
SELECT o_orderkey, unnest(['Start', 'Taxi', 'Takeoff', 'Landing', 'Parked', 'Shutdown']) AS cell, unnest([t, t + INTERVAL 5 MINUTE, t + INTERVAL 9 MINUTE, t + INTERVAL 60 MINUTE, t + INTERVAL 66 MINUTE, t + INTERVAL 70 MINUTE]) AS at FROM t""")
def summary_times(spark, sf_dir):
    at = lambda m: F.col("o_orderdate") + F.expr(f"INTERVAL {m} MINUTES")
    names = {"hobbs_start": 0, "moving_start": 5, "flying_start": 9, "flying_end": 60, "moving_end": 66, "hobbs_end": 70}
    return catalog.summary_cells(_t(spark, sf_dir, "orders").select("o_orderkey", *[at(m).alias(n) for n, m in names.items()]), "o_orderkey")


@query("""SELECT s_suppkey, unnest(['Start', 'End', 'Used']) AS cell, unnest([30.0::DOUBLE + s_suppkey % 9, 20.0::DOUBLE, 10.0::DOUBLE + s_suppkey % 9]) AS "left", unnest([25.0::DOUBLE, 15.0::DOUBLE, 10.0::DOUBLE]) AS "right", unnest([55.0::DOUBLE + s_suppkey % 9, 35.0::DOUBLE, 20.0::DOUBLE + s_suppkey % 9]) AS total FROM supplier""")
def summary_fuel(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", fuel.tanks(30.0 + F.col("s_suppkey") % 9, F.lit(25.0)).alias("fuel_start"), fuel.tanks(F.lit(20.0), F.lit(15.0)).alias("fuel_end"))
    return catalog.fuel_cells(rows, "s_suppkey")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 50.0::DOUBLE WHEN s_suppkey % 3 = 1 THEN (s_suppkey % 20 + 1 + 8)::DOUBLE ELSE 70.0::DOUBLE END AS target, CASE WHEN s_suppkey % 3 = 0 THEN 60.0::DOUBLE WHEN s_suppkey % 3 = 1 THEN (s_suppkey % 20 + 9)::DOUBLE ELSE 92.0::DOUBLE END AS totalizer_start,
 CASE WHEN s_suppkey % 3 = 0 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS added FROM supplier""")
def fuel_defaults(spark, sf_dir):
    k = F.col("s_suppkey")
    known = F.when(k % 3 == 1, 1)
    rows = _t(spark, sf_dir, "supplier").select(k, F.when(k % 3 == 0, F.lit("2024-01-01")).alias("last_entered"), F.lit(50.0).alias("target"), F.lit(60.0).alias("totalizer_start"), F.lit(4.0).alias("added"), (known * (k % 20 + 0.2)).alias("start_left"), (known * 7.3).alias("start_right"))
    return catalog.fuel_defaults(rows).select("s_suppkey", "target", "totalizer_start", "added")


@query(f"""WITH {_FLIGHTS} SELECT log_id, CASE WHEN log_id % 2 = 0 THEN concat_ws(' via ', concat_ws(' - ', start_icao, end_icao), 'X, Y') ELSE concat_ws(' - ', start_icao, end_icao) END AS route, coalesce(CASE WHEN log_id % 3 > 0 THEN 'N' || log_id END, system_id::VARCHAR) AS identifier, log_id % 5 < 2 AS agrees FROM f WHERE start_icao IS NOT NULL AND end_icao IS NOT NULL""")
def route_texts(spark, sf_dir):
    k = F.col("log_id")
    rows = _flights(spark, sf_dir).where("start_icao IS NOT NULL AND end_icao IS NOT NULL")
    route = F.when(k % 2 == 0, F.array(F.col("start_icao"), F.lit("X"), F.lit("Y"), F.col("end_icao"))).otherwise(F.array("start_icao", "end_icao"))
    name = catalog.display_identifier(F.when(k % 3 > 0, F.concat(F.lit("N"), k.cast("string"))), F.col("system_id"))
    return rows.select("log_id", catalog.route_text(route, F.col("start_icao"), F.col("end_icao")).alias("route"), name.alias("identifier"), catalog.totalizer_agrees((k % 5).cast("double"), F.lit(0.0)).alias("agrees"))


@query("""WITH f AS (SELECT s_suppkey, (s_suppkey * 7 % 40)::DOUBLE AS cl, (s_suppkey * 11 % 40)::DOUBLE AS cr, (s_suppkey * 3 % 20)::DOUBLE AS added FROM supplier) SELECT s_suppkey, CASE WHEN cl - cr + added > 0 THEN cl - cr + added ELSE 70.0 END AS start, added + cr < 46 AND added + cr >= cr AS valid, cl + cr AS total FROM f""")
def totalizer_starts(spark, sf_dir):
    k = F.col("s_suppkey")
    cl, cr, added = ((k * a % b).cast("double") for a, b in ((7, 40), (11, 40), (3, 20)))
    return _t(spark, sf_dir, "supplier").select(k, fuel.next_totalizer_start(cl, cr, added, F.lit(70.0)).alias("start"), fuel.valid_added(added, cr, F.lit(46.0)).alias("valid"), fuel.total(fuel.tanks(cl, cr)).alias("total"))


@query("""SELECT event_id, round(value * cos(radians(event_id % 360 - user_id)), 6) + 0.0 AS head, round(value * sin(radians(event_id % 360 - user_id)), 6) + 0.0 AS side,
 CASE WHEN (event_id % 720 - 100 + 720) % 360 > 180 THEN (event_id % 720 - 100 + 720) % 360 - 360 ELSE (event_id % 720 - 100 + 720) % 360 END::DOUBLE AS turn FROM events""")
def planning_winds(spark, sf_dir):
    args = F.col("value"), F.col("event_id") % 360, F.col("user_id")
    turn = geo.angle_difference((F.col("event_id") % 720).cast("double"), F.lit(100.0))
    return _t(spark, sf_dir, "events").select("event_id", (F.round(geo.headwind(*args), 6) + 0.0).alias("head"), (F.round(geo.side_wind(*args), 6) + 0.0).alias("side"), turn.alias("turn"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN round((c_custkey % 80 + 30.5 / 60)::DOUBLE, 6) END AS lat, CASE WHEN c_custkey % 3 > 0 THEN round(-(c_custkey % 170 + 15.25 / 60)::DOUBLE, 6) END AS lon,
 CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 360)::DOUBLE END AS direction, 18.0::DOUBLE AS speed FROM customer""")
def parsed_tokens(spark, sf_dir):
    k = F.col("c_custkey")
    token = F.concat(F.lit("N"), F.lpad((k % 80).cast("string"), 2, "0"), F.lit("30.5/W"), F.lpad((k % 170).cast("string"), 3, "0"), F.lit("15.25"))
    place, wind = geo.coordinate(F.when(k % 3 > 0, token).otherwise("DCT")), text.pair(F.concat(F.when(k % 4 > 0, (k % 360).cast("string")).otherwise("--"), F.lit("/018")))
    return _t(spark, sf_dir, "customer").select(k, F.round(place["lat"], 6).alias("lat"), F.round(place["lon"], 6).alias("lon"), wind["first"].alias("direction"), wind["second"].alias("speed"))


@query("""SELECT event_id, (round(epoch(ts) / 300) * 300)::BIGINT AS nearest, 'value' AS field, 'max' AS metric FROM events""")
def rounded_times_and_keys(spark, sf_dir):
    key = text.split_key(F.lit(text.metric_key("value", "max")))
    return _t(spark, sf_dir, "events").select("event_id", F.unix_seconds(text.rounded_time(F.col("ts"), 300)).alias("nearest"), key["field"].alias("field"), key["metric"].alias("metric"))


@query("""SELECT event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS told FROM events""")
def text_rows(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("ts", "event_id", F.col("ts").alias("at"))
    found = store.as_text(rows.select("at", "event_id"), "at")
    return rows.select("event_id", "ts").join(found.select(F.col("event_id").cast("long").alias("event_id"), F.col("at").alias("told")), "event_id")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def removed_records(spark, sf_dir):
    gone = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return catalog.without(_t(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey")


@query("""SELECT user_id, round(median(value), 6) AS middle, arg_min(event_id, (value, ts, event_id)) AS lowest_at, arg_max(event_id, (value, ts, event_id)) AS highest_at FROM events GROUP BY user_id""")
def middles_and_extremes(spark, sf_dir):
    at = F.struct("value", *ORDER)
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.median("value"), 6).alias("middle"), F.min_by("event_id", at).alias("lowest_at"), F.max_by("event_id", at).alias("highest_at"))


@query("""SELECT user_id, max(value) AS alt, round(avg(value), 6) AS ias, arg_max(value, (ts, event_id)) AS fuel, arg_min(value, (ts, event_id)) AS lat FROM events GROUP BY user_id""")
def leg_values(spark, sf_dir):
    s = stats.value_stats("value", F.struct(*ORDER))
    shown = {"alt": "AltMSL", "ias": "IAS", "fuel": "FQtyT", "lat": "Latitude"}
    found = _t(spark, sf_dir, "events").groupBy("user_id").agg(*[fields.leg_value(s, f).alias(n) for n, f in shown.items()])
    return found.withColumn("ias", F.round("ias", 6))


@query("""SELECT event_id, round(value * 33.86389, 4) AS "BaroA", round((value - 32) / 1.8, 6) AS "E1 OilT", value AS "Other" FROM events""")
def shown_fields(spark, sf_dir):
    v = F.col("value")
    rows = _t(spark, sf_dir, "events").select("event_id", v.alias("BaroA"), v.alias("E1 OilT"), v.alias("Other"))
    rows = fields.shown(rows, ["BaroA", "IAS", "Other"])
    from skyloom.functions.units import displayed

    rows = displayed(rows, {"E1 OilT": (fields.unit("E1 OilT"), "degC")})
    return rows.select("event_id", F.round("BaroA", 4).alias("BaroA"), F.round("E1 OilT", 6).alias("E1 OilT"), "Other")


@query(f"""WITH {_TRACK}, p AS (SELECT *, value_on > 0 AS pw FROM (SELECT *, event_id % 11 - 3 AS value_on FROM t)), e0 AS (SELECT user_id, min(row_idx) FILTER (pw) AS a, max(row_idx) FILTER (pw) AS b FROM p GROUP BY user_id),
e AS (SELECT p.* FROM p JOIN e0 USING (user_id) WHERE row_idx BETWEEN a AND b), en AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_idx) AS n FROM e),
br AS (SELECT *, coalesce(max(CASE WHEN NOT gs > 10 THEN n END) OVER (PARTITION BY user_id ORDER BY n), 0) AS broken FROM en),
m0 AS (SELECT user_id, min(row_idx) FILTER (gs > 10 AND n - broken >= 5) AS a, max(row_idx) FILTER (gs > 10) AS b FROM br GROUP BY user_id),
w0 AS (SELECT user_id, arg_min(fuel, row_idx) AS fuel_from, arg_max(fuel, row_idx) AS fuel_to, arg_max(fuel_burn, row_idx) AS fuel_totalizer, arg_max(elapsed, row_idx) AS distance, max(alt) AS altitude FROM t GROUP BY user_id), f0 AS (SELECT user_id, min(row_idx) FILTER (ias > 35) AS a, max(row_idx) FILTER (ias > 35) AS b FROM e GROUP BY user_id)
SELECT e0.user_id AS log_id, (SELECT ts FROM t WHERE t.user_id = e0.user_id AND row_idx = e0.a) AS engine_start, (SELECT ts FROM t WHERE t.user_id = e0.user_id AND row_idx = e0.b) AS engine_end, (SELECT ts FROM t WHERE t.user_id = e0.user_id AND row_idx = m0.a) AS moving_start,
 (SELECT ts FROM t WHERE t.user_id = e0.user_id AND row_idx = f0.a) AS flying_start, (SELECT ts FROM t WHERE t.user_id = e0.user_id AND row_idx = f0.b) AS flying_end, CASE WHEN e0.a IS NULL OR m0.a IS NULL THEN 'preflight' WHEN f0.a IS NULL THEN 'ground' ELSE 'flight' END AS type,
 (SELECT ts FROM t WHERE t.user_id = e0.user_id AND row_idx = CASE WHEN m0.a IS NOT NULL THEN m0.b END) AS moving_end, round(fuel_from, 6) AS fuel_from, round(fuel_to, 6) AS fuel_to, round(fuel_totalizer, 6) AS fuel_totalizer, round(distance, 3) AS distance, altitude, route
FROM e0 JOIN w0 USING (user_id) LEFT JOIN m0 USING (user_id) LEFT JOIN f0 USING (user_id) LEFT JOIN
 (SELECT user_id, string_agg(event_type, ' ' ORDER BY row_idx) AS route FROM (SELECT t.user_id, row_idx, event_type, lag(event_type) OVER (PARTITION BY t.user_id ORDER BY row_idx) AS before, row_number() OVER (PARTITION BY t.user_id ORDER BY row_idx) AS n FROM t JOIN f0 USING (user_id) WHERE row_idx >= f0.a)
  WHERE (n = 1 OR event_type IS DISTINCT FROM before) AND event_type <> '' GROUP BY user_id) USING (user_id)""")
def flight_summaries(spark, sf_dir):
    rows = _track(spark, sf_dir).select(
        F.col("user_id").alias("log_id"), F.struct(*ORDER).alias("ts"), F.when(F.col("gs") > 10, F.col("gs")).otherwise(0.0).alias("gs"), "ias", (F.col("event_id") % 11 - 3).cast("double").alias("power"),
        F.col("fuel").alias("fuel_left"), F.col("fuel").alias("fuel_right"), F.col("fuel_burn").alias("totalizer"), F.col("elapsed").alias("distance"), "alt", F.col("event_type").alias("waypoint"),
    )
    found = flights.summaries(rows)
    times = [F.col(f"{c}.ts").alias(c) for c in ("engine_start", "engine_end", "moving_start", "moving_end", "flying_start", "flying_end")]
    return found.select("log_id", *times, "type", F.round("fuel_start.left", 6).alias("fuel_from"), F.round("fuel_end.right", 6).alias("fuel_to"), *_r("fuel_totalizer", places=6), *_r("distance", places=3), "altitude", F.array_join("route", " ").alias("route"))
