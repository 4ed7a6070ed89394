"""Registered queries of computed columns, legs from take-off, time ranges and field frames, each with its SQL.

Events stand for recorder rows; their columns take the names that the field dictionary knows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom import fields
from skyloom.functions import spans
from skyloom.operators import derived, flights, series, stats
from skyloom.plans.catalogue import KEY, ORDER, W, _t, query


def _recorder(spark, sf_dir):
    """Recorder rows: cylinder i at value * (i + event_id % i), the fuel of a tank missing now and then."""
    k, v, none = F.col("event_id"), F.col("value"), F.lit(float("nan"))
    rows = _t(spark, sf_dir, "events").withColumns({f"E1 EGT{i}": v * (i + k % i) for i in range(1, 7)})
    return rows.withColumns({
        "FQtyL": F.when(k % 5 > 0, v), "FQtyR": F.when(k % 7 == 0, none).otherwise(v * 2), "WndDr": (k % 720 - 360).cast("double"), "WndSpd": v / 10, "CRS": (k * 7 % 360).cast("double"),
        "E1 FFlow": F.when(k % 11 == 0, none).otherwise(v), "E1 RPM": F.when(k % 3 > 0, v * 10).otherwise(F.lit(0.0)), "Latitude": F.when(k % 13 == 0, none).otherwise(v / 10), "Longitude": v / 5,
        "AtvWpt": F.col("event_type"),
    })


_EGT = "[" + ", ".join(f"value * ({i} + event_id % {i})" for i in range(1, 7)) + "]"


@query(f"""WITH t AS (SELECT *, {_EGT} AS egt, radians(CASE WHEN abs(pmod - crs) > 180 THEN 360 - abs(pmod - crs) ELSE abs(pmod - crs) END) AS angle
 FROM (SELECT *, CASE WHEN event_id % 720 < 360 THEN event_id % 720 ELSE event_id % 720 - 360 END AS pmod, event_id * 7 % 360 AS crs FROM events))
SELECT event_id, CASE WHEN event_id % 5 > 0 AND event_id % 7 > 0 THEN round(value * 3, 6) END AS fuel, round(list_max(egt), 6) AS hottest, round(list_min(egt), 6) AS coldest,
 list_position(egt, list_max(egt))::VARCHAR AS cylinder, round(value / 10 * sin(angle), 6) + 0.0 AS "cross", round(-value / 10 * cos(angle), 6) + 0.0 AS along,
 round(sum(CASE WHEN event_id % 11 > 0 THEN value / 3600 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS totalizer FROM t""")
def derived_columns(spark, sf_dir):
    rows = derived.derived(_recorder(spark, sf_dir), KEY, ORDER)
    names = {"FQtyT": "fuel", "E1 EGTMax": "hottest", "E1 EGTMin": "coldest", "WndCross": "cross", "WndDirect": "along", "FTotalizerT": "totalizer"}
    return rows.select("event_id", F.col("E1 EGTMaxIdx").alias("cylinder"), *[(F.round(f"`{c}`", 6) + F.lit(0.0)).alias(n) for c, n in names.items()])


@query(f"""WITH w AS (SELECT event_id, count(*) OVER five AS n, value - first_value(value) OVER five AS gain, min(value) OVER five AS low FROM events WINDOW five AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING))
SELECT event_id, CASE WHEN n < 5 THEN 'short' WHEN low < 10 THEN 'low' WHEN gain > 50 THEN 'up' WHEN gain < -50 THEN 'down' ELSE 'level' END AS trend FROM w""")
def rolled_names(spark, sf_dir):
    def trend(value):
        gain = F.element_at(value, -1) - value[0]
        return F.when(F.size(value) < 5, "short").when(F.array_min(value) < 10, "low").when(gain > 50, "up").when(gain < -50, "down").otherwise("level")

    return derived.rolled(_t(spark, sf_dir, "events"), ["value"], 5, KEY, ORDER, "trend", trend).select("event_id", "trend")


def _flown_sql(rows: str) -> str:
    return f"""l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), r AS ({rows}),
c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) {W} AND row_number() {W} > 1 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS leg FROM c),
s AS (SELECT user_id, leg, min(event_type) AS name, min(ts) AS start FROM g GROUP BY user_id, leg)
SELECT user_id, leg::INT AS leg_idx, name, start, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY leg), last) AS "end" FROM s JOIN l USING (user_id)"""


@query(f"""WITH {_flown_sql("SELECT * FROM events JOIN (SELECT user_id, min(ts) AS takeoff FROM events WHERE value > 100 GROUP BY user_id) USING (user_id) WHERE ts >= takeoff")}""")
def legs_from_takeoff(spark, sf_dir):
    rows = _recorder(spark, sf_dir)
    takeoff = rows.where("value > 100").groupBy(*KEY).agg(F.min("ts").alias("takeoff"))
    return flights.flown_legs(rows, ["AtvWpt"], KEY, ORDER, "ts", takeoff).withColumn("leg_idx", F.col("leg_idx").cast("int")).withColumnRenamed("AtvWpt", "name")


@query(f"WITH {_flown_sql('SELECT * FROM events')}")
def route_legs(spark, sf_dir):
    found = flights.flown_legs(_recorder(spark, sf_dir), ["AtvWpt"], KEY, ORDER, "ts")
    return found.withColumn("leg_idx", F.col("leg_idx").cast("int")).withColumnRenamed("AtvWpt", "name")


@query("""WITH s AS (SELECT user_id, epoch_us(min(ts)) / 1e6 AS a, epoch_us(max(ts)) / 1e6 AS b, epoch_us(min(ts) FILTER (event_type = 'click')) / 1e6 AS c, epoch_us(max(ts) FILTER (event_type = 'click')) / 1e6 AS d FROM events GROUP BY user_id)
SELECT user_id, round(b - a, 3) AS elapsed, round(c - a, 3) AS before, round(d - a, 3) AS until, round(b - d, 3) AS after,
 CASE WHEN c IS NOT NULL THEN (ceil((d - 978307200) / 7000) - floor((c - 978307200) / 7000))::INT + 1 END AS moments, (floor((c - 978307200) / 7000) * 7000 + 978307200)::BIGINT AS first FROM s""")
def time_ranges(spark, sf_dir):
    click = F.col("event_type") == "click"
    ends = _t(spark, sf_dir, "events").groupBy(*KEY).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.min(F.when(click, F.col("ts"))).alias("c"), F.max(F.when(click, F.col("ts"))).alias("d"))
    own = ends.select(*KEY, spans.span(F.col("a"), F.col("b")).alias("log"), spans.span(F.col("c"), F.col("d")).alias("part"))
    log, part = F.col("log"), F.col("part")
    schedule = spans.schedule(part, 7000)
    figures = {"elapsed": log, "before": spans.start_to_start(log, part), "until": spans.start_to_end(log, part), "after": spans.end_to_end(part, log)}
    return own.select(
        *KEY, *[F.round(spans.elapsed_s(r), 3).alias(n) for n, r in figures.items()], F.when(part.isNotNull(), F.size(schedule)).alias("moments"), F.unix_seconds(F.get(schedule, F.lit(0))).alias("first")
    )


@query("""SELECT event_id, round(value * 2, 6) AS "right", round(value, 6) AS "left" FROM events WHERE event_id % 5 > 0 AND event_id % 7 > 0""")
def number_frame(spark, sf_dir):
    rows = fields.frame(_recorder(spark, sf_dir), "number", ["event_id"], ["FQtyL", "FQtyR"], every=False)
    return rows.select("event_id", F.round("FQtyR", 6).alias("right"), F.round("FQtyL", 6).alias("left"))


@query("""SELECT event_id, event_type AS waypoint, CASE WHEN event_id % 13 > 0 THEN round(value / 10, 6) END AS lat, CASE WHEN event_id % 13 > 0 THEN round(value / 5, 6) END AS lon FROM events""")
def name_and_position_frames(spark, sf_dir):
    rows = _recorder(spark, sf_dir)
    names = fields.frame(rows, "name", ["event_id"]).withColumnRenamed("AtvWpt", "waypoint")
    places = fields.frame(rows, "position", ["event_id"]).select("event_id", F.round("position.lat", 6).alias("lat"), F.round("position.lon", 6).alias("lon"))
    return names.join(places, "event_id")


@query("""WITH t AS (SELECT *, time_bucket(INTERVAL 1 day, ts) AS start FROM events)
SELECT user_id, strftime(start, '%Y-%m-%d') AS start, round(median(value), 6) AS median, arg_min(event_id, (value, event_id)) AS min_at, arg_min(event_id, (-value, event_id)) AS max_at,
 round(max(value) FILTER (event_id % 5 > 0 AND event_id % 7 > 0), 6) AS imbalance, count(*) FILTER (event_id % 3 > 0 AND value > 0) * 2 > count(*) AS running FROM t GROUP BY ALL""")
def interval_extras(spark, sf_dir):
    rows = series.intervals(_recorder(spark, sf_dir), "ts", 86400)
    found = stats.interval_extras("value", F.col("event_id"), F.col("FQtyL"), F.col("FQtyR"), F.col("E1 RPM") > 0)
    out = rows.groupBy(*KEY, "start").agg(*[c.alias(n) for n, c in found.items()])
    return out.withColumns({"start": F.date_format("start", "yyyy-MM-dd"), "median": F.round("median", 6), "imbalance": F.round("imbalance", 6)})
