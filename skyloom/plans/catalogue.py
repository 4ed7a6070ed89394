"""Registered queries over the test tables, each with the SQL that gives the same rows.

Recorder roles: ``user_id`` is the log, (ts, event_id) the order, ``event_type`` a name column, ``value``
a number column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import geo, text, units
from skyloom.operators import corridor, flights, joins, phase, series, stats

KEY, ORDER = ["user_id"], ["ts", "event_id"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from skyloom.plans import computed, files, kept, planning, recorder  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from skyloom.plans import computed, files, kept, planning, recorder  # noqa: F401

    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_LEGS = f"""c AS (SELECT *, CASE WHEN row_number() {W} = 1 OR event_type IS DISTINCT FROM lag(event_type) {W} THEN 1 ELSE 0 END AS new FROM events),
legs AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS leg_idx FROM c)"""


@query(f"""WITH {_LEGS} SELECT user_id, leg_idx::BIGINT AS leg_idx, min(event_type) AS event_type, min(ts) AS start_ts, max(ts) AS end_ts, count(value) AS n,
 arg_min(value, (ts, event_id)) AS start_value, arg_max(value, (ts, event_id)) AS end_value, min(value) AS min_value, max(value) AS max_value,
 round(avg(value), 6) AS avg_value, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS total_value FROM legs GROUP BY user_id, leg_idx""")
def leg_statistics(spark, sf_dir):
    rows = series.legs(_t(spark, sf_dir, "events"), ["event_type"], KEY, ORDER)
    s = stats.value_stats("value", F.struct(*ORDER))
    return rows.groupBy("user_id", F.col("leg_idx").cast("long").alias("leg_idx")).agg(
        F.min("event_type").alias("event_type"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), s["count"].alias("n"),
        s["start"].alias("start_value"), s["end"].alias("end_value"), s["min"].alias("min_value"), s["max"].alias("max_value"),
        F.round(s["average"], 6).alias("avg_value"), F.round(s["total"], 6).alias("total_value"),
    )


@query(f"WITH {_LEGS} SELECT event_id, user_id, ts, event_type FROM c WHERE new = 1")
def value_change_segments(spark, sf_dir):
    return series.value_changes(_t(spark, sf_dir, "events"), ["event_type", "absent"], KEY, ORDER).select("event_id", "user_id", "ts", "event_type")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts), event_type ORDER BY ts, event_id) AS n,
 row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS month, arg_min(event_type, i) AS "start", arg_max(event_type, i) AS "end", arg_max(event_type, (n, -i)) AS most_frequent, count(DISTINCT event_type) AS n_distinct
FROM n GROUP BY ALL""")
def segment_modes(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("month", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    return stats.modes(rows, "event_type", ["user_id", "month"], ORDER)


@query("""SELECT user_id, time_bucket(INTERVAL 6 HOURS, ts)::TIMESTAMP AS start, count(value) AS n, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS avg_value
FROM events GROUP BY ALL""")
def interval_value_stats(spark, sf_dir):
    rows = series.intervals(_t(spark, sf_dir, "events"), "ts", 21600)
    return rows.groupBy("user_id", "start").agg(F.count("value").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("""WITH e AS (SELECT user_id, min(time_bucket(INTERVAL 1 DAY, ts)) AS a, max(time_bucket(INTERVAL 1 DAY, ts)) AS b FROM events GROUP BY user_id),
g AS (SELECT user_id, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS start FROM e)
SELECT g.user_id, g.start, count(value) AS n FROM g LEFT JOIN events ON events.user_id = g.user_id AND time_bucket(INTERVAL 1 DAY, ts) = g.start GROUP BY ALL""")
def interval_dense_grid(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    grid = series.dense_intervals(rows, "ts", KEY, 86400)
    return grid.join(series.intervals(rows, "ts", 86400), ["user_id", "start"], "left").groupBy("user_id", "start").agg(F.count("value").alias("n"))


@query(f"""WITH {_LEGS}, s AS (SELECT user_id, leg_idx, min(ts) AS start FROM legs GROUP BY ALL), m AS (SELECT user_id, max(ts) AS last FROM events GROUP BY ALL)
SELECT user_id, leg_idx::BIGINT AS leg_idx, start, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start, leg_idx), last) AS "end" FROM s JOIN m USING (user_id)""")
def leg_ends(spark, sf_dir):
    rows = series.legs(_t(spark, sf_dir, "events"), ["event_type"], KEY, ORDER)
    legs = rows.withColumn("last", F.max("ts").over(Window.partitionBy(*KEY))).groupBy("user_id", F.col("leg_idx").cast("long").alias("leg_idx")).agg(F.min("ts").alias("start"), F.max("last").alias("last"))
    return series.leg_ends(legs, KEY, "start", "last", order=["leg_idx"]).drop("last")


@query("SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def range_slice(spark, sf_dir):
    cut = lambda s: F.lit(s).cast("timestamp_ntz")
    return series.between(_t(spark, sf_dir, "events"), "ts", cut("2024-01-05"), cut("2024-01-20")).select("event_id", "user_id", "ts")


@query(f"""WITH n AS (SELECT *, row_number() {W} AS n, coalesce(value > 20, false) AS m FROM events),
b AS (SELECT *, coalesce(max(CASE WHEN NOT m THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS broken FROM n),
f AS (SELECT *, min(CASE WHEN m AND n - broken >= 3 THEN n END) OVER (PARTITION BY user_id) AS first FROM b)
SELECT event_id, user_id, value FROM f WHERE n >= first""")
def drop_head_run(spark, sf_dir):
    return series.drop_head(_t(spark, sf_dir, "events"), F.col("value") > 20, KEY, ORDER, run=3).select("event_id", "user_id", "value")


@query(f"""WITH n AS (SELECT *, row_number() {W} AS n FROM events), l AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN n END) OVER (PARTITION BY user_id) AS last FROM n)
SELECT event_id, user_id, event_type FROM l WHERE last IS NULL OR n <= last""")
def drop_tail(spark, sf_dir):
    return series.drop_tail(_t(spark, sf_dir, "events"), F.col("event_type") == "purchase", KEY, ORDER).select("event_id", "user_id", "event_type")


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL AND value >= 5 AND event_id % 7 <> 0")
def drop_missing(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    made = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("value") < 5, F.lit(float("inf"))).otherwise(F.col("value"))
    return series.drop_missing(rows.withColumn("value", made), ["value", "absent"]).select("event_id", "value")


@query(f"WITH n AS (SELECT *, row_number() {W} - 1 AS n FROM events) SELECT event_id, user_id FROM n WHERE n % 300 = 0")
def systematic_sample(spark, sf_dir):
    return series.every(_t(spark, sf_dir, "events"), 300, KEY, ORDER).select("event_id", "user_id")


@query(f"WITH n AS (SELECT *, row_number() {W} AS n FROM events) SELECT event_id, user_id FROM n WHERE n <= 5")
def row_limit(spark, sf_dir):
    return series.first_rows(_t(spark, sf_dir, "events"), 5, KEY, ORDER).select("event_id", "user_id")


@query("""WITH b AS (SELECT *, coalesce((ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id))::INT, 0) AS back FROM events),
e AS (SELECT *, sum(back) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM b),
l AS (SELECT *, max(epoch) OVER (PARTITION BY user_id) AS last FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS k FROM l WHERE epoch = last)
SELECT event_id, user_id, ts FROM k WHERE k = 1""")
def dedupe_epoch(spark, sf_dir):
    return series.last_epoch(_t(spark, sf_dir, "events"), "ts", KEY, ["event_id"]).select("event_id", "user_id", "ts")


@query("SELECT event_id, user_id, round(sum(coalesce(value, 0) / 3600) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS total FROM events")
def running_total(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "user_id", F.round(series.running_total(F.col("value"), KEY, ORDER), 6).alias("total"))


@query(f"""WITH s AS (SELECT *, coalesce(least(greatest(epoch(ts) - epoch(lag(ts) {W}), 0), 10), 0) AS step FROM events)
SELECT event_id, user_id, round(sum(coalesce(value, 0) * step / 3600) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS used FROM s""")
def dt_integral(spark, sf_dir):
    rows = series.with_steps(_t(spark, sf_dir, "events"), "ts", KEY, ORDER)
    return rows.select("event_id", "user_id", F.round(series.integral(F.col("value"), "ts", KEY, ORDER), 6).alias("used"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 6) AS smooth FROM events")
def rolling_centre_mean(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.round(series.centred_mean("value", KEY, ORDER), 6).alias("smooth"))


@query(f"""WITH {_LEGS}, i AS (SELECT *, row_number() {W} - 1 AS i FROM legs),
r AS (SELECT user_id, leg_idx, min(event_type) AS event_type, min(i) AS a, max(i) AS b, count(*) AS n FROM i GROUP BY user_id, leg_idx),
k AS (SELECT *, sum(CASE WHEN leg_idx = 0 OR n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY leg_idx ROWS UNBOUNDED PRECEDING) AS g FROM r),
l AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id, g ORDER BY leg_idx) AS label FROM k),
d AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY user_id ORDER BY leg_idx) OR leg_idx = 0 THEN 1 ELSE 0 END AS new FROM l),
u AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY leg_idx ROWS UNBOUNDED PRECEDING) - 1 AS run FROM d)
SELECT user_id, run::BIGINT AS run, min(label) AS event_type, min(a)::INT AS "first", max(b)::INT AS "last", sum(n)::BIGINT AS n FROM u GROUP BY user_id, run""")
def merge_short_runs(spark, sf_dir):
    out = series.merged_runs(_t(spark, sf_dir, "events"), "event_type", KEY, ORDER, F.col("n") >= 2)
    return out.withColumn("run", F.col("run").cast("long"))


@query("""SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (value > 50) AS first_match, arg_max(event_id, (ts, event_id)) FILTER (value > 50) AS last_match FROM events GROUP BY user_id""")
def first_last_match(spark, sf_dir):
    first, last = series.first_last("event_id", ORDER, F.col("value") > 50)
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(first.alias("first_match"), last.alias("last_match"))


@query(f"""SELECT user_id, list_sum(list_transform(list(value ORDER BY ts, event_id), lambda x: floor(x)::BIGINT % 7))::BIGINT AS folded FROM events GROUP BY user_id""")
def generic_fold(spark, sf_dir):
    v = F.floor("value") % 7
    return stats.folded(_t(spark, sf_dir, "events"), v, KEY, ORDER, 0, lambda a, x: a + x)


@query("""SELECT l_suppkey, min(l_quantity) AS "l_quantity.min", max(l_quantity) AS "l_quantity.max", round(avg(l_quantity), 6) AS "l_quantity.average", max(l_discount) AS "l_discount.max" FROM lineitem GROUP BY l_suppkey""")
def aggregate_wide(spark, sf_dir):
    spec = {"l_quantity": ["min", "max", "average"], "l_discount": ["max"]}
    out = stats.segment_stats(_t(spark, sf_dir, "lineitem"), spec, ["l_suppkey"], F.struct("l_orderkey", "l_linenumber"))
    return out.withColumn("l_quantity.average", F.round(F.col("`l_quantity.average`"), 6))


@query("""WITH q AS (SELECT *, row_number() OVER (ORDER BY user_id, ts, event_id) AS rid FROM events WHERE event_type = 'error'),
p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT q.event_id, q.user_id, p.ts AS last_ts, p.value AS last_value FROM q ASOF LEFT JOIN p ON q.user_id = p.user_id AND q.ts >= p.ts""")
def asof_previous(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    bought = rows.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    found = joins.as_of(rows.where("event_type = 'error'").select("event_id", "user_id", "ts"), bought, KEY, "ts", ["ts", "value"])
    return found.select("event_id", "user_id", "last_ts", "last_value")


@query("""WITH s AS (SELECT user_id, ts AS a, min(event_id) AS seg FROM events WHERE event_type = 'signup' GROUP BY ALL),
t AS (SELECT *, a + INTERVAL 1 HOUR AS own, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS nxt FROM s),
g AS (SELECT user_id, seg, a, least(own, coalesce(nxt, own)) AS b FROM t)
SELECT e.event_id, coalesce(g.seg, -1) AS seg FROM events e LEFT JOIN g ON e.user_id = g.user_id AND e.ts >= g.a AND e.ts < g.b""")
def interval_join(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    own = rows.where("event_type = 'signup'").groupBy("user_id", F.col("ts").alias("a")).agg(F.min("event_id").alias("seg"))
    hour = F.col("a") + F.expr("INTERVAL 1 HOUR")
    own = own.withColumn("b", F.least(hour, F.coalesce(F.lead("a").over(Window.partitionBy("user_id").orderBy("a")), hour)))
    return joins.in_intervals(rows, own, KEY, "ts", "a", "b", ["seg"]).select("event_id", F.coalesce("seg", F.lit(-1)).alias("seg"))


@query("""WITH n AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, lag(o_orderkey) OVER w AS lk, lag(o_orderpriority) OVER w AS lp, lead(o_orderkey) OVER w AS nk, lead(o_orderstatus) OVER w AS ns, o_orderpriority FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, CASE WHEN lp = o_orderstatus THEN lk END AS previous, CASE WHEN ns = o_orderpriority THEN nk END AS following FROM n""")
def prev_next_continuity(spark, sf_dir):
    return joins.continuity(_t(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], "o_orderpriority", "o_orderstatus", ["o_custkey"]).select("o_orderkey", "previous", "following")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (SELECT o_custkey FROM orders)")
def semi_member(spark, sf_dir):
    own = _t(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return own.join(_t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_mktsegment = 'BUILDING'")
def anti_missing(spark, sf_dir):
    placed = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing(_t(spark, sf_dir, "customer"), placed, ["c_custkey"], F.col("c_mktsegment") == "BUILDING").select("c_custkey")


@query("""SELECT s_suppkey AS k, 'here' AS side FROM supplier WHERE s_suppkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
SELECT DISTINCT o_custkey, 'there' FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def sync_difference(spark, sf_dir):
    here = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    there = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return joins.missing(here, there, ["k"]).withColumn("side", F.lit("here")).unionByName(joins.missing(there, here, ["k"]).withColumn("side", F.lit("there")))


@query("""SELECT o_orderkey, 'new' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, NULL FROM orders WHERE o_orderkey % 5 <> 0""")
def upsert_union(spark, sf_dir):
    old = _t(spark, sf_dir, "orders")
    new = old.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"), "o_totalprice")
    return joins.upsert(old.select("o_orderkey", "o_orderstatus"), new, ["o_orderkey"])


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0""")
def add_absent(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders")
    return joins.add_absent(rows.where("o_orderstatus = 'O'").select("o_orderkey"), rows.where("o_orderkey % 3 = 0").select("o_orderkey"), ["o_orderkey"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12")
def topk_pending(spark, sf_dir):
    return _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(12).select("o_orderkey", "o_orderdate")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, 0 AS is_total FROM lineitem GROUP BY ALL UNION ALL
SELECT l_returnflag, NULL, sum(l_quantity), 1 FROM lineitem GROUP BY ALL""")
def group_subtotals(spark, sf_dir):
    return flights.subtotals(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_linestatus"], ["l_quantity"])


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def month_buckets(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY ALL")
def ratio_of_sums(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(stats.ratio("l_extendedprice", "l_quantity"), 4).alias("price"))


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS discount FROM lineitem GROUP BY ALL")
def weighted_mean(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(stats.weighted_mean("l_discount", "l_quantity"), 6).alias("discount"))


@query("""WITH v AS (SELECT user_id, avg(value * sin(radians(event_id % 360))) AS e, avg(value * cos(radians(event_id % 360))) AS n FROM events GROUP BY user_id)
SELECT user_id, round(sqrt(e * e + n * n), 4) AS speed, round((degrees(atan2(e, n)) + 360) % 360, 4) AS direction FROM v""")
def vector_mean(spark, sf_dir):
    wind = geo.mean_wind(F.col("value"), F.col("event_id") % 360)
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(wind.alias("w")).select("user_id", F.round("w.speed", 4).alias("speed"), F.round("w.direction", 4).alias("direction"))


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentile95(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"))


_SELF = "(event_id * 37 % 120 - 60)::DOUBLE AS lat, (event_id * 53 % 300 - 150)::DOUBLE AS lon, (event_id * 29 % 120 - 60)::DOUBLE AS lat2, (event_id * 71 % 300 - 150)::DOUBLE AS lon2"


def _points(spark, sf_dir):
    at = lambda k, m, half: (F.col("event_id") * k % m - half).cast("double")
    return _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", at(37, 120, 60).alias("lat"), at(53, 300, 150).alias("lon"), at(29, 120, 60).alias("lat2"), at(71, 300, 150).alias("lon2"))


def _sql_distance(a: str, b: str, c: str, d: str) -> str:
    h = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"(2 * {geo.RADIUS_NM!r} * asin(sqrt(CASE WHEN {h} > 1 THEN 1.0 ELSE {h} END)))"


@query(f"""WITH p AS (SELECT event_id, {_SELF} FROM events) SELECT event_id, round({_sql_distance("lat", "lon", "lat2", "lon2")}, 4) AS nm,
 round((degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360) % 360, 4) % 360 AS bearing FROM p""")
def distances(spark, sf_dir):
    args = [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
    return _points(spark, sf_dir).select("event_id", F.round(geo.distance_nm(*args), 4).alias("nm"), F.pmod(F.round(geo.bearing(*args), 4), F.lit(360.0)).alias("bearing"))


@query(f"""WITH p AS (SELECT event_id, user_id, ts, {_SELF} FROM events), s AS (SELECT *, coalesce({_sql_distance(f"lag(lat) {W}", f"lag(lon) {W}", "lat", "lon")}, 0) AS d FROM p)
SELECT event_id, round(sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS distance FROM s""")
def cumulative_distance(spark, sf_dir):
    rows = series.distance_run(_points(spark, sf_dir), "lat", "lon", KEY, ORDER)
    return rows.select("event_id", F.round("distance", 2).alias("distance"))


@query("""SELECT event_id, round(CASE WHEN a > 180 THEN value * sin(radians(360 - a)) ELSE value * sin(radians(a)) END, 6) + 0.0 AS cross,
 round(-value * cos(radians(CASE WHEN a > 180 THEN 360 - a ELSE a END)), 6) + 0.0 AS along FROM (SELECT event_id, value, abs(event_id % 360 - user_id * 20 % 360) AS a FROM events)""")
def wind_components(spark, sf_dir):
    args = F.col("value"), F.col("event_id") % 360, F.col("user_id") * 20 % 360
    return _t(spark, sf_dir, "events").select("event_id", F.round(geo.crosswind(*args), 6).alias("cross"), F.round(geo.wind_along(*args), 6).alias("along"))


@query("""SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_discount * 100, l_tax * 100) AS top, least(l_quantity, l_discount * 100, l_tax * 100) AS low,
 CASE greatest(l_quantity, l_discount * 100, l_tax * 100) WHEN l_quantity THEN '1' WHEN l_discount * 100 THEN '2' ELSE '3' END AS hottest FROM lineitem""")
def row_extremes(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumns({"a": F.col("l_quantity"), "b": F.col("l_discount") * 100, "c": F.col("l_tax") * 100})
    top, low, index = phase.hottest(["a", "b", "c"])
    return rows.select("l_orderkey", "l_linenumber", top.alias("top"), low.alias("low"), index.alias("hottest"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events""")
def decoded_properties(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


#: Orders as flights: the airports are A to D, some are unknown.
_FLIGHTS = """f AS (SELECT o_orderkey AS log_id, 'log_' || (o_orderkey % 100 + 100)::VARCHAR || '_' || o_orderkey || '.csv' AS log_file_name, o_custkey AS system_id, o_orderdate AS start_time,
 CASE WHEN o_orderkey % 13 > 0 THEN chr((65 + o_orderkey % 4)::INT) END AS start_icao, CASE WHEN o_orderkey % 17 > 0 THEN chr((65 + o_orderkey // 3 % 4)::INT) END AS end_icao,
 o_totalprice / 1000 AS distance, o_totalprice / 100000 AS hours, o_totalprice / 20000 AS fuel_used, (60 + o_orderkey % 30)::DOUBLE AS fuel_from, (60 + o_orderkey % 30)::DOUBLE - o_totalprice / 20000 AS fuel_to,
 (o_orderkey % 97 * 100)::DOUBLE AS altitude, (o_orderkey % 7)::DOUBLE AS added, o_orderstatus AS status FROM orders)"""


def _flights(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return _t(spark, sf_dir, "orders").select(
        k.alias("log_id"), F.concat(F.lit("log_"), (k % 100 + 100).cast("string"), F.lit("_"), k.cast("string"), F.lit(".csv")).alias("log_file_name"), F.col("o_custkey").alias("system_id"), F.col("o_orderdate").alias("start_time"),
        F.when(k % 13 > 0, F.char(65 + k % 4)).alias("start_icao"), F.when(k % 17 > 0, F.char(65 + F.expr("o_orderkey div 3") % 4)).alias("end_icao"),
        (price / 1000).alias("distance"), (price / 100000).alias("hours"), (price / 20000).alias("fuel_used"), (60 + k % 30).cast("double").alias("fuel_from"), ((60 + k % 30).cast("double") - price / 20000).alias("fuel_to"),
        (k % 97 * 100).cast("double").alias("altitude"), (k % 7).cast("double").alias("added"), F.col("o_orderstatus").alias("status"),
    )


@query(f"""WITH {_FLIGHTS}, l AS (SELECT *, lag(start_time) OVER (PARTITION BY system_id ORDER BY start_time, log_id) AS p FROM f WHERE start_icao <> end_icao)
SELECT start_icao AS airport, system_id, sum(start_time::DATE - p::DATE)::BIGINT AS nights, count(*) AS visits FROM l WHERE p IS NOT NULL GROUP BY ALL""")
def nights_by_place(spark, sf_dir):
    rows = _flights(spark, sf_dir)
    return flights.nights(rows, ["system_id"], order=["log_id"])


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, CASE WHEN list_contains(list(role), 'system') THEN 'guided' ELSE 'Direct / other' END AS label FROM conversations GROUP BY conv_id""")
def rule_labels(spark, sf_dir):
    roles = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    label = corridor.classified(F.col("roles"), [{"label": "guided", "all_of": ["system"]}])
    return roles.select("conv_id", F.array_join("roles", ",").alias("roles"), label.alias("label"))


@query("""SELECT l_suppkey, l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS q, round(avg(l_tax), 6) AS x FROM lineitem GROUP BY ALL""")
def option_means(spark, sf_dir):
    out = corridor.option_rows(_t(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_quantity", "l_tax"])
    return out.select("l_suppkey", "l_returnflag", "n", F.round("l_quantity", 6).alias("q"), F.round("l_tax", 6).alias("x"))


@query(f"""WITH RECURSIVE r AS (SELECT event_id, user_id, value, row_number() {W} AS n FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::VARCHAR AS now, false AS changed, 0::BIGINT AS back, 0::BIGINT AS held FROM events
 UNION ALL
 SELECT user_id, n, now, changed, least(reach, n - 1), CASE WHEN changed THEN 1 ELSE reach END FROM
 (SELECT *, coalesce(now <> before, false) AS changed FROM
  (SELECT s.user_id, r.n, s.now AS before, least(s.held + 1, 20) AS reach,
    CASE WHEN least(s.held + 1, 20) < 15 THEN coalesce(s.now, 'Ground') WHEN r.value > 35 THEN
     CASE WHEN r.value - f.value > 50 THEN 'Climb' WHEN r.value - f.value < -50 THEN 'Descent' ELSE 'Cruise' END ELSE 'Ground' END AS now
   FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1 JOIN r f ON f.user_id = s.user_id AND f.n = s.n + 2 - least(s.held + 1, 20)))),
c AS (SELECT * FROM s WHERE changed),
b AS (SELECT r.event_id, arg_max(c.now, c.n) AS now FROM r JOIN c ON c.user_id = r.user_id AND r.n < c.n AND r.n >= c.n - c.back GROUP BY r.event_id)
SELECT r.event_id, r.user_id, coalesce(b.now, s.now) AS phase FROM r JOIN s USING (user_id, n) LEFT JOIN b ON b.event_id = r.event_id""")
def flight_phases(spark, sf_dir):
    rows = phase.with_phase(_t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "value", "value", KEY, ORDER)
    return rows.select("event_id", "user_id", "phase")


@query("""WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderstatus AS departs,
 CASE o_orderpriority[1] WHEN '1' THEN 'O' WHEN '2' THEN 'F' ELSE 'P' END AS arrives FROM orders),
s AS (SELECT DISTINCT k, 0::BIGINT AS n, NULL::BIGINT AS id, 0 AS trip, 0 AS following, NULL::VARCHAR AS departed, NULL::VARCHAR AS arrived FROM o
 UNION ALL
 SELECT k, n, id, trip, CASE WHEN home THEN trip + 1 ELSE trip END, CASE WHEN NOT home THEN departs END, CASE WHEN NOT home THEN arrives END FROM
 (SELECT k, n, id, departs, arrives, home, following + CASE WHEN departed = 'O' AND arrived = 'O' AND NOT home AND departs <> arrives THEN 1 ELSE 0 END AS trip FROM
  (SELECT o.k, o.n, o.o_orderkey AS id, o.departs, o.arrives, s.following, s.departed, s.arrived, s.departed IS NOT NULL AND o.arrives = 'O' AS home FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1)))
SELECT id AS o_orderkey, k AS system_id, trip AS trip_idx FROM s WHERE id IS NOT NULL""")
def trip_segments(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("system_id"), F.col("o_orderdate").alias("start_time"), F.col("o_orderstatus").alias("start_icao"), F.substring("o_orderpriority", 1, 1).alias("end_icao"))
    rows = rows.withColumn("end_icao", F.when(F.col("end_icao") == "1", "O").when(F.col("end_icao") == "2", "F").otherwise("P"))
    return flights.trips(rows, "O", order=["o_orderkey"]).select("o_orderkey", "system_id", "trip_idx")


@query("""SELECT page_id, len(regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>'))::BIGINT AS n_rows FROM pages""")
def page_tables(spark, sf_dir):
    from skyloom.sources.plans import table_cells

    pages = _t(spark, sf_dir, "pages")
    found = table_cells(pages, "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))


@query("""SELECT o_orderkey, (o_orderkey % 24)::VARCHAR || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS token, (o_orderkey % 24 * 3600 + o_orderkey % 60 * 60)::BIGINT AS seconds FROM orders""")
def parsed_durations(spark, sf_dir):
    token = F.concat((F.col("o_orderkey") % 24).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", token.alias("token"), text.seconds(token).alias("seconds"))


_ENDS = """(event_id * 37 % 60)::DOUBLE + 0.05 * (user_id % 3) AS first_lat, (event_id * 53 % 300 - 150)::DOUBLE AS first_lon, (event_id * 37 % 60)::DOUBLE AS last_lat, (event_id * 53 % 300 - 150)::DOUBLE + 0.02 * (user_id % 5) AS last_lon"""


def _matches_sql(dated: str) -> str:
    return f"""WITH l AS (SELECT event_id AS log_id, ts::DATE AS day, {_ENDS} FROM events),
p AS (SELECT log_id AS plan_id, CASE WHEN {dated} THEN day END AS day, last_lat AS from_lat, first_lon AS from_lon, first_lat AS to_lat, last_lon AS to_lon FROM l),
d AS (SELECT p.plan_id, l.log_id, {_sql_distance("first_lat", "first_lon", "from_lat", "from_lon")} AS a, {_sql_distance("last_lat", "last_lon", "to_lat", "to_lon")} AS b
 FROM p JOIN l ON abs(l.first_lat - p.from_lat) < 1 AND abs(l.first_lon - p.from_lon) < 1 AND (p.day IS NULL OR p.day = l.day)),
r AS (SELECT plan_id, log_id, round(a, 6) AS start_nm, round(b, 6) AS end_nm, row_number() OVER (PARTITION BY plan_id ORDER BY round(a + b, 6), log_id)::INT AS rank, count(*) OVER (PARTITION BY plan_id) AS n FROM d WHERE a <= 12 AND b <= 12)
SELECT * FROM r WHERE rank <= 5"""


def _ends(spark, sf_dir) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    lat, lon = (k * 37 % 60).cast("double"), (k * 53 % 300 - 150).cast("double")
    return _t(spark, sf_dir, "events").select(
        k.alias("log_id"), F.to_date("ts").alias("day"), (lat + 0.05 * (u % 3)).alias("first_lat"), lon.alias("first_lon"), lat.alias("last_lat"), (lon + 0.02 * (u % 5)).alias("last_lon")
    )


def _ranked_matches(logs: DataFrame, dated) -> DataFrame:
    """The first five matches of every log, taken as a plan that begins where it ended, and how many there are."""
    plans = logs.select(
        F.col("log_id").alias("plan_id"), F.when(dated, F.col("day")).alias("day"),
        F.col("last_lat").alias("from_lat"), F.col("first_lon").alias("from_lon"), F.col("first_lat").alias("to_lat"), F.col("last_lon").alias("to_lon"),
    )
    found = joins.first_log_matches(plans, logs, 5)
    return found.select("plan_id", "log_id", F.round("start_nm", 6).alias("start_nm"), F.round("end_nm", 6).alias("end_nm"), "rank", "n")


@query(_matches_sql("log_id % 2 = 0"))
def plan_log_matches(spark, sf_dir):
    """Every log as a plan, half of the plans without a day, which meet all logs."""
    return _ranked_matches(_ends(spark, sf_dir), F.col("log_id") % 2 == 0)


@query(_matches_sql("log_id % 3 <> 0"))
def plan_log_matches_all(spark, sf_dir):
    """The same with a third of the plans without a day."""
    return _ranked_matches(_ends(spark, sf_dir), F.col("log_id") % 3 != 0)


@query("""WITH p AS (SELECT event_id, (event_id * 37 % 170 - 85)::DOUBLE AS lat, (event_id * 53 % 350 - 175)::DOUBLE AS lon FROM events),
s AS (SELECT s_suppkey, (s_suppkey * 7 % 60)::DOUBLE + 0.25 AS slat, (s_suppkey * 11 % 90)::DOUBLE + 0.5 AS slon FROM supplier)
SELECT event_id, arg_min(s_suppkey, ((lat - slat) * (lat - slat) + (lon - slon) * (lon - slon), s_suppkey)) AS s_suppkey FROM p, s GROUP BY event_id""")
def nearest_airport(spark, sf_dir):
    k, s = F.col("event_id"), F.col("s_suppkey")
    points = _t(spark, sf_dir, "events").select(k, (k * 37 % 170 - 85).cast("double").alias("lat"), (k * 53 % 350 - 175).cast("double").alias("lon"))
    places = _t(spark, sf_dir, "supplier").select(s, ((s * 7 % 60).cast("double") + 0.25).alias("lat"), ((s * 11 % 90).cast("double") + 0.5).alias("lon"))
    return joins.nearest_of_all(points, places, "lat", "lon", ["event_id"], "s_suppkey").select("event_id", "s_suppkey")


@query("""SELECT event_id, round(value * 0.3048, 6) AS metres, round((value - 32) / 1.8, 6) AS celsius, round(value * 1.852, 6) AS kph FROM events""")
def display_units(spark, sf_dir):
    v = F.col("value")
    shown = {"metres": ("ft", "m"), "celsius": ("degF", "degC"), "kph": ("kt", "kph")}
    rows = units.displayed(_t(spark, sf_dir, "events").select("event_id", *[v.alias(c) for c in shown]), shown)
    return rows.select("event_id", *[F.round(c, 6).alias(c) for c in shown])
