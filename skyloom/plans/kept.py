"""Registered queries over streams, kept tables, clusters, trip tables and plan pages, all made from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.operators import clusters, flights
from skyloom.plans.catalogue import _FLIGHTS, KEY, _flights, _sql_distance, _t, query
from skyloom.plans.recorder import _TRACK, _r, _track
from skyloom.session import shared_folder
from skyloom.sources import keyed, plans
from skyloom.streaming import streams


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with positions of which some are missing."""
    kind = _t(spark, sf_dir, "events").schema
    k = F.col("event_id")
    # A stream's source is a folder: of a table that is one file the folder that it lies in.
    read = spark.readStream.schema(kind)
    read = read.parquet(f"{sf_dir}/events.parquet") if keyed.is_folder(spark, f"{sf_dir}/events.parquet") else read.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = read.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", "user_id", "ts", "event_type", "value", F.when(k % 7 > 0, 50 + k % 90 * 0.01).alias("lat"), F.when(k % 11 > 0, k % 70 * 0.02).alias("lon"))


def _ended(stream) -> None:
    stream.awaitTermination()


O = "OVER (PARTITION BY user_id ORDER BY event_id)"  # noqa: E741
E = "OVER (PARTITION BY user_id, epoch ORDER BY event_id)"
UP = "OVER (PARTITION BY user_id, epoch ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH b AS (SELECT *, CASE WHEN event_id % 7 > 0 THEN 50 + event_id % 90 * 0.01::DOUBLE END AS lat, CASE WHEN event_id % 11 > 0 THEN event_id % 70 * 0.02::DOUBLE END AS lon, coalesce((ts < lag(ts) {O})::INT, 0) AS back, coalesce(ts = lag(ts) {O}, false) AS twice FROM events),
e AS (SELECT *, sum(back) {O} AS epoch FROM b), k AS (SELECT *, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN {{'lat': lat, 'lon': lon}} END AS fix FROM e WHERE NOT twice),
s AS (SELECT *, coalesce(value * CASE WHEN epoch(ts) - epoch(lag(ts) {E}) > 10 THEN 10 ELSE epoch(ts) - epoch(lag(ts) {E}) END / 3600, 0) AS step, last_value(fix IGNORE NULLS) {UP} AS before FROM k),
d AS (SELECT *, coalesce({_sql_distance("before.lat", "before.lon", "lat", "lon")}, 0) AS nm FROM s)
SELECT event_id, user_id, epoch::INT AS epoch, round(sum(nm) {E}, 4) AS distance, round(sum(step) {E}, 6) AS used FROM d""")
def stream_parsed(spark, sf_dir):
    """Parsing with its state carried from batch to batch, written and read again."""
    folder = _folder(spark)
    found = streams.parsed(_events(spark, sf_dir), "user_id", "event_id", "ts", "lat", "lon", "value")
    _ended(found.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").format("parquet").option("path", f"{folder}/rows").start())
    return spark.read.parquet(f"{folder}/rows").select("event_id", "user_id", "epoch", F.round("distance", 4).alias("distance"), F.round("used", 6).alias("used"))


@query("""SELECT user_id, to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS start, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS average FROM events GROUP BY ALL""")
def stream_intervals(spark, sf_dir):
    folder = _folder(spark)
    found = streams.interval_stats(_events(spark, sf_dir), "ts", "value", KEY, 3600)
    _ended(streams.keep(found, f"{folder}/rows", ["user_id", "start"], f"{folder}/checkpoint"))
    rows = keyed.opened(spark, f"{folder}/rows").table()
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "count", "min", "max", F.round("average", 6).alias("average"))


@query("""WITH g AS (SELECT user_id, ts, coalesce((epoch(ts) - epoch(lag(ts) OVER w) >= 1800)::INT, 0) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS spell FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS "end", count(*) AS n FROM s GROUP BY user_id, spell""")
def stream_sessions(spark, sf_dir):
    folder = _folder(spark)
    found = streams.sessions(_events(spark, sf_dir), "ts", KEY, "30 minutes")
    write = lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows")
    _ended(found.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).start())
    return spark.read.parquet(f"{folder}/rows").select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


@query(f"""WITH c AS (SELECT *, (row_number() {O} = 1 OR event_type IS DISTINCT FROM lag(event_type) {O})::INT AS new FROM events), s AS (SELECT *, sum(new) {O} - 1 AS segment FROM c)
SELECT user_id, segment::BIGINT AS segment, min(event_type) AS value, arg_min(ts, event_id)::TIMESTAMP AS start, arg_max(ts, event_id)::TIMESTAMP AS "end", count(*) AS n FROM s GROUP BY user_id, segment""")
def stream_segments(spark, sf_dir):
    folder = _folder(spark)
    found = streams.segments(_events(spark, sf_dir), "user_id", "event_id", "ts", "event_type")
    _ended(streams.keep(found, f"{folder}/rows", ["user_id", "segment"], f"{folder}/checkpoint"))
    return keyed.opened(spark, f"{folder}/rows").table().select("user_id", "segment", "value", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


@query("""SELECT lpad(user_id::VARCHAR, 6, '0') AS log, count(*) AS n, count(value) AS valued, round(sum(value), 4) AS total, min(ts)::TIMESTAMP AS first, max(ts)::TIMESTAMP AS last FROM events GROUP BY 1""")
def stream_catalogue(spark, sf_dir):
    """The catalogue of partial aggregates by a text key that looks like a number."""
    folder = _folder(spark)
    rows = _events(spark, sf_dir).select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("log"), "event_id", "value", "ts")
    spec = keyed.partials(n=("count", "event_id"), valued=("count", "value"), total=("sum", "value"), first=("min", "ts"), last=("max", "ts"))
    _ended(streams.refresh(rows, f"{folder}/rows", "log", f"{folder}/checkpoint", spec))
    own = keyed.opened(spark, f"{folder}/rows").table()
    return own.select("log", "n", "valued", F.round("total", 4).alias("total"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")])


@query("""WITH k AS (SELECT '00' || o_custkey AS log, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey % 4 > 0),
n AS (SELECT '00' || o_custkey AS log, -o_orderkey AS o_orderkey, 'new' AS o_orderstatus FROM orders WHERE o_custkey % 5 = 0)
SELECT * FROM (SELECT * FROM k WHERE log NOT IN (SELECT log FROM n) UNION ALL SELECT * FROM n) WHERE log NOT LIKE '%7'""")
def keyed_store(spark, sf_dir):
    """Rows kept by a text key: stored, replaced for some keys, removed for others, compacted and read."""
    path = f"{_folder(spark)}/rows"
    rows = _t(spark, sf_dir, "orders").withColumn("log", F.concat(F.lit("00"), F.col("o_custkey").cast("string")))
    own = keyed.KeyedTable(spark, path, "log", buckets=16)
    own.replace(rows.where("o_orderkey % 3 > 0 AND o_custkey % 4 > 0").select("log", "o_orderkey", "o_orderstatus"))
    own.replace(rows.where("o_custkey % 5 = 0").select("log", (-F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("o_orderstatus")))
    own.delete(rows.where(F.col("log").endswith("7")).select("log"))
    own.compact()
    own.vacuum()
    return keyed.opened(spark, path).table()


_LINES = "i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS line, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


def _lines(spark, sf_dir):
    """The line items, numbered within their order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    return _t(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(w).cast("long"))


_GAP = "sqrt(list_sum(list_transform(list_zip(xs[a + 1], xs[b + 1]), lambda z: pow(z[1] - z[2], 2))) / 4)"


@query(f"""WITH RECURSIVE {_LINES},
p AS (SELECT l_orderkey AS way, list([l_extendedprice / 3000, l_quantity + l_extendedprice / 100000, l_extendedprice / 7000 - l_quantity, l_discount * 100 + l_extendedprice / 90000] ORDER BY line) AS xs, list(line ORDER BY line) AS ids FROM i GROUP BY l_orderkey),
r AS (SELECT way, xs, ids, list_transform(range(len(ids)), lambda i: [i]) AS cl, 0 AS step FROM p
 UNION ALL SELECT way, xs, ids, list_filter(list_transform(range(len(cl)), lambda k: CASE WHEN k = best.i THEN list_concat(cl[best.i + 1], cl[best.j + 1]) WHEN k = best.j THEN NULL ELSE cl[k + 1] END), lambda c: c IS NOT NULL), step + 1 FROM
 (SELECT *, list_min(flatten(list_transform(range(len(cl)), lambda i: list_transform(range(i + 1, len(cl)), lambda j: {{'d': list_max(flatten(list_transform(cl[i + 1], lambda a: list_transform(cl[j + 1], lambda b: {_GAP})))), 'i': i, 'j': j}})))) AS best FROM r) WHERE best.d <= 12),
last AS (SELECT way, ids, arg_max(cl, step) AS cl FROM r GROUP BY way, ids),
c AS (SELECT way, ids, unnest(cl) AS members FROM last), n AS (SELECT *, row_number() OVER (PARTITION BY way ORDER BY len(members) DESC, list_min(members)) - 1 AS cluster FROM c)
SELECT l_orderkey, ids[m + 1] AS line, cluster::INT AS cluster FROM (SELECT way AS l_orderkey, ids, cluster, unnest(members) AS m FROM n)""")
def clustered_profiles(spark, sf_dir):
    """Complete linkage of each order's lines by four figures."""
    price, n = F.col("l_extendedprice"), F.col("l_quantity")
    offsets = F.array(price / 3000, n + price / 100000, price / 7000 - n, F.col("l_discount") * 100 + price / 90000)
    rows = _lines(spark, sf_dir).select("l_orderkey", "line", offsets.alias("offsets"))
    return clusters.clustered(rows, "l_orderkey", "line").select("l_orderkey", "line", "cluster")


@query(f"""WITH {_TRACK}, f AS (SELECT 'F' || s_suppkey AS fix, s_suppkey % 3 = 0 AS navaid, 49.5 + s_suppkey % 40 * 0.1::DOUBLE AS flat, -1.2 + s_suppkey % 17 * 0.1::DOUBLE AS flon FROM supplier),
d AS (SELECT user_id % 2 AS way, user_id % 5 AS cluster, user_id, fix, navaid, min({_sql_distance("lat", "lon", "flat", "flon")}) AS nm FROM t, f GROUP BY ALL)
SELECT way::INT AS way, cluster::INT AS cluster, fix, navaid, round(avg(nm), 4) AS mean FROM d GROUP BY ALL""")
def fix_approaches(spark, sf_dir):
    """How near the tracks of each cluster come to each fix."""
    u, s = F.col("user_id"), F.col("s_suppkey")
    tracks = _track(spark, sf_dir).select((u % 2).cast("int").alias("way"), (u % 5).cast("int").alias("cluster"), u.alias("flight"), "lat", "lon")
    ways = tracks.select("way").distinct()
    fixes = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("F"), s.cast("string")).alias("fix"), (s % 3 == 0).alias("navaid"), (49.5 + s % 40 * 0.1).alias("lat"), (-1.2 + s % 17 * 0.1).alias("lon"))
    fixes = fixes.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1)))).join(ways, "way", "left_semi")
    return clusters.fix_distances(tracks, fixes, "way").withColumn("mean", F.round("mean", 4))


#: Places that prices by 1,000, 20,000 and 100,000 have at most.
_PLACES = {"distance": 5, "hours": 7, "fuel_used": 7, "fuel_start": 7, "fuel_end": 7, "altitude": 0, "ground_speed": 6, "gph": 6, "nm_per_gallon": 6}
_SUMS = ", ".join(f"round({e}, {_PLACES[n]}) AS {n}" for n, e in {
    "fuel_start": "arg_min(fuel_from, (start_time, log_id))", "fuel_end": "arg_max(fuel_to, (start_time, log_id))", "distance": "sum(distance)", "hours": "sum(hours)", "fuel_used": "sum(fuel_used)", "altitude": "max(altitude)",
    "ground_speed": "sum(distance) / nullif(sum(hours), 0)", "gph": "sum(fuel_used) / nullif(sum(hours), 0)", "nm_per_gallon": "sum(distance) / nullif(sum(fuel_used), 0)",
}.items())


@query(f"""WITH {_FLIGHTS}, y AS (SELECT *, year(start_time)::INT AS trip FROM f),
r AS (SELECT system_id, trip, log_id, 3 - (grouping(system_id) + grouping(trip) + grouping(log_id)) AS level, min(start_time)::TIMESTAMP AS oldest, max(start_time)::TIMESTAMP AS newest, count(*) AS n_flights, {_SUMS} FROM y GROUP BY ROLLUP (system_id, trip, log_id))
SELECT *, row_number() OVER (PARTITION BY level, CASE WHEN level > 1 THEN system_id END, CASE WHEN level > 2 THEN trip END ORDER BY newest DESC, system_id DESC, trip DESC, log_id DESC)::INT AS place FROM (SELECT * REPLACE (level::INT AS level) FROM r)""")
def trip_table(spark, sf_dir):
    """Flights, totals of each year as a trip, of each aircraft and of all, in the order of a table."""
    rows = _flights(spark, sf_dir).withColumn("trip", F.year("start_time"))
    out = flights.trip_table(rows, ["system_id", "trip"], "log_id", order=["log_id"])
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("oldest", "newest")]
    return out.select("system_id", "trip", "log_id", "level", "n_flights", "place", *times, *[F.round(c, k).alias(c) for c, k in _PLACES.items()])


def _coordinate(k):
    """A token such as N5120.5/W00033.5 of a line item."""
    two, three = (lambda c: F.lpad(c.cast("string"), 2, "0")), (lambda c: F.lpad(c.cast("string"), 3, "0"))
    return F.concat(F.lit("N"), two(k % 60), two(k * 7 % 60), F.lit(".5/W"), three(k % 170), two(k * 11 % 60), F.lit(".5"))


_POINTS = f"{_LINES}, k AS (SELECT *, l_orderkey * 7 + line AS k FROM i WHERE n >= 3)"
_PLACE = "round(k % 60 + (k * 7 % 60 + 0.5) / 60, 6) AS lat, round(-(k % 170 + (k * 11 % 60 + 0.5) / 60), 6) AS lon"


@query(f"""WITH {_POINTS} SELECT l_orderkey, line::INT AS seq, 'WP' || line AS name, {_PLACE}, CASE WHEN line % 2 = 0 THEN 'VOR' END AS navaid, 'L' || line AS airway, l_quantity * 100 AS altitude_ft, l_partkey::DOUBLE AS dist_leg, l_tax * 1000 AS fuel_rem, (line * 60)::BIGINT AS leg_time_s
FROM k""")
def plan_pages(spark, sf_dir):
    """Waypoints of pages with an alternate's table behind the first; each order is a page, its lines are waypoints."""
    k = F.col("l_orderkey") * 7 + F.col("line")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cell = lambda *c: F.concat(F.lit("<td>"), *c, F.lit("</td>"))
    line = F.col("line")
    row = F.concat(
        F.lit("<tr>"), cell(F.lit("WP"), text(line), F.lit(" "), _coordinate(k), F.when(line % 2 == 0, " VOR").otherwise("")), cell(F.lit("-")), cell(F.lit("L"), text(line), F.lit(" "), text((F.col("l_quantity") * 100).cast("long"))),
        *[cell(F.lit("-"))] * 3, cell(text(F.col("l_partkey"))), cell(F.format_string("%.3f", F.col("l_tax") * 1000)), *[cell(F.lit("&nbsp;"))] * 2, cell(F.lit("0:"), F.lpad(text(line), 2, "0")), cell(F.lit("-")), F.lit("</tr>"),
    )
    rows = _lines(spark, sf_dir).select("l_orderkey", F.struct(line.alias("at"), row.alias("row")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), "\n")
    page = F.concat(F.lit("<p>Plan</p><table><tr><td>ETE 1h05m</td></tr></table><TABLE class='x'>"), F.col("body"), F.lit("</TABLE><table>"), F.replace(F.col("body"), F.lit("WP"), F.lit("ALT")), F.lit("</table>"))
    pages = rows.groupBy("l_orderkey").agg(body.alias("body")).select("l_orderkey", page.alias("html"))
    found = plans.waypoints(pages, "l_orderkey", "html")
    return found.select("l_orderkey", "seq", "name", *_r("lat", "lon", places=6), "navaid", "airway", "altitude_ft", "dist_leg", "fuel_rem", "leg_time_s")


@query(f"""WITH {_POINTS} SELECT l_orderkey, line::INT AS seq, 'WP' || line AS name, {_PLACE}, CASE WHEN line % 2 = 0 THEN 'VOR' END AS navaid, 'L' || line AS airway, l_quantity * 100 AS altitude_ft, l_partkey::DOUBLE AS dist_leg, (line * 10)::DOUBLE AS wind_dir, l_quantity AS wind_speed,
 (line * 60)::BIGINT AS leg_time_s, CASE WHEN line % 2 = 0 THEN line::DOUBLE * 1000 END AS msa FROM k""")
def printed_plans(spark, sf_dir):
    """Waypoints of printed pages from their placed words; each order is a plan, its lines are waypoints of three printed lines."""
    text = lambda c: c.cast("string")

    def words(x, i):
        line = (i + 1).cast("long")
        word = lambda row, x0, c: F.struct(F.lit(1).alias("page"), (line * 40 + row * 9).cast("double").alias("top"), F.lit(float(x0)).alias("x0"), c.alias("text"))
        even = lambda c: F.when(line % 2 == 0, c)
        return F.array(
            word(0, 30, F.concat(F.lit("WP"), text(line))), word(0, 131, F.concat(F.lit("L"), text(line))), word(0, 270, text(x["l_partkey"])), word(0, 395, F.concat(F.lit("0:"), F.lpad(text(line), 2, "0"))), word(0, 460, F.lit("ETA")),
            word(1, 32, _coordinate(x["l_orderkey"] * 7 + line)), word(1, 140, text((x["l_quantity"] * 100).cast("long"))), word(1, 170, F.concat(text(line * 10), F.lit("/"), text(x["l_quantity"].cast("long")))),
            word(2, 33, even(F.lit("VOR"))), word(2, 135, even(text(line * 1000))),
        )

    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_orderkey", "l_quantity")))
    pages = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines")).select("l_orderkey", F.flatten(F.transform("lines", words)).alias("words"))
    found = plans.printed_plans(pages, "l_orderkey", "words")
    return found.select("l_orderkey", "seq", "name", *_r("lat", "lon", places=6), "navaid", "airway", "altitude_ft", "dist_leg", "wind_dir", "wind_speed", "leg_time_s", "msa")
