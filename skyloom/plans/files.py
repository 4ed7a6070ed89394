"""Registered queries that write files made from the test tables and read them again through the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom import fields
from skyloom.functions import text
from skyloom.operators import catalog, series
from skyloom.plans.catalogue import KEY, ORDER, W, _t, query
from skyloom.session import shared_folder
from skyloom.sources import avionics, logs, logscan, store


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


HEADER = '#airframe_info, log_version="1.00", system_id="{}"\n#yyyy-mm-dd, hh:mm:ss, hh:mm, degrees, degrees, kt, ident\n  Lcl Date, Lcl Time, UTCOfst, Latitude, Longitude, IAS, AtvWpt\n'


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a recorder log of each user: a row a second, of which some have no position and some repeat a second."""
    i = F.col("i")
    rows = series.numbered(_t(spark, sf_dir, "events"), KEY, ORDER, "i")
    second = i - F.when(i % 10 == 9, 1).otherwise(0)
    at = F.timestamp_seconds(F.lit(1_600_000_000) + second)
    blank = lambda c: F.when(i % 7 == 0, F.lit("")).otherwise(c.cast("string"))
    line = F.concat_ws(",", F.date_format(at, "yyyy-MM-dd"), F.date_format(at, " HH:mm:ss"), F.lit(" +00:00"), blank(50 + i % 90 * 0.5), blank(i % 70 * 0.25), F.coalesce(F.col("value").cast("string"), F.lit("  ")), F.concat(F.lit('"'), "event_type", F.lit(', x"')))
    logs_ = rows.select("user_id", F.struct("i", line.alias("line")).alias("l")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("body"))
    u = F.lpad(F.col("user_id").cast("string"), 6, "0")
    head = F.replace(F.lit(HEADER), F.lit("{}"), u)
    folder = _folder(spark)
    store.export_files(logs_.select(F.concat(F.lit("log_200913_"), u, F.lit("_EGTF.csv")).alias("name"), F.concat(head, "body", F.lit("\n")).alias("text")), folder, "name", "text")
    return folder


def _user():
    return F.regexp_extract("path", r"log_200913_(\d{6})_EGTF", 1).cast("long").alias("user_id")


_LOGS = f"""i AS (SELECT *, row_number() {W} - 1 AS i FROM events), k AS (SELECT user_id, i, 1600000000 + i - CASE WHEN i % 10 = 9 THEN 1 ELSE 0 END AS s, CASE WHEN i % 7 > 0 THEN 50 + i % 90 * 0.5::DOUBLE END AS lat, CASE WHEN i % 7 > 0 THEN i % 70 * 0.25::DOUBLE END AS lon, value AS ias, event_type || ', x' AS wpt FROM i),
rows AS (SELECT * FROM k WHERE i % 10 <> 9)"""
_SAMPLES = f"WITH {_LOGS} SELECT user_id, s::BIGINT AS s, lat, lon, round(ias, 6) AS ias, wpt FROM rows"
_COLUMNS = ["Latitude", "Longitude", "IAS", "AtvWpt"]


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(_user(), F.unix_seconds("ts").alias("s"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"), F.round("IAS", 6).alias("ias"), F.col("AtvWpt").alias("wpt"))


@query(_SAMPLES)
def log_samples(spark, sf_dir):
    """Logs written and read by lines."""
    return _shown(logs.samples(spark, _written(spark, sf_dir), _COLUMNS))


@query(_SAMPLES)
def log_scan(spark, sf_dir):
    """The same through the data source, in byte ranges."""
    return _shown(logscan.samples(spark, _written(spark, sf_dir), _COLUMNS, range=20_000))


@query(f"WITH {_LOGS} SELECT user_id, count(*) AS n, max(s)::BIGINT AS last FROM rows WHERE (i + 3) % 5 = 0 GROUP BY user_id")
def log_every_fifth_line(spark, sf_dir):
    rows = _shown(logscan.samples(spark, _written(spark, sf_dir), _COLUMNS, every=5))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("s").alias("last"))


@query(f"""WITH {_LOGS}, f AS (SELECT user_id, arg_min({{'s': s, 'lat': lat, 'lon': lon}}, i) AS a, arg_max({{'s': s, 'lat': lat, 'lon': lon}}, i) AS b FROM k WHERE lat IS NOT NULL GROUP BY user_id)
SELECT user_id, strftime(to_timestamp(a.s) AT TIME ZONE 'UTC', '%H:%M:%S') AS first_time, a.lat AS first_lat, a.lon AS first_lon, strftime(to_timestamp(b.s) AT TIME ZONE 'UTC', '%H:%M:%S') AS last_time, b.lat AS last_lat, b.lon AS last_lon FROM f""")
def log_ends(spark, sf_dir):
    """First and last positions from the head and the tail of each log alone."""
    found = logscan.peeked(spark, _written(spark, sf_dir), head=20, tail=2000)
    return found.select(_user(), *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("first", "last") for c in ("time", "lat", "lon")])


_KINDS = ("('Lcl Date', '#yyyy-mm-dd', 'ignored', 0), ('Lcl Time', 'hh:mm:ss', 'ignored', 1), ('UTCOfst', 'hh:mm', 'ignored', 2), ('Latitude', 'degrees', 'number', 3), ('Longitude', 'degrees', 'number', 4), ('IAS', 'kt', 'number', 5), ('AtvWpt', 'ident', 'name', 6)")


@query(f"SELECT user_id, position::INT AS position, field, unit, kind FROM (SELECT DISTINCT user_id FROM events), (VALUES {_KINDS}) AS k(field, unit, kind, position)")
def log_columns(spark, sf_dir):
    found = logs.columns(logs.lines(spark, _written(spark, sf_dir)))
    return found.select(_user(), "position", "field", "unit", "kind")


@query("""SELECT 'log_200913_' || lpad(user_id::VARCHAR, 6, '0') || '_EGTF.csv' AS name, 'log' AS kind, lpad(user_id::VARCHAR, 6, '0') AS system_id FROM (SELECT DISTINCT user_id FROM events)""")
def listed_logs(spark, sf_dir):
    folder = _written(spark, sf_dir)
    told = logs.metadata(logs.lines(spark, folder)).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("meta")["system_id"].alias("system_id"))
    return logs.listed(spark, folder).select("name", "kind").join(told, "name")


@query("""SELECT s_suppkey, 'N' || s_suppkey AS "aircraftIdentifier", 'Café ' || s_name AS "airframeName", ltrim(s_suppkey::VARCHAR, '0') AS "systemId" FROM supplier""")
def avionics_reports(spark, sf_dir):
    """Report files written and read; the zeros before a system's id go."""
    k = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("Report\nSystem ID,Aircraft Identifier,Airframe Name\n\"000"), k, F.lit('",N'), k, F.lit(",Cafe "), F.col("s_name"), F.lit("\nx\n"))
    folder = _folder(spark)
    store.export_files(_t(spark, sf_dir, "supplier").select(F.concat(F.lit("rpt_"), k, F.lit(".csv")).alias("name"), body.alias("text")), folder, "name", "text")
    rows = avionics.reports(spark, folder)
    name = F.replace("airframeName", F.lit("Cafe"), F.lit("Café")).alias("airframeName")
    return rows.select(F.regexp_extract("path", r"rpt_(\d+)\.csv", 1).cast("long").alias("s_suppkey"), "aircraftIdentifier", name, "systemId")


@query("""SELECT s_suppkey, 'N' || s_suppkey AS "aircraftIdentifier", s_name AS "airframeName", 'S' || s_suppkey AS "systemId", 'v' || s_nationkey AS version FROM supplier""")
def avionics_systems(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    body = F.to_json(F.struct(F.create_map(F.lit("version"), F.concat(F.lit("v"), F.col("s_nationkey").cast("string"))).alias("info"), F.concat(F.lit("N"), k).alias("aircraftIdentifier"), F.col("s_name").alias("airframeName"), F.concat(F.lit("S"), k).alias("systemId")))
    folder = _folder(spark)
    store.export_files(_t(spark, sf_dir, "supplier").select(F.concat(F.lit("sys_"), k, F.lit(".json")).alias("name"), body.alias("text")), folder, "name", "text")
    rows = avionics.systems(spark, folder)
    return rows.select(F.substring("systemId", 2, 20).cast("long").alias("s_suppkey"), "aircraftIdentifier", "airframeName", "systemId", F.col("info")["version"].alias("version"))


@query("""WITH r AS (SELECT lpad(user_id::VARCHAR, 6, '0') AS log, value, floor(epoch(ts) / 3600) * 3600 AS hour FROM events WHERE user_id % 5 > 0)
SELECT log, hour::BIGINT AS since, round(avg(value), 6) AS mean, round(max(value), 6) AS top FROM r GROUP BY ALL""")
def stored_aggregates(spark, sf_dir):
    """Interval aggregates stored, stored again, some removed, read."""
    path = _folder(spark)
    rows = _t(spark, sf_dir, "events").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("LogFileName"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("AltMSL"), F.col("value").alias("E1 RPM"))
    own = store.Aggregates(spark, path, seconds=3600)
    own.upsert(rows.where("CAST(LogFileName AS LONG) % 2 = 0"))
    own.upsert(rows.where("CAST(LogFileName AS LONG) % 3 <> 1 OR CAST(LogFileName AS LONG) % 2 = 1"))
    own.remove(rows.where("CAST(LogFileName AS LONG) % 5 = 0"))
    found = store.Aggregates(spark, path, seconds=3600).table()
    return found.select(F.col("LogFileName").alias("log"), F.unix_seconds(F.col("Date").cast("timestamp")).alias("since"), F.round("`AltMSL.average`", 6).alias("mean"), F.round("`E1 RPM.max`", 6).alias("top"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def exported_csv(spark, sf_dir):
    """A catalogue exported as CSV and read again, and a scan that is made once."""
    folder = _folder(spark)
    store.export_csv(_t(spark, sf_dir, "orders"), f"{folder}/csv", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    read = lambda: spark.read.option("header", True).schema("o_orderkey long, o_orderstatus string, o_totalprice double").csv(f"{folder}/csv")
    store.cached(spark, f"{folder}/cache", "orders 1", read)
    return store.cached(spark, f"{folder}/cache", "orders 1", lambda: read().limit(0))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 2 HOUR END AS told, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN o_totalprice END AS number, 'S' || o_custkey AS system_id FROM orders""")
def parsed_cells(spark, sf_dir):
    """Times assembled of date, time and offset cells, numbers or nulls, and ids without their quotes."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    date = F.when(k % 2 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    told = text.timestamp(F.when(k % 3 == 0, "").otherwise(date), F.date_format(d, " HH:mm:ss"), F.lit(" -02:00"))
    cell = F.when(k % 4 == 0, "--").when(k % 4 == 1, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).otherwise("NaN")
    return _t(spark, sf_dir, "orders").select("o_orderkey", told.cast("timestamp_ntz").alias("told"), text.number(cell).alias("number"), catalog.without_quotes(F.concat(F.lit('"S'), F.col("o_custkey").cast("string"), F.lit('"'))).alias("system_id"))


_ORDERED = ", ".join(f"('{f}', {v[0]}, '{v[1]}', '{v[2]}')" for f, v in sorted(fields.FIELDS.items(), key=lambda x: x[1][0]))


@query(f"SELECT l_suppkey, field, row_number() OVER (PARTITION BY l_suppkey ORDER BY o, field)::INT AS place, unit, kind FROM (SELECT DISTINCT l_suppkey FROM lineitem), (VALUES {_ORDERED}) AS f(field, o, unit, kind) WHERE o % 5 = l_suppkey % 5")
def fields_in_order(spark, sf_dir):
    """The fields of each supplier's table, a fifth of the dictionary, in its order."""
    from pyspark.sql import Window

    own = _t(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    rows = own.join(F.broadcast(fields.dictionary(spark)), F.col("order") % 5 == F.col("l_suppkey") % 5)
    return rows.select("l_suppkey", "field", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("order", "field")).alias("place"), "unit", "kind")
