import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import fields, session
from skyloom.functions import geo
from skyloom.operators import catalog, corridor, flights, joins, stats
from skyloom.sources import avionics, logs, plans, store

LOG = (
    '#airframe_info,log_version="1.00",system_id="ABC"\n#yyy-mm-dd,hh:mm:ss,hh:mm,ident,kt,MHz,enum\nLcl Date, Lcl Time, UTCOfst, AtvWpt, IAS, COM1, New\n'
    '2021-06-23, 14:15:01, +01:00, "A, ""B""", 10.5, 118.1, x\n2021-06-23, 14:15:02, +01:00, , 11.5, 118.1, x\n2021-06-23, , +01:00, C, 11.5, 118.1, x\n'
    "2021-06-23, 14:15:03, +01:00, C, 12.5, 118.2, x\n2021-06-23, 14:15:04, +01:00, C, 13.5, 118.2, x\n"
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "data_log").mkdir()
    (tmp_path / "data_log" / "log_210623_141501_TEST.csv").write_text(LOG)
    (tmp_path / "notes.txt").write_text("not a log\n")
    (tmp_path / "rpt_1.csv").write_bytes("Report\nSystem ID,Aircraft Identifier,Airframe Name\n\"000AB12\",N1,Caf\u00e9\nx\n".encode("mac_roman"))
    (tmp_path / "rpt_2.csv").write_text("Report\nSystem ID\n1\n")
    (tmp_path / "sys_AB12.json").write_text('{"info": {"a": "b"},\n "aircraftIdentifier": "N1", "airframeName": "C", "systemId": "AB12"}')
    return str(tmp_path)


def test_quoted_cells_units_and_kinds(spark, folder):
    rows = logs.samples(spark, folder, ["AtvWpt", "IAS", "COM1", "Absent"]).orderBy("ts").collect()
    assert [(r.AtvWpt, r.IAS, r.COM1, r.Absent) for r in rows] == [('A, "B"', 10.5, "118.1", None), ("", 11.5, "118.1", None), ("C", 12.5, "118.2", None), ("C", 13.5, "118.2", None)]
    assert rows[0].ts == datetime.datetime(2021, 6, 23, 13, 15, 1)
    kinds = {r.field: (r.unit, r.kind) for r in logs.columns(logs.lines(spark, folder)).collect()}
    assert kinds["Lcl Date"][1] == "ignored" and kinds["AtvWpt"] == ("ident", "name") and kinds["IAS"] == ("kt", "number") and kinds["COM1"] == ("MHz", "name") and kinds["New"] == ("enum", "name")
    assert logs.samples(spark, folder, ["IAS"], every=2).count() == 2 and logs.samples(spark, folder, ["IAS"], most_lines=5).count() == 2
    assert {(r.name, r.kind) for r in logs.listed(spark, folder).collect()} == {("log_210623_141501_TEST.csv", "log"), ("rpt_1.csv", "report"), ("rpt_2.csv", "report"), ("sys_AB12.json", "system")}


def test_odd_lines(spark):
    lines = [",b", "a,", '"x,y",z', 'a"b,c', "", ' "q""r" , s ']
    found = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").orderBy("i").select(logs.cells(F.col("x")).alias("c")).collect()]
    assert found == [["", "b"], ["a", ""], ["x,y", "z"], ['a"b', "c"], [""], ['q"r', "s"]]


def test_avionics(spark, folder):
    found = avionics.reports(spark, f"{folder}/rpt_*.csv").collect()
    assert [(r.systemId, r.aircraftIdentifier, r.airframeName) for r in found] == [("AB12", "N1", "Caf\u00e9")]
    own = avionics.systems(spark, f"{folder}/sys_AB12.json").first()
    assert own.systemId == "AB12" and own.info == {"a": "b"}


def test_ends_of_logs_and_airport_tables(spark, tmp_path):
    rows = spark.createDataFrame([("p", 0, 1, None, 1.0), ("p", 1, 2, 1.0, 2.0), ("p", 2, 3, 3.0, 4.0), ("p", 3, 4, None, None)], "path string, row_idx int, ts int, Latitude double, Longitude double")
    found = logs.end_fixes(rows).first()
    assert (found.first.lat, found.first.ts, found.last.lon) == (1.0, 2, 4.0)
    (tmp_path / "a.csv").write_text("id,ident,type,name,latitude_deg,longitude_deg\n1,EGTF,small_airport,F,51.3,-0.5\n2,H,heliport,H,1,1\n")
    (tmp_path / "r.csv").write_text("id,airport_ident,length_ft,width_ft,surface,lighted,closed\n1,EGTF,2500,60,ASP,1,0\n2,H,50,50,X,0,0\n")
    places = logs.airports(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in logs.runways(spark, str(tmp_path / "r.csv"), places).collect()] == [("EGTF", 2500.0, 60.0, "ASP", True, False)]


PAGE = """<h1>EGTF - LFAT N12345 (Jun 07, 2026)</h1><p>Route</p><p>EGTF DCT LFAT</p>
<table><tr><td>ETE  1h05m</td><td>Distance  101.5 NM</td><td>Avg TAS  150 kt</td><td>Altitude  5,500 ft</td><td>Avg Wind  264/18</td></tr></table>
<table><tr><td>Taxi</td><td>1.5</td><td>-</td></tr><tr><td>Destination  LFAT</td><td>12.0</td><td>1:05</td></tr><tr><td>Nothing</td><td>9</td></tr></table>
<table><tr><th>Name</th></tr>
<tr><td>EGTF N5120.9/W00033.5</td><td></td><td>120</td><td>-</td><td></td><td></td><td></td><td>50.0</td><td>-</td><td></td><td></td><td>0:00</td></tr>
<tr><td>-TOC- N5115.0/W00010.0</td><td></td><td>L9 5500 2.1</td><td>-5 264/018 +13/-2</td><td>120 118</td><td>150 145</td><td>20 80</td><td>45.5</td><td>4.5</td><td>15.0</td><td>0:10 0:55</td><td>0:10</td></tr>
<tr><td>LYD N5059.9/E00052.7 LYD</td><td></td><td>- --</td><td></td><td></td><td></td><td></td><td></td><td></td><td></td><td></td><td>0:30:30</td></tr></table>"""


def test_a_plan_page(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None)], "plan_id int, html string")
    way = plans.waypoints(pages, "plan_id", "html").orderBy("seq").collect()
    assert [(w.name, w.is_pseudo, w.navaid, w.eta_elapsed_s) for w in way] == [("EGTF", False, None, 0), ("-TOC-", True, None, 600), ("LYD", False, "LYD", 1830)]
    top = way[1]
    assert (top.airway, top.altitude_ft, top.msa, top.wind_comp_raw, top.wind_dir, top.wind_speed, top.oat, top.isa_dev) == ("L9", 5500, 2.1, "-5", 264, 18, 13, -2)
    assert (top.mag_hdg, top.crs, top.tas, top.gs, top.dist_leg, top.dist_rem, top.fuel_rem, top.fuel_used, top.flow, top.leg_time_s, top.ete_remaining_s) == (120, 118, 150, 145, 20, 80, 45.5, 4.5, 15, 600, 3300)
    assert (way[0].altitude_ft, way[0].airway, way[2].altitude_ft) == (120, None, None) and abs(way[2].lon - 0.878333) < 1e-6
    head = {r.plan_id: r for r in plans.summaries(pages, "plan_id", "html").collect()}
    h = head[1]
    assert (h.departure, h.destination, h.aircraft, h.date, h.route) == ("EGTF", "LFAT", "N12345", datetime.date(2026, 6, 7), "EGTF DCT LFAT")
    assert (h.ete_total_s, h.dist_total_nm, h.avg_tas, h.cruise_alt_ft, h.avg_wind) == (3900, 101.5, 150, 5500, "264/18") and head[2].date is None
    assert {(r.label, r.gal, r.time_s) for r in plans.fuel_plan(pages, "plan_id", "html").collect()} == {("Taxi", 1.5, None), ("Destination", 12.0, 3900)}


def test_placed_words_become_rows(spark):
    words = spark.createDataFrame([(1, 100.0, 10.0, "EGTF"), (1, 100.2, 60.0, "12"), (1, 100.4, 55.0, "+"), (1, 130.0, 12.0, "LYD")], "page int, top double, x0 double, text string")
    found = plans.words_to_rows(words, ["page"], {"name": (0, 50), "wind": (51, 90)}).orderBy("line").collect()
    assert [(r.name, r.wind) for r in found] == [("EGTF", "+ 12"), ("LYD", "")]


def test_field_dictionary(spark, tmp_path):
    assert fields.order("WptDst") == 35 and fields.order("What") == 9999 and fields.unit("OAT") == "degC" and fields.kind("COM1", "MHz") == "name" and fields.kind("What", "hh:mm") == "ignored"
    assert [fields.metric(f) for f in ("AltMSL", "FQtyT", "IAS", "Latitude", "E1 CHT3")] == ["max", "end", "average", "start", "max"]
    assert fields.united(["IAS", "What"], ["AtvWpt", "IAS"]) == ["AtvWpt", "IAS", "What"] and fields.dictionary(spark).count() == len(fields.FIELDS)
    assert catalog.field_columns(spark.createDataFrame([(1, 2, 3, 4)], "What int, IAS int, AtvWpt int, leg int"), ["leg"], {f: v[0] for f, v in fields.FIELDS.items()}) == ["AtvWpt", "IAS", "What"]
    (tmp_path / "d.csv").write_text("field,order,unit,description,unit_description,type\nIAS,11,kt,,,value\nX,,kt,,,value\n")
    assert [(r.field, r.order) for r in fields.imported(spark, str(tmp_path / "d.csv")).collect()] == [("IAS", 11)]
    assert fields.SUMMARY_FIELDS["GpH"] == "E1 FFlow" and len(fields.STORED_VALUES) == 31 and len(fields.STORED_NAMES) == 5


def test_interval_store_replaces_logs_and_guards_its_version(spark, tmp_path):
    start = datetime.datetime(2021, 1, 1)
    rows = spark.createDataFrame([(n, start + datetime.timedelta(seconds=s), float(s), "on" if s > 90 else "off") for n in ("a", "b") for s in range(0, 180, 10)], "LogFileName string, ts timestamp, Distance double, AfcsOn string")
    path = str(tmp_path / "s")
    own = store.Aggregates(spark, path)
    own.upsert(rows)
    own.upsert(rows)
    assert own.table().groupBy("LogFileName").count().orderBy("LogFileName").collect()[1]["count"] == 3
    found = own.table().where("LogFileName = 'a'").orderBy("Date").collect()
    assert [(r["Distance.total"], r["AfcsOn.mostFrequent"]) for r in found] == [(50.0, "off"), (50.0, "off"), (50.0, "on")]
    own.upsert(rows.where("LogFileName = 'b'"), spark.createDataFrame([("b", start + datetime.timedelta(seconds=65))], "LogFileName string, start timestamp"))
    assert own.table().where("LogFileName = 'b'").count() == 2
    own.remove(["a", "nobody"])
    assert {r.LogFileName for r in own.table().collect()} == {"b"}
    with pytest.raises(ValueError):
        store.Aggregates(spark, path, seconds=30)
    made = []
    for _ in range(2):
        store.cached(spark, str(tmp_path / "c"), "v1", lambda: made.append(1) or rows)
    assert len(made) == 1
    store.export_csv(rows, str(tmp_path / "csv"), ["LogFileName", "Distance"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["LogFileName", "Distance"]


def test_times_are_told_in_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        frame = spark.sql("SELECT timestamp_seconds(0) AS at, 1 AS x")
        assert store.as_text(frame, "at").first()["at"] == "1970-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_places_near_the_poles_and_the_date_line(spark):
    rng = np.random.default_rng(4)
    lats = np.concatenate([rng.uniform(-90, 90, 400), 90 - rng.exponential(0.3, 300), rng.exponential(0.3, 100) - 90])
    lons = np.concatenate([rng.uniform(-180, 180, 600), 180 - rng.exponential(0.1, 100), rng.exponential(0.1, 100) - 180])
    places = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lats, lons, strict=True))]
    points = [(i, float(np.clip(a + x, -90, 90)), float((b + y + 180) % 360 - 180)) for (i, a, b), x, y in zip(places, rng.normal(0, 0.05, 800), rng.normal(0, 0.3, 800), strict=True)]
    at, near = spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(places, "place int, lat double, lon double")
    found = {r.id: r.place for r in joins.nearest_within(at, near, "lat", "lon", ["id"], "place", 12.0).collect()}
    x, y = np.radians(lats), np.radians(lons)
    for i, a, b in points:
        a, b = np.radians(a), np.radians(b)
        h = np.sin((x - a) / 2) ** 2 + np.cos(x) * np.cos(a) * np.sin((y - b) / 2) ** 2
        d = 2 * geo.RADIUS_NM * np.arcsin(np.sqrt(np.minimum(h, 1)))
        assert found[i] == (int(d.argmin()) if d.min() <= 12 else None)
    day = datetime.date(2021, 1, 1)
    ends = spark.createDataFrame([(i, day, a, b, a, b) for i, a, b in places], "plan_id int, day date, from_lat double, from_lon double, to_lat double, to_lon double")
    own = spark.createDataFrame([(i, day, a, b, a, b) for i, a, b in points], "log_id int, day date, first_lat double, first_lon double, last_lat double, last_lon double")
    best = {r.log_id: r.n for r in joins.log_matches(ends, own).groupBy("log_id").agg(F.count("*").alias("n")).collect()}
    for i, a, b in points:
        a, b = np.radians(a), np.radians(b)
        d = 2 * geo.RADIUS_NM * np.arcsin(np.sqrt(np.minimum(np.sin((x - a) / 2) ** 2 + np.cos(x) * np.cos(a) * np.sin((y - b) / 2) ** 2, 1)))
        assert best.get(i, 0) == int((d <= 12).sum())


def test_inbound_corridor_flights_are_turned_round(spark):
    out = [("out", i, i * 60.0, 51.0 + i * 0.02, -0.5, 120.0, 3000.0, i * 0.1) for i in range(60)]
    back = [("in", i, i * 60.0, 52.18 - i * 0.02, -0.5, 120.0, 5000.0, i * 0.1) for i in range(60)]
    away = [("away", i, i * 60.0, 40.0, -0.5, 120.0, 3000.0, 0.0) for i in range(60)]
    rows = spark.createDataFrame(out + back + away, "log string, row_idx int, elapsed double, lat double, lon double, tas double, alt double, fuel_burn double")
    cut = corridor.corridor_segments(rows, (51.0, -0.5), (51.6, -0.5), "log", "row_idx")
    found = {r.log: r for r in corridor.segment_figures(cut, ["log", "direction"]).collect()}
    assert set(found) == {"out", "in"} and found["in"].direction == "in" and abs(found["in"].track_nm - 36.02) < 0.05 and found["in"].time_s == 1800.0
    assert cut.where("log = 'in'").orderBy("step").first().lat == 51.0 and abs(found["out"].still_air_s - found["out"].track_nm / 120 * 3600) < 1e-6


def test_blanks_are_no_names_and_modes_go_to_who_was_first(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(["", "x", "y", "y", "x", ""])], "k string, i int, v string")
    found = stats.wide(rows, {"Missing": ("max",)}, {"v": ("start", "end", "mostFrequent"), "Gone": ("end",)}, ["k"], ["i"], {"made": 1}).first()
    assert (found["v.start"], found["v.end"], found["v.mostFrequent"], found["Missing.max"], found["Gone.end"], found["made"]) == ("x", "x", "y", None, None, 1)


def test_selected_files_without_a_date(spark):
    files = spark.createDataFrame([("log_210623_141501_A.csv",), ("odd.csv",)], "name string")
    assert catalog.import_list(files, "name", "latest", imported=files.limit(0)).count() == 2
    assert [r.name for r in catalog.import_list(files, "name", "selected", chosen=["odd.csv"]).collect()] == ["odd.csv"]
    assert spark.range(1).select(catalog.without_quotes(F.lit('"A"')).alias("x")).first().x == "A"
    assert catalog.of_aircraft(spark.createDataFrame([("",), ("A",)], "system_id string"), ["", "A"]).count() == 1


def test_flights_of_no_aircraft_have_no_trip(spark):
    rows = spark.createDataFrame([(None, 1, "B", "X"), ("p", 1, "B", "X")], "system_id string, start_time int, start_icao string, end_icao string")
    assert {(r.system_id, r.trip_idx) for r in flights.trips(rows, "B").collect()} == {(None, None), ("p", 0)}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "here"}.get(key, default)

    fake = lambda master: type("S", (), {"conf": Conf(), "sparkContext": type("C", (), {"master": master})()})()
    assert session.shared_folder(fake("local[2]")) == "here"
    with pytest.raises(ValueError):
        session.shared_folder(fake("spark://host:7077"))
