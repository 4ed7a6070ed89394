import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import fuel, geo, text, units
from skyloom.operators import corridor, flights, joins, phase, series
from skyloom.plans import catalogue
from skyloom.sources import logs, plans, store
from skyloom.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_coordinates_and_angles(spark):
    found = one(spark, geo.coordinate(F.lit("N5120.9/W00033.5")))
    assert abs(found["lat"] - 51.348333) < 1e-6 and abs(found["lon"] + 0.558333) < 1e-6
    assert one(spark, geo.coordinate(F.lit("nowhere"))) is None
    assert one(spark, geo.angle_difference(F.lit(10.0), F.lit(350.0))) == 20.0
    assert one(spark, geo.angle_difference(F.lit(0.0), F.lit(180.0))) == 180.0
    assert abs(one(spark, geo.distance_nm(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 60.04) < 0.01
    assert one(spark, geo.distance_nm(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))) is None
    assert one(spark, geo.cross_track_nm(F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) < 0
    assert one(spark, geo.headwind(F.lit(10.0), F.lit(90.0), F.lit(90.0))) == 10.0
    assert one(spark, geo.wind_along(F.lit(10.0), F.lit(-270.0), F.lit(90.0))) == -10.0


def test_cells(spark):
    assert one(spark, text.seconds(F.lit("1:02:03"))) == 3723
    assert one(spark, text.seconds(F.lit("x"))) is None
    assert one(spark, text.number(F.lit(" -- "))) is None and one(spark, text.number(F.lit("NaN"))) is None
    assert one(spark, text.number(F.lit(" 4.5 "))) == 4.5
    assert one(spark, text.file_kind(F.lit("log_210623_141501_EGTF.csv"))) == "log"
    assert one(spark, text.file_time(F.lit("log_210623_141501_EGTF.csv"))) == datetime.datetime(2021, 6, 23, 14, 15, 1)
    assert one(spark, text.file_airport(F.lit("log_210623_141501_EGTF.csv"))) == "EGTF"
    at = one(spark, text.timestamp(F.lit("23/06/2021"), F.lit("14:15:01"), F.lit("+01:00")))
    assert at == datetime.datetime(2021, 6, 23, 13, 15, 1)


def test_fuel_is_capped_at_full_tanks_and_never_negative(spark):
    both = lambda v: fuel.tanks(F.lit(float(v)), F.lit(float(v)))
    out = fuel.analysed(spark.range(1), both(10), both(50), both(35), both(60), both(40), both(46), F.lit(17.0)).first()["analysis"]
    assert out["target"] == 70 and out["target_add"] == 50 and out["added_total"] == 92 and out["current_totalizer"] == 0
    assert round(out["target_endurance"]) == round(70 / 17 * 3600)


def samples(spark, speeds, alts=None):
    start = datetime.datetime(2021, 6, 23, 14)
    alts = alts or [0.0] * len(speeds)
    return spark.createDataFrame([("a", start + datetime.timedelta(seconds=i), s, h) for i, (s, h) in enumerate(zip(map(float, speeds), alts, strict=True))], "log string, ts timestamp, v double, h double")


def test_head_and_tail(spark):
    rows = samples(spark, [0.0, 1, 0, 1, 1, 1, 0, 1, 0])
    assert [r.v for r in series.drop_head(rows, F.col("v") > 0, ["log"], ["ts"], run=3).orderBy("ts").collect()] == [1, 0, 1, 0]
    assert series.drop_head(rows, F.col("v") > 5, ["log"], ["ts"]).count() == 0
    assert series.drop_tail(rows, F.col("v") > 5, ["log"], ["ts"]).count() == 9
    assert series.drop_tail(rows, F.col("v") > 0, ["log"], ["ts"]).count() == 8


def test_phases_by_the_rule_row_by_row(spark):
    speed = [0.0] * 30 + [100.0] * 120 + [0.0] * 30
    alt = [0.0] * 30 + [float(min(i, 60) * 20) if i < 80 else 1200.0 - (i - 80) * 20 for i in range(120)] + [400.0] * 30
    found = [r.phase for r in phase.with_phase(samples(spark, speed, alt), "v", "h", ["log"], ["ts"]).orderBy("ts").collect()]
    runs = [p for i, p in enumerate(found) if i == 0 or found[i - 1] != p]
    # The first fast row is level with the rows before it, which it relabels; the climb shows 15 rows later.
    assert runs[:4] == ["Ground", "Cruise", "Climb", "Cruise"] and runs[-1] == "Ground" and "Descent" in runs
    assert found == phases_row_by_row(speed, alt)
    assert phase.labels([], []) == []
    level = [5000.0] * 40
    level[25] = None
    assert set(phase.labels([100.0] * 40, level)[15:]) == {"Cruise"}
    rng = np.random.default_rng(2)
    for _ in range(30):
        s, a = rng.choice([0.0, 30.0, 50.0, 90.0], 120).tolist(), np.cumsum(rng.choice([-20.0, 0.0, 5.0, 30.0], 120)).tolist()
        for i in rng.integers(0, 120, 4):
            s[i], a[(i + 7) % 120] = None, None
        assert phase.labels(s, a) == phases_row_by_row(s, a)


def phases_row_by_row(speed, altitude):
    """The rule told plainly: buffers of at most 20 values, emptied but for the current one when the label changes."""
    out, buffer = [], []
    for t, (s, a) in enumerate(zip(speed, altitude, strict=True)):
        buffer = (buffer + [a])[-20:]
        before = out[-1] if out else None
        if len(buffer) < 15:
            new = before or "Ground"
        elif s is not None and s > 35:
            known = a is not None and buffer[0] is not None
            new = "Climb" if known and a > buffer[0] + 50 else "Descent" if known and a < buffer[0] - 50 else "Cruise"
        else:
            new = "Ground"
        if before is not None and new != before:
            for row in range(max(0, t - len(buffer)), t):
                out[row] = new
            buffer = [a]
        out.append(new)
    return out


def test_states_cross_batches_and_partitions(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
        found = {r.event_id: r.phase for r in phase.with_phase(rows, "value", "value", ["user_id"], ["ts", "event_id"]).collect()}
        for _, own in rows.toPandas().sort_values(["ts", "event_id"], kind="stable").groupby("user_id"):
            v = own["value"].tolist()
            assert [found[i] for i in own["event_id"]] == phases_row_by_row(v, v)
        orders = catalogue.queries()["trip_segments"](spark, sf_dir)
        told = {r.o_orderkey: r.trip_idx for r in orders.collect()}
        plain = spark.read.parquet(f"{sf_dir}/orders.parquet").toPandas().sort_values(["o_orderdate", "o_orderkey"])
        for _, own in plain.groupby("o_custkey"):
            trip, last = 0, None
            for r in own.itertuples():
                here = (r.o_orderstatus, {"1": "O", "2": "F"}.get(r.o_orderpriority[0], "P"))
                ends = last is not None and here[1] == "O"
                if last == ("O", "O") and here[0] != here[1] and not ends:
                    trip += 1
                assert told[r.o_orderkey] == trip
                trip, last = (trip + 1, None) if ends else (trip, here)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trips_of_hand(spark):
    legs = [("B", "X"), ("X", "B"), ("B", "B"), ("B", "B"), ("B", "B"), ("B", "Y"), ("Y", None), ("Y", "B")]
    rows = spark.createDataFrame([("p", i, a, b) for i, (a, b) in enumerate(legs)], "system_id string, start_time int, start_icao string, end_icao string")
    found = [r.trip_idx for r in flights.trips(rows, "B").orderBy("start_time").collect()]
    assert found == [0, 0, 1, 1, 2, 3, 3, 3]


def test_summary_types(spark):
    def log(name, power, gs, ias):
        start = datetime.datetime(2021, 1, 1)
        return [(name, start + datetime.timedelta(seconds=i), g, s, p, 40.0 - i, 40.0, i * 0.01, i * 0.02, 100.0, "W1" if i < 8 else "W2") for i, (p, g, s) in enumerate(zip(power, gs, ias, strict=True))]

    rows = log("fly", [1.0] * 15, [5.0] * 15, [0.0] * 4 + [60.0] * 8 + [0.0] * 3) + log("taxi", [1.0] * 15, [5.0] * 15, [0.0] * 15) + log("off", [0.0] * 15, [0.0] * 15, [0.0] * 15)
    frame = spark.createDataFrame(rows, "log_id string, ts timestamp, gs double, ias double, power double, fuel_left double, fuel_right double, totalizer double, distance double, alt double, waypoint string")
    found = {r.log_id: r for r in flights.measures(flights.summaries(frame)).collect()}
    assert {k: r.type for k, r in found.items()} == {"fly": "flight", "taxi": "ground", "off": "preflight"}
    assert found["fly"].route == ["W1", "W2"] and found["fly"].flying_start.second == 4


def test_nearest_place_and_abeam(spark):
    places = spark.createDataFrame([("EGTF", 51.348, -0.559), ("EGPN", 56.4525, -3.0258), ("KSAF", 35.617, -106.089), ("FAR", 0.0, 0.0)], "ident string, lat double, lon double")
    points = spark.createDataFrame([(1, 51.3504028, -0.5617803), (2, 56.4537125, -3.0180488), (3, 35.617, -106.089), (4, 80.0, 80.0)], "id int, lat double, lon double")
    found = {r.id: r.ident for r in joins.nearest_of_all(points, places, "lat", "lon", ["id"], "ident").collect()}
    assert found == {1: "EGTF", 2: "EGPN", 3: "KSAF", 4: "EGTF"}
    found = {r.id: r.ident for r in joins.nearest_within(points, places, "lat", "lon", ["id"], "ident").collect()}
    assert found == {1: "EGTF", 2: "EGPN", 3: "KSAF", 4: None}
    track = spark.createDataFrame([("a", i, 0.0, i / 10, 50.0 - i, float(i * 60)) for i in range(11)], "log string, row_idx int, lat double, lon double, fuel double, elapsed double")
    plan = spark.createDataFrame([("a", 0, "P", 0.01, 0.0, 50.0, 0.0), ("a", 1, "Q", 0.01, 0.52, 46.0, 280.0)], "log string, seq int, name string, lat double, lon double, fuel double, elapsed double")
    found = corridor.reconcile(plan, track, ["log"]).orderBy("seq").collect()
    assert [r.row_idx for r in found] == [0, 5] and found[1].fuel_delta == -1.0 and abs(found[0].leg_flown_nm - 30.02) < 0.01


def test_complete_linkage_against_brute_force():
    rng = np.random.default_rng(1)
    x = [rng.normal(c, 1, 9) for c in (0, 0, 0, 40, 40, -40)]
    assert corridor.complete_linkage(x, 12.0) == [0, 0, 0, 1, 1, 2]
    assert corridor.complete_linkage([], 12.0) == []
    for n in range(2, 14):
        own = [rng.normal(0, 8, 9).round(1) for _ in range(n)]
        groups = [[i] for i in range(n)]
        while len(groups) > 1:
            d, a, b = min((max(float(np.sqrt(((own[i] - own[j]) ** 2).mean())) for i in g for j in h), k, m) for k, g in enumerate(groups) for m, h in enumerate(groups) if k < m)
            if d > 12.0:
                break
            groups[a] += groups.pop(b)
        groups.sort(key=lambda g: -len(g))
        assert corridor.complete_linkage(own, 12.0) == [next(k for k, g in enumerate(groups) if i in g) for i in range(n)]


def test_log_reader(spark, tmp_path):
    (tmp_path / "log_210623_141501_TEST.csv").write_text(
        '#airframe_info,log_version="1.00",system_id="ABC"\n#yyyy-mm-dd,hh:mm:ss,hh:mm,ident,kt\nLcl Date, Lcl Time, UTCOfst, AtvWpt, IAS\n'
        "2021-06-23, 14:15:01, +01:00, EGTF, 10.5\n2021-06-23, 14:15:01, +01:00, EGTF, 11.5\n2021-06-23, 14:15:02, +01:00, , bad\n2021-06-23, 14:15:03, +01:00, X\n"
    )
    rows = logs.samples(spark, str(tmp_path), ["AtvWpt", "IAS", "Absent"]).orderBy("ts").collect()
    assert [(r.AtvWpt, r.IAS, r.Absent) for r in rows] == [("EGTF", 10.5, None), ("", None, None)]
    assert logs.metadata(logs.lines(spark, str(tmp_path))).first()["meta"]["system_id"] == "ABC"


def test_html_tables(spark):
    page = spark.createDataFrame([(1, "<table><tr><th>A</th><td> b&nbsp;<b>c</b></td></tr></table>"), (2, None)], "id int, html string")
    assert [r.cells for r in plans.table_cells(page, "id", "html").collect()] == [["A", "b c"]]


def test_replacing_twice_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "log string, v int")
    path = str(tmp_path / "store")
    for _ in range(2):
        store.replace_by_key(rows, path, "log")
    store.replace_by_key(rows.where("log = 'a'").withColumn("v", F.lit(9)), path, "log")
    assert sorted((r.log, r.v) for r in store.stored(spark, path).collect()) == [("a", 9), ("b", 2)]


def test_streaming_agrees_with_batch(spark, sf_dir, tmp_path):
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    kind.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(kind.schema).parquet(str(tmp_path / "in"))
    out = streams.interval_stats(source, "ts", "value", ["user_id"], 3600).writeStream.outputMode("complete").format("memory").queryName("interval_stats").trigger(availableNow=True).start()
    out.awaitTermination()
    batch = kind.groupBy(F.window("ts", "3600 seconds"), "user_id").agg(F.count("value").alias("n"))
    assert spark.table("interval_stats").count() == batch.count()


def test_units(spark):
    assert abs(one(spark, units.converted(F.lit(212.0), "degF", "degC")) - 100) < 1e-9
    assert one(spark, units.converted(F.lit(None).cast("double"), "ft", "m")) is None
    with pytest.raises(ValueError):
        units.converted(F.lit(1.0), "ft", "kt")


def test_plans_find_their_logs(spark):
    day = datetime.date(2021, 6, 23)
    plans = spark.createDataFrame([(1, day, 51.0, 179.95, 52.0, 1.0), (2, datetime.date(2020, 1, 1), 51.0, 179.95, 52.0, 1.0), (3, day, None, None, None, None)], "plan_id int, day date, from_lat double, from_lon double, to_lat double, to_lon double")
    logs = spark.createDataFrame([("a", day, 51.0, -179.95, 52.0, 1.0), ("b", None, 51.0, 179.95, 52.0, 1.0), ("c", day, 51.0, 179.95, 53.0, 1.0)], "log_id string, day date, first_lat double, first_lon double, last_lat double, last_lon double")
    found = [(r.plan_id, r.log_id, r["rank"]) for r in joins.log_matches(plans, logs).orderBy("plan_id", "rank").collect()]
    assert found == [(1, "a", 1), (2, "b", 1), (2, "a", 2)]


def test_clusters_are_named_after_their_own_fix(spark):
    tracks = spark.createDataFrame([("N", c, f"flight {c}", i / 10, float(c)) for c in (0, 1) for i in range(5)] + [("S", 0, "x", 0.0, 0.0)], "way string, cluster int, flight string, lat double, lon double")
    fixes = spark.createDataFrame([("N", "OBSCURE", False, 0.2, 0.0), ("N", "VOR", True, 0.2, 0.05), ("N", "BETWEEN", True, 0.2, 0.5), ("N", "EAST", False, 0.2, 1.0), ("S", "FAR", True, 5.0, 5.0)], "way string, fix string, navaid boolean, lat double, lon double")
    found = {(r.way, r.cluster): r.label for r in corridor.labelled(corridor.fix_distances(tracks, fixes, "way"), "way").collect()}
    assert found == {("N", 0): "VOR", ("N", 1): "EAST", ("S", 0): "Group 1"}


def test_nearest_place_has_no_range_limit(spark):
    rng = np.random.default_rng(7)
    places = [(f"P{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-60, 20, 60), rng.uniform(-170, 30, 60), strict=True))] + [("NONE", None, 1.0)]
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300), strict=True))] + [(900, None, 0.0)]
    at, near = spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(places, "ident string, lat double, lon double")
    found = {r.id: r.ident for r in joins.nearest_of_all(at, near, "lat", "lon", ["id"], "ident").collect()}
    expected = {i: min(((a - x) ** 2 + (b - y) ** 2, p) for p, x, y in places[:-1])[1] for i, a, b in points[:-1]}
    assert found == expected | {900: None}
    assert {r.ident for r in joins.nearest_of_all(at, near.limit(0), "lat", "lon", ["id"], "ident").collect()} == {None}


def test_plans_without_a_day_meet_all_logs(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.to_date("ts").alias("day")).toPandas()
    k, u, day = (events[c].to_numpy() for c in ("event_id", "user_id", "day"))
    lat, lon = (k * 37 % 60).astype(float), (k * 53 % 300 - 150).astype(float)
    first, last = (lat + 0.05 * (u % 3), lon), (lat, lon + 0.02 * (u % 5))

    def nm(a, b):
        x, y, z, w = (np.radians(v) for v in (*a, *b))
        h = np.sin((z - x) / 2) ** 2 + np.cos(x) * np.cos(z) * np.sin((w - y) / 2) ** 2
        return 2 * geo.RADIUS_NM * np.arcsin(np.sqrt(np.minimum(h, 1)))

    expected = {}
    for i in range(len(k)):
        start, end = nm(first, (last[0][i], first[1][i])), nm(last, (first[0][i], last[1][i]))
        ok = (start <= 12) & (end <= 12) & ((day == day[i]) | (k[i] % 3 == 0))
        at = sorted((round(float(start[j] + end[j]), 6), int(k[j])) for j in np.flatnonzero(ok))
        expected[int(k[i])] = (len(at), [j for _, j in at[:5]])
    found = {}
    for r in catalogue.queries()["plan_log_matches_all"](spark, sf_dir).orderBy("plan_id", "rank").collect():
        found.setdefault(r.plan_id, (r.n, []))[1].append(r.log_id)
        assert r.start_nm <= 12 and r.end_nm <= 12 and r["rank"] == len(found[r.plan_id][1])
    assert found == expected
    assert max(n for i, (n, _) in found.items() if i % 3 == 0) > max(n for i, (n, _) in found.items() if i % 3)
    assert np.mean([n > 1 for i, (n, _) in found.items() if i % 3 == 0]) > 0.9
