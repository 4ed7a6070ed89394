import datetime as dt

from pyspark.sql import functions as F

from skyloom import fields
from skyloom.functions import spans
from skyloom.operators import derived, flights, phase, stats
from skyloom.sources import logs

NAN = float("nan")


def test_calculations_run_where_their_inputs_are(spark):
    rows = spark.createDataFrame([("a", 1, 10.0, 20.0), ("a", 2, NAN, 5.0), ("a", 3, None, 5.0)], "k string, i int, FQtyL double, FQtyR double")
    out = derived.derived(rows, ["k"], ["i"])
    assert out.columns == ["k", "i", "FQtyL", "FQtyR", "FQtyT"]
    assert [r.FQtyT for r in out.orderBy("i").collect()] == [30.0, None, None]


def test_own_calculations_read_earlier_outputs(spark):
    rows = spark.createDataFrame([("a", 1, 3600.0), ("a", 2, None), ("a", 3, 7200.0)], "k string, i int, flow double")
    own = [derived.of_series(["flow"], "used", lambda flow, key, order: derived.running_total(flow, key, order)), derived.of_row(["used"], ["left"], lambda used: [10 - used])]
    assert [r.left for r in derived.derived(rows, ["k"], ["i"], own).orderBy("i").collect()] == [9.0, 9.0, 7.0]


def test_phase_is_the_state_machine(spark):
    n = 60
    speed, altitude = [60.0] * n, [100.0 + 5 * max(i - 30, 0) for i in range(n)]
    rows = spark.createDataFrame([("a", i, speed[i], altitude[i]) for i in range(n)], "k string, i int, IAS double, AltMSL double")
    assert [r.FltPhase for r in derived.derived(rows, ["k"], ["i"]).orderBy("i").collect()] == phase.labels(speed, altitude)


def test_rolled_keeps_nulls_and_starts_short(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), ("b", 1, 9.0)], "k string, i int, v double")
    out = derived.rolled(rows, ["v"], 2, ["k"], ["i"], "held", lambda v: v)
    assert [r.held for r in out.orderBy("k", "i").collect()] == [[1.0], [1.0, None], [None, 3.0], [9.0]]


def test_legs_from_takeoff(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("a", t(i), n) for i, n in enumerate(["x", "x", "y", "y", "x", None, None])] + [("b", t(0), "x"), ("c", t(0), "x")], "k string, ts timestamp, n string")
    takeoff = spark.createDataFrame([("a", t(1)), ("b", None)], "k string, takeoff timestamp")
    found = flights.flown_legs(rows, ["n"], ["k"], ["ts"], "ts", takeoff).orderBy("leg_idx").collect()
    assert [(r.k, r.leg_idx, r.n, r.start.second, r.end.second) for r in found] == [("a", 0, "x", 1, 2), ("a", 1, "y", 2, 4), ("a", 2, "x", 4, 5), ("a", 3, None, 5, 6)]
    assert flights.flown_legs(rows, ["n"], ["k"], ["ts"], "ts").where("k <> 'a'").count() == 2
    assert flights.flown_legs(rows.limit(0), ["n"], ["k"], ["ts"], "ts", takeoff).count() == 0


def test_time_ranges(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = spark.createDataFrame([(t(1, 10), t(3)), (t(2), t(2)), (None, t(3))], "a timestamp, b timestamp")
    own = spans.span(F.col("a"), F.col("b"))
    found = rows.select(own.alias("s"), F.transform(spans.schedule(own, 3600), lambda m: F.hour(m)).alias("hours"), spans.elapsed_s(own).alias("e")).collect()
    assert [(r.hours, r.e) for r in found] == [([1, 2, 3], 6600.0), ([2], 0.0), (None, None)]
    assert found[2].s is None


def test_interval_extras_of_missing_values(spark):
    rows = spark.createDataFrame([(1, 1, NAN, 1.0, NAN, True), (1, 2, 4.0, 3.0, 1.0, None), (1, 3, 4.0, None, 1.0, False), (2, 1, None, None, None, None)], "k int, i int, v double, l double, r double, on boolean")
    found = stats.interval_extras("v", F.col("i"), F.col("l"), F.col("r"), F.col("on"))
    out = rows.groupBy("k").agg(*[c.alias(n) for n, c in found.items()]).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(1, 4.0, 2, 2, 2.0, False), (2, None, None, None, None, None)]


def test_frames_by_kind(spark):
    rows = spark.createDataFrame([(1, 2.0, NAN, "W", 50.0, NAN, "x"), (2, 3.0, 4.0, None, 50.0, 1.0, "x")], "i int, FQtyL double, FQtyR double, AtvWpt string, Latitude double, Longitude double, other string")
    numbers = fields.frame(rows, "number", ["i"])
    assert numbers.columns == ["i", "FQtyL", "FQtyR", "Latitude", "Longitude"] and numbers.where("FQtyR IS NULL").count() == 1
    assert [tuple(r) for r in fields.frame(rows, "number", ["i"], ["FQtyR"], every=False).collect()] == [(2, 4.0)]
    assert fields.frame(rows, "name", ["i"]).columns == ["i", "AtvWpt"]
    assert [r.position for r in fields.frame(rows, "position", ["i"], ["position"]).collect()] == [(50.0, 1.0)]


def test_fixes(spark, tmp_path):
    (tmp_path / "f.csv").write_text("ident,latitude_deg,longitude_deg\nabc ,50,1\nABC,50,1\nX,?,1\nY,95,1\n,1,1\n")
    assert [tuple(r) for r in logs.fixes(spark, str(tmp_path / "f.csv")).collect()] == [("ABC", 50.0, 1.0)]
