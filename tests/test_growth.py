"""What showed only on larger tables."""

import datetime
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import clusters, corridor, joins, spatial
from skyloom.plans import catalogue
from skyloom.sources import keyed, plans
from skyloom.streaming import streams


def table(spark, folder, name, rows):
    rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_stored_aggregates_of_more_than_a_thousand_logs(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    table(spark, tmp_path, "events", spark.createDataFrame([(k, day, u, "x", 1.0, "") for k, u in enumerate((4, 5, 995, 1000, 1001, 7005, 7006))], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"))
    found = catalogue.queries()["stored_aggregates"](spark, str(tmp_path))
    assert sorted(r.log for r in found.collect()) == ["000004", "001001", "007006"]


def test_a_half_goes_up_whatever_the_order_of_adding(spark):
    own = [9.3, 0.5, 4.1, 8.0, 8.7, 7.1, 9.6, 8.9]  # 7.0249999999999995 when added in this order
    legs = spark.createDataFrame([(1, True, True, 1.0, 1.0, 1.0, 1.0, x, 0.0, 0.0, 0.0, 0.0) for x in own], "p int, reliable boolean, overflown boolean, actual_gs double, planned_gs double, actual_time_s double, planned_time_s double, actual_fuel double, planned_fuel double, actual_fuel_tank double, headwind_actual double, headwind_planned double")
    assert corridor.accuracy(legs.coalesce(1), ["p"]).first().mean_leg_fuel_err_gal == 7.03


def test_first_matches_are_those_of_all(spark):
    k = F.col("id")
    on = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    logs = spark.range(1500).select(k.alias("log_id"), F.when(k % 7 > 0, on(k % 3)).alias("day"), (k % 4 * 0.05).alias("first_lat"), (k % 5 * 0.06).alias("first_lon"), (k % 2 * 1.0).alias("last_lat"), F.when(k % 11 > 0, k % 3 * 0.07).alias("last_lon"))
    asked = spark.range(40).select(k.alias("plan_id"), F.when(k % 2 == 0, on(k % 5)).alias("day"), (k % 4 * 0.05).alias("from_lat"), F.lit(0.06).alias("from_lon"), (k % 2 * 1.0).alias("to_lat"), F.lit(0.0).alias("to_lon"))
    every = joins.log_matches(asked, logs).collect()
    n = {p: sum(r.plan_id == p for r in every) for p in range(40)}
    expected = sorted((r.plan_id, r["rank"], r.log_id, r.start_nm, r.end_nm, n[r.plan_id]) for r in every if r["rank"] <= 3)
    found = joins.first_log_matches(asked, logs, 3)
    assert expected and sorted((r.plan_id, r["rank"], r.log_id, r.start_nm, r.end_nm, r.n) for r in found.collect()) == expected


def test_plan_matches_of_one_place_do_not_multiply(spark, tmp_path):
    at = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    table(spark, tmp_path, "events", spark.range(0, 300 * 20_000, 300).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit(0).cast("long").alias("user_id")))
    found = catalogue.queries()["plan_log_matches"](spark, str(tmp_path))  # 400 million matches
    assert found.agg(F.count("*"), F.min("n"), F.max("n"), F.max("log_id")).first() == (100_000, 20_000, 20_000, 1200)


def test_fixes_of_one_place_are_measured_once(spark):
    tracks = spark.range(40).select(F.lit(1).alias("way"), F.lit(0).alias("cluster"), (F.col("id") % 4).alias("flight"), (50 + F.col("id") * 0.01).alias("lat"), F.lit(1.0).alias("lon"))
    k = F.col("id")
    fixes = spark.range(200_000).select(F.lit(1).alias("way"), F.concat(F.lit("F"), k.cast("string")).alias("fix"), (k % 2 == 0).alias("navaid"), (50 + k % 3).cast("double").alias("lat"), F.lit(1.5).alias("lon"))
    found = clusters.fix_distances(tracks, fixes, "way")
    one = lambda lat: sum(min(clusters.approach(*map(np.array, ([50 + n * 0.01], [1.0], [lat], [1.5])))[0] for n in range(f, 40, 4)) for f in range(4)) / 4
    means = {r.place: (r.n, r.low, r.high) for r in found.groupBy((F.substring("fix", 2, 9).cast("long") % 3).alias("place")).agg(F.count("*").alias("n"), F.min("mean").alias("low"), F.max("mean").alias("high")).collect()}
    assert {p: m[0] for p, m in means.items()} == {0: 66_667, 1: 66_667, 2: 66_666}
    assert all(m[1] == m[2] == pytest.approx(one(50.0 + p), abs=1e-9) for p, m in means.items())
    # No task's rows hold a corridor's fixes: a flight meets three places.
    plan = clusters.fix_distances(tracks, fixes, "way")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(fix" not in plan


def test_small_groups_are_linked_together_as_one_by_one(spark):
    rng = np.random.default_rng(5)
    groups = {g: [rng.normal(0, 10, 4).tolist() for _ in range(int(rng.integers(1, 12)))] for g in range(60)}
    groups[60] = [[1.0, 2.0], None, [1.0, float("nan")], [1.5, 2.0], [1.0], [float("inf"), 0.0]]
    groups[61] = [[], []]
    groups[62] = [[float(k % 3 * 100 + k * 0.01)] for k in range(clusters.FEW + 20)]
    rows = [(g, k, o) for g, own in groups.items() for k, o in enumerate(own)]
    found = clusters.clustered(spark.createDataFrame(rows, "way int, flight int, offsets array<double>").repartition(3), "way", "flight")
    assert found.columns == ["way", "flight", "offsets", "cluster"] and dict(found.dtypes)["cluster"] == "int"
    got = {(r.way, r.flight): r.cluster for r in found.collect()}
    for g, own in groups.items():
        width = max(len(o or [np.nan]) for o in own)
        x = [np.array(o) if o is not None and len(o) == width else np.full(width, np.nan) for o in own]
        assert [got[g, k] for k in range(len(own))] == (clusters.complete_linkage(x, 12.0) if g != 61 else [0, 1])
    calls = [len(clusters.linked(rng.normal(0, 10, (500, 6, 4)), 12.0))]
    assert calls == [500]


def test_plan_pages_are_read_without_a_shuffle(spark):
    row = "<tr><td>{} N5120.5/W00033.5 VOR</td><td>-</td><td>L1 900</td></tr>"
    two = "".join(row.format(f"A{k}") for k in range(2))
    four = "".join(row.format(f"B{k}") + "<tr><td>note</td></tr>" for k in range(4))
    later = "".join(row.format(f"C{k}") for k in range(5))
    pages = spark.createDataFrame([(1, f"<table>{two}</table><TABLE x=1>{four}</TABLE><table>{later}</table>"), (2, None), (3, f"<table>{two}</table>")], "p int, html string")
    found = plans.waypoints(pages, "p", "html")
    assert [(r.p, r.seq, r.name, r.navaid, r.airway, r.altitude_ft) for r in found.orderBy("seq").collect()] == [(1, k + 1, f"B{k}", "VOR", "L1", 900.0) for k in range(4)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_places_and_namesakes_at_one_position_are_met_once(spark):
    places = spark.range(30_000).select(F.col("id").alias("place"), F.lit(50.0).alias("lat"), (F.col("id") % 2 * 0.01).alias("lon"))
    points = spark.range(3_000).select("id", F.lit(50.0).alias("lat"), (F.col("id") % 3 * 0.01 - 0.002).alias("lon"))
    found = spatial.nearest_within(points, places, "lat", "lon", ["id"], "place")
    assert {(r.id % 3, r.place) for r in found.collect()} == {(0, 0), (1, 1), (2, 1)} and found.count() == 3_000  # 90 million pairs
    k = F.col("id")
    fixes = spark.range(20_000).select(F.when(k % 2 == 0, "A").otherwise("B").alias("name"), (k % 10).cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    airports = spark.createDataFrame([("B", 9.0, 3.0), ("B", 8.0, 4.0)], "ident string, lat double, lon double")
    asked = spark.range(12_000).select("id", F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C").alias("ident"), F.when(k % 12 > 0, k * 0.001).alias("ref_lat"), F.lit(1.0).alias("ref_lon"))
    got = {r.id: (r.lat, r.lon) for r in joins.resolved(asked, airports, fixes).collect()}
    assert len(got) == 12_000 and got[0] == (0.0, 1.0) and got[4] == (8.0, 4.0) and got[2] == (None, None) and got[3] == (0.0, 1.0) and got[3_300 - 3_300 % 12 + 3] == (4.0, 1.0) and got[9_003] == (8.0, 1.0)


def test_words_of_printed_plans_are_not_rows_of_a_sort(spark, sf_dir):
    words = []
    for p, n in ((1, 3), (2, 2), (3, 4)):
        for page in (None, 2):
            for k in range(n if page else 3):
                words += [(p, page, k * 40.0, 30.0, f"P{page}{k}"), (p, page, k * 40.0, 5.0, "ETA"), (p, page, k * 40.0, 131.0, "L"), (p, page, k * 40.0, 131.0, "K"), (p, page, k * 40.0, 150.0, None)]
                words += [(p, page, k * 40.0 + 9, -3.0, "N5120.5/W00033.5"), (p, page, k * 40.0 + 9, 140.0, "900"), (p, page, k * 40.0 + 20, 135.0, "-"), (p, page, k * 40.0 + 30, 135.0, "70"), (p, page, k * 40.0 + 30, 40.0, "VOR")]
    words += [(3, 2, 170.0, 30.0, "N5120.5/W00033.5"), (3, 2, 180.0, 30.0, "N5220.5/W00033.5"), (3, 2, 180.0, 140.0, "5")]  # a coordinate heads the next one
    frame = spark.createDataFrame(words, "plan int, page int, top double, x0 double, text string").repartition(5)
    found = plans.printed_waypoints(frame, "plan")
    got = [(r.plan, r.seq, r.name, r.coord_raw, r.airway, r.altitude_ft, r.msa, r.navaid) for r in found.orderBy("plan", "seq").collect()]
    own = lambda p, pages: [(p, i + 1, f"P{page}{k}", "N5120.5/W00033.5", "K", 900.0, 70.0, "VOR") for i, (page, k) in enumerate((page, k) for page, n in pages for k in range(n))]
    last = own(3, [(None, 3), (2, 4)])
    last[6] = (*last[6][:6], None, None)  # its last line heads what follows
    last += [(3, 8, "VOR", None, "70", None, None, None), (3, 9, "N5120.5/W00033.5", "N5220.5/W00033.5", None, 5.0, None, None)]
    assert got == own(1, [(None, 3), (2, 3)]) + own(2, [(None, 3)]) + last
    arrays = frame.groupBy("plan").agg(F.collect_list(F.struct("page", "top", "x0", "text")).alias("words")).localCheckpoint()
    whole = plans.printed_plans(arrays, "plan", "words")
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, found.collect()))
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    plan = catalogue.queries()["printed_plans"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate") == 1


def test_streamed_segments_write_few_files(spark, tmp_path):
    k = F.col("id")
    at = F.when(k % 5 > 0, F.timestamp_micros(F.lit(1_700_000_000_000_000) + k * 7))
    rows = spark.range(16_000).select((k % 800).alias("log"), (-k).alias("line"), at.alias("ts"), F.when(k % 3 > 0, (F.floor(k / 800) % 4 / 3).cast("int").cast("string")).alias("phase"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
        streams.keep(streams.segments(stream, "log", "line", "ts", "phase"), str(tmp_path / "out"), ["log", "segment"], str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = keyed.opened(spark, str(tmp_path / "out")).table()
    assert dict(found.dtypes)["start"] == "timestamp" and found.columns == ["log", "segment", "value", "start", "end", "n"]
    expected = []
    for log in range(800):
        number, last = -1, object()
        for i in range(15_200 + log, -1, -800):
            value, ts = str(i // 800 % 4 // 3) if i % 3 else None, 1_700_000_000_000_000 + i * 7 if i % 5 else None
            if value != last:
                number, last = number + 1, value
                expected.append([log, number, value, ts, ts, 0])
            expected[-1][4:] = [ts, expected[-1][5] + 1]
    got = found.select("log", "segment", "value", F.unix_micros("start"), F.unix_micros("end"), "n").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(e)) for e in expected)
    files = list((tmp_path / "out" / "data").rglob("*.parquet"))
    assert len(files) <= 64 * keyed.SPLITS  # of 16 tasks with rows of all 64 buckets


def test_planned_climb_and_descent_hold_one_sort_alone(spark, sf_dir):
    names = {1: ["A", "-TOC-", "B", "-TOD-", "C"], 2: ["A", "-TOC-", None], 3: ["A", "-TOD-", "-TOD-", "B"], 4: ["A"]}
    rows = [(p, k, n, 100.0 * k, 2.0 * k, None if k == 2 and p == 2 else 5.0 + k, 50.0 - k, 1000.0 * (k + p), None if k == 4 else 90.0 + 10 * k, 80.0 + k) for p, own in names.items() for k, n in enumerate(own)]
    plan = spark.createDataFrame(rows, "p int, seq int, name string, eta_s double, fuel_used double, dist_leg double, dist_rem double, altitude double, tas double, gs double").repartition(3)
    found = corridor.planned_climb_descent(plan, ["p"])
    assert found.columns == ["p", "climb_s", "climb_gal", "climb_nm", "climb_ft", "descent_s", "descent_gal", "descent_nm", "descent_ft", "descent_tas", "descent_gs", "climb_fpm", "descent_fpm"]
    assert [tuple(r) for r in found.orderBy("p").collect()] == [
        (1, 100.0, 2.0, 6.0, 1000.0, 100.0, 2.0, 47.0, 1000.0, 120.0, 83.5, 600.0, 600.0), (2, 100.0, 2.0, 6.0, 1000.0, *[None] * 6, 600.0, None),
        (3, *[None] * 4, 100.0, 2.0, 48.0, 1000.0, 115.0, 82.5, None, 600.0), (4, *[None] * 12),
    ]
    planned = catalogue.queries()["planned_climb_descent"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in planned and planned.count("Exchange") == 1 and planned.count("Sort [") == 1
