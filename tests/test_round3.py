"""Keyed tables, incremental catalogues, stateful streams, trees of places, and what else round 3 brought."""

import datetime
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import clusters, series, spatial, stats
from skyloom.sources import keyed, logscan, plans, sqlite, store
from skyloom.streaming import streams

START = datetime.datetime(2021, 1, 1)


def rows_of(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_text_keys_come_back_as_text_and_are_replaced_and_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    names = ["0012", "0013", "a:b c=1.csv", "x/y", "1e3", ""]
    own = keyed.KeyedTable(spark, path, "log", buckets=4)
    own.replace(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "log string, v int"))
    assert dict(own.table().dtypes)["log"] == "string" and rows_of(own.table(), "log") == sorted((n,) for n in names)
    own.replace(spark.createDataFrame([("0012", 9), ("0012", 10), ("new", 1)], "log string, v int").withColumn("more", F.lit("x")))
    expected = [("", 5, None), ("0012", 9, "x"), ("0012", 10, "x"), ("0013", 1, None), ("1e3", 4, None), ("a:b c=1.csv", 2, None), ("new", 1, "x"), ("x/y", 3, None)]
    assert rows_of(own.table(), "log", "v", "more") == sorted(expected)
    own.delete(spark.createDataFrame([("a:b c=1.csv",), ("x/y",), ("nobody",)], "log string"))
    expected = [e for e in expected if e[0] not in ("a:b c=1.csv", "x/y")]
    assert rows_of(keyed.opened(spark, path).table(), "log", "v", "more") == sorted(expected)
    own.compact()
    own.vacuum()
    assert rows_of(store.stored(spark, path), "log", "v", "more") == sorted(expected) and len(own._versions()) == 1
    own.delete(spark.createDataFrame([(n,) for n in [*names, "new"]], "log string"))
    assert own.table().count() == 0 and own.table().columns == ["log", "v", "more"]
    with pytest.raises(ValueError):
        keyed.KeyedTable(spark, path, "v")
    with pytest.raises(ValueError):
        keyed.opened(spark, str(tmp_path / "nothing"))


def test_keys_of_several_columns_with_nulls_keep_their_types(spark, tmp_path):
    own = keyed.KeyedTable(spark, str(tmp_path / "t"), ["a", "b"], buckets=3)
    own.replace(spark.createDataFrame([(1, None, 1.0), (1, "x", 2.0), (None, None, 3.0)], "a long, b string, v double"))
    own.replace(spark.createDataFrame([(1, None, 7.0)], "a int, b string, v double"))  # an int is the same key as a long
    assert sorted(map(repr, map(tuple, own.table().collect()))) == sorted(map(repr, [(1, None, 7.0), (1, "x", 2.0), (None, None, 3.0)]))
    own.delete(spark.createDataFrame([(None, None)], "a long, b string"))
    assert own.table().count() == 2


def test_a_lost_race_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    own = keyed.KeyedTable(spark, path, "k")
    own.replace(spark.createDataFrame([("a", 1)], "k string, v int"))
    slow = keyed.KeyedTable(spark, path, "k")
    slow._versions = list  # it read the table before the other wrote
    with pytest.raises(RuntimeError):
        slow.replace(spark.createDataFrame([("a", 2)], "k string, v int"))
    assert rows_of(own.table(), "k", "v") == [("a", 1)]
    own.vacuum()
    assert rows_of(own.table(), "k", "v") == [("a", 1)] and len(keyed._names(spark, f"{path}/data")) == 1


def test_catalogue_merges_partials_and_counts_a_batch_once(spark, tmp_path):
    kind = "log string, ts timestamp, v double"
    batches = [[("0012", START, 1.0), ("b", START, None)], [("0012", START + datetime.timedelta(hours=1), 5.0), ("c", START, 3.0)], [("b", START, 4.0), (None, START, 1.0)]]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    spec = keyed.partials(n=("count", "v"), total=("sum", "v"), start=("min", "ts"), end=("max", "ts"))
    run = lambda cp: streams.refresh(source, str(tmp_path / "out"), "log", str(tmp_path / cp), spec).awaitTermination()
    for own in batches:
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run("cp")
    run("cp")
    every = spark.createDataFrame([r for b in batches for r in b], kind).groupBy("log").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    found = store.stored(spark, str(tmp_path / "out"))
    assert sorted(map(repr, found.select(*every.columns).collect())) == sorted(map(repr, every.collect()))
    table = keyed.opened(spark, str(tmp_path / "out"))
    assert table.mark(str(tmp_path / "cp")) == 2


def stream_in_parts(spark, rows, kind, folder, parts, make):
    """Runs a stream over rows that come in several files, one a batch."""
    for i in range(parts):
        own = spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], kind).coalesce(1)
        own.write.mode("append").parquet(f"{folder}/in")
    import glob
    import os

    for i, f in enumerate(sorted(glob.glob(f"{folder}/in/*.parquet"), key=os.path.getmtime)):
        os.utime(f, (1_600_000_000 + i * 10,) * 2)
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return make(source)


def test_a_parsed_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows, clock = [], {k: 0 for k in "abc"}
    for line in range(300):
        k = rng.choice("aab c".replace(" ", ""))
        clock[k] += rng.choice([0, 1, 1, 2, 15])
        if rng.random() < 0.01:
            clock[k] = 5
        some = lambda v: None if rng.random() < 0.1 else v
        rows.append((k, line, START + datetime.timedelta(seconds=clock[k]), some(50 + rng.random()), some(rng.random()), some(10 * rng.random())))
    kind = "log string, line long, ts timestamp, lat double, lon double, rate double"
    out = str(tmp_path / "out")
    query = stream_in_parts(spark, rows, kind, str(tmp_path), 6, lambda s: streams.parsed(s, "log", "line", "ts", "lat", "lon", "rate").writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).option("path", out).format("parquet").start())
    query.awaitTermination()
    assert len(query.recentProgress) >= 6
    found = spark.read.parquet(out)
    last = found.groupBy("log").agg(F.max("epoch").alias("epoch"))
    found = found.join(last, ["log", "epoch"])
    batch = series.last_epoch(spark.createDataFrame(rows, kind), "ts", ["log"], ["line"])
    batch = series.with_steps(series.distance_run(batch, "lat", "lon", ["log"], ["line"]), "ts", ["log"], ["line"])
    batch = batch.select("log", "line", "distance", series.integral(F.col("rate"), "ts", ["log"], ["line"]).alias("used"))
    mine, theirs = rows_of(found, "log", "line", "distance", "used"), rows_of(batch, "log", "line", "distance", "used")
    assert [r[:2] for r in mine] == [r[:2] for r in theirs] and np.allclose([r[2:] for r in mine], [r[2:] for r in theirs])


def test_streamed_segments_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, START + datetime.timedelta(seconds=i), rng.choice(["x", "x", "y", None])) for i in range(200)]
    kind = "log string, line long, ts timestamp, phase string"
    stream_in_parts(spark, rows, kind, str(tmp_path), 5, lambda s: streams.keep(streams.segments(s, "log", "line", "ts", "phase"), str(tmp_path / "out"), ["log", "segment"], str(tmp_path / "cp"))).awaitTermination()
    expected = []
    for k in "ab":
        number, before = -1, object()
        for _, _, t, v in [r for r in rows if r[0] == k]:
            if v != before:
                number, before = number + 1, v
                expected.append([k, number, v, t, t, 0])
            expected[-1][4:] = [t, expected[-1][5] + 1]
    found = store.stored(spark, str(tmp_path / "out")).select("log", "segment", "value", "start", "end", "n").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(tuple(e)) for e in expected)


def test_sessions_end_at_gaps(spark, tmp_path):
    rows = [("a", START + datetime.timedelta(minutes=m)) for m in (0, 1, 2, 30, 31)] + [("b", START)]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    streams.sessions(source, "ts", ["k"], "5 minutes").writeStream.outputMode("complete").format("memory").queryName("spells").trigger(availableNow=True).start().awaitTermination()
    at = lambda m: START + datetime.timedelta(minutes=m)
    assert rows_of(spark.table("spells"), "k", "start", "end", "n") == [("a", at(0), at(7), 3), ("a", at(30), at(36), 2), ("b", at(0), at(5), 1)]


@pytest.mark.parametrize("shape", ["spread", "clumps", "same", "line"])
def test_nearest_place_by_tree(shape, spark):
    rng = np.random.default_rng(4)
    places = {"spread": rng.uniform(-80, 80, (900, 2)), "clumps": np.repeat(rng.uniform(-80, 80, (9, 2)), 100, 0) + rng.normal(0, 0.01, (900, 2)), "same": np.ones((300, 2)), "line": np.stack([np.arange(400) / 10, np.zeros(400)], 1)}[shape]
    places = np.round(places, 2)
    points = np.concatenate([rng.uniform(-90, 90, (400, 2)), places[:50], [[0.05, 0.0], [1e6, -1e6]]])
    at = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(9000, float("nan"), 1.0), (9001, None, 1.0), (9002, float("inf"), 1.0)], "id int, lat double, lon double")
    near = spark.createDataFrame([(f"P{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(places)] + [("bad", float("nan"), 0.0), (None, 0.0, 0.0)], "ident string, lat double, lon double")
    found = {r.id: r.ident for r in spatial.nearest_of_all(at, near, "lat", "lon", ["id"], "ident", leaf=40, chunk=100).collect()}
    d = (points[:, None, 0] - places[None, :, 0]) ** 2 + (points[:, None, 1] - places[None, :, 1]) ** 2
    assert found == {i: f"P{k:04d}" for i, k in enumerate(d.argmin(1))} | {9000: None, 9001: None, 9002: None}


def test_boxes_that_cannot_hold_the_nearest_place_are_passed_over():
    rng = np.random.default_rng(5)
    places = rng.uniform(0, 100, (20_000, 2))
    tree = spatial.Tree.of(places, 200)
    leaf = tree.leaf(places)
    boxes = np.array([[*places[leaf == k].min(0), *places[leaf == k].max(0)] for k in np.unique(leaf)])
    points = rng.uniform(-500, 600, (500, 2))
    assert len(spatial.worthwhile(points, boxes)[0]) < 12 * len(points)
    number, d = spatial.nearest_of(points, places)
    every = ((points[:, None] - places[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and np.allclose(d, every.min(1))


def test_cells_hold_all_within_reach(spark):
    rng = np.random.default_rng(6)
    grid = spatial.Grid(30.0)
    a = [(i, float(math.degrees(math.asin(rng.uniform(-1, 1)))), float(rng.uniform(-180, 180))) for i in range(300)] + [(900, 89.99, 10.0), (901, -90.0, 0.0), (902, 0.0, 180.0)]
    b = []
    for i, lat, lon in a:
        turn, far = rng.uniform(0, 2 * math.pi), math.radians(29.9 / 60) * rng.uniform(0, 1)
        p = math.radians(lat)
        q = math.asin(math.sin(p) * math.cos(far) + math.cos(p) * math.sin(far) * math.cos(turn))
        east = math.atan2(math.sin(turn) * math.sin(far) * math.cos(p), math.cos(far) - math.sin(p) * math.sin(q))
        b.append((i, math.degrees(q), (lon + math.degrees(east) + 180) % 360 - 180))
    kind = "id int, lat double, lon double"
    own = grid.cells(spark.createDataFrame(a, kind), "lat", "lon", "y", "x").select("id", "y", "x")
    other = grid.around(spark.createDataFrame(b, kind), "lat", "lon", "y", "x")
    assert other.groupBy("id").count().agg(F.max("count")).first()[0] <= 4
    assert other.join(own, ["id", "y", "x"]).select("id").distinct().count() == len(a)


def linkage(x, most):
    """The closest two clusters join, by all pairs."""
    groups = [[i] for i in range(len(x))]
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).mean(2))
    while len(groups) > 1:
        d, i, j = min((max(gap[a, b] for a in groups[i] for b in groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d > most:
            break
        groups[i] += groups.pop(j)
    groups.sort(key=lambda g: (-len(g), min(g)))
    return {m: k for k, g in enumerate(groups) for m in g}


def test_clusters_of_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows, expected = [], {}
    for g, n in (("a", 60), ("b", 1), ("c", 35), (None, 3)):
        x = rng.normal(0, 30, (n, 1)) + rng.normal(0, 6, (n, 9))
        rows += [(g, f"{i:03d}", [float(v) for v in p], 1) for i, p in enumerate(x)]
        expected |= {(g, f"{i:03d}"): k for i, k in linkage(x, 12.0).items()}
    rows += [("d", "0", None, 1), ("d", "1", [1.0, float("nan")], 1), ("d", "2", [1.0, 1.0], 1), ("d", "3", [1.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "way string, flight string, offsets array<double>, cluster2 int")
    found = {(r.way, r.flight): r.cluster for r in clusters.clustered(frame, "way", "flight").collect()}
    assert {k: found[k] for k in expected} == expected
    assert found["d", "2"] == found["d", "3"] == 0 and sorted((found["d", "0"], found["d", "1"])) == [1, 2]
    assert clusters.clustered(frame.limit(0), "way", "flight").count() == 0
    apart = clusters.blocks(frame.where("way = 'a'"), "way", 12.0).select("block").distinct().count()
    assert 1 <= apart <= len({v for (g, _), v in expected.items() if g == "a"})


def test_vectors_that_are_dropped_are_made_again():
    x = np.random.default_rng(9).normal(0, 10, (80, 5))
    few = clusters.Chain(x, 12.0, cache=1)
    few.room = 2
    assert (few.run() == clusters.Chain(x, 12.0).run()).all()


def test_very_many_flights_of_one_corridor_need_no_pairs():
    rng = np.random.default_rng(10)
    centres = np.arange(40)[:, None] * 100.0 + rng.normal(0, 1, (40, 9))
    x = np.repeat(centres, 500, axis=0) + rng.uniform(-5, 5, (20_000, 9))
    began = time.perf_counter()
    found = clusters.complete_linkage(x, 12.0)
    assert time.perf_counter() - began < 240
    assert len(set(found)) == 40 and all(len(set(found[i * 500 : (i + 1) * 500])) == 1 for i in range(40))


def test_approaches_equal_all_distances():
    rng = np.random.default_rng(11)
    lat, lon = 50 + np.cumsum(rng.normal(0, 0.01, 700)), np.cumsum(rng.normal(0, 0.01, 700))
    fix_lat, fix_lon = np.append(rng.uniform(40, 60, 1500), 90.0), np.append(rng.uniform(-180, 180, 1500), 0.0)
    every = clusters.radians_apart(lat[None], lon[None], fix_lat[:, None], fix_lon[:, None]).min(1) * clusters.RADIUS_NM
    assert np.allclose(clusters.approach(lat, lon, fix_lat, fix_lon), every, rtol=1e-12, atol=1e-9)


def test_folds_take_keys_of_any_length_in_order(spark):
    rows = spark.range(50_000).select((F.col("id") % 3).alias("k"), (-F.col("id")).alias("o"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("v"))
    found = {r.k: r.folded for r in stats.folded(rows, F.col("v"), ["k"], ["o"], 0, lambda a, x: (a * 31 + (x or 7)) % 1_000_003).collect()}
    expected = {k: 0 for k in range(3)}
    for i in range(49_999, -1, -1):
        expected[i % 3] = (expected[i % 3] * 31 + ((i % 11 if i % 5 else 0) or 7)) % 1_000_003
    assert found == expected
    text = stats.folded(rows.where("id < 4" if "id" in rows.columns else "o > -4"), F.col("v").cast("string"), ["k"], ["o"], "", lambda a, x: a + str(x), "string")
    assert {r.k: r.folded for r in text.collect()} == {0: "3None", 1: "1", 2: "2"}
    assert stats.folded(rows.limit(0), F.col("v"), ["k"], ["o"], 0, lambda a, x: a).count() == 0


LOG = '#airframe_info, log_version="1.00"\n#yyy-mm-dd, hh:mm:ss, hh:mm, degrees, degrees, kt, ident\n  Lcl Date, Lcl Time, UTCOfst, Latitude, Longitude, IAS, AtvWpt\n'


def log_lines(n):
    out = []
    for i in range(n):
        fix = ",".join(["", ""] if i % 10 == 0 or i > n - 3 else [f"{50 + i / 1000:9.4f}", f" {i / 1000:9.4f}"])
        out.append(f'2021-01-01, 10:{i // 60:02d}:{i % 60:02d}, +00:00,{fix}, {i}.5,"WP, {i % 4}"')
    return out


@pytest.mark.parametrize("size", [97, 1000, 1 << 20])
def test_log_scan_reads_ranges_once_and_in_order(size, spark, tmp_path):
    from skyloom.sources import logs

    lines = log_lines(150)
    lines[40] += ", one cell more"
    (tmp_path / "log_210101_100000_EGTF.csv").write_text(LOG + "\n".join(lines))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "log_210102_100000_LFAT.csv").write_text(LOG.replace("IAS", "TAS").replace("\n", "\r\n") + "\r\n".join(log_lines(5)) + "\r\n")
    (tmp_path / "log_210103_000000.csv").write_text("")
    (tmp_path / "notes.txt").write_text("no log")
    wanted = ["Latitude", "Longitude", "IAS", "AtvWpt", "Absent"]
    plain = {(r.path.rsplit("/", 1)[1], r.ts): tuple(r[c] for c in wanted) for r in logs.samples(spark, str(tmp_path), wanted).collect()}
    rows = logscan.samples(spark, str(tmp_path), wanted, range=size).collect()
    assert {(r.path.rsplit("/", 1)[1], r.ts): tuple(r[c] for c in wanted) for r in rows} == plain and len(rows) == len(plain) == 154
    own = sorted((r for r in rows if "EGTF" in r.path), key=lambda r: r.row_idx)
    assert [r.ts for r in own] == sorted(r.ts for r in own)
    some = logscan.cells(spark, str(tmp_path), ["IAS"], every=30, range=size)
    assert [r.IAS for r in some.where("path LIKE '%EGTF%'").orderBy("at").collect()] == ["27.5", "57.5", "87.5", "117.5", "147.5"]
    assert logscan.cells(spark, str(tmp_path), ["IAS"], head=8).groupBy("path").count().agg(F.max("count")).first()[0] == 5


def test_ends_of_logs_are_peeked_at(spark, tmp_path):
    lines = log_lines(3000)
    (tmp_path / "log_210101_100000_EGTF.csv").write_text(LOG + "\n".join(lines) + "\n")
    (tmp_path / "log_210101_110000_X.csv").write_text(LOG + "\n".join(log_lines(1)) + "\n")
    found = {r.path.rsplit("_", 1)[1]: r for r in logscan.peeked(spark, str(tmp_path), head=50, tail=2000).collect()}
    assert set(found) == {"EGTF.csv"}
    r = found["EGTF.csv"]
    assert (r.first.date, r.first.time, r.first.lat) == ("2021-01-01", "10:00:01", 50.001) and (r["last"].time, r["last"].lat) == ("10:49:57", 52.997)
    assert logscan.peeked(spark, str(tmp_path), head=1, tail=10).count() == 0


def test_only_the_first_table_with_waypoints_counts(spark):
    row = "<tr><td>{} N5120.9/W00033.5</td></tr>"
    few, many = "".join(row.format(f"A{i}") for i in range(2)), "".join(row.format(f"B{i}") for i in range(3))
    html = f"<table>{few}</table><table>{many}</table><table>{many.replace('B', 'C') * 2}</table>"
    found = plans.waypoints(spark.createDataFrame([(1, html), (2, f"<table>{few}</table>")], "p int, html string"), "p", "html")
    assert rows_of(found, "p", "seq", "name") == [(1, 1, "B0"), (1, 2, "B1"), (1, 3, "B2")]


def test_words_of_several_pages_become_waypoints(spark):
    words = []

    def line(page, top, *cells):
        words.extend((1, page, top + k * 0.01, x, t) for k, (x, t) in enumerate(cells))

    for i, page in enumerate((1, 1, 1, 2, 2, 2)):
        top = 100.0 + 60 * (i % 3)
        line(page, top - 20, (20.0, "WAYPOINT"), (140.0, "AWY"))
        line(page, top, (20.0, f"WP{i}" if i != 2 else "-TOC-"), (131.0, "L9"), (170.0, "-5"), (215.0, "120"), (245.0, "150"), (270.0, "20"), (300.0, "45.5"), (330.0, "4.5"), (365.0, "15"), (393.0, "0:10"), (420.0, "0:20"))
        line(page, top + 9, (20.0, "N5120.9/W00033.5"), (140.0, "5500"), (170.0, "264/018"), (215.0, "118"), (245.0, "145"), (270.0, "80"), (393.0, "0:55"))
        line(page, top + 18, (140.0, "2100"), (170.0, "+13/-2"))
        line(page, top + 27, (20.0, "LYD"))
    line(3, 10.0, (20.0, "N5120.9/W00033.5"))
    frame = spark.createDataFrame(words, "plan int, page int, top double, x0 double, text string")
    found = plans.printed_waypoints(frame, "plan").orderBy("seq").collect()
    assert [(r.seq, r.name, r.is_pseudo) for r in found] == [(i + 1, "-TOC-" if i == 2 else f"WP{i}", i == 2) for i in range(6)]
    r = found[3]
    assert (r.airway, r.wind_comp_raw, r.mag_hdg, r.tas, r.dist_leg, r.fuel_rem, r.fuel_used, r.flow, r.leg_time_s, r.eta_elapsed_s) == ("L9", "-5", 120, 150, 20, 45.5, 4.5, 15, 600, 1200)
    assert (r.coord_raw, r.altitude_ft, r.wind_dir, r.wind_speed, r.crs, r.gs, r.dist_rem, r.ete_remaining_s, r.msa, r.oat, r.isa_dev, r.navaid) == ("N5120.9/W00033.5", 5500, 264, 18, 118, 145, 80, 3300, 2100, 13, -2, "LYD")


def test_sqlite_tables_are_read_in_ranges(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "nav.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE airports (id INTEGER PRIMARY KEY, ident TEXT, name TEXT, latitude_deg REAL, longitude_deg REAL)")
        db.executemany("INSERT INTO airports VALUES (?, ?, ?, ?, ?)", [(i * 3, f"A{i}", "x", i / 10, -i / 10) for i in range(1000)] + [(5000, "NONE", "x", None, 1.0), (5001, "TEXT", "x", "north", 1.0)])
        db.execute('CREATE TABLE navaids (ident TEXT PRIMARY KEY, latitude_deg REAL, longitude_deg REAL, "odd ""name" TEXT) WITHOUT ROWID')
        db.execute("INSERT INTO navaids VALUES ('LYD', 51, 1, 'o')")
        db.execute("CREATE TABLE empty (a INT)")
    found = sqlite.table(spark, path, "airports", ["ident", "latitude_deg"], parts=5)
    assert found.columns == ["ident", "latitude_deg"] and found.rdd.getNumPartitions() == 5
    assert rows_of(found.where("latitude_deg IS NOT NULL"), "ident", "latitude_deg") == sorted((f"A{i}", i / 10) for i in range(1000)) and found.count() == 1002
    assert rows_of(sqlite.table(spark, path, "navaids"), "ident", 'odd "name') == [("LYD", "o")]
    assert sqlite.table(spark, path, "empty").count() == 0 and sqlite.airports(spark, path).count() == 1000
    assert rows_of(sqlite.nav_model(spark, path).where("navaid"), "ident", "lat", "lon") == [("LYD", 51.0, 1.0)]
    with pytest.raises(Exception, match="no columns"):
        sqlite.table(spark, path, "airports", ["absent"]).count()
    points = spark.createDataFrame([(1, 3.02, -3.0)], "id int, lat double, lon double")
    assert spatial.nearest_of_all(points, sqlite.airports(spark, path), "lat", "lon", ["id"], "ident").first().ident == "A30"


def test_exported_files_are_the_rows_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", "one\ntwo"), ("b.txt", None), (None, "lost")], "name string, body string")
    assert store.export_files(rows, f"file:{tmp_path}/out", "name", "body") == 2
    assert (tmp_path / "out" / "a.txt").read_text() == "one\ntwo" and (tmp_path / "out" / "b.txt").read_text() == ""
    assert store.export_files(rows.limit(0), str(tmp_path / "none"), "name", "body") == 0
