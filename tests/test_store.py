"""Files of the store by their zones: scans that skip, changes that rewrite little, older stores, windows that exports replace."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.functions.scalars import boxes_meet, hilbert
from trailweave.plans import ingest
from trailweave.sources import gpx
from trailweave.sources.store import SCHEMA_VERSION, TABLES, Store, between, box
from trailweave.streaming import tracks as stream

DAY = 86_400_000


def segments(spark, n=4000, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lat, lon, t = float(rng.uniform(40, 60)), float(rng.uniform(0, 30)), int(rng.integers(0, 30)) * DAY
        rows.append((i, i, i % 10, "car", t, t + 1000, 2, 2, lat, lon, lat + 0.01, lon + 0.01, 0) if i % 50 else (i, i, i % 10, "car", None, None, 2, 0, None, None, None, None, 1))
    return spark.createDataFrame(rows, TABLES["segments"])


def test_a_small_box_reads_few_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), parts=16)
    rows = segments(spark)
    store.append("segments", rows)
    small = (50.0, 10.0, 51.0, 12.0)
    every, met = store.files("segments").count(), store.files("segments", box(*small)).count()
    assert every == 16 and met <= 4
    want = sorted(r.id for r in rows.where(boxes_meet(*small)).collect())
    found = store.read("segments", box(*small))
    assert len(found.inputFiles()) == met and sorted(r.id for r in found.where(boxes_meet(*small)).collect()) == want and want
    assert store.files("segments", box(-80, -170, -70, -160)).count() == 0
    assert store.files("segments", between("start_ts_ms", -9, -1, nulls=True)).count() < every  # undated ones stand together, as they have no box
    assert store.highest("segments", "tracks") == {"segments": 3999, "tracks": 0}


def test_the_curve(spark):
    cells = [(-90 + (i + 0.5) * 180 / 16, -180 + (j + 0.5) * 360 / 16) for i in range(16) for j in range(16)]
    rows = spark.createDataFrame(cells, "lat double, lon double").withColumn("d", hilbert(F.col("lat"), F.col("lon"), 4)).collect()
    order = sorted(rows, key=lambda r: r.d)
    assert [r.d for r in order] == list(range(256))
    for p, q in zip(order, order[1:]):  # each cell is beside the one before
        assert abs(p.lat - q.lat) * 16 / 180 + abs(p.lon - q.lon) * 16 / 360 == pytest.approx(1)
    odd = spark.createDataFrame([(1e9, -1e9), (90.0, -180.0), (None, 1.0)], "lat double, lon double").select(hilbert(F.col("lat"), F.col("lon"))).collect()
    assert odd[0][0] == odd[1][0] and odd[2][0] is None


def test_changes_rewrite_only_the_files_that_hold_them(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), parts=8)
    points = spark.range(8000).select(F.col("id").alias("segment_id"), F.lit(0).alias("seq"), F.lit(1).alias("ts_ms"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"), F.lit(None).cast("double").alias("ele"), F.lit(0).alias("flag"))
    store.append("points", points.withColumn("segment_id", F.col("segment_id") * 10))
    ids = spark.createDataFrame([(41_000,), (41_010,)], "id long")
    rows, paths = store.holding("points", "segment_id", ids)
    assert 1 <= len(paths) <= 2
    before = {r.path for r in store.files("points").collect()}
    store.commit(instead={"points": (rows.join(ids.withColumnRenamed("id", "segment_id"), "segment_id", "left_anti"), paths)})
    after = {r.path for r in store.files("points").collect()}
    assert before - after == set(paths) and store.read("points").count() == 7998
    assert store.read("points").where("segment_id IN (41000, 41010)").count() == 0
    store.append("points", points.limit(3))
    assert store.read("points").count() == 8001
    store.compact("points")
    assert store.read("points").count() == 8001 and len(store.versions()["points"]) == 1


def test_a_store_of_the_first_version_opens(spark, tmp_path):
    root = str(tmp_path / "store")
    old = spark.createDataFrame([(2, 1, 5), (1, 2, 7), (3, 3, 1), (3, 4, 2)], TABLES["rail_edges"])
    old.write.parquet(f"{root}/v1/rail_edges")
    spark.createDataFrame([(1, "a")], TABLES["places"]).write.parquet(f"{root}/v1/places")
    log = [(1, "rail_edges", 1, False), (1, "places", 1, True)]
    spark.createDataFrame(log, "version long, name string, schema_version int, adds boolean").write.parquet(f"{root}/log")
    store = Store(spark, root)
    edges = lambda: sorted(map(tuple, store.read("rail_edges").collect()))
    assert edges() == [(1, 2, 7), (3, 4, 2)] and store.read("places").count() == 1
    store.append("rail_edges", spark.createDataFrame([(4, 9, 1)], TABLES["rail_edges"]))
    assert edges() == [(1, 2, 7), (3, 4, 2), (4, 9, 1)]
    store.compact()
    assert edges() == [(1, 2, 7), (3, 4, 2), (4, 9, 1)]
    assert {r.schema_version for t in ("rail_edges", "places") for r in store.files(t).collect()} == {SCHEMA_VERSION}
    assert spark.read.parquet(f"{root}/v3/rail_edges").count() == 3


def export(folder, name, day, lats, visit=None):
    at = lambda i: f"2024-01-{day:02d}T10:{i:02d}:00Z"
    pts = "".join(f'<trkpt lat="{lat}" lon="2"><time>{at(i)}</time></trkpt>' for i, lat in enumerate(lats))
    wpt = f'<wpt lat="1" lon="2"><time>{at(5)}</time><name>{visit}</name></wpt>' if visit else ""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(f'<gpx version="1.1">{wpt}<trk><type>walking</type><trkseg>{pts}</trkseg></trk></gpx>')
    return folder


def day_window(day):
    start = (19_723 + day - 1) * DAY  # 2024-01-01 is day 19723
    return start, start + DAY - 1


def test_an_overwrite_of_one_day_writes_only_that_days_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for day in (1, 2):
        ingest.import_files(store, gpx.read(spark, str(export(tmp_path / f"d{day}", f"{day}.gpx", day, [1 + i * 1e-5 for i in range(4)], f"P{day}"))))
    tables = ("segments", "points", "levels", "visits", "tracks")
    before = {t: {r.path for r in store.files(t).collect()} for t in tables}
    late = gpx.read(spark, str(export(tmp_path / "again", "2b.gpx", 2, [1.5 + i * 1e-5 for i in range(6)], "Q2")))
    got = ingest.import_files(store, late, overwrite=[day_window(2)])
    assert (got.files, got.segments, got.points, got.visits) == (1, 1, 6, 1)
    for t in ("segments", "visits"):  # ids are told apart by blocks, which such small tables share; times aren't
        gone = before[t] - {r.path for r in store.files(t).collect()}
        assert len(gone) == 1 and all(path.startswith("v2/") for path in gone)
    first, _ = day_window(1)
    segs = sorted((r.start_ts_ms, r.point_count, r.id) for r in store.read("segments").collect())
    assert [r[:2] for r in segs] == [(first + 36_000_000, 4), (first + DAY + 36_000_000, 6)]
    by = {r.segment_id: r.n for r in store.read("points").groupBy("segment_id").agg(F.count("*").alias("n")).collect()}
    assert by == {r[2]: r[1] for r in segs} and {r.segment_id for r in store.read("levels").collect()} == set(by)
    assert sorted(r.name for r in store.read("visits").collect()) == ["P1", "Q2"] and store.read("tracks").count() == 2
    assert sorted((r.segment_count, r.point_count, r.visit_count) for r in store.read("files").collect()) == [(1, 4, 1), (1, 6, 1)]
    assert ingest.clear_windows(store, [(5, 4), (None, 3)]) is None
    ingest.clear_windows(store, [day_window(1)])
    left = store.read("files").collect()
    assert [(r.segment_count, r.visit_count) for r in left] == [(1, 1)] and store.read("points").count() == 6


def test_a_window_takes_part_of_a_file(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    d = export(tmp_path / "in", "1.gpx", 1, [1.0, 1.00001])
    one = (d / "1.gpx").read_text()
    (d / "1.gpx").write_text(one.replace("</gpx>", "") + one.split("</wpt>")[-1].split('"1.1">')[-1].replace("2024-01-01", "2024-01-09"))
    ingest.import_files(store, gpx.read(spark, str(d)))
    assert store.read("segments").count() == 2
    ingest.clear_windows(store, [day_window(9)])
    row = store.read("files").first()
    assert (row.track_count, row.segment_count, row.point_count) == (1, 1, 2) and store.read("tracks").count() == 1 and store.read("points").count() == 2


def test_late_exports_replace_what_they_cover(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    run = lambda: stream.import_stream(stream.arriving(spark, str(folder)), store, str(tmp_path / "cp"), overwrite=ingest.spans).awaitTermination(200)
    export(folder, "1.gpx", 1, [1.0, 1.00001, 1.00002])
    export(folder, "2.gpx", 2, [1.0, 1.00001])
    run()
    assert store.read("points").count() == 5
    export(folder, "1-late.gpx", 1, [1.1, 1.10001, 1.10002, 1.10003])  # covers more of the first day
    run()
    assert sorted(r.point_count for r in store.read("segments").collect()) == [2, 4] and store.read("points").count() == 6
    assert sorted(r.point_count for r in store.read("files").collect()) == [2, 4]


def test_spans(spark, tmp_path):
    export(tmp_path / "in", "1.gpx", 1, [1.0, 1.1], "P")
    (tmp_path / "in" / "bad.gpx").write_text("<no/>")
    (tmp_path / "in" / "undated.gpx").write_text('<gpx version="1.1"><trk><trkseg><trkpt lat="1" lon="1"/></trkseg></trk></gpx>')
    start, _ = day_window(1)
    assert ingest.spans(gpx.read(spark, str(tmp_path / "in"))) == [(start + 36_000_000, start + 36_300_000)]
    assert ingest.merged_windows([(5, 9), (1, 2), (8, 12), (7, 3), (None, 1)]) == [(1, 2), (5, 12)]
