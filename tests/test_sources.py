"""Documents in, tables out; codecs, stores, extracts, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.operators import network as N
from trailweave.plans import ingest
from trailweave.sources import codec, gpx, osm
from trailweave.sources.store import Settings, Store
from trailweave.streaming import tracks as stream


def point(lat, lon, time=None):
    return f'<trkpt lat="{lat}" lon="{lon}">' + (f"<time>{time}</time>" if time else "") + "</trkpt>"


def track(type_, *segments, name=""):
    body = "".join(f"<trkseg>{''.join(s)}</trkseg>" for s in segments)
    return f"<trk><name>{name}</name>" + (f"<type>{type_}</type>" if type_ is not None else "") + body + "</trk>"


def document(*parts):
    return '<?xml version="1.0"?><gpx version="1.1">' + "".join(parts) + "</gpx>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("gpx")
    t = lambda s: f"2000-01-03T10:00:{s:02d}Z"
    walk = [point(1 + i * 1e-5, 2, t(i)) for i in range(5)]
    car = [point(1, 2, t(0)), point(1, 2, t(0)), point(1.0001, 2, t(1))]
    metro = [point(1, 2, t(0)), point(3, 2, t(1)), point(1.0001, 2, t(2))]
    visits = '<wpt lat="1" lon="2"><time>2000-01-03T10:00:00Z</time><name>Alpha</name></wpt><wpt lat="x" lon="2"/>'
    (d / "2000-W01-a.gpx").write_text(document(track("Walking", walk, []), track("car", car), track("metro", metro), track(None, [point(95, 2), point(1, 2)]), visits))
    (d / "sub").mkdir()
    (d / "sub" / "copy.GPX").write_text((d / "2000-W01-a.gpx").read_text())
    (d / "sub" / "bad.gpx").write_text("<notgpx></notgpx>")
    (d / "note.txt").write_text("no")
    return d


def test_import_is_idempotent_and_isolates_failures(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    files = gpx.read(spark, str(folder))
    assert files.count() == 3
    got = ingest.import_files(store, files)
    assert (got.files, got.skipped, got.failed) == (1, 1, 1)
    assert (got.tracks, got.segments, got.points, got.visits, got.flagged) == (4, 5, 13, 1, 3)
    flags = {r.type: r.flags for r in store.read("segments").where("point_count > 0").collect()}
    assert flags == {"walking": 0, "car": 2, "metro": 4, "unknown": 1}
    assert store.read("segments").where("flags = 256").count() == 1
    one = store.read("files").where("status = 'imported'").first()
    assert (one.iso_year, one.iso_week, one.point_count) == (2000, 1, 13)
    assert {r.name: r.ignored for r in store.read("categories").collect()} == {"walking": False, "car": False, "metro": False, "unknown": True}
    again = ingest.import_files(store, files)
    assert (again.files, again.skipped, again.points) == (0, 2, 0) and store.read("points").count() == 13
    over = ingest.import_files(store, files.limit(0), overwrite=[(946_893_600_000, 946_893_700_000)])
    assert over.files == 0 and store.read("segments").where("start_ts_ms IS NOT NULL").count() == 0


def test_paths_that_are_not_there_are_skipped(spark, folder):
    assert gpx.read(spark, [str(folder), str(folder) + "-no"]).count() == 3
    assert gpx.read(spark, str(folder) + "-no").count() == 0 and gpx.read(spark, str(folder / "*.gpx")).count() == 1


def test_files_stream_in_once(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        stream.import_stream(stream.arriving(spark, str(folder)), store, str(tmp_path / "cp")).awaitTermination(120)
    assert store.read("points").count() == 13


def test_a_stream_cleans_as_a_batch(spark, tmp_path):
    from trailweave.operators.clean import clean

    rows = [(s, "walking", i, i * 10_000 if i != 7 else 0, 10 + i * 1e-5, 20.0 + (1.0 if i % 6 == 5 else 0)) for s in range(3) for i in range(20)]
    pts = spark.createDataFrame(rows, "segment_id long, type string, seq long, ts_ms long, lat double, lon double")
    for k in range(2):
        pts.where((F.col("seq") < 10) if k == 0 else (F.col("seq") >= 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.cleaned(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r.segment_id, r.seq): r.flag for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.segment_id, r.seq): r.flag for r in clean(pts).collect()} and set(got.values()) == {0, 4, 8}


def test_geometry_codec_round_trip(spark):
    lines = [(7, 2010, 0, np.array([1, 2, float("nan"), float("nan"), 3, 4], dtype=np.float32)), (8, 0, 1, np.array([], dtype=np.float32))]
    types, got = codec.decode(codec.encode(["été", "car"], lines))
    assert types == ["été", "car"] and [x[:3] for x in got] == [x[:3] for x in lines]
    assert np.array_equal(got[0][3], lines[0][3], equal_nan=True)
    with pytest.raises(ValueError):
        codec.decode(b"nope")
    rows = spark.createDataFrame([(1, "car", 1_262_304_000_000, [1.0, 2.0, 3.0, 4.0]), (2, "bus", None, [0.0, 0.0])], "id long, type string, start_ts_ms long, coords array<float>")
    assert sorted((r.id, r.type, r.year, list(r.coords)) for r in codec.unpacked(codec.packed(rows)).collect()) == [(1, "car", 2010, [1, 2, 3, 4]), (2, "bus", 0, [0, 0])]


def test_extracts_become_networks(spark):
    nodes = "".join(f'{{"type":"node","id":{i},"lat":0,"lon":{i}}},' for i in range(5))
    found = osm.elements(spark, f'{{"elements":[{nodes}{{"type":"way","id":9,"nodes":[0,1,2,99,3],"tags":{{"railway":"subway"}}}}]}}')
    n, e = osm.network(found)
    assert sorted((r.a, r.b, r.kind) for r in e.collect()) == [(0, 1, 1), (1, 2, 1)] and sorted(r.id for r in n.collect()) == [0, 1, 2]
    asked = []

    def ask(url, query):
        asked.append(url)
        return (429, "") if len(asked) == 1 else (200, "{}")

    assert osm.fetch("q", ask) == "{}" and len(asked) == 2
    with pytest.raises(OSError):
        osm.fetch("q", lambda *_: (400, ""))
    with pytest.raises(ValueError):
        N.check_fetch(0, 0, 10, 1, 4.0, 0.02)


def test_regions_accumulate(spark):
    empty = [spark.createDataFrame([], s) for s in ("id long, lat double, lon double", "a long, b long, kind int", "category string, min_lat double, min_lon double, max_lat double, max_lon double, fetched_at_ms long, node_count long, edge_count long")]
    nodes = lambda ids: spark.createDataFrame([(i, 0.0, float(i)) for i in ids], "id long, lat double, lon double")
    edges = lambda es: spark.createDataFrame(es, "a long, b long, kind int")
    box = {"category": "rail", "min_lat": 0.0, "min_lon": 0.0, "max_lat": 1.0, "max_lon": 1.0, "fetched_at_ms": 1}
    one = N.added_region(*empty, nodes([1, 2, 3]), edges([(1, 2, 1), (3, 2, 1)]), box)
    two = N.added_region(*one, nodes([2, 3, 4]), edges([(2, 3, 4), (4, 3, 1), (3, 3, 1)]), box | {"max_lat": 2.0, "fetched_at_ms": 2})
    assert sorted((r.a, r.b, r.kind) for r in two[1].collect()) == [(1, 2, 1), (2, 3, 4), (3, 4, 1)]
    assert two[0].count() == 4 and [r.max_lat for r in two[2].collect()] == [2.0]


def test_settings():
    assert Settings.parse("nonsense") == Settings()
    got = Settings.parse('{"max_segments": 20000, "snap_m": 5, "transfer_m": 900, "other": 1}')
    assert (got.max_segments, got.snap_m, got.transfer_m) == (100_000, 20.0, 500.0)
    assert Settings.parse(got.dump()) == got


def test_every_query_has_a_name_and_oracles_match_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_store_adds_without_rewriting_and_compacts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    place = lambda *rows: spark.createDataFrame(rows, "id long, name string")
    assert store.read("places").count() == 0 and store.compact() is None
    store.append("places", place((1, "a")))
    store.append("places", place((2, "b")))
    assert {tuple(r) for r in store.read("places").collect()} == {(1, "a"), (2, "b")}
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "store" / "v2" / "places")).select("id").collect()] == [2]
    store.compact()
    assert store.versions() == {"places": [3]} and store.read("places").count() == 2
    store.commit(places=place((5, "e")))
    store.append("places", place((6, "f")))
    assert store.versions() == {"places": [4, 5]} and sorted(r.id for r in store.read("places").collect()) == [5, 6]
    with pytest.raises(ValueError):
        store.commit(add={"places": place((7, "g"))}, places=place((7, "g")))
    for ms in (1.0, 2.0):
        store.log_performance("q", ms, "", 0)
    assert [r.ms for r in store.recent_performance().collect()] == [2.0, 1.0]
    # Logs from before additions have no word on them.
    spark.createDataFrame([(9, "visits", 1)], "version long, name string, schema_version int").write.mode("append").parquet(str(tmp_path / "store" / "log"))
    assert store.versions()["visits"] == [9]
