"""Streams whose rows come late, twice or out of order, against batches; what a recorder keeps."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailweave.operators.clean import clean
from trailweave.operators.edits import WINDOW_MS, merge_candidates
from trailweave.sources.store import Store
from trailweave.stream_queries import FAR, replayed
from trailweave.streaming import live, tracks as stream

POINT = "segment_id long, type string, seq long, ts_ms long, lat double, lon double, part int"
MINUTE = 60_000
#: A watermark starts at the epoch, so that what is not after it would be late.
BASE = 1_700_000_000_000


def rides():
    """Rides with spikes, a clock that goes back, repeats, undated points and one off the globe; a point a minute."""
    rows = []
    for s in range(4):
        for i in range(40):
            ts = BASE + i * MINUTE if i % 11 != 7 else (None if s % 2 else BASE + (i - 3) * MINUTE)
            lat = 95.0 if i == 20 else 10 + (i if i % 13 else i - 1) * 1e-5 + (1.0 if i % 9 == 5 else 0)
            rows.append((s, "walking", i, ts, lat, 20.0))
    return rows


def flags(spark, rows):
    pts = spark.createDataFrame([r[:6] for r in rows], POINT.rsplit(",", 1)[0])
    return {(r.segment_id, r.seq): r.flag for r in clean(pts).collect()}


def test_any_order_gives_the_flags_of_the_batch(spark):
    rng = np.random.default_rng(0)
    rows = rides()
    # each point comes up to two parts after its turn; undated points come with their turn
    dealt = [(*r, r[2] // 8 + int(rng.integers(0, 3))) for r in rows] + [(-1, "car", 0, FAR, 0.0, 0.0, 99)]
    got = replayed([spark.createDataFrame(dealt, POINT)], lambda p: live.reordered(p, "60 minutes")).where("segment_id >= 0").collect()
    want = flags(spark, rows)
    assert len(got) == len(want) and {(r.segment_id, r.seq): r.flag for r in got} == want
    assert set(want.values()) == {0, 1, 4, 8}


def test_what_comes_too_late_is_left_out(spark):
    rows = [(1, "walking", i, BASE + i * MINUTE, 10 + i * 1e-5, 20.0) for i in range(30)]
    late = {4, 5}
    dealt = [(*r, 2 if r[2] in late else r[2] // 16) for r in rows] + [(-1, "car", 0, FAR, 0.0, 0.0, 3)]
    got = replayed([spark.createDataFrame(dealt, POINT)], lambda p: live.reordered(p, "5 minutes")).where("segment_id >= 0").collect()
    want = flags(spark, [r for r in rows if r[2] not in late])
    assert {(r.segment_id, r.seq): r.flag for r in got} == want


def test_ready_points():
    held = lambda *rows: pd.DataFrame(rows, columns=["seq", "at_ms"], dtype=float).astype({"seq": "int64"})
    none, nan = float("-inf"), float("nan")
    assert live.ready(held((0, 5.0), (1, 6.0)), -1, none, -1) == 2  # nothing can come between
    assert live.ready(held((1, 6.0), (2, 9.0)), -1, none, 8) == 0 and live.ready(held((1, 6.0), (2, 9.0)), -1, none, 9) == 2
    assert live.ready(held((3, nan), (4, 9.0)), 1, 7.0, 8) == 0 and live.ready(held((3, nan), (4, 9.0)), 2, 7.0, 0) == 2
    assert live.ready(held((2, 1.0)), 5, 7.0, 7) == 1  # behind what has gone
    assert live.ready(held((1, nan)), -1, none, 0) == 0 and live.ready(held((1, nan), (2, nan)), -1, none, 0) == 0  # point 0 may still come
    assert live.ready(held((3, nan)), 1, 7.0, 8) == 0  # what is missing may be later than what went before
    assert live.ready(held((1, nan), (2, nan), (4, 9.0)), -1, none, 8) == 0 and live.ready(held((1, nan), (2, nan), (4, 9.0)), -1, none, 9) == 3


def test_undated_points_that_come_before_the_first(spark):
    rows = [(1, "walking", i, None if i < 3 else BASE + i * MINUTE, 10.0, 20.0) for i in range(6)]
    dealt = [(*r, 2 - r[2] if r[2] < 3 else 1) for r in rows] + [(-1, "car", 0, FAR, 0.0, 0.0, 3)]
    got = replayed([spark.createDataFrame(dealt, POINT)], lambda p: live.reordered(p, "40000 days")).where("segment_id >= 0")
    want = flags(spark, rows)
    assert got.count() == len(want) and {(r.segment_id, r.seq): r.flag for r in got.collect()} == want and want[1, 0] == 0


def test_repeats_in_a_stream(spark):
    rows = [(s, i, BASE + i * MINUTE, part) for part in range(3) for s in range(3) for i in range(part * 5, part * 5 + 10)]
    frame = spark.createDataFrame(rows + rows[:20], "segment_id long, seq long, ts_ms long, part int")
    got = replayed([frame], lambda p: live.without_repeats(p, ["segment_id", "seq"], F.timestamp_millis("ts_ms"), "30 minutes"))
    assert sorted(map(tuple, got.collect())) == sorted({r[:3] for r in rows})


def test_rides_near_anchors(spark):
    rng = np.random.default_rng(3)
    day = live.DAY_MS
    segs = [(i, ["car", "bogus", "metro"][i % 3], None if i % 17 == 0 else BASE + int(rng.integers(0, 30 * day)), int(rng.integers(0, 3))) for i in range(200)]
    segs += [(900, "car", BASE + 5 * day, 0), (901, "car", BASE + 7 * day, 2)]  # exactly a day before and after
    anchors = [(1, BASE + 6 * day, 1), (2, BASE + 6 * day + 1, 0), (3, None, 0), (4, BASE + 29 * day, 2), (5, BASE, 0)]
    cats = spark.createDataFrame([("bogus", True), ("car", False)], "name string, ignored boolean")
    s = spark.createDataFrame(segs, "id long, type string, start_ts_ms long, part int")
    a = spark.createDataFrame(anchors, "anchor long, at_ms long, part int")
    got = replayed([a, s], lambda x, y: live.near_in_time(x, y, cats, late="40 days"))
    want = {(k, r.id) for k, at, _ in anchors if at is not None for r in merge_candidates(s, cats, at).collect()}
    assert {(r.anchor, r.id) for r in got.collect()} == want and got.count() == len(want) and (1, 900) in want and (2, 900) not in want
    assert WINDOW_MS == day


class StateRows(live.Recorder):
    """Also keeps how many rows a stream's join held after each batch."""

    def __init__(self):
        super().__init__()
        self.held = []

    def onQueryProgress(self, event):
        self.held += [op.numRowsTotal for op in event.progress.stateOperators]
        super().onQueryProgress(event)


def crowd(rng, n, days=3):
    """(id, ms, part) of n rows within some days, in parts 0 and 1, and of one 400 days later in part 2."""
    return [(i, BASE + int(rng.integers(0, days * live.DAY_MS)), i % 2) for i in range(n)] + [(n, BASE + 400 * live.DAY_MS, 2)]


def near(anchors, rides):
    """By anchor, how many rides are within a day."""
    starts = np.sort([ms for _, ms, _ in rides])
    counts = {i: int(np.searchsorted(starts, ms + live.DAY_MS, "right") - np.searchsorted(starts, ms - live.DAY_MS, "left")) for i, ms, _ in anchors}
    return {i: n for i, n in counts.items() if n}


def test_many_rides_near_many_anchors_are_held_in_packs(spark):
    rng = np.random.default_rng(5)
    anchors, rides = crowd(rng, 1500), crowd(rng, 1500)
    a = spark.createDataFrame(anchors, "anchor long, at_ms long, part int")
    s = spark.createDataFrame([(i, "car", ms, part) for i, ms, part in rides], "id long, type string, start_ts_ms long, part int")
    cats = spark.createDataFrame([("bogus", True)], "name string, ignored boolean")
    recorder = StateRows()
    spark.streams.addListener(recorder)
    try:
        got = replayed([a, s], lambda x, y: live.near_in_time(x, y, cats, late="10 days"), "crowd", recorder)
    finally:
        spark.streams.removeListener(recorder)
    counts = got.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).collect()
    assert {r.anchor: r.n for r in counts} == near(anchors, rides) and all(r.ids == r.n for r in counts)
    # a row by itself would be held once as a ride and three times as an anchor; a batch's rows of a day are one
    assert 0 < max(recorder.held) < 100
    assert recorder.held[-1] <= 4  # what the watermark has passed goes


def test_packs_are_spelled_out_by_tasks_that_follow_the_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    anchors, rides = crowd(rng, 700), crowd(rng, 900)
    monkeypatch.setattr(live, "SPELLED_A_TASK", 20_000)
    a = spark.createDataFrame(anchors, "anchor long, at_ms long, part int")
    s = spark.createDataFrame([(i, "car", ms, part) for i, ms, part in rides], "id long, type string, start_ts_ms long, part int")
    cats = spark.createDataFrame([("bogus", True)], "name string, ignored boolean")
    packs = replayed([a, s], lambda x, y: live.packs_near_in_time(x, y, cats, late="500 days"))
    want = near(anchors, rides)
    out = live.spelled(live.dealt(packs))
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert {r.anchor: r["count"] for r in out.groupBy("anchor").count().collect()} == want
    assert sum(tasks) == sum(want.values()) and len(tasks) > 10 and max(tasks) < sum(tasks) / 5
    assert live.dealt(packs.limit(0)).count() == 0


def test_packs_hold_all_rows_of_a_block_by_time():
    rows = pa.RecordBatch.from_pylist([{"block": k % 3, "ms": 7919 * k % 5000, "row": {"id": k}} for k in range(5000)])
    packs = [p for b in live.packed(iter([rows, rows.slice(0, 0)])) for p in b.to_pylist()]
    assert sorted(r["id"] for p in packs for r in p["rows"]) == list(range(5000)) and len(packs) == 3 * (1 + 1666 // live.PACK)
    for p in packs:
        times = [7919 * r["id"] % 5000 for r in p["rows"]]
        assert times == sorted(times) and (p["first_ms"], p["last_ms"]) == (times[0], times[-1]) and {r["id"] % 3 for r in p["rows"]} == {p["block"]}
    assert list(live.packed(iter([rows.slice(0, 0)]))) == []


def test_a_recorder_keeps_batches(spark):
    frame = spark.createDataFrame([(i, i % 3) for i in range(30)], "n long, part int")
    recorder = live.Recorder()
    spark.streams.addListener(recorder)
    try:
        replayed([frame], lambda p: live.observed(p, "sums", total=F.sum("n")), "kept", recorder)
    finally:
        spark.streams.removeListener(recorder)
    rows = recorder.table(spark).collect()
    assert [r.kind for r in rows if r.kind != "batch"] == ["started", "done"] * 3
    seen = {r.batch: (r.rows, r.metrics["sums.rows"], r.metrics["sums.total"]) for r in rows if r.kind == "batch" and r.rows}
    assert seen == {k: (10, 10, sum(range(k, 30, 3))) for k in range(3)} and all(r.ms > 0 for r in rows if r.kind == "batch" and r.rows)
    assert recorder.taken() == []


def test_a_recorder_keeps_failures(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0)], "n long, part int")
    recorder = live.Recorder()
    spark.streams.addListener(recorder)
    try:
        with pytest.raises(Exception, match="broken on purpose"):
            replayed([frame], lambda p: p.withColumn("n", F.raise_error(F.lit("broken on purpose")).cast("long")), None, recorder)
    finally:
        spark.streams.removeListener(recorder)


def test_imports_are_observed_and_logged(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.gpx").write_text(f'<gpx version="1.1"><trk><type>car</type><trkseg><trkpt lat="1" lon="{k}"></trkpt><trkpt lat="1" lon="{k}.1"></trkpt></trkseg></trk></gpx>')
    store, recorder = Store(spark, str(tmp_path / "store")), live.Recorder()
    spark.streams.addListener(recorder)
    try:
        recorder.wait(stream.import_stream(stream.arriving(spark, str(tmp_path / "in"), 1), store, str(tmp_path / "cp")), 300)
    finally:
        spark.streams.removeListener(recorder)
    batches = [r for r in recorder.table(spark).collect() if r.kind == "batch" and r.rows]
    assert [r.metrics["files.rows"] for r in batches] == [1, 1, 1] and all(r.metrics["files.bytes"] > 100 for r in batches)
    log = store.recent_performance().collect()
    assert [(r.id, r.name, r.detail) for r in log] == [(k, "import", "files=1 skipped=0 failed=0 points=2") for k in (3, 2, 1)]
