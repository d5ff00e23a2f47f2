"""Drafts, splits, mergers and rebuilds on small cases with known answers."""

import math

from pyspark.sql import functions as F

from trailweave.functions import scalars as S
from trailweave.operators import drafts as D, edits as E, geometry as G, network as N, places as P, viewport as V

POINT = "segment_id long, seq long, ts_ms long, lat double, lon double, flag int"
EDIT = "segment_id long, seq double, kind string, lat double, lon double, ts_ms long"


def line(sid, n, bad=()):
    return [(sid, i, 1000 * i, 10.0 + i, 20.0, 1 if i in bad else 0) for i in range(n)]


def test_numbers_follow_the_ids_over_many_blocks(spark):
    ids = [-5000, -1, 0, 4095, 4096, 9000, 123456789]
    rows = E.numbered(spark.createDataFrame([(i,) for i in reversed(ids)], "k long"), "k", 100).collect()
    assert {r["k"]: r["new_id"] for r in rows} == {k: 100 + i for i, k in enumerate(ids)}
    assert E.numbered(spark.createDataFrame([], "k long"), "k", 1).count() == 0


def test_a_save_that_leaves_one_point_is_refused_and_keeps_the_old_draft(spark):
    points = spark.createDataFrame(line(1, 3) + line(2, 3), POINT)
    old = spark.createDataFrame([(1, 0.0, "move", 1.0, 1.0, None)], EDIT)
    edits = spark.createDataFrame([(1, 0.0, "delete", None, None, None), (1, 1.0, "delete", None, None, None), (2, 1.0, "delete", None, None, None), (9, 0.0, "delete", None, None, None)], EDIT)
    overlay, status = D.saved(points, old, edits)
    assert {tuple(r) for r in status.collect()} == {(1, "short"), (2, "saved"), (9, "unknown")}
    assert {(r["segment_id"], r["seq"], r["kind"]) for r in overlay.collect()} == {(1, 0.0, "move"), (2, 1.0, "delete")}


def test_edit_state_counts_what_the_editor_shows(spark):
    points = spark.createDataFrame(line(1, 4, bad=(3,)) + line(2, 2), POINT)
    overlay = spark.createDataFrame([(1, 3.0, "delete", None, None, None), (1, 1.0, "delete", None, None, None), (1, 0.5, "insert", 5.0, 5.0, None)], EDIT)
    got = {r["segment_id"]: r for r in D.edit_state(points, overlay).collect()}
    assert got[1].asDict() == {"segment_id": 1, "points": 4, "drawn": 3, "has_draft": True, "deleted": [1.0, 3.0]}
    assert got[2].asDict() == {"segment_id": 2, "points": 2, "drawn": 2, "has_draft": False, "deleted": []}
    assert D.edit_state(points.limit(0), overlay.limit(0)).count() == 0


def test_commit_of_all_empties_the_overlay(spark):
    points = spark.createDataFrame(line(1, 3) + line(2, 2), POINT)
    overlay = spark.createDataFrame([(1, 1.0, "delete", None, None, None)], EDIT)
    new, left, touched = D.committed(points, overlay)
    assert left.count() == 0 and [r[0] for r in touched.collect()] == [1]
    assert sorted((r["segment_id"], r["seq"], r["lat"]) for r in new.collect()) == [(1, 0, 10.0), (1, 1, 12.0), (2, 0, 10.0), (2, 1, 11.0)]


def test_typed_split_at_an_inserted_vertex(spark):
    points = spark.createDataFrame(line(1, 4) + line(2, 4) + line(3, 4) + line(4, 2), POINT)
    overlay = spark.createDataFrame([(1, 1.5, "insert", 50.0, 60.0, None)], EDIT)
    segments = spark.createDataFrame([(1, "walking"), (2, "car"), (3, "car"), (4, "car")], "id long, type string")
    categories = spark.createDataFrame([("walking",), ("car",), ("metro",)], "name string")
    cuts = spark.createDataFrame([(1, 1.5, None, "metro"), (2, 1.5, None, None), (3, 2.0, "sledge", None), (4, 1.0, None, None), (8, 1.0, None, None)], "segment_id long, at double, first_type string, second_type string")
    new, left, typed, status = D.typed_split(points, overlay, segments, cuts, categories, 100)
    assert {tuple(r) for r in status.collect()} == {(1, "split", 100), (2, "point", None), (3, "type", None), (4, "short", None), (8, "unknown", None)}
    rows = sorted((r["segment_id"], r["seq"], r["lat"], r["ts_ms"]) for r in new.where("segment_id IN (1, 100)").collect())
    assert rows == [(1, 0, 10.0, 0), (1, 1, 11.0, 1000), (1, 2, 50.0, 1500), (100, 0, 50.0, 1500), (100, 1, 12.0, 2000), (100, 2, 13.0, 3000)]
    assert new.where("segment_id IN (2, 3, 4)").count() == 10 and left.count() == 0
    assert {tuple(r) for r in typed.collect()} == {(1, "walking"), (100, "metro"), (2, "car"), (3, "car"), (4, "car")}


def test_merger_takes_the_largest_members_type_and_the_earliest_members_id(spark):
    points = spark.createDataFrame(line(1, 2) + line(2, 3) + line(3, 2) + line(4, 2), POINT)
    segments = spark.createDataFrame([(1, "car", None, 2), (2, "walking", 50, 3), (3, "car", 20, 3), (4, "car", 5, 2)], "id long, type string, start_ts_ms long, clean_point_count long")
    categories = spark.createDataFrame([("walking",), ("car",)], "name string")
    groups = spark.createDataFrame([(1, 7, None), (2, 7, None), (3, 7, None), (4, 8, None), (99, 8, None), (4, 9, "sledge"), (1, 9, "sledge")], "segment_id long, grp long, type string")
    new, kept, status = D.merged_segments(points, segments, groups, categories)
    assert {tuple(r) for r in status.collect()} == {(7, "merged", 3), (8, "few", None), (9, "type", None)}
    assert {(r["id"], r["type"]) for r in kept.collect()} == {(3, "car"), (4, "car")}
    assert [r["seq"] for r in new.where("segment_id = 3").orderBy("seq").collect()] == list(range(7))


def test_rebuild_touches_only_what_was_edited(spark):
    points = spark.createDataFrame(line(1, 3) + line(2, 3), POINT)
    levels = G.detail_levels(points)
    stale = spark.createDataFrame([(1, "car", 99, 99), (2, "car", 77, 77), (5, "car", 3, 3)], "id long, type string, point_count long, clean_point_count long")
    ids = spark.createDataFrame([(1,), (5,)], "segment_id long")
    segments, lines, matched = D.rebuilt(ids, points, stale, levels.withColumn("point_count", F.lit(0).cast("long")), levels)
    assert {tuple(r) for r in segments.collect()} == {(1, "car", 3, 3), (2, "car", 77, 77), (5, "car", None, None)}
    assert {(r["segment_id"], r["point_count"]) for r in lines.collect()} == {(1, 2), (2, 0)}
    assert {r["segment_id"] for r in matched.collect()} == {2}


def test_stamps_and_tallies(spark):
    points = spark.createDataFrame(line(1, 3) + line(2, 3) + line(3, 3, bad=(0, 1)), POINT)
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,)], "segment_id long")
    shape = points.where("segment_id = 1").select(F.col("seq").alias("k"), "lon", "lat")
    assert {tuple(r) for r in D.stamp_outcome(shape, 1, points, ids).collect()} == {(2, "applied"), (3, "skipped"), (4, "skipped")}
    assert {r["outcome"] for r in D.stamp_outcome(shape.limit(1), 1, points, ids).collect()} == {"skipped"}
    rows = spark.createDataFrame([("metro", True), ("metro", False), ("car", True)], "type string, matched boolean")
    assert tuple(D.draw_tally(rows, ("metro", "train")).first()) == (2, 1)
    shown = spark.createDataFrame([("metro", True), ("car", False)], "name string, visible boolean")
    assert V.of_visible_types(rows, shown).count() == 2


def test_lines_and_stops(spark):
    line_ = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]))
    row = spark.range(1).select(N.line_distance(F.lit(0.5), F.lit(0.25), line_, F.lit(1.0)).alias("d"), N.line_distance(F.lit(3.0), F.lit(4.0), F.slice(line_, 1, 1), F.lit(1.0)).alias("one"), N.line_distance(F.lit(0.0), F.lit(0.0), F.slice(line_, 1, 0), F.lit(1.0)).alias("none"), N.line_length(line_).alias("l"), N.line_length(F.slice(line_, 1, 1)).alias("l1")).first()
    assert row["d"] == 0.25 and row["one"] == 5.0 and row["none"] is None and row["l1"] == 0
    assert math.isclose(row["l"], 1 + math.cos(math.radians(1 / 3)))
    stops = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 0.0), (1, 2.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0)], "request long, turn double, lon double, lat double")
    vias = spark.createDataFrame([(1, 1.1, 0.6), (2, 5.0, 5.0), (3, 1.0, 1.0)], "request long, lon double, lat double")
    assert {r["request"]: r["turn"] for r in N.via_turns(stops, vias).collect()} == {1: 1.5, 2: 0.5, 3: 0.5}


def test_colours_as_hex(spark):
    given = {"hsl(0, 100%, 50%)": "#ff0000", "HSL(120,100%,25%)": "#008000", "hsl(240, 0%, 100%)": "#ffffff", "#Ab12cd": "#Ab12cd", "red": "#888888", "hsl(1.2.3, 1%, 1%)": "#888888"}
    rows = spark.createDataFrame([(c,) for c in given], "c string").select("c", S.hex_color(F.col("c")).alias("h")).collect()
    assert {r["c"]: r["h"] for r in rows} == given


def test_cleared_networks_and_tracks_as_visits(spark):
    t = spark.range(3)
    assert [x.count() for x in N.cleared(t, t, t, t)] == [0, 0, 0, 0] and N.cleared(t, t, t, t, True)[3].count() == 3
    assert not N.fetched(t.limit(0), t.limit(0)) and N.fetched(t.limit(0), t)
    segments = spark.createDataFrame([(1, 5, 2), (2, None, 2), (3, 1, 2)], "segment_id long, start_ts_ms long, place_id long")
    rows = P.tracks_as_visits(spark.createDataFrame(line(1, 3) + line(2, 1) + line(3, 1, bad=(0,)), POINT), segments, 40).collect()
    assert {(r["segment_id"], r["id"], r["lat"], r["ts_ms"]) for r in rows} == {(1, 40, 11.0, 5), (2, 41, 10.0, None)}
