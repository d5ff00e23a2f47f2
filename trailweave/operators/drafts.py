"""The edit surface over whole tables: drafts and their state, saves that are refused, commits, typed splits and merges, and the
derived rows that follow an edit.

Every operator takes any number of segments at once and returns new tables; what can't be done is a status on its row, not an error
that stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import edits as E
from .clean import segment_rollup
from .geometry import detail_levels

def drafts(overlay: DataFrame) -> DataFrame:
    """(segment_id): the segments with a draft, each once."""
    return overlay.select("segment_id").distinct()


def draft_count(overlay: DataFrame) -> DataFrame:
    """One row: ``drafts``, the number of segments with a draft."""
    return overlay.agg(F.countDistinct("segment_id").alias("drafts"))


def edit_state(points: DataFrame, overlay: DataFrame) -> DataFrame:
    """(segment_id, points, drawn, has_draft, deleted): of every segment its raw points, those the editor shows, and its draft.

    ``deleted`` holds the seqs that the draft takes out, in order, those of flagged points too.
    """
    raw = points.groupBy("segment_id").agg(F.count(F.lit(1)).alias("points"))
    shown = E.effective_points(points, overlay).groupBy("segment_id").agg(F.count(F.lit(1)).alias("drawn"))
    seq = F.when(F.col("kind") == "delete", F.col("seq").cast("double"))
    own = overlay.groupBy("segment_id").agg(F.sort_array(F.collect_set(seq)).alias("deleted"), F.lit(True).alias("has_draft"))
    out = raw.join(shown, "segment_id", "left").join(own, "segment_id", "left")
    none = F.array().cast("array<double>")
    return out.select("segment_id", "points", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("has_draft", F.lit(False)).alias("has_draft"), F.coalesce("deleted", none).alias("deleted"))


def saved(points: DataFrame, overlay: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overlay, status): ``edits`` put in place of the drafts of their segments; status is (segment_id, status).

    ``saved``; ``short``, if fewer than two points would be left to draw; ``unknown``, if the segment has no points. A refused segment
    keeps the draft it had.
    """
    sound = E.valid_overlay(edits)
    asked = edits.select("segment_id").distinct()
    mine = points.join(asked, "segment_id", "left_semi")
    left = E.effective_points(mine, sound).groupBy("segment_id").agg(F.count(F.lit(1)).alias("left"))
    known = mine.select("segment_id").distinct().withColumn("known", F.lit(True))
    rows = asked.join(known, "segment_id", "left").join(left, "segment_id", "left")
    verdict = F.when(F.col("known").isNull(), "unknown").when(F.coalesce("left", F.lit(0)) < 2, "short").otherwise("saved")
    status = rows.select("segment_id", verdict.alias("status"))
    taken = status.where("status = 'saved'").select("segment_id")
    return overlay.join(taken, "segment_id", "left_anti").unionByName(sound.join(taken, "segment_id", "left_semi")), status


def committed(points: DataFrame, overlay: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, overlay, touched): the drafts of ``ids`` (segment_id), or all, made permanent; other segments' points stay as they are."""
    mine = overlay if ids is None else overlay.join(ids, "segment_id", "left_semi")
    touched = drafts(mine)
    new = E.baked(points.join(touched, "segment_id", "left_semi"), mine)
    same = points.select(*(c if c in points.columns else F.lit(None).cast(t).alias(c) for c, t in new.dtypes)).join(touched, "segment_id", "left_anti")
    return same.unionByName(new), overlay.join(touched, "segment_id", "left_anti"), touched


def rebuilt(ids: DataFrame, points: DataFrame, segments: DataFrame, levels: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, levels, matched) with what derives from the points of ``ids`` (segment_id) made anew; their matched lines go.

    Only the points of ``ids`` are read; segments of ``ids`` that have no points left keep no levels.
    """
    mine = points.join(ids, "segment_id", "left_semi")
    new = segment_rollup(mine).withColumnRenamed("segment_id", "id")
    derived = [c for c in new.columns if c != "id" and c in segments.columns]
    hit = segments.join(ids.select(F.col("segment_id").alias("id")).distinct(), "id", "left_semi")
    hit = hit.drop(*derived).join(new.select("id", *derived), "id", "left").select(*segments.columns)
    rest = E.without(segments, ids, "id").select(*segments.columns)
    lines = E.without(levels, ids).select(*levels.columns).unionByName(detail_levels(mine).select(*levels.columns))
    return rest.unionByName(hit), lines, E.without(matched, ids)


def _known(name: Column, categories: DataFrame, rows: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: if ``name`` is a category or null."""
    names = categories.select(F.col("name").alias("is_name")).distinct()
    return rows.join(names, name == F.col("is_name"), "left").withColumn(flag, name.isNull() | F.col("is_name").isNotNull()).drop("is_name")


def typed_split(points: DataFrame, overlay: DataFrame, segments: DataFrame, cuts: DataFrame, categories: DataFrame, first_new_id: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(points, overlay, segments, status): segments parted at any point that the editor knows, drafts made permanent on the way.

    ``cuts``: one (segment_id, at, first_type, second_type) a segment, types null for the segment's own; ``at`` may be an inserted
    vertex's seq. Both halves hold the point at ``at`` and are numbered from 0. ``status``: (segment_id, status, new_id) with split;
    unknown; type, if a type is no category; point, if no point has that seq; short, if a half would have fewer than two clean points.
    """
    types = segments.select(F.col("id").alias("segment_id"), F.col("type").alias("old_type"))
    asked = cuts.select("segment_id", F.col("at").cast("double").alias("at"), "first_type", "second_type").join(types, "segment_id", "left")
    for c in ("first", "second"):
        asked = _known(F.col(f"{c}_type"), categories, asked, f"{c}_known")
    mine = asked.select("segment_id")
    whole = E.timed(E._merge(points.join(mine, "segment_id", "left_semi"), overlay.join(mine, "segment_id", "left_semi")).select("segment_id", "seq", "ts_ms", "lat", "lon", "ele", "flag", "edit"))
    ok = (F.col("flag") == 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    side = lambda hit: F.count(F.when(ok & hit, 1))
    counts = whole.join(asked.select("segment_id", "at"), "segment_id").groupBy("segment_id").agg(
        side(F.col("seq") <= F.col("at")).alias("low"), side(F.col("seq") >= F.col("at")).alias("high"), F.count(F.when(F.col("seq") == F.col("at"), 1)).alias("there")
    )
    asked = asked.join(counts, "segment_id", "left")
    verdict = (
        F.when(F.col("old_type").isNull(), "unknown").when(~F.col("first_known") | ~F.col("second_known"), "type")
        .when(F.coalesce("there", F.lit(0)) == 0, "point").when(F.least("low", "high") < 2, "short").otherwise("split")
    )
    asked = asked.withColumn("status", verdict)
    made = E.numbered(asked.where("status = 'split'").select("segment_id", "at", "first_type", "second_type", "old_type"), "segment_id", first_new_id)
    done = made.select("segment_id")
    met = whole.join(made.select("segment_id", "at", "new_id"), "segment_id")
    half = F.explode(F.array_compact(F.array(F.when(F.col("seq") <= F.col("at"), F.col("segment_id")), F.when(F.col("seq") >= F.col("at"), F.col("new_id")))))
    met = met.select(half.alias("of"), "seq", "ts_ms", "lat", "lon", "ele", "flag")
    seq = F.row_number().over(Window.partitionBy("of").orderBy("seq")) - 1
    new = met.select(F.col("of").alias("segment_id"), seq.cast("long").alias("seq"), "ts_ms", "lat", "lon", "ele", "flag")
    same = points.select(*(c if c in points.columns else F.lit(None).cast(t).alias(c) for c, t in new.dtypes)).join(done, "segment_id", "left_anti")
    typed = segments.join(made.select(F.col("segment_id").alias("id"), "first_type"), "id", "left").withColumn("type", F.coalesce("first_type", "type")).select(*segments.columns)
    second = segments.join(made.select(F.col("segment_id").alias("id"), "new_id", "second_type"), "id").withColumns({"id": F.col("new_id"), "type": F.coalesce("second_type", "type")}).select(*segments.columns)
    status = asked.select("segment_id", "status").join(made.select("segment_id", "new_id"), "segment_id", "left")
    return same.unionByName(new), overlay.join(done, "segment_id", "left_anti"), typed.unionByName(second), status


def usual_type(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, type): the type that a merger of each group takes unless told: its largest member's by clean points, of equal ones the first's.

    Members come by start, undated ones last, then by id. ``groups``: (segment_id, grp).
    """
    of = groups.distinct().join(segments.select(F.col("id").alias("segment_id"), "type", "start_ts_ms", "clean_point_count"), "segment_id")
    first = F.struct((-F.col("clean_point_count")).alias("n"), F.col("start_ts_ms").isNull().alias("undated"), "start_ts_ms", "segment_id")
    return of.groupBy("grp").agg(F.min_by("type", first).alias("type"))


def merged_segments(points: DataFrame, segments: DataFrame, groups: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, segments, status): the segments of each group made one of the group's type; ``groups``: (segment_id, grp, type).

    ``status``: (grp, status, segment_id) with merged and the survivor; few, if fewer than two members exist; type, if the type is no
    category. A null type is ``usual_type``'s.
    """
    usual = usual_type(segments, groups.select("segment_id", "grp")).withColumnRenamed("type", "usual")
    found = groups.select("segment_id", "grp").distinct().join(segments.select(F.col("id").alias("segment_id"), "start_ts_ms"), "segment_id")
    first = F.min_by("segment_id", F.struct(F.col("start_ts_ms").isNull().alias("undated"), "start_ts_ms", "segment_id"))
    of = groups.groupBy("grp").agg(F.max("type").alias("type")).join(found.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), first.alias("into")), "grp", "left").join(usual, "grp", "left")
    of = _known(F.col("type"), categories, of, "known")
    verdict = F.when(F.coalesce("n", F.lit(0)) < 2, "few").when(~F.col("known"), "type").otherwise("merged")
    of = of.select("grp", verdict.alias("status"), "into", F.coalesce("type", "usual").alias("type"))
    sound = of.where("status = 'merged'")
    mine = found.join(sound.select("grp", "into", F.col("type").alias("new_type")), "grp")
    line = E.stitched(points, segments.select("id", "start_ts_ms"), mine.select("segment_id", "grp"))
    gone = mine.where("segment_id <> into").select("segment_id")
    kept = E.without(segments, gone, "id").join(sound.select(F.col("into").alias("id"), F.col("type").alias("new_type")), "id", "left")
    return line, kept.withColumn("type", F.coalesce("new_type", "type")).select(*segments.columns), of.select("grp", "status", F.when(F.col("status") == "merged", F.col("into")).alias("segment_id"))


def stamp_outcome(shape: DataFrame, shape_id: int, points: DataFrame, ids: DataFrame) -> DataFrame:
    """(segment_id, outcome) of drawing the line of ``shape_id`` over ``ids`` (segment_id): applied, or skipped where either line has
    fewer than two clean points. The shape's own segment is no target.
    """
    enough = F.lit(shape.limit(2).count() == 2)
    ok = points.where((F.col("flag") == 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    targets = ids.where(F.col("segment_id") != shape_id).select("segment_id").distinct()
    n = ok.join(targets, "segment_id", "left_semi").groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))
    return targets.join(n, "segment_id", "left").select("segment_id", F.when(enough & (F.coalesce("n", F.lit(0)) >= 2), "applied").otherwise("skipped").alias("outcome"))


def matched_rides(matched: DataFrame) -> DataFrame:
    """One row: ``rides``, how many segments have a matched line."""
    return matched.agg(F.countDistinct("segment_id").alias("rides"))


def draw_tally(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row of drawn ``rows`` (type, matched): how many are of ``types``, and how many of these are drawn by their matched line."""
    mine = F.col("type").isin(*types)
    return rows.agg(F.count(F.when(mine, 1)).alias("rides"), F.count(F.when(mine & F.col("matched"), 1)).alias("snapped"))
