"""Importing: files to clean, rolled-up, simplified tables in one commit."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import IGNORED_TYPES, category_color
from ..operators import clean as cleaning
from ..operators.geometry import detail_levels
from ..operators.joins import spans_meeting
from ..operators.places import pruned
from ..session import cut
from ..sources import gpx
from ..sources.store import Settings, Store, between


@dataclass(frozen=True)
class Imported:
    files: int
    skipped: int
    failed: int
    tracks: int
    segments: int
    points: int
    visits: int
    flagged: int


def seeded_categories(types: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` categories and those of ``types`` (type) that are new; colours of known types are kept up to date unless chosen."""
    new = types.select(F.col("type").alias("name")).distinct().join(known.select("name"), "name", "left_anti")
    rows = new.select("name", category_color(F.col("name")).alias("color"), F.lit(True).alias("visible"), F.col("name").isin(*IGNORED_TYPES).alias("ignored"), F.lit(False).alias("custom"), F.lit(None).cast("int").alias("priority"))
    fresh = known.withColumn("color", F.when(F.col("custom"), F.col("color")).otherwise(category_color(F.col("name"))))
    return fresh.unionByName(rows)


def _within(column: str, windows: list[tuple[int, int]]) -> Column:
    """If a time lies within one of the windows, both ends included; windows that aren't ones hold nothing."""
    hit = F.lit(False)
    for a, b in windows:
        hit = hit | F.col(column).between(a, b)
    return F.coalesce(hit, F.lit(False))


def merged_windows(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The windows that have an end not before their start, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for a, b in windows if a is not None and b is not None and a <= b):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cleared(store: Store, windows: list[tuple[int, int]]) -> dict[str, tuple[DataFrame, list[str]]]:
    """By table, (rows, paths): what the files that hold rows of the windows keep, and these files, for ``Store.commit``.

    Segments go that start within a window, with their points, levels, matched lines and overlays, and visits within it; tracks and files that
    are left with nothing go, others have their counts anew; places without visits go. ``files`` and ``places`` are whole tables.
    """
    windows = merged_windows(windows)
    if not windows:
        return {}
    met = lambda column: functools.reduce(lambda x, y: x | y, (between(column, a, b) for a, b in windows))
    segments, segment_files = store.meeting("segments", met("start_ts_ms"))
    visits, visit_files = store.meeting("visits", met("ts_ms"))
    gone = cut(segments.where(_within("start_ts_ms", windows)).select("id", "track_id", "file_id"))
    gone_visits = cut(visits.where(_within("ts_ms", windows)).select("id", "file_id", "place_id"))
    out = {"segments": (segments.where(~_within("start_ts_ms", windows)), segment_files), "visits": (visits.where(~_within("ts_ms", windows)), visit_files)}
    ids = gone.select("id")
    for name in ("points", "levels", "matched", "overlay"):
        rows, paths = store.holding(name, "segment_id", ids)
        out[name] = (rows.join(ids.withColumnRenamed("id", "segment_id"), "segment_id", "left_anti"), paths)
    left = store.read("segments").join(ids, "id", "left_anti")
    left_visits = store.read("visits").join(gone_visits.select("id"), "id", "left_anti")
    lost = cut(gone.select(F.col("track_id").alias("id")).distinct().join(left.select(F.col("track_id").alias("id")), "id", "left_anti"))
    tracks, track_files = store.holding("tracks", "id", lost)
    out["tracks"] = (tracks.join(lost, "id", "left_anti"), track_files)
    files = store.read("files")
    touched = gone.select("file_id").union(gone_visits.select("file_id")).distinct()
    counts = left.join(touched, "file_id", "left_semi").groupBy("file_id").agg(F.countDistinct("track_id").alias("tracks"), F.count(F.lit(1)).alias("segments"), F.sum("point_count").alias("points"))
    n_visits = left_visits.join(touched, "file_id", "left_semi").groupBy("file_id").agg(F.count(F.lit(1)).alias("visits"))
    now = touched.join(counts, "file_id", "left").join(n_visits, "file_id", "left").where("segments > 0 OR visits > 0").fillna(0, ["tracks", "segments", "points", "visits"])
    anew = {"track_count": "tracks", "segment_count": "segments", "point_count": "points", "visit_count": "visits"}
    kept = files.join(touched.withColumnRenamed("file_id", "id"), "id", "left_anti")
    changed = files.join(now.withColumnRenamed("file_id", "id"), "id").select(*(F.col(anew[c]).alias(c) if c in anew else F.col(c) for c in files.columns))
    out["files"] = (cut(kept.select(*files.columns).unionByName(changed)), [])
    if gone_visits.where("place_id IS NOT NULL").limit(1).count():
        out["places"] = (cut(pruned(store.read("places"), left_visits)), [])
    return out


def clear_windows(store: Store, windows: list[tuple[int, int]]) -> int | None:
    """Take what lies within windows of time out of ``store``, rewriting only the files that hold it; the new version, if anything was there."""
    out = cleared(store, windows)
    if not out:
        return None
    whole = {t: out.pop(t)[0] for t in ("files", "places") if t in out}
    return store.commit(instead=out, **whole)


def spans(files: DataFrame) -> list[tuple[int, int]]:
    """The windows of time that ``files`` (columns of gpx.read) cover: each file's first to last time. Files that fail or have no times cover nothing."""
    rows = gpx.spans(gpx.parsed(files).where("error IS NULL")).where("start_ms IS NOT NULL")
    return merged_windows([tuple(r) for r in rows.select("start_ms", "end_ms").distinct().collect()])


def overlaps(files: DataFrame, segments: DataFrame, visits: DataFrame) -> DataFrame:
    """(path, overlap_start_ms, overlap_end_ms, segments, visits): of each file (path, start_ms, end_ms) that meets what is there, the tightest span of the
    segments that start and the visits that are within it, and their numbers: what an overwrite would replace. Files that meet nothing are left out.
    """
    met = lambda rows, at, kind: spans_meeting(files.where("start_ms IS NOT NULL"), rows.select(F.col(at).alias("at")), "at").select("path", "at", F.lit(kind).alias("kind"))
    both = met(segments.where("start_ts_ms IS NOT NULL"), "start_ts_ms", "segment").unionByName(met(visits.where("ts_ms IS NOT NULL"), "ts_ms", "visit"))
    return both.groupBy("path").agg(F.min("at").alias("overlap_start_ms"), F.max("at").alias("overlap_end_ms"), F.count_if(F.col("kind") == "segment").alias("segments"), F.count_if(F.col("kind") == "visit").alias("visits"))


def import_files(store: Store, files: DataFrame, settings: Settings | None = None, overwrite: list[tuple[int, int]] | None = None) -> Imported:
    """Import ``files`` (columns of gpx.read) into ``store``. Content that was imported is skipped; what fails is recorded, alone.

    ``overwrite``: windows of time (ms, both ends included) whose segments and visits the new files replace.
    """
    settings = settings or Settings()
    instead = cleared(store, overwrite) if overwrite else {}
    known_files, known_categories = instead["files"][0] if "files" in instead else store.read("files"), store.read("categories")
    total = files.count()
    docs = cut(gpx.parsed(gpx.unseen(files, known_files)))
    docs = cut(gpx.with_ids(docs, {t: n + 1 for t, n in store.highest("files", "tracks", "segments", "visits").items()}))
    good = docs.where("error IS NULL")
    tracks = gpx.tracks(good).withColumn("id", F.col("track_base") + F.col("track_no"))
    rows = gpx.points(good).withColumns({"segment_id": F.col("segment_base") + F.col("segment_at"), "track_id": F.col("track_base") + F.col("track_no")})
    rows = cut(rows.select("segment_id", "track_id", "file_id", "type", "seq", "ts_ms", "lat", "lon", "ele"))
    flagged = cut(cleaning.clean(rows.where("seq IS NOT NULL"), settings.ceilings, settings.default_ceiling))
    every = flagged.unionByName(rows.where("seq IS NULL").withColumn("flag", F.lit(None).cast("int")))
    of = F.struct("segment_id", "track_id", "file_id", "type")
    segments = cut(cleaning.segment_rollup(every.withColumn("of", of), "of").select("of.*", "*").drop("of").withColumnRenamed("segment_id", "id"))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c)
    points = flagged.select("segment_id", "seq", "ts_ms", finite("lat"), finite("lon"), "ele", "flag")
    visits = cut(gpx.visits(good).select((F.col("visit_base") + F.col("visit_no")).alias("id"), "file_id", "name", "ts_ms", "lat", "lon", F.lit(None).cast("long").alias("place_id")))
    counts = segments.groupBy("file_id").agg(F.countDistinct("track_id").alias("with_segments"), F.count(F.lit(1)).alias("segment_count"), F.sum("point_count").alias("point_count"), F.min("start_ts_ms").alias("start_ts_ms"))
    n_tracks = tracks.groupBy("file_id").agg(F.count(F.lit(1)).alias("track_count"))
    n_visits = visits.groupBy("file_id").agg(F.count(F.lit(1)).alias("visit_count"))
    status = F.when(F.col("error").isNull(), "imported").otherwise("failed")
    listed = docs.join(counts, "file_id", "left").join(n_tracks, "file_id", "left").join(n_visits, "file_id", "left").withColumn("status", status)
    listed = gpx.weeks(listed).fillna(0, ["track_count", "segment_count", "point_count", "visit_count"])
    listed = listed.select(F.col("file_id").alias("id"), "path", "file_hash", "size", "status", "error", "iso_year", "iso_week", "track_count", "segment_count", "point_count", "visit_count")
    kept_files = known_files.join(docs.select("file_hash"), "file_hash", "left_anti").select(*known_files.columns)
    # The lists of files and of categories are written whole; other tables grow by what is new, and lose what a window takes.
    whole = {"files": kept_files.unionByName(listed), "categories": seeded_categories(segments, known_categories)}
    if "places" in instead:
        whole["places"] = instead["places"][0]
    levels = cut(detail_levels(points))  # the clustering samples it before it is written
    new = {
        "tracks": tracks.select("id", "file_id", F.col("track_name").alias("name"), "type"),
        "segments": segments, "points": points, "levels": levels, "visits": visits,
    }
    store.commit(add=new, instead={t: v for t, v in instead.items() if t not in whole}, **whole)
    s = segments.agg(F.count(F.lit(1)), F.coalesce(F.sum("point_count"), F.lit(0)), F.coalesce(F.sum(F.col("point_count") - F.col("clean_point_count")), F.lit(0))).first()
    n = docs.agg(F.count(F.lit(1)), F.count("error")).first()
    return Imported(n[0] - n[1], total - n[0], n[1], tracks.count(), s[0], s[1], visits.count(), s[2])
