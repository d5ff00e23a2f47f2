"""Viewport queries: what to draw of a box, a range of dates and a zoom, within budgets."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import DETAIL_ZOOMS, boxes_meet, overlaps
from ..session import cut
from .geometry import decimated, interleaved

DETAIL_OF_MODE = {"low": 0, "medium": 1, "high": 2, "all": "raw"}


@dataclass(frozen=True)
class Viewport:
    """A request. ``detail`` is auto, low, medium, high or all; ``snapped`` the types drawn by their matched lines."""

    min_lat: float = -90.0
    min_lon: float = -180.0
    max_lat: float = 90.0
    max_lon: float = 180.0
    since_ms: int | None = None
    until_ms: int | None = None
    zoom: float = 14.0
    detail: str = "auto"
    snapped: tuple[str, ...] = ()
    max_segments: int = 100_000
    max_points: int = 300_000
    max_pins: int = 5_000

    def padded(self, share: float = 0.15) -> Viewport:
        """The box grown by ``share`` of its sides on each side, within the world."""
        dlat, dlon = (self.max_lat - self.min_lat) * share, (self.max_lon - self.min_lon) * share
        return replace(self, min_lat=max(-90.0, self.min_lat - dlat), min_lon=max(-180.0, self.min_lon - dlon), max_lat=min(90.0, self.max_lat + dlat), max_lon=min(180.0, self.max_lon + dlon))

    @property
    def level(self) -> int | str:
        """0, 1, 2 or raw."""
        return DETAIL_OF_MODE.get(self.detail, sum(self.zoom >= z for z in DETAIL_ZOOMS))


def utc_day(day: datetime) -> tuple[int, int]:
    """The first and last millisecond of a UTC day."""
    start = datetime(day.year, day.month, day.day, tzinfo=UTC)
    a = int(start.timestamp() * 1000)
    return a, a + 86_400_000 - 1


def last_days(n: int, today: datetime) -> tuple[int, int]:
    return utc_day(today - timedelta(days=n - 1))[0], utc_day(today)[1]


def stepped(since_ms: int, until_ms: int, days: int = 7, back: bool = False) -> tuple[int, int]:
    d = days * 86_400_000 * (-1 if back else 1)
    return since_ms + d, until_ms + d


@dataclass(frozen=True)
class Drawn:
    """``rows``: (id, type, start_ts_ms, point_count, coords, matched); what was asked, shown and cut."""

    rows: DataFrame
    level: int | str
    truncated: bool
    stride: int
    points: int


def visible(segments: DataFrame, categories: DataFrame, view: Viewport) -> DataFrame:
    """Segments in the box and range of dates whose category isn't ignored. Box bounds reach the Parquet scan."""
    here = segments.where(boxes_meet(view.min_lat, view.min_lon, view.max_lat, view.max_lon))
    here = here.where(overlaps(F.col("start_ts_ms"), F.col("end_ts_ms"), view.since_ms, view.until_ms))
    return here.join(categories.where("ignored").select(F.col("name").alias("type")), "type", "left_anti")


def displayed(segments: DataFrame, levels: DataFrame, matched: DataFrame | None = None, snapped: tuple[str, ...] = ()) -> DataFrame:
    """``segments`` with each detail level's line, the matched one in its place for ``snapped`` types.

    Adds detail, coords, point_count, display_count (the unmatched line's, which orders the segment cap) and matched.
    """
    lines = levels.select(F.col("segment_id").alias("id"), "detail", F.col("point_count").alias("display_count"), F.col("coords").alias("own"))
    rows = segments.select("id", "type", "start_ts_ms").join(lines, "id")
    if matched is None or not snapped:
        return rows.select("id", "type", "start_ts_ms", "detail", F.col("own").alias("coords"), F.col("display_count").alias("point_count"), "display_count", F.lit(False).alias("matched"))
    better = matched.select(F.col("segment_id").alias("id"), "detail", F.col("point_count").alias("m_count"), F.col("coords").alias("m_coords"), F.lit(True).alias("has"))
    rows = rows.join(better, ["id", "detail"], "left")
    use = F.coalesce(F.col("has"), F.lit(False)) & F.col("type").isin(*snapped)
    return rows.select("id", "type", "start_ts_ms", "detail", F.when(use, F.col("m_coords")).otherwise(F.col("own")).alias("coords"), F.when(use, F.col("m_count")).otherwise(F.col("display_count")).alias("point_count"), "display_count", use.alias("matched"))


def level_within(counts: dict[int, int], level: int, budget: int) -> int:
    """The finest level from ``level`` down whose points fit the budget; 0 if none does."""
    while level > 0 and counts.get(level, 0) > budget:
        level -= 1
    return level


def capped(rows: DataFrame, limit: int, size: Column) -> tuple[DataFrame, bool]:
    """The ``limit`` largest rows, ties by id, and whether there were more."""
    top = cut(rows.orderBy(size.desc(), F.col("id")).limit(limit + 1))
    more = top.count() > limit
    return (cut(top.orderBy(size.desc(), F.col("id")).limit(limit)) if more else top), more


def draw(view: Viewport, segments: DataFrame, categories: DataFrame, levels: DataFrame, points: DataFrame | None = None, matched: DataFrame | None = None) -> Drawn:
    """The lines of a viewport.

    ``segments``: (id, type, start_ts_ms, end_ts_ms, clean_point_count, min_lat, …); ``levels`` and ``matched``: (segment_id, detail,
    point_count, coords); ``points``: effective points, for raw detail. Auto detail steps down until its points fit the budget; then
    the largest segments up to the cap; then every n-th vertex of each.
    """
    here = visible(segments, categories, view)
    level = view.level
    if level == "raw":
        if points is None:
            raise ValueError("raw detail needs points")
        top, more = capped(here.select("id", "type", "start_ts_ms", "clean_point_count"), view.max_segments, F.col("clean_point_count"))
        line = F.sort_array(F.collect_list(F.struct("seq", F.col("lon").alias("lon"), F.col("lat").alias("lat"))))
        raw = points.join(top.select(F.col("id").alias("segment_id")), "segment_id", "left_semi").groupBy(F.col("segment_id").alias("id")).agg(line.alias("line"))
        rows = top.join(raw.where(F.size("line") >= 2), "id").select("id", "type", "start_ts_ms", F.size("line").cast("long").alias("point_count"), interleaved(F.col("line")).cast("array<float>").alias("coords"), F.lit(False).alias("matched"))
    else:
        all_levels = displayed(here, levels, matched, view.snapped)
        if view.detail == "auto" and level:
            # One pass counts every level; only three numbers come back.
            counts = {r["detail"]: r["n"] for r in all_levels.groupBy("detail").agg(F.sum("point_count").alias("n")).collect()}
            level = level_within(counts, level, view.max_points)
        rows, more = capped(all_levels.where(F.col("detail") == level), view.max_segments, F.col("display_count"))
        rows = rows.select("id", "type", "start_ts_ms", "point_count", "coords", "matched")
    rows = cut(rows)
    total = rows.agg(F.sum("point_count")).first()[0] or 0
    stride = max(1, -(-total // view.max_points))
    if stride > 1:
        rows = rows.withColumn("coords", decimated(F.col("coords"), F.lit(stride))).withColumn("point_count", (F.size("coords") / 2).cast("long"))
    return Drawn(rows, level, more, stride, total)


def category_list(segments: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category with its segments and points, in drawing order: shown before ignored, by priority, then by number, then by name."""
    n = segments.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("segment_count"), F.sum("point_count").alias("n_points"))
    out = categories.join(n, "name", "left").fillna(0, ["segment_count", "n_points"])
    return out.orderBy("ignored", F.asc_nulls_last("priority"), F.desc("segment_count"), "name")


def summary(files: DataFrame, tracks: DataFrame, segments: DataFrame, visits: DataFrame) -> DataFrame:
    """One row: counts of files, tracks, segments, points and visits; first and last time; outer bounds."""
    of = segments.agg(
        F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("point_count"), F.lit(0)).alias("points"), F.min("start_ts_ms").alias("start_ts_ms"), F.max("end_ts_ms").alias("end_ts_ms"),
        *(f(c).alias(c) for c, f in (("min_lat", F.min), ("min_lon", F.min), ("max_lat", F.max), ("max_lon", F.max))),
    )
    for name, table in (("files", files), ("tracks", tracks), ("visits", visits)):
        of = of.join(table.agg(F.count(F.lit(1)).alias(name)), how="cross")  # one row each
    return of


def of_visible_types(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Drawn ``rows`` (type, …) whose category is switched on; ``categories``: (name, visible). Rows drawn once are filtered, not asked for anew."""
    return rows.join(categories.where("visible").select(F.col("name").alias("type")), "type", "left_semi")


def place_count(visits: DataFrame, places: DataFrame) -> DataFrame:
    """One row, ``places``: merged places, names of other visits, and other visits without a name."""
    loose, named = F.col("place_id").isNull(), F.coalesce(F.col("name") != "", F.lit(False))
    of = visits.agg(F.count_distinct(F.when(loose & named, F.col("name"))).alias("named"), F.count_if(loose & ~named).alias("unnamed"))
    return of.join(places.agg(F.count(F.lit(1)).alias("merged")), how="cross").select((F.col("merged") + F.col("named") + F.col("unnamed")).alias("places"))  # one row each


def dataset_stats(files: DataFrame, tracks: DataFrame, segments: DataFrame, visits: DataFrame, places: DataFrame) -> dict[str, DataFrame]:
    """All that describes a dataset: rows of totals and of places, segments and visits by year, and the places with the most visits."""
    from .places import top_places, year_counts

    return {
        "summary": summary(files, tracks, segments, visits), "places": place_count(visits, places), "segment_years": year_counts(segments.withColumn("ts_ms", F.col("start_ts_ms"))),
        "visit_years": year_counts(visits), "top_places": top_places(visits, places),
    }
