"""Places: clusters of visits, pins on a map, statistics, merges."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import equirectangular_m, overlaps
from ..session import cut

# Degrees within which visits are one place, and what makes a visit an outlier of its place.
RADIUS = 0.0025
OUTLIER_FACTOR, OUTLIER_FLOOR_M = 3.0, 150.0


def _greedy(visits: pd.DataFrame) -> pd.DataFrame:
    """Each visit, by id, into the first cluster whose mean is within RADIUS, or a new one."""
    visits = visits.sort_values("id", kind="stable")
    sums: list[list[float]] = []
    out = []
    for lat, lon in zip(visits["lat"].to_numpy(), visits["lon"].to_numpy(), strict=True):
        k = next((i for i, (a, o, n) in enumerate(sums) if (lat - a / n) ** 2 + (lon - o / n) ** 2 <= RADIUS * RADIUS), len(sums))
        if k == len(sums):
            sums.append([0.0, 0.0, 0])
        sums[k][0] += lat
        sums[k][1] += lon
        sums[k][2] += 1
        out.append(k)
    return visits.assign(cluster=out)[["id", "region", "cluster"]]


def clusters(visits: DataFrame) -> DataFrame:
    """(id, cluster_id): named, unmerged visits by name and greedy proximity in order of id; cluster_id is the least id of a cluster.

    ``visits``: (id, name, lat, lon). Visits of a name fall apart into regions no cluster can reach across: runs of latitude, then
    of longitude, with gaps of more than twice the radius. A region is one group, so a name used all over doesn't fill one task.
    """
    v = visits.where(F.col("name").isNotNull()).select("id", "name", "lat", "lon")
    # Means stay within what their visits span, so a gap wider than the radius is never bridged.
    for axis in ("lat", "lon"):
        keys = [c for c in ("name", "lat_run") if c in v.columns]
        size = 4 * RADIUS
        strips = v.select(*keys, F.floor(F.col(axis) / size).alias("strip")).distinct()
        w = Window.partitionBy(*keys).orderBy("strip")
        fresh = F.coalesce(F.col("strip") - F.lag("strip").over(w) > 1, F.lit(True))
        runs = strips.withColumn(f"{axis}_run", F.sum(fresh.cast("int")).over(w))
        v = v.withColumn("strip", F.floor(F.col(axis) / size)).join(runs, [*keys, "strip"]).drop("strip")
    v = v.select("id", "lat", "lon", F.xxhash64("name", "lat_run", "lon_run").alias("region"))
    found = v.groupBy("region").applyInPandas(_greedy, "id long, region long, cluster int")
    least = found.groupBy("region", "cluster").agg(F.min("id").alias("cluster_id"))
    return found.join(least, ["region", "cluster"]).select("id", "cluster_id")


def in_range(visits: DataFrame, since: int | None, until: int | None) -> DataFrame:
    return visits.where(overlaps(F.col("ts_ms"), F.col("ts_ms"), since, until))


def _pin(members: DataFrame, by: list[str]) -> DataFrame:
    """Mean position; id, time and name of the most recent visit: the latest, undated ones first of all, then the least id."""
    recent = F.struct(F.coalesce("ts_ms", F.lit(-(1 << 63))), (-F.col("id")).alias("back"))
    last = F.max_by(F.struct("id", "ts_ms", "name"), recent)
    return members.groupBy(*by).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), last.alias("m"), F.count(F.lit(1)).alias("visits")).select(
        F.col("m.id").alias("id"), F.col("m.ts_ms").alias("ts_ms"), F.col("m.name").alias("name"), "lat", "lon", "visits", *by
    )


def pins(visits: DataFrame, box: tuple[float, float, float, float], since: int | None = None, until: int | None = None, names: DataFrame | None = None) -> DataFrame:
    """One pin for each place with a visit in ``box`` (min_lat, min_lon, max_lat, max_lon) and the range of dates, both inclusive.

    Position and identity come from all visits of a place in the range, in view or not, so pins stay put while a map moves.
    ``visits``: (id, name, ts_ms, lat, lon, place_id); ``names``: (id, name) of explicit places.
    """
    dated = in_range(visits, since, until)
    inside = F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3])
    dated = cut(dated.withColumn("inside", inside))
    seen = dated.where("inside")
    blank = F.coalesce(F.col("name"), F.lit("")) == ""
    loose = seen.where(F.col("place_id").isNull() & blank)
    loose = loose.select("id", "ts_ms", F.lit(None).cast("string").alias("name"), "lat", "lon", F.lit(1).cast("long").alias("visits"))
    merged = dated.where(F.col("place_id").isNotNull()).join(seen.select("place_id").distinct(), "place_id", "left_semi")
    merged = _pin(merged, ["place_id"])
    if names is not None:
        merged = merged.join(names.select(F.col("id").alias("place_id"), F.col("name").alias("own")), "place_id", "left").withColumn("name", F.coalesce("own", "name")).drop("own")
    named = dated.where(F.col("place_id").isNull() & ~blank)
    named = named.join(named.where("inside").select("name").distinct(), "name", "left_semi")
    named = named.join(clusters(named), "id")
    shown = named.where("inside").select("cluster_id").distinct()
    clustered = _pin(named.join(shown, "cluster_id", "left_semi"), ["cluster_id"])
    columns = ["id", "ts_ms", "name", "lat", "lon", "visits"]
    return loose.select(columns).unionByName(merged.select(columns)).unionByName(clustered.select(columns))


def thin(rows: DataFrame, limit: int, span: float) -> DataFrame:
    """At most ``limit`` rows (id, ts_ms, lat, lon, …): the most recent of each cell of a grid on the world, coarsened until it fits.

    The grid has cells of 360 / 2**k degrees, k from floor(log2(360 / span * 256)) down to 0. One pass counts the cells of all k.
    """
    if limit <= 0:
        return rows.limit(0)
    rows = cut(rows)
    if rows.limit(limit + 1).count() <= limit:
        return rows
    first = max(0, math.floor(math.log2(360 / max(span, 1e-9) * 256)))
    steps = list(range(first, -1, -1))
    here = lambda k: F.struct(F.floor(F.col("lat") * (2.0**k / 360)), F.floor(F.col("lon") * (2.0**k / 360)))
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), here(k).alias("c")) for k in steps))).alias("s")).select("s.k", "s.c").distinct()
    fits = [r["k"] for r in each.groupBy("k").count().where(F.col("count") <= limit).collect()]
    k = max(fits, default=0)
    recent = F.struct(F.coalesce("ts_ms", F.lit(-(1 << 63))), (-F.col("id")).alias("back"))
    best = rows.groupBy(here(k).alias("c")).agg(F.max_by(F.struct(*rows.columns), recent).alias("r")).select("r.*")
    return best.orderBy(F.desc_nulls_last("ts_ms"), "id").limit(limit)


def members(visits: DataFrame, place_id: int | None = None, visit_id: int | None = None) -> DataFrame:
    """The visits of a place: of an explicit one, or of the cluster (or lone visit) that a visit belongs to."""
    if place_id is not None:
        return visits.where(F.col("place_id") == place_id)
    own = visits.where(F.col("id") == visit_id).select("name", "place_id").first()
    if own is None:
        return visits.limit(0)
    if own["place_id"] is not None:
        return members(visits, place_id=own["place_id"])
    if not own["name"]:
        return visits.where(F.col("id") == visit_id)
    same = visits.where((F.col("name") == own["name"]) & F.col("place_id").isNull())
    found = cut(clusters(same))
    ids = found.join(found.where(F.col("id") == visit_id).select("cluster_id"), "cluster_id", "left_semi").select("id")
    return same.join(ids, "id", "left_semi")


def outliers(visits: DataFrame, by: str) -> DataFrame:
    """``visits`` (id, lat, lon, ``by``) with ``distance_m`` from the median of their place and ``outlier``: over three times the
    median distance, and 150 m at least.
    """
    centre = visits.groupBy(F.col(by).alias("of")).agg(F.median("lat").alias("c_lat"), F.median("lon").alias("c_lon"))
    far = visits.join(centre, F.col(by) == F.col("of")).withColumn("distance_m", equirectangular_m(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon"))).drop("of")
    usual = far.groupBy(F.col(by).alias("of")).agg(F.greatest(F.lit(OUTLIER_FLOOR_M), OUTLIER_FACTOR * F.median("distance_m")).alias("bar"))
    return far.join(usual, F.col(by) == F.col("of")).withColumn("outlier", F.col("distance_m") > F.col("bar")).drop("of", "bar", "c_lat", "c_lon")


def members(visits: DataFrame, by: str) -> DataFrame:
    """``outliers`` with ``place_rank``: 1 for the visit of a place that is farthest from its middle, to the millimetre; ties by id."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("distance_m", 3)), "id")
    return outliers(visits, by).withColumn("place_rank", F.row_number().over(order))


def _dense(key: Column, n: int) -> Column:
    """A histogram over 0..n-1 as an array, zeros included."""
    return F.array(*(F.count(F.when(key == k, 1)) for k in range(n)))


def histograms(visits: DataFrame, by: str, timezone: str = "UTC") -> DataFrame:
    """Of each place: visits, first and last time, and local hours (24) and days of the week (7, from Sunday) as arrays."""
    local = F.from_utc_timestamp(F.timestamp_millis("ts_ms"), timezone)
    return visits.groupBy(by).agg(
        F.count(F.lit(1)).alias("visits"), F.min("ts_ms").alias("first_ts_ms"), F.max("ts_ms").alias("last_ts_ms"),
        _dense(F.hour(local), 24).alias("hours"), _dense(F.dayofweek(local) - 1, 7).alias("weekdays"),
    )


def year_counts(rows: DataFrame, ts: str = "ts_ms", timezone: str = "UTC") -> DataFrame:
    """(year, n): dated rows by year."""
    year = F.year(F.from_utc_timestamp(F.timestamp_millis(ts), timezone))
    return rows.where(F.col(ts).isNotNull()).groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy("year")


def distinct_places(visits: DataFrame) -> DataFrame:
    """One row: how many different names visits have, and how many different places those with a name belong to."""
    return visits.where("name <> ''").agg(F.countDistinct("name").alias("names"), F.countDistinct("place_id").alias("places"))


def top_places(visits: DataFrame, places: DataFrame, limit: int = 12) -> DataFrame:
    """The places with the most visits: explicit ones by id, others by name; ties by name in code point order."""
    merged = visits.join(places.select(F.col("id").alias("place_id"), F.col("name").alias("own")), "place_id").groupBy("place_id").agg(F.max("own").alias("name"), F.count(F.lit(1)).alias("visits"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    named = visits.where(F.col("place_id").isNull() & (F.col("name") != "")).groupBy("name").agg(F.count(F.lit(1)).alias("visits"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.max("id").alias("visit_id"))
    return merged.unionByName(named, allowMissingColumns=True).orderBy(F.desc("visits"), "name", "place_id").limit(limit)


def merged(visits: DataFrame, places: DataFrame, ids: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(visits, places) with the visits of ``ids`` (id) made one place called ``name``: the least existing place among them, or a new one.

    Places left without visits go.
    """
    name = name.strip()
    if not name:
        raise ValueError("a place needs a name")
    own = visits.join(ids, "id", "left_semi").agg(F.min("place_id")).first()[0]
    target = own if own is not None else (places.agg(F.max("id")).first()[0] or 0) + 1
    hit = ids.select(F.col("id").alias("hit")).distinct()
    moved = visits.join(hit, F.col("id") == F.col("hit"), "left").withColumn("place_id", F.when(F.col("hit").isNotNull(), F.lit(target)).otherwise(F.col("place_id"))).select(*visits.columns)
    kept = places.where(F.col("id") != target).unionByName(places.sparkSession.createDataFrame([(target, name)], "id long, name string").select(*(F.col(c).cast(t).alias(c) for c, t in places.dtypes)))
    return moved, pruned(kept, moved)


def separated(visits: DataFrame, places: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visits, places) with the visits of ``ids`` (id) taken out of their places, nameless."""
    hit = ids.select(F.col("id").alias("hit")).distinct()
    free = F.col("hit").isNotNull()
    out = visits.join(hit, F.col("id") == F.col("hit"), "left").withColumns({"place_id": F.when(~free, F.col("place_id")), "name": F.when(~free, F.col("name"))}).select(*visits.columns)
    return out, pruned(places, out)


def pruned(places: DataFrame, visits: DataFrame) -> DataFrame:
    """Places that some visit belongs to."""
    return places.join(visits.select(F.col("place_id").alias("id")), "id", "left_semi")


def track_as_visit(points: DataFrame, segment: DataFrame, place_id: int, visit_id: int) -> DataFrame:
    """(id, name, ts_ms, lat, lon, place_id): the visit that a stationary track amounts to: its clean centroid at its start."""
    ok = points.where((F.col("flag") == 0) & F.col("lat").isNotNull())
    mean = ok.groupBy("segment_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return segment.join(mean, "segment_id").select(F.lit(visit_id).cast("long").alias("id"), F.lit(None).cast("string").alias("name"), F.col("start_ts_ms").alias("ts_ms"), "lat", "lon", F.lit(place_id).cast("long").alias("place_id"))


def tracks_as_visits(points: DataFrame, segments: DataFrame, first_id: int) -> DataFrame:
    """(segment_id, id, name, ts_ms, lat, lon, place_id): a visit for every one of ``segments`` (segment_id, start_ts_ms, place_id) that
    has a clean point: the mean of these at the track's start. Ids count from ``first_id`` in order of segment_id.
    """
    from .edits import numbered

    ok = points.where((F.col("flag") == 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    mean = ok.groupBy("segment_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    rows = numbered(segments.join(mean, "segment_id"), "segment_id", first_id, "id")
    return rows.select("segment_id", "id", F.lit(None).cast("string").alias("name"), F.col("start_ts_ms").alias("ts_ms"), "lat", "lon", "place_id")
