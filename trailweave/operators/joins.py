"""Joins by place and time: nearest within a radius, pairs within a radius, containment, similar tracks, passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import haversine_m
from ..session import cut

#: About so many nodes of one place meet others as one; pairs that a task spells out, and the most tasks.
SPOT, PAIRS_A_TASK, MOST_TASKS = 1000, 1 << 21, 20_000


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def around(x: Column, reach: int = 1) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: x + d))


def nearest_within(left: DataFrame, right: DataFrame, radius: float, keys: list[str], id_col: str) -> DataFrame:
    """(keys, id_col, distance): for each row of ``left`` (keys, lat, lon) the nearest of ``right`` (id_col, lat, lon) closer than
    ``radius`` degrees, the least id of equally near ones. Rows meet by grid cells as wide as the radius.
    """
    spots = right.select(F.col(id_col), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), cell(F.col("lat"), radius).alias("ci"), cell(F.col("lon"), radius).alias("cj"))
    asked = left.select(*keys, "lat", "lon", around(cell(F.col("lat"), radius)).alias("ci"), cell(F.col("lon"), radius).alias("j0"))
    asked = asked.select(*keys, "lat", "lon", "ci", around(F.col("j0")).alias("cj"))
    d2 = (F.col("lat") - F.col("r_lat")) ** 2 + (F.col("lon") - F.col("r_lon")) ** 2
    met = asked.join(spots, ["ci", "cj"]).withColumn("d2", d2).where(F.col("d2") < radius * radius)
    return met.groupBy(*keys).agg(F.min(F.struct("d2", id_col)).alias("m")).select(*keys, F.col(f"m.{id_col}").alias(id_col), F.sqrt("m.d2").alias("distance"))


def pairs_within(nodes: DataFrame, radius: float, keep: DataFrame | None = None) -> DataFrame:
    """(a, b, distance): pairs a < b of ``nodes`` (id, x, y) at most ``radius`` and more than 0 apart; not those of ``keep`` (a, b).

    Nodes at one place are grouped, SPOT or so at most, and groups meet by grid cells; only those near enough are spelled out, by as many tasks as the result needs.
    """
    nodes = nodes.where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select("id", "x", "y")
    crowd = nodes.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    dealt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SPOT)).alias("part")
    spots = cut(nodes.join(crowd, ["x", "y"]).groupBy("x", "y", dealt).agg(F.collect_list("id").alias("ids")))
    side = lambda s: spots.select(*(F.col(c).alias(s + c) for c in ("x", "y", "part", "ids")))
    keys = lambda s: [s + c for c in ("x", "y", "part")]
    lean = lambda s: side(s).select(*keys(s), F.size(f"{s}ids").alias(f"{s}n"), cell(F.col(f"{s}x"), radius).alias("ci"), cell(F.col(f"{s}y"), radius).alias("j0"))
    here = lean("a").withColumn("ci", around(F.col("ci"))).withColumn("cj", around(F.col("j0"))).drop("j0")
    d2 = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2
    once = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    met = here.join(lean("b").withColumnRenamed("j0", "cj"), ["ci", "cj"]).where(once).withColumn("d2", d2).where((F.col("d2") > 0) & (F.col("d2") <= radius * radius))
    met = cut(met.drop("ci", "cj"))
    total = met.agg(F.sum(F.col("an") * F.col("bn").cast("long"))).first()[0] or 0
    # Spots are joined as a whole; their pairs are dealt evenly before they are spelled out.
    met = met.join(side("a"), keys("a")).join(side("b"), keys("b")).repartition(min(MOST_TASKS, 1 + total // PAIRS_A_TASK), *keys("a"), *keys("b"))
    met = met.select(F.explode("aids").alias("one"), "bids", "d2").select("one", F.explode("bids").alias("other"), "d2").where("one <> other")
    out = met.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"), F.sqrt("d2").alias("distance"))
    return out if keep is None else out.join(keep, ["a", "b"], "left_anti")


def covered(rows: DataFrame, boxes: DataFrame, size: float = 0.25) -> DataFrame:
    """``rows`` (lat, lon and more) with ``covered``: is it in any of ``boxes`` (min_lat, min_lon, max_lat, max_lon), edges included?

    Boxes are spread over grid cells, so that rows meet only those near them.
    """
    spread = boxes.select("*", F.explode(F.sequence(cell(F.col("min_lat"), size), cell(F.col("max_lat"), size))).alias("ci"))
    spread = spread.select("*", F.explode(F.sequence(cell(F.col("min_lon"), size), cell(F.col("max_lon"), size))).alias("cj"))
    spread = spread.select("ci", "cj", *(F.col(c).alias(f"b_{c}") for c in ("min_lat", "min_lon", "max_lat", "max_lon")))
    inside = F.col("lat").between(F.col("b_min_lat"), F.col("b_max_lat")) & F.col("lon").between(F.col("b_min_lon"), F.col("b_max_lon"))
    spots = rows.select("lat", "lon").distinct().withColumns({"ci": cell(F.col("lat"), size), "cj": cell(F.col("lon"), size)})
    hit = spots.join(spread, ["ci", "cj"]).where(inside).select(F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon")).distinct()
    joined = rows.join(hit, (F.col("lat") == F.col("h_lat")) & (F.col("lon") == F.col("h_lon")), "left")
    return joined.select(*rows.columns, F.col("h_lat").isNotNull().alias("covered"))


def ends(points: DataFrame) -> DataFrame:
    """(segment_id, type, first, last): the first and last clean point of each segment as (seq, lat, lon)."""
    p = F.struct("seq", "lat", "lon")
    ok = points.where((F.col("flag") == 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return ok.groupBy("segment_id", "type").agg(F.min_by(p, "seq").alias("first"), F.max_by(p, "seq").alias("last"))


def similar(segments: DataFrame, radius_m: float, most_m: float = 5000.0) -> DataFrame:
    """(a, b): ordered pairs of segments of one type that start and end within ``radius_m`` of each other, in the same direction.

    ``segments``: ``ends``. Starts meet by grid cells of latitude; the radius is capped at ``most_m``.
    """
    radius_m = min(radius_m, most_m)
    size = radius_m / 111_000.0
    s = segments.select("segment_id", "type", "first", "last", cell(F.col("first.lat"), size).alias("c"))
    left = s.select(*(F.col(c).alias(f"l_{c}") for c in s.columns)).withColumn("c", around(F.col("l_c")))
    # Latitudes that are close enough meet; longitudes narrow by latitude, so they are compared with the pad they need there.
    pad = size / F.greatest(F.lit(0.05), F.cos(F.radians(F.col("first.lat"))))
    near = F.abs(F.col("l_first.lon") - F.col("first.lon")) <= pad
    met = left.join(s, (left["c"] == s["c"]) & (F.col("l_type") == F.col("type"))).where(near & (F.col("l_segment_id") != F.col("segment_id")))
    far = lambda e: haversine_m(F.col(f"l_{e}.lat"), F.col(f"l_{e}.lon"), F.col(f"{e}.lat"), F.col(f"{e}.lon"))
    return met.where((far("first") <= radius_m) & (far("last") <= radius_m)).select(F.col("l_segment_id").alias("a"), F.col("segment_id").alias("b"))


def passing(points: DataFrame, start: tuple[float, float], end: tuple[float, float], radius_m: float) -> DataFrame:
    """(segment_id): segments with a clean point near ``start`` (lat, lon) and a later one near ``end``."""
    near = lambda p: haversine_m(F.col("lat"), F.col("lon"), F.lit(p[0]), F.lit(p[1])) <= radius_m
    ok = points.where((F.col("flag") == 0) & F.col("lat").isNotNull())
    seen = ok.groupBy("segment_id").agg(F.min(F.when(near(start), F.col("seq"))).alias("s"), F.max(F.when(near(end), F.col("seq"))).alias("e"))
    return seen.where("s < e").select("segment_id")


def spans_meeting(files: DataFrame, rows: DataFrame, at: str, days: int = 7) -> DataFrame:
    """``files`` (path, start_ms, end_ms) joined with ``rows`` whose ``at`` lies within; spans meet rows by blocks of ``days`` days."""
    size = days * 86_400_000
    blocks = files.where("start_ms <= end_ms").withColumn("block", F.explode(F.sequence(F.floor(F.col("start_ms") / size), F.floor(F.col("end_ms") / size))))
    return blocks.join(rows.withColumn("block", F.floor(F.col(at) / size)), "block").where(F.col(at).between(F.col("start_ms"), F.col("end_ms"))).drop("block")


def neighbours_in_time(points: DataFrame, by: str = "segment_id") -> DataFrame:
    """``points`` with ``prev`` and ``next``: the nearest dated points (seq, ts_ms) before and after each."""
    w = Window.partitionBy(by).orderBy("seq")
    dated = F.when(F.col("ts_ms").isNotNull(), F.struct("seq", "ts_ms"))
    return points.withColumns({
        "prev": F.last(dated, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "next": F.first(dated, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
