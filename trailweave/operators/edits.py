"""The edit overlay: moves, deletes and inserts beside the raw points, and what is made of them.

An overlay row is (segment_id, seq, kind, lat, lon, ts_ms) with kind move, delete or insert and a fractional seq. Reading applies it to
clean points only; baking applies it to all. Every operator takes any number of segments at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import finite, js_round
from .geometry import cumulative_m
from .joins import neighbours_in_time

WINDOW_MS = 24 * 3600 * 1000
#: Ids are numbered by blocks of so many neighbours.
BLOCK = 4096


def numbered(ids: DataFrame, key: str, first: int, name: str = "new_id") -> DataFrame:
    """``ids`` (distinct whole numbers ``key``) with ``name``, counting from ``first`` in order of ``key``.

    Ids are ranked within blocks of BLOCK neighbours; only the blocks' sizes are summed in one window.
    """
    block = F.floor(F.col(key) / BLOCK)
    sizes = ids.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = sizes.select("block", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy(key))
    return ids.withColumn("block", block).join(start, "block").withColumn(name, (F.col("before") + rank - 1 + first).cast("long")).drop("block", "before")


def valid_overlay(overlay: DataFrame) -> DataFrame:
    """The rows of an overlay that are sound: a finite seq; for moves and inserts a position on the globe."""
    place = finite(F.col("lat")) & finite(F.col("lon")) & (F.abs("lat") <= 90) & (F.abs("lon") <= 180)
    return overlay.where(finite(F.col("seq")) & ((F.col("kind") == "delete") | (F.col("kind").isin("move", "insert") & place)))


def _merge(points: DataFrame, overlay: DataFrame) -> DataFrame:
    """(segment_id, seq, ts_ms, lat, lon, ele, flag, edit) of points and overlay by (segment_id, seq).

    What meets no point is dropped unless it is an insert; an insert that meets one is dropped, and the point stays as it is.
    """
    p = points.select("segment_id", F.col("seq").cast("double").alias("seq"), "ts_ms", "lat", "lon", *(F.col(c) if c in points.columns else F.lit(None).cast(t).alias(c) for c, t in (("ele", "double"), ("flag", "int"))), F.lit(True).alias("raw"))
    o = overlay.select("segment_id", F.col("seq").cast("double").alias("seq"), "kind", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("ts_ms").alias("o_ts"))
    both = p.join(o, ["segment_id", "seq"], "full_outer")
    raw, kind = F.coalesce(F.col("raw"), F.lit(False)), F.coalesce(F.col("kind"), F.lit(""))
    both = both.where(F.when(raw, kind != "delete").otherwise(kind == "insert"))
    moved, added = raw & (kind == "move"), ~raw
    return both.select(
        "segment_id", "seq",
        F.when(added, F.col("o_ts")).otherwise(F.col("ts_ms")).alias("ts_ms"),
        *(F.when(moved | added, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ("lat", "lon")),
        "ele", F.when(moved | added, 0).otherwise(F.col("flag")).cast("int").alias("flag"),
        F.when(moved, "move").when(added, "insert").alias("edit"),
    )


def _fill(points: pd.DataFrame) -> pd.DataFrame:
    """Times of undated inserts of one gap, in order: each by seq between the dated point before it, a filled one too, and the next."""
    points = points.sort_values("seq", kind="stable")
    ts = points["ts_ms"].astype("Float64").to_numpy(dtype=float, na_value=float("nan"))
    seq, is_insert = points["seq"].to_numpy(), (points["edit"] == "insert").to_numpy()
    last = (points["p_seq"].iloc[0], points["p_ts"].iloc[0])
    ahead = (points["n_seq"].iloc[0], points["n_ts"].iloc[0])
    for i in range(len(points)):
        if is_insert[i] and ahead[0] != last[0]:
            share = (seq[i] - last[0]) / (ahead[0] - last[0])
            ts[i] = float((last[1] + (ahead[1] - last[1]) * share + 0.5) // 1)
            last = seq[i], ts[i]
    return points.assign(filled=ts)[["segment_id", "seq", "filled"]]


def timed(points: DataFrame) -> DataFrame:
    """``points`` with times for undated inserts: by seq between their dated neighbours, rounded; none at the ends.

    One insert in a gap needs its neighbours only. Where a gap holds more, each rounded time is the next one's neighbour: those gaps
    are groups of their own.
    """
    near = neighbours_in_time(points)
    todo = (F.col("edit") == "insert") & F.col("ts_ms").isNull() & F.col("prev").isNotNull() & F.col("next").isNotNull()
    near = near.withColumn("todo", F.coalesce(todo, F.lit(False)))
    gap = Window.partitionBy("segment_id", "prev.seq", "todo")
    near = near.withColumn("n_gap", F.when(F.col("todo"), F.count(F.lit(1)).over(gap)).otherwise(0))
    share = F.try_divide(F.col("seq") - F.col("prev.seq"), F.col("next.seq") - F.col("prev.seq"))
    one = js_round(F.col("prev.ts_ms") + (F.col("next.ts_ms") - F.col("prev.ts_ms")) * share).cast("long")
    ready = near.where("n_gap <= 1").withColumn("ts_ms", F.when(F.col("todo"), one).otherwise(F.col("ts_ms"))).select(points.columns)
    many = near.where("n_gap > 1").select("segment_id", "seq", F.col("ts_ms").cast("double").alias("ts_ms"), "edit", F.col("prev.seq").alias("p_seq"), F.col("prev.ts_ms").cast("double").alias("p_ts"), F.col("next.seq").alias("n_seq"), F.col("next.ts_ms").cast("double").alias("n_ts"))
    filled = many.groupBy("segment_id", "p_seq").applyInPandas(_fill, "segment_id long, seq double, filled double")
    rest = near.where("n_gap > 1").select(points.columns).join(filled, ["segment_id", "seq"]).withColumn("ts_ms", F.nanvl("filled", F.lit(None).cast("double")).cast("long")).select(points.columns)
    return ready.unionByName(rest)


def effective_points(points: DataFrame, overlay: DataFrame) -> DataFrame:
    """(segment_id, seq, ts_ms, lat, lon, edit): clean points under the overlay; a move or delete of a flagged point does nothing."""
    ok = points.where((F.col("flag") == 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return timed(_merge(ok, overlay).select("segment_id", "seq", "ts_ms", "lat", "lon", "edit"))


def baked(points: DataFrame, overlay: DataFrame) -> DataFrame:
    """(segment_id, seq, ts_ms, lat, lon, ele, flag): all points with the overlay made permanent, numbered anew from 0.

    A flagged point that is moved is clean from then on.
    """
    merged = timed(_merge(points, overlay).select("segment_id", "seq", "ts_ms", "lat", "lon", "ele", "flag", "edit"))
    seq = F.row_number().over(Window.partitionBy("segment_id").orderBy("seq")) - 1
    return merged.select("segment_id", seq.cast("long").alias("seq"), "ts_ms", "lat", "lon", "ele", "flag")


def replaced(overlay: DataFrame, edits: DataFrame) -> DataFrame:
    """``overlay`` with the rows of the segments in ``edits`` replaced by these; ``drafts.saved`` refuses what leaves too few points."""
    return overlay.join(edits.select("segment_id").distinct(), "segment_id", "left_anti").unionByName(valid_overlay(edits))


def reverted(overlay: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``overlay`` without the rows of ``ids`` (segment_id), or of all."""
    return overlay.limit(0) if ids is None else overlay.join(ids, "segment_id", "left_anti")


def drawable(points: DataFrame, least: int = 2) -> DataFrame:
    """(segment_id): segments with at least two points to draw."""
    return points.groupBy("segment_id").count().where(F.col("count") >= least).select("segment_id")


def split(points: DataFrame, cuts: DataFrame, first_new_id: int) -> DataFrame:
    """``points`` with segments parted at ``cuts`` (segment_id, at): both halves hold the point at ``at`` and are numbered anew.

    The first half keeps the id, the second gets the next from ``first_new_id``. Cuts that leave a half with fewer than two clean
    points are not made.
    """
    at = cuts.groupBy("segment_id").agg(F.min("at").alias("at"))
    met = points.join(at, "segment_id")
    ok = (F.col("flag") == 0) & F.col("lat").isNotNull()
    sound = met.groupBy("segment_id", "at").agg(F.count(F.when(ok & (F.col("seq") <= F.col("at")), 1)).alias("a"), F.count(F.when(ok & (F.col("seq") >= F.col("at")), 1)).alias("b"), F.count(F.when(F.col("seq") == F.col("at"), 1)).alias("c"))
    sound = sound.where("a >= 2 AND b >= 2 AND c > 0").select("segment_id", "at")
    sound = numbered(sound, "segment_id", first_new_id)
    met = points.join(sound, "segment_id")
    halves = met.where(F.col("seq") <= F.col("at")).select(points.columns).unionByName(met.where(F.col("seq") >= F.col("at")).withColumn("segment_id", F.col("new_id")).select(points.columns))
    seq = F.row_number().over(Window.partitionBy("segment_id").orderBy("seq")) - 1
    return points.join(sound, "segment_id", "left_anti").unionByName(halves.withColumn("seq", seq.cast(dict(points.dtypes)["seq"])))


def stitched(points: DataFrame, segments: DataFrame, groups: DataFrame) -> DataFrame:
    """``points`` with the segments of each group made one: by start (undated last), then id; the first keeps its id.

    ``segments``: (id, start_ts_ms); ``groups``: (segment_id, grp). A group of fewer than two segments is none.
    """
    of = groups.distinct().join(segments.select(F.col("id").alias("segment_id"), "start_ts_ms"), "segment_id")
    w = Window.partitionBy("grp").orderBy(F.asc_nulls_last("start_ts_ms"), "segment_id")
    of = of.select("segment_id", F.row_number().over(w).alias("turn"), F.first("segment_id").over(w).alias("into"), F.count(F.lit(1)).over(Window.partitionBy("grp")).alias("n")).where("n >= 2")
    met = points.join(of, "segment_id")
    seq = F.row_number().over(Window.partitionBy("into").orderBy("turn", "seq")) - 1
    new = met.withColumn("seq", seq.cast(dict(points.dtypes)["seq"])).withColumn("segment_id", F.col("into")).select(points.columns)
    return points.join(of.select("segment_id"), "segment_id", "left_anti").unionByName(new)


def merge_candidates(segments: DataFrame, categories: DataFrame, at_ms: int) -> DataFrame:
    """Segments that start within a day of a time, of categories that aren't ignored, by start and id."""
    near = segments.where(F.col("start_ts_ms").between(at_ms - WINDOW_MS, at_ms + WINDOW_MS))
    return near.join(categories.where("ignored").select(F.col("name").alias("type")), "type", "left_anti").orderBy("start_ts_ms", "id")


def without(table: DataFrame, ids: DataFrame, key: str = "segment_id") -> DataFrame:
    """``table`` without the rows of ``ids`` (segment_id); unknown ids do nothing."""
    return table.join(ids.select(F.col("segment_id").alias(key)).distinct(), key, "left_anti")


def retyped(segments: DataFrame, ids: DataFrame, type_: str, categories: DataFrame) -> DataFrame:
    if not categories.where(F.col("name") == type_).limit(1).count():
        raise ValueError(f"no category {type_!r}")
    hit = ids.select(F.col("segment_id").alias("hit")).distinct()
    return segments.join(hit, F.col("id") == F.col("hit"), "left").withColumn("type", F.when(F.col("hit").isNotNull(), F.lit(type_)).otherwise(F.col("type"))).drop("hit")


def recategorised(categories: DataFrame, name: str, visible: bool | None = None, color: str | None = None, reset_color: bool = False) -> DataFrame:
    """``categories`` (name, color, custom, visible, …) with one changed; a colour is # and six hex digits, a reset takes the known one."""
    import re

    from ..functions.scalars import category_color

    if color is not None and not re.fullmatch(r"#[0-9a-fA-F]{6}", color):
        raise ValueError(f"not a colour: {color!r}")
    hit = F.col("name") == name
    out = categories
    if visible is not None:
        out = out.withColumn("visible", F.when(hit, F.lit(visible)).otherwise(F.col("visible")))
    if color is not None or reset_color:
        new = F.lit(color) if color is not None else category_color(F.col("name"))
        out = out.withColumns({"color": F.when(hit, new).otherwise(F.col("color")), "custom": F.when(hit, F.lit(color is not None)).otherwise(F.col("custom"))})
    return out


def reprioritised(categories: DataFrame, order: list[str]) -> DataFrame:
    """``categories`` with priorities by ``order``; those not named have none."""
    rows = categories.sparkSession.createDataFrame(list(enumerate(order)), "p int, of string")
    return categories.join(rows, F.col("name") == F.col("of"), "left").withColumn("priority", F.col("p")).drop("p", "of")


def layered_times(shape: DataFrame, targets: DataFrame) -> DataFrame:
    """(segment_id, k, lon, lat, ts_ms): every target's times laid on the vertices of ``shape`` (k, lon, lat).

    A vertex's share of the shape's length is looked up, piecewise linearly, on the target's curve of share of length and time.
    ``targets``: clean points (segment_id, seq, lat, lon, ts_ms). Times never go back; targets with fewer than two times that
    differ in place have none. The result holds every vertex for every target, so the shape, which has at most SHAPE_VERTICES, meets each of them.
    """
    if shape.limit(SHAPE_VERTICES + 1).count() > SHAPE_VERTICES:
        raise ValueError(f"a shape has at most {SHAPE_VERTICES} vertices")
    run = cumulative_m(targets)
    w = Window.partitionBy("segment_id")
    n = F.count(F.lit(1)).over(w)
    run = run.withColumns({"place": F.row_number().over(w.orderBy("seq")) - 1, "n": n, "total": F.max("metres").over(w)})
    share = F.when(F.col("total") > 0, F.col("fraction")).otherwise(F.try_divide(F.col("place"), F.col("n") - 1))
    # Of points at one share, the largest time.
    curve = run.where(F.col("ts_ms").isNotNull()).groupBy("segment_id", share.alias("f")).agg(F.max("ts_ms").alias("ts"))
    ahead = Window.partitionBy("segment_id").orderBy("f")
    curve = curve.withColumns({"f1": F.lead("f").over(ahead), "ts1": F.lead("ts").over(ahead), "first": F.row_number().over(ahead) == 1, "controls": F.count(F.lit(1)).over(Window.partitionBy("segment_id"))})
    on = cumulative_m(shape.withColumn("one", F.lit(1)), "one", "k").select("k", "lon", "lat", F.col("fraction").alias("g"))
    spans = curve.where("controls >= 2")
    # Every vertex falls into one span: after a control, up to the next; before the first into the first, past the last into the last.
    low = F.when(F.col("first"), F.lit(float("-inf"))).otherwise(F.col("f"))
    spans = spans.where(F.col("f1").isNotNull()).withColumns({"low": low, "last": F.lead("f1").over(ahead).isNull()})
    hit = ((F.col("g") > F.col("low")) & ((F.col("g") <= F.col("f1")) | F.col("last")))
    met = spans.join(F.broadcast(on), hit)
    t = (F.col("g") - F.col("f")) / (F.col("f1") - F.col("f"))
    ts = F.when(F.col("g") <= F.col("f"), F.col("ts")).when(F.col("g") >= F.col("f1"), F.col("ts1")).otherwise(js_round(F.col("ts") + t * (F.col("ts1") - F.col("ts"))).cast("long"))
    met = met.select("segment_id", "k", ts.alias("at"))
    upto = Window.partitionBy("segment_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    met = met.select("segment_id", "k", F.max("at").over(upto).alias("ts_ms"))
    ids = targets.select("segment_id").distinct()
    every = ids.join(F.broadcast(on.select("k", "lon", "lat")), F.lit(True))
    return every.join(met, ["segment_id", "k"], "left")


#: Vertices that a drawn shape may have: it is one polyline, given by hand, and is copied to every target.
SHAPE_VERTICES = 100_000


def stamped(shape: DataFrame, targets: DataFrame) -> DataFrame:
    """The overlay that draws ``shape`` (k, lon, lat) in place of every target's line: ends stay, clean inner points go, vertices are
    inserted just above the first point's seq with their layered times. Targets and shapes of fewer than two points give nothing.
    """
    m = shape.limit(SHAPE_VERTICES + 1).count()
    if m > SHAPE_VERTICES:
        raise ValueError(f"a shape has at most {SHAPE_VERTICES} vertices")
    w = Window.partitionBy("segment_id")
    ok = targets.withColumns({"first": F.min("seq").over(w), "last": F.max("seq").over(w)}).where("first < last")
    gone = ok.where("seq > first AND seq < last").select("segment_id", F.col("seq").cast("double").alias("seq"), F.lit("delete").alias("kind"), "lat", "lon", F.lit(None).cast("long").alias("ts_ms"))
    if m < 2:
        return gone.limit(0)
    rank = F.row_number().over(Window.partitionBy("segment_id").orderBy("k"))
    first = ok.select("segment_id", F.col("first").cast("double").alias("first")).distinct()
    new = layered_times(shape, ok.select("segment_id", "seq", "lat", "lon", "ts_ms")).join(first, "segment_id")
    new = new.select("segment_id", (F.col("first") + rank / F.lit(m + 1)).alias("seq"), F.lit("insert").alias("kind"), "lat", "lon", "ts_ms")
    return gone.unionByName(new)


def spliced(points: DataFrame, start_seq: float, end_seq: float, route: DataFrame) -> DataFrame:
    """The overlay that puts ``route`` (k, lon, lat) between two points of one segment's effective ``points``.

    Inner points of the raw track are deleted, earlier inserts vanish; vertices take seqs between the start and the end, or the next
    whole number if that comes first, so that none falls on a deleted point's.
    """
    if not end_seq > start_seq:
        raise ValueError("the ends of a splice are out of order")
    high = min(end_seq, float(int(start_seq // 1) + 1))
    inner = (F.col("seq") > start_seq) & (F.col("seq") < end_seq)
    gone = points.where(inner & F.coalesce(F.col("edit") != "insert", F.lit(True))).select("segment_id", "seq", F.lit("delete").alias("kind"), "lat", "lon", F.lit(None).cast("long").alias("ts_ms"))
    n = F.count(F.lit(1)).over(Window.partitionBy("segment_id"))
    one = points.select("segment_id").distinct()
    rows = route.join(F.broadcast(one.limit(1)), F.lit(True)).withColumn("turn", F.row_number().over(Window.partitionBy("segment_id").orderBy("k"))).withColumn("n", n)
    new = rows.select("segment_id", (F.lit(start_seq) + F.col("turn") / (F.col("n") + 1) * (high - start_seq)).alias("seq"), F.lit("insert").alias("kind"), "lat", "lon", F.lit(None).cast("long").alias("ts_ms"))
    return gone.unionByName(new)


def inserted_on_line(before: dict, after: dict, lon: float, lat: float, share: float) -> dict:
    """The overlay row of a vertex put on the line between two points: seq and time by the same share."""
    ts = None
    if before["ts_ms"] is not None and after["ts_ms"] is not None:
        ts = int((before["ts_ms"] + (after["ts_ms"] - before["ts_ms"]) * share + 0.5) // 1)
    return {"seq": before["seq"] + (after["seq"] - before["seq"]) * share, "kind": "insert", "lat": lat, "lon": lon, "ts_ms": ts}


def overlay_of(points: DataFrame, deleted: DataFrame) -> DataFrame:
    """The overlay behind edited ``points`` (…, edit) and ``deleted`` (segment_id, seq): times of inserts are kept."""
    moved = points.where(F.col("edit").isNotNull()).select("segment_id", "seq", F.col("edit").alias("kind"), "lat", "lon", F.when(F.col("edit") == "insert", F.col("ts_ms")).alias("ts_ms"))
    gone = deleted.select("segment_id", F.col("seq").cast("double").alias("seq"), F.lit("delete").alias("kind"), *(F.lit(None).cast("double").alias(c) for c in ("lat", "lon")), F.lit(None).cast("long").alias("ts_ms"))
    return moved.unionByName(gone)


def cleared_windows(segments: DataFrame, visits: DataFrame, windows: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(segments, visits) without those that start, or take place, within one of the windows (both ends included). Undated rows stay."""
    def outside(ts: str):
        hit = F.lit(False)
        for a, b in windows:
            if a is not None and b is not None and a <= b:
                hit = hit | F.col(ts).between(a, b)
        return ~F.coalesce(hit, F.lit(False))

    return segments.where(outside("start_ts_ms")), visits.where(outside("ts_ms"))
