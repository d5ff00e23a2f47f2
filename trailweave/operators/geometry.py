"""Polylines: simplification, detail levels, decimation, resampling, medians.

Geometry travels as ``coords``, an array of interleaved 32-bit lon, lat; a pair of NaN is a break. Whatever needs a polyline's vertices in
turn is a small array kernel under an Arrow-batched UDF; the rest is built-in array functions, windows and aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import DETAIL_TOLERANCES

COORDS = "array<float>"
#: Lines that Spark hands to Python at a time; of its default of 10,000 a worker would hold a hundred megabytes several times over.
BATCH = 1000
SAMPLE_SPACING, MOST_SAMPLES, SMOOTHING = 4.5e-4, 500, 2


def importance(xy: np.ndarray, cuts: np.ndarray, least: float) -> np.ndarray:
    """The squared tolerance below which Douglas-Peucker keeps each vertex of many lines; 0 where that is not beyond ``least``, infinity at ends.

    ``xy`` holds the lines one after the other, ``cuts`` their n + 1 bounds. A span is split at the vertex farthest from its chord (to the chord itself, not to its
    line; the first of equally far ones), whatever the tolerance, so a vertex is kept below the least distance on its way from the whole line. All
    open spans of all lines are split in one round.
    """
    out = np.zeros(len(xy))
    first, last = cuts[:-1][np.diff(cuts) > 0], cuts[1:][np.diff(cuts) > 0] - 1
    out[first] = out[last] = np.inf
    a, b, above = first, last, np.full(len(first), np.inf)
    while True:
        open_ = b - a > 1
        a, b, above = a[open_], b[open_], above[open_]
        if not len(a):
            return out
        n = b - a - 1
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        span = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(span)) - starts[span] + a[span] + 1
        cx, cy = (xy[b] - xy[a]).T
        length2 = cx * cx + cy * cy
        ox, oy = (xy[at] - xy[a][span]).T
        t = np.clip(np.divide(ox * cx[span] + oy * cy[span], length2[span], out=np.zeros(len(span)), where=length2[span] > 0), 0, 1)
        gx, gy = ox - t * cx[span], oy - t * cy[span]
        d2 = gx * gx + gy * gy
        most = np.maximum.reduceat(d2, starts)
        hits = np.flatnonzero(d2 == most[span])
        m = at[hits[np.searchsorted(span[hits], np.arange(len(a)))]]
        kept = most > least * least
        a, b, m, above = a[kept], b[kept], m[kept], np.minimum(above, most)[kept]
        out[m] = above
        a, b, above = np.concatenate([a, m]), np.concatenate([m, b]), np.concatenate([above, above])


def simplify(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that Douglas-Peucker keeps of an (n, 2) line: both ends, and what lies farther than ``tolerance`` from the chord of its span."""
    return np.flatnonzero(importance(np.asarray(xy, dtype=np.float64), np.array([0, len(xy)]), tolerance) > tolerance * tolerance)


def parts(coords: np.ndarray) -> list[np.ndarray]:
    """The (n, 2) pieces of interleaved coords between breaks."""
    xy = np.asarray(coords, dtype=np.float64).reshape(-1, 2)
    broken = np.isnan(xy).any(axis=1)
    runs = np.cumsum(broken)
    return [p for p in (xy[(runs == r) & ~broken] for r in range(int(runs[-1]) + 1 if len(runs) else 0)) if len(p)]


def joined(pieces: list[np.ndarray]) -> np.ndarray:
    """Pieces as interleaved 32-bit coords with a break between."""
    gap = np.full((1, 2), np.nan)
    rows = [x for i, p in enumerate(pieces) for x in ([gap, p] if i else [p])]
    return (np.concatenate(rows) if rows else np.zeros((0, 2))).astype(np.float32).reshape(-1)


def _small_batches(spark: SparkSession) -> None:
    """Batches of at most BATCH rows from here on: what a worker holds then doesn't follow the rows of a task."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(BATCH, now) if now > 0 else BATCH)


def simplified(coords: Column, tolerance: float) -> Column:
    """``coords`` simplified within each part."""

    @F.pandas_udf(COORDS)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda c: None if c is None else joined([p[simplify(p, tolerance)] for p in parts(c)]))

    return run(coords)


def simplified_at(coords: Column, tolerances: tuple[float, ...]) -> Column:
    """``coords`` simplified within each part, at each tolerance: an array of lines."""

    @F.pandas_udf(f"array<{COORDS}>")
    def run(lines: pd.Series) -> pd.Series:
        pieces = [None if c is None else parts(c) for c in lines]
        every = [p for line in pieces for p in line or []]
        cuts = np.concatenate([[0], np.cumsum([len(p) for p in every])]).astype(np.int64)
        weight = importance(np.concatenate(every) if every else np.zeros((0, 2)), cuts, min(tolerances))
        out, k = [], 0
        for line in pieces:
            if line is None:
                out.append(None)
                continue
            own = range(k, k := k + len(line))
            out.append([joined([p[weight[cuts[i] : cuts[i + 1]] > t * t] for i, p in zip(own, line, strict=True)]) for t in tolerances])
        return pd.Series(out, index=lines.index, dtype=object)

    return run(coords)


def polylines(points: DataFrame) -> DataFrame:
    """(segment_id, coords): the clean points of each segment in order, as 64-bit interleaved lon, lat; at least two of them."""
    line = F.sort_array(F.collect_list(F.struct("seq", "lon", "lat")))
    lines = points.where((F.col("flag") == 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("segment_id").agg(line.alias("line"))
    return lines.where(F.size("line") >= 2).select("segment_id", F.flatten(F.transform("line", lambda p: F.array(p["lon"], p["lat"]))).alias("coords"))


def detail_levels(points: DataFrame) -> DataFrame:
    """(segment_id, detail, point_count, coords): the clean line of every segment at each detail level."""
    _small_batches(points.sparkSession)
    lines = polylines(points)
    return lines.select("segment_id", F.posexplode(simplified_at(F.col("coords"), DETAIL_TOLERANCES)).alias("detail", "coords")).select("segment_id", "detail", (F.size("coords") / 2).cast("long").alias("point_count"), "coords")


def pairs(coords: Column) -> Column:
    """Interleaved coords as an array of (lon, lat)."""
    evens = F.filter(coords, lambda _, i: i % 2 == 0)
    odds = F.filter(coords, lambda _, i: i % 2 == 1)
    return F.zip_with(evens, odds, lambda x, y: F.struct(x.alias("lon"), y.alias("lat")))


def interleaved(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["lon"], p["lat"])))


def thinned(coords: np.ndarray, stride: int) -> np.ndarray:
    """Every ``stride``-th vertex of each part and its last, and all breaks. Lines of two vertices stay."""
    xy = np.asarray(coords, dtype=np.float32).reshape(-1, 2)
    if stride <= 1 or len(xy) <= 2:
        return xy.reshape(-1)
    at = np.arange(len(xy))
    broken = np.isnan(xy).any(axis=1)
    start = np.maximum.accumulate(np.where(broken, at + 1, 0))
    last = np.r_[broken[1:], True]
    return xy[broken | ((at - start) % stride == 0) | last].reshape(-1)


def decimated(coords: Column, stride: Column) -> Column:
    @F.pandas_udf(COORDS)
    def run(lines: pd.Series, strides: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else thinned(c, int(s)) for c, s in zip(lines, strides, strict=True)])

    return run(coords, stride)


def arc_length(coords: Column) -> Column:
    """Length in degrees of a line without breaks."""

    @F.pandas_udf("double")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda c: float(np.hypot(*np.diff(np.asarray(c, dtype=float).reshape(-1, 2), axis=0).T).sum()))

    return run(coords)


def resample(xy: np.ndarray, k: int) -> np.ndarray:
    """``k`` points at equal steps of arc length along an (n, 2) line; k times the first where it has no length."""
    run = np.r_[0, np.cumsum(np.hypot(*np.diff(xy, axis=0).T))]
    if run[-1] == 0:
        return np.repeat(xy[:1], k, axis=0)
    want = run[-1] * np.arange(k) / (k - 1)
    # The first vertex at or after each step; a step that rounding puts past the end belongs to the last span.
    hi = np.clip(np.searchsorted(run, want), 1, len(xy) - 1)
    span = run[hi] - run[hi - 1]
    t = np.divide(want - run[hi - 1], span, out=np.zeros(k), where=span > 0)
    return xy[hi - 1] + (xy[hi] - xy[hi - 1]) * t[:, None]


def resampled(coords: Column, k: Column, flipped: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(lines: pd.Series, ks: pd.Series, flips: pd.Series) -> pd.Series:
        return pd.Series([resample(np.asarray(c, dtype=float).reshape(-1, 2)[:: -1 if f else 1], int(k)).reshape(-1) for c, k, f in zip(lines, ks, flips, strict=True)])

    return run(coords, k, flipped)


def smooth(xy: np.ndarray, passes: int = SMOOTHING) -> np.ndarray:
    """Each inner point as half of itself and a quarter of each neighbour, as they were before the pass; the ends stay."""
    xy = np.array(xy, dtype=float)
    for _ in range(passes if len(xy) > 2 else 0):
        xy[1:-1] = (xy[:-2] + 2 * xy[1:-1] + xy[2:]) / 4
    return xy


def smoothed(coords: Column, passes: int = SMOOTHING) -> Column:
    @F.pandas_udf(COORDS)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda c: smooth(np.asarray(c, dtype=float).reshape(-1, 2), passes).reshape(-1).astype(np.float32))

    return run(coords)


def cumulative_m(points: DataFrame, by: str = "segment_id", order: str = "seq") -> DataFrame:
    """``points`` with ``metres``, the distance run to each, and ``fraction`` of the whole (0 where there is no length)."""
    from ..functions.scalars import haversine_m

    w = Window.partitionBy(by).orderBy(order)
    step = F.coalesce(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    run = points.withColumn("step_m", step).withColumn("metres", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.max("metres").over(Window.partitionBy(by))
    return run.withColumn("fraction", F.when(total > 0, F.col("metres") / total).otherwise(0.0)).drop("step_m")


def to_geojson(coords: Column) -> Column:
    """A LineString, or a MultiLineString of the parts where there are breaks; parts of one vertex are left out, null if none is left."""
    p = pairs(coords)
    text = F.aggregate(p, F.lit("").cast("string"), lambda s, q: F.concat(s, F.when(F.isnan(q["lon"]), F.lit("|")).otherwise(F.format_string("[%s,%s];", q["lon"].cast("string"), q["lat"].cast("string")))))
    lines = F.filter(F.transform(F.split(text, r"\|"), lambda part: F.filter(F.split(part, ";"), lambda v: v != "")), lambda part: F.size(part) >= 2)
    lines = F.transform(lines, lambda part: F.concat(F.lit("["), F.array_join(part, ","), F.lit("]")))
    one, many = F.concat(F.lit('{"type":"LineString","coordinates":'), F.get(lines, F.lit(0)), F.lit("}")), F.concat(F.lit('{"type":"MultiLineString","coordinates":['), F.array_join(lines, ","), F.lit("]}"))
    return F.when(F.size(lines) == 1, one).when(F.size(lines) > 1, many)


def averaged_rides(rows: DataFrame, places: DataFrame, types: tuple[str, ...] = ("metro", "tram", "train"), radius: float = 0.004) -> DataFrame:
    """Rides of the same type between the same two places drawn as one line; ``rows``: (id, type, start_ts_ms, point_count, coords).

    Returns the same columns and ``members``, the number of rides that a line stands for. Ends anchor to the nearest place closer than
    ``radius``, the least id of equally near ones. Rides that stray from the median line, and groups that don't agree, stay as they are.
    """
    from ..session import cut
    from .joins import nearest_within

    _small_batches(rows.sparkSession)
    n = F.size("coords")
    ends = rows.where(F.col("type").isin(*types) & (F.col("point_count") >= 2)).select("id", F.posexplode(F.array(F.struct(F.get("coords", F.lit(0)).alias("lon"), F.get("coords", F.lit(1)).alias("lat")), F.struct(F.get("coords", n - 2).alias("lon"), F.get("coords", n - 1).alias("lat")))).alias("end", "p"))
    ends = ends.select("id", "end", F.col("p.lon").cast("double").alias("lon"), F.col("p.lat").cast("double").alias("lat"))
    near = nearest_within(ends, places.select(F.col("id").alias("place"), "lat", "lon"), radius, ["id", "end"], "place")
    both = near.groupBy("id").agg(F.max(F.when(F.col("end") == 0, F.col("place"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("place"))).alias("b")).where("a <> b").withColumnRenamed("id", "of")
    rides = rows.join(both, F.col("id") == F.col("of")).select(*rows.columns, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (F.col("a") > F.col("b")).alias("flipped"))
    rides = cut(rides.withColumn("length", arc_length(F.col("coords"))))
    key = ["type", "lo", "hi"]
    # The upper of the two middle lengths sets the number of samples.
    upper = F.expr("-percentile_disc(0.5) WITHIN GROUP (ORDER BY -length)")
    spread = rides.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), upper.alias("usual")).where("n >= 2")
    samples = F.least(F.lit(MOST_SAMPLES), F.greatest(F.lit(2), F.floor(F.col("usual") / SAMPLE_SPACING + 0.5) + 1)).cast("int")
    rides = rides.join(spread.select(*key, samples.alias("k")), key)
    sampled = rides.select(*key, "k", "id", "start_ts_ms", resampled(F.col("coords"), F.col("k"), F.col("flipped")).alias("s"))
    at = cut(sampled.select(*key, "k", "id", "start_ts_ms", F.posexplode(pairs(F.col("s"))).alias("j", "p")).select("*", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat")).drop("p"))
    middle = at.groupBy(*key, "j").agg(F.median("lon").alias("mx"), F.median("lat").alias("my"))
    off = at.join(middle, [*key, "j"]).groupBy(*key, "id").agg(F.max(F.hypot(F.col("lon") - F.col("mx"), F.col("lat") - F.col("my"))).alias("off"))
    bar = off.groupBy(*key).agg(F.greatest(F.lit(1e-3), 3 * F.median("off")).alias("bar"))
    inside = off.join(bar, key).where(F.col("off") <= F.col("bar")).select(*key, "id")
    agreed = inside.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("least")).where("members >= 2")
    inside = cut(inside.join(agreed, key))
    line = at.join(inside.select(*key, "id"), [*key, "id"], "left_semi").groupBy(*key, "j").agg(F.median("lon").alias("lon"), F.median("lat").alias("lat"), F.max("start_ts_ms").alias("start_ts_ms"), F.max("k").alias("k"))
    line = line.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("j", "lon", "lat"))).alias("line"), F.max("start_ts_ms").alias("start_ts_ms"), F.max("k").cast("long").alias("point_count")).join(agreed, key)
    shape = smoothed(F.flatten(F.transform("line", lambda p: F.array(p["lon"], p["lat"]))))
    drawn = line.select(F.col("least").alias("id"), "type", "start_ts_ms", "point_count", shape.alias("coords"), "members")
    alone = rows.join(inside.select(F.col("id").alias("of")), F.col("id") == F.col("of"), "left_anti").select("id", "type", "start_ts_ms", "point_count", "coords", F.lit(1).cast("long").alias("members"))
    return alone.unionByName(drawn)
