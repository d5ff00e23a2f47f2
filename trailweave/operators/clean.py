"""Cleaning: implausible points are flagged, never deleted.

A point is compared with the last clean point before it, so that one outlier doesn't poison the next. For most segments that is just
the previous valid point, and a window tells their flags; it is right wherever it flags nothing. The rest is folded, in chunks: a
chunk's outcome depends on the point that it inherits, so all chunks are folded at once under a guess, and those whose guess turned out
wrong again, until none is. So a segment of any length is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import DEFAULT_CEILING, haversine_m, speed_ceiling, valid_position
from ..session import cut

INVALID, DUPLICATE, SPEED, TIME, EMPTY = 1, 2, 4, 8, 256
#: Metres that a position may move while the clock stands.
JITTER_M = 50.0
#: Points of a chunk: a range of seq.
CHUNK = 20_000


def _against(q: str = "q") -> Column:
    """The flag of a valid point against the clean point ``q`` (struct of lat, lon, ts_ms; null for none)."""
    lat, lon, ts = (F.col(f"{q}.{c}") for c in ("lat", "lon", "ts_ms"))
    seconds = (F.col("ts_ms") - ts) / 1000
    metres = haversine_m(lat, lon, F.col("lat"), F.col("lon"))
    same = (F.col("lat") == lat) & (F.col("lon") == lon) & F.col("ts_ms").eqNullSafe(ts)
    dated = F.when(seconds < 0, TIME).when(seconds == 0, F.when(metres > JITTER_M, TIME).otherwise(0)).when(F.try_divide(metres, seconds) > F.col("ceiling"), SPEED).otherwise(0)
    return F.when(F.col(q).isNull(), 0).when(same, DUPLICATE).when(seconds.isNull(), 0).otherwise(dated)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags of points that come chunk by chunk and in order, each chunk from the clean point that it inherits; only the last clean point is held."""
    sin, cos, radians, least = math.sin, math.cos, math.radians, JITTER_M
    chunk, has, p_lat, p_lon, p_ts = None, False, math.nan, math.nan, math.nan
    for batch in batches:
        flags: list[int] = []
        values = (batch.column(c).to_pylist() for c in ("segment_id", "chunk", "lat", "lon", "ts_ms", "flag", "ceiling", "has", "in_lat", "in_lon", "in_ts"))
        for segment, part, lat, lon, ts, flag, ceiling, in_has, in_lat, in_lon, in_ts in zip(*values, strict=True):
            if (segment, part) != chunk:
                chunk, has, p_lat, p_lon, p_ts = (segment, part), in_has, in_lat, in_lon, in_ts
            if flag == INVALID:
                flags.append(flag)
                continue
            flag = 0
            if has:
                if lat == p_lat and lon == p_lon and ts == p_ts:  # two undated points are equal, too
                    flag = DUPLICATE
                elif ts is not None and p_ts is not None:
                    seconds = (ts - p_ts) / 1000
                    if seconds < 0:
                        flag = TIME
                    else:
                        a = sin(radians(lat - p_lat) / 2) ** 2 + cos(radians(p_lat)) * cos(radians(lat)) * sin(radians(lon - p_lon) / 2) ** 2
                        metres = 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(a)))
                        if seconds == 0:
                            flag = TIME if metres > least else 0
                        elif metres / seconds > ceiling:
                            flag = SPEED
            flags.append(flag)
            if not flag:
                has, p_lat, p_lon, p_ts = True, lat, lon, ts
        kept = batch.select(["segment_id", "chunk", "seq", "ts_ms", "lat", "lon"])
        yield pa.record_batch([*kept.columns, pa.array(flags, pa.int32())], names=[*kept.schema.names, "flag"])


def clean(points: DataFrame, ceilings: Mapping[str, float] | None = None, default: float = DEFAULT_CEILING, chunk: int = CHUNK) -> DataFrame:
    """``points`` (segment_id, type, seq, ts_ms, lat, lon and more) with ``flag``: 0, or the first rule that a point breaks.

    1: no position on the globe; 2: the last clean point again; 8: the clock went back, or stood while it moved over 50 m; 4: faster
    than its type can be. Without a time on either side only 1 and 2 apply. ``seq`` is unique within a segment.
    """
    rows = points.withColumn("ceiling", speed_ceiling(F.col("type"), ceilings, default))
    rows = rows.withColumn("valid", valid_position(F.col("lat"), F.col("lon")))
    # The last valid point before a point is one of its chunk, or else the last one of the chunks before, so that no task holds a whole segment.
    rows = rows.withColumn("chunk", F.floor(F.col("seq") / chunk))
    of = rows.where("valid").groupBy("segment_id", "chunk").agg(F.max_by(F.struct("lat", "lon", "ts_ms"), "seq").alias("end"))
    chunks = rows.select("segment_id", "chunk").distinct().join(of, ["segment_id", "chunk"], "left")
    earlier = Window.partitionBy("segment_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = chunks.select(F.col("segment_id").alias("_segment"), F.col("chunk").alias("_chunk"), F.last("end", ignorenulls=True).over(earlier).alias("earlier")).where("earlier IS NOT NULL")
    before = Window.partitionBy("segment_id", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    here = F.when(F.col("valid"), F.struct("lat", "lon", "ts_ms"))
    rows = rows.withColumn("q", F.last(here, ignorenulls=True).over(before))
    rows = rows.join(ends, (F.col("segment_id") == F.col("_segment")) & (F.col("chunk") == F.col("_chunk")), "left").withColumn("q", F.coalesce("q", "earlier"))
    rows = rows.withColumn("flag", F.when(~F.col("valid"), INVALID).otherwise(_against()).cast("int"))
    rows = cut(rows.drop("q", "earlier", "_segment", "_chunk", "chunk"))
    doubtful = rows.where(F.col("flag") > INVALID).select(F.col("segment_id").alias("of")).distinct()
    sure = rows.join(doubtful, F.col("segment_id") == F.col("of"), "left_anti").select(*points.columns, "flag")
    fold = rows.join(doubtful, F.col("segment_id") == F.col("of"), "left_semi").select("segment_id", "seq", "ts_ms", "lat", "lon", "ceiling", F.when(F.col("flag") == INVALID, INVALID).otherwise(0).alias("flag"), F.floor(F.col("seq") / chunk).alias("chunk"))
    flags = _folded(fold)
    rest = rows.drop("flag").join(flags, ["segment_id", "seq"]).select(*points.columns, "flag")
    return sure.unionByName(rest)


def _folded(points: DataFrame) -> DataFrame:
    """(segment_id, seq, flag) by rounds over chunks."""
    state = points.select("segment_id", "chunk").distinct().withColumn("inherits", F.lit(None).cast("struct<lat:double,lon:double,ts:double>"))
    done, todo = None, cut(state)
    while True:
        given = points.join(todo, ["segment_id", "chunk"]).select(
            "segment_id", "chunk", "seq", F.col("ts_ms").cast("double").alias("ts_ms"), "lat", "lon", "ceiling", "flag",
            F.col("inherits").isNotNull().alias("has"), F.col("inherits.lat").alias("in_lat"), F.col("inherits.lon").alias("in_lon"), F.col("inherits.ts").alias("in_ts"),
        )
        # Many chunks stream through a task, one after the other.
        given = given.repartition("segment_id", "chunk").sortWithinPartitions("segment_id", "chunk", "seq")
        folded = given.mapInArrow(_fold, given.select("segment_id", "chunk", "seq", "ts_ms", "lat", "lon", "flag").schema)
        kept = folded.select("segment_id", "chunk", "seq", "flag", F.when(F.col("flag") == 0, F.struct("lat", "lon", F.col("ts_ms").alias("ts"))).alias("at"))
        done = cut(kept if done is None else done.join(todo, ["segment_id", "chunk"], "left_anti").unionByName(kept))
        # What each chunk hands on is its last clean point; what it inherits, the last handed on before it.
        ends = done.groupBy("segment_id", "chunk").agg(F.max_by(F.col("at"), F.when(F.col("at").isNotNull(), F.col("seq"))).alias("hands"))
        before = Window.partitionBy("segment_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        now = ends.select("segment_id", "chunk", F.last("hands", ignorenulls=True).over(before).alias("inherits"))
        wrong = now.join(state.withColumnRenamed("inherits", "was"), ["segment_id", "chunk"]).where(~F.col("inherits").eqNullSafe(F.col("was")))
        todo, state = cut(wrong.drop("was")), now
        if not todo.limit(1).count():
            return done.select("segment_id", "seq", "flag")


def segment_rollup(points: DataFrame, by: str = "segment_id") -> DataFrame:
    """Of flagged ``points``: counts, bounds and times of the clean ones, all flags together; 256 if there is no point at all.

    A segment without points is a row of nulls with seq null.
    """
    ok = (F.col("flag") == 0) & F.col("seq").isNotNull()
    clean_ = lambda f, c: f(F.when(ok, F.col(c)))
    return points.groupBy(by).agg(
        F.count("seq").alias("point_count"),
        F.count(F.when(ok, 1)).alias("clean_point_count"),
        *(clean_(f, c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")),
        clean_(F.min, "ts_ms").alias("start_ts_ms"),
        clean_(F.max, "ts_ms").alias("end_ts_ms"),
        F.when(F.count("seq") == 0, EMPTY).otherwise(F.coalesce(F.bit_or("flag"), F.lit(0))).cast("long").alias("flags"),
    )


def rollup(children: DataFrame, by: str) -> DataFrame:
    """Segments into tracks, tracks into files: sums of counts, outer bounds and times."""
    return children.groupBy(by).agg(
        F.sum("point_count").alias("point_count"), F.sum("clean_point_count").alias("clean_point_count"),
        *(f(c).alias(c) for c, f in (("min_lat", F.min), ("min_lon", F.min), ("max_lat", F.max), ("max_lon", F.max), ("start_ts_ms", F.min), ("end_ts_ms", F.max))),
        F.bit_or("flags").alias("flags"),
    )
