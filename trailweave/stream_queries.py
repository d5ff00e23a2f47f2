"""Queries that run streams: the made-up points and rides arrive in parts, late, twice and in any order, and the result is that of a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .plans import tracks as T
from .queries import _FLAGS, _OK, _categories, _segments, query
from .session import cut, shared_path
from .streaming import live


def replayed(feeds: list[DataFrame], build: Callable[..., DataFrame], name: str | None = None, recorder: live.Recorder | None = None) -> DataFrame:
    """What the stream that ``build`` makes of ``feeds`` gives when all their rows have come: a batch for each value of their column ``part``, in order.

    Each part is appended to a feed's folder, by as many tasks as it has partitions, and the stream goes on from its checkpoint. Parts are few.
    """
    spark = feeds[0].sparkSession
    paths = [shared_path(spark, "arriving") for _ in feeds]
    out, state = shared_path(spark, "streamed"), shared_path(spark, "state")
    kept = [cut(f) for f in feeds]
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    try:
        for k in sorted({r[0] for f in kept for r in f.select("part").distinct().collect()}):
            for f, path in zip(kept, paths, strict=True):
                f.where(F.col("part") == k).drop("part").write.mode("append").parquet(path)
            stream = build(*(spark.readStream.schema(f.drop("part").schema).parquet(path) for f, path in zip(kept, paths, strict=True)))
            writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
            q = (writer.queryName(name) if name else writer).start()
            recorder.wait(q) if recorder else q.awaitTermination()
    finally:
        if provider is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    return spark.read.schema(stream.schema).parquet(out)


def _end(spark: SparkSession, like: DataFrame, **values) -> DataFrame:
    """One row far ahead, of no known segment, whose time lets all that is held go."""
    return spark.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in like.schema))


FAR = 4_102_444_800_000


@query("SELECT segment_id, seq, flag FROM fold", views=_FLAGS, recursive=True)
def stream_flags_any_order(spark: SparkSession, d: str) -> DataFrame:
    """Points in three parts, dealt at random, so that most come before points that precede them."""
    points = T.points(spark, d)
    dealt = points.withColumn("part", F.pmod(F.xxhash64("segment_id", "seq"), F.lit(3)))
    dealt = dealt.unionByName(_end(spark, points, segment_id=-1, type="car", seq=0, ts_ms=FAR, lat=0.0, lon=0.0).withColumn("part", F.lit(3).cast("long")))
    # the points of a part are as far from each other as the whole history is, so nothing is late before the last
    return replayed([dealt], lambda rows: live.reordered(rows, "40000 days")).where("segment_id >= 0")


@query("SELECT segment_id, lat, lon, ts_ms, count(*) AS n FROM (SELECT DISTINCT segment_id, lat, lon, ts_ms FROM pts WHERE ts_ms IS NOT NULL) GROUP BY ALL")
def stream_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Points that a second part repeats; the stream keeps each once."""
    points = T.points(spark, d).where("ts_ms IS NOT NULL").select("segment_id", "lat", "lon", "ts_ms")
    twice = points.withColumn("part", F.lit(0)).unionByName(points.where("segment_id % 3 < 2").withColumn("part", F.lit(1)))
    kept = replayed([twice], lambda rows: live.without_repeats(rows, ["segment_id", "lat", "lon", "ts_ms"], F.timestamp_millis("ts_ms"), "40000 days"))
    return kept.groupBy("segment_id", "lat", "lon", "ts_ms").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id AS anchor, at_ms, x.id_, x.type, x.start_ms FROM (SELECT id, ts_ms AS at_ms FROM wpt WHERE id % 50 = 0 AND ts_ms IS NOT NULL) a
  JOIN (SELECT id AS id_, type, start_ts_ms + (id % 20) * 86400000 AS start_ms FROM seg WHERE type NOT IN (SELECT name FROM cat WHERE ignored)) x ON x.start_ms BETWEEN a.at_ms - 86400000 AND a.at_ms + 86400000""", views=_OK)
def stream_rides_near_visits(spark: SparkSession, d: str) -> DataFrame:
    """Rides that start within a day of visits, both as streams; rides are spread over 20 days."""
    visits = T.waypoints(spark, d).where("id % 50 = 0 AND ts_ms IS NOT NULL").select(F.col("id").alias("anchor"), F.col("ts_ms").alias("at_ms"), (F.col("id") / 50 % 2).cast("int").alias("part"))
    rides = _segments(spark, d).select("id", "type", (F.col("start_ts_ms") + F.col("id") % 20 * live.DAY_MS).alias("start_ts_ms"), (F.col("id") % 3).cast("int").alias("part"))
    packs = replayed([visits, rides], lambda v, r: live.packs_near_in_time(v, r, _categories(spark), late="40000 days"))
    return live.spelled(live.dealt(packs)).withColumnRenamed("id", "id_")


@query("SELECT CAST(k AS BIGINT) AS batch, count(*) AS rows, count(*) AS points, count(ts_ms) AS dated, sum(CASE WHEN lat > 90 THEN 1 ELSE 0 END)::BIGINT AS off_globe FROM (SELECT *, segment_id % 3 AS k FROM pts) GROUP BY 1")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """What a recorder kept of a stream of three batches."""
    points = T.points(spark, d).withColumn("part", (F.col("segment_id") % 3).cast("int"))
    recorder = live.Recorder()
    spark.streams.addListener(recorder)
    try:
        replayed([points], lambda rows: live.observed(rows, "points", dated=F.count("ts_ms"), off_globe=F.count_if(F.col("lat") > 90)), "progress", recorder)
    finally:
        spark.streams.removeListener(recorder)
    kept = recorder.table(spark).where("kind = 'batch' AND rows > 0")
    return kept.select("batch", "rows", F.col("metrics")["points.rows"].alias("points"), F.col("metrics")["points.dated"].alias("dated"), F.col("metrics")["points.off_globe"].alias("off_globe"))
