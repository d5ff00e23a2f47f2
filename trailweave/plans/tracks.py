"""Track tables derived from the test tables, the same in Spark and in SQL.

The driver's tables hold no positions. These views make deterministic ones from ``events``: a user is a segment, an event a point. Some
points are repeated, off the globe or undated, and time is compressed so that each kind of flag occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Epoch milliseconds from which time is compressed, and by how much.
EPOCH, COMPRESSION = 1_704_067_200_000, 300
TYPES = ("walking", "cycling", "car", "metro", "bogus")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``ms``, the nearest millisecond of ``ts``, as epoch_ms gives it in SQL."""
    nearest = F.col("ts").cast("timestamp") + F.expr("INTERVAL '0.0005' SECOND")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ms", F.unix_millis(nearest))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment_id, type, seq, ts_ms, lat, lon)"""
    e = events(spark, sf_dir).select("event_id", "user_id", "ms")
    twice = e.withColumn("copy", F.explode(F.when(F.col("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ms", "event_id", "copy")) - 1
    bad = F.col("event_id") % 97 == 0
    return twice.select(
        F.col("user_id").alias("segment_id"),
        F.element_at(F.array(*map(F.lit, TYPES)), (F.col("user_id") % 5 + 1).cast("int")).alias("type"),
        seq.cast("long").alias("seq"),
        F.when(F.col("event_id") % 71 != 0, F.floor((F.col("ms") - EPOCH) / COMPRESSION).cast("long") + EPOCH).alias("ts_ms"),
        F.when(bad, 95.0).otherwise((F.col("event_id") * 37 % 1200).cast("double") / 10000 + 10).alias("lat"),
        ((F.col("event_id") * 91 % 1700).cast("double") / 10000 + 20).alias("lon"),
    )


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, ts_ms, lat, lon, place_id)"""
    e, u = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).select(
        e.alias("id"),
        F.when(e % 13 != 0, F.concat(F.lit("P"), (u % 20).cast("string"))).alias("name"),
        F.when(e % 17 != 0, F.col("ms")).alias("ts_ms"),
        ((u % 20).cast("double") / 2 + (e * 37 % 100).cast("double") / 20000).alias("lat"),
        ((u % 20).cast("double") / 4 + (e * 53 % 100).cast("double") / 20000).alias("lon"),
        F.when(e % 11 == 0, u % 5).alias("place_id"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, kind): a lattice of supplier and part keys, both ways and with repeats, as regions that overlap would bring them."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select((F.col("l_suppkey") % 40).alias("a"), (F.col("l_partkey") % 40).alias("b"), (F.col("l_linenumber") % 7).cast("int").alias("kind"), F.col("l_orderkey").alias("turn"))


#: The same views as common table expressions.
SQL = f"""
ev AS (SELECT event_id, user_id, event_type, epoch_ms(ts) AS ms FROM events),
pts AS (
  SELECT user_id AS segment_id, ['walking', 'cycling', 'car', 'metro', 'bogus'][CAST(user_id % 5 + 1 AS INT)] AS type,
         row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id, copy) - 1 AS seq,
         CASE WHEN event_id % 71 <> 0 THEN CAST(floor((ms - {EPOCH}) / {COMPRESSION}::DOUBLE) AS BIGINT) + {EPOCH} END AS ts_ms,
         CASE WHEN event_id % 97 = 0 THEN 95.0::DOUBLE ELSE (event_id * 37 % 1200)::DOUBLE / 10000 + 10 END AS lat,
         (event_id * 91 % 1700)::DOUBLE / 10000 + 20 AS lon
  FROM (SELECT *, 0 AS copy FROM ev UNION ALL SELECT *, 1 AS copy FROM ev WHERE event_id % 50 = 0)
),
wpt AS (
  SELECT event_id AS id, CASE WHEN event_id % 13 <> 0 THEN 'P' || CAST(user_id % 20 AS VARCHAR) END AS name,
         CASE WHEN event_id % 17 <> 0 THEN ms END AS ts_ms,
         (user_id % 20)::DOUBLE / 2 + (event_id * 37 % 100)::DOUBLE / 20000 AS lat,
         (user_id % 20)::DOUBLE / 4 + (event_id * 53 % 100)::DOUBLE / 20000 AS lon,
         CASE WHEN event_id % 11 = 0 THEN user_id % 5 END AS place_id
  FROM ev
)"""
