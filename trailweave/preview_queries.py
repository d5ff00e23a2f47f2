"""Registered queries on what is asked before something is changed or drawn: previews of routes, overlaps of files, totals, vertices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars as S
from .functions.tables import vertices
from .operators import geometry as G, network as N, places as P, preview as R, viewport as V
from .plans import ingest, tracks as T
from .queries import _OK, _flagged, _segments, _town, query


@query("""SELECT request, CASE WHEN count(lat) < 2 OR count(lat) < count(*) THEN 'stops' WHEN count(*) FILTER (inside) < count(*) THEN 'outside' ELSE 'ok' END AS status FROM (
  SELECT user_id * 3 + id % 3 AS request, CASE WHEN id % 97 <> 0 THEN lat END AS lat, EXISTS (SELECT 1 FROM nation n WHERE n_nationkey < 12 AND w.lat BETWEEN n_nationkey / 2.0::DOUBLE - 0.1 AND n_nationkey / 2.0::DOUBLE + 0.1
    AND w.lon BETWEEN n_nationkey / 4.0::DOUBLE - 0.1 AND n_nationkey / 4.0::DOUBLE + 0.1) AS inside FROM wpt w JOIN events e ON e.event_id = w.id) GROUP BY 1""")
def preview_gate(spark, d):
    """Requests of each user's visits, some with a stop that isn't one, against boxes about some of the users' whereabouts."""
    of = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), "user_id")
    w = T.waypoints(spark, d).join(of, "id")
    stops = w.select((F.col("user_id") * 3 + F.col("id") % 3).alias("request"), F.col("id").alias("turn"), "lon", F.when(F.col("id") % 97 != 0, F.col("lat")).alias("lat"))
    k = F.col("n_nationkey").cast("double")
    boxes = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 12").select((k / 2 - 0.1).alias("min_lat"), (k / 4 - 0.1).alias("min_lon"), (k / 2 + 0.1).alias("max_lat"), (k / 4 + 0.1).alias("max_lon"))
    return R.gate(stops, boxes)


@query("""SELECT key, coalesce(bool_and(NOT gap) AND max(t1) >= 1 - 1e-12, false) AS covered FROM (SELECT DISTINCT key FROM leg) LEFT JOIN (
  SELECT key, t1, t0 > coalesce(max(t1) OVER (PARTITION BY key ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1e-12 AS gap FROM (
    SELECT key, greatest(0, CASE WHEN bx <> ax THEN least((x0 - ax) / (bx - ax), (x1 - ax) / (bx - ax)) ELSE 0 END, CASE WHEN dy <> ay THEN least((y0 - ay) / (dy - ay), (y1 - ay) / (dy - ay)) ELSE 0 END) AS t0,
           least(1, CASE WHEN bx <> ax THEN greatest((x0 - ax) / (bx - ax), (x1 - ax) / (bx - ax)) ELSE 1 END, CASE WHEN dy <> ay THEN greatest((y0 - ay) / (dy - ay), (y1 - ay) / (dy - ay)) ELSE 1 END) AS t1
    FROM leg, tile WHERE (bx <> ax OR ax BETWEEN x0 AND x1) AND (dy <> ay OR ay BETWEEN y0 AND y1)) WHERE t0 <= t1) USING (key) GROUP BY key""", views=_OK + """,
leg AS (SELECT segment_id * 100000 + seq // 2 AS key, arg_min(lon, seq) AS ax, arg_min(lat, seq) AS ay, arg_max(lon, seq) AS bx, arg_max(lat, seq) AS dy FROM pf WHERE flag = 0 GROUP BY 1),
tile AS (SELECT 10 + n_nationkey // 5 * 0.024::DOUBLE AS y0, 10 + (n_nationkey // 5 + 1) * 0.024::DOUBLE AS y1, 20 + n_nationkey % 5 * 0.034::DOUBLE AS x0, 20 + (n_nationkey % 5 + 1) * 0.034::DOUBLE AS x1 FROM nation WHERE n_nationkey <> 7)""")  # fmt: skip
def legs_covered(spark, d):
    """Pairs of points whose straight way lies within fetched tiles, one of which is missing."""
    lines = _flagged(spark, d).where("flag = 0").select((F.col("segment_id") * 100000 + F.floor(F.col("seq") / 2)).alias("key"), F.col("seq").alias("turn"), "lon", "lat")
    k = F.col("n_nationkey").cast("long")
    row, col = F.floor(k / 5), k % 5
    edge = lambda base, n, width: F.lit(base) + n * F.lit(width)
    tiles = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey <> 7").select(edge(10, row, 0.024).alias("min_lat"), edge(20, col, 0.034).alias("min_lon"), edge(10, row + 1, 0.024).alias("max_lat"), edge(20, col + 1, 0.034).alias("max_lon"))
    return R.line_covered(lines, tiles)


@query("""SELECT path, min(t) AS overlap_start_ms, max(t) AS overlap_end_ms, count(*) FILTER (kind = 's') AS segments, count(*) FILTER (kind = 'v') AS visits
  FROM (SELECT 'f' || n_nationkey AS path, 1704067200000 + n_nationkey::BIGINT * 1000000 AS a, 1704067200000 + n_nationkey::BIGINT * 90000000 AS b FROM nation) f
  JOIN (SELECT 's' AS kind, start_ts_ms AS t FROM seg UNION ALL SELECT 'v', ts_ms FROM wpt) x ON t BETWEEN a AND b GROUP BY 1""", views=_OK)
def import_overlaps(spark, d):
    n = F.col("n_nationkey").cast("long")
    files = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("f"), n.cast("string")).alias("path"), (n * 1000000 + 1704067200000).alias("start_ms"), (n * 90000000 + 1704067200000).alias("end_ms"))
    return ingest.overlaps(files, _segments(spark, d), T.waypoints(spark, d))


@query("""SELECT 'segments' AS what, CAST(year(make_timestamp(start_ts_ms * 1000)) AS BIGINT) AS key, count(*) AS n FROM seg WHERE start_ts_ms IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'visits', CAST(year(make_timestamp(ts_ms * 1000)) AS BIGINT), count(*) FROM wpt WHERE ts_ms IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'points', 0, CAST(sum(point_count) AS BIGINT) FROM seg UNION ALL SELECT 'tracks', 0, count(*) FROM seg
  UNION ALL SELECT 'places', 0, 5 + count(DISTINCT name) FILTER (place_id IS NULL AND name <> '') + count(*) FILTER (place_id IS NULL AND coalesce(name, '') = '') FROM wpt""", views=_OK)
def dataset_stats(spark, d):
    s, w = _segments(spark, d), T.waypoints(spark, d)
    got = V.dataset_stats(s, s, s, w, spark.range(5).select("id", F.concat(F.lit("Place "), F.col("id").cast("string")).alias("name")))
    years = lambda name, what: got[name].select(F.lit(what).alias("what"), F.col("year").cast("long").alias("key"), F.col("n").alias("n"))
    one = lambda name, column, what: got[name].select(F.lit(what).alias("what"), F.lit(0).cast("long").alias("key"), F.col(column).cast("long").alias("n"))
    return years("segment_years", "segments").unionByName(years("visit_years", "visits")).unionByName(one("summary", "points", "points")).unionByName(one("summary", "segments", "tracks")).unionByName(one("places", "places", "places"))


@query("""SELECT segment_id, CAST(row_number() OVER (PARTITION BY segment_id ORDER BY seq) - 1 AS INT) AS n, lon, lat FROM pf WHERE flag = 0 AND segment_id IN (SELECT segment_id FROM pf WHERE flag = 0 GROUP BY 1 HAVING count(*) >= 2)""", views=_OK)
def line_vertices(spark, d):
    return vertices(spark, G.polylines(_flagged(spark, d))).select("segment_id", "n", "lon", "lat")


@query("""SELECT a.id, least(a.min_lat, b.min_lat) AS min_lat, least(a.min_lon, b.min_lon) AS min_lon, greatest(a.max_lat, b.max_lat) AS max_lat, greatest(a.max_lon, b.max_lon) AS max_lon,
  coalesce(a.min_lat >= greatest(-90, b.min_lat - 0.001) AND a.max_lat <= least(90, b.max_lat + 0.001) AND a.min_lon >= greatest(-180, b.min_lon - 0.001) AND a.max_lon <= least(180, b.max_lon + 0.001), false) AS within
  FROM seg a JOIN seg b ON b.id = a.id + 1""", views=_OK)
def box_algebra(spark, d):
    """Boxes of segments whose ids follow each other: their union, and if one lies within the other and a margin."""
    box = F.struct(*S.BOUNDS)
    s = _segments(spark, d)
    both = s.select("id", box.alias("a")).join(s.select((F.col("id") - 1).alias("id"), box.alias("b")), "id")
    return both.select("id", S.box_union(F.col("a"), F.col("b")).alias("u"), S.box_within(F.col("a"), S.box_padded(F.col("b"), 0.001)).alias("within")).select("id", "u.*", "within")


@query("""SELECT id, name, round(dist, 3) AS distance_m, CAST(row_number() OVER (PARTITION BY name ORDER BY round(dist, 3) DESC, id) AS INT) AS place_rank FROM (
    SELECT id, w.name, sqrt(pow((w.lon - c.lon) * cos(radians(c.lat)) * 111320.0::DOUBLE, 2) + pow((w.lat - c.lat) * 110540.0::DOUBLE, 2)) AS dist
    FROM wpt w JOIN (SELECT name, median(lat) AS lat, median(lon) AS lon FROM wpt WHERE name IS NOT NULL GROUP BY 1) c USING (name))""")
def place_members(spark, d):
    rows = P.members(T.waypoints(spark, d).where("name IS NOT NULL"), "name")
    return rows.select("id", "name", F.round("distance_m", 3).alias("distance_m"), "place_rank")


_TOWN = """
spot AS (SELECT id, id // 18 AS r, id % 18 AS c, id // 18 / 100.0::DOUBLE + 10 AS lat, id % 18 / 100.0::DOUBLE + 20 AS lon FROM (SELECT unnest(range(234)) AS id)),
k AS (SELECT cos(radians(avg(lat))) AS cos FROM spot),
way AS (SELECT a.id AS a, b.id AS b, (b.lon - a.lon) * cos * CASE WHEN a.r % 2 = 0 THEN 0.55 ELSE 0.6 END::DOUBLE AS w FROM spot a JOIN spot b ON b.id = a.id + 1 AND a.c < 17, k
  UNION ALL SELECT a.id, b.id, (b.lat - a.lat) * 1.1::DOUBLE FROM spot a JOIN spot b ON b.id = a.id + 18),
arc AS (SELECT a, b, w FROM way UNION ALL SELECT b, a, w FROM way),
stop AS (SELECT s_suppkey AS request, t AS turn, CASE WHEN s_suppkey % 10 = 2 THEN s_suppkey % 234 WHEN t = 0 THEN s_suppkey * 7 % 234 WHEN t = 1 THEN s_suppkey * 13 % 234 ELSE s_nationkey * 9 % 234 END AS node, s_suppkey % 10 = 1 AND t = 1 AS far
  FROM supplier, (SELECT unnest(range(3)) AS t) WHERE s_suppkey % 10 <> 0 OR t = 0),
leg AS (SELECT request, turn, lag(node) OVER (PARTITION BY request ORDER BY turn) AS src, node AS dst, lag(far) OVER (PARTITION BY request ORDER BY turn) AS was, far FROM stop),
go AS (SELECT DISTINCT src, src AS node, 0.0::DOUBLE AS cost, 0 AS hops FROM leg WHERE src IS NOT NULL UNION ALL SELECT src, b, min(cost + w), hops + 1 FROM go JOIN arc ON a = node WHERE hops < 45 GROUP BY src, b, hops),
cheapest AS (SELECT src, node AS dst, min(cost) AS cost FROM go GROUP BY ALL)"""


@query("""SELECT request, CASE WHEN n < 2 THEN 'stops' WHEN far THEN 'off_network' WHEN coalesce(legs, 0) = 0 THEN 'one_spot' ELSE 'ok' END AS status, CASE WHEN n >= 2 AND NOT far AND legs > 0 THEN round(cost, 6) END AS cost
  FROM (SELECT request, count(*) AS n, bool_or(far) AS far FROM stop GROUP BY 1) LEFT JOIN (
    SELECT request, count(*) AS legs, sum(cost) AS cost FROM leg JOIN cheapest USING (src, dst) WHERE src <> dst GROUP BY 1) USING (request)""", views=_TOWN, recursive=True)
def routes_through_stops(spark, d):
    """Requests of suppliers through three stops on the town's streets; what a route costs is read off its shape."""
    nodes, edges = _town(spark, d)
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("request"), "s_nationkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("turn")).where("request % 10 <> 0 OR turn = 0")
    node = F.when(F.col("request") % 10 == 2, F.col("request") % 234).when(F.col("turn") == 0, F.col("request") * 7 % 234).when(F.col("turn") == 1, F.col("request") * 13 % 234).otherwise(F.col("s_nationkey") * 9 % 234)
    stops = s.withColumn("id", node.cast("long")).join(nodes, "id").select("request", "turn", (F.col("lon") + F.when((F.col("request") % 10 == 1) & (F.col("turn") == 1), 5).otherwise(0)).alias("lon"), "lat", F.lit(0.0).alias("guide"))
    graph = N.drive(nodes, edges)
    found = N.routed(stops, graph)
    step = F.transform(F.sequence(F.lit(1), F.size("shape") - 1), lambda k: F.struct(F.get("shape", k - 1).alias("p"), F.get("shape", k).alias("q")))
    row = lambda p: F.round((p["lat"] - 10) * 100)
    cost = lambda e: F.when(e["p"]["lat"] == e["q"]["lat"], F.abs(e["p"]["lon"] - e["q"]["lon"]) * graph.cos * F.when(row(e["p"]) % 2 == 0, 0.55).otherwise(0.6)).otherwise(F.abs(e["p"]["lat"] - e["q"]["lat"]) * 1.1)
    return found.select("request", "status", F.when(F.col("shape").isNotNull(), F.round(F.aggregate(step, F.lit(0.0), lambda total, e: total + cost(e)), 6)).alias("cost"))
