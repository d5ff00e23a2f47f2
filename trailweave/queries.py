"""The registered queries: each an operator applied to the test tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import scalars as S
from .operators import clean as C, edits as E, geometry as G, joins as J, matching as M, network as N, places as P, viewport as V
from .plans import tracks as T
from .session import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Cleaned points as a recursion over seq, with the last clean point as its state.
_FLAGS = """
ceil(type, c) AS (VALUES ('walking', 12.0::DOUBLE), ('cycling', 30.0::DOUBLE), ('car', 90.0::DOUBLE), ('metro', 50.0::DOUBLE), ('bogus', 300.0::DOUBLE)),
fold AS (
  SELECT segment_id, type, seq, lat, lon, ts_ms, CASE WHEN lat > 90 THEN 1 ELSE 0 END AS flag,
         CASE WHEN lat <= 90 THEN lat END AS p_lat, CASE WHEN lat <= 90 THEN lon END AS p_lon, CASE WHEN lat <= 90 THEN ts_ms END AS p_ts
  FROM pts WHERE seq = 0
  UNION ALL
  SELECT segment_id, type, seq, lat, lon, ts_ms, flag, CASE WHEN flag = 0 THEN lat ELSE p_lat END, CASE WHEN flag = 0 THEN lon ELSE p_lon END, CASE WHEN flag = 0 THEN ts_ms ELSE p_ts END
  FROM (
    SELECT n.segment_id, n.type, n.seq, n.lat, n.lon, n.ts_ms, f.p_lat, f.p_lon, f.p_ts,
      CASE WHEN n.lat > 90 THEN 1 WHEN f.p_lat IS NULL THEN 0
           WHEN n.lat = f.p_lat AND n.lon = f.p_lon AND n.ts_ms IS NOT DISTINCT FROM f.p_ts THEN 2
           WHEN n.ts_ms IS NULL OR f.p_ts IS NULL THEN 0
           WHEN n.ts_ms < f.p_ts THEN 8
           WHEN n.ts_ms = f.p_ts THEN CASE WHEN dist > 50 THEN 8 ELSE 0 END
           WHEN dist / ((n.ts_ms - f.p_ts) / 1000.0::DOUBLE) > c.c THEN 4 ELSE 0 END AS flag
    FROM fold f JOIN pts n ON n.segment_id = f.segment_id AND n.seq = f.seq + 1 JOIN ceil c ON c.type = n.type,
    LATERAL (SELECT 2 * 6371000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(n.lat - f.p_lat) / 2), 2) + cos(radians(f.p_lat)) * cos(radians(n.lat)) * pow(sin(radians(n.lon - f.p_lon) / 2), 2)))) AS dist)
  )
)"""
_HAVERSINE = "2 * 6371000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
#: Points with the one flag that needs no state, segments of them, categories.
_OK = """
pf AS (SELECT *, CASE WHEN lat > 90 THEN 1 ELSE 0 END AS flag FROM pts),
seg AS (
  SELECT segment_id AS id, type, count(*) AS point_count, count(*) FILTER (flag = 0) AS clean_point_count,
         min(lat) FILTER (flag = 0) AS min_lat, min(lon) FILTER (flag = 0) AS min_lon, max(lat) FILTER (flag = 0) AS max_lat, max(lon) FILTER (flag = 0) AS max_lon,
         min(ts_ms) FILTER (flag = 0) AS start_ts_ms, max(ts_ms) FILTER (flag = 0) AS end_ts_ms, CAST(bit_or(flag) AS BIGINT) AS flags
  FROM pf GROUP BY ALL
),
cat(name, ignored, priority) AS (VALUES ('walking', false, NULL), ('cycling', false, 2), ('car', false, 1), ('metro', false, NULL), ('bogus', true, NULL))"""
_OVERLAY = """
ov AS (
  SELECT segment_id, seq::DOUBLE AS seq, 'delete' AS kind, lat, lon FROM pf WHERE seq % 10 = 3
  UNION ALL SELECT segment_id, seq::DOUBLE, 'move', 11.0::DOUBLE, lon FROM pf WHERE seq % 10 = 5
  UNION ALL SELECT segment_id, seq + 0.5::DOUBLE, 'insert', 12.0::DOUBLE, lon FROM pf WHERE seq % 10 = 7
  UNION ALL SELECT segment_id, seq::DOUBLE, 'insert', 13.0::DOUBLE, lon FROM pf WHERE seq % 10 = 8
)"""


def query(sql: str | None = None, *, views: str = "", recursive: bool = False):
    """Register a query under its function's name, with its SQL over the derived views."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{T.SQL.strip()}{',' + views if views else ''} {sql}"
        return f

    return register


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return T.points(spark, d).withColumn("flag", F.when(F.col("lat") > 90, 1).otherwise(0))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    p = _flagged(spark, d)
    return C.segment_rollup(p.withColumn("of", F.struct("segment_id", "type")), "of").select(F.col("of.segment_id").alias("id"), "of.type", *[c for c in ("point_count", "clean_point_count", "min_lat", "min_lon", "max_lat", "max_lon", "start_ts_ms", "end_ts_ms", "flags")])


def _categories(spark: SparkSession) -> DataFrame:
    rows = [("walking", False, None), ("cycling", False, 2), ("car", False, 1), ("metro", False, None), ("bogus", True, None)]
    return spark.createDataFrame(rows, "name string, ignored boolean, priority int")


def _overlay(p: DataFrame) -> DataFrame:
    seq = F.col("seq").cast("double")
    kinds = [(3, "delete", 0.0, F.col("lat")), (5, "move", 0.0, F.lit(11.0)), (7, "insert", 0.5, F.lit(12.0)), (8, "insert", 0.0, F.lit(13.0))]
    out = None
    for rest, kind, off, lat in kinds:
        rows = p.where(F.col("seq") % 10 == rest).select("segment_id", (seq + off).alias("seq"), F.lit(kind).alias("kind"), lat.alias("lat"), "lon", F.lit(None).cast("long").alias("ts_ms"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- cleaning and rollups


@query("SELECT segment_id, seq, flag FROM fold", views=_FLAGS, recursive=True)
def clean_flags(spark, d):
    return C.clean(T.points(spark, d)).select("segment_id", "seq", "flag")


_ROLLED = """SELECT segment_id, count(*) AS point_count, count(*) FILTER (flag = 0) AS clean_point_count, min(lat) FILTER (flag = 0) AS min_lat, max(lat) FILTER (flag = 0) AS max_lat,
 min(lon) FILTER (flag = 0) AS min_lon, max(lon) FILTER (flag = 0) AS max_lon, min(ts_ms) FILTER (flag = 0) AS start_ts_ms, max(ts_ms) FILTER (flag = 0) AS end_ts_ms, CAST(bit_or(flag) AS BIGINT) AS flags FROM fold GROUP BY 1"""


@query(_ROLLED, views=_FLAGS, recursive=True)
def segment_rollup(spark, d):
    return C.segment_rollup(C.clean(T.points(spark, d)))


@query("""SELECT type, count(*) AS segments, CAST(sum(clean) AS BIGINT) AS points FROM (
  SELECT segment_id, type, count(*) FILTER (flag = 0) AS clean, min(lat) FILTER (flag = 0) a, max(lat) FILTER (flag = 0) b, min(lon) FILTER (flag = 0) c, max(lon) FILTER (flag = 0) e, min(ts_ms) FILTER (flag = 0) s, max(ts_ms) FILTER (flag = 0) t FROM fold GROUP BY ALL)
  WHERE b >= 10.0 AND a <= 10.08 AND e >= 20.0 AND c <= 20.12 AND (t IS NULL OR t >= 1704067300000) AND (s IS NULL OR s <= 1704070000000) AND type NOT IN ('bogus', 'unknown') GROUP BY 1""", views=_FLAGS, recursive=True)
def viewport_type_counts(spark, d):
    """The flagship: clean segments and points of each type in a box and range of dates."""
    rolled = C.segment_rollup(C.clean(T.points(spark, d)).withColumn("of", F.struct("segment_id", "type")), "of").select("of.*", "*")
    view = V.Viewport(10.0, 20.0, 10.08, 20.12, 1704067300000, 1704070000000)
    categories = spark.createDataFrame([("bogus", True), ("unknown", True), ("car", False)], "name string, ignored boolean")
    return V.visible(rolled, categories, view).groupBy("type").agg(F.count(F.lit(1)).alias("segments"), F.sum("clean_point_count").alias("points"))


@query("SELECT type, CAST(sum(point_count) AS BIGINT) AS point_count, CAST(sum(clean_point_count) AS BIGINT) AS clean_point_count, min(min_lat) AS min_lat, min(min_lon) AS min_lon, max(max_lat) AS max_lat, max(max_lon) AS max_lon, min(start_ts_ms) AS start_ts_ms, max(end_ts_ms) AS end_ts_ms, CAST(bit_or(flags) AS BIGINT) AS flags FROM seg GROUP BY 1", views=_OK)
def track_file_rollup(spark, d):
    return C.rollup(_segments(spark, d), "type")


# ---- filters, joins, limits


@query("SELECT id, min_lat, max_lat FROM seg WHERE max_lat >= 10.02 AND min_lat <= 10.021 AND max_lon >= 20.1 AND min_lon <= 20.12", views=_OK)
def scan_filter_bbox(spark, d):
    return _segments(spark, d).where(S.boxes_meet(10.02, 20.1, 10.021, 20.12)).select("id", "min_lat", "max_lat")


@query("SELECT id, ts_ms FROM wpt WHERE (ts_ms IS NULL OR ts_ms >= 1704800000000) AND (ts_ms IS NULL OR ts_ms <= 1705300000000)")
def time_overlap_null_tolerant(spark, d):
    return P.in_range(T.waypoints(spark, d), 1704800000000, 1705300000000).select("id", "ts_ms")


@query("SELECT id, type FROM seg WHERE type NOT IN (SELECT name FROM cat WHERE ignored)", views=_OK)
def ignored_anti_join(spark, d):
    return V.visible(_segments(spark, d), _categories(spark), V.Viewport()).select("id", "type")


@query("SELECT id, point_count FROM seg ORDER BY point_count DESC, id LIMIT 20", views=_OK)
def topk_segment_cap(spark, d):
    return V.capped(_segments(spark, d), 20, F.col("point_count"))[0].select("id", "point_count")


@query("SELECT name, ignored, priority, coalesce(n, 0) AS segment_count, coalesce(p, 0) AS n_points, row_number() OVER (ORDER BY ignored, priority NULLS LAST, coalesce(n, 0) DESC, name) AS place FROM cat LEFT JOIN (SELECT type, count(*) AS n, CAST(sum(point_count) AS BIGINT) AS p FROM seg GROUP BY 1) ON type = name", views=_OK)
def category_counts_ordered(spark, d):
    rows = V.category_list(_segments(spark, d), _categories(spark))
    order = Window.orderBy("ignored", F.asc_nulls_last("priority"), F.desc("segment_count"), "name")  # as few rows as categories
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


@query("SELECT (SELECT count(*) FROM seg) AS segments, (SELECT CAST(sum(point_count) AS BIGINT) FROM seg) AS points, (SELECT min(start_ts_ms) FROM seg) AS start_ts_ms, (SELECT max(end_ts_ms) FROM seg) AS end_ts_ms, (SELECT min(min_lat) FROM seg) AS min_lat, (SELECT max(max_lon) FROM seg) AS max_lon, (SELECT count(*) FROM wpt) AS visits", views=_OK)
def dataset_summary(spark, d):
    s = _segments(spark, d)
    return V.summary(s, s, s, T.waypoints(spark, d)).select("segments", "points", "start_ts_ms", "end_ts_ms", "min_lat", "max_lon", "visits")


@query("SELECT CAST(year(make_timestamp(o * 1000)) AS INT) AS year, count(*) AS n FROM (SELECT epoch_ms(o_orderdate) AS o FROM orders) GROUP BY 1")
def year_histogram(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"))
    return P.year_counts(o)


@query("""SELECT name, visits, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (
  SELECT 'Place ' || place_id AS name, count(*) AS visits, avg(lat) AS lat, avg(lon) AS lon FROM wpt WHERE place_id IS NOT NULL GROUP BY place_id
  UNION ALL SELECT name, count(*), avg(lat), avg(lon) FROM wpt WHERE place_id IS NULL AND name <> '' GROUP BY name) ORDER BY visits DESC, name LIMIT 12""")
def top_places_union(spark, d):
    places = spark.range(5).select("id", F.concat(F.lit("Place "), F.col("id").cast("string")).alias("name"))
    return P.top_places(T.waypoints(spark, d), places).select("name", "visits", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SELECT count(DISTINCT name) AS names, count(DISTINCT place_id) AS places FROM wpt WHERE name <> ''")
def distinct_places(spark, d):
    return P.distinct_places(T.waypoints(spark, d))


@query("""SELECT name, h AS hour, count(*) AS n FROM (SELECT name, hour(make_timestamp(ts_ms * 1000)) AS h FROM wpt WHERE name IS NOT NULL AND ts_ms IS NOT NULL) GROUP BY ALL""")
def place_histograms(spark, d):
    rows = P.histograms(T.waypoints(spark, d).where("name IS NOT NULL"), "name")
    return rows.select("name", F.posexplode("hours").alias("h", "n")).where("n > 0").select("name", F.col("h").cast("long").alias("hour"), "n")


@query("""SELECT id, round(dist, 3) AS distance_m, dist > bar AS outlier FROM (
  SELECT id, name, dist, greatest(150.0::DOUBLE, 3 * median(dist) OVER (PARTITION BY name)) AS bar FROM (
    SELECT id, w.name, sqrt(pow((w.lon - c.lon) * cos(radians(c.lat)) * 111320.0::DOUBLE, 2) + pow((w.lat - c.lat) * 110540.0::DOUBLE, 2)) AS dist
    FROM wpt w JOIN (SELECT name, median(lat) AS lat, median(lon) AS lon FROM wpt WHERE name IS NOT NULL GROUP BY 1) c USING (name)))""")
def place_outliers(spark, d):
    rows = P.outliers(T.waypoints(spark, d).where("name IS NOT NULL"), "name")
    return rows.select("id", F.round("distance_m", 3).alias("distance_m"), "outlier")


@query("""SELECT place_id, count(*) AS visits, round(avg(lat), 6) AS lat, arg_max(id, (coalesce(ts_ms, -1), -id)) AS id FROM wpt WHERE place_id IS NOT NULL GROUP BY 1""")
def visit_pin_reduce(spark, d):
    rows = P._pin(T.waypoints(spark, d).where("place_id IS NOT NULL"), ["place_id"])
    return rows.select("place_id", "visits", F.round("lat", 6).alias("lat"), "id")


@query("""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY floor(lat * (pow(2.0::DOUBLE, k) / 360)), floor(lon * (pow(2.0::DOUBLE, k) / 360)) ORDER BY coalesce(ts_ms, -1) DESC, id) AS r FROM wpt,
  (SELECT coalesce(max(k) FILTER (n <= 30), 0) AS k FROM (SELECT k, count(DISTINCT (floor(lat * (pow(2.0::DOUBLE, k) / 360)), floor(lon * (pow(2.0::DOUBLE, k) / 360)))) AS n FROM wpt, (SELECT unnest(range(19)) AS k) GROUP BY k))) WHERE r = 1""")
def grid_thin_best_per_cell(spark, d):
    # A span of 0.3 degrees starts at cells of 360 / 2**18 degrees, which 20 names overflow: the grid is coarsened until 30 fit.
    return P.thin(T.waypoints(spark, d), 30, 0.3).select("id")


@query("SELECT segment_id, arg_min(seq, seq) AS first_seq, arg_min(lat, seq) AS first_lat, arg_max(seq, seq) AS last_seq, arg_max(lon, seq) AS last_lon FROM pf WHERE flag = 0 GROUP BY 1", views=_OK)
def first_last_clean(spark, d):
    return J.ends(_flagged(spark, d)).select("segment_id", F.col("first.seq").alias("first_seq"), F.col("first.lat").alias("first_lat"), F.col("last.seq").alias("last_seq"), F.col("last.lon").alias("last_lon"))


_ENDS = """, e AS (SELECT segment_id AS id, type, arg_min(lat, seq) AS flat, arg_min(lon, seq) AS flon, arg_max(lat, seq) AS llat, arg_max(lon, seq) AS llon FROM pf WHERE flag = 0 GROUP BY ALL)"""


@query(f"""SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.type = y.type AND x.id <> y.id
  WHERE {_HAVERSINE.replace("{a}.lat", "x.flat").replace("{a}.lon", "x.flon").replace("{b}.lat", "y.flat").replace("{b}.lon", "y.flon")} <= 5000
  AND {_HAVERSINE.replace("{a}.lat", "x.llat").replace("{a}.lon", "x.llon").replace("{b}.lat", "y.llat").replace("{b}.lon", "y.llon")} <= 5000""", views=_OK + _ENDS)
def similar_endpoints(spark, d):
    return J.similar(cut(J.ends(_flagged(spark, d))), 5000.0)


@query(f"""SELECT segment_id FROM (SELECT segment_id, min(seq) FILTER ({_HAVERSINE.format(a="p", b="s")} <= 3000) AS s, max(seq) FILTER ({_HAVERSINE.format(a="p", b="t")} <= 3000) AS t
  FROM pf p, (SELECT 10.03::DOUBLE AS lat, 20.05::DOUBLE AS lon) s, (SELECT 10.08::DOUBLE AS lat, 20.12::DOUBLE AS lon) t WHERE flag = 0 GROUP BY 1) WHERE s < t""", views=_OK)
def passes_through(spark, d):
    return J.passing(_flagged(spark, d), (10.03, 20.05), (10.08, 20.12), 3000.0)


@query("SELECT id, type, start_ts_ms FROM seg WHERE start_ts_ms BETWEEN 1704068000000 - 86400000 AND 1704068000000 + 86400000 AND type NOT IN (SELECT name FROM cat WHERE ignored)", views=_OK)
def merge_candidates(spark, d):
    return E.merge_candidates(_segments(spark, d), _categories(spark), 1704068000000).select("id", "type", "start_ts_ms")


@query("""SELECT path, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM (SELECT 'f' || n_nationkey AS path, 1704067200000 + n_nationkey::BIGINT * 90000000 AS a, 1704067200000 + n_nationkey::BIGINT * 100000000 AS b FROM nation) f JOIN wpt w ON w.ts_ms BETWEEN f.a AND f.b GROUP BY 1""")
def overlap_range_join(spark, d):
    n = F.col("n_nationkey").cast("long")
    files = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("f"), n.cast("string")).alias("path"), (n * 90000000 + 1704067200000).alias("start_ms"), (n * 100000000 + 1704067200000).alias("end_ms"))
    met = J.spans_meeting(files, T.waypoints(spark, d).select("id", "ts_ms"), "ts_ms")
    return met.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query("SELECT 'segment' AS kind, id FROM seg WHERE NOT coalesce(start_ts_ms BETWEEN 1704067200000 AND 1704067500000, false) UNION ALL SELECT 'visit', id FROM wpt WHERE NOT coalesce(ts_ms BETWEEN 1704067200000 AND 1704067500000, false)", views=_OK)
def window_clear(spark, d):
    s, v = E.cleared_windows(_segments(spark, d), T.waypoints(spark, d), [(1704067200000, 1704067500000)])
    return s.select(F.lit("segment").alias("kind"), "id").unionByName(v.select(F.lit("visit").alias("kind"), "id"))


@query("SELECT id FROM (SELECT unnest(range(8)) AS id) p WHERE EXISTS (SELECT 1 FROM wpt WHERE place_id = p.id)")
def orphan_anti_join(spark, d):
    return P.pruned(spark.range(8), T.waypoints(spark, d))


@query("""SELECT p.id, w.place, round(w.d, 6) AS distance FROM wpt p JOIN LATERAL (
  SELECT n AS place, sqrt(pow(p.lat - n / 2.0::DOUBLE - 0.001, 2) + pow(p.lon - n / 4.0::DOUBLE - 0.001, 2)) AS d FROM (SELECT unnest(range(20)) AS n)) w ON w.d < 0.004
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY w.d, w.place) = 1""")
def nearest_place(spark, d):
    spots = spark.range(20).select(F.col("id").alias("place"), (F.col("id") / F.lit(2.0) + 0.001).alias("lat"), (F.col("id") / F.lit(4.0) + 0.001).alias("lon"))
    return J.nearest_within(T.waypoints(spark, d).select("id", "lat", "lon"), spots, 0.004, ["id"], "place").select("id", "place", F.round("distance", 6).alias("distance"))


# ---- the edit overlay


_MERGED = """, m AS (
  SELECT coalesce(p.segment_id, o.segment_id) AS segment_id, coalesce(p.seq, o.seq) AS seq, p.ts_ms,
         CASE WHEN p.seq IS NULL OR o.kind = 'move' THEN o.lat ELSE p.lat END AS lat, CASE WHEN p.seq IS NULL OR o.kind = 'move' THEN o.lon ELSE p.lon END AS lon,
         CASE WHEN p.seq IS NULL THEN 'insert' WHEN o.kind = 'move' THEN 'move' END AS edit,
         CASE WHEN p.seq IS NULL OR o.kind = 'move' THEN 0 ELSE p.flag END AS flag
  FROM (SELECT segment_id, seq::DOUBLE AS seq, ts_ms, lat, lon, flag FROM pf WHERE {where}) p FULL JOIN ov o ON p.segment_id = o.segment_id AND p.seq = o.seq
  WHERE CASE WHEN p.seq IS NULL THEN o.kind = 'insert' ELSE o.kind IS DISTINCT FROM 'delete' END
), nb AS (
  SELECT *, max(CASE WHEN ts_ms IS NOT NULL THEN seq END) OVER b AS ps, min(CASE WHEN ts_ms IS NOT NULL THEN seq END) OVER a AS ns FROM m
  WINDOW b AS (PARTITION BY segment_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY segment_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), ins AS (
  SELECT n.segment_id, n.seq, n.ps, n.ns, p.ts_ms AS pt, q.ts_ms AS qt, row_number() OVER (PARTITION BY n.segment_id, n.ps ORDER BY n.seq) AS r
  FROM nb n JOIN m p ON p.segment_id = n.segment_id AND p.seq = n.ps JOIN m q ON q.segment_id = n.segment_id AND q.seq = n.ns WHERE n.edit = 'insert' AND n.ts_ms IS NULL
), chain AS (
  SELECT *, CAST(floor(pt + (qt - pt) * ((seq - ps) / (ns - ps)) + 0.5) AS BIGINT) AS filled FROM ins WHERE r = 1
  UNION ALL
  SELECT i.*, CAST(floor(c.filled + (i.qt - c.filled) * ((i.seq - c.seq) / (i.ns - c.seq)) + 0.5) AS BIGINT) FROM chain c JOIN ins i ON i.segment_id = c.segment_id AND i.ps = c.ps AND i.r = c.r + 1
), t AS (
  SELECT m.segment_id, m.seq, m.lat, m.lon, m.edit, m.flag, coalesce(c.filled, m.ts_ms) AS ts_ms FROM m LEFT JOIN chain c ON c.segment_id = m.segment_id AND c.seq = m.seq
)"""


@query("SELECT segment_id, seq, ts_ms, lat, lon, edit FROM t", views=_OK + "," + _OVERLAY + _MERGED.replace("{where}", "flag = 0"), recursive=True)
def overlay_effective_points(spark, d):
    p = cut(_flagged(spark, d))
    return E.effective_points(p, _overlay(p))


@query("SELECT segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY seq) - 1 AS seq, ts_ms, lat, lon, flag FROM t", views=_OK + "," + _OVERLAY + _MERGED.replace("{where}", "true"), recursive=True)
def overlay_bake_renumber(spark, d):
    p = cut(_flagged(spark, d))
    return E.baked(p, _overlay(p)).drop("ele")


@query("""SELECT segment_id, seq, lat, lon FROM pf WHERE segment_id % 3 <> 0 OR segment_id NOT IN (SELECT segment_id FROM sound)
  UNION ALL SELECT p.segment_id, row_number() OVER (PARTITION BY p.segment_id ORDER BY seq) - 1, lat, lon FROM pf p JOIN sound s ON p.segment_id = s.segment_id AND seq <= 10
  UNION ALL SELECT s.new_id, row_number() OVER (PARTITION BY p.segment_id ORDER BY seq) - 1, lat, lon FROM pf p JOIN sound s ON p.segment_id = s.segment_id AND seq >= 10""",
  views=_OK + """, sound AS (SELECT segment_id, 1000000 + row_number() OVER (ORDER BY segment_id) - 1 AS new_id FROM (
    SELECT segment_id, count(*) FILTER (flag = 0 AND seq <= 10) AS a, count(*) FILTER (flag = 0 AND seq >= 10) AS b, count(*) FILTER (seq = 10) AS c FROM pf WHERE segment_id % 3 = 0 GROUP BY 1) WHERE a >= 2 AND b >= 2 AND c > 0)""")  # fmt: skip
def split_segment(spark, d):
    p = cut(_flagged(spark, d).select("segment_id", "seq", "lat", "lon", "flag"))
    cuts = p.where("segment_id % 3 = 0").select("segment_id", F.lit(10).cast("long").alias("at")).distinct()
    return E.split(p, cuts, 1_000_000).drop("flag")


@query("""SELECT into_id AS segment_id, row_number() OVER (PARTITION BY into_id ORDER BY turn, seq) - 1 AS seq, lat FROM pf JOIN (
    SELECT id, row_number() OVER (PARTITION BY id // 4 ORDER BY start_ts_ms NULLS LAST, id) AS turn, first_value(id) OVER (PARTITION BY id // 4 ORDER BY start_ts_ms NULLS LAST, id) AS into_id, count(*) OVER (PARTITION BY id // 4) AS n FROM seg) g ON g.id = segment_id WHERE n >= 2
  UNION ALL SELECT segment_id, seq, lat FROM pf JOIN (SELECT id, count(*) OVER (PARTITION BY id // 4) AS n FROM seg) g ON g.id = segment_id WHERE n < 2""", views=_OK)
def stitch_segments(spark, d):
    p = cut(_flagged(spark, d).select("segment_id", "seq", "lat"))
    s = cut(_segments(spark, d).select("id", "start_ts_ms"))
    groups = s.select(F.col("id").alias("segment_id"), F.floor(F.col("id") / 4).alias("grp"))
    return E.stitched(p, s, groups)


@query(f"""SELECT segment_id, seq, round(sum(step) OVER (PARTITION BY segment_id ORDER BY seq), 2) AS metres FROM (
  SELECT a.segment_id, a.seq, CASE WHEN b.seq IS NULL THEN 0 ELSE {_HAVERSINE.format(a="b", b="a")} END AS step FROM (SELECT *, lag(seq) OVER (PARTITION BY segment_id ORDER BY seq) AS before FROM pf WHERE flag = 0) a LEFT JOIN pf b ON b.segment_id = a.segment_id AND b.seq = a.before)""", views=_OK)
def running_length(spark, d):
    return G.cumulative_m(_flagged(spark, d).where("flag = 0")).select("segment_id", "seq", F.round("metres", 2).alias("metres"))


# Vertices along a meridian, so that their shares of the length are those of latitude; most fall between the targets' own points.
_VERTICES = [10.0, 10.03, 10.1, 10.17, 10.2]


@query(f"""SELECT segment_id, k, max(laid) OVER (PARTITION BY segment_id ORDER BY k) AS ts_ms FROM (
    SELECT segment_id, k, CASE WHEN g <= f THEN ts WHEN g >= f1 THEN ts1 ELSE CAST(floor(ts + (g - f) / (f1 - f) * (ts1 - ts) + 0.5) AS BIGINT) END AS laid
    FROM (SELECT *, r = 1 AS head, r = max(r) OVER (PARTITION BY segment_id) AS tail FROM spans), (VALUES {", ".join(f"({k}, ({lat}::DOUBLE - 10) / 0.2)" for k, lat in enumerate(_VERTICES))}) v(k, g)
    WHERE (head OR g > f) AND (tail OR g <= f1))""", views=_OK + f""", step AS (
    SELECT a.segment_id, a.seq, a.ts_ms, CASE WHEN b.seq IS NULL THEN 0 ELSE {_HAVERSINE.format(a="b", b="a")} END AS metres
    FROM (SELECT *, lag(seq) OVER (PARTITION BY segment_id ORDER BY seq) AS before FROM pf WHERE flag = 0 AND ts_ms IS NOT NULL) a LEFT JOIN pf b ON b.segment_id = a.segment_id AND b.seq = a.before),
  run AS (SELECT segment_id, ts_ms, sum(metres) OVER (PARTITION BY segment_id ORDER BY seq) / sum(metres) OVER (PARTITION BY segment_id) AS f FROM step),
  curve AS (SELECT segment_id, f, max(ts_ms) AS ts FROM run WHERE f IS NOT NULL AND NOT isnan(f) GROUP BY ALL),
  spans AS (SELECT * FROM (SELECT *, lead(f) OVER w AS f1, lead(ts) OVER w AS ts1, row_number() OVER w AS r FROM curve WINDOW w AS (PARTITION BY segment_id ORDER BY f)) WHERE f1 IS NOT NULL)""")  # fmt: skip
def layered_times(spark, d):
    p = _flagged(spark, d).where("flag = 0 AND ts_ms IS NOT NULL")
    many = p.groupBy("segment_id").agg(F.countDistinct("lat", "lon").alias("n")).where("n > 1").select("segment_id")
    shape = spark.createDataFrame([(k, 20.0, lat) for k, lat in enumerate(_VERTICES)], "k int, lon double, lat double")
    return E.layered_times(shape, cut(p.join(many, "segment_id", "left_semi"))).select("segment_id", "k", "ts_ms")


# ---- gaps and networks


_GAPS = """, g AS (SELECT segment_id, seq, sqrt(pow((lead(lon) OVER w - lon) * 0.98::DOUBLE, 2) + pow(lead(lat) OVER w - lat, 2)) AS gap FROM pf WHERE flag = 0 WINDOW w AS (PARTITION BY segment_id ORDER BY seq)),
 wide AS (SELECT segment_id, seq, coalesce(gap >= greatest(0.0011, CASE WHEN count(gap) OVER s >= 4 THEN 1.5 * median(gap) OVER s ELSE 0 END), false) AS wide FROM g WINDOW s AS (PARTITION BY segment_id))"""


def _wide(spark, d):
    return M.gaps(_flagged(spark, d).where("flag = 0"), 0.98, 1.5)  # gaps of these made-up tracks vary less than real ones


@query("SELECT segment_id, seq, wide FROM wide", views=_OK + _GAPS)
def gap_outliers(spark, d):
    return _wide(spark, d).select("segment_id", "seq", "wide")


@query("""SELECT segment_id, run, count(*) AS n, min(seq) AS first_seq FROM (SELECT segment_id, seq, wide, CAST(sum(CASE WHEN wide AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY segment_id ORDER BY seq) AS BIGINT) AS run
  FROM (SELECT *, lag(wide) OVER (PARTITION BY segment_id ORDER BY seq) AS before FROM wide)) WHERE wide GROUP BY ALL""", views=_OK + _GAPS)
def gap_islands(spark, d):
    return _wide(spark, d).where("wide").groupBy("segment_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


_NODES = "nd AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101)::DOUBLE / 1000 AS x, (s_suppkey * 53 % 97)::DOUBLE / 1000 AS y FROM supplier)"


def _lattice(spark, d):
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("id"), ((k * 37 % 101).cast("double") / 1000).alias("x"), ((k * 53 % 97).cast("double") / 1000).alias("y"))


@query("SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 9) AS distance FROM nd a JOIN nd b ON a.id < b.id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) > 0 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.0081 * 0.0081::DOUBLE", views=_NODES)
def transfer_self_join(spark, d):
    return J.pairs_within(_lattice(spark, d), 0.0081).select("a", "b", F.round("distance", 9).alias("distance"))


@query("SELECT least(a, b) AS a, greatest(a, b) AS b, max(kind) AS kind FROM (SELECT l_suppkey % 40 AS a, l_partkey % 40 AS b, CAST(l_linenumber % 7 AS INT) AS kind FROM lineitem) WHERE a <> b GROUP BY 1, 2")
def edge_canonical_upsert(spark, d):
    empty = [spark.createDataFrame([], s) for s in ("id long, lat double, lon double", "a long, b long, kind int", "category string, min_lat double, min_lon double, max_lat double, max_lon double, fetched_at_ms long, node_count long, edge_count long")]
    box = {"category": "rail", "min_lat": 0.0, "min_lon": 0.0, "max_lat": 1.0, "max_lon": 1.0, "fetched_at_ms": 1}
    nodes = spark.range(40).select("id", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    return N.added_region(*empty, nodes, T.edges(spark, d).drop("turn"), box)[1]


@query("SELECT id, EXISTS (SELECT 1 FROM (SELECT unnest(range(6)) AS k) WHERE lat BETWEEN k AND k + 0.5 AND lon BETWEEN k / 2.0::DOUBLE AND k / 2.0::DOUBLE + 0.3) AS covered FROM wpt")
def coverage_contains(spark, d):
    k = F.col("id").cast("double")
    boxes = spark.range(6).select(k.alias("min_lat"), (k / 2).alias("min_lon"), (k + 0.5).alias("max_lat"), (k / 2 + 0.3).alias("max_lon"))
    return J.covered(T.waypoints(spark, d).select("id", "lat", "lon"), boxes).select("id", "covered")


@query("SELECT p_partkey AS id, round(pow(CASE p_size % 22 WHEN 1 THEN 0.55 WHEN 2 THEN 0.6 WHEN 3 THEN 0.7 WHEN 4 THEN 0.8 WHEN 5 THEN 0.9 WHEN 6 THEN 1.05 WHEN 7 THEN 1.1 WHEN 8 THEN 1.6 WHEN 20 THEN 0.85 ELSE 1 END::DOUBLE, least(4.0, greatest(1.0, p_retailprice / 100 / 8))), 9) AS cost FROM part")
def class_cost(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), F.round(S.class_cost(F.col("p_size") % 22, S.clamp(F.col("p_retailprice") / 100 / 8, 1.0, 4.0)), 9).alias("cost"))


@query("SELECT DISTINCT o_orderkey AS id, CAST(isoyear(o_orderdate) AS INT) AS iso_year, CAST(weekofyear(o_orderdate) AS INT) AS iso_week FROM orders")
def iso_week(spark, d):
    year, week = S.iso_week(F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), year.alias("iso_year"), week.alias("iso_week"))


@query(f"SELECT a.segment_id, a.seq, round({_HAVERSINE.format(a='a', b='b')}, 3) AS metres FROM pf a JOIN pf b ON a.segment_id = b.segment_id AND b.seq = a.seq + 1 WHERE a.flag = 0 AND b.flag = 0", views=_OK)
def haversine_pairs(spark, d):
    w = Window.partitionBy("segment_id").orderBy("seq")
    p = _flagged(spark, d).withColumn("n", F.lead(F.struct("lat", "lon", "flag")).over(w)).where("flag = 0 AND n.flag = 0")
    return p.select("segment_id", "seq", F.round(S.haversine_m(F.col("lat"), F.col("lon"), F.col("n.lat"), F.col("n.lon")), 3).alias("metres"))


_LINKS = "lk AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), un AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk)"


def _links(spark, d):
    n = F.col("n_nationkey").cast("long")
    return spark.read.parquet(f"{d}/nation.parquet").select(n.alias("a"), ((n * 7 + 3) % 25).alias("b"))


@query("SELECT a AS id, min(r) AS component FROM walk GROUP BY 1", views=_LINKS + ", walk AS (SELECT a, a AS r FROM un WHERE a <> b UNION SELECT w.a, u.b FROM walk w JOIN un u ON u.a = w.r)", recursive=True)
def connected_components(spark, d):
    return N.components(_links(spark, d))


@query("SELECT dst, round(min(c), 9) AS cost FROM go GROUP BY 1", views=_LINKS + ", go AS (SELECT 1 AS dst, 0.0::DOUBLE AS c, 0 AS hops UNION SELECT u.b, g.c + (u.a * 7 + u.b * 7 + u.a * u.b) % 11 + 1, g.hops + 1 FROM go g JOIN un u ON u.a = g.dst WHERE g.hops < 24)", recursive=True)
def shortest_path(spark, d):
    e = _links(spark, d).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    w = ((F.col("a") * 7 + F.col("b") * 7 + F.col("a") * F.col("b")) % 11 + 1).cast("double")
    arcs = cut(e.select(F.col("a").alias("u"), F.col("b").alias("v"), w.alias("w")).union(e.select("b", "a", w)))
    nodes = spark.range(25).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    graph = N.Graph(nodes, e, arcs, 1.0, 1.0)
    pairs = nodes.select(F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"))
    return N.routes(pairs, graph, F.lit(1000.0)).select("dst", F.round("cost", 9).alias("cost"))


_LATTICE = """
cells AS (SELECT l_orderkey % 10000 AS id, (1 + count(*) % 7) / 128.0::DOUBLE AS east, (1 + CAST(sum(l_quantity) AS BIGINT) % 7) / 128.0::DOUBLE AS north FROM lineitem GROUP BY 1),
ways AS (SELECT c.id AS a, n.id AS b, c.east AS w FROM cells c JOIN cells n ON n.id = c.id + 1 WHERE c.id % 100 < 99 UNION ALL SELECT c.id, n.id, c.north FROM cells c JOIN cells n ON n.id = c.id + 100),
arc AS (SELECT a, b, w FROM ways UNION ALL SELECT b, a, w FROM ways),
ask AS (SELECT DISTINCT src, dst, 2 * sqrt(pow(src % 100 - dst % 100, 2) + pow(src // 100 - dst // 100, 2)) / 128.0::DOUBLE + 4 / 128.0::DOUBLE AS most FROM (
  SELECT s_suppkey * 97 % 10000 AS src, (s_suppkey * 97 + s_suppkey % 11 + s_nationkey % 9 * 100) % 10000 AS dst FROM supplier) WHERE src IN (SELECT id FROM cells) AND dst IN (SELECT id FROM cells)),
go AS (SELECT src, dst, most, src AS node, 0.0::DOUBLE AS cost, 0 AS arcs FROM ask UNION ALL
  SELECT src, dst, most, b, min(cost + w), arcs + 1 FROM go JOIN arc ON a = node WHERE cost + w <= most GROUP BY src, dst, most, b, arcs)"""


@query("SELECT src, dst, cost, min(arcs) AS arcs FROM (SELECT *, min(cost) OVER (PARTITION BY src, dst) AS least FROM go WHERE node = dst) WHERE cost = least GROUP BY ALL", views=_LATTICE, recursive=True)
def routes_on_lattice(spark, d):
    """Routes between suppliers' cells on a lattice of order keys, whose steps cost what the orders of a cell say; sums of 128ths are exact."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_orderkey") % 10000).alias("id"))
    step = lambda c: (1 + c % 7) / F.lit(128.0)
    cells = cut(li.agg(step(F.count(F.lit(1))).alias("east"), step(F.sum("l_quantity").cast("long")).alias("north")))
    there = cells.select(F.col("id").alias("b"))
    ways = cells.where("id % 100 < 99").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.col("east").alias("w")).union(cells.select("id", F.col("id") + 100, "north")).join(there, "b", "left_semi")
    arcs = cut(ways.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").union(ways.select("b", "a", "w")))
    nodes = cells.select("id", (F.col("id") % 100 / F.lit(128.0)).alias("x"), (F.floor(F.col("id") / 100) / F.lit(128.0)).alias("y"))
    src, key = F.col("s_suppkey") * 97, F.col("s_suppkey")
    asked = spark.read.parquet(f"{d}/supplier.parquet").select((src % 10000).alias("src"), ((src + key % 11 + F.col("s_nationkey") % 9 * 100) % 10000).alias("dst")).distinct()
    found = N.routes(asked, N.Graph(nodes, ways, arcs, 1.0, 1.0), 2 * F.col("straight") + 4 / 128)
    return found.select("src", "dst", "cost", (F.size("path") - 1).alias("arcs"))


# ---- scalars


@query("""SELECT name, printf('hsl(%d, 65%%, 60%%)', CAST(((h % 360) + 360) % 360 AS INT)) AS color FROM (
  SELECT p_name AS name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM (SELECT DISTINCT p_name FROM part))""")
def category_colors(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name")).distinct()
    return p.select("name", S.category_color(F.col("name")).alias("color"))


@query("""SELECT y, CASE WHEN y <= 0 THEN '#7d8590' ELSE printf('hsl(%d, %d%%, %d%%)', CAST(floor(48 + 167 * t + 0.5) AS INT), CAST(floor(48 + 37 * t + 0.5) AS INT), CAST(floor(62 - 7 * t + 0.5) AS INT)) END AS color
  FROM (SELECT n_nationkey - 1 AS y, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (n_nationkey - 1 - 3) / 17.0::DOUBLE)) AS t FROM nation)""")
def year_colors(spark, d):
    y = F.col("n_nationkey") - 1
    return spark.read.parquet(f"{d}/nation.parquet").select(y.alias("y"), S.year_color(y, F.lit(3), F.lit(20)).alias("color"))


@query("SELECT type, CASE type WHEN 'walking' THEN 12 WHEN 'cycling' THEN 30 WHEN 'car' THEN 90 WHEN 'metro' THEN 50 ELSE 300 END::DOUBLE AS ceiling, z AS zoom, CASE WHEN z < 8 THEN 0 WHEN z < 13 THEN 1 ELSE 2 END AS level FROM (SELECT DISTINCT type FROM pts), (SELECT unnest(range(20)) AS z)")
def ceilings_and_levels(spark, d):
    types = T.points(spark, d).select("type").distinct().select("type", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("zoom"))
    return types.select("type", S.speed_ceiling(F.col("type")).alias("ceiling"), "zoom", S.detail_for_zoom(F.col("zoom")).alias("level"))


# ---- sequential algorithms: rows only here, tested against brute force


def _town(spark, d):
    """A grid of track around the made-up points, with a kind for each row."""
    at = spark.range(13 * 18).select("id", (F.floor(F.col("id") / 18) / 100 + 10).alias("lat"), (F.col("id") % 18 / 100 + 20).cast("double").alias("lon"))
    i = F.col("id")
    east = at.where(i % 18 < 17).select(i.alias("a"), (i + 1).alias("b"), (F.floor(i / 18) % 2 + 1).cast("int").alias("kind"))
    north = at.where(i < 12 * 18).select(i.alias("a"), (i + 18).alias("b"), F.lit(7).alias("kind"))
    return at, east.unionByName(north)


def _rides(spark, d, type_):
    """Points of one type moved onto the town: metros up and down its rows, cars its columns with a jump after every eighth point."""
    n, i = F.col("seq"), F.col("segment_id")
    noise = (F.col("lat") - 10) / 1000
    if type_ == "metro":
        lat, lon = i % 12 / 100 + 10 + noise, F.abs(n % 120 - 60) * 0.0025 + 20
    else:
        lat, lon = F.abs(F.floor(n / 8) % 24 - 12) / 100 + 10 + n % 8 * 0.0002, i % 18 / 100 + 20 + noise
    return cut(_flagged(spark, d).where((F.col("type") == type_) & (F.col("flag") == 0)).withColumns({"lat": lat.cast("double"), "lon": lon.cast("double")}))


def _matched(spark, d, type_):
    nodes, edges = _town(spark, d)
    box = spark.createDataFrame([(9.0, 19.0, 11.0, 21.0)], "min_lat double, min_lon double, max_lat double, max_lon double")
    return M.rebuild(_rides(spark, d, type_), _segments(spark, d), nodes, edges, box, snap_m=300.0).select("segment_id", "detail", "point_count", G.to_geojson(F.col("coords")).alias("geojson"))


@query()
def rail_match(spark, d):
    return _matched(spark, d, "metro")


@query()
def tunnel_bridge(spark, d):
    return _matched(spark, d, "car")


@query()
def ride_average(spark, d):
    lines = G.polylines(_flagged(spark, d)).join(_segments(spark, d).select(F.col("id").alias("segment_id"), "start_ts_ms"), "segment_id")
    rides = lines.select(F.col("segment_id").alias("id"), F.lit("metro").alias("type"), "start_ts_ms", (F.size("coords") / 2).cast("long").alias("point_count"), F.col("coords").cast("array<float>").alias("coords"))
    places = spark.range(20 * 26).select("id", (F.floor(F.col("id") / 26) * 0.006 + 10).alias("lat"), (F.col("id") % 26 * 0.0066 + 20).alias("lon"))
    return G.averaged_rides(cut(rides), places).select("id", "type", "start_ts_ms", "point_count", "members")


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return viewport_type_counts(spark, sf_dir)
