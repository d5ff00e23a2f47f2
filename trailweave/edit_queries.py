"""Registered queries on what an editor and a map ask of the store: drafts, splits, mergers, swaps of matched lines, networks, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import drafts as D, edits as E, geometry as G, network as N, places as P, viewport as V
from .plans import tracks as T
from .queries import _OK, _OVERLAY, _MERGED, _categories, _flagged, _overlay, _segments, query
from .session import cut

_EDITED = _OK + "," + _OVERLAY + _MERGED.replace("{where}", "flag = 0")
_BAKED = _OK + "," + _OVERLAY + _MERGED.replace("{where}", "true")


# ---- drafts


@query("SELECT segment_id FROM ov GROUP BY 1", views=_OK + "," + _OVERLAY)
def draft_segments(spark, d):
    return D.drafts(_overlay(_flagged(spark, d)))


@query("SELECT count(DISTINCT segment_id) AS drafts FROM ov WHERE kind = 'move'", views=_OK + "," + _OVERLAY)
def draft_count_of_moves(spark, d):
    return D.draft_count(_overlay(_flagged(spark, d)).where("kind = 'move'"))


@query("""SELECT p.segment_id, p.points, coalesce(e.drawn, 0) AS drawn, o.segment_id IS NOT NULL AS has_draft, coalesce(o.gone, 0) AS deleted, o.first_gone
  FROM (SELECT segment_id, count(*) AS points FROM pf GROUP BY 1) p LEFT JOIN (SELECT segment_id, count(*) AS drawn FROM t GROUP BY 1) e USING (segment_id)
  LEFT JOIN (SELECT segment_id, count(*) FILTER (kind = 'delete') AS gone, min(seq) FILTER (kind = 'delete') AS first_gone FROM ov WHERE segment_id % 4 <> 0 GROUP BY 1) o ON o.segment_id = p.segment_id""",
  views=_EDITED.replace("FULL JOIN ov o", "FULL JOIN (SELECT * FROM ov WHERE segment_id % 4 <> 0) o"), recursive=True)
def edit_states(spark, d):
    p = cut(_flagged(spark, d))
    rows = D.edit_state(p, _overlay(p).where("segment_id % 4 <> 0"))
    return rows.select("segment_id", "points", "drawn", "has_draft", F.size("deleted").cast("long").alias("deleted"), F.get("deleted", F.lit(0)).alias("first_gone"))


# Segments divisible by 3 are to lose all points but their first.
@query("""SELECT segment_id, CASE WHEN coalesce(n, 0) < 2 THEN 'short' ELSE 'saved' END AS status FROM (SELECT DISTINCT segment_id FROM pf WHERE segment_id % 2 = 0) LEFT JOIN (
  SELECT segment_id, count(*) FILTER (flag = 0 AND (segment_id % 3 <> 0 OR seq = 0)) AS n FROM pf GROUP BY 1) USING (segment_id) UNION ALL SELECT -1, 'unknown'""", views=_OK)
def drafts_saved_or_refused(spark, d):
    p = cut(_flagged(spark, d))
    gone = p.where("segment_id % 2 = 0").select("segment_id", F.when((F.col("segment_id") % 3 == 0) & (F.col("seq") > 0), F.col("seq")).otherwise(-1).cast("double").alias("seq"), F.lit("delete").alias("kind"), "lat", "lon", F.lit(None).cast("long").alias("ts_ms"))
    odd = spark.range(1).select(F.lit(-1).cast("long").alias("segment_id"), F.lit(0.0).alias("seq"), F.lit("delete").alias("kind"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(None).cast("long").alias("ts_ms"))
    return D.saved(p, _overlay(p), gone.dropDuplicates(["segment_id", "seq"]).unionByName(odd))[1]


@query("SELECT segment_id, count(*) AS edits FROM ov WHERE segment_id % 3 <> 0 GROUP BY 1", views=_OK + "," + _OVERLAY)
def draft_reverted(spark, d):
    p = _flagged(spark, d)
    ids = p.where("segment_id % 3 = 0").select("segment_id").distinct()
    return E.reverted(_overlay(p), ids).groupBy("segment_id").agg(F.count(F.lit(1)).alias("edits"))


@query("SELECT kind, count(*) AS n FROM ov GROUP BY 1", views=_OK + "," + _OVERLAY)
def overlay_validated(spark, d):
    p = _flagged(spark, d)
    good = _overlay(p)
    bad = p.limit(0)
    for lat, seq, kind in ((F.lit(91.0), F.col("seq"), "move"), (F.lit(1.0), F.lit(float("nan")), "delete"), (F.lit(None), F.col("seq"), "insert"), (F.lit(1.0), F.col("seq"), "bend")):
        rows = p.select("segment_id", seq.cast("double").alias("seq"), F.lit(kind).alias("kind"), lat.cast("double").alias("lat"), "lon", F.lit(None).cast("long").alias("ts_ms"))
        bad = rows if "kind" not in bad.columns else bad.unionByName(rows)
    return E.valid_overlay(good.unionByName(bad)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY seq) - 1 AS seq, ts_ms, lat, lon, flag FROM t WHERE segment_id % 3 = 1
  UNION ALL SELECT segment_id, seq, ts_ms, lat, lon, flag FROM pf WHERE segment_id % 3 <> 1""", views=_BAKED, recursive=True)
def drafts_committed(spark, d):
    p = cut(_flagged(spark, d))
    ids = p.where("segment_id % 3 = 1").select("segment_id").distinct()
    return D.committed(p, _overlay(p), ids)[0].select("segment_id", "seq", "ts_ms", "lat", "lon", "flag")


_TYPED = """, ask AS (SELECT DISTINCT segment_id, CASE WHEN segment_id % 2 = 0 THEN 7.5::DOUBLE ELSE 10.0 END AS cut_at,
    CASE WHEN segment_id % 7 = 0 THEN 'sledge' WHEN segment_id % 5 = 0 THEN 'car' END AS ft, CASE WHEN segment_id % 11 = 0 THEN 'cycling' END AS st FROM pf WHERE segment_id % 3 <> 0),
  v AS (SELECT a.*, CASE WHEN ft = 'sledge' THEN 'type' WHEN coalesce(c, 0) = 0 THEN 'point' WHEN least(l, h) < 2 THEN 'short' ELSE 'split' END AS status FROM ask a JOIN (
    SELECT segment_id, count(*) FILTER (t.seq = cut_at) AS c, count(*) FILTER (flag = 0 AND t.seq <= cut_at) AS l, count(*) FILTER (flag = 0 AND t.seq >= cut_at) AS h FROM t JOIN ask USING (segment_id) GROUP BY 1) USING (segment_id)),
  n AS (SELECT segment_id, 1000000 + row_number() OVER (ORDER BY segment_id) - 1 AS new_id FROM v WHERE status = 'split')"""


def _cuts(p):
    i = F.col("segment_id")
    return p.where(i % 3 != 0).select(i, F.when(i % 2 == 0, 7.5).otherwise(10.0).alias("at"), F.when(i % 7 == 0, "sledge").when(i % 5 == 0, "car").alias("first_type"), F.when(i % 11 == 0, "cycling").alias("second_type")).distinct()


def _split(spark, d):
    p = cut(_flagged(spark, d))
    return D.typed_split(p, _overlay(p), cut(_segments(spark, d).select("id", "type")), cut(_cuts(p)), _categories(spark), 1_000_000)


@query("SELECT segment_id, status, new_id FROM v LEFT JOIN n USING (segment_id)", views=_BAKED + _TYPED, recursive=True)
def typed_split_status(spark, d):
    return _split(spark, d)[3]


@query("""SELECT segment_id, seq, lat FROM pf WHERE segment_id NOT IN (SELECT segment_id FROM n)
  UNION ALL SELECT segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY t.seq) - 1, lat FROM t JOIN v USING (segment_id) WHERE status = 'split' AND t.seq <= cut_at
  UNION ALL SELECT new_id, row_number() OVER (PARTITION BY new_id ORDER BY t.seq) - 1, lat FROM t JOIN v USING (segment_id) JOIN n USING (segment_id) WHERE t.seq >= cut_at""", views=_BAKED + _TYPED, recursive=True)
def typed_split_points(spark, d):
    return _split(spark, d)[0].select("segment_id", "seq", "lat")


@query("SELECT id, coalesce(CASE WHEN n.segment_id IS NOT NULL THEN ft END, type) AS type FROM seg LEFT JOIN v ON v.segment_id = id LEFT JOIN n ON n.segment_id = id UNION ALL SELECT new_id, coalesce(st, type) FROM n JOIN v USING (segment_id) JOIN seg ON id = n.segment_id", views=_BAKED + _TYPED, recursive=True)
def typed_split_types(spark, d):
    return _split(spark, d)[2]


_GROUPS = """, mem AS (SELECT id, id // 4 AS grp, type, start_ts_ms, clean_point_count AS c FROM seg), gr AS (
    SELECT grp, count(*) AS n, arg_min(id, (start_ts_ms IS NULL, coalesce(start_ts_ms, 0), id)) AS into_id, arg_min(type, (-c, start_ts_ms IS NULL, coalesce(start_ts_ms, 0), id)) AS usual,
           CASE WHEN grp % 3 = 0 THEN 'car' WHEN grp % 5 = 1 THEN 'sledge' END AS want FROM mem GROUP BY 1),
  g AS (SELECT *, CASE WHEN n < 2 THEN 'few' WHEN want = 'sledge' THEN 'type' ELSE 'merged' END AS status FROM gr)"""


def _groups(segments):
    grp = F.floor(F.col("id") / 4)
    return segments.select(F.col("id").alias("segment_id"), grp.alias("grp"), F.when(grp % 3 == 0, "car").when(grp % 5 == 1, "sledge").alias("type"))


@query("SELECT grp, usual AS type FROM g", views=_OK + _GROUPS)
def merged_type_by_default(spark, d):
    s = cut(_segments(spark, d))
    return D.usual_type(s, _groups(s).drop("type"))


@query("SELECT id, coalesce(want, usual) AS type FROM g JOIN mem USING (grp) WHERE status = 'merged' AND id = into_id UNION ALL SELECT id, type FROM mem JOIN g USING (grp) WHERE status <> 'merged'", views=_OK + _GROUPS)
def merged_segment_types(spark, d):
    s = cut(_segments(spark, d))
    return D.merged_segments(_flagged(spark, d), s, _groups(s), _categories(spark))[1].select("id", "type")


@query("SELECT grp, status, CASE WHEN status = 'merged' THEN into_id END AS segment_id FROM g", views=_OK + _GROUPS)
def merger_status(spark, d):
    s = cut(_segments(spark, d))
    return D.merged_segments(_flagged(spark, d), s, _groups(s), _categories(spark))[2]


@query("SELECT CASE WHEN n >= 2 THEN 'applied' ELSE 'skipped' END AS outcome, count(*) AS n FROM (SELECT segment_id, count(*) FILTER (flag = 0) AS n FROM pf WHERE segment_id <> 3 AND (segment_id % 2 = 0 OR seq < 1) GROUP BY 1) GROUP BY 1", views=_OK)
def stamp_outcomes(spark, d):
    p = cut(_flagged(spark, d).where("segment_id % 2 = 0 OR seq < 1 OR segment_id = 3"))
    shape = p.where("segment_id = 3 AND flag = 0").select(F.col("seq").alias("k"), "lon", "lat")
    return D.stamp_outcome(shape, 3, p, p.select("segment_id")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'car' ELSE type END AS type FROM seg", views=_OK)
def segments_retyped(spark, d):
    s = _segments(spark, d)
    return E.retyped(s, s.where("id % 4 = 0").select(F.col("id").alias("segment_id")), "car", _categories(spark)).select("id", "type")


@query("SELECT id FROM seg WHERE id % 6 <> 1", views=_OK)
def segments_deleted(spark, d):
    s = _segments(spark, d)
    ids = s.where("id % 6 = 1").select(F.col("id").alias("segment_id")).union(spark.createDataFrame([(-5,)], "segment_id long"))
    return E.without(s, ids, "id").select("id")


# Points of segments divisible by 5 are halved; what derives from them follows, the rest stays.
@query("SELECT id, point_count, clean_point_count, min_lat, max_lon, start_ts_ms FROM seg WHERE id % 5 <> 0 UNION ALL SELECT segment_id, count(*), count(*) FILTER (flag = 0), min(lat) FILTER (flag = 0), max(lon) FILTER (flag = 0), min(ts_ms) FILTER (flag = 0) FROM pf WHERE segment_id % 5 = 0 AND seq % 2 = 0 GROUP BY 1", views=_OK)
def rebuilt_after_edit(spark, d):
    p = cut(_flagged(spark, d))
    new = p.where("segment_id % 5 <> 0 OR seq % 2 = 0")
    levels = G.detail_levels(p)
    ids = p.where("segment_id % 5 = 0").select("segment_id").distinct()
    return D.rebuilt(ids, new, _segments(spark, d), levels, levels)[0].select("id", "point_count", "clean_point_count", "min_lat", "max_lon", "start_ts_ms")


# ---- lines at their detail levels, and what a map draws of them


# Douglas-Peucker as a recursion over spans: each parts at its farthest vertex while that is off the chord.
_DP = """, ln AS (SELECT segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY seq) AS k, lon, lat, count(*) OVER (PARTITION BY segment_id) AS n FROM pf WHERE flag = 0),
  tol(detail, tol) AS (VALUES (0, 0.001::DOUBLE), (1, 0.0001), (2, 0.00001)),
  sp AS (
    SELECT segment_id, detail, tol, 1::BIGINT AS a, n AS b FROM ln, tol WHERE k = 1 AND n >= 2
    UNION ALL
    SELECT segment_id, detail, tol, CASE half WHEN 0 THEN a ELSE m END, CASE half WHEN 0 THEN m ELSE b END FROM (
      SELECT *, row_number() OVER (PARTITION BY segment_id, detail, a, b ORDER BY d2 DESC, m) AS r FROM (
        SELECT segment_id, detail, tol, a, b, m, pow(ox - t * cx, 2) + pow(oy - t * cy, 2) AS d2 FROM (
          SELECT s.segment_id, s.detail, s.tol, s.a, s.b, p.k AS m, p.lon - u.lon AS ox, p.lat - u.lat AS oy, w.lon - u.lon AS cx, w.lat - u.lat AS cy,
            CASE WHEN w.lon = u.lon AND w.lat = u.lat THEN 0 ELSE greatest(0, least(1, ((p.lon - u.lon) * (w.lon - u.lon) + (p.lat - u.lat) * (w.lat - u.lat)) / (pow(w.lon - u.lon, 2) + pow(w.lat - u.lat, 2)))) END AS t
          FROM sp s JOIN ln p ON p.segment_id = s.segment_id AND p.k > s.a AND p.k < s.b JOIN ln u ON u.segment_id = s.segment_id AND u.k = s.a JOIN ln w ON w.segment_id = s.segment_id AND w.k = s.b))),
      (VALUES (0), (1)) h(half) WHERE r = 1 AND d2 > tol * tol),
  kept AS (SELECT segment_id, detail, a AS k FROM sp UNION SELECT segment_id, detail, b FROM sp),
  lv AS (SELECT segment_id, detail, count(*) AS n FROM kept GROUP BY ALL)"""


@query("""SELECT segment_id, detail, count(*) AS point_count, '{"type":"LineString","coordinates":[' || string_agg('[' || lon::FLOAT || ',' || lat::FLOAT || ']', ',' ORDER BY k) || ']}' AS geojson FROM kept JOIN ln USING (segment_id, k) GROUP BY 1, 2""", views=_OK + _DP, recursive=True)
def simplify_levels(spark, d):
    return G.detail_levels(_flagged(spark, d)).select("segment_id", "detail", "point_count", G.to_geojson(F.col("coords")).alias("geojson"))


@query("""SELECT segment_id, CAST(2 * n AS INT) AS before, CAST(2 * count(*) FILTER (n <= 2 OR (k - 1) % 5 = 0 OR k = n) AS INT) AS after, round(sum(step), 6) AS length
  FROM (SELECT *, sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)) AS step FROM ln WHERE n >= 2 WINDOW w AS (PARTITION BY segment_id ORDER BY k)) GROUP BY segment_id, n""", views=_OK + _DP, recursive=True)
def decimated_lines(spark, d):
    lines = G.polylines(_flagged(spark, d))
    return lines.select("segment_id", F.size("coords").alias("before"), F.size(G.decimated(F.col("coords"), F.lit(5))).alias("after"), F.round(G.arc_length(F.col("coords")), 6).alias("length"))


@query("""SELECT id, type, start_ts_ms, CASE WHEN stride = 1 OR n <= 2 THEN n ELSE (n - 1) // stride + 1 + CASE WHEN (n - 1) % stride > 0 THEN 1 ELSE 0 END END AS point_count, CAST(stride AS INT) AS stride, level
  FROM (SELECT *, greatest(1, CAST(ceil(sum(n) OVER () / 2000.0) AS BIGINT)) AS stride FROM (
    SELECT id, type, start_ts_ms, n, level FROM here, lev WHERE detail = level ORDER BY n DESC, id LIMIT 100))""",
  views=_OK + _DP + """, here AS (SELECT id, type, start_ts_ms, detail, n FROM seg JOIN lv ON id = segment_id WHERE type NOT IN (SELECT name FROM cat WHERE ignored) AND min_lat IS NOT NULL),
  lev AS (SELECT CASE WHEN (SELECT sum(n) FROM here WHERE detail = 1) > 2000 THEN 0 ELSE 1 END AS level)""", recursive=True)  # fmt: skip
def viewport_draw(spark, d):
    p = cut(_flagged(spark, d))
    segments = cut(_segments(spark, d))
    drawn = V.draw(V.Viewport(zoom=10, max_points=2000, max_segments=100), segments, _categories(spark), cut(G.detail_levels(p)))
    return drawn.rows.select("id", "type", "start_ts_ms", "point_count", F.lit(drawn.stride).alias("stride"), F.lit(drawn.level).alias("level"))


# Every other segment has a matched line, of one vertex more; only metros are drawn by it.
@query("SELECT id, detail, CASE WHEN type = 'metro' AND id % 2 = 0 THEN m ELSE n END AS point_count, type = 'metro' AND id % 2 = 0 AS matched FROM seg JOIN lv ON lv.segment_id = id JOIN (SELECT segment_id, detail, n + 1 AS m FROM lv) x USING (segment_id, detail)", views=_OK + _DP, recursive=True)
def matched_swap_in(spark, d):
    levels = cut(G.detail_levels(_flagged(spark, d)))
    matched = levels.where("segment_id % 2 = 0").withColumn("point_count", F.col("point_count") + 1)
    rows = V.displayed(_segments(spark, d), levels, matched, ("metro",))
    return rows.select("id", "detail", "point_count", "matched")


@query("SELECT detail, CAST(sum(n) AS BIGINT) AS n FROM lv GROUP BY 1", views=_OK + _DP, recursive=True)
def budget_counts(spark, d):
    rows = V.displayed(_segments(spark, d), G.detail_levels(_flagged(spark, d)))
    return rows.groupBy("detail").agg(F.sum("point_count").alias("n"))


@query("SELECT count(*) AS rides, count(*) FILTER (id % 2 = 0) AS snapped FROM seg WHERE type IN ('metro', 'tram', 'train')", views=_OK)
def draw_counters(spark, d):
    rows = _segments(spark, d).withColumn("matched", F.col("id") % 2 == 0)
    return D.draw_tally(rows, ("metro", "tram", "train"))


@query("SELECT count(DISTINCT segment_id) AS rides FROM pts WHERE type = 'metro'")
def matched_ride_count(spark, d):
    return D.matched_rides(T.points(spark, d).where("type = 'metro'"))


@query("SELECT id, type FROM seg WHERE type IN ('walking', 'car')", views=_OK)
def visible_types(spark, d):
    c = _categories(spark).withColumn("visible", F.col("name").isin("walking", "car"))
    return V.of_visible_types(_segments(spark, d), c).select("id", "type")


@query("SELECT id FROM seg WHERE max_lat >= 9.991 AND min_lat <= 10.069 AND max_lon >= 20.091 AND min_lon <= 20.169", views=_OK)
def padded_viewport(spark, d):
    v = V.Viewport(10.0, 20.1, 10.06, 20.16).padded()
    return _segments(spark, d).where(S.boxes_meet(v.min_lat, v.min_lon, v.max_lat, v.max_lon)).select("id")


# ---- places


# Greedy clusters as a recursion over a name's visits in order of id, with the clusters so far as its state.
_GREEDY = """, gv AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM wpt WHERE place_id IS NULL AND name <> ''),
  gc AS (
    SELECT name, r, id, id AS cluster_id, [{'a': lat, 'o': lon, 'n': 1.0::DOUBLE, 'c': id}] AS s FROM gv WHERE r = 1
    UNION ALL
    SELECT name, r, id, CASE WHEN hit IS NULL THEN id ELSE s[hit].c END,
      CASE WHEN hit IS NULL THEN list_append(s, {'a': lat, 'o': lon, 'n': 1.0::DOUBLE, 'c': id})
           ELSE list_concat(list_concat(s[1:hit - 1], [{'a': s[hit].a + lat, 'o': s[hit].o + lon, 'n': s[hit].n + 1, 'c': s[hit].c}]), s[hit + 1:]) END
    FROM (SELECT v.name, v.r, v.id, v.lat, v.lon, g.s, nullif(list_position(list_transform(g.s, lambda e: pow(v.lat - e.a / e.n, 2) + pow(v.lon - e.o / e.n, 2) <= 0.0025::DOUBLE * 0.0025::DOUBLE), true), 0) AS hit
          FROM gc g JOIN gv v ON v.name = g.name AND v.r = g.r + 1))"""


@query("SELECT id, cluster_id FROM gc", views=_GREEDY.lstrip(", "), recursive=True)
def greedy_clusters(spark, d):
    return P.clusters(T.waypoints(spark, d).where("place_id IS NULL"))


@query("""SELECT id, ts_ms, name, round(lat, 6) AS lat, round(lon, 6) AS lon, visits FROM (
  SELECT *, row_number() OVER (PARTITION BY floor(lat * (pow(2.0::DOUBLE, k) / 360)), floor(lon * (pow(2.0::DOUBLE, k) / 360)) ORDER BY coalesce(ts_ms, -1) DESC, id) AS r FROM pin,
    (SELECT CASE WHEN (SELECT count(*) FROM pin) <= 50 THEN 60 ELSE coalesce(max(k) FILTER (n <= 50), 0) END AS k FROM (
      SELECT k, count(DISTINCT (floor(lat * (pow(2.0::DOUBLE, k) / 360)), floor(lon * (pow(2.0::DOUBLE, k) / 360)))) AS n FROM pin, (SELECT unnest(range(15)) AS k) GROUP BY k))) WHERE r = 1""",
  views=_GREEDY.lstrip(", ") + """, w AS (SELECT *, lat BETWEEN 0 AND 5 AND lon BETWEEN 0 AND 3 AS inside FROM wpt),
  pin AS (
    SELECT id, ts_ms, NULL AS name, lat, lon, 1::BIGINT AS visits FROM w WHERE inside AND place_id IS NULL AND coalesce(name, '') = ''
    UNION ALL SELECT arg_max(id, (coalesce(ts_ms, -1), -id)), arg_max({'v': ts_ms}, (coalesce(ts_ms, -1), -id)).v, arg_max({'v': name}, (coalesce(ts_ms, -1), -id)).v, avg(lat), avg(lon), count(*) FROM w WHERE place_id IS NOT NULL GROUP BY place_id HAVING bool_or(inside)
    UNION ALL SELECT arg_max(id, (coalesce(ts_ms, -1), -id)), arg_max({'v': ts_ms}, (coalesce(ts_ms, -1), -id)).v, arg_max({'v': w.name}, (coalesce(ts_ms, -1), -id)).v, avg(lat), avg(lon), count(*) FROM w JOIN gc USING (id) GROUP BY cluster_id HAVING bool_or(inside))""", recursive=True)  # fmt: skip
def viewport_pins(spark, d):
    rows = P.thin(P.pins(T.waypoints(spark, d), (0.0, 0.0, 5.0, 3.0)), 50, 5.0)
    return rows.select("id", "ts_ms", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "visits")


@query("""SELECT name, CAST(dayofweek(make_timestamp(ts_ms * 1000)) AS BIGINT) AS weekday, count(*) AS n FROM wpt WHERE name IS NOT NULL AND ts_ms IS NOT NULL GROUP BY ALL""")
def place_weekdays(spark, d):
    rows = P.histograms(T.waypoints(spark, d).where("name IS NOT NULL"), "name")
    return rows.select("name", F.posexplode("weekdays").alias("d", "n")).where("n > 0").select("name", F.col("d").cast("long").alias("weekday"), "n")


@query("SELECT id, place_id FROM (SELECT id, CASE WHEN id % 10 = 3 THEN (SELECT min(place_id) FROM wpt WHERE id % 10 = 3) ELSE place_id END AS place_id FROM wpt)")
def places_merged(spark, d):
    v = cut(T.waypoints(spark, d))
    places = spark.range(5).select("id", F.concat(F.lit("Place "), F.col("id").cast("string")).alias("name"))
    return P.merged(v, places, v.where("id % 10 = 3").select("id"), "Home")[0].select("id", "place_id")


@query("SELECT id, CASE WHEN id % 10 <> 3 THEN place_id END AS place_id, CASE WHEN id % 10 <> 3 THEN name END AS name FROM wpt")
def visits_separated(spark, d):
    v = T.waypoints(spark, d)
    places = spark.range(5).select("id", F.col("id").cast("string").alias("name"))
    return P.separated(v, places, v.where("id % 10 = 3").select("id"))[0].select("id", "place_id", "name")


@query("SELECT segment_id AS id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, start_ts_ms AS ts_ms FROM pf JOIN seg ON id = segment_id WHERE flag = 0 GROUP BY segment_id, start_ts_ms", views=_OK)
def tracks_as_visits(spark, d):
    s = _segments(spark, d).select(F.col("id").alias("segment_id"), "start_ts_ms", F.lit(1).cast("long").alias("place_id"))
    rows = P.tracks_as_visits(_flagged(spark, d), s, 7)
    return rows.select(F.col("segment_id").alias("id"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "ts_ms")


# ---- networks


_NET = "nd AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101)::DOUBLE / 100 AS lat, (s_suppkey * 53 % 97)::DOUBLE / 100 AS lon FROM supplier), ed AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(kind) AS kind FROM (SELECT l_suppkey AS a, l_partkey % 40 AS b, CAST(l_linenumber % 7 AS INT) AS kind FROM lineitem) WHERE a <> b GROUP BY 1, 2)"


def _net(spark, d):
    k = F.col("s_suppkey")
    nodes = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("id"), ((k * 37 % 101).cast("double") / 100).alias("lat"), ((k * 53 % 97).cast("double") / 100).alias("lon"))
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 40).alias("b"), (F.col("l_linenumber") % 7).cast("int").alias("kind"))
    return nodes, N.canonical(li).groupBy("a", "b").agg(F.max("kind").alias("kind"))


@query("SELECT a, b, kind FROM ed JOIN nd p ON p.id = a JOIN nd q ON q.id = b WHERE greatest(p.lat, q.lat) >= 0.2 AND least(p.lat, q.lat) <= 0.3 AND greatest(p.lon, q.lon) >= 0.4 AND least(p.lon, q.lon) <= 0.45", views=_NET)
def edges_in_box(spark, d):
    return N.within(*_net(spark, d), 0.2, 0.4, 0.3, 0.45)[1].select("a", "b", "kind")


@query("SELECT id FROM nd WHERE id IN (SELECT a FROM ed WHERE kind IN (0, 4, 5)) OR id IN (SELECT b FROM ed WHERE kind IN (0, 4, 5))", views=_NET)
def used_nodes_of_kinds(spark, d):
    nodes, edges = _net(spark, d)
    return N.used_nodes(nodes, N.of_kinds(edges, (4, 5))).select("id")


@query("SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges, 25::BIGINT AS regions, 24000::BIGINT AS last_fetched_ms", views=_NET)
def coverage_totals(spark, d):
    return N.coverage_report(*_net(spark, d), _regions(spark, d))


def _regions(spark, d):
    k = F.col("n_nationkey").cast("long")
    return spark.read.parquet(f"{d}/nation.parquet").select(F.when(k % 3 == 0, "rail").otherwise("road").alias("category"), (k / 10).alias("min_lat"), (k / 20).alias("min_lon"), (k / 10 + 0.3).alias("max_lat"), (k / 20 + 0.2).alias("max_lon"), (k * 1000).alias("fetched_at_ms"), k.alias("node_count"), k.alias("edge_count"))


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'rail' ELSE 'road' END AS category, n_nationkey * 1000::BIGINT AS fetched_at_ms FROM nation WHERE n_nationkey % 3 = 0")
def coverage_of_layer(spark, d):
    return N.coverage_boxes(_regions(spark, d), "rail").select("category", "fetched_at_ms")


@query("SELECT fetched_at_ms FROM (SELECT n_nationkey * 1000::BIGINT AS fetched_at_ms FROM nation WHERE NOT (n_nationkey % 3 <> 0 AND n_nationkey / 10.0::DOUBLE >= 0.35 AND n_nationkey / 10.0::DOUBLE + 0.3 <= 1.55)) UNION ALL SELECT 99::BIGINT")
def regions_subsumed(spark, d):
    nodes, edges = _net(spark, d)
    box = {"category": "road", "min_lat": 0.35, "min_lon": 0.0, "max_lat": 1.55, "max_lon": 5.0, "fetched_at_ms": 99}
    return N.added_region(nodes, edges, _regions(spark, d), nodes, edges, box)[2].select("fetched_at_ms")


@query("SELECT layer, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'nodes' AS layer, 0 AS n UNION ALL SELECT 'matched', count(*) FROM nd) GROUP BY 1", views=_NET)
def network_cleared(spark, d):
    nodes, edges = _net(spark, d)
    kept = N.cleared(nodes, edges, _regions(spark, d), nodes, keep_matched=True)
    count = lambda t, name: t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "n")
    return count(kept[0], "nodes").unionByName(count(kept[3], "matched"))


_GUIDE = [(0.0, 0.0), (0.3, 0.4), (0.6, 0.2), (0.9, 0.95)]


def _chord_sql(x: str, y: str) -> str:
    """The squared distance of (x, y) from chord (px, py, qx, qy), as SQL."""
    t = f"greatest(0, least(1, (({x} - px) * (qx - px) + ({y} - py) * (qy - py)) / (pow(qx - px, 2) + pow(qy - py, 2))))"
    return f"pow(px + {t} * (qx - px) - {x}, 2) + pow(py + {t} * (qy - py) - {y}, 2)"


_CHORDS = ", ".join(f"({i}, {p[0]}::DOUBLE, {p[1]}::DOUBLE, {q[0]}::DOUBLE, {q[1]}::DOUBLE)" for i, (p, q) in enumerate(zip(_GUIDE[:-1], _GUIDE[1:], strict=True)))


@query(f"SELECT id, round(sqrt(min({_chord_sql('lon', 'lat')})), 9) AS distance, round(1.0::DOUBLE + least(49.0, 4.0 * min({_chord_sql('lon', 'lat')}) / pow(0.002::DOUBLE, 2)), 6) AS factor FROM nd, (VALUES {_CHORDS}) c(i, px, py, qx, qy) GROUP BY id", views=_NET)
def corridor_distances(spark, d):
    line = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in _GUIDE))
    rows = _net(spark, d)[0].select("id", N.line_distance(F.col("lon"), F.col("lat"), line, F.lit(1.0)).alias("d"))
    return rows.select("id", F.round("d", 9).alias("distance"), F.round(S.corridor_factor(F.col("d")), 6).alias("factor"))


@query(f"""SELECT id AS request, turn + 0.5::DOUBLE AS turn FROM (SELECT id, i AS turn, row_number() OVER (PARTITION BY id ORDER BY {_chord_sql('x', 'y')}, i) AS r
  FROM (SELECT id, radians(lon) AS x, ln(tan(radians(45 + lat / 2))) AS y FROM nd), (SELECT i, radians(a) AS px, ln(tan(radians(45 + b / 2))) AS py, radians(c) AS qx, ln(tan(radians(45 + e / 2))) AS qy FROM (VALUES {_CHORDS}) c(i, a, b, c, e))) WHERE r = 1""", views=_NET)
def via_on_nearest_leg(spark, d):
    spots = cut(_net(spark, d)[0].select(F.col("id").alias("request"), "lon", "lat"))
    stops = spots.select("request", F.posexplode(F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in _GUIDE))).alias("turn", "p")).select("request", F.col("turn").cast("double").alias("turn"), "p.lon", "p.lat")
    return N.via_turns(stops, spots).select("request", "turn")


@query("SELECT segment_id, round(sum(sqrt(pow((lon - pl) * c, 2) + pow(lat - pa, 2))), 6) AS length FROM (SELECT segment_id, lon, lat, lag(lon) OVER w AS pl, lag(lat) OVER w AS pa, greatest(0.1, cos(radians(avg(lat) OVER (PARTITION BY segment_id)))) AS c, count(*) OVER (PARTITION BY segment_id) AS n FROM pf WHERE flag = 0 WINDOW w AS (PARTITION BY segment_id ORDER BY seq)) WHERE n > 1 GROUP BY 1", views=_OK)
def guide_lengths(spark, d):
    lines = G.polylines(_flagged(spark, d))
    return lines.select("segment_id", F.round(N.line_length(G.pairs(F.col("coords"))), 6).alias("length"))


@query("SELECT p_partkey AS id, least(4.0::DOUBLE, greatest(1.0::DOUBLE, p_size / 100.0::DOUBLE * 111320 / 1000 / 8)) AS emphasis FROM part")
def route_emphasis(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), S.emphasis(F.col("p_size") / F.lit(100.0)).alias("emphasis"))


# ---- scalars and files


# Lightness is chosen so that no channel ends on a half.
@query("""SELECT h, s, l, '#' || lpad(lower(to_hex(CAST(floor((l / 100.0::DOUBLE - s / 100.0::DOUBLE * least(l / 100.0::DOUBLE, 1 - l / 100.0::DOUBLE) * greatest(-1, least(k0 - 3, 9 - k0, 1))) * 255 + 0.5) AS BIGINT))), 2, '0')
    || lpad(lower(to_hex(CAST(floor((l / 100.0::DOUBLE - s / 100.0::DOUBLE * least(l / 100.0::DOUBLE, 1 - l / 100.0::DOUBLE) * greatest(-1, least(k8 - 3, 9 - k8, 1))) * 255 + 0.5) AS BIGINT))), 2, '0')
    || lpad(lower(to_hex(CAST(floor((l / 100.0::DOUBLE - s / 100.0::DOUBLE * least(l / 100.0::DOUBLE, 1 - l / 100.0::DOUBLE) * greatest(-1, least(k4 - 3, 9 - k4, 1))) * 255 + 0.5) AS BIGINT))), 2, '0') AS hex
  FROM (SELECT h, 61::BIGINT AS s, 43::BIGINT AS l, h / 30.0::DOUBLE AS k0, (h / 30.0::DOUBLE + 8) % 12 AS k8, (h / 30.0::DOUBLE + 4) % 12 AS k4 FROM (SELECT DISTINCT p_partkey % 360 AS h FROM part))""")
def hex_colors(spark, d):
    h = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 360).alias("h")).distinct()
    return h.select("h", F.lit(61).cast("long").alias("s"), F.lit(43).cast("long").alias("l"), S.hex_color(F.format_string("hsl(%d, 61%%, 43%%)", "h")).alias("hex"))


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 60 BETWEEN 1 AND 53 THEN 2000 + o_orderkey % 30 END AS INT) AS iso_year, CAST(CASE WHEN o_orderkey % 60 BETWEEN 1 AND 53 THEN o_orderkey % 60 END AS INT) AS iso_week FROM (SELECT DISTINCT o_orderkey FROM orders)")
def iso_week_of_names(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id")).distinct()
    year, week = S.iso_week_of_name(F.format_string("ride %d-W%02d of.gpx", 2000 + F.col("id") % 30, F.col("id") % 60))
    return o.select("id", year.alias("iso_year"), week.alias("iso_week"))


@query("SELECT type, CAST(unnest(range(year(make_timestamp(a * 1000)), year(make_timestamp(b * 1000)) + 1)) AS INT) AS year FROM (SELECT CAST(o_custkey % 7 AS INT) AS type, min(epoch_ms(o_orderdate)) AS a, max(epoch_ms(o_orderdate)) AS b FROM orders GROUP BY 1)")
def year_ranges(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 7).cast("int").alias("type"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return o.groupBy("type").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("type", F.explode(S.years_between(F.col("a"), F.col("b"))).alias("year"))


@query("SELECT l_linenumber AS k, CASE l_linenumber % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 0 END AS rail, CASE l_linenumber % 7 WHEN 5 THEN 1 WHEN 6 THEN 3 ELSE 0 END AS road, count(*) AS n FROM lineitem GROUP BY ALL")
def tag_classes(spark, d):
    tags = F.array(*map(F.lit, ("footway", "subway", "light_rail", "tram", "rail", "motorway_link", "primary")))
    tag = F.get(tags, (F.col("l_linenumber") % 7).cast("int"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("k"), S.rail_kind(tag).alias("rail"), S.road_class(tag).alias("road"))
    return rows.groupBy("k", "rail", "road").agg(F.count(F.lit(1)).alias("n"))
