"""Transport networks: regions, graphs, components, anchors and routes, all as tables.

A network is nodes (id, lat, lon) and undirected edges (a, b, kind) with a < b, in any number. A graph adds projected coordinates,
weights and components. Routes between many pairs are found at once (``routing``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import BUS_KIND, KINDS_OF_TYPE, M_PER_DEG, class_cost, corridor_factor
from ..session import cut
from . import routing
from .joins import around, cell, pairs_within

# How far a route may exceed the straight line, by factor and in degrees, and what a transfer costs besides its length.
GAP_FACTOR, GAP_SLACK, TRANSFER_PENALTY = 4.0, 3e-3, 2e-3


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with a < b; loops are dropped."""
    swap = [c for c in edges.columns if c not in ("a", "b")]
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *swap)


def added_region(nodes: DataFrame, edges: DataFrame, coverage: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, box: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, coverage) with a fetched region: new rows replace old ones of their keys, boxes within the new one of its layer go.

    ``box``: category, min_lat, min_lon, max_lat, max_lon, fetched_at_ms.
    """
    def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))

    fresh = canonical(new_edges).groupBy("a", "b").agg(F.max("kind").alias("kind"))
    fresh_nodes = new_nodes.dropDuplicates(["id"])
    inside = (F.col("category") == box["category"]) & (F.col("min_lat") >= box["min_lat"]) & (F.col("max_lat") <= box["max_lat"]) & (F.col("min_lon") >= box["min_lon"]) & (F.col("max_lon") <= box["max_lon"])
    counts = fresh_nodes.agg(F.count(F.lit(1)).alias("node_count")).join(fresh.agg(F.count(F.lit(1)).alias("edge_count")), how="cross")  # one row each
    row = counts.select(*(F.lit(box[c]).alias(c) for c in ("category", "min_lat", "min_lon", "max_lat", "max_lon", "fetched_at_ms")), "node_count", "edge_count")
    kept = coverage.where(~inside)
    return upsert(nodes, fresh_nodes, ["id"]), upsert(edges, fresh, ["a", "b"]), kept.unionByName(row.select(*(F.col(c).cast(t).alias(c) for c, t in coverage.dtypes)))


def coverage_report(nodes: DataFrame, edges: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: nodes and edges stored, regions, when one was last fetched (null if none)."""
    n, e = (t.agg(F.count(F.lit(1)).alias(c)) for t, c in ((nodes, "nodes"), (edges, "edges")))
    return coverage.agg(F.count(F.lit(1)).alias("regions"), F.max("fetched_at_ms").alias("last_fetched_ms")).join(n, how="cross").join(e, how="cross")  # one row each


def check_fetch(min_lat: float, min_lon: float, max_lat: float, max_lon: float, most: float, pad: float) -> tuple[float, float, float, float]:
    """The box to fetch, padded within the world; an error if it spans more than ``most`` degrees."""
    if not (min_lat < max_lat and min_lon < max_lon):
        raise ValueError("an empty box")
    if max_lat - min_lat > most or max_lon - min_lon > most:
        raise ValueError(f"zoom in: a region may span {most:g} degrees")
    return max(-90.0, min_lat - pad), max(-180.0, min_lon - pad), min(90.0, max_lat + pad), min(180.0, max_lon + pad)


def of_kinds(edges: DataFrame, kinds: tuple[int, ...], wildcard: bool = True) -> DataFrame:
    """Edges of some kinds; rail graphs also take those of unknown kind (0)."""
    return edges.where(F.col("kind").isin(*kinds, *([0] if wildcard else [])))


def drivable(edges: DataFrame, bus: bool) -> DataFrame:
    return edges if bus else edges.where(F.coalesce(F.col("kind") != BUS_KIND, F.lit(True)))


def within(nodes: DataFrame, edges: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> tuple[DataFrame, DataFrame]:
    """The edges whose box meets the given one, and their nodes."""
    ends = located(nodes, edges)
    meets = lambda p, q, lo, hi: (F.greatest(p, q) >= lo) & (F.least(p, q) <= hi)
    kept = ends.where(meets("a_lat", "b_lat", min_lat, max_lat) & meets("a_lon", "b_lon", min_lon, max_lon)).select(*edges.columns)
    return used_nodes(nodes, kept), kept


def located(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with both ends' positions; edges that lack one are dropped."""
    for end in ("a", "b"):
        edges = edges.join(nodes.select(F.col("id").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon")), end)
    return edges


def used_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least node that each node is joined with, by large-star and small-star rounds."""
    links = cut(canonical(edges).select(F.col("b").alias("u"), F.col("a").alias("v")).distinct())
    while links.limit(1).count():
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = cut(small.where("u <> v").distinct())
        forked = links.groupBy("u").count().where("count > 1").limit(1).count()
        chained = links.join(links.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").limit(1).count()
        if not forked and not chained:
            break
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select("v", "v").distinct())


class Graph:
    """nodes (id, lat, lon, x, y, component), tracks (a, b, kind, weight), arcs (u, v, w) both ways with transfers."""

    def __init__(self, nodes: DataFrame, tracks: DataFrame, arcs: DataFrame, radius: float, cos: float):
        self.nodes, self.tracks, self.arcs, self.radius, self.cos = nodes, tracks, arcs, radius, cos

    @property
    def empty(self) -> bool:
        return not self.tracks.limit(1).count()


def build(nodes: DataFrame, edges: DataFrame, snap_m: float = 200.0, transfer_m: float = 60.0, cost: Column | None = None) -> Graph:
    """The graph of the edges whose nodes are known. ``cost`` scales an edge's length by its ``kind`` and middle (``mid_x``, ``mid_y``).

    Longitudes shrink by the cosine of the mean latitude. Nodes within ``transfer_m`` that no edge joins are joined by a transfer,
    whose flat penalty makes a route stay on its track where it can. Components count tracks only.
    """
    edges = edges if "kind" in edges.columns else edges.withColumn("kind", F.lit(0))
    kept = cut(located(nodes, edges.where("a <> b").groupBy("a", "b").agg(F.max("kind").alias("kind"))))
    used = cut(used_nodes(nodes.dropDuplicates(["id"]), kept))
    cos = max(0.1, used.agg(F.cos(F.radians(F.avg("lat")))).first()[0] or 1.0)
    placed = used.withColumns({"x": F.col("lon") * cos, "y": F.col("lat")})
    placed = cut(placed.join(components(kept), "id"))
    length = F.hypot((F.col("a_lon") - F.col("b_lon")) * cos, F.col("a_lat") - F.col("b_lat"))
    middle = kept.withColumns({"mid_x": (F.col("a_lon") + F.col("b_lon")) / 2 * cos, "mid_y": (F.col("a_lat") + F.col("b_lat")) / 2})
    weighed = middle.withColumn("weight", length * (cost if cost is not None else F.lit(1.0)))
    tracks = cut(weighed.select("a", "b", "kind", (F.col("a_lon") * cos).alias("ax"), F.col("a_lat").alias("ay"), (F.col("b_lon") * cos).alias("bx"), F.col("b_lat").alias("by"), "weight"))
    links = tracks.select("a", "b", "weight")
    if transfer_m > 0:
        adjacent = tracks.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = links.unionByName(pairs_within(placed, transfer_m / M_PER_DEG, adjacent).select("a", "b", (F.col("distance") + TRANSFER_PENALTY).alias("weight")))
    arcs = links.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("weight").alias("w")).union(links.select("b", "a", "weight"))
    return Graph(placed, tracks, cut(arcs.groupBy("u", "v").agg(F.min("w").alias("w"))), snap_m / M_PER_DEG, cos)


def drive(nodes: DataFrame, edges: DataFrame, emphasis: float = 1.0, guide: list[tuple[float, float]] | None = None, snap_m: float = 200.0) -> Graph:
    """The road graph: length times class cost, and where a ``guide`` (lon, lat) is given, more the farther from it."""
    cost = class_cost(F.col("kind"), emphasis)
    if guide and len(guide) >= 2:
        cost = cost * corridor_factor(_distance_to(guide))
    return build(nodes, edges, snap_m, 0.0, cost)


def _distance_to(guide: list[tuple[float, float]]) -> Column:
    """The distance of an edge's middle from a line given by hand, in degrees of latitude."""
    import numpy as np

    from .geometry import simplify

    line = np.array(guide, dtype=float)
    cos = max(0.1, float(np.cos(np.radians(line[:, 1].mean()))))
    line = line[simplify(line, 0.002 / 3)] if len(line) > 2 else line
    a_lon, a_lat, b_lon, b_lat = (F.col(c) for c in ("a_lon", "a_lat", "b_lon", "b_lat"))
    px, py = (a_lon + b_lon) / 2 * cos, (a_lat + b_lat) / 2
    gaps = []
    for (x0, y0), (x1, y1) in zip(line[:-1] * [cos, 1], line[1:] * [cos, 1], strict=True):
        gaps.append(segment_distance(px, py, *(F.lit(float(v)) for v in (x0, y0, x1, y1)))[0])
    return F.sqrt(F.least(*gaps) if len(gaps) > 1 else gaps[0])


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(squared distance of a point from a segment, share of the segment at which it is nearest)"""
    vx, vy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * vx + (py - ay) * vy, vx * vx + vy * vy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return (ax + t * vx - px) ** 2 + (ay + t * vy - py) ** 2, t


def anchors(spots: DataFrame, graph: Graph, scale: float = 1.0) -> DataFrame:
    """(key, component, node, d2): of each spot (key, lon, lat) and component, the best node within ``scale`` times the snap radius.

    That is the nearer end of the nearest edge, the lesser node of equally near ones. Edges are spread over the cells their boxes
    touch, spots over their neighbourhood; the join is by cell.
    """
    size = graph.radius
    xs, ys = (F.sequence(cell(F.least(f"a{c}", f"b{c}"), size), cell(F.greatest(f"a{c}", f"b{c}"), size)) for c in "xy")
    laid = graph.tracks.select("a", "b", "ax", "ay", "bx", "by", F.explode(xs).alias("cx"), ys.alias("cys"))
    laid = laid.select("a", "b", "ax", "ay", "bx", "by", "cx", F.explode("cys").alias("cy"))
    reach = int(-(-scale // 1))
    asked = spots.select("key", (F.col("lon") * graph.cos).alias("px"), F.col("lat").alias("py"))
    asked = asked.select("key", "px", "py", around(cell(F.col("px"), size), reach).alias("cx"))
    asked = asked.select("key", "px", "py", "cx", around(cell(F.col("py"), size), reach).alias("cy"))
    d2, t = segment_distance(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))
    met = asked.join(laid, ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") < (size * scale) ** 2)
    met = met.select("key", F.when(t < 0.5, F.col("a")).otherwise(F.col("b")).alias("node"), "d2")
    met = met.join(graph.nodes.select(F.col("id").alias("node"), "component"), "node")
    return met.groupBy("key", "component").agg(F.min(F.struct("d2", "node")).alias("m")).select("key", "component", "m.node", "m.d2")


def routes(pairs: DataFrame, graph: Graph, budget: Column | None = None) -> DataFrame:
    """(src, dst, path, cost): the cheapest path of every pair (src, dst and more) within its budget; pairs without one are left out.

    ``budget`` is a column of ``pairs`` with ``straight`` (the ends' distance); four times that and some slack by default.
    """
    at = graph.nodes.select("id", "x", "y")
    budget = budget if budget is not None else GAP_FACTOR * F.col("straight") + GAP_SLACK
    found = pairs.join(at.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy")), "src").join(at.select(F.col("id").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy")), "dst")
    found = found.withColumn("straight", F.hypot(F.col("sx") - F.col("dx"), F.col("sy") - F.col("dy"))).groupBy("src", "dst", "sx", "sy", "dx", "dy").agg(F.max(budget).alias("most"))
    return routing.routes(found, at, graph.arcs)


def path_lengths(found: DataFrame, graph: Graph) -> DataFrame:
    """``found`` (src, dst, path, cost) with ``length``, in degrees along the ground, and ``shape``, the path's (lon, lat)."""
    each = found.select("src", "dst", F.posexplode("path").alias("i", "id")).join(graph.nodes.select("id", "x", "y", "lon", "lat"), "id")
    line = each.groupBy("src", "dst").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y", "lon", "lat"))).alias("p"))
    inner = lambda k: F.slice("p", k, F.greatest(F.size("p") - 1, F.lit(0)))
    steps = F.zip_with(inner(1), inner(2), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    line = line.select("src", "dst", F.aggregate(steps, F.lit(0.0), lambda s, d: s + d).alias("length"), F.transform("p", lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat"))).alias("shape"))
    return found.join(line, ["src", "dst"])


# Slack of a route through stops: by the straight line, by the length of its guide, and in any case, in degrees.
VIA_FACTOR, VIA_GUIDE, VIA_SLACK = 12, 30, 0.6


def routed(stops: DataFrame, graph: Graph) -> DataFrame:
    """(request, status, legs, shape): the routes of any number of requests, each through its ``stops`` (request, turn, lon, lat, guide).

    ``guide`` is the length in degrees of the line that the request follows, 0 without one. ``status`` is ok; stops, if there are fewer
    than two; off_network, if one is beyond the snap radius; one_spot, if all meet the same node; no_path, if a leg has no route within
    its budget. ``shape`` is the (lon, lat) of an ok route, null otherwise. All legs of all requests are searched together.
    """
    spots = stops.select(F.struct("request", "turn").alias("key"), "lon", "lat")
    near = anchors(spots, graph).groupBy("key").agg(F.min(F.struct("d2", "node")).alias("m")).select("key.request", "key.turn", "m.node")
    on = cut(stops.select("request", "turn", "guide").join(near, ["request", "turn"], "left"))
    legs = on.withColumn("src", F.lag("node").over(Window.partitionBy("request").orderBy("turn"))).where("src <> node")
    at = graph.nodes.select(F.col("id"), "x", "y")
    ends = legs.select("request", "turn", "guide", "src", F.col("node").alias("dst"))
    for end in ("src", "dst"):
        ends = ends.join(at.select(F.col("id").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y")), end)
    straight = F.hypot(F.col("src_x") - F.col("dst_x"), F.col("src_y") - F.col("dst_y"))
    ends = cut(ends.select("request", "turn", "src", "dst", (VIA_FACTOR * straight + VIA_GUIDE * F.col("guide") + VIA_SLACK).alias("most")))
    found = path_lengths(routes(ends.select("src", "dst", "most"), graph, F.col("most")), graph).select("src", "dst", "cost", "shape")
    ways = ends.join(found, ["src", "dst"]).where("cost <= most").select("request", "turn", "shape")
    ways = ways.groupBy("request").agg(F.count(F.lit(1)).alias("found"), F.sort_array(F.collect_list(F.struct("turn", "shape"))).alias("ways"))
    # A leg starts where the one before it ends.
    whole = F.aggregate("ways", F.array().cast("array<struct<lon:double,lat:double>>"), lambda s, w: F.concat(s, F.when(F.size(s) == 0, w["shape"]).otherwise(F.slice(w["shape"], 2, F.greatest(F.size(w["shape"]) - 1, F.lit(0))))))
    of = on.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.count("node").alias("near"))
    of = of.join(ends.groupBy("request").agg(F.count(F.lit(1)).alias("legs")), "request", "left").join(ways.select("request", "found", whole.alias("line")), "request", "left")
    of = of.withColumns({"legs": F.coalesce("legs", F.lit(0)), "found": F.coalesce("found", F.lit(0))})
    status = F.when(F.col("n") < 2, "stops").when(F.col("near") < F.col("n"), "off_network").when(F.col("legs") == 0, "one_spot").when(F.col("found") < F.col("legs"), "no_path").otherwise("ok")
    return of.select("request", status.alias("status"), "legs", F.when(status == "ok", F.col("line")).alias("shape"))


def kind_sets() -> dict[tuple[int, ...], list[str]]:
    """The types that share a set of kinds, and so a graph."""
    out: dict[tuple[int, ...], list[str]] = {}
    for type_, kinds in KINDS_OF_TYPE.items():
        out.setdefault(kinds, []).append(type_)
    return out


def coverage_boxes(coverage: DataFrame, category: str) -> DataFrame:
    """The fetched boxes of one layer, the latest first."""
    return coverage.where(F.col("category") == category).orderBy(F.desc("fetched_at_ms"), "min_lat", "min_lon", "max_lat", "max_lon")


def cleared(nodes: DataFrame, edges: DataFrame, coverage: DataFrame, matched: DataFrame, keep_matched: bool = False) -> tuple[DataFrame, ...]:
    """The four tables of a network emptied; with ``keep_matched`` lines matched before are still drawn."""
    return nodes.limit(0), edges.limit(0), coverage.limit(0), matched if keep_matched else matched.limit(0)


def fetched(edges: DataFrame, coverage: DataFrame) -> bool:
    """If anything has been fetched into a network, be it an empty region."""
    return bool(edges.limit(1).count() or coverage.limit(1).count())


def _chords(line: Column) -> Column:
    """A line of (lon, lat) as an array of (p, q), one for each two vertices in turn; a lone vertex is one of itself."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), F.slice(line, 2, F.greatest(n - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).when(n == 1, F.transform(line, lambda p: F.struct(p.alias("p"), p.alias("q"))))


def line_distance(lon: Column, lat: Column, line: Column, cos: Column) -> Column:
    """How far a position lies from a line (array of lon, lat), in degrees of latitude; longitudes shrink by ``cos``. Null without a line."""
    gaps = F.transform(_chords(line), lambda c: segment_distance(lon * cos, lat, c["p"]["lon"] * cos, c["p"]["lat"], c["q"]["lon"] * cos, c["q"]["lat"])[0])
    return F.sqrt(F.array_min(gaps))


def line_cos(line: Column) -> Column:
    """The cosine of a line's mean latitude, 0.1 at least."""
    mean = F.aggregate(line, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(line)
    return F.greatest(F.lit(0.1), F.cos(F.radians(mean)))


def line_length(line: Column) -> Column:
    """The length of a line (array of lon, lat) in degrees of latitude; 0 for fewer than two vertices."""
    cos = line_cos(line)
    steps = F.transform(_chords(line), lambda c: F.hypot((c["q"]["lon"] - c["p"]["lon"]) * cos, c["q"]["lat"] - c["p"]["lat"]))
    return F.coalesce(F.aggregate(steps, F.lit(0.0), lambda s, d: s + d), F.lit(0.0))


def via_turns(stops: DataFrame, vias: DataFrame) -> DataFrame:
    """(request, lon, lat, turn): where each new stop of a request goes: half a turn after the start of the leg that it lies nearest to.

    ``stops``: (request, turn, lon, lat), whole turns in order; ``vias``: (request, lon, lat), one a request. Nearness is on the plane
    of a web map, and the first of equally near legs takes the stop. Requests of fewer than two stops take it at their end.
    """
    up = lambda lat: F.log(F.tan(F.radians(45 + F.col(lat) / 2)))
    w = Window.partitionBy("request").orderBy("turn")
    at = stops.select("request", "turn", F.radians("lon").alias("x"), up("lat").alias("y"))
    legs = at.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "last": F.max("turn").over(Window.partitionBy("request"))})
    new = vias.select("request", "lon", "lat", F.radians("lon").alias("px"), up("lat").alias("py"))
    d2 = segment_distance(*(F.col(c) for c in ("px", "py", "x", "y", "nx", "ny")))[0]
    met = new.join(legs, "request", "left").withColumn("d2", F.when(F.col("nx").isNotNull(), d2))
    best = met.groupBy("request", "lon", "lat").agg(F.min_by("turn", F.when(F.col("d2").isNotNull(), F.struct("d2", "turn"))).alias("leg"), F.max("last").alias("last"))
    return best.select("request", "lon", "lat", (F.coalesce("leg", "last", F.lit(0)) + F.lit(0.5)).alias("turn"))
