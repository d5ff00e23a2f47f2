"""Previews of routes: the gate of what has been fetched, the weight of big roads by length, graphs kept between requests, light lines."""

from __future__ import annotations

import functools
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import emphasis as emphasis_of
from ..session import cut
from .geometry import simplify
from .joins import covered
from .network import Graph, drivable, drive, line_length, routed, within

#: Degrees within which a route's line may be off.
TOLERANCE = 1e-5
#: Least margin of a graph about its request, and graphs kept.
MARGIN, KEPT = 0.04, 4
LINE = "array<struct<lon:double,lat:double>>"


def light(shape: Column) -> Column:
    """A line of (lon, lat) without the vertices that lie within ``TOLERANCE`` of what is left."""

    def thin(line):
        if line is None or len(line) < 3:
            return line
        xy = np.array([(p["lon"], p["lat"]) for p in line])
        return [line[k] for k in simplify(xy, TOLERANCE)]

    @F.pandas_udf(LINE)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(thin)

    return run(shape)


def gate(stops: DataFrame, coverage: DataFrame) -> DataFrame:
    """(request, status): ok; stops, for fewer than two valid ones or an invalid one; no_roads, if nothing has been fetched; outside, if a stop lies in no box.

    ``stops``: (request, turn, lon, lat); ``coverage``: boxes (min_lat, min_lon, max_lat, max_lon).
    """
    valid = F.col("lon").isNotNull() & F.col("lat").isNotNull() & (F.abs("lon") < float("inf")) & (F.abs("lat") < float("inf"))
    inside = covered(stops.where(valid).select("request", "turn", "lat", "lon"), coverage.select("min_lat", "min_lon", "max_lat", "max_lon"))
    by = stops.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(valid, F.lit(False))).alias("valid"))
    met = inside.groupBy("request").agg(F.count_if("covered").alias("inside"))
    fetched = not coverage.limit(1).isEmpty()
    status = F.when((F.col("valid") < 2) | (F.col("valid") < F.col("n")), "stops")
    status = status.when(F.lit(not fetched), "no_roads").when(F.coalesce("inside", F.lit(0)) < F.col("valid"), "outside").otherwise("ok")
    return by.join(met, "request", "left").select("request", status.alias("status"))


def line_covered(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """(key, covered): if the boxes together cover every leg of a line (key, turn, lon, lat), and not only its vertices.

    A leg is cut where it enters and leaves each box; the cuts of all boxes must leave no gap. Legs meet boxes by cells of latitude and longitude.
    """
    w = Window.partitionBy("key").orderBy("turn")
    legs = lines.select("key", "turn", F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.lead("lon").over(w).alias("bx"), F.lead("lat").over(w).alias("by"), F.count(F.lit(1)).over(Window.partitionBy("key")).alias("of"))
    legs = legs.where("bx IS NOT NULL OR of = 1").withColumns({"bx": F.coalesce("bx", "ax"), "by": F.coalesce("by", "ay")})
    cells = lambda a, b: F.sequence(F.floor(F.least(a, b)), F.floor(F.greatest(a, b)))
    spread = lambda d, x0, x1, y0, y1: d.withColumn("cx", F.explode(cells(x0, x1))).withColumn("cy", F.explode(cells(y0, y1)))
    laid = spread(boxes.select("min_lat", "min_lon", "max_lat", "max_lon").distinct(), "min_lon", "max_lon", "min_lat", "max_lat")
    met = spread(legs, "ax", "bx", "ay", "by").join(laid, ["cx", "cy"]).drop("cx", "cy").distinct()

    def span(a: str, b: str, low: str, high: str) -> tuple[Column, Column]:
        """Shares of the leg at which it enters and leaves the box's range of one coordinate; none if it misses it."""
        d = F.col(b) - F.col(a)
        p, q = (F.col(low) - F.col(a)) / d, (F.col(high) - F.col(a)) / d
        flat = F.col(a).between(F.col(low), F.col(high))
        return F.when(d != 0, F.least(p, q)).when(flat, F.lit(0.0)), F.when(d != 0, F.greatest(p, q)).when(flat, F.lit(1.0))

    (x0, x1), (y0, y1) = span("ax", "bx", "min_lon", "max_lon"), span("ay", "by", "min_lat", "max_lat")
    cuts = met.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1}).where("x0 IS NOT NULL AND y0 IS NOT NULL")
    cuts = cuts.select("key", "turn", F.greatest(F.lit(0.0), "x0", "y0").alias("t0"), F.least(F.lit(1.0), "x1", "y1").alias("t1")).where("t0 <= t1")
    order = Window.partitionBy("key", "turn").orderBy("t0", "t1")
    reach = F.coalesce(F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = cuts.withColumn("gap", F.col("t0") > reach + 1e-12).groupBy("key", "turn").agg(F.max("gap").alias("gap"), F.max("t1").alias("t1"))
    good = legs.select("key", "turn").join(whole, ["key", "turn"], "left").withColumn("ok", F.coalesce(~F.col("gap") & (F.col("t1") >= 1 - 1e-12), F.lit(False)))
    return good.groupBy("key").agg(F.min("ok").alias("covered"))


def weighed(stops: DataFrame, guide_length: Column | None = None) -> DataFrame:
    """(request, length, emphasis): how much a request's route prefers big roads, in tenths, by the length in degrees of its stops' line, or its guide's if longer."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("turn", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    own = stops.groupBy("request").agg(line.alias("line"), F.max(guide_length if guide_length is not None else F.lit(0.0)).alias("guide"))
    length = F.greatest(line_length(F.col("line")), F.coalesce("guide", F.lit(0.0)))
    return own.select("request", length.alias("length"), F.floor(emphasis_of(length) * 10 + 0.5).cast("int").alias("emphasis"))


def previews(stops: DataFrame, nodes: DataFrame, edges: DataFrame, coverage: DataFrame) -> DataFrame:
    """(request, status, legs, shape) of many requests (request, turn, lon, lat, bus) without guides: one graph for each emphasis and kind of driver, of which there are at most 62."""
    checked = cut(gate(stops, coverage))
    able = stops.join(checked.where("status = 'ok'").select("request"), "request", "left_semi")
    of = cut(able.join(weighed(able), "request").select("request", "turn", "lon", "lat", F.lit(0.0).alias("guide"), "bus", "emphasis"))
    out = checked.where("status <> 'ok'").select("request", "status", F.lit(0).cast("long").alias("legs"), F.lit(None).cast(LINE).alias("shape"))
    for row in of.select("emphasis", "bus").distinct().collect():
        graph = drive(nodes, drivable(edges, row["bus"]), row["emphasis"] / 10)
        found = routed(of.where((F.col("emphasis") == row["emphasis"]) & (F.col("bus") == row["bus"])).drop("emphasis", "bus"), graph)
        out = out.unionByName(found.select("request", "status", F.col("legs").cast("long").alias("legs"), light(F.col("shape")).alias("shape")))
    return out


@dataclass(frozen=True)
class _Key:
    guide: tuple
    emphasis: int
    bus: bool
    version: int


class Previews:
    """Answers requests one at a time, as they are drawn, from a network at a version; graphs are kept while the same guide, emphasis, driver and version
    are asked for within their box, the least lately used going first.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, coverage: DataFrame, version: int = 0, kept: int = KEPT):
        self.nodes, self.edges, self.coverage, self.version, self.kept = nodes, edges, coverage, version, kept
        self.graphs: OrderedDict[_Key, tuple[tuple[float, ...], Graph]] = OrderedDict()
        self.built = 0

    def changed(self, nodes: DataFrame, edges: DataFrame, coverage: DataFrame, version: int) -> None:
        self.nodes, self.edges, self.coverage, self.version = nodes, edges, coverage, version

    def graph(self, points: list[tuple[float, float]], guide: list[tuple[float, float]], emphasis: int, bus: bool) -> Graph:
        """The graph about ``points`` and ``guide`` (lon, lat), with room for a route to bow out and for stops to move."""
        lons, lats = zip(*points, *guide)
        want = (min(lats), min(lons), max(lats), max(lons))
        key = _Key(tuple(guide), emphasis, bus, self.version)
        if key in self.graphs:
            box, graph = self.graphs[key]
            if box[0] <= want[0] and box[1] <= want[1] and box[2] >= want[2] and box[3] >= want[3]:
                self.graphs.move_to_end(key)
                return graph
        pad = max(MARGIN, want[2] - want[0], want[3] - want[1])
        box = (want[0] - pad, want[1] - pad, want[2] + pad, want[3] + pad)
        nodes, edges = within(self.nodes, drivable(self.edges, bus), *box)
        self.graphs[key] = (box, drive(nodes, edges, emphasis / 10, guide if len(guide) >= 2 else None))
        self.graphs.move_to_end(key)
        self.built += 1
        while len(self.graphs) > self.kept:
            self.graphs.popitem(last=False)
        return self.graphs[key][1]

    def route(self, stops: list[tuple[float, float]], guide: list[tuple[float, float]] | None = None, corridor: bool = True, type_: str | None = None) -> tuple[str, list[tuple[float, float]] | None]:
        """(status, line of lon, lat) through ``stops`` (lon, lat). ``guide`` is the span that the route replaces; with ``corridor`` it stays near it."""
        spark = self.nodes.sparkSession
        guide = [p for p in guide or [] if all(v is not None and np.isfinite(v) for v in p)]
        rows = [(0, k, *(None if v is None else float(v) for v in p), 0.0) for k, p in enumerate(stops)]
        if not rows:
            return "stops", None
        frame = spark.createDataFrame(rows, "request long, turn int, lon double, lat double, guide double")
        status = gate(frame, self.coverage).first()["status"]
        if status != "ok":
            return status, None
        length = functools.partial(_length, spark)
        emphasis = weighed(frame, F.lit(length(guide))).first()["emphasis"]
        near = guide if corridor else []
        graph = self.graph(stops, near, emphasis, type_ == "bus")
        if graph.empty:
            return "off_network", None
        found = routed(frame.withColumn("guide", F.lit(length(near))), graph).select("status", light(F.col("shape")).alias("shape")).first()
        return found["status"], None if found["shape"] is None else [(p["lon"], p["lat"]) for p in found["shape"]]


def _length(spark, line: list[tuple[float, float]]) -> float:
    if len(line) < 2:
        return 0.0
    return spark.createDataFrame([([{"lon": float(x), "lat": float(y)} for x, y in line],)], f"line {LINE}").select(line_length(F.col("line")).alias("n")).first()["n"]
