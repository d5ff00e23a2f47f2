"""Previews: what gates them, kept graphs, light lines; extracts over a transport that fails; the table function."""

import json
import time

import pytest
from pyspark.sql import functions as F

from trailweave.functions.tables import vertices
from trailweave.operators import preview as R
from trailweave.sources import extracts, osm

BOX = "min_lat double, min_lon double, max_lat double, max_lon double"
STOP = "request long, turn int, lon double, lat double"


@pytest.fixture(scope="module")
def roads(spark):
    nodes = spark.createDataFrame([(i, 0.0 if i < 11 else 0.02, (i % 11) / 100) for i in range(22)], "id long, lat double, lon double")
    edges = [(i, i + 1, 5) for i in range(10)] + [(i, i + 1, 1) for i in range(11, 21)] + [(0, 11, 1), (10, 21, 1)]
    return nodes, spark.createDataFrame(edges, "a long, b long, kind int")


def test_gate(spark):
    boxes = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (1.0, 1.0, 2.0, 2.0)], BOX)
    nan = float("nan")
    rows = [(1, 0, 0.5, 0.5), (1, 1, 1.0, 1.0), (2, 0, 0.5, 0.5), (2, 1, 0.5, 1.5), (3, 0, 0.5, 0.5), (4, 0, 0.5, 0.5), (4, 1, nan, 0.5), (4, 2, 0.6, 0.5), (5, 0, None, None)]
    stops = spark.createDataFrame(rows, STOP)
    assert dict(map(tuple, R.gate(stops, boxes).collect())) == {1: "ok", 2: "outside", 3: "stops", 4: "stops", 5: "stops"}
    assert dict(map(tuple, R.gate(stops, boxes.limit(0)).collect())) == {1: "no_roads", 2: "no_roads", 3: "stops", 4: "stops", 5: "stops"}


def test_boxes_cover_lines_together(spark):
    boxes = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (0.0, 1.0, 1.0, 2.5), (1.0, 2.0, 3.0, 3.0)], BOX)
    lines = {1: [(0.5, 0.5), (2.4, 0.5)], 2: [(0.5, 0.5), (2.5, 2.5)], 3: [(2.2, 0.9), (2.2, 2.9)], 4: [(0.2, 0.2)], 5: [(9.0, 9.0)], 6: [(0.1, 0.1), (0.9, 0.9), (0.9, 0.9), (1.5, 0.5)], 7: [(-1.0, 0.5), (0.5, 0.5)]}
    rows = [(k, i, *p) for k, line in lines.items() for i, p in enumerate(line)]
    got = dict(map(tuple, R.line_covered(spark.createDataFrame(rows, "key long, turn int, lon double, lat double"), boxes).collect()))
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False}


def test_graphs_are_kept_between_requests(spark, roads):
    boxes = spark.createDataFrame([(-1.0, -1.0, 1.0, 1.0)], BOX)
    p = R.Previews(*roads, boxes, kept=2)
    status, line = p.route([(0.0, 0.0), (0.1, 0.0)])
    assert status == "ok" and p.built == 1 and line[0] == (0.0, 0.0) and line[-1] == (0.1, 0.0)
    assert len(line) == 4  # over the large road; straight runs are one leg each
    assert p.route([(0.0, 1e-4), (0.1, 1e-4)])[0] == "ok" and p.built == 1  # moved a little
    assert p.route([(0.0, 0.0), (0.1, 0.0)], type_="bus")[0] == "ok" and p.built == 2
    assert p.route([(0.0, 0.0), (5.0, 0.0)]) == ("outside", None) and p.route([(0.0, 0.0)]) == ("stops", None) and p.built == 2
    near, _ = p.route([(0.0, 0.0), (0.1, 0.0)], guide=[(0.0, 0.0), (0.05, 0.0), (0.1, 0.0)]), p.built
    assert near[0] == "ok" and near[1] == [(0.0, 0.0), (0.1, 0.0)] and p.built == 3 and len(p.graphs) == 2
    p.changed(*roads, boxes, 1)
    assert p.route([(0.0, 0.0), (0.1, 0.0)], type_="bus")[0] == "ok" and p.built == 4


def test_many_previews_at_once(spark, roads):
    boxes = spark.createDataFrame([(-1.0, -1.0, 1.0, 1.0)], BOX)
    rows = [(k, t, (t * 0.1), 0.0, k % 2 == 1) for k in range(4) for t in range(2)] + [(9, 0, 0.0, 0.0, False), (8, 0, 0.0, 0.0, False), (8, 1, 7.0, 7.0, False)]
    got = {r.request: r for r in R.previews(spark.createDataFrame(rows, STOP + ", bus boolean"), *roads, boxes).collect()}
    assert {k: r.status for k, r in got.items()} == {0: "ok", 1: "ok", 2: "ok", 3: "ok", 9: "stops", 8: "outside"} and len(got[0].shape) == 4


def test_extracts_try_mirrors_and_wait(spark, tmp_path):
    folder = str(tmp_path)

    def ask(url, query, seconds):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(f"{url} {query}")
        tried = sum(1 for name in os.listdir(folder) if open(os.path.join(folder, name)).read() == f"{url} {query}")
        if url == "http://silent":
            raise OSError("no answer")
        if tried == 1:
            return 503, "busy"
        base = 10 if "(0.0" in query else 20
        return 200, json.dumps({"elements": [{"type": "node", "id": base, "lat": 1, "lon": 2.5}, {"type": "node", "id": base + 1, "lat": 1, "lon": 2}, {"type": "way", "id": 1, "nodes": [base, base + 1], "tags": {"railway": "rail"}}]})

    got = extracts.read(spark, [(0.0, 0.0, 1.0, 1.0), (5.0, 5.0, 6.0, 6.0)], ask=ask, mirrors='["http://silent", "http://busy"]', tries="3", pause="0.01")
    assert got.rdd.getNumPartitions() == 2
    rows = got.persist()
    assert sorted((r.box, r.type, r.id) for r in rows.collect()) == [(0, "node", 10), (0, "node", 11), (0, "way", 1), (1, "node", 20), (1, "node", 21), (1, "way", 1)]
    nodes, edges = osm.network(rows)
    assert nodes.count() == 4 and sorted((r.a, r.b) for r in edges.collect()) == [(10, 11), (20, 21)]


def test_answers():
    asked = []

    def ask(statuses):
        left = iter(statuses)

        def run(url, query, seconds):
            asked.append(url)
            s = next(left)
            if isinstance(s, Exception):
                raise s
            return s, f"body {s}"

        return run

    two = ["http://a/x", "http://b/x"]
    assert extracts.answer("q", ask([429, 200]), two, 1, 1, 0) == "body 200" and asked == two
    with pytest.raises(OSError, match="a answered 400: body 400"):
        extracts.answer("q", ask([400]), two, 1, 3, 0)
    start = time.time()
    with pytest.raises(OSError, match="b: gone"):
        extracts.answer("q", ask([500, OSError("gone")] * 3), two, 1, 3, 0.02)
    assert time.time() - start >= 0.06


def test_vertices(spark):
    nan = float("nan")
    lines = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, nan, nan, 5.0, 6.0]), (2, None), (3, [])], "segment_id long, coords array<double>")
    assert sorted(map(tuple, vertices(spark, lines).collect())) == [(1, 0, 0, 1.0, 2.0), (1, 1, 0, 3.0, 4.0), (1, 3, 1, 5.0, 6.0)]
    assert dict(vertices(spark, lines.withColumn("coords", F.col("coords").cast("array<float>"))).dtypes)["lon"] == "float"
    with pytest.raises(Exception, match="array of numbers"):
        vertices(spark, lines.withColumn("coords", F.lit("x"))).collect()
