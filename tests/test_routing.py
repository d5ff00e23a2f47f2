"""Routes of many pairs: tiles with heaps, and rounds beyond, against a plain search."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.operators import network as N, routing as R


def least(arcs, src, most):
    """(cost, arcs, path) of the best path from ``src`` to every node, all ties broken, by Dijkstra's search over whole labels."""
    ahead = {}
    for u, v, w in arcs:
        ahead.setdefault(u, []).append((v, w))
    done, heap = {}, [(0.0, 0, (src,))]
    while heap:
        cost, n, path = heapq.heappop(heap)
        if path[-1] in done:
            continue
        done[path[-1]] = (cost, n, path)
        for v, w in ahead.get(path[-1], ()):
            if cost + w <= most and v not in done:
                heapq.heappush(heap, (cost + w, n + 1, (*path, v)))
    return done


def graph(spark, nodes, arcs):
    return N.Graph(spark.createDataFrame(nodes, "id long, x double, y double"), None, spark.createDataFrame(arcs, "u long, v long, w double"), 1.0, 1.0)


def lattice(n, seed, one_way=False):
    """n by n nodes at odd places; steps of whole costs, so that many paths cost the same."""
    rng = np.random.default_rng(seed)
    nodes = [(i, float(i % n), float(i // n)) for i in range(n * n)]
    arcs = []
    for i in range(n * n):
        for j in ([i + 1] if i % n < n - 1 else []) + ([i + n] if i < n * n - n else []):
            w = float(rng.integers(1, 4))
            arcs += [(i, j, w)] + ([] if one_way and rng.random() < 0.3 else [(j, i, w + (1 if one_way else 0))])
    return nodes, arcs


@pytest.mark.parametrize("one_way", [False, True])
def test_equal_to_the_plain_search(spark, monkeypatch, one_way):
    monkeypatch.setattr(R, "PAIRS", 7)  # so that a tile is dealt to several tasks
    nodes, arcs = lattice(14, 4, one_way)
    rng = np.random.default_rng(1)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 196, (60, 2))} | {(5, 5), (0, 195)}
    g = graph(spark, nodes, arcs)
    asked = spark.createDataFrame(sorted(pairs), "src long, dst long")
    for budget, times, more in ((F.lit(100.0), 0, 100), (1.5 * F.col("straight") + 2, 1.5, 2)):
        want = {}
        for a, b in pairs:
            most = times * math.hypot(a % 14 - b % 14, a // 14 - b // 14) + more
            if (hit := least(arcs, a, most).get(b)) is not None:
                want[a, b] = (hit[2], hit[0])
        got = {(r["src"], r["dst"]): (tuple(r["path"]), r["cost"]) for r in N.routes(asked, g, budget).collect()}
        assert got == want


def test_large_tiles_go_by_rounds(spark):
    nodes, arcs = lattice(6, 2)
    g = graph(spark, nodes, arcs)
    rows = [(0, 35, 0.0, 0.0, 5.0, 5.0, 40.0), (3, 8, 3.0, 0.0, 2.0, 1.0, 5.0)]
    asked = spark.createDataFrame(rows, "src long, dst long, sx double, sy double, dx double, dy double, most double")
    by = lambda n: sorted(map(tuple, R.routes(asked, g.nodes, g.arcs, n).collect()))
    assert by(10) == by(1000) and len(by(10)) == 2


def test_landmarks_bound_and_help():
    nodes, arcs = lattice(30, 9)
    at = np.array([(x, y) for _, x, y in nodes])
    u, v, w = (np.array(c) for c in zip(*arcs))
    net = R.Network(u, v, w, *at[u].T, *at[v].T)
    plain = net.costs_from(0)
    net.mark()
    assert all(net.bound(0, k) <= plain[k] for k in range(900)) and net.both_ways
    assert sum(net.bound(0, k) for k in range(900)) > 0.8 * sum(plain)


def test_the_number_of_jobs_does_not_follow_the_length(spark):
    counts = []
    for n in (11, 501):
        g = graph(spark, [(i, i / 100, 0.0) for i in range(n)], [(a, b, 0.01) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))])
        asked = spark.createDataFrame([(0, n - 1)], "src long, dst long")
        spark.sparkContext.setJobGroup(f"route-{n}", "")
        got = N.routes(asked, g).collect()
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"route-{n}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got[0]["path"] == list(range(n)) and got[0]["cost"] == pytest.approx((n - 1) / 100)
    assert abs(counts[0] - counts[1]) <= 3


def test_nothing_to_search(spark):
    g = graph(spark, [(0, 0.0, 0.0), (1, 0.0, 0.0)], [(0, 1, 0.5), (1, 0, 0.5)])
    none = spark.createDataFrame([], "src long, dst long")
    assert N.routes(none, g).collect() == []
    one = spark.createDataFrame([(0, 1), (1, 1), (0, 7)], "src long, dst long")
    assert sorted(map(tuple, N.routes(one, g, F.lit(1.0)).collect())) == [(0, 1, [0, 1], 0.5), (1, 1, [1], 0.0)]
    free = graph(spark, [(0, 0.0, 0.0), (1, 9.0, 0.0)], [(0, 1, 0.0)])
    assert N.routes(one.limit(1), free, F.lit(1.0)).count() == 1
