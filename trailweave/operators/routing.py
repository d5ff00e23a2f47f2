"""Cheapest paths between many pairs of nodes at once, each within a budget.

A budget bounds how far a path can stray: its nodes lie in an ellipse about the pair's ends. Pairs are dealt to tiles of a size that
follows their ellipses, an arc to the tiles that can hold both its ends, and each tile searches for its pairs with a heap on its own part
of the graph (A-star; bounds from positions and, where a tile has many pairs, from landmarks). So the number of jobs doesn't depend on
the length of the routes. A tile with more arcs than a task should hold is searched by rounds of joins instead.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: Pairs that one task searches for, arcs that it may hold, and pairs from which landmarks pay; how many there are.
PAIRS, ARCS, FROM, LANDMARKS = 512, 1 << 21, 16, 4
#: Room for the rounding of bounds.
SLACK = 1e-9
_FOUND = "src long, dst long, path array<long>, cost double"
_TILE = ["level", "tx", "ty", "part"]


class Network:
    """The part of a graph that a tile holds; nodes are numbered in the order of their ids."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, ux: np.ndarray, uy: np.ndarray, vx: np.ndarray, vy: np.ndarray):
        self.ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        tail, head = place[: len(u)], place[len(u) :]
        x, y = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        x[tail], y[tail], x[head], y[head] = ux, uy, vx, vy
        self.x, self.y = x.tolist(), y.tolist()
        far = np.hypot(x[tail] - x[head], y[tail] - y[head])
        #: What a degree costs at least.
        self.rate = float(np.min(w[far > 0] / far[far > 0], initial=math.inf))
        self.rate = 0.0 if math.isinf(self.rate) else self.rate * (1 - SLACK)
        self.ahead, self.behind = self._lists(tail, head, w), self._lists(head, tail, w)
        self.both_ways = bool(np.array_equal(*(m[np.lexsort(m.T)] for m in (np.stack([tail, head, w], axis=1), np.stack([head, tail, w], axis=1)))))
        self.marks: list[list[float]] = []

    def _lists(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[list[tuple[int, float]]]:
        out: list[list[tuple[int, float]]] = [[] for _ in self.ids]
        for i, j, c in zip(a.tolist(), b.tolist(), w.tolist()):
            out[i].append((j, c))
        return out

    def number(self, node: int) -> int | None:
        at = int(np.searchsorted(self.ids, node))
        return at if at < len(self.ids) and self.ids[at] == node else None

    def costs_from(self, start: int) -> list[float]:
        out = [math.inf] * len(self.ids)
        out[start], heap = 0.0, [(0.0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > out[u]:
                continue
            for v, w in self.ahead[u]:
                if d + w < out[v]:
                    out[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        return out

    def mark(self, n: int = LANDMARKS) -> None:
        """Landmarks, each the node that is farthest from those before it, and the costs from them."""
        if not len(self.ids):
            return
        least = np.array(self.costs_from(0))
        for _ in range(n):
            at = int(np.argmax(np.where(np.isfinite(least), least, -1)))
            self.marks.append(self.costs_from(at))
            least = np.minimum(least, self.marks[-1])

    def bound(self, u: int, to: int) -> float:
        """What a path from ``u`` to ``to`` costs at least."""
        best = self.rate * math.hypot(self.x[u] - self.x[to], self.y[u] - self.y[to])
        for costs in self.marks:
            if math.isfinite(costs[u]):
                gap = costs[to] - costs[u]
                best = max(best, (abs(gap) if self.both_ways else gap) * (1 - SLACK))
        return best

    def path(self, src: int, dst: int, most: float) -> tuple[list[int], float] | None:
        """The cheapest path within ``most``; of equally cheap ones that of the fewest arcs, then the least by its nodes."""
        cost, goal = {src: 0.0}, math.inf
        heap = [(self.bound(src, dst), 0.0, src)]
        bounds: dict[int, float] = {}
        while heap:
            f, d, u = heapq.heappop(heap)
            if f > min(goal, most) * (1 + SLACK) + SLACK:
                break
            if d > cost[u] or u == dst:
                continue
            for v, w in self.ahead[u]:
                c = d + w
                if c <= most and c < cost.get(v, math.inf):
                    cost[v] = c
                    if v == dst:
                        goal = c
                    if v not in bounds:
                        bounds[v] = self.bound(v, dst)
                    heapq.heappush(heap, (c + bounds[v], c, v))
        if dst not in cost:
            return None
        # back from the goal along arcs that cost exactly what they should, a layer at a time
        steps, layer = {dst: 0}, [dst]
        while src not in steps:
            layer = [u for v in layer for u, w in self.behind[v] if u in cost and u not in steps and cost[u] + w == cost[v] and steps.setdefault(u, steps[v] + 1)]
        out = [src]
        while (u := out[-1]) != dst:
            out.append(min(v for v, w in self.ahead[u] if steps.get(v) == steps[u] - 1 and cost[u] + w == cost[v]))
        return out, cost[dst]


def _search(pairs: pa.Table, arcs: pa.Table) -> pa.Table:
    if not pairs.num_rows:
        return pairs.select(["src", "dst"]).slice(0, 0).append_column("path", pa.array([], pa.list_(pa.int64()))).append_column("cost", pa.array([], pa.float64()))
    net = Network(*(arcs.column(c).to_numpy() for c in ("u", "v", "w", "ux", "uy", "vx", "vy")))
    if pairs.num_rows >= FROM:
        net.mark()
    found: list[tuple] = []
    for src, dst, most in zip(*(pairs.column(c).to_pylist() for c in ("src", "dst", "most"))):
        if src == dst:
            found.append((src, dst, [src], 0.0))
        elif (a := net.number(src)) is not None and (b := net.number(dst)) is not None and (way := net.path(a, b, most)):
            found.append((src, dst, net.ids[way[0]].tolist(), way[1]))
    columns = list(zip(*found)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["src", "dst", "path", "cost"])


def _reach(pairs: DataFrame, rate: float) -> DataFrame:
    """``pairs`` with the level and the tile of the box about all that their budgets reach."""
    half = F.col("most") / (2 * rate)
    f = F.hypot(F.col("dx") - F.col("sx"), F.col("dy") - F.col("sy")) / 2
    b2 = F.greatest(F.lit(0.0), half * half - f * f)
    tilt = lambda along: F.coalesce(F.try_divide(along * along, 4 * f * f), F.lit(0.0))
    hx = F.sqrt(b2 + tilt(F.col("dx") - F.col("sx")) * (half * half - b2))
    hy = F.sqrt(b2 + tilt(F.col("dy") - F.col("sy")) * (half * half - b2))
    grown = 1 + 1e-6
    hx, hy = (F.when(f > 0, h).otherwise(half) * grown + 1e-9 for h in (hx, hy))
    level = F.ceil(F.log2(F.greatest(hx, hy) * 2)).cast("int")
    out = pairs.withColumns({"level": level, "left": (F.col("sx") + F.col("dx")) / 2 - hx, "low": (F.col("sy") + F.col("dy")) / 2 - hy})
    size = F.pow(F.lit(2.0), F.col("level"))
    return out.withColumns({"tx": F.floor(F.col("left") / size), "ty": F.floor(F.col("low") / size)}).drop("left", "low")


def _tiled(arcs: DataFrame, tiles: DataFrame, levels: list[int]) -> DataFrame:
    """Arcs beside each of the ``tiles`` (level, tx, ty and more) whose two by two cells hold both their ends."""
    laid = arcs.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    size = F.pow(F.lit(2.0), F.col("level"))

    def shared(u: str, v: str):
        a, b = F.floor(F.col(u) / size), F.floor(F.col(v) / size)
        return F.when(F.abs(a - b) <= 1, F.sequence(F.greatest(a, b) - 1, F.least(a, b)))  # the cells from which both are within one

    laid = laid.withColumn("tx", F.explode(shared("ux", "vx"))).withColumn("ty", F.explode(shared("uy", "vy")))
    return laid.join(tiles, ["level", "tx", "ty"])


def routes(pairs: DataFrame, nodes: DataFrame, arcs: DataFrame, most_arcs: int | None = None) -> DataFrame:
    """(src, dst, path, cost): the cheapest path of every pair (src, dst, sx, sy, dx, dy, most) that has one of at most ``most``.

    ``nodes``: (id, x, y); ``arcs``: (u, v, w) with w of 0 or more. Of equally cheap paths the one of the fewest arcs, then the least.
    """
    at = nodes.select("id", "x", "y")
    placed = arcs.select("u", "v", "w").join(at.select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u").join(at.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
    far = F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy"))
    rate = placed.where(far > 0).agg(F.min(F.col("w") / far)).first()[0]
    if rate is not None and rate <= 0:  # some arc costs nothing, so that no budget bounds how far a path strays
        return by_rounds(pairs, arcs)
    reach = cut(_reach(pairs, rate or 1.0))
    per_tile = reach.groupBy("level", "tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    levels = [r["level"] for r in per_tile.select("level").distinct().collect()]  # powers of two, a few dozen at most
    if not levels:
        return by_rounds(pairs, arcs).limit(0)
    tiles = per_tile.select("level", "tx", "ty", F.ceil(F.col("n") / PAIRS).cast("int").alias("parts"))
    held = _tiled(placed, tiles, levels).groupBy("level", "tx", "ty", "parts").agg(F.count(F.lit(1)).alias("arcs"))
    tiles = cut(tiles.join(held, ["level", "tx", "ty", "parts"], "left").withColumn("large", F.coalesce(F.col("arcs") > (most_arcs or ARCS), F.lit(False))))
    spread = reach.join(tiles, ["level", "tx", "ty"])
    asked = spread.where("NOT large").select("level", "tx", "ty", F.pmod(F.xxhash64("src", "dst"), F.col("parts")).cast("int").alias("part"), "src", "dst", "most")
    beside = _tiled(placed, tiles.where("NOT large").select("level", "tx", "ty", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), levels)
    beside = beside.select(*_TILE, "u", "v", "w", "ux", "uy", "vx", "vy")
    found = asked.groupBy(*_TILE).cogroup(beside.groupBy(*_TILE)).applyInArrow(_search, _FOUND)
    if tiles.where("large").isEmpty():
        return found
    return found.unionByName(by_rounds(spread.where("large").select("src", "dst", "most"), arcs))


def by_rounds(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """The same by rounds that extend every pair's frontier by one arc: of any size, but a job for each arc of the longest path."""
    state = cut(pairs.select("src", "dst", F.col("src").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("turn"), F.array("src").alias("path"), "most"))
    for turn in itertools.count(1):  # ends: costs grow, and budgets bound them
        goal = state.where("node = dst").select("src", "dst", F.col("cost").alias("goal"))
        ahead = state.where((F.col("turn") == turn - 1) & (F.col("node") != F.col("dst"))).join(arcs, F.col("node") == F.col("u"))
        ahead = ahead.select("src", "dst", F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.lit(turn).alias("turn"), F.concat("path", F.array("v")).alias("path"), "most").where("cost <= most")
        # an arrival that costs what is known is dropped by its larger turn
        ahead = ahead.join(goal, ["src", "dst"], "left").where(F.col("goal").isNull() | (F.col("cost") < F.col("goal"))).select(*state.columns)
        best = state.unionByName(ahead).groupBy("src", "dst", "node").agg(F.min(F.struct("cost", "turn", "path", "most")).alias("m"))
        state = cut(best.select("src", "dst", "node", "m.cost", "m.turn", "m.path", "m.most"))
        if not state.where(F.col("turn") == turn).limit(1).count():
            break
    return state.where("node = dst").select("src", "dst", "path", "cost")
