"""Mixing sources to target weights by entropy balancing.

Of all rates per document that give a source its target number of words, those closest to one in relative entropy are the words'
exponential tilts min(CAP, exp(lambda * size)): one lambda for each source, the solution of a convex dual problem. Newton steps solve it
over a source's cells, the numbers of documents by source and size, all sources at once as groups. Rates become whole copies
cell by cell from the longest documents to the shortest, what rounding leaves over passing to the next, so that a source ends within
about half its shortest documents of its target.

A cell stands for any number of documents. Sizes being different whole numbers, a source of W words has at most sqrt(2 W) + 1 cells,
which bounds the one group of cells for each source. No job is run for a step, so what the driver plans doesn't follow their number.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Newton stops when every source is this close to its target, relatively, or after so many steps.
TOLERANCE, STEPS = 1e-9, 60
#: Documents of one cell among which copies are dealt out in one group.
DEAL = 4096


def words(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources`` (source, source_size) with their ``weight`` and ``target``.

    Weights repeat over the sources by code point, null last. Targets share ``share`` of all sizes by weight and stop at ``cap``
    times a source's size, the excess shared again by weight among the others: target = min(cap * size, weight * level) for the one
    level at which targets add up. The level rises until no more source reaches its cap.
    """
    at = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    known = cut(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1).cast("double")))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    top, level, capped = cap * F.col("source_size"), 0.0, -1
    while total:
        full = top <= F.col("weight") * level
        row = known.agg(F.coalesce(F.sum(F.when(full, top)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        if row[2] == capped or not row[1]:
            break
        capped, level = row[2], (share * total - row[0]) / row[1]
    return known.withColumn("target", F.least(top.cast("double"), F.col("weight") * level))


def balance(size: np.ndarray, n: np.ndarray, target: float, cap: float = CAP) -> np.ndarray:
    """The rates of one source's cells, ``n`` documents of ``size`` words each, sizes over 0: min(cap, exp(lambda * size)), by which it takes ``target`` words.

    Newton steps for lambda, in units of one over the mean size, are held within a bracket that every step narrows, so that they
    converge from anywhere.
    """
    words_ = n * size
    if target >= cap * words_.sum() * (1 - 1e-12):
        return np.full(len(size), float(cap))
    x = size / (words_.sum() / n.sum())
    tilt, low, high = 0.0, -700.0, 700.0
    for _ in range(STEPS):
        rate = np.exp(np.minimum(700.0, tilt * x))
        taken = float((words_ * np.minimum(float(cap), rate)).sum())
        slope = float(np.where(rate < cap, words_ * x * rate, 0.0).sum())
        if abs(taken - target) <= TOLERANCE * target:
            break
        over = taken > target
        low, high = (low, tilt) if over else (tilt, high)
        next_ = tilt + (target - taken) / slope if slope else math.nan
        if not low < next_ < high:
            next_ = tilt * 2 - 1 if low <= -700 and over else tilt * 2 + 1 if high >= 700 and not over else (low + high) / 2
        tilt = next_
    return np.minimum(float(cap), np.exp(np.minimum(700.0, tilt * x)))


def _copied(cap: int):
    def whole(cells: pd.DataFrame) -> pd.DataFrame:
        """Copies of each cell of a source: rates times documents, rounded from the longest to the shortest, the remainder of words passed on."""
        cells = cells.sort_values("size", ascending=False, kind="stable")
        sizes, docs = cells["size"].to_numpy(np.float64), cells["n"].to_numpy(np.float64)
        left, out = 0.0, []
        for size, n, rate in zip(cells["size"].to_numpy(), cells["n"].to_numpy(), balance(sizes, docs, float(cells["target"].iloc[0]), cap), strict=True):
            want = rate * n + left / size
            copies = min(max(math.floor(want + 0.5), 0), cap * int(n))
            left = (want - copies) * size
            out.append(copies)
        return cells.assign(copies=np.array(out, dtype=np.int64))

    return whole


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix of every document of ``docs`` (doc_id, text, source).

    Returns doc_id, source, size, source_size, target, copies (0 to ``cap``), taken (copies * size), row_key: one row per input row,
    repeated rows included. Documents of no words take one copy and no words. Which documents of a cell take one copy more goes by a
    hash of doc_id and text, so that reruns agree. Null sources are one source, last in order. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), row_key(docs).alias("row_key"))
    rows = cut(rows)
    cells = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = targets(sources, weights, share, cap).select("source", "source_size", "target")
    of = sources.select(F.col("source").alias("s"), "source_size", "target")
    sized = cells.where("size > 0").join(of, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    copies = sized.groupBy("source").applyInPandas(_copied(cap), sized.select("*").schema.add("copies", "long"))
    # Documents of one cell are dealt into groups of about DEAL by their hash; each group gets its part of the cell's copies.
    groups = F.ceil(F.col("cell_n") / DEAL)
    cell = cut(copies.select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("n").alias("cell_n"), "copies", "source_size", "target"))
    dealt = rows.where("size > 0").join(cell, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")))
    dealt = cut(dealt.withColumn("part", F.pmod(F.xxhash64("row_key"), groups).cast("long")))
    parts = dealt.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("part_n"), F.first("cell_n").alias("cell_n"), F.first("copies").alias("copies"))
    upto = F.sum("part_n").over(Window.partitionBy("source", "size").orderBy("part"))
    extra = F.col("copies") % F.col("cell_n")
    share_of = lambda docs_: F.floor(extra * docs_ / F.col("cell_n"))
    parts = parts.withColumn("upto", upto).select(
        F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("part").alias("p_part"),
        (share_of(F.col("upto")) - share_of(F.col("upto") - F.col("part_n"))).alias("more"),
    )
    dealt = dealt.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("row_key", "doc_id"))
    all_ = F.floor(F.col("copies") / F.col("cell_n")) + (rank <= F.col("more")).cast("long")
    dealt = dealt.select("doc_id", "source", "size", "source_size", "target", all_.alias("copies"), (all_ * F.col("size")).alias("taken"), "row_key")
    # No words, nothing to weigh: they stay as they are.
    none = sources.select(F.col("source").alias("s"), "source_size", "target")
    none = rows.where("size = 0").join(none, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken"), "row_key")
    return dealt.unionByName(none)


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", "text", "source")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` in the mix: every row as often as it takes copies, all columns kept. Repeated rows share the copies of all."""
    shares = mix(docs).groupBy("doc_id", "row_key").agg(F.sum("copies").alias("m_copies"), F.count(F.lit(1)).alias("m_rows"))
    shares = cut(shares.where("m_copies > 0").select(F.col("doc_id").alias("m_id"), F.col("row_key").alias("m_key"), "m_copies", "m_rows"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # a document's own columns may be called anything
    rows = docs.select(docs["doc_id"].cast("long").alias("own_id"), row_key(docs).alias("own_key"), *(docs[c].alias(n) for c, n in names.items()))
    joined = rows.join(shares, F.col("own_id").eqNullSafe(F.col("m_id")) & (F.col("own_key") == F.col("m_key")))
    once = joined.where("m_rows = 1").unionByName(joined.where("m_rows > 1").dropDuplicates(["m_id", "m_key"]))
    each = once.withColumn("m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m_copies"))))
    return each.select(*(F.col(n).alias(c) for c, n in names.items()))
