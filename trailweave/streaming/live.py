"""Streams of points and rides whose rows come late, twice or out of order; and what a stream tells of its progress."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.scalars import DEFAULT_CEILING, speed_ceiling, valid_position
from ..operators.clean import INVALID, _fold
from ..operators.edits import WINDOW_MS
from ..operators.joins import MOST_TASKS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000

# ---- points in any order


_POINT = StructType([StructField(c, t) for c, t in (("seq", LongType()), ("ts_ms", DoubleType()), ("lat", DoubleType()), ("lon", DoubleType()), ("ceiling", DoubleType()), ("flag", IntegerType()), ("at_ms", DoubleType()))])
_LAST = StructType([StructField(c, t) for c, t in (("seq", LongType()), ("at_ms", DoubleType()), ("has", IntegerType()), ("lat", DoubleType()), ("lon", DoubleType()), ("ts_ms", DoubleType()))])
_FLAGS = StructType([StructField("segment_id", LongType()), StructField("seq", LongType()), StructField("flag", IntegerType())])
NAN = float("nan")


def ready(held: pd.DataFrame, after: int, before_ms: float, watermark: float) -> int:
    """How many of the ``held`` points, sorted by seq, nothing can come before any more.

    A point that follows the last one (``after``, whose time was ``before_ms``) is ready at once. After a gap a point is ready when the watermark has passed
    it, what came before it and the next dated point after it: what is missing would lie before that, and be late. An undated point after a gap waits
    until there is a dated one after it, as what is missing may be as late as that.
    """
    n, reached = 0, before_ms
    seqs, times = held["seq"].tolist(), held["at_ms"].tolist()
    following, ahead = [], NAN
    for at in reversed(times):
        following.append(ahead)
        ahead = at if at == at else ahead
    for k, (seq, at, then) in enumerate(zip(seqs, times, reversed(following), strict=True)):
        if at == at:
            reached = max(reached, at)
        if seq > after + 1:
            if (at != at and then != then) or max(reached, then if then == then else reached) > watermark:
                break
        after, n = max(after, seq), k + 1
    return n


class Reordered(StatefulProcessor):
    """Holds a segment's points until those before them are there or too late to come, then flags them in order against the last clean point."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _POINT)
        self.last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        return self._release(key, new[_POINT.names], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._release(key, None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _release(self, key, new: pd.DataFrame | None, watermark: int) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(NAN if v is None else v for v in row) for row in self.held.get()], columns=_POINT.names) if self.held.exists() else None
        frames = [f for f in (held, new) if f is not None and len(f)]
        if not frames:
            return
        points = pd.concat(frames).sort_values("seq", kind="stable").reset_index(drop=True)
        state = self.last.get() if self.last.exists() else None
        seq, at, has, lat, lon, ts = state if state is not None else (-1, float("-inf"), 0, 0.0, 0.0, NAN)
        n = ready(points, int(seq), float(at), watermark)
        rest = points.iloc[n:]
        if n:
            out = points.iloc[:n]
            rows = out.assign(segment_id=key[0], chunk=0, has=bool(has), in_lat=lat, in_lon=lon, in_ts=NAN if ts is None else ts).astype({"seq": "int64", "flag": "int64", "segment_id": "int64"})
            done = pa.Table.from_batches(_fold(iter([pa.RecordBatch.from_pandas(rows, preserve_index=False)]))).to_pandas()
            clean = done[done["flag"] == 0]
            if len(clean):
                has, (lat, lon, ts) = 1, (float(clean[c].iloc[-1]) for c in ("lat", "lon", "ts_ms"))
            times = out["at_ms"].dropna()
            at = max(float(at), float(times.max())) if len(times) else float(at)
            self.last.update((max(int(seq), int(out["seq"].max())), at, int(has), float(lat), float(lon), float(NAN if ts is None else ts)))
            yield done[["segment_id", "seq", "flag"]].astype({"flag": "int32"})
        if len(rest):
            self.held.put([(int(r.seq), r.ts_ms, r.lat, r.lon, r.ceiling, int(r.flag), r.at_ms) for r in rest.itertuples(index=False)])
            # when the watermark passes what the first of them waits for, there may be no new row to tell; without a dated point it waits for a row
            dated = pd.concat([rest["at_ms"].iloc[:1], rest["at_ms"].iloc[1:].dropna().iloc[:1]]).dropna()
            if len(dated):
                self.handle.registerTimer(int(max(dated.max(), float(at), watermark + 1)))
        else:
            self.held.clear()


def reordered(points: DataFrame, late: str = "10 minutes", default: float = DEFAULT_CEILING) -> DataFrame:
    """(segment_id, seq, flag) of a stream of points (segment_id, type, seq, ts_ms, lat, lon) that may come in any order, up to ``late`` behind the latest.

    ``seq`` counts a segment's points from 0. A point waits until those before it have come or can't come any more, so the flags are those of
    a batch over the same points. Points that come later than that are dropped. Undated points wait for those before them, or for a dated one after them.
    The session must keep state in RocksDB (``ROCKS``).
    """
    at = F.timestamp_millis("ts_ms").alias("at")
    flag = F.when(valid_position(F.col("lat"), F.col("lon")), 0).otherwise(INVALID).cast("int").alias("flag")
    rows = points.select("segment_id", "seq", F.col("ts_ms").cast("double").alias("ts_ms"), "lat", "lon", speed_ceiling(F.col("type"), None, default).cast("double").alias("ceiling"), flag, F.col("ts_ms").cast("double").alias("at_ms"), at)
    rows = rows.withWatermark("at", late)
    return rows.groupBy("segment_id").transformWithStateInPandas(Reordered(), _FLAGS, "append", "EventTime")


# ---- repeats


def without_repeats(points: DataFrame, keys: list[str], at: Column, late: str = "10 minutes") -> DataFrame:
    """A stream without rows whose ``keys`` have been seen within ``late`` of each other; state goes as the watermark passes.

    Rows without a time (``at``) are to be left out before: their state would go at once.
    """
    rows = points.withColumn("_at", at).withWatermark("_at", late)
    return rows.dropDuplicatesWithinWatermark(keys).drop("_at")


# ---- rides near in time


#: Rows that go through the join as one, at most, and about so many rows that a task sorts at once to pack them.
PACK, SLAB = 250, 1 << 17
#: About so many pairs of an anchor and a ride that a task spells out.
SPELLED_A_TASK = 1 << 22


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, ms, row) as packs (block, first_ms, last_ms, rows): of one block and ``PACK`` rows at most, and near in time as far as a task's rows allow."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= SLAB:
            yield _packs(held)
            held, n = [], 0
    if n:
        yield _packs(held)


def _packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("block", "ascending"), ("ms", "ascending")])).combine_chunks().to_batches()[0]
    block, ms, n = rows["block"].to_numpy(), rows["ms"].to_numpy(), rows.num_rows
    bounds = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, n]
    cuts = np.concatenate([np.arange(a, b, PACK) for a, b in pairwise(bounds)])
    ends = np.r_[cuts[1:], n]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[cuts, n], pa.int32()), rows["row"])
    return pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array(ms[cuts]), pa.array(ms[ends - 1]), lists], ["block", "first_ms", "last_ms", "rows"])


def _in_packs(rows: DataFrame, ms: str, within_ms: int, s: str) -> DataFrame:
    """(s_block, s_first, s_last, s_rows): packs of the ``rows`` of a stream, by blocks of ``within_ms``; each row as a struct."""
    keyed = rows.select(F.floor(F.col(ms) / within_ms).cast("long").alias("block"), F.col(ms).cast("long").alias("ms"), F.struct(*rows.columns).alias("row"))
    shape = StructType([StructField(c, LongType()) for c in ("block", "first_ms", "last_ms")] + [StructField("rows", ArrayType(keyed.schema["row"].dataType))])
    return keyed.repartition("block").mapInArrow(packed, shape).toDF(*(f"{s}_{c}" for c in ("block", "first", "last", "rows")))


def packs_near_in_time(anchors: DataFrame, segments: DataFrame, categories: DataFrame, within_ms: int = WINDOW_MS, late: str = "1 hour") -> DataFrame:
    """(anchors, rides): packs of rows of the two streams of ``near_in_time`` which hold all its pairs, each once; ``spelled`` makes them rows.

    Rows of a batch are packed by blocks of time as long as the window, and packs of both streams are joined by block, of which an anchor meets three. State is
    dealt by block and, as what is written, holds whole packs: what grows with the number of pairs is spelled out afterwards, by as many tasks as it needs.
    A pack is as late as its latest row, and goes from the state when the other stream's watermark has passed all that it could meet.
    """
    shown = segments.join(categories.where("ignored").select(F.col("name").alias("type")), "type", "left_anti")
    rides = shown.where("start_ts_ms IS NOT NULL").select("id", "type", F.col("start_ts_ms").alias("start_ms"))
    rides = _in_packs(rides, "start_ms", within_ms, "r").withColumn("r_at", F.timestamp_millis("r_last")).withWatermark("r_at", late)
    asked = _in_packs(anchors.where("at_ms IS NOT NULL").select("anchor", "at_ms"), "at_ms", within_ms, "a").withColumn("a_at", F.timestamp_millis("a_last")).withWatermark("a_at", late)
    asked = asked.withColumn("near", F.explode(F.array(F.col("a_block") - 1, F.col("a_block"), F.col("a_block") + 1)))
    # Rows of a pack lie less than a window before its last one. The exact test has two columns of each side, so that no watermark is read into it.
    span = F.expr(f"INTERVAL '{2 * within_ms / 1000:.3f}' SECOND")
    meet = F.greatest(F.col("a_first") - within_ms, F.col("r_first")) <= F.least(F.col("a_last") + within_ms, F.col("r_last"))
    close = (F.col("near") == F.col("r_block")) & (F.col("r_at") >= F.col("a_at") - span) & (F.col("r_at") <= F.col("a_at") + span) & meet
    return asked.join(rides, close).select(F.col("a_rows").alias("anchors"), F.col("r_rows").alias("rides"))


def spelled(packs: DataFrame, within_ms: int = WINDOW_MS) -> DataFrame:
    """(anchor, at_ms, id, type, start_ms): the pairs in ``packs`` (``packs_near_in_time``) that are within ``within_ms`` of each other."""
    pairs = packs.select(F.inline("anchors"), "rides").select("anchor", "at_ms", F.inline("rides"))
    at = F.col("at_ms").cast("long")
    return pairs.where(F.col("start_ms").between(at - within_ms, at + within_ms))


def dealt(packs: DataFrame) -> DataFrame:
    """``packs`` that have been written, dealt so that tasks spell out about as many pairs each."""
    total = packs.agg(F.sum(F.size("anchors").cast("long") * F.size("rides"))).first()[0] or 0
    return packs.repartition(min(MOST_TASKS, 1 + total // SPELLED_A_TASK))


def near_in_time(anchors: DataFrame, segments: DataFrame, categories: DataFrame, within_ms: int = WINDOW_MS, late: str = "1 hour") -> DataFrame:
    """(anchor, at_ms, id, type, start_ms): a stream of ``anchors`` (anchor, at_ms) with the rides of another, ``segments`` (id, type, start_ts_ms),
    that start within ``within_ms`` of them, but those of ignored ``categories``; undated rows meet nothing.

    Where many rides start near many anchors, ``packs_near_in_time`` leaves the pairs to be spelled out after the stream.
    """
    return spelled(packs_near_in_time(anchors, segments, categories, within_ms, late), within_ms)


# ---- progress


class Recorder(StreamingQueryListener):
    """Keeps a row for each event of the session's streams: their start, each batch with its rows, time and observed metrics, their end.

    Rows are kept until ``table`` or ``taken`` hands them on, so a long stream's recorder should be emptied from time to time.
    """

    SCHEMA = "query string, kind string, batch long, rows long, ms long, metrics map<string,long>, error string"

    def __init__(self) -> None:
        self._rows: list[tuple] = []
        self._lock = threading.Lock()
        self._ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def _add(self, *row) -> None:
        with self._lock:
            self._rows.append(row)

    def onQueryStarted(self, event) -> None:
        self._add(event.name or str(event.id), "started", None, None, None, None, None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = {f"{name}.{k}": int(v) for name, row in p.observedMetrics.items() for k, v in row.asDict().items() if v is not None}
        self._add(p.name or str(p.id), "batch", p.batchId, p.numInputRows, p.durationMs.get("triggerExecution"), metrics, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(str(event.id), "error" if event.exception else "done", None, None, None, None, event.exception)
        self._end(str(event.runId)).set()

    def wait(self, query, seconds: float | None = None) -> None:
        """Until ``query`` has ended and its events have come; they come a little after it."""
        query.awaitTermination(None if seconds is None else int(seconds))
        if not self._end(str(query.runId)).wait(60):
            raise TimeoutError("the stream's end wasn't reported")

    def taken(self) -> list[tuple]:
        """The rows so far, which are then forgotten."""
        with self._lock:
            rows, self._rows = self._rows, []
        return rows

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.taken(), self.SCHEMA)


def observed(rows: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """``rows`` with sums that a recorder sees for each batch: their number, and ``metrics`` (whole numbers)."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *(F.coalesce(m.cast("long"), F.lit(0).cast("long")).alias(k) for k, m in metrics.items()))
