"""Streams: files as they arrive, points cleaned as they come."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import DEFAULT_CEILING, speed_ceiling, valid_position
from ..operators.clean import INVALID, _fold
from ..plans.ingest import import_files
from ..sources import gpx
from ..sources.store import Settings, Store
from .live import observed

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of the columns of gpx.read: files below ``path`` as they arrive, each once."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[gG][pP][xX]").option("maxFilesPerTrigger", per_batch).load(path)
    return gpx.described(found)


def import_stream(files: DataFrame, store: Store, checkpoint: str, settings: Settings | None = None, overwrite=None):
    """Import a stream's files batch by batch, all that are there, then stop. Content seen before is skipped by its hash.

    Batches observe ``files`` (their number and bytes), and each is a row of the store's performance log, with what it imported; a ``live.Recorder`` sees both the
    stream's start and end and the batches between.

    A batch that is run again after a failure finds its files imported and changes nothing. ``overwrite`` (a function of a batch)
    gives the windows that late or overlapping exports replace: ``ingest.spans`` for what each file covers, of files not seen before.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        start = time.time()
        got = import_files(store, rows, settings, overwrite(gpx.unseen(rows, store.read("files"))) if overwrite else None)
        detail = f"files={got.files} skipped={got.skipped} failed={got.failed} points={got.points}"
        store.log_performance("import", (time.time() - start) * 1000, detail, int(start * 1000))
        rows.unpersist()

    return observed(files, "files", bytes=F.sum("size")).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cleaned(points: DataFrame, default: float = DEFAULT_CEILING) -> DataFrame:
    """A stream of points (segment_id, type, seq, ts_ms, lat, lon) with ``flag``; points of a segment come in order.

    The state of a segment is its last clean point, so a stream and a batch give the same flags.
    """
    rows = points.select("segment_id", "seq", F.col("ts_ms").cast("double").alias("ts_ms"), "lat", "lon", speed_ceiling(F.col("type"), None, default).alias("ceiling"), F.when(valid_position(F.col("lat"), F.col("lon")), 0).otherwise(INVALID).alias("flag"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk = pd.concat(list(frames)).sort_values("seq", kind="stable").reset_index(drop=True)
        has, lat, lon, ts = (True, *state.get) if state.exists else (False, 0.0, 0.0, float("nan"))
        rows = chunk.assign(chunk=0, has=has, in_lat=lat, in_lon=lon, in_ts=ts)
        # Undated points are NaN in pandas and null in Arrow.
        done = pa.Table.from_batches(_fold(iter([pa.RecordBatch.from_pandas(rows, preserve_index=False)]))).to_pandas()
        clean = done[done["flag"] == 0]
        if len(clean):
            state.update(tuple(float(clean[c].iloc[-1]) for c in ("lat", "lon", "ts_ms")))
        yield done[["segment_id", "seq", "flag"]]

    return rows.groupBy("segment_id").applyInPandasWithState(step, "segment_id long, seq long, flag int", "lat double, lon double, ts double", "append", GroupStateTimeout.NoTimeout)


def active_types(points: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream's points by type and window of event time; points later than ``late`` are left out."""
    at = points.withColumn("at", F.timestamp_millis("ts_ms")).where(F.col("at").isNotNull()).withWatermark("at", late)
    return at.groupBy(F.window("at", window), "type").agg(F.count(F.lit(1)).alias("points")).select(F.col("window.start").alias("start"), "type", "points")
