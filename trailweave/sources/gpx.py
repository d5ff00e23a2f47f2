"""GPX documents: found, read, checked and taken apart, one row a file to one row a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite, iso_week, iso_week_of_name

_text = T.StringType()
_point = T.StructType([T.StructField(n, _text) for n in ("_lat", "_lon", "ele", "time")])
_visit = T.StructType([T.StructField(n, _text) for n in ("_lat", "_lon", "time", "name")])
_segment = T.StructType([T.StructField("trkpt", T.ArrayType(_point))])
_track = T.StructType([T.StructField("name", _text), T.StructField("type", _text), T.StructField("trkseg", T.ArrayType(_segment))])
DOCUMENT = T.StructType([T.StructField("trk", T.ArrayType(_track)), T.StructField("wpt", T.ArrayType(_visit)), T.StructField("_corrupt_record", _text)])

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_ISO = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?\s*$"


def number(text: Column) -> Column:
    """A decimal number, NaN for anything else: what can't be read stays and is flagged later."""
    return F.coalesce(F.when(text.rlike(_NUMBER), text.try_cast("double")), F.lit(float("nan")))


def millis(text: Column) -> Column:
    """Epoch milliseconds of an ISO 8601 time, UTC unless it says otherwise; null for anything else."""
    return F.when(text.rlike(_ISO), F.unix_millis(F.try_to_timestamp(F.trim(text))))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _exists(spark: SparkSession, path: str) -> bool:
    """If a path, or a pattern of paths, is there on the file system that it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, size, modified, file_hash, xml) of all ``.gpx`` files, in any case, below the paths; hidden files and paths that don't exist are left out."""
    paths = [p for p in ([paths] if isinstance(paths, str) else paths) if _exists(spark, p)]
    if not paths:
        return described(spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[gG][pP][xX]").load(paths)
    return described(found)


def described(found: DataFrame) -> DataFrame:
    """The columns of ``read`` from those of a binaryFile scan, batch or stream."""
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_hash"), F.try_to_binary(F.hex("content"), F.lit("hex")).cast("string").alias("xml"))


def parsed(files: DataFrame) -> DataFrame:
    """``files`` with ``doc``, and ``error`` where a file is no GPX document: another root, an empty one, or broken XML."""
    root = F.regexp_extract("xml", r"(?s)^\x{FEFF}?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<([A-Za-z_][\w:.-]*)", 1)
    empty = F.col("xml").rlike(r"(?s)<gpx\s*/>\s*$|<gpx>\s*</gpx>\s*$")
    doc = F.from_xml("xml", DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = files.withColumn("doc", doc)
    error = F.when((root != "gpx") | empty, "not a GPX document: no <gpx> root").when(F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull() | ~F.col("xml").contains("</gpx>"), "broken XML")
    return out.withColumn("error", error)


def _kind(track: Column) -> Column:
    return F.coalesce(F.lower(blank_to_null(track["type"])), F.lit("unknown"))


def _segments_of(doc: Column) -> Column:
    """All segments of a document, one after the other, with the number, name and type of their track and their number in it."""
    empty = F.array().cast(T.ArrayType(_segment))
    of = lambda t, i: F.transform(F.coalesce(t["trkseg"], empty), lambda s, j: F.struct(i.alias("track_no"), blank_to_null(t["name"]).alias("track_name"), _kind(t).alias("type"), j.alias("segment_no"), s["trkpt"].alias("points")))
    return F.flatten(F.transform(doc["trk"], of))


def _visits_of(doc: Column) -> Column:
    """The visits of a document that have a position."""
    each = F.transform(doc["wpt"], lambda w: F.struct(number(w["_lat"]).alias("lat"), number(w["_lon"]).alias("lon"), millis(w["time"]).alias("ts_ms"), blank_to_null(w["name"]).alias("name")))
    return F.filter(each, lambda v: finite(v["lat"]) & finite(v["lon"]))


def points(docs: DataFrame) -> DataFrame:
    """(path, file_hash, track_no, track_name, type, segment_no, segment_at, seq, lat, lon, ele, ts_ms); a segment without points is a row of nulls.

    ``segment_at`` numbers a document's segments from 0; columns of ids that ``with_ids`` gave are kept.
    """
    own = [c for c in ("file_id", "track_base", "segment_base") if c in docs.columns]
    segments = docs.where("error IS NULL").select("path", "file_hash", *own, F.posexplode(_segments_of(F.col("doc"))).alias("segment_at", "s"))
    each = segments.select("path", "file_hash", *own, "segment_at", "s.track_no", "s.track_name", "s.type", "s.segment_no", F.posexplode_outer("s.points").alias("seq", "p"))
    has = F.col("p").isNotNull()
    ele = number(F.col("p.ele"))
    return each.select(
        "path", "file_hash", *own, "track_no", "track_name", "type", "segment_no", "segment_at", F.col("seq").cast("long").alias("seq"),
        F.when(has, number(F.col("p._lat"))).alias("lat"), F.when(has, number(F.col("p._lon"))).alias("lon"),
        F.when(finite(ele), ele).alias("ele"), millis(F.col("p.time")).alias("ts_ms"),
    )


def tracks(docs: DataFrame) -> DataFrame:
    """(path, file_hash, track_no, track_name, type) of every track, those without segments, too."""
    own = [c for c in ("file_id", "track_base") if c in docs.columns]
    each = docs.where("error IS NULL").select("path", "file_hash", *own, F.posexplode("doc.trk").alias("track_no", "trk"))
    return each.select("path", "file_hash", *own, "track_no", blank_to_null(F.col("trk.name")).alias("track_name"), _kind(F.col("trk")).alias("type"))


def visits(docs: DataFrame) -> DataFrame:
    """(path, file_hash, visit_no, lat, lon, ts_ms, name); visits without a position are dropped."""
    own = [c for c in ("file_id", "visit_base") if c in docs.columns]
    return docs.where("error IS NULL").select("path", "file_hash", *own, F.posexplode(_visits_of(F.col("doc"))).alias("visit_no", "v")).select("path", "file_hash", *own, "visit_no", "v.*")


def with_ids(docs: DataFrame, first: dict[str, int]) -> DataFrame:
    """``docs`` with file_id, and the ids from which each one's tracks, segments and visits count (track_base, segment_base, visit_base).

    Ids go on from ``first`` (by files, tracks, segments, visits) in the order of paths. What is numbered is one row of counts for each file.
    """
    size = lambda c: F.when(F.col("error").isNull(), F.coalesce(F.size(c), F.lit(0))).otherwise(0).cast("long")
    counts = docs.select("path", size(F.coalesce("doc.trk", F.array())).alias("tracks"), size(F.coalesce(_segments_of(F.col("doc")), F.array())).alias("segments"), size(F.coalesce(_visits_of(F.col("doc")), F.array())).alias("visits"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: (F.coalesce(F.sum(c).over(before), F.lit(0)) + first[c]).cast("long")
    ids = counts.select("path", (F.count(F.lit(1)).over(before) + first["files"]).cast("long").alias("file_id"), base("tracks").alias("track_base"), base("segments").alias("segment_base"), base("visits").alias("visit_base"))
    return docs.join(ids, "path")


def unseen(files: DataFrame, imported: DataFrame) -> DataFrame:
    """Files whose content hasn't been imported; of equal ones in this batch, the first path."""
    fresh = files.join(imported.where("status = 'imported'").select("file_hash"), "file_hash", "left_anti")
    first = fresh.groupBy("file_hash").agg(F.min("path").alias("first_path"))
    return fresh.join(first, "file_hash").where("path = first_path").select(files.columns)


def spans(docs: DataFrame) -> DataFrame:
    """(path, start_ms, end_ms): the dates that a file covers, by all points and visits, flagged or not."""
    both = points(docs).select("path", "ts_ms").unionByName(visits(docs).select("path", "ts_ms"))
    return both.groupBy("path").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))


def weeks(files: DataFrame, start: str = "start_ts_ms") -> DataFrame:
    """``files`` with iso_year and iso_week: from the name, or else from the first time."""
    (ny, nw), (ty, tw) = iso_week_of_name(F.col("name")), iso_week(F.col(start))
    return files.withColumns({"iso_year": F.coalesce(ny, F.when(nw.isNull(), ty)), "iso_week": F.coalesce(nw, tw)})
