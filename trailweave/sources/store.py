"""A store of tables: Parquet files by commit, a log of what each commit replaces, adds or takes away, and a settings file.

A commit writes the rows it brings below a new version and, last, its rows of the log, which is itself a table that Spark appends to. A
table is its newest replacement and the files added since, less those that later commits took away, so what a commit costs follows what
it brings or changes, not what is there. The log holds zones of each file (least and greatest values of some columns), by which scans leave
files out before any is opened, and changes rewrite only the files that hold what changes. A commit that fails before its log leaves
what was there. One writer at a time; ``compact`` makes many small additions one, and brings older rows to the present schema.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, fields

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import hilbert

SCHEMA_VERSION = 2

TABLES = {
    "files": "id long, path string, file_hash string, size long, status string, error string, iso_year int, iso_week int, track_count long, segment_count long, point_count long, visit_count long",
    "tracks": "id long, file_id long, name string, type string",
    "segments": "id long, track_id long, file_id long, type string, start_ts_ms long, end_ts_ms long, point_count long, clean_point_count long, min_lat double, min_lon double, max_lat double, max_lon double, flags long",
    "points": "segment_id long, seq long, ts_ms long, lat double, lon double, ele double, flag int",
    "levels": "segment_id long, detail int, point_count long, coords array<float>",
    "matched": "segment_id long, detail int, point_count long, coords array<float>",
    "visits": "id long, file_id long, name string, ts_ms long, lat double, lon double, place_id long",
    "places": "id long, name string",
    "categories": "name string, color string, visible boolean, ignored boolean, custom boolean, priority int",
    "overlay": "segment_id long, seq double, kind string, lat double, lon double, ts_ms long",
    "rail_nodes": "id long, lat double, lon double",
    "rail_edges": "a long, b long, kind int",
    "rail_coverage": "category string, min_lat double, min_lon double, max_lat double, max_lon double, fetched_at_ms long, node_count long, edge_count long",
    "route_nodes": "id long, lat double, lon double",
    "route_edges": "a long, b long, kind int",
    "route_coverage": "category string, min_lat double, min_lon double, max_lat double, max_lon double, fetched_at_ms long, node_count long, edge_count long",
    "performance": "id long, name string, ms double, detail string, at_ms long",
}
#: By what a table's files are clustered, so that scans skip most of them: segments and visits by where they are, on a curve that keeps near things near.
CLUSTERED: dict[str, Callable[[], list[Column]]] = {
    "segments": lambda: [hilbert((F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2), F.col("id")],
    "visits": lambda: [hilbert(F.col("lat"), F.col("lon")), F.col("id")],
    "points": lambda: [F.col("segment_id"), F.col("seq")],
    "levels": lambda: [F.col("detail"), F.col("segment_id")],
    "matched": lambda: [F.col("detail"), F.col("segment_id")],
}
#: Columns whose zones the log keeps for each file; other tables are kept by folder.
ZONES = {
    "segments": ["id", "track_id", "min_lat", "min_lon", "max_lat", "max_lon", "start_ts_ms", "end_ts_ms"], "visits": ["id", "ts_ms", "lat", "lon"], "tracks": ["id"], "files": ["id"], "performance": ["id"],
    "points": ["segment_id", "ts_ms"], "levels": ["segment_id", "detail"], "matched": ["segment_id", "detail"], "overlay": ["segment_id"],
}
LOG = "version long, name string, schema_version int, adds boolean, path string, gone boolean, rows long, zones map<string,struct<lo:double,hi:double,nulls:boolean>>"
#: Tables that a commit writes at a time.
WRITERS = 4
#: Ids of which a change tells the files apart: blocks of so many.
BLOCK = 4096


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Edges with a < b, one of each, as version 2 keeps them."""
    return edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("kind").alias("kind"))


#: What brings rows of older versions to each version, by table; rows of the version or later ones come out as they went in.
MIGRATIONS: dict[int, dict[str, Callable[[DataFrame], DataFrame]]] = {2: {"rail_edges": canonical_edges, "route_edges": canonical_edges}}


def between(column: str, low: float, high: float, nulls: bool = False) -> Column:
    """Of a file's zones: may it hold a row whose ``column`` lies within ``low`` and ``high`` (or, with ``nulls``, is null)?"""
    zone = F.col("zones")[column]
    hit = (zone["hi"] >= low) & (zone["lo"] <= high)
    return zone.isNull() | F.coalesce(hit, F.lit(False)) | (zone["nulls"] if nulls else F.lit(False))


def box(min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    """Of a file's zones: may it hold a segment whose box meets this one?"""
    inf = float("inf")
    return between("max_lat", min_lat, inf) & between("min_lat", -inf, max_lat) & between("max_lon", min_lon, inf) & between("min_lon", -inf, max_lon)


class Store:
    """``parts``: the files into which a clustered table is written; as Spark finds fit by default."""

    def __init__(self, spark: SparkSession, root: str, parts: int | None = None):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def _log(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(LOG).parquet(f"{self.root}/log")
        except AnalysisException:
            return None

    def _since(self) -> DataFrame | None:
        """The log from each table's newest replacement on."""
        log = self._log()
        if log is None:
            return None
        # Older logs have a row for each commit and table, of which the oldest don't say that they replace.
        whole = F.max(F.when(F.col("path").isNull() & ~F.coalesce("adds", F.lit(False)), F.col("version")))
        return log.join(log.groupBy("name").agg(F.coalesce(whole, F.lit(0)).alias("whole")), "name").where("version >= whole")

    def versions(self) -> dict[str, list[int]]:
        """The versions that make up each table: its newest replacement, and those that added to it or changed it since."""
        since = self._since()
        return {} if since is None else {r["name"]: r["parts"] for r in since.groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("parts")).collect()}

    def files(self, name: str, meets: Column | None = None) -> DataFrame:
        """(path, schema_version, rows, zones) of the files, or folders, that make up a table, but those whose zones rule out ``meets``."""
        since = self._since()
        if since is None:
            return self.spark.createDataFrame([], "path string, schema_version int, rows long, zones map<string,struct<lo:double,hi:double,nulls:boolean>>")
        own = since.where(F.col("name") == name)
        folder = F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(f"/{name}"))
        there = own.where(F.col("path").isNotNull() & ~F.coalesce("gone", F.lit(False)))
        older = own.where(F.col("path").isNull() & (F.col("schema_version") < 2)).withColumn("path", folder)
        alive = there.unionByName(older).join(own.where("gone").select("path"), "path", "left_anti")
        return (alive if meets is None else alive.where(meets)).select("path", "schema_version", "rows", "zones")

    def read(self, name: str, meets: Column | None = None) -> DataFrame:
        """A table as last committed, empty if it never was; of ``meets`` (over a file's ``zones``) only the files that may hold such rows.

        Columns added since are null in older files; what else changed between versions is brought up to date.
        """
        return self._rows(name, [(r["path"], r["schema_version"]) for r in self.files(name, meets).select("path", "schema_version").collect()])

    def _rows(self, name: str, files: list[tuple[str, int]]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(TABLES[name]).parquet(*(f"{self.root}/{path}" for path, _ in files))
        oldest = min(version for _, version in files)
        for version, steps in sorted(MIGRATIONS.items()):
            if version > oldest and name in steps:
                rows = steps[name](rows).select(*rows.columns)
        return rows

    def highest(self, *names: str) -> dict[str, int]:
        """The greatest ``id`` of each table, 0 in an empty one: from the zones, or else from the rows."""
        since = self._since()
        if since is None:
            return dict.fromkeys(names, 0)
        own = since.where(F.col("name").isin(*names))
        gone = own.where("gone").select("name", "path")
        unzoned = F.col("path").isNull() & (F.col("schema_version") < 2) | F.col("path").isNotNull() & F.col("zones").isNull()
        alive = own.where(~F.coalesce("gone", F.lit(False))).join(gone, ["name", "path"], "left_anti")
        found = {r["name"]: r for r in alive.groupBy("name").agg(F.max(F.col("zones")["id"]["hi"]).alias("top"), F.max(unzoned).alias("scan")).collect()}
        return {n: int((self.read(n).agg(F.max("id")).first()[0] if n in found and found[n]["scan"] else found[n]["top"] if n in found else 0) or 0) for n in names}

    def holding(self, name: str, column: str, ids: DataFrame) -> tuple[DataFrame, list[str]]:
        """(rows, paths) of the files that may hold one of ``ids`` (id) in ``column``, told apart by blocks of ids."""
        blocks = ids.select(F.floor(F.col("id") / BLOCK).alias("block")).distinct()
        files = self.files(name)
        zone = F.col("zones")[column]
        spans = files.select("path", F.explode(F.when(zone.isNotNull(), F.sequence(F.floor(zone["lo"] / BLOCK), F.floor(zone["hi"] / BLOCK)))).alias("block"))
        met = spans.join(blocks, "block", "left_semi").select("path").union(files.where(zone.isNull()).select("path")).distinct()
        found = [(r["path"], r["schema_version"]) for r in files.join(met, "path", "left_semi").select("path", "schema_version").collect()]
        return self._rows(name, found), [p for p, _ in found]

    def meeting(self, name: str, meets: Column) -> tuple[DataFrame, list[str]]:
        """(rows, paths) of the files whose zones don't rule out ``meets``."""
        found = [(r["path"], r["schema_version"]) for r in self.files(name, meets).select("path", "schema_version").collect()]
        return self._rows(name, found), [p for p, _ in found]

    def commit(self, add: dict[str, DataFrame] | None = None, instead: dict[str, tuple[DataFrame, list[str]]] | None = None, **tables: DataFrame) -> int:
        """Replace ``tables``, add the rows of ``add`` (by table) to others, and put the rows of ``instead`` in the place of files (rows, paths), as one new
        version; all or nothing is seen. A table may be both changed and added to.
        """
        add, instead = add or {}, {n: v for n, v in (instead or {}).items() if v[1]}
        if both := (add.keys() | instead.keys()) & tables.keys():
            raise ValueError(f"both replaced and added to: {sorted(both)}")
        version = max((v for parts in self.versions().values() for v in parts), default=0) + 1

        def written(name: str) -> DataFrame:
            brought = [d for d in (tables.get(name), add.get(name), instead[name][0] if name in instead else None) if d is not None]
            kinds = self.spark.createDataFrame([], TABLES[name]).dtypes
            rows = None
            for d in brought:
                d = d.select(*(F.col(c).cast(t).alias(c) for c, t in kinds))
                rows = d if rows is None else rows.unionByName(d)
            if by := CLUSTERED.get(name):
                rows = rows.repartitionByRange(*([self.parts] if self.parts else []), *by()).sortWithinPartitions(*by())
            rows.write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
            mine = [(version, name, SCHEMA_VERSION, name not in tables, None, False, None, None)]
            mine += [(version, name, SCHEMA_VERSION, True, path, True, None, None) for path in (instead[name][1] if name in instead else [])]
            if name not in ZONES:
                mine.append((version, name, SCHEMA_VERSION, name not in tables, f"v{version}/{name}", False, None, None))
            mine = self.spark.createDataFrame(mine, LOG)
            return mine.unionByName(self._zones(version, name, name not in tables)) if name in ZONES else mine

        names = list(dict.fromkeys((*tables, *add, *instead)))
        with ThreadPoolExecutor(WRITERS) as pool:  # tables are written side by side, as small ones don't fill a cluster
            parts = list(pool.map(inheritable_thread_target(self.spark)(written), names))
        log = functools.reduce(DataFrame.unionByName, parts) if parts else None
        if log is not None:
            log.coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return version

    def _zones(self, version: int, name: str, adds: bool) -> DataFrame:
        """The log's rows of the files of a commit: a scan of the columns that have zones."""
        rows = self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/v{version}/{name}")
        zone = lambda c: F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), (F.count(c) < F.count(F.lit(1))).alias("nulls"))
        zones = F.map_from_arrays(F.array(*map(F.lit, ZONES[name])), F.array(*map(zone, ZONES[name])))
        of = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"), zones.alias("zones"))
        return of.select(
            F.lit(version).cast("long").alias("version"), F.lit(name).alias("name"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(adds).alias("adds"),
            F.concat(F.lit(f"v{version}/{name}/"), "file").alias("path"), F.lit(False).alias("gone"), "rows", "zones",
        )

    def append(self, name: str, rows: DataFrame) -> int:
        return self.commit(add={name: rows})

    def compact(self, *names: str) -> int | None:
        """Write each of ``names`` (all tables by default) that has additions, changes or rows of older versions as one replacement, clustered anew."""
        since = self._since()
        if since is None:
            return None
        state = since.groupBy("name").agg(F.countDistinct("version").alias("n"), F.min("schema_version").alias("oldest"))
        many = [r["name"] for r in state.where((F.col("n") > 1) | (F.col("oldest") < SCHEMA_VERSION)).collect() if not names or r["name"] in names]
        return self.commit(**{n: self.read(n) for n in many}) if many else None

    def log_performance(self, name: str, ms: float, detail: str, at_ms: int) -> int:
        next_id = self.highest("performance")["performance"] + 1
        return self.append("performance", self.spark.createDataFrame([(next_id, name, float(ms), detail, at_ms)], TABLES["performance"]))

    def recent_performance(self, limit: int = 50) -> DataFrame:
        return self.read("performance").orderBy(F.desc("id")).limit(max(0, min(200, limit)))


@dataclass
class Settings:
    """Limits and tunings; unknown keys of a file are ignored, unreadable files give the defaults."""

    max_segments: int = 100_000
    max_pins: int = 5_000
    max_points: int = 300_000
    snap_m: float = 200.0
    transfer_m: float = 60.0
    ceilings: dict[str, float] = field(default_factory=dict)
    default_ceiling: float = 300.0

    def __post_init__(self) -> None:
        if self.max_segments == 20_000:  # the cap of earlier versions, too low for large archives
            self.max_segments = 100_000
        self.snap_m = min(1000.0, max(20.0, self.snap_m))
        self.transfer_m = min(500.0, max(0.0, self.transfer_m))

    @classmethod
    def parse(cls, text: str | None) -> Settings:
        try:
            got = json.loads(text or "")
        except ValueError:
            return cls()
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in got.items() if k in names}) if isinstance(got, dict) else cls()

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)
