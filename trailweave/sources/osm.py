"""OpenStreetMap extracts: queries, fetching through a given function, JSON to nodes and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import BUS_KIND, RAIL_KINDS, ROAD_CLASSES, ROAD_TUNNEL_KIND, rail_kind, road_class

#: Where extracts may be asked for, in turn.
MIRRORS = ("https://overpass-api.de/api/interpreter", "https://overpass.kumi.systems/api/interpreter")
ELEMENTS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"


def _box(min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> str:
    return f"({min_lat},{min_lon},{max_lat},{max_lon})"


def _asking(filters: list[str], box: str, timeout: int) -> str:
    ways = "".join(f"way{f}{box};" for f in filters)
    return f"[out:json][timeout:{timeout}];({ways});(._;>;);out body;"


def rail_query(box: tuple[float, float, float, float], layer: str, timeout: int = 180) -> str:
    """The query for a layer: ``rail`` (all railways) or ``road_tunnel``."""
    if layer == "road_tunnel":
        roads = "|".join(f"{c}|{c}_link" for c in list(ROAD_CLASSES)[:5])
        return _asking([f'["highway"~"^({roads})$"]["tunnel"="yes"]'], _box(*box), timeout)
    return _asking([f'["railway"~"^({"|".join(RAIL_KINDS)})$"]'], _box(*box), timeout)


def drive_query(box: tuple[float, float, float, float], timeout: int = 180) -> str:
    roads = "|".join([*ROAD_CLASSES, *(f"{c}_link" for c in list(ROAD_CLASSES)[:5])])
    return _asking([f'["highway"~"^({roads})$"]', '["highway"="busway"]'], _box(*box), timeout)


def fetch(query: str, ask: Callable[[str, str], tuple[int, str]], mirrors: tuple[str, ...] = MIRRORS) -> str:
    """The answer of the first mirror that gives one. ``ask`` (url, query) returns status and body or raises OSError.

    A busy or broken mirror leads to the next; a request that is wrong is wrong everywhere.
    """
    error: Exception = OSError("no mirror")
    for url in mirrors:
        try:
            status, body = ask(url, query)
        except OSError as e:
            error = e
            continue
        if status == 200:
            return body
        error = OSError(f"{url} answered {status}")
        if status < 500 and status != 429:
            break
    raise error


def elements(spark: SparkSession, json: str | list[str]) -> DataFrame:
    """The elements of answers, a row each; ``json`` is their text, or paths of files."""
    if isinstance(json, str):
        docs = spark.createDataFrame([(json,)], "value string")
    else:
        docs = spark.read.text(json, wholetext=True)
    return docs.select(F.from_json("value", ELEMENTS).alias("d")).select(F.inline("d.elements"))


def way_kind(layer: str) -> Column:
    """The kind of a way by its tags: rails by railway, tunnels all alike, roads by highway."""
    tag = lambda name: F.try_element_at(F.col("tags"), F.lit(name))
    if layer == "road_tunnel":
        return F.lit(ROAD_TUNNEL_KIND)
    if layer == "drive":
        bus_only = (tag("highway") == "busway") | tag("bus").isin("designated", "yes") & tag("access").isin("no", "private")
        return F.when(F.coalesce(bus_only, F.lit(False)), BUS_KIND).otherwise(road_class(tag("highway")))
    return rail_kind(tag("railway"))


def network(found: DataFrame, layer: str = "rail") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``elements``: a way of k nodes is k - 1 edges; edges that lack a node, and loops, are dropped, as are unused nodes."""
    from ..operators.network import used_nodes

    nodes = found.where((F.col("type") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("id", "lat", "lon").dropDuplicates(["id"])
    ways = found.where((F.col("type") == "way") & (F.size("nodes") >= 2)).select("nodes", way_kind(layer).cast("int").alias("kind"))
    n = F.size("nodes") - 1
    steps = ways.select(F.explode(F.arrays_zip(F.slice("nodes", 1, n).alias("a"), F.slice("nodes", 2, n).alias("b"))).alias("e"), "kind").select("e.a", "e.b", "kind").where("a <> b")
    for end in ("a", "b"):
        steps = steps.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return used_nodes(nodes, steps), steps.select("a", "b", "kind")
