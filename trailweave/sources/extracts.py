"""OpenStreetMap extracts as a data source: each box is a partition, asked for by its own task, with a timeout, back-off and mirrors."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .osm import MIRRORS, drive_query, rail_query

#: (url, query, seconds) to status and body; raises OSError where there is no answer.
Ask = Callable[[str, str, float], tuple[int, str]]
SCHEMA = "box int, type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>"
FORMAT = "osm_extract"


def post(url: str, query: str, seconds: float) -> tuple[int, str]:
    """Ask over HTTP."""
    body = urllib.parse.urlencode({"data": query}).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/x-www-form-urlencoded", "Accept": "application/json", "User-Agent": "trailweave"})
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return answer.status, answer.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def answer(query: str, ask: Ask, mirrors: list[str], seconds: float, tries: int, pause: float) -> str:
    """The first answer, from the mirrors in turn; after a round without one comes a pause, twice as long each time.

    A mirror that is busy (429), broken (500 and more) or silent leads to the next; a request that is wrong is wrong everywhere.
    """
    error: Exception = OSError("no mirror")
    for k in range(max(1, tries)):
        if k:
            time.sleep(pause * 2 ** (k - 1))
        for url in mirrors:
            host = urllib.parse.urlparse(url).netloc or url
            try:
                status, body = ask(url, query, seconds)
            except OSError as e:
                error = OSError(f"{host}: {e}")
                continue
            if status == 200:
                return body
            error = OSError(f"{host} answered {status}: {body[:200]}")
            if status < 500 and status != 429:
                raise error
    raise error


@dataclass
class Box(InputPartition):
    number: int
    box: tuple[float, float, float, float]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], ask: Ask):
        self.boxes = [tuple(map(float, b)) for b in json.loads(options["boxes"])]
        self.layer = options.get("layer", "rail")
        self.mirrors = json.loads(options["mirrors"]) if "mirrors" in options else list(MIRRORS)
        self.seconds, self.tries, self.pause = float(options.get("timeout", 180)), int(options.get("tries", 3)), float(options.get("pause", 2))
        self.ask = ask

    def partitions(self) -> list[Box]:
        return [Box(k, b) for k, b in enumerate(self.boxes)]

    def read(self, partition: Box) -> Iterator[tuple]:
        seconds = int(self.seconds)
        query = drive_query(partition.box, seconds) if self.layer == "drive" else rail_query(partition.box, self.layer, seconds)
        for e in json.loads(answer(query, self.ask, self.mirrors, self.seconds, self.tries, self.pause)).get("elements", []):
            number = lambda c: float(e[c]) if isinstance(e.get(c), (int, float)) else None
            yield partition.number, e.get("type"), e.get("id"), number("lat"), number("lon"), e.get("nodes"), {str(k): str(v) for k, v in (e.get("tags") or {}).items()}


def extracts(ask: Ask = post) -> type[DataSource]:
    """The data source over a transport. Options: boxes (JSON, [min_lat, min_lon, max_lat, max_lon] each), layer (rail, road_tunnel or drive), mirrors (JSON), timeout (seconds), tries, pause."""

    class Extracts(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), ask)

    return Extracts


def read(spark: SparkSession, boxes: list[tuple[float, float, float, float]], layer: str = "rail", ask: Ask = post, **options) -> DataFrame:
    """The elements of extracts, for ``osm.network``: a task for each box."""
    spark.dataSource.register(extracts(ask))
    return spark.read.format(FORMAT).options(boxes=json.dumps([list(b) for b in boxes]), layer=layer, **options).load()
