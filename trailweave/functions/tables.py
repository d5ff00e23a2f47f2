"""Table functions: a line's vertices as rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Vertices:
    """(n, lon, lat) of interleaved ``coords``, of their own width; breaks are left out but counted by ``part``. No rows of a null line."""

    @staticmethod
    def analyze(coords: AnalyzeArgument) -> AnalyzeResult:
        kind = coords.dataType
        if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType))):
            raise ValueError(f"coords must be an array of numbers, not {kind.simpleString()}")
        return AnalyzeResult(StructType().add("n", IntegerType()).add("part", IntegerType()).add("lon", kind.elementType).add("lat", kind.elementType))

    def eval(self, coords: list[float] | None) -> Iterator[tuple]:
        part = 0
        for n in range(len(coords or ()) // 2):
            lon, lat = coords[2 * n], coords[2 * n + 1]
            if lon != lon or lat != lat:
                part += 1
            else:
                yield n, part, float(lon), float(lat)


def vertices(spark: SparkSession, lines: DataFrame, key: str = "segment_id", coords: str = "coords") -> DataFrame:
    """(key, n, part, lon, lat): the vertices of ``lines``, by a lateral join with the table function, which SQL knows as ``vertices``."""
    spark.udtf.register("vertices", udtf(Vertices))
    return spark.sql(f"SELECT l.`{key}`, v.n, v.part, v.lon, v.lat FROM {{lines}} l, LATERAL vertices(l.`{coords}`) v", lines=lines)
