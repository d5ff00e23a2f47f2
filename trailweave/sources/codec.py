"""The packed form of a viewport's geometry: one binary for each batch of lines, little-endian, aligned to four bytes.

Layout: magic ``TWG1``; the byte length of a JSON list of types, padded to four bytes; that list; the number of lines; then of each line
its id (64-bit float), year (16-bit, 0 undated), type (16-bit index), number of vertices (32-bit) and vertices (32-bit lon, lat).
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

MAGIC = b"TWG1"
_LINE = struct.Struct("<dHHI")


def encode(types: list[str], lines: list[tuple[int, int, int, np.ndarray]]) -> bytes:
    """``lines``: (id, year, index of type, interleaved coords)."""
    table = json.dumps(types, ensure_ascii=False).encode()
    table += b" " * (-len(table) % 4)
    out = [MAGIC, struct.pack("<I", len(table)), table, struct.pack("<I", len(lines))]
    for id_, year, kind, coords in lines:
        coords = np.asarray(coords, dtype="<f4")
        out += [_LINE.pack(float(id_), year, kind, len(coords) // 2), coords.tobytes()]
    return b"".join(out)


def decode(data: bytes) -> tuple[list[str], list[tuple[int, int, int, np.ndarray]]]:
    view = memoryview(data)
    if bytes(view[:4]) != MAGIC:
        raise ValueError("not packed geometry: it doesn't begin with TWG1")
    (size,) = struct.unpack_from("<I", view, 4)
    types = json.loads(bytes(view[8 : 8 + size]))
    (n,) = struct.unpack_from("<I", view, 8 + size)
    at, out = 12 + size, []
    for _ in range(n):
        id_, year, kind, points = _LINE.unpack_from(view, at)
        at += _LINE.size
        out.append((int(id_), year, kind, np.frombuffer(view, dtype="<f4", count=2 * points, offset=at).copy()))
        at += 8 * points
    return types, out


def packed(rows: DataFrame, per_batch: int = 5000) -> DataFrame:
    """(batch, data): the drawn ``rows`` (id, type, start_ts_ms, coords) packed, at most about ``per_batch`` lines in one binary."""
    year = F.coalesce(F.year(F.timestamp_millis("start_ts_ms")), F.lit(0))
    n = max(1, -(-rows.count() // per_batch))
    ready = rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("batch"), "id", "type", year.alias("year"), "coords")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        types = list(dict.fromkeys(part["type"]))
        lines = [(i, y, types.index(t), c) for i, y, t, c in zip(part["id"], part["year"], part["type"], part["coords"], strict=True)]
        return pd.DataFrame({"batch": [part["batch"].iloc[0]], "data": [encode(types, lines)]})

    return ready.groupBy("batch").applyInPandas(pack, "batch long, data binary")


def unpacked(batches: DataFrame) -> DataFrame:
    """(id, type, year, coords) of ``packed`` batches."""

    def read(frames):
        for frame in frames:
            for data in frame["data"]:
                types, lines = decode(bytes(data))
                yield pd.DataFrame({"id": [x[0] for x in lines], "type": [types[x[2]] for x in lines], "year": [x[1] for x in lines], "coords": [x[3] for x in lines]})

    return batches.select("data").mapInPandas(read, "id long, type string, year int, coords array<float>")
