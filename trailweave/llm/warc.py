"""WARC derivatives: of each response, a metadata record and a plain-text conversion record.

Both name the response by WARC-Refers-To and each other by WARC-Concurrent-To, and carry its target, date and digests on. The metadata
record holds, as JSON, the response's own WARC headers, its HTTP status and headers, and the page's title and links; the conversion
record holds the page's visible text. Record ids follow from the response's id, so that a task run again gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_slices
from .html import Page

DATE = "2024-01-01T00:00:00Z"
#: Columns of a response; ``block`` is the HTTP message, ``headers`` the record's WARC header lines, its version line first.
RESPONSE = "key long, record_id string, target_uri string, date string, payload_digest string, block_digest string, headers string, block string"
DERIVATIVE = "key long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, source_payload_digest string, block_digest string, content_length long, headers string, body string"

_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.IGNORECASE | re.DOTALL)
_LINK = re.compile(r"""<(a|link|img|script|iframe|area)\b[^>]*?\s(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{kind} {record_id}'.encode()).digest()[:16], version=5)}>"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html), as a crawler would have stored them. A null html is an empty body.

    A row's record id follows from its page_id, url and html, so repeated rows repeat it.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    length = F.octet_length(body)
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"), body)
    hexed = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), F.lit("\x00")), F.coalesce("url", F.lit("\x00")), body).cast("binary"))
    spot = [F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    made = pages.select(F.col("page_id").cast("long").alias("key"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *spot), F.lit(">")).alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"), body.alias("payload"), block.alias("block"))
    sha = lambda c: F.concat(F.lit("sha1:"), _base32(F.sha1(c.cast("binary"))))
    made = made.withColumns({"payload_digest": sha(F.col("payload")), "block_digest": sha(F.col("block"))})
    headers = F.concat_ws(
        "\r\n", F.lit("WARC/1.0"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Target-URI: "), "target_uri"),
        F.concat(F.lit("WARC-Payload-Digest: "), "payload_digest"), F.concat(F.lit("WARC-Block-Digest: "), "block_digest"), F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    return made.select("key", "record_id", "target_uri", "date", "payload_digest", "block_digest", headers.alias("headers"), "block")


def _base32(hexed):
    """Base 32 of 20 bytes in hexadecimal: five bits for each letter, by way of a string of bits."""
    # 160 bits are four runs of 40, each eight letters.
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    runs = [F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32) for k in range(4)]
    return F.translate(F.concat(*(F.lpad(r, 8, "0") for r in runs)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", letters)


def _header(pairs: list[tuple[str, str]]) -> str:
    return "\r\n".join(["WARC/1.0", *(f"{k}: {v}" for k, v in pairs if v)])


def fields(lines: str) -> tuple[str, list[tuple[str, str]]]:
    """The first line, and the (name, value) of all header lines; a line that goes on with white space belongs to the one before."""
    first, *rest = re.split(r"\r?\n", lines.strip("\r\n")) or [""]
    out: list[tuple[str, str]] = []
    for line in rest:
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return first, out


def plain_text(page: str) -> str:
    """The visible text of a page: all its blocks, menus included, one a line."""
    return "\n".join(block[1] for block in Page(page).blocks)


def derive(record: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    block = record["block"] or ""
    head, _, body = block.partition("\r\n\r\n") if "\r\n\r\n" in block else block.partition("\n\n")
    status, http = fields(head)
    source_line, source = fields(record["headers"] or "")
    source_id, target = record["record_id"] or "", record["target_uri"] or ""
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    is_page = "html" in kind.lower() or not kind
    title = _TITLE.search(body) if is_page else None
    links = [{"path": f"{m[1].upper()}@/{m[2].lower()}", "url": entities.unescape(m[3] or m[4] or m[5] or "")} for m in _LINK.finditer(body)] if is_page else []
    payload_digest = record["payload_digest"] or digest(body.encode("utf-8", "surrogatepass"))
    about = {
        "Envelope": {
            "WARC-Header-Line": source_line,
            "WARC-Header-Metadata": [[k, v] for k, v in source],
            "Block-Digest": record["block_digest"] or digest(block.encode("utf-8", "surrogatepass")),
            "Payload-Metadata": {
                "Actual-Content-Type": kind,
                "HTTP-Response-Metadata": {
                    "Response-Message": status,
                    "Headers": [[k, v] for k, v in http],
                    "Entity-Digest": payload_digest,
                    "Entity-Length": len(body.encode("utf-8", "surrogatepass")),
                    "HTML-Metadata": {"Title": " ".join(entities.unescape(title[1]).split()) if title else "", "Links": links},
                },
            },
        }
    }
    bodies = {"metadata": json.dumps(about, ensure_ascii=False, separators=(",", ":")), "conversion": plain_text(body) if is_page else body}
    ids = {k: derived_id(source_id, k) for k in bodies}
    out = []
    for k, other in (("metadata", "conversion"), ("conversion", "metadata")):
        data = bodies[k].encode("utf-8", "surrogatepass")
        header = _header(
            [
                ("WARC-Type", k), ("WARC-Record-ID", ids[k]), ("WARC-Refers-To", source_id), ("WARC-Concurrent-To", ids[other]), ("WARC-Target-URI", target), ("WARC-Date", record["date"] or ""),
                ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(data)), ("Content-Type", "application/json" if k == "metadata" else "text/plain; charset=utf-8"), ("Content-Length", str(len(data))),
            ]
        )
        out.append({"key": record["key"], "record_type": k, "record_id": ids[k], "refers_to": source_id, "concurrent_to": ids[other], "target_uri": target, "source_payload_digest": payload_digest, "block_digest": digest(data), "content_length": len(data), "headers": header, "body": bodies[k]})
    return out


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of all ``records`` (columns of RESPONSE; others are ignored): two rows for each.

    Null columns count as empty; a digest that a response lacks is computed. A body that isn't HTML is its own plain text. Repeated
    rows give repeated records; an empty table gives an empty result.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "block"):
                rows = [r for record in part.to_pylist() for r in derive(record)]
                yield pa.record_batch([pa.array([r[c] for r in rows], pa.int64() if c in ("key", "content_length") else pa.string()) for c in rows[0]], names=list(rows[0]))

    return records.select(*(c.split()[0] for c in RESPONSE.split(", "))).mapInArrow(build, DERIVATIVE)


def serialised(records: DataFrame) -> DataFrame:
    """``records`` of ``derivatives`` with ``record``, the bytes that stand for each in a WARC file."""
    return records.withColumn("record", F.concat(F.concat("headers", F.lit("\r\n\r\n"), "body", F.lit("\r\n\r\n")).cast("binary")))
