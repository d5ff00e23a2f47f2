"""Token counts by a separator scan of flat token files.

A flat token file is nothing but token ids of one width, little-endian, each document closed by an end-of-document id; it has no
index. Files are read in blocks by many tasks. A task finds the separators of a block with one vectorised comparison; how many
separators and where the last one lies before each block is a prefix scan over the blocks' sums, in two levels; so documents that
cross blocks are stitched without any task reading a file through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, fresh_path, text_slices

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the tokenizer cuts a text before it merges bytes, and the id that is free for the end of a document.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: Tokens of a block, and blocks of a group of the prefix scan's upper level.
BLOCK, GROUP = 1 << 20, 1024
#: A text is tokenized in stretches of about this many characters, cut before white space that a word follows.
STRETCH = 1 << 16


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, path: str, ranks_path: str = RANKS, end: int = END) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) into flat files of 16-bit ids below ``path``, one for each partition.

    Returns (file, ordinal, doc_id), the order of documents in each file. A null text is a document without tokens. A task writes
    beside its file and then moves it, so that one run again after a lost executor leaves one whole file.
    """
    with open(ranks_path, "rb") as f:  # a tokenizer's file, which is installed with the driver; tasks get its bytes
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shipped.value.splitlines())}
        encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.bin"
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        scratch, ordinal = f"{root}/_{name}.{task.taskAttemptId()}", 0
        out = None
        for batch in batches:
            for part in text_slices(batch, "text"):
                out = out or fs.open_output_stream(scratch)
                for text in part.column("text").to_pylist():
                    for tokens in encoding.encode_ordinary_batch(list(stretches(text or "")), num_threads=1):
                        out.write(np.array(tokens, dtype="<u2").tobytes())
                    out.write(np.array([end], dtype="<u2").tobytes())
                n = part.num_rows
                yield pa.record_batch([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), part.column("doc_id")], names=["file", "ordinal", "doc_id"])
                ordinal += n
        if out:
            out.close()
            fs.move(scratch, f"{root}/{name}")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "file string, ordinal long, doc_id long")


def stretches(text: str) -> Iterator[str]:
    """``text`` in parts at whose bounds the tokenizer cuts anyway: before a single space between two letters."""
    at = 0
    while len(text) - at > STRETCH:
        cut_at = at + STRETCH
        while cut_at < len(text) and not (text[cut_at] == " " and text[cut_at - 1].isalpha() and text[cut_at + 1 : cut_at + 2].isalpha()):
            cut_at += 1
        yield text[at:cut_at]
        at = cut_at
    yield text[at:]


def scan_tokens(spark: SparkSession, path: str, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """The documents of all flat token files below ``path``: (file, ordinal, start, n_tokens, closed).

    ``start`` is the position of a document's first token in its file. What follows a file's last separator is a document that is
    not closed, if it has tokens; bytes after the last whole token are no token. Files whose names begin with _ or . are left out;
    an empty folder gives an empty result.
    """
    fs, root = _open(path)
    files = [(f.base_name, f.size // width) for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name[0] not in "_."]
    listed = spark.createDataFrame(files, "file string, size long")
    blocks = listed.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))).alias("block"))
    blocks = blocks.repartition(max(spark.sparkContext.defaultParallelism, min(100_000, sum(-(-s // block) for _, s in files) // 4)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        for batch in batches:
            for file, size, number in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "block")), strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    f.seek(number * block * width)
                    tokens = np.frombuffer(f.read(min(block, size - number * block) * width), dtype=f"<u{width}")
                at = np.flatnonzero(tokens == end).astype(np.int64) + number * block
                yield pa.record_batch([pa.array([file]), pa.array([size]), pa.array([number]), pa.array([at], pa.list_(pa.int64()))], names=["file", "size", "block", "ends"])

    found = cut(blocks.mapInArrow(find, "file string, size long, block long, ends array<long>"))
    found = found.withColumn("part", F.floor(F.col("block") / GROUP)).withColumn("n", F.size("ends").cast("long")).withColumn("last", F.when(F.size("ends") > 0, F.element_at("ends", -1)))
    parts = found.groupBy("file", "part").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("file").alias("of"), F.col("part").alias("in_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base_n"), F.max("last").over(earlier).alias("base_last"))
    earlier = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("file", "part", "block", "size", "ends", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.max("last").over(earlier).alias("last_before"))
    carried = carried.join(parts, (F.col("file") == F.col("of")) & (F.col("part") == F.col("in_part")))
    first = F.col("base_n") + F.col("n_before")
    before = F.coalesce(F.greatest("base_last", "last_before"), F.lit(-1))
    starts = F.transform("ends", lambda _, i: F.when(i == 0, before).otherwise(F.element_at("ends", i)) + 1)
    tail = F.struct((F.coalesce(F.when(F.size("ends") > 0, F.element_at("ends", -1)), before) + 1).alias("start"), F.col("size").alias("stop"), F.lit(False).alias("closed"))
    closed = F.transform(F.arrays_zip(starts.alias("start"), F.col("ends").alias("stop")), lambda d: F.struct(d["start"].alias("start"), d["stop"].alias("stop"), F.lit(True).alias("closed")))
    is_last = F.col("block") == F.floor((F.col("size") - 1) / block)
    open_ = F.when(is_last & (tail["start"] < tail["stop"]), F.array(tail)).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,closed:boolean>>"))
    rows = carried.select("file", first.alias("first"), F.posexplode(F.concat(closed, open_)).alias("i", "d"))
    return rows.select("file", (F.col("first") + F.col("i")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.col("d.closed").alias("closed"))


def token_counts(docs: DataFrame, ranks_path: str = RANKS, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every document of ``docs`` (doc_id, text), counted in flat files written below ``path``.

    One row per input row, repeated rows included; null and empty texts have no tokens; an empty table gives an empty result; other
    columns are ignored. By default files go to the folder in ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    order = cut(write_tokens(docs, path, ranks_path))
    if not order.limit(1).count():
        return order.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    counts = scan_tokens(spark, path).select(F.col("file").alias("in_file"), F.col("ordinal").alias("at"), "n_tokens")
    return order.join(counts, (F.col("file") == F.col("in_file")) & (F.col("ordinal") == F.col("at"))).select("doc_id", "n_tokens")
