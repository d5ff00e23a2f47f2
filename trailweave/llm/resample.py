"""Importance resampling towards a target: documents are drawn by how much likelier their words and word pairs are in the target texts.

The words of a block of texts become ids, and one suffix array of these ids, sorted to the depth of the longest n-gram, brings equal n-grams
together: the runs in which neighbours share n words or more (LCP) are the different n-grams of n words. Each run is hashed once, from the
checksums of its words, and its bucket goes back to all places where it occurs. Two passes over the texts: one counts buckets (a partial count
for each task, then summed by Spark), one scores.

Odd input: a null text has no words, so no features and weight 0; a null id is the empty string in the draw's hash and comes first among ties;
repeated rows each have a row, of their own rank where drawn; an empty table gives an empty one, and an empty target is one that holds no features;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, text_slices
from .terms import encoded_words, word_bytes

BUCKETS = 10_000
LONGEST = 2
#: Bytes of text of one suffix array; a longer text has one of its own.
BLOCK = 1 << 21
#: Copies of a row that are made at once.
COPIES = 4096
_INSIDE = word_bytes(("0", "9"))

# --- CRC-32 of joined strings ------------------------------------------------------------------------------------------------------


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_TABLE = _byte_table()


def _applied(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


def _doubled() -> list[np.ndarray]:
    """Tables of the linear map that appends 2**k zero bytes to what has the checksum c, for k up to 31."""
    values = np.arange(256, dtype=np.uint32)
    zero = lambda c: _TABLE[c & 255] ^ (c >> 8)
    out = [np.stack([zero(values << np.uint32(8 * b)) for b in range(4)])]
    for _ in range(31):
        out.append(np.stack([_applied(out[-1], out[-1][b]) for b in range(4)]))
    return out


_ZEROS = _doubled()


def checksums(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and length of each of many byte strings, a byte of all of them at a time, longest first so that those that are over drop out."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    order = np.argsort(-sizes, kind="stable")
    at, left = ends[:-1][order], np.sort(sizes)
    c = np.full(len(words), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(left[-1]) if len(left) else 0):
        n = len(left) - int(np.searchsorted(left, k, side="right"))
        c[:n] = _TABLE[(c[:n] ^ data[at[:n] + k]) & 255] ^ (c[:n] >> 8)
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out, sizes


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Checksums of strings made of two each: those of the parts, and the second part's length in bytes."""
    size = np.broadcast_to(np.asarray(size, dtype=np.int64), first.shape)
    out = first.copy()
    for k in range(int(size.max(initial=0)).bit_length()):
        at = np.flatnonzero((size >> k) & 1)
        out[at] = _applied(_ZEROS[k], out[at])
    return out ^ second


_SPACE = np.uint32(_TABLE[(0xFFFFFFFF ^ 0x20) & 255] ^ np.uint32(0x00FFFFFF) ^ np.uint32(0xFFFFFFFF))

# --- Suffix arrays -----------------------------------------------------------------------------------------------------------------


def suffixes(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of word ids, sorted to ``depth`` words, and the words that each suffix shares with the one before it (at most ``depth``).

    ``left`` counts the words from each place to its text's end, itself among them, so no suffix runs into the next text.
    """
    key, width = ids.astype(np.int64), int(ids.max(initial=0)) + 2
    for k in range(1, depth):
        following = np.zeros(len(ids), dtype=np.int64)
        following[: len(ids) - k] = ids[k:] + 1
        following[left <= k] = 0
        if int(key.max(initial=0)) >= (1 << 62) // width:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + following
    order = np.argsort(key, kind="stable")
    shared = np.zeros(len(ids), dtype=np.int64)
    a, b, same = order[1:], order[:-1], np.ones(max(0, len(ids) - 1), dtype=bool)
    for k in range(depth):
        same = same & (left[a] > k) & (left[b] > k)
        at = np.flatnonzero(same)
        same[at] = ids[a[at] + k] == ids[b[at] + k]
        shared[1:] += same
    return order, shared


def buckets(texts: pa.Array, longest: int = LONGEST, n_buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n from 1 to ``longest``: n, the bucket at every place, whether an n-gram begins there, and the texts' first places (n + 1)."""
    words, ids, first = encoded_words(texts, _INSIDE)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(ids))
    order, shared = suffixes(ids, left, longest)
    sums, sizes = checksums(words)
    for n in range(1, longest + 1):
        run = np.cumsum(shared < n) - 1
        head = order[np.flatnonzero(shared < n)]
        whole = left[head] >= n  # else no n-gram begins there
        head_whole = head[whole]
        crc = sums[ids[head_whole]] if len(head_whole) else np.zeros(0, np.uint32)
        for k in range(1, n):
            word = ids[head_whole + k]
            crc = joined(joined(crc, _SPACE, 1), sums[word], sizes[word])
        of_run = np.zeros(len(head), dtype=np.int64)
        of_run[whole] = crc.astype(np.int64) % n_buckets
        at = np.zeros(len(ids), dtype=np.int64)
        at[order] = of_run[run]
        yield n, at, left >= n, first


def _counted(longest: int, n_buckets: int):
    def count(batches):
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK):
                for _, at, here, _ in buckets(part.column("text"), longest, n_buckets):
                    total += np.bincount(at[here], minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, n_buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of n-grams by bucket over all texts: ``n_buckets`` numbers, whatever the size of the corpus."""
    parts = texts.select(F.col(text).alias("text")).mapInArrow(_counted(longest, n_buckets), "bucket long, n long")
    out = np.zeros(n_buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier a bucket is in the target, each count one more, rounded down."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weighed(gain: np.ndarray, longest: int):
    def weigh(batches):
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK):
                rows = part.num_rows
                n_words, features, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for n, at, here, first in buckets(part.column("text"), longest, len(gain)):
                    if n == 1:
                        n_words = np.diff(first)
                    running = np.concatenate([[0], np.cumsum(np.where(here, gain[at], 0))]) if len(at) else np.zeros(1, np.int64)
                    total += running[first[1:]] - running[first[:-1]]
                    features += np.maximum(0, np.diff(first) - n + 1)
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n_words), pa.array(features), pa.array(weight)], ["key", "n_words", "n_features", "weight"])

    return weigh


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, n_buckets: int = BUCKETS) -> DataFrame:
    """key, n_words, n_features, weight of every row of ``docs``: the mean gain of its n-grams over ``target``, rounded down."""
    gain = gains(bucket_counts(docs, text, longest, n_buckets), bucket_counts(target, text, longest, n_buckets))
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_weighed(gain, longest), f"key {kind}, n_words long, n_features long, weight long")


def _noise(seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of the id: adding it to log weights and taking the largest draws without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def drawn(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_features, weight, score, rank of every row; the best ``share`` percent of those with ``least_words`` words have a rank, from 1.

    Ranks come from counts by score, then by key within a score, so no task sorts all rows. Equal rows are counted first and take
    ranks one after the other.
    """
    scored = weights(docs, target, key, text).withColumn("score", F.col("weight") + _noise(seed)).withColumn("able", F.col("n_words") >= least_words)
    counted = cut(scored.groupBy("key", "able", "n_features", "weight", "score").agg(F.count("*").alias("n")))
    block = F.floor(F.col("score") / 1024)
    by_score = cut(counted.filter("able").groupBy("score").agg(F.sum("n").alias("of_score")).withColumn("block", block))
    blocks = by_score.groupBy("block").agg(F.sum("of_score").alias("of_block"))
    n_drawn = (by_score.agg(F.sum("of_score")).first()[0] or 0) * share // 100
    higher = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a score is a whole number in a range that the logarithms bound, so blocks of 1024 of them are few
    blocks = blocks.withColumn("before", higher(Window.orderBy(F.desc("block")), "of_block"))
    by_score = by_score.join(blocks, "block").withColumn("above", F.col("before") + higher(Window.partitionBy("block").orderBy(F.desc("score")), "of_score"))
    in_score = Window.partitionBy("score").orderBy("key", "n_features", "weight")
    ranked = counted.filter("able").join(by_score.filter(F.col("above") < n_drawn).select("score", "above"), "score").withColumn("before", F.col("above") + higher(in_score, "n"))
    rest = counted.filter("able").join(by_score.filter(F.col("above") >= n_drawn).select("score"), "score", "left_semi").unionByName(counted.filter(~F.col("able")))
    out = ranked.drop("above").unionByName(rest.withColumn("before", F.lit(None).cast("long")))
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}"))))
    out = out.withColumn("copy", F.explode(F.sequence(F.expr(f"part * {COPIES} + 1"), F.least("n", F.expr(f"(part + 1) * {COPIES}")))))
    rank = F.col("before") + F.col("copy")
    return out.select(F.col("key").alias(key), "n_features", "weight", "score", F.when(rank <= n_drawn, rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; a drawn key brings all rows that have it."""
    keys = drawn(docs, target, share, least_words, seed, key, text).filter("rank IS NOT NULL").select(F.col(key).alias("_drawn")).distinct()
    return docs.join(keys, docs[key].eqNullSafe(keys["_drawn"]), "left_semi")
