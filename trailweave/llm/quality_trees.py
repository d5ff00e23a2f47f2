"""A quality classifier: gradient-boosted trees over histograms of document statistics, flattened into arrays that numpy walks for all rows at once.

Spark computes the statistics of every whole text once and keeps them; labels meet them by key. The trees are fitted on at most ``SAMPLE`` labelled
rows (of more, those with the least hash of their key), so what the driver gets is bounded: a row of ``len(NAMES)`` numbers each. The
model, a few arrays, goes to all tasks, which score the kept statistics.

Odd input: a null text counts as an empty one, whose statistics are all 0, and has a score as any other; labels other than 1 count as 0, null ones as none;
a key with several labels has their mean; rows with the same key and statistics are one training row and have equal scores; a null key has no label and isn't held
out; without labels all scores are 0.5, with labels of one kind near that kind; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, text_bytes, text_slices, word_hashes

#: Labelled rows that the trees are fitted on at most.
SAMPLE = 50_000
TREES, DEPTH, BINS, RATE, SHRINK, LEAST_ROWS = 120, 4, 64, 0.15, 1.0, 4.0

NAMES = [
    "log_chars", "log_words", "word_chars", "word_chars_deviation", "longest_word", "upper_letters", "digits", "beyond_ascii", "white", "stops", "commas", "shouts", "symbols", "bars", "other_marks",
    "entropy", "distinct_words", "repeats_of_last", "distinct_pairs", "distinct_triples", "capital_words", "letterless_words", "marked_words", "lines", "distinct_lines", "line_words", "stopped_lines",
]

#: Kinds of bytes; a character beyond ASCII is counted by its first byte.
_KINDS = ["lower", "upper", "digit", "space", "newline", "white", "stop", "comma", "shout", "symbol", "bar", "mark", "beyond", "following"]
_KIND = np.full(256, _KINDS.index("mark"), dtype=np.int64)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 0, 1, 2
_KIND[[0x09, 0x0B, 0x0C, 0x0D]], _KIND[0x20], _KIND[0x0A] = 5, 3, 4
for _chars, _name in ((".", "stop"), (",;:", "comma"), ("!?", "shout"), ("#*$%&<>@^~=+_\\/{}[]", "symbol"), ("|", "bar")):
    _KIND[[ord(c) for c in _chars]] = _KINDS.index(_name)
_KIND[0x80:0xC0], _KIND[0xC0:] = 13, 12
_WHITE = np.isin(_KIND, [3, 4, 5])
_LETTER = np.isin(_KIND, [0, 1, 12, 13])
_MIX = np.uint64(0x9E3779B97F4A7C15)

# --- Statistics --------------------------------------------------------------------------------------------------------------------


def _distinct(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Different values of each document."""
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return np.bincount(doc[new], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text, over its whole length; shares are of characters, words or lines."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    kind = np.bincount(doc_of * len(_KINDS) + _KIND[data], minlength=n * len(_KINDS)).reshape(n, len(_KINDS)).astype(np.float64)
    lower, upper, digit, space, newline, white, stop, comma, shout, symbol, bar, mark, beyond, _ = kind.T
    chars = kind[:, :-1].sum(axis=1)
    per_char, letters = np.maximum(chars, 1), np.maximum(lower + upper + beyond, 1)
    share = kind[:, :-1] / per_char[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)

    hashes, first = word_hashes(data, offsets)
    words = np.diff(first).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(first))
    inside = ~_WHITE[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    held = inside[at[:-1]] if len(data) else np.zeros(0, bool)
    starts, stops = at[:-1][held], at[1:][held]
    seen = np.concatenate([[0], np.cumsum(_KIND[data] != 13)])
    letters_seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
    size = (seen[stops] - seen[starts]).astype(np.float64)
    per_word = np.maximum(words, 1)
    mean = lambda values: np.bincount(doc, values, minlength=n) / per_word
    word_chars = mean(size)
    deviation = np.sqrt(np.maximum(0, mean(size * size) - word_chars**2))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, size)
    last = data[stops - 1] if len(stops) else np.zeros(0, np.uint8)
    marked = mean(np.isin(_KIND[last], [8, 9, 10, 11]).astype(np.float64))
    capital = mean((_KIND[data[starts]] == 1).astype(np.float64)) if len(starts) else np.zeros(n)
    letterless = mean((letters_seen[stops] == letters_seen[starts]).astype(np.float64))
    follows = np.zeros(len(doc), dtype=bool)
    follows[1:] = (doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])
    distinct = [_distinct(doc, hashes, n) / per_word]
    gram = hashes
    for k in (1, 2):
        gram = (gram[: len(hashes) - k] * _MIX) ^ hashes[k:] if len(hashes) > k else gram[:0]
        whole = doc[k:] == doc[: len(doc) - k] if len(hashes) > k else np.zeros(0, bool)
        distinct.append(np.where(words > k, _distinct(doc[k:][whole], gram[whole], n) / np.maximum(words - k, 1), 1))

    # lines with a word: a line's hash sums its words' hashes, each by its place in the line
    line_of_byte = np.cumsum(data == 0x0A) + doc_of if len(data) else np.zeros(0, np.int64)
    line = line_of_byte[starts] if len(starts) else np.zeros(0, np.int64)
    head = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, np.int64)
    place = np.arange(len(line)) - np.repeat(head, np.diff(np.append(head, len(line))))
    line_hash = np.add.reduceat(hashes * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)) ^ (place.astype(np.uint64) * _MIX), head) if len(head) else np.zeros(0, np.uint64)
    line_doc = doc[head] if len(head) else np.zeros(0, np.int64)
    lines = np.bincount(line_doc, minlength=n).astype(np.float64)
    per_line = np.maximum(lines, 1)
    tail = np.append(head[1:], len(line)) - 1 if len(head) else head
    stopped = np.bincount(line_doc, np.isin(last[tail], [ord(c) for c in ".!?"]).astype(np.float64) if len(tail) else None, minlength=n) / per_line
    out = [
        np.log1p(chars), np.log1p(words), word_chars, deviation, np.log1p(longest), upper / letters, digit / per_char, beyond / per_char, (space + newline + white) / per_char, stop / per_word, comma / per_word,
        shout / per_word, symbol / per_word, bar / per_word, mark / per_word, entropy, distinct[0], np.bincount(doc, follows.astype(np.float64), minlength=n) / per_word, distinct[1], distinct[2], capital,
        letterless, marked, np.log1p(lines), np.where(lines > 0, _distinct(line_doc, line_hash, n) / per_line, 1), words / per_line, stopped,
    ]
    return np.where((words > 0)[:, None], np.stack(out, axis=1), 0.0)


def _measure(batches):
    for batch in batches:
        for part in text_slices(batch, "text"):
            x = statistics(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("key"), lists], ["key", "x"])


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, x: the statistics ``NAMES`` of every row's whole text."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_measure, f"key {kind}, x array<double>")


# --- Trees -------------------------------------------------------------------------------------------------------------------------


@dataclass
class Forest:
    """All trees one after the other: a node has a statistic, a threshold (at most: left) and its children, which are the node itself at a leaf."""

    base: float
    roots: np.ndarray
    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all rows walk down all trees at once, a level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth if len(self.roots) else 0):
            at = np.where(x[rows, self.statistic[at]] <= self.threshold[at], self.left[at], self.right[at])
        z = self.base + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fitted(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boosts logistic loss: values are binned by quantiles once; each level of a tree sums gradients by node, statistic and bin, and splits where that gains most."""
    rows, width = x.shape if len(x) else (0, len(NAMES))
    prior = (y.sum() + 1) / (rows + 2) if rows else 0.5
    base = float(np.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)] if rows else []
    coded = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if rows else np.zeros((0, width), np.int64)
    coded = coded + np.arange(width) * bins
    nodes: dict[str, list] = {k: [] for k in ("statistic", "threshold", "left", "right", "value")}
    roots, z = [], np.full(rows, base)

    def node() -> int:
        for k, v in nodes.items():
            v.append(len(nodes["value"]) if k in ("left", "right") else 0)
        return len(nodes["left"]) - 1

    for _ in range(trees if 0 < y.sum() < rows else 0):
        p = 1 / (1 + np.exp(-z))
        slope, bend = y - p, np.maximum(p * (1 - p), 1e-9)
        roots.append(node())
        own, level = np.full(rows, roots[-1]), [roots[-1]]
        for k in range(depth + 1):
            number = {m: i for i, m in enumerate(level)}
            index = np.array([number.get(m, -1) for m in range(len(nodes["left"]))])[own]
            here = index >= 0
            g, h = (np.bincount(index[here], w[here], minlength=len(level)) for w in (slope, bend))
            for m, a, b in zip(level, g, h):
                nodes["value"][m] = RATE * a / (b + SHRINK)
            if k == depth:
                break
            cell = (index[here, None] * (width * bins) + coded[here]).ravel()
            sums = [np.bincount(cell, np.repeat(w[here], width), minlength=len(level) * width * bins).reshape(len(level), width, bins).cumsum(axis=2) for w in (slope, bend, np.ones(rows))]
            low_g, low_h, low_n = sums
            high_g, high_h, high_n = g[:, None, None] - low_g, h[:, None, None] - low_h, low_n[:, :, -1:] - low_n
            gain = low_g**2 / (low_h + SHRINK) + high_g**2 / (high_h + SHRINK) - (g**2 / (h + SHRINK))[:, None, None]
            gain[(low_n < LEAST_ROWS) | (high_n < LEAST_ROWS)] = -1
            following = []
            for i, m in enumerate(level):
                f, b = divmod(int(gain[i].argmax()), bins)
                if gain[i, f, b] <= 1e-6:
                    continue
                nodes["statistic"][m], nodes["threshold"][m] = f, edges[f][b]
                nodes["left"][m], nodes["right"][m] = node(), node()
                mine = np.flatnonzero(own == m)
                goes = coded[mine, f] - f * bins <= b
                own[mine[goes]], own[mine[~goes]] = nodes["left"][m], nodes["right"][m]
                following += [nodes["left"][m], nodes["right"][m]]
            level = following
            if not level:
                break
        z += np.array(nodes["value"])[own]
    whole = np.int64
    return Forest(base, np.array(roots, whole), np.array(nodes["statistic"], whole), np.array(nodes["threshold"], float), np.array(nodes["left"], whole), np.array(nodes["right"], whole), np.array(nodes["value"], float), depth)


def _scored(forest: Forest):
    def score(batches):
        for batch in batches:
            lists = batch.column("x")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(forest.scores(x))], ["key", "held_out", "score"])

    return score


def held_out(key: Column, folds: int = 3, out: int = 1) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == out, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """key, held_out, score, predicted of every row; learnt from the labels of keys that aren't held out."""
    stats = cut(measured(docs, key, text).withColumn("held_out", held_out(F.col("key"))))
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg((F.col(label) == 1).cast("double")).alias("y"))
    known = stats.filter("NOT held_out").join(marks, "key").dropDuplicates(["key", "x"])
    known = known.orderBy(F.xxhash64("key"), "key", "x").limit(sample).select("x", "y").toArrow()
    x = known.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    forest = fitted(x, known.column("y").to_numpy())
    kind = docs.schema[key].dataType.simpleString()
    out = stats.mapInArrow(_scored(forest), f"key {kind}, held_out boolean, score double")
    return out.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
