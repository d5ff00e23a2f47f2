"""How far the vocabularies of a language's sources are from each other, from term counts in mergeable radix tries.

Each task counts the terms of its texts in one byte trie a language. A trie is laid out by its leaves in UTF-8 order: a leaf names the depth at
which it branches off the leaf before it and the bytes of its own below that, and holds a counter for each source (occurrences, documents).
Tries are cut into branches by prefix; the branches of one prefix of all tasks are merged in one group, and a prefix whose branches
hold more counters than fit in a group is cut deeper first, until it fits or is a single term. The merged branches, walked in order, give the sums over
terms for all pairs of sources, and each group's candidate terms, of equal ones the first in UTF-8 order.

Odd input: null texts, languages and sources are empty strings, and an empty string is a source like any other; repeated rows are documents of their
own; a language none of whose terms is kept has pairs of value 0 and no terms; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, fresh_path, remove, text_slices
from .terms import encoded_words, word_bytes

ONE = 1_000_000_000
LEAST_DOCUMENTS = 3
TERMS = 200
#: Bytes of the first prefix, and how much deeper a branch with too many counters is cut each time.
PREFIX, DEEPER = 2, 1
#: Counters that one group merges, and those that a task holds before it lets its tries go.
MERGED, HELD = 1 << 19, 1 << 20
#: Prefixes to be cut deeper that every task gets; of more, each task gets those that it needs, by a shuffle.
SENT = 100_000
#: Groups (language, source) whose totals one walk of the tries takes along; a language with more has a walk of its own.
WALKED = 1 << 16
#: Cells of one block of the counts of a branch's terms by sources.
BLOCK = 1 << 19
_INSIDE = word_bytes(("A", "Z"))

_BRANCH = "lang string, prefix binary, sources array<string>, branches array<int>, sizes array<int>, labels binary, held array<int>, source array<int>, n array<long>, docs array<long>"
_KEPT = "lang string, sources array<string>, totals array<long>, branches array<int>, sizes array<int>, labels binary, held array<int>, source array<int>, n array<long>"

# --- The layout of a trie ----------------------------------------------------------------------------------------------------------


def _bytes_of(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    terms = terms.cast(pa.large_binary())
    ends = np.frombuffer(terms.buffers()[1], dtype=np.int64)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int64)
    data = np.frombuffer(terms.buffers()[2], dtype=np.uint8) if len(terms) and terms.buffers()[2] else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def laid_out(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(depth at which each of the sorted, different terms branches off the one before, bytes below that, these bytes one after the other)."""
    data, ends = _bytes_of(terms)
    sizes, branch = np.diff(ends), np.zeros(len(terms), dtype=np.int64)
    at = np.arange(1, len(terms))
    k = 0
    while len(at):
        at = at[(sizes[at] > k) & (sizes[at - 1] > k)]
        at = at[data[ends[at] + k] == data[ends[at - 1] + k]]
        k += 1
        branch[at] = k
    own = np.arange(len(data)) - np.repeat(ends[:-1], sizes) >= np.repeat(branch, sizes)
    return branch, sizes - branch, data[own].tobytes()


def read_out(branch: np.ndarray, below: np.ndarray, labels: bytes) -> pa.Array:
    """The terms of a trie that ``laid_out`` gave: each byte is found on the way down, with the last leaf that branched off above it."""
    sizes = branch + below
    ends = np.concatenate([[0], np.cumsum(sizes)])
    start = np.concatenate([[0], np.cumsum(below)])
    source, data = np.frombuffer(labels, dtype=np.uint8), np.zeros(int(ends[-1]), dtype=np.uint8)
    at, k = np.arange(len(sizes)), 0
    while len(at := at[sizes[at] > k]):
        owner = np.maximum.accumulate(np.where(branch[at] <= k, np.arange(len(at)), 0))
        leaf = at[owner]
        data[ends[at] + k] = source[start[leaf] + k - branch[leaf]]
        k += 1
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


def merged(terms: pa.Array, leaf: np.ndarray, source: np.ndarray, *counts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Tries one after the other (their terms, and counters with the index of their term) as one: sorted terms, counters by term and source, summed."""
    code = terms.dictionary_encode()
    order = pc.sort_indices(code.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    leaf = rank[code.indices.to_numpy(zero_copy_only=False)][leaf] if len(leaf) else leaf
    key = leaf * (int(source.max(initial=0)) + 1) + source
    by = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[by], prepend=-1))
    sums = [np.add.reduceat(c[by], first) if len(first) else c[:0] for c in counts]
    return code.dictionary.take(pa.array(order)), leaf[by][first], source[by][first], sums


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _column(batch: pa.RecordBatch | pa.Table, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False).astype(np.int64)


# --- Counting ----------------------------------------------------------------------------------------------------------------------


class _Counts:
    """What a task has counted: terms, and counters (term, group, occurrences, documents), several of a term and group until they are merged."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self):
        self.terms, self.parts, self.n_terms, self.n = [], [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        words, ids, first = encoded_words(batch.column("text"), _INSIDE)
        if not len(ids):
            return
        width = len(words)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], dtype=np.int64)
        pair, n = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(first)) * width + ids, return_counts=True)  # a document and a term
        key = group[pair // width] * width + pair % width
        by = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.diff(key[by], prepend=-1))
        key, n, docs = key[by][at], np.add.reduceat(n[by], at), np.diff(np.append(at, len(by)))
        self.terms.append(words)
        self.parts.append((key % width + self.n_terms, key // width, n, docs))
        self.n_terms, self.n = self.n_terms + width, self.n + len(key)

    def merge(self) -> None:
        leaf, group, n, docs = (np.concatenate(x) for x in zip(*self.parts))
        terms, leaf, group, (n, docs) = merged(pa.chunked_array(self.terms).combine_chunks(), leaf, group, n, docs)
        self.terms, self.parts, self.n_terms, self.n = [terms], [(leaf, group, n, docs)], len(terms), len(leaf)

    def branches(self) -> Iterator[pa.RecordBatch]:
        """The tries by language, cut by prefix; nothing is held after that."""
        if not self.parts:
            return
        self.merge()
        terms, (leaf, group, n, docs) = self.terms[0], self.parts[0]
        by_lang: dict[str, list[int]] = {}
        for (lang, _), g in self.groups.items():
            by_lang.setdefault(lang, []).append(g)
        for lang, groups in by_lang.items():
            own = np.full(len(self.groups), -1, dtype=np.int64)
            own[groups] = np.arange(len(groups))
            here = own[group] >= 0
            used, at = np.unique(leaf[here], return_inverse=True)
            names = {g: s for (_, s), g in self.groups.items()}
            yield from _cut_branches(lang, [names[g] for g in groups], terms.take(pa.array(used)), at, own[group[here]], n[here], docs[here], PREFIX)
        self.clear()


def _cut_branches(lang: str, names: list[str], terms: pa.Array, leaf: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """One row for each prefix of ``depth`` bytes; sorted terms, counters sorted by term."""
    if not len(terms):
        return
    data, ends = _bytes_of(terms)
    sizes, new = np.diff(ends), np.zeros(len(terms), dtype=bool)
    new[0] = True
    for k in range(depth):
        byte = np.where(sizes > k, data[np.minimum(ends[:-1] + k, len(data) - 1)].astype(np.int64), -1)
        new[1:] |= byte[1:] != byte[:-1]
    cuts = np.append(np.flatnonzero(new), len(terms))
    branch, below, _ = laid_out(terms)
    counters = np.searchsorted(leaf, cuts)
    of_leaf = np.bincount(leaf, minlength=len(terms))
    for low in range(0, len(cuts) - 1, 512):
        spans = list(zip(cuts[low : low + 512], cuts[low + 1 : low + 513]))
        marks = list(zip(counters[low : low + 512], counters[low + 1 : low + 513]))
        used = [np.unique(source[a:b], return_inverse=True) for a, b in marks]
        rows = []
        for a, b in spans:
            own = branch[a:b].copy()
            own[0] = 0
            rows.append((own, sizes[a:b] - own))
        labels = []
        for (a, b), (own, _) in zip(spans, rows):
            at = np.arange(ends[a], ends[b]) - np.repeat(ends[a:b], sizes[a:b]) >= np.repeat(own, sizes[a:b])
            labels.append(data[ends[a] : ends[b]][at].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(spans), pa.string()),
                pa.array([data[ends[a] : min(ends[a] + depth, ends[a + 1])].tobytes() for a, _ in spans], pa.binary()),
                pa.array([[names[s] for s in u] for u, _ in used], pa.list_(pa.string())),
                _lists([x for x, _ in rows], pa.int32()),
                _lists([x for _, x in rows], pa.int32()),
                pa.array(labels, pa.binary()),
                _lists([of_leaf[a:b] for a, b in spans], pa.int32()),
                _lists([i for _, i in used], pa.int32()),
                _lists([n[a:b] for a, b in marks], pa.int64()),
                _lists([docs[a:b] for a, b in marks], pa.int64()),
            ],
            ["lang", "prefix", "sources", "branches", "sizes", "labels", "held", "source", "n", "docs"],
        )


def _count(batches):
    counts = _Counts()
    for batch in batches:
        for part in text_slices(batch, "text"):
            counts.add(part)
            if counts.n > HELD:
                counts.merge()
                if counts.n > HELD // 2:
                    yield from counts.branches()
    yield from counts.branches()


def _deeper(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            terms = read_out(_column(batch, "branches", k), _column(batch, "sizes", k), batch.column("labels")[k].as_py())
            leaf = np.repeat(np.arange(len(terms)), _column(batch, "held", k))
            depth = len(batch.column("prefix")[k].as_py()) + DEEPER
            yield from _cut_branches(batch.column("lang")[k].as_py(), batch.column("sources")[k].as_py(), terms, leaf, _column(batch, "source", k), _column(batch, "n", k), _column(batch, "docs", k), depth)


def _merge(least: int):
    def merge(table: pa.Table) -> pa.Table:
        """The branches of one prefix as one, without terms of fewer than ``least`` documents."""
        names: dict[str, int] = {}
        terms, parts, base = [], [], 0
        for k in range(table.num_rows):
            own = read_out(_column(table, "branches", k), _column(table, "sizes", k), table.column("labels")[k].as_py())
            to = np.array([names.setdefault(s, len(names)) for s in table.column("sources")[k].as_py()], dtype=np.int64)
            parts.append((np.repeat(np.arange(len(own)), _column(table, "held", k)) + base, to[_column(table, "source", k)], _column(table, "n", k), _column(table, "docs", k)))
            terms.append(own)
            base += len(own)
        words, leaf, source, (n, docs) = merged(pa.chunked_array(terms).combine_chunks(), *(np.concatenate(x) for x in zip(*parts)))
        kept = np.bincount(leaf, docs, minlength=len(words)) >= least
        here = kept[leaf]
        rank = np.cumsum(kept) - 1
        words, leaf, source, n = words.filter(pa.array(kept)), rank[leaf[here]], source[here], n[here]
        branch, below, labels = laid_out(words)
        rows = 1 if len(words) else 0
        totals = np.zeros(len(names), dtype=np.int64)
        np.add.at(totals, source, n)
        columns = [
            pa.array([table.column("lang")[0].as_py()], pa.string()), pa.array([list(names)], pa.list_(pa.string())), _lists([totals], pa.int64()), _lists([branch], pa.int32()),
            _lists([below], pa.int32()), pa.array([labels], pa.binary()), _lists([np.bincount(leaf, minlength=len(words))], pa.int32()), _lists([source], pa.int32()), _lists([n], pa.int64()),
        ]
        return pa.Table.from_arrays(columns, ["lang", "sources", "totals", "branches", "sizes", "labels", "held", "source", "n"]).slice(0, rows)

    return merge


def kept_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS) -> str:
    """Counts the terms of ``docs``, keeps those of ``least`` documents of their language; the path of a table of tries, one a language and prefix."""
    spark = docs.sparkSession
    plain = docs.select(F.col(text).alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))))
    paths, out = [fresh_path(spark, "tries")], fresh_path(spark, "terms")
    plain.mapInArrow(_count, _BRANCH).write.parquet(paths[0])
    whole = spark.read.parquet(paths[0])
    ready = []
    while True:
        sizes = whole.groupBy("lang", "prefix").agg(F.sum(F.size("source")).alias("counters"), F.max(F.size("branches")).alias("leaves"), F.max(F.length("labels")).alias("bytes"))
        # a single leaf no longer than its prefix can't be cut; it has a counter for each task and source
        large = sizes.filter((F.col("counters") > MERGED) & ((F.col("leaves") > 1) | (F.col("bytes") > F.length("prefix")))).select("lang", "prefix")
        large = cut(large)
        n_large = large.count()
        if not n_large:
            ready.append(whole)
            break
        large = F.broadcast(large) if n_large <= SENT else large  # else all branches would be shuffled for it
        ready.append(whole.join(large, ["lang", "prefix"], "left_anti"))
        paths.append(fresh_path(spark, "tries"))
        names = [x.split(" ")[0] for x in _BRANCH.split(", ")]
        whole.join(large, ["lang", "prefix"], "left_semi").select(names).mapInArrow(_deeper, _BRANCH).write.parquet(paths[-1])
        whole = spark.read.parquet(paths[-1])
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    every.groupBy("lang", "prefix").applyInArrow(_merge(least), _KEPT).write.parquet(out)
    for path in paths:
        remove(spark, path)
    return out


# --- Walking the merged tries ------------------------------------------------------------------------------------------------------


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / whole), exactly: long division by three digits at a time where the product would not fit."""
    a = count + 1
    if int(a.max(initial=0)) < (1 << 63) // ONE:
        return 1 + a * ONE // whole
    out, rest = a // whole, a % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return 1 + out


def _walk(langs: dict[str, tuple[list[str], np.ndarray, int]], terms: int):
    """langs: sources, their totals, kept terms. Rows: a pair's sum over this task's terms, and a group's best terms of each trie."""

    def walk(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                lang = batch.column("lang")[k].as_py()
                names, totals, n_kept = langs[lang]
                number = {s: i for i, s in enumerate(names)}
                column = np.array([number[s] for s in batch.column("sources")[k].as_py()], dtype=np.int64)[_column(batch, "source", k)]
                held, n = _column(batch, "held", k), _column(batch, "n", k)
                words = read_out(_column(batch, "branches", k), _column(batch, "sizes", k), batch.column("labels")[k].as_py())
                ends = np.concatenate([[0], np.cumsum(held)])
                pair = sums.setdefault(lang, np.zeros((len(names), len(names)), dtype=np.int64))
                best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in names]
                step = max(1, BLOCK // len(names))
                for low in range(0, len(words), step):
                    high = min(len(words), low + step)
                    counts = np.zeros((high - low, len(names)), dtype=np.int64)
                    counts[np.repeat(np.arange(high - low), held[low:high]), column[ends[low] : ends[high]]] = n[ends[low] : ends[high]]
                    p = shares(counts, totals + n_kept)
                    q = shares(counts.sum(axis=1), totals.sum() + n_kept)[:, None]
                    for g in range(len(names)):
                        pair[g] += ((p[:, g : g + 1] - p) ** 2 // p).sum(axis=0)
                    value = (p - q) ** 2 // q
                    able = (counts > 0) & (p > q)
                    for g in range(len(names)):
                        at = np.flatnonzero(able[:, g])
                        at = at[np.argsort(-value[at, g], kind="stable")[:terms]]  # in UTF-8 order where values are equal
                        best[g].append((at + low, value[at, g]))
                for g, found in enumerate(best):
                    at, value = (np.concatenate(x) for x in zip(*found))
                    first = np.lexsort((at, -value))[:terms]
                    if len(first):
                        rows = len(first)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * rows), pa.array([names[g]] * rows), pa.array(["term"] * rows), words.take(pa.array(at[first])).cast(pa.binary()).cast(pa.string()), pa.array(value[first])],
                            ["lang", "source", "part", "item", "value"],
                        )
        for lang, pair in sums.items():
            names = langs[lang][0]
            for g, s in enumerate(names):
                others = [i for i in range(len(names)) if i != g]
                if others:
                    rows = len(others)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * rows), pa.array([s] * rows), pa.array(["pair"] * rows), pa.array([names[i] for i in others]), pa.array(pair[g][others])], ["lang", "source", "part", "item", "value"])

    return walk


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each group's distance from each other source of its language (part ``pair``) and the terms that set it apart (``term``).

    The result holds all ordered pairs of a language's sources, so the totals that a walk takes along are few beside it.
    """
    spark = docs.sparkSession
    path = kept_terms(docs, text, lang, source, least)
    kept = spark.read.parquet(path)
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source")))).distinct()
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
    n_kept = kept.groupBy("lang").agg(F.sum(F.size("branches")).alias("kept"))
    known = cut(groups.join(totals, ["lang", "source"], "left").join(n_kept, "lang", "left"))
    bare = known.filter("kept IS NULL").select("lang", "source")
    pairs = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source != item")
    found = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    for langs in _walks(known.filter("kept IS NOT NULL").orderBy("lang", "source")):
        found = found.unionByName(kept.filter(F.col("lang").isin(list(langs))).mapInArrow(_walk(langs, terms), "lang string, source string, part string, item string, value long"))
    found = cut(found)
    remove(spark, path)
    pair_sums = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pair_sums.withColumn("rank", F.row_number().over(best)).unionByName(found.filter("part = 'term'").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= terms))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def _walks(known: DataFrame) -> Iterator[dict[str, tuple[list[str], np.ndarray, int]]]:
    """Whole languages with at most ``WALKED`` groups together, or one language."""
    langs: dict[str, tuple[list, list, int]] = {}
    n, last = 0, None
    for row in known.toLocalIterator():
        if row["lang"] != last and n >= WALKED:
            yield {k: (s, np.array(t, dtype=np.int64), v) for k, (s, t, v) in langs.items()}
            langs, n = {}, 0
        last, n = row["lang"], n + 1
        s, t, _ = langs.setdefault(last, ([], [], row["kept"]))
        s.append(row["source"])
        t.append(row["total"] or 0)
    if langs:
        yield {k: (s, np.array(t, dtype=np.int64), v) for k, (s, t, v) in langs.items()}
