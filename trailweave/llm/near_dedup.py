"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is SHINGLE successive words (all of them if a text has fewer). Its weight in a text is its number there times its inverse
document frequency, in which a group of near copies counts about as one text: every text counts as one over the number of texts that
share the likeliest of its min-hashes, so that what a large group of copies shares doesn't weigh less than the words in which the copies
differ. Each text keeps one consistent weighted sample for each of BANDS * ROWS hashes; texts whose samples agree in all ROWS of a band
meet in that band's bucket, and pairs are verified by the weighted Jaccard similarity of whole texts.

Equal texts are one text from the start. Frequencies and min-hash counts are kept by hash in tables of fixed size, and so are the
random variates, which bounds all broadcasts. A bucket never gives all its pairs. Buckets of up to SMALL texts are matched in full. In
larger ones texts first meet the two most popular members; what these links leave in different components is then joined exactly:
where it fits into one cell all at once, else by its rarest shingles, as two texts that are similar enough share one of the shingles
that make up the first 1 - SIMILARITY of either's weight, rarest first. So classes are those of all pairs that share a bucket, whatever its size, and only links leave the comparison.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, mix64, sorted_unique, text_bytes, text_slices, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 6
#: Document frequencies are summed by this many bits of a shingle's hash.
DF_BITS = 20
#: Min-hashes of a text, and the bits by which texts are counted for each.
MIN_HASHES, MIN_BITS = 8, 17
#: Slots of a table that travel in one row.
RUN = 1 << 12
#: Shingles draw their variates from so many rows, gamma and Cauchy-like ones apart.
VARIATES = 1 << 14
#: Buckets of up to so many texts are matched in full; larger ones by their centres and rarest shingles, which loses none either.
SMALL = 6
#: Texts that share a rare shingle are compared in cells of about so many shingles a side, each in a task's memory.
LEFT_CELL, RIGHT_CELL = 1 << 18, 1 << 20
#: A text's pairs are dealt in so many parts, so that a popular member isn't one task.
SALTS = 256
#: Edges of a partition where components are sought.
EDGES = 100_000
#: What rounding may add to a bound.
ROUNDING = 1e-6
#: Bits of the filter that keeps texts without a candidate from being shuffled; it never loses one that has.
FILTER_BITS = 26
SEED = 20_240_229


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit hash of every shingle of every text, and the n + 1 offsets."""
    words, first = word_hashes(data, offsets)
    counts = np.diff(first)
    kept = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    bounds = np.r_[0, np.cumsum(kept)]
    starts = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], kept)
    lengths = np.repeat(np.minimum(counts, SHINGLE), kept)
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(SHINGLE):
        on = k < lengths
        word = words[np.minimum(starts + k, max(len(words) - 1, 0))] if len(words) else np.zeros(len(starts), np.uint64)
        out = np.where(on, mix64(out * np.uint64(0x9E3779B97F4A7C15) + word), out)
    return (out >> np.uint64(32)).astype(np.uint32), bounds


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in text_slices(batch, "text"):
        yield part, *shingles(*text_bytes(part.column("text")))


def _summed(rows: DataFrame, size: int, tally: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """A table of ``size`` slots: the sums over all rows of what ``tally`` gives of a batch, as (slots, values)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size)
        for batch in batches:
            for slots, values in tally(batch):
                np.add.at(table, slots, values)
        for run in range(0, size, RUN):
            some = table[run : run + RUN]
            if some.any():
                yield pa.record_batch([pa.array([run], pa.int32()), pa.array([some.tobytes()], pa.binary())], names=["run", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for run, part in zip(batch.column("run").to_pylist(), batch.column("sums"), strict=True):
                some = np.frombuffer(part.as_buffer(), dtype=np.float64)
                sums[run] = sums[run] + some if run in sums else some.copy()
        for run, some in sums.items():
            yield pa.record_batch([pa.array([run], pa.int32()), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], names=["run", "sums"])

    # Tables are summed as they stream in, so a task holds the runs that are its own, however many tables there are. Most sums are small
    # whole numbers: packed, they reach the driver as far smaller results.
    got = rows.mapInArrow(count, "run int, sums binary").repartition("run").mapInArrow(add, "run int, sums binary").toArrow()
    out = np.zeros(size)
    for run, part in zip(got.column("run").to_pylist(), got.column("sums"), strict=True):
        out[run : run + RUN] = np.frombuffer(zlib.decompress(part.as_buffer()), dtype=np.float64)[: size - run]
    return out


def _min_slots(all_: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text with a shingle, the slot of each of its MIN_HASHES min-hashes: the least of its shingles in as many orders."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), MIN_HASHES), dtype=np.int64)
    if len(starts):
        for k in range(MIN_HASHES):
            factor = mix64(np.array([2 * k + 1], dtype=np.uint64))[0] | np.uint64(1)
            least = np.minimum.reduceat((all_.astype(np.uint64) * factor) >> np.uint64(16), starts)
            out[:, k] = (mix64(least) >> np.uint64(64 - MIN_BITS)).astype(np.int64) + (k << MIN_BITS)
    return out


def _shares(counts: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """What each text counts for: one over the texts that share the likeliest of its min-hashes, less what chance puts into a slot."""
    load = counts.reshape(MIN_HASHES, -1).mean(axis=1)
    chance = np.repeat(load + 3 * np.sqrt(load), 1 << MIN_BITS) if load.max() >= 0.05 else 0.0
    return 1 / np.maximum(1.0, (counts - chance)[slots].max(axis=1, initial=1.0))


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, float]:
    """How many texts hold a shingle with each hash of DF_BITS bits, and the number of texts; near copies count about as one."""

    def copies(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, all_, bounds in _grouped(batch):
            slots = _min_slots(all_, bounds).reshape(-1)
            yield slots, np.ones(len(slots))

    counts = texts.sparkSession.sparkContext.broadcast(_summed(texts.select("text"), MIN_HASHES << MIN_BITS, copies).astype(np.uint32))

    def holders(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, all_, bounds in _grouped(batch):
            some = np.diff(bounds) > 0
            share = np.zeros(len(some))
            share[some] = _shares(counts.value, _min_slots(all_, bounds))
            owner = np.repeat(np.arange(len(some), dtype=np.uint64), np.diff(bounds))
            once = sorted_unique((owner << np.uint64(32)) | all_)
            yield (once & np.uint64((1 << DF_BITS) - 1)).astype(np.int64), share[(once >> np.uint64(32)).astype(np.int64)]
            yield np.array([1 << DF_BITS]), np.array([share.sum()])

    table = _summed(texts.select("text"), (1 << DF_BITS) + 1, holders)
    return table[:-1], float(table[-1])


def weights(frequencies: np.ndarray, texts: float) -> np.ndarray:
    """The weight of a shingle by its hash: 1 + ln((1 + N) / (1 + df)); df less what other shingles of the slot add on average."""
    load = frequencies.mean()
    df = np.maximum(frequencies - load, max(1.0, 2 * np.sqrt(load)))
    return (1 + np.log((1 + max(texts, 1.0)) / (1 + np.minimum(df, max(texts, 1.0))))).astype(np.float32)


def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row and hash: r ~ Gamma(2, 1), 1 / r, beta ~ Uniform(0, 1); and ln c with c ~ Gamma(2, 1)."""
    rng = np.random.default_rng(SEED)
    shape = (VARIATES, BANDS * ROWS)
    r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
    return r, 1 / r, rng.random(shape, dtype=np.float32), np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)


def signatures(all_: np.ndarray, bounds: np.ndarray, weight: np.ndarray, variates: tuple) -> np.ndarray:
    """The consistent weighted samples of each text, one 64-bit value for each hash; zeros if it has no shingle."""
    r, inverse, beta, log_c = variates
    hashes, step = r.shape[1], 1024
    out = np.zeros((len(bounds) - 1, hashes), dtype=np.uint64)
    room = [np.empty((step, hashes), dtype=np.float32) for _ in range(3)]
    each = np.arange(hashes)
    for i in range(len(bounds) - 1):
        mine = np.sort(all_[bounds[i] : bounds[i + 1]])
        if not len(mine):
            continue
        at = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        keys, tf = mine[at], np.diff(np.r_[at, len(mine)])
        log_w = np.log(tf * weight[keys & np.uint32((1 << DF_BITS) - 1)]).astype(np.float32)
        least = np.full(hashes, np.inf, dtype=np.float32)
        for start in range(0, len(keys), step):
            k = keys[start : start + step].astype(np.uint64)
            mixed = mix64(k)
            row, other = ((mixed >> np.uint64(shift)).astype(np.int64) % VARIATES for shift in (40, 10))
            # t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1)
            b, t, a = (x[: len(k)] for x in room)
            np.take(beta, row, axis=0, out=b)
            np.take(inverse, row, axis=0, out=t)
            t *= log_w[start : start + step, None]
            t += b
            np.floor(t, out=t)
            np.subtract(t, b, out=b)
            b += 1
            b *= np.take(r, row, axis=0, out=a)
            np.take(log_c, other, axis=0, out=a)
            a -= b
            first = a.argmin(axis=0)
            value = a[first, each]
            better = value < least
            chosen = mix64((k[first] << np.uint64(16)) ^ (t[first, each].astype(np.int64) & 0xFFFF).astype(np.uint64))
            least, out[i] = np.where(better, value, least), np.where(better, chosen, out[i])
    return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """The sum of least weights by that of largest, over the shingles of two sorted lists in which a shingle stands tf times."""
    keys = sorted_unique(np.concatenate([a, b]))
    ca = np.searchsorted(a, keys, side="right") - np.searchsorted(a, keys, side="left")
    cb = np.searchsorted(b, keys, side="right") - np.searchsorted(b, keys, side="left")
    w = weight[keys & np.uint32((1 << DF_BITS) - 1)].astype(np.float64)
    return float((w * np.minimum(ca, cb)).sum() / max((w * np.maximum(ca, cb)).sum(), 1e-300))


def _banded(texts: DataFrame, weight) -> DataFrame:
    """(text_key, bands) of each text with a shingle: its key in each band."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variates = _variates()
        for batch in batches:
            for part, all_, bounds in _grouped(batch):
                some = np.flatnonzero(np.diff(bounds) > 0)
                samples = signatures(all_, bounds, weight.value, variates)[some].reshape(len(some), BANDS, ROWS)
                key = np.zeros((len(some), BANDS), dtype=np.uint64)
                for j in range(ROWS):
                    key = mix64(key * np.uint64(31) + samples[:, :, j] + np.uint64(j + 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(some) + 1, BANDS, dtype=np.int32)), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.record_batch([part.column("text_key").take(pa.array(some)), lists], names=["text_key", "bands"])

    return texts.select("text_key", "text").mapInArrow(sign, "text_key binary, bands array<long>")


def _crowded(members: DataFrame, over: int) -> DataFrame:
    """(of, at, n): the buckets with more than ``over`` members."""
    sizes = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("n") > over).withColumnsRenamed({"band": "of", "key": "at"})


def _same_bucket() -> Column:
    return (F.col("band") == F.col("of")) & (F.col("key") == F.col("at"))


def _full(members: DataFrame) -> DataFrame:
    """(a, b): all pairs of the buckets of up to SMALL members."""
    sizes = _crowded(members, 1).where(F.col("n") <= SMALL)
    lists = members.join(sizes, _same_bucket()).groupBy("band", "key").agg(F.sort_array(F.collect_list("text_key")).alias("all"))
    lists = lists.select(F.posexplode("all").alias("i", "a"), "all")
    return lists.select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))


def _popular(members: DataFrame) -> DataFrame:
    """``members`` with ``pop``, the sizes of all buckets of a text together: of a group of copies, those that differ least have most."""
    sizes = _crowded(members, 0).select("of", "at", "n")
    pop = members.join(sizes, _same_bucket()).groupBy("text_key").agg(F.sum("n").alias("pop")).withColumnRenamed("text_key", "t")
    return members.join(pop, F.col("text_key") == F.col("t")).select("band", "key", "text_key", "pop")


def _stars(members: DataFrame) -> DataFrame:
    """(band, key, c, text_key): every member of a bucket with each of the bucket's centres, its two most popular members."""
    odd = F.xxhash64("text_key") % 2 == 0
    rank = lambda among: F.max_by("text_key", F.when(among, F.struct("pop", "text_key")))
    tops = members.groupBy("band", "key").agg(rank(odd).alias("c0"), rank(~odd).alias("c1"))
    centres = tops.select(F.col("band").alias("of"), F.col("key").alias("at"), F.explode(F.array_distinct(F.array_compact(F.array("c0", "c1")))).alias("c"))
    return members.join(centres, _same_bucket()).where(F.col("c") != F.col("text_key")).select("band", "key", "c", "text_key")


def _filter(members: DataFrame) -> np.ndarray:
    """A Bloom filter of the texts in ``members``, as FILTER_BITS bits."""
    spots = members.select("text_key").distinct().select(F.explode(F.array(*(_spot(F.col("text_key"), i) for i in range(2)))).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def _spot(key: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(1 << FILTER_BITS)).cast("int")


def _sets(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(text_key, grams): the sorted shingles, each as often as it occurs, of the texts in ``members`` and a few others."""
    kept = texts.sparkSession.sparkContext.broadcast(_filter(members))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = kept.value
        for batch in batches:
            spots = [batch.column(f"spot{i}").to_numpy() for i in range(2)]
            on = np.logical_and.reduce([((bits[s >> 6] >> (s & 63)) & 1).astype(bool) for s in spots])
            batch = batch.filter(pa.array(on))
            for part, all_, bounds in _grouped(batch):
                packed = [np.sort(all_[bounds[i] : bounds[i + 1]]).tobytes() for i in range(len(bounds) - 1)]
                yield pa.record_batch([part.column("text_key"), pa.array(packed, pa.binary())], names=["text_key", "grams"])

    grams = texts.select("text_key", "text", *(_spot(F.col("text_key"), i).alias(f"spot{i}") for i in range(2)))
    return grams.mapInArrow(sets, "text_key binary, grams binary").groupBy("text_key").agg(F.first("grams").alias("grams"))


def _verified(sets: DataFrame, pairs: DataFrame, weight) -> DataFrame:
    """``pairs`` (x, c) with their weighted Jaccard similarity.

    ``c`` may stand in any share of the pairs: its shingles go to as many parts of them as there are, up to SALTS.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int"))
    centres = salted.select("c", "salt").distinct().join(sets, F.col("c") == F.col("text_key")).select(F.col("c").alias("of"), F.col("salt").alias("part"), F.col("grams").alias("gc"))
    joined = salted.join(sets, F.col("x") == F.col("text_key")).select("x", "c", "salt", F.col("grams").alias("gx"))
    joined = joined.join(centres, (F.col("c") == F.col("of")) & (F.col("salt") == F.col("part"))).select("x", "c", "gx", "gc")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = [weighted_jaccard(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), weight.value) for x, y in zip(batch.column("gx"), batch.column("gc"), strict=True)]
            yield pa.record_batch([batch.column("x"), batch.column("c"), pa.array(similar, pa.float64())], names=["a", "b", "similarity"])

    return joined.mapInArrow(verify, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): the least node of its component.

    Alternates the large-star and small-star steps until nothing changes; each step is one aggregation and one join. Edges are held in
    as many partitions as their number asks for, so that a few of them aren't dealt over all of the cluster.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    parts = 1 + edges.count() // EDGES
    edges = edges.coalesce(parts)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")
        small = large.join(least, F.col("u") == F.col("of"))
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        after = cut(small.coalesce(parts).distinct().coalesce(parts))
        # Done once every node hangs on one root and no root hangs on another.
        tangled = after.groupBy("u").count().where("count > 1").limit(1).count() or after.join(after.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").limit(1).count()
        edges = after
        if not tangled:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _links(texts: DataFrame) -> DataFrame:
    """(a, b, similarity): the verified links between different texts; ``texts``: (text_key, text)."""
    spark = texts.sparkSession
    frequencies, n = _document_frequencies(texts)
    weight = spark.sparkContext.broadcast(weights(frequencies, n))
    bands = cut(_banded(texts, weight).groupBy("text_key").agg(F.first("bands").alias("bands")))
    members = bands.select("text_key", F.posexplode("bands").alias("band", "key"))
    members = cut(members.join(_crowded(members, 1), _same_bucket(), "left_semi"))
    large = cut(_popular(members).join(_crowded(members, SMALL), _same_bucket(), "left_semi"))
    pairs = _full(members).select(F.col("a").alias("x"), F.col("b").alias("c")).union(_stars(large).select("text_key", "c"))
    sets = cut(_sets(texts, members))
    links = cut(_verified(sets, pairs.distinct(), weight).where(F.col("similarity") >= SIMILARITY))
    return links.union(_across(sets, large, links, weight))


def _elements(grams: np.ndarray) -> np.ndarray:
    """Sorted shingles with repeats as different elements of a set: a shingle's hash, then which of its occurrences it is."""
    nth = np.arange(len(grams)) - np.searchsorted(grams, grams)
    return (grams.astype(np.uint64) << np.uint64(32)) | nth.astype(np.uint64)


def _weight_of(elements: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return weight[(elements >> np.uint64(32)).astype(np.int64) & ((1 << DF_BITS) - 1)].astype(np.float64)


def _across(sets: DataFrame, large: DataFrame, links: DataFrame, weight) -> DataFrame:
    """(a, b, similarity) of all similar pairs of one family but not of one component of ``links``; a family is what large buckets join.

    A family whose texts fit into one cell is compared there, each text of the largest component with those of others only.
    In a larger one, pairs are found by their rarest shingles.
    """
    root = components(links) if links.limit(1).count() else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    first = large.groupBy("band", "key").agg(F.min("text_key").alias("first")).withColumnsRenamed({"band": "of", "key": "at"})
    chained = cut(large.join(first, _same_bucket()).where(F.col("text_key") != F.col("first")).select(F.col("first").alias("a"), F.col("text_key").alias("b")).distinct())
    if not chained.limit(1).count():
        return links.limit(0)
    mine = components(chained).select(F.col("node").alias("hot_key"), F.col("root").alias("family"))
    mine = mine.join(root, F.col("hot_key") == F.col("node"), "left").select("hot_key", "family", F.coalesce("root", "hot_key").alias("comp"))
    mine = sets.join(mine, F.col("text_key") == F.col("hot_key")).select("text_key", "family", "comp", "grams", (F.length("grams") / 4).cast("long").alias("size"))
    mine = cut(mine)
    families = mine.groupBy("family").agg(F.sum("size").alias("all")).select(F.col("family").alias("name"), (F.col("all") <= RIGHT_CELL).alias("whole"))
    mine = mine.join(families, F.col("family") == F.col("name")).drop("name")
    shared = mine.where("whole").select(F.xxhash64("family").alias("token"), "text_key", "comp", "size")
    wide = families.where("NOT whole").limit(1).count()
    if wide:
        mine = cut(mine.where("NOT whole").select("text_key", "comp", "grams"))
        shared = shared.unionByName(_heads(mine, weight))
    shared = cut(shared)
    each = shared.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    main = F.struct("n", "comp")
    each = each.groupBy("token").agg(F.max_by("comp", main).alias("main"), F.sum("size").alias("all"), (F.sum("size") - F.max_by("size", main)).alias("others"))
    blocks = lambda c, size: F.ceil(F.col(c) / size).cast("int").alias(f"{c}_blocks")
    each = each.where("others > 0").select(F.col("token").alias("of"), "main", blocks("others", LEFT_CELL), blocks("all", RIGHT_CELL))
    met = shared.join(each, F.col("token") == F.col("of"))
    own = lambda blocks: F.pmod(F.xxhash64("text_key"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = met.where(F.col("comp") != F.col("main")).select("token", own("others_blocks").alias("i"), every("all_blocks").alias("j"), F.lit(True).alias("left"), "text_key", "comp")
    right = met.select("token", every("others_blocks").alias("i"), own("all_blocks").alias("j"), F.lit(False).alias("left"), "text_key", "comp")
    cells = left.union(right).withColumnRenamed("text_key", "k").join(sets, F.col("k") == F.col("text_key")).select("token", "i", "j", "left", "k", "comp", "grams")
    cells = cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return cells.mapInArrow(lambda batches: _matched(batches, weight), "a binary, b binary, similarity double").dropDuplicates(["a", "b"])


def _heads(mine: DataFrame, weight) -> DataFrame:
    """(token, text_key, comp, size): the shingles of each text's head, but for those that no other text of ``mine`` holds.

    A similar pair shares weight of at least SIMILARITY times that of either text. Let all shingles stand in one order, rare ones first,
    and a text's head be its first shingles down to where less than that share is left: then the heads of a similar pair have a shingle
    in common. Any order is right; this one is by how many of these texts hold a shingle.
    """

    def held(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for grams in batch.column("grams"):
            slots = (sorted_unique(np.frombuffer(grams.as_buffer(), np.uint32)) & np.uint32((1 << DF_BITS) - 1)).astype(np.int64)
            yield slots, np.ones(len(slots))

    rarity = mine.sparkSession.sparkContext.broadcast(_summed(mine.select("grams"), 1 << DF_BITS, held).astype(np.int32))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for grams in batch.column("grams"):
                elements = _elements(np.frombuffer(grams.as_buffer(), np.uint32))
                rank = rarity.value[(elements >> np.uint64(32)).astype(np.int64) & ((1 << DF_BITS) - 1)]
                order = np.lexsort((elements, rank))
                w = _weight_of(elements, weight.value)[order]
                head = order[: int(np.searchsorted(np.cumsum(w), w.sum() * (1 - SIMILARITY + ROUNDING))) + 1]
                found.append(elements[head[rank[head] > 1]])  # no other hot text holds the rest
                sizes.append(len(elements))
            at = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            token = np.concatenate(found) if found else np.zeros(0, np.uint64)
            rows = batch.select(["text_key", "comp"]).take(pa.array(at))
            yield pa.record_batch([pa.array(token.view(np.int64)), *rows.columns, pa.array(np.array(sizes, dtype=np.int64)[at])], names=["token", "text_key", "comp", "size"])

    return mine.mapInArrow(heads, "token long, text_key binary, comp binary, size long")


def _matched(batches: Iterator[pa.RecordBatch], weight) -> Iterator[pa.RecordBatch]:
    """The links of each cell: rows of one (token, i, j), which follow each other."""
    pending: pa.Table | None = None

    def cells_of(table: pa.Table) -> np.ndarray:
        ids = np.stack([table.column(c).to_numpy() for c in ("token", "i", "j")])
        return np.flatnonzero(np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(axis=0)])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if pending is None else pa.concat_tables([pending, table])
        if not table.num_rows:
            continue
        starts = cells_of(table)
        for start, stop in zip(starts[:-1], starts[1:], strict=True):
            yield from _cell(table.slice(start, stop - start), weight.value)
        pending = table.slice(starts[-1])
    if pending is not None:
        yield from _cell(pending, weight.value)


def _cell(table: pa.Table, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    is_left = table.column("left").to_numpy()
    keys, comps = (np.array(table.column(c).to_pylist(), dtype=object) for c in ("k", "comp"))
    sets = [_elements(np.frombuffer(g.as_buffer(), np.uint32)) for g in table.column("grams")]
    left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
    if not len(left) or not len(right):
        return
    flat = np.concatenate([sets[k] for k in right])
    names, where = np.unique(flat, return_inverse=True)
    w = _weight_of(names, weight)
    sizes = np.array([len(sets[k]) for k in right])
    owner, each = np.repeat(np.arange(len(right)), sizes), w[where]
    total = np.bincount(owner, each, len(right))
    a, b, similar = [], [], []
    for k in left:
        at = np.searchsorted(names, sets[k])
        hit = at < len(names)
        hit[hit] = names[at[hit]] == sets[k][hit]
        has = np.zeros(len(names))
        has[at[hit]] = w[at[hit]]
        common = np.bincount(owner, has[where], len(right))
        jaccard = common / np.maximum(_weight_of(sets[k], weight).sum() + total - common, 1e-300)
        for r in right[(jaccard >= SIMILARITY) & (comps[right] != comps[k])]:
            a.append(min(keys[k], keys[r]))
            b.append(max(keys[k], keys[r]))
            similar.append(float(jaccard[np.searchsorted(right, r)]))
    if a:
        yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(similar, pa.float64())], names=["a", "b", "similarity"])


def groups(docs: DataFrame) -> DataFrame:
    """The class of every document of ``docs`` (doc_id, text): doc_id, text_key, class_id.

    Documents are of one class if their texts are equal or joined by a chain of links, similar by SIMILARITY or more. class_id is the least
    doc_id of the class. One row per input row, repeated rows included. A text without a word (null, empty, blank) is alone with the rows of its own doc_id. A
    null doc_id keeps a null class_id only where its class has no other. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    texts = rows.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")
    links = cut(_links(texts))
    root = cut(components(links)) if links.limit(1).count() else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(F.col("text").cast("binary")))).alias("text_key"))
    keyed = cut(keyed)
    some = keyed.where(F.col("text_key").isNotNull()).groupBy("text_key").agg(F.min("doc_id").alias("least"))
    some = some.join(root, F.col("text_key") == F.col("node"), "left")
    some = cut(some.select("text_key", "least", F.coalesce("root", "text_key").alias("root")))
    class_id = some.groupBy("root").agg(F.min("least").alias("class_id"))
    some = some.join(class_id, "root").select(F.col("text_key").alias("k"), "class_id")
    out = keyed.join(some, F.col("text_key") == F.col("k"), "left")
    return out.select("doc_id", "text_key", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id, and of rows that share it, of the least text.

    Rows without a word stay, as do all columns. Repeated rows are one document.
    """
    found = cut(groups(docs))
    worded = found.where(F.col("text_key").isNotNull())
    # A class whose only ids are null is known by its text.
    name = F.coalesce(F.col("class_id").cast("string"), F.hex("text_key"))
    first = worded.groupBy(name.alias("name")).agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "text_key")).alias("w"))
    first = first.select(F.col("w.id").alias("w_id"), F.col("w.text_key").alias("w_key"))
    copies = worded.groupBy(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "text_key").count()
    first = first.join(copies, (F.col("w_id") == F.col("id")) & (F.col("w_key") == F.col("text_key"))).select("w_id", "w_key", (F.col("count") > 1).alias("w_more"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # a document's own columns may be called anything
    has = F.coalesce(docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = (has.alias("has"), F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("own_id"), F.unhex(F.md5(docs["text"].cast("binary"))).alias("own_key"))
    rows = docs.select(*own, *(docs[c].alias(n) for c, n in names.items()))
    kept = rows.where("has").join(first, (F.col("own_id") == F.col("w_id")) & (F.col("own_key") == F.col("w_key")))
    out = kept.where("NOT w_more").unionByName(kept.where("w_more").dropDuplicates(["w_id", "w_key"])).select(*names.values())
    out = out.unionByName(rows.where("NOT has").select(*names.values()))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))
