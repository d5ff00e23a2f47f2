"""Quality rules: fixed rules on words, and perplexity under a modified Kneser-Ney model of each language.

The model is over characters: n-grams of up to ORDER code points, exact, but for letter case, digits and kinds of white space, which
count as one. N-grams are counted over every whole text; each task first sums what it has seen. The model grows with the corpus as its
n-grams do. Texts are dealt in two folds by hash, and a text is scored by the model of the other fold, so that no text vouches for
itself. A model is kept as sorted arrays of 64-bit hashes of its n-grams, which tasks get as one broadcast of bounded size: a larger
model is dealt in parts by the character before the last, and texts are scored once for each part; the sums are those of the whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, mix64, text_slices

#: Characters of the longest n-grams, the bits of a code point, and how many last ones the low half of an n-gram's code holds.
ORDER, BITS, LOW = 4, 21, 3
FOLDS = 2
#: Model entries broadcast at once (16 bytes each, twice as many at most); a larger model is scored in parts, of which there are at most so many.
BROADCAST_ENTRIES, MOST_PARTS = 1 << 23, 1 << 12
#: Languages whose bands every task gets; of more, each task gets those that it needs, by a shuffle.
SENT = 100_000
#: Bytes of text that are cut into n-grams at once.
SLICE = 1 << 19
#: What n-grams are dealt to parts by: the two characters before the last one, as a number modulo this prime.
DEALT = 1_000_003
#: A document is rejected if its log-perplexity (the mean negative log-probability of a word) lies further from its language's
#: median than BAND_WIDTH times the distance from the median to the lower or upper quartile, both for a text of its number of
#: words, and at least by BAND_LEAST.
BAND_WIDTH, BAND_LEAST = 5.0, 0.5
#: Rules on words.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

_SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\v\f\r"
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@cache
def _folded() -> np.ndarray:
    """What each code point below 0x10000 counts as: its lower case if that is one character, 0 for digits, a space for white space."""
    out = np.arange(1 << 16, dtype=np.uint64)
    for c in range(1 << 16):
        low = chr(c).lower()
        if unicodedata.category(chr(c)) == "Nd":
            out[c] = ord("0")
        elif chr(c).isspace():
            out[c] = 32
        elif len(low) == 1:
            out[c] = ord(low)
    return out


_CHAR = (1 << BITS) - 1
_PAIR = (1 << 2 * BITS) - 1


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram of ORDER characters that ends at each character of all texts, as its last LOW ones and those before, and the n + 1 offsets.

    A text starts after white space.
    """
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = _folded()[np.minimum(points, (1 << 16) - 1)]
    chars = np.where(points < 1 << 16, low, points)
    padded = np.full(len(chars) + (ORDER - 1) * len(texts), 32, dtype=np.uint64)
    where = np.arange(len(chars)) + (ORDER - 1) * np.repeat(np.arange(1, len(texts) + 1), lengths)
    padded[where] = chars
    halves = [np.zeros(len(chars), dtype=np.uint64) for _ in range(2)]
    for back in range(ORDER):
        halves[back >= LOW] |= padded[where - back] << np.uint64(BITS * (back - LOW * (back >= LOW)))
    return halves[1], halves[0], np.r_[0, np.cumsum(lengths)]


def _last(hi: np.ndarray, lo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``k`` characters of n-grams."""
    mask = lambda n: np.uint64((1 << BITS * n) - 1)
    return hi & mask(max(k - LOW, 0)), lo & mask(min(k, LOW))


def _but_last(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams without their last character."""
    return hi >> np.uint64(BITS), (lo >> np.uint64(BITS)) | ((hi & np.uint64(_CHAR)) << np.uint64(BITS * (LOW - 1)))


def _hashed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix64(hi * np.uint64(0x9E3779B97F4A7C15) + lo)


def base_measures(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """Words, their characters, symbols, repeated lines, words in repeated three-word windows, and if the fixed rules reject the text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text or "") - sum(data.count(bytes([c])) for c in _WHITE)
    symbols = sum(data.count(bytes([c])) for c in _SYMBOLS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        for word in words:
            ids.setdefault(word, len(ids))
        if len(ids) < n:
            w = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=n)
            pair = w[:-1] * len(ids) + w[1:]
            order = np.sort(pair)
            pairs = order[np.r_[True, order[1:] != order[:-1]]]
            window = np.searchsorted(pairs, pair[:-1]) * len(ids) + w[2:]
            order = np.sort(window)
            twice = order[1:][order[1:] == order[:-1]]
            if len(twice):
                hit = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, window), len(twice) - 1)] == window)
                covered = np.zeros(n, dtype=bool)
                for k in range(3):
                    covered[hit + k] = True
                repeated = int(covered.sum())
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, failed


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's n-gram counts by language and fold, given out whenever it holds half a million."""
    held: dict[tuple, list[tuple[np.ndarray, ...]]] = {}
    room = 1 << 20

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h, hi, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        at = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        first = order[at]
        return h[first], hi[first], lo[first], np.add.reduceat(n[order], at)

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, fold), parts in held.items():
            _, hi, lo, n = merged(parts)
            for start in range(0, len(n), 100_000):
                some = [pa.array(x[start : start + 100_000].view(np.int64)) for x in (hi, lo, n)]
                size = len(some[0])
                yield pa.record_batch([pa.array([lang] * size, pa.string()), pa.array([fold] * size, pa.int32()), *some], names=["lang", "fold", "hi", "lo", "n"])
        held.clear()

    for batch in batches:
        for part in text_slices(batch, "text", SLICE):
            texts = part.column("text").fill_null("").to_pylist()
            hi, lo, offsets = _codes(texts)
            h = _hashed(hi, lo)
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(part.column("lang").to_pylist(), part.column("fold").to_pylist(), strict=True)):
                if offsets[i + 1] > offsets[i]:
                    rows.setdefault(key, []).append(i)
            for key, mine in rows.items():
                own = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in mine])
                held.setdefault(key, []).append(merged([(h[own], hi[own], lo[own], np.ones(len(own), dtype=np.int64))]))
        if sum(len(x[0]) for parts in held.values() for x in parts) > room:
            for key, parts in held.items():
                held[key] = [merged(parts)]
            if sum(len(x[0]) for parts in held.values() for x in parts) > room // 2:
                yield from told()
    yield from told()


def _fold() -> Column:
    """The fold of a text: equal texts share one."""
    return F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, fold, hi, lo, n): how often each n-gram of ORDER characters occurs in all texts of a language and fold."""
    partial = docs.select("text", "lang", _fold()).mapInArrow(_count, "lang string, fold int, hi long, lo long, n long")
    return partial.groupBy("lang", "fold", "hi", "lo").agg(F.sum("n").alias("n"))


def _same(*names: str) -> Column:
    """Equality with the columns of the same names after an underscore; a null language equals a null one."""
    return reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, fold, k, hi, lo, logp, backoff): interpolated modified Kneser-Ney log-probabilities of every n-gram of k = 1..ORDER characters.

    ``backoff`` is the log-weight that the n-gram, as a context, gives to the next lower order (k = 0: to all characters alike, unseen
    ones included as one). Orders below the highest count the different characters seen before an n-gram. The discounts of one, two and
    three or more come from the counts of counts, as in Chen and Goodman, held within 0 and the count where a small corpus gives none.
    """
    mask = lambda n: F.lit((1 << BITS * n) - 1)
    grams = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        hi, lo = F.col("hi").bitwiseAND(mask(max(k - LOW, 0))), F.col("lo").bitwiseAND(mask(min(k, LOW)))
        grams[k] = cut(grams[k + 1].groupBy("lang", "fold", hi.alias("hi"), lo.alias("lo")).agg(F.count(F.lit(1)).alias("n")))
    out, lower = None, None
    before = [F.shiftright("hi", BITS).alias("_hi"), F.shiftright("lo", BITS).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(mask(1)), BITS * (LOW - 1))).alias("_lo")]
    for k in range(1, ORDER + 1):
        of = grams[k]
        seen = of.groupBy("lang", "fold").agg(*(F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)), F.count(F.lit(1)).alias("all"))
        y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        ratio = lambda i: F.coalesce(F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(1.0))
        cuts = [F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), i - (i + 1) * y * ratio(i))).alias(f"d{i}") for i in (1, 2, 3)]
        seen = seen.select(F.col("lang").alias("_lang"), F.col("fold").alias("_fold"), "all", *cuts)
        n = F.col("n")
        taken = F.least(F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3")), n)
        # Two rows for each language, which Spark broadcasts or not by their size.
        of = of.join(seen, _same("lang", "fold")).select("lang", "fold", "hi", "lo", (n - taken).alias("left"), taken.alias("cut"), "n", "all")
        sums = of.groupBy("lang", "fold", *before).agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"))
        sums = cut(sums.select(F.col("lang").alias("_lang"), F.col("fold").alias("_fold"), "_hi", "_lo", "total", (F.col("cuts") / F.col("total")).alias("gamma")))
        keyed = of.select("lang", "fold", F.col("hi").alias("own_hi"), F.col("lo").alias("own_lo"), *(c.alias(c_) for c, c_ in zip(before, ("hi", "lo"), strict=True)), "left", "all")
        of = keyed.join(sums, _same("lang", "fold", "hi", "lo")).select("lang", "fold", F.col("own_hi").alias("hi"), F.col("own_lo").alias("lo"), "left", "total", "gamma", "all")
        if k == 1:
            p = F.col("left") / F.col("total") + F.col("gamma") / (F.col("all") + 1)
            sums = sums.join(seen.select(F.col("_lang").alias("lang"), F.col("_fold").alias("fold"), "all"), _same("lang", "fold")).select("_lang", "_fold", "_hi", "_lo", (F.col("gamma") / (F.col("all") + 1)).alias("gamma"))
            of = of.select("lang", "fold", "hi", "lo", p.alias("p"))
        else:
            short = [F.col("hi").bitwiseAND(mask(max(k - 1 - LOW, 0))).alias("hi"), F.col("lo").bitwiseAND(mask(min(k - 1, LOW))).alias("lo")]
            of = of.select("lang", "fold", F.col("hi").alias("own_hi"), F.col("lo").alias("own_lo"), *short, "left", "total", "gamma")
            base = lower.select(*(F.col(c).alias(f"_{c}") for c in ("lang", "fold", "hi", "lo")), F.col("p").alias("q"))
            of = of.join(base, _same("lang", "fold", "hi", "lo")).select("lang", "fold", F.col("own_hi").alias("hi"), F.col("own_lo").alias("lo"), (F.col("left") / F.col("total") + F.col("gamma") * F.col("q")).alias("p"))
        lower = cut(of)
        entry = lower.select("lang", "fold", F.lit(k).alias("k"), "hi", "lo", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff"))
        weights = sums.select(F.col("_lang").alias("lang"), F.col("_fold").alias("fold"), F.lit(k - 1).alias("k"), F.col("_hi").alias("hi"), F.col("_lo").alias("lo"), F.lit(None).cast("double").alias("logp"), F.log("gamma").alias("backoff"))
        out = entry.unionByName(weights) if out is None else out.unionByName(entry).unionByName(weights)
    return out.groupBy("lang", "fold", "k", "hi", "lo").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff"))


class SortedHashes:
    """A sorted array of 64-bit hashes with values, found by their leading bits and a few steps."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.starts = np.r_[0, np.cumsum(np.bincount((self.keys >> self.shift).astype(np.int64), minlength=slots))].astype(np.int32)

    def find(self, want: np.ndarray) -> np.ndarray:
        """Where each of ``want`` stands, or -1."""
        out = np.full(len(want), -1, dtype=np.int64)
        slot = (want >> self.shift).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        live = np.flatnonzero(at < end)
        at, end, want = at[live], end[live], want[live]
        while len(live):
            here = self.keys[at]
            hit = here == want
            out[live[hit]] = at[hit]
            go = (here < want) & (at + 1 < end)
            live, at, end, want = live[go], at[go] + 1, end[go], want[go]
        return out


def _arrays(model: DataFrame) -> dict:
    """The sorted hash arrays of a model of bounded size: {(lang, fold): [SortedHashes of k = 0..ORDER]}, values (logp, backoff)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.select(["lang", "fold", "k"]).to_pandas(types_mapper=None)
            h = _hashed(*(batch.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")))
            values = np.stack([np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float32), nan=np.float32(n)) for c, n in (("logp", 1.0), ("backoff", 0.0))], axis=1)
            for (lang, fold, k), at in ids.groupby(["lang", "fold", "k"], dropna=False, sort=False).indices.items():
                lang = lang if isinstance(lang, str) else None
                yield pa.record_batch([pa.array([lang], pa.string()), pa.array([fold], pa.int32()), pa.array([k], pa.int32()), pa.array([h[at].tobytes()], pa.binary()), pa.array([values[at].tobytes()], pa.binary())], names=["lang", "fold", "k", "keys", "numbers"])

    got = model.mapInArrow(pack, "lang string, fold int, k int, keys binary, numbers binary").toArrow()
    parts: dict[tuple, list] = {}
    for lang, fold, k, keys, numbers in zip(*(got.column(c).to_pylist() for c in ("lang", "fold", "k")), got.column("keys"), got.column("numbers"), strict=True):
        parts.setdefault((lang, fold, k), []).append((np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(numbers.as_buffer(), np.float32).reshape(-1, 2)))
    none = [(np.zeros(0, np.uint64), np.zeros((0, 2), np.float32))]
    return {key: [SortedHashes(*(np.concatenate(x) for x in zip(*parts.get((*key, k), none), strict=True))) for k in range(ORDER + 1)] for key in {p[:2] for p in parts}}


def _log_probability(hi: np.ndarray, lo: np.ndarray, model: list[SortedHashes]) -> np.ndarray:
    """The log-probability of each n-gram's last character after those before it, backing off where unseen."""
    out = np.zeros(len(hi), dtype=np.float32)
    open_ = np.arange(len(hi))
    for k in range(ORDER, -1, -1):
        if k:
            at = model[k].find(_hashed(*_last(hi[open_], lo[open_], k)))
            value = np.where(at >= 0, model[k].values[at, 0] if len(model[k].keys) else 1.0, 1.0)
            hit = value <= 0  # an n-gram that is known as a context only has no probability
            out[open_[hit]] += value[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
            at = model[k - 1].find(_hashed(*_last(*_but_last(hi[open_], lo[open_]), k - 1)))
            out[open_] += np.where(at >= 0, model[k - 1].values[at, 1] if len(model[k - 1].keys) else 0.0, 0.0)
    return out


def measured(docs: DataFrame, shipped: Broadcast, part: int = 0, parts: int = 1, keep: bool = False) -> DataFrame:
    """``docs`` (text, lang, fold and more) without fold, and without text unless ``keep``, with the base measures and ``log_p``, the log-probability of the text.

    ``log_p`` counts the characters after such as the part of the model holds, and is null without a model. Columns must not have the
    names of measures. ``shipped``: what ``_arrays`` gives.
    """
    rest = [c for c in docs.columns if c != "fold" and (keep or c != "text")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shipped.value
        for batch in batches:
            for some in text_slices(batch, "text", SLICE):
                texts = some.column("text").to_pylist()
                base = [base_measures(t) for t in texts]
                hi, lo, offsets = _codes([t or "" for t in texts])
                total, known = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
                rows: dict[tuple, list[int]] = {}
                for i, (lang, fold) in enumerate(zip(some.column("lang").to_pylist(), some.column("fold").to_pylist(), strict=True)):
                    if (lang, (fold + 1) % FOLDS) in models and offsets[i + 1] > offsets[i]:
                        rows.setdefault((lang, (fold + 1) % FOLDS), []).append(i)
                for key, mine in rows.items():
                    own = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in mine])
                    owner = np.repeat(mine, offsets[np.array(mine) + 1] - offsets[mine])
                    if parts > 1:
                        here = ((lo[own] >> np.uint64(BITS)) & np.uint64(_PAIR)) % np.uint64(DEALT) % np.uint64(parts) == part
                        own, owner = own[here], owner[here]
                    total += np.bincount(owner, _log_probability(hi[own], lo[own], models[key]), len(texts))
                    known[mine] = True
                columns = [pa.array(x) for x in zip(*base, strict=True)]
                yield pa.record_batch([*(some.column(c) for c in rest), *columns, pa.array(total, mask=~known)], names=[*rest, *(x.split()[0] for x in BASE_SCHEMA.split(", ")), "log_p"])

    schema = docs.select(*rest).schema
    for x in (*BASE_SCHEMA.split(", "), "log_p double"):
        schema = schema.add(*x.split())
    return docs.mapInArrow(score, schema)


def _dealt(parts: int) -> Column:
    """The parts that an entry of three characters or more is in: by the two characters before its last one, and as a context by its own last two."""
    number = lambda c: (c.bitwiseAND(F.lit(_PAIR)) % DEALT % parts).cast("int")
    return F.array_distinct(F.array(number(F.shiftright("lo", BITS)), number(F.col("lo"))))


def part_of(model: DataFrame, part: int, parts: int) -> DataFrame:
    """The entries with which the n-grams of a part are scored; those of one or two characters are in all parts."""
    return model if parts == 1 else model.where((F.col("k") < 3) | F.array_contains(_dealt(parts), part))


def n_parts(model: DataFrame, bound: int) -> int:
    """The number of parts of which the largest, counted, holds at most twice ``bound`` entries; fewer pairs of characters than that can't be told apart."""
    parts = max(1, -(-model.count() // bound))
    while 1 < parts < MOST_PARTS:
        small = model.where("k < 3").count()
        largest = model.where("k >= 3").select(F.explode(_dealt(parts)).alias("part")).groupBy("part").count().agg(F.max("count")).first()[0] or 0
        if small + largest <= 2 * bound:
            break
        parts *= 2
    return min(parts, MOST_PARTS)


def _model(docs: DataFrame) -> tuple[DataFrame, int]:
    """The model of all languages and folds, and in how many parts it is scored."""
    model = cut(kneser_ney(cut(ngram_counts(docs))))
    return model, n_parts(model, BROADCAST_ENTRIES)


def _shipped(model: DataFrame, parts: int) -> list[Broadcast]:
    """The arrays of each part of the model, sent to the executors once for all that is scored."""
    context = model.sparkSession.sparkContext
    return [context.broadcast(_arrays(part_of(model, i, parts))) for i in range(parts)]


def _scored(docs: DataFrame, shipped: list[Broadcast], keep: bool = False) -> DataFrame:
    """``docs`` (text, lang and more), without text unless ``keep``, with the base measures and ``log_ppl``, the mean negative log-probability of a word."""
    parts = len(shipped)
    key = [F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key")] if parts > 1 else []
    rows = measured(docs.select("*", _fold(), *key), shipped[0], 0, parts, keep)
    if parts > 1:
        # One sum of each text for each part but the first.
        texts = docs.select("text", "lang", _fold(), *key)
        more = reduce(DataFrame.unionByName, (measured(texts, shipped[i], i, parts).select("lang", "text_key", F.lit(i).alias("part"), "log_p") for i in range(1, parts)))
        more = more.groupBy("lang", "text_key", "part").agg(F.first("log_p").alias("log_p")).groupBy("lang", "text_key").agg(F.sum("log_p").alias("more"))
        rows = rows.join(more.withColumnsRenamed({"lang": "_lang", "text_key": "_text_key"}), _same("lang", "text_key"), "left")
        rows = rows.withColumn("log_p", F.col("log_p") + F.coalesce("more", F.lit(0.0))).drop("_lang", "_text_key", "text_key", "more")
    return rows.withColumn("log_ppl", F.when(F.col("n_words") > 0, -F.col("log_p") / F.col("n_words"))).drop("log_p")


def _bands(scored: DataFrame) -> DataFrame:
    """(_lang, mid, below, above): each language's median of log_ppl, and how far a text of one word may stray below and above it."""
    good = scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull())
    mid = cut(good.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("mid"))).withColumnRenamed("lang", "_lang")
    # The mean of n words strays with 1 / sqrt(n), so quartiles are taken of what is scaled by sqrt(n).
    strays = (F.col("log_ppl") - F.col("mid")) * F.sqrt("n_words")
    good = good.select("lang", "log_ppl", "n_words").join(mid, _same("lang"))
    bands = good.groupBy("lang").agg(F.first("mid").alias("mid"), F.percentile_approx(strays, [0.25, 0.75], 10_000).alias("q"))
    return cut(bands.select(F.col("lang").alias("_lang"), "mid", (F.abs(F.col("q")[0]) * BAND_WIDTH).alias("below"), (F.abs(F.col("q")[1]) * BAND_WIDTH).alias("above")))


def _judged(scored: DataFrame, bands: DataFrame) -> DataFrame:
    """``scored`` with ``kept``; a text that no model scores has nothing against it."""
    width = lambda c: F.greatest(F.lit(BAND_LEAST), F.col(c) / F.sqrt("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("mid") - width("below"), F.col("mid") + width("above")), F.lit(True))
    # One row for each language; joined otherwise, all texts would be shuffled by their language.
    joined = scored.join(F.broadcast(bands) if bands.count() <= SENT else bands, _same("lang"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def assess(docs: DataFrame) -> DataFrame:
    """The verdict on every document of ``docs`` (doc_id, text, lang; other columns are ignored).

    Returns doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ppl, kept: one row per
    input row, repeated rows included. A null or empty text has no words, null log_ppl and fails; a null lang is a language of its
    own. Where the other fold has no text of a language, log_ppl is null and the fixed rules decide. The band of a language comes from the median and quartiles of log_ppl over all its documents that pass the fixed rules
    (see BAND_WIDTH); a text whose log_ppl lies below or above it is rejected. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    scored = cut(_scored(rows, _shipped(*_model(rows))))
    return _judged(scored, _bands(scored)).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ppl", "kept")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang and more) that ``assess`` keeps, all columns as they are.

    Texts are scored a second time once the bands are known, which is cheaper than a shuffle of all texts by their verdicts.
    """
    names = {c: c if c in ("text", "lang") else f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select("text", "lang")
    shipped = _shipped(*_model(rows))
    bands = _bands(cut(_scored(rows, shipped)))
    whole = docs.select(*(docs[c].alias(n) for c, n in names.items()))
    return _judged(_scored(whole, shipped, keep=True), bands).where("kept").select(*(F.col(n).alias(c) for c, n in names.items()))
