"""Importance resampling against a plain version; odd input."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trailweave.llm import resample as R

SCHEMA = "doc_id long, text string"


def plain(docs, target, share=25, least=20, n_buckets=10_000):
    """The contract, row by row, in plain Python."""

    def grams(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [zlib.crc32(g.encode()) % n_buckets for g in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in grams(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + n_buckets) / ((s[b] + 1) * (t.sum() + n_buckets)))) for b in range(n_buckets)]
    rows = []
    for key, text in docs:
        words, hit = grams(text)
        weight = sum(gain[b] for b in hit) // len(hit) if hit else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(hit), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    able = sorted((-r[3], r[0] is not None, r[0] or 0, r[1], r[2]) for r in rows if r[4])
    n = share * len(able) // 100
    ranks = {}
    for k, x in enumerate(able[:n]):
        ranks.setdefault((x[2] if x[1] else None, -x[0], x[3], x[4]), []).append(k + 1)
    out = []
    for r in rows:
        free = ranks.get((r[0], r[3], r[1], r[2]), []) if r[4] else []
        out.append((r[0], r[1], r[2], r[3], free.pop(0) if free else None))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def prose(rng, n):
    words = ["Alpha", "beta", "gamma9", "Straße", "été", "the", "of", "x", "漢字"]
    return " ".join(rng.choice(words, size=n)) + "."


def test_equals_the_plain_version(spark):
    rng = np.random.default_rng(3)
    docs = [(k, prose(rng, int(rng.integers(1, 90)))) for k in range(120)]
    docs += [(200, None), (201, ""), (202, "...\n 12"), (None, prose(rng, 30)), (203, "Ab-cD_eF`g{h}i~" * 20), (204, "w" * 5000 + " " + prose(rng, 40_000))]
    docs += [(300, docs[5][1])] * 40  # repeated rows
    target = [prose(rng, 40).replace("the", "beta") for _ in range(20)] + [None]
    got = R.drawn(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert ordered(map(tuple, got.collect())) == ordered(plain(docs, target))


def test_small_copies_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "COPIES", 7)
    docs = [(1, "one two three four five")] * 50 + [(2, "six seven")] * 3
    got = R.drawn(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([("one two",)], "text string"), share=60, least_words=2)
    assert ordered(map(tuple, got.collect())) == ordered(plain(docs, ["one two"], 60, 2))


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    target = spark.createDataFrame([("a b c",)], "text string")
    assert R.drawn(none, target).collect() == []
    docs = [(k, "some words here " * (k + 5)) for k in range(30)]
    plainly = plain(docs, [])
    odd = spark.createDataFrame([(*d, 1, 2, "x", 3, 4) for d in docs], SCHEMA + ", key int, score int, weight string, n int, rank int")
    assert ordered(map(tuple, R.drawn(odd, none.select("text")).collect())) == ordered(plainly)
    kept = R.resampled(odd, none.select("text"))
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in plainly if r[4]}


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_suffix_arrays(depth):
    rng = np.random.default_rng(depth)
    ids, first = rng.integers(0, 4, 300), np.array([0, 0, 50, 51, 180, 300])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(300)
    order, shared = R.suffixes(ids, left, depth)
    cuts = [tuple(ids[i : i + min(depth, left[i])]) for i in order]
    assert cuts == sorted(cuts)
    for k in range(1, 300):
        common = next((j for j in range(depth) if cuts[k][j : j + 1] != cuts[k - 1][j : j + 1] or len(cuts[k]) <= j), depth)
        assert shared[k] == common


def test_more_words_a_gram():
    texts = pa.array(["a b c d e f g a b c d", None, "", "b c d", "ß"])
    n_buckets = 997
    for n, at, here, first in R.buckets(texts, 4, n_buckets):
        for k, text in enumerate(texts.to_pylist()):
            words = (text or "").split()
            want = [zlib.crc32(" ".join(words[i : i + n]).encode()) % n_buckets for i in range(len(words) - n + 1)]
            assert at[first[k] : first[k + 1]][here[first[k] : first[k + 1]]].tolist() == want


def test_checksums():
    words = [b"abc", b"", b"x" * 3000, "é".encode(), b"the"]
    sums, sizes = R.checksums(pa.array(words, pa.large_binary()))
    assert sums.tolist() == [zlib.crc32(w) for w in words]
    assert R.joined(sums, sums[::-1].copy(), sizes[::-1].copy()).tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[::-1])]
