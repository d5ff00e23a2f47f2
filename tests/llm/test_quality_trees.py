"""Statistics against a plain version, trees against a row-wise walk and an exhaustive first split, held-out accuracy, odd input."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trailweave.llm import quality_trees as Q

SF = "/root/testdata/sf0.01"


def plain(text):
    """The statistics by their meaning, a text at a time."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return [0.0] * len(Q.NAMES)
    n, w = len(text), len(words)
    kinds = Counter()
    for c in text:
        o = ord(c)
        kinds["beyond" if o > 127 else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "space" if c == " " else "newline" if c == "\n" else "white" if c in "\t\x0b\x0c\r" else "stop" if c == "." else "comma" if c in ",;:" else "shout" if c in "!?" else "symbol" if c in "#*$%&<>@^~=+_\\/{}[]" else "bar" if c == "|" else "mark"] += 1
    sizes = [len(x) for x in words]
    mean = sum(sizes) / w
    lines = [x for x in (re.findall(r"[^\x20\x09-\x0D]+", line) for line in text.split("\n")) if x]
    grams = lambda k: len(set(zip(*(words[i:] for i in range(k))))) / (w - k + 1) if w >= k else 1
    letterless = sum(not re.search(r"[A-Za-z]|[^\x00-\x7f]", x) for x in words)
    loud = "!?#*$%&<>@^~=+_\\/{}[]|"
    marks = sum(x[-1] in loud or (ord(x[-1]) < 128 and not x[-1].isalnum() and x[-1] not in ".,;:") for x in words)
    return [
        math.log1p(n), math.log1p(w), mean, math.sqrt(max(0, sum(s * s for s in sizes) / w - mean**2)), math.log1p(max(sizes)), kinds["upper"] / max(1, kinds["lower"] + kinds["upper"] + kinds["beyond"]),
        kinds["digit"] / n, kinds["beyond"] / n, (kinds["space"] + kinds["newline"] + kinds["white"]) / n, kinds["stop"] / w, kinds["comma"] / w, kinds["shout"] / w, kinds["symbol"] / w, kinds["bar"] / w,
        kinds["mark"] / w, -sum(v / n * math.log2(v / n) for v in kinds.values()), len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:])) / w, grams(2), grams(3), sum("A" <= x[0] <= "Z" for x in words) / w,
        letterless / w, marks / w, math.log1p(len(lines)), len(set(map(tuple, lines))) / len(lines), w / len(lines), sum(x[-1][-1] in ".!?" for x in lines) / len(lines),
    ]


TEXTS = ["", None, " \n\t", "one", "a a a b. C, d!\na a a b. C, d!\n\nb a", "Straße é 漢字 漢字 | x*** 12 34-\r\n\x0bEND?", "no end", "\n\n x \n", "a b\nb a", "w" * 3000 + " " + "ab cd, " * 2000]


def test_statistics():
    got = Q.statistics(pa.array(TEXTS, pa.string()))
    assert np.allclose(got, [plain(t) for t in TEXTS], atol=1e-9)
    for k, t in enumerate(TEXTS):  # whatever stands beside it
        assert np.array_equal(Q.statistics(pa.array([t], pa.string()))[0], got[k])


def data(rows=400):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(rows, len(Q.NAMES))), 1)
    return x, ((x[:, 3] > 0.4) ^ (x[:, 7] * x[:, 9] > 0)).astype(float)


def test_flat_arrays_walk_as_a_tree_does():
    x, y = data()
    forest = Q.fitted(x, y, trees=12)
    for row, score in zip(x[:50], forest.scores(x[:50])):
        z = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.statistic[at]] <= forest.threshold[at] else forest.right[at]
            z += forest.value[at]
        assert score == pytest.approx(1 / (1 + math.exp(-z)))


def test_first_split_is_the_best_of_all():
    x, y = data()
    forest = Q.fitted(x, y, trees=1, depth=1)
    p = (y.sum() + 1) / (len(y) + 2)
    gain = lambda k: (y[k] - p).sum() ** 2 / (k.sum() * p * (1 - p) + Q.SHRINK)
    best = max(gain(x[:, f] <= t) + gain(x[:, f] > t) for f in range(x.shape[1]) for t in np.unique(x[:, f])[:-1] if min((x[:, f] <= t).sum(), (x[:, f] > t).sum()) >= Q.LEAST_ROWS)
    low = x[:, forest.statistic[0]] <= forest.threshold[0]
    assert gain(low) + gain(~low) == pytest.approx(best, rel=0.02)  # bins are quantiles, so a threshold may be off by one
    want = np.where(low, Q.RATE * (y[low] - p).sum() / (low.sum() * p * (1 - p) + 1), Q.RATE * (y[~low] - p).sum() / ((~low).sum() * p * (1 - p) + 1))
    assert np.allclose(forest.value[np.where(low, forest.left[0], forest.right[0])], want)
    assert ((Q.fitted(x, y).scores(x) >= 0.5) == y).mean() > 0.97


def test_one_kind_of_label_or_none():
    x, y = data(50)
    assert Q.fitted(x, np.ones(50)).scores(x).min() > 0.9
    assert Q.fitted(x[:0], y[:0]).scores(x).tolist() == [0.5] * 50


def test_odd_input(spark):
    docs = [(k, "Good words in a line of prose, here and there." if k % 2 else "BAD!! BAD!! ### *** $$$") for k in range(60)]
    docs += [(None, "no key"), (100, None), (101, "")] + [(5, docs[5][1])] * 300
    labels = [(k, k % 2) for k in range(60)] + [(None, 1), (7, 1), (9, None), (5000, 0)]
    frame = spark.createDataFrame([(*d, "x", 1, 2.0) for d in docs], "doc_id long, text string, key string, x int, score double")
    marks = spark.createDataFrame([(*m, 1) for m in labels], "doc_id long, quality int, held_out int")
    out = Q.classified(frame, marks)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d[0]) for d in docs)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["predicted"] == r["doc_id"] % 2
    assert Q.classified(frame.limit(0), marks).collect() == []
    assert {r["score"] for r in Q.classified(frame, marks.limit(0)).collect()} == {0.5}
    assert sorted(map(str, Q.classified(frame.repartition(7), marks).collect())) == sorted(map(str, rows))


@pytest.mark.skipif(not os.path.isdir(SF) and not os.path.exists(SF), reason="the test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.classified(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.97
