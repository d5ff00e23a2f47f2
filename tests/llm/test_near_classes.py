"""Near-duplicates: classes are those of all pairs that share a bucket, however large the bucket is."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trailweave.llm import near_dedup
from trailweave.llm.common import text_bytes


def _edited(rng, words, n, mark):
    out = list(words)
    for j in rng.choice(len(words), n, replace=False):
        out[j] = f"{mark}-{j}"
    return out


def _brute(spark, df, texts):
    """The weighted Jaccard similarity of all pairs, and which of them share a band."""
    keyed = df.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")
    weight = near_dedup.weights(*near_dedup._document_frequencies(keyed))
    bands = {bytes(r.text_key): np.array(r.bands) for r in near_dedup._banded(keyed, spark.sparkContext.broadcast(weight)).collect()}
    mine = np.array([bands[hashlib.md5(t.encode()).digest()] for t in texts])
    all_, bounds = near_dedup.shingles(*text_bytes(pa.array(texts)))
    keys, where = np.unique(all_, return_inverse=True)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    counts = np.zeros((len(texts), len(keys)), dtype=np.float32)
    np.add.at(counts, (owner, where), 1)
    assert counts.max() == 1  # so that a product gives what two texts share
    w = weight[keys & np.uint32((1 << near_dedup.DF_BITS) - 1)].astype(np.float64)
    shared = (counts * w) @ counts.T
    total = (counts * w).sum(axis=1)
    similar = shared / (total[:, None] + total[None] - shared)
    band = np.zeros(similar.shape, dtype=bool)
    for k in range(mine.shape[1]):
        band |= mine[:, k][:, None] == mine[:, k][None]
    return similar, band, weight


def _components(links):
    label = np.arange(len(links))
    while True:
        after = np.array([min(label[i], label[links[i]].min(initial=len(links))) for i in range(len(links))])
        after = after[after]
        if (after == label).all():
            return label
        label = after


def test_no_link_within_a_large_bucket_is_lost(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    texts = [_edited(rng, base, int(rng.integers(0, 5)), f"e{i}") for i in range(800)]
    texts += [_edited(rng, texts[i], 4, f"f{i}") for i in range(300)]  # similar to one matched text, too far from most others
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.groups(df).collect()}
    got = np.array([got[i] for i in range(len(texts))])
    similar, band, _ = _brute(spark, df, texts)
    links = np.argwhere(np.triu(band & (similar >= near_dedup.SIMILARITY + 1e-6), 1))
    assert len(links) > 1000 and (got[links[:, 0]] == got[links[:, 1]]).all()
    # Nothing else is joined: classes lie within those of all similar pairs.
    wide = _components(similar >= near_dedup.SIMILARITY - 1e-6)
    assert all(len(set(wide[got == c])) == 1 for c in set(got))


def test_a_wide_group_of_thousands_is_joined_as_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    # Up to 12 edits: many members are too far from the centres, and some are like another such member only.
    texts = [_edited(rng, base, int(rng.integers(0, 13)), f"e{i}") for i in range(1500)]
    texts += [_edited(rng, texts[i], 1, f"g{i}") for i in range(1000)]
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.class_id for r in near_dedup.groups(df).collect()}
    got = np.array([got[i] for i in range(len(texts))])
    similar, _, weight = _brute(spark, df, texts)
    links = np.argwhere(np.triu(similar >= near_dedup.SIMILARITY, 1))
    assert (got[links[:, 0]] == got[links[:, 1]]).mean() >= 0.99
    alone = [x for x in range(1500, 2500) if (similar[x] >= near_dedup.SIMILARITY).sum() == 2]  # itself and its model
    assert len(alone) > 50 and np.mean([got[x] == got[x - 1500] for x in alone]) >= 0.9
    wide = _components(similar >= near_dedup.SIMILARITY - 1e-6)
    assert all(len(set(wide[got == c])) == 1 for c in set(got))
    # A group of copies counts about as one text, so that what it shares weighs about as much as what is unique.
    shared = near_dedup.shingles(*text_bytes(pa.array([" ".join(base)])))[0]
    assert np.median(weight[shared & np.uint32((1 << near_dedup.DF_BITS) - 1)]) > 0.6 * weight.max()
    # What unrelated texts share weighs less.
    line = "all rights are reserved here"
    other = [" ".join([line, *(f"u{i}-{j}" for j in range(60))]) for i in range(400)]
    keyed = spark.createDataFrame([(t,) for t in other], "text string").withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    weight = near_dedup.weights(*near_dedup._document_frequencies(keyed))
    assert weight[near_dedup.shingles(*text_bytes(pa.array([line])))[0] & np.uint32((1 << near_dedup.DF_BITS) - 1)][0] < 0.6 * weight.max()


def test_cells_of_any_size_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(_edited(rng, base, int(rng.integers(0, 8)), f"e{i % 70}")) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = sorted(near_dedup.groups(df).collect())
    monkeypatch.setattr(near_dedup, "LEFT_CELL", 500)
    monkeypatch.setattr(near_dedup, "RIGHT_CELL", 900)
    assert sorted(near_dedup.groups(df).collect()) == one
