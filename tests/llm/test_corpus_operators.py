"""Mixing, neighbours, near-duplicates and the pipeline against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import mixing, near_dedup, neighbours

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, copies string"
ODD = [(1, None, "en", "a", 1, "x"), (2, "", "en", None, 1, "x"), (3, " \n", "en", "b", 1, "x"), (4, "same words here", "en", "b", 1, "x"), (4, "same words here", "en", "b", 1, "x"), (None, "same words here", "en", "a", 1, "x"), (5, "same  words\nhere", "en", None, 1, "x"), (6, "alone", "en", "b", 1, "x"), (7, "long " * 30_000, "en", "c", 1, "x")]


def targets(sizes):
    """The contract's targets: shares by weight, the excess of capped sources shared again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = (total - sum(out.values())) / max(sum(weight[s] for s in open_), 1e-9)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_mix_meets_its_targets(spark, which):
    docs = spark.read.parquet(f"{DATA}/documents.parquet") if which == "documents" else spark.createDataFrame(ODD, DOC)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
    for s in sizes:
        least = min((r.size for r in rows if r.source == s and r.size), default=0)
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 2 * least), (s, taken[s], want[s])
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0


def test_mix_runs_no_job_for_a_newton_step(spark):
    """What the driver plans doesn't follow the number of steps; there were 97 jobs."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, "w " * int(n), "en", "abc"[i % 3], 1, "x") for i, n in enumerate(rng.integers(1, 300, 300))], DOC)
    spark.sparkContext.setJobGroup("mix", "mix")
    try:
        assert mixing.mixed(docs).count()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("mix"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert 0 < jobs <= 60, jobs


def test_rates_take_what_they_should():
    rng = np.random.default_rng(4)
    size, n = np.arange(1.0, 400.0), rng.integers(1, 50, 399).astype(float)
    for share in (0.01, 0.5, 1.0, 1.4, 1.99, 2.0):
        rate = mixing.balance(size, n, share * (size * n).sum())
        assert (rate > 0).all() and (rate <= 2).all() and math.isclose((rate * size * n).sum(), share * (size * n).sum(), rel_tol=1e-8)
    assert mixing.balance(np.array([7.0]), np.array([1.0]), 3.5)[0] == pytest.approx(0.5)


def nearest_brute(rows, k):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], dtype=float)
    out = {}
    for i, q in enumerate(ids):
        if q is not None and q % 20 == 0:
            score = (x[i] * x).sum(axis=1)
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-score[j], ids[j]))[:k]
            out[q] = [(ids[j], score[j]) for j in order]
    return out


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 8)) * rng.uniform(0.1, 3, size=(1500, 1))
    x[300:420] = x[300]  # many equal vectors: ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    bad = [(20_000, None), (20_020, [0.0] * 8), (20_040, [float("nan")] * 8), (20_060, [None] + [1.0] * 7), (20_080, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, score string")
    old = neighbours.SHARD_ROWS
    neighbours.SHARD_ROWS = 400
    try:
        got = defaultdict(list)
        for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, factor=1.0).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
    finally:
        neighbours.SHARD_ROWS = old
    want = nearest_brute(rows, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall_and_few_candidates(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = nearest_brute([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got = defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    recall = np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95, recall
    few = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(few, F.col("vec_id") == 0).orderBy("rank", "vec_id").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in rows] == [(0, 1, 1, 2.0)] * 2 + [(0, 2, 0, 1.0)] * 2
    assert neighbours.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_recall_over_many_shards_and_odd_vectors(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = nearest_brute([(r.vec_id, r.embedding) for r in df.collect()], 20)
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 200)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)  # queries stream through each tree in many turns
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(want) and all(len(v) == len(set(v)) == 20 for v in got.values())
    recall = np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95, recall
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (None, [3.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [3.0, 0.0]), (20, [5.0])], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(odd, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 2, 3.0), (0, 2, None, 3.0)]


def shingle_sets(texts):
    out = []
    for t in texts:
        w = [x for x in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def test_shingles_and_samples_follow_weighted_jaccard():
    import pyarrow as pa

    from trailweave.llm.common import text_bytes

    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(300)]
    texts = ["", "one two", " ".join(base), " ".join(base), " ".join([f"x{i}" if rng.random() < 0.02 else b for i, b in enumerate(base)])]
    all_, bounds = near_dedup.shingles(*text_bytes(pa.array(texts)))
    assert np.diff(bounds).tolist() == [0, 1, 296, 296, 296]
    weight = np.ones(1 << near_dedup.DF_BITS, dtype=np.float32)
    signs = np.concatenate([near_dedup.signatures(all_, bounds, weight, near_dedup._variates())])
    sets = shingle_sets(texts)
    true = len(sets[3] & sets[4]) / len(sets[3] | sets[4])
    got = near_dedup.weighted_jaccard(*(np.sort(all_[bounds[i] : bounds[i + 1]]) for i in (3, 4)), weight)
    assert abs(got - true) < 1e-9 and (signs[2] == signs[3]).all() and abs((signs[3] == signs[4]).mean() - true) < 0.12


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, base = [], [f"w{i}" for i in range(200)]
    for i in range(60):  # one large group of copies that differ, some by much
        words = list(base)
        for j in rng.choice(200, int(rng.integers(0, 12)), replace=False):
            words[j] = f"e{i}-{j}"
        rows.append((i, " ".join(words)))
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(100 + i, shared + " " + " ".join(f"u{i}-{j}" for j in range(90))) for i in range(60)]  # a long passage, but other texts
    rows += [(200 + i, rows[3][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.groups(df).collect()}
    sets = shingle_sets([t for _, t in rows])
    ids = [i for i, _ in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = []
    for a in range(len(ids)):
        for b in range(a):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.82:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
            elif j >= 0.76:
                near.append((ids[a], ids[b]))
    for a, b in [(a, b) for a in ids for b in ids if find(a) == find(b)]:
        assert got[a] == got[b]
    # Nothing is joined but by pairs that are at the threshold, within the weights' few per cent.
    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert all(find(i) == find(got[i]) for i in ids) and all(got[100 + i] == 100 + i for i in range(60))


def test_classes_of_odd_texts(spark):
    df = spark.createDataFrame(ODD, DOC)
    got = defaultdict(list)
    for r in near_dedup.groups(df).collect():
        got[r.doc_id].append(r.class_id)
    assert got == {1: [1], 2: [2], 3: [3], 4: [4, 4], None: [4], 5: [4], 6: [6], 7: [7]}
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7]
    assert near_dedup.groups(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], DATA).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    from trailweave.llm import quality, secrets

    verdict = {r.doc_id for r in quality.assess(docs).where("kept").collect()}
    assert ids[1] == verdict and all(s.columns == docs.columns for s in seen[:-1])
    classes = {r.doc_id: r.class_id for r in near_dedup.groups(seen[1]).collect()}
    assert ids[2] == set(classes.values()) and seen[2].count() == len(ids[2])
    texts = {r.doc_id: r.text for r in seen[2].collect()}
    words = secrets.learned_words(seen[2])
    assert all(r.text == secrets.redact(texts[r.doc_id], words) and r.n_chars == len(r.text) for r in seen[3].collect()) and ids[3] == ids[2]
    copies = {r.doc_id: r.copies for r in mixing.mix(seen[3]).collect()}
    assert {r.doc_id: r["count"] for r in seen[4].groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}
    assert seen[5].count() == seen[4].count() and seen[5].where("size(ids) = n_pieces AND n_pieces > 0").count() == seen[5].count()
