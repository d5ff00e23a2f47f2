"""Tries of term counts and the divergences from them, against a plain version; odd input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trailweave.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, least=3, terms=200):
    """The contract in plain Python."""
    held, groups, counts = defaultdict(Counter), set(), defaultdict(Counter)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        w = words(text)
        held[lang].update(set(w))
        counts[lang, source].update(w)
    out = []
    for lang, source in groups:
        kept = sorted((t for t, n in held[lang].items() if n >= least), key=lambda t: t.encode())
        sources = [s for x, s in groups if x == lang]
        whole = {s: sum(counts[lang, s][t] for t in kept) + len(kept) for s in sources}
        p = {s: [1 + 10**9 * (counts[lang, s][t] + 1) // whole[s] for t in kept] for s in sources}
        every = sum(whole.values()) - len(kept) * (len(sources) - 1)
        q = [1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 1) // every for t in kept]
        pairs = sorted((-sum((a - b) ** 2 // b for a, b in zip(p[source], p[o])), o.encode(), o) for o in sources if o != source)
        out += [(lang, source, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
        best = sorted((-((a - b) ** 2 // b), t.encode(), t) for t, a, b in zip(kept, p[source], q) if counts[lang, source][t] and a > b)
        out += [(lang, source, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(best[:terms])]
    return sorted(out)


def corpus(n=150):
    rng = np.random.default_rng(5)
    base = ["the", "Theme", "thematic", "he", "her", "été", "étés", "漢字", "漢", "a", "ab", "abc", "𐐷x", "ﬀ", "zebra", "x" * 300] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    docs = [(k, " ".join(rng.choice(base, size=int(rng.integers(0, 60)))), ["en", "fr", "de"][k % 3], f"s{int(rng.integers(0, 5)) * (k % 4 > 0)}") for k in range(n)]
    docs += [(900, None, None, None), (901, "", "xx", "s1"), (902, "unique words only here", "yy", "s1"), (903, None, "yy", "s2"), (904, "a the", "en", None), (905, "12 34 -_`~", "en", "quiet")]
    return docs + [docs[7]] * 30 + [(None, "Only-A to Z\x7fare low\x00ered: É", "en", "s1")] * 3


def test_equals_the_plain_version(spark):
    docs = corpus()
    got = D.divergences(spark.createDataFrame(docs, SCHEMA).repartition(4))
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == plain(docs)


def test_branches_are_cut_deeper_and_walks_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(D, "MERGED", 40)
    monkeypatch.setattr(D, "WALKED", 6)
    docs = corpus()
    got = D.divergences(spark.createDataFrame(docs, SCHEMA).repartition(3), terms=5)
    assert sorted(map(tuple, got.collect())) == plain(docs, terms=5)


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert D.divergences(none).collect() == []
    docs = corpus(40)
    odd = spark.createDataFrame([(*d, 1, "x", 2, "y") for d in docs], SCHEMA + ", item int, part string, n int, prefix string").withColumnRenamed("text", "body")
    assert sorted(map(tuple, D.divergences(odd, text="body").collect())) == plain(docs)


def test_languages_without_kept_terms(spark):
    docs = [(1, "one", "aa", "s"), (2, "two", "aa", "t"), (3, None, "aa", "u")]
    got = sorted(map(tuple, D.divergences(spark.createDataFrame(docs, SCHEMA)).collect()))
    assert got == plain(docs) and len(got) == 6


def test_layout_reads_back():
    rng = np.random.default_rng(1)
    terms = sorted({bytes(rng.choice([97, 98, 195], size=int(rng.integers(1, 9)))) for _ in range(500)} | {b"a" * 2000, b"a" * 2001})
    branch, below, labels = D.laid_out(pa.array(terms, pa.large_binary()))
    assert D.read_out(branch, below, labels).to_pylist() == terms
    assert len(labels) < sum(map(len, terms)) / 2
    for a, b, depth in zip(terms, terms[1:], branch[1:]):
        assert a[:depth] == b[:depth] and a[depth : depth + 1] != b[depth : depth + 1]
    assert D.read_out(*D.laid_out(pa.array([], pa.large_binary()))).to_pylist() == []


@pytest.mark.parametrize("held", [1, 50, 10**6])
def test_tries_let_go_in_parts(monkeypatch, held):
    monkeypatch.setattr(D, "HELD", held)
    docs = corpus()
    batch = pa.RecordBatch.from_pydict({"text": [d[1] for d in docs], "lang": [d[2] or "" for d in docs], "source": [d[3] or "" for d in docs]})
    rows = pa.Table.from_batches(list(D._count(iter([batch.slice(k, 9) for k in range(0, len(docs), 9)]))))
    got, seen = Counter(), Counter()
    for k in range(rows.num_rows):
        terms = D.read_out(D._column(rows, "branches", k), D._column(rows, "sizes", k), rows["labels"][k].as_py()).to_pylist()
        assert all(t.startswith(rows["prefix"][k].as_py()) for t in terms) and terms == sorted(terms)
        leaf = np.repeat(np.arange(len(terms)), D._column(rows, "held", k))
        for i, s, n, m in zip(leaf, D._column(rows, "source", k), D._column(rows, "n", k), D._column(rows, "docs", k)):
            at = rows["lang"][k].as_py(), rows["sources"][k].as_py()[s], terms[i].decode()
            got[at] += n
            seen[at] += m
    want, wanted = Counter(), Counter()
    for _, text, lang, source in docs:
        want.update((lang or "", source or "", w) for w in words(text))
        wanted.update((lang or "", source or "", w) for w in set(words(text)))
    assert got == want and seen == wanted


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 10**9, 9 * 10**12, 10**15 - 1], dtype=np.int64)
    whole = np.array([3, 7 * 10**9 + 1, 10**13 + 7, 10**15], dtype=np.int64)
    assert D.shares(counts, whole).tolist() == [1 + 10**9 * (int(c) + 1) // int(w) for c, w in zip(counts, whole)]
