"""Quality rules, language identification and their edge cases against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import language, quality

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [
    (1, None, "en", None, None, "x"), (2, "", "en", "a", 0, "x"), (3, " \n\t ", None, "a", 4, "x"), (4, "une ligne\nune ligne\n\nfin", "fr", "a", 1, "x"),
    (None, "no id", "en", "a", 1, "x"), (6, "a b c a b c a b", "en", "a", 1, "x"), (6, "a b c a b c a b", "en", "a", 1, "x"), (7, "12345 !!! ###", "de", "a", 1, "x"), (8, "mot " * 30_000, "fr", "a", 1, "x"),
]


def base(text):
    words = WORD.findall(text or "")
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    covered = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_measures_equal_brute_force():
    rng = np.random.default_rng(3)
    texts = [r[1] for r in ODD]
    for _ in range(300):
        texts.append("".join(rng.choice(list("aab  \n\t\x0b  é#|𝒳"), rng.integers(0, 80))))
    for text in texts:
        assert quality.base_measures(text) == base(text), text


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_kneser_ney_equals_brute_force(spark):
    texts = ["the cat sat on the mat", "The dog sat 19", "a cat!", "字字𝒳 cat", "a hat", "the mat, the hat", "dogs 7", "on that cat"]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    models = quality._arrays(quality.kneser_ney(quality.ngram_counts(rows)))
    folds = {r.text: r.fold for r in rows.select("text", quality._fold()).collect()}
    assert set(folds.values()) == {0, 1} and set(models) == {("en", 0), ("en", 1)}
    grams = lambda t: [(" " * (quality.ORDER - 1) + t)[i : i + quality.ORDER] for i in range(len(t))]
    plain = lambda t: re.sub(r"\d", "0", t.lower())
    for fold in (0, 1):
        counts = {quality.ORDER: Counter(g for t in texts if folds[t] == fold for g in grams(plain(t)))}
        for k in range(quality.ORDER - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])

        def prob(gram, k):
            if not k:
                return 1 / (len(counts[1]) + 1)
            c = counts[k]
            n = [sum(v == i for v in c.values()) for i in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
            d = [max(0.1, min(i - 0.1, i - (i + 1) * y * (n[i] / n[i - 1] if n[i - 1] else 1))) for i in (1, 2, 3)]
            gram = gram[-k:]
            same = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
            lower = prob(gram, k - 1)
            if not same:
                return lower
            cut = lambda v: min(v, d[min(v, 3) - 1])
            here = same.get(gram, 0)
            return ((here - cut(here)) if here else 0) / sum(same.values()) + sum(map(cut, same.values())) / sum(same.values()) * lower

        for t in texts:  # of either fold: seen and unseen n-grams
            hi, lo, _ = quality._codes([t])
            got = quality._log_probability(hi, lo, models["en", fold])
            assert np.allclose(got, [math.log(prob(g, quality.ORDER)) for g in grams(plain(t))], atol=1e-4), t
        alphabet = [*{g for g in counts[1]}, "\0"]
        assert abs(sum(prob("e ca"[1 - quality.ORDER :] + x, quality.ORDER) for x in alphabet) - 1) < 1e-9


def test_a_model_in_parts_gives_the_same_scores(spark, docs, monkeypatch):
    some = docs.limit(60).select("doc_id", "text", "lang")
    some = some.unionByName(some.limit(3))
    key = lambda r: (str(r.doc_id), r.log_ppl or 0)
    one = sorted(quality.assess(some).collect(), key=key)
    monkeypatch.setattr(quality, "BROADCAST_ENTRIES", 20_000)
    parts = sorted(quality.assess(some).collect(), key=key)
    assert [(r.doc_id, r.n_words) for r in one] == [(r.doc_id, r.n_words) for r in parts]
    assert np.allclose([r.log_ppl or 0 for r in one], [r.log_ppl or 0 for r in parts], atol=1e-4)


def test_parts_of_a_skewed_model_hold_their_bound(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdfghijklmnopqrstuvwxyz"))
    texts = ["".join(x + "e" for x in rng.choice(letters, 300)) for _ in range(60)]  # every other character is an e
    model = quality.cut(quality.kneser_ney(quality.ngram_counts(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"))))
    bound = model.count() // 8
    parts = quality.n_parts(model, bound)
    sizes = [quality.part_of(model, i, parts).count() for i in range(parts)]
    assert parts > 1 and max(sizes) <= 2 * bound and sum(sizes) >= model.count()
    assert quality.n_parts(model, 10**9) == 1 and quality.n_parts(model.limit(0), 5) == 1


def test_verdicts_reject_junk_and_keep_prose(spark, docs):
    junk = docs.where("lang = 'en'").limit(3).select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.regexp_replace("text", r"(\w)( |$)", "$1 @~^ ").alias("text"), "lang")
    odd = spark.createDataFrame(ODD, DOC)
    out = {}
    for r in quality.assess(docs.select("doc_id", "text", "lang").unionByName(junk).unionByName(odd.select("doc_id", "text", "lang").where("doc_id < 9 or doc_id is null").withColumn("doc_id", F.col("doc_id") + 2_000_000))).collect():
        out.setdefault(r.doc_id, []).append(r)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = [i for i, q in labels.items() if q == 1 and not base(texts[i])[5]]
    assert sum(out[i][0].kept for i in good) >= 0.98 * len(good)
    assert not any(out[i][0].kept for i in out if i is not None and 1_000_000 <= i < 2_000_000 and not out[i][0].base_failed)
    assert len(out[2_000_006]) == 2 and all(not r.kept for r in out[2_000_001] + out[2_000_002] + out[2_000_003] + out[None])
    kept = {r.doc_id for rs in out.values() for r in rs if r.kept}
    got = quality.accepted(docs.withColumn("log_ppl", F.lit("clash")))
    assert got.columns == [*docs.columns, "log_ppl"] and len({r.doc_id for r in got.collect()} ^ {i for i in kept if i < 1_000_000}) <= 3


def test_no_documents(spark):
    none = spark.createDataFrame([], DOC)
    assert quality.assess(none).count() == 0
    assert language.identify(none).count() == 0


def test_languages_are_told_apart(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(big).join(big.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_odd_texts(spark, docs):
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    got = [(r.doc_id, r.lang_pred) for r in language.predict(spark.createDataFrame(ODD, DOC), model).collect()]
    und = {i for i, lang in got if lang == "und"}
    assert len(got) == len(ODD) and {1, 2, 3, 7} <= und and None not in und and 4 not in und
    kernel = lambda a, b: len(np.intersect1d(a, b)) / math.sqrt(len(a) * len(b))
    assert kernel(language.ngrams("abc"), language.ngrams("ABC")) == 1 and len(language.ngrams("aba")) == 2 + 2 + 1
