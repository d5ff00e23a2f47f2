"""Language identification by a string kernel.

The kernel of two texts is the number of different character n-grams, of each length up to ORDER, that both hold, divided by the
root of the product of their own numbers. LANDMARKS texts of each language span the Nyström approximation: a text's features are its
kernels with the landmarks, times the inverse root of the landmarks' kernel matrix. One ridge regression for each language
(one-versus-rest) is fitted on a bounded sample. A text's scores are then one product of its presence row with a matrix that holds
landmarks, inverse root and ridge weights multiplied out; texts are scored many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import text_slices

ORDER = 3
#: Texts sampled of each language, and those of them that are landmarks. Texts of up to LONG characters come first.
SAMPLE, LANDMARKS, LONG = 240, 40, 20_000
#: Languages learned at most; of more, those with the most texts.
LANGUAGES = 400
RIDGE = 1e-3
_POINT = 21  # bits of a code point, so that three make one exact 63-bit key


def ngrams(text: str) -> np.ndarray:
    """The different n-grams of 1..ORDER characters of a lower-case text, white space as one kind, sorted."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    points[(points == 10) | (points == 9) | (points == 13)] = 32
    parts, key = [], points + 1
    for n in range(1, ORDER + 1):
        if n > 1:
            key = (key[:-1] << _POINT) | (points[n - 1 :] + 1)
        ordered = np.sort(key)
        parts.append(ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered)
    return np.concatenate(parts)  # longer n-grams have larger keys, so the whole is sorted


def _sample(docs: DataFrame) -> DataFrame:
    """(lang, grams) of up to SAMPLE texts of each language: those first by a hash of the text and id, long texts last."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Names don't bound a sample: only the ids and hashes of the rows chosen meet in a window, no texts.
    named = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    order = F.xxhash64("doc_id", "text")
    narrow = known.select("lang", order.alias("h"), (F.length("text") > LONG).cast("int").alias("long"))
    first = Window.partitionBy("lang").orderBy("long", "h")
    narrow = narrow.select("*", F.row_number().over(first).alias("r")).where(F.col("r") <= SAMPLE).join(F.broadcast(named), "lang", "left_semi")
    chosen = known.select("lang", "text", order.alias("h")).join(F.broadcast(narrow.select("lang", "h").distinct()), ["lang", "h"], "left_semi")
    chosen = chosen.dropDuplicates(["lang", "h"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.record_batch([part.column("lang"), part.column("h"), pa.array([ngrams(t) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))], names=["lang", "h", "grams"])

    return chosen.mapInArrow(grams, "lang string, h long, grams array<long>")


def fit(docs: DataFrame) -> dict:
    """The model of ``docs`` (doc_id, text, lang): {languages, keys, weights}; weights has a row for each n-gram of a landmark."""
    rows = sorted(((r.lang, r.h, np.array(r.grams, dtype=np.int64)) for r in _sample(docs).toLocalIterator()), key=lambda r: r[:2])
    languages = sorted({r[0] for r in rows})
    seen: dict[str, int] = {}
    marks = []
    for i, (lang, _, _) in enumerate(rows):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= LANDMARKS:
            marks.append(i)
    if not marks:
        return {"languages": [], "keys": np.zeros(0, np.int64), "weights": np.zeros((0, 0), np.float32)}
    keys = np.unique(np.concatenate([rows[i][2] for i in marks]))
    held = np.zeros((len(keys), len(marks)), dtype=np.float32)
    for j, i in enumerate(marks):
        held[np.searchsorted(keys, rows[i][2]), j] = 1 / np.sqrt(len(rows[i][2]))

    def kernels(some: list[int]) -> np.ndarray:
        out = np.zeros((len(some), len(marks)))
        for n, i in enumerate(some):
            at = np.searchsorted(keys, rows[i][2])
            at = at[keys[np.minimum(at, len(keys) - 1)] == rows[i][2]] if len(at) else at
            out[n] = held[at].sum(axis=0) / np.sqrt(len(rows[i][2]))
        return out

    values, vectors = np.linalg.eigh(kernels(marks))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernels(list(range(len(rows)))) @ root
    targets = np.array([[r[0] == x for x in languages] for r in rows], dtype=float)
    share = targets.sum(axis=0)
    each = (1 / share)[[languages.index(r[0]) for r in rows]]  # every language weighs the same, whatever its number of texts
    ridge = np.linalg.solve((features * each[:, None]).T @ features + RIDGE * np.eye(features.shape[1]), (features * each[:, None]).T @ targets)
    return {"languages": languages, "keys": keys, "weights": (held @ (root @ ridge)).astype(np.float32)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text). Only the text decides.

    ``und`` with score 0 if the text is null or has no letter, or no language was learned. Ties go to the language first in order.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, keys, weights = (shipped.value[x] for x in ("languages", "keys", "weights"))
        for batch in batches:
            for part in text_slices(batch, "text"):
                names, scores = [], []
                texts = part.column("text").to_pylist()
                ready = [i for i, t in enumerate(texts) if languages and t and any(map(str.isalpha, t))]
                grams = [ngrams(texts[i]) for i in ready]
                result = {}
                if ready:
                    # The product of the texts' presence matrix with the weights, which have a row for each n-gram.
                    flat = np.concatenate(grams)
                    at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                    hit = keys[at] == flat
                    sizes = np.array([len(g) for g in grams])
                    owner = np.repeat(np.arange(len(ready)), sizes)[hit]
                    total = np.zeros((len(ready), len(languages)))
                    begun = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
                    if len(begun):
                        total[owner[begun]] = np.add.reduceat(weights[at[hit]], begun, axis=0, dtype=np.float64)
                    total /= np.sqrt(sizes)[:, None]
                    top = total.argmax(axis=1)
                    result = {i: (languages[t], float(min(1.0, max(0.0, total[n, t])))) for n, (i, t) in enumerate(zip(ready, top, strict=True))}
                for i in range(len(texts)):
                    name, value = result.get(i, ("und", 0.0))
                    names.append(name)
                    scores.append(value)
                yield pa.record_batch([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """If a document is kept from training: crc32 of its id as text leaves 2 when divided by 4; a null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang); learned from those not held out.

    One row per input row, repeated rows included; an empty table gives an empty result; other columns are ignored.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
