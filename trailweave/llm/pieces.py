"""SentencePiece encoding and decoding by the n best segmentations.

The pieces of a model that match a text span a lattice. Forward Viterbi gives the best score up to every position; searching backward
from the end, that score is what the rest will cost exactly, so A-star finds segmentations in order of their scores. No piece of a model
that splits at white space goes from one word into the next, so a text's lattice is a chain of words' lattices. Forward scores are
computed for all new words of a batch at once and remembered; they tell what leaving the best costs in each word, and A-star is run on
the words in which a text's n best leave it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import mix64, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What a character costs that no piece holds, below the least score of a piece.
UNKNOWN_PENALTY = 10.0
#: Words remembered by a worker; then it starts afresh.
REMEMBERED = 500_000
#: Words remembered with what is next to their best.
LEFT = 20_000
#: Longer words aren't remembered.
REMEMBERED_WORD = 256
#: Words of up to so many characters are searched many at once.
LONG_WORD = 48
#: Segmentations asked for.
BEST = 2

_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@dataclass
class Pieces:
    """A model's pieces: ``known`` {piece: (id, score)}, ``texts`` by id, ``byte_ids`` of the 256 byte pieces (empty without)."""

    known: dict[str, tuple[int, float]]
    texts: list[str]
    byte_ids: list[int]
    unknown_id: int
    chained: bool = True  # no piece has a space after its first other character
    longest: int = 1
    unknown_score: float = 0.0
    of_byte: dict[int, int] = field(default_factory=dict)
    prefixes: frozenset[str] = frozenset()
    tables: list[tuple[np.ndarray, ...]] = field(default_factory=list)  # by length: sorted hashes of prefixes, ids and scores of those that are pieces
    remembered: dict[str, tuple[float, bytes, float]] = field(default_factory=dict)
    left: dict[tuple[str, int], list[tuple[float, bytes]]] = field(default_factory=dict)
    encoded: list[bytes] = field(default_factory=list)  # each piece's bytes, once they are asked for

    @classmethod
    def load(cls, model: bytes) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        texts = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        plain = [i for i in range(len(texts)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        by_text = {t: i for i, t in enumerate(texts) if sp.is_byte(i)}
        byte_ids = [by_text[f"<0x{b:02X}>"] for b in range(256)] if len(by_text) == 256 else []
        return cls.of({texts[i]: (i, float(sp.get_score(i))) for i in plain}, texts, byte_ids, sp.unk_id())

    @classmethod
    def of(cls, known: dict[str, tuple[int, float]], texts: list[str], byte_ids: list[int], unknown_id: int) -> Pieces:
        chained = all(SPACE not in t.lstrip(SPACE) for t in known)
        longest = max(map(len, known), default=1)
        least = min((s for _, s in known.values() if s > -1e8), default=0.0)
        prefixes = frozenset(t[:k] for t in known for k in range(1, len(t) + 1))
        return cls(known, texts, byte_ids, unknown_id, chained, longest, least - UNKNOWN_PENALTY, {i: b for b, i in enumerate(byte_ids)}, prefixes, _tables(known, prefixes, longest))

    def _ends(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each position, the (start, score, ids) of the lattice's edges that end there."""
        n, known, prefixes = len(text), self.known, self.prefixes
        ends: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                part = text[i:j]
                if part not in prefixes:
                    break
                if found := known.get(part):
                    ends[j].append((i, found[1], (found[0],)))
            if text[i] not in known:
                ends[i + 1].append((i, self.unknown_score, self._unknown(text[i])))
        return ends

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The (score, ids) of the ``n`` best segmentations of a string of pieces' characters, best first; fewer if there are no more.

        Of equal scores, those found first, which a run always repeats. A step of the search puts two states on the heap: the best
        edge into its position, and the next best one in place of the edge that it came by.
        """
        ends = self._ends(text)
        best = [0.0] * (len(text) + 1)
        for j in range(1, len(text) + 1):
            best[j] = max([best[i] + score for i, score, _ in ends[j]])
        ordered: list[list[tuple] | None] = [None] * (len(text) + 1)

        def ways(at: int) -> list[tuple]:
            found = ordered[at]
            if found is None:
                found = ordered[at] = sorted([(-best[i] - score, i, score, ids) for i, score, ids in ends[at]])
            return found

        out: list[tuple[float, tuple[int, ...]]] = []
        turn = 0
        # (minus the best score of a whole segmentation by this edge, turn, position, rank of the edge into it, score so far, chain of ids)
        heap: list[tuple] = [(-best[-1], 0, len(text), 0, 0.0, None)]
        while heap and len(out) < n:
            _, _, at, rank, so_far, chain = heapq.heappop(heap)
            edges = ways(at)
            turn -= 2  # of equal scores the latest state first: it is nearest to a whole segmentation
            if rank + 1 < len(edges):
                heapq.heappush(heap, (edges[rank + 1][0] - so_far, turn, at, rank + 1, so_far, chain))
            _, start, score, ids = edges[rank]
            so_far, chain = so_far + score, (ids, chain)
            if start:
                heapq.heappush(heap, (-best[start] - so_far, turn - 1, start, 0, so_far, chain))
                continue
            path: list[int] = []
            while chain:
                path += chain[0]
                chain = chain[1]
            out.append((so_far, tuple(path)))
        return out

    def word(self, word: str) -> tuple[float, bytes, float]:
        """Score and ids (as bytes of 32-bit numbers) of a word's best segmentation, and what the next best costs more; remembered."""
        found = self.remembered.get(word)
        if found is None:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            best = self.n_best(word, 2)
            found = (best[0][0], array("i", best[0][1]).tobytes(), best[0][0] - best[1][0] if len(best) > 1 else inf)
            if len(word) <= REMEMBERED_WORD:
                self.remembered[word] = found
        return found

    def _split(self, text: str) -> list[str]:
        marked = SPACE + text.replace(" ", SPACE)
        return _WORD.findall(marked) if self.chained else [marked]

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The words of each of ``texts`` (none of a null one). All that aren't yet are remembered, those of up to LONG_WORD characters all at once."""
        words = [self._split(t) if t else [] for t in texts]
        if not self.chained:
            return words
        every = set(chain.from_iterable(words))
        new = every.difference(self.remembered)  # goes over the words at hand; a difference with keys() goes over all remembered ones
        if len(self.remembered) + len(new) > REMEMBERED:
            self.remembered.clear()
            new = every
        short = [w for w in new if len(w) <= LONG_WORD]
        for start in range(0, len(short), 20_000):
            some = short[start : start + 20_000]
            self.remembered.update(zip(some, self.viterbi(some), strict=True))
        return words

    def forget(self) -> None:
        self.remembered.clear()
        self.left.clear()

    def viterbi(self, words: list[str]) -> list[tuple[float, bytes, float]]:
        """``word`` of many words at once: forward scores and, for what the next best costs, backward ones, by array operations.

        A segmentation but the best holds an edge off the best path, and the best through an edge costs what forward and backward
        scores at its ends say.
        """
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), lengths)
        first = np.cumsum(lengths) - lengths
        stop = (first + lengths)[owner]
        # Nodes of a word are its positions and its end: position p of word w is node p + w.
        at, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
        src, dst, ids, scores = [], [], [], []
        for length, (keys, piece, score) in enumerate(self.tables, 1):
            inside = at + length <= stop[at]
            at, h = at[inside], _extend(h[inside], codes[at[inside] + length - 1])
            if not len(at):
                break
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            on = keys[k] == h
            hit = on & (piece[k] >= 0)
            if length == 1:
                miss = at[~hit]
                src.append(miss + owner[miss])
                dst.append(src[-1] + 1)
                ids.append(-1 - codes[miss].astype(np.int64))
                scores.append(np.full(len(miss), self.unknown_score))
            src.append(at[hit] + owner[at[hit]])
            dst.append(src[-1] + length)
            ids.append(piece[k[hit]])
            scores.append(score[k[hit]])
            at, h = at[on], h[on]
        src, dst, ids, scores = (np.concatenate(x) for x in (src, dst, ids, scores))
        node_owner = np.repeat(np.arange(len(words)), lengths + 1)
        start = first + np.arange(len(words))
        last = start + lengths
        forward, back = np.full(len(node_owner), -np.inf), np.full(len(node_owner), -np.inf)
        forward[start], back[last] = 0.0, 0.0
        enters = np.full(len(node_owner), -1)
        place = dst - start[node_owner[dst]]
        order = np.lexsort((src, dst, place))
        bounds = np.searchsorted(place[order], np.arange(1, int(lengths.max()) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            e = order[a:b]
            total = forward[src[e]] + scores[e]
            heads = np.flatnonzero(np.r_[True, dst[e][1:] != dst[e][:-1]])
            top = np.maximum.reduceat(total, heads)
            forward[dst[e][heads]] = top
            # The first edge that reaches the top: of equal ones, that of the earliest start.
            best = np.flatnonzero(total == np.repeat(top, np.diff(np.r_[heads, len(e)])))
            unique = best[np.r_[True, dst[e][best][1:] != dst[e][best][:-1]]]
            enters[dst[e][unique]] = e[unique]
        place = last[node_owner[src]] - src
        order = np.lexsort((src, place))
        bounds = np.searchsorted(place[order], np.arange(1, int(lengths.max()) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            e = order[a:b]
            heads = np.flatnonzero(np.r_[True, src[e][1:] != src[e][:-1]])
            back[src[e][heads]] = np.maximum.reduceat(back[dst[e]] + scores[e], heads)
        # The best paths, backward, all words a step at a time.
        on_path = np.zeros(len(src), dtype=bool)
        here, who = last.copy(), np.arange(len(words))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(here):
            e = enters[here]
            on_path[e] = True
            steps.append((who, e))
            here = src[e]
            going = here > start[who]
            here, who = here[going], who[going]
        through = np.where(on_path, -np.inf, forward[src] + scores + back[dst])
        second = np.full(len(words), -np.inf)
        np.maximum.at(second, node_owner[src], through)
        top = forward[last]
        whose = np.concatenate([w for w, _ in steps])
        path = ids[np.concatenate([e for _, e in steps])]
        turn = np.repeat(np.arange(len(steps)), [len(w) for w, _ in steps])
        order = np.lexsort((-turn, whose))
        path, sizes = path[order], np.bincount(whose, minlength=len(words))
        cuts = np.r_[0, np.cumsum(sizes)]
        plain, unknown = path.astype(np.int32).tobytes(), np.flatnonzero(path < 0)
        odd = set(np.searchsorted(cuts, unknown, side="right") - 1)
        out = []
        for w in range(len(words)):
            packed = plain[4 * cuts[w] : 4 * cuts[w + 1]]
            if w in odd:
                each = [[i] if i >= 0 else self._unknown(chr(-1 - i)) for i in path[cuts[w] : cuts[w + 1]].tolist()]
                packed = array("i", [i for x in each for i in x]).tobytes()
            out.append((float(top[w]), packed, float(top[w] - second[w])))
        return out

    def _unknown(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")) if self.byte_ids else (self.unknown_id,)

    def encode(self, text: str, n: int = BEST, words: list[str] | None = None) -> list[tuple[float, bytes]]:
        """The (score, ids as bytes of 32-bit numbers) of the ``n`` best segmentations of a text, whose ``words`` may be known; none of an empty text."""
        if not text:
            return []
        words = words or self._split(text)
        found = list(map(self.remembered.get, words))
        if None in found:
            found = [f or self.word(w) for f, w in zip(found, words, strict=True)]
        scores, paths, costs = zip(*found, strict=True)
        top, ids = sum(scores), list(paths)
        out = [(top, b"".join(ids))]
        if n > 1:
            # A segmentation among the n best leaves the best only in words whose next best is among the n - 1 that cost least.
            where = [costs.index(min(costs))] if n == 2 else sorted(heapq.nsmallest(n - 1, range(len(costs)), key=costs.__getitem__))
            heads: list[tuple[float, dict[int, bytes]]] = [(0.0, {})]
            for k in where:
                options = [(found[k][0] - score, {k: path}) for score, path in self._others(words[k], n)]
                heads = heapq.nsmallest(n, heads + [(cost + more, change | other) for cost, change in heads for more, other in options], key=lambda o: o[0])
            for cost, change in heads[1:n]:
                for k, path in change.items():
                    ids[k] = path
                out.append((top - cost, b"".join(ids)))
                for k in change:
                    ids[k] = found[k][1]
        return out

    def _others(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """The (score, ids as bytes) of a word's ``n`` best segmentations but the first; remembered, as the same words cost least in many texts."""
        found = self.left.get((word, n))
        if found is None:
            if len(self.left) >= LEFT:
                self.left.clear()
            found = [(score, array("i", path).tobytes()) for score, path in self.n_best(word, n)[1:]]
            if len(word) <= LONG_WORD:
                self.left[word, n] = found
        return found

    def decode(self, ids: bytes | list[int]) -> str:
        """The text of ids; the inverse of ``encode`` for texts without the mark that stands for a space."""
        ids = np.frombuffer(ids, dtype=np.int32).tolist() if isinstance(ids, bytes) else ids
        if not self.encoded:
            self.encoded[:] = [bytes([self.of_byte[i]]) if i in self.of_byte else t.encode("utf-8", "surrogatepass") for i, t in enumerate(self.texts)]
        text = b"".join(map(self.encoded.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix64(h * np.uint64(0x9E3779B97F4A7C15) + code + np.uint64(1))


def _hashes(texts: list[str], length: int) -> np.ndarray:
    h = np.zeros(len(texts), dtype=np.uint64)
    for k in range(length):
        h = _extend(h, np.array([ord(t[k]) for t in texts], dtype=np.uint64))
    return h


def _tables(known: dict[str, tuple[int, float]], prefixes: frozenset[str], longest: int) -> list[tuple[np.ndarray, ...]]:
    """By length: the sorted hashes of all prefixes of pieces, and of those that are pieces the id (else -1) and the score."""
    out = []
    for length in range(1, longest + 1):
        some = [t for t in prefixes if len(t) == length] or ["\0" * length]  # no piece at all
        keys = _hashes(some, length)
        order = np.argsort(keys)
        ids, scores = (np.array([known.get(t, (-1, 0.0))[i] for t in some], dtype=kind)[order] for i, kind in ((0, np.int64), (1, np.float64)))
        out.append((keys[order], ids, scores))
    return out


_loaded: dict[bytes, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces.load(model)
    return _loaded[key]


_BEST = ArrayType(StructType().add("score", "double").add("ids", "binary"))


def n_best(docs: DataFrame, n: int = BEST, model_path: str = MODEL, check: bool = False) -> DataFrame:
    """``docs`` (text and more) with ``best`` in place of ``text``: the ``n`` best segmentations of every whole text, best first.

    Each is (score, ids), ids as 32-bit little-endian numbers; there are fewer where a text has fewer. With ``check``, ``round_trip``
    tells if decoding each of them gives the text back. An empty text has none; a null one has null in both columns. Rows stay as they
    are, repeated ones included; an empty table gives an empty result. Columns must not be called ``best`` or ``round_trip``.
    """
    rest = [c for c in docs.columns if c != "text"]
    with open(model_path, "rb") as f:  # a tokenizer's file, which is installed with the driver; tasks get its bytes
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shipped.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = [None if t is None else pieces.encode(t, n, w) for t, w in zip(texts, pieces.learn(texts), strict=True)]
                columns = [*(part.column(c) for c in rest), pa.array([None if x is None else [{"score": s, "ids": i} for s, i in x] for x in found], kind)]
                if check:
                    columns.append(pa.array([None if x is None else all(pieces.decode(i) == t for _, i in x) for x, t in zip(found, texts, strict=True)], pa.bool_()))
                yield pa.record_batch(columns, names=[*rest, "best", *["round_trip"] * check])

    schema = docs.select(*rest).schema.add("best", _BEST)
    return docs.mapInArrow(run, schema.add("round_trip", "boolean") if check else schema)


def ranked(docs: DataFrame, n: int = BEST, model_path: str = MODEL) -> DataFrame:
    """doc_id, rank (from 1), score, ids (array<int>): one row for each of the ``n`` best segmentations of every text of ``docs`` (doc_id, text)."""
    found = n_best(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, model_path)
    found = found.select("doc_id", F.posexplode("best").alias("at", "one"))
    return found.select("doc_id", (F.col("at") + 1).alias("rank"), F.col("one.score").alias("score"), _numbers(F.col("one.ids")).alias("ids"))


def _numbers(ids: Column) -> Column:
    """32-bit little-endian numbers as an array; every id is below 2**24."""
    digits = F.hex(ids)
    number = lambda k: F.conv(F.concat(*(F.substring(digits, k * 8 + 1 + 2 * b, 2) for b in (2, 1, 0))), 16, 10).cast("int")
    return F.when(F.length(ids) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.length(ids) / 4 - 1, F.lit(0)).cast("int")), number))


def segmentations(docs: DataFrame, model_path: str = MODEL, n: int = BEST) -> DataFrame:
    """The ``n`` best segmentations of every whole text of ``docs`` (doc_id, text), digested.

    Returns doc_id, n_pieces, best_score, second_score and second_sha256 (null if there is no other segmentation), ids_sha256 (of the best
    ids as 32-bit little-endian numbers), round_trip (does decoding give the text back?): one row per input row, repeated rows included.
    An empty text has no pieces; a null one has null in all but doc_id. An empty table gives an empty result; other columns are ignored.
    """
    found = n_best(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, model_path, check=True)
    at = lambda k, what: F.get(F.col("best"), F.lit(k))[what]
    some = F.col("best").isNotNull()
    ids = F.when(some, F.coalesce(at(0, "ids"), F.lit(b"")))
    return found.select(
        "doc_id", (F.length(ids) / 4).cast("long").alias("n_pieces"), F.when(some, F.coalesce(at(0, "score"), F.lit(0.0))).alias("best_score"), at(1, "score").alias("second_score"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2(at(1, "ids"), 256).alias("second_sha256"), "round_trip",
    )


def encoded(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, lang, source, n_pieces, ids, other_ids: the best segmentation of every text, and the second best for training on both.

    A null text has null ids; a text without another segmentation has null other_ids.
    """
    rest = ("doc_id", "lang", "source")
    with open(model_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shipped.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = [None if t is None else pieces.encode(t, 2, w) for t, w in zip(texts, pieces.learn(texts), strict=True)]
                lists = [None if x is None else np.frombuffer(x[0][1], dtype=np.int32) if x else np.zeros(0, np.int32) for x in found]
                other = [np.frombuffer(x[1][1], dtype=np.int32) if x and len(x) > 1 else None for x in found]
                n = pa.array([None if x is None else len(x) for x in lists], pa.int64())
                yield pa.record_batch([*(part.column(c) for c in rest), n, *(pa.array(x, pa.list_(pa.int32())) for x in (lists, other))], names=[*rest, "n_pieces", "ids", "other_ids"])
        pieces.forget()  # the worker may go on with another stage, beside whose memory this would count

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    return columns.mapInArrow(run, "doc_id long, lang string, source string, n_pieces long, ids array<int>, other_ids array<int>")


def decoded(encodings: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text of every row of ``encodings`` (doc_id, ids); null ids give a null text."""
    with open(model_path, "rb") as f:
        shipped = encodings.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shipped.value)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
