"""Secret scans: fixed patterns, and the guess cost of values in a credential context.

The guess cost of a value is that of its cheapest segmentation into words, dates, repeats, keyboard walks and spans to be guessed by
brute force: the sum of the segments' log10 guesses and of NEXT for each segment after the first, by dynamic programming over the end.
Words are frequent words of passwords and the LEARNED most frequent words of all texts, each at its rank; values in a credential context
don't count as words. A value costing LEAST_GUESSES or more is a secret of kind ``guess``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, text_slices

#: Kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value in a credential context is a secret.
LEAST_GUESSES = 10.0
#: log10 of the guesses at where the next segment starts and what kind it is.
NEXT = 0.6
#: So many of the corpus' words are known, the most frequent first; it bounds their broadcast. A word has 3 to LONGEST letters.
LEARNED, LONGEST = 40_000, 20
#: Words seen less often in all texts aren't learned.
LEAST_SEEN = 3
#: Different words that a task counts before it hands them on.
HELD = 100_000
#: Repeated units of up to so many characters are looked for.
UNIT = 8

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Where a value follows: a credential's name, then a sign or the word "is". A quoted value goes to its closing quote, another to white space.
_CONTEXT = re.compile(
    r"""([?&])?(?:(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth|bearer|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret)s?)["'\]]?(?:\x20*(?::=|=>|[:=])|\x20+is)\x20*(?:"([^"\n]{6,})"|'([^'\n]{6,})'|`([^`\n]{6,})`|["'`]?(\S{6,}))""",
    re.ASCII | re.IGNORECASE,
)
_NAMES = ("pass", "pwd", "pin", "secret", "token", "credential", "auth", "bearer", "key")

# Frequent words of passwords, the most frequent first.
WORDS = (
    "password pass admin user login root guest test demo hello welcome letmein master secret default dragon monkey shadow sunshine princess football baseball superman "
    "batman iloveyou love star flower summer winter spring autumn january february march april may june july august september october november december monday friday "
    "sunday computer internet server system network token access key example sample change changeme temp temporary public private service account database data dev "
    "prod stage local host name word the and for you are not with this that from have one two three four five six seven eight nine ten red green blue black white "
    "silver gold orange yellow apple google house home family mother father michael jennifer jordan thomas robert daniel charlie hunter soccer hockey killer pepper "
    "ginger cookie banana cheese coffee chocolate purple tiger lion eagle phoenix matrix freedom forever nothing something whatever money magic"
).split()
# Rows of the usual keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_LETTERS = re.compile(r"[^\W\d_]+")
_LEET = str.maketrans("4@301!$57", "aaeoiisst")
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_PLACE = {c: (x + y / 2, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d)")


def _alphabet(text: str) -> int:
    """The characters that brute force must try: those of the kinds that occur."""
    size = 0
    size += 10 * any("0" <= c <= "9" for c in text)
    size += 26 * any("a" <= c <= "z" for c in text)
    size += 26 * any("A" <= c <= "Z" for c in text)
    size += 33 * any(c.isascii() and not c.isalnum() for c in text)
    size += 100 * any(not c.isascii() for c in text)
    return max(size, 1)


def _word_cost(text: str, rank: int, tax: int) -> float:
    upper, n = sum(c.isupper() for c in text), len(text)
    case = 1 if not upper else 2 if upper in (1, n) else min(2**n, math.comb(n, upper) * 2)
    return math.log10(rank * tax * case + 1)


class _Segments:
    """The segments of a text but for brute force, by their start: words, dates, repeats, keyboard walks and rows of characters.

    Of a run (a repeat, a walk, a row) those segments count that begin or end where the run does, so that there are as many as the text
    has characters.
    """

    def __init__(self, text: str, ranks: dict[str, int]) -> None:
        self.text, self.ranks = text, ranks
        low = text.lower()
        self.low = low if len(low) == len(text) else text
        self.plain = self.low.translate(_LEET)
        self.runs: dict[object, tuple[int, int]] = {}

    def _run(self, kind: object, i: int, goes) -> tuple[int, int]:
        """Start and end of the run of ``kind`` that holds character ``i``; ``goes(j)``: character j follows j - 1 in the run."""
        start, end = self.runs.get(kind, (0, 0))
        if i >= end:
            start, end = i, i + 1
            while end < len(self.text) and goes(end):
                end += 1
            self.runs[kind] = start, end
        return start, end

    def at(self, i: int) -> Iterator[tuple[int, float]]:
        """(end, log10 guesses) of the segments that start at ``i``."""
        text, low, n = self.text, self.low, len(self.text)
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            for form, tax in ((low, 1), (self.plain, 4)):
                for word, back in ((form[i:j], 1), (form[i:j][::-1], 2)):
                    if rank := self.ranks.get(word):
                        yield j, _word_cost(text[i:j], rank, tax * back)
        if (m := _DATE.match(text, i)) and m.end() - i >= 4:
            yield m.end(), math.log10(120 if m.end() - i == 4 else 365 * 120 * (4 if not m[0].isdigit() else 1))

        def ends(start: int, end: int, least: int) -> Iterator[int]:
            yield from ([end] if i > start else range(i + least, end + 1)) if end - i >= least else []

        for unit in range(1, UNIT + 1):
            start, end = self._repeat(unit, i)
            for j in ends(start, end, max(3, 2 * unit)):
                yield j, unit * math.log10(_alphabet(text[i : i + unit])) + math.log10(j - i)

        def near(j: int) -> bool:
            a, b = _PLACE.get(low[j - 1]), _PLACE.get(low[j])
            return bool(a and b and a != b and abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1)

        start, end = self._run("walk", i, near)
        turns, last, counted = 0, None, i + 1
        for j in ends(start, end, 3):
            while counted < j:
                a, b = _PLACE[low[counted - 1]], _PLACE[low[counted]]
                turns, last, counted = turns + ((b[0] - a[0], b[1] - a[1]) != last), (b[0] - a[0], b[1] - a[1]), counted + 1
            yield j, math.log10(len(_PLACE) * (j - i)) + turns * math.log10(4.6)
        for step in (1, -1):
            start, end = self._run(("row", step), i, lambda j, s=step: text[j].isalnum() and ord(text[j]) - ord(text[j - 1]) == s)
            for j in ends(start, end, 3):
                yield j, math.log10(26 * (j - i) * (1 if step > 0 else 2))

    def _repeat(self, unit: int, i: int) -> tuple[int, int]:
        """The longest stretch from ``i``, or from before it, in which every character equals the one ``unit`` before."""
        start, end = self.runs.get(unit, (0, 0))
        if i + 2 * unit > end:
            start, end = i, min(i + unit, len(self.text))
            while end < len(self.text) and self.text[end] == self.text[end - unit]:
                end += 1
            self.runs[unit] = start, end
        return start, end


def guess_cost(text: str, ranks: dict[str, int] = _RANK, enough: float = math.inf) -> float:
    """log10 of the guesses that find ``text``, by the cheapest segmentation; from ``enough`` on, some value of that or more. Empty: 0."""
    if not text:
        return 0.0
    n, single = len(text), math.log10(_alphabet(text))
    known = _Segments(text, ranks)
    # The least cost of the first j characters whose last segment is known, and of those whose last goes on by brute force.
    best, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)
    best[0], reach = 0.0, 0
    for i in range(n):
        here = min(best[i], brute[i])
        if here >= enough:
            if i >= reach:
                return here  # whatever comes costs no less
            continue
        paid = here + (NEXT if i else 0.0)
        on = min(paid, brute[i]) + single
        if on < brute[i + 1]:
            brute[i + 1] = on
        for j, cost in known.at(i):
            if paid + cost < best[j]:
                best[j] = paid + cost
                if best[j] < enough:
                    reach = max(reach, j)
        if on < enough:
            reach = max(reach, i + 1)
    return min(best[n], brute[n])


def _values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values in a credential context; an unquoted value leaves out marks at its end, and in a query what follows &."""
    for m in _CONTEXT.finditer(text):
        group = m.lastindex or 5
        start, end = m.span(group)
        if group == 5:
            value = m[5]
            if m[1]:
                value = re.split("[&#]", value, maxsplit=1)[0]
            end = start + len(value.rstrip(".,;:!?\"'`)]}>"))
        if end - start >= 6:
            yield start, end


def scan(text: str | None, ranks: dict[str, int] = _RANK) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets of a text in code points, by start, then kind. Null counts as empty."""
    if not text:
        return []
    found = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        found += [("guess", a, b) for a, b in _values(text) if guess_cost(text[a:b], ranks, LEAST_GUESSES) >= LEAST_GUESSES]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def learned_words(docs: DataFrame) -> dict[str, int]:
    """The words of all texts by rank, the most frequent first, at most LEARNED, with the frequent words of passwords at their own ranks.

    Of equally frequent words, the first in order. A null text has no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            words = {w: n for w, n in seen.items() if 3 <= len(w) <= LONGEST}
            seen.clear()
            return pa.record_batch([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in text_slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    low = text.lower() if text else ""
                    if any(name in low for name in _NAMES):
                        for a, b in reversed([*_values(low)]):
                            low = low[:a] + " " + low[b:]
                    seen.update(_LETTERS.findall(low))
                if len(seen) > HELD:
                    yield told()
        yield told()

    words = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = cut(words.where(F.col("n") >= LEAST_SEEN))
    # Words by the logarithm of their number: those above the level at which there are too many come to the driver.
    level = F.floor(F.log2("n") * 64).alias("level")
    from_, held = 0, 0
    for row in words.groupBy(level).count().orderBy(F.desc("level")).collect():  # at most 64 for each doubling of the largest number
        held += row["count"]
        from_ = row["level"]
        if held > LEARNED:
            from_ += 1
            break
    top = sorted(words.where(level >= from_).collect(), key=lambda r: (-r["n"], r["word"]))
    ranks = {r["word"]: i + 1 for i, r in enumerate(top)}
    return ranks | {w: min(r, ranks.get(w, r)) for w, r in _RANK.items()}


def redact(text: str | None, ranks: dict[str, int] = _RANK, mark: str = "[SECRET]") -> str | None:
    """``text`` with every secret replaced by ``mark``; spans that overlap become one. Null stays null."""
    if not text:
        return text
    out, at = [], 0
    for _, start, end in scan(text, ranks):
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """The secrets of every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 (of the spans of the first three kinds), spans: one row per input
    row, repeated rows included. A null or empty text has none. An empty table gives an empty result; other columns are ignored.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(learned_words(docs))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                spans = [scan(t, ranks.value) for t in part.column("text").to_pylist()]
                counts = [pa.array([sum(s[0] == kind for s in x) for x in spans], pa.int64()) for kind in KINDS]
                digests = [hashlib.sha256(_listed([s for s in x if s[0] != "guess"]).encode()).hexdigest() for x in spans]
                yield pa.record_batch([part.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([_listed(x) for x in spans], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, schema)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by a mark; all rows and other columns stay as they are.

    A null text stays null; an empty table gives an empty result. Words are learned from ``text_col``.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(learned_words(docs.select(docs[text_col].alias("text"))))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, part.schema.field(at), pa.array([redact(t, ranks.value) for t in part.column(at).to_pylist()], part.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
