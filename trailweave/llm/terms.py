"""Words as ids: the texts of an Arrow batch cut at bytes that aren't part of a word, and every word looked up in the batch's own dictionary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import text_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_bytes(*also: tuple[str, str]) -> np.ndarray:
    """True for the bytes of a word: lower-case ASCII letters, all beyond ASCII, and the ranges of characters in ``also``."""
    inside = np.zeros(256, dtype=bool)
    inside[0x80:] = True
    for low, high in (("a", "z"), *also):
        inside[ord(low) : ord(high) + 1] = True
    return inside


def encoded_words(texts: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words as bytes, the id of each word in order, n + 1 indexes of the texts' first words).

    Only A to Z are lower-cased, then words are maximal runs of bytes for which ``inside`` is true. In UTF-8 all bytes of a character beyond
    ASCII are 0x80 and more, so this is the same as matching characters. A null text is an empty one.
    """
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    held = inside[data]
    edge = np.ones(len(data) + 1, dtype=bool)  # a word ends with its text, too
    edge[1:-1] = held[1:] != held[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = held[at[:-1]] if len(data) else np.zeros(0, dtype=bool)
    starts, stops = at[:-1][keep], at[1:][keep]
    ends = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(stops - starts, out=ends[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[held]))])
    words = words.dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offsets)
