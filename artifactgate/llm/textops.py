"""Vectorised word splitting and hashing over Arrow string batches.

The near-duplicate, line and contamination operators all start from the same
step: split every text into words and give each word a 64-bit hash. Doing that
word by word in Python costs more than everything that follows, so the step
works on the bytes of a whole slice of texts with numpy.

Two word alphabets are defined, both on UTF-8 bytes with A-Z lower-cased:

* ``SPACED``  -- maximal runs of bytes other than space and 0x09-0x0D
* ``ALNUM``   -- maximal runs of 0-9, a-z and every byte from 0x80 up

A word's hash is a polynomial over random per-byte values modulo 2**64 that is
mixed once more at the end; it does not depend on where the word stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def _alphabet(separators: np.ndarray) -> np.ndarray:
    """Byte -> lower-cased byte, 0 for separators."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[separators] = 0
    return table


SPACED = _alphabet(np.array([0x20, *range(0x09, 0x0E)]))
#: A NUL byte is a word byte here, so it gets a stand-in that no UTF-8 text holds.
SPACED[0] = 0xFF
ALNUM = _alphabet(np.array([b for b in range(0x80) if not chr(b).isalnum()]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_POWERS: dict[int, np.ndarray] = {}


def _powers(of: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; those that a slice of texts takes are made once."""
    known = _POWERS.get(int(of))
    if known is None or len(known) < n:
        out = np.full(max(n, SLICE_BYTES + 1), of, dtype=np.uint64)
        out[0] = U(1)
        known = np.multiply.accumulate(out)
        known.flags.writeable = False
        if len(known) == SLICE_BYTES + 1:
            _POWERS[int(of)] = known
    return known[:n]


class Words(NamedTuple):
    """The words of consecutive texts.

    first: index of each text's first word, with one more entry at the end
    start, end: each word's byte range in ``data``
    hash: each word's hash
    data: the bytes of the texts; text ``i`` is ``data[at[i]:at[i + 1]]``
    """

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    at: np.ndarray


def split_words(data: np.ndarray, at: np.ndarray, alphabet: np.ndarray) -> Words:
    """Words of the texts that stand in ``data`` between the offsets ``at``."""
    low = alphabet[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = low != 0
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    # Texts stand next to each other without a separator: cut at their borders.
    border = at[1:-1]
    border = border[(border > 0) & (border < len(data))]
    joined = border[inside[border] & inside[border + 1]]
    starts[joined] = True
    ends[joined] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[low] * _powers(_BASE, len(data)), out=sums[1:])
    value = (sums[end] - sums[start]) * _powers(_INVERSE, len(data) + 1)[start]
    return Words(np.searchsorted(start, at), start, end, mix(value), data, at)


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of consecutive rows of a string column; null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def windows(word_hash: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words: one less row for each word over the first."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = word_hash[:n].copy()
    for k in range(1, width):
        out *= _BASE
        out += word_hash[k : k + n]
    return mix(out + U(width))


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct hashes of ``width`` consecutive words.

    A text of fewer words, but not none, has its whole sequence as its only one.
    """
    every = windows(words.hash, width)
    for lo, hi in zip(words.first[:-1], words.first[1:]):
        n = hi - lo
        yield np.unique(every[lo : hi - width + 1]) if n >= width else windows(words.hash[lo:hi], int(n)) if n else every[:0]
