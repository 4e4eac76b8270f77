"""Word and shingle hashes of whole Arrow batches, in numpy and without Python objects per word.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``. A word's hash is a polynomial over its bytes
(mod 2**64, through a table of random byte values), taken from prefix sums, so the work per byte is
a few vector operations. Text is hashed in segments that end between words: memory stays a small
multiple of SEGMENT bytes plus 24 bytes per word, however long a text is.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
_MASK = (1 << 64) - 1
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse mod 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = np.random.default_rng(20240607).integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
    return values, values[_FOLD]


_powers_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse (kept for ordinary segment sizes only)."""
    size = max(n + 1, SEGMENT * 2)
    if size not in _powers_cache:

        def running(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        made = running(_MULTIPLIER), running(pow(_MULTIPLIER, -1, 1 << 64))
        if size > SEGMENT * 2:
            return made
        _powers_cache[size] = made
    return _powers_cache[size]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: spreads a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def _cuts(raw: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Segments that end at a space (or the end of the data)."""
    start, n = 0, len(raw)
    while start < n:
        end = min(start + SEGMENT, n)
        if end < n:
            while end < n:  # to the next space
                found = np.flatnonzero(space[end : end + SEGMENT])
                if len(found):
                    end += int(found[0])
                    break
                end = min(end + SEGMENT, n)
        yield start, end
        start = end


def words(raw: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word; a text boundary ends a word. ``fold`` lower-cases A-Z."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    values = _tables()[1 if fold else 0]
    space = _SPACE[raw]
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= space[1:]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    for a, b in _cuts(raw, space):
        lo, hi = np.searchsorted(starts, [a, b])
        if lo == hi:
            continue
        power, inverse = _powers(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[raw[a:b]] * power[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        hashes[lo:hi] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
    return starts, ends, hashes


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each word on, for all words that have k - 1 after them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its k-word shingles (A-Z lower-cased).

    A text of fewer than ``k`` words has its whole word sequence as its one shingle; a null, an empty
    text and a text without words have none.
    """
    raw, offsets = text_buffers(texts)
    starts, _, hashes = words(raw, offsets, fold=True)
    bounds = np.searchsorted(starts, offsets)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b == a:
            yield np.zeros(0, np.uint64)
        else:
            yield np.unique(windows(hashes[a:b], min(k, int(b - a))))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes of ``column`` each (one row at least)."""
    _, offsets = text_buffers(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end
