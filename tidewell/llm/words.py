"""Words of many texts as 64-bit hashes, by numpy over the bytes of a slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.cumprod(np.full(256, _STEP, np.uint64))

#: White space between words, and bytes of words when punctuation also separates them.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_IS_MARK = np.array([not (chr(b).isalnum() or b >= 128) if b < 128 else False for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power(n: np.ndarray) -> np.ndarray:
    """_STEP to the n+1 by two table look-ups for n under 65536, by squaring beyond."""
    low = _POWERS[n & 255]
    high = n >> 8
    if high.any():
        base, out, k = _POWERS[255], np.ones(len(n), np.uint64), high.copy()
        while k.any():
            out = np.where(k & 1, out * base, out)
            with np.errstate(over="ignore"):
                base, k = base * base, k >> 1
        low = low * out
    return low


def word_hashes(texts: pa.Array, punctuation_separates: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words begin (one place more than texts).

    A-Z count as a-z. Null texts have no words. With punctuation_separates, words are runs of ASCII letters and
    digits and of bytes of other characters; else they are runs of anything but the six ASCII spaces.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    ends = np.cumsum(sizes)
    # a separator between texts, so that no word crosses from one to the next
    data = np.insert(raw, ends[:-1], np.uint8(32)) if n > 1 else raw
    inside = ~(_IS_MARK if punctuation_separates else _IS_SPACE)[data]
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    first, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    length = stop - first
    letters = _LOWER[data[inside]]
    begin = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(begin, length)
    value = np.add.reduceat(_BYTE[letters] * power(place), begin)
    text_first = np.concatenate([[0], ends[:-1] + np.arange(1, n)])
    at = np.concatenate([np.searchsorted(first, text_first), [len(first)]])
    return mix(value + length.astype(np.uint64)), at


def combine(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """For each place i, a hash of the words at i + offsets, in order; as many as fit."""
    count = len(hashes) - offsets[-1]
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k, o in enumerate(offsets):
        out = out * _STEP + mix(hashes[o : o + count] + np.uint64(k))
    return mix(out + np.uint64(len(offsets)))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles of one text's words, ascending; fewer words than size are one shingle, none have none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(combine(hashes, tuple(range(min(size, len(hashes))))))
