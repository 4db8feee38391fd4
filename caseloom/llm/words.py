"""Word and shingle hashes of whole Arrow batches, without a Python loop over words.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters;
callers lower-case texts in the JVM first. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import byte_view

#: Words in a shingle.
SHINGLE = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(6364136223846793005)
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    text = np.zeros(256, bool)
    text[128:] = True
    for low, high in ((48, 57), (65, 90), (97, 122)):
        text[low : high + 1] = True
    values[~text] = 0
    return values


_VALUES = _byte_values()
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, _BLOCK + 64)
        inverse = np.uint64(pow(int(_POWER), -1, 1 << 64))
        for name, base in (("up", _POWER), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _mark_values() -> np.ndarray:
    values = mix(np.arange(1001, 1257, dtype=np.uint64) * _STEP)
    values[_VALUES != 0] = 0
    values[:33] = values[127] = 0
    return values


#: For :func:`word_hashes`: runs of ASCII punctuation instead of words.
MARKS = _mark_values()


def _hash_block(data: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words in ``data``; a word never spans a break."""
    values = table[data]
    inside = values != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    begins[cut] |= inside[cut]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _power_tables(len(data))
    values *= up[: len(data)]
    total = np.cumsum(values)
    # non-word bytes count 0, so a word's sum may run up to the next word's start
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    after = np.append(before[1:], total[-1])
    return mix((after - before) * down[starts]), starts


def word_hashes(texts: pa.Array, table: np.ndarray = _VALUES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for every text where its words begin (one entry more than texts)."""
    data, offsets = byte_view(texts)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        while end < len(data) and table[data[end]] and table[data[end - 1]]:
            end += 1  # a block ends between words
        low, high = np.searchsorted(offsets, at), np.searchsorted(offsets, end, side="right")
        found, where = _hash_block(data[at:end], offsets[low:high] - at, table)
        hashes.append(found)
        starts.append(where + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def piece_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of all bytes of every piece; ``bounds`` ascend and end with the end of the data."""
    table = mix(np.arange(2001, 2257, dtype=np.uint64) * _STEP)
    out, first = np.zeros(len(bounds) - 1, np.uint64), 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _BLOCK, side="right")) - 1)
        start = bounds[first]
        values = table[data[start : bounds[last]]]
        up, down = _power_tables(len(values))
        values *= up[: len(values)]
        total = np.concatenate([[np.uint64(0)], np.cumsum(values)])
        at = bounds[first : last + 1] - start
        sums = np.diff(total[at]) * down[at[:-1]]
        out[first:last] = mix(sums + np.diff(at).astype(np.uint64) * _STEP)
        first = last
    return out


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words, and where each text's runs begin.

    A text of one to ``size`` - 1 words has one shingle: all its words.
    """
    counts = np.diff(rows)
    full = np.maximum(counts - size + 1, 0)
    short = (counts > 0) & (full == 0)
    begins = np.concatenate([[0], np.cumsum(full + short)])
    out = np.zeros(begins[-1], np.uint64)
    if full.any():
        runs = words[: len(words) - size + 1].copy()
        for j in range(1, size):
            runs *= _POWER
            runs += words[j : len(words) - size + 1 + j]
        doc = np.repeat(np.arange(len(counts)), full)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
        out[begins[doc] + nth] = mix(runs[rows[doc] + nth])
    for d in np.flatnonzero(short):
        value = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for w in words[rows[d] : rows[d + 1]]:
                value = value * _STEP + w
        out[begins[d]] = mix(np.array([value]))[0]
    return out, begins
