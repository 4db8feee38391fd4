"""Deterministic text vectors, computed batch by batch next to the data."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .text import ascii_lower

#: Tokens worked on at a time; bounds the scratch arrays of a batch.
_BLOCK_TOKENS = 500_000


def tokens_of(text: Column) -> Column:
    """Maximal runs of letters and digits (Unicode), A-Z lower-cased."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+")


def _token_table(words: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and signed weights (8 each) of distinct tokens."""
    encoded = [w.encode("utf-8") for w in words]
    digests = np.frombuffer(b"".join(hashlib.sha256(e).digest() for e in encoded), np.uint8).reshape(-1, 8, 4)
    slots = (digests[:, :, 0].astype(np.int64) + 256 * digests[:, :, 1].astype(np.int64)) % dims
    # an empty string is what splitting leaves at the edges, not a token
    weights = np.array([1.0 + math.log(len(e)) if e else 0.0 for e in encoded])
    return slots, np.where(digests[:, :, 2] & 1, -1.0, 1.0) * weights[:, None]


def _embed_block(flat: pa.Array, lengths: np.ndarray, dims: int) -> np.ndarray:
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    slots, values = _token_table(words, dims)
    index = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    cells = (row[:, None] * dims + slots[index]).ravel()
    grid = np.bincount(cells, values[index].ravel(), len(lengths) * dims).reshape(-1, dims)
    real = np.array([bool(w) for w in words], dtype=bool)[index]
    seen = np.bincount(row, real, len(lengths)) > 0
    norm = np.sqrt((grid * grid).sum(axis=1))
    grid /= np.where(norm > 0, norm, 1.0)[:, None]
    grid[~seen] = 0.0
    grid[~seen, 0] = 1.0
    return grid


def _embed_batch(tokens: pa.Array, dims: int) -> pa.Array:
    lengths = np.diff(tokens.offsets.to_numpy())
    flat = tokens.flatten()
    blocks, start, used = [], 0, 0
    while start < len(lengths):
        stop, count = start + 1, int(lengths[start])
        while stop < len(lengths) and count + lengths[stop] <= _BLOCK_TOKENS:
            count += int(lengths[stop])
            stop += 1
        blocks.append(_embed_block(flat.slice(used, count), lengths[start:stop], dims))
        start, used = stop, used + count
    values = np.concatenate(blocks) if blocks else np.zeros((0, dims))
    offsets = np.arange(0, (len(lengths) + 1) * dims, dims, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def hash_vector(text: Column, dims: int) -> Column:
    """Unit vector (array<double>) of a text.

    Every token adds its weight 1 + ln(bytes), with a sign, to eight slots read from
    its SHA-256; a text without tokens is the first unit vector. Tokens are cut in
    the JVM; the Arrow batch then hashes each distinct token once and scatters all
    rows in one step. Nothing is shuffled, so a frequent token is nobody's key.
    """

    def embed(tokens: pa.Array) -> pa.Array:
        return _embed_batch(tokens, dims)

    embed.__annotations__ = {"tokens": pa.Array, "return": pa.Array}
    # declared non-deterministic so that no filter derived from the result makes the
    # optimizer compute it a second time (explode and join conditions would)
    return F.arrow_udf(embed, "array<double>").asNondeterministic()(tokens_of(text))
