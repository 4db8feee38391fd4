"""Weighted MinHash signatures of shingle multisets, computed batch by batch in numpy.

A shingle that occurs w times owns the strip [0, w) of a plane (weight x time) on
which Poisson points are drawn, the same for every document that has the shingle.
Each point falls to one of the registers at random; a register keeps its earliest
point. Two documents agree in a register with probability sum(min) / sum(max) of
their weights, the weighted Jaccard similarity, without bias.

The weight axis is discretised in strips [0,1), [1,2), [2,4), [4,8) ..., one process
each; a strip that the weight cuts is halved level by level, every point going to one
half by one random bit, and points that end above the weight are left out. Points
come in ascending time, so a process ends as soon as it is later than all registers
of its document: most shingles cost one or two points.
"""

from __future__ import annotations

import numpy as np

from .words import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_DRAW = np.uint64(0xD1B54A32D192ED03)
_WIDE = 8192


def count_shingles(shingles: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Multisets: document, shingle and weight of every different shingle, and its numbered occurrences.

    The last result holds one hash per occurrence (the n-th occurrence of a shingle
    has its own), sorted by document: multiset overlap becomes set overlap.
    """
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.argsort(shingles, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16 if len(begins) <= 65536 else np.int64), kind="stable")]
    doc, shingles = doc[order], shingles[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])
    where = np.flatnonzero(first)
    weight = np.diff(np.append(where, len(doc)))
    nth = (np.arange(len(doc)) - np.repeat(where, weight)).astype(np.uint64)
    return doc[where], shingles[where], weight, np.where(nth > 0, mix(shingles + nth * _STEP), shingles)


def _strips(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray):
    """One row per (shingle, strip below its weight): document, seed, strip start and width, weight."""
    out, level, low = [], 0, 0
    live = np.arange(len(doc))
    while len(live):
        width = 1 if level == 0 else low
        seed = mix(shingle[live] + np.uint64(level * int(_DRAW) & (2**64 - 1)))
        out.append((doc[live], seed, np.full(len(live), low), np.full(len(live), width), weight[live]))
        low, level = low + width, level + 1
        live = live[weight[live] > low]
    return [np.concatenate(parts) for parts in zip(*out, strict=True)] if out else None


def signatures(
    doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, documents: int, registers: int
) -> np.ndarray:
    """Registers (uint64, documents x registers) of the multisets; documents without shingles get zeros."""
    best = np.full(documents * registers, np.inf)
    procs = _strips(doc, shingle, weight)
    if procs is not None:
        _draw(best, *procs, documents, registers)
    found = np.isfinite(best)
    bits = best.view(np.uint64).copy()
    bits[~found] = 0
    return np.where(found, mix(bits), bits).reshape(documents, registers)


def _draw(best, doc, seed, low, width, weight, documents, registers):
    time = np.zeros(len(doc))
    step = 0
    latest = np.full(documents, np.inf)
    simple = (low + width) <= weight
    while len(doc):
        many = int(np.clip(_WIDE // len(doc), 1, 64))
        # the next points of every process at once: waiting times are exponential
        at = seed[:, None] + np.arange(step + 1, step + many + 1, dtype=np.uint64)[None, :] * _STEP
        bits = mix(at)
        wait = -np.log1p(-((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53))
        # added strictly one after another, so a time does not depend on how many points are drawn at once
        wait /= width[:, None]
        wait[:, 0] += time
        times = np.cumsum(wait, axis=1)
        step += many
        spread = mix(bits ^ _DRAW)
        slot = ((spread >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        good = times <= latest[doc][:, None]
        if not simple.all():
            # the bits of the position, from the top one down, choose a half at each level
            place = low[:, None] + (spread & (width[:, None] - 1).astype(np.uint64)).astype(np.int64)
            good &= place < weight[:, None]
        cell = doc[:, None] * registers + slot
        np.minimum.at(best, cell[good], times[good])
        touched = np.unique(doc)
        latest[touched] = best.reshape(documents, registers)[touched].max(axis=1)
        time = times[:, -1]
        live = time < latest[doc]
        if not live.all():
            doc, seed, low, width, weight = doc[live], seed[live], low[live], width[live], weight[live]
            time, simple = time[live], simple[live]
