"""Signatures of weighted bags (BagMinHash) with dyadic Poisson processes.

An element with weight w owns the levels [0, w).  On the levels of each element runs one
Poisson process of rate 1 a level, the same for every bag, whose points fall into the
slots of the signature at random.  A slot keeps its earliest point, so two bags agree in
a slot with a probability of their weighted Jaccard similarity.

The points are found hierarchically.  The levels are divided into blocks [0, 1), [1, 2),
[2, 4), [4, 8) ..., and of a block first only the earliest point is drawn.  To go on, the
block is halved: a coin puts the point into one half, and the other half draws its own
earliest point; a single level draws the next one.  Blocks go on only while their points
can still be the earliest of some slot, and halves above the weight are dropped, so heavy
elements cost the logarithm of their weight.
"""

from __future__ import annotations

import numpy as np

SLOTS = 96
BANDS = 24
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _waits(random: np.ndarray) -> np.ndarray:
    """Exponential waiting times of rate 1."""
    return -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))


class _Blocks:
    """Parts of processes: bag, element, seed, levels [low, low + width), weight, the time
    of the earliest point, and whether that point has been used."""

    def __init__(self, *columns: np.ndarray):
        self.columns = columns
        self.bag, self.element, self.seed, self.low, self.width, self.weight, self.time, self.used = columns

    def where(self, rows: np.ndarray) -> _Blocks:
        return _Blocks(*(column[rows] for column in self.columns))

    def plus(self, *others: _Blocks) -> _Blocks:
        columns = zip(self.columns, *(other.columns for other in others))
        return _Blocks(*(np.concatenate(same) for same in columns))


def _first_blocks(bags: np.ndarray, elements: np.ndarray, weights: np.ndarray) -> _Blocks:
    parts = []
    low, width = 0, 1
    while len(bags):
        seed = _mixed(elements + _A * np.array([low + 1], np.uint64))
        lows, widths = np.full(len(bags), low, np.int64), np.full(len(bags), width, np.int64)
        time = _waits(_mixed(seed + _A)) / width
        parts.append(
            _Blocks(bags, elements, seed, lows, widths, weights, time, np.zeros(len(bags), bool))
        )
        low, width = low + width, low + width
        more = weights > low
        bags, elements, weights = bags[more], elements[more], weights[more]
    return parts[0].plus(*parts[1:])


def _halved(b: _Blocks) -> _Blocks:
    """Both halves of blocks: one holds the earliest point, the other draws its own."""
    half = b.width // 2
    to_left = (_mixed(b.seed + _C) >> np.uint64(63)) == 0
    seeds = _mixed(b.seed ^ _B), _mixed(b.seed ^ _C)
    later = b.time + _waits(_mixed(np.where(to_left, seeds[1], seeds[0]) + _A)) / half
    left = _Blocks(
        b.bag, b.element, seeds[0], b.low, half, b.weight,
        np.where(to_left, b.time, later), b.used & to_left,
    )
    right = _Blocks(
        b.bag, b.element, seeds[1], b.low + half, half, b.weight,
        np.where(to_left, later, b.time), b.used & ~to_left,
    )
    both = left.plus(right)
    return both.where(both.low < both.weight)


def signatures(
    n: int, bags: np.ndarray, elements: np.ndarray, weights: np.ndarray, slots: int = SLOTS
) -> np.ndarray:
    """Signatures [bag, slot] of bags 0..n-1 given as (bag, element hash, weight) triples.

    The values are times of points; bags without elements have infinite times.
    """
    times = np.full(n * slots, np.inf)
    if not len(bags):
        return times.reshape(n, slots)
    blocks = _first_blocks(bags, elements.astype(np.uint64), weights)
    while len(blocks.bag):
        drawn = _mixed(blocks.element ^ blocks.time.view(np.uint64))
        fresh = ~blocks.used & (blocks.low + blocks.width <= blocks.weight)
        place = blocks.bag * slots + ((drawn >> np.uint64(33)) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(times, place[fresh], blocks.time[fresh])
        latest = times.reshape(n, slots).max(axis=1)
        blocks.used |= fresh
        single = blocks.width == 1
        level = blocks.where(single)
        level.time += _waits(_mixed(drawn[single] + _A))
        level.used[:] = False
        if not single.all():
            level = level.plus(_halved(blocks.where(~single)))
        blocks = level.where(level.time < latest[level.bag])
    return times.reshape(n, slots)


def short(times: np.ndarray) -> np.ndarray:
    """Signatures as 32-bit values that agree where the points do."""
    return (_mixed(times.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    n, slots = values.shape
    parts = values.astype(np.uint64).reshape(n, bands, slots // bands)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for i in range(slots // bands):
        keys = _mixed(keys * _A + parts[:, :, i] + np.uint64(1))
    return keys.view(np.int64)
