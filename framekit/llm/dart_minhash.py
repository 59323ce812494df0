"""DartMinHash: signatures of weighted sets whose agreement is their weighted Jaccard similarity.

Imagine darts thrown at random, one after another, at the plane of elements and weights; a set is hit by a
dart that lands on one of its elements below that element's weight. Each dart belongs to one of
k coordinates, and a set's value at a coordinate is its earliest dart there: two sets agree there with
probability sum min / sum max. Darts come from hashes of (element, weight region, time slice), so all
sets see the same ones; regions and slices double in size, and slices are opened in order of time
until every coordinate is filled. A set of total weight W opens about k ln k / W of time: some k ln k darts
whatever its size.
"""

from __future__ import annotations

import math

import numpy as np

COORDINATES = 128
#: Length of the first time slice.
FIRST_SLICE = 2.0**-4

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (fixed constants of the public splitmix64 generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _salt(*parts: int) -> np.uint64:
    out = 0x9E3779B97F4A7C15
    for p in parts:
        out = int(mix(np.array([(out * 0x100000001B3 + p + 1) % 2**64], _U))[0])
    return _U(out)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


class _Region:
    """The cells of one weight region: its time slices, in order. A cell's number of darts for an element is Poisson by its area."""

    def __init__(self, region: int) -> None:
        self._region = region
        self.low = 0.0 if region == 0 else 2.0 ** (region - 1)
        self.width = 1.0 if region == 0 else self.low
        self.salt, self.none_below = np.empty(0, _U), np.empty(0, _U)
        self.start, self.length, self._first = np.empty(0), np.empty(0), np.empty(0, np.int64)
        self._at_most = np.empty(0)

    def _extend(self, slices: int) -> None:
        for i in range(len(self.salt), slices):
            start = 0.0 if i == 0 else FIRST_SLICE * 2.0 ** (i - 1)
            length = FIRST_SLICE if i == 0 else start
            area = self.width * length
            n = np.arange(int(area + 12 * math.sqrt(area) + 20))
            log = n * math.log(area) - area - np.concatenate([[0.0], np.cumsum(np.log(np.maximum(n[1:], 1)))])
            # Chance of at most 0, 1, 2, ... darts, and hashes below which there is none.
            at_most = np.cumsum(np.exp(log))
            self.salt = np.append(self.salt, _salt(self._region, i))
            self.none_below = np.append(self.none_below, _U(min(int(at_most[0] * 2.0**64), 2**64 - 1)))
            self.start, self.length, self._first = np.append(self.start, start), np.append(self.length, length), np.append(self._first, len(self._at_most))
            # All slices in one ascending table: each one's chances lie above those of the slices before.
            self._at_most = np.append(self._at_most, np.minimum(at_most, 1.0) + 2.0 * i)

    def darts(self, elements: np.ndarray, weights: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and time of the darts of the slices from ``first`` up to ``last`` that hit the set."""
        self._extend(last)
        h = mix(elements ^ self.salt[first:last, None])
        cell, element = np.nonzero(h >= self.none_below[first:last, None])
        h = h[cell, element]
        cell += first
        number = np.searchsorted(self._at_most, _unit(h) + 2.0 * cell, side="right") - self._first[cell]
        owner = np.repeat(np.arange(len(h)), number)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        dart, cell = mix(h[owner] + (nth.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)), cell[owner]
        if weights.min() < self.low + self.width:
            hit = self.low + self.width * _unit(mix(dart ^ _U(0x5851F42D4C957F2D))) < weights[element[owner]]
            dart, cell = dart[hit], cell[hit]
        return dart, self.start[cell] + self.length[cell] * _unit(mix(dart ^ _U(0x14057B7EF767814F)))


_regions: dict[int, _Region] = {}


def _region(region: int) -> _Region:
    found = _regions.get(region)
    if found is None:
        found = _regions[region] = _Region(region)
    return found


def signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """16-bit values of the k coordinates. ``elements``: distinct 64-bit hashes; ``weights``: over 0, not all tiny."""
    value, filled = np.zeros(k, np.uint16), np.zeros(k, bool)
    regions = 1 + max(0, math.ceil(math.log2(max(float(weights.max()), 1.0))))
    parts = [(_region(0), elements, weights)]
    for r in range(1, regions):
        above = weights > 2.0 ** (r - 1)
        parts.append((_region(r), elements[above], weights[above]))
    # The slices that it takes to fill nearly all coordinates are opened at once, further ones singly.
    time_needed = 0.85 * k * math.log(max(k, 2)) / float(weights.sum())
    first, last = 0, 1 + max(0, math.ceil(math.log2(time_needed / FIRST_SLICE)))
    while True:
        found = [region.darts(e, w, first, last) for region, e, w in parts]
        dart, time = (np.concatenate([f[i] for f in found]) for i in (0, 1)) if regions > 1 else found[0]
        at = ((dart >> _U(16)) % _U(k)).astype(np.int64)
        new = ~filled[at]
        dart, time, at = dart[new], time[new], at[new]
        # Latest first, so that the earliest is the last one written.
        order = np.argsort(-time, kind="stable")
        value[at[order]] = (dart[order] & _U(0xFFFF)).astype(np.uint16)
        filled[at] = True
        if filled.all():
            return value
        first, last = last, last + 1
