"""DartMinHash signatures of weighted sets, for whole batches at a time.

Every element owns a half-plane weight x rank on which hashed darts of unit
density lie; a set sees the darts below its elements' weights.  Each dart also
has one of ``k`` coordinates, and a signature keeps, per coordinate, the dart
of least rank.  Two signatures agree in a coordinate with the probability of
their sets' weighted likeness.  A set of total weight W only has to look at
ranks up to (k ln k + 2k) / W, whatever its number of elements, so a signature
costs k log k darts instead of k times the set's size.

The half-plane is cut into rectangles of area one (weight octaves, their rank
cells widened to match), so that the darts of a rectangle are Poisson(1) many
and follow from a hash of (element, octave, cell): equal in every set.
"""

from __future__ import annotations

import math

import numpy as np

from palimpsest.functions.shingles import U, mix

#: Lower ends and heights of the weight octaves (steps of four); weights are in (0, 1].
OCTAVES = ((0.0, 1 / 16), (1 / 16, 3 / 16), (1 / 4, 3 / 4))
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
#: Sets are worked off in blocks of about this many elements, which keeps the arrays in the processor's cache.
BLOCK = 1 << 13
NONE = U(2**64 - 1)


def _throw(h: np.ndarray, w: np.ndarray, doc: np.ndarray, theta: np.ndarray, k: int, seed: int, best: np.ndarray) -> None:
    """Lower ``best`` (per set and coordinate: rank bits, then the dart's name) to the darts seen below ``theta``."""
    with np.errstate(over="ignore"):
        for octave, (low, height) in enumerate(OCTAVES):
            seen = np.flatnonzero(w > low)
            if not len(seen):
                continue
            width = np.float32(1.0 / height)
            n_cells = np.ceil(theta[doc[seen]] / width).astype(np.int64)
            el = np.repeat(seen, n_cells)
            cell = np.arange(len(el)) - np.repeat(np.cumsum(n_cells) - n_cells, n_cells)
            salt = U((seed * 0x9E3779B97F4A7C15 + (octave + 1) * 0xA24BAED4963EE407) & (2**64 - 1))
            key = mix((h[el] ^ salt) + (cell.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
            count = np.searchsorted(_POISSON, (key >> U(11)).astype(np.float64) * 2.0**-53)
            at = np.repeat(np.arange(len(el)), count)
            number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(key[at] + (number.astype(U) + U(1)) * U(0xC2B2AE3D27D4EB4F))
            el, cell = el[at], cell[at]
            # of a dart's 64 bits: 32 its place in the rank cell, 20 its weight, 12 its coordinate
            weight = ((dart >> U(12)) & U(0xFFFFF)).astype(np.float32) * np.float32(2.0**-20 * height) + np.float32(low)
            rank = (cell.astype(np.float32) + (dart >> U(32)).astype(np.float32) * np.float32(2.0**-32)) * width
            ok = np.flatnonzero((weight < w[el]) & (rank <= theta[doc[el]]))
            dart, slot = dart[ok], doc[el[ok]] * k
            slot += (((dart & U(0xFFF)) * U(k)) >> U(12)).astype(np.int64)
            value = (rank[ok].view(np.uint32).astype(U) << U(32)) | (mix(dart) >> U(32))
            np.minimum.at(best, slot, value)


def signatures(h: np.ndarray, offsets: np.ndarray, w: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A row of ``k`` darts (32-bit names) per set.  A set without elements gets a row of zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, k), U)
    w = w.astype(np.float32)
    t = k * math.log(k) + 2 * k
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
        a, b = offsets[lo], offsets[hi]
        doc = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
        total = np.bincount(doc, weights=w[a:b], minlength=hi - lo)
        best = np.full((hi - lo) * k, NONE, U)
        todo, reach = np.flatnonzero(total > 0), 1.0
        while len(todo):
            theta = np.zeros(hi - lo, np.float32)
            theta[todo] = reach * t / total[todo]
            pick = np.flatnonzero(theta[doc] > 0)
            _throw(h[a:b][pick], w[a:b][pick], doc[pick], theta, k, seed, best)
            todo = todo[(best.reshape(-1, k)[todo] == NONE).any(axis=1)]  # a coordinate without a dart: look further
            reach *= 2
        out[lo:hi] = np.where(best == NONE, U(0), best & U(0xFFFFFFFF)).reshape(-1, k)
        lo = hi
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int, seed: int = 7) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; the band's number is part of the key."""
    with np.errstate(over="ignore"):
        keys = np.zeros((len(sig), bands), U)
        for r in range(rows):
            keys = mix(keys + sig[:, r * bands : (r + 1) * bands] + U(seed))
        return mix(keys + (np.arange(bands, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
