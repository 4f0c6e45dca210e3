"""Sums of doubles without rounding, so that neither the order of rows nor the number of tasks shows in them.

A value is cut into whole numbers at fixed binary places, limbs of 32 bits, that are
added up apart for each cell. A state is one array: the first limb in use, then one
number for each limb in use and cell. As whole numbers count in units of 2**-1126.
"""

from __future__ import annotations

import numpy as np

_BITS = 32
_MASK = (1 << _BITS) - 1
#: Limbs of infinite and of NaN values, above all limbs of finite sums.
_INF, _NAN = 72, 76
#: As a whole number, a sum with an infinite value is at least ``INF``, and one with a NaN at least ``NAN``.
INF, NAN = 1 << _BITS * _INF, 1 << _BITS * _NAN


def _cut(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whole mantissa, binary place of its last bit) of values that are not negative."""
    odd = ~np.isfinite(values)
    m, e = np.frexp(np.where(odd, 0.0, values))
    m, place = (m * 2.0**53).astype(np.int64), e.astype(np.int64) + 1073
    m[odd], place[odd] = 1, np.where(np.isnan(values[odd]), _NAN, _INF) * _BITS
    return m, place


def state(cell: np.ndarray, values: np.ndarray, cells: int) -> np.ndarray:
    """State of the sums of ``values`` by ``cell``, below ``cells``; no value is negative."""
    used = values != 0
    cell, (m, place) = cell[used], _cut(values[used])
    if not len(cell):
        return np.zeros(1, np.int64).view(float)
    limb, shift = place // _BITS, place % _BITS
    first = int(limb.min())
    out = np.zeros(1 + (int(limb.max()) - first + 3) * cells, np.int64)
    out[0] = first
    low, high = (m & _MASK) << shift, (m >> _BITS) << shift
    at = 1 + (limb - first) * cells + cell
    for j, part in enumerate((low & _MASK, (low >> _BITS) + (high & _MASK), high >> _BITS)):
        np.add.at(out, at + j * cells, part)
    return out.view(float)


def merged(a: np.ndarray, b: np.ndarray, cells: int) -> np.ndarray:
    """State of the sums of two states."""
    parts = [s.view(np.int64) for s in (a, b) if len(s) > 1]
    if len(parts) < 2:
        return parts[0].view(float) if parts else a
    first = min(int(p[0]) for p in parts)
    out = np.zeros(max((int(p[0]) - first) * cells + len(p) for p in parts), np.int64)
    out[0] = first
    for p in parts:
        low = 1 + (int(p[0]) - first) * cells
        out[low : low + len(p) - 1] += p[1:]
    return out.view(float)


def sums(found: np.ndarray, cells: int) -> list[int]:
    """The sums of a state as whole numbers, one a cell."""
    own = found.view(np.int64)
    out = [0] * cells
    for limb, row in enumerate(own[1:].reshape(-1, cells), int(own[0])):
        for c in np.flatnonzero(row):
            out[c] += int(row[c]) << _BITS * limb
    return out


def whole(values: np.ndarray) -> list[int]:
    """Values that are not negative as whole numbers."""
    return [int(m) << int(place) for m, place in zip(*_cut(values), strict=True)]
