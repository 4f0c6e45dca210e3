"""Vectorised words: boundaries and 64-bit hashes for whole batches of texts.

Words are maximal runs of bytes other than ASCII white space. A word's hash is
a polynomial over its bytes modulo 2**64, read off one running sum, so the cost
is a few numpy passes over the bytes however many words there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20).integers(1, 2**64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of a word beyond which :func:`rehash_long` hashes it in another way.
LONG = 64
#: Text bytes handled at once; a longer text is handled alone.
CHUNK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Words of several texts: hashes, byte bounds in ``data``, and the first word of each text."""

    data: bytes
    first: np.ndarray  # len(texts) + 1
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def read_words(texts: list[bytes]) -> Words:
    data = b"\n".join([*texts, b""]) or b"\n"
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    power, inverse = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64, out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start])
    ends = np.cumsum([len(x) + 1 for x in texts]) if texts else np.zeros(0, int)
    return Words(data, np.r_[0, np.searchsorted(start, ends)], start, end, hashes)


def rehash_long(words: Words) -> Words:
    """``words`` whose long words have the XXH3 hash of their bytes.

    Products modulo 2**64 lose low bits with every doubling of a word, so that long
    words made for it (from some 1,000 bytes on) are sure to collide.
    """
    for i in np.flatnonzero(words.end - words.start > LONG).tolist():
        words.hashes[i] = xxhash.xxh3_64_intdigest(words.data[words.start[i] : words.end[i]])
    return words


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunked(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one text."""
    low = size = 0
    for i, x in enumerate(texts):
        if i > low and size + len(x) > limit:
            yield low, i
            low, size = i, 0
        size += len(x)
    if low < len(texts):
        yield low, len(texts)


def sums_by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a per-word array over each text."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
