"""Lines of growing files by byte ranges.

A range holds the lines that begin in it, so ranges of a file hold each line once,
wherever they are cut; only complete lines count.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

#: Bytes of one range.
RANGE_BYTES = 8 << 20
#: Bytes read at a time to find the end of a line.
_STEP = 64 << 10


@dataclass(frozen=True)
class Range:
    """Bytes ``low`` to ``high`` of ``path``; ``base`` is added to the positions of its lines."""

    path: str
    low: int
    high: int
    base: int = 0


def ranges_of(path: str, start: int, end: int, base: int = 0) -> list[Range]:
    return [Range(path, low, min(low + RANGE_BYTES, end), base) for low in range(start, end, RANGE_BYTES)]


def last_line_end(path: str, start: int, most: int | None = None) -> int:
    """The last position behind a line feed after ``start`` and not beyond ``most``; behind the first line if that is longer; ``start`` without any."""
    size = os.path.getsize(path)
    high = size if most is None else min(most, size)
    with open(path, "rb") as f:
        at = high
        while at > start:
            low = max(start, at - _STEP)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
        f.seek(max(high, start))
        at = f.tell()
        while part := f.read(_STEP):
            found = part.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(part)
    return start


def lines_of(own: Range, whole: bool = True) -> Iterator[tuple[int, str]]:
    """(position, text) of the lines that begin in a range; with ``whole`` a last line without a line feed is left out."""
    with open(own.path, "rb") as f:
        at = own.low
        if at:  # unless a line begins just here, the first one is the range before's
            f.seek(at - 1)
            at += len(f.readline()) - 1
        f.seek(at)
        while at < own.high:
            line = f.readline()
            if not line or (whole and not line.endswith(b"\n")):
                return
            yield own.base + at, line.rstrip(b"\n").decode("utf-8", "replace")
            at += len(line)
