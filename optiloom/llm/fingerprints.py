"""SimHash fingerprints of word shingles, and their links over Gray-order hierarchical indexes.

Fingerprints within ``limit`` bits agree on all but ``limit`` of ``parts`` parts of the
64 bits, so each distinct fingerprint is filed under every choice of so many parts, and
each group is searched with :mod:`gray_index`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiloom.llm.gray_index import spanning_edges
from optiloom.llm.words import as_bytes

SHINGLE = 3
LIMIT = 2
PARTS = 6
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles in order, repeats included; of the whole sequence if it has fewer words."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, 42)], np.uint64)
    stops = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(stops + 1).tolist()]
    ends = [*stops.tolist(), len(line)][shingle - 1 :]
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(ends))


def majority(values: np.ndarray) -> int:
    """A bit is 1 if set in over half of the values."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(values), 1 << 16):
        part = values[low : low + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64 (seed 42)."""
    return majority(shingle_hashes(text, shingle))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fingerprints as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x, shingle) for x in as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _masks(parts: int, limit: int) -> list[int]:
    """Masks of every choice of all parts but ``limit``, as signed longs."""
    cuts = [round(64 * k / parts) for k in range(parts + 1)]
    bits = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(parts)]
    return [int(np.uint64(sum(c)).view(np.int64)) for c in combinations(bits, parts - limit)]


def links(fingerprints: DataFrame, limit: int = LIMIT, parts: int = PARTS) -> DataFrame:
    """(u, v): edges between distinct fingerprints (column fp) with the components of all links."""
    masks = _masks(parts, limit)
    filed = fingerprints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "key"))
    groups = filed.groupBy("c", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values = column.flatten().to_numpy(zero_copy_only=False)
            bounds = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
            edges = [e for a, b in zip(bounds[:-1], bounds[1:]) for e in spanning_edges(values[a:b].view(np.uint64), limit)]
            found = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["u", "v"])

    return groups.mapInArrow(run, "u long, v long")
