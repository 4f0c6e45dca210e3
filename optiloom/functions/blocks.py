"""Numpy states over all rows: each task reduces its Arrow batches to one array, a few tasks merge
these, and the driver merges the last few. A state's size depends on columns, never on rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

def fold(df: DataFrame, step: Callable[[np.ndarray | None, pa.RecordBatch], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """``step`` takes a task's state so far (None at first) and a batch; ``merge`` two states, one-dimensional float64 arrays. None without rows.

    As many tasks merge as the root of the shuffle partitions; so many states reach the driver.
    """
    mergers = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = step(state, batch)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"state": [state.tobytes()]})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for raw in batch.column(0):
                own = np.frombuffer(raw.as_py())
                state = own if state is None else merge(state, own)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"state": [state.tobytes()]})

    out = None
    for row in df.mapInArrow(run, "state binary").repartition(mergers).mapInArrow(join, "state binary").collect():
        own = np.frombuffer(row.state)
        out = own if out is None else merge(out, own)
    return out


def matrix(batch: pa.RecordBatch, names: list[str] | None = None) -> np.ndarray:
    """Columns of a batch as a (rows, columns) array of doubles, nulls as NaN."""
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in (names or batch.schema.names)])


def vectors(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a (rows, length) array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)
