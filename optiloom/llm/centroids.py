"""Centroid clustering of integer vectors by partial-distance search.

A vector's components x become floor(64 * x). Each round gives every vector its
nearest centroid (squared Euclidean distance, ties to the smaller number) and
replaces the centroids by floors of exact means. The nearest centroid is found by
partial distances: dimensions are taken by falling variance, a few at a time; a
centroid whose sum over them is strictly above the vector's best distance so far
is given up, and only those that survive finish all dimensions. The first best is
the distance to the centroid that looks nearest over the first dimensions.

Rows stay where they are. A task sends one row of integer sums per cluster and
dimensions' moments, which Spark adds up; only centroids (clusters x dimensions),
variances and their counts reach the driver, and go out with the next round's
tasks. Sums are integers, so neither the order of rows nor a repeated task changes
a result.

Edge cases: null vectors, vectors of another length and vectors with null, NaN or
infinite components are left out; an empty table (or none kept) gives an empty
result; with fewer vectors than clusters there are as many clusters as vectors;
repeated rows count each; rows that repeat an id and share its hash are ordered by
their vectors as first centroids; a null id is kept, has no hash and comes last among
first centroids; clusters without vectors keep their centroid and have no
rows. Components beyond 2**27 count as 2**27 (and so below zero), as squared
distances would not fit a long. Columns besides id and vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optiloom.functions.storage import saved

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
#: Components are floors of this times x.
SCALE = 64
#: Dimensions between two comparisons with the best distance.
STEP = 8
#: Vectors handled at once.
BLOCK = 8192
_BOUND = float(1 << 27)


@dataclass
class Search:
    """Centroids, and the order in which dimensions are summed."""

    centroids: np.ndarray  # clusters x dimensions, int64
    order: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row of ``vectors`` (int64)."""
        have, centers = np.ascontiguousarray(vectors[:, self.order].T), self.centroids[:, self.order]
        n, first = have.shape[1], slice(0, STEP)
        partial = np.stack([_distance(have[first], c[first]) for c in centers])
        chosen = partial.argmin(axis=0)
        best = partial[chosen, np.arange(n)]
        for d in range(STEP, len(self.order)):
            best += (have[d] - centers[chosen, d]) ** 2
        guess = chosen.copy()
        for k, c in enumerate(centers):
            live = np.flatnonzero((partial[k] <= best) & (guess != k))
            total = partial[k, live]
            for low in range(STEP, len(self.order), STEP):
                if not len(live):
                    break
                part = slice(low, low + STEP)
                total = total + _distance(have[part][:, live], c[part])
                stays = total <= best[live]
                live, total = live[stays], total[stays]
            better = (total < best[live]) | ((total == best[live]) & (k < chosen[live]))
            best[live[better]], chosen[live[better]] = total[better], k
        return chosen, best


def _distance(have: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Squared differences of rows (dimensions) to ``center``, added up."""
    return ((have - center[:, None]) ** 2).sum(axis=0)


def integers(column: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the rows that are kept, their vectors as integers)."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dimensions)
    if not len(rows):
        return rows, np.zeros((0, dimensions), np.int64)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    sound = np.isfinite(flat).all(axis=1)
    flat = np.floor(flat[sound] * SCALE)
    return rows[sound], np.clip(flat, -_BOUND, _BOUND).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], column: str, dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for low in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(low, BLOCK)
            rows, vectors = integers(batch.column(column), dimensions)
            if len(rows):
                yield batch, rows, vectors


def _sums(df: DataFrame, key: str, width: int) -> list:
    """Rows (key, s: sums by place, n) added up by key: one row for each key."""
    added = df.groupBy(key).agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)], F.sum("n").alias("n"))
    return [(r[0], list(r[1:-1]), r[-1]) for r in added.collect()]  # a row a cluster


def _variance_order(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """Dimensions by falling variance over all kept vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, np.zeros(dimensions), np.zeros(dimensions)
        for _, _, x in _blocks(batches, "embedding", dimensions):
            m, own = len(x), x.mean(axis=0)
            square += ((x - own) ** 2).sum(axis=0) + (own - mean) ** 2 * (n * m / (n + m))
            mean += (own - mean) * (m / (n + m))
            n += m
        if n:
            yield pa.RecordBatch.from_pydict({"d": np.arange(dimensions), "n": np.full(dimensions, n), "mean": mean, "square": square})

    parts = vectors.mapInArrow(run, "d long, n long, mean double, square double")
    middle = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    total = F.sum(F.col("square") + F.col("n") * F.col("mean") * F.col("mean")) / F.sum("n") - middle * middle
    found = {r.d: r.v for r in parts.groupBy("d").agg(total.alias("v")).collect()}
    return np.array(sorted(range(dimensions), key=lambda d: (-found.get(d, 0.0), d)))


def _valid(vector: Column, dimensions: int) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & sound, F.lit(False))


def _first_centroids(vectors: DataFrame, clusters: int, dimensions: int) -> np.ndarray:
    mark = F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    least = vectors.where(_valid(F.col("embedding"), dimensions)).withColumn("mark", mark).orderBy(F.asc_nulls_last("mark"), "embedding").limit(clusters)
    rows = [r.embedding for r in least.select("embedding").collect()]
    kind = pa.list_(pa.float64())
    return integers(pa.array(rows, kind), dimensions)[1]


def _moved(vectors: DataFrame, search: Search) -> np.ndarray:
    """Centroids after one round."""
    dimensions, clusters = len(search.order), len(search.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((clusters, dimensions), np.int64), np.zeros(clusters, np.int64)
        for _, _, x in _blocks(batches, "embedding", dimensions):
            chosen, _ = search.nearest(x)
            by = np.argsort(chosen, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(chosen[by]) > 0])
            sums[chosen[by][cuts]] += np.add.reduceat(x[by], cuts, axis=0)
            counts += np.bincount(chosen, minlength=clusters)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_pydict({"cluster": used, "s": sums[used].tolist(), "n": counts[used]})

    moved = search.centroids.copy()
    for k, total, n in _sums(vectors.mapInArrow(run, "cluster long, s array<long>, n long"), "cluster", dimensions):
        moved[k] = [t // n for t in total]
    return moved


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector of (vec_id, embedding), and the final centroids."""
    vectors = vectors.select("vec_id", "embedding")
    search = Search(_first_centroids(vectors, clusters, dimensions), _variance_order(vectors, dimensions))
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    if not len(search.centroids):
        return vectors.sparkSession.createDataFrame([], schema), search.centroids
    for _ in range(rounds):
        search = Search(_moved(vectors, search), search.order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, x in _blocks(batches, "embedding", dimensions):
            chosen, best = search.nearest(x)
            ids = batch.column("vec_id").take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(chosen.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, schema), search.centroids


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, inertia of the cluster and of all, and the centroid's hash."""
    found, centroids = cluster(vectors)
    found = saved(found)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = vectors.sparkSession.createDataFrame([(k, s, sum(sums.values()), marks[k]) for k, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
