"""Principal components, k-means, elbow and cluster statistics."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiloom.functions import blocks, exact
from optiloom.functions.ordered import with_position
from optiloom.functions.schema import EPS, StudySchema
from optiloom.functions.storage import Scratch
from optiloom.operators.filters import long_form
from optiloom.operators.sensitivity import moments

MAX_ROUNDS = 300
#: Parts of a range of rows whose sums of squared distances are told apart in one scan.
SECTIONS = 512
#: Rows that a seeding step fetches at most, for each number of clusters.
FETCHED = 1024


def features(df: DataFrame, schema: StudySchema, space: str) -> list:
    """Columns of a space: param, objective or all (with numeric attributes); text columns count as 0."""
    kinds = dict(df.dtypes)
    attrs = [a for a in schema.attrs if kinds[a] != "string"]
    names = {"param": schema.params, "objective": schema.objectives, "all": (*schema.params, *schema.objectives, *attrs)}[space]
    return [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if kinds[n] != "string" else F.lit(0.0) for n in names]


def pca(df: DataFrame, columns: Sequence, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray] | None:
    """(df with pc1.., eigenvalues, loadings): centered, unscaled, sample covariance; the largest loading of each is positive.

    None for fewer than two rows or no columns.
    """
    if not columns:
        return None
    m = moments(df, columns)
    if m.n < 2:
        return None
    values, loads = np.linalg.eigh(m.cross / (m.n - 1))
    values, loads = np.maximum(values[::-1], 0), loads[:, ::-1]
    loads = loads * np.where(loads[np.abs(loads).argmax(0), np.arange(loads.shape[1])] < 0, -1, 1)
    k = min(k, len(values))
    names = [f"__x{i}" for i in range(len(columns))]
    cols = {n: (F.col(c) if isinstance(c, str) else c).cast("double") for n, c in zip(names, columns, strict=True)}
    shifted = [f"({n} - {_literal(v)})" for n, v in zip(names, m.mean, strict=True)]
    out = {f"pc{j + 1}": F.expr(" + ".join(f"{x} * {_literal(v)}" for x, v in zip(shifted, loads[:, j], strict=True))) for j in range(k)}
    return df.withColumns(cols).withColumns(out).drop(*names), values[:k], loads[:, :k]


def _literal(x: float) -> str:
    return f"({float(x)!r}D)"


def _distances(names: Sequence[str], centers: np.ndarray):
    """Squared distances to each center, added up column by column; one expression text a center, as there are many terms."""
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    return [F.expr("0D" + "".join(f" + ({n} - {_literal(v)}) * ({n} - {_literal(v)})" for n, v in zip(quoted, c, strict=True))) for c in centers]


def assigned(df: DataFrame, names: Sequence[str], centers: np.ndarray) -> DataFrame:
    """``label`` of the nearest center (the lowest of equal ones) and ``d2``, its squared distance."""
    d = F.array(*_distances(names, centers))
    return df.withColumn("__d", d).withColumn("d2", F.array_min("__d")).withColumn("label", (F.array_position("__d", F.col("d2")) - 1).cast("int")).drop("__d")


def squared_distances(x: np.ndarray, center: Sequence[float]) -> np.ndarray:
    """Of the rows of ``x`` (one array a column), added up column by column as :func:`assigned` does."""
    out = np.zeros(x.shape[1])
    for values, c in zip(x, center, strict=True):
        out += (values - c) * (values - c)
    return out


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, squared distance); ties go to the lowest label."""
    d = np.stack([squared_distances(x, c) for c in centers])
    label = d.argmin(axis=0)
    return label, d[label, np.arange(len(label))]


def _columns(batch) -> tuple[np.ndarray, np.ndarray]:
    """(positions, one array a column) of a batch of row_idx and v."""
    return batch.column("row_idx").to_numpy(), np.ascontiguousarray(blocks.vectors(batch.column("v")).T)


def _sections(rows: DataFrame, centers: dict[int, np.ndarray], at: dict[int, tuple[int, int]]) -> dict[int, list[int]]:
    """For each k the sums of squared distances to its centers over ``SECTIONS`` even sections of its range of positions, as whole numbers of :mod:`exact`."""
    ks = sorted(at)
    cells = len(ks) * SECTIONS
    width = {k: -(-(at[k][1] - at[k][0]) // SECTIONS) for k in ks}

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return exact.merged(a, b, cells)

    def step(state: np.ndarray | None, batch) -> np.ndarray:
        place, x = _columns(batch)
        cell, d = [], []
        for i, k in enumerate(ks):
            inside = np.flatnonzero((place >= at[k][0]) & (place < at[k][1]))
            cell.append(i * SECTIONS + (place[inside] - at[k][0]) // width[k])
            d.append(_nearest(x[:, inside], centers[k])[1])
        own = exact.state(np.concatenate(cell), np.concatenate(d), cells)
        return own if state is None else merge(state, own)

    low, high = min(a for a, _ in at.values()), max(b for _, b in at.values())
    found = exact.sums(blocks.fold(rows.where(F.col("row_idx").between(low, high - 1)), step, merge), cells)
    return {k: found[i * SECTIONS : (i + 1) * SECTIONS] for i, k in enumerate(ks)}


def _share(total: int, parts: int) -> int:
    """The least whole sum that reaches its even share; the first infinite or NaN one where there are such."""
    return exact.NAN if total >= exact.NAN else exact.INF if total >= exact.INF else -(-total // parts)


def _next_centers(rows: DataFrame, n: int, centers: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each k the row at which the running sum of squared distances reaches its even share: found by sums of sections, then of sections of that section, until a few rows are left.

    Sums are exact, as in tables that repeat rows they meet the share to the last bit.
    """
    at = dict.fromkeys(centers, (0, n))
    share: dict[int, int] = {}
    while wide := {k: r for k, r in at.items() if r[1] - r[0] > FETCHED}:
        for k, sums in _sections(rows, centers, wide).items():
            low, high = at[k]
            width = -(-(high - low) // SECTIONS)
            upto = list(accumulate(sums))
            share.setdefault(k, _share(upto[-1], k - len(centers[k]) + 1))
            hit = min(bisect_left(upto, share[k]), (high - low - 1) // width)
            share[k] -= upto[hit - 1] if hit else 0
            at[k] = (low + hit * width, min(low + (hit + 1) * width, high))
    inside = F.lit(False)
    for low, high in set(at.values()):
        inside = inside | F.col("row_idx").between(low, high - 1)
    near = sorted(rows.where(inside).collect(), key=lambda r: r.row_idx)  # at most FETCHED rows a k
    out = {}
    for k, (low, high) in at.items():
        own = np.array([r.v for r in near if low <= r.row_idx < high], float)
        upto = list(accumulate(exact.whole(_nearest(own.T, centers[k])[1])))
        goal = share.get(k, _share(upto[-1], k - len(centers[k]) + 1))
        out[k] = own[min(bisect_left(upto, goal), len(own) - 1)]
    return out


def clusterings(df: DataFrame, names: Sequence[str], ks: Sequence[int], order: str) -> dict[int, tuple[np.ndarray, float]]:
    """(centers, within-cluster sum of squares) for every k of ``ks``, all advanced by the same scans.

    Rows are numbered by ``order`` and written once, narrow, to the shared folder.
    A scan sends one state a task: for each k sums and counts by cluster, the sum of
    squares and a mark of all labels; rounds end for a k when its mark stays.
    Only centers and such states reach the driver.
    """
    work = Scratch(df.sparkSession)
    try:
        packed = df.select(F.col(order).alias("__order"), F.array(*[F.col(c).cast("double") for c in names]).alias("v"))
        rows = work.save(with_position(packed, "__order").select("row_idx", "v"))
        n = rows.count()
        centers = {k: np.zeros((0, len(names))) for k in ks if 1 <= k <= n}
        if not centers:
            return {k: (np.zeros((0, len(names))), 0.0) for k in ks}
        first = np.array([rows.where(F.col("row_idx") == n // 2).first().v], float)
        centers = dict.fromkeys(centers, first)
        while short := {k: c for k, c in centers.items() if len(c) < k}:
            for k, row in _next_centers(rows, n, short).items():
                centers[k] = np.concatenate([centers[k], row[None]])
        done: dict[int, tuple[np.ndarray, float]] = {k: (np.zeros((0, len(names))), 0.0) for k in ks}
        marks: dict[int, int] = {}
        for _ in range(MAX_ROUNDS):
            for k, (mark, wcss, counts, sums) in _round(rows, centers).items():
                done[k] = (centers[k], wcss)
                if marks.get(k) == mark:
                    del marks[k], centers[k]
                    continue
                marks[k] = mark
                used = counts > 0
                centers[k] = centers[k].copy()
                centers[k][used] = sums[used] / counts[used, None]
            if not centers:
                break
        return done
    finally:
        work.drop()


def _round(rows: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, tuple[int, float, np.ndarray, np.ndarray]]:
    """For each k: (mark of all labels, sum of squares, counts, sums by cluster)."""
    ks = sorted(centers)
    width = centers[ks[0]].shape[1]
    cuts = np.cumsum([0, *(2 + k * (width + 1) for k in ks)])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a + b
        at = cuts[:-1]
        out[at] = (a[at].view(np.uint64) + b[at].view(np.uint64)).view(float)  # marks add modulo 2**64
        return out

    def step(state: np.ndarray | None, batch) -> np.ndarray:
        place, x = _columns(batch)
        own = np.zeros(cuts[-1])
        for k, low in zip(ks, cuts, strict=False):
            label, d = _nearest(x, centers[k])
            own[low] = _mark(place, label)
            own[low + 1] = d.sum()
            own[low + 2 : low + 2 + k] = np.bincount(label, minlength=k)
            by = own[low + 2 + k : low + 2 + k * (width + 1)].reshape(k, width)
            for j, values in enumerate(x):
                by[:, j] = np.bincount(label, values, k)
        return own if state is None else merge(state, own)

    found = blocks.fold(rows, step, merge)
    out = {}
    for k, low in zip(ks, cuts, strict=False):
        part = found[low : low + 2 + k * (width + 1)]
        out[k] = int(part[:1].view(np.uint64)[0]), float(part[1]), part[2 : 2 + k], part[2 + k :].reshape(k, width)
    return out


def _mark(place: np.ndarray, label: np.ndarray) -> float:
    """A 64-bit sum of mixed (position, label) pairs, as the bits of a double."""
    x = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + label.astype(np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x.sum(dtype=np.uint64).view(float)


def kmeans(df: DataFrame, names: Sequence[str], k: int, order: str) -> tuple[DataFrame, np.ndarray, float]:
    """(df with label, centers, within-cluster sum of squares): deterministic seeding, then Lloyd rounds.

    The first center is the middle row; each next is the row at which the
    running sum of squared distances, in row order, reaches its even share. Row
    orders are unique. Fewer rows than ``k``: all label 0 and no centers.
    """
    centers, wcss = clusterings(df, names, [k], order)[k]
    if not len(centers):
        return df.withColumn("label", F.lit(0)), centers, wcss
    return assigned(df, names, centers).drop("d2"), centers, wcss


def elbow(df: DataFrame, names: Sequence[str], order: str, max_k: int = 10) -> tuple[list[float], int]:
    """(sums of squares for k = 2.., recommended k): the greatest second difference, the last of equal ones."""
    top = min(max_k, df.count())
    found = clusterings(df, names, list(range(2, top + 1)), order)
    values = [found[k][1] for k in range(2, top + 1)]
    if len(values) < 3:
        return values, min(max(len(values) + 1, 2), max(top, 2))
    bends = [values[i] - 2 * values[i + 1] + values[i + 2] for i in range(len(values) - 2)]
    best = max(range(len(bends)), key=lambda i: (bends[i], i))
    return values, min(max(best + 3, 2), max(top, 2))


def cluster_stats(df: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    """label, name, size, mean, std (sample) and whether the cluster's mean stands out by over 3 standard errors."""
    rows = long_form(df, names, label)
    whole = rows.groupBy("name").agg(F.avg("value").alias("gm"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("gv"), F.count(F.lit(1)).alias("gn"))
    own = rows.groupBy(label, "name").agg(F.count(F.lit(1)).alias("size"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"))
    error = F.sqrt(F.col("var") / F.col("size") + F.col("gv") / F.col("gn"))
    stands = F.when(error < EPS, F.lit(False)).otherwise(F.abs(F.col("mean") - F.col("gm")) > 3 * error)
    return own.join(F.broadcast(whole), "name").select(label, "name", "size", "mean", F.sqrt("var").alias("std"), stands.alias("significant"))


def cluster_view(df: DataFrame, schema: StudySchema, space: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(df with pc1, pc2 and label, statistics): components, k-means on them, statistics of the original columns."""
    found = pca(df, features(df, schema, space), 2)
    if found is None:
        raise ValueError("nothing to cluster")
    names = [c for c in ("pc1", "pc2") if c in found[0].columns]
    labelled, _, _ = kmeans(found[0], names, k, schema.id)
    numeric = [*schema.numeric(df, schema.params), *schema.objectives]
    return labelled, cluster_stats(labelled, "label", numeric)
