"""Dominance: fronts, ranks, hypervolume and its history, comparison of studies.

The front of a union is the front of the parts' fronts, so a first pass keeps
each partition's own front, and only survivors meet, part by part.

A rank is one more than the greatest rank of the vectors that dominate a vector.
In lexicographic order these come first, so blocks of that order are ranked one
after another: all earlier blocks send a block their vectors that can matter to it,
spread over tasks, and one task ranks the block's own few thousand. There are as
many rounds as blocks, however many fronts there are.

The history of the hypervolume cuts a study's rows into blocks of their order. A
block is summed up by its front, prefixes of these are merged in logarithmic
rounds, and each block then replays its rows from the front of all rows before it.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from optiloom.functions.ordered import scan
from optiloom.functions.schema import StudySchema, finite
from optiloom.functions.storage import Scratch, saved

#: Distinct objective vectors that one task ranks among themselves.
RANKED = 8192
#: Survivors of the partitions' own fronts in one part; pairs of parts meet.
MERGED = 16_384
#: Low bits of the positions that one block of a hypervolume history holds.
HISTORY_BITS = 16
_BLOCK = 512


def skyline(points: np.ndarray) -> np.ndarray:
    """Mask of the rows (costs) that no other row dominates; equal rows don't dominate each other."""
    order = np.lexsort(points.T[::-1])
    sorted_ = points[order]
    keep = np.zeros(len(points), bool)
    front = np.empty((0, points.shape[1]))
    for low in range(0, len(sorted_), _BLOCK):  # a row is dominated only by rows before it in this order
        block = sorted_[low : low + _BLOCK]
        alive = np.ones(len(block), bool)
        for a in range(0, len(front), 4096):
            part = front[a : a + 4096]
            alive &= ~((part[None] <= block[:, None]).all(2) & (part[None] < block[:, None]).any(2)).any(1)
        inner = block[alive]
        if len(inner):
            worse = ((inner[None] <= inner[:, None]).all(2) & (inner[None] < inner[:, None]).any(2)).any(1)
            at = np.flatnonzero(alive)
            alive[at[worse]] = False
            front = np.concatenate([front, inner[~worse]])
        keep[order[low : low + _BLOCK]] = alive
    return keep


def chain_ranks(points: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Ranks of distinct rows in lexicographic order; ``below`` holds each row's greatest rank of a dominating row outside (0: none)."""
    rank = below.astype(int) + 1

    def spread(low: int, middle: int, high: int) -> None:
        """Ranks of the first part raise those of the second."""
        for a in range(low, middle, _BLOCK):
            part, to = slice(a, min(a + _BLOCK, middle)), slice(middle, high)
            over = (points[part][:, None] <= points[to][None]).all(2)
            np.maximum(rank[to], np.where(over, rank[part][:, None] + 1, 0).max(0), out=rank[to])

    def solve(low: int, high: int) -> None:
        if high - low <= 16:
            for i in range(low + 1, high):
                over = (points[low:i] <= points[i]).all(1)
                if over.any():
                    rank[i] = max(rank[i], rank[low:i][over].max() + 1)
            return
        middle = (low + high) // 2
        solve(low, middle)
        spread(low, middle, high)
        solve(middle, high)

    solve(0, len(points))
    return rank


def matters_later(points: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Mask of the rows that a later row's rank can depend on: no other row is as low in all costs but the first, at the same rank or a higher one."""
    rest = points[:, 1:]
    order = np.lexsort((*rest.T[::-1], -rank))  # what makes a row needless stands before it
    keep = np.ones(len(rest), bool)
    if rest.shape[1] == 1:
        least = np.minimum.accumulate(rest[order, 0])
        keep[order[1:]] = rest[order[1:], 0] < least[:-1]
        return keep
    held = np.empty((0, rest.shape[1]))
    for low in range(0, len(order), _BLOCK):
        block = rest[order[low : low + _BLOCK]]
        alive = np.ones(len(block), bool)
        for a in range(0, len(held), 4096):
            alive &= ~(held[a : a + 4096][None] <= block[:, None]).all(2).any(1)
        inner = np.flatnonzero(alive)
        over = np.tril((block[inner][None] <= block[inner][:, None]).all(2), -1)
        alive[inner[over.any(1)]] = False
        held = np.concatenate([held, block[alive]])
        keep[order[low : low + _BLOCK]] = alive
    return keep


def _costs(df: DataFrame, schema: StudySchema) -> tuple[DataFrame, list[str]]:
    names = [f"__c{k}" for k in range(len(schema.objectives))]
    return df.withColumns({n: schema.cost(k).cast("double") for k, n in enumerate(names)}), names


def _nan_free(names: Sequence[str]):
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(n)
    return out


def _local_fronts(vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    names = list(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, len(names)))
        for f in frames:
            held = np.concatenate([held, f[names].to_numpy()])
            held = held[skyline(held)]
        yield pd.DataFrame(held, columns=names)

    return vectors.select(*names).mapInPandas(run, ", ".join(f"{n} double" for n in names))


def _front_vectors(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct vectors of the first front.

    What survives in its own partition is dealt to parts of ``MERGED`` vectors, and
    every pair of parts meets in a task that finds the vectors of the one which the
    other one dominates: no task sees more than two parts, however large the front is.
    """
    names = list(names)
    local = saved(_local_fronts(df.select(*names).distinct(), names))
    parts = max(1, -(-local.count() // MERGED))
    own, every = F.pmod(F.hash(*names), F.lit(parts)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    judged = local.select(*names, own.alias("__i"), every.alias("__j"), F.lit(True).alias("__judged"))
    rivals = local.select(*names, every.alias("__i"), own.alias("__j"), F.lit(False).alias("__judged"))

    def beaten(f: pd.DataFrame) -> pd.DataFrame:
        mine = f["__judged"].to_numpy(bool)
        points, others = f.loc[mine, names].to_numpy(float), f.loc[~mine, names].to_numpy(float)
        others = others[skyline(others)]
        gone = np.zeros(len(points), bool)
        for low in range(0, len(points), _BLOCK):
            block = points[low : low + _BLOCK][:, None]
            for a in range(0, len(others), 4096):
                some = others[a : a + 4096][None]
                gone[low : low + _BLOCK] |= ((some <= block).all(2) & (some < block).any(2)).any(1)
        return pd.DataFrame(points[gone], columns=names)

    lost = judged.unionByName(rivals).groupBy("__i", "__j").applyInPandas(beaten, ", ".join(f"{n} double" for n in names))
    return local.join(lost, names, "left_anti").distinct()


def front(df: DataFrame, schema: StudySchema) -> DataFrame:
    """Rows that no row dominates; rows with NaN are left out."""
    costed, names = _costs(df, schema)
    return costed.where(_nan_free(names)).join(_front_vectors(costed.where(_nan_free(names)), names), list(names), "left_semi").drop(*names)


def _ranked_vectors(vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """The distinct ``vectors`` with their ``rank``."""
    names = list(names)
    work = Scratch(vectors.sparkSession)
    placed = work.save(scan(vectors, tuple(names), place="__p"))
    fields = "__p long, " + ", ".join(f"{n} double" for n in names) + ", rank int, keep boolean"

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__p", kind="stable")
        points = f[names].to_numpy(float)
        rank = chain_ranks(points, f["below"].fillna(0).to_numpy())
        return f[["__p", *names]].assign(rank=rank.astype("int32"), keep=matters_later(points, rank))

    done: list[DataFrame] = []
    for low in range(0, max(placed.count(), 1), RANKED):
        block = placed.where(F.col("__p").between(low, low + RANKED - 1))
        if done:
            earlier = done[0]
            for part in done[1:]:
                earlier = earlier.unionByName(part)
            own = block.select(F.col("__p").alias("__at"), *[F.col(n).alias(f"{n}_at") for n in names])
            over = F.lit(True)
            for n in names:
                over = over & (F.col(n) <= F.col(f"{n}_at"))
            below = earlier.where("keep").join(F.broadcast(own), over).groupBy(F.col("__at").alias("__p")).agg(F.max("rank").alias("below"))  # at most RANKED rows
            block = block.join(below, "__p", "left")
        else:
            block = block.withColumn("below", F.lit(None).cast("int"))
        done.append(work.save(block.groupBy(F.lit(low).alias("__low")).applyInPandas(settle, fields)))
    ranked = done[0]
    for part in done[1:]:
        ranked = ranked.unionByName(part)
    return ranked.select(*names, "rank")


def ranks(df: DataFrame, schema: StudySchema, max_rank: int | None = None) -> DataFrame:
    """``rank`` from 1. With one objective or none all rank 1; rows with NaN rank one below all others.

    With ``max_rank`` deeper rows get ``max_rank + 1``.
    """
    if len(schema.objectives) < 2:
        return df.withColumn("rank", F.lit(1))
    costed, names = _costs(df, schema)
    ranked = _ranked_vectors(costed.where(_nan_free(names)).select(*names).distinct(), names)
    last = ranked.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("__last"))
    found = F.coalesce("rank", F.col("__last") + 1)
    joined = costed.join(ranked, names, "left").crossJoin(F.broadcast(last))  # a row
    return joined.withColumn("rank", (found if max_rank is None else F.least(found, F.lit(max_rank + 1))).cast("int")).drop("__last", *names)


def reference_point(df: DataFrame, schema: StudySchema) -> DataFrame:
    """One row r0..: worst plus a tenth of the spread plus one, per objective as costs."""
    cols = [(F.max(schema.cost(k)) + 0.1 * F.abs(F.max(schema.cost(k)) - F.min(schema.cost(k))) + 1).alias(f"r{k}") for k in range(len(schema.objectives))]
    return df.agg(*cols)


def hypervolume(df: DataFrame, schema: StudySchema, true_area: bool = False) -> DataFrame:
    """``hv`` of the first front over objectives 0 and 1, from its own reference point; null with fewer than two front rows.

    Strips between neighbouring first costs, each as high as the left one's second
    cost leaves. With three objectives or more, front rows can dominate each other
    in these two; the strips are taken as they are then, or with ``true_area`` those
    of the lowest second cost so far.
    """
    if len(schema.objectives) < 2:
        return df.sparkSession.createDataFrame([(None,)], "hv double")
    on = front(df, schema)
    ref = reference_point(on, schema)
    size = on.agg(F.count(F.lit(1)).alias("n"))
    x, y = schema.cost(0).cast("double").alias("x"), schema.cost(1).cast("double").alias("y")
    inside = on.select(x, y, F.col(schema.id).alias("__id")).crossJoin(F.broadcast(ref)).where((F.col("x") < F.col("r0")) & (F.col("y") < F.col("r1")))  # a row
    if true_area:
        inside = scan(inside, ("x", "y"), {"low": (F.col("y"), F.min)}).withColumn("y", F.col("low"))
    back = inside.withColumn("__x", -F.col("x")).withColumn("__place", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("__id"))))
    steps = scan(back.where("__place = 1"), ("__x",), {"to": (F.col("x"), F.min)}, before={"to": "next"})  # of equal first costs the last row counts
    total = steps.agg(F.sum((F.coalesce("next", "r0") - F.col("x")) * (F.col("r1") - F.col("y"))).alias("v"))
    return size.crossJoin(F.broadcast(total)).select(F.when(F.col("n") >= 2, F.col("v")).alias("hv"))  # a row each


class Staircase:
    """Area dominated by the points so far, x ascending and y descending."""

    def __init__(self, ref: Sequence[float]):
        self.ref, self.xs, self.ys, self.area = ref, [], [], 0.0

    def add(self, point: Sequence[float]) -> None:
        x, y = point[0], point[1]
        if not (x < self.ref[0] and y < self.ref[1]):
            return
        xs, ys = self.xs, self.ys
        at = bisect.bisect_right(xs, x)
        if at and ys[at - 1] <= y:
            return
        low = end = bisect.bisect_left(xs, x)
        top, left = ys[low - 1] if low else self.ref[1], x
        while end < len(xs) and ys[end] >= y:
            self.area += (xs[end] - left) * (top - y)
            left, top = xs[end], ys[end]
            end += 1
        self.area += ((xs[end] if end < len(xs) else self.ref[0]) - left) * (top - y)
        xs[low:end], ys[low:end] = [x], [y]


class Strips:
    """The front of the points so far in all costs, and its strips over the first two: equal first costs stand in the order in which they came."""

    def __init__(self, ref: Sequence[float], m: int):
        self.ref, self.front, self.area = ref, np.empty((0, m)), 0.0

    def add(self, point: Sequence[float]) -> None:
        p, front = np.asarray(point, float), self.front
        if ((front <= p).all(1) & (front < p).any(1)).any():
            return
        front = self.front = np.vstack([front[~((p <= front).all(1) & (p < front).any(1))], p])
        inside = front[(front[:, 0] < self.ref[0]) & (front[:, 1] < self.ref[1])]
        inside = inside[np.argsort(inside[:, 0], kind="stable")]
        self.area = float((np.diff(np.append(inside[:, 0], self.ref[0])) * (self.ref[1] - inside[:, 1])).sum()) if len(inside) else 0.0


def _block_fronts(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys, __t and costs of each group's front; of equal vectors the last one stays."""
    names = list(names)
    columns = [*keys, "__t", *names]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__t").drop_duplicates(names, keep="last")
        return f.loc[skyline(f[names].to_numpy(float)), columns]

    return rows.select(*columns).groupBy(*keys).applyInPandas(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns))


def hypervolume_history(df: DataFrame, schema: StudySchema, by: Sequence[str] = (), order: str | None = None, true_area: bool = False) -> DataFrame:
    """by, order and ``hv`` after each row, the reference point taken from all rows of the study; rows with NaN repeat the value before.

    For three objectives or more the volume is that of :func:`hypervolume`, over the
    front in all objectives. Orders are unique within a study.
    """
    order, by = order or schema.id, list(by)
    if len(schema.objectives) < 2:
        return df.select(*by, order, F.lit(0.0).alias("hv"))
    costed, every = _costs(df, schema)
    rows = costed.select(*by, order, *every, _nan_free(every).alias("__ok"))
    rows = saved(scan(rows, (order,), by=tuple(by), place="__t").withColumn("__block", F.shiftright("__t", HISTORY_BITS)))
    last = rows.agg(F.max("__block").alias("b")).first().b or 0
    good = rows.where("__ok")
    worst, best = ([how(n) for n in every[:2]] for how in (F.max, F.min))
    ref = good.groupBy(*by).agg(*[(w + 0.1 * F.abs(w - b) + 1).alias(f"__r{k}") for k, (w, b) in enumerate(zip(worst, best, strict=True))])

    names = every[:2] if true_area else every
    keys = [*by, "__block"]
    fronts, reach = _block_fronts(good, keys, names), 1
    while reach <= last:  # the front of a block and of the 2 * reach - 1 before it
        fronts = saved(fronts)
        shifted = fronts.withColumn("__block", F.col("__block") + reach).where(F.col("__block") <= last)
        fronts, reach = _block_fronts(fronts.unionByName(shifted), keys, names), 2 * reach
    prior = fronts.withColumn("__block", F.col("__block") + 1).where(F.col("__block") <= last)
    prior = prior.withColumn(order, F.lit(None).cast(rows.schema[order].dataType)).withColumn("__ok", F.lit(True)).withColumn("__own", F.lit(False))
    both = rows.select(*keys, order, "__t", *names, "__ok").withColumn("__own", F.lit(True)).unionByName(prior)
    on = F.lit(True)
    for k, c in enumerate(by):
        ref = ref.withColumnRenamed(c, f"__by{k}")
        on = on & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    both = both.join(ref, on, "left")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["__own", "__t"])
        point = (float(f["__r0"].iloc[0]), float(f["__r1"].iloc[0]))
        state = Staircase(point) if len(names) == 2 else Strips(point, len(names))
        values = np.zeros(len(f))
        for i, (p, ok) in enumerate(zip(f[names].to_numpy(float), f["__ok"].to_numpy(bool), strict=True)):
            if ok:
                state.add(p)
            values[i] = state.area
        return f[[*by, order]].assign(hv=values)[f["__own"].to_numpy(bool)]

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, order]) + ", hv double"
    return both.groupBy(*keys).applyInPandas(run, fields)


def front_line(df: DataFrame, schema: StudySchema) -> DataFrame:
    """The front in the order of its first objective, as a line is drawn through it."""
    return front(df, schema).orderBy(schema.objectives[0], schema.id)


def drawn_as_front(df: DataFrame, schema: StudySchema) -> DataFrame:
    """Rows that a view marks as the front: the front, and rows with a NaN objective, which nothing dominates.

    Unlike :func:`front`, which leaves these out.
    """
    odd = F.lit(False)
    for o in schema.objectives:
        odd = odd | F.isnan(F.col(o).cast("double"))
    columns = df.columns
    return front(df.where(~F.coalesce(odd, F.lit(False))), schema).select(*columns).unionByName(df.where(odd))


def ranks_and_volume(df: DataFrame, schema: StudySchema) -> tuple[DataFrame, DataFrame, float | None]:
    """(rows with ranks, ids of rank 1, hypervolume of these); the volume only for two objectives or more and two such rows or more."""
    ranked = ranks(df, schema)
    best = ranked.where("rank = 1").select(schema.id)
    enough = len(schema.objectives) >= 2 and best.limit(2).count() == 2
    return ranked, best, hypervolume(df, schema).first().hv if enough else None


def comparable(a: Sequence[str], b: Sequence[str]) -> bool:
    """Whether two studies have the same directions in the same order."""
    return list(a) == list(b)


def dominance_ratio(main: DataFrame, other: DataFrame, schema: StudySchema) -> DataFrame:
    """Share of the pooled front that comes from each study, whole per cent; null if either has no finite row."""
    ok = F.lit(True)
    for o in schema.objectives:
        ok = ok & finite(F.col(o).cast("double"))
    pooled = main.where(ok).select(*schema.objectives, F.lit("main").alias("study")).unionByName(other.where(ok).select(*schema.objectives, F.lit("other").alias("study")))
    sizes = pooled.agg(F.count(F.when(F.col("study") == "main", 1)).alias("a"), F.count(F.when(F.col("study") == "other", 1)).alias("b"))
    counts = front(pooled, schema).agg(F.count(F.when(F.col("study") == "main", 1)).alias("m"), F.count(F.when(F.col("study") == "other", 1)).alias("o"))
    share = lambda c: F.when((F.col("a") > 0) & (F.col("b") > 0), F.round(100 * F.col(c) / F.when(F.col("m") + F.col("o") > 0, F.col("m") + F.col("o")))).cast("int")
    return counts.crossJoin(F.broadcast(sizes)).select(share("m").alias("main_pct"), share("o").alias("other_pct"), F.lit(0).alias("non_dominated"))


#: Studies that one study is compared with at most.
MAX_COMPARED = 4


def comparisons(main: DataFrame, schema: StudySchema, others: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> dict[str, tuple[str | None, DataFrame | None]]:
    """:func:`comparison` with each of up to ``MAX_COMPARED`` named (rows, directions)."""
    if len(others) > MAX_COMPARED:
        raise ValueError(f"at most {MAX_COMPARED} studies can be compared with one")
    return {name: comparison(main, rows, schema, directions) for name, (rows, directions) in others.items()}


def comparison(main: DataFrame, other: DataFrame, schema: StudySchema, other_directions: Sequence[str]) -> tuple[str | None, DataFrame | None]:
    """(message, None) for studies that can't be compared, else (None, ratio)."""
    if len(schema.directions) != len(other_directions):
        return "The studies have different numbers of objectives.", None
    if not comparable(schema.directions, other_directions):
        return "The studies optimize in different directions.", None
    return None, dominance_ratio(main, other, schema)
