"""Random-forest regression: bootstrap trees over all features with exact midpoint thresholds.

All rows stay distributed. How often a row is in a tree's bootstrap is drawn from a
hash of its id and the tree (Poisson with mean 1), so it does not depend on where the
row lies. A node with many rows is split by sums over the distinct values of each
feature, added up before they are shuffled, and running sums over these values. A
node with at most ``NODE_ROWS`` rows is sent to one task, which grows the tree below
it. Both take the greatest drop in squared error over all midpoints of neighbouring
values, so the limit moves work, not results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiloom.functions import blocks
from optiloom.functions.ordered import scan
from optiloom.functions.schema import EPS

TREES, DEPTH, LEAF, SEED = 100, 10, 2, 42
#: Rows of a node up to which one task grows what is below it.
NODE_ROWS = 100_000
#: Least drop in squared error of a split.
GAIN = 1e-12

Node = tuple[int, float, int, int]  # feature (-1: a leaf), threshold or value, left, right
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def draws(h: np.ndarray, tree: int) -> np.ndarray:
    """How often each row (by the hash of its id) is in a tree's bootstrap."""
    x = h.view(np.uint64) + np.uint64((SEED + (tree + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, side="right")


def _gains(n: np.ndarray, left: np.ndarray, whole: float, total: float, leaf: int) -> np.ndarray:
    """Drop in squared error for left parts of ``n`` rows with sum ``left``; none for parts below ``leaf`` rows."""
    fits = (n >= leaf) & (whole - n >= leaf)
    inner = np.where(fits, n, 1), np.where(fits, whole - n, 1)
    return np.where(fits, left**2 / inner[0] + (total - left) ** 2 / inner[1] - total**2 / whole, -np.inf)


def _best_split(x: np.ndarray, y: np.ndarray, w: np.ndarray, leaf: int) -> tuple[int, float] | None:
    """(feature, threshold) of the greatest drop in squared error, at least ``leaf`` rows a side."""
    best, found = GAIN, None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        xs, n, total = x[order, j], np.cumsum(w[order]), np.cumsum((w * y)[order])
        at = np.flatnonzero(xs[1:] > xs[:-1]) + 1
        if not len(at):
            continue
        gain = _gains(n[at - 1], total[at - 1], n[-1], total[-1], leaf)
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (j, float((xs[at[k] - 1] + xs[at[k]]) / 2))
    return found


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, depth: int = DEPTH, leaf: int = LEAF) -> list[Node]:
    """Nodes of a tree over rows of weight ``w``, the root first."""
    w = np.ones(len(y)) if w is None else w
    nodes: list[Node] = []

    def build(rows: np.ndarray, left: int) -> int:
        at, n = len(nodes), w[rows].sum()
        nodes.append((-1, float((w[rows] * y[rows]).sum() / n), -1, -1))
        split = _best_split(x[rows], y[rows], w[rows], leaf) if left > 0 and n >= 2 * leaf else None
        if split:
            go = x[rows, split[0]] <= split[1]
            nodes[at] = (split[0], split[1], build(rows[go], left - 1), build(rows[~go], left - 1))
        return at

    build(np.arange(len(y)), depth)
    return nodes


def _places(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    """The node at which each row ends."""
    feature, value, left, right = (np.array(c) for c in zip(*nodes, strict=True))
    at = np.zeros(len(x), int)
    while (live := feature[at] >= 0).any():
        k = at[live]
        at[live] = np.where(x[live, feature[k]] <= value[k], left[k], right[k])
    return at


def predict(trees: list[list[Node]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for nodes in trees:
        total += np.array([n[1] for n in nodes])[_places(nodes, x)]
    return total / len(trees)


@dataclass
class _Growing:
    """Trees whose open nodes (depth by node) wait for a split or for the tree below them."""

    trees: list[list[Node]]
    open: list[dict[int, int]] = field(default_factory=list)

    def leaf(self, tree: int, node: int, value: float) -> None:
        self.trees[tree][node] = (-1, value, -1, -1)
        del self.open[tree][node]

    def split(self, tree: int, node: int, feature: int, threshold: float) -> tuple[int, int]:
        nodes, depth = self.trees[tree], self.open[tree].pop(node)
        left, right = len(nodes), len(nodes) + 1
        nodes[node] = (feature, threshold, left, right)
        nodes += [(-1, 0.0, -1, -1)] * 2
        self.open[tree] |= {left: depth + 1, right: depth + 1}
        return left, right

    def graft(self, tree: int, node: int, below: list[Node]) -> None:
        """``below`` takes the place of an open node."""
        nodes = self.trees[tree]
        at = [node, *range(len(nodes), len(nodes) + len(below) - 1)]
        moved = [(f, v, at[a] if a >= 0 else -1, at[b] if b >= 0 else -1) for f, v, a, b in below]
        nodes[node] = moved[0]
        nodes += moved[1:]
        del self.open[tree][node]


def _drawn(trees: list[list[Node]], wanted: list[set[int]], p: int, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each tree the rows drawn for it that end in its wanted nodes: (tree, node, hash, features, target, count)."""
    h, data = batch.column("h").to_numpy(), blocks.matrix(batch, [*(f"x{j}" for j in range(p)), "y"])
    for t, nodes in enumerate(trees):
        if not wanted[t]:
            continue
        w = draws(h, t)
        rows = np.flatnonzero(w)
        at = _places(nodes, data[rows, :-1])
        keep = np.isin(at, list(wanted[t]))
        rows = rows[keep]
        yield t, at[keep], h[rows], data[rows, :-1], data[rows, -1], w[rows]


def _split_large(rows: DataFrame, p: int, now: _Growing, wanted: list[set[int]], leaf: int) -> dict[tuple[int, int], tuple[float, float, tuple[int, float, float] | None]]:
    """For each wanted node: count, sum, and (feature, threshold, count on the left) of its best split."""
    trees = now.trees

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, node, _, x, y, w in _drawn(trees, wanted, p, batch):
                for j in range(p):
                    keys = pd.DataFrame({"node": node, "value": x[:, j], "n": w.astype(float), "s": w * y})
                    found = keys.groupby(["node", "value"], as_index=False).sum()
                    yield pa.RecordBatch.from_pydict({"tree": np.full(len(found), t), "node": found["node"].to_numpy(), "feature": np.full(len(found), j), "value": found["value"].to_numpy(), "n": found["n"].to_numpy(), "s": found["s"].to_numpy()})

    keys = ("tree", "node", "feature")
    values = rows.mapInArrow(sums, "tree long, node long, feature long, value double, n double, s double")
    values = values.groupBy(*keys, "value").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    running = {"upto_n": (F.col("n"), F.sum), "upto_s": (F.col("s"), F.sum), "upto_v": (F.col("value"), F.max)}
    steps = scan(values, ("value",), running, keys, before={"upto_n": "left_n", "upto_s": "left_s", "upto_v": "below"})
    whole = steps.groupBy(*keys).agg(F.max("upto_n").alias("all_n"), F.sum("s").alias("all_s"))  # a row a node and feature
    steps = steps.where(F.col("below").isNotNull()).join(whole, list(keys))
    right = F.col("all_n") - F.col("left_n")
    gain = F.pow("left_s", F.lit(2)) / F.col("left_n") + F.pow(F.col("all_s") - F.col("left_s"), F.lit(2)) / right - F.pow("all_s", F.lit(2)) / F.col("all_n")
    fits = steps.where((F.col("left_n") >= leaf) & (right >= leaf)).withColumn("gain", gain).where(F.col("gain") > GAIN)
    first = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("value")).alias("v"), ((F.col("below") + F.col("value")) / 2).alias("threshold"), "left_n")
    best = {(r.tree, r.node): (-r.b.f, r.b.threshold, r.b.left_n) for r in fits.groupBy("tree", "node").agg(F.max(first).alias("b")).collect()}  # a row a node
    return {(r.tree, r.node): (r.all_n, r.all_s, best.get((r.tree, r.node))) for r in whole.where("feature = 0").collect()}


def _grow_small(rows: DataFrame, p: int, now: _Growing, wanted: list[set[int]], depth: int, leaf: int) -> None:
    """Every wanted node's rows meet in one task, which grows the tree below."""
    trees, depths = now.trees, [dict(d) for d in now.open]
    names = [f"x{j}" for j in range(p)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, node, h, x, y, w in _drawn(trees, wanted, p, batch):
                yield pa.RecordBatch.from_pydict({"tree": np.full(len(y), t), "node": node, "h": h, **{n: x[:, j] for j, n in enumerate(names)}, "y": y, "w": w})

    def below(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["h", *names, "y"], kind="stable")  # so that sums do not depend on how rows came
        t, node = int(f["tree"].iloc[0]), int(f["node"].iloc[0])
        nodes = grow(f[names].to_numpy(float), f["y"].to_numpy(float), f["w"].to_numpy(float), depth - depths[t][node], leaf)
        return pd.DataFrame([(t, node, i, *n) for i, n in enumerate(nodes)], columns=["tree", "node", "i", "feature", "value", "l", "r"])

    drawn = rows.mapInArrow(send, "tree long, node long, h long, " + ", ".join(f"{n} double" for n in names) + ", y double, w long")
    found = drawn.groupBy("tree", "node").applyInPandas(below, "tree long, node long, i int, feature int, value double, l int, r int").toPandas()  # nodes of the trees
    for (t, node), g in found.groupby(["tree", "node"]):
        now.graft(int(t), int(node), list(g.sort_values("i")[["feature", "value", "l", "r"]].itertuples(index=False, name=None)))


def fit(rows: DataFrame, p: int, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF) -> list[list[Node]]:
    """Trees over ``rows`` (h: hash of the id, x0.. of ``p`` features, y), which are read once for each level of large nodes and once for all small ones."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).first()
    now = _Growing([[(-1, 0.0, -1, -1)] for _ in range(trees)], [{0: 0} for _ in range(trees)])
    counts = {(t, 0): float(size.n) for t in range(trees)}
    while True:
        large = [{n for n, d in own.items() if counts[t, n] > NODE_ROWS and d < depth} for t, own in enumerate(now.open)]
        if not any(large):
            break
        for (t, node), (n, total, split) in _split_large(rows, p, now, large, leaf).items():
            if split is None:
                now.leaf(t, node, total / n)
                continue
            left, right = now.split(t, node, split[0], split[1])
            counts[t, left], counts[t, right] = split[2], n - split[2]
    _grow_small(rows, p, now, [set(own) for own in now.open], depth, leaf)
    for t, own in enumerate(now.open):
        for node in list(own):  # only where a tree's bootstrap is empty
            now.leaf(t, node, size.mean)
    return now.trees


def r_squared_over(rows: DataFrame, p: int, trees: list[list[Node]]) -> float:
    """R² over all rows of (x0.., y)."""

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, shift = a[0] + b[0], b[1] - a[1]
        return np.array([n, a[1] + shift * b[0] / n, a[2] + b[2] + shift * shift * a[0] * b[0] / n, a[3] + b[3]])

    def step(state: np.ndarray | None, batch: pa.RecordBatch) -> np.ndarray:
        data = blocks.matrix(batch, [*(f"x{j}" for j in range(p)), "y"])
        y = data[:, -1]
        own = np.array([len(y), y.mean(), ((y - y.mean()) ** 2).sum(), ((y - predict(trees, data[:, :-1])) ** 2).sum()])
        return own if state is None else merge(state, own)

    state = blocks.fold(rows, step, merge)
    return 1.0 if state is None or state[2] < EPS else float(1 - state[3] / state[2])


def r_squared(y: np.ndarray, fitted: np.ndarray) -> float:
    """Not clamped; 1 for a constant target."""
    total = ((y - y.mean()) ** 2).sum()
    return 1.0 if total < EPS else float(1 - ((y - fitted) ** 2).sum() / total)
