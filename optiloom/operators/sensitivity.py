"""Which params matter: rank correlation, ridge coefficients, Sobol indices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from optiloom.functions import blocks
from optiloom.functions.ordered import running, with_position
from optiloom.functions.schema import EPS, StudySchema, finite
from optiloom.functions.storage import saved
from optiloom.operators.filters import long_form

SOBOL_SEED = 0xDEADBEEF12345678


def label_encode(df: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """Codes 0, 1, 2, ... of the labels by first appearance in ``order``; null counts as a label."""
    seen = df.groupBy(F.col(column).alias("__label")).agg(F.min(order).alias("__first"))
    codes = with_position(seen, "__first", "__code").select("__label", F.col("__code").cast("double").alias(out))
    return df.join(codes, df[column].eqNullSafe(codes["__label"])).drop("__label")


def encoded(df: DataFrame, schema: StudySchema) -> tuple[DataFrame, list[str]]:
    """``df`` with every text param as codes; returns the names of the numeric stand-ins."""
    kinds, names = dict(df.dtypes), []
    for p in schema.params:
        if kinds[p] == "string":
            df = label_encode(df, p, schema.id, f"{p}__code")
        names.append(f"{p}__code" if kinds[p] == "string" else p)
    return df, names


def average_ranks(df: DataFrame, names: Sequence[str], id_col: str) -> DataFrame:
    """id, name, value and average rank from 1 (NaN last) of every named column.

    Ranks come from counts of distinct values, so equal values cost one row; the
    running count goes over ranges of (name, value), so that one column's values
    are spread over tasks.
    """
    rows = long_form(df, names, id_col)
    counts = rows.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = running(counts, ("name", "value"), F.col("n"), F.sum, "__upto", by=("name",))
    ranked = upto.select(F.col("name").alias("__name"), F.col("value").alias("__v"), (F.col("__upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    return rows.join(ranked, (F.col("name") == F.col("__name")) & F.col("value").eqNullSafe(F.col("__v"))).select(id_col, "name", "value", "rank")


def _correlation(x, y):
    """Pearson correlation as an aggregate; 0 for fewer than two rows or a constant side."""
    down = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when((F.count(F.lit(1)) < 2) | (down < EPS), 0.0).otherwise(F.try_divide(F.covar_pop(x, y), down))


def spearman_matrix(df: DataFrame, schema: StudySchema) -> DataFrame:
    """param, objective, rho for every pair; text params by their codes; rows with NaN objectives are left out."""
    ok = F.lit(True)
    for o in schema.objectives:
        ok = ok & finite(F.col(o).cast("double"))
    coded, names = encoded(df.where(ok), schema)
    every = [*names, *schema.objectives]
    narrow = saved(coded.select(schema.id, *[F.col(c).cast("double").alias(c) for c in every]))  # read by counts and by ranks
    ranks = average_ranks(narrow, every, schema.id)
    wide = ranks.groupBy(schema.id).pivot("name", every).agg(F.first("rank"))
    pairs = [(p, n, o) for p, n in zip(schema.params, names, strict=True) for o in schema.objectives]
    row = wide.agg(*[_correlation(F.col(n), F.col(o)).alias(f"__r{i}") for i, (_, n, o) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(o).alias("objective"), F.col(f"__r{i}").alias("rho")) for i, (p, _, o) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


@dataclass
class Moments:
    """Count, means and centered cross products of columns: everything a linear fit needs."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    @property
    def std(self) -> np.ndarray:
        s = np.sqrt(np.maximum(np.diag(self.cross) / max(self.n, 1), 0))
        return np.where(s < EPS, 1.0, s)


def moments(df: DataFrame, columns: Sequence) -> Moments:
    """Moments of all rows whose columns are all finite, in one pass.

    Every task adds up centered cross products as matrix products of whole
    batches; states of two tasks merge by the difference of their means, so large
    means cost no digits and the plan does not grow with the number of columns.
    """
    c = [F.col(x).cast("double") if isinstance(x, str) else x.cast("double") for x in columns]
    p = len(c)

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb = a[0], b[0]
        if not na or not nb:
            return a if na else b
        shift = b[1 : p + 1] - a[1 : p + 1]
        cross = a[p + 1 :] + b[p + 1 :] + (np.outer(shift, shift) * (na * nb / (na + nb))).ravel()
        return np.concatenate([[na + nb], a[1 : p + 1] + shift * (nb / (na + nb)), cross])

    def step(state: np.ndarray | None, batch) -> np.ndarray:
        x = blocks.matrix(batch)
        x = x[np.isfinite(x).all(axis=1)]
        mean = x.mean(axis=0) if len(x) else np.zeros(p)
        own = np.concatenate([[len(x)], mean, ((x - mean).T @ (x - mean)).ravel()])
        return own if state is None else merge(state, own)

    found = blocks.fold(df.select(*[x.alias(f"c{i}") for i, x in enumerate(c)]), step, merge)
    if found is None:
        return Moments(0, np.zeros(p), np.zeros((p, p)))
    return Moments(int(found[0]), found[1 : p + 1], found[p + 1 :].reshape(p, p))


@dataclass
class Ridge:
    """Coefficients of standardized inputs, fit quality and the scales they refer to."""

    beta: np.ndarray
    r2: float
    mean: np.ndarray
    std: np.ndarray
    y_mean: float


def ridge_from(m: Moments, y: int, alpha: float = 1.0) -> Ridge:
    """Ridge of column ``y`` on the columns before the objectives: (Z'Z + alpha I) beta = Z'y with Z standardized."""
    p = len(m.mean) - y if y < 0 else y
    x = np.arange(p)
    std = m.std[x]
    gram = m.cross[np.ix_(x, x)] / np.outer(std, std)
    zy = m.cross[x, y] / std
    try:
        system = gram + alpha * np.eye(p)
        beta = np.linalg.solve(system, zy) if np.linalg.cond(system) < 1e15 else np.zeros(p)
    except np.linalg.LinAlgError:
        beta = np.zeros(p)
    total = m.cross[y, y]
    rest = total - 2 * beta @ zy + beta @ gram @ beta
    return Ridge(beta, 0.0 if total < EPS else max(0.0, 1 - rest / total), m.mean[x], std, m.mean[y])


def ridge_fits(df: DataFrame, inputs: Sequence, objectives: Sequence[str], alpha: float = 1.0) -> list[Ridge]:
    """One fit per objective from a single pass; rows with a non-finite objective are left out of all."""
    ok = F.lit(True)
    for o in objectives:
        ok = ok & finite(F.col(o).cast("double"))
    m = moments(df.where(ok), [*inputs, *objectives])
    p = len(inputs)
    out = []
    for k in range(len(objectives)):
        at = [*range(p), p + k]
        out.append(ridge_from(Moments(m.n, m.mean[at], m.cross[np.ix_(at, at)]), p, alpha))
    return out


def ridge_table(df: DataFrame, schema: StudySchema, alpha: float = 1.0) -> DataFrame:
    """param, objective, beta, r2."""
    coded, names = encoded(df, schema)
    fits = ridge_fits(coded, names, schema.objectives, alpha)
    rows = [(p, o, float(f.beta[i]), float(f.r2)) for o, f in zip(schema.objectives, fits, strict=True) for i, p in enumerate(schema.params)]
    return df.sparkSession.createDataFrame(rows, "param string, objective string, beta double, r2 double")


def sensitivity(df: DataFrame, schema: StudySchema, selection: DataFrame | None = None) -> DataFrame:
    """param, objective, rho, beta, r2; with a selection of ids, of those rows only (codes are those of all rows)."""
    if not schema.params or not schema.objectives or df.limit(2).count() < 2:
        return df.sparkSession.createDataFrame([], "param string, objective string, rho double, beta double, r2 double")
    coded, names = encoded(df, schema)
    if selection is not None:
        coded = coded.join(selection.select(schema.id).distinct(), schema.id, "left_semi")
    plain = StudySchema(tuple(names), schema.objectives, schema.directions, (), schema.id)
    back = dict(zip(names, schema.params, strict=True))
    name = F.create_map(*[x for k, v in back.items() for x in (F.lit(k), F.lit(v))])
    both = spearman_matrix(coded, plain).join(ridge_table(coded, plain), ["param", "objective"])
    return both.select(F.element_at(name, F.col("param")).alias("param"), "objective", "rho", "beta", "r2")


def importance(table: DataFrame, measure: str) -> DataFrame:
    """param and the mean absolute measure over objectives, ascending."""
    return table.groupBy("param").agg(F.avg(F.abs(measure)).alias("importance")).orderBy("importance", "param")


def thresholded(table: DataFrame, measure: str, least: float = 0.1) -> DataFrame:
    """Rows of params whose greatest absolute measure is below ``least`` are set to zero."""
    top = F.max(F.abs(measure)).over(Window.partitionBy("param"))
    return table.withColumn(measure, F.when(top < least, 0.0).otherwise(F.col(measure)))


def lcg(state: int) -> tuple[int, float]:
    """Next state of a 64-bit linear congruential generator and a number in [0, 1) from its top 53 bits."""
    # Multiplier and increment of the generator.
    state = (state * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
    return state, (state >> 11) / (1 << 53)


def quadratic(x: np.ndarray) -> np.ndarray:
    """Columns, their squares, then their products by pairs."""
    p = x.shape[1]
    return np.column_stack([x, x * x, *[x[:, i] * x[:, j] for i in range(p) for j in range(i + 1, p)]])


def sobol(df: DataFrame, schema: StudySchema, n: int = 1024) -> DataFrame:
    """param, objective, first-order and total index of a quadratic ridge surrogate (Saltelli design)."""
    spark, kind = df.sparkSession, "param string, objective string, s1 double, st double"
    kinds = dict(df.dtypes)
    cols = [F.coalesce(F.col(p).cast("double"), F.lit(0.0)) if kinds[p] != "string" else F.lit(0.0) for p in schema.params]
    p = len(cols)
    if not p or not schema.objectives or df.limit(2).count() < 2:
        return spark.createDataFrame([], kind)
    base = moments(df, cols)
    ends = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(cols)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    z = [(c - float(base.mean[i])) / float(base.std[i]) for i, c in enumerate(cols)]
    features = [*z, *[c * c for c in z], *[z[i] * z[j] for i in range(p) for j in range(i + 1, p)]]
    fits = ridge_fits(df, features, schema.objectives)
    low = np.array([ends[f"a{i}"] for i in range(p)], float)
    high = np.array([ends[f"b{i}"] for i in range(p)], float)
    flat = high - low < EPS
    low, high = np.where(flat, low - 1, low), np.where(flat, high + 1, high)
    draws, state = np.empty(2 * n * p), SOBOL_SEED
    for i in range(len(draws)):
        state, draws[i] = lcg(state)
    a, b = (low + (high - low) * d for d in draws.reshape(2, n, p))
    rows = []
    for o, fit in zip(schema.objectives, fits, strict=True):
        f = lambda x: fit.y_mean + (quadratic((x - base.mean) / base.std) - fit.mean) / fit.std @ fit.beta  # noqa: B023, E731
        fa, fb = f(a), f(b)
        v = fa.var()
        for i, name in enumerate(schema.params):
            mixed = a.copy()
            mixed[:, i] = b[:, i]
            fm = f(mixed)
            s1, st = (0.0, 0.0) if v < EPS else (float(np.mean(fb * (fm - fa)) / v), float(np.mean((fa - fm) ** 2) / (2 * v)))
            rows.append((name, o, min(max(s1, 0.0), 1.0), min(max(st, 0.0), 1.0)))
    return spark.createDataFrame(rows, kind)
