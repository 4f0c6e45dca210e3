"""Partial dependence and response surfaces of ridge, random-forest and Gaussian-process models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiloom.functions.schema import EPS, StudySchema, finite
from optiloom.functions.storage import Scratch
from optiloom.operators import forest, kriging
from optiloom.operators.sensitivity import ridge_fits

#: Rows a Gaussian process is fitted on; more are sampled by hash of the id.
KRIGING_ROWS = 1000


def linspace(low: float, high: float, n: int) -> list[float]:
    """``n`` even points; the middle for one."""
    if n < 1:
        return []
    return [(low + high) / 2] if n == 1 else [low + (high - low) * i / (n - 1) for i in range(n)]


def _numeric(df: DataFrame, schema: StudySchema) -> list:
    kinds = dict(df.dtypes)
    return [F.coalesce(F.col(p).cast("double"), F.lit(0.0)) if kinds[p] != "string" else F.lit(0.0) for p in schema.params]


def _range(df: DataFrame, c) -> tuple[float, float]:
    r = df.agg(F.min(c).alias("a"), F.max(c).alias("b")).first()
    return float(r.a), float(r.b)


def pdp_1d(df: DataFrame, schema: StudySchema, param: str, objective: str, n: int = 20) -> DataFrame:
    """x, y, r2 of the ridge model along one param."""
    spark, kind = df.sparkSession, "x double, y double, r2 double"
    cols = _numeric(df, schema)
    if param not in schema.params or df.limit(2).count() < 2 or n < 1:
        return spark.createDataFrame([], kind)
    j = schema.params.index(param)
    fit = ridge_fits(df, cols, [objective])[0]
    xs = linspace(*_range(df, cols[j]), n)
    return spark.createDataFrame([(x, float(fit.y_mean + fit.beta[j] * (x - fit.mean[j]) / fit.std[j]), float(fit.r2)) for x in xs], kind)


def _training(df: DataFrame, schema: StudySchema, cols: list, objective: str) -> DataFrame:
    """id, x0.. and y of the rows with a finite objective."""
    return df.where(finite(F.col(objective).cast("double"))).select(schema.id, *[c.alias(f"x{i}") for i, c in enumerate(cols)], F.col(objective).cast("double").alias("y"))


def _sampled(df: DataFrame, schema: StudySchema, cols: list, objective: str, limit: int) -> np.ndarray:
    rows = _training(df, schema, cols, objective)
    data = rows.orderBy(F.xxhash64(schema.id), schema.id).limit(limit).toPandas().sort_values(schema.id)  # bounded by limit
    return data[[*(f"x{i}" for i in range(len(cols))), "y"]].to_numpy(float)


def _forest(df: DataFrame, schema: StudySchema, cols: list, objective: str, grid: np.ndarray) -> tuple[np.ndarray, float]:
    """(values at ``grid``, r2) of a forest over all rows."""
    work = Scratch(df.sparkSession)
    training = _training(df, schema, cols, objective)
    rows = work.save(training.select(F.xxhash64(schema.id).alias("h"), *[c for c in training.columns if c != schema.id]))
    if rows.isEmpty():
        return np.full(len(grid), np.nan), 1.0
    trees = forest.fit(rows, len(cols))
    found = forest.predict(trees, grid), forest.r_squared_over(rows, len(cols), trees)
    work.drop()
    return found


def surface(df: DataFrame, schema: StudySchema, p1: str, p2: str, objective: str, n: int = 50, model: str = "ridge") -> DataFrame:
    """x, y, z, r2 on an n by n grid. ``random_forest`` and ``kriging`` fit on the two params alone; any other name is ridge."""
    spark, kind = df.sparkSession, "x double, y double, z double, r2 double"
    if p1 not in schema.params or p2 not in schema.params or df.limit(2).count() < 2 or n < 1:
        return spark.createDataFrame([], kind)
    cols = _numeric(df, schema)
    a, b = schema.params.index(p1), schema.params.index(p2)
    xs, ys = linspace(*_range(df, cols[a]), n), linspace(*_range(df, cols[b]), n)
    gx, gy = (g.ravel() for g in np.meshgrid(xs, ys, indexing="ij"))
    if model == "random_forest":
        z, r2 = _forest(df, schema, [cols[a], cols[b]], objective, np.column_stack([gx, gy]))
    elif model == "kriging":
        data = _sampled(df, schema, [cols[a], cols[b]], objective, KRIGING_ROWS)
        if len(data) < 3:
            return spark.createDataFrame([], kind)
        gp = kriging.fit(data[:, :2], data[:, 2])
        z, r2 = gp.predict(np.column_stack([gx, gy])), forest.r_squared(data[:, 2], gp.predict(data[:, :2]))
    else:
        fit = ridge_fits(df, cols, [objective])[0]
        z = fit.y_mean + fit.beta[a] * (gx - fit.mean[a]) / fit.std[a] + fit.beta[b] * (gy - fit.mean[b]) / fit.std[b]
        r2 = fit.r2
    keep = np.isfinite(z)
    return spark.createDataFrame([(float(x), float(y), float(v), float(r2)) for x, y, v in zip(gx[keep], gy[keep], z[keep], strict=True)], kind)


class SurfaceCache:
    """Surfaces of one study by model, params, objective and grid; another study empties it. A surface has at most n * n rows.

    A study is the same if its plan is, so one that is read again finds its surfaces.
    """

    def __init__(self):
        self._study: DataFrame | None = None
        self._held: dict[tuple, DataFrame] = {}

    def surface(self, df: DataFrame, schema: StudySchema, p1: str, p2: str, objective: str, n: int = 50, model: str = "ridge") -> DataFrame:
        if self._study is None or not df.sameSemantics(self._study):
            self._study, self._held = df, {}
        key = (model, p1, p2, objective, n)
        if key not in self._held:
            self._held[key] = surface(df, schema, p1, p2, objective, n, model)
        return self._held[key]


def quality_label(r2: float) -> str:
    return "Good" if r2 >= 0.8 else "Caution" if r2 >= 0.5 else "Not Recommended"


__all__ = ["EPS", "SurfaceCache", "linspace", "pdp_1d", "quality_label", "surface"]
