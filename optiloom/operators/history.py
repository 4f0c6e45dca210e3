"""Series along the trials of a study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optiloom.functions.ordered import running, scan, trailing_mean, with_position
from optiloom.functions.schema import StudySchema, finite


def _clean(df: DataFrame, value: str) -> DataFrame:
    return df.where(finite(F.col(value)))


def best_so_far(df: DataFrame, order: str, value: str, minimize: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """``best``: least (or greatest) value up to each row; rows without a finite value are left out."""
    return running(_clean(df, value), order, F.col(value), F.min if minimize else F.max, "best", by=by)


def moving_average(df: DataFrame, order: str, value: str, by: tuple[str, ...], window: int = 5) -> DataFrame:
    """Trailing mean of the last ``window`` rows of each series."""
    return trailing_mean(_clean(df, value), order, value, window, "moving_avg", by)


def improvement(df: DataFrame, order: str, value: str, by: tuple[str, ...], minimize: bool = True) -> DataFrame:
    """Change of the best value against the row before, per cent; 0 on the first row and after a best of 0."""
    best = {"best": (F.col(value), F.min if minimize else F.max)}
    found = scan(_clean(df, value), (order,), best, by, before={"best": "__prev"})  # the best of all rows before is that of the row before
    prev = F.col("__prev")
    pct = F.when(prev.isNull() | (prev == 0), 0.0).otherwise(F.abs((prev - F.col("best")) / prev) * 100)
    return found.withColumn("improvement", pct).drop("__prev")


def with_place(df: DataFrame, order: str, out: str, *ties: str) -> DataFrame:
    """``out``: places from 0 along ``order``."""
    return with_position(df, order, out, *ties)


def phase(position: Column, total: Column) -> Column:
    at = position / total
    return F.when(at < 0.3, "exploration").when(at < 0.7, "exploitation").otherwise("convergence")


def with_phase(df: DataFrame, order: str) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    return with_position(df, order).crossJoin(F.broadcast(total)).withColumn("phase", phase(F.col("row_idx"), F.col("__total"))).drop("__total")


def record_trials(df: DataFrame, order: str, value: str, by: tuple[str, ...], minimize: bool = True) -> DataFrame:
    """Rows better than all before them in their series."""
    best = {"__best": (F.col(value), F.min if minimize else F.max)}
    better = F.col(value) < F.col("__before") if minimize else F.col(value) > F.col("__before")
    found = scan(_clean(df, value), (order,), best, by, before={"__best": "__before"})
    return found.where(F.col("__before").isNull() | better).drop("__best", "__before")


def convergence(df: DataFrame, order: str, value: str, by: tuple[str, ...], minimize: bool = True) -> DataFrame:
    """Verdict per series from the change of the best value over the last fifth of its trials."""
    clean = _clean(df, value)
    found = scan(clean, (order,), {"best": (F.col(value), F.min if minimize else F.max)}, by, place="i")
    sizes = clean.groupBy(*[F.col(c).alias(f"__of_{c}") for c in by]).agg(F.count(F.lit(1)).alias("n"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    at = F.floor(F.col("n") * 0.8)
    ends = found.join(sizes, on).where((F.col("i") == at) | (F.col("i") == F.col("n") - 1))  # two rows a series
    ends = ends.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.when(F.col("i") == at, F.col("best"))).alias("first"), F.max(F.when(F.col("i") == F.col("n") - 1, F.col("best"))).alias("last"))
    rate = F.when(F.col("first") == 0, F.abs(F.col("first") - F.col("last"))).otherwise(F.abs((F.col("first") - F.col("last")) / F.when(F.col("first") != 0, F.col("first"))))
    verdict = F.when(F.col("n") < 10, "insufficient").when(rate < 0.001, "converged").when(rate < 0.01, "converging").otherwise("not_converged")
    return ends.select(*by, "n", rate.alias("rate"), verdict.alias("verdict"))


def edf_of(df: DataFrame, schema: StudySchema) -> DataFrame:
    """Empirical distributions of the first two objectives (or the only one): objective, trial id, value, y."""
    parts = [edf(df.select(schema.id, F.lit(o).alias("objective"), F.col(o).cast("double").alias("value")), "value", schema.id) for o in schema.objectives[:2]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("objective", schema.id, "value", "y")


def edf(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Empirical distribution: one point per row, y = place / n."""
    clean = _clean(df, value)
    total = clean.agg(F.count(F.lit(1)).alias("__n"))
    return with_position(clean, value, "row_idx", tie).crossJoin(F.broadcast(total)).withColumn("y", (F.col("row_idx") + 1) / F.col("__n")).drop("__n")
