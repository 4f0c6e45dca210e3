"""Scalar rankings over several objectives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiloom.functions.schema import EPS, StudySchema


def normalized_weights(weights: Sequence[float] | None, m: int) -> list[float]:
    """Weights that add up to 1 where their sum is positive; equal ones by default."""
    given = list(weights) if weights is not None else [1.0] * m
    total = sum(given)
    return [w / total for w in given] if total > 0 else given


def _bad(schema: StudySchema):
    out = F.lit(False)
    for o in schema.objectives:
        out = out | F.col(o).isNull() | F.isnan(F.col(o).cast("double"))
    return out


def chebyshev(df: DataFrame, schema: StudySchema, weights: Sequence[float]) -> DataFrame:
    """``score``: greatest weighted distance to the ideal point, ascending is better; rows with NaN have no score and sort last."""
    m = len(schema.objectives)
    if len(weights) != m:
        raise ValueError("one weight per objective")
    bad = _bad(schema)
    ideal = df.agg(*[F.min(F.when(~F.isnan(schema.cost(k).cast("double")), schema.cost(k))).alias(f"__i{k}") for k in range(m)])
    terms = [F.abs(schema.cost(k) - F.col(f"__i{k}")) * float(weights[k]) for k in range(m)]
    score = F.greatest(*terms) if m > 1 else terms[0]
    return df.crossJoin(F.broadcast(ideal)).withColumn("score", F.when(~bad, score)).drop(*[f"__i{k}" for k in range(m)])


def topsis(df: DataFrame, schema: StudySchema, weights: Sequence[float]) -> DataFrame:
    """``score`` in [0, 1], higher is better: closeness to the ideal of the vector-normalized, weighted objectives.

    Rows with NaN score 0 and take no part in norms; if every row has one, all score 0.5.
    """
    m = len(schema.objectives)
    if m == 0:
        raise ValueError("no objectives")
    if len(weights) != m or (schema.directions and len(schema.directions) != m):
        raise ValueError("one weight and one direction per objective")
    good, o = ~_bad(schema), [F.col(c).cast("double") for c in schema.objectives]
    aggs = [F.count(F.when(good, 1)).alias("__good")]
    for k in range(m):
        v = F.when(good, o[k])
        aggs += [F.sqrt(F.sum(v * v)).alias(f"__n{k}"), F.min(v).alias(f"__a{k}"), F.max(v).alias(f"__b{k}")]
    joined = df.crossJoin(F.broadcast(df.agg(*aggs)))
    plus = minus = F.lit(0.0)
    for k in range(m):
        scale = F.when(F.col(f"__n{k}") < EPS, 0.0).otherwise(float(weights[k]) / F.when(F.col(f"__n{k}") >= EPS, F.col(f"__n{k}")))
        best, worst = (f"__a{k}", f"__b{k}") if schema.minimized(k) else (f"__b{k}", f"__a{k}")
        plus = plus + F.pow((o[k] - F.col(best)) * scale, F.lit(2.0))
        minus = minus + F.pow((o[k] - F.col(worst)) * scale, F.lit(2.0))
    far, near = F.sqrt(minus), F.sqrt(plus)
    score = F.when(far + near < EPS, 0.5).otherwise(F.try_divide(far, far + near))
    return joined.withColumn("score", F.when(F.col("__good") == 0, 0.5).when(good, score).otherwise(0.0)).drop("__good", *[f"__{x}{k}" for x in "nab" for k in range(m)])


def top(df: DataFrame, n: int, tie: str, ascending: bool = False) -> DataFrame:
    """The ``n`` best rows by score, equal ones by ``tie``."""
    return df.orderBy(F.col("score").asc_nulls_last() if ascending else F.col("score").desc_nulls_last(), tie).limit(n)
