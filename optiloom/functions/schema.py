"""Roles of a study's columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


@dataclass(frozen=True)
class StudySchema:
    """Names by role. Objectives carry a direction, 'minimize' or 'maximize'; a missing one is minimize."""

    params: tuple[str, ...] = ()
    objectives: tuple[str, ...] = ()
    directions: tuple[str, ...] = ()
    attrs: tuple[str, ...] = ()
    id: str = "trial_id"

    def minimized(self, k: int) -> bool:
        return k >= len(self.directions) or self.directions[k] != "maximize"

    def cost(self, k: int) -> Column:
        """Objective ``k`` with maximization turned into minimization."""
        c = F.col(self.objectives[k])
        return c if self.minimized(k) else -c

    def numeric(self, df: DataFrame, names: tuple[str, ...]) -> tuple[str, ...]:
        kinds = dict(df.dtypes)
        return tuple(n for n in names if kinds.get(n) != "string")


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def with_feasibility(df: DataFrame, constraints: str = "constraints") -> DataFrame:
    """is_feasible (1.0 when all present constraints are at most 0) and constraint_sum (signed)."""
    c = F.coalesce(F.col(constraints), F.array().cast("array<double>"))
    return df.withColumn("is_feasible", F.when(F.forall(c, lambda x: x <= 0), 1.0).otherwise(0.0)).withColumn("constraint_sum", F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
