"""Positions, running values and trailing means over a total order, without a task that holds a series.

Rows are dealt to as many ranges of the order columns as the shuffle has
partitions, by Spark's range partitioning over all of them, so that ties of the
first column and long series spread too. Each range is worked on alone, and a table
of one row per range and series carries what the earlier ranges add. Before that
the ranged rows are written once to the shared folder: range bounds are sampled, so
a range must not be computed twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from optiloom.functions.storage import saved

#: Positions of a series that one task averages.
AVERAGED = 1 << 16


def ranged(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``df`` with ``__range``, which rises with the order columns."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))


#: How running values of two parts go together, by the aggregate's name.
_COMBINED = {"min": F.least, "max": F.greatest, "sum": lambda a, b: a + b}


def scan(
    df: DataFrame,
    order: tuple[str, ...],
    values: Mapping[str, tuple[Column, Callable]] | None = None,
    by: tuple[str, ...] = (),
    place: str | None = None,
    before: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running values of every series of ``by`` in the order of ``order``.

    ``values``: output name to (value, F.min or F.max or F.sum), over all rows up to
    each row; ``before`` names further outputs for some of them, over all rows before
    each row (null on the first). ``place``: positions from 0.
    """
    values, before = dict(values or {}), dict(before or {})
    held = {name: f"__v{k}" for k, name in enumerate(values)}
    rows = ranged(df.withColumns({held[name]: v for name, (v, _) in values.items()}), (*by, *[c for c in order if c not in by]))
    part = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"), *[how(held[name]).alias(f"{held[name]}w") for name, (_, how) in values.items()])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range, and one more per series
    prior = part.select(
        *[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)],
        F.col("__range").alias("__at"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"),
        *[how(f"{held[name]}w").over(earlier).alias(f"{held[name]}p") for name, (_, how) in values.items()],
    )
    on = F.col("__range") == F.col("__at")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    inside = Window.partitionBy(*by, "__range").orderBy(*order)
    upto, past = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    own = {f"{held[name]}o": how(held[name]).over(upto) for name, (_, how) in values.items()}
    own |= {f"{held[name]}b": values[name][1](held[name]).over(past) for name in before}
    if place:
        own["__rowno"] = F.row_number().over(inside)
    joined = rows.withColumns(own).join(prior, on)

    def both(name: str, mark: str) -> Column:
        a, b = F.col(f"{held[name]}p"), F.col(f"{held[name]}{mark}")
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(_COMBINED[values[name][1].__name__](a, b))

    out = {name: both(name, "o") for name in values} | {to: both(name, "b") for name, to in before.items()}
    if place:
        out[place] = (F.col("__n") + F.col("__rowno") - 1).cast("long")
    gone = ["__range", "__at", "__n", "__rowno", *[f"__by{k}" for k in range(len(by))], *[f"{h}{m}" for h in held.values() for m in ("", "o", "b", "p")]]
    return joined.withColumns(out).drop(*gone)


def with_position(df: DataFrame, order: str, out: str = "row_idx", *ties: str) -> DataFrame:
    """``out``: positions from 0 in ascending order of ``order`` and the tie columns."""
    return scan(df, (order, *ties), place=out)


def running(df: DataFrame, order: str | tuple[str, ...], value: Column, how: Callable, out: str, *ties: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``out``: ``how`` (F.min or F.max or F.sum) of ``value`` over all rows up to each row, in each series of ``by``, whose columns lead the order."""
    return scan(df, (*((order,) if isinstance(order, str) else order), *ties), {out: (value, how)}, by)


def trailing_mean(df: DataFrame, order: str, value: str, window: int, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``out``: mean of the last ``window`` rows of the series up to each row.

    Rows go to blocks of positions; the last ``window - 1`` rows of a block go to
    the next one as well, where they only count for the rows after them.
    """
    size = max(AVERAGED, window)
    placed = scan(df, (order,), by=by, place="__place").withColumn("__block", F.floor(F.col("__place") / size))
    halo = placed.where(F.col("__place") % size > size - window).withColumn("__block", F.col("__block") + 1)
    both = placed.withColumn("__own", F.lit(True)).unionByName(halo.withColumn("__own", F.lit(False)))
    last = Window.partitionBy(*by, "__block").orderBy("__place").rowsBetween(1 - window, 0)
    return both.withColumn(out, F.avg(value).over(last)).where("__own").drop("__place", "__block", "__own")
