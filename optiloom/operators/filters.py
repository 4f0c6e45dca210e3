"""Range filters, lookups and projections for views."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optiloom.functions.ordered import with_position
from optiloom.functions.schema import StudySchema, finite

Bounds = tuple[float | None, float | None]


def _bound(x: object) -> float | None:
    """A number as it is; anything else leaves the range open."""
    return x if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else None


def parse_ranges(text: str) -> dict[str, Bounds]:
    """``{"x": {"min": 1, "max": null}}``; text that is no JSON object is no range at all, a member or bound of another form is open."""
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    if not isinstance(found, dict):
        return {}
    sides = {k: v if isinstance(v, dict) else {} for k, v in found.items()}
    return {k: (_bound(v.get("min")), _bound(v.get("max"))) for k, v in sides.items()}


def range_predicate(df: DataFrame, ranges: Mapping[str, Bounds]) -> Column:
    """Conjunction of inclusive ranges. NaN fails any range; an unknown column, one that is no number, or an empty range fails all rows."""
    kinds, out = {f.name: f.dataType for f in df.schema.fields}, F.lit(True)
    for name, bounds in ranges.items():
        low, high = map(_bound, bounds)
        kind = kinds.get(name)
        if not isinstance(kind, T.NumericType) or (low is not None and high is not None and low > high):
            return F.lit(False)
        c = F.col(f"`{name}`")
        out = out & c.isNotNull() & (~F.isnan(c) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.lit(True))
        out = out & (c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True))
    return out


def range_filter(df: DataFrame, ranges: dict[str, Bounds] | str) -> DataFrame:
    return df.where(range_predicate(df, parse_ranges(ranges) if isinstance(ranges, str) else ranges))


@dataclass(frozen=True)
class Selection:
    """Ranges of axes and positions brushed by hand; every change gives a new selection. Without either all rows are selected."""

    ranges: Mapping[str, Bounds] = field(default_factory=dict)
    brushed: frozenset[int] | None = None

    def with_range(self, axis: str, low: float | None, high: float | None) -> Selection:
        return Selection({**self.ranges, axis: (low, high)}, None)

    def without_range(self, axis: str) -> Selection:
        return Selection({k: v for k, v in self.ranges.items() if k != axis}, None)

    def brush(self, positions: Sequence[int]) -> Selection:
        """Positions take the place of the ranges' result until a range changes."""
        return Selection(self.ranges, frozenset(positions))

    def clear(self) -> Selection:
        return Selection()

    def apply(self, df: DataFrame, position: str = "row_idx") -> DataFrame:
        if self.brushed is not None:
            wanted = df.sparkSession.createDataFrame([(p,) for p in sorted(self.brushed)], "__wanted long")
            return df.join(wanted, F.col(position) == F.col("__wanted"), "left_semi")
        return range_filter(df, dict(self.ranges)) if self.ranges else df


def trial_record(schema: StudySchema, df: DataFrame) -> list[Column]:
    """trial_id, numeric params (missing and text: 0) as a map, objective values as an array."""
    kinds = dict(df.dtypes)
    pairs = [x for p in schema.params for x in (F.lit(p), F.coalesce(F.col(p).cast("double"), F.lit(0.0)) if kinds[p] != "string" else F.lit(0.0))]
    return [F.col(schema.id), F.create_map(*pairs).alias("params"), F.array(*[F.col(o).cast("double") for o in schema.objectives]).alias("values")]


def all_trials(df: DataFrame, schema: StudySchema) -> DataFrame:
    return df.select(*trial_record(schema, df))


def trials_batch(df: DataFrame, positions: Sequence[int], position: str = "row_idx") -> DataFrame:
    """Rows at the wanted positions with ``ordinal``; positions out of range are skipped."""
    wanted = df.sparkSession.createDataFrame([(i, p) for i, p in enumerate(positions)], "ordinal long, wanted long")
    return df.join(wanted, F.col(position) == F.col("wanted")).drop("wanted")


def trial_at(df: DataFrame, index: int, position: str = "row_idx", schema: StudySchema | None = None) -> DataFrame:
    """The row at a position; with ``schema`` as a typed record (trial_id, params, values)."""
    row = df.where(F.col(position) == index)
    return row if schema is None else all_trials(row, schema)


def point_positions(df: DataFrame, schema: StudySchema, position: str = "row_idx") -> DataFrame:
    """x, y, z of the scatter view: objectives, or the relative position for a single one."""
    m = len(schema.objectives)
    o = [F.col(c).cast("double") for c in schema.objectives]
    zero = F.lit(0.0)
    if m == 1:
        n = df.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("__n"))
        df = df.crossJoin(F.broadcast(n))
        x, y, z = F.col(position) / F.col("__n"), o[0], zero
    else:
        x, y, z = (o[0], o[1], o[2] if m > 2 else zero) if m else (zero, zero, zero)
    return df.select(schema.id, x.alias("x"), y.alias("y"), z.alias("z"))


def axis_extents(df: DataFrame, names: Sequence[str], pad: bool = False) -> DataFrame:
    """axis, low, high over finite values; with ``pad`` a constant axis opens by one per cent, or by one at zero."""
    values = long_form(df, names).where(finite(F.col("value")))
    out = values.groupBy("name").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    if pad:
        by = F.when(F.col("low") != F.col("high"), 0.0).when(F.col("low") == 0, 1.0).otherwise(F.abs("low") * 0.01)
        out = out.select("name", (F.col("low") - by).alias("low"), (F.col("high") + by).alias("high"))
    return out


def long_form(df: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    """One row per row and column: name, value."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*keep, F.explode(pairs).alias("__p")).select(*keep, "__p.name", "__p.value")


def effective_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> dict[str, tuple[float, float]]:
    """Ranges that cover less than their column's finite values (to 1e-10)."""
    extent = {r.name: (r.low, r.high) for r in axis_extents(df, list(ranges)).collect()}  # a row per range
    return {k: v for k, v in ranges.items() if k not in extent or v[0] > extent[k][0] + 1e-10 or v[1] < extent[k][1] - 1e-10}


def selected_points(df: DataFrame, columns: Sequence[str], selected: Column, full: float = 1.0, dimmed: float = 0.2) -> DataFrame:
    """Slice (param, objective) or contour (two params, objective) points of finite values, with alpha ``full`` for selected rows and ``dimmed`` for others."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & finite(F.col(c).cast("double"))
    return df.where(ok).select(*columns, F.coalesce(selected, F.lit(False)).alias("selected")).withColumn("alpha", F.when(F.col("selected"), F.lit(float(full))).otherwise(F.lit(float(dimmed))))


def scatter_color(df: DataFrame, schema: StudySchema) -> DataFrame:
    """Objective 0 scaled to [0, 1]; 0.5 where it is not finite or constant."""
    c = F.col(schema.objectives[0]).cast("double")
    ends = df.where(finite(c)).agg(F.min(c).alias("__low"), F.max(c).alias("__high"))
    span = F.col("__high") - F.col("__low")
    scaled = F.when(finite(c) & (span > 0), (c - F.col("__low")) / span).otherwise(0.5)
    return df.crossJoin(F.broadcast(ends)).select(schema.id, scaled.alias("color"))


def scatter_cells(schema: StudySchema, mode: str = "all") -> list[tuple[str, str]]:
    """Cells of the scatter matrix: params by params, params by objectives, or all by all; axes by name."""
    p, o = sorted(schema.params), list(schema.objectives)
    rows, cols = {"params": (p, p), "objectives": (p, o), "all": (p + o, p + o)}[mode]
    return [(a, b) for a in rows for b in cols]


def objective_pairs(schema: StudySchema) -> list[tuple[str, str]]:
    return [(a, b) for a in schema.objectives for b in schema.objectives]


def detail_table(df: DataFrame, schema: StudySchema) -> DataFrame:
    """Text cells: params to 6 significant digits, objectives to 4 decimals, a dash where not finite."""
    kinds = dict(df.dtypes)

    def param(n: str) -> Column:
        if kinds[n] == "string":
            return F.col(n)
        x = F.col(n).cast("double")
        digits = F.lit(5) - F.floor(F.log10(F.abs(x))).cast("int")
        scale = F.pow(F.lit(10.0), digits.cast("double"))
        return F.when(~finite(x), F.lit("-")).when(x == 0, F.lit("0")).otherwise(plain_number(F.round(x * scale) / scale))

    shown = [F.when(finite(F.col(o).cast("double")), F.format_string("%.4f", F.col(o).cast("double"))).otherwise("-").alias(o) for o in schema.objectives]
    return df.select(schema.id, *[param(p).alias(p) for p in schema.params], *shown)


def plain_number(x: Column) -> Column:
    """Integers without a point, others with up to ten decimals, trailing zeros cut; empty where not finite."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(~finite(x), F.lit("")).when(whole, x.cast("decimal(20,0)").cast("string")).otherwise(F.regexp_replace(F.format_string("%.10f", x), "\\.?0+$", ""))


def color_at(t: Column, stops: Sequence[str]) -> Column:
    """Hex colour at ``t`` in [0, 1] between evenly spaced hex stops."""
    last = len(stops) - 1
    rgb = [[int(s.lstrip("#")[k : k + 2], 16) for k in (0, 2, 4)] for s in stops]
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * last
    low = F.least(F.floor(at).cast("int"), F.lit(max(last - 1, 0)))
    part = []
    for k in range(3):
        band = F.array(*[F.lit(float(c[k])) for c in rgb])
        a, b = F.get(band, low), F.coalesce(F.get(band, low + 1), F.get(band, low))
        part.append(F.lpad(F.lower(F.hex(F.round(a + (b - a) * (at - low)).cast("int"))), 2, "0"))
    return F.concat(F.lit("#"), *part)


def indexed(df: DataFrame, schema: StudySchema) -> DataFrame:
    """``row_idx``: positions from 0 by trial id."""
    return with_position(df, schema.id)
