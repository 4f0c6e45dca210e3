"""Replay of append-only JSON-lines journals into study and trial tables.

Every line is an operation; the state of a trial is the last write to each of
its fields. So a line is parsed once, into its writes (``operations``), which are
kept narrow; the last write of each (trial, kind, key) is an aggregate that starts
before the shuffle, and one more aggregate makes a trial of them. A trial's writes
before its creation have no effect: as only the last write of a field counts, it is
enough to compare that one's line with the line of the creation. Identifiers are
running counts of creation lines, counted within blocks of line numbers and over
these blocks.

Fixed values: operations 0 create study, 3 study attributes, 4 create trial,
5 set param, 6 set state and values, 8 user attributes, 9 system attributes;
direction 2 is maximize, anything else minimize; state 1 is complete. Other
operations are ignored. Lines that are not strict JSON are skipped. A missing id
or state counts as 0, a missing name as empty.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from optiloom.functions.ordered import with_position
from optiloom.functions.schema import StudySchema, with_feasibility
from optiloom.functions.storage import saved
from optiloom.sources import operations as ops
from optiloom.sources.byte_ranges import lines_of, ranges_of

WRITES = "line_no long, op int, study_id long, trial_id long, kind string, key string, num double, text string, list array<double>"
#: Low bits of the line numbers that one block of running counts holds.
BLOCK_BITS = 20


class JournalError(ValueError):
    """No line of a non-empty journal is valid JSON."""


@dataclass
class Replay:
    """``studies``: one row per study. ``trials``: one row per complete trial, with maps and arrays by role."""

    studies: DataFrame
    trials: DataFrame

    def schema_of(self, study_id: int) -> StudySchema:
        s = self.studies.where(F.col("study_id") == study_id).first()
        if s is None:
            raise KeyError(study_id)
        return StudySchema(tuple(s.param_names), tuple(s.objective_names), tuple(s.directions), tuple(s.user_attr_names))

    def select(self, study_id: int) -> DataFrame:
        """Wide table of one study with ``row_idx``. Missing values: 0 for numeric params and constraints, NaN for objectives and numeric attributes, '' for text."""
        s = self.studies.where(F.col("study_id") == study_id).first()
        if s is None:
            raise KeyError(study_id)
        rows = self.trials.where(F.col("study_id") == study_id)
        cols: dict[str, Column] = {}
        for p in s.param_names:
            cols.setdefault(p, F.coalesce(F.element_at("param_labels", F.lit(p)), F.lit("")) if p in s.label_names else F.coalesce(F.element_at("params", F.lit(p)), F.lit(0.0)))
        for k, o in enumerate(s.objective_names):
            cols.setdefault(o, F.coalesce(F.get("objectives", F.lit(k)), F.lit(float("nan"))))
        for a in s.user_attr_names:
            cols.setdefault(a, F.coalesce(F.element_at("attrs_num", F.lit(a)), F.lit(float("nan"))) if a in s.numeric_attr_names else F.coalesce(F.element_at("attrs_str", F.lit(a)), F.lit("")))
        for k in range(s.n_constraints):
            cols.setdefault(f"c{k + 1}", F.coalesce(F.get("constraints", F.lit(k)), F.lit(0.0)))
        wide = with_feasibility(rows).select("trial_id", *[c.alias(n) for n, c in cols.items()], "is_feasible", "constraint_sum")
        return with_position(wide, "trial_id")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of the text files under ``path`` in file order."""
    text = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("__m"))
    packed = text.withColumn("__at", F.struct("file_path", "file_block_start", "__m"))
    parts = packed.groupBy("file_path", "file_block_start").agg(F.min("__m").alias("__least"), F.count(F.lit(1)).alias("__n"))
    before = parts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("file_path", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per split
    placed = packed.join(before, ["file_path", "file_block_start"])
    return placed.select((F.col("__before") + F.col("__m") - F.col("__least")).alias("line_no"), "value")


def journal_writes(lines: DataFrame) -> DataFrame:
    """A row for every write of every valid line: line_no, op, study_id, trial_id and the write's fields. Other valid lines give a row without kind."""
    arrow = pa.schema([("line_no", pa.int64()), ("op", pa.int32()), ("study_id", pa.int64()), ("trial_id", pa.int64()), ("kind", pa.string()), ("key", pa.string()), ("num", pa.float64()), ("text", pa.string()), ("list", pa.list_(pa.float64()))])
    no_write = (None,) * 5

    def rows_of(line_no: int, line: str | None) -> Iterator[tuple]:
        o = ops.parse(line) if line else None
        if o is None:
            return
        op = ops.whole(o.get("op_code"), None) if isinstance(o, dict) else None
        op = op if op is not None and op < 10 else None
        head = (line_no, op, *((ops.whole(o.get("study_id")), ops.whole(o.get("trial_id"))) if op is not None else (None, None)))
        found = list(ops.writes_of(op, o)) if op is not None else []
        for write in found or [no_write]:
            yield (*head, *write)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("line_no").to_pylist()
            rows = [r for i, x in zip(numbers, batch.column("value").to_pylist(), strict=True) for r in rows_of(i, x)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return lines.select("line_no", "value").mapInArrow(run, WRITES)


class JournalFiles(DataSource):
    """``spark.read.format("journal_files").option("path", file or folder or pattern)``; rows: line_no, value.

    Files are read in the order of their names, each by byte ranges. A line's number
    is its position in all files end to end, so it needs no count of lines: numbers
    rise with the lines, but not by one.
    """

    @classmethod
    def name(cls) -> str:
        return "journal_files"

    def schema(self) -> str:
        return "line_no long, value string"

    def reader(self, schema):
        return JournalFilesReader(self.options["path"])


class JournalFilesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        found = glob.glob(os.path.join(self.path, "*") if os.path.isdir(self.path) else self.path)
        if not found:
            raise FileNotFoundError(self.path)
        out, base = [], 0
        for name in sorted(f for f in found if os.path.isfile(f)):
            size = os.path.getsize(name)
            out += [InputPartition(r) for r in ranges_of(name, 0, size, base)]
            base += size
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return iter(()) if partition.value is None else lines_of(partition.value, whole=False)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of journals on a file system that driver and executors share; :func:`read_lines` reads any store."""
    spark.dataSource.register(JournalFiles)
    return spark.read.format("journal_files").option("path", path).load()


def _counted(rows: DataFrame, flag: Column, out: str) -> DataFrame:
    """``out``: how many rows up to each have ``flag``, by line number: counts within a block of lines, plus those of the blocks before."""
    blocked = rows.withColumn("__block", F.shiftright("line_no", BLOCK_BITS)).withColumn("__flag", flag.cast("long"))
    blocks = blocked.groupBy("__block").agg(F.sum("__flag").alias("__n"))
    before = blocks.select("__block", (F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")).alias("__before"))  # a row for 2**BLOCK_BITS lines
    own = F.sum("__flag").over(Window.partitionBy("__block").orderBy("line_no"))
    return blocked.withColumn("__own", own).join(before, "__block").withColumn(out, F.col("__own") + F.col("__before")).drop("__block", "__flag", "__own", "__before")


def _created(writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(studies: study_id, study_line, name, directions; trials: line_no, trial_id, study_id) with ids by order of creation."""
    births = writes.where(F.col("kind").isin("study", "b")).select("line_no", "kind", F.col("num").cast("long").alias("study_id"), "text", "list")
    counted = _counted(births, F.col("kind") == "study", "__studies")
    studies = counted.where("kind = 'study'").select((F.col("__studies") - 1).alias("study_id"), F.col("line_no").alias("study_line"), F.col("text").alias("name"), F.col("list").alias("directions"))
    accepted = counted.where("kind = 'b'").where(F.col("study_id") < F.col("__studies")).select("line_no", "study_id")
    trials = _counted(accepted, F.lit(True), "__trials").select("line_no", (F.col("__trials") - 1).alias("trial_id"), "study_id")
    return studies, trials


def parse_journal(lines: DataFrame) -> Replay:
    """Replays ``lines`` (line_no, value). An empty journal has no studies; one without any valid line is an error."""
    writes = saved(journal_writes(lines))
    if writes.isEmpty() and not lines.where(F.trim("value") != "").isEmpty():
        raise JournalError("no valid JSON line")
    studies, trials = _created(writes)

    value = F.struct("num", "text", "list")
    fields = ["trial_id", "line_no", "kind", "key", "num", "text", "list"]
    later = writes.where(F.col("op").isin(5, 6, 8, 9)).select(*fields)
    at_birth = writes.where("op = 4").drop("trial_id", "study_id").join(trials, "line_no").withColumn("num", F.when(F.col("kind") == "b", F.col("study_id").cast("double")).otherwise(F.col("num"))).select(*fields)
    last = later.unionByName(at_birth).groupBy("trial_id", "kind", "key").agg(F.max_by(value, "line_no").alias("v"), F.max("line_no").alias("line"))
    every = last.groupBy("trial_id").agg(F.collect_list(F.struct("kind", "key", "line", "v")).alias("w"))
    every = every.withColumn("born", F.get(F.filter("w", lambda x: x["kind"] == "b"), F.lit(0))).where(F.col("born").isNotNull())
    every = every.withColumn("w", F.filter("w", lambda x: x["line"] >= F.col("born")["line"]))

    of = lambda kind: F.filter("w", lambda x: x["kind"] == kind)
    table = lambda kind, field: F.map_from_entries(F.array_sort(F.transform(of(kind), lambda x: F.struct(x["key"], x["v"][field]))))
    numbers = lambda kind: F.coalesce(F.get(of(kind), F.lit(0))["v"]["list"], F.array().cast("array<double>"))
    complete = saved(
        every.where(F.get(of("s"), F.lit(0))["v"]["num"] == 1).select(
            F.col("born")["v"]["num"].cast("long").alias("study_id"), "trial_id", table("p", "num").alias("params"), table("l", "text").alias("param_labels"), numbers("v").alias("objectives"),
            table("n", "num").alias("attrs_num"), table("t", "text").alias("attrs_str"), numbers("c").alias("constraints"),
        )
    )
    return Replay(_study_table(studies, writes, trials, complete), complete)


def _study_table(studies: DataFrame, writes: DataFrame, trials: DataFrame, complete: DataFrame) -> DataFrame:
    named = writes.where("kind = 'names'").select("study_id", "line_no", F.from_json("text", "array<string>").alias("names"))
    named = named.join(studies.select("study_id", "study_line"), "study_id").where(F.col("line_no") > F.col("study_line")).groupBy("study_id").agg(F.max_by("names", "line_no").alias("metric_names"))
    counts = trials.groupBy("study_id").agg(F.count(F.lit(1)).alias("total_trials"))
    names = lambda m: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys(m)))))
    found = complete.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("completed_trials"), names("params").alias("pn"), names("param_labels").alias("label_names"), names("attrs_num").alias("numeric_attr_names"), names("attrs_str").alias("sn"),
        F.max(F.size("constraints")).alias("n_constraints"), F.min_by(F.size("objectives"), F.when(F.size("objectives") > 0, F.col("trial_id"))).alias("n_objectives"),
    )
    table = studies.join(named, "study_id", "left").join(counts, "study_id", "left").join(found, "study_id", "left")
    text = F.array().cast("array<string>")
    defaults = F.transform(F.sequence(F.lit(0), F.col("n_objectives") - 1), lambda i: F.concat(F.lit("obj"), i.cast("string")))
    listed = lambda c: F.coalesce(c, text)
    return table.select(
        "study_id", "name", F.transform("directions", lambda x: F.when(x == 2, "maximize").otherwise("minimize")).alias("directions"),
        F.coalesce("completed_trials", F.lit(0)).alias("completed_trials"), F.coalesce("total_trials", F.lit(0)).alias("total_trials"),
        F.array_sort(F.array_union(listed(F.col("pn")), listed(F.col("label_names")))).alias("param_names"), listed(F.col("label_names")).alias("label_names"),
        F.coalesce("metric_names", F.when(F.col("n_objectives") > 0, defaults), text).alias("objective_names"),
        F.array_sort(F.array_union(listed(F.col("numeric_attr_names")), listed(F.col("sn")))).alias("user_attr_names"), listed(F.col("numeric_attr_names")).alias("numeric_attr_names"),
        F.coalesce("n_constraints", F.lit(0)).alias("n_constraints"), (F.coalesce("n_constraints", F.lit(0)) > 0).alias("has_constraints"),
    )
