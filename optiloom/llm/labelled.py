"""Bounded labelled samples and held-out marks shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows a classifier is fitted on. The sample is the rows of least hash, so it is the same on every run.
SAMPLE = 12000
#: Longest text, in bytes, that a classifier is fitted on. Longer ones are scored like all others.
SAMPLE_BYTES = 200_000


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, limit: int = SAMPLE) -> DataFrame:
    """Documents with column ``y`` (0 or 1) outside the held-out fold, at most ``limit`` rows: one for each id.

    Labels of unknown value are ignored; of repeated labels the greatest counts,
    of rows that repeat an id the one whose values have the least hash. Null and
    too long texts are not learnt from.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = documents.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id")  # bounded by limit
    rest = [c for c in found.columns if c != "doc_id"]
    row = F.struct(F.xxhash64(*rest).alias("__h"), *rest)
    return found.groupBy("doc_id").agg(F.min(row).alias("__r")).select("doc_id", *[F.col(f"__r.{c}").alias(c) for c in rest])
