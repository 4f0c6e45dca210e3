"""Corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last keep the
columns of ``documents``.

Edge cases, in all stages: an empty table gives an empty table; rows that repeat
an id are judged each on its own, but of near copies with one id one row stays;
other columns pass through all but the last stage. What a null or empty text
comes to is said at each stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optiloom.functions.storage import Scratch
from optiloom.llm import decontaminate, line_dedup, pieces, quality_rules, simhash


#: Characters in one suffix array of the last stage: few, as its executors still hold the heap of the stages before.
INDEX_CHARS = 1 << 18
#: Rows of an Arrow batch, of which JVM and Python hold a few at once beside that heap.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failed lines. Null and empty texts fail."""
    return quality_rules.clean(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier line or nearly so; of equal ones the line of the least id stays. Null texts stay null."""
    return line_dedup.clean(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies: five-word shingles of Jaccard similarity 4/5 or more, found exactly, not within the two bits of op10's contract. Null and empty texts are one group."""
    return simhash.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; an empty benchmark and null texts leave them as they are."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and whether they decode to the text. Null and empty texts have no tokens."""
    vocabulary = replace(pieces.Vocabulary.load(), index_chars=INDEX_CHARS)
    coded = pieces.annotate(docs.select("doc_id", "text"), vocabulary)
    return coded.select("doc_id", F.col("pieces.ids").alias("tokens"), F.size("pieces.ids").cast("long").alias("n_tokens"), F.col("pieces.round_trip").alias("round_trip"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", token_stage),
]
#: Near-duplicate lines, components and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_ROWS`` rows at most; afterwards of as many as before."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        work = Scratch(spark)
        with small_batches(spark):
            docs = work.save(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        before = work
    return docs
