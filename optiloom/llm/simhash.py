"""SimHash near-duplicate groups over a Gray-order hierarchical index.

Fingerprints are the bitwise majority of the XXH64 values of word shingles.
Two fingerprints within two bits agree on at least four of six parts of the 64
bits, so each distinct fingerprint is filed under the fifteen choices of four
parts; each group is searched with :mod:`gray_index`. A group's members differ
in the two free parts only, at most 22 bits, so a group holds at most 2**22
distinct fingerprints (32 MB) whatever the corpus: copies of a text are one
fingerprint. Groups emit a spanning forest, not all pairs, and components are
found on distributed edges.

Edge cases: null and empty texts have fingerprint zero, linked like any other;
rows with a null id take part but never name a component (a component of null
ids only is null); repeated rows come back once each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiloom.llm import near_copies
from optiloom.llm.components import checkpointed, components
from optiloom.llm.fingerprints import LIMIT, SHINGLE, fingerprint, links, with_fingerprints  # noqa: F401


def group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    marked = checkpointed(with_fingerprints(docs, id_col, text, shingle))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least")))
    nodes = components(links(distinct, limit))
    named = distinct.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def digest(documents: DataFrame) -> DataFrame:
    return group(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of :mod:`near_copies`, that of the least id; of rows that repeat an id one stays; rows without an id all stay. Same columns."""
    found = near_copies.groups(docs, id_col, text)
    go = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__go")).distinct()
    left = docs.join(go, docs[id_col] == go["__go"], "left_anti")
    if found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        return left
    single = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return single.unionByName(left.where(F.col(id_col).isNull()))
