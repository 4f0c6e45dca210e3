"""Benchmark decontamination with an Aho-Corasick automaton.

Every run of ``WINDOW`` words of a benchmark item (or all its words, if fewer)
is a pattern of one automaton over normalised text; each document is normalised
and scanned once, and hits are mapped back to offsets in the original text.

The automaton lives in every worker, so its input is bounded: a benchmark of
more than ``SHARD_BYTES`` of text is split by item and the documents pass
through one automaton after another in the same task, without a shuffle. A task
keeps ``KEPT`` automata over all its batches; with more of them documents are gathered
to ``GROUP_BYTES`` before each automaton is made anew and reads them all.

Edge cases: null texts have no words; a null item id counts as the empty id;
items without words match nothing; repeated items and rows are harmless (items
are counted by distinct id); an empty benchmark contaminates nothing. Columns
of the documents pass through; the result is in one struct column whose name
the caller chooses and which may not be among them (``__decon`` in :func:`clean`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optiloom.llm.words import as_bytes

WINDOW = 10
#: Benchmark text in one automaton. A byte costs about ten trie nodes of some fifty bytes.
SHARD_BYTES = 256 << 10
#: Automata that a task keeps.
KEPT = 4
#: Bytes of documents that pass through all automata together where these are more than a task keeps.
GROUP_BYTES = 64 << 20
#: ASCII letters and digits, lower-cased, and all bytes of other characters stay; the rest become spaces.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ORIGINAL_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def build(items: list[tuple[str, bytes]]):
    """The automaton, or None without patterns. Values: (number of words, ids)."""
    import ahocorasick

    owners: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        found = normal_words(text)
        n = min(WINDOW, len(found))
        for i in range(len(found) - n + 1 if n else 0):
            owners.setdefault(b" ".join(found[i : i + n]), (n, set()))[1].add(item)
    if not owners:
        return None
    automaton = ahocorasick.Automaton()
    for key, (n, ids) in owners.items():
        automaton.add_word(f" {key.decode('latin-1')} ", (n, frozenset(ids)))
    automaton.make_automaton()
    return automaton


def scan_text(automaton, text: bytes) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, which words are hit, and the ids whose patterns occur."""
    found = normal_words(text)
    line = b" " + b" ".join(found) + b" "
    hits = list(automaton.iter(line.decode("latin-1"))) if automaton is not None and found else []
    marks = np.zeros(len(found) + 1, np.int64)
    ids: set[str] = set()
    if hits:
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        after = np.searchsorted(spaces, [e for e, _ in hits])
        np.add.at(marks, after, -1)
        np.add.at(marks, after - [n for _, (n, _) in hits], 1)
        for _, (_, some) in hits:
            ids |= some
    return len(found), np.cumsum(marks[:-1]) > 0, ids


def original_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code-point ranges of the original text."""
    bounds = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False]))
    return [{"start": bounds[a][0], "end": bounds[b - 1][1]} for a, b in edges.reshape(-1, 2)]


def _shards(benchmark: DataFrame, item_id: str, text: str) -> list[list[tuple[str, bytes]]]:
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where(F.length("t") > 0)
    out: list[list[tuple[str, bytes]]] = []
    size = SHARD_BYTES
    for r in sorted(rows.distinct().collect()):
        if size >= SHARD_BYTES:
            out.append([])
            size = 0
        out[-1].append((r.i, r.t.encode()))
        size += len(out[-1][-1][1])
    return out


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield held
            held = []
    if held:
        yield held


def annotate(docs: DataFrame, benchmark: DataFrame, out: str = "decon", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with struct column ``out``: n_words, n_hit, sorted item ids, spans in the original text."""
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {out} is there already")
    shards = _shards(benchmark, item_id, item_text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, RESULT)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = len(shards) <= KEPT
        automata = [build(items) for items in shards] if few else None
        for held in _gathered(batches, 0 if few else GROUP_BYTES):
            texts = [as_bytes(b.column(text)) for b in held]
            states = [[(len(normal_words(x)), None, set()) for x in own] for own in texts] if not shards else None
            for k, items in enumerate(shards):
                automaton = automata[k] if automata else build(items)
                new = [[scan_text(automaton, x) for x in own] for own in texts]
                states = new if states is None else [[(n, a | b, i | j) for (n, a, i), (_, b, j) in zip(*both, strict=True)] for both in zip(states, new, strict=True)]
            for batch, own, state in zip(held, texts, states, strict=True):
                yield told(batch, own, state)

    def told(batch: pa.RecordBatch, texts: list[bytes], state: list[tuple]) -> pa.RecordBatch:
        rows = []
        for raw, (n, hit, ids) in zip(texts, state, strict=True):
            some = hit is not None and hit.any()
            rows.append({"n_words": n, "n_hit": int(hit.sum()) if some else 0, "items": sorted(ids), "spans": original_spans(raw.decode("utf-8", "replace"), hit) if some else []})
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], names=[*batch.schema.names, out])

    return docs.mapInArrow(scan, schema)


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = annotate(documents.select("doc_id", "text"), benchmark)
    d = F.col("decon")
    return found.select(
        "doc_id",
        d["n_words"].alias("n_words"),
        d["n_hit"].alias("n_hit"),
        F.size(d["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(d["items"], ","), 256).alias("items_sha256"),
        (d["n_hit"] > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark window; same columns."""
    return annotate(docs, benchmark, "__decon").where(F.col("__decon.n_hit") == 0).select(*docs.columns)
