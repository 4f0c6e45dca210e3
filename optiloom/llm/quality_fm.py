"""Quality by a factorisation machine.

Inputs are hashed words (frequencies scaled to unit length), structure
statistics and metadata. Pairwise interactions have rank ``RANK`` and are scored
in time linear in the inputs: the sum over pairs is half of the square of the
sum less the sum of squares, factor by factor. It is fitted on a bounded
labelled sample and scored in one narrow pass over whole texts.

Edge cases: null and empty texts have zero words and statistics of an empty
text; with labelled rows of one kind only all scores are the odds of that kind,
without any 0.5; an ``n_chars`` that is missing, null or no number is taken from
the text; repeated rows are scored alike, so ties are; very long texts are scored
whole, by one task each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiloom.llm import labelled
from optiloom.llm.words import Words, as_bytes, chunked, read_words, sums_by_doc

BITS = 14
RANK = 8
FOLDS, FOLD = 5, 0
THRESHOLD = 0.3
#: Byte classes whose shares are statistics: symbols, bars, exclamation marks, digits, capitals, line ends, full stops.
_CLASSES = (b"#*$%&<>", b"|", b"!", b"0123456789", bytes(range(65, 91)), b"\n", b".")
N_STATS = len(_CLASSES) + 7


def statistics(texts: list[bytes], words: Words, doc: np.ndarray, count: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """A row of structure statistics and metadata per text. ``doc`` and ``count``: text and count of each distinct word."""
    raw = np.frombuffer(words.data, np.uint8)
    bounds = np.r_[0, np.cumsum([len(x) + 1 for x in texts])]
    size = np.maximum(np.diff(bounds) - 1, 1)
    n = np.diff(words.first)
    table = np.zeros(256, np.uint8)
    for k, chars in enumerate(_CLASSES):
        table[list(chars)] = k + 1
    kinds = table[raw]
    counted = np.stack([np.bincount(kinds[a:b], minlength=len(_CLASSES) + 1)[1:] for a, b in zip(bounds[:-1], bounds[1:])]) if texts else np.zeros((0, len(_CLASSES)))
    top = np.zeros(len(texts))
    np.maximum.at(top, doc, count)
    distinct = np.bincount(doc, minlength=len(texts))
    letters = sums_by_doc((words.end - words.start).astype(float), words.first)
    every = np.maximum(n, 1)
    rest = (np.log1p(size), np.log1p(n), letters / every, distinct / every, top / every, np.log1p(np.maximum(n_chars, 0)), np.log1p(n / (counted[:, 5] + 1)))
    return np.column_stack([np.minimum(counted / size[:, None], 1) ** 0.5, *rest])


def inputs(texts: list[bytes], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the words, sorted by text, and the statistics."""
    words = read_words(texts)
    key, count = np.unique(words.doc << BITS | (words.hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    doc, bucket, count = key >> BITS, key & ((1 << BITS) - 1), count.astype(float)
    norm = np.sqrt(np.bincount(doc, count * count, len(texts)))
    return doc, bucket, count / norm[doc], statistics(texts, words, doc, count, n_chars)


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def margins(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid; words and statistics are inputs of one machine."""
        n, dense = len(stats), np.clip((stats - self.mean) / self.std, -4, 4)
        words = 1 << BITS
        linear = self.bias + np.bincount(doc, self.w[bucket] * value, n) + dense @ self.w[words:]
        cuts = np.searchsorted(doc, np.arange(n + 1))
        pairs = np.zeros(n)
        for k in range(self.v.shape[1]):
            x = self.v[bucket, k] * value
            y = dense * self.v[words:, k]
            total = sums_of(x, cuts) + y.sum(1)
            pairs += total * total - sums_of(x * x, cuts) - (y * y).sum(1)
        return linear + pairs / 2


def sums_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values)]
    return total[cuts[1:]] - total[cuts[:-1]]


def fit(examples: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], epochs: int = 2, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> Model:
    """AdaGrad on the logistic loss over (label, buckets, values, statistics)."""
    words, rng = 1 << BITS, np.random.default_rng(seed)
    w, v = np.zeros(words + N_STATS), rng.normal(0, 0.02, (words + N_STATS, RANK))
    good = sum(y for y, *_ in examples)
    if good in (0, len(examples)):  # nothing to tell apart: the odds of what was seen
        return Model(float(np.log((good + 0.5) / (len(examples) - good + 0.5))), w, np.zeros_like(v), np.zeros(N_STATS), np.ones(N_STATS))
    stats = np.array([s for *_, s in examples])
    mean, std = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    gw, gv = np.full(len(w), 1e-6), np.full(v.shape, 1e-6)
    bias, gb = 0.0, 1e-6
    tail = np.arange(words, words + N_STATS)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            y, bucket, value, s = examples[i]
            at = np.concatenate([bucket, tail])
            x = np.concatenate([value, np.clip((s - mean) / std, -4, 4)])
            vx = v[at] * x[:, None]
            total = vx.sum(0)
            margin = bias + w[at] @ x + (total @ total - (vx * vx).sum()) / 2
            g = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y
            dw = g * x + decay * w[at]
            dv = g * x[:, None] * (total - vx) + decay * v[at]
            gw[at] += dw * dw
            gv[at] += dv * dv
            gb += g * g
            w[at] -= rate * dw / np.sqrt(gw[at])
            v[at] -= rate * dv / np.sqrt(gv[at])
            bias -= rate * g / gb**0.5
    return Model(float(bias), w, v, mean, std)


def _selected(documents: DataFrame) -> DataFrame:
    n_chars = F.coalesce(F.col("n_chars").try_cast("double"), F.length("text").cast("double"), F.lit(0.0)) if "n_chars" in documents.columns else F.coalesce(F.length("text").cast("double"), F.lit(0.0))
    return documents.select("doc_id", n_chars.alias("n"), "text")


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most ``labelled.SAMPLE`` labelled documents outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_chars = as_bytes(batch.column(3)), batch.column(2).to_numpy(zero_copy_only=False)
            for low, high in chunked(texts):
                doc, bucket, value, stats = inputs(texts[low:high], n_chars[low:high])
                cuts = np.searchsorted(doc, np.arange(high - low + 1))
                x = [b"".join((bucket[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes())) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(1)[low:high], pa.array(x, pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], names=["doc_id", "y", "x", "s"])

    some = labelled.sample(_selected(documents), labels, "quality", FOLDS, FOLD).select("doc_id", "y", "n", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = some.mapInArrow(run, f"doc_id {kind}, y int, x binary, s binary").select(F.xxhash64("doc_id").alias("k"), "y", "x", "s").collect()
    examples = []
    for r in sorted(rows, key=lambda r: (r.k, r.x)):
        n = len(r.x) // 8
        examples.append((r.y, np.frombuffer(r.x, np.int32, n), np.frombuffer(r.x, np.float32, n, 4 * n).astype(float), np.frombuffer(r.s)))
    return fit(examples)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_chars = as_bytes(batch.column(3)), batch.column(2).to_numpy(zero_copy_only=False)
            parts = [model.margins(*inputs(texts[a:b], n_chars[a:b])) for a, b in chunked(texts)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *parts]), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    kept = _selected(documents).select("doc_id", labelled.held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "n", "text")
    return kept.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, train(documents, labels))
