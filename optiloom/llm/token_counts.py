"""Token counts of a byte-pair SentencePiece model, by a whole-token shortcut.

A text falls into pre-tokens: a word with the spaces before it, or a line feed
with what follows it up to the next space or line feed. No piece continues over
the start of a word and none holds a line feed (both are checked on loading), so
the tokens of a text are those of its pre-tokens.

Most frequent words are pieces, but a piece in the vocabulary need not be what
the model makes of that string: its own joins may lead elsewhere. So every piece
is run through the joins once, on the driver, before any text is read; those that
end as one token are the proven ones. A pre-token among them counts one by a
dictionary look-up. Only the rest is merged: all new pre-tokens of a batch
together, each round joining in every pre-token the two neighbouring symbols that
spell the best piece (the leftmost of equal ones). A worker keeps their counts,
up to a bound.

Tables of pairs and proven strings are as large as the vocabulary and go out with
the tasks; executors need neither the model file nor its library.

Edge cases: null and empty texts have no tokens; U+2581 counts as a space, as in
the library; characters without a piece count as their bytes; bytes that are no
UTF-8 count as U+FFFD; a single word of very many characters is joined with a heap,
at some 300 bytes of memory for each of them; repeated rows and ids are counted
alike; an empty table gives an empty result; other columns pass through, and those
of the result may not be among them. Models other than byte-pair models without
normalisation are refused on loading.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optiloom.llm.pieces import SPACE, Vocabulary

#: Tokens above which a document is over the limit.
LIMIT = 4096
#: Pre-tokens, proven ones among them, whose counts a worker keeps.
CACHE = 1_000_000
#: Characters of texts that are split at once; a longer text is split alone.
CHARS = 4 << 20
#: Pre-tokens above this many characters are joined with a heap.
LONG = 256
#: Characters of pre-tokens that are joined together.
JOINED = 1 << 20
_NONE = np.iinfo(np.int64).max >> 24
_SLOW = re.compile(" +[^ \n]*|\n[^ \n]*")


@dataclass
class Merges:
    """Which neighbouring symbols join into what, and which strings are proven to be one token."""

    chars: np.ndarray  # code points that occur in pieces, ascending
    char_symbol: np.ndarray
    char_weight: np.ndarray  # tokens of a character that stays alone
    keys: np.ndarray  # left symbol * n + right symbol, ascending
    rank: np.ndarray
    made: np.ndarray
    n: int
    mark: str
    whole: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Merges:
        rank = dict(zip(vocabulary.pieces, vocabulary.ranks, strict=True))
        if any("\n" in p for p in rank):
            raise ValueError("a piece holds a line feed")
        symbols = {s: i for i, s in enumerate(dict.fromkeys([*rank, *"".join(rank)]))}
        n = len(symbols)
        pairs = {symbols[p[:k]] * n + symbols[p[k:]]: p for p in rank for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        keys = np.array(sorted(pairs), np.int64)
        chars = sorted({c for p in rank for c in p})
        made = cls(
            np.array([ord(c) for c in chars], np.uint32),
            np.array([symbols[c] for c in chars], np.int64),
            np.array([1 if c in rank else len(c.encode()) for c in chars], np.int64),
            keys,
            np.array([rank[pairs[k]] for k in keys.tolist()], np.int64),
            np.array([symbols[pairs[k]] for k in keys.tolist()], np.int64),
            n,
            vocabulary.mark,
        )
        every = list(rank)
        made.whole = frozenset(p for p, k in zip(every, made.counts(every).tolist(), strict=True) if k == 1)
        return made

    def _joins(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of each pair's join; a rank of ``_NONE`` where there is none."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.rank[at], _NONE), self.made[at]

    def counts(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit, a string with ``SPACE`` for every space."""
        out = np.zeros(len(units), np.int64)
        short: list[int] = []
        size = 0
        for i, u in enumerate(units):
            if len(u) > LONG:
                out[i] = self._heap(u)
                continue
            short.append(i)
            size += len(u)
            if size > JOINED:
                out[short] = self._rounds([units[k] for k in short])
                short, size = [], 0
        if short:
            out[short] = self._rounds([units[k] for k in short])
        return out

    def _read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, tokens if it stays alone) of each character; symbol -1 where no piece holds it."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        known = self.chars[at] == code
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        return np.where(known, self.char_symbol[at], -1), np.where(known, self.char_weight[at], width)

    def _rounds(self, units: list[str]) -> np.ndarray:
        sizes = np.array([len(u) for u in units])
        symbol, weight = self._read("".join(units))
        owner = np.repeat(np.arange(len(units)), sizes)
        out = np.zeros(len(units), np.int64)

        def joins(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            after = np.minimum(at + 1, len(symbol) - 1)
            rank, made = self._joins(symbol[at], symbol[after])
            return np.where((owner[at] == owner[after]) & (after > at), rank, _NONE), made

        rank, made = joins(np.arange(len(symbol)))
        while len(symbol):
            cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(symbol))
            best = np.minimum.reduceat(rank * len(symbol) + place, cuts)
            go = best < _NONE * len(symbol)
            spread = np.repeat(go, np.diff(np.r_[cuts, len(symbol)]))
            np.add.at(out, owner[~spread], weight[~spread])
            left = best[go] % len(symbol)
            symbol[left], weight[left] = made[left], 1
            spread[left + 1] = False  # the right symbols are gone, and words without joins are done
            new = np.cumsum(spread) - 1
            symbol, weight, owner, rank, made = symbol[spread], weight[spread], owner[spread], rank[spread], made[spread]
            left = new[left]
            touched = np.unique(np.r_[left, np.maximum(left - 1, 0)])
            if len(touched):
                rank[touched], made[touched] = joins(touched)
        return out

    def _heap(self, unit: str) -> int:
        symbol, weight = (x.tolist() for x in self._read(unit))
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = np.array(symbol)
        rank, made = self._joins(first[:-1], first[1:])
        queue = [(r, i, symbol[i], symbol[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist(), strict=True)) if r < _NONE]
        heapq.heapify(queue)

        def push(i: int) -> None:
            if i >= 0 and after[i] < n:
                a, b = symbol[i], symbol[after[i]]
                at = int(np.searchsorted(self.keys, a * self.n + b))
                if a >= 0 and b >= 0 and at < len(self.keys) and self.keys[at] == a * self.n + b:
                    heapq.heappush(queue, (int(self.rank[at]), i, a, b, int(self.made[at])))

        while queue:
            _, i, a, b, m = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], weight[i], symbol[j], weight[j] = m, 1, -2, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(before[i])
            push(i)
        return sum(weight)


def pretokens(text: str) -> list[str]:
    """Keys of a text's pre-tokens: ``w`` for a word after one space (or at the start), the unit itself for a word after
    several, and a line feed with what follows it."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " in text or text[:1] == " ":
        return [u[1:] if u[0] == " " and u[1:2] != " " else u.replace(" ", SPACE) for u in _SLOW.findall(" " + text)]
    return text.replace("\n", " \n").split(" ") if text else []


class Counts(dict):
    """Token counts by pre-token key; starts with the proven strings."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._start()

    def _start(self) -> None:
        self.clear()
        self["\n"] = 1
        for p in self.merges.whole:
            if p[:1] != SPACE:
                self["\n" + p] = 2
            elif p[1:2] != SPACE:
                self[p[1:]] = 1
            else:
                self[p] = 1

    def learn(self, keys: set[str]) -> None:
        """Merges all ``keys`` that are not known yet."""
        new = list(keys.difference(self))
        if len(self) + len(new) > CACHE:
            self._start()
            new = list(keys.difference(self))
        lines = np.array([k[:1] == "\n" for k in new], bool)
        units = [k[1:] if k[:1] == "\n" else k if k[:1] == SPACE else SPACE + k for k in new]
        self.update(zip(new, (self.merges.counts(units) + lines).tolist(), strict=True))

    def of(self, texts: list[str | None]) -> list[int]:
        split = [pretokens(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        return [sum(map(self.__getitem__, keys)) for keys in split]


#: Counts by vocabulary, so that a worker keeps them from task to task.
_WORKER: dict[str, Counts] = {}


def _texts(column: pa.Array) -> list[str | None]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def count(docs: DataFrame, merges: Merges, out: str = "n_tokens", text: str = "text") -> DataFrame:
    """``docs`` with long column ``out``, the number of tokens of each text."""
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {out} is there already")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _WORKER.setdefault(merges.mark, Counts(merges))
        for batch in batches:
            texts = _texts(batch.column(text))
            found: list[int] = []
            low = size = 0
            for i, t in enumerate(texts):
                if size + len(t or "") > CHARS and i > low:
                    found += own.of(texts[low:i])
                    low, size = i, 0
                size += len(t or "")
            found += own.of(texts[low:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def digest(documents: DataFrame, vocabulary: Vocabulary, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    found = count(documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), Merges.of(vocabulary))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
