"""SentencePiece encoding and decoding with a suffix array.

The new words of a batch are concatenated and indexed by a suffix array; every
piece of the vocabulary is looked up by binary search, which gives the ranges of
all its occurrences. Sorted by position, these occurrences are the edges of one
graph over the text: an edge from s to e is a piece that spells text[s:e]. The
graph is then relaxed in the order of a byte-pair model: in each word the edge
of best score over two neighbouring symbols joins them (the leftmost of equal
ones), until no edge does. Characters without a piece fall back to bytes.

Pieces never continue over the start of a word (checked on loading), so words
are independent, and each distinct word is encoded once per worker.

The vocabulary is read from the model file on the driver and travels with the
tasks; executors need neither the file nor the library.

Edge cases: null and empty texts encode to no ids and decode to the empty text;
a text that holds U+2581 decodes with a space in its place, as in the library;
repeated rows are encoded alike; a single word of very many characters takes
about 70 bytes of memory for each of them; empty tables give empty results; other
columns pass through, and the result's name may not be among them. Models that
are not byte-pair models, or that normalise text, are refused on loading.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Characters indexed by one suffix array.
INDEX_CHARS = 1 << 20
#: Words above this many characters are relaxed with a heap instead of in rounds.
LONG = 256
#: Texts encoded together.
ROWS = 2000
#: Texts on which a model's own ids are compared on loading, beside joined pieces: spaces, accents, wide and compatibility forms.
_PROBES = (" two  spaces ", "é e\u0301 ﬁ Ａ ½ ™", "unseparatedwordsthatmanypiecescover", "12345 67.89", "中文字", "🎈", "tab\there", "a\n\nb")
#: Words kept encoded by a worker.
CACHE = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Encoded:
    """Encoded words: ids end to end, where each word's begin, and the bytes they decode to."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.spelled: list[bytes] = []
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 12, np.int64)
        self.size = 0

    def add(self, words: list[str], ids: list[tuple[int, ...]], spelled: list[bytes]) -> None:
        flat = np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids)))
        n = len(self.place)
        while self.size + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.size : self.size + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(words)] = self.size + np.cumsum([len(x) for x in ids])
        self.size += len(flat)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))
        self.spelled += [b"".join([spelled[i] for i in x]) for x in ids]

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids) of the words at ``places``."""
        first, count = self.ends[places], self.ends[places + 1] - self.ends[places]
        stops = np.cumsum(count)
        return self.ids[np.repeat(first - stops + count, count) + np.arange(stops[-1] if len(stops) else 0)], count


@dataclass
class Vocabulary:
    """Pieces that spell text (with ids and ranks, best first), ids of bytes, and the bytes every id decodes to."""

    pieces: list[str]
    ids: list[int]
    ranks: list[int]
    byte_ids: list[int]
    spelled: list[bytes]
    mark: str = ""
    index_chars: int = INDEX_CHARS
    encoded: Encoded = field(default_factory=Encoded, repr=False)
    _table: tuple | None = field(default=None, repr=False)

    def __post_init__(self):
        self.mark = hashlib.sha256(repr((self.pieces, self.ids, self.ranks, self.byte_ids, self.spelled)).encode()).hexdigest()

    def __getstate__(self):
        return {**self.__dict__, "encoded": Encoded(), "_table": None}

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        every = range(model.get_piece_size())
        text = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in text]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece runs over the start of a word")
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        spelled = [b""] * len(every)
        for i, p in zip(text, pieces, strict=True):
            spelled[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            spelled[i] = bytes([b])
        order = np.lexsort((text, [-model.get_score(i) for i in text]))
        ranks = np.empty(len(text), int)
        ranks[order] = np.arange(len(text))
        made = cls(pieces, text, ranks.tolist(), byte_ids, spelled)
        probes = [*(p.replace(SPACE, " ") + q for p, q in zip(pieces[::37], pieces[-1::-37], strict=False)), *_PROBES]
        if any(model.encode(t) != ids for t, ids in zip(probes, made.encode_batch(probes), strict=True)):
            raise ValueError("not a byte-pair model without normalisation: its ids differ from those of these rules")
        return made

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces as padded code-point rows, lengths, ids, ranks."""
        if self._table is None:
            lengths = np.array([len(p) for p in self.pieces])
            rows = np.zeros((len(self.pieces), lengths.max()), np.uint32)
            for i, p in enumerate(self.pieces):
                rows[i, : len(p)] = [ord(c) for c in p]
            self._table = rows, lengths, np.array(self.ids), np.array(self.ranks)
        return self._table

    def encode_units(self, units: list[str]) -> None:
        """Encodes words that are not in ``encoded`` yet, into it."""
        low = size = 0
        for i, u in enumerate(units):
            size += len(u) + 1
            if size >= self.index_chars or i == len(units) - 1:
                self.encoded.add(units[low : i + 1], _relaxed(self, units[low : i + 1]), self.spelled)
                low, size = i + 1, 0

    def placed(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the places of its words in ``encoded``, which holds all of them then; only new words are held as strings."""
        if len(self.encoded.place) > CACHE:
            self.encoded = Encoded()
        have, out = self.encoded.place, []
        new: defaultdict[str, int] = defaultdict(itertools.count(len(have)).__next__)  # numbers words as they come
        for t in texts:
            units = _UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else []
            out.append(np.array([have[u] if u in have else new[u] for u in units], np.int32))
        self.encode_units(list(new))
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        return [self.encoded.of(p)[0].tolist() for p in self.placed(texts)]

    def decode(self, ids: list[int]) -> str:
        spelled = self.spelled
        raw = b"".join([spelled[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (code points) ordered by their first ``depth`` characters or more, by prefix doubling.

    The first round packs as many characters as fit into one number, by their places in the text's alphabet.
    """
    seen = np.unique(text)
    bits = max(len(seen).bit_length(), 1)
    code = np.searchsorted(seen, text).astype(np.int64) + 1
    done = min(62 // bits, max(depth, 1))  # characters that one number holds
    rank = np.zeros_like(code)
    for k in range(done):
        rank[: max(len(code) - k, 0)] |= code[k:] << (bits * (done - 1 - k))
    while done < depth:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64) + 1
        later = np.zeros_like(rank)
        later[:-done] = rank[done:] if done < len(rank) else 0
        rank = rank * (len(rank) + 2) + later
        done *= 2
    return np.argsort(rank)


def _bound(text: np.ndarray, order: np.ndarray, rows: np.ndarray, lengths: np.ndarray, right: bool) -> np.ndarray:
    """First place in the suffix array whose suffix is not below (``right``: is above all that start with) each piece."""
    low, high = np.zeros(len(rows), int), np.full(len(rows), len(order))
    while (low < high).any():
        live = np.flatnonzero(low < high)
        middle = (low[live] + high[live]) // 2
        at = order[middle]
        below, equal = np.zeros(len(live), bool), np.ones(len(live), bool)
        for k in range(rows.shape[1]):
            inside = equal & (k < lengths[live])
            if not inside.any():
                break
            have = text[np.minimum(at + k, len(text) - 1)]
            want = rows[live, k]
            have = np.where(at + k < len(text), have, 0)
            below |= inside & (have < want)
            equal &= ~inside | (have == want)
        go = below | equal if right else below
        low[live[go]] = middle[go] + 1
        high[live[~go]] = middle[~go]
    return low


def occurrences(vocabulary: Vocabulary, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, piece) of every occurrence of every piece, piece by piece."""
    rows, lengths, _, _ = vocabulary.table()
    order = suffix_array(text, rows.shape[1]).astype(np.int32)  # there are several edges a character, so they are held in 32 bits
    first, last = _bound(text, order, rows, lengths, False), _bound(text, order, rows, lengths, True)
    count = last - first
    piece = np.repeat(np.arange(len(rows), dtype=np.int32), count)
    begin = (first - np.cumsum(count) + count).astype(np.int32)  # place in the suffix array less number of the edge
    start = order[begin[piece] + np.arange(count.sum(), dtype=np.int32)]
    return start, lengths.astype(np.int32)[piece], piece


def edges(vocabulary: Vocabulary, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The :func:`occurrences` by start, then length."""
    start, length, piece = occurrences(vocabulary, text)
    by = np.lexsort((length, start))
    return start[by], length[by], piece[by]


def _relaxed(vocabulary: Vocabulary, units: list[str]) -> list[tuple[int, ...]]:
    joined = "\n".join([*units, ""])  # no piece holds a line feed
    text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    _, _, ids, ranks = vocabulary.table()
    start, length, piece = occurrences(vocabulary, text)  # a graph by place needs no order of its edges
    wide = vocabulary.table()[0].shape[1] + 1
    graph = np.full((len(text), wide), -1, np.int32)
    graph[start, length] = piece
    none = np.int64(len(ranks))
    sizes = np.array([len(u) for u in units])
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.ones(len(text), bool)  # where a symbol starts
    symbols[begin + sizes] = False
    unit = np.repeat(np.arange(len(units)), sizes + 1)
    for u in np.flatnonzero(sizes > LONG):
        symbols[begin[u] : begin[u] + sizes[u]] = _heap_relaxed(graph[begin[u] : begin[u] + sizes[u]], ranks)
    active = np.flatnonzero(symbols & (sizes[unit] <= LONG))
    while len(active) > 1:
        owner = unit[active]
        n = len(active)
        after = np.append(np.arange(1, n), n - 1)
        pair = owner[after] == owner
        pair[-1] = False
        nxt = np.append(np.arange(2, n), [n, n])[:n]
        stop = np.where((nxt < n) & (owner[np.minimum(nxt, n - 1)] == owner), active[np.minimum(nxt, n - 1)], begin[owner] + sizes[owner])
        span = stop - active
        fits = pair & (span < wide)
        found = np.where(fits, graph[active, np.where(fits, span, 0)], -1)
        rank = np.where(found >= 0, ranks[np.maximum(found, 0)], none)
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.minimum.reduceat(rank * np.int64(n) + np.arange(n), cuts)
        merged = best < none * np.int64(n)
        if not merged.any():
            break
        gone = best[merged] % n + 1
        symbols[active[gone]] = False
        stays = np.repeat(merged, np.diff(np.r_[cuts, n]))
        stays[gone] = False
        active = active[stays]
    return _ids(vocabulary, joined, graph, symbols, ids, begin, sizes, unit)


def _heap_relaxed(graph: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Symbol starts of one long word, by the same order of joins."""
    n, wide = graph.shape
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    queue: list[tuple[int, int, int, int]] = []

    def push(s: int) -> None:
        m = after[s]
        if m < n and (e := after[m]) - s < wide and (p := graph[s, e - s]) >= 0:
            heapq.heappush(queue, (int(ranks[p]), s, m, e))

    for s in range(n - 1):
        push(s)
    while queue:
        _, s, m, e = heapq.heappop(queue)
        if not alive[s] or m >= n or not alive[m] or after[s] != m or after[m] != e:
            continue
        alive[m] = False
        after[s] = e
        if e < n:
            before[e] = s
        push(s)
        if before[s] >= 0:
            push(before[s])
    return np.array(alive)


def _ids(vocabulary: Vocabulary, joined: str, graph: np.ndarray, symbols: np.ndarray, ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray, unit: np.ndarray) -> list[tuple[int, ...]]:
    at = np.flatnonzero(symbols)
    owner = unit[at]
    last = np.append(owner[1:] != owner[:-1], True)
    stop = np.where(last, begin[owner] + sizes[owner], np.append(at[1:], 0))
    piece = graph[at, stop - at]
    found = np.where(piece >= 0, ids[np.maximum(piece, 0)], -1).tolist()
    for k in np.flatnonzero(piece < 0).tolist():
        found[k] = tuple(vocabulary.byte_ids[b] for b in joined[at[k]].encode("utf-8", "surrogatepass"))
    cuts = np.searchsorted(owner, np.arange(len(sizes) + 1)).tolist()
    out = [tuple(found[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    for u in np.unique(owner[piece < 0]).tolist():
        out[u] = tuple(i for x in out[u] for i in (x if isinstance(x, tuple) else (x,)))
    return out


RESULT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
_ARROW = pa.struct([("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])
#: Vocabularies by content, so that a worker keeps its encoded words from task to task.
_WORKER: dict[str, Vocabulary] = {}


def _kept(vocabulary: Vocabulary) -> Vocabulary:
    return _WORKER.setdefault(vocabulary.mark, vocabulary)


def annotate(docs: DataFrame, vocabulary: Vocabulary, out: str = "pieces", text: str = "text") -> DataFrame:
    """``docs`` with struct column ``out``: the ids, and whether they decode to the text."""
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {out} is there already")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _kept(vocabulary)
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                texts = batch.column(text).to_pylist()
                places = own.placed(texts)
                spelled = own.encoded.spelled
                back = [b"".join([spelled[k] for k in p.tolist()]) for p in places]
                same = [(x[1:] if x[:1] == b" " else x).decode("utf-8", "replace") == (t or "") for x, t in zip(back, texts, strict=True)]
                sizes = np.array([len(p) for p in places])
                flat, count = own.encoded.of(np.concatenate(places))
                bounds = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(sizes)]].astype(np.int32)
                column = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)), pa.array(same, pa.bool_())], fields=list(_ARROW))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode_column(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the decoded text of a column of ids."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [vocabulary.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def digest(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids joined by commas) and round_trip."""
    from pyspark.sql import functions as F

    found = annotate(documents.select("doc_id", "text"), vocabulary)
    return found.select(
        "doc_id",
        F.size("pieces.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("pieces.ids", ","), 256).alias("ids_sha256"),
        F.col("pieces.round_trip").alias("round_trip"),
    )
