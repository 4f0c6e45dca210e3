"""Exact substring deduplication over prefix-partitioned suffix trees.

A window of ``window`` consecutive words is removed from a document when the
same words also start in a document of smaller id.

1. Every document is put in one of a number of *sheaves* that grows with the
   bytes of text; a sheaf is the unit of pre-aggregation.
2. Each sheaf reports its anchors: of the ``window - GRAM + 1`` word grams of
   a window, the first one of least hash. Equal windows have equal anchors, so
   a window whose anchor occurs in one document only repeats nowhere. Anchors
   found in several documents go back to the sheaves that hold them, with the
   number of their occurrences.
3. Around each such anchor a sheaf cuts a segment, all the words of the windows
   that have it: the suffixes that the tree needs are the ones that start in
   it. Each distinct segment goes out once, with the least id that holds it. A
   segment is partitioned by a prefix of variable length: the anchor's words
   if few share them, else those of a whole window (then one segment for each
   window). A partition is a memory-sized group.
4. Each group builds the suffix tree of its segments (sorted suffixes, lengths
   of common prefixes, and from these the internal nodes; what lies above a
   depth of ``window`` words is not built). Nodes at least
   ``window`` words deep are the repeats; the highest one above a leaf holds all
   suffixes that start with the same window, so that its least id decides.
   Windows of a greater id go back to the sheaves, which cut the words.

A very common passage costs one segment per sheaf, not one per document. Words
are compared by hashes of 64 bits each (long ones by XXH3), windows on their way back by 80 bits.
The text is dealt to the sheaves once for each of the steps 2, 3 and 4; each
step's shuffle files go when its result is written.

Edge cases: null and empty texts have no words; a null id is neither smaller
nor larger than any other, so its text stays and removes nothing; repeated rows
of one id do not remove each other; ids are integers; a very long text is read
in one piece by one task; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiloom.functions.storage import Scratch, saved
from optiloom.llm.words import Words, as_bytes, chunked, mix, read_words, rehash_long

WINDOW = 13
GRAM = 8
#: Bytes of text for each sheaf.
SHEAF_BYTES = 6 << 20
#: Occurrences of one anchor beyond which its segments are partitioned by whole windows.
GROUP_LIMIT = 4096
_NULL = np.iinfo(np.int64).max


def window_keys(codes: np.ndarray) -> np.ndarray:
    """128-bit keys of windows given by their words' codes, one row each."""
    out = np.zeros((len(codes), 2), np.uint64)
    for k in range(codes.shape[1]):
        word = codes[:, k]
        for side, salt in enumerate((0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)):
            out[:, side] = (out[:, side] ^ word) * np.uint64(salt)
            out[:, side] ^= out[:, side] >> np.uint64(29)
    return mix(out)


def _combined(hashes: np.ndarray, n: int, length: int) -> np.ndarray:
    """Order-sensitive hash of every run of ``n`` word hashes."""
    out = np.zeros(max(length, 0), np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return mix(out)


class Windows:
    """Windows of several texts: first word, text, anchor (its part of ``parts``, then 32 bits of its hash) and the anchor's first word."""

    def __init__(self, words: Words, window: int, gram: int, parts: int):
        h, doc = words.hashes, words.doc
        total = len(h) - window + 1
        starts = np.arange(max(total, 0))
        starts = starts[doc[starts] == doc[starts + window - 1]] if total > 0 else starts
        self.start, self.doc = starts, doc[starts] if len(starts) else starts
        grams = _combined(h, gram, len(h) - gram + 1)
        found, place = (grams[starts], starts.copy()) if len(starts) else (np.zeros(0, np.uint64), starts)
        for k in range(1, window - gram + 1):
            less = grams[starts + k] < found
            found[less], place[less] = grams[starts + k][less], starts[less] + k
        self.anchor = (found % np.uint64(parts)) << np.uint64(32) | found >> np.uint64(32)
        self.place, self.hashes = place, h

    def codes(self, at: np.ndarray, window: int) -> np.ndarray:
        """Word codes of the windows ``at``, one row each."""
        return self.hashes[self.start[at][:, None] + np.arange(window)]

    def segments(self, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, codes, starts) of the anchors of the windows ``at``, in order.

        A segment begins with the first word any of these windows may have; where the words of its windows end it holds zeros.
        Bit k of ``starts`` says that a window starts at its word k; ``window`` is the first of them.
        """
        if not len(at):
            return at, np.zeros((0, 2 * window - gram), np.uint64), np.zeros(0, np.uint32)
        first = np.flatnonzero(np.r_[True, self.place[at[1:]] != self.place[at[:-1]]])
        own = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(at)]))
        low = self.start[at[first]]
        starts = np.bitwise_or.reduceat(np.uint32(1) << (self.start[at] - low[own]).astype(np.uint32), first)
        last = np.maximum.reduceat(self.start[at], first) + window
        words = low[:, None] + np.arange(2 * window - gram)
        codes = np.where(words < last[:, None], self.hashes[np.minimum(words, len(self.hashes) - 1)], np.uint64(0))
        return at[first], codes, starts


def first_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, is_first) of rows sorted by the columns, the first column most significant."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), bool)
    if len(order):
        fresh[0] = True
        for c in columns:
            s = c[order]
            fresh[1:] |= s[1:] != s[:-1]
    return order, fresh


def _spread(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct key: the row of its least ``low``, and its greatest ``high``."""
    order = np.lexsort((low, key[:, 1], key[:, 0]))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[order[1:]] != key[order[:-1]]).any(1)
    cuts = np.flatnonzero(fresh)
    return order[cuts], np.maximum.reduceat(high[order], cuts)


def suffixes_of(starts: np.ndarray, width: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, first word) of the suffixes that start in the segments."""
    at = [np.flatnonzero(starts >> np.uint32(k) & np.uint32(1)) for k in range(width - window + 1)]
    return np.concatenate(at), np.repeat(np.arange(len(at)), [len(x) for x in at])


def suffix_tree(codes: np.ndarray, segment: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, common, keys): suffixes in tree order, the words each but the first shares with the one before it, and the keys of their windows.

    Only nodes of ``window`` words or more are built, so the edges above them
    are taken as one symbol, the window's key; below it follow the single words
    to the end of the segment, which holds zeros behind its last word.
    """
    width = codes.shape[1]
    keys = np.zeros((len(segment), 2), np.uint64)
    cuts = np.searchsorted(first, np.arange(width - window + 2))
    for k in range(width - window + 1):
        at = slice(cuts[k], cuts[k + 1])
        keys[at] = window_keys(codes[segment[at], k : k + window])
    word = lambda at, j: np.where(first[at] + j < width, codes[segment[at], np.minimum(first[at] + j, width - 1)], np.uint64(0))
    every = np.arange(len(segment))
    order = np.lexsort([*[word(every, j) for j in range(width - 1, window - 1, -1)], keys[:, 1], keys[:, 0]])
    common = np.zeros(max(0, len(order) - 1), np.int64)
    going = np.arange(len(common))
    for j in range(width):  # pairs of neighbours drop out at the first word in which they differ
        now, before = word(order[going + 1], j), word(order[going], j)
        going = going[(now == before) & (now != 0)]
        common[going] += 1
    return order, common, keys


def internal_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) leaves of the highest nodes at least ``depth`` words deep; a leaf that shares less is a node of its own."""
    cuts = np.flatnonzero(np.r_[True, common < depth])
    return cuts, np.r_[cuts[1:], len(common) + 1]


def deep_leaves(codes: np.ndarray, starts: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, key of the window, least id) for each suffix that starts in the segments, by the tree's nodes of ``window`` words or more."""
    segment, first = suffixes_of(starts, codes.shape[1], window)
    if not len(segment):
        return segment, np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
    order, common, keys = suffix_tree(codes, segment, first, window)
    low, high = internal_nodes(common, window)
    return segment[order], keys[order], np.repeat(np.minimum.reduceat(ids[segment[order]], low), high - low)


def _sheaves(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int]:
    """(sheaf, id, text) and the number of sheaves, by the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // SHEAF_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("sheaf", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")).select("sheaf", "id", "text"), n


def _read(table: pa.Table, window: int, gram: int, parts: int) -> Iterator[tuple[list[bytes], np.ndarray, Words, Windows]]:
    """Texts, ids (``_NULL`` for null), words and windows, chunk by chunk."""
    texts, ids = as_bytes(table.column("text")), table.column("id").to_pylist()
    for low, high in chunked(texts, 1 << 20):
        words = rehash_long(read_words(texts[low:high]))
        yield texts[low:high], np.array([_NULL if i is None else i for i in ids[low:high]], np.int64), words, Windows(words, window, gram, parts)


def _anchors_of(window: int, gram: int, n: int):
    def run(table: pa.Table) -> pa.Table:
        grams, low, high, count = [], [], [], []
        for _, ids, _, win in _read(table, window, gram, n):
            own = ids[win.doc] if len(win.doc) else np.zeros(0, np.int64)
            live = own != _NULL
            a, d = win.anchor[live], own[live]
            order = np.argsort(a, kind="stable")
            a, d = a[order], d[order]
            cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
            if len(cuts):
                grams.append(a[cuts])
                low.append(np.minimum.reduceat(d, cuts))
                high.append(np.maximum.reduceat(d, cuts))
                count.append(np.diff(np.r_[cuts, len(a)]))
        sheaf = table.column("sheaf")[0].as_py()
        if not grams:
            return pa.table({"part": pa.array([], pa.int32()), "sheaf": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        g, lo, hi, c = (np.concatenate(x) for x in (grams, low, high, count))
        order, fresh = first_of(g)
        cuts = np.flatnonzero(fresh)
        g = g[order][cuts]
        lo, hi, c = np.minimum.reduceat(lo[order], cuts), np.maximum.reduceat(hi[order], cuts), np.add.reduceat(c[order], cuts)
        edges = np.searchsorted(g >> np.uint64(32), np.arange(n + 1))
        blobs, parts = [], []
        for k in np.flatnonzero(np.diff(edges)):
            at = slice(edges[k], edges[k + 1])
            counted = np.minimum(c[at], 1 << 30).astype(np.uint32) | (hi[at] != lo[at]).astype(np.uint32) << np.uint32(31)
            blobs.append(b"".join((g[at].astype(np.uint32).tobytes(), lo[at].tobytes(), counted.tobytes())))
            parts.append(int(k))
        return pa.table({"part": pa.array(parts, pa.int32()), "sheaf": pa.array([sheaf] * len(parts), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _split(blobs: list[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of blobs holding ``width`` arrays each, and the blob of every row."""
    arrays = [np.frombuffer(b, np.uint64).reshape(width, -1) for b in blobs]
    return [np.concatenate([a[k] for a in arrays]) for k in range(width)], np.repeat(np.arange(len(arrays)), [a.shape[1] for a in arrays])


def _columns(blobs: list[bytes], kinds: list) -> list[np.ndarray]:
    """Columns of blobs that hold one array of each kind, and the blob of every row."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    sizes, out, at = [len(b) // width for b in blobs], [], 0
    for kind in kinds:
        out.append(np.concatenate([np.frombuffer(b, kind, n, at * n) for b, n in zip(blobs, sizes, strict=True)]))
        at += np.dtype(kind).itemsize
    return [*out, np.repeat(np.arange(len(sizes)), sizes)]


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Anchors of several documents, back to each sheaf that holds them, with their number of suffixes."""
    sheaves = np.array(table.column("sheaf").to_pylist(), np.int64)
    g, low, counted, blob = _columns(table.column("blob").to_pylist(), [np.uint32, np.int64, np.uint32])
    g = np.uint64(table.column("part")[0].as_py()) << np.uint64(32) | g.astype(np.uint64)
    order, fresh = first_of(g)
    cuts = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    low, counted = low[order], counted[order]
    many = (np.minimum.reduceat(low, cuts) != np.maximum.reduceat(low, cuts)) | (np.maximum.reduceat(counted >> np.uint32(31), cuts) > 0)
    total = np.add.reduceat((counted & np.uint32(0x7FFFFFFF)).astype(np.uint64), cuts)
    keep = many[group]
    g, weight, owner = g[order][keep], total[group][keep], sheaves[blob[order][keep]]
    by = np.argsort(owner, kind="stable")
    names, firsts = np.unique(owner[by], return_index=True)
    blobs = [np.concatenate([g[at], weight[at]]).tobytes() for at in np.split(by, firsts[1:])] if len(names) else []
    return pa.table({"sheaf": pa.array(names, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _segments_of(window: int, gram: int, n: int, limit: int):
    width = 2 * window - gram
    empty = pa.table({"part": pa.array([], pa.int32()), "sheaf": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        (shared, weight), _ = _split(right.column("blob").to_pylist(), 2)
        order = np.argsort(shared)
        shared, weight = shared[order], weight[order]
        found, seen = [], 0
        for _, own, _, win in _read(left, window, gram, n):
            if not len(win.anchor):
                continue
            at = np.minimum(np.searchsorted(shared, win.anchor), len(shared) - 1)
            hit = (shared[at] == win.anchor) & (own[win.doc] != _NULL)
            often = weight[at] > limit
            first, codes, starts = win.segments(np.flatnonzero(hit & ~often), window, gram)
            alone = np.flatnonzero(hit & often)
            single = np.zeros((len(alone), width), np.uint64)
            single[:, :window] = win.codes(alone, window)
            lead = np.r_[first, alone]
            prefix = np.r_[win.anchor[first] >> np.uint64(32), window_keys(single)[:, 0] % np.uint64(n)]
            found.append((np.concatenate([codes, single]), np.r_[starts, np.ones(len(alone), np.uint32)], own[win.doc[lead]], prefix.astype(np.int64), seen + lead))
            seen += len(win.start)
        if not found:
            return empty
        codes, starts, ids, part, place = (np.concatenate(x) for x in zip(*found, strict=True))
        at, most = _spread(window_keys(np.column_stack([codes, starts.astype(np.uint64), part.astype(np.uint64)])), ids, ids)
        several = (most != ids[at]).astype(np.uint8)
        by = np.lexsort((place[at], part[at]))
        edges = np.searchsorted(part[at][by], np.arange(n + 1))
        sheaf = left.column("sheaf")[0].as_py()
        parts, blobs = [], []
        for k in np.flatnonzero(np.diff(edges)):
            some = by[edges[k] : edges[k + 1]]
            rows = at[some]
            blobs.append(b"".join((ids[rows].tobytes(), several[some].tobytes(), starts[rows].tobytes(), codes[rows].tobytes())))
            parts.append(int(k))
        return pa.table({"part": pa.array(parts, pa.int32()), "sheaf": pa.array([sheaf] * len(parts), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _repeats_of(window: int, gram: int):
    width = 2 * window - gram

    def run(table: pa.Table) -> pa.Table:
        sheaves = np.array(table.column("sheaf").to_pylist(), np.int64)
        ids, several, starts, rows, blob = _columns(table.column("blob").to_pylist(), [np.int64, np.uint8, np.uint32, np.dtype((np.void, 8 * width))])
        codes = np.frombuffer(rows.tobytes(), np.uint64).reshape(-1, width)
        segment, keys, least = deep_leaves(codes, starts, ids, window)
        told = (least < ids[segment]) | (several[segment] > 0)  # sheaves with a text to cut
        segment, keys, least = segment[told], keys[told], least[told]
        owner = sheaves[blob[segment]]
        order, fresh = first_of(owner.astype(np.uint64), keys[:, 0], keys[:, 1])
        order = order[fresh]  # a window has one least id, whichever segment it was found in
        names, firsts = np.unique(owner[order], return_index=True)
        blobs = []
        for rows in np.split(order, firsts[1:]) if len(names) else []:
            blobs.append(b"".join((keys[rows, 0].tobytes(), keys[rows, 1].astype(np.uint16).tobytes(), least[rows].tobytes())))
        return pa.table({"sheaf": pa.array(names, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _cut(window: int, gram: int, n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        one, two, least = np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64)
        if right.num_rows:  # 80 bits of a key tell the windows of one sheaf apart
            one, two, low, _ = _columns(right.column("blob").to_pylist(), [np.uint64, np.uint16, np.int64])
            order = np.lexsort((two, one))
            one, two, least = one[order], two[order], low[order]
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
        for texts, own, words, win in _read(left, window, gram, n):
            gone = np.zeros(len(words.hashes) + 1, np.int64)
            if len(one):
                for low in range(0, len(win.start), 1 << 17):
                    starts, d = win.start[low : low + (1 << 17)], own[win.doc[low : low + (1 << 17)]]
                    key = window_keys(win.codes(np.arange(low, low + len(starts)), window))
                    short = key[:, 1].astype(np.uint16)
                    at = np.minimum(np.searchsorted(one, key[:, 0]), len(one) - 1)
                    while (late := (one[at] == key[:, 0]) & (two[at] < short) & (at < len(one) - 1)).any():
                        at = at + late  # equal first halves lie side by side
                    bad = (one[at] == key[:, 0]) & (two[at] == short) & (least[at] < d) & (d != _NULL)
                    np.add.at(gone, starts[bad], 1)
                    np.add.at(gone, starts[bad] + window, -1)
            keep = np.cumsum(gone[:-1]) == 0
            for k in range(len(own)):
                a, b = words.first[k], words.first[k + 1]
                rest = np.flatnonzero(keep[a:b]) + a if not keep[a:b].all() else range(b - a)
                kept = texts[k].split() if len(rest) == b - a else [words.data[s:e] for s, e in zip(words.start[rest].tolist(), words.end[rest].tolist())]
                out["doc_id"].append(None if own[k] == _NULL else int(own[k]))
                out["n_words"].append(int(b - a))
                out["n_removed"].append(int(b - a - len(rest)))
                out["kept"].append(b" ".join(kept).decode())
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.string())})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces, for every row."""
    gram = min(GRAM, window)
    rows, n = _sheaves(docs, id_col, text)
    by, work = rows.groupBy("sheaf"), Scratch(docs.sparkSession)
    anchors = by.applyInArrow(_anchors_of(window, gram, n), "part int, sheaf int, blob binary")
    shared = work.save(anchors.groupBy("part").applyInArrow(_shared_anchors, "sheaf int, blob binary"))
    segments = by.cogroup(shared.groupBy("sheaf")).applyInArrow(_segments_of(window, gram, n, limit), "part int, sheaf int, blob binary")
    repeats = saved(segments.groupBy("part").applyInArrow(_repeats_of(window, gram), "sheaf int, blob binary"))
    work.drop()
    return by.cogroup(repeats.groupBy("sheaf")).applyInArrow(_cut(window, gram, n), "doc_id long, n_words long, n_removed long, kept string")


def digest(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
